"""The review log, its fold into current state, and what is counted over both (ST7, A18 to A20, A29, J1 to J7, W2 to W4, O3 to O9)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.schema import FIELDS

# States, and the state each action leads to (none: it stays).
STATUSES = ("pending", "in_review", "approved", "rejected", "needs_revision")
LEADS_TO = {"flagged": "pending", "assigned": "in_review", "approved": "approved", "rejected": "rejected"}


def state(log: DataFrame) -> DataFrame:
    """The current state of each record, from its events (record_id, session_id, ts, event_id, action, reviewer, confidence) in time order.

    Any state may follow any other. One aggregation: the latest of each kind is a maximum of (ts, event_id), so hot records combine before the shuffle.
    """
    when = F.struct("ts", "event_id")
    leads = F.create_map(*[F.lit(x) for p in LEADS_TO.items() for x in p])
    status = F.try_element_at(leads, F.col("action"))
    last = lambda value, test: F.max_by(F.when(test, value), F.when(test, when))
    reason = [F.min_by("reason", when).alias("reason")] if "reason" in log.columns else []
    assigned, closed = F.col("action") == "assigned", F.col("action").isin("approved", "rejected")
    return log.groupBy("record_id").agg(
        F.max("session_id").alias("session_id"),
        F.coalesce(last(status, status.isNotNull()), F.lit("pending")).alias("status"),
        last(F.col("reviewer"), assigned).alias("reviewer"),
        F.min("ts").alias("flagged_at"),
        last(F.col("ts"), assigned).alias("started"),
        last(F.col("ts"), closed).alias("completed"),
        F.count_if(F.col("action") == "updated").alias("corrections"),
        F.max_by("confidence", when).alias("confidence"),
        F.count("*").alias("events"),
        *reason,
    )


def latest(log: DataFrame) -> DataFrame:
    """The last event of each record (W4): a maximum, so that hot records combine before the shuffle."""
    last = F.max_by(F.struct(*[c for c in log.columns if c != "record_id"]), F.struct("ts", "event_id")).alias("last")
    return log.groupBy("record_id").agg(last).select("record_id", "last.*").select(*log.columns)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]


def session_summary(states: DataFrame) -> DataFrame:
    """For each session: records, each state's count (0 included), mean review hours, corrections and share approved."""
    hours = (_micros("completed") - _micros("started")) / 3_600_000_000
    return states.groupBy("session_id").agg(F.count("*").alias("total"), *_status_counts(), F.avg(hours).alias("review_hours"), F.sum("corrections").alias("corrections"), (F.count_if(F.col("status") == "approved") / F.count("*")).alias("completion"))


def statistics(states: DataFrame) -> DataFrame:
    """Records by state, only those that occur."""
    return states.groupBy("status").agg(F.count("*").alias("n"))


def status_histogram(states: DataFrame) -> DataFrame:
    """Records by state, with every state."""
    every = states.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(statistics(states), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def reviewer_report(states: DataFrame) -> DataFrame:
    """For each reviewer: assigned, completed, approved, rejected."""
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return states.filter("reviewer is not null").groupBy("reviewer").agg(F.count("*").alias("assigned"), of("approved", "rejected").alias("completed"), of("approved").alias("approved"), of("rejected").alias("rejected"))


def audit_report(states: DataFrame) -> DataFrame:
    """One row: flagged records, each state's count, the share that is approved or rejected, corrections and records that have any."""
    done = F.count_if(F.col("status").isin("approved", "rejected"))
    return states.agg(
        F.count("*").alias("total"), *_status_counts(), F.coalesce(F.try_divide(done, F.count("*")), F.lit(0.0)).alias("completion_rate"),
        F.coalesce(F.sum("corrections"), F.lit(0)).alias("total_corrections"), F.count_if(F.col("corrections") > 0).alias("records_with_corrections"),
    )


def top_reasons(states: DataFrame, k: int = 5) -> DataFrame:
    """The k most common reasons for a flag, ties by reason."""
    return states.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def corrected_fields(changes: DataFrame) -> DataFrame:
    """How often each field of the maps `before` and `after` was changed."""
    cells = changes.select("before", F.explode(F.map_entries("after")).alias("e")).filter(F.map_contains_key("before", F.col("e.key")))
    return cells.filter(~F.try_element_at("before", F.col("e.key")).eqNullSafe(F.col("e.value"))).groupBy(F.col("e.key").alias("field")).agg(F.count("*").alias("n"))


def sessions_flagged(sessions: DataFrame, states: DataFrame, newest: int = 50) -> DataFrame:
    """Of the newest sessions those with flagged records, and how many."""
    counts = states.groupBy("session_id").agg(F.count("*").alias("flagged"))
    return sessions.orderBy(F.desc("uploaded"), "session_id").limit(newest).join(counts, "session_id").select("session_id", "uploaded", "flagged")


def sessions_completed(sessions: DataFrame, states: DataFrame) -> DataFrame:
    """Sessions with a record that is approved or rejected."""
    return sessions.join(states.filter(F.col("status").isin("approved", "rejected")), "session_id", "left_semi")


def trail(states: DataFrame, log: DataFrame) -> DataFrame:
    """Each record's events beside its state (J3); in time order if sorted by record_id, ts, event_id."""
    return states.select("record_id", "status").join(log.select("record_id", "ts", "event_id", "action", "reviewer"), "record_id")


def review_list(states: DataFrame, status: str | None = None, session: str | None = None, reviewer: str | None = None, low: float = 0.0, high: float = 1.0, sort: str = "flagged_at", descending: bool = True, reason: str | None = None) -> DataFrame:
    """Records to review by state, session, reviewer, confidence range (both ends included) and reason, sorted."""
    out = states.filter(F.col("confidence").between(low, high))
    for name, value in (("status", status), ("session_id", session), ("reviewer", reviewer), ("reason", reason)):
        out = out if value is None else out.filter(F.col(name) == value)
    return out.orderBy(F.desc(sort) if descending else F.asc(sort), "record_id")


def recent(log: DataFrame, k: int = 10) -> DataFrame:
    """The k last events (O7): a top-k, not a sort of the log."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def performance(operations: DataFrame) -> DataFrame:
    """For each operation, and for all (operation `all`): how many, share of successes, mean, least and most seconds, mean and most MB."""
    out = operations.rollup("operation").agg(
        F.grouping("operation").alias("whole"), F.count("*").alias("total"), (F.count_if("success") / F.count("*")).alias("success_rate"), F.avg("seconds").alias("mean_seconds"), F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"), F.avg("memory_mb").alias("mean_mb"), F.max("memory_mb").alias("max_mb"),
    )
    return out.withColumn("operation", F.when(F.col("whole") == 1, "all").otherwise(F.col("operation"))).drop("whole").filter("total > 0")


def last_operations(operations: DataFrame, k: int = 10) -> DataFrame:
    """The k operations begun last."""
    return operations.orderBy(F.desc("began"), F.desc("operation_id")).limit(k)


def recent_each(log: DataFrame, k: int = 3) -> DataFrame:
    """The last k events of each record."""
    nth = F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return log.withColumn("nth", nth).filter(F.col("nth") <= k)


def ranked(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """rows with `rank`, the place from 0 among those of the key by order. No task sees more than a key's bucket, which must rise with the order.

    Rows are numbered within buckets, and the counts of the buckets before are added.
    """
    spread = rows.withColumn("bucket", bucket)
    counts = spread.groupBy(key, "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1
    return spread.withColumn("nth", nth).join(offsets, [key, "bucket"]).withColumn("rank", F.col("offset") + F.col("nth")).drop("bucket", "nth", "offset")


def sliding(log: DataFrame, rows: int = 100, block: int = 20_000) -> DataFrame:
    """Each event with the mean value of its reviewer's last `rows` events, itself included.

    A reviewer's events are dealt out in blocks, each with the last events of the block before, so a hot reviewer is many tasks.
    """
    placed = ranked(log.select("event_id", "reviewer", "ts", "confidence"), "reviewer", ["ts", "event_id"], F.date_trunc("day", "ts"))
    placed = placed.withColumn("block", F.expr(f"rank div {block}"))
    carried = placed.filter(F.expr(f"rank % {block}") > block - rows).withColumn("block", F.col("block") + 1)
    both = placed.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    w = Window.partitionBy("reviewer", "block").orderBy("rank").rowsBetween(1 - rows, 0)
    return both.withColumn("moving", F.avg("confidence").over(w)).filter("own").select("event_id", "reviewer", "moving")


def retained(rows: DataFrame, column: str, as_of: datetime, days: float) -> DataFrame:
    """Rows not older than that many days."""
    return rows.filter(F.col(column) >= F.lit(as_of - timedelta(days=days)).cast(rows.schema[column].dataType))


def export(records: DataFrame, states: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Records that are approved, or rejected if asked for, by a semi join on record_id."""
    wanted = ("approved", "rejected") if include_rejected else ("approved",)
    return records.join(states.filter(F.col("status").isin(*wanted)), "record_id", "left_semi")


def audited_export(scored: DataFrame, states: DataFrame, include_rejected: bool = False, metadata: bool = True, confidences: bool = True) -> DataFrame:
    """Reviewed records for export: the fields, their confidences and six columns of the review, as asked for."""
    wanted = ("approved", "rejected") if include_rejected else ("approved",)
    review = states.filter(F.col("status").isin(*wanted)).select(
        "record_id", F.col("reason").alias("audit_flag_reason"), F.col("status").alias("audit_review_status"), F.coalesce("reviewer", F.lit("")).alias("audit_reviewer"),
        F.col("completed").alias("audit_review_completed"), F.col("corrections").alias("audit_corrections_made"),
    )
    out = scored.join(review, "record_id")
    extra = [F.col(f"s_{f}").alias(f"{f}_confidence") for f in FIELDS] if confidences else []
    about = [F.col("record_id").alias("audit_record_id"), *[c for c in review.columns if c != "record_id"]] if metadata else []
    return out.select(*FIELDS, *extra, *about)


def orphans(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """Records whose session is gone."""
    return records.join(sessions, "session_id", "left_anti")


def database_stats(records: DataFrame, states: DataFrame) -> DataFrame:
    """Sessions, records, reviewed and flagged ones in one row."""
    a = records.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("records")).select(F.lit(1).alias("one"), "*")
    b = states.agg(F.count("*").alias("flagged"), F.count_if(F.col("status").isin("approved", "rejected")).alias("reviewed")).select(F.lit(1).alias("one"), "*")
    return a.join(b, "one").drop("one")


def session_counts(sessions: DataFrame) -> DataFrame:
    """Sessions by status."""
    return sessions.groupBy("status").agg(F.count("*").alias("sessions"), F.sum("n_records").alias("records"))


def indexed(records: DataFrame) -> DataFrame:
    """Each record with its place in its session, from 0 (W3). A hot session is numbered in ranges of record_id."""
    placed = ranked(records, "session_id", ["record_id"], F.expr("record_id div 100000"))
    return placed.withColumnRenamed("rank", "place")


def list_sessions(sessions: DataFrame, k: int = 100, status: str | None = None) -> DataFrame:
    """The k sessions uploaded last, of one status if given (O1, O2)."""
    found = sessions if status is None else sessions.filter(F.col("status") == status)
    return found.orderBy(F.desc("uploaded"), "session_id").limit(k)


def newest(rows: DataFrame, column: str, tie: str, k: int | None = None, oldest: bool = False) -> DataFrame:
    """Exports newest first, a session's jobs oldest first (O8); the first k if given, which is a top-k and no sort of all."""
    out = rows.orderBy(F.asc(column) if oldest else F.desc(column), tie)
    return out if k is None else out.limit(k)


def preview(scored: DataFrame, least: float, columns: list[str], k: int = 50) -> DataFrame:
    """The first k records whose confidence is at least that, with some columns."""
    return scored.filter(F.col("overall") >= least).orderBy("record_id").limit(k).select("record_id", *columns)


def hit_rate(log: DataFrame, hit: Column) -> DataFrame:
    """Requests, hits and their rate, 0 without requests."""
    return log.agg(F.count("*").alias("requests"), F.count_if(hit).alias("hits"), F.coalesce(F.try_divide(F.count_if(hit), F.count("*")), F.lit(0.0)).alias("rate"))


def efficiency(states: DataFrame, log: DataFrame) -> DataFrame:
    """One row, from the log and nothing made up (H13): reviewed records an hour of review, corrections a record, the share of approved records without corrections, and the mean rise of confidence from a record's first to its last event."""
    hours = (_micros("completed") - _micros("started")) / 3_600_000_000
    done = F.col("status").isin("approved", "rejected") & (hours > 0)
    at = F.struct("ts", "event_id")
    rise = log.groupBy("record_id").agg((F.max_by("confidence", at) - F.min_by("confidence", at)).alias("rise"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return states.join(rise, "record_id", "left").agg(
        zero(F.try_divide(F.count_if(done), F.sum(F.when(done, hours)))).alias("records_per_hour"), zero(F.try_divide(F.sum("corrections"), F.count("*"))).alias("corrections_per_record"),
        zero(F.try_divide(F.count_if((F.col("status") == "approved") & (F.col("corrections") == 0)), F.count_if(F.col("status") == "approved"))).alias("first_pass_rate"), zero(F.avg("rise")).alias("confidence_rise"),
    )


def service_health(checks: DataFrame, fallbacks: dict[str, str]) -> DataFrame:
    """name, status, last_check and `use` of each service, by its last check (name, ts, healthy; null: the check itself failed) (H3).

    use: the service itself if healthy, else its fallback, else null, which is an error to its caller.
    """
    last = checks.groupBy("name").agg(F.max("ts").alias("last_check"), F.max_by(F.struct("healthy"), F.struct("ts", F.coalesce(F.col("healthy").cast("int"), F.lit(-1)))).alias("last"))
    status = F.when(F.col("last.healthy"), "healthy").when(~F.col("last.healthy"), "unhealthy").otherwise("error")
    other = F.create_map(*[F.lit(x) for p in fallbacks.items() for x in p]) if fallbacks else F.lit(None).cast("map<string,string>")
    return last.select("name", status.alias("status"), "last_check", F.when(status == "healthy", F.col("name")).otherwise(F.try_element_at(other, F.col("name"))).alias("use"))


def system_status(services: DataFrame) -> DataFrame:
    """One row of services (name, status): the whole's health, how many there are and how many are healthy (H3)."""
    n, good = F.count("*"), F.count_if(F.col("status") == "healthy")
    return services.agg(F.when(good == n, "healthy").when(good > 0, "degraded").otherwise("critical").alias("overall_health"), n.alias("total_services"), good.alias("healthy_services"))
