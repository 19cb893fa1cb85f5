"""Quality analytics over scored and validated records.

Field statistics unpivot narrow tuples once and aggregate once, with partial aggregation, whatever the number of fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.common import blank, fixed, messages, when_first
from rollbook.functions.confidence import THRESHOLDS, factors, field_type, is_low, weighed
from rollbook.functions.mapping import Mapping, export_checks, export_summary, record_errors
from rollbook.operators.ranks import order_statistics
from rollbook.schema import CRITICAL, FIELDS, IMPORTANT, TEXT_FIELDS, field_class


def populated(field: str) -> Column:
    """Text that isn't blank, numbers that aren't 0."""
    return ~blank(F.col(field)) if field in TEXT_FIELDS else F.col(field).isNotNull() & (F.col(field) != 0)


def unpivoted(scored: DataFrame, *keys: str) -> DataFrame:
    """keys, field, filled and score: a narrow row for each record and field."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), populated(f).alias("filled"), F.col(f"s_{f}").alias("score")) for f in FIELDS])
    return scored.select(*keys, F.inline(cells))


def field_quality(average: Column, rate: Column, errors: Column, field: Column) -> Column:
    """A field's level: stricter for critical and important fields, lower where there are errors (A2). The bounds are fixed values."""

    def levels(bounds: tuple) -> Column:
        (ce, cg, ca), (pe, pg, pa) = bounds
        good, fair = (average >= cg) & (rate >= pg), (average >= ca) & (rate >= pa)
        return F.when(errors > 0, when_first((good, "acceptable"), (fair, "poor"), other="critical")).otherwise(
            when_first(((average >= ce) & (rate >= pe), "excellent"), (good, "good"), (fair, "acceptable"), ((average >= 0.5) & (rate >= 0.3), "poor"), other="critical")
        )

    return (
        F.when(field.isin(*CRITICAL), levels(((0.9, 0.8, 0.7), (0.95, 0.85, 0.70))))
        .when(field.isin(*IMPORTANT), levels(((0.85, 0.75, 0.65), (0.90, 0.80, 0.65))))
        .otherwise(levels(((0.80, 0.70, 0.60), (0.85, 0.70, 0.50))))
    )


def quality_level(average: Column, valid_rate: Column) -> Column:
    """A session's level (A3)."""
    return when_first(*[((average >= c) & (valid_rate >= v), name) for c, v, name in ((0.9, 0.95, "excellent"), (0.8, 0.85, "good"), (0.7, 0.70, "acceptable"), (0.5, 0.50, "poor"))], other="critical")


def mentions(messages: str, field: str) -> Column:
    """How many of the messages name the field with spaces for underscores: the attribution is by text."""
    return F.size(F.filter(messages, lambda m: F.lower(m).contains(field.replace("_", " "))))


def field_metrics(checked: DataFrame) -> DataFrame:
    """For each field: rows, filled, confidence, error and warning counts and level (A1, A2)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), populated(f).alias("filled"), F.col(f"s_{f}").alias("score"), mentions("v_errors", f).alias("e"), mentions("v_warnings", f).alias("w")) for f in FIELDS])
    out = checked.select(F.inline(cells)).groupBy("field").agg(
        F.count("*").alias("total"), F.count_if("filled").alias("populated"), F.avg("score").alias("avg_confidence"), F.min("score").alias("min_confidence"),
        F.max("score").alias("max_confidence"), F.sum("e").alias("n_errors"), F.sum("w").alias("n_warnings"),
    )
    return out.withColumn("level", field_quality(F.col("avg_confidence"), F.col("populated") / F.col("total"), F.col("n_errors"), F.col("field")))


def flag_reasons(confidence: float = 0.7, critical: float = 0.5) -> Column:
    """Why a checked record should be reviewed, joined by `; `; empty if it needn't be (A5)."""
    two = lambda c: fixed(c, 2)
    reasons = [F.when(F.col("v_score") < confidence, F.concat(F.lit("Low overall confidence ("), two(F.col("v_score")), F.lit(")"))), F.when(F.size("v_errors") > 0, F.concat(F.lit("Validation errors ("), F.size("v_errors"), F.lit(")")))]
    reasons += [F.when(F.col(f"s_{f}") < critical, F.concat(F.lit(f"Critical field '{f}' low confidence ("), two(F.col(f"s_{f}")), F.lit(")"))) for f in CRITICAL]
    reasons += [F.when(blank(F.col(f)), f"Critical field '{f}' is empty") for f in CRITICAL]
    return F.concat_ws("; ", *reasons)


def session_quality(checked: DataFrame) -> DataFrame:
    """For each session: records, valid and flagged ones, mean confidence and level (A4)."""
    out = checked.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if("v_valid").alias("valid"), F.count_if(flag_reasons() != "").alias("flagged"), F.avg("v_score").alias("confidence"))
    return out.withColumn("level", quality_level(F.col("confidence"), F.col("valid") / F.col("total")))


def field_statistics(scored: DataFrame) -> DataFrame:
    """For each field: filled, rate, mean, least, most and sample deviation of confidence."""
    return unpivoted(scored).groupBy("field").agg(
        F.count_if("filled").alias("populated"), (F.count_if("filled") / F.count("*")).alias("rate"), F.avg("score").alias("avg_confidence"), F.min("score").alias("min_confidence"),
        F.max("score").alias("max_confidence"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("std_confidence"),
    )


def quartiles(scored: DataFrame, value: str = "overall") -> DataFrame:
    """n, q1, q2, q3: order statistics n div 4 and 3n div 4 (least and most below 4 values) and the median (A7, W5); nulls without any value. Selected over ranges of values: no task orders all rows."""
    n = scored.select(F.count(value)).first()[0]
    schema = "n long, q1 double, q2 double, q3 double"
    if not n:
        return scored.sparkSession.createDataFrame([(None, None, None, None)], schema)
    q1, q3 = (n // 4, 3 * n // 4) if n >= 4 else (0, n - 1)
    at = order_statistics(scored, value, [q1, (n - 1) // 2, n // 2, q3])
    return scored.sparkSession.createDataFrame([(n, at[q1], (at[(n - 1) // 2] + at[n // 2]) / 2, at[q3])], schema)


def distribution(scored: DataFrame) -> DataFrame:
    """Mean, sample deviation, least, most, median and quartiles of the overall confidence."""
    one = F.lit(1).alias("one")
    plain = scored.agg(F.avg("overall").alias("mean"), F.coalesce(F.stddev_samp("overall"), F.lit(0.0)).alias("std"), F.min("overall").alias("min"), F.max("overall").alias("max")).select(one, "*")
    order = quartiles(scored).select(one, F.col("q2").alias("median"), "q1", "q3")
    return plain.join(order, "one").drop("one")


def completeness(records: DataFrame) -> DataFrame:
    """Mean share of filled values for each class of fields."""
    rates = [(field_class(f), F.avg(populated(f).cast("int")).alias(f)) for f in FIELDS]
    wide = records.agg(*[r for _, r in rates])
    return wide.select(*[(sum((F.col(f) for f in FIELDS if field_class(f) == k), F.lit(0.0)) / sum(field_class(f) == k for f in FIELDS)).alias(f"{k}_avg") for k in ("critical", "important", "optional")])


def record_completeness(records: DataFrame) -> DataFrame:
    """Mean, least, most and sample deviation of the records' shares of filled fields."""
    share = sum((populated(f).cast("int") for f in FIELDS), F.lit(0)) / len(FIELDS)
    one = records.select(share.alias("x"))
    return one.agg(F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))


def message_counts(checked: DataFrame, column: str = "v_errors") -> DataFrame:
    """message and n, most frequent first, ties by message."""
    return checked.select(F.explode(column).alias("message")).groupBy("message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message")


def top_messages(checked: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent errors and warnings."""
    parts = [message_counts(checked, c).limit(k).select(F.lit(kind).alias("kind"), "message", "n") for kind, c in (("error", "v_errors"), ("warning", "v_warnings"))]
    return parts[0].unionByName(parts[1])


def validation_summary(checked: DataFrame) -> DataFrame:
    """Records, valid and invalid ones, their rate and the mean score."""
    return checked.agg(F.count("*").alias("total"), F.count_if("v_valid").alias("valid"), F.count_if(~F.col("v_valid")).alias("invalid"), F.try_divide(F.count_if("v_valid"), F.count("*")).alias("rate"), F.avg("v_score").alias("confidence"))


def session_metrics(scored: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """For each session: records, confident and flagged ones, mean score, percent filled of each field, and seconds from started to finished of times (session_id, started, finished), 0 where one is missing."""
    rates = [(100.0 * F.count_if(populated(f)) / F.count("*")).alias(f"pct_{f}") for f in FIELDS]
    out = scored.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(F.col("overall") >= 0.7).alias("confident"), F.count_if("flagged").alias("flagged"), F.avg("overall").alias("average"), *rates)
    if times is None:
        return out
    seconds = (F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1_000_000
    return out.join(times.select("session_id", seconds.alias("seconds")), "session_id", "left").withColumn("processing_seconds", F.coalesce("seconds", F.lit(0.0))).drop("seconds")


def ensemble(results: DataFrame, *keys: str) -> DataFrame:
    """Results (keys, value, confidence) of several methods made one: the value of the highest, the self-weighted mean with a bonus for agreement."""
    n, distinct, total = F.count("*"), F.countDistinct("value"), F.sum("confidence")
    out = results.groupBy(*keys).agg(n.alias("n"), distinct.alias("d"), total.alias("t"), F.sum(F.col("confidence") * F.col("confidence")).alias("q"), F.max(F.struct("confidence", "value")).alias("best"))
    bonus = when_first((F.col("d") == 1, 0.1), (F.col("d") * 2 <= F.col("n"), 0.05), other=-0.05)
    mean = F.coalesce(F.try_divide("q", "t"), F.col("best.confidence"))
    return out.select(*keys, F.col("best.value").alias("value"), F.when(F.col("n") == 1, F.col("t")).otherwise(F.least(mean + bonus, F.lit(1.0))).alias("confidence"), "n")


def confidence_report(scored: DataFrame) -> DataFrame:
    """For each field over all records: mean, least, most and sample deviation; for fields with a low mean, the advice."""
    out = field_statistics(scored).select("field", "avg_confidence", "min_confidence", "max_confidence", "std_confidence")
    return out.withColumn("advice", F.when(F.col("avg_confidence") < 0.7, "Overall confidence is low. Consider using additional extraction methods."))


def document_report(scored: DataFrame) -> DataFrame:
    """For each record, over its fields' confidences: n, mean, median, least, most, sample deviation, the fields below their thresholds and the advice.

    A record's fields are columns of its row, so nothing is shuffled.
    """
    scores = F.array_sort(F.array(*[F.col(f"s_{f}") for f in FIELDS]))
    low = messages(*[F.when(is_low(f, F.col(f"s_{f}")), f) for f in FIELDS])
    bound = scored.select("record_id", scores.alias("s"), low.alias("flagged_fields")).select("*", (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / len(FIELDS)).alias("mean"))
    spread = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / (len(FIELDS) - 1))
    n = F.size("flagged_fields")
    # The advice.
    review = when_first((n == 0, "All fields meet confidence thresholds. No manual review required."), (n * 2 > len(FIELDS), "More than 50% of fields flagged. Consider reviewing source document quality."))
    advice = messages(F.coalesce(review, F.concat(n.cast("string"), F.lit(" fields flagged for manual review."))), F.when(F.round("mean", 12) < 0.7, "Overall confidence is low. Consider using additional extraction methods."))  # rounded: the order of adding must not decide
    middle = len(FIELDS) // 2
    median = F.get("s", F.lit(middle)) if len(FIELDS) % 2 else (F.get("s", F.lit(middle - 1)) + F.get("s", F.lit(middle))) / 2
    return bound.select("record_id", F.lit(len(FIELDS)).alias("n"), "mean", median.alias("median"), F.array_min("s").alias("least"), F.array_max("s").alias("most"), spread.alias("std"), "flagged_fields", advice.alias("advice"))


def field_analysis(records: DataFrame, contexts: dict[str, str], method: str = "regex_pattern") -> DataFrame:
    """For each record and field of contexts: confidence, the field's threshold, whether it is reached, the method and the six factors (A17's field_analysis)."""
    rows = []
    for f, context in contexts.items():
        parts = factors(f, F.col(f).cast("string"), F.lit(context), F.lit(method))
        bound = THRESHOLDS[field_type(f)]
        score = weighed(parts)
        rows.append(F.struct(F.lit(f).alias("field"), score.alias("confidence_score"), F.lit(bound).alias("threshold"), (score >= bound).alias("above_threshold"), F.lit(method).alias("extraction_method"), *[c.cast("double").alias(f"{k}_factor") for k, c in parts.items()]))
    return records.select("record_id", F.inline(F.array(*rows)))


def edit_summary(edits: DataFrame) -> DataFrame:
    """For each record of edits (scored, with the values before as was_<field>): changed fields, mean confidence and fields by status."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    changed = sum((F.when(text(f) != text(f"was_{f}"), 1).otherwise(0) for f in FIELDS), F.lit(0))
    mean = sum((F.col(f"s_{f}") for f in FIELDS), F.lit(0.0)) / len(FIELDS)
    status = {f: four_way(F.col(f"s_{f}")) for f in FIELDS}
    counts = [sum((F.when(status[f] == s, 1).otherwise(0) for f in FIELDS), F.lit(0)).alias(f"n_{s}") for s in ("excellent", "good", "warning", "error")]
    return edits.select("record_id", changed.alias("changed"), mean.alias("average"), *counts)


def recommendations(checked: DataFrame) -> DataFrame:
    """Advice from the field metrics and the most frequent error (A10). The texts and bounds are fixed values."""
    m = field_metrics(checked)
    rate = F.col("populated") / F.col("total")
    poor = F.col("level").isin("poor", "critical")
    each = m.filter(F.col("field").isin(*CRITICAL) & (poor | (rate < 0.8))).select(
        F.when(poor, F.concat(F.lit("Critical field '"), "field", F.lit("' has "), "level", F.lit(" quality. Consider improving extraction methods or manual review.")))
        .otherwise(F.concat(F.lit("Critical field '"), "field", F.lit("' is only populated in "), fixed(rate * 100, 1), F.lit("% of records. Review document parsing for this field.")))
        .alias("advice")
    )
    common = message_counts(checked).limit(1).select(F.concat(F.lit("Most common error: '"), "message", F.lit("' ("), F.col("n"), F.lit(" occurrences). Focus on resolving this issue first.")).alias("advice"))
    low = m.agg(F.count_if(F.col("avg_confidence") < 0.6).alias("k"), F.avg(F.when(F.col("field").isin(*CRITICAL), rate)).alias("c"))
    many = low.filter("k > 5").select(F.concat(F.col("k"), F.lit(" fields have low confidence scores. Consider retraining extraction models or improving validation rules.")).alias("advice"))
    empty = low.filter("c < 0.7").select(F.lit("Low completeness in critical fields. Consider improving document preprocessing or using alternative extraction methods.").alias("advice"))
    return each.unionByName(common).unionByName(empty).unionByName(many)


def buckets(scored: DataFrame) -> DataFrame:
    """Records by their unweighted mean score: high, medium, low, with shares."""
    mean = sum((F.col(f"s_{f}") for f in FIELDS), F.lit(0.0)) / len(FIELDS)
    bucket = when_first((mean >= 0.8, "high"), (mean >= 0.6, "medium"), other="low")
    out = scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def data_statistics(records: DataFrame) -> DataFrame:
    """For each field the share of values that aren't null or empty text, and how many distinct ones there are.

    Values are reduced to one row for each field and value before they are counted, so nothing is gathered in one task.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in FIELDS])
    values = records.select(F.inline(cells)).groupBy("field", "v").agg(F.count("*").alias("c"))
    return values.groupBy("field").agg((F.sum(F.when(F.col("v").isNotNull() & (F.col("v") != ""), F.col("c")).otherwise(0)) / F.sum("c")).alias("completion"), F.count("v").alias("n_unique"))


def four_way(score: Column) -> Column:
    """The editor's status of a score."""
    return when_first((score >= 0.8, "excellent"), (score >= 0.6, "good"), (score >= 0.4, "warning"), other="error")


def report_json(checked: DataFrame, k: int = 5) -> DataFrame:
    """part and body: the totals, a row for each field and the k most frequent errors and warnings as JSON text, doubles with six places.

    A record's totals, fields and messages are rows of one aggregation, so the rules run once; what is ranked and written are its groups.
    """

    def cell(part: str, key: Column, filled: Column, score: Column, e: Column = F.lit(0), w: Column = F.lit(0)) -> Column:
        return F.struct(F.lit(part).alias("part"), key.cast("string").alias("key"), F.lit(1).alias("c"), filled.cast("boolean").alias("filled"), score.cast("double").alias("score"), e.cast("int").alias("e"), w.cast("int").alias("w"))

    none = F.lit(None)
    said = [F.transform("v_errors", lambda m: cell("error", m, none, none)), F.transform("v_warnings", lambda m: cell("warning", m, none, none))]
    own = F.array(cell("totals", none, F.col("v_valid"), F.col("v_score")), *[cell("field", F.lit(f), populated(f), F.col(f"s_{f}"), mentions("v_errors", f), mentions("v_warnings", f)) for f in FIELDS])
    # totals stand without records too
    rows = checked.select(F.inline(F.concat(own, *said))).unionByName(checked.sparkSession.range(1).select(F.inline(F.array(cell("totals", none, none, none)))).withColumn("c", F.lit(0)))
    groups = rows.groupBy("part", "key").agg(
        F.sum("c").alias("n"), F.count_if("filled").alias("yes"), F.count_if(~F.col("filled")).alias("no"), F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"), F.sum("e").alias("e"), F.sum("w").alias("w"),
    )
    r6 = lambda c: F.round(c, 6)
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "key"))
    level = field_quality(F.col("mean"), F.col("yes") / F.col("n"), F.col("e"), F.col("key"))
    totals = F.struct(F.col("n").alias("total"), F.col("yes").alias("valid"), F.col("no").alias("invalid"), r6(F.try_divide("yes", "n")).alias("rate"), r6("mean").alias("confidence"))
    field = F.struct(F.col("key").alias("field"), F.col("n").alias("total"), F.col("yes").alias("populated"), r6("mean").alias("avg_confidence"), r6("low").alias("min_confidence"), r6("high").alias("max_confidence"), F.col("e").alias("n_errors"), F.col("w").alias("n_warnings"), level.alias("level"))
    message = F.struct(F.col("part").alias("kind"), F.col("key").alias("message"), "n")
    kept = groups.withColumn("place", place).filter((F.col("place") <= k) | F.col("part").isin("totals", "field"))
    body = F.when(F.col("part") == "totals", F.to_json(totals)).when(F.col("part") == "field", F.to_json(field)).otherwise(F.to_json(message))
    return kept.select(F.when(F.col("part").isin("totals", "field"), F.col("part")).otherwise("message").alias("part"), body.alias("body"))


def report_summary(checked: DataFrame, k: int = 5) -> DataFrame:
    """pos and line of the report's short form (A11): totals, then the k most frequent errors."""
    head = validation_summary(checked).select(F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), c.alias("line")) for i, c in enumerate((
        F.concat(F.lit("Records: "), "total"), F.concat(F.lit("Valid: "), "valid", F.lit(" ("), fixed(F.coalesce("rate", F.lit(0.0)) * 100, 1), F.lit("%)")),
        F.concat(F.lit("Confidence: "), fixed(F.coalesce("confidence", F.lit(0.0)), 2)),
    ))])))
    top = message_counts(checked).limit(k).select((F.row_number().over(Window.orderBy(F.desc("n"), "message")) + 2).alias("pos"), F.concat("message", F.lit(": "), "n").alias("line"))
    return head.unionByName(top)


def report_lines(records: DataFrame, mappings: list[Mapping], first: int = 20) -> DataFrame:
    """pos and line of the text report on an export (A15): totals, the first errors by record_id and how many more there are, percents by field.

    Without records all percents are 0. The fixed texts are the report's format. The lines are a few more than `first` and the fields, whatever the records.
    """
    row = lambda pos, line: F.struct(pos.cast("int").alias("pos"), line.alias("line"))
    total = export_summary(records, mappings)
    line = lambda label, c: F.concat(F.lit(label), F.col(c).cast("string"))
    head = [F.lit("CSV Export Validation Report"), F.lit("=" * 30), line("Total Records: ", "total"), line("Valid Records: ", "valid"), line("Invalid Records: ", "invalid"), F.lit("")]
    some = F.col("errors") > 0
    more = F.when(F.col("errors") > first, F.concat(F.lit("  ... and "), (F.col("errors") - first).cast("string"), F.lit(" more errors")))
    rows = [(F.lit(i), x) for i, x in enumerate(head)] + [(F.lit(10), F.when(some, "Validation Errors:")), (F.lit(11), F.when(some, "-" * 18)), (F.lit(90), more), (F.lit(91), F.when(some, ""))]
    rows += [(F.lit(95), F.lit("Field Statistics:")), (F.lit(96), F.lit("-" * 17))]
    framed = total.select(F.inline(F.array(*[row(*x) for x in rows])))
    names = [m.source for m in mappings]
    named = record_errors(records, mappings).withColumn("at", F.array_position(F.array(*map(F.lit, names)), F.col("field"))).orderBy("record_id", "at").limit(first)
    nth = F.row_number().over(Window.orderBy("record_id", "at"))
    listed = named.select(row(nth + 11, F.concat(F.lit("  \u2022 Record "), F.col("record_id").cast("string"), F.lit(": "), "error")).alias("r")).select("r.*")
    share = lambda c: F.coalesce(F.try_divide(F.lit(100.0) * F.col(c), F.col("n")), F.lit(0.0))
    label = F.element_at(F.create_map(*[F.lit(x) for m in mappings for x in (m.source, m.name)]), F.col("field"))
    at = F.array_position(F.array(*map(F.lit, names)), F.col("field"))
    fields = export_checks(records, mappings).select(row(at + 100, F.format_string("  %s: %s%% empty, %s%% errors", label, fixed(share("n_empty"), 1), fixed(share("n_errors"), 1))).alias("r")).select("r.*")
    return framed.unionByName(listed).unionByName(fields).filter("line is not null")
