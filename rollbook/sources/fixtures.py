"""Views that turn the star-schema tables into licence records, lines, documents, a review log and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One text for both engines: only functions that agree in them.
RECORDS_SQL = """
select k as record_id, concat('S', cast(k % 7 as string)) as session_id,
  case when k % 23 = 0 then '' when k % 29 = 0 then 'AB' when k % 5 = 0 then concat('Town ', cast(nk as string)) else concat(n_name, ' Borough Council') end as council,
  case when k % 31 = 0 then '' when k % 37 = 0 then '#!' when k % 3 = 0 then concat(cast(year(d) as string), '/', cast(k as string)) else concat('HMO', cast(k as string)) end as reference,
  case when k % 41 = 0 then 'Short' when k % 43 = 0 then concat(cast(1 + k % 199 as string), ' High Street, Town') else concat(cast(1 + k % 199 as string), ' High Street, Town, AB', cast(1 + nk % 9 as string), ' 2CD') end as hmo_address,
  case when k % 17 = 0 then 'not a date' when k % 2 = 0 then cast(d as string) else concat(lpad(cast(day(d) as string), 2, '0'), '/', lpad(cast(month(d) as string), 2, '0'), '/', cast(year(d) as string)) end as licence_start,
  case when k % 19 = 0 then '' when k % 47 = 0 then cast(d - 30 as string) else cast(d + cast(365 * (1 + k % 12) as int) as string) end as licence_expiry,
  cast(k % 61 as int) as max_occupancy,
  case when k % 11 = 0 then '' when k % 13 = 0 then 'Single' when k % 2 = 0 then 'Alex Smith' else 'Jo O''Connor' end as hmo_manager_name,
  case when k % 7 = 0 then '' else concat(cast(1 + k % 50 as string), ' Mill Lane, Town') end as hmo_manager_address,
  case when k % 8 = 0 then c_name else 'Sam Patel' end as licence_holder_name,
  case when k % 9 = 0 then 'Short' else concat(cast(1 + k % 80 as string), ' Oak Road, Town, CD1 3EF') end as licence_holder_address,
  cast(case when k % 53 = 0 then -1 else k % 9 end as int) as number_of_households,
  cast(k % 4 as int) as number_of_shared_kitchens, cast(k % 5 as int) as number_of_shared_bathrooms,
  cast(k % 6 as int) as number_of_shared_toilets, cast(k % 13 as int) as number_of_storeys
from (select o_orderkey as k, cast(o_orderdate as date) as d, n_name, cast(n_nationkey as bigint) as nk, c_name
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) o
"""

#: The review log: an event each for a record, with what the reviewer did.
LOG_SQL = """
select event_id, event_id % 997 as record_id, concat('S', cast((event_id % 997) % 7 as string)) as session_id,
  concat('rev', cast(user_id % 5 as string)) as reviewer, ts,
  case event_type when 'view' then 'assigned' when 'click' then 'updated' when 'purchase' then 'approved' when 'error' then 'rejected' else 'commented' end as action,
  value as confidence, concat('reason ', cast((event_id % 997) % 11 % 7 as string)) as reason
from events
"""


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a scan of fewer splits than cores, which is small by that, is dealt out; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def licence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each order. The joins' small sides are broadcast by Spark where their size allows."""
    tables = {t: _view(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    tables["orders"] = spread(tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate"))
    return spark.sql(RECORDS_SQL.replace("from orders join customer", "from {orders} join {customer}").replace("join nation on", "join {nation} on"), **tables)


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG_SQL.replace("from events", "from {events}"), events=_view(spark, sf_dir, "events"))


def licence_lines(records: DataFrame) -> DataFrame:
    """session_id (here one document for each five records), pos and line: six lines for each record."""
    line = F.array(
        F.col("council"),
        F.concat(F.lit("Reference: "), "reference"),
        F.concat(F.lit("Property Address: "), "hmo_address"),
        F.concat(F.lit("HMO Manager: "), "hmo_manager_name"),
        F.concat(F.lit("Maximum Occupancy: "), F.col("max_occupancy").cast("string"), F.lit(" persons")),
        F.lit(""),
    )
    exploded = records.select(F.expr("record_id div 5").alias("doc"), "record_id", F.posexplode(line).alias("i", "line"))
    return exploded.select("doc", (F.col("record_id") % 5 * 6 + F.col("i")).cast("int").alias("pos"), "line")


LINES_SQL = """
select record_id // 5 as doc, cast(record_id % 5 * 6 + i as int) as pos,
  case i when 0 then council when 1 then concat('Reference: ', reference) when 2 then concat('Property Address: ', hmo_address)
    when 3 then concat('HMO Manager: ', hmo_manager_name) when 4 then concat('Maximum Occupancy: ', cast(max_occupancy as string), ' persons') else '' end as line
from rec, (select unnest(range(6)) as i)
"""


def licence_documents(records: DataFrame) -> DataFrame:
    """doc and text: the lines of a document joined by line feeds. Thirty lines at most make a document."""
    lines = licence_lines(records)
    return lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("doc", F.array_join("l.line", "\n").alias("text"))
