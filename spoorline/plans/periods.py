"""Queries over periods, usage by day, and events of further producers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frames import cut, shared_dir
from ..functions import ids
from ..operators import analytics, extract, ranges
from ..sources.tables import OrderTables
from ..streaming.ingest import parsed, valid_events
from .queries import NOW, _date, _long
from .registry import QUERIES, SQL, query


@query(
    "period_overlaps",
    """WITH a AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 60 + 1 AS INTEGER)) AS e FROM orders),
       b AS (SELECT o_custkey, l_orderkey, l_linenumber, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
       SELECT o_custkey, o_orderkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM a JOIN b USING (o_custkey) WHERE a.s < b.e AND b.s < a.e""",
    mapped=False,
)
def period_overlaps(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    days = lambda c: F.make_dt_interval(c.cast("int"))
    o = t.source("orders")
    a = o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("since"), (F.col("o_orderdate") + days(F.col("o_orderkey") % 60 + 1)).alias("until"))
    items = t.source("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    b = items.select("o_custkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("since"), (F.col("l_shipdate") + days(F.col("l_quantity"))).alias("until"))
    met = ranges.overlaps(a, b, ["o_custkey"])
    return met.select("o_custkey", F.col("a_o_orderkey").alias("o_orderkey"), F.col("b_l_orderkey").alias("l_orderkey"), F.col("b_l_linenumber").cast("long").alias("l_linenumber"))


def _usage_by_day(depth):
    def run(spark, sf_dir):
        t = OrderTables(spark, sf_dir)
        path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
        analytics.refresh_days(t.output, t.run, path, tasks=t.tasks)
        return _date(analytics.usage_of_days(spark.read.parquet(path), t.output, t.run, t.user, t.dataset, t.location, depth, NOW))

    return run


for _d in ("daily", "weekly", "monthly"):
    QUERIES[f"usage_{_d}_by_day"], SQL[f"usage_{_d}_by_day"] = _usage_by_day(_d), SQL[f"usage_{_d}"]


def _producer_events(spark, sf_dir):
    """One event for each order, of a scheduler's task, a query of a warehouse, a streaming job or a model, by turns."""
    o = OrderTables(spark, sf_dir).source("orders")
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    at = F.col("o_orderdate").cast("timestamp")
    turn = lambda n, c: F.when(k % 4 == n, c)
    kind = lambda name, of, how: F.struct(F.lit(name).alias("integration"), F.lit(of).alias("jobType"), F.lit(how).alias("processingType"))
    by_turn = lambda *cs: F.coalesce(*(turn(n, c) for n, c in enumerate(cs)))
    types = by_turn(kind("AIRFLOW", "TASK", "BATCH"), kind("HIVE", "QUERY", "BATCH"), kind("FLINK", "JOB", "STREAMING"), kind("DBT", "MODEL", "BATCH"))
    job = F.struct(
        by_turn(F.lit("http://air:8081"), F.lit("hive://hs:10000"), F.lit("http://flink:8081"), F.lit("dbt://host")).alias("namespace"),
        by_turn(F.concat(F.lit("dag.t"), text), F.concat(F.lit("query.q"), text), F.concat(F.lit("job"), text), F.concat(F.lit("schema.model"), text)).alias("name"),
        F.struct(types.alias("jobType")).alias("facets"),
    )
    parent = F.struct(F.struct(by_turn(F.lit("http://air:8081"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("dbt://host")).alias("namespace"), F.lit("top").alias("name")).alias("job"), F.struct(ids.incremental_uuid(at, F.lit("top")).alias("runId")).alias("run"))
    task = F.struct(F.struct(F.lit("dag").alias("dag_id")).alias("dag"), F.struct(F.lit("manual__1").alias("run_id"), F.lit("manual").alias("run_type")).alias("dagRun"), F.struct(F.concat(F.lit("t"), text).alias("task_id"), F.lit("PythonOperator").alias("operator_class")).alias("task"), F.struct((k % 5 + 1).cast("int").alias("map_index"), F.lit(1).alias("try_number")).alias("taskInstance"))
    session = F.struct(F.lit("me").alias("username"), F.lit("1.2.3.4").alias("clientIp"), F.concat(F.lit("s"), text).alias("sessionId"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationTime"))
    facets = F.struct(
        F.when(k % 4 != 1, F.when(k % 4 != 2, parent)).alias("parent"), turn(0, task).alias("airflow"), turn(1, F.struct(F.concat(F.lit("q"), text).alias("queryId"), F.lit("QUERY").alias("operationName"))).alias("hive_query"),
        turn(1, session).alias("hive_session"), turn(2, F.struct(F.concat(F.lit("f"), text).alias("jobId"))).alias("flink_job"),
    )
    ended = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "P", "FAIL").otherwise("RUNNING")
    event = F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), ended.alias("eventType"), job.alias("job"), F.struct(ids.incremental_uuid(at, text).alias("runId"), facets.alias("facets")).alias("run"))
    value = F.concat(F.regexp_replace(F.to_json(event), r"\}$", ""), F.lit(', "inputs": [], "outputs": []}'))
    texts = cut(o.select(value.alias("value")))
    return extract.classified(valid_events(cut(texts.select(parsed().alias("event")))))


@query(
    "ingest_producers",
    """SELECT CASE o_orderkey % 4 WHEN 0 THEN 't' WHEN 1 THEN 'q' WHEN 2 THEN 'job' ELSE 'schema.model' END || o_orderkey AS name, CASE o_orderkey % 4 WHEN 2 THEN 'STREAMING' ELSE 'BATCH' END AS type,
       CASE WHEN o_orderkey % 4 = 3 THEN 'MODEL' END AS group_name, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5 + 1 AS BIGINT) END AS position,
       CASE o_orderkey % 4 WHEN 0 THEN 'PythonOperator' WHEN 1 THEN 'QUERY' END AS description, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS BIGINT) AS status FROM orders""",
    mapped=False,
)
def ingest_producers(spark, sf_dir):
    ops = extract.merged_operations(_producer_events(spark, sf_dir))
    return ops.select("name", "type", F.col("group").alias("group_name"), F.col("position").cast("long").alias("position"), "description", F.col("status").cast("long").alias("status"))


@query(
    "ingest_producer_runs",
    """SELECT external_id, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'manual__1' WHEN 1 THEN 's' || o_orderkey WHEN 2 THEN 'f' || o_orderkey END AS external_id FROM orders WHERE o_orderkey % 4 <> 3) GROUP BY 1""",
    mapped=False,
)
def ingest_producer_runs(spark, sf_dir):
    runs = extract.merged_runs(_producer_events(spark, sf_dir)).where("external_id is not null")
    return runs.groupBy("external_id").agg(F.count("*").alias("n"))
