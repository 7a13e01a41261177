"""One query for each operator over the mapped order tables, with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..frames import cut, first_per
from ..functions import flags, ids, text
from ..operators import analytics, columns, extract, io_stats, lineage, listing, merge
from ..sources import partitions
from ..sources.tables import OrderTables
from ..streaming.ingest import parse_events, parsed, valid_events
from .registry import QUERIES, SQL, query

DAY = dt.datetime
SINCE, UNTIL = DAY(1997, 3, 1), DAY(1997, 3, 20)
PERIOD = "TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-20'"
NOW = DAY(2001, 11, 4)


def _date(df, column="last_interaction_at", name="last_at"):
    return df.withColumn(name, F.to_date(column)).drop(column) if column == name or column in df.columns else df


def _long(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


# reads and writes

_ROLLED = "CAST(sum(num_bytes) AS BIGINT) AS num_bytes, CAST(sum(num_rows) AS BIGINT) AS num_rows, CAST(sum(num_files) AS BIGINT) AS num_files, min(oldest) AS oldest_schema_id, max(newest) AS newest_schema_id"
_RELEVANCE = "CASE WHEN max(newest) IS NULL THEN NULL WHEN min(oldest) = max(newest) THEN 'EXACT_MATCH' ELSE 'LATEST_KNOWN' END AS relevance"


@query("io_dedup_input", "SELECT job_id, run_id, operation_id, dataset_id, CAST(seen_at AS DATE) AS last_at, num_bytes, num_rows, num_files, oldest AS oldest_schema_id, newest AS newest_schema_id FROM dedup_in")
def io_dedup_input(spark, sf_dir):
    return _date(io_stats.dedup_io(OrderTables(spark, sf_dir).input))


@query("io_dedup_output", "SELECT job_id, run_id, operation_id, dataset_id, CAST(seen_at AS DATE) AS last_at, num_bytes, num_rows, num_files, oldest AS oldest_schema_id, newest AS newest_schema_id, CAST(types AS BIGINT) AS types FROM dedup_out")
def io_dedup_output(spark, sf_dir):
    return _long(_date(io_stats.dedup_io(OrderTables(spark, sf_dir).output)), "types")


def _rollup(granularity):
    def run(spark, sf_dir):
        out = io_stats.roll_up(io_stats.dedup_io(OrderTables(spark, sf_dir).output), granularity)
        return _long(_date(out), "types").withColumn("relevance", io_stats.schema_relevance())

    return run


for _g, _keys in (("operation", "operation_id, run_id"), ("run", "CAST(NULL AS BIGINT) AS operation_id, run_id"), ("job", "CAST(NULL AS BIGINT) AS operation_id, CAST(NULL AS BIGINT) AS run_id")):
    query(
        f"io_rollup_{_g}",
        f"SELECT {_keys}, job_id, dataset_id, CAST(max(seen_at) AS DATE) AS last_at, {_ROLLED}, CAST(bit_or(types) AS BIGINT) AS types, {_RELEVANCE} FROM dedup_out GROUP BY ALL",
    )(_rollup(_g.upper()))


@query(
    "io_rollup_grouping_sets",
    f"""SELECT operation_id, run_id, job_id, dataset_id, CASE WHEN grouping(run_id) = 1 THEN 'JOB' WHEN grouping(operation_id) = 1 THEN 'RUN' ELSE 'OPERATION' END AS granularity,
        CAST(max(seen_at) AS DATE) AS last_at, {_ROLLED}, CAST(bit_or(types) AS BIGINT) AS types
        FROM dedup_out GROUP BY GROUPING SETS ((operation_id, run_id, job_id, dataset_id), (run_id, job_id, dataset_id), (job_id, dataset_id))""",
)
def io_rollup_grouping_sets(spark, sf_dir):
    return _long(_date(io_stats.roll_up_all(io_stats.dedup_io(OrderTables(spark, sf_dir).output))), "types")


@query("schema_relevance", f"SELECT relevance, count(*) AS n FROM (SELECT job_id, dataset_id, {_RELEVANCE} FROM dedup_in GROUP BY ALL) GROUP BY ALL")
def schema_relevance(spark, sf_dir):
    rolled = io_stats.roll_up(io_stats.dedup_io(OrderTables(spark, sf_dir).input), io_stats.JOB)
    return rolled.groupBy(io_stats.schema_relevance().alias("relevance")).agg(F.count("*").alias("n"))


def _stats_sql(entity, key):
    side = lambda s, d: f"{s} AS (SELECT {key}, count(DISTINCT dataset_id) AS n, CAST(sum(num_bytes) AS BIGINT) AS b, CAST(sum(num_rows) AS BIGINT) AS r, CAST(sum(num_files) AS BIGINT) AS f FROM {d} GROUP BY 1)"
    cols = ", ".join(f"coalesce({s}.{c}, 0) AS {n}_total_{t}" for s, n in (("i", "inputs"), ("o", "outputs")) for c, t in (("n", "datasets"), ("b", "bytes"), ("r", "rows"), ("f", "files")))
    return f"WITH {side('i', 'dedup_in')}, {side('o', 'dedup_out')} SELECT e.id AS {key}, {cols} FROM {entity} e LEFT JOIN i ON i.{key} = e.id LEFT JOIN o ON o.{key} = e.id"


@query("run_io_stats", _stats_sql("run", "run_id"))
def run_io_stats(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return io_stats.io_statistics(t.run, t.input, t.output, "run_id")


@query("operation_io_stats", _stats_sql("operation", "operation_id"))
def operation_io_stats(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return io_stats.io_statistics(t.operation, t.input, t.output, "operation_id")


@query("run_operation_count", "SELECT run_id, count(DISTINCT id) AS total_operations FROM operation GROUP BY 1")
def run_operation_count(spark, sf_dir):
    return io_stats.operation_counts(OrderTables(spark, sf_dir).operation)


@query("location_dataset_stats", "SELECT location_id, count(DISTINCT id) AS total FROM dataset GROUP BY 1")
def location_dataset_stats(spark, sf_dir):
    return io_stats.per_location(OrderTables(spark, sf_dir).dataset)


@query("location_job_stats", "SELECT location_id, count(DISTINCT id) AS total FROM job GROUP BY 1")
def location_job_stats(spark, sf_dir):
    return io_stats.per_location(OrderTables(spark, sf_dir).job)


@query(
    "io_dataset_relation",
    """SELECT i.dataset_id AS in_dataset_id, o.dataset_id AS out_dataset_id, CAST(max(o.created_at) AS DATE) AS last_at,
       first(i.schema_id ORDER BY i.created_at, i.schema_id NULLS LAST) AS oldest_input_schema_id, last(i.schema_id ORDER BY i.created_at, i.schema_id NULLS LAST) AS newest_input_schema_id,
       first(o.schema_id ORDER BY o.created_at, o.schema_id NULLS LAST) AS oldest_output_schema_id, last(o.schema_id ORDER BY o.created_at, o.schema_id NULLS LAST) AS newest_output_schema_id
       FROM inputs i JOIN outputs o ON i.operation_id = o.operation_id AND i.dataset_id <> o.dataset_id
       WHERE i.created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND o.created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1, 2""",
)
def io_dataset_relation(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _date(io_stats.dataset_relations(t.input, t.output, DAY(1997, 1, 1), DAY(1997, 12, 31)))


# lineage

_STARTS = "(1, 3, 7, 10)"
_IDS = [1, 3, 7, 10]
_CLOSE = "SELECT id FROM {0} UNION SELECT to_dataset_id FROM dataset_symlink WHERE from_dataset_id IN (SELECT id FROM {0}) UNION SELECT from_dataset_id FROM dataset_symlink WHERE to_dataset_id IN (SELECT id FROM {0})"
_TIMED = f"""d_in AS (SELECT job_id, run_id, dataset_id, num_rows, operation_id FROM (SELECT job_id, run_id, operation_id, dataset_id, max(num_rows) AS num_rows FROM inputs WHERE created_at BETWEEN {PERIOD} GROUP BY ALL)),
d_out AS (SELECT job_id, run_id, dataset_id, num_rows, operation_id FROM (SELECT job_id, run_id, operation_id, dataset_id, max(num_rows) AS num_rows FROM outputs WHERE created_at BETWEEN {PERIOD} GROUP BY ALL))"""


def _edges(out):
    rows = lineage.relation_rows(out)
    return rows.select("kind", "from_kind", "from_id", "to_kind", "to_id", "num_rows")


def _walk_sql(first, then, way):
    """Three levels from datasets by job: first and then are the facts before and after the job."""
    kind, other = ("INPUT", "OUTPUT") if way == "DOWNSTREAM" else ("OUTPUT", "INPUT")
    ends = lambda k: "'DATASET' AS from_kind, CAST(dataset_id AS VARCHAR) AS from_id, 'JOB' AS to_kind, CAST(job_id AS VARCHAR) AS to_id" if k == "INPUT" else "'JOB' AS from_kind, CAST(job_id AS VARCHAR) AS from_id, 'DATASET' AS to_kind, CAST(dataset_id AS VARCHAR) AS to_id"
    return f"""WITH {_TIMED}, s0 AS (SELECT id FROM dataset WHERE id IN {_STARTS}), s AS ({_CLOSE.format("s0")}),
        e1 AS (SELECT job_id, dataset_id, num_rows FROM {first} WHERE dataset_id IN (SELECT id FROM s)), j1 AS (SELECT DISTINCT job_id FROM e1),
        e2 AS (SELECT job_id, dataset_id, num_rows FROM {then} WHERE job_id IN (SELECT job_id FROM j1)),
        n0 AS (SELECT DISTINCT dataset_id AS id FROM e2 WHERE dataset_id NOT IN (SELECT id FROM s)), n1 AS ({_CLOSE.format("n0")}), n AS (SELECT id FROM n0 UNION SELECT id FROM n1 WHERE id NOT IN (SELECT id FROM s)),
        e3 AS (SELECT job_id, dataset_id, num_rows FROM {first} WHERE dataset_id IN (SELECT id FROM n))
        SELECT '{kind}' AS kind, {ends(kind)}, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e3) GROUP BY ALL
        UNION ALL SELECT '{other}' AS kind, {ends(other)}, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM e2 GROUP BY ALL"""


@query("lineage_dataset_downstream", _walk_sql("d_in", "d_out", "DOWNSTREAM"))
def lineage_dataset_downstream(spark, sf_dir):
    return _edges(lineage.by_datasets(OrderTables(spark, sf_dir), _IDS, lineage.DOWNSTREAM, lineage.JOB, SINCE, UNTIL, 3))


@query("lineage_dataset_upstream", _walk_sql("d_out", "d_in", "UPSTREAM"))
def lineage_dataset_upstream(spark, sf_dir):
    return _edges(lineage.by_datasets(OrderTables(spark, sf_dir), _IDS, lineage.UPSTREAM, lineage.JOB, SINCE, UNTIL, 3))


LONG = "TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'"


def _relations_sql(depth, down, up):
    rel = f"rel AS (SELECT DISTINCT i.dataset_id AS a, o.dataset_id AS b FROM inputs i JOIN outputs o ON i.operation_id = o.operation_id AND i.dataset_id <> o.dataset_id WHERE i.created_at BETWEEN {LONG} AND o.created_at BETWEEN {LONG})"
    parts, found = [f"s0 AS (SELECT id FROM dataset WHERE id IN {_STARTS})", f"k0 AS ({_CLOSE.format('s0')})", "dn0 AS (SELECT id FROM k0)", "up0 AS (SELECT id FROM k0)"], []
    for i in range(depth):
        step = []
        for on, name, near, far in ((down, "dn", "a", "b"), (up, "up", "b", "a")):
            if on:
                parts.append(f"{name}r{i} AS (SELECT a, b FROM rel WHERE {near} IN (SELECT id FROM {name}{i}))")
                parts.append(f"{name}f{i} AS (SELECT DISTINCT {far} AS id FROM {name}r{i} WHERE {far} NOT IN (SELECT id FROM k{i}))")
                parts.append(f"{name}{i + 1} AS ({_CLOSE.format(f'{name}f{i}')})")
                found.append(f"SELECT a, b FROM {name}r{i}")
                step.append(f"SELECT id FROM {name}{i + 1}")
        parts.append(f"k{i + 1} AS (SELECT id FROM k{i} UNION {' UNION '.join(step)})")
    return f"WITH {rel}, {', '.join(parts)} SELECT DISTINCT a AS in_dataset_id, b AS out_dataset_id FROM ({' UNION '.join(found)})"


@query("lineage_dataset_both", _relations_sql(2, True, True))
def lineage_dataset_both(spark, sf_dir):
    out = lineage.by_datasets(OrderTables(spark, sf_dir), _IDS, lineage.BOTH, lineage.DATASET, DAY(1997, 1, 1), DAY(1997, 12, 31), 2)
    return out.all_relations().select("in_dataset_id", "out_dataset_id")


@query("lineage_dataset_relations_deep", _relations_sql(5, True, False))
def lineage_dataset_relations_deep(spark, sf_dir):
    out = lineage.by_datasets(OrderTables(spark, sf_dir), _IDS, lineage.DOWNSTREAM, lineage.DATASET, DAY(1997, 1, 1), DAY(1997, 12, 31), 5)
    return out.all_relations().select("in_dataset_id", "out_dataset_id")


def _jobs_sql(depth):
    """From jobs downstream by job; after each hop the datasets that were visited are no frontier."""
    parts = ["j0 AS (SELECT id FROM job WHERE id IN (1, 2, 4, 7, 8, 10, 11, 13))", "vd0 AS (SELECT CAST(-1 AS BIGINT) AS id)", "vj0 AS (SELECT id FROM j0)"]
    outs, ins = [], []
    for i in range(depth):
        if i % 2 == 0:  # jobs to datasets
            parts.append(f"o{i} AS (SELECT job_id, dataset_id, num_rows FROM d_out WHERE job_id IN (SELECT id FROM j{i}))")
            parts.append(f"a{i} AS (SELECT DISTINCT dataset_id AS id FROM o{i} WHERE dataset_id NOT IN (SELECT id FROM vd{i}))")
            parts.append(f"b{i} AS ({_CLOSE.format(f'a{i}')})")
            parts.append(f"s{i + 1} AS (SELECT id FROM a{i} UNION SELECT id FROM b{i} WHERE id NOT IN (SELECT id FROM vd{i}))")
            parts.append(f"vd{i + 1} AS (SELECT id FROM vd{i} UNION SELECT id FROM s{i + 1})")
            parts.append(f"vj{i + 1} AS (SELECT id FROM vj{i})")
            outs.append(f"SELECT * FROM o{i}")
        else:
            parts.append(f"i{i} AS (SELECT job_id, dataset_id, num_rows FROM d_in WHERE dataset_id IN (SELECT id FROM s{i}))")
            parts.append(f"j{i + 1} AS (SELECT DISTINCT job_id AS id FROM i{i} WHERE job_id NOT IN (SELECT id FROM vj{i}))")
            parts.append(f"vj{i + 1} AS (SELECT id FROM vj{i} UNION SELECT id FROM j{i + 1})")
            parts.append(f"vd{i + 1} AS (SELECT id FROM vd{i})")
            ins.append(f"SELECT * FROM i{i}")
    sides = [f"SELECT 'OUTPUT' AS kind, 'JOB' AS from_kind, CAST(job_id AS VARCHAR) AS from_id, 'DATASET' AS to_kind, CAST(dataset_id AS VARCHAR) AS to_id, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM ({' UNION ALL '.join(outs)}) GROUP BY ALL"]
    if ins:
        sides.append(f"SELECT 'INPUT' AS kind, 'DATASET' AS from_kind, CAST(dataset_id AS VARCHAR) AS from_id, 'JOB' AS to_kind, CAST(job_id AS VARCHAR) AS to_id, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM ({' UNION ALL '.join(ins)}) GROUP BY ALL")
    return f"WITH {_TIMED}, {', '.join(parts)} {' UNION ALL '.join(sides)}"


def _jobs_walk(depth):
    def run(spark, sf_dir):
        return _edges(lineage.by_jobs(OrderTables(spark, sf_dir), [1, 2, 4, 7, 8, 10, 11, 13], lineage.DOWNSTREAM, lineage.JOB, SINCE, UNTIL, depth))

    return run


for _d in (1, 2, 3):
    query(f"lineage_job_depth{_d}", _jobs_sql(_d))(_jobs_walk(_d))


def _grain(kind, table, where):
    rows = []
    for grain, key in (("OPERATION", "operation_id"), ("RUN", "run_id"), ("JOB", "job_id")):
        ends = f"'DATASET' AS from_kind, CAST(dataset_id AS VARCHAR) AS from_id, '{grain}' AS to_kind, CAST({key} AS VARCHAR) AS to_id" if kind == "INPUT" else f"'{grain}' AS from_kind, CAST({key} AS VARCHAR) AS from_id, 'DATASET' AS to_kind, CAST(dataset_id AS VARCHAR) AS to_id"
        rows.append(f"SELECT '{kind}' AS kind, {ends}, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM {table} WHERE {where} GROUP BY ALL")
    return rows


@query("lineage_symlink_closure", f"WITH s0 AS (SELECT id FROM dataset WHERE id IN {_STARTS}) SELECT id FROM ({_CLOSE.format('s0')})")
def lineage_symlink_closure(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return lineage.Walker(t).closure(t.dataset.where(F.col("id").isin(_IDS)).select("id"))[0]


@query(
    "lineage_dataset_schema_pick",
    """WITH o AS (SELECT dataset_id, first(schema_id ORDER BY created_at, schema_id) AS a, last(schema_id ORDER BY created_at, schema_id) AS b FROM outputs WHERE schema_id IS NOT NULL GROUP BY 1),
       i AS (SELECT dataset_id, first(schema_id ORDER BY created_at, schema_id) AS a, last(schema_id ORDER BY created_at, schema_id) AS b FROM inputs WHERE schema_id IS NOT NULL GROUP BY 1)
       SELECT dataset_id, coalesce(o.b, i.b) AS schema_id, CASE WHEN coalesce(o.b, i.b) = coalesce(o.a, i.a) THEN 'EXACT_MATCH' ELSE 'LATEST_KNOWN' END AS relevance FROM o FULL JOIN i USING (dataset_id)""",
)
def lineage_dataset_schema_pick(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return lineage.dataset_schemas(t.input, t.output)


# columns

_COMBINED = "SELECT source_dataset_id, target_dataset_id, source_column, target_column, bit_or(type) AS types, max(created_at) AS used FROM column_lineage JOIN column_relation USING (fingerprint) {} GROUP BY 1, 2, 3, 4"


def _names(mask):
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {mask} & {bit} <> 0 THEN '{name}' END" for name, bit in flags.RELATION_TYPES.items()) + "] IF x IS NOT NULL]"


@query("column_lineage_combined", f"SELECT source_dataset_id, target_dataset_id, source_column, target_column, CAST(types AS BIGINT) AS types, CAST(used AS DATE) AS last_at FROM ({_COMBINED.format('')})")
def column_lineage_combined(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _long(_date(columns.combined(t.column_lineage, t.dataset_column_relation), "last_used_at"), "types")


def _flat(df, *keys):
    """Sources as text, one row each: nested values compare alike in every engine that way."""
    return df.select(*keys, F.explode("sources").alias("s")).select(*keys, F.col("s.field").alias("field"), F.array_join("s.types", "|").alias("types"))


@query("column_lineage_direct", f"SELECT source_dataset_id, target_dataset_id, target_column, source_column AS field, array_to_string({_names('types')}, '|') AS types FROM ({_COMBINED.format('')}) WHERE target_column IS NOT NULL")
def column_lineage_direct(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _flat(columns.direct(columns.combined(t.column_lineage, t.dataset_column_relation)), "source_dataset_id", "target_dataset_id", "target_column")


@query("column_lineage_indirect", f"SELECT source_dataset_id, target_dataset_id, source_column AS field, array_to_string({_names('types')}, '|') AS types FROM ({_COMBINED.format('')}) WHERE target_column IS NULL")
def column_lineage_indirect(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _flat(columns.indirect(columns.combined(t.column_lineage, t.dataset_column_relation)), "source_dataset_id", "target_dataset_id")


@query("anti_missing_fingerprints", "SELECT fingerprint, source_column, target_column, CAST(type AS BIGINT) AS type FROM column_relation WHERE fingerprint NOT IN (SELECT fingerprint FROM column_lineage WHERE created_at >= TIMESTAMP '2000-01-01')")
def anti_missing_fingerprints(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _long(columns.new_relations(t.dataset_column_relation, t.column_lineage.where(F.col("created_at") >= F.lit(DAY(2000, 1, 1)))), "type")


# usage


def _usage(depth):
    def run(spark, sf_dir):
        t = OrderTables(spark, sf_dir)
        return _date(analytics.usage(t.output, t.run, t.user, t.dataset, t.location, depth, NOW))

    return run


for _d, _interval in (("daily", "1 day"), ("weekly", "7 days"), ("monthly", "1 month")):
    query(
        f"usage_{_d}",
        f"""SELECT dataset_id, u.id AS user_id, CAST(max(o.created_at) AS DATE) AS last_at, count(*) AS num_of_interactions, CAST(sum(num_bytes) AS BIGINT) AS num_bytes, CAST(sum(num_rows) AS BIGINT) AS num_rows,
            CAST(sum(num_files) AS BIGINT) AS num_files, u.name AS user_name, d.name AS dataset_name, l.name AS dataset_location, l.type AS dataset_location_type
            FROM outputs o JOIN run r ON r.id = o.run_id JOIN users u ON u.id = r.started_by_user_id JOIN dataset d ON d.id = o.dataset_id LEFT JOIN location l ON l.id = d.location_id
            WHERE o.created_at >= TIMESTAMP '2001-11-04' - INTERVAL '{_interval}' GROUP BY ALL""",
    )(_usage(_d))


# listings


@query("job_last_run", "SELECT job_id, id, CAST(created_at AS DATE) AS last_at, CAST(status AS BIGINT) AS status FROM run QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY run.created_at DESC, id DESC) = 1")
def job_last_run(spark, sf_dir):
    return _long(_date(listing.last_runs(OrderTables(spark, sf_dir).run).select("job_id", "id", "created_at", "status"), "created_at"), "status")


@query("jobs_all_tags", "SELECT id, name FROM job WHERE id IN (SELECT job_id FROM job_tag_value WHERE tag_value IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING count(DISTINCT tag_value) = 3)")
def jobs_all_tags(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return listing.with_all_tags(t.job, t.job_tag_value, "job_id", "tag_value", ["1-URGENT", "2-HIGH", "5-LOW"]).select("id", "name")


@query(
    "runs_filtered_page",
    """SELECT id, job_id, CAST(created_at AS DATE) AS created, CAST(status AS BIGINT) AS status FROM run
       WHERE run.created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND status IN (0, 1) AND job_id IN (SELECT id FROM job WHERE type IN ('BUILDING', 'MACHINERY'))
       AND started_by_user_id IN (SELECT id FROM users WHERE name IN ('user1', 'user2', 'user3', 'user4')) ORDER BY run.created_at DESC, id DESC LIMIT 20 OFFSET 20""",
)
def runs_filtered_page(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    found = listing.runs(t, since=DAY(1996, 1, 1), until=DAY(1999, 12, 31), statuses=[0, 1], job_types=["BUILDING", "MACHINERY"], users=["USER1", "user2", "user3", "user4"])
    page = listing.page_rows(found, [F.desc("created_at"), F.desc("id")], page=2)
    return _long(_date(page.select("id", "job_id", "created_at", "status"), "created_at", "created"), "status")


@query(
    "runs_page_with_stats",
    "WITH p AS (SELECT id FROM run WHERE run.created_at >= TIMESTAMP '1998-01-01' ORDER BY run.created_at DESC, id DESC LIMIT 50) "
    + """SELECT p.id, (SELECT count(DISTINCT o.id) FROM operation o WHERE o.run_id = p.id) AS total_operations,
       (SELECT coalesce(CAST(sum(num_rows) AS BIGINT), 0) FROM dedup_in d WHERE d.run_id = p.id) AS inputs_total_rows, (SELECT coalesce(CAST(sum(num_bytes) AS BIGINT), 0) FROM dedup_out d WHERE d.run_id = p.id) AS outputs_total_bytes FROM p""",
)
def runs_page_with_stats(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    page = listing.page_rows(listing.runs(t, since=DAY(1998, 1, 1)), [F.desc("created_at"), F.desc("id")], page_size=50)
    return listing.with_run_statistics(page, t).select("id", "total_operations", "inputs_total_rows", "outputs_total_bytes")


@query("operations_of_runs", "SELECT id, run_id, name FROM operation WHERE run_id IN (1, 2, 3, 5, 8, 13, 21, 34) AND created_at >= TIMESTAMP '1995-06-01'")
def operations_of_runs(spark, sf_dir):
    return listing.operations(OrderTables(spark, sf_dir), run_ids=[1, 2, 3, 5, 8, 13, 21, 34], since=DAY(1995, 6, 1)).select("id", "run_id", "name")


@query("datasets_page", "SELECT d.id, d.name, l.name AS location_name, l.type AS location_type FROM dataset d JOIN location l ON l.id = d.location_id WHERE l.type IN ('asia', 'europe') ORDER BY d.name LIMIT 10")
def datasets_page(spark, sf_dir):
    found = listing.datasets(OrderTables(spark, sf_dir), location_types=["ASIA", "Europe"])
    return listing.page_rows(found, [F.asc("name")], page_size=10).select("id", "name", "location_name", "location_type")


@query(
    "jobs_page",
    """SELECT j.id, j.name, l.type AS location_type, r.id AS last_run_id FROM job j JOIN location l ON l.id = j.location_id
       LEFT JOIN (SELECT job_id, id FROM run QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY run.created_at DESC, id DESC) = 1) r ON r.job_id = j.id
       WHERE j.type = 'BUILDING' AND l.type = 'asia' ORDER BY j.name LIMIT 20""",
)
def jobs_page(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    page = listing.page_rows(listing.jobs(t, types=["BUILDING"], location_types=["asia"]), [F.asc("name")])
    return listing.with_last_runs(page, t).select("id", "name", "location_type", "last_run_id")


@query("locations_page", "SELECT id, type, name, (SELECT count(*) FROM dataset d WHERE d.location_id = l.id) AS total_datasets, (SELECT count(*) FROM job j WHERE j.location_id = l.id) AS total_jobs FROM location l ORDER BY name, type LIMIT 10 OFFSET 10")
def locations_page(spark, sf_dir):
    found = listing.locations(OrderTables(spark, sf_dir))
    return listing.page_rows(found, [F.asc("name"), F.asc("type")], page=2, page_size=10).select("id", "type", "name", "total_datasets", "total_jobs")


@query("tags_grouped", "SELECT job_id, 'priority' AS tag, array_to_string(list_sort(list(DISTINCT tag_value)), '|') AS tag_values FROM job_tag_value GROUP BY 1")
def tags_grouped(spark, sf_dir):
    bridge = OrderTables(spark, sf_dir).job_tag_value.select("job_id", F.lit("priority").alias("tag"), F.col("tag_value").alias("value"))
    return listing.grouped_tags(bridge, "job_id").select("job_id", "tag", F.array_join("values", "|").alias("tag_values"))


@query("distinct_types", "SELECT DISTINCT type FROM location ORDER BY 1")
def distinct_types(spark, sf_dir):
    return listing.distinct_sorted(OrderTables(spark, sf_dir).location, "type")


@query("multi_col_in", "SELECT id, type, name FROM location WHERE (type, name) IN (('africa', 'nation_0'), ('america', 'nation_1'), ('asia', 'nation_0'))")
def multi_col_in(spark, sf_dir):
    pairs = [("africa", "nation_0"), ("america", "nation_1"), ("asia", "nation_0")]
    return listing.in_pairs(OrderTables(spark, sf_dir).location, ("type", "name"), pairs, ("string", "string")).select("id", "type", "name")


@query("symlinks_touching", "SELECT from_dataset_id, to_dataset_id, type FROM dataset_symlink WHERE from_dataset_id IN (10, 21) OR to_dataset_id IN (10, 21)")
def symlinks_touching(spark, sf_dir):
    return listing.touching(OrderTables(spark, sf_dir).dataset_symlink, [10, 21])


@query("run_parents", "SELECT r.id, p.id AS parent_id, p.job_id AS parent_job_id FROM run r JOIN run p ON r.parent_run_id = p.id")
def run_parents(spark, sf_dir):
    return listing.parents(OrderTables(spark, sf_dir).run)


# search: the SQL states tokens, match and rank again

_CLEAN = "regexp_replace({0}, '[^\\p{{L}}\\p{{N}}/._-]', ' ', 'g')"
_VECTOR = "list_distinct([x FOR x IN regexp_split_to_array(lower({0} || ' ' || translate({0}, '/.', '  ')), '\\s+') IF x <> ''])"


def _branch(source, key, expr, written, bare):
    """(id, rank) of the rows of a source that match."""
    v = _VECTOR.format(_CLEAN.format(f"({expr})"))
    exact = " AND ".join(f"list_contains(v, '{w}')" for w in written) or "false"
    begin = " AND ".join(f"len([x FOR x IN v IF starts_with(x, '{w}')]) > 0" for w in written) or "false"
    parts = " AND ".join(f"len([x FOR x IN v IF starts_with(x, '{w}')]) > 0" for w in bare) or "false"
    points = " + ".join(f"CASE WHEN list_contains(v, '{w}') THEN 2 WHEN len([x FOR x IN v IF starts_with(x, '{w}')]) > 0 THEN 1 ELSE 0 END" for w in sorted({*written, *bare}))
    return f"SELECT {key} AS id, CAST(floor(({points}) * 1000000 / len(v)) AS BIGINT) AS search_rank FROM (SELECT {key}, {v} AS v FROM {source}) WHERE ({exact}) OR ({begin}) OR ({parts})"


def _search_sql(branches, written, bare):
    return "SELECT id, max(search_rank) AS search_rank FROM (" + " UNION ALL ".join(_branch(*b, written, bare) for b in branches) + ") GROUP BY 1"


_DATASETS = "(SELECT d.id, d.name, l.type AS lt, l.name AS ln FROM dataset d JOIN location l ON l.id = d.location_id)"
_JOBS = "(SELECT j.id, j.name, l.type AS lt, l.name AS ln FROM job j JOIN location l ON l.id = j.location_id)"


@query("search_dataset", _search_sql([("dataset", "id", "name"), (_DATASETS, "id", "lt || ' ' || ln")], ["asia"], ["asia"]))
def search_dataset(spark, sf_dir):
    return listing.datasets(OrderTables(spark, sf_dir), text="asia").select("id", "search_rank")


@query("search_job", _search_sql([("job", "id", "name"), (_JOBS, "id", "lt || ' ' || ln")], ["customer", "000000012"], ["customer", "000000012"]))
def search_job(spark, sf_dir):
    return listing.jobs(OrderTables(spark, sf_dir), text="Customer#000000012").select("id", "search_rank")


@query("search_location", _search_sql([("location", "id", "type || ' ' || name")], ["east"], ["east"]))
def search_location(spark, sf_dir):
    return listing.locations(OrderTables(spark, sf_dir), text="east").select("id", "search_rank")


@query(
    "search_run",
    "WITH r AS (SELECT * FROM run WHERE run.created_at >= TIMESTAMP '1996-01-01') "
    + _search_sql([("r", "id", "external_id"), ("(SELECT r.id, j.name FROM r JOIN job j ON j.id = r.job_id)", "id", "name")], ["run-12"], ["run", "12"]),
)
def search_run(spark, sf_dir):
    return listing.runs(OrderTables(spark, sf_dir), since=DAY(1996, 1, 1), text="run-12").select("id", "search_rank")


@query("search_tag", "SELECT 'o_orderpriority' AS tag, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS tag_values FROM orders", mapped=False)
def search_tag(spark, sf_dir):
    o = OrderTables(spark, sf_dir).source("orders")
    values = o.select(F.lit("o_orderpriority").alias("tag"), F.col("o_orderpriority").alias("value")).union(o.select(F.lit("o_orderstatus"), F.col("o_orderstatus"))).distinct()
    return listing.tags(values, "1-urg").select("tag", F.array_join("values", "|").alias("tag_values"))


@query("search_documents", _search_sql([("(SELECT doc_id AS id, text FROM documents)", "id", "text")], ["released", "license."], ["released", "license"]))
def search_documents(spark, sf_dir):
    docs = OrderTables(spark, sf_dir).source("documents").select(F.col("doc_id").alias("id"), "text")
    return listing.search(docs.select("id"), [(docs, "id", ["text"])], "released license.").select("id", "search_rank")


# events

_STATUS = "CASE event_type WHEN 'signup' THEN 'START' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAIL' ELSE 'OTHER' END"


def _events(spark, sf_dir):
    kind = F.create_map(*(F.lit(x) for p in (("signup", "START"), ("view", "RUNNING"), ("purchase", "COMPLETE"), ("error", "FAIL"), ("click", "OTHER")) for x in p))
    return OrderTables(spark, sf_dir).source("events").select("event_id", F.col("user_id").cast("long").alias("run_id"), "ts", kind[F.col("event_type")].alias("type"), "props")


_EV = f"SELECT event_id, CAST(user_id AS BIGINT) AS run_id, ts, {_STATUS} AS type, props FROM events"


@query(
    "event_status_merge",
    f"""SELECT run_id, CAST(max(CASE type WHEN 'START' THEN 0 WHEN 'RUNNING' THEN 0 WHEN 'COMPLETE' THEN 1 WHEN 'FAIL' THEN 2 ELSE -1 END) AS BIGINT) AS status,
        epoch_us(min(ts) FILTER (type = 'START')) AS started, epoch_us(max(ts) FILTER (type IN ('COMPLETE', 'FAIL'))) AS ended FROM ({_EV}) GROUP BY 1""",
    mapped=False,
)
def event_status_merge(spark, sf_dir):
    out = merge.fold_statuses(_events(spark, sf_dir), "run_id", F.col("type"), "ts")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _long(out.select("run_id", "status", micros("started_at").alias("started"), micros("ended_at").alias("ended")), "status")


@query(
    "event_hourly_tick",
    f"""SELECT DISTINCT run_id, epoch_us(a) + (epoch_us(ts) - epoch_us(a)) // 3600000000 * 3600000000 AS tick FROM (SELECT run_id, ts, min(ts) OVER (PARTITION BY run_id) AS a FROM ({_EV}))""",
    mapped=False,
)
def event_hourly_tick(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    anchors = e.groupBy("run_id").agg(F.min("at").alias("anchor"))
    return e.join(anchors, "run_id").select("run_id", F.unix_micros(text.hourly_tick(F.col("at"), F.col("anchor"))).alias("tick")).distinct()


@query("event_coalesce_latest", f"SELECT run_id, last(json_extract_string(props, '$.k') ORDER BY ts, event_id) FILTER (json_extract_string(props, '$.k') IS NOT NULL AND type <> 'OTHER') AS k FROM ({_EV}) GROUP BY 1", mapped=False)
def event_coalesce_latest(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("k", F.when(F.col("type") != "OTHER", F.get_json_object("props", "$.k")))
    return e.groupBy("run_id").agg(merge.latest_known("k", F.struct("ts", "event_id")).alias("k"))


@query("dlq_split", "SELECT CASE WHEN event_id % 3 = 0 THEN 'malformed' ELSE 'valid' END AS kind, count(*) AS n FROM events GROUP BY 1", mapped=False)
def dlq_split(spark, sf_dir):
    e = OrderTables(spark, sf_dir).source("events")
    named = F.struct(F.lit("n").alias("namespace"), F.col("event_type").alias("name"))
    good = F.to_json(F.struct(F.col("ts").cast("timestamp").alias("eventTime"), F.lit("START").alias("eventType"), named.alias("job"), F.struct(ids.static_uuid(F.col("user_id").cast("string")).alias("runId")).alias("run")))
    raw = e.select(F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit('{"not": "valid event"}')).otherwise(F.lit("{broken"))).otherwise(good).alias("value"))
    valid, malformed = parse_events(raw)
    return valid.select(F.lit("valid").alias("kind")).union(malformed.select(F.lit("malformed"))).groupBy("kind").agg(F.count("*").alias("n"))


# strings and flags

_STATEMENTS = ["SELECT 1", "insert INTO a SELECT 1", "MERGE INTO a", "ALTER TABLE a DROP COLUMN b", "DROP TABLE a", "create table a as select 1", "with x as (select 1) UPDATE a", "COPY a FROM b", "TRUNCATE a", "alter TABLE x RENAME TO y", "DELETE FROM a; INSERT INTO a"]


@query(
    "output_type_from_sql",
    "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 11 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATEMENTS))
    + " END AS q FROM orders), m AS (SELECT o_orderkey, q, upper(regexp_extract(replace(upper(q), 'DROP COLUMN', 'GONE'), '\\b(MERGE|INSERT|UPDATE|DELETE|CREATE|RENAME|TRUNCATE|DROP|COPY)\\s', 1)) AS k FROM s) "
    + "SELECT o_orderkey, CAST(CASE k WHEN 'MERGE' THEN 512 WHEN 'INSERT' THEN 1 WHEN 'COPY' THEN 1 WHEN 'UPDATE' THEN 256 WHEN 'DELETE' THEN 128 WHEN 'CREATE' THEN 2 WHEN 'RENAME' THEN 8 WHEN 'TRUNCATE' THEN 64 WHEN 'DROP' THEN 32 ELSE CASE WHEN upper(q) LIKE 'ALTER %' THEN 4 END END AS BIGINT) AS type FROM m",
)
def output_type_from_sql(spark, sf_dir):
    o = OrderTables(spark, sf_dir).source("orders").select("o_orderkey")
    q = F.array(*map(F.lit, _STATEMENTS))[(F.col("o_orderkey") % 11).cast("int")]
    return o.select("o_orderkey", text.output_type_of_sql(q).cast("long").alias("type"))


@query("location_parse", "SELECT page_id, split_part(lower(url), '://', 1) AS type, regexp_extract(lower(url), '://([^/?#]*)', 1) AS name FROM pages", mapped=False)
def location_parse(spark, sf_dir):
    where = text.dataset_location(F.col("url"))
    return OrderTables(spark, sf_dir).source("pages").select("page_id", where.alias("w")).select("page_id", "w.type", "w.name")


@query("partition_strip", "SELECT o_orderkey, '/data/' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority || '/part' END AS path FROM orders", mapped=False)
def partition_strip(spark, sf_dir):
    o = OrderTables(spark, sf_dir).source("orders")
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/data/"), F.col("o_orderstatus"), F.lit("/day="), F.to_date("o_orderdate").cast("string"), F.lit("/hour=1")))
    return o.select("o_orderkey", text.strip_partitions(path.otherwise(F.concat(F.lit("/data/"), F.col("o_orderpriority"), F.lit("/part")))).alias("path"))


@query("symlink_explode", "SELECT from_dataset_id, to_dataset_id, type FROM dataset_symlink")
def symlink_explode(spark, sf_dir):
    d = OrderTables(spark, sf_dir).dataset.where("id % 10 = 0")
    both = F.array(
        F.struct(F.col("id").alias("from_dataset_id"), (F.col("id") + 1).alias("to_dataset_id"), F.lit("METASTORE").alias("type")),
        F.struct((F.col("id") + 1).alias("from_dataset_id"), F.col("id").alias("to_dataset_id"), F.lit("WAREHOUSE").alias("type")),
    )
    known = OrderTables(spark, sf_dir).dataset.select((F.col("id") - 1).alias("id"))
    return d.join(known, "id", "left_semi").select(F.explode(both).alias("x")).select("x.*")


@query("flags_decode", "SELECT l_orderkey, l_linenumber, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN ((1 << l_linenumber) | 1) & {b} <> 0 THEN '{n}' END" for n, b in flags.OUTPUT_TYPES.items()) + "] IF x IS NOT NULL], '|') AS names FROM lineitem", mapped=False)
def flags_decode(spark, sf_dir):
    item = OrderTables(spark, sf_dir).source("lineitem")
    names = flags.decode_flags(F.expr("shiftleft(1, l_linenumber) | 1"), flags.OUTPUT_TYPES)
    return item.select("l_orderkey", "l_linenumber", F.array_join(names, "|").alias("names"))


@query("flags_encode", "SELECT l_orderkey, l_linenumber, CAST((1 << l_linenumber) | 1 AS BIGINT) AS mask FROM lineitem", mapped=False)
def flags_encode(spark, sf_dir):
    item = OrderTables(spark, sf_dir).source("lineitem")
    names = flags.decode_flags(F.expr("shiftleft(1, l_linenumber) | 1"), flags.OUTPUT_TYPES)
    return item.select("l_orderkey", "l_linenumber", flags.encode_flags(names, flags.OUTPUT_TYPES).cast("long").alias("mask"))


@query("sentinel_counters", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) END AS num_rows FROM lineitem", mapped=False)
def sentinel_counters(spark, sf_dir):
    item = OrderTables(spark, sf_dir).source("lineitem")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("decimal(20,0)")).otherwise(F.lit(2**63 - 1).cast("decimal(20,0)"))
    return item.select("l_orderkey", "l_linenumber", flags.count_or_null(raw).alias("num_rows"))


@query("id_time_bounds", "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders", mapped=False)
def id_time_bounds(spark, sf_dir):
    o = OrderTables(spark, sf_dir).source("orders")
    made = ids.incremental_uuid(F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", F.unix_millis(ids.uuid_instant(made)).alias("ms"))


@query(
    "static_uuid_fingerprint",
    """WITH h AS (SELECT DISTINCT p_type, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_type)) AS h FROM part)
       SELECT p_type, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE substr(h, 17, 1) WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8'
       WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS fingerprint FROM h""",
)
def static_uuid_fingerprint(spark, sf_dir):
    return OrderTables(spark, sf_dir).source("part").select("p_type").distinct().select("p_type", ids.static_uuid(F.col("p_type")).alias("fingerprint"))


# partitions and merges


@query(
    "partition_ranges",
    """WITH t AS (SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem UNION ALL SELECT ts FROM events),
            s AS (SELECT date_trunc('month', min(t)) AS a, date_trunc('month', max(t)) + INTERVAL 2 MONTH AS b FROM t)
       SELECT strftime(m, 'y%Y_m%m') AS name, CAST(m AS DATE) AS begin_at, CAST(m + INTERVAL 1 MONTH AS DATE) AS end_at FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM s)""",
    mapped=False,
)
def partition_ranges(spark, sf_dir):
    source = OrderTables(spark, sf_dir).source
    facts = [source("orders").select(F.col("o_orderdate").alias("created_at")), source("lineitem").select(F.col("l_shipdate").alias("created_at")), source("events").select(F.col("ts").alias("created_at"))]
    out = partitions.partitions_of(facts, granularity="month", ahead=2)
    return out.select("name", F.col("begin").alias("begin_at"), F.col("end").alias("end_at"))


@query("partition_cleanup_selection", "SELECT strftime(t, 'y%Y_m%m_d%d') AS name, t AS begin_at FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders) WHERE t < DATE '1997-01-01'", mapped=False)
def partition_cleanup_selection(spark, sf_dir):
    days = OrderTables(spark, sf_dir).source("orders").select(F.date_format("o_orderdate", "'y'yyyy_'m'MM_'d'dd").alias("name")).distinct()
    return partitions.partitions_before(days.union(spark.createDataFrame([("default",)], "name string")), dt.date(1997, 1, 1)).select("name", F.col("begin").alias("begin_at"))


@query("dedup_row_number", "SELECT dataset_id, operation_id, CAST(created_at AS DATE) AS last_at, num_bytes FROM outputs QUALIFY row_number() OVER (PARTITION BY dataset_id, operation_id ORDER BY outputs.created_at DESC, num_bytes DESC, num_files DESC) = 1")
def dedup_row_number(spark, sf_dir):
    out = first_per(OrderTables(spark, sf_dir).output, ["dataset_id", "operation_id"], F.desc("created_at"), F.desc("num_bytes"), F.desc("num_files"))
    return _date(out.select("dataset_id", "operation_id", "created_at", "num_bytes"), "created_at")


@query(
    "batch_merge_io",
    """SELECT operation_id, run_id, job_id, dataset_id, CAST(min(created_at) AS DATE) AS created, first(schema_id ORDER BY created_at, schema_id) FILTER (schema_id IS NOT NULL) AS schema_id,
       max(nullif(num_bytes, 0)) AS num_bytes, max(nullif(num_rows - num_rows % 3, 0)) AS num_rows, max(nullif(num_files - 1, 0)) AS num_files, CAST(bit_or(type) AS BIGINT) AS type FROM outputs GROUP BY ALL""",
)
def batch_merge_io(spark, sf_dir):
    batch = OrderTables(spark, sf_dir).output.withColumn("num_rows", F.col("num_rows") - F.col("num_rows") % 3).withColumn("num_files", F.col("num_files") - 1)
    return _long(_date(merge.merge_io(batch), "created_at", "created"), "type")


@query(
    "upsert_io_merge",
    """SELECT CAST(created_at AS DATE) AS created, operation_id, run_id, job_id, dataset_id, schema_id,
       max(num_bytes) AS num_bytes, max(num_rows) AS num_rows, max(num_files) AS num_files, CAST(bit_or(type) AS BIGINT) AS type FROM outputs GROUP BY outputs.created_at, operation_id, run_id, job_id, dataset_id, schema_id""",
)
def upsert_io_merge(spark, sf_dir):
    out = OrderTables(spark, sf_dir).output
    part = lambda odd: out.where(F.col("num_files") % 2 == odd)
    keys = ["created_at", "operation_id", "run_id", "job_id", "dataset_id", "schema_id"]
    once = lambda df: df.groupBy(*keys).agg(*(F.max(c).alias(c) for c in io_stats.COUNTERS), F.bit_or("type").alias("type"))
    return _long(_date(merge.upsert_io(once(part(0)), once(part(1))), "created_at", "created"), "type")


@query(
    "upsert_run_merge",
    """SELECT id, CAST(CASE WHEN id % 3 = 0 THEN greatest(status, 1) ELSE status END AS BIGINT) AS status, CASE WHEN id % 6 = 0 THEN 'new-' || id ELSE external_id END AS external_id,
       job_id FROM run UNION ALL SELECT id + 1000000000, 1, CASE WHEN id % 6 = 0 THEN 'new-' || id END, job_id FROM run WHERE id % 3 = 0""",
)
def upsert_run_merge(spark, sf_dir):
    stored = OrderTables(spark, sf_dir).run.select("id", "status", "external_id", "job_id")
    some = stored.where("id % 3 = 0").select("id", F.lit(1).alias("status"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("new-"), F.col("id").cast("string"))).alias("external_id"), "job_id")
    new = some.unionByName(some.withColumn("id", F.col("id") + 1_000_000_000))
    return _long(merge.upsert(stored, new, ["id"]), "status")


@query("insert_missing_rows", "SELECT id + 50 AS id, name FROM dataset WHERE id + 50 NOT IN (SELECT id FROM dataset)")
def insert_missing_rows(spark, sf_dir):
    d = OrderTables(spark, sf_dir).dataset.select("id", "name")
    new = d.withColumn("id", F.col("id") + 50)
    return merge.insert_missing(d, new.union(new), ["id"])


@query("job_tags_replaced", "SELECT job_id, tag_value FROM job_tag_value WHERE job_id % 4 <> 0 OR job_id NOT IN (SELECT job_id FROM job_tag_value) UNION ALL SELECT DISTINCT job_id, 'new' FROM job_tag_value WHERE job_id % 4 = 0")
def job_tags_replaced(spark, sf_dir):
    stored = OrderTables(spark, sf_dir).job_tag_value
    new = stored.where("job_id % 4 = 0").select("job_id", F.lit("new").alias("tag_value"))
    return merge.replace_tags(stored, new, "job_id")


@query("dimension_ids", "SELECT row_number() OVER (ORDER BY p_type) + 1000 AS id, p_type FROM (SELECT DISTINCT p_type FROM part WHERE p_type NOT LIKE '%TIN')", mapped=False)
def dimension_ids(spark, sf_dir):
    types = OrderTables(spark, sf_dir).source("part").select("p_type")
    stored = types.where("p_type LIKE '%TIN'").distinct().select("p_type", F.lit(1000).cast("long").alias("id"))
    anchor = stored.union(spark.createDataFrame([("stored", 1000)], "p_type string, id long"))
    return merge.assign_ids(types, anchor, ["p_type"]).select("id", "p_type")


@query(
    "dataset_partition_collapse",
    "SELECT id, min(id) OVER (PARTITION BY location_id, lower('/data/' || CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END)) AS new_id FROM dataset",
)
def dataset_partition_collapse(spark, sf_dir):
    d = OrderTables(spark, sf_dir).dataset
    name = F.concat(F.lit("/data/"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd"), F.lit("/day="), F.col("id").cast("string"))
    return merge.collapse_partitions(d, name)


# ingest: run events made from orders and line items, extracted again


def _made_events(spark, sf_dir):
    """One event per line item: an operation of a Spark application (the order) that reads or writes a table behind a path."""
    t = OrderTables(spark, sf_dir)
    o = t.source("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    e = t.dealt(t.source("lineitem"), "l_orderkey").join(t.dealt(o, "l_orderkey"), "l_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    uid = lambda k: ids.incremental_uuid(at, k.cast("string"))
    op = uid(F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2 + 1_000_000_000)
    app = F.concat(F.lit("app-"), F.col("o_custkey").cast("string"))
    path = F.concat(F.lit("/data/s"), F.col("l_suppkey").cast("string"), F.lit("/day=1"))
    table = F.concat(F.lit("db.s"), F.col("l_suppkey").cast("string"))
    link = F.array(F.struct(F.lit("hive://meta:9083").alias("namespace"), table.alias("name"), F.lit("TABLE").alias("type")))
    count = F.struct(F.col("l_quantity").cast("long").alias("rowCount"))
    facets = F.when(F.col("l_suppkey") % 2 == 0, F.struct(F.struct(link.alias("identifiers")).alias("symlinks")))
    data = F.struct(F.lit("HDFS://Host1:9820,host2:9820").alias("namespace"), path.alias("name"), facets.alias("facets"), F.struct(count.alias("inputStatistics")).alias("inputFacets"), F.struct(count.alias("outputStatistics")).alias("outputFacets"))
    reads = F.col("l_returnflag") == "R"
    event = F.struct(
        (F.col("o_orderdate") + F.expr("make_dt_interval(0, l_linenumber)")).cast("timestamp").alias("eventTime"),
        F.when(F.col("l_linestatus") == "F", "COMPLETE").otherwise("RUNNING").alias("eventType"),
        F.struct(
            F.lit("yarn://cluster").alias("namespace"), F.concat(app, F.lit(".save")).alias("name"),
            F.struct(F.struct(F.lit("BATCH").alias("processingType"), F.lit("SPARK").alias("integration"), F.lit("SQL_JOB").alias("jobType")).alias("jobType"), F.struct(F.lit("  INSERT INTO x\n  SELECT 1").alias("query")).alias("sql")).alias("facets"),
        ).alias("job"),
        F.struct(op.alias("runId"), F.struct(F.struct(F.struct(F.lit("yarn://cluster").alias("namespace"), app.alias("name")).alias("job"), F.struct(uid(F.col("l_orderkey")).alias("runId")).alias("run")).alias("parent")).alias("facets")).alias("run"),
    )
    as_json = lambda side: F.when(side, F.concat(F.lit("["), F.to_json(data), F.lit("]"))).otherwise("[]")
    value = F.concat(F.regexp_replace(F.to_json(event), r"\}$", ""), F.lit(', "inputs": '), as_json(reads), F.lit(', "outputs": '), as_json(~reads), F.lit("}"))
    texts = cut(e.select(value.alias("value")))
    return extract.classified(valid_events(cut(texts.select(parsed().alias("event")))))


_MADE = "(SELECT l.*, o_custkey, o_orderdate FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"
_DS = "CASE WHEN l_suppkey % 2 = 0 THEN 'db.s' || l_suppkey ELSE '/data/s' || l_suppkey END"


@query("ingest_jobs", f"SELECT DISTINCT 'yarn' AS location_type, 'cluster' AS location_name, 'app-' || o_custkey AS name FROM {_MADE}", mapped=False)
def ingest_jobs(spark, sf_dir):
    return extract.jobs(extract.merged_runs(_made_events(spark, sf_dir))).select("location_type", "location_name", "name")


@query("ingest_datasets", f"SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'hive' ELSE 'hdfs' END AS location_type, CASE WHEN l_suppkey % 2 = 0 THEN 'meta:9083' ELSE 'host1:9820' END AS location_name, {_DS} AS name FROM {_MADE} UNION SELECT 'hdfs', 'host1:9820', '/data/s' || l_suppkey FROM {_MADE}", mapped=False)
def ingest_datasets(spark, sf_dir):
    return extract.named_datasets(_made_events(spark, sf_dir))


@query("ingest_operations", f"SELECT 'app-' || o_custkey AS app, CAST(status AS BIGINT) AS status, count(*) AS n FROM (SELECT o_custkey, l_orderkey, l_linenumber % 2, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS status FROM {_MADE} GROUP BY ALL) GROUP BY ALL", mapped=False)
def ingest_operations(spark, sf_dir):
    e = _made_events(spark, sf_dir)
    ops, runs = extract.merged_operations(e).where("name = 'save'"), extract.merged_runs(e)
    both = ops.select("run_id", "status").join(runs.select(F.col("id").alias("run_id"), F.col("job.name").alias("app")), "run_id")
    return _long(both.groupBy("app", "status").agg(F.count("*").alias("n")), "status")


def _ingest_io(side, flag):
    def run(spark, sf_dir):
        io = extract.merged_io(_made_events(spark, sf_dir), side)
        return io.groupBy(F.col("dataset.name").alias("name")).agg(F.count("*").alias("n"), F.sum("num_rows").alias("num_rows"))

    return run


for _side, _flag in (("inputs", "= 'R'"), ("outputs", "<> 'R'")):
    query(f"ingest_{_side}", f"SELECT {_DS} AS name, count(*) AS n, CAST(sum(r) AS BIGINT) AS num_rows FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(CAST(l_quantity AS BIGINT)) AS r FROM {_MADE} WHERE l_returnflag {_flag} GROUP BY l_suppkey, l_orderkey, l_linenumber) GROUP BY l_suppkey", mapped=False)(_ingest_io(_side, _flag))

# lineage over whole tables: all entities as starts, all pairs, all rows

_WHOLE = f"SELECT source_dataset_id, target_dataset_id, source_column, target_column, CAST(types AS BIGINT) AS types, CAST(used AS DATE) AS last_at FROM ({_COMBINED.format('')})"


@query("lineage_run", "SELECT * FROM (" + " UNION ALL ".join(_grain("INPUT", "dedup_in", "true") + _grain("OUTPUT", "dedup_out", "true")) + ")")
def lineage_run(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _edges(lineage.by_runs(t, t.run.select("id"), lineage.BOTH, lineage.OPERATION))


@query("lineage_operation", "SELECT * FROM (" + " UNION ALL ".join(_grain("INPUT", "dedup_in", "true") + _grain("OUTPUT", "dedup_out", "true")) + ")")
def lineage_operation(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _edges(lineage.by_operations(t, t.operation.select("id"), lineage.BOTH, SINCE, UNTIL))


@query(
    "lineage_parent_relations",
    """WITH ops AS (SELECT id, run_id FROM operation WHERE id IN (SELECT operation_id FROM dedup_in UNION SELECT operation_id FROM dedup_out))
       SELECT 'RUN' AS from_kind, CAST(run_id AS VARCHAR) AS from_id, 'OPERATION' AS to_kind, CAST(id AS VARCHAR) AS to_id FROM ops
       UNION ALL SELECT DISTINCT 'JOB', CAST(job_id AS VARCHAR), 'RUN', CAST(run.id AS VARCHAR) FROM run JOIN ops ON ops.run_id = run.id""",
)
def lineage_parent_relations(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return lineage.parent_relations(lineage.by_operations(t, t.operation.select("id"), lineage.BOTH, sums=False), t)


@query("column_lineage_pairs", _WHOLE)
def column_lineage_pairs(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    pairs = t.column_lineage.select("source_dataset_id", "target_dataset_id").distinct()
    return _long(_date(columns.of_pairs(t.column_lineage, t.dataset_column_relation, pairs, tasks=t.tasks), "last_used_at"), "types")


@query("column_lineage_by_job", _WHOLE)
def column_lineage_by_job(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    shown = t.dataset.select("id")
    return _long(_date(columns.of_entities(t.column_lineage, t.dataset_column_relation, "job_id", t.job.select("id"), shown, shown, tasks=t.tasks), "last_used_at"), "types")


@query("union_pages", "SELECT id, name, 'dataset' AS kind FROM dataset UNION SELECT id, name, 'job' FROM job")
def union_pages(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return listing.either(*(df.select("id", "name", F.lit(kind).alias("kind")) for kind, df in (("dataset", t.dataset), ("job", t.job))))


@query(
    "ingest_schema_first",
    f"""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS digits FROM (
        SELECT l_orderkey, l_suppkey, l_orderkey * 2 + l_linenumber % 2 AS op, min(l_linenumber) AS c FROM {_MADE} WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY 1""",
    mapped=False,
)
def ingest_schema_first(spark, sf_dir):
    """Of several schemas of a read in an hour that told first: here a line item's number is its schema, and its minute the time."""
    e = OrderTables(spark, sf_dir).source("lineitem").where("l_returnflag = 'R'")
    rows = e.select(
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"), (F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2).alias("operation_id"), F.col("l_orderkey").alias("run_id"),
        F.timestamp_seconds(F.col("l_linenumber") * 60).alias("told_at"), F.col("l_suppkey").alias("dataset"), F.col("l_linenumber").cast("string").alias("schema_digest"),
        *(F.lit(None).cast("long").alias(c) for c in io_stats.COUNTERS),
    )
    first = extract.merged_rows(rows, "inputs")
    return first.groupBy(F.col("run_id").alias("l_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("schema_digest").cast("long")).alias("digits"))


# listings by address, location, end, with tags, statistics and texts


@query("search_location_address", _search_sql([("location", "id", "type || ' ' || name"), ("(SELECT location_id AS id, url FROM address)", "id", "url")], ["h12.example"], ["h12", "example"]))
def search_location_address(spark, sf_dir):
    return listing.locations(OrderTables(spark, sf_dir), text="h12.example").select("id", "search_rank")


@query("search_dataset_address", _search_sql([("dataset", "id", "name"), ("(SELECT d.id, url FROM dataset d JOIN address USING (location_id))", "id", "url")], ["h7.example:9000"], ["h7", "example", "9000"]))
def search_dataset_address(spark, sf_dir):
    return listing.datasets(OrderTables(spark, sf_dir), text="h7.example:9000").select("id", "search_rank")


@query("search_job_page", f"SELECT id, search_rank FROM ({_search_sql([('job', 'id', 'name'), (_JOBS, 'id', "lt || ' ' || ln")], ['customer'], ['customer'])}) JOIN job USING (id) ORDER BY search_rank DESC, name LIMIT 20")
def search_job_page(spark, sf_dir):
    found = listing.jobs(OrderTables(spark, sf_dir), text="customer")
    return listing.page_rows(found, listing.by_rank(F.asc("name"))).select("id", "search_rank")


@query("runs_ended_in_locations", "SELECT run.id, job_id, CAST(ended_at AS DATE) AS ended FROM run WHERE ended_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND job_id IN (SELECT id FROM job WHERE location_id IN (1, 2, 3, 4, 5))")
def runs_ended_in_locations(spark, sf_dir):
    found = listing.runs(OrderTables(spark, sf_dir), ended_since=DAY(1997, 1, 1), ended_until=DAY(1997, 12, 31), job_location_ids=[1, 2, 3, 4, 5])
    return _date(found.select("id", "job_id", "ended_at"), "ended_at", "ended")


@query("jobs_with_tags", "SELECT job.id, coalesce((SELECT string_agg(tag_value, '|' ORDER BY tag_value) FROM job_tag_value t WHERE t.job_id = job.id), '') AS priorities FROM job")
def jobs_with_tags(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    bridge = t.job_tag_value.select("job_id", F.lit("priority").alias("tag"), F.col("tag_value").alias("value"))
    rows = listing.with_tags(t.job, bridge, "job_id")
    return rows.select("id", F.coalesce(F.array_join(F.get("tags", F.lit(0))["values"], "|"), F.lit("")).alias("priorities"))


@query(
    "operations_page_with_stats",
    """WITH p AS (SELECT id FROM operation WHERE operation.created_at >= TIMESTAMP '1998-01-01' ORDER BY operation.created_at DESC, id DESC LIMIT 50)
       SELECT p.id, (SELECT count(DISTINCT dataset_id) FROM dedup_in d WHERE d.operation_id = p.id) AS inputs_total_datasets, (SELECT coalesce(CAST(sum(num_rows) AS BIGINT), 0) FROM dedup_in d WHERE d.operation_id = p.id) AS inputs_total_rows,
       (SELECT coalesce(CAST(sum(num_bytes) AS BIGINT), 0) FROM dedup_out d WHERE d.operation_id = p.id) AS outputs_total_bytes FROM p""",
)
def operations_page_with_stats(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    page = listing.page_rows(io_stats.in_period(t.operation, DAY(1998, 1, 1)), [F.desc("created_at"), F.desc("id")], page_size=50)
    return listing.with_operation_statistics(page, t).select("id", "inputs_total_datasets", "inputs_total_rows", "outputs_total_bytes")


@query("operations_with_query_text", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'SELECT ' || (id % 50) END AS sql_query FROM operation")
def operations_with_query_text(spark, sf_dir):
    rows = OrderTables(spark, sf_dir).operation.withColumn("sql_fingerprint", F.when(F.col("id") % 3 != 0, ids.static_uuid((F.col("id") % 50).cast("string"))))
    texts = spark.range(50).select(ids.static_uuid(F.col("id").cast("string")).alias("fingerprint"), F.concat(F.lit("SELECT "), F.col("id").cast("string")).alias("query"))
    return listing.with_query_text(rows, texts).select("id", "sql_query")


@query("location_patched", "SELECT id, name, CASE WHEN id = 3 THEN 'ext-3' END AS external_id FROM location")
def location_patched(spark, sf_dir):
    return merge.set_external_id(OrderTables(spark, sf_dir).location, 3, "ext-3").select("id", "name", "external_id")


@query("location_match", "SELECT type, CASE WHEN id % 2 = 0 THEN name ELSE 'other-' || id END AS name, CASE WHEN id % 5 <> 1 OR id % 2 = 0 THEN id END AS id FROM location")
def location_match(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    known = t.location.join(t.address.select(F.col("location_id").alias("id"), "url"), "id")
    name = F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("other-"), F.col("id").cast("string")))
    new = known.select("type", name.alias("name"), F.array(F.when(F.col("id") % 5 != 1, F.col("url")).otherwise("jdbc://nowhere")).alias("addresses"))
    return merge.match_locations(new, t.location, t.address).select("type", "name", "id")


@query("facts_repointed", "SELECT CAST(CASE WHEN dataset_id % 2 = 0 AND dataset_id > 0 THEN dataset_id - 1 ELSE dataset_id END AS BIGINT) AS dataset_id, count(*) AS n, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM inputs GROUP BY 1")
def facts_repointed(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    pair = F.floor((F.col("id") + 1) / 2).cast("string")
    moved = merge.collapse_partitions(t.dataset.withColumn("location_id", F.lit(0)), F.concat(F.lit("/data/"), pair, F.lit("/day="), F.col("id").cast("string")))
    return merge.repoint(t.input, moved).groupBy("dataset_id").agg(F.count("*").alias("n"), F.sum("num_rows").alias("num_rows"))


@query(
    "lineage_symlinks_encoded",
    f"SELECT DISTINCT type, 'DATASET' AS from_kind, CAST(from_dataset_id AS VARCHAR) AS from_id, 'DATASET' AS to_kind, CAST(to_dataset_id AS VARCHAR) AS to_id FROM dataset_symlink WHERE from_dataset_id IN {_STARTS} OR to_dataset_id IN {_STARTS}",
)
def lineage_symlinks_encoded(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    out = lineage.Lineage()
    out.symlinks.append(lineage.Walker(t).closure(t.dataset.where(F.col("id").isin(_IDS)).select("id"))[1])
    return lineage.symlink_rows(out)
