"""Queries over walks in every direction, their column lineage, and searches by a stored index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frames import shared_dir
from ..operators import lineage, search_index
from ..sources.tables import OrderTables
from .queries import _CLEAN, _CLOSE, _DATASETS, _IDS, _JOBS, _TIMED, DAY, LONG, PERIOD, _date, _edges, _long, _relations_sql, _search_sql
from .registry import query

JOBS = [1, 2, 4, 7, 8, 10, 11, 13]
_J0 = "(1, 2, 4, 7, 8, 10, 11, 13)"
RUNS = [1, 2, 3, 4, 5, 6, 7, 32, 33]
_R0 = "(1, 2, 3, 4, 5, 6, 7, 32, 33)"

#: The walks' period: so many years that three levels find something.
FROM, TO = DAY(1993, 1, 1), DAY(2000, 12, 31)
WIDE = "TIMESTAMP '1993-01-01' AND TIMESTAMP '2000-12-31'"
_WALKED = _TIMED.replace(PERIOD, WIDE)
_FACT = "operation_id, run_id, job_id, dataset_id, num_rows"


def _rows(kind: str, grain: str, key: str, source: str) -> str:
    """Sums by (entity, dataset) of facts that carry the level at which they were met; of equal edges that of the later level stays."""
    ends = f"'DATASET' AS from_kind, CAST(dataset_id AS VARCHAR) AS from_id, '{grain}' AS to_kind, CAST({key} AS VARCHAR) AS to_id" if kind == "INPUT" else f"'{grain}' AS from_kind, CAST({key} AS VARCHAR) AS from_id, 'DATASET' AS to_kind, CAST(dataset_id AS VARCHAR) AS to_id"
    level = f"SELECT lvl, {key}, dataset_id, CAST(sum(num_rows) AS BIGINT) AS num_rows FROM ({source}) GROUP BY ALL"
    return f"SELECT '{kind}' AS kind, {ends}, num_rows FROM (SELECT * FROM ({level}) QUALIFY row_number() OVER (PARTITION BY {key}, dataset_id ORDER BY lvl DESC) = 1)"


def _entities_sql(key: str, start: str, depth: int, way: str, grains: list[tuple[str, str]]) -> str:
    """A walk from jobs or runs in one direction: facts of the frontier, datasets that are new with their symlinks, facts of those, and so on."""
    first, then = ("d_out", "d_in") if way == lineage.DOWNSTREAM else ("d_in", "d_out")
    kinds = {"d_out": "OUTPUT", "d_in": "INPUT"}
    parts, met = [f"e0 AS (SELECT id FROM {start})", "ve0 AS (SELECT id FROM e0)", "vd0 AS (SELECT CAST(-1 AS BIGINT) AS id)"], {"d_out": [], "d_in": []}
    for i in range(depth):
        if i % 2 == 0:
            parts.append(f"f{i} AS (SELECT {i} AS lvl, {_FACT} FROM {first} WHERE {key} IN (SELECT id FROM e{i}))")
            parts.append(f"a{i} AS (SELECT DISTINCT dataset_id AS id FROM f{i} WHERE dataset_id NOT IN (SELECT id FROM vd{i}))")
            parts.append(f"b{i} AS ({_CLOSE.format(f'a{i}')})")
            parts.append(f"s{i + 1} AS (SELECT id FROM a{i} UNION SELECT id FROM b{i} WHERE id NOT IN (SELECT id FROM vd{i}))")
            parts += [f"vd{i + 1} AS (SELECT id FROM vd{i} UNION SELECT id FROM s{i + 1})", f"ve{i + 1} AS (SELECT id FROM ve{i})"]
            met[first].append(f"SELECT * FROM f{i}")
        else:
            parts.append(f"f{i} AS (SELECT {i} AS lvl, {_FACT} FROM {then} WHERE dataset_id IN (SELECT id FROM s{i}))")
            parts.append(f"e{i + 1} AS (SELECT DISTINCT {key} AS id FROM f{i} WHERE {key} NOT IN (SELECT id FROM ve{i}))")
            parts += [f"ve{i + 1} AS (SELECT id FROM ve{i} UNION SELECT id FROM e{i + 1})", f"vd{i + 1} AS (SELECT id FROM vd{i})"]
            met[then].append(f"SELECT * FROM f{i}")
    sides = [_rows(kinds[io], grain, of, " UNION ALL ".join(found)) for io, found in met.items() if found for grain, of in grains]
    return f"WITH {_WALKED}, {', '.join(parts)} {' UNION ALL '.join(sides)}"


@query("lineage_job_upstream_depth3", _entities_sql("job_id", f"job WHERE id IN {_J0}", 3, lineage.UPSTREAM, [("JOB", "job_id")]))
def lineage_job_upstream_depth3(spark, sf_dir):
    return _edges(lineage.by_jobs(OrderTables(spark, sf_dir), JOBS, lineage.UPSTREAM, lineage.JOB, FROM, TO, 3))


@query("lineage_job_by_run", _entities_sql("job_id", f"job WHERE id IN {_J0}", 1, lineage.DOWNSTREAM, [("RUN", "run_id"), ("JOB", "job_id")]))
def lineage_job_by_run(spark, sf_dir):
    return _edges(lineage.by_jobs(OrderTables(spark, sf_dir), JOBS, lineage.DOWNSTREAM, lineage.RUN, FROM, TO, 1))


for _way in (lineage.DOWNSTREAM, lineage.UPSTREAM):
    query(f"lineage_run_{_way.lower()}_depth3", _entities_sql("run_id", f"run WHERE id IN {_R0}", 3, _way, [("RUN", "run_id"), ("JOB", "job_id")]))(
        lambda spark, sf_dir, way=_way: _edges(lineage.by_runs(OrderTables(spark, sf_dir), RUNS, way, lineage.RUN, FROM, TO, 3))
    )


@query(
    "lineage_job_both_depth2",
    f"""WITH {_WALKED}, i1 AS (SELECT {_FACT} FROM d_in WHERE job_id IN {_J0}), o1 AS (SELECT {_FACT} FROM d_out WHERE job_id IN {_J0}),
        a AS (SELECT DISTINCT dataset_id AS id FROM i1), up AS ({_CLOSE.format("a")}), o2 AS (SELECT {_FACT} FROM d_out WHERE dataset_id IN (SELECT id FROM up)),
        b AS (SELECT DISTINCT dataset_id AS id FROM o1 WHERE dataset_id NOT IN (SELECT id FROM up)), c AS ({_CLOSE.format("b")}),
        dn AS (SELECT id FROM b UNION SELECT id FROM c WHERE id NOT IN (SELECT id FROM up)), i2 AS (SELECT {_FACT} FROM d_in WHERE dataset_id IN (SELECT id FROM dn))
        {_rows("INPUT", "JOB", "job_id", "SELECT 0 AS lvl, * FROM (SELECT * FROM i1 UNION SELECT * FROM i2)")} UNION ALL {_rows("OUTPUT", "JOB", "job_id", "SELECT 0 AS lvl, * FROM (SELECT * FROM o1 UNION SELECT * FROM o2)")}""",
)
def lineage_job_both_depth2(spark, sf_dir):
    return _edges(lineage.by_jobs(OrderTables(spark, sf_dir), JOBS, lineage.BOTH, lineage.JOB, FROM, TO, 2))


# column lineage of a walk


def _columns_sql(entity: str, reads: str, writes: str, when: str) -> str:
    """Relations of the walk's entities between what it shows as read and as written."""
    return f"""SELECT source_dataset_id, target_dataset_id, source_column, target_column, CAST(bit_or(type) AS BIGINT) AS types, CAST(max(created_at) AS DATE) AS last_at
        FROM column_lineage JOIN column_relation USING (fingerprint) WHERE {entity} AND {when}
        AND source_dataset_id IN (SELECT dataset_id FROM inputs WHERE {reads}) AND target_dataset_id IN (SELECT dataset_id FROM outputs WHERE {writes}) GROUP BY 1, 2, 3, 4"""


def _columns(out, t):
    return _long(_date(lineage.column_lineage(out, t, t.tasks), "last_used_at"), "types")


_WITHIN = f"created_at BETWEEN {WIDE}"


@query("walk_columns_by_job", _columns_sql(f"job_id IN {_J0}", f"job_id IN {_J0} AND {_WITHIN}", f"job_id IN {_J0} AND {_WITHIN}", _WITHIN))
def walk_columns_by_job(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _columns(lineage.by_jobs(t, JOBS, lineage.BOTH, lineage.JOB, FROM, TO, sums=False), t)


@query("walk_columns_by_run", _columns_sql("true", _WITHIN, _WITHIN, _WITHIN))
def walk_columns_by_run(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _columns(lineage.by_runs(t, t.run.select("id"), lineage.BOTH, lineage.RUN, FROM, TO, sums=False), t)


@query("walk_columns_by_operation", _columns_sql("true", "true", "true", "true"))
def walk_columns_by_operation(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _columns(lineage.by_operations(t, t.operation.select("id"), lineage.BOTH, sums=False), t)


@query(
    "walk_columns_by_dataset",
    f"""SELECT source_dataset_id, target_dataset_id, source_column, target_column, CAST(bit_or(type) AS BIGINT) AS types, CAST(max(created_at) AS DATE) AS last_at
        FROM column_lineage JOIN column_relation USING (fingerprint) JOIN ({_relations_sql(2, True, True)}) AS walked ON source_dataset_id = in_dataset_id AND target_dataset_id = out_dataset_id
        WHERE created_at BETWEEN {LONG} GROUP BY 1, 2, 3, 4""",
)
def walk_columns_by_dataset(spark, sf_dir):
    t = OrderTables(spark, sf_dir)
    return _columns(lineage.by_datasets(t, _IDS, lineage.BOTH, lineage.DATASET, DAY(1997, 1, 1), DAY(1997, 12, 31), 2), t)


# searches by a stored index


def _index(spark, sf_dir):
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    search_index.write(search_index.entity_postings(OrderTables(spark, sf_dir)), path)
    return spark.read.parquet(path)


def _by_index(name: str, kind: str, text: str, branches: list, written: list[str], bare: list[str]):
    def run(spark, sf_dir):
        return search_index.search(_index(spark, sf_dir), kind, text).select(F.col("id").cast("long").alias("id"), "search_rank")

    query(name, _search_sql(branches, written, bare))(run)


def _located(rows: str, table: str) -> list:
    return [(table, "id", "name"), (rows, "id", "lt || ' ' || ln"), (f"(SELECT t.id, url FROM {table} t JOIN address USING (location_id))", "id", "url")]


_by_index("search_index_dataset", "dataset", "h7.example:9000", _located(_DATASETS, "dataset"), ["h7.example", "9000"], ["h7", "example", "9000"])
_by_index("search_index_job", "job", "Customer#000000012", _located(_JOBS, "job"), ["customer", "000000012"], ["customer", "000000012"])
_by_index("search_index_location", "location", "east", [("location", "id", "type || ' ' || name"), ("(SELECT location_id AS id, url FROM address)", "id", "url")], ["east"], ["east"])
_by_index("search_index_run", "run", "run-12", [("run", "id", "external_id"), ("(SELECT r.id, j.name FROM run r JOIN job j ON j.id = r.job_id)", "id", "name")], ["run-12"], ["run", "12"])


@query(
    "search_documents_cover",
    f"""WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(c || ' ' || translate(c, '/.', '  ')), '\\s+') IF x <> ''] AS v FROM (SELECT doc_id, {_CLEAN.format("text")} AS c FROM documents)),
        p AS (SELECT doc_id, len(list_distinct(v)) AS n, unnest(v) AS token, unnest(range(1, len(v) + 1)) AS place FROM t),
        h AS (SELECT doc_id, n, place, CASE WHEN starts_with(token, 'released') THEN place END AS a, CASE WHEN starts_with(token, 'license') THEN place END AS b FROM p WHERE starts_with(token, 'released') OR starts_with(token, 'license')),
        l AS (SELECT doc_id, n, place, max(a) OVER w AS a, max(b) OVER w AS b FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
        c AS (SELECT doc_id, n, least(a, b) AS s, min(place) AS e, arg_min(a < b, place) AS ordered FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id, n, least(a, b))
        SELECT doc_id AS id, count(*) AS covers, CAST(floor(sum(floor(CASE WHEN ordered THEN 2000000 ELSE 1000000 END / (1 + greatest(0, e - s - 1)))) / n) AS BIGINT) AS cover_rank FROM c GROUP BY doc_id, n""",
)
def search_documents_cover(spark, sf_dir):
    docs = OrderTables(spark, sf_dir).source("documents")
    postings = search_index.vectors(docs, "document", "text", "doc_id", ["text"])
    return search_index.cover_ranks(postings, ["released", "license"]).select("id", "covers", "cover_rank")
