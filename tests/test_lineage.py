"""Lineage walks over small graphs of known shape."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spoorline import schema
from spoorline.operators import columns, io_stats, lineage, listing, merge

T0 = dt.datetime(2024, 7, 1, 10)


class Graph:
    """Tables of a graph given as (job, run, operation, 'in' or 'out', dataset) facts."""

    def __init__(self, spark, facts, symlinks=(), rows=1):
        self.spark = spark
        ins, outs = [], []
        for n, (j, r, o, side, d) in enumerate(facts):
            base = (T0 + dt.timedelta(days=r), o, r, j, d, 100 + d, 10 * (n + 1), n + 1, None)
            (ins if side == "in" else outs).append(base if side == "in" else (*base, 1 << n % 3))
        self.input = spark.createDataFrame(ins, schema.INPUT.format(id="bigint"))
        self.output = spark.createDataFrame(outs, schema.OUTPUT.format(id="bigint"))
        ids = {d for *_, d in facts} | {x for s in symlinks for x in s}
        self.dataset = spark.createDataFrame([(d, 1, f"d{d}") for d in ids], schema.DATASET)
        self.job = spark.createDataFrame([(j, 1, f"j{j}", None) for j in {f[0] for f in facts}], schema.JOB)
        self.run = spark.createDataFrame([(r, j) for j, r in {(f[0], f[1]) for f in facts}], "id bigint, job_id bigint")
        self.operation = spark.createDataFrame([(o, r) for r, o in {(f[1], f[2]) for f in facts}], "id bigint, run_id bigint")
        both = [(a, b, "METASTORE") for a, b in symlinks] + [(b, a, "WAREHOUSE") for a, b in symlinks]
        self.dataset_symlink = spark.createDataFrame(both, "from_dataset_id bigint, to_dataset_id bigint, type string")


def chain(*datasets):
    """d1 -> o1 -> d2 -> o2 -> d3 ..., each operation in a job and run of its own."""
    facts = []
    for i, (a, b) in enumerate(zip(datasets, datasets[1:], strict=False), 1):
        facts += [(i, 10 + i, 100 + i, "in", a), (i, 10 + i, 100 + i, "out", b)]
    return facts


def ids(out, kind):
    nodes = out.nodes(kind)
    return set() if nodes is None else {r.id for r in nodes.collect()}


def edges(out):
    got = set()
    for side in ("inputs", "outputs"):
        rows = out.merged(side)
        if rows is not None:
            got |= {(side[0], r.dataset_id, r.job_id, r.run_id, r.operation_id) for r in rows.collect()}
    return got


@pytest.mark.parametrize(("depth", "jobs", "datasets"), [(1, {1}, {1}), (2, {1}, {1, 2}), (3, {1, 2}, {1, 2}), (10, {1, 2, 3, 4}, {1, 2, 3, 4, 5})])
def test_depth_counts_every_step(spark, depth, jobs, datasets):
    out = lineage.by_datasets(Graph(spark, chain(1, 2, 3, 4, 5)), [1], lineage.DOWNSTREAM, lineage.JOB, T0, None, depth)
    assert ids(out, lineage.JOB) == jobs and ids(out, lineage.DATASET) == datasets


def test_directions(spark):
    g = Graph(spark, chain(1, 2, 3, 4, 5))
    up = lineage.by_datasets(g, [3], lineage.UPSTREAM, lineage.OPERATION, T0, None, 10)
    assert ids(up, lineage.OPERATION) == {101, 102} and ids(up, lineage.DATASET) == {1, 2, 3} and ids(up, lineage.RUN) == {11, 12} and ids(up, lineage.JOB) == {1, 2}
    both = lineage.by_jobs(g, [2], lineage.BOTH, lineage.JOB, T0, None, 1)
    assert edges(both) == {("i", 2, 2, None, None), ("o", 3, 2, None, None)} and ids(both, lineage.DATASET) == {2, 3}


def test_cycles_and_self_references_end(spark):
    cyclic = Graph(spark, [(1, 11, 101, "in", 1), (1, 11, 101, "out", 2), (2, 12, 102, "in", 2), (2, 12, 102, "out", 1)])
    out = lineage.by_datasets(cyclic, [1], lineage.DOWNSTREAM, lineage.JOB, T0, None, 10)
    assert edges(out) == {("i", 1, 1, None, None), ("o", 2, 1, None, None), ("i", 2, 2, None, None), ("o", 1, 2, None, None)}
    selfish = Graph(spark, [(1, 11, 101, "in", 1), (1, 11, 101, "out", 1)])
    out = lineage.by_datasets(selfish, [1], lineage.BOTH, lineage.JOB, T0, None, 10)
    assert edges(out) == {("i", 1, 1, None, None), ("o", 1, 1, None, None)}
    assert lineage.by_datasets(selfish, [1], lineage.BOTH, lineage.DATASET, T0, None, 3).all_relations().count() == 0
    over = lineage.by_datasets(cyclic, [1], lineage.DOWNSTREAM, lineage.DATASET, T0, None, 10).all_relations()
    assert {(r.in_dataset_id, r.out_dataset_id) for r in over.collect()} == {(1, 2), (2, 1)}


def test_symlinks_join_the_walk(spark):
    g = Graph(spark, [(1, 11, 101, "in", 1), (1, 11, 101, "out", 2), (2, 12, 102, "in", 3), (2, 12, 102, "out", 4)], symlinks=[(2, 3)])
    out = lineage.by_datasets(g, [1], lineage.DOWNSTREAM, lineage.JOB, T0, None, 10)
    assert ids(out, lineage.JOB) == {1, 2} and ids(out, lineage.DATASET) == {1, 2, 3, 4} and out.all_symlinks().count() == 2
    over = lineage.by_datasets(g, [1], lineage.DOWNSTREAM, lineage.DATASET, T0, None, 10)
    assert {(r.in_dataset_id, r.out_dataset_id) for r in over.all_relations().collect()} == {(1, 2), (3, 4)}


def test_period_is_inclusive_and_operations_ignore_it_at_first(spark):
    g = Graph(spark, chain(1, 2, 3))
    until = T0 + dt.timedelta(days=11)
    out = lineage.by_datasets(g, [1], lineage.DOWNSTREAM, lineage.JOB, until, until + dt.timedelta(seconds=1), 10)
    assert ids(out, lineage.JOB) == {1}
    late = lineage.by_operations(g, [101], lineage.DOWNSTREAM, dt.datetime(2030, 1, 1))
    assert ("o", 2, 1, 11, 101) in edges(late) and ("o", 2, 1, None, None) in edges(late)


def test_long_running_counters_take_the_largest_then_sum(spark):
    rows = [(T0 + dt.timedelta(hours=h), o, 1, 1, 7, None, h, h, h) for o in (1, 2) for h in range(10)]
    got = io_stats.roll_up(io_stats.dedup_io(spark.createDataFrame(rows, schema.INPUT.format(id="bigint"))), lineage.JOB).collect()
    assert len(got) == 1 and got[0].num_rows == 18 and got[0].operation_id is None and got[0].oldest_schema_id is None


def test_parents_and_relation_rows(spark):
    g = Graph(spark, chain(1, 2))
    out = lineage.by_operations(g, [101], lineage.BOTH)
    assert {(r.from_kind, r.from_id, r.to_id) for r in lineage.parent_relations(out, g).collect()} == {("JOB", "1", "11"), ("RUN", "11", "101")}
    rows = lineage.relation_rows(out).collect()
    assert {(r.kind, r.from_kind, r.to_kind) for r in rows} == {("INPUT", "DATASET", k) for k in ("OPERATION", "RUN", "JOB")} | {("OUTPUT", k, "DATASET") for k in ("OPERATION", "RUN", "JOB")}


def test_unknown_starts_give_nothing(spark):
    g = Graph(spark, chain(1, 2))
    assert lineage.by_datasets(g, [99], since=T0).merged("inputs") is None and lineage.by_runs(g, []).merged("outputs") is None


@pytest.mark.parametrize("bad", [{"depth": 0}, {"depth": 11}, {"direction": "SIDEWAYS"}, {"since": T0, "until": T0}])
def test_arguments(spark, bad):
    with pytest.raises(ValueError):
        lineage.by_datasets(Graph(spark, chain(1, 2)), [1], **{"direction": lineage.BOTH, **bad})


def test_column_lineage_combines_types(spark):
    facts = spark.createDataFrame([(T0, 1, 1, 1, 1, 2, "a"), (T0 + dt.timedelta(1), 2, 1, 1, 1, 2, "b"), (T0, 3, 2, 2, 1, 3, "a")], schema.COLUMN_LINEAGE.format(id="bigint"))
    relations = spark.createDataFrame([("a", "x", "y", 2), ("b", "x", "y", 4), ("b", "z", None, 64)], schema.COLUMN_RELATION)
    rows = columns.combined(facts, relations)
    got = {(r.target_dataset_id, r.source_column, r.target_column): r.types for r in rows.collect()}
    assert got == {(2, "x", "y"): 6, (2, "z", None): 64, (3, "x", "y"): 2}
    one = columns.direct(rows).where("target_dataset_id = 2").head()
    assert one.sources[0].field == "x" and one.sources[0].types == ["IDENTITY", "TRANSFORMATION"]
    assert columns.indirect(rows).count() == 1


def test_merges(spark):
    stored = spark.createDataFrame([(1, 0, "a", None), (2, 2, "b", "x")], "id long, status int, name string, note string")
    new = spark.createDataFrame([(1, 1, None, "n"), (2, 1, "c", None), (3, 0, "d", None)], stored.schema)
    assert {tuple(r) for r in merge.upsert(stored, new, ["id"]).collect()} == {(1, 1, "a", "n"), (2, 2, "c", "x"), (3, 0, "d", None)}
    known = spark.createDataFrame([("a", 4), ("b", 9)], "name string, id long")
    more = spark.createDataFrame([(f"n{i:03d}",) for i in range(300)] + [("a",), ("n001",)], "name string").repartition(7)
    got = sorted((r.name, r.id) for r in merge.assign_ids(more, known, ["name"]).collect())
    assert got == [(f"n{i:03d}", 10 + i) for i in range(300)]


def test_pages(spark):
    df = spark.range(45)
    page = listing.paginate(df, [F.asc("id")], page=3, page_size=20)
    assert [r.id for r in page.rows.collect()] == list(range(40, 45)) and page.pages_count == 3 and not page.has_next and page.previous_page == 2
    assert listing.paginate(df.limit(0), [F.asc("id")]).pages_count == 1
    with pytest.raises(ValueError):
        listing.page_rows(df, [F.asc("id")], page_size=51)
    assert listing.any_of(df, "id", []).count() == 45 and listing.any_of(df, "id", [3, 99]).count() == 1
