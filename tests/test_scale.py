"""Plans and helpers that matter for large tables: days that are pruned, bounds from ids, clean-up, listings."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from spoorline.functions import ids
from spoorline.operators import analytics, io_stats, lineage, listing, merge
from spoorline.sources import partitions
from spoorline.sources.tables import OrderTables, Tables

SMALL = "/root/testdata/sf0.001"
DAYS = [dt.datetime(2024, 3, d, 10, tzinfo=dt.UTC) for d in range(1, 9)]


def v7(at, n):
    return str(uuid.UUID(int=int(at.timestamp() * 1000) << 80 | 7 << 76 | 2 << 62 | n))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Eight days of runs; each has one operation that reads dataset n and writes dataset n + 1."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    runs = [(v7(at, i), at, 1, 1) for i, at in enumerate(DAYS)]
    ops = [(v7(at, 100 + i), at, runs[i][0], "o") for i, at in enumerate(DAYS)]
    facts = [(at + dt.timedelta(minutes=5), ops[i][0], runs[i][0], 1, i, None, 1, 2, 3) for i, at in enumerate(DAYS)]
    schema = "created_at timestamp, operation_id string, run_id string, job_id long, dataset_id long, schema_id long, num_bytes long, num_rows long, num_files long"
    made = {"run": spark.createDataFrame(runs, "id string, created_at timestamp, job_id long, status int"), "operation": spark.createDataFrame(ops, "id string, created_at timestamp, run_id string, name string")}
    made["input"] = spark.createDataFrame(facts, schema)
    made["output"] = made["input"].withColumn("dataset_id", F.col("dataset_id") + 1).withColumn("type", F.lit(1))
    for name, df in made.items():
        partitions.write_fact(df, f"{path}/{name}")
    spark.createDataFrame([(i, 1, f"d{i}") for i in range(9)], "id long, location_id long, name string").write.parquet(f"{path}/dataset")
    spark.createDataFrame([(1, 1, "j", "t")], "id long, location_id long, name string, type string").write.parquet(f"{path}/job")
    spark.createDataFrame([], "from_dataset_id long, to_dataset_id long, type string").write.parquet(f"{path}/dataset_symlink")
    return Tables(spark, path)


def test_periods_prune_days(stored):
    df = io_stats.in_period(stored.input, DAYS[2], DAYS[3] + dt.timedelta(hours=1))
    text = plan(df)
    assert "PartitionFilters" in text and "created_date" in text.split("PartitionFilters", 1)[1].split("PushedFilters")[0]
    assert len(df.inputFiles()) >= 1 and df.count() == 2
    assert {r.created_date for r in df.collect()} == {dt.date(2024, 3, 3), dt.date(2024, 3, 4)}


def test_bounds_from_ids(spark, stored):
    some = [v7(DAYS[4], 4), v7(DAYS[5], 5)]
    df = ids.with_id_bounds(stored.run, some)
    assert sorted(r.id for r in df.collect()) == sorted(some) and "created_date" in plan(df).split("PartitionFilters", 1)[1].split("PushedFilters")[0]
    assert ids.with_id_bounds(stored.run, []).count() == 0
    assert ids.bounds_of(some) == (DAYS[4], DAYS[5]) == ids.bounds_of(spark.createDataFrame([(i,) for i in some], "id string"))
    assert ids.bounds_of([1, 2]) == ids.bounds_of(["x"]) == ids.bounds_of(spark.range(3)) == ids.bounds_of([]) == (None, None)
    found = listing.runs(stored, ids=some)
    assert found.count() == 2 and "created_date" in plan(found).split("PartitionFilters", 1)[1].split("PushedFilters")[0]


def test_walks_from_ids_take_their_bound_from_them(stored):
    out = lineage.by_runs(stored, [v7(DAYS[6], 6)], lineage.BOTH, lineage.RUN)
    assert [r.dataset_id for r in out.merged("inputs").where("run_id is not null").collect()] == [6]
    out = lineage.by_operations(stored, [v7(DAYS[6], 106)], lineage.BOTH)
    assert {r.dataset_id for r in out.merged("outputs").collect()} == {7}


@pytest.mark.parametrize("direction,want", [(lineage.DOWNSTREAM, {(3, 4), (4, 5)}), (lineage.UPSTREAM, {(2, 3), (1, 2)}), (lineage.BOTH, {(3, 4), (4, 5), (2, 3), (1, 2)})])
def test_walks_over_datasets_read_the_frontier_only(stored, direction, want):
    out = lineage.by_datasets(stored, [3], direction, lineage.DATASET, depth=2)
    assert {(r.in_dataset_id, r.out_dataset_id) for r in out.all_relations().collect()} == want
    rows = lineage.relation_rows(out).collect()
    assert [(r.from_id, r.to_id) for r in rows] == sorted((str(a), str(b)) for a, b in want) and {(r.kind, r.from_kind, r.to_kind) for r in rows} == {("INPUT", "DATASET", "DATASET")}


def test_clean_up_of_days(spark, tmp_path):
    facts = spark.createDataFrame([(at, i) for i, at in enumerate(DAYS)], "created_at timestamp, n int")
    path = f"file://{tmp_path}"
    for name in ("input", "output"):
        partitions.write_fact(facts, f"{path}/{name}")
    old = [(t, at.date()) for t in ("input", "output") for at in DAYS[:3]]
    after = dt.date(2024, 3, 4)
    assert partitions.clean_up(path, ["input", "output", "none"], after) == old and spark.read.parquet(f"{path}/input").count() == 8
    assert partitions.clean_up(path, ["input"], after, partitions.TRUNCATE) == old[:3] and spark.read.parquet(f"{path}/input").count() == 5
    assert partitions.clean_up(path, ["output"], dt.date(2024, 3, 2), partitions.DETACH) == old[3:4]
    assert spark.read.parquet(f"{path}/output").count() == 7 and spark.read.parquet(f"{path}/output_detached").count() == 1
    assert partitions.clean_up(path, ["output"], after, partitions.DROP) == old[4:] and spark.read.parquet(f"{path}/output").count() == 5
    with pytest.raises(ValueError):
        partitions.clean_up(path, [], after, "burn")


def test_usage_is_written_for_every_depth(spark, tmp_path):
    t = OrderTables(spark, SMALL)
    for _ in range(2):  # what was there is replaced
        analytics.refresh(t, f"{tmp_path}", now=dt.datetime(1998, 9, 1))
    for name, io in (("input", t.input), ("output", t.output)):
        for depth in analytics.DEPTHS:
            want = analytics.usage(io, t.run, t.user, t.dataset, t.location, depth, dt.datetime(1998, 9, 1))
            assert spark.read.parquet(f"{tmp_path}/{name}_{depth}_stats").count() == want.count()


def test_locations_are_matched_by_name_then_address(spark):
    stored = spark.createDataFrame([(1, "hdfs", "a"), (2, "hdfs", "b"), (3, "hive", "a")], "id long, type string, name string")
    urls = spark.createDataFrame([(1, "hdfs://x"), (2, "hdfs://x"), (2, "hdfs://y"), (3, "hive://x")], "location_id long, url string")
    new = spark.createDataFrame([("hdfs", "b", ["hdfs://x"]), ("hdfs", "c", ["hdfs://x", "hdfs://y"]), ("hdfs", "d", ["hdfs://z"]), ("hive", "e", ["hdfs://x"]), ("hive", "f", [])], "type string, name string, addresses array<string>")
    assert {r.name: r.id for r in merge.match_locations(new, stored, urls).collect()} == {"b": 2, "c": 1, "d": None, "e": None, "f": None}


def test_only_a_location_that_is_there_is_patched(spark):
    t = OrderTables(spark, SMALL)
    rows = {r.id: r.external_id for r in merge.set_external_id(t.location, 3, "x").collect()}
    assert rows.pop(3) == "x" and set(rows.values()) == {None}
    with pytest.raises(KeyError):
        merge.set_external_id(t.location, 10**9, "x")


def test_added_tags_stay_beside_others(spark):
    stored = spark.createDataFrame([(1, "a", "x")], "dataset long, tag string, value string")
    got = merge.add_tags(stored, spark.createDataFrame([(1, "a", "y"), (1, "a", "x")], stored.schema)).collect()
    assert sorted(r.value for r in got) == ["x", "y"]


def test_listings_end_and_location_of_the_job(spark):
    t = OrderTables(spark, SMALL)
    got = listing.runs(t, ended_until=dt.datetime(1997, 1, 1), job_location_ids=[1, 2], job_types=["BUILDING"])
    jobs = {r.id for r in t.job.where("location_id in (1, 2) and type = 'BUILDING'").collect()}
    assert all(r.job_id in jobs and r.ended_at <= dt.datetime(1997, 1, 1) for r in got.collect())
    rows = listing.with_tags(t.job.limit(5), t.job_tag_value.select("job_id", F.lit("p").alias("tag"), F.col("tag_value").alias("value")).limit(0), "job_id")
    assert [r.tags for r in rows.collect()] == [[]] * 5


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from spoorline import frames

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        frames.shared_dir(Session)


def test_tasks_grow_with_the_facts(spark, monkeypatch):
    from spoorline.sources import tables

    plain = {name: getattr(OrderTables(spark, SMALL), name) for name in ("input", "output", "operation", "column_lineage")}
    monkeypatch.setattr(tables, "WHOLE_ROWS", 0)
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    dealt = OrderTables(spark, SMALL)
    assert io_stats.dedup_io(dealt.output).rdd.getNumPartitions() >= dealt.source("lineitem").count() // 300
    for name, df in plain.items():
        other = getattr(dealt, name)
        assert other.count() == df.count() and df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty()
    assert tables.tasks_of(1200) == 4


def test_column_lineage_is_folded_in_as_many_tasks_as_facts(spark, monkeypatch):
    from spoorline.operators import columns
    from spoorline.sources import tables

    def folded(t):
        return columns.combined(t.column_lineage, t.dataset_column_relation, tasks=t.tasks)

    plain = folded(OrderTables(spark, SMALL))
    monkeypatch.setattr(tables, "WHOLE_ROWS", 0)
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    dealt = OrderTables(spark, SMALL)
    rows = folded(dealt)
    assert rows.rdd.getNumPartitions() == dealt.tasks >= dealt.source("lineitem").count() // 300
    assert rows.count() == plain.count() > 0 and rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()


def test_edges_of_one_level_need_no_window(spark):
    t = OrderTables(spark, SMALL)
    out = lineage.by_runs(t, t.run.select("id"), lineage.BOTH, lineage.OPERATION)
    for rows in (out.merged("inputs"), out.merged("outputs")):
        keys = [c for c in ("operation_id", "run_id", "job_id", "dataset_id", "types") if c in rows.columns]
        assert "Window" not in plan(rows) and rows.count() == rows.select(*keys).distinct().count() > 0


def test_walks_without_sums_hold_the_same_nodes(spark, monkeypatch):
    """What parents and columns are looked up by: the same without the edges' sums, also where many ids are dealt out; a fold by all granularities is not made for them."""
    from spoorline import frames
    from spoorline.sources import tables

    t = OrderTables(spark, SMALL)
    with_sums = lineage.by_operations(t, t.operation.select("id"), lineage.BOTH)
    parents, found = lineage.parent_relations(with_sums, t), lineage.column_lineage(with_sums, t)
    monkeypatch.setattr(tables, "WHOLE_ROWS", 0)
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    monkeypatch.setattr(frames, "MANY_IDS", 0)
    dealt = OrderTables(spark, SMALL)
    out = lineage.by_operations(dealt, dealt.operation.select("id"), lineage.BOTH, sums=False)
    for kind in ("inputs", "outputs"):
        assert [df.columns for df in getattr(out, kind)] == [["operation_id", "dataset_id"]]
        assert getattr(out, kind)[0].rdd.getNumPartitions() == dealt.tasks >= 20
        assert out.datasets(kind).exceptAll(with_sums.datasets(kind)).isEmpty() and out.datasets(kind).count() == with_sums.datasets(kind).count() > 0
        with pytest.raises(ValueError):
            out.merged(kind)
    for want, got in ((parents, lineage.parent_relations(out, dealt)), (found, lineage.column_lineage(out, dealt, dealt.tasks))):
        assert want.count() == got.count() > 0 and want.exceptAll(got).isEmpty()
    assert lineage.parent_relations(out, dealt).collect() == parents.collect()  # sorted


@pytest.mark.parametrize("name", ["by_runs", "by_operations"])
def test_edges_of_many_entities_are_not_stored(spark, monkeypatch, name):
    """They are made of the facts when they are asked for, with the sums that are asked for, and give the same rows, sums, nodes and symlinks."""
    from spoorline import frames
    from spoorline.sources import tables

    def walk(t):
        return lineage.by_runs(t, t.run.select("id"), lineage.BOTH, lineage.OPERATION) if name == "by_runs" else lineage.by_operations(t, t.operation.select("id"), lineage.BOTH)

    few = walk(OrderTables(spark, SMALL))
    want = lineage.relation_rows(few).collect()
    monkeypatch.setattr(tables, "WHOLE_ROWS", 0)
    monkeypatch.setattr(tables, "TASK_ROWS", 300)
    monkeypatch.setattr(frames, "MANY_IDS", 0)
    stored, cut = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: stored.append(df.columns) or cut(df))
    t = OrderTables(spark, SMALL)
    many = walk(t)
    rows = lineage.relation_rows(many)
    assert rows.rdd.getNumPartitions() == -(-t.tasks // lineage.SHARES) > 1
    assert rows.collect() == want and len(want) > 1000 and stored == [["id"]]  # the starts
    text = plan(rows.select("kind", "from_kind", "from_id", "to_kind", "to_id", "num_rows"))
    assert "l_quantity" in text and "l_extendedprice" not in text and "l_partkey" not in text and "Expand" not in text
    for kind in (lineage.DATASET, lineage.JOB, lineage.RUN, lineage.OPERATION):
        assert many.nodes(kind).exceptAll(few.nodes(kind)).isEmpty() and many.nodes(kind).count() == few.nodes(kind).count() > 0
    for kind in ("inputs", "outputs"):
        assert {r.id for r in many.datasets(kind).collect()} == {r.dataset_id for r in few.merged(kind).collect()}
    assert many.all_symlinks().exceptAll(few.all_symlinks()).isEmpty() and many.all_symlinks().count() == few.all_symlinks().count() > 0


@pytest.mark.parametrize("of", ["input", "output"])
def test_sums_in_steps_are_those_of_grouping_sets(spark, of):
    deduped = io_stats.dedup_io(getattr(OrderTables(spark, SMALL), of))
    for granularities in ((lineage.OPERATION, lineage.RUN, lineage.JOB), (lineage.RUN, lineage.JOB), (lineage.JOB,)):
        want, got = io_stats.roll_up_sets(deduped, granularities), io_stats.roll_up_steps(deduped, granularities, 3)
        assert got.dtypes == want.dtypes and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_relation_rows_with_ids_of_two_types(stored):
    run = v7(DAYS[6], 6)
    rows = lineage.relation_rows(lineage.by_runs(stored, [run], lineage.BOTH, lineage.RUN)).collect()
    want = [("INPUT", "DATASET", "6", "JOB", "1"), ("INPUT", "DATASET", "6", "RUN", run), ("OUTPUT", "JOB", "1", "DATASET", "7"), ("OUTPUT", "RUN", run, "DATASET", "7")]
    assert [tuple(r)[:5] for r in rows] == want and [r.num_rows for r in rows] == [2] * 4 and [r.types for r in rows] == [None, None, 1, 1]
