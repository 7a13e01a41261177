"""Overlapping periods, usage by day, runs in stream state, producers that a user adds: each against plain Python or the batch form."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_ingest import APP, INNER, OTHER, event, parsed

from spoorline.operators import analytics, extract, merge, ranges
from spoorline.streaming import runs

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("base", [ranges.BASE, 1_000_000])
def test_overlaps_are_those_of_all_pairs(spark, base):
    rnd = random.Random(6)
    lengths = [0, 1, 60, 3600, 3601, 86400 * 9, 86400 * 4000]

    def period(i):
        s = START + dt.timedelta(seconds=rnd.randrange(0, 86400 * 40, 30))
        e = s + dt.timedelta(seconds=rnd.choice(lengths) * rnd.choice([1, 1, 1, -1]))
        return i, rnd.choice([1, 2, None]), rnd.choice([s, s, s, None]), rnd.choice([e, e, e, None])

    a, b = [period(i) for i in range(120)], [period(i) for i in range(120)]
    a.append(a[0])
    frames = [spark.createDataFrame(x, "n int, k int, since timestamp, until timestamp") for x in (a, b)]
    got = sorted((r.a_n, r.b_n) for r in ranges.overlaps(*frames, ["k"], base=base).collect())
    low, high = dt.datetime(1, 1, 1), dt.datetime(9999, 1, 1)
    want = sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] is not None and x[1] == y[1] and (x[2] or low) < (y[3] or high) and (y[2] or low) < (x[3] or high))
    assert got == want and len(got) > 500
    assert ranges.overlaps(frames[0].limit(0), frames[1], ["k"]).count() == 0


def test_a_period_takes_a_few_rows_however_long(spark):
    df = spark.createDataFrame([(1, START, START + dt.timedelta(days=20_000)), (1, START, START + dt.timedelta(seconds=1)), (1, None, None)], "k int, since timestamp, until timestamp")
    placed = ranges._placed(df, "a", ["k"], "since", "until", ranges.BASE)
    assert placed.count() <= 3 * 2 * ranges.levels_of(ranges.BASE)


def test_overlaps_are_not_broadcast_and_visit_levels_in_use_only(spark):
    days = [(1, START + dt.timedelta(days=i), START + dt.timedelta(days=i + 1)) for i in range(50)]
    df = spark.createDataFrame(days, "k int, since timestamp, until timestamp")
    met = ranges.overlaps(df, df, ["k"])
    assert met.count() == 50
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    homes = ranges._levelled(df, "b", ["k"], "since", "until", ranges.BASE).select(F.bit_or(F.expr("shiftleft(1, _own)"))).scalar()
    assert ranges._placed(df, "a", ["k"], "since", "until", ranges.BASE, homes).select("_level").distinct().count() == 1


def test_usage_of_days_is_usage(spark, tmp_path):
    rnd = random.Random(7)
    now = dt.datetime(2024, 3, 20, 13, 30)
    facts = [(now - dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 40)), f"r{rnd.randrange(30)}", rnd.randrange(5), rnd.choice([None, 3]), 1, 2) for _ in range(800)]
    io = spark.createDataFrame(facts, "created_at timestamp, run_id string, dataset_id long, num_bytes long, num_rows long, num_files long").withColumn("created_date", F.to_date("created_at"))
    all_runs = spark.createDataFrame([(f"r{i}", i % 4) for i in range(28)], "id string, started_by_user_id int")
    users = spark.createDataFrame([(i, f"u{i}") for i in range(3)], "id int, name string")
    datasets = spark.createDataFrame([(i, f"d{i}", i) for i in range(5)], "id long, name string, location_id long")
    places = spark.createDataFrame([(i, f"l{i}", "t") for i in range(4)], "id long, name string, type string")
    path = f"file://{tmp_path}/sums"
    old = io.where("created_date < date'2024-03-20'")
    analytics.refresh_days(old.union(old), all_runs, path)  # what was there before a day is told again
    analytics.refresh_days(io, all_runs, path, sorted({r[0] for r in io.select("created_date").distinct().collect()}))
    files = {f for f in spark.read.parquet(path).inputFiles() if "day=2024-03-19" in f}
    analytics.refresh_days(io, all_runs, path, [dt.date(2024, 3, 20)])
    assert {f for f in spark.read.parquet(path).inputFiles() if "day=2024-03-19" in f} == files
    for depth in analytics.DEPTHS:
        want = analytics.usage(io, all_runs, users, datasets, places, depth, now)
        got = analytics.usage_of_days(spark.read.parquet(path), io, all_runs, users, datasets, places, depth, now).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 3


@pytest.mark.parametrize("order", [1, -1])
def test_runs_in_stream_state_are_those_of_a_batch(spark, tmp_path, order):
    rnd = random.Random(8)
    kinds = ["START", "RUNNING", "COMPLETE", "FAIL", "OTHER", "running"]
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice(kinds), START + dt.timedelta(microseconds=rnd.randrange(10**12))) for _ in range(60)][::order]
    schema = "run string, type string, at timestamp"
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    folded = runs.fold(stream, "run", "type", "at")
    told: dict = {}

    def save(df, number):
        told.update({r.key: r for r in df.collect()})

    query = folded.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    want = merge.fold_statuses(spark.createDataFrame(rows, schema).where("run is not null"), "run", F.col("type"), "at").collect()
    assert {(r.key, r.status, r.started_at, r.ended_at) for r in told.values()} == {(r.run, r.status, r.started_at, r.ended_at) for r in want} and len(want) == 3


def test_a_producer_that_a_user_adds(spark):
    rules = extract.Integration(
        "ARGO", match=lambda: F.col("job.namespace").startswith("argo://"), operation=lambda: F.size("inputs") > 0,
        runs={"external_id": lambda: F.concat(F.lit("argo-"), F.col("job.name")), "user": lambda: F.lit("robot")},
        operations={"name": lambda: F.upper("job.name"), "group": lambda: F.lit("steps")}, output_type=lambda d: F.lit(4),
    )
    data = {"namespace": "hdfs://nn:9820", "name": "/x"}
    rows = [event("COMPLETE", APP, "flow", "argo://host", job={}, inputs=[data], outputs=[data]), event("START", OTHER, "idle", "argo://host", job={}), event("START", INNER, "thing", job={}, inputs=[data])]
    try:
        extract.register(rules)
        e = parsed(spark, rows)[0]
        found = {r.id: r for r in extract.merged_runs(e).collect()}
        assert (found[APP].external_id, found[APP].user) == ("argo-flow", "robot") and found[OTHER].external_id == "argo-idle" and found[INNER].external_id is None
        ops = {r.id: r for r in extract.merged_operations(e).collect()}
        assert set(ops) == {APP, INNER} and (ops[APP].name, ops[APP].group, ops[APP].description) == ("FLOW", "steps", None) and ops[INNER].name == "thing"
        assert [r.type for r in extract.io(e, "outputs").collect()] == [4]
    finally:
        extract.unregister("ARGO")
    assert {r.integration for r in extract.classified(parsed(spark, rows)[0]).collect()} == {extract.OTHER}
    with pytest.raises(ValueError, match="own rules"):
        extract.register(extract.Integration(extract.SPARK, match=lambda: F.lit(True)))
    with pytest.raises(ValueError, match="no columns"):
        extract.register(extract.Integration("X", match=lambda: F.lit(True), runs={"colour": lambda: F.lit(1)}))
    assert extract.SPARK not in extract._ADDED


def test_day_sums_are_dealt_to_the_tasks_asked_for(spark):
    at = dt.datetime(2024, 3, 20, 12)
    facts = spark.createDataFrame([(at, i, i % 5, 1, 2, 3) for i in range(100)], "created_at timestamp, run_id long, dataset_id long, num_bytes long, num_rows long, num_files long")
    runs = spark.range(100).select("id", (F.col("id") % 3).alias("started_by_user_id"))
    dealt = analytics.day_sums(facts, runs, tasks=7)
    assert dealt.rdd.getNumPartitions() == 7
    assert sorted(dealt.collect()) == sorted(analytics.day_sums(facts, runs).collect()) and dealt.count() == 15
