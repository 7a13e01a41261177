"""The store: deltas, compaction, ledger, several writers, location identity."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from test_ingest import APP, SQL, event, events, parent, parsed

from spoorline.operators import merge
from spoorline.operators.components import components
from spoorline.streaming import ingest
from spoorline.streaming.ledger import Ledger
from spoorline.streaming.store import FACTS, KEYS, Store

TABLES = [t for t in (*KEYS, *FACTS) if t not in ("location_external_id", "posting")]


def rows_of(store: Store, name: str) -> list[str]:
    df = store.read(name)
    return [] if df is None else sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect())


def contents(store: Store) -> dict[str, list[str]]:
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(TABLES, pool.map(lambda t: rows_of(store, t), TABLES), strict=True))


def size(path: str) -> int:
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


PLACE = "location_type string, location_name string"
REF = "struct<location_type: string, location_name: string, addresses: array<string>, name: string>"


def ref(name: str, host: str = "nn:9820", kind: str = "hdfs", hosts: list | None = None) -> tuple:
    return kind, host, [f"{kind}://{h}" for h in hosts or [host]], name


def tables(spark, *reads: dict) -> dict:
    """A batch: a row for each read (dataset, at, rows, schema), with the tables that it refers to."""
    datasets = [r["dataset"] for r in reads]
    runs = [(r.get("run", APP), dt.datetime(2024, 3, 11, 14, 20), ref("app", "host", "local"), r.get("status", 0), r.get("external")) for r in reads]
    facts = [(r.get("at", dt.datetime(2024, 3, 11, 14, 30)), SQL, APP, r["dataset"], r.get("schema"), r.get("rows", 5), r.get("bytes")) for r in reads]
    out = {
        "location": spark.createDataFrame([d[:3] for d in datasets], f"{PLACE}, addresses array<string>").groupBy("location_type", "location_name").agg(F.array_distinct(F.flatten(F.collect_set("addresses"))).alias("addresses")),
        "dataset": spark.createDataFrame([(*d[:2], d[3]) for d in datasets], f"{PLACE}, name string").distinct(),
        "run": spark.createDataFrame(runs, f"id string, created_at timestamp, job {REF}, status int, external_id string").groupBy("id", "created_at", "job").agg(F.max("status").alias("status"), F.max("external_id").alias("external_id")),
        "input": spark.createDataFrame(facts, f"created_at timestamp, operation_id string, run_id string, dataset {REF}, schema_digest string, num_rows long, num_bytes long").groupBy("created_at", "operation_id", "run_id", "dataset", "schema_digest").agg(F.max("num_rows").alias("num_rows"), F.max("num_bytes").alias("num_bytes")),
    }
    tags = [(ref("app", "host", "local"), "t", v) for r in reads for v in r.get("tags", ())]
    return out | ({"job_tag_value": spark.createDataFrame(tags, f"job {REF}, tag string, value string")} if tags else {})


def reads(spark, name: str, **told) -> dict:
    return tables(spark, {"dataset": ref(name)} | told)


def test_batches_and_compactions_in_any_mix_give_the_same(spark, tmp_path):
    days = [dt.datetime(2024, 3, d, 10) for d in (11, 12, 13)]
    batches = [
        [{"dataset": ref("/a"), "rows": 5, "status": 0, "external": "x", "tags": ["old", "both"]}, {"dataset": ref("/B"), "at": days[1], "rows": 1}],
        [{"dataset": ref("/b"), "at": days[1], "rows": 7, "status": 1, "tags": ["both", "new"]}, {"dataset": ref("/c"), "at": days[2], "schema": "s"}],
        [{"dataset": ref("/a"), "rows": 3, "bytes": 9, "status": 0}, {"dataset": ref("/c"), "at": days[2], "schema": "s", "rows": 50}],
    ]
    seen = []
    for k, compacted in enumerate(((), (0,), (0, 1, 2))):
        store = Store(spark, f"{tmp_path}/{k}", buckets=3)
        for i, b in enumerate(batches):
            store.add(tables(spark, *b))
            if i in compacted:
                store.compact()
        seen.append(contents(store))
        if 2 in compacted:
            assert all(not t["deltas"] for t in store.ledger.state()[1]["tables"].values())
        store.add(tables(spark, *batches[2]))  # again: nothing new
        assert contents(store) == seen[-1]
    assert all(s == seen[0] for s in seen)
    run, names = json.loads(seen[0]["run"][0]), sorted(json.loads(r)["name"] for r in seen[0]["dataset"])
    assert (run["status"], run["external_id"]) == (1, "x") and names == ["/B", "/a", "/c"]  # the spelling that was met first
    assert sorted((json.loads(r)["num_rows"], json.loads(r)["num_bytes"]) for r in seen[0]["input"] if "/a" in r) == [(5, 9)]
    assert sorted(json.loads(r)["value"] for r in seen[0]["job_tag_value"]) == ["both", "new"]


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.add(tables(spark, *({"dataset": ref(f"/data/{i}")} for i in range(20_000))))
    store.compact()
    large = size(f"{tmp_path}/store")
    files = set(glob.glob(f"{tmp_path}/store/**/*.parquet", recursive=True))
    store.add(reads(spark, "/data/7", rows=9))
    new = set(glob.glob(f"{tmp_path}/store/**/*.parquet", recursive=True)) - files
    assert new and all("/delta/" in f for f in new) and sum(map(os.path.getsize, new)) < large / 10
    assert store.read("input").count() == 20_000 and store.read("input").where("num_rows = 9").count() == 1
    store.add(reads(spark, "/data/8", at=dt.datetime(2024, 3, 12, 14)))
    store.compact(["input"])
    assert set(store.ledger.state()[1]["tables"]["input"]["base"]) == {"2024-03-11", "2024-03-12"} and store.read("input").count() == 20_001
    assert store.vacuum(keep=1, older_than=-10) > 0 and store.read("input").count() == 20_001 and len(rows_of(store, "dataset")) == 20_000


def test_only_days_that_a_delta_touches_are_written_again(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.add(tables(spark, {"dataset": ref("/a")}, {"dataset": ref("/a"), "at": dt.datetime(2024, 3, 14, 9)}))
    store.compact()
    before = store.ledger.state()[1]["tables"]["input"]["base"]
    store.add(reads(spark, "/b"))
    store.compact()
    after = store.ledger.state()[1]["tables"]["input"]["base"]
    assert after["2024-03-14"] == before["2024-03-14"] and after["2024-03-11"] != before["2024-03-11"]
    store.add(reads(spark, "/a", rows=50))
    df = store.read("input").where("created_date = date'2024-03-14'")
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "created_date" in plan.split("PartitionFilters")[1]


def test_a_stream_batch_that_comes_again_is_added_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    version = store.add(reads(spark, "/a"), batch=("s", 0))
    assert store.add(reads(spark, "/a"), batch=("s", 0)) == version == store.version()
    assert store.save(None, batch=("s", 0)) == version  # told before anything is made of it
    assert store.add(reads(spark, "/b"), batch=("s", 1)) == version + 1
    assert store.read("dataset").count() == 2 and store.read("dataset", version).count() == 1  # as it stood


def test_a_batch_that_dies_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/store")
    store.add(reads(spark, "/a"))
    before, version = contents(store), store.version()
    written = store._write_delta

    def dies(name, rows):
        if name == "input":
            raise OSError("gone")
        return written(name, rows)

    monkeypatch.setattr(store, "_write_delta", dies)
    with pytest.raises(OSError, match="gone"):
        store.add(reads(spark, "/b"))
    monkeypatch.undo()
    assert contents(store) == before and store.version() == version
    store.add(reads(spark, "/b"))
    assert store.read("dataset").count() == 2


def test_two_stores_at_once_lose_and_double_nothing(spark, tmp_path):
    path, failed = f"{tmp_path}/store", []

    def write(names):
        try:
            store = Store(spark, path)
            for n in names:
                store.add(reads(spark, n))
        except Exception as e:  # noqa: BLE001  told by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=([f"/{k}/{i}" for i in range(3)] + ["/both"],)) for k in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    store = Store(spark, path)
    assert store.version() == 8 and store.read("dataset").count() == 7 and store.read("run").count() == 1 and store.read("input").count() == 7


def test_the_ledger_tries_again_on_top_of_another_writer(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.state() == (0, {}) and ledger.add(1, {"n": 1}) and not ledger.add(1, {"n": 2})
    seen = []

    def decide(state):
        seen.append(state["n"])
        if len(seen) == 1:
            assert ledger.add(2, {"n": 10})
        return {"n": state["n"] + 1}

    assert ledger.change(decide) == 3 and seen == [1, 10] and ledger.state() == (3, {"n": 11})
    ledger.prune(1)
    assert ledger.state() == (3, {"n": 11}) and ledger.change(lambda s: None) == 3


def test_compaction_and_a_batch_at_once(spark, tmp_path, monkeypatch):
    store = Store(spark, f"{tmp_path}/store")
    store.add(reads(spark, "/a"))
    folded, other = store._folded, Store(spark, f"{tmp_path}/store")

    def meanwhile(name, table):
        out = folded(name, table)
        if name == "dataset":
            other.add(reads(spark, "/b"))
            other.compact(["input"])
        return out

    monkeypatch.setattr(store, "_folded", meanwhile)
    store.compact()
    assert store.read("dataset").count() == 2 and store.read("input").count() == 2 and store.read("run").count() == 1


def test_components_are_those_of_a_plain_search(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (8, 6), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 9} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_locations_that_share_addresses_by_way_of_others_are_one(spark):
    rows = [("kafka", "c", ["1", "2"], False), ("kafka", "b", ["2", "3"], True), ("kafka", "a", ["3"], False), ("kafka", "z", ["9"], False), ("hdfs", "y", ["1"], False), ("hdfs", "x", None, False), ("kafka", "d", ["8", None], False), ("kafka", "d", ["9"], True)]
    df = spark.createDataFrame(rows, "location_type string, location_name string, addresses array<string>, stored boolean")
    got = {(r[0], r[1]): r[2] for r in merge.location_groups(df).collect()}
    assert got == {("kafka", "c"): "b", ("kafka", "b"): "b", ("kafka", "a"): "b", ("kafka", "z"): "d", ("kafka", "d"): "d", ("hdfs", "y"): "y", ("hdfs", "x"): "x"}
    links = spark.createDataFrame([("hdfs", "x", "y")], "location_type string, location_name string, stands_for string")
    assert {r[2] for r in merge.location_groups(df, links).where("location_type = 'hdfs'").collect()} == {"x"}


def test_the_store_knows_locations_by_their_addresses(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    at = lambda hosts, name: tables(spark, {"dataset": ref(name, hosts[0], "kafka", hosts)})
    kafka = lambda: {r.location_name for r in store.read("location").where("location_type = 'kafka'").collect()}
    store.add(at(["k1:1", "k2:1"], "t"))
    store.add(at(["k9:1", "k8:1"], "t"))
    assert kafka() == {"k1:1", "k9:1"} and store.read("dataset").count() == 2
    store.add(at(["k2:1"], "t"))  # one of the first one's addresses
    assert kafka() == {"k1:1", "k9:1"} and store.read("dataset").count() == 2
    assert {r.dataset.location_name for r in store.read("input").collect()} == {"k1:1", "k9:1"} and len({r.dataset.location_name for r in store.read("input").collect()}) == 2
    store.add(at(["k3:1", "k2:1", "k8:1"], "u"))  # joins both
    places = store.read("location").collect()
    assert [r.location_name for r in places] == ["k1:1"] and set(places[0].addresses) >= {"kafka://k9:1", "kafka://k3:1"}
    assert sorted(r.name for r in store.read("dataset").collect()) == ["t", "u"]
    before = rows_of(store, "input"), rows_of(store, "dataset"), rows_of(store, "location")
    store.compact()
    assert before == (rows_of(store, "input"), rows_of(store, "dataset"), rows_of(store, "location"))


def test_external_ids_are_stored(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.add(reads(spark, "/a"))
    with pytest.raises(KeyError):
        store.set_external_id("hdfs", "nowhere", "x")
    for value in ("one", "two"):
        store.set_external_id("hdfs", "nn:9820", value)
    store.compact()
    assert [tuple(r) for r in store.external_ids().collect()] == [("hdfs", "nn:9820", "two")]
    store.set_external_id("hdfs", "nn:9820", None)
    assert store.external_ids().count() == 0


def test_dead_letters_keep_all_that_they_came_with(spark, tmp_path):
    good = json.dumps(events()[0])
    late = json.dumps({**events()[0], "eventType": "LATER"})
    bad = [(b"abc", b'{"not": "valid event"}', [("cde", b"efg"), ("cde", b"h")], 7), (None, late.encode(), None, 8), (b"k", good.encode(), None, 9), (b"n", None, [], 10)]
    raw = spark.createDataFrame(bad, "key binary, value binary, headers array<struct<key: string, value: binary>>, offset long").selectExpr("*", "'t' AS topic", "0 AS partition", "timestamp'2024-01-01 00:00:00' AS timestamp")
    raw.write.parquet(f"{tmp_path}/in")
    told = []
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    query = ingest.start(stream, lambda events, batch: told.append((events.count(), batch)), f"{tmp_path}/checkpoint", dead_letters=f"{tmp_path}/dead", available_now=True, name="s", publish=lambda df: told.append(df.count()))
    query.awaitTermination(120)
    assert query.exception() is None and told == [(1, ("s", 0)), 3]
    got = {r.reply_to: r for r in spark.read.parquet(f"{tmp_path}/dead").collect()}
    first = got["t/0/7"]
    assert bytes(first.key) == b"abc" and bytes(first.value) == b'{"not": "valid event"}' and [(h.key, bytes(h.value)) for h in first.headers] == [("cde", b"efg"), ("cde", b"h")]
    assert first.correlation_id == "s-0" and first.timestamp is not None and first.reason == "not a run event"
    assert got["t/0/8"].reason == "unknown event type LATER" and got["t/0/10"].value is None and len(got) == 3


def test_events_of_one_application_lie_together(spark):
    rows = [event("START", SQL, "a.b", facets=parent(APP, "app")), event("START", APP, "app"), event("START", SQL, "other")]
    dealt = ingest.by_application(parsed(spark, rows)[0], 4)
    got = dealt.select(ingest.partition_key().alias("k"), F.spark_partition_id().alias("p")).distinct().collect()
    assert len(got) == 2 and len({r.k for r in got}) == 2


def test_searches_read_the_postings_of_their_words(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", buckets=8)
    assert store.search("dataset", "orders") is None
    store.add(tables(spark, *({"dataset": ref(n)} for n in ("/data/orders", "/data/orders_old", "/other/customers.parquet"))))
    store.compact()
    store.add(reads(spark, "/data/Orders/day"))

    def names(kind, text):
        return {r.name: r.search_rank for r in store.search(kind, text).collect()}

    got = names("dataset", "orders")
    assert set(got) == {"/data/orders", "/data/orders_old", "/data/Orders/day"} and got["/data/orders"] == max(got.values())
    assert set(names("dataset", "customers.par")) == {"/other/customers.parquet"} and names("dataset", "nothing") == {} and set(names("dataset", "data ORD")) == set(got)
    assert {r.location_name for r in store.search("location", "nn:98").collect()} == {"nn:9820"}
    found = store.search("dataset", "orders")
    assert found.inputFiles() and all("/posting/" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("PushedFilters: ", 1) for x in plan.split("PartitionFilters: ")[1:]]
    assert any("_bucket" in parts for parts, _ in scans), plan
    assert all("token" in pushed.split("ReadSchema")[0] for _, pushed in scans), plan
    before = got
    store.compact()
    assert names("dataset", "orders") == before
