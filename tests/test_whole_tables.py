"""Queries over whole tables against brute force over the files."""

import pandas as pd

from spoorline.plans import queries  # noqa: F401  registers the queries
from spoorline.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def lines():
    item, orders = pd.read_parquet(f"{SMALL}/lineitem.parquet"), pd.read_parquet(f"{SMALL}/orders.parquet")
    return item.merge(orders, left_on="l_orderkey", right_on="o_orderkey")


def test_ingest_makes_events_of_all_line_items(spark):
    e = lines()
    e["name"] = [f"db.s{s}" if s % 2 == 0 else f"/data/s{s}" for s in e["l_suppkey"]]
    assert (e["l_linenumber"] > 3).mean() > 0.3
    for side, part in (("inputs", e[e["l_returnflag"] == "R"]), ("outputs", e[e["l_returnflag"] != "R"])):
        kept = part.groupby(["name", "l_orderkey", "l_linenumber"])["l_quantity"].max().astype("int64").reset_index()
        want = {n: (len(g), int(g["l_quantity"].sum())) for n, g in kept.groupby("name")}
        assert {r["name"]: (r.n, r.num_rows) for r in QUERIES[f"ingest_{side}"](spark, SMALL).collect()} == want
    ops = {(f"app-{c}", o, n % 2) for c, o, n in zip(e["o_custkey"], e["l_orderkey"], e["l_linenumber"], strict=True)}
    assert sum(r.n for r in QUERIES["ingest_operations"](spark, SMALL).collect()) == len(ops)
    assert {r["name"] for r in QUERIES["ingest_jobs"](spark, SMALL).collect()} == {a for a, _, _ in ops}
    want = set(e["name"]) | {f"/data/s{s}" for s in e["l_suppkey"]}
    assert {r["name"] for r in QUERIES["ingest_datasets"](spark, SMALL).collect()} == want


def test_lineage_starts_from_all_entities(spark):
    e = lines()
    e["op"] = e["l_orderkey"] * 2 + e["l_linenumber"] % 2
    reads, writes = e[e["l_returnflag"] == "R"], e[e["l_returnflag"] != "R"]
    want = {("INPUT", str(d), kind, str(i)) for kind, c in (("OPERATION", "op"), ("RUN", "l_orderkey"), ("JOB", "o_custkey")) for d, i in zip(reads["l_suppkey"], reads[c], strict=True)}
    want |= {("OUTPUT", str(i), kind, str(d)) for kind, c in (("OPERATION", "op"), ("RUN", "l_orderkey"), ("JOB", "o_custkey")) for d, i in zip(writes["l_suppkey"], writes[c], strict=True)}
    for name in ("lineage_run", "lineage_operation"):
        got = {(r.kind, r.from_id, r.to_kind if r.kind == "INPUT" else r.from_kind, r.to_id) for r in QUERIES[name](spark, SMALL).collect()}
        assert got == want, name
    parents = QUERIES["lineage_parent_relations"](spark, SMALL).collect()
    assert len(parents) == e["op"].nunique() + e["l_orderkey"].nunique()


def test_column_lineage_of_all_pairs_and_jobs(spark):
    e, part = lines(), pd.read_parquet(f"{SMALL}/part.parquet")
    e["op"] = e["l_orderkey"] * 2 + e["l_linenumber"] % 2
    both = e[e["l_returnflag"] == "R"].merge(e[e["l_returnflag"] != "R"], on="op", suffixes=("", "_to")).merge(part, left_on="l_partkey", right_on="p_partkey")
    target = [t if s % 3 else None for t, s in zip(both["p_type"], both["p_size"], strict=True)]
    want = set(zip(both["l_suppkey"], both["l_suppkey_to"], both["p_brand"], target, strict=True))
    for name in ("column_lineage_pairs", "column_lineage_by_job"):
        assert {tuple(r)[:4] for r in QUERIES[name](spark, SMALL).collect()} == want, name


def test_union_of_whole_tables(spark):
    n = sum(len(pd.read_parquet(f"{SMALL}/{t}.parquet")) for t in ("supplier", "customer"))
    assert QUERIES["union_pages"](spark, SMALL).count() == n
