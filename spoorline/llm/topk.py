"""Exact top-k search by inner product: a uniform threshold in three phases.

The dimensions are cut into ``LISTS`` blocks. For a query, a block gives every vector a partial score, and the vectors of
a task in the order of that score are one of its local lists; the score is the sum over the blocks.

1. Gather. Every task takes the first k of each of its local lists and tells the best k whole scores among them.
2. Cutoff. Of what all tasks told the k-th best score is a cutoff: k vectors reach it, so none below it can be among the
   best k. It is sent to the tasks. A score of at least the cutoff has some block with at least cutoff / ``LISTS``, the
   uniform threshold, so the entries of the local lists above it are sufficient.
3. Resolve. Only for those entries the other blocks' scores are added; whole scores that reach the cutoff are told,
   at most k for a query and batch, in the order of the result, and ranked over all tasks.

Equal vectors are one entry before anything is compared, with the k + 1 smallest ids it can give to a result: a vector
that a third of all rows share costs what one costs. Queries go in passes of ``PASS_BYTES``, each over all vectors,
so what is sent to the tasks is bounded; a pass does thousands of multiplications for each number it reads.
Scores are whole numbers: single or double precision where every sum is exact there, else Python's whole numbers.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, shared_dir

LISTS = 2
#: Bytes of query vectors in a pass, queries of a block, and vectors that are compared with a block at a time.
PASS_BYTES, QUERIES, VECTORS = 8 << 20, 512, 2048
_LEAST = -(1 << 62)


def vectors_of(table: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, x): floor(scale * component) of every vector without nulls and non-finite components."""
    finite = ~F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * scale))
    return table.where(F.col(vector_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(x, ids): one row for each distinct vector, with its k + 1 smallest ids in order, a repeated id as often as it is there, nulls last."""
    first = W.partitionBy("x").orderBy(F.asc_nulls_last("id"))
    kept = vectors.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)  # cut down in each task before the exchange
    return kept.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("ids")).select("x", F.transform("ids", lambda i: i["id"]).alias("ids"))


def _dense(vectors: list, width: int) -> np.ndarray:
    """Rows of whole numbers of one width; shorter ones are filled up with zeros."""
    if all(len(v) == width for v in vectors):
        return np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _exact(most: float):
    """The type that holds every sum of size ``most`` exactly."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def partials(v: np.ndarray, q: np.ndarray, lists: int) -> list[np.ndarray]:
    """The partial scores (query by vector) of each block of dimensions."""
    width = max(v.shape[1], q.shape[1])
    size = float(np.abs(v.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(width, 1)
    kind = _exact(size)
    edges = np.linspace(0, min(v.shape[1], q.shape[1]), lists + 1).astype(int)
    v, q = v.astype(kind), q.astype(kind)
    return [q[:, a:b] @ v[:, a:b].T if b > a else np.zeros((len(q), len(v)), dtype=kind) for a, b in zip(edges, edges[1:], strict=False)]


def best_scores(parts: list[np.ndarray], times: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: (query, k) whole scores, descending, of the vectors that lead a local list; ``times`` (query by vector) is how many rows a vector stands for."""
    total = functools.reduce(np.add, parts)
    n = total.shape[1]
    if n > k + 1:
        lead = np.concatenate([np.argpartition(p, n - k - 1, axis=1)[:, n - k - 1 :] if p.dtype != object else np.argsort(p, axis=1, kind="stable")[:, n - k - 1 :] for p in parts], axis=1)
        lead.sort(axis=1)
        again = np.zeros(lead.shape, dtype=bool)
        again[:, 1:] = lead[:, 1:] == lead[:, :-1]
    else:
        lead, again = np.tile(np.arange(n), (len(total), 1)), np.zeros((len(total), n), dtype=bool)
    score = np.take_along_axis(total, lead, axis=1).clip(_LEAST + 1, -_LEAST).astype(np.int64)
    count = np.where(again, 0, np.take_along_axis(times, lead, axis=1))
    order = np.argsort(-score, axis=1, kind="stable")
    score, ends = np.take_along_axis(score, order, axis=1), np.take_along_axis(count, order, axis=1).cumsum(axis=1)
    out = np.full((len(total), k), _LEAST, dtype=np.int64)
    for j in range(k):
        at = (ends <= j).sum(axis=1)
        have = at < score.shape[1]
        out[have, j] = score[have, at[have]]
    return out


def sufficient(parts: list[np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, vector, score) of the pairs that reach the cutoff of their query."""
    least = np.ceil(cutoff.astype(np.float64) / len(parts) - 1e-6 * np.abs(cutoff)) if parts[0].dtype != object else np.array([-(-c // len(parts)) for c in cutoff.tolist()], dtype=object)
    above = functools.reduce(np.logical_or, (p >= least[:, None] for p in parts))
    q, v = np.nonzero(above)
    score = functools.reduce(np.add, (p[q, v] for p in parts))
    reach = score >= cutoff[q]
    return q[reach], v[reach], score[reach].clip(_LEAST + 1, -_LEAST).astype(np.int64)


def _order(id: np.ndarray, gone: np.ndarray, score: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order of the result: by query, score descending, id ascending, nulls last; the place within the query of what stands there)."""
    order = np.lexsort((id, gone, -score, q))
    first = np.searchsorted(q[order], q[order], side="left")
    return order, np.arange(len(order)) - first


def search(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(query_id, rank, <id>, score): for every row for which ``queries`` holds its k best other rows, all if there are fewer.

    Ties go to the smaller id. Defined cases: rows whose vector is null or holds null or non-finite components take no
    part; a row that is a candidate under a null id comes after all others of its score; a repeated row is a query and
    a candidate as often as it is there; vectors of several lengths are compared over the dimensions that both have; an
    empty vector has score 0; scores beyond 2^62 are told as 2^62; an empty table or no query gives an empty result;
    other columns are neither read nor kept.
    """
    spark = table.sparkSession
    rows = vectors_of(table, id_col, vector_col)
    asked = cut(vectors_of(table.where(queries), id_col, vector_col).where("id is not null").groupBy("id", "x").agg(F.count("*").alias("times")))
    out_type = f"query_id long, rank int, {id_col} long, score long"
    n, widest = asked.agg(F.count("*"), F.max(F.size("x"))).head()
    if not n:
        return spark.createDataFrame([], out_type)
    classes = cut(classes_of(rows, k))
    passes = -(-n * (8 * max(widest, 1) + 40) // pass_bytes)
    folder = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}"
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(passes)) == i) if passes > 1 else asked
        found = _one_pass(classes, part.orderBy("id", "x").collect(), k, lists)  # some PASS_BYTES
        found.write.mode("overwrite").parquet(f"{folder}/{i}")
    got = spark.read.parquet(*(f"{folder}/{i}" for i in range(passes)))
    return got.select("query_id", "rank", F.col("vec_id").alias(id_col), "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_again")).drop("_again")


def _one_pass(classes: DataFrame, asked: list, k: int, lists: int) -> DataFrame:
    """(query_id, rank, vec_id, score, times) for the queries given."""
    spark = classes.sparkSession
    width = max((len(r["x"]) for r in asked), default=0)
    x = _dense([r["x"] for r in asked], width)
    ids, times = np.array([r["id"] for r in asked], dtype=np.int64), [int(r["times"]) for r in asked]
    own: dict[bytes, list[int]] = {}
    for i, r in enumerate(asked):
        own.setdefault(np.array(r["x"], dtype=np.int64).tobytes(), []).append(i)
    blocks = range(0, len(asked), QUERIES)

    def batches_of(batches):
        """(vectors, their ids as lists, (query, vector) where a query's own vector stands) of some rows."""
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTORS):
                part = batch.slice(lo, VECTORS)
                listed = part.column(0)
                offsets = listed.offsets.to_numpy()
                values = listed.values.to_numpy(zero_copy_only=False)
                vs = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                if not vs:
                    continue
                mine = [(q, i) for i, v in enumerate(vs) for q in own.get(v.astype(np.int64).tobytes(), ())]
                yield _dense(vs, max(map(len, vs))), part.column(1).to_pylist(), np.array(mine, dtype=np.int64).reshape(-1, 2)

    def gather(batches):
        best = np.full((len(asked), k), _LEAST, dtype=np.int64)
        seen = False
        for v, held, mine in batches_of(batches):
            seen = True
            count = np.minimum(np.array([len(h) for h in held]), k + 1)
            for lo in blocks:
                here = mine[(mine[:, 0] >= lo) & (mine[:, 0] < lo + QUERIES)]
                many = np.tile(count, (len(x[lo : lo + QUERIES]), 1))
                np.subtract.at(many, (here[:, 0] - lo, here[:, 1]), 1)
                told = best_scores(partials(v, x[lo : lo + QUERIES], lists), many, k)
                both = np.concatenate([best[lo : lo + QUERIES], told], axis=1)
                best[lo : lo + QUERIES] = -np.sort(-both, axis=1)[:, :k]
        if seen:
            for lo in blocks:
                yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([best[lo : lo + QUERIES].tobytes()], pa.binary())], names=["block", "scores"])

    def merge(batches):
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                told = np.frombuffer(data, dtype=np.int64).reshape(-1, k)
                both = np.concatenate([best[lo], told], axis=1) if lo in best else told
                best[lo] = -np.sort(-both, axis=1)[:, :k]
        for lo, scores in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([scores[:, k - 1].tobytes()], pa.binary())], names=["block", "scores"])

    told = classes.mapInArrow(gather, "block int, scores binary").repartition("block").mapInArrow(merge, "block int, scores binary")
    cutoff = np.full(len(asked), _LEAST, dtype=np.int64)
    for r in told.collect():  # 8 bytes a query
        scores = np.frombuffer(r["scores"], dtype=np.int64)
        cutoff[r["block"] : r["block"] + len(scores)] = scores

    def collect(batches):
        for v, held, mine in batches_of(batches):
            count = np.array([len(h) for h in held])
            start = np.cumsum(count) - count
            flat = [i for h in held for i in h]
            gone = np.array([i is None for i in flat], dtype=bool)
            flat = np.array([0 if i is None else i for i in flat], dtype=np.int64)
            self_at = set(map(tuple, mine.tolist()))
            for lo in blocks:
                q, at, score = sufficient(partials(v, x[lo : lo + QUERIES], lists), cutoff[lo : lo + QUERIES])
                # of many entries of one query the first k + 1 by score and least id hold its first k rows
                order, place = _order(flat[start[at]], gone[start[at]], score, q)
                order = order[place <= k]
                q, at, score = q[order], at[order], score[order]
                n = count[at]
                row = np.repeat(start[at], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                mine_too = np.array([(lo + a, b) in self_at for a, b in zip(q.tolist(), at.tolist(), strict=True)], dtype=bool)
                q, score, mine_too, at = np.repeat(q, n), np.repeat(score, n), np.repeat(mine_too, n), np.repeat(at, n)
                # a row is no candidate of its own: once, where a query's id stands among its vector's ids
                same = mine_too & (flat[row] == ids[lo + q]) & ~gone[row] if len(q) else np.zeros(0, dtype=bool)
                hit = np.flatnonzero(same)
                if len(hit):
                    _, once = np.unique(q[hit], return_index=True)
                    keep = np.ones(len(q), dtype=bool)
                    keep[hit[once]] = False
                    q, score, row = q[keep], score[keep], row[keep]
                order, place = _order(flat[row], gone[row], score, q)
                order = order[place < k]
                q, score, row = q[order], score[order], row[order]
                yield pa.RecordBatch.from_arrays([pa.array(lo + q, pa.int32()), pa.array(flat[row], pa.int64(), mask=gone[row]), pa.array(score, pa.int64())], names=["q", "vec_id", "score"])

    found = classes.mapInArrow(collect, "q int, vec_id long, score long")
    by_query = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(asked), dtype=np.int32), "query_id": ids, "times": np.array(times, dtype=np.int32)}))
    return found.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score", "times")
