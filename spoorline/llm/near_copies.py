"""Near copies by exact similarity of shingle sets, for the stage that keeps one document of each group.

A SimHash distance bounds no similarity: of pairs of Jaccard similarity 0.8 the 64 bits differ in 10 places on
average and in any number at worst, so no radius that can be searched finds all of them. The fingerprint here is
therefore the odd sketch of the set: 512 bits in a ring of eight segments, bit b being the parity of the number of
shingles whose hash falls on b. Its Hamming distance is never above the symmetric difference, which a similarity t
bounds by D = (1 - t) / (1 + t) * (|A| + |B|); so the pigeonring chains of SimHash apply with D as the radius:
some segment differs in at most D / 8 bits, it and the next one in at most 2 D / 8, and the whole in at most D.
What is left is compared once more by odd sketches of two bits a shingle, then set by set. No pair of similarity t is lost on the way:

1. Keys. Two such sets share one of the first |A| - ceil(t |A|) + 1 shingles of each in any common order. Shingles
   that many documents have come last in the order, so keys are rare ones. How many have a shingle is read from
   counts of all documents by hash cell; a count too low or too high changes the order only, never the result.
2. Stars. In each group of sets that share a key a few are compared with all others, which gives most links at a cost
   that grows with the groups and not with their squares. A few rounds, each over the groups not yet of one component.
3. The rest. Of groups that still hold several components all pairs between different components are compared, so
   what the stars did not decide is decided exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..operators.components import components
from .common import cut, let, map_beside, released, small_batches, small_side

CELLS = 20  # bits of a hash that choose its cell
#: Cells that are told to the tasks as crowded, those with the largest counts; others count as rare.
CROWDED = 1 << 14
SEGMENTS = 8
#: Rounds of stars, and stars of a group in each.
ROUNDS, HUBS = 1, 6
#: A group that has at least this part (1 / HOT_SHARE) of all rows is not dealt out by group: its first row is sent to the tasks.
HOT_SHARE = 4096

_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``k`` words, ASCII letters lower-cased; fewer words are one shingle, no words none."""
    words = (text or b"").lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), k)] * bool(words), dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    s = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        s ^= s >> np.uint64(29)
        s *= _MIX
        s += h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= _END
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS)).astype(np.int64)


def _class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def sketch(s: np.ndarray, bits: int = 64 * SEGMENTS) -> np.ndarray:
    """The odd sketch of ``bits`` (a power of two) as signed longs. Its halves, taken together by exclusive or, are the sketch of half the bits."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """The odd sketch of at least two bits a shingle, for the comparison just before that of whole sets."""
    return sketch(s, max(64 * SEGMENTS, 1 << (2 * len(s) - 1).bit_length()))


def crowded_cells(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of the crowded cells, zero elsewhere. Every task adds up its own documents and tells the cells that stand out there."""

    def run(batches):
        seen, total, waiting, held = np.zeros(1 << CELLS, dtype=np.int64), 0, [], 0
        for pdf in batches:
            for t in pdf["t"]:
                waiting.append(shingle_set(t, k))
                held += len(waiting[-1])
                if held > 1 << 20:
                    seen += np.bincount(_cells(np.concatenate(waiting)), minlength=1 << CELLS)
                    total, waiting, held = total + held, [], 0
        if waiting:
            seen += np.bincount(_cells(np.concatenate(waiting)), minlength=1 << CELLS)
        usual = (total + held) / (1 << CELLS)
        at = np.flatnonzero(seen >= usual + 3 * math.sqrt(usual) + 3)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": seen[at]})

    told = texts.select("t").mapInPandas(released(run), "cell int, n long")
    top = told.groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(CROWDED).collect()
    out = np.zeros(1 << CELLS, dtype=np.int64)
    out[[r["cell"] for r in top]] = [r["n"] for r in top]
    return out


def _within(similarity: float) -> Column:
    """Sizes and odd sketches of sides a and b allow the similarity: a chain of two segments within budget, then the whole."""
    most = (F.col("size_a") + F.col("size_b")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6

    def chained(apart: Column) -> Column:
        two = F.exists(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda i: (apart[i] * SEGMENTS <= most) & ((apart[i] + apart[(i + 1) % SEGMENTS]) * SEGMENTS <= 2 * most))
        return two & (F.aggregate(apart, F.lit(0), lambda n, d: n + d) <= most)

    sizes = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6
    return sizes & let(F.zip_with("sketch_a", "sketch_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), chained)


def _enough_left(similarity: float) -> Column:
    """The key at place i of sides a and b can be the first that they share: what is left from it on, in either, holds all that has to be shared."""
    needed = (F.col("size_a") + F.col("size_b")) * F.lit(similarity / (1 + similarity)) - 1e-6
    return F.least(F.col("size_a") - F.col("i_a"), F.col("size_b") - F.col("i_b")) >= needed


def _wide_within(similarity: float) -> Column:
    """Wide sketches of sides a and b, the longer one folded to the shorter, allow the similarity."""
    n = F.least(F.size("wide_a"), F.size("wide_b"))

    def folded(x: str) -> Column:
        return F.when(F.size(x) > n, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(x, i).bitwiseXOR(F.get(x, i + n)))).otherwise(F.col(x))

    apart = F.aggregate(F.zip_with(folded("wide_a"), folded("wide_b"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    return apart <= (F.col("size_a") + F.col("size_b")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def _side(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{side}") for c in columns))


def left_pairs(marks: DataFrame, info: DataFrame, similarity: float) -> DataFrame:
    """(c_a, c_b): pairs of sets of different ``label`` that may be similar enough, of those that share a key of ``marks`` (h, c, i, label).

    Keys that the same sets share are one: their members are met once, at the first of those keys, not anew at each.
    """
    by_key = W.partitionBy("h")
    members = [F.bit_xor(F.xxhash64("c", F.lit(i))).over(by_key).alias(f"g{i}") for i in range(2)]
    rest = marks.select("c", "i", "label", *members).repartition("g0", "g1")
    rest = rest.groupBy("g0", "g1", "c").agg(F.min("i").alias("i"), F.first("label").alias("label"))
    rest = rest.join(small_side(info.select("c", "size", "sketch"), 120), "c")
    a, b = (_side(rest, side, "g0", "g1", "c", "i", "label", "size", "sketch") for side in "ab")
    same = (F.col("g0_a") == F.col("g0_b")) & (F.col("g1_a") == F.col("g1_b")) & (F.col("c_a") < F.col("c_b")) & (F.col("label_a") != F.col("label_b"))
    return a.join(b, same & _enough_left(similarity) & _within(similarity)).select("c_a", "c_b")


class _Verifier:
    """Compares pairs of classes by their whole sets, which are made anew from the texts of one row of each class."""

    def __init__(self, texts: DataFrame, classes: DataFrame, k: int, similarity: float):
        self.texts, self.classes, self.k, self.similarity = texts, classes, k, similarity

    def edges(self, pairs: DataFrame) -> DataFrame:
        """Of the distinct ``pairs`` (c_a, c_b) those that are similar enough, as (a, b)."""
        k = self.k
        a, b = (_side(self.classes, side, "c", "size", "wide") for side in "ab")
        pairs = cut(pairs.join(a, "c_a").join(b, "c_b").where(_wide_within(self.similarity)).select("c_a", "c_b"))
        met = pairs.select(F.explode(F.array("c_a", "c_b")).alias("c")).distinct()
        met = cut(self.classes.select("c", "th").join(met, "c", "left_semi"))
        n = met.count()

        def whole(batches):
            for pdf in batches:
                sets = [shingle_set(t, k) for t in pdf["t"]]
                yield pd.DataFrame({"c": [_class(s) for s in sets], "sh": pd.Series([s.view(np.int64) for s in sets], dtype=object)})

        texts = self.texts.join(small_side(met.select("th").distinct(), 16, n), "th", "left_semi").select("t")
        sets = texts.mapInPandas(released(whole), "c long, sh array<long>").join(small_side(met.select("c"), 16, n), "c", "left_semi")
        sets = sets.groupBy("c").agg(F.first("sh").alias("sh"))
        both = pairs.join(_side(sets, "a", "c", "sh"), "c_a").join(_side(sets, "b", "c", "sh"), "c_b")
        shared = F.size(F.array_intersect("sh_a", "sh_b"))
        return both.where(shared >= self.similarity * (F.size("sh_a") + F.size("sh_b") - shared) - 1e-9).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """(id, th, group): one row per input row, stored; th is a hash of the text, rows of one group are near copies.

    Groups are the components of the links between all rows whose sets of shingles have at least the Jaccard
    similarity. Rows without words are copies of each other.
    """
    small_batches(docs.sparkSession)
    k = shingle_words
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    crowd = crowded_cells(texts, k)
    at = np.flatnonzero(crowd)
    crowded = (at.astype(np.int32), crowd[at])  # what is sent to the tasks: CROWDED rows at most

    def begin(batches):
        count = np.zeros(1 << CELLS, dtype=np.int64)
        count[crowded[0]] = crowded[1]
        told: set[int] = set()
        for pdf in batches:
            cs, sizes, keys, wide = [], [], [], []
            for t in pdf["t"]:
                s = shingle_set(t, k)
                c = _class(s)
                cs.append(c)
                sizes.append(len(s))
                if c in told:  # a copy of one that this task has told
                    keys.append(None)
                    wide.append(None)
                    continue
                told.add(c)
                least = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
                n = count[_cells(s)]
                rare = np.flatnonzero(n == 0)[:least]
                if len(rare) < least:
                    often = np.flatnonzero(n)
                    rare = np.concatenate([rare, often[np.argsort(n[often], kind="stable")][: least - len(rare)]])
                keys.append(s[rare].view(np.int64))
                wide.append(wide_sketch(s))
            yield pd.DataFrame({"th": pdf["th"], "c": cs, "size": sizes, "keys": pd.Series(keys, dtype=object), "wide": pd.Series(wide, dtype=object)})

    out = T.StructType.fromDDL("th long, c long, size int, keys array<long>, wide array<long>").fields
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("t"))
    begun = cut(map_beside(rows, "id", [F.col("th"), F.col("t")], released(begin), out))
    told = begun.where(F.col("keys").isNotNull())
    # the sets that share a key: dealt out by key once, copies told by several tasks fall together there
    marks = told.select("c", F.posexplode("keys").alias("i", "h"), "size").repartition("h")
    marks = marks.groupBy("h", "c").agg(F.min(F.struct("i", "size")).alias("m"))
    marks = marks.withColumn("n", F.count("*").over(W.partitionBy("h"))).where("n > 1")
    marks = cut(marks.select("h", "c", F.col("m.i").alias("i"), F.col("m.size").alias("size")))
    info = told.select("c", "th", "size", "wide").join(marks.select("c").distinct(), "c", "left_semi")
    info = info.groupBy("c").agg(F.first("size").alias("size"), F.first("wide").alias("wide"), F.min("th").alias("th"))
    narrow = [F.aggregate(F.sequence(F.lit(i), F.size("wide") - 1, F.lit(SEGMENTS)), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get("wide", j))) for i in range(SEGMENTS)]
    info = cut(info.withColumn("sketch", F.array(*narrow)))
    verifier = _Verifier(texts, info, k, similarity)
    edges, labels = None, None

    by_key = W.partitionBy("h")

    def labelled() -> DataFrame:
        """The marks of groups that still hold several components, with the component as ``label``. One exchange, by key."""
        if labels is None:
            of = marks.withColumn("label", F.col("c"))
        else:
            of = marks.join(small_side(labels, 16), F.col("c") == F.col("v"), "left").select(*marks.columns, F.coalesce("label", "c").alias("label"))
        of = of.withColumns({"lo": F.min("label").over(by_key), "hi": F.max("label").over(by_key)})
        return of.where("lo <> hi").drop("lo", "hi")

    def compared(pairs: DataFrame) -> None:
        nonlocal edges, labels
        found = verifier.edges(pairs)
        edges = cut(found if edges is None else edges.union(found).distinct())
        labels = components(edges)

    for r in range(rounds):
        chosen = [F.min_by(F.struct("c", "label", "size"), F.xxhash64("c", F.lit(HUBS * r + i))).over(by_key) for i in range(HUBS)]
        pairs = labelled().withColumn("hubs", F.array(*chosen)).select("c", "label", "size", F.explode(F.array_distinct("hubs")).alias("hub"))
        pairs = pairs.where((F.col("label") != F.col("hub.label")) & (F.least("size", "hub.size") >= similarity * F.greatest("size", "hub.size") - 1e-6))
        pairs = pairs.select(F.least("c", "hub.c").alias("c_a"), F.greatest("c", "hub.c").alias("c_b")).distinct()
        pairs = pairs.join(_side(info, "a", "c", "size", "sketch"), "c_a").join(_side(info, "b", "c", "size", "sketch"), "c_b")
        compared(pairs.where(_within(similarity)).select("c_a", "c_b"))

    compared(left_pairs(labelled(), info, similarity).distinct())
    out = begun.select("id", "th", "c").join(labels, F.col("c") == F.col("v"), "left")
    return cut(out.select("id", "th", F.coalesce("label", "c").alias("group")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the least id stays, with its whole text.

    Defined cases: null and blank texts have no words and are copies of each other; a null id comes after all others;
    rows that repeat id and text are one; an empty table gives an empty result; all columns stay, whatever their names
    (``_th`` aside). A group of any size costs in proportion to its rows while its members are alike, and texts are
    compared whole. Rows that go are looked up by id and text hash; texts are dealt out only where they are too many.
    """
    rows = groups_of(docs, id_col, text_col, shingle_words, similarity)
    keys = rows.groupBy("id", "th", "group").agg(F.count("*").alias("n"))
    first = keys.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("f"), F.sum("n").alias("of"))
    first = cut(first.select("group", F.col("f.id").alias("fid"), F.col("f.th").alias("fth"), "of"))
    hot = first.where(F.col("of") * HOT_SHARE >= (first.agg(F.sum("of")).first()[0] or 0))  # HOT_SHARE groups at most
    met = keys.join(F.broadcast(hot), "group").unionByName(keys.join(F.broadcast(hot.select("group")), "group", "left_anti").join(first.where("of > 1"), "group"))
    keys = cut(met.withColumn("kept", F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth"))).where("not kept or n > 1").select(F.col("id").alias("_id"), F.col("th").alias("_of"), "kept"))
    marked = docs.withColumn("_th", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of"))
    out = marked.join(small_side(keys.drop("kept"), 64), same, "left_anti")
    again = cut(keys.where("kept").drop("kept"))
    if again.count():  # rows told twice over
        out = out.unionByName(marked.join(small_side(again, 64), same, "left_semi").dropDuplicates([id_col, "_th"]))
    return out.drop("_th")
