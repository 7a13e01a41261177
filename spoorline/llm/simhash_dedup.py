"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, then by
the pigeonring principle some chain of consecutive segments, from some start, keeps every cumulative difference
within its proportional budget: after k segments at most k * 3 / 4 bits, so 0 after one, 1 after two, 2 after
three. The first two segments of such a chain are an equality key once the side whose differing bit is clear lists the
values with one more bit of its second segment set, so candidates come from an equi-join; the third segment's budget
prunes them, and the full Hamming distance decides.

Rows with equal fingerprints are one class before anything is joined. A key that more than ``pair_limit`` classes
share (a large group of near copies) is not joined pair by pair: its classes are linked through the values
between them, see ``_dense_links``. That is exact and grows with the classes, not with their square. A key has 32 bits
in one of four places and a class probes 9 of them on average, so evenly spread fingerprints crowd keys only beyond
2e11 classes; from there on a wider key (more segments) is the better choice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import cut, map_beside, released, small_batches

RADIUS = 3
SEGMENTS = 4
WIDTH = 16


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: ASCII-lower-cased words, shingles with repeats, XXH64; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp): one row per input row; fp is the 64 bits as a signed long. Null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"fp": np.array([fingerprint(t, shingle_words) for t in pdf["t"]], dtype=np.uint64).view(np.int64)})

    return map_beside(docs, id_col, [F.col(text_col).cast("binary").alias("t")], released(run), [T.StructField("fp", T.LongType())])


def _segment(fp: Column, i) -> Column:
    """Segment i (a number or a column, taken modulo 4) of a fingerprint."""
    return F.call_function("shiftrightunsigned", fp, ((F.lit(i) % SEGMENTS) * WIDTH).cast("int")).bitwiseAND(F.lit(0xFFFF))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _key(i, first: Column, second: Column) -> Column:
    return (F.lit(i).cast("long") * F.lit(1 << 32)) + first * F.lit(1 << 16) + second


def links(classes: DataFrame, pair_limit: int = 512) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) at most 3 bits apart, enough to connect every such pair.

    A key that at most ``pair_limit`` classes probe gives all its links. A pair is missed there only if the key that
    one side has and the other probes is denser, and ``_dense_links`` links all classes that probe such keys.
    """
    key = lambda i: _key(i, _segment(F.col("fp"), i), _segment(F.col("fp"), i + 1))
    index = classes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), key(i).alias("key")) for i in range(SEGMENTS)))).alias("x")).select("fp", "x.i", "x.key")
    clear = F.filter(F.array(*(F.lit(1 << b).cast("long") for b in range(WIDTH))), lambda m: F.col("key").bitwiseAND(m) == 0)
    values = F.concat(F.array("key"), F.transform(clear, lambda m: F.col("key").bitwiseOR(m)))
    probe = index.select(F.col("fp").alias("other"), F.explode(values).alias("key"))
    dense = probe.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > pair_limit).select("key")
    dense = cut(index.select("key").distinct().join(dense, "key", "left_semi"))
    pairs = probe.join(index.join(dense, "key", "left_anti"), "key").where(F.col("fp") != F.col("other"))

    def apart(k: int) -> Column:
        i = F.col("i") + k
        return _distance(_segment(F.col("fp"), i), _segment(F.col("other"), i))

    pairs = pairs.where(apart(1) + apart(2) <= 2).where(_distance(F.col("fp"), F.col("other")) <= RADIUS)
    pairs = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    crowded = probe.join(dense, "key", "left_semi").select(F.col("other").alias("fp")).distinct()
    return pairs.unionByName(_dense_links(crowded)).distinct()


def _dense_links(crowded: DataFrame) -> DataFrame:
    """Links that connect all pairs of ``crowded`` at most 3 bits apart.

    Such a pair has a value between: within one bit of one side and two of the other. Each value that some
    class reaches with one bit takes the least such class as its hub; all that reach it with two bits are
    within 3 of the hub. At most 2081 distinct fingerprints reach a value, so its list is bounded.
    """
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    places = F.sequence(F.lit(0), F.lit(63))
    one = F.transform(places, bit)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda a: F.transform(F.sequence(a + 1, F.lit(63)), lambda b: bit(a).bitwiseOR(bit(b)))))
    near = crowded.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), one, two)).alias("mask"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), (F.bit_count("mask") <= 1).alias("close"))
    met = near.groupBy("value").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("bs")).where(F.col("a").isNotNull() & (F.size("bs") > 1))
    found = met.select("a", F.explode("bs").alias("b")).where(F.col("a") != F.col("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes_of(fps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id, first_id, first_fp): for every distinct fingerprint its component's least id, and the row that stands for it."""
    classes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("id")))
    labels = components(links(classes))
    labelled = classes.join(labels.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label"))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("m"))
    return labelled.join(first, "label").select("fp", F.col("m.id").alias("component_id"), F.col("m.fp").alias("first_fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): one row per input row.

    ``component_id`` is the least id reachable over links of at most 3 bits. Defined cases: null and empty texts
    have fingerprint zero and are linked like any other; repeated rows are one class; a null id never is the least
    one, and its row has the component of its text; an empty table gives an empty result; other columns are
    neither read nor kept; a text is read whole, however long, in memory of about ten times its size.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    found = fps.join(classes_of(fps, id_col), "fp")
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies (five-word shingles, similarity 0.8); see ``near_copies``, whose fingerprints no such pair can evade."""
    from . import near_copies

    return near_copies.keep_first(docs, id_col, text_col, shingle_words, similarity)
