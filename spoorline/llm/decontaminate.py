"""Benchmark decontamination with SimHash over item-sized windows. DataFrame functions only.

1. Windows. Only a window that shares a word shingle with an item can be similar to it, so a document's shingles are
   looked up among those of all items; a hit at place p of the document and q of an item with n words gives the
   window of n words that starts at p - q. No text is cut and every aligned window is looked at.
2. Fingerprints. Windows and items get a 64-bit SimHash of their words, repeats included.
3. Multi-index Hamming blocks. Eight blocks of eight bits: of two fingerprints within 15 bits at least one block
   differs in at most one bit, so an equi-join on (size, block, value), with the nine values about each block of an
   item listed, finds every pair of equal size within the radius.
4. Verification. The similarity of a window and an item of as many words is the weight of the shingles that they
   share, repeats counted, over the weight of the item's shingles; a shingle weighs ln(1 + items / items that have it).

No radius bounds the similarity: with seven words at the edges of a 39-word item changed, similarity is exactly 0.8 and
one window in seven lies beyond 15 bits. Steps 1 to 3 also see aligned windows only. What they leave goes through
``every_contaminated`` in the pipeline, which weighs every window of an item's length that shares a shingle with it;
fingerprints give its distance. The query uses it for all rows, because its pairs need every window.

Items of fewer words than a shingle are one shingle as a whole. Broadcasts stand behind a count of rows of a fixed
width, or of bytes where rows hold lists. A text is read as one row, however long: a row of hits takes 24 bytes for each
place of the text where a shingle of that item stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, let, small_side

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 8, 8
#: Up to so many rows of a fixed width (some 60 bytes) a side may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, each as a 64-bit hash, in order."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: Column, k: int) -> Column:
    """The hashes of all runs of ``k`` words, in order; none where there are fewer words."""
    run = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))
    return F.when(F.size(words) >= k, run).otherwise(F.array().cast("array<bigint>"))


def simhash(features: Column) -> Column:
    """The 64-bit SimHash of an array of hashes, repeats included."""

    def bit(fs: Column, b: Column) -> Column:
        ones = F.aggregate(fs, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(2 * ones > F.size(fs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return let(features, lambda fs: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(bit(fs, b))))


def _block(fp: Column, b: int) -> Column:
    return F.call_function("shiftright", fp, F.lit(b * BLOCK_BITS)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, n, k, sh, fp): words, shingle length, shingle hashes and fingerprint of each item that has words.

    The key tells rows apart that share an item id; it holds once the result is stored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    sh = reduce(lambda rest, k: F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(rest), range(1, SHINGLE), shingles(F.col("w"), SHINGLE))
    return items.select(F.monotonically_increasing_id().alias("key"), "item", F.size("w").alias("n"), "k", sh.alias("sh"), simhash(F.col("w")).alias("fp"))


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, windows): of each id with a shingle of an item the distinct (n, k, start) of aligned windows. ``docs`` has id and t."""
    marks = items.select("k", "n", F.posexplode("sh").alias("q", "h")).groupBy("h", "k").agg(F.collect_set(F.struct("n", "q")).alias("at"))
    marks = cut(marks)
    lengths = [r.k for r in marks.select("k").distinct().collect()]  # five at most
    held = marks.agg(F.sum(F.size("at") * 8 + 60)).head()[0] or 0
    words = docs.select("id", words_of(F.col("t")).alias("w"))

    def hits(k: int) -> DataFrame:
        placed = words.select("id", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("p", "h"))
        met = placed.join(small_side(marks.where(F.col("k") == k).drop("k"), 1, held), "h")
        at = met.select("id", "size", "p", F.explode("at").alias("x")).select("id", "size", F.col("x.n").alias("n"), (F.col("p") - F.col("x.q")).alias("start"))
        # a window that would hang over an end of the text is moved inside it
        start = F.greatest(F.lit(0), F.least(F.col("start"), F.col("size") - F.col("n")))
        return at.where(F.col("size") >= k).select("id", F.struct("n", F.lit(k).alias("k"), start.alias("start")).alias("window"))

    if not lengths:
        return docs.select("id", F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("start"))).alias("windows")).where("false")
    return reduce(DataFrame.unionByName, map(hits, lengths)).groupBy("id").agg(F.collect_set("window").alias("windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, distance): every document and item of which some window is within the radius and similar enough.

    similarity is the largest over the windows, distance the least. Defined cases: null texts and texts without
    letters or digits have no words and never match, on either side; repeated rows and ids give one row for each
    id and item; a null id is an id like any other; an empty table on either side gives an empty result; other
    columns are neither read nor kept.
    """
    items = cut(items_of(benchmark, item_col, item_text_col))
    n_items = items.count()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    windows = cut(windows_of(texts, items))
    held = windows.agg(F.sum(F.size("windows") * 16 + 100)).head()[0] or 0
    found = texts.join(small_side(windows.withColumnRenamed("id", "of"), 1, held), F.col("id").eqNullSafe(F.col("of")))
    found = found.select("id", words_of(F.col("t")).alias("w"), F.explode("windows").alias("x"))
    found = found.select("id", F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w"), F.col("x.n").alias("n"), F.col("x.k").alias("k"))
    sh = reduce(lambda rest, k: F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(rest), range(1, SHINGLE), shingles(F.col("w"), SHINGLE))
    found = cut(found.select("id", "n", sh.alias("sh"), simhash(F.col("w")).alias("fp")))

    weights = items.select(F.explode(F.array_distinct("sh")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    weighed = items.select("key", F.explode("sh").alias("h")).groupBy("key", "h").agg(F.count("*").alias("c")).join(weights, "h")
    bags = weighed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("h", "c", F.log(1 + F.lit(n_items) / F.col("df")).alias("v")))).alias("bag"))

    values = [0] + [1 << b for b in range(BLOCK_BITS)]
    index = items.join(bags, "key").select("item", "n", "bag", F.col("fp").alias("item_fp"), F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).bitwiseXOR(F.lit(v)).alias("value")) for b in range(BLOCKS) for v in values))).alias("x"))
    index = index.select("item", "n", "item_fp", "bag", "x.block", "x.value")
    probes = found.select("id", "n", "sh", "fp", F.explode(F.array(*(F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)))).alias("x"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))

    def first_block() -> Column:
        """The first block that brings the pair here; the others bring it again."""
        near = [F.bit_count(_block(F.col("fp").bitwiseXOR(F.col("item_fp")), b)) <= 1 for b in range(BLOCKS)]
        return reduce(lambda rest, b: F.when(near[b], F.lit(b)).otherwise(rest), reversed(range(BLOCKS)), F.lit(-1))

    pairs = probes.select("id", "n", "sh", "fp", "x.block", "x.value").join(index, ["n", "block", "value"])
    pairs = pairs.where((distance <= RADIUS) & (F.col("block") == first_block()))

    def total(each) -> Column:
        return F.aggregate("bag", F.lit(0.0), lambda s, x: s + x["v"] * each(x))

    shared = total(lambda x: F.least(x["c"], F.size(F.filter("sh", lambda h: h == x["h"])).cast("long")))
    pairs = pairs.select("id", "item", distance.alias("distance"), (shared / total(lambda x: x["c"])).alias("similarity")).where(F.col("similarity") >= SIMILARITY - 1e-9)
    return pairs.groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max("similarity").alias("similarity"), F.min("distance").alias("distance"))


def every_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, distance): as ``contaminated``, over all windows of an item's length and without a radius.

    The shared weight of a window changes only where a hit enters or leaves it, so sums over sorted hits give it for
    every start, at a cost that grows with the hits. distance is the least among the windows that are similar enough.
    """
    items = cut(items_of(benchmark, item_col, item_text_col))
    n_items = items.count()
    weights = items.select(F.explode(F.array_distinct("sh")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    index = items.select("key", "n", "k", F.explode("sh").alias("h")).groupBy("key", "n", "k", "h").agg(F.count("*").cast("int").alias("c")).join(weights, "h")
    index = cut(index.withColumn("v", F.log(1 + F.lit(n_items) / F.col("df"))).drop("df"))
    rows, lengths = index.count(), [r.k for r in index.select("k").distinct().collect()]  # five at most
    goals = items.select("key", "item", F.col("fp").alias("item_fp")).join(index.groupBy("key").agg(F.sum(F.col("c") * F.col("v")).alias("goal")), "key")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("t"))
    words = texts.select("id", "th", words_of(F.col("t")).alias("w"))

    def hits(k: int) -> DataFrame:
        placed = words.where(F.size("w") >= k).select("id", "th", F.size("w").alias("size"), F.posexplode(shingles(F.col("w"), k)).alias("p", "h"))
        return placed.join(_side(index.where(F.col("k") == k), rows), "h")

    found = reduce(DataFrame.unionByName, map(hits, lengths or [SHINGLE]))
    found = found.groupBy("id", "th", "size", "key", "n", "k").agg(F.sort_array(F.collect_set(F.struct("h", "p", "c", "v"))).alias("hits"))
    found = found.join(_side(goals, n_items), "key")
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))

    def edges(x: Column, i: Column) -> Column:
        """Of the starts whose window counts this hit: the first, and the one after the last."""
        before = F.when(i >= x["c"], F.get("hits", i - x["c"]))  # with it in the window too, the hit is one too many
        first = F.greatest(F.lit(0), x["p"] - (F.col("n") - F.col("k")), F.when(before["h"] == x["h"], before["p"] + 1).otherwise(0))
        end = F.least(x["p"], last) + 1
        return F.when(first < end, F.array(F.struct(first.alias("at"), x["v"].alias("v")), F.struct(end.alias("at"), (-x["v"]).alias("v")))).otherwise(F.array().cast("array<struct<at:int,v:double>>"))

    least = F.col("goal") * SIMILARITY - 1e-9 * F.col("goal")
    found = found.where(F.aggregate("hits", F.lit(0.0), lambda s, x: s + x["v"]) >= least)
    found = found.withColumn("edges", F.sort_array(F.flatten(F.transform("hits", edges)))).drop("hits")
    most = F.aggregate("edges", F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("top")), lambda s, e: let(s["sum"] + e["v"], lambda n: F.struct(n.alias("sum"), F.greatest(s["top"], n).alias("top"))))["top"]
    found = cut(found.withColumn("most", most).where(F.col("most") >= least))

    by = W.partitionBy("id", "th", "key").orderBy("at")
    steps = found.select("id", "th", "key", "item", "item_fp", "n", "goal", "most", F.explode("edges").alias("e")).groupBy("id", "th", "key", "item", "item_fp", "n", "goal", "most", F.col("e.at").alias("at")).agg(F.sum("e.v").alias("v"))
    steps = steps.withColumn("sum", F.sum("v").over(by)).withColumn("to", F.lead("at").over(by)).where((F.col("sum") >= least) & F.col("to").isNotNull())
    spans = cut(steps.groupBy("id", "th", "item", "item_fp", "n").agg(F.max(F.col("most") / F.col("goal")).alias("similarity"), F.collect_set(F.struct("at", "to")).alias("spans")))
    held = spans.agg(F.sum(F.size("spans") * 16 + 100)).head()[0] or 0
    near = texts.join(small_side(spans.withColumnRenamed("id", "of").withColumnRenamed("th", "of_th"), 1, held), F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")))
    starts = F.flatten(F.transform("spans", lambda x: F.sequence(x["at"], x["to"] - 1)))
    distance = let(words_of(F.col("t")), lambda w: F.array_min(F.transform(starts, lambda s: F.bit_count(simhash(F.slice(w, s + 1, F.col("n"))).bitwiseXOR(F.col("item_fp"))))))
    return near.withColumn("distance", distance).groupBy(F.col("id").alias(id_col), F.col("item").alias(item_col)).agg(F.max("similarity").alias("similarity"), F.min("distance").alias("distance"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", search=contaminated, **names) -> DataFrame:
    """The rows of ``docs`` that have no row in what ``search`` gives: ``contaminated`` or ``every_contaminated``.

    A row is judged on its own text: rows are told apart by id and a hash of the text, so others with its id stay.
    """
    text = F.col(names.get("text_col", "text"))
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    found = search(docs.withColumn("_row", row), benchmark, "_row", **names).select(F.col("_row.id").alias("_leaked"), F.col("_row.hash").alias("_hash"))
    found = cut(found.distinct())
    same = F.col(id_col).eqNullSafe(F.col("_leaked")) & (F.xxhash64(text) == F.col("_hash"))
    return docs.join(_side(found, found.count()), same, "left_anti")
