"""A stored inverted index for searches, and rank by cover density.

A posting is (token, kind, branch, id, at, n): the places of a token in the vector of one name (or set of names) of an
entity, and how many distinct tokens that vector has. Postings are stored sorted by token, in files that hold disjoint
ranges, by kind; a word, whole or as a beginning, is the range from the word to the next text that does not begin with
it, a condition on a sorted column that skips files and row groups. So a search reads the postings of its words, never
an entity table; the rows of a page are then looked up by its ids.

Cover density: a cover is a smallest window of a vector that holds all words of the query. It is worth 1 / (1 + noise),
noise being the places in it beyond one for each word, and as much again where the words stand in it in the order of the
query; covers of a vector add up, divided by its distinct tokens. So near words, words in order, and short names come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.search import query_words, token_list

#: Rows of postings that a file holds, about.
FILE_ROWS = 4_000_000


def vectors(frame: DataFrame, kind: str, branch: str, id: str, names: list[str]) -> DataFrame:
    """(token, kind, branch, id, at, n): the postings of one branch of a kind of entity. Rows without a token have none.

    ``id`` may repeat (an entity with several addresses): every row is a vector of its own, told apart by ``vector``.
    """
    rows = frame.select(F.col(id).alias("id"), token_list(*map(F.col, names)).alias("ts")).where(F.size("ts") > 0)
    rows = rows.withColumn("vector", F.xxhash64(F.array_join("ts", " "))).withColumn("n", F.size(F.array_distinct("ts")))
    each = rows.select("id", "vector", "n", F.posexplode("ts").alias("place", "token"))
    found = each.groupBy("token", "id", "vector", "n").agg(F.sort_array(F.collect_set(F.col("place") + 1)).alias("at"))
    return found.select("token", F.lit(kind).alias("kind"), F.lit(branch).alias("branch"), "id", "vector", "at", "n")


def entity_postings(tables) -> DataFrame:
    """The postings of datasets, jobs, locations and runs, with those of what an entity's location is called."""
    place = tables.location.select(F.col("id").alias("location_id"), F.col("type").alias("location_type"), F.col("name").alias("location_name"), F.col("external_id").alias("location_external_id"))
    address = tables.address.select("location_id", "url")
    parts = [vectors(tables.location, "location", "name", "id", ["type", "name", "external_id"]), vectors(address, "location", "address", "location_id", ["url"])]
    for kind, table in (("dataset", tables.dataset), ("job", tables.job)):
        at = table.select("id", "location_id")
        parts += [vectors(table, kind, "name", "id", ["name"]), vectors(at.join(place, "location_id"), kind, "location", "id", ["location_type", "location_name"])]
        parts += [vectors(at.join(address, "location_id"), kind, "address", "id", ["url"]), vectors(at.join(place, "location_id"), kind, "external", "id", ["location_external_id"])]
    runs = tables.run.select("id", "job_id", "external_id")
    names = runs.join(tables.job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
    parts += [vectors(runs, "run", "external", "id", ["external_id"]), vectors(names, "run", "job", "id", ["job_name"])]
    return reduce(DataFrame.unionByName, (p.withColumn("id", F.col("id").cast("string")) for p in parts))


def write(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Stores postings by kind, in files of disjoint, sorted ranges of tokens. A token with very many postings fills files of its own: ids part it."""
    files = files or max(1, -(-postings.count() // FILE_ROWS))
    dealt = postings.repartitionByRange(files, "kind", "token", "id").sortWithinPartitions("kind", "token", "id")
    dealt.write.mode("overwrite").partitionBy("kind").parquet(path)


def in_ranges(token: Column, words: list[str]) -> Column:
    """Whether a token begins with one of the words, as comparisons that reach the scan of a sorted column."""
    most = "\U0010ffff"  # comes after every character, so it ends the range of a beginning
    ranges = [(token >= w) & (token <= w + most * 8) & token.startswith(w) for w in words]
    return reduce(Column.__or__, ranges) if ranges else F.lit(False)


def hits(postings: DataFrame, text: str, by: tuple[str, ...] = ("kind", "branch", "id", "vector")) -> DataFrame:
    """The vectors that match a query, with ``n`` and, for each of its words, ``whole<i>`` and ``begun<i>``."""
    written, bare = query_words(text)
    words = sorted({*written, *bare})
    near = postings.where(in_ranges(F.col("token"), words))
    tests = [F.max(F.col("token") == w).alias(f"whole{i}") for i, w in enumerate(words)] + [F.max(F.col("token").startswith(w)).alias(f"begun{i}") for i, w in enumerate(words)]
    found = near.groupBy(*by).agg(F.first("n").alias("n"), *(tests or [F.lit(False).alias("none")]))
    place = {w: i for i, w in enumerate(words)}

    def every(some: list[str], how: str) -> Column:
        return reduce(Column.__and__, (F.col(f"{how}{place[w]}") for w in some)) if some else F.lit(False)

    return found.where(every(written, "whole") | every(written, "begun") | every(bare, "begun"))


def search(postings: DataFrame, kind: str, text: str) -> DataFrame:
    """(id, search_rank): the entities of a kind that match, as ``listing.search`` finds them; of several branches the largest rank counts."""
    if len(text.strip()) < 3:
        raise ValueError("a search has three characters at least")
    written, bare = query_words(text)
    n = len({*written, *bare})
    points = reduce(Column.__add__, (F.when(F.col(f"whole{i}"), 2).when(F.col(f"begun{i}"), 1).otherwise(0) for i in range(n)), F.lit(0))
    found = hits(postings.where(F.col("kind") == kind), text)
    return found.groupBy("id").agg(F.max(F.floor(points * F.lit(1_000_000) / F.col("n")).cast("long")).alias("search_rank"))


def cover_ranks(postings: DataFrame, words: list[str], by: tuple[str, ...] = ("kind", "branch", "id", "vector")) -> DataFrame:
    """(by..., covers, cover_rank): the vectors that hold all ``words`` (whole or as beginnings), their covers and their rank in millionths.

    One pass over the sorted places of the words in each vector; a vector of any length is a sorted run of rows.
    """
    near = postings.where(in_ranges(F.col("token"), words))
    asked = F.filter(F.array(*(F.when(F.col("token").startswith(w), F.lit(i)) for i, w in enumerate(words))), lambda i: i.isNotNull())
    places = near.select(*by, "n", F.explode("at").alias("place"), asked.alias("ws")).select(*by, "n", "place", F.explode("ws").alias("w"))
    before = W.partitionBy(*by).orderBy("place").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = [f"_last{i}" for i in range(len(words))]
    ends = places.select("*", *(F.max(F.when(F.col("w") == i, F.col("place"))).over(before).alias(c) for i, c in enumerate(last)))
    ends = ends.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in last)))
    begin = F.least(*last) if len(last) > 1 else F.col(last[0])
    in_order = reduce(Column.__and__, (F.col(a) < F.col(b) for a, b in zip(last, last[1:], strict=False)), F.lit(len(last) > 1))
    # of the windows that begin at one place the one that ends first is a cover
    covers = ends.groupBy(*by, "n", begin.alias("begin")).agg(F.min(F.struct("place", (~in_order).alias("mixed"))).alias("e"))
    noise = F.greatest(F.lit(0), F.col("e.place") - F.col("begin") + 1 - len(words))
    worth = F.when(F.col("e.mixed"), F.lit(1_000_000)).otherwise(F.lit(2_000_000)) / (1 + noise)
    # whole millionths for each cover, so that the order of adding them up changes nothing
    return covers.groupBy(*by, "n").agg(F.count("*").alias("covers"), F.sum(F.floor(worth)).alias("sum")).select(*by, "covers", F.floor(F.col("sum") / F.col("n")).cast("long").alias("cover_rank"))


def page(postings: DataFrame, entities: DataFrame, kind: str, text: str, order: str = "id", page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of a search, best match first, then by id: the entities' rows are read for the page's ids only."""
    from .listing import page_rows

    found = page_rows(search(postings, kind, text), [F.desc("search_rank"), F.asc(order)], page, page_size).collect()  # 50 at most
    kind_of = dict(entities.dtypes)["id"]
    ranks = entities.sparkSession.createDataFrame([(r["id"], r["search_rank"]) for r in found], "id string, search_rank long").withColumn("id", F.col("id").cast(kind_of))
    return entities.where(F.col("id").isin([r["id"] for r in found])).join(F.broadcast(ranks), "id")
