"""Source divergence audit: how far the word shares of each source lie from those of other sources and of its language.

Shares are whole numbers, p = 1 + floor(10^9 (count + 5) / (N + 5 V)), so all sums are exact. The distance of two
sources is the sum of |p - q| over the kept terms of their language. A term that a source does not have has the base
share of that source, so only terms that one of the two has need a look. With d the distance of the two base shares:

* heavy terms, which many sources have, go into dense numpy tiles (term by source); the sum of |p - q| - d is taken
  over whole tiles;
* light terms are sparse postings. A source's own light terms against the base share of another one are a sum over
  sorted shares, looked up for all other sources at once; where a term is in the postings of both, the pair is
  corrected by |p - q| - |p - base of the other| - |q - base of the one| + d.

Both partial sums are added to V d. Work is dealt out by (language, two tiles of sources, part of the terms): a tile has
``TILE`` sources, and the terms of a language are split into parts of some ``PART`` postings, so a language or a source
that holds most of the rows is many tasks, and a task adds up pairs in a table of fixed size. What is shuffled before
is counted by word in the tasks that read the texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut, small_batches, small_side

LEAST_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
TILE, PART = 256, 200_000
#: A term is heavy where at least this share of the sources of two tiles has it.
HEAVY = 0.25
#: Distinct words that a task holds before it tells their counts, and bytes of a text that are split at a time.
HELD, SLICE = 400_000, 1 << 20

_TERM = bytes(b if chr(b).isalpha() and b < 0x80 or b >= 0x80 else 0x20 for b in range(256)).lower()


def terms_of(text: bytes):
    """Yields the terms of a text, a list for each slice of it: runs of ASCII letters and non-ASCII characters; only A-Z are lower-cased."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        yield text[at : end if end >= 0 else len(text)].split()
        at = end + 1 if end >= 0 else len(text)


def word_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, term, source, n, d): occurrences and documents, one row or more a term and source; each group also has a row without a term."""
    small_batches(docs.sparkSession)
    out = "lang string, term binary, source string, n long, d long"

    def run(batches):
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}
        told: set[tuple] = set()

        def rows():
            for (lang, source), counts in n.items():
                seen = d[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(counts)), pa.array(list(counts), pa.binary()), pa.repeat(pa.scalar(source, pa.string()), len(counts)), pa.array(list(counts.values()), pa.int64()), pa.array([seen[t] for t in counts], pa.int64())],
                    names=["lang", "term", "source", "n", "d"],
                )
            n.clear()
            d.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                group = lang, source
                if group not in n:
                    n[group], d[group] = Counter(), Counter()
                    if group not in told:
                        told.add(group)
                        n[group][b""] = 0
                own: set[bytes] = set()
                for words in terms_of(text):
                    n[group].update(words)
                    own.update(words)
                d[group].update(own)
            if sum(map(len, n.values())) > HELD:
                yield from rows()
        yield from rows()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    told = docs.select(text[0].alias("lang"), text[1].alias("source"), text[2].cast("binary").alias("t")).mapInArrow(run, out)
    return told.withColumn("term", F.col("term").cast("string"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + PRIOR) / (total + PRIOR kept)), in decimals, so that no count is too large."""
    long = lambda c: c.cast("decimal(19,0)")
    above = (long(n) + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (long(total) + long(kept) * PRIOR).cast("decimal(24,0)")
    return F.call_function("div", above, below) + 1


def pair_sums(term: np.ndarray, at: np.ndarray, p: np.ndarray, base: np.ndarray, heavy: float = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(dense, sparse): over the terms given the sum of |p - q| - |base - base of the other| for every two of the sources ``base`` is of.

    ``term`` numbers the terms, ``at`` the sources; a source that has no posting of a term has its base share there.
    """
    width = len(base)
    apart = np.abs(base[:, None] - base[None, :])
    _, term, sizes = np.unique(term, return_inverse=True, return_counts=True)
    is_heavy = sizes >= max(2, heavy * width)
    dense, sparse = np.zeros((width, width), dtype=np.int64), np.zeros((width, width), dtype=np.int64)
    place = np.cumsum(is_heavy) - 1
    mine = is_heavy[term]
    # heavy: tiles of terms by sources
    rows, cols, shares = place[term[mine]], at[mine], p[mine]
    order = np.argsort(rows, kind="stable")
    rows, cols, shares = rows[order], cols[order], shares[order]
    for lo in range(0, int(is_heavy.sum()), TILE):
        a, b = np.searchsorted(rows, [lo, lo + TILE])
        tile = np.repeat(base[:, None], min(TILE, int(is_heavy.sum()) - lo), axis=1)
        tile[cols[a:b], rows[a:b] - lo] = shares[a:b]
        for g in range(width):
            dense[g] += np.abs(tile - tile[g]).sum(axis=1) - tile.shape[1] * apart[g]
    # light: each source's own terms against the base share of every other one
    term, at, p = term[~mine], at[~mine], p[~mine]
    for g in np.unique(at):
        own = np.sort(p[at == g])
        sums = np.concatenate([[0], np.cumsum(own)])
        below = np.searchsorted(own, base)
        away = base * below - sums[below] + (sums[-1] - sums[below]) - base * (len(own) - below)
        more = away - len(own) * apart[g]
        sparse[g] += more
        sparse[:, g] += more
    # and where both have the term
    order = np.lexsort((at, term))
    term, at, p = term[order], at[order], p[order]
    for step in range(1, int(sizes[~is_heavy].max(initial=0))):
        both = np.flatnonzero(term[step:] == term[:-step])
        g, s, pg, ps = at[both], at[both + step], p[both], p[both + step]
        more = np.abs(pg - ps) - np.abs(pg - base[s]) - np.abs(ps - base[g]) + apart[g, s]
        np.add.at(sparse, (g, s), more)
        np.add.at(sparse, (s, g), more)
    np.fill_diagonal(sparse, 0)
    return dense, sparse


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to every other source of the language
    (part ``pair``), and its ``top_terms`` kept terms with a share above that of the language (part ``term``).

    Ranks go by value descending, then item ascending by its UTF-8 bytes. Defined cases: null text, language and
    source count as empty text; a group without terms is there, with base shares; a language without kept terms has
    distances of 0 and no terms; a lone source has no pairs; repeated rows count each; an empty table gives an empty
    result; a text is split whole, however long; other columns are neither read nor kept.
    """
    told = word_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    # counted by task above; this one exchange serves the sums by source and those over the sources
    over = W.partitionBy("lang", "term")
    counts = told.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = counts.withColumns({"docs": F.sum("d").over(over), "all": F.sum("n").over(over)})
    counts = cut(counts.where((F.col("term") == "") | (F.col("docs") >= least_documents)).select("lang", "term", "source", "n", "all"))
    postings = counts.where(F.col("term") != "")
    # of each language V and N, of each group N and its number in the language; groups without terms too
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term") == "").select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").fillna(0, ["total"])
    languages = postings.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    groups = groups.join(languages, "lang", "left").fillna(0, ["kept", "lang_total"])
    groups = groups.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = cut(groups.withColumn("base", F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0).cast("long"))))
    bytes_held = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 60)).head()[0] or 0
    shares = postings.join(small_side(groups, 1, bytes_held), ["lang", "source"])
    shares = cut(shares.select("lang", "term", "source", "at", "total", "kept", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q")))

    above = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_group = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top_terms)

    sums = _pairs(shares, groups)
    one, other = groups.select("lang", "source", "at", "base", "kept"), groups.select("lang", F.col("source").alias("item"), F.col("at").alias("to"), F.col("base").alias("other"))
    pairs = one.join(other, "lang").where(F.col("at") != F.col("to"))  # the result itself: every other source of the language
    pairs = pairs.join(sums, (pairs["lang"] == sums["of"]) & (pairs["at"] == sums["g"]) & (pairs["to"] == sums["s"]), "left")
    value = F.col("kept") * F.abs(F.col("base") - F.col("other")) + F.coalesce("dense", F.lit(0)) + F.coalesce("sparse", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_group))
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(of, g, s, dense, sparse): the sums of ``pair_sums`` over all kept terms of a language, for every two of its sources."""
    tiles = groups.groupBy("lang").agg((F.floor(F.max("at") / TILE) + 1).cast("int").alias("tiles"))
    held = shares.groupBy("lang").agg(F.count("*").alias("rows"))
    parts = cut(tiles.join(held, "lang").select("lang", "tiles", F.ceil(F.col("rows") / PART).cast("int").alias("parts")))
    width = parts.agg(F.sum(F.octet_length("lang") + 60)).head()[0] or 0
    tile = F.floor(F.col("at") / TILE).cast("int")
    each = shares.join(small_side(parts, 1, width), "lang").select("lang", "tiles", F.pmod(F.xxhash64("term"), F.col("parts")).alias("part"), "term", "at", "p", tile.alias("tile"))
    # a tile of sources meets every other tile; where there is one tile, nothing is told twice
    each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    each = each.select("lang", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "part", "term", "at", "p")
    # the base shares of the sources of both tiles stand beside the postings, as rows without a term
    keys = each.select("lang", "i", "j", "part").distinct()
    of_tile = groups.select("lang", F.col("at").alias("at"), F.col("base").alias("p"), tile.alias("tile"))
    keys = keys.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j"))))
    bases = keys.join(of_tile, ["lang", "tile"]).select("lang", "i", "j", "part", F.lit(None).cast("string").alias("term"), "at", "p")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, i, j, _ = key
        plain = pdf["term"].isna().to_numpy()
        own = pdf[plain].sort_values("at")
        sources, base = own["at"].to_numpy(), own["p"].to_numpy()
        rest = pdf[~plain]
        at = np.searchsorted(sources, rest["at"].to_numpy())
        dense, sparse = pair_sums(pd.factorize(rest["term"])[0], at, rest["p"].to_numpy(), base)
        g, s = np.nonzero((dense != 0) | (sparse != 0))
        if i != j:  # pairs inside a tile belong to that tile's own work
            across = (sources[g] // TILE) != (sources[s] // TILE)
            g, s = g[across], s[across]
        return pd.DataFrame({"of": lang, "g": sources[g], "s": sources[s], "dense": dense[g, s], "sparse": sparse[g, s]})

    found = each.unionByName(bases).groupBy("lang", "i", "j", "part").applyInPandas(run, T.StructType.fromDDL("of string, g int, s int, dense long, sparse long"))
    return found.groupBy("of", "g", "s").agg(F.sum("dense").alias("dense"), F.sum("sparse").alias("sparse"))
