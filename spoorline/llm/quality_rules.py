"""Quality rules: one Spark projection compiled from a table of thresholds. No user functions, no shuffle.

``measures`` gives the counts of each text, ``verdict`` compiles the table to one boolean column.
Defined cases: a null, empty or blank text has no words, so all its counts but that of symbols are zero and it fails;
repeated rows are judged each on its own; a null id keeps its row; an empty table gives an empty result; other columns
of the input are neither read nor kept, so their names can't clash. A text is one row whatever its length: windows of a
text take memory in proportion to its words (16 bytes a window), in the task that reads it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Frequent function words of the four languages in the tables.
STOP_WORDS = (
    "a and as be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine ist mit nicht sich und von zu "
    "au dans de des elle en est et il la le les pas pour que qui sur un une "
    "al con del el es las lo los no para por se su y"
).split()

#: (rule, measure, per, lowest, highest): lowest <= measure / per <= highest, None where a side is open.
#: A rule whose ``per`` is zero passes; texts without words fail the base rules first.
THRESHOLDS = (
    ("word_length", "word_chars", "n_words", 2.0, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.25),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 0.3),
)

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds at least twice.

    Windows are compared by 64-bit hash. Sorted by (hash, place), equal windows are neighbours; of the places
    found, in order, each covers its three words less those that the next place covers again.
    """
    word_hashes = F.transform(words, lambda w: F.xxhash64(w))

    def places(ws: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))
        )
        return let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w["h"])) == F.size(w), F.array().cast("array<int>")).otherwise(let(F.sort_array(w), _neighbours)),
        )

    covered = let(
        let(word_hashes, places),
        lambda p: F.when(F.size(p) == 0, 0).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda s, j: s + F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3))))
        ),
    )
    return F.when(F.size(words) < 3, 0).otherwise(covered)


def _neighbours(s: Column) -> Column:
    h = s["h"]
    same = let(h, lambda hs: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(hs, j) == F.get(hs, j - 1)) | (F.get(hs, j) == F.get(hs, j + 1))))
    return F.sort_array(F.transform(same, lambda j: F.get(s["i"], j)))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and the counts that the rules read (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col), text.alias("t"), words_of(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    return split.select(
        F.col(id_col),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def verdict(rules=THRESHOLDS) -> Column:
    """The table as one boolean column over the columns of ``measures``; products, so nothing is divided by zero."""

    def one(rule) -> Column:
        _, measure, per, lowest, highest = rule
        sides = [F.col(measure) >= lowest * F.col(per)] if lowest is not None else []
        sides += [F.col(measure) <= highest * F.col(per)] if highest is not None else []
        return (F.col(per) == 0) | reduce(Column.__and__, sides)

    return reduce(Column.__and__, map(one, rules), F.lit(True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """``measures`` with ``base_failed`` (short or repetitive texts) and ``kept`` (not failed, and within every threshold)."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
