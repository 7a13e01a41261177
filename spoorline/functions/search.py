"""Full-text matching: token vectors, a three-way query, and a rank that puts short and exact matches first."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = "/._-"


def token_list(*names: Column) -> Column:
    """Lower-case tokens of names in order: first as they are written, then split at slashes and dots. Other signs part words."""
    text = F.regexp_replace(F.concat_ws(" ", *names), r"[^\p{L}\p{N}/._-]", " ")
    both = F.concat_ws(" ", text, F.translate(text, "/.", "  "))
    return F.filter(F.split(F.lower(both), r"\s+"), lambda t: t != "")


def tokens(*names: Column) -> Column:
    """The distinct ones of ``token_list``."""
    return F.array_distinct(token_list(*names))


def query_words(text: str) -> tuple[list[str], list[str]]:
    """(words with the punctuation of paths and hosts, words without any), both in lower case."""
    dropped = "".join(c for c in string.punctuation if c not in KEPT)
    low = text.lower()
    written = [w for w in low.translate({ord(c): " " for c in dropped}).split() if w.strip(string.punctuation)]
    bare = low.translate({ord(c): " " for c in string.punctuation}).split()
    return written, bare


def matches(vector: Column, text: str) -> Column:
    """Whether a token vector has every word of the query, whole or as a beginning, as written or without punctuation."""
    written, bare = query_words(text)

    def every(words: list[str], test) -> Column:
        return reduce(Column.__and__, (test(vector, w) for w in words)) if words else F.lit(False)

    return every(written, F.array_contains) | every(written, _has_beginning) | every(bare, _has_beginning)


def _has_beginning(vector: Column, word: str) -> Column:
    return F.exists(vector, lambda t: t.startswith(word))


def rank(vector: Column, text: str) -> Column:
    """Twice the words found whole plus those found as a beginning, by the number of distinct tokens, in millionths."""
    written, bare = query_words(text)
    words = sorted(set(written) | set(bare))
    points = [F.when(F.array_contains(vector, w), 2).when(_has_beginning(vector, w), 1).otherwise(0) for w in words]
    total = reduce(Column.__add__, points, F.lit(0))
    return F.when(F.size(vector) > 0, F.floor(total * F.lit(1_000_000) / F.size(vector))).otherwise(F.lit(0)).cast("long")
