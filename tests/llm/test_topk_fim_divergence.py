"""Operators 11 to 13 against brute force: ties, repeated rows, nulls, long texts, empty tables, other columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import divergence, fim, topk

VECTORS = "vec_id long, embedding array<float>, rank string, q int, label int"


def brute_top(rows: list, k: int, asked) -> list:
    """(query_id, rank, vec_id, score) by looking at every pair of rows."""
    taken = [(i, [math.floor(64 * float(np.float32(v))) for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for a, (i, x) in enumerate(taken):
        if i is not None and asked(i):
            scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), j is None, j or 0) for b, (j, y) in enumerate(taken) if b != a]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found_top(spark, rows: list, k: int, parts: int, **options) -> list:
    df = spark.createDataFrame([(i, x, "r", 0, 1) for i, x in rows], VECTORS).repartition(parts)
    got = topk.search(df, F.col("vec_id") % 5 == 0, k=k, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed: int, n: int, width: int) -> list:
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize(("lists", "pass_bytes"), [(1, 1 << 20), (2, 1 << 20), (4, 900)])
def test_topk_is_that_of_all_pairs(spark, lists, pass_bytes):
    rows = vectors(1, 90, 6) + [(200 + i, [0.5, -0.25, 0.125, 0.0, 0.0, 1.0]) for i in range(40)] + [(7, None), (5, [float("nan")] * 6), (10, [1.0, None] * 3), (15, [math.inf] * 6)]
    assert found_top(spark, rows, 7, 4, lists=lists, pass_bytes=pass_bytes) == brute_top(rows, 7, lambda i: i % 5 == 0)


def test_topk_ties_repeats_and_null_ids(spark):
    same = [0.25, -0.5, 1.0]
    rows = [(i % 30, same) for i in range(70)] + [(None, same), (None, [2.0, 2.0, 2.0])] + [(40, [0.0, 0.0, 0.0])] * 3 + [(45, [])] + [(60, [1.0])] + vectors(3, 12, 3)
    for parts in (1, 5):
        assert found_top(spark, rows, 4, parts) == brute_top(rows, 4, lambda i: i % 5 == 0)
    assert found_top(spark, rows[:3], 20, 2) == brute_top(rows[:3], 20, lambda i: i % 5 == 0)  # fewer than k


def test_topk_large_components_are_exact(spark):
    rows = [(5, [3.0e7, -1.0e7]), (1, [2.0e7 + 32, 7.0]), (2, [2.0e7, 9.0]), (3, [-2.0e7, 4.0]), (4, [1.0, 1.0])]
    assert found_top(spark, rows, 4, 2) == brute_top(rows, 4, lambda i: i % 5 == 0)
    huge = [(5, [3.0e8]), (1, [2.0e8]), (2, [-2.0e8]), (3, [1.0])]  # beyond what a score can tell
    assert found_top(spark, huge, 2, 1) == [(5, 1, 1, 1 << 62), (5, 2, 3, 64 * 64 * 300_000_000)]


def test_topk_of_nothing(spark):
    assert found_top(spark, [], 3, 1) == [] and found_top(spark, [(1, [1.0]), (2, [2.0])], 3, 1) == []
    assert found_top(spark, [(5, [1.0])], 3, 1) == []


def test_cutoff_is_safe_and_entries_are_sufficient():
    rng = np.random.default_rng(0)
    v, q = rng.integers(-64, 64, (500, 10)), rng.integers(-64, 64, (9, 10))
    parts = topk.partials(v, q, 3)
    whole = q @ v.T
    best = topk.best_scores(parts, np.ones(whole.shape, dtype=np.int64), 5)
    top = -np.sort(-whole, axis=1)[:, :5]
    assert (best[:, 4] <= top[:, 4]).all() and (np.diff(best, axis=1) <= 0).all()
    a, b, score = topk.sufficient(parts, best[:, 4])
    told = set(zip(a.tolist(), b.tolist(), score.tolist(), strict=True))
    assert told == {(i, j, int(whole[i, j])) for i in range(9) for j in range(500) if whole[i, j] >= best[i, 4]}


def brute_fim(doc_id, text: str | None) -> tuple:
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", t
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{suf}<P>{pre}<M>{mid}"
    else:
        form, out = "psm", f"<P>{pre}<S>{suf}<M>{mid}"
    plain = form == "plain"
    return doc_id, len(units), form, None if plain else len(pre), None if plain else len(mid), out, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()


def test_fill_in_middle_is_that_of_plain_cuts(spark):
    rng = random.Random(4)
    signs = ["abc", "Z", "é", "漢", "🙂", " ", "\n", "12", "<", "P>", "<S", ">", "<M", "x<", "́", "-"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    rows = [(2**53 + 2 * i + 1, t, 0, "x") for i, t in enumerate(texts)] + [(None, "some words", 0, "x"), (None, None, 0, "x"), (9, None, 0, "x"), (10, "", 0, "x"), (11, "<P>a", 0, "x"), (12, "long text, " * 60_000, 0, "x"), (13, "é" * 70_000, 0, "x"), (14, "a" * 5000, 0, "x"), (14, "a" * 5000, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    for parts in (1, 3):
        got = sorted((tuple(r) for r in fim.fill_in_middle(df.repartition(parts)).collect()), key=str)
        assert got == sorted((brute_fim(r[0], r[1]) for r in rows), key=str)
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_restore_undoes_both_forms():
    for text in (b"<<<S", b"a<P b<", b">S><", b""):
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                pre, mid, suf = text[:a], text[a:b], text[b:]
                assert fim.restore(b"<P>" + pre + b"<S>" + suf + b"<M>" + mid, "psm") == text
                assert fim.restore(b"<S>" + suf + b"<P>" + pre + b"<M>" + mid, "spm") == text


def brute_divergence(rows: list, least: int, most: int) -> list:
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen, count = Counter(), defaultdict(Counter)
        for other, source, words in docs:
            if other == lang:
                seen.update(set(words))
                count[source].update(words)
        kept = [t for t, d in seen.items() if d >= least]

        def share(of: Counter, kept=kept) -> dict:
            total = sum(of[t] for t in kept)
            return {t: 1 + math.floor(Fraction(10**9 * (of[t] + 5), total + 5 * len(kept))) for t in kept}

        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        for s in p:
            parts = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s], "term": [(q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found)
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked) if part == "pair" or i < most]
    return sorted(out)


@pytest.mark.parametrize(("tile", "part", "held"), [(256, 200_000, 400_000), (3, 40, 20)])
def test_divergence_is_that_of_all_terms(spark, monkeypatch, tile, part, held):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "PART", part)
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(5)
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'é' * (i // 26)}" for i in range(80)]
    rows = [(rng.choice(["en", "de", None]), f"s{rng.randrange(8)}", " ".join(rng.choice(words[: rng.randrange(2, 80)]) for _ in range(rng.randrange(0, 40)))) for _ in range(300)]
    rows += [("en", "none", ""), ("en", None, None), ("few", "a", "one two"), ("few", "b", "Two three"), ("lone", "x", "ÄÖ Foo-bar_baz9qux "), ("en", "s1", "WA wa. Wa\x7fwa")] + [("en", "s2", "wa wb")] * 5
    df = spark.createDataFrame([(i, *r, "k", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, item string, rank int")
    got = sorted(tuple(r) for r in divergence.divergence(df, least_documents=12, top_terms=6).collect())
    assert got == brute_divergence(rows, 12, 6)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(df).collect() == []


def test_heavy_and_light_sums_are_those_of_whole_rows():
    rng = np.random.default_rng(2)
    width, terms = 12, 300
    base = rng.integers(1, 50, width)
    p = np.repeat(base[:, None], terms, axis=1)
    has = rng.random((width, terms)) < rng.random(terms) ** 2
    p[has] = rng.integers(1, 10**9, int(has.sum()))
    at, term = np.nonzero(has)
    whole = np.abs(p[:, None, :] - p[None, :, :]).sum(axis=2) - terms * np.abs(base[:, None] - base[None, :])
    for heavy in (0.0, 0.25, 0.5, 2.0):
        dense, sparse = divergence.pair_sums(term, at, p[at, term], base, heavy)
        none = terms - len(np.unique(term))  # terms without a posting are not told
        assert (dense + sparse == whole).all() and none >= 0
    assert (divergence.pair_sums(term, at, p[at, term], base, 2.0)[0] == 0).all()


def test_long_texts_are_split_at_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "Alpha beta,gamma  delta" * 9
    assert [w for part in divergence.terms_of(text.encode()) for w in part] == [w.encode() for w in re.findall("[a-z]+", text.lower())]
