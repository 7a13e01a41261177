"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that toxic documents of the labelled sample have far more often
than others, counted by document with Spark. A text becomes a few dense numbers: lexicon densities, how near lexicon
words stand to a second person, capitals, punctuation and obfuscation rates. Trees are fitted on the driver on a
bounded sample of labelled rows (``max_labelled``); calibration uses scores of folds that neither the lexicon nor the
trees behind them have seen. What is sent to the tasks is bounded by ``max_terms`` and the number of trees.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, labelled_sample, map_beside, one_text_an_id, small_batches

#: Words for the second person in the four languages of the tables.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
#: Characters that stand for letters in obfuscated words.
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "!": "i", ".": "", "-": "", "_": ""})

_WORD = re.compile(r"\S+")
_EDGES = ".,;:!?\"'()[]{}«»…-"
_ENDS = _EDGES + "#$%&*|"  # signs that noise appends
_MIXED = re.compile(r"[^\W\d_][\d@$*!_.\-]+[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_][ .\-]){3,}[^\W\d_](?!\S)")
BEGINNINGS = (5, 6)
NEAR = 6  # words
FOLDS = 4

FEATURES = (
    "log_words", "word_weight", "word_hits", "word_distinct", "word_most", "begin_weight", "begin_hits", "begin_distinct",
    "near_second", "second", "capitals", "capital_words", "exclaim", "question", "punctuation", "mixed", "unmasked", "spaced", "hits_per_word", "hits_total",
)


def plain_word(raw: str) -> str:
    """A token in lower case, without signs at its edges, obfuscation undone."""
    w = raw.lstrip(_EDGES).rstrip(_ENDS)
    if not w.isalpha() and _MIXED.search(w):
        w = w.translate(_PLAIN)
    return w.lower()


def terms_of(text: str) -> set[str]:
    """The words of a text and their beginnings (marked by a ``^``)."""
    words = {plain_word(w) for w in _WORD.findall(_joined(text))}
    out = {w for w in words if 3 <= len(w) <= 40}
    for n in BEGINNINGS:
        out |= {"^" + w[:n] for w in words if len(w) >= n}
    return out


def _joined(text: str) -> str:
    """The text with letters that were spaced out set together again."""
    return _SPACED.sub(lambda m: re.sub(r"[ .\-]", "", m[0]), text) if " " in text else text


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    begins: dict[str, float] = field(default_factory=dict)


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The numbers of ``FEATURES``; all zero for a text without words."""
    joined = _joined(text)
    raw = _WORD.findall(joined)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    plain = [w if w.isalpha() and w.islower() else plain_word(w) for w in raw]
    words, begins, a, b = lexicon.words, lexicon.begins, *BEGINNINGS
    word_hits = [(i, words[w]) for i, w in enumerate(plain) if w in words]
    begin_hits = [(i, max(begins.get(w[:a], 0.0), begins.get(w[:b], 0.0))) for i, w in enumerate(plain) if w[:a] in begins or w[:b] in begins]
    second = [i for i, w in enumerate(plain) if w in SECOND_PERSON]
    hits = sorted({i for i, _ in word_hits} | {i for i, _ in begin_hits})
    near = 0
    if second and hits:
        s, h = np.array(second), np.array(hits)
        at = np.searchsorted(s, h)
        near = int(np.count_nonzero((np.abs(s[np.minimum(at, len(s) - 1)] - h) <= NEAR) | (np.abs(s[np.maximum(at, 1) - 1] - h) <= NEAR)))
    letters = max(1, len(text) - text.count(" "))
    odd = [w for w in raw if not w.isalpha() and _MIXED.search(w)]
    unmasked = sum(plain_word(w) in words for w in odd)
    upper = sum(1 for w in raw if w.isupper() and len(w) > 1)
    capitals = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    return [
        math.log1p(n), sum(v for _, v in word_hits) / n, len(word_hits) / n, len({plain[i] for i, _ in word_hits}), max((v for _, v in word_hits), default=0.0),
        sum(v for _, v in begin_hits) / n, len(begin_hits) / n, len({plain[i] for i, _ in begin_hits}),
        near / n, len(second) / n, capitals / letters, upper / n, text.count("!") / n, text.count("?") / n, sum(map(text.count, ".,;:")) / n, len(odd) / n, unmasked / n, (len(text) - len(joined)) / n,
        len(hits) / n, len(hits),
    ]


class Trees:
    """Boosted trees of a fixed depth for the logistic loss, on histograms of ``bins`` quantiles."""

    depth, bins = 3, 32

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, l2: float = 1.0) -> Trees:
        n, width = x.shape
        self.base = math.log((y.sum() + 1) / (n - y.sum() + 1))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not n:
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
        raw = np.full(n, self.base)
        for _ in range(rounds if 0 < y.sum() < n else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            inner = (1 << self.depth) - 1
            feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                offset, nodes = (1 << level) - 1, 1 << level
                best = np.zeros(nodes)
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    k = len(cuts[j]) + 1
                    key = (node - offset) * k + binned[:, j]
                    gs = np.bincount(key, weights=g, minlength=nodes * k).reshape(nodes, k).cumsum(axis=1)
                    hs = np.bincount(key, weights=h, minlength=nodes * k).reshape(nodes, k).cumsum(axis=1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(nodes), at]
                    wins = top > best + 1e-9
                    best[wins] = top[wins]
                    feature[offset + np.flatnonzero(wins)] = j
                    limit[offset + np.flatnonzero(wins)] = cuts[j][at[wins]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, weights=g, minlength=1 << self.depth), np.bincount(leaf, weights=h, minlength=1 << self.depth)
            value = -rate * gs / (hs + l2)
            self.trees.append((feature, limit, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the non-decreasing fit of ``y`` by ``raw``: pooled neighbours, one point for each pool."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        pools.append([1.0, float(v), float(r)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: Trees
    at: np.ndarray
    share: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
        raw = self.trees.raw(x)
        # one part in a hundred of the uncalibrated score keeps the order inside a pool
        return (0.99 * np.interp(raw, self.at, self.share) + 0.01 / (1 + np.exp(-raw))).clip(0, 1)


def fit(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, fold: np.ndarray) -> Scorer:
    """Trees on all rows; calibration on scores that each fold gets from what the others taught.

    ``x`` is (row, 1 + FOLDS, feature): features by the lexicon of all rows, then by the lexicon learned without each
    fold. So a row's label is in neither the lexicon nor the trees that give the score it is calibrated with.
    """
    if len(y) < 2 * FOLDS or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        trees = Trees().fit(x[:, 0], y, rounds=0)
        return Scorer(lexicon, trees, np.array([0.0]), np.array([share]))
    unseen = np.empty(len(y))
    for k in range(FOLDS):
        out = fold == k
        unseen[out] = Trees().fit(x[~out, 1 + k], y[~out]).raw(x[out, 1 + k])
    return Scorer(lexicon, Trees().fit(x[:, 0], y), *isotonic(unseen, y))


def learn_lexicons(sample: DataFrame, max_terms: int = 4000, least_documents: int = 4, least_odds: float = 1.5) -> list[Lexicon]:
    """Terms of toxic documents: in ``least_documents`` of them and, in log-odds, ``least_odds`` likelier there.

    The first lexicon is of all rows of ``sample`` (_t, _y, _fold), the others leave one fold out each. Terms are
    counted once, by fold.
    """
    totals = {(r["_y"], r["_fold"]): r["count"] for r in sample.groupBy("_y", "_fold").count().collect()}  # 2 * FOLDS rows

    def run(batches):
        for pdf in batches:
            for (y, fold), part in pdf.groupby(["_y", "_fold"]):
                count: dict[str, int] = {}
                for t in part["_t"]:
                    for term in terms_of(t):
                        count[term] = count.get(term, 0) + 1
                yield pd.DataFrame({"term": list(count), "y": int(y), "fold": int(fold), "n": list(count.values())})

    counts = sample.select("_t", "_y", "_fold").mapInPandas(run, "term string, y int, fold int, n long")

    def seen(y: int, without: int) -> Column:
        return F.sum(F.when((F.col("y") == y) & (F.col("fold") != without), F.col("n")).otherwise(0))

    by_term = counts.groupBy("term").agg(*(seen(y, k).alias(f"n{y}_{k}") for y in (0, 1) for k in range(-1, FOLDS)))
    by_term = cut(by_term.where(F.col("n1_-1") >= least_documents))
    out = []
    for k in range(-1, FOLDS):
        n1, n0 = (sum(n for (v, f), n in totals.items() if v == y and f != k) for y in (1, 0))
        toxic, clean = F.col(f"n1_{k}"), F.col(f"n0_{k}")
        odds = F.log((toxic + 0.5) / (n1 - toxic + 0.5)) - F.log((clean + 0.5) / (n0 - clean + 0.5))
        top = by_term.select("term", toxic.alias("toxic"), odds.alias("odds")).where((F.col("toxic") >= least_documents) & (F.col("odds") >= least_odds))
        rows = top.orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(max_terms).collect()
        out.append(Lexicon({r["term"]: r["odds"] for r in rows if r["term"][0] != "^"}, {r["term"][1:]: r["odds"] for r in rows if r["term"][0] == "^"}))
    return out


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 12000) -> Scorer:
    """The scorer, fitted on at most about ``max_labelled`` rows of ``labels`` for which ``usable`` holds."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, id_col, label_col, usable, max_labelled)
    rows = one_text_an_id(docs, id_col, text_col, sample)
    rows = cut(rows.select("_id", "_t", "_y", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("_fold")))
    lexicons = learn_lexicons(rows)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["_id"], "y": pdf["_y"], "fold": pdf["_fold"], "x": [[v for lexicon in lexicons for v in features(t, lexicon)] for t in pdf["_t"]]})

    got = rows.withColumn("_id", F.col("_id").cast("string")).mapInPandas(run, "id string, y int, fold int, x array<double>").toPandas().sort_values("id", kind="stable")
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), 1 + FOLDS, len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.int64), lexicons[0], got["fold"].to_numpy())


def predict(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per input row; score is the calibrated probability of label 1.

    Defined cases: null and empty texts have all features zero and get the score of that; a null id stays null and
    ids of any type stay as they are; repeated rows give a row each; an empty table gives an empty result; with no label
    or one label only the score is that label's share; a text is scored whole, its words in memory (some 150 bytes a
    word); other columns are neither read nor kept.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"score": scorer.score(pdf["_t"].tolist())})

    return map_beside(docs, id_col, [F.coalesce(F.col(text_col), F.lit("")).alias("_t")], run, [T.StructField("score", T.DoubleType())])
