"""LM scoring by masked pseudo-likelihood.

A small network predicts every word of a text from the words before and after it; the sum of the conditional
log-probabilities scores the text. Words are counted over all documents with Spark; the most frequent ones are
tokens, any other word is one of ``SHAPES`` shape tokens. Scoring gives every rare word its probability within its
shape besides, from the counts of all words, which stay in a Spark table joined by word. A token is a pair (class, member), predicted one after the
other, so the distribution over all tokens is exact at the cost of two short softmaxes.

Training covers all documents: every partition starts from the same network and walks over its own texts, predicting
every position (a word is never an input of its own prediction, so nothing is masked); the networks are averaged,
weighted by positions, and the next round starts from the average. So the network, and with it the scores, depend a
little on how the table is dealt out to partitions: the same files and settings give the same scores but for rounding,
another layout gives others of the same kind. What is gathered grows with the input (the count of every word, one network a partition);
what is sent to the tasks is the vocabulary of the network and the network, both of fixed size.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, map_beside, small_batches

VOCABULARY = 1024
SHAPES = 32
MEMBERS = 32
REACH = 2  # words on either side
WIDTH, HIDDEN = 16, 32
STEP = 1024  # positions of a training step
SUMS = 8  # tasks that add up the networks of all partitions
BLOCK = 4096  # positions scored at a time, few enough for the caches
#: The most frequent words outside the vocabulary that are told to the tasks, and the characters such a word may have: 8 MB at most.
HEAD, HEAD_CHARS = 1 << 16, 32
AROUND = np.r_[-REACH:0, 1 : REACH + 1]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shape(word: str) -> int:
    """The shape token of a rare word: its length, whether it is letters only, and whether ASCII."""
    return 4 * min((len(word) - 1) // 2, 7) + 2 * word.isalpha() + word.isascii()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, s, n): the shape of each word and how often it occurs in all documents, written once. Its rows grow with the corpus and stay in Spark."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            seen: Counter = Counter()
            for t in pdf["_t"]:
                seen.update(words_of(t))
            yield pd.DataFrame({"w": pd.Series(list(seen), dtype=object), "s": [shape(w) for w in seen], "n": list(seen.values())})

    parts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInPandas(run, "w string, s int, n long")
    return cut(parts.groupBy("w", "s").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY, counts: DataFrame | None = None) -> dict[str, int]:
    """The most frequent words of all documents, by count, then word; ``SHAPES`` places are left for rare words."""
    counts = word_counts(docs, text_col) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "w").limit(size - SHAPES).collect()
    return {r["w"]: i for i, r in enumerate(top)}


class Tokens(dict):
    """Token by word: the vocabulary, and rare words as they are met, up to a bound on memory that changes no result.

    Words that are ``told`` have codes of their own beyond the pad; ``tokens`` and ``shares`` give, by code, the token and the told logarithm.
    """

    def __init__(self, vocab: dict[str, int], size: int = VOCABULARY, most: int = 300_000, told: dict[str, float] | None = None):
        super().__init__(vocab)
        self.rare, self.most = size - SHAPES, most
        told = told or {}
        self.update(zip(told, range(size + 1, size + 1 + len(told)), strict=True))
        self.tokens = np.r_[np.arange(size + 1), np.array([self.rare + shape(w) for w in told], dtype=np.int64)]
        self.shares = np.r_[np.zeros(size + 1), np.array(list(told.values()), dtype=np.float64)]

    def __missing__(self, word: str) -> int:
        token = self.rare + shape(word)
        if len(self) < self.most:
            self[word] = token
        return token


def codes(texts: list[list[str]], known: Tokens, size: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all texts' words with ``REACH`` pads before, between and after them, number of words of each text)."""
    pads = np.full(REACH, size, dtype=np.int64)
    parts = [pads]
    for words in texts:
        if words:
            parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        parts.append(pads)
    return np.concatenate(parts), np.array([len(words) for words in texts], dtype=np.int64)


def tokens(texts: list[str], known: Tokens, size: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` of texts, as tokens."""
    found, counts = codes([words_of(t) if t else [] for t in texts], known, size)
    return known.tokens[found], counts


class Room:
    """Arrays that are used again at every step; new ones would cost the system's pages each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple, kind) -> np.ndarray:
        held = self.held.get(name)
        if held is None or len(held) < shape[0] or held.shape[1:] != shape[1:] or held.dtype != kind:
            held = self.held[name] = np.empty(shape, dtype=kind)
        return held[: shape[0]]


@dataclass
class Network:
    """The numbers of the network; ``flat`` and ``of`` turn them into one vector and back."""

    p: dict[str, np.ndarray]

    @staticmethod
    def shapes(size: int = VOCABULARY) -> dict[str, tuple]:
        classes = -(-size // MEMBERS)
        return {"E": (size + 1, WIDTH), "W": (2 * REACH * WIDTH, HIDDEN), "w": (HIDDEN,), "A": (HIDDEN, classes), "a": (classes,), "B": (HIDDEN, MEMBERS), "C": (classes, MEMBERS)}

    @classmethod
    def new(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return cls({k: (rng.normal(0, 0.1 if k == "E" else s[0] ** -0.5, s) if len(s) > 1 and k != "C" else np.zeros(s)).astype(np.float32) for k, s in cls.shapes().items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        return cls.over(np.array(flat, dtype=np.float32))

    @classmethod
    def over(cls, flat: np.ndarray) -> Network:
        """The network whose arrays are views of ``flat``."""
        out, at = {}, 0
        for k, s in cls.shapes().items():
            n = int(np.prod(s))
            out[k] = flat[at : at + n].reshape(s)
            at += n
        return cls(out)

    def output(self) -> np.ndarray:
        """What leads from a hidden layer, with the class of the token beside it as zeros and a one, to the logits of all classes and of the class's members."""
        classes = len(self.p["a"])
        return np.block([[self.p["A"], self.p["B"]], [np.broadcast_to(self.p["a"], (classes, classes)), self.p["C"]]])

    def tables(self) -> list[tuple[int, np.ndarray]]:
        """(offset, what a token there adds to the hidden layer) for each place around a position."""
        return [(o, self.p["E"] @ self.p["W"][k * WIDTH : (k + 1) * WIDTH]) for k, o in enumerate(AROUND)]

    def bound(self) -> float:
        """What no logit is above: the hidden layer is within 1, so sums of weights tell. Only large logits need their maximum taken away."""
        return max(np.abs(self.p["A"]).sum(0).max() + np.abs(self.p["a"]).max(), np.abs(self.p["B"]).sum(0).max() + np.abs(self.p["C"]).max())

    def log_prob(self, stream: np.ndarray, at: np.ndarray, tables: list | None = None, room: Room | None = None) -> np.ndarray:
        """The log-probability of the token at each of the positions ``at``, given the tokens on both sides."""
        room, n, classes = Room() if room is None else room, len(at), len(self.p["a"])
        t = self.p["W"].dtype
        hidden, part = room("hidden", (n, HIDDEN), t), room("part", (n, HIDDEN), t)
        hidden[:] = self.p["w"]
        for offset, table in tables or self.tables():
            hidden += np.take(table, stream[at + offset], axis=0, out=part, mode="clip")
        logits, kind, member = self._logits(stream[at], hidden, room)
        rows = np.arange(n)
        total = logits[rows, kind].astype(np.float64) + logits[rows, classes + member]
        if self.bound() > 80:
            total -= _less_most(logits, classes)
        np.exp(logits, out=logits)
        return total - np.log(logits @ _halves(classes, t)).sum(axis=1, dtype=np.float64)

    def _logits(self, target: np.ndarray, hidden: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits of classes and of the target's class's members side by side, class, member); the layer itself is in ``room`` as ``layer``."""
        n, classes, t = len(target), len(self.p["a"]), hidden.dtype
        kind, member = np.divmod(target, MEMBERS)
        layer = room("layer", (n, HIDDEN + classes), t)
        np.tanh(hidden, out=layer[:, :HIDDEN])
        layer[:, HIDDEN:] = 0
        layer[np.arange(n), HIDDEN + kind] = 1
        return np.matmul(layer, self.output(), out=room("logits", (n, classes + MEMBERS), t)), kind, member

    def gradients(self, stream: np.ndarray, at: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability at the positions ``at``."""
        room, n, classes = Room() if room is None else room, len(at), len(self.p["a"])
        t = self.p["W"].dtype
        context = stream[at[:, None] + AROUND]
        x = np.take(self.p["E"], context, axis=0, out=room("x", (n, 2 * REACH, WIDTH), t), mode="clip").reshape(n, -1)
        hidden = np.matmul(x, self.p["W"], out=room("hidden", (n, HIDDEN), t))
        hidden += self.p["w"]
        g, kind, member = self._logits(stream[at], hidden, room)
        layer = room("layer", (n, HIDDEN + classes), t)
        if self.bound() > 80:
            _less_most(g, classes)
        np.exp(g, out=g)
        share = 1 / (g @ _halves(classes, t) * t.type(n))  # softmax over both halves, divided by the positions, less the target
        g[:, :classes] *= share[:, :1]
        g[:, classes:] *= share[:, 1:]
        rows = np.arange(n)
        g[rows, kind] -= t.type(1 / n)
        g[rows, classes + member] -= t.type(1 / n)
        out = layer.T @ g
        gh = np.matmul(g, np.hstack([self.p["A"], self.p["B"]]).T, out=hidden)
        slope = np.square(layer[:, :HIDDEN], out=room("part", (n, HIDDEN), t))
        gh *= np.subtract(1, slope, out=slope)
        gx = np.matmul(gh, self.p["W"].T, out=room("gx", (n, 2 * REACH * WIDTH), t))
        ge = _summed(context.ravel(), gx.reshape(-1, WIDTH), self.p["E"])
        return {"E": ge, "W": x.T @ gh, "w": gh.sum(0), "A": out[:HIDDEN, :classes], "a": out[HIDDEN:, :classes].sum(0), "B": out[:HIDDEN, classes:], "C": out[HIDDEN:, classes:]}


def _halves(classes: int, kind) -> np.ndarray:
    """Adds up the logits of classes and those of members."""
    return np.repeat(np.eye(2, dtype=kind), (classes, MEMBERS), axis=0)


def _less_most(logits: np.ndarray, classes: int) -> np.ndarray:
    """Takes its largest value away from either half of each row; the sum of both."""
    total = np.zeros(len(logits))
    for half in (logits[:, :classes], logits[:, classes:]):
        most = half.max(axis=1, keepdims=True)
        half -= most
        total += most[:, 0]
    return total


def _summed(rows: np.ndarray, values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Values added up by row, in the shape and type of ``like``."""
    at = (rows * like.shape[1])[:, None] + np.arange(like.shape[1])
    return np.bincount(at.ravel(), weights=values.ravel(), minlength=like.size).reshape(like.shape).astype(like.dtype)


class Walk:
    """Adam over the texts of one partition."""

    def __init__(self, network: Network, seed: int, rate: float = 0.004):
        self.all = network.flat()  # of which the network's arrays are views
        self.net = Network.over(self.all)
        self.m, self.v, self.g, self.by = (np.zeros_like(self.all) for _ in range(4))
        self.room, self.step, self.seen, self.rate, self.rng = Room(), 0, 0, rate, np.random.default_rng(seed)

    def texts(self, texts: list[str], known: Tokens) -> None:
        self.stream(tokens(texts, known)[0])

    def stream(self, stream: np.ndarray) -> None:
        """Over the positions of a stream of tokens with pads between the texts, in an order by chance."""
        real = np.flatnonzero(stream < VOCABULARY)
        at = self.rng.permutation(real)
        for lo in range(0, len(at), STEP):
            part = at[lo : lo + STEP]
            self.step += 1
            found = self.net.gradients(stream, part, self.room)
            g, by = np.concatenate([found[k].ravel() for k in Network.shapes()], out=self.g), self.by
            self.m *= 0.9
            self.m += np.multiply(g, 0.1, out=by)
            self.v *= 0.99
            np.square(g, out=by)
            by *= 0.01
            self.v += by
            np.divide(self.v, 1 - 0.99**self.step, out=by)
            np.sqrt(by, out=by)
            by += 1e-8
            np.divide(self.m, by, out=by)
            by *= self.rate / (1 - 0.9**self.step)
            self.all -= by
        self.seen += len(at)


def train(docs: DataFrame, vocab: dict[str, int], text_col: str = "text", rounds: int = 2) -> Network:
    """The network after ``rounds`` walks over all documents. Without any word it is the one training starts from."""
    small_batches(docs.sparkSession)
    network = Network.new()
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_t"))

    def encode(batches):
        known = Tokens(vocab)
        for pdf in batches:
            yield pd.DataFrame({"b": [tokens(part, known)[0].astype(np.int16).tobytes() for part in chunks(pdf["_t"].tolist())]})

    streams = cut(texts.mapInPandas(encode, "b binary"))  # a third of the texts, made once for all rounds
    for r in range(rounds):
        start = network

        def run(batches, start=start, r=r):
            walk = Walk(start, seed=r)
            for pdf in batches:
                for b in pdf["b"]:
                    walk.stream(np.frombuffer(b, dtype=np.int16).astype(np.int64))
            if walk.seen:
                yield pd.DataFrame({"n": [walk.seen], "v": [walk.net.flat()]})

        parts = streams.mapInPandas(run, "n long, v array<float>")
        sums = parts.repartition(SUMS).mapInPandas(_added, "n long, v array<double>").collect()  # a network's numbers in each of SUMS rows
        if sums:
            network = Network.of(sum(np.array(r["v"]) for r in sums) / sum(r["n"] for r in sums))
    return network


def _added(batches):
    """The sum of the networks of a partition, each weighted by its positions; one at a time is held."""
    n, total = 0, None
    for pdf in batches:
        for k, v in zip(pdf["n"], pdf["v"], strict=True):
            n, total = n + int(k), int(k) * np.asarray(v, dtype=np.float64) + (0 if total is None else total)
    if n:
        yield pd.DataFrame({"n": [n], "v": [total]})


def score_words(texts: list[list[str]], known: Tokens, network: Network, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, summed log-probability with what is told of rare words, of each text; codes of all words)."""
    room = Room() if room is None else room
    found, counts = codes(texts, known)
    real = np.flatnonzero(found != VOCABULARY)
    stream, found = known.tokens[found], found[real]
    tables = network.tables()
    logp = np.concatenate([network.log_prob(stream, real[lo : lo + BLOCK], tables, room) for lo in range(0, len(real), BLOCK)] or [np.zeros(0)])
    logp += known.shares[found]
    return counts, np.bincount(np.repeat(np.arange(len(texts)), counts), weights=logp, minlength=len(texts)), found


def score_texts(texts: list[str], known: Tokens, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens, summed log-probability) of each text."""
    return score_words([words_of(t) if t else [] for t in texts], known, network)[:2]


def untold(texts: list[list[str]], counts: np.ndarray, found: np.ndarray) -> list[Counter]:
    """How often each text has each of the rare words that were not told; ``found`` are the codes of all words."""
    words = list(chain.from_iterable(texts))
    at = np.flatnonzero((found >= VOCABULARY - SHAPES) & (found < VOCABULARY))
    ends = np.searchsorted(at, np.r_[0, np.cumsum(counts)])
    rare = [words[i] for i in at]
    return [Counter(rare[lo:hi]) for lo, hi in pairwise(ends)]


def score(docs: DataFrame, vocab: dict[str, int], network: Network, id_col: str = "doc_id", text_col: str = "text", counts: DataFrame | None = None, head: int = HEAD) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob): one row per input row; the natural logarithm, summed and by token.

    With ``counts`` (of ``word_counts``) a rare word has the probability of its shape token times its share of all
    occurrences of rare words of that shape; without, that of its shape token. The ``head`` most frequent rare words are
    told to the tasks, the others are joined by word, so no frequent word is a key of the join; scores are the same for
    any head but for rounding. Defined cases: a word that was never
    counted has a share of one in all rare occurrences and one; null and empty texts, and texts of white space, have no tokens, log_prob 0 and a
    null mean; repeated rows give a row each, with the same score; an empty table gives an empty result; other
    columns are neither read nor kept.
    """
    small_batches(docs.sparkSession)
    inner = counts is not None
    rare_words, unseen = within_shape(counts, vocab) if inner else (None, 0.0)
    told = {r["w"]: r["lp"] for r in rare_words.where(F.length("w") <= HEAD_CHARS).orderBy(F.desc("n"), "w").limit(head).collect()} if inner else {}
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())]
    if inner:
        fields += [T.StructField("_row", T.LongType()), T.StructField("_w", T.ArrayType(T.StringType())), T.StructField("_n", T.ArrayType(T.LongType()))]

    def run(batches):
        known, room = Tokens(vocab, told=told), Room()
        for pdf in batches:
            counted, total, rare = [], [], []
            for part in chunks(pdf["_t"].tolist()):
                words = [words_of(t) for t in part]
                n, sums, found = score_words(words, known, network, room)
                counted.append(n)
                total.append(sums)
                rare += untold(words, n, found) if inner else []
            out = {"n_tokens": np.concatenate(counted), "log_prob": np.concatenate(total)}
            if inner:
                out |= {"_row": pdf["_row"], "_w": pd.Series([list(c) for c in rare], dtype=object), "_n": pd.Series([list(c.values()) for c in rare], dtype=object)}
            yield pd.DataFrame(out)

    out = map_beside(docs, id_col, [F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *([F.monotonically_increasing_id().alias("_row")] if inner else [])], run, fields)
    if inner:
        out = with_rare(cut(out), rare_words, unseen)
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def within_shape(counts: DataFrame, vocab: dict[str, int]) -> tuple[DataFrame, float]:
    """(w, n, lp): of every counted word outside ``vocab`` the logarithm of its share of all occurrences of such words of its shape; and that of a word never counted."""
    rare = counts.where(~F.col("w").isin(list(vocab))) if vocab else counts
    sums = {r["s"]: r["n"] for r in rare.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # 32 at most
    total = F.element_at(F.create_map(*(F.lit(x) for s in range(SHAPES) for x in (s, max(sums.get(s, 0), 1)))), F.col("s"))
    return rare.select("w", "n", (F.log("n") - F.log(total)).alias("lp")), -math.log(1 + sum(sums.values()))


def with_rare(scored: DataFrame, rare: DataFrame, unseen: float) -> DataFrame:
    """``scored`` with the log-probability within its shape of every rare word that the tasks were not told; a join by word."""
    words = scored.select("_row", F.explode(F.arrays_zip("_w", "_n")).alias("x")).select("_row", F.col("x._w").alias("w"), F.col("x._n").alias("m"))
    added = words.join(rare.select("w", "lp"), "w", "left").groupBy("_row").agg(F.sum(F.col("m") * F.coalesce("lp", F.lit(unseen))).alias("_more"))
    return scored.drop("_w", "_n").join(added, "_row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("_more", F.lit(0.0))).drop("_row", "_more")
