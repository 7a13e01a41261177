"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` bytes that cover its whole text. A passage is encoded from what
kinds of bytes it holds, which kind follows which, and how much of it was seen before in the document. A gated
attention (tanh times sigmoid) learned from document labels alone weighs the passages; the score is the logistic of
the weighted mean of their codes. The network is a fixed few thousand numbers, so sending it to every task is
bounded; labels come from a bounded sample of labelled rows (``max_labelled``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, labelled_sample, map_beside, one_text_an_id, released, small_batches

PASSAGE = 512
#: Passages that are encoded at a time. A text's own memory is its bytes, 8 bytes a word and its passages' codes.
BLOCK = 1024
#: Passages that the fit takes of all labelled texts together, some 430 bytes each: of a long text evenly from the whole of it.
MAX_PASSAGES = 300_000
CODE, GATE = 24, 12

#: The kinds of bytes. Letters, digits and white space are kinds; of the signs, those that noise is made of are their own.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "#", "$%&*", "|", "<>{}[]\\^~`=", "-_/'\"()+@"]
N_KINDS = len(_KINDS) + 2
_KIND_OF = np.full(256, N_KINDS - 1, dtype=np.int32)
_KIND_OF[128:] = N_KINDS - 2
for _i, _s in enumerate(_KINDS):
    _KIND_OF[np.frombuffer(_s.encode(), dtype=np.uint8)] = _i
WIDTH = N_KINDS + N_KINDS * N_KINDS + 3

_MIX = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_WINDOW = 4


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text). An empty text has one passage, all zero."""
    counts = np.maximum(1, -(-np.array([len(t) for t in texts], dtype=np.int64) // PASSAGE))
    out = np.zeros((int(counts.sum()), WIDTH), dtype=np.float32)
    short = [i for i, t in enumerate(texts) if len(t) <= BLOCK * PASSAGE]
    first = np.cumsum(counts) - counts
    if short:
        rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in short])
        out[rows] = _encode([texts[i] for i in short], counts[short])
    for i in set(range(len(texts))).difference(short):
        _encode_long(texts[i], out[first[i] : first[i] + counts[i]])
    np.sqrt(out, out=out)  # shares near zero tell most
    return out, counts


def _shares(out: np.ndarray, kind: np.ndarray, pair: np.ndarray, passage: np.ndarray) -> None:
    """Fills in the shares of kinds and of neighbours, ``BLOCK`` passages at a time."""
    n = np.bincount(passage, minlength=len(out)).clip(1)
    for lo in range(0, len(out), BLOCK):
        a, b = np.searchsorted(passage, [lo, lo + BLOCK])
        m = min(BLOCK, len(out) - lo)
        local = passage[a:b] - lo
        out[lo : lo + m, :N_KINDS] = np.bincount(local * N_KINDS + kind[a:b], minlength=m * N_KINDS).reshape(m, -1)
        out[lo : lo + m, N_KINDS : N_KINDS * (N_KINDS + 1)] = np.bincount(local * N_KINDS**2 + pair[a:b], minlength=m * N_KINDS**2).reshape(m, -1)
    out[:, :-3] /= n[:, None]


def _encode(texts: list[bytes], counts: np.ndarray) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begins = np.cumsum(sizes) - sizes
    out = np.zeros((int(counts.sum()), WIDTH), dtype=np.float32)
    if not len(buf):
        return out
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    passage = (np.cumsum(counts) - counts)[doc] + (np.arange(len(buf), dtype=np.int64) - begins[doc]) // PASSAGE
    kind = _KIND_OF[buf]
    pair = np.empty(len(buf), dtype=np.int64)
    pair[0], pair[1:] = 0, kind[:-1] * N_KINDS + kind[1:]
    pair[begins[sizes > 0]] = kind[begins[sizes > 0]] * (N_KINDS + 1)
    _shares(out, kind, pair, passage)
    gap = (kind == 3) | (kind == 4)
    edge = np.empty(len(buf), dtype=bool)
    edge[0], edge[1:] = True, gap[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(edge & ~gap)
    if len(start):
        word = np.cumsum(edge & ~gap) - 1
        inside = np.flatnonzero(~gap)
        hashes = np.add.reduceat(_values(buf[inside], inside - start[word[inside]]), np.searchsorted(inside, start))
        out[:, -3:] = _seen_before(hashes, doc[start], passage[start], np.bincount(passage[inside], minlength=len(out)), len(out))
    return out


def _encode_long(text: bytes, out: np.ndarray) -> None:
    """``_encode`` for one long text, a block of passages after the other, so that no array has more numbers than a block has bytes."""
    buf = np.frombuffer(text, dtype=np.uint8)
    hashes: list[np.ndarray] = []
    begun: list[np.ndarray] = []
    letters = np.zeros(len(out), dtype=np.int64)
    before, run = -1, 0  # the kind before this block, and how much of a word that is not yet over was seen
    for lo in range(0, len(out), BLOCK):
        part = buf[lo * PASSAGE : (lo + BLOCK) * PASSAGE]
        kind = _KIND_OF[part]
        passage = np.arange(len(part)) // PASSAGE
        pair = np.empty(len(part), dtype=np.int64)
        pair[0], pair[1:] = (kind[0] if before < 0 else before) * N_KINDS + kind[0], kind[:-1] * N_KINDS + kind[1:]
        here = out[lo : lo + BLOCK]
        _shares(here, kind, pair, passage)
        gap = (kind == 3) | (kind == 4)
        edge = np.empty(len(part), dtype=bool)
        edge[0], edge[1:] = before < 0 or before in (3, 4), gap[:-1]
        start = np.flatnonzero(edge & ~gap)
        inside = np.flatnonzero(~gap)
        letters[lo : lo + BLOCK] = np.bincount(passage[inside], minlength=len(here))
        head = int(start[0]) if len(start) else len(part)
        rest = int(np.searchsorted(inside, head))  # of the word that was under way
        if run and rest:
            hashes[-1][-1:] += _values(part[inside[:rest]], run + inside[:rest]).sum(dtype=np.uint64, keepdims=True)
        if len(start):
            word = np.cumsum(edge & ~gap) - 1
            own = inside[rest:]
            hashes.append(np.add.reduceat(_values(part[own], own - start[word[own]]), np.searchsorted(own, start)))
            begun.append((passage[start] + lo).astype(np.int32))
        run = 0 if gap[-1] else (len(part) - int(start[-1]) if len(start) else run + len(part))
        before = int(kind[-1])
    if hashes:
        words = np.concatenate(hashes)
        out[:, -3:] = _seen_before(words, np.zeros(len(words), dtype=np.int32), np.concatenate(begun), letters, len(out))


def _values(signs: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What each sign adds to the hash of its word."""
    return (signs.astype(np.uint64) + np.uint64(1)) * _MIX[place & 63]


def _seen_before(hashes: np.ndarray, d: np.ndarray, p: np.ndarray, letters: np.ndarray, n: int) -> np.ndarray:
    """Of each passage: the share of words, and of 4-word windows, that the document had before; the mean word length / 64.

    Of each word: its hash, document and passage; ``letters`` are the signs of words of each passage.
    """
    hashes = hashes ^ (hashes >> np.uint64(29))
    out = np.zeros((n, 3), dtype=np.float32)
    windows = hashes * _MIX[0]
    for k in range(1, _WINDOW):
        windows[:-k] += hashes[k:] * _MIX[k]
    words = np.bincount(p, minlength=n).clip(1)
    for col, h in ((0, hashes), (1, windows)):
        key = h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        repeated = np.ones(len(key), dtype=bool)
        repeated[np.unique(key, return_index=True)[1]] = False
        out[:, col] = np.bincount(p, weights=repeated, minlength=n) / words
    out[:, 2] = letters / words / 64
    return out.clip(0, 1)


def _forward(w: dict, x: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple:
    h = np.tanh((x - w["mean"]) * w["scale"] @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    raw = (t * s) @ w["a"]
    top = np.repeat(np.maximum.reduceat(raw, first), counts)
    weight = np.exp(raw - top)
    weight /= np.repeat(np.add.reduceat(weight, first), counts)
    z = np.add.reduceat(h * weight[:, None], first)
    return h, t, s, weight, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))


def score(w: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(score, largest attention weight) of each text."""
    x, counts = encode(texts)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    *_, weight, _, p = _forward(w, x, first, counts)
    return p.astype(np.float64), np.maximum.reduceat(weight, first).astype(np.float64)


def gradients(w: dict, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross-entropy of bags ``counts`` of passages ``x`` with labels ``y``."""
    first = np.cumsum(counts) - counts
    h, t, s, weight, z, p = _forward(w, x, first, counts)
    g = ((p - y) / len(y)).astype(x.dtype)
    gz = np.repeat(g[:, None] * w["c"], counts, axis=0)
    ga = (gz * h).sum(1)
    graw = weight * (ga - np.repeat(np.add.reduceat(weight * ga, first), counts))
    gt, gs = graw[:, None] * w["a"] * s * (1 - t * t), graw[:, None] * w["a"] * t * s * (1 - s)
    pre = (gz * weight[:, None] + gt @ w["V"].T + gs @ w["U"].T) * (1 - h * h)
    scaled = (x - w["mean"]) * w["scale"]
    return {"E": scaled.T @ pre, "e": pre.sum(0), "V": h.T @ gt, "U": h.T @ gs, "a": (t * s).T @ graw, "c": z.T @ g, "d": g.sum(keepdims=True)}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 30, seed: int = 0) -> dict:
    """The network, by Adam on the cross-entropy of document labels. With one label only, that label's share is the score."""
    rng = np.random.default_rng(seed)
    width = x.shape[1] if len(x) else WIDTH
    w = {k: rng.normal(0, s, shape).astype(np.float32) for k, s, shape in (("E", width**-0.5, (width, CODE)), ("V", 0.2, (CODE, GATE)), ("U", 0.2, (CODE, GATE)), ("a", 0.2, GATE), ("c", 0.2, CODE))}
    w |= {"e": np.zeros(CODE, np.float32), "d": np.zeros(1, np.float32), "mean": np.zeros(width, np.float32), "scale": np.ones(width, np.float32)}
    share = (y.sum() + 1) / (len(y) + 2)
    w["d"][0] = np.log(share / (1 - share))
    if len(y) < 2 or y.min() == y.max():
        w["c"][:] = 0
        return w
    w["mean"], w["scale"] = x.mean(0), 1 / (x.std(0) + 0.02)
    start = np.concatenate([[0], np.cumsum(counts)])
    learned = ("E", "e", "V", "U", "a", "c", "d")
    m, v, step = {k: np.zeros_like(w[k]) for k in learned}, {k: np.zeros_like(w[k]) for k in learned}, 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in part])
            grads = gradients(w, x[rows], counts[part], y[part])
            step += 1
            rate = 0.003 * (1 - epoch / epochs) + 1e-4
            for k in learned:
                grad = grads[k] + 1e-4 * w[k] * (k not in "ed")
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def _bags(texts: list[bytes], most: int) -> list[np.ndarray]:
    """The passages of each text for the fit: all, or of a long text ``most`` evenly from its whole length."""
    x, counts = encode(texts)
    parts = np.split(x.astype(np.float16), np.cumsum(counts)[:-1])
    return [b if len(b) <= most else b[np.linspace(0, len(b) - 1, most).astype(np.int64)] for b in parts]


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 4000, max_passages: int = MAX_PASSAGES) -> dict:
    """The network, fitted on at most about ``max_labelled`` rows of ``labels`` for which ``usable`` holds, one text an id.

    What comes to the driver is at most about ``max_passages`` passages, whatever the ids and the lengths of the texts.
    """
    sample = labelled_sample(labels, id_col, label_col, usable, max_labelled)
    rows = one_text_an_id(docs, id_col, text_col, sample).select(F.col("_id").cast("string").alias("_id"), F.col("_t").cast("binary").alias("_t"), "_y")
    most = max(1, max_passages // max(1, max_labelled))
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            bags = [bag for part in chunks(pdf["_t"].tolist()) for bag in _bags(part, most)]
            yield pd.DataFrame({"id": pdf["_id"], "y": pdf["_y"], "n": [len(b) for b in bags], "x": [b.tobytes() for b in bags]})

    got = rows.mapInPandas(run, "id string, y int, n long, x binary").toPandas().sort_values(["id", "n"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit(x, got["n"].to_numpy(), got["y"].to_numpy())


def classify(docs: DataFrame, network: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, attention): one row per input row; score is the probability of label 1, attention the largest weight of a passage.

    Defined cases: null and empty texts are one passage without anything in it and get its score; repeated rows give
    a row each; an empty table gives an empty result; other columns are neither read nor kept. A text is scored whole:
    a passage's codes (some 850 bytes) for each 512 bytes of it, besides what ``encode`` holds.
    """
    small_batches(docs.sparkSession)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("attention", T.DoubleType())]

    def run(batches):
        for pdf in batches:
            p, a = map(np.concatenate, zip(*(score(network, part) for part in chunks(pdf["_t"].tolist())), strict=True))
            yield pd.DataFrame({"score": p, "attention": a})

    return map_beside(docs, id_col, [F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_t")], released(run), fields)


def score_column(docs: DataFrame, network: dict, text_col: str = "text") -> Column:
    """The score of ``text_col`` as a column, for filters that keep the other columns."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([p for part in chunks(texts.tolist()) for p in score(network, part)[0]], dtype=float)

    return run(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
