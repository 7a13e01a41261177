"""Language identification by multilingual mixture inference.

Every language has a smoothed distribution over hashed byte trigrams of lower-case letters. A text is cut into units
of a few words, and the units' trigram likelihoods go into expectation-maximisation, which estimates the proportions
of the languages in the text. The set of languages is chosen by penalised likelihood: the weakest language goes
while that lowers minus two log-likelihood plus the logarithm of the units for each further language.

The tables have ``BINS`` numbers a language whatever the corpus, so sending them to every task is bounded; they are
fitted on about ``max_per_language`` documents of each language at most.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, cut, map_beside, small_batches, small_side

BINS = 1 << 16
UNIT_WORDS = 4
#: Bytes of texts whose trigrams are held at a time.
BLOCK = 1 << 20
ROUNDS = 12
UNKNOWN = "und"

#: Letters of ASCII in lower case, bytes of other scripts as they are, all else as a gap.
_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, word, text) of every trigram that is not all gap; words are numbered through the batch."""
    sizes = np.array([len(t) + 3 for t in texts], dtype=np.int64)
    buf = _FOLD[np.frombuffer(b"\n \n".join([b"", *texts, b""]), dtype=np.uint8)]  # gaps before the first text too, so that its place in a batch changes nothing
    text = np.concatenate([np.zeros(3, dtype=np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)])
    wide = buf.astype(np.uint32)
    code = np.zeros(len(buf), dtype=np.uint32)
    code[2:] = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    letter = buf != 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    word = np.cumsum(begins) - 1
    keep = letter.copy()  # trigrams that end in a letter, or just after one
    keep[1:] |= letter[:-1]
    keep &= word >= 0
    at = np.flatnonzero(keep)
    return (code[at] & np.uint32(BINS - 1)).astype(np.int64), word[at], text[at]


def _blocks(text: bytes, most: int = BLOCK) -> list[bytes]:
    """A text cut after gaps into blocks of about ``most`` bytes; what has no gap within twice that is cut as it is."""
    out, at = [], 0
    while len(text) - at > most:
        near = text[at + most : at + 2 * most]
        gap = re.search(rb"[^A-Za-z\x80-\xff]", near)
        end = at + most + (gap.end() if gap else len(near))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def _likelihoods(texts: list[bytes], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the likelihood of every unit by language, up to a factor; the text of each). Units are ``UNIT_WORDS`` words of one text."""
    n, languages = len(texts), logp.shape[1]
    code, word, text = grams(texts)
    if not len(code) or not languages:
        return np.zeros((0, languages)), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    word_text = text[starts]
    first_word = np.searchsorted(word_text, np.arange(n))
    unit_of_word = (np.arange(len(starts)) - first_word[word_text]) // UNIT_WORDS
    new = np.r_[True, (unit_of_word[1:] != unit_of_word[:-1]) | (word_text[1:] != word_text[:-1])]
    unit_starts = starts[new]
    like = np.stack([np.add.reduceat(logp[code, k], unit_starts) for k in range(languages)], axis=1)
    return np.exp(like - like.max(axis=1, keepdims=True)), word_text[new].astype(np.int64)


def chunks_of(pieces: list[tuple[int, bytes]], most: int):
    """Runs of pieces of about ``most`` bytes together."""
    part, size = [], 0
    for p in pieces:
        if part and size + len(p[1]) > most:
            yield part
            part, size = [], 0
        part.append(p)
        size += len(p[1])
    if part:
        yield part


def mixture(texts: list[bytes], logp: np.ndarray) -> np.ndarray:
    """The proportions (text by language) of the chosen sets; all zero for a text without units.

    A long text goes by blocks, so beside it only the likelihoods of its units are held.
    """
    n, languages = len(texts), logp.shape[1]
    out = np.zeros((n, languages))
    pieces = [(i, block) for i, t in enumerate(texts) for block in _blocks(t)]
    found = []
    for part in chunks_of(pieces, BLOCK):
        like, of = _likelihoods([block for _, block in part], logp)
        found.append((like, np.array([i for i, _ in part])[of] if len(of) else of))
    like, text = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not len(like):
        return out
    doc, row = np.unique(text, return_inverse=True)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    units = np.diff(np.r_[first, len(row)])

    def em(share: np.ndarray, rows: np.ndarray, row: np.ndarray, first: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = units[rows][:, None]
        for _ in range(ROUNDS):
            r = like * share[row]
            r /= r.sum(axis=1, keepdims=True) + 1e-300
            share = np.add.reduceat(r, first) / count
        return share, np.add.reduceat(np.log((like * share[row]).sum(axis=1) + 1e-300), first)

    active = np.ones((len(doc), languages), dtype=bool)
    live = np.arange(len(doc))
    share, ll = em(np.full((len(doc), languages), 1 / languages), live, row, first, like)
    best = share.copy()
    for _ in range(languages - 1):
        weakest = languages - 1 - np.where(active[live], best[live], np.inf)[:, ::-1].argmin(axis=1)  # of equals the last by name
        mask = active[live].copy()
        mask[np.arange(len(live)), weakest] = False
        place = np.full(len(doc), -1)
        place[live] = np.arange(len(live))
        use = place[row] >= 0
        sub = place[row[use]]
        sub_first = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
        start = np.where(mask, best[live] + 1e-3, 0)
        fewer, ll_fewer = em(start / start.sum(axis=1, keepdims=True), live, sub, sub_first, like[use])
        better = -2 * ll_fewer <= -2 * ll[live] + np.log(np.maximum(units[live], 2))
        chosen = live[better]
        active[chosen], best[chosen], ll[chosen] = mask[better], fewer[better], ll_fewer[better]
        live = chosen
        if not len(live):
            break
    out[doc] = best
    return out


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_language: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of every bin by language) from rows with a language for which ``usable`` holds."""
    small_batches(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("binary").alias("t"))
    sizes = cut(rows.groupBy("lang").count())  # as many rows as languages
    rows = rows.join(small_side(sizes, 100), "lang").where((F.col("count") <= max_per_language) | (F.pmod("h", F.col("count")) < max_per_language)).select("lang", "t")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for texts in chunks([block for t in part["t"] for block in _blocks(t)], BLOCK):
                    total[lang] = total.get(lang, 0) + np.bincount(grams(texts)[0], minlength=BINS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": counts[at]})

    got = rows.mapInPandas(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((BINS, len(languages)))
    for k, lang in enumerate(languages):
        one = got[got["lang"] == lang]
        counts[one["bin"].to_numpy(), k] = one["n"]
    # half of the smoothing is even, half follows all languages together
    prior = (counts.sum(axis=1, keepdims=True) + 0.5) / (counts.sum() + 0.5 * BINS) if languages else np.zeros((BINS, 0))
    smooth = 0.5 * BINS
    share = (counts + 0.5 * smooth * prior + 0.5 * smooth / BINS) / (counts.sum(axis=0) + smooth) if languages else counts
    return languages, np.log(share).astype(np.float32)


def predict(docs: DataFrame, languages: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, shares): the language with the largest proportion, that proportion, and all of the chosen set.

    Defined cases: ``und`` with score 0 for null texts, texts without a letter, and where no language was learned; of
    equal proportions the language first by name; a null id stays null and ids of any type stay as they are; repeated
    rows give a row each; an empty table gives an empty result; a text of any length is read whole, by blocks of
    ``BLOCK`` bytes, beside which the likelihoods of its units are held (8 bytes a language for ``UNIT_WORDS`` words);
    other columns are neither read nor kept.
    """
    small_batches(docs.sparkSession)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))]
    names = np.array([*languages, UNKNOWN])

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["_t"]]
            share = np.concatenate([mixture([t.encode() for t in part], logp) for part in chunks(texts)]) if languages else np.zeros((len(texts), 0))
            known = np.array([any(map(str.isalpha, t)) for t in texts]) & (share.sum(axis=1) > 0)
            top = share.argmax(axis=1) if languages else np.zeros(len(texts), dtype=int)
            score = np.where(known, share.max(axis=1, initial=0), 0.0).clip(0, 1)
            shares = [[(names[k], float(row[k])) for k in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(share, known, strict=True)]
            yield pd.DataFrame({"lang_pred": np.where(known, names[top], UNKNOWN), "score": score, "shares": pd.Series(shares, dtype=object)})

    return map_beside(docs, id_col, [F.col(text_col).alias("_t")], run, fields)
