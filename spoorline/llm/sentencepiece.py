"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The distinct words of a batch are grouped by length and the words of a group advance together, one character at a
time. A group's substrings are hashed from prefix hashes and looked up among the sorted keys of the pieces; at every
end the best candidate (``argmax`` over the piece lengths) is stored as the back pointer.

Two kinds of model are read. A unigram model scores a path by the sum of its pieces' scores. A BPE model has one
right path, the one its merges give: a candidate scores 0 where the merge order keeps it apart from the piece
before it, else minus infinity. Merges happen in the order of their ranks, so whether two pieces stay apart can be
told from the two alone, by undoing their merges and asking whether a merge over the border would have come first.
Characters that no piece has become byte pieces.

A long word (text without spaces) is cut where two characters meet that no piece holds side by side. What is still long
is, for BPE, cut into overlapping blocks of one length, which advance together too; two neighbours are set together at
a place where both paths have a border and the pieces about it stay apart. Since a path is right exactly if all its
neighbours stay apart, one look at the whole path proves it; one that fails is made again in one go.
"""

from __future__ import annotations

import collections
import functools
import itertools
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_beside, released, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20  # bits of the table that remembers pairs
_FILTER = 22  # bits of the table that tells most substrings from pieces
_NONE = np.zeros(0, dtype=np.int64)
#: Characters of a word that is encoded in one go, and by which blocks of longer ones overlap on either side.
LONG, OVERLAP = 512, 64
#: Blocks of one word that are kept while they may come back.
AGAIN = 256
#: Words of earlier batches that an encoder keeps with their pieces.
REMEMBERED = 200_000

#: Fixed values of the file format: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes):
    """(number, value) of the fields of a protobuf message; the value is an int, a float or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value = struct.unpack_from("<f", buf, at)[0]
            at += 4
        elif kind == 1:
            value = buf[at : at + 8]
            at += 8
        else:
            n = varint()
            value = buf[at : at + n]
            at += n
        yield tag >> 3, value


class Model:
    """The tables of a model file. They grow with its vocabulary only."""

    def __init__(self, proto: bytes):
        self.pieces, self.scores, self.types = [], [], []
        spec, self.kind, charsmap = {3: 1, 4: 1, 5: 1}, UNIGRAM, b""
        for number, value in _fields(proto):
            if number == 1:
                piece = {2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                self.types.append(piece[3])
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                got = dict(_fields(value))
                charsmap = got.get(2, b"")
                spec |= {k: got[k] for k in (3, 4, 5) if k in got}
        if self.kind not in (UNIGRAM, BPE) or charsmap or spec[4] or not spec[5]:
            raise ValueError("only unigram and BPE models without a normalizer are read")
        self.prefix = SPACE if spec[3] else ""
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)):
            if t == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
        self.unknown = self.types.index(UNKNOWN)
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else p.encode() for p, t in zip(self.pieces, self.types, strict=True)]
        ids = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED)]
        self.scores = np.array(self.scores, dtype=np.float64)
        if self.kind == BPE:
            ids = self._merges(ids)
        self.longest = max((len(self.pieces[i]) for i in ids), default=1)
        keys = np.array([int(_keys(np.array([[ord(c) for c in self.pieces[i]]], dtype=np.uint64))[0]) for i in ids], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, dtype=np.int32)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one key")
        self.filter = np.zeros(1 << _FILTER, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER)] = True
        # a word is white space and what follows it; nothing joins over the place before white space or about a line break
        inner = [self.pieces[i] for i in ids]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in inner):
            raise ValueError("pieces that hold white space after other characters are not read")
        pairs = {(ord(a) << 32) | ord(b) for p in inner for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(pairs), dtype=np.uint64)  # characters that some piece holds side by side
        self.sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _merges(self, ids: list[int]) -> list[int]:
        """rank, left and right of every piece that merges can make, and the rank of every pair that can merge."""
        of = {self.pieces[i]: i for i in ids}
        order = sorted((i for i in ids if len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
        rank = {self.pieces[i]: k for k, i in enumerate(order)}
        n = len(self.pieces)
        self.rank, self.left, self.right = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        made = [i for i in ids if len(self.pieces[i]) == 1]
        pairs = {}
        for i in order:
            parts = list(self.pieces[i])
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda j: rank.get(parts[j] + parts[j + 1], n))
                if parts[best] + parts[best + 1] not in rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2 and parts[0] in of and parts[1] in of:
                made.append(i)
                self.rank[i], self.left[i], self.right[i] = rank[self.pieces[i]], of[parts[0]], of[parts[1]]
            p = self.pieces[i]
            for j in range(1, len(p)):
                if p[:j] in of and p[j:] in of:
                    pairs[of[p[:j]] * n + of[p[j:]]] = rank[p]
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        return made

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merges leave piece ``b`` apart from the piece ``a`` before it."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), dtype=bool)
        if not len(self.pair_keys):
            return out
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * len(self.pieces) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            lost = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[live])
            out[live[lost]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            undo_right = ~undo_left & (ry >= 0)
            go = ~lost & (undo_left | undo_right)
            limit[live] = np.where(undo_left, rx, ry + 1)  # of equal merges the one on the left comes first
            a[live[undo_left]] = self.right[x[undo_left]]
            b[live[undo_right]] = self.left[y[undo_right]]
            live = live[go]
        return out


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _finish(h: np.ndarray, length) -> np.ndarray:
    h = (h + np.uint64(length)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes: column i is of the first i characters."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


def _keys(codes: np.ndarray) -> np.ndarray:
    return _finish(_prefixes(codes)[:, -1], codes.shape[1])


class Encoder:
    """Encodes batches with one model; remembers a bounded number of words and of pairs of pieces."""

    def __init__(self, model: Model):
        self.m = model
        self.seen = np.full(1 << _SLOTS, -1, dtype=np.int64)
        self.verdict = np.zeros(1 << _SLOTS, dtype=bool)
        self._forget()

    def _forget(self) -> None:
        """Starts the table of words anew; that bounds memory and changes no result."""
        self.place = collections.defaultdict(itertools.count().__next__)
        self.flat, self.start, self.count = np.zeros(0, dtype=np.int32), _NONE, _NONE

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.m.pieces) + b
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.verdict[slot]
        miss = np.flatnonzero(self.seen[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            got = self.m.apart(new // len(self.m.pieces), new % len(self.m.pieces))[back]
            out[miss] = got
            # of two pairs that share a slot the last one stays, with its own verdict
            last = {int(s): i for i, s in enumerate(slot[miss])} if len(miss) < 64 else None
            keep = miss[list(last.values())] if last is not None else miss[len(miss) - 1 - np.unique(slot[miss][::-1], return_index=True)[1]]
            self.seen[slot[keep]], self.verdict[slot[keep]] = key[keep], out[keep]
        return out

    def group(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words of one length one after the other, ids of each word); a character that no piece has is -1 - its code point."""
        m, n, size = self.m, len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size)
        pre, power = _prefixes(codes.astype(np.uint64)), _powers(min(size, m.longest))
        most = min(size, m.longest)
        found = np.full((most, size + 1, n), -1, dtype=np.int32)  # [length - 1, end, word]
        for k in range(1, most + 1):
            key = _finish(pre[:, k:] - pre[:, :-k] * power[k], k)
            maybe = np.nonzero(m.filter[key >> np.uint64(64 - _FILTER)])
            probe = key[maybe]
            at = np.minimum(np.searchsorted(m.keys, probe), len(m.keys) - 1)
            hit = m.keys[at] == probe
            found[k - 1, maybe[1][hit] + k, maybe[0][hit]] = m.ids[at[hit]]
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        step, last = np.zeros((size + 1, n), dtype=np.int32), np.full((size + 1, n), -1, dtype=np.int64)
        least = float(m.scores.min()) - 10
        for i in range(1, size + 1):
            cands = found[: min(i, most), i]
            k, row = np.nonzero(cands >= 0)
            piece = cands[k, row]
            score = np.full((min(i, most), n), -np.inf)
            before = i - 1 - k
            if m.kind == BPE:
                prev = last[before, row]
                fits = prev < 0
                inner = np.flatnonzero(~fits)
                fits[inner] = self._apart(prev[inner], piece[inner])
                score[k[fits], row[fits]] = best[before[fits], row[fits]]
            else:
                score[k, row] = best[before, row] + m.scores[piece]
            alone = cands[0] < 0
            score[0, alone] = best[i - 1, alone] + (0 if m.kind == BPE else least)
            pick = score.argmax(axis=0)
            best[i] = score[pick, np.arange(n)]
            step[i] = pick + 1
            last[i] = cands[pick, np.arange(n)]
            free = (pick == 0) & alone
            last[i, free] = -1 - codes[free, i - 1].astype(np.int64)
        out = np.zeros((size, n), dtype=np.int64)
        count, at, rows = np.zeros(n, dtype=np.int64), np.full(n, size), np.arange(n)
        while len(rows):
            out[size - 1 - count[rows], rows] = last[at[rows], rows]
            count[rows] += 1
            at[rows] -= step[at[rows], rows]
            rows = rows[at[rows] > 0]
        return out.T[(np.arange(size)[:, None] >= size - count).T], count

    def _paths(self, words: list[str]) -> list[np.ndarray]:
        """``group`` for words of one length, in portions that bound memory: the ids of each."""
        room, out = max(1, 2_000_000 // (len(words[0]) * min(len(words[0]), self.m.longest))), []
        for at in range(0, len(words), room):
            flat, n = self.group(words[at : at + room])
            out += np.split(flat, np.cumsum(n)[:-1])
        return out

    def _long(self, word: str) -> np.ndarray:
        """The ids of a long word, as ``group`` has them: cut at sure places, each distinct part encoded once."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        pair = (codes[:-1] << np.uint64(32)) | codes[1:]
        at = np.minimum(np.searchsorted(self.m.beside, pair), max(len(self.m.beside) - 1, 0))
        sure = np.flatnonzero(self.m.beside[at] != pair) + 1 if len(self.m.beside) else np.arange(1, len(word))
        edges = [0, *sure.tolist(), len(word)]
        cut = [word[a:b] for a, b in itertools.pairwise(edges)]
        groups: dict[int, list[str]] = {}
        for part in dict.fromkeys(cut):
            groups.setdefault(len(part), []).append(part)
        known: dict[str, np.ndarray] = {}
        for size, members in groups.items():
            found = self._paths(members) if size <= LONG or self.m.kind != BPE else map(self._blocks, members)
            known |= zip(members, found, strict=True)
        return np.concatenate([known[part] for part in cut])

    def _blocks(self, word: str) -> np.ndarray:
        """The ids of a word without sure places, by overlapping blocks."""
        n = len(word)
        spans = [(max(0, lo - OVERLAP), min(n, lo + LONG + OVERLAP)) for lo in range(0, n, LONG)]
        paths: dict[int, np.ndarray] = {}
        by_size: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(spans):
            by_size.setdefault(b - a, []).append(k)
        for members in by_size.values():
            texts = [word[slice(*spans[k])] for k in members]
            known = dict.fromkeys(texts)  # blocks of a text that repeats are one
            known |= zip(known, self._paths(list(known)), strict=True)
            paths |= {k: known[t] for k, t in zip(members, texts, strict=True)}
        met: dict[str, np.ndarray] = {}  # blocks that were encoded again from a border; in a text that repeats they come back

        def borders(ids: np.ndarray, begin: int) -> np.ndarray:
            return begin + np.concatenate([[0], np.cumsum(np.where(ids < 0, 1, self.m.sizes[np.maximum(ids, 0)]))])

        done, ids, here = [], paths[0], borders(paths[0], 0)  # the path so far, of which ``ids`` may still change at its end
        for k in range(1, len(spans)):
            after = paths[k]
            there = borders(after, spans[k][0])
            joint = None
            for again in (False, True):
                if again:  # from a border of the path so far
                    begin = int(here[here <= k * LONG][-1])
                    part = word[begin : spans[k][1]]
                    if part not in met:
                        met = met if len(met) < AGAIN else {}
                        met[part] = self._paths([part])[0]
                    after = met[part]
                    there = borders(after, begin)
                common = np.intersect1d(here[1:], there[:-1])
                for p in sorted(common.tolist(), key=lambda p: abs(p - k * LONG)):
                    i, j = int(np.searchsorted(here, p)), int(np.searchsorted(there, p))
                    if ids[i - 1] < 0 or after[j] < 0 or self._apart(ids[i - 1 : i], after[j : j + 1])[0]:
                        joint = i, j
                        break
                if joint:
                    break
            if not joint:
                return self._paths([word])[0]
            done.append(ids[: joint[0]])
            ids, here = after[joint[1] :], there[joint[1] :]
        out = np.concatenate([*done, ids])
        inner = np.flatnonzero((out[:-1] >= 0) & (out[1:] >= 0))
        right = borders(out, 0)[-1] == n and all(self._apart(out[part], out[part + 1]).all() for part in np.array_split(inner, 1 + len(inner) // 100_000))
        return out if right else self._paths([word])[0]

    def _learn(self, words: list[str]) -> None:
        """Encodes words that were not met before and adds them to what is remembered."""
        m = self.m
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= LONG:
                groups.setdefault(len(w), []).append(i)
        count, start = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        parts, size_so_far = [self.flat], len(self.flat)
        for size, members in sorted(groups.items()):
            room = max(1, 2_000_000 // (size * min(size, m.longest)))
            for at in range(0, len(members), room):
                part = np.array(members[at : at + room])
                flat, n = self.group([words[j] for j in part])
                if (flat < 0).any():
                    flat, n = self._bytes(flat, n)
                count[part], start[part] = n, size_so_far + np.cumsum(n) - n
                parts.append(flat.astype(np.int32))
                size_so_far += len(flat)
        for i in (i for i, w in enumerate(words) if len(w) > LONG):
            flat = self._long(words[i])
            if (flat < 0).any():
                flat, _ = self._bytes(flat, np.array([len(flat)]))
            count[i], start[i] = len(flat), size_so_far
            parts.append(flat.astype(np.int32))
            size_so_far += len(flat)
        self.flat = np.concatenate(parts)
        self.start, self.count = np.concatenate([self.start, start]), np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The piece ids of each text. A null or empty text has none."""
        m = self.m
        if len(self.place) > REMEMBERED:
            self._forget()
        known, place = len(self.place), self.place.__getitem__
        lists = [np.array(list(map(place, m.words.findall(m.prefix + t.replace(" ", SPACE)))), dtype=np.int64) if t else _NONE for t in texts]
        if len(self.place) > known:
            self._learn(list(itertools.islice(self.place, known, None)))
        words = np.concatenate([_NONE, *lists])
        n = self.count[words]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[words] - (ends - n), n) + np.arange(int(n.sum()))]
        total = np.concatenate([[0], ends])
        return np.split(ids, total[np.cumsum([len(x) for x in lists])[:-1]]) if texts else []

    def _bytes(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that no piece has as byte pieces, or as the unknown piece where the model has none."""
        as_bytes = {}
        for code in np.unique(flat[flat < 0]).tolist():
            found = [int(self.m.byte_ids[b]) for b in chr(-1 - code).encode("utf-8", "surrogatepass")]
            as_bytes[code] = found if min(found) >= 0 else [self.m.unknown]
        longer = np.array([len(as_bytes[i]) if i < 0 else 1 for i in flat.tolist()], dtype=np.int64)
        out = np.array([x for i in flat.tolist() for x in (as_bytes[i] if i < 0 else (i,))], dtype=np.int64)
        return out, np.add.reduceat(longer, np.cumsum(n) - n)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids."""
        table = self.m.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.m.prefix and text[:1] == " " else text


@functools.lru_cache(maxsize=4)
def _model(proto: bytes) -> Model:
    return Model(proto)


def load(spark: SparkSession, path: str = MODEL) -> Model:
    """The model at ``path``: a file of the driver's machine, or one that Spark reads."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return _model(f.read())
    return _model(bytes(spark.read.format("binaryFile").load(path).select("content").head()[0]))


def encode_column(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The piece ids of ``text_col``, array<int>; null texts have none (an empty array)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model)
        for texts in batches:
            yield pd.Series([x for part in chunks(texts.tolist()) for x in encoder.encode(part)])

    return run(F.col(text_col))


def decode_column(docs: DataFrame, model: Model, ids_col: str = "ids") -> Column:
    """The text of the piece ids in ``ids_col``; null for null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model)
        for ids in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x)) for x in ids], dtype=object)

    return run(F.col(ids_col))


def encode_decode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_bytes, ids, round_trip): one row per input row.

    n_bytes counts byte pieces; round_trip tells whether the decoded ids are the text again. A text that itself has
    the mark U+2581 decodes with a space in its place. Defined cases: null and empty texts have no pieces and
    round-trip as empty; repeated rows give a row each; an empty table gives an empty result; other columns are
    neither read nor kept.
    """
    small_batches(docs.sparkSession)
    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    is_byte = np.array([t == BYTE for t in model.types])

    def run(batches):
        # both ways in one worker, so a task holds one copy of the tables
        encoder = Encoder(model)
        for pdf in batches:
            texts = pdf["_t"].tolist()
            ids = [x for part in chunks(texts) for x in encoder.encode(part)]
            yield pd.DataFrame({"n_pieces": [len(x) for x in ids], "n_bytes": [int(is_byte[x].sum()) for x in ids], "ids": ids, "round_trip": [encoder.decode(x) == t for x, t in zip(ids, texts, strict=True)]})

    return map_beside(docs, id_col, [F.coalesce(F.col(text_col), F.lit("")).alias("_t")], released(run), fields)
