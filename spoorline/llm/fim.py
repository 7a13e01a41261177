"""Fill-in-middle transformation: one numpy kernel for a whole Arrow batch, on the bytes of its UTF-8 buffer.

1. Every byte gets its class by a table of 256: letter (A-Z, a-z), continuation byte, or other.
2. A unit (a run of letters, or one other character) begins where the class and that of the byte before tell so; texts
   begin anew. These masks are all that is held of a text beside it, one byte each.
3. Units are summed up by blocks of ``BLOCK`` bytes; taking away the sum before a text resets it there. A search in the
   sums finds the block of every cut of every row at once, and a short sum inside those blocks finds the byte.
4. Output and restored text are joined from slices of the one buffer.

Which units are cut and which form a row takes come from a hash of its id that Spark computes, so they do not depend on
partitions or on the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percent of rows that stay plain, counted from the top, and percent of the others that put the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20
BLOCK = 1024
#: Cuts that are placed at a time, each with the sums of one block.
PLACED = 4096

_LETTER, _INNER, _OTHER = 1, 2, 0
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[0x80:0xC0] = _INNER
_MARKED = np.zeros(256, dtype=bool)
_MARKED[[m[1] for m in (PREFIX, SUFFIX, MIDDLE)]] = True


class _Sums:
    """How many bytes of a mask are set before any place, from sums of blocks."""

    def __init__(self, mask: np.ndarray):
        self.mask = np.zeros(-(-max(1, len(mask)) // BLOCK) * BLOCK, dtype=bool)
        self.mask[: len(mask)] = mask
        self.sums = np.concatenate([[0], np.cumsum(self.mask.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])

    def before(self, places: np.ndarray) -> np.ndarray:
        block, inner = np.divmod(places, BLOCK)
        out = self.sums[block]
        for lo in range(0, len(places), PLACED):
            part = slice(lo, lo + PLACED)
            rows = self.mask.reshape(-1, BLOCK)[np.minimum(block[part], len(self.sums) - 2)]
            out[part] += np.where(block[part] < len(self.sums) - 1, (rows & (np.arange(BLOCK) < inner[part, None])).sum(axis=1), 0)
        return out

    def place(self, nth: np.ndarray) -> np.ndarray:
        """Where the set byte stands that has ``nth`` set ones before it; one has to be there."""
        block = np.searchsorted(self.sums, nth, side="right") - 1
        out = np.empty(len(nth), dtype=np.int64)
        for lo in range(0, len(nth), PLACED):
            part = slice(lo, lo + PLACED)
            inside = np.cumsum(self.mask.reshape(-1, BLOCK)[block[part]], axis=1, dtype=np.int16)
            out[part] = block[part] * BLOCK + (inside > (nth[part] - self.sums[block[part]])[:, None]).argmax(axis=1)
        return out


def units(buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a unit begins here, a character begins here) for every byte; texts begin at ``begin``."""
    kind = _CLASS[buf]
    characters = kind != _INNER
    starts = characters.copy()
    starts[1:] &= (kind[1:] != _LETTER) | (kind[:-1] != _LETTER)
    first = begin[begin < len(buf)]
    starts[first] = characters[first] = True
    return starts, characters


def marked(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold one of the three marks."""
    out = np.zeros(len(offsets) - 1, dtype=bool)
    if len(buf) >= 3:
        at = np.flatnonzero((buf[:-2] == PREFIX[0]) & _MARKED[buf[1:-1]] & (buf[2:] == PREFIX[2]))
        row = np.searchsorted(offsets, at, side="right") - 1
        out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def cuts(buf: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """n (units), a and b (bytes where the middle begins and ends), a_chars and b_chars (code points of prefix and middle) of every text."""
    begin, end = offsets[:-1], offsets[1:]
    starts, characters = map(_Sums, units(buf, begin))
    base = starts.before(begin)
    n = starts.before(end) - base
    one, two = h1 % (n + 1), h2 % (n + 1)
    out = {"n": n}
    for name, nth in (("a", np.minimum(one, two)), ("b", np.maximum(one, two))):
        place = end.copy()
        inside = nth < n
        place[inside] = starts.place((base + nth)[inside])
        out[name] = place
    at = characters.before(out["a"])
    return out | {"a_chars": at - characters.before(begin), "b_chars": characters.before(out["b"]) - at}


def transform(buf: np.ndarray, offsets: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """(what ``cuts`` gives and the form of every text, the output of every text). ``h`` is (row, 4)."""
    out = cuts(buf, offsets, h[:, 0], h[:, 1])
    begin, end = offsets[:-1], offsets[1:]
    plain = (begin == end) | marked(buf, offsets) | (h[:, 2] % 100 >= FIM_PERCENT)
    form = np.where(plain, PLAIN, np.where(h[:, 3] % 100 < SPM_PERCENT, SPM, PSM))
    whole, texts = memoryview(buf), []
    for f, lo, a, b, hi in zip(form.tolist(), begin.tolist(), out["a"].tolist(), out["b"].tolist(), end.tolist(), strict=True):
        if f == PLAIN:
            texts.append(bytes(whole[lo:hi]))
        elif f == PSM:
            texts.append(b"".join((PREFIX, whole[lo:a], SUFFIX, whole[b:hi], MIDDLE, whole[a:b])))
        else:
            texts.append(b"".join((SUFFIX, whole[b:hi], PREFIX, whole[lo:a], MIDDLE, whole[a:b])))
    return out | {"form": form, "plain": plain}, texts


def restore(output: bytes, form: str) -> bytes:
    """The text again, from the output and its form alone. No mark can begin inside another or inside a text that has none."""
    if form == PLAIN:
        return output
    rest, _, middle = output.partition(MIDDLE)
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    one, _, two = rest[len(first) :].partition(second)
    return one + middle + two if form == PSM else two + middle + one


def seeds(id: Column, salt: str = "1:") -> list[Column]:
    """The first four groups of 8 digits of the hex SHA-256 of salt and id, as whole numbers; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256): one row per input row.

    ``output`` is the transformed text; restored_sha256 is of the text that ``restore`` makes of output and form.
    Defined cases: a null or empty text is plain with n 0 and an empty output; a text that holds a mark is plain; a
    null id is hashed as empty text; repeated rows give equal rows; an empty table gives an empty result; other
    columns are neither read nor kept. A text is cut whole: beside it and its output some five bytes for each of its
    bytes are held.
    """
    small_batches(docs.sparkSession)
    fields = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output binary, output_sha256 string, restored_sha256 string").fields])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2]
            buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
            h = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            found, texts = transform(buf, offsets - offsets[0], h)
            form = found["form"].tolist()
            numbers = [pa.array(found["n"], pa.int64()), pa.array(form, pa.string()), *(pa.array(found[c], pa.int64(), mask=found["plain"]) for c in ("a_chars", "b_chars"))]
            digests = [hashlib.sha256(t).hexdigest() for t in texts], [hashlib.sha256(restore(t, f)).hexdigest() for t, f in zip(texts, form, strict=True)]
            columns = [batch.column(0), *numbers, pa.array(texts, pa.binary()), *(pa.array(d, pa.string()) for d in digests)]
            yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *(h.alias(f"_h{i}") for i, h in enumerate(seeds(F.col(id_col)))))
    return rows.mapInArrow(run, fields).withColumn("output", F.col("output").cast("string"))
