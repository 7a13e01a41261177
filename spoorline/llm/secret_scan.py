"""Secret scans with multipart credential linking.

Three base kinds (assign, access, hex) are reported by themselves. Weaker parts (short access identifiers and user
names, short or bare secrets, endpoints) are common in clean text, so they are reported only where a complementary
part lies in the same scope (the text between blank lines), or within ``gap`` characters of it where the caller
names a gap: an interval join of weak parts with parts of the complementary roles. A bare hex run may be a commit or a
digest and completes nothing; a short secret counts only if it has a letter, a digit and six characters. The join runs for a whole Arrow batch at once: both sides are
laid on one line by (row, scope) and place, and sorted searches find the nearest partner, so a text with
thousands of parts makes no pairs.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_beside, small_batches

#: The base patterns and the least lengths of what they must hold.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

BARE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")
NAME = re.compile(r"""(?:access[_-]?key[_-]?id|client[_-]?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,64}""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::\d{1,5})?(?:/[A-Za-z0-9._/-]*)?")
HOST = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\d.])")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Role of each kind, and the roles that complete it.
ID, SECRET, ENDPOINT, NONE = range(4)
ROLE = np.array([SECRET, ID, NONE, ID, SECRET, ENDPOINT])
#: What a short secret must look like.
SENSIBLE = re.compile(r"(?=.*[A-Za-z])(?=.*\d).{6,}")
COMPLETES = {ID: (SECRET,), SECRET: (ID, ENDPOINT), ENDPOINT: (SECRET,)}
BASE = 3


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base spans and weak candidates of a text, in code points, end exclusive."""
    found, weak = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((0, *m.span()))
            elif SENSIBLE.fullmatch(m[2]):
                weak.append((4, *m.span()))
        weak += [(3, *m.span()) for m in NAME.finditer(text)]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            (found if len(m[0]) >= ACCESS_LEAST else weak).append((1 if len(m[0]) >= ACCESS_LEAST else 3, *m.span()))
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    weak += [(4, *m.span()) for m in BARE.finditer(text) if re.search(r"[a-z]", m[0]) and re.search(r"[A-Z]", m[0]) and re.search(r"\d", m[0])]
    if "://" in text:
        weak += [(5, *m.span()) for m in URL.finditer(text)]
    weak += [(5, *m.span()) for m in HOST.finditer(text)]
    if weak and found:  # what a base span reports already is no weak candidate
        spans = sorted((s, e) for _, s, e in found)
        starts, ends = np.array([s for s, _ in spans]), np.maximum.accumulate([e for _, e in spans])
        at = np.searchsorted(starts, [e for _, _, e in weak])
        weak = [w for w, i in zip(weak, at, strict=True) if not i or ends[i - 1] <= w[1]]
    return found + weak


def linked(row: np.ndarray, scope: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int | None) -> np.ndarray:
    """The interval join: which parts have a partner of a completing role in their (row, scope), at most ``gap`` characters away where it is given."""
    out = np.zeros(len(row), dtype=bool)
    if not len(row):
        return out
    gap = int(end.max()) if gap is None else gap
    _, group = np.unique(np.stack([row, scope]), axis=1, return_inverse=True)
    base = group.reshape(-1).astype(np.int64) * (int(end.max()) + 2 * gap + 2)
    lo, hi, role = base + start, base + end, ROLE[kind]
    for own, others in COMPLETES.items():
        mine = np.flatnonzero(role == own)
        theirs = np.flatnonzero(np.isin(role, others))
        if len(mine) and len(theirs):
            theirs = theirs[np.argsort(lo[theirs], kind="stable")]
            reach = np.maximum.accumulate(hi[theirs])  # the farthest end of those that start no later
            at = np.searchsorted(lo[theirs], hi[mine] + gap, side="right")
            out[mine] = (at > 0) & (reach[np.maximum(at, 1) - 1] >= lo[mine] - gap)
    return out


def spans_of(texts: list[str], gap: int | None) -> list[list[tuple[int, int, int]]]:
    """For each text its base spans and its linked weak spans, by start, then kind as listed."""
    rows = [(i, *p) for i, t in enumerate(texts) for p in parts_of(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if rows:
        row, kind, start, end = np.array(rows, dtype=np.int64).T
        scope = np.zeros(len(row), dtype=np.int64)
        for i in np.unique(row):
            breaks = [m.start() for m in BLANK_LINE.finditer(texts[i])]
            scope[row == i] = np.searchsorted(breaks, start[row == i])
        keep = (kind < BASE) | linked(row, scope, kind, start, end, gap)
        for i, k, s, e in zip(row[keep], kind[keep], start[keep], end[keep], strict=True):
            out[i].append((int(k), int(s), int(e)))
    return [sorted(set(x), key=lambda p: (p[1], p[0], p[2])) for x in out]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, found): one row per input row.

    ``found`` lists the spans as structs of kind, start and end. Defined cases: a null text counts as empty and has
    no spans; a null id stays null and ids of any type stay as they are; repeated rows give a row each; of spans that
    begin at one place the kind listed first comes first; a text is scanned whole, its parts in memory (some 200 bytes
    a part); an empty table gives an empty result; other columns are neither read nor kept.
    """
    small_batches(docs.sparkSession)
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:BASE]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    fields.append(T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))

    def run(batches):
        for pdf in batches:
            spans = spans_of(pdf["t"].tolist(), gap)
            base = [[p for p in x if p[0] < BASE] for x in spans]
            out = {f"n_{k}": [sum(p[0] == i for p in x) for x in base] for i, k in enumerate(KINDS[:BASE])}
            out |= {"base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in spans]}
            yield pd.DataFrame(out | {"found": [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x] for x in spans]})

    return map_beside(docs, id_col, [F.coalesce(F.col(text_col), F.lit("")).alias("t")], run, fields)


def mask_secrets(docs: DataFrame, text_col: str = "text", gap: int | None = None) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``[kind]``; overlapping spans become one. Null texts stay null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, spans_of([t or "" for t in texts], gap), strict=True):
            done, parts = 0, []
            for k, s, e in spans:
                if s >= done:
                    parts += [text[done:s], f"[{KINDS[k]}]"]
                done = max(done, e)
            out.append("".join([*parts, text[done:]]) if spans else text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, run(F.col(text_col)))
