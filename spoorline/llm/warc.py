"""WARC archives from a table of pages: a deterministic sharded writer and the reader.

Records are sorted by (id, digest, address), nulls last, and cut into shards at boundary keys. Which keys are
boundaries depends on the rows alone: a hash of the key chooses some ``PER_SHARD`` keys a shard, and bytes are summed
along them. So any partitions give the same shards, whatever the ids look like: dense, sparse, text, repeated or null.
Rows that are the same throughout are told apart by a number, so that even they can be cut. A shard is one partition,
sorted and written one gzip member a record; a file rolls when its compressed size reaches ``roll_bytes``. Headers and
digests are made anew from the payload and no clock or random number goes into a file, so the same rows give the same
bytes.

Commit: every attempt of a task writes under a temporary name of its own; the rows that tell what successful
attempts wrote are stored first, then the files get their final names (a rename that was done before is not done
again), then the manifest is written. Readers take the files that the manifest lists. Files are reached by their
URI, so the folder may be in any store that pyarrow opens; it must be shared by all machines.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import urllib.parse
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, cut, small_batches, small_side

LEAST_REVISIT = 1000
#: Bytes of payload in a shard, about. The driver holds a boundary key (some 100 bytes) a shard and ``PER_SHARD`` keys for it.
SHARD_BYTES = 64 << 20
PER_SHARD = 16
#: Places to which rows of one payload are dealt out where what is known of payloads is too large to be broadcast.
SALTS = 32
ROLL_BYTES = 64 << 20
#: Bytes of archives that one task reads back, about.
READ_BYTES = 64 << 20
#: Fixed values of the file format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_SPACE_OF_IDS = uuid.UUID("5d1c5f0e-6f6b-4f4b-9f6e-3f2a2f3c7b11")
_PRINTABLE = "".join(map(chr, range(33, 127)))

STAGED = "file string, temporary string, records long, bytes long, sha1 string, first_id string, last_id string"
RECORD = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, file string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _header(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record(row, seen: int = 0) -> bytes:
    """The bytes of one record. ``seen`` counts rows before it that are the same in id, address and payload."""
    sha = base64.b32encode(bytes.fromhex(row.digest)).decode()
    name = uuid.uuid5(_SPACE_OF_IDS, f"{row.id}\n{row.url}\n{row.digest}\n{seen}")
    target = None if row.url is None else urllib.parse.quote(row.url, safe=_PRINTABLE)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row.payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"), ("Page-ID", row.id)]
    if row.kind == "response":
        block = head + row.payload
    else:
        block = head
        first = uuid.uuid5(_SPACE_OF_IDS, f"{row.first_id}\n{row.first_url}\n{row.digest}\n0")
        uri = None if row.first_url is None else urllib.parse.quote(row.first_url, safe=_PRINTABLE)
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{first}>"), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-ID", row.first_id)]
    return _header(row.kind, fields, block) + block + b"\r\n\r\n"


def warcinfo(file: str) -> bytes:
    block = b"software: spoorline\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(_SPACE_OF_IDS, file)
    fields = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")]
    return _header("warcinfo", fields, block) + block + b"\r\n\r\n"


class _Roll:
    """One file being written under its temporary name."""

    def __init__(self, folder: str, file: str):
        self.fs, path = _fs(folder)
        self.file, self.temporary = file, f"_temporary/{file}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{path}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(f"{path}/{self.temporary}")
        self.records, self.bytes, self.sha, self.first, self.last = 0, 0, hashlib.sha1(), None, None
        self._put(warcinfo(file))

    def _put(self, data: bytes) -> None:
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.bytes += len(member)
        self.sha.update(member)

    def add(self, row, seen: int) -> None:
        self._put(record(row, seen))
        self.first = row.id if not self.records else self.first
        self.last = row.id
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.file, self.temporary, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """((id, url, payload, digest, kind, first_id, first_url): what is written for each row, (id, url, digest, size): its narrow part, stored).

    Payloads are read twice: once for the narrow rows, which everything is decided by, once to be written.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    narrow = cut(rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("size")))
    groups = narrow.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("first"))
    groups = cut(groups.where("n > 1").select("digest", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")))
    width = F.lit(100) + F.octet_length(F.col("first_id").cast("string")) + F.coalesce(F.octet_length("first_url"), F.lit(0))
    held = groups.agg(F.sum(width)).head()[0] or 0
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    if held <= BROADCAST_BYTES:
        found = rows.join(F.broadcast(groups), "digest", "left")
    else:  # a payload that very many rows share is dealt out to SALTS places
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    found = found.withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
    return found.select("id", "url", "payload", "digest", "kind", *(F.when(revisit, F.col(c)).alias(c) for c in ("first_id", "first_url"))), narrow


def _key(id, digest, url, seq) -> tuple:
    return id is None, id, digest, url is None, url, seq


def shards_of(rows: DataFrame, narrow: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """``rows`` with ``seq`` and ``times`` (how many equal rows one stands for, and the number of the first), dealt out to sorted shards; how many shards.

    Shards are decided by ``narrow`` (of ``records_of``).
    """
    key = ["id", "digest", "url"]
    size = F.col("size") + 600  # with headers, about
    n, total = narrow.agg(F.count("*"), F.sum(size)).head()
    shards = max(1, -(-(total or 0) // shard_bytes))
    rows = rows.withColumn("seq", F.lit(0)).withColumn("times", F.lit(1))
    bounds: list[tuple] = []
    if shards > 1:
        picked = narrow.where(F.pmod(F.xxhash64(*key), F.lit(max(1, n // (shards * PER_SHARD)))) == 0)
        picked = picked.groupBy(*key).agg(F.sum(size).alias("b")).collect()
        picked = sorted((_key(r["id"], r["digest"], r["url"], 0), r["b"]) for r in picked)
        each, held = max(1, sum(b for _, b in picked) / shards), 0
        for at, b in picked:
            if held >= each * (len(bounds) + 1):
                bounds.append(at)
            held += b
        many = narrow.groupBy(*key).agg(F.count("*").alias("many"), F.first(size).alias("b")).where(F.col("many") * F.col("b") > shard_bytes)
        many = cut(many.withColumn("piece", F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / F.col("b")))))
        told = many.collect()  # each stands for more bytes than a shard, so there are fewer of them than shards
        if told:
            same = rows["id"].eqNullSafe(many["id"]) & (rows["digest"] == many["digest"]) & rows["url"].eqNullSafe(many["url"])
            width = sum(len(str(r["id"])) + len(r["url"] or "") + 100 for r in told)
            few = small_side(many, 1, width)
            one = rows.join(few, same, "left_semi").dropDuplicates(key)
            pieces = one.join(few, same).select(*(one[c] for c in rows.columns if c not in ("seq", "times")), "many", "piece")
            pieces = pieces.withColumn("seq", F.explode(F.expr("sequence(0L, many - 1, piece)")))
            pieces = pieces.select(*(c for c in rows.columns if c not in ("seq", "times")), F.col("seq").cast("int").alias("seq"), F.least("piece", F.col("many") - F.col("seq")).cast("int").alias("times"))
            rows = rows.join(few, same, "left_anti").unionByName(pieces)
            bounds += [_key(r["id"], r["digest"], r["url"], q) for r in told for q in range(0, r["many"], r["piece"])]
        bounds = sorted(set(bounds))

    @F.pandas_udf(T.IntegerType())
    def place(none: pd.Series, id: pd.Series, digest: pd.Series, url: pd.Series, seq: pd.Series) -> pd.Series:
        keys = zip(none, id, digest, url, seq, strict=True)
        return pd.Series([bisect.bisect_right(bounds, _key(None if gone else i, d, u, q)) for gone, i, d, u, q in keys], dtype="int32")

    some = next((b[1] for b in bounds if b[1] is not None), None)  # in place of null, so that long ids stay whole numbers in pandas
    rows = rows.withColumn("shard", place(F.col("id").isNull(), F.coalesce("id", F.lit(some).cast(rows.schema["id"].dataType)), "digest", "url", "seq") if bounds else F.lit(0))
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard"))
    return rows.sortWithinPartitions(F.asc_nulls_last("id"), "digest", F.asc_nulls_last("url"), "seq"), len(bounds) + 1


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, **names) -> DataFrame:
    """Writes ``pages`` as WARC files under ``folder`` (a URI) and returns the manifest.

    Of the records with equal payloads of at least ``least`` bytes that with the largest id is a response and the
    others revisit it; smaller ones are all responses. Ids have any type that can be ordered. Defined cases: a null
    payload is empty; rows that repeat the largest id are all responses; null ids come last and, beside ids that are
    not null, revisit; an id or a whole row that is repeated very often is cut into shards like others; an empty table
    writes no file and an empty manifest; a payload is one record however long; other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows, _ = shards_of(*records_of(pages, **names), shard_bytes)
    rows = rows.select("shard", F.col("id").cast("string").alias("id"), "url", "payload", "digest", "kind", F.col("first_id").cast("string").alias("first_id"), "first_url", "seq", "times")

    def run(batches):
        roll, at, part, before, seen = None, None, 0, None, 0
        for pdf in batches:
            pdf = pdf.astype(object)
            done = []
            for row in pdf.where(pdf.notna(), None).itertuples(index=False):
                at = row.shard
                same = (row.id, row.url, row.digest)
                seen = max(row.seq, seen + 1 if same == before else 0)
                before = same
                for more in range(row.times):
                    if roll and roll.bytes >= roll_bytes:
                        done.append(roll.close())
                        roll, part = None, part + 1
                    roll = roll or _Roll(folder, f"pages-{at:08d}-{part:05d}.warc.gz")
                    roll.add(row, seen + more)
                seen += row.times - 1
            if done:
                yield pd.DataFrame(done, columns=[f.split()[0] for f in STAGED.split(", ")])
        if roll:
            yield pd.DataFrame([roll.close()], columns=[f.split()[0] for f in STAGED.split(", ")])

    rows.mapInPandas(run, STAGED).write.mode("overwrite").parquet(f"{folder}/_staged")

    def commit(batches):
        fs, path = _fs(folder)
        for pdf in batches:
            for temporary, file in zip(pdf["temporary"], pdf["file"], strict=True):
                try:
                    fs.move(f"{path}/{temporary}", f"{path}/{file}")
                except OSError:  # an attempt before this one may have renamed it
                    if fs.get_file_info(f"{path}/{file}").size != int(pdf.loc[pdf["file"] == file, "bytes"].iloc[0]):
                        raise
            yield pdf

    spark.read.parquet(f"{folder}/_staged").mapInPandas(commit, STAGED).drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    _clear(folder)
    return spark.read.parquet(f"{folder}/manifest")


def _clear(folder: str) -> None:
    """Removes what attempts that failed have left under temporary names."""
    from pyarrow.fs import FileType

    fs, path = _fs(folder)
    if fs.get_file_info(f"{path}/_temporary").type == FileType.Directory:
        fs.delete_dir(f"{path}/_temporary")


def parse(stream) -> list:
    """Yields (header fields in lower case, block) of the records of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.lower()] = v.strip()
        yield fields, stream.read(int(fields["content-length"]))


def read(spark: SparkSession, folder: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """One row per response or revisit record of the files that the manifest lists, with digests checked.

    payload_bytes and payload_digest (lower-case hex SHA-1) are of the full payload: computed for responses, from the
    headers for revisits.
    """
    small_batches(spark)

    def sha(value: str) -> str:
        return base64.b32decode(value.removeprefix("sha1:")).hex()

    def rows(file: str):
        fs, path = _fs(folder)
        with fs.open_input_stream(f"{path}/{file}", compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:
            for fields, block in parse(stream):
                if hashlib.sha1(block).hexdigest() != sha(fields["warc-block-digest"]):
                    raise ValueError(f"{file}: a block does not have its digest")
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = sha(fields["warc-payload-digest"])
                if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{file}: a payload does not have its digest")
                yield fields.get("page-id"), fields.get("warc-target-uri"), size, digest, fields["warc-type"], fields.get("refers-to-page-id"), file

    def run(batches):
        columns = [f.split()[0] for f in RECORD.split(", ")]
        for pdf in batches:
            for file in pdf["file"]:
                part = []
                for row in rows(file):
                    part.append(row)
                    if len(part) == 4000:
                        yield pd.DataFrame(part, columns=columns)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=columns)

    files = spark.read.parquet(f"{folder}/manifest").select("file", "bytes")
    n, total = files.agg(F.count("*"), F.sum("bytes")).head()
    # dealt out by a number of tasks that follows the archives' bytes; a column's partitions would be merged by the size of the file names
    return files.select("file").repartition(max(1, min(n, -(-(total or 0) // read_bytes)))).mapInPandas(run, RECORD)


def write_and_read(pages: DataFrame, folder: str, id_col: str = "page_id", **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, file): what reading back gives for every row written."""
    kind: T.DataType = pages.schema[id_col].dataType
    write(pages, folder, id_col=id_col, **options)
    out = read(pages.sparkSession, folder)
    return out.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "file")
