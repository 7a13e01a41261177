"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one Arrow batch. Texts are whole, so a batch stays a few MB at usual lengths.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch, for very long texts.
BATCH_BYTES = str(4 << 20)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch to ``rows``; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def chunks(texts: list, most: int = 1 << 19):
    """Runs of ``texts`` of about ``most`` characters or bytes together; a longer text is a run by itself."""
    part, size = [], 0
    for t in texts:
        n = len(t) if t is not None else 0
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += n
    if part:
        yield part


def map_beside(docs: DataFrame, id_col: str, columns: list[Column], run, fields: list[T.StructField]) -> DataFrame:
    """(id, fields...): what ``run`` makes of the pandas frames of ``columns``, one frame for each with as many rows, with the id beside it.

    The id never passes through pandas, where a null in a batch makes fractions of whole numbers and rounds those
    above 2^53: its Arrow column is set before the others as it came, of whatever type.
    """
    rest = to_arrow_schema(T.StructType(fields))

    def outer(batches):
        ids: deque = deque()

        def frames():
            for batch in batches:
                ids.append(batch.column(0))
                yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).to_pandas()

        for out in run(frames()):
            made = pa.RecordBatch.from_pandas(out, schema=rest, preserve_index=False)
            yield pa.RecordBatch.from_arrays([ids.popleft(), *made.columns], names=[id_col, *rest.names])

    out_type = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    return docs.select(F.col(id_col), *columns).mapInArrow(outer, out_type)


def released(run):
    """``run`` for mapInPandas, giving memory back to the system at the end: idle Python workers stay beside the JVM."""

    @functools.wraps(run)
    def outer(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return outer


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local one gets a temporary folder and a cluster an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


#: Bytes that a side of a join may hold, by its count of rows and the width its caller names, to be broadcast.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, width: int, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast where its rows times ``width`` bytes are within the bound; beyond, the join shuffles. ``df`` should be stored."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from there, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column's text, modulo n; null where the column is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def crc_mod_py(value, n: int) -> int:
    return zlib.crc32(str(value).encode()) % n


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, usable: Column, limit: int) -> DataFrame:
    """(_id, _y): about ``limit`` labelled ids at most, chosen by hash; of an id with several labels the largest counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    n = known.count()
    return known if n <= limit else known.where(F.pmod(F.xxhash64("_id"), F.lit(n)) < limit)


def one_text_an_id(docs: DataFrame, id_col: str, text_col: str, sample: DataFrame) -> DataFrame:
    """(_id, _t, _y): a text for each id of ``sample`` (of ``labelled_sample``) that has a row; of several the least, so that an id that is repeated often is one row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    return rows.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body's lambdas read it for every element."""
    return F.transform(F.array(value), body)[0]
