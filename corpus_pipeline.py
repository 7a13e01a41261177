"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of ``documents``. Rows with a null id or text are treated like any other row.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import decontaminate, quality_mil, secret_scan, sentencepiece, simhash_dedup
from spoorline.llm.common import crc_mod, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score below 0.3)."""
    network = quality_mil.train(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return docs.where(quality_mil.score_column(docs, network) >= 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8), that with the least id."""
    return simhash_dedup.keep_first(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item: by SimHash blocks first, then what an exact search of the rest finds beyond the radius."""
    benchmark = table(spark, sf_dir, "benchmark")
    rest = decontaminate.without_contaminated(docs, benchmark, search=decontaminate.contaminated)
    return decontaminate.without_contaminated(rest, benchmark, search=decontaminate.every_contaminated)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows."""
    masked = secret_scan.mask_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else masked


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text, with the check that they decode to it."""
    return sentencepiece.encode_decode(docs, sentencepiece.load(spark))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the session's shared folder.

    With a ``folder`` of the caller's (a URI), a run that failed goes on after the last stage that was finished there,
    and all stages stay. Without one, a stage's rows go as soon as the next one's are written.
    """
    base = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        if not (folder and finished(spark, f"{base}/{i}")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{i}")
            if folder:
                spark.range(1).write.mode("overwrite").parquet(f"{base}/{i}-finished")
        docs = spark.read.parquet(f"{base}/{i}")
        if i and not folder:
            remove(f"{base}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written to its end, which a small table beside it tells."""
    try:
        return spark.read.parquet(f"{path}-finished").count() > 0
    except AnalysisException:
        return False


def remove(path: str) -> None:
    """Removes a folder of a store that pyarrow opens; in other stores it stays."""
    from pyarrow import ArrowException, fs

    with contextlib.suppress(OSError, ArrowException):
        files, name = fs.FileSystem.from_uri(path)
        files.delete_dir(name)
