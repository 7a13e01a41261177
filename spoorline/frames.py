"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where a session names none, a local one gets a temporary folder and a cluster an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: the plan stays short and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Later:
    """A frame, or several, that ``make`` gives when it is first asked for; given again after that."""

    def __init__(self, make: Callable):
        self._make = make

    @cached_property
    def made(self):
        return self._make()


def made(part):
    """A frame that may still have to be made."""
    return part.made if isinstance(part, Later) else part


class Rounds:
    """Tables of an iteration, written to the shared folder and read again.

    A checkpoint keeps what the optimizer has inferred of its rows; over the rounds of an iteration that grows until planning
    takes longer than the work. A table that is read has none of it, and its size is known. ``keep`` removes all but
    some of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append(path)
        return out

    def keep(self, *frames: DataFrame) -> None:
        """Removes the tables that none of ``frames`` reads."""
        live = [f for df in frames for f in df.inputFiles()]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for p in [p for p in self.paths if not any(f"{p.rsplit('/', 2)[1]}/{p.rsplit('/', 1)[1]}/" in f for f in live)]:
            at = path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove(p)


def ids_frame(spark: SparkSession, ids: Iterable, kind: str = "bigint", name: str = "id") -> DataFrame:
    """A one-column frame of the ids that a caller names."""
    return spark.createDataFrame([(i,) for i in sorted(set(ids))], f"{name} {kind}")


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order given (unlike dropDuplicates, which one is defined)."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def without(df: DataFrame, seen: DataFrame, column: str = "id") -> DataFrame:
    """The rows whose ``column`` is not among the ids in ``seen``."""
    return df.join(seen.select(F.col("id").alias(column)), column, "left_anti")


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among ``ids``; Spark broadcasts the ids where they are few."""
    return df.join(ids.select(F.col("id").alias(column)), column, "left_semi")


#: Ids from which on a join by them is dealt out; Spark sends fewer ones to the tasks, or shuffles them cheaply.
MANY_IDS = 125_000


def are_many(ids: DataFrame) -> bool:
    """Whether stored ``ids`` are more than ``MANY_IDS``."""
    return ids.count() > MANY_IDS


def among_many(df: DataFrame, ids: DataFrame, column: str, tasks: int | None) -> DataFrame:
    """``among`` stored ``ids``, where they are many with both sides dealt out to ``tasks``: a task's share does not grow with the tables then."""
    if tasks is None or not are_many(ids):
        return among(df, ids, column)
    return among(df.repartition(tasks, column), ids.repartition(tasks, "id"), column)
