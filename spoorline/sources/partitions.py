"""Date partitions of fact tables: their ranges, and which are old enough to go."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRANULARITIES = ("day", "month", "year")


def partition_ranges(spark: SparkSession, start: dt.date, end: dt.date, granularity: str = "month") -> DataFrame:
    """(name, begin, end): the days, months or years that hold start through end; ends are exclusive."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity is one of {GRANULARITIES}")
    if start > end:
        raise ValueError("start has to be before end")
    one = spark.range(1).select(F.explode(F.sequence(F.date_trunc(granularity, F.lit(start)), F.date_trunc(granularity, F.lit(end)), F.expr(f"INTERVAL 1 {granularity}"))).alias("t"))
    return _named(one, granularity)


def partitions_of(facts: list[DataFrame], created: str = "created_at", granularity: str = "month", ahead: int = 0) -> DataFrame:
    """(name, begin, end): the partitions from the first to the last moment of all ``facts``, and ``ahead`` more after them; none without facts.

    A moment is read by its minimum and maximum only, which Parquet's footers answer; null moments count for nothing.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity is one of {GRANULARITIES}")
    times = reduce(DataFrame.union, (f.select(F.col(created).cast("timestamp").alias("t")) for f in facts))
    last = F.date_trunc(granularity, F.max("t")) + F.make_interval(**{f"{granularity}s": F.lit(ahead)})
    span = times.agg(F.date_trunc(granularity, F.min("t")).alias("first"), last.alias("last")).where("first is not null")
    return _named(span.select(F.explode(F.sequence("first", "last", F.expr(f"INTERVAL 1 {granularity}"))).alias("t")), granularity)


def _named(begins: DataFrame, granularity: str) -> DataFrame:
    pattern = {"day": "'y'yyyy_'m'MM_'d'dd", "month": "'y'yyyy_'m'MM", "year": "'y'yyyy"}[granularity]
    return begins.select(F.date_format("t", pattern).alias("name"), F.to_date("t").alias("begin"), F.to_date(F.col("t") + F.expr(f"INTERVAL 1 {granularity}")).alias("end"))


def create_days(path: str, tables: list[str], start: dt.date, end: dt.date) -> list[tuple[str, dt.date]]:
    """(table, day) of the days from ``start`` through ``end`` that were not there; each has an empty folder then.

    Writing makes folders by itself; made beforehand they let readers list a day that has no facts yet. Days that are
    there stay as they are. ``path`` is a URI of any store that pyarrow opens.
    """
    from pyarrow import fs

    if start > end:
        raise ValueError("start has to be before end")
    files, root = fs.FileSystem.from_uri(path)
    days = [start + dt.timedelta(i) for i in range((end - start).days + 1)]
    wanted = [(t, d) for t in tables for d in days]
    infos = files.get_file_info([f"{root}/{t}/created_date={d}" for t, d in wanted])
    missing = [w for w, info in zip(wanted, infos, strict=True) if info.type == fs.FileType.NotFound]
    for t, d in missing:
        files.create_dir(f"{root}/{t}/created_date={d}", recursive=True)
    return sorted(missing)


def partitions_before(names: DataFrame, keep_after: dt.date) -> DataFrame:
    """The rows of (table, name) whose partition begins before ``keep_after``, with that day; names of another form are left out."""
    found = F.regexp_extract("name", r"^y(\d{4})(?:_m(\d{2}))?(?:_d(\d{2}))?$", 1)
    part = lambda i: F.regexp_extract("name", r"^y(\d{4})(?:_m(\d{2}))?(?:_d(\d{2}))?$", i)
    or_first = lambda c: F.when(c == "", "01").otherwise(c)
    begin = F.to_date(F.concat_ws("-", part(1), or_first(part(2)), or_first(part(3))))
    return names.where(found != "").withColumn("begin", begin).where(F.col("begin") < F.lit(keep_after))


DRY_RUN, DETACH, DROP, TRUNCATE = "dry_run", "detach", "drop", "truncate"


def clean_up(path: str, tables: list[str], keep_after: dt.date, command: str = DRY_RUN) -> list[tuple[str, dt.date]]:
    """(table, day) of the stored days before ``keep_after``, after doing to them what ``command`` names.

    A dry run only lists them. Detached days move to ``<table>_detached``, dropped ones go, truncated ones keep an
    empty folder. Folders are handled by name, so no data is read; ``path`` is a URI of any store that pyarrow opens.
    """
    from pyarrow import fs

    if command not in (DRY_RUN, DETACH, DROP, TRUNCATE):
        raise ValueError(f"unknown command {command}")
    files, root = fs.FileSystem.from_uri(path)
    found = []
    for table in tables:
        for info in files.get_file_info(fs.FileSelector(f"{root}/{table}", allow_not_found=True)):
            day = re.fullmatch(r"created_date=(\d{4}-\d{2}-\d{2})", info.base_name)
            if day and info.type == fs.FileType.Directory and dt.date.fromisoformat(day[1]) < keep_after:
                found.append((table, dt.date.fromisoformat(day[1])))
    for table, day in found:
        folder = f"{root}/{table}/created_date={day}"
        if command == DROP:
            files.delete_dir(folder)
        elif command == TRUNCATE:
            files.delete_dir_contents(folder)
        elif command == DETACH:
            files.create_dir(f"{root}/{table}_detached", recursive=True)
            files.move(folder, f"{root}/{table}_detached/created_date={day}")
    return sorted(found)


def write_fact(df: DataFrame, path: str, created: str = "created_at") -> None:
    """Writes facts by day. Days that ``df`` has are replaced, others stay."""
    dated = df.withColumn("created_date", F.to_date(created))
    dated.repartition("created_date", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_date").parquet(path)
