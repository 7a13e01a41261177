"""Usage of datasets by users over the last day, week or month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTHS = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month"}


def usage(io: DataFrame, runs: DataFrame, users: DataFrame, datasets: DataFrame, locations: DataFrame, depth: str, now: dt.datetime | None = None) -> DataFrame:
    """One row per dataset and user: last use, number of interactions, summed counters, with names.

    Facts are cut to the period and aggregated by run and dataset before any join. A dataset without a location stays.
    """
    moment = F.lit(now) if now is not None else F.current_timestamp()
    recent = io.where(F.col("created_at") >= moment - F.expr(f"INTERVAL {DEPTHS[depth]}"))
    by_run = recent.groupBy("run_id", "dataset_id").agg(
        F.max("created_at").alias("last_interaction_at"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("num_bytes", "num_rows", "num_files"))
    )
    started = runs.select(F.col("id").alias("run_id"), F.col("started_by_user_id").alias("user_id"))
    total = (
        by_run.join(started, "run_id")
        .groupBy("dataset_id", "user_id")
        .agg(F.max("last_interaction_at").alias("last_interaction_at"), F.sum("n").alias("num_of_interactions"), *(F.sum(c).alias(c) for c in ("num_bytes", "num_rows", "num_files")))
    )
    return named(total, users, datasets, locations)


def refresh(tables, folder: str, depths=tuple(DEPTHS), now: dt.datetime | None = None) -> None:
    """Writes the usage tables of inputs and outputs for each depth under ``folder``, replacing what was there."""
    for depth in depths:
        for name, io in (("input", tables.input), ("output", tables.output)):
            usage(io, tables.run, tables.user, tables.dataset, tables.location, depth, now).write.mode("overwrite").parquet(f"{folder}/{name}_{depth}_stats")


# usage by day

_SUMS = ("num_bytes", "num_rows", "num_files")


def day_sums(io: DataFrame, runs: DataFrame, tasks: int | None = None) -> DataFrame:
    """(day, dataset_id, user_id, last_interaction_at, num_of_interactions, sums): one row for each day on which a user's runs touched a dataset.

    There are nearly as many groups as facts, so they are dealt out to ``tasks`` tasks where that is given.
    """
    by_run = io.groupBy("run_id", "dataset_id", F.to_date("created_at").alias("day")).agg(F.max("created_at").alias("last_interaction_at"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    started = runs.select(F.col("id").alias("run_id"), F.col("started_by_user_id").alias("user_id"))
    rows, keys = by_run.join(started, "run_id"), ("day", "dataset_id", "user_id")
    return _added(rows if tasks is None else rows.repartition(tasks, *keys), "n", *keys)


def _added(rows: DataFrame, n: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("last_interaction_at").alias("last_interaction_at"), F.sum(n).alias("num_of_interactions"), *(F.sum(c).alias(c) for c in _SUMS))


def refresh_days(io: DataFrame, runs: DataFrame, path: str, days: list[dt.date] | None = None, tasks: int | None = None) -> None:
    """Writes the sums of ``days`` to ``path``, by day; other days stay as they are and are not read. Without ``days`` the table is made anew. ``tasks`` as of ``day_sums``."""
    if days is not None:
        if not days:
            return
        io = io.where(F.col("created_date").isin(days) if "created_date" in io.columns else F.to_date("created_at").isin(days))
    sums = day_sums(io, runs, tasks).hint("rebalance", "day")  # a day to a task, large ones to several
    sums.write.mode("overwrite").option("partitionOverwriteMode", "static" if days is None else "dynamic").partitionBy("day").parquet(path)


def usage_of_days(sums: DataFrame, io: DataFrame, runs: DataFrame, users: DataFrame, datasets: DataFrame, locations: DataFrame, depth: str, now: dt.datetime) -> DataFrame:
    """``usage`` made of the sums of days (``day_sums``, stored); facts are read for the day only in which the period begins."""
    since = F.lit(now) - F.expr(f"INTERVAL {DEPTHS[depth]}")
    whole = sums.where(F.col("day") > F.to_date(since)).select("dataset_id", "user_id", "last_interaction_at", "num_of_interactions", *_SUMS)
    edge = io.where((F.col("created_at") >= since) & (F.col("created_at") < F.date_add(F.to_date(since), 1)))
    edge = edge.where(F.col("created_date") == F.to_date(since)) if "created_date" in io.columns else edge
    edge = day_sums(edge, runs).select(*whole.columns)
    return named(_added(whole.unionByName(edge), "num_of_interactions", "dataset_id", "user_id"), users, datasets, locations)


def named(total: DataFrame, users: DataFrame, datasets: DataFrame, locations: DataFrame) -> DataFrame:
    """Sums by dataset_id and user_id with names of users, datasets and locations."""
    what = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"), "location_id")
    where = locations.select(F.col("id").alias("location_id"), F.col("name").alias("dataset_location"), F.col("type").alias("dataset_location_type"))
    people = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return total.join(people, "user_id").join(what, "dataset_id").join(where, "location_id", "left").drop("location_id")
