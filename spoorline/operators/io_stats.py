"""Reads and writes of datasets: de-duplication, roll-ups, statistics and dataset-to-dataset relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("num_bytes", "num_rows", "num_files")
OPERATION, RUN, JOB, DATASET = "OPERATION", "RUN", "JOB", "DATASET"
KEYS = {OPERATION: ["operation_id", "run_id", "job_id", "dataset_id"], RUN: ["run_id", "job_id", "dataset_id"], JOB: ["job_id", "dataset_id"]}


def _by_time(schema: str = "schema_id", created: str = "created_at") -> Column:
    return F.struct(F.col(created), F.col(schema).isNull(), F.col(schema))


def dedup_io(io: DataFrame) -> DataFrame:
    """One row per job, run, operation and dataset. Counters are cumulative, so the largest counts; output types are combined.

    The schemas are those of the earliest and latest row by (created_at, schema_id, nulls last). One hash
    aggregation with partial sums, where a window would sort.
    """
    types = [F.bit_or("type").alias("types")] if "type" in io.columns else []
    return io.groupBy("job_id", "run_id", "operation_id", "dataset_id").agg(
        F.max("created_at").alias("last_interaction_at"),
        *(F.max(c).alias(c) for c in COUNTERS),
        F.min_by("schema_id", _by_time()).alias("oldest_schema_id"),
        F.max_by("schema_id", _by_time()).alias("newest_schema_id"),
        *types,
    )


def _sums(df: DataFrame) -> list[Column]:
    types = [F.bit_or("types").alias("types")] if "types" in df.columns else []
    return [
        F.max("last_interaction_at").alias("last_interaction_at"),
        *(F.sum(c).alias(c) for c in COUNTERS),
        F.min("oldest_schema_id").alias("oldest_schema_id"),
        F.max("newest_schema_id").alias("newest_schema_id"),
        *types,
    ]


def roll_up(deduped: DataFrame, granularity: str) -> DataFrame:
    """Sums by operation, run or job; the ids of finer entities become null."""
    keys = KEYS[granularity]
    kinds = dict(deduped.dtypes)
    out = deduped.groupBy(*keys).agg(*_sums(deduped))
    return out.select(*(F.col(k) if k in keys else F.lit(None).cast(kinds[k]).alias(k) for k in KEYS[OPERATION]), *(c for c in out.columns if c not in keys))


def roll_up_sets(deduped: DataFrame, granularities) -> DataFrame:
    """``roll_up`` for several granularities in one pass over the rows."""
    if len(granularities) == 1:
        return roll_up(deduped, granularities[0])
    known = {KEYS[g][0]: g for g in granularities}  # the finest id that a row has tells its granularity
    keys = [k for k in KEYS[OPERATION] if any(k in KEYS[g] for g in granularities)]
    kinds = dict(deduped.dtypes)
    out = deduped.groupingSets([[F.col(k) for k in KEYS[g]] for g in known.values()], *map(F.col, keys)).agg(*_sums(deduped))
    return out.select(*(F.col(k) if k in keys else F.lit(None).cast(kinds[k]).alias(k) for k in KEYS[OPERATION]), *(c for c in out.columns if c not in keys))


def roll_up_steps(deduped: DataFrame, granularities, tasks: int | None = None) -> DataFrame:
    """``roll_up`` for several granularities, finest first, each from the one before; runs are dealt out to ``tasks``.

    Grouping sets shuffle every row once for each granularity. Here the first one of operations is the rows as they are,
    and rows that are dealt out by run are folded where they lie.
    """
    parts = []
    for g in granularities:
        rows = parts[-1] if parts else deduped
        rows = rows.repartition(tasks, "run_id") if g == RUN and tasks else rows
        parts.append(rows.select(*roll_up(rows, g).columns) if g == OPERATION else roll_up(rows, g))
    return reduce(DataFrame.unionByName, parts)


def roll_up_all(deduped: DataFrame) -> DataFrame:
    """All three granularities in one pass; ``granularity`` names them."""
    sets = [[F.col(k) for k in KEYS[g]] for g in (OPERATION, RUN, JOB)]
    out = deduped.groupingSets(sets, *map(F.col, KEYS[OPERATION])).agg(*_sums(deduped), F.grouping("operation_id").alias("_op"), F.grouping("run_id").alias("_run"))
    granularity = F.when(F.col("_run") == 1, JOB).when(F.col("_op") == 1, RUN).otherwise(OPERATION)
    return out.withColumn("granularity", granularity).drop("_op", "_run")


def schema_relevance(oldest: str = "oldest_schema_id", newest: str = "newest_schema_id") -> Column:
    """EXACT_MATCH where one schema was seen throughout, LATEST_KNOWN where it changed, null without a schema."""
    return F.when(F.col(newest).isNull(), None).when(F.col(oldest) == F.col(newest), "EXACT_MATCH").otherwise("LATEST_KNOWN")


def statistics(deduped: DataFrame, by: str) -> DataFrame:
    """Datasets and summed counters by ``by`` (a run, operation or other id column); missing counters count as 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c.removeprefix('num_')}") for c in COUNTERS]
    return deduped.groupBy(by).agg(F.count_distinct("dataset_id").alias("total_datasets"), *sums)


def io_statistics(entities: DataFrame, inputs: DataFrame, outputs: DataFrame, by: str) -> DataFrame:
    """For each id in ``entities`` its input and output statistics, 0 where there are none."""
    out = entities.select(F.col("id").alias(by))
    for side, io in (("inputs", inputs), ("outputs", outputs)):
        stats = statistics(dedup_io(io), by)
        out = out.join(stats.select(by, *(F.col(c).alias(f"{side}_{c}") for c in stats.columns if c != by)), by, "left")
    return out.na.fill(0)


def operation_counts(operations: DataFrame) -> DataFrame:
    """Operations by run."""
    return operations.groupBy("run_id").agg(F.count_distinct("id").alias("total_operations"))


def per_location(entities: DataFrame) -> DataFrame:
    """Datasets or jobs by location."""
    return entities.groupBy("location_id").agg(F.count_distinct("id").alias("total"))


def in_period(df: DataFrame, since=None, until=None, column: str = "created_at") -> DataFrame:
    """The rows from ``since`` through ``until``, both inclusive, either may be open. Plain comparisons, so they reach the scan.

    Facts that are stored by day (``created_date``) are bounded by day too, so that only those days are opened.
    """
    by_day = column == "created_at" and "created_date" in df.columns
    for bound, within in ((since, lambda c, v: c >= v), (until, lambda c, v: c <= v)):
        if bound is not None:
            df = df.where(within(F.col(column), F.lit(bound)))
            df = df.where(within(F.col("created_date"), F.to_date(F.lit(bound)))) if by_day else df
    return df


def dataset_relations(inputs: DataFrame, outputs: DataFrame, since=None, until=None) -> DataFrame:
    """(in_dataset_id, out_dataset_id): datasets that an operation reads and writes, within the period on both sides.

    With the last write and the earliest and latest schemas of either side. Each side is first reduced to one row
    per operation and dataset, so an operation that reports often doesn't multiply.
    """

    def side(io: DataFrame, name: str) -> DataFrame:
        return (
            in_period(io, since, until)
            .groupBy("operation_id", F.col("dataset_id").alias(f"{name}_dataset_id"))
            .agg(
                F.max("created_at").alias(f"{name}_at"),
                F.min(F.struct("created_at", F.col("schema_id").isNull().alias("none"), "schema_id")).alias(f"{name}_oldest"),
                F.max(F.struct("created_at", F.col("schema_id").isNull().alias("none"), "schema_id")).alias(f"{name}_newest"),
            )
        )

    pairs = side(inputs, "in").join(side(outputs, "out"), "operation_id").where("in_dataset_id <> out_dataset_id")
    return pairs.groupBy("in_dataset_id", "out_dataset_id").agg(
        F.max("out_at").alias("last_interaction_at"),
        F.min("in_oldest")["schema_id"].alias("oldest_input_schema_id"),
        F.max("in_newest")["schema_id"].alias("newest_input_schema_id"),
        F.min("out_oldest")["schema_id"].alias("oldest_output_schema_id"),
        F.max("out_newest")["schema_id"].alias("newest_output_schema_id"),
    )
