"""Column lineage: which columns of a dataset a column of another depends on, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import among, among_many
from ..functions.flags import RELATION_TYPES, decode_flags
from .io_stats import in_period


def combined(lineage: DataFrame, relations: DataFrame, since=None, until=None, tasks: int | None = None) -> DataFrame:
    """One row per source and target dataset and column: types combined, and when it was last seen.

    Operations share relation sets by fingerprint. Facts are first reduced to one row per dataset pair and
    fingerprint, so the join makes a row per distinct relation, not per operation. Facts are dealt out by
    fingerprint, and what the join makes by dataset pair, to ``tasks`` tasks where that is given; Spark makes few of rows that compress well, and each would hold many groups.
    """
    facts = in_period(lineage, since, until)
    facts = facts if tasks is None else facts.repartition(tasks, "fingerprint")
    facts = facts.groupBy("source_dataset_id", "target_dataset_id", "fingerprint").agg(F.max("created_at").alias("last_used_at"))
    rows = facts.join(relations, "fingerprint")
    rows = rows if tasks is None else rows.repartition(tasks, "source_dataset_id", "target_dataset_id")
    return (
        rows.groupBy("source_dataset_id", "target_dataset_id", "source_column", "target_column")
        .agg(F.bit_or("type").alias("types"), F.max("last_used_at").alias("last_used_at"))
    )


def of_entities(lineage: DataFrame, relations: DataFrame, column: str, ids: DataFrame, sources: DataFrame, targets: DataFrame, since=None, until=None, tasks: int | None = None) -> DataFrame:
    """``combined`` for the given jobs, runs or operations (``column`` names which), between datasets that are shown. ``ids`` should be stored."""
    rows = among(among(among_many(lineage, ids, column, tasks), sources, "source_dataset_id"), targets, "target_dataset_id")
    return combined(rows, relations, since, until, tasks)


def of_pairs(lineage: DataFrame, relations: DataFrame, pairs: DataFrame, since=None, until=None, tasks: int | None = None) -> DataFrame:
    """``combined`` for (source_dataset_id, target_dataset_id) pairs."""
    return combined(lineage.join(pairs, ["source_dataset_id", "target_dataset_id"], "left_semi"), relations, since, until, tasks)


def direct(rows: DataFrame) -> DataFrame:
    """One row per dataset pair and target column: the source columns with their types, by name."""
    source = F.struct(F.col("source_column").alias("field"), decode_flags(F.col("types"), RELATION_TYPES).alias("types"), "last_used_at")
    return rows.where("target_column is not null").groupBy("source_dataset_id", "target_dataset_id", "target_column").agg(F.sort_array(F.collect_list(source)).alias("sources"))


def indirect(rows: DataFrame) -> DataFrame:
    """One row per dataset pair: the source columns on which the target depends as a whole, by name."""
    source = F.struct(F.col("source_column").alias("field"), decode_flags(F.col("types"), RELATION_TYPES).alias("types"), "last_used_at")
    return rows.where("target_column is null").groupBy("source_dataset_id", "target_dataset_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))


def new_relations(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The relation rows whose fingerprint is not stored yet."""
    return incoming.join(stored.select("fingerprint").distinct(), "fingerprint", "left_anti")
