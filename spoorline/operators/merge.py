"""Merging of repeated reports of an entity, inside a batch and with what is stored.

All merges are aggregations over (stored, new) rows with a sequence number, so a batch costs one shuffle by key and
the order of arrival inside it does not matter where the rules say so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_known(column: str, order: Column) -> Column:
    """The last value that is not null, by ``order``."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), order))


def largest_but_zero(column: str) -> Column:
    """The largest counter of a batch, where 0 stands for not known."""
    return F.max(F.when(F.col(column) != 0, F.col(column)))


def merge_io(batch: DataFrame) -> DataFrame:
    """Reports of one input or output inside a batch: first time, largest counters but 0, types combined, the schema that was told first (as ``extract.merged_rows``)."""
    keys = ["operation_id", "run_id", "job_id", "dataset_id"]
    types = [F.bit_or("type").alias("type")] if "type" in batch.columns else []
    return batch.groupBy(*keys).agg(
        F.min("created_at").alias("created_at"),
        F.min_by("schema_id", F.when(F.col("schema_id").isNotNull(), F.struct("created_at", "schema_id"))).alias("schema_id"),
        *(largest_but_zero(c).alias(c) for c in ("num_bytes", "num_rows", "num_files")),
        *types,
    )


def upsert_io(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new rows by time, operation, dataset and schema: counters greatest, where 0 counts; types combined. Another schema is a row of its own."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    types = [F.bit_or("type").alias("type")] if "type" in both.columns else []
    return both.groupBy("created_at", "operation_id", "run_id", "job_id", "dataset_id", "schema_id").agg(*(F.max(c).alias(c) for c in ("num_bytes", "num_rows", "num_files")), *types)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], greatest: tuple[str, ...] = ("status",)) -> DataFrame:
    """Stored and new rows by key: ``greatest`` columns take the largest, the others the new value if there is one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_new")]
    return both.groupBy(*keys).agg(*((F.max(c) if c in greatest else latest_known(c, F.col("_new"))).alias(c) for c in rest)).select(*keys, *rest)


def insert_missing(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not stored, one per key."""
    return new.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def replace_tags(stored: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """Tags of jobs: an entity with new tags has those only; the others keep theirs."""
    kept = stored.join(new.select(entity).distinct(), entity, "left_anti")
    return kept.unionByName(new.distinct())


def add_tags(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of datasets: new ones are added."""
    return stored.unionByName(new).distinct()


def fold_statuses(events: DataFrame, key: str, event_type: Column, at: str) -> DataFrame:
    """Events of one run folded to (key, status, started_at, ended_at): the largest status, the first start, the last end."""
    from ..functions.flags import status_of_event

    kind = F.upper(event_type)
    return events.groupBy(key).agg(
        F.max(status_of_event(event_type)).alias("status"),
        F.min(F.when(kind == "START", F.col(at))).alias("started_at"),
        F.max(F.when(kind.isin("COMPLETE", "FAIL", "ABORT"), F.col(at))).alias("ended_at"),
    )


def assign_ids(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of a dimension with ids that follow the largest stored one, in the order of their keys.

    The numbers come from zipping sorted partitions with their sizes, so no task sees all rows.
    """
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).head()[0]
    fresh = new.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)
    placed = fresh.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    from ..frames import cut

    placed = cut(placed)
    sizes = sorted(placed.groupBy("_part").count().collect())  # one row per partition
    offset, steps = top + 1, []
    for part, n in sizes:
        steps.append((part, offset))
        offset += n
    starts = new.sparkSession.createDataFrame(steps or [(0, top + 1)], "_part long, _start long")
    return placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_row")).drop("_at", "_part", "_row", "_start")


def collapse_partitions(datasets: DataFrame, name: Column) -> DataFrame:
    """(id, new_id): datasets whose names differ in partition directories only get the least id of them."""
    from pyspark.sql import Window as W

    from ..functions.text import strip_partitions

    low = F.lower(strip_partitions(name))
    return datasets.select("id", F.min("id").over(W.partitionBy("location_id", low)).alias("new_id"))


def repoint(facts: DataFrame, moved: DataFrame, column: str = "dataset_id") -> DataFrame:
    """Facts with ``column`` moved from ``id`` to ``new_id`` (of ``collapse_partitions``); ids that did not move stay."""
    changed = moved.where("id <> new_id").select(F.col("id").alias(column), F.col("new_id").alias("_to"))
    out = facts.join(changed, column, "left")
    return out.withColumn(column, F.coalesce("_to", column)).select(*facts.columns)


def match_locations(new: DataFrame, stored: DataFrame, addresses: DataFrame) -> DataFrame:
    """``new`` (type, name, addresses) with the ``id`` of the stored location (id, type, name) of that type and name, else of
    that type with one of the addresses (location_id, url), the least of several; null where there is none."""
    by_name = stored.select("type", "name", F.col("id").alias("_named")).groupBy("type", "name").agg(F.min("_named").alias("_named"))
    known = addresses.join(stored.select(F.col("id").alias("location_id"), "type"), "location_id").groupBy("type", "url").agg(F.min("location_id").alias("_at"))
    asked = new.select("type", "name", F.explode("addresses").alias("url")).join(known, ["type", "url"]).groupBy("type", "name").agg(F.min("_at").alias("_at"))
    out = new.join(by_name, ["type", "name"], "left").join(asked, ["type", "name"], "left")
    return out.select(*new.columns, F.coalesce("_named", "_at").alias("id"))


def location_groups(locations: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(location_type, location_name, stands_for): one row per location; of locations that are the same one name stands for all.

    ``locations`` has location_type, location_name, addresses and ``stored``. Locations of one type are the same where they
    share an address, also by way of others; ``links`` (location_type, location_name, stands_for) tells more of them. The
    least name among those that are ``stored`` stands for a group, else the least of all. A location without addresses
    stands for itself; null addresses count as none; rows of one location are taken together.
    """
    from .components import components

    key = ["location_type", "location_name"]
    vertex = lambda kind, c: F.concat_ws("\n", F.lit(kind), "location_type", c)
    named = locations.groupBy(*key).agg(F.max("stored").alias("stored"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("addresses", F.array().cast("array<string>"))))).alias("addresses"))
    edges = named.select(vertex("name", "location_name").alias("a"), F.explode(F.transform("addresses", lambda url: F.concat_ws("\n", F.lit("address"), "location_type", url))).alias("b"))
    if links is not None:
        edges = edges.union(links.select(vertex("name", "location_name").alias("a"), vertex("name", "stands_for").alias("b")))
    labels = components(edges)
    found = named.withColumn("v", vertex("name", "location_name")).join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    heads = found.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("stored"), F.col("location_name"))), F.min("location_name")).alias("stands_for"))
    return found.join(heads, "label").select(*key, "stands_for")


def set_external_id(locations: DataFrame, location_id: int, external_id: str | None) -> DataFrame:
    """Locations with the external id of one of them changed; KeyError where it is not there."""
    if locations.where(F.col("id") == location_id).isEmpty():
        raise KeyError(f"no location {location_id}")
    return locations.withColumn("external_id", F.when(F.col("id") == location_id, F.lit(external_id)).otherwise(F.col("external_id")))
