"""Filtered, searched and paged listings of entities with their statistics.

A filter that is not given is not applied, and neither is an empty list. Conditional joins are built only where a
filter needs them.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import among, ids_frame
from ..functions.ids import bounds_of
from ..functions.search import matches, rank, tokens
from .io_stats import in_period, io_statistics, operation_counts, per_location

MAX_PAGE_SIZE = 50


@dataclass
class Page:
    """One page of a listing with what a caller needs to turn it."""

    rows: DataFrame
    page: int
    page_size: int
    total_count: int

    @property
    def pages_count(self) -> int:
        return max(1, math.ceil(self.total_count / self.page_size))

    @property
    def has_next(self) -> bool:
        return self.page < self.pages_count

    @property
    def has_previous(self) -> bool:
        return self.page > 1

    @property
    def next_page(self) -> int | None:
        return self.page + 1 if self.has_next else None

    @property
    def previous_page(self) -> int | None:
        return self.page - 1 if self.has_previous else None


def page_rows(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """The rows of a page: ordered, so many skipped, so many taken (a top-k in one pass)."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page is from 1, page_size from 1 to {MAX_PAGE_SIZE}")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def by_rank(*order: Column) -> list[Column]:
    """The order of a searched listing: best match first, then as given."""
    return [F.desc("search_rank"), *order]


def paginate(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> Page:
    return Page(page_rows(df, order, page, page_size), page, page_size, df.count())


def any_of(df: DataFrame, column: Column | str, values: Collection | None) -> DataFrame:
    """Membership in a list that a caller names; no list, or an empty one, keeps all rows."""
    return df.where((F.col(column) if isinstance(column, str) else column).isin(list(values))) if values else df


def any_of_lower(df: DataFrame, column: str, values: Collection[str] | None) -> DataFrame:
    """``any_of`` without regard to case."""
    return any_of(df, F.lower(column), [v.lower() for v in values] if values else None)


def in_pairs(df: DataFrame, columns: tuple[str, str], pairs: Collection[tuple], kinds: tuple[str, str]) -> DataFrame:
    """The rows whose two columns are one of the given pairs."""
    wanted = df.sparkSession.createDataFrame(list(pairs), f"{columns[0]} {kinds[0]}, {columns[1]} {kinds[1]}").distinct()
    return df.join(wanted, list(columns), "left_semi")


def with_all_tags(df: DataFrame, bridge: DataFrame, entity: str, tag: str, wanted: Collection | None) -> DataFrame:
    """The entities that have every one of the given tag values."""
    if not wanted:
        return df
    having = bridge.where(F.col(tag).isin(list(wanted))).groupBy(entity).agg(F.count_distinct(tag).alias("n")).where(F.col("n") == len(set(wanted)))
    return df.join(having.select(F.col(entity).alias("id")), "id", "left_semi")


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each job, by (created_at, id)."""
    latest = runs.groupBy("job_id").agg(F.max_by(F.struct(*runs.columns), F.struct("created_at", "id")).alias("r"))
    return latest.select("r.*")


def grouped_tags(bridge: DataFrame, entity: str) -> DataFrame:
    """(entity, tag, values): the tag values of each entity by tag, sorted. ``bridge`` has entity, tag, value."""
    return bridge.groupBy(entity, "tag").agg(F.sort_array(F.collect_set("value")).alias("values"))


def search(df: DataFrame, branches: list[tuple[DataFrame, str, list[str]]], text: str) -> DataFrame:
    """Entities that match, with ``search_rank``: the largest rank of their branches.

    A branch is (frame, the column that refers to the entity, its name columns). The branches' matches are combined
    before the join, so the entity table is read once.
    """
    if len(text.strip()) < 3:
        raise ValueError("a search has three characters at least")
    found = None
    for frame, key, names in branches:
        vector = tokens(*map(F.col, names))
        hits = frame.select(F.col(key).alias("id"), vector.alias("v")).where(matches(F.col("v"), text)).select("id", rank(F.col("v"), text).alias("search_rank"))
        found = hits if found is None else found.unionByName(hits)
    ranks = found.groupBy("id").agg(F.max("search_rank").alias("search_rank"))
    return df.join(ranks, "id")


def _named(locations: DataFrame) -> DataFrame:
    return locations.select(F.col("id").alias("location_id"), F.col("type").alias("location_type"), F.col("name").alias("location_name"))


def with_tags(df: DataFrame, bridge: DataFrame, entity: str) -> DataFrame:
    """Entities with ``tags``: an array of (tag, values), sorted, empty where there are none. ``bridge`` has entity, tag, value; it is read for these entities only."""
    grouped = grouped_tags(among(bridge, df.select("id"), entity), entity)
    lists = grouped.groupBy(F.col(entity).alias("id")).agg(F.sort_array(F.collect_list(F.struct("tag", "values"))).alias("tags"))
    return df.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<tag:string,values:array<string>>>")))


def _with_addresses(tables, df: DataFrame, key: str = "location_id") -> list:
    """The branches of a search that find an entity by what its location is called: addresses and external id."""
    places = df.select("id", F.col(key).alias("location_id")) if key != "id" else df.select("id", F.col("id").alias("location_id"))
    urls = places.join(tables.address.select("location_id", "url"), "location_id")
    external = places.join(tables.location.select(F.col("id").alias("location_id"), "external_id"), "location_id")
    return [(urls, "id", ["url"]), (external, "id", ["external_id"])]


def datasets(tables, ids=None, tag_values=None, location_ids=None, location_types=None, text: str | None = None) -> DataFrame:
    """Datasets with their location; ordered pages come from ``paginate`` by (search_rank desc,) name."""
    df = any_of(any_of(tables.dataset, "id", ids), "location_id", location_ids)
    if tag_values:
        df = with_all_tags(df, tables.dataset_tag_value, "dataset_id", "tag_value", tag_values)
    df = any_of_lower(df.join(_named(tables.location), "location_id"), "location_type", location_types)
    return search(df, [(tables.dataset, "id", ["name"]), (df, "id", ["location_type", "location_name"]), *_with_addresses(tables, df)], text) if text else df


def jobs(tables, ids=None, types=None, tag_values=None, location_ids=None, location_types=None, text: str | None = None) -> DataFrame:
    """Jobs with their location; ``with_last_runs`` adds the last runs of a page of them."""
    df = any_of(any_of(any_of(tables.job, "id", ids), "type", types), "location_id", location_ids)
    if tag_values:
        df = with_all_tags(df, tables.job_tag_value, "job_id", "tag_value", tag_values)
    df = any_of_lower(df.join(_named(tables.location), "location_id"), "location_type", location_types)
    return search(df, [(tables.job, "id", ["name"]), (df, "id", ["location_type", "location_name"]), *_with_addresses(tables, df)], text) if text else df


def with_last_runs(page: DataFrame, tables) -> DataFrame:
    """A page of jobs with the id and time of their last runs, null where there is none. Runs are read for its jobs only."""
    runs = among(tables.run, page.select("id"), "job_id").select("id", "job_id", "created_at")
    last = last_runs(runs).select(F.col("job_id").alias("id"), F.col("id").alias("last_run_id"), F.col("created_at").alias("last_run_at"))
    return page.join(last, "id", "left")


def parents(runs: DataFrame, all_runs: DataFrame | None = None) -> DataFrame:
    """(id, parent_id, parent_job_id): the runs that have a parent, with it and its job; parents are looked up in ``all_runs``, bounded by their ids where these tell a time."""
    having = runs.where("parent_run_id is not null").select("id", F.col("parent_run_id").alias("parent_id"))
    found = runs if all_runs is None else all_runs
    return having.join(found.select(F.col("id").alias("parent_id"), F.col("job_id").alias("parent_job_id")), "parent_id").select("id", "parent_id", "parent_job_id")


def either(*pages: DataFrame) -> DataFrame:
    """The distinct rows of several listings that have the same columns."""
    return reduce(DataFrame.unionByName, pages).distinct()


def locations(tables, ids=None, types=None, text: str | None = None) -> DataFrame:
    """Locations with how many datasets and jobs they hold."""
    df = any_of_lower(any_of(tables.location, "id", ids), "type", types)
    for name, entities in (("total_datasets", tables.dataset), ("total_jobs", tables.job)):
        df = df.join(per_location(entities).select(F.col("location_id").alias("id"), F.col("total").alias(name)), "id", "left")
    df = df.na.fill(0, ["total_datasets", "total_jobs"])
    return search(df, [(tables.location, "id", ["type", "name", "external_id"]), _with_addresses(tables, df, "id")[0]], text) if text else df


def runs(tables, ids=None, since=None, until=None, job_ids=None, parent_run_ids=None, job_types=None, statuses=None, users=None, started_since=None, started_until=None, text: str | None = None, ended_since=None, ended_until=None, job_location_ids=None) -> DataFrame:
    """Runs with their job; ids with a time in them bound the days that are read; pages are ordered by (created_at desc, id desc)."""
    if (job_ids or parent_run_ids or text) and since is None:
        raise ValueError("since has to be given with job_ids, parent_run_ids or a search")
    low, high = bounds_of(ids)
    df = any_of(in_period(tables.run, since, until), "id", ids)
    df = in_period(df, low, high and high + dt.timedelta(microseconds=999))
    df = any_of(any_of(any_of(df, "job_id", job_ids), "parent_run_id", parent_run_ids), "status", statuses)
    df = in_period(df, started_since, started_until, "started_at")
    df = in_period(df, ended_since, ended_until, "ended_at")
    if job_types or job_location_ids:
        wanted = any_of(any_of(tables.job, "type", job_types), "location_id", job_location_ids)
        df = df.join(wanted.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    if users:
        df = df.join(any_of_lower(tables.user, "name", users).select(F.col("id").alias("started_by_user_id")), "started_by_user_id", "left_semi")
    if text:
        names = df.select("id", "job_id").join(tables.job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
        df = search(df, [(df, "id", ["external_id"]), (names, "id", ["job_name"])], text)
    return df


def with_run_statistics(page: DataFrame, tables) -> DataFrame:
    """A page of runs with input, output and operation statistics, 0 where there are none. Facts are read for its runs only."""
    ids = page.select("id")
    stats = io_statistics(ids, among(tables.input, ids, "run_id"), among(tables.output, ids, "run_id"), "run_id")
    counts = operation_counts(among(tables.operation, ids, "run_id"))
    return page.join(stats.withColumnRenamed("run_id", "id"), "id", "left").join(counts.withColumnRenamed("run_id", "id"), "id", "left").na.fill(0, ["total_operations"])


def with_operation_statistics(page: DataFrame, tables) -> DataFrame:
    """A page of operations with input and output statistics, 0 where there are none. Facts are read for its operations only."""
    ids = page.select("id")
    stats = io_statistics(ids, among(tables.input, ids, "operation_id"), among(tables.output, ids, "operation_id"), "operation_id")
    return page.join(stats.withColumnRenamed("operation_id", "id"), "id", "left")


def with_query_text(operations: DataFrame, queries: DataFrame) -> DataFrame:
    """Operations with ``sql_query``, the text of ``sql_fingerprint`` (``queries`` has fingerprint, query); null where there is none."""
    return operations.join(queries.select(F.col("fingerprint").alias("sql_fingerprint"), F.col("query").alias("sql_query")), "sql_fingerprint", "left")


def operations(tables, ids=None, run_ids=None, since=None, until=None) -> DataFrame:
    """Operations; run ids need a lower bound in time."""
    if not ids and not run_ids:
        raise ValueError("operations are listed by ids or by runs")
    if run_ids and since is None:
        raise ValueError("since has to be given with run_ids")
    low, high = bounds_of(ids)
    near = in_period(in_period(tables.operation, since, until), low, high and high + dt.timedelta(microseconds=999))
    return any_of(any_of(near, "id", ids), "run_id", run_ids)


def tags(tag_values: DataFrame, text: str | None = None) -> DataFrame:
    """(tag, values): tags with their sorted values; a search finds a tag by its name or a value. ``tag_values`` has tag, value."""
    rows = tag_values.select(F.col("tag").alias("id"), "value").distinct()
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_set("value")).alias("values"))
    found = search(grouped, [(rows.select("id", F.col("id").alias("name")).distinct(), "id", ["name"]), (rows, "id", ["value"])], text) if text else grouped
    return found.withColumnRenamed("id", "tag")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, sorted."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def touching(symlinks: DataFrame, ids: Collection) -> DataFrame:
    """Symlinks from or to one of the given datasets."""
    wanted = ids_frame(symlinks.sparkSession, ids)
    return among(symlinks, wanted, "from_dataset_id").unionByName(among(symlinks, wanted, "to_dataset_id")).distinct()
