"""Identifiers: name-based and time-based UUIDs as column expressions, and time bounds from them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dashed(h: Column) -> Column:
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _variant(digit: Column) -> Column:
    """The hexadecimal digit with its two upper bits set to 10."""
    value = F.conv(digit, 16, 10).cast("int")
    return F.lower(F.hex((value.bitwiseAND(F.lit(3)) + 8).cast("long")))


def static_uuid(text: Column) -> Column:
    """UUIDv5 of a text in the URL namespace."""
    h = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(text, "utf-8")))
    fixed = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), _variant(F.substring(h, 17, 1)), F.substring(h, 18, 15))
    return F.when(text.isNotNull(), _dashed(fixed))


def incremental_uuid(instant: Column, data: Column) -> Column:
    """UUIDv7 with the milliseconds of ``instant`` and, in place of random bits, the first bits of a SHA-1 of instant and data."""
    zone = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(instant) % 1_000_000
    iso = F.concat(zone, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))
    h = F.sha1(F.encode(F.concat(iso, data), "utf-8"))
    # 76 bits of the digest: 12 after the version, 2 left beside the variant, 62 at the end
    low = F.substring(h, 1, 19)
    time = F.lower(F.lpad(F.hex(F.unix_millis(instant)), 12, "0"))
    fixed = F.concat(time, F.lit("7"), F.substring(low, 1, 3), _variant(F.substring(low, 4, 1)), F.substring(low, 5, 15))
    return _dashed(fixed)


def uuid_instant(value: Column) -> Column:
    """The instant in a UUIDv7; null where the version is below 6."""
    version = F.conv(F.substring(value, 15, 1), 16, 10).cast("int")
    millis = F.conv(F.concat(F.substring(value, 1, 8), F.substring(value, 10, 4)), 16, 10).cast("long")
    return F.when(version >= 6, F.timestamp_millis(millis))


def instant_of(value: str) -> dt.datetime:
    """The instant in a UUIDv7, for ids that a caller names."""
    u = uuid.UUID(value)
    if u.version is None or u.version < 6:
        raise ValueError(f"{value} has no time in it")
    return dt.datetime.fromtimestamp((u.int >> 80) / 1000, dt.UTC)


def id_bounds(ids: Iterable[str]) -> tuple[dt.datetime, dt.datetime]:
    """The earliest and latest instant among ids."""
    instants = [instant_of(i) for i in ids]
    return min(instants), max(instants)


def bounds_of(ids, column: str = "id") -> tuple[dt.datetime | None, dt.datetime | None]:
    """``id_bounds`` of a list or of a frame's column; (None, None) where some id has no time in it, or there is none."""
    if isinstance(ids, DataFrame):
        if dict(ids.dtypes)[column] != "string":
            return None, None
        instant = uuid_instant(F.col(column))
        low, high, known, n = ids.agg(F.min(F.unix_millis(instant)), F.max(F.unix_millis(instant)), F.count(instant), F.count("*")).head()
        if not n or known < n:
            return None, None
        return tuple(dt.datetime.fromtimestamp(x / 1000, dt.UTC) for x in (low, high))
    try:
        return id_bounds(ids) if ids else (None, None)
    except (ValueError, AttributeError):
        return None, None


#: Days that a condition names one by one; beyond, the first and the last bound them.
MOST_DAYS = 64


def near_ids(df: DataFrame, ids: DataFrame, column: str = "id", created: str = "created_at") -> DataFrame:
    """The rows of ``df`` that were created when the ids of a frame say, by a range of instants and, for tables by day, by the days themselves.

    For tables whose rows are made with their ids (runs, operations). ``ids`` should be stored: it is read for its
    instants. Where some id has no time in it, nothing is bounded.
    """
    from ..operators.io_stats import in_period

    if dict(ids.dtypes)[column] != "string":
        return df
    instant = uuid_instant(F.col(column))
    days = ids.groupBy(F.to_date(instant).alias("day")).agg(F.min(F.unix_millis(instant)).alias("low"), F.max(F.unix_millis(instant)).alias("high"))
    told = days.agg(F.min("low"), F.max("high"), F.count("*"), F.count("day"), F.slice(F.sort_array(F.collect_set("day")), 1, MOST_DAYS + 1)).head()
    low, high, n, known, named = told
    if not n or known < n:
        return df
    low, high = (dt.datetime.fromtimestamp(x / 1000, dt.UTC) for x in (low, high))
    near = in_period(df, low, high + dt.timedelta(microseconds=999), created)
    return near.where(F.col("created_date").isin(named)) if "created_date" in df.columns and 1 < len(named) <= MOST_DAYS else near


def with_id_bounds(df: DataFrame, ids: Iterable[str], column: str = "id", created: str = "created_at") -> DataFrame:
    """The rows with the given ids, read from the days that the ids themselves tell (which Catalyst can't infer)."""
    from ..operators.io_stats import in_period

    wanted = sorted(set(ids))
    if not wanted:
        return df.where(F.lit(False))
    lowest, highest = id_bounds(wanted)
    near = in_period(df, lowest, highest + dt.timedelta(microseconds=999), created)
    return near.where(F.col(column).isin(wanted))
