"""String rules of ingest: locations, partition paths, SQL statements, tags, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flags import OUTPUT_TYPES

#: What a statement's first keyword does to its output. ALTER counts only where none of the others is found.
STATEMENTS = {
    "MERGE": "MERGE",
    "INSERT": "APPEND",
    "UPDATE": "UPDATE",
    "DELETE": "DELETE",
    "CREATE": "CREATE",
    "RENAME": "RENAME",
    "TRUNCATE": "TRUNCATE",
    "DROP": "DROP",
    "COPY": "APPEND",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written into the plan once, where ``body`` names it several times."""
    return F.transform(F.array(value), body)[0]


def scheme_of(namespace: Column) -> Column:
    """The lower-case scheme of a namespace; ``unknown`` without one. A bare ``file`` is the local file system."""
    low = F.lower(namespace)
    named = let(F.regexp_extract(low, r"^([a-z][a-z0-9+.\-]*):", 1), lambda scheme: F.when(scheme != "", scheme).otherwise(F.lit("unknown")))
    return F.when(low == "file", F.lit("file")).otherwise(named)


def authority_of(namespace: Column) -> Column:
    """What stands between the scheme and the path of a namespace, or else its path."""
    low = F.lower(namespace)
    rest = F.when(low == "file", F.lit("")).otherwise(F.regexp_replace(low, r"^[a-z][a-z0-9+.\-]*:", ""))

    def found(rest: Column) -> Column:
        host = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
        return F.when(rest.startswith("//") & (host != ""), host).otherwise(F.regexp_extract(F.regexp_replace(rest, r"^//", ""), r"^([^?#]*)", 1))

    return let(rest, found)


def hosts_of(namespace: Column) -> Column:
    """The hosts of a dataset's namespace, which may list several; ``unknown`` where there is none."""
    return let(F.filter(F.split(authority_of(namespace), ","), lambda h: h != ""), lambda hosts: F.when(F.size(hosts) > 0, hosts).otherwise(F.array(F.lit("unknown"))))


def dataset_location(namespace: Column) -> Column:
    """struct(type, name, addresses) of a dataset's namespace: the first host names the location."""

    def where(x: Column) -> Column:
        addresses = F.transform(x["hosts"], lambda h: F.concat(x["scheme"], F.lit("://"), h))
        return F.struct(x["scheme"].alias("type"), x["hosts"][0].alias("name"), addresses.alias("addresses"))

    return let(namespace, lambda n: F.when(n.isNotNull(), let(F.struct(scheme_of(n).alias("scheme"), hosts_of(n).alias("hosts")), where)))


def job_location(namespace: Column) -> Column:
    """struct(type, name, addresses) of a job's namespace; several hosts stay one name."""

    def where(x: Column) -> Column:
        return F.struct(x["scheme"].alias("type"), x["name"].alias("name"), F.array(F.concat(x["scheme"], F.lit("://"), x["name"])).alias("addresses"))

    return let(namespace, lambda n: F.when(n.isNotNull(), let(F.struct(scheme_of(n).alias("scheme"), authority_of(n).alias("name")), where)))


def strip_partitions(path: Column) -> Column:
    """A path without its partition directories (``key=value``) and what follows them."""
    base = F.regexp_extract(path, r"^(.*?)/[^/=]+=", 1)
    return F.when(base != "", base).otherwise(path)


def output_type_of_sql(query: Column) -> Column:
    """The bit of what a statement does: by the keyword that comes first, or ALTER where only that is found; null else.

    ``DROP COLUMN`` is no DROP: it is part of an ALTER.
    """
    words = "|".join(f"{k}(?!\\sCOLUMN)" if k == "DROP" else k for k in STATEMENTS)
    found = F.upper(F.regexp_extract(query, rf"(?is)\b({words})\s", 1))
    bits = F.create_map(*(F.lit(x) for word, name in STATEMENTS.items() for x in (word, OUTPUT_TYPES[name])))
    return F.when(found != "", bits[found]).when(query.rlike(r"(?is)\bALTER\s"), F.lit(OUTPUT_TYPES["ALTER"]))


def tag_of(text: Column) -> Column:
    """struct(key, value, source) of ``key:value[:source]``; null without a colon."""
    parts = F.split(text, ":", 3)
    return F.when(F.size(parts) > 1, F.struct(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"), F.get(parts, F.lit(2)).alias("source")))


def job_type(integration: Column, kind: Column) -> Column:
    """``INTEGRATION_KIND`` in capitals; the integration alone without a kind; null without an integration."""
    named = F.when(F.coalesce(kind, F.lit("")) != "", F.concat_ws("_", integration, kind)).otherwise(integration)
    return F.when(integration.isNotNull(), F.upper(named))


def hourly_tick(event_time: Column, anchor: Column) -> Column:
    """The start of the hour, counted from ``anchor``, in which an event falls; events before the anchor are at it."""
    hour = F.lit(3_600_000_000)
    passed = F.floor((F.unix_micros(event_time) - F.unix_micros(anchor)) / hour) * hour
    return F.greatest(anchor, F.timestamp_micros(F.unix_micros(anchor) + passed.cast("long")))
