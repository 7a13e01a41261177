"""Bit masks of output types and column relations, and the order of statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of what an output did to a dataset.
OUTPUT_TYPES = {"APPEND": 1, "CREATE": 2, "ALTER": 4, "RENAME": 8, "OVERWRITE": 16, "DROP": 32, "TRUNCATE": 64, "DELETE": 128, "UPDATE": 256, "MERGE": 512}
#: Bits of how a column depends on another.
RELATION_TYPES = {
    "UNKNOWN": 1,
    "IDENTITY": 2,
    "TRANSFORMATION": 4,
    "TRANSFORMATION_MASKING": 8,
    "AGGREGATION": 16,
    "AGGREGATION_MASKING": 32,
    "FILTER": 64,
    "JOIN": 128,
    "GROUP_BY": 256,
    "SORT": 512,
    "WINDOW": 1024,
    "CONDITIONAL": 2048,
}
#: A later status is the larger one.
STATUSES = {"UNKNOWN": -1, "STARTED": 0, "SUCCEEDED": 1, "FAILED": 2, "KILLED": 3}
EVENT_STATUS = {"START": 0, "RUNNING": 0, "COMPLETE": 1, "FAIL": 2, "ABORT": 3}


def decode_flags(mask: Column, flags: dict[str, int]) -> Column:
    """The names of the bits that are set, in the order of the bits; null for null."""
    names = F.array(*(F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in flags.items()))
    return F.when(mask.isNotNull(), F.array_compact(names))


def encode_flags(names: Column, flags: dict[str, int]) -> Column:
    """The mask of an array of names; unknown names add nothing, null gives null."""
    bits = F.create_map(*(F.lit(x) for pair in flags.items() for x in pair))
    return F.aggregate(names, F.lit(0), lambda mask, name: mask.bitwiseOR(F.coalesce(bits[name], F.lit(0))))


def status_of_event(event_type: Column) -> Column:
    """The status that an event type reports; OTHER and unknown types give -1."""
    known = F.create_map(*(F.lit(x) for pair in EVENT_STATUS.items() for x in pair))
    return F.coalesce(known[F.upper(event_type)], F.lit(-1))


def count_or_null(value: Column) -> Column:
    """A counter as long; the largest 64-bit number, which some engines send for unknown, becomes null."""
    wide = value.cast("decimal(20,0)")
    return F.when(wide < F.lit(2**63 - 1).cast("decimal(20,0)"), wide.cast("long"))
