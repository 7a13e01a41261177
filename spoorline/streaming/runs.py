"""Runs folded in the state of a stream: a row for each run, from its first event to its last, told anew when it changes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.flags import status_of_event

FOLDED = "key string, status int, started_at timestamp, ended_at timestamp"
_STATE = "status int, started long, ended long"


def fold(stream: DataFrame, key: str, event_type: str, at: str, forget: dt.timedelta | None = None) -> DataFrame:
    """(key, status, started_at, ended_at), in update mode: what ``merge.fold_statuses`` makes of all events of a run so far.

    The largest status, the first START and the last end; events may come in any order, late ones count, and one that
    comes again changes nothing. A state is three numbers a run. With ``forget`` a run that has ended is forgotten when
    that time has gone by without an event of it; an event that still comes after begins the run anew, so a store that
    merges by key is right either way. Events without a key are left out.
    """
    kind = F.upper(event_type)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = stream.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), status_of_event(F.col(event_type)).cast("int").alias("status"),
        F.when(kind == "START", micros).alias("started"), F.when(kind.isin("COMPLETE", "FAIL", "ABORT"), micros).alias("ended"),
    )
    # numbers as text through pandas, so that a null beside them makes no fractions
    rows = rows.select("key", "status", F.col("started").cast("string").alias("started"), F.col("ended").cast("string").alias("ended"))
    wait = None if forget is None else int(forget.total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        status, started, ended = before or (None, None, None)
        for pdf in frames:
            told = [int(x) for x in pdf["status"]]
            status = max([*told, *([] if status is None else [status])])
            first, last = [int(x) for x in pdf["started"].dropna()], [int(x) for x in pdf["ended"].dropna()]
            started = min([*first, *([] if started is None else [started])], default=None)
            ended = max([*last, *([] if ended is None else [ended])], default=None)
        after = (status, started, ended)
        if after != before:
            state.update(after)
        if wait is not None and ended is not None:
            state.setTimeoutDuration(wait)
        if after != before:
            instant = lambda x: pd.Series([pd.NaT if x is None else pd.Timestamp(x, unit="us")], dtype="datetime64[us]")
            yield pd.DataFrame({"key": [key[0]], "status": [status], "started_at": instant(started), "ended_at": instant(ended)})

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(step, FOLDED, _STATE, "update", timeout)
