"""The time difference of histograms over a stream, with the last counts of each series as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "series string, ts bigint, n array<bigint>, value_dropped boolean"


def stream_time_diff(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(series, ts, n: counts by bucket) -> (series, ts, n: differences, value_dropped).

    Snapshots of a series are taken in order of ts within a trigger; later triggers go on from the state. A snapshot
    that is not newer than the last one of its series is left out. The state of a series that has had no snapshot for
    idle_ms of processing time is dropped, and its next one counts as its first. That needs batches without data, so such a
    query runs until it is stopped, with any trigger. By default states are kept."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_ts, last = state.get if state.exists else (None, [])
        last = list(last)
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            if last_ts is not None and row.ts <= last_ts:
                continue
            now = [int(v) for v in row.n]
            before = last + [0] * (len(now) - len(last))
            out.append((key[0], int(row.ts), [b if b < a else b - a for a, b in zip(before, now)], any(b < a for a, b in zip(before, now))))
            last_ts, last = int(row.ts), now
        if last_ts is not None:
            state.update((last_ts, last))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["series", "ts", "n", "value_dropped"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.select("series", "ts", "n").groupBy("series").applyInPandasWithState(step, _OUT, "ts bigint, n array<bigint>", "append", timeout)


def stream_section_counts(rows: DataFrame, predicate: Column) -> DataFrame:
    """Hits by (vec, sect) of a growing vector, as a running aggregate."""
    return rows.groupBy("vec", F.shiftright("pos", 8).alias("sect")).agg(F.count("*").alias("n"), F.count_if(predicate).alias("hits"))
