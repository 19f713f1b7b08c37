"""Event-time windows over transaction streams.

Arrival is the filing, event time the transaction: a row is late when it is filed more than
``STATE_DAYS - 1`` days after its transaction, which is what the watermark expresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(rows: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark needs a timestamp with a zone; plain timestamps are cast first."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def sliding_state(rows: DataFrame, *, column: str = "ts", width: str = "14 days", step: str = "1 day", delay: str = "13 days") -> DataFrame:
    """Counts and totals of each sliding window and type."""
    timed = with_event_time(rows, column, delay)
    return timed.groupBy(F.window(column, width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling_periods(rows: DataFrame, *, column: str = "ts", width: str = "21 days", delay: str = "13 days") -> DataFrame:
    """Non-overlapping periods."""
    return with_event_time(rows, column, delay).groupBy(F.window(column, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(rows: DataFrame, *, column: str = "ts", key: str = "user_id", gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """The gap-based cousin of clusters."""
    return with_event_time(rows, column, delay).groupBy(F.session_window(column, gap), key).agg(F.count("*").alias("n"))


def deduplicated(rows: DataFrame, *, column: str = "ts", key: str = "event_id", delay: str = "13 days") -> DataFrame:
    """First arrival of each key within the watermark."""
    return with_event_time(rows, column, delay).dropDuplicatesWithinWatermark([key])


def greedy_clusters(rows: DataFrame, *, key: str, owner: str, column: str, days: int = 14, buyers: int = 2) -> DataFrame:
    """Anchored clusters of a stream: state holds a key's open rows; a cluster is emitted when the watermark passes its end.

    Rows may arrive in any order within the watermark; clusters equal those of the batch operator
    as long as no row is later than that.
    """
    schema = f"{key} long, first_date date, last_date date"
    state = "days array<int>, owners array<long>"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*group.get, strict=True)) if group.exists else []
        for batch in batches:
            held += [(int(d), int(o)) for d, o in zip(batch["day"], batch["owner"], strict=True)]
        held.sort()
        passed = group.getCurrentWatermarkMs() // 86_400_000
        out, i = [], 0
        while i < len(held) and held[i][0] + days < passed:
            j = i
            while j + 1 < len(held) and held[j + 1][0] - held[i][0] <= days:
                j += 1
            if len({o for _, o in held[i : j + 1]}) >= buyers:
                out.append((held[i][0], held[j][0]))
                i = j + 1
            else:
                i += 1
        held = held[i:]
        if held:
            group.update(([d for d, _ in held], [o for _, o in held]))
            group.setTimeoutTimestamp(max((held[0][0] + days + 1) * 86_400_000, group.getCurrentWatermarkMs() + 1))
        elif group.exists:
            group.remove()
        dates = lambda k: [pd.Timestamp(x[k], unit="D").date() for x in out]
        yield pd.DataFrame({key: [keys[0]] * len(out), "first_date": dates(0), "last_date": dates(1)})

    timed = rows.select(F.col(key), F.col(owner).cast("long").alias("owner"), F.unix_date(F.to_date(column)).alias("day"), F.col(column))
    return timed.groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
