"""The adaptive gate and the call log as streams; with ``availableNow`` they end like the batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import gate


def gate_stream(outcomes: DataFrame, key: str = "user_id", initial: int = 4) -> DataFrame:
    """``key, limit`` after each micro-batch; the state is the limit and the run of successes.

    Within a micro-batch a key's outcomes are taken by time; between them, as they arrive.
    """
    kind = dict(outcomes.dtypes)[key]

    def update(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (initial, 0)
        for status in pd.concat(list(frames)).sort_values(["ts", "event_id"])["status"]:
            now = gate.step(now, int(status))
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "limit": [now[0]]})

    return outcomes.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, limit int", "limit int, run int", "update", GroupStateTimeout.NoTimeout)


def usage_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls and tokens by hour and model, late events allowed for; missing token counts aren't zeros."""
    w = events.withWatermark("at", late).groupBy(F.window("at", window), "model")
    return w.agg(F.count("*").alias("calls"), F.sum("usage").alias("usage"), F.count("usage").alias("with_usage"))
