"""Adaptive concurrency: halved on a rate limit, one up after eight successes, never below or above its bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(state: tuple[int, int], status: int, least: int = 1, most: int = 32, after: int = 8) -> tuple[int, int]:
    """The next (limit, successes in a row)."""
    limit, run = state
    if status == 429:
        return max(least, limit // 2), 0
    return (min(most, limit + 1), 0) if run + 1 >= after else (limit, run + 1)


def fold(statuses: Column, initial: int = 4, least: int = 1, most: int = 32, after: int = 8) -> Column:
    """The limit after an array of statuses in order; a fold, as each step depends on the one before."""
    start = F.struct(F.lit(initial).alias("limit"), F.lit(0).alias("run"))

    def one(s, status):
        down = F.struct(F.greatest(F.lit(least), F.floor(s["limit"] / 2).cast("int")).alias("limit"), F.lit(0).alias("run"))
        up = F.struct(F.least(F.lit(most), s["limit"] + 1).alias("limit"), F.lit(0).alias("run"))
        return F.when(status == 429, down).when(s["run"] + 1 >= after, up).otherwise(F.struct(s["limit"].alias("limit"), (s["run"] + 1).alias("run")))

    return F.aggregate(statuses, start, one, lambda s: s["limit"])


def final_limits(outcomes: DataFrame, key: str = "user_id") -> DataFrame:
    """``key, final_limit`` of ``outcomes(key, ts, event_id, status)`` taken in order of time."""
    g = outcomes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "status"))).alias("o"))
    return g.select(key, fold(F.transform("o", lambda x: x["status"])).alias("final_limit"))
