"""Token counts and costs, from calls to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_usage(calls: DataFrame, key: str) -> DataFrame:
    """Sums over a document's calls: tokens of all, pages of those that a model read; missing counts stay missing."""
    model = F.col("parser") == "LLM_PARSE"
    g = calls.groupBy(key).agg(F.sum(F.when(model, F.col("input"))).alias("input"), F.sum(F.when(model, F.col("output"))).alias("output"), F.sum(model.cast("long")).alias("llm_pages"))
    g = g.fillna(0, ["input", "output"])
    return g.select(key, "input", "output", (F.col("input") + F.col("output")).alias("total"), "llm_pages")


def cost(usage: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """Costs by a small table of rates a million tokens and an image; without a rate the costs are null."""
    u = usage.join(F.broadcast(rates), key, "left")  # a handful of models, from a literal or one file
    part = lambda n, rate: F.col(n) * F.col(rate) / 1e6
    image = F.col("llm_pages") * F.col("image_rate")
    return u.select(key, part("input", "input_rate").alias("cost_input"), image.alias("cost_image"), part("output", "output_rate").alias("cost_output"), (part("input", "input_rate") + image + part("output", "output_rate")).alias("cost_total"))


def pair_calls(events: DataFrame) -> DataFrame:
    """Start and finish of each ``call_id`` in one row: ``call_id, seconds, retries, usage``; an open call has nulls."""
    of = lambda kind, c: F.max(F.when(F.col("event") == kind, F.col(c)))
    g = events.groupBy("call_id").agg(of("start", "at").alias("started"), of("finish", "at").alias("finished"), F.max("attempt").alias("attempt"), F.sum("usage").alias("usage"))
    return g.select("call_id", (F.col("finished") - F.col("started")).alias("seconds"), (F.col("attempt") - 1).alias("retries"), "usage")
