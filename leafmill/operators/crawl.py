"""Pages reached over links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``page_id, min_depth`` of the pages within ``depth`` links of ``roots(page_id)``.

    A round joins the frontier to the links and drops what was seen; the rounds are as many as the depth.
    """
    seen = roots.select("page_id", F.lit(0).alias("min_depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        front = front.join(edges, front.page_id == edges.src).select(F.col("dst").alias("page_id")).distinct()
        front = front.join(seen, "page_id", "left_anti").withColumn("min_depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def visits(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``depth, visits``: how many pages are visited at each depth if none are remembered; paths are counted, not listed."""
    front = roots.groupBy("page_id").agg(F.count("*").alias("n"))
    out = front.agg(F.lit(0).alias("depth"), F.sum("n").alias("visits"))
    for d in range(1, depth + 1):
        front = front.join(edges, front.page_id == edges.src).groupBy(F.col("dst").alias("page_id")).agg(F.sum("n").alias("n"))
        out = out.unionByName(front.agg(F.lit(d).alias("depth"), F.sum("n").alias("visits")))
    return out
