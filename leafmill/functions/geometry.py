"""Boxes and numbers: expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(box: dict[str, Column], width: Column, height: Column) -> list[Column]:
    return [(box["x0"] / width).alias("x0"), (box["top"] / height).alias("top"), (box["x1"] / width).alias("x1"), (box["bottom"] / height).alias("bottom")]


def vertical_overlap(top_a: Column, bottom_a: Column, top_b: Column, bottom_b: Column) -> Column:
    """Common height over the smaller height; 0 for boxes without height."""
    smaller = F.least(bottom_a - top_a, bottom_b - top_b)
    return F.when(smaller <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(bottom_a, bottom_b) - F.greatest(top_a, top_b)) / smaller)


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("top", "bottom")


def touches(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Boxes that share a point, edges included."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["top"] <= b["bottom"]) & (a["bottom"] >= b["top"])


def columns(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x0", "top", "x1", "bottom")}


def pixel_box(xs: Column, ys: Column, width: int, height: int, dx: int = 0, dy: int = 0) -> Column:
    """Integer box of a polygon: least corners cut to integers, greatest rounded up, moved and kept on the page."""
    low = lambda v, d, most: F.greatest(F.lit(0), F.least(F.lit(most), F.array_min(v).cast("int") + d))
    high = lambda v, d, most: F.greatest(F.lit(0), F.least(F.lit(most), F.ceil(F.array_max(v)).cast("int") + d))
    return F.struct(low(xs, dx, width).alias("x0"), low(ys, dy, height).alias("y0"), high(xs, dx, width).alias("x1"), high(ys, dy, height).alias("y1"))


def merge_boxes(boxes: Column, threshold: float = 0.02) -> Column:
    """Boxes that touch vertically and are near horizontally, merged along the reading order.

    A fold over the sorted array: the growing box decides what joins it, so neighbours alone don't tell. Its left
    edge isn't moved. ``boxes`` are structs (x0, top, x1, bottom).
    """
    kind = "array<struct<x0:double,top:double,x1:double,bottom:double>>"
    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(b["top"].alias("top"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["bottom"].alias("bottom")))), lambda b: F.struct(b["x0"].alias("x0"), b["top"].alias("top"), b["x1"].alias("x1"), b["bottom"].alias("bottom")))

    def step(done, b):
        cur = F.element_at(done, -1)
        joins = ~((cur["bottom"] < b["top"]) | (b["bottom"] < cur["top"])) & (F.least(F.abs(b["x0"] - cur["x1"]), F.abs(b["x1"] - cur["x0"])) <= threshold)
        grown = F.struct(cur["x0"].alias("x0"), F.least(cur["top"], b["top"]).alias("top"), F.greatest(cur["x1"], b["x1"]).alias("x1"), F.greatest(cur["bottom"], b["bottom"]).alias("bottom"))
        return F.when(F.size(done) == 0, F.array(b)).when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(ordered, F.array().cast(kind), step)


def anchored_groups(values: Column, gap: Column) -> Column:
    """First values of groups: a sorted value opens a group if it's more than ``gap`` above the group's first."""
    def step(done, v):
        return F.when((F.size(done) == 0) | (v - F.element_at(done, -1) > gap), F.concat(done, F.array(v))).otherwise(done)

    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), step)


def orientation(rotation: Column, confidence: Column, top_rotation: Column, top_confidence: Column) -> Column:
    """Quarter turn to apply: sure enough, and for a quarter turn not vetoed by the page's top strip."""
    sure = rotation.isin(90, 180, 270) & (confidence >= 0.80)
    veto = rotation.isin(90, 270) & (top_confidence >= 0.80) & (top_rotation != rotation)
    return F.when(sure & ~F.coalesce(veto, F.lit(False)), rotation).otherwise(F.lit(0))
