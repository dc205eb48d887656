"""DocTags to Markdown: headings, texts and tables out of tagged lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"<section_header_level_(\d+)>(.*?)</section_header_level_\1>|<text>(.*?)</text>|<otsl>(.*?)</otsl>", re.S)
_LOC = re.compile(r"<loc_(\d+)>")


def parse(tags: str) -> list[tuple[str, list[float] | None]]:
    """Markdown blocks with their boxes (the last four locations over 500, or none)."""
    out = []
    for level, title, plain, table in _PART.findall(tags or ""):
        body = title or plain or table
        loc = [int(x) / 500 for x in _LOC.findall(body)][-4:]
        body = _LOC.sub("", body)
        if level:
            md = "#" * min(6, max(1, int(level))) + " " + body.strip()
        elif table:
            rows, headed = [], "<ched>" in body
            for i, row in enumerate(r for r in body.split("<nl>") if r.strip()):
                cells = [c.strip() for c in re.split(r"<(?:ched|fcel|ecel)>", row)[1:]]
                rows.append("| " + " | ".join(cells) + " |")
                if i == 0:
                    rows.append("|" + "---|" * len(cells))
            md = "\n".join(rows) if rows or headed else ""
        else:
            md = body.strip()
        out.append((md, loc if len(loc) == 4 else None))
    return out


def to_markdown(docs: DataFrame) -> DataFrame:
    """``doc_id, block_no, markdown, box`` of ``docs(doc_id, tags)``."""
    def run(frames):
        for f in frames:
            rows = [(d, i, md, box) for d, t in zip(f["doc_id"], f["tags"], strict=True) for i, (md, box) in enumerate(parse(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_no", "markdown", "box"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "tags").mapInPandas(run, "doc_id long, block_no int, markdown string, box array<double>")


def scaled_locations(values):
    """``<loc_n>`` numbers of box values: shares of the greatest, times 500, rounded half to even."""
    return F.transform(values, lambda v: F.bround(v / F.array_max(values) * 500).cast("int"))
