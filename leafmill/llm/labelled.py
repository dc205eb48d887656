"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col, folds: int, fold: int) -> F.Column:
    """True where crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, longest: int) -> list[tuple[str, int]]:
    """At most ``rows`` pairs (text, label) of rows outside the held-out fold, the least by a checksum of the id.

    Only texts of at most ``longest`` characters are taken, so the driver holds at most ``rows * longest`` of them.
    Copies and near copies would count a text's words many times: of rows whose two least word hashes agree, the
    first is kept. The same tables give the same sample. Rows without a label, an id or a text are not taken.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    rows_ = docs.select("doc_id", "text").where(F.length("text") <= longest).where(~held_out(F.col("doc_id"), folds, fold))
    # The ids are chosen first: texts of the chosen rows alone are joined and sorted.
    chosen = rows_.select("doc_id").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = rows_.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows).select("text", "y").collect()
    out, seen = [], set()
    for text, y in got:
        least = tuple(sorted({zlib.crc32(w.encode()) for w in set(text.split())})[:2])
        if least not in seen:
            seen.add(least)
            out.append((text, int(y)))
    return out
