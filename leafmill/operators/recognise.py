"""Recognition of documents page by page: cached stages and drafts, bounded attempts, delivery in order.

Models, renderers and OCR engines are given as functions (adapters), made once a worker by ``factory()``; nothing here
knows a provider. What a call raised is told as names and numbers, never as a provider's text.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import latex
from .evidence import FALLBACK_MARK
from .pages import deliverable

RESULT = "doc_id long, page int, total int, tex string, attempts int, action string, degraded boolean, error_name string, status int"


class CallFailed(Exception):
    """What an adapter raises: the error's name, an HTTP status if any, TeX that could be used all the same, the stage."""

    def __init__(self, name: str, status: int | None = None, fallback: str | None = None, stage: str = "request"):
        super().__init__(name)
        self.name, self.status, self.fallback, self.stage = name, status, fallback, stage


def decide(name: str, status: int | None, attempt: int, attempts: int, has_fallback: bool, metadata_only: bool, invalid: bool) -> str:
    """``next_step`` of the routing operators for one call, inside a worker."""
    n = name.lower()
    network = "connection" in n or "timeout" in n
    service = network or n in ("urlerror", "ratelimiterror", "internalservererror", "authenticationerror", "permissiondeniederror", "modelunavailableerror") or (status is not None and (status in (401, 403, 408, 429) or status >= 500))
    retry = (invalid or network or service or status in (408, 429, 500, 502, 503, 504)) and attempt + 1 < (2 if service else attempts)
    if retry and status not in (401, 403) and not (metadata_only and has_fallback):
        return "retry"
    return "pause_document" if service else "use_tex" if has_fallback else "fallback_page"


def recognise_pages(pages: DataFrame, factory: Callable[[], Callable[[dict, int], str]], attempts: int = 2, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Asks the adapter for the TeX of each page: a row a page with the attempts it took and the action that ended it.

    ``pages(doc_id, page, total, fallback, ...)``; the adapter gets the row and the attempt's number and returns TeX.
    Documents are dealt out whole and pages come in order, so that an outage (``pause_document``) leaves the document's
    later pages alone: they are ``paused``. Waits double up to 30 s, with a random part.
    """

    def run(frames):
        call, stopped = factory(), {}
        for f in frames:
            rows = []
            for row in f.to_dict("records"):
                head = (row["doc_id"], row["page"], row["total"])
                if row["doc_id"] in stopped:
                    rows.append((*head, None, 0, "paused", False, *stopped[row["doc_id"]]))
                    continue
                kept, attempt = None, 0
                while True:
                    try:
                        tex = call(row, attempt)
                        if latex_marker(tex) != (row["page"], row["total"]):
                            raise CallFailed("ValueError", stage="latex_validation")
                        rows.append((*head, tex, attempt + 1, "done", False, None, None))
                        break
                    except Exception as e:
                        wrong = e if isinstance(e, CallFailed) else CallFailed(type(e).__name__)
                        kept = wrong.fallback or kept
                        step = decide(wrong.name, wrong.status, attempt, attempts, kept is not None, wrong.stage == "field_metadata", wrong.name in ("ValueError", "JSONDecodeError"))
                        if step == "retry":
                            if wrong.name != "ValueError":
                                pause(min(30, 2**attempt) + random.random())
                            attempt += 1
                            continue
                        if step == "pause_document":
                            stopped[row["doc_id"]] = (wrong.name, wrong.status)
                        tex = {"use_tex": kept, "fallback_page": row.get("fallback")}.get(step)
                        rows.append((*head, tex, attempt + 1, step, step != "pause_document", wrong.name, wrong.status))
                        break
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            yield out.astype({"status": "Int32"})

    return pages.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInPandas(run, RESULT)


def latex_marker(tex: str | None) -> tuple[int, int] | None:
    """Page and total of a text's only marker; None without one or with several."""
    import re

    found = re.findall(latex.MARKER_RX, tex or "")
    return tuple(map(int, found[0])) if len(found) == 1 else None


def usable_drafts(cache: DataFrame) -> DataFrame:
    """Drafts that can be delivered again: of the right page, no placeholder, and without a broken page rule.

    ``cache(cache_key, page, total, tex)``; a null text is a file that couldn't be read.
    """
    good = F.col("tex").isNotNull() & ~F.contains("tex", F.lit(FALLBACK_MARK))
    kept = cache.where(good)
    return kept.where(latex.first_violation(F.col("tex"), F.col("page"), F.col("total")).isNull())


def read_through(pages: DataFrame, stored: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's results: stored ones whose page and render settings are the same, the rest computed; ``cached`` tells.

    ``pages(cache_key, page, render, ...)``, ``stored(cache_key, page, render, payload)``; ``compute`` gets the pages that
    lack a result and returns ``cache_key, page, render, payload``.
    """
    have = stored.where("payload is not null").select("cache_key", "page", F.col("render").alias("as_rendered"), "payload")
    j = pages.join(have, ["cache_key", "page"], "left").withColumn("hit", F.col("payload").isNotNull() & F.col("render").eqNullSafe(F.col("as_rendered")))
    hits = j.where("hit").select("cache_key", "page", "render", "payload", F.lit(True).alias("cached"))
    return hits.unionByName(compute(j.where("not hit").select(pages.columns)).select("cache_key", "page", "render", "payload", F.lit(False).alias("cached")))


def prepare(pages: DataFrame, factory: Callable[[], dict[str, Callable[[dict], str]]], ocr: str = "paddleocr") -> DataFrame:
    """OCR, then layout and tables of each page by adapters; what fails is left out and named in ``degraded``.

    ``pages(cache_key, page, render, ...)`` -> ``cache_key, page, ocr, tables, degraded``. OCR is tried twice, the others once;
    with ``ocr='none'`` nothing is asked. Names of failed adapters stand once, in order.
    """

    def run(frames):
        adapters = factory() if ocr != "none" else {}
        for f in frames:
            rows = []
            for row in f.to_dict("records"):
                got, failed = {}, []
                for name, tries in (("ocr", 2), ("layout", 1), ("tables", 1)):
                    for last in [False] * (tries - 1) + [True]:
                        if name not in adapters:
                            break
                        try:
                            got[name] = adapters[name](row | got)
                            break
                        except Exception:
                            if last:
                                failed.append(name)
                rows.append((row["cache_key"], row["page"], got.get("ocr"), got.get("tables"), list(dict.fromkeys(failed))))
            yield pd.DataFrame(rows, columns=["cache_key", "page", "ocr", "tables", "degraded"])

    return pages.mapInPandas(run, "cache_key string, page int, ocr string, tables string, degraded array<string>")


def recognise(pages: DataFrame, drafts: DataFrame, factory, attempts: int = 2, start_page: int = 1, process: Callable[[DataFrame], DataFrame] | None = None, pause=time.sleep) -> DataFrame:
    """A document's pages: drafts that can be used, the others recognised, as ``RESULT`` and ``from_cache``.

    ``pages(doc_id, cache_key, page, total, fallback, ...)``, ``drafts(cache_key, page, total, tex)``. ``process`` is a user's
    step over the results; pages it changes must keep their number and marker, or they are dropped as ``rejected``.
    Earlier pages than ``start_page`` must have drafts: those that lack one come as ``missing_draft``.
    """
    good = usable_drafts(drafts).select("cache_key", "page", F.col("tex").alias("draft")).dropDuplicates(["cache_key", "page"])
    j = pages.join(good, ["cache_key", "page"], "left")
    shape = lambda df, tex, n, action, degraded: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("total").cast("int").alias("total"), tex.alias("tex"), F.lit(n).alias("attempts"), F.lit(action).alias("action"), F.lit(degraded).alias("degraded"), F.lit(None).cast("string").alias("error_name"), F.lit(None).cast("int").alias("status"))
    cached = shape(j.where("draft is not null"), F.col("draft"), 0, "cached", False)
    lost = shape(j.where(F.col("draft").isNull() & (F.col("page") < start_page)), F.lit(None).cast("string"), 0, "missing_draft", False)
    fresh = recognise_pages(j.where(F.col("draft").isNull() & (F.col("page") >= start_page)).drop("draft"), factory, attempts, pause)
    out = cached.unionByName(lost).unionByName(fresh)
    if process is not None:
        out = process(out)
        kept = F.col("tex").isNull() | latex.first_violation(F.col("tex"), F.col("page"), F.col("total")).isNull() | (F.col("action") != "done")
        out = out.withColumn("action", F.when(kept, F.col("action")).otherwise("rejected"))
    return out.withColumn("from_cache", F.col("action") == "cached")


def delivered(results: DataFrame) -> DataFrame:
    """What can be delivered: pages 1..n of each document without a gap, in order."""
    return deliverable(results.where(F.col("tex").isNotNull() & ~F.col("action").isin("rejected", "paused")), "doc_id")


def incomplete(results: DataFrame) -> DataFrame:
    """Documents that lack pages: ``doc_id, total, n_pages, first_missing``."""
    done = results.where(F.col("tex").isNotNull() & ~F.col("action").isin("rejected", "paused"))
    n = results.groupBy("doc_id").agg(F.max("total").alias("total"))
    have = done.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"), F.collect_set("page").alias("have"))
    j = n.join(have, "doc_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
    first = F.array_min(F.array_except(F.sequence(F.lit(1), F.col("total")), F.coalesce("have", F.array().cast("array<int>"))))
    return j.where("n_pages < total").select("doc_id", "total", "n_pages", first.alias("first_missing"))


def resume_faults(last_page, last_total, start_page, total):
    """Why a run can't go on at ``start_page``: its bounds, another total, a checkpoint that isn't the page before; null if it can."""
    expected = F.coalesce(last_page, F.lit(0)) + 1
    return F.when((start_page < 1) | (start_page > total), "start_page").when(last_total.isNotNull() & (last_total != total), "total_pages").when(start_page != expected, "checkpoint")


def with_retry(call: Callable, wait: float = 10.0, pause: Callable[[float], None] = time.sleep) -> Callable:
    """A call that is tried once more after a wait; then its failure is a row: ``(None, name)`` in place of ``(value, None)``."""

    def run(*args):
        for last in (False, True):
            try:
                return call(*args), None
            except Exception as e:
                if last:
                    return None, type(e).__name__
                pause(wait)
        raise AssertionError

    return run
