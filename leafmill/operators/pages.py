"""Pages of a document over time: cache, resume, delivery, templates, model replies, budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import latex, text


def canonical_json(entries: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and no blanks; the values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), entries[k]) for k in sorted(entries)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cache_key(sha: Column, config: dict[str, object], versions: dict[str, str], prompt: str, model: Column) -> Column:
    """SHA-256 over what can change a page's result: not the number of attempts, nor an effort that isn't set."""
    kept = {k: v for k, v in config.items() if k != "max_page_attempts" and not (k == "reasoning_effort" and v is None)}
    import json

    obj = lambda d: F.lit(json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    body = canonical_json({"config": obj(kept), "versions": obj(versions), "prompt": obj(prompt), "pdf_sha256": quoted(F.lower(sha)), "model": quoted(model)})
    return F.when(sha.rlike("^[0-9a-fA-F]{64}$"), F.sha2(body, 256))


def page_status(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """``cached`` or ``todo`` for each page: only a usable draft of the same key counts.

    Unusable drafts are filtered before the join, so the join sees one row a page.
    """
    good = cache.where(F.col("draft").isNotNull() & (F.trim("draft") != "") & ~F.col("fallback")).select("cache_key", "page", F.lit(True).alias("hit"))
    out = pages.join(good, ["cache_key", "page"], "left")
    return out.select("doc_id", "page", F.when(F.col("hit"), "cached").otherwise("todo").alias("status"))


def deliverable(done: DataFrame, key: str) -> DataFrame:
    """Pages 1..n of each document without a gap."""
    return done.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("page"))).where("page = rn").drop("rn")


def first_missing(done: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """The least page of 1..total that isn't done; null if all are. An anti-join of the expected pages."""
    expected = totals.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("total"))))
    gaps = expected.join(done.select(key, "page"), [key, "page"], "left_anti").groupBy(key).agg(F.min("page").alias("first_missing"))
    return totals.select(key).join(gaps, key, "left")


def assemble(pages: DataFrame, key: str) -> DataFrame:
    """The pages of each document joined in order, with one end of document: ``key, tex``."""
    body = F.regexp_replace("tex", r"\s*\\end\{document\}\s*", "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("b")))), lambda x: x["b"])
    return pages.groupBy(key).agg(F.concat(F.array_join(parts, "\n"), F.lit("\n\\end{document}")).alias("tex"))


def extract_fields(pages: DataFrame) -> DataFrame:
    """Fields of annotated pages: ``conv_id, page, id, label, value, is_handwritten, field_type, needs_review, error``.

    ``pages(conv_id, page, tex)``. Braces nest, so the scan is Python, in Arrow batches; an error is a row.
    """
    schema = "conv_id long, page int, id string, label string, value string, is_handwritten boolean, field_type string, needs_review boolean, error string"

    def run(frames):
        for f in frames:
            out = []
            for c, p, t in zip(f["conv_id"], f["page"], f["tex"], strict=True):
                try:
                    out += [(c, p, *(r[k] for k in ("id", "label", "value", "is_handwritten", "field_type", "needs_review")), None) for r in latex.extract(t or "")[1]]
                except latex.TemplateError as e:
                    out.append((c, p, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[s.split()[0] for s in schema.split(", ")])

    return pages.select("conv_id", "page", "tex").mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Each page taken apart and filled again: ``conv_id, page, filled`` (null where extraction fails)."""
    @F.pandas_udf("string")
    def again(tex: pd.Series) -> pd.Series:
        def one(t):
            try:
                template, records = latex.extract(t or "")
            except latex.TemplateError:
                return None
            return latex.fill(template, records)

        return tex.map(one)

    return pages.select("conv_id", "page", again("tex").alias("filled"))


def reply_pages(replies: DataFrame) -> DataFrame:
    """Pages of model replies: the part in ``<output>``, split at ``<page-break>``, numbered from 1."""
    body = text.between_output_tags(F.col("text"))
    return replies.select("conv_id", "turn", F.posexplode(F.split(body, "<page-break>", -1)).alias("n", "content")).select("conv_id", "turn", (F.col("n") + 1).alias("page"), text.strip(F.col("content")).alias("content"))


def token_budget(text_length: Column, cells: Column, spans: Column, tables: Column, least: int = 2048, most: int = 8192) -> Column:
    """Output tokens for a page: twice its characters, and shares for tables, their cells and spans."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(least) + 2 * text_length + 500 * tables + 100 * cells + 50 * spans))


def within_budget(blocks: DataFrame, keys: list[str], budget: int, overhead: int) -> DataFrame:
    """The first blocks in reading order whose encoded lengths fit a budget, and whether any were left out.

    ``blocks(keys, top, x0, pos, encoded)``: ``keys, kept, truncated``. A running sum takes the place of dropping
    the last block again and again; a cut costs the flag's own characters too.
    """
    order = Window.partitionBy(*keys).orderBy("top", "x0", "pos")
    n = F.length("encoded") + F.when(F.row_number().over(order) > 1, 1).otherwise(0)
    run = blocks.withColumn("n", n).withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.max("sum").over(Window.partitionBy(*keys)) + overhead <= budget
    run = run.withColumn("whole", whole).withColumn("fits", F.col("whole") | (F.col("sum") + overhead + len(',"truncated":true') <= budget))
    return run.groupBy(*keys).agg(F.sum(F.col("fits").cast("int")).cast("int").alias("kept"), (~F.first("whole")).alias("truncated"))


def lenient_json(raw: Column) -> Column:
    """JSON text that parses, with the back-slashes of TeX commands kept as characters; null if nothing helps.

    A lone back-slash before two or more letters is a command's, not an escape. If that doesn't parse, such back-slashes
    are doubled once more, and those that start no JSON escape too.
    """
    twice = r"\\\\"
    kept = F.regexp_replace(raw, r"(?<!\\)\\(?=[A-Za-z]{2,})", twice)
    mended = F.regexp_replace(F.regexp_replace(kept, r"\\(?=[A-Za-z]{2,})", twice), r'\\(?!["\\/bfnrt]|u[0-9a-fA-F]{4})', twice)
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(kept), kept).when(ok(mended), mended)
