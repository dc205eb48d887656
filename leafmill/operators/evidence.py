"""Page evidence: typed JSON in and out, the faults of a record, TeX pages held against their fields."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import latex, text
from .pages import lenient_json

# The version of the format, the shape of a field's id, and the types of its records.
VERSION = "recognition/v1"
FIELD_ID = r"^LEX-P\d{4}-[VC]\d{4}$"
_BOX = "array<bigint>"
_CELL = f"struct<row:bigint,column:bigint,rowspan:bigint,colspan:bigint,text:string,bbox:{_BOX},score:double>"
_TABLE = f"page:bigint,bbox:{_BOX},rows:bigint,columns:bigint,cells:array<{_CELL}>,source:string,fallback_reason:string"
RENDER = f"struct<dpi:bigint,width:bigint,height:bigint,rotation:bigint,deskew:double,source_size:{_BOX}>"
BLOCKS = f"array<struct<text:string,bbox:{_BOX},score:double>>"
TABLES = f"array<struct<{_TABLE},original_table:struct<{_TABLE}>>>"
FIELDS = f"array<struct<field_id:string,label:string,bbox:{_BOX},value:string,paddle_text:string,model_guess:string,confidence:double,needs_review:boolean,history:array<struct<stage:string,`from`:string,`to`:string,reason:string>>>>"
EVIDENCE = f"schema string, page bigint, render {RENDER}, ocr_blocks {BLOCKS}, tables {TABLES}, fields {FIELDS}, degraded_adapters array<string>"


def read(json: Column) -> Column:
    """Evidence from JSON text. What doesn't fit its type is null and so a fault; null if the text is no object."""
    return F.when(F.get_json_object(json, "$").startswith("{"), F.from_json(json, EVIDENCE))


def write(evidence: Column) -> Column:
    """JSON of evidence: a null reason is written; rotation, deskew, source size and original table only if they say something."""
    out = F.to_json(evidence, {"ignoreNullFields": "false"})
    for name, nothing in (("rotation", "0|null"), ("deskew", r"-?0\.0|null"), ("source_size", "null"), ("original_table", "null")):
        out = F.regexp_replace(out, rf',"{name}":(?:{nothing})(?=[,}}])', "")
    return out


def _bad(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _box(b: Column) -> Column:
    four = (F.size(b) == 4) & F.forall(b, lambda v: F.coalesce(v >= 0, F.lit(False)))
    return four & (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3))


def _score(s: Column) -> Column:
    return s.between(0.0, 1.0) & ~F.isnan(s)


def _inside(b: Column, render: Column) -> Column:
    return (F.get(b, 2) <= render["width"]) & (F.get(b, 3) <= render["height"])


def _table_faults(t: Column, render: Column) -> list[tuple[Column, str]]:
    cell = lambda ok: F.exists(t["cells"], lambda c: _bad(ok(c)))
    return [
        (_bad(_box(t["bbox"])), "table_box"),
        (_bad((t["rows"] > 0) & (t["columns"] > 0)), "table_size"),
        (_bad(F.trim(t["source"]) != ""), "table_source"),
        (F.coalesce(t["cells"].isNull(), F.lit(True)), "cells_missing"),
        (cell(lambda c: (c["row"] >= 0) & (c["column"] >= 0) & (c["rowspan"] > 0) & (c["colspan"] > 0) & c["text"].isNotNull()), "cell_place"),
        (cell(lambda c: _box(c["bbox"])), "cell_box"),
        (cell(lambda c: _score(c["score"])), "cell_score"),
        (cell(lambda c: (c["row"] + c["rowspan"] <= t["rows"]) & (c["column"] + c["colspan"] <= t["columns"])), "cell_span"),
        (_bad(_inside(t["bbox"], render)) | cell(lambda c: _inside(c["bbox"], render)), "table_outside"),
    ]


def _table_fault(t: Column, page: Column, render: Column) -> Column:
    """The first fault of a table; null for none."""
    faults = _table_faults(t, render)
    o = t["original_table"]
    nested = o.isNotNull() & _bad((o["page"] == t["page"]) & (o["bbox"] == t["bbox"]))
    out = F.when(_bad(t["page"] == page), "table_page")
    for wrong, name in [*faults, (nested, "original_table")]:
        out = out.when(wrong, name)
    return out


def violations(e: Column) -> Column:
    """Names of all the rules that a page's evidence breaks, in the order in which they are checked; empty if it keeps all."""
    r, one_of = e["render"], lambda rows, ok: F.exists(rows, lambda x: _bad(ok(x)))
    ids = F.transform(e["fields"], lambda f: f["field_id"])
    checks = [
        (_bad(e["schema"] == VERSION), "schema"),
        (_bad(e["page"] > 0), "page"),
        (_bad(r["dpi"].between(72, 600) & (r["width"] > 0) & (r["height"] > 0)), "render"),
        (_bad(F.coalesce(r["rotation"], F.lit(0)).isin(0, 90, 180, 270)), "rotation"),
        (_bad(F.coalesce(r["deskew"], F.lit(0.0)).between(-20.0, 20.0) & ~F.isnan(F.coalesce(r["deskew"], F.lit(0.0)))), "deskew"),
        (r["source_size"].isNotNull() & _bad((F.size(r["source_size"]) == 2) & F.forall(r["source_size"], lambda v: F.coalesce(v > 0, F.lit(False)))), "source_size"),
        (e["ocr_blocks"].isNull() | e["tables"].isNull() | e["fields"].isNull() | e["degraded_adapters"].isNull(), "missing_list"),
        (one_of(e["ocr_blocks"], lambda b: b["text"].isNotNull() & _box(b["bbox"]) & _score(b["score"])), "block"),
        (one_of(e["ocr_blocks"], lambda b: _inside(b["bbox"], r)), "block_outside"),
    ]
    named = [F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for wrong, name in checks]
    named.append(F.get(F.filter(F.transform(e["tables"], lambda t: _table_fault(t, e["page"], r)), lambda x: x.isNotNull()), 0))
    checks = [
        (one_of(e["fields"], lambda f: f["field_id"].rlike(FIELD_ID)), "field_id"),
        (one_of(e["fields"], lambda f: f["label"].isNotNull() & f["value"].isNotNull() & f["paddle_text"].isNotNull() & f["model_guess"].isNotNull() & f["needs_review"].isNotNull() & f["history"].isNotNull()), "field_text"),
        (one_of(e["fields"], lambda f: _box(f["bbox"])), "field_box"),
        (one_of(e["fields"], lambda f: _score(f["confidence"])), "field_score"),
        (F.exists(e["fields"], lambda f: F.exists(f["history"], lambda h: _bad(h["stage"].isNotNull() & h["from"].isNotNull() & h["to"].isNotNull() & h["reason"].isNotNull()))), "history"),
        (one_of(e["fields"], lambda f: _inside(f["bbox"], r)), "field_outside"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "duplicate_field"),
        (one_of(e["degraded_adapters"], lambda a: F.trim(a) != ""), "adapter"),
    ]
    named += [F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for wrong, name in checks]
    return F.when(e.isNull(), F.array(F.lit("no_object"))).otherwise(F.filter(F.array(*named), lambda x: x.isNotNull()))


def layout_regions(raw: Column) -> Column:
    """Regions ``kind, bbox, score`` of a layout model's boxes that are well formed: integer boxes, scores from 0 to 1."""
    got = F.from_json(raw, "boxes array<struct<label:string,coordinate:array<double>,score:double>>")["boxes"]
    region = lambda b: F.struct(b["label"].alias("kind"), F.transform(b["coordinate"], lambda v, i: F.when(i < 2, F.floor(v)).otherwise(F.ceil(v)).cast("long")).alias("bbox"), b["score"].alias("score"))
    return F.filter(F.transform(got, region), lambda x: F.coalesce((F.trim(x["kind"]) != "") & _box(x["bbox"]) & _score(x["score"]), F.lit(False)))


def text_blocks(raw: Column) -> Column:
    """OCR blocks of three parallel lists (texts, scores, boxes); null if the lists differ in length: an adapter's fault."""
    got = F.from_json(raw, "rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<bigint>>")
    texts, scores, boxes = got["rec_texts"], got["rec_scores"], got["rec_boxes"]
    same = (F.size(texts) == F.size(scores)) & (F.size(texts) == F.size(boxes))
    return F.when(same, F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.get(boxes, i).alias("bbox"), F.get(scores, i).alias("score"))))


@dataclass(frozen=True)
class Config:
    """Settings of page recognition; a value out of its range is refused when the object is made."""

    ocr: str = "paddleocr"
    device: str = "cpu"
    initial_render_dpi: int = 240
    retry_crop_dpi: int = 480
    render_workers: int = 2
    paddle_batch_size: int = 4
    vision_concurrency: int = 4
    max_page_attempts: int = 2
    reasoning_effort: str | None = None
    min_output_tokens: int = 2048
    max_output_tokens: int = 8192
    paddle_low_score: float = 0.70
    enable_vl_fallback: bool = True

    def __post_init__(self):
        whole = lambda v: type(v) is int and v > 0
        counts = (self.render_workers, self.paddle_batch_size, self.vision_concurrency, self.min_output_tokens, self.max_output_tokens)
        rules = {
            "ocr": self.ocr in ("none", "paddleocr"),
            "device": re.fullmatch(r"cpu|gpu(:\d+)?", self.device),
            "initial_render_dpi": 72 <= self.initial_render_dpi <= 600,
            "retry_crop_dpi": self.initial_render_dpi <= self.retry_crop_dpi <= 600,
            "counts": all(map(whole, counts)) and self.min_output_tokens <= self.max_output_tokens,
            "paddle_low_score": type(self.paddle_low_score) in (int, float) and 0 <= self.paddle_low_score <= 1,
            "max_page_attempts": type(self.max_page_attempts) is int and self.max_page_attempts in (1, 2),
            "reasoning_effort": self.reasoning_effort in (None, "none", "minimal", "low", "medium", "high", "xhigh"),
        }
        if wrong := [name for name, ok in rules.items() if not ok]:
            raise ValueError("unsupported " + ", ".join(wrong))


def completion_options(model: str | None, default: str, effort: str | None = None) -> dict:
    """The model that is asked (a given one, else the default) and the options that go with a call; unset ones are left out."""
    chosen = (model or "").strip() or default
    return {"model": chosen} | ({"reasoning_effort": effort} if effort is not None else {})


def unwrap_reply(reply: Column) -> Column:
    """TeX of a model's reply: the ``latex`` of a JSON object, fenced or not, else the reply itself (null: it broke off)."""
    bare = F.regexp_replace(F.regexp_replace(text.strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    envelope = F.get_json_object(lenient_json(bare), "$.latex")
    return F.coalesce(envelope, bare)


def complete(reply: Column, finish_reason: Column) -> Column:
    """A reply that wasn't cut off for its length; null else."""
    return F.when(~finish_reason.eqNullSafe("length"), reply)


def fields_from_tex(pages: DataFrame, width: int, height: int) -> DataFrame:
    """Fields of pages without metadata: a row for each declared id, with the label and value of its place.

    ``pages(conv_id, page, tex)``; the box is the whole page, the confidence 0.5, and all need review. Labels are paired
    by position; a page whose fields can't be read has empty values.
    """

    @F.pandas_udf("map<string,string>")
    def values(tex: pd.Series) -> pd.Series:
        def one(t):
            try:
                return {r["id"]: latex.plain(r["value"]) for r in latex.extract(t or "")[1]}
            except latex.TemplateError:
                return {}

        return tex.map(one)

    labels = F.regexp_extract_all("tex", F.lit(r"(?m)^\s*% #FIELD_VALUE:\s*(.*)$"), F.lit(1))
    rows = pages.select("conv_id", "page", labels.alias("labels"), values("tex").alias("found"), F.posexplode(latex.value_ids(F.col("tex"))).alias("i", "field_id"))
    box = F.array(F.lit(0), F.lit(0), F.lit(width), F.lit(height)).cast(_BOX)
    return rows.select("conv_id", "page", "field_id", F.coalesce(F.get("labels", "i"), F.lit("")).alias("label"), F.coalesce(F.col("found")[F.col("field_id")], F.lit("")).alias("value"), box.alias("bbox"), F.lit(0.5).alias("confidence"), F.lit(True).alias("needs_review"))


def expand_metadata(pages: DataFrame, meta: DataFrame) -> DataFrame:
    """Field metadata by the last part of an id, for pages whose id set agrees with it: ``conv_id, page, field_id, bbox, confidence, needs_review, error``.

    ``pages(conv_id, page, tex)``, ``meta(conv_id, page, suffix, bbox, confidence, needs_review)``. A page whose sets differ,
    or with an id of another page, has one row that says so.
    """
    ids = pages.select("conv_id", "page", latex.value_ids(F.col("tex")).alias("ids"))
    known = meta.groupBy("conv_id", "page").agg(F.collect_list(F.struct("suffix", "bbox", "confidence", "needs_review")).alias("m"))
    j = ids.join(known, ["conv_id", "page"], "left").withColumn("m", F.coalesce("m", F.array().cast(known.schema["m"].dataType)))
    last = F.transform("ids", lambda i: F.substring_index(i, "-", -1))
    names = F.transform("m", lambda x: x["suffix"])
    differ = (F.size(F.array_except(last, names)) > 0) | (F.size(F.array_except(names, last)) > 0)
    foreign = F.exists("ids", lambda i: ~i.startswith(F.format_string("LEX-P%04d-", F.col("page"))))
    j = j.withColumn("error", F.when(differ, "id_sets_differ").when(foreign, "foreign_page"))
    told = j.select("conv_id", "page", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("ids"))).alias("field_id"), "m")
    own = F.get(F.filter("m", lambda x: x["suffix"] == F.substring_index(F.col("field_id"), "-", -1)), 0)
    told = told.where("error is not null or field_id is not null")
    return told.select("conv_id", "page", "field_id", own["bbox"].alias("bbox"), own["confidence"].alias("confidence"), own["needs_review"].alias("needs_review"), "error")


def validate_pages(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """Pages held against their fields: ``conv_id, page, violation, mismatches, outcome``.

    ``pages(conv_id, page, total, tex)``, ``fields(conv_id, page, field_id, value)``. Rules in order, the first that is
    broken is the violation: empty, a repeated id, an id of another page, id sets that differ, the marker, checkbox
    glyphs, a numbered section, adjacent tables, the number of fields, then values that differ as read. ``outcome`` is
    ``ok``; ``accept_tex`` if all that differ are handwritten; ``recoverable`` if others differ; ``rejected`` else.
    """
    own = fields.groupBy("conv_id", "page").agg(F.collect_list(F.struct("field_id", "value")).alias("f"))
    j = pages.select("conv_id", "page", "total", "tex").join(own, ["conv_id", "page"], "left")
    j = j.withColumn("f", F.coalesce("f", F.array().cast("array<struct<field_id:string,value:string>>")))
    names = F.transform("f", lambda x: x["field_id"])
    rule = latex.first_violation(F.col("tex"), F.col("page"), F.col("total"), names)
    repeated = F.size(F.array_distinct(names)) != F.size(names)
    empty = F.trim(F.coalesce("tex", F.lit(""))) == ""
    j = j.select("conv_id", "page", "tex", "f", F.when(empty, "empty").when(repeated, "duplicate_id").otherwise(rule).alias("rule"))
    mismatch = "array<struct<field_id:string,value:string,is_handwritten:boolean>>"

    def run(frames):
        for g in frames:
            rows = []
            for conv, page, tex, held, broken in zip(g["conv_id"], g["page"], g["tex"], g["f"], g["rule"], strict=True):
                differ = []
                if broken is None:
                    try:
                        seen = {r["id"]: (latex.plain(r["value"]), r["is_handwritten"]) for r in latex.extract(tex)[1]} if len(held) else {}
                    except latex.TemplateError:
                        broken, seen = "template", {}
                    key = lambda v: text.visible_key(pd.Series([v or ""]))[0]
                    differ = [(x["field_id"], *seen[x["field_id"]]) for x in held if x["field_id"] in seen and key(seen[x["field_id"]][0]) != key(x["value"])]
                outcome = "rejected" if broken else "ok" if not differ else "accept_tex" if all(h for _, _, h in differ) else "recoverable"
                rows.append((conv, page, "value_mismatch" if differ else broken, [dict(zip(("field_id", "value", "is_handwritten"), d, strict=True)) for d in differ], outcome))
            yield pd.DataFrame(rows, columns=["conv_id", "page", "violation", "mismatches", "outcome"])

    return j.mapInPandas(run, f"conv_id long, page int, violation string, mismatches {mismatch}, outcome string")


# What stands before the first page of a document that OCR text has to fill, and before later ones.
FALLBACK_MARK = "% RECOGNITION_FALLBACK"
PREAMBLE = "\n".join((
    "% !TeX program = xelatex", "% !TeX encoding = UTF-8", r"\documentclass[UTF8,10pt,a4paper,fontset=fandol]{ctexart}",
    r"\usepackage{amsmath,amssymb,graphicx,tabularx,array,multirow,enumitem,titlesec,xcolor,ragged2e,etoolbox}",
    r"\usepackage[a4paper,top=1.6cm,bottom=1.6cm,left=1.6cm,right=1.6cm]{geometry}",
    r"\newcommand{\fieldvalue}[1]{#1}", r"\newcommand{\handwritten}[1]{#1}", r"\newcommand{\checkboxfield}[1]{#1}", r"\begin{document}", "",
))


def fallback_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages made of OCR text alone: ``conv_id, page, tex``; a page without text is left blank.

    ``pages(conv_id, page, total)``, ``blocks(conv_id, page, top, x0, text)``. Blocks stand in reading order, escaped, in a
    box that is scaled to the page; the first page has the preamble, the last the document's end, each its marker.
    """
    line = F.concat(F.lit(r"\noindent "), text.escape_tex(F.col("text")), F.lit(r"\par"))
    rows = blocks.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list(F.struct("top", "x0", line.alias("line")))).alias("r"))
    j = pages.join(rows, ["conv_id", "page"], "left")
    body = F.concat(F.lit("\\noindent\\resizebox{\\textwidth}{0.9\\textheight}{%\n\\begin{minipage}{\\textwidth}\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n\\end{minipage}}\n"))
    tex = F.concat(F.when(F.col("page") == 1, PREAMBLE).otherwise("\\newpage\n"), F.lit(FALLBACK_MARK + "\n"), F.when(F.col("r").isNull(), "\\null\n").otherwise(body), F.when(F.col("page") == F.col("total"), "\\end{document}\n").otherwise(""))
    return j.select("conv_id", "page", latex.with_marker(tex, F.col("page"), F.col("total")).alias("tex"))
