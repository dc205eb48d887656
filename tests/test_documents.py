"""Readers, recognition, evidence, stages and layout streams on small cases worked out by hand; adapters are fakes."""

import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import html, latex, schema
from leafmill.operators import evidence, flow, layout, match, recognise
from leafmill.plans import inputs
from leafmill.sources import dispatch, stages


def test_fields_are_taken_apart_and_put_together():
    tex = "% #VALUE_ID: A1\n% #FIELD_VALUE: Name {x}\n% #TODO #HANDWRITTEN: look\n\\fieldvalue{\\handwritten{a {b} \\} c}} and \\fieldvalue{\\checkboxfield{x} y}"
    template, records = latex.extract(tex)
    assert [(r["id"], r["value"], r["is_handwritten"], r["field_type"], r["needs_review"]) for r in records] == [("A1", "a {b} \\} c", True, "text", True), ("VALUE_002", "\\checkboxfield{x} y", False, "text", False)]
    assert records[0]["label"] == "Name {x}" and template.endswith("@@FIELD_A1@@ and @@FIELD_VALUE_002@@") and latex.fill(template, records) == tex
    ticked = "\\fieldvalue{\\handwritten{\\checkboxfield{yes}}}"
    assert latex.extract(ticked)[1][0]["field_type"] == "checkbox" and latex.fill(*latex.extract(ticked)) == ticked
    for wrong in ("no field", "\\fieldvalue{open", "% #VALUE_ID: A\n\\fieldvalue{a}% #VALUE_ID: A\n\\fieldvalue{b}"):
        with pytest.raises(latex.TemplateError):
            latex.extract(wrong)
    with pytest.raises(latex.TemplateError):
        latex.fill("@@FIELD_Z@@", records)
    assert [latex.plain(x) for x in (r"\textbf{A\&B}", r"$10^{2}$", r"$\checkmark$", "")] == ["A&B", "10^2", "\u2713", ""]


def test_html_pages():
    got = html.to_markdown("<title>T</title><h1>A <b>b</b></h1><p>one<p>two <a href='/x'>l</a><ol start=3><li>a<li>b<ul><li>c</ul></ol><table><tr><th>h<th>k<tr><td>1<td>2|3</table><h5>f</h5><pre>x  y</pre><script>no</script>e &amp; f")
    assert got.split("\n\n") == ["# A **b**", "one", "two [l](/x)", "3. a\n4. b\n  * c", "| h | k |\n| --- | --- |\n| 1 | 2\\|3 |", "##### f", "```\nx  y\n```", "e & f"]
    assert html.to_markdown(None) == html.to_markdown("") == "" and html.title("<p>") == "No title"


def test_schemas_of_types(spark):
    @dataclasses.dataclass
    class Item:
        name: str
        price: float = 0.0

    @dataclasses.dataclass
    class Order:
        id: int = dataclasses.field(metadata={"description": "its number"})
        items: list[Item]
        note: str | None = None
        either: int | str = 0
        more: dict[str, int] = dataclasses.field(default_factory=dict)

    Order.__annotations__ = {"id": int, "items": list[Item], "note": str | None, "either": int | str, "more": dict[str, int]}
    Item.__annotations__ = {"name": str, "price": float}
    for cls in (Order, Item):
        for f in dataclasses.fields(cls):
            f.type = cls.__annotations__[f.name]
    s = schema.json_schema(Order)
    assert s["required"] == ["id", "items"] and s["properties"]["id"] == {"type": "integer", "description": "its number"}
    assert s["properties"]["items"]["items"] == {"type": "object", "properties": {"name": {"type": "string"}, "price": {"type": "number"}}, "required": ["name"]}
    assert s["properties"]["either"] == {"anyOf": [{"type": "integer"}, {"type": "string"}]} and s["properties"]["note"] == {"type": "string"}
    with pytest.raises(TypeError):
        schema.json_schema(int)
    small = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}, "required": ["a"]}
    df = spark.createDataFrame([('```json\n{"a": 1, "b": ["x"]}\n```',), ('{"b": []}',), ("no",), (None,)], "r string")
    assert [r["x"] and r["x"].asDict() for r in df.select(schema.extracted(F.col("r"), small).alias("x")).collect()] == [{"a": 1, "b": ["x"]}, None, None, None]
    assert schema.load(json.dumps(small)) == small


GOOD = {
    "schema": "recognition/v1", "page": 21, "render": {"dpi": 240, "width": 1983, "height": 2804},
    "ocr_blocks": [{"text": "t", "bbox": [1, 2, 30, 40], "score": 0.9}],
    "tables": [{"page": 21, "bbox": [0, 0, 100, 100], "rows": 1, "columns": 2, "cells": [{"row": 0, "column": 0, "rowspan": 1, "colspan": 2, "text": "", "bbox": [0, 0, 9, 9], "score": 1.0}], "source": "pp", "fallback_reason": None}],
    "fields": [{"field_id": "LEX-P0021-V0001", "label": "L", "bbox": [5, 5, 50, 20], "value": "v", "paddle_text": "v", "model_guess": "v", "confidence": 0.5, "needs_review": False, "history": [{"stage": "s", "from": "a", "to": "b", "reason": "r"}]}],
    "degraded_adapters": ["vl"],
}


def changed(*path, to):
    page = json.loads(json.dumps(GOOD))
    at = page
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = to
    return page


def test_evidence_faults_and_round_trip(spark):
    twice = json.loads(json.dumps(GOOD))
    twice["fields"] *= 2
    cases = [
        (GOOD, []), (changed("schema", to="v0"), ["schema"]), (changed("page", to=0), ["page", "table_page"]), (changed("render", "dpi", to=601), ["render"]), (changed("render", "rotation", to=45), ["rotation"]),
        (changed("render", "deskew", to=21.0), ["deskew"]), (changed("render", "deskew", to=-3.2), []), (changed("render", "source_size", to=[3]), ["source_size"]), (changed("ocr_blocks", 0, "bbox", to=[1, 2, 1, 40]), ["block"]),
        (changed("ocr_blocks", 0, "bbox", to=[1, 2, 1984, 40]), ["block_outside"]), (changed("ocr_blocks", 0, "score", to=1.5), ["block"]), (changed("tables", 0, "page", to=2), ["table_page"]), (changed("tables", 0, "columns", to=1), ["cell_span"]),
        (changed("tables", 0, "source", to=" "), ["table_source"]), (changed("fields", 0, "field_id", to="X"), ["field_id"]), (changed("fields", 0, "needs_review", to=None), ["field_text"]), (changed("fields", 0, "bbox", to=[5, 5, 50, 9999]), ["field_outside"]),
        (twice, ["duplicate_field"]), (changed("degraded_adapters", to=[" "]), ["adapter"]), (changed("fields", to=None), ["missing_list"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)] + [(98, "no"), (99, None)], "i int, j string")
    got = {r["i"]: r["v"] for r in df.select("i", evidence.violations(evidence.read(F.col("j"))).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases] and got[98] == got[99] == ["no_object"]
    back = df.where("i in (0, 6)").orderBy("i").select(evidence.write(evidence.read(F.col("j"))).alias("j")).collect()
    assert json.loads(back[0]["j"]) == GOOD and json.loads(back[1]["j"]) == cases[6][0]
    raw = '{"rec_texts": ["Batch ID"], "rec_scores": [0.98], "rec_boxes": [[42, 81, 233, 126]]}'
    one = spark.createDataFrame([(raw,), (raw.replace("[0.98]", "[]"),)], "r string").select(evidence.text_blocks(F.col("r")).alias("b")).collect()
    assert one[0]["b"][0]["bbox"] == [42, 81, 233, 126] and one[1]["b"] is None


def test_config_is_checked():
    for device in ("cpu", "gpu", "gpu:0", "gpu:7"):
        assert evidence.Config(device=device).device == device
    for wrong in ({"device": "cuda"}, {"device": "gpu:"}, {"device": "gpu:-1"}, {"retry_crop_dpi": 100}, {"max_page_attempts": 3}, {"max_page_attempts": True}, {"render_workers": 0}, {"min_output_tokens": 9000}, {"reasoning_effort": "huge"}, {"ocr": "x"}, {"paddle_low_score": 2}):
        with pytest.raises(ValueError):
            evidence.Config(**wrong)
    assert evidence.completion_options(" ", "m") == {"model": "m"} and evidence.completion_options("x", "m", "low") == {"model": "x", "reasoning_effort": "low"}


def tex_page(page, total, *fields):
    body = "".join(f"% #VALUE_ID: LEX-P{page:04d}-V{i:04d}\n% #FIELD_VALUE: F{i}\n\\fieldvalue{{{v}}}\n" for i, v in enumerate(fields, 1))
    return body + f"% PAGE_COMPLETED: {page}/{total}"


def test_pages_are_held_against_fields(spark):
    name = lambda p, i: f"LEX-P{p:04d}-V{i:04d}"
    rows = [(1, 1, 3, tex_page(1, 3, "a", r"\textbf{B\&C}")), (2, 1, 1, tex_page(1, 1, "a")), (3, 1, 1, tex_page(1, 1, r"\handwritten{x}")), (4, 1, 1, tex_page(1, 1, "x")), (5, 1, 2, tex_page(1, 1, "x")), (6, 1, 1, ""), (7, 1, 1, None), (8, 2, 2, tex_page(2, 2))]
    pages = spark.createDataFrame(rows, "conv_id long, page int, total int, tex string")
    fields = spark.createDataFrame([(1, 1, name(1, 1), " A "), (1, 1, name(1, 2), "b&c"), (3, 1, name(1, 1), "y"), (4, 1, name(1, 1), "y"), (5, 1, name(1, 1), "x")], "conv_id long, page int, field_id string, value string")
    got = {r["conv_id"]: (r["violation"], r["outcome"]) for r in evidence.validate_pages(pages, fields).collect()}
    assert got == {1: (None, "ok"), 2: ("id_sets_differ", "rejected"), 3: ("value_mismatch", "accept_tex"), 4: ("value_mismatch", "recoverable"), 5: ("marker", "rejected"), 6: ("empty", "rejected"), 7: ("empty", "rejected"), 8: (None, "ok")}
    got = [(r["conv_id"], r["field_id"], r["label"], r["value"], r["bbox"]) for r in evidence.fields_from_tex(pages.where("conv_id = 1"), 10, 20).collect()]
    assert got == [(1, name(1, 1), "F1", "a", [0, 0, 10, 20]), (1, name(1, 2), "F2", "B&C", [0, 0, 10, 20])]
    meta = spark.createDataFrame([(1, 1, "V0001", [1, 2, 3, 4], 0.5, False), (1, 1, "V0002", [1, 2, 3, 5], 0.6, True), (4, 1, "V0009", [1, 2, 3, 4], 0.5, False)], "conv_id long, page int, suffix string, bbox array<long>, confidence double, needs_review boolean")
    got = sorted((r["conv_id"], r["field_id"] or "", r["error"] or "", r["confidence"]) for r in evidence.expand_metadata(pages.where("conv_id in (1, 4)"), meta).collect())
    assert got == [(1, name(1, 1), "", 0.5), (1, name(1, 2), "", 0.6), (4, "", "id_sets_differ", None)]
    blocks = spark.createDataFrame([(5, 1, 9.0, 0.0, "second_"), (5, 1, 3.0, 0.0, "first & all")], "conv_id long, page int, top double, x0 double, text string")
    made = {r["conv_id"]: r["tex"] for r in evidence.fallback_pages(pages.where("conv_id in (5, 8)"), blocks).collect()}
    assert made[5].index(r"first \& all\par") < made[5].index(r"second\_\par") and made[5].startswith("% !TeX") and made[5].endswith("% PAGE_COMPLETED: 1/2")
    assert made[8].startswith("\\newpage\n" + evidence.FALLBACK_MARK + "\n\\null\n\\end{document}")
    r = spark.createDataFrame([('```json\n{"latex": "\\\\section{a}"}\n```', "stop"), ("\\alpha", "length"), ('{"x": 1}', None)], "r string, f string")
    assert [tuple(x) for x in r.select(evidence.unwrap_reply(F.col("r")), evidence.complete(F.col("r"), F.col("f")).isNull()).collect()] == [("\\section{a}", False), ("\\alpha", True), ('{"x": 1}', False)]


def test_recognition_attempts_outages_and_drafts(spark):
    def factory():
        def call(row, attempt):
            doc, page = row["doc_id"], row["page"]
            if doc == 2 and page == 2:
                raise recognise.CallFailed("ConnectionError")
            if doc == 3 and attempt == 0:
                raise recognise.CallFailed("RateLimitError", 429)
            if doc == 4:
                raise recognise.CallFailed("ValueError", fallback="kept", stage="field_metadata")
            if doc == 5:
                return "no marker"
            return f"text\n% PAGE_COMPLETED: {page}/{row['total']}"

        return call

    rows = [(d, f"k{d}", p, 3, "blank") for d in range(1, 6) for p in (1, 2, 3)]
    pages = spark.createDataFrame(rows, "doc_id long, cache_key string, page int, total int, fallback string")
    drafts = spark.createDataFrame([("k1", 1, 3, "old\n% PAGE_COMPLETED: 1/3"), ("k1", 2, 3, evidence.FALLBACK_MARK + "\n% PAGE_COMPLETED: 2/3"), ("k1", 3, 3, "old\n% PAGE_COMPLETED: 2/3"), ("k2", 1, 3, None)], "cache_key string, page int, total int, tex string")
    got = recognise.recognise(pages, drafts, factory, pause=lambda s: None)
    by = {(r["doc_id"], r["page"]): (r["action"], r["attempts"]) for r in got.collect()}
    assert [by[1, p] for p in (1, 2, 3)] == [("cached", 0), ("done", 1), ("done", 1)]
    assert [by[2, p] for p in (1, 2, 3)] == [("done", 1), ("pause_document", 2), ("paused", 0)]
    assert {by[3, p] for p in (1, 2, 3)} == {("done", 2)} and {by[4, p] for p in (1, 2, 3)} == {("use_tex", 1)} and {by[5, p] for p in (1, 2, 3)} == {("fallback_page", 2)}
    assert sorted((r["doc_id"], r["page"]) for r in recognise.delivered(got).collect() if r["doc_id"] == 2) == [(2, 1)]
    assert [tuple(r) for r in recognise.incomplete(got).collect()] == [(2, 3, 1, 2)]
    late = recognise.recognise(pages.where("doc_id = 3"), drafts, factory, start_page=3, process=lambda df: df.withColumn("tex", F.concat(F.lit("% PAGE_COMPLETED: 1/9\n"), "tex")), pause=lambda s: None)
    assert {(r["page"], r["action"]) for r in late.collect()} == {(1, "missing_draft"), (2, "missing_draft"), (3, "rejected")}

    def adapters():
        def ocr(row):
            if row["page"] == 2:
                raise OSError
            return f"ocr {row['page']}"

        def tables(row):
            if row["page"] == 3:
                raise OSError
            return row.get("ocr", "-") + " t"

        return {"ocr": ocr, "tables": tables}

    staged = pages.where("doc_id = 1").select("cache_key", "page", F.lit("r1").alias("render"))
    got = {r["page"]: (r["ocr"], r["tables"], r["degraded"]) for r in recognise.prepare(staged, adapters).collect()}
    assert got == {1: ("ocr 1", "ocr 1 t", []), 2: (None, "- t", ["ocr"]), 3: ("ocr 3", None, ["tables"])}
    assert all(r["ocr"] is None and not r["degraded"] for r in recognise.prepare(staged, adapters, "none").collect())
    stored = spark.createDataFrame([("k1", 1, "r1", "x"), ("k1", 2, "r0", "x"), ("k1", 3, "r1", None)], "cache_key string, page int, render string, payload string")
    through = recognise.read_through(staged, stored, lambda df: df.withColumn("payload", F.lit("new")))
    assert {(r["page"], r["payload"], r["cached"]) for r in through.collect()} == {(1, "x", True), (2, "new", False), (3, "new", False)}
    g = spark.createDataFrame([(None, None, 1, 3), (2, 3, 3, 3), (1, 3, 3, 3), (2, 4, 3, 3), (None, None, 4, 3)], "l int, t int, s int, n int")
    assert [r[0] for r in g.select(recognise.resume_faults(*map(F.col, "ltsn"))).collect()] == [None, None, "checkpoint", "total_pages", "start_page"]


def test_files_to_segments(spark, tmp_path):
    files = {"a.txt": b"hi \xff there", "b.csv": b"n,v\nx,1\nyy,22\n", "c.html": b"<h2>A</h2>one<h2>B</h2>two", "d.pdf": b"%PDF /Image/ x", "e.zip": b"PK", "f.docx": b"broken", "g.png": b"img", "h.pptx": b"s", "i.mp3": b"m"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)

    def broken(data, path):
        raise RuntimeError("secret")

    model = lambda b, p: [{"page": 1, "content": "page one", "input": 5, "output": 2}, {"page": 2, "content": "two", "input": 1, "output": 1}]
    words = lambda b, p: [{"page": 1, "content": "ocr", "bboxes": [("w", 0.0, 0.0, 1.0, 1.0)]}]
    adapters = {"model": model, "layout": broken, "ocr": words, "slides": lambda b, p: [(1, "Introduction", "slide")], "audio": broken}
    got = dispatch.parse_path(spark, str(tmp_path), adapters=adapters, boxes=True).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["seg_no"]):
        by.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    say = lambda n: [(r["parser"], r["reader"], r["heading"], r["content"], r["error"]) for r in by[n]]
    assert say("a.txt") == [("STATIC_PARSE", "text", None, "hi  there", None)]
    assert by["b.csv"][0]["content"] == "| n   |   v |\n|:----|----:|\n| x   |   1 |\n| yy  |  22 |"
    assert [(h, c) for _, _, h, c, _ in say("c.html")] == [("Introduction", ""), ("A", "one"), ("B", "two")]
    assert [x[0] for x in say("d.pdf")] == ["LLM_PARSE"] * 2 and say("g.png")[0][1] == "model" and by["g.png"][0]["bboxes"][0]["word"] == "w" and not by["g.png"][1]["bboxes"]
    assert say("e.zip")[0][4] == "unsupported file type" and say("f.docx")[0][:2] == ("LLM_PARSE", "model")
    word = dispatch.parse_path(spark, str(tmp_path / "f.docx"), adapters=adapters, parser="STATIC_PARSE").collect()
    assert [(r["reader"], r["error"]) for r in word] == [(None, "BadZipFile")]
    assert say("h.pptx") == [("STATIC_PARSE", "slides", "Introduction", "slide", None)] and say("i.mp3")[0][4] == "RuntimeError" and "secret" not in str(got)
    static = dispatch.parse_path(spark, str(tmp_path / "d.pdf"), adapters=adapters, parser="STATIC_PARSE").collect()
    assert [(r["reader"], r["content"]) for r in static] == [("ocr", "ocr")]
    cheap = dispatch.parse_path(spark, str(tmp_path / "g.png"), adapters=adapters, cost_threshold=100).collect()
    assert [r["reader"] for r in cheap] == ["ocr"]
    docs = {r["path"].rsplit("/", 1)[-1]: r for r in dispatch.documents(dispatch.parse_path(spark, str(tmp_path), adapters=adapters)).collect()}
    assert docs["d.pdf"]["raw"] == "page one\n\ntwo" and (docs["d.pdf"]["input"], docs["d.pdf"]["total"], docs["d.pdf"]["llm_page_count"]) == (6, 9, 2) and docs["a.txt"]["total"] == 0
    urls = spark.createDataFrame([("https://x.example/a/b.pdf?q=1", None), ("https://x.example/a/", "image/png; x"), ("https://x.example", "text/html"), ("bad", None)], "u string, t string")
    assert [r[0] for r in urls.select(dispatch.download_name(F.col("u"), F.col("t"))).collect()] == ["b.pdf", "a.png", "download.html", "bad"]
    pages = dispatch.pages_of(spark.read.format("binaryFile").load(str(tmp_path / "d.pdf")), lambda b, dpi, first: [(b"1", 10, 20), (b"2", 0, 0)])
    assert [(r["page"], r["width"]) for r in pages.collect()] == [(1, 10)]

    def fetch(url):
        if "bad" in url:
            raise OSError
        return "<title>T \xe9</title><p>x".encode("iso-8859-1")

    got = {r["url"]: (r["title"], r["markdown"], r["error"]) for r in dispatch.web_pages(spark.createDataFrame([("ok",), ("bad",)], "url string"), fetch, 0.0).collect()}
    assert got == {"ok": ("T \xe9", "x", None), "bad": (None, None, "OSError")}
    assert dispatch.cost_rates(spark, {"m": {"input": 1}}).collect()[0]["input_rate"] == 1.0 and dispatch.union([urls, urls.withColumn("x", F.lit(1))]).count() == 8
    with pytest.raises(ValueError):
        dispatch.cost_rates(spark, 3)


def test_page_files_and_stage_artifacts(spark, tmp_path):
    out = tmp_path / "o.tex"
    with pytest.raises(ValueError):
        stages.write_page(out, 1, 2, "no begin")
    stages.write_page(out, 1, 2, "\\documentclass{a}\n\\begin{document}\none\n\\end{document}\n% PAGE_COMPLETED: 1/2")
    assert stages.checkpoint(out) == (1, 2) and out.read_text().count("\\providecommand") == 3 and "\\end{document}" not in out.read_text()
    before = out.read_text()
    for page, total, text in ((3, 2, "x"), (2, 3, "x"), (2, 2, "x\n% PAGE_COMPLETED: 1/2")):
        with pytest.raises(ValueError):
            stages.write_page(out, page, total, text)
    assert out.read_text() == before
    df = spark.createDataFrame([(1, 2, "again"), (2, 2, "two")], "page int, total int, tex string")
    assert stages.write_pages(df, out) == 1
    text = out.read_text()
    assert text.endswith("one\n\ntwo\n\n\\end{document}\n% PAGE_COMPLETED: 2/2\n") and text.count("PAGE_COMPLETED") == 1 and text.count("\\end{document}") == 1
    assert [p.name for p in tmp_path.iterdir()] == ["o.tex"]
    (tmp_path / "in.tex").write_text("a \\fieldvalue{x} b")
    found = stages.organise(tmp_path / "in.tex", tmp_path / "t.tex", tmp_path / "v.json")
    assert found["value_count"] == 1
    edited = (tmp_path / "v.json").read_text().replace('"value": "x"', '"value": "new"')
    (tmp_path / "v.json").write_text(edited)
    stages.fill(tmp_path / "t.tex", tmp_path / "v.json", tmp_path / "f.tex")
    assert (tmp_path / "f.tex").read_text() == "a \\fieldvalue{new} b"
    k, root = "a" * 64, str(tmp_path / "cache")
    rows = [(1, '{"x": 1}', "ocr", k), (2, '{"x": ', "ocr", k), (3, "tex", "draft", k), (1, '{"x": 5}', "ocr", "b" * 64)]
    spark.createDataFrame(rows, "page int, payload string, stage string, cache_key string").write.partitionBy("stage", "cache_key").parquet(root)
    got = {(r["cache_key"][0], r["page"]): r["json"] and r["json"]["x"] for r in stages.read_stage(spark, root, "ocr", "x long").collect()}
    assert got == {("a", 1): 1, ("a", 2): None, ("b", 1): 5}
    stages.invalidate(spark, root, spark.createDataFrame([("ocr", k, 1)], "stage string, cache_key string, page int"))
    assert {(r["cache_key"][0], r["page"]) for r in stages.read_stage(spark, root, "ocr", "x long").collect()} == {("a", 2), ("b", 1)}
    assert stages.read_stage(spark, root, "draft", "x long").collect()[0]["text"] == "tex"
    for wrong in (("ocr", "x"), ("no", k)):
        with pytest.raises(ValueError):
            stages.stage_path(root, *wrong)
    docs = spark.createDataFrame([("p", "text")], "path string, raw string")
    stages.write_markdown(docs, str(tmp_path / "md"))
    stages.write_markdown(docs, str(tmp_path / "js"), True)
    assert spark.read.text(str(tmp_path / "md")).collect()[0][0] == "text" and spark.read.json(str(tmp_path / "js")).count() == 1
    stages.log_calls(spark.createDataFrame([("c1", "secret")], "call_id string, prompt string"), str(tmp_path / "log"))
    stages.log_calls(spark.createDataFrame([("c2", "secret")], "call_id string, prompt string"), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 2 and "prompt" not in log.columns
    assert len(stages.file_digests(spark, str(tmp_path / "in.tex")).collect()[0]["sha256"]) == 64


WORD = "doc_id long, page int, pos int, text string, x0 double, top double, bottom double, size double, fontname string"


def words(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, x, top, top + size, size, "Serif") for i, (t, x, top, size) in enumerate(rows)], WORD)


def test_lines_are_snapped_in_a_chain(spark):
    w = words(spark, [("a", 0.0, 10.0, 11.0), ("b", 0.0, 12.5, 11.0), ("c", 0.0, 12.9, 11.0), ("d", 0.0, 13.0, 11.0), ("e", 0.0, 15.9, 11.0)])
    got = [r["top"] for r in layout.snapped(w).orderBy("pos").collect()]
    assert got == [10.0, 10.0, 10.0, 13.0, 13.0]


def test_tables_and_rules_flow_with_words(spark):
    w = words(spark, [("Head", 72.0, 10.0, 24.0), ("one", 72.0, 40.0, 11.0), ("two", 100.0, 40.0, 11.0), ("in", 122.0, 60.0, 11.0), ("after", 72.0, 120.0, 11.0), ("end", 72.0, 121.0, 11.0), ("mail", 90.0, 121.0, 11.0)])
    modes = spark.createDataFrame([(1, 1, 11.0, 72.0)], "doc_id long, page int, body_size double, base_left double")
    tables = spark.createDataFrame([(1, 1, 0, 70.0, 110.0, "|t|\n\n")], "doc_id long, page int, table_no int, top double, bottom double, content string")
    rules = spark.createDataFrame([(1, 1, 0, 50.0), (1, 1, 1, 100.0), (1, 1, 2, 300.0)], "doc_id long, page int, rule_no int, top double")
    stream = layout.page_stream(w, tables, rules)
    kinds = [r["kind"][0] for r in stream.orderBy("n").collect()]
    assert "".join(kinds) == "wwwrwtrwwwr"
    got = [(r["kind"], r["markdown"]) for r in layout.flowing_blocks(stream, modes).orderBy("block_no").collect()]
    # The first rule lies below the last line when it is reached, so it is written with the second, after the table.
    assert got == [("heading", "# Head\n\n"), ("paragraph", " one two\n\n"), ("paragraph", "&nbsp;" * 9 + " in\n\n"), ("table", "|t|\n\n"), ("rule", "\n---\n\n" * 2), ("paragraph", " after end mail\n\n")]
    assert layout.page_texts(layout.flowing_blocks(stream, modes)).count() == 1
    none = stream.where("false")
    assert layout.flowing_blocks(none, modes).count() == 0


def test_whole_pages_flow_as_their_parts_with_one_shuffle(spark, monkeypatch):
    r = random.Random(5)
    fonts = [None, "Mono", "Serif", "Heavy-Italic", "Serif-Bold", "Oblique"]
    rows = []
    for d in range(6):
        for p in range(1, 6):
            top, font = 10.0, r.choice(fonts)
            for i in range(r.choice([1, 4, 60])):
                top += r.choice([0, 0, 0, 1.0, 4.0, 14.0, 60.0])
                font = r.choice([font, font, font, r.choice(fonts)])
                size = r.choice([11.0] * 6 + [11.5, 14.0, 24.0])
                rows.append((d, p, i, r.choice(["word", "w\u00f6rd \u4e2d", "", "x", None]), r.choice([72.0, 72.0, 76.0, 99.5, 200.0]), top, top + size, size, font))
    w = spark.createDataFrame(r.sample(rows, len(rows)), WORD)
    tables = spark.createDataFrame([(d, p, n, float(t), t + r.choice([5.0, 90.0]), f"|{n}|\n\n") for d in range(6) for p in range(1, 6) for n, t in enumerate(sorted(r.sample(range(400), r.randint(0, 3))))], "doc_id long, page int, table_no int, top double, bottom double, content string")
    rules = spark.createDataFrame([(d, p, n, float(t)) for d in range(6) for p in range(1, 6) for n, t in enumerate(sorted(r.choices(range(400), k=r.randint(0, 7))))], "doc_id long, page int, rule_no int, top double")
    read = lambda df: sorted(tuple(x) for x in df.select("doc_id", "page", "block_no", "kind", "markdown").collect())
    want = read(layout.flowing_blocks(layout.page_stream(w, tables, rules), layout.page_modes(w)))
    whole = flow.page_blocks(w, tables, rules)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert {x[3] for x in want} == {"heading", "paragraph", "table", "rule"} and read(whole) == want
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1
    monkeypatch.setattr(flow, "_TOGETHER", 1)
    assert read(flow.page_blocks(w, tables, rules)) == want
    # A page without words keeps its table; words, tables and rules that name no page are left out.
    lone = spark.createDataFrame([(1, 9, 0, 5.0, 9.0, "|t|"), (None, 9, 0, 5.0, 9.0, "|n|")], tables.schema)
    assert read(flow.page_blocks(w.where("false"), lone, rules.where("false"))) == [(1, 9, 0, "table", "|t|")]
    assert read(flow.page_blocks(w.where("false"), lone.where("false"), rules.where("false"))) == []
    pages = lambda df: sorted(map(tuple, df.select("doc_id", "page").collect()))
    data = "/root/testdata/sf0.001"
    assert pages(inputs.layout_pages(spark, data)) == pages(inputs.layout(spark, data).select("doc_id", "page").distinct())


def test_text_parts_are_found_in_boxes(spark):
    sch = "doc_id long, page int, pos int, text string"
    content = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate("the cat sat on the cat mat".split())], sch)
    boxes = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate("the kat cat sat on the mat".split())], sch)
    needle = lambda *w: spark.createDataFrame([(1, 1, 7, list(w))], "doc_id long, page int, needle_id int, words array<string>")
    got = lambda mode, *w: sorted((r["start"], r["pos"], r["box_pos"]) for r in match.find_boxes(content, boxes, needle(*w), mode).collect())
    assert got("exact", "the", "cat") == [(0, 0, 0), (0, 1, 2)]
    assert got("all_matches", "the", "cat") == [(0, 0, 0), (0, 1, 2), (4, 4, 5)]
    assert got("fuzzy", "thee", "cat", "mat") == [(4, 4, 5), (4, 5, 1), (4, 6, 6)]
    assert got("fuzzy", "nothing", "alike") == [] and got("exact", *["a"] * 9) == []
    with pytest.raises(ValueError):
        match.find_boxes(content, boxes, needle("a"), "other")
    raw = spark.createDataFrame([(1, "(https://a.b/c) /Rect [1 2 3 4] (https://a.b/c) /Rect [5 6 7 8] (http://z)"), (2, "none"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in match.uri_rects(raw).collect()] == [(1, "https://a.b/c", [5.0, 6.0, 7.0, 8.0])]


def fake_adapters():
    return {"model": lambda b, p: [(1, None, "seen")]}


def fake_call(data, wanted):
    return '{"n": ' + str(len(data)) + "}"


def fake_render(data, dpi, first):
    return [(data, 10, 10)] * 3


def fake_page(row, attempt):
    body = "\\begin{document}\n" if row["page"] == 1 else ""
    return f"{body}% #VALUE_ID: LEX-P{row['page']:04d}-V0001\n\\fieldvalue{{{row['page']}}}\n% PAGE_COMPLETED: {row['page']}/{row['total']}"


def test_commands(spark, tmp_path, capsys):
    from leafmill import cli

    (tmp_path / "a.png").write_bytes(b"12345")
    (tmp_path / "a.txt").write_text("plain")
    here = "test_documents"
    cli.main(["parse", str(tmp_path / "a.png"), "--adapters", f"{here}:fake_adapters"], spark)
    cli.main(["parse", str(tmp_path / "a.txt"), "--format", "json", "--output", str(tmp_path / "o.json")], spark)
    assert capsys.readouterr().out == "seen\n" and json.loads((tmp_path / "o.json").read_text())["raw"] == "plain"
    cli.main(["schema", str(tmp_path / "a.png"), '{"type": "object", "properties": {"n": {"type": "integer"}}, "required": ["n"]}', "--adapter", f"{here}:fake_call"], spark)
    assert json.loads(capsys.readouterr().out) == {"n": 5}
    out = tmp_path / "o.tex"
    cli.main(["latex", str(tmp_path / "a.png"), str(out), "--adapter", f"{here}:fake_page", "--renderer", f"{here}:fake_render", "--organize-values"], spark)
    assert stages.checkpoint(out) == (3, 3) and json.loads((tmp_path / "o.values.json").read_text())["value_count"] == 3
    cli.main(["latex-fill", str(tmp_path / "o.template.tex"), str(tmp_path / "o.values.json"), str(tmp_path / "f.tex")])
    assert (tmp_path / "f.tex").read_text() == out.read_text()
    cli.main(["latex-template", str(out), str(tmp_path / "t.tex"), "--values-output", str(tmp_path / "v.json")])
    assert (tmp_path / "t.tex").read_text() == (tmp_path / "o.template.tex").read_text()
    with pytest.raises(SystemExit):
        cli.main(["latex", str(tmp_path / "a.png"), str(out), "--adapter", f"{here}:fake_page", "--renderer", f"{here}:fake_render", "--start-page", "3"], spark)
