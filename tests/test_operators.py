"""Cases worked out by hand, and plain models of what the SQL can't say."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import geometry, latex, text
from leafmill.operators import doctags, gate, match, pages, routing, tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_template_takes_fields_apart_and_back():
    tex = "% #VALUE_ID: LEX-P0001-V0001\n% #FIELD_VALUE: Lot 批\n\\fieldvalue{\\handwritten{a{b}c}}\n% #FIELD_VALUE: Ok\n% #TODO #HANDWRITTEN: look\n\\fieldvalue{\\checkboxfield{checked}}"
    template, records = latex.extract(tex)
    assert [r["id"] for r in records] == ["LEX-P0001-V0001", "VALUE_002"]
    assert records[0]["value"] == "a{b}c" and records[0]["is_handwritten"] and records[1]["field_type"] == "checkbox" and records[1]["needs_review"]
    assert latex.fill(template, records) == tex


@pytest.mark.parametrize("tex", ["no field", "\\fieldvalue{open", "% #VALUE_ID: A\n\\fieldvalue{1}% #VALUE_ID: A\n\\fieldvalue{2}"])
def test_template_errors(tex):
    with pytest.raises(latex.TemplateError):
        latex.extract(tex)


def test_fill_needs_every_value():
    with pytest.raises(latex.TemplateError):
        latex.fill("@@FIELD_X@@", [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_characters="{}\\%@\n\r", blacklist_categories=("Cs",)), max_size=12), min_size=1, max_size=5))
def test_template_round_trip(values):
    tex = "\n".join(f"\\fieldvalue{{{v.strip()}}}" for v in values)
    assert latex.fill(*latex.extract(tex)) == tex


@pytest.mark.parametrize(("md", "want"), [("## a\nx\n## b\ny", "##"), ("a\n---\nb\n---\n", "underline"), ("plain", "#"), ("### a\n### b\n## c\n## d", "##")])
def test_dominant_heading(spark, md, want):
    assert value(spark, text.dominant_heading(F.lit(md))) == want


def test_heading_segments_keep_an_empty_introduction(spark):
    got = value(spark, text.heading_segments(F.lit("## a ## x\none\n\n## b\ntwo"), F.lit("##")))
    assert [tuple(s) for s in got] == [("Introduction", ""), ("a  x", "one"), ("b", "two")]
    got = value(spark, text.heading_segments(F.lit("in\nA\n---\none\nB\n--\ntwo"), F.lit("underline")))
    assert [tuple(s) for s in got] == [("Introduction", "in"), ("A", "one"), ("B", "two")]


def test_replies(spark):
    assert value(spark, text.fenced(F.lit("x```json\n{}\n``` y"), "json")) == "{}"
    for raw, want in (("a<output>b</output>c", "b"), ("a<output>b", "b"), ("a</output>b", "a"), ("a", "a")):
        assert value(spark, text.between_output_tags(F.lit(raw))) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 4), st.integers(1, 8)), min_size=1, max_size=8))
def test_merge_boxes_as_a_plain_loop(spark, raw):
    boxes = [(x / 10, t / 10, (x + w) / 10, t / 10 + 0.1) for x, t, w in raw]
    want, cur = [], None
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if cur and not (cur[3] < b[1] or b[3] < cur[1]) and min(abs(b[0] - cur[2]), abs(b[2] - cur[0])) <= 0.1:
            cur = (cur[0], min(cur[1], b[1]), max(cur[2], b[2]), max(cur[3], b[3]))
        else:
            want += [cur] if cur else []
            cur = b
    df = spark.createDataFrame([(boxes,)], "b array<struct<x0:double,top:double,x1:double,bottom:double>>")
    got = [tuple(r) for r in df.select(geometry.merge_boxes(F.col("b"), 0.1).alias("m")).first()[0]]
    # equal tops and left edges may come in either order
    assert len(got) == len([*want, cur]) or len({b[:2] for b in boxes}) < len(boxes)
    if len({b[:2] for b in boxes}) == len(boxes):
        assert got == [*want, cur]


def test_gate_folds_like_its_steps(spark):
    statuses = [200] * 9 + [429, 429] + [200] * 20 + [429]
    now = (4, 0)
    for s in statuses:
        now = gate.step(now, s)
    assert value(spark, gate.fold(F.array(*map(F.lit, statuses)))) == now[0]


def test_gate_stream_ends_like_the_batch(spark, tmp_path):
    from leafmill.plans import inputs
    from leafmill.streaming.gates import gate_stream

    src = str(tmp_path / "in")
    rows = inputs.outcomes(spark, "/root/testdata/sf0.001")
    rows.repartition(1).write.parquet(src)
    q = gate_stream(spark.readStream.schema(rows.schema).parquet(src)).writeStream.format("memory").queryName("limits").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["user_id"]: r["limit"] for r in spark.table("limits").collect()}
    assert got == {r["user_id"]: r["final_limit"] for r in gate.final_limits(rows).collect()}


def test_html_grid_spans():
    html = "<tr><td colspan=2>a</td></tr><tr><td rowspan=2>b</td><td>c</td></tr><tr><td>d</td></tr>"
    cells, error = tables.grid_of(f"<table>{html}</table>")
    assert error is None and [c[:2] for c in cells] == [(0, 0), (1, 0), (1, 1), (2, 1)]
    assert tables.grid_of("<tr><td rowspan=3>a</td></tr>")[1] == "invalid span"
    assert tables.grid_of("")[1]


def test_doctags():
    got = doctags.parse("<section_header_level_9><loc_1><loc_2><loc_3><loc_500>T</section_header_level_9><text>x</text><otsl><ched>a<ched>b<nl><fcel>1<fcel>2<nl></otsl>")
    assert got == [("###### T", [0.002, 0.004, 0.006, 1.0]), ("x", None), ("| a | b |\n|---|---|\n| 1 | 2 |", None)]


def test_greedy_takes_the_nearest_left(spark):
    c = spark.createDataFrame([(1, 1, 0, "abcd"), (1, 1, 1, "abce"), (1, 1, 2, "zzzzzzzz")], "doc_id long, page int, pos int, text string")
    b = spark.createDataFrame([(1, 1, 0, "abce"), (1, 1, 1, "abcx")], "doc_id long, page int, pos int, text string")
    got = {r["pos"]: r["box_pos"] for r in match.greedy_nearest(c, b, ["doc_id", "page"]).collect()}
    assert got == {0: 1, 1: 0, 2: None}


def test_greedy_as_a_plain_walk_and_with_a_shuffle_for_each_side(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    sides = [[(d, p, i, word()) for d in range(3) for p in range(1, 5) for i in range(r.randint(0, 25))] for _ in range(2)]
    kind = "doc_id long, page int, pos int, text string"
    frames = [spark.createDataFrame(r.sample(rows, len(rows)), kind) for rows in sides]
    df = match.greedy_nearest(*frames, ["doc_id", "page"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    got = {(x["doc_id"], x["page"], x["pos"]): x["box_pos"] for x in df.collect()}
    want = {}
    for d in range(3):
        for p in range(1, 5):
            content, boxes = ([x[2:] for x in rows if x[:2] == (d, p)] for rows in sides)
            free, first, late = list(boxes), [b[1] for b in boxes], []
            for i, t in content:
                same = [b for b in free if b[1] == t]
                want[d, p, i] = same[0][0] if same else None
                free = [b for b in free if not same or b != same[0]]
                late += [] if same else [(i, t)]
            for i, t in late:
                near = [(n, first.index(b[1]), b) for b in free if (n := match._edits(t, b[1], 3)) <= 3]
                if near:
                    want[d, p, i] = min(near)[2][0]
                    free.remove(min(near)[2])
    assert got == want
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_fuzzy_windows_as_a_scan(spark):
    docs = [(1, "the quick brown fox jumps over it all".split()), (2, "a teh quick brwn fox ran".split()), (3, "nothing of that kind here".split())]
    items = [(7, "the quick brown fox".split())]
    t = spark.createDataFrame(docs, "doc_id long, words array<string>")
    n = spark.createDataFrame(items, "item_id long, words array<string>")
    got = {(r["doc_id"], r["start"], r["dist"]) for r in match.fuzzy_windows(n, t).collect()}
    assert got == {(1, 0, 0), (2, 1, 3)}


def test_cache_key_ignores_attempts_and_order(spark):
    key = lambda c, v: value(spark, pages.cache_key(F.lit("a" * 64), c, v, "p", F.lit("m")))
    assert key({"max_page_attempts": 1, "dpi": 2}, {"a": "1", "b": "2"}) == key({"dpi": 2, "max_page_attempts": 9, "reasoning_effort": None}, {"b": "2", "a": "1"})
    assert key({"dpi": 2}, {}) != key({"dpi": 3}, {})
    assert value(spark, pages.cache_key(F.lit("nothex"), {}, {}, "p", F.lit("m"))) is None


def test_orientation(spark):
    at = lambda *x: value(spark, geometry.orientation(*[F.lit(v) for v in x]))
    assert (at(270, 0.99, 270, 0.9), at(270, 0.5, 0, 0.0), at(90, 0.9, 0, 0.9), at(0, 0.99, 0, 0.9)) == (270, 0, 0, 0)


def test_failures_and_steps(spark):
    step = lambda name, status, attempt: value(spark, routing.next_step(F.lit(name), F.lit(status).cast("int"), F.lit(False), F.lit(False), F.lit(False), F.lit(attempt)))
    assert (step("HTTPError", 401, 0), step("HTTPError", 429, 0), step("HTTPError", 429, 1), step("KeyError", None, 0)) == ("pause_document", "retry", "pause_document", "fallback_page")


def test_names_nothing_private():
    assert not re.search(r"s3://|gs://", open(text.__file__).read())
