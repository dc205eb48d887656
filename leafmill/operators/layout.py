"""Words with boxes: modes, lines, blocks, rules, cells, links. Joins always carry (doc, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

PAGE = ["doc_id", "page"]


def page_modes(words: DataFrame, y_tolerance: float = 5.0) -> DataFrame:
    """Most frequent font size and left edge of lines of each page; of equally frequent ones the smallest."""
    lag = F.lag("top").over(Window.partitionBy(*PAGE).orderBy("pos"))
    w = words.withColumn("starts", F.coalesce(F.abs(F.col("top") - lag) > y_tolerance, F.lit(True)))
    counts = w.groupBy(*PAGE, "size").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*PAGE).agg(F.min_by("size", F.struct(-F.col("n"), "size")).alias("body_size"))
    lefts = w.where("starts").groupBy(*PAGE, "x0").agg(F.count("*").alias("n")).groupBy(*PAGE).agg(F.min_by("x0", F.struct(-F.col("n"), "x0")).alias("base_left"))
    return sizes.join(lefts, PAGE)


def proportional_boxes(lines: DataFrame, width: float = 1.0) -> DataFrame:
    """Word boxes of a line's box by the words' shares of its characters: ``doc_id, line_no, word_no, word, x0, x1``."""
    w = lines.select("doc_id", "line_no", text.words(F.col("line")).alias("ws")).where(F.size("ws") > 0)
    w = w.withColumn("total", F.length(F.array_join("ws", "")))
    before = lambda i: F.length(F.array_join(F.slice("ws", F.lit(1), i), ""))
    boxes = F.transform("ws", lambda x, i: F.struct(i.alias("word_no"), x.alias("word"), (width * before(i) / F.col("total")).alias("x0"), (width * (before(i) + F.length(x)) / F.col("total")).alias("x1")))
    return w.select("doc_id", "line_no", F.explode(boxes).alias("b")).select("doc_id", "line_no", "b.*")


def blocks(words: DataFrame, modes: DataFrame, y_tolerance: float = 5.0) -> DataFrame:
    """Headings and paragraphs of each page in reading order: ``doc_id, page, block_no, kind, markdown``.

    A new line, or a change between heading sizes and others, opens a block. One pass of windows over the page's
    words: flags, their running sum, ordered concatenation.
    """
    order = Window.partitionBy(*PAGE).orderBy("pos")
    w = words.join(modes, PAGE).withColumn("level", text.heading_level(F.col("size"), F.col("body_size")))
    prev_top, prev_level = F.lag("top").over(order), F.lag(F.col("level").isNotNull()).over(order)
    new_line = F.coalesce(F.abs(F.col("top") - prev_top) > y_tolerance, F.lit(False))
    first = F.row_number().over(order) == 1
    w = w.withColumn("new_line", new_line).withColumn("opens", (first | new_line | (F.col("level").isNotNull() != prev_level)).cast("int"))
    w = w.withColumn("block_no", F.sum("opens").over(order))
    mono = F.lower("fontname").contains("mono")
    mark = F.when(F.col("new_line") & F.col("level").isNull(), F.concat(F.repeat(F.lit("&nbsp;"), 3 * text.indent_level(F.col("x0"), F.col("base_left"))), F.lit(" "))).otherwise(F.lit(""))
    w = w.withColumn("shown", F.concat(mark, F.when(mono, F.concat(F.lit("`"), "text", F.lit("`"))).otherwise(text.formatted(F.col("text"), F.col("fontname")))))
    parts = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    g = w.groupBy(*PAGE, "block_no").agg(F.min("level").alias("level"), F.bool_and(mono).alias("mono"), F.array_join(parts("shown"), " ").alias("shown"), F.array_join(parts("text"), " ").alias("plain"))
    body = F.when(F.col("mono"), F.concat(F.lit("```\n"), "plain", F.lit("\n```\n\n"))).otherwise(F.concat("shown", F.lit("\n\n")))
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    return g.select(*PAGE, F.col("block_no").cast("int").alias("block_no"), kind.alias("kind"), text.drop_redundant_marks(F.concat(F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(F.lit("")), body)).alias("markdown"))


def _overlap(words: DataFrame, zones: DataFrame):
    a, b = geometry.columns("w."), geometry.columns("z.")
    return (F.col("w.doc_id") == F.col("z.doc_id")) & (F.col("w.page") == F.col("z.page")) & geometry.touches(a, b)


def words_in(words: DataFrame, zones: DataFrame) -> DataFrame:
    """A row for each pair of a zone (``zone_no`` and a box) and a word that touch; (doc, page) is the equi key."""
    return words.alias("w").join(zones.alias("z"), _overlap(words, zones)).select("w.doc_id", "w.page", "z.zone_no", "w.pos", "w.text")


def words_outside(words: DataFrame, zones: DataFrame) -> DataFrame:
    return words.alias("w").join(zones.alias("z"), _overlap(words, zones), "left_anti")


def struck(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Words with ``~~`` for each rule whose first touched word (least ``pos``) they are."""
    hit = words_in(words, rules).groupBy(*PAGE, "zone_no").agg(F.min("pos").alias("pos")).groupBy(*PAGE, "pos").agg(F.count("*").cast("int").alias("times"))
    out = words.join(hit, [*PAGE, "pos"])
    return out.select(*PAGE, "pos", F.concat(F.repeat(F.lit("~~"), F.col("times")), "text", F.repeat(F.lit("~~"), F.col("times"))).alias("text"))


def rules_of(lines: DataFrame) -> DataFrame:
    """Lines that are horizontal rules: flat, or over twenty times as wide as high."""
    h, w = F.abs(F.col("bottom") - F.col("top")), F.abs(F.col("x1") - F.col("x0"))
    return lines.where((h < 0.1) | (w > 20 * h))


def link_spans(words: DataFrame, links: DataFrame, slack: float = 1.0) -> DataFrame:
    """First and last word whose corner lies in a link's rectangle, ``slack`` points around it allowed."""
    inside = (F.col("w.doc_id") == F.col("z.doc_id")) & (F.col("w.page") == F.col("z.page")) & F.col("w.x0").between(F.col("z.x0") - slack, F.col("z.x1") + slack) & F.col("w.top").between(F.col("z.top") - slack, F.col("z.bottom") + slack)
    return words.alias("w").join(links.alias("z"), inside).groupBy("w.doc_id", "w.page", "z.uri").agg(F.min("w.pos").alias("first_pos"), F.max("w.pos").alias("last_pos"))


def text_under(words: DataFrame, fields: DataFrame) -> DataFrame:
    """Text of the words that share area with a field, in reading order: ``doc_id, page, field_no, text``."""
    a, b = geometry.columns("w."), geometry.columns("z.")
    on = (F.col("w.doc_id") == F.col("z.doc_id")) & (F.col("w.page") == F.col("z.page")) & (geometry.overlap_area(a, b) > 0)
    seen = words.alias("w").join(fields.alias("z"), on).groupBy("w.doc_id", "w.page", "z.field_no").agg(F.array_sort(F.collect_list(F.struct("w.top", "w.x0", "w.text"))).alias("r"))
    return seen.select("doc_id", "page", "field_no", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))


def splice_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``[text](uri)`` put into page texts: ``pages(doc_id, page, text)``, ``links(doc_id, page, first, end, uri)``.

    Spans grow to the blanks around them; links go in by position, so no offset has to be carried. A fold over the
    page's sorted links.
    """
    each = links.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("first", "end", "uri"))).alias("links"))

    def grow(t, x):
        head = F.substring(t, F.lit(1), x["first"])
        left = x["first"] - F.length(F.substring_index(head, " ", -1))
        right = x["end"] + F.length(F.substring_index(F.substring(t, x["end"] + 1, F.length(t)), " ", 1))
        return left, right

    def step(acc, x):
        left, right = grow(F.col("text"), x)
        fits = left >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, left - acc["at"]), F.lit("["), F.substring(F.col("text"), left + 1, right - left), F.lit("]("), x["uri"], F.lit(")"))
        return F.struct(F.when(fits, piece).otherwise(acc["out"]).alias("out"), F.when(fits, right).otherwise(acc["at"]).cast("int").alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("links", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return pages.join(each, PAGE, "left").select(*PAGE, F.when(F.col("links").isNull(), F.col("text")).otherwise(done).alias("text"))


def crossing_rows(fields: DataFrame, least: float = 0.65) -> DataFrame:
    """First pair of fields of one table that overlap vertically though they stand in different TeX rows.

    ``fields(doc_id, page, table_no, field_id, pos, row, top, bottom)``; an equi self-join on the table.
    """
    a, b = fields.alias("a"), fields.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "page", "table_no")]
    on = same[0] & same[1] & same[2] & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.row") != F.col("b.row")) & (geometry.vertical_overlap(F.col("a.top"), F.col("a.bottom"), F.col("b.top"), F.col("b.bottom")) >= least)
    pair = F.min(F.struct(F.col("a.pos"), F.col("b.pos").alias("pos_b"), F.col("a.field_id").alias("left"), F.col("b.field_id").alias("right"))).alias("p")
    return a.join(b, on).groupBy("a.doc_id", "a.page").agg(pair).select("doc_id", "page", F.col("p.left").alias("id_left"), F.col("p.right").alias("id_right"))


def snapped(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words with ``top`` set to the word's before if they differ by less than ``tolerance``: that one may be set itself.

    What a word gets depends on all before it on the page, so a page (a bounded group) is worked through in one call.
    """
    kinds = dict(words.dtypes)

    def page(frame):
        frame = frame.sort_values("pos", kind="stable")
        tops = frame["top"].to_list()
        for i in range(1, len(tops)):
            if abs(tops[i] - tops[i - 1]) < tolerance:
                tops[i] = tops[i - 1]
        return frame.assign(top=tops)

    return words.groupBy(*PAGE).applyInPandas(page, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def page_stream(words: DataFrame, tables: DataFrame, rules: DataFrame) -> DataFrame:
    """Words, tables and rules of each page in one order: ``doc_id, page, n, kind, ...`` (kind: rule, table or word).

    ``tables(doc_id, page, table_no, top, bottom, content)``, ``rules(doc_id, page, rule_no, top)``. All stand by their top;
    of equal tops rules come first, and a table before the first word that reaches below it.
    """
    t, w = tables.alias("t"), words.alias("w")
    below = (F.col("t.doc_id") == F.col("w.doc_id")) & (F.col("t.page") == F.col("w.page")) & (F.col("w.bottom") > F.col("t.bottom"))
    placed = t.join(w, below, "left").groupBy("t.doc_id", "t.page", "t.table_no", "t.top", "t.bottom", "t.content").agg(F.min("w.pos").alias("before"))
    late = F.lit(2**31 - 1)
    each = words.select(*PAGE, F.lit("word").alias("kind"), "top", "bottom", F.lit(1).alias("a"), F.col("pos").alias("b"), F.lit(1).alias("c"), "pos", "text", "size", "fontname", "x0", F.lit(None).cast("string").alias("content"))
    none = lambda kind: F.lit(None).cast(kind)
    as_table = placed.select(*PAGE, F.lit("table").alias("kind"), "top", "bottom", F.lit(1).alias("a"), F.coalesce("before", late).alias("b"), F.lit(0).alias("c"), F.col("table_no").alias("pos"), none("string").alias("text"), none("double").alias("size"), none("string").alias("fontname"), none("double").alias("x0"), "content")
    as_rule = rules.select(*PAGE, F.lit("rule").alias("kind"), "top", F.col("top").alias("bottom"), F.lit(0).alias("a"), F.col("rule_no").alias("b"), F.lit(0).alias("c"), F.col("rule_no").alias("pos"), none("string").alias("text"), none("double").alias("size"), none("string").alias("fontname"), none("double").alias("x0"), none("string").alias("content"))
    order = Window.partitionBy(*PAGE).orderBy("top", "a", "b", "c", "bottom", "pos")
    return each.unionByName(as_table).unionByName(as_rule).withColumn("n", F.row_number().over(order)).drop("a", "b", "c")


def flowing_blocks(stream: DataFrame, modes: DataFrame, y_tolerance: float = 5.0) -> DataFrame:
    """Headings, paragraphs, tables and rules of ``page_stream`` as they are written: ``doc_id, page, block_no, kind, markdown``.

    A word opens a block on a new line (by its top against the last word's top or table's bottom), after a table, where
    headings and other words meet, and after a rule that was written while a paragraph was open. A rule is written once
    a rule is reached whose last line lies at or below it; it ends a paragraph, but comes before a heading that is open.
    """
    own = Window.partitionBy(*PAGE)
    before = own.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    w = stream.join(modes, PAGE).withColumn("level", F.when(F.col("kind") == "word", text.heading_level(F.col("size"), F.col("body_size"))))
    w = w.withColumn("last_y", F.last(F.when(F.col("kind") == "word", F.col("top")).when(F.col("kind") == "table", F.col("bottom")), True).over(before))
    # Rules are written at the first rule that is reached with a last line at or below theirs.
    r = w.where("kind = 'rule'").select(*PAGE, "n", "top", "last_y")
    a, b = r.alias("a"), r.alias("b")
    met = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("b.last_y") >= F.col("a.top"))
    written = a.join(b, met).groupBy("a.doc_id", "a.page", "a.n").agg(F.min("b.n").alias("at")).groupBy("doc_id", "page", "at").agg(F.count("*").cast("int").alias("rules"))
    w = w.join(written.withColumnRenamed("at", "n"), [*PAGE, "n"], "left")
    heading, word = F.col("level").isNotNull(), F.col("kind") == "word"
    # The word before, if no table stands between; whether a rule was written since.
    prev = F.last(F.when(word, F.struct("n", heading.alias("heading"))).when(F.col("kind") == "table", F.struct(F.lit(-1).alias("n"), F.lit(False).alias("heading"))), True).over(before)
    ruled = F.last(F.when(F.col("rules").isNotNull(), F.col("n")), True).over(before)
    w = w.withColumn("prev", prev).withColumn("ruled", ruled)
    new_line = F.col("last_y").isNotNull() & (F.abs(F.col("top") - F.col("last_y")) > y_tolerance)
    opens = F.col("prev").isNull() | (F.col("prev.n") < 0) | new_line | (F.col("prev.heading") != heading) | (~F.col("prev.heading") & F.coalesce(F.col("ruled") > F.col("prev.n"), F.lit(False)))
    # Where what is open is written: a heading waits for the next word or table, a paragraph goes before what follows.
    after = own.orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    flush = F.coalesce(F.first(F.when(F.col("kind") != "rule", F.col("n")), True).over(after) - F.lit(0.5), F.lit(1e9))
    w = w.withColumn("new_line", new_line).withColumn("block", F.sum((word & opens).cast("int")).over(own.orderBy("n"))).withColumn("due", F.when(heading, flush).otherwise(F.col("n").cast("double")))
    mono = F.lower("fontname").contains("mono")
    mark = F.when(F.col("new_line") & ~heading, F.concat(F.repeat(F.lit("&nbsp;"), 3 * text.indent_level(F.col("x0"), F.col("base_left"))), F.lit(" "))).otherwise(F.lit(""))
    shown = F.concat(mark, F.when(mono, F.concat(F.lit("`"), "text", F.lit("`"))).otherwise(text.formatted(F.col("text"), F.col("fontname"))))
    parts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda s: s[c]), " ")
    g = w.where(word).withColumn("shown", shown).groupBy(*PAGE, "block").agg(F.min_by("level", "n").alias("level"), F.bool_and(mono).alias("mono"), parts("shown").alias("shown"), parts("text").alias("plain"), F.max("due").alias("due"))
    body = F.when(F.col("mono"), F.concat(F.lit("```\n"), "plain", F.lit("\n```\n\n"))).otherwise(F.concat("shown", F.lit("\n\n")))
    lead = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(F.lit(""))
    blocks_ = g.select(*PAGE, "due", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("kind"), F.concat(lead, body).alias("markdown"))
    tables = w.where("kind = 'table'").select(*PAGE, F.col("n").cast("double").alias("due"), F.lit("table").alias("kind"), F.col("content").alias("markdown"))
    lines = w.where("rules is not null").select(*PAGE, F.col("n").cast("double").alias("due"), F.lit("rule").alias("kind"), F.repeat(F.lit("\n---\n\n"), F.col("rules")).alias("markdown"))
    out = blocks_.unionByName(tables).unionByName(lines)
    return out.select(*PAGE, (F.row_number().over(own.orderBy("due")) - 1).alias("block_no"), "kind", "markdown")


def page_texts(blocks_: DataFrame) -> DataFrame:
    """Blocks joined in order, with e-mail addresses linked and marks that meet taken out: ``doc_id, page, text``."""
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "markdown"))), lambda b: b["markdown"]), "")
    return blocks_.groupBy(*PAGE).agg(rows.alias("t")).select(*PAGE, text.drop_redundant_marks(text.link_emails(F.col("t"))).alias("text"))
