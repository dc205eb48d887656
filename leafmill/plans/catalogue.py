"""The query catalogue: one entry for each operator family, over whole tables, and the SQL that answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, latex, text
from ..operators import crawl, doctags, gate, layout, match, pages, routing, tables, usage
from . import inputs
from .inputs import duck, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- text and routing


@query("q01_text_segments", "SELECT doc_id, 1 AS page, sha256(text) AS content_sha, length(text) AS n FROM documents")
def q01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.sha2("text", 256).alias("content_sha"), F.length("text").cast("long").alias("n"))


_MIME_CASE = "CASE " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in routing.MIME.items()) + " END"
_ROUTED = f"""routed AS (SELECT *, coalesce(mime LIKE 'image/%' OR mime LIKE 'text/%' OR mime LIKE 'audio/%' OR mime = 'application/pdf' OR regexp_matches(mime, 'wordprocessing|spreadsheet|presentation'), false) AS supported,
 CASE WHEN mime LIKE 'text/%' OR regexp_matches(mime, 'spreadsheet|presentation') THEN 'STATIC_PARSE' WHEN mime LIKE 'audio%' THEN 'LLM_PARSE' WHEN acc AND mime = 'application/pdf' AND NOT img AND lnk THEN 'STATIC_PARSE'
 WHEN NOT acc AND mime = 'application/pdf' AND NOT img THEN 'STATIC_PARSE' ELSE 'LLM_PARSE' END AS parser,
 CASE WHEN mime LIKE 'image/%' OR (mime = 'application/pdf' AND img) THEN 'ocr' WHEN mime = 'application/pdf' THEN 'layout' END AS bbox_source
 FROM (SELECT *, {_MIME_CASE} AS mime FROM (SELECT doc_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, doc_id % 2 = 0 AS img, doc_id % 3 = 0 AS lnk, doc_id % 5 = 0 AS acc FROM paths)))"""


@query("q02_routing", duck("SELECT doc_id, mime, supported, parser, bbox_source, CASE WHEN ext IN ('.doc', '.docx') AND parser <> 'STATIC_PARSE' THEN 'as_pdf' WHEN ext IN ('.xlsx', '.pptx') AND parser = 'LLM_PARSE' THEN 'static' ELSE 'as_is' END AS mode FROM routed", "paths", more=_ROUTED))
def q02(spark, d):
    p = inputs.paths(spark, d).withColumn("mime", routing.mime_type(F.col("path")))
    p = p.withColumn("img", F.col("doc_id") % 2 == 0).withColumn("parser", routing.route(F.col("mime"), F.col("img"), F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0))
    return p.select("doc_id", "mime", routing.supported(F.col("mime")).alias("supported"), "parser", routing.box_source(F.col("mime"), F.col("img")).alias("bbox_source"), routing.overrides(routing.extension(F.col("path")), F.col("parser")).alias("mode"))


@query("q02b_url_types", "SELECT page_id, coalesce(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '(\\.[^./]+)$', 1)) IN ('.pdf', '.png', '.jpg', '.jpeg', '.tiff', '.bmp', '.gif'), false) AS supported FROM pages")
def q02b(spark, d):
    return table(spark, d, "pages").select("page_id", routing.supported_url(F.col("url")).alias("supported"))


@query("q02c_tokens", "SELECT doc_id, list_contains(list_transform(string_split(lower(replace(text, ' ', '/')), '/'), lambda x: trim(x, ' ')), 'image') AS has_image, list_contains(list_transform(string_split(lower(replace(text, ' ', '/')), '/'), lambda x: trim(x, ' ')), 'the') AS has_the FROM documents")
def q02c(spark, d):
    raw = F.replace(F.col("text"), F.lit(" "), F.lit("/"))
    return table(spark, d, "documents").select("doc_id", routing.has_token(raw, "image").alias("has_image"), routing.has_token(raw, "the").alias("has_the"))


_RANGES = "ranges AS (SELECT doc_id, s AS start, least(s + 3, n) AS \"end\", printf('split_%04d_%d.pdf', s, least(s + 3, n)) AS name FROM (SELECT doc_id, CAST(ceil(n_chars / 1800.0) AS INTEGER) AS n FROM documents), unnest(range(1, n + 1, 4)) AS u(s))"


def _ranges(spark, d):
    return routing.page_ranges(table(spark, d, "documents").select("doc_id", "n_chars"), F.ceil(F.col("n_chars") / 1800.0)).select("doc_id", "start", "end", "name")


@query("q03_page_ranges", duck('SELECT doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", name FROM ranges', more=_RANGES))
def q03(spark, d):
    return _ranges(spark, d)


@query("q03b_page_selection", "SELECT doc_id, CAST(unnest(list_sort(list_distinct([doc_id % 5 + 1, doc_id % 3 + 1, 1]))) AS INTEGER) AS page FROM documents")
def q03b(spark, d):
    wanted = F.array(*[x.cast("int") for x in (F.col("doc_id") % 5 + 1, F.col("doc_id") % 3 + 1, F.lit(1))])
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_sort(F.array_distinct(wanted))).alias("page"))


@query("q03c_total_pages", duck("SELECT doc_id, sum(CAST(regexp_extract(name, '_(\\d+)\\.', 1) AS BIGINT) - CAST(regexp_extract(name, 'split_(\\d+)', 1) AS BIGINT) + 1) AS pages FROM ranges GROUP BY doc_id", more=_RANGES))
def q03c(spark, d):
    part = lambda rx: F.regexp_extract("name", rx, 1).cast("long")
    return _ranges(spark, d).groupBy("doc_id").agg(F.sum(part(r"_(\d+)\.") - part(r"split_(\d+)") + 1).alias("pages"))


@query("q04_worker_chunks", duck("SELECT doc_id, CAST(rn - 1 AS INTEGER) AS split_no, CAST((rn - 1) // greatest(1, n // 4) AS INTEGER) AS chunk FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM ranges)", more=_RANGES))
def q04(spark, d):
    return routing.worker_chunks(_ranges(spark, d), "doc_id")


_LEVELS = " ".join(f"WHEN len(regexp_extract_all(md, '(?m)^{'#' * k} .*$')) > 1 THEN '{'#' * k}'" for k in range(1, 6))
_PATTERN = f"CASE WHEN len(regexp_extract_all(md, '(?m)^[^\\n]+\\n-+$')) > 1 THEN 'underline' {_LEVELS} ELSE '#' END"


@query("q05_dominant_heading", duck(f"SELECT doc_id, {_PATTERN} AS pattern FROM md_docs", "md_docs"))
def q05(spark, d):
    return inputs.md_docs(spark, d).select("doc_id", text.dominant_heading(F.col("md")).alias("pattern"))


_SEGMENTS = f"""p AS (SELECT doc_id, string_split(md, chr(10)) AS ls, {_PATTERN} AS pattern FROM md_docs),
l AS (SELECT doc_id, pattern, i, ls[i] AS line, starts_with(ls[i], pattern || ' ') AS head FROM p, unnest(range(1, len(ls) + 1)) AS u(i)),
s AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS seg_no FROM l)"""


@query("q06_heading_split", duck("""SELECT doc_id, seg_no, CASE WHEN seg_no = 0 THEN 'Introduction' ELSE max(CASE WHEN head THEN trim(replace(line, pattern, '')) END) END AS heading,
 sha256(regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '^\\s+|\\s+$', '', 'g')) AS content_sha
 FROM (SELECT doc_id, pattern, i, line, head, seg_no FROM s UNION ALL SELECT doc_id, pattern, -1, NULL, NULL, 0 FROM p) GROUP BY doc_id, seg_no""", "md_docs", more=_SEGMENTS))
def q06(spark, d):
    m = inputs.md_docs(spark, d)
    return m.select("doc_id", F.posexplode(text.heading_segments(F.col("md"), text.dominant_heading(F.col("md")))).alias("seg_no", "s")).select("doc_id", "seg_no", "s.heading", F.sha2("s.content", 256).alias("content_sha"))


def _duck_html() -> str:
    out = "html"
    for pattern, new in text.HTML_RULES:
        new = new.replace("$", "\\")
        p = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{p}', " + "'" + new.replace("'", "''").replace("\n", "' || chr(10) || '") + "', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query("q07_html_markdown", f"SELECT page_id, sha256({_duck_html()}) AS markdown_sha FROM pages")
def q07(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.html_to_markdown(F.col("html")), 256).alias("markdown_sha"))


_LINKED = "linked AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '[site](https://a.example/' || doc_id || ') and https://b.example/x' WHEN 1 THEN 'see http://c.example/' || doc_id WHEN 2 THEN '[x](https://a.example/1) [y](https://a.example/1) www' WHEN 3 THEN '[z](docs.example.org/' || doc_id || ')' ELSE 'none' END || ' ' || text AS md FROM documents)"


def _linked(spark, d):
    i = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 5
    lead = F.when(kind == 0, F.concat(F.lit("[site](https://a.example/"), i, F.lit(") and https://b.example/x"))).when(kind == 1, F.concat(F.lit("see http://c.example/"), i)).when(kind == 2, F.lit("[x](https://a.example/1) [y](https://a.example/1) www")).when(kind == 3, F.concat(F.lit("[z](docs.example.org/"), i, F.lit(")"))).otherwise(F.lit("none"))
    return table(spark, d, "documents").select("doc_id", F.concat(lead, F.lit(" "), "text").alias("md"))


@query("q08_urls", duck("SELECT DISTINCT doc_id, url FROM (SELECT doc_id, unnest(regexp_extract_all(md, '\\[([^\\]]+)\\]\\((https?://[^\\s\\)]+)\\)', 2)) AS url FROM linked UNION ALL SELECT doc_id, unnest(regexp_extract_all(md, '(^|[^(])(https?://[^\\s\\)]+)', 2)) FROM linked)", more=_LINKED))
def q08(spark, d):
    return _linked(spark, d).select("doc_id", F.explode(text.urls(F.col("md"))).alias("url"))


@query("q08b_crawl_urls", duck("SELECT doc_id, CASE WHEN u LIKE 'http%' THEN u ELSE 'https://' || u END AS url FROM (SELECT doc_id, unnest(regexp_extract_all(md, '\\]\\(((?:https?://)?[A-Za-z0-9.-]+\\.[a-z]{2,}[^\\s\\)]*)\\)', 1)) AS u FROM linked)", more=_LINKED))
def q08b(spark, d):
    return _linked(spark, d).select("doc_id", F.explode(text.crawl_urls(F.col("md"))).alias("url"))


@query("q09_titles", "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') ELSE 'No title' END || ' - ' || substr(sha256(url), 1, 8) AS full_title FROM pages")
def q09(spark, d):
    return table(spark, d, "pages").select("page_id", text.full_title(F.col("html"), F.col("url")).alias("full_title"))


@query("q10_crawl", duck("SELECT page_id, min(depth) AS min_depth FROM walk GROUP BY page_id", "edges", more="RECURSIVE walk(page_id, depth) AS (SELECT min(page_id), 0 FROM pages UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = page_id WHERE depth < 4)"))
def q10(spark, d):
    roots = table(spark, d, "pages").agg(F.min("page_id").alias("page_id"))
    return crawl.reach(inputs.edges(spark, d), roots, 4)


@query("q10b_visits", duck("SELECT depth, CAST(sum(n) AS BIGINT) AS visits FROM walk GROUP BY depth", "edges", more="RECURSIVE walk(page_id, depth, n) AS (SELECT min(page_id), 0, 1 FROM pages UNION ALL SELECT dst, depth + 1, n FROM walk JOIN edges ON src = page_id WHERE depth < 4)"))
def q10b(spark, d):
    roots = table(spark, d, "pages").agg(F.min("page_id").alias("page_id"))
    return crawl.visits(inputs.edges(spark, d), roots, 4)


@query("q11_email_links", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n_emails FROM documents")
def q11(spark, d):
    linked = text.link_emails(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(linked, F.lit(r"<[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}>")).cast("long").alias("n_emails"))


@query("q12_plain_words", "SELECT doc_id, len(ws) AS n_words, sha256(array_to_string(ws, ' ')) AS words_sha FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '[*_`~]', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM documents)")
def q12(spark, d):
    w = text.words(text.strip_markdown(F.col("text")))
    return table(spark, d, "documents").select("doc_id", w.alias("ws")).select("doc_id", F.size("ws").cast("long").alias("n_words"), F.sha2(F.array_join("ws", " "), 256).alias("words_sha"))


# --- layout


@query("q13_normalised_boxes", duck("SELECT doc_id, page, pos, round(x0 / 612.0, 6) AS x0, round(top / 792.0, 6) AS top, round(x1 / 612.0, 6) AS x1, round(bottom / 792.0, 6) AS bottom FROM layout", "layout"))
def q13(spark, d):
    w = inputs.layout(spark, d)
    boxes = geometry.normalise({k: F.col(k) for k in ("x0", "top", "x1", "bottom")}, F.lit(612.0), F.lit(792.0))
    return w.select("doc_id", "page", "pos", *boxes).select("doc_id", "page", "pos", *[F.round(k, 6).alias(k) for k in ("x0", "top", "x1", "bottom")])


@query("q14_word_boxes", duck("SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(j - 1 AS INTEGER) AS word_no, CAST(floor(1e6 * (length(array_to_string(ws[1 : j - 1], '')) / length(array_to_string(ws, '')))) AS BIGINT) AS x0, CAST(floor(1e6 * (length(array_to_string(ws[1 : j], '')) / length(array_to_string(ws, '')))) AS BIGINT) AS x1 FROM (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS ws FROM lines), unnest(range(1, len(ws) + 1)) AS u(j)", "lines"))
def q14(spark, d):
    return layout.proportional_boxes(inputs.lines(spark, d)).select("doc_id", "line_no", "word_no", F.floor(1e6 * F.col("x0")).alias("x0"), F.floor(1e6 * F.col("x1")).alias("x1"))


@query("q15_merged_boxes", duck("""SELECT doc_id, page, m.x0 AS x0, m.top AS top, m.x1 AS x1, m.bottom AS bottom FROM (SELECT doc_id, page, unnest(list_reduce(list_transform(list({'x0': x0, 'top': top, 'x1': x1, 'bottom': bottom} ORDER BY top, x0, x1, bottom), lambda b: [b]),
 lambda acc, y: CASE WHEN NOT (acc[-1].bottom < y[1].top OR y[1].bottom < acc[-1].top) AND least(abs(y[1].x0 - acc[-1].x1), abs(y[1].x1 - acc[-1].x0)) <= 6
 THEN list_append(acc[: len(acc) - 1], {'x0': acc[-1].x0, 'top': least(acc[-1].top, y[1].top), 'x1': greatest(acc[-1].x1, y[1].x1), 'bottom': greatest(acc[-1].bottom, y[1].bottom)}) ELSE list_append(acc, y[1]) END)) AS m FROM layout WHERE pos % 3 < 2 GROUP BY doc_id, page)""", "layout"))
def q15(spark, d):
    w = inputs.layout(spark, d).where("pos % 3 < 2")
    g = w.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x0", "top", "x1", "bottom")).alias("b"))
    return g.select("doc_id", "page", F.explode(geometry.merge_boxes(F.col("b"), 6.0)).alias("m")).select("doc_id", "page", "m.*")


_MODES = """c AS (SELECT doc_id, page, size, count(*) AS n FROM layout GROUP BY ALL), st AS (SELECT *, coalesce(abs(top - lag(top) OVER (PARTITION BY doc_id, page ORDER BY pos)) > 5, true) AS starts FROM layout),
l AS (SELECT doc_id, page, x0, count(*) AS n FROM st WHERE starts GROUP BY ALL),
modes AS (SELECT doc_id, page, body_size, base_left FROM (SELECT doc_id, page, size AS body_size FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, size) = 1) JOIN (SELECT doc_id, page, x0 AS base_left FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY n DESC, x0) = 1) USING (doc_id, page))"""


@query("q16_page_modes", duck("SELECT doc_id, page, body_size, base_left FROM modes", "layout", more=_MODES))
def q16(spark, d):
    return layout.page_modes(inputs.layout(spark, d)).select("doc_id", "page", "body_size", "base_left")


@query("q17_heading_levels", duck("SELECT doc_id, page, pos, CASE WHEN size / body_size >= 2 THEN 1 WHEN size / body_size >= 1.4 THEN 2 WHEN size / body_size >= 1.2 THEN 3 END AS level, CASE WHEN x0 - base_left < 5 THEN 0 ELSE CAST(floor((x0 - base_left) / 25) + 1 AS INTEGER) END AS indent FROM layout JOIN modes USING (doc_id, page)", "layout", more=_MODES))
def q17(spark, d):
    w = inputs.layout(spark, d)
    j = w.join(layout.page_modes(w), ["doc_id", "page"])
    return j.select("doc_id", "page", "pos", text.heading_level(F.col("size"), F.col("body_size")).alias("level"), text.indent_level(F.col("x0"), F.col("base_left")).alias("indent"))


@query("q19_blocks", duck("""SELECT doc_id, page, block_no, CASE WHEN lv IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, sha256(replace(replace(replace(CASE WHEN lv IS NULL THEN '' ELSE repeat('#', lv) || ' ' END || CASE WHEN mono THEN '```' || chr(10) || plain || chr(10) || '```' || chr(10) || chr(10) ELSE shown || chr(10) || chr(10) END, '** **', ' '), '* *', ' '), '` `', ' ')) AS text_sha FROM (
 SELECT doc_id, page, CAST(g AS INTEGER) AS block_no, min(level) AS lv, bool_and(fontname = 'Mono') AS mono, string_agg(text, ' ' ORDER BY pos) AS plain, string_agg(shown, ' ' ORDER BY pos) AS shown FROM (
 SELECT *, CASE WHEN new_line AND level IS NULL THEN repeat('&nbsp;', 3 * CASE WHEN x0 - base_left < 5 THEN 0 ELSE CAST(floor((x0 - base_left) / 25) + 1 AS INTEGER) END) || ' ' ELSE '' END || CASE fontname WHEN 'Mono' THEN '`' || text || '`' WHEN 'Serif-Bold' THEN '**' || text || '**' WHEN 'Serif-Italic' THEN '*' || text || '*' ELSE text END AS shown,
 sum(opens) OVER (PARTITION BY doc_id, page ORDER BY pos) AS g FROM (
 SELECT *, CASE WHEN rn = 1 OR new_line OR (level IS NOT NULL) <> prev THEN 1 ELSE 0 END AS opens FROM (
 SELECT *, row_number() OVER w AS rn, coalesce(abs(top - lag(top) OVER w) > 5, false) AS new_line, lag(level IS NOT NULL) OVER w AS prev FROM (
 SELECT *, CASE WHEN size / body_size >= 2 THEN 1 WHEN size / body_size >= 1.4 THEN 2 WHEN size / body_size >= 1.2 THEN 3 END AS level FROM layout JOIN modes USING (doc_id, page)) WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)))) GROUP BY doc_id, page, g)""", "layout", more=_MODES))
def q19(spark, d):
    w = inputs.layout(spark, d)
    return layout.blocks(w, layout.page_modes(w)).select("doc_id", "page", "block_no", "kind", F.sha2("markdown", 256).alias("text_sha"))


_PAGES = "pg AS (SELECT DISTINCT doc_id, page FROM layout)"


def _pages(w):
    return w.select("doc_id", "page").distinct()


@query("q20_struck_words", duck("SELECT doc_id, page, pos, repeat('~~', n) || text || repeat('~~', n) AS text FROM (SELECT doc_id, page, pos, CAST(count(*) AS INTEGER) AS n FROM (SELECT r.doc_id, r.page, r.k, min(pos) AS pos FROM layout w JOIN rules r ON w.doc_id = r.doc_id AND w.page = r.page AND w.x0 <= r.x1 AND w.x1 >= r.x0 AND w.top <= r.bottom AND w.bottom >= r.top GROUP BY ALL) GROUP BY ALL) JOIN layout USING (doc_id, page, pos)", "layout", more=_PAGES + ", rules AS (SELECT doc_id, page, 1 AS k, 90.0 AS x0, 300.0 AS x1, 78.0 AS top, 78.05 AS bottom FROM pg UNION ALL SELECT doc_id, page, 2, 90.0, 300.0, 104.0, 106.0 FROM pg)"))
def q20(spark, d):
    w = inputs.layout(spark, d)
    rule = lambda k, t, b: _pages(w).select("doc_id", "page", F.lit(k).alias("zone_no"), F.lit(90.0).alias("x0"), F.lit(300.0).alias("x1"), F.lit(t).alias("top"), F.lit(b).alias("bottom"))
    return layout.struck(w, layout.rules_of(rule(1, 78.0, 78.05).unionByName(rule(2, 104.0, 106.0))))


_ZONES = _PAGES + ", z AS (SELECT doc_id, page, CAST(r * 3 + c AS INTEGER) AS zone_no, 72.0 + 100 * c AS x0, 172.0 + 100 * c AS x1, 100.0 + 40 * r AS top, 140.0 + 40 * r AS bottom FROM pg, unnest(range(3)) AS a(r), unnest(range(3)) AS b(c))"


def _zones(w):
    g = _pages(w).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return g.select("doc_id", "page", (F.col("r") * 3 + F.col("c")).alias("zone_no"), (72.0 + 100 * F.col("c")).alias("x0"), (172.0 + 100 * F.col("c")).alias("x1"), (100.0 + 40 * F.col("r")).alias("top"), (140.0 + 40 * F.col("r")).alias("bottom"))


_TOUCH = "w.doc_id = z.doc_id AND w.page = z.page AND w.x0 <= z.x1 AND w.x1 >= z.x0 AND w.top <= z.bottom AND w.bottom >= z.top"


@query("q21_words_in_cells", duck(f"SELECT w.doc_id, w.page, z.zone_no, w.pos, w.text FROM layout w JOIN z ON {_TOUCH}", "layout", more=_ZONES))
def q21(spark, d):
    w = inputs.layout(spark, d)
    return layout.words_in(w, _zones(w))


@query("q21b_words_outside", duck(f"SELECT doc_id, page, pos FROM layout w WHERE NOT EXISTS (SELECT 1 FROM z WHERE {_TOUCH})", "layout", more=_ZONES))
def q21b(spark, d):
    w = inputs.layout(spark, d)
    return layout.words_outside(w, _zones(w)).select("doc_id", "page", "pos")


@query("q22_link_spans", duck("SELECT w.doc_id, w.page, uri, min(pos) AS first_pos, max(pos) AS last_pos FROM layout w JOIN k ON w.doc_id = k.doc_id AND w.page = k.page AND w.x0 BETWEEN 99 AND 251 AND w.top BETWEEN 113 AND 129 GROUP BY ALL", "layout", more=_PAGES + ", k AS (SELECT doc_id, page, 'https://x.example/' || doc_id AS uri FROM pg)"))
def q22(spark, d):
    w = inputs.layout(spark, d)
    k = _pages(w).select("doc_id", "page", F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("uri"), F.lit(100.0).alias("x0"), F.lit(250.0).alias("x1"), F.lit(114.0).alias("top"), F.lit(128.0).alias("bottom"))
    return layout.link_spans(w, k)


@query("q22b_spliced_links")
def q22b(spark, d):
    """Five links a page, where its text is long enough: SQL can't follow the spans as they grow and meet."""
    p = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    first = F.transform(F.array(*map(F.lit, (0, 40, 46, 300, 2000))), lambda x: x + (F.col("doc_id") % 13).cast("int"))
    links = p.select("doc_id", "page", F.length("text").alias("n"), F.posexplode(first).alias("k", "first")).where("first + 3 <= n")
    links = links.select("doc_id", "page", "first", (F.col("first") + 3).alias("end"), F.concat(F.lit("u"), F.col("k").cast("string")).alias("uri"))
    return layout.splice_links(p, links).select("doc_id", "page", F.sha2("text", 256).alias("text_sha"))


@query("q22c_text_under", duck("SELECT doc_id, page, 1 AS field_no, string_agg(text, ' ' ORDER BY top, x0) AS text FROM layout WHERE least(x1, 260.0) > greatest(x0, 120.0) AND least(bottom, 110.0) > greatest(top, 80.0) GROUP BY doc_id, page", "layout"))
def q22c(spark, d):
    w = inputs.layout(spark, d)
    return layout.text_under(w, _pages(w).select("doc_id", "page", F.lit(1).alias("field_no"), F.lit(120.0).alias("x0"), F.lit(260.0).alias("x1"), F.lit(80.0).alias("top"), F.lit(110.0).alias("bottom")))


# --- matching


@query("q23_occurrence_join", duck("SELECT c.doc_id, c.page, c.pos, b.pos AS box_pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, text ORDER BY pos) AS k FROM layout) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, page, text ORDER BY pos) AS k FROM layout WHERE pos % 4 <> 1) b USING (doc_id, page, text, k)", "layout"))
def q23(spark, d):
    w = inputs.layout(spark, d).select("doc_id", "page", "pos", "text")
    return match.by_occurrence(w, w.where("pos % 4 <> 1"), ["doc_id", "page"]).select("doc_id", "page", "pos", "box_pos")


@query("q24_greedy_nearest")
def q24(spark, d):
    w = inputs.layout(spark, d).select("doc_id", "page", "pos", "text")
    worn = w.withColumn("text", F.when(F.col("pos") % 10 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return match.greedy_nearest(worn, w, ["doc_id", "page"])


@query("q25_exact_windows", duck("SELECT doc_id, CAST(i AS INTEGER) AS start FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> '') AS ws FROM documents), unnest(range(len(ws) - 2)) AS u(i) WHERE len(ws) >= 5 AND ws[i + 1 : i + 3] = ws[3 : 5]"))
def q25(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "[ \t\n]+"), lambda w: w != "").alias("ws")).where(F.size("ws") >= 5)
    return match.windows(t.withColumn("needle", F.slice("ws", 3, 3)), "ws", "needle").select("doc_id", "start")


@query("q26_fuzzy_windows")
def q26(spark, d):
    split = F.filter(F.split("text", "[ \t\n]+"), lambda w: w != "")
    items = table(spark, d, "benchmark").select("item_id", F.slice(split, 1, 4).alias("words")).where(F.size("words") == 4)
    return match.fuzzy_windows(items, table(spark, d, "documents").select("doc_id", split.alias("words")))


# --- usage and cost

_USAGE = "usage AS (SELECT conv_id, coalesce(sum(input) FILTER (parser = 'LLM_PARSE'), 0)::BIGINT AS input, coalesce(sum(output) FILTER (parser = 'LLM_PARSE'), 0)::BIGINT AS output, count(*) FILTER (parser = 'LLM_PARSE') AS llm_pages FROM calls GROUP BY conv_id)"


@query("q27_document_usage", duck("SELECT conv_id, input, output, input + output AS total, llm_pages FROM usage", "calls", more=_USAGE))
def q27(spark, d):
    return usage.document_usage(inputs.calls(spark, d), "conv_id")


@query("q27b_positional_boxes", duck("SELECT conv_id, turn, page AS box_page FROM calls LEFT JOIN (SELECT doc_id AS conv_id, page - 1 AS turn, page FROM layout GROUP BY ALL) USING (conv_id, turn)", "calls", "layout"))
def q27b(spark, d):
    boxes = _pages(inputs.layout(spark, d)).select(F.col("doc_id").alias("conv_id"), (F.col("page") - 1).cast("long").alias("turn"), F.col("page").alias("box_page"))
    return inputs.calls(spark, d).join(boxes, ["conv_id", "turn"], "left").select("conv_id", "turn", "box_page")


@query("q28_costs", duck("SELECT model_no, round(input * ir / 1e6, 9) AS cost_input, round(llm_pages * CAST(mr AS DOUBLE), 9) AS cost_image, round(output * orr / 1e6, 9) AS cost_output, round(input * ir / 1e6 + llm_pages * mr + output * orr / 1e6, 9) AS cost_total FROM (SELECT model_no, coalesce(sum(input) FILTER (parser = 'LLM_PARSE'), 0) AS input, coalesce(sum(output) FILTER (parser = 'LLM_PARSE'), 0) AS output, count(*) FILTER (parser = 'LLM_PARSE') AS llm_pages FROM calls GROUP BY model_no) LEFT JOIN (VALUES (0, 1e-1, 4e-1, 1e-3), (1, 125e-2, 1e1, 2e-3), (2, 3e0, 15e0, 0e0)) r(model_no, ir, orr, mr) USING (model_no)", "calls"))
def q28(spark, d):
    rates = spark.createDataFrame([(0, 0.1, 0.4, 0.001), (1, 1.25, 10.0, 0.002), (2, 3.0, 15.0, 0.0)], "model_no long, input_rate double, output_rate double, image_rate double")
    got = usage.cost(usage.document_usage(inputs.calls(spark, d), "model_no"), rates, "model_no")
    return got.select("model_no", *[F.round(c, 9).alias(c) for c in ("cost_input", "cost_image", "cost_output", "cost_total")])


# --- tables

_CELLS = "cells AS (SELECT n_regionkey AS table_id, CAST(rn AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS col, CASE c WHEN 0 THEN n_name WHEN 1 THEN CAST(n_nationkey AS VARCHAR) WHEN 2 THEN '' ELSE n_name || chr(10) || 'x' END AS text FROM (SELECT *, 2 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 2 AS rn FROM nation), unnest(range(4)) AS u(c) UNION ALL SELECT r_regionkey, 1, CAST(c AS INTEGER), '' FROM region, unnest(range(4)) AS u(c))"
_CLEAN = "clean AS (SELECT table_id, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY \"row\") - 1 AS INTEGER) AS \"row\", CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY col) - 1 AS INTEGER) AS col, text FROM cells JOIN (SELECT table_id, \"row\" FROM cells GROUP BY ALL HAVING bool_or(text <> '')) USING (table_id, \"row\") JOIN (SELECT table_id, col FROM cells GROUP BY ALL HAVING bool_or(text <> '')) USING (table_id, col))"
_HEADED = "headed AS (SELECT table_id, \"row\", col, \"row\" = 0 AS is_header, CASE WHEN \"row\" = 0 THEN text ELSE replace(text, chr(10), '<br>') END AS text FROM clean)"


def _cells(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation").withColumn("row", (2 * F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 2).cast("int"))
    c = n.select(F.col("n_regionkey").alias("table_id"), "row", F.posexplode(F.array("n_name", F.col("n_nationkey").cast("string"), F.lit(""), F.concat("n_name", F.lit("\nx")))).alias("col", "text"))
    blank = table(spark, d, "region").select(F.col("r_regionkey").alias("table_id"), F.lit(1).alias("row"), F.posexplode(F.array_repeat(F.lit(""), 4)).alias("col", "text"))
    return c.unionByName(blank)


@query("q30_clean_cells", duck("SELECT table_id, \"row\", col, is_header, text FROM headed", more=f"{_CELLS}, {_CLEAN}, {_HEADED}"))
def q30(spark, d):
    return tables.promote_header(tables.drop_empty(_cells(spark, d))).select("table_id", "row", "col", "is_header", "text")


@query("q29_markdown_tables", duck("""SELECT table_id, string_agg(s, chr(10) ORDER BY "row") AS markdown FROM (SELECT table_id, "row", '|' || string_agg(' ' || CASE WHEN r THEN lpad(text, w, ' ') ELSE rpad(text, w, ' ') END || ' ', '|' ORDER BY col) || '|' || CASE WHEN "row" = 0 THEN chr(10) || '|' || string_agg(CASE WHEN r THEN repeat('-', w + 1) || ':' ELSE ':' || repeat('-', w + 1) END, '|' ORDER BY col) || '|' ELSE '' END AS s
 FROM (SELECT *, CAST(greatest(3, max(length(text)) OVER (PARTITION BY table_id, col)) AS INTEGER) AS w, bool_and("row" = 0 OR regexp_matches(text, '^[+-]?\\d+(\\.\\d+)?$')) OVER (PARTITION BY table_id, col) AS r FROM headed) GROUP BY table_id, "row") GROUP BY table_id""", more=f"{_CELLS}, {_CLEAN}, {_HEADED}"))
def q29(spark, d):
    return tables.to_markdown(tables.promote_header(tables.drop_empty(_cells(spark, d))))


@query("q31_doctags", duck("SELECT doc_id, CAST(line_no AS INTEGER) AS block_no, CASE WHEN line_no % 3 = 0 THEN '## ' || t WHEN line_no % 3 = 1 THEN t ELSE '| ' || t || ' | ' || line_no || ' |' || chr(10) || '|---|---|' END AS markdown FROM (SELECT doc_id, line_no, CASE WHEN length(regexp_replace(line, '[^A-Za-z ]', '', 'g')) = 0 OR trim(regexp_replace(line, '[^A-Za-z ]', '', 'g')) = '' THEN 'x' ELSE trim(regexp_replace(line, '[^A-Za-z ]', '', 'g')) END AS t FROM lines)", "lines"))
def q31(spark, d):
    t = F.trim(F.regexp_replace("line", "[^A-Za-z ]", ""))
    t = F.when(t == "", F.lit("x")).otherwise(t)
    loc = F.lit("<loc_10><loc_20><loc_250><loc_500>")
    tag = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("<section_header_level_2>"), loc, t, F.lit("</section_header_level_2>"))).when(F.col("line_no") % 3 == 1, F.concat(F.lit("<text>"), loc, t, F.lit("</text>"))).otherwise(F.concat(F.lit("<otsl>"), loc, F.lit("<fcel>"), t, F.lit("<fcel>"), F.col("line_no").cast("string"), F.lit("<nl></otsl>")))
    g = inputs.lines(spark, d).select("doc_id", "line_no", tag.alias("tag")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "tag"))), lambda x: x["tag"]), "").alias("tags"))
    return doctags.to_markdown(g).select("doc_id", "block_no", "markdown")


# --- replies and TeX


@query("q32_reply_pages", "SELECT conv_id, turn, CAST(i AS INTEGER) AS page, sha256(regexp_replace(ps[i], '^\\s+|\\s+$', '', 'g')) AS content_sha FROM (SELECT conv_id, turn, string_split(text || '<page-break> second ' || conv_id, '<page-break>') AS ps FROM conversations), unnest(range(1, len(ps) + 1)) AS u(i)")
def q32(spark, d):
    body = F.concat("text", F.lit("<page-break> second "), F.col("conv_id").cast("string"))
    k = F.col("conv_id") % 4
    wrapped = F.when(k == 0, F.concat(F.lit("note <output>"), body, F.lit("</output> end"))).when(k == 1, F.concat(F.lit("<output>"), body)).when(k == 2, F.concat(body, F.lit("</output> end"))).otherwise(body)
    got = pages.reply_pages(table(spark, d, "conversations").select("conv_id", "turn", wrapped.alias("text")))
    return got.select("conv_id", "turn", "page", F.sha2("content", 256).alias("content_sha"))


_FAULTS = "f AS (SELECT *, (conv_id + page - 1) % 9 AS fault FROM tex_pages)"


@query("q33_fields", duck("SELECT conv_id, page, CASE WHEN fault IN (1, 6) THEN NULL ELSE id END AS id, CASE WHEN fault IN (1, 6) THEN NULL ELSE label END AS label, CASE WHEN fault IN (1, 6) THEN NULL ELSE v END AS value FROM (SELECT conv_id, page, fault, printf('LEX-P%04d-V0001', CASE WHEN fault = 2 THEN page + 1 ELSE page END) AS id, 'Item ' || conv_id AS label, value AS v FROM f UNION ALL SELECT conv_id, page, fault, 'VALUE_002', '', 'extra' FROM f WHERE fault = 5)", "tex_pages", more=_FAULTS))
def q33(spark, d):
    return pages.extract_fields(inputs.tex_pages(spark, d)).select("conv_id", "page", "id", "label", "value")


@query("q33b_round_trip", duck("SELECT conv_id, page, CASE WHEN fault IN (1, 6) THEN NULL ELSE sha256(tex) END AS filled_sha FROM f", "tex_pages", more=_FAULTS))
def q33b(spark, d):
    return pages.round_trip(inputs.tex_pages(spark, d)).select("conv_id", "page", F.sha2("filled", 256).alias("filled_sha"))


@query("q34_page_roles", duck("SELECT conv_id, page, printf('LEX-P%04d-V%04d', page, 1) AS value_id, CASE WHEN page = 1 THEN 'first' WHEN page = total THEN 'last' ELSE 'middle' END AS role FROM tex_pages", "tex_pages"))
def q34(spark, d):
    t = inputs.tex_pages(spark, d)
    return t.select("conv_id", "page", F.format_string("LEX-P%04d-V%04d", "page", F.lit(1)).alias("value_id"), F.when(F.col("page") == 1, "first").when(F.col("page") == F.col("total"), "last").otherwise("middle").alias("role"))


@query("q35_page_rules", duck("SELECT conv_id, page, CASE fault WHEN 6 THEN 'empty' WHEN 1 THEN 'duplicate_id' WHEN 2 THEN 'foreign_page' WHEN 7 THEN 'marker' WHEN 4 THEN 'checkbox_glyph' WHEN 3 THEN 'numbered_section' WHEN 5 THEN 'field_count' END AS violation FROM f", "tex_pages", more=_FAULTS))
def q35(spark, d):
    t = inputs.tex_pages(spark, d)
    return t.select("conv_id", "page", latex.first_violation(F.col("tex"), F.col("page"), F.col("total")).alias("violation"))


@query("q35b_field_metadata", duck("SELECT conv_id, page, id, suffix, page % 2 = 0 OR suffix IS NOT NULL AS known FROM (SELECT conv_id, page, unnest(regexp_extract_all(tex, '(?m)% #VALUE_ID:[ \\t]*([A-Za-z0-9][A-Za-z0-9_-]*)[ \\t]*$', 1)) AS id FROM tex_pages) LEFT JOIN (SELECT 'V0001' AS suffix) m ON split_part(id, '-', 3) = m.suffix", "tex_pages"))
def q35b(spark, d):
    t = inputs.tex_pages(spark, d).select("conv_id", "page", F.explode(latex.value_ids(F.col("tex"))).alias("id"))
    meta = spark.createDataFrame([("V0001",)], "suffix string")
    j = t.join(meta, F.substring_index("id", "-", -1) == F.col("suffix"), "left")
    return j.select("conv_id", "page", "id", "suffix", ((F.col("page") % 2 == 0) | F.col("suffix").isNotNull()).alias("known"))


@query("q36_value_mismatch", duck("SELECT conv_id, page, CASE WHEN page % 3 = 0 AND value <> '' THEN 'accept_tex' ELSE 'equal' END AS outcome FROM f WHERE fault NOT IN (1, 6)", "tex_pages", more=_FAULTS))
def q36(spark, d):
    key = F.pandas_udf(text.visible_key, "string")
    t = inputs.tex_pages(spark, d)
    got = pages.extract_fields(t).where("error is null and id like 'LEX%'").select("conv_id", "page", F.col("value").alias("tex_value"))
    seen = t.select("conv_id", "page", F.when((F.col("page") % 3 == 0) & (F.col("value") != ""), F.concat("value", F.lit("?"))).otherwise(F.upper(F.concat(F.lit(" "), "value"))).alias("guess"))
    j = got.join(seen, ["conv_id", "page"])
    return j.select("conv_id", "page", F.when(key("tex_value") == key("guess"), "equal").otherwise("accept_tex").alias("outcome"))


@query("q37_adjacent_tables", "SELECT conv_id, turn, turn % 3 = 0 AS adjacent FROM conversations")
def q37(spark, d):
    one, k = "\\begin{tabularx}{a}\\end{tabularx}", F.col("turn") % 3
    tex = F.when(k == 0, F.lit(f"{one}\n% note\n{one}")).when(k == 1, F.lit(f"{one}\n\n{one}")).otherwise(F.lit(f"{one} text {one}"))
    return table(spark, d, "conversations").select("conv_id", "turn", latex.adjacent_tables(tex).alias("adjacent"))


@query("q37b_escaped_tex", "SELECT conv_id, turn, sha256(" + "list_reduce(list_transform(string_split(text, ''), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.TEX_ESCAPES.items()) + " ELSE c END), lambda a, b: a || b)) AS escaped_sha FROM conversations WHERE text <> ''")
def q37b(spark, d):
    return table(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", F.sha2(text.escape_tex(F.col("text")), 256).alias("escaped_sha"))


@query("q38_crossing_rows", duck("SELECT doc_id, page, id_left, id_right FROM (SELECT a.doc_id, a.page, CAST(a.pos AS VARCHAR) AS id_left, CAST(b.pos AS VARCHAR) AS id_right, row_number() OVER (PARTITION BY a.doc_id, a.page ORDER BY a.pos, b.pos) AS rn FROM fl a JOIN fl b ON a.doc_id = b.doc_id AND a.page = b.page AND a.table_no = b.table_no AND a.pos < b.pos AND a.r <> b.r AND greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)) / least(a.bottom - a.top, b.bottom - b.top) >= 0.65) WHERE rn = 1", "layout", more="fl AS (SELECT doc_id, page, pos, line % 2 AS table_no, pos % 5 AS r, top, bottom FROM layout)"))
def q38(spark, d):
    w = inputs.layout(spark, d)
    f = w.select("doc_id", "page", (F.col("line") % 2).alias("table_no"), F.col("pos").cast("string").alias("field_id"), "pos", (F.col("pos") % 5).alias("row"), "top", "bottom")
    return layout.crossing_rows(f)


@query("q39_budgeted_blocks", duck("SELECT doc_id, page, CAST(count(*) FILTER (total + 60 <= 3000 OR s + 60 + 17 <= 3000) AS INTEGER) AS kept, bool_or(total + 60 > 3000) AS truncated FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, page ORDER BY top, x0, pos ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY doc_id, page) AS total FROM (SELECT *, length(text) + 2 + CASE WHEN row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, pos) > 1 THEN 1 ELSE 0 END AS n FROM layout)) GROUP BY doc_id, page", "layout"))
def q39(spark, d):
    w = inputs.layout(spark, d).withColumn("encoded", F.concat(F.lit('"'), "text", F.lit('"')))
    return pages.within_budget(w, ["doc_id", "page"], 3000, 60)


@query("q40_token_budget", "SELECT doc_id, CAST(least(8192, greatest(2048, 2048 + 2 * n_chars + 500 * (doc_id % 3) + 100 * (doc_id % 7) + 50 * (doc_id % 2))) AS BIGINT) AS budget FROM documents")
def q40(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", pages.token_budget(F.col("n_chars"), i % 7, i % 2, i % 3).cast("long").alias("budget"))


# --- cache, resume, delivery

_CONFIG = {"max_page_attempts": 2, "reasoning_effort": None, "render_dpi": 240, "ocr": "paddle"}
_KEY = "k AS (SELECT doc_id, n_chars, sha256('{\"config\":{\"ocr\":\"paddle\",\"render_dpi\":240},\"model\":\"m' || doc_id % 3 || '\",\"pdf_sha256\":\"' || sha256(text) || '\",\"prompt\":\"p1\",\"versions\":{\"a\":\"1\",\"b\":\"2\"}}') AS cache_key FROM documents)"


def _keys(spark, d):
    model = F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))
    key = pages.cache_key(F.sha2("text", 256), _CONFIG, {"b": "2", "a": "1"}, "p1", model)
    return table(spark, d, "documents").select("doc_id", "n_chars", key.alias("cache_key"))


@query("q41_cache_keys", duck("SELECT doc_id, cache_key FROM k", more=_KEY))
def q41(spark, d):
    return _keys(spark, d).select("doc_id", "cache_key")


@query("q42_page_status", duck("SELECT p.doc_id, CAST(p.page AS INTEGER) AS page, CASE WHEN (p.doc_id + p.page) % 3 = 0 AND p.page % 4 <> 3 AND p.page % 5 <> 4 THEN 'cached' ELSE 'todo' END AS status FROM (SELECT doc_id, unnest(range(1, CAST(ceil(n_chars / 1800.0) AS INTEGER) + 1)) AS page FROM k) p", more=_KEY))
def q42(spark, d):
    p = _keys(spark, d).where("n_chars > 0").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("cache_key"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("n_chars") / 1800.0).cast("int"))).alias("page"))
    cache = p.where((F.col("doc_id") + F.col("page")) % 3 == 0).select("cache_key", "page", F.when(F.col("page") % 4 == 3, F.lit("")).otherwise(F.lit("draft")).alias("draft"), (F.col("page") % 5 == 4).alias("fallback"))
    return pages.page_status(p, cache)


@query("q42b_adapters", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ocr,tables' WHEN 1 THEN 'ocr,tables,vision' ELSE 'tables,ocr' END AS adapters FROM documents")
def q42b(spark, d):
    k = F.col("doc_id") % 3
    a = F.when(k == 2, F.array(F.lit("tables"), F.lit("ocr"))).otherwise(F.array(F.lit("ocr"), F.lit("tables")))
    b = F.when(k == 1, F.array(F.lit("ocr"), F.lit("vision"))).otherwise(F.array(F.lit("ocr")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.concat(a, b)), ",").alias("adapters"))


@query("q43_checkpoints", duck("SELECT conv_id, max_by(CASE WHEN fault = 7 THEN page + 1 ELSE page END, page) AS last_page, max(total) AS total FROM f WHERE fault <> 6 GROUP BY conv_id", "tex_pages", more=_FAULTS))
def q43(spark, d):
    whole = pages.assemble(inputs.tex_pages(spark, d), "conv_id")
    last = latex.last_marker(F.col("tex"))
    return whole.select("conv_id", last.alias("m")).where("m is not null").select("conv_id", F.col("m.page").alias("last_page"), "m.total")


@query("q43b_assembled", duck("SELECT conv_id, sha256(string_agg(tex, chr(10) ORDER BY page) || chr(10) || '\\end{document}') AS assembled_sha FROM tex_pages GROUP BY conv_id", "tex_pages"))
def q43b(spark, d):
    return pages.assemble(inputs.tex_pages(spark, d), "conv_id").select("conv_id", F.sha2("tex", 256).alias("assembled_sha"))


@query("q43c_salvaged", duck("SELECT conv_id, page, CASE WHEN fault = 6 OR page = 1 THEN NULL ELSE sha256('\\newpage' || chr(10) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tex, '(?m)% #VALUE_ID:[ \\t]*([A-Za-z0-9][A-Za-z0-9_-]*)[ \\t]*$', '', 'g'), '^\\s+', ''), '\\n[ \\t]*(?:\\n[ \\t]*)+(% #(?:VALUE_ID|FIELD_VALUE|(?:TODO )?#?HANDWRITTEN))', chr(10) || '\\1', 'g'), '% PAGE_COMPLETED: (\\d+)/(\\d+)', '', 'g'), '\\s+$', '') || chr(10) || '% PAGE_COMPLETED: ' || page || '/' || total) END AS kept_sha FROM f", "tex_pages", more=_FAULTS))
def q43c(spark, d):
    t = inputs.tex_pages(spark, d)
    return t.select("conv_id", "page", F.sha2(latex.salvage(F.col("tex"), F.col("page"), F.col("total")), 256).alias("kept_sha"))


_DONE = "done AS (SELECT conv_id, page, total FROM tex_pages WHERE (conv_id + page) % 6 <> 0)"


def _done(spark, d):
    return inputs.tex_pages(spark, d).where((F.col("conv_id") + F.col("page")) % 6 != 0)


@query("q44_delivered", duck("SELECT conv_id, page FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) AS rn FROM done) WHERE page = rn", "tex_pages", more=_DONE))
def q44(spark, d):
    return pages.deliverable(_done(spark, d), "conv_id").select("conv_id", "page")


@query("q45_first_missing", duck("SELECT conv_id, min(page) FILTER (NOT EXISTS (SELECT 1 FROM done x WHERE x.conv_id = t.conv_id AND x.page = t.page)) AS first_missing FROM tex_pages t GROUP BY conv_id", "tex_pages", more=_DONE))
def q45(spark, d):
    totals = inputs.tex_pages(spark, d).groupBy("conv_id").agg(F.max("total").alias("total"))
    return pages.first_missing(_done(spark, d), totals, "conv_id")


@query("q46_gate", duck("SELECT user_id, lim AS final_limit FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1", "outcomes", more="RECURSIVE o AS MATERIALIZED (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM outcomes), fold(user_id, n, lim, run) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 4, 0 FROM o UNION ALL SELECT f.user_id, o.rn, CASE WHEN status = 429 THEN greatest(1, lim // 2) WHEN run + 1 >= 8 THEN least(32, lim + 1) ELSE lim END, CASE WHEN status = 429 OR run + 1 >= 8 THEN 0 ELSE run + 1 END FROM fold f JOIN o ON o.user_id = f.user_id AND o.rn = f.n + 1)"))
def q46(spark, d):
    return gate.final_limits(inputs.outcomes(spark, d))


_NAMES = ("ConnectionError", "ReadTimeout", "RateLimitError", "ValueError", "KeyError", "ModelUnavailableError")
_FAILS = "x AS (SELECT event_id, (['ConnectionError', 'ReadTimeout', 'RateLimitError', 'ValueError', 'KeyError', 'ModelUnavailableError'])[event_id % 6 + 1] AS name, ([401, 403, 404, 408, 429, 500, 503, NULL])[(event_id // 6) % 8 + 1] AS status, (event_id // 48) % 2 AS attempt, event_id % 5 = 0 AS fb FROM events), y AS (SELECT *, lower(name) LIKE '%connection%' OR lower(name) LIKE '%timeout%' OR lower(name) IN ('ratelimiterror', 'modelunavailableerror') OR coalesce(status IN (401, 403, 408, 429) OR status >= 500, false) AS service FROM x)"


def _fails(spark, d):
    i = F.col("event_id")
    statuses = F.array(*[F.lit(x).cast("int") for x in (401, 403, 404, 408, 429, 500, 503, None)])
    return table(spark, d, "events").select("event_id", F.get(F.array(*map(F.lit, _NAMES)), (i % 6).cast("int")).alias("name"), F.get(statuses, (F.floor(i / 6) % 8).cast("int")).alias("status"), (F.floor(i / 48) % 2).alias("attempt"), (i % 5 == 0).alias("fb"))


@query("q47_failures", duck("SELECT event_id, service FROM y", more=_FAILS))
def q47(spark, d):
    return _fails(spark, d).select("event_id", routing.service_failure(F.col("name"), F.col("status")).alias("service"))


@query("q48_next_steps", duck("SELECT event_id, CASE WHEN (name = 'ValueError' OR service OR coalesce(status IN (500, 503, 429, 408), false)) AND attempt + 1 < 2 AND NOT coalesce(status IN (401, 403), false) AND NOT (event_id % 7 = 0 AND fb) THEN 'retry' WHEN service THEN 'pause_document' WHEN fb THEN 'use_tex' ELSE 'fallback_page' END AS action FROM y", more=_FAILS))
def q48(spark, d):
    step = routing.next_step(F.col("name"), F.col("status"), F.col("name") == "ValueError", F.col("fb"), F.col("event_id") % 7 == 0, F.col("attempt"))
    return _fails(spark, d).select("event_id", step.alias("action"))


@query("q49_call_log", duck("SELECT n * 1000000 + user_id AS call_id, max(s) FILTER (k = 1) - max(s) FILTER (k = 0) AS seconds, CAST(0 AS BIGINT) AS retries, sum(v) FILTER (k = 1) AS usage FROM (SELECT user_id, (rn - 1) // 2 AS n, (rn - 1) % 2 AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE WHEN event_type = 'click' THEN NULL ELSE event_id END AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)) GROUP BY user_id, n"))
def q49(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    first = F.col("rn") % 2 == 0
    e = e.select((F.floor(F.col("rn") / 2) * 1000000 + F.col("user_id")).alias("call_id"), F.when(first, "start").otherwise("finish").alias("event"), F.unix_timestamp("ts").alias("at"), F.lit(1).cast("long").alias("attempt"), F.when(~first & (F.col("event_type") != "click"), F.col("event_id")).alias("usage"))
    return usage.pair_calls(e)


_SPANS = "t AS (SELECT c_custkey AS table_id, CAST(2 + c_custkey % 3 AS INTEGER) AS n_rows, CAST(2 + c_custkey % 2 AS INTEGER) AS n_cols FROM customer), s AS (SELECT table_id, n_rows, n_cols, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CASE WHEN r = 0 AND c = 0 AND table_id % 5 = 0 THEN 2 ELSE 1 END AS cs FROM t, unnest(range(n_rows)) AS a(r), unnest(range(n_cols)) AS b(c) WHERE NOT (table_id % 7 = 0 AND r = 1 AND c = 1)), g AS (SELECT table_id, count(*) AS n, count(DISTINCT r * 100 + cc) AS dn FROM (SELECT table_id, r, unnest(range(c, c + cs)) AS cc FROM s) GROUP BY table_id), topo AS (SELECT table_id, n > dn AS overlap, dn <> n_rows * n_cols AS gap FROM t JOIN g USING (table_id))"


def _topology(spark, d):
    i = F.col("c_custkey")
    t = table(spark, d, "customer").select(i.alias("table_id"), (2 + i % 3).cast("int").alias("n_rows"), (2 + i % 2).cast("int").alias("n_cols"))
    c = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    c = c.where("not (table_id % 7 = 0 and row = 1 and col = 1)")
    c = c.select("table_id", "row", "col", F.lit(1).alias("rowspan"), F.when((F.col("row") == 0) & (F.col("col") == 0) & (F.col("table_id") % 5 == 0), 2).otherwise(1).alias("colspan"))
    return tables.topology(c, t)


@query("q50_topology", duck("SELECT table_id, overlap, gap FROM topo", more=_SPANS))
def q50(spark, d):
    return _topology(spark, d)


@query("q50b_fallback_tables", duck("SELECT table_id, CASE WHEN (overlap OR gap) AND table_id % 2 = 0 THEN 'candidate' ELSE 'original' END AS source, CASE WHEN (overlap OR gap) AND table_id % 2 = 0 THEN 'invalid_topology' WHEN overlap OR gap THEN 'unresolved' END AS reason FROM topo", more=_SPANS))
def q50b(spark, d):
    t = _topology(spark, d)
    return tables.choose_fallback(t, t.select("table_id", (F.col("table_id") % 2 == 1).alias("overlap"), F.lit(False).alias("gap")))


@query("q50c_html_grids", "SELECT table_id, CAST(r AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS col, t AS text FROM (SELECT CAST(c_custkey AS BIGINT) AS table_id, unnest([{'r': 0, 'c': 0, 't': 'a'}, {'r': 0, 'c': cs, 't': c_name}, {'r': 1, 'c': CASE WHEN rs = 2 THEN cs ELSE 0 END, 't': 'c'}, {'r': 1, 'c': CASE WHEN rs = 2 THEN cs + 1 ELSE 1 END, 't': c_mktsegment}], recursive := true) FROM (SELECT *, 1 + c_custkey % 3 AS cs, 1 + c_custkey % 2 AS rs FROM customer))")
def q50c(spark, d):
    i = F.col("c_custkey")
    html = F.format_string("<table><tr><th colspan='%d' rowspan=%d>a</th><th>%s<tr><td>c</td><td> %s </td></tr></table>", 1 + i % 3, 1 + i % 2, "c_name", "c_mktsegment")
    return tables.html_tables(table(spark, d, "customer").select(i.alias("table_id"), html.alias("html"))).select("table_id", "row", "col", "text")


@query("q51_pixel_boxes", duck("SELECT doc_id, page, pos, greatest(0, least(1983, CAST(trunc(x0 * 3) AS INTEGER))) AS x0, greatest(0, least(2804, CAST(trunc(top * 3.3) AS INTEGER))) AS y0, greatest(0, least(1983, CAST(ceil(x1 * 3) AS INTEGER))) AS x1, greatest(0, least(2804, CAST(ceil(bottom * 3.3) AS INTEGER))) AS y1, x1 * 3 <= 1983 AND bottom * 3.3 <= 2804 AS inside FROM layout", "layout"))
def q51(spark, d):
    w = inputs.layout(spark, d)
    xs, ys = F.array(F.col("x1") * 3, F.col("x0") * 3), F.array(F.col("top") * 3.3, F.col("bottom") * 3.3)
    b = w.select("doc_id", "page", "pos", geometry.pixel_box(xs, ys, 1983, 2804).alias("b"), ((F.col("x1") * 3 <= 1983) & (F.col("bottom") * 3.3 <= 2804)).alias("inside"))
    return b.select("doc_id", "page", "pos", "b.*", "inside")


@query("q52_orientation", "SELECT event_id, CASE WHEN rot IN (90, 180, 270) AND conf >= 0.8 AND NOT (rot IN (90, 270) AND tc >= 0.8 AND tr <> rot) THEN rot ELSE 0 END AS rotation FROM (SELECT event_id, CAST(event_id % 4 * 90 AS INTEGER) AS rot, (event_id % 10) / 10.0 AS conf, CAST((event_id // 4) % 4 * 90 AS INTEGER) AS tr, ((event_id // 10) % 10) / 10.0 AS tc FROM events)")
def q52(spark, d):
    i = F.col("event_id")
    got = geometry.orientation((i % 4 * 90).cast("int"), (i % 10) / 10.0, (F.floor(i / 4) % 4 * 90).cast("int"), (F.floor(i / 10) % 10) / 10.0)
    return table(spark, d, "events").select("event_id", got.alias("rotation"))


@query("q52b_resized", "SELECT p_partkey, CASE WHEN greatest(w, h) > 1000 THEN CAST(trunc(w * (1000.0 / greatest(w, h))) AS INTEGER) ELSE CAST(w AS INTEGER) END AS width FROM (SELECT p_partkey, p_partkey % 1700 + 100 AS w, p_size * 40 + 50 AS h FROM part)")
def q52b(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 1700 + 100).alias("w"), (F.col("p_size") * 40 + 50).alias("h"))
    most = F.greatest("w", "h")
    return p.select("p_partkey", F.when(most > 1000, (F.col("w") * (1000.0 / most)).cast("int")).otherwise(F.col("w").cast("int")).alias("width"))


_ANGLES = "a AS (SELECT l_orderkey, l_linenumber, l_quantity AS len, round((l_partkey % 41 - 20) / 10.0, 1) AS angle FROM lineitem)"


def _angles(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("len"), F.round((F.col("l_partkey") % 41 - 20) / 10.0, 1).alias("angle"))


@query("q53_weighted_median", duck("SELECT l_orderkey, min(angle) FILTER (s >= total / 2) AS angle FROM (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY angle, len, l_linenumber ROWS UNBOUNDED PRECEDING) AS s, sum(len) OVER (PARTITION BY l_orderkey) AS total FROM a) GROUP BY l_orderkey", more=_ANGLES))
def q53(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("l_orderkey")
    a = _angles(spark, d).withColumn("s", F.sum("len").over(own.orderBy("angle", "len", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("len").over(own))
    return a.where("s >= total / 2").groupBy("l_orderkey").agg(F.min("angle").alias("angle"))


@query("q53b_anchored_groups", duck("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_groups FROM walk GROUP BY l_orderkey", more="RECURSIVE " + _ANGLES + ", walk(l_orderkey, v) AS (SELECT l_orderkey, min(angle) FROM a GROUP BY l_orderkey UNION ALL SELECT w.l_orderkey, nxt.v FROM walk w, LATERAL (SELECT min(angle) AS v FROM a WHERE a.l_orderkey = w.l_orderkey AND a.angle - w.v > 0.5) nxt WHERE nxt.v IS NOT NULL)"))
def q53b(spark, d):
    g = _angles(spark, d).groupBy("l_orderkey").agg(F.collect_list("angle").alias("v"))
    return g.select("l_orderkey", F.size(geometry.anchored_groups(F.col("v"), F.lit(0.5))).alias("n_groups"))


@query("q54_typed_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q54(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("q54b_lenient_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ' \\n' WHEN 1 THEN '\\section{' || event_type || '} \\alpha' END AS latex FROM events")
def q54b(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('{"latex": "'), "event_type", F.lit(' \\\\n"}'))).when(k == 1, F.concat(F.lit('{"latex": "\\section{'), "event_type", F.lit('} \\alpha"}'))).otherwise(F.concat(F.lit('{"latex": "'), "event_type"))
    return table(spark, d, "events").select("event_id", F.get_json_object(pages.lenient_json(raw), "$.latex").alias("latex"))


@query("q55_challenges", "SELECT page_id, list_has_any([contains(t, m) FOR m IN [" + ", ".join(f"'{m}'" for m in routing.CHALLENGES) + "]], [true]) AS challenge, length(t) < 50 AS too_short FROM (SELECT page_id, lower(url || chr(10) || substr(html, 1, 4000)) AS t FROM pages)")
def q55(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", routing.challenged(F.col("url"), F.col("html")).alias("challenge"), (F.length(F.concat("url", F.lit("\n"), F.substring("html", 1, 4000))) < 50).alias("too_short"))


_MODELS = ("gemini-x", "gpt-5", "meta-llama/turbo-1", "meta-llama/Other", "microsoft/p", "accounts/fireworks/a", "claude-x", "mistral-o", "deepseek-v", "m2-a", "x-docling", "unknown")


@query("q56_providers", "SELECT event_id, (['gemini', 'openai', 'together', 'huggingface', 'openrouter', 'fireworks', 'anthropic', 'mistral', 'deepseek', 'minimax', 'local', NULL])[event_id % 12 + 1] AS provider FROM events")
def q56(spark, d):
    model = F.get(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % 12).cast("int"))
    return table(spark, d, "events").select("event_id", routing.provider(model).alias("provider"))


@query("q58_cheap_first", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 500 THEN 'OCR' ELSE 'LLM_PARSE' END AS parser FROM documents")
def q58(spark, d):
    return table(spark, d, "documents").select("doc_id", routing.cheap_first(F.length(text.strip(F.col("text"))), 500).alias("parser"))
