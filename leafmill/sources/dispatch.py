"""From paths to segments: which reader or adapter a file goes to, what happens where that fails, and the document's row.

Plain files are read here. PDF, slides, images, audio and model parsing come as adapters ``bytes, path -> segments``: no
library for them is part of this package. A segment is ``(page, heading, content)`` or a dict with further keys.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as markup
from ..operators import routing
from .readers import docx_paragraphs, xlsx_cells

SEGMENTS = "path string, parser string, reader string, seg_no int, page int, heading string, content string, input long, output long, bboxes array<struct<word:string,x0:double,top:double,x1:double,bottom:double>>, error string"
Adapter = Callable[[bytes, str], Iterable]
#: What reads a kind of file without a model, in the order in which readers are tried.
READERS = {"pdf": ("layout", "ocr"), "image": ("ocr",), "slides": ("slides",), "text": ("text",), "csv": ("csv",), "sheet": ("sheet",), "word": ("word",), "html": ("html",), "audio": ()}


def kind_of(path: str) -> str | None:
    """The kind of a file by its extension; None if none of the readers knows it."""
    ext = re.search(r"(\.[^./]+)$", path.lower())
    mime = routing.MIME.get(ext[1]) if ext else None
    exact = {"application/pdf": "pdf", "text/csv": "csv", "text/html": "html"}
    parts = {"spreadsheet": "sheet", "presentation": "slides", "wordprocessing": "word", "image/": "image", "audio/": "audio", "text/": "text"}
    return exact.get(mime) or next((k for p, k in parts.items() if mime and p in mime), None)


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a pipe table, the first one its header; columns of numbers alone are set to the right."""
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [[c.replace("\n", "<br>") if i else c for c in r] + [""] * (n - len(r)) for i, r in enumerate(rows)]
    width = [max(3, *(len(r[j]) for r in rows)) for j in range(n)]
    right = [all(re.fullmatch(r"[+-]?\d+(\.\d+)?", r[j]) for r in rows[1:]) for j in range(n)]
    line = lambda r: "| " + " | ".join(c.rjust(w) if a else c.ljust(w) for c, w, a in zip(r, width, right, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + ":" if a else ":" + "-" * (w + 1) for w, a in zip(width, right, strict=True)) + "|"
    return "\n".join([line(rows[0]), rule, *map(line, rows[1:])])


def heading_pieces(md: str) -> list[tuple[str, str]]:
    """A Markdown text at its dominant heading level: ``(heading, content)``, what stands before as ``Introduction``."""
    rule = next((rf"(?m)^{'#' * k} .*$" for k in range(1, 6) if len(re.findall(rf"(?m)^{'#' * k} .*$", md)) > 1), r"(?m)^# .*$")
    heads = [h.replace(rule[5:].split(" ")[0], "").strip() for h in re.findall(rule, md)]
    return list(zip(["Introduction", *heads], [p.strip() for p in re.split(rule, md)], strict=True))


def _sheet(data: bytes) -> str:
    cells = xlsx_cells(data)
    rows = [["" for _ in range(max((c for _, c, _ in cells), default=-1) + 1)] for _ in range(max((r for r, _, _ in cells), default=-1) + 1)]
    for r, c, v in cells:
        rows[r][c] = v or ""
    return pipe_table(rows)


def _plain(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


#: Readers that need no adapter.
BUILT_IN: dict[str, Adapter] = {
    "text": lambda b, p: [(1, None, _plain(b))],
    "csv": lambda b, p: [(1, None, pipe_table(list(csv.reader(io.StringIO(_plain(b))))))],
    "sheet": lambda b, p: [(1, None, _sheet(b))],
    "word": lambda b, p: [(1, None, docx_paragraphs(b))],
    "html": lambda b, p: [(None, h, c) for h, c in heading_pieces(markup.to_markdown(_plain(b)))],
}


def parse_bytes(data: bytes, path: str, parser: str, adapters: dict[str, Adapter], fall_back: bool = True) -> tuple[str, str | None, list, str | None]:
    """One file: ``(parser, reader, segments, error)``.

    Static parsing tries the kind's readers in turn (layout, then OCR). A parser that the router chose and that fails
    gives way once to the other one; one that the caller named doesn't. An unknown kind is an error of its own.
    """
    kind, known, wrong = kind_of(path), BUILT_IN | adapters, "unsupported file type"
    if kind is None:
        return parser, None, [], wrong
    for way in (parser, "STATIC_PARSE" if parser == "LLM_PARSE" else "LLM_PARSE")[: 2 if fall_back else 1]:
        for reader in READERS[kind] if way == "STATIC_PARSE" else ("audio" if kind == "audio" else "model",):
            if reader not in known:
                wrong = f"no adapter: {reader}"
                continue
            try:
                return way, reader, [s if isinstance(s, dict) else dict(zip(("page", "heading", "content"), s, strict=True)) for s in known[reader](data, path)], None
            except Exception as e:  # an adapter may raise whatever its library does
                wrong = type(e).__name__
    return parser, None, [], wrong


def parse(files: DataFrame, adapters: dict[str, Adapter] | None = None, parser: str = "AUTO", accurate: bool = False, cost_threshold: int | None = None, boxes: bool = False) -> DataFrame:
    """Segments of ``files(path, content binary)``, as ``SEGMENTS``; a file that can't be read has one row with its error.

    ``AUTO`` routes by kind, images and links (``routing.route``). With ``cost_threshold`` a file with images is read by
    OCR first, and by the model only if that finds as many characters. With ``boxes``, segments without word boxes get
    those of the static parse, by their number. Sheets and slides are parsed statically whatever was asked.
    """
    adapters = adapters or {}

    def run(frames):
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                data = bytes(raw)
                kind, way, routed = kind_of(path), parser, parser == "AUTO"
                token = lambda t, d=data: t in [x.strip() for x in d.decode("latin-1").lower().split("/")]
                has_image = kind == "image" or kind == "pdf" and token("image")
                if routed:
                    cheap = kind in ("text", "csv", "html", "sheet", "slides") or kind == "pdf" and not has_image and (not accurate or token("uri"))
                    way = "STATIC_PARSE" if cheap else "LLM_PARSE"
                if kind in ("sheet", "slides"):
                    way = "STATIC_PARSE"
                if routed and cost_threshold is not None and has_image and "ocr" in adapters:
                    got = parse_bytes(data, path, "STATIC_PARSE", {"ocr": adapters["ocr"], "layout": adapters["ocr"]}, False)
                    if got[3] or len("\n\n".join(s["content"] or "" for s in got[2]).strip()) >= cost_threshold:
                        got = parse_bytes(data, path, "LLM_PARSE", adapters, True)
                else:
                    got = parse_bytes(data, path, way, adapters, routed)
                used, reader, found, wrong = got
                if boxes and found and not found[0].get("bboxes"):
                    for s, t in zip(found, parse_bytes(data, path, "STATIC_PARSE", adapters, False)[2], strict=False):
                        s["bboxes"] = t.get("bboxes")
                for i, s in enumerate(found or [{}]):
                    rows.append((path, used, reader, i, s.get("page"), s.get("heading"), s.get("content"), s.get("input"), s.get("output"), [dict(zip(("word", "x0", "top", "x1", "bottom"), b, strict=True)) for b in s.get("bboxes") or []], wrong))
            out = pd.DataFrame(rows, columns=["path", "parser", "reader", "seg_no", "page", "heading", "content", "input", "output", "bboxes", "error"])
            yield out.astype({"seg_no": "Int32", "page": "Int32", "input": "Int64", "output": "Int64"})

    return files.select("path", "content").mapInPandas(run, SEGMENTS)


def parse_path(spark: SparkSession, path: str, **options) -> DataFrame:
    """``parse`` of the files that a path or pattern names, by Spark's own reader, which leaves out files without bytes."""
    return parse(spark.read.format("binaryFile").load(path), **options)


def documents(segments: DataFrame) -> DataFrame:
    """A row a document: text, parsers, token usage: ``path, raw, parsers_used, input, output, total, llm_page_count, error``.

    Segments stand in order, a blank line between them; usage counts those of the model alone.
    """
    asked = F.col("parser") == "LLM_PARSE"
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", F.coalesce("content", F.lit("")).alias("c"))))
    tokens = lambda c: F.coalesce(F.sum(F.when(asked, F.col(c))), F.lit(0))
    g = segments.groupBy("path").agg(F.array_join(F.transform(ordered, lambda s: s["c"]), "\n\n").alias("raw"), F.array_sort(F.collect_set("parser")).alias("parsers_used"), tokens("input").alias("input"), tokens("output").alias("output"), F.sum((asked & F.col("error").isNull()).cast("long")).alias("llm_page_count"), F.max("error").alias("error"))
    return g.withColumn("total", F.col("input") + F.col("output"))


def union(parts: list[DataFrame]) -> DataFrame:
    """Results of several chunks or parsers as one; columns that some lack are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def download_name(url: Column, content_type: Column) -> Column:
    """The file name of a download: the last part of the URL's path, with an extension by content type where it has none."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"/+$", "")
    name = F.element_at(F.split(path, "/"), -1)
    back = F.create_map(*[F.lit(x) for ext, mime in reversed({m: e for e, m in reversed(routing.MIME.items())}.items()) for x in (ext, mime)])
    ext = F.coalesce(back[F.trim(F.lower(F.substring_index(content_type, ";", 1)))], F.lit(""))
    name = F.when(name == "", F.lit("download")).otherwise(name)
    return F.when(name.rlike(r"\.[^./]+$"), name).otherwise(F.concat(name, ext))


def pages_of(files: DataFrame, render: Callable[[bytes, int, int], list[tuple[bytes, int, int]]], dpi: int = 240) -> DataFrame:
    """Page images ``path, page, image, width, height, dpi`` by a renderer ``(bytes, dpi, first page) -> images``.

    Pages count from 1; a resolution outside 72..600 is refused, and so are images without a size.
    """
    if not 72 <= dpi <= 600:
        raise ValueError("dpi must be between 72 and 600")

    def run(frames):
        for f in frames:
            rows = [(p, n, i, w, h, dpi) for p, b in zip(f["path"], f["content"], strict=True) for n, (i, w, h) in enumerate(render(bytes(b), dpi, 1), 1) if w > 0 and h > 0]
            yield pd.DataFrame(rows, columns=["path", "page", "image", "width", "height", "dpi"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, image binary, width int, height int, dpi int")


def web_pages(urls: DataFrame, fetch: Callable[[str], bytes], wait: float = 10.0) -> DataFrame:
    """Pages behind ``urls(url)`` as ``url, title, markdown, error``; a failed fetch is tried once more, then told.

    Bytes are read as ISO-8859-1, as a plain HTTP client would without a declared encoding.
    """
    from ..operators.recognise import with_retry

    def run(frames):
        get = with_retry(fetch, wait)
        for f in frames:
            rows = []
            for url in f["url"]:
                body, wrong = get(url)
                page = body.decode("iso-8859-1") if body is not None else None
                rows.append((url, markup.title(page) if page is not None else None, markup.to_markdown(page) if page is not None else None, wrong))
            yield pd.DataFrame(rows, columns=["url", "title", "markdown", "error"])

    return urls.select("url").mapInPandas(run, "url string, title string, markdown string, error string")


def cost_rates(spark: SparkSession, source: dict | str) -> DataFrame:
    """Rates by model, from a dict or a JSON file ``{model: {"input": .., "output": .., "input-image": ..}}``."""
    if not isinstance(source, dict | str):
        raise ValueError("rates are a dict or the path of a JSON file")
    found = source if isinstance(source, dict) else json.loads(Path(source).read_text(encoding="utf-8"))
    rows = [(m, float(r.get("input", 0)), float(r.get("output", 0)), float(r.get("input-image", 0))) for m, r in found.items()]
    return spark.createDataFrame(rows, "model string, input_rate double, output_rate double, image_rate double")
