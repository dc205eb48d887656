"""Files to text segments ``path, page, content``: plain text, CSV, word files, sheets; by Spark's own file readers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def text_segments(spark: SparkSession, path: str) -> DataFrame:
    """One segment, page 1, for each file; bytes that aren't UTF-8 are left out."""
    decode = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode("utf-8", "ignore")), "string")
    return spark.read.format("binaryFile").load(path).select("path", F.lit(1).alias("page"), decode("content").alias("content"))


def csv_segments(spark: SparkSession, path: str) -> DataFrame:
    """Each CSV file as one pipe table."""
    def cells(frames):
        import csv

        for f in frames:
            rows = [(p, r, c, v) for p, b in zip(f["path"], f["content"], strict=True) for r, row in enumerate(csv.reader(io.StringIO(bytes(b).decode("utf-8", "ignore")))) for c, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=["table_id", "row", "col", "text"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    long = raw.mapInPandas(cells, "table_id string, row int, col int, text string")
    return tables.to_markdown(long).select(F.col("table_id").alias("path"), F.lit(1).alias("page"), F.col("markdown").alias("content"))


def docx_paragraphs(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_W}body")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in (body if body is not None else []) if p.tag == f"{_W}p")


def xlsx_cells(data: bytes) -> list[tuple[int, int, str]]:
    """Cells of the first sheet as (row, column, text), from 0."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        sheet = ElementTree.fromstring(z.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
    out = []
    for c in sheet.iter(f"{_S}c"):
        letters, number = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
        col = 0
        for x in letters:
            col = col * 26 + ord(x) - 64
        v = c.find(f"{_S}v")
        text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        out.append((int(number) - 1, col - 1, text))
    return out


def _failing(one):
    """Turns an exception of one file into a row with its name in ``error``."""
    def run(frames):
        for f in frames:
            rows = []
            for p, b in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((p, 1, one(bytes(b)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, 1, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "page", "content", "error"])

    return run


def docx_segments(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of word files joined by line feeds; a file that can't be read has an ``error`` instead."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(_failing(docx_paragraphs), "path string, page int, content string, error string")


def xlsx_segments(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook as a pipe table."""
    def cells(frames):
        for f in frames:
            rows = [(p, *c) for p, b in zip(f["path"], f["content"], strict=True) for c in xlsx_cells(bytes(b))]
            yield pd.DataFrame(rows, columns=["table_id", "row", "col", "text"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    long = raw.mapInPandas(cells, "table_id string, row int, col int, text string")
    return tables.to_markdown(long).select(F.col("table_id").alias("path"), F.lit(1).alias("page"), F.col("markdown").alias("content"))


def write_stage(pages: DataFrame, root: str) -> None:
    """Stage artifacts by stage and cache key; writing a key again replaces that key alone."""
    pages.write.partitionBy("stage", "cache_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def write_evidence(pages: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are written."""
    pages.select(F.to_json(F.struct(*pages.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
