"""Stage artifacts, page-by-page TeX files, templates and logs on disk: reading, writing, invalidating, resuming."""

from __future__ import annotations

import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import latex

# The stages of a page's recognition, and the macros that annotated TeX needs.
STAGES = ("render", "ocr", "tables", "draft", "reconciled")
MACROS = {r"\handwritten": r"\providecommand{\handwritten}[1]{#1}", r"\fieldvalue": r"\providecommand{\fieldvalue}[1]{#1}", r"\checkboxfield": r"\providecommand{\checkboxfield}[1]{#1}"}


def stage_path(root: str, stage: str, key: str) -> str:
    """The folder of one stage and cache key; unknown stages and keys that are no SHA-256 are refused."""
    if stage not in STAGES or not re.fullmatch(r"[0-9a-f]{64}", key):
        raise ValueError("unknown stage or malformed cache key")
    return f"{root}/stage={stage}/cache_key={key}"


def read_stage(spark: SparkSession, root: str, stage: str, schema: str) -> DataFrame:
    """Artifacts of a stage: ``cache_key, page, text, json``; a payload that isn't whole JSON of ``schema`` is null."""
    if stage not in STAGES:
        raise ValueError("unknown stage")
    rows = spark.read.schema("page int, payload string, stage string, cache_key string").parquet(root).where(F.col("stage") == stage)
    whole = F.try_parse_json("payload").isNotNull()
    return rows.select("cache_key", "page", F.col("payload").alias("text"), F.when(whole, F.from_json("payload", schema)).alias("json"))


def invalidate(spark: SparkSession, root: str, gone: DataFrame) -> None:
    """Drops artifacts ``gone(stage, cache_key, page)``: only the partitions that hold some are written anew.

    The rest of such a partition is written to a folder beside and put in its place by Spark's own commit.
    """
    rows = spark.read.schema("page int, payload string, stage string, cache_key string").parquet(root)
    touched = rows.join(gone.select("stage", "cache_key").distinct(), ["stage", "cache_key"], "left_semi")
    marked = touched.join(gone.select("stage", "cache_key", "page", F.lit(True).alias("drop")).distinct(), ["stage", "cache_key", "page"], "left")
    held = f"{root.rstrip('/')}.kept"
    marked.where("drop is null").select("page", "payload", "stage", "cache_key").write.mode("overwrite").parquet(held)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in touched.select("stage", "cache_key").distinct().toLocalIterator():  # a partition at a time: names, not rows
        fs.delete(path(stage_path(root, r["stage"], r["cache_key"])), True)
    kept = spark.read.schema("page int, payload string, stage string, cache_key string").parquet(held)
    kept.write.partitionBy("stage", "cache_key").mode("append").parquet(root)
    fs.delete(path(held), True)


def replace_file(path: str | Path, content: str) -> None:
    """Writes a small file so that readers see the old or the new one, never a part: beside, flushed, then renamed."""
    path = Path(path)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def checkpoint(path: str | Path) -> tuple[int, int] | None:
    """Page and total of the last completion marker of a file; None without one."""
    path = Path(path)
    found = re.findall(latex.MARKER_RX, path.read_text(encoding="utf-8")) if path.exists() else []
    return tuple(map(int, found[-1])) if found else None


def write_page(path: str | Path, page: int, total: int, content: str) -> None:
    """Adds one page to a TeX file: only after the page before it, for the same total; whole or not at all.

    The page's own marker must be the right one, if it has any; the file has one marker, after its last page, one end of
    the document, with the last page, and a definition of each macro, put before the document's begin where it lacks one.
    """
    own = [tuple(map(int, m)) for m in re.findall(latex.MARKER_RX, content)]
    if own and own != [(page, total)]:
        raise ValueError("the page has a wrong or a second marker")
    before = ""
    if page > 1:
        last = checkpoint(path)
        if last is None or last[0] != page - 1:
            raise ValueError(f"page {page} doesn't follow page {last[0] if last else 'unknown'}")
        if last[1] != total:
            raise ValueError("the number of pages differs")
        before = Path(path).read_text(encoding="utf-8")
    bare = lambda t: re.sub(latex.MARKER_RX, "", t).replace(r"\end{document}", "").rstrip()
    markers = re.findall(latex.MARKER_RX + ".*", before)
    text = "\n\n".join(x for x in (bare(before) if markers else before.replace(r"\end{document}", "").rstrip(), bare(content)) if x)
    if page == total:
        text += "\n\n\\end{document}"
    text += f"\n% PAGE_COMPLETED: {page}/{total}\n"
    lacking = [line for name, line in MACROS.items() if f"\\newcommand{{{name}}}" not in text and f"\\providecommand{{{name}}}" not in text]
    if lacking:
        if r"\begin{document}" not in text:
            raise ValueError("the text has no begin of a document")
        text = text.replace(r"\begin{document}", "\n".join(lacking) + "\n\\begin{document}", 1)
    replace_file(path, text)


def write_pages(pages: DataFrame, path: str | Path) -> int:
    """Adds a document's delivered pages (``page, total, tex``) to its file in order, after what it has; how many."""
    last = checkpoint(path)
    n = 0
    for row in pages.where(F.col("page") > (last[0] if last else 0)).orderBy("page").toLocalIterator():  # one document, a page at a time
        write_page(path, row["page"], row["total"], row["tex"])
        n += 1
    return n


def organise(source: str | Path, template: str | Path, manifest: str | Path) -> dict:
    """Takes an annotated file apart: a template with placeholders, and a manifest of its values."""
    text, records = latex.extract(Path(source).read_text(encoding="utf-8"))
    found = {"schema_version": "1.0", "source_tex": Path(source).name, "value_count": len(records), "values": records}
    replace_file(template, text)
    replace_file(manifest, json.dumps(found, ensure_ascii=False, indent=2) + "\n")
    return found


def fill(template: str | Path, manifest: str | Path, output: str | Path) -> None:
    """Puts a manifest's values, as they were edited, into a template."""
    values = json.loads(Path(manifest).read_text(encoding="utf-8"))["values"]
    replace_file(output, latex.fill(Path(template).read_text(encoding="utf-8"), values))


def write_markdown(documents: DataFrame, path: str, as_json: bool = False) -> None:
    """Texts (``raw``) as files of text, or whole rows as JSON lines."""
    if as_json:
        documents.write.mode("overwrite").json(path)
    else:
        documents.select(F.coalesce("raw", F.lit("")).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def log_calls(events: DataFrame, path: str) -> None:
    """Adds call events to a log of JSON lines; prompts and replies are left out."""
    kept = [c for c in events.columns if c not in ("prompt", "reply", "payload", "content")]
    events.select(*kept, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at")).write.mode("append").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of the files that a path or pattern names."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
