"""Commands: ``parse``, ``schema``, ``latex``, ``latex-template`` and ``latex-fill`` (``python -m leafmill.cli``).

Adapters are named as ``module:function``: a factory without arguments that returns a dict of adapters (for ``parse``), or
the model's call (for ``schema`` and ``latex``).
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import schema as schemas
from .operators import recognise
from .sources import dispatch, stages


def named(where: str):
    """What ``module:function`` names; its module travels to the workers, who may not have it."""
    module, _, name = where.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, name)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in positional:
            c.add_argument(x)
        return c

    c = command("parse", "input")
    c.add_argument("--output")
    c.add_argument("--parser-type", default="AUTO", choices=("AUTO", "STATIC_PARSE", "LLM_PARSE"))
    c.add_argument("--format", default="markdown", choices=("markdown", "json"))
    c.add_argument("--priority", default="speed", choices=("speed", "accuracy", "cost"))
    c.add_argument("--adapters")
    c = command("schema", "input", "schema")
    c.add_argument("--output")
    c.add_argument("--adapter", required=True)
    c.add_argument("--fill-single-schema", action="store_true")
    c = command("latex", "input", "output")
    c.add_argument("--adapter", required=True)
    c.add_argument("--renderer", required=True)
    c.add_argument("--start-page", type=int, default=None)
    c.add_argument("--organize-values", action="store_true")
    c.add_argument("--render-dpi", type=int, default=240)
    c = command("latex-template", "input", "output")
    c.add_argument("--values-output", required=True)
    command("latex-fill", "template", "values", "output")
    return p


def _say(text: str, output: str | None) -> None:
    if output:
        stages.replace_file(output, text)
    else:
        sys.stdout.write(text + "\n")


def _parse(spark, a) -> None:
    adapters = named(a.adapters)() if a.adapters else {}
    segments = dispatch.parse_path(spark, a.input, adapters=adapters, parser=a.parser_type, accurate=a.priority == "accuracy", cost_threshold=100 if a.priority == "cost" else None)
    rows = dispatch.documents(segments).orderBy("path")
    if a.output and len(list(Path(a.input).parent.glob(Path(a.input).name))) != 1:  # many files: a folder, written by tasks
        stages.write_markdown(rows, a.output, a.format == "json")
        return
    each = (r.asDict(recursive=True) for r in rows.toLocalIterator())
    _say("\n".join(json.dumps(r, ensure_ascii=False) if a.format == "json" else r["raw"] or "" for r in each), a.output)


def _schema(spark, a) -> None:
    call, wanted = named(a.adapter), schemas.load(a.schema)
    raw = spark.read.format("binaryFile").load(a.input)
    ask = F.pandas_udf(lambda s: s.map(lambda b: call(bytes(b), wanted)), "string")
    got = raw.select("path", schemas.extracted(ask("content"), wanted).alias("record")).orderBy("path")
    if a.fill_single_schema:
        got = got.where("record is not null").limit(1)
    _say("\n".join(r["j"] for r in got.where("record is not null").select(F.to_json("record", {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()), a.output)


def _latex(spark, a) -> None:
    call, render = named(a.adapter), named(a.renderer)
    pages = dispatch.pages_of(spark.read.format("binaryFile").load(a.input), render, a.render_dpi)
    total = pages.count()
    last = stages.checkpoint(a.output)
    start = a.start_page or (last[0] + 1 if last and last[0] < total else 1)
    fault = spark.range(1).select(recognise.resume_faults(F.lit(last[0] if last and start > 1 else None).cast("int"), F.lit(last[1] if last and start > 1 else None).cast("int"), F.lit(start), F.lit(total))).first()[0]
    if fault:
        raise SystemExit(f"can't go on at page {start}: {fault}")
    asked = pages.where(F.col("page") >= start).select(F.lit(1).cast("long").alias("doc_id"), "page", F.lit(total).alias("total"), "image", F.lit(None).cast("string").alias("fallback"))
    got = recognise.recognise_pages(asked, lambda: call).where("tex is not null").orderBy("page")
    for row in got.toLocalIterator():  # one document's pages, in order: each is on disk before the next
        stages.write_page(a.output, row["page"], row["total"], row["tex"])
    done = stages.checkpoint(a.output)
    if not done or done[0] < total:
        raise SystemExit(f"stopped after page {done[0] if done else 0} of {total}")
    if a.organize_values:
        out = Path(a.output)
        stages.organise(out, out.with_suffix(".template.tex"), out.with_suffix(".values.json"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    if a.command == "latex-template":
        stages.organise(a.input, a.output, a.values_output)
    elif a.command == "latex-fill":
        stages.fill(a.template, a.values, a.output)
    else:
        {"parse": _parse, "schema": _schema, "latex": _latex}[a.command](spark or SparkSession.builder.getOrCreate(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
