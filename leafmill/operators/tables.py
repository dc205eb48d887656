"""Tables as long cells ``(table_id, row, col, text)``: cleaning, rendering, spans, topology."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_empty(cells: DataFrame) -> DataFrame:
    """Without rows and columns whose cells are all empty; what stays is numbered anew from 0."""
    full = F.coalesce(F.col("text"), F.lit("")) != ""
    rows = cells.groupBy("table_id", "row").agg(F.bool_or(full).alias("f")).where("f").drop("f")
    cols = cells.groupBy("table_id", "col").agg(F.bool_or(full).alias("f")).where("f").drop("f")
    left = cells.join(rows, ["table_id", "row"], "left_semi").join(cols, ["table_id", "col"], "left_semi")
    rank = lambda c: (F.dense_rank().over(Window.partitionBy("table_id").orderBy(c)) - 1).cast("int")
    return left.select("table_id", rank("row").alias("row"), rank("col").alias("col"), F.coalesce("text", F.lit("")).alias("text"))


def promote_header(cells: DataFrame) -> DataFrame:
    """Row 0 becomes the header; line feeds of the others become ``<br>``."""
    return cells.withColumn("is_header", F.col("row") == 0).withColumn("text", F.when(F.col("row") == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("<br>"))))


def to_markdown(cells: DataFrame) -> DataFrame:
    """Pipe tables: ``table_id, markdown``. Columns of numbers alone are set to the right, others to the left."""
    number = F.col("text").rlike(r"^[+-]?\d+(\.\d+)?$")
    by_col = cells.groupBy("table_id", "col").agg(F.max(F.length("text")).alias("width"), F.bool_and((F.col("row") == 0) | number).alias("right"))
    c = cells.join(by_col.withColumn("width", F.greatest("width", F.lit(3))), ["table_id", "col"])
    padded = F.when(F.col("right"), F.lpad("text", F.col("width"), F.lit(" "))).otherwise(F.rpad("text", F.col("width"), F.lit(" ")))
    rule = F.when(F.col("right"), F.concat(F.repeat(F.lit("-"), F.col("width") + 1), F.lit(":"))).otherwise(F.concat(F.lit(":"), F.repeat(F.lit("-"), F.col("width") + 1)))
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", c.alias("s")))), lambda x: x["s"]), "|")
    rows = c.groupBy("table_id", "row").agg(F.concat(F.lit("|"), line(F.concat(F.lit(" "), padded, F.lit(" "))), F.lit("|")).alias("s"), F.concat(F.lit("|"), line(rule), F.lit("|")).alias("rule"))
    rows = rows.withColumn("s", F.when(F.col("row") == 0, F.concat("s", F.lit("\n"), "rule")).otherwise(F.col("s")))
    return rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "s"))), lambda x: x["s"]), "\n").alias("markdown"))


def topology(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Whether cells with spans cover the grid exactly: ``table_id, overlap, gap``.

    ``cells(table_id, row, col, rowspan, colspan)``, ``tables(table_id, n_rows, n_cols)``.
    """
    covered = cells.withColumn("r", F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1))).withColumn("c", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)))
    counts = covered.groupBy("table_id").agg(F.count("*").alias("n"), F.count_distinct("r", "c").alias("d"), F.max("r").alias("mr"), F.max("c").alias("mc"))
    out = tables.join(counts, "table_id", "left").fillna(0, ["n", "d"])
    size = F.col("n_rows") * F.col("n_cols")
    outside = F.coalesce((F.col("mr") >= F.col("n_rows")) | (F.col("mc") >= F.col("n_cols")), F.lit(False))
    return out.select("table_id", (F.col("n") > F.col("d")).alias("overlap"), ((F.col("d") != size) | outside).alias("gap"))


def choose_fallback(tables: DataFrame, candidates: DataFrame) -> DataFrame:
    """``table_id, source, reason``: a candidate is taken for a table that needs one only if it is clean itself."""
    out = tables.select("table_id", (F.col("overlap") | F.col("gap")).alias("needs")).join(candidates.select("table_id", (~F.col("overlap") & ~F.col("gap")).alias("clean")), "table_id", "left")
    return out.select("table_id", F.when(~F.col("needs"), "original").when(F.col("clean"), "candidate").otherwise("original").alias("source"), F.when(F.col("needs") & F.col("clean"), "invalid_topology").when(F.col("needs"), "unresolved").alias("reason"))


class _Grid(HTMLParser):
    """Cells of an HTML table, each at the next free column of its row."""

    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            a = dict(attrs)
            self.cell = [int(a.get("rowspan", 1)), int(a.get("colspan", 1)), []]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell and data.strip():
            self.cell[2].append(data.strip())


def grid_of(html: str) -> tuple[list[tuple[int, int, int, int, str]], str | None]:
    """``(row, col, rowspan, colspan, text)`` of a table's cells, and what is wrong with it, if anything."""
    parser = _Grid()
    parser.feed(html or "")
    taken, cells = set(), []
    for r, row in enumerate(parser.rows):
        col = 0
        for rowspan, colspan, parts in row:
            while (r, col) in taken:
                col += 1
            if rowspan < 1 or colspan < 1 or r + rowspan > len(parser.rows):
                return [], "invalid span"
            area = {(i, j) for i in range(r, r + rowspan) for j in range(col, col + colspan)}
            if area & taken:
                return [], "overlapping cells"
            taken |= area
            cells.append((r, col, rowspan, colspan, " ".join(parts)))
            col += colspan
    return cells, None if cells else "missing table structure"


def html_tables(tables: DataFrame) -> DataFrame:
    """``table_id, row, col, rowspan, colspan, text, error`` of ``tables(table_id, html)``."""
    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for t, h in zip(f["table_id"], f["html"], strict=True):
                cells, error = grid_of(h)
                out += [(t, *c, None) for c in cells] if not error else [(t, None, None, None, None, None, error)]
            g = pd.DataFrame(out, columns=["table_id", "row", "col", "rowspan", "colspan", "text", "error"])
            yield g.astype({c: "Int32" for c in ("row", "col", "rowspan", "colspan")})

    return tables.select(F.col("table_id").cast("long").alias("table_id"), "html").mapInPandas(run, "table_id long, row int, col int, rowspan int, colspan int, text string, error string")
