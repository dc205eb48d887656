"""Variable-capacity best-fit packing, planned on length counts and dealt out to rows by ordinals."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise, table

#: Permitted sequence lengths.
SIZES = (512, 1024, 2048, 4096, 8192)
#: Rows of a length class that share a salt; a class's ordinals are counted within salts and offset.
SALT_ROWS = 20_000
#: Ordinals of one chunk: ranges of a plan are joined to rows by (length, chunk).
CHUNK = 4096


@dataclass(frozen=True)
class Placement:
    """Rows ``first .. first + count - 1`` of a length go to bins ``bin .. bin + count - 1``, each at ``offset``."""

    length: int
    first: int
    count: int
    bin: int
    offset: int


def cost(size: int, fixed: float = 64.0, square: float = 1 / 65536) -> float:
    """Cost of a sequence of ``size`` tokens: linear work, a fixed share for each sequence, and attention's square."""
    return fixed + size + square * size * size


def plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, price=cost) -> tuple[list[Placement], list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over ``{length: rows}``; bins alike are handled as one run of bins.

    Longest first, rows go to the open bins with the least room that still holds them. Where none has room a new bin
    is opened, of the size with the least cost a token that it can be expected to hold: the row itself and, as far
    as they last, the shorter rows still to come. At the end each bin shrinks to the smallest size that holds its
    contents. Returns the placements and the bins as runs ``(first bin, bins, used, size)``.

    The work depends on the number of lengths (at most the largest size), not of rows: a run of bins is split only
    where a length ends within it.
    """
    sizes = tuple(sorted(sizes))
    if any(not 0 < n <= sizes[-1] for n in counts):
        raise ValueError("lengths must be between 1 and the largest size")
    rooms: list[int] = []  # rooms with open runs, ascending
    runs: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, used)
    placed: list[Placement] = []
    bins = 0
    shorter = sum(n * c for n, c in counts.items())

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room not in runs:
            insort(rooms, room)
        runs.setdefault(room, []).append(run)

    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        shorter -= length * left
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n, used = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
                take = min(n, left)
                if n > take:
                    put(room, (start + take, n - take, used))
            else:
                # What is still to come fills a bin up to its size or to its share of the rest.
                held = lambda s, rest=shorter + length * left: min(s, rest if rest < s else s)
                size = min((s for s in sizes if s >= length), key=lambda s: (price(s) / max(length, held(s)), s))
                per = max(1, size // length)
                take, start, room, used = max(1, -(-left // per)), bins, size, 0
                bins += take
            placed.append(Placement(length, first, take, start, used))
            put(room - length, (start, take, used + length))
            first, left = first + take, left - take
    done = [(start, n, used, next(s for s in sizes if s >= used)) for room in rooms for start, n, used in runs[room]]
    return placed, sorted(done)


def by_size(placed: list[Placement], bins: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Placements cut where the runs of finished bins end, each with the size its bins have shrunk to."""
    starts, out = [b[0] for b in bins], []
    for p in placed:
        at, end = p.bin, p.bin + p.count
        k = bisect_right(starts, at) - 1
        while at < end:
            stop = min(end, bins[k][0] + bins[k][1])
            out.append((p.length, p.first + at - p.bin, stop - at, at, p.offset, bins[k][3]))
            at, k = stop, k + 1
    return out


def pack(rows: DataFrame, length_col: str = "n_tokens", id_cols: tuple[str, ...] = ("doc_id",), sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """One row for each piece of each row: ``id_cols, piece, n_tokens, bin_id, bin_size, bin_offset``.

    A row longer than the largest size is cut into full pieces and a rest; its pieces are packed like rows. A null
    or negative length counts as 0 and such rows come back once, with null bin columns. Which of equal lengths goes
    where follows a checksum of the ids, then the ids, so repeated rows get a place each. An empty table gives an
    empty result. The driver sees one count for each length up to the largest size, whatever the input.
    """
    spark = rows.sparkSession
    top = max(sizes)
    base = rows.select(*id_cols, F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    base = materialise(base, "lengths")  # read three times below; what a length takes to count is done once
    pieces = base.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / top) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(top).cast("long"), F.col("total") - F.col("piece").cast("long") * top)).drop("total")
    counts = {r[0]: r[1] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*")).collect()}
    placed, bins = plan(counts, sizes)

    # Ordinals within a length, without a task for a length: counts by salt give each salt its offset.
    mark = F.xxhash64("piece", *id_cols)
    salts = F.greatest(F.lit(1), F.ceil(F.col("of_length") / SALT_ROWS)).cast("long")
    sizes_df = spark.createDataFrame(sorted(counts.items()) or [(0, 0)], "n_tokens long, of_length long")
    full = pieces.where("n_tokens > 0").join(F.broadcast(sizes_df), "n_tokens").withColumn("mark", mark)
    full = full.withColumn("salt", F.pmod("mark", salts)).drop("of_length")
    by_salt = full.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_salt.select("n_tokens", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("n_tokens", "salt").orderBy("mark", "piece", *id_cols)
    numbered = full.withColumn("own", F.row_number().over(own)).join(offsets, ["n_tokens", "salt"])
    numbered = numbered.withColumn("ordinal", F.col("before") + F.col("own") - 1).withColumn("chunk", F.floor(F.col("ordinal") / CHUNK))

    places = spark.createDataFrame([tuple(r) for r in by_size(placed, bins)] or [(0,) * 6], "n_tokens long, first long, count long, bin long, bin_offset long, bin_size int")
    places = places.where("count > 0").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("first") + F.col("count") - 1) / CHUNK))))
    at = numbered.join(places, ["n_tokens", "chunk"]).where("ordinal >= first and ordinal < first + count")
    out = at.withColumn("bin_id", F.col("bin") + F.col("ordinal") - F.col("first")).select(*id_cols, "piece", "n_tokens", "bin_id", "bin_size", "bin_offset")
    empty = pieces.where("n_tokens = 0").select(*id_cols, "piece", "n_tokens", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_size"), F.lit(None).cast("long").alias("bin_offset"))
    return out.unionByName(empty)


def word_count(text) -> F.Column:
    """Words of a text (runs of characters other than white space), without a regular expression."""
    flat = F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, " " * len(ASCII_SPACE)))
    # A word begins at each character that isn't a blank and follows one: blanks in runs are counted once.
    return F.when(F.length(flat) == 0, 0).otherwise(F.size(F.filter(F.split(flat, " ", -1), lambda w: w != ""))).cast("long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n_tokens")))
