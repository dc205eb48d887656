"""Exact dedup: binary fuse filters of an immutable snapshot screen incoming digests before bytes are compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialise, table

#: Digests in one filter shard, on average: a shard is built in one task from this many 8-byte keys.
SHARD_KEYS = 200_000
#: A set of digests is broadcast only up to this many rows (about 64 bytes each); see ``join_groups`` for larger ones.
BROADCAST_DIGESTS = 250_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static filter with 16-bit fingerprints: three slots a key, in consecutive segments; no false negatives."""

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def _places(h: np.ndarray, segment: int, starts: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        cells = [h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36)) & mask]
        return np.stack([(first + np.uint64(k)) * np.uint64(segment) + c for k, c in enumerate(cells)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, min(14, int(np.log(n) / np.log(3.33) + 2.25)))
        size = int(n * max(1.13, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 8
        starts = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            h = _mix(keys, seed)
            at = cls._places(h, segment, starts)
            total = (starts + 2) * segment
            count = np.bincount(at.ravel(), minlength=total)
            index = np.arange(len(keys), dtype=np.int64)
            xor = np.zeros(total, np.int64)
            for row in at:
                np.bitwise_xor.at(xor, row, index)
            alive, order = np.ones(len(keys), bool), []
            ones = np.flatnonzero(count == 1)
            while len(ones):  # each round peels every key that is alone in some slot
                key, first = np.unique(xor[ones], return_index=True)
                slot, keep = ones[first], alive[key]
                key, slot = key[keep], slot[keep]
                order.append((key, slot))
                alive[key] = False
                for row in at:
                    np.subtract.at(count, row[key], 1)
                    np.bitwise_xor.at(xor, row[key], key)
                near = np.unique(at[:, key])
                ones = near[count[near] == 1]
            if not alive.any():
                slots, mark = np.zeros(total, np.uint16), (h ^ (h >> np.uint64(47))).astype(np.uint16)
                for key, slot in reversed(order):
                    rest = slots[at[0, key]] ^ slots[at[1, key]] ^ slots[at[2, key]] ^ slots[slot]
                    slots[slot] = mark[key] ^ rest
                return cls(seed, segment, slots)
        raise RuntimeError("no seed gives an acyclic filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys, np.uint64), self.seed)
        at = self._places(h, self.segment, len(self.slots) // self.segment - 2)
        return (h ^ (h >> np.uint64(47))).astype(np.uint16) == self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """One row ``(shard, seed, segment, slots)`` for each shard of the snapshot's distinct ``key``."""

    def one(group: pa.Table) -> pa.Table:
        f = BinaryFuse.build(group["key"].to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int64()), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "slots": pa.array([f.slots.tobytes()], pa.binary())})

    keyed = digests.select("key").distinct().withColumn("shard", F.pmod("key", F.lit(shards)).cast("long"))
    return keyed.groupBy("shard").applyInArrow(one, "shard long, seed long, segment long, slots binary")


def screen(filters: DataFrame, incoming: DataFrame, shards: int) -> DataFrame:
    """The ``key`` of ``incoming`` that the filters let through: every one of the snapshot, and about 1 in 65536 others."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["key"].to_numpy()
        if not left.num_rows or not len(keys):
            return pa.table({"key": pa.array([], pa.int64())})
        f = BinaryFuse(left["seed"][0].as_py(), left["segment"][0].as_py(), np.frombuffer(left["slots"][0].as_py(), np.uint16))
        return pa.table({"key": pa.array(keys[f.contains(keys.view(np.uint64))], pa.int64())})

    keyed = incoming.select("key").distinct().withColumn("shard", F.pmod("key", F.lit(shards)).cast("long"))
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(one, "key long")


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_SPACE, "")


def digest(norm) -> F.Column:
    return F.sha2(norm, 256)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, most: int | None = None) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row for each ``on``), however many rows one group has.

    Up to ``most`` groups (``BROADCAST_DIGESTS``) are broadcast. Beyond it only those are that have at least a
    ``most``-th of all grouped rows, by their ``size``; there are no more than ``most`` such groups. The others have so
    few rows each that a shuffle deals them out evenly.
    """
    most = BROADCAST_DIGESTS if most is None else most
    n, total = groups.agg(F.count("*"), F.sum(size)).first()
    if n <= most:
        return rows.join(F.broadcast(groups), on, "left")
    hot = F.col(size) * most >= total
    first = rows.join(F.broadcast(groups.where(hot)), on, "left")
    rest = rows.join(F.broadcast(groups.where(hot).select(on)), on, "left_anti").join(groups.where(~hot), on, "left")
    return first.where(F.col(size).isNotNull()).unionByName(rest)


def exact_groups(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows whose texts are equal without white space; one row for each row of ``docs``.

    ``in_snapshot`` is a boolean column: its rows are the immutable snapshot, the others the incoming batch. The
    snapshot's filters screen the batch's digests; what passes, and what repeats within either side, goes on to
    exact buckets in which the bytes themselves are grouped. Returns ``doc_id, keep_id, group_size, kept,
    text_sha256, n_chars, variant``.

    A null text is empty, and empty texts are copies of each other. The row with the most code points in its
    original text, then the least ``doc_id``, stays (a null ``doc_id`` comes last). Repeated rows count each; those
    of the ``doc_id`` that stays are all ``kept``. Different texts of one digest are told apart by their bytes and, in
    the groups' names, by a second hash. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), F.coalesce(in_snapshot, F.lit(False)).alias("old"), digest(norm).alias("sha"), F.xxhash64(norm).alias("variant"))
    rows = materialise(rows.withColumn("key", F.xxhash64("sha")), "digests")

    # Each side on its own: a row for each digest, with what repeats within the side.
    sides = rows.groupBy("sha", "key", "old").agg(F.count("*").alias("n"))
    sides = materialise(sides, "sides")
    old, new = sides.where("old"), sides.where("not old")
    shards = max(1, -(-sides.count() // SHARD_KEYS))
    passed = screen(build_filters(old, shards), new, shards)
    doubtful = new.join(passed, "key", "left_semi").join(old.select("sha"), "sha", "left_semi").select("sha")
    doubtful = materialise(doubtful.union(sides.where("n > 1").select("sha")).distinct(), "doubtful")

    # Exact buckets: only texts whose digest is in doubt are read again, and grouped by their bytes.
    few = doubtful.count() <= BROADCAST_DIGESTS
    suspects = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), norm.alias("bytes")).withColumn("sha", digest(F.col("bytes")))
    suspects = suspects.join(F.broadcast(doubtful) if few else doubtful, "sha", "left_semi")
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    exact = suspects.groupBy("sha", "bytes").agg(F.count("*").alias("size"), best.alias("best"))
    exact = exact.select("sha", F.xxhash64("bytes").alias("variant"), "size", F.col("best.d").alias("keep"))
    exact = materialise(exact, "exact")

    out = join_groups(rows, exact, ["sha", "variant"], "size")
    single = F.col("size").isNull()
    return out.select("doc_id", "variant", F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.when(single, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars")


def keep_first(docs: DataFrame, in_snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, and one row of each of ``exact_groups``: the row that stays.

    Of repeated rows that all might stay, the longest text, then the greatest, is kept. Null texts are empty, a null
    id stays only where its group has no other of as long a text, and an empty table gives an empty result.
    """
    groups = exact_groups(docs, in_snapshot, id_col, text_col).where("group_size > 1")
    groups = groups.groupBy(F.col("text_sha256").alias("__sha"), F.col("variant").alias("__variant")).agg(F.min("keep_id").alias("__keep"), F.count("*").alias("__size"))
    groups = materialise(groups, "groups")
    norm = normalised(F.col(text_col))
    named = join_groups(docs.withColumn("__sha", digest(norm)).withColumn("__variant", F.xxhash64(norm)), groups, ["__sha", "__variant"], "__size")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col(text_col), F.lit(""))
    several = named.where(F.col("__size").isNotNull() & F.col(id_col).cast("long").eqNullSafe(F.col("__keep")))
    several = several.groupBy("__sha", "__variant").agg(F.max_by(whole, F.struct(F.length(text), text)).alias("__row")).select("__row.*")
    return named.where("__size is null").select(docs.columns).unionByName(several)


def default_snapshot(id_col: str = "doc_id"):
    """Half of the rows by a checksum of their id stand for the snapshot; the result is the same for any split."""
    return F.crc32(F.col(id_col).cast("string")) % 2 == 0


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs, default_snapshot()).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
"""
