"""Exact top-k inner products by norm buckets: local cosine thresholds prune a bucket by length or by coordinates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Vectors whose lengths differ by less than this factor share a bucket.
STEP = 1.05
#: Rows of a block of candidates or of queries: what one task holds of either at a time.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Candidates of a part that a block of queries meets in a task of its own; there are six parts at least.
SHARD_ROWS = 64 * BLOCK
LEAST_SHARDS = 6
#: Coordinate pruning looks at this many of a query's largest components first.
FOCUS = 8


def _pack(kind: int):
    """Rows (group, id, norm, vector) in order of group -> one row a group, its ids and vectors as bytes."""

    def one(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        x = np.array(group["x"].to_pylist(), np.int64).reshape(len(ids), group["dim"][0].as_py())
        order = np.argsort(ids, kind="stable")
        return pa.table({"kind": pa.array([kind], pa.int32()), "block": pa.array([group["block"][0].as_py()], pa.int64()), "bucket": pa.array([group["bucket"][0].as_py()], pa.int64()), "ids": pa.array([ids[order].astype("<i8").tobytes()]), "vectors": pa.array([x[order].astype("<i8").tobytes()]), "dim": pa.array([x.shape[1]], pa.int32())})

    return one


PACKED = "kind int, block long, bucket long, ids binary, vectors binary, dim int"


def _best(k: int, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest k scores of each row, ties to smaller ids."""
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


class _Search:
    """The running top k of a block of queries; a bucket is asked only for what can still enter it."""

    NONE = np.iinfo(np.int64).min + 1  # its negative is an int64 too

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.length = np.sqrt((q.astype(float) ** 2).sum(1))
        self.score = np.full((len(ids), k), self.NONE, np.int64)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max, np.int64)
        self.focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :FOCUS]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        exact = x.astype(float)
        norms = np.sqrt((exact**2).sum(1))
        top = norms.max()
        # Length pruning: q.x <= |q||x|, so a bucket can't change queries whose kth score is above that. A relative
        # margin covers the rounding of the bound; equal scores stay, as ties go to smaller ids.
        kth = self.score[:, -1].astype(float)
        open_ = np.flatnonzero(kth <= self.length * top * (1 + 1e-9) + 1)
        if not len(open_):
            return
        safe = self.length.max() * top < 2**52
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.length[open_] * top > 0, kth[open_] / (self.length[open_] * top), -1.0)
        # Where the local threshold is low nearly all survive any bound: all products are verified in one go.
        dense = open_[cosine < 0.55]
        for at in range(0, len(dense), 256):
            rows = dense[at : at + 256]
            products = (self.q[rows].astype(float) @ exact.T).astype(np.int64) if safe else self.q[rows] @ x.T
            self._enter(rows, products, ids)
        for row in open_[cosine >= 0.55].tolist():
            # Coordinate pruning: the focus coordinates are multiplied, the rest is bounded by Cauchy-Schwarz.
            f = self.focus[row]
            part = exact[:, f] @ self.q[row, f].astype(float)
            rest_q = math.sqrt(max(self.length[row] ** 2 - float((self.q[row, f].astype(float) ** 2).sum()), 0.0))
            rest_x = np.sqrt(np.maximum(norms**2 - (exact[:, f] ** 2).sum(1), 0))
            bound = part + rest_q * rest_x
            left = np.flatnonzero(bound * (1 + np.sign(bound) * 1e-9) + 1 >= kth[row])
            if len(left):
                self._enter(np.array([row]), (x[left] @ self.q[row])[None, :], ids[left])

    def _enter(self, rows: np.ndarray, products: np.ndarray, ids: np.ndarray) -> None:
        same = self.ids[rows][:, None] == ids[None, :]
        if same.any():
            products = np.where(same, self.NONE, products)
        if products.shape[1] > 4 * self.k:  # ties at the cut are kept apart: all that reach it stay
            cut = np.partition(products, -self.k, axis=1)[:, -self.k]
            keep = np.flatnonzero((products >= cut[:, None]).any(0))
            products, ids = products[:, keep], ids[keep]
        score = np.concatenate([self.score[rows], products], 1)
        names = np.concatenate([self.found[rows], np.where(products == self.NONE, np.iinfo(np.int64).max, np.broadcast_to(ids, products.shape))], 1)
        self.score[rows], self.found[rows] = _best(self.k, score, names)

    def rows(self) -> pa.RecordBatch:
        ok = self.found != np.iinfo(np.int64).max
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, ok.sum(1))), pa.array(self.found[ok]), pa.array(self.score[ok])], ["query_id", "vec_id", "score"])


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest integer inner products of each query among ``vectors``: ``query_id, rank, vec_id, score``.

    Both take ``vec_id long`` and ``x array<long>``. Vectors of different lengths have no product and never meet; two empty
    ones have the product 0. Candidates are grouped by length into buckets of
    a factor of 1.05, and large buckets (a hot length, or many copies of a vector) into blocks of a bounded size.
    A task takes a block of queries through a shard of the blocks, longest vectors first, so that a query's kth score
    soon closes the buckets that follow; only k rows a query leave each shard. Nothing is approximate.

    Null vectors, and those with a null component, take no part, nor does a row with a null id; a query isn't its own
    candidate (all rows of its id are left out). Ties go to the smaller id; of a repeated row each counts. A table
    without queries gives an empty result, a query without candidates no row. Other columns are not read.
    """
    usable = lambda df: df.where("vec_id is not null and x is not null and not exists(x, v -> v is null)").select(F.col("vec_id").cast("long").alias("vec_id"), "x", F.size("x").alias("dim"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    c = usable(vectors).withColumn("norm", norm).withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(STEP))).otherwise(-1).cast("long"))
    c = materialise(c, "vectors")
    sizes = materialise(c.groupBy("dim", "bucket").agg(F.count("*").alias("n")), "sizes")
    shards = max(LEAST_SHARDS, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS))
    # A bucket of n rows becomes ceil(n / BLOCK) blocks, filled by a checksum of the id.
    c = c.join(sizes, ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).cast("long"))
    c_blocks = c.select("dim", "bucket", "block", "vec_id", "x").groupBy("dim", "bucket", "block").applyInArrow(_pack(1), PACKED)
    q = usable(queries)
    n_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n_blocks)).cast("long")).withColumn("bucket", F.lit(0).cast("long"))
    q_blocks = q.select("dim", "bucket", "block", "vec_id", "x").groupBy("dim", "bucket", "block").applyInArrow(_pack(0), PACKED)
    # Each block of queries meets each shard of candidates in one task: blocks travel, not rows or pairs.
    shard = F.pmod(F.xxhash64("bucket", "block"), F.lit(shards)).cast("int")
    left = c_blocks.withColumn("shard", shard).withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    right = q_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("qblock", F.col("block"))
    met = left.unionByName(right).repartition("dim", "qblock", "shard").sortWithinPartitions("dim", "qblock", "shard", "kind", F.desc("bucket"), "block")

    def run(batches):
        key, search = None, None
        for b in batches:
            for row in b.to_pylist():
                if (row["dim"], row["qblock"], row["shard"]) != key:
                    if search:
                        yield search.rows()
                    key, search = (row["dim"], row["qblock"], row["shard"]), None
                ids = np.frombuffer(row["ids"], "<i8")
                x = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dim"])
                if row["kind"] == 0:
                    search = _Search(ids, x, k)
                elif search:
                    search.meet(ids, x)
        if search:
            yield search.rows()

    conf, setting = met.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    conf.set(setting, "8")  # blocks are large
    try:
        part = materialise(met.mapInArrow(run, "query_id long, vec_id long, score long"), "topk")
    finally:
        conf.set(setting, before)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def floors(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: every component times ``scale``, floored; vectors that aren't all finite are left out."""
    x = F.transform(vector_col, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    odd = F.exists(vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(odd, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = floors(table(spark, sf_dir, "embeddings"))
    return top_products(v, v.where("vec_id % 50 = 0"), 5)


OP2_SQL = """
WITH e AS (SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product([CAST(v AS DOUBLE) FOR v IN q.x], [CAST(v AS DOUBLE) FOR v IN c.x]) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""
