"""Shared helpers of the ``llm`` operators: scratch tables, row selection and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of ``[\x20\x09-\x0D]``: the only white space that the dedup and fingerprint contracts know.
ASCII_SPACE = " \t\n\x0b\x0c\r"

_scratch: dict[str, list[str]] = {}
_own_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it names none, a temporary folder serves in local mode, where all tasks run on this machine, until the
    interpreter ends. On a cluster executors wouldn't see each other's files there, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, _own_root[app], ignore_errors=True)
    return "file://" + _own_root[app]


@atexit.register
def _clear_at_exit() -> None:
    """Scratch tables of op queries go with the driver, if its session is still there."""
    session = SparkSession.getActiveSession()
    if session is not None and session.sparkContext._jsc is not None:
        clear_scratch(session)


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet into the shared folder; what reads it back, and where it is."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/leafmill-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``store`` for a scratch table: lineage ends at shared storage, and ``clear_scratch`` deletes it."""
    back, path = store(df, label)
    _scratch.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return back


def delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; call it only once what was built on them is stored."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, whatever else ``docs`` carries."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_hash(text_col: str = "text") -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, twice: DataFrame, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` but for the rows in ``gone``, and with those in ``twice`` once; both name rows by ``doc_id, th``.

    All columns are kept. The side that names rows is broadcast up to ``bound`` rows (16 bytes each).
    """
    named = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__th", text_hash(text_col))

    def side(df: DataFrame) -> DataFrame:
        df = df.select(F.col("doc_id").alias("__i"), F.col("th").alias("__h")).distinct()
        return F.broadcast(df) if df.count() <= bound else df

    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__th") == F.col("__h"))
    left = named.join(side(gone), on, "left_anti")
    if twice.limit(1).count():
        again = side(twice)
        once = left.join(again, on, "left_semi").dropDuplicates(["__id", "__th"])
        left = left.join(again, on, "left_anti").unionByName(once)
    return left.select(docs.columns)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches hold whole texts, so a batch is kept to a few hundred of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Connected components of undirected ``edges`` of longs: one row ``(node, root)`` for each node with an edge.

    Alternating star contraction: every pass joins neighbours to the least one seen from a node, so a hub never
    gathers its neighbours in one task (``min`` is combined map-side, the join back can be split). ``root`` is the
    least node of the component. No edges give no rows; self-loops and repeated edges are ignored.
    """
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    now = materialise(now, "edges")
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
        state = tuple(seen)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        small = small.where("a <> b").union(least.select("u", "m")).distinct()
        now = materialise(small.toDF("u", "v"), "edges")
