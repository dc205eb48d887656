"""A corpus from raw documents to packed sequences: quality, exact copies, near copies, repeated strings, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Stages but the last return the
columns of ``documents``. A stage's scratch tables are deleted when the next stage starts, so what a stage returns has
to be written before (``run`` does that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from leafmill.llm.common import clear_scratch, delete, store, table

#: A document goes if its quality score is below this.
LEAST_QUALITY = 0.5

#: Texts are near copies if so large a share of their five-word shingles is common.
NEAR = 0.8

#: Bytes of a string that is cut out where it repeats: about 50 short words, so that any passage of over 50 words that
#: texts share holds one. (The operator's own default of 400 bytes is longer than many such passages.)
REPEAT = 240

#: SQL can't express the trained first stage.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier finds good; it learns from the labelled rows of ``docs``."""
    clear_scratch(spark)
    model = quality.learn(spark, docs, sf_dir)
    return quality.filter_documents(docs, model, LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    clear_scratch(spark)
    return exact_dedup.keep_first(docs, exact_dedup.default_snapshot())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each component of near fingerprints, or similar sets, of five-word shingles."""
    clear_scratch(spark)
    return simhash.keep_first(docs, words=5, similarity=NEAR)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEAT`` bytes that also start elsewhere; a text that is used up stays, empty."""
    clear_scratch(spark)
    return suffix_dedup.rewrite(docs, REPEAT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words go: bins of several sizes."""
    clear_scratch(spark)
    return packing.pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), packing.word_count(F.col("text")).alias("n_tokens")))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
        if before:
            delete(spark, before)
        before = path
    clear_scratch(spark)
    return docs
