"""Language ID, near-duplicates, benchmark decontamination, source mixing and sharding over documents.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next one's docs. All but the last return the columns of documents; other columns of
docs, whatever they are named, are left out. Every stage decides row by row: rows that repeat are rows of their own, and
rows without an id are not mixed up. Very long texts are read whole. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.decontamination import decontaminated
from panelyard.llm.language import UNKNOWN, identified, train
from panelyard.llm.minhash_join import similar_documents
from panelyard.llm.mixing import mixed
from panelyard.llm.shared import dropped, written
from panelyard.llm.sharding import sharded

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is not recognised; all others stay, whatever their language.

    Null and empty texts have no letter and go. Documents without a lang teach nothing but are judged as all others;
    where none has one, there is no language to recognise and all go. Rows with equal texts share their fate.
    """
    docs = docs.select(*COLUMNS)
    found = identified(docs, train(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: five-word shingles, similarity of 0.8 or more.

    The row of the smallest id stays, one without an id only where all are, and of equal ids the first in the table.
    Null texts and texts without a word are no copies of anything and stay. docs is read several times and its rows are matched by their place, as in mixed().
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    found = similar_documents(placed.select(key.alias("key"), "text"), shingle=5, threshold=0.8, id_col="key")
    gone = written(found.where(~F.col("kept")).select(F.col("key.row").alias("_row")), "copies")
    return placed.join(gone, "_row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null, empty and wordless texts hold none and stay; null and wordless items are in no document; an empty benchmark
    drops nothing. Rows with equal texts share their fate.
    """
    return decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources reach their target weights; a row per copy taken.

    A null source is a source. Texts without a word have no size and follow their source's fraction by chance. Rows that
    repeat are rounded one by one. The targets are those of mixed_copies().
    """
    return mixed(docs.select(*COLUMNS))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy: doc_id, size, text_crc32, shard, slot. Null texts are empty; equal texts, null ids or not, share a shard."""
    return sharded(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier, the join's trees and the mix's random choices have no SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
