"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last give
back the columns of ``documents``.  A stage works on all rows that its predecessor
kept.  ``run`` writes each stage's result to the shared scratch folder and rereads it
for the next, so that a lost executor repeats one stage's tasks at most.

No SQL twin: the classifier and the near-duplicate stage cannot be expressed in SQL;
``tests/llm`` compares the stages with brute force.

Every stage handles a null in any column, empty and very long texts, repeated rows, an
empty table and further columns (which it leaves out): a null text is scored and
deduplicated as empty, stays null through the cuts and is packed as the end id alone;
a null id is an id like any other, the last among equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlytics.llm import exact, minhash, packing, quality, suffix
from postlytics.llm.common import held_out, store
from postlytics.llm.queries import vocabulary
from postlytics.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of rows that are not
    held out, scores 0.7 or more."""
    net = quality.fit_quality(docs.where(~held_out(F.col("doc_id"))), load(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(*COLUMNS), net).where(F.col("score") >= quality.ACCEPT).select(*COLUMNS)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the longest, then the smallest id; rows
    that repeat an id and text are one."""
    docs = docs.select(*COLUMNS)
    decided = exact.exact_dedup(docs, carry={"_key": F.xxhash64("text")}).where("kept").select(
        F.col("doc_id").alias("_id"), "_key")
    return _rows(docs.withColumn("_x", F.xxhash64("text")), "_x", decided).dropDuplicates(["doc_id", "_x"]).select(*COLUMNS)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    docs = docs.select(*COLUMNS)
    decided = minhash.near_classes(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return _rows(docs.withColumn("_x", minhash.text_key(F.col("text"))), "_x", decided).select(*COLUMNS)


def _rows(docs: DataFrame, key: str, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (_id, _key) names."""
    return docs.join(decided, docs["doc_id"].eqNullSafe(decided["_id"]) & docs[key].eqNullSafe(decided["_key"]), "left_semi")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes or more that stand anywhere else too.  A
    character that a cut has split goes; a text that is all repeated stays, empty."""
    docs = docs.select(*COLUMNS).withColumn("_none", F.col("text").isNull())
    cut = suffix.remove_repeats(docs, carry=["lang", "source", "_none"], whole_chars=True)
    return (cut.withColumn("text", F.when(~F.col("_none"), F.col("kept").cast("string")))
            .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences, with their ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), keep_table=False)


STAGES = [("quality classifier", good_quality), ("exact dedup", one_of_equal), ("near-duplicates", one_of_near),
          ("suffix-array dedup", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
