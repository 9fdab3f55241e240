"""The registered queries of the operators, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postlytics.llm import (chat, divergence, exact, lang_id, minhash, packing, pieces, quality, rules, spelling, squares,
                            suffix, warc)
from postlytics.llm.common import held_out, scratch_path
from postlytics.sources.tables import load


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    learned = lang_id.fit_dictionaries(docs.where(~held_out(F.col("doc_id"))))
    found = lang_id.predict_language(docs, learned)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
                        (F.col("lang") != lang_id.UNKNOWN).alias("accepted"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.chat_format(chat.with_planted(load(spark, sf_dir, "conversations"))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_digest(rules.quality_rules(load(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    net = quality.fit_quality(docs.where(~held_out(F.col("doc_id"))), load(spark, sf_dir, "labels"))
    return quality.score_quality(docs, net, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= quality.ACCEPT, 1).otherwise(0).alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_digest(suffix.remove_repeats(load(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(packing.pack(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return exact.exact_dedup(docs, carry={"text_sha256": F.sha2(exact.normalised(F.col("text")), 256)})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(load(spark, sf_dir, "pages"), path)
    return warc.warc_digest(warc.read_warc(spark, path))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(load(spark, sf_dir, "documents")).drop("text_key")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    return pieces.pieces_digest(pieces.encode_pieces(load(spark, sf_dir, "documents"), path, decoded=True), path)


def op11_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares.pack_squares(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"),
                                carry={"ids_crc32": F.crc32("ids")})


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(load(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(load(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_language_id, op2_chat_format, op3_quality_rules, op4_quality_classifier, op5_suffix_dedup, op6_packing, op7_exact_dedup, op8_warc,
        op9_near_duplicates, op10_sentencepiece, op11_squares_packing, op12_spelling_variants, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.CHAT_SQL, "op3_quality_rules": rules.RULES_SQL, "op7_exact_dedup": exact.EXACT_SQL,
            "op8_warc": warc.WARC_SQL, "op12_spelling_variants": spelling.SPELLING_SQL, "op13_source_divergence": divergence.DIVERGENCE_SQL}
