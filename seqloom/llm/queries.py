"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import ball_kmeans, byte_pairs, chosen_path, language_id, line_dedup, mixing, oracles, pieces, pii, quality_mil, quality_rules, spelling, tiff, token_counts
from seqloom.llm.common import table

TOKEN_LIMIT = 512


def op1_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(pieces.MODEL))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_mil.quality_scores(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_mil.held_out().alias("held_out"), "score", (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("doc", "doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))  # the text only breaks ties of ids
    placed = mixing.place_documents(docs, names=["block", "seq", "slot", "release", "deadline"])
    return placed.select("doc_id", "source", "block", "seq", "slot", "release", "deadline")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.byte_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(byte_pairs.MODEL))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_media_tiff, op2_token_counts, op3_sentencepiece, op4_pii, op5_quality_mil, op6_ngram_join, op7_language_id, op8_line_dedup, op9_pfair_mix, op10_quality_rules)}
QUERIES |= {f.__name__: f for f in (op11_byte_pairs, op12_spelling_variants, op13_ball_kmeans)}
ORACLES: dict[str, str] = {
    "op8_line_dedup": oracles.OP8,
    "op9_pfair_mix": oracles.OP9,
    "op10_quality_rules": oracles.op10(quality_rules.RULES, quality_rules.ALPHA, quality_rules.DELTA),
    "op12_spelling_variants": oracles.OP12,
    "op13_ball_kmeans": oracles.op13(ball_kmeans.CLUSTERS, ball_kmeans.ROUNDS, ball_kmeans.SCALE, ball_kmeans.DIMENSIONS, ball_kmeans.SEED),
}
