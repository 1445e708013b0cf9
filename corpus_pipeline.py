"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

1. quality_classifier: trains the passage-attention classifier on its input and its labels, and drops the documents that
   it rejects.
2. line_dedup: drops repeated long lines; texts and n_chars change, no row goes.
3. ngram_join: keeps one document, the one with the smallest id, of each class of near duplicates.
4. mixing: puts the rows in the order of the mix; no row goes.
5. sentencepiece: encodes each text, decodes the ids, and gives doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import chosen_path, line_dedup, mixing, pieces, quality_mil
from seqloom.llm.common import checkpoint, table
from seqloom.session import configure


def stage(f):
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(configure(spark), docs, sf_dir)

    return run


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_mil.keep_good(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_first(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mix_order(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this stage needs it

    return pieces.piece_digests(docs, public_tokenizers.path(pieces.MODEL))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the classifier and the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
