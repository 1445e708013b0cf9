"""Reads derived from the documents table, and mates derived from the reads, for queries that run over tables.

Letters stand for bases; all letters of a document are cut into windows of 12 to 151 bases, one every 100 bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ATGCATCGACGTTCAGNATCGACNGN"
MIN_LENGTH, STEP = 30, 100
#: Bytes of a row group, by default of Spark's writer.
ROW_GROUP = 128 << 20


def spread(table: DataFrame) -> DataFrame:
    """The rows dealt over all cores if the table's files are too small to give each core a row group of its own; beyond that
    size the scan's own splits do, and nothing is shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * ROW_GROUP else table


def all_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_idx, doc_id, source, id, seq."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    dna = docs.select("doc_id", "source", F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), LETTERS, BASES).alias("s"))
    # Pieces of 100 are cut once: a read lies in two of them, and a place in the text would be found from its start each time.
    pieces = dna.select("doc_id", "source", F.regexp_extract_all("s", F.lit(f".{{1,{STEP}}}"), F.lit(0)).alias("p"))
    two = F.transform("p", lambda x, i: F.concat(x, F.coalesce(F.get("p", i + 1), F.lit(""))))
    cut = pieces.select("doc_id", "source", F.posexplode(two).alias("j", "two"))
    return cut.select(
        (F.col("doc_id") * 1_000_000 + F.col("j")).alias("read_idx"), "doc_id", "source",
        F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit("_"), F.col("j").cast("string")).alias("id"),
        F.substr("two", F.lit(1), (12 + (F.col("doc_id") * 37 + F.col("j") * 53) % 140).cast("int")).alias("seq"),
    )


def reads(spark: SparkSession, sf_dir: str, min_length: int = MIN_LENGTH) -> DataFrame:
    return all_reads(spark, sf_dir).where(F.length("seq") >= min_length)


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and seq of both mates: the read, and the reverse complement of a copy with planted terminal changes."""
    r, seq = reads(spark, sf_dir), F.col("seq")
    first, last = F.substr(seq, F.lit(1), F.lit(1)), F.right(seq, F.lit(1))
    damaged = F.concat(
        F.when(first == "T", "C").otherwise(first), F.substr(seq, F.lit(2), F.lit(18)),
        F.when(F.col("doc_id") % 3 == 0, "A").otherwise(F.substr(seq, F.lit(20), F.lit(1))),
        F.substr(seq, F.lit(21), F.length(seq) - 21), F.when(last == "A", "G").otherwise(last),
    )
    one = F.struct(F.concat("id", F.lit("/1")).alias("id"), seq.alias("seq"))
    two = F.struct(F.concat("id", F.lit("/2")).alias("id"), F.reverse(F.translate(damaged, "ACGTN", "TGCAN")).alias("seq"))
    return r.select(F.explode(F.array(one, two)).alias("mate")).select("mate.*")


def quality_string() -> Column:
    """Printable qualities of a derived read: score (7 position + doc_id) mod 41, position from 0."""
    score = lambda i: F.char((i * 7 + F.col("doc_id")) % 41 + 33)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length("seq") - 1), score), "")


def bin_of(gc: Column) -> Column:
    """A fixed start for clusters: -1 below a GC share of 0.2, then one cluster for each step of 0.08."""
    return F.when(gc < 0.2, F.lit(-1)).otherwise(F.floor((gc - 0.2) / 0.08).cast("int"))


ORACLE_READS = f"""
all_reads AS (
  SELECT doc_id * 1000000 + j AS read_idx, doc_id, source, concat('r', doc_id::VARCHAR, '_', j::VARCHAR) AS id,
         substr(s, 1 + j * 100, (12 + (doc_id * 37 + j * 53) % 140)) AS seq
  FROM (SELECT doc_id, source, s, unnest(range(0, (length(s) - 1) // 100 + 1)) AS j
        FROM (SELECT doc_id, source, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS s FROM documents)
        WHERE length(s) > 0)),
reads AS (SELECT * FROM all_reads WHERE length(seq) >= {MIN_LENGTH})"""

ORACLE_MATES = """
damaged AS (
  SELECT id, seq, concat(CASE WHEN substr(seq, 1, 1) = 'T' THEN 'C' ELSE substr(seq, 1, 1) END, substr(seq, 2, 18),
         CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE substr(seq, 20, 1) END, substr(seq, 21, length(seq) - 21),
         CASE WHEN right(seq, 1) = 'A' THEN 'G' ELSE right(seq, 1) END) AS d FROM reads),
mates AS (
  SELECT concat(id, '/1') AS id, seq FROM damaged UNION ALL
  SELECT concat(id, '/2') AS id, reverse(translate(d, 'ACGTN', 'TGCAN')) AS seq FROM damaged)"""

ORACLE_BIN = "CASE WHEN gc < 0.2::DOUBLE THEN -1 ELSE floor((gc - 0.2::DOUBLE) / 0.08::DOUBLE)::INTEGER END"
