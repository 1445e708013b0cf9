"""The external assembler: reads to contigs."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession

from seqloom.sources.fastq import numbered, read_fasta
from seqloom.sources.sinks import write_fastq

MIN_SHARE = 0.10


def available(path: str = "megahit") -> bool:
    return shutil.which(path) is not None


def assemble(spark: SparkSession, reads: DataFrame, path: str = "megahit", threads: int = 4, folder: str | None = None) -> DataFrame | None:
    """The contigs, or None if the program is missing or fails."""
    if not available(path):
        return None
    work = folder or tempfile.mkdtemp()
    source, out = os.path.join(work, "reads.fastq"), os.path.join(work, "out")
    write_fastq(reads, source)
    # The assembler's options.
    command = [path, "--read", source, "--min-count", "1", "--k-min", "21", "--k-step", "10", "--out-dir", out, "--num-cpu-threads", str(threads)]
    if subprocess.run(command, capture_output=True).returncode:
        return None
    return numbered(read_fasta(spark, os.path.join(out, "final.contigs.fa")))


def worth_using(contigs: DataFrame, reads: DataFrame) -> bool:
    """Whether contigs hold over a tenth of the reads' bases."""
    bases = lambda df: df.selectExpr("coalesce(sum(length(seq)), 0) as n").first().n
    total = bases(reads)
    return total > 0 and bases(contigs) / total > MIN_SHARE
