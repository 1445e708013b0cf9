"""Whole runs: from files of reads to cluster statistics and exports."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.config import Options
from seqloom.functions.sequence import gc_content
from seqloom.operators import damage, em, matrix, pairs, qc, report
from seqloom.sources import assembler, bam, fastq, files, sinks
from seqloom.storage import checkpoint

log = logging.getLogger(__name__)
DASHBOARD = "dashboard"  # the folder of its files
DAMAGE = ("damage5", "damage3", "combined")


@dataclass
class Result:
    rows: DataFrame  # a row a read, with cluster and measures
    stats: DataFrame  # a row a cluster, with taxonomy
    components: DataFrame  # read_idx, x
    explained: tuple[list[float], list[float]]  # percentages of the retained, and of the whole variance


def load(spark: SparkSession, options: Options) -> DataFrame:
    """read_idx, id, seq, quality of the reads that pass quality control."""
    if options.fastq:
        files.file_type(options.fastq)
        return fastq.numbered(qc.long_enough(fastq.read_fastq(spark, options.fastq), options.min_length)).select("read_idx", "id", "seq", "quality")
    files.file_type(options.bam)
    records = qc.passed_alignments(bam.read_bam(spark, options.bam, columns=["nr", "id", "seq", "quality", *bam.FLAGS, "length"]), options.bam_filter, options.min_length)
    return fastq.numbered(records).select("read_idx", "id", "seq", "quality")


def measured(reads: DataFrame, window: int) -> DataFrame:
    """The reads with GC and damage, as columns; no side tables, so no joins by id."""
    return damage.measured(reads.withColumn("gc", gc_content(F.col("seq"))), window, DAMAGE)


def _finish(rows: DataFrame, stats: DataFrame, options: Options) -> None:
    sinks.write_report(stats, options.output)
    if options.export_clusters:
        zipped, as_bam = options.export_output.endswith(".zip"), bool(options.bam) and options.export_format == "same"
        if as_bam and zipped:
            sinks.write_bam_clusters(options.bam, rows, stats, options.export_output, options.export_min_size)
        elif as_bam:
            sinks.write_bam_parts(options.bam, rows, stats, files.address(options.export_output), options.export_min_size)
        elif not zipped:
            sinks.write_cluster_files(rows, stats, options.export_output, options.export_format, options.export_with_metadata, options.export_min_size)
        else:
            sinks.write_clusters(rows, stats, options.export_output, options.export_format, options.export_with_metadata, options.export_min_size)


def run_em(spark: SparkSession, options: Options) -> Result:
    """Features, components, k-means, then EM over tetranucleotide profiles; of contigs where an assembly is worth it."""
    reads = checkpoint(measured(load(spark, options), options.damage_window))
    if reads.isEmpty():
        raise ValueError("no read passed quality control")
    units = reads
    if options.assemble:
        contigs = assembler.assemble(spark, reads, options.megahit_path)
        if contigs is None:
            log.warning("no assembly; reads are clustered")
        elif assembler.worth_using(contigs, reads):
            units = contigs.select("read_idx", "seq")
    components, retained, every = matrix.principal_components(matrix.features18(units), options.pca_components, scaled=True)
    start = units.select("read_idx", "seq").join(matrix.k_means(components, options.n_init_clusters, options.seed), "read_idx")
    model = em.em(start, 4, options.min_cluster_size, options.em_iterations, options.em_convergence)
    clusters = em.assignments(reads, model) if units is reads else em.map_reads(reads, model)
    rows = checkpoint(reads.join(clusters, "read_idx"))
    stats = checkpoint(report.cluster_stats(rows).withColumn("taxonomy", F.lit("Unassigned")))
    _finish(rows, stats, options)
    if options.dashboard:
        log.warning("the dashboard belongs to the legacy pipeline")
    return Result(rows, stats, components, report.explained_percent(list(retained), list(every)))


def run_legacy(spark: SparkSession, options: Options) -> Result:
    """K-mer, codon and damage features, components and k-means."""
    reads = checkpoint(measured(load(spark, options), options.damage_window))
    if reads.isEmpty():
        raise ValueError("no read passed quality control")
    supported = reads.join(pairs.support_of_reads(reads.select("read_idx", "id", "seq")).groupBy("id").agg(F.max("support").alias("support")), "id", "left")
    features = matrix.legacy_features(supported, options.k, options.use_codon, options.damage_window)
    components, retained, every = matrix.principal_components(features, options.pca_components, width=matrix.legacy_width(options.k, options.use_codon))
    rows = checkpoint(reads.join(matrix.k_means(components, options.n_init_clusters, options.seed), "read_idx"))
    stats = report.cluster_stats(rows)
    stats = checkpoint(stats.withColumn("taxonomy", report.taxonomy(F.col("cluster"), F.col("avg_gc"), F.col("avg_damage"), options.damage_threshold)))
    _finish(rows, stats, options)
    explained = report.explained_percent(list(retained), list(every))
    if options.dashboard:
        sinks.write_dashboard(rows, stats, components, [float(v) for v in explained[0]], len(every), DASHBOARD)
    return Result(rows, stats, components, explained)


def run(spark: SparkSession, options: Options) -> Result:
    return (run_legacy if options.legacy else run_em)(spark, options.checked())
