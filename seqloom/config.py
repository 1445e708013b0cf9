"""Options of a run, with the defaults that hold when an option is missing or does not parse."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    fastq: str | None = None
    bam: str | None = None
    bam_filter: str = "all"  # all, mapped, unmapped
    output: str = "cluster_report.csv"
    dashboard: bool = False
    min_length: int = 30
    k: int = 4  # legacy pipeline only; the EM pipeline always takes 4
    use_codon: bool = False
    damage_window: int = 5
    pca_components: int = 8
    batch_size: int = 1000  # accepted; the covariance is exact whatever the batches
    n_init_clusters: int = 15
    sim_threshold: float = 0.5  # accepted, without effect
    conf_threshold: float = 0.1  # accepted, without effect
    damage_threshold: float = 0.5
    export_clusters: bool = False
    export_min_size: int = 0
    export_format: str = "same"  # same, fasta, fastq
    export_output: str = "exported_clusters.zip"
    export_with_metadata: bool = False
    em_iterations: int = 20
    em_convergence: float = 0.001
    min_cluster_size: int = 10
    merge_threshold: float = 0.05  # accepted, without effect
    assemble: bool = False
    megahit_path: str = "megahit"
    legacy: bool = False
    seed: int = 42

    def checked(self) -> Options:
        if (self.fastq is None) == (self.bam is None):
            raise ValueError("give exactly one of --fastq and --bam")
        if self.pca_components > 20:
            raise ValueError("--pca_components must be 20 at most")
        if self.bam_filter not in ("all", "mapped", "unmapped"):
            raise ValueError("--bam-filter is all, mapped or unmapped")
        return self


DASHED = {"bam_filter", "n_init_clusters", "export_clusters", "export_min_size", "export_format", "export_output", "export_with_metadata", "em_iterations", "em_convergence", "min_cluster_size", "merge_threshold", "megahit_path"}


def _lenient(kind: type, default):
    def read(text: str):
        try:
            return kind(text)
        except ValueError:
            return default

    return read


def parse(argv: list[str] | None = None) -> Options:
    """Options from the command line; numbers that do not parse take their default."""
    parser = argparse.ArgumentParser(prog="seqloom", description="Reference-free analysis of sequencing reads on Spark.")
    for f in fields(Options):
        flag = "--" + (f.name.replace("_", "-") if f.name in DASHED else f.name)
        if isinstance(f.default, bool):
            parser.add_argument(flag, dest=f.name, action="store_true")
        elif isinstance(f.default, (int, float)):
            parser.add_argument(flag, dest=f.name, type=_lenient(type(f.default), f.default), default=f.default)
        else:
            parser.add_argument(flag, dest=f.name, default=f.default)
    return Options(**vars(parser.parse_args(sys.argv[1:] if argv is None else argv))).checked()
