"""File access for sources and sinks: local or shared paths, and any address that pyarrow's file systems know."""

from __future__ import annotations

import glob
import os

import pyarrow.fs as pafs

EXTENSIONS = {"fastq": "fastq", "fq": "fastq", "bam": "bam"}


def listing(path: str) -> list[tuple[str, int]]:
    """Files and sizes: one file, all files of a folder, or a local pattern."""
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        prefix = path[: len(path) - len(inner)]
        info = system.get_file_info(inner)
        infos = system.get_file_info(pafs.FileSelector(inner)) if info.type == pafs.FileType.Directory else [info]
        found = [(prefix + i.path, i.size) for i in infos if i.type == pafs.FileType.File]
    else:
        names = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path))
        found = [(n, os.path.getsize(n)) for n in names if os.path.isfile(n)]
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def opened(path: str):
    """A binary stream."""
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def address(path: str) -> str:
    """The path as pyarrow's file systems take it."""
    return path if "://" in path else os.path.abspath(path)


def file_type(path: str) -> str:
    """fastq or bam, by the extension (in lower case); a bam file has to begin as one. Anything else is an error."""
    from seqloom.sources.bam import is_bam

    extension = os.path.basename(path).rpartition(".")
    kind = EXTENSIONS.get(extension[2]) if extension[1] else None
    if kind is None:
        raise ValueError(f"unknown file type: {path}")
    if kind == "bam" and not is_bam(path):
        raise ValueError(f"not a BAM file: {path}")
    return kind
