"""Sinks: report, archives of clusters, dashboard."""

from __future__ import annotations

import csv
import http.server
import io
import json
import os
import shutil
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import gc_content
from seqloom.operators import report
from seqloom.sources import bam
from seqloom.storage import shared_folder

DEFAULT_QUALITY = "/"


def write_report(stats: DataFrame, path: str) -> None:
    """One CSV file of the clusters, by number. The table has one row a cluster."""
    rows = report.report_rows(stats.orderBy("cluster")).toLocalIterator()
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerow(report.REPORT)
        writer.writerows(rows)


def fasta_text(metadata: bool):
    """The record of a read as a Column: header with its cluster, and its measures if asked for; sequence."""
    three = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)))
    header = [F.lit(">"), F.col("id"), F.lit(" cluster="), F.col("cluster").cast("string")]
    if metadata:
        header += [F.lit(" gc="), three(gc_content(F.col("seq")))]
        for name in ("damage5", "damage3", "combined"):
            header += [F.lit(f" {name}="), three(F.col(name))]
    return F.concat(*header, F.lit("\n"), F.col("seq"), F.lit("\n"))


def fastq_text(metadata: bool):
    """Four lines; without qualities, the default score at every base. Scores that no character stands for become null."""
    scores = F.array_join(F.transform(F.col("quality"), lambda q: F.when(q.between(0, 93), F.char(q.cast("long") + 33))), "")
    good = F.forall(F.col("quality"), lambda q: q.between(0, 93))
    quality = F.when(F.col("quality").isNotNull() & good, scores).otherwise(F.repeat(F.lit(DEFAULT_QUALITY), F.length("seq")))
    tail = [F.lit(" cluster="), F.col("cluster").cast("string")] if metadata else []
    return F.concat(F.lit("@"), F.col("id"), *tail, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), quality, F.lit("\n"))


def exported_reads(reads: DataFrame, stats: DataFrame, min_size: int, extension: str) -> DataFrame:
    """The reads of the clusters to export, with the name of their file."""
    chosen = report.exported(stats, min_size).select("cluster", report.export_name(extension).alias("file"))
    return reads.join(chosen, "cluster")


def write_cluster_files(reads: DataFrame, stats: DataFrame, folder: str, export_format: str = "same", metadata: bool = False, min_size: int = 0) -> None:
    """A folder `file=<name>` for each cluster, with FASTA or FASTQ text in parts whose names are in the order of the reads.
    The executors write them: ranges of cluster and read, so that a large cluster has many writers."""
    fasta = export_format == "fasta"
    text = F.expr("substr(text, 1, length(text) - 1)")  # the writer ends a record's last line
    rows = exported_reads(reads, stats, min_size, "fa" if fasta else "fastq").select("file", "read_idx", (fasta_text(metadata) if fasta else fastq_text(metadata)).alias("text"))
    rows = rows.repartitionByRange("file", "read_idx").sortWithinPartitions("file", "read_idx").select("file", text.alias("value"))
    rows.write.partitionBy("file").text(folder)


def write_clusters(reads: DataFrame, stats: DataFrame, path: str, export_format: str = "same", metadata: bool = False, min_size: int = 0) -> int:
    """A zip with one FASTA (.fa) or FASTQ file for each cluster, in the order of clusters; the number of files. The
    executors write the parts to the shared folder, and the one writer that an archive has copies them into it."""
    parts = f"{shared_folder(reads.sparkSession)}/clusters-{uuid.uuid4().hex}"
    write_cluster_files(reads, stats, parts, export_format, metadata, min_size)
    store, at = pa_fs.FileSystem.from_uri(parts)
    found: dict[str, list[str]] = {}
    for entry in store.get_file_info(pa_fs.FileSelector(at, recursive=True)):
        folder, name = entry.path.rsplit("/", 2)[-2:]
        if entry.is_file and name.startswith("part-") and folder.startswith("file="):
            found.setdefault(folder.removeprefix("file="), []).append(entry.path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(found, key=lambda f: int(f.split("_")[1])):
            with archive.open(file, "w", force_zip64=True) as out:
                _copy(store, sorted(found[file]), out)
    store.delete_dir(at)
    return len(found)


BAM_PART = "cluster long, file string, nr long, path string"


def write_bam_parts(source: str, clusters: DataFrame, stats: DataFrame, folder: str, min_size: int = 0, whole: bool = True) -> list[tuple[str, bam.Header, list[str]]]:
    """File name, header and part files (in the order of records) of each cluster, in the order of clusters. The source is
    read again by name, so all records that share a kept name go along; mapped ones get the number of their reference in
    the cluster's own header. The executors write the parts: ranges of cluster and record, each a BAM file of its own if
    `whole`, else blocks only. Each attempt of a task writes under new names in `_attempts`; the parts of those that
    succeeded are moved to `<folder>/<file name>/part-<number>.bam` and the rest goes, so lost executors and repeated tasks do
    no harm. A folder that exists is an error."""
    spark = stats.sparkSession
    chosen = exported_reads(clusters.select("id", "cluster").distinct(), stats, min_size, "bam").select("id", "cluster", "file")
    records = bam.read_bam(spark, source, raw=True)
    header = bam.header_of(source)
    tids = {c: own.tolist() for c, own in report.references_by_cluster(records, chosen).items()}
    joined = records.drop("file").join(chosen, "id").select("cluster", "file", "nr", "raw")
    store, at = pa_fs.FileSystem.from_uri(folder)
    if store.get_file_info(at).type != pa_fs.FileType.NotFound:
        raise FileExistsError(folder)
    store.create_dir(f"{at}/_attempts")

    def write(batches):
        target, inner = pa_fs.FileSystem.from_uri(folder)
        opened, done = None, []

        def finish():
            if opened is not None:
                opened[1].close() if whole else opened[1].flush()
                opened[2].close()

        for batch in batches:
            for cluster, file, nr, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if opened is None or opened[0] != cluster:
                    finish()
                    own, numbers = bam.minimal_header(header, tids.get(cluster, []))
                    path = f"{inner}/_attempts/{uuid.uuid4().hex}.bam"
                    stream = target.open_output_stream(path)
                    opened = cluster, bam.BgzfWriter(stream), stream, numbers
                    if whole:
                        opened[1].write(bam.encode_header(own))
                    done.append((cluster, file, nr, path))
                if (data := bam.moved_record(raw, opened[3])) is not None:
                    opened[1].write(data)
        finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["cluster", "file", "nr", "path"])

    rows = joined.selectExpr("cast(cluster as long) as cluster", "file", "nr", "raw").repartitionByRange("cluster", "nr").sortWithinPartitions("cluster", "nr")
    found: dict[tuple[int, str], list[str]] = {}
    for r in sorted(rows.mapInArrow(write, BAM_PART).collect(), key=lambda r: (r.cluster, r.nr)):  # a row a part
        own = found.setdefault((r.cluster, r.file), [])
        if not own:
            store.create_dir(f"{at}/{r.file}")
        own.append(f"{at}/{r.file}/part-{len(own):05d}.bam")
        store.move(r.path, own[-1])
    store.delete_dir(f"{at}/_attempts")
    return [(file, bam.minimal_header(header, tids.get(cluster, []))[0], paths) for (cluster, file), paths in found.items()]


def write_bam_clusters(source: str, clusters: DataFrame, stats: DataFrame, path: str, min_size: int = 0) -> int:
    """A zip with one BAM file for each cluster; the number of files. As in `write_clusters`, the executors write the
    blocks and the archive's one writer copies them."""
    parts = f"{shared_folder(stats.sparkSession)}/clusters-{uuid.uuid4().hex}"
    store, at = pa_fs.FileSystem.from_uri(parts)
    written = write_bam_parts(source, clusters, stats, parts, min_size, whole=False)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file, header, paths in written:
            with archive.open(file, "w", force_zip64=True) as out:
                writer = bam.BgzfWriter(out)
                writer.write(bam.encode_header(header))
                writer.flush()
                _copy(store, paths, out)
                writer.close()
    store.delete_dir(at)
    return len(written)


def _copy(store, paths: list[str], out) -> None:
    for part in paths:
        with store.open_input_stream(part) as stream:
            shutil.copyfileobj(stream, out, 1 << 20)


def write_fastq(reads: DataFrame, path: str) -> None:
    """A FASTQ file for the assembler, which runs on this machine, with the score I at every base; the executors write its
    text in parts."""
    parts = f"{shared_folder(reads.sparkSession)}/fastq-{uuid.uuid4().hex}"
    text = F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    reads.select(text.alias("value")).write.text(parts)
    store, at = pa_fs.FileSystem.from_uri(parts)
    with open(path, "wb") as out:
        _copy(store, sorted(e.path for e in store.get_file_info(pa_fs.FileSelector(at)) if e.base_name.startswith("part-")), out)
    store.delete_dir(at)


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Clusters</title><style>body{font-family:sans-serif;margin:2em}td,th{padding:.2em .8em;text-align:right}canvas{border:1px solid #ccc;margin:.5em 0}</style></head>
<body><h1>Clusters</h1><p id="totals"></p><p id="variance"></p><label>Smallest cluster <input id="least" type="number" value="5"></label>
<h2>Components 1 and 2</h2><label>Colour <select id="colour"><option value="cluster">Cluster<option value="damage">Damage<option value="gc">GC</select></label><br><canvas id="scatter" width="640" height="640"></canvas><p id="scale"></p>
<h2>Damage scores</h2><canvas id="damage" width="640" height="240"></canvas><p>Red: 5' end; blue: 3' end; 0 to 1</p><table id="rows"></table>
<script>const data = __DATA__;
const field = id => document.getElementById(id);
const shown = c => c.cluster === -1 || data.clusters.some(k => k.cluster === c.cluster && k.num_reads >= +field("least").value);
const hue = c => c === -1 ? "#000" : "hsl(" + (c * 137.5) % 360 + ",70%,45%)";
const heat = v => "hsl(" + (260 - 200 * v) + ",80%," + (25 + 35 * v) + "%)";
function scatter() {
  const by = field("colour").value, pen = field("scatter").getContext("2d"), kept = data.cells.filter(shown), step = 640 / data.grid;
  const values = kept.map(c => c[by]), low = Math.min(...values), span = Math.max(...values) - low || 1, most = Math.log1p(Math.max(1, ...kept.map(c => c.n)));
  pen.clearRect(0, 0, 640, 640);
  for (const c of kept) {
    pen.fillStyle = by === "cluster" ? hue(c.cluster) : heat((c[by] - low) / span);
    const size = step * (0.4 + 0.6 * Math.log1p(c.n) / most);
    pen.fillRect(c.cell_x * step + (step - size) / 2, 640 - (c.cell_y + 1) * step + (step - size) / 2, size, size);
  }
  field("scale").textContent = kept.length === 0 || by === "cluster" ? "" : by + " from " + low.toFixed(4) + " to " + (low + span).toFixed(4);
}
function histogram() {
  const pen = field("damage").getContext("2d"), most = Math.max(1, ...data.histogram.map(b => b.n)), width = 640 / data.bins;
  for (const b of data.histogram) {
    pen.fillStyle = b.end === 5 ? "rgba(220,60,60,.5)" : "rgba(60,90,220,.5)";
    pen.fillRect(b.bin * width + 1, 240 - 236 * b.n / most, width - 2, 236 * b.n / most);
  }
}
function show() {
  const kept = data.clusters.filter(shown), largest = Math.max(1, ...kept.filter(c => c.cluster !== -1).map(c => c.num_reads));
  field("totals").textContent = data.reads + " reads in " + data.n_clusters + " clusters, " + data.noise_percent.toFixed(2) + "% noise, mean damage " + data.mean_damage.toFixed(4) + ", " + data.features + " features";
  field("variance").textContent = "Explained variance: " + data.explained.map((v, i) => "PC" + (i + 1) + " " + v.toFixed(2) + "%").join(", ");
  field("rows").innerHTML = "<tr><th>Label<th>Reads<th>Percent of largest<th>GC<th>Damage" + kept.sort((a, b) => b.num_reads - a.num_reads).map(c =>
    "<tr><td>" + [c.label, c.num_reads, (100 * c.num_reads / largest).toFixed(1), c.avg_gc, c.avg_damage].join("<td>")).join("");
  scatter();
}
field("least").onchange = show;
field("colour").onchange = scatter;
histogram();
show();</script></body></html>"""
GRID, BINS = 64, 30


def write_dashboard(rows: DataFrame, stats: DataFrame, components: DataFrame, explained: list[float], features: int, folder: str) -> str:
    """data.json and index.html from aggregates of all reads (`components`: read_idx, x): clusters and totals, cells of the
    scatter, histograms of damage. No read leaves the executors."""
    payload = json.loads(report.dashboard_json(rows, stats).first().json)
    totals = report.global_summary(rows).first()
    cells = report.scatter_cells(rows.select("read_idx", "cluster", "gc", "combined").join(components.select("read_idx", "x"), "read_idx"), GRID)
    payload |= {
        "noise_percent": totals.noise_percent or 0.0, "mean_damage": totals.mean_damage or 0.0, "explained": explained, "features": features, "grid": GRID, "bins": BINS,
        "cells": [r.asDict() for r in cells.orderBy("cluster", "cell_x", "cell_y").collect()],
        "histogram": [r.asDict() for r in report.damage_histogram(rows, BINS).orderBy("end", "bin").collect()],
    }
    text = json.dumps(payload)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "data.json"), "w") as f:
        f.write(text)
    page = os.path.join(folder, "index.html")
    with open(page, "w") as f:
        f.write(PAGE.replace("__DATA__", text.replace("</", "<\\/")))
    return page


def serve(folder: str, port: int = 8080) -> http.server.ThreadingHTTPServer:
    """A server of the folder on this machine; the caller runs and stops it."""
    handler = lambda *a, **k: http.server.SimpleHTTPRequestHandler(*a, directory=folder, **k)
    return http.server.ThreadingHTTPServer(("127.0.0.1", port), handler)


def csv_text(stats: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(report.REPORT)
    writer.writerows(report.report_rows(stats.orderBy("cluster")).toLocalIterator())
    return out.getvalue()
