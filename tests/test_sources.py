"""File sources and sinks with small files."""

import gzip
import io
import json
import threading
import urllib.request
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.config import Options
from seqloom.operators import qc, report
from seqloom.plans import pipelines
from seqloom.sources import assembler, bam, fastq, files, sinks

READ = "ACGTTGCATTGACCATGACTTGACGTACCATGACGT"


def record(name, seq=READ, quality=None):
    return f"@{name}\n{seq}\n+\n{quality or 'I' * len(seq)}\n"


def ids(df):
    return [r.id for r in df.orderBy("nr").collect()]


def test_fastq_fixtures(spark, tmp_path):
    cases = {
        "ok": (record("a") + record("b", "ACGT") + record("c"), ["a", "b", "c"]), "junk": (record("a") + "stray\n" + record("b"), ["a", "b"]),
        "cut": (record("a") + f"@b\n{READ}\n+\n", ["a"]), "comment": (record("id extra words"), ["id"]), "nohdr": (record(""), ["unknown"]), "dup": (record("a") + record("a"), ["a", "a"]),
    }
    for name, (text, expected) in cases.items():
        (tmp_path / f"{name}.fastq").write_text(text)
        assert ids(fastq.read_fastq(spark, str(tmp_path / f"{name}.fastq"))) == expected
    row = fastq.read_fastq(spark, str(tmp_path / "ok.fastq")).first()
    assert row.quality == [40] * len(READ) and row.seq == READ
    assert qc.long_enough(fastq.read_fastq(spark, str(tmp_path / "ok.fastq"))).count() == 2
    counted = fastq.numbered(fastq.read_fastq(spark, str(tmp_path / "dup.fastq")))
    assert counted.select("read_idx").distinct().count() == 2


def test_fastq_is_cut_into_ranges(spark, tmp_path):
    path = tmp_path / "many.fastq"
    path.write_text("".join(record(f"r{i}", READ[: 5 + i % 30], "@" * (5 + i % 30)) for i in range(500)))
    spark.dataSource.register(fastq.FastqSource)
    df = spark.read.format("fastq").option("rangebytes", "1000").load(str(path))
    assert df.rdd.getNumPartitions() > 10
    assert sorted(r.id for r in df.collect()) == sorted(f"r{i}" for i in range(500))


PIECES = st.sampled_from([record("a"), record("b", "AC", "@!"), record("c x", "ACGTN", "@@@@@"), "@d\nACGT\n+\n", "@e\n", "stray\n", "@\n\n+\n\n", "\n", "@f\r\nAC\r\n+\r\nII\r\n", "@g\nAC\n+\n I\n", "+\n@\n", "@h\n@CC\n@x\n@II\n", "@é\tz\nAé\n+\n!é\n", "@k\nAC\n+\n\x1fI\n", " @m\n"])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30), st.integers(1, 90), st.integers(1, 200), st.booleans(), st.booleans())
def test_ranges_do_not_change_records(pieces, size, block, bad, open_end):
    """Any damage and any cut: the records of all ranges are those of the line-by-line reader, in order."""
    raw = "".join(pieces).encode()
    raw = raw[:-1] if open_end else raw
    expected = [(n, *r) for n, *r in fastq.fastq_records(fastq.lines(io.BytesIO(raw)), bad)]
    found = []
    stream = io.BytesIO(raw)
    points = [fastq.sync_point(stream, at, min(at + size, len(raw))) for at in range(0, max(len(raw), 1), size)]
    points = [p for p in points if p is not None]
    assert points == sorted(set(points))
    for begin, end in zip(points, [*points[1:], fastq.LAST]):
        for batch in fastq.fastq_batches(stream, begin, end, "f", 0, bad, block):
            found += [tuple(r.values())[1:] for r in batch.to_pylist()]
    assert found == expected


def test_ranges_of_a_damaged_file(spark, tmp_path):
    whole = "".join(record(f"r{i}", READ[: 5 + i % 30]) + ("stray\n" if i % 17 == 0 else "") for i in range(400)).splitlines(keepends=True)
    del whole[803], whole[401]  # a record without its quality, and one without its header
    (tmp_path / "x.fastq").write_text("".join(whole))
    spark.dataSource.register(fastq.FastqSource)
    expected = sorted((n, i, s) for n, i, s, _ in fastq.fastq_records(fastq.lines(io.BytesIO("".join(whole).encode()))))
    for size in (60, 333, 1200, 10**6):
        got = spark.read.format("fastq").option("rangebytes", size).load(str(tmp_path / "x.fastq"))
        assert sorted((r.nr, r.id, r.seq) for r in got.select("nr", "id", "seq").collect()) == expected


def test_fasta(spark, tmp_path):
    (tmp_path / "multi.fa").write_text(">a one\nACGT\n\n  TTTT \n>empty\n>\nACGT\n>b\nCC\n")
    rows = fastq.read_fasta(spark, str(tmp_path / "multi.fa")).orderBy("nr").collect()
    assert [(r.id, r.seq, r.quality) for r in rows] == [("a", "ACGTTTTT", None), ("b", "CC", None)]


def test_file_types(tmp_path):
    assert files.file_type("x.fq") == "fastq"
    for name in ("x.FASTQ", "x.fastq.gz", "x"):
        with pytest.raises(ValueError):
            files.file_type(name)
    (tmp_path / "x.bam").write_bytes(b"nothing")
    assert not bam.is_bam(str(tmp_path / "x.bam"))
    with pytest.raises(ValueError):
        files.file_type(str(tmp_path / "x.bam"))


HEADER = bam.Header("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:500\n@SQ\tSN:c2\tLN:700\n@PG\tID:x\n", [("c1", 500), ("c2", 700)])
RECORDS = [("p", 0, 1, 5, 60, READ, [30] * len(READ)), ("p", 0x100, 0, 5, 60, READ, None), ("s", 0x800, 1, 5, 60, READ, [1] * len(READ)), ("u", 4, -1, -1, 0, READ + "N", [2] * (len(READ) + 1)), ("t", 0, 0, 1, 9, "ACGT", [9] * 4)]


def write_bam(path):
    out = io.BytesIO()
    writer = bam.BgzfWriter(out)
    writer.write(bam.encode_header(HEADER))
    for r in RECORDS:
        writer.write(bam.encode_record(*r))
    writer.close()
    path.write_bytes(out.getvalue())
    return str(path)


def test_bam_round_trip(spark, tmp_path):
    path = write_bam(tmp_path / "flags.bam")
    assert bam.is_bam(path) and bam.header_of(path) == HEADER
    rows = bam.read_bam(spark, path).orderBy("nr").collect()
    assert [(r.id, r.flag, r.tid, r.pos, r.mapq, r.seq, r.quality) for r in rows] == RECORDS
    got = qc.alignment_counters(bam.read_bam(spark, path)).first()
    assert (got.total, got.secondary, got.supplementary, got.short, got.passed) == (5, 1, 1, 1, 2)


@pytest.mark.parametrize("filters", ["true", "false"])
def test_bam_filters_reach_the_reader(spark, tmp_path, filters, capsys):
    path = write_bam(tmp_path / "flags.bam")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", filters)
    try:
        records = bam.read_bam(spark, path, columns=["nr", "id", *bam.FLAGS, "length"])
        assert records.columns == ["nr", "id", "secondary", "supplementary", "unmapped", "length"]
        for kind, expected in (("all", ["p", "u"]), ("mapped", ["p"]), ("unmapped", ["u"])):
            assert ids(qc.passed_alignments(records, kind)) == expected
        passed = qc.passed_alignments(bam.read_bam(spark, path), "mapped")
        assert [(r.id, r.seq, r.quality) for r in passed.collect()] == [("p", READ, [30] * len(READ))]
        passed.explain()
        plan = capsys.readouterr().out
        assert (" Filter " in plan) != (filters == "true"), plan
        assert ids(records.where("length > 4 and id <> 'p'")) == ["s", "u"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abé", max_size=9), st.integers(0, 4095), st.integers(-1, 1), st.integers(-1, 9), st.integers(0, 255), st.text("ACGTN", max_size=9), st.booleans()), max_size=25), st.integers(1, 300), st.integers(0, 6))
def test_decoded_blocks_equal_records(rows, held, low):
    """Spans of any size, by blocks and as a stream, against the decoder of one record; broken records are left out."""
    out = io.BytesIO()
    writer = bam.BgzfWriter(out)
    plain = []
    for i, (name, flag, tid, pos, mapq, seq, scored) in enumerate(rows):
        raw = bam.encode_record(name, flag, tid, pos, mapq, seq, [i % 40] * len(seq) if scored else None)
        if i % 7 == 5:
            raw = raw[:20] + (1000).to_bytes(4, "little") + raw[24:]  # a sequence beyond the record's end
        plain.append(raw)
        writer.write(raw)
        if i % 3 == 0:
            writer.flush()
    writer.close()
    expected = [r[:-1] for r in bam.bam_records(io.BytesIO(b"".join(plain)))]
    old, bam.HELD = bam.HELD, held
    try:
        columns = ["nr", "id", "flag", "tid", "pos", "mapq", "seq", "quality"]
        read = lambda spans, tests=(): [tuple(r.values()) for s in spans for r in bam.decode_spans(*s, "f", 0, columns, list(tests)).to_pylist()]
        assert read(bam.stream_spans(io.BytesIO(b"".join(plain)))) == expected
        blocks = read(bam.block_spans(bam.Blocks(io.BytesIO(out.getvalue())), 1 << 40))
        assert [r[1:] for r in blocks] == [r[1:] for r in expected] and len({r[0] for r in blocks}) == len(blocks)
        tests = [("unmapped", "=", False), ("length", ">=", low)]
        assert [r[1:] for r in read(bam.stream_spans(io.BytesIO(b"".join(plain))), tests)] == [r[1:] for r in expected if not r[2] & 4 and len(r[6]) >= low]
    finally:
        bam.HELD = old


def test_bam_pipeline_exports_bam(spark, tmp_path):
    path = write_bam(tmp_path / "flags.bam")
    options = Options(bam=path, output=str(tmp_path / "report.csv"), export_clusters=True, export_output=str(tmp_path / "out.zip"), n_init_clusters=2)
    result = pipelines.run(spark, options)
    assert result.rows.count() == 2
    with zipfile.ZipFile(tmp_path / "out.zip") as archive:
        names = archive.namelist()
        assert names and all(n.endswith(".bam") for n in names)
        found = []
        for n in names:
            with gzip.open(io.BytesIO(archive.read(n))) as stream:
                header = bam.read_header(stream)
                found += [(r[1], r[3], [x for x, _ in header.references]) for r in bam.bam_records(stream)]
    assert {f[0] for f in found} == {"p", "u"} and len(found) == 3  # the secondary record shares a kept name
    assert all("unmapped" in refs if name == "u" and tid == -1 and len(refs) == 1 else tid >= 0 or name == "u" for name, tid, refs in found)


@pytest.mark.parametrize("legacy", [False, True])
def test_fastq_pipelines(spark, tmp_path, monkeypatch, legacy):
    import random

    rng = random.Random(2)
    monkeypatch.chdir(tmp_path)
    source = tmp_path / "reads.fastq"
    source.write_text("".join(record(f"r{i}", "".join(rng.choice("AAAT" if i % 2 else "GGGC") for _ in range(60))) for i in range(60)))
    options = Options(fastq=str(source), output=str(tmp_path / "report.csv"), export_clusters=True, export_format="fasta" if legacy else "same", export_with_metadata=True, export_output=str(tmp_path / "out.zip"), n_init_clusters=3, legacy=legacy, dashboard=legacy, k=2, use_codon=True)
    result = pipelines.run(spark, options)
    lines = (tmp_path / "report.csv").read_text().splitlines()
    assert lines[0].startswith("Cluster ID,Number of Reads") and len(lines) == 1 + result.stats.count()
    assert result.stats.agg({"num_reads": "sum"}).first()[0] == 60
    with zipfile.ZipFile(tmp_path / "out.zip") as archive:
        text = "".join(archive.read(n).decode() for n in archive.namelist())
        assert text.count(">" if legacy else "@r") == 60 and " cluster=" in text
        assert archive.namelist()[0].startswith("cluster_0_size_") and archive.namelist()[0].endswith(".fa" if legacy else ".fastq")
    if legacy:
        data = json.loads((tmp_path / "dashboard/data.json").read_text())
        assert data["reads"] == 60 and sum(c["n"] for c in data["cells"]) == 60 and sum(b["n"] for b in data["histogram"]) == 120
        assert {c["cluster"] for c in data["cells"]} == {c["cluster"] for c in data["clusters"]} and sum(data["explained"]) == pytest.approx(100)
        assert 0 < data["features"] and {c["cell_x"] for c in data["cells"]} >= {0, sinks.GRID - 1}
        with sinks.serve("dashboard", 0) as server:
            threading.Thread(target=server.serve_forever, daemon=True).start()
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/") as page:
                assert page.status == 200 and b'id="scatter"' in page.read()
            server.shutdown()
        assert "<table" in (tmp_path / "dashboard/index.html").read_text()
    assert sum(result.explained[0]) == pytest.approx(100)


def test_assembler_is_optional(spark, tmp_path):
    reads = spark.createDataFrame([("a", READ)], "id string, seq string")
    assert assembler.assemble(spark, reads, "no-such-program") is None
    assert assembler.worth_using(reads, reads)
    sinks.write_fastq(reads, str(tmp_path / "x.fastq"))
    assert ids(fastq.read_fastq(spark, str(tmp_path / "x.fastq"))) == ["a"]


def test_numbers_are_unique_over_ranges_and_files(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f"{f}.fastq").write_text("".join(f"@{f}{i} x\n{'ACGT' * (i % 40 + 1)}\n+\n{'@+II' * (i % 40 + 1)}\n" for i in range(500)))
    spark.dataSource.register(fastq.FastqSource)
    whole = fastq.numbered(fastq.read_fastq(spark, str(tmp_path))).select("read_idx", "id", "seq").collect()
    cut = fastq.numbered(spark.read.format("fastq").option("rangebytes", "2000").load(str(tmp_path))).select("read_idx", "id", "seq").collect()
    assert sorted(whole) == sorted(cut) and len({r.read_idx for r in cut}) == 1000


def test_long_records_and_bad_qualities(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text(f"@long\n{'A' * 200_000}\n+\n{'I' * 200_000}\n@bad\nACGT\n+\nII I\n@good\nACGT\n+\nIIII\n")
    spark.dataSource.register(fastq.FastqSource)
    rows = spark.read.format("fastq").option("rangebytes", "50000").load(str(path)).collect()
    assert [(r.id, len(r.seq), len(r.quality)) for r in rows] == [("long", 200_000, 200_000), ("good", 4, 4)]
    assert fastq.bad_records(spark, str(path)) == 1


def test_clusters_are_written_by_executors(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id AS read_idx", "concat('r', id) AS id", "'ACGT' AS seq", "array(40S, 40S, 40S, 200S) AS quality", "IF(id < 2900, 10, IF(id < 2990, 2, -1)) AS cluster", "0.5D AS gc", "0.1D AS damage5", "0.2D AS damage3", "0.3D AS combined")
    stats = report.cluster_stats(rows)
    assert sinks.write_clusters(rows, stats, str(tmp_path / "x.zip"), "fasta", True) == 2
    with zipfile.ZipFile(tmp_path / "x.zip") as archive:
        names = archive.namelist()
        assert [n.split("_")[1] for n in names] == ["2", "10"]
        lines = archive.read(names[1]).decode().splitlines()
    assert lines[::2] == [f">r{i} cluster=10 gc=0.500 damage5=0.100 damage3=0.200 combined=0.300" for i in range(2900)] and set(lines[1::2]) == {"ACGT"}
    sinks.write_cluster_files(rows, stats, str(tmp_path / "parts"), min_size=100)
    (folder,) = [p for p in (tmp_path / "parts").iterdir() if p.is_dir()]
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert folder.name.startswith("file=cluster_10_") and text == "".join(f"@r{i}\nACGT\n+\n////\n" for i in range(2900))
    assert sinks.write_clusters(rows.limit(0), stats.limit(0), str(tmp_path / "none.zip")) == 0


def long_bam(path, n=3000):
    """Records from a few bytes to several blocks, under a header that is longer than a block."""
    import random

    rng = random.Random(5)
    references = [(f"contig{i:05d}", 1000 + i) for i in range(9000)]
    rows = []
    for i in range(n):
        seq = "".join(rng.choices("ACGT", k=rng.choice([1, 40, 150, 3000] if i % 500 else [200_000])))
        quality = None if i % 7 == 0 else [rng.randrange(60) for _ in seq]
        rows.append((f"r{i}", 0, rng.randrange(9000), rng.randrange(900), 60, seq, quality))
    with open(path, "wb") as out:
        writer = bam.BgzfWriter(out)
        writer.write(bam.encode_header(bam.Header("@HD\tVN:1.6\n", references)))
        for r in rows:
            writer.write(bam.encode_record(*r))
        writer.close()
    return rows


def test_bam_is_cut_into_ranges(spark, tmp_path):
    path = tmp_path / "x.bam"
    rows = long_bam(path)
    spark.dataSource.register(bam.BamSource)
    load = lambda size: spark.read.format("bam").option("rangebytes", str(size)).load(str(path))
    whole = load(1 << 30)
    assert whole.rdd.getNumPartitions() == 1
    whole = whole.collect()
    assert [(r.id, r.flag, r.tid, r.pos, r.mapq, r.seq, r.quality) for r in whole] == rows
    assert len({r.nr for r in whole}) == len(rows) and [r.nr for r in whole] == sorted(r.nr for r in whole)
    for size in (30_011, 200_003):
        cut = load(size)
        assert cut.rdd.getNumPartitions() > 10
        assert sorted((r.nr, r.id, r.seq) for r in cut.select("nr", "id", "seq").collect()) == [(r.nr, r.id, r.seq) for r in whole]


def test_numbers_of_records_that_compress_well(tmp_path):
    path = tmp_path / "same.bam"
    with open(path, "wb") as out:
        writer = bam.BgzfWriter(out)
        writer.write(bam.encode_header(HEADER))
        writer.write(bam.encode_record("a", 4, -1, -1, 0, "", None) * 20_000)
        writer.close()
    with open(path, "rb") as stream:
        blocks = bam.Blocks(stream)
        bam.read_header(blocks)
        numbers = [n for span in bam.block_spans(blocks, 1 << 40) for n in span[3]]
    assert len(numbers) == 20_000 and all(a < b for a, b in zip(numbers, numbers[1:]))


def test_plain_gzip_bam(spark, tmp_path):
    path = tmp_path / "plain.bam"
    path.write_bytes(gzip.compress(bam.encode_header(HEADER) + b"".join(bam.encode_record(*r) for r in RECORDS)))
    assert [r.id for r in bam.read_bam(spark, str(path)).collect()] == [r[0] for r in RECORDS]


def test_bam_clusters_are_written_by_executors(spark, tmp_path):
    source = tmp_path / "x.bam"
    rows = long_bam(source, 1200)
    clusters = spark.createDataFrame([(r[0], i % 3 - 1, 0.5, 0.1, 0.2, 0.3) for i, r in enumerate(rows)], "id string, cluster int, gc double, damage5 double, damage3 double, combined double")
    stats = report.cluster_stats(clusters)
    wanted = {c: [(r[0], f"contig{r[2]:05d}", r[5]) for i, r in enumerate(rows) if i % 3 - 1 == c] for c in (0, 1)}

    def records(data):
        with gzip.open(io.BytesIO(data)) as stream:
            header = bam.read_header(stream)
            return [(r[1], header.references[r[3]][0], r[6]) for r in bam.bam_records(stream)]

    assert sinks.write_bam_clusters(str(source), clusters, stats, str(tmp_path / "x.zip")) == 2
    with zipfile.ZipFile(tmp_path / "x.zip") as archive:
        names = archive.namelist()
        assert [n.split("_")[1] for n in names] == ["0", "1"]
        assert {int(n.split("_")[1]): records(archive.read(n)) for n in names} == wanted
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else one task takes so few rows
    try:
        parts = sinks.write_bam_parts(str(source), clusters, stats, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {int(f.split("_")[1]): [x for p in paths for x in records(open(p, "rb").read())] for f, _, paths in parts} == wanted
    assert sorted(str(p) for p in (tmp_path / "parts").rglob("*") if p.is_file()) == sorted(p for _, _, paths in parts for p in paths)
    with pytest.raises(FileExistsError):
        sinks.write_bam_parts(str(source), clusters, stats, str(tmp_path / "parts"))
    assert sum(len(paths) for _, _, paths in parts) > 2 and sinks.write_bam_parts(str(source), clusters, stats.limit(0), str(tmp_path / "none")) == []


def files_of(folder):
    return sorted(p.name for p in folder.iterdir()) if folder.exists() else []


@pytest.mark.parametrize("kind", ["fastq", "fasta", "bam"])
def test_sources_write_what_they_read(spark, tmp_path, kind):
    spark.dataSource.register(fastq.FastqSource)
    spark.dataSource.register(fastq.FastaSource)
    spark.dataSource.register(bam.BamSource)
    rows = [(f"r{i}", READ[: 10 + i % 20], [i % 41] * (10 + i % 20) if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, seq string, quality array<smallint>").repartition(4)
    folder = tmp_path / kind
    df.write.format(kind).mode("append").save(str(folder))
    assert len(files_of(folder)) == 4 and all(n.startswith("part-") and n.endswith(kind) for n in files_of(folder))
    expected = {"fasta": lambda r: (r[0], r[1], None), "bam": lambda r: r, "fastq": lambda r: (*r[:2], [14] * len(r[1]) if r[2] is None else r[2])}[kind]
    read = lambda: sorted((r.id, r.seq, r.quality) for r in spark.read.format(kind).load(str(folder)).select("id", "seq", "quality").collect())
    assert read() == sorted(map(expected, rows))
    df.where("id < 'r2'").write.format(kind).mode("append").save(str(folder))
    assert len(read()) == 100 + df.where("id < 'r2'").count()
    df.where("id = 'r7'").coalesce(1).write.format(kind).mode("overwrite").save(str(folder))
    assert [r[0] for r in read()] == ["r7"] and len(files_of(folder)) == 1


@pytest.mark.parametrize("kind", ["fastq", "bam"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, kind):
    spark.dataSource.register(fastq.FastqSource)
    spark.dataSource.register(bam.BamSource)
    folder = tmp_path / kind
    good = spark.createDataFrame([("a", "ACGT", 0)], "id string, seq string, tid int").drop("tid")
    good.write.format(kind).mode("append").save(str(folder))
    before = files_of(folder)
    rows = [(f"r{i}", "ACGT", [200 if i == 77 else 7] * 4, 5 if i == 77 else -1) for i in range(100)]
    bad = spark.createDataFrame(rows, "id string, seq string, quality array<smallint>, tid int").repartition(4)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no character|no reference"):
            bad.write.format(kind).mode(mode).save(str(folder))
        assert files_of(folder) == before
    with pytest.raises(Exception, match="id and seq"):
        bad.drop("seq").write.format(kind).mode("append").save(str(folder))
