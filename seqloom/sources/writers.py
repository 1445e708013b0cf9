"""Writers of the FASTQ, FASTA and BAM sources: `df.write.format("fastq").mode("append").save(folder)`, and so on.

Each task writes files under names of its own in a folder of attempts. When all tasks have succeeded, the driver moves
the files that were reported into the folder; when the job fails, the attempts are removed, so that nothing is left of it.
Files of tasks that were lost or repeated are never reported. With the mode "overwrite" what was in the folder goes
once the new files are complete.

Columns are taken by name: id and seq, quality (FASTQ; null: the score / at every base), flag, tid, pos and mapq (BAM;
0x4, -1, -1 and 0 where they are absent or null). The option `header` of BAM names a file whose references are kept."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from seqloom.sources.files import address

MISSING = "/"  # the score of bases without one
ROWS_OF_FILE = 1 << 24


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TextFile:
    """FASTQ or FASTA text."""

    def __init__(self, stream, kind: str, options: dict):
        self.stream, self.fastq = stream, kind == "fastq"

    def add(self, rows: dict[str, list]) -> None:
        out = []
        for i, (name, seq) in enumerate(zip(rows["id"], rows["seq"])):
            if not self.fastq:
                out.append(f">{name or 'unknown'}\n{seq or ''}\n")
                continue
            quality = rows["quality"][i] if "quality" in rows else None
            scores = MISSING * len(seq or "") if quality is None else "".join(chr(q + 33) for q in quality)
            if quality is not None and any(not 0 <= q <= 93 for q in quality):
                raise ValueError(f"a score of {name} has no character")
            out.append(f"@{name or 'unknown'}\n{seq or ''}\n+\n{scores}\n")
        self.stream.write("".join(out).encode())

    def close(self) -> None:
        self.stream.close()


class BamFile:
    """Blocks of a BAM file with its header."""

    def __init__(self, stream, kind: str, options: dict):
        from seqloom.sources import bam

        self.stream, self.bam, self.writer = stream, bam, bam.BgzfWriter(stream)
        header = bam.header_of(options["header"]) if options.get("header") else bam.Header("@HD\tVN:1.6\n")
        self.references = len(header.references)
        self.writer.write(bam.encode_header(header))

    def add(self, rows: dict[str, list]) -> None:
        given = lambda c, i, other: other if c not in rows or rows[c][i] is None else rows[c][i]
        for i, (name, seq) in enumerate(zip(rows["id"], rows["seq"])):
            tid = given("tid", i, -1)
            if not -1 <= tid < self.references:
                raise ValueError(f"the header has no reference {tid}")
            self.writer.write(self.bam.encode_record(name or "unknown", given("flag", i, 4), tid, given("pos", i, -1), given("mapq", i, 0), seq or "", given("quality", i, None)))

    def close(self) -> None:
        self.writer.close()
        self.stream.close()


class Writer(DataSourceArrowWriter):
    def __init__(self, kind: str, options: dict, columns: list[str], overwrite: bool):
        if not {"id", "seq"} <= set(columns):
            raise ValueError("the columns id and seq have to be there")
        self.kind, self.options, self.overwrite = kind, {"header": options.get("header")}, overwrite
        self.system, self.folder = pafs.FileSystem.from_uri(address(options["path"]))
        self.turn = uuid.uuid4().hex
        self.attempts = f"{self.folder}/_attempts-{self.turn}"
        self.system.create_dir(self.attempts, recursive=True)  # by the driver alone: tasks that outlive a failed job write no more

    def write(self, iterator):
        files, file, held = [], None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if file is None or held >= ROWS_OF_FILE:
                if file is not None:
                    file.close()
                files.append(f"{uuid.uuid4().hex}.{self.kind}")
                file, held = (BamFile if self.kind == "bam" else TextFile)(self.system.open_output_stream(f"{self.attempts}/{files[-1]}"), self.kind, self.options), 0
            file.add({c: batch.column(c).to_pylist() for c in batch.schema.names})
            held += batch.num_rows
        if file is not None:
            file.close()
        return Written(files)

    def commit(self, messages):
        old = [f.path for f in self.system.get_file_info(pafs.FileSelector(self.folder)) if f.type == pafs.FileType.File] if self.overwrite else []
        names = [name for m in messages if m for name in m.files]
        for i, name in enumerate(names):
            self.system.move(f"{self.attempts}/{name}", f"{self.folder}/part-{i:05d}-{self.turn}.{self.kind}")
        for path in old:
            self.system.delete_file(path)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        for turn in range(5):
            if self.system.get_file_info(self.attempts).type != pafs.FileType.Directory:
                return
            try:
                self.system.delete_dir(self.attempts)
            except OSError:  # a task that still runs has just opened a file
                if turn == 4:
                    raise
                time.sleep(0.2)
