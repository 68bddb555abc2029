"""Sent digests as JSON lines, each written exactly once.

``digest_lines`` appends rows (at, subject, text, job_ids) to a folder. Each task writes one pending file; the commit names the pending
files in a record of its own, and only recorded files count. So a task that is tried again, or a job that is aborted, leaves no line, and a
batch (option ``batch``) that was recorded before is not recorded again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FIELDS = "at string, subject string, text string, job_ids array<long>"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    lines: int


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class DigestWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch = path, batch

    def write(self, rows: Iterator) -> Written:
        system, root = _folder(self.path)
        lines = [json.dumps({k: list(v) if isinstance(v, (list, tuple)) else v for k, v in r.asDict().items()}, ensure_ascii=False) for r in rows]
        if not lines:
            return Written(None, 0)
        file = f"{uuid.uuid4().hex}.jsonl"
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{file}") as out:
            out.write(("\n".join(lines) + "\n").encode())
        return Written(file, len(lines))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _folder(self.path)
        files = [m.file for m in messages if m and m.file]
        if f"batch-{self.batch}" in recorded(self.path):
            return self._drop(files)
        system.create_dir(f"{root}/_recorded", recursive=True)
        pending = f"{root}/_recorded/.{uuid.uuid4().hex}"
        with system.open_output_stream(pending) as out:
            out.write(json.dumps(files).encode())
        system.move(pending, f"{root}/_recorded/batch-{self.batch}")  # one step: all lines of the batch, or none

    def abort(self, messages: list[Written | None]) -> None:
        self._drop([m.file for m in messages if m and m.file])

    def _drop(self, files: list[str]) -> None:
        system, root = _folder(self.path)
        for f in files:
            system.delete_file(f"{root}/{f}")


class DigestLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "digest_lines"

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("sent digests are only ever added")
        return DigestWriter(self.options["path"], self.options.get("batch") or uuid.uuid4().hex)


def recorded(path: str) -> dict[str, list[str]]:
    """The files of each recorded batch."""
    from pyarrow import fs

    system, root = _folder(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/_recorded", allow_not_found=True))
    out = {}
    for f in found:
        if not f.base_name.startswith("."):
            with system.open_input_stream(f.path) as stream:
                out[f.base_name] = json.loads(stream.read())
    return out


def append_digests(digests: DataFrame, path: str, batch: str | None = None) -> None:
    digests.sparkSession.dataSource.register(DigestLines)
    out = digests.select("at", "subject", "text", F.col("job_ids").cast("array<long>")).write.format("digest_lines").option("path", path)
    (out.option("batch", batch) if batch else out).mode("append").save()


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all recorded batches."""
    files = [f"{path}/{f}" for own in recorded(path).values() for f in own]
    return spark.read.schema(FIELDS).json(files) if files else spark.createDataFrame([], FIELDS)
