"""Daily usage as CSV files: a Python data source for writing.

Each task writes one file with a byte-order mark and a header; files get their names when the whole write is committed, and what an
attempt that failed has written is deleted. Texts are quoted if they have a comma, a quote or a line break, or begin as a formula would.
Paths are those of pyarrow's file systems: local, or with a scheme that it knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Header by column, the most days of an export.
HEADER = {
    "day": "Date", "nickname": "User", "workdir": "Workdir", "tool_code": "Tool", "provider_id": "Provider", "model": "Model", "input_tokens": "Input Tokens", "output_tokens": "Output Tokens",
    "cache_read_tokens": "Cache Read Tokens", "cache_write_tokens": "Cache Write Tokens", "reasoning_tokens": "Reasoning Tokens", "total_tokens": "Total Tokens", "cost": "Estimated Cost USD", "cost_quality": "Cost Quality", "source_quality": "Source Quality",
}
MOST_DAYS = 90
MARK = "﻿"


def field(value) -> str:
    if value is None:
        return ""
    text = str(value)
    if isinstance(value, str) and (any(c in text for c in ',"\n\r') or text[:1] in ("=", "+", "-", "@")):
        return '"' + text.replace('"', '""') + '"'
    return text


@dataclass
class Written(WriterCommitMessage):
    partition: int
    staged: str
    rows: int


class UsageCsvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path.rstrip("/"), names, overwrite, uuid.uuid4().hex

    def files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = self.files()
        task = TaskContext.get()
        staged, rows = f"{base}/_staged-{self.run}/{task.partitionId()}-{task.taskAttemptId()}.csv", 0
        store.create_dir(staged.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(staged) as out:
            out.write((MARK + ",".join(field(HEADER.get(c, c)) for c in self.names) + "\n").encode())
            for batch in iterator:
                rows += batch.num_rows
                columns = [c.to_pylist() for c in batch.columns]
                out.write("".join(",".join(map(field, row)) + "\n" for row in zip(*columns, strict=True)).encode())
        return Written(task.partitionId(), staged, rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = self.files()
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.type == fs.FileType.File and old.base_name.startswith("part-"):
                    store.delete_file(old.path)
        for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
            store.move(m.staged, f"{base}/part-{m.partition:05d}-{self.run}.csv")
        self.drop(store, base)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(*self.files())

    def drop(self, store, base: str) -> None:
        from pyarrow import fs

        staged = f"{base}/_staged-{self.run}"
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


class UsageCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "usage_csv"

    def writer(self, schema: StructType, overwrite: bool) -> UsageCsvWriter:
        return UsageCsvWriter(self.options["path"], schema.names, overwrite)


def export(usage: DataFrame, path: str, span: tuple[date, date] | None = None, files: int = 8, mode: str = "overwrite") -> None:
    """Write daily usage (columns of HEADER that it has, in that order) newest day first, in files that follow each other; a longer ``span`` than MOST_DAYS is refused."""
    if span is not None:
        if (span[1] - span[0]).days > MOST_DAYS:
            raise ValueError(f"an export has at most {MOST_DAYS} days")
        usage = usage.where(F.col("day").between(F.lit(span[0]), F.lit(span[1])))
    usage.sparkSession.dataSource.register(UsageCsv)
    present = [c for c in HEADER if c in usage.columns]
    rank = [F.desc(c) for c in ("day", "total_tokens") if c in present] + [F.col(c) for c in ("nickname", "tool_code", "provider_id", "model") if c in present]
    rows = usage.select(*[F.col(c).cast("string").alias(c) if c == "day" else F.col(c) for c in present])
    rows.repartitionByRange(files, *rank).sortWithinPartitions(*rank).write.format("usage_csv").mode(mode).save(path)
