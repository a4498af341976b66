"""Zstandard logs of one or many frames as lines of text.

A file is one row of bytes (the reader's limit of 2 GB holds), its frames are decoded one after the other, a piece at a
time. A log may be cut off: of a torn frame what can be decoded counts, or nothing (``whole_frames``), where each frame
is one write. Bytes that are no frame end a file's lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE = 1 << 20
LINES_A_BATCH = 10_000
_MAGIC = b"\x28\xb5\x2f\xfd"


def frames(data: bytes, whole_frames: bool) -> Iterator[bytes]:
    """Decoded bytes of the frames of ``data``, in pieces; whole frames come in one piece each."""
    import zstandard

    at = 0
    while data[at : at + 4] == _MAGIC:
        frame, held = zstandard.ZstdDecompressor().decompressobj(), []
        while at < len(data) and not frame.eof:
            piece = data[at : at + PIECE]
            try:
                out = frame.decompress(piece)
            except zstandard.ZstdError:
                return
            at += len(piece) - (len(frame.unused_data) if frame.eof else 0)
            if whole_frames:
                held.append(out)
            else:
                yield out
        if frame.eof and held:
            yield b"".join(held)
        elif not frame.eof:
            return


def split_lines(pieces: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for piece in pieces:
        *lines, rest = (rest + piece).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in lines)
    if rest:
        yield rest.decode("utf-8", "replace")


def packed_lines(spark: SparkSession, path: str, glob: str, whole_frames: bool = False) -> DataFrame:
    """Columns file, line (from 0) and raw of the compressed files below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(file: str, first: int, lines: list[str]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())], ["file", "line", "raw"])

        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                lines, first = [], 0
                for line in split_lines(frames(content.as_py(), whole_frames)):
                    lines.append(line)
                    if len(lines) == LINES_A_BATCH:
                        yield batch(file.as_py(), first, lines)
                        first, lines = first + len(lines), []
                if lines:
                    yield batch(file.as_py(), first, lines)

    return found.mapInArrow(run, "file string, line long, raw string")
