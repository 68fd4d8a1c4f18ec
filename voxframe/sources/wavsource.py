"""A data source of long WAV files: ``spark.read.format("wavblocks")``, one row for each block of samples.

A file is not read whole by anyone: planning reads its chunk headers alone, and each task
reads the byte range of its own blocks.

    spark.dataSource.register(WavBlocks)
    spark.read.format("wavblocks").option("block", 160_000).load("/shared/audio")

Rows are (path, block, rate, channels, start, samples): samples are the mean of the channels,
``start`` is the number of a block's first.  Paths are files or folders, of which files
ending in .wav are taken, through any file system that Arrow opens.  A broken file gives one
row with its ``error`` and no block; a file without samples gives no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Samples of a block, and blocks that a task reads at the most.
BLOCK, BLOCKS_A_TASK = 160_000, 32


@dataclass
class Span(InputPartition):
    """Blocks [first, last) of a file whose samples begin at byte ``at``."""

    path: str
    at: int
    samples: int
    rate: int
    channels: int
    first: int
    last: int
    error: str | None = None


def layout(source, size: int) -> tuple[int, int, int, int]:
    """(rate, channels, first byte, samples) of a 16-bit PCM file, from its chunks' headers."""

    def read(offset: int, n: int) -> bytes:
        source.seek(offset)
        return source.read(n)

    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= size and (form is None or body is None):
        name, n = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", read(at + 8, 16))
        elif name == b"data":
            body = at + 8, min(n, size - at - 8)
        at += 8 + n + n % 2
    if form is None or body is None:
        raise ValueError("a WAV file without format or data")
    kind, channels, rate, _, _, bits = form
    if kind != 1 or bits != 16:
        raise ValueError("only 16-bit PCM is read")
    return rate, channels, body[0], body[1] // (2 * channels)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's WAV files."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and (f is info or f.path.lower().endswith(".wav")))


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


class WavBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavblocks"

    def schema(self) -> str:
        return "path string, block long, rate int, channels int, start long, samples array<float>, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("blocks_a_task", BLOCKS_A_TASK)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int, blocks_a_task: int):
        if block < 1 or blocks_a_task < 1:
            raise ValueError("a block has a sample, and a task a block, at the least")
        self.path, self.block, self.some = path, block, blocks_a_task

    def partitions(self) -> list[Span]:
        out = []
        for path, size in _files(self.path):
            try:
                with _open(path) as source:
                    rate, channels, at, n = layout(source, size)
            except (ValueError, struct.error) as e:
                out.append(Span(path, 0, 0, 0, 0, 0, 0, str(e)))
                continue
            blocks = -(-n // self.block)
            out += [Span(path, at, n, rate, channels, i, min(blocks, i + self.some)) for i in range(0, blocks, self.some)]
        return out or [Span("", 0, 0, 0, 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        import numpy as np

        p = partition
        if p.error is not None:
            yield p.path, None, None, None, None, None, p.error
        if p.first == p.last:
            return
        with _open(p.path) as source:
            for i in range(p.first, p.last):
                start = i * self.block
                source.seek(p.at + start * 2 * p.channels)
                data = source.read(min(self.block, p.samples - start) * 2 * p.channels)
                whole = np.frombuffer(data, "<i2").reshape(-1, p.channels)
                yield p.path, i, p.rate, p.channels, start, (whole.mean(1) / 32768).astype("float32").tolist(), None
