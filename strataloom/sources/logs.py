"""Log files as tables of lines with byte offsets, in batch and as a growing stream.

Files must be readable under the same path on every executor (a shared mount, or a URI that pyarrow's file systems know).
A file is cut into byte ranges; the line that spans a cut belongs to the range in which it begins.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from strataloom.session import ship

LINES = "file_path string, byte_offset bigint, next_offset bigint, line string"
#: Bytes of a line that are kept unless another bound, or none, is asked for.
MAX_LINE = 65_536
SPLIT_BYTES, BATCH_LINES = 64 << 20, 8_192


def _open(path: str):
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def file_size(path: str) -> int:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).size or 0
    return os.path.getsize(path)


def expand(paths: str) -> list[str]:
    """Comma-separated paths and globs, sorted, each once."""
    out: set[str] = set()
    for p in filter(None, (x.strip() for x in paths.split(","))):
        out.update([p] if "://" in p else [os.path.abspath(f) for f in glob.glob(p)] or [os.path.abspath(p)])
    return sorted(out)


def valid_files(paths: list[str]) -> tuple[list[str], list[str]]:
    """Files to read, and a warning for each that is missing, no regular file or empty. Fails if none is left."""
    good, warnings = [], []
    for p in paths:
        if "://" not in p and not os.path.exists(p):
            warnings.append(f"{p}: not found")
        elif "://" not in p and not os.path.isfile(p):
            warnings.append(f"{p}: not a regular file")
        elif file_size(p) == 0:
            warnings.append(f"{p}: empty")
        else:
            good.append(p)
    if not good:
        raise ValueError("no readable log file: " + "; ".join(warnings or ["none given"]))
    return good, warnings


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    begins_line: bool
    most: int | None = MAX_LINE

    def __hash__(self) -> int:
        return hash((self.path, self.start, self.end))


def clean_line(raw: bytes, most: int | None = MAX_LINE) -> str:
    """A line without its end: one CR less, ``most`` bytes at most (None: all), empty if what is kept isn't UTF-8. A sign
    that the cut would split is left out."""
    if raw.endswith(b"\r"):
        raw = raw[:-1]
    if most is not None and len(raw) > most:
        end = most
        while end > max(0, most - 3) and raw[end] & 0xC0 == 0x80:
            end -= 1
        raw = raw[:end]
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return ""


def read_range(part: ByteRange) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file_path", pa.string()), ("byte_offset", pa.int64()), ("next_offset", pa.int64()), ("line", pa.string())])
    with _open(part.path) as f:
        at = part.start
        if not part.begins_line:
            # the line before the range's first byte ends within or at it
            at -= 1
            f.seek(at)
            at += len(f.readline())
        else:
            f.seek(at)
        rows: list[tuple] = []
        while at < part.end:
            raw = f.readline()
            if not raw:
                break
            after = at + len(raw)
            rows.append((part.path, at, after, clean_line(raw[:-1] if raw.endswith(b"\n") else raw, part.most)))
            at = after
            if len(rows) == BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def ranges(path: str, start: int, end: int, split: int, most: int | None = MAX_LINE) -> list[ByteRange]:
    return [ByteRange(path, a, min(a + split, end), a == start, most) for a in range(start, end, split)]


class LogLines(DataSource):
    """``spark.read.format("loglines").option("paths", ...)``; options ``positions`` (JSON, path -> byte from which to
    read), ``split`` (bytes of a task) and ``max_line`` (bytes of a line that are kept; 0 keeps whole lines)."""

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = expand(options.get("paths", options.get("path", "")))
        self.positions = json.loads(options.get("positions", "{}"))
        self.split = int(options.get("split", SPLIT_BYTES))
        self.most = int(options.get("max_line", MAX_LINE)) or None

    def partitions(self) -> list[ByteRange]:
        out = []
        for p in self.paths:
            size, at = file_size(p), int(self.positions.get(p, 0))
            out += ranges(p, 0 if size < at else at, size, self.split, self.most)
        return out or [ByteRange("", 0, 0, True)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are bytes by path. Only whole lines are read. A file that became shorter is read from its beginning."""

    def __init__(self, options: dict):
        self.paths = options.get("paths", options.get("path", ""))
        self.positions = json.loads(options.get("positions", "{}"))
        self.split = int(options.get("split", SPLIT_BYTES))
        self.most = int(options.get("max_line", MAX_LINE)) or None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps(self.positions)}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for p in expand(self.paths):
            if "://" in p or os.path.isfile(p):
                out[p] = self._whole_lines(p)
        return {"files": json.dumps(out, sort_keys=True)}

    @staticmethod
    def _whole_lines(path: str) -> int:
        """Size of a file up to its last line end."""
        end = file_size(path)
        with _open(path) as f:
            while end > 0:
                start = max(0, end - (1 << 16))
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for p, size in now.items():
            at = int(before.get(p, 0))
            out += ranges(p, 0 if size < at else at, size, self.split, self.most)
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass


def register(spark) -> None:
    ship(spark)
    spark.dataSource.register(LogLines)


def read_lines(spark, paths: str, positions: dict[str, int] | None = None, split: int = SPLIT_BYTES, max_line: int | None = MAX_LINE):
    register(spark)
    return (
        spark.read.format("loglines")
        .option("paths", paths)
        .option("positions", json.dumps(positions or {}))
        .option("split", str(split))
        .option("max_line", str(max_line or 0))
        .load()
    )
