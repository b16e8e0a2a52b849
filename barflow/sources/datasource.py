"""A Spark data source for landed vendor files, batch and streaming: spark.read.format("vendor_bars").load(folder).

Files are read in byte ranges through a file system that the path names, so executors need no local copy. The symbol is the name
of a file, or of a `symbol=` folder above it; filters on it leave files out, filters on the date leave rows out. A line with a bad
cell is kept with the line in `bad` and nulls for what could not be read.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, time_key string, open double, high double, low double, close double, volume double, bad string"
NUMBERS = ["open", "high", "low", "close", "volume"]
ARROW = pa.schema([("symbol", pa.string()), ("time_key", pa.string()), *((c, pa.float64()) for c in NUMBERS), ("bad", pa.string())])
BLOCK, ROWS = 64_000_000, 10_000
#: small files share a partition up to this many bytes, since a task for each would cost more than its rows
GROUP, CHUNK = 4_000_000, 1 << 20


@dataclass
class Piece(InputPartition):
    """Byte ranges (path, start, end) that one task reads."""

    ranges: list[tuple[str, int, int]]


def symbol_of(path: str) -> str:
    for part in reversed(path.split("/")[:-1]):
        if part.startswith("symbol="):
            return part.removeprefix("symbol=")
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


class Vendor:
    """What the batch and the streaming reader share."""

    def __init__(self, options: dict):
        self.layout = options.get("layout", "csv")
        if self.layout not in ("csv", "arrays"):
            raise ValueError(f"unknown layout {self.layout}")
        self.block = int(options.get("block", BLOCK))
        self.uri = options["path"]
        self.symbols: set[str] | None = None
        self.low: str | None = None
        self.high: str | None = None

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)

    def files(self) -> list[fs.FileInfo]:
        """Files below the folder, or the one file, oldest first; names that begin with a dot or underscore are not data."""
        store, path = self.store()
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        ending = ".csv" if self.layout == "csv" else ".json"
        found = [f for f in found if f.is_file and f.path.endswith(ending) and not any(p.startswith((".", "_")) for p in f.path[len(path) :].split("/") if p)]
        return sorted(found, key=lambda f: (f.mtime_ns, f.path))

    def pieces(self, files: Iterable[fs.FileInfo]) -> list[Piece]:
        """Large files are cut into ranges of a block, small ones are put together."""
        out: list[Piece] = []
        most, room = min(GROUP, self.block), 0
        for f in files:
            if self.symbols is None or symbol_of(f.path) in self.symbols:
                step = self.block if self.layout == "csv" else max(f.size, 1)
                for at in range(0, f.size, step):
                    one = (f.path, at, min(at + step, f.size))
                    size = one[2] - at
                    if size > room:
                        out.append(Piece([]))
                        room = most
                    out[-1].ranges.append(one)
                    room -= size
        return out

    def wanted(self, day: str | None) -> bool:
        return day is not None and (self.low is None or day >= self.low) and (self.high is None or day <= self.high)

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        store, _ = self.store()
        for one in piece.ranges:
            for row in self._csv(store, *one) if self.layout == "csv" else self._arrays(store, one[0]):
                rows.append(row)
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _csv(self, store: fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple]:
        """Lines that begin in the range; the header is read for every range."""
        symbol = symbol_of(path)
        with store.open_input_file(path) as fh:
            header = next(csv.reader([_line(fh).decode("utf-8-sig")]))
            if start > fh.tell():
                fh.seek(start - 1)
                _line(fh)  # the rest of a line of the range before
            for line in _lines(fh, end):
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text:
                    cells = next(csv.reader([text])) if '"' in text else text.split(",")
                    row = dict(zip(header, cells))
                    day = row.get("time_key")
                    values = [_number(row.get(c)) for c in NUMBERS]
                    if not row.get("volume"):
                        values[4] = 0.0
                    bad = text if not day or None in values or len(cells) != len(header) else None
                    if bad or self.wanted(day):
                        yield (symbol, day, *values, bad)

    def _arrays(self, store: fs.FileSystem, path: str) -> Iterator[tuple]:
        symbol = symbol_of(path)
        with store.open_input_stream(path) as fh:
            raw = fh.read().decode("utf-8-sig", "replace")
        try:
            data = json.loads(raw)
            days = data.get("qfqday") or data.get("day") or []
        except (ValueError, AttributeError):
            yield (symbol, None, None, None, None, None, None, raw)
            return
        for item in days:
            cells = list(item) if isinstance(item, list) else []
            day, o, c, h, lo, *v = cells if len(cells) > 4 else [None] * 5
            values = [*map(_number, (o, h, lo, c)), _number(v[0]) if v else 1.0]
            bad = json.dumps(item, ensure_ascii=False) if day is None or None in values else None
            if bad or self.wanted(day):
                yield (symbol, day, *values, bad)


def _line(fh) -> bytes:
    """One line, read in small steps from where the file stands."""
    at, out = fh.tell(), b""
    while True:
        part = fh.read(4096)
        end = part.find(b"\n")
        if end >= 0:
            out += part[: end + 1]
            break
        out += part
        if not part:
            break
    fh.seek(at + len(out))
    return out


def _lines(fh, end: int) -> Iterator[bytes]:
    """The lines that begin between where the file stands and `end`, read in large steps."""
    at, held = fh.tell(), b""
    while at < end:
        part = fh.read(min(CHUNK, max(end - at - len(held), 4096)))
        *lines, held = (held + part).split(b"\n")
        for line in lines if part else [held]:
            if at >= end:
                return
            yield line
            at += len(line) + 1
        if not part:
            return


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


class VendorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.vendor = Vendor(options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Symbols are settled by the choice of files. Dates only leave rows out early, so those filters are checked again."""
        v = self.vendor
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                v.symbols = asked if v.symbols is None else v.symbols & asked
                continue
            if column == "time_key" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                v.low = max(v.low or f.value, f.value)
            if column == "time_key" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                v.high = min(v.high or f.value, f.value)
            yield f

    def partitions(self) -> list[Piece]:
        return self.vendor.pieces(self.vendor.files())

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.vendor.batches(partition)


class VendorStream(DataSourceStreamReader):
    """New files by time of change and name; an offset names the last file that a batch took."""

    def __init__(self, options: dict):
        self.vendor = Vendor(options)

    def initialOffset(self) -> dict:
        return {"time": "0", "path": ""}

    def latestOffset(self) -> dict:
        files = self.vendor.files()
        return {"time": str(files[-1].mtime_ns), "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high = ((int(o["time"]), o["path"]) for o in (start, end))
        return self.vendor.pieces(f for f in self.vendor.files() if low < (f.mtime_ns, f.path) <= high)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.vendor.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class VendorBars(DataSource):
    """Layouts: csv (with header) and arrays (JSON bar arrays)."""

    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VendorReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VendorStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorBars)
