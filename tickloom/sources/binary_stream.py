"""A binary research stream as a Spark data source: text lines that say what comes, and blocks of little-endian doubles between.

`META k=v ...`, then for each instrument `INST name kind sector`, blocks `ROWS n` followed by n rows of six doubles (time in seconds, open,
high, low, close, volume, in order of time) and `DONE name status`, and `END` at last. Headers tell where blocks lie without reading
them: they are hopped over once, blocks become the source's partitions, and those that no asked instrument or day is in are never read.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from tickloom.sources import files

FIELDS = ("time", "open", "high", "low", "close", "volume")
ROW = 8 * len(FIELDS)
SCHEMA = "instrument string, kind string, sector string, status string, day int, time double, open double, high double, low double, close double, volume double"
#: Days are those of India's time.
OFFSET = 19800


@dataclass
class Block:
    path: str
    at: int
    rows: int
    first_day: int
    last_day: int


@dataclass
class Instrument:
    name: str
    kind: str
    sector: str
    status: str
    blocks: list[Block]


def _day(seconds: float) -> int:
    return int((seconds + OFFSET) // 86400)


def index(path: str, torn: str = "reject") -> tuple[dict, list[Instrument]]:
    """(what META, STOP and END say, instruments in order) of a file; of its rows only the first and last of each block are looked at.

    An instrument that the file doesn't finish is left out, or with torn="fail" an error.
    """
    meta: dict = {"interval": 5, "complete": False}
    out: list[Instrument] = []
    current: Instrument | None = None
    with files.opened(path) as raw:
        head = raw.read(2)
        raw.seek(0)
        f = io.BytesIO(_unzipped(raw.read())) if head == b"\x1f\x8b" else io.BufferedReader(_Raw(raw))
        size = f.seek(0, io.SEEK_END)
        f.seek(0)
        while line := f.readline():
            tag, *parts = line.decode().strip().split(" ")
            if not line.endswith(b"\n") and tag != "END":
                break  # a torn header
            if tag == "META":
                meta |= {k: int(v) if v.isdigit() else v for k, _, v in (p.partition("=") for p in parts)}
            elif tag == "INST":
                current = Instrument(*parts[:3], "", [])
            elif tag == "ROWS" and current is not None:
                n, at = int(parts[0]), f.tell()
                if at + n * ROW > size:
                    break
                if n:
                    ends = []
                    for k in (0, n - 1):
                        f.seek(at + k * ROW)
                        ends.append(_day(np.frombuffer(f.read(8), "<f8")[0]))
                    current.blocks.append(Block(path, at, n, min(ends), max(ends)))
                f.seek(at + n * ROW)
            elif tag == "DONE" and current is not None:
                current.status = parts[1] if len(parts) > 1 else "OK"
                out.append(current)
                current = None
            elif tag == "STOP":
                meta["stopped"] = " ".join(parts)
            elif tag == "END":
                meta["complete"] = True
                break
    if current is not None and torn == "fail":
        raise EOFError(f"{path}: the stream ends within {current.name}")
    return meta, out


def _unzipped(data: bytes) -> bytes:
    """All that a gzip file holds, up to where it is torn."""
    return zlib.decompressobj(31).decompress(data)


class _Raw(io.RawIOBase):
    """A pyarrow file as Python's buffered reader wants it."""

    def __init__(self, f) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        return self.f.seek(at, whence)

    def tell(self) -> int:
        return self.f.tell()


@dataclass
class Part(InputPartition):
    """Blocks that one task reads, each with its instrument."""

    blocks: list[tuple[Instrument, Block]]


class StreamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.torn = options["path"], options.get("torn", "reject")
        self.rows = int(options.get("rowsperpartition", 1 << 20))
        self.names: set[str] | None = None
        self.days = [int(options.get("dayfrom", -(1 << 31))), int(options.get("dayto", 1 << 31))]
        if options.get("instruments"):
            self.names = set(options["instruments"].split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Instruments and days are chosen here; Spark applies all others, and days again within blocks."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("instrument",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
                continue
            if f.__class__ in (EqualTo, GreaterThanOrEqual, LessThanOrEqual) and f.attribute == ("day",):
                if not isinstance(f, LessThanOrEqual):
                    self.days[0] = max(self.days[0], f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.days[1] = min(self.days[1], f.value)
            yield f

    def chosen(self) -> list[tuple[Instrument, Block]]:
        out = []
        for path, _ in files.listed(self.path, ""):
            _, instruments = index(path, self.torn)
            for x in instruments:
                if self.names is None or x.name in self.names:
                    out += [(x, b) for b in x.blocks if b.last_day >= self.days[0] and b.first_day <= self.days[1]]
        return out

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        held = self.rows
        for x, b in self.chosen():
            if held >= self.rows or parts[-1].blocks[-1][1].path != b.path:
                parts.append(Part([]))
                held = 0
            parts[-1].blocks.append((Instrument(x.name, x.kind, x.sector, x.status, []), b))
            held += b.rows
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        path = partition.blocks[0][1].path
        with files.opened(path) as raw:
            zipped = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            f = io.BytesIO(_unzipped(raw.read())) if zipped else raw
            for x, b in partition.blocks:
                f.seek(b.at)
                rows = np.frombuffer(f.read(b.rows * ROW), "<f8").reshape(-1, len(FIELDS))
                days = ((rows[:, 0] + OFFSET) // 86400).astype(np.int32)
                rows, days = (a[(days >= self.days[0]) & (days <= self.days[1])] for a in (rows, days))
                said = [pa.array([v] * len(rows), pa.string()) for v in (x.name, x.kind, x.sector, x.status)]
                yield pa.RecordBatch.from_arrays([*said, pa.array(days), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FIELDS)))], ["instrument", "kind", "sector", "status", "day", *FIELDS])


class BinaryStream(DataSource):
    """spark.read.format("binary_stream"): options path, instruments (comma-separated), dayFrom, dayTo (days since 1970), torn, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "binary_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def read_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Rows of all streams below a path; filters on instrument and day choose what is read."""
    spark.dataSource.register(BinaryStream)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("binary_stream").options(**{k: str(v) for k, v in options.items()}).load(path)


def encoded(instruments: Iterator[tuple[str, str, str, str, np.ndarray]], interval: int, block: int = 4096) -> Iterator[bytes]:
    """A stream of (name, kind, sector, status, rows)."""
    yield f"META interval={interval}\n".encode()
    for name, kind, sector, status, rows in instruments:
        yield f"INST {name} {kind} {sector}\n".encode()
        for at in range(0, len(rows), block):
            part = np.ascontiguousarray(rows[at : at + block], "<f8")
            yield f"ROWS {len(part)}\n".encode() + part.tobytes()
        yield f"DONE {name} {status}\n".encode()
    yield b"END\n"


def write_streams(rows: DataFrame, path: str, parts: int, interval: int, block: int = 4096) -> list[str]:
    """Writes rows (instrument, kind, sector, status and FIELDS) as `parts` files, each with whole instruments; the files' paths.

    A file is of its partition's number, so a task that runs again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches))
        names = table.column("instrument").to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        values = np.column_stack([table.column(c).to_numpy() for c in FIELDS]) if len(names) else np.zeros((0, len(FIELDS)))
        several = ((*(table.column(c)[a].as_py() for c in ("instrument", "kind", "sector", "status")), values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
        target = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.stream"
        files.written(target, b"".join(encoded(several, interval, block)))
        yield pa.RecordBatch.from_arrays([pa.array([target])], ["file"])

    told = rows.select("instrument", "kind", "sector", "status", *[rows[c].cast("double").alias(c) for c in FIELDS]).repartition(parts, "instrument").sortWithinPartitions("instrument", "time")
    return sorted(r.file for r in told.mapInArrow(run, "file string").collect())
