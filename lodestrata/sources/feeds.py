"""Stored price responses as a Spark data source: ``spark.read.format("responses")``, and ``readStream`` for a feed that never goes back.

Responses lie in folders ``arrived=<when>/instrument_id=<id>/span=<yyyy or yyyy-MM>``, one JSON body a line; ``span`` is the period of a body's rows, ``arrived``
(any text that sorts by time; it may be left out, and is the span then) says when they came. A body is a list of klines ([open time in ms, open,
high, low, close, volume, ..]) or of end-of-day objects. A body that is an object is a source's refusal of an unknown instrument: it gives no
rows, or an error with ``unknown=fail``.

Batch: of a range (options ``first`` and ``last``, both included, and ``instruments``, a JSON list; see ``read_responses``) the files outside are never opened,
and each task reads files of about ``partitionBytes`` in the order of their spans. The range comes as options and not by Spark's filter push-down for
Python sources, as that keeps the filters of a loaded frame's first query for its later ones, which then lack rows.
Stream: the offset is the newest arrival, so a restart goes on behind what was read; ``until`` holds back later arrivals. Arrivals are
written once and in order: one that is not newer than the offset is never read, and an offset before the last one is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "instrument_id string, ts date, open double, high double, low double, close double, volume double, arrived string"
_PRICES = ("open", "high", "low", "close", "volume")
_ARROW = pa.schema([("instrument_id", pa.string()), ("ts", pa.date32()), *[(c, pa.float64()) for c in _PRICES], ("arrived", pa.string())])
_EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class Stored:
    """One file of bodies."""

    path: str
    size: int
    instrument_id: str
    span: str
    arrived: str

    def days(self) -> tuple[date, date]:
        """First and last day of the span."""
        if len(self.span) == 4:
            return date(int(self.span), 1, 1), date(int(self.span), 12, 31)
        year, month = map(int, self.span.split("-"))
        return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)


@dataclass
class Files(InputPartition):
    files: tuple[Stored, ...]


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def stored_files(path: str) -> list[Stored]:
    fs, root = _file_system(path)
    out = []
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.type != pafs.FileType.File or f.base_name.startswith(("_", ".")):
            continue
        keys = dict(p.split("=", 1) for p in f.path[len(root) :].split("/") if "=" in p)
        keys = {k: unquote(v) for k, v in keys.items()}
        out.append(Stored(f.path, f.size, keys["instrument_id"], keys["span"], keys.get("arrived", keys["span"])))
    return sorted(out, key=lambda f: (f.span, f.instrument_id, f.arrived, f.path))


def in_parts(files: Iterable[Stored], size: int) -> list[Files]:
    """Successive files, about ``size`` bytes together."""
    out, part, n = [], [], 0
    for f in files:
        if part and n + f.size > size:
            out.append(Files(tuple(part)))
            part, n = [], 0
        part.append(f)
        n += f.size
    return [*out, Files(tuple(part))] if part else out


def body_rows(body: str, unknown: str = "skip") -> list[tuple]:
    """(day, open, high, low, close, volume) of a response."""
    rows = json.loads(body)
    if isinstance(rows, dict):
        if unknown == "fail":
            raise LookupError(f"the source refuses: {rows.get('msg') or rows.get('detail') or body}")
        return []
    out = []
    for r in rows:
        if isinstance(r, dict):
            day, prices = date.fromisoformat(r["date"][:10]), [r.get(c) for c in _PRICES]
        else:
            day, prices = _EPOCH + timedelta(milliseconds=int(r[0])), r[1:6]
        out.append((day, *[None if x is None else float(x) for x in prices]))
    return out


def _read(path: str, files: Files, unknown: str, keep=lambda day: True) -> Iterator[pa.RecordBatch]:
    fs, _ = _file_system(path)
    for f in files.files:
        with fs.open_input_stream(f.path) as s:
            lines = s.read().decode().splitlines()
        for body in lines:
            rows = [r for r in body_rows(body, unknown) if keep(r[0])]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([f.instrument_id] * len(rows)), pa.array(cols[0], pa.date32()), *[pa.array(c, pa.float64()) for c in cols[1:]], pa.array([f.arrived] * len(rows))], schema=_ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.unknown = options["path"], options.get("unknown", "skip")
        self.size = int(options.get("partitionbytes", 64 << 20))
        self.first, self.last = date.fromisoformat(options.get("first", "0001-01-01")), date.fromisoformat(options.get("last", "9999-12-31"))
        self.instruments = set(json.loads(options["instruments"])) if "instruments" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        def wanted(f: Stored) -> bool:
            a, b = f.days()
            return a <= self.last and b >= self.first and (self.instruments is None or f.instrument_id in self.instruments)

        # A source without partitions is refused by Spark; an empty one reads nothing.
        return in_parts(filter(wanted, stored_files(self.path)), self.size) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.unknown, lambda day: self.first <= day <= self.last)


class Feed(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.unknown, self.until = options["path"], options.get("unknown", "skip"), options.get("until")
        self.size = int(options.get("partitionbytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"arrived": ""}

    def latestOffset(self) -> dict:
        return {"arrived": max((f.arrived for f in stored_files(self.path) if self.until is None or f.arrived <= self.until), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["arrived"] < start["arrived"]:
            raise ValueError(f"a feed doesn't go back: {end['arrived']} is before {start['arrived']}")
        return in_parts((f for f in stored_files(self.path) if start["arrived"] < f.arrived <= end["arrived"]), self.size)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition, self.unknown)

    def commit(self, end: dict) -> None:
        pass


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Feed:
        return Feed(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session."""
    spark.dataSource.register(Responses)
    return spark


def read_responses(spark: SparkSession, path: str, first: date | None = None, last: date | None = None, instruments: list[str] | None = None, unknown: str = "skip") -> DataFrame:
    """Bars of a range of days (both ends included; None: open) and of some instruments (None: all)."""
    r = register(spark).read.format("responses").option("path", path).option("unknown", unknown)
    for name, day in (("first", first), ("last", last)):
        if day is not None:
            r = r.option(name, day.isoformat())
    if instruments is not None:
        r = r.option("instruments", json.dumps(instruments))
    return r.load()


def write_responses(bars: DataFrame, path: str) -> None:
    """Bars (with ``arrived`` and ``span``) as kline bodies in the folders that the format reads; one body holds one span of an instrument."""
    ms = (F.unix_date("ts").cast("long") * 86_400_000).cast("string")
    line = F.array(ms, *[F.col(c).cast("string") for c in _PRICES])
    bodies = bars.groupBy("arrived", "instrument_id", "span").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ts", line.alias("k")))), lambda x: x["k"])).alias("value"))
    bodies.repartition("arrived", "instrument_id").write.partitionBy("arrived", "instrument_id", "span").text(path)
