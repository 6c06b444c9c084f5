"""A log of records as a streaming source: offsets by topic and partition, at most so many records a batch.

The log is what codec.publish() writes: Parquet in a folder for each partition, in order of offset. A position is a query's
own, in its checkpoint, and moves on once a batch is delivered.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .package import ship

if TYPE_CHECKING:
    import pyarrow.parquet as pq

RECORD = "key binary, value binary, partition int, offset long"
_COLUMNS = ["key", "value", "partition", "offset"]


def _local(path: str) -> str:
    """Where a shared folder is mounted; the source opens files itself, so the folder has to be one on all machines."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: the log has to be in a folder that all machines mount")
    return unquote(url.path) if url.scheme else path


@dataclass
class Range(InputPartition):
    partition: int
    start: int
    end: int
    files: list[str]

    def __hash__(self) -> int:
        return hash((self.partition, self.start))


@dataclass
class Batch(InputPartition):
    """One of the batches that are planned at once: a task reads it."""

    number: int
    ranges: list[Range]

    def __hash__(self) -> int:
        return hash((self.number, *self.ranges))


def cut(ranges: list[Range], most: int) -> list[Batch]:
    """The ranges, one after another, as batches of `most` records each; the last may have less."""
    out, left = [], 0
    for r in ranges:
        at = r.start
        while at < r.end:
            if not left:
                out.append(Batch(len(out), []))
                left = most
            end = min(r.end, at + left)
            out[-1].ranges.append(Range(r.partition, at, end, r.files))
            left, at = left - (end - at), end
    return out


def shares(available: dict[int, int], most: int) -> dict[int, int]:
    """How many records to take of each partition: none more than there are, no more than `most` in all, as even as that allows."""
    out, left = {}, most
    for i, (p, n) in enumerate(sorted(available.items(), key=lambda x: (x[1], x[0]))):
        out[p] = min(n, left // (len(available) - i))
        left -= out[p]
    return out


def bounds(meta: pq.FileMetaData) -> list[tuple[int, int]]:
    """Least and largest offset of each row group."""
    at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == "offset")  # of leaves, not of columns
    stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
    return [(s.min, s.max) for s in stats]


def groups(meta: pq.FileMetaData, start: int, end: int) -> list[int]:
    """The row groups that may have offsets from start on and below end."""
    return [i for i, (low, high) in enumerate(bounds(meta)) if low < end and high >= start]


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.topic = _local(options["path"]), options.get("topic", "events")
        self.most, self.batches = int(options.get("maxrecords", "100000")), int(options.get("batches", "0"))
        if self.most < 1:
            raise ValueError("a batch takes one record at least")
        if self.batches < 0:
            raise ValueError("batches are counted from one on")
        self.checkpoint = _local(options["checkpoint"]) if "checkpoint" in options else None
        self.known: dict[str, tuple[int, int]] = {}
        self.position: dict[int, int] | None = None

    def _files(self) -> dict[int, list[tuple[int, int, str]]]:
        """(first, end, path) of the files of each partition, from their footers; a file is read for this once."""
        import pyarrow.parquet as pq

        out: dict[int, list[tuple[int, int, str]]] = {}
        for folder in sorted(os.listdir(self.path)) if os.path.isdir(self.path) else []:
            name, _, number = folder.partition("=")
            if name != "partition":
                continue
            for f in sorted(os.listdir(f"{self.path}/{folder}")):
                file = f"{self.path}/{folder}/{f}"
                if not f.endswith(".parquet") or f[0] in "._":
                    continue
                if file not in self.known:
                    found = bounds(pq.ParquetFile(file).metadata)
                    self.known[file] = (min(low for low, _ in found), max(high for _, high in found) + 1) if found else (0, 0)
                out.setdefault(int(number), []).append((*self.known[file], file))
        return out

    def ends(self) -> dict[int, int]:
        return {p: max(end for _, end, _ in files) for p, files in self._files().items()}

    def _resumed(self) -> dict[int, int]:
        """The position that the query's checkpoint was last planned to, if it has one."""
        folder = f"{self.checkpoint}/offsets"
        batches = [int(n) for n in os.listdir(folder) if n.isdigit()] if self.checkpoint and os.path.isdir(folder) else []
        if not batches:
            return {}
        with open(f"{folder}/{max(batches)}") as f:
            found = [json.loads(x) for x in f.read().splitlines()[2:] if x.startswith("{")]
        return next(({int(p): n for p, n in x[self.topic].items()} for x in found if self.topic in x), {})

    def initialOffset(self) -> dict:
        return {self.topic: {}}

    def latestOffset(self) -> dict:
        """Where the next batch may end; the same, however often it is asked, until that batch is planned or more records come."""
        if self.position is None:
            self.position = self._resumed()
        available = {p: n - self.position.get(p, 0) for p, n in self.ends().items() if n > self.position.get(p, 0)}
        taken = shares(available, self.most * max(1, self.batches))
        return {self.topic: {str(p): self.position.get(p, 0) + taken.get(p, 0) for p in sorted({*self.position, *taken})}}

    def partitions(self, start: dict, end: dict) -> list[Range] | list[Batch]:
        files, out = self._files(), []
        for p, b in end[self.topic].items():
            a = start[self.topic].get(p, 0)
            if a < b:
                here = [x for x in files.get(int(p), []) if x[0] < b and x[1] > a]
                # a batch's range is cut at the ends of files, so that it names few of them
                ends = sorted({a, b, *(x for first, last, _ in here for x in (first, last) if a < x < b)}) if self.batches else [a, b]
                out += [Range(int(p), low, high, [f for first, last, f in here if first < high and last > low]) for low, high in zip(ends, ends[1:], strict=False)]
        self.position = {int(p): n for p, n in end[self.topic].items()}
        return cut(out, self.most) if self.batches else out

    def read(self, partition: Range | Batch) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        for r in partition.ranges if self.batches else [partition]:
            for path in r.files:
                file = pq.ParquetFile(path)
                for b in file.iter_batches(columns=["key", "value", "offset"], row_groups=groups(file.metadata, r.start, r.end)):
                    at = b.column("offset")
                    b = b.filter(pc.and_(pc.greater_equal(at, r.start), pc.less(at, r.end)))
                    column = lambda n: pa.array([n] * len(b), pa.int32())  # noqa: B023, E731
                    out = [b.column("key").cast(pa.binary()), b.column("value").cast(pa.binary()), column(r.partition), b.column("offset")]
                    yield pa.RecordBatch.from_arrays([*out, column(partition.number)], [*_COLUMNS, "part"]) if self.batches else pa.RecordBatch.from_arrays(out, _COLUMNS)


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return f"{RECORD}, part int" if int({k.lower(): v for k, v in self.options.items()}.get("batches", "0")) else RECORD

    def streamReader(self, schema: object) -> LogReader:
        return LogReader(dict(self.options))


def read_log(spark: SparkSession, path: str, checkpoint: str | None = None, max_records: int = 100_000, topic: str = "events", batches: int | None = None) -> DataFrame:
    """Records from the earliest on, at most max_records a batch, shared out evenly among partitions that have some.

    With `batches` up to so many batches are read at once, each by a task, all full but the last; the further column part
    numbers them within Spark's micro-batch. So the time doesn't grow with the number of batches where these are small.
    checkpoint is that of the query which will read; without it a query that is started again plans its first batch as if
    anew, which repeats records but loses none.
    """
    ship(spark)
    spark.dataSource.register(RecordLog)
    reader = spark.readStream.format("record_log").option("path", path).option("maxRecords", max_records).option("topic", topic)
    reader = reader.option("batches", batches) if batches else reader
    return (reader.option("checkpoint", checkpoint) if checkpoint else reader).load()
