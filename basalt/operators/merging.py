"""The store with merges: batches in folders of their own, and months rewritten to one row a key.

A batch is one folder, so writing it again replaces it. A merge rewrites the months that new batches touch, sorted by key,
into folders of a new version, and publishes them with the batches that went in by renaming one small file; a reader
that opened the store before keeps reading the folders it knows. So merged rows need no dedup and no shuffle: only
the batches since the last merge do, and they meet merged rows through their keys alone.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .project import COLUMNS
from .store import KEY, final, month


@dataclass
class State:
    """What a version is made of: the version in which each month was last merged, and the batches that went in."""

    version: int = 0
    months: dict[str, int] = field(default_factory=dict)
    absorbed: list[str] = field(default_factory=list)


class _Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def whole(self, folder: str) -> bool:
        return self.fs.exists(self.path(f"{folder}/_SUCCESS"))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file whole or not at all; one that is there already is an error, as claiming its name is refused to all but the first."""
        claim = self.path(f"{name}.claim")
        self.fs.mkdirs(claim.getParent())
        self.fs.create(claim, False).close()
        part = f"{name}.{self.jvm.java.util.UUID.randomUUID()}.tmp"
        stream = self.fs.create(self.path(part))
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self.path(part), self.path(name)):
            self.fs.delete(self.path(part), False)
            raise FileExistsError(name)

    def delete(self, folder: str) -> None:
        self.fs.delete(self.path(folder), True)


def _state(files: _Files) -> State:
    versions = [n for n in files.names("ledger") if n.endswith(".json")]
    return State(**json.loads(files.read(f"ledger/{versions[-1]}"))) if versions else State()


def write_batch(rows: DataFrame, root: str, batch: str, write_seq: Column) -> None:
    """Put a batch's rows, in the store's columns, into its folder; the same batch again replaces what is there.

    write_seq says which of two rows with one key was written later. Rows are dealt by month in as many parts as their size
    asks, and sorted by key within files.
    """
    out = rows.withColumn("write_seq", write_seq).withColumn("event_month", month(F.col("event_time")))
    out = out.hint("rebalance", F.col("event_month")).sortWithinPartitions("event_month", *KEY)
    out.write.mode("overwrite").partitionBy("event_month").option("compression", "zstd").parquet(f"{root}/raw/batch={batch}")


@dataclass
class Snapshot:
    """merged: one row a key; tail: rows of later batches, as they were written. Either may be None."""

    merged: DataFrame | None
    tail: DataFrame | None
    state: State
    batches: list[str]


def _read(spark: SparkSession, base: str, folders: list[str], schema=None) -> DataFrame | None:
    reader = (spark.read.schema(schema) if schema is not None else spark.read).option("basePath", base)
    return reader.parquet(*folders).drop("batch", "version") if folders else None


def open_store(spark: SparkSession, root: str, schema=None) -> Snapshot:
    """The store as it stands: what the last merge published and the batches since, each of which is whole.

    schema is that of the rows with write_seq, where a batch may be without any rows.
    """
    files = _Files(spark, root)
    state = _state(files)
    new = [n for n in files.names("raw") if n.partition("=")[2] not in state.absorbed and files.whole(f"raw/{n}")]
    merged = [f"{root}/merged/version={v}/event_month={m}" for m, v in sorted(state.months.items())]
    tail = [f"{root}/raw/{n}" for n in new]
    return Snapshot(_read(spark, f"{root}/merged", merged, schema), _read(spark, f"{root}/raw", tail, schema), state, [n.partition("=")[2] for n in new])


def final_rows(s: Snapshot) -> DataFrame:
    """One row a key, the one written last, in the store's columns and write_seq.

    Without a tail this is a scan. With one, the tail alone is shuffled and deduplicated; merged rows are looked up in its
    keys, which Spark broadcasts where it knows them to be few.
    """
    keep = [*COLUMNS, "write_seq"]
    if s.tail is None:
        if s.merged is None:
            raise ValueError("the store is empty")
        return s.merged.select(*keep)
    last = final(s.tail, keep=keep)
    if s.merged is None:
        return last
    keys = last.select(*KEY, F.col("write_seq").alias("_seq"))
    newer = s.merged.join(keys, list(KEY), "left_anti")
    # keys in both: whichever was written later; of the merged table only keys and order are read for it
    both = s.merged.select(*KEY, F.col("write_seq").alias("_old")).join(keys, list(KEY))
    late = both.filter("_old >= _seq").select(*KEY)
    kept = s.merged.join(late, list(KEY), "left_semi")
    return newer.select(*keep).unionByName(kept.select(*keep)).unionByName(last.join(late, list(KEY), "left_anti").select(*keep))


def merge(spark: SparkSession, root: str) -> list[int]:
    """Rewrite the months that batches since the last merge touch, and publish them; returns these months.

    Readers see the store either as it was or as it is after. Of two merges at once the one that publishes second fails
    and changes nothing. Old folders stay until vacuum().
    """
    files = _Files(spark, root)
    s = open_store(spark, root)
    if s.tail is None:
        return []
    months = sorted(r[0] for r in s.tail.select(month(F.col("event_time"))).distinct().collect())  # as many as months
    version = s.state.version + 1
    if months:
        old = [f"{root}/merged/version={s.state.months[str(m)]}/event_month={m}" for m in months if str(m) in s.state.months]
        touched = Snapshot(_read(spark, f"{root}/merged", old), s.tail, s.state, s.batches)
        rows = final_rows(touched).withColumn("event_month", month(F.col("event_time")))
        rows = rows.repartitionByRange("event_month", *KEY).sortWithinPartitions("event_month", *KEY)
        rows.write.mode("overwrite").partitionBy("event_month").option("compression", "zstd").parquet(f"{root}/merged/version={version}")
    there = {n.partition("=")[2] for n in files.names("raw")}
    absorbed = sorted({*s.batches, *(b for b in s.state.absorbed if b in there)})
    state = State(version, s.state.months | {str(m): version for m in months}, absorbed)
    files.publish(f"ledger/{version:012d}.json", json.dumps(state.__dict__))
    return months


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete batches that were merged and versions of months that were merged again; for when no reader uses them any more."""
    files = _Files(spark, root)
    state = _state(files)
    gone = [f"raw/batch={b}" for b in state.absorbed if files.fs.exists(files.path(f"raw/batch={b}"))]
    for name in files.names("merged"):
        version = int(name.partition("=")[2])
        live = {m for m, x in state.months.items() if x == version}
        if version <= state.version:  # a later one is being written
            gone += [f"merged/{name}/{n}" for n in files.names(f"merged/{name}") if n.startswith("event_month=") and n.partition("=")[2] not in live]
    for folder in gone:
        files.delete(folder)
    return sorted(gone)
