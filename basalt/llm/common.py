"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.package import ship

__all__ = ["drop", "free_name", "keep_rows", "materialize", "prepare", "release", "shared_dir", "ship", "table"]

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}  # of each application: its own folder, and the scratch tables it has left
_left: dict[str, set[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Settings that the queries over whole texts want of their session: batches of at most 1,000 rows go to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores after it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where the session names none, a session in one process makes a temporary one; on a cluster that is an error,
    since executors don't see each other's local folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[\d*]+(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = _own.get(spark.sparkContext.applicationId)
        if where is None:
            where = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="basalt-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where.rstrip("/")


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the shuffle files of a finished write are removed instead of waiting for the driver's garbage collection."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The result has no lineage, survives a lost executor and is read as often as needed without being
    computed again. The folder is scratch space: drop() removes a table that is no longer needed, and release()
    what is left of a session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/basalt-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._basalt_path = path
    _left.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _left.get(spark.sparkContext.applicationId, set()).discard(path)


def drop(*tables: DataFrame) -> None:
    """Remove the files behind tables that materialize() wrote, once nothing reads them any more."""
    for df in tables:
        _remove(df.sparkSession, df._basalt_path)


def release(spark: SparkSession) -> None:
    """Remove all scratch tables of this session that are left: those that results returned so far still read."""
    for path in sorted(_left.get(spark.sparkContext.applicationId, ())):
        _remove(spark, path)


def keep_rows(docs: DataFrame, text_col: str, wanted: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Rows of docs whose text is wanted, with all their columns, whatever these are called."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(wanted(b.column(at).to_pylist()), pa.bool_()))

    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
