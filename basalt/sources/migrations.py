"""Versioned schema changes: SQL files that Spark runs in order, each once."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import outstanding
from ..operators.project import COLUMNS

_NAME = re.compile(r"0*([1-9]\d*)_([a-z0-9_]+)\.sql")
_SHIPPED = "version long, name string, statement string"


def shipped(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(version, name, statement) of the files in a folder; each holds one statement that may be run again."""
    rows = []
    for f in sorted(Path(folder).glob("*.sql")):
        if not (m := _NAME.fullmatch(f.name)):
            raise ValueError(f"{f.name} should read like 0001_name.sql")
        statement = "\n".join(line for line in f.read_text().splitlines() if not line.lstrip().startswith("--")).strip().rstrip(";")
        if not re.match(r"CREATE\s+(TABLE|VIEW)\s+IF\s+NOT\s+EXISTS\b", statement, re.I):
            raise ValueError(f"{f.name} can't be run twice")
        rows.append((int(m[1]), m[2], statement))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("two files have one version")
    return spark.createDataFrame(rows, _SHIPPED)


def apply(spark: SparkSession, folder: str | Path, ledger: str = "schema_migrations") -> list[int]:
    """Run what is outstanding in order of version, and note each in the ledger before the next."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {ledger} (version BIGINT, name STRING, applied_at TIMESTAMP) USING parquet")
    # as many rows as files
    todo = outstanding(shipped(spark, folder), spark.table(ledger)).orderBy("version").collect()
    for m in todo:
        spark.sql(m["statement"])
        spark.sql(f"INSERT INTO {ledger} SELECT :v, :n, current_timestamp()", args={"v": m["version"], "n": m["name"]})
    return [m["version"] for m in todo]


def missing_columns(spark: SparkSession, name: str, declared: list[str] = COLUMNS) -> list[str]:
    """Columns that a table should have and hasn't."""
    present = {c.name for c in spark.catalog.listColumns(name)}
    return [c for c in declared if c not in present]


def require(spark: SparkSession, name: str, declared: list[str] = COLUMNS) -> None:
    """Refuse to start on a table that is behind what was declared."""
    if absent := missing_columns(spark, name, declared):
        raise RuntimeError(f"{name} lacks {', '.join(absent)}; apply the outstanding migrations first")
