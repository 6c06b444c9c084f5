"""Events as records of the backbone: value bytes, key and headers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.contract import EVENT_TYPE, get

PARTITIONS = 12


def encode(event: Column) -> Column:
    """JSON in UTF-8; absent fields are left out."""
    return F.to_json(event).cast("binary")


def decode(df: DataFrame, value: str = "value", event: str = "event") -> DataFrame:
    """df with the event and undecodable; an empty value is an empty event, unknown fields are ignored."""
    text = F.when(F.length(value) == 0, F.lit("{}")).otherwise(F.decode(F.col(value), "UTF-8"))
    schema = T.StructType(EVENT_TYPE.fields + [T.StructField("_broken", T.StringType())])
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = df.withColumn("_parsed", parsed)
    bad = F.col("_parsed").isNull() | F.col("_parsed._broken").isNotNull()
    fields = [F.col("_parsed")[f].alias(f) for f in EVENT_TYPE.fieldNames()]
    return out.withColumn("undecodable", bad).withColumn(event, F.when(~bad, F.struct(*fields))).drop("_parsed")


def to_records(df: DataFrame, event: str = "event", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, value, headers): one record for each event, keyed by its agent; with columns to keep beside it."""
    header = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value"))
    headers = F.array(header("content-type", "application/json"), header("schema", "security.event"), header("schema-version", "1"))
    return df.select(get(F.col(event), "origin.agent_id").cast("binary").alias("key"), encode(F.col(event)).alias("value"), headers.alias("headers"), *keep)


def partition_of(key: Column, partitions: int = PARTITIONS) -> Column:
    """The partition in which publish() puts a key."""
    return F.pmod(F.hash(key), F.lit(partitions))


#: Bytes of keys, values and other texts that one task of publish() sorts and writes.
PIECE_BYTES = 256 << 20
#: Bytes of a row group of the log before compression, the least that a reader of a few records reads.
GROUP_BYTES = 8 << 20
_SAMPLED = 256


def _pieces(staged: DataFrame, row: Column, partitions: int) -> list[tuple]:
    """(partition, piece, first row of it, first row of the next, records) of the ranges into which partitions are cut.

    A partition of up to PIECE_BYTES is one piece of its own number; further pieces of larger ones have numbers from `partitions` on.
    Ends are taken from a sample, which decides how even the pieces are and nothing else. All lists have a row a piece.
    """
    totals = sorted((r.partition, r.bytes, r.records) for r in staged.groupBy("partition").agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("records")).collect())
    wanted = {p: -(-size // PIECE_BYTES) for p, size, _ in totals if size > PIECE_BYTES}
    if not wanted:
        return [(p, p, None, None, n) for p, _, n in totals]
    one_in = max(1, sum(n for p, _, n in totals if p in wanted) // (_SAMPLED * sum(wanted.values())))
    cuts = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    sample = staged.filter(F.col("partition").isin(*wanted) & (F.pmod(F.xxhash64("_tie"), F.lit(one_in)) == 0)).select("partition", row.alias("row"), "_bytes")
    upto = F.sum("_bytes").over(Window.partitionBy("partition").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    share = F.coalesce(upto, F.lit(0)) / F.sum("_bytes").over(Window.partitionBy("partition"))
    firsts = sample.withColumn("cut", F.floor(share * cuts[F.col("partition")])).groupBy("partition", "cut").agg(F.min("row").alias("row")).collect()
    out, free = [], partitions
    for p, _, _ in totals:
        ends = [r.row for r in sorted((r for r in firsts if r.partition == p), key=lambda r: r.cut)][1:]
        for i, (low, high) in enumerate(zip([None, *ends], [*ends, None], strict=True)):
            out.append((p, free if i else p, low, high, 0))
            free += i > 0
    counts = {r.piece: r["count"] for r in _in_pieces(staged, row, out).groupBy("piece").count().collect()}
    return [(p, piece, low, high, counts.get(piece, 0)) for p, piece, low, high, _ in out]


def _in_pieces(staged: DataFrame, row: Column, pieces: list[tuple]) -> DataFrame:
    """staged with the piece of each row, and the last field of that piece's tuple as _start."""
    kind = staged.select(row.alias("row")).schema["row"].dataType
    schema = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("_low", kind), T.StructField("_high", kind), T.StructField("_start", T.LongType())])
    ranges = staged.sparkSession.createDataFrame(pieces, schema)
    low, high = F.col("_low").isNull() | (row >= F.col("_low")), F.col("_high").isNull() | (row < F.col("_high"))
    return staged.join(F.broadcast(ranges.withColumnRenamed("partition", "_of")), (F.col("partition") == F.col("_of")) & low & high).drop("_of", "_low", "_high")


def publish(records: DataFrame, path: str, partitions: int = PARTITIONS, order: tuple[str, ...] = ()) -> None:
    """Append records(key, value, headers) to a log: those of a key lie in one partition, in the order of the columns `order`.

    Offsets go on from the log's last, without gaps. The records are first put beside the log, so they are computed once; a
    partition is then cut into ranges of that order, each of which is sorted and written as one file by one task, so a task has
    no more to do where there are more records, or few keys. Without `order` records lie in any order. Columns of the order are
    left out; only one publisher may write at a time.
    """
    spark = records.sparkSession
    try:
        # as many rows as partitions
        ends = {r[0]: r[1] + 1 for r in spark.read.parquet(path).groupBy("partition").agg(F.max("offset")).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ends = {}
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}")
    try:
        texts = [f.name for f in records.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(64).cast("long"))
        placed = records.withColumn("partition", partition_of(F.col("key"), partitions))
        placed.withColumn("_bytes", size).withColumn("_tie", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at.toString())
        staged = spark.read.schema(T.StructType([*placed.schema.fields, T.StructField("_bytes", T.LongType()), T.StructField("_tie", T.LongType())])).parquet(at.toString())
        row = F.struct(*order, "key", "_tie")
        pieces = []
        for p, piece, low, high, n in _pieces(staged, row, partitions):
            pieces.append((p, piece, low, high, ends.get(p, 0)))
            ends[p] = ends.get(p, 0) + n
        cut = _in_pieces(staged, row, pieces).repartitionById(max(partitions, 1 + max((x[1] for x in pieces), default=0)), F.col("piece")).sortWithinPartitions("partition", *order, "key", "_tie")
        nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its task, which has one piece
        numbered = cut.withColumn("offset", F.col("_start") + nth).select(*[c for c in placed.columns if c not in order], "offset")
        numbered.write.mode("append").partitionBy("partition").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    finally:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Offsets of a partition that delivery() looks at in one task.
CHUNK = 1 << 17


def delivery(df: DataFrame, key: str = "key", sequence: str = "sequence", partition: str = "partition", offset: str = "offset") -> DataFrame:
    """(key, records, partitions, out_of_order, repeated) of each key.

    Within a key and partition, in order of offset: records whose sequence is below their predecessor's, and
    those that have the same. Records are compared in chunks of offsets, and then the ends of neighbouring chunks.
    """
    at = F.coalesce(F.col(offset).cast("long"), F.lit(-(1 << 63)))
    df = df.select(F.col(key).alias("_key"), F.col(partition).alias("_part"), at.alias("_at"), F.col(sequence).alias("_now")).withColumn("_chunk", F.floor(F.col("_at") / CHUNK))
    df = df.withColumn("_before", F.lag("_now").over(Window.partitionBy("_key", "_part", "_chunk").orderBy("_at")))
    count = lambda when: F.coalesce(F.sum(when.cast("long")), F.lit(0))
    chunks = df.groupBy("_key", "_part", "_chunk").agg(
        F.count(F.lit(1)).alias("n"),
        count(F.col("_now") < F.col("_before")).alias("below"),
        count(F.col("_now") == F.col("_before")).alias("same"),
        F.min_by("_now", "_at").alias("_first"),
        F.max_by("_now", "_at").alias("_last"),
    )
    last = F.lag("_last").over(Window.partitionBy("_key", "_part").orderBy("_chunk"))
    chunks = chunks.withColumn("_last", last)
    return chunks.groupBy(F.col("_key").alias(key)).agg(
        F.sum("n").alias("records"),
        F.countDistinct("_part").alias("partitions"),
        (F.sum("below") + count(F.col("_first") < F.col("_last"))).alias("out_of_order"),
        (F.sum("same") + count(F.col("_first") == F.col("_last"))).alias("repeated"),
    )


def quarantine(df: DataFrame) -> DataFrame:
    """Refused records with their bytes and key untouched, and why and where they were read."""
    header = lambda k, c: F.struct(F.lit(k).alias("key"), F.coalesce(c.cast("string"), F.lit("")).cast("binary").alias("value"))
    headers = F.array(
        header("quarantine-reason", F.col("outcome")),
        header("quarantine-detail", F.col("detail")),
        header("source-partition", F.col("partition")),
        header("source-offset", F.col("offset")),
    )
    return df.filter("outcome <> 'row'").select("key", "value", headers.alias("headers"), "partition", "offset", F.col("outcome").alias("reason"), "detail")
