"""From raw documents to encoded training text, one operator to a stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents, with the last one's result in their place. STAGES can be run one by one, each written as Parquet and
read again by the next; run() does this in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import decontaminate, linededup, neardup, pieces, quality
from basalt.llm.common import drop, materialize, prepare, table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns.

    Labels of every fifth id (by crc32) are not learned from. A null or empty text is scored as an empty line; repeated rows
    are all scored; an empty table stays empty.
    """
    prepare(spark)
    may_learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), may_learn)
    return quality.keep_good(docs, model, LEAST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sites or more, unless no other would be left; n_chars is that of the new text.

    Null and empty texts stay as they are, as do repeated rows and an empty table; all columns stay.
    """
    prepare(spark)
    out = linededup.remove_boilerplate(docs, min_sites=10)
    changed = F.col(f"`{out.columns[-1]}`") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, likeness of 0.8 or more), the one of least id.

    Documents without words all stay; of repeated rows one stays; a null id comes last; an empty table stays empty.
    """
    prepare(spark)
    return neardup.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (80 % of its shingles or more).

    Null and empty texts hold none; repeated rows are decided alike; an empty table on either side changes nothing.
    """
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), width=5, min_percent=80)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with its three best segmentations' scores.

    A null text is encoded as an empty one, to no ids; repeated rows stay; an empty table gives no rows.
    """
    prepare(spark)
    return pieces.encode_texts(docs, PIECES, 3, ("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: SQL can't express the classifier nor the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the one before it kept stays in the shared folder, as they are read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
