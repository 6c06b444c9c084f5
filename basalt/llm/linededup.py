"""Line dedup by cross-site spread: HyperLogLog sketches first, exact counts only near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, free_name, materialize

#: Hashes of boilerplate lines that may be sent to every task: 8 MB of them.
BROADCAST_LINES = 1_000_000


def normalized(line: Column) -> Column:
    """Lines are compared after trimming white space."""
    return F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def _trimmed_chars(text: str) -> Column:
    """Characters of a text's lines after trimming."""
    kept = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x20]*\n[\x00-\x20]*", "\n"), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.char_length(F.replace(kept, F.lit("\n"), F.lit("")))


def _without(lines: Column, gone: Column) -> Column:
    """The text of the lines whose positions aren't in gone, in time linear in both."""

    def joined(t: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(t["lines"]) - 1), t["gone"])
        return F.array_join(F.transform(kept, lambda i: F.get(t["lines"], i)), "\n")

    # as a variable, so that the text is split once and not for each line
    return F.transform(F.array(F.struct(lines.alias("lines"), gone.alias("gone"))), joined)[0]


def lines_of(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(line_hash, site_hash) of every line that isn't blank."""
    rows = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("line"))
    return (
        rows.select("site", normalized(F.col("line")).alias("line"))
        .filter(F.col("line") != "")
        .select(F.xxhash64("line").alias("line_hash"), F.xxhash64(F.coalesce("site", F.lit(""))).alias("site_hash"))
    )


def boilerplate(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source", lg_k: int = 10, sigmas: float = 5.0) -> DataFrame:
    """(line_hash, n_sites) of lines on at least min_sites sites; n_sites is exact near the threshold, else estimated.

    Sketches of sites merge per line hash, on the map side first. A sketch's standard error is about
    1.04 / sqrt(2 ** lg_k); lines whose estimate is within `sigmas` of these from the threshold are counted
    exactly, all others are decided by the sketch. A null site is a site of its own; blank lines never count.
    The result is a table in the shared folder.
    """
    lines = lines_of(docs, text_col, site_col)
    band = sigmas * 1.04 / (2**lg_k) ** 0.5
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site_hash", F.lit(lg_k))).alias("n_sites"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    spread = materialize(spread.filter(F.col("n_sites") >= low))
    near = spread.filter(F.col("n_sites") <= high).select("line_hash")
    exact = (
        lines.join(near, "line_hash", "left_semi")
        .distinct()
        .groupBy("line_hash")
        .agg(F.count(F.lit(1)).alias("n_sites"))
        .filter(F.col("n_sites") >= min_sites)
    )
    out = materialize(spread.filter(F.col("n_sites") > high).unionByName(exact))
    drop(spread)
    return out


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    max_share: float | None = None,
    text_col: str = "text",
    site_col: str = "source",
    id_col: str = "doc_id",
    **sketch: float,
) -> DataFrame:
    """docs, with boilerplate lines taken out of text_col, and a last column with their number (long).

    That column is called lines_removed, with underscores after it where docs has such a column. A document stays as
    it is where nothing of its own would be left: all its lines that aren't blank are boilerplate. It is a copy
    rather than a page around content, for near-duplicate removal to judge. max_share also keeps documents of whose
    trimmed characters more than that share are boilerplate. A null text stays null; an empty table stays empty;
    repeated rows are treated alike and all kept; other columns pass through whatever their names. Only the numbers
    of removed lines are joined to the documents, so the text of a document is shuffled once at most.
    """
    lines = boilerplate(docs, min_sites, text_col, site_col, **sketch).select("line_hash")
    if lines.count() <= BROADCAST_LINES:
        lines = F.broadcast(lines)
    text = F.col(text_col).cast("string")
    key = F.struct(F.md5(text.cast("binary")).alias("m"), F.xxhash64(F.col(id_col)).alias("i"))
    # the key stands below the explode, where it is computed for each document and not for each line
    parts = docs.select(key.alias("k"), text.alias("x")).select("k", F.posexplode(F.split("x", "\n")).alias("pos", "line"))
    parts = parts.select("k", "pos", normalized(F.col("line")).alias("line")).filter(F.col("line") != "")
    parts = parts.select("k", "pos", F.xxhash64("line").alias("line_hash"), F.char_length("line").alias("n"))
    found = parts.join(lines, "line_hash").groupBy("k").agg(F.collect_set("pos").alias("gone"), F.sum("n").alias("gone_chars_x"), F.count(F.lit(1)).alias("rows_x"))
    # a repeated row counts its lines as often as it stands there
    found = found.select("k", "gone", (F.col("gone_chars_x") * F.size("gone") / F.col("rows_x")).alias("gone_chars"))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), text.alias("x"), key.alias("k")).join(found, "k", "left")
    if max_share is None:
        act = F.col("gone").isNotNull() & (F.size("gone") < F.size(F.filter(F.split("x", "\n"), lambda line: normalized(line) != "")))
    else:
        act = F.col("gone").isNotNull() & (F.col("gone_chars") <= max_share * _trimmed_chars("x"))
    rest = _without(F.split("x", "\n"), F.col("gone"))
    out = [F.when(act, rest).otherwise(F.col("x")).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*out, F.when(act, F.size("gone")).otherwise(0).cast("long").alias(free_name("lines_removed", docs.columns)))
