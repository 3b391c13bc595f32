"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every normalised text and sets two bits per hash in a blocked Bloom filter; bits that were set by more
than one row make up the second, much emptier filter. Pass 2 tests each hash against it. A row with a bit that
nobody else set has no twin and passes straight through. Only the rest, the possibly repeated hashes, are shuffled
and grouped exactly, so false positives cost a little traffic and never change the result.

The filter that is broadcast has ``BITS_PER_ROW`` bits a row but never more than ``max_filter_mb``. Beyond that
(about 34 million rows at the default) it fills up, more rows count as possibly repeated, and in the limit
all slim rows (hash, id) are grouped by shuffle; texts never are.

Defined cases: a null text is the empty text. A null id comes after every other id. If the row that stays is itself repeated
(same id, same text), exactly one of the repeats stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import join_groups, whole_text
from cellpulse.plans.storage import durable

SEGMENT_BITS = 32_768
BITS_PER_ROW = 16
MAX_FILTER_MB = 64


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(whole_text(text_col)), 256))


def _segments(rows: int, max_filter_mb: int) -> int:
    return max(1, min(-(-rows * BITS_PER_ROW // SEGMENT_BITS), max_filter_mb * 2**20 * 8 // SEGMENT_BITS))


def _with_bits(df: DataFrame, segments: int) -> DataFrame:
    """Add the segment and the two bit positions of each digest."""
    h = F.xxhash64("_sha")
    return df.select(
        "*",
        F.pmod(h, F.lit(segments)).alias("_segment"),
        F.shiftrightunsigned(h, 20).bitwiseAND(SEGMENT_BITS - 1).alias("_bit_a"),
        F.shiftrightunsigned(h, 42).bitwiseAND(SEGMENT_BITS - 1).alias("_bit_b"),
    )


def repeat_filter(digests: DataFrame, segments: int) -> DataFrame:
    """Pass 1: per segment, the bits that at least two rows set."""
    bits = F.explode(F.array_distinct(F.array("_bit_a", "_bit_b")))
    counts = _with_bits(digests, segments).select("_segment", bits.alias("_bit")).groupBy("_segment", "_bit").count()
    return counts.filter("count > 1").groupBy("_segment").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def _is_set(bit: str) -> Column:
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast({bit} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.coalesce(F.expr(f"cast(pow(2, {bit} % 8) as int)").bitwiseAND(byte) > 0, F.lit(False))


def with_suspicion(df: DataFrame, filter_: DataFrame, segments: int) -> DataFrame:
    """Pass 2: add ``_suspect``, whether the digest may occur more than once."""
    tested = _with_bits(df, segments).join(F.broadcast(filter_), "_segment", "left")
    return tested.select(*df.columns, (_is_set("_bit_a") & _is_set("_bit_b")).alias("_suspect"))


def _groups(suspects: DataFrame) -> DataFrame:
    """One row per digest: the row that stays, the size, and how often the staying row's id occurs."""
    by_id = suspects.groupBy("_sha", "doc_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_tag").alias("_tag"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_n", "_tag"))
    out = by_id.groupBy("_sha").agg(first.alias("_first"), F.sum("_n").alias("group_size"))
    return out.select(
        "_sha", F.col("_first.doc_id").alias("keep_id"), F.col("_first._tag").alias("_keep_tag"), F.col("_first._n").alias("_repeats"), "group_size"
    )


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("_sha"), F.monotonically_increasing_id().alias("_tag"))
    return durable(slim, "digests")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _hashed(docs, id_col, text_col)
    total = rows.count()
    segments = _segments(total, max_filter_mb)
    tested = durable(with_suspicion(rows, repeat_filter(rows, segments), segments), "tested")
    alone = tested.filter("not _suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha"
    )
    suspects = tested.filter("_suspect").drop("_suspect")
    judged = join_groups(suspects, durable(_groups(suspects), "groups"), "_sha", "group_size", total)
    judged = judged.select("doc_id", "keep_id", "group_size", (F.col("_tag") == F.col("_keep_tag")).alias("kept"), "_sha")
    out = alone.unionByName(judged)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; only possibly repeated rows are shuffled."""
    rows = _hashed(docs, id_col, text_col)
    segments = _segments(rows.count(), max_filter_mb)
    filter_ = durable(repeat_filter(rows, segments), "filter")
    keepers = _groups(with_suspicion(rows, filter_, segments).filter("_suspect"))
    keepers = keepers.select("_sha", F.col("keep_id").alias("_keep_id"), "_repeats")
    whole = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), _digest(text_col).alias("_sha"))
    tested = with_suspicion(whole, filter_, segments)
    same = (F.col("s._sha") == F.col("k._sha")) & F.col("s._id").eqNullSafe(F.col("k._keep_id"))
    staying = tested.filter("_suspect").alias("s").join(keepers.alias("k"), same).select("s._row", "s._id", "s._sha", "k._repeats")
    once = staying.filter("_repeats = 1").select("_row")
    # rows repeated with their id: any one of them, chosen by the smallest hash of its columns
    repeated = staying.filter("_repeats > 1").groupBy("_sha", "_id").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return tested.filter("not _suspect").select("_row").unionByName(once).unionByName(repeated).select("_row.*")
