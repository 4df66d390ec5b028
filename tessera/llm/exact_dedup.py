"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 is a Bloom filter of slots_per_row bits a row, of one hash function, that tells bits set once from bits set again. So few of its bits are set by any task that each task keeps the places of its own, combined before they are sent, and the places meet by range; no hash of a text is counted or compared, and texts that share a bit by chance count as possibly repeated. The bits set again go into a dense filter that is small enough to send to all tasks. Pass 2 looks every row up: a row whose bit isn't in it is unique and passes straight through; only the others are shuffled and grouped by their whole SHA-256, which tells the chance meetings apart. Rows themselves, with their ids and texts, never take part in pass 1.

The dense filter has bits_per_hash bits for each bit set again. Once that is over max_bits, the bits are split into ranges with a filter each, which are looked up one after another, so no broadcast is over max_bits / 8 bytes (128 MB by default) and no filter fills up, at any size.

Texts are equal if the same after lower-casing A-Z; null counts as empty, and very long texts are hashed whole. Of equal texts, the row with the largest id stays (null ids count as the smallest); of rows that repeat id and text, exactly one. An empty table gives no rows. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, left_join_groups, staged

HASHES = 2
#: Bits of one row of the filter table, as bitmap_construct_agg makes them.
_ROW_BITS = 32768


def text_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text's UTF-8 bytes."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _flagged(rows: DataFrame, bits_per_hash: int, max_bits: int, slots_per_row: int) -> DataFrame:
    """rows (_sha, ...), which are stored, with _maybe: whether the bit of _sha is in the filter of the bits set again."""
    slots = 1 << max(rows.count() * slots_per_row - 1, 1).bit_length()
    rows = rows.withColumn("_h", F.xxhash64("_sha").bitwiseAND(F.lit(slots - 1)))
    repeated = staged(rows.groupBy("_h").count().where("count > 1").select("_h"), "bits-set-again")
    bits, wanted = _ROW_BITS, repeated.count() * bits_per_hash
    while bits < min(wanted, max_bits):
        bits *= 2
    ranges = max(1, -(-wanted // bits))
    position = lambda i: F.pmod(F.xxhash64("_h", F.lit(i)), F.lit(bits))
    out = None
    for n in range(ranges):
        own = repeated.where(F.pmod("_h", F.lit(ranges)) == n)
        hits = own.select(F.explode(F.array(*map(position, range(HASHES)))).alias("pos"))
        bitmaps = hits.groupBy(F.expr(f"pos div {_ROW_BITS}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"pos % {_ROW_BITS}")).alias("bitmap"))
        part = _looked_up(rows.where(F.pmod("_h", F.lit(ranges)) == n) if ranges > 1 else rows, staged(bitmaps, "repeat-filter"), position)
        if ranges > 1:  # so that one filter is held at a time
            part = staged(part, "looked-up")
        out = part if out is None else out.unionByName(part)
    return out


def _looked_up(rows: DataFrame, bitmaps: DataFrame, position: Callable[[int], Column]) -> DataFrame:
    """rows with _maybe instead of _h: whether all positions of _h are set."""
    maybe = F.lit(True)
    columns = [c for c in rows.columns if c != "_h"]
    for i in range(HASHES):
        rows = rows.withColumn("_pos", position(i)).withColumn("_bucket", F.expr(f"_pos div {_ROW_BITS}"))
        rows = rows.join(F.broadcast(bitmaps.toDF("_bucket", f"_bitmap{i}")), "_bucket", "left")
        byte = F.conv(F.hex(F.expr(f"substring(_bitmap{i}, cast((_pos % {_ROW_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        rows = rows.withColumn(f"_hit{i}", F.coalesce(F.expr("1 << cast(_pos % 8 as int)").bitwiseAND(byte) != 0, F.lit(False)))
        maybe = maybe & F.col(f"_hit{i}")
    return rows.withColumn("_maybe", maybe).select(*columns, "_maybe")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_hash: int = 16, max_bits: int = 1 << 30, slots_per_row: int = 64) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_sha")), "text-hashes")
    flagged = _flagged(rows, bits_per_hash, max_bits, slots_per_row)
    groups = flagged.where("_maybe").groupBy("_sha").agg(F.max(F.struct("_id", "_uid")).alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    unique = flagged.where("not _maybe").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha")
    shared = left_join_groups(flagged.where("_maybe").drop("_maybe"), staged(groups, "copy-groups"), "_sha", "_size", rows.count())
    shared = shared.select(
        "_id",
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | (F.col("_keep._uid") == F.col("_uid"))).alias("kept"),
        "_sha",
    )
    out = unique.unionByName(shared)
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_hash: int = 16, max_bits: int = 1 << 30, slots_per_row: int = 64) -> DataFrame:
    """The rows of docs that stay, whole, with docs' columns. Each text is hashed once; of each text, a task sends one row at most."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"))
    rows = staged(docs.select(whole.alias("_row"), order.alias("_order"), text_hash(F.col(text_col)).alias("_sha")), "hashed-documents")
    flagged = _flagged(rows, bits_per_hash, max_bits, slots_per_row)
    largest = flagged.where("_maybe").groupBy("_sha").agg(F.max_by("_row", "_order").alias("_row"))
    return flagged.where("not _maybe").select("_row.*").unionByName(largest.select("_row.*"))
