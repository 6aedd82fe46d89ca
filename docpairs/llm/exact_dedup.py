"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
texts the row with the largest ``doc_id`` stays (null ids are smallest).

Pass 1 sets two bits per row in a blocked Bloom filter (a block is one 32,768-bit
bitmap) and keeps the bits that were set more than once: a row whose two bits are both
among them *may* be repeated, any other row is certainly unique. The bits are counted
with map-side combine, so a text that holds a third of all rows sends two rows per task.
Pass 2 probes every row against that filter. Only rows that may be repeated are shuffled
by their SHA-256; the rest pass straight through.

The filter has ``bits_per_row`` bits for each row. Up to ``broadcast_bytes`` it is
broadcast (the size is known exactly before: blocks x 4 KiB); beyond, the short digest
rows are joined with the blocks by a shuffle. Both ways give the same rows.

Cases: an empty table gives an empty result; null and empty texts are equal to each
other; rows repeated as a whole leave one row; any other columns are carried unchanged,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, read, text_or_empty, written

BLOCK_BITS = 32768
BITS_PER_ROW = 16
BROADCAST_BYTES = 32 << 20
#: Groups from one thousandth of all rows on are broadcast.
HOT_SHARE = 1000


def text_digest(col="text") -> Column:
    """SHA-256 (binary) of the normalised text in UTF-8."""
    return F.unhex(F.sha2(lower_ascii(text_or_empty(col)).cast("binary"), 256))


def _with_bits(df: DataFrame, digest: str, n_blocks: int) -> DataFrame:
    """Add the row's block and its two bit positions inside it."""
    h = F.xxhash64(F.col(digest))
    return (df.withColumn("bloom_hash", h)
            .withColumns({"block": F.pmod(F.shiftrightunsigned("bloom_hash", 30), F.lit(n_blocks)).cast("int"),
                          "bit1": F.col("bloom_hash").bitwiseAND(BLOCK_BITS - 1).cast("int"),
                          "bit2": F.shiftrightunsigned("bloom_hash", 15).bitwiseAND(BLOCK_BITS - 1).cast("int")})
            .drop("bloom_hash"))


def repeated_filter(bits: DataFrame) -> DataFrame:
    """Pass 1: ``(block, repeated)``, the bitmap of the bits set more than once."""
    counted = (bits.select("block", F.explode(F.array("bit1", "bit2")).alias("bit"))
               .groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")))
    return (counted.where("n > 1").groupBy("block")
            .agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("repeated")))


def _bit_set(bitmap: str, bit: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.getbit(byte.cast("int"), F.col(bit) % 8) == 1


def mark_possible(bits: DataFrame, bloom: DataFrame, n_blocks: int,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pass 2: add ``maybe_repeated``; false means certainly unique."""
    side = F.broadcast(bloom) if n_blocks * (BLOCK_BITS // 8) <= broadcast_bytes else bloom
    hit = F.col("repeated").isNotNull() & _bit_set("repeated", "bit1") & _bit_set("repeated", "bit2")
    return (bits.join(side, "block", "left").withColumn("maybe_repeated", F.coalesce(hit, F.lit(False)))
            .drop("repeated", "block", "bit1", "bit2"))


def _n_blocks(n_rows: int, bits_per_row: int) -> int:
    return max(1, -(-n_rows * bits_per_row // BLOCK_BITS))


def dedup_report(docs: DataFrame, bits_per_row: int = BITS_PER_ROW,
                 broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The digests are written once (48 bytes a row); no text is shuffled at all. Groups that
    hold a thousandth of all rows or more, of which there are at most a thousand, are
    broadcast with their winners, so the rows of a hot text never meet in one task; the
    others are joined by digest. Rows that tie on the largest ``doc_id`` keep one of them."""
    digests = written(docs.select(F.col("doc_id"), text_digest("text").alias("digest"))
                      .withColumn("row", F.monotonically_increasing_id()), "digests")
    number = digests.count()
    n_blocks = _n_blocks(number, bits_per_row)
    bits = _with_bits(digests, "digest", n_blocks)
    marked = mark_possible(bits, repeated_filter(bits), n_blocks, broadcast_bytes)
    maybe = marked.where("maybe_repeated").drop("maybe_repeated")
    groups = written(maybe.groupBy("digest")
                     .agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count(F.lit(1)).alias("group_size")), "groups")
    hot = F.col("group_size") >= max(2, -(-number // HOT_SHARE))
    few = F.broadcast(groups.where(hot))
    named = maybe.join(few, "digest").unionByName(maybe.join(few, "digest", "left_anti").join(groups.where(~hot), "digest"))
    repeated = named.select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"), "digest")
    unique = marked.where("NOT maybe_repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "digest")
    return (unique.unionByName(repeated)
            .withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest"))


def dedup(docs: DataFrame, bits_per_row: int = BITS_PER_ROW,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Certainly unique rows pass straight through with their text. Rows that may be
    repeated are reduced to one per digest by an aggregate with map-side combine, so a
    hot text moves one row per task."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    digests = written(rows.select(text_digest(F.col("doc.text")).alias("digest")), "digests")
    n_blocks = _n_blocks(digests.count(), bits_per_row)
    bloom = written(repeated_filter(_with_bits(digests, "digest", n_blocks)), "bloom")
    bits = _with_bits(rows.withColumn("digest", text_digest(F.col("doc.text"))), "digest", n_blocks)
    marked = mark_possible(bits, bloom, n_blocks, broadcast_bytes)
    unique = marked.where("NOT maybe_repeated").select("doc")
    one = (marked.where("maybe_repeated").groupBy("digest")
           .agg(F.max_by("doc", F.struct("doc.doc_id", "doc.text")).alias("doc")).select("doc"))
    return unique.unionByName(one).select("doc.*")


def op10_exact_dedup(spark, sf_dir):
    return dedup_report(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
           FROM documents),
     h AS (SELECT doc_id, sha256(s) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
