"""Exact dedup by a two-pass Bloom filter, with DataFrame functions only.

Pass one hashes every normalised text into a filter that keeps the bit positions hit
at least twice. Pass two probes it: a row with a position hit only once has no equal
and passes straight through; the others, true repeats and a few false positives,
shuffle by hash and are grouped. No text is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import settle, table

#: Runs that change under normalisation; a single blank stays as it is.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
BITS_PER_ROW = 16
#: 2^28 bits are 32 MB: the proven bound of the broadcast filter. Beyond it more rows
#: test as repeated and shuffle; the result is the same.
MAX_BITS_LOG2 = 28
BITMAP_BITS = 32_768


def _positions(bits_log2: int) -> tuple[Column, Column]:
    """Two positions of a hash, one in each half of the filter."""
    half = 1 << (bits_log2 - 1)
    first = F.pmod(F.xxhash64("sha"), F.lit(half))
    second = F.pmod(F.xxhash64(F.lit(1), "sha"), F.lit(half)) + F.lit(half)
    return first, second


def repeat_filter(hashes: DataFrame, bits_log2: int) -> DataFrame:
    """(bucket, bits): bitmaps of the positions that two or more rows hit."""
    return (
        hashes.select(F.explode(F.array(*_positions(bits_log2))).alias("position"))
        .groupBy("position").agg(F.count("*").alias("hits")).filter("hits > 1")
        .groupBy(F.expr("position div 32768").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("position", F.lit(BITMAP_BITS))).alias("bits"))
    )


def _is_set(position: str) -> Column:
    """Is the bit of ``position`` set in the bitmap ``bits`` (absent: no bit is)?"""
    byte = f"cast(conv(hex(substring(bits, cast({position} % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce((shiftright({byte}, cast({position} % 8 as int)) & 1) = 1, false)")


def possibly_repeated(hashes: DataFrame, bits_log2: int) -> DataFrame:
    """``hashes`` with a column ``repeated``: False only where no other row has the same hash."""
    bitmaps = repeat_filter(hashes, bits_log2)
    first, second = _positions(bits_log2)
    probed = hashes.withColumns({"p1": first, "p2": second})
    for p in ("p1", "p2"):
        probed = (
            probed.withColumn("bucket", F.expr(f"{p} div 32768"))
            .join(F.broadcast(bitmaps), "bucket", "left")
            .withColumn(f"{p}_set", _is_set(p))
            .drop("bits", "bucket")
        )
    return probed.withColumn("repeated", F.col("p1_set") & F.col("p2_set")).drop("p1", "p2", "p1_set", "p2_set")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits_log2: int = MAX_BITS_LOG2
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one blank; a
    null text counts as empty. The smallest doc_id of a group stays (a null id only if
    all are null); of rows that share it, one stays. Other columns are ignored, an empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text, RUNS, " "), 256)).alias("sha"),
        ),
        "exact-hashes",
    )
    rows = max(hashes.count(), 1)
    bits_log2 = min(max_bits_log2, max(17, math.ceil(math.log2(BITS_PER_ROW * rows))))
    probed = possibly_repeated(hashes, bits_log2)

    # Rows of one hash and id are counted first, so that each join row stands for all of them.
    # The groups are written before the join, which lets adaptive execution split a hot one.
    suspects = settle(
        probed.filter("repeated").groupBy("sha", "doc_id").agg(F.count("*").alias("same")), "exact-suspects"
    )
    groups = settle(
        suspects.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("same").alias("group_size")),
        "exact-groups",
    )
    grouped = (
        suspects.join(groups, "sha")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("same"))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha",
        )
    )
    single = probed.filter(~F.col("repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    return single.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
"""
