"""Line dedup with DataFrame functions only: lines that many documents share are dropped.

Lines are exploded, normalised and hashed; the documents of a hash are counted; a
line over the threshold goes from every document but one. Only hashes and ids are
grouped and joined. The documents meet their dropped hashes once and are reassembled
in the order of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import SPACE, UPPER, ascii_lower, settle, table

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text.

    A key is a line stripped of white space with A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their lines
    except in the largest doc_id that holds them. A null or empty text is one empty line.
    Rows that share a doc_id, or have none, count as one document, and each is
    reassembled by itself; a null id is the smallest. Other columns are ignored, an
    empty table gives an empty result.
    """
    parts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = settle(
        parts.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .filter(F.char_length(F.btrim("line", F.lit(SPACE))) >= min_chars)
        .select(_hash(F.col("line")).alias("hash"), "doc_id").distinct(),
        "line-hashes",
    )
    # Both sides are read from files, so that adaptive execution can split a line that very many documents share.
    common = settle(
        held.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs),
        "line-common",
    )
    dropped = (
        held.join(common, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_set("hash").alias("drops"))
    )

    def stays(line: Column) -> Column:
        # A null list of drops never gets here.
        return (F.char_length(line) < min_chars) | ~F.array_contains("drops", _hash(line))

    lines = F.split("text", "\n", -1)
    joined = parts.join(dropped, F.col("doc_id").eqNullSafe(F.col("drop_id")), "left").select(
        "doc_id", "text", "drops", F.when(F.col("drops").isNotNull(), F.filter(lines, stays)).alias("left_lines")
    )
    n_lines = F.size(lines).cast("long")
    return joined.select(
        "doc_id",
        n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.size("left_lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join("left_lines", "\n")).alias("kept_text"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      '{UPPER}', '{UPPER.lower()}') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
