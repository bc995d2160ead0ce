"""Small tables and brute-force versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Row, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside; a table may have columns of the same name.
CLASHING = [
    "n_words", "row", "key", "size", "pattern", "sha", "hash", "line", "drops", "bucket", "bits", "fp", "anchor",
    "score", "text_key", "row_mark", "prediction", "features", "words", "label", "probability", "family", "seq",
    "file", "ids", "copies", "taken", "kept", "keep_id", "component_id", "n", "train", "threshold", "position",
]
LONG = " ".join(f"word{i % 977} is{i % 31}" for i in range(30_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
LINE = "This very line stands in many of the documents here."
ROWS = [
    (None, None, None, None), (None, "a row without an id " + PASSAGE, "en", "b"), (1, None, "en", "a"), (2, "", None, "a"),
    (3, "", "de", None), (4, PASSAGE, "en", "a"), (5, PASSAGE, "en", "b"), (5, PASSAGE, "en", "b"),
    (6, "Start " + PASSAGE + "\tend.", "fr", "b"), (7, LONG, "es", "c"), (8, LONG + " more", "es", "c"),
    (9, " \t\n\x0b\x0c\r ", "en", "a"), (10, f"{LINE}\nnext", "en", "a"), (11, f"  {LINE.upper()} \nother", "en", "b"),
    (12, f"{LINE}\n{LINE}", "en", "c"), (13, f"a\n{LINE}", "en", None), (14, f"{LINE}\n\n", "en", "a"),
    (14, f"x\n{LINE}", "en", "a"), (15, "<|endoftext|> it's éÉİΣ 　 'LL 12 \U0001f44d", "en", "c"),
    (16, "Released under the MIT License.\nplain words", "en", "c"), (17, "one", "en", "c"),
]
BENCHMARK = [
    (1, "Three, four five-six seven eight nine ten eleven TWELVE thirteen fourteen fifteen?"), (2, "very line stands"),
    (2, "is30"), (3, None), (4, ""), (None, "plain words"), (5, PASSAGE + " and on to something that no document has"),
]


def documents(spark: SparkSession, rows: list | None = None, clashing: bool = False) -> DataFrame:
    rows = ROWS if rows is None else rows
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    if clashing:
        for name in CLASHING:
            df = df.withColumn(name, df["source"])
    return df


def benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


def rows_of(df: DataFrame) -> list[Row]:
    return sorted(df.collect(), key=repr)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
