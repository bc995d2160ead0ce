"""SimHash near-dedup: block pairs find candidates, pivot distances discard, Hamming distances verify.

Documents become 64-bit fingerprints over word shingles; equal fingerprints are one
row from there on.

* Candidates meet by equality of two of four 16-bit blocks: with two differing bits at
  most, two blocks are equal. No distance is computed for this.
* Every fingerprint has a table of its Hamming distances to 16 seeded reference
  fingerprints. A pair that met is discarded if any of these distances differs by more
  than two (triangle inequality).

Survivors are verified by their Hamming distance. A block pair with very many
fingerprints is not paired at all: there, fingerprints meet at every pattern within
one bit of them, where all that meet are links, and at most 33 can meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import settle, table
from cohortlens.llm.components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints in a block pair from which they meet at patterns instead of in pairs.
DENSE = 256
PIVOTS = [int.from_bytes(hashlib.sha256(f"pivot {i}".encode()).digest()[:8], "big", signed=True) for i in range(16)]
BLOCK_PAIRS = list(combinations(range(4), 2))
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8; 0 without words. Wrong bytes count as they are."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    size = min(shingle, len(words))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(first[at:at + CHUNK], last[at:at + CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(first)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every row; null and empty texts have 0."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1).cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])

    return picked.mapInArrow(mark, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def _block(fp: str, i: int) -> str:
    return f"(shiftrightunsigned({fp}, {16 * i}) & 65535L)"


def _tables(fp: str) -> list[Column]:
    """Distances to the 16 references, eight to a long, a byte each."""
    parts = []
    for at in (0, 8):
        distances = [f"shiftleft(cast(bit_count({fp} ^ {p}L) as bigint), {8 * i})" for i, p in enumerate(PIVOTS[at:at + 8])]
        parts.append(F.expr(" | ".join(distances)).alias(f"d{at // 8}"))
    return parts


def links(marks: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints ``marks.fp`` at two bits or fewer.

    Lists every link outside dense block pairs, and inside those enough links to join
    all that are connected.
    """
    keys = F.array(*[F.expr(f"{k}L * 4294967296L + {_block('fp', i)} * 65536L + {_block('fp', j)}")
                     for k, (i, j) in enumerate(BLOCK_PAIRS)])
    met = settle(marks.select("fp", F.explode(keys).alias("key")), "simhash-keys")
    shared = settle(met.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-shared")
    met = settle(met.join(shared, "key").select("key", "n", "fp", *_tables("fp")), "simhash-met")

    sparse = met.filter(F.col("n") <= dense).drop("n")
    x, y = sparse.alias("x"), sparse.alias("y")
    near = [f"abs((shiftright(x.d{t}, {8 * i}) & 255L) - (shiftright(y.d{t}, {8 * i}) & 255L)) <= {MAX_BITS}"
            for t in (0, 1) for i in range(8)]
    test = " AND ".join(["x.key = y.key", "x.fp < y.fp", *near, f"bit_count(x.fp ^ y.fp) <= {MAX_BITS}"])
    pairs = x.join(y, F.expr(test)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    # The free bits of a block pair are those of the other two blocks.
    kind = F.expr("cast(key div 4294967296L as int)")
    free = F.array(*[
        F.array(*[F.lit(16 * b + i) for b in range(4) if b not in pair for i in range(16)]) for pair in BLOCK_PAIRS
    ])
    flips = F.transform(F.element_at(free, kind + 1), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met_at = met.filter(F.col("n") > dense).select(
        "key", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("pattern")
    )
    stars = (
        met_at.groupBy("key", "pattern").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    )
    return pairs.unionByName(stars).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, dense: int = DENSE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id.

    ``component_id`` is the smallest doc_id reachable by links of two differing bits or
    fewer, itself included. Texts without words share the fingerprint zero and link like
    any other; bytes that are not UTF-8 count as they are. A row without a doc_id takes part and never names a component that has ids.
    Rows that share a doc_id are rows of their own. Other columns are ignored, an empty
    table gives an empty result.
    """
    marks = settle(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = settle(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    found = settle(links(distinct.select("fp"), dense), "simhash-links")
    roots = components(found, "a", "b").withColumnRenamed("node", "fp")
    placed = settle(
        distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id"),
        "simhash-roots",
    )
    named = settle(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-components")
    by_mark = settle(placed.join(named, "root").select("fp", "component_id"), "simhash-named")
    return marks.join(by_mark, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, that of the smallest doc_id, with all its columns.

    Of rows with that doc_id, the one of the smallest text hash stays; a row without a doc_id only
    where no row of its component has one. Null and empty texts are one component. Columns may have
    any names; an empty table gives an empty result.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"),
    )
    groups = simhash_groups(rows.select(F.struct(F.col("id").isNull(), "id", "mark").alias("doc_id"), "text"), **options)
    keep = groups.select(F.col("component_id").alias("keep")).distinct().select("keep.*").toDF("no_id", "keep_id", "keep_mark").drop("no_id")
    joined = rows.drop("text").join(keep, F.expr("id <=> keep_id AND mark = keep_mark"), "left_semi")
    return joined.dropDuplicates(["id", "mark"]).select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
