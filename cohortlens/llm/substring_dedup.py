"""Substring dedup: word windows that an earlier document also holds are removed.

Groups of suffixes by prefix, as in a suffix tree that is built in parts, but without the
tree: windows have one fixed length, so equal windows are all that is asked for, and their
64-bit hashes are compared and shuffled in place of suffixes.

1. Of the suffixes that start inside a window only one is kept as the window's anchor,
   the start of its smallest hashed word sequence of ``PREFIX`` words. Equal windows
   have equal anchors at the same place.
2. The anchor's prefix groups the suffixes. A prefix held by a single text has no repeat
   and is dropped, which leaves the repeated part of the corpus.
3. The hashed windows of a group of memory size are sorted in one task, equal ones side by
   side. A group that is larger is divided by the whole window and only counted.
4. A window with two or more documents is a repeat; it is removed from all but the
   smallest document in which it starts. Consecutive such windows make the maximal repeats.

Identical texts are one row until the end, and so are the equal label lists of many
documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.common import discard, free_shuffles, settle, table

WINDOW = 13
PREFIX = 5
#: Label lists in one subtree.
GROUP_ROWS = 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8; wrong bytes count as they are."""
    return (text or b"").split()


def _sequence_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words."""
    n = max(len(codes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= MULTIPLIER
        out += codes[j:j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def anchored_windows(words: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: the hash of its anchor's prefix and the hash of the whole window."""
    if len(words) < window:
        none = np.zeros(0, np.uint64)
        return none, none
    digest = xxhash.xxh64_intdigest
    codes = np.fromiter(map(digest, words), np.uint64, len(words))
    labels, least = _sequence_hashes(codes, window), _sequence_hashes(codes, prefix)
    span, reach = window - prefix + 1, 1
    while 2 * reach <= span:  # minima over windows of doubling width
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    return (np.minimum(least[: len(least) - rest], least[rest:]) if rest else least), labels


def _read(docs: DataFrame, id_type: str, window: int, prefix: int) -> DataFrame:
    """Per row: words, hash of the joined words and the distinct anchors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, shas, anchors = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                words = words_of(value.as_py())
                n_words.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(np.unique(anchored_windows(words, window, prefix)[0]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(shas, pa.binary()),
                 pa.array(anchors, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_words", "sha", "anchors"],
            )

    return docs.mapInArrow(read, f"doc_id {id_type}, text_key long, n_words long, sha binary, anchors array<long>")


def _suffixes(held: DataFrame, id_type: str, window: int, prefix: int) -> DataFrame:
    """(doc_id, text_key, anchor, starts, labels): windows of live anchors, one row for each anchor and text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, starts, labels = [], [], [], []
            texts = batch.column(1).cast(pa.binary())
            for row in range(batch.num_rows):
                anchors, hashes = anchored_windows(words_of(texts[row].as_py()), window, prefix)
                live = batch.column(3)[row].values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(np.isin(anchors, live))
                at = at[np.argsort(anchors[at], kind="stable")]
                cuts = np.flatnonzero(np.diff(anchors[at])) + 1
                for part in np.split(at, cuts) if len(at) else []:
                    ids.append(row)
                    keys.append(anchors[part[0]])
                    starts.append(part.astype(np.int32))
                    labels.append(hashes[part].view(np.int64))
            rows = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows),
                 pa.array(np.array(keys, np.uint64).view(np.int64)),
                 pa.array(starts, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "anchor", "starts", "labels"],
            )

    out = f"doc_id {id_type}, text_key long, anchor long, starts array<int>, labels array<long>"
    return held.select("doc_id", "text", "text_key", "live").mapInArrow(emit, out)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats that the subtrees of a task show; the rows are sorted by anchor.

    In: anchor, labels, starts, doc_id, text_key, a row for each different label list. Out:
    doc_id, text_key and the starts whose path ends in a deep node with a smaller document.
    A group that goes on in the next batch is held back.
    """
    held: pa.Table | None = None

    def repeats(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        labels = t.column("labels").chunk(0)
        row = np.repeat(np.arange(t.num_rows), np.diff(labels.offsets.to_numpy()))
        label = labels.flatten().to_numpy(zero_copy_only=False)
        start = t.column("starts").chunk(0).flatten().to_numpy(zero_copy_only=False)
        # documents in their order, so that any type of id compares
        rank = pc.rank(t.column("doc_id"), "ascending", tiebreaker="min").to_numpy()[row]
        anchor = t.column("anchor").to_numpy()[row]
        order = np.lexsort((rank, label, anchor))
        a, b = anchor[order], label[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        node = np.cumsum(first) - 1
        later = np.sort(order[rank[order] > rank[order][first][node]])
        rows, cuts = np.unique(row[later], return_index=True)
        offsets = np.append(cuts, len(later)).astype(np.int32)
        picked = t.select(["doc_id", "text_key"]).take(pa.array(rows)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [picked.column(0).chunk(0) if len(rows) else pa.array([], t.schema.field("doc_id").type),
             picked.column(1).chunk(0) if len(rows) else pa.array([], pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(start[later], pa.int32()))],
            names=["doc_id", "text_key", "starts"],
        )

    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        anchors = now.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1])) if len(anchors) else 0
        held = now.slice(cut)
        if cut:
            yield repeats(now.slice(0, cut))
    if held is not None and held.num_rows:
        yield repeats(held)


def _cut(flagged: DataFrame, id_type: str, window: int) -> DataFrame:
    """The result rows of texts that lose words. In: doc_id, text, starts of the windows to remove."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, spans = [], [], [], []
            texts = batch.column(1).cast(pa.binary())
            for row in range(batch.num_rows):
                words = words_of(texts[row].as_py())
                starts = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                depth = np.zeros(len(words) + 1, np.int32)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + window, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                 pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "repeats"],
            )

    out = (f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept_text string, "
           "repeats array<struct<begin:int,end:int>>")
    return flagged.select("doc_id", "text", "starts").mapInArrow(cut, out)


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    prefix: int = PREFIX,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text, repeats.

    A window is ``window`` consecutive words; every word inside a window that also starts
    in a document with a smaller doc_id is removed. ``kept_text`` joins what is left by
    blanks (null where nothing was removed: the text stays as it is), ``repeats`` are the
    word ranges removed, the document's maximal repeats of earlier text. Null and empty
    texts have no words, shorter texts no windows. A row without a doc_id is kept whole and
    removes nothing. Rows that share a doc_id remove nothing from each other. Other columns
    are ignored, an empty table gives an empty result. ``docs`` is read three times, the last
    time with the result.
    """
    spark = docs.sparkSession
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")
    )
    id_type = picked.schema["doc_id"].dataType.simpleString()
    read = settle(_read(picked, id_type, window, prefix), "substring-anchors")

    # Of identical word sequences only the one with the smallest id goes on.
    firsts = settle(
        read.filter("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first_id")), "substring-firsts"
    )
    rows = settle(
        read.select("doc_id", "text_key", "n_words", "sha").join(firsts, "sha", "left").withColumn(
            "copied",
            F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window), F.lit(False)),
        ),
        "substring-rows",
    )
    held = (
        read.filter(F.size("anchors") > 0)
        .join(firsts.select(F.col("first_id").alias("doc_id"), "sha"), ["doc_id", "sha"], "left_semi")
        .select("doc_id", F.explode("anchors").alias("anchor"))
    )

    # Prefixes that more than one text holds.
    shared = settle(held.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "substring-shared")
    live = settle(held.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("live")), "substring-live")
    discard(read, firsts, shared)
    free_shuffles(spark)
    # No copy of the texts is stored: here and for the cut they come from the table.
    suffixes = settle(
        _suffixes(picked.join(live, "doc_id"), id_type, window, prefix).withColumn("list_key", F.xxhash64("labels")),
        "substring-suffixes",
    )
    discard(live)
    free_shuffles(spark)

    # Equal label lists are one row in their group: the windows of all documents but the
    # smallest are repeats, and the smallest stands for them in the subtree.
    lists = settle(
        suffixes.groupBy("anchor", "list_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")),
        "substring-lists",
    )
    sizes = settle(lists.groupBy("anchor").agg(F.count("*").alias("rows")), "substring-sizes")
    about = settle(
        lists.join(sizes, "anchor").filter("n > 1 OR rows > 1").select("anchor", "list_key", "least_id", "rows"),
        "substring-about",
    )
    discard(lists, sizes)
    placed = settle(
        suffixes.join(about, ["anchor", "list_key"]).filter("doc_id > least_id OR rows > 1")
        .withColumn("labels", F.when(F.col("doc_id") == F.col("least_id"), F.col("labels")))
        .select("doc_id", "text_key", "anchor", "starts", "labels", "rows"),
        "substring-placed",
    )
    discard(suffixes, about)
    free_shuffles(spark)
    in_lists = placed.filter("labels IS NULL").select("doc_id", "text_key", "starts")
    own = placed.filter("labels IS NOT NULL").select("anchor", "labels", "starts", "doc_id", "text_key", "rows")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_trees = (
        own.filter(F.col("rows") <= group_rows).drop("rows")
        .repartition(partitions, "anchor").sortWithinPartitions("anchor")
        .mapInArrow(_subtrees, f"doc_id {id_type}, text_key long, starts array<int>")
    )
    # A larger group is split by the whole window: each path is a deep node then.
    paths = settle(
        own.filter(F.col("rows") > group_rows)
        .select("anchor", "doc_id", "text_key", F.explode(F.arrays_zip("labels", "starts")).alias("w"))
        .select("anchor", F.col("w.labels").alias("label"), F.col("w.starts").alias("start"), "doc_id", "text_key"),
        "substring-paths",
    )
    nodes = settle(paths.groupBy("anchor", "label").agg(F.min("doc_id").alias("least_id")), "substring-nodes")
    in_paths = (
        paths.join(nodes, ["anchor", "label"]).filter("doc_id > least_id")
        .select("doc_id", "text_key", F.array("start").alias("starts"))
    )
    whole = rows.filter("NOT copied")
    starts = settle(
        in_lists.unionByName(in_trees).unionByName(in_paths).groupBy("doc_id", "text_key")
        .agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
        .join(whole, ["doc_id", "text_key"], "left_semi"),
        "substring-starts",
    )
    discard(placed, paths, nodes)
    free_shuffles(spark)
    no_span = F.array().cast("array<struct<begin:int,end:int>>")
    copies = rows.filter("copied").select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"),
        F.lit("").alias("kept_text"),
        F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("end"))).alias("repeats"),
    )
    untouched = whole.join(starts, ["doc_id", "text_key"], "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("sha")).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"), no_span.alias("repeats"),
    )
    cut = _cut(picked.join(starts, ["doc_id", "text_key"]), id_type, window)
    # A row without an id never equals another in the anti join and so stays in ``untouched``.
    return copies.unionByName(untouched).unionByName(cut)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})
), least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN least USING (s) WHERE doc_id > first
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, count(gone.p) AS n_removed,
         string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
