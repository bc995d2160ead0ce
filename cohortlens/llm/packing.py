"""Packing of token ids into windows by non-negative least squares over length combinations.

A document's ids are cut into whole windows and a rest. The rests are counted by length.
Combinations of two and three lengths that fill a window exactly are the columns of a
matrix; least squares with non-negative repeat counts fits their sum to the histogram.
Counts are rounded down, topped up while all their lengths are left, and what remains is
packed greedily: laid end to end, longest first, and cut where a window is full. The last
window is cut into powers of two, which need no padding.

Only the histogram, a number for each length, reaches the driver. Rests of a length are
numbered inside the task that writes their ids and shifted by the counts of the tasks
before, so that a row finds its place from the plan without meeting other rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import settle, table, valid_texts
from cohortlens.llm.token_ids import encoder, slices

WINDOW = 1024
#: Combinations of three lengths in the matrix; a wider window takes every n-th first length.
TRIPLES = 100_000
ROUNDS = 300
#: Rows of the table of first numbers (task and length) up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
INDEX_BITS = 40


def combinations(window: int, triples: int = TRIPLES) -> np.ndarray:
    """Rows of three lengths in ascending order that sum up to ``window``; a pair has a zero first."""
    half = np.arange(1, window // 2 + 1)
    parts = [np.stack([np.zeros_like(half), half, window - half], axis=1)]
    step = max(1, -(-window * window // (12 * triples)))
    for a in range(1, window // 3 + 1, step):
        b = np.arange(a, (window - a) // 2 + 1)
        parts.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(parts)


def repeat_counts(histogram: np.ndarray, columns: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: repeats of each combination whose lengths come near the histogram.

    Projected gradients with momentum; the matrix is never laid out, its products are gathers and counts.
    """
    target = histogram.astype(float)
    target[0] = 0
    scale = target.max(initial=0)
    if not scale:
        return np.zeros(len(columns))
    target /= scale
    flat = columns.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, weights=np.repeat(x, columns.shape[1]), minlength=len(target))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns].sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(20):
        v = back(used(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(used(v))))
    x, y, t = np.zeros(len(columns)), np.zeros(len(columns)), 1.0
    for _ in range(rounds):
        after = np.maximum(y - step * back(used(y) - target), 0)
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / further * (after - x)
        x, t = after, further
    return x * scale


@dataclass
class Plan:
    """Places of all rests: segments of equal combinations first, then the stream of what is left.

    Rest ``j`` of length ``l`` belongs to the last segment whose key, length and first number,
    is not above it, or to the stream if ``j >= used[l]``.
    """

    window: int
    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    stream_start: np.ndarray
    stream_sequence: int
    stream_bounds: np.ndarray  # of the last, cut window
    whole: int

    def stream(self, at: np.ndarray) -> np.ndarray:
        """The number of the window of a place in the stream."""
        tail = self.whole + np.searchsorted(self.stream_bounds, at, side="right") - 1
        return np.where(at < self.whole * self.window, at // self.window, tail)

    def bound(self, number: np.ndarray) -> np.ndarray:
        """The place in the stream where a window begins."""
        tail = np.clip(number - self.whole, 0, len(self.stream_bounds) - 1)
        return np.where(number <= self.whole, number * self.window, self.stream_bounds[tail])


def plan(histogram: np.ndarray, first_sequence: int, window: int = WINDOW, triples: int = TRIPLES) -> Plan:
    """Packs a histogram of rests, ``histogram[l]`` of length ``l`` below ``window``."""
    columns = combinations(window, triples)
    repeats = repeat_counts(histogram, columns)
    left = histogram.astype(np.int64).tolist()
    left[0] = 0
    taken: dict[int, int] = {}
    for top_up in (False, True):
        for i in np.argsort(-repeats, kind="stable").tolist():
            lengths = [x for x in columns[i].tolist() if x]
            most = min(left[x] // lengths.count(x) for x in lengths)
            n = most if top_up else min(most, int(repeats[i]))
            if n:
                taken[i] = taken.get(i, 0) + n
                for x in lengths:
                    left[x] -= n
    used = np.zeros(window, np.int64)
    segments, sequence = [], first_sequence
    for i, n in taken.items():
        offset = 0
        for x in columns[i].tolist():
            if x:
                segments.append((x << INDEX_BITS | int(used[x]), sequence, offset))
                used[x] += n
                offset += x
        sequence += n
    segments = np.array(sorted(segments), np.int64).reshape(-1, 3)
    stream = (histogram - used) * np.arange(window)
    start = stream[::-1].cumsum()[::-1] - stream
    total = int(stream.sum())
    whole, rest = divmod(total, window)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return Plan(
        window, segments[:, 0], segments[:, 1], segments[:, 2], used, start, sequence,
        whole * window + np.cumsum([0, *powers]), whole,
    )


def place(
    chosen: Plan, n: np.ndarray, nth: np.ndarray, window_sequence: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, sequence, offset) of every piece of rows with ``n`` ids, in the order of the ids.

    ``nth`` numbers the rests of a length, ``window_sequence`` is the sequence of a row's first whole window.
    """
    window = chosen.window
    windows, rest = np.divmod(n, window)
    at = chosen.stream_start[rest] + (nth - chosen.used[rest]) * rest
    loose = (rest > 0) & (nth >= chosen.used[rest])
    first = np.where(loose, chosen.stream(at), 0)
    last = np.where(loose, chosen.stream(at + rest - 1), 0)
    segment = np.searchsorted(chosen.keys, rest << INDEX_BITS | nth, side="right") - 1
    found = np.flatnonzero((rest > 0) & ~loose)
    fixed_sequence, fixed_offset = np.zeros_like(n), np.zeros_like(n)
    numbers = chosen.keys[segment[found]] & ((1 << INDEX_BITS) - 1)
    fixed_sequence[found] = chosen.sequence[segment[found]] + nth[found] - numbers
    fixed_offset[found] = chosen.offset[segment[found]]

    pieces = windows + np.where(rest > 0, last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    whole = k < windows[row]
    number = first[row] + k - windows[row]
    low = np.maximum(at[row], chosen.bound(np.where(loose[row] & ~whole, number, 0)))
    high = np.minimum((at + rest)[row], chosen.bound(np.where(loose[row] & ~whole, number + 1, 0)))
    stream = loose[row] & ~whole
    start = np.where(whole, k * window, windows[row] * window + np.where(stream, low - at[row], 0))
    length = np.where(whole, window, np.where(stream, high - low, rest[row]))
    sequence = np.where(whole, window_sequence[row] + k, np.where(stream, chosen.stream_sequence + number, fixed_sequence[row]))
    offset = np.where(whole, 0, np.where(stream, low - chosen.bound(np.where(stream, number, 0)), fixed_offset[row]))
    return row, start, length, sequence, offset


def _token_rows(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int, window: int) -> DataFrame:
    """(doc_id, n, part, rest, nth, window_nth, ids): the ids of every row and its numbers within its task."""
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, whole = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for batch in batches:
            texts = valid_texts(batch.column(1))
            for rows in slices(texts):
                ids, sizes = encoder(vocabulary).encode(texts[rows.start:rows.stop])
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(np.int32)
                n = sizes + 1
                windows, rest = np.divmod(n, window)
                order = np.argsort(rest, kind="stable")
                counts = np.bincount(rest, minlength=window)
                nth = np.empty_like(n)
                nth[order] = np.arange(len(n)) - (np.cumsum(counts) - counts)[rest[order]]
                nth += seen[rest]
                seen += counts
                window_nth = whole + np.cumsum(windows) - windows
                whole += int(windows.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start:rows.stop], pa.array(n), pa.array(np.full(len(n), part, np.int32)),
                     pa.array(rest, pa.int32()), pa.array(nth), pa.array(window_nth), lists],
                    names=["doc_id", "n", "part", "rest", "nth", "window_nth", "ids"],
                )

    id_type = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(
        encode, f"doc_id {id_type}, n long, part int, rest int, nth long, window_nth long, ids array<int>"
    )


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids end with ``end_id``; every id lies in exactly one piece, pieces of a sequence lie
    one behind the other from offset 0, and no sequence exceeds ``window``. A null text counts as
    empty and gives a piece of one id. Rows that share a doc_id, or have none, are packed each by
    itself. Which rests meet in a sequence follows the order in which Spark reads the rows. A text
    that is not valid UTF-8 is read with a replacement character for each wrong part. Other
    columns are ignored, an empty table gives an empty result.
    """
    tokens = settle(
        _token_rows(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), id_col, text_col, end_id, window), "packing-ids"
    )
    counts = settle(
        tokens.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {window}")).alias("windows")), "packing-counts"
    )
    histogram, n_windows = np.zeros(window, np.int64), 0
    for r in counts.groupBy("rest").agg(F.sum("rows").alias("rows"), F.sum("windows").alias("windows")).collect():  # a row for each length
        histogram[r["rest"]] = r["rows"]
        n_windows += r["windows"]
    histogram[0] = 0
    chosen = plan(histogram, n_windows, window)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = counts.groupBy("part").agg(F.sum("windows").alias("w")).select(
        "part", F.coalesce(F.sum("w").over(before), F.lit(0)).cast("long").alias("first_window")
    )
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = settle(
        counts.withColumn("first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long"))
        .join(parts, "part").select("part", "rest", "first", "first_window"),
        "packing-firsts",
    )
    small = firsts.count() <= broadcast_rows
    rows = tokens.join(F.broadcast(firsts) if small else firsts, ["part", "rest"]).select(
        "doc_id", "n", (F.col("nth") + F.col("first")).alias("nth"), (F.col("window_nth") + F.col("first_window")).alias("window_sequence"), "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nth, sequence = (batch.column(i).to_numpy() for i in (1, 2, 3))
            lists = batch.column(4)
            bounds = lists.offsets.to_numpy()
            row, start, length, number, offset = place(chosen, n, nth, sequence)
            values = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
            ends = np.concatenate([[0], np.cumsum(length)])
            raw = values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                 pa.array(crcs, pa.int64()), pa.array(n[row]), pa.array(number), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        cut, f"doc_id {id_type}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of packed pieces, padded to ``window`` unless the length is a power of two.

    The pieces of a sequence are gathered, ``window`` ids at most.
    """
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(held, lambda p: p["ids"])).alias("ids"))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padding = F.array_repeat(F.lit(pad_id), F.when(power, 0).otherwise(window - F.col("n_tokens")).cast("int"))
    return joined.select("sequence_id", "n_tokens", F.concat("ids", padding).alias("ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
