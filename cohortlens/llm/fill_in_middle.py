"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one byte array. A scan marks the bytes that begin a unit and finds
the two cuts of each text. Moving a part of a text to its place in the output shifts all
its bytes by the same number, so an array of differences that is zero but where a part
begins gives, by a running sum, every byte's shift; one numpy scatter writes the output.
Restoring finds the three marks in an output, builds the same kind of differences in the
other direction and gathers the bytes back.

Running sums go over windows of bytes and carry the last shift on, so that a very long
text needs its own size and no multiple of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import table
from cohortlens.llm.token_ids import slices

# The marks, the seed, and the shares in percent of plain texts and of the two orders.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
TRANSFORMED = 90
SUFFIX_FIRST = 20
WINDOW = 1 << 20
BLOCK = 1 << 12
MARK = len(PREFIX)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes that do not begin a code point.
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the seed and the id; a null id draws from the seed alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    hashed = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[bounds[0]:bounds[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class Marked:
    """Marked bytes, counted in blocks, so that neither counting nor finding lists them all."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        whole = len(marks) // BLOCK * BLOCK
        counts = [np.count_nonzero(marks[whole:])] if whole < len(marks) else []
        inner = np.count_nonzero(marks[:whole].reshape(-1, BLOCK), axis=1)
        self.upto = np.concatenate([[0], np.cumsum(np.concatenate([inner, counts]))]).astype(np.int64)

    def before(self, at: int) -> int:
        """Marks before a byte."""
        block = at // BLOCK
        return int(self.upto[block]) + int(np.count_nonzero(self.marks[block * BLOCK:at]))

    def place(self, number: int) -> int:
        """The byte of a mark by its number."""
        block = int(np.searchsorted(self.upto, number, side="right")) - 1
        inside = np.flatnonzero(self.marks[block * BLOCK:(block + 1) * BLOCK])
        return block * BLOCK + int(inside[number - int(self.upto[block])])


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which bytes begin a run of letters or another single code point."""
    letter = _LETTER[data]
    starts = ~_INNER[data]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    begin = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[begin] = True
    return starts


def shifts(size: int, at: np.ndarray, shift: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Windows (first byte, places + shifts) where the bytes from ``at[i]`` on have ``shift[i]``."""
    step = np.diff(shift, prepend=0)
    for first in range(0, size, WINDOW):
        last = min(first + WINDOW, size)
        a, b = np.searchsorted(at, [first, last])
        difference = np.zeros(last - first, np.int64)
        np.add.at(difference, at[a:b] - first, step[a:b])
        difference[0] += step[:a].sum()
        yield first, np.arange(first, last) + np.cumsum(difference)


def cuts(data: np.ndarray, bounds: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the bytes where its prefix and its middle end."""
    units = Marked(unit_starts(data, bounds))
    upto = np.fromiter((units.before(b) for b in bounds.tolist()), np.int64, len(bounds))
    n = np.diff(upto)
    found = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        at = bounds[1:].copy()
        for i in np.flatnonzero(k < n).tolist():
            at[i] = units.place(int(upto[i] + k[i]))
        found.append(at)
    return n, *found


def transform(data: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, plain: np.ndarray, suffix_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all texts and their bounds; ``a`` and ``b`` are the ends of prefix and middle."""
    begin, end = bounds[:-1], bounds[1:]
    out_bounds = np.concatenate([[0], np.cumsum(end - begin + np.where(plain, 0, 3 * MARK))])
    to = out_bounds[:-1]
    p, m, s = a - begin, b - a, end - b
    prefix_to = to + MARK + np.where(suffix_first, s + MARK, 0)
    suffix_to = to + MARK + np.where(suffix_first, 0, p + MARK)
    middle_to = to + 3 * MARK + p + s
    at = np.stack([begin, a, b], axis=1).ravel()
    shift = np.stack([
        np.where(plain, to, prefix_to) - begin,
        np.where(plain, to + p, middle_to) - a,
        np.where(plain, to + p + m, suffix_to) - b,
    ], axis=1).ravel()
    out = np.empty(int(out_bounds[-1]), np.uint8)
    for first, goal in shifts(len(data), at, shift):
        out[goal] = data[first:first + len(goal)]
    moved = np.flatnonzero(~plain)
    for mark, place in ((PREFIX, prefix_to), (SUFFIX, suffix_to), (MIDDLE, middle_to)):
        out[(place[moved] - MARK)[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)
    return out, out_bounds


def marks_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each mark that lies within one text, and that text's number."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    middle = np.isin(data[1:-1], [PREFIX[1], SUFFIX[1], MIDDLE[1]])
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) & middle)
    owner = np.searchsorted(bounds, at, side="right") - 1
    inside = at + MARK <= bounds[owner + 1]
    return at[inside], owner[inside]


def restore(out: np.ndarray, bounds: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that gave these outputs, from the outputs and their forms alone."""
    moved = np.flatnonzero(forms != "plain")
    begin, end = bounds[:-1], bounds[1:]
    text_bounds = np.concatenate([[0], np.cumsum(end - begin - np.where(forms != "plain", 3 * MARK, 0))])
    # A text that is not plain holds no mark of its own and marks cannot overlap: three to an output.
    marks, owner = marks_in(out, bounds)
    marks = marks[forms[owner] != "plain"].reshape(-1, 3)
    kind = out[marks + 1]
    where = {c: marks[kind == c[0]] for c in (PREFIX[1:2], SUFFIX[1:2], MIDDLE[1:2])}
    prefix, suffix, middle = (where[c] + MARK for c in (PREFIX[1:2], SUFFIX[1:2], MIDDLE[1:2]))
    first = forms[moved] == "spm"
    stop = middle - MARK
    p = np.where(first, stop, suffix - MARK) - prefix
    m = end[moved] - middle
    to = text_bounds[:-1]
    at, shift = [to], [begin - to]
    at += [to[moved], to[moved] + p, to[moved] + p + m]
    shift += [prefix - to[moved], middle - to[moved] - p, suffix - to[moved] - p - m]
    keep = np.ones(len(to), bool)
    keep[moved] = False
    at[0], shift[0] = at[0][keep], shift[0][keep]
    at, shift = np.concatenate(at), np.concatenate(shift)
    part = np.concatenate([np.zeros(int(keep.sum()), np.int64), np.repeat([0, 1, 2], len(moved))])
    text = np.concatenate([np.flatnonzero(keep), np.tile(moved, 3)])
    order = np.lexsort((part, text))
    texts = np.empty(int(text_bounds[-1]), np.uint8)
    for first_byte, source in shifts(len(texts), at[order], shift[order]):
        texts[first_byte:first_byte + len(source)] = out[source]
    return texts, text_bounds


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
    )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut between its ``n`` units, runs of ASCII letters or other single code points;
    the id alone draws the cuts and the form, so reruns agree and rows that share an id are cut
    by the same draw. A null text counts as empty. Empty texts, texts that hold a mark and a
    drawn tenth stay as they are: ``plain``, with null character counts. A text that is not
    valid UTF-8 is cut by its bytes, of which 80 to BF belong to the unit before, and keeps
    them. Other columns are ignored, an empty table gives an empty result.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *draws(id_col, seed))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.string())
            h = [batch.column(2 + i).to_numpy() for i in range(4)]
            for rows in slices(column):
                data, bounds = text_buffer(column[rows.start:rows.stop])
                h1, h2, h3, h4 = (x[rows] for x in h)
                n, a, b = cuts(data, bounds, h1, h2)
                plain = (n == 0) | (h3 % 100 >= TRANSFORMED)
                plain[marks_in(data, bounds)[1]] = True
                suffix_first = h4 % 100 < SUFFIX_FIRST
                out, out_bounds = transform(data, bounds, a, b, plain, suffix_first)
                chars = Marked(~_INNER[data])
                points = [np.fromiter(map(chars.before, x.tolist()), np.int64, len(x)) for x in (bounds[:-1], a, b)]
                forms = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[rows.start:rows.stop], pa.array(n), pa.array(forms.tolist(), pa.string()),
                    pa.array(points[1] - points[0], pa.int64(), mask=plain), pa.array(points[2] - points[1], pa.int64(), mask=plain),
                    strings(out, out_bounds),
                ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(
        move, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(moved: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """``moved`` with the text rebuilt from an output and its form in a further column ``to``.

    All columns stay. A null output gives an empty text; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in moved.columns])
    picked = moved.select(row.alias("row"), F.coalesce(F.col(f"`{output_col}`"), F.lit("")).alias("out"), F.col(f"`{form_col}`").alias("form"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.string())
            for rows in slices(column):
                forms = np.array(batch.column(2)[rows.start:rows.stop].to_pylist(), dtype="U8")
                texts = strings(*restore(*text_buffer(column[rows.start:rows.stop]), forms))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows.start:rows.stop], texts], names=["row", to])

    schema = T.StructType([picked.schema["row"], T.StructField(to, T.StringType())])
    return picked.mapInArrow(back, schema).select("row.*", f"`{to}`")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_in_middle(table(spark, sf_dir, "documents"))
    return restored(moved).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


_DRAW = "('0x' || substr(h, {}, 8))::BIGINT"
OP12_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || doc_id::VARCHAR) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), cut AS (
  SELECT *, len(u) AS n, {_DRAW.format(1)} % (len(u) + 1) AS k1, {_DRAW.format(9)} % (len(u) + 1) AS k2,
    CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR {_DRAW.format(17)} % 100 >= {TRANSFORMED}
      THEN 'plain' WHEN {_DRAW.format(25)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
    array_to_string(u[greatest(k1, k2) + 1:], '') AS s
  FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
