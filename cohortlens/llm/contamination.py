"""Benchmark decontamination with one Aho-Corasick automaton over word windows.

Every distinct benchmark word becomes one code point, every window a short string, and
the automaton of all windows scans a document's words once. Hits are mapped back to
character offsets of the original text. A benchmark larger than one block gives
several automata that scan one after the other in the same task; one that is too large to be
sent to the executors is read in parts, each of which adds its hits to the rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import settle, table, valid_texts

WINDOW = 13
#: A document is contaminated from one hit word in so many.
LEAST_SHARE = 20
#: A benchmark block holds at most this many characters of item text (one larger item is a
#: block by itself); it bounds the memory of an automaton.
BLOCK_CHARS = 4_000_000
#: Characters of the benchmark that go to the driver and the executors at a time; a larger one is scanned in parts.
MAX_BENCHMARK_CHARS = 64_000_000

#: Byte table: A-Z to lower case, all ASCII that is no word character to a blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OUT = "doc_id {id}, n_words long, n_hit long, item_ids array<string>, spans array<struct<begin:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Matcher:
    """The automaton of the windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.letters: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item_id, text in items:
            ids = "".join(self._letter(w) for w in words_of(text))
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(ids[i:i + size], set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), frozenset(ids)))
        if owners:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        """A code point of its own for each word, from 1 on and without the surrogates."""
        n = len(self.letters) + 1
        return self.letters.setdefault(word, chr(n if n < 0xD800 else n + 0x800))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of the hits, in order of their ends, and the items hit."""
        if not len(self.automaton):
            return [], set()
        get = self.letters.get
        found, items = [], set()
        for end, (size, ids) in self.automaton.iter("".join([get(w, "\0") for w in words])):
            found.append((end - size + 1, end + 1))
            items |= ids
        return found, items


_MATCHERS: dict[str, list[Matcher]] = {}


def _matchers(blocks: Broadcast, window: int, key: str) -> list[Matcher]:
    """The automata of a benchmark, built once per Python worker; only the last benchmark is kept."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = [Matcher(block, window) for block in blocks.value]
    return _MATCHERS[key]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_parts(benchmark: DataFrame, item_col: str, text_col: str, max_chars: int) -> list[DataFrame]:
    """The items (item, text), all together up to ``max_chars`` characters, else in parts of about half as many.

    Equal items are the same; only an item that is larger than ``max_chars`` makes a part that is.
    """
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    size = items.agg(F.sum(F.char_length("text") + 64)).first()[0] or 0
    if size <= max_chars:
        return [items]
    stored = settle(items.distinct().withColumn("hash", F.xxhash64("item", "text")), "benchmark-items")
    n = -(-2 * size // max_chars)
    return [stored.filter(F.pmod("hash", F.lit(n)) == i).select("item", "text") for i in range(n)]


def benchmark_blocks(part: DataFrame, block_chars: int) -> list[list[tuple[str, str]]]:
    """The items of a part on the driver."""
    blocks: list[list[tuple[str, str]]] = [[]]
    filled = 0
    for item, text in sorted((r.item, r.text) for r in part.collect()):
        if filled and filled + len(text) > block_chars:
            blocks.append([])
            filled = 0
        blocks[-1].append((item, text))
        filled += len(text)
    return blocks


class Scanner:
    """Scans texts in tasks with the automata of a part of the benchmark that was sent to the executors."""

    def __init__(self, part: DataFrame, window: int, block_chars: int) -> None:
        blocks = benchmark_blocks(part, block_chars)
        self.key = hashlib.sha256(repr((window, blocks)).encode("utf-8", "surrogatepass")).hexdigest()
        self.window = window
        self.blocks = part.sparkSession.sparkContext.broadcast(blocks)

    def scan(
        self, text: str, ranges: Iterable[tuple[int, int]] = (), items: Iterable[str] = ()
    ) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged word ranges of the hits, items hit; with those found before."""
        words = words_of(text)
        ranges, items = list(ranges), set(items)
        for m in _matchers(self.blocks, self.window, self.key):
            found, ids = m.scan(words)
            ranges += found
            items |= ids
        return len(words), merge(ranges), items


def _before(batch: pa.RecordBatch) -> Iterable[tuple[list[tuple[int, int]], list[str]]]:
    """The hits that the parts before have found in the rows of a batch."""
    if batch.num_columns == 1:
        return repeat(([], []))
    ranges = ([(r["begin"], r["end"]) for r in found] for found in batch.column(1).to_pylist())
    return zip(ranges, batch.column(2).to_pylist())


RANGES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def scan_parts(
    rows: DataFrame, at: int, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS, max_chars: int = MAX_BENCHMARK_CHARS,
) -> tuple[DataFrame, Scanner]:
    """``rows`` with the hits of all parts of the benchmark but the last, and the scanner of that one.

    ``rows`` has a column ``row``, a struct whose field ``at`` is the text. Between two parts the rows are
    written with the word ranges and items found so far; a benchmark of one part adds nothing to them.
    """
    *earlier, last = benchmark_parts(benchmark, item_col, item_text_col, max_chars)
    for i, part in enumerate(earlier):
        scanner = Scanner(part, window, block_chars)

        def add(batches: Iterator[pa.RecordBatch], scanner: Scanner = scanner) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ranges, items = [], []
                for value, before in zip(valid_texts(batch.column(0).field(at)), _before(batch)):
                    _, found, ids = scanner.scan(value.as_py() or "", *before)
                    ranges.append([{"begin": a, "end": b} for a, b in found])
                    items.append(sorted(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ranges, RANGES), pa.array(items, pa.list_(pa.string()))], names=["row", "ranges", "items"]
                )

        rows = settle(rows.mapInArrow(add, _with_hits(rows)), f"contamination-{i}")
        scanner.blocks.unpersist()
    return rows, Scanner(last, window, block_chars)


def _with_hits(rows: DataFrame) -> T.StructType:
    """The schema of rows with their word ranges and items."""
    pair = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return T.StructType([
        rows.schema["row"], T.StructField("ranges", T.ArrayType(pair)), T.StructField("items", T.ArrayType(T.StringType()))
    ])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    max_chars: int = MAX_BENCHMARK_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids, spans.

    ``n_hit`` counts the words inside any occurrence of a window, ``item_ids`` lists the
    items of those windows (as strings, sorted, once each; a null id is the empty string)
    and ``spans`` their character ranges in the original text. Null and empty texts have no
    words, an item without words no window; what is not UTF-8 in a text reads as a replacement
    character. Other columns are ignored, an empty table of
    documents gives an empty result, an empty benchmark no hits.
    """
    picked = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).alias("row"))
    rows, scanner = scan_parts(picked, 1, benchmark, item_col, item_text_col, window, block_chars, max_chars)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, item_ids, spans = [], [], [], []
            for value, before in zip(valid_texts(batch.column(0).field(1)), _before(batch)):
                text = value.as_py() or ""
                words, ranges, items = scanner.scan(text, *before)
                at = [x.span() for x in WORD.finditer(text)] if ranges else []
                n_words.append(words)
                n_hit.append(sum(b - a for a, b in ranges))
                item_ids.append(sorted(items))
                spans.append([{"begin": at[a][0], "end": at[b - 1][1]} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).field(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(item_ids, pa.list_(pa.string())), pa.array(spans, RANGES),
                ],
                names=["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return rows.mapInArrow(scan, OUT.format(id=docs.schema[id_col].dataType.simpleString()))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Null and empty texts have no words and stay; rows that share an id are judged each by itself.
    Columns may have any names; an empty table gives an empty result, an empty benchmark all rows.
    """
    at = docs.columns.index(text_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows, scanner = scan_parts(whole, at, benchmark, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for value, before in zip(valid_texts(batch.column(0).field(at)), _before(batch)):
                words, ranges, _ = scanner.scan(value.as_py() or "", *before)
                hit = sum(b - a for a, b in ranges)
                clean.append(hit == 0 or LEAST_SHARE * hit < words)
            yield batch.select(["row"]).filter(pa.array(clean, pa.bool_()))

    return rows.mapInArrow(keep, whole.schema).select("row.*")


def is_contaminated() -> Column:
    """The contract's rule: a twentieth of a document's words or more."""
    return (F.col("n_hit") > 0) & (LEAST_SHARE * F.col("n_hit") >= F.col("n_words"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item, w, least({WINDOW}, len(w)) AS size, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i
  FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM bw
), sizes AS (SELECT DISTINCT size FROM windows),
dw AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size
), hits AS (
  SELECT doc_id, i, dw.size AS size, item FROM dw JOIN windows
  ON windows.size = dw.size AND s = array_to_string(w[i:i + dw.size - 1], ' ')
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
