"""Token ids of documents in parquet list columns, written in document order and read back.

Ids are dictionary or delta encoded. Row groups and pages are small enough that the
footers and page indexes lead a reader to the documents it wants, and metadata reads
skip the id column.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import new_path, table, valid_texts

#: Pieces remembered per Python worker before the memory is emptied.
REMEMBERED = 300_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 1_000_000
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

#: Classes of a byte, as bits: visible, blank, line end, ASCII letter, mark before which a word is cut (not the
#: apostrophe, nor the bar inside special strings), the lead byte C3, and a byte that makes a letter after C3
#: (all but the signs for times and divided by). Text is not cut around white space beyond ASCII, whose lead bytes
#: are the last class.
VISIBLE, BLANK, LINE, LETTER, MARK, LATIN, WIDE, LEAD = (1 << i for i in range(8))
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x21, 0x7F), *range(0x80, 0x100)]] |= VISIBLE
_CLASS[0x20] |= BLANK
_CLASS[0x0A] |= LINE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= LETTER
_CLASS[[ord(c) for c in ".,;:!?)(%$*&"]] |= MARK
_CLASS[0xC3] |= LATIN
_CLASS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] |= WIDE
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] |= LEAD
#: Pieces that begin with a visible character, or with a blank and one, and end with one.
_JOINABLE = re.compile(rb" ?[!-~\x80-\xff](?:[^\n]*[!-~\x80-\xff])?", re.DOTALL).fullmatch
#: Pieces that are one match of the pre-tokenizer's pattern for letters.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
TOGETHER = 2000
_WIDE_SPACES = {
    chr(c).encode() for c in [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
}


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _has_wide_space(raw: bytes, leads: np.ndarray) -> bool:
    """Is one of the bytes at ``leads`` the first of a white space character beyond ASCII?"""
    return any(raw[i:i + 2] in _WIDE_SPACES or raw[i:i + 3] in _WIDE_SPACES for i in leads.tolist())


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A byte-level text may be cut before a single blank and around a single line end between
    visible characters, and between a letter and a mark: the pre-tokenizer's pattern
    always ends a match there, so the ids of the pieces joined are the ids of the text.
    For the same reason new pieces are encoded together, a line end between them; a piece of
    letters alone is one match, which goes straight to the library's model. Texts with white
    space beyond ASCII are encoded whole.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # a character of a byte-level token is a byte
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, number in vocabulary.items():
            self.width[number] = len(name)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (
            np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)]),
            np.fromiter(map(len, ids), np.int64, len(ids)),
        )

    def _gather(self, number: np.ndarray) -> np.ndarray:
        """The ids of known pieces, one after another."""
        size = self.size[number]
        ends = np.cumsum(size)
        return self.flat[np.arange(size.sum()) + np.repeat(self.first[number] - (ends - size), size)]

    def _learn(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None) -> None:
        """Remember the ids of new pieces, which lie one after another or at ``starts``."""
        at, end = len(self.known), len(self.known) + len(pieces)
        while end > len(self.first):
            self.first, self.size = np.concatenate([self.first] * 2), np.concatenate([self.size] * 2)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat] * 2)
        starts = np.cumsum(sizes) - sizes if starts is None else starts
        self.first[at:end], self.size[at:end] = self.used + starts, sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(pieces, range(at, end)))

    def _numbers(self, pieces: list[bytes], wide: bool) -> np.ndarray:
        """The number of each piece, encoding those not yet known. ``wide``: may pieces hold white space beyond ASCII?"""
        if len(self.known) > REMEMBERED or self.used > 8 * REMEMBERED:
            kept = [p for p in pieces if p in self.known]
            number = np.fromiter(map(self.known.__getitem__, kept), np.int64, len(kept))
            sizes, ids = self.size[number], self._gather(number)
            self._forget()
            self._learn(kept, ids, sizes)
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(numbers < 0).tolist()
        if not missing:
            return numbers
        new = [pieces[i] for i in missing]
        is_word = list(map(bool, map(_WORD, new)))
        words = list(compress(new, is_word))
        if words:
            letters, tokenize = self.letters, self.model.tokenize
            numbers[list(compress(missing, is_word))] = np.arange(len(self.known), len(self.known) + len(words))
            ids = [[t.id for t in tokenize(p.decode("latin-1").translate(letters))] for p in words]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._learn(words, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes)
        left = [i for i, ok in zip(missing, is_word) if not ok]
        new = rest = [pieces[i] for i in left]
        plain = [_JOINABLE(p) is not None and not (wide and _has_wide_space(p, np.arange(len(p)))) for p in new]
        odd = [p for p, ok in zip(new, plain) if not ok]
        if odd:
            self._learn(odd, *self._encode([p.decode() for p in odd]))
        new = [p for p, ok in zip(new, plain) if ok]
        for at in range(0, len(new), TOGETHER):
            part = new[at:at + TOGETHER]
            ids, _ = self._encode([b"\n".join(part).decode()])
            widths = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(widths + 1) - 1
            upto = np.cumsum(self.width[ids])
            first = np.searchsorted(upto, ends - widths, side="right")
            self._learn(part, ids, np.searchsorted(upto, ends, side="left") + 1 - first, first)
        numbers[left] = [self.known[p] for p in rest]
        return numbers

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        kind = _CLASS[data]
        cut = np.zeros(len(data) + 2, np.uint8)
        alone = (kind[:-2] & kind[2:] & VISIBLE) != 0
        line = alone & ((kind[1:-1] & LINE) != 0)
        cut[1:len(data) - 1] = alone & ((kind[1:-1] & (BLANK | LINE)) != 0)
        cut[2:len(data)] |= line
        mark = np.flatnonzero(kind[1:] & MARK)
        letter = (kind[mark] & LETTER) != 0
        letter |= (mark > 0) & ((kind[mark] & WIDE) != 0) & ((kind[mark - 1] & LATIN) != 0)
        cut[mark[letter] + 1] = 1
        leads = np.flatnonzero(kind & LEAD)
        raw = data.tobytes()
        if wide := _has_wide_space(raw, leads):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if _has_wide_space(raw, leads[np.searchsorted(leads, a):np.searchsorted(leads, b)]):
                    cut[a:b] = 0
        cut[bounds[:-1]] = 1
        cuts = np.flatnonzero(cut[:len(data)].view(bool))
        offsets = np.append(cuts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(
            pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]
        ).dictionary_encode()
        number = self._numbers(pieces.dictionary.to_pylist(), wide)[pieces.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(self.size[number])])
        return self._gather(number), np.diff(upto[np.searchsorted(cuts, bounds)])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(file: str) -> PieceEncoder:
    """One encoder per Python worker and vocabulary."""
    if file not in _ENCODERS:
        _ENCODERS[file] = PieceEncoder(file)
    return _ENCODERS[file]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[slice]:
    """Consecutive rows of at most ``most`` bytes of text; a longer text is a slice by itself."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1])
    at, filled = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if filled and filled + n > most:
            yield slice(at, i)
            at, filled = i, 0
        filled += n
    if at < len(texts):
        yield slice(at, len(texts))


def write_token_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Write (seq, doc_id, n_tokens, ids) in ascending doc_id order, a file per range of ids.

    Each document's ids end with ``end_id``; a null text counts as empty. ``seq`` numbers
    the rows within a file in its low 33 bits and the files in the bits above. Rows without
    a doc_id come first, rows that share one are ordered by text. ``encoding`` is
    ``dictionary`` or ``delta``. Other columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = valid_texts(batch.column(1))
            for rows in slices(texts):
                part = texts[rows.start:rows.stop]
                ids, sizes = encoder(vocabulary).encode(part)
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id).astype(np.int32)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start:rows.stop], pa.array(sizes + 1, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    names=["doc_id", "n_tokens", "ids"],
                )

    out = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_tokens int, ids array<int>"
    (
        picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, out)
        .select(F.monotonically_increasing_id().alias("seq"), "doc_id", "n_tokens", "ids")
        .write.options(**{
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
            "parquet.block.size": row_group_bytes,
            "parquet.page.size": page_bytes,
            "compression": "zstd",
        }).parquet(path)
    )


def read_token_ids(
    spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None, ids: bool = True
) -> DataFrame:
    """Stored documents from ``first_id`` to ``last_id``; without ``ids`` only the metadata columns are read."""
    stored = spark.read.parquet(path)
    if first_id is not None:
        stored = stored.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        stored = stored.filter(F.col("doc_id") <= last_id)
    return stored if ids else stored.drop("ids")


def stored_summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all stored documents, from the files.

    ``start`` is the number of ids before the document. The running sum runs within each
    file; the files' totals, a row each, give the rest.
    """
    stored = read_token_ids(spark, path)
    id_type = stored.schema["doc_id"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())],
                names=["seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = (
        stored.select("seq", "doc_id", "ids")
        .mapInArrow(check, f"seq long, doc_id {id_type}, n_tokens long, ids_crc32 long")
        .withColumn("file", F.shiftright("seq", 33))
    )
    files = (
        read_token_ids(spark, path, ids=False).groupBy(F.shiftright("seq", 33).alias("file"))
        .agg(F.sum("n_tokens").alias("n"))
        .select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before_file"))
    )
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("seq")) - F.col("n_tokens")
    return (
        rows.withColumn("before", before).join(files, "file")
        .select("doc_id", (F.col("before_file") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_output(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """Write the token ids of ``docs`` to a new folder in the shared one and summarise the files.

    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_token_ids(docs, path, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), **options)
    return stored_summary(spark, path)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
