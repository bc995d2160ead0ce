"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A text becomes a stream of symbols: the bytes of its words, the last byte of each word
as a symbol of its own kind. The transducer reads the stream; each transition carries
the number of tokens that are certain from there on. A state is what the tokens to come
can depend on: the places in the current word from which a token may still be growing,
each with the token before it and the tokens counted so far. It follows from the merges
that a place's last token is the only one ending there that may stand next to the last
token of the place where it starts. States and transitions are made when first met.

A stream is read in chunks side by side, a numpy step per symbol. The map of a chunk
takes the state before it to the state and the count after it. It is evaluated at the
state that the symbols before the chunk lead to from the start of a word; a scan over
the chunks composes the maps, and those entered in another state are read again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import table, valid_texts
from cohortlens.llm.token_ids import byte_letters, slices

LIMIT = 2048
LAST = 256  # added to the last byte of a word
SYMBOLS = 512
CHUNK = 64
WARM = 24
#: States after which a worker starts its transducer anew.
MOST_STATES = 120_000
SLOT_BITS = 22
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: Below this code point no character combines with others, and lower case and NFC never change.
STABLE = 0x300
ABSENT = 1 << 60


class Transducer:
    """Deterministic transducer of a BPE vocabulary with marked word ends, compiled on demand."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        letters = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> tuple[int, ...]:
            body = token[: -len(suffix)] if token.endswith(suffix) and token != suffix else token
            out = [letters[c] for c in body]
            if body != token:
                out[-1] += LAST
            return tuple(out)

        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: its first merge and the two halves
        for rank, (a, b) in enumerate(merges):
            pair = vocabulary[a], vocabulary[b]
            self.rank.setdefault(pair, rank)
            self.halves.setdefault(vocabulary[a + b], (rank, *pair))
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for name, number in vocabulary.items():
            if number in self.halves or len(symbols(name)) == 1:
                self._add(symbols(name), number)
        self.adjacent: dict[tuple[int, int], bool] = {}
        self.forget()

    def _add(self, symbols: tuple[int, ...], number: int) -> None:
        node = 0
        for s in symbols:
            if s not in self.children[node]:
                self.children[node][s] = len(self.children)
                self.children.append({})
                self.token.append(-1)
            node = self.children[node][s]
        self.token[node] = number

    def forget(self) -> None:
        """Back to the start state alone."""
        self.adjacent.clear()
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.keys = np.full(1 << SLOT_BITS, -1, np.int32)
        self.goal = np.zeros(1 << SLOT_BITS, np.int32)
        self.emit = np.zeros(1 << SLOT_BITS, np.uint8)
        self.filled = 0

    def _spine(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """A token and the parts at its edge, each with the rank of the merge that ends it."""
        ends = ABSENT
        while True:
            yield token, ends
            if token not in self.halves:
                return
            ends, *both = self.halves[token]
            token = both[side]

    def stand_together(self, left: int, right: int) -> bool:
        """Do two adjacent tokens stay two, that is, does no merge cross their border in time?"""
        known = self.adjacent.get((left, right))
        if known is None:
            rights = list(self._spine(right, 0))
            known = not any(
                rank < left_ends and rank <= right_ends
                for a, left_ends in self._spine(left, 1)
                for b, right_ends in rights
                if (rank := self.rank.get((a, b), ABSENT)) < ABSENT
            )
            self.adjacent[left, right] = known
        return known

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and tokens emitted."""
        live, last, count = [], -1, 0
        for node, before, n in self.states[state]:
            below = self.children[node].get(symbol)
            if below is None:
                continue
            token = self.token[below]
            if last < 0 and token >= 0 and (before < 0 or self.stand_together(before, token)):
                last, count = token, n + 1
            if self.children[below]:
                live.append((below, before, n))
        if last < 0:
            raise ValueError("the vocabulary does not cover every byte")
        if symbol >= LAST:
            return 0, count
        live.append((0, last, count))
        least = min(n for _, _, n in live)
        key = tuple((node, before, n - least) for node, before, n in live)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key], least

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each transition, or the free slot where it would go."""
        mask = (1 << SLOT_BITS) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        wrong = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            there = self.keys[at[wrong]]
            wrong = wrong[(there != keys[wrong]) & (there != -1)]
        return at

    def move(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts, compiling the transitions not yet met."""
        keys = (state * SYMBOLS + symbol).astype(np.int32)
        at = self._slots(keys)
        missing = self.keys[at] != keys
        if missing.any():
            for key in np.unique(keys[missing]).tolist():
                slot = int(self._slots(np.array([key], np.int32))[0])
                self.goal[slot], self.emit[slot] = self._step(key // SYMBOLS, key % SYMBOLS)
                self.keys[slot] = key
                self.filled += 1
            at = self._slots(keys)
        return self.goal[at], self.emit[at]

    def full(self) -> bool:
        return len(self.states) > MOST_STATES or self.filled > (1 << SLOT_BITS) * 0.6

    def emitted(self, stream: np.ndarray, chunk: int = CHUNK, warm: int = WARM) -> np.ndarray:
        """Tokens emitted by each symbol of a stream that starts and ends with whole words."""
        if self.full():
            self.forget()
        n = len(stream)
        chunks = -(-n // chunk)
        # A transition from the padding symbol -1 leaves everything as it is.
        padded = np.full((chunks, chunk), -1, np.int16)
        padded.reshape(-1)[:n] = stream
        before = np.full((chunks, warm), -1, np.int16)
        before[1:] = padded[:-1, chunk - warm:]

        def read(part: np.ndarray, state: np.ndarray, out: np.ndarray | None) -> np.ndarray:
            state = state.copy()
            for t in range(part.shape[1]):
                symbol = part[:, t]
                on = np.flatnonzero(symbol >= 0) if (symbol < 0).any() else slice(None)
                state[on], emitted = self.move(state[on], symbol[on].astype(np.int32))
                if out is not None:
                    out[on, t] = emitted
            return state

        entry = read(before, np.zeros(chunks, np.int32), None)
        out = np.zeros((chunks, chunk), np.uint8)
        leave = read(padded, entry, out)
        while True:  # compose the maps from left to right
            wrong = np.flatnonzero(entry[1:] != leave[:-1]) + 1
            if not len(wrong):
                return out.reshape(-1)[:n]
            entry[wrong] = leave[wrong - 1]
            again = np.zeros((len(wrong), chunk), np.uint8)
            leave[wrong] = read(padded[wrong], entry[wrong], again)
            out[wrong] = again


class TokenCounter:
    """Token counts of texts under a vocabulary file with a lower-casing, word-splitting normaliser."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            described = json.load(f)
        model = described["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in described["added_tokens"]) or "(?!)")
        self.tokenizer = Tokenizer.from_file(file)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        """The class of each character as the library's own pattern sees it, asked once a character.

        Between two letters a letter stays inside one piece, and white space makes no piece. Between
        two other marks a mark does, a number does not.
        """
        kind = self.kinds[codes]
        if (kind == UNKNOWN).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for code in np.unique(codes[kind == UNKNOWN]).tolist():
                c = chr(code)
                pieces = len(split(f"a{c}a"))
                self.kinds[code] = LETTER if pieces == 1 else SPACE if pieces == 2 else OTHER if len(split(f"!{c}!")) == 1 else NUMBER
            kind = self.kinds[codes]
        return kind

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a normalised text, and the byte of the text that each stands for."""
        data = np.frombuffer(text.encode(), np.uint8)
        codes = data if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self._kinds(codes)
        last = np.ones(len(codes), bool)
        last[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == NUMBER)
        # 's 't 'm 'd 're 've 'll after anything but another mark are words of their own
        quote = np.flatnonzero((codes[:-1] == 0x27) & (kind[1:] == LETTER))
        quote = quote[(quote == 0) | (kind[quote - 1] != OTHER)]
        one = codes[quote + 1]
        two = codes[np.minimum(quote + 2, len(codes) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (quote + 2 < len(codes)) & (
            ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        )
        last[quote[short | long]] = False
        last[quote[short] + 1] = True
        last[quote[long] + 2] = True
        last[quote[long] + 1] = False
        if codes is data:
            at = np.flatnonzero(kind != SPACE)
            return (data[at] + LAST * last[at]).astype(np.int16), at
        first = (data & 0xC0) != 0x80
        char = np.cumsum(first) - 1
        at = np.flatnonzero(kind[char] != SPACE)
        ends = np.append(first[1:], True)
        return (data[at] + LAST * (ends & last[char])[at]).astype(np.int16), at

    def _count_normal(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without special strings."""
        joined = "\n".join(texts)
        if not joined.isascii():
            normal = self.tokenizer.normalizer.normalize_str
            texts = [t.lower() if t.isascii() or max(t) < chr(STABLE) else normal(t) for t in texts]
            joined = "\n".join(texts)
        else:
            joined = joined.lower()
        if not joined:
            return np.zeros(len(texts), np.int64)
        stream, at = self._symbols(joined)
        if not len(stream):
            return np.zeros(len(texts), np.int64)
        # Each distinct word is read once.
        ends = np.flatnonzero(stream >= LAST) + 1
        bounds = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(ends), [None, pa.py_buffer((2 * bounds).tobytes()), pa.py_buffer(stream.tobytes())]
        ).dictionary_encode()
        distinct = words.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int32)[:len(distinct) + 1] // 2
        symbols = np.frombuffer(distinct.buffers()[2], np.int16)[:offsets[-1]]
        per_word = np.add.reduceat(self.transducer.emitted(symbols), offsets[:-1], dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(per_word[words.indices.to_numpy()])])
        sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(upto[np.searchsorted(at[bounds[:-1]], starts)])

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings count as one token each."""
        counts = np.zeros(len(texts), np.int64)
        owner, parts = [], []
        for i, text in enumerate(texts):
            if "<|" in text and (found := self.special.findall(text)):
                counts[i] += len(found)
                for part in self.special.split(text):
                    owner.append(i)
                    parts.append(part)
            else:
                owner.append(i)
                parts.append(text)
        np.add.at(counts, np.array(owner, np.int64), self._count_normal(parts))
        return counts


_COUNTERS: dict[str, TokenCounter] = {}


def counter(file: str) -> TokenCounter:
    """One compiled transducer per Python worker and vocabulary."""
    if file not in _COUNTERS:
        _COUNTERS[file] = TokenCounter(file)
    return _COUNTERS[file]


def token_counts(
    docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is a tokenizers file with a BPE model that marks word ends. A null text
    counts as empty, with 0 bytes and tokens; what is not UTF-8 in a text counts as a
    replacement character. Rows that share a doc_id are counted each by
    itself, a null id stays null. Other columns are ignored, an empty table gives an empty
    result.
    """
    file = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = valid_texts(batch.column(1))
            for rows in slices(texts):
                part = texts[rows.start:rows.stop]
                n = counter(file).count(part.to_pylist())
                n_bytes = np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset:part.offset + len(part) + 1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows.start:rows.stop], pa.array(n_bytes.astype(np.int64)), pa.array(n),
                     pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    out = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return picked.mapInArrow(count, out)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
