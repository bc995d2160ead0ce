"""Toxicity scores by a convolutional text classifier trained in numpy.

Words are embedded as the sum of hashed vectors of the word and of its first bytes;
filters of widths one to three run over all words of a text, their maxima over the whole
text feed a logistic output. Training uses a bounded sample of labelled rows on the
driver; scoring runs in Arrow batches over whole texts. A threshold for each language is
calibrated on all other labelled rows outside the held-out quarter, counted by score. Only the text goes into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import settle, table
from cohortlens.llm.token_ids import slices

#: Labelled rows in the training sample, of each class, and the characters a sampled text may have.
TRAIN_ROWS = 2500
TRAIN_CHARS = 20_000
#: Score bins, to one, in which labelled rows are counted; thresholds lie between bins.
BINS = 1000
CUT = 0.3
#: F1 that a threshold may give away to lie nearer to ``CUT``.
SLACK = 0.01
BUCKETS = 1 << 16
DIMENSIONS = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
EPOCHS = 10
BATCH = 64
SEED = 7
SCORE_BYTES = 1_000_000

#: Byte table: A-Z to lower case, ASCII that is neither letter nor digit to a blank.
WORD_BYTES = np.array([
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
], np.uint8)
#: Blanks after a text: enough for a text without words to have a place for every filter.
PAD = max(WIDTHS)


def distinct_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts, the words as numbers in these, and the number of words of each text."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if bounds[-1] == bounds[0]:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    data = WORD_BYTES[raw]
    inside = data != 0x20
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[1:-1][bounds[1:-1] < len(data)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    # Each word with the blanks after it, up to the next; blanks are stripped from the distinct ones.
    offsets = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    ).dictionary_encode()
    upto = np.searchsorted(starts, bounds)
    return [w.rstrip() for w in words.dictionary.to_pylist()], words.indices.to_numpy().astype(np.int64), np.diff(upto)


def buckets_of(words: list[bytes]) -> np.ndarray:
    """Hashed rows of each word and of its prefixes."""
    out = np.empty((len(words), 1 + len(PREFIXES)), np.int64)
    out[:, 0] = [zlib.crc32(w) & (BUCKETS - 1) for w in words]
    for k, n in enumerate(PREFIXES, 1):
        out[:, k] = [zlib.crc32(w[:n], k) & (BUCKETS - 1) for w in words]
    return out


@dataclass
class Network:
    embedding: np.ndarray  # buckets x dimensions
    kernels: list[np.ndarray]  # for each width: width x dimensions x filters
    bias: np.ndarray  # widths x filters
    output: np.ndarray  # widths * filters
    offset: float

    def features(self, vectors: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of all filters for each text, the place of each, and the padded words.

        ``vectors`` holds the distinct words' vectors. A text is followed by zero vectors, and a
        filter counts only where it ends within the text and these, so a score depends on its own
        text alone; a text without words has the features of the zero vectors.
        """
        total = len(words) + PAD * len(sizes)
        starts = np.cumsum(sizes + PAD) - (sizes + PAD)
        padded = np.full(total + PAD, len(vectors), np.int64)
        own = np.ones(total, bool)
        ends = starts + sizes
        for k in range(PAD):
            own[ends + k] = False
        padded[:total][own] = words
        maxima = np.empty((len(sizes), self.bias.size), np.float32)
        places = np.empty((len(sizes), self.bias.size), np.int64)
        vectors = np.concatenate([vectors, np.zeros((1, DIMENSIONS), np.float32)])
        owner = np.repeat(np.arange(len(sizes)), sizes + PAD)
        for i, kernel in enumerate(self.kernels):
            reach = np.zeros((total, FILTERS), np.float32)
            for k in range(len(kernel)):
                reach += (vectors @ kernel[k])[padded[k:k + total]]
            for k in range(1, len(kernel)):  # places from which a filter would reach into the next text
                reach[ends + PAD - k] = -np.inf
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            top = np.maximum.reduceat(reach, starts, axis=0)
            maxima[:, cols] = top
            if self.training:
                hit = reach == top[owner]
                rows, filters = np.nonzero(hit)
                places[owner[rows[::-1]], i * FILTERS + filters[::-1]] = rows[::-1]  # the first place counts
        return maxima + self.bias.reshape(-1), places, padded

    training = False

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return self.embedding[buckets].sum(axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        words, numbers, sizes = distinct_words(texts)
        vectors = self.vectors(buckets_of(words)) if words else np.zeros((0, DIMENSIONS), np.float32)
        top, _, _ = self.features(vectors, numbers, sizes)
        margin = np.maximum(top, 0) @ self.output + self.offset
        return 1 / (1 + np.exp(-margin.astype(np.float64)))

    def all_scores(self, texts: pa.Array) -> np.ndarray:
        """Scores of texts without nulls, a slice at a time."""
        return np.concatenate([np.zeros(0), *(self.scores(texts[s.start:s.stop]) for s in slices(texts, SCORE_BYTES))])


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Weighted logistic loss, Adagrad; one class only gives a constant score."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(np.average(labels, weights=weights), 1e-4, 1 - 1e-4)) if len(labels) else 1e-4
    net = Network(
        rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros((len(WIDTHS), FILTERS), np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        float(np.log(share / (1 - share))),
    )
    if not len(labels) or labels.min() == labels.max():
        return net
    net.output[:] = rng.normal(0, 0.3, net.output.shape)
    net.training = True
    words, numbers, sizes = distinct_words(pa.array(texts, pa.string()))
    buckets = buckets_of(words) if words else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    ends = np.cumsum(sizes)
    sums = {"e": np.full(net.embedding.shape, 1e-3, np.float32), "b": np.full(net.bias.shape, 1e-3, np.float32),
            "o": np.full(net.output.shape, 1e-3, np.float32), "k": [np.full(k.shape, 1e-3, np.float32) for k in net.kernels]}
    sum_c = 1e-3

    def descend(value: np.ndarray, past: np.ndarray, slope: np.ndarray, rate: float) -> None:
        past += slope * slope
        value -= rate * slope / np.sqrt(past)

    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs) + 0.01
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            part = np.concatenate([numbers[ends[r] - sizes[r]:ends[r]] for r in rows])
            used, local = np.unique(part, return_inverse=True)
            vectors = net.vectors(buckets[used]) if len(used) else np.zeros((0, DIMENSIONS), np.float32)
            top, places, padded = net.features(vectors, local, sizes[rows])
            hidden = np.maximum(top, 0)
            score = 1 / (1 + np.exp(-(hidden @ net.output + net.offset)))
            error = ((score - labels[rows]) * weights[rows] / weights[rows].sum()).astype(np.float32)
            to_top = error[:, None] * net.output * (top > 0)
            vectors = np.concatenate([vectors, np.zeros((1, DIMENSIONS), np.float32)])
            to_vectors = np.zeros_like(vectors)
            for i, kernel in enumerate(net.kernels):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                slope, place = to_top[:, cols], places[:, cols]
                to_kernel = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    word = padded[place + k]
                    to_kernel[k] = np.einsum("rf,rfd->df", slope, vectors[word])
                    np.add.at(to_vectors, word.reshape(-1), (slope[:, :, None] * kernel[k].T[None]).reshape(-1, DIMENSIONS))
                descend(kernel, sums["k"][i], to_kernel, rate)
            descend(net.bias, sums["b"], to_top.sum(0).reshape(net.bias.shape), rate)
            descend(net.output, sums["o"], hidden.T @ error, rate)
            slope_c = float(error.sum())
            sum_c += slope_c * slope_c
            net.offset -= rate * slope_c / sum_c ** 0.5
            moved = np.flatnonzero(np.abs(to_vectors[:-1]).sum(1))
            if len(moved):
                touched, where = np.unique(buckets[used[moved]].reshape(-1), return_inverse=True)
                slope = np.zeros((len(touched), DIMENSIONS), np.float32)
                np.add.at(slope, where.reshape(-1), np.repeat(to_vectors[:-1][moved], 1 + len(PREFIXES), axis=0))
                past = sums["e"][touched] + slope * slope
                sums["e"][touched] = past
                net.embedding[touched] -= rate * slope / np.sqrt(past)
    net.training = False
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) outside the held-out quarter; of a doc_id with several labels the highest counts."""
    return (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )


def labelled_sample(docs: DataFrame, known: DataFrame, train_rows: int, train_chars: int) -> tuple[list, float]:
    """Training rows (doc_id, text, toxic) and the labels' ratio of clean to toxic.

    Drawn by hash from ``known``. Texts are read only for the rows drawn.
    """
    counts = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(SEED), "doc_id")
    drawn: list = []
    for kind in (0, 1):
        # A third of a class at least is left for calibration.
        own = counts.get(kind, 0)
        top = known.filter(F.col("toxic") == kind).orderBy(order, "doc_id").limit(min(train_rows, own - own // 3))
        drawn += [(r.doc_id, kind) for r in top.collect()]
    picked = docs.sparkSession.createDataFrame(drawn, known.select("doc_id").schema.add("toxic", "integer"))
    # Of rows that share an id, one is learned.
    rows = (
        docs.join(F.broadcast(picked), "doc_id").filter(F.char_length("text") <= train_chars)
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return rows, counts.get(0, 0) / max(counts.get(1, 0), 1)


def language_thresholds(counts: list[tuple], ratio: float, default: float = CUT, least: int = 20) -> dict:
    """A threshold for each language with ``least`` toxic rows, ``default`` for the others.

    ``counts``: language, toxic, bin and number of rows; clean rows get the weight that makes them
    ``ratio`` times the toxic ones. Of the borders of bins whose weighted F1 is within ``SLACK``
    of the best, the one nearest to ``default``: a few rows do not move it far.
    """
    n_toxic = sum(n for _, y, _, n in counts if y)
    weight = ratio * max(n_toxic, 1) / max(sum(n for _, y, _, n in counts if not y), 1)
    by_lang: dict = {}
    for lang, y, bin, n in counts:
        by_lang.setdefault(lang, np.zeros((2, BINS + 1)))[y, bin] += n
    out: dict = {}
    for lang, (clean, toxic) in by_lang.items():
        if toxic.sum() < least or not clean.sum():
            out[lang] = default
            continue
        hits, wrong = (np.cumsum(x[::-1])[::-1] for x in (toxic, clean * weight))
        f1 = 2 * hits / (hits + wrong + toxic.sum())
        good = np.flatnonzero(f1 >= f1.max() - SLACK) / BINS
        out[lang] = float(good[np.argmin(np.abs(good - default))])
    return out


def fit_network(docs: DataFrame, known: DataFrame, train_rows: int, train_chars: int) -> tuple[Network, list, float]:
    """The trained network, the ids it learned from, and the labels' ratio of clean to toxic."""
    learned, ratio = labelled_sample(docs, known, train_rows, train_chars)
    # Weights that give the classes their share among all labelled rows.
    y = np.array([r.toxic for r in learned], np.float32)
    clean = ratio * max(y.sum(), 1) / max((y == 0).sum(), 1)
    net = train([r.text for r in learned], y, np.where(y == 1, 1.0, clean).astype(np.float32))
    return net, [(r.doc_id,) for r in learned], ratio


def fit(
    docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, cut: float = CUT,
    row_text: int | None = None,
) -> tuple[dict, DataFrame]:
    """The threshold of each language, and (doc_id, lang, score) of every row.

    ``docs``: doc_id, text, lang. Thresholds cover all labelled rows, with their whole texts,
    but the held-out quarter and the rows learned from. With ``row_text``, ``docs`` also has a
    struct ``row``, which holds the text at that place and stays with the score.
    """
    labels = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "toxic")
    known = settle(known_labels(labels), "toxicity-labels")
    net, learned, ratio = fit_network(docs, known, train_rows, train_chars)
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(BINS + 1) / BINS
        for batch in batches:
            texts = batch.column(2) if row_text is None else batch.column(2).field(row_text)
            scores = sent.value.all_scores(pc.fill_null(texts.cast(pa.string()), ""))
            bins = np.searchsorted(edges, scores, side="right") - 1
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(bins, pa.int32()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns[:len(out)], names=out.names)

    out = T.StructType([*(docs.schema[c] for c in ("doc_id", "lang")), T.StructField("score", T.DoubleType()), T.StructField("bin", T.IntegerType())])
    if row_text is not None:
        out = out.add(docs.schema["row"])
    scored = settle(
        docs.select("doc_id", "lang", "text" if row_text is None else "row").mapInArrow(score, out), "toxicity-scores"
    )
    used = F.broadcast(docs.sparkSession.createDataFrame(learned, known.select("doc_id").schema))
    counts = (
        scored.join(known, "doc_id").join(used, "doc_id", "left_anti")
        .groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")).collect()
    )
    thresholds = language_thresholds([tuple(r) for r in counts], ratio, cut)
    return thresholds, scored.drop("bin")


def _threshold(thresholds: dict, cut: float) -> Column:
    """The threshold of a row's language."""
    threshold = F.lit(cut)
    for lang, value in sorted(thresholds.items(), key=repr):
        threshold = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(value)).otherwise(threshold)
    return threshold


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = TRAIN_ROWS,
    train_chars: int = TRAIN_CHARS,
    cut: float = CUT,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, threshold, rejected.

    ``predicted`` is 1 from ``cut`` on; ``rejected`` compares with the calibrated threshold of
    the row's language (``cut`` where there are too few labels). Null and empty texts get the
    score of a text without words. Without labels of both classes the score is constant.
    Rows that share a doc_id are scored each by itself, a null id is not held out. Other
    columns are ignored, an empty table gives an empty result.
    """
    thresholds, scored = fit(_picked(docs, id_col, text_col, lang_col), labels, train_rows, train_chars, cut)
    threshold = _threshold(thresholds, cut)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"),
        threshold.alias("threshold"), (F.col("score") >= threshold).alias("rejected"),
    )


def _picked(docs: DataFrame, id_col: str, text_col: str, lang_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.col(f"`{lang_col}`").alias("lang"), *more,
    )


def accepted_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    cut: float = CUT, **options,
) -> DataFrame:
    """The rows of ``docs`` below their language's threshold, with all their columns.

    Each row is scored once and kept with its score, rows that share an id each by themselves. A
    null or empty text has the score of a text without words, a null language its own threshold.
    Columns may have any names; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    picked = _picked(docs, id_col, text_col, lang_col, row)
    thresholds, scored = fit(picked, labels, cut=cut, row_text=docs.columns.index(text_col), **options)
    return scored.filter(F.col("score") < _threshold(thresholds, cut)).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
