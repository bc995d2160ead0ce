"""Texts that are not UTF-8, columns with any names, and scores and counts of single texts."""

import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import toxicity as tox
from cohortlens.llm.fill_in_middle import fill_in_middle
from cohortlens.llm.merkle import merkle_manifest
from cohortlens.llm.packing import pack
from cohortlens.llm.token_counts import TokenCounter
from tests.llm.data import PASSAGE, documents
from tests.llm.test_contracts import FILTERS, OPERATORS

ALL = {
    **OPERATORS, "pack": lambda spark, docs: pack(docs), "fill_in_middle": lambda spark, docs: fill_in_middle(docs),
    "merkle_manifest": lambda spark, docs: merkle_manifest(docs),
}
BROKEN = "61FF62C3206F6E652074776FC3282066756E20EDA080"  # a, FF, b, a cut character, words, a cut one, a surrogate


@pytest.mark.parametrize("name", ALL)
def test_text_that_is_not_utf8(spark, name):
    more = spark.sql(f"""SELECT id AS doc_id, cast(concat(X'{BROKEN}', encode('{PASSAGE}', 'utf-8')) AS string) AS text,
        'en' AS lang, 'a' AS source, 5L AS n_chars FROM range(500, 504)""")
    docs = documents(spark).unionByName(more)
    got = ALL[name](spark, docs)
    got = got.select(*[c for c, kind in got.dtypes if kind != "string" and "string" not in kind])
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert name in FILTERS or ids >= {500, 501, 502, 503}


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_dotted_columns(spark, name):
    docs = documents(spark).withColumn("a.b", F.lit(1)).withColumn("c d", F.lit(2)).withColumnRenamed("n_chars", "n.chars")
    kept = ALL[name](spark, docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert {tuple(r) for r in kept.select("`a.b`", "`c d`").collect()} == {(1, 2)}


def test_filters_take_another_id_column(spark):
    from cohortlens.llm.simhash import one_of_each_group
    from tests.llm.test_contracts import labels

    docs = documents(spark).withColumnRenamed("doc_id", "key.id")
    for kept in (tox.accepted_documents(docs, labels(spark), id_col="key.id"), one_of_each_group(docs, id_col="key.id")):
        assert kept.columns == docs.columns and kept.count() > 0


def loops(net, text):
    """The score of one text by plain loops."""
    words, numbers, _ = tox.distinct_words(pa.array([text], pa.string()))
    rows = net.vectors(tox.buckets_of(words)) if words else np.zeros((0, tox.DIMENSIONS))
    row = [rows[n].astype(float) for n in numbers] + [np.zeros(tox.DIMENSIONS)] * tox.PAD
    margin = net.offset
    for i, kernel in enumerate(net.kernels):
        for f in range(tox.FILTERS):
            best = max(
                sum(float(row[at + k] @ kernel[k][:, f].astype(float)) for k in range(len(kernel)))
                for at in range(len(row) - len(kernel) + 1)
            )
            margin += max(best + float(net.bias[i, f]), 0.0) * float(net.output[i * tox.FILTERS + f])
    return 1 / (1 + np.exp(-margin))


def test_toxicity_scores_depend_on_their_own_text_alone():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["vile", "foul", "idiot"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 9, 200)] + ["", " ", "one", "vile foul idiot", "plain words here", ""]
    y = np.array([any(w in t for w in ("vile", "foul", "idiot")) for t in texts], np.float32)
    net = tox.train(texts, y, np.ones(len(y), np.float32), epochs=4)
    want = np.array([loops(net, t) for t in texts])
    assert want.std() > 0.1
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1], rng.permutation(len(texts))):
        assert net.scores(pa.array([texts[i] for i in order], pa.string())) == pytest.approx(want[order], abs=1e-6)
    before = tox.SCORE_BYTES
    try:
        tox.SCORE_BYTES = 20
        assert net.all_scores(pa.array(texts, pa.string())) == pytest.approx(want, abs=1e-6)
    finally:
        tox.SCORE_BYTES = before


def test_token_counts_of_all_characters():
    """Alone, between letters, after a mark and before one; the pieces of a text are counted together."""
    file = public_tokenizers.path("word_bpe_49k.json")
    own, counter = Tokenizer.from_file(file), TokenCounter(file)
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    # Unassigned and private characters are all alike; every 50th of them will do.
    codes = [c for i, c in enumerate(codes) if i % 50 == 0 or unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = [" ".join(f"a{c}b {c} e{c}́ a̧{c} 1{c}!" for c in map(chr, codes[at:at + 20])) for at in range(0, len(codes), 20)]
    want = [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want
