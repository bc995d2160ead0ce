"""Fill-in-the-middle against a version by string operations, and as a round trip."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import fill_in_middle as fim
from cohortlens.llm.fill_in_middle import fill_in_middle, restored
from tests.llm.data import CLASHING, ROWS, documents, rows_of

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(i, text):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text or "")
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text or ""
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    odd = ["<P", "P>", "<", "S>x<M", "a<P>b", "<<S>>", "M><", "éa bÉ", "中文 ab", "x" * 70_000 + " 1"] * 4
    rows = ROWS + [(1000 + i, t, "en", "a") for i, t in enumerate(odd)]
    docs = documents(spark, rows).coalesce(1)
    want = sorted((brute(i, t) for i, t, *_ in rows), key=repr)
    got = fill_in_middle(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    texts = sorted((t or "" for _, t, *_ in rows))
    assert sorted(r.restored for r in restored(got).collect()) == texts
    assert rows_of(fill_in_middle(docs.repartition(7))) == rows_of(got)


def test_columns_and_empty_tables(spark):
    docs = documents(spark, clashing=True)
    assert rows_of(fill_in_middle(docs)) == rows_of(fill_in_middle(documents(spark)))
    assert fill_in_middle(documents(spark, [])).count() == 0
    assert restored(fill_in_middle(documents(spark, []))).count() == 0
    more = fill_in_middle(documents(spark)).withColumns({c: F.lit(1) for c in CLASHING if c != "n"}).withColumn("a.b", F.lit(2))
    assert restored(more).columns == [*more.columns, "restored"]


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("SELECT id AS doc_id, cast(X'61FF62C3A980416263C3' AS string) AS text FROM range(40)")
    for r in restored(fill_in_middle(docs)).select("*", F.hex(F.col("restored").cast("binary")).alias("h")).drop("output", "restored").collect():
        assert r.h == "61FF62C3A980416263C3" and (r.prefix_chars is None) == (r.form == "plain")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab<>PSM é中")), max_size=12), min_size=1, max_size=8), st.integers(0, 1000), st.sampled_from([3, 1 << 20]))
def test_round_trip(texts, seed, window):
    before, fim.WINDOW = fim.WINDOW, window
    try:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        rng = np.random.default_rng(seed)
        n, a, b = fim.cuts(data, bounds, rng.integers(0, 99, len(raw)), rng.integers(0, 99, len(raw)))
        assert n.tolist() == [len(UNIT.findall(t)) for t in texts]
        plain = (n == 0) | (rng.random(len(raw)) < 0.3)
        plain[fim.marks_in(data, bounds)[1]] = True
        first = rng.random(len(raw)) < 0.5
        out, out_bounds = fim.transform(data, bounds, a, b, plain, first)
        for i, x in enumerate(raw):
            p, m, s = x[:a[i] - bounds[i]], x[a[i] - bounds[i]:b[i] - bounds[i]], x[b[i] - bounds[i]:]
            want = x if plain[i] else b"<S>" + s + b"<P>" + p + b"<M>" + m if first[i] else b"<P>" + p + b"<S>" + s + b"<M>" + m
            assert out[out_bounds[i]:out_bounds[i + 1]].tobytes() == want
        forms = np.where(plain, "plain", np.where(first, "spm", "psm"))
        back, back_bounds = fim.restore(out, out_bounds, forms)
        assert back.tobytes() == b"".join(raw) and back_bounds.tolist() == bounds.tolist()
    finally:
        fim.WINDOW = before
