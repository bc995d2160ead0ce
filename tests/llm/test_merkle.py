"""The Merkle manifest against a version by plain loops."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortlens.llm.merkle import fold, merkle_manifest
from tests.llm.data import ROWS, documents, lower, rows_of


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(level, arity):
    """The next level and, for each node, the siblings to its left and right."""
    runs = [level[i:i + arity] for i in range(0, len(level), arity)]
    beside = [("".join(run[:k]), "".join(run[k + 1:])) for run in runs for k in range(len(run))]
    return [h(*run) for run in runs], beside


def tree(leaves, arity):
    """Root and, for each leaf, the siblings on its way."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        level, beside = up(level, arity)
        for i in range(len(leaves)):
            paths[i].append(beside[at[i]])
            at[i] //= arity
    return level[0], paths


def brute(rows, arity):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], len(r[1] or ""), text)))
    keyed = []
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        keyed.append((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1]),
                      leaf(r, lower(r[1]) if bad and r[1] is not None else r[1]), r[0]))
    keyed.sort(key=lambda k: k[:5])
    groups = sorted({k[:2] for k in keyed})
    trees = [tree([k[4] for k in keyed if k[:2] == g], arity) for g in groups]
    root, tops = tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, paths), top in zip(groups, trees, tops):
        for k, path in zip([k for k in keyed if k[:2] == g], paths):
            way, now = path + top, k[5]
            for left, right in way:
                now = h(left, now, right)
            out.append((k[6], k[4], subroot, root, h(*[x for step in way for x in step]), now))
    return sorted(out, key=repr)


def manifest(docs, arity):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = merkle_manifest(docs, changed={"text": F.when(bad, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))}, arity=arity)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof"), fold(F.col("changed_leaf"), F.col("path")).alias("folded"))


@pytest.mark.parametrize("arity", [2, 8])
def test_manifest(spark, arity):
    many = [(100 + i, f"Text {i % 40}", ["de", "en", "zz", "Ä", None][min(i % 7, 4)], "s") for i in range(150)]
    rows = ROWS + many + [(7000 + i, "Alone", f"lang{i}", "s") for i in range(20)] + many[:5]
    got = manifest(documents(spark, rows), arity)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, arity)


def test_small_tables(spark):
    assert manifest(documents(spark, []), 8).count() == 0
    one = manifest(documents(spark, [(3, "Only", "en", "a")]), 8).first()
    assert one.leaf == one.subroot == one.root and one.proof == h("") and sorted(map(tuple, [one]), key=repr) == brute([(3, "Only", "en", "a")], 8)
    same = [(5, "Same", "en", "a")] * 9
    assert sorted(map(tuple, manifest(documents(spark, same), 8).collect()), key=repr) == brute(same, 8)


def test_more_columns_change_nothing(spark):
    assert rows_of(manifest(documents(spark, clashing=True), 8)) == rows_of(manifest(documents(spark), 8))
