"""Merkle manifest of a dataset by nested-interval labels.

Rows are ranked once over the whole table, by group, id and leaf. Every node of every
tree is labelled with the interval of leaf ranks that it covers, so that one node is an
ancestor of another exactly if its interval contains the other's. Trees are built level
by level from runs of consecutive nodes, a tree for each group and one over their roots.

Going down, each level's nodes meet their parents in a containment join inside a bucket
(level, tree, place of the parent). The siblings of a node are what remains of the
parent's interval without the node's own: the children to its left and to its right. A
node hands these lists to its children, so that the last join has a row for every run of
leaves and not for every leaf; a leaf needs no join of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import UPPER, ascii_lower, settle, table, total

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column | str) -> Column:
    """Lowercase hex SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for a null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def with_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` written in this order, with its 0-based place in ``rank``.

    Rows are sorted by ranges, numbered inside the file that they are written to, and
    shifted by the rows of the files before, so no task holds more than a range.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = settle(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_start")
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("_part", part).join(starts, "_part")
        .withColumn("rank", F.col("_start") + inside).drop("_part", "_at", "_start")
    )


def _runs(nodes: DataFrame, arity: int, level: int, name: str) -> DataFrame:
    """Runs of ``arity`` consecutive nodes of a tree, each with its children and their digest.

    ``nodes`` has (tree, n, pos, lo, hi, digest, item): ``n`` nodes of the tree on this level,
    the place among them, the interval of ranks and what the node carries. A tree of one node
    has nothing to hash: its run passes the node's digest on.
    """
    child = F.struct("lo", "hi", "digest", "item")
    runs = nodes.groupBy("tree", "n", F.floor(F.col("pos") / arity).cast("long").alias("pos")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array_sort(F.collect_list(child), lambda a, b: F.signum(a["lo"] - b["lo"]).cast("int")).alias("children"),
    )
    hashed = digest(F.array_join(F.transform("children", lambda c: c["digest"]), ""))
    return settle(
        runs.withColumn("digest", F.when(F.col("n") > 1, hashed).otherwise(F.col("children")[0]["digest"])),
        f"{name}-{level}",
    )


def build(leaves: DataFrame, most: int, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and the root of each tree: (tree, lo, hi, digest).

    ``most`` is the number of leaves of the largest tree, which gives the number of levels.
    """
    levels, roots, nodes = [], [], leaves
    while True:
        runs = _runs(nodes, arity, len(levels), name)
        levels.append(runs)
        above = runs.withColumn("n", F.ceil(F.col("n") / arity).cast("long")).drop("children")
        roots.append(above.filter("n = 1").select("tree", "lo", "hi", "digest"))
        most = -(-most // arity)
        if most <= 1:
            break
        nodes = above.filter("n > 1").withColumn("item", F.lit(None).cast("int"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return levels, found


def attach(levels: list[DataFrame], tops: DataFrame, arity: int, carried: Sequence[str]) -> DataFrame:
    """The children of the lowest level with ``path``, the siblings on the way to the root.

    ``tops`` has (tree, path) and the ``carried`` columns for the root of each tree. An element
    of a path holds the joined digests of the siblings to the left and to the right.
    """
    parents = None  # nodes of the level above as children: (tree, pos, lo, hi, path)
    for level in reversed(range(len(levels))):
        runs = levels[level]
        single = F.ceil(F.col("n") / arity) == 1
        found = runs.filter(single).join(tops, "tree")
        if parents is not None:
            run, above = runs.filter(~single).alias("run"), parents.alias("above")
            inside = F.expr("run.tree = above.tree AND run.pos = above.pos AND above.lo <= run.lo AND run.hi <= above.hi")
            met = run.join(above, inside).select("run.*", *[f"above.{c}" for c in ("path", *carried)])
            found = found.unionByName(met)
        children = found.select(
            "tree", "n", (F.col("pos") * arity).alias("first"), "path", *carried,
            F.col("children").alias("all"), F.posexplode("children").alias("place", "child"),
        )

        def siblings(outside: Column) -> Column:
            return F.array_join(F.transform(F.filter("all", lambda c: F.when(outside == -1, c["hi"] <= F.col("child.lo"))
                                                     .otherwise(c["lo"] >= F.col("child.hi"))), lambda c: c["digest"]), "")

        step = F.struct(siblings(F.lit(-1)).alias("left"), siblings(F.lit(1)).alias("right"))
        path = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        parents = children.select(
            "tree", (F.col("first") + F.col("place")).alias("pos"), "child.lo", "child.hi", "child.digest", "child.item",
            path.alias("path"), *carried,
        )
    return parents


EMPTY_PATH = "cast(array() AS array<struct<left: string, right: string>>)"


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["left"], acc, step["right"]))


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    changed: dict[str, Column] | None = None,
    arity: int = ARITY,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, changed_leaf, subroot, root, path.

    A leaf is the hash of ``fields``, each null as ``-``, else its length in bytes, a colon and
    the value. ``path`` lists the siblings from the leaf to the root, ``changed_leaf`` is the
    leaf with the expressions of ``changed`` in place of their fields, null where none applies.
    Leaves of a group are in ascending order of the id, rows without one first; rows that
    share an id follow by leaf, equal rows in any order. Groups are in bytewise order, the
    null group first; a group of one row has its leaf as subroot. Texts count as their bytes,
    valid UTF-8 or not. Other columns are ignored, an empty table gives an empty result.
    """
    def leaf(replaced: dict[str, Column]) -> Column:
        return digest(*[field(replaced.get(f, F.col(f"`{f}`"))) for f in fields])

    original = leaf({})
    after = leaf(changed) if changed else original
    rows = docs.select(
        F.col(f"`{group_col}`").alias("grp"), F.col(f"`{id_col}`").alias("doc_id"), original.alias("leaf"), after.alias("changed_leaf"),
        F.monotonically_increasing_id().alias("mark"),
    )
    # The mark tells equal rows apart, so that they too are dealt to several tasks.
    order = [F.col(c).asc_nulls_first() for c in ("grp", "doc_id", "leaf", "mark")]
    ranked = settle(with_rank(settle(rows, "merkle-leaves"), order, "merkle-order"), "merkle-ranked")
    groups = settle(ranked.groupBy("grp").agg(F.min("rank").alias("lo"), F.count("*").alias("n")), "merkle-groups")
    most, n_groups = total(groups, F.max("n"), F.count("*"))
    groups = with_rank(groups, [F.col("lo")], "merkle-trees").withColumnRenamed("rank", "tree")

    g, r = groups.alias("g"), ranked.alias("r")
    leaves = r.join(g, F.col("r.grp").eqNullSafe(F.col("g.grp"))).select(
        "g.tree", "g.n", (F.col("r.rank") - F.col("g.lo")).alias("pos"), F.col("r.rank").alias("lo"), (F.col("r.rank") + 1).alias("hi"),
        F.col("r.leaf").alias("digest"), F.struct("r.doc_id", F.nullif("r.changed_leaf", "r.leaf").alias("changed")).alias("item"),
    )
    lower, subroots = build(leaves, most or 0, arity, "merkle-run")
    upper, roots = build(
        subroots.select(
            F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("pos"),
            "lo", "hi", "digest", F.lit(None).cast("int").alias("item"),
        ),
        n_groups, arity, "merkle-top",
    )
    top = roots.select("tree", F.expr(EMPTY_PATH).alias("path"), F.col("digest").alias("root"))
    tops = attach(upper, top, arity, ["root"]).select(
        F.col("pos").alias("tree"), "path", F.col("digest").alias("subroot"), "root"
    )
    return attach(lower, settle(tops, "merkle-tops"), arity, ["subroot", "root"]).select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"),
        F.coalesce("item.changed", "digest").alias("changed_leaf"), "subroot", "root", "path",
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tampered = F.when(number % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    manifest = merkle_manifest(table(spark, sf_dir, "documents"), changed={"text": tampered})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"),
        fold(F.col("changed_leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of the SQL: enough for 8^8 rows of a group and 8^8 groups.
SQL_LEVELS = 8


def _sql_tree(name: str, leaves: str) -> str:
    """CTEs ``{name}_0`` to ``{name}_8``: (tree, pos, h) of every level; the last has the roots alone."""
    parts = [f"{name}_0 AS ({leaves})"]
    for k in range(SQL_LEVELS):
        parts.append(f"""{name}_{k + 1} AS (
  SELECT tree, pos // {ARITY} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_{k}) GROUP BY tree, pos // {ARITY})""")
    return ",\n".join(parts)


def _sql_fold(name: str, tree: str, start: str) -> str:
    """CTEs from ``start`` (id, tree, pos, h, proof) up the tree: the folded digest and the siblings so far."""
    parts, last = [], start
    for k in range(SQL_LEVELS):
        parts.append(f"""{name}_{k + 1} AS (
  SELECT f.id, f.tree, any_value(f.pos) // {ARITY} AS pos,
    CASE WHEN any_value(t.n) > 1 THEN sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos))
         ELSE any_value(f.h) END AS h,
    any_value(f.proof) || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos <> f.pos), '') AS proof
  FROM {last} f JOIN (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {tree}_{k}) t
    ON t.tree = f.tree AND t.pos // {ARITY} = f.pos // {ARITY}
  GROUP BY f.id, f.tree)""")
        last = f"{name}_{k + 1}"
    return ",\n".join(parts)


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)
_TAMPERED = " || ".join(
    _FIELD.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')" if f == "text" else f) for f in FIELDS
)
#: CRC-32 over the digits of the id, with the usual reversed polynomial; DuckDB has no function for it.
_SHIFT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
OP13_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: {_SHIFT.format('c')}) ORDER BY b) AS t FROM range(256) r(b)
), marked AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS bad
  FROM documents, crc_table
), ranked AS (
  SELECT doc_id AS id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
    sha256({_LEAF}) AS h, CASE WHEN bad THEN sha256({_TAMPERED}) ELSE sha256({_LEAF}) END AS changed
  FROM marked
), {_sql_tree("low", "SELECT tree, pos, h FROM ranked")},
{_sql_tree("top", f"SELECT 0 AS tree, tree AS pos, h FROM low_{SQL_LEVELS}")},
start_low AS (SELECT id, tree, pos, changed AS h, '' AS proof FROM ranked),
{_sql_fold("up", "low", "start_low")},
start_top AS (SELECT id, 0 AS tree, tree AS pos, h, proof FROM up_{SQL_LEVELS}),
{_sql_fold("on", "top", "start_top")}
SELECT r.id AS doc_id, r.h AS leaf, s.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root,
  o.h = t.h AS verified
FROM ranked r JOIN low_{SQL_LEVELS} s ON s.tree = r.tree JOIN on_{SQL_LEVELS} o ON o.id = r.id, top_{SQL_LEVELS} t
"""
