"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents that belong to the same set of sources form a pattern. The patterns' sizes
are the capacities of a small network: a pattern can send its size once for each pass,
every further pass at a higher cost, to any of its sources, and each source draws up to
its target. Only the patterns' totals reach the driver; the flow says how much of each
pattern is taken. Documents are then taken in the order of a seeded hash, each that still
fits; one that does not fit is passed over and the smaller ones behind it go on filling.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import settle, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
SEED = 42
#: Patterns whose totals may go to the driver.
MAX_PATTERNS = 100_000
#: Most ranges of the seeded hash in which a pattern's sizes are summed, as a power of two.
RANGE_BITS = 14
#: Documents that the ranges read by the driver hold together, about; more only where ranges cannot be narrower.
DRIVER_ROWS = 1 << 17


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, passes: int) -> dict[str | None, Fraction]:
    """Words to take for each source.

    Sources in order of their code points, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target above ``passes`` times its source's size is cut to
    that and the excess is shared among the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, active = Fraction(share) * sum(sizes.values()), {}, set(order)
    while active:
        total = sum(weight[s] for s in active)
        full = {s for s in active if left * weight[s] / total > passes * sizes[s]}
        if not full:
            out |= {s: left * weight[s] / total for s in active}
            break
        out |= {s: Fraction(passes * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        active -= full
    return out


def min_cost_flow(
    supply: dict[str, int], members: dict[str, list], quota: dict, passes: int
) -> dict[tuple[str, object], int]:
    """Words that each pattern sends to each of its sources, as much of the quotas as can be met at least cost.

    A pattern's first pass is free and pass ``k`` costs ``k - 1`` a word. A way from the start to a
    quota costs what the pass that it begins with does, so passes are opened in order of their
    cost, and at each cost as much is sent as the passes opened so far let through. All shortest
    ways are filled together, so the rounds follow the length of the ways, not their number.
    """
    nodes: dict[object, int] = {}
    at = lambda name: nodes.setdefault(name, len(nodes))
    start, end = at(("start",)), at(("end",))
    to: list[int] = []  # an arc and its reverse follow each other
    room: list[int] = []
    leaving: dict[int, list[int]] = {start: [], end: []}

    def arc(a: int, b: int, most: int) -> int:
        for x, y, r in ((a, b, most), (b, a, 0)):
            leaving.setdefault(x, []).append(len(to))
            to.append(y)
            room.append(r)
        return len(to) - 2

    entries, sent = {}, {}
    for p in sorted(supply):
        entries[p] = arc(start, at(("pattern", p)), 0)
        for s in members[p]:
            sent[p, s] = arc(at(("pattern", p)), at(("source", s)), passes * supply[p])
    for s in sorted(quota, key=lambda s: (s is None, s or "")):
        arc(at(("source", s)), end, quota[s])

    for _ in range(passes):
        for p, i in entries.items():
            room[i] += supply[p]
        while depth := _depths(leaving, to, room, start, end):
            _fill_shortest(leaving, to, room, start, end, depth)
    return {key: room[i ^ 1] for key, i in sent.items()}


def _depths(leaving: dict[int, list[int]], to: list[int], room: list[int], start: int, end: int) -> dict[int, int]:
    """Arcs from the start to each node that can be reached, none if the end cannot."""
    depth, level = {start: 0}, [start]
    while level and end not in depth:
        after = []
        for x in level:
            for i in leaving[x]:
                if room[i] > 0 and to[i] not in depth:
                    depth[to[i]] = depth[x] + 1
                    after.append(to[i])
        level = after
    return depth if end in depth else {}


def _fill_shortest(
    leaving: dict[int, list[int]], to: list[int], room: list[int], start: int, end: int, depth: dict[int, int]
) -> None:
    """Sends along ways of the least length until none is left; each arc is given up once."""
    tried = dict.fromkeys(depth, 0)
    way: list[int] = []
    x = start
    while True:
        if x == end:
            flow = min(room[i] for i in way)
            for i in way:
                room[i] -= flow
                room[i ^ 1] += flow
            del way[next(k for k, i in enumerate(way) if not room[i]):]
            x = to[way[-1]] if way else start
        arcs = leaving[x]
        while tried[x] < len(arcs):
            i = arcs[tried[x]]
            if room[i] > 0 and depth.get(to[i]) == depth[x] + 1:
                break
            tried[x] += 1
        if tried[x] < len(arcs):
            way.append(i)
            x = to[i]
        elif way:
            x = to[way.pop() ^ 1]
            tried[x] += 1
        else:
            return


@dataclass
class Plan:
    """Per source its size and target, per pattern its size and the words to take."""

    source_size: dict
    target: dict
    members: dict[str, list]
    size: dict[str, int]
    take: dict[str, int]


def plan_mix(patterns: list[tuple[str, list, int]], weights=WEIGHTS, share=SHARE, passes=PASSES) -> Plan:
    """The flow over (pattern, its sources, its size)."""
    size = {p: n for p, _, n in patterns}
    members = {p: m for p, m, _ in patterns}
    source_size: dict = {}
    for p, m, n in patterns:
        for s in m:
            source_size[s] = source_size.get(s, 0) + n
    # Shares are of all sizes; a document of several sources counts for each of them here.
    target = targets(source_size, weights, share, passes)
    flow = min_cost_flow(size, members, {s: int(t) for s, t in target.items()}, passes)
    take = dict.fromkeys(size, 0)
    for (p, _), n in flow.items():
        take[p] += n
    return Plan(source_size, target, members, size, take)


KEY_BITS = 63


def _pattern(docs: DataFrame, source_col: str) -> Column:
    """The set of sources of a row, sorted; an empty or null one is the null source."""
    source = F.col(source_col)
    if not isinstance(docs.schema[source_col].dataType, T.ArrayType):
        source = F.array(source)
    source = F.array_sort(F.array_distinct(F.transform(source, lambda x: x.cast("string"))))
    return F.when(F.coalesce(F.size(source), F.lit(0)) <= 0, F.array(F.lit(None).cast("string"))).otherwise(source)


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(id_col: str, text_col: str, seed: int) -> Column:
    """The seeded hash by which documents are selected, from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text_col), 1)


STEPS = "array<struct<above:bigint,upto:bigint,most:bigint,take:boolean>>"
LAST_KEY = (1 << KEY_BITS) - 1


def _taken() -> Column:
    """Whether ``steps`` take a document: the last step that covers its key and size counts."""
    def after(taken: Column, step: Column) -> Column:
        covers = (F.col("key") > step["above"]) & (F.col("key") <= step["upto"]) & (F.col("size") <= step["most"])
        return F.when(covers, step["take"]).otherwise(taken)

    return F.aggregate("steps", F.lit(False), after)


def _fill(placed: DataFrame, counts: dict[str, int], gap: dict[str, int], steps: dict[str, list], take: bool) -> None:
    """Take documents (or give back taken ones) in order of their keys, each that fits into what is left of ``gap``.

    Appends to ``steps`` and leaves in ``gap`` less than the size of any document passed over. Documents
    that share a key are taken together. A round sums sizes by ranges of keys, takes the ranges
    that fit as a whole and reads the documents of the first that does not.
    """
    spark = placed.sparkSession
    above = {p: -1 for p, n in gap.items() if n > 0}
    before = {p: steps[p][:] for p in above}
    while above:
        rows = max(DRIVER_ROWS // len(above), 1)
        shift = {p: KEY_BITS - min(RANGE_BITS, max(counts[p] // rows, 0).bit_length()) for p in above}
        wanted = F.broadcast(spark.createDataFrame(
            [(p, above[p], gap[p], shift[p], before[p]) for p in above],
            f"pattern string, above long, gap long, shift int, steps {STEPS}",
        ))
        fitting = (
            placed.join(wanted, "pattern").filter((F.col("key") > F.col("above")) & (F.col("size") <= F.col("gap")))
            .filter(_taken() != F.lit(take))
            .withColumn("range", F.expr("shiftright(key, shift)"))
        )
        order = Window.partitionBy("pattern").orderBy("range")
        sums = (
            fitting.groupBy("pattern", "gap", "range").agg(F.sum("size").alias("n"))
            .withColumn("upto", F.sum("n").over(order))
            .groupBy("pattern").agg(
                F.min_by(
                    F.struct("range", (F.col("gap") - F.col("upto") + F.col("n")).alias("room")),
                    F.when(F.col("upto") > F.col("gap"), F.col("range")),
                ).alias("at"),
                F.sum("n").alias("n"),
            ).collect()
        )
        ends = {r.pattern: r.at for r in sums if r.n > gap[r.pattern]}
        for r in sums:
            if r.pattern not in ends:  # all that is left fits
                steps[r.pattern].append((above[r.pattern], LAST_KEY, gap[r.pattern], take))
                gap[r.pattern] -= r.n
        read: dict[str, list] = {p: [] for p in ends}
        if ends:
            at = F.broadcast(spark.createDataFrame([(p, r.range) for p, r in ends.items()], "pattern string, range long"))
            for r in (
                fitting.join(at, ["pattern", "range"]).groupBy("pattern", "key")
                .agg(F.sum("size").alias("n"), F.max("size").alias("size")).collect()
            ):
                read[r.pattern].append((r.key, r["size"], r.n))
        above = {p: x for p, x in above.items() if p in ends}
        for p, found in read.items():
            room = ends[p].room
            for key, size, n in sorted(found):
                if size > gap[p]:
                    continue
                if n <= room:
                    room -= n
                else:
                    steps[p].append((above[p], key - 1, gap[p], take))
                    above[p], gap[p] = key, room
            end = ((ends[p].range + 1) << shift[p]) - 1
            steps[p].append((above[p], end, gap[p], take))
            above[p], gap[p] = end, room
        above = {p: x for p, x in above.items() if gap[p] > 0 and x < LAST_KEY}


def selection(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    seed: int = SEED,
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """(pattern, source_size, target, whole, steps): what to take of each pattern, a row each.

    Every document is taken ``whole`` times, and once more if the ``steps`` take it.
    """
    spark = docs.sparkSession
    members = _pattern(docs, source_col)
    key = _key(id_col, text_col, seed)
    sized = settle(
        docs.select(members.alias("members"), F.to_json(members).alias("pattern"), _size(text_col).alias("size"), key.alias("key")),
        "mix-sizes",
    )
    found = (
        sized.groupBy("pattern")
        .agg(F.first("members").alias("members"), F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
        .limit(max_patterns + 1).collect()
    )
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} different sets of sources")
    plan = plan_mix([(r.pattern, r.members, r["size"]) for r in found], weights, share, passes)
    counts = {r.pattern: r.n for r in found}
    whole = {p: divmod(plan.take[p], max(n, 1)) for p, n in plan.size.items()}
    gap = {p: rest for p, (_, rest) in whole.items()}
    steps: dict[str, list] = {p: [] for p in whole}
    placed = sized.filter("size > 0").select("pattern", "size", "key")
    _fill(placed, counts, gap, steps, take=True)

    # What is left is less than any document passed over. The smallest of these is taken, and others
    # are given back for the excess, where that comes nearer to the share.
    open_rows = [(p, steps[p]) for p, n in gap.items() if n > 0]
    if open_rows:
        wanted = F.broadcast(spark.createDataFrame(open_rows, f"pattern string, steps {STEPS}"))
        least = settle(
            placed.join(wanted, "pattern").filter(~_taken()).groupBy("pattern")
            .agg(F.min(F.struct("size", "key")).alias("least")).select("pattern", "least.key"),
            "mix-least",
        )
        over = placed.join(F.broadcast(least), ["pattern", "key"]).groupBy("pattern", "key").agg(F.sum("size").alias("n")).collect()
        excess = {r.pattern: r.n - gap[r.pattern] for r in over}
        tried = {r.pattern: [*steps[r.pattern], (r.key - 1, r.key, LAST_KEY, True)] for r in over}
        _fill(placed, counts, excess, tried, take=False)
        steps |= {p: tried[p] for p in tried if excess[p] < gap[p]}
    return spark.createDataFrame(
        [(p, plan.source_size[m[0]], float(plan.target[m[0]]), whole[p][0], steps[p]) for p, m in plan.members.items()],
        f"pattern string, source_size long, target double, whole long, steps {STEPS}",
    )


def _copies() -> Column:
    return F.when(F.col("size") > 0, F.col("whole") + _taken().cast("long")).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, pattern, size, source_size, target, copies, taken.

    ``source_col`` holds a source or an array of sources; an empty or null array is the
    null source. ``size`` counts the words (ASCII white space between them), ``taken`` is
    ``copies`` times the size. ``source_size`` and ``target`` are those of the document's first
    source. Null and empty texts have size 0 and are never taken. Rows that share id and
    text are taken alike; reruns take the same documents. Other columns are ignored, an
    empty table gives an empty result.
    """
    plan = selection(docs, id_col, text_col, source_col, seed=seed, **options)
    return (
        docs.select(
            F.col(id_col).alias("doc_id"), F.to_json(_pattern(docs, source_col)).alias("pattern"),
            _size(text_col).alias("size"), _key(id_col, text_col, seed).alias("key"),
        )
        .join(F.broadcast(plan), "pattern")
        .select("doc_id", "pattern", "size", "source_size", "target", _copies().alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns and no others."""
    plan = selection(docs, id_col, text_col, source_col, seed=seed, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return (
        docs.select(
            row, F.to_json(_pattern(docs, source_col)).alias("pattern"),
            _size(text_col).alias("size"), _key(id_col, text_col, seed).alias("key"),
        )
        .join(F.broadcast(plan), "pattern").withColumn("copies", _copies()).filter("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
    )


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
