"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so nothing about a component is gathered
in one place; a node with very many neighbours is split by adaptive execution. Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import settle, total


def _state(edges: DataFrame) -> tuple:
    return total(edges, F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges with u > v: (node, minimum of its neighbourhood) pairs, u > v again."""
    around = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settle(around.groupBy("u").agg(F.min("v").alias("m")), "component-minima")
    least = least.withColumn("m", F.least("u", "m"))
    met = around.join(least, "u")
    if small:
        # the neighbours below u, and u itself, all point to the smallest
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        # the neighbours above u point to the smallest
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return settle(out.filter("u > v").distinct(), "component-edges")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` that is not a root itself.

    Self-links and nulls have no effect; an empty list gives an empty result.
    """
    edges = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u > v").distinct(),
        "component-edges",
    )
    before, now = None, _state(edges)
    while now != before:
        edges = _stars(_stars(edges, small=False), small=True)
        before, now = now, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
