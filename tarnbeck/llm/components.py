"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_since, mark, newest, stash


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over undirected edges (a, b) with a < b: each node hooks its larger
    (large) or its smaller (small) neighbours to the smallest node of its neighbourhood."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        sides = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hooked = sides.join(least, "u")
    if large:
        out = hooked.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = hooked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return out.filter("a < b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a long, b long) to (node, root), root the smallest node reachable; one row for
    each node that has an edge. Edges are kept in tables; only one number a round (a digest of
    the edge set) reaches the driver. A hub's edges are summed before they are shuffled, and
    the join of a hub is one that adaptive execution can split."""
    ordered = edges.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    since = mark()
    now = stash(ordered.distinct(), "edges")
    digest = F.struct(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))"))
    seen = None
    for _ in range(max_rounds):
        now = stash(_stars(_stars(now, large=True), large=False), "edges")
        drop_since(now.sparkSession, since, [newest()])
        found = now.agg(digest.alias("d")).head()[0]
        if found == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen = found
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
