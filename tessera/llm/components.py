"""Connected components of a graph that is far larger than any one machine: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first())


def _star(directed: DataFrame, larger: bool, rows: int) -> DataFrame:
    """Each node u links its neighbours (the larger ones, or the smaller ones and itself) to the least node next to it. `rows`: how
    many edges there are about. The edges as a stored table."""
    # stored by itself, the table of least neighbours leaves the join below two shuffles of its own, whose large keys (a node
    # of very many edges) Spark may split
    least = stored(directed.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least", rows)
    linked = directed.join(least, F.col("a") == F.col("u"))
    if larger:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u"), "m"))
    edges = stored(out.where("a <> b").distinct(), "edges", rows)
    drop_stored(least)
    return edges


def connected_components(edges: DataFrame, most_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """node, root: for each node of edges (a, b; any comparable type, no nulls) the least node that it is linked to.

    rows: about how many edges there are at most, if known. Loops and repeated edges do no harm; without edges the result is
    empty. Each round's edges are written to the shared folder and the ones before deleted; the rounds grow with the logarithm of the longest chain. A node of very many edges
    meets only sums with partial aggregation and joins whose large keys Spark may split.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    state = _state(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True, 2 * state[0])
        drop_stored(now)
        # large-star leaves edges from larger to smaller nodes only
        now = _star(large, False, 2 * state[0])
        drop_stored(large)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
