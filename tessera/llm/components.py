"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, settled


def _two(df: DataFrame, first: tuple, second: tuple, names: tuple[str, str]) -> DataFrame:
    """Two rows for each row of ``df``."""
    rows = F.array(*[F.struct(*[x.alias(n) for x, n in zip(pair, names)]) for pair in (first, second)])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (or itself)."""
    u, v = F.col("u"), F.col("v")
    both = _two(e, (u, v), (v, u), ("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = _two(down.join(least, "u"), (F.col("v"), F.col("m")), (F.col("u"), F.col("m")), ("u", "v"))
    return joined.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root being the smallest node of its component.

    Large-star and small-star steps (Kiveris et al., 2014) in turn until
    nothing changes; each keeps its edges in the shared folder, so a lost
    executor costs one step.  Edges never outgrow the input.  Loops and
    repeated edges do no harm.  A node without an edge to another isn't listed.
    """
    return settled(edges.sparkSession, lambda: _contracted(edges))


def _contracted(edges: DataFrame) -> DataFrame:
    e = durable(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = _mark(e)
    while True:
        e = durable(_small_star(_large_star(e)))
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return _two(e, (F.col("u"), F.col("v")), (F.col("v"), F.col("v")), ("node", "root")).distinct()


def _mark(e: DataFrame) -> tuple:
    """Tells one edge set from another: the number of edges and the sum of their hashes."""
    h = F.xxhash64("u", "v")
    r = e.agg(
        F.count(F.lit(1)),
        F.sum(h.cast("decimal(20,0)")),
    ).first()
    return tuple(r)
