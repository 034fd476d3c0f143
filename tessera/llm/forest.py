"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then put into one
leaf of each tree.  A query walks all trees with one shared priority queue,
nearest splits first, until the leaves it has visited hold enough vectors.  The
vectors in these leaves are compared exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


@dataclass
class Tree:
    """Splits in breadth order: a vector goes right if its product with the normal is over the offset."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray  # child node, or -1 - leaf
    right: np.ndarray


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """Split ``x`` at the median of a direction between two random points until ``leaf`` are left."""
    normals, offsets, left, right, leaves = [], [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                n = a - b
                size = np.linalg.norm(n)
                if size > 0:
                    n = n / size
                    p = x[rows] @ n
                    cut = float(np.median(p))
                    up = p > cut
                    if 0 < up.sum() < len(rows):
                        me = len(normals)
                        normals.append(n)
                        offsets.append(cut)
                        left.append(0)
                        right.append(0)
                        left[me] = grow(rows[~up])
                        right[me] = grow(rows[up])
                        return me
        leaves += 1
        return -leaves

    top = grow(np.arange(len(x)))
    if top < 0:  # a single leaf: one split that sends all to it
        return Tree(np.zeros((1, x.shape[1])), np.zeros(1), np.array([-1]), np.array([-1]))
    return Tree(np.array(normals), np.array(offsets), np.array(left), np.array(right))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row of ``x``."""
    at = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        node = at[live]
        up = np.einsum("ij,ij->i", x[live], tree.normals[node]) > tree.offsets[node]
        at[live] = np.where(up, tree.right[node], tree.left[node])
        live = live[at[live] >= 0]
    return -1 - at


def visit(trees: list[Tree], held: list[np.ndarray], q: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees until they hold ``enough`` vectors.

    ``held``: vectors in each leaf of each tree.  The priority of a branch is
    the smallest margin on its way, as in the forests this follows.
    """
    queue = [(-np.inf, t, 0) for t in range(len(trees))]
    out, have = [], 0
    while queue and have < enough:
        bound, t, node = heapq.heappop(queue)
        if node < 0:
            leaf = -1 - node
            out.append((t, leaf))
            have += held[t][leaf]
            continue
        tree = trees[t]
        margin = float(q @ tree.normals[node]) - tree.offsets[node]
        near, far = (tree.right, tree.left) if margin > 0 else (tree.left, tree.right)
        heapq.heappush(queue, (bound, t, int(near[node])))
        heapq.heappush(queue, (max(bound, abs(margin)), t, int(far[node])))
    return out


def usable(v, size: int):
    """Whether a vector takes part: of the given size, all finite, not zero."""
    ok = v.isNotNull() & (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def search_share(
    forest: list[Tree], x: np.ndarray, k: int, target: float, probes: int, rng: np.random.Generator
) -> float:
    """How many vectors a search has to visit, as a multiple of all, for a recall of ``target``.

    Measured against brute force on ``probes`` vectors of the sample, within
    the sample; a vector in several trees' leaves counts each time.
    """
    if len(x) <= k + 1:
        return float(len(forest))
    leaves = [leaf_of(t, x) for t in forest]
    held = [np.bincount(lf, minlength=len(t.offsets) + 2) for lf, t in zip(leaves, forest)]
    chosen = rng.choice(len(x), min(probes, len(x)), replace=False)
    true = []
    for q in chosen:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        true.append(np.argpartition(d, k)[:k])
    share = 1 / 64
    while share < len(forest):
        found = 0
        for q, want in zip(chosen, true):
            seen = set(visit(forest, held, x[q], int(share * len(x)) + 1))
            found += sum(any((t, int(lf[w])) in seen for t, lf in enumerate(leaves)) for w in want)
        if found >= target * k * len(chosen):
            return share
        share *= 1.5
    return float(len(forest))


def nearest(
    df: DataFrame,
    queries: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    trees: int = 12,
    sample: int = 50_000,
    leaf: int = 512,
    target: float = 0.96,
    probes: int = 200,
    chunk: int = 8_192,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` nearest rows found for every row of ``queries``: query_id, rank, vec_id, score.

    Euclidean distance in double precision; a query's own row is no candidate;
    ties go to the smaller id.  Vectors that are null, zero, hold null or
    non-finite components, or differ in size from most take no part, and
    neither do rows with a null id.  No usable row: no result.

    ``sample`` bounds the vectors the trees are fitted on, taken by a hash;
    all vectors are put in leaves.  How far a search goes is set so that
    ``probes`` vectors of the sample find ``target`` of their true neighbours.
    Equal vectors are one entry of the index, with their ``k + 1`` smallest
    ids: as ties go to smaller ids, no other can be among the k nearest.  A
    leaf meets the queries that visit it in chunks of about ``chunk`` vectors,
    each of which hands on its k nearest entries for each query.
    """
    spark = df.sparkSession
    kind = df.schema[vec_id].dataType.simpleString()
    part = df.schema[vector].dataType.elementType.simpleString()
    schema = f"query_id {kind}, rank int, vec_id {kind}, score double"
    sizes = df.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("c"))
    most = sizes.orderBy(F.desc("c"), "n").first()
    if most is None:
        return spark.createDataFrame([], schema)

    def good(t: DataFrame) -> DataFrame:
        """Usable rows; -0.0 counts as 0.0."""
        v = F.transform(vector, lambda x: x + F.lit(0).cast(part))
        ok = usable(F.col(vector), most["n"]) & F.col(vec_id).isNotNull()
        return t.filter(ok).select(F.col(vec_id).alias("id"), v.alias("v"))

    points = durable(_points(good(df), k + 1))
    total = points.count()
    if not total:
        return spark.createDataFrame([], schema)
    some = points
    if total > sample:
        some = points.filter(F.pmod(F.xxhash64("p"), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    x = np.array([r["v"] for r in some.select("v").toLocalIterator()], np.float64).reshape(-1, most["n"])
    rng = np.random.default_rng(seed)
    forest = [fit_tree(x, max(1, leaf * len(x) // total), rng) for _ in range(trees)]
    enough = int(search_share(forest, x, k, target, probes, rng) * total) + 1
    shared = spark.sparkContext.broadcast(forest)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = np.stack(b["v"].to_numpy()).astype(np.float64)
                for t, tree in enumerate(shared.value):
                    yield pd.DataFrame({"t": t, "leaf": leaf_of(tree, m), "p": b["p"].to_numpy(), "v": b["v"], "ids": b["ids"]})

    index = points.mapInPandas(put, f"t int, leaf long, p long, v array<{part}>, ids array<{kind}>")
    # the leaves are bounded by the sample
    counts = index.groupBy("t", "leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    held = [np.zeros(len(tree.offsets) + 2, np.int64) for tree in forest]
    for r in counts:
        held[r["t"]][r["leaf"]] = r["n"]
    holds = spark.sparkContext.broadcast(held)

    def chunks(t: int, lf: int) -> int:
        return max(1, -(-int(holds.value[t][lf]) // chunk))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in put(batches):
            n = np.maximum(1, -(-holds.value[int(b["t"].iloc[0])] // chunk))
            yield b.assign(c=b["p"].to_numpy() % n[b["leaf"].to_numpy()]).drop(columns="p")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, w in zip(b["id"], b["v"]):
                seen = visit(shared.value, holds.value, np.asarray(w, np.float64), enough)
                rows = [(t, lf, c) for t, lf in seen for c in range(chunks(t, lf))]
                out = pd.DataFrame(rows, columns=["t", "leaf", "c"])
                yield out.assign(q=q, w=[w] * len(out))

    def rerank(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The nearest entries of a chunk for each query that visits it."""
        q, ids, score = [], [], []
        if len(points) and len(asked):
            m = np.stack(points["v"].to_numpy()).astype(np.float64)
            for name, w in zip(asked["q"], asked["w"]):
                d = m - np.asarray(w, np.float64)
                d = np.sqrt((d * d).sum(axis=1))
                near = np.nonzero(d <= np.partition(d, k)[k])[0] if len(d) > k + 1 else np.arange(len(d))
                q += [name] * len(near)
                ids += [points["ids"].iloc[i].tolist() for i in near]
                score += d[near].tolist()
        return pd.DataFrame({"q": q, "ids": pd.Series(ids, dtype=object), "score": np.array(score, np.float64)})

    dealt = points.mapInPandas(deal, f"t int, leaf long, v array<{part}>, ids array<{kind}>, c long")
    visits = good(queries).mapInPandas(walk, f"t int, leaf long, c long, q {kind}, w array<{part}>")
    keys = ["t", "leaf", "c"]
    met = dealt.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(rerank, f"q {kind}, ids array<{kind}>, score double")
    flat = met.select("q", "score", F.explode("ids").alias("id")).filter(F.col("id") != F.col("q")).distinct()
    order = Window.partitionBy("q").orderBy("score", "id")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _points(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors, each with its ``most`` smallest ids and a number p.

    The ids are cut in two steps, the first in 64 parts, so no task gathers all
    ids of a vector.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    first = Window.partitionBy("h", "v", "part").orderBy("id")
    second = Window.partitionBy("h", "v").orderBy("id")
    x = rows.distinct().withColumn("h", F.xxhash64("v")).withColumn("part", part)
    x = x.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    x = x.withColumn("n", F.row_number().over(second)).filter(F.col("n") <= most)
    grouped = x.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select("v", "ids", F.xxhash64("h", F.element_at("ids", 1)).alias("p"))
