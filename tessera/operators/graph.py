"""The evidence graph as node and edge tables, and what is computed on it.

Nodes are (node_id, node_type), edges (src, dst, edge_type, weight), directed,
parallel ones allowed.  Ids carry their type as a prefix, ``type::value``, but
for chunks, whose ids are as they are.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.durable import durable

#: Default weights of the kinds of edges.
WEIGHTS = {
    "chunk-mentions-metric": 0.8,
    "chunk-mentions-year": 0.8,
    "company-has-filing": 0.7,
    "filing-has-section": 0.6,
    "section-has-chunk": 0.6,
    "chunk-belongs-to-filing": 0.5,
    "same-company": 0.5,
    "same-year": 0.5,
    "same-metric": 0.5,
    "semantic-similar": 0.3,
}
#: Names, or parts of them, of relations in the semantic channel.
SEMANTIC_HINTS = (
    "semantic-similar", "same-company", "same-year", "same-metric", "same-section", "same-filing-year", "near-duplicate", "duplicate", "similar",
)


def _node(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), F.concat_ws("|", *parts))


def _ids() -> dict[str, Column]:
    company = F.when(F.coalesce(F.col("company"), F.lit("")) == "", "unknown").otherwise(F.col("company"))
    return {
        "chunk": F.col("chunk_id"),
        "company": _node("company", F.col("company")),
        "filing": _node("filing", company, F.col("filing_type"), F.col("filing_year")),
        "section": _node("section", F.col("section")),
        "metric": _node("metric", F.col("metric")),
        "year": _node("year", F.col("filing_year")),
    }


def build_nodes(chunks: DataFrame) -> DataFrame:
    """Distinct nodes of ``chunks`` (chunk_id, company, filing_type, filing_year, section, metric)."""
    both = F.array(*[F.struct(v.alias("node_id"), F.lit(k).alias("node_type")) for k, v in _ids().items()])
    return chunks.select(F.explode(both).alias("n")).select("n.*").filter(F.col("node_id").isNotNull()).distinct()


def build_edges(chunks: DataFrame, use_weights: bool = True) -> DataFrame:
    """Edges of ``chunks``.  Those between two entities are kept once, all others a chunk each."""
    i = _ids()
    kinds = [
        ("chunk-mentions-metric", "chunk", "metric"),
        ("chunk-mentions-year", "chunk", "year"),
        ("section-has-chunk", "section", "chunk"),
        ("chunk-belongs-to-filing", "chunk", "filing"),
        ("company-has-filing", "company", "filing"),
        ("filing-has-section", "filing", "section"),
    ]
    rows = lambda some: F.array(*[F.struct(i[a].alias("src"), i[b].alias("dst"), F.lit(t).alias("edge_type")) for t, a, b in some])
    # a chunk's edges are distinct as its id is; only the others are made so
    own = chunks.select(F.explode(rows(kinds[:4])).alias("e")).select("e.*")
    shared = chunks.select(F.explode(rows(kinds[4:])).alias("e")).select("e.*").distinct()
    return weighted(own.union(shared), use_weights)


def weighted(edges: DataFrame, use_weights: bool = True) -> DataFrame:
    w = F.lit(1.0)
    if use_weights:
        for kind, value in WEIGHTS.items():
            w = F.when(F.col("edge_type") == kind, F.lit(value)).otherwise(w)
    return edges.select("src", "dst", "edge_type", w.alias("weight"))


def same_edges(chunks: DataFrame, value: str, edge_type: str, order: str = "chunk_id", bridges: int = 0) -> DataFrame:
    """Each chunk linked to the next one and the one after with the same value.

    With ``bridges``, values of more than three chunks also get up to that many
    links between places that a hash of the value and the place names, the
    same on every run.
    """
    w = Window.partitionBy(value).orderBy(order)
    x = chunks.filter(F.col(value).isNotNull()).select(
        value, F.col("chunk_id").alias("src"), F.lead("chunk_id", 1).over(w).alias("n1"), F.lead("chunk_id", 2).over(w).alias("n2"),
        F.row_number().over(w).alias("i"),
    )
    near = x.select("src", F.explode(F.array_compact(F.array("n1", "n2"))).alias("dst"))
    if bridges:
        n = x.groupBy(value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 3)
        k = F.least(F.lit(bridges), F.floor(F.col("n") / 2).cast("int"))
        ends = n.select(value, "n", F.explode(F.sequence(F.lit(1), k)).alias("b")).select(
            value, (F.pmod(F.xxhash64(value, "b"), F.col("n")) + 1).cast("int").alias("i"), (F.pmod(F.xxhash64("b", value), F.col("n")) + 1).cast("int").alias("j")
        )
        named = x.select(value, "i", "src")
        far = ends.filter(F.col("i") != F.col("j")).join(named, [value, "i"]).join(
            named.select(value, F.col("i").alias("j"), F.col("src").alias("dst")), [value, "j"]
        )
        near = near.union(far.select("src", "dst"))
    return weighted(near.withColumn("edge_type", F.lit(edge_type)))


def bidirectional(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): both directions of every pair, the largest weight of either."""
    both = edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree, log_degree): edges in and out, parallel ones each."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")).withColumn("log_degree", F.log1p(F.col("degree").cast("double")))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node_id): what can be reached over out-edges in at most ``hops`` steps, the seed included."""
    step = edges.select("src", "dst").distinct()
    reached = seeds.select(F.col("node_id").alias("seed"), "node_id").distinct()
    front = reached
    for _ in range(hops):
        front = front.join(step, front["node_id"] == step["src"]).select("seed", F.col("dst").alias("node_id")).distinct()
        reached = reached.union(front).distinct()
    return reached


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``nodes`` (node_id)."""
    n = nodes.select("node_id").distinct()
    a = edges.join(n.withColumnRenamed("node_id", "_s"), F.col("src") == F.col("_s"), "left_semi")
    return a.join(n.withColumnRenamed("node_id", "_d"), F.col("dst") == F.col("_d"), "left_semi")


def subgraph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, edge_type, weight) among ``nodes``: an edge for each unordered pair and type, smaller end first.

    Of parallel edges and of both directions the one from the smaller end gives the weight, the largest of these.
    """
    x = induced(edges, nodes)
    forward = (F.col("src") <= F.col("dst")).cast("int")
    one = x.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "edge_type").agg(F.max(F.struct(forward.alias("f"), "weight")).alias("w"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge_type", "w.weight")


def normalized_adjacency(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """(src, dst, value): D^-1/2 A D^-1/2 of the bidirectional graph, with loops of weight 1 if asked."""
    a = bidirectional(edges)
    if self_loops:
        a = a.union(a.select("src", F.col("src").alias("dst"), F.lit(1.0)).distinct())
    d = a.groupBy("src").agg(F.sum("weight").alias("_d"))
    left = a.join(d, "src").withColumnRenamed("_d", "_ds")
    both = left.join(d.select(F.col("src").alias("dst"), F.col("_d").alias("_dd")), "dst")
    return both.select("src", "dst", (F.col("weight") / (F.sqrt("_ds") * F.sqrt("_dd"))).alias("value"))


def channel(edge_type: Column) -> Column:
    """"structural" or "semantic" by hints in the name; unknown kinds are structural."""
    semantic = F.exists(F.array(*map(F.lit, SEMANTIC_HINTS)), lambda h: F.contains(F.lower(edge_type), h))
    return F.when(semantic, "semantic").otherwise("structural")


def channel_adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, channel, edge_type, src, dst, value): each query's normalised matrices, both directions.

    ``nodes``: query_id, node_id, factor, which conflicts of a passage with the
    query take off (``support.semantic_factor``; null for other nodes).  The
    weight of a semantic edge is multiplied by both ends' factors, at least
    0.05 together; of parallel edges the largest weight counts, and each kind
    is divided by the roots of both ends' sums.
    """
    def end(name: str) -> DataFrame:
        return nodes.groupBy("query_id", F.col("node_id").alias(name)).agg(F.min(F.coalesce("factor", F.lit(1.0))).alias(f"_f{name}"))

    x = edges.join(end("src"), "src").join(end("dst"), ["query_id", "dst"]).withColumn("channel", channel(F.col("edge_type")))
    off = F.greatest(F.col("_fsrc") * F.col("_fdst"), F.lit(0.05))
    w = F.col("weight") * F.when(F.col("channel") == "semantic", off).otherwise(1.0)
    key = ["query_id", "channel", "edge_type"]
    one = x.select(*key, F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"), w.alias("w"))
    a = one.groupBy(*key, "e.src", "e.dst").agg(F.max("w").alias("w"))
    d = a.groupBy(*key, "src").agg((F.sum("w") + 1e-8).alias("_d"))
    both = a.join(d.withColumnRenamed("_d", "_ds"), [*key, "src"]).join(d.withColumnsRenamed({"src": "dst", "_d": "_dd"}), [*key, "dst"])
    return both.select(*key, "src", "dst", (F.col("w") / (F.sqrt("_ds") * F.sqrt("_dd"))).alias("value"))


def pagerank(edges: DataFrame, seeds: DataFrame, iterations: int = 20, alpha: float = 0.85, every: int = 5) -> DataFrame:
    """Personalised PageRank of all nodes for every query: query_id, node_id, score.

    ``edges`` (src, dst, weight) are used as given; ``seeds`` (query_id, node_id)
    share a query's restart equally, and get what nodes without out-edges hold.
    A set-at-a-time loop over tables, kept every few steps.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_o"))
    p = durable(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_o")).alias("p")))
    n = Window.partitionBy("query_id")
    start = durable(seeds.distinct().select("query_id", "node_id", (1.0 / F.count(F.lit(1)).over(n)).alias("r")))
    score = start.select("query_id", "node_id", F.col("r").alias("score"))
    sources = p.select(F.col("src").alias("node_id")).distinct()
    for i in range(iterations):
        moved = score.join(p, score["node_id"] == p["src"]).groupBy("query_id", "dst").agg((alpha * F.sum(F.col("score") * F.col("p"))).alias("m"))
        lost = score.join(sources, "node_id", "left_anti").groupBy("query_id").agg(F.sum("score").alias("lost"))
        back = start.join(lost, "query_id", "left").select(
            "query_id", F.col("node_id").alias("dst"), (F.col("r") * (1 - alpha + alpha * F.coalesce("lost", F.lit(0.0)))).alias("m")
        )
        score = moved.union(back).groupBy("query_id", F.col("dst").alias("node_id")).agg(F.sum("m").alias("score"))
        if (i + 1) % every == 0 or i + 1 == iterations:
            score = durable(score)
    return score


def candidate_subgraphs(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, src, dst, weight): for each query the edges within its ``members`` (query_id, node_id) and their neighbours, either way.

    One row an ordered pair, the largest weight; joins on nodes, so only edges at a member's neighbours are copied.
    """
    both = durable(bidirectional(edges))
    m = members.select("query_id", "node_id").distinct()
    near = m.join(both, m["node_id"] == both["src"]).select("query_id", F.col("dst").alias("node_id"))
    nodes = durable(m.union(near).distinct())
    out = nodes.join(both, nodes["node_id"] == both["src"]).select("query_id", "src", "dst", "weight")
    return out.join(nodes.select("query_id", F.col("node_id").alias("dst")), ["query_id", "dst"], "left_semi").select("query_id", "src", "dst", "weight")


def pagerank_converged(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """The same until the change falls under ``tolerance``, a query's own subgraph in one task.

    ``edges`` (query_id, src, dst, weight) hold each query's subgraph: for
    candidate sets, not for whole graphs.
    """

    def rank(key: tuple, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(pd.unique(pd.concat([e["src"], e["dst"], s["node_id"]])))
        n = len(names)
        if n == 0:
            return pd.DataFrame({"query_id": [], "node_id": [], "score": []})
        i, j, w = names.get_indexer(e["src"]), names.get_indexer(e["dst"]), e["weight"].to_numpy(float)
        out = np.bincount(i, w, n)
        restart = np.zeros(n)
        restart[names.get_indexer(s["node_id"].unique())] = 1
        restart = restart / restart.sum() if restart.sum() else np.full(n, 1 / n)
        r = restart.copy()
        for _ in range(most):
            new = alpha * (np.bincount(j, r[i] * w / np.maximum(out[i], 1e-300), n) + restart * r[out == 0].sum()) + (1 - alpha) * restart
            done = np.abs(new - r).sum() < n * tolerance
            r = new
            if done:
                break
        return pd.DataFrame({"query_id": key[0], "node_id": names, "score": r})

    kind = dict(edges.dtypes)["query_id"]
    grouped = edges.groupBy("query_id").cogroup(seeds.select(F.col("query_id").alias("_q"), "node_id").groupBy("_q"))
    return grouped.applyInPandas(rank, f"query_id {kind}, node_id string, score double")


def knn_edges(vectors: DataFrame, key: str, vector: str, m: int, least: float, block: int = 32_768) -> DataFrame:
    """Each vector's ``m`` nearest by cosine that reach ``least``, itself excluded: src, dst, similarity.

    Vectors are cut into blocks of rows; every pair of blocks meets in one
    task, which multiplies pieces of it and hands on m rows a vector, so pairs
    of vectors are never rows.  A vector is copied once a block: with all pairs
    compared, time and what is shuffled grow with the square, memory doesn't.
    """
    from tessera.operators.retrieval import CELLS, best_cells, top_k

    n = max(1, -(-vectors.count() // block))
    part = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    side = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), part.alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = side.select(F.col("k").alias("ak"), F.col("v").alias("av"), F.col("b").alias("ab"), every.alias("ao"))
    right = side.select(F.col("k").alias("ck"), F.col("v").alias("cv"), every.alias("cb"), F.col("b").alias("co"))

    def near(key_: tuple, a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"src": [], "dst": [], "score": []})
        x, y = (np.stack(v.to_numpy()).astype(np.float64) for v in (a["av"], c["cv"]))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        names, order = c["ck"].to_numpy(), np.argsort(np.argsort(c["ck"].to_numpy(), kind="stable"), kind="stable")
        step = max(1, CELLS // len(c))
        found = []
        for i in range(0, len(a), step):
            own, s = a["ak"].to_numpy()[i : i + step], x[i : i + step] @ y.T
            if a["ab"].iloc[0] == c["cb"].iloc[0]:
                s[own[:, None] == names[None, :]] = -np.inf
            rows, cols = best_cells(s, order, m)
            got = s[rows, cols]
            ok = got >= least
            found.append(pd.DataFrame({"src": own[rows[ok]], "dst": names[cols[ok]], "score": got[ok]}))
        return pd.concat(found)

    kind = dict(vectors.dtypes)[key]
    met = left.groupBy("ab", "ao").cogroup(right.groupBy("cb", "co")).applyInPandas(near, f"src {kind}, dst {kind}, score double")
    return top_k(met, "src", "dst", m).select("src", "dst", F.col("score").alias("similarity"))


def to_arrays(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense numbers for nodes, in order of their ids, and edges by number: for libraries that take index arrays.

    Nodes are sorted in ranges and kept; a node's number is its place in its
    partition and what the partitions before hold, one row a partition.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    x = durable(nodes.select("node_id").sort("node_id")).select("node_id", F.spark_partition_id().alias("p"), place.alias("o"))
    held = x.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = held.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("b"))
    ids = x.join(F.broadcast(before), "p").select("node_id", (F.col("b") + F.col("o")).alias("i"))
    by = edges.join(ids.withColumnsRenamed({"node_id": "src", "i": "si"}), "src").join(ids.withColumnsRenamed({"node_id": "dst", "i": "di"}), "dst")
    return ids, by.select("edge_type", "si", "di", "weight")


