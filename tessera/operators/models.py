"""Forward passes of the graph rerankers, a query's subgraph at a time, in numpy.

Weights are given; nothing is downloaded.  Rows of ``features`` are nodes in
the order of ``names``; adjacency matrices are dense, for candidate subgraphs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def normalized(a: np.ndarray, loops: bool) -> np.ndarray:
    """D^-1/2 (A + I) D^-1/2; rows without edges stay zero."""
    a = a + np.eye(len(a)) if loops else a
    d = a.sum(axis=1)
    s = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-12)), 0)
    return a * s[:, None] * s[None, :]


def gcn(x: np.ndarray, a: np.ndarray, weights: list[np.ndarray], head: np.ndarray) -> np.ndarray:
    """Layers of relu(A X W), then a linear head."""
    a = normalized(a, True)
    for w in weights:
        x = np.maximum(a @ x @ w, 0)
    return x @ head


def rgcn(x: np.ndarray, by_relation: list[np.ndarray], layers: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]], head: np.ndarray) -> np.ndarray:
    """Layers of relu(X W0 + sum of A_r X W_r), the bias added after it; then a linear head."""
    mats = [normalized(a, False) for a in by_relation]
    for own, each, bias in layers:
        x = np.maximum(x @ own + sum((a @ x @ w for a, w in zip(mats, each)), np.zeros((len(x), own.shape[1]))), 0) + bias
    return x @ head


def lite_rgcn(x: np.ndarray, by_relation: list[np.ndarray], layers: list[tuple[np.ndarray, np.ndarray]], head: np.ndarray) -> np.ndarray:
    """As ``rgcn`` with one matrix, and one gate a relation (the first for the node itself)."""
    mats = [normalized(a, False) for a in by_relation]
    for w, gates in layers:
        g = 1 / (1 + np.exp(-gates))
        h = x @ w
        x = np.maximum(g[0] * h + sum((gr * (a @ h) for gr, a in zip(g[1:], mats)), np.zeros_like(h)), 0)
    return x @ head


def gatv2(x: np.ndarray, a: np.ndarray, left: np.ndarray, right: np.ndarray, attention: np.ndarray, slope: float = 0.2) -> np.ndarray:
    """One head of dynamic attention over neighbours and the node itself; residual, layer norm, ELU."""
    l, r = x @ left, x @ right
    z = l[:, None, :] + r[None, :, :]
    e = np.where(z > 0, z, slope * z) @ attention
    e = np.where((a > 0) | np.eye(len(a), dtype=bool), e, -np.inf)
    p = np.exp(e - e.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    h = p @ r
    if h.shape == x.shape:
        h = h + x
    h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
    return np.where(h > 0, h, np.expm1(np.minimum(h, 0)))


def dual_channel(x: np.ndarray, structural: np.ndarray, semantic: np.ndarray, ws: np.ndarray, wm: np.ndarray, gate: np.ndarray, query_type: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Structural and semantic messages, mixed by a softmax over what the query's type asks for."""
    g = np.exp(query_type @ gate - (query_type @ gate).max())
    g /= g.sum()
    s = np.maximum(normalized(structural, True) @ x @ ws, 0)
    m = np.maximum(normalized(semantic, True) @ x @ wm, 0)
    return (g[0] * s + g[1] * m) @ head


def bounded_support(base: np.ndarray, support: np.ndarray, conflict: np.ndarray, rank_norm: np.ndarray, scales: tuple[float, float, float], most: tuple[float, float, float]) -> np.ndarray:
    """base + s support - c conflict + x rank, each scale a sigmoid up to its bound."""
    s, c, x = (m / (1 + np.exp(-v)) for v, m in zip(scales, most))
    return base + s * support - c * conflict + x * rank_norm


def sparse_experts(base: np.ndarray, scores: np.ndarray, logits: np.ndarray, confidence: np.ndarray, k: int = 2, tau: float = 0.15) -> np.ndarray:
    """base + tau confidence tanh(sum of the k best routed experts' weights times their scores)."""
    keep = np.argsort(-logits, kind="stable")[:k]
    w = np.exp(logits[keep] - logits[keep].max())
    w /= w.sum()
    return base + tau * confidence * np.tanh(scores[:, keep] @ w)


def score_subgraphs(nodes: DataFrame, edges: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], query: str = "query_id") -> DataFrame:
    """(query, node_id, score): ``score(features, adjacency)`` of each query's subgraph.

    ``nodes``: query, node_id, features; ``edges``: query, src, dst, weight.  A
    query's candidates and their neighbours fit in one task by their nature.
    """

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({query: [], "node_id": [], "score": []})
        names = pd.Index(n["node_id"])
        a = np.zeros((len(names), len(names)))
        i, j = names.get_indexer(e["src"]), names.get_indexer(e["dst"])
        ok = (i >= 0) & (j >= 0)
        np.maximum.at(a, (i[ok], j[ok]), e["weight"].to_numpy(float)[ok])
        a = np.maximum(a, a.T)
        return pd.DataFrame({query: key[0], "node_id": n["node_id"], "score": score(np.stack(n["features"].to_numpy()).astype(float), a)})

    kind = dict(nodes.dtypes)[query]
    other = edges.withColumnRenamed(query, "_q")
    return nodes.groupBy(query).cogroup(other.groupBy("_q")).applyInPandas(run, f"{query} {kind}, node_id string, score double")
