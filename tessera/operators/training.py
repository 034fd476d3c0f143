"""Training rows for rerankers: pairs, hard negatives, splits; and a pairwise linear ranker."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def train_pairs(judged: DataFrame, query: str, doc: str, negatives: int = 5) -> DataFrame:
    """(query, positive, negative): the best ranked gold against the first ``negatives`` others."""
    order = Window.partitionBy(query, "is_gold").orderBy("rank", doc)
    x = judged.withColumn("_n", F.row_number().over(order))
    pos = x.filter((F.col("is_gold") == 1) & (F.col("_n") == 1)).select(query, F.col(doc).alias("positive"))
    neg = x.filter((F.col("is_gold") == 0) & (F.col("_n") <= negatives)).select(query, F.col(doc).alias("negative"))
    return pos.join(neg, query)


def hard_negatives(rows: DataFrame, query: str, doc: str, each: int) -> DataFrame:
    """Up to ``each`` negatives of each bucket: same metric in another year, same year with another metric,
    same section, the rest; the first that applies.  Within a bucket in order of a hash of both ids."""
    bucket = (
        F.when((F.col("metric_same") == 1) & (F.col("year_same") == 0), "wrong_year")
        .when((F.col("year_same") == 1) & (F.col("metric_same") == 0), "wrong_metric")
        .when(F.col("section_same") == 1, "same_section")
        .otherwise("other")
    )
    order = Window.partitionBy(query, "bucket").orderBy(F.md5(F.concat_ws("|", F.col(query).cast("string"), F.col(doc).cast("string"))))
    x = rows.withColumn("bucket", bucket)
    return x.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).select(query, doc, "bucket")


def strategy_negatives(rows: DataFrame, query: str, doc: str, total: int = 10) -> DataFrame:
    """Negatives by strategy: a quarter of ``total`` of each, at least one, in order of a hash of both ids.

    Unlike ``hard_negatives``, a row of the same section is also one of its own
    strategy; what no strategy takes is "random_fallback".
    """
    metric, year, section = (F.col(c) == 1 for c in ("metric_same", "year_same", "section_same"))
    each = F.array_compact(F.array(
        F.when(metric & ~year, "same_metric_wrong_year"), F.when(year & ~metric, "same_year_wrong_metric"), F.when(section, "same_section"),
        F.when(~section & (metric == year), "random_fallback"),
    ))
    order = Window.partitionBy(query, "strategy").orderBy(F.md5(F.concat_ws("|", F.col(query).cast("string"), F.col(doc).cast("string"))))
    x = rows.select(query, doc, F.explode(each).alias("strategy")).withColumn("_n", F.row_number().over(order))
    return x.filter(F.col("_n") <= max(1, total // 4)).drop("_n")


def margin_loss(positive: Column, negative: Column, conflicts: list[Column], scales: tuple[float, ...] = (), penalty: float = 0.001) -> Column:
    """Mean softplus of negative less positive score, a half more for each conflict of the negative; plus the squares of scales."""
    weight = sum((0.5 * c for c in conflicts), F.lit(1.0))
    x = negative - positive
    soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return F.coalesce(F.avg(weight * soft), F.lit(0.0)) + F.lit(penalty * sum(s * s for s in scales))


def first_scores(ranked: DataFrame, query: str, doc: str, queries: int = 5) -> DataFrame:
    """(doc, score): the score that the first of the first ``queries`` queries, by id, gives each document."""
    few = ranked.select(query).distinct().orderBy(query).limit(queries)
    x = ranked.join(F.broadcast(few), query, "left_semi")
    return x.groupBy(doc).agg(F.min_by("score", F.struct(query, "rank")).alias("score"))


def sampled_queries(queries: DataFrame, key: str, most: int, first: bool = False, seed: int = 42) -> DataFrame:
    """At most ``most`` queries: the first by id, or a sample without replacement in order of a hash."""
    order = F.col(key) if first else F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return queries.orderBy(order, key).limit(most)


def split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with is_validation, by a hash of the key: stable when rows are added."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000))
    return df.withColumn("is_validation", h < int(share * 1_000_000))


def fit_pairwise(positive: np.ndarray, negative: np.ndarray, margin: float = 0.5, epochs: int = 50, rate: float = 0.05, penalty: float = 1e-4) -> np.ndarray:
    """Weights w that rank positives over negatives by a margin: hinge loss, full gradients, Adam."""
    d = positive - negative
    w, m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1]), np.zeros(d.shape[1])
    for t in range(1, epochs + 1):
        short = (d @ w < margin).astype(float)
        g = -(short @ d) / max(1, len(d)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
