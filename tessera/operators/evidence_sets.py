"""Evidence sets: passages scored, seeds ranked, sets judged by what they cover, contradict and repeat.

Profiles are rows of a query and a passage with arrays companies, years,
metrics, filings, sections, and the query's entities as q_<same>.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("companies", "years", "metrics", "filings", "sections")
#: Weights of a passage's score, of a seed's, and of a set's.
PASSAGE = {"retrieval": 0.35, "graph": 0.45, "consistency": 0.20}
SEED = {"relevance": 0.25, "coverage": 0.45, "coherence": 0.20, "conflict": -0.35}
SET = {"relevance": 0.25, "coverage": 0.40, "coherence": 0.20, "redundancy": -0.10, "conflict": -0.35, "size": -0.02}


def coverage(values: dict[str, Column]) -> Column:
    """Mean share of the query's entities that are there, over the kinds the query has."""
    share = [F.size(F.array_intersect(F.col(f"q_{k}"), values[k])) / F.size(f"q_{k}") for k in KINDS]
    parts = F.array_compact(F.array(*[F.when(F.size(f"q_{k}") > 0, s) for k, s in zip(KINDS, share)]))
    return F.when(F.size(parts) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.size(parts))


def conflicts() -> dict[str, Column]:
    """wrong_company, wrong_year, wrong_metric: both sides known, nothing in common."""
    against = lambda k: ((F.size(f"q_{k}") > 0) & (F.size(k) > 0) & ~F.arrays_overlap(f"q_{k}", k)).cast("int")
    return {"wrong_company": against("companies"), "wrong_year": against("years"), "wrong_metric": against("metrics")}


def profile_scores(df: DataFrame) -> DataFrame:
    """``df`` with coverage, conflict (0 to 1) and the three flags."""
    x = df.withColumns(conflicts())
    return x.withColumns({"coverage": coverage({k: F.col(k) for k in KINDS}), "conflict": (F.col("wrong_company") + F.col("wrong_year") + F.col("wrong_metric")) / 3.0})


def passage_scores(df: DataFrame) -> DataFrame:
    """``df`` (with retrieval, graph and ``profile_scores``) with score, min-maxed in a query; all equal: 1."""
    from tessera.operators.retrieval import min_max

    consistency = F.greatest(F.lit(0.0), F.col("coverage") - F.col("conflict"))
    raw = PASSAGE["retrieval"] * F.col("retrieval") + PASSAGE["graph"] * F.col("graph") + PASSAGE["consistency"] * consistency
    return df.withColumn("_raw", F.round(raw, 10)).withColumn("score", min_max(F.col("_raw"), "query_id", 1.0)).drop("_raw")


def connectivity(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, chunk_id, coherence): the share of a query's other candidates that an edge, either way, leads to."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").filter("src != dst").distinct()
    c = candidates.select("query_id", "chunk_id").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    sized = c.withColumn("_n", n)
    met = c.join(both, c["chunk_id"] == both["src"]).select("query_id", "chunk_id", F.col("dst").alias("other"))
    linked = met.join(c.select("query_id", F.col("chunk_id").alias("other")), ["query_id", "other"], "left_semi")
    k = linked.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("_k"))
    out = sized.join(k, ["query_id", "chunk_id"], "left")
    return out.select("query_id", "chunk_id", (F.coalesce("_k", F.lit(0)) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("coherence"))


def seeds(df: DataFrame, most: int) -> DataFrame:
    """The ``most`` best seeds a query by relevance (0.8 score, 0.2 prior), coverage, coherence and conflict; ties to the larger id."""
    relevance = 0.8 * F.col("score") + 0.2 * F.col("prior")
    s = SEED["relevance"] * relevance + SEED["coverage"] * F.col("coverage") + SEED["coherence"] * F.col("coherence") + SEED["conflict"] * F.col("conflict")
    order = Window.partitionBy("query_id").orderBy(F.desc("seed_score"), F.desc("chunk_id"))
    return df.withColumn("seed_score", F.round(s, 8)).withColumn("seed_rank", F.row_number().over(order)).filter(F.col("seed_rank") <= most)


def set_scores(members: DataFrame, edges: DataFrame, largest: int = 5) -> DataFrame:
    """A row a query's set: relevance, coverage, coherence, redundancy, conflict, size penalty, flags and the final score.

    ``members``: query_id, chunk_id, score, prior, the profile's arrays and the
    query's.  Pairs are made inside a set, which has ``largest`` passages at most.
    """
    m = members.withColumns(conflicts())
    merged = m.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("passages"), F.avg(0.8 * F.col("score") + 0.2 * F.col("prior")).alias("relevance"),
        F.avg((F.col("wrong_company") + F.col("wrong_year") + F.col("wrong_metric")) / 3.0).alias("conflict"),
        *[F.max(c).alias(c) for c in ("wrong_company", "wrong_year", "wrong_metric")],
        *[F.array_distinct(F.flatten(F.collect_list(k))).alias(k) for k in KINDS], *[F.first(f"q_{k}").alias(f"q_{k}") for k in KINDS],
    )
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.chunk_id") < F.col("b.chunk_id")))
    some = [(F.size(f"a.{k}") > 0) | (F.size(f"b.{k}") > 0) for k in KINDS]
    same = [F.arrays_overlap(f"a.{k}", f"b.{k}") for k in KINDS]
    total, shared = (reduce(lambda x, y: x + y, [c.cast("int") for c in cs]) for cs in (some, same))
    both = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().withColumn("linked", F.lit(1))
    rows = pairs.select(F.col("a.query_id").alias("query_id"), F.col("a.chunk_id").alias("u"), F.col("b.chunk_id").alias("v"), F.when(total > 0, shared / total).otherwise(0.0).alias("same"))
    rows = rows.join(both, ["u", "v"], "left").groupBy("query_id").agg(F.avg("same").alias("redundancy"), F.avg(F.coalesce("linked", F.lit(0))).alias("coherence"))
    x = merged.join(rows, "query_id", "left").fillna(0.0, ["redundancy", "coherence"])
    x = x.withColumns({"coverage": coverage({k: F.col(k) for k in KINDS}), "size": F.greatest(F.lit(0.0), (F.col("passages") - 3) / F.lit(float(max(largest, 1))))})
    final = reduce(lambda p, q: p + q, [w * F.col(k) for k, w in SET.items()])
    return x.withColumn("final", final).select("query_id", "passages", *SET, "wrong_company", "wrong_year", "wrong_metric", "final")


def set_summary(scored: DataFrame, gold_share: DataFrame) -> DataFrame:
    """One row: means of gold coverage (query_id, share; 0 if missing), entity coverage, any conflict, redundancy."""
    x = scored.join(gold_share, "query_id", "left")
    mean = lambda c: F.round(F.avg(c), 6)
    any_ = F.greatest("wrong_company", "wrong_year", "wrong_metric").cast("double")
    return x.agg(mean(F.coalesce("share", F.lit(0.0))).alias("gold_coverage"), mean("coverage").alias("entity_coverage"), mean(any_).alias("conflict_rate"), mean("redundancy").alias("redundancy_rate"))


def conflict_sets(profiles: DataFrame, base: DataFrame, largest: int = 5) -> DataFrame:
    """Negative sets: query_id, name, ids.  For each conflict the first candidate by rank that has it, before the base set's others.

    ``profiles`` with ``profile_scores`` and rank; ``base``: query_id, ids.
    """
    flags = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("on")) for n in ("wrong_year", "wrong_metric", "wrong_company")])).alias("f")
    x = profiles.select("query_id", "chunk_id", "rank", flags).filter("f.on = 1")
    first = x.groupBy("query_id", F.col("f.name").alias("name")).agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("c"))
    ids = F.concat(F.array("c"), F.slice(F.array_remove(F.slice("ids", 1, largest), F.col("c")), 1, largest - 1))
    out = first.join(base, "query_id").select("query_id", "name", ids.alias("ids"))
    again = base.filter(F.size("ids") > 0).select("query_id", F.lit("redundant").alias("name"), F.slice(F.concat(F.slice("ids", 1, largest), F.slice("ids", 1, 1)), 1, largest).alias("ids"))
    return out.union(again)
