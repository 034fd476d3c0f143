"""Reranking by features and rules: matches, conflicts, fusion, paths, evidence sets.

Candidates are rows of a query and a chunk with the entities of both as arrays
(q_companies, q_years, q_metrics; companies, years, metrics).  An empty side is
neither a match nor a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.durable import broadcast_if_small, durable

KINDS = ("company", "year", "metric")
PLURAL = {"company": "companies", "year": "years", "metric": "metrics"}
#: Weights of the constraint score, of the four fused signals, and of the path rules.
CONSTRAINT = {"company": 1.0, "year": 1.0, "metric": 0.8}
FUSION = {"retrieval": 0.3, "graph": 0.3, "model": 0.3, "constraint": 0.1}
PATH_SUPPORT = {"coverage": 0.40, "company": 0.15, "year": 0.15, "metric": 0.15, "semantic": 0.10}
PATH_CONFLICT = {"company": 0.30, "year": 0.30, "metric": 0.30}


def match_features(df: DataFrame) -> DataFrame:
    """``df`` with <kind>_match and <kind>_conflict, 0 or 1."""
    out = {}
    for k in KINDS:
        q, c = F.col(f"q_{PLURAL[k]}"), F.col(PLURAL[k])
        known = (F.size(q) > 0) & (F.size(c) > 0)
        out[f"{k}_match"] = F.when(known & F.arrays_overlap(q, c), 1).otherwise(0)
        out[f"{k}_conflict"] = F.when(known & ~F.arrays_overlap(q, c), 1).otherwise(0)
    return df.withColumns(out)


def constraint_score(df: DataFrame, query: str = "query_id") -> DataFrame:
    """Weighted matches, over the largest of the query's if that is over 0."""
    raw = F.lit(0.0)
    for k, w in CONSTRAINT.items():
        raw = raw + F.col(f"{k}_match") * F.lit(w)
    x = df.withColumn("_raw", raw)
    top = F.max("_raw").over(Window.partitionBy(query))
    return x.withColumn("constraint", F.when(top > 0, F.col("_raw") / top).otherwise(F.col("_raw"))).drop("_raw")


def fuse(df: DataFrame, signals: dict[str, float], query: str = "query_id", when_equal: float = 0.5) -> Column:
    """Weighted sum of signals, each min-maxed within its query; missing ones count 0 before that."""
    from tessera.operators.retrieval import min_max

    total = F.lit(0.0)
    for name, w in signals.items():
        total = total + w * min_max(F.coalesce(F.col(name), F.lit(0.0)), query, when_equal)
    return total


def floored_weights(weights: list[Column], floors: list[float]) -> Column:
    """Softmax of logits, then floors: what a floor adds the others give in proportion."""
    e = [F.exp(w - F.greatest(*weights)) for w in weights]
    total = sum(e[1:], e[0])
    soft = [x / total for x in e]
    low = [F.when(s < f, F.lit(f)) for s, f in zip(soft, floors)]
    fixed = sum([F.coalesce(x, F.lit(0.0)) for x in low], F.lit(0.0))
    free = sum([F.when(x.isNull(), s).otherwise(0.0) for x, s in zip(low, soft)], F.lit(0.0))
    return F.array(*[F.coalesce(x, s * (1 - fixed) / F.greatest(free, F.lit(1e-12))) for x, s in zip(low, soft)])


def reciprocal_rank(df: DataFrame, score: str, query: str, doc: str) -> Column:
    """1 / rank by a score, ties to the smaller id."""
    return F.lit(1.0) / F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), doc))


def typed_paths(edges: DataFrame, candidates: DataFrame, most: int = 8) -> DataFrame:
    """Typed paths from candidates: query_id, chunk_id, path_type, target, kind, is_match.

    Six kinds in a fixed order, the first ``most`` of a candidate kept:
    company - filing - section - chunk, filing - section, metrics and years of
    the chunk that the query names, neighbours by semantic edges, either way,
    that name one of the query's companies, years or metrics, and conflicts:
    companies, years and metrics of the chunk other than the query's.
    ``candidates`` have q_companies, q_years, q_metrics; without values of a
    kind the query has neither matches nor conflicts of it.
    """
    q = durable(candidates.select("query_id", "chunk_id", "q_companies", "q_years", "q_metrics"))
    ids = durable(q.select("chunk_id").distinct())
    near = edges.filter(F.col("edge_type") == "semantic-similar").select("src", "dst")
    both = near.union(near.select("dst", "src")).toDF("chunk_id", "n")
    met = durable(both.join(broadcast_if_small(ids), "chunk_id", "left_semi").distinct())
    # edges of the candidates and their neighbours, and those between entities, are all that any path takes
    wanted = durable(ids.union(met.select("n")).distinct().toDF("at"))
    chunk = F.when(F.col("edge_type") == "section-has-chunk", F.col("dst")).otherwise(F.col("src"))
    theirs = edges.filter(F.col("edge_type").isin("chunk-belongs-to-filing", "section-has-chunk", "chunk-mentions-metric", "chunk-mentions-year"))
    theirs = theirs.select("src", "dst", "edge_type", chunk.alias("at")).join(broadcast_if_small(wanted), "at", "left_semi")
    entities = edges.filter(F.col("edge_type").isin("filing-has-section", "company-has-filing"))
    e = durable(theirs.drop("at").union(entities.select("src", "dst", "edge_type")).distinct())

    def of(kind: str) -> DataFrame:
        return e.filter(F.col("edge_type") == kind)

    value = lambda c: F.element_at(F.split(c, "::"), 2)
    filing = of("chunk-belongs-to-filing").select(F.col("src").alias("chunk_id"), F.col("dst").alias("filing"))
    section = of("section-has-chunk").select(F.col("dst").alias("chunk_id"), F.col("src").alias("section"))
    has_section = of("filing-has-section").select(F.col("src").alias("filing"), F.col("dst").alias("section"))
    company = of("company-has-filing").select(F.col("dst").alias("filing"), F.col("src").alias("company"))
    chain = q.join(section, "chunk_id").join(has_section, "section").join(filing, ["chunk_id", "filing"])
    owned = chain.join(company, "filing")
    row = lambda df, order, path, target, match, kind: df.select(
        "query_id", "chunk_id", F.lit(order).alias("gen_order"), F.lit(path).alias("path_type"), target.alias("target"), F.lit(kind).alias("kind"), match.alias("known"),
    )
    has = lambda values, c: F.when(F.size(values) == 0, None).otherwise(F.array_contains(values, c))
    metric = q.join(of("chunk-mentions-metric").select(F.col("src").alias("chunk_id"), F.col("dst").alias("m")), "chunk_id")
    year = q.join(of("chunk-mentions-year").select(F.col("src").alias("chunk_id"), F.col("dst").alias("y")), "chunk_id")
    support = q.join(met, "chunk_id")
    told = [
        (of("chunk-mentions-metric").select(F.col("src").alias("n"), value(F.col("dst")).alias("v")), "q_metrics"),
        (of("chunk-mentions-year").select(F.col("src").alias("n"), value(F.col("dst")).alias("v")), "q_years"),
        (filing.join(company, "filing").select(F.col("chunk_id").alias("n"), value(F.col("company")).alias("v")), "q_companies"),
    ]
    alike = [support.join(t, "n").filter(F.array_contains(names, F.col("v"))).select("query_id", "chunk_id", "n") for t, names in told]
    alike = alike[0].union(alike[1]).union(alike[2]).distinct()
    owner = has(F.col("q_companies"), value(F.col("company")))
    says = has(F.col("q_metrics"), value(F.col("m"))), has(F.col("q_years"), value(F.col("y")))
    found = [
        row(owned, 1, "company_filing_section", F.col("company"), F.when(owner, True), "company"),
        row(chain, 2, "filing_section", F.col("section"), F.lit(None).cast("boolean"), "filing"),
        row(metric.filter(says[0]), 3, "chunk_metric", F.col("m"), F.lit(True), "metric"),
        row(year.filter(says[1]), 4, "chunk_year", F.col("y"), F.lit(True), "year"),
        row(alike, 5, "semantic_support", F.col("n"), F.lit(None).cast("boolean"), "semantic"),
        row(metric.filter(~says[0]), 6, "conflict", F.col("m"), F.lit(False), "metric"),
        row(year.filter(~says[1]), 6, "conflict", F.col("y"), F.lit(False), "year"),
        row(q.join(filing, "chunk_id").join(company, "filing").filter(~owner), 6, "conflict", F.col("company"), F.lit(False), "company"),
    ]
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    order = Window.partitionBy("query_id", "chunk_id").orderBy("gen_order", "target")
    ranked = every.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return ranked.select(
        "query_id", "chunk_id", "path_type", "target", "kind", F.when(F.coalesce("known", F.lit(False)), 1).otherwise(0).alias("is_match"),
        F.when(F.coalesce(~F.col("known"), F.lit(False)), 1).otherwise(0).alias("is_conflict"),
    )


def path_arrays(paths: DataFrame, most: int = 8) -> DataFrame:
    """Each candidate's paths as arrays of ``most`` places: type_ids, matches, conflicts, mask.

    Path types are numbered from 3 on in order of their names, after those of
    padding (0), unknown (1) and none (2); they are a handful, not data, so
    their table is broadcast.  Paths come in order of type and target.
    """
    paths = durable(paths)
    kinds = paths.select("path_type").distinct().withColumn("type_id", F.row_number().over(Window.orderBy("path_type")) + 2)
    x = paths.join(F.broadcast(kinds), "path_type")
    n = Window.partitionBy("query_id", "chunk_id").orderBy("path_type", "target", "kind")
    few = x.withColumn("_n", F.row_number().over(n)).filter(F.col("_n") <= most)
    rows = few.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_n", "type_id", "is_match", "is_conflict"))).alias("p"))
    fill = lambda c: F.concat(c, F.array_repeat(F.lit(0), F.lit(most) - F.size(c)))
    get = lambda name: fill(F.transform("p", lambda s: s[name]))
    return rows.select(
        "query_id", "chunk_id", get("type_id").alias("type_ids"), get("is_match").alias("matches"), get("is_conflict").alias("conflicts"),
        fill(F.transform("p", lambda s: F.lit(1))).alias("mask"),
    )


def path_features(paths: DataFrame, most: int = 8) -> DataFrame:
    """Counts over ``most``, the share that match, and which kinds match or conflict at all."""
    flag = lambda kind, col: F.max(F.when((F.col("kind") == kind) & (F.col(col) == 1), 1).otherwise(0))
    share = lambda c: F.least(c / F.lit(float(most)), F.lit(1.0))
    n, m, c = F.count(F.lit(1)), F.sum("is_match"), F.sum("is_conflict")
    return paths.groupBy("query_id", "chunk_id").agg(
        share(n).alias("path_count"),
        share(m).alias("matched"),
        share(c).alias("conflicting"),
        (m / n).alias("coverage"),
        *[flag(k, "is_match").alias(f"{k}_path") for k in KINDS],
        F.max(F.when(F.col("kind") == "semantic", 1).otherwise(0)).alias("semantic_path"),
        *[flag(k, "is_conflict").alias(f"{k}_conflict") for k in KINDS],
    )


def rule_path_score(base: Column, tau: float = 0.2) -> Column:
    """``base`` moved by the hyperbolic tangent of support less conflict."""
    support = PATH_SUPPORT["coverage"] * F.col("coverage") + PATH_SUPPORT["semantic"] * F.col("semantic_path")
    for k in KINDS:
        support = support + PATH_SUPPORT[k] * F.col(f"{k}_path")
    conflict = sum([PATH_CONFLICT[k] * F.col(f"{k}_conflict") for k in KINDS], F.lit(0.0))
    return base + tau * F.tanh(support - conflict)


def stable_ranking(df: DataFrame, query: str = "query_id", doc: str = "chunk_id", bound: float = 0.15) -> DataFrame:
    """.75 retrieval + .25 rank prior + a delta of at most ``bound`` either way; best first."""
    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    prior = 1 - (F.col("rank") - 1) / F.greatest(n - 1, F.lit(1))
    score = 0.75 * F.col("retrieval") + 0.25 * prior + F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("delta")))
    x = df.withColumn("score", score)
    return x.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 8).desc(), doc)))


def greedy_sets(df: DataFrame, size: int = 4, conflict_over: float = 0.75) -> DataFrame:
    """An evidence set for each query, built greedily: query_id, chunk_id, position.

    ``df``: query_id, chunk_id, score, conflict, covers (what a passage covers of
    the query) and asked (all that is to be covered).  Passages come in order of
    score; those in conflict are passed over; it ends when all is covered by
    two or more.  A fold over a query's candidates, of which there are few.
    """
    ordered = df.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", "conflict", "covers"))).alias("c"), F.first("asked").alias("asked")
    )
    empty = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("got"))

    def take(acc: Column, x: Column) -> Column:
        n = F.size(acc["ids"])
        done = (n >= size) | ((n >= 2) & (F.size(F.array_except(F.col("asked"), acc["got"])) == 0))
        grown = F.struct(F.concat(acc["ids"], F.array(x["chunk_id"])).alias("ids"), F.array_union(acc["got"], x["covers"]).alias("got"))
        return F.when(done | (x["conflict"] > conflict_over), acc).otherwise(grown)

    folded = ordered.select("query_id", F.aggregate("c", empty, take)["ids"].alias("ids"))
    return folded.select("query_id", F.posexplode("ids").alias("position", "chunk_id"))
