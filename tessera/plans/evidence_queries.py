"""Queries over an evidence table made of orders, with their SQL.

A chunk is an order; its document is the customer, its company the customer's
nation, its filing that nation's market segment and year, its section the
priority and its metric the status.  Queries are nations: each asks for its own
company, the year 1995 and the metric F; candidates are the region's 50 most
valuable orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import expansion, graph, metrics, rerank, retrieval, training
from tessera.operators.durable import broadcast_if_small, durable
from tessera.plans.retrieval_queries import table


def _chunks(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"),
        F.col("n_name").alias("company"),
        F.col("n_regionkey").alias("region"),
        F.col("c_mktsegment").alias("filing_type"),
        F.year("o_orderdate").cast("string").alias("filing_year"),
        F.col("o_orderpriority").alias("section"),
        F.col("o_orderstatus").alias("metric"),
        F.col("o_orderkey").alias("word_offset"),
        F.col("o_totalprice").alias("value"),
    )


def _ranked(spark, d, k=50):
    """query_id, chunk_id, score, rank: the best of a region once, for each of its nations."""
    q = table(spark, d, "nation").select(F.col("n_name").alias("query_id"), F.col("n_regionkey").alias("region"))
    c = _chunks(spark, d).select("chunk_id", "region", F.col("value").alias("score"))
    best = retrieval.top_k(c, "region", "chunk_id", k)
    return durable(best.join(q, "region").select("query_id", "chunk_id", "score", "rank"))


def _candidates(spark, d):
    c = _chunks(spark, d).drop("doc_id", "region", "word_offset", "value")
    return c.join(broadcast_if_small(_ranked(spark, d)), "chunk_id").select(
        "query_id", "chunk_id", "score", "rank",
        F.array("query_id").alias("q_companies"), F.array(F.lit("1995")).alias("q_years"), F.array(F.lit("F")).alias("q_metrics"),
        F.array("company").alias("companies"), F.array("filing_year").alias("years"), F.array("metric").alias("metrics"), "section",
    )


def graph_nodes(spark, d):
    return graph.build_nodes(_chunks(spark, d))


def graph_edges(spark, d):
    return graph.build_edges(_chunks(spark, d))


def edge_type_counts(spark, d):
    return graph_edges(spark, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


def node_degree(spark, d):
    return graph.degrees(graph_edges(spark, d)).select("node_id", "degree", F.round("log_degree", 6).alias("log_degree"))


def same_entity_edges(spark, d):
    chunks = _chunks(spark, d)
    w = graph.same_edges(chunks, "doc_id", "same-company", "word_offset")
    return w.select("src", "dst", "edge_type", "weight")


def bidirectional_max(spark, d):
    return graph.bidirectional(graph_edges(spark, d))


def two_hop(spark, d):
    seeds = table(spark, d, "nation").select(F.concat(F.lit("company::"), "n_name").alias("node_id"))
    return graph.k_hop(graph_edges(spark, d), seeds, 2)


def induced_subgraph(spark, d):
    nodes = _ranked(spark, d).select(F.col("chunk_id").alias("node_id")).union(graph_nodes(spark, d).filter(F.col("node_type") != "chunk").select("node_id"))
    return graph.induced(graph_edges(spark, d), nodes)


def edge_channels(spark, d):
    e = graph_edges(spark, d).union(same_entity_edges(spark, d))
    return e.groupBy(graph.channel(F.col("edge_type")).alias("channel")).agg(F.count(F.lit(1)).alias("edges"))


def norm_adjacency(spark, d):
    a = graph.normalized_adjacency(graph_edges(spark, d))
    return a.select("src", "dst", F.round("value", 6).alias("value"))


def knn_edges(spark, d):
    e = graph.knn_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 5, 0.2)
    return e.select("src", "dst", F.round("similarity", 6).alias("similarity"))


def _entity_graph(spark, d):
    """Companies, filings and sections, both ways."""
    e = graph_edges(spark, d).filter(F.col("edge_type").isin("company-has-filing", "filing-has-section"))
    return graph.bidirectional(e)


def ppr_20_iterations(spark, d):
    seeds = table(spark, d, "nation").select(F.col("n_name").alias("query_id"), F.concat(F.lit("company::"), "n_name").alias("node_id"))
    p = graph.pagerank(_entity_graph(spark, d), seeds, 20)
    return p.select("query_id", "node_id", F.round("score", 6).alias("score"))


def _subgraphs(spark, d):
    """Each nation's own company and first twenty candidates, with their neighbours."""
    seeds = table(spark, d, "nation").select(F.col("n_name").alias("query_id"), F.concat(F.lit("company::"), "n_name").alias("node_id"))
    members = _ranked(spark, d, 20).select("query_id", F.col("chunk_id").alias("node_id")).union(seeds)
    few = graph_edges(spark, d).filter(F.col("edge_type").isin("chunk-belongs-to-filing", "company-has-filing"))
    return graph.candidate_subgraphs(few, members), seeds


def candidate_subgraph(spark, d):
    return _subgraphs(spark, d)[0]


def ppr_converged(spark, d):
    return graph.pagerank_converged(*_subgraphs(spark, d)).select("query_id", "node_id", F.round("score", 4).alias("score"))


def typed_paths(spark, d):
    near = graph.same_edges(_chunks(spark, d), "doc_id", "semantic-similar", "word_offset")
    return rerank.typed_paths(graph_edges(spark, d).union(near), _candidates(spark, d))


def _features(spark, d):
    return rerank.path_features(typed_paths(spark, d))


def path_features(spark, d):
    return _features(spark, d).withColumn("coverage", F.round("coverage", 6))


def rule_path_score(spark, d):
    x = _candidates(spark, d).select("query_id", "chunk_id", retrieval.min_max(F.col("score"), "query_id").alias("base"))
    s = x.join(_features(spark, d), ["query_id", "chunk_id"])
    return s.select("query_id", "chunk_id", F.round(rerank.rule_path_score(F.col("base")), 6).alias("score"))


def match_conflict_features(spark, d):
    x = rerank.match_features(_candidates(spark, d))
    return x.select("query_id", "chunk_id", *[f"{k}_{m}" for k in rerank.KINDS for m in ("match", "conflict")])


def _constraint(spark, d):
    return rerank.constraint_score(rerank.match_features(_candidates(spark, d)))


def constraint_score(spark, d):
    return _constraint(spark, d).select("query_id", "chunk_id", F.round("constraint", 6).alias("score"))


def fusion_score(spark, d):
    x = _constraint(spark, d).withColumn("recip", rerank.reciprocal_rank(_constraint(spark, d), "constraint", "query_id", "chunk_id"))
    fused = rerank.fuse(x, {"score": 0.6, "constraint": 0.3, "recip": 0.1})
    return x.select("query_id", "chunk_id", F.round(fused, 6).alias("fused"))


def floored_weights(spark, d):
    q = table(spark, d, "nation").select("n_nationkey", *[(F.col("n_nationkey") * k / 10.0).alias(f"l{k}") for k in (1, 2, 3)])
    w = rerank.floored_weights([F.col("l1"), F.col("l2"), F.col("l3")], [0.15, 0.35, 0.0])
    return q.select("n_nationkey", *[F.round(w[i], 6).alias(f"w{i}") for i in range(3)])


def stable_ranking(spark, d):
    x = _constraint(spark, d).withColumn("retrieval", retrieval.min_max(F.col("score"), "query_id", 1.0)).withColumn("delta", F.col("constraint") - 0.5)
    return rerank.stable_ranking(x).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "new_rank")


def evidence_sets(spark, d):
    x = _constraint(spark, d)
    covers = F.array_compact(F.array(*[F.when(F.col(f"{k}_match") == 1, F.lit(k)) for k in rerank.KINDS]))
    conflict = sum([F.col(f"{k}_conflict") for k in rerank.KINDS], F.lit(0)) / 3.0
    rows = x.select("query_id", "chunk_id", "score", conflict.alias("conflict"), covers.alias("covers"), F.array(*map(F.lit, rerank.KINDS)).alias("asked"))
    return rerank.greedy_sets(rows)


def _seeds(spark, d):
    return _ranked(spark, d, 15)


def expand_adjacent(spark, d):
    e = expansion.adjacent(_seeds(spark, d), _chunks(spark, d), budget=10)
    return e.select("query_id", "chunk_id", "seed_id", F.round("priority", 6).alias("priority"))


def _same_filing(spark, d, budget=10):
    overlap = F.when(F.col("section") == F.col("seed_section"), 1.0).otherwise(0.8)
    return expansion.same_key(_seeds(spark, d), _chunks(spark, d), "same_filing", ["company", "filing_type", "filing_year"], 1, overlap, ("section",), budget)


def expand_same_filing(spark, d):
    return _same_filing(spark, d).select("query_id", "chunk_id", "seed_id", F.round("priority", 6).alias("priority"))


def expand_same_section(spark, d):
    bonus = 1 / (1 + F.abs(F.col("word_offset") - F.col("seed_word_offset")) / 1000.0)
    e = expansion.same_key(_seeds(spark, d), _chunks(spark, d), "same_section", ["doc_id", "section"], 1, bonus, ("word_offset",), 10)
    return e.select("query_id", "chunk_id", "seed_id", F.round("priority", 6).alias("priority"))


def expand_merge(spark, d):
    e = expansion.adjacent(_seeds(spark, d), _chunks(spark, d), budget=10).union(_same_filing(spark, d))
    m = expansion.merge(_ranked(spark, d), e)
    return m.select("query_id", "chunk_id", "is_initial", "relations", F.round("priority", 6).alias("priority"), "position")


def _judged(spark, d):
    x = rerank.match_features(_candidates(spark, d))
    gold = x.filter((F.col("company_match") == 1) & (F.col("metric_match") == 1)).select("query_id", "chunk_id")
    return metrics.judged(x, gold, "query_id", "chunk_id")


def train_pairs(spark, d):
    return training.train_pairs(_judged(spark, d), "query_id", "chunk_id")


def hard_negatives(spark, d):
    x = _judged(spark, d).filter(F.col("is_gold") == 0)
    same = F.when(F.col("section") == "1-URGENT", 1).otherwise(0)
    rows = x.select("query_id", "chunk_id", F.col("metric_match").alias("metric_same"), F.col("year_match").alias("year_same"), same.alias("section_same"))
    return training.hard_negatives(rows, "query_id", "chunk_id", 3)


def candidate_company_hint(spark, d):
    """The most frequent company among the top 20, if it has at least a quarter and two."""
    x = _candidates(spark, d).filter(F.col("rank") <= 20)
    n = x.groupBy("query_id", F.col("companies")[0].alias("company")).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("query_id").agg(F.max(F.struct("n", "company")).alias("b"))
    return best.filter(F.col("b.n") >= 5).select("query_id", "b.company", "b.n")


def conflict_rates(spark, d):
    """Shares of conflicts among candidates where both sides are known."""
    x = rerank.match_features(_candidates(spark, d))
    rate = lambda k: F.round(F.sum(f"{k}_conflict") / F.sum(F.col(f"{k}_conflict") + F.col(f"{k}_match")), 6).alias(f"{k}_rate")
    return x.groupBy("query_id").agg(*[rate(k) for k in rerank.KINDS])


QUERIES = {
    f.__name__: f
    for f in (
        graph_nodes, graph_edges, edge_type_counts, node_degree, same_entity_edges, bidirectional_max, two_hop, induced_subgraph, edge_channels,
        norm_adjacency, knn_edges, ppr_20_iterations, candidate_subgraph, ppr_converged, typed_paths, path_features, rule_path_score, match_conflict_features,
        constraint_score, fusion_score, floored_weights, stable_ranking, evidence_sets, expand_adjacent, expand_same_filing, expand_same_section,
        expand_merge, train_pairs, hard_negatives, candidate_company_hint, conflict_rates,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_C = """
chunks AS MATERIALIZED (SELECT 'o' || o_orderkey AS chunk_id, 'c' || o_custkey AS doc_id, n_name AS company, n_regionkey AS region, c_mktsegment AS filing_type,
  year(o_orderdate)::VARCHAR AS filing_year, o_orderpriority AS section, o_orderstatus AS metric, o_orderkey AS word_offset, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_R = _C + """,
ranked50 AS MATERIALIZED (SELECT * FROM (SELECT n_name AS query_id, chunk_id, value AS score,
  row_number() OVER (PARTITION BY n_name ORDER BY round(value, 8) DESC, chunk_id) AS rank FROM chunks JOIN nation ON region = n_regionkey) WHERE rank <= 50),
cand AS MATERIALIZED (SELECT query_id, chunk_id, score, rank::INT AS rank, company, filing_year, metric, section,
  (company = query_id)::INT AS company_match, (company <> query_id)::INT AS company_conflict, (filing_year = '1995')::INT AS year_match,
  (filing_year <> '1995')::INT AS year_conflict, (metric = 'F')::INT AS metric_match, (metric <> 'F')::INT AS metric_conflict
  FROM ranked50 JOIN chunks USING (chunk_id))"""
_E = """
ids AS (SELECT chunk_id, 'company::' || company AS co, 'filing::' || company || '|' || filing_type || '|' || filing_year AS fi,
  'section::' || section AS se, 'metric::' || metric AS me, 'year::' || filing_year AS ye FROM chunks),
edges AS MATERIALIZED (
  SELECT chunk_id AS src, me AS dst, 'chunk-mentions-metric' AS edge_type, 0.8::DOUBLE AS weight FROM ids
  UNION ALL SELECT chunk_id, ye, 'chunk-mentions-year', 0.8 FROM ids UNION ALL SELECT se, chunk_id, 'section-has-chunk', 0.6 FROM ids
  UNION ALL SELECT chunk_id, fi, 'chunk-belongs-to-filing', 0.5 FROM ids
  UNION ALL SELECT * FROM (SELECT DISTINCT co, fi, 'company-has-filing', 0.7::DOUBLE FROM ids)
  UNION ALL SELECT * FROM (SELECT DISTINCT fi, se, 'filing-has-section', 0.6::DOUBLE FROM ids))"""
_CE = _C + "," + _E
_BI = """, both_ AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
bi AS MATERIALIZED (SELECT src, dst, max(weight) AS weight FROM both_ GROUP BY src, dst)"""
_NODES = """, nodes AS (SELECT DISTINCT chunk_id AS node_id, 'chunk' AS node_type FROM ids UNION SELECT co, 'company' FROM ids UNION SELECT fi, 'filing' FROM ids
  UNION SELECT se, 'section' FROM ids UNION SELECT me, 'metric' FROM ids UNION SELECT ye, 'year' FROM ids)"""
_PATHS = """, q AS (SELECT query_id, chunk_id, ids.*  EXCLUDE (chunk_id) FROM cand JOIN ids USING (chunk_id)),
nx AS (SELECT chunk_id, lead(chunk_id, 1) OVER w AS a, lead(chunk_id, 2) OVER w AS b FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY word_offset)),
nb AS (SELECT chunk_id AS s, a AS t FROM nx WHERE a IS NOT NULL UNION SELECT chunk_id, b FROM nx WHERE b IS NOT NULL UNION SELECT a, chunk_id FROM nx WHERE a IS NOT NULL UNION SELECT b, chunk_id FROM nx WHERE b IS NOT NULL),
allp0 AS (
  SELECT query_id, chunk_id, 1 AS o, 'company_filing_section' AS path_type, co AS target, 'company' AS kind, CASE WHEN split_part(co, '::', 2) = query_id THEN true END AS known FROM q
  UNION ALL SELECT query_id, chunk_id, 2, 'filing_section', se, 'filing', NULL FROM q
  UNION ALL SELECT query_id, chunk_id, 3, 'chunk_metric', me, 'metric', true FROM q WHERE me = 'metric::F'
  UNION ALL SELECT query_id, chunk_id, 4, 'chunk_year', ye, 'year', true FROM q WHERE ye = 'year::1995'
  UNION ALL SELECT query_id, q.chunk_id, 5, 'semantic_support', t, 'semantic', NULL FROM q JOIN nb ON s = q.chunk_id JOIN chunks c ON c.chunk_id = t WHERE c.metric = 'F' OR c.filing_year = '1995' OR c.company = query_id
  UNION ALL SELECT query_id, chunk_id, 6, 'conflict', me, 'metric', false FROM q WHERE me <> 'metric::F' UNION ALL SELECT query_id, chunk_id, 6, 'conflict', ye, 'year', false FROM q WHERE ye <> 'year::1995'
  UNION ALL SELECT query_id, chunk_id, 6, 'conflict', co, 'company', false FROM q WHERE split_part(co, '::', 2) <> query_id),
allp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY o, target) AS n FROM allp0) WHERE n <= 8),
paths AS MATERIALIZED (SELECT query_id, chunk_id, path_type, target, kind, coalesce(known, false)::INT AS is_match, coalesce(NOT known, false)::INT AS is_conflict FROM allp),
pf AS MATERIALIZED (SELECT query_id, chunk_id, least(count(*) / 8.0::DOUBLE, 1) AS path_count, least(sum(is_match) / 8.0::DOUBLE, 1) AS matched,
  least(sum(is_conflict) / 8.0::DOUBLE, 1) AS conflicting, sum(is_match) / count(*) AS coverage,
  max((kind = 'company' AND is_match = 1)::INT) AS company_path, max((kind = 'year' AND is_match = 1)::INT) AS year_path,
  max((kind = 'metric' AND is_match = 1)::INT) AS metric_path, max((kind = 'semantic')::INT) AS semantic_path,
  max((kind = 'company' AND is_conflict = 1)::INT) AS company_conflict, max((kind = 'year' AND is_conflict = 1)::INT) AS year_conflict,
  max((kind = 'metric' AND is_conflict = 1)::INT) AS metric_conflict FROM paths GROUP BY query_id, chunk_id)"""
_CON = """, con AS MATERIALIZED (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE raw END AS c
  FROM (SELECT *, company_match * 1.0::DOUBLE + year_match * 1.0::DOUBLE + metric_match * 0.8::DOUBLE AS raw FROM cand))"""
_MM = "CASE WHEN max({x}) OVER w = min({x}) OVER w THEN {e}::DOUBLE ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"
_SEED = """, seeds AS (SELECT query_id, chunk_id AS seed_id, score AS seed_score, rank AS seed_rank FROM ranked50 WHERE rank <= 15),
isseed AS (SELECT query_id, seed_id AS chunk_id FROM seeds)"""
_CLAIM = """, {n}_c AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(priority, 10) DESC, seed_rank, seed_id) AS one FROM {n}_r
    ANTI JOIN isseed USING (query_id, chunk_id)),
{n} AS MATERIALIZED (SELECT query_id, chunk_id, '{rel}' AS relation, seed_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(priority, 10) DESC, chunk_id) AS b
    FROM {n}_c WHERE one = 1) WHERE b <= 10)"""
_ADJ = """, pos AS (SELECT chunk_id, section, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_offset, chunk_id) AS i FROM chunks),
adj_r AS (SELECT query_id, b.chunk_id, seed_id, seed_rank, 1.0::DOUBLE / seed_rank / 2.0 * CASE WHEN a.section = b.section THEN 1.0::DOUBLE ELSE 0.5 END AS priority
  FROM seeds JOIN pos a ON a.chunk_id = seed_id JOIN pos b ON a.doc_id = b.doc_id AND abs(a.i - b.i) IN (1, 2))""" + _CLAIM.format(n="adj", rel="adjacent_chunk")
_FIL = """, fil_r AS (SELECT query_id, b.chunk_id, seed_id, seed_rank, 0.75::DOUBLE / seed_rank / 2.0 * CASE WHEN a.section = b.section THEN 1.0::DOUBLE ELSE 0.8 END AS priority
  FROM seeds JOIN chunks a ON a.chunk_id = seed_id JOIN chunks b ON a.company = b.company AND a.filing_type = b.filing_type AND a.filing_year = b.filing_year
    AND a.chunk_id <> b.chunk_id)""" + _CLAIM.format(n="fil", rel="same_filing")
_SEC = """, sec_r AS (SELECT query_id, b.chunk_id, seed_id, seed_rank, 0.9::DOUBLE / seed_rank / 2.0 * (1 / (1 + abs(a.word_offset - b.word_offset) / 1000.0::DOUBLE)) AS priority
  FROM seeds JOIN chunks a ON a.chunk_id = seed_id JOIN chunks b ON a.doc_id = b.doc_id AND a.section = b.section AND a.chunk_id <> b.chunk_id)""" + _CLAIM.format(n="sec", rel="same_section")
_JUD = """, jud AS (SELECT *, company_match * metric_match AS is_gold FROM cand)"""


def _ppr_sql(steps: int = 20) -> str:
    """The loop written out, a common table expression a step."""
    sql = f"""WITH {_CE}, e0 AS (SELECT src, dst, weight FROM edges WHERE edge_type IN ('company-has-filing', 'filing-has-section')),
        e1 AS (SELECT src, dst, max(weight) AS w FROM (SELECT * FROM e0 UNION ALL SELECT dst, src, weight FROM e0) GROUP BY src, dst),
        p AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM e1),
        s0 AS MATERIALIZED (SELECT n_name AS query_id, 'company::' || n_name AS node_id, 1.0::DOUBLE AS score FROM nation)"""
    for i in range(steps):
        sql += f""", s{i + 1} AS MATERIALIZED (SELECT query_id, node_id, sum(m) AS score FROM (
            SELECT query_id, dst AS node_id, 0.85::DOUBLE * score * p AS m FROM s{i} JOIN p ON node_id = src
            UNION ALL SELECT s0.query_id, s0.node_id, s0.score * (0.15::DOUBLE + 0.85::DOUBLE * coalesce(l.lost, 0)) FROM s0 LEFT JOIN
              (SELECT query_id, sum(score) AS lost FROM s{i} WHERE node_id NOT IN (SELECT src FROM p) GROUP BY query_id) l USING (query_id)) GROUP BY query_id, node_id)"""
    return sql + f" SELECT query_id, node_id, round(score, 6) AS score FROM s{steps}"


_PRI = "SELECT query_id, chunk_id, seed_id, round(priority, 6) AS priority FROM "
ORACLE_SQL = {
    "graph_nodes": f"WITH {_CE}{_NODES} SELECT * FROM nodes",
    "graph_edges": f"WITH {_CE} SELECT * FROM edges",
    "edge_type_counts": f"WITH {_CE} SELECT edge_type, count(*)::BIGINT AS edges, round(sum(weight), 4) AS weight FROM edges GROUP BY edge_type",
    "node_degree": f"""WITH {_CE} SELECT node_id, count(*)::BIGINT AS degree, round(ln(1 + count(*)), 6) AS log_degree
        FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node_id""",
    "same_entity_edges": f"""WITH {_C}, x AS (SELECT chunk_id, lead(chunk_id, 1) OVER w AS a, lead(chunk_id, 2) OVER w AS b FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY word_offset))
        SELECT chunk_id AS src, a AS dst, 'same-company' AS edge_type, 0.5::DOUBLE AS weight FROM x WHERE a IS NOT NULL
        UNION ALL SELECT chunk_id, b, 'same-company', 0.5 FROM x WHERE b IS NOT NULL""",
    "bidirectional_max": f"WITH {_CE}{_BI} SELECT * FROM bi",
    "two_hop": f"""WITH {_CE}, s AS (SELECT 'company::' || n_name AS seed FROM nation), e AS (SELECT DISTINCT src, dst FROM edges),
        h1 AS (SELECT seed, dst AS node_id FROM s JOIN e ON seed = src), h2 AS (SELECT seed, dst AS node_id FROM h1 JOIN e ON node_id = src)
        SELECT seed, seed AS node_id FROM s UNION SELECT * FROM h1 UNION SELECT * FROM h2""",
    "induced_subgraph": f"""WITH {_R}, {_E}{_NODES}, n AS (SELECT chunk_id AS node_id FROM ranked50 UNION SELECT node_id FROM nodes WHERE node_type <> 'chunk')
        SELECT * FROM edges WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)""",
    "edge_channels": f"""WITH {_CE}, x AS (SELECT chunk_id, lead(chunk_id, 1) OVER w AS a, lead(chunk_id, 2) OVER w AS b FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY word_offset))
        SELECT CASE WHEN edge_type IN ('semantic-similar', 'same-company', 'same-year', 'same-metric', 'same-section', 'same-filing-year', 'near-duplicate') THEN 'semantic' ELSE 'structural' END AS channel,
          sum(n)::BIGINT AS edges FROM (SELECT edge_type, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'same-company', count(a) + count(b) FROM x) GROUP BY ALL""",
    "norm_adjacency": f"""WITH {_CE}{_BI}, a AS (SELECT * FROM bi UNION ALL SELECT DISTINCT src, src, 1.0::DOUBLE FROM bi), d AS (SELECT src, sum(weight) AS d FROM a GROUP BY src)
        SELECT a.src, a.dst, round(weight / (sqrt(x.d) * sqrt(y.d)), 6) AS value FROM a JOIN d x ON a.src = x.src JOIN d y ON a.dst = y.src""",
    "knn_edges": """WITH s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)
        SELECT src, dst, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 8) DESC, dst) AS n FROM s WHERE s >= 0.2) WHERE n <= 5""",
    "ppr_20_iterations": _ppr_sql(),
    "candidate_subgraph": f"""WITH {_R}, {_E}, e AS (SELECT src, dst, weight FROM edges WHERE edge_type IN ('chunk-belongs-to-filing', 'company-has-filing')),
        b AS MATERIALIZED (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY src, dst),
        m AS (SELECT query_id, chunk_id AS node FROM ranked50 WHERE rank <= 20 UNION SELECT n_name, 'company::' || n_name FROM nation),
        v AS MATERIALIZED (SELECT query_id, node FROM m UNION SELECT query_id, dst FROM m JOIN b ON src = node)
        SELECT x.query_id, src, dst, weight FROM v x JOIN b ON src = x.node JOIN v y ON y.query_id = x.query_id AND y.node = dst""",
    "typed_paths": f"WITH {_R}, {_E}{_PATHS} SELECT * FROM paths",
    "path_features": f"WITH {_R}, {_E}{_PATHS} SELECT * REPLACE (round(coverage, 6) AS coverage) FROM pf",
    "rule_path_score": f"""WITH {_R}, {_E}{_PATHS}, b AS (SELECT query_id, chunk_id, {_MM.format(x='score', e='0.5')} AS base FROM cand WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, chunk_id, round(base + 0.2::DOUBLE * tanh(0.4::DOUBLE * coverage + 0.1::DOUBLE * semantic_path + 0.15::DOUBLE * company_path + 0.15::DOUBLE * year_path
          + 0.15::DOUBLE * metric_path - (0.3::DOUBLE * company_conflict + 0.3::DOUBLE * year_conflict + 0.3::DOUBLE * metric_conflict)), 6) AS score FROM b JOIN pf USING (query_id, chunk_id)""",
    "match_conflict_features": f"WITH {_R} SELECT query_id, chunk_id, company_match, company_conflict, year_match, year_conflict, metric_match, metric_conflict FROM cand",
    "constraint_score": f"WITH {_R}{_CON} SELECT query_id, chunk_id, round(c, 6) AS score FROM con",
    "fusion_score": f"""WITH {_R}{_CON}, r AS (SELECT *, 1.0::DOUBLE / row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS recip FROM con)
        SELECT query_id, chunk_id, round(0.6::DOUBLE * {_MM.format(x='score', e='0.5')} + 0.3::DOUBLE * {_MM.format(x='c', e='0.5')} + 0.1::DOUBLE * {_MM.format(x='recip', e='0.5')}, 6) AS fused
        FROM r WINDOW w AS (PARTITION BY query_id)""",
    "floored_weights": """WITH l AS (SELECT n_nationkey, n_nationkey / 10.0::DOUBLE AS a, n_nationkey * 2 / 10.0::DOUBLE AS b, n_nationkey * 3 / 10.0::DOUBLE AS c FROM nation),
        s AS (SELECT n_nationkey, exp(a - c) / (exp(a - c) + exp(b - c) + 1) AS s0, exp(b - c) / (exp(a - c) + exp(b - c) + 1) AS s1, 1 / (exp(a - c) + exp(b - c) + 1) AS s2 FROM l),
        f AS (SELECT *, CASE WHEN s0 < 0.15 THEN 0.15::DOUBLE END AS f0, CASE WHEN s1 < 0.35 THEN 0.35::DOUBLE END AS f1 FROM s),
        t AS (SELECT *, coalesce(f0, 0) + coalesce(f1, 0) AS fixed, CASE WHEN f0 IS NULL THEN s0 ELSE 0 END + CASE WHEN f1 IS NULL THEN s1 ELSE 0 END + s2 AS free FROM f)
        SELECT n_nationkey, round(coalesce(f0, s0 * (1 - fixed) / free), 6) AS w0, round(coalesce(f1, s1 * (1 - fixed) / free), 6) AS w1, round(s2 * (1 - fixed) / free, 6) AS w2 FROM t""",
    "stable_ranking": f"""WITH {_R}{_CON}, r AS (SELECT query_id, chunk_id, 0.75::DOUBLE * {_MM.format(x='score', e='1.0')} + 0.25::DOUBLE * (1 - (rank - 1) / greatest(count(*) OVER w - 1, 1))
          + greatest(-0.15::DOUBLE, least(0.15::DOUBLE, c - 0.5)) AS score FROM con WINDOW w AS (PARTITION BY query_id))
        SELECT query_id, chunk_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, chunk_id))::INT AS new_rank FROM r""",
    "expand_adjacent": f"WITH {_R}{_SEED}{_ADJ} {_PRI} adj",
    "expand_same_filing": f"WITH {_R}{_SEED}{_FIL} {_PRI} fil",
    "expand_same_section": f"WITH {_R}{_SEED}{_SEC} {_PRI} sec",
    "expand_merge": f"""WITH {_R}{_SEED}{_ADJ}{_FIL}, u AS (SELECT query_id, chunk_id, true AS is_initial, NULL AS relation, 0.0::DOUBLE AS priority, score FROM ranked50
          UNION ALL SELECT query_id, chunk_id, false, relation, priority, 0 FROM adj UNION ALL SELECT query_id, chunk_id, false, relation, priority, 0 FROM fil),
        g AS (SELECT query_id, chunk_id, bool_or(is_initial) AS is_initial, coalesce(string_agg(DISTINCT relation, ',' ORDER BY relation), '') AS relations, max(priority) AS priority, max(score) AS score FROM u GROUP BY query_id, chunk_id)
        SELECT query_id, chunk_id, is_initial, relations, round(priority, 6) AS priority, position FROM (SELECT *, (row_number() OVER (PARTITION BY query_id
          ORDER BY is_initial DESC, round(priority, 10) DESC, round(score, 10) DESC, chunk_id))::INT AS position FROM g) WHERE position <= 80""",
    "train_pairs": f"""WITH {_R}{_JUD}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_gold ORDER BY rank, chunk_id) AS n FROM jud)
        SELECT p.query_id, p.chunk_id AS positive, n.chunk_id AS negative FROM x p JOIN x n USING (query_id) WHERE p.is_gold = 1 AND p.n = 1 AND n.is_gold = 0 AND n.n <= 5""",
    "hard_negatives": f"""WITH {_R}{_JUD}, b AS (SELECT query_id, chunk_id, CASE WHEN metric_match = 1 AND year_match = 0 THEN 'wrong_year' WHEN year_match = 1 AND metric_match = 0 THEN 'wrong_metric'
          WHEN section = '1-URGENT' THEN 'same_section' ELSE 'other' END AS bucket FROM jud WHERE is_gold = 0)
        SELECT query_id, chunk_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY md5(query_id || '|' || chunk_id)) AS n FROM b) WHERE n <= 3""",
    "candidate_company_hint": f"""WITH {_R}, n AS (SELECT query_id, company, count(*)::BIGINT AS n FROM cand WHERE rank <= 20 GROUP BY ALL)
        SELECT query_id, company, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, company DESC) AS b FROM n) WHERE b = 1 AND n >= 5""",
    "conflict_rates": f"""WITH {_R} SELECT query_id, round(sum(company_conflict) / count(*), 6) AS company_rate, round(sum(year_conflict) / count(*), 6) AS year_rate,
        round(sum(metric_conflict) / count(*), 6) AS metric_rate FROM cand GROUP BY query_id""",
}
