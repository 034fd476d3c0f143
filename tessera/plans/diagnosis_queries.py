"""Queries on what went wrong, on pairs of questions and candidates and on training rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diagnostics, graph, pairs, rerank, retrieval, support, training
from tessera.plans import evidence_queries as G
from tessera.plans import finance_queries as Q
from tessera.plans.retrieval_queries import table


def _matched(spark, d):
    """Candidates with what the questions name; gold is the question's company in 1995."""
    return Q._pairs(spark, d).withColumn("is_gold", (F.col("company") == Q._name("query_id")) & (F.col("filing_year") == "1995"))


def retrieval_errors(spark, d):
    x = _matched(spark, d)
    hit = x.filter("rank <= 10").groupBy("query_id").agg(F.max("is_gold").alias("hit"))
    first = x.filter("rank = 1").select("query_id", "q_companies", "q_years", "q_metrics", "q_filings", "text", "company", F.col("filing_year").alias("year"), F.col("metrics")[0].alias("metric"), F.col("filing_type").alias("filing"))
    e = diagnostics.retrieval_errors(first.join(hit, "query_id"))
    return e.select("query_id", F.array_join("errors", "|").alias("errors"))


def retrieval_error_counts(spark, d):
    e = retrieval_errors(spark, d).select(F.explode(F.split("errors", r"\|")).alias("error"))
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("queries"))


def path_diagnostics(spark, d):
    x = diagnostics.path_diagnostics(G._judged(spark, d).select("query_id", "chunk_id", "is_gold"), G._features(spark, d))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


def path_counts(spark, d):
    return G.typed_paths(spark, d).groupBy("path_type").agg(F.count(F.lit(1)).alias("paths"))


def gold_alignment(spark, d):
    wanted = table(spark, d, "nation").select(F.col("n_name").alias("query_id"))
    x = diagnostics.gold_alignment(wanted, G._judged(spark, d).filter("is_gold = 1").select("query_id"))
    return x.withColumn("coverage", F.round("coverage", 6))


def pair_features(spark, d):
    x = pairs.pair_features(Q._pairs(spark, d).withColumn("norm", retrieval.min_max(F.col("score"), "query_id")))
    return x.select("query_id", "chunk_id", F.round("norm", 6).alias("norm"), F.round(1 / F.col("rank"), 6).alias("reciprocal"), *[f"pair_{k}" for k in pairs.MATCHES], F.round("pair_entity", 6).alias("pair_entity"))


def entity_vectors(spark, d):
    v = pairs.entity_vector(Q._asked(spark, d), 7)
    return Q._asked(spark, d).select("query_id", *[F.round(v[i], 6).alias(f"v{i}") for i in range(7)])


def encoder_texts(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    e = pairs.encoder_text
    return t.select(
        "conv_id", "turn", F.md5(e(F.col("text"), "prefixed", "query")).alias("q"), F.md5(e(F.col("text"), "prefixed", "passage")).alias("p"),
        F.md5(e(F.col("text"), "instructed", "query", "Find it")).alias("i"), F.md5(e(F.col("text"), "plain", "query")).alias("r"),
    )


def strategy_negatives(spark, d):
    x = G._judged(spark, d).filter("is_gold = 0")
    rows = x.select("query_id", "chunk_id", F.col("metric_match").alias("metric_same"), F.col("year_match").alias("year_same"), (F.col("section") == "1-URGENT").cast("int").alias("section_same"))
    return training.strategy_negatives(rows, "query_id", "chunk_id", 12)


def margin_loss(spark, d):
    """Of each query's best gold against all of its other candidates, scores in millions."""
    x = G._judged(spark, d)
    gold = x.filter("is_gold = 1").groupBy("query_id").agg((F.max("score") / 1e6).alias("p"))
    other = x.filter("is_gold = 0").select("query_id", (F.col("score") / 1e6).alias("s"), "company_conflict", "year_conflict", "metric_conflict")
    loss = training.margin_loss(F.col("p"), F.col("s"), [F.col(c) for c in ("company_conflict", "year_conflict", "metric_conflict")], (0.5, 0.5))
    return other.join(gold, "query_id").groupBy("query_id").agg(F.round(loss, 6).alias("loss"))


def first_scores(spark, d):
    return training.first_scores(G._ranked(spark, d), "query_id", "chunk_id", 5).withColumn("score", F.round("score", 2))


def sampled_queries(spark, d):
    items = table(spark, d, "nation").select(F.col("n_name").alias("query_id"))
    s = lambda first: training.sampled_queries(items, "query_id", 7, first).withColumn("first", F.lit(int(first)))
    return s(True).union(s(False))


def subgraph_edges(spark, d):
    """Among the three best candidates of each query and their entities; every edge of a filing is there the other way, too."""
    e = G.graph_edges(spark, d)
    both = e.union(e.filter("edge_type = 'chunk-belongs-to-filing'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", (F.col("weight") / 2).alias("weight")))
    top = G._ranked(spark, d, 3).select(F.col("chunk_id").alias("node_id"))
    near = e.join(top, F.col("src") == F.col("node_id")).select(F.col("dst").alias("node_id"))
    x = graph.subgraph_edges(both, top.union(near))
    return x.withColumn("weight", F.round("weight", 4))


def _reports(spark, d):
    """Reports of nations as methods, each in one of four spellings, and a second source that doesn't count."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*map(F.lit, ("recall@10", "recall_at_10", "Recall@10", "evidence_recall.10"))), k % 4 + 1)
    row = lambda source, v: n.select(F.col("n_name").alias("method"), F.lit(source).alias("source"), F.create_map(name, v, F.lit("mrr"), v / 2).alias("values"))
    return row("a", k / 25.0).union(row("b", k * 0.0))


def merged_reports(spark, d):
    expected = {r: 0.5 for r in ("NATION_3", "NATION_12", "NATION_13")} | {"NATION_20": 0.75, "NATION_21": 0.7}
    return diagnostics.merged_reports(_reports(spark, d), ["recall@10", "mrr", "hit@10"], expected).select("method", F.col("`recall@10`").alias("recall"), "mrr", F.col("`hit@10`").alias("hit"), F.col("deviates").cast("int").alias("deviates"))


def _of_length():
    return lambda questions, texts: [float(len(t) - len(q)) for q, t in zip(questions, texts)]


def pair_scores(spark, d):
    """Ten best by a model from outside, here the difference of lengths; ties to the smaller id."""
    x = pairs.scored(Q._pairs(spark, d).select("query_id", "chunk_id", "question", "text"), "question", "text", _of_length, "model")
    return retrieval.top_k(x.select("query_id", "chunk_id", F.col("model").alias("score")), "query_id", "chunk_id", 10)


def _longest(question, texts):
    return max(range(len(texts)), key=lambda i: (len(texts[i]), -i))


def tournament(spark, d):
    """Ten best by tournaments in groups of five, here for the longest text, of equals the first."""
    return pairs.tournament(Q._pairs(spark, d).select("query_id", "chunk_id", "question", "text", "rank"), _longest, 5, 10)


def node_features(spark, d):
    """Ranked passages, the first 20 of a query as candidates, and three entities."""
    p = Q._pairs(spark, d)
    cols = ["query_id", "question", "q_companies", "q_years", "q_metrics"]
    rank = F.col("rank")
    chunks = p.select(*cols, F.col("chunk_id").alias("node_id"), "company", "filing_year", "text", F.when(rank <= 20, F.col("score")).alias("retrieval"), (1.0 / rank).alias("graph"))
    names = F.explode(F.array(F.lit("year::1995"), F.lit("metric::revenue"), F.concat(F.lit("company::"), Q._name("query_id"), F.lit(" Corp"))))
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    others = p.filter("rank = 1").select(*cols, names.alias("node_id"), null("string", "company"), null("string", "filing_year"), null("string", "text"), null("double", "retrieval"), null("double", "graph"))
    x = support.node_features(chunks.union(others))
    return x.select("query_id", "node_id", *[F.round(c, 6).alias(c) if c in ("node_retrieval", "node_graph", "node_overlap") else c for c in x.columns if c.startswith("node_") and c != "node_id"])


def completed_orders(spark, d):
    """A model that names each query's third, an unknown one and the first passage; every fourth query has no answer."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"])
    x = G._ranked(spark, d, 6).groupBy("query_id").agg(ids.alias("c")).join(table(spark, d, "nation").select(F.col("n_name").alias("query_id"), "n_nationkey"), "query_id")
    said = F.when(F.col("n_nationkey") % 4 != 0, F.array(F.get("c", F.lit(2)), F.lit("x"), F.get("c", F.lit(0))))
    return x.select("query_id", F.array_join(pairs.completed_order(said, F.col("c")), "|").alias("ids"))


def group_means(spark, d):
    """Matches by section, the first section as null, and the entropy of the three."""
    x = G._judged(spark, d).withColumn("section", F.when(F.col("section") != "1-URGENT", F.col("section")))
    names = ["company_match", "year_match", "metric_match"]
    return diagnostics.group_means(x.withColumns({f"s_{n}": F.col(n).cast("double") for n in names}), "section", names, [f"s_{n}" for n in names])


def path_arrays(spark, d):
    x = rerank.path_arrays(G.typed_paths(spark, d))
    return x.select("query_id", "chunk_id", *[F.array_join(c, ",").alias(c) for c in ("type_ids", "matches", "conflicts", "mask")])


def channel_adjacency(spark, d):
    """Among each query's first 30 passages: neighbours of one company, one year (semantic) and, with a made-up kind, one customer's segment (structural)."""
    p = support.match_flags(Q._pairs(spark, d)).filter("rank <= 30")
    nodes = p.select("query_id", F.col("chunk_id").alias("node_id"), support.semantic_factor(p).alias("factor"))
    pool = Q._passages(spark, d).join(nodes.select(F.col("node_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi")
    kinds = (("company", "same-company"), ("filing_year", "same-year"), ("filing_type", "follows"))
    every = [graph.same_edges(pool, c, kind) for c, kind in kinds]
    x = graph.channel_adjacency(every[0].union(every[1]).union(every[2]), nodes)
    return x.withColumn("value", F.round("value", 6))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_errors, retrieval_error_counts, path_diagnostics, path_counts, gold_alignment, pair_features, entity_vectors, encoder_texts, strategy_negatives,
        margin_loss, first_scores, sampled_queries, subgraph_edges, merged_reports, pair_scores, tournament, node_features, completed_orders, group_means, path_arrays, channel_adjacency,
    )
}

_RE = f"""WITH {Q._PR}, h AS (SELECT query_id, max((company = nm AND filing_year = '1995')::INT) AS hit FROM (SELECT query_id, rank, company, filing_year, nm FROM pr) WHERE rank <= 10 GROUP BY query_id),
  e AS (SELECT query_id, concat_ws('|', CASE WHEN hit = 0 THEN 'missing_evidence' END, CASE WHEN {Q._CO[0]} AND NOT {Q._CO[1]} THEN 'wrong_company' END,
    CASE WHEN len(qy) > 0 AND NOT list_contains(qy, filing_year) THEN 'wrong_year' END, CASE WHEN NOT list_contains(qm, metric) THEN 'wrong_metric' END,
    CASE WHEN len(qf) > 0 AND NOT list_contains(qf, filing_type) THEN 'wrong_filing' END) AS s FROM pr JOIN h USING (query_id) WHERE rank = 1),
  er AS (SELECT query_id, CASE WHEN s = '' THEN 'unclassifiable' ELSE s END AS errors FROM e)"""
_NEG = f"WITH {G._R}{G._JUD}"
_ZERO = "coalesce(round(avg({x}) FILTER (WHERE {of}), 6), 0)::DOUBLE AS {n}"
ORACLE_SQL = {
    "retrieval_errors": f"{_RE} SELECT query_id, errors FROM er",
    "retrieval_error_counts": f"{_RE} SELECT error, count(*)::BIGINT AS queries FROM (SELECT unnest(string_split(errors, '|')) AS error FROM er) GROUP BY error",
    "path_diagnostics": f"""WITH {G._R}, {G._E}{G._PATHS}{G._JUD}, np AS (SELECT query_id, chunk_id, count(*) AS n FROM paths GROUP BY ALL),
        x AS (SELECT jud.query_id, jud.chunk_id, is_gold, coalesce(n, 0) AS n, company_path, year_path, metric_path, greatest(pf.company_conflict, pf.year_conflict, pf.metric_conflict) AS bad
          FROM jud LEFT JOIN np USING (query_id, chunk_id) LEFT JOIN pf USING (query_id, chunk_id))
        SELECT {_ZERO.format(x='n', of='true', n='paths')}, {_ZERO.format(x='n', of='is_gold = 1', n='paths_of_gold')}, {_ZERO.format(x='n', of='is_gold = 0', n='paths_of_others')},
          {_ZERO.format(x='(n = 0)::INT', of='true', n='without_paths')}, {_ZERO.format(x='coalesce(company_path, 0)', of='is_gold = 1', n='gold_with_company')},
          {_ZERO.format(x='coalesce(year_path, 0)', of='is_gold = 1', n='gold_with_year')}, {_ZERO.format(x='coalesce(metric_path, 0)', of='is_gold = 1', n='gold_with_metric')},
          {_ZERO.format(x='coalesce(bad, 0)', of='is_gold = 0', n='others_in_conflict')} FROM x""",
    "path_counts": f"WITH {G._R}, {G._E}{G._PATHS} SELECT path_type, count(*)::BIGINT AS paths FROM paths GROUP BY path_type",
    "gold_alignment": f"""{_NEG} SELECT count(*)::BIGINT AS queries, count(g.query_id)::BIGINT AS aligned, (count(*) - count(g.query_id))::BIGINT AS unaligned, round(count(g.query_id) / count(*)::DOUBLE, 6) AS coverage
        FROM nation LEFT JOIN (SELECT DISTINCT query_id FROM jud WHERE is_gold = 1) g ON n_name = g.query_id""",
    "pair_features": f"""WITH {Q._PR}, m AS (SELECT query_id, chunk_id, round({G._MM.format(x='score', e='0.5')}, 6) AS norm, round(1.0::DOUBLE / rank, 6) AS reciprocal, ({Q._CO[0]} AND {Q._CO[1]})::INT AS pair_company,
          list_contains(qy, filing_year)::INT AS pair_year, list_contains(qm, metric)::INT AS pair_metric, list_contains(qf, filing_type)::INT AS pair_filing,
          (k % 3 = 0 AND contains(lower(section), 'risk'))::INT AS pair_section FROM pr WINDOW w AS (PARTITION BY query_id))
        SELECT *, round((pair_company + pair_year + pair_metric + pair_filing + pair_section) / 5.0::DOUBLE, 6) AS pair_entity FROM m""",
    "entity_vectors": f"""WITH {Q._P}{Q._Q} SELECT query_id, (len(qc) > 0)::INT::DOUBLE AS v0, len(qy) / 5.0::DOUBLE AS v1, len(qm) / 5.0::DOUBLE AS v2, (len(qf) > 0)::INT::DOUBLE AS v3,
        (len(qs) > 0)::INT::DOUBLE AS v4, 0::DOUBLE AS v5, 0::DOUBLE AS v6 FROM qe""",
    "encoder_texts": """SELECT conv_id, turn, md5('query: ' || text) AS q, md5('passage: ' || text) AS p, md5('Instruct: Find it' || chr(10) || 'Query: ' || text) AS i, md5(text) AS r FROM conversations""",
    "strategy_negatives": f"""{_NEG}, r AS (SELECT query_id, chunk_id, metric_match AS m, year_match AS y, (section = '1-URGENT')::INT AS s FROM jud WHERE is_gold = 0),
        b AS (SELECT query_id, chunk_id, 'same_metric_wrong_year' AS strategy FROM r WHERE m = 1 AND y = 0 UNION ALL SELECT query_id, chunk_id, 'same_year_wrong_metric' FROM r WHERE y = 1 AND m = 0
          UNION ALL SELECT query_id, chunk_id, 'same_section' FROM r WHERE s = 1 UNION ALL SELECT query_id, chunk_id, 'random_fallback' FROM r WHERE s = 0 AND m = y)
        SELECT query_id, chunk_id, strategy FROM (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY md5(query_id || '|' || chunk_id)) AS n FROM b) WHERE n <= 3""",
    "margin_loss": f"""{_NEG}, g AS (SELECT query_id, max(score) / 1e6::DOUBLE AS p FROM jud WHERE is_gold = 1 GROUP BY query_id)
        SELECT query_id, round(avg((1 + 0.5::DOUBLE * (company_conflict + year_conflict + metric_conflict)) * ln(1 + exp(score / 1e6::DOUBLE - p))) + 0.0005::DOUBLE, 6) AS loss
        FROM jud JOIN g USING (query_id) WHERE is_gold = 0 GROUP BY query_id""",
    "first_scores": f"""WITH {G._R} SELECT chunk_id, round(arg_min(score, query_id), 2) AS score FROM ranked50 WHERE query_id IN (SELECT DISTINCT query_id FROM ranked50 ORDER BY query_id LIMIT 5) GROUP BY chunk_id""",
    "sampled_queries": """SELECT * FROM (SELECT n_name AS query_id, 1 AS "first" FROM nation ORDER BY n_name LIMIT 7) UNION ALL SELECT * FROM (SELECT n_name, 0 FROM nation ORDER BY md5('42|' || n_name), n_name LIMIT 7)""",
    "subgraph_edges": f"""WITH {G._R}, {G._E}, t AS (SELECT DISTINCT chunk_id AS x FROM ranked50 WHERE rank <= 3), n AS (SELECT x FROM t UNION SELECT dst FROM edges JOIN t ON src = x),
        b AS (SELECT * FROM edges UNION ALL SELECT dst, src, edge_type, weight / 2 FROM edges WHERE edge_type = 'chunk-belongs-to-filing'),
        i AS (SELECT * FROM b WHERE src IN (SELECT x FROM n) AND dst IN (SELECT x FROM n))
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, edge_type, round(coalesce(max(weight) FILTER (WHERE i.src <= i.dst), max(weight)), 4) AS weight FROM i GROUP BY least(i.src, i.dst), greatest(i.src, i.dst), edge_type""",
    "merged_reports": """SELECT n_name AS method, round(n_nationkey / 25.0::DOUBLE, 4) AS recall, round(n_nationkey / 50.0::DOUBLE, 4) AS mrr, 0::DOUBLE AS hit,
        (n_name IN ('NATION_3', 'NATION_21'))::INT AS deviates FROM nation""",
    "pair_scores": f"""WITH {Q._PR}, x AS (SELECT query_id, chunk_id, (length(text) - length(question))::DOUBLE AS score FROM pr)
        SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM x) WHERE rank <= 10""",
    "tournament": f"""WITH {Q._PR} SELECT * FROM (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank))::INT AS rank FROM pr) WHERE rank <= 10""",
    "node_features": f"""WITH {Q._PR}, a AS (SELECT query_id, question, qc, qy, qm, nm, chunk_id AS node_id, company, filing_year, metric, text, CASE WHEN rank <= 20 THEN score END AS r, 1.0::DOUBLE / rank AS g FROM pr),
        c AS (SELECT query_id, node_id, (r IS NOT NULL)::INT AS node_candidate, CASE WHEN r IS NULL THEN 0 ELSE round({G._MM.format(x='r', e='0.5')}, 6) END::DOUBLE AS node_retrieval,
          round({G._MM.format(x='g', e='0.5')}, 6) AS node_graph, list_contains(qy, filing_year)::INT AS node_year, list_contains(qm, metric)::INT AS node_metric, ({Q._CO[0]} AND {Q._CO[1]})::INT AS node_company,
          round(len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) / len(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')))::DOUBLE, 6) AS node_overlap
          FROM a WINDOW w AS (PARTITION BY query_id))
        SELECT * FROM c UNION ALL SELECT query_id, v.n, 0, 0, 0, CASE WHEN v.i = 1 THEN list_contains(qy, '1995')::INT ELSE 0 END, CASE WHEN v.i = 2 THEN list_contains(qm, 'revenue')::INT ELSE 0 END,
          CASE WHEN v.i = 3 THEN list_contains(qc, nm || ' Corp')::INT ELSE 0 END, 0
          FROM (SELECT *, unnest([{{'i': 1, 'n': 'year::1995'}}, {{'i': 2, 'n': 'metric::revenue'}}, {{'i': 3, 'n': 'company::' || nm || ' Corp'}}]) AS v FROM pr WHERE rank = 1)""",
    "completed_orders": f"""WITH {G._R}, c AS (SELECT query_id, list(chunk_id ORDER BY rank) AS c FROM ranked50 WHERE rank <= 6 GROUP BY query_id)
        SELECT query_id, array_to_string(CASE WHEN n_nationkey % 4 = 0 THEN c ELSE [c[3], 'x', c[1]] || list_filter(c, lambda v: v <> c[3] AND v <> c[1]) END, '|') AS ids FROM c JOIN nation ON n_name = query_id""",
    "group_means": f"""{_NEG} SELECT CASE WHEN section = '1-URGENT' THEN 'unknown' ELSE section END AS section, count(*)::BIGINT AS "rows", round(avg(company_match), 4) AS company_match, round(avg(year_match), 4) AS year_match,
        round(avg(metric_match), 4) AS metric_match, round(avg(CASE WHEN company_match + year_match + metric_match > 0 THEN ln(company_match + year_match + metric_match) ELSE 0 END), 4) AS entropy FROM jud GROUP BY 1""",
    "path_arrays": f"""WITH {G._R}, {G._E}{G._PATHS}, o AS (SELECT *, CASE path_type WHEN 'chunk_metric' THEN 3 WHEN 'chunk_year' THEN 4 WHEN 'company_filing_section' THEN 5 WHEN 'conflict' THEN 6 WHEN 'filing_section' THEN 7 ELSE 8 END AS t FROM paths),
        l AS (SELECT query_id, chunk_id, list(t ORDER BY path_type, target, kind) AS t, list(is_match ORDER BY path_type, target, kind) AS m, list(is_conflict ORDER BY path_type, target, kind) AS k FROM o GROUP BY ALL)
        SELECT query_id, chunk_id, array_to_string(list_resize(t, 8, 0), ',') AS type_ids, array_to_string(list_resize(m, 8, 0), ',') AS matches, array_to_string(list_resize(k, 8, 0), ',') AS conflicts,
          array_to_string(list_resize(list_transform(t, lambda v: 1), 8, 0), ',') AS mask FROM l""",
    "channel_adjacency": f"""WITH {Q._PR}, nd AS (SELECT query_id, chunk_id, CASE WHEN {Q._CO[0]} AND NOT {Q._CO[1]} THEN 0.35::DOUBLE ELSE 1 END * CASE WHEN len(qy) > 0 AND NOT list_contains(qy, filing_year) THEN 0.4::DOUBLE ELSE 1 END
          * CASE WHEN NOT list_contains(qm, metric) THEN 0.5::DOUBLE ELSE 1 END AS f FROM pr WHERE rank <= 30),
        po AS (SELECT * FROM ps WHERE chunk_id IN (SELECT chunk_id FROM nd)),
        k AS (SELECT chunk_id, 'same-company' AS t, 'semantic' AS ch, 0.5::DOUBLE AS w, company AS v FROM po UNION ALL SELECT chunk_id, 'same-year', 'semantic', 0.5, filing_year FROM po UNION ALL SELECT chunk_id, 'follows', 'structural', 1, filing_type FROM po),
        l AS (SELECT *, lead(chunk_id, 1) OVER o AS n1, lead(chunk_id, 2) OVER o AS n2 FROM k WINDOW o AS (PARTITION BY t, v ORDER BY chunk_id)),
        e AS (SELECT chunk_id AS s, n1 AS d, t, ch, w FROM l WHERE n1 IS NOT NULL UNION ALL SELECT chunk_id, n2, t, ch, w FROM l WHERE n2 IS NOT NULL),
        q1 AS (SELECT a.query_id, ch, t, s, d, w * CASE WHEN ch = 'semantic' THEN greatest(a.f * b.f, 0.05) ELSE 1 END AS w FROM e JOIN nd a ON a.chunk_id = s JOIN nd b ON b.chunk_id = d AND b.query_id = a.query_id),
        m AS (SELECT query_id, ch, t, s, d, max(w) AS w FROM (SELECT * FROM q1 UNION ALL SELECT query_id, ch, t, d, s, w FROM q1) GROUP BY ALL),
        g AS (SELECT query_id, t, s AS x, sum(w) + 1e-8::DOUBLE AS g FROM m GROUP BY ALL)
        SELECT m.query_id, ch AS channel, m.t AS edge_type, s AS src, d AS dst, round(w / (sqrt(a.g) * sqrt(b.g)), 6) AS value FROM m JOIN g a ON a.query_id = m.query_id AND a.t = m.t AND a.x = s JOIN g b ON b.query_id = m.query_id AND b.t = m.t AND b.x = d""",
}
