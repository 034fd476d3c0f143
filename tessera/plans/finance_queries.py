"""Queries over financial questions and passages, with their SQL.

Questions and passages are written from rows: a nation is a company that asks
for itself, an order a passage that reports a metric, a sum and a year.  So
entities are read from text, in three vocabularies, on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import evidence_sets as S
from tessera.operators import expansion, generation, graph, retrieval, support
from tessera.operators.durable import broadcast_if_small
from tessera.plans import answer_queries as A
from tessera.plans.evidence_queries import _ranked
from tessera.plans.retrieval_queries import table


def _name(c: str):
    """A capitalised word of letters."""
    plain = F.translate(c, "_0123456789", "xabcdefghij")
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 100)))


def _questions(spark, d):
    n = table(spark, d, "nation").withColumn("nm", _name("n_name"))
    kind = F.col("n_nationkey") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("How did revenue of "), "nm", F.lit(" Corp change from 1994 to 1995 in the 10-K risk factors?")))
        .when(kind == 1, F.concat(F.lit("What was net income of "), "nm", F.lit(" Group in FY1995?")))
        .otherwise(F.concat(F.lit("Compare cash flow and revenue, "), F.lower("nm")))
    )
    return n.select(F.col("n_name").alias("query_id"), text.alias("question"))


def _passages(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation").withColumn("nm", _name("n_name"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    metric = F.when(F.col("o_orderstatus") == "F", "revenue").when(F.col("o_orderstatus") == "O", "net income").otherwise("cash flow")
    year = F.year("o_orderdate").cast("string")
    return x.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"),
        F.col("nm").alias("company"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "10-K").otherwise("10-Q").alias("filing_type"),
        year.alias("filing_year"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Item 1A Risk Factors").otherwise("Item 7").alias("section"),
        F.array(metric).alias("metrics"),
        F.col("o_orderkey").alias("word_offset"),
        (F.col("o_orderstatus") == "F").alias("is_table"),
        F.concat("nm", F.lit(" Corp reported "), metric, F.lit(" of $"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" million in "), year, F.lit(".")).alias("text"),
    )


def _asked(spark, d):
    return support.with_question(_questions(spark, d), "question")


def _pairs(spark, d):
    """Questions with their ranked passages, and the entities of both."""
    x = _passages(spark, d).join(broadcast_if_small(_ranked(spark, d)), "chunk_id").join(_asked(spark, d), "query_id")
    return support.with_passage(x, "text")


# --- entities and features of text


def compares_years(spark, d):
    t = A._texts(spark, d).union(_questions(spark, d).select(F.concat(F.lit("q"), "query_id"), "question"))
    return t.select("id", E.compares_years(F.col("text")).cast("int").alias("comparison"))


def scoring_entities(spark, d):
    e = E.scoring_entities(F.col("text"))
    t = _passages(spark, d).select(F.col("chunk_id").alias("id"), "text").union(_questions(spark, d).select("query_id", "question"))
    return t.select("id", *[F.array_join(F.array_sort(v), "|").alias(k) for k, v in e.items()])


def negative_metrics(spark, d):
    t = _passages(spark, d).select(F.col("chunk_id").alias("id"), "text").union(_questions(spark, d).select("query_id", "question"))
    return t.select("id", F.array_join(F.array_sort(E.metrics(F.col("text"), E.NEGATIVE_METRICS)), "|").alias("metrics"))


def question_features(spark, d):
    f = support.question_features(F.col("question"))
    names = ("years", "metrics", "companies", "words", "numeric", "comparing", "changing", "filing", "section", "vague")
    k = support.known_entities(F.col("question"))
    known = [k[i].alias(f"has_{n}") for i, n in enumerate(("company", "year", "metric"))]
    return _questions(spark, d).select("query_id", *[F.round(f[i], 6).alias(n) for i, n in enumerate(names)], *known)


def named_sections(spark, d):
    q = F.col("question")
    return _questions(spark, d).select("query_id", F.array_join(E.sections_named(q), "|").alias("sections"), F.array_join(E.years_with_ends(q), "|").alias("years"), E.spaced(F.col("query_id")).alias("spaced"))


def company_overlap(spark, d):
    p = _pairs(spark, d)
    both = E.companies_overlap(F.col("q_companies"), F.array(F.concat("company", F.lit(" Corp"))))
    return p.select("query_id", "chunk_id", both.cast("int").alias("company_same"), E.clear_year_conflict(F.col("q_years"), F.col("t_years")).cast("int").alias("year_conflict"))


def support_features(spark, d):
    seed = _passages(spark, d).select("chunk_id", F.col("doc_id").alias("seed_doc_id"), F.col("section").alias("seed_section"), F.col("word_offset").alias("seed_word_offset"))
    first = _ranked(spark, d, 1).select("query_id", "chunk_id").join(seed, "chunk_id").drop("chunk_id")
    x = support.support_features(_pairs(spark, d).join(first, "query_id").withColumn("alignment", F.lit(0.75)))
    names = [c for c in x.columns if c.endswith("_support")]
    return x.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) if c in ("overlap_support", "adjacent_support") else c for c in names])


def conflict_features(spark, d):
    x = support.conflict_features(_pairs(spark, d))
    return x.select("query_id", "chunk_id", *[c for c in x.columns if c.endswith("_against")])


def match_flags(spark, d):
    x = support.match_flags(_pairs(spark, d))
    names = [c for c in x.columns if c.endswith(("_hit", "_miss"))]
    return x.select("query_id", "chunk_id", *names, F.round(support.semantic_factor(x), 6).alias("factor"))


def conflict_negatives(spark, d):
    x = support.conflict_negatives(support.conflict_features(_pairs(spark, d)))
    return x.select("query_id", "chunk_id", F.array_join("conflicts", "|").alias("conflicts"))


# --- expansion


def _seeds(spark, d):
    return _ranked(spark, d, 15)


def _router(spark, d):
    """A probability for each query and relation, from the nation's key."""
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(i).alias("i")) for i, r in enumerate(expansion.PRIOR)])).alias("r")
    x = table(spark, d, "nation").select(F.col("n_name").alias("query_id"), F.col("n_nationkey").alias("k"), names)
    return x.select("query_id", "r.relation", ((F.col("k") * 7 + F.col("r.i") * 13) % 20 / 20.0).alias("probability"))


def _semantic(spark, d):
    """Edges between the orders of a customer that follow one another, as neighbours."""
    return graph.same_edges(_passages(spark, d), "doc_id", "semantic-similar", "word_offset")


def _claims(e):
    return e.select("query_id", "chunk_id", "seed_id", F.round("priority", 6).alias("priority"))


def expand_document(spark, d):
    return _claims(expansion.same_filing(_seeds(spark, d), _passages(spark, d), _questions(spark, d), 10))


def expand_company_year(spark, d):
    return _claims(expansion.same_company_year(_seeds(spark, d), _passages(spark, d), _asked(spark, d), 10))


def expand_metric(spark, d):
    return _claims(expansion.same_metric(_seeds(spark, d), _passages(spark, d), _asked(spark, d), 10))


def expand_year(spark, d):
    return _claims(expansion.same_year(_seeds(spark, d), _passages(spark, d), _asked(spark, d), 10))


def expand_semantic(spark, d):
    return _claims(expansion.along_edges(_seeds(spark, d), _semantic(spark, d), 5))


def expansion_budgets(spark, d):
    return expansion.budgets(_router(spark, d), 20)


def _expanded(spark, d):
    return expansion.expand(_ranked(spark, d), _passages(spark, d), _asked(spark, d), _semantic(spark, d), _router(spark, d), initial=30)


def expand_all(spark, d):
    return _expanded(spark, d).select("query_id", "chunk_id", "is_initial", "relations", F.round("priority", 6).alias("priority"), "position")


def expansion_diagnostics(spark, d):
    gold = _passages(spark, d).filter((F.col("filing_year") == "1995") & F.col("is_table")).join(table(spark, d, "nation").select(F.col("n_name").alias("query_id"), _name("n_name").alias("company")), "company")
    return expansion.diagnostics(_expanded(spark, d), gold, _questions(spark, d))


# --- answers


def _answers(spark, d):
    """A question's first five passages as evidence; the answer is the second's text, gold the first's."""
    x = _ranked(spark, d, 5).join(_passages(spark, d).select("chunk_id", "text"), "chunk_id")
    rows = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("e"))
    n = F.length("query_id") % 4
    answer = F.when(n == 0, F.lit("Insufficient evidence. Nothing is said.")).when(n == 1, F.lit("")).when(n == 2, F.col("e")[0]["text"]).otherwise(F.concat(F.col("e")[1]["text"], F.lit(" Margin was 5.")))
    return rows.select(
        "query_id", answer.alias("answer"), F.col("e")[0]["text"].alias("gold"), F.array_join(F.transform("e", lambda r: r["text"]), " ").alias("evidence"),
        F.transform("e", lambda r: r["chunk_id"]).alias("retrieved"), F.when(n == 3, F.array().cast("array<string>")).otherwise(F.array(F.col("e")[2]["chunk_id"], F.lit("none"))).alias("gold_ids"),
    )


def _judged(spark, d):
    return generation.judged_answers(_answers(spark, d), "answer", "gold", "evidence", "retrieved", "gold_ids")


def judged_answers(spark, d):
    return _judged(spark, d).drop("answer", "gold", "evidence", "retrieved", "gold_ids")


def judged_summary(spark, d):
    return generation.judged_summary(_judged(spark, d), "answer")


def answer_rates(spark, d):
    x = A._pairs(spark, d).withColumns({"c": (F.length("answer") % 2) == 0, "h": (F.length("question") % 3) == 0})
    return generation.answer_rates(x, "answer", "question", "c", "h")


def json_answers(spark, d):
    """Answers in four states of repair, written from the events' numbers."""
    k = F.col("event_id") % 4
    n = F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"answer": "a'), n, F.lit('", "citations": ["x", "y"], "confidence": "high"}')))
        .when(k == 1, F.concat(F.lit('Here it is:\n```json\n{"answer": "b'), n, F.lit('"}\n```')))
        .when(k == 2, F.concat(F.lit('So {"answer": "c'), n, F.lit('", "citations": ["z",],} it is')))
        .otherwise(F.concat(F.lit("no answer "), n))
    )
    g = generation.parse_generator(raw)
    x = table(spark, d, "events").select("event_id", g.alias("g"))
    return x.select("event_id", "g.answer", F.array_join("g.citations", "|").alias("citations"), "g.confidence")


def evidence_budget(spark, d):
    x = _ranked(spark, d, 20).join(_passages(spark, d).select("chunk_id", "text"), "chunk_id")
    e = generation.budgeted_evidence(x.select("query_id", "chunk_id", "rank", "text"), "query_id", 10, 120)
    return e.select("query_id", "chunk_id", "rank", "tokens", "truncated")


def text_fallback(spark, d):
    """A document's own text if its number is even, a conversation's turn if there is one, else a placeholder."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), "text")
    turns = table(spark, d, "conversations").filter(F.col("turn") == 0).select(F.col("conv_id").alias("k"), "text").groupBy("k").agg(F.min("text").alias("text"))
    x = generation.first_text(docs.select("k"), [docs.filter(F.col("k") % 2 == 0), turns], "k")
    return x.select("k", F.md5("text").alias("text_md5"))


def error_examples(spark, d):
    p = A._pairs(spark, d).withColumn("kind", F.length("answer") % 5)
    return generation.examples(p.withColumn("o", F.concat_ws("-", "conv_id", "turn")), "kind", "o").select("kind", "conv_id", "turn")


# --- evidence sets


def _profiles(spark, d):
    x = _pairs(spark, d).withColumns({
        "companies": F.array(F.concat("company", F.lit(" Corp"))), "years": F.array("filing_year"), "filings": F.array("filing_type"),
        "sections": F.array(F.when(F.col("section") == "Item 7", "item 7").otherwise("risk factors")),
        "retrieval": retrieval.min_max(F.col("score"), "query_id", 1.0), "prior": 1 - (F.col("rank") - 1) / 49.0, "graph": F.col("word_offset") % 10 / 10.0,
    })
    return S.passage_scores(S.profile_scores(x.drop("score")))


def passage_scores(spark, d):
    x = _profiles(spark, d)
    return x.select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("coverage", "conflict", "score")])


def _links(spark, d):
    return _semantic(spark, d).select("src", "dst")


def candidate_connectivity(spark, d):
    c = S.connectivity(_ranked(spark, d), _links(spark, d))
    return c.select("query_id", "chunk_id", F.round("coherence", 6).alias("coherence"))


def _set_seeds(spark, d, most):
    x = _profiles(spark, d).join(S.connectivity(_ranked(spark, d), _links(spark, d)), ["query_id", "chunk_id"])
    return S.seeds(x, most)


def seed_ranking(spark, d):
    return _set_seeds(spark, d, 5).select("query_id", "chunk_id", F.round("seed_score", 6).alias("seed_score"), "seed_rank")


def set_scores(spark, d):
    x = S.set_scores(_set_seeds(spark, d, 4), _links(spark, d))
    return x.select("query_id", "passages", *[F.round(c, 6).alias(c) for c in (*S.SET, "final")], "wrong_company", "wrong_year", "wrong_metric")


def set_summary(spark, d):
    x = S.set_scores(_set_seeds(spark, d, 4), _links(spark, d))
    return S.set_summary(x, table(spark, d, "nation").select(F.col("n_name").alias("query_id"), (F.col("n_nationkey") % 4 / 4.0).alias("share")).filter("share > 0"))


def conflict_sets(spark, d):
    base = _set_seeds(spark, d, 3).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed_rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return S.conflict_sets(_profiles(spark, d), base).select("query_id", "name", F.array_join("ids", "|").alias("ids"))


QUERIES = {
    f.__name__: f
    for f in (
        compares_years, scoring_entities, negative_metrics, question_features, named_sections, company_overlap, support_features, conflict_features,
        match_flags, conflict_negatives, expand_document, expand_company_year, expand_metric, expand_year, expand_semantic, expansion_budgets,
        expand_all, expansion_diagnostics, judged_answers, judged_summary, answer_rates, json_answers, evidence_budget, text_fallback,
        error_examples, passage_scores, candidate_connectivity, seed_ranking, set_scores, set_summary, conflict_sets,
    )
}

# --- SQL -----------------------------------------------------------------------------------------------------------

_NM = "upper(substr(n_name, 1, 1)) || lower(substr(translate(n_name, '_0123456789', 'xabcdefghij'), 2))"
_P = f"""
n AS MATERIALIZED (SELECT *, {_NM} AS nm FROM nation),
ps AS MATERIALIZED (SELECT 'o' || o_orderkey AS chunk_id, 'c' || o_custkey AS doc_id, nm AS company, n_regionkey AS region,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '10-K' ELSE '10-Q' END AS filing_type, year(o_orderdate)::VARCHAR AS filing_year,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Item 1A Risk Factors' ELSE 'Item 7' END AS section,
  CASE o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'net income' ELSE 'cash flow' END AS metric, o_orderkey AS word_offset, o_orderstatus = 'F' AS is_table,
  nm || ' Corp reported ' || (CASE o_orderstatus WHEN 'F' THEN 'revenue' WHEN 'O' THEN 'net income' ELSE 'cash flow' END) || ' of $' || o_totalprice::DECIMAL(12,2)::VARCHAR
    || ' million in ' || year(o_orderdate) || '.' AS text, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey),
q AS MATERIALIZED (SELECT n_name AS query_id, n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'How did revenue of ' || nm || ' Corp change from 1994 to 1995 in the 10-K risk factors?'
  WHEN 1 THEN 'What was net income of ' || nm || ' Group in FY1995?' ELSE 'Compare cash flow and revenue, ' || lower(nm) END AS question FROM n)"""
#: What the questions name, worked out by hand: metrics, years, companies, filings, sections.
_Q = """,
qe AS MATERIALIZED (SELECT q.*, CASE k % 3 WHEN 0 THEN ['revenue'] WHEN 1 THEN ['net income'] ELSE ['cash flow', 'revenue'] END AS qm,
  CASE k % 3 WHEN 0 THEN ['1994', '1995'] WHEN 1 THEN ['1995'] ELSE []::VARCHAR[] END AS qy,
  CASE k % 3 WHEN 0 THEN [nm || ' Corp'] WHEN 1 THEN [nm || ' Group'] ELSE []::VARCHAR[] END AS qc,
  CASE k % 3 WHEN 0 THEN ['10-K'] ELSE []::VARCHAR[] END AS qf, CASE k % 3 WHEN 0 THEN ['risk factors'] ELSE []::VARCHAR[] END AS qs, nm FROM q JOIN n ON n_name = query_id)"""
_K = """,
rk AS MATERIALIZED (SELECT * FROM (SELECT n_name AS query_id, chunk_id, value AS score,
  (row_number() OVER (PARTITION BY n_name ORDER BY round(value, 8) DESC, chunk_id))::INT AS rank FROM ps JOIN n ON region = n_regionkey) WHERE rank <= 50)"""
_PR = _P + _Q + _K + """,
pr AS MATERIALIZED (SELECT rk.query_id, rk.score, rk.rank, ps.*, qe.question, qm, qy, qc, qf, qs, qe.nm, qe.k FROM rk JOIN ps USING (chunk_id) JOIN qe USING (query_id))"""
_CO = "(len(qc) > 0)", "(contains(lower(qc[1]), lower(company)) OR contains(lower(company), lower(qc[1])))"
_SEEDS = _P + _Q + _K + """,
sd AS MATERIALIZED (SELECT query_id, chunk_id AS seed_id, score AS seed_score, rank AS seed_rank FROM rk WHERE rank <= 15),
sp AS MATERIALIZED (SELECT sd.*, ps.doc_id AS s_doc, ps.section AS s_sec, ps.company AS s_com, ps.filing_year AS s_yr, ps.word_offset AS s_off FROM sd JOIN ps ON chunk_id = seed_id)"""
_PICK = """,
{n}_1 AS (SELECT query_id, chunk_id, seed_id, seed_rank, {prior}::DOUBLE * sign(seed_score) / seed_rank / {far} * bonus AS priority FROM {n}_r ANTI JOIN (SELECT query_id, seed_id AS chunk_id FROM sd) USING (query_id, chunk_id)),
{n} AS MATERIALIZED (SELECT query_id, chunk_id, '{rel}' AS relation, seed_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(priority, 10) DESC, seed_rank, seed_id) AS one FROM {n}_1) WHERE one = 1)"""


def _rel(n: str, rel: str, prior: float, far: int, rows: str) -> str:
    return f",\n{n}_r AS ({rows})" + _PICK.format(n=n, rel=rel, prior=prior, far=float(far))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''))"
_DOC = _rel("doc", "same_filing", 0.75, 2, f"""SELECT sp.*, ps.chunk_id, CASE WHEN is_table THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN section = s_sec THEN 1.0::DOUBLE ELSE 0.8 END
  * (1 + least(len(list_intersect({_WORDS.format(t='question')}, {_WORDS.format(t='text')})) / len({_WORDS.format(t='question')}), 0.5)) AS bonus
  FROM sp JOIN q USING (query_id) JOIN ps ON doc_id = s_doc AND ps.chunk_id <> seed_id""")
_CY = _rel("cy", "same_company_year", 0.9, 2, """SELECT sp.*, ps.chunk_id, CASE WHEN list_contains(qm, metric) THEN 1.5::DOUBLE ELSE 1 END AS bonus
  FROM sp JOIN qe USING (query_id) JOIN ps ON company = s_com AND filing_year = s_yr AND ps.chunk_id <> seed_id""")
_MT = _rel("mt", "same_metric", 0.85, 3, """SELECT sp.*, ps.chunk_id, CASE WHEN company = s_com THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN filing_year = s_yr THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN doc_id = s_doc THEN 1.1::DOUBLE ELSE 1 END AS bonus
  FROM sp JOIN qe USING (query_id) JOIN ps ON list_contains(qm, metric)""")
_YR = _rel("yr", "same_year", 0.65, 3, """SELECT sp.*, ps.chunk_id, CASE WHEN company = s_com THEN 1.5::DOUBLE WHEN doc_id = s_doc THEN 1.2 ELSE 1 END AS bonus
  FROM sp JOIN qe USING (query_id) JOIN ps ON filing_year = s_yr AND ps.chunk_id <> seed_id WHERE len(qy) > 0""")
_LINKS = """,
ln0 AS (SELECT chunk_id, lead(chunk_id, 1) OVER w AS a, lead(chunk_id, 2) OVER w AS b FROM ps WINDOW w AS (PARTITION BY doc_id ORDER BY word_offset)),
ln AS MATERIALIZED (SELECT chunk_id AS src, a AS dst FROM ln0 WHERE a IS NOT NULL UNION ALL SELECT chunk_id, b FROM ln0 WHERE b IS NOT NULL),
l2 AS MATERIALIZED (SELECT src, dst FROM ln UNION ALL SELECT dst, src FROM ln)"""
_SE = _LINKS + _rel("se", "semantic_similar", 0.5, 2, "SELECT sd.*, dst AS chunk_id, 0.3::DOUBLE AS bonus FROM sd JOIN l2 ON src = seed_id")
_AD = """, po AS (SELECT chunk_id, section, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_offset, chunk_id) AS i FROM ps)""" + _rel(
    "ad", "adjacent_chunk", 1.0, 2, """SELECT sd.*, b.chunk_id, CASE WHEN a.section = b.section THEN 1.0::DOUBLE ELSE 0.5 END AS bonus
  FROM sd JOIN po a ON a.chunk_id = seed_id JOIN po b ON a.doc_id = b.doc_id AND abs(a.i - b.i) IN (1, 2)""")
_SC = _rel("sc", "same_section", 0.9, 2, """SELECT sp.*, ps.chunk_id, 1 / (1 + abs(word_offset - s_off) / 1000.0::DOUBLE) AS bonus FROM sp JOIN ps ON doc_id = s_doc AND section = s_sec AND ps.chunk_id <> seed_id""")
_TOP = "SELECT query_id, chunk_id, seed_id, round(priority, 6) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(priority, 10) DESC, chunk_id) AS b FROM {n}) WHERE b <= {k}"


def _budgets(total: int) -> str:
    """Shares, first budgets and what the cap gives back; then units taken one at a time from the largest."""
    return f""",
rt AS (SELECT query_id, r.relation, (k * 7 + r.i * 13) % 20 / 20.0::DOUBLE AS probability FROM q, (VALUES ('adjacent_chunk', 0), ('same_section', 1), ('same_filing', 2),
  ('same_company_year', 3), ('same_metric', 4), ('same_year', 5), ('semantic_similar', 6)) r(relation, i)),
b1 AS (SELECT *, probability / sum(probability) OVER (PARTITION BY query_id) * {total} AS share FROM rt WHERE probability >= 0.1),
b2 AS (SELECT *, CASE WHEN share >= 0.5 THEN greatest(1, round_even(least(share, 10), 0)) ELSE 0 END::INT AS f FROM b1),
b3 AS (SELECT *, sum(greatest(share - 10, 0)) OVER (PARTITION BY query_id) AS excess, sum((share < 10 AND f > 0)::INT) OVER (PARTITION BY query_id) AS opens FROM b2),
b4 AS (SELECT query_id, relation, CASE WHEN excess > 0.5 AND share < 10 AND f > 0 THEN least(10, f + greatest(1, round_even(excess / greatest(opens, 1), 0)::INT)) ELSE f END AS b FROM b3),
u AS (SELECT query_id, relation, unnest(range(1, b + 1)) AS unit FROM b4),
u1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY unit, relation DESC) AS place FROM u),
bud AS MATERIALIZED (SELECT query_id, relation, count(*)::INT AS budget FROM u1 WHERE unit = 1 OR place <= {total} GROUP BY ALL)"""


_ALL = _SEEDS + _DOC + _CY + _MT + _YR + _SE + _AD + _SC + _budgets(40) + """,
ev AS (SELECT * FROM (SELECT e.*, budget, row_number() OVER (PARTITION BY query_id, relation ORDER BY round(priority, 10) DESC, chunk_id) AS b FROM (SELECT * FROM doc UNION ALL SELECT * FROM cy
  UNION ALL SELECT * FROM mt UNION ALL SELECT * FROM yr UNION ALL SELECT query_id, chunk_id, relation, seed_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(priority, 10) DESC, chunk_id) AS b5 FROM se) WHERE b5 <= 5 UNION ALL SELECT * FROM ad UNION ALL SELECT * FROM sc) e JOIN bud USING (query_id, relation)) WHERE b <= budget),
un AS (SELECT query_id, chunk_id, true AS is_initial, NULL AS relation, 0.0::DOUBLE AS priority, score FROM rk WHERE rank <= 30 UNION ALL SELECT query_id, chunk_id, false, relation, priority, 0 FROM ev),
gr AS (SELECT query_id, chunk_id, bool_or(is_initial) AS is_initial, coalesce(string_agg(DISTINCT relation, ',' ORDER BY relation), '') AS relations, max(priority) AS priority, max(score) AS score FROM un GROUP BY ALL),
ex AS MATERIALIZED (SELECT * FROM (SELECT query_id, chunk_id, is_initial, relations, priority, (row_number() OVER (PARTITION BY query_id ORDER BY is_initial DESC, round(priority, 10) DESC, round(score, 10) DESC, chunk_id))::INT AS position FROM gr) WHERE position <= 80)"""
_JU = _P + _K + """,
to5 AS (SELECT query_id, list(chunk_id ORDER BY rank) AS c, list(text ORDER BY rank) AS t FROM rk JOIN ps USING (chunk_id) WHERE rank <= 5 GROUP BY query_id),
an AS MATERIALIZED (SELECT query_id, CASE length(query_id) % 4 WHEN 0 THEN 'Insufficient evidence. Nothing is said.' WHEN 1 THEN '' WHEN 2 THEN t[1] ELSE t[2] || ' Margin was 5.' END AS answer, t[1] AS gold,
  array_to_string(t, ' ') AS evidence, c, CASE WHEN length(query_id) % 4 = 3 THEN []::VARCHAR[] ELSE [c[3], 'none'] END AS gids FROM to5),
a1 AS MATERIALIZED (SELECT *, regexp_matches(answer, '(?i)^\\s*insufficient[\\s_]+evidence\\b') AS out, """ + f"{A._na('answer')} AS na, {A._na('gold')} AS ng, {A._num('answer')} AS nu, {A._num('gold')} AS gu, {A._num('evidence')} AS eu, {A._yr('answer')} AS ya, {A._yr('evidence')} AS ye," + f"""
  {_WORDS.format(t='answer')} AS wa, {_WORDS.format(t='evidence')} AS we FROM an),
a2 AS MATERIALIZED (SELECT *, list_distinct(list_transform(nu, lambda x: {A._nn('x')})) AS nun, list_transform(gu, lambda x: {A._nn('x')}) AS gun, list_distinct(list_transform(eu, lambda x: {A._nn('x')})) AS eun, {A._ts('na')} AS ta, {A._ts('ng')} AS tg FROM a1),
ju AS MATERIALIZED (SELECT query_id, answer, out::INT AS abstained,
  CASE WHEN NOT out THEN CASE WHEN na = ng THEN 1.0::DOUBLE WHEN na <> '' AND ng <> '' AND (contains(na, ng) OR contains(ng, na) OR len(list_intersect(ta, tg)) >= 0.8 * len(tg)) THEN 0.5 ELSE 0 END END AS score,
  CASE WHEN NOT out THEN CASE WHEN len(gu) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(nu, lambda x: list_contains(gun, {A._nn('x')}))) / len(gu), 6) END END AS consistency,
  CASE WHEN NOT out THEN round(CASE WHEN len(nun) = 0 THEN CASE WHEN len(wa) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(wa, we)) / len(wa) END ELSE len(list_intersect(nun, eun)) / len(nun) END, 6) END AS faithfulness,
  CASE WHEN NOT out THEN CASE WHEN len(nun) = 0 THEN len(wa) > 0 AND len(list_intersect(wa, we)) / len(wa) < 0.3 ELSE len(list_intersect(nun, eun)) / len(nun) < 0.5 OR (len(ya) > 0 AND len(ye) > 0 AND NOT list_has_any(ya, ye)) END END::INT AS unsupported,
  CASE WHEN NOT out THEN len(list_filter(nu, lambda x: NOT list_contains(eun, {A._nn('x')}) AND len(list_filter(eu, lambda m: coalesce(abs({A._nv('x')} - {A._nv('m')}) / greatest(abs({A._nv('m')}), 1) < 0.01, false))) = 0)) > 0 END::INT AS arithmetic,
  CASE WHEN NOT out THEN (len(ye) > 0 AND len(list_filter(ya, lambda y: NOT list_contains(ye, y))) > 0)::INT END AS wrong_year,
  CASE WHEN NOT out THEN (len(list_filter(['revenue', 'revenues', 'income', 'profit', 'loss', 'eps', 'ebitda', 'ebit', 'margin', 'cost', 'expense', 'asset', 'liability', 'equity', 'cash flow', 'dividend', 'roe', 'roa', 'roi', 'pe ratio'],
    lambda m: contains(lower(answer), m) AND NOT contains(lower(evidence), m))) > 0)::INT END AS wrong_metric,
  CASE WHEN len(gids) > 0 THEN 1 END AS hit, CASE WHEN len(gids) > 0 THEN 0.5::DOUBLE END AS recall, CASE WHEN len(gids) > 0 THEN 0 END AS all_gold, CASE WHEN len(gids) > 0 THEN 0.333333::DOUBLE END AS mrr FROM a2)"""
_PF = _PR + """,
f1 AS (SELECT *, [company || ' Corp'] AS companies, [filing_year] AS years, [metric] AS metrics, [filing_type] AS filings, [CASE WHEN section = 'Item 7' THEN 'item 7' ELSE 'risk factors' END] AS sections,
  1 - (rank - 1) / 49.0::DOUBLE AS prior, word_offset % 10 / 10.0::DOUBLE AS graph,
  CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS retrieval FROM pr WINDOW w AS (PARTITION BY query_id)),
f2 AS (SELECT * EXCLUDE (score), (len(qc) > 0 AND NOT list_has_any(qc, companies))::INT AS wrong_company, (len(qy) > 0 AND NOT list_has_any(qy, years))::INT AS wrong_year, (len(qm) > 0 AND NOT list_has_any(qm, metrics))::INT AS wrong_metric,
  (CASE WHEN len(qc) > 0 THEN len(list_intersect(qc, companies)) / len(qc) ELSE 0 END + CASE WHEN len(qy) > 0 THEN len(list_intersect(qy, years)) / len(qy) ELSE 0 END + CASE WHEN len(qm) > 0 THEN len(list_intersect(qm, metrics)) / len(qm) ELSE 0 END
   + CASE WHEN len(qf) > 0 THEN len(list_intersect(qf, filings)) / len(qf) ELSE 0 END + CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, sections)) / len(qs) ELSE 0 END)
   / ((len(qc) > 0)::INT + (len(qy) > 0)::INT + (len(qm) > 0)::INT + (len(qf) > 0)::INT + (len(qs) > 0)::INT) AS coverage FROM f1),
f3 AS (SELECT *, (wrong_company + wrong_year + wrong_metric) / 3.0::DOUBLE AS conflict FROM f2),
f4 AS (SELECT *, round(0.35::DOUBLE * retrieval + 0.45::DOUBLE * graph + 0.2::DOUBLE * greatest(0, coverage - conflict), 10) AS raw FROM f3),
pf AS MATERIALIZED (SELECT *, CASE WHEN max(raw) OVER w = min(raw) OVER w THEN 1.0::DOUBLE ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS score FROM f4 WINDOW w AS (PARTITION BY query_id))""" + _LINKS
_CN = """,
cn AS MATERIALIZED (SELECT c.query_id, c.chunk_id, (SELECT count(DISTINCT dst) FROM l2 JOIN rk o ON o.query_id = c.query_id AND o.chunk_id = l2.dst WHERE l2.src = c.chunk_id AND l2.dst <> c.chunk_id) / greatest(count(*) OVER (PARTITION BY c.query_id) - 1, 1) AS coherence FROM rk c)"""
_SD = _PF + _CN + """,
se0 AS (SELECT pf.*, coherence, round(0.25::DOUBLE * (0.8::DOUBLE * score + 0.2::DOUBLE * prior) + 0.45::DOUBLE * coverage + 0.2::DOUBLE * coherence - 0.35::DOUBLE * conflict, 8) AS seed_score FROM pf JOIN cn USING (query_id, chunk_id)),
seeds AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY seed_score DESC, chunk_id DESC))::INT AS seed_rank FROM se0)"""
_COV = " + ".join(f"CASE WHEN len({q}) > 0 THEN len(list_intersect({q}, list_distinct(flatten(list({p}))))) / len({q}) ELSE 0 END" for q, p in (("any_value(qc)", "companies"), ("any_value(qy)", "years"), ("any_value(qm)", "metrics"), ("any_value(qf)", "filings"), ("any_value(qs)", "sections")))
_SAME = " + ".join(f"list_has_any(a.{p}, b.{p})::INT" for p in S.KINDS)
_SS = _SD + f""",
m AS MATERIALIZED (SELECT * FROM seeds WHERE seed_rank <= 4),
mg AS (SELECT query_id, count(*) AS passages, avg(0.8::DOUBLE * score + 0.2::DOUBLE * prior) AS relevance, avg(conflict) AS conflict, max(wrong_company) AS wrong_company, max(wrong_year) AS wrong_year, max(wrong_metric) AS wrong_metric,
  ({_COV}) / ((len(any_value(qc)) > 0)::INT + (len(any_value(qy)) > 0)::INT + (len(any_value(qm)) > 0)::INT + (len(any_value(qf)) > 0)::INT + (len(any_value(qs)) > 0)::INT) AS coverage FROM m GROUP BY query_id),
pa AS (SELECT a.query_id, avg(({_SAME}) / 5.0::DOUBLE) AS redundancy, avg(CASE WHEN EXISTS (SELECT 1 FROM l2 WHERE src = a.chunk_id AND dst = b.chunk_id) THEN 1.0::DOUBLE ELSE 0 END) AS coherence FROM m a JOIN m b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id GROUP BY a.query_id),
ss AS MATERIALIZED (SELECT *, greatest(0, (passages - 3) / 5.0::DOUBLE) AS size FROM mg JOIN pa USING (query_id))"""
_TXQ = A._TXT + ", " + _P.strip() + ", tq AS (SELECT * FROM txt UNION ALL SELECT 'q' || query_id, question FROM q)"
_FT = _P + ", ft AS (SELECT chunk_id AS id, text FROM ps UNION ALL SELECT query_id, question FROM q)"
_CMP = "(?i)from\\s+(?:FY\\s*)?(?:19|20)[0-9]{2}\\s+to\\s+(?:FY\\s*)?(?:19|20)[0-9]{2}|between\\s+(?:FY\\s*)?(?:19|20)[0-9]{2}\\s+and\\s+(?:FY\\s*)?(?:19|20)[0-9]{2}|change\\s+(?:from\\s+)?(?:FY\\s*)?(?:19|20)[0-9]{2}|compared\\s+to\\s+(?:FY\\s*)?(?:19|20)[0-9]{2}|from\\s+[0-9]{2,4}\\s*[-–]\\s*[0-9]{2,4}|(?:19|20)[0-9]{2}\\s*[-–]\\s*(?:19|20)[0-9]{2}|(?:growth|increase|decrease|trend)\\s+(?:from|since)\\s+(?:19|20)[0-9]{2}|delta\\s+in\\s+.*?[0-9]{2,4}\\s*[-–]\\s*[0-9]{2,4}|YoY|year[-\\s]over[-\\s]year|year[-\\s]on[-\\s]year"
_SQL_PIECES = "list_sort(list_distinct(list_transform(regexp_extract_all(text, '{p}', {g}), lambda x: {f})))"


def _found(p: str, g: int = 0, f: str = "lower(trim(x))") -> str:
    return "coalesce(array_to_string(" + _SQL_PIECES.format(p=p, g=g, f=f) + ", '|'), '')"


ORACLE_SQL = {
    "compares_years": f"WITH {_TXQ} SELECT id, (regexp_matches(text, '{_CMP}') OR len({A._yr('text')}) >= 2)::INT AS comparison FROM tq",
    "scoring_entities": f"""WITH {_FT} SELECT id, {_found("(?i)" + E.SCORING_METRICS[0])} AS metrics, {_found("((?:19|20)[0-9]{2})" .join(["\\b", "\\b"]), 1, "x")} AS years,
        {_found(E.SCORING_FILINGS, 0, "x")} AS filings, {_found(E.SCORING_COMPANIES, 1)} AS companies FROM ft""",
    "negative_metrics": f"""WITH {_FT} SELECT id, {_found("(?i)" + "|".join(E.NEGATIVE_METRICS))} AS metrics FROM ft""",
    "question_features": f"""WITH {_P}{_Q} SELECT query_id, len(qy) / 5.0::DOUBLE AS years, len(qm) / 5.0::DOUBLE AS metrics, round(len(qc) / 3.0::DOUBLE, 6) AS companies,
        round(len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) / 50.0::DOUBLE, 6) AS words, (k % 3 < 2)::INT::DOUBLE AS numeric, (k % 3 = 2)::INT::DOUBLE AS comparing, (k % 3 = 0)::INT::DOUBLE AS changing,
        (k % 3 = 0)::INT::DOUBLE AS filing, (k % 3 = 0)::INT::DOUBLE AS section, 0::DOUBLE AS vague, (len(qc) > 0)::INT AS has_company, (len(qy) > 0)::INT AS has_year, 1 AS has_metric FROM qe""",
    "named_sections": f"WITH {_P}{_Q} SELECT query_id, coalesce(array_to_string(qs, '|'), '') AS sections, coalesce(array_to_string(qy, '|'), '') AS years, lower(replace(query_id, '_', ' ')) AS spaced FROM qe",
    "company_overlap": f"""WITH {_PR} SELECT query_id, chunk_id, (len(qc) > 0 AND (qc[1] = company || ' Corp' OR string_split(qc[1], ' ')[1] = company OR string_split(qc[1], ' ')[2] = 'Corp'))::INT AS company_same,
        (CASE WHEN len(qy) = 0 THEN true ELSE len(list_filter(qy, lambda y: abs(y::INT - filing_year::INT) <= 1)) = 0 END)::INT AS year_conflict FROM pr""",
    "support_features": f"""WITH {_PR}, s AS (SELECT query_id, doc_id AS sdoc, section AS ssec, word_offset AS soff FROM pr WHERE rank = 1)
        SELECT query_id, chunk_id, ({_CO[0]} AND {_CO[1]})::INT AS company_support, list_contains(qy, filing_year)::INT AS filing_year_support, list_contains(qy, filing_year)::INT AS year_text_support,
          list_contains(qm, metric)::INT AS metric_support, list_contains(qf, filing_type)::INT AS filing_type_support, (len(qs) > 0 AND contains(lower(section), 'risk factors'))::INT AS section_support,
          round(len(list_intersect({_WORDS.format(t='question')}, {_WORDS.format(t='text')})) / len({_WORDS.format(t='question')}), 6) AS overlap_support, (doc_id = sdoc)::INT AS same_filing_support,
          (doc_id = sdoc AND section = ssec)::INT AS same_section_support, CASE WHEN doc_id = sdoc AND abs(word_offset - soff) < 1000 THEN round(1 / (1 + abs(word_offset - soff) / 100.0::DOUBLE), 6) ELSE 0 END AS adjacent_support,
          0.75::DOUBLE AS route_support FROM pr JOIN s USING (query_id)""",
    "conflict_features": f"""WITH {_PR} SELECT query_id, chunk_id, ({_CO[0]} AND NOT {_CO[1]})::INT AS company_against, (len(qy) > 0 AND NOT list_contains(qy, filing_year))::INT AS year_against,
        (NOT list_contains(qm, metric))::INT AS metric_against, (len(qf) > 0 AND NOT list_contains(qf, filing_type))::INT AS filing_type_against, (len(qs) > 0 AND NOT contains(lower(section), 'risk factors'))::INT AS section_against FROM pr""",
    "match_flags": f"""WITH {_PR}, f AS (SELECT query_id, chunk_id, ({_CO[0]} AND {_CO[1]})::INT AS company_hit, list_contains(qy, filing_year)::INT AS year_hit, list_contains(qm, metric)::INT AS metric_hit,
          list_contains(qf, filing_type)::INT AS filing_hit, (len(qs) > 0 AND contains(lower(section), 'risk factors'))::INT AS section_hit, ({_CO[0]} AND NOT {_CO[1]})::INT AS company_miss,
          (len(qy) > 0 AND NOT list_contains(qy, filing_year))::INT AS year_miss, (NOT list_contains(qm, metric))::INT AS metric_miss FROM pr)
        SELECT *, round(greatest(0.05::DOUBLE, CASE WHEN company_miss = 1 THEN 0.35::DOUBLE ELSE 1 END * CASE WHEN year_miss = 1 THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN metric_miss = 1 THEN 0.5::DOUBLE ELSE 1 END), 6) AS factor FROM f""",
    "conflict_negatives": f"""WITH {_PR}, f AS (SELECT query_id, chunk_id, concat_ws('|', CASE WHEN {_CO[0]} AND NOT {_CO[1]} THEN 'company' END, CASE WHEN len(qy) > 0 AND NOT list_contains(qy, filing_year) THEN 'year' END,
          CASE WHEN NOT list_contains(qm, metric) THEN 'metric' END) AS conflicts FROM pr) SELECT * FROM f WHERE conflicts <> ''""",
    "expand_document": f"WITH {_SEEDS}{_DOC} {_TOP.format(n='doc', k=10)}",
    "expand_company_year": f"WITH {_SEEDS}{_CY} {_TOP.format(n='cy', k=10)}",
    "expand_metric": f"WITH {_SEEDS}{_MT} {_TOP.format(n='mt', k=10)}",
    "expand_year": f"WITH {_SEEDS}{_YR} {_TOP.format(n='yr', k=10)}",
    "expand_semantic": f"WITH {_SEEDS}{_SE} {_TOP.format(n='se', k=5)}",
    "expansion_budgets": f"WITH {_P}{_budgets(20)} SELECT query_id, relation, budget FROM bud",
    "expand_all": f"WITH {_ALL} SELECT query_id, chunk_id, is_initial, relations, round(priority, 6) AS priority, position FROM ex",
    "expansion_diagnostics": f"""WITH {_ALL}, go AS (SELECT n_name AS query_id, chunk_id FROM ps JOIN n ON company = nm WHERE filing_year = '1995' AND is_table), gn AS (SELECT query_id, count(*) AS golds FROM go GROUP BY ALL),
        pe AS (SELECT query_id, sum(is_initial::INT) AS a, sum((NOT is_initial)::INT) AS b, sum((is_initial AND go.chunk_id IS NOT NULL)::INT) AS ga, sum((go.chunk_id IS NOT NULL)::INT) AS gb FROM ex LEFT JOIN go USING (query_id, chunk_id) GROUP BY query_id)
        SELECT count(*)::BIGINT AS queries, round(avg(coalesce(a, 0)), 4) AS initial, round(avg(coalesce(b, 0)), 4) AS expanded, round(avg(coalesce(ga / golds, 0)), 4) AS recall_before, round(avg(coalesce(gb / golds, 0)), 4) AS recall_after,
          sum((coalesce(gb, 0) > coalesce(ga, 0))::INT)::BIGINT AS queries_with_new_gold FROM q LEFT JOIN pe USING (query_id) LEFT JOIN gn USING (query_id)""",
    "judged_answers": f"WITH {_JU} SELECT * EXCLUDE (answer) FROM ju",
    "judged_summary": f"""WITH {_JU} SELECT count(*)::BIGINT AS answers, sum(abstained)::BIGINT AS abstained, sum((trim(answer) = '' AND abstained = 0)::INT)::BIGINT AS api_errors,
        {", ".join(f"round(avg({c}), 6) AS {c}" for c in ("score", "consistency", "faithfulness", "unsupported", "arithmetic", "wrong_year", "wrong_metric", "hit", "recall", "all_gold", "mrr"))} FROM ju""",
    "answer_rates": f"""WITH {A._PAIR}, x AS (SELECT *, regexp_replace(regexp_replace(lower(trim(answer)), '[.]+$', ''), '\\s+', ' ', 'g') AS a, regexp_replace(regexp_replace(lower(trim(question)), '[.]+$', ''), '\\s+', ' ', 'g') AS g FROM pairs),
        y AS (SELECT *, {A._ts('a')} AS ta, {A._ts('g')} AS tg FROM x)
        SELECT count(*)::BIGINT AS answers, round(avg((a = g)::INT), 6) AS exact_match, round(avg(CASE WHEN len(ta) = 0 OR len(tg) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(ta, tg)) / (len(ta) + len(tg)) END), 6) AS f1,
          round(avg((length(answer) % 2 = 0)::INT), 6) AS consistency, round(avg((length(question) % 3 = 0)::INT), 6) AS hallucination, round(avg(contains(upper(answer), 'INSUFFICIENT_EVIDENCE')::INT), 6) AS insufficient FROM y""",
    "json_answers": """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN substr('abc', (event_id % 4 + 1)::INT, 1) || event_id END AS answer, CASE event_id % 4 WHEN 0 THEN 'x|y' WHEN 2 THEN 'z' ELSE '' END AS citations,
        CASE WHEN event_id % 4 = 0 THEN 'high' ELSE 'medium' END AS confidence FROM events""",
    "evidence_budget": f"""WITH RECURSIVE {_P}{_K}, t AS (SELECT query_id, chunk_id, rank, greatest(1, length(text) // 4)::INT AS tokens FROM rk JOIN ps USING (chunk_id) WHERE rank <= 10),
        f AS (SELECT *, tokens <= 120 AS kept, CASE WHEN tokens <= 120 THEN tokens ELSE 0 END::BIGINT AS used FROM t WHERE rank = 1
          UNION ALL SELECT t.*, f.used + t.tokens <= 120, f.used + CASE WHEN f.used + t.tokens <= 120 THEN t.tokens ELSE 0 END FROM f JOIN t ON t.query_id = f.query_id AND t.rank = f.rank + 1)
        SELECT query_id, chunk_id, rank, tokens, truncated FROM f JOIN (SELECT query_id, NOT bool_and(kept) AS truncated FROM f GROUP BY query_id) USING (query_id) WHERE kept""",
    "text_fallback": """SELECT doc_id AS k, md5(coalesce(CASE WHEN doc_id % 2 = 0 AND trim(d.text) <> '' THEN d.text END, CASE WHEN trim(c.text) <> '' THEN c.text END, '[text not available]')) AS text_md5
        FROM documents d LEFT JOIN (SELECT conv_id, min(text) AS text FROM conversations WHERE turn = 0 GROUP BY conv_id) c ON c.conv_id = d.doc_id""",
    "error_examples": f"""WITH {A._PAIR} SELECT kind, conv_id, turn FROM (SELECT (length(answer) % 5)::INT AS kind, conv_id, turn, row_number() OVER (PARTITION BY length(answer) % 5 ORDER BY conv_id || '-' || turn) AS n FROM pairs) WHERE n <= 3""",
    "passage_scores": f"WITH {_PF} SELECT query_id, chunk_id, round(coverage, 6) AS coverage, round(conflict, 6) AS conflict, round(score, 6) AS score FROM pf",
    "candidate_connectivity": f"WITH {_P}{_K}{_LINKS}{_CN} SELECT query_id, chunk_id, round(coherence, 6) AS coherence FROM cn",
    "seed_ranking": f"WITH {_SD} SELECT query_id, chunk_id, round(seed_score, 6) AS seed_score, seed_rank FROM seeds WHERE seed_rank <= 5",
    "set_scores": f"""WITH {_SS} SELECT query_id, passages, round(relevance, 6) AS relevance, round(coverage, 6) AS coverage, round(coherence, 6) AS coherence, round(redundancy, 6) AS redundancy, round(conflict, 6) AS conflict, round(size, 6) AS size,
        round(0.25::DOUBLE * relevance + 0.4::DOUBLE * coverage + 0.2::DOUBLE * coherence - 0.1::DOUBLE * redundancy - 0.35::DOUBLE * conflict - 0.02::DOUBLE * size, 6) AS final, wrong_company, wrong_year, wrong_metric FROM ss""",
    "set_summary": f"""WITH {_SS} SELECT round(avg(n_nationkey % 4 / 4.0::DOUBLE), 6) AS gold_coverage, round(avg(coverage), 6) AS entity_coverage, round(avg(greatest(wrong_company, wrong_year, wrong_metric)), 6) AS conflict_rate,
        round(avg(redundancy), 6) AS redundancy_rate FROM ss JOIN nation ON n_name = query_id""",
    "conflict_sets": f"""WITH {_SD}, b AS (SELECT query_id, list(chunk_id ORDER BY seed_rank) AS ids FROM seeds WHERE seed_rank <= 3 GROUP BY query_id),
        x AS (SELECT query_id, chunk_id, rank, unnest(['wrong_year', 'wrong_metric', 'wrong_company']) AS name, unnest([wrong_year, wrong_metric, wrong_company]) AS flag FROM pf),
        c AS (SELECT query_id, name, arg_min(chunk_id, rank) AS c FROM x WHERE flag = 1 GROUP BY ALL)
        SELECT query_id, name, array_to_string(list_concat([c], list_filter(ids, lambda i: i <> c)), '|') AS ids FROM c JOIN b USING (query_id)
        UNION ALL SELECT query_id, 'redundant', array_to_string(list_concat(ids, ids[1:1]), '|') FROM b""",
}
