import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment, expansion, generation, graph, metrics, models, rerank, retrieval, support, training


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hybrid_counts_a_missing_side_as_zero(spark):
    a = spark.createDataFrame([("q", "x", 2.0), ("q", "y", 1.0)], "q string, d string, score double")
    b = spark.createDataFrame([("q", "z", 5.0)], "q string, d string, score double")
    got = {r["d"]: r["score"] for r in retrieval.hybrid(a, b, "d", "q", 3).collect()}
    assert got == {"x": 0.5, "y": 0.0, "z": 0.25}


@pytest.mark.parametrize("equal", [0.5, 1.0])
def test_min_max(spark, equal):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 3.0)], "q string, score double")
    got = rows(df.select("q", retrieval.min_max(F.col("score"), "q", equal).alias("s")))
    assert got == [("a", 0.0), ("a", 1.0), ("b", equal)]


def test_metric_profiles(spark):
    ranked = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1)], "q string, d string, rank int")
    gold = spark.createDataFrame([("q1", "b")], "q string, d string")
    queries = spark.createDataFrame([("q1",), ("q2",)], "q string")
    per = metrics.per_query(ranked, gold, queries, "q", "d", (2,))
    every, some = metrics.summary(per).first(), metrics.summary(per, "gold_only").first()
    assert (every["queries"], every["recall"], every["mrr"]) == (2, 0.5, 0.25)
    assert (some["queries"], some["recall"], some["mrr"], some["precision"]) == (1, 1.0, 0.5, 0.5)


def test_bidirectional_takes_the_largest_weight(spark):
    e = spark.createDataFrame([("a", "b", 0.8), ("a", "b", 0.5), ("b", "a", 0.2)], "src string, dst string, weight double")
    assert rows(graph.bidirectional(e)) == [("a", "b", 0.8), ("b", "a", 0.8)]


def test_pagerank_of_both_kinds_agrees_with_a_dense_solution(spark):
    pairs = [("s", "a", 1.0), ("a", "s", 1.0), ("a", "b", 2.0), ("b", "a", 2.0), ("b", "c", 1.0)]
    e = spark.createDataFrame(pairs, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("q", "s")], "query_id string, node_id string")
    names = ["s", "a", "b", "c"]
    m = np.zeros((4, 4))
    for u, v, w in pairs:
        m[names.index(u), names.index(v)] = w
    restart = np.array([1.0, 0, 0, 0])
    p = np.vstack([r / r.sum() if r.sum() else restart for r in m])
    want = np.linalg.solve(np.eye(4) - 0.85 * p.T, 0.15 * restart)
    for got in (graph.pagerank(e, seeds, 60), graph.pagerank_converged(e.withColumn("query_id", F.lit("q")), seeds, most=300, tolerance=1e-12)):
        score = {r["node_id"]: r["score"] for r in got.collect()}
        assert np.allclose([score[n] for n in names], want, atol=1e-3)


def test_k_hop_follows_out_edges(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "src string, dst string")
    got = rows(graph.k_hop(e, spark.createDataFrame([("a",)], "node_id string"), 2))
    assert got == [("a", "a"), ("a", "b"), ("a", "c")]


def test_knn_edges_match_brute_force(spark):
    v = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n @ n.T - 9 * np.eye(60)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.3}
    assert {(r["src"], r["dst"]) for r in graph.knn_edges(df, "id", "v", 3, 0.3, block=25).collect()} == want


def test_missing_entities_are_no_conflict(spark):
    schema = "query_id string, chunk_id string, " + ", ".join(f"{p}{k} array<string>" for k in ("companies", "years", "metrics") for p in ("q_", ""))
    data = [("q", "a", ["acme"], ["acme"], ["2023"], ["2022"], ["m"], []), ("q", "b", [], ["x"], [], [], [], [])]
    got = rows(rerank.match_features(spark.createDataFrame(data, schema)).select("chunk_id", "company_match", "year_match", "year_conflict", "metric_conflict"))
    assert got == [("a", 1, 0, 1, 0), ("b", 0, 0, 0, 0)]


def test_floored_weights_sum_to_one(spark):
    w = rerank.floored_weights([F.lit(0.0), F.lit(0.0), F.lit(4.0)], [0.15, 0.35, 0.0])
    got = spark.range(1).select(w.alias("w")).first()["w"]
    assert got[:2] == [0.15, 0.35] and abs(sum(got) - 1) < 1e-9


def test_expansion_skips_seeds_and_rates_distance(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "s" if i < 3 else "t", i) for i in range(6)], "chunk_id string, doc_id string, section string, word_offset int")
    seeds = spark.createDataFrame([("q", "c1", 2.0, 1), ("q", "c2", 1.0, 2)], "query_id string, chunk_id string, score double, rank int")
    got = {r["chunk_id"]: (r["seed_id"], r["priority"]) for r in expansion.adjacent(seeds, chunks).collect()}
    assert got == {"c0": ("c1", 0.5), "c3": ("c1", 0.25), "c4": ("c2", 0.125)}


def budget_one_by_one(relations, total, most=10, least=0.1):
    """Units taken one at a time from the largest budget, ties to the first name."""
    chosen = {r: p for r, p in relations if p >= least}
    whole = sum(chosen.values())
    share = {r: p / whole * total for r, p in chosen.items()}
    out = {r: max(1, round(min(v, most))) if v >= 0.5 else 0 for r, v in share.items()}
    excess, open_ = sum(max(v - most, 0) for v in share.values()), [r for r in out if share[r] < most and out[r]]
    if excess > 0.5 and open_:
        out |= {r: min(most, out[r] + max(1, round(excess / len(open_)))) for r in open_}
    while sum(out.values()) > total and max(out.values()) > 1:
        out[min(r for r in out if out[r] == max(out.values()))] -= 1
    return {r: n for r, n in out.items() if n}


def test_budgets(spark):
    cases = {
        "none": [("a", 0.05)], "one": [("a", 1.0)], "capped": [("a", 0.9), ("b", 0.1)], "many": [("a", 0.6), ("b", 0.3), ("c", 0.05), ("d", 0.2)],
        "even": [(r, 0.5) for r in "abcdefg"], "steep": [("a", 0.99), ("b", 0.98), ("c", 0.97), ("d", 0.1), ("e", 0.1)],
    }
    df = spark.createDataFrame([(q, r, p) for q, rs in cases.items() for r, p in rs], "query_id string, relation string, probability double")
    for total in (3, 12, 30):
        got = {}
        for q, r, n in rows(expansion.budgets(df, total)):
            got.setdefault(q, {})[r] = n
        for q, rs in cases.items():
            want = {} if q == "none" else budget_one_by_one(rs, total)
            assert got.get(q, {}) == want, (q, total)


def test_year_expansion_needs_a_year_in_the_question_and_relations_merge_under_the_cap(spark):
    names = "chunk_id string, doc_id string, section string, company string, filing_year string, word_offset int, is_table boolean, metrics array<string>, text string"
    chunks = spark.createDataFrame([(f"c{i}", f"d{i // 3}", "s", f"co{i % 2}", f"202{i % 3}", i, False, ["revenue"], f"revenue {i}") for i in range(12)], names)
    ranked = spark.createDataFrame([(q, f"c{i}", 9.0 - i, i + 1) for q in ("with", "without") for i in range(3)], "query_id string, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([("with", "revenue in 2021", ["2021"], ["revenue"]), ("without", "revenue", [], ["revenue"])], "query_id string, question string, q_years array<string>, q_metrics array<string>")
    years = rows(expansion.same_year(ranked, chunks, asked).select("query_id").distinct())
    assert years == [("with",)]
    router = spark.createDataFrame([(q, r, 0.5) for q in ("with", "without") for r in expansion.PRIOR], "query_id string, relation string, probability double")
    edges = spark.createDataFrame([("c0", "c11", 0.5)], "src string, dst string, weight double")
    out = expansion.expand(ranked, chunks, asked, edges, router, total=14, cap=7)
    got = out.filter("query_id = 'with'").orderBy("position").collect()
    assert len(got) == 7 and [r["is_initial"] for r in got] == [True] * 3 + [False] * 4
    assert any("," in r["relations"] for r in got) and all(r["chunk_id"] != "c12" for r in got)


def test_conflicts_need_both_sides_and_the_filing_outranks_the_text(spark):
    names = "question string, text string, company string, filing_year string, filing_type string, section string"
    x = spark.createDataFrame(
        [("What was revenue of Acme Corp in 2020?", "revenue fell in 2020", "Acme", "2019", "10-K", "Item 7"), ("What was revenue?", "net income in 2020", "Acme", "2019", "10-K", "Item 7"),
         ("Acme Corp in 2020, 10-Q item 1a", "x", "Other", None, None, None), ("in 2020", "in 2019", None, "", None, None)], names)
    y = support.conflict_features(support.with_passage(support.with_question(x, "question"), "text"))
    got = [tuple(r[c] for c in ("company_against", "year_against", "metric_against", "filing_type_against", "section_against")) for r in y.collect()]
    assert got == [(0, 1, 0, 0, 0), (0, 0, 1, 0, 0), (1, 0, 0, 0, 0), (0, 1, 0, 0, 0)]


def test_answers_against_evidence(spark):
    names = "answer string, gold string, evidence string, retrieved array<string>, gold_ids array<string>"
    x = spark.createDataFrame([("Insufficient evidence. None", "5", "e", ["a"], ["a"]), ("It was $5.5 in 2020", "$5.5", "$5.5 in 2019", ["a", "b"], ["b", "c"]), ("no words here", "x", "other text", [], [])], names)
    got = generation.judged_answers(x, "answer", "gold", "evidence", "retrieved", "gold_ids").collect()
    assert got[0]["abstained"] == 1 and got[0]["score"] is None and got[0]["hit"] == 1 and got[0]["mrr"] == 1.0
    assert (got[1]["score"], got[1]["unsupported"], got[1]["wrong_year"], got[1]["recall"], got[1]["mrr"]) == (0.5, 1, 1, 0.5, 0.5)
    assert (got[2]["faithfulness"], got[2]["unsupported"], got[2]["hit"]) == (0.0, 1, None)


def test_json_in_any_state(spark):
    raw = ['{"answer": "a"}', 'x ```json\n{"answer": "b"}\n``` y', 'so {"answer": "c",} end', "{'answer': 'd'}", "nothing", None, ""]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r["g"]["answer"] for r in df.select(generation.parse_generator(F.col("r")).alias("g")).collect()] == ["a", "b", "c", "d", None, None, None]


def test_containment_either_way_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [rng.choice("abcde") * rng.randint(1, 3) for _ in range(400)]
    docs = [(i, " ".join(words[i * 7 : i * 7 + rng.randint(1, 40)])) for i in range(40)] + [(90, None), (91, " ")]
    items = [(100 + i, " ".join(words[a : a + rng.randint(1, 30)])[rng.randint(0, 1) :]) for i, a in enumerate(range(0, 300, 9))] + [(900, ""), (901, None)]
    got = rows(alignment.contained(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(items, "i long, text string"), "d", "i"))
    flat = lambda t: " ".join((t or "").split())
    want = sorted((i, d) for d, t in docs for i, e in items if flat(t) and flat(e) and (flat(e) in flat(t) or flat(t) in flat(e)))
    assert sorted(got) == want


def test_token_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 8), ("q", 2, 5), ("q", 3, 2)], "q string, rank int, tokens int")
    assert rows(generation.token_budget(df, "q", "rank", "tokens", 10).select("rank")) == [(1,), (3,)]


def test_numbers_as_documented(spark):
    want = {"10.2 billion": ["10.2"], "5%": ["5"], "2023": [], "1000 million": ["1000 million"], "1,234.5": ["1,234.5"], "1234": [], "1500%": ["1500%"]}
    for text, numbers in want.items():
        assert spark.range(1).select(generation.numbers(F.lit(text)).alias("n")).first()["n"] == numbers, text


def test_abstention_has_no_scores(spark):
    df = spark.createDataFrame([("insufficient evidence", "100 million"), ("Revenue is 100 million.", "100 million")], "a string, g string")
    got = generation.evaluate_answers(df, "a", "g").select("answered", "f1", "relaxed").collect()
    assert tuple(got[0]) == (0, None, None) and got[1]["answered"] == 1 and got[1]["relaxed"] == 1


def test_json_in_answers(spark):
    schema = "answer string, ids array<string>"
    for raw in ('{"answer": "x", "ids": ["1"]}', 'Sure:\n```json\n{"answer": "x", "ids": ["1"]}\n```', 'so {"answer": "x", "ids": ["1",],} it is'):
        got = spark.range(1).select(generation.parse_json(F.lit(raw), schema).alias("x")).first()["x"]
        assert got["answer"] == "x" and got["ids"] == ["1"], raw


def test_training_rows(spark):
    j = spark.createDataFrame([("q", "a", 1, 0), ("q", "b", 2, 1), ("q", "c", 3, 0)], "q string, d string, rank int, is_gold int")
    assert rows(training.train_pairs(j, "q", "d", 1)) == [("q", "b", "a")]
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 4))
    w = training.fit_pairwise(base + [1, 0, 0, 0], base, epochs=200)
    assert w[0] > 10 * abs(w[1:]).max()


def test_graph_models_have_the_right_shape_and_use_edges(spark):
    rng = np.random.default_rng(3)
    x, a = rng.normal(size=(4, 6)), np.array([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0.0]])
    w, head = rng.normal(size=(6, 6)), rng.normal(size=6)
    assert models.gcn(x, a, [w], head).shape == (4,)
    assert not np.allclose(models.gcn(x, a, [w], head), models.gcn(x, 0 * a, [w], head))
    assert np.allclose(models.rgcn(x, [a, 0 * a], [(w, [w, w], np.zeros(6))], head), models.rgcn(x, [a], [(w, [w], np.zeros(6))], head))
    assert models.gatv2(x, a, w, w, rng.normal(size=6)).shape == (4, 6)
    nodes = spark.createDataFrame([("q", f"n{i}", [float(v) for v in x[i]]) for i in range(4)], "query_id string, node_id string, features array<double>")
    edges = spark.createDataFrame([("q", "n0", "n1", 1.0)], "query_id string, src string, dst string, weight double")
    got = {r["node_id"]: r["score"] for r in models.score_subgraphs(nodes, edges, lambda f, adj: models.gcn(f, adj, [w], head)).collect()}
    assert np.allclose([got[f"n{i}"] for i in range(4)], models.gcn(x, a, [w], head))


def _evidence(spark):
    """Three seeds of one query among 400 chunks of 40 documents."""
    rng = np.random.default_rng(7)
    data = []
    for i in range(400):
        doc = int(rng.integers(40))
        names = ["revenue", "cash flow", "eps"]
        data.append((f"c{i:03d}", f"d{doc}", f"co{doc % 3}" if doc % 7 else None, str(1994 + int(rng.integers(3))), [names[k] for k in range(3) if rng.random() < 0.6]))
    chunks = spark.createDataFrame(data, "chunk_id string, doc_id string, company string, filing_year string, metrics array<string>")
    seeds = spark.createDataFrame([("q", "c005", 3.0, 1), ("q", "c017", 2.0, 2), ("p", "c100", -1.0, 1), ("p", "c300", 1.0, 2)], "query_id string, chunk_id string, score double, rank int")
    asked = spark.createDataFrame([("q", "", ["1995"], ["revenue", "eps"]), ("p", "", ["1994"], ["cash flow"])], "query_id string, question string, q_years array<string>, q_metrics array<string>")
    return seeds, chunks, asked


@pytest.mark.parametrize("relation", [expansion.same_metric, expansion.same_year, expansion.same_company_year])
@pytest.mark.parametrize("budget", [1, 4, 10])
def test_expansion_within_a_budget_is_the_head_of_the_whole(spark, relation, budget):
    seeds, chunks, asked = _evidence(spark)
    whole = relation(seeds, chunks, asked).collect()
    want = []
    for q in ("p", "q"):
        best = sorted((r for r in whole if r["query_id"] == q), key=lambda r: (-round(r["priority"], 10), r["chunk_id"]))
        want += best[:budget]
    assert rows(relation(seeds, chunks, asked, budget)) == sorted(map(tuple, want), key=str)


def test_expansion_in_a_budget_meets_few_chunks(spark):
    """As many chunks of a group as its budget, not all, go into the join with the seeds."""
    chunks = spark.range(5000).selectExpr("concat('c', lpad(id, 5, '0')) AS chunk_id", "concat('d', id) AS doc_id", "'co' AS company", "'1995' AS filing_year", "array('eps') AS metrics")
    seed = spark.createDataFrame([("c00000", "d0")], "seed_id string, seed_doc_id string")
    assert expansion._first(chunks, seed, ["company", "filing_year", "metrics"], 10).distinct().count() == 11


def test_paths_read_the_edges_a_few_times(spark):
    chunks = spark.createDataFrame([(f"c{i}", "co", "10-K", "1995", "s", "F") for i in range(20)], "chunk_id string, company string, filing_type string, filing_year string, section string, metric string")
    near = spark.createDataFrame([("c1", "c2", "semantic-similar", 0.3)], "src string, dst string, edge_type string, weight double")
    edges = graph.build_edges(chunks).union(near)
    read, n = spark.sparkContext.accumulator(0), edges.count()
    counted = spark.createDataFrame(edges.rdd.map(lambda r: (read.add(1), r)[1]), edges.schema)
    asked = spark.createDataFrame([("q", "c1", ["co"], ["1995"], ["F"])], "query_id string, chunk_id string, q_companies array<string>, q_years array<string>, q_metrics array<string>")
    got = rows(rerank.typed_paths(counted, asked).select("path_type", "target"))
    assert got == [("chunk_metric", "metric::F"), ("chunk_year", "year::1995"), ("company_filing_section", "company::co"), ("filing_section", "section::s"), ("semantic_support", "c2")]
    assert read.value <= 4 * n


def test_products_come_in_pieces_with_ties_to_the_smaller_id(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 3)).round(1)
    data = [(int(i), [float(x) for x in base[i % 6]]) for i in rng.permutation(60)]  # ten of each
    v = spark.createDataFrame(data, "id long, embedding array<double>")
    m = dict(data)
    dots = {i: sorted(m, key=lambda j: (-round(float(np.dot(m[i], m[j])), 8), j))[:4] for i in range(8)}
    monkeypatch.setattr(retrieval, "CELLS", 50)
    top = retrieval.dense(v, v.filter("id < 8").withColumnRenamed("id", "q"), "id", "q", 4, block=3).orderBy("q", "rank").toPandas()
    assert {q: list(x["id"]) for q, x in top.groupby("q")} == dots
    same = {i: [j for j in sorted(m) if j % 6 == i % 6 and j != i][:4] for i in m}
    e = graph.knn_edges(v, "id", "embedding", 4, 0.999, block=25).orderBy("src", "dst").toPandas()
    assert {i: list(x["dst"]) for i, x in e.groupby("src")} == same
    s = np.array([[1.0, 1.0 + 1e-12, 0.5]])
    assert [c.tolist() for c in retrieval.best_cells(s, np.array([0, 1, 2]), 1)] == [[0], [0]]


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_documents_are_scored_where_they_lie(spark, batch):
    """The same ranking as from all pairs, with documents cut by batches and queries by blocks, and no row a pair."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 12, n))
    docs = spark.createDataFrame([(i, text(int(rng.integers(0, 9)))) for i in range(40)] + [(40, None)], "d long, text string")
    queries = spark.createDataFrame([(f"q{i}", text(3)) for i in range(5)] + [("none", "zz")], "q string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        want = retrieval.top_k(retrieval.bm25(docs, queries, "d", "q"), "q", "d", 4)
        got = retrieval.bm25_top(docs, queries, "d", "q", 4)
        cut = lambda df: rows(df.select("q", "d", F.round("score", 8).alias("s"), "rank"))
        assert cut(got) == cut(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
