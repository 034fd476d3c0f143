import pytest
from pyspark.sql import functions as F

from tessera.operators import diagnostics, graph, pairs, training
from tessera.sources import readers


def test_first_results_and_their_errors(spark):
    rows = [
        ("a", ["Acme Corp"], ["2020"], ["revenue"], ["10-K"], "revenue in 2020", "acme corp", "2019, 2020", "", "10-K", True),
        ("b", ["Acme Corp"], ["2020"], ["revenue"], ["10-K"], "profit in 2018", "Bolt Inc", "2018", "profit", "10-Q", False),
        ("c", ["Acme Corp"], [], [], [], None, None, None, None, None, False),
        ("d", [], [], [], [], "", "", "", "", "", False),
    ]
    names = "query_id string, q_companies array<string>, q_years array<string>, q_metrics array<string>, q_filings array<string>, text string, company string, year string, metric string, filing string, hit boolean"
    got = {r["query_id"]: r["errors"] for r in diagnostics.retrieval_errors(spark.createDataFrame(rows, names)).collect()}
    assert got == {
        "a": ["unclassifiable"],
        "b": ["missing_evidence", "wrong_company", "wrong_year", "wrong_metric", "wrong_filing"],
        "c": ["missing_evidence"],
        "d": ["missing_evidence"],
    }


def test_alignment_warns_or_fails(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    x = diagnostics.gold_alignment(q, q.limit(1))
    assert x.first()["coverage"] == 0.5
    assert diagnostics.require_alignment(x, 0.5, True) is None
    assert "1 have none" in diagnostics.require_alignment(x, 0.9, False)
    with pytest.raises(RuntimeError):
        diagnostics.require_alignment(x, 0.9, True)
    assert diagnostics.gold_alignment(q.limit(0), q).first()["coverage"] == 0


def test_records_of_rankings(spark):
    rows = [("q", ["g"], ["c"], "bm25_v1"), (None, ["g"], ["c"], "bm25_v1"), ("q", None, ["c"], "bm25_v1"), ("q", [], [], "bm25_v1"), ("q", [], ["c"], "other"), ("q", [], ["c"], None)]
    df = spark.createDataFrame(rows, "question_id string, gold_evidence_ids array<string>, retrieved_chunk_ids array<string>, method string")
    said = [r[0] for r in df.select(readers.record_problem("BM25", {"bm25_v1": "BM25"})).collect()]
    assert said == [None, "missing 'question_id'", "missing 'gold_evidence_ids'", "empty retrieved_chunk_ids", "method 'other' != 'BM25'", "method '' != 'BM25'"]
    with pytest.raises(ValueError):
        readers.stored_results(spark, "/nowhere", "poor")


def test_reports_merge_by_any_spelling(spark):
    rows = [("m", "b", {"recall@10": 0.9}), ("m", "a", {"Recall@10": 0.3, "evidence_recall.5": 0.2, "ndcg.10": 0.4}), ("n", "a", {"x": 1.0})]
    df = spark.createDataFrame(rows, "method string, source string, values map<string,double>")
    got = {r["method"]: tuple(r)[1:] for r in diagnostics.merged_reports(df, ["recall@10", "recall@5", "ndcg@10"], {"m": 0.5}).collect()}
    assert got == {"m": (0.3, 0.2, 0.4, True), "n": (0.0, 0.0, 0.0, False)}


def test_tournament_keeps_order_among_equals_and_ends(spark):
    rows = [("q", f"c{i}", "?", "x" * n, i) for i, n in enumerate([3, 9, 9, 1, 2, 7, 9, 4])] + [("one", "c", "?", "x", 1)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, question string, text string, rank int")
    best = lambda question, texts: max(range(len(texts)), key=lambda i: (len(texts[i]), -i))
    got = pairs.tournament(df, best, 3, 5).orderBy("query_id", "rank").collect()
    assert [(r[0], r[1]) for r in got] == [("one", "c"), ("q", "c1"), ("q", "c2"), ("q", "c6"), ("q", "c5"), ("q", "c7")]


def test_scores_from_outside_keep_columns(spark):
    df = spark.createDataFrame([("a", "bb", 1), ("ccc", "d", 2)], "q string, t string, keep int")
    got = pairs.scored(df, "q", "t", lambda: lambda q, t: [len(x) * 10.0 + len(y) for x, y in zip(q, t)])
    assert sorted(map(tuple, got.collect())) == [("a", "bb", 1, 12.0), ("ccc", "d", 2, 31.0)]
    assert pairs.scored(df.limit(0), "q", "t", lambda: lambda q, t: []).count() == 0


def test_strategies_overlap_in_sections_only(spark):
    rows = [("q", "a", 1, 0, 1), ("q", "b", 0, 1, 0), ("q", "c", 0, 0, 0), ("q", "d", 1, 1, 0), ("q", "e", 1, 1, 1)]
    df = spark.createDataFrame(rows, "q string, c string, metric_same int, year_same int, section_same int")
    got = {(r["c"], r["strategy"]) for r in training.strategy_negatives(df, "q", "c", 40).collect()}
    assert got == {
        ("a", "same_metric_wrong_year"), ("a", "same_section"), ("b", "same_year_wrong_metric"), ("c", "random_fallback"), ("d", "random_fallback"), ("e", "same_section"),
    }


def test_an_edge_for_each_pair_and_type(spark):
    rows = [("b", "a", "x", 2.0), ("a", "b", "x", 1.0), ("b", "a", "y", 3.0), ("a", "c", "x", 9.0)]
    e = spark.createDataFrame(rows, "src string, dst string, edge_type string, weight double")
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert sorted(map(tuple, graph.subgraph_edges(e, n).collect())) == [("a", "b", "x", 1.0), ("a", "b", "y", 3.0)]


def test_loss_of_margins(spark):
    import math

    df = spark.createDataFrame([(1.0, 0.0, 1), (0.0, 900.0, 0)], "p double, n double, c int")
    got = df.agg(training.margin_loss(F.col("p"), F.col("n"), [F.col("c")], (2.0,)).alias("x")).first()["x"]
    assert abs(got - ((1.5 * math.log1p(math.exp(-1)) + 900) / 2 + 0.004)) < 1e-9
    assert df.limit(0).agg(training.margin_loss(F.col("p"), F.col("n"), [], ()).alias("x")).first()["x"] == 0


def test_nodes_are_numbered_in_order_over_partitions(spark):
    nodes = spark.range(1000).select(F.format_string("n%04d", "id").alias("node_id")).repartition(7)
    edges = spark.createDataFrame([("n0003", "n0999", "x", 0.5)], "src string, dst string, edge_type string, weight double")
    ids, by = graph.to_arrays(nodes, edges)
    assert [(r["node_id"], r["i"]) for r in ids.orderBy("i").collect()] == [(f"n{i:04d}", i) for i in range(1000)]
    assert [tuple(r) for r in by.collect()] == [("x", 3, 999, 0.5)]
