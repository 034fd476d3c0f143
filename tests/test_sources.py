import json

import pytest

from tessera.sources import readers, sinks
from tessera.streaming import events as S


def test_parquet_questions_by_split(spark, tmp_path):
    df = spark.createDataFrame([("1", "q?", "a", ["e1", "e2"])], "_id string, text string, answer string, references array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    for f in (tmp_path / "x").glob("part-*.parquet"):
        f.rename(tmp_path / "test-0.parquet")
    got = readers.load_dataset(spark, "parquet_qa", str(tmp_path), "test").first()
    assert got["evidence_texts"] == ["e1", "e2"] and got["question"] == "q?"
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "nothing", str(tmp_path))


def test_results_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"question_id": "q", "retrieved_chunk_ids": ["c1", "c2"]}) + "\n" + json.dumps({"query_id": "r", "top_k": [{"passage_id": "p", "score": 0.9}]}))
    got = [tuple(r) for r in readers.simple_results(spark, str(tmp_path / "a.jsonl")).collect()]
    assert got == [("q", "c1", 1, None), ("q", "c2", 2, None), ("r", "p", 1, 0.9)]


def test_a_broken_last_line_is_left_out(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a"')
    assert readers.read_jsonl(spark, str(tmp_path / "ok.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a"\n{"a": 2}')
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")


def test_reports(spark):
    m = spark.createDataFrame([("bm25", "recall", 5, 0.25), ("bm25", "mrr", None, 0.5), ("dense", "mrr", None, 0.1)], "method string, metric string, k int, value double")
    text = sinks.to_markdown(sinks.wide(m).orderBy("method"))
    assert "| bm25 | 0.5000 | 0.2500 |" in text and sinks.MISSING in text
    assert "tabular" in sinks.to_latex(sinks.wide(m))
    assert sinks.upsert(m, m.limit(1), ["method", "metric"]).count() == 3


def test_streams_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = S.EVENTS
    row = lambda i, t: (i, t, 1, "click", 1.0, "{}")
    from datetime import datetime

    spark.createDataFrame([row(1, datetime(2024, 1, 1, 0, 5)), row(1, datetime(2024, 1, 1, 0, 5)), row(2, datetime(2024, 1, 1, 0, 50))], schema).write.parquet(src)
    once = lambda: S.run_to_end(S.without_repeats(S.read_events(spark, src), ["event_id"]), out, ck)
    once()
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([row(3, datetime(2024, 1, 1, 1, 0))], schema).write.mode("append").parquet(src)
    once()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windows_over_a_stream(spark, tmp_path):
    from datetime import datetime

    src = str(tmp_path / "src")
    data = [(i, datetime(2024, 1, 1, h, 5), 1, "click", 1.0, "{}") for i, h in enumerate((0, 0, 1, 9))]
    spark.createDataFrame(data, S.EVENTS).write.parquet(src)
    S.run_to_end(S.tumbling(S.read_events(spark, src)), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [1, 2]
