"""Sources: question sets, document folders, stored rankings, line files with a broken end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which result files keep a passage's id and their lists.
ID_NAMES = ("chunk_id", "passage_id", "id", "doc_id")
LIST_NAMES = ("retrieved_chunk_ids", "reranked_chunk_ids", "chunk_ids", "ranked_ids")


def load_dataset(spark: SparkSession, name: str, path: str, split: str | None = None) -> DataFrame:
    """Samples (id, question, answer, evidence_texts, metadata) of a known layout."""
    readers = {"parquet_qa": parquet_qa, "table_qa": table_qa, "program_qa": program_qa}
    if name not in readers:
        raise ValueError(f"unknown dataset {name!r}: one of {', '.join(readers)}")
    return readers[name](spark, path, split)


def parquet_qa(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Parquet files, those whose names hold the split if one is given; references to an array of strings."""
    reader = spark.read.option("pathGlobFilter", f"*{split}*.parquet" if split else "*.parquet").option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    kind = dict(df.dtypes).get("references", "")
    refs = F.col("references")
    evidence = F.transform(refs, lambda x: x.cast("string")) if kind.startswith("array") else F.array_compact(F.array(refs.cast("string") if kind else F.lit(None).cast("string")))
    have = lambda c, t="string": F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    meta = F.struct(F.lit("parquet_qa").alias("source"), have("category").alias("category"), have("type").alias("type"), have("reasoning", "boolean").alias("reasoning"))
    return df.select(have("_id").alias("id"), have("text").alias("question"), have("answer").alias("answer"), F.coalesce(evidence, F.array()).alias("evidence_texts"), meta.alias("metadata"))


def table_qa(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A JSON array of tables with paragraphs and questions; the table itself is evidence, as JSON."""
    schema = "table struct<uid:string,table:array<array<string>>>, paragraphs array<struct<uid:string,text:string>>, questions array<struct<uid:string,question:string,answer:string,scale:string>>"
    df = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", f"*{split}*.json" if split else "*.json").json(path)
    evidence = F.concat(F.transform("paragraphs", lambda p: p["text"]), F.array(F.to_json("table")))
    rows = df.select(evidence.alias("evidence_texts"), F.explode("questions").alias("q"))
    meta = F.struct(F.lit("table_qa").alias("source"), F.lit(None).cast("string").alias("category"), F.col("q.scale").alias("type"), F.lit(None).cast("boolean").alias("reasoning"))
    return rows.select(F.col("q.uid").alias("id"), F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), "evidence_texts", meta.alias("metadata"))


def program_qa(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A JSON array of questions with the text before and after a table; each table row is evidence."""
    schema = "id string, pre_text array<string>, post_text array<string>, table array<array<string>>, qa struct<question:string,answer:string>"
    df = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", f"*{split}*.json" if split else "*.json").json(path)
    none = F.array().cast("array<string>")
    evidence = F.concat(F.coalesce("pre_text", none), F.coalesce("post_text", none), F.coalesce(F.transform("table", F.to_json), none))
    meta = F.struct(F.lit("program_qa").alias("source"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("reasoning"))
    return df.select("id", F.col("qa.question").alias("question"), F.col("qa.answer").alias("answer"), evidence.alias("evidence_texts"), meta.alias("metadata"))


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all .txt, .html and .htm files below ``path``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,html,htm}").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def rich_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored rankings with passages: query_id, chunk_id, rank (from 1), score, text."""
    schema = "query_id string, top_k array<struct<rank:int,passage_id:string,score:double,text:string>>"
    rows = spark.read.schema(schema).json(path).select("query_id", F.posexplode("top_k").alias("p", "x"))
    return rows.filter(F.col("x.passage_id").isNotNull()).select("query_id", F.col("x.passage_id").alias("chunk_id"), (F.col("p") + 1).alias("rank"), "x.score", "x.text")


def simple_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored rankings as lists of ids under any of the known names, else lists of objects under top_k."""
    item = "struct<chunk_id:string,passage_id:string,id:string,doc_id:string,score:double,text:string>"
    schema = "question_id string, query_id string, " + ", ".join(f"{n} array<string>" for n in LIST_NAMES) + f", top_k array<{item}>, results array<{item}>"
    df = spark.read.schema(schema).json(path)
    ids = F.coalesce(*[F.when(F.size(n) > 0, F.transform(n, lambda i: F.struct(i.alias("chunk_id"), F.lit(None).cast("double").alias("score")))) for n in LIST_NAMES])
    listed = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: F.struct(F.coalesce(*[x[n] for n in ID_NAMES]).alias("chunk_id"), x["score"].alias("score"))))
    rows = df.select(F.coalesce("query_id", "question_id").alias("query_id"), F.posexplode(F.coalesce(ids, listed("top_k"), listed("results"))).alias("p", "x"))
    return rows.filter(F.col("x.chunk_id").isNotNull()).select("query_id", "x.chunk_id", (F.col("p") + 1).alias("rank"), "x.score")


def stored_results(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Stored rankings of either form, "rich" or "simple", with the columns of both; text is null in the second."""
    if form not in ("rich", "simple"):
        raise ValueError(f"unknown form of results: {form}")
    return rich_results(spark, path) if form == "rich" else simple_results(spark, path).withColumn("text", F.lit(None).cast("string"))


def record_problem(method: str, labels: dict[str, str]) -> Column:
    """What is wrong with a record of a stored ranking, null if nothing: a field that lacks, an empty list, another method.

    Columns: question_id, gold_evidence_ids, retrieved_chunk_ids, method; ``labels`` are the names of methods in files.
    """
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    other = ~F.element_at(known, F.col("method")).eqNullSafe(F.lit(method))
    out = F.when(other, F.concat(F.lit("method '"), F.coalesce("method", F.lit("")), F.lit(f"' != '{method}'")))
    out = F.when(F.size("retrieved_chunk_ids") == 0, "empty retrieved_chunk_ids").otherwise(out)
    for field in ("retrieved_chunk_ids", "gold_evidence_ids", "question_id"):
        out = F.when(F.col(field).isNull(), f"missing '{field}'").otherwise(out)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON.  A last line that is cut off is left out; a broken line before it is an error.

    The last line of a file is the one with the greatest offset in it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.withColumn("ok", F.get_json_object("value", "$").isNotNull())
    last = parsed.groupBy("file").agg(F.max("n").alias("last"))
    broken = parsed.filter(~F.col("ok")).join(last, "file").filter(F.col("n") < F.col("last"))
    if not broken.isEmpty():
        raise ValueError(f"broken line before the end of {broken.first()['file']}")
    return parsed.filter("ok").select(F.from_json("value", schema).alias("r")).select("r.*")


def validate_ranking(rows: DataFrame, wanted: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(problem, n): queries missing or unknown, short lists, ids that the corpus lacks."""
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    return (
        count(wanted.join(per, "query_id", "left_anti"), "missing queries")
        .union(count(per.join(wanted, "query_id", "left_anti"), "unknown queries"))
        .union(count(per.filter(F.col("n") < k), "short lists"))
        .union(count(rows.join(corpus, "chunk_id", "left_anti"), "unknown chunks"))
    )
