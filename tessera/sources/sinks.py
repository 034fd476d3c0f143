"""Sinks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "—"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").json(path)


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """(method, metric, k, value) to one row a method, a column a metric and k."""
    wide(metrics).coalesce(1).write.option("header", "true").csv(path)


def wide(metrics: DataFrame) -> DataFrame:
    name = F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("@", "metric", F.col("k").cast("string")))
    return metrics.withColumn("_m", name).groupBy("method").pivot("_m").agg(F.first("value"))


def write_by_method(df: DataFrame, path: str) -> None:
    """One folder a method; a method that is run again replaces its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)


def to_markdown(df: DataFrame, digits: int = 4) -> str:
    """A report table; for a few rows, which are collected."""
    rows = df.collect()
    cell = lambda v: MISSING if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def to_latex(df: DataFrame, digits: int = 4) -> str:
    rows = df.collect()
    cell = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(map(cell, r)) + r" \\" for r in rows]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\ \midrule"
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(df.columns) - 1) + "}", r"\toprule", head, *body, r"\bottomrule", r"\end{tabular}"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a cache after an update: new ones replace old ones with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
