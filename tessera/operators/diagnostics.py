"""What went wrong and how well things are covered: retrieval errors, paths of candidates, gold alignment, merged reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import entities as E

#: Names of retrieval errors, in the order in which they are listed.
ERRORS = ("missing_evidence", "wrong_company", "wrong_year", "wrong_metric", "wrong_filing")


def _parts(c: str) -> Column:
    """What a comma-separated cell holds, lower case."""
    return F.transform(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), ","), lambda v: F.trim(v))


def retrieval_errors(first: DataFrame) -> DataFrame:
    """``first`` with errors: what is wrong with each query's first result.

    Needs q_companies, q_years, q_metrics, q_filings (of ``support.with_question``),
    the result's text, company, year, metric, filing (null without a result), and hit, whether
    gold is among the results looked at.  Only what the query names and the
    result tells can be wrong; a query without results has missing evidence,
    one without any error is "unclassifiable".
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    text = F.coalesce("text", F.lit(""))
    told = E.companies(text)
    named = F.exists("q_companies", lambda q: E.overlaps_name(q, F.col("company")))
    written = F.exists("q_companies", lambda q: F.exists(told, lambda c: F.contains(F.lower(c), F.lower(q))))
    years = F.array_union(_parts("year"), E.years(text))
    metrics = F.array_union(_parts("metric"), E.metrics(text))
    asked = F.transform("q_metrics", F.lower)
    filed = F.exists("q_filings", lambda f: F.contains(F.upper("filing"), F.upper(f)))
    wrong = (
        ~F.col("hit"),
        (F.size("q_companies") > 0) & some("company") & ~named & ~written,
        (F.size("q_years") > 0) & ~F.arrays_overlap("q_years", years),
        (F.size(asked) > 0) & ~F.arrays_overlap(asked, metrics),
        (F.size("q_filings") > 0) & some("filing") & ~filed,
    )
    found = F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in zip(ERRORS, wrong)]))
    nothing = F.col("text").isNull() & F.col("company").isNull()
    errors = F.when(nothing, F.array(F.lit(ERRORS[0]))).when(F.size(found) == 0, F.array(F.lit("unclassifiable"))).otherwise(found)
    return first.withColumn("errors", errors)


def path_diagnostics(candidates: DataFrame, features: DataFrame, most: int = 8) -> DataFrame:
    """One row on the paths of candidates (query_id, chunk_id, is_gold), given ``rerank.path_features`` of ``most`` paths."""
    x = candidates.join(features, ["query_id", "chunk_id"], "left")
    n = F.coalesce(F.round(F.col("path_count") * most), F.lit(0.0))
    gold = F.col("is_gold") == 1
    share = lambda of, c: F.coalesce(F.avg(F.when(of, F.coalesce(c, F.lit(0)).cast("double"))), F.lit(0.0))
    against = F.greatest("company_conflict", "year_conflict", "metric_conflict")
    return x.agg(
        F.coalesce(F.avg(n), F.lit(0.0)).alias("paths"),
        F.coalesce(F.avg(F.when(gold, n)), F.lit(0.0)).alias("paths_of_gold"),
        F.coalesce(F.avg(F.when(~gold, n)), F.lit(0.0)).alias("paths_of_others"),
        share(F.lit(True), (n == 0).cast("int")).alias("without_paths"),
        *[share(gold, F.col(f"{k}_path")).alias(f"gold_with_{k}") for k in ("company", "year", "metric")],
        share(~gold, against).alias("others_in_conflict"),
    )


def gold_alignment(queries: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: queries (query_id), aligned ones, those that ``gold`` (query_id) lacks, and the share of the first."""
    x = queries.select("query_id").join(gold.select("query_id").distinct().withColumn("_g", F.lit(1)), "query_id", "left")
    n, m = F.count(F.lit(1)), F.count("_g")
    return x.agg(n.alias("queries"), m.alias("aligned"), (n - m).alias("unaligned"), (m / F.greatest(n, F.lit(1))).alias("coverage"))


def require_alignment(alignment: DataFrame, least: float, strict: bool) -> str | None:
    """A warning if the coverage is under ``least``; with ``strict`` an error."""
    r = alignment.first()
    if r["coverage"] >= least:
        return None
    said = f"gold covers {r['coverage']:.2%} of {r['queries']} queries, less than {least:.2%}; {r['unaligned']} have none"
    if strict:
        raise RuntimeError(said)
    return said


def group_means(rows: DataFrame, group: str, names: list[str], shares: list[str] = ()) -> DataFrame:
    """For each group, null as "unknown": rows, the means of ``names`` without nulls (0 without any), and the mean entropy of ``shares``, if named."""
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in shares), F.lit(0.0))
    part = lambda s: F.coalesce(F.col(s), F.lit(0.0)) / total
    entropy = -sum((F.when((total > 0) & (F.coalesce(F.col(s), F.lit(0.0)) > 0), part(s) * F.log(part(s))).otherwise(0.0) for s in shares), F.lit(0.0))
    means = [F.round(F.coalesce(F.avg(n), F.lit(0.0)), 4).alias(n) for n in names]
    more = [F.round(F.avg(entropy), 4).alias("entropy")] if shares else []
    return rows.groupBy(F.coalesce(F.col(group), F.lit("unknown")).alias(group)).agg(F.count(F.lit(1)).alias("rows"), *means, *more)


def metric_of(values: Column, name: str) -> Column:
    """A metric such as recall@10 in a map of names and numbers, under any of the ways to write it; null without one."""
    at = name.split("@")
    names = dict.fromkeys((name, name.replace("@", "_at_"), name.capitalize(), *([f"evidence_recall.{at[1]}"] if name.startswith("recall@") else []), *([f"{at[0]}.{at[1]}"] if len(at) == 2 else [])))
    return F.coalesce(*[F.element_at(values, F.lit(n)) for n in names])


def merged_reports(reports: DataFrame, names: list[str], expected: dict[str, float], checked: str = "recall@10", off: float = 0.1) -> DataFrame:
    """A row for each method: the metrics under their first names, and deviates, if ``checked`` is over ``off`` from what is expected.

    ``reports``: method, source (an order of preference) and values, a map.  The first source of a method counts.
    """
    first = reports.groupBy("method").agg(F.min_by("values", "source").alias("values"))
    table = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair]) if expected else F.create_map().cast("map<string,double>")
    got = metric_of(F.col("values"), checked)
    off_by = F.abs(got - F.element_at(table, F.col("method")))
    return first.select("method", *[F.round(F.coalesce(metric_of(F.col("values"), n), F.lit(0.0)), 4).alias(n) for n in names], F.coalesce(off_by > off, F.lit(False)).alias("deviates"))
