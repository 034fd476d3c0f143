"""Feature vectors of queries and nodes, as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.functions.text import words

#: The words each of these flags looks for.
FINANCE_WORDS = ("revenue", "profit", "income", "earnings", "assets", "liabilities", "cash", "eps")
ASKS_NUMBER = (
    "how many", "how much", "what is the", "what was the", "amount", "value", "number of", "percentage", "percent", "ratio", "what are the",
)
ASKS_COMPARISON = (
    "compare", "comparison", "versus", "vs", "higher", "lower", "more than", "less than", "greater", "difference", "between", "than", "relative to",
)
ASKS_CHANGE = ("change", "growth", "decline", "increase", "decrease", "delta", "trend", "rising", "falling", "improved", "deteriorated")


def capped(n: Column, most: int) -> Column:
    return F.least(n, F.lit(most)) / F.lit(float(most))


def flag(c: Column) -> Column:
    return c.cast("double")


def query_features(text: Column) -> Column:
    """Seven numbers: years, metrics, companies, length, and three kinds of question."""
    low = F.lower(text)
    return F.array(
        capped(F.size(E.years(text)), 5),
        capped(F.size(E.metrics(text)), 10),
        capped(F.size(E.companies(text)), 10),
        capped(F.size(words(text)), 200),
        flag(E.contains_any(low, ASKS_NUMBER)),
        flag(E.contains_any(low, ASKS_COMPARISON)),
        flag(E.contains_any(low, ASKS_CHANGE)),
    )


def sha1_slot(value: Column, slots: int) -> Column:
    """The SHA-1 of a string as a number, modulo ``slots``, digit by digit."""
    digits = F.split(F.sha1(value), "")
    return F.aggregate(
        F.filter(digits, lambda d: d != ""), F.lit(0), lambda n, d: ((n * 16 + F.conv(d, 16, 10).cast("int")) % slots).cast("int")
    )


def query_vector(text: Column, size: int = 64) -> Column:
    """Nine statistics, then a slot for each of the first entities by the hash of its name; of length 1."""
    metrics, years, companies = E.metrics(text), E.years(text), E.companies(text)
    head = F.array(
        capped(F.size(metrics), 10), capped(F.size(years), 5), capped(F.size(companies), 10), capped(F.size(words(text)), 200),
        flag(F.size(metrics) > 0), flag(F.size(years) > 0), flag(F.size(companies) > 0), flag(F.size(E.filing_types(text)) > 0),
        flag(E.contains_any(F.lower(text), FINANCE_WORDS)),
    )
    first = lambda a, n: F.slice(F.array_sort(a), 1, n)
    names = F.concat(first(metrics, 8), first(years, 4), first(companies, 4))
    slots = F.transform(names, lambda x: sha1_slot(x, size - 9))
    tail = F.transform(F.sequence(F.lit(0), F.lit(size - 10)), lambda i: flag(F.array_contains(slots, i)))
    whole = F.concat(head, tail)
    norm = F.sqrt(F.aggregate(whole, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 1e-8, F.transform(whole, lambda x: x / norm)).otherwise(whole)


def node_features(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """(node_id, features): vector, retrieval score, type of three, two flags for later, log degree.

    Nodes without a vector or score get zeros; types other than chunk, metric
    and year take the chunk's place.
    """
    from tessera.operators.graph import degrees

    x = nodes.join(vectors.select("node_id", "vector"), "node_id", "left").join(scores.select("node_id", "score"), "node_id", "left")
    x = x.join(degrees(edges).select("node_id", "log_degree"), "node_id", "left")
    zeros = F.array_repeat(F.lit(0.0), size)
    kind = F.array(flag(~F.col("node_type").isin("metric", "year")), flag(F.col("node_type") == "metric"), flag(F.col("node_type") == "year"))
    rest = F.array(F.lit(0.0), F.lit(0.0), F.coalesce("log_degree", F.lit(0.0)))
    return x.select(
        "node_id", F.concat(F.coalesce(F.col("vector").cast("array<double>"), zeros), F.array(F.coalesce("score", F.lit(0.0))), kind, rest).alias("features")
    )
