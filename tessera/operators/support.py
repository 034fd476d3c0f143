"""Features of a question, and of a question and a candidate: what supports it and what conflicts.

What is missing on one side is neither a match nor a conflict.  Questions and
candidates are columns; entities are extracted once and handed over as arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import entities as E

#: Words of questions, and how they begin.
COMPARING = ("compare", "comparison", "versus", "vs", "difference", "higher", "lower", "better", "worse", "more than", "less than", "between")
CHANGING = ("change", "increase", "decrease", "growth", "decline", "trend", "quarter over quarter", "year over year", "yoy", "qoq")
FILING_WORDS = ("10-k", "10-q", "8-k", "annual", "quarterly", "filing", "report")
ASKING = (
    "what", "how", "which", "who", "when", "where", "why", "did", "does", "is", "are", "was", "were", "can", "could", "would", "should", "will",
)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def question_features(question: Column) -> Column:
    """Ten numbers: years, metrics, companies and words, each capped; question with a number, comparison, change, filing, section, short and vague."""
    low = F.lower(question)
    tokens = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    n = {k: F.size(f(question)) for k, f in (("y", E.years), ("m", E.metrics), ("c", E.companies))}
    capped = lambda c, most: F.least(c, F.lit(most)) / F.lit(float(most))
    asks = F.contains(question, F.lit("?")) | low.rlike("^(?:" + "|".join(ASKING) + ")")
    flags = [
        question.rlike("[0-9]") & asks, E.contains_any(low, COMPARING), E.contains_any(low, CHANGING), E.contains_any(low, FILING_WORDS),
        E.contains_any(low, E.SECTION_WORDS), (tokens <= 5) & (n["m"] == 0) & (n["c"] == 0),
    ]
    return F.array(capped(n["y"], 5), capped(n["m"], 5), capped(n["c"], 3), capped(tokens, 50), *[_flag(f).cast("double") for f in flags])


def known_entities(question: Column) -> Column:
    """Whether a question names a company, a year, a metric."""
    return F.array(*[(F.size(f(question)) > 0).cast("int") for f in (E.companies, E.years, E.metrics)])


def with_question(df: DataFrame, question: str) -> DataFrame:
    """``df`` with the question's entities: q_companies, q_years, q_metrics, q_filings, q_sections."""
    q = F.col(question)
    return df.withColumns({"q_companies": E.companies(q), "q_years": E.years(q), "q_metrics": E.metrics(q), "q_filings": E.filing_types(q), "q_sections": E.sections_named(q)})


def with_passage(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the passage's entities: t_years, t_metrics."""
    return df.withColumns({"t_years": E.years(F.col(text)), "t_metrics": E.metrics(F.col(text))})


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _company() -> tuple[Column, Column]:
    """Both sides known, and one name contains the other."""
    return (F.size("q_companies") > 0) & _some("company"), F.exists("q_companies", lambda q: E.overlaps_name(q, F.col("company")))


def support_features(df: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """``df`` with eleven supports.

    Needs what ``with_question`` and ``with_passage`` add; company, filing_year,
    filing_type, section, doc_id, word_offset of the candidate; seed_doc_id,
    seed_section, seed_word_offset (null without a seed); alignment (the sum
    of the router's probabilities for the candidate's relations).
    """
    known, same = _company()
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda w: w != ""))
    overlap = F.size(F.array_intersect(words(question), words(text))) / F.greatest(F.size(words(question)), F.lit(1))
    doc = _some("seed_doc_id") & (F.col("doc_id") == F.col("seed_doc_id"))
    far = F.abs(F.col("word_offset") - F.col("seed_word_offset"))
    return df.withColumns({
        "company_support": _flag(known & same),
        "filing_year_support": _flag(_some("filing_year") & F.array_contains("q_years", F.col("filing_year"))),
        "year_text_support": _flag(F.arrays_overlap("t_years", "q_years")),
        "metric_support": _flag(F.arrays_overlap("t_metrics", "q_metrics")),
        "filing_type_support": _flag(_some("filing_type") & F.array_contains("q_filings", F.upper("filing_type"))),
        "section_support": _flag(F.exists("q_sections", lambda s: F.contains(F.lower("section"), s))),
        "overlap_support": F.least(overlap, F.lit(1.0)),
        "same_filing_support": _flag(doc),
        "same_section_support": _flag(doc & _some("seed_section") & (F.col("section") == F.col("seed_section"))),
        "adjacent_support": F.when(_flag(doc & (far < 1000)) == 1, 1 / (1 + far / 100.0)).otherwise(0.0),
        "route_support": F.least(F.coalesce("alignment", F.lit(0.0)), F.lit(1.0)),
    })


def conflict_features(df: DataFrame) -> DataFrame:
    """``df`` with five conflicts, where both sides are known and differ; the filing's year outranks those in its text."""
    known, same = _company()
    filed = _some("filing_year")
    by_text = (F.size("t_years") > 0) & ~F.arrays_overlap("t_years", "q_years")
    year = F.when(filed, ~F.array_contains("q_years", F.col("filing_year"))).otherwise(by_text)
    return df.withColumns({
        "company_against": _flag(known & ~same),
        "year_against": _flag((F.size("q_years") > 0) & year),
        "metric_against": _flag((F.size("q_metrics") > 0) & (F.size("t_metrics") > 0) & ~F.arrays_overlap("t_metrics", "q_metrics")),
        "filing_type_against": _flag((F.size("q_filings") > 0) & _some("filing_type") & ~F.array_contains("q_filings", F.upper("filing_type"))),
        "section_against": _flag((F.size("q_sections") > 0) & _some("section") & ~F.exists("q_sections", lambda s: F.contains(F.lower("section"), s))),
    })


def match_flags(df: DataFrame) -> DataFrame:
    """``df`` with five matches and three conflicts; the years of a candidate are those of its text and its filing's."""
    known, same = _company()
    told = F.array_compact(F.array_append("t_years", F.when(_some("filing_year"), F.col("filing_year"))))
    years, metrics = (F.size("q_years") > 0) & (F.size(told) > 0), (F.size("q_metrics") > 0) & (F.size("t_metrics") > 0)
    q = lambda c: F.transform(c, E.spaced)
    one = {"year": F.arrays_overlap(told, "q_years"), "metric": F.arrays_overlap(q("t_metrics"), q("q_metrics"))}
    return df.withColumns({
        "company_hit": _flag(known & same), "year_hit": _flag(years & one["year"]), "metric_hit": _flag(metrics & one["metric"]),
        "filing_hit": _flag(_some("filing_type") & F.array_contains("q_filings", F.upper("filing_type"))),
        "section_hit": _flag(F.exists("q_sections", lambda s: F.contains(F.lower("section"), s))),
        "company_miss": _flag(known & ~same), "year_miss": _flag(years & ~one["year"]), "metric_miss": _flag(metrics & ~one["metric"]),
    })


def node_features(df: DataFrame, question: str = "question", text: str = "text", query: str = "query_id") -> DataFrame:
    """``df``, nodes of queries' subgraphs, with seven columns about the query.

    Needs node_id, what ``with_question`` adds, company, filing_year and the text of a
    passage (null for other nodes), retrieval (null unless a candidate) and
    graph (null without a score).  node_candidate; node_retrieval and node_graph,
    min-maxed over what a query has (0.5 if all are equal, 0 for null); node_year,
    node_metric and node_company, by an entity's name or a passage's text and
    columns; node_overlap, the share of the question's words in the passage.
    """
    from tessera.operators.retrieval import min_max

    is_passage = F.col(text).isNotNull()
    value = lambda kind: F.when(F.startswith("node_id", F.lit(f"{kind}::")), F.substring_index("node_id", "::", -1))
    norm = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(min_max(F.col(c), query, 0.5))
    known = F.exists("q_companies", lambda q: E.overlaps_name(q, F.col("company"))) & _some("company")
    year = F.array_contains("q_years", F.col("filing_year")) | F.arrays_overlap(E.years(F.col(text)), "q_years")
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9]+"), F.lit(0)))
    shared = F.size(F.array_intersect(tokens(question), tokens(text))) / F.greatest(F.size(tokens(question)), F.lit(1))
    one = lambda kind, names, passage: _flag(F.coalesce(F.array_contains(names, value(kind)), F.when(is_passage, passage)))
    some = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns({
        "node_candidate": F.col("retrieval").isNotNull().cast("int"),
        "node_retrieval": norm("retrieval"),
        "node_graph": norm("graph"),
        "node_year": one("year", "q_years", some(year)),
        "node_metric": one("metric", "q_metrics", F.arrays_overlap(E.metrics(F.col(text)), "q_metrics")),
        "node_company": one("company", "q_companies", some(known) | F.arrays_overlap(E.companies(F.col(text)), "q_companies")),
        "node_overlap": F.when(is_passage, shared).otherwise(0.0),
    })


def semantic_factor(df: DataFrame) -> Column:
    """What an edge's weight is multiplied by for conflicts at one end (of ``match_flags``): 0.35 company, 0.40 year, 0.50 metric, at least 0.05."""
    out = F.lit(1.0)
    for name, f in (("company_miss", 0.35), ("year_miss", 0.40), ("metric_miss", 0.50)):
        out = out * F.when(F.col(name) == 1, f).otherwise(1.0)
    return F.greatest(out, F.lit(0.05))


def conflict_negatives(df: DataFrame, query: str = "query_id", doc: str = "chunk_id") -> DataFrame:
    """Candidates with an explicit mismatch of company, year or metric: query, doc, conflicts (names, in order)."""
    names = ("company", "year", "metric")
    said = F.array_compact(F.array(*[F.when(F.col(f"{n}_against") == 1, F.lit(n)) for n in names]))
    return df.select(query, doc, said.alias("conflicts")).filter(F.size("conflicts") > 0)
