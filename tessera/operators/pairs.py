"""Pairs of a question and a candidate: features, texts for encoders, scoring by a model from outside, tournaments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import entities as E

#: What a section's name holds, and the words by which a question means such a section.
SECTION_KINDS = {
    "risk": ("risk", "risks"),
    "mda": ("management discussion", "mda", "md&a"),
    "business": ("business", "overview"),
    "financial": ("financial statement", "financial condition"),
    "notes": ("notes to financial", "footnote"),
}
MATCHES = ("company", "year", "metric", "filing", "section")


def pair_features(df: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """``df`` with five matches (pair_<kind>, 0 or 1) and their mean, pair_entity.

    Needs what ``support.with_question`` and ``with_passage`` add, and company,
    filing_year, filing_type, section of the candidate.  Scores and reciprocal
    ranks of retrievers are columns of ``df`` beside them.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    asked, section = F.lower(question), F.lower("section")
    meant = F.lit(False)
    for kind, words in reversed(SECTION_KINDS.items()):
        meant = F.when(F.contains(section, F.lit(kind)), E.contains_any(asked, words)).otherwise(meant)
    hits = {
        "company": some("company") & F.exists("q_companies", lambda q: E.overlaps_name(q, F.col("company"))),
        "year": F.array_contains("q_years", F.coalesce("filing_year", F.lit(""))) | F.arrays_overlap("t_years", "q_years"),
        "metric": F.arrays_overlap("t_metrics", "q_metrics"),
        "filing": some("filing_type") & F.array_contains("q_filings", F.upper("filing_type")),
        "section": some("section") & (F.contains(asked, section) | meant),
    }
    x = df.withColumns({f"pair_{k}": F.coalesce(h, F.lit(False)).cast("int") for k, h in hits.items()})
    return x.withColumn("pair_entity", sum((F.col(f"pair_{k}") for k in MATCHES), F.lit(0)) / F.lit(float(len(MATCHES))))


def entity_vector(df: DataFrame, size: int) -> Column:
    """Company named, years and metrics up to five, filing and section named; cut or filled with zeros to ``size``."""
    flag = lambda c: (F.size(c) > 0).cast("double")
    few = lambda c: F.least(F.size(c), F.lit(5)) / F.lit(5.0)
    base = F.array(flag("q_companies"), few("q_years"), few("q_metrics"), flag("q_filings"), flag("q_sections"))
    return F.slice(F.concat(base, F.array_repeat(F.lit(0.0), max(0, size - 5))), 1, size)


def encoder_text(text: Column, kind: str, role: str, instruction: str = "") -> Column:
    """A text as an encoder wants it: kind "prefixed" or "instructed", else as it is; role "query" or "passage"."""
    if kind == "prefixed":
        return F.concat(F.lit(f"{role}: "), text)
    if kind == "instructed" and role == "query":
        return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), text)
    return text


def scored(pairs: DataFrame, question: str, text: str, model: Callable[[], Callable[[list[str], list[str]], list[float]]], score: str = "score") -> DataFrame:
    """``pairs`` with a score of each question and text, by a model that every task makes once.

    Batches go through Arrow; only the two columns and the score are touched.
    Rank them with ``retrieval.top_k``: equal scores go to the smaller id.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + f", `{score}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model()
        for b in batches:
            b[score] = pd.Series(of(b[question].tolist(), b[text].tolist()), index=b.index, dtype=float)
            yield b

    return pairs.mapInPandas(run, schema)


def completed_order(answered: Column, candidates: Column) -> Column:
    """A model's order of ids, then the candidates that it left out, as they were; all as they were without an answer (null)."""
    return F.when(answered.isNull(), candidates).otherwise(F.concat(answered, F.array_except(candidates, answered)))


def tournament(candidates: DataFrame, choose: Callable[[str, list[str]], int], group: int = 5, most: int = 10, query: str = "query_id", doc: str = "chunk_id") -> DataFrame:
    """The ``most`` best of each query by repeated tournaments: query, doc, rank.

    ``candidates``: query, doc, question, text, rank.  ``choose`` names the place
    of the best among up to ``group`` texts; winners meet until one is left,
    which takes the next rank and leaves.  A group's winner is remembered, so a
    round after the first only asks where the last one played.  What isn't
    chosen keeps its order.  One query's candidates are one task: for lists of
    candidates, not for corpora.
    """
    kinds = dict(candidates.dtypes)

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", doc], kind="stable").reset_index(drop=True)
        texts, known = rows["text"].tolist(), {}
        asked = rows["question"].iloc[0]

        def best(field: list[int]) -> int:
            while len(field) > 1:
                heats = [tuple(field[i : i + group]) for i in range(0, len(field), group)]
                for h in heats:
                    if h not in known:
                        known[h] = h[choose(asked, [texts[i] for i in h])] if len(h) > 1 else h[0]
                field = [known[h] for h in heats]
            return field[0]

        left, order = list(range(len(rows))), []
        while left and len(order) < most:
            order.append(best(left))
            left.remove(order[-1])
        out = rows.iloc[order][[query, doc]].copy()
        out["rank"] = range(1, len(order) + 1)
        return out

    return candidates.groupBy(query).applyInPandas(play, f"`{query}` {kinds[query]}, `{doc}` {kinds[doc]}, rank int")
