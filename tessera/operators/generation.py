"""What surrounds answer generation: evidence budgets, prompts, parsing, answer metrics, errors, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.entities import NUMBERS, UNITS, years
from tessera.functions.text import ascii_bounds


def token_budget(df: DataFrame, query: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Rows kept within ``budget`` tokens, in order: one that doesn't fit is dropped, a later one may still fit."""
    rest = [c for c in df.columns if c != query]
    rows = df.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x[tokens] <= budget
        return F.struct(
            (acc["used"] + F.when(fits, x[tokens]).otherwise(0)).cast("long").alias("used"),
            F.when(fits, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"),
            (acc["i"] + 1).alias("i"),
        )

    kept = rows.select(query, "r", F.aggregate("r", start, step)["kept"].alias("k"))
    return kept.select(query, F.explode(F.transform("k", lambda i: F.get("r", i))).alias("x")).select(query, "x.*")


def prompt(question: Column, evidence: Column, longest: int = 800) -> Column:
    """Question and numbered evidence (array of structs id, text), each cut to ``longest`` characters."""
    short = lambda t: F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("..."))).otherwise(t)
    parts = F.transform(evidence, lambda e, i: F.format_string("[%d] (%s) %s", i + 1, e["id"].cast("string"), short(e["text"])))
    return F.concat(F.lit("Question: "), question, F.lit("\n\nEvidence:\n"), F.array_join(parts, "\n"))


def citations(answer: Column, ids: Column) -> Column:
    """The evidence ids that occur in the answer."""
    return F.filter(ids, lambda i: F.contains(answer, i))


def repaired_json(raw: Column) -> Column:
    """Commas before closing brackets removed, line ends as spaces, and single quotes doubled where no double one occurs."""
    x = F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r",\s*([}\]])", "$1")
    return F.when(F.contains(x, F.lit('"')), x).otherwise(F.replace(x, F.lit("'"), F.lit('"')))


def json_body(raw: Column) -> Column:
    """The object in an answer: as it is, in a code fence, from the first to the last brace, or that repaired; else null."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    brace = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    whole = lambda c: F.when(F.get_json_object(c, "$").isNotNull() & c.rlike(r"^\s*\{"), c)
    return F.coalesce(whole(raw), whole(fence), whole(brace), whole(repaired_json(brace)))


def parse_json(raw: Column, schema: str) -> Column:
    """``json_body`` as a struct; null if there is none."""
    body = json_body(raw)
    return F.when(body.isNotNull(), F.from_json(body, schema, {"mode": "PERMISSIVE"}))


def parse_reranker(raw: Column) -> Column:
    """ranked_ids of a reranker's answer; empty if it has none."""
    return F.coalesce(parse_json(raw, "ranked_ids array<string>")["ranked_ids"], F.array().cast("array<string>"))


def parse_generator(raw: Column) -> Column:
    """Struct answer, citations (empty by default) and confidence ("medium" by default); answer null if it can't be read."""
    x = parse_json(raw, "answer string, citations array<string>, confidence string")
    return F.struct(
        x["answer"].alias("answer"), F.coalesce(x["citations"], F.array().cast("array<string>")).alias("citations"), F.coalesce(x["confidence"], F.lit("medium")).alias("confidence")
    )


def normalize_answer(text: Column) -> Column:
    """Lower case without code fences and signs, white space collapsed: ``10.2`` becomes ``102``."""
    x = F.regexp_replace(text, r"```(?:json)?\s*", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def is_abstention(answer: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(answer)), "[.!]+$", "").rlike(r"^insufficient[\s_]+evidence$")


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def token_f1(a: Column, b: Column) -> Column:
    """Of two sets of tokens; two empty ones agree."""
    same = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0) | (same == 0), 0.0)
        .otherwise(2.0 * same / (F.size(a) + F.size(b)))
    )


def relaxed_match(a: Column, b: Column) -> Column:
    """Either contains the other, or a has four fifths of b's tokens; never if one is empty."""
    ta, tb = token_set(a), token_set(b)
    near = F.size(F.array_intersect(ta, tb)) >= 0.8 * F.size(tb)
    return F.when((a == "") | (b == ""), False).otherwise(F.contains(a, b) | F.contains(b, a) | near)


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(NUMBERS)), F.lit(0)), lambda x: F.trim(x))


def normalize_number(n: Column) -> Column:
    x = F.regexp_replace(F.lower(n), r"\$", "")
    x = F.regexp_replace(x, "([0-9]),([0-9])", "$1$2")
    for word, letter in (("million", "m"), ("billion", "b"), ("thousand", "k"), ("trillion", "t")):
        x = F.replace(x, F.lit(word), F.lit(letter))
    return F.regexp_replace(x, r"\s+", "")


def number_value(n: Column) -> Column:
    """As a double, number words multiplied, percent signs dropped; null if it isn't one."""
    x = F.regexp_replace(F.lower(n), "[$,%]", "")
    factor = F.lit(1.0)
    for word, size in (("million", 1e6), ("billion", 1e9), ("thousand", 1e3), ("trillion", 1e12)):
        factor = F.when(F.contains(x, F.lit(word)), F.lit(size)).otherwise(factor)
    return F.trim(F.regexp_replace(x, "[a-z]+", "")).try_cast("double") * factor


def number_set_match(got: Column, reference: Column) -> Column:
    """The share of numbers that the reference has, normalised; 1 without numbers."""
    ref = F.transform(reference, normalize_number)
    hits = F.size(F.filter(got, lambda n: F.array_contains(ref, normalize_number(n))))
    return F.when(F.size(got) == 0, 1.0).otherwise(hits / F.size(got))


def tolerance_match(got: Column, reference: Column) -> Column:
    """The share of numbers within 1 % of one of the reference's; 1 without numbers."""
    ref = F.filter(F.transform(reference, number_value), lambda v: v.isNotNull())
    near = lambda v: F.exists(ref, lambda r: F.abs(v - r) / F.greatest(F.abs(r), F.lit(1.0)) < 0.01)
    hits = F.size(F.filter(got, lambda n: F.coalesce(near(number_value(n)), F.lit(False))))
    return F.when(F.size(got) == 0, 1.0).otherwise(hits / F.size(got))


def units(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(UNITS)), F.lit(1)), lambda u: F.lower(u)))


def evaluate_answers(df: DataFrame, answer: str, gold: str) -> DataFrame:
    """``df`` with answered, exact, relaxed, f1, number_match, tolerance, unit_match.

    Null where it doesn't apply: all but answered for abstentions, numbers
    where neither side has any.
    """
    a, g = normalize_answer(F.col(answer)), normalize_answer(F.col(gold))
    na, ng, ua, ug = numbers(F.col(answer)), numbers(F.col(gold)), units(F.col(answer)), units(F.col(gold))
    answered = ~is_abstention(F.col(answer))
    some = answered & ((F.size(na) > 0) | (F.size(ng) > 0))
    return df.withColumns(
        {
            "answered": answered.cast("int"),
            "exact": F.when(answered, (a == g).cast("int")),
            "relaxed": F.when(answered, relaxed_match(a, g).cast("int")),
            "f1": F.when(answered, F.round(token_f1(token_set(a), token_set(g)), 6)),
            "number_match": F.when(some, F.round(number_set_match(na, ng), 6)),
            "tolerance": F.when(some, F.round(tolerance_match(na, ng), 6)),
            "unit_match": F.when(answered, F.when(F.size(ua) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(ua, ug)) / F.size(ua), 6))),
        }
    )


def verify_numbers(df: DataFrame, answer: str, evidence: str) -> DataFrame:
    """``df`` with unsupported (numbers the evidence lacks), year_ok and consistent."""
    na = F.array_distinct(F.transform(numbers(F.col(answer)), normalize_number))
    ne = F.transform(numbers(F.col(evidence)), normalize_number)
    missing = F.size(F.array_except(na, ne))
    ya, ye = years(F.col(answer)), years(F.col(evidence))
    year_ok = (F.size(ya) == 0) | (F.size(ye) == 0) | F.arrays_overlap(ya, ye)
    return df.withColumns({"unsupported": missing, "year_ok": year_ok.cast("int"), "consistent": ((missing == 0) & year_ok).cast("int")})


def error_type(question: str, answer: str, gold: str, retrieved: Column, overlap: Column) -> Column:
    """The first error that applies, in the order of the cases."""
    yq, ya, uq, ua = years(F.col(question)), years(F.col(answer)), units(F.col(question)), units(F.col(answer))
    both = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0)
    digits = F.col(question).rlike("[0-9]") & F.col(answer).rlike("[0-9]")
    plain = lambda c: F.regexp_replace(c, ",", "")
    return (
        F.when(retrieved == 0, "unsupported")
        .when(both(yq, ya) & ~F.arrays_overlap(yq, ya), "wrong_year")
        .when(both(uq, ua) & (F.array_sort(uq) != F.array_sort(ua)), "unit_error")
        .when(digits & (plain(F.col(gold)) != plain(F.col(answer))), "arithmetic_error")
        .when(overlap == 0, "missing_evidence")
        .otherwise("other")
    )


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """US dollars at prices for a million tokens."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 8)


def missing_rows(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def plain_answer(text: Column) -> Column:
    """Trimmed, lower case, white space collapsed, without dots at the end: signs inside stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[.]+$", ""), r"\s+", " ")


def begins_with_abstention(answer: Column) -> Column:
    """The abstention stands at the beginning, whatever follows."""
    return answer.rlike(ascii_bounds(r"(?i)^\s*insufficient[\s_]+evidence\b"))


def set_f1(a: Column, b: Column) -> Column:
    """Of the sets of two plain answers' words; 0 if either has none."""
    x, y = token_set(a), token_set(b)
    same = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (same == 0), 0.0).otherwise(2.0 * same / (F.size(x) + F.size(y)))


def answer_rates(df: DataFrame, answer: str, gold: str, consistent: str, hallucinated: str) -> DataFrame:
    """One row: accuracy and exact match of plain answers, set F1, and shares of flags and of INSUFFICIENT_EVIDENCE."""
    a, g = plain_answer(F.col(answer)), plain_answer(F.col(gold))
    exact = (a == g).cast("double")
    share = lambda c: F.round(F.avg(c), 6)
    return df.agg(
        F.count(F.lit(1)).alias("answers"), share(exact).alias("exact_match"), share(set_f1(a, g)).alias("f1"),
        share(F.col(consistent).cast("double")).alias("consistency"), share(F.col(hallucinated).cast("double")).alias("hallucination"),
        share(F.contains(F.upper(F.col(answer)), F.lit("INSUFFICIENT_EVIDENCE")).cast("double")).alias("insufficient"),
    )


def evidence_at(retrieved: Column, gold: Column, k: int = 5) -> Column:
    """Struct hit, recall, all_gold, mrr of the first ``k`` retrieved ids; nulls without gold."""
    top = F.slice(retrieved, 1, k)
    same = F.size(F.array_intersect(top, F.array_distinct(gold)))
    ranks = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    some = F.size(gold) > 0
    return F.struct(
        F.when(some, (same > 0).cast("int")).alias("hit"),
        F.when(some, same / F.size(F.array_distinct(gold))).alias("recall"),
        F.when(some, (F.size(F.array_except(gold, top)) == 0).cast("int")).alias("all_gold"),
        F.when(some, F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))).alias("mrr"),
    )


def needs_arithmetic(answer: Column, evidence: Column) -> Column:
    """Some number of the answer is neither in the evidence, normalised, nor within 1 % of one there."""
    na, ne = numbers(answer), numbers(evidence)
    told = F.transform(ne, normalize_number)
    values = F.filter(F.transform(ne, number_value), lambda v: v.isNotNull())
    near = lambda v: F.exists(values, lambda r: F.abs(v - r) / F.greatest(F.abs(r), F.lit(1.0)) < 0.01)
    return F.exists(na, lambda n: ~F.array_contains(told, normalize_number(n)) & ~F.coalesce(near(number_value(n)), F.lit(False)))


def faithfulness(answer: Column, evidence: Column) -> Column:
    """Struct score and unsupported.

    Without numbers: the share of the answer's words in the evidence, unsupported
    under 0.3.  Else the share of its normalised numbers there; unsupported under
    a half, or if both have years and none in common.
    """
    words_of = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    wa, we = words_of(answer), words_of(evidence)
    na = F.array_distinct(F.transform(numbers(answer), normalize_number))
    ne = F.array_distinct(F.transform(numbers(evidence), normalize_number))
    by_words = F.when(F.size(wa) == 0, 1.0).otherwise(F.size(F.array_intersect(wa, we)) / F.size(wa))
    by_numbers = F.size(F.array_intersect(na, ne)) / F.size(na)
    ya, ye = years(answer), years(evidence)
    apart = (F.size(ya) > 0) & (F.size(ye) > 0) & ~F.arrays_overlap(ya, ye)
    plain = F.size(na) == 0
    return F.struct(
        F.when(plain, by_words).otherwise(by_numbers).alias("score"),
        F.when(plain, by_words < 0.3).otherwise((by_numbers < 0.5) | apart).cast("int").alias("unsupported"),
    )


#: Terms that name a metric in an answer.
METRIC_TERMS = (
    "revenue", "revenues", "income", "profit", "loss", "eps", "ebitda", "ebit", "margin", "cost", "expense", "asset", "liability", "equity",
    "cash flow", "dividend", "roe", "roa", "roi", "pe ratio",
)


def wrong_year(answer: Column, evidence: Column) -> Column:
    """A year that the evidence, which has years, doesn't have."""
    ya, ye = years(answer), years(evidence)
    return ((F.size(ya) > 0) & (F.size(ye) > 0) & (F.size(F.array_except(ya, ye)) > 0)).cast("int")


def wrong_metric(answer: Column, evidence: Column) -> Column:
    """A metric's term that only the answer has."""
    a, e = F.lower(answer), F.lower(evidence)
    return F.exists(F.array(*map(F.lit, METRIC_TERMS)), lambda t: F.contains(a, t) & ~F.contains(e, t)).cast("int")


def judged_answers(df: DataFrame, answer: str, gold: str, evidence: str, retrieved: str, gold_ids: str) -> DataFrame:
    """``df`` with what one answer is judged by against its evidence.

    score: 1 exact, 0.5 relaxed, else 0.  consistency: how many of the answer's
    numbers are the gold's, over the gold's number; it can exceed 1.  Columns
    other than abstained are null for abstentions, those of the evidence
    without gold ids.
    """
    a, g, e = F.col(answer), F.col(gold), F.col(evidence)
    out = begins_with_abstention(a)
    exact, relaxed = normalize_answer(a) == normalize_answer(g), relaxed_match(normalize_answer(a), normalize_answer(g))
    na, ng = numbers(a), numbers(g)
    told = F.transform(ng, normalize_number)
    matched = F.size(F.filter(na, lambda n: F.array_contains(told, normalize_number(n))))
    said = lambda c: F.when(~out, c)
    ev, faith = evidence_at(F.col(retrieved), F.col(gold_ids)), faithfulness(a, e)
    return df.withColumns({
        "abstained": out.cast("int"),
        "score": said(F.when(exact, 1.0).when(relaxed, 0.5).otherwise(0.0)),
        "consistency": said(F.when(F.size(ng) == 0, 1.0).otherwise(F.round(matched / F.size(ng), 6))),
        "faithfulness": said(F.round(faith["score"], 6)),
        "unsupported": said(faith["unsupported"]),
        "arithmetic": said(needs_arithmetic(a, e).cast("int")),
        "wrong_year": said(wrong_year(a, e)),
        "wrong_metric": said(wrong_metric(a, e)),
        "hit": ev["hit"], "recall": F.round(ev["recall"], 6), "all_gold": ev["all_gold"], "mrr": F.round(ev["mrr"], 6),
    })


def judged_summary(df: DataFrame, answer: str, *keys: str) -> DataFrame:
    """Means of ``judged_answers`` over what they apply to, by ``keys``; api_errors are empty answers that don't abstain."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    empty = (F.trim(F.coalesce(F.col(answer), F.lit(""))) == "") & (F.coalesce("abstained", F.lit(0)) == 0)
    names = ("score", "consistency", "faithfulness", "unsupported", "arithmetic", "wrong_year", "wrong_metric", "hit", "recall", "all_gold", "mrr")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("answers"), F.sum("abstained").alias("abstained"), F.sum(empty.cast("int")).alias("api_errors"), *map(mean, names))


def examples(df: DataFrame, kind: str, order: str, most: int = 3) -> DataFrame:
    """The first ``most`` rows of each kind."""
    from pyspark.sql import Window

    w = Window.partitionBy(kind).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def first_text(df: DataFrame, sources: list[DataFrame], key: str, placeholder: str = "[text not available]") -> DataFrame:
    """``df`` with text from the first of ``sources`` (key, text; one row a key) that has any, else a placeholder."""
    found, texts = df, []
    for i, s in enumerate(sources):
        found = found.join(s.select(key, F.col("text").alias(f"_t{i}")), key, "left")
        texts.append(F.when(F.trim(f"_t{i}") != "", F.col(f"_t{i}")))
    return found.withColumn("text", F.coalesce(*texts, F.lit(placeholder))).drop(*[f"_t{i}" for i in range(len(sources))])


def budgeted_evidence(df: DataFrame, query: str, k: int, budget: int) -> DataFrame:
    """The first ``k`` rows a query by rank, each chunk once, cut to ``budget`` tokens, with truncated: whether any was dropped.

    ``df``: query, chunk_id, rank, text.
    """
    from tessera.functions.text import estimate_tokens
    from tessera.operators.retrieval import dedupe_best_rank

    once = dedupe_best_rank(df, query, "chunk_id").withColumn("tokens", estimate_tokens(F.col("text"))).filter(F.col("rank") <= k)
    kept = token_budget(once.select(query, "rank", "chunk_id", "tokens"), query, "rank", "tokens", budget)
    n = once.groupBy(query).agg(F.count(F.lit(1)).alias("_all"))
    m = kept.groupBy(query).agg(F.count(F.lit(1)).alias("_kept"))
    flags = n.join(m, query, "left").select(query, (F.coalesce("_kept", F.lit(0)) < F.col("_all")).alias("truncated"))
    return kept.join(flags, query)
