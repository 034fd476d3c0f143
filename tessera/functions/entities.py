"""Entity extraction by pattern, with vocabularies that can be replaced."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ascii_bounds

#: The default vocabulary of financial metrics.
METRICS = (
    r"\b(revenue|revenues|sales|net\s+sales)\b",
    r"\b(net\s+income|net\s+earnings|net\s+loss|profit)\b",
    r"\b(operating\s+income|operating\s+earnings|operating\s+loss)\b",
    r"\b(gross\s+profit|gross\s+margin)\b",
    r"\b(eps|earnings\s+per\s+share|diluted\s+eps|basic\s+eps)\b",
    r"\b(ebitda|adjusted\s+ebitda|ebit)\b",
    r"\b(total\s+assets|total\s+liabilities|total\s+equity)\b",
    r"\b(cash\s+and\s+cash\s+equivalents|cash\s+flow)\b",
    r"\b(free\s+cash\s+flow|operating\s+cash\s+flow)\b",
    r"\b(operating\s+expenses|r\s*&?\s*d\s+expenses?|research\s+and\s+development)\b",
    r"\b(sg\s*&?\s*a|selling\s+general\s+and\s+administrative)\b",
    r"\b(cost\s+of\s+(revenue|sales|goods\s+sold)|cogs)\b",
    r"\b(shareholders?.?\s*equity|stockholders?.?\s*equity)\b",
    r"\b(working\s+capital|long[\s-]term\s+debt|short[\s-]term\s+debt)\b",
    r"\b(dividends?\s+(per\s+share)?|capital\s+expenditures?|capex)\b",
    r"\b(return\s+on\s+(equity|assets|invested\s+capital)|roe|roa|roic)\b",
    r"\b(market\s+cap(italization)?|enterprise\s+value)\b",
)
#: Years, companies, kinds of filing, numbers, units, abstentions.
YEARS = r"(?i)\b(?:19|20)[0-9]{2}\b|FY\s*(?:19|20)[0-9]{2}|fiscal\s+year\s+(?:19|20)[0-9]{2}"
COMPANIES = (
    r"\b([A-Z][a-z]+(?:\s+(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|"
    r"PLC|LLC|Group|Holdings?|International|Technologies?)))\b"
)
FILINGS = r"(?i)\b(10-K|10-Q|8-K|20-F|40-F|S-1|S-3)\b"
NUMBERS = (
    r"(?i)\b[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\b"
    r"|\b[0-9]+\.?[0-9]*\s*(?:million|billion|thousand|trillion)\b"
    r"|\b[0-9]+\.?[0-9]*\s*%"
    r"|\$\s*[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\b"
)
UNITS = r"(?i)\b(million|billion|thousand|trillion|percent|%|dollars?\$?)\b"
#: Words of questions that compare, and of questions that want an explanation.
COMPARISON = (
    "compare", "comparison", "versus", " vs ", "change", "increase", "decrease", "growth", "decline", "trend", "delta", "between",
    "year over year", "yoy", "qoq",
)
EXPLANATION = ("why", "explain", "reason", "risk", "disclosure", "describe", "discussion", "management", "factor", "outlook")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(group)))


def metrics(text: Column, patterns: tuple[str, ...] = METRICS) -> Column:
    one = "|".join(patterns)
    if all(re.fullmatch(r"\\b\((?:[^()]|\([^()]*\))*\)\\b", p) for p in patterns):  # asked once a place, not once a pattern
        one = r"\b(?:" + "|".join(p[2:] for p in patterns) + ")"
    every = F.regexp_extract_all(text, F.lit(ascii_bounds("(?i)" + one)), F.lit(0))
    return F.array_distinct(F.transform(every, lambda m: F.lower(F.trim(m))))


def years(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(ascii_bounds(YEARS)), F.lit(0))
    return F.array_distinct(F.transform(every, lambda y: F.regexp_extract(y, "((?:19|20)[0-9]{2})", 1)))


def companies(text: Column) -> Column:
    return found(text, COMPANIES, 1)


def filing_types(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(FILINGS)), F.lit(0)), lambda t: F.upper(t)))


def section_values(section: Column, filing_type: Column) -> Column:
    """The section, and the filing as ``filing:<type>``; what is empty is left out."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.array_compact(F.array(some(section), F.concat(F.lit("filing:"), some(filing_type))))


def years_with_ranges(text: Column, longest: int = 10) -> Column:
    """Years, and all between the ends of ranges like 2021-23 or 2021 to 2023."""
    spans = F.regexp_extract_all(text, F.lit(ascii_bounds(r"(?:19|20)[0-9]{2}\s*(?:-|to)\s*(?:(?:19|20)[0-9]{2}|[0-9]{2})\b")), F.lit(0))

    def between(s: Column) -> Column:
        a = F.substring(s, 1, 4).cast("int")
        b = F.regexp_extract(s, "([0-9]+)$", 1)
        e = F.when(F.length(b) == 2, F.concat(F.substring(s, 1, 2), b)).otherwise(b).cast("int")
        ok = (e >= a) & (e - a <= longest)
        return F.when(ok, F.transform(F.sequence(a, F.greatest(e, a)), lambda y: y.cast("string"))).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.concat(years(text), F.flatten(F.transform(spans, between)))))


def contains_any(text: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(text, F.lit(n))
    return out


def query_type(text: Column) -> Column:
    """Flags: number asked, comparison, explanation, none of these."""
    low = F.lower(text)
    number = text.rlike("[0-9]") | (F.size(metrics(text)) > 0)
    compares, explains = contains_any(low, COMPARISON), contains_any(low, EXPLANATION)
    return F.array(*[c.cast("int") for c in (number, compares, explains, ~(number | compares | explains))])


def canonical_exact(value: Column, aliases: dict[str, str]) -> Column:
    """By an exact alias after white space is collapsed, else the value itself."""
    clean = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, clean), clean)


def canonical_first(value: Column, aliases: list[tuple[str, str]]) -> Column:
    """By an exact alias, else by the first alias in the list that occurs in the value, else the value."""
    clean = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    out = clean
    for alias, name in reversed(aliases):
        out = F.when(F.contains(clean, F.lit(alias)), F.lit(name)).otherwise(out)
    for alias, name in aliases:
        out = F.when(clean == alias, F.lit(name)).otherwise(out)
    return out


#: What makes a question about more than one year.
COMPARING_YEARS = (
    r"from\s+(?:FY\s*)?(?:19|20)[0-9]{2}\s+to\s+(?:FY\s*)?(?:19|20)[0-9]{2}",
    r"between\s+(?:FY\s*)?(?:19|20)[0-9]{2}\s+and\s+(?:FY\s*)?(?:19|20)[0-9]{2}",
    r"change\s+(?:from\s+)?(?:FY\s*)?(?:19|20)[0-9]{2}",
    r"compared\s+to\s+(?:FY\s*)?(?:19|20)[0-9]{2}",
    r"from\s+[0-9]{2,4}\s*[-–]\s*[0-9]{2,4}",
    r"(?:19|20)[0-9]{2}\s*[-–]\s*(?:19|20)[0-9]{2}",
    r"growth\s+(?:from|since)\s+(?:19|20)[0-9]{2}",
    r"increase\s+(?:from|since)\s+(?:19|20)[0-9]{2}",
    r"decrease\s+(?:from|since)\s+(?:19|20)[0-9]{2}",
    r"delta\s+in\s+.*?[0-9]{2,4}\s*[-–]\s*[0-9]{2,4}",
    r"trend\s+(?:from|since)\s+(?:19|20)[0-9]{2}",
    r"YoY|year[-\s]over[-\s]year|year[-\s]on[-\s]year",
)
#: A second vocabulary, for scoring by constraints, and a third, for hard negatives.
SCORING_METRICS = (
    r"\b(revenue|revenues|sales|net\s+income|net\s+earnings|net\s+loss|profit|"
    r"operating\s+income|operating\s+earnings|gross\s+profit|gross\s+margin|"
    r"eps|earnings\s+per\s+share|ebitda|ebit|total\s+assets|total\s+liabilities|"
    r"cash\s+flow|free\s+cash\s+flow|r\s*&?\s*d|sg\s*&?\s*a|"
    r"cost\s+of\s+(revenue|sales|goods\s+sold)|dividends?)\b",
)
SCORING_FILINGS = r"(?i)\b(10-K|10-Q|8-K|annual\s+report|quarterly\s+report)\b"
SCORING_COMPANIES = (
    r"\b([A-Z][a-z]+(?:\s+(?:Inc\.?|Corp\.?|Corporation|Ltd\.?|Limited|"
    r"PLC|LLC|Technologies?|Group|Holdings?)))\b"
)
NEGATIVE_METRICS = (
    r"\b(revenue|net\s+income|operating\s+income|gross\s+profit|eps|ebitda|ebit)\b",
    r"\b(total\s+assets|total\s+liabilities|cash\s+flow|free\s+cash\s+flow)\b",
    r"\b(operating\s+expenses|r\s*&?\s*d|sg\s*&?\s*a|cost\s+of\s+revenue)\b",
    r"\b(shareholders?.?\s*equity|working\s+capital|long.term\s+debt)\b",
)
#: Sections that questions name.
SECTION_WORDS = (
    "item 1", "item 1a", "item 7", "item 8", "mda", "risk factors", "financial statements", "notes", "business", "management discussion",
)


def compares_years(text: Column) -> Column:
    """One of the patterns that name a change between years, or two different years."""
    said = text.rlike("(?i)" + "|".join(COMPARING_YEARS))
    return said | (F.size(years(text)) >= 2)


def bare_years(text: Column) -> Column:
    """Years as they stand, without what is read from FY or ranges."""
    return found(text, r"\b((?:19|20)[0-9]{2})\b", 1)


def scoring_entities(text: Column) -> dict[str, Column]:
    """Metrics, years, filing types as written and companies in lower case, by the scoring vocabulary."""
    return {
        "metrics": metrics(text, SCORING_METRICS),
        "years": bare_years(text),
        "filings": found(text, SCORING_FILINGS),
        "companies": F.array_distinct(F.transform(found(text, SCORING_COMPANIES, 1), lambda c: F.lower(F.trim(c)))),
    }


def years_with_ends(text: Column) -> Column:
    """Years, and both ends of ranges like 2021-23, but none between them."""
    spans = F.regexp_extract_all(text, F.lit(ascii_bounds(r"(?:19|20)[0-9]{2}\s*[-–]\s*[0-9]{2,4}\b")), F.lit(0))

    def last(s: Column) -> Column:
        b = F.regexp_extract(s, "([0-9]+)$", 1)
        return F.when(F.length(b) == 2, F.concat(F.substring(s, 1, 2), b)).when(F.length(b) == 4, b)

    ends = F.array_compact(F.transform(spans, last))
    return F.array_sort(F.array_distinct(F.concat(years(text), ends)))


def sections_named(text: Column, names: tuple[str, ...] = SECTION_WORDS) -> Column:
    """The section words that occur in a text, in the order of the list."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, names)), lambda s: F.contains(low, s))


def spaced(value: Column) -> Column:
    """Lower case, underscores and hyphens as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "[_-]", " "), r"\s+", " "))


def aliases_in(text: Column, aliases: list[str]) -> Column:
    """The aliases that stand in a text as whole words, in the order of the list."""
    low, end = F.lower(text), F.lit(ascii_bounds(r"\b"))  # whole form: aliases are not patterns of ours
    return F.filter(F.array(*map(F.lit, aliases)), lambda a: F.rlike(low, F.concat(end, a, end)))


def overlaps_name(a: Column, b: Column) -> Column:
    """Either name contains the other, in lower case."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)


def companies_overlap(left: Column, right: Column) -> Column:
    """Any two names contain one another, or share at least half of the shorter one's words."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))

    def same(x: Column, y: Column) -> Column:
        n = F.size(F.array_intersect(tokens(x), tokens(y)))
        return overlaps_name(F.trim(x), F.trim(y)) | ((n > 0) & (n >= 0.5 * F.least(F.size(tokens(x)), F.size(tokens(y)))))

    return F.exists(left, lambda x: F.exists(right, lambda y: same(x, y)))


def clear_year_conflict(asked: Column, told: Column) -> Column:
    """No year of the one within a year of the other's; never if the passage has over five years.

    Without years on either side it is a conflict if the two have none in common, that is always.
    """
    near = F.exists(asked, lambda a: F.exists(told, lambda b: F.abs(a.cast("int") - b.cast("int")) <= 1))
    none = (F.size(asked) == 0) | (F.size(told) == 0)
    return F.when(none, F.lit(True)).when(F.size(told) > 5, F.lit(False)).otherwise(~near)
