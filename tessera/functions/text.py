"""Text expressions: tokens, normal forms, ids, HTML, chunks.

Regular expressions keep to what Java and RE2 read alike; classes are ASCII.
Empty strings mean missing in chunk columns.  A null gives a null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` for Spark, with ``\\b`` at the ends of runs of a-z, A-Z, 0-9 and _ only, as RE2 reads it.

    Java's own also sees letters beyond these: it has no word ``dollar`` in
    ``\u00f1dollar``.  What begins with a word's character takes the short form;
    an alternative like ``%`` at the beginning of a group takes the whole one.
    """
    either = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    whole = re.sub(r"\\b(?=$|[|)]|\((?:[^()]*\|)?[^\w(\[?\\])", lambda m: either, pattern)
    return whole.replace(r"\b", r"(?<!\w)")


def words(text: Column) -> Column:
    """Lower-cased pieces between white space, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def normalize_text(text: Column) -> Column:
    """Lower case, white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def alnum_tokens(text: Column, longer_than: int = 2) -> Column:
    """Distinct runs of a-z and 0-9 of more than ``longer_than`` characters, in order of appearance."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def safe_id(value: Column, longest: int = 80) -> Column:
    """Lower case; all but a-z, 0-9, dot, underscore and hyphen become single hyphens; none at the ends."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9._-]+", "-"), "-+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, longest)


def chunk_id(kind: Column, doc: Column, section: Column, offset: Column, text: Column) -> Column:
    """Stable id from what a chunk is, where it is and what it says."""
    some = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    digest = F.substring(F.sha1(normalize_text(text)), 1, 10)
    return F.concat_ws("::", kind, some(safe_id(doc), "no-doc"), some(safe_id(section), "no-section"), offset.cast("string"), digest)


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """First words of the windows over ``n`` words; the last window ends at the last word."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap at least 0 and under size")
    step = size - overlap
    more = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), more * step, F.lit(step))).otherwise(F.array().cast("array<int>"))


def chunk_text(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """A row a window of words: ``df``'s columns, chunk_text, word_offset, word_count.  No words: no row."""
    cut = df.withColumn("_w", F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    rows = cut.withColumn("word_offset", F.explode(chunk_starts(F.size("_w"), size, overlap)))
    part = F.slice("_w", F.col("word_offset") + 1, F.lit(size))
    return rows.select(*df.columns, F.array_join(part, " ").alias("chunk_text"), "word_offset", F.size(part).alias("word_count"))


def chunk_table(df: DataFrame, text: str, max_rows: int) -> DataFrame:
    """Blocks of a Markdown table, the two header lines repeated: chunk_text, row_offset, row_count."""
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    lines = df.withColumn("_l", F.split(F.trim(F.col(text)), "\n")).filter(F.size("_l") > 2)
    last = (F.floor((F.size("_l") - 3) / max_rows) * max_rows).cast("int")
    rows = lines.withColumn("row_offset", F.explode(F.sequence(F.lit(0), last, F.lit(max_rows))))
    body = F.slice("_l", F.col("row_offset") + 3, F.lit(max_rows))
    whole = F.array_join(F.concat(F.slice("_l", 1, 2), body), "\n")
    return rows.select(*df.columns, whole.alias("chunk_text"), "row_offset", F.size(body).alias("row_count"))


#: What a heading of a filing's item looks like, and a file name that names its filing.
ITEM = r"(?im)^[ \t]*(item\s+\d+[a-z]?\.?)"
FILING_NAME = r"(?i)^([a-z.]+)[_-]((?:19|20)[0-9]{2})[_-](10-?k|10-?q|8-?k)"


def filing_from_name(name: Column) -> Column:
    """Struct of company, filing_type and filing_year from a file name; '' where it doesn't say."""
    part = lambda i: F.regexp_extract(name, FILING_NAME, i)
    kind = F.regexp_replace(F.upper(part(3)), "^(10|8)-?", "$1-")
    year = F.when(part(2) != "", part(2)).otherwise(F.regexp_extract(name, "(19[0-9]{2}|20[0-9]{2})", 1))
    return F.struct(F.upper(part(1)).alias("company"), kind.alias("filing_type"), year.alias("filing_year"))


def sections(df: DataFrame, text: str) -> DataFrame:
    """A row an item of a filing: ``df``'s columns, section, body, pos.  What precedes the first heading
    is dropped; a text without headings is one section, "Full Document"."""
    mark = "\x01"
    parts = F.split(F.regexp_replace(F.col(text), ITEM, mark + "$1" + mark), mark)
    n = F.floor((F.size("_p") - 1) / 2).cast("int")
    cut = df.withColumn("_p", parts)
    named = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.struct(F.trim(F.get(F.col("_p"), 2 * i - 1)).alias("section"), F.regexp_replace(F.get(F.col("_p"), 2 * i), r"^\s+|\s+$", "").alias("body"))
    )
    whole = F.array(F.struct(F.lit("Full Document").alias("section"), F.col(text).alias("body")))
    rows = cut.select(*df.columns, F.posexplode(F.when(n >= 1, named).otherwise(whole)).alias("pos", "_s"))
    return rows.select(*df.columns, "_s.section", "_s.body", "pos")


#: Entities decoded after the tags are gone, the ampersand last.
ENTITIES = {
    "&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&middot;": "·", "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&sect;": "§", "&euro;": "€",
    "&pound;": "£", "&yen;": "¥", "&cent;": "¢", "&deg;": "°", "&plusmn;": "±", "&times;": "×", "&frac12;": "½", "&frac14;": "¼", "&frac34;": "¾",
    "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ccedil;": "ç", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö",
    "&Uuml;": "Ü", "&szlig;": "ß", "&ntilde;": "ñ", "&amp;": "&",
}


def _numbered(x: Column) -> Column:
    """Characters given by number, decimal or hexadecimal, from what splits at each of them."""
    digits = F.regexp_extract_all(x, F.lit("(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(1))
    parts = F.split(x, "(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});")

    def char(d: Column) -> Column:
        code = F.when(F.lower(F.substring(d, 1, 1)) == "x", F.conv(F.substring(d, 2, 8), 16, 10)).otherwise(d).cast("int")
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32BE")

    told = F.concat(F.transform(digits, char), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, told, lambda a, b: F.concat(a, b)), "")


def html_to_text(html: Column, decode: bool = True) -> Column:
    """Text of a page: scripts and styles dropped, lines for br, ends of p and div, other tags and blanks as one space.

    Entities are decoded last, if asked: by number all of them, by name those in ``ENTITIES``.
    """
    x = F.regexp_replace(html, r"(?is)<script.*?>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style.*?>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</p\s*>|</div\s*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    if decode:
        x = F.when(x.rlike("(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"), _numbered(x)).otherwise(x)
        for name, value in ENTITIES.items():
            x = F.replace(x, F.lit(name), F.lit(value))
    return x


def estimate_tokens(text: Column) -> Column:
    """0 for an empty text, else a quarter of its characters, at least 1."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")
