import pytest
from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_chunks_overlap_and_end_at_the_last_word(spark):
    df = spark.createDataFrame([(" ".join(f"token{i}" for i in range(80)),), ("",), ("one",)], "text string")
    rows = T.chunk_text(df, "text", 20, 5).select("word_offset", "word_count").collect()
    assert sorted(map(tuple, rows)) == sorted([(0, 20), (15, 20), (30, 20), (45, 20), (60, 20), (0, 1)])


@pytest.mark.parametrize("size, overlap", [(0, 0), (5, 5), (5, -1)])
def test_bad_chunk_sizes(size, overlap):
    with pytest.raises(ValueError):
        T.chunk_starts(F.lit(3), size, overlap)


def test_table_chunks_repeat_the_header(spark):
    df = spark.createDataFrame([("a|b\n-|-\n1|2\n3|4",), ("a|b",)], "text string")
    rows = [tuple(r) for r in T.chunk_table(df, "text", 1).select("chunk_text", "row_offset", "row_count").collect()]
    assert rows == [("a|b\n-|-\n1|2", 0, 1), ("a|b\n-|-\n3|4", 1, 1)]


def test_sections(spark):
    df = spark.createDataFrame([("intro\nItem 1. Business\nwe sell\nItem 1A. Risk\nrain",), ("no headings",)], "t string")
    rows = [(r["section"], r["body"]) for r in T.sections(df, "t").collect()]
    assert rows == [("Item 1.", "Business\nwe sell"), ("Item 1A.", "Risk\nrain"), ("Full Document", "no headings")]


def test_filing_name(spark):
    assert tuple(one(spark, T.filing_from_name(F.col("n")), n="ACME_2025_10-K.txt")) == ("ACME", "10-K", "2025")
    assert one(spark, T.filing_from_name(F.col("n")), n="report 1999")["filing_year"] == "1999"


def test_html(spark):
    html = "<html><script>x<y</script><p>Fish &amp; chips</p><div>a&lt;b</div>"
    assert one(spark, T.html_to_text(F.col("h")), h=html).strip() == "Fish & chips\n a<b"


def test_ids_are_stable_and_distinct(spark):
    rows = [("Item 7", "0", "Some  Text"), ("Item 7", "0", "some text"), ("Item 7", "5", "some text"), ("", "0", "x")]
    df = spark.createDataFrame(rows, "s string, o string, t string")
    ids = [r[0] for r in df.select(T.chunk_id(F.lit("text"), F.lit("DOC 1"), F.col("s"), F.col("o"), F.col("t"))).collect()]
    assert ids[0] == ids[1] != ids[2]
    assert ids[0].startswith("text::doc-1::item-7::0::") and "::no-section::" in ids[3]


def test_entities(spark):
    t = "In fiscal year 2023 and FY2021 Acme Inc. filed a 10-k: net income rose, Revenue fell"
    assert one(spark, E.years(F.col("t")), t=t) == ["2023", "2021"]
    assert one(spark, E.metrics(F.col("t")), t=t) == ["net income", "revenue"]
    assert one(spark, E.filing_types(F.col("t")), t=t) == ["10-K"]
    assert one(spark, E.companies(F.col("t")), t=t) == ["Acme Inc"]
    assert one(spark, E.years_with_ranges(F.col("t")), t="2021-23 or 2030 to 2031") == ["2021", "2022", "2023", "2030", "2031"]
    assert one(spark, E.query_type(F.col("t")), t="Why did it change?") == [0, 1, 1, 0]
    assert one(spark, E.query_type(F.col("t")), t="hello") == [0, 0, 0, 1]


def test_canonical_names(spark):
    aliases = [("sales", "revenue"), ("net sales", "net revenue")]
    assert one(spark, E.canonical_first(F.col("t"), aliases), t="Net   Sales") == "net revenue"
    assert one(spark, E.canonical_first(F.col("t"), aliases), t="total net sales") == "revenue"
    assert one(spark, E.canonical_exact(F.col("t"), dict(aliases)), t="other") == "other"


def test_words_end_at_letters_beyond_ascii_as_in_sql(spark):
    from tessera.operators import generation

    t = F.col("t")
    assert one(spark, generation.units(t), t="queñdollar ciópercenté dollary 5%x 5% x") == ["dollar", "percent", "%"]
    assert one(spark, E.metrics(t), t="ñrevenue") == ["revenue"]
    assert one(spark, E.years(t), t="é2021é, 20212") == ["2021"]
    assert one(spark, generation.numbers(t), t="ñ12 a7") == ["12"]
    assert one(spark, E.aliases_in(t, ["cash"]), t="ñcash") == ["cash"]
    assert one(spark, generation.begins_with_abstention(t), t="Insufficient evidenceé")
