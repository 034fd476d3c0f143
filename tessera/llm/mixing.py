"""Mixing sources to target weights by hash-threshold histograms.

Each source has a budget of words.  A document's hash decides how often it is
taken: every source has a threshold, and documents under it are taken once more
than the others.  The threshold is found from sums by source and hash bucket;
only the bucket in which the budget ends is looked at more closely, level by
level, down to a single hash.  Documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, 15 hexadecimal digits, and bits that each level decides.
HASH_BITS, LEVELS = 60, (12, 24, 24)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 of the id, or of the text where the id is null."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3
) -> DataFrame:
    """Budgets from ``sizes`` (source, source_size): columns source, source_size, target.

    Sources in code point order, null last, weigh ``weights`` over and over and
    share ``share`` of all words.  A target stops at ``most`` times its
    source's size and the excess is shared by weight among the others, until
    none is above.  In closed form: with sources in order of cap over weight,
    a source stops at its cap if, with all at this ratio, the caps reached and
    the weights left use no more than the total.

    The windows have one partition: a row a source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(by_name)).withColumn("_w", w.cast("long"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap").cast("double") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("source_size").over(everything)
    budget = total if share == 1.0 else F.floor(total * F.lit(share)).cast("long")
    x = (
        ranked.withColumn("_cap", F.col("source_size") * most)
        .withColumn("_budget", budget)
        .withColumn("_caps", F.sum("_cap").over(by_ratio))
        .withColumn("_left", F.sum("_w").over(everything) - F.sum("_w").over(by_ratio))
    )
    # caps so far + (cap / weight) * weights left <= budget, in whole numbers as decimals
    stops = F.col("_cap").cast("decimal(20,0)") * F.col("_left") <= (F.col("_budget") - F.col("_caps")).cast(
        "decimal(20,0)"
    ) * F.col("_w")
    x = x.withColumn("_stops", stops)
    used = F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("_w"))).over(everything)
    level = (F.col("_budget") - used).cast("double") / free
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)
    return x.select("source", "source_size", target.alias("target"))


def _rest(t: str = "target", n: str = "source_size") -> tuple[Column, Column]:
    """Whole passes over a source, and the words that are left for its threshold."""
    whole = F.when(F.col(n) > 0, F.floor(F.col(t) / F.col(n))).otherwise(F.lit(0)).cast("long")
    return whole, F.col(t) - whole * F.col(n)


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """Hash below which, and source in which, a document is taken once more.

    ``slim``: durable rows of source, size and h.  Result: source, target,
    source_size, whole, below.  Documents with ``h < below`` fill the words
    that whole passes leave.  The hash in which the budget ends is taken if
    that comes nearer to the budget than leaving it; documents with the same
    hash (that is, the same id) go together.
    """
    whole, rest = _rest()
    state = targets.select("source", "source_size", "target", whole.alias("whole"), rest.alias("rest")).withColumn(
        "prefix", F.lit(0).cast("long")
    )
    state = durable(state)
    rows, bits = slim, 0
    for n in LEVELS:
        bits += n
        shift = HASH_BITS - bits
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("m"))
        upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        s = state.withColumnRenamed("source", "s")
        cum = sums.withColumn("cum", F.sum("m").over(upto)).join(s, F.col("source").eqNullSafe(F.col("s")))
        # the first bucket whose sum passes the budget
        end = (
            cum.filter(F.col("cum") > F.col("rest"))
            .groupBy("source")
            .agg(F.min_by(F.struct("b", "m", "cum"), "b").alias("e"))
            .select(F.col("source").alias("s2"), "e.*")
        )
        found = state.join(end, F.col("source").eqNullSafe(F.col("s2")), "left")
        # a source that is already settled, or whose sum never passes, has no such bucket
        open_ = F.col("b").isNotNull()
        state = durable(
            found.select(
                "source",
                "source_size",
                "target",
                "whole",
                F.when(open_, F.col("rest") - (F.col("cum") - F.col("m"))).otherwise(F.lit(0.0)).alias("rest"),
                F.when(open_, F.col("b")).alias("prefix"),
                F.col("m").alias("last"),
            )
        )
        if shift:
            edge = broadcast_if_small(state.select(F.col("source").alias("s3"), F.col("prefix").alias("p3")))
            same = F.col("source").eqNullSafe(F.col("s3")) & (F.shiftright("h", shift) == F.col("p3"))
            rows = durable(rows.join(edge, same).select("source", "size", "h"))
    nearer = F.col("last") - F.col("rest") < F.col("rest")
    everything = F.lit(1 << HASH_BITS)
    below = F.when(F.col("prefix").isNull(), everything).otherwise(
        F.col("prefix") + F.when(nearer, 1).otherwise(0)
    )
    return state.select("source", "source_size", "target", "whole", below.cast("long").alias("below"))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = 3,
) -> DataFrame:
    """How often the mix takes each row of ``df``: doc_id, source, size, source_size, target, copies.

    Null texts and texts without words have size 0 and are taken as their hash
    says.  A null source is a source.  Rows with one id rise and fall together;
    rows with a null id go by their text.  Sources without words have target 0.
    No rows: no rows.  The hash of a row depends on nothing else, so reruns
    agree, and a row's fate changes little when the table grows.
    """
    slim = durable(
        df.select(
            df[doc_id].alias("doc_id"),
            df[source].alias("source"),
            word_count(df[text]).alias("size"),
            document_hash(df[doc_id], df[text]).alias("h"),
        )
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = durable(thresholds(slim, source_targets(sizes, weights, share, most)))
    t = broadcast_if_small(found.withColumnRenamed("source", "_s"))
    copies = F.col("whole") + F.when((F.col("h") < F.col("below")) & (F.col("whole") < most), 1).otherwise(0)
    return slim.join(t, slim["source"].eqNullSafe(t["_s"])).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), "h"
    )


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that the mix takes, as often as it takes them; columns as in ``df``.

    The thresholds, a few numbers a source, are joined to the rows; the rows
    themselves aren't shuffled unless there are too many sources to broadcast.
    """
    most = how.get("most", 3)
    slim = durable(
        df.select(
            df[source].alias("source"), word_count(df[text]).alias("size"), document_hash(df[doc_id], df[text]).alias("h")
        )
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = durable(thresholds(slim, source_targets(sizes, **how)))
    s, w, b, h, n = (fresh(df, x) for x in ("mix_s", "mix_w", "mix_b", "mix_h", "mix_n"))
    t = broadcast_if_small(found.select(F.col("source").alias(s), F.col("whole").alias(w), F.col("below").alias(b)))
    hashed = df.withColumn(h, document_hash(df[doc_id], df[text]))
    copies = F.col(w) + F.when((F.col(h) < F.col(b)) & (F.col(w) < most), 1).otherwise(0)
    taken = hashed.join(t, hashed[source].eqNullSafe(F.col(s))).withColumn(n, copies).filter(F.col(n) > 0)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*df.columns)


#: The same mix in DuckDB's SQL, by sorting each source; {docs} is the input, {weights} the weights.
MIX_SQL = r"""
slim AS (
  SELECT doc_id, source, text_row,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || text, '')), 1, 15))::BIGINT AS h
  FROM (SELECT *, row_number() OVER () AS text_row FROM {docs})),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n, 3 * source_size AS cap,
         (sum(source_size) OVER ())::BIGINT AS budget FROM sizes),
weighed AS (SELECT *, [1, 2, 3][((n - 1) % 3 + 1)::INT]::BIGINT AS w FROM ranked),
run AS (
  SELECT *, sum(cap) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS leftw FROM weighed
  WINDOW o AS (ORDER BY cap::DOUBLE / w, n ROWS UNBOUNDED PRECEDING)),
stop AS (SELECT *, cap::HUGEINT * leftw <= (budget - caps)::HUGEINT * w AS stops FROM run),
target AS (
  SELECT source, source_size,
         CASE WHEN stops THEN cap::DOUBLE ELSE w * (
           (budget - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ())::DOUBLE
           / (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ())::DOUBLE) END AS target
  FROM stop),
rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM target),
groups AS (SELECT source, h, sum(size)::BIGINT AS m FROM slim GROUP BY source, h),
cums AS (SELECT *, sum(m) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM groups),
taken AS (
  SELECT slim.doc_id, slim.text_row, slim.size, rest.source_size, rest.target,
         rest.whole + CASE WHEN rest.whole < 3 AND (
           cums.cum <= rest.target - rest.whole * rest.source_size
           OR cums.cum - cums.m <= rest.target - rest.whole * rest.source_size
              AND cums.cum - (rest.target - rest.whole * rest.source_size)
                  < rest.target - rest.whole * rest.source_size - (cums.cum - cums.m)) THEN 1 ELSE 0 END AS copies
  FROM slim JOIN rest ON slim.source IS NOT DISTINCT FROM rest.source
  JOIN cums ON slim.source IS NOT DISTINCT FROM cums.source AND slim.h = cums.h)
"""
OP2_SQL = "WITH " + MIX_SQL.format(docs="documents") + """
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM taken"""
