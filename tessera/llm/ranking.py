"""Gapless numbering inside classes without one sorted task a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(
    rows: DataFrame, class_col: str, order: list[str], out: str, buckets: int
) -> DataFrame:
    """Add ``out``: a number from 0, gapless in each value of ``class_col``.

    Equal rows are counted before the shuffle and spread out again at the end,
    so one row repeated any number of times costs one row until then.  Each
    class is dealt over ``buckets`` hash buckets; a bucket's numbers start
    where those of the buckets before it end.  The order inside a class is by
    bucket and then ``order``: fixed by the rows' values alone, whatever the
    partitioning.  No row: no row.  ``class_col`` may be null (a class of its own).
    """
    cols = rows.columns
    b: Column = F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", b)
    sums = counted.groupBy(class_col, "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(class_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(class_col).alias("_c"), F.col("_b").alias("_sb"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start")
    )
    inside = (
        Window.partitionBy(class_col, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = placed.join(
        starts, placed[class_col].eqNullSafe(starts["_c"]) & (placed["_b"] == starts["_sb"])
    )
    first = F.col("_start") + F.col("_in")
    return joined.select(
        *cols, F.explode(F.sequence(first.cast("long"), (first + F.col("_n") - 1).cast("long"))).alias(out)
    )
