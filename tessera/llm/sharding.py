"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable key and the number of shards decide the shard; there is no ring and
no table.  When shards are appended, a row either stays or moves to a new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh
from .ranking import number_within

#: Fixed values of the published method: the generator's multiplier, and 2 to the 31.
LCG, SCALE = 2862933555777941757, 1 << 31


def jump_buckets(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; one vectorised step for all keys still moving."""
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    at = np.full(len(key), -1, np.int64)
    to = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = to[live]
        k = key[live] * np.uint64(LCG) + np.uint64(1)
        key[live] = k
        step = SCALE / ((k >> np.uint64(33)).astype(np.float64) + 1.0)
        to[live] = np.floor((at[live] + 1) * step).astype(np.int64)
        live = live[to[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Column of shards 0 to ``shards - 1``.

    The key is hashed first, so runs of ids spread.  A null key counts as one
    value of its own and so goes to one fixed shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(h.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 24, out: str = "shard") -> DataFrame:
    """``df`` and the shard of each row, in column ``out`` (replaced if it exists).

    A narrow step: nothing is shuffled.  Repeated keys share a shard, null keys
    too; empty tables stay empty; other columns are kept as they are.
    """
    return df.withColumn(out, jump_shard(df[key], shards))


def moved_rows(df: DataFrame, key: str, shards: int, grown: int) -> DataFrame:
    """The rows of ``df`` that change their shard when ``shards`` become ``grown``."""
    a, b = fresh(df, "before"), fresh(df, "after")
    both = df.withColumn(a, jump_shard(df[key], shards)).withColumn(b, jump_shard(df[key], grown))
    return both.filter(F.col(a) != F.col(b)).drop(a, b)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = 24, files: int = 8) -> None:
    """Write ``df`` as Parquet under ``path``, a folder a shard, each of about ``files`` files.

    Rows are dealt by shard and a salt, so that a shard which holds many rows
    isn't one task's work.
    """
    out = assign_shards(df, key, shards)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    out.repartition(shards * files, "shard", salt).write.partitionBy("shard").parquet(path)


def shard_slots(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, buckets: int = 256
) -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8, a null text counting as none.  slot
    numbers the rows of a shard from 0 without gaps; equal rows get
    neighbouring slots.  The rows are kept in the shared folder before they are
    numbered, because numbering reads them twice.
    """
    bytes_ = F.coalesce(df[text].cast("binary"), F.lit(b""))
    slim = df.select(
        df[key].alias(key),
        (F.octet_length(bytes_).cast("long") + 8).alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        jump_shard(df[key], shards).alias("shard"),
        jump_shard(df[key], shards + 1).alias("grown_shard"),
    )
    numbered = number_within(durable(slim), "shard", [key, "size", "text_crc32"], "slot", buckets)
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
