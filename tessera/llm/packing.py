"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so the decisions of best-fit
decreasing depend on the number of pieces of each length alone.  The driver
gets these numbers, at most one a length, and packs all pieces of a length at
once: a segment tree over remaining capacities gives the tightest open
sequence.  What comes back is a list of runs ("the pieces number a to b of this
length go to sequences from c on, at offset d"), from which every piece finds
its own place by its number within its length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .ranking import number_within
from .tokens import default_path, encoder


class TightestOpen:
    """Segment tree over remaining capacities 0 to ``most``: which are there at all."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = bytearray(2 * self.leaves)

    def set(self, remaining: int, there: bool) -> None:
        i = remaining + self.leaves
        self.tree[i] = there
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def at_least(self, size: int) -> int | None:
        """The smallest remaining capacity of at least ``size``; None if there is none."""
        i = size + self.leaves
        if self.tree[i]:
            return size
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``first`` to ``first + count - 1`` of ``length``, ``each`` a sequence from ``sequence`` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place ``counts[length]`` pieces of each length, and the number of sequences.

    As if each piece in turn, longest first, went to the open sequence with the
    least room that still holds it: a sequence that takes one piece of a length
    is then the tightest for the next, so it takes as many as it holds.
    Sequences that were opened together and have the same room are one entry,
    so the work and the runs depend on the lengths, not on the pieces.
    """
    room: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
    tree, runs, opened = TightestOpen(capacity), [], 0

    def put(remaining: int, lo: int, hi: int) -> None:
        if hi > lo:
            if remaining and not room[remaining]:
                tree.set(remaining, True)
            if remaining:
                room[remaining].append((lo, hi))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        first, left = 0, counts[length]
        while left:
            r = tree.at_least(length)
            if r is None:
                r, each = capacity, capacity // length
                lo, hi = opened, opened + -(-left // each)
                opened = hi
            else:
                each = r // length
                lo, hi = room[r].popleft()
                if not room[r]:
                    tree.set(r, False)
            full = min(hi - lo, left // each)
            if full:
                runs.append(Run(length, first, full * each, each, lo, capacity - r))
                put(r - each * length, lo, lo + full)
                first, left, lo = first + full * each, left - full * each, lo + full
            if left and lo < hi:  # fewer than a sequence takes
                runs.append(Run(length, first, left, left, lo, capacity - r))
                put(r - left * length, lo, lo + 1)
                left, lo = 0, lo + 1
            put(r, lo, hi)
    return runs, opened


def pieces(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None
) -> DataFrame:
    """Pieces of the documents' ids: doc_id, piece, start, length, ids_crc32.

    A document is its tokens and id 0 at the end, so a null or empty text has
    one id.  Only documents longer than ``capacity`` are cut.  Runs over
    batches of rows; what a worker holds is a batch and the words it keeps.
    """
    vocabulary = path or default_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(vocabulary)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch["t"]):
                ids = coder.packed(t) + b"\0\0\0\0"
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    e = min(s + capacity, n)
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            ids = batch["d"].to_numpy(dtype=object)
            yield pd.DataFrame(
                {"d": ids[at], "piece": piece, "start": start, "length": length, "ids_crc32": crc}
            )

    # as a string, so that pandas doesn't turn whole numbers with nulls into floats
    out = df.select(df[doc_id].cast("string").alias("d"), df[text].alias("t")).mapInPandas(
        cut, "d string, piece int, start long, length long, ids_crc32 long"
    )
    kind = df.schema[doc_id].dataType
    return out.select(F.col("d").cast(kind).alias(doc_id), "piece", "start", "length", "ids_crc32")


def pack(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    path: str | None = None,
    rows_a_bucket: int = 200_000,
) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Columns: doc_id, piece (from 0), start, length, ids_crc32, sequence_id,
    offset.  Rows with the same id, equal rows and null ids are packed like any
    others.  An empty table gives no rows.  Within a length, which piece gets
    which place is fixed by the pieces' values; equal pieces are exchanged
    freely.  Sequences are filled without gaps from offset 0.

    Pieces (no texts, no ids) are kept in the shared folder; the driver gets a
    count for each length, so at most ``capacity`` numbers.
    """
    cut = durable(pieces(df, doc_id, text, capacity, path))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    buckets = max(16, sum(counts.values()) // rows_a_bucket)
    numbered = number_within(cut, "length", [doc_id, "piece", "start", "ids_crc32"], "n", buckets)
    # places by (length, number): runs of a length are sorted by their first number
    table = np.array(
        sorted((r.length, r.first, r.each, r.sequence, r.offset) for r in runs) or [(0, 0, 1, 0, 0)], np.int64
    )
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        order = table[:, 1]
        for length, number in batches:
            ln, no = length.to_numpy(np.int64), number.to_numpy(np.int64)
            row = np.empty(len(ln), np.int64)
            for value in np.unique(ln):
                mine = ln == value
                lo, hi = starts[value], starts[value + 1]
                row[mine] = lo + np.searchsorted(order[lo:hi], no[mine], side="right") - 1
            _, first, each, sequence, offset = table[row].T
            j = no - first
            yield pd.DataFrame({"sequence_id": sequence + j // each, "offset": offset + (j % each) * ln})

    placed = numbered.withColumn("_p", place("length", "n"))
    return placed.select(doc_id, "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def sequences(df: DataFrame, packed: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most the capacity), doc_ids in order.

    For tables whose ids are unique and not null.  A sequence is as long as the
    capacity at most, so the rows gathered for one are bounded.
    """
    vocabulary = path or default_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(vocabulary)
        for t in batches:
            yield pd.Series([np.frombuffer(coder.packed(x) + b"\0\0\0\0", "<u4").astype(np.int32) for x in t])

    coded = df.select(df[doc_id].alias("_d"), ids(df[text]).alias("_ids"))
    cut = packed.join(coded, packed[doc_id] == coded["_d"]).select(
        "sequence_id", "offset", doc_id, F.slice("_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")
    )
    whole = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", doc_id, "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col(f"p.{doc_id}").alias("doc_ids"))
