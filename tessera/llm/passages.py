"""Removal of repeated passages: every byte in a string of ``width`` bytes that starts elsewhere too.

A text is cut once into runs of windows with a common anchor (``anchors``).
Equal windows have equal anchors, so only runs with one anchor have to be
compared; what has an anchor of its own drops out.  All that is left is judged
by an index: a run-compressed Burrows-Wheeler transform with samples at its run
ends, through which matching statistics are streamed (``rindex``).  It is given
bytes, from two places where a run occurs twice.  Runs whose anchor comes with
one content only are put together, neighbour to neighbour, to chains, so that
long copies are indexed as they stand; the others are gathered by anchor.
Anchors with too many different runs for one task are first split by parts of
their windows, which share more bytes and so fall apart into smaller classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .anchors import content_hash, content_names, runs
from .common import broadcast_if_small, durable, written
from .rindex import RunIndex

#: Bytes of runs indexed at once in a task; rows handed on at once; windows in a chain.
BATCH, ROWS, CHAIN = 1 << 20, 50_000, 1 << 16
RUN = "ah long, r1 long, r2 long, s long, w int, o int"


def _utf8(t: str | None) -> bytes:
    return (t or "").encode("utf-8", "surrogatepass")


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two hashes that stand for a row's id and text."""
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(17), text, doc_id).alias("k2")]


def run_rows(df: DataFrame, doc_id: str, text: str, width: int, gram: int) -> DataFrame:
    """k1, k2 and for each run: anchor's hash, content's hash (two numbers), first window, windows, anchor's place in the run."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["k1", "k2", "ah", "r1", "r2", "s", "w", "o"]

        def frame(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
            return pd.DataFrame({x: np.concatenate(c) for x, c in zip(names, zip(*held))})

        for batch in batches:
            held, n = [], 0
            for k1, k2, t in zip(batch["k1"], batch["k2"], batch["t"]):
                b = _utf8(t)
                for s, w, p, h in runs(b, width, gram):
                    r = content_names([b[a:e] for a, e in zip(s.tolist(), (s + w + width - 1).tolist())])
                    held.append((np.full(len(s), k1), np.full(len(s), k2), h, r[:, 0], r[:, 1], s, w, p - s))
                    n += len(s)
                    if n > ROWS:
                        yield frame(held)
                        held, n = [], 0
            if held:
                yield frame(held)

    slim = df.select(*_row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))
    long_enough = slim.filter(F.octet_length("t") >= width)
    return long_enough.mapInPandas(cut, f"k1 long, k2 long, {RUN}")


SLICE = "x1 long, x2 long, x3 long, n long, o int, content binary"


def _slices(df: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """The bytes from s to e of the rows named in ``wanted`` (k1, k2, s, e, and what is handed on: x1, x2, x3, n, o).

    Rows that agree in id and text are read once in a task.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows, size, seen = ["x1", "x2", "x3", "n", "o", "content"], [], 0, set()
        for batch in batches:
            for k1, k2, t, need in zip(batch["k1"], batch["k2"], batch["t"], batch["need"]):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                b = _utf8(t)
                for r in need:
                    rows.append((r["x1"], r["x2"], r["x3"], r["n"], r["o"], b[r["s"] : r["e"]]))
                    size += r["e"] - r["s"]
                    if size > 4 * BATCH or len(rows) > ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    what = ["s", "e", "x1", "x2", "x3", "n", "o"]
    need = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*what)).alias("need"))
    need = need.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "need")
    docs = df.select(*_row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))
    found = docs.join(need, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2"))).select("k1", "k2", "t", "need")
    return found.mapInPandas(cut, SLICE)


def _index(rows: DataFrame, width: int) -> DataFrame:
    """(c, h, lo, hi): the repeated windows of the strings ``rows`` (c, h, content): each class c is in one task.

    c is the class, h names a string in it; of rows with one name the first
    is reported.  Several classes are indexed together; windows of different
    classes are never equal, but for chains, where it does no harm: they are
    repeated then.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def flush() -> pd.DataFrame:
            out, before = [], None
            for (c, h, _), again in zip(held, RunIndex([x[2] for x in held]).repeated(width)):
                if (c, h) != before:
                    edges = np.nonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))[0]
                    out += [(c, h, a, e) for a, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
                before = c, h
            held.clear()
            return pd.DataFrame(out, columns=["c", "h", "lo", "hi"])

        for batch in batches:
            for c, h, b in zip(batch["c"], batch["h"], batch["content"]):
                if size >= BATCH and c != last:
                    yield flush()
                    size = 0
                held.append((c, h, b))
                size += len(b)
                last = c
        if held:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("c", "h", "content").repartition(n, "c").sortWithinPartitions("c", "h")
    return dealt.mapInPandas(mark, "c long, h long, lo int, hi int")


def _split(parts: DataFrame, level: int, span: int, width: int) -> DataFrame:
    """Each part's windows dealt to two halves of their possible places, each with the bytes its windows share as class.

    ``parts``: ah, r1, r2, n, first (window of the run), o (anchor's place in
    the content), content.  A window that starts d bytes before its anchor is
    in piece floor(d * 2^level / span).
    """
    names = ["ah", "r1", "r2", "n", "first", "o", "content", "c", "h"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ah, r1, r2, n, first, o, b in zip(*(batch[x] for x in names[:7])):
                windows = len(b) - width + 1
                d = o - np.arange(windows)
                piece = (d << level) // span
                cut = np.concatenate([[0], np.nonzero(np.diff(piece))[0] + 1, [windows]])
                for a, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    q = int(piece[a])
                    nearest, farthest = -(-(q * span) >> level), min(span - 1, (((q + 1) * span - 1) >> level))
                    core = b[o - nearest : o - farthest + width]
                    c = xxhash.xxh3_64_intdigest(core, (ah ^ q * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
                    sub = b[a : e - 1 + width]
                    rows.append((ah, r1, r2, n, first + a, o - a, sub, c - (1 << 64) if c >> 63 else c, content_hash(sub)))
            yield pd.DataFrame(rows, columns=names)

    return parts.mapInPandas(deal, "ah long, r1 long, r2 long, n long, first int, o int, content binary, c long, h long")


def _gathered(parts: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """(ah, r1, r2, lo, hi): repeated windows lo to hi - 1 of the runs in ``parts`` (ah, r1, r2, n, o, content).

    A run that occurs n times is there twice, from two places, if n > 1.
    Classes of at most ``most`` different strings go to the index; larger ones
    are split, and their parts are judged anew.  Single windows at last share
    all of their bytes, so such a class is one string.
    """
    span, level, out = width - gram + 1, 0, []
    parts = parts.select("ah", "r1", "r2", "n", F.lit(0).alias("first"), "o", "content", F.col("ah").alias("c"), F.col("r1").alias("h"))
    while True:
        parts = durable(parts)
        if level and parts.isEmpty():
            break
        run = F.struct("ah", "r1", "r2")
        kinds = parts.groupBy("c", "h").agg(((F.max("n") > 1) | (F.min(run) != F.max(run))).alias("again"))
        sizes = kinds.groupBy("c").agg(F.count(F.lit(1)).alias("d"), F.max("again").alias("any"))
        judged = sizes.filter((F.col("d") > 1) | F.col("any")).select(F.col("c").alias("c2"), "d")
        rows = parts.join(broadcast_if_small(durable(judged)), F.col("c") == F.col("c2")).drop("c2")
        small = rows.filter(F.col("d") <= most)
        one = small.groupBy("c", "h").agg(
            F.min("content").alias("a"), F.max("content").alias("b"), ((F.max("n") > 1) | (F.min(run) != F.max(run))).alias("again")
        )
        strings = F.array_compact(F.array("a", F.when(F.col("again"), F.col("b"))))
        marks = durable(_index(one.select("c", "h", F.explode(strings).alias("content")), width))
        marks = marks.withColumnsRenamed({"c": "c2", "h": "h2"})
        named = small.select("ah", "r1", "r2", "first", "c", "h").distinct()
        part = named.join(marks, (F.col("c") == F.col("c2")) & (F.col("h") == F.col("h2")))
        out.append(part.select("ah", "r1", "r2", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")))
        big = rows.filter(F.col("d") > most).select("ah", "r1", "r2", "n", "first", "o", "content")
        level += 1
        if 1 << level - 1 >= span:
            break
        parts = _split(big, level, span, width)
    union = out[0]
    for x in out[1:]:
        union = union.union(x)
    return union


def _chains(kinds: DataFrame) -> DataFrame:
    """Runs of one content each, put together where they are neighbours at both of two places they occur at.

    ``kinds``: ah, r1, r2, w, p and q (k1, k2, s of the first and the last
    occurrence).  Result: c (the chain's name), p, q, w (windows), runs.
    """
    doc = Window.partitionBy("p.k1", "p.k2").orderBy("p.s")
    shift = F.col("q.s") - F.col("p.s")
    other = F.struct("q.k1", "q.k2", shift.alias("d"))
    x = kinds.withColumns({"other": other, "block": F.floor(F.col("p.s") / CHAIN)})
    follows = (F.lag("other").over(doc) == F.col("other")) & (F.lag(F.col("p.s") + F.col("w")).over(doc) == F.col("p.s"))
    follows = F.coalesce(follows & (F.lag("block").over(doc) == F.col("block")), F.lit(False))
    x = x.withColumn("k", F.sum((~follows).cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    chain = x.groupBy(F.col("p.k1").alias("k1"), F.col("p.k2").alias("k2"), "k").agg(
        F.min("p").alias("p"), F.min_by("q", "p.s").alias("q"), F.sum("w").cast("long").alias("w"), F.collect_list(F.struct("ah", "r1", "r2", F.col("p.s").alias("s"), "w")).alias("runs")
    )
    return chain.select(F.xxhash64("k1", "k2", "k").alias("c"), "p", "q", "w", "runs")


def repeated_spans(df: DataFrame, doc_id: str, text: str, width: int = 400, gram: int = 150, most: int = 1_500) -> DataFrame:
    """(k1, k2, spans): for each row with repeated bytes, spans of them, unmerged.

    k1, k2 as in ``_row_key``: rows that agree in id and text share one entry,
    though each counts as an occurrence.
    """
    all_runs = written(run_rows(df, doc_id, text, width, gram))
    # anchors that occur once drop out
    anchors = all_runs.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("ah").alias("a"))
    met = written(all_runs.join(broadcast_if_small(durable(anchors)), F.col("ah") == F.col("a")).drop("a"))
    place = F.struct("k1", "k2", "s")
    kinds = met.groupBy("ah", "r1", "r2").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("p"), F.max(place).alias("q"), F.min("w").alias("w"), F.min("o").alias("o")
    )
    kinds = durable(kinds)
    several = kinds.groupBy(F.col("ah").alias("a")).agg(F.count(F.lit(1)).alias("d"))
    kinds = written(kinds.join(several, F.col("ah") == F.col("a")).drop("a"))
    chains = written(_chains(kinds.filter("d = 1").drop("d", "n", "o")))
    both = F.explode(F.array("p", "q"))
    # the chain's places: that in the first text and that in the last, each to the last byte of its last window
    asked = chains.select("w", F.col("c").alias("x1"), both.alias("at")).select(
        "at.*", (F.col("at.s") + F.col("w") + width - 1).alias("e"), "x1", F.lit(0).cast("long").alias("x2"), F.lit(0).cast("long").alias("x3"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("o")
    )
    mixed = kinds.filter("d > 1").select("w", "n", "o", "ah", "r1", "r2", F.explode(F.when(F.col("n") > 1, F.array("p", "q")).otherwise(F.array("p"))).alias("at"))
    mixed = mixed.select("at.*", (F.col("at.s") + F.col("w") + width - 1).alias("e"), F.col("ah").alias("x1"), F.col("r1").alias("x2"), F.col("r2").alias("x3"), "n", "o")
    got = written(_slices(df, doc_id, text, asked.union(mixed)))
    marks = _index(got.filter("o < 0").select(F.col("x1").alias("c"), F.lit(0).cast("long").alias("h"), "content"), width)
    found = marks.join(chains.select(F.col("c").alias("c2"), F.col("p.s").alias("at"), "runs"), F.col("c") == F.col("c2"))
    # a run's place in its chain is where it stands in the first text
    placed = F.transform("runs", lambda r: F.struct(r["ah"].alias("ah"), r["r1"].alias("r1"), r["r2"].alias("r2"), (r["s"] - F.col("at")).alias("a"), (r["s"] - F.col("at") + r["w"]).alias("z")))
    rows = found.select("lo", "hi", F.explode(placed).alias("r")).select("lo", "hi", "r.*").filter("lo < z and hi > a")
    uniform = rows.select("ah", "r1", "r2", F.greatest(F.col("lo") - F.col("a"), F.lit(0)).alias("lo"), (F.least("hi", "z") - F.col("a")).alias("hi"))
    uniform = uniform.withColumns({"lo": F.col("lo").cast("int"), "hi": F.col("hi").cast("int")})
    parts = got.filter("o >= 0").withColumnsRenamed({"x1": "ah", "x2": "r1", "x3": "r2"})
    marks = written(uniform.union(_gathered(parts, width, gram, most)).withColumnsRenamed({"ah": "a", "r1": "b1", "r2": "b2"}))
    same = (F.col("ah") == F.col("a")) & (F.col("r1") == F.col("b1")) & (F.col("r2") == F.col("b2"))
    span = F.struct((F.col("s") + F.col("lo")).alias("a"), (F.col("s") + F.col("hi") - 1 + width).alias("e"))
    return met.join(marks, same).groupBy("k1", "k2").agg(F.collect_set(span).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted((int(x["a"]), int(x["e"])) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([a, e])
    return [(a, e) for a, e in out]


PIECES = "kept binary, removed array<struct<start:long,end:long>>"


def remove_passages(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 400, gram: int = 150, most: int = 1_500
) -> DataFrame:
    """``df`` with two columns: kept (the bytes left) and removed (spans of bytes taken out, in order).

    Texts are UTF-8 bytes, null ones empty.  A byte goes if a string of
    ``width`` bytes that covers it also starts at another place of the corpus,
    in the same text or another; matches never cross texts and are judged on
    the input.  All copies go, so repeated rows lose everything if they are
    long enough.  Texts shorter than ``width`` stay whole.  ``gram``, the
    anchors' bytes, and ``most``, the different runs of an anchor that are
    indexed in one task, change the work but not the result.  Columns named
    kept or removed are replaced.
    """
    spans = repeated_spans(df, doc_id, text, width, gram, most)
    spans = spans.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "spans")
    rest = [c for c in df.columns if c.lower() not in ("kept", "removed")]
    row = df.select(F.struct(*rest).alias("r"), *_row_key(F.col(doc_id), F.col(text)), F.col(text).alias("t"))

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            kept, removed = [], []
            for t, x in zip(texts, found):
                b = _utf8(t)
                gone = _merged(x) if x is not None else []
                at, left = 0, []
                for a, e in gone:
                    left.append(b[at:a])
                    at = e
                kept.append(b"".join([*left, b[at:]]))
                removed.append([{"start": a, "end": e} for a, e in gone])
            yield pd.DataFrame({"kept": kept, "removed": pd.Series(removed, dtype=object)})

    joined = row.join(spans, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left")
    return joined.withColumn("c", cut("t", "spans")).select("r.*", "c.*")


def passage_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Of each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_passages(df.select(doc_id, text), doc_id, text, **how)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select(
        doc_id,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


