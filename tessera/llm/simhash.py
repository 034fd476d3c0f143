"""SimHash near-duplicates found by pigeonring filtering.

Two fingerprints of 64 bits that differ in at most ``limit`` bits are linked.
The bits lie in ``limit + 1`` segments on a ring.  Among linked fingerprints
there is a segment from which every chain of 1, 2, 3, ... consecutive segments
differs in no more bits than its share of the limit (the pigeonring principle,
Qin and Xiao, 2018).  The chain's first segment is equal, and the first two
together may differ in one bit at most if the share of two segments is under 2:
then one half of the second segment is equal as well.  So the join key is a
segment and half of the next; what meets is held against the chain's budgets
and then compared in full.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, fresh, settled
from .components import connected_components
from .lines import BAG, _above

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(256)).lower()


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of ``text``, every occurrence counted; 0 without words."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = ends - [len(w) for w in words]
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_digest
    # digests are big-endian: bit i of the row is bit 63 - i of the number
    h = b"".join([digest(joined[a:b], seed) for a, b in zip(first[:n].tolist(), last.tolist())])
    return _majority(np.frombuffer(h, np.uint8).reshape(n, 8))


def _majority(rows: np.ndarray) -> int:
    """The number whose bits are set in over half of ``rows``, of eight bytes each."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), 4096):  # bounded memory for long texts
        ones += np.unpackbits(rows[i : i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big")


def fingerprints(text: Column, width: int = 4, seed: int = 42) -> Column:
    """Column of fingerprints as signed 64-bit integers."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series(np.array([fingerprint(x, width, seed) for x in t], np.uint64).view(np.int64))

    return of(text)


def _segments(limit: int) -> list[tuple[int, int]]:
    """(shift, bits) of the segments on the ring."""
    cuts = [64 * i // (limit + 1) for i in range(limit + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bits(f: Column, shift: int, n: int) -> Column:
    return f if n == 64 else F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << n) - 1))


def _keys(limit: int, depth: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each join key: the segment its chain starts from, and the bit ranges that are equal.

    Depth 2: two segments may differ in one bit, so the first and half of the
    second are equal.  Depth 3, from a limit of 2: three segments may differ in
    two bits and the first two in one, so besides the first, one half of each
    other or both halves of the second are equal: longer keys, but more of them.
    """
    seg, out = _segments(limit), []
    if limit == 0:
        return [(0, [(0, 64)])]

    def halves(k: int) -> list[tuple[int, int]]:
        shift, n = seg[k % len(seg)]
        return [(shift, n // 2), (shift + n // 2, n - n // 2)]

    for i, first in enumerate(seg):
        if depth == 2 or limit < 2:
            out += [(i, [first, h]) for h in halves(i + 1)]
        else:
            out += [(i, [first, h, g]) for h in halves(i + 1) for g in halves(i + 2)]
            out.append((i, [first, *halves(i + 1)]))
    return out


def _first_key(limit: int, depth: int) -> str:
    """SQL: number of the first key that brings the pair a.f, b.f together; null if no chain keeps its budgets.

    The first segment from which all chains keep to their share of the limit;
    then the first of its keys whose bits are equal (there always is one).
    """
    x, seg, keys = "(a.f ^ b.f)", _segments(limit), _keys(limit, depth)

    def bits(s: tuple[int, int]) -> str:
        return x if s[1] == 64 else f"(shiftrightunsigned({x}, {s[0]}) & {(1 << s[1]) - 1}L)"

    cases = []
    for i in range(len(seg)):
        chain, total = [], []
        for k in range(len(seg)):
            total.append(f"bit_count({bits(seg[(i + k) % len(seg)])})")
            chain.append(f"{' + '.join(total)} <= {(k + 1) * limit // len(seg)}")
        mine = [(n, equal) for n, (start, equal) in enumerate(keys) if start == i]
        first = " ".join(f"WHEN {' AND '.join(f'{bits(s)} = 0' for s in equal)} THEN {n}" for n, equal in mine)
        cases.append(f"WHEN {' AND '.join(chain)} THEN CASE {first} END")
    return f"CASE {' '.join(cases)} END"


def _ring_rows(limit: int, depth: int) -> list[Column]:
    """(k, key) for each join key of the fingerprint f."""
    rows = []
    for k, (_, equal) in enumerate(_keys(limit, depth)):
        key = F.lit(0).cast("long")
        for s in equal:
            key = F.shiftleft(key, s[1]).bitwiseOR(_bits(F.col("f"), *s)) if s[1] < 64 else F.col("f")
        rows.append(F.struct(F.lit(k).alias("k"), key.alias("key")))
    return rows


def _dealt(fps: DataFrame, limit: int, depth: int) -> DataFrame:
    """(f, k, key): every fingerprint under each of its keys."""
    return fps.select("f", F.explode(F.array(*_ring_rows(limit, depth))).alias("r")).select("f", "r.*")


def linked_pairs(fps: DataFrame, limit: int = 4, depth: int = 2) -> DataFrame:
    """(u, v) with u < v: all pairs of the distinct fingerprints ``fps`` (f) within ``limit`` bits.

    A pair that meets under several keys is kept under the first only, so it
    comes out once and nothing needs to be made distinct.
    """
    return _pairs(_dealt(fps, limit, depth), limit, depth)


def _pairs(dealt: DataFrame, limit: int, depth: int, more: str = "true") -> DataFrame:
    a, b = dealt.alias("a"), dealt.alias("b")
    on = F.expr(f"a.k = b.k AND a.key = b.key AND a.f < b.f AND {more} AND {_first_key(limit, depth)} = a.k AND bit_count(a.f ^ b.f) <= {limit}")
    return a.join(b, on).select(F.col("a.f").alias("u"), F.col("b.f").alias("v"))


def fingerprint_classes(fps: DataFrame, limit: int = 4, depth: int = 3) -> DataFrame:
    """(f, root) for the distinct fingerprints ``fps`` (f); root stands for the component.

    First each fingerprint is held against the smallest under each of its
    keys; what that links is a group already.  Then only pairs between
    different groups are looked at, so a large group doesn't emit its pairs.
    The longer keys of depth 3 keep chance meetings rare.
    """
    dealt = _dealt(fps, limit, depth)
    heads = dealt.groupBy("k", "key").agg(F.min("f").alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = broadcast_if_small(durable(heads.select(F.col("k").alias("k2"), F.col("key").alias("key2"), "c")))
    met = durable(dealt.join(heads, (F.col("k") == F.col("k2")) & (F.col("key") == F.col("key2"))).select("k", "key", "f", "c"))
    stars = met.filter((F.col("f") != F.col("c")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("c"))) <= limit))
    groups = durable(connected_components(stars.select(F.col("c").alias("u"), F.col("f").alias("v"))))
    named = met.join(broadcast_if_small(groups), met["f"] == groups["node"], "left").select("k", "key", "f", F.coalesce("root", "f").alias("g"))
    # keys that one group has to itself make no pairs
    mixed = named.groupBy("k", "key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo != hi")
    mixed = broadcast_if_small(durable(mixed.select(F.col("k").alias("k2"), F.col("key").alias("key2"))))
    open_ = durable(named.join(mixed, (F.col("k") == F.col("k2")) & (F.col("key") == F.col("key2"))).select("k", "key", "f", "g"))
    links = _pairs(open_, limit, depth, "a.g <> b.g").union(groups.select(F.col("root").alias("u"), F.col("node").alias("v")))
    comp = durable(connected_components(links))
    alone = fps.join(comp, fps["f"] == comp["node"], "left_anti").select("f", F.col("f").alias("root"))
    return comp.select(F.col("node").alias("f"), "root").union(alone)


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, limit: int = 4
) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach, the row's own included.
    Copies are one fingerprint, so a group of any size is one row in the join.
    Null, empty and blank texts have fingerprint zero and are linked like any
    other.  Rows with a null id are linked too; a component of null ids alone
    has component_id null.  Repeated rows stay.  No rows: no rows.
    """
    slim = durable(df.select(df[doc_id].alias("doc_id"), fingerprints(df[text], width).alias("f")))
    least = durable(slim.groupBy("f").agg(F.min("doc_id").alias("least")))
    classes = durable(fingerprint_classes(least.select("f"), limit))
    roots = classes.join(least, "f").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = broadcast_if_small(durable(classes.join(roots, "root").select(F.col("f").alias("_f"), "component_id")))
    return slim.join(labels, slim["f"] == labels["_f"]).select(
        F.col("doc_id").alias(doc_id),
        F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"),
        "component_id",
    )


#: Smallest shingle hashes by which texts meet whose fingerprints are further apart; their kind of key.
SMALLEST, BY_SHINGLE = 8, -1
#: Counts of shingle hashes that are kept of a text, seven to a long.
BAGS = 8


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """Hashes of the word shingles of ``text``, repeats included, as ``fingerprint`` takes them; of all words if there are fewer."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + width]), seed) for i in range(n)], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The different ``shingle_hashes`` of ``text``, sorted."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def shingle_sets(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield pd.Series([shingle_set(x, width) for x in t], dtype=object)

    return of(text)


def shingle_heads(text: Column, width: int, keys: int) -> Column:
    """What is kept of a text: t, a hash of its set of shingles, n, their number, f, its SimHash (0 without words), first, the ``keys`` smallest, and their bags."""
    names = _bag_names()

    @F.pandas_udf(f"t long, n long, f long, first array<long>, {', '.join(f'{b} long' for b in names)}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for x in texts:
                h = shingle_hashes(x, width)
                s, f = np.unique(h.view(np.int64)), _majority(h.astype(">u8").view(np.uint8).reshape(-1, 8))
                t = xxhash.xxh64_intdigest(s.tobytes())
                rows.append((*np.array([t, len(s), f], np.uint64).view(np.int64).tolist(), s[:keys].copy(), *_bags(s)))  # a view would keep all of s
            yield pd.DataFrame(rows, columns=["t", "n", "f", "first", *names])

    return of(text)


def _bag_names() -> list[str]:
    return [f"b{i}" for i in range(BAGS)]


def _bags(hashes: np.ndarray) -> list[int]:
    """How many of ``hashes`` fall into each of ``BAG * BAGS`` classes, at most 127: ``BAG`` counts to a long, as ``_above`` takes them."""
    counts = np.bincount((hashes.view(np.uint64) % (BAG * BAGS)).astype(np.int64), minlength=BAG * BAGS)
    return (np.minimum(counts, 127).reshape(BAGS, BAG) << (8 * np.arange(BAG))).sum(axis=1).tolist()


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and bags of two sets allow for ``similarity``: what one has more of in a class isn't in the other.

    Sets of sizes m and n have at least similarity / (1 + similarity) * (m + n) in common then.
    Looked at in one direction, as what they have in common there is the same in both, and in two bags first.
    """
    m, n = F.col(a + "n"), F.col(b + "n")
    need = similarity / (1 + similarity) * (m + n) - 1e-6
    over = [_above(F.col(a + c), F.col(b + c)) % 255 for c in _bag_names()]
    return (F.least(m, n) >= similarity * F.greatest(m, n)) & (m - sum(over[:2]) >= need) & (m - sum(over) >= need)


def _similar(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least ``similarity`` of their union in common; ``sets_of`` gives (t, s) for some t."""
    ends = durable(pairs.select(F.col("u").alias("t")).union(pairs.select(F.col("v").alias("t"))).distinct())
    need = durable(sets_of(ends))
    a = need.select(F.col("t").alias("u"), F.col("s").alias("x"))
    b = need.select(F.col("t").alias("v"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "u").join(b, "v").filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("u", "v")


def similar_classes(heads: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, limit: int = 4, depth: int = 3) -> DataFrame:
    """(t, root) for the texts ``heads`` (see ``shingle_heads``; one row for each t); root stands for the component.

    Texts meet on the pigeonring keys of their fingerprints, keep the chains'
    budgets and differ in at most ``limit`` bits; or, as 0.8 in common can be
    further apart, on one of their smallest shingle hashes: of those at 0.8 one
    in 400,000 or so shares none of 8.  Those whose sizes and bags allow for
    ``similarity`` are then compared by their sets.
    First each with the first one under its keys; then only the pairs between
    different groups.
    """
    by_shingle = F.transform("first", lambda x: F.struct(F.lit(BY_SHINGLE).alias("k"), x.alias("key")))
    dealt = heads.select("t", F.explode(F.concat(F.array(*_ring_rows(limit, depth)), by_shingle)).alias("r")).select("r.*", "t")
    w = Window.partitionBy("k", "key")
    met = durable(dealt.withColumn("many", F.count(F.lit(1)).over(w)).filter("many > 1").drop("many"))
    names = ["t", "n", "f", *_bag_names()]

    def near(a: str, b: str) -> Column:
        bits = F.bit_count(F.col(a + "f").bitwiseXOR(F.col(b + "f")))
        return ((F.col("k") == BY_SHINGLE) | (bits <= limit)) & _alike(a, b, similarity)

    met = met.join(heads.select(*names), "t").withColumn("c", F.min(F.struct(*names)).over(w))
    met = durable(met.select("k", "key", *names, F.when((F.col("t") != F.col("c.t")) & near("", "c."), F.col("c.t")).alias("u")))
    stars = met.filter("u is not null").select("u", F.col("t").alias("v")).distinct()
    spark = heads.sparkSession
    groups = settled(spark, lambda: connected_components(_similar(durable(stars), sets_of, similarity)))
    named = met.join(groups, met["t"] == groups["node"], "left").select("k", "key", *names, F.coalesce("root", "t").alias("g"))
    named = named.withColumns({"lo": F.min("g").over(w), "hi": F.max("g").over(w)}).filter("lo != hi")
    a, b = named.alias("a"), named.withColumnRenamed("k", "k2").alias("b")
    ring = F.expr(f"a.k = {BY_SHINGLE} OR {_first_key(limit, depth)} = a.k")
    on = (F.col("k") == F.col("k2")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.t") < F.col("b.t")) & (F.col("a.g") != F.col("b.g"))
    on &= near("a.", "b.") & ring
    pairs = a.join(b, on).select(F.col("a.t").alias("u"), F.col("b.t").alias("v")).distinct()
    more = settled(spark, lambda: _similar(durable(pairs), sets_of, similarity))
    links = more.union(groups.select(F.col("root").alias("u"), F.col("node").alias("v")))
    comp = durable(connected_components(links))
    alone = heads.join(comp, heads["t"] == comp["node"], "left_anti").select("t", F.col("t").alias("root"))
    return comp.select(F.col("node").alias("t"), "root").union(alone)


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component, the row with the smallest id.

    Linked are texts whose sets of word shingles have at least ``similarity`` of their union in common;
    texts without words are equal.
    Of rows that share this id one stays, the first by a hash of its text.  Rows with a null
    id come after all others.  The columns are those of ``df``.  Of each text a few
    numbers are kept; the sets are made again of texts that are to be compared.
    """
    k, i, m = (fresh(df, s) for s in ("k", "i", "m"))
    key = F.xxhash64(doc_id, text)
    kept = settled(df.sparkSession, lambda: _first_of_each(df, key, doc_id, text, width, similarity))
    kept = kept.select(F.col("k").alias(m), F.col("doc_id").alias(i))
    keyed = df.withColumn(k, key)
    stay = keyed.join(kept, (F.col(k) == F.col(m)) & keyed[doc_id].eqNullSafe(F.col(i)), "left_semi")
    return stay.dropDuplicates([k, doc_id]).select(*df.columns)


def _first_of_each(df: DataFrame, key: Column, doc_id: str, text: str, width: int, similarity: float) -> DataFrame:
    """(k, doc_id) of the rows that stay; k is ``key``."""
    slim = df.select(F.col(doc_id).alias("doc_id"), key.alias("k"), shingle_heads(df[text], width, SMALLEST).alias("h"))
    slim = durable(slim.select("doc_id", "k", "h.*"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k")).alias("best")
    least = durable(slim.groupBy("t").agg(best))
    heads = durable(slim.select("t", "n", "f", "first", *_bag_names()).dropDuplicates(["t"]))
    at, texts = least.select("t", F.col("best.k").alias("k")), df.select(key.alias("k"), F.col(text).alias("x"))

    def sets_of(ends: DataFrame) -> DataFrame:
        places = broadcast_if_small(durable(at.join(ends, "t")))
        return texts.join(places, "k").dropDuplicates(["t"]).select("t", shingle_sets(F.col("x"), width).alias("s"))

    classes = settled(df.sparkSession, lambda: similar_classes(heads, sets_of, similarity))
    kept = classes.join(least, "t").groupBy("root").agg(F.min("best").alias("best"))
    return kept.select("best.k", "best.doc_id")
