import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import avi, cotraining, forest, jpeg, mixing, packing, queries, sharding, simhash, tokens, toxicity
from tessera.llm.components import connected_components

LONG = "longer words " * 3_000


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 120))), f"s{rng.randint(0, 3)}") for i in range(60)]
    rows += [(60, None, "s1"), (61, "", None), (62, " \n\t ", "s2"), (63, LONG, "s0"), (64, rows[2][1], "s2"), (64, rows[2][1], "s2"), (None, "null id", "s3"), (None, None, None)]
    return rows


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_loop():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 2_000)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump_buckets(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]


def test_slots_are_gapless_and_growth_moves_rows_to_the_new_shard(docs):
    rows = corpus()
    got = sharding.shard_slots(docs(rows), shards=5).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    assert sharding.shard_slots(docs([])).count() == 0
    assert sharding.assign_shards(docs(rows)).columns[-1] == "shard"
    moved = sharding.moved_rows(docs(rows), "doc_id", 5, 6).count()
    assert moved == sum(r["grown_shard"] == 5 for r in got)


# --- mixing


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]


def test_targets_stop_at_three_times_the_source(spark):
    df = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got["b"] == 30 and got["a"] <= 300 and math.isclose(sum(got.values()), 1200)
    free = [got["a"] / 1, got["c"] / 3, got[None] / 1]
    assert math.isclose(free[0], free[2]) and math.isclose(free[0], free[1])


def test_mix_comes_near_its_targets_and_agrees_on_reruns(docs):
    rows = corpus()
    a = table(mixing.mix(docs(rows)), "doc_id", "source", "size", "target", "copies")
    b = table(mixing.mix(docs(rows[::-1]).repartition(7)), "doc_id", "source", "size", "target", "copies")
    assert a == b and len(a) == len(rows)
    assert collections.Counter(x[2] for x in a) == collections.Counter(sizes(rows))
    for s in {x[1] for x in a}:
        mine = [x for x in a if x[1] == s]
        taken = sum(x[2] * x[4] for x in mine)
        assert abs(taken - mine[0][3]) <= max(x[2] for x in mine) and all(0 <= x[4] <= 3 for x in mine)
    assert mixing.mix(docs([])).count() == 0


def test_mixed_rows_keep_columns_and_repeat(docs):
    df = docs(corpus())
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    copies = mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert out.count() == copies
    assert mixing.mixed_rows(docs([])).count() == 0


# --- packing


def test_tokens_are_the_tokenizers():
    coder = tokens.WordEncoder(tokens.default_path())
    rng = random.Random(7)
    letters = "abcdefghijklmnop éèüßñ'-.,!?0123456789$%<|>ABCXYİΣς\x85\xa0 \x1c\x00/…’中文한\n\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(2_000)]
    texts += [None, "", "<|endoftext|> x", "it's they're", "a\x0bb\x0cc"]
    for t in texts:
        want = coder.exact.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(coder.packed(t), "<u4").tolist() == want, t


def test_packing_equals_best_fit_decreasing_one_by_one():
    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([10, 30, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        room = []
        for n in sorted(lengths, reverse=True):
            i = bisect.bisect_left(room, n)
            left = room.pop(i) if i < len(room) else capacity
            bisect.insort(room, left - n)
        runs, opened = packing.best_fit_decreasing(collections.Counter(lengths), capacity)
        used = collections.Counter()
        for r in runs:
            for t in range(r.count):
                used[r.sequence + t // r.each] += r.length
        assert opened == len(room) and sorted(capacity - n for n in used.values()) == room


def test_pieces_are_whole_and_sequences_gapless(docs):
    rows, capacity = corpus(), 64
    got = packing.pack(docs(rows), capacity=capacity).collect()
    coder = tokens.WordEncoder(tokens.default_path())
    want = []
    for i, t, _ in rows:
        ids = coder.packed(t) + b"\0\0\0\0"
        for k, s in enumerate(range(0, len(ids) // 4, capacity)):
            part = ids[4 * s : 4 * (s + capacity)]
            want.append((i, k, s, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert packing.pack(docs([])).count() == 0


def test_sequences_hold_the_ids(docs):
    df = docs([(1, "some words here", "s"), (2, "and more", "s")])
    packed = packing.pack(df)
    coder = tokens.WordEncoder(tokens.default_path())
    (row,) = packing.sequences(df, packed).collect()
    want = {i: np.frombuffer(coder.packed(t) + b"\0\0\0\0", "<u4").tolist() for i, t in ((1, "some words here"), (2, "and more"))}
    assert row["ids"] == sum((want[i] for i in row["doc_ids"]), [])


# --- near-duplicates


def reference_fingerprint(t, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for _, t, _ in corpus():
        assert simhash.fingerprint(t) == reference_fingerprint(t)


@pytest.mark.parametrize("limit, depth", [(0, 2), (1, 2), (4, 2), (4, 3), (6, 3), (9, 3)])
def test_all_pairs_within_the_limit_once(spark, limit, depth):
    rng = random.Random(limit)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(4):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 10)):
                g ^= 1 << b
            fps.add(g)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "f long")
    got = sorted(map(tuple, simhash.linked_pairs(df, limit, depth).collect()))
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= limit]
    assert got == sorted(want)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {n: find(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_and_one_of_each(docs):
    rows = corpus()
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    blank = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {60}
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 64)} == {2}
    df = docs(rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 in ids and 64 not in ids and 60 in ids and 61 not in ids and ids.count(None) == 1
    assert simhash.near_duplicates(docs([])).count() == 0 and simhash.one_of_each(docs([])).count() == 0


# --- neighbours


def test_forest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1_500, 16)).astype(np.float32)
    v[700:730] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(2_000, None), (2_100, [0.0] * 16), (2_200, [float("nan")] * 16), (2_300, [1.0] * 3), (2_400, [None] * 16), (None, rows[5][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = forest.nearest(df, df.filter(F.col("vec_id") % 100 == 0), leaf=64, trees=8).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    x, hits = v.astype(float), 0
    for q in range(0, 1_500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), d))[:10]) & set(found[q]))
    assert hits / 150 >= 0.9 and set(found) == set(range(0, 1_500, 100))
    assert found[0] == list(range(700, 710)) and found[700][:2] == [0, 701]
    few = forest.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 0"))
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3]
    assert forest.nearest(df.filter("vec_id = 2000"), df).count() == 0


# --- classifiers


def test_quality_separates_junk_and_keeps_the_rest(spark, docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubcdst") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = " ".join(word().upper() + "!!" if bad else word() for _ in range(rng.randint(20, 80)))
        rows.append((i, t, f"s{i % 3}"))
        if i < 250:
            marks.append((i, 0 if bad else 1))
    df = docs(rows + [(900, None, None), (901, "", "s1"), (None, LONG, None)])
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, quality int")
    model = cotraining.fit_quality(df, labels)
    got = {r["doc_id"]: r["quality_score"] for r in cotraining.with_quality(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 4 != 0) for i in range(250, 400))
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    kept = cotraining.keep_good(df, model)
    assert kept.columns == df.columns and kept.filter("doc_id < 400").count() == 300
    none = cotraining.fit_quality(df, labels.filter("false"))
    assert cotraining.keep_good(df, none).count() == 403
    assert cotraining.keep_good(docs([]), cotraining.fit_quality(docs([]), labels)).count() == 0


def test_the_page_view_reads_no_text_and_views_lend_to_each_other(spark):
    """Sources tell good from bad, and so do words; few labels.  Held-out accuracy beats a model without labels lent."""
    rng = random.Random(6)
    rows = []
    for i in range(1_200):
        bad = i % 3 == 0
        words = [("zq" if bad and rng.random() < 0.2 else "") + "".join(rng.choice("aeioubcdst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(words), "en", f"{'b' if bad else 'g'}{rng.randint(0, 2)}" if rng.random() < 0.9 else "x", len(" ".join(words))))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(150)], "doc_id long, quality int")
    model = cotraining.fit_quality(df, labels)
    got = {r["doc_id"]: r["quality_score"] for r in cotraining.with_quality(df, model).collect()}
    right = np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in range(150, 1_200)])
    assert right > 0.9 > 2 / 3  # the share of the larger kind is what a model that knows nothing reaches
    pages = df.withColumn("text", F.lit(None).cast("string"))
    only = [r["quality_score"] for r in cotraining.with_quality(pages, model).collect()]
    assert len(set(only)) > 1 and cotraining.page_view({"lang": "en", "source": None, "n_chars": float("nan")}).shape == (cotraining.NAMES + 2,)


def test_toxicity_on_held_out_rows(spark, docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(800):
        w = [word() for _ in range(rng.randint(20, 60))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = rng.choice(["zorkish", "quuxes", "vlimpost" + word()])
        rows.append((i, " ".join(w), "s"))
        marks.append((i, int(i % 5 == 0)))
    df = docs([*rows, (900, None, "s"), (901, "", "s"), (None, LONG + "zorkish", "s")])
    model = toxicity.fit_toxicity(df, spark.createDataFrame([*marks, (None, 1)], "doc_id long, toxic int"))
    got = toxicity.with_toxicity(df, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    judged = [(r["score"] >= 0.3, r["doc_id"] % 5 == 0) for r in got if r["h"] and r["doc_id"] < 800]
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([a for a, b in judged if b]) > 0.85 and np.mean([a for a, b in judged if not b]) < 0.05
    assert [r["score"] >= 0.3 for r in got if r["doc_id"] is None] == [True]
    assert {r["score"] for r in got if r["doc_id"] in (900, 901)} == {next(r["score"] for r in got if r["doc_id"] == 900)}
    empty = toxicity.fit_toxicity(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.with_toxicity(docs([]), empty).count() == 0


# --- media


def test_bytes_survive_the_video(docs):
    rows = corpus()
    for r in avi.text_media(docs(rows)).collect():
        if r["doc_id"] is None:
            continue
        raw = next((t or "").encode() for i, t, _ in rows if i == r["doc_id"])
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        media = avi.store(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert avi.text_media(docs([])).count() == 0


def test_both_decoders_agree(monkeypatch):
    frame = jpeg.encode_bytes(bytes(range(256)) * 9)[0]
    fast = jpeg.Frame(frame)
    monkeypatch.setattr(jpeg.Frame, "_uniform", lambda self, coded: False)
    slow = jpeg.Frame(frame)
    assert (fast.scan[0]["blocks"] == slow.scan[0]["blocks"]).all() and (fast.luma() == slow.luma()).all()


def test_shots_become_clips(spark):
    dark, light = jpeg.encode_bytes(bytes(jpeg.FRAME_BYTES))[0], jpeg.encode_bytes(bytes([128, 127] * (jpeg.FRAME_BYTES // 2)))[0]
    video = avi.write_avi([dark] * 12 + [light] * 12, 64, 64)
    df = spark.createDataFrame([(1, bytearray(video), "a"), (2, None, "b"), (3, bytearray(b"junk"), "c")], "id long, media binary, clip string")
    got = [tuple(r) for r in avi.clips(df).select("id", "clip", "first_frame", "frames", "start_ms", "end_ms").collect()]
    assert got == [(1, 0, 0, 12, 0.0, 480.0), (1, 1, 12, 12, 480.0, 960.0), (3, None, None, None, None, None)]
    without_index = video[: video.index(b"idx1")]
    assert len(avi.read_avi(without_index).frames) == 24


# --- queries


COLUMNS = {
    "op1": {"doc_id", "text", "n_lines", "n_removed"},
    "op2": {"doc_id", "size", "source_size", "target", "taken"},
    "op3": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "fingerprint", "component_id"},
    "op7": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op8": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op9": {"query_id", "rank", "vec_id", "score"},
    "op10": {"doc_id", "quality_score", "keep"},
}


def test_queries_run_and_have_their_contract_columns(spark, tmp_path):
    """Each query over small tables written as the driver's: its columns, and a row for each document."""
    rows = [r for r in corpus() if r[0] is not None][:20] + [(64, None, "s1")]
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(1).normal(size=(150, 8)))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(queries.QUERIES) == 10
    for name, query in queries.QUERIES.items():
        op = name.split("_")[0]
        got = query(spark, str(tmp_path))
        assert COLUMNS[op] <= set(got.columns), name
        n = got.select("doc_id").distinct().count() if "doc_id" in got.columns else got.select("query_id").distinct().count()
        assert n == (2 if op == "op9" else 21), name


def test_lines_with_clashing_columns(spark):
    from tessera.llm.lines import dedup_lines

    df = spark.createDataFrame([(1, "a line of words\nother", 5, 6, 7), (2, "a line of words", 8, 9, 1), (3, None, 1, 1, 1)], "doc_id long, text string, _k long, _k2 long, _gone long")
    got = {r["doc_id"]: tuple(r) for r in dedup_lines(df).collect()}
    assert got == {1: (1, "a line of words\nother", 5, 6, 7), 2: (2, "", 8, 9, 1), 3: (3, None, 1, 1, 1)}
