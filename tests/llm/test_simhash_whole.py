"""Near duplicates of the pipeline: linked exactly if their shingles are 0.8 alike."""

import random

import numpy as np

from tessera.llm import simhash
from tessera.llm.simhash import one_of_each


def shingles(text, width=5):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_one_of_each_links_by_similarity(docs):
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(80):
        a = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60 + i)]
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] = f"new{rng.random()}"
        x, y = " ".join(a), " ".join(b)
        rows += [(i, x, "s"), (100 + i, y, "s")]
        p, q = shingles(x), shingles(y)
        want |= {i} if len(p & q) >= 0.8 * len(p | q) else {i, 100 + i}
    assert {r["doc_id"] for r in one_of_each(docs(rows)).collect()} == want
    assert 90 < len(want) < 150


def test_one_of_each_meets_on_pigeonring_keys(docs, monkeypatch):
    monkeypatch.setattr(simhash, "SMALLEST", 0)  # nothing meets on shingles then
    rng = random.Random(12)
    rows, want, far = [], set(), 0
    for i in range(40):
        a = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
        b = [*a[:-1], "other"] if i % 2 else [*a[:150], *reversed(a[150:])]
        x, y = " ".join(a), " ".join(b)
        rows += [(i, x, "s"), (100 + i, y, "s")]
        p, q = shingles(x), shingles(y)
        bits = (simhash.fingerprint(x, 5) ^ simhash.fingerprint(y, 5)).bit_count()
        far += bits > 4
        want |= {i} if len(p & q) >= 0.8 * len(p | q) and bits <= 4 else {i, 100 + i}
    assert {r["doc_id"] for r in one_of_each(docs(rows)).collect()} == want and 40 < len(want) < 80 and far > 0


def test_texts_that_share_a_passage_make_no_pairs(docs, monkeypatch):
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    passage = words(60)
    rows = [(i, " ".join([*passage, *words(60)]), "s") for i in range(40)]
    rows.append((100, rows[0][1] + " end", "s"))
    seen, similar = [], simhash._similar

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(simhash, "_similar", counted)
    assert {r["doc_id"] for r in one_of_each(docs(rows)).collect()} == set(range(40))
    assert sum(seen) == 1


def test_bags_allow_for_what_sets_have_in_common(spark):
    rng = random.Random(14)
    rows, want = [], []
    for i in range(300):
        n = rng.choice([1, 5, 60, 400, 12_000])
        a = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        b = np.concatenate([a[rng.randint(0, n // 4) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 4))], np.uint64)])
        a, b = (np.unique(x.view(np.int64)) for x in (a, b))
        both = len(np.intersect1d(a, b))
        want += [i] if both >= 0.8 * (len(a) + len(b) - both) else []
        rows.append((i, len(a), *simhash._bags(a), len(b), *simhash._bags(b)))
    names = ["n", *simhash._bag_names()]
    df = spark.createDataFrame(rows, ["i", *[f"a_{c}" for c in names], *[f"b_{c}" for c in names]])
    got = {r["i"] for r in df.filter(simhash._alike("a_", "b_", 0.8)).collect()}
    assert got >= set(want) and 50 < len(want) < 250
