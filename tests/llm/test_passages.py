import collections
import hashlib
import random

import pytest

from tessera.llm.passages import passage_digest, remove_passages
from tessera.llm.rindex import RunIndex


def brute(rows, width):
    count = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in texts:
        for a in range(len(b) - width + 1):
            count[b[a : a + width]] += 1
    out = []
    for i, b in texts:
        gone = set()
        for a in range(len(b) - width + 1):
            if count[b[a : a + width]] > 1:
                gone.update(range(a, a + width))
        spans = sum(1 for x in gone if x - 1 not in gone)
        kept = bytes(c for x, c in enumerate(b) if x not in gone)
        out.append((i, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        own = " ".join(word() for _ in range(rng.randint(0, 50)))
        a = rng.randint(0, len(shared) // 2)
        part = shared[a : a + rng.randint(20, 200)]
        if rng.random() < 0.3:
            part = part[:40] + "#" + part[40:]
        rows.append((i, own[: len(own) // 2] + part + own[len(own) // 2 :], "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "ab" * 300, None), (103, "x" * 79, "s"), (104, rows[3][1], "s")]
    rows += [(3, rows[3][1], "s"), (None, rows[5][1], "s"), (200, "q" * 80, "s")]
    return rows


@pytest.mark.parametrize("most", [1_500, 2])
def test_matches_brute_force(docs, most):
    rows = corpus(most)
    out = passage_digest(docs(rows), width=80, gram=30, most=most)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 80)


def test_keeps_columns_and_empty_table(docs):
    out = remove_passages(docs([]), width=80, gram=30)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "k", "f", "kept", "removed"]
    assert out.count() == 0


def test_index_finds_all_repeats():
    rng = random.Random(2)
    for _ in range(100):
        letters = rng.choice([b"ab", b"abc", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(60))
        strings = {base[a : a + rng.randint(1, 40)] for a in (rng.randint(0, 30) for _ in range(5))} - {b""}
        strings, width = sorted([*strings, *rng.sample(sorted(strings), min(len(strings), rng.randint(0, 3)))]), rng.randint(2, 12)
        count = collections.Counter(s[i : i + width] for s in strings for i in range(len(s) - width + 1))
        for s, got in zip(strings, RunIndex(strings).repeated(width)):
            assert [count[s[i : i + width]] > 1 for i in range(len(s) - width + 1)] == got.tolist()


def test_copies_lengthen_runs_and_add_none():
    one, many = RunIndex([b"banana bread"]), RunIndex([b"banana bread"] * 50)
    assert len(one.heads) == len(many.heads) and (many.lengths == 50 * one.lengths).all()
    assert many.lengths.sum() == 50 * 13


def test_texts_over_the_step(docs):
    """Runs break at a mebibyte; repeats that lie across the break are found whole."""
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij ") for _ in range((1 << 20) + 5_000))
    rows = [(1, long, "s"), (2, "start " + long[(1 << 20) - 300 : (1 << 20) + 250] + " end", "s"), (3, long[10:95], "s"), (4, long[(1 << 20) + 900 :][:3_000], "s")]
    out = passage_digest(docs(rows), width=80, gram=30)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 80)
