"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of the embeddings of its hashed parts: the word,
its beginnings and its end.  Filters of several widths run over the words; the
largest response of each over the whole text goes to a logistic output.  The
first embedding dimension starts from how much more often a part occurs in
labelled toxic documents than in others, less its uncertainty; the rest starts
from noise, and all of it is trained with the filters by Adam.

The fit takes a bounded sample of labelled rows; every text is scored whole.
Language is used for decision thresholds only, never for the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Hash buckets for word parts, embedding size, filters of each width, widths.
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 22, 8, 8, (1, 2, 3)
#: Words of a text looked at in one step, and words whose embedding a worker keeps.
STEP, KEPT_WORDS = 1 << 16, 300_000
#: Letters of a word that is kept at most: longer ones are looked up anew each time.
KEPT_LETTERS = 200


def parts(word: str) -> list[int]:
    """Hash buckets of a word: itself, its beginnings of 3 to 6 letters, its last 4."""
    names = {"w" + word} | {f"p{word[:n]}" for n in range(3, 7) if len(word) > n}
    if len(word) > 5:
        names.add("s" + word[-4:])
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names})


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def log_odds(toxic: Counter, clean: Counter, n1: int, n0: int, least: int) -> dict[int, float]:
    """For parts in at least ``least`` documents: log odds, moved towards 0 by 1.5 standard errors."""
    out = {}
    for p in toxic.keys() | clean.keys():
        a, b = toxic[p], clean[p]
        if a + b >= least:
            lo = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
            safe = abs(lo) - 1.5 * np.sqrt(1 / (a + 0.5) - 1 / (n1 + 1) + 1 / (b + 0.5) - 1 / (n0 + 1))
            if safe > 0.5:
                out[p] = float(np.sign(lo) * safe)
    return out


@dataclass
class TextCNN:
    rows: dict[int, int] = field(default_factory=dict)  # bucket -> row of the embedding; row 0 is zero
    emb: np.ndarray = field(default_factory=lambda: np.zeros((1, SIZE), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # each: width x SIZE x FILTERS
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    out_bias: float = 0.0
    shift: tuple[float, float] = (1.0, 0.0)  # calibration of the logit
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    def rows_of(self, word: str) -> tuple[int, ...]:
        return tuple(r for p in parts(word) if (r := self.rows.get(p)))

    def forward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter over the words' embeddings ``e``, and where it is."""
        best = np.zeros(len(self.out), np.float32)
        at = np.full(len(self.out), -1)
        n = len(e)
        for k, (w, b) in enumerate(zip(self.filters, self.bias)):
            width = len(w)
            padded = e if n >= width else np.concatenate([e, np.zeros((width - n, SIZE), np.float32)])
            m = len(padded) - width + 1
            r = b + sum(padded[j : m + j] @ w[j] for j in range(width))
            i = r.argmax(axis=0)
            top = r[i, np.arange(FILTERS)]
            on = slice(k * FILTERS, (k + 1) * FILTERS)
            best[on] = np.maximum(top, 0)
            at[on] = np.where(top > 0, i, -1)
        return best, at

    def logit(self, text: str | None, known: dict[str, int], table: list[np.ndarray]) -> float:
        """Over the whole text, in steps that overlap by the widest filter."""
        words = words_of(text)
        found = list(map(known.get, words))
        if None in found:
            for i, r in enumerate(found):
                if r is None:
                    w = words[i]
                    r = known.get(w)
                    if r is None:
                        mine, r = self.rows_of(w), 0
                        if mine:
                            r = len(table)
                            table.append(self.emb[list(mine)].sum(axis=0))
                        if len(w) <= KEPT_LETTERS:
                            known[w] = r
                    found[i] = r
        ids = np.array(found, np.int64)
        # windows that see only zeros respond with the bias: a few of them stand for all
        near = np.zeros(len(ids), bool)
        hit = np.nonzero(ids)[0]
        for d in range(-max(WIDTHS), max(WIDTHS) + 1):
            near[np.clip(hit + d, 0, max(0, len(ids) - 1))] = True
        ids = np.concatenate([ids[near], np.zeros(max(WIDTHS), np.int64)])
        best = np.zeros(len(self.out), np.float32)
        for i in range(0, len(ids), STEP):
            block = ids[i : i + STEP + max(WIDTHS) - 1]
            best = np.maximum(best, self.forward(np.stack([table[r] for r in block.tolist()]))[0])
        return float(best @ self.out + self.out_bias)

    def scores(self, texts: list[str | None], known: dict[str, int], table: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            if len(known) > KEPT_WORDS:
                known.clear()
                del table[1:]
            out[i] = self.logit(t, known, table)
        z = np.clip(self.shift[0] * out + self.shift[1], -30, 30)
        return 1 / (1 + np.exp(-z))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.scores(texts, {}, [np.zeros(SIZE, np.float32)])


def _counts(docs: list[set[int]], y: np.ndarray) -> tuple[Counter, Counter]:
    toxic, clean = Counter(), Counter()
    for d, t in zip(docs, y):
        (toxic if t else clean).update(d)
    return toxic, clean


def _spread_filters(rng: np.random.Generator) -> list[np.ndarray]:
    """Small noise, and a first look at the first dimension: positive in half the filters."""
    out = []
    for width in WIDTHS:
        w = rng.normal(0, 0.1, (width, SIZE, FILTERS)).astype(np.float32)
        w[:, 0, : FILTERS // 2] += 0.5 / width
        out.append(w)
    return out


def train(texts: list[str | None], y: np.ndarray, langs: list[str | None], epochs: int = 8, rate: float = 0.02, seed: int = 3, parts_kept: int = 60_000) -> TextCNN:
    """Fit on labelled texts.  Copies count once; without both labels all scores are 0.

    One half gives the starting log odds, the other trains the filters, so that
    these learn what a log odds is worth on unseen texts; then both give the log odds.
    A quarter of the second half takes no part in any of this: it calibrates
    the scores and sets the thresholds of each language.
    """
    first: dict[str | None, int] = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    keep = sorted(first.values())
    texts, y, langs = [texts[i] for i in keep], np.asarray(y, np.float64)[keep], [langs[i] for i in keep]
    model, rng = TextCNN(out_bias=-30.0), np.random.default_rng(seed)
    if len(set(y)) < 2 or min(y.sum(), (1 - y).sum()) < 4:
        model.filters = [np.zeros((w, SIZE, FILTERS), np.float32) for w in WIDTHS]
        model.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        return model
    docs = [words_of(t) for t in texts]
    vocabulary = {w: parts(w) for w in {w for d in docs for w in d}}
    sets = [{p for w in set(d) for p in vocabulary[w]} for d in docs]
    group = np.zeros(len(y), int)
    for kind in (0, 1):
        rows = rng.permutation(np.nonzero(y == kind)[0])
        group[rows[len(rows) // 2 :]] = 1
        group[rows[len(rows) - max(1, len(rows) // 8) :]] = 2
    a = group == 0
    least = max(2, int(np.log10(len(y))))
    start = log_odds(*_counts([s for s, ok in zip(sets, a) if ok], y[a]), int(y[a].sum()), int((1 - y[a]).sum()), least)
    # the rows that calibrate give no log odds: their scores have to be those of unseen texts
    b = group != 2
    whole = log_odds(*_counts([s for s, ok in zip(sets, b) if ok], y[b]), int(y[b].sum()), int((1 - y[b]).sum()), least + 1)
    names = sorted(start.keys() | whole.keys(), key=lambda p: (-abs(whole.get(p, start.get(p, 0.0))), p))[:parts_kept]
    model.rows = {p: i + 1 for i, p in enumerate(names)}
    noise = rng.normal(0, 0.02, (len(names) + 1, SIZE)).astype(np.float32)
    noise[0] = 0
    model.emb = noise.copy()
    model.emb[1:, 0] = [start.get(p, 0.0) / 4 for p in names]
    model.filters, model.bias = _spread_filters(rng), [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    model.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    model.out_bias = float(np.log(y.mean() / (1 - y.mean())) - 1)
    found = {w: model.rows_of(w) for w in vocabulary}
    rows = [[found[w] for w in d] for d in docs]

    def embed(d: list[tuple[int, ...]]) -> np.ndarray:
        e = np.zeros((max(1, len(d)), SIZE), np.float32)
        for i, r in enumerate(d):
            if r:
                e[i] = model.emb[list(r)].sum(axis=0)
        return e

    weights = [*model.filters, *model.bias, model.out]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, batch = 0, 32
    mine = np.nonzero(group == 1)[0]
    for _ in range(epochs):
        for lo in range(0, len(mine), batch):
            if lo == 0:
                mine = rng.permutation(mine)
            grads, g0, moved = [np.zeros_like(w) for w in weights], 0.0, {}
            for i in mine[lo : lo + batch]:
                d = rows[i]
                e = embed(d)
                best, at = model.forward(e)
                p = 1 / (1 + np.exp(-np.clip(best @ model.out + model.out_bias, -30, 30)))
                err = float((p - y[i]) * (2.0 if y[i] else 1.0))
                grads[-1] += err * best
                g0 += err
                for f in np.nonzero(at >= 0)[0]:
                    k, c, s = f // FILTERS, f % FILTERS, at[f]
                    g = err * model.out[f]
                    grads[len(WIDTHS) + k][c] += g
                    for j in range(WIDTHS[k]):
                        if s + j < len(e):
                            grads[k][j, :, c] += g * e[s + j]
                            for r in d[s + j] if s + j < len(d) else ():
                                moved[r] = moved.get(r, 0) + g * model.filters[k][j, :, c]
            step += 1
            for w, g, mm, vv in zip(weights, grads, m, v):
                g = g / batch + 1e-4 * w
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                w -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-6)
            model.out_bias -= rate * g0 / batch * 5
            for r, g in moved.items():
                model.emb[r] -= rate * np.clip(g / batch * 5, -0.5, 0.5)
    learned = model.emb[1:, 0] - np.array([start.get(p, 0.0) / 4 for p in names], np.float32)
    model.emb[1:, 0] = np.array([whole.get(p, start.get(p, 0.0)) / 4 for p in names], np.float32) + learned
    _calibrate(model, [t for t, g in zip(texts, group) if g == 2], y[group == 2], [ln for ln, g in zip(langs, group) if g == 2])
    return model


def _calibrate(model: TextCNN, texts: list, y: np.ndarray, langs: list) -> None:
    """Scale and shift of the logit by regularised logistic regression; then thresholds by language."""
    known, table = {}, [np.zeros(SIZE, np.float32)]
    z = np.array([model.logit(t, known, table) for t in texts])
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.05 * (np.mean((p - y) * z) / (1 + np.mean(z * z)) * 4 + 0.02 * (a - 1))
        b -= 0.5 * (np.mean(p - y) + 0.01 * b)
    model.shift = (float(a), float(b))
    s = model.score(texts)

    def best(mask: np.ndarray) -> float | None:
        t, k = y[mask], s[mask]
        if t.sum() < 5:
            return None
        cuts = np.unique(np.round(k, 3))
        f1 = [2 * t[k >= c].sum() / ((k >= c).sum() + t.sum()) for c in cuts]
        i = int(np.argmax(f1))
        return float((cuts[i] + (cuts[i - 1] if i else 0.0)) / 2)

    model.threshold = best(np.ones(len(y), bool)) or 0.3
    for ln in {x for x in langs if x is not None}:
        c = best(np.array([x == ln for x in langs]))
        if c is not None:
            model.thresholds[ln] = c


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_toxicity(
    df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
    positives: int = 1_500, negatives: int = 3_500, longest: int = 20_000,
) -> TextCNN:
    """Fit on about ``positives`` and ``negatives`` labelled rows at most, chosen by a hash of the id.

    Held-out rows, rows with a null id or label, and texts of over ``longest``
    characters (which are scored like all others) aren't fitted on.  An id with
    contradicting labels counts as toxic.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("_d")).agg(F.max(label).cast("int").alias("_y"))
    n = marks.agg(F.sum("_y"), F.sum(1 - F.col("_y"))).first()
    cut = 1 << 30
    most = F.when(F.col("_y") == 1, int(cut * min(1.0, positives / max(1, n[0] or 1)))).otherwise(int(cut * min(1.0, negatives / max(1, n[1] or 1))))
    chosen = marks.filter(F.pmod(F.xxhash64("_d"), F.lit(cut)) < most)
    slim = df.select(df[doc_id].alias("d"), df[text].alias("t"), df[lang].cast("string").alias("ln"))
    slim = slim.filter(F.coalesce(F.length("t"), F.lit(0)) <= longest)
    # about ``positives + negatives`` ids, whatever the size of the table
    rows = slim.join(F.broadcast(chosen), F.col("d") == F.col("_d")).select("d", "t", "ln", "_y").dropDuplicates(["d"])
    got = sorted(rows.collect(), key=lambda r: r["d"])
    return train([r["t"] for r in got], np.array([r["_y"] for r in got]), [r["ln"] for r in got])


def with_toxicity(df: DataFrame, model: TextCNN, text: str = "text", lang: str = "lang", score: str = "score", flag: str = "toxic_by_language") -> DataFrame:
    """``df``, each row's score from its whole text, and whether it passes its language's threshold.

    Null and empty texts get the score of a text without words.  A null or
    unknown language takes the common threshold.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, table = {}, [np.zeros(SIZE, np.float32)]
        for t in batches:
            yield pd.Series(shared.value.scores(t.tolist(), known, table))

    cut = F.lit(model.threshold)
    for ln, c in sorted(model.thresholds.items()):
        cut = F.when(df[lang] == ln, F.lit(c)).otherwise(cut)
    return df.withColumn(score, of(df[text])).withColumn(flag, F.col(score) >= cut)
