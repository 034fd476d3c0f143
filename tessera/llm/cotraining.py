"""Quality classifier by co-training (Blum and Mitchell, 1998).

Two logistic models look at two views of a document: its text (counts of byte
pairs, and how much words repeat) and its page, that is the columns that come
with it (language, source, length, address), no byte of the text.  Over several
rounds each scores all unlabelled documents and labels those it is surest of
for the other.  Both are then calibrated on held-out labels and combined, and
all documents are scored.

A model is fitted on a bounded sample of labelled rows, whose features the
executors compute from whole texts; candidates for new labels are all rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Buckets for pairs of bytes, and for what the page says.
PAIRS, NAMES = 1024, 512
#: Bytes looked at in one step, to bound memory on long texts.
STEP = 1 << 20
#: Columns that make up a page's view, if a table has them.
PAGE = ("lang", "source", "n_chars", "url")


def text_view(text: str | None) -> np.ndarray:
    """Frequencies of hashed byte pairs as square roots, and four measures of repetition."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    counts = np.zeros(PAIRS, np.int64)
    for i in range(0, max(0, len(b) - 1), STEP):
        right = b[i + 1 : i + STEP + 1]
        pairs = b[i : i + len(right)].astype(np.uint16) * np.uint16(40503) + right * np.uint16(9)
        counts += np.bincount(pairs % np.uint16(PAIRS), minlength=PAIRS)
    total = max(1, counts.sum())
    words = (text or "").split()
    distinct = Counter(words)
    lines = (text or "").split("\n")
    n = max(1, len(words))
    share = np.array(heapq.nlargest(3, distinct.values()) or [0]) / n
    extra = np.array(
        [
            len(distinct) / n,
            share[0],
            share.sum(),
            len(set(lines)) / max(1, len(lines)),
        ]
    )
    return np.concatenate([np.sqrt(counts / total), extra, [np.log1p(n) / 10]]).astype(np.float32)


def page_view(page: dict[str, object]) -> np.ndarray:
    """What the columns say: names and pairs of names, hashed, the host of an address, and numbers by their size."""
    out = np.zeros(NAMES, np.float32)
    marks, sizes = [], []
    for name, value in sorted(page.items()):
        if isinstance(value, (int, float)) and value == value:
            sizes.append(np.log1p(max(0.0, float(value))))
            marks.append(f"{name}:{int(2 * sizes[-1])}")
        else:
            text = None if value is None or value != value else str(value)
            marks.append(f"{name}:{text}")
            if text and "://" in text:
                marks.append(f"{name}:" + text.split("://", 1)[1].split("/", 1)[0])
    for m in [*marks, *(f"{x}|{y}" for i, x in enumerate(marks) for y in marks[i + 1 :])]:
        out[zlib.crc32(m.encode("utf-8", "surrogatepass")) % NAMES] += 1
    size = sum(sizes) / 12
    return np.concatenate([out, np.array([size, size * size], np.float32)])


@dataclass
class Logistic:
    """Logistic regression with an L2 penalty, fitted by Adam; features are standardised by scale."""

    penalty: float = 1e-4
    steps: int = 120
    rate: float = 0.05
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    bias: float = 0.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1, np.float32))

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Logistic:
        x, y, w = x.astype(np.float32), y.astype(np.float32), (w / w.sum()).astype(np.float32)
        self.mean = x.mean(axis=0)
        self.scale = 1 / (x.std(axis=0) + np.float32(0.02))
        z = (x - self.mean) * self.scale
        beta, bias = np.zeros(x.shape[1], np.float32), float(np.log((w @ y + 1e-3) / (1 - w @ y + 1e-3)))
        m, v, mb, vb = np.zeros_like(beta), np.zeros_like(beta), 0.0, 0.0
        for t in range(1, self.steps + 1):
            p = 1 / (1 + np.exp(-np.clip(z @ beta + bias, -30, 30)))
            e = (p - y) * w
            g, gb = z.T @ e + self.penalty * beta, e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            a, c = 1 - 0.9**t, 1 - 0.99**t
            beta = beta - self.rate * (m / a) / (np.sqrt(v / c) + 1e-6)
            bias -= self.rate * (mb / a) / (np.sqrt(vb / c) + 1e-6)
        self.weights, self.bias = beta.astype(np.float32), float(bias)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weights + self.bias


@dataclass
class CoTrained:
    """The two views' models and the weights that combine their calibrated logits."""

    text: Logistic
    page: Logistic
    combine: np.ndarray  # text, page, bias

    def logits(self, texts: list, pages: list[dict[str, object]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.empty(len(texts)), np.empty(len(texts))
        for i in range(0, len(texts), 256):
            on = slice(i, i + 256)
            a[on] = self.text.logit(np.stack([text_view(x) for x in texts[on]]))
            b[on] = self.page.logit(np.stack([page_view(x) for x in pages[on]]))
        return np.clip(a, -20, 20), np.clip(b, -20, 20)

    def score(self, texts: list, pages: list[dict[str, object]]) -> np.ndarray:
        """Probability that each document is of good quality."""
        if not len(texts):
            return np.empty(0)
        a, b = self.logits(texts, pages)
        return 1 / (1 + np.exp(-(a * self.combine[0] + b * self.combine[1] + self.combine[2])))


@dataclass
class Rows:
    """Features of both views, labels, and how much each counts."""

    a: np.ndarray
    b: np.ndarray
    y: np.ndarray

    def __add__(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.a, other.a]), np.concatenate([self.b, other.b]), np.concatenate([self.y, other.y]))

    def only(self, mask: np.ndarray) -> Rows:
        return Rows(self.a[mask], self.b[mask], self.y[mask])


def undecided() -> CoTrained:
    """A model that scores everything 1: nothing says that anything is bad."""
    flat = lambda n: Logistic(weights=np.zeros(n, np.float32), mean=np.zeros(n, np.float32))
    return CoTrained(flat(PAIRS + 5), flat(NAMES + 2), np.array([0.0, 0.0, 40.0]))


def refit(train: Rows, lent: list[Rows | None]) -> list[Logistic]:
    """Both views on the labelled rows, kinds balanced, and on what the other view has lent, which counts half."""
    good = train.y.mean()
    balance = np.where(train.y == 1, 0.5 / good, 0.5 / (1 - good))
    out = []
    for k in (0, 1):
        rows, w = train, balance
        if lent[k] is not None and len(lent[k].y):
            rows, w = train + lent[k], np.concatenate([balance, np.full(len(lent[k].y), 0.5)])
        out.append(Logistic().fit((rows.a, rows.b)[k], rows.y, w))
    return out


def combined(models: list[Logistic], held: Rows) -> CoTrained:
    """The views weighed by a logistic model of their logits on held-out labels."""
    s = np.stack([np.clip(m.logit(v), -20, 20) for m, v in zip(models, (held.a, held.b))], axis=1)
    c = Logistic(penalty=1e-2, steps=400).fit(s, held.y, np.ones(len(held.y)))
    w = c.weights * c.scale
    return CoTrained(models[0], models[1], np.array([w[0], w[1], c.bias - c.mean @ w]))


def sure_from(train: Rows, sure: float, rng: np.random.Generator) -> list[tuple[float, float]]:
    """For each view, the logits up to and from which it is right about a label with probability ``sure``.

    Each half of the rows is scored by a model of the other half, and a
    logistic model of these scores says what a logit is worth.  A view that
    tells nothing is never sure.
    """
    half = rng.permutation(len(train.y)) % 2 == 0
    if any(len(set(train.y[m])) < 2 for m in (half, ~half)):
        return [(-np.inf, np.inf)] * 2
    z = np.empty((2, len(train.y)))
    for m in (half, ~half):
        for k, model in enumerate(refit(train.only(~m), [None, None])):
            z[k, m] = np.clip(model.logit((train.a, train.b)[k][m]), -20, 20)
    out, need = [], float(np.log(sure / (1 - sure)))
    for k in (0, 1):
        c = Logistic(penalty=1e-2, steps=400).fit(z[k][:, None], train.y, np.ones(len(train.y)))
        w = float(c.weights[0] * c.scale[0])
        b = c.bias - float(c.mean[0]) * w
        out.append(((-need - b) / w, (need - b) / w) if w > 0 else (-np.inf, np.inf))
    return out


def _pages(df: DataFrame, page: tuple[str, ...]) -> Column:
    """The page's columns that ``df`` has; numbers stay numbers, all else becomes text."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = {c.lower(): t for c, t in df.dtypes}
    have = [c for c in page if c.lower() in kinds]
    cols = [df[c].cast("double" if kinds[c.lower()] in numbers else "string").alias(c) for c in have]
    return F.struct(*cols) if cols else F.struct(F.lit(None).cast("string").alias("none"))


def _dicts(pages: pd.DataFrame) -> list[dict[str, object]]:
    return pages.to_dict("records")


def _features(rows: DataFrame) -> Rows:
    """Features of ``rows`` (d, t, p, y), computed where the texts are and collected: a bounded sample."""

    @F.pandas_udf("struct<a:binary,b:binary>")
    def of(texts: pd.Series, pages: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": [text_view(t).tobytes() for t in texts], "b": [page_view(p).tobytes() for p in _dicts(pages)]})

    got = rows.select("d", "y", of("t", "p").alias("f")).dropDuplicates(["d"]).collect()
    got.sort(key=lambda r: str(r["d"]))
    view = lambda name, n: np.array([np.frombuffer(r["f"][name], np.float32) for r in got], np.float32).reshape(-1, n)
    return Rows(view("a", PAIRS + 5), view("b", NAMES + 2), np.array([r["y"] for r in got], np.float64))


def _lent(slim: DataFrame, ids: DataFrame, models: list[Logistic], sure: list[tuple[float, float]], bad: float, share: float, most: int) -> list[Rows | None]:
    """For each view, the rows of which the other view is surest: all unlabelled rows are scored.

    Histograms of the logits give the bounds that the ``share`` surest pass,
    good and bad in the proportion of the labels, as far as they are ``sure``
    (see ``sure_from``); about ``most`` of them, by a hash, are handed over.
    """
    shared = slim.sparkSession.sparkContext.broadcast(CoTrained(models[0], models[1], np.array([0.5, 0.5, 0.0])))

    @F.pandas_udf("struct<a:double,b:double>")
    def of(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for t, p in batches:
            a, b = shared.value.logits(t.tolist(), _dicts(p))
            yield pd.DataFrame({"a": a, "b": b})

    scored = slim.filter(F.col("d").isNotNull()).select("d", of("t", "p").alias("s")).select("d", "s.a", "s.b")
    scored = written(scored)
    free = scored.join(ids, scored["d"] == ids["_d"], "left_anti")
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(v) * 8).cast("int").alias("q")) for k, v in enumerate("ab")])).alias("x")
    counts = free.select(bins).groupBy("x.k", "x.q").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 642 rows
    out: list[Rows | None] = [None, None]
    for k, v in enumerate("ab"):
        mine = sorted((r["q"], r["n"]) for r in counts if r["k"] == k)
        total = sum(n for _, n in mine)
        if not total:
            continue

        def bound(bins_: list[tuple[int, int]], wanted: float) -> tuple[int | None, int]:
            """The last bin that still fits into ``wanted`` rows (the first in any case), and the rows up to it."""
            have, last = 0, None
            for q, n in bins_:
                if last is not None and have + n > wanted:
                    break
                have, last = have + n, q
            return last, have

        low, n0 = bound([x for x in mine if x[0] + 1 <= 8 * sure[k][0]], bad * share * total)
        high, n1 = bound([x for x in reversed(mine) if x[0] >= 8 * sure[k][1]], (1 - bad) * share * total)
        cut = 1 << 30
        q, h = F.floor(F.col(v) * 8), F.pmod(F.xxhash64(F.lit(k), "d"), F.lit(cut))
        other, (no, yes) = F.col("ab"[1 - k]), sure[1 - k]
        sides = []
        # nothing is lent to a view that is sure of the contrary
        for last, n, ok, y in ((low, n0, lambda: (q <= low) & (other < yes), 0.0), (high, n1, lambda: (q >= high) & (other > no), 1.0)):
            if last is not None:
                rate = min(1.0, most * (bad if y == 0 else 1 - bad) / n)
                sides.append(free.filter(ok() & (h < int(cut * rate))).select(F.col("d").alias("_i"), F.lit(y).alias("y")))
        if sides:
            chosen = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
            # about ``most`` ids, whatever the size of the table
            out[1 - k] = _features(slim.join(F.broadcast(chosen.dropDuplicates(["_i"])), F.col("d") == F.col("_i")).select("d", "t", "p", "y"))
    return out


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    page: tuple[str, ...] = PAGE,
    labelled: int = 3_000,
    lent: int = 600,
    rounds: int = 2,
    share: float = 0.1,
    sure: float = 0.98,
    held_out: float = 0.25,
    seed: int = 5,
) -> CoTrained:
    """Fit on at most about ``labelled`` labelled documents, chosen by a hash of the id, and all others unlabelled.

    In each of ``rounds`` rounds both views score all unlabelled documents and
    each labels the ``share`` it is surest of for the other, if its labels are
    right with probability ``sure`` as far as the known ones tell; the other is
    then fitted on about ``lent`` of these too.  ``held_out`` of the labelled rows
    calibrate and combine the views and aren't trained on.

    Texts are read whole.  Rows with a null id lend nothing; null labels and
    ids don't count, and of contradicting labels for an id the larger does.
    Null values in a page's columns are values of their own; columns that
    ``df`` lacks are left out.  With under 8 labels, or labels of one kind
    only, or no rows, all scores are 1.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    marks = marks.groupBy(F.col(doc_id).alias("_d")).agg(F.max(label).cast("double").alias("_q"))
    slim = df.select(df[doc_id].alias("d"), df[text].alias("t"), _pages(df, page).alias("p"))
    ids = written(slim.filter(F.col("d").isNotNull()).select("d").join(marks, F.col("d") == F.col("_d")).select("_d", "_q").distinct())
    n = ids.count()
    cut = 1 << 30
    chosen = ids.filter(F.pmod(F.xxhash64("_d"), F.lit(cut)) < int(cut * min(1.0, labelled / max(1, n))))
    known = _features(slim.join(F.broadcast(chosen), F.col("d") == F.col("_d")).select("d", "t", "p", F.col("_q").alias("y")))
    if len(known.y) < 8 or len(set(known.y)) < 2:
        return undecided()
    rng = np.random.default_rng(seed)
    calibrate = np.zeros(len(known.y), bool)
    for kind in (0, 1):
        rows = np.nonzero(known.y == kind)[0]
        calibrate[rng.permutation(rows)[: max(1, int(held_out * len(rows)))]] = True
    train, held = known.only(~calibrate), known.only(calibrate)
    if len(set(train.y)) < 2:
        train = held = known
    models = refit(train, [None, None])
    worth = sure_from(train, sure, rng)
    for _ in range(rounds):
        models = refit(train, _lent(slim, ids, models, worth, 1 - train.y.mean(), share, lent))
    return combined(models, held)


def with_quality(df: DataFrame, model: CoTrained, text: str = "text", page: tuple[str, ...] = PAGE, out: str = "quality_score") -> DataFrame:
    """``df`` and each row's score (probability of good quality), from its whole text and its page's columns.

    Null or empty texts are scored too, by what their page says; null columns
    are values of their own.  Repeated rows get equal scores.  No rows: no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for t, p in batches:
            yield pd.Series(shared.value.score(t.tolist(), _dicts(p)))

    return df.withColumn(out, score(df[text], _pages(df, page)))


def keep_good(df: DataFrame, model: CoTrained, least: float = 0.5, **columns) -> DataFrame:
    """The rows of ``df`` that score at least ``least``; columns as in ``df``.

    Rows with null or empty texts are judged by their page; repeated rows stay or go together.
    """
    s = fresh(df, "quality")
    return with_quality(df, model, out=s, **columns).filter(F.col(s) >= least).drop(s)
