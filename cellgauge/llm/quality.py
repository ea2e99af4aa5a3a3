"""Quality by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear machine.

The n-grams of a text are its runs of 1 to ORDER bytes in UTF-8, and runs of 1 to ORDER marks that say of each
word whether it equals the word before it, so that a text that says the same over and over has n-grams that
others lack, whatever its words are. Each n-gram is dealt to one of BUCKETS buckets by a hash; a text holds a
bucket or doesn't, however often. r is the log of the ratio of a bucket's share among texts labelled 1 to
its share among texts labelled 0, each count smoothed by 1. A held bucket's value is r / SCALE, and a machine
with hinge loss is fitted to these by dual coordinate descent, both classes weighted alike. Its margins become
scores by a logistic curve, fitted to the margins that machines of two thirds of the rows give the others.

Fitting uses at most max_rows labelled rows, those with the least hashes of their id, and of them, in that
order, as many as hold max_held buckets together, so the driver gets 4 bytes for each and no texts. Scoring
covers every row and its whole text; a task holds one batch and BUCKETS marks. Labels, language, source and id
are no inputs of a score.

A null text is an empty one; both hold no bucket and have the score of a margin of the bias alone. Rows repeated
in the labels count once each; a text that two labels mark counts for both; null labels and ids are left out.
Without labels of both kinds every text has the (smoothed) share of label 1. Empty tables give empty ones; the
column `_quality` is replaced if there, any others may be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

ORDER = 4
BITS = 18
BUCKETS = 1 << BITS
SCALE = 30.0
#: Labelled rows that a machine is fitted to at most, and the buckets that they hold together.
MAX_ROWS = 6_000
MAX_HELD = 20_000_000
#: Cost of a unit of hinge loss, and sweeps over the rows at most.
COST = 1.0
SWEEPS = 30
FOLDS = 3
#: Bytes of a text that are looked at together.
PIECE = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


def _runs(symbols: np.ndarray, kind: int) -> Iterator[np.ndarray]:
    """Buckets of the runs of 1 to ORDER symbols, each 1 or more; kind tells alphabets apart."""
    h = np.zeros(len(symbols), np.uint64)
    for n in range(1, min(ORDER, len(symbols)) + 1):
        h = h[: len(symbols) - n + 1] * _STEP + symbols[n - 1 :]
        yield ((h + np.uint64(n * 7_919 + kind * 104_729)) * _MULT >> np.uint64(64 - BITS)).astype(np.int32)


def buckets(text: str | None, marks: np.ndarray | None = None) -> np.ndarray:
    """The buckets that a text holds, in order. marks: BUCKETS false marks to work with, left false."""
    marks = np.zeros(BUCKETS, bool) if marks is None else marks
    if text:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        for at in range(0, len(data), PIECE):  # pieces overlap, so that no run is lost
            for found in _runs(data[max(0, at - ORDER + 1) : at + PIECE].astype(np.uint64) + np.uint64(1), 0):
                marks[found] = True
        words = text.split()
        again = np.fromiter((a == b for a, b in zip(words, words[1:])), bool, max(0, len(words) - 1))  # noqa: B905
        for found in _runs(again.astype(np.uint64) + np.uint64(1), 1):
            marks[found] = True
    held = np.flatnonzero(marks).astype(np.int32)
    marks[held] = False
    return held


@dataclass
class QualityModel:
    """A text's margin is bias and the sum of its buckets' weights; its score a logistic curve of slope * margin + shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, held: np.ndarray) -> float:
        return float(self.weights[held].sum(dtype=np.float64)) + self.bias

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.asarray(margins, dtype=float) + self.shift, -500, 500)))


def log_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Per bucket the log of its share among rows labelled 1 over that among the others."""
    one, other = (np.bincount(np.concatenate([np.empty(0, np.int32), *(x for x, y in zip(rows, label, strict=True) if y == k)]), minlength=BUCKETS) + 1.0 for k in (1, 0))
    return np.log(one / one.sum()) - np.log(other / other.sum())


def train(rows: list[np.ndarray], label: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, float]:
    """Weights of the buckets and the bias: scaled indicators, hinge loss, dual coordinate descent."""
    scale = log_ratios(rows, label) / SCALE
    sign = np.where(label == 1, 1.0, -1.0)
    most = np.where(label == 1, COST / 2 / max(1, (label == 1).sum()), COST / 2 / max(1, (label == 0).sum())) * len(label)
    values = [scale[x] for x in rows]
    # The bias is the weight of a feature that all rows have.
    square = np.array([v @ v + 1 for v in values])
    w, bias, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(0)
    for _ in range(sweeps):
        moved = 0.0
        for k in draw.permutation(len(rows)):
            held, v = rows[k], values[k]
            new = min(max(dual[k] + (1 - sign[k] * (w[held] @ v + bias)) / square[k], 0.0), most[k])
            if step := (new - dual[k]) * sign[k]:
                w[held] += step * v
                bias += step
                moved = max(moved, abs(step))
                dual[k] = new
        if moved < 1e-4:
            break
    return w * scale, bias


def logistic_curve(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve nearest to the labels, which are drawn in a little by their numbers."""
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    want = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margins, np.ones(len(margins))])

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ b).sum() - want @ (x @ b))

    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (want - p)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(b + size * step) > loss(b):
            size /= 2
        b = b + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit_rows(rows: list[np.ndarray], labels: list[int]) -> QualityModel:
    label = np.array(labels, dtype=int)
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    if min(n1, n0) < FOLDS:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    # Each class is dealt to the folds in turn, so every fold has both.
    fold = np.zeros(len(label), dtype=int)
    for k in (0, 1):
        fold[label == k] = np.arange((label == k).sum()) % FOLDS
    margins = np.zeros(len(label))
    for f in range(FOLDS):
        seen = np.flatnonzero(fold != f)
        w, bias = train([rows[k] for k in seen], label[seen])
        for k in np.flatnonzero(fold == f):
            margins[k] = w[rows[k]].sum() + bias
    w, bias = train(rows, label)
    return QualityModel(w.astype(np.float32), bias, *logistic_curve(margins, label))


@F.pandas_udf(BinaryType())
def _held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    marks = np.zeros(BUCKETS, bool)
    for texts in batches:
        yield pd.Series([buckets(t if isinstance(t, str) else None, marks).tobytes() for t in texts])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", max_rows: int = MAX_ROWS, max_held: int = MAX_HELD) -> QualityModel:
    """A machine fitted to the texts of docs that labels (key, label 0 or 1) marks.

    At most max_rows labels are drawn, from narrow rows; only they, so a bounded table, are broadcast to
    find their texts, whose buckets are made where the texts are.
    """
    order = F.md5(F.col(key).cast("string"))
    drawn = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label).distinct()
    drawn = drawn.orderBy(order, label).limit(max_rows)
    chosen = docs.select(key, text).join(F.broadcast(drawn), key).select(order.alias("_order"), F.col(label).alias("_label"), _held(F.col(text)).alias("_held"))
    chosen = chosen.orderBy("_order", "_held", "_label").limit(max_rows)
    # max_rows rows at most: one task adds up what they hold.
    so_far = F.sum(F.length("_held")).over(Window.orderBy("_order", "_held", "_label").rowsBetween(Window.unboundedPreceding, 0))
    got = chosen.withColumn("_far", so_far).where(F.col("_far") <= 4 * max_held).orderBy("_order", "_held", "_label").select("_label", "_held").collect()
    return fit_rows([np.frombuffer(r["_held"], np.int32) for r in got], [int(r["_label"]) for r in got])


def score(df: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """df with `_quality` (replaced if there): score, and the margin that it comes from."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, margin double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        marks, machine = np.zeros(BUCKETS, bool), shared.value
        for texts in batches:
            margins = np.array([machine.margin(buckets(t if isinstance(t, str) else None, marks)) for t in texts], dtype=float)
            yield pd.DataFrame({"score": machine.probability(margins), "margin": margins})

    return df.withColumn("_quality", judge(F.col(text)))
