import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.llm import quality
from cellgauge.llm.queries import op11_quality

SF = "/root/testdata/sf0.01"


def plain_buckets(text):
    """The same buckets, one n-gram after the other."""
    data, words = (text or "").encode("utf-8", "replace"), (text or "").split()
    out = set()
    for kind, symbols in ((0, [b + 1 for b in data]), (1, [1 + (a == b) for a, b in zip(words, words[1:], strict=False)])):
        for n in range(1, quality.ORDER + 1):
            for i in range(len(symbols) - n + 1):
                h = 0
                for x in symbols[i : i + n]:
                    h = (h * 1_000_003 + x) % (1 << 64)
                out.add((h + n * 7_919 + kind * 104_729) % (1 << 64) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - quality.BITS))
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " ", "a", "ab", "a a", "ein ein ein ein Wort, été\n\tñ \ud800", "x" * 50])
def test_buckets_are_those_of_every_run(text):
    assert quality.buckets(text).tolist() == plain_buckets(text)


def test_pieces_lose_no_run(monkeypatch):
    text = " ".join(random.Random(1).choice(["alpha", "beta", "été"]) for _ in range(200))
    whole = quality.buckets(text).tolist()
    monkeypatch.setattr(quality, "PIECE", 7)
    assert quality.buckets(text).tolist() == whole == plain_buckets(text)


def made(n, seed=0):
    draw = random.Random(seed)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]
    out = []
    for k in range(n):
        w = [draw.choice(words) for _ in range(draw.randint(1, 60))]
        out.append((k, " ".join(w) if k % 4 else " ".join(x + "##" if draw.random() < 0.5 else x for x in w + ["elit##"]), int(bool(k % 4))))
    return out


def test_machine_meets_its_optimality_conditions():
    rows = made(120)
    held, label = [quality.buckets(t) for _, t, _ in rows], np.array([y for *_, y in rows])
    w, bias = quality.train(held, label, sweeps=2000)
    r = quality.log_ratios(held, label) / quality.SCALE
    raw = np.divide(w, r, out=np.zeros_like(w), where=r != 0)
    sign = np.where(label == 1, 1.0, -1.0)
    cost = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()) * len(label) * quality.COST
    margin = sign * np.array([w[x].sum() + bias for x in held])
    primal = (raw @ raw + bias * bias) / 2 + cost @ np.maximum(0, 1 - margin)
    # A plain subgradient descent on the same loss comes no lower.
    v, c, best = np.zeros_like(raw), 0.0, np.inf
    for step in range(1, 3000):
        m = sign * np.array([(v * r)[x].sum() + c for x in held])
        best = min(best, (v @ v + c * c) / 2 + cost @ np.maximum(0, 1 - m))
        g, gc = v.copy(), c
        for x, s, a, k in zip(held, sign, cost, m < 1, strict=True):
            if k:
                g[x] -= a * s * r[x]
                gc -= a * s
        v, c = v - g / step, c - gc / step
    assert primal <= best * 1.001


def test_ratios_are_smoothed_shares():
    rows = [np.array([1, 2], np.int32), np.array([2], np.int32), np.array([3], np.int32)]
    r = quality.log_ratios(rows, np.array([1, 1, 0]))
    n = quality.BUCKETS
    assert r[2] == pytest.approx(np.log(3 / (3 + n) / (1 / (1 + n))))
    assert r[3] == pytest.approx(np.log(1 / (3 + n) / (2 / (1 + n))))


def test_logistic_curve_is_the_best_of_many():
    draw = np.random.default_rng(2)
    m = draw.normal(size=200)
    y = (m + draw.normal(size=200) > 0).astype(int)
    want = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (200 - y.sum() + 2))

    def loss(a, b):
        return np.logaddexp(0, a * m + b).sum() - want @ (a * m + b)

    a, b = quality.logistic_curve(m, y)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.1, 0, 0.1) for db in (-0.1, 0, 0.1))


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id bigint, label int")


def test_learns_and_ignores_order_copies_and_other_columns(spark):
    rows = made(200)
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels)
    again = quality.fit(docs.orderBy(F.desc("doc_id")).withColumn("label", F.lit(9)), labels.unionByName(labels))
    assert (model.weights == again.weights).all() and model.bias == again.bias
    seen = {r["doc_id"]: r["s"] for r in quality.score(docs, model).select("doc_id", F.col("_quality.score").alias("s")).collect()}
    assert all((seen[d] >= 0.5) == bool(y) for d, _, y in rows)
    fresh = made(80, seed=9)
    assert np.mean([(model.probability(model.margin(quality.buckets(t))) >= 0.5) == bool(y) for _, t, y in fresh]) > 0.95


def test_bounds_of_the_sample_hold(spark, monkeypatch):
    rows = made(200)
    docs, labels = frames(spark, rows)
    took = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, labels: took.append((len(rows), sum(map(len, rows)))))
    quality.fit(docs, labels, max_rows=50)
    quality.fit(docs, labels, max_held=2_000)
    assert took[0][0] == 50 and 0 < took[1][0] < 200 and took[1][1] <= 2_000


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    no_labels = spark.createDataFrame([], "doc_id bigint, label int")
    model = quality.fit(none, no_labels)
    assert model.probability(model.margin(quality.buckets("x"))) == 0.5
    assert quality.score(none, model).count() == 0
    one = quality.fit_rows([np.array([5], np.int32)] * 8, [1] * 8)
    assert one.probability(one.margin(quality.buckets("any"))) == pytest.approx(0.9)
    rows = made(60)
    docs, labels = frames(spark, [*rows, (None, "alone", 1), (1000, None, 1), (1001, "", 1)])
    labels = labels.unionByName(spark.createDataFrame([(2, None), (None, 0), (3, 7), (99_999, 1)], labels.schema))
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "same", 3), (1, "same", 4), (2, "w " * 300_000, 5)], "doc_id bigint, text string, _quality int")
    got = quality.score(odd, model).select("text", F.col("_quality.score").alias("s")).collect()
    assert len(got) == 5 and all(0 <= r["s"] <= 1 for r in got)
    assert got[0]["s"] == got[1]["s"] and got[2]["s"] == got[3]["s"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = op11_quality(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.99
