import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import bytecodes, codes, neighbours, tiles
from cellgauge.plans import store
from cellgauge.sources import arrays

CELLS = "field_id string, idx bigint, v double"


def test_refined_ratio_is_the_published_sum(spark):
    draw = np.random.default_rng(0)
    fields = {"even": draw.integers(-9, 9, 400), "peaked": np.where(draw.random(400) < 0.8, 0, draw.integers(-4, 4, 400)), "flat": np.zeros(50, int)}
    hist = codes.histogram(spark.createDataFrame([(f, int(c)) for f, v in fields.items() for c in v], "field_id string, code bigint"))
    got = {r["field_id"]: r for r in codes.refined_ratio(hist).collect()}
    for name, v in fields.items():
        n = len(v)
        freq = {int(c): int((v == c).sum()) for c in np.unique(v)}
        length = {c: (b if (b := -math.log2(m / n)) >= 1 else {0: 1, 1: 2.5}.get(abs(c), 4)) for c, m in freq.items()}
        bits = sum(m / n * length[c] for c, m in freq.items())
        f0 = freq.get(0, 0) / n
        p0 = (f0 if freq.get(0, 0) > n // 2 else -f0 * math.log2(f0) if f0 else 0) / bits
        top = [c for c, _ in sorted(freq.items(), key=lambda x: (-x[1], x[0]))[:5] if c]
        share = {c: -freq[c] / n * math.log2(freq[c] / n) / bits for c in top}
        left = (1 - f0) * p0 + sum((1 - freq[c] / n) * share[c] for c in top) + 1 - p0 - sum(share.values())
        assert got[name]["refined_ratio"] == (pytest.approx(32 / bits / left) if left > 1e-12 else None)
        assert got[name]["lossless_ratio"] >= 32 / bits - 1e-9


def test_arrays_that_features_cannot_take_are_errors(spark):
    for row, said in (((None, [2], "float64"), "has no data"), (([1.0], [1], "int32"), "precision"), (([1.0], [1, 1, 1, 1], "float32"), "1, 2 or 3"), (([1.0], [], "float32"), "1, 2 or 3")):
        df = spark.createDataFrame([("bad", row[1], row[2], row[0])], arrays.PACKED)
        with pytest.raises(Exception, match=said):
            neighbours.checked(df).collect()
    good = spark.createDataFrame([("a", [2], "float32", [1.0, 2.0])], arrays.PACKED)
    assert neighbours.checked(good).collect() == good.collect()
    with pytest.raises(ValueError, match="1 to 3"):
        neighbours.neighbour_features(arrays.unpack(good), [1, 1, 1, 2])


def test_degenerate_fields_are_left_out(spark):
    draw = np.random.default_rng(1)
    fields = {"good": draw.normal(size=16), "few": draw.normal(size=8), "still": np.full(16, 2.0), "nan": np.where(np.arange(16) == 3, np.nan, draw.normal(size=16)), "line": draw.normal(size=16)}
    rows = [(f, i * 4 if f == "line" else i, float(x)) for f, v in fields.items() for i, x in enumerate(v)] + [("hole", i, None if i == 5 else float(i)) for i in range(16)]
    df = spark.createDataFrame(rows, CELLS)
    assert [r["field_id"] for r in tiles.usable_fields(df, [0, 4]).collect()] == ["good"]
    assert tiles.usable_fields(df, [16]).count() == 0


def test_columns_and_dicts_have_one_canonical_form(spark):
    rows = [{"size": 3, "brand": 'a"b', "é": 1.5}, {"size": -1, "brand": "", "é": 0.25}]
    df = spark.createDataFrame([(r["size"], r["é"], r["brand"]) for r in rows], "size int, `é` double, brand string")
    for names in (["size", "brand", "é"], ["é", "size", "brand"]):
        got = [json.loads(r[0]) for r in df.select(store.canonical_column(names)).collect()]
        assert got == rows and all(list(g) == sorted(g) for g in got)
    assert df.select(F.sha2(store.canonical_column(["size", "brand"]), 256)).first()[0] == spark.createDataFrame([(store.canonical_json({"brand": 'a"b', "size": 3}),)], "c string").select(F.sha2("c", 256)).first()[0]


def test_pairs_of_bytes_add_up_however_texts_are_cut(spark, monkeypatch):
    texts = [None, "", "a", "aba", "é" * 40, "xyz " * 300]
    rows = [(k % 3 if k % 4 else None, t) for k, t in enumerate(texts * 30)]
    df = spark.createDataFrame(rows, "g int, text string").repartition(3)
    want = {}
    for g, t in rows:
        b = [bytecodes.MARK, *(t or "").encode(), bytecodes.MARK]
        for x, y in zip(b, b[1:], strict=False):
            want[g, x * bytecodes.SYMBOLS + y] = want.get((g, x * bytecodes.SYMBOLS + y), 0) + 1
    for piece, held in ((1 << 20, 64), (50, 64), (50, 1), (1 << 20, 2)):
        monkeypatch.setattr(bytecodes, "PIECE", piece)
        monkeypatch.setattr(bytecodes, "HELD_GROUPS", held)
        assert {(r["g"], r["code"]): r["freq"] for r in bytecodes.byte_pairs(df, "text", ["g"]).collect()} == want
    whole = bytecodes.text_ratios(bytecodes.byte_pairs(df, "text", []), []).first()
    assert (whole["n_texts"], whole["n_bytes"]) == (len(rows), sum(len((t or "").encode()) for _, t in rows))
    none = bytecodes.byte_pairs(df.limit(0), "text", ["g"])
    assert none.count() == 0 and bytecodes.text_ratios(none, ["g"]).count() == 0
    same = bytecodes.text_ratios(bytecodes.byte_pairs(spark.createDataFrame([("",)], "text string"), "text", []), []).first()
    assert (same["n_texts"], same["n_bytes"], same["entropy_0"], same["ratio_0"]) == (1, 0, 0.0, None)
