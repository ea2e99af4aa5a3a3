import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import closedloop, codecs, codes, learning, neighbours, sampling, studies, tiles
from cellgauge.sources import arrays
from cellgauge.sources.ranges import Ranges


def cells(spark, x, name="x"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(np.ravel(x))], "field_id string, idx bigint, v double")


def plain_features(x):
    """Neighbour features by a loop over the flat array."""
    dims, flat = x.shape, x.ravel()
    steps = arrays.strides(list(dims))
    look = lambda i: flat[i] if 0 <= i < len(flat) else None
    picked, near, lorenzo, spline = [], [], [], []
    for i in range(len(flat)):
        at, rest = [], i
        for s in steps:
            at.append(rest // s)
            rest %= s
        if any(a % 4 for a in at):
            continue
        v = flat[i]
        picked.append(v)
        around = [w for s in steps for o in (-s, s) if (w := look(i + o)) is not None]
        if around:
            near.append(abs(np.mean(around) - v))
        corner = [(look(i + o), sign) for o, sign in neighbours.lorenzo_offsets(list(dims)).items()]
        if all(c is not None for c, _ in corner):
            lorenzo.append(abs(sum(c * s for c, s in corner) / (2 ** len(dims) - 1) - v))
        for s in steps:
            w = [look(i + o) for o in (-3 * s, -s, s, 3 * s)]
            if None not in w:
                spline.append(abs((-w[0] + 9 * w[1] + 9 * w[2] - w[3]) / 16 - v))
    mean = lambda a: float(np.mean(a)) if a else None
    span = max(picked) - min(picked)
    return [span, mean(picked) - min(picked) if span else None, mean(near), mean(lorenzo), mean(spline)]


@pytest.mark.parametrize("shape", [(1,), (3,), (40,), (9, 13), (40, 7), (9, 6, 10), (4, 4, 4)])
@pytest.mark.parametrize("chunk", [16, 1 << 17])
def test_neighbour_features(spark, shape, chunk, monkeypatch):
    monkeypatch.setattr(neighbours.with_neighbours, "__defaults__", (chunk,))
    x = np.random.default_rng(len(shape)).normal(size=shape)
    got = neighbours.neighbour_features(cells(spark, x), list(shape)).first()
    for a, b in zip(list(got)[1:], plain_features(x), strict=True):
        assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9)


def test_constant_field_has_null_mean(spark):
    r = neighbours.neighbour_features(cells(spark, np.ones(64)), [0]).first()
    assert r["value_range"] == 0 and r["mean_value"] is None and r["mean_neighbor_difference"] == 0
    assert neighbours.non_constant_share(cells(spark, np.ones(64)), [0]).first()[1] == 0.5


def test_lorenzo_codes_rebuild_the_field(spark):
    x = np.random.default_rng(0).normal(size=(12, 9)).cumsum(axis=1)
    c = codes.lorenzo_codes(cells(spark, x), [0, 9], 0.05)
    code = np.zeros(x.size, dtype=int)
    for r in c.collect():
        code[r["idx"]] = r["code"]
    q = code.reshape(x.shape).cumsum(axis=0).cumsum(axis=1)
    assert np.abs(q * 0.1 - x).max() <= 0.05 + 1e-9


def test_bit_model_by_hand(spark):
    h = spark.createDataFrame([("a", 0, 60), ("a", 1, 20), ("a", -2, 20)], "field_id string, code bigint, freq bigint")
    b = 0.6 * 1 + 2 * 0.2 * -math.log2(0.2)
    r = codes.corrected_ratio(h).first()
    p0 = 0.6 / b
    assert r["mean_bits"] == pytest.approx(b) and r["p0"] == pytest.approx(p0)
    assert r["ratio"] == pytest.approx(32 * max(1, 1 / (0.4 * p0 + 1 - p0)) / b)
    one = codes.code_bits(spark.createDataFrame([("a", 5, 9)], "field_id string, code bigint, freq bigint")).first()
    assert one["mean_bits"] == 4.0


def test_closed_loop_keeps_the_bound():
    x = np.random.default_rng(1).normal(size=300).cumsum()
    guess = 0.0
    for v in x:
        code, back = closedloop.quantise_step(float(v), guess, 0.01)
        assert code == 0 and back == v or abs(back - v) <= 0.01
        guess = back
    hist = closedloop.lorenzo_scan(x.reshape(20, 15), 0.01)
    assert sum(hist.values()) == 300
    for n in range(1, 12):
        y = np.arange(n, dtype=float)
        assert all(closedloop._line_guess(y, i) == pytest.approx(i) for i in range(1, n, 2) if n > 2)
    assert sum(closedloop.interpolation_codes(np.zeros((8, 8)), 0.1, stride=1).values()) > 0


def test_codecs_keep_their_bound():
    x = np.random.default_rng(2).normal(size=500).cumsum()
    for name, run in codecs.CODECS.items():
        size, back = run(x, 0.05)
        assert size > 0 and np.abs(back - x).max() <= 0.05 + 1e-9, name
        assert run(np.empty(0), 0.05)[0] >= 0


def test_huffman_round_trip():
    s = np.random.default_rng(3).geometric(0.4, 400).tolist()
    assert codecs.huffman_decode(*codecs.huffman_encode(s)) == s
    assert codecs.huffman_decode(*codecs.huffman_encode([7] * 5)) == [7] * 5
    assert codecs.huffman_encode([])[2] == 0


def test_sampling(spark):
    assert sampling.block_positions([400], 0.1) == [[0, 40, 80, 120, 160, 200, 240, 280, 320, 360]]
    assert sampling.block_positions([40, 40], 0.25) == [[0, 8, 20, 28, 36]] * 2
    assert sampling.block_positions([8, 8], 0.3)[0] == [0]
    t = sampling.sampled_tiles(cells(spark, np.arange(64 * 48)), [0, 48], n=5).collect()
    assert len(t) == 5 and all(len(r["values"]) == 256 for r in t)
    with pytest.raises(ValueError):
        sampling.sampled_tiles(cells(spark, np.arange(4)), [1, 1, 2, 2])


def test_raw_reader(spark, tmp_path):
    x = np.arange(24, dtype="<f4")
    (tmp_path / "CLOUDf01.bin").write_bytes(x.tobytes())
    got = arrays.read_raw(spark, str(tmp_path), [4, 6], "float32", r"/([A-Z]+)f(\d+)\.bin", ("field", "step")).first()
    assert (got["field"], got["step"], got["dims"], got["values"]) == ("CLOUD", "01", [4, 6], x.tolist())
    arrays.append_csv(spark.createDataFrame([(0, 1.5, 2.5)]), str(tmp_path / "c"))
    assert arrays.read_csv(spark, str(tmp_path / "c"), ["a", "b"], drop=1).collect() == [(1.5, 2.5)]
    assert arrays.gaussian_field((16, 16), 3.0, 1).std() > 0.5
    with pytest.raises(KeyError):
        arrays.read_fields(spark, "nowhere")


def test_dense_index(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BUCKET_ROWS", 7)
    keys = sorted({i * i % 1009 for i in range(200)})
    got = {r["k"]: r["idx"] for r in arrays.dense_index(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k").collect()}
    assert [got[k] for k in keys] == list(range(len(keys)))


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (2, 5), (23, 10), (40, 7), (9, 9)])
def test_folds(spark, n, k):
    got = [r["fold"] for r in learning.with_folds(spark.range(n).withColumnRenamed("id", "idx"), k).orderBy("idx").collect()]
    want = [f for f in range(k) for _ in range(n // k + (f < n % k))]
    assert got == want
    with pytest.raises(ValueError):
        learning.with_folds(spark.range(3).withColumnRenamed("id", "idx"), 0)


def test_median_error_and_predictors(spark):
    train, test = [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], [(2.0, 3.0), (3.0, 4.0), (4.0, 5.0)]
    rows = spark.createDataFrame([(f, i, x, y) for f, part in enumerate((test, train)) for i, (x, y) in enumerate(part)], "fold int, idx bigint, x double, y double")
    program = "def fit(features, labels):\n    return (labels - features[:, 0]).max()\ndef predict(features, state):\n    return features[:, 0] + state\n"
    for p in (learning.Offset(), learning.UserProgram(program, ["x"])):
        got = learning.cross_validate(rows, p, ["x"], "y", 2)
        assert sorted(r["predicted"] for r in got.where("fold = 0").collect()) == [3, 4, 5]
        assert learning.median_ape(got, ["fold"]).where("medape <> 0").count() == 0
    assert sorted(r["predicted"] for r in learning.offset_folds(rows, "x", "y").where("fold = 0").collect()) == [3, 4, 5]
    assert learning.cross_validate(rows, learning.Noop(), ["x"], "y", 2).where("predicted <> actual - 1").count() == 0
    for values in ([], [1.0], [1.0, 2.0], [4.0, 1.0, 3.0, 2.0, 9.0, 7.0]):
        df = spark.createDataFrame([(0, 1.0, 1.0 + v) for v in values], "fold int, actual double, predicted double")
        over = learning.median_ape(df, []).first()
        assert over["n"] == len(values) and over["medape"] == (pytest.approx(np.median(values)) if values else None)
        if values:
            assert learning.median_ape(df, ["fold"]).first()["medape"] == pytest.approx(np.median(values))
    upper = spark.createDataFrame([(0, 1.0, 1.0 + v) for v in (1, 2, 3, 4)], "fold int, actual double, predicted double")
    assert learning.median_ape(upper, ["fold"], rule="upper").first()["medape"] == 3.5
    with pytest.raises(Exception, match="no number"):
        learning.matrix(spark.createDataFrame([(1, "x")], "k int, a string"), ["a"], ["k"]).collect()


def test_tiles_by_loop(spark):
    x = np.random.default_rng(4).normal(size=(12, 8))
    x[:4, :4] = 1.0
    t = tiles.tiles(cells(spark, x), 8, 4)
    assert t.count() == 5
    s = tiles.spatial_statistics(t).first()
    where = [(r, c) for r in range(3) for c in range(2) if (r, c) != (0, 0)]
    v = {p: x[p[0] * 4 : p[0] * 4 + 4, p[1] * 4 : p[1] * 4 + 4].ravel() for p in where}
    sv, sc, hi, lo = [], [], [], []
    for p in where:
        w = np.array([abs(p[0] - q[0]) + abs(p[1] - q[1]) for q in where if q != p], float)
        d = np.array([np.linalg.norm(v[p] - v[q]) for q in where if q != p])
        r = np.abs([np.corrcoef(v[p], v[q])[0, 1] for q in where if q != p])
        sv.append(np.sqrt(w * d).sum() / np.sqrt(w).sum())
        sc.append((np.sqrt(w) * r).sum() / np.sqrt(w).sum())
        hi.append(r.max())
        lo.append(r.min())
    intra = np.array([2 * v[p].var(ddof=1) for p in where])
    assert s["spatial_variation"] == pytest.approx(-(intra * sv).sum() * math.log(1 / 5) / 5)
    assert s["correlation_weighted"] == pytest.approx((np.array(sc) / intra).sum() / (1 / intra).sum())
    assert s["correlation_minmax"] == pytest.approx(min(hi)) and s["correlation_min"] == pytest.approx(min(lo))
    g = tiles.coding_gain(t).first()
    m = sum(np.outer(a, a) for a in v.values()) / 5
    sing = np.linalg.svd(m, compute_uv=False)
    assert g["svd_trunc"] == pytest.approx(100 * (np.argmax(sing.cumsum() / sing.sum() >= 0.99) + 1) / 16)


def test_studies(spark):
    assert studies.list_schedule([3, 3, 2, 2, 2], 2) == 7
    assert studies.list_schedule([], 3) == 0
    needs = {"a": {frozenset("x"), frozenset("yz")}, "b": {frozenset("z")}}
    assert studies.smallest_cover(needs, list("xyz")) == ["x", "z"]
    m = studies.misranking(spark.createDataFrame([(0.1, 0.1, 0.0)], "d double, sigma double, sigma_e double")).first()
    assert m["change"] == 0 and m["without_error"] == pytest.approx(0.2397500610934768)
    assert studies.noisy_search([0.0])[0][1] < 1e-3


def test_mahalanobis(spark):
    draw = np.random.default_rng(5)
    a, b = draw.normal(size=(50, 2)), draw.normal(size=(60, 2)) + 3
    rows = spark.createDataFrame([("a", *map(float, r)) for r in a] + [("b", *map(float, r)) for r in b], "g string, x double, y double")
    got = {(r["a"], r["b"]): r["distance"] for r in learning.mahalanobis_between(rows, "g", ["x", "y"]).collect()}

    def one(p, q):
        e = p - q.mean(axis=0)
        return np.einsum("ij,jk,ik->i", e, np.linalg.inv(np.cov(q.T)), e).mean()

    assert got["a", "b"] == pytest.approx((one(a, b) + one(b, a)) / 2)


@pytest.mark.parametrize("kind", ["spread", "clumped", "hot", "null", "tiny"])
def test_dense_index_with_null_hot_and_clumped_keys(spark, monkeypatch, kind):
    """Every row is numbered once, from 0, nulls first and keys rising, whatever the keys; no bucket is large."""
    monkeypatch.setattr(arrays, "BUCKET_ROWS", 40)
    keys = {"spread": [7 * i for i in range(1000)], "clumped": [i for i in range(900)] + [10**12 + i for i in range(100)], "hot": [5] * 600 + list(range(400)), "null": [None] * 500 + list(range(500)), "tiny": [None, 3, None]}[kind]
    df = spark.createDataFrame([(k, i, "ab"[i % 2]) for i, k in enumerate(keys)], "k bigint, row int, g string").repartition(3)
    got = sorted(((r["idx"], r["k"], r["row"]) for r in arrays.dense_index(df, "k").collect()), key=lambda r: r[0])
    assert [r[0] for r in got] == list(range(len(keys)))
    assert [r[1] for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert len({r[2] for r in got}) == len(keys)
    by = arrays.dense_index(df, "k", by=["g"]).collect()
    for g in "ab":
        mine = sorted((r for r in by if r["g"] == g), key=lambda r: r["idx"])
        assert [r["idx"] for r in mine] == list(range(len(mine)))
        assert [r["k"] for r in mine] == sorted((r["k"] for r in mine), key=lambda k: (k is not None, k or 0))
    tied = df.withColumn("t", F.xxhash64("k", "row"))
    largest = tied.groupBy(Ranges(tied, "k", 40).bucket("k", "t").alias("b")).count().agg(F.max("count")).first()[0]
    assert largest <= 160
    with pytest.raises(TypeError):
        arrays.dense_index(df, "g")


def test_a_row_is_searched_for_once_among_many_segments(spark):
    df = spark.range(4000).withColumn("t", F.xxhash64("id"))
    plan = df.select(Ranges(df, "id", 100).bucket("id", "t").alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") + plan.count("aggregate(") == 1


def test_blocks_of_tiles_change_no_sum(spark):
    x = np.random.default_rng(8).normal(size=(40, 30))
    t = tiles.tiles(cells(spark, x).unionByName(cells(spark, x[:8] * 2, "y")), 30, 5)
    one, many = (sorted(map(tuple, tiles.pair_sums(t, block).collect())) for block in (1000, 7))
    assert [r[:3] for r in one] == [r[:3] for r in many] and len(one) == 48 + 6
    assert np.allclose([r[3:] for r in one], [r[3:] for r in many])
    assert all(r[4] == (47 if r[0] == "x" else 5) for r in one)


def test_tiles_move_a_fixed_number_of_times(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(120, 20))
    t = tiles.tiles(cells(spark, x), 20, 2)
    whole = sorted(map(tuple, tiles.pair_sums(t, 1000).collect()))
    monkeypatch.setattr(tiles, "TILE_BLOCKS", 3)
    monkeypatch.setattr(tiles, "TILE_BLOCK", 10)
    seen, work = spark.sparkContext.accumulator(0), tiles._block_sums

    def counted(f):
        seen.add(len(f))
        return work(f)

    monkeypatch.setattr(tiles, "_block_sums", counted)
    monkeypatch.setattr(tiles, "PIECE", 64)
    got = sorted(map(tuple, tiles.pair_sums(t).collect()))
    assert seen.value == 3 * 600 and len(got) == 600
    assert [r[:3] for r in got] == [r[:3] for r in whole] and np.allclose([r[3:] for r in got], [r[3:] for r in whole])
    monkeypatch.setattr(tiles, "BLOCK_CELLS", 300)
    seen.value = 0
    got = sorted(map(tuple, tiles.pair_sums(t).collect()))
    assert seen.value == 8 * 600 and np.allclose([r[3:] for r in got], [r[3:] for r in whole])


@pytest.mark.parametrize("block", [1000, 7, None])
def test_totals_of_pairs_are_the_tiles_sums(spark, monkeypatch, block):
    monkeypatch.setattr(tiles, "PIECE", 5)
    monkeypatch.setattr(tiles, "TILE_BLOCK", 10)
    x = np.random.default_rng(12).normal(size=(40, 30))
    t = tiles.tiles(cells(spark, x).unionByName(cells(spark, x[:8] * 2, "y")).unionByName(cells(spark, x[:5, :5], "single")), 30, 5)
    got = {r["field_id"]: r for r in tiles.pair_totals(t, block).collect()}
    assert set(got) == {"x", "y"}  # a tile alone has no pair
    for name, rows in {k: [r for r in t.collect() if r["field_id"] == k] for k in got}.items():
        pairs = [(a, b) for a in rows for b in rows if a is not b]
        v = [(np.array(a["values"]), np.array(b["values"])) for a, b in pairs]
        assert got[name]["n"] == len(pairs)
        assert got[name]["w"] == sum(abs(a["tr"] - b["tr"]) + abs(a["tc"] - b["tc"]) for a, b in pairs)
        assert got[name]["d"] == pytest.approx(sum(np.linalg.norm(a - b) for a, b in v))
        assert got[name]["r"] == pytest.approx(sum(abs(np.corrcoef(a, b)[0, 1]) for a, b in v))


def test_totals_of_pairs_move_a_row_for_two_blocks_and_are_exact(spark, monkeypatch):
    from cellgauge import queries

    far = 2**57 // 40 + 3
    places = [(0, 0), (1, 0), (far, 3), (far + 2, 1), (5, 4), (far - 7, 2), (11, 0), (13, 1), (2 * far + 1, 0), (far, 0)]
    draw = np.random.default_rng(13)
    t = spark.createDataFrame([("ord2d", a, b, [float(x) for x in draw.normal(size=4)], 1.0, 1.0) for a, b in places], "field_id string, tr bigint, tc bigint, values array<double>, intra double, mean_square double")
    exact = sum(abs(a - c) + abs(b - d) for a, b in places for c, d in places)
    assert exact > 2**53 and exact != int(float(exact))
    assert [r["w"] for r in tiles.pair_totals(t, 3).collect()] == [exact]
    moved = spark.sparkContext.accumulator(0)

    def counted(work):
        def f(part):
            out = work(part)
            moved.add(len(out))
            return out

        return f

    for name in ("_block_sums", "_block_totals"):
        monkeypatch.setattr(tiles, name, counted(getattr(tiles, name)))
    monkeypatch.setattr(tiles, "TILE_BLOCK", 5)  # two blocks: three meetings
    monkeypatch.setattr(queries.tiles, "tiles", lambda *a, **b: t)
    row = queries.QUERIES["tile_pairs"](spark, "/root/testdata/sf0.001").first()
    assert row["n_pairs"] == 90 and row["sum_w"] == float(exact)
    assert moved.value <= 3


def test_codes_beyond_four_bytes_are_kept():
    x = np.array([1e7, -3.5, 1e7 + 0.25, 0.0])
    for name in ("quant_zlib", "quant_zstd"):
        assert np.abs(codecs.CODECS[name](x, 1e-3)[1] - x).max() <= 1e-3 + 1e-6


def test_every_hundredth_code_of_a_scan(spark):
    packed = arrays.from_values(spark, "a", np.arange(250.0)).unionByName(arrays.from_values(spark, "b", np.arange(64.0)))
    assert sum(r["freq"] for r in closedloop.scan_histograms(packed, 0.01).collect()) == 2
