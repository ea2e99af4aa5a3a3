import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from cellgauge.operators import blockcodec, closedloop, codecs, codes, huffman, interpolation, sampling, wavefront
from cellgauge.sources import arrays

CELLS = "field_id string, idx bigint, v double"


def cells(spark, x, name="x"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(np.ravel(x))], CELLS)


# --- transform codec ---


@settings(max_examples=60, deadline=None)
@given(d=st.integers(1, 3), data=st.data(), bound=st.sampled_from([0.0, 1e-12, 1e-3, 0.5, 1e4]))
def test_every_value_comes_back_within_the_bound(d, data, bound):
    x = data.draw(hnp.arrays(np.float64, (3, 4**d), elements=st.floats(-1e12, 1e12) | st.sampled_from([0.0, np.nan, np.inf, 5e-324, 1.7e308])))
    back = blockcodec.decode(blockcodec.encode(x, d, bound), d)
    for a, b in zip(x, back, strict=True):
        if np.isfinite(a).all():
            assert np.abs(a - b).max() <= bound
        else:
            assert np.array_equal(a, b, equal_nan=True)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_the_transform_is_reversible_and_finds_ramps(d):
    q = np.random.default_rng(d).integers(-(1 << 50), 1 << 50, (200, 4**d))
    assert (blockcodec.inverse(blockcodec.forward(q, d), d) == q).all()
    ramp = np.indices([4] * d).sum(axis=0).reshape(1, -1) * 8
    assert np.count_nonzero(blockcodec.forward(ramp, d)) == 1 + d


def test_smooth_blocks_take_fewer_bytes():
    noise = np.random.default_rng(0).normal(size=(500, 16))
    ramp = np.indices((4, 4)).sum(axis=0).reshape(1, -1) * np.linspace(0.1, 1, 500)[:, None]
    size = lambda x: sum(map(len, blockcodec.encode(x, 2, 1e-3)))
    assert size(ramp) < size(noise) / 2 and size(np.zeros((500, 16))) == 500
    assert blockcodec.decode([], 2).shape == (0, 16) and blockcodec.encode(np.empty((0, 16)), 2, 1.0) == []


@pytest.mark.parametrize("dims", [[37], [9, 14], [5, 6, 7]])
def test_fields_are_coded_block_by_block(spark, dims):
    x = np.random.default_rng(len(dims)).normal(size=dims).cumsum(axis=0)
    df = cells(spark, x).where("idx % 11 <> 5").unionByName(spark.createDataFrame([("x", 5, None), ("y", 0, 1.0)], CELLS))
    rows = blockcodec.coded_blocks(df, dims, 0.01)
    got = rows.select("field_id", "block", F.posexplode("back").alias("k", "v")).where("field_id = 'x'")
    assert got.count() == x.size - len(range(5, x.size, 11)) and rows.agg(F.max("max_error")).first()[0] <= 0.01
    r = {r["field_id"]: r for r in blockcodec.transform_ratio(df, dims, 0.01).collect()}
    assert r["x"]["n_blocks"] == np.prod([-(-n // 4) for n in dims]) and r["y"]["n_blocks"] == 1 and 1 < r["x"]["ratio"] < 20
    assert blockcodec.transform_ratio(df.limit(0), dims, 0.01).count() == 0
    with pytest.raises(ValueError):
        blockcodec.coded_blocks(df, [2, 2, 2, 2], 0.01)


def test_sampled_blocks_tell_the_whole_fields_ratio(spark):
    i, j = np.indices((64, 64))
    df = cells(spark, np.sin(i / 9) + np.cos(j / 7))
    whole, part = (blockcodec.transform_ratio(c, [64, 64], 1e-3).first()["ratio"] for c in (df, sampling.sampled_blocks(df, [64, 64], 0.1)))
    assert part == pytest.approx(whole, rel=0.15)


# --- entropy coder ---


def plain_bits(freq):
    """The bits of a Huffman coding, by merging the two least until one is left."""
    f, total = sorted(freq), 0
    while len(f) > 1:
        a, b = f.pop(0), f.pop(0)
        total += a + b
        f = sorted([*f, a + b])
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 62), 1 << 62) | st.integers(-3, 3), max_size=300))
def test_bytes_come_back_as_the_same_codes(values):
    v = np.array(values, np.int64)
    symbols, freq = np.unique(v, return_counts=True)
    table = huffman.Table.of(symbols, freq)
    again = huffman.Table.from_bytes(table.to_bytes())
    data = table.write(v)
    assert again.read(data).tolist() == values
    bits = plain_bits(freq.tolist()) if len(freq) > 1 else len(values)
    assert len(data) == 8 + -(-bits // 8)


def test_lengths_are_limited_and_still_a_code():
    f = np.array([1, 1, *(1 << k for k in range(60))])
    n = huffman.limited_lengths(f)
    assert n.max() <= huffman.PEEK < huffman.code_lengths(f).max() and (2.0**-n).sum() <= 1
    v = np.repeat(np.arange(12), 2 ** np.arange(12))
    t = huffman.Table(np.arange(62), n)
    assert (t.read(t.write(v)) == v).all()


def test_chunks_share_their_fields_table(spark):
    draw = np.random.default_rng(5)
    made = {name: draw.geometric(p, n) * draw.choice([-1, 1], n) for name, p, n in (("a", 0.3, 700), ("b", 0.9, 64), ("c", 0.5, 1))}
    df = spark.createDataFrame([(f, i, int(c)) for f, v in made.items() for i, c in enumerate(v)], "field_id string, idx bigint, code bigint")
    chunks = huffman.coded_chunks(df, 100)
    back = huffman.read_chunks(chunks, 100)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for r in huffman.huffman_ratio(df, chunk=100).collect():
        v = made[r["field_id"]]
        assert (r["n"], r["n_chunks"]) == (len(v), -(-len(v) // 100)) and r["ratio"] == 8 * len(v) / (r["table_bytes"] + r["data_bytes"])
    assert huffman.huffman_ratio(df.limit(0)).count() == 0


# --- codecs and listeners ---


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@pytest.mark.parametrize("n", [0, 1, 3, 63, 64, 65, 1000])
def test_arrays_come_back_from_bytes_alone(name, n):
    x = np.random.default_rng(n).normal(size=n).cumsum() - 3
    codec = codecs.CODECS[name]
    data = codec.encode(x, 0.05)
    back = codec.decode(bytes(data), 0.05)
    assert isinstance(data, bytes) and len(back) == n and np.abs(back - x).max(initial=0) <= 0.05 + 1e-9


class Calls(codecs.Listener):
    """Counts what it is told."""

    def __init__(self):
        self.n = dict.fromkeys([*codecs.EVENTS, *(f"{e}_many" for e in codecs.EVENTS)], 0)

    def results(self):
        return {f"calls:{k}": v for k, v in self.n.items()}


def _counting(event):
    def told(self, *given):
        self.n[event] += 1

    return told


for _e in list(Calls().n):
    setattr(Calls, _e, _counting(_e))


def test_listeners_are_told_of_each_array_and_each_batch(spark):
    packed = arrays.from_values(spark, "a", np.arange(10.0)).unionByName(arrays.from_values(spark, "b", np.arange(5.0))).coalesce(1)
    got = {r["field_id"]: r["metrics"] for r in codecs.observed(packed, "quant_zlib", 0.1, [Calls(), codecs.Size(), codecs.ErrorStat(), codecs.Time()]).collect()}
    assert all(got["b"][f"calls:{e}"] == 2 for e in codecs.EVENTS) and all(got["a"][f"calls:{e}"] == 1 for e in codecs.EVENTS)
    assert got["a"]["calls:begin_compress_many"] == 1 and got["a"]["calls:end_compress_many"] == 0  # the batch ends after its arrays
    assert all(m["time:compress"] > 0 and m["time:decompress"] > 0 and m["error_stat:max_error"] <= 0.1 + 1e-9 for m in got.values())
    assert got["a"]["size:ratio"] == 80 / got["a"]["size:compressed_bytes"]
    alone = codecs.observed(packed, "quant_zlib", 0.1, [Calls(), codecs.ErrorStat()], decompress=False).where("field_id = 'a'").first()["metrics"]
    assert alone["calls:begin_decompress"] == 0 and alone["calls:end_compress"] == 1 and "error_stat:mse" not in alone


def test_composites_nest_and_repeats_are_timed():
    order = []

    class Named(codecs.Listener):
        def __init__(self, name):
            self.name = name

        def begin_compress(self, x):
            order.append(f"begin {self.name}")

        def end_compress(self, x, data):
            order.append(f"end {self.name}")

    told = codecs.Composite([Named("a"), codecs.Composite([Named("b"), Named("c")])])
    told.begin_compress(np.zeros(1))
    told.end_compress(np.zeros(1), b"")
    assert order == ["begin a", "begin b", "begin c", "end c", "end b", "end a"]
    calls = Calls()
    bench = codecs.Repeated(calls, replicates=5, warmups=2)
    bench.begin_compress(np.zeros(1))
    r = bench.results()
    assert r["calls:begin_compress"] == 7 and 0 <= r["bench:begin_compress:min"] <= r["bench:begin_compress:mean"] <= r["bench:begin_compress:max"] and "bench:end_compress:mean" not in r


@pytest.mark.parametrize("name", ["lorenzo_huffman", "transform"])
def test_codecs_hold_little_beside_a_long_array(name):
    x = np.random.default_rng(6).exponential(50, size=400_000).round(2)
    tracemalloc.start()
    try:
        size, back = codecs.CODECS[name](x, 0.001)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.abs(back - x).max() <= 0.001 + 1e-9 and size < x.nbytes
    assert peak < 13 * x.nbytes


def test_pieces_of_huffman_codes_make_the_same_bytes(monkeypatch):
    values = np.random.default_rng(7).geometric(0.02, size=5_000)
    table = huffman.Table.of(*np.unique(values, return_counts=True))
    whole = table.write(values)
    monkeypatch.setattr(huffman, "PIECE", 37)
    monkeypatch.setattr(huffman, "WINDOW", 64)
    assert table.write(values) == whole and (table.read(whole) == values).all()
    one = huffman.Table.of(np.array([5]), np.array([3]))
    assert one.read(one.write(np.full(200, 5))).tolist() == [5] * 200
    with pytest.raises(ValueError, match="codes end"):
        table.read(whole[:100])


# --- predictors on fields of any size ---


@pytest.mark.parametrize("dims", [[1], [2], [7], [64], [8, 8], [5, 13], [4, 6, 7], [11, 10, 10], [3, 4, 5, 4]])
@pytest.mark.parametrize("stride", [1, 5])
def test_interpolation_equals_the_scan_of_a_packed_field(spark, dims, stride):
    x = np.random.default_rng(sum(dims)).normal(size=dims).cumsum(axis=-1)
    want = closedloop.interpolation_codes(x, 0.01, stride=stride)
    for d in (dims, [0, *dims[1:]]):
        hist = codes.histogram(interpolation.finest_codes(cells(spark, x), d, 0.01, stride))
        assert {r["code"]: r["freq"] for r in hist.collect()} == want


@pytest.mark.parametrize("dims,block", [([50], [7]), ([50], [50]), ([9, 14], [4, 5]), ([1, 3], [2, 2]), ([6, 7, 5], [3, 3, 2])])
def test_waves_equal_the_scan_of_a_whole_field(spark, dims, block):
    draw = np.random.default_rng(sum(dims))
    fields = {"a": draw.normal(size=dims).cumsum(axis=-1), "b": draw.normal(size=dims) * 1e6}
    df = cells(spark, fields["a"], "a").unionByName(cells(spark, fields["b"], "b"))
    for every in (1, 3):
        got = wavefront.lorenzo_histograms(df, dims, 0.01, every, block)
        want = {(f, c, n) for f, x in fields.items() for c, n in closedloop.lorenzo_scan(x, 0.01, every).items()}
        assert set(map(tuple, got.collect())) == want


def test_a_narrow_field_is_cut_along_its_long_axis_alone(spark, tmp_path, monkeypatch):
    assert wavefront.block_sides([0, 10, 10]) == [10485, 10, 10] and wavefront.block_sides([0]) == [1 << 20] and wavefront.block_sides([0, 0]) == [1024, 1024]
    assert wavefront.block_sides([1, 3]) == [1, 3] and wavefront.block_sides([0, 2, 300], 128) == [8, 2, 8]
    folder = f"file://{tmp_path}/waves"
    monkeypatch.setattr(wavefront, "new_folder", lambda spark, name: folder)
    x = np.random.default_rng(12).normal(size=(300, 3, 2)).cumsum(axis=0)
    got = wavefront.lorenzo_histograms(cells(spark, x), [0, 3, 2], 0.01)
    assert {r["code"]: r["freq"] for r in got.collect()} == closedloop.lorenzo_scan(x, 0.01)
    assert spark.read.parquet(f"{folder}/blocks").count() == 1


def test_waves_of_odd_fields(spark):
    long, short = cells(spark, np.arange(30.0), "long"), cells(spark, [1.0, 5.0], "short")
    got = wavefront.lorenzo_histograms(long.unionByName(short), [0], 0.25, 1, [8])
    want = {(f, c, n) for f, x in (("long", np.arange(30.0)), ("short", np.array([1.0, 5.0]))) for c, n in closedloop.lorenzo_scan(x, 0.25).items()}
    assert set(map(tuple, got.collect())) == want
    assert wavefront.lorenzo_histograms(long.limit(0), [0], 0.1).count() == 0
    with pytest.raises(Exception, match="has holes"):
        wavefront.lorenzo_histograms(long.where("idx <> 3"), [0], 0.1).count()
    with pytest.raises(ValueError):
        wavefront.lorenzo_histograms(long, [2, 2, 2, 2], 0.1)
