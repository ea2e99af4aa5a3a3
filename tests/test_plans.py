import importlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.functions import scalar
from cellgauge.plans import catalog, collect, run, store
from cellgauge.sources import arrays
from cellgauge.streaming import ingest

#: The published cases.
ND, ED, EA, DA = "mock:nondeterministic", "mock:error_dependent", "mock_data:error_agnostic", "mock_data:data"
EXPECTED = {
    "all": ({ND, ED, EA, DA}, False),
    "all_training": ({ND, ED, EA, DA}, True),
    "training": ({ND}, False),
    "data": ({ND, DA}, False),
    "runtime": ({ND}, False),
    "dependent": ({ND, ED}, False),
    "agnostic": ({ND, EA}, False),
    "agnostic_runtime": ({ND, EA}, False),
}


def test_invalidation(spark):
    m = catalog.invalidation(catalog.MOCK, spark, catalog.MOCK_CASES)
    got: dict = {}
    for r in m.where("invalid").collect():
        got.setdefault(r["case"], {"feature": set(), "label": set()})[r["usage"]].add(r["metric"])
    assert {c: (v["feature"], bool(v["label"])) for c, v in got.items()} == EXPECTED
    ids = {(r["case"], r["usage"]): r for r in catalog.ids(m).collect()}
    assert ids["data", "feature"]["all"] == [ND, ED, EA, DA]
    assert ids["data", "feature"]["valid"] == sorted([ED, EA])
    assert catalog.uses_real_codec(catalog.MOCK, {catalog.TRAINING}) and not catalog.uses_real_codec(catalog.MOCK, {catalog.DATA})
    assert catalog.requirements(m, True).where("compress and decompress and training").count() == 8


def test_undeclared_class_holds_all_settings():
    s = catalog.Scheme("s", (), {catalog.RUNTIME: ("a",)}, ("a", "b"))
    assert set(s.classes({"b"})) == {catalog.NONDETERMINISTIC, catalog.DEPENDENT, catalog.AGNOSTIC, "b"}


def test_fresh_over_cached(spark):
    fresh = spark.createDataFrame([("x", "1.5"), ("y", None)], "field_id string, m string")
    cached = spark.createDataFrame([("x", "9"), ("y", "2")], "field_id string, m string")
    assert {r["field_id"]: r["m"] for r in catalog.fresh_or_cached(fresh, cached, ["m"]).collect()} == {"x": 1.5, "y": 2.0}
    with pytest.raises(Exception, match="no value of m"):
        catalog.fresh_or_cached(fresh, cached.where("field_id = 'x'"), ["m"]).collect()


@pytest.mark.parametrize("kept", [False, True])
def test_store(spark, tmp_path, kept):
    s = store.ResultStore(spark, str(tmp_path / "s") if kept else None)
    a = s.upsert_configs("datasets", [{"b": 1, "a": [2]}, {"a": [2], "b": 1}, {"c": None}]).collect()
    assert len(a) == 2 and {json.loads(r["config"]).get("b") for r in a} == {1, None}
    assert {r["id"] for r in s.upsert_configs("datasets", [{"c": None}]).collect()} <= {r["id"] for r in a}
    assert s.table("datasets").count() == 2
    fields = spark.createDataFrame([(0,), (1,)], "field bigint")
    grid = store.task_grid(fields, 2, experiment=1, compressor=1, dataset=1)
    assert grid.count() == s.todo(grid).count() == 4
    obs = grid.where("field = 1").withColumn("values", F.create_map(F.lit("m"), F.lit("2.5"), F.lit("text"), F.lit("x"), F.lit("none"), F.lit(None).cast("string")))
    s.upsert_results(obs)
    s.upsert_results(obs)
    assert s.todo(grid).count() == s.done(grid).count() == 2
    assert [r["values"] for r in s.load().collect()] == [{"m": 2.5}] * 2
    assert s.table("entries").count() == 2
    assert [r["m"] for r in s.wide(["m"]).collect()] == [2.5] * 2
    assert store.query_one(spark, "select :x + 1 as y", x=2)["y"] == 3
    with pytest.raises(ValueError):
        store.query_one(spark, "select 1 where false")


def test_run_and_score(spark):
    s = store.ResultStore(spark)
    packed = spark.createDataFrame([(str(i), [32], "float64", [float((i * k * k) % 97) for k in range(32)]) for i in range(12)], arrays.PACKED)
    first = run.run(spark, s, packed, "quant_zlib", 0.1, replicates=2)
    assert first.count() == 24
    assert run.run(spark, s, packed, "quant_zlib", 0.1, replicates=2).count() == 24
    assert run.score(first.where("replicate = 0"), "range", "size:ratio", k=3).count() == 3
    assert run.settings(["a=1", "a=2", "b==", "a=3"]) == {"a": ["1", "2", "3"], "b": "="}
    with pytest.raises(ValueError):
        run.settings(["a"])
    assert run.parser().parse_args(["-k", "5", "-R", "2"]).folds == 5


def test_run_options(spark, tmp_path):
    """Late options win, the loader is chosen, fields may have names, and errors are stored where decoding is asked for."""
    assert run.layered(["bound=1", "codec=noop"], ["bound=2"]) == {"bound": "2", "codec": "noop"}
    for name in ("a.raw", "b.raw"):
        (tmp_path / name).write_bytes(np.linspace(0, 1, 12, dtype="float32").tobytes())
    packed = run.load(spark, {"source": "raw", "path": str(tmp_path), "dims": "3,4"}, "")
    assert sorted(r["field_id"] for r in packed.collect()) == ["a.raw", "b.raw"]
    s = store.ResultStore(spark)
    assert "error_stat:max_error" not in run.run(spark, s, packed, "quant_zlib", 0.1).first()["values"]
    rows = [r["values"] for r in run.run(spark, s, packed, "quant_zlib", 0.1, decompress=True).collect()]
    assert len(rows) == 4 and sum(v.get("error_stat:max_error", 9) <= 0.1 + 1e-9 for v in rows) == 2
    for bad in ({"source": "emb2d"}, {"source": "nothing"}, {"source": "grid100", "dtype": "x"}):
        with pytest.raises(ValueError):
            run.load(spark, bad, "/root/testdata/sf0.001")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a=b=c", 1.0, 0.0)], "s string, x double, z double")
    r = df.select(scalar.split_setting(F.col("s")).alias("p"), scalar.rescale(F.col("x"), 0, 2, 10, 20).alias("r"), scalar.rescale(F.col("x"), 1, 1, 0, 1).alias("n"), scalar.absolute_percentage_error(F.col("z"), F.col("x")).alias("e"), scalar.first_number(F.lit("x"), F.lit("7")).alias("f")).first()
    assert (r["p"]["key"], r["p"]["value"], r["r"], r["n"], r["e"], r["f"]) == ("a", "b=c", 15.0, None, 0.0, 7.0)
    with pytest.raises(Exception, match="no ="):
        df.select(scalar.split_setting(F.lit("x"))).collect()


def test_stream_feeds_the_store_once(spark, tmp_path):
    schema = "experiment bigint, compressor bigint, dataset bigint, field bigint, replicate bigint, values map<string,string>"
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 1, i, 0, {"m": str(i)}) for i in range(5)], schema).write.parquet(src)
    s = store.ResultStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.feed(spark.readStream.schema(schema).parquet(src), s, str(tmp_path / "cp")).awaitTermination(120)
    assert s.load().count() == 5
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:00:00", "a", 5.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["mean_value"] for r in ingest.windowed_statistics(events).collect()) == [2.0, 5.0]


def test_timer():
    t = store.timed(lambda: None, warmup=1, repeat=3)
    assert 0 <= t["min"] <= t["mean"] <= t["max"]


def test_entry_lists_every_query():
    e = importlib.import_module("__spark_entry__")
    names = set(e.queries())
    assert len(names) >= 99 and set(e.oracle_sql()) <= names


def test_causes_of_the_schemes():
    causes = {n: s.metrics[0].causes for n, s in catalog.SCHEMES.items()}
    every = (catalog.DEPENDENT, catalog.AGNOSTIC, catalog.DATA)
    assert causes == {"sampled_tiles": every, "lorenzo_bits": every, "interpolation_bits": (catalog.DEPENDENT,), "sampled_blocks": (catalog.DEPENDENT,), "neighbours": (catalog.DEPENDENT,)}


def test_only_invalid_modules_run(spark):
    """For each change the modules that run, and values fresh or cached; the real codec only where labels are wanted."""
    packed = spark.createDataFrame([(str(i), [32], "float64", [float((i * k * k) % 97) for k in range(32)]) for i in range(4)], arrays.PACKED)
    s, settings = collect.CODES, {"bound": 0.5, "codec": "quant_zlib"}
    full = collect.collect(s, {catalog.ALL, catalog.TRAINING}, packed, settings)
    assert full.ran == ["range", "entropy", "size"]
    cached = packed.select("field_id", *[F.lit(-1.0).alias(m.metric) for m in s.metrics])
    for changes, ran in (({"bound"}, ["entropy"]), ({"level"}, []), ({catalog.DATA}, ["range", "entropy"]), ({"bound", catalog.TRAINING}, ["entropy", "size"]), ({"bound", catalog.LABELS}, ["entropy", "size"]), ({catalog.TRAINING}, ["size"])):
        got = collect.collect(s, changes, packed, settings, cached)
        assert sorted(got.ran) == sorted(ran), changes
        want = {r["field_id"]: r.asDict() for r in full.table.collect()}
        for r in got.table.collect():
            for m in s.metrics:
                assert r[m.metric] == (want[r["field_id"]][m.metric] if m.module in ran else -1.0)
    assert collect.labels(s, full).columns == ["field_id", "size:ratio"] and collect.features(s, full).columns == ["field_id", "range:value_range", "entropy:entropy"]
    without = collect.collect(s, {catalog.ALL}, packed, settings)
    assert "size" not in without.ran and "size:ratio" not in without.table.columns
    with pytest.raises(Exception, match="no value of range:value_range"):
        collect.collect(s, {"bound"}, packed, settings).table.collect()
    for name in ("neighbours", "lorenzo_bits", "interpolation_bits"):
        assert collect.collect(catalog.SCHEMES[name], {catalog.ALL}, packed, settings).table.count() == 4
