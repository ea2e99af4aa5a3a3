import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import codecs
from cellgauge.plans import catalog, collect, run, store
from cellgauge.sources import arrays

SETTINGS = {"bound": 0.5, "codec": "quant_zlib", "dims": [64], "block_size": [16], "sample_ratio": 0.5}


def packed(spark, n=6, size=64):
    return spark.createDataFrame([(str(i), [size], "float64", [float((i * k * k) % 97 + k / 7) for k in range(size)]) for i in range(n)], arrays.PACKED)


@pytest.mark.parametrize("name", sorted(collect.SCHEMES))
def test_every_scheme_collects_all_that_it_names(spark, name):
    scheme = collect.SCHEMES[name]
    got = collect.collect(scheme, {catalog.ALL, catalog.TRAINING, catalog.LABELS}, packed(spark), SETTINGS)
    assert got.table.columns == ["field_id", *[m.metric for m in scheme.metrics]]
    rows = got.table.collect()
    assert len(rows) == 6 and all(r[m.metric] is not None and np.isfinite(r[m.metric]) for r in rows for m in scheme.metrics)


def test_a_wider_cache_adds_no_rows_and_no_errors(spark):
    few, scheme = packed(spark, 2), collect.CODES
    for columns in (["range:value_range", "entropy:entropy"], ["range:value_range"]):  # without the stale metric as well
        cached = packed(spark, 500, 2).select("field_id", *[F.lit(-1.0).alias(c) for c in columns])
        rows = collect.collect(scheme, {"bound"}, few, SETTINGS, cached).table.collect()
        assert sorted(r["field_id"] for r in rows) == ["0", "1"] and all(r["range:value_range"] == -1 and r["entropy:entropy"] >= 0 for r in rows)


def test_a_codec_runs_once_for_all_its_listeners(spark, monkeypatch):
    told = []
    monkeypatch.setattr(codecs, "observed", lambda df, codec, bound, listeners, **_: told.append([type(x).__name__ for x in listeners]) or df.withColumn("metrics", F.create_map(*[F.lit(x) for m in collect.CODEC_METRICS.values() for n in m for x in (n, 1.0)])))
    parts = collect.CODES.metrics + (catalog.Metric("time:compress", "time", "label", ()), catalog.Metric("error_stat:psnr", "error_stat", "label", ()))
    scheme = catalog.Scheme("all", parts, training_required=True)
    collect.collect(scheme, {catalog.ALL, catalog.TRAINING}, packed(spark), SETTINGS).table.collect()
    assert told == [["Size", "Time", "ErrorStat"]]


def test_qualified_names_lead_to_the_same_numbers(spark):
    plain, named = collect.CODES, collect.CODES.qualified("mine")
    assert named.metrics[1].metric == "/mine/entropy:entropy:entropy" and named.qualified("") == plain.qualified("")
    a, b = (collect.collect(s, {catalog.ALL, catalog.TRAINING}, packed(spark), SETTINGS).table.orderBy("field_id").collect() for s in (plain, named))
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and b[0].asDict().keys() == {"field_id", *(m.metric for m in named.metrics)}


def test_runs_are_resumed_and_valid_features_taken_from_the_run_before(spark, tmp_path, monkeypatch):
    s, scheme, arrays_ = store.ResultStore(spark, str(tmp_path / "s")), collect.CODES, packed(spark)
    first = run.run_scheme(spark, s, arrays_.where("field_id < 3"), scheme, {"bound": 0.5})
    assert first.count() == 3
    ran = []
    whole = collect.collect

    def watched(*given):
        ran.append(sorted(r["field_id"] for r in given[2].select("field_id").collect()))
        found = whole(*given)
        ran.append(found.ran)
        return found

    monkeypatch.setattr(collect, "collect", watched)
    assert run.run_scheme(spark, s, arrays_, scheme, {"bound": 0.5}, replicates=2).count() == 12
    # Fields 0 to 2 lack their second replicate alone.
    assert ran == [["0", "1", "2", "3", "4", "5"], ["range", "entropy", "size"]]
    ran.clear()
    again = run.run_scheme(spark, s, arrays_, scheme, {"bound": 0.25}, previous={"bound": 0.5})
    assert ran[1] == ["entropy", "size"] and again.count() == 6
    fresh = {r["field"]: r["values"] for r in run.run_scheme(spark, store.ResultStore(spark), arrays_, scheme, {"bound": 0.25}).collect()}
    assert {r["field"]: r["values"] for r in again.collect()} == fresh
    with pytest.raises(Exception, match="no value of range:value_range"):
        run.run_scheme(spark, s, packed(spark, 8), scheme, {"bound": 0.125}, previous={"bound": 0.5})


def test_times_are_labels_of_a_run(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "s"))
    results = run.run_scheme(spark, s, packed(spark, 12), collect.TIMING, {"bound": 0.5})
    assert results.where(F.col("values")["time:compress"] > 0).where(F.col("values")["time:decompress"] > 0).count() == 12
    assert run.score_scheme(results, collect.TIMING, 3).count() == 3
    assert run.score_scheme(results, collect.TIMING, 3, "time:decompress").where("medape is not null").count() == 3


def test_a_scheme_without_training_predicts_its_feature(spark):
    results = run.run_scheme(spark, store.ResultStore(spark), packed(spark), collect.SCHEMES["sampled_tiles"], SETTINGS)
    got = run.score_scheme(results, collect.SCHEMES["sampled_tiles"], 2)
    assert got.count() == 2 and got.where("medape >= 0").count() == 2


def test_options_become_numbers_and_lists():
    assert run.typed({"bound": "1", "seed": "3", "sample_ratio": "0.5", "codec": "noop", "dims": ["4", "5"], "block_size": "16"}) == {"bound": 1.0, "seed": 3, "sample_ratio": 0.5, "codec": "noop", "dims": [4, 5], "block_size": [16]}
    assert isinstance(run.typed({"bound": "1"})["bound"], float)
    assert run.parser().parse_args(["--scheme", "codes", "-Q"]).qualified


def test_command_line_runs_and_scores_a_scheme(spark, tmp_path, capsys):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    run.main(["-a", "run", "score", "--scheme", "codes", "-o", "bound=0.5", "-k", "5", "-Q", "--store", str(tmp_path / "s")])
    out = capsys.readouterr().out
    assert "medape" in out


def test_plugins_register_what_a_run_uses(spark, tmp_path, monkeypatch, capsys):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    (tmp_path / "own_scheme.py").write_text(
        "from pyspark.sql import functions as F\n"
        "from cellgauge.plans import catalog, collect\n"
        "collect.MODULES['first'] = lambda packed, settings: packed.select('field_id', F.get('values', F.lit(0)).alias('first:value'))\n"
        "collect.SCHEMES['own'] = catalog.Scheme('own', (catalog.Metric('first:value', 'first', 'feature'), catalog.Metric('size:ratio', 'size', 'label')), predictor='least_squares', training_required=True)\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    try:
        run.main(["--plugin", "own_scheme", "--scheme", "own", "-a", "run", "score", "-k", "3"])
    finally:
        collect.SCHEMES.pop("own", None), collect.MODULES.pop("first", None)
    assert "medape" in capsys.readouterr().out
    with pytest.raises(SystemExit, match="no scheme"):
        run.main(["--scheme", "own"])


def test_what_is_no_json_is_no_configuration(spark, monkeypatch):
    s = store.ResultStore(spark)
    assert s.upsert_configs("experiments", [{"a": 1}]).count() == 1
    monkeypatch.setattr(store, "canonical_json", lambda c: "{not json")
    with pytest.raises(Exception, match="no JSON"):
        s.upsert_configs("experiments", [{"a": 2}]).collect()


def test_a_log_of_changes_is_judged_as_each_change_by_itself(spark):
    keys = [catalog.DATA, catalog.ALL, catalog.TRAINING, "unknown", *catalog.MOCK.all_settings]
    sets = {k: {key for b, key in enumerate(keys) if k >> b & 1} for k in range(1 << len(keys))}
    loose = catalog.Scheme("loose", catalog.MOCK.metrics, {catalog.RUNTIME: (keys[4],)}, catalog.MOCK.all_settings)
    log = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "case int, changes array<string>")
    for scheme in (catalog.MOCK, loose):
        got = {r["case"]: r["c"] for r in log.select("case", catalog.classes_of(scheme, F.col("changes")).alias("c")).collect()}
        assert got == {k: scheme.classes(s) for k, s in sets.items()}
    cases = {str(k): s for k, s in sets.items() if k % 37 == 0}
    one = catalog.invalidation(catalog.MOCK, spark, cases)
    many = catalog.invalidation_log(catalog.MOCK, spark.createDataFrame([(k, sorted(s)) for k, s in cases.items()], "case string, changes array<string>"))
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.select(many.columns).collect()))
    none = catalog.invalidation_log(catalog.MOCK, spark.createDataFrame([("n", None)], "case string, changes array<string>"))
    assert [r["metric"] for r in none.where("invalid").collect()] == ["mock:nondeterministic"]
    assert catalog.invalidation_log(catalog.MOCK, log.limit(0)).count() == 0
