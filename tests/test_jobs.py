import json
import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import scheme_benchmark, text_compressibility
from jobs.queries import ORACLE, QUERIES

from .compare import assert_same, connect

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
CONFIG = json.loads((ROOT / "jobs/text_compressibility.json").read_text())
BENCHMARK = json.loads((ROOT / "jobs/scheme_benchmark.json").read_text())


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    before = {k: v for k, v in spark.conf.getAll.items()}
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLE[name])
    assert {k: v for k, v in spark.conf.getAll.items()} == before
    assert not [t for t in spark.catalog.listTables() if "job" in t.name]


# --- texts ---


def plain_report(rows):
    """(source, lang): n_texts, n_bytes, entropy_0, entropy_1 of (source, lang, text)."""
    groups = {}
    for source, lang, text in rows:
        b = [256, *(text or "").encode(), 256]
        groups.setdefault((source, lang), []).append(b)
    out = {}
    for key, texts in groups.items():
        pairs = Counter(p for t in texts for p in zip(t, t[1:], strict=False))
        firsts, seconds, n = Counter(), Counter(), sum(pairs.values())
        for (a, b), c in pairs.items():
            firsts[a] += c
            seconds[b] += c
        h0 = -sum(c / n * math.log2(c / n) for c in seconds.values())
        h1 = -sum(c / n * math.log2(c / firsts[a]) for (a, _), c in pairs.items())
        out[key] = (len(texts), n - len(texts), round(h0, 5), round(h1, 5))
    return out


ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint, code string"


def documents(n, start=0):
    words = ["alpha", "béta", "γ", "", "de lta\n"]
    return [(start + k, None if k % 11 == 5 else " ".join(words[(k * j) % 5] for j in range(k % 17)), ["en", "de", None, ""][k % 4], ["s1", "s2", None, "", "1"][k % 5], 0, "clash") for k in range(n)]


def add_file(spark, folder, rows):
    """One more file of rows."""
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def result(spark, out):
    kinds = {"source": "string", "lang": "string"}
    rows = text_compressibility.report(spark, out, kinds, CONFIG["by"]).collect()
    return {(r["source"], r["lang"]): (r["n_texts"], r["n_bytes"], round(r["entropy_0"], 5), round(r["entropy_1"], 5)) for r in rows}


def expected(rows):
    return plain_report([(r[3], r[2], r[1]) for r in rows])


def test_only_new_files_are_taken(spark, tmp_path):
    data, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    first, second = documents(60), documents(45, 100)
    add_file(spark, data, first)
    one = text_compressibility.run(spark, data, out, CONFIG)
    assert (one["batches"], one["texts"]) == (1, 60) and result(spark, out) == expected(first)
    assert text_compressibility.run(spark, data, out, CONFIG)["texts"] == 0 and result(spark, out) == expected(first)
    add_file(spark, data, second)
    two = text_compressibility.run(spark, data, out, CONFIG)
    assert (two["batches"], two["texts"]) == (1, 45) and result(spark, out) == expected(first + second)
    assert sorted(p.name for p in Path(out, "pairs").glob("batch=*")) == ["batch=0", "batch=1"]


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    data, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    rows = documents(40)
    add_file(spark, data, rows[:25])
    text_compressibility.run(spark, data, out, CONFIG)
    add_file(spark, data, rows[25:])
    text_compressibility.run(spark, data, out, CONFIG)
    # As if the driver had been lost after the last batch's write and before its commit.
    for f in Path(out, "checkpoint/commits").glob("*1*"):
        f.unlink()
    shutil.rmtree(Path(out, "report"))
    again = text_compressibility.run(spark, data, out, CONFIG)
    assert again["texts"] == 15 and result(spark, out) == expected(rows)


def test_small_batches_add_up(spark, tmp_path):
    data, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    for k in range(4):
        add_file(spark, data, documents(10, 10 * k))
    taken = text_compressibility.run(spark, data, out, {**CONFIG, "files_per_trigger": 1}, f"{tmp_path}/mark")
    assert taken["batches"] == 4 and taken["texts"] == 40
    assert result(spark, out) == expected([r for k in range(4) for r in documents(10, 10 * k)])
    assert Path(tmp_path, "mark").is_dir() and not Path(out, "checkpoint").exists()


def test_no_rows(spark, tmp_path):
    data, out = f"{tmp_path}/documents", f"{tmp_path}/out"
    spark.createDataFrame([], ROWS).write.parquet(data)
    assert text_compressibility.run(spark, data, out, CONFIG)["groups"] == 0
    assert result(spark, out) == {}


# --- schemes ---


@needs_tables
def test_a_rerun_replaces_its_own_partitions(spark, tmp_path):
    out = str(tmp_path)
    config = {**BENCHMARK, "views": ["evt1d"], "bounds": [0.5], "schemes": {"entropy": BENCHMARK["schemes"]["entropy"]}}
    scheme_benchmark.run(spark, SF, out, config)
    read = lambda: {n: sorted(map(str, scheme_benchmark.read(spark, out, n).collect())) for n in scheme_benchmark.SCHEMAS}
    before = read()
    scheme_benchmark.run(spark, SF, out, config)
    assert read() == before
    scheme_benchmark.run(spark, SF, out, {**config, "bounds": [0.25]})
    assert {r["bound"] for r in scheme_benchmark.read(spark, out, "observations").collect()} == {0.25, 0.5}
    assert [x for x in read()["observations"] if "bound=0.5" in x] == before["observations"]


@needs_tables
def test_empty_tables_and_counts(spark, tmp_path):
    config = {**BENCHMARK, "views": ["evt1d"], "bounds": [0.5, 0.25]}
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/in/events.parquet")
    assert set(scheme_benchmark.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config).values()) == {0}
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    got = scheme_benchmark.run(spark, SF, f"{tmp_path}/out", config)
    assert got["evt1d:cells"] == n and got["evt1d:observations"] == 2 * 5 and got["evt1d:predictions"] == 2 * 5 * len(config["schemes"])


def test_fields_without_entropy_are_seen_but_not_scored(spark):
    cells = [("flat", i, 1.0) for i in range(20)] + [(f"f{k}", i, float((i * (k + 3)) % 11)) for k in range(6) for i in range(30)]
    seen = scheme_benchmark.observe(spark.createDataFrame(cells, "field_id string, idx bigint, v double"), [0], [0.1], 2)
    rows = {r["field_id"]: r for r in seen.collect()}
    assert len(rows) == 7 and rows["flat"]["entropy_ratio"] is None and rows["flat"]["range_bits"] == 0
    made = scheme_benchmark.predict(seen.selectExpr("*", "'x' as view"), "entropy", BENCHMARK["schemes"]["entropy"])
    assert scheme_benchmark.scores(made).where("fold = -1").first()["n"] == 6


def test_cells_are_made_once_for_all_bounds(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def one(v):
        made.add(1)
        return v

    cells = [(f"f{k}", i, float((i * (k + 3)) % 11)) for k in range(4) for i in range(25)]
    counting = spark.createDataFrame(cells, "field_id string, idx bigint, v double").withColumn("v", F.udf(one, "double")("v"))
    monkeypatch.setattr(scheme_benchmark, "read_fields", lambda spark, view, sf_dir: counting)
    got = scheme_benchmark.run(spark, "in", f"{tmp_path}/out", {**BENCHMARK, "views": ["evt1d"], "bounds": [0.5, 0.25, 0.125]})
    assert got["evt1d:cells"] == 100 and got["evt1d:observations"] == 12 and made.value == 100


@needs_tables
@pytest.mark.parametrize("job", ["scheme_benchmark", "text_compressibility"])
def test_command_line(tmp_path, job):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"views": ["evt1d"], "bounds": [0.5], "folds": 2, "schemes": {"entropy": {"predictor": "noop", "features": ["entropy_ratio"]}}} if job == "scheme_benchmark" else CONFIG))
    source = SF if job == "scheme_benchmark" else f"{SF}/documents.parque[t]"
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", source, f"{tmp_path}/out", "--config", str(config)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and "read" in done.stderr
    assert any(Path(tmp_path, "out").rglob("*.parquet"))
