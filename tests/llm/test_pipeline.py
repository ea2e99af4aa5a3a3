import random

import pytest

import corpus_pipeline
from cellgauge.llm import toxicity
from cellgauge.llm.queries import training_labels

from .brute import classes
from .test_edges import PROSE, bm25_pairs, sample

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k int, _id string, label int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with toxic texts, near copies, leaks and odd rows."""
    texts, toxic = sample(400, 9)
    draw = random.Random(8)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    items = [(i, " ".join(f"q{draw.randrange(900)}" for _ in range(draw.randrange(15, 50)))) for i in range(12)]
    for i in range(1000, 1040):
        w = draw.choice(texts).split()
        w[draw.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w), "en", "s0"))
    rows += [(1100 + i, f"{PROSE} {items[i][1]} {PROSE[::-1]}", "en", None) for i in range(6)]
    rows += [(2000, None, None, None), (2001, "", "en", "s1"), (2002, " ", "en", "s1"), (2003, "lone", "en", "s1"), (2003, "lone", "en", "s1"), (None, "no id at all here", None, "s2"), (2004, "the " * 30_000, "en", "s2")]
    rows = [(*r, len(r[1] or ""), 7, "x", 3) for r in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def staged(spark, name, rows, folder):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame(rows, COLUMNS)
    out = stage(spark, df, folder)
    assert name == "mixing" or out.columns == df.columns
    assert stage(spark, df.limit(0), folder).count() == 0
    return [tuple(r) for r in out.collect()]


def test_toxicity_stage(spark, corpus):
    folder, rows, _ = corpus
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), training_labels(spark.read.parquet(f"{folder}/labels.parquet")))
    p = model.probability(toxicity.Scorer(model).values([r[1] for r in rows]))
    assert sorted(map(str, staged(spark, "toxicity", rows, folder))) == sorted(str(r) for r, x in zip(rows, p, strict=True) if x < corpus_pipeline.TOXIC)


def test_near_duplicate_stage(spark, corpus):
    folder, rows, _ = corpus
    got = staged(spark, "near_duplicates", rows, folder)
    of = {(d, n): c for d, n, c in classes([(r[0], r[1]) for r in rows], 5, 80, 100)}
    kept = {c for (d, n), c in of.items() if n and d is not None}
    assert {r[0] for r in got} == kept | {2000, 2001, 2002, None}
    assert len(got) == len({r[0] for r in got})


def test_leak_stage(spark, corpus):
    folder, rows, items = corpus
    leaks = {d for d, _ in bm25_pairs([(r[0], r[1]) for r in rows], items, 0.6, 0.5)}
    assert leaks == {1100 + i for i in range(6)}
    assert sorted(map(str, staged(spark, "decontamination", rows, folder))) == sorted(str(r) for r in rows if r[0] not in leaks)


def test_run_is_the_stages_in_order(spark, corpus):
    folder, rows, _ = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, folder).collect()
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    ids = {r["doc_id"] for r in out}
    assert ids and not ids & {1100 + i for i in range(6)} and not ids & {i for i in range(0, 400, 6)}


def test_rows_leave_by_id_and_text(spark, corpus):
    """Rows that share an id with a copy or a leak, or have none like it, stay."""
    folder, _, items = corpus
    leak = f"{PROSE} {items[0][1]} {PROSE[::-1]}"
    rows = [(None, leak), (None, "clean and without an id"), (7, leak), (7, "clean and of the same id"), (8, "clean")]
    full = [(*r, "en", "s", len(r[1]), 7, "x", 3) for r in rows]
    got = staged(spark, "decontamination", full, folder)
    assert sorted(map(str, got)) == sorted(str(r) for r in full if "clean" in r[1])
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(1, a), (5, a + " more"), (5, b), (None, c), (None, c + " more"), (None, d), (9, d + " more"), (9, d), (6, "lone"), (6, "lone"), (None, "x"), (None, "y")]
    full = [(*r, "en", "s", len(r[1]), 7, "x", 3) for r in rows]
    got = [(r[0], r[1].removesuffix(" more")) for r in staged(spark, "near_duplicates", full, folder)]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (5, b), (None, c), (9, d), (6, "lone"), (None, "x"), (None, "y")]))


def test_two_columns_are_enough(spark, corpus):
    """Stages that need no more than an id and a text take tables without other columns, also where ids repeat."""
    folder, _, _ = corpus
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, a + " more"), (2, None), (2, None)], "doc_id bigint, text string")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns
        rows = sorted(map(str, (tuple(r) for r in out.collect())))
        assert rows == sorted(map(str, [(1, a), (1, b), (2, None), (2, None)] if name == "near_duplicates" else [tuple(r) for r in df.collect()]))
