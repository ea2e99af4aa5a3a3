import random

import numpy as np
import pytest

from cellgauge.llm import ngram_join as J

from .brute import classes


def near_texts(seed, n, length):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[draw.choice(vocab) for _ in range(length)] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.randrange(0, 5)):
            at = draw.randrange(len(w))
            w[at : at + draw.randrange(0, 2)] = [f"x{draw.randrange(10_000)}"] * draw.randrange(0, 2)
        out.append(" ".join(w))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in J.components(df, **how).collect()), key=str)


@pytest.mark.parametrize("k,num,length", [(4, 85, 60), (5, 80, 30), (4, 85, 9)])
def test_equals_brute_force(spark, k, num, length):
    rows = list(enumerate(near_texts(k * num + length, 150, length)))
    assert run(spark, rows, k=k, num=num, den=100) == classes(rows, k, num, 100)


def test_blocks_of_a_large_class_change_nothing(spark):
    rows = list(enumerate(near_texts(5, 300, 80)))
    want = classes(rows, 4, 85, 100)
    assert run(spark, rows, k=4, num=85, den=100, block_shingles=800, block_sets=20) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two"), (6, "one two"), (None, "one two"), (None, "quite alone here it is"), (7, "É é"), (8, "é é"), (9, "a " * 5000), (10, "a " * 4000)]
    assert run(spark, rows, k=4, num=85, den=100) == classes(rows, 4, 85, 100)
    assert run(spark, [], k=4, num=85, den=100) == []


def test_every_linked_pair_meets_under_a_key():
    draw = np.random.default_rng(3)
    for num in (80, 85):
        plan = J.Plan(4, num, 100)
        for _ in range(400):
            n = int(draw.integers(2, 400))
            a = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
            gone = int(draw.integers(0, max(1, int(len(a) * 0.2)) + 1))
            b = np.unique(np.concatenate([a[gone:], draw.integers(0, 1 << 63, int(draw.integers(0, max(1, len(a) // 8) + 1))).astype(np.uint64)]))
            if len(b) and J.linked(plan, a, b) and J.set_id(a) != J.set_id(b):
                assert set().union(*[x.tolist() for _, x in plan.keys(a)]) & set().union(*[x.tolist() for _, x in plan.keys(b)])


def test_linked_pairs_meet_whichever_shingles_are_common():
    draw = np.random.default_rng(4)
    plan = J.Plan(5, 80, 100)
    for share in (0.02, 0.5, 1.0):
        for _ in range(150):
            a = np.unique(draw.integers(0, 1 << 63, int(draw.integers(2, 600))).astype(np.uint64))
            b = np.unique(np.concatenate([a[int(draw.integers(0, max(1, len(a) // 8) + 1)) :], draw.integers(0, 1 << 63, int(draw.integers(0, max(1, len(a) // 9) + 1))).astype(np.uint64)]))
            common = np.unique(draw.choice(np.concatenate([a, b]), int(share * len(a)) + 1))
            common = np.unique(np.concatenate([a, b])) if share == 1 else common
            if J.linked(plan, a, b) and J.set_id(a) != J.set_id(b):
                assert set().union(*[x.tolist() for _, x in plan.keys(a, common)]) & set().union(*[x.tolist() for _, x in plan.keys(b, common)])


def made(monkeypatch):
    """Rows of each table that a run writes, by its label."""
    out, write = {}, J.materialize

    def counted(df, label, *a, **b):
        table = write(df, label, *a, **b)
        out.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(J, "materialize", counted)
    return out


def passage_texts(n):
    """Texts that share a passage and are else apart; of every tenth there is a near copy, and some are little else than the passage."""
    draw = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = [f"w{draw.randrange(100_000)}" for _ in range(draw.randrange(130, 150))]
        out.append(w[:70] + passage + w[70:])
        if i % 10 == 0:
            out.append(out[-1][:-1])
    out += [[f"y{i}", *passage, f"z{i}"] for i in range(20)] + [[f"u{i}{j}" for j in range(9)] + passage + [f"v{i}{j}" for j in range(9)] for i in range(20)]
    return list(enumerate(" ".join(w) for w in out))


def test_a_passage_that_all_share_ties_no_class(spark, monkeypatch):
    """Each class's blocks move its sets' texts, so a class of all texts takes disk by the square of their number."""
    rows = passage_texts(200)
    want = classes(rows, 5, 80, 100)
    sizes = made(monkeypatch)
    assert run(spark, rows, k=5, num=80, den=100) == want
    assert sizes["members"] == [sum(sizes["members"])] and sizes["members"][0] < 150


def test_common_shingles_beyond_those_sent_change_nothing(spark, monkeypatch):
    rows = passage_texts(60)
    want = classes(rows, 5, 80, 100)
    for run_shingles, sent in ((3_000, 20), (3_000, 0), (10**9, 10**6)):
        monkeypatch.setattr(J, "RUN_SHINGLES", run_shingles)
        monkeypatch.setattr(J, "COMMON", sent)
        assert run(spark, rows, k=5, num=80, den=100) == want


def test_pairs_of_blocks_move_in_rounds(spark, monkeypatch):
    rows = list(enumerate(near_texts(5, 300, 80)))
    want = classes(rows, 4, 85, 100)
    sizes = made(monkeypatch)
    monkeypatch.setattr(J, "MANY", 10**6)  # else all shingles are common
    assert run(spark, rows, k=4, num=85, den=100, block_shingles=800, block_sets=20) == want
    assert len(sizes["links"]) > 3


@pytest.mark.parametrize("ids", ["half null", "all null", "one id"])
def test_rows_without_an_id_or_with_one_id(spark, ids):
    rows = [({"half null": None if i % 2 else i, "all null": None, "one id": 7}[ids], t) for i, t in enumerate(near_texts(21, 160, 40) + ["", " ", "one two", "one two"])]
    assert run(spark, rows, k=4, num=85, den=100) == classes(rows, 4, 85, 100)
    assert run(spark, rows, k=4, num=85, den=100, block_shingles=400, block_sets=20) == classes(rows, 4, 85, 100)


def test_many_rows_without_an_id_take_no_longer(spark):
    """Their number squared would be 64 million texts here."""
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(12)) for _ in range(2_000)]
    rows = [(None, f"{t} {'x' if k % 2 else 'y'}") for k in range(4) for t in texts]
    got = run(spark, rows, k=4, num=60, den=100)
    assert len(got) == 8_000 and {r[0] for r in got} == {None}


def test_very_long_word_and_text(spark):
    long = "x" * 3_000_000
    rows = [(1, long + " b c d"), (2, long + " B c d"), (3, "y " * 700_000 + "z")]
    assert [r[2] for r in run(spark, rows, k=4, num=85, den=100)] == [1, 1, 3]


def test_runs_of_keys_and_hot_nodes_lose_no_connection(spark, monkeypatch):
    """Keys in runs of their own, and centres and classes sent instead of joined, give the same classes."""
    from cellgauge.llm import common

    rows = list(enumerate(near_texts(11, 200, 40))) + [(1000 + i, "a passage that very many documents have " * 3) for i in range(100)] + [(2000 + i, None) for i in range(50)]
    want = classes(rows, 4, 85, 100)
    monkeypatch.setattr(J, "HELD_KEYS", 600)
    monkeypatch.setattr(J, "MANY", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert run(spark, rows, k=4, num=85, den=100) == want


def test_components_of_stars_chains_and_rings(spark, monkeypatch):
    from cellgauge.llm import common
    from cellgauge.llm.graph import connected_components

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = [(500, i) for i in range(1, 60)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(3000 + i, 3999) for i in range(30)] + [(7, 7), (500, 1)]
    classes = J.Classes(5000)
    for x, y in edges:
        classes.union(x, y)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: classes.find(x) for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
