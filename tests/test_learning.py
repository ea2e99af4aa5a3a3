import numpy as np
import pytest

from cellgauge.operators import learning

PAIRS = "call int, actual double, predicted double"


def ranked(values):
    s = np.sort(np.asarray(values))
    n = len(s)
    return n, (s[(n - 1) // 2] + s[n // 2]) / 2, s[int(n * 0.1)], s[int(n * 0.9)]


@pytest.mark.parametrize("kind", ["normal", "ties", "few", "skewed"])
def test_ranks_are_exact(spark, kind):
    draw = np.random.default_rng(4)
    values = {
        "normal": lambda n: draw.normal(size=n),
        "ties": lambda n: np.where(draw.random(n) < 0.7, 0.0, draw.integers(0, 3, n)),
        "few": lambda n: draw.normal(size=n % 7 + 1),
        "skewed": lambda n: np.exp(8 * draw.normal(size=n)),
    }[kind]
    groups = {g: values(n) for g, n in enumerate((1, 2, 3, 10, 999, 5000, 20000))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 1.0), (None, 2.0), (1, None)], "g int, v double").repartition(5)
    got = {r["g"]: (r["n"], r["medape"], r["p10"], r["p90"]) for r in learning.summarised(df, "v", ["g"]).collect()}
    want = {g: ranked(vs) for g, vs in groups.items()} | {None: ranked([1.0, 2.0])}
    assert got == want
    every = np.concatenate([*groups.values(), [1.0, 2.0]])
    r = learning.summarised(df, "v", []).first()
    assert (r["n"], r["medape"], r["p10"], r["p90"]) == ranked(every)


def test_no_rows(spark):
    none = spark.createDataFrame([], PAIRS)
    assert learning.median_ape(none, ["call"]).collect() == []
    r = learning.median_ape(none, []).first()
    assert (r["n"], r["medape"]) == (0, None)


def test_quality_adds_up_over_calls(spark):
    draw = np.random.default_rng(6)
    folds = [[(float(a), float(p)) for a, p in zip(draw.uniform(1, 9, n), draw.uniform(1, 9, n), strict=True)] for n in (9, 20, 31)]
    quality, other = learning.MedianErrors(), learning.MedianErrors()
    for k, f in enumerate(folds):
        (quality if k < 2 else other).score(spark.createDataFrame([(k, a, p) for a, p in f] + [(k, None, None)], PAIRS))
    quality.merge(other)
    errors = [[abs(a - p) / a for a, p in f] for f in folds]
    assert [r["medape"] for r in quality.folds().orderBy("call").collect()] == pytest.approx([ranked(e)[1] for e in errors])
    r = quality.results().first()
    _, mid, low, high = ranked([ranked(e)[1] for e in errors])
    assert (r["folds_median"], r["folds_10ape"], r["folds_90ape"]) == pytest.approx((mid, low, high))
    n, mid, low, high = ranked(sum(errors, []))
    assert (r["n"], r["overall_median"], r["overall_10ape"], r["overall_90ape"]) == (n, *map(pytest.approx, (mid, low, high)))
    quality.clear()
    with pytest.raises(ValueError, match="nothing"):
        quality.results()


def test_quality_checks_what_it_is_given(spark):
    q = learning.MedianErrors()
    with pytest.raises(ValueError, match="no column predicted"):
        q.score(spark.createDataFrame([(1.0,)], "actual double"))
    with pytest.raises(TypeError, match="not a number"):
        q.score(spark.createDataFrame([(1.0, "x")], "actual double, predicted string"))
    with pytest.raises(TypeError, match="different dimensions"):
        q.score(spark.createDataFrame([(1.0, [1.0])], "actual double, predicted array<double>"))
    q.score(spark.createDataFrame([([2.0], [1.0])], "actual array<double>, predicted array<double>"))
    assert q.results().first()["overall_median"] == 0.5
    for rows, kind, said in (([(1.0, None)], "double", "different dimensions"), ([([1.0, 2.0], [1.0, 2.0])], "array<double>", "more or fewer labels")):
        q.clear()
        q.score(spark.createDataFrame(rows, f"actual {kind}, predicted {kind}"))
        with pytest.raises(Exception, match=said):
            q.results().collect()


def rows_of(spark, n=60, k=5):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(n, 2))
    y = 3 * x[:, 0] - x[:, 1] + 2 + 0.1 * draw.normal(size=n)
    data = [(i, int(i * k // n), float(a), float(b), float(c), "g" if i % 3 else None) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "idx bigint, fold int, a double, b double, y double, g string"), x, y, np.array([r[1] for r in data])


def test_merged_offset_equals_the_fold_by_fold_one(spark):
    rows, *_ = rows_of(spark)
    got = {r["idx"]: r["predicted"] for r in learning.cross_validate_merged(rows, learning.MergeableOffset(), ["a"], "y").collect()}
    want = {r["idx"]: r["predicted"] for r in learning.cross_validate(rows, learning.Offset(), ["a"], "y", 5).collect()}
    assert got == pytest.approx(want)


def test_merged_least_squares_equals_a_fit_of_the_other_folds(spark):
    rows, x, y, fold = rows_of(spark)
    got = {r["idx"]: r["predicted"] for r in learning.cross_validate_merged(rows, learning.LeastSquares(), ["a", "b"], "y").collect()}
    z = np.column_stack([x, np.ones(len(x))])
    for f in range(5):
        c = np.linalg.lstsq(z[fold != f], y[fold != f], rcond=None)[0]
        for i in np.flatnonzero(fold == f):
            assert got[i] == pytest.approx(z[i] @ c)


def test_states_merge_in_any_grouping():
    draw = np.random.default_rng(3)
    ls = learning.LeastSquares()

    def state(m):
        c = np.cov(m.T, bias=True) * len(m)
        return np.concatenate([[len(m)], m.mean(axis=0), c[np.triu_indices(3)]])

    m = draw.normal(size=(50, 3)) * [1, 100, 1e-3] + [0, 1e6, 5]
    whole = state(m)
    for cut in (1, 10, 49):
        assert ls.merge(state(m[:cut]), state(m[cut:])) == pytest.approx(whole, rel=1e-9)
    none = np.zeros(len(whole))
    assert (ls.merge(none, whole) == whole).all() and np.isnan(ls.finish(none)).all()


def test_groups_nulls_and_lone_folds(spark):
    rows, *_ = rows_of(spark)
    by_group = learning.cross_validate_merged(rows, learning.LeastSquares(), ["a"], "y", ["g"])
    assert by_group.where("predicted is null").count() == 0 and by_group.count() == 60
    odd = spark.createDataFrame([(0, None, 1.0), (0, 1.0, 2.0), (1, 2.0, None), (1, 3.0, 4.0)], "fold int, a double, y double")
    got = sorted((r["fold"], r["a"], r["predicted"]) for r in learning.cross_validate_merged(odd, learning.MergeableOffset(), ["a"], "y").where("a is not null").collect())
    assert got == [(0, 1.0, 2.0), (1, 2.0, 3.0), (1, 3.0, 4.0)]
    lone = learning.cross_validate_merged(odd.where("fold = 0"), learning.LeastSquares(), ["a"], "y")
    assert lone.where("predicted is not null").count() == 0 and lone.count() == 2
    same = spark.createDataFrame([(f, 1.0, float(f)) for f in (0, 0, 1, 1)], "fold int, a double, y double")
    assert {r["fold"]: r["predicted"] for r in learning.cross_validate_merged(same, learning.LeastSquares(), ["a"], "y").collect()} == pytest.approx({0: 1.0, 1: 0.0})
    assert learning.cross_validate_merged(odd.limit(0), learning.LeastSquares(), ["a"], "y").count() == 0
