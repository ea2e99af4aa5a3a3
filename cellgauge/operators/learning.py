"""Folds, predictors, scoring, and the multivariate comparisons of fields."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_folds(rows: DataFrame, k: int, idx: str = "idx", n: int | None = None, partition: list[str] | None = None) -> DataFrame:
    """rows with `fold`: contiguous, the first n mod k folds get one row more.

    idx must run from 0 without gaps. Within partitions a window deals the folds; for a whole table
    the fold follows from idx and the number of rows alone, so no task sees all rows.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if partition:
        return rows.withColumn("fold", F.ntile(k).over(Window.partitionBy(*partition).orderBy(idx)) - 1)
    n = rows.count() if n is None else n
    small, extra = divmod(n, k)
    i = F.col(idx)
    first = extra * (small + 1)
    late = F.lit(extra) + F.floor((i - first) / F.lit(max(1, small)))
    return rows.withColumn("fold", F.when(i < first, F.floor(i / (small + 1))).otherwise(late).cast("int"))


def ape(actual: Column, predicted: Column, signed: bool = False) -> Column:
    from ..functions.scalar import absolute_percentage_error

    return absolute_percentage_error(actual, predicted, signed)


#: Shares of a group's rows that its quantiles are bracketed by, and the accuracy of those brackets.
BRACKETS = 200
ACCURACY = 10_000


def select_ranks(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, n and for each name of ranks the value of that rank (from 0, a function of n) among a group's values in order.

    Exact, in two passes over rows and without a task for each group: mergeable sketches bracket each rank
    by values, then what lies below a bracket is counted and what lies in it is counted by value. Only
    the distinct values of the brackets, about three in BRACKETS of a group's, are put in order. A rank beyond
    the last row is null; null values are left out; without by, one row comes out even of no rows.
    """
    keys = [f"_k{k}" for k in range(len(by))]
    given = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    grid = [i / BRACKETS for i in range(BRACKETS + 1)]
    groups = given.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_v", grid, ACCURACY).alias("_g"))
    n = F.col("_n")

    def bracket(name: str) -> Column:
        rank = ranks[name](n).cast("bigint")
        at = F.floor(rank / F.greatest(n, F.lit(1)) * BRACKETS).cast("int")
        low = F.when(at >= 2, F.get("_g", at - 2)).otherwise(F.lit(float("-inf")))
        high = F.when(at + 2 < BRACKETS, F.get("_g", at + 2)).otherwise(F.lit(float("inf")))
        return F.struct(F.lit(name).alias("name"), rank.alias("rank"), low.alias("low"), high.alias("high"))

    wanted = groups.select(*keys, "_n", F.filter(F.array(*[bracket(r) for r in ranks]), lambda t: t["rank"] < n).alias("_t"))
    a, b = given.alias("a"), wanted.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]) if keys else given.crossJoin(F.broadcast(wanted))
    own = [F.col(f"a.{k}").alias(k) for k in keys] if keys else []
    met = both.select(*own, "_v", "_n", F.explode(F.filter("_t", lambda t: F.col("_v") <= t["high"])).alias("t"))
    # One value stands for all below the bracket.
    held = met.groupBy(*keys, "_n", F.col("t.name").alias("_name"), F.col("t.rank").alias("_rank"), F.when(F.col("_v") < F.col("t.low"), F.lit(float("-inf"))).otherwise(F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = held.withColumn("_to", F.sum("_c").over(w)).where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c")))
    wide = found.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_name") == r, F.col("_v"))).alias(r) for r in ranks])
    return wide.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"), *ranks)


#: The ranks that errors are summed up by: those of the median, both elements next to it by the upper rule, and the tenths.
ERROR_RANKS: dict[str, Callable[[Column], Column]] = {
    "_low": lambda n: F.floor((n - 1) / 2),
    "_half": lambda n: F.floor(n / 2),
    "_upper": lambda n: F.floor(n / 2) + 1,
    "p10": lambda n: F.floor(n * 0.1),
    "p90": lambda n: F.floor(n * 0.9),
}


def median_ape(rows: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", rule: str = "median", signed: bool = False) -> DataFrame:
    """n, median, p10 and p90 of the absolute percentage error per group.

    p10 and p90 are the elements at floor(0.1 n) and floor(0.9 n) of the sorted errors. rule
    "upper": for even n of 4 or more the mean of the elements at n/2 and n/2 + 1.
    """
    e = rows.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).withColumn("ape", ape(F.col(actual), F.col(predicted), signed))
    return summarised(e, "ape", by, rule)


def summarised(rows: DataFrame, value: str, by: list[str], rule: str = "median") -> DataFrame:
    """by, n, medape, p10, p90 of values, by median_ape's rules."""
    r = select_ranks(rows, value, by, ERROR_RANKS)
    mid = (F.col("_low") + F.col("_half")) / 2
    if rule == "upper":
        mid = F.when((F.col("n") % 2 == 0) & (F.col("n") >= 4), (F.col("_half") + F.col("_upper")) / 2).otherwise(F.col("_half"))
    return r.select(*by, "n", mid.alias("medape"), "p10", "p90")


class MedianErrors:
    """A quality metric that adds up over calls, each of which scores one fold; parts of it can be merged.

    It holds plans, not rows, so what it was given is read when results are asked for.
    """

    def __init__(self, rule: str = "median", signed: bool = False):
        self.rule, self.signed, self.calls = rule, signed, []

    def score(self, rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> None:
        """Add a fold. Both columns must be there and be numbers, or arrays of one number each; a row that has
        only one of them is an error when the results are read, a row with neither counts for nothing."""
        kinds = dict(rows.dtypes)
        for c in (actual, predicted):
            if c not in kinds:
                raise ValueError(f"no column {c}")
            if not re.fullmatch(r"(array<)?(tinyint|smallint|int|bigint|float|double|decimal\(\d+,\d+\))>?", kinds[c]):
                raise TypeError(f"{c} is {kinds[c]}, not a number or an array of one")
        if kinds[actual].startswith("array") != kinds[predicted].startswith("array"):
            raise TypeError("actual and predicted have different dimensions")

        def number(c: str) -> Column:
            if not kinds[c].startswith("array"):
                return F.col(c).cast("double")
            return F.when(F.size(c) == 1, F.get(c, F.lit(0)).cast("double")).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} has more or fewer labels than one")).cast("double"))

        a, p = number(actual), number(predicted)
        one = F.when(a.isNull() != p.isNull(), F.raise_error(F.lit("actual and predicted have different dimensions")).cast("double")).otherwise(ape(a, p, self.signed))
        self.calls.append(rows.select(one.alias("ape")))

    def merge(self, other: MedianErrors) -> None:
        """Add another's folds after the own ones."""
        self.calls += other.calls

    def clear(self) -> None:
        self.calls = []

    def _all(self) -> DataFrame:
        if not self.calls:
            raise ValueError("nothing was scored")
        parts = [c.select(F.lit(k).cast("bigint").alias("call"), "ape") for k, c in enumerate(self.calls)]
        return functools.reduce(DataFrame.unionByName, parts)

    def folds(self) -> DataFrame:
        """call, n, medape, p10, p90 of each fold."""
        return summarised(self._all(), "ape", ["call"], self.rule)

    def results(self) -> DataFrame:
        """One row: the median and tenths of the folds' medians, and of all errors."""
        folds = summarised(self.folds(), "medape", [], self.rule).select(F.col("p10").alias("folds_10ape"), F.col("p90").alias("folds_90ape"), F.col("medape").alias("folds_median"))
        every = summarised(self._all(), "ape", [], self.rule).select(F.col("p10").alias("overall_10ape"), F.col("p90").alias("overall_90ape"), F.col("medape").alias("overall_median"), "n")
        return folds.crossJoin(F.broadcast(every))


def matrix(rows: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """keys and `row`, the named columns as doubles in order; a null or non-numeric one is an error that names it."""
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.raise_error(F.concat_ws(" ", F.lit(f"{c} is no number in row"), *[F.col(k).cast("string") for k in keys])).cast("double"))
    return rows.select(*keys, F.array(*[number(c) for c in ids]).alias("row"))


# --- predictors -----------------------------------------------------------------------------------


class Noop:
    """Predicts the feature itself."""

    training_required = False

    def fit(self, x: np.ndarray, y: np.ndarray):
        return None

    def predict(self, x: np.ndarray, state) -> np.ndarray:
        return x.reshape(len(x), -1)[:, 0]


class Offset:
    """Predicts the feature and the greatest difference seen."""

    training_required = True

    def fit(self, x, y):
        return float((y - x.reshape(len(x), -1)[:, 0]).max())

    def predict(self, x, state):
        return x.reshape(len(x), -1)[:, 0] + state


class UserProgram:
    """A predictor from program text that defines fit(features, labels) and predict(features, state); it sees `names`."""

    training_required = True

    def __init__(self, program: str, names: list[str]):
        self.program, self.names = program, names

    def _scope(self) -> dict:
        scope: dict = {"names": self.names, "np": np}
        exec(self.program, scope)  # the caller's own program
        return scope

    def fit(self, x, y):
        return self._scope()["fit"](x, y)

    def predict(self, x, state):
        return np.asarray(self._scope()["predict"](x, state), dtype=float)


PREDICTORS: dict[str, Callable] = {"noop": Noop, "offset": Offset, "program": UserProgram}


def cross_validate(rows: DataFrame, predictor, features: list[str], label: str, k: int) -> DataFrame:
    """fold, idx, actual, predicted for every row; each fold is predicted by what the others taught.

    rows: fold, idx, features and label. Folds are fitted in parallel, each by one task over its
    training rows, which a fit in memory needs; offset_folds() is the declarative form.
    """
    folds = rows.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("test_fold"), "fold", "idx", *features, label)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        own = f["fold"] == f["test_fold"]
        x, y = f[features].to_numpy(dtype=float), f[label].to_numpy(dtype=float)
        if not own.any():
            return pd.DataFrame({"fold": [], "idx": [], "actual": [], "predicted": []})
        state = predictor.fit(x[~own], y[~own]) if predictor.training_required and (~own).any() else None
        return pd.DataFrame({"fold": f["test_fold"][own], "idx": f["idx"][own], "actual": y[own], "predicted": predictor.predict(x[own], state)})

    return folds.groupBy("test_fold").applyInPandas(one, "fold int, idx bigint, actual double, predicted double")


class MergeableOffset:
    """The offset predictor as a state of one number, the greatest difference seen, that merges."""

    def state(self, features: list[str], label: str) -> list[Column]:
        return [F.max(F.col(label) - F.col(features[0]))]

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fmax(a, b)

    def finish(self, state: np.ndarray) -> np.ndarray:
        return state

    def predicted(self, features: list[Column], given: Callable[[int], Column]) -> Column:
        return features[0] + given(0)


class LeastSquares:
    """A line or plane through the training rows. State: their number, means and sums of products of differences from the means.

    Where the rows don't tell features apart, the least coefficients that fit as well; without rows, null.
    """

    def state(self, features: list[str], label: str) -> list[Column]:
        cols = [*features, label]
        n = F.count(F.lit(1)).cast("double")
        return [n, *[F.avg(c) for c in cols], *[F.covar_pop(a, b) * n for i, a in enumerate(cols) for b in cols[i:]]]

    @staticmethod
    def _parts(state: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        size = int(round((np.sqrt(8 * len(state) + 1) - 3) / 2))  # 1 + size + size (size + 1) / 2 numbers
        cross = np.zeros((size, size))
        cross[np.triu_indices(size)] = state[1 + size :]
        return state[0], state[1 : 1 + size], cross + np.triu(cross, 1).T

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not a[0] or not b[0]:
            return b if not a[0] else a
        (n, x, s), (m, y, t) = self._parts(a), self._parts(b)
        cross = s + t + np.outer(y - x, y - x) * n * m / (n + m)
        return np.concatenate([[n + m], x + (y - x) * m / (n + m), cross[np.triu_indices(len(x))]])

    def finish(self, state: np.ndarray) -> np.ndarray:
        n, mean, cross = self._parts(state)
        if not n:
            return np.full(len(mean), np.nan)
        slopes = np.linalg.pinv(cross[:-1, :-1], hermitian=True) @ cross[:-1, -1]
        return np.append(slopes, mean[-1] - slopes @ mean[:-1])

    def predicted(self, features: list[Column], given: Callable[[int], Column]) -> Column:
        return sum((f * given(k) for k, f in enumerate(features)), given(len(features)))


MERGEABLE: dict[str, Callable] = {"offset": MergeableOffset, "least_squares": LeastSquares}


def cross_validate_merged(rows: DataFrame, predictor, features: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """rows with `actual` and `predicted`; each fold is predicted by what the others of its group taught.

    Each fold is summed up once, where its rows are; a fold's training state is the merged states of the
    others, from both ends, so no row is copied for a fold and no task is a fold's. The states (a row of
    a few numbers for each fold of each group) pass through the driver, as a fitted model does. Rows with
    a null feature or label teach nothing; a fold whose group has no other rows is predicted null.
    """
    by = by or []
    cols = [*by, "fold"]
    whole = functools.reduce(lambda a, c: a & F.col(c).isNotNull(), [*features, label], F.lit(True))
    teach = rows.where(whole).select(*cols, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, label])])
    stats = teach.groupBy(*cols).agg(*[c.cast("double").alias(f"_s{k}") for k, c in enumerate(predictor.state(features, label))])
    groups: dict[tuple, dict] = {}
    for r in stats.collect():
        groups.setdefault(tuple(r[c] for c in by), {})[r["fold"]] = np.array([np.nan if r[f"_s{k}"] is None else r[f"_s{k}"] for k in range(len(r) - len(cols))])
    folds = [r for r in rows.select(*cols).distinct().collect()]
    kinds = dict(rows.dtypes)
    fitted = []
    for key in dict.fromkeys(tuple(r[c] for c in by) for r in folds):
        own = groups.get(key, {})
        order = sorted(own)
        ahead = list(itertools.accumulate((own[f] for f in order), predictor.merge))
        behind = list(itertools.accumulate((own[f] for f in reversed(order)), predictor.merge))[::-1]
        for fold in {r["fold"] for r in folds if tuple(r[c] for c in by) == key}:
            at = bisect.bisect_left(order, fold)
            after = at + (fold in own)
            sides = [s[k] for s, k in ((ahead, at - 1), (behind, after)) if 0 <= k < len(order)]
            if sides:
                params = predictor.finish(functools.reduce(predictor.merge, sides))
                fitted.append((*key, fold, [None if np.isnan(x) else float(x) for x in params]))
    schema = ", ".join([*(f"_b{k} {kinds[c]}" for k, c in enumerate(by)), f"_fold {kinds['fold']}", "_params array<double>"])
    table = rows.sparkSession.createDataFrame(fitted, schema)
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)], F.col("fold") == F.col("_fold"))
    # Fold and group are few by what they are: each has a state on the driver.
    joined = rows.join(F.broadcast(table), same, "left")
    predicted = predictor.predicted([F.col(c).cast("double") for c in features], lambda k: F.get("_params", F.lit(k)))
    kept = [F.col(c) for c in rows.columns if c not in ("actual", "predicted")]
    return joined.select(*kept, F.col(label).cast("double").alias("actual"), predicted.alias("predicted"))


def offset_folds(rows: DataFrame, feature: str, label: str) -> DataFrame:
    """cross_validate with the offset predictor, as aggregates: per fold, the greatest difference of all other folds."""
    per = rows.groupBy("fold").agg(F.max(F.col(label) - F.col(feature)).alias("m"))
    a, b = per.select(F.col("fold").alias("fold")), per.select(F.col("fold").alias("other"), "m")
    state = a.join(b, a["fold"] != b["other"]).groupBy("fold").agg(F.max("m").alias("state"))
    return rows.join(state, "fold").select("fold", "idx", F.col(label).alias("actual"), (F.col(feature) + F.col("state")).alias("predicted"))


def linear_fit(rows: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


# --- multivariate ---------------------------------------------------------------------------------


def standardised(rows: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """cols centred and scaled by the training rows' mean and deviation, for all rows."""
    stats = rows.where(train).agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_samp(c).alias(f"{c}_s") for c in cols])
    out = rows.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"{c}_m"), F.nullif(f"{c}_s", F.lit(0.0))))
    return out.drop(*[f"{c}_{s}" for c in cols for s in "ms"])


def _vectors(rows: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="vector").transform(rows)


def kmeans_costs(rows: DataFrame, cols: list[str], ks: range, seed: int = 1) -> DataFrame:
    """k and the within-cluster sum of squares, for the elbow."""
    from pyspark.ml.clustering import KMeans

    v = _vectors(rows, cols).select("vector").persist()
    costs = [(k, float(KMeans(k=k, seed=seed, featuresCol="vector").fit(v).summary.trainingCost)) for k in ks if k > 1]
    if 1 in ks:
        costs.append((1, rows.agg(sum((F.var_pop(c) * F.count(c) for c in cols), F.lit(0.0))).first()[0]))
    v.unpersist()
    return rows.sparkSession.createDataFrame(sorted(costs), "k int, cost double")


def principal_components(rows: DataFrame, cols: list[str], k: int) -> DataFrame:
    """component and its share of the variance of the standardised columns."""
    from pyspark.ml.feature import PCA, StandardScaler

    v = _vectors(rows, cols)
    v = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True).fit(v).transform(v)
    shares = PCA(k=k, inputCol="scaled", outputCol="pc").fit(v).explainedVariance.toArray()
    return rows.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(shares)], "component int, share double")


def mahalanobis_between(rows: DataFrame, group: str, cols: list[str], form: str = "mean") -> DataFrame:
    """a, b, distance: symmetrised Mahalanobis distances between groups of rows.

    form "mean": mean of the squared distances; "spread": their median times their deviation. Each
    group's mean and covariance are one small row; distances are computed where the rows are.
    """
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    covs = [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)]
    stats = rows.groupBy(group).agg(*means, *covs).collect()
    k = len(cols)
    model = {}
    for r in stats:
        cov = np.array([[r[f"c{i}_{j}"] for j in range(k)] for i in range(k)], dtype=float)
        model[r[group]] = (np.array([r[f"m{i}"] for i in range(k)], dtype=float), np.linalg.pinv(cov))

    def distances(frames):
        for f in frames:
            x = f[cols].to_numpy(dtype=float)
            for name, (m, inv) in model.items():
                d = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
                yield pd.DataFrame({"a": f[group], "b": name, "d": d})

    kind = dict(rows.dtypes)[group]
    d = rows.select(group, *cols).mapInPandas(distances, f"a {kind}, b {kind}, d double")
    value = F.avg("d") if form == "mean" else F.median("d") * F.stddev_samp("d")
    one = d.groupBy("a", "b").agg(value.alias("v"))
    back = one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("v").alias("u"))
    return one.join(back, ["a", "b"]).select("a", "b", ((F.col("v") + F.col("u")) / 2).alias("distance"))


def row_shares(pairs: DataFrame) -> DataFrame:
    """distance as a share of its row's sum."""
    return pairs.withColumn("share", F.try_divide("distance", F.nullif(F.sum("distance").over(Window.partitionBy("a")), F.lit(0.0))))
