"""The metric catalog: which metrics a change of settings makes invalid, and what a run must compute."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of invalidation classes.
NONDETERMINISTIC, RUNTIME, DEPENDENT, AGNOSTIC, DATA, TRAINING, ALL, LABELS = "predictors:nondeterministic", "predictors:runtime", "predictors:error_dependent", "predictors:error_agnostic", "predictors:data", "predictors:training", "predictors:all", "predictors:collect_labels"
CLASSES = (NONDETERMINISTIC, RUNTIME, DEPENDENT, AGNOSTIC, DATA)
METRIC = "position int, metric string, module string, usage string, causes array<string>, needs_compress boolean, needs_decompress boolean"


@dataclass(frozen=True)
class Metric:
    metric: str
    module: str
    usage: str = "feature"
    causes: tuple[str, ...] = ()
    needs_compress: bool = True
    needs_decompress: bool = True
    #: The module's own name for it, if that is another.
    column: str = ""


@dataclass(frozen=True)
class Scheme:
    """Metrics in declared order, and for each invalidation class the compressor settings that belong to it.

    A class that the compressor doesn't declare holds all its settings; a module without causes has
    every class.
    """

    name: str
    metrics: tuple[Metric, ...]
    settings: dict = field(default_factory=dict, hash=False)
    all_settings: tuple[str, ...] = ()
    predictor: str = "noop"
    training_required: bool = False

    def classes(self, changes: set[str]) -> list[str]:
        """Invalidation classes of a change set."""
        out = {NONDETERMINISTIC}
        if DATA in changes:
            out.add(DATA)
        if ALL in changes:
            return sorted(out | {RUNTIME, DEPENDENT, AGNOSTIC, DATA})
        for key in changes:
            out |= {c for c in (RUNTIME, DEPENDENT, AGNOSTIC) if key in self.settings.get(c, self.all_settings)} | {key}
        return sorted(out)

    def qualified(self, name: str) -> Scheme:
        """The scheme as one of several, its metrics named below name and their module; an empty name gives the plain names again."""
        return replace(self, metrics=tuple(replace(m, metric=f"/{name}/{m.module}:{m.column or m.metric}" if name else m.column or m.metric, column=m.column or m.metric) for m in self.metrics))

    def of_usage(self, usage: str) -> list[str]:
        """The metrics that are features, or labels, in declared order."""
        return [m.metric for m in self.metrics if m.usage == usage]

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(i, m.metric, m.module, m.usage, list(m.causes or CLASSES), m.needs_compress, m.needs_decompress) for i, m in enumerate(self.metrics)]
        return spark.createDataFrame(rows, METRIC)


def is_invalid(classes: Column, training: Column) -> Column:
    return F.arrays_overlap("causes", classes) & ((F.col("usage") == "feature") | training)


def invalidation(scheme: Scheme, spark: SparkSession, cases: dict[str, set[str]]) -> DataFrame:
    """Per case and metric whether it is valid, and what the run must do."""
    rows = [(name, scheme.classes(c), TRAINING in c) for name, c in cases.items()]
    changes = spark.createDataFrame(rows, "case string, classes array<string>, training boolean")
    both = changes.join(scheme.catalog(spark))
    return both.select("case", "position", "metric", "module", "usage", "needs_compress", "needs_decompress", is_invalid(F.col("classes"), F.col("training")).alias("invalid"))


def classes_of(scheme: Scheme, changes: Column) -> Column:
    """Scheme.classes() of a column of change sets, arrays of keys; a null set is an empty one."""
    names = lambda keys: F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    given = F.coalesce(changes, names([]))
    found = [names([NONDETERMINISTIC]), F.when(F.array_contains(given, DATA), names([DATA])).otherwise(names([]))]
    found += [F.when(F.arrays_overlap(given, names(scheme.settings.get(c, scheme.all_settings))), names([c])).otherwise(names([])) for c in (RUNTIME, DEPENDENT, AGNOSTIC)]
    own = F.array_sort(F.array_distinct(F.concat(*found, given)))
    return F.when(F.array_contains(given, ALL), F.array_sort(names([NONDETERMINISTIC, RUNTIME, DEPENDENT, AGNOSTIC, DATA]))).otherwise(own)


def invalidation_log(scheme: Scheme, log: DataFrame, case: str = "case", changes: str = "changes") -> DataFrame:
    """invalidation() of a table of change sets of any length: case, and its changes as an array."""
    rows = log.select(F.col(case).alias("case"), classes_of(scheme, F.col(changes)).alias("classes"), F.coalesce(F.array_contains(changes, TRAINING), F.lit(False)).alias("training"))
    # A scheme has a few metrics; each case meets each of them.
    both = rows.join(F.broadcast(scheme.catalog(log.sparkSession)))
    return both.select("case", "position", "metric", "module", "usage", "needs_compress", "needs_decompress", is_invalid(F.col("classes"), F.col("training")).alias("invalid"))


def modules_to_run(matrix: DataFrame) -> DataFrame:
    """module, n_cases, n_metrics: in how many cases a module has an invalid metric, and how many it has in all of them."""
    return matrix.where("invalid").groupBy("module", "case").agg(F.count("*").alias("n")).groupBy("module").agg(F.count("*").alias("n_cases"), F.sum("n").alias("n_metrics"))


def requirements(matrix: DataFrame, training_required: bool) -> DataFrame:
    """Per case: whether any invalid metric needs compression or decompression, and whether training is needed."""
    return matrix.groupBy("case").agg(F.bool_or(F.col("invalid") & F.col("needs_compress")).alias("compress"), F.bool_or(F.col("invalid") & F.col("needs_decompress")).alias("decompress"), F.lit(training_required).alias("training"))


def ids(matrix: DataFrame) -> DataFrame:
    """Per case and usage: all ids in declared order, valid and invalid ones by name."""
    named = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("metric"))))
    return matrix.groupBy("case", "usage").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "metric"))), lambda x: x["metric"]).alias("all"),
        named(~F.col("invalid")).alias("valid"),
        named(F.col("invalid")).alias("invalid"),
    )


def modules(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("module").agg(F.array_sort(F.collect_set("metric")).alias("metrics"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("causes")))).alias("causes"))


def uses_real_codec(scheme: Scheme, changes: set[str]) -> bool:
    """A real codec runs only if labels are wanted: in a training that the predictor needs, or on request."""
    return scheme.training_required and TRAINING in changes or LABELS in changes


def fresh_or_cached(fresh: DataFrame, cached: DataFrame, metrics: list[str], key: str = "field_id", how: str = "full_outer") -> DataFrame:
    """key and metrics: the fresh number if there is one, else the cached, else an error that names the metric.

    how: full_outer for the keys of both, left for those of fresh alone, whatever the cache holds besides.
    """
    f = fresh.select(key, *[F.col(m).alias(f"_f_{m}") for m in metrics if m in fresh.columns])
    c = cached.select(key, *[F.col(m).alias(f"_c_{m}") for m in metrics if m in cached.columns])
    both = f.join(c, key, how)

    def one(m: str) -> Column:
        found = [F.col(x).cast("string").try_cast("double") for x in (f"_f_{m}", f"_c_{m}") if x in both.columns]
        return F.coalesce(*found, F.raise_error(F.lit(f"no value of {m}")).cast("double")).alias(m)

    return both.select(key, *[one(m) for m in metrics])


#: What the label of every scheme depends on.
_SIZE = Metric("size:ratio", "size", "label", (DEPENDENT, AGNOSTIC, DATA), True, False)

#: The estimators of this package, with the published causes (fixed values); each scheme's label is the ratio of a real codec.
SCHEMES: dict[str, Scheme] = {
    name: Scheme(name, (Metric(f"{name}:ratio", name, "feature", causes, False, False), _SIZE), training_required=False)
    for name, causes in {"sampled_tiles": (DEPENDENT, AGNOSTIC, DATA), "lorenzo_bits": (DEPENDENT, AGNOSTIC, DATA), "interpolation_bits": (DEPENDENT,), "sampled_blocks": (DEPENDENT,)}.items()
} | {
    "neighbours": Scheme("neighbours", tuple(Metric(f"neighbours:{m}", "neighbours", "feature", (DEPENDENT,), False, False) for m in ("value_range", "mean_value", "mean_neighbor_difference", "mean_lorenzo_difference", "mean_spline_difference", "non_constant_block_percentage")) + (_SIZE,), predictor="offset", training_required=True),
}


def load_plugin(name: str):
    """Import a module that registers its own schemes, predictors or codecs."""
    return importlib.import_module(name)


def describe(spark: SparkSession) -> DataFrame:
    """Everything registered: kind, name, detail, version and stability."""
    from .. import __version__
    from ..operators.codecs import CODECS
    from ..operators.learning import PREDICTORS
    from ..sources.arrays import SOURCES

    rows = [("scheme", s.name, ",".join(m.metric for m in s.metrics)) for s in SCHEMES.values()] + [("predictor", p, "") for p in PREDICTORS] + [("codec", c, "") for c in CODECS] + [("source", s, "") for s in SOURCES]
    return spark.createDataFrame([(*r, __version__, "stable" if r[0] != "scheme" else "experimental") for r in rows], "kind string, name string, detail string, version string, stability string")


#: A scheme over mock modules, with the settings of a mock compressor, and the eight changes that are told apart.
MOCK = Scheme(
    "mock",
    (
        Metric("mock:nondeterministic", "mock", "feature", (NONDETERMINISTIC,)),
        Metric("mock:error_dependent", "mock", "feature", (DEPENDENT,)),
        Metric("mock_data:error_agnostic", "mock_data", "feature", (AGNOSTIC,)),
        Metric("mock_data:data", "mock_data", "feature", (DATA,)),
        Metric("size:compression_ratio", "size", "label", (DEPENDENT, AGNOSTIC, DATA)),
    ),
    {RUNTIME: ("mock_compressor:runtime",), DEPENDENT: ("mock_compressor:error_dependent",), AGNOSTIC: ("mock_compressor:error_agnostic",)},
    ("mock_compressor:runtime", "mock_compressor:error_dependent", "mock_compressor:error_agnostic"),
    training_required=True,
)
MOCK_CASES: dict[str, set[str]] = {
    "all": {ALL},
    "all_training": {ALL, TRAINING},
    "training": {TRAINING},
    "data": {DATA},
    "runtime": {"mock_compressor:runtime"},
    "dependent": {"mock_compressor:error_dependent"},
    "agnostic": {"mock_compressor:error_agnostic"},
    "agnostic_runtime": {"mock_compressor:error_agnostic", "mock_compressor:runtime"},
}
