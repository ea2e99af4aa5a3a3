"""Command line and library entry of a whole run: plan tasks, compute what is missing, score by folds."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.codecs import CODECS, compressed
from ..operators.learning import MERGEABLE, PREDICTORS, cross_validate, cross_validate_merged, median_ape, with_folds
from ..sources.arrays import DIMS, SOURCES, pack, read_fields
from ..sources.shared import new_folder
from . import collect
from .catalog import ALL, LABELS, TRAINING, Scheme, describe, load_plugin
from .collect import SCHEMES
from .store import KEY, ResultStore, task_grid

#: Views that are a single field of all rows.
ONE_FIELD = {"emb2d", "evt3d", "ord2d", "part1d"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cellgauge")
    p.add_argument("-a", "--action", choices=("settings", "dataset", "run", "score", "flush"), nargs="*", default=["run"])
    p.add_argument("-k", "--folds", type=int, default=10)
    p.add_argument("-o", "--codec-option", action="append", default=[], help="key=value, applied last")
    p.add_argument("-b", "--codec-early-option", action="append", default=[])
    p.add_argument("-l", "--loader-option", action="append", default=[], help="key=value, applied last; source is a view or raw")
    p.add_argument("-L", "--loader-early-option", action="append", default=[])
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-Q", "--qualified", action="store_true")
    p.add_argument("-D", "--decompress", action="store_true")
    p.add_argument("-R", "--replicates", type=int, default=1)
    p.add_argument("--scheme", help="run and score by a scheme's features and labels")
    p.add_argument("--plugin", action="append", default=[], help="module to import first, which registers schemes, modules or codecs of its own")
    p.add_argument("--previous", action="append", help="key=value, settings of an earlier run that valid features are taken from")
    p.add_argument("--data", default="/root/testdata/sf0.001")
    p.add_argument("--store")
    return p


def settings(pairs: list[str]) -> dict[str, str | list[str]]:
    """Options from key=value texts; a repeated key becomes a list."""
    out: dict = {}
    for s in pairs:
        key, mark, value = s.partition("=")
        if not mark:
            raise ValueError(f"no = in {s!r}")
        out[key] = [*out[key], value] if isinstance(out.get(key), list) else [out[key], value] if key in out else value
    return out


def layered(early: list[str], late: list[str]) -> dict[str, str | list[str]]:
    """Options of both lists; a late one takes the place of an early one with its key."""
    return {**settings(early), **settings(late)}


def typed(options: dict[str, str | list[str]]) -> dict:
    """Options with numbers as numbers, and dims and block_size as lists of them."""

    def one(key: str, value):
        if key in ("dims", "block_size"):
            return [int(x) for v in ([value] if isinstance(value, str) else value) for x in v.strip("[]").split(",")]
        for kind in (int, float):
            try:
                return float(value) if key == "bound" else kind(value)
            except (TypeError, ValueError):
                continue
        return value

    return {k: one(k, v) for k, v in options.items()}


def load(spark: SparkSession, options: dict, data: str) -> DataFrame:
    """Packed arrays of the loader named by source: a view of the tables in data, or raw files with path, dims (slow to fast, a comma between), dtype and glob.

    A view's field becomes one row, so views that are one field of all rows are an error.
    """
    given = {"source": "emb1d", **options}
    source = given.pop("source")
    if source == "raw":
        dims = [int(d) for d in given.pop("dims").split(",")]
        return read_fields(spark, "raw", dims=dims, **given)
    if source not in SOURCES or source in ONE_FIELD:
        raise ValueError(f"no loader {source!r} for a run; there are {sorted({*SOURCES, 'raw'} - ONE_FIELD)}")
    view = read_fields(spark, source, sf_dir=given.pop("path", data))
    if given:
        raise ValueError(f"loader {source!r} has no option {sorted(given)}")
    return pack(view, DIMS[source])


def observe(packed: DataFrame, codec: str, bound: float, decompress: bool = False) -> DataFrame:
    """field_id and values: cheap features and the codec's ratio, as texts by name; with decompress also the errors of the decoded array."""
    c = compressed(packed, codec, bound)
    errors = [x for e in ("max_error", "mse", "psnr") for x in (F.lit(f"error_stat:{e}"), F.col(e).cast("string"))] if decompress else []
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / F.size("values")
    return c.select("field_id", F.create_map(F.lit("range"), F.col("value_range").cast("string"), F.lit("mean"), mean.cast("string"), F.lit("size:ratio"), F.col("ratio").cast("string"), F.lit("codec"), F.lit(codec), *errors).alias("values"))


def run(spark: SparkSession, store: ResultStore, packed: DataFrame, codec: str, bound: float, replicates: int = 1, decompress: bool = False, source: str = "memory") -> DataFrame:
    """Compute the tasks that the store lacks, add them, and return all results; fields whose names aren't whole numbers are stored by a hash of the name.

    With decompress or another source the configuration, and so the tasks, are others.
    """
    ids = {n[:-1]: store.upsert_configs(n, [c]).first()["id"] for n, c in (("experiments", {"name": "default"}), ("datasets", {"source": source}), ("compressors", {"codec": codec, "bound": bound, **({"decompress": True} if decompress else {})}))}
    number = F.coalesce(F.col("field_id").try_cast("bigint"), F.xxhash64("field_id"))
    fields = packed.select(number.alias("field")).distinct()
    todo = store.todo(task_grid(fields, replicates, experiment=ids["experiment"], dataset=ids["dataset"], compressor=ids["compressor"]))
    wanted = packed.withColumn("field", number).join(todo.select("field").distinct(), "field", "left_semi").drop("field")
    seen = observe(wanted, codec, bound, decompress).withColumn("field", number)
    store.upsert_results(todo.join(seen, "field").select(*KEY, "values"))
    return store.load()


def run_scheme(spark: SparkSession, store: ResultStore, packed: DataFrame, scheme: Scheme, settings: dict, replicates: int = 1, source: str = "memory", previous: dict | None = None) -> DataFrame:
    """Compute the scheme's features and labels for the tasks that the store lacks, add them, and return this configuration's results.

    previous: settings of an earlier run into the same store. Features that the change from them leaves valid
    aren't computed again but taken from that run's results; a field that it didn't have is an error that
    names the metric. Labels are always computed.
    """
    ids = _configs(store, source, {"scheme": scheme.name, **settings})
    number = F.coalesce(F.col("field_id").try_cast("bigint"), F.xxhash64("field_id"))
    todo = store.todo(task_grid(packed.select(number.alias("field")).distinct(), replicates, **ids))
    wanted = packed.withColumn("_n", number).join(todo.select(F.col("field").alias("_n")).distinct(), "_n", "left_semi").drop("_n")
    changes, cached = {ALL, TRAINING, LABELS}, None
    if previous is not None:
        changes = {k for k in settings.keys() | previous.keys() if settings.get(k) != previous.get(k)} | {TRAINING, LABELS}
        before = _results(store, _configs(store, source, {"scheme": scheme.name, **previous})).where("replicate = 0")
        names = wanted.select("field_id", number.alias("field")).distinct()
        cached = before.join(names, "field").select("field_id", *[F.col("values")[m].alias(m) for m in scheme.of_usage("feature")])
    found = collect.collect(scheme, changes, wanted, settings, cached).table
    # A label that an array doesn't have, such as the ratio of an empty one, isn't stored.
    pairs = [F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in found.columns if c != "field_id"]
    values = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))
    # Written once: the store reads what it is given several times, and features and codecs are dear.
    folder = new_folder(spark, "observed")
    found.select(number.alias("field"), values.alias("values")).write.parquet(folder)
    seen = spark.read.schema("field bigint, values map<string,string>").parquet(folder)
    store.upsert_results(todo.join(seen, "field").select(*KEY, "values"))
    return _results(store, ids)


def _configs(store: ResultStore, source: str, compressor: dict) -> dict[str, int]:
    """Ids of the experiment, the dataset and the compressor."""
    return {n[:-1]: store.upsert_configs(n, [c]).first()["id"] for n, c in (("experiments", {"name": "default"}), ("datasets", {"source": source}), ("compressors", compressor))}


def _results(store: ResultStore, ids: dict[str, int]) -> DataFrame:
    """The results of one configuration."""
    mine = [F.col(k) == v for k, v in ids.items()]
    return store.load().where(mine[0] & mine[1] & mine[2])


def score_scheme(results: DataFrame, scheme: Scheme, k: int = 10, label: str | None = None) -> DataFrame:
    """Median absolute percentage error per fold of the scheme's own predictor on the results of run_scheme()."""
    from ..sources.arrays import dense_index

    features, label = scheme.of_usage("feature"), label or scheme.of_usage("label")[0]
    rows = results.select("field", "replicate", *[F.col("values")[m].alias(f"_x{i}") for i, m in enumerate(features)], F.col("values")[label].alias("_y"))
    rows = with_folds(dense_index(rows, "field"), k)
    names = [f"_x{i}" for i in range(len(features))]
    if scheme.predictor == "noop":
        made = rows.select("fold", F.col("_y").alias("actual"), F.col("_x0").alias("predicted"))
    else:
        made = cross_validate_merged(rows, MERGEABLE[scheme.predictor](), names, "_y")
    return median_ape(made, ["fold"])


def score(results: DataFrame, feature: str, label: str, predictor: str = "offset", k: int = 10) -> DataFrame:
    """Median absolute percentage error per fold of a predictor on stored results."""
    from ..sources.arrays import dense_index

    rows = dense_index(results.select("field", F.col("values")[feature].alias("x"), F.col("values")[label].alias("y")), "field")
    return median_ape(cross_validate(with_folds(rows, k), PREDICTORS[predictor](), ["x"], "y", k), ["fold"])


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    for name in a.plugin:
        load_plugin(name)
    if a.scheme and a.scheme not in SCHEMES:
        raise SystemExit(f"no scheme {a.scheme!r}; there are {sorted(SCHEMES)}")
    spark = SparkSession.builder.appName("cellgauge").getOrCreate()
    options = layered(a.codec_early_option, a.codec_option)
    loader = layered(a.loader_early_option, a.loader_option)
    codec, bound = options.get("codec", "quant_zlib"), float(options.get("bound", 1e-2))
    if codec not in CODECS:
        raise SystemExit(f"no codec {codec!r}; there are {sorted(CODECS)}")
    scheme = SCHEMES[a.scheme].qualified("pressio" if a.qualified else "") if a.scheme else None
    given = typed({"codec": codec, "bound": str(bound), **options})
    source = json.dumps({"data": a.data, **loader}, sort_keys=True)
    packed = load(spark, loader, a.data)
    store = ResultStore(spark, a.store)
    for action in a.action:
        if action == "settings":
            describe(spark).show(100, False)
        elif action == "dataset":
            packed.select("field_id", "dims", "dtype").show()
        elif action == "run" and scheme:
            done = run_scheme(spark, store, packed, scheme, given, a.replicates, source, typed({**{k: str(v) for k, v in given.items()}, **settings(a.previous)}) if a.previous else None)
            done.show()
        elif action == "score" and scheme:
            score_scheme(_results(store, _configs(store, source, {"scheme": scheme.name, **given})), scheme, a.folds).show()
        elif action == "run":
            done = run(spark, store, packed, codec, bound, a.replicates, a.decompress, json.dumps({"data": a.data, **loader}, sort_keys=True) if loader else "memory")
            if a.verbose:
                done.explain("formatted" if a.verbose > 1 else "simple")
            done.show()
        elif action == "score":
            score(store.load(), "range", "size:ratio", k=a.folds).show()


if __name__ == "__main__":
    main()
