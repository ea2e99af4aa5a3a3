"""Job 1: how well cheap features predict the ratio of a predictive codec, by scheme, array view and error bound.

For each view of the tables, each of its fields and each bound, one row has the features, the ratio that a
Lorenzo-predicting codec with an ideal entropy coder reaches, and what each scheme predicts for the field from
the other folds; the scores are the median and tenths of the absolute percentage errors, per fold and over all.

Written below the output folder:

* observations, partitioned by view and bound: field_id, fold, n_cells, the features, actual;
* predictions, partitioned by view and bound: scheme, field_id, fold, actual, predicted, ape;
* scores, partitioned by view: bound, scheme, fold (-1: all folds), n, medape, p10, p90.

Each view's partitions replace those of an earlier run and no others, so a rerun, also after a failure, leaves the same
files' worth of rows. Predictions are made from the observations as written. A field whose codes have no
entropy has no ratio: it is observed, teaches nothing and isn't scored.
"""

from __future__ import annotations

import argparse
import functools
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.operators import codes, learning
from cellgauge.sources.arrays import DIMS, read_fields

log = logging.getLogger("scheme_benchmark")

FEATURES = "entropy_ratio double, range_bits double, step_bits double"
SCHEMAS = {
    "observations": f"field_id string, fold int, n_cells bigint, {FEATURES}, actual double, view string, bound double",
    "predictions": "scheme string, field_id string, fold int, actual double, predicted double, ape double, view string, bound double",
    "scores": "bound double, scheme string, fold int, n bigint, medape double, p10 double, p90 double, view string",
}


def fold_of(field_id: str, folds: int) -> Column:
    """A fold by a hash of the field's name, so that fields needn't be numbered."""
    return (F.conv(F.substring(F.md5(field_id), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def counted(cells: DataFrame, dims: list[int], bounds: list[float]) -> DataFrame:
    """How often each field's quantised values and their Lorenzo residuals (residual) occur at each bound, and the range of their cells; the cells are read and put in order once."""
    bounds = [float(b) for b in dict.fromkeys(bounds)]
    found = [F.struct(F.lit(b).alias("bound"), F.lit(kind == "r").alias("residual"), F.col(f"{kind}{k}").alias("code")) for k, b in enumerate(bounds) for kind in "qr"]
    rows = codes.values_and_residuals(cells, dims, bounds).select("field_id", "v", F.explode(F.array(*found)).alias("_c"))
    return rows.select("field_id", "v", "_c.*").groupBy("field_id", "bound", "residual", "code").agg(F.count("*").alias("freq"), F.min("v").alias("low"), F.max("v").alias("high"))


def summarised(counts: DataFrame, folds: int) -> DataFrame:
    """field_id, bound, fold, n_cells, features and actual of each field at each bound, from its counts.

    entropy_ratio: 64 bits over the entropy of the quantised values; range_bits: log2 of the range in steps of
    the quantiser; step_bits: log2 of the mean absolute first difference in such steps, and 1.
    """
    key, step, share = ["field_id", "bound"], 2 * F.col("bound"), F.col("freq") / F.col("n").cast("double")
    total = counts.groupBy(*key, "residual").agg(F.sum("freq").alias("n"))
    entropy = lambda mine: -F.sum(F.when(mine, share * F.log2(share)))
    residual = F.col("residual")
    both = counts.join(total, [*key, "residual"]).groupBy(*key).agg(
        entropy(~residual).alias("_values"),
        entropy(residual).alias("_residuals"),
        F.sum(F.when(residual, F.col("freq"))).alias("n_cells"),
        F.sum(F.when(residual, F.abs("code") * F.col("freq"))).alias("_steps"),
        (F.max("high") - F.min("low")).alias("range"),
    )
    ratio = lambda e: F.try_divide(F.lit(64.0), F.nullif(F.round(e, 12), F.lit(0.0)))
    mean_step = F.col("_steps") / F.col("n_cells")
    return both.select("field_id", fold_of("field_id", folds).alias("fold"), "n_cells", ratio("_values").alias("entropy_ratio"), F.log2(F.col("range") / step + 1).alias("range_bits"), F.log2(mean_step + 1).alias("step_bits"), ratio("_residuals").alias("actual"), "bound")


def observe(cells: DataFrame, dims: list[int], bounds: list[float], folds: int) -> DataFrame:
    """summarised() of counted()."""
    return summarised(counted(cells, dims, bounds), folds)


def predict(observations: DataFrame, scheme: str, how: dict) -> DataFrame:
    """The scheme's predictions: each fold of a view and bound from the others."""
    features, by = how["features"], ["view", "bound"]
    if how["predictor"] == "noop":
        rows = observations.withColumn("predicted", F.col(features[0]))
    else:
        rows = learning.cross_validate_merged(observations, learning.MERGEABLE[how["predictor"]](), features, "actual", by)
    error = F.when(F.col("predicted").isNotNull(), learning.ape(F.col("actual"), F.col("predicted")))
    return rows.select(F.lit(scheme).alias("scheme"), "field_id", "fold", "actual", "predicted", error.alias("ape"), *by)


def scores(predictions: DataFrame) -> DataFrame:
    by = ["view", "bound", "scheme"]
    each = learning.median_ape(predictions, [*by, "fold"])
    every = learning.median_ape(predictions, by).withColumn("fold", F.lit(-1))
    return each.unionByName(every)


def _write(rows: DataFrame, out: str, name: str, by: list[str], mine: Column) -> DataFrame:
    """Replace the partitions that rows belong to, and read back what is there: those that mine says."""
    columns = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
    rows.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")
    held = read(rows.sparkSession, out, name).where(mine)
    log.info("wrote %d rows to %s/%s", held.count(), out, name)
    return held


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")


def run(spark: SparkSession, data: str, out: str, config: dict) -> dict[str, int]:
    """Observe, predict and score all views of the tables in data; cells read and rows written by name."""
    out, counts = out.rstrip("/"), {}
    bounds = [float(b) for b in config["bounds"]]
    for view in config["views"]:
        of_view = F.col("view") == view
        seen = counted(read_fields(spark, view, sf_dir=data), DIMS[view], bounds).persist()
        try:
            rows = summarised(seen, config["folds"]).withColumn("view", F.lit(view))
            held = _write(rows, out, "observations", ["view", "bound"], of_view & F.col("bound").isin(bounds))
        finally:
            seen.unpersist()
        cells = held.agg(F.sum("n_cells")).first()[0] or 0
        log.info("read view %s of %s, %d cells at %d bounds", view, data, cells // len(bounds), len(bounds))
        parts = [predict(held, scheme, how) for scheme, how in sorted(config["schemes"].items())]
        made = _write(functools.reduce(DataFrame.unionByName, parts), out, "predictions", ["view", "bound"], of_view & F.col("bound").isin(bounds))
        # Scores of a view are one partition, so they are those of all bounds that there are.
        scored = _write(scores(read(spark, out, "predictions").where(of_view)), out, "scores", ["view"], of_view)
        counts |= {f"{view}:cells": cells // len(bounds), f"{view}:observations": held.count(), f"{view}:predictions": made.count(), f"{view}:scores": scored.count()}
    return counts


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.scheme_benchmark", description="Score prediction schemes on views of the tables.")
    p.add_argument("data", help="folder of the tables")
    p.add_argument("out", help="folder to write to")
    p.add_argument("--config", default=__file__.replace(".py", ".json"))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(a.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("scheme_benchmark").getOrCreate()
    try:
        run(spark, a.data, a.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
