"""Simulation and scheduling studies; timings come as (method, codec, mean, sd) rows."""

from __future__ import annotations

import heapq
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_tail

#: Published codec and estimator timings in seconds, mean and deviation.
TIMINGS = [
    ("none", "sz", 0.009, 0.014), ("none", "sz3", 0.032, 0.0005), ("none", "mgard", 0.2083, 0.0084), ("none", "digit_rounding", 0.0099, 0.0002), ("none", "tthresh", 0.4303, 0.0034),
    ("sampling", "sz", 0.009, 0.005), ("sampling", "sz3", 0.0038, 0.0012), ("sampling", "mgard", 1.232, 0.0061), ("sampling", "digit_rounding", 0.0009, 0.0015), ("sampling", "tthresh", 0.0102, 0.0021),
    ("tiles", "sz", 0.0021, 0.0058), ("tiles", "sz3", 0.0021, 0.0058), ("tiles", "mgard", 0.0021, 0.0058), ("tiles", "digit_rounding", 0.0021, 0.0058), ("tiles", "tthresh", 0.0021, 0.0058),
]


def timings(spark) -> DataFrame:
    return spark.createDataFrame(TIMINGS, "method string, codec string, mean double, sd double")


def search_speedup(t: DataFrame, steps: int = 49) -> DataFrame:
    """log2 of the cost of a search of steps + 2 compressions over that with estimates and one compression."""
    base = t.where("method = 'none'").select("codec", F.col("mean").alias("mean_baseline"))
    cost = t.join(base, "codec").withColumn("cost", F.when(F.col("method") == "none", (steps + 2) * F.col("mean")).otherwise((steps + 1) * F.col("mean") + F.col("mean_baseline")))
    none = cost.where("method = 'none'").select("codec", F.col("cost").alias("cost_baseline"))
    out = cost.where("method <> 'none'").join(none, "codec")
    return out.select("codec", "method", F.log2(F.col("cost_baseline") / F.col("cost")).alias("speedup"))


def best_codec_speedup(t: DataFrame) -> DataFrame:
    """Cost of trying every codec, over that of estimating each: one row per method, slowest first."""
    cost = t.groupBy("method").agg(F.sum("mean").alias("cost"))
    none = cost.where("method = 'none'").select(F.col("cost").alias("none"))
    return cost.where("method <> 'none'").crossJoin(F.broadcast(none)).select("method", (F.col("none") / F.col("cost")).alias("speedup"))


def list_schedule(times: list[float], processors: int, longest_first: bool = True) -> float:
    """Makespan of greedy list scheduling."""
    load = [0.0] * processors
    for t in sorted(times, reverse=True) if longest_first else times:
        heapq.heapreplace(load, load[0] + t)
    return max(load, default=0.0)


def makespans(tasks: DataFrame, processors: int, longest_first: bool = True) -> DataFrame:
    """scenario and makespan; tasks: scenario, time. A scenario is scheduled by one task, scenarios in parallel."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scenario": [f["scenario"].iloc[0]], "makespan": [list_schedule(f["time"].tolist(), processors, longest_first)]})

    return tasks.groupBy("scenario").applyInPandas(one, "scenario string, makespan double")


def parallel_writes(t: DataFrame, buffers: int = 3840, processors: int = 128, write: float = 0.027) -> DataFrame:
    """Mean-time model of writing buffers in waves, with every buffer tried, or estimated and then scheduled."""
    waves = -(-buffers // processors)
    none = t.where("method = 'none'").select("codec", F.col("mean").alias("none"))
    total = F.when(F.col("method") == "none", waves * (F.col("mean") + write)).otherwise(waves * (F.col("mean") + F.col("none") + write))
    return t.join(none, "codec").select("codec", "method", total.alias("seconds"))


def smallest_cover(needs: dict[str, set[frozenset]], names: list[str]) -> list[str]:
    """The fewest names such that each need has one of its sets chosen in full; all subsets are tried by size."""
    for n in range(len(names) + 1):
        for c in combinations(names, n):
            got = set(c)
            if all(any(s <= got for s in sets) for sets in needs.values()):
                return list(c)
    return []


def misranking(cases: DataFrame) -> DataFrame:
    """Chance of ranking two means wrongly, with and without estimation error, and the relative change; cases: d, sigma, sigma_e."""
    with_e = normal_tail(F.col("d") / F.sqrt(2 * F.col("sigma") ** 2 + 2 * F.col("sigma_e") ** 2))
    without = normal_tail(F.col("d") / F.sqrt(2 * F.col("sigma") ** 2))
    return cases.withColumn("with_error", with_e).withColumn("without_error", without).withColumn("change", (F.col("without_error") - F.col("with_error")) / F.col("without_error"))


def noisy_search(levels: list[float], points: int = 601, seed: int = 0) -> list[tuple[float, float]]:
    """(deviation, loss) of minimising (x - 1)(x + 2) on [-3, 3] when each value has a fixed error."""
    import numpy as np

    x = np.linspace(-3, 3, points)
    f = (x - 1) * (x + 2)
    draw = np.random.default_rng(seed)
    return [(s, float(f[np.argmin(f + draw.normal(0, s, points))] + 2.25)) for s in levels]


def running_max_steps(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows with the running maximum of value, of each maximum the first row only."""
    w = Window.partitionBy("series").orderBy(order)
    run = rows.withColumn("running_max", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy("series", "running_max").orderBy(order)
    return run.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
