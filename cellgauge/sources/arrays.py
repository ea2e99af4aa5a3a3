"""Arrays as DataFrames: one row per cell (field_id, idx, v), or one row per packed array.

dims are always slow to fast, and idx = (i * Y + j) * X + k. Readers of files whose dims are written
fast to slow reverse them at the boundary.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import Ranges

PACKED = "field_id string, dims array<bigint>, dtype string, values array<double>"
#: Rows that one numbering bucket holds on average.
BUCKET_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strides(dims: list[int]) -> list[int]:
    """Step in idx of each dimension."""
    return [math.prod(dims[k + 1 :]) for k in range(len(dims))]


def coordinates(dims: list[int], idx: str = "idx") -> list[Column]:
    """Coordinate columns of idx; the first isn't reduced by its own size, which may be unknown."""
    s = strides(dims)
    out = [F.expr(f"{idx} div {s[0]}")]
    return out + [F.expr(f"({idx} div {s[k]}) % {dims[k]}") for k in range(1, len(dims))]


def dense_index(df: DataFrame, key: str, out: str = "idx", by: list[str] | None = None) -> DataFrame:
    """df with its rows numbered from 0 by an integer key, within each group of `by`, without one task for all rows.

    Null keys come first; rows with equal keys are numbered by a hash of all their columns. Rows are
    numbered within buckets of rising keys, and the buckets' counts, a small table, give the offsets.
    """
    by = by or []
    tie, bucket, before = "_tie", "_bucket", "_before"
    df = df.withColumn(tie, F.xxhash64(*df.columns))
    df = df.withColumn(bucket, Ranges(df, key, BUCKET_ROWS).bucket(key, tie))
    counts = df.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, bucket, F.coalesce(running, F.lit(0)).alias(before))
    w = Window.partitionBy(*by, bucket).orderBy(F.col(key).asc_nulls_first(), tie)
    numbered = df.withColumn(out, F.row_number().over(w) - 1)
    joined = numbered.alias("a").join(offsets.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, bucket)])
    return joined.select(*[F.col(f"a.{c}") for c in numbered.columns if c not in (tie, bucket, out)], (F.col(f"a.{out}") + F.col(before)).cast("bigint").alias(out))


# --- views of the driver's tables ------------------------------------------------------------------


def emb2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select(F.lit("emb2d").alias("field_id"), (F.col("vec_id") * 64 + F.col("pos")).alias("idx"), F.col("x").cast("double").alias("v"))


def emb1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return e.select(F.col("vec_id").cast("string").alias("field_id"), F.col("pos").cast("bigint").alias("idx"), F.col("x").cast("double").alias("v"))


def evt1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("field_id"), "event_id", F.col("value").alias("v"))
    return dense_index(e, "event_id", by=["field_id"]).select("field_id", "idx", "v")


def evt3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(table(spark, sf_dir, "events").select("event_id", "value"), "event_id").select(F.lit("evt3d").alias("field_id"), "idx", F.col("value").alias("v"))


def ord2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").select(F.lit("ord2d").alias("field_id"), "idx", F.col("o_totalprice").alias("v"))


def part1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_index(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey").select(F.lit("part1d").alias("field_id"), "idx", F.col("p_retailprice").alias("v"))


def grid100(spark: SparkSession) -> DataFrame:
    """ln of the squared ratio sin^2(0.1 i + 0.2 j) / cos(0.1 j) on 100 x 100 cells; ln 0 is null."""
    i, j = F.expr("id div 100"), F.col("id") % 100
    ratio = F.pow(F.pow(F.sin(i * 0.1 + j * 0.2), 2) / F.cos(j * 0.1), 2)
    return spark.range(10_000).select(F.lit("grid100").alias("field_id"), F.col("id").alias("idx"), F.log(ratio).alias("v"))


#: dims of each view with its first dimension open (0).
DIMS = {"emb2d": [0, 64], "emb1d": [0], "evt1d": [0], "evt3d": [0, 10, 10], "ord2d": [0, 50], "part1d": [0], "grid100": [0, 100]}

SOURCES: dict[str, Callable[..., DataFrame]] = {"emb2d": emb2d, "emb1d": emb1d, "evt1d": evt1d, "evt3d": evt3d, "ord2d": ord2d, "part1d": part1d, "grid100": lambda spark, sf_dir=None: grid100(spark)}


# --- loaders ----------------------------------------------------------------------------------------


def from_values(spark: SparkSession, field_id: str, values, dims: list[int] | None = None) -> DataFrame:
    """A packed array from memory."""
    flat = np.asarray(values, dtype=float)
    return spark.createDataFrame([(field_id, [int(d) for d in (dims or flat.shape)], str(np.asarray(values).dtype), flat.ravel().tolist())], PACKED)


def read_raw(spark: SparkSession, path: str, dims: list[int], dtype: str = "float32", pattern: str | None = None, groups: tuple[str, ...] = (), glob: str | None = None) -> DataFrame:
    """Packed arrays from files of raw numbers, one per file; groups of pattern become columns.

    dims are slow to fast; a file of another length is an error.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    n, kind = math.prod(dims), np.dtype(dtype).str

    @F.pandas_udf("array<double>")
    def decode(content: pd.Series) -> pd.Series:
        def one(b):
            x = np.frombuffer(b, dtype=kind)
            if len(x) != n:
                raise ValueError(f"{len(x)} values, not {n}")
            return x.astype(float)

        return content.map(one)

    cols = [F.regexp_extract("path", pattern, k + 1).alias(g) for k, g in enumerate(groups)] if pattern else []
    return files.select(F.element_at(F.split("path", "/"), -1).alias("field_id"), *cols, F.array(*[F.lit(int(d)) for d in dims]).cast("array<bigint>").alias("dims"), F.lit(dtype).alias("dtype"), decode("content").alias("values"))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Metadata of files, without their contents: the column is pruned from the scan."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def read_csv(spark: SparkSession, path: str, names: list[str], drop: int = 0) -> DataFrame:
    """Headerless numbers; the first `drop` columns are left out."""
    df = spark.read.csv(path, schema=", ".join(f"_x{k} double" for k in range(drop)) + (", " if drop else "") + ", ".join(f"`{n}` double" for n in names))
    return df.select(*names)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


def read_fields(spark: SparkSession, source: str, **options) -> DataFrame:
    """One entry for all loaders: a view's name, or raw (packed files), raw_cells (files of any size), csv or memory, with its options."""
    from .raw import read_raw_cells

    loaders = {"raw": read_raw, "raw_cells": read_raw_cells, "csv": read_csv, "memory": from_values}
    found = SOURCES.get(source) or loaders.get(source)
    if found is None:
        raise KeyError(f"no loader {source!r}; there are {sorted([*SOURCES, *loaders])}")
    return found(spark, **options)


def pack(cells: DataFrame, dims: list[int]) -> DataFrame:
    """One row per field; for fields that fit one row."""
    rows = cells.groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("r"))
    return rows.select("field_id", F.array(*[F.lit(d) for d in dims]).cast("array<bigint>").alias("dims"), F.lit("float64").alias("dtype"), F.col("r.v").alias("values"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("field_id", F.posexplode("values").alias("idx", "v")).withColumn("idx", F.col("idx").cast("bigint"))


def gaussian_field(shape: tuple[int, int], reach: float, seed: int, sill: float = 5.0, nugget: float = 1e-8) -> np.ndarray:
    """A random field with exponential covariance, by spectral sampling on a torus; for fixtures."""
    draw = np.random.default_rng(seed)
    y, x = (np.minimum(np.arange(n), n - np.arange(n)) for n in shape)
    cov = sill * np.exp(-np.hypot(y[:, None], x[None, :]) / reach)
    cov[0, 0] += nugget
    power = np.maximum(np.fft.fft2(cov).real, 0)
    noise = draw.standard_normal(shape) + 1j * draw.standard_normal(shape)
    return np.fft.ifft2(np.sqrt(power) * noise * np.sqrt(np.prod(shape))).real
