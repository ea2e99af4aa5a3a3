"""The result store: configurations by content hash, results by a five-part key, entries as (result, metric, value).

A store is a folder of Parquet tables, or temporary views when it has none. Upserts are
insert-ignore: rows whose key is there already are left out by an anti join.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets that new rows are numbered in; their counts are the only rows that meet in one task.
BUCKETS = 1024
CONFIG = "id bigint, hash string, config string"
KEY = ["experiment", "compressor", "dataset", "field", "replicate"]
SCHEMAS = {
    "experiments": CONFIG,
    "datasets": CONFIG,
    "compressors": CONFIG,
    "metrics": "id bigint, value string",
    "results": "id bigint, experiment bigint, compressor bigint, dataset bigint, field bigint, replicate bigint",
    "entries": "result bigint, metric bigint, value double",
}


def canonical_json(options: dict) -> str:
    return json.dumps(options, sort_keys=True, separators=(",", ":"))


def canonical_column(names: list[str]) -> Column:
    """The canonical JSON of columns, as canonical_json() would write them: sorted by name, null ones left out."""
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in sorted(names)]))


def config_rows(spark: SparkSession, configs: list[dict]) -> DataFrame:
    """hash (SHA-256 of the canonical JSON) and config."""
    return spark.createDataFrame([(canonical_json(c),) for c in configs], "config string").select(F.sha2("config", 256).alias("hash"), "config")


def numbered(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """new with ids that follow the greatest in old: numbered within buckets of a hash, by order, plus the counts of the buckets before."""
    top = old.agg(F.max("id")).first()[0] or 0
    new = new.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int"))
    counts = new.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy("_bucket").orderBy(*order)
    return new.join(offsets, "_bucket").withColumn("id", (F.row_number().over(w) + F.col("_before") + top).cast("bigint")).drop("_bucket", "_before")


def missing(rows: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key isn't in old, each key once."""
    return rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def numeric_entries(rows: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """keys, metric and value of each option that is a number."""
    e = rows.select(*keys, F.explode(values).alias("metric", "text"))
    return e.withColumn("value", F.col("text").try_cast("double")).where(F.col("value").isNotNull()).drop("text")


class ResultStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self.views: dict[str, DataFrame] = {}
        for name, schema in SCHEMAS.items():
            if self.path is None:
                self.views[name] = spark.createDataFrame([], schema)
            else:
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.views[name] if self.path is None else self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows = rows.select(*[c.split(" ")[0] for c in SCHEMAS[name].split(", ")])
        if self.path is None:
            self.views[name] = self.views[name].unionByName(rows)
        else:
            rows.write.mode("append").parquet(f"{self.path}/{name}")

    def upsert_configs(self, name: str, configs: list[dict]) -> DataFrame:
        """id and hash of each configuration, new or not."""
        rows, old = config_rows(self.spark, configs), self.table(name)
        valid = F.when(is_json(F.col("config")), F.col("config")).otherwise(F.raise_error(F.concat(F.lit("no JSON: "), F.col("config"))).cast("string"))
        rows = rows.withColumn("config", valid)
        self._append(name, numbered(missing(rows, old, ["hash"]), old, ["hash"]))
        return self.table(name).join(rows.select("hash").distinct(), "hash", "left_semi")

    def upsert_results(self, observations: DataFrame) -> None:
        """observations: the key and values map<string,string>; what isn't a number isn't stored."""
        fresh = missing(observations, self.table("results"), KEY)
        new = numbered(fresh, self.table("results"), KEY)
        entries = numeric_entries(new, ["id"])
        names = entries.select(F.col("metric").alias("value")).distinct()
        self._append("metrics", numbered(missing(names, self.table("metrics"), ["value"]), self.table("metrics"), ["value"]))
        m = self.table("metrics").select(F.col("id").alias("mid"), F.col("value").alias("metric"))
        rows = entries.join(m, "metric").select(F.col("id").alias("result"), F.col("mid").alias("metric"), "value")
        self._append("entries", rows.dropDuplicates(["result", "metric"]))
        self._append("results", new)

    def load(self) -> DataFrame:
        """The key and values map<string,double> of each result."""
        e = self.table("entries").join(self.table("metrics").withColumnRenamed("value", "name"), F.col("metric") == F.col("id")).select("result", "name", "value")
        maps = e.groupBy("result").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))
        return self.table("results").join(maps, F.col("id") == F.col("result"), "left").select(*KEY, "values")

    def wide(self, names: list[str]) -> DataFrame:
        """The key and one column per metric."""
        e = self.table("entries").join(self.table("metrics").withColumnRenamed("value", "name"), F.col("metric") == F.col("id")).select("result", "name", "value")
        p = e.groupBy("result").pivot("name", names).agg(F.first("value"))
        return self.table("results").join(p, F.col("id") == F.col("result"), "left").drop("id", "result")

    def todo(self, tasks: DataFrame) -> DataFrame:
        return tasks.join(self.table("results"), KEY, "left_anti")

    def done(self, tasks: DataFrame) -> DataFrame:
        return tasks.join(self.table("results"), KEY, "left_semi")


def task_grid(fields: DataFrame, replicates: int, **ids: int) -> DataFrame:
    """Every field in every replicate, with the ids of its configurations."""
    r = fields.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
    return fields.select("field").crossJoin(r).select(*[F.lit(ids.get(k, 0)).cast("bigint").alias(k) for k in KEY[:3]], "field", "replicate")


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    return spark.sql(sql, args=args)


def query_one(spark: SparkSession, sql: str, **args):
    """The only row of a query; none or several are an error."""
    rows = spark.sql(sql, args=args).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} row")
    return rows[0]


def timed(action, warmup: int = 2, repeat: int = 30) -> dict[str, float]:
    """Milliseconds of repeated runs, warm-ups left out: mean, deviation, least and greatest."""
    import statistics

    took = []
    for k in range(warmup + repeat):
        t = time.perf_counter()
        action()
        if k >= warmup:
            took.append((time.perf_counter() - t) * 1000)
    return {"mean": statistics.fmean(took), "sd": statistics.stdev(took) if len(took) > 1 else 0.0, "min": min(took), "max": max(took)}


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()
