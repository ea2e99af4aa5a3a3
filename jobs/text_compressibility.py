"""Job 2: how far the texts of a growing table would compress, by group, taking only files that are new.

A file stream with a checkpoint reads the files that it hasn't read yet. Each of its batches adds one partition of
byte pair counts; a batch that runs again after a failure has the same number and the same files, so it replaces its
own partition. The report is made of all counts, never of texts read before.

Written below the output folder:

* pairs, partitioned by batch: the columns of `by`, code, freq (see cellgauge.operators.bytecodes);
* report, partitioned by bucket (a hash of the group): the columns of `by`, n_texts, n_bytes, entropy_0,
  entropy_1, ratio_0, ratio_1;
* checkpoint, the stream's own, unless another folder is named. A checkpoint belongs to one output folder.

A run without new files leaves all as it was. Texts are counted once a row: repeated rows count again, null
texts are empty ones, and null groups are groups of their own.
"""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgauge.operators import bytecodes

log = logging.getLogger("text_compressibility")

FIGURES = "n_texts bigint, n_bytes bigint, entropy_0 double, entropy_1 double, ratio_0 double, ratio_1 double"


def _columns(kinds: dict[str, str], by: list[str]) -> str:
    return ", ".join(f"`{c}` {kinds[c]}" for c in by)


def pairs(spark: SparkSession, out: str, kinds: dict[str, str], by: list[str]) -> DataFrame:
    return spark.read.schema(f"{_columns(kinds, by)}, code bigint, freq bigint, batch bigint").parquet(f"{out}/pairs")


def report(spark: SparkSession, out: str, kinds: dict[str, str], by: list[str]) -> DataFrame:
    return spark.read.schema(f"{_columns(kinds, by)}, {FIGURES}, bucket int").parquet(f"{out}/report").drop("bucket")


def run(spark: SparkSession, documents: str, out: str, config: dict, checkpoint: str | None = None) -> dict[str, int]:
    """Take in the files of documents that are new, and renew the report; batches, texts and bytes taken, groups reported."""
    out, by, text = out.rstrip("/"), list(config["by"]), config["text"]
    checkpoint = checkpoint or f"{out}/checkpoint"
    schema = spark.read.parquet(documents).schema
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    # The folder, so that a table without rows has a report as well.
    empty = spark.createDataFrame([], f"{_columns(kinds, by)}, code bigint, freq bigint, batch bigint")
    empty.write.mode("append").partitionBy("batch").parquet(f"{out}/pairs")
    taken = {"batches": 0, "texts": 0, "bytes": 0}

    def add(rows: DataFrame, batch: int) -> None:
        counted = bytecodes.byte_pairs(rows, text, by).withColumn("batch", F.lit(batch).cast("bigint"))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/pairs")
        second = F.expr(f"code % {bytecodes.SYMBOLS} = {bytecodes.MARK}")
        seen = pairs(spark, out, kinds, by).where(F.col("batch") == batch).agg(F.sum(F.when(second, F.col("freq"))), F.sum(F.when(~second, F.col("freq")))).first()
        taken["batches"] += 1
        taken["texts"] += seen[0] or 0
        taken["bytes"] += seen[1] or 0
        log.info("batch %d: read %d texts of %d bytes from %s, wrote %s/pairs/batch=%d", batch, seen[0] or 0, seen[1] or 0, documents, out, batch)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_trigger"]).parquet(documents)
    query = stream.select(*dict.fromkeys([*by, text])).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    total = pairs(spark, out, kinds, by).groupBy(*by, "code").agg(F.sum("freq").alias("freq"))
    figures = bytecodes.text_ratios(total, by).withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(config["buckets"])).cast("int"))
    figures.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/report")
    taken["groups"] = report(spark, out, kinds, by).count()
    log.info("took %d batches; wrote %d groups to %s/report", taken["batches"], taken["groups"], out)
    return taken


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.text_compressibility", description="Take in new files of texts and report how far they would compress.")
    p.add_argument("documents", help="folder of Parquet files with texts, or a pattern for them")
    p.add_argument("out", help="folder to write to")
    p.add_argument("--checkpoint", help="the stream's checkpoint; by default in the output folder")
    p.add_argument("--config", default=__file__.replace(".py", ".json"))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(a.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName("text_compressibility").getOrCreate()
    try:
        run(spark, a.documents, a.out, config, a.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
