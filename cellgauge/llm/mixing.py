"""Mixing sources to target weights by Poisson replication.

Each document is repeated N times, N drawn from a Poisson distribution whose mean is the target
repetition rate of its source. N is the inverse of the distribution function at a uniform number
made from a hash of the seed and the document, so a rerun, or a retry of a lost task, draws the same.
Copies are then put in an order given by a hash of seed, document and copy.

Rates: weights are shares of the output, total is its expected number of documents (by default
that of the input), so rate = share * total / documents of the source. A source without a weight
has the default weight; a null source is a source of its own. A mean above PIECE is split into
equal pieces that are drawn one by one and added, which is the same distribution and keeps exp(-mean)
far from zero. Repeated rows with one id draw alike; a row without an id draws by a hash of its text.

An empty table gives an empty one; null and empty texts are documents like others. Columns that are
added (`rate`, `n_copies`, `copy`, `position`) replace those of the same name; any others may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

PIECE = 16.0
#: Terms of the distribution function that are summed for one piece; at a mean of 16 what lies beyond has probability below 1e-25.
TERMS = 90
#: Sources that are broadcast at most; with more of them the join splits the largest.
SENT_SOURCES = 100_000
#: Documents that one output partition holds on average, unless the session asks for more partitions.
PARTITION_ROWS = 20_000
#: Output partitions at most: positions are dealt by their first 7 hexadecimal digits.
PARTITIONS = 1 << 20


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The least n whose distribution function exceeds u."""
    first = F.exp(-mean)
    start = F.struct(F.lit(0).alias("n"), first.alias("p"), first.alias("c"))
    step = lambda a, k: F.when(a["c"] > u, a).otherwise(
        F.struct((a["n"] + 1).alias("n"), (a["p"] * mean / k).alias("p"), (a["c"] + a["p"] * mean / k).alias("c"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["n"])


def source_rates(docs: DataFrame, source: str, weights: dict[str | None, float] | None, default: float, total: int | None) -> tuple[DataFrame, float]:
    """A row for each source: `_source`, documents `_n` and `_rate`; and the expected number of documents in all."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    weight = F.lit(float(default))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("_w", weight)
    # Three numbers come to the driver: the sum of weights, the documents in all and the sources.
    sums = counts.agg(F.sum("_w").alias("w"), F.sum("_n").alias("n"), F.count("*").alias("k")).first()
    wanted = float(total if total is not None else sums["n"] or 0)
    rates = counts.select("_source", "_n", (F.col("_w") * F.lit(wanted) / F.nullif(F.lit(float(sums["w"] or 0)), F.lit(0.0)) / F.col("_n")).alias("_rate"))
    # Few sources are sent to the documents, so a source with a third of them isn't dealt to one task.
    return F.broadcast(rates) if sums["k"] <= SENT_SOURCES else rates, wanted


def identity(docs: DataFrame, doc_id: str, text: str) -> Column:
    """What a document's numbers are drawn by: its id or, for a row without one, a hash of its text."""
    alone = F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))) if text in docs.columns else F.lit("")
    return F.coalesce(F.col(doc_id).cast("string"), alone)


def with_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, default: float = 1.0, total: int | None = None, seed: int = 17, text: str = "text") -> DataFrame:
    """docs with `rate` and `n_copies`."""
    return _with_counts(docs, doc_id, source, weights, default, total, seed, text)[0]


def _with_counts(docs, doc_id, source, weights, default, total, seed, text) -> tuple[DataFrame, float]:
    docs = docs.drop("rate", "n_copies")
    s, r = free(docs, "_source"), free(docs, "_rate")
    rates, wanted = source_rates(docs, source, weights, default, total)
    rates = rates.withColumnsRenamed({"_source": s, "_rate": r}).drop("_n")
    joined = docs.join(rates, docs[source].eqNullSafe(rates[s]), "left").drop(s)
    rate = F.coalesce(r, F.lit(0.0))
    pieces = F.greatest(F.ceil(rate / PIECE), F.lit(1)).cast("int")
    key = identity(docs, doc_id, text)
    drawn = F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), lambda n, i: n + poisson(uniform(F.lit(str(seed)), key, i.cast("string")), rate / pieces))
    return joined.withColumn("rate", rate).withColumn("n_copies", drawn).drop(r), wanted


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, default: float = 1.0, total: int | None = None, seed: int = 17, text: str = "text") -> DataFrame:
    """docs, each row repeated n_copies times, with `rate`, `n_copies`, `copy` (from 0) and `position`, in order of position.

    `position` is the hash that orders all copies. It is uniform, so its first digits say which of
    equally wide ranges, one for each output partition, a row lies in: that is the global shuffle,
    without a pass that samples the rows first. Rows of one source, or copies of one document,
    spread over all partitions.
    """
    docs = docs.drop("rate", "n_copies", "copy", "position")
    out, wanted = _with_counts(docs, doc_id, source, weights, default, total, seed, text)
    out = out.where(F.col("n_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = identity(docs, doc_id, text)
    out = out.withColumn("position", F.substring(F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), key, F.col("copy").cast("string"))), 1, 16))
    n = min(PARTITIONS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(wanted) // PARTITION_ROWS))
    part = (F.conv(F.substring("position", 1, 7), 16, 10).cast("bigint") * n / F.lit(1 << 28)).cast("int")
    return out.repartitionById(n, part).sortWithinPartitions("position", doc_id)
