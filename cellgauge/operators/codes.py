"""Quantisation codes: histograms, entropy, and the bit model that turns a histogram into a ratio."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrays import coordinates
from .neighbours import lorenzo_offsets, with_neighbours

#: Code of an exact hit, and bits of a number that can't be predicted.
CENTER = 32768
RAW_BITS = 32


def quantised(v: Column, bound: float) -> Column:
    """The nearest multiple of 2 * bound, as its number."""
    return F.floor(v / (2 * bound) + 0.5).cast("bigint")


def to_grid(v: Column, bound: float, how: str = "round") -> Column:
    """v on a grid of step bound."""
    return F.floor(v / bound + (0.5 if how == "round" else 0.0)) * bound


def _lorenzo_names(dims: list[int]) -> dict[str, int]:
    """Names of the columns of a cell's corners, and their offsets."""
    return {f"l{k}": o for k, o in enumerate(sorted(lorenzo_offsets(dims)))}


def _lorenzo_guess(dims: list[int], value: Callable[[Column], Column]) -> Column:
    """The signed sum of a cell's corners, each as value says; beyond an edge counts 0."""
    offs, coords, steps = lorenzo_offsets(dims), coordinates(dims), [1]
    for d in dims[:0:-1]:
        steps.insert(0, steps[0] * d)
    total = F.lit(0)
    for n, o in _lorenzo_names(dims).items():
        # Which axes this corner steps back along: they need a coordinate above 0.
        rest, ok = -o, F.lit(True)
        for c, s in zip(coords, steps, strict=True):
            if rest >= s:
                rest -= s
                ok = ok & (c > 0)
        total = total + F.when(ok, offs[o] * F.coalesce(value(F.col(n)), F.lit(0))).otherwise(0)
    return total


def lorenzo_codes(cells: DataFrame, dims: list[int], bound: float) -> DataFrame:
    """field_id, idx, code: Lorenzo residuals of numbers that are quantised first; beyond an edge counts 0."""
    q = cells.withColumn("v", quantised(F.col("v"), bound))
    rows = with_neighbours(q, _lorenzo_names(dims))
    return rows.select("field_id", "idx", (F.col("v") - _lorenzo_guess(dims, lambda c: c)).cast("bigint").alias("code"))


def values_and_residuals(cells: DataFrame, dims: list[int], bounds: list[float]) -> DataFrame:
    """field_id, idx, v and, of the k-th bound, the quantised value q<k> and its Lorenzo residual r<k>; neighbours are found once for all bounds."""
    rows = with_neighbours(cells.select("field_id", "idx", "v"), _lorenzo_names(dims))
    out = []
    for k, b in enumerate(bounds):
        q = quantised(F.col("v"), b)
        out += [q.alias(f"q{k}"), (q - _lorenzo_guess(dims, lambda c, b=b: quantised(c, b))).cast("bigint").alias(f"r{k}")]
    return rows.select("field_id", "idx", "v", *out)


def histogram(codes: DataFrame) -> DataFrame:
    return codes.groupBy("field_id", "code").agg(F.count("*").alias("freq"))


def with_share(hist: DataFrame) -> DataFrame:
    total = hist.groupBy("field_id").agg(F.sum("freq").alias("n"))
    return hist.join(total, "field_id").withColumn("f", F.col("freq") / F.col("n").cast("double"))


def entropy(hist: DataFrame) -> DataFrame:
    """Shannon entropy in bits of each field's codes."""
    return with_share(hist).groupBy("field_id").agg((-F.sum(F.col("f") * F.log2("f"))).alias("entropy"))


def bits(f: Column, code: Column, center: int, raw: int | None) -> Column:
    """Bits that the model gives a code of share f; none for shares below 2^-32."""
    b = -F.log2(f)
    out = F.when(b >= 32, 0.0).when(b >= 1, b).when(code == center, 1.0).when(F.abs(code - center) == 1, 2.5).otherwise(4.0)
    return F.when(code == raw, float(RAW_BITS)).otherwise(out) if raw is not None else out


def code_bits(hist: DataFrame, center: int = 0, raw: int | None = None) -> DataFrame:
    """Mean bits per value and the ratio 32 / bits, per field."""
    rows = with_share(hist).withColumn("b", F.col("f") * bits(F.col("f"), F.col("code"), center, raw))
    return rows.groupBy("field_id").agg(F.sum("b").alias("mean_bits")).withColumn("ratio", F.try_divide(F.lit(32.0), F.nullif("mean_bits", F.lit(0.0))))


def corrected_ratio(hist: DataFrame, center: int = 0, raw: int | None = None) -> DataFrame:
    """The ratio corrected for runs of the centre code.

    B: mean bits; P0: the centre's share of them (by its count if it has over half of the codes, by
    its information else); rho = max(1, 1 / ((1 - f) P0 + 1 - P0)); ratio = 32 rho / B.
    """
    rows = with_share(hist).withColumn("b", F.col("f") * bits(F.col("f"), F.col("code"), center, raw))
    agg = rows.groupBy("field_id").agg(F.sum("b").alias("mean_bits"), F.max(F.when(F.col("code") == center, F.col("f"))).alias("fc"), F.max(F.when(F.col("code") == center, F.col("freq"))).alias("nc"), F.max("n").alias("n"))
    fc = F.coalesce("fc", F.lit(0.0))
    info = F.when(fc > 0, -fc * F.log2(fc)).otherwise(0.0)
    p0 = F.try_divide(F.when(F.coalesce("nc", F.lit(0)) > F.expr("n div 2"), fc).otherwise(info), F.nullif("mean_bits", F.lit(0.0)))
    rho = F.greatest(F.lit(1.0), F.try_divide(F.lit(1.0), F.nullif((1 - fc) * p0 + 1 - p0, F.lit(0.0))))
    return agg.select("field_id", "mean_bits", p0.alias("p0"), rho.alias("rho"), F.try_divide(32.0 * rho, F.nullif("mean_bits", F.lit(0.0))).alias("ratio"))


def refined_ratio(hist: DataFrame, k: int = 5, center: int = 0, raw: int | None = None) -> DataFrame:
    """The ratio corrected for runs, once of the centre code alone and once of the most frequent codes as well.

    With B the mean bits, f a code's share of the codes and P its share of the bits (the centre's by corrected_ratio's
    rule, another code's by its information), what is left of the bits is the sum of (1 - f) P over the codes
    looked at and of 1 - P for the rest; codes: the centre, and those of the k most frequent that aren't it.
    """
    total = corrected_ratio(hist, center, raw).withColumnRenamed("ratio", "lossless_ratio")
    top = with_share(hist).join(top_codes(hist, k, center).select("field_id", "code"), ["field_id", "code"]).join(total.select("field_id", "mean_bits"), "field_id")
    info = F.try_divide(-F.col("f") * F.log2("f"), F.nullif("mean_bits", F.lit(0.0)))
    more = top.groupBy("field_id").agg(F.sum((1 - F.col("f")) * info).alias("_left"), F.sum(info).alias("_share"))
    fc = with_share(hist).groupBy("field_id").agg(F.coalesce(F.max(F.when(F.col("code") == center, F.col("f"))), F.lit(0.0)).alias("_fc"))
    both = total.join(fc, "field_id").join(more, "field_id", "left").na.fill(0.0, ["_left", "_share"])
    left = (1 - F.col("_fc")) * F.col("p0") + F.col("_left") + 1 - F.col("p0") - F.col("_share")
    return both.select("field_id", "mean_bits", "lossless_ratio", F.try_divide(F.lit(32.0), F.nullif(left * F.col("mean_bits"), F.lit(0.0))).alias("refined_ratio"))


def top_codes(hist: DataFrame, k: int = 5, center: int = 0) -> DataFrame:
    """The k most frequent codes per field, then without the centre; ties by code."""
    w = F.row_number().over(_rank())
    return hist.withColumn("rank", w).where(F.col("rank") <= k).where(F.col("code") != center)


def _rank():
    from pyspark.sql import Window

    return Window.partitionBy("field_id").orderBy(F.col("freq").desc(), "code")


def quant_entropy_ratio(cells: DataFrame, bound: float, bits_raw: int = 64) -> DataFrame:
    """Codec of quantised values at their Shannon entropy: entropy and ratio to raw bits per field."""
    hist = cells.select("field_id", quantised(F.col("v"), bound).alias("code")).groupBy("field_id", "code").agg(F.count("*").alias("freq"))
    return entropy(hist).withColumn("ratio", F.try_divide(F.lit(float(bits_raw)), F.nullif(F.round("entropy", 12), F.lit(0.0))))
