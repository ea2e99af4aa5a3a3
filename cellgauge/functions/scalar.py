"""Scalar functions of the engine as column expressions."""


import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def rescale(x: Column, a, b, c, d) -> Column:
    """x from [a, b] to [c, d]; null if a = b."""
    col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    a, b, c, d = map(col, (a, b, c, d))
    return F.try_divide(x - a, F.nullif(b - a, F.lit(0.0))) * (d - c) + c


def spline4(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (-a + 9 * b + 9 * c - d) / 16.0


def absolute_percentage_error(actual: Column, predicted: Column, signed: bool = False) -> Column:
    """|actual - predicted| / |actual|, 0 for an actual of 0; signed divides by the actual itself."""
    return F.when(actual == 0, 0.0).otherwise(F.abs(actual - predicted) / (actual if signed else F.abs(actual)))


def split_setting(s: Column) -> Column:
    """struct<key, value> of `key=value`, parted at the first `=`; an error without one."""
    at = F.instr(s, "=")
    checked = F.when(at > 0, s).otherwise(F.raise_error(F.concat(F.lit("no = in "), s)))
    return F.struct(F.substring(checked, F.lit(1), at - 1).alias("key"), F.substring(checked, at + 1, F.length(s)).alias("value"))


def as_number(s: Column) -> Column:
    return s.try_cast("double")


def first_number(*candidates: Column, name: str = "value") -> Column:
    """The first candidate that is a number, an error if none is."""
    return F.coalesce(*[as_number(c.cast("string")) for c in candidates], F.raise_error(F.lit(f"{name} is neither computed nor cached")).cast("double"))


def manhattan(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.abs(r1 - r2) + F.abs(c1 - c2)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@F.pandas_udf(DoubleType())
def normal_tail(x: pd.Series) -> pd.Series:
    """Probability that a standard normal variable exceeds x."""
    return x.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))
