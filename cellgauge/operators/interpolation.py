"""Codes of an interpolating predictor's finest level as window expressions, for fields of any size and 1 to 4 dimensions.

Axis by axis, points with an odd coordinate on that axis (any on the axes before, even ones on those after) are
predicted from their neighbours on the line along it: by a cubic where there are neighbours for one, else by what
there is. Values predicted from are the field's own, so nothing has to be decoded first and each point is by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrays import coordinates, strides
from .codes import CENTER
from .neighbours import with_neighbours

#: Weights of the neighbours at these steps along a line, in order of preference, each with the divisor.
CUBICS = (({-3: -1, -1: 9, 1: 9, 3: -1}, 16), ({-1: 3, 1: 6, 3: -1}, 8), ({-3: -1, -1: 6, 1: 3}, 8), ({-5: 3, -3: -10, -1: 15}, 8), ({-1: 1, 1: 1}, 2), ({-3: -0.5, -1: 1.5}, 1), ({-1: 1}, 1))
STEPS = (-5, -3, -1, 1, 3)


def quantised_step(value: Column, guess: Column, bound: float) -> Column:
    """The code of a value given its guess; 0 where the value is kept as it is."""
    half = F.floor((F.floor(F.abs(value - guess) / bound) + 1) / 2).cast("bigint")
    signed = F.when(value >= guess, half).otherwise(-half)
    good = (half < CENTER) & (F.abs(guess + 2 * signed * bound - value) <= bound)
    return F.when(good, CENTER + signed).otherwise(F.lit(0)).cast("bigint")


def sampled(dims: list[int], axis: int, stride: int) -> Column:
    """Whether a cell is one of the points that the axis predicts, every stride-th on its line."""
    c = coordinates(dims)
    cond = (c[axis] - 1) % (2 * stride) == 0
    for k in range(axis + 1, len(dims)):
        cond = cond & (c[k] % 2 == 0)
    return cond


def finest_codes(cells: DataFrame, dims: list[int], bound: float, stride: int = 5) -> DataFrame:
    """field_id, idx, axis, code of every stride-th odd point of each line; the first of dims may be open (0).

    Cells must be without holes; a null value is a neighbour that isn't there.
    """
    if not 1 <= len(dims) <= 4:
        raise ValueError(f"{len(dims)} dimensions; there must be 1 to 4")
    name = lambda a, s: f"_a{a}_{'m' if s < 0 else 'p'}{abs(s)}"
    size, coords = strides(dims), coordinates(dims)
    rows = with_neighbours(cells, {name(a, s): s * size[a] for a in range(len(dims)) for s in STEPS})
    parts = []
    for a in range(len(dims)):

        def at(s: int, a: int = a) -> Column:
            """The neighbour s steps along the axis, null where the line ends."""
            c = F.col(name(a, s))
            if s < 0:
                return F.when(coords[a] >= -s, c)
            return c if a == 0 else F.when(coords[a] + s < dims[a], c)

        guesses = [sum((F.lit(float(w)) * at(s) for s, w in sorted(ws.items())), F.lit(0.0)) / float(d) for ws, d in CUBICS]
        code = quantised_step(F.col("v"), F.coalesce(*guesses), bound)
        parts.append(F.when(sampled(dims, a, stride) & F.col("v").isNotNull(), F.struct(F.lit(a).alias("axis"), code.alias("code"))))
    # A cell is one axis's point at most: the last one that it is odd on.
    return rows.select("field_id", "idx", F.coalesce(*reversed(parts)).alias("p")).where("p is not null").select("field_id", "idx", "p.axis", "p.code")
