"""Rows dealt into buckets of rising keys, none of them large however the keys are distributed.

Quantiles of the keys cut them into intervals of about equally many rows; an interval that is still
too large is split evenly by value. A key that holds several quantiles by itself, and null keys, are
split by a tie breaker, a 64-bit hash of the row, so that one key with any share of the rows doesn't
meet in one task. Buckets rise with (key, tie breaker), nulls first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERVALS = 256
#: Segments that are told apart by a tree of conditions; more of them are searched.
TREE = 16
INTEGERS = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Segment:
    """Keys from low on; parts buckets from base on, by the tie breaker if they hold one key."""

    low: int
    high: int
    point: bool
    parts: int
    base: int


class Ranges:
    def __init__(self, df: DataFrame, key: str, per_bucket: int, weight: Column | None = None, intervals: int = INTERVALS, most: int | None = None):
        """per_bucket: rows, or units of weight, that a bucket holds on average; most: buckets at most, about."""
        if dict(df.dtypes)[key] not in INTEGERS:
            raise TypeError(f"{key} must be an integer column")
        w = F.lit(1) if weight is None else weight
        shares = [i / intervals for i in range(intervals + 1)]
        row = df.agg(F.percentile_approx(key, shares, 10_000).alias("q"), F.sum(w).alias("n"), F.sum(F.when(F.col(key).isNull(), w)).alias("none")).first()
        self.total, none, found = int(row["n"] or 0), int(row["none"] or 0), [int(x) for x in row["q"] or []]
        if most:
            per_bucket = max(per_bucket, self.total // most)
        self.nulls = max(1, math.ceil(none / per_bucket))
        self.segments = self._cut(found, max(1, math.ceil((self.total - none) / per_bucket)), intervals)

    @staticmethod
    def _cut(found: list[int], need: int, intervals: int) -> list[Segment]:
        out: list[Segment] = []
        base, held = 0, 0  # quantile steps of the open segment
        low = found[0] if found else 0
        values = sorted(set(found))
        for i, c in enumerate(values):
            following = values[i + 1] if i + 1 < len(values) else c + 1
            parts = math.ceil((found.count(c) - 1) * need / intervals)
            if parts >= 2:
                if low < c:
                    out.append(Segment(low, c, False, max(1, math.ceil(held * need / intervals)), base))
                    base += out[-1].parts
                out.append(Segment(c, c + 1, True, parts, base))
                base, low, held = base + parts, c + 1, 0
            held += 1
            if held * need >= intervals and low < following:
                out.append(Segment(low, following, False, max(1, math.ceil(held * need / intervals)), base))
                base, low, held = base + out[-1].parts, following, 0
        if not out or held and low <= values[-1]:
            out.append(Segment(low, (values[-1] if values else low) + 1, False, 1, base))
        return out

    @property
    def count(self) -> int:
        return self.nulls + self.segments[-1].base + self.segments[-1].parts

    def bucket(self, key: str, tie: str) -> Column:
        """The bucket of a row, an int; tie: a bigint column that parts rows of one key."""
        k, t = f"`{key}`", f"`{tie}`"

        def by_tie(parts: int) -> str:
            return "0" if parts == 1 else f"least({parts - 1}, cast(floor((cast({t} as double) / 18446744073709551616.0D + 0.5D) * {parts}) as int))"

        def leaf(s: Segment) -> str:
            if s.point or s.parts == 1:
                return f"{s.base} + {by_tie(s.parts)}"
            # A key beyond the quantiles seen belongs to the outermost part.
            return f"{s.base} + greatest(0, least({s.parts - 1}, cast(floor((cast({k} as double) - {s.low}) * {s.parts} / {s.high - s.low}) as int)))"

        def tree(lo: int, hi: int) -> str:
            if hi - lo == 1:
                return leaf(self.segments[lo])
            mid = (lo + hi) // 2
            return f"case when {k} < {self.segments[mid].low} then {tree(lo, mid)} else {tree(mid, hi)} end"

        none = f"{by_tie(self.nulls)} - {self.nulls}"
        if len(self.segments) <= TREE:
            return F.expr(f"case when {k} is null then {none} else {tree(0, len(self.segments))} end")
        return F.when(F.col(key).isNull(), F.expr(none)).otherwise(self._searched(F.col(key), F.col(tie)))

    def _searched(self, key: Column, tie: Column) -> Column:
        """The same by a search in arrays, so that the plan stays small; a row is searched for once, for all that its segment gives."""
        s = self.segments
        whole = lambda v: F.array(*[F.lit(int(x)) for x in v]).cast("array<bigint>")
        lows, highs, parts, bases, points = whole(x.low for x in s), whole(x.high for x in s), whole(x.parts for x in s), whole(x.base for x in s), whole(x.point for x in s)

        def within(i: Column) -> Column:
            at = lambda a: F.get(a, i)
            share = F.when(at(points) == 1, tie.cast("double") / 18446744073709551616.0 + 0.5).otherwise((key.cast("double") - at(lows)) / (at(highs) - at(lows)))
            return (at(bases) + F.greatest(F.lit(0), F.least(at(parts) - 1, F.floor(share * at(parts))))).cast("int")

        i = F.greatest(F.lit(0), F.size(F.filter(lows, lambda low: low <= key)) - 1)
        return F.get(F.transform(F.array(i), within), 0)
