"""A transform codec of blocks of 4 cells per axis, bounded in error, with fields of any size dealt out block by block.

A block's values get a common exponent and become integers; a reversible lifting transform (sums and
differences, two levels along each axis, the finer differences predicted from the coarser) turns smooth
blocks into few large numbers; their bits are written plane by plane in base -2, the numbers that have
become non-zero so far bit by bit and the rest by one mark, down to the lowest plane that the bound needs.
That plane is found by decoding: it is the highest, from a guess downward, at which no value is off by more
than the bound. Blocks that no plane serves (a bound below the integers' step, values that aren't finite)
are kept as they are.

One row is one block, so Spark deals a field out and no task holds a field; a batch of rows is worked on as
one array. Cells that a block lacks, at edges and in holes, and null values are filled with the mean of the
others and not decoded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from ..sources.arrays import coordinates

SIDE = 4
#: Bits of a block's largest integer, and the lowest plane's values that stand for a block of zeros and one kept as it is.
BITS = 50
ZERO, RAW = 254, 255
_NEGABINARY = np.uint64(0xAAAAAAAAAAAAAAAA)


def _lifted(a: np.ndarray, axis: int) -> np.ndarray:
    """The transform along an axis of 4: sum, difference of sums, and both differences less what the first predicts."""
    w, x, y, z = (np.take(a, k, axis) for k in range(4))
    low, high = (w + x) >> 1, (y + z) >> 1
    coarse = low - high
    return np.stack([(low + high) >> 1, coarse, w - x - (coarse >> 1), y - z - (coarse >> 1)], axis)


def _lowered(c: np.ndarray, axis: int) -> np.ndarray:
    total, coarse, first, second = (np.take(c, k, axis) for k in range(4))
    first, second = first + (coarse >> 1), second + (coarse >> 1)
    low = total + ((coarse + 1) >> 1)
    high = low - coarse
    w, y = low + ((first + 1) >> 1), high + ((second + 1) >> 1)
    return np.stack([w, w - first, y, y - second], axis)


def _order(d: int) -> np.ndarray:
    """Coefficients from coarse to fine."""
    level = np.array([0, 1, 2, 2])
    return np.argsort(sum(level[g] for g in np.indices([SIDE] * d)).ravel(), kind="stable")


def forward(q: np.ndarray, d: int) -> np.ndarray:
    """Coefficients of blocks (rows of SIDE**d integers), coarse ones first."""
    a = q.reshape(len(q), *[SIDE] * d)
    for axis in range(1, d + 1):
        a = _lifted(a, axis)
    return a.reshape(len(q), SIDE**d)[:, _order(d)]


def inverse(c: np.ndarray, d: int) -> np.ndarray:
    a = np.empty_like(c)
    a[:, _order(d)] = c
    a = a.reshape(len(c), *[SIDE] * d)
    for axis in range(d, 0, -1):
        a = _lowered(a, axis)
    return a.reshape(len(c), SIDE**d)


def _values(u: np.ndarray, plane: np.ndarray, exponent: np.ndarray, d: int) -> np.ndarray:
    """What blocks decode to from the bits of u from their lowest plane on."""
    kept = u >> plane[:, None].astype(np.uint64) << plane[:, None].astype(np.uint64)
    return np.ldexp(inverse(((kept ^ _NEGABINARY) - _NEGABINARY).view(np.int64), d).astype(float), (exponent - BITS)[:, None])


def _top(u: np.ndarray) -> np.ndarray:
    """The highest plane with a bit, per block, or -1."""
    most = np.bitwise_or.reduce(u, axis=1)
    return np.array([int(x).bit_length() - 1 for x in most], dtype=np.int64)


def _write(u: np.ndarray, low: np.ndarray, top: np.ndarray) -> list[bytes]:
    """The planes of each block from top to low, packed."""
    b, n = u.shape
    size = np.maximum(top - low + 1, 0) * (n + 1) + n
    out, at, held = np.zeros((b, int(size.max(initial=0))), np.uint8), np.zeros(b, np.int64), np.zeros(b, np.int64)
    place = np.arange(n)
    for p in range(int(top.max(initial=-1)), int(low.min(initial=0)) - 1, -1):
        rows = np.flatnonzero((p <= top) & (p >= low))
        bit = (u[rows] >> np.uint64(p)).astype(np.uint8) & 1
        now = np.maximum(held[rows], (bit * (place + 1)).max(axis=1))
        grown = now - held[rows]
        # A one for each number that becomes part of what is written, and a zero unless all are.
        r = np.repeat(rows, grown)
        out[r, np.repeat(at[rows], grown) + np.arange(len(r)) - np.repeat(np.cumsum(grown) - grown, grown)] = 1
        at[rows] += grown + (now < n)
        r = np.repeat(rows, now)
        out[r, np.repeat(at[rows], now) + np.arange(len(r)) - np.repeat(np.cumsum(now) - now, now)] = bit[place < now[:, None]]
        at[rows] += now
        held[rows] = now
    return [np.packbits(row[:end]).tobytes() for row, end in zip(out, at, strict=True)]


def _read(data: list[bytes], low: np.ndarray, top: np.ndarray, n: int) -> np.ndarray:
    b = len(data)
    wide = max((len(x) for x in data), default=0) + 1
    bits = np.unpackbits(np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in data), np.uint8).reshape(b, wide), axis=1)
    u, at, held = np.zeros((b, n), np.uint64), np.zeros(b, np.int64), np.zeros(b, np.int64)
    place = np.arange(n)
    for p in range(int(top.max(initial=-1)), int(low.min(initial=0)) - 1, -1):
        rows = np.flatnonzero((p <= top) & (p >= low))
        more = rows[held[rows] < n]
        while len(more):
            one = bits[more, at[more]] == 1
            at[more] += 1
            more = more[one]
            held[more] += 1
            more = more[held[more] < n]
        now = held[rows]
        r = np.repeat(rows, now)
        seen = np.zeros((len(rows), n), np.uint64)
        seen[place < now[:, None]] = bits[r, np.repeat(at[rows], now) + np.arange(len(r)) - np.repeat(np.cumsum(now) - now, now)]
        u[rows] |= seen << np.uint64(p)
        at[rows] += now
    return u


def encode(values: np.ndarray, d: int, bound: float) -> list[bytes]:
    """Bytes of blocks, rows of SIDE**d numbers each, none of which decodes to values off by more than bound."""
    b = len(values)
    most = np.abs(values).max(axis=1, initial=0.0)
    finite = np.isfinite(values).all(axis=1)
    exponent = np.where(finite, np.frexp(np.where(finite, most, 0.0))[1], 0).astype(np.int64)
    low = np.full(b, RAW)
    low[finite & (most <= bound)] = ZERO
    left = np.flatnonzero(low == RAW) if bound > 0 else np.empty(0, np.int64)
    left = left[finite[left]]
    u, top = np.zeros(values.shape, np.uint64), np.zeros(b, np.int64)
    with np.errstate(over="ignore"):
        u[left] = (forward(np.rint(np.ldexp(values[left], (BITS - exponent[left])[:, None])).astype(np.int64), d).view(np.uint64) + _NEGABINARY) ^ _NEGABINARY
        top[left] = _top(u[left])
        guess = np.clip(np.floor(np.log2(max(bound, 5e-324)) - exponent[left] + BITS).astype(np.int64) + 1, 0, 62)
        while len(left):
            good = np.abs(_values(u[left], guess, exponent[left], d) - values[left]).max(axis=1) <= bound
            low[left[good]] = guess[good]
            left, guess = left[~good & (guess > 0)], guess[~good & (guess > 0)] - 1
    plain = np.flatnonzero(low < ZERO)
    bits = dict(zip(plain.tolist(), _write(u[plain], low[plain], top[plain]), strict=True))
    head = np.rec.fromarrays([low.astype(np.uint8), exponent.astype("<i2"), np.maximum(top, 0).astype(np.uint8)])
    return [head[k].tobytes() + bits[k] if k in bits else bytes([low[k]]) + (values[k].astype("<f8").tobytes() if low[k] == RAW else b"") for k in range(b)]


def decode(data: list[bytes], d: int) -> np.ndarray:
    """The values of blocks, from their bytes alone."""
    n = SIDE**d
    out = np.zeros((len(data), n))
    low = np.array([x[0] for x in data], dtype=np.int64)
    for k in np.flatnonzero(low == RAW):
        out[k] = np.frombuffer(data[k][1:], "<f8")
    plain = np.flatnonzero(low < ZERO)
    if len(plain):
        head = np.frombuffer(b"".join(data[k][1:4] for k in plain), np.dtype([("e", "<i2"), ("t", "u1")]))
        u = _read([data[k][4:] for k in plain], low[plain], head["t"].astype(np.int64), n)
        with np.errstate(over="ignore"):
            out[plain] = _values(u, low[plain], head["e"].astype(np.int64), d)
    return out


def _full(places: pd.Series, values: pd.Series, n: int) -> np.ndarray:
    """Blocks with all their cells, those that aren't there filled in."""
    size = places.map(len).to_numpy(dtype=np.int64)
    out = np.full((len(places), n), np.nan)
    there = np.zeros((len(places), n), bool)
    if size.sum():
        row, at = np.repeat(np.arange(len(size)), size), np.concatenate(places.to_list()).astype(np.int64)
        out[row, at], there[row, at] = np.concatenate(values.to_list()).astype(float), True
    count = there.sum(axis=1)
    with np.errstate(invalid="ignore"):
        mean = np.divide(np.where(there, out, 0.0).sum(axis=1), count, out=np.zeros(len(out)), where=count > 0)
    return np.where(there, out, mean[:, None])


def blocks(cells: DataFrame, dims: list[int]) -> DataFrame:
    """field_id, block (its number along each axis), places and values of each block's cells; null values are left out."""
    coords = coordinates(dims)
    place, step = F.lit(0), 1
    for c in reversed(coords):
        place, step = place + (c % SIDE) * step, step * SIDE
    rows = cells.where("v is not null").select("field_id", F.array(*[F.floor(c / SIDE).cast("bigint") for c in coords]).alias("block"), F.struct(place.cast("int").alias("place"), F.col("v").cast("double").alias("v")).alias("c"))
    packed = rows.groupBy("field_id", "block").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return packed.select("field_id", "block", F.col("c.place").alias("places"), F.col("c.v").alias("values"))


def encoded(d: int, bound: float) -> Column:
    """The bytes of a row's block, from its columns places and values."""

    @F.pandas_udf(BinaryType())
    def run(places: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series(encode(_full(places, values, SIDE**d), d, bound), dtype=object)

    return run("places", "values")


def decoded(d: int, data: str = "data") -> Column:
    """The values at a row's places, from its bytes."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(given: pd.Series, places: pd.Series) -> pd.Series:
        back = decode(given.to_list(), d)
        return pd.Series([row[p] for row, p in zip(back, places, strict=True)], dtype=object)

    return run(data, "places")


def coded_blocks(cells: DataFrame, dims: list[int], bound: float) -> DataFrame:
    """field_id, block, n_cells, data, back (decoded values), max_error and squared_error of each block."""
    d = len(dims)
    if not 1 <= d <= 3:
        raise ValueError(f"{d} dimensions; there must be 1 to 3")
    rows = blocks(cells, dims).withColumn("data", encoded(d, float(bound))).withColumn("back", decoded(d))
    errors = F.transform(F.arrays_zip("values", "back"), lambda x: F.abs(x["values"] - x["back"]))
    rows = rows.withColumn("_e", errors)
    return rows.select("field_id", "block", F.size("places").alias("n_cells"), "data", "back", F.array_max("_e").alias("max_error"), F.aggregate("_e", F.lit(0.0), lambda a, x: a + x * x).alias("squared_error"))


def transform_ratio(cells: DataFrame, dims: list[int], bound: float) -> DataFrame:
    """field_id, n_blocks, ratio (8 bytes a cell over the encoded bytes), max_error and mse, of decoded values."""
    rows = coded_blocks(cells, dims, bound).groupBy("field_id").agg(F.count("*").alias("n_blocks"), F.sum("n_cells").alias("_n"), F.sum(F.length("data")).alias("_bytes"), F.max("max_error").alias("max_error"), F.sum("squared_error").alias("_s"))
    return rows.select("field_id", "n_blocks", (F.col("_n") * 8.0 / F.col("_bytes")).alias("ratio"), "max_error", (F.col("_s") / F.col("_n")).alias("mse"))
