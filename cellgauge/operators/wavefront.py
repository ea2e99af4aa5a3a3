"""Closed-loop Lorenzo prediction of fields larger than a task, in 1 to 3 dimensions.

The scan predicts each cell from cells that are decoded already, so a field is dealt into blocks, and blocks whose
numbers add up to the same are one wave: each is scanned where it is, from the faces that the blocks below it
decoded to. A wave's faces are written to the shared folder and read by the next, so what a task
holds is a block and its faces, and a lost executor costs a wave. A field of n blocks a side takes d * (n - 1) + 1
waves; fields go through them side by side. Blocks are as long as their number of cells allows, so a narrow field
is cut along its long axis alone, into few.

Within a block, cells whose coordinates add up to the same depend on none of each other and are decoded as one array.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.arrays import strides
from ..sources.shared import new_folder
from .codes import CENTER

#: Cells of a block, and dimensions that a field may have.
BLOCK_CELLS = 1 << 20
MOST_DIMS = 3
CODES = "field_id string, code bigint, freq bigint"


def block_sides(dims: list[int], cells: int = BLOCK_CELLS) -> list[int]:
    """Cells of a block along each axis: equally many, except that short axes are taken whole and the others, an open one (0) too, get what those leave."""
    sides, left, open_axes = [0] * len(dims), cells, len(dims)
    for k in sorted(range(len(dims)), key=lambda k: dims[k] or math.inf):
        equal = max(1, math.floor(left ** (1 / open_axes) + 1e-9))
        sides[k] = min(dims[k], equal) if dims[k] else equal
        left, open_axes = left // sides[k], open_axes - 1
    return sides


def quantised(value: np.ndarray, guess: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(codes, decoded values); code 0 keeps a value as it is."""
    half = (np.floor(np.abs(value - guess) / bound) + 1) // 2
    signed = np.where(value >= guess, half, -half)
    back = guess + 2 * signed * bound
    good = (half < CENTER) & (np.abs(back - value) <= bound)
    return np.where(good, CENTER + signed, 0).astype(np.int64), np.where(good, back, value)


def scan_line(x: np.ndarray, before: float, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(codes, decoded values) of a line after a decoded value: scan_block() for one dimension, where each cell depends on the last."""
    codes, backs, guess = [], [], float(before)
    for v in x.tolist():
        code, back = 0, v
        steps = abs(v - guess) / bound
        if steps < 2 * CENTER - 1:
            half = (math.floor(steps) + 1) >> 1
            signed = half if v >= guess else -half
            found = guess + 2 * signed * bound
            if abs(found - v) <= bound:
                code, back = CENTER + signed, found
        codes.append(code)
        backs.append(back)
        guess = back
    return np.array(codes, np.int64), np.array(backs)


def scan_block(x: np.ndarray, known: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(codes, decoded with a face in front of each axis) of a block; known: an array one larger on each axis, of which the faces are set."""
    if x.ndim == 1:
        codes, back = scan_line(x, known[0], bound)
        return codes, np.concatenate([known[:1], back])
    grid = np.indices(x.shape).reshape(x.ndim, -1)
    level = grid.sum(axis=0)
    order = np.argsort(level, kind="stable")
    ends = np.cumsum(np.bincount(level))
    # Places in the flat arrays, level by level; a corner lies a fixed number of places before its cell.
    back = known.ravel()
    at, value = np.ravel_multi_index(tuple(grid + 1), known.shape)[order], x.ravel()[order]
    corners = [(int(np.ravel_multi_index(c, known.shape)), 1 if sum(c) % 2 else -1) for c in itertools.product((0, 1), repeat=x.ndim) if any(c)]
    found = np.zeros(x.size, np.int64)
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        here, guess = at[lo:hi], 0
        for step, sign in corners:
            guess = guess + sign * back[here - step]
        found[lo:hi], back[here] = quantised(value[lo:hi], guess, bound)
    codes = np.empty(x.size, np.int64)
    codes[order] = found
    return codes.reshape(x.shape), back.reshape(known.shape)


def lorenzo_histograms(cells: DataFrame, dims: list[int], bound: float, every: int = 1, block: list[int] | None = None) -> DataFrame:
    """field_id, code, freq: every so-manieth code, in order of idx, of a closed-loop scan of each field.

    cells: field_id, idx, v without holes or nulls; dims are the same for all fields, the first may be open (0).
    """
    d = len(dims)
    if not 1 <= d <= MOST_DIMS:
        raise ValueError(f"{d} dimensions; there must be 1 to {MOST_DIMS}")
    block, spark = block or block_sides(dims), cells.sparkSession
    folder = new_folder(spark, "waves")
    size, names = strides(dims), [f"b{k}" for k in range(d)]
    dealt = cells.select("field_id", *[F.expr(f"({c}) div {n}").cast("int").alias(b) for c, n, b in zip(_texts(dims), block, names, strict=True)], F.struct("idx", F.col("v").cast("double").alias("v")).alias("c"))
    dealt.groupBy("field_id", *names).agg(F.array_sort(F.collect_list("c")).alias("c")).select("field_id", *names, F.col("c.idx").alias("idx"), F.col("c.v").alias("v"), F.expr(" + ".join(names)).alias("wave")).write.partitionBy("wave").parquet(f"{folder}/blocks")
    # Waves follow from the blocks that there are.
    placed = f"field_id string, {', '.join(f'{b} int' for b in names)}"
    blocks = spark.read.schema(f"{placed}, idx array<bigint>, v array<double>, wave int").parquet(f"{folder}/blocks")
    waves = blocks.agg(F.max("wave")).first()[0]
    if waves is None:
        return spark.createDataFrame([], CODES)
    out = f"{placed}, side string, face array<double>, code array<bigint>, freq array<bigint>"
    shifts = [c for c in itertools.product((0, 1), repeat=d) if any(c)]

    def scan(key, mine: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=["field_id", *names, "side", "face", "code", "freq"])
        idx = np.asarray(mine["idx"].iloc[0], np.int64)
        place, rest = [], idx
        for s in size:
            place.append(rest // s)
            rest = rest % s
        low = [int(p.min()) for p in place]
        shape = [int(p.max()) - lo + 1 for p, lo in zip(place, low, strict=True)]
        if math.prod(shape) != len(idx):
            raise ValueError(f"field {key[0]} has holes")
        x = np.asarray(mine["v"].iloc[0], float).reshape(shape)
        known = np.zeros([n + 1 for n in shape])
        for side, face in zip(faces["side"], faces["face"], strict=True):
            known[tuple(0 if s == "1" else slice(1, None) for s in side)] = np.asarray(face, float).reshape([n for n, s in zip(shape, side, strict=True) if s == "0"])
        codes, back = scan_block(x, known, bound)
        seen, freq = np.unique(codes.ravel()[(idx + 1) % every == 0], return_counts=True)
        rows = [(*key, "", None, seen, freq)]
        for shift in shifts:  # what the block above in these axes sees of this one
            part = back[tuple(-1 if s else slice(1, None) for s in shift)]
            rows.append((key[0], *(b + s for b, s in zip(key[1:], shift, strict=True)), "".join(map(str, shift)), np.ravel(part), None, None))
        return pd.DataFrame(rows, columns=["field_id", *names, "side", "face", "code", "freq"])

    made = spark.createDataFrame([], out)
    for wave in range(waves + 1):
        mine = blocks.where(F.col("wave") == wave).drop("wave")
        faces = made.where(f"side <> '' and {' + '.join(names)} = {wave}").select("field_id", *names, "side", "face")
        scanned = mine.groupBy("field_id", *names).cogroup(faces.groupBy("field_id", *names)).applyInPandas(scan, out)
        scanned.write.mode("append").parquet(f"{folder}/scanned")
        made = spark.read.schema(out).parquet(f"{folder}/scanned")
    counts = made.where("side = ''").select("field_id", F.explode(F.arrays_zip("code", "freq")).alias("h"))
    return counts.groupBy("field_id", F.col("h.code").alias("code")).agg(F.sum("h.freq").alias("freq"))


def _texts(dims: list[int]) -> list[str]:
    """The coordinates as SQL text."""
    s = strides(dims)
    return [f"idx div {s[0]}"] + [f"(idx div {s[k]}) % {dims[k]}" for k in range(1, len(dims))]
