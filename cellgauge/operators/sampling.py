"""Samples of arrays: seeded tiles in a fixed order, and evenly placed blocks of four cells per axis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.arrays import coordinates

#: Default tile shapes by number of dimensions.
TILE_SHAPES = {1: [128], 2: [16, 16], 3: [8, 8, 8]}
N_TILES = 32


def sampled_tiles(cells: DataFrame, dims: list[int], n: int = N_TILES, seed: int = 0, shape: list[int] | None = None) -> DataFrame:
    """field_id, tile and values of n whole tiles per field, the first by a hash of seed and tile."""
    shape = shape or TILE_SHAPES.get(len(dims))
    if shape is None:
        raise ValueError(f"no default tile for {len(dims)} dimensions")
    coords = coordinates(dims)
    tile = F.concat_ws(",", *[F.floor(c / s).cast("string") for c, s in zip(coords, shape, strict=True)])
    pos, place = F.lit(0), 1
    for c, s in reversed(list(zip(coords, shape, strict=True))):
        pos, place = pos + (c % s) * place, place * s
    rows = cells.select("field_id", tile.alias("tile"), pos.alias("pos"), "v")
    # Ranks are made from tile ids alone; only the chosen tiles' cells are gathered.
    whole = rows.groupBy("field_id", "tile").count().where(F.col("count") == math.prod(shape))
    w = Window.partitionBy("field_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("tile"))), "tile")
    chosen = whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("field_id", "tile", "rank")
    rows = rows.join(chosen, ["field_id", "tile"])
    out = rows.groupBy("field_id", "tile", "rank").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("r"))
    return out.select("field_id", "tile", "rank", F.col("r.v").alias("values"))


def block_positions(dims: list[int], ratio: float) -> list[list[int]]:
    """First coordinates of the sampled 4-blocks on each axis; a single block lies at 0."""
    if len(dims) == 1:
        n = int(dims[0] * ratio) // 4
        total = dims[0] // 4
        if not n:
            return [[]]
        step = max(1, math.floor(total / n + 0.5)) * 4
        return [[x for x in range(0, dims[0] - 3, step)][:n]]
    out = []
    for d in dims:
        blocks = d // 4
        n = int(ratio ** (1 / len(dims)) * blocks)
        out.append(sorted({4 * math.floor(i / max(1, n - 1) * (blocks - 1) + 0.5) for i in range(n)}))
    return out


def sampled_blocks(cells: DataFrame, dims: list[int], ratio: float = 0.01) -> DataFrame:
    """Cells of evenly placed blocks of 4 per axis that make up about ratio of the field; dims must be closed."""
    spark = cells.sparkSession
    coords = coordinates(dims)
    out = cells
    for k, starts in enumerate(block_positions(dims, ratio)):
        # An axis has few starts next to its cells, yet they join unless the plan finds them small.
        axis = spark.createDataFrame([(s,) for s in starts], f"_s{k} bigint")
        out = out.withColumn(f"_s{k}", F.floor(coords[k] / 4) * 4).join(axis, f"_s{k}")
    return out.select("field_id", "idx", "v")
