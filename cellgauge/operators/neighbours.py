"""Neighbourhood features of arrays, from lag and lead over the flat index.

A field may be larger than one task: cells are dealt into chunks of consecutive indices, and each
chunk also gets the cells within the farthest offset around it, so the window never needs more.
Filters on the sampling grid come after the window, since neighbours must be seen first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.arrays import coordinates, strides

CHUNK = 1 << 17
GRID = 4
BLOCK_STEP = 16


def with_neighbours(cells: DataFrame, offsets: dict[str, int], chunk: int = CHUNK) -> DataFrame:
    """cells with a column for each offset: the value at idx + offset, null beyond the field."""
    halo = max(abs(o) for o in offsets.values())
    size = max(chunk, 8 * halo)
    own = F.expr(f"idx div {size}")
    reach = F.sequence(F.expr(f"greatest(0, (idx - {halo}) div {size})"), F.expr(f"(idx + {halo}) div {size}"))
    dealt = cells.withColumn("_own", own).withColumn("_chunk", F.explode(reach))
    w = Window.partitionBy("field_id", "_chunk").orderBy("idx")
    out = dealt.select("*", *[(F.lag("v", -o) if o < 0 else F.lead("v", o)).over(w).alias(n) for n, o in offsets.items()])
    return out.where("_own = _chunk").drop("_own", "_chunk")


def mean_of_present(cols: list[Column]) -> Column:
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, F.nullif(n, F.lit(0)))


def lorenzo_offsets(dims: list[int]) -> dict[int, int]:
    """Offset to sign of the Lorenzo predictor: every corner of the cell's lower hypercube."""
    out: dict[int, int] = {}
    steps = strides(dims)
    for mask in range(1, 1 << len(dims)):
        picked = [s for k, s in enumerate(steps) if mask >> k & 1]
        out[-sum(picked)] = 1 if len(picked) % 2 else -1
    return out


def _on_grid(dims: list[int]) -> Column:
    cond = F.lit(True)
    for c in coordinates(dims):
        cond = cond & (c % GRID == 0)
    return cond


def sampled_grid(cells: DataFrame, dims: list[int]) -> DataFrame:
    """Cells whose coordinates are all multiples of 4."""
    return cells.where(_on_grid(dims))


def neighbour_features(cells: DataFrame, dims: list[int], scaled_lorenzo: bool = True) -> DataFrame:
    """Per field: range and mean of the sampled grid, and mean differences to three predictors.

    A predictor is left out where a cell it needs lies beyond the field; neighbours are those by flat
    index, so they wrap from row to row. The Lorenzo sum is divided by 2^d - 1 unless
    scaled_lorenzo is False. Fields without any valid cell have null means.
    """
    if not 1 <= len(dims) <= 3:
        raise ValueError(f"{len(dims)} dimensions; there must be 1 to 3")
    steps = strides(dims)
    lorenzo = lorenzo_offsets(dims)
    need = {s for d in steps for s in (-d, d, -3 * d, 3 * d)} | set(lorenzo)
    name = lambda o: f"n{'m' if o < 0 else 'p'}{abs(o)}"
    rows = with_neighbours(cells, {name(o): o for o in sorted(need)}).where(_on_grid(dims))
    at = lambda o: F.col(name(o))
    v = F.col("v")
    axis = mean_of_present([at(s) for d in steps for s in (-d, d)])
    corner = sum((sign * at(o) for o, sign in lorenzo.items()), F.lit(0.0)) / (float(2 ** len(dims) - 1) if scaled_lorenzo else 1.0)
    spline = [F.abs(v - (-at(-3 * d) + 9 * at(-d) + 9 * at(d) - at(3 * d)) / 16.0) for d in steps]
    rows = rows.select("field_id", "v", F.abs(axis - v).alias("a"), F.abs(corner - v).alias("l"), *[s.alias(f"s{k}") for k, s in enumerate(spline)])
    sums = sum((F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in range(len(steps))), F.lit(0.0))
    counts = sum((F.count(f"s{k}") for k in range(len(steps))), F.lit(0))
    return rows.groupBy("field_id").agg(
        (F.max("v") - F.min("v")).alias("value_range"),
        F.when(F.max("v") > F.min("v"), F.avg("v") - F.min("v")).alias("mean_value"),
        F.avg("a").alias("mean_neighbor_difference"),
        F.avg("l").alias("mean_lorenzo_difference"),
        F.try_divide(sums, F.nullif(counts, F.lit(0))).alias("mean_spline_difference"),
    )


def checked(packed: DataFrame) -> DataFrame:
    """packed, in which reading an array without values, of another type than float32 or float64, or of other than 1 to 3 dimensions is an error."""
    fault = F.when(F.col("values").isNull(), "has no data").when(F.col("dtype").isNull() | ~F.col("dtype").isin("float32", "float64"), "isn't of single or double precision").when(F.col("dims").isNull() | ~F.size("dims").between(1, 3), "must have 1, 2 or 3 dimensions")
    said = F.concat(F.lit("array "), F.coalesce("field_id", F.lit("")), F.lit(" "), fault)
    return packed.withColumn("values", F.when(fault.isNotNull(), F.raise_error(said).cast("array<double>")).otherwise(F.col("values")))


def constant_blocks(cells: DataFrame, dims: list[int]) -> DataFrame:
    """Per field and 4^d block at origins that are multiples of 16: cells, range and whether it isn't constant."""
    coords = coordinates(dims)
    inside = F.lit(True)
    for c in coords:
        inside = inside & (c % BLOCK_STEP < GRID)
    limit = sampled_grid(cells, dims).groupBy("field_id").agg((0.15 * (F.avg("v") - F.min("v"))).alias("limit"))
    blocks = cells.where(inside).groupBy("field_id", *[F.floor(c / BLOCK_STEP).alias(f"b{k}") for k, c in enumerate(coords)]).agg(F.count("*").alias("n_cells"), (F.max("v") - F.min("v")).alias("spread"))
    least = 0.75 * GRID ** len(dims)
    return blocks.join(limit, "field_id").withColumn("non_constant", (F.col("n_cells") < least) | (F.col("spread") > F.col("limit")))


def non_constant_share(cells: DataFrame, dims: list[int]) -> DataFrame:
    """Per field: share of blocks that aren't constant, mapped from [0, 1] to [0.5, 1]."""
    share = F.avg(F.col("non_constant").cast("double"))
    return constant_blocks(cells, dims).groupBy("field_id").agg((0.5 + 0.5 * share).alias("non_constant_block_percentage"))
