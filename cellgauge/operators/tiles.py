"""Tile statistics of two-dimensional fields: spread, variation, correlation, entropy, coding gain.

Tiles are k x k; tiles cut off by the field's edge, and tiles without variance, drop out. Pairs of
tiles meet within one field only, block by block; the number of tiles of a field, not of its cells, is
what is squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.arrays import coordinates
from ..sources.shared import new_folder

BINS = 15
EMPTY_BIN = 1e-10
#: Blocks that a field's tiles are dealt into, unless it is small (fewer, of TILE_BLOCK tiles) or a block would have more than BLOCK_CELLS cells.
TILE_BLOCKS, TILE_BLOCK = 16, 128
BLOCK_CELLS = 1 << 22
#: Tiles whose pairs a task looks at at once, and fields whose numbers of blocks are sent to their tiles at most.
PIECE = 512
SENT_FIELDS = 500_000


def tile_cells(cells: DataFrame, width: int, k: int, center: bool = False) -> DataFrame:
    """field_id, tr, tc (tile coordinates), pos (place in the tile) and v, of whole tiles only; center: less the column's mean."""
    i, j = F.expr(f"idx div {width}"), F.col("idx") % width
    rows = cells.select("field_id", i.alias("i"), j.alias("j"), "v").where(F.col("j") < width // k * k)
    if center:
        rows = rows.join(cells.groupBy("field_id", j.alias("j")).agg(F.avg("v").alias("_m")), ["field_id", "j"]).withColumn("v", F.col("v") - F.col("_m"))
    rows = rows.select("field_id", F.expr(f"i div {k}").alias("tr"), F.expr(f"j div {k}").alias("tc"), (F.col("i") % k * k + F.col("j") % k).alias("pos"), "v")
    return rows


def tiles(cells: DataFrame, width: int, k: int, center: bool = False) -> DataFrame:
    """A row per whole tile with variance: values in order, intra-tile spread (twice the variance) and mean square."""
    t = tile_cells(cells, width, k, center).groupBy("field_id", "tr", "tc").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_r"), F.var_samp("v").alias("_var"), F.avg(F.col("v") * F.col("v")).alias("mean_square"))
    t = t.where((F.size("_r") == k * k) & (F.col("_var") > 0))
    return t.select("field_id", "tr", "tc", F.col("_r.v").alias("values"), (2 * F.col("_var")).alias("intra"), "mean_square")


SUMS = ["n", "w", "d", "r", "root_w", "root_wd", "root_w_r"]
PAIRED = "field_id string, tr bigint, tc bigint, intra double, " + ", ".join(f"{c} double" for c in SUMS) + ", rmax double, rmin double"


class _Side:
    """A block's tiles, and of each its sums over the other block's."""

    def __init__(self, part):
        self.part, self.tr, self.tc = part[["field_id", "tr", "tc", "intra"]], part["tr"].to_numpy(), part["tc"].to_numpy()
        self.v = np.stack(part["values"].to_numpy())
        c = self.v - self.v.mean(axis=1, keepdims=True)
        self.c, self.square = c / np.linalg.norm(c, axis=1, keepdims=True), (self.v**2).sum(axis=1)
        self.sums = {c: np.zeros(len(part)) for c in SUMS}
        self.rmax, self.rmin = np.full(len(part), -1.0), np.full(len(part), 2.0)

    def take(self, at: slice, axis: int, cells: dict, n, high, low) -> None:
        self.sums["n"][at] += n
        for c, x in cells.items():
            self.sums[c][at] += x.sum(axis=axis)
        self.rmax[at] = np.maximum(self.rmax[at], high.max(axis=axis))
        self.rmin[at] = np.minimum(self.rmin[at], low.min(axis=axis))

    def frame(self):
        return self.part.assign(**self.sums, rmax=self.rmax, rmin=self.rmin)


def _block_sums(f):
    """Of each tile of two blocks of one field (or of one block twice) its sums over the other block's tiles; pairs are looked at piece by piece."""
    import pandas as pd

    lo, hi = f["lo"].iloc[0], f["hi"].iloc[0]
    parts = [f[f["own"] == lo], f[f["own"] == hi]]
    if not all(len(p) for p in parts):
        return pd.DataFrame({c.split(" ")[0]: [] for c in PAIRED.split(", ")})
    a = _Side(parts[0])
    b = a if lo == hi else _Side(parts[1])
    for i in range(0, len(a.part), PIECE):
        for j in range(i if a is b else 0, len(b.part), PIECE):
            p, q = slice(i, i + PIECE), slice(j, j + PIECE)
            w = np.abs(a.tr[p, None] - b.tr[q]) + np.abs(a.tc[p, None] - b.tc[q]).astype(float)
            d = np.sqrt(np.maximum(0.0, a.square[p, None] + b.square[q] - 2 * a.v[p] @ b.v[q].T))
            r = high = low = np.abs(a.c[p] @ b.c[q].T)
            itself = a is b and i == j  # the piece's tiles meet themselves too
            if itself:
                own = np.eye(len(r), dtype=bool)
                d, r, high, low = np.where(own, 0, d), np.where(own, 0, r), np.where(own, -1.0, r), np.where(own, 2.0, r)
            root = np.sqrt(w)
            cells = {"w": w, "d": d, "r": r, "root_w": root, "root_wd": root * np.sqrt(d), "root_w_r": root * r}
            a.take(p, 1, cells, r.shape[1] - itself, high, low)
            if not itself:
                b.take(q, 0, cells, r.shape[0], high, low)
    return a.frame() if a is b else pd.concat([a.frame(), b.frame()])


TOTALS = "field_id string, n bigint, w bigint, d double, r double"


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of |a - b| over all a of x and b of y, whole numbers, without their pairs."""
    y = np.sort(y)
    below = np.concatenate([[0], np.cumsum(y)])
    k = np.searchsorted(y, x)
    return int((x * (2 * k - len(y)) + below[-1] - 2 * below[k]).sum())


def _block_totals(f):
    """Totals over the pairs of tiles of two blocks of one field (or of one block twice), each pair taken from both its tiles; pairs are looked at piece by piece."""
    import pandas as pd

    lo, hi = f["lo"].iloc[0], f["hi"].iloc[0]
    parts = [f[f["own"] == lo], f[f["own"] == hi]]
    if not all(len(p) for p in parts):
        return pd.DataFrame({c.split(" ")[0]: [] for c in TOTALS.split(", ")})
    a = _Side(parts[0])
    b = a if lo == hi else _Side(parts[1])
    na, nb, ways = len(a.part), len(b.part), 1 if a is b else 2
    d = r = 0.0
    for i in range(0, na, PIECE):
        for j in range(i if a is b else 0, nb, PIECE):
            p, q = slice(i, i + PIECE), slice(j, j + PIECE)
            itself = a is b and i == j  # the piece's tiles meet themselves, and each pair twice
            x = a.v[p] @ b.v[q].T
            x *= -2
            x += a.square[p, None]
            x += b.square[q]
            np.sqrt(np.maximum(x, 0, out=x), out=x)
            y = a.c[p] @ b.c[q].T
            np.abs(y, out=y)
            if itself:
                np.fill_diagonal(x, 0)
                np.fill_diagonal(y, 0)
            d += x.sum() * (2 - itself)
            r += y.sum() * (2 - itself)
    n = na * (na - 1) if a is b else 2 * na * nb
    return pd.DataFrame({"field_id": f["field_id"].iloc[:1], "n": [n], "w": [ways * (_apart(a.tr, b.tr) + _apart(a.tc, b.tc))], "d": [d], "r": [r]})


def _two_blocks(t: DataFrame, block: int | None) -> DataFrame:
    """A row per tile and block of its field, with the two blocks lo and hi, one of them its own, that are to meet.

    Each two blocks meet once, as one task's matrix products, so neither a field nor a pair of tiles is a row
    that moves. A tile moves once for each block: TILE_BLOCKS times whatever the field's size, until blocks
    reach BLOCK_CELLS (or `block` tiles). Tiles are made once and kept in the shared folder.
    """
    spark = t.sparkSession
    folder = new_folder(spark, "tiles")
    t.write.parquet(folder)
    t = spark.read.schema(t.schema).parquet(folder)
    most = F.count("*") / block if block else F.sum(F.size("values")) / BLOCK_CELLS
    counts = t.groupBy("field_id").agg(F.greatest(F.ceil(most), F.least(F.lit(TILE_BLOCKS), F.ceil(F.count("*") / TILE_BLOCK))).cast("int").alias("_blocks"))
    rows = t.join(F.broadcast(counts) if counts.count() <= SENT_FIELDS else counts, "field_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("tr", "tc"), F.col("_blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.select("field_id", "tr", "tc", "intra", "values", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def pair_sums(t: DataFrame, block: int | None = None) -> DataFrame:
    """Of each tile, over the other tiles of its field: their number n, and sums of the Manhattan distance w, the Euclidean distance d, the absolute correlation r, sqrt(w), sqrt(w d) and sqrt(w) r; and r's extremes."""
    each = _two_blocks(t, block).groupBy("field_id", "lo", "hi").applyInPandas(_block_sums, PAIRED)
    return each.groupBy("field_id", "tr", "tc").agg(F.first("intra").alias("intra"), *[F.sum(c).alias(c) for c in SUMS], F.max("rmax").alias("rmax"), F.min("rmin").alias("rmin")).where("n > 0")


def pair_totals(t: DataFrame, block: int | None = None) -> DataFrame:
    """Of each field, over its ordered pairs of different tiles: their number n, and totals of the Manhattan distance w, the Euclidean distance d and the absolute correlation r.

    What pair_sums gives by tile, summed: two blocks give one row, and n and w are whole numbers of any size.
    """
    each = _two_blocks(t, block).groupBy("field_id", "lo", "hi").applyInPandas(_block_totals, TOTALS)
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "w")]
    return each.groupBy("field_id").agg(*whole, F.sum("d").alias("d"), F.sum("r").alias("r")).where("n > 0")


def spatial_statistics(t: DataFrame) -> DataFrame:
    """Per field: spatial variation, and four summaries of the tiles' absolute correlations."""
    n = F.count("*").cast("double")
    per = pair_sums(t).select("field_id", "tr", "tc", "intra", (F.col("root_wd") / F.col("root_w")).alias("sv"), (F.col("root_w_r") / F.col("root_w")).alias("sc"), "rmax", "rmin")
    return (
        per.groupBy("field_id")
        .agg(
            (-F.sum(F.col("intra") * F.col("sv")) * F.log(1 / n) / n).alias("spatial_variation"),
            (F.sum(F.col("sc") / F.col("intra")) / F.sum(1 / F.col("intra"))).alias("correlation_weighted"),
            F.avg("sc").alias("correlation_mean"),
            F.min("rmax").alias("correlation_minmax"),
            F.min("rmin").alias("correlation_min"),
        )
    )


def binned_entropy(tile_rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Entropy over BINS equal bins with right-closed edges; the minimum itself lies in none, as under the distribution function's differences."""
    rows = tile_rows.select(*keys, value.alias("x"))
    bounds = rows.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").cast("double").alias("n"))
    step = (F.col("hi") - F.col("lo")) / float(BINS)
    which = F.greatest(F.lit(0), F.least(F.lit(BINS), F.ceil(F.try_divide(F.col("x") - F.col("lo"), F.nullif(step, F.lit(0.0)))).cast("int")))
    hist = rows.join(bounds, keys).groupBy(*keys, which.alias("bin")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first(F.col("hi") - F.col("lo")).alias("span"))
    p = F.col("c") / F.col("n")
    used = (F.col("bin") >= 1) & (F.col("span") > 0)
    gap = EMPTY_BIN * F.log2(F.lit(EMPTY_BIN))
    return hist.groupBy(*keys).agg(F.when(F.first("span") > 0, -F.coalesce(F.sum(F.when(used, p * F.log2(p))), F.lit(0.0)) - (BINS - F.sum(used.cast("int"))) * gap).otherwise(0.0).alias("entropy"))


def distortion(cells: DataFrame, width: int, k: int, bound: float) -> DataFrame:
    """Per field: sum over tiles of 2^(-2 (Hq - H)) / 12, H and Hq the tile's entropy before and after quantising down."""
    keys = ["field_id", "tr", "tc"]
    rows = tile_cells(cells, width, k)
    whole = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.var_samp("v").alias("_var")).where((F.col("_n") == k * k) & (F.col("_var") > 0)).select(*keys)
    rows = rows.join(whole, keys)
    h = binned_entropy(rows, keys, F.col("v"))
    q = binned_entropy(rows, keys, F.floor(F.col("v") / bound) * bound).withColumnRenamed("entropy", "quantised")
    return h.join(q, keys).groupBy("field_id").agg(F.sum(F.pow(F.lit(2.0), -2 * (F.col("quantised") - F.col("entropy"))) / 12).alias("distortion"))


def coding_gain(t: DataFrame) -> DataFrame:
    """Per field: both coding gains (log10) and the share of singular values that holds 99 %, from the tiles' outer products.

    The sum of outer products is a k^2 x k^2 matrix whatever the number of tiles; it is summed in
    each task first.
    """

    def partial(frames):
        import pandas as pd

        held: dict = {}
        for f in frames:
            for name, g in f.groupby("field_id"):
                x = np.stack(g["values"].to_numpy())
                m, n = held.get(name, (0.0, 0))
                held[name] = (m + x.T @ x, n + len(x))
        for name, (m, n) in held.items():
            yield pd.DataFrame({"field_id": [name], "n": [n], "m": [m.ravel()]})

    def finish(f):
        import pandas as pd

        m = sum(f["m"].to_numpy()) / f["n"].sum()
        m = m.reshape(int(len(m) ** 0.5), -1)
        s = np.maximum(np.linalg.svd(m, compute_uv=False), 1e-300)
        share = np.cumsum(s) / s.sum()
        logs = np.log(s).mean()
        gain = np.log10(s.mean()) - logs / np.log(10)
        diag = (np.log(np.maximum(np.diag(m), 1e-300)).mean() - logs) / np.log(10)
        return pd.DataFrame({"field_id": [f["field_id"].iloc[0]], "gaussian_gain": [gain], "gain": [diag], "svd_trunc": [100.0 * (int(np.argmax(share >= 0.99)) + 1) / len(s)]})

    parts = t.select("field_id", "values").mapInPandas(partial, "field_id string, n bigint, m array<double>")
    return parts.groupBy("field_id").applyInPandas(finish, "field_id string, gaussian_gain double, gain double, svd_trunc double")


def standardised_svd(cells: DataFrame, width: int, k: int) -> DataFrame:
    """Per field: coding gains of tiles whose columns were standardised first."""
    j = F.col("idx") % width
    stats = cells.groupBy("field_id", j.alias("j")).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    rows = cells.withColumn("j", j).join(stats, ["field_id", "j"]).where("s > 0").select("field_id", "idx", ((F.col("v") - F.col("m")) / F.col("s")).alias("v"))
    return coding_gain(tiles(rows, width, k))


#: A field with fewer cells or dimensions or a smaller deviation is degenerate.
LEAST_CELLS, LEAST_DIMS, LEAST_SD = 10, 2, 0.01


def usable_fields(cells: DataFrame, dims: list[int], least_sd: float = LEAST_SD) -> DataFrame:
    """field_id, n, sd of the fields that aren't degenerate: enough cells, all of them numbers, two dimensions of more than one cell, some deviation."""
    spread = [F.max(c) > F.min(c) for c in coordinates(dims)]
    several = sum((s.cast("int") for s in spread), F.lit(0))
    t = cells.groupBy("field_id").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), several.alias("_d"), F.bool_or(F.col("v").isNull() | F.isnan("v")).alias("_holes"))
    return t.where((F.col("n") >= LEAST_CELLS) & (F.col("sd") >= least_sd) & (F.col("_d") >= LEAST_DIMS) & ~F.col("_holes")).select("field_id", "n", "sd")


def total_statistics(cells: DataFrame) -> DataFrame:
    return cells.groupBy("field_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("greatest"))
