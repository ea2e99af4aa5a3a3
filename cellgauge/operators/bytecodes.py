"""How far texts would compress: histograms of their bytes and of pairs of bytes, and the entropies that follow.

A text is the sequence of its bytes in UTF-8 with a mark before and after it, so the pairs of a text say how
many bytes and how many texts there are too. Histograms of parts of a table add up to those of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands before and after a text; a pair's code is SYMBOLS * first + second.
MARK = 256
SYMBOLS = 257
#: Bytes that are looked at together, and groups that a task counts side by side (half a MB each).
PIECE = 1 << 20
HELD_GROUPS = 64


def _runs(offsets: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `piece` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _pair_codes(data: np.ndarray, lengths: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of texts one after the other in data: (row, code) of each pair, in pieces however long a text is."""
    if len(lengths) == 1 and len(data) > piece:
        for at in range(0, len(data) + 1, piece):
            part = np.concatenate([[data[at - 1] if at else MARK], data[at : at + piece], [MARK] if at + piece > len(data) else []]).astype(np.int64)
            yield np.zeros(len(part) - 1, np.int64), part[:-1] * SYMBOLS + part[1:]
        return
    # One mark ends a text and starts the next.
    symbols = np.insert(data.astype(np.int64), np.cumsum(lengths), MARK)
    yield np.repeat(np.arange(len(lengths)), lengths + 1), np.concatenate([[MARK], symbols[:-1]]) * SYMBOLS + symbols


def byte_pairs(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """by, code, freq: how often each pair of bytes, marks included, is in the texts of each group of rows.

    Null texts are empty; null groups are groups. A task sends its own sums, one row for each group and
    pair that it has seen, not its bytes. by must not have columns named code or freq.
    """
    names = [f"_g{k}" for k in range(len(by))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.Field] = []

        def out() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                code = np.flatnonzero(total)
                groups = [pa.array([v], f.type).take(pa.array(np.zeros(len(code), np.int64))) for v, f in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*groups, pa.array(code), pa.array(total[code])], [*names, "code", "freq"])
            held.clear()

        for b in batches:
            kinds = [b.schema.field(k) for k in range(len(by))]
            texts = b.column(len(by)).cast(pa.large_binary()).fill_null(b"")
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            keys = list(zip(*(c.to_pylist() for c in b.columns[: len(by)]), strict=True)) if by else [()] * len(texts)
            for lo, hi in _runs(offsets, PIECE):
                number = {key: k for k, key in enumerate(dict.fromkeys(keys[lo:hi]))}
                group = np.array([number[key] for key in keys[lo:hi]])
                several = len(number) > HELD_GROUPS
                if several or len(held) + len(number) > HELD_GROUPS:
                    yield from out()
                for row, code in _pair_codes(data[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1]), PIECE):
                    if several:  # too many groups for a count of each pair
                        seen, freq = np.unique(group[row] * SYMBOLS**2 + code, return_counts=True)
                        which = pa.array(seen // SYMBOLS**2)
                        groups = [pa.array([key[k] for key in number], f.type).take(which) for k, f in enumerate(kinds)]
                        yield pa.RecordBatch.from_arrays([*groups, pa.array(seen % SYMBOLS**2), pa.array(freq)], [*names, "code", "freq"])
                        continue
                    total = np.bincount(group[row] * SYMBOLS**2 + code, minlength=len(number) * SYMBOLS**2).reshape(len(number), -1)
                    for key, k in number.items():
                        held[key] = held[key] + total[k] if key in held else total[k].copy()
        yield from out()

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{n} {types[c]}" for n, c in zip(names, by, strict=True)), "code bigint, freq bigint"])
    given = rows.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(text).alias("_text"))
    sums = given.mapInArrow(count, schema).groupBy(*names, "code").agg(F.sum("freq").alias("freq"))
    return sums.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "code", "freq")


def text_ratios(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n_texts, n_bytes, entropy_0, entropy_1, ratio_0, ratio_1 from byte_pairs(), each group's pairs once.

    entropy_0: bits of a symbol (a byte or the mark that ends a text) by itself; entropy_1: given the symbol
    before it. The ratios are the texts' 8 bits a byte over what their symbols take; null where that is 0.
    """
    second = F.expr(f"code % {SYMBOLS}")
    seen = pairs.select(*by, F.expr(f"code div {SYMBOLS}").alias("_first"), second.alias("_second"), "freq")

    def bits(by_symbol: DataFrame) -> DataFrame:
        """by, _n and _bits: the symbols that follow each context together, and what coding them takes."""
        return by_symbol.groupBy(*by, *(c for c in ("_first",) if c in by_symbol.columns)).agg(F.sum("freq").alias("_n"), F.sum(F.col("freq") * F.log2("freq")).alias("_s")).withColumn("_bits", F.col("_n") * F.log2("_n") - F.col("_s"))

    order1 = bits(seen).groupBy(*by).agg(F.sum("_bits").alias("_bits_1"))
    symbols = seen.groupBy(*by, "_second").agg(F.sum("freq").alias("freq"))
    order0 = bits(symbols.select(*by, "freq")).select(*by, "_n", F.col("_bits").alias("_bits_0"))
    sizes = symbols.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_second") == MARK, F.col("freq"))), F.lit(0)).alias("n_texts"), F.coalesce(F.sum(F.when(F.col("_second") != MARK, F.col("freq"))), F.lit(0)).alias("n_bytes"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    both = sizes.alias("a").join(order0.alias("b"), same("a", "b")).join(order1.alias("c"), same("a", "c")) if by else sizes.crossJoin(order0).crossJoin(order1)
    # Rounded, so that a text of one symbol over and over has no bits rather than a rounding error's worth.
    b0, b1 = (F.round(f"_bits_{k}", 6) + 0.0 for k in (0, 1))
    ratio = lambda b: F.try_divide(F.col("n_bytes") * 8.0, F.nullif(b, F.lit(0.0)))
    return both.select(*[F.col(f"a.{c}") for c in by], "n_texts", "n_bytes", (b0 / F.col("_n")).alias("entropy_0"), (b1 / F.col("_n")).alias("entropy_1"), ratio(b0).alias("ratio_0"), ratio(b1).alias("ratio_1"))
