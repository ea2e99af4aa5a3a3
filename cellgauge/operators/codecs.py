"""Codecs of whole arrays that stand in for external ones, and listeners that are told of what a codec does.

A codec turns an array into bytes and bytes into an array again; sizes are lengths of those bytes, errors are
those of the array that comes back. Listeners (sizes, errors, times, and any of a caller's own) are told before
and after each array is compressed and decompressed, where the arrays are, and give numbers by name.
"""

from __future__ import annotations

import copy
import itertools
import statistics
import struct
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blockcodec
from .huffman import Table


@dataclass(frozen=True)
class Codec:
    """encode(array, bound) and decode(bytes, bound); called, it gives (number of bytes, array that comes back)."""

    encode: Callable[[np.ndarray, float], bytes]
    decode: Callable[[bytes, float], np.ndarray]

    def __call__(self, x: np.ndarray, bound: float) -> tuple[int, np.ndarray]:
        data = self.encode(x, bound)
        return len(data), self.decode(data, bound)


def _quantised(x: np.ndarray, bound: float) -> np.ndarray:
    return np.floor(x / (2 * bound) + 0.5).astype(np.int64)


def _packed(q: np.ndarray) -> tuple[bytes, bytes]:
    """The kind of codes, four bytes each if all fit, else eight; and the codes as bytes."""
    kind = b"4" if np.abs(q).max(initial=0) < 1 << 31 else b"8"
    return kind, q.astype(f"<i{kind.decode()}").tobytes()


def _unpacked(kind: bytes, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{kind.decode()}").astype(np.int64)


def _quant_zlib(x: np.ndarray, bound: float) -> bytes:
    kind, raw = _packed(_quantised(x, bound))
    return kind + zlib.compress(raw, 6)


def _quant_zstd(x: np.ndarray, bound: float) -> bytes:
    import pyarrow as pa

    kind, raw = _packed(_quantised(x, bound))
    return kind + struct.pack("<q", len(raw)) + bytes(pa.Codec("zstd").compress(raw))


def _from_zstd(data: bytes, bound: float) -> np.ndarray:
    import pyarrow as pa

    return _unpacked(data[:1], bytes(pa.Codec("zstd").decompress(data[9:], struct.unpack("<q", data[1:9])[0]))) * (2 * bound)


def huffman_encode(symbols: list[int]) -> tuple[bytes, bytes, int]:
    """(the table's bytes, the codes' bytes, number of bits of the codes)."""
    seen, freq = np.unique(np.array(symbols, np.int64), return_counts=True)
    table = Table.of(seen, freq)
    at = {s: n for s, n in zip(table.symbols.tolist(), table.lengths.tolist(), strict=True)}
    return table.to_bytes(), table.write(np.array(symbols, np.int64)), sum(at[s] * n for s, n in zip(seen.tolist(), freq.tolist(), strict=True))


def huffman_decode(table: bytes, data: bytes, n_bits: int) -> list[int]:
    return Table.from_bytes(table).read(data).tolist()


def _lorenzo_huffman(x: np.ndarray, bound: float) -> bytes:
    """First differences of quantised values, Huffman coded."""
    steps = np.diff(_quantised(x, bound), prepend=0)
    table = Table.of(*np.unique(steps, return_counts=True))
    head = table.to_bytes()
    return struct.pack("<I", len(head)) + head + table.write(steps)


def _from_lorenzo_huffman(data: bytes, bound: float) -> np.ndarray:
    end = 4 + struct.unpack("<I", data[:4])[0]
    return np.cumsum(Table.from_bytes(data[4:end]).read(data[end:])) * (2 * bound)


def _block_float(x: np.ndarray, bound: float, block: int = 64) -> bytes:
    """Blocks that keep each value's bits above the bound, as many as their largest needs."""
    out = [struct.pack("<q", len(x))]
    for at in range(0, len(x), block):
        q = _quantised(x[at : at + block], bound)
        folded = np.where(q < 0, -2 * q - 1, 2 * q).astype(np.uint64)
        wide = int(folded.max(initial=0)).bit_length()
        bits = folded[:, None] >> np.arange(wide, dtype=np.uint64)[::-1] & np.uint64(1)
        out.append(bytes([wide]) + np.packbits(bits.astype(np.uint8)).tobytes())
    return b"".join(out)


def _from_block_float(data: bytes, bound: float, block: int = 64) -> np.ndarray:
    n, at, out = struct.unpack("<q", data[:8])[0], 8, []
    for start in range(0, n, block):
        count, wide = min(block, n - start), data[at]
        size = (count * wide + 7) // 8
        bits = np.unpackbits(np.frombuffer(data[at + 1 : at + 1 + size], np.uint8))[: count * wide].reshape(count, wide).astype(np.int64)
        folded = (bits << np.arange(wide)[::-1]).sum(axis=1)
        out.append(np.where(folded & 1, -(folded + 1 >> 1), folded >> 1))
        at += 1 + size
    return np.concatenate([np.empty(0, np.int64), *out]) * (2 * bound)


#: Runs of values that the transform codec takes at once.
RUNS = 1 << 14


def _transform(x: np.ndarray, bound: float) -> bytes:
    """The transform codec on runs of 4 values; the last run is filled up with its last value."""
    side = blockcodec.SIDE
    rows = np.pad(x, (0, -len(x) % side), mode="edge").reshape(-1, side) if len(x) else np.empty((0, side))
    sizes, out = [], []
    for at in range(0, len(rows), RUNS):
        data = blockcodec.encode(rows[at : at + RUNS], 1, bound)
        sizes.append(np.array([len(d) for d in data], np.uint8).tobytes())
        out.append(b"".join(data))
    return b"".join([struct.pack("<q", len(x)), *sizes, *out])


def _from_transform(data: bytes, bound: float) -> np.ndarray:
    n, side = struct.unpack("<q", data[:8])[0], blockcodec.SIDE
    end = 8 + -(-n // side)
    sizes, out = np.frombuffer(data[8:end], np.uint8), np.empty((len(data[8:end]), side))
    for at in range(0, len(sizes), RUNS):
        ends = [end, *(end + np.cumsum(sizes[at : at + RUNS].astype(np.int64))).tolist()]
        out[at : at + RUNS] = blockcodec.decode([data[a:b] for a, b in itertools.pairwise(ends)], 1).reshape(-1, side)
        end = ends[-1]
    return out.ravel()[:n]


CODECS: dict[str, Codec] = {
    "noop": Codec(lambda x, bound: x.astype("<f8").tobytes(), lambda data, bound: np.frombuffer(data, "<f8")),
    "quant_zlib": Codec(_quant_zlib, lambda data, bound: _unpacked(data[:1], zlib.decompress(data[1:])) * (2 * bound)),
    "quant_zstd": Codec(_quant_zstd, _from_zstd),
    "lorenzo_huffman": Codec(_lorenzo_huffman, _from_lorenzo_huffman),
    "block_float": Codec(_block_float, _from_block_float),
    "transform": Codec(_transform, _from_transform),
}


# --- listeners ------------------------------------------------------------------------------------


class Listener:
    """Told of each array that a codec takes, and of each batch of them; results() gives numbers by name, for the array last told of."""

    def begin_compress(self, x: np.ndarray) -> None: ...

    def end_compress(self, x: np.ndarray, data: bytes) -> None: ...

    def begin_decompress(self, data: bytes) -> None: ...

    def end_decompress(self, data: bytes, back: np.ndarray) -> None: ...

    def begin_compress_many(self, xs: list[np.ndarray]) -> None: ...

    def end_compress_many(self, xs: list[np.ndarray], data: list[bytes]) -> None: ...

    def begin_decompress_many(self, data: list[bytes]) -> None: ...

    def end_decompress_many(self, data: list[bytes], backs: list[np.ndarray]) -> None: ...

    def results(self) -> dict[str, float]:
        return {}


EVENTS = ("begin_compress", "end_compress", "begin_decompress", "end_decompress")


class Size(Listener):
    def end_compress(self, x, data):
        self.raw, self.size = x.nbytes, len(data)

    def results(self):
        return {"size:raw_bytes": self.raw, "size:compressed_bytes": self.size, **({"size:ratio": self.raw / self.size} if self.size and self.raw else {})}


class ErrorStat(Listener):
    """Errors of the array that comes back; none without decompression."""

    def begin_compress(self, x):
        self.x, self.found = x, {}

    def end_decompress(self, data, back):
        x = self.x
        err = np.abs(x - back)
        mse, span = (float((err**2).mean()), float(np.ptp(x))) if len(x) else (0.0, 0.0)
        self.found = {"error_stat:max_error": float(err.max(initial=0.0)), "error_stat:mse": mse, "error_stat:value_range": span}
        if mse > 0 and span > 0:
            self.found["error_stat:psnr"] = 20 * np.log10(span) - 10 * np.log10(mse)

    def results(self):
        return self.found


class Time(Listener):
    """Milliseconds that compressing and decompressing take, where they are done."""

    def begin_compress(self, x):
        self.found, self.since = {}, time.perf_counter()

    def end_compress(self, x, data):
        self.found["time:compress"] = (time.perf_counter() - self.since) * 1000

    def begin_decompress(self, data):
        self.since = time.perf_counter()

    def end_decompress(self, data, back):
        self.found["time:decompress"] = (time.perf_counter() - self.since) * 1000

    def results(self):
        return self.found


class Composite(Listener):
    """Several listeners; the first is told first of a beginning and last of an end."""

    def __init__(self, listeners: list[Listener]):
        self.listeners = listeners

    def results(self):
        return {k: v for x in self.listeners for k, v in x.results().items()}


def _passed_on(event: str):
    def tell(self, *given):
        for x in self.listeners if event.startswith("begin") else reversed(self.listeners):
            getattr(x, event)(*given)

    return tell


for _event in (*EVENTS, *(f"{e}_many" for e in EVENTS)):
    setattr(Composite, _event, _passed_on(_event))


class Repeated(Listener):
    """Tells a listener of each event several times, and how long that took it: mean, std, min and max in milliseconds after the warm-ups."""

    def __init__(self, listener: Listener, replicates: int = 30, warmups: int = 2):
        self.listener, self.replicates, self.warmups = listener, replicates, warmups
        self.took: dict[str, list[float]] = {}

    def _track(self, event: str, *given) -> None:
        took = []
        for _ in range(self.warmups + self.replicates):
            since = time.perf_counter()
            getattr(self.listener, event)(*given)
            took.append((time.perf_counter() - since) * 1000)
        self.took[event] = took[self.warmups :]

    def results(self):
        out = dict(self.listener.results())
        for event, t in self.took.items():
            if t:
                out |= {f"bench:{event}:mean": statistics.fmean(t), f"bench:{event}:std": statistics.stdev(t) if len(t) > 1 else 0.0, f"bench:{event}:min": min(t), f"bench:{event}:max": max(t)}
        return out


for _event in EVENTS:
    setattr(Repeated, _event, lambda self, *given, _e=_event: self._track(_e, *given))


LISTENERS: dict[str, Callable[[], Listener]] = {"size": Size, "error_stat": ErrorStat, "time": Time}


def observed(packed: DataFrame, codec: str, bound: float, listeners: list[Listener], values: str = "values", decompress: bool = True) -> DataFrame:
    """packed with `metrics`, map<string,double>: what the listeners say of each row's array.

    Each task has listeners of its own, copies of those given; they are told of each batch of rows as many
    arrays, and of each array by itself.
    """
    run = CODECS[codec]
    # Bytes and arrays that come back are held for a batch only if a listener wants them all at once.
    many = any(getattr(type(x), f"{e}_many") is not getattr(Listener, f"{e}_many") for x in listeners for e in EVENTS)

    @F.pandas_udf("map<string,double>")
    def measure(arrays: pd.Series) -> pd.Series:
        told = Composite([copy.deepcopy(x) for x in listeners])
        xs = [np.asarray(a, dtype=float) for a in arrays]
        told.begin_compress_many(xs)
        data, backs, out = [], [], []
        for x in xs:
            told.begin_compress(x)
            one = run.encode(x, bound)
            told.end_compress(x, one)
            if many:
                data.append(one)
            if decompress:
                told.begin_decompress(one)
                back = run.decode(one, bound)
                told.end_decompress(one, back)
                if many:
                    backs.append(back)
            out.append({k: float(v) for k, v in told.results().items()})
        told.end_compress_many(xs, data)
        if decompress:
            told.begin_decompress_many(data)
            told.end_decompress_many(data, backs)
        return pd.Series(out, dtype=object)

    return packed.withColumn("metrics", measure(F.col(values)))


def compressed(packed: DataFrame, codec: str, bound: float, values: str = "values") -> DataFrame:
    """packed with raw bytes, compressed bytes, ratio and error statistics of each row's array."""
    c = observed(packed.withColumnRenamed("metrics", "_metrics") if "metrics" in packed.columns else packed, codec, bound, [Size(), ErrorStat()], values)
    got = lambda name: F.col("metrics")[name]
    sizes = [got(f"size:{n}").cast("bigint").alias(n) for n in ("raw_bytes", "compressed_bytes")]
    out = c.select("*", *sizes, got("size:ratio").alias("ratio"), *[got(f"error_stat:{n}").alias(n) for n in ("max_error", "mse", "psnr", "value_range")]).drop("metrics")
    return out.withColumnRenamed("_metrics", "metrics") if "metrics" in packed.columns else out


def sampled_ratio(tiles: DataFrame, codec: str, bound: float) -> DataFrame:
    """Per field: mean ratio of the sampled tiles, and the ratios in order of rank."""
    c = compressed(tiles, codec, bound)
    rows = c.groupBy("field_id").agg(F.avg("ratio").alias("estimate"), F.sort_array(F.collect_list(F.struct("rank", "ratio"))).alias("r"))
    return rows.select("field_id", "estimate", F.col("r.ratio").alias("ratios"))
