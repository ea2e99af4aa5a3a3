"""Huffman coding of quantisation codes to bytes and back, for fields of any size.

A field's table comes from its histogram, which Spark sums up; its codes are then written chunk by chunk with that
table, so a task holds a chunk and one field's table, whatever the field's length. All sizes are lengths of bytes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

CHUNK = 1 << 16
#: Bits of the longest code that is looked for at once.
PEEK = 48
#: Values that are written, and bits that are read, at once; a multiple of eight.
PIECE, WINDOW = 1 << 16, 1 << 18


def code_lengths(freq: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code in a Huffman tree of their frequencies; a lone symbol has one bit."""
    n = len(freq)
    if n <= 1:
        return np.ones(n, np.int64)
    heap = [(int(f), k) for k, f in enumerate(freq)]
    heapq.heapify(heap)
    up = np.zeros(2 * n - 1, np.int64)
    for node in range(n, 2 * n - 1):
        (f, a), (g, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a] = up[b] = node
        heapq.heappush(heap, (f + g, node))
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    return depth[:n]


def limited_lengths(freq: np.ndarray, most: int = PEEK) -> np.ndarray:
    """code_lengths with none above most, by levelling the frequencies until that is so."""
    f = np.asarray(freq, dtype=np.int64)
    while len(f) and (lengths := code_lengths(f)).max() > most:
        f = f // 2 + 1
    return lengths if len(f) else np.zeros(0, np.int64)


class Table:
    """A canonical code: symbols in order of (length, symbol) have rising codes, so the lengths say all."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = np.asarray(symbols, np.int64)[order], np.asarray(lengths, np.int64)[order]
        code, last, codes = 0, 0, []
        for n in self.lengths.tolist():
            code <<= n - last
            codes.append(code)
            code, last = code + 1, n
        self.codes = np.array(codes, dtype=np.uint64)
        #: The end of each code's range among all strings of PEEK bits.
        self.ends = (self.codes + np.uint64(1)) << (PEEK - self.lengths).astype(np.uint64)

    @classmethod
    def of(cls, symbols: np.ndarray, freq: np.ndarray) -> Table:
        """From a histogram."""
        order = np.argsort(symbols, kind="stable")
        return cls(np.asarray(symbols)[order], limited_lengths(np.asarray(freq)[order]))

    def to_bytes(self) -> bytes:
        """The number of symbols, their lengths, the least symbol and the steps from symbol to symbol, in as few bytes as the widest needs."""
        order = np.argsort(self.symbols, kind="stable")
        s = self.symbols[order]
        steps = np.diff(s)
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(steps) or int(steps.max()) <= np.iinfo(k).max)
        return np.array([len(s)], "<u4").tobytes() + kind[-1:].encode() + s[:1].astype("<i8").tobytes() + self.lengths[order].astype(np.uint8).tobytes() + steps.astype(kind).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        n = int(np.frombuffer(data[:4], "<u4")[0])
        if not n:
            return cls(np.empty(0, np.int64), np.empty(0, np.int64))
        first, at = np.frombuffer(data[5:13], "<i8"), 13 + n
        return cls(np.concatenate([first, first + np.cumsum(np.frombuffer(data[at:], f"<u{chr(data[4])}").astype(np.int64))]), np.frombuffer(data[13:at], np.uint8))

    def write(self, values: np.ndarray) -> bytes:
        """The codes of values, all of which the table must have, one after the other; the first eight bytes say how many."""
        order = np.argsort(self.symbols, kind="stable")
        symbols, out, rest = self.symbols[order], [np.array([len(values)], "<u8").tobytes()], np.empty(0, np.uint8)
        for start in range(0, len(values), PIECE):
            at = order[np.searchsorted(symbols, values[start : start + PIECE])]
            size, code = self.lengths[at], self.codes[at]
            back = np.repeat(np.cumsum(size), size) - np.arange(int(size.sum())) - 1
            bits = (np.repeat(code, size) >> back.astype(np.uint64)) & np.uint64(1)
            bits = np.concatenate([rest, bits.astype(np.uint8)])
            whole = len(bits) // 8 * 8
            out.append(np.packbits(bits[:whole]).tobytes())
            rest = bits[whole:]
        return b"".join([*out, np.packbits(rest).tobytes()])

    def read(self, data: bytes) -> np.ndarray:
        """The values again, window by window: each is read from where the last one's codes end."""
        n = int(np.frombuffer(data[:8], "<u8")[0])
        raw, out, got, place = np.frombuffer(data, np.uint8, offset=8), np.empty(n, np.int64), 0, 0
        while got < n:
            first = place // 8
            bits = np.unpackbits(raw[first : first + (WINDOW + PEEK) // 8])
            if place - 8 * first >= len(bits):
                raise ValueError(f"the codes end after {got} of {n} values")
            found, end = self._window(bits, place - 8 * first, min(WINDOW, len(bits)), n - got)
            out[got : got + len(found)] = found
            got, place = got + len(found), 8 * first + end
        return out

    def _window(self, bits: np.ndarray, start: int, limit: int, most: int) -> tuple[np.ndarray, int]:
        """Values whose codes start in bits[start:limit], no more than most, and where the last one ends. Every bit is taken for the start of a code; then the starts that the first leads to are followed, twice as far each time."""
        peek, have = bits.astype(np.uint64), 1
        while have < PEEK:  # the next `have` bits of each place, doubled or filled up; zeros beyond the end
            more = min(have, PEEK - have)
            tail = np.zeros(len(bits), np.uint64)
            tail[: max(0, len(bits) - have)] = peek[have:]
            peek, have = (peek << np.uint64(more)) | (tail >> np.uint64(have - more)), have + more
        which = np.minimum(np.searchsorted(self.ends, peek[:limit], "right"), len(self.ends) - 1)
        jump = np.append(np.minimum(np.arange(limit) + self.lengths[which], limit), limit)
        starts = np.array([start])
        while len(starts) < most and starts[-1] < limit:
            starts = np.concatenate([starts, jump[starts]])
            jump = jump[jump] if len(starts) < most else jump
        starts = starts[starts < limit][:most]
        return self.symbols[which[starts]], int(starts[-1] + self.lengths[which[starts[-1]]])


def tables(hist: DataFrame) -> DataFrame:
    """field_id and table, the bytes of each field's canonical table, from its histogram (field_id, code, freq)."""

    @F.pandas_udf(BinaryType())
    def make(codes: pd.Series, freq: pd.Series) -> pd.Series:
        return pd.Series([Table.of(np.asarray(c, np.int64), np.asarray(f, np.int64)).to_bytes() for c, f in zip(codes, freq, strict=True)], dtype=object)

    rows = hist.groupBy("field_id").agg(F.array_sort(F.collect_list(F.struct("code", "freq"))).alias("h"))
    return rows.select("field_id", make(F.col("h.code"), F.col("h.freq")).alias("table"))


def coded_chunks(codes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """field_id, chunk, n, data, table of codes (field_id, idx, code): each chunk of consecutive codes in the bytes of its field's table."""

    @F.pandas_udf(BinaryType())
    def write(table: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([Table.from_bytes(t).write(np.asarray(v, np.int64)) for t, v in zip(table, values, strict=True)], dtype=object)

    t = tables(codes.groupBy("field_id", "code").agg(F.count("*").alias("freq")))
    rows = codes.groupBy("field_id", F.expr(f"idx div {chunk}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("idx", "code"))).alias("c"))
    return rows.join(t, "field_id").select("field_id", "chunk", F.size("c").alias("n"), write("table", F.col("c.code")).alias("data"), "table")


def read_chunks(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """field_id, idx, code again, from the bytes alone; fields without holes."""

    @F.pandas_udf(ArrayType(LongType()))
    def read(table: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([Table.from_bytes(t).read(d) for t, d in zip(table, data, strict=True)], dtype=object)

    rows = chunks.select("field_id", "chunk", F.posexplode(read("table", "data")).alias("k", "code"))
    return rows.select("field_id", (F.col("chunk") * chunk + F.col("k")).alias("idx"), "code")


def huffman_ratio(codes: DataFrame, raw_bytes: int = 8, chunk: int = CHUNK) -> DataFrame:
    """field_id, n, n_chunks, table_bytes, data_bytes and ratio: raw bytes a value over all bytes of the table and the chunks."""
    per = coded_chunks(codes, chunk).groupBy("field_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_chunks"), F.max(F.length("table")).alias("table_bytes"), F.sum(F.length("data")).alias("data_bytes"))
    return per.withColumn("ratio", F.col("n") * float(raw_bytes) / (F.col("table_bytes") + F.col("data_bytes")))
