"""Helpers shared by the corpus operators: shared storage, table access, vectorised word hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
WS_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_MULT = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where they are one process."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that the driver and the executors of {master} share")
        found = getattr(spark, "_cellgauge_shared", None)
        if not found:
            found = spark._cellgauge_shared = "file://" + tempfile.mkdtemp(prefix="cellgauge-")
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    return str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors.

    release: have the JVM collect its garbage, so that the shuffle files behind df, which nothing
    needs any more, are deleted now rather than when memory runs short.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    if release:
        del df
        gc.collect()
        spark._jvm.System.gc()
    out._cellgauge_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of materialize() that no returned plan reads any more."""
    for df in frames:
        path = getattr(df, "_cellgauge_path", None)
        if path:
            spark = df.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(df: DataFrame, name: str) -> str:
    """name, or a longer one that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Keys that join_hot() sends at most, and rows of a key from which on it does.
HOT_KEYS = 200_000
HOT_ROWS = 50_000


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int, how: str = "inner", largest: int | None = None) -> DataFrame:
    """rows and the columns of per_key, a table with one row for each key, by key.

    count: the column of per_key (left out of the result) with the rows that have the key; total: about
    how many rows there are; largest: how many one key has at most, if that is known. Keys with many
    rows, HOT_KEYS at most, are sent to the rows, so none of them is one task's work; the others are
    joined. rows is read twice where there are such keys.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    if (total if largest is None else largest) <= most:
        return rows.join(per_key.drop(count), key, how)
    given = [c for c in per_key.columns if c not in (key, count)]
    mark = free(rows, "_hot")
    sent = [free(rows, f"_hot_{c}") for c in given]
    hot = per_key.where(F.col(count) > most).select(F.col(key).alias(mark), *[F.col(c).alias(x) for c, x in zip(given, sent, strict=True)])
    both = rows.join(F.broadcast(hot), rows[key] == hot[mark], "left")
    few = both.where(F.col(mark).isNull()).drop(mark, *sent).join(per_key.where(F.col(count) <= most).drop(count), key, how)
    many = both.where(F.col(mark).isNotNull()).drop(mark).withColumnsRenamed(dict(zip(sent, given, strict=True)))
    return few.unionByName(many)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(fold: bool) -> np.ndarray:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _CHUNK + 1
    inv = pow(_MULT, -1, 1 << 64)
    up, down = (np.full(n, v, dtype=np.uint64) for v in (_MULT, inv))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 buffers, A-Z folded, without a Python loop over words."""

    def __init__(self, fold: bool = True, punctuation: bool = False):
        """punctuation: ASCII punctuation parts words too."""
        self.values = _byte_values(fold)
        self.space = np.zeros(256, dtype=bool)
        self.space[list(WS_BYTES)] = True
        if punctuation:
            self.space[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
        self.up, self.down = _powers()

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word of a byte buffer, whose length is not limited."""
        parts, at, n = [], 0, len(data)
        while at < n:
            to = min(n, at + _CHUNK)
            if to < n and not self.space[data[to - 1]] and not self.space[data[to]]:
                gaps = np.flatnonzero(self.space[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:  # one word longer than a chunk: hash it by itself
                    rest = self.space[data[to:]]
                    end = to + int(np.argmax(rest)) if rest.any() else n
                    parts.append((self._long(data[at:end]), np.array([at]), np.array([end])))
                    at = end
                    continue
            h, s, e = self._chunk(data[at:to])
            parts.append((h, s + at, e + at))
            at = to
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _chunk(self, data: np.ndarray):
        gap = self.space[data]
        edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
        return mix64((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), start, end

    def _long(self, data: np.ndarray) -> np.ndarray:
        total, scale = 0, 1
        for at in range(0, len(data), _CHUNK):
            piece = data[at : at + _CHUNK]
            total += scale * int(np.sum(self.values[piece] * self.up[: len(piece)], dtype=np.uint64))
            scale = scale * pow(_MULT, len(piece), 1 << 64) % (1 << 64)
        return mix64(np.array([(total + len(data)) % (1 << 64)], dtype=np.uint64))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column without copying; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def blocks_of(offsets: np.ndarray, limit: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows with at most limit bytes together, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def documents_words(hasher: WordHasher, column) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) for each row of an Arrow string column, in order."""
    for lo, h, bounds, _, _ in blocks_words(hasher, column):
        for k in range(len(bounds) - 1):
            yield lo + k, h[bounds[k] : bounds[k + 1]]


def blocks_words(hasher: WordHasher, column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of rows: (first row, word hashes, each row's bounds in them, words' starts and ends in their row's bytes)."""
    offsets, data = text_buffers(column)
    for lo, hi in blocks_of(offsets):
        # A row's last word must not run into the next row's first one.
        pieces = data[offsets[lo] : offsets[hi]]
        if hi - lo > 1:
            cuts = offsets[lo + 1 : hi] - offsets[lo]
            pieces = np.insert(pieces, cuts, 0x20)
            ends = np.concatenate((cuts + np.arange(len(cuts)), [len(pieces)]))
        else:
            ends = np.array([len(pieces)])
        h, start, end = hasher.words(pieces)
        bounds = np.concatenate(([0], np.searchsorted(start, ends)))
        origin = np.repeat(np.concatenate(([0], ends[:-1] + 1)), np.diff(bounds))
        yield lo, h, bounds, start - origin, end - origin


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, in order; a shorter sequence is one shingle; no words, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(k, n)
    acc = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        acc = mix64(acc * np.uint64(_MULT) + words[j : n - size + 1 + j])
    return acc


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def chunked(items: Iterable, n: int) -> Iterator[list]:
    out: list = []
    for x in items:
        out.append(x)
        if len(out) >= n:
            yield out
            out = []
    if out:
        yield out
