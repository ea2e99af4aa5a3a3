"""N-gram Jaccard self-join with a count-vector R-tree.

A document is the set of its k-word shingles, and two link when den * |A & B| >= num * |A | B|.
The result is a class for each document, the smallest doc_id reachable by links, without listing
all pairs of a class.

1. Groups. Linked sets differ in at most d shingles, d known from their sizes. Shingles are hashed
   into m = d + 1 + spare groups, so at least spare + 1 groups are equal in both sets. Each set's
   groups, keyed by size band, group and a hash of the group's content, are dealt out; sets that
   meet under a key are candidates, and only a star of each key's sets is kept, never their pairs.
   spare is chosen so that few sets have more than spare empty groups; those deal out a prefix of
   single shingles as well, which covers pairs of two such sets. So no link is missed, whatever the sizes.
   Shingles that many sets of a run of sets share, as those of a passage, are common: they are left out
   of the groups, which then differ in no more places, and come last in the order that prefixes are
   taken by. Else a passage would tie a part of the corpus into one class, and what a class's blocks
   move grows with its square. Which shingles count as common changes candidates, never links.
2. Candidate classes: connected components of those stars, one size band at a time. A set is a node
   in its own band and in those of the smaller sets that it can link to, so sets of very different
   sizes don't share a class for a passage that they share.
3. In each candidate class an R-tree over the sets' count vectors (shingles hashed into
   coordinates, more of them for larger sets) joins the sets: nodes, then leaves, are passed over when the summed minima of their
   upper bounds, or the vectors' own, are below the overlap needed. What is left is verified by
   intersection. Sets that are already in one class aren't compared again.
4. A class larger than a block is first joined block by block, each with the same few pivots. Only
   sets that are then still in different classes meet, in pairs of blocks, in rounds that each move
   a few times the sets at most.

Keys that many sets of a map task share, such as those of a passage that a third of all documents
hold, are dealt out under a key of their own for each run of sets, of which one set goes on under the
common key: no task gathers all sets of a key, and no connection is lost.

Equal sets are one set throughout. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; fewer than
k words are one shingle; a null or blank text has an empty set and is alone in its class. Rows with
a null doc_id take part; a class of only such rows has a null id. Repeated rows each get a row.
Sets and shingles are compared by 64-bit hashes. An empty table gives an empty one; other columns of
the table, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_long, discard, documents_words, join_hot, materialize, mix64, shingles
from .graph import connected_components

LEAF = 16
#: Shingles, and sets, that one block holds; and the pivots that each block of a class shares.
BLOCK_SHINGLES = 12_000_000
BLOCK_SETS = 4_000
PIVOTS = 64
#: Keys that one task holds before it sends them, and sets of such a run under one key from which on they get a key of their own.
HELD_KEYS = 200_000
MANY = 16
#: Shingles in a run of sets whose common ones are counted, and common shingles that are sent to the tasks at most, 8 bytes each.
RUN_SHINGLES = 2_000_000
COMMON = 500_000
#: Times the sets of large classes that a round of pairs of blocks moves at most.
ROUND = 2

_K1, _K2, _K3, _K4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))

_NONE = np.empty(0, np.uint64)


def _in(common: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of h are in common, a sorted array."""
    if not len(common):
        return np.zeros(len(h), dtype=bool)
    at = np.searchsorted(common, h)
    at[at == len(common)] = 0
    return common[at] == h


class Plan:
    """Size bands and numbers of groups for a shingle length and a threshold num / den."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den

    def least_partner(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of sets of these sizes that link."""
        return -(-self.num * (a + b) // (self.den + self.num))

    @lru_cache(maxsize=None)  # noqa: B019
    def band_start(self, b: int) -> int:
        return 1 if b == 0 else max(self.band_start(b - 1) + 1, -(-self.band_start(b - 1) * 5 // 4))

    def band(self, n: int) -> int:
        b = 0
        while self.band_start(b + 1) <= n:
            b += 1
        return b

    @lru_cache(maxsize=None)  # noqa: B019
    def groups(self, b: int) -> tuple[int, int]:
        """(m, spare) of pairs whose smaller set is in band b; m is 0 if such sets link only when equal."""
        n, a = self.band_start(b), self.band_start(b + 1) - 1
        d = (a + a * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if not d:
            return 0, 0
        least = spare = 2 + d // 50
        while spare <= d:
            empty = (d + 1 + spare) * math.exp(-n / (d + 1 + spare))
            if spare > empty + 2 * math.sqrt(empty):
                return d + 1 + spare, spare
            spare += 1 + spare // 50
        # A small set has about as many groups as shingles: most have empty groups whatever spare is.
        return d + 1 + least, least

    @lru_cache(maxsize=4096)  # noqa: B019
    def families(self, n: int) -> tuple[int, ...]:
        """Bands of the smaller sets that a set of n shingles can link to."""
        b, out = self.band(n), []
        while b >= 0 and self.band_start(b + 1) - 1 >= self.least_partner(n):
            if self.groups(b)[0]:
                out.append(b)
            b -= 1
        return tuple(out)

    def keys(self, h: np.ndarray, common: np.ndarray = _NONE) -> list[tuple[int, np.ndarray]]:
        """By band, the keys of a set under which it meets every other set that it links to; common: sorted, the same for all sets."""
        out = []
        last = _in(common, h)
        rare = h[~last]
        r, v = mix64(rare ^ _K1), mix64(rare + _K3)
        for b in self.families(len(h)):
            m, spare = self.groups(b)
            g = (r % np.uint64(m)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            gs = g[order]
            starts = np.flatnonzero(np.concatenate(([True], gs[1:] != gs[:-1]))) if len(gs) else np.empty(0, np.int64)
            total = np.add.reduceat(v[order], starts) if len(gs) else _NONE
            found = [mix64(total + gs[starts].astype(np.uint64) * _K1 + _band_salt(b))]
            if len(starts) < m - spare:
                prefix = np.concatenate((np.sort(r), np.sort(mix64(h[last] ^ _K1))))[: len(h) - self.least_partner(len(h)) + 1]
                found.append(mix64((prefix ^ _K3) + _band_salt(-b - 1)))
            out.append((b, np.concatenate(found)))
        return out


def node(i: np.uint64, band: int) -> int:
    """The id of a set in the candidate graph of a band."""
    return int(mix64(np.array([i ^ _band_salt(band)], dtype=np.uint64)).view(np.int64)[0])


def _band_salt(b: int) -> np.uint64:
    return np.uint64((b + 1) * int(_K2) % (1 << 64))


def set_id(h: np.ndarray) -> np.uint64:
    return mix64(np.array([(int(np.add.reduce(mix64(h ^ _K2))) + len(h) * int(_K1)) % (1 << 64)], dtype=np.uint64))[0]


class ShingleSets:
    """Sets of hashed shingles of an Arrow text column."""

    def __init__(self, k: int):
        self.k, self.hasher = k, WordHasher()

    def __call__(self, column) -> Iterator[np.ndarray]:
        for _, words in documents_words(self.hasher, column):
            yield np.unique(shingles(words, self.k))


# --- in one block ---------------------------------------------------------------------------------


class CountTree:
    """An R-tree over count vectors, packed by size and then by the coordinates that vary most."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = self._packed(counts, sizes)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        hi = np.stack([counts[x].max(axis=0) for x in self.leaves])
        lo = np.array([sizes[x].min() for x in self.leaves])
        up = np.array([sizes[x].max() for x in self.leaves])
        self.levels.append((hi, lo, up))
        while len(hi) > 1:
            cut = range(0, len(hi), LEAF)
            hi, lo, up = np.stack([hi[i : i + LEAF].max(axis=0) for i in cut]), np.array([lo[i : i + LEAF].min() for i in cut]), np.array([up[i : i + LEAF].max() for i in cut])
            self.levels.append((hi, lo, up))

    @staticmethod
    def _packed(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.argsort(sizes, kind="stable")
        slabs = max(1, int(np.sqrt(len(order) / LEAF)))
        axis = int(np.argmax(counts.var(axis=0) / (counts.mean(axis=0) + 1)))
        step = -(-len(order) // slabs)
        return np.concatenate([s[np.argsort(counts[s, axis], kind="stable")] for s in (order[i : i + step] for i in range(0, len(order), step))])

    def leaf_pairs(self, plan: Plan) -> Iterator[tuple[int, int]]:
        """Pairs of leaves whose bounds leave room for a link, by descent from the root."""
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            hi, lo, up = self.levels[level]
            small, large = min(lo[i], lo[j]), max(lo[i], lo[j])
            if i != j and (plan.least_partner(int(large)) > (up[i] if lo[i] < lo[j] else up[j])):
                continue
            if np.minimum(hi[i], hi[j]).sum(dtype=np.int64) < plan.overlap(int(small), int(max(small, min(large, up[i], up[j])))):
                continue
            if level == 0:
                yield i, j
                continue
            n = len(self.levels[level - 1][0])
            a, b = range(i * LEAF, min(n, i * LEAF + LEAF)), range(j * LEAF, min(n, j * LEAF + LEAF))
            todo += [(level - 1, x, y) for x in a for y in b if i != j or x <= y]


class Classes:
    """Union-find; the least member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def join_block(plan: Plan, sets: list[np.ndarray], start: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect the block's classes, a spanning forest of them; start: classes known before."""
    n = len(sets)
    if n < 2:
        return []
    classes = Classes(n)
    if start is not None:
        first: dict = {}
        for k, s in enumerate(start):
            classes.union(first.setdefault(s, k), k)
    sizes = np.array([len(s) for s in sets])
    dims = max(64, min(4096, 1 << (int(sizes.max()) // 4).bit_length()))
    counts = np.empty((n, dims), dtype=np.uint16 if sizes.max() < 1 << 16 else np.int32)
    for k, s in enumerate(sets):
        counts[k] = np.bincount((s % np.uint64(dims)).astype(np.int64), minlength=dims)
    tree = CountTree(counts, sizes)
    links = []
    for i, j in tree.leaf_pairs(plan):
        a, b = tree.leaves[i], tree.leaves[j]
        ra, rb = np.array([classes.find(int(x)) for x in a]), np.array([classes.find(int(x)) for x in b])
        if (ra == ra[0]).all() and (rb == ra[0]).all():
            continue
        bound = np.minimum(counts[a][:, None, :], counts[b][None, :, :]).sum(axis=2, dtype=np.int64)
        both = sizes[a][:, None] + sizes[b][None, :]
        fits = (bound * (plan.den + plan.num) >= plan.num * both) & (ra[:, None] != rb[None, :])
        for x, y in zip(*np.nonzero(fits), strict=True):
            p, q = int(a[x]), int(b[y])
            if p != q and classes.find(p) != classes.find(q) and linked(plan, sets[p], sets[q]):
                classes.union(p, q)
                links.append((p, q))
    return links


def linked(plan: Plan, a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return plan.den * both >= plan.num * (len(a) + len(b) - both) and both > 0


# --- tables ---------------------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, n_shingles, set_id (null if the set is empty) and the set's nodes, of each row.

    Beside them are rows with n_shingles -1, whose nodes are the common shingles of a run of sets.
    """

    def digest(batches):
        sets, seen, run, held = ShingleSets(plan.k), set(), [], 0
        kind = None
        for batch in batches:
            n, ids, nodes, kind = [], [], [], batch.schema.field(0).type
            for h in sets(batch.column(1)):
                i = set_id(h) if len(h) else None
                n.append(len(h))
                ids.append(None if i is None else int(i.view(np.int64)))
                nodes.append([] if i is None else [node(i, b) for b in plan.families(len(h))])
                if i is not None and i not in seen:
                    seen.add(i)
                    run.append(h)
                    held += len(h)
                    if held > RUN_SHINGLES:
                        yield _common_of_run(run, kind)
                        run, held = [], 0
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=_SET_COLUMNS)
        if run:
            yield _common_of_run(run, kind)

    return docs.select(key, text, F.xxhash64(text)).mapInArrow(digest, f"key {dict(docs.dtypes)[key]}, text_hash bigint, n_shingles bigint, set_id bigint, nodes array<bigint>")


_SET_COLUMNS = ["key", "text_hash", "n_shingles", "set_id", "nodes"]


def _common_of_run(run: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    """A row with the shingles that MANY sets of the run have; none if there are none."""
    shingle, count = np.unique(np.concatenate(run), return_counts=True)
    found = as_long(shingle[count >= MANY])
    n = int(len(found) > 0)
    return pa.record_batch([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([found] * n, pa.list_(pa.int64()))], names=_SET_COLUMNS)


def _common(found: DataFrame) -> np.ndarray:
    """The common shingles, sorted, of rows of shingle_sets(); those of most runs if they are more than COMMON."""
    each = found.where("n_shingles = -1").select(F.explode("nodes").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    most = each.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(most.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _dealt_keys(docs: DataFrame, plan: Plan, text: str, common: np.ndarray = _NONE) -> DataFrame:
    """key and node for each group of each set, once for equal sets of a task."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def emit(batches):
        sets, seen = ShingleSets(plan.k), set()
        for batch in batches:
            keys, ids, held = [], [], 0
            for h in sets(batch.column(0)):
                if not len(h):
                    continue
                i = set_id(h)
                if i in seen:
                    continue
                seen.add(i)
                for band, k in plan.keys(h, sent.value):
                    keys.append(k)
                    ids.append(np.full(len(k), node(i, band)))
                    held += len(k)
                if held > HELD_KEYS:
                    yield _keys_of_run(keys, ids)
                    keys, ids, held = [], [], 0
            if keys:
                yield _keys_of_run(keys, ids)

    return docs.select(text).mapInArrow(emit, "key bigint, node bigint")


def _keys_of_run(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    """Keys and nodes; where MANY nodes or more have a key, they have one of the run instead, and the least of them also has the key itself."""
    key, node_ = as_long(np.concatenate(keys)), as_long(np.concatenate(ids))
    order = np.lexsort((node_, key))
    key, node_ = key[order], node_[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    lead = first[size >= MANY]
    if len(lead):
        many = np.repeat(size >= MANY, size)
        # The run's key follows from its content, so a task that is run again sends the same.
        run = mix64(np.array([int(np.add.reduce(mix64(node_.view(np.uint64))))], dtype=np.uint64))[0]
        own = as_long(mix64((key.view(np.uint64) ^ _K4) + run))
        key, node_ = np.concatenate((np.where(many, own, key), key[lead])), np.concatenate((node_, node_[lead]))
    return pa.record_batch([pa.array(key), pa.array(node_)], names=["key", "node"])


def candidate_stars(docs: DataFrame, plan: Plan, text: str = "text", common: np.ndarray = _NONE) -> DataFrame:
    """Edges a, b: the least node of each key and the others. Rows come sorted, so a key of any size streams through."""

    def stars(batches):
        last_key, center = None, None
        for batch in batches:
            k, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(k):
                continue
            new = np.concatenate(([last_key is None or k[0] != last_key], k[1:] != k[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            mid = np.where(at >= 0, i[np.maximum(at, 0)], center if center is not None else 0)
            last_key, center = k[-1], mid[-1]
            edge = mid != i
            if edge.any():
                pairs = np.unique(np.stack([mid[edge], i[edge]], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    keys = _dealt_keys(docs, plan, text, common)
    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(stars, "a bigint, b bigint").distinct()


def _join_blocks(rows: DataFrame, plan: Plan) -> DataFrame:
    """Links a, b found in each block; rows: block string, set_id, start (class so far) and _text."""

    def join(batches):
        sets = ShingleSets(plan.k)
        name, ids, held, starts = None, {}, [], []

        def finish():
            found = join_block(plan, held, starts)
            back = list(ids)
            return pa.record_batch([pa.array([back[p] for p, _ in found], pa.int64()), pa.array([back[q] for _, q in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for block, i, s, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets(batch.column(3)), strict=True):
                if block != name:
                    if len(held) > 1:
                        yield finish()
                    name, ids, held, starts = block, {}, [], []
                # Rows that repeat a doc_id and its text are one set; a text whose hash is another's isn't this set.
                if i not in ids and len(h) and int(set_id(h).view(np.int64)) == i:
                    ids[i] = len(held)
                    held.append(h)
                    starts.append(i if s is None else s)
        if len(held) > 1:
            yield finish()

    return rows.select("block", "set_id", "start", "_text").repartition("block").sortWithinPartitions("block", "set_id").mapInArrow(join, "a bigint, b bigint")


def _share(x):
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(x, F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def classes_of_sets(docs: DataFrame, sets: DataFrame, plan: Plan, key: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """set_id and label of each set that links to another; sets: the written table of shingle_sets()."""
    stars = materialize(candidate_stars(docs, plan, text, _common(sets)), "stars", release=True)
    found = connected_components(stars)
    discard(stars)
    # One text of each member set stands for it, found by its row's key and its own hash, since many rows may share a key or have none.
    one = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("text_hash").alias("hash")))
    stand = sets.where("set_id is not null").groupBy("set_id").agg(one.alias("_one"), F.max("n_shingles").alias("n"), F.first("nodes").alias("nodes"))
    nodes = stand.select("set_id", F.col("_one.key").alias("_key"), F.col("_one.hash").alias("_hash"), "n", F.explode("nodes").alias("node"))
    # The keys' files may outlive stars, as long as its events wait for listeners; texts shouldn't come on top of them.
    members = materialize(nodes.join(found.withColumnRenamed("label", "cand"), "node").drop("node"), "members", release=True)
    members_table = members
    discard(found)
    weight = members.groupBy("cand").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    weight = weight.select("cand", "w", F.greatest(F.ceil(F.col("w") / block_shingles), F.ceil(F.col("c") / block_sets)).cast("int").alias("nb"), "c")
    members = members.join(weight, "cand")
    is_pivot = (F.col("nb") > 1) & (_share(F.col("set_id")) < F.lit(float(PIVOTS)) / F.col("c"))
    own = F.pmod(F.xxhash64("set_id"), F.col("nb")).cast("int")
    spread = members.withColumn("part", F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(own))))
    block = F.concat_ws(":", "cand", "part")
    texts = _with_text(docs, spread.select("_key", "_hash", "cand", "set_id", block.alias("block"), ((F.col("nb") > 1) & (F.col("part") == own)).alias("big"), F.lit(None).cast("bigint").alias("start")), key, text)
    big = members.where("nb > 1").select("set_id", "cand", "n")
    if not big.limit(1).count():
        links = materialize(_join_blocks(texts, plan), "links", release=True)
        discard(members_table)
        return _labels(links)
    # The members' texts are needed again, so they are kept; the corpus is dealt out once.
    texts = materialize(texts, "texts", release=True)
    links = materialize(_join_blocks(texts, plan), "links", release=True)
    links = _across_blocks(texts.where("big").select("cand", "set_id", "_text"), big, links, plan, block_shingles)
    discard(texts, members_table)
    return _labels(links)


def _labels(links: DataFrame) -> DataFrame:
    found = connected_components(links)
    discard(links)
    out = found.select(F.col("node").alias("set_id"), "label")
    out._cellgauge_path = found._cellgauge_path
    return out


def _across_blocks(texts: DataFrame, big: DataFrame, links: DataFrame, plan: Plan, block_shingles: int) -> DataFrame:
    """links and those between sets of one large candidate class that are still in different classes."""
    labels = connected_components(links.join(big.select(F.col("set_id").alias("a")), "a", "left_semi"))
    rows = big.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("start", F.coalesce("label", "set_id")).drop("label")
    size = rows.groupBy("cand", "start").agg(F.sum("n").alias("w"))
    split = size.groupBy("cand").agg(F.count("*").alias("k"), F.sum(F.when(F.col("w") <= block_shingles / 4, F.col("w")).otherwise(0)).alias("ws")).where("k > 1")
    rows = rows.join(size, ["cand", "start"]).join(split, "cand")
    half = block_shingles / 2
    pure = F.col("w") > block_shingles / 4
    unit = F.when(pure, F.concat(F.lit("L"), F.col("start"), F.lit("/"), F.pmod(F.xxhash64("set_id"), F.ceil(F.col("w") / half).cast("bigint")))).otherwise(F.concat(F.lit("S"), F.pmod(F.xxhash64("start"), F.ceil(F.col("ws") / half).cast("bigint"))))
    rows = materialize(rows.select("cand", "set_id", "n", "start", unit.alias("unit"), F.when(pure, F.col("start")).alias("only")), "units")
    discard(labels)
    units = rows.groupBy("cand").agg(F.collect_set(F.struct("unit", "only")).alias("units"))
    pairs = rows.join(units, "cand").withColumn("other", F.explode("units")).where(~F.coalesce(F.col("only") == F.col("other.only"), F.lit(False)))
    block = F.concat_ws("|", F.col("cand").cast("string"), F.least("unit", "other.unit"), F.greatest("unit", "other.unit"))
    pairs = pairs.select("cand", "set_id", block.alias("block"), "start", "n")
    # Each set goes to the pairs of its unit with all others: what moves grows with the square of a class, so it moves in rounds.
    moved, held = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], big.agg(F.sum("n")).first()[0]
    rounds = max(1, -(-moved // (ROUND * held)))
    for k in range(rounds):
        part = pairs.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == k).drop("n")
        more = _join_blocks(part.join(texts, ["cand", "set_id"]), plan)
        out = materialize(links.unionByName(more), "links", release=True)
        discard(links)
        links = out
    discard(rows)
    return links


def _with_text(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    # Merged at every size: rows grows with the documents that have near copies.
    d = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    return rows.hint("merge").join(d, (rows["_hash"] == d["_h"]) & rows["_key"].eqNullSafe(d["_k"])).drop("_k", "_h", "_key", "_hash")


def components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """key, n_shingles and component_id of each row of docs."""
    plan = Plan(k, num, den)
    sets = materialize(shingle_sets(docs, plan, key, text), "sets")
    labels = classes_of_sets(docs, sets, plan, key, text, **limits)
    rows = sets.where("n_shingles >= 0").join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    rows = materialize(rows, "labelled")
    discard(sets, labels)
    first = rows.where("label is not null").groupBy("label").agg(F.min("key").alias("component_id"), F.count("*").alias("_n"))
    out = join_hot(rows, first, "label", "_n", rows.count(), "left", first.agg(F.max("_n")).first()[0] or 0)
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
