"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage by block-max WAND.

A passage is two neighbouring blocks of BLOCK_WORDS words (or as many as the longest item has), so
every item that a text repeats lies within one passage. A passage retrieves every item whose BM25
score for it is at least `threshold` of the score of the item's own words.

Scores are kept as shares of that own score. Postings are cut into blocks of items with the greatest
share in each. First the block maxima of a passage's terms are summed for all blocks, for a run of
passages at once; terms whose greatest shares sum up to less than SLACK are left out of these
bounds, which add SLACK instead (they are the frequent words, with the long postings). Blocks below
the threshold are skipped. In the others a cursor for each term stands at its next item: cursors are
sorted by item, the pivot is the first item at which the maxima summed so far reach the threshold,
and either all cursors stand there and the item is scored in full, or those before it skip to it.
All passages walk in step. So all items above the threshold are found, and little else is scored.

What is retrieved is verified: of the three-word sequences of an item's question, and of its answer,
at least `overlap` must occur in the passage or the blocks beside it. An item without columns of its
own for them is parted into its first and second half.

Words are runs of what is neither ASCII white space nor ASCII punctuation, with A-Z lower-cased.
Null or blank texts, items without words, and empty tables give no rows; repeated items are items of
their own, whose ids are whole numbers; rows that share a key count as one; other columns, whatever their names, are left out.
One index of at most CHUNK_ITEMS items and CHUNK_CHARS characters is broadcast; of more items there
are more such indexes in the shared folder, and each task goes through them for each GROUP_WORDS words
that it has read, so the texts are scanned once. Document frequencies, mean length and passage width
are those of all items, so chunks change no result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, as_long, blocks_words, discard, materialize, mix64, scratch

BLOCK_WORDS = 64
ITEM_BLOCK = 4
SLACK = 0.05
CHUNK_ITEMS = 5_000
CHUNK_CHARS = 5_000_000
GROUP_WORDS = 4_000_000
#: Passages whose block bounds are held at a time.
RUN_PASSAGES = 4_096
#: Sums of floats differ by less in whatever order they are made.
TINY = 1e-9
GRAM = 3
K1, B = 1.2, 0.75


def item_words():
    """A function that gives the word hashes of an item's text."""
    hasher = WordHasher(punctuation=True)
    return lambda t: hasher.words(np.frombuffer(t.encode(), np.uint8))[0]


class Whole:
    """What scores take from all items: their number, mean and greatest length, and in how many each term is."""

    def __init__(self, items: DataFrame):
        """items: columns id, question and answer without nulls."""

        def count(batches):
            words = item_words()
            for batch in batches:
                found = [np.concatenate([words(q), words(a)]) for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                terms = [as_long(np.unique(w)) for w in found]
                bounds = np.cumsum([0] + [len(t) for t in terms])
                flat = pa.array(np.concatenate(terms) if terms else np.empty(0, np.int64), pa.int64())
                yield pa.record_batch([pa.array([len(w) for w in found], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)], names=["length", "terms"])

        rows = materialize(items.select("question", "answer").mapInArrow(count, "length bigint, terms array<bigint>"), "items")
        r = rows.where("length > 0").agg(F.count("*"), F.sum("length"), F.max("length")).first()
        self.count, self.mean, self.longest = r[0], (r[1] or 0) / max(1, r[0]), r[2] or 0
        self.table = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
        discard(rows)

    def frequencies(self, vocabulary: np.ndarray) -> np.ndarray:
        """The number of items that have each term of a sorted vocabulary, each of which some item has."""
        wanted = self.table.sparkSession.createDataFrame(pa.table({"term": as_long(vocabulary)}))
        got = self.table.join(F.broadcast(wanted), "term").select("term", "df").toArrow()
        term, df = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
        out = np.empty(len(vocabulary), np.int64)
        out[np.searchsorted(vocabulary, term)] = df
        return out


class ItemIndex:
    """Impacts of terms on items as shares of each item's own score, by term and with block maxima."""

    def __init__(self, items: list[tuple[int, str, str]], threshold: float, overlap: float, whole: Whole | None = None):
        """items: (id, question, answer); an empty answer means that the question is the whole item.

        whole: of the items that these are a part of; None if these are all.
        """
        if not threshold > SLACK:
            raise ValueError(f"the threshold must be above {SLACK}")
        self.threshold, self.overlap = threshold, overlap
        words = item_words()
        self.ids, self.parts, terms = [], [], []
        for i, q, a in items:
            wq, wa = words(q), words(a)
            if not len(wa):
                wq, wa = wq[: len(wq) // 2], wq[len(wq) // 2 :]
            if len(wq) + len(wa):
                self.ids.append(i)
                self.parts.append((grams(wq), grams(wa)))
                terms.append(np.concatenate([wq, wa]))
        self.vocabulary = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.uint64)
        n = len(terms)
        lengths = np.array([len(t) for t in terms], dtype=float)
        self.block_words = max(BLOCK_WORDS, whole.longest if whole else int(lengths.max(initial=0)))
        term_of, item_of, tf = [], [], []
        for k, t in enumerate(terms):
            u, c = np.unique(np.searchsorted(self.vocabulary, t), return_counts=True)
            term_of.append(u)
            item_of.append(np.full(len(u), k))
            tf.append(c)
        if not n:
            return
        term, item, tf = np.concatenate(term_of), np.concatenate(item_of), np.concatenate(tf).astype(float)
        df = whole.frequencies(self.vocabulary) if whole else np.bincount(term, minlength=len(self.vocabulary))
        count, mean = (whole.count, whole.mean) if whole else (n, lengths.mean())
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        impact /= np.bincount(item, weights=impact, minlength=n)[item]
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        # Block maxima, by term and block.
        self.blocks = -(-n // ITEM_BLOCK)
        key = term[order] * self.blocks + self.item // ITEM_BLOCK
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        self.cells, self.cell_first = key[starts], np.concatenate((starts, [len(key)]))
        self.block, self.block_max = key[starts] % self.blocks, np.maximum.reduceat(self.impact, starts)
        self.block_first = np.searchsorted(key[starts] // self.blocks, np.arange(len(self.vocabulary) + 1))
        # The terms that the first bounds leave out: those with the least greatest shares.
        top = np.maximum.reduceat(self.impact, self.first[:-1])
        rank = np.argsort(top, kind="stable")
        self.essential = np.ones(len(top), dtype=bool)
        self.essential[rank[np.cumsum(top[rank]) < SLACK]] = False

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The vocabulary's index of each word, or -1."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words, at, -1)

    def walk(self, block: np.ndarray, pair: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, item, score) of the items of block[k] that reach the threshold for the distinct terms given with pair k, by cursors."""
        key = term * self.blocks + block[pair]
        at = np.searchsorted(self.cells, key)
        at[at == len(self.cells)] = 0
        hit = self.cells[at] == key
        pair, term, at = pair[hit], term[hit], at[hit]
        pos, end, top = self.cell_first[at], self.cell_first[at + 1], self.block_max[at]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        while len(pair):
            item = self.item[pos]
            order = np.lexsort((term, item, pair))
            pair, term, item, pos, end, top = (x[order] for x in (pair, term, item, pos, end, top))
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            size = np.diff(np.concatenate((first, [len(pair)])))
            group = np.repeat(np.arange(len(first)), size)
            run = np.cumsum(top)
            reached = np.flatnonzero(run - np.repeat(run[first] - top[first], size) >= self.threshold - TINY)
            # The pivot: the item of the first cursor at which the sum is reached.
            has, lead = np.unique(group[reached], return_index=True)
            pivot = np.full(len(first), -1)
            pivot[has] = item[reached[lead]]
            goal = pivot[group]
            whole = (pivot == item[first])[group] & (item == goal)
            if whole.any():
                g, slot = np.unique(group[whole], return_inverse=True)
                score = np.bincount(slot, weights=self.impact[pos[whole]])
                good = score >= self.threshold
                found.append((pair[first[g[good]]], pivot[g[good]], score[good]))
            # Cursors at a scored item go on, those before a pivot skip to it; where no pivot is, the pair is done.
            pos = pos + whole
            behind = (goal >= 0) & ~whole & (pos < end)
            while (behind := behind & (pos < end) & (self.item[np.minimum(pos, len(self.item) - 1)] < goal)).any():
                pos = pos + behind
            keep = (goal >= 0) & (pos < end)
            pair, term, pos, end, top = (x[keep] for x in (pair, term, pos, end, top))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def search(self, words: np.ndarray, bounds: np.ndarray):
        """(row, item, score, question overlap, answer overlap) of verified items in rows of words."""
        if not len(self.vocabulary):
            return
        size = np.diff(bounds)
        rows = np.repeat(np.arange(len(size)), size)
        # Each row has blocks of its own, and an empty one behind it, so no passage reaches into the next row.
        per = -(-size // self.block_words)
        base = np.concatenate(([0], np.cumsum(per + 1)))
        place = base[rows] + (np.arange(len(words)) - bounds[rows]) // self.block_words
        term = self.terms(words)
        known = np.flatnonzero(term >= 0)
        V = len(self.vocabulary)
        mine = np.unique(place[known] * V + term[known])
        total = int(base[-1])
        for lo in range(0, total, RUN_PASSAGES):
            hi = min(total, lo + RUN_PASSAGES)
            # A run's last passage needs the block behind it.
            part = mine[np.searchsorted(mine, lo * V) : np.searchsorted(mine, (hi + 1) * V)]
            for q, item, score in self._retrieved(part, lo, hi):
                row = int(np.searchsorted(base, q, "right")) - 1
                at = bounds[row] + (q - base[row]) * self.block_words
                around = grams(words[max(bounds[row], at - self.block_words) : min(bounds[row + 1], at + 3 * self.block_words)])
                question, answer = (share(g, around) for g in self.parts[item])
                if min(question, answer) >= self.overlap:
                    yield row, self.ids[item], score, question, answer

    def _retrieved(self, mine: np.ndarray, lo: int, hi: int):
        """(passage, item, score) above the threshold, of passages lo to hi - 1; mine: sorted keys place * vocabulary + term."""
        V, blocks = len(self.vocabulary), self.blocks
        p, t = mine // V, mine % V
        essential = self.essential[t]
        if not essential.any():
            return
        p, t = p[essential] - lo, t[essential]
        n = self.block_first[t + 1] - self.block_first[t]
        at = spread(self.block_first[t], n)
        bound = np.bincount(np.repeat(p, n) * blocks + self.block[at], weights=self.block_max[at], minlength=(hi - lo + 1) * blocks).reshape(-1, blocks)
        bound[:-1] += bound[1:]
        q, block = np.nonzero(bound[: hi - lo] + SLACK >= self.threshold - TINY)
        # The distinct terms of both halves of each passage that is left.
        q = q + lo
        first = np.searchsorted(mine, q * V)
        n = np.searchsorted(mine, (q + 2) * V) - first
        pair = np.unique(np.repeat(np.arange(len(q)), n) * V + mine[spread(first, n)] % V)
        found = self.walk(block, pair // V, pair % V)
        yield from zip(q[found[0]].tolist(), found[1].tolist(), found[2].tolist(), strict=True)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices first[k], first[k] + 1, ... n[k] of them, for each k in turn."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else first, n) + np.arange(int(n.sum()))


def grams(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of the GRAM-word sequences; a shorter text is one."""
    n = min(GRAM, len(words))
    if not n:
        return np.empty(0, np.uint64)
    acc = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return np.unique(acc)


def share(part: np.ndarray, around: np.ndarray) -> float:
    """The part of sequences that occur around; 1 for a part without words."""
    return float(np.isin(part, around).mean()) if len(part) else 1.0


RESULT = "doc_id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double"


def _chunks(items: DataFrame):
    """(list of items, whether it is all of them), within the bounds for broadcasting; two lists are held at a time."""
    held: list = []
    chars, before = 0, None
    for i, q, a in items.toLocalIterator():
        if held and (len(held) >= CHUNK_ITEMS or chars + len(q) + len(a) > CHUNK_CHARS):
            if before is not None:
                yield before, False
            before, held, chars = held, [], 0
        held.append((i, q, a))
        chars += len(q) + len(a)
    if before is not None:
        yield before, False
    yield held, before is None


class _Chunks:
    """The indexes of all items: the one that is broadcast, or files of the shared folder, read one after the other."""

    def __init__(self, alone=None, files: list[str] | None = None):
        self.alone, self.files = alone, files or []

    def __iter__(self):
        if self.alone is not None:
            yield self.alone.value
        for uri in self.files:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                yield pickle.loads(f.read())


def _indexes(items: DataFrame, threshold: float, overlap: float) -> _Chunks:
    """items: columns id, question and answer without nulls. Two chunks of items are on the driver at a time."""
    spark = items.sparkSession
    whole, files, folder = None, [], None
    for chunk, alone in _chunks(items):
        if alone:
            return _Chunks(alone=spark.sparkContext.broadcast(ItemIndex(chunk, threshold, overlap)))
        from pyarrow import fs

        if whole is None:
            whole, folder = Whole(items), scratch(spark, "item-index")
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{len(files):06d}", compression=None) as f:
            f.write(pickle.dumps(ItemIndex(chunk, threshold, overlap, whole), protocol=5))
        files.append(f"{folder}/{len(files):06d}")
    discard(whole.table)
    return _Chunks(files=files)


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, key: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "text", answer: str | None = None) -> DataFrame:
    """Per document and item that it repeats: the best passage's score and both overlaps."""
    items = items.select(F.col(item_id).cast("bigint").alias("id"), F.coalesce(question, F.lit("")).alias("question"), (F.coalesce(answer, F.lit("")) if answer else F.lit("")).alias("answer"))
    indexes = _indexes(items, threshold, overlap)

    def search(batches):
        hasher = WordHasher(punctuation=True)

        def flush(group):
            found = []
            for index in indexes:
                for k, (_, words, bounds) in enumerate(group):
                    found += [(k, *hit) for hit in index.search(words, bounds)]
            for k, (keys, _, _) in enumerate(group):
                hits = [h[1:] for h in found if h[0] == k]
                if hits:
                    row, *cols = zip(*hits, strict=True)
                    yield pa.record_batch([keys.take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        group, held = [], 0
        for batch in batches:
            for lo, words, bounds, _, _ in blocks_words(hasher, batch.column(1)):
                group.append((batch.column(0).slice(lo, len(bounds) - 1), words, bounds))
                held += len(words)
                if held >= GROUP_WORDS or indexes.alone is not None:
                    yield from flush(group)
                    group, held = [], 0
        yield from flush(group)

    found = docs.select(key, text).mapInArrow(search, RESULT.format(kind=dict(docs.dtypes)[key]))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b"))
    return best.select(F.col("doc_id").alias(key), "item_id", "b.*")
