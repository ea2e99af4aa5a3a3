"""Spelling variant grouping by a rare-first q-gram prefix filter.

Words are counted where the texts are, so only a task's distinct words move. All pairs of words that differ by
one inserted, deleted or replaced code point are then found without comparing all words:

* Bigrams have a global order, by the number of words that hold them (counted per bucket of a hash, so the table
  of counts has ORDERED rows for any alphabet), the rarest first. One edit touches at most two bigrams of a word,
  so of two near words' three rarest bigrams at least one is in both, at the same place if the words are
  equally long and else at the same place or the next. Words meet in groups by (bigram, place, length), where
  the shorter of two words also calls at the groups of words one longer, at either place.
* A group of more than DENSE words is dealt out again by what a word leaves when a code point is taken out: near
  words have such a rest in common, or the longer's rest is the shorter. So no group's pairs are all compared,
  however many words have a bigram, and no pair is lost.
* Pairs that meet are verified by their edit distance, and counted once.

A word's form is its near word with the largest count n (ties: the smallest in code-point order) if that is
RATIO times the word's own n at least. Its root is found by following forms to the last, twice as far at each
round; a form has a larger n, so this ends.

Null and empty texts hold no words. Repeated rows count again. A null id is an empty string where ids take part
(misspell). Words of any length are taken; long texts are read in pieces. Empty tables give no rows; columns
other than the id and the text aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix64

#: What a word is made of, its least length and number of occurrences, and how much more frequent a form is.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Rare bigrams of a word that lead to its groups: one more than an edit can touch.
RARE = 3
#: Buckets of bigrams.
ORDERED = 1 << 16
#: Words of a group from which on it is dealt out again.
DENSE = 100
#: Keys of such groups that are broadcast at most, 8 bytes each.
SENT_KEYS = 1_000_000
#: Distinct words that a task holds, and occurrences of one text that it counts together.
HELD_WORDS = 300_000
PIECE = 100_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: From an id as text to what turns a lower-cased word of its text into the word that is counted.
Change = Callable[[str], Callable[[str], str]]


def misspell(doc_id: str, every: int = 199) -> Callable[[str], str]:
    """Takes one code point out of a word, if `every` divides the CRC-32 of id and word."""
    start = crc32(f"{doc_id}:".encode())

    def bent(word: str) -> str:
        h = crc32(word.encode(), start)
        if h % every:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return bent


def _counted(find: re.Pattern, text: str) -> Iterator[Counter]:
    """Occurrences of the pattern's matches in a text, a long text in pieces."""
    if len(text) <= 8 * PIECE:
        yield Counter(find.findall(text))
        return
    runs = (m[0] for m in find.finditer(text))
    while piece := Counter(islice(runs, PIECE)):
        yield piece


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Change | None = None) -> DataFrame:
    """word and n, its occurrences in all texts, of words (A-Z lower-cased) with least_length code points and least_count occurrences.

    change: applied to each occurrence before it is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(pattern), Counter()

        def out() -> pa.RecordBatch:
            held = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return held

        for b in batches:
            for doc_id, whole in zip(b.column(0), b.column(1), strict=True):
                bent = change(doc_id.as_py()) if change else None
                for piece in _counted(find, whole.as_py() or ""):
                    for run, n in piece.items():
                        word = run.lower() if run.isascii() else run.translate(_LOWER)
                        word = bent(word) if bent else word
                        if len(word) >= least_length:
                            seen[word] += n
                    if len(seen) > HELD_WORDS:
                        yield out()
        yield out()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words one after the other, their number of each)."""
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64), pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, hash) of each bigram of each word, in order."""
    code, size = _codes(words)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    first = np.flatnonzero(word[:-1] == word[1:])
    return word[first], place[first], mix64(code[first] * np.uint64(0x110000) + code[first + 1])


def _bigram_counts(words: DataFrame) -> np.ndarray:
    """Of each bucket of bigrams, how many words' bigrams are in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDERED, np.int64)
        for b in batches:
            total += np.bincount((_grams(b.column(0))[2] % np.uint64(ORDERED)).astype(np.int64), minlength=ORDERED)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = words.select("word").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(ORDERED, np.int64)
    for r in rows:  # ORDERED rows at most
        out[r["bucket"]] = r["n"]
    return out


def _groups(gram: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix64(gram + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


CALL = "group bigint, own boolean, word string, n bigint"


def _calls(words: DataFrame) -> DataFrame:
    """group, own, word, n: the groups of each word's rarest bigrams, its own ones and those of words one longer where it calls."""
    counts = words.sparkSession.sparkContext.broadcast(_bigram_counts(words))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, place, gram = _grams(b.column(0))
            order = np.lexsort((place, gram, counts.value[(gram % np.uint64(ORDERED)).astype(np.int64)], word))
            # Of each word the first RARE in the order.
            held = word[order]
            order = order[np.arange(len(held)) - np.searchsorted(held, held) < RARE]
            word, place, gram = word[order], place[order], gram[order]
            size = pc.utf8_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)[word]
            group = np.concatenate([_groups(gram, place, size), _groups(gram, place, size + 1), _groups(gram, place + 1, size + 1)])
            at = pa.array(np.tile(word, 3))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.repeat([True, False, False], len(word))), b.column(0).take(at), b.column(1).take(at)], ["group", "own", "word", "n"])

    return words.select("word", "n").mapInArrow(call, CALL)


def _rests(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hash) of what is left of each word without each of its code points, in order, and each word's own hash."""
    code, size = _codes(words)
    word, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    place = np.arange(len(code)) - start[word]
    power = np.full(int(size.max(initial=0)) + 1, np.uint64(0x9E3779B97F4A7C15))
    power[0] = 1
    power = np.multiply.accumulate(power)
    # A hash is the sum of code * power of its place; places after the one taken out move by one.
    whole = np.concatenate(([np.uint64(0)], np.cumsum(code * power[place], dtype=np.uint64)))
    moved = np.concatenate(([np.uint64(0)], np.cumsum(code * power[np.maximum(place - 1, 0)], dtype=np.uint64)))
    at, end = np.arange(len(code)), (start + size)[word]
    rest = whole[at] - whole[start[word]] + moved[end] - moved[at + 1]
    return word, mix64(rest), mix64(whole[start + size] - whole[start])


def _dealt_again(calls: DataFrame) -> DataFrame:
    """The calls at dense groups, each for every rest of the word, or for the word itself where it is the shorter."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column(0).to_numpy().view(np.uint64)
            own = b.column(1).to_numpy(zero_copy_only=False)
            row, rest, self = _rests(b.column(2))
            # Of equal code points side by side one rest is enough.
            keep = own[row] & np.append((row[1:] != row[:-1]) | (rest[1:] != rest[:-1]), True)[: len(row)]
            short = np.flatnonzero(~own)
            at = np.concatenate([row[keep], short])
            dealt = mix64(np.concatenate([rest[keep], self[short]]) + group[at])
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(dealt.view(np.int64)), *(b.column(c).take(at) for c in (1, 2, 3))], ["group", "own", "word", "n"])

    return calls.mapInArrow(deal, CALL)


def near_pairs(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """a, n_a, b, n_b: each pair of words that differ by exactly one code point inserted, deleted or replaced, once.

    words: word, n; read several times, so it should be a written table. Words need RARE bigrams.
    """
    calls = materialize(_calls(words), "calls")
    crowded = materialize(calls.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") > dense).select(F.col("group").alias("crowded")), "crowded")
    few = crowded.count() <= SENT_KEYS
    marked = calls.join(F.broadcast(crowded) if few else crowded, F.col("group") == F.col("crowded"), "left")
    dealt = _dealt_again(marked.where("crowded is not null").select("group", "own", "word", "n"))
    met = marked.where("crowded is null").select("group", "own", "word", "n").unionByName(dealt)
    one = met.where("own").select("group", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = met.select("group", F.col("own").alias("own_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    # Equally long words meet from both sides; a shorter one only calls.
    pairs = one.join(other, "group").where("(not own_b or a < b) and levenshtein(a, b, 1) = 1")
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame, ratio: int = RATIO, dense: int = DENSE) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of words (word, n)."""
    words = materialize(words, "words")
    pairs = near_pairs(words, dense)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    # Of equal counts the smallest word is the least of (-n, word).
    best = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")))
    found = found.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    found = materialize(found, "forms")
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(up: DataFrame) -> DataFrame:
    """word and root: up's pointers (word, root) followed to their ends."""
    up = materialize(up, "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not up.join(further, "root", "left_semi").limit(1).count():
            return up
        new = materialize(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(up)
        up = new
