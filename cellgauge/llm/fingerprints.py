"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Each five-word shingle is hashed once. The top 8 bits choose one of 256 bins, each bin keeps its
least hash, and of that the 8 low-order bits. An empty bin takes the value of the first bin that
isn't empty in its own probe order, a full cycle drawn from a hash of the bin alone, so two
documents borrow alike. 256 bytes are stored as hexadecimal digits. Likeness is the share of equal
bytes, corrected for those that agree by chance: (p - 1/256) / (1 - 1/256), not below 0.

Words are runs of anything but ASCII white space, lower-cased. A text of one to four words is one
shingle. A null, empty or blank text has the empty string as its fingerprint: likeness 1 to
another such, else 0. Everything is a DataFrame expression, so whole texts stay in the JVM.

An empty table gives an empty one; repeated rows and rows without an id are documents like others;
the column that is added replaces one of its name, and any others may be there. Ids are integers.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import Ranges
from .common import free

BINS = 256
#: Bins probed one after the other before the rest are ranked at once; both give the same bin.
PROBES = 8
#: Text bytes that one task sorts to find each row's successor; more where there would be too many buckets to send.
BUCKET_BYTES = 4 << 20
INTERVALS = 512
#: Buckets whose bounds are sent to the rows at most, 40 bytes each.
SENT_BUCKETS = 500_000
#: The bits of a hash below those that choose its bin.
BELOW = (1 << 56) - 1


def _seeds() -> list[int]:
    """For each bin: start, odd step and the step's inverse modulo BINS, 8 bits each."""
    draw = random.Random(7)
    out = []
    for _ in range(BINS):
        start, step = draw.randrange(BINS), draw.randrange(1, BINS, 2)
        out.append(start | step << 8 | pow(step, -1, BINS) << 16)
    return out


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(h: Column, k: int) -> Column:
    many = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    # array() of a hash of all words: a short text's only shingle.
    return F.when(F.size(h) >= k, many).when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<bigint>"))


def with_signature(df: DataFrame, text: str, out: str, k: int = 5) -> DataFrame:
    """df and, as array<tinyint> `out`, the densified low-order bytes; null if the text has no words."""
    h, s, d, b = (free(df, c) for c in ("_h", "_s", "_d", "_b"))
    df = df.withColumn(h, word_hashes(F.col(text)))
    # A greatest value for each bin joins the shingles, so every bin has a first value in the sorted hashes; alone it says that the bin is empty.
    ends = F.array(*[F.lit((i << 56 | BELOW) - (i >> 7 << 64)) for i in range(BINS)])
    df = df.withColumn(s, F.sort_array(F.concat(shingle_hashes(F.col(h), k), ends)))
    top = lambda x: F.shiftrightunsigned(x, 56)
    least = F.filter(F.col(s), lambda x, i: (i == 0) | (top(x) != top(F.get(F.col(s), i - 1))))
    # In the order of signed numbers, so bin i stands at place(i).
    place = lambda i: (i + BINS // 2).bitwiseAND(BINS - 1)
    df = df.withColumn(d, F.transform(least, lambda x: F.when(x.bitwiseAND(BELOW) != BELOW, x.bitwiseAND(255).cast("int"))))
    low = lambda i: F.get(F.col(d), place(i))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    df = df.withColumn(b, F.when(F.exists(F.col(d), lambda v: v.isNull()), F.filter(bins, lambda i: low(i).isNotNull())))
    seeds = F.array(*[F.lit(x) for x in _seeds()])

    def borrowed(seed: Column) -> Column:
        start, step, inverse = seed.bitwiseAND(255), F.shiftright(seed, 8).bitwiseAND(255), F.shiftright(seed, 16)
        near = [low((start + step * t).bitwiseAND(BINS - 1)) for t in range(PROBES)]
        rank = F.transform(F.col(b), lambda x: ((x - start + BINS) * inverse).bitwiseAND(BINS - 1) * BINS + x)
        return F.coalesce(*near, low(F.array_min(rank).bitwiseAND(BINS - 1)))

    own = lambda i: F.coalesce(low(i), F.get(F.transform(F.array(F.get(seeds, i)), borrowed), F.lit(0)))
    signature = F.when(F.size(h) > 0, F.transform(bins, lambda i: (own(i) - 128).cast("tinyint")))
    return df.withColumn(out, signature).drop(h, s, d, b)


def packed(signature: Column) -> Column:
    """The signature as hexadecimal digits; empty if null."""
    digits = "".join(f"{i:02x}" for i in range(BINS))
    return F.coalesce(F.array_join(F.transform(signature, lambda v: F.substring(F.lit(digits), (v.cast("int") + 128) * 2 + 1, F.lit(2))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two signatures."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    fair = F.greatest(F.lit(0.0), (same - 1.0 / BINS) / (1.0 - 1.0 / BINS))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(fair)


def unpack(fingerprint: Column) -> Column:
    """The signature of a stored fingerprint."""
    one = lambda i: (F.conv(F.substring(fingerprint, i * 2 + 1, F.lit(2)), 16, 10).cast("int") - 128).cast("tinyint")
    return F.when(F.length(fingerprint) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = 5) -> DataFrame:
    """df and `out`, each row's packed fingerprint."""
    sig = free(df, "_sig")
    return with_signature(df, text, sig, k).withColumn(out, packed(F.col(sig))).drop(sig)


def with_next(df: DataFrame, key: str, text: str, carry: list[str], prepare=lambda df: df) -> DataFrame:
    """df and `next_<c>` for each c in carry: the value in the next row, after the last row the first's.

    Rows are ordered by key, nulls first, then by a hash of the text, then by the text. They are dealt
    into buckets of rising keys and hashes; each bucket also gets a copy of the first row of the next
    one, so no task sees more than its bucket, and a key with any share of the rows is split. The
    buckets' first rows, one small row each, are sent to the rows. prepare adds columns to carry to the
    dealt rows, once they have moved.
    """
    tie, own, copy, least, source, to = (free(df, c) for c in ("_tie", "_bucket", "_copy", "_least", "_from", "_to"))
    df = df.withColumn(tie, F.xxhash64(text))
    ranges = Ranges(df, key, BUCKET_BYTES, F.octet_length(text).cast("bigint"), INTERVALS, SENT_BUCKETS)
    df = df.withColumn(own, ranges.bucket(key, tie))
    first = df.groupBy(F.col(own).alias(source)).agg(F.min(F.struct(key, tie)).alias(least))
    w = Window.orderBy(source)
    ring = first.select(source, least, F.coalesce(F.lag(source).over(w), F.last(source).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(to))
    found = df.join(F.broadcast(ring), (F.col(own) == F.col(source)) & F.struct(key, tie).eqNullSafe(F.col(least)))
    # Rows of one key and hash are copies of each other, however many: one is enough.
    rest = [c for c in df.columns if c not in (key, tie, text, own)]
    heads = found.groupBy(to).agg(F.min(F.struct(key, tie, text, *rest)).alias(least)).select(f"{least}.*", F.col(to).alias(own)).select(*df.columns)
    both = df.withColumn(copy, F.lit(False)).unionByName(heads.withColumn(copy, F.lit(True)))
    both = prepare(both.repartition(own))
    w = Window.partitionBy(own).orderBy(copy, F.col(key).asc_nulls_first(), tie, text)
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.where(~F.col(copy)).drop(copy, own, tie)


def edited_neighbours(docs: DataFrame, k: int = 5) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; docs has doc_id and text.

    Edited: the last floor(n_chars / 2) code points give way to the first as many (or all) of the
    next document by doc_id; the last document is followed by the first, and a lone one by itself.
    Rows with a null doc_id come first; rows of one doc_id lie in order of a hash of their texts.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", "text", ["text", "sig"], lambda d: with_signature(d, "text", "sig", k))
    half = F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    docs = with_signature(docs, "edited", "edited_sig", k)
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("sig")).alias("fingerprint"),
        packed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
