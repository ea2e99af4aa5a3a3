import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pyarrow as pa
import pytest

from cellgauge.llm import spelling

WORDS = "word string, n bigint"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=spelling.RATIO):
    form = {}
    out = []
    others = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(others[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(others[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcé", "abcdefghijklm"])
@pytest.mark.parametrize("dense", [0, 4, 50])
def test_variants_equal_brute_force(spark, alphabet, dense):
    draw = random.Random(len(alphabet))
    words = {}
    for _ in range(250):
        w = "".join(draw.choice(alphabet) for _ in range(draw.randint(6, 9)))
        words[w] = draw.choice([5, 5, 6, 25, 30, 125, 700])
        k = draw.randrange(len(w))
        words.setdefault(draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice(alphabet) + w[k:], w[:k] + draw.choice(alphabet) + w[k + 1 :]]), 5)
    words = {w: n for w, n in words.items() if len(w) >= 6}
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS), dense=dense)) == plain(words)


def test_a_group_of_most_words_is_dealt_out_again(spark, monkeypatch):
    # All words share their rarest bigrams, so one group has them all.
    words = {"qxzq" + "".join(random.Random(k).choice("ab") for _ in range(8)): 5 + k % 3 for k in range(200)}
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS))) == plain(words)
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS), dense=1)) == plain(words)


def test_chains_of_forms_reach_their_root(spark):
    words = {"aaaaaa" + "b" * k: 5 ** (9 - k) for k in range(8)}
    got = {w: root for w, _, root, *_ in rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS)))}
    assert set(got.values()) == {"aaaaaa"}


def test_ties_take_the_smallest_word(spark):
    words = {"banana": 5, "bananb": 25, "bananc": 25, "canana": 25}
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), WORDS))) == plain(words)


def test_rests_are_hashes_of_the_words_that_are_left():
    words = ["ab", "aab", "abcabc", "étéà", "x" * 40, "q"]
    word, rest, own = spelling._rests(pa.array(words))
    left = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    assert word.tolist() == [k for k, w in enumerate(words) for _ in w]
    assert rest.tolist() == spelling._rests(pa.array(left))[2].tolist()
    assert len(set(own.tolist())) == len(words)


def plain_counts(docs, change=None):
    seen = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if change:
                h = crc32(f"{'' if d is None else d}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return sorted((w, n) for w, n in seen.items() if len(w) >= 6 and n >= 5)


def test_counts_of_odd_texts(spark, monkeypatch):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcÀÉöxyzABC") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    docs = [(k if k % 7 else None, "".join(draw.choice(vocabulary) + draw.choice([" ", "\n", "1", "×", "–"]) for _ in range(300))) for k in range(40)]
    docs += [(1, None), (2, ""), (3, "  "), (3, "Wörter " * 300_000), (docs[1][0], docs[1][1])]
    given = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, word int")
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    assert sorted(tuple(r) for r in spelling.word_counts(given).collect()) == plain_counts(docs)
    assert sorted(tuple(r) for r in spelling.word_counts(given, change=spelling.misspell).collect()) == plain_counts(docs, True)


def test_no_words(spark):
    none = spelling.word_counts(spark.createDataFrame([], "doc_id bigint, text string"))
    assert none.collect() == [] and rows(spelling.variants(none)) == []
    assert rows(spelling.variants(spark.createDataFrame([("lonely", 9)], WORDS))) == [("lonely", None, "lonely", 9, 0, None)]
    assert all(not near(a, b) for a, b in combinations(["lonely", "lovers"], 2))
