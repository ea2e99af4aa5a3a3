"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: the gap-weighted subsequence kernel. Strings share each (not necessarily contiguous)
subsequence of ORDER characters with weight DECAY to the power of the length that it spans in both,
normalised to 1 for equal strings. Inserted characters only lengthen a span, so an insult written
`idxiot` or `i-d-i-o-t` stays near `idiot`. A string's likeness to a landmark is their kernel if the
string has the landmark's letters, of which one may lack if there are more than five; else it is 0, and a
word without any likeness to a typical string has none at all. That is how the machines are defined,
in training and in scoring, so what lacks the letters needs no kernel.

Words are read with their start marked; of words longer than WINDOW, windows of that length, in one of
which each typical string lies whole, and of twice the longest typical string, in one of which it lies
whole with a character put in at each place; runs of single characters, also with marks beside them, are
joined to one word as well. Landmarks are strings that tell texts labelled 1 from the others (by how
many of either hold them in one word, or in two different ones; those that cover the texts best are
kept) and the most frequent words of texts labelled 0.

The machine, linear in the Nyström features K(x, landmarks) K(landmarks, landmarks)^(-1/2) with squared
hinge loss, tells words that hold a typical string, also with a character put in, from words that are
only near one. A word that it accepts mentions the string that it is nearest to, plainly if it holds it
whole and in disguise if not. What mentions mean is learned from the sentences of the labelled texts: for
each string and either kind, the share of label 1 among the texts that mention it in one, two, or TOP
or more different sentences, where each text labelled 1 counts a tenth once more with its plain mentions
disguised by a character put in. So one mention of a word that clean texts hold too is little, several
are much, and a disguise counts unless clean texts have words as near. Of a long text as many sentences
count as it has in LONG, and one more. A text's score takes its mentions as independent evidence, and
what isn't mentioned at all as the share of label 1 among texts without mentions.

Fitting uses at most max_rows labelled rows with max_chars characters together, those with the least
hashes of their id, in one task, which sends the model to the driver; scoring covers every row and its whole
text. Labels, language, source and id are no inputs of a score. A null or blank text has the score of
a text without any insult. Rows repeated in the labels count once each; null labels are left out;
without labelled texts every text has the base rate; empty tables give empty ones; the column
`_toxicity` is replaced if there, any others may be there.
"""

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 3
DECAY = 0.5
#: Of a landmark with more than five letters, so many may lack.
SPARE_LETTERS = 1
WINDOW = 12
#: From so many sentences on, more mentions of a string mean no more; in a text of more than LONG sentences they count by share.
TOP = 3
LONG = 12
#: Texts of the general share of label 1 that are added to those seen with a number of mentions; fitted to either half of the training rows, 1 to 4 find about the same in the other.
PRIOR = 2.0
#: Taken share of insults that are disguised; from 0.03 to 0.1 halves of the training rows find the same.
DISGUISED = 0.1
#: Rows that a machine is fitted to at most, and their characters.
MAX_ROWS = 6_000
MAX_CHARS = 60_000_000
LANDMARKS = 64
#: Of the landmarks, typical strings at most; and the words of clean texts that are looked through for the nearest.
TYPICAL = 48
CLEAN_WORDS = 60_000
#: Words of either kind that the machine for words is trained on at most.
MOST_WORDS = 2_500

_OTHER = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W_][\s.\-_*]+){3,}[^\W_][.\-_*]*(?!\S)")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
#: Stands before a word.
START = "^"


def words_of(text: str | None) -> set[str]:
    """Distinct raw words of a text, lower-cased; runs of single characters joined are words too."""
    if not text:
        return set()
    low = text.lower()
    found = set(low.split())
    if sum(len(w) == 1 or (not w.isalnum() and len(bare(w)) == 1) for w in found) >= 2:
        found.update("".join(c for c in m[0] if c.isalnum()) for m in _SPELLED.finditer(low))
    return found


def bare(word: str) -> str:
    """The letters and digits of a word."""
    return word if word.isalnum() else _OTHER.sub("", word)


def all_windows(word: str, wide: int) -> list[str]:
    """The word, or strings of it such that each run of WINDOW - 2 characters lies whole in one of WINDOW, and each of wide - 1 in one of `wide`."""
    if len(word) <= WINDOW:
        return [word]
    found = {}
    for n, step in ((WINDOW, 3), (wide, 2)):
        last = max(0, len(word) - n)
        for i in (*range(0, last, step), last):
            found[word[i : i + n]] = None
    return list(found)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], dtype=np.int64)
    width = max(1, int(size.max(initial=1)))
    flat = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(strings), width), size


def kernel_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """The unnormalised kernel of a[i] and b[i], by the usual recursion, for all pairs at once."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), 16384):
        out[lo : lo + 16384] = _kernel(a[lo : lo + 16384], b[lo : lo + 16384])
    return out


def _kernel(a: list[str], b: list[str]) -> np.ndarray:
    if not a:
        return np.zeros(0)
    s, _ = _codes(a)
    t, _ = _codes(b)
    n, ls, lt = len(a), s.shape[1], t.shape[1]
    same = (s[:, :, None] == t[:, None, :]) & (s[:, :, None] != 0)
    # below[i, j]: weight of common subsequences of the prefixes, with the gaps up to their ends.
    below = np.ones((n, ls + 1, lt + 1))
    for _ in range(ORDER - 1):
        step = np.zeros((n, ls + 1, lt + 1))
        for i in range(1, ls + 1):
            run = np.zeros(n)
            for j in range(1, lt + 1):
                run = DECAY * run + np.where(same[:, i - 1, j - 1], DECAY * DECAY * below[:, i - 1, j - 1], 0.0)
                step[:, i, j] = DECAY * step[:, i - 1, j] + run
        below = step
    return np.sum(same * below[:, :ls, :lt], axis=(1, 2)) * DECAY * DECAY


def _masks(strings: list[str]) -> np.ndarray:
    """A bit for each letter, modulo 64."""
    out = np.zeros(len(strings), dtype=np.uint64)
    short = [i for i, s in enumerate(strings) if 0 < len(s) <= 40]
    for lo in range(0, len(short), 50_000):
        part = short[lo : lo + 50_000]
        codes, _ = _codes([strings[i] for i in part])
        out[part] = np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << (codes & 63).astype(np.uint64), np.uint64(0)), axis=1)
    for i, s in enumerate(strings):
        if len(s) > 40:
            m = 0
            for c in set(s):
                m |= 1 << (ord(c) & 63)
            out[i] = m
    return out


class ToxicityModel:
    def __init__(self, landmarks: list[str], positive: int):
        #: The first `positive` landmarks are typical of texts labelled 1.
        self.landmarks, self.positive = landmarks, positive
        self.wide = max([WINDOW, *(2 * len(x) for x in landmarks[:positive])])
        self.own = np.sqrt(np.maximum(kernel_pairs(landmarks, landmarks), 1e-12))
        self.masks = _masks(landmarks)
        self.need = np.bitwise_count(self.masks).astype(np.int64) - np.array([SPARE_LETTERS if len(x.removeprefix(START)) > 5 else 0 for x in landmarks])
        gram = self._pairs(landmarks, *map(np.ravel, np.indices((len(landmarks), len(landmarks)))))
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6
        self.root = vectors[:, keep] / np.sqrt(values[keep])
        #: The machine, in terms of likenesses.
        self.weights, self.bias = np.zeros(len(landmarks)), 0.0
        #: The share of label 1 among texts without mentions, and by the number of mentions of each typical string, plain ones first.
        self.base, self.shares = 0.5, np.zeros((TOP, 2 * positive))

    def _holds(self, strings: list[str], first: int | None = None) -> np.ndarray:
        """Whether each string has the letters of each landmark."""
        return np.bitwise_count(_masks(strings)[:, None] & self.masks[None, :first]) >= self.need[None, :first].astype(np.uint8)

    def _pairs(self, strings: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Normalised kernel of string i[k] and landmark j[k] for each k, else 0."""
        out = np.zeros((len(strings), len(self.landmarks)))
        if len(i):
            used, back = np.unique(i, return_inverse=True)
            norm = np.sqrt(np.maximum(kernel_pairs(x := [strings[k] for k in used], x), 1e-12))
            out[i, j] = kernel_pairs([strings[k] for k in i], [self.landmarks[k] for k in j]) / (norm[back] * self.own[j])
        return out

    def likeness(self, words: list[str]) -> np.ndarray:
        """Of each bare word its likeness to each landmark, that of its nearest window; 0 to all if it is near no typical string."""
        out = np.zeros((len(words), len(self.landmarks)))
        marked = [START + w for w in words]
        few = [k for k, w in enumerate(words) if len(w) >= ORDER]
        # A window has no letters that its word lacks, so only words that pass are cut.
        few = [few[k] for k in np.flatnonzero(self._holds([marked[k] for k in few], self.positive).any(axis=1))] if few else few
        parts = [(k, w) for k in few for w in all_windows(marked[k], self.wide)]
        for first, last in ((0, self.positive), (self.positive, len(self.landmarks))):
            if not parts:
                break
            strings, at = [w for _, w in parts], np.array([k for k, _ in parts])
            i, j = np.nonzero(self._holds(strings)[:, first:last])
            found = self._pairs(strings, i, j + first)
            np.maximum.at(out, at, found)
            # The other landmarks are asked only of words near a typical string.
            parts = [p for p in parts if out[p[0], : self.positive].any()]
        return out

    def mentions(self, words: list[str]) -> np.ndarray:
        """The typical string that each bare word mentions, plus `positive` if in disguise, or -1."""
        out = np.full(len(words), -1)
        if not self.positive:
            return out
        found = self.likeness(words)
        typical = found[:, : self.positive]
        for k in np.flatnonzero(typical.any(axis=1) & (found @ self.weights + self.bias > 0)):
            plain = [j for j in range(self.positive) if self.landmarks[j] in START + words[k]]
            out[k] = max(plain, key=lambda j, k=k: typical[k, j]) if plain else self.positive + int(typical[k].argmax())
        return out

    def value(self, counts: np.ndarray) -> np.ndarray:
        """Log odds of label 1 of texts with so many mentions of each typical string."""
        at = np.minimum(counts, TOP)
        share = np.where(at > 0, self.shares[np.maximum(at, 1) - 1, np.arange(2 * self.positive)], 0.0)
        rest = np.log(1 - self.base) + np.log(1 - share).sum(axis=1)
        return np.log(-np.expm1(rest)) - rest

    def decide(self, words: list[str]) -> np.ndarray:
        """The value of a text of each word alone."""
        counts = np.zeros((len(words), 2 * self.positive), dtype=np.int64)
        found = self.mentions(words)
        counts[found >= 0, found[found >= 0]] = 1
        return self.value(counts)

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(value, -500, 500)))


class Scorer:
    """Values of texts; what each word mentions is computed once and kept while there is room."""

    def __init__(self, model: ToxicityModel, room: int = 400_000):
        #: What a word mentions, or -1.
        self.model, self.room, self.known = model, room, {}

    def counts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str | None]]:
        """(in how many sentences each typical string is mentioned, the word that says most) of each text."""
        at = 0
        while at < len(texts):
            sets, size = [], 0
            while at + len(sets) < len(texts) and (not sets or size < 60_000):
                sets.append(words_of(texts[at + len(sets)]))
                size += len(sets[-1])
            fresh = list({w for s in sets for w in s if w not in self.known})
            if len(self.known) + len(fresh) > self.room:
                self.known = {}
                fresh = list({w for s in sets for w in s})
            self.known.update(zip(fresh, self.model.mentions([bare(w) for w in fresh]).tolist(), strict=True))
            for s, text in zip(sets, texts[at : at + len(sets)], strict=True):
                said = {w for w in s if self.known[w] >= 0}
                yield self._sentences(text, said), max(said, key=lambda w: (self.model.shares[0, self.known[w]], w), default=None)
            at += len(sets)

    def _sentences(self, text: str, said: set[str]) -> np.ndarray:
        out = np.zeros(2 * self.model.positive, dtype=np.int64)
        if not said:
            return out
        left, sentences = set(said), dict.fromkeys(_ENDS.split(text.lower()))
        for sentence in sentences:
            held = said.intersection(sentence.split())
            if held:
                left -= held
                out[list({self.known[w] for w in held})] += 1
        for w in left:  # joined runs
            out[self.known[w]] += 1
        return np.minimum(out, 1 + LONG * out // max(LONG, len(sentences)))

    def values(self, texts: list[str | None]) -> np.ndarray:
        return np.array([v for v, _ in self.worst(texts)])

    def worst(self, texts: list[str | None]) -> list[tuple[float, str | None]]:
        """(value, the word that says most for it) of each text."""
        found = list(self.counts(texts))
        values = self.model.value(np.array([c for c, _ in found]).reshape(len(found), -1)) if found else []
        return [(float(v), word) for v, (_, word) in zip(values, found, strict=True)]


def _grams(words: set[str], sizes: range, holding: set[str] | None = None) -> set[str]:
    """Strings of the words; with holding, only of words and strings that hold one of those."""
    out = set()
    for w in words:
        if holding is not None and not any(w[i : i + n] in holding for n in SEEDS for i in range(len(w) - n + 1)):
            continue
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = w[i : i + n]
                if holding is None or any(g[j : j + k] in holding for k in SEEDS for j in range(n - k + 1)):
                    out.add(g)
    return out


#: Lengths of the strings that are counted first, and of those that can be typical.
SEEDS = (4, 5)
SIZES = range(4, 11)


def _marked_words(text: str | None) -> set[str]:
    return {START + b for w in words_of(text) if len(b := bare(w)) >= 4}


def _counts(texts: Iterator[set[str]], among: set[str] | None = None) -> list[Counter]:
    """In how many texts each short string (of those among) occurs in one word or more, and in two different words or more."""
    once: Counter = Counter()
    twice: Counter = Counter()
    for s in texts:
        held: Counter = Counter()
        for w in s:
            grams = {w[i : i + n] for n in SEEDS for i in range(len(w) - n + 1)}
            held.update(grams if among is None else grams & among)
        once.update(held.keys())
        twice.update(g for g, n in held.items() if n > 1)
    return [once, twice]


def _frequent(texts: Iterator[set[str]], most: int) -> list[str]:
    """About the `most` words that most texts hold; words seen once are forgotten whenever there are too many."""
    seen: Counter = Counter()
    for s in texts:
        seen.update(s)
        if len(seen) > 5 * most:
            seen = Counter({w: n for w, n in seen.items() if n > 1})
    return [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]]


def _typical(toxic: list[set[str]], clean: Iterator[set[str]], n_clean: int, most: int) -> list[str]:
    """Strings that cover the toxic texts best, among those that clean texts hardly hold once, or twice."""
    # Near copies of a text say nothing new: of those that share their least-hashed rare word, one is kept.
    often = Counter(w for s in toxic for w in s)
    toxic = list({min((crc32(w.encode("utf-8", "replace")) for w in s if often[w] <= 0.05 * len(toxic)), default=-1 - k): s for k, s in enumerate(toxic)}.values())
    least = max(3, 0.01 * len(toxic))
    seeds, counts = set(), _counts(iter(toxic))
    for held, other in zip(counts, _counts(clean, {g for g, n in counts[0].items() if n >= least}), strict=True):
        seeds |= {g for g, n in held.items() if n >= least and other[g] / max(1, n_clean) <= 0.02 * n / len(toxic)}
    # What is to be covered: each suspicious word of each toxic text.
    spots: dict[str, set[tuple[int, str]]] = {}
    for k, s in enumerate(toxic):
        for w in s:
            for g in _grams({w}, SIZES, seeds):
                spots.setdefault(g, set()).add((k, w))
    spots = {g: t for g, t in spots.items() if len(t) >= least}
    covered: set[tuple[int, str]] = set()
    chosen: list[str] = []
    gain = {g: len(t) for g, t in spots.items()}
    while gain and len(chosen) < most:
        best = max(gain, key=lambda g: (gain[g], len(g), g))
        fresh = len(spots[best] - covered)
        if fresh < gain[best]:
            gain[best] = fresh
            if fresh < least:
                del gain[best]
            continue
        # A longer string that covers nearly as much says more.
        best = max((g for g in gain if best in g and len(spots[g] - covered) >= 0.9 * fresh), key=lambda g: (len(g), g))
        chosen.append(best)
        covered |= spots[best]
        del gain[best]
    return chosen


def _bent(word: str) -> list[str]:
    """The word with one character put in, at each place in turn."""
    return [word[:i] + "xqzjk"[i % 5] + word[i:] for i in range(1, len(word))]


def _train(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighted alike, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_texts(texts: list[str | None], labels: list[int]) -> ToxicityModel:
    label = np.array(labels)
    toxic = [_marked_words(t) for t, y in zip(texts, labels, strict=True) if y == 1]
    n_clean = int((label == 0).sum())
    clean = lambda: (_marked_words(t) for t, y in zip(texts, labels, strict=True) if y == 0)
    typical = _typical(toxic, clean(), n_clean, TYPICAL) if toxic else []
    if not typical:  # nothing to learn from: every text has the base rate
        model = ToxicityModel(["abc"], 0)
        model.base = (len(toxic) + 1) / (len(toxic) + n_clean + 2)
        return model
    frequent = [w.removeprefix(START) for w in _frequent(clean(), CLEAN_WORDS)]
    model = ToxicityModel([*typical, *((START + w)[:WINDOW] for w in frequent[: LANDMARKS - len(typical)])], len(typical))
    near = model.likeness(frequent)[:, : len(typical)].max(axis=1, initial=0.0)
    # Words that hold a typical string, as they are and with a character put in, against words of clean texts that are only near one.
    shown = Counter(w[1:] for s in toxic for w in s if any(g in w for g in typical))
    holding = [w for w, _ in sorted(shown.items(), key=lambda x: (-x[1], x[0]))[:MOST_WORDS]]
    bent = [x for w in [*typical, *holding[:200]] for x in _bent(w.removeprefix(START)) if len(w) < WINDOW]
    other = [frequent[k] for k in np.argsort(-near, kind="stable")[:MOST_WORDS] if near[k] > 0 and not any(g in START + frequent[k] for g in typical)]
    x = model.likeness(holding + bent + other)
    w, model.bias = _train(x @ model.root, np.array([1.0] * (len(holding) + len(bent)) + [-1.0] * len(other)))
    model.weights = model.root @ w
    counts = np.array([c for c, _ in Scorer(model).counts(texts)])
    general = label.mean()
    # Of each string's disguises, those that are taken for it.
    taken = [np.mean(np.isin(model.mentions(_bent(g.removeprefix(START))), (j, len(typical) + j))) for j, g in enumerate(typical)]
    for n in range(1, TOP + 1):
        held = counts >= n if n == TOP else counts == n
        yes = (held & (label == 1)[:, None]).sum(axis=0)
        more = np.concatenate([np.zeros(len(typical)), DISGUISED * np.array(taken) * yes[: len(typical)]])
        model.shares[n - 1] = (yes + more + PRIOR * general) / (held.sum(axis=0) + more + PRIOR)
    # More mentions never mean less.
    model.shares = np.minimum(np.maximum.accumulate(model.shares, axis=0), 1 - 1e-9)
    silent = ~counts.any(axis=1)
    model.base = ((silent & (label == 1)).sum() + PRIOR * general) / (silent.sum() + PRIOR)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """A machine fitted to the texts of docs that labels (key, label 0 or 1) marks.

    At most max_rows labels are drawn, from narrow rows; only they, so a bounded table, are broadcast
    to find their texts, of which as many reach the driver as have max_chars characters together.
    """
    order = F.md5(F.col(key).cast("string"))
    drawn = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label).distinct()
    drawn = drawn.orderBy(order, label).limit(max_rows)
    chosen = docs.select(key, text).join(F.broadcast(drawn), key).orderBy(order, text, label).limit(max_rows)
    # max_rows rows at most: one task adds up their lengths.
    so_far = F.sum(F.coalesce(F.length(text), F.lit(0))).over(Window.orderBy(order, text, label).rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("_chars", so_far).where(F.col("_chars") <= max_chars).select(text, label)

    def learn(batches):
        texts, given = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            given += b.column(1).to_pylist()
        yield pa.record_batch([pa.array([pickle.dumps(fit_texts(texts, given))], pa.binary())], names=["model"])

    # The sample is bounded and in one task already, so it is fitted there: the driver gets the model alone.
    found = chosen.select(text, F.col(label).cast("int")).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit_texts([], [])


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """df with `_toxicity` (replaced if there): score, the worst word and the sentence that holds it first."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, word string, sentence string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            given = [t if isinstance(t, str) else None for t in texts]
            found = scorer.worst(given)
            p = shared.value.probability(np.array([v for v, _ in found])) if found else []
            words, sentences = [], []
            for t, (v, w) in zip(given, found, strict=True):
                bad = v > 0 and w
                words.append(w if bad else None)
                sentences.append(_sentence(t, w) if bad else None)
            yield pd.DataFrame({"score": np.asarray(p, dtype=float), "word": words, "sentence": sentences})

    return df.withColumn("_toxicity", judge(F.col(text)))


def _sentence(text: str, word: str) -> str:
    for m in _SENTENCE.finditer(text):
        if word in m[0].lower():
            return m[0].strip()
    return ""
