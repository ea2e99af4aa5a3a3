"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.llm import chat, decontamination, fingerprints, licenses, mixing, toxicity, urls, warc, wrappers
from cellgauge.llm.common import WordHasher, shared_dir
from cellgauge.llm.queries import HOSTILE, URL_RULES

from .brute import shingle_set

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly judge my vow to boxing"


# --- chat ---


def chats(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string"))
    return out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))


def test_chat_round_trip(spark):
    texts = [HOSTILE, None, "", "<|", "a\\s\\l<|x|>", "\n<|im_end|>\n", "ü" * 50_000, "<", "|im_start|>", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "p") for i, t in enumerate(texts)]
    rows += [(2, 0, "odd\nrole<|\\", "x", None), (None, None, None, None, None), (3, 1, "assistant", "b", ""), (3, 1, "assistant", "a", ""), (3, 1, "assistant", "a", "")]
    got = {r["conv_id"]: r for r in chats(spark, rows).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1]["loss"] == "".join(t or "" for t in texts[1::2])
    assert [tuple(t) for t in got[2]["back"]] == [("odd\nrole<|\\", "x")]
    assert [tuple(t) for t in got[None]["back"]] == [("", "")]
    assert got[3]["loss"] == "aab"
    assert "<|im_start|>" not in got[1]["formatted"].replace("<|im_start|>user\n", "").replace("<|im_start|>assistant\n", "")
    assert chats(spark, []).count() == 0


def test_chat_layouts(spark):
    want = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": None, "output": "a"},
        {"instruction": "q", "output": "a", "extra": {"x": 1}},
        {"prompt": "q", "response": "a"},
        {"prompt": "q", "completion": "a"},
        {"question": "q", "answer": "a", "source": "z"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{}",), (None,), ("no json",)], "j string")
    got = chat.turns_of_records(df, "j").collect()
    assert [[tuple(t) for t in r["turns"]] for r in got[:7]] == [want] * 7
    assert [r["turns"] for r in got[7:]] == [None] * 3
    assert chat.render(chat.turns_of_records(df, "j").where("turns is not null")).count() == 7


# --- licenses ---


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    long = licenses.TEMPLATES["MIT text"].replace("merge, publish,", "merge, now and then, publish,")
    rows = [(1, PROSE), (2, f"{PROSE} {mit} {PROSE}\n{mit}"), (3, None), (4, ""), (5, (PROSE + " ") * 20_000 + mit.upper()), (6, long), (2, mit), (None, mit)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")
    got = sorted(((r["doc_id"], r["license"], round(r["coverage"], 2)) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(2, "MIT", 1.0)] * 3 + [(5, "MIT", 1.0), (6, "MIT text", 1.0), (None, "MIT", 1.0)], key=str)
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, {}).count() == 0
    assert {r["span"] for r in licenses.scan(df).where("doc_id = 2").collect()} == {"Released under the MIT License"}


def test_alignment_is_common_and_rising():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.randrange(8) for _ in range(draw.randrange(0, 20))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.align(list("abcxyz"), list("abczyx"))[:3] == [(0, 0), (1, 1), (2, 2)]
    assert len(licenses.align(list(range(50)), list(range(0, 50, 2)))) == 25


def plain_align(a, b):
    """Patience alignment by its definition, with the longest rising sequence (of those, the one that ends first) from all of them."""
    pre = 0
    while pre < min(len(a), len(b)) and a[pre] == b[pre]:
        pre += 1
    post = 0
    while post < min(len(a), len(b)) - pre and a[len(a) - 1 - post] == b[len(b) - 1 - post]:
        post += 1
    ends = [(i, i) for i in range(pre)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(post)]
    x, y = a[pre : len(a) - post], b[pre : len(b) - post]
    pairs = [(i, y.index(w)) for i, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    best, rank = [[]], lambda c: (len(c), -c[-1][1] if c else 0)
    for p in pairs:
        best.append(max((c for c in best if not c or c[-1][1] < p[1]), key=rank) + [p])
    anchors = max(best, key=rank)
    out, at = [], (0, 0)
    for i, j in [*anchors, (len(x), len(y))] if anchors else []:
        out += [(at[0] + p, at[1] + q) for p, q in plain_align(x[at[0] : i], y[at[1] : j])]
        at = (i + 1, j + 1)
    return sorted(ends + [(pre + p, pre + q) for p, q in [*out, *anchors]])


def test_alignment_equals_the_definition():
    draw = random.Random(12)
    for _ in range(400):
        a, b = ([draw.randrange(draw.choice([4, 12, 40])) for _ in range(draw.randrange(0, 25))] for _ in range(2))
        assert licenses.align(a, b) == plain_align(a, b)


def test_license_places_equal_a_plain_scan(spark):
    """Every start of every text against every template, the best places first, none overlapping."""
    templates = {"A": "one two three four five six seven eight", "B": "one two three nine ten eleven", "C": "red green blue red yellow"}
    said = {n: t.split() for n, t in templates.items()}
    draw = random.Random(13)
    texts = []
    for _ in range(150):
        w = []
        for _ in range(draw.randrange(0, 6)):
            w += [draw.choice("pqrstuv") for _ in range(draw.randrange(0, 9))]
            t = list(draw.choice(list(said.values())))
            for _ in range(draw.randrange(0, 3)):
                at = draw.randrange(len(t))
                t[at : at + draw.randrange(0, 2)] = [draw.choice(["p", "one", "red", "three"])]
            w += t
        texts.append(w)

    def plain(w):
        places = []
        for name, t in said.items():
            hits = []
            need = math.ceil(0.8 * len(t) - 1e-9)
            for at in range(len(w)):
                if w[at] not in t[: len(t) - need + 1]:
                    continue  # more words than may be missing come before it
                pairs = plain_align(w[at : at + 2 * len(t)], t)
                if len(pairs) >= need:
                    hits.append((len(pairs), at + pairs[0][0], at + pairs[-1][0] + 1, at))
            while hits:  # the best of those that start before the first hit ends
                first = hits[0]
                near = [h for h in hits if h[3] < first[2]]
                best = min(near, key=lambda h: (-h[0], h[2] - h[1], h[1]))
                places.append((-best[0], best[2] - best[1], best[1], name, best[2]))
                hits = [h for h in hits if h[3] >= best[2]]
        out = []
        for n, _, i, name, j in sorted(places):
            if all(j <= a or b <= i for a, b, *_ in out):
                out.append((i, j, name, -n / len(said[name])))
        return sorted(out)

    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got: dict = {}
    for r in licenses.scan(df, templates).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["coverage"], 6), r["span"]))
    for i, w in enumerate(texts):
        want = [(name, round(c, 6), " ".join(w[a:b])) for a, b, name, c in plain(w)]
        assert sorted(got.get(i, [])) == sorted(want)


@pytest.mark.parametrize(
    "text,name",
    [
        ("GNU General Public License, version 2.", "GPL-2.0 short"),
        ("under the GNU Lesser General Public License version 2.1", "LGPL-2.1 short"),
        ("under the GNU Lesser General Public License version 2", None),
        ("This work is licensed under the GNU General Public License, version 3.0.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 3.5.", None),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("see CC BY-SA 4.0", "CC-BY-SA-4.0 short"),
        ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
        ("Released under the Foo License.", None),
        ("a released, see: Released under the MIT License.", "MIT"),
        ("SPDX-License-Identifier: LGPL-3.0", "LGPL-3.0 tag"),
        (licenses.TEMPLATES["BSD-2-Clause text"], "BSD-2-Clause text"),
        (licenses.TEMPLATES["BSD-3-Clause text"], "BSD-3-Clause text"),
        (licenses.TEMPLATES["Apache-2.0 notice"], "Apache-2.0 notice"),
    ],
)
def test_licenses_that_differ_in_a_word(spark, text, name):
    got = licenses.scan(spark.createDataFrame([(1, f"{PROSE} {text} {PROSE}")], "doc_id bigint, text string")).collect()
    assert [r["license"] for r in got] == ([name] if name else [])
    if name == "MIT":
        assert got[0]["span"] == "Released under the MIT License"


def test_each_template_finds_itself(spark):
    rows = [(i, f"{PROSE}. {t} {PROSE}") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in got) == [(i, n, 1.0) for i, n in enumerate(licenses.TEMPLATES)]


# --- decontamination ---


def bm25_pairs(texts, items, threshold, overlap):
    """Each passage of each text scored against each item by the formula, without an index."""
    h = WordHasher(punctuation=True)
    words = lambda t: h.words(np.frombuffer((t or "").encode(), np.uint8))[0].tolist()
    docs = [(i, words(t)) for i, t in items if words(t)]
    n, mean = len(docs), sum(len(w) for _, w in docs) / len(docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    size = max(decontamination.BLOCK_WORDS, max(len(w) for _, w in docs))

    def impact(t, w):
        return math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))

    found = set()
    for d, text in texts:
        w = words(text)
        for lo in range(0, len(w), size):
            here = set(w[lo : lo + 2 * size])
            around = set(decontamination.grams(np.array(w[max(0, lo - size) : lo + 3 * size], np.uint64)).tolist())
            for i, iw in docs:
                score = sum(impact(t, iw) for t in set(iw) & here) / sum(impact(t, iw) for t in set(iw))
                halves = (iw[: len(iw) // 2], iw[len(iw) // 2 :])
                shares = [1.0 if not p else np.mean([g in around for g in decontamination.grams(np.array(p, np.uint64)).tolist()]) for p in halves]
                if score >= threshold and min(shares) >= overlap:
                    found.add((d, i))
    return found


def test_decontamination_equals_plain_scoring(spark):
    draw = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(draw.choice(vocab) for _ in range(n))
    items = [(i, make(draw.randrange(6, 70))) for i in range(40)] + [(90, None), (91, "  "), (5, "again the same")]
    texts = []
    for d in range(120):
        body = make(draw.randrange(0, 300))
        if d % 3 == 0:
            w = draw.choice(items[:40])[1].split()
            if d % 2:
                w[draw.randrange(len(w))] = "changed"
            body = body + " " + " ".join(w) + ". " + make(20)
        texts.append((d, body))
    texts += [(500, None), (501, ""), (502, items[3][1].upper() + "!"), (502, items[3][1]), (503, make(80_000) + " " + items[7][1])]
    docs = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id bigint, text string, score double")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == bm25_pairs(texts, items, 0.6, 0.5)
    assert {(502, 3), (503, 7)} <= got
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


# --- pages ---

PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><header>site</header><nav><ul><li>menu</li></ul></nav><div class='cookie-notice'>we use</div>{}<aside>side</aside><form><input value=1>go</form><div id=comments><p>first!</p></div><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (PAGE.format("<article><h1>Head</h1><p>One&nbsp;&lt;b&gt;\n two<p>Three <b>bold</b><br>four</article>"), "Head\nOne <b> two\nThree bold four"),
        (PAGE.format("<main><div class='post'><header><h1>T</h1></header><p>x</p><div class='share-buttons'>tweet</div></div></main>"), "T\nx"),
        (PAGE.format("<div class='content'><p>a</p><ul><li>b<li>c</ul><table><tr><td>d<td>e</table></div>"), "a\nb\nc\nd e"),
        ("<p>a<!-- <p>b</p> -->c</p><div", "ac"),
        ("<article><p>x</p><section class='comments'><p>bad</p></section></article>", "x"),
        ("<" * 1000, "<" * 1000),
    ],
)
def test_extract_page(html, text):
    assert wrappers.extract_page(html) == text


def test_wrappers_find_unmarked_template(spark):
    body = "<html><body><div class=x1><p>Our shop since 1999</p></div><div class=x2><p>{}</p><p>{}</p></div><div class=x3>call us</div></body></html>"
    rows = [(i, f"http://a.com/{i}", body.format(f"story {i} begins", f"and ends {i * i}"), "k") for i in range(30)]
    rows += [(100, "http://b.com/", body.format("lone", "page"), "k"), (101, None, None, None), (102, "no scheme", "", "k"), (3, "http://a.com/3", rows[3][2], "k")]
    rows += [(200 + i, "http://c.com/x", body.format("copy", "of one"), "k") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, wrapper string").repartition(4)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert got[7] == "story 7 begins\nand ends 49"
    assert got[100] == "Our shop since 1999\nlone\npage\ncall us"
    assert got[200] == "Our shop since 1999\ncopy\nof one\ncall us"
    assert got[101] == got[102] == ""
    assert wrappers.extract(df).count() == len(rows)
    assert wrappers.extract(df.limit(0)).count() == 0


def test_simple_tree_matching_is_the_best_pairing():
    def size(a, b):
        if not a or not b:
            return 0
        best = max(size(a[1:], b), size(a, b[1:]))
        if a[0][0] == b[0][0]:
            best = max(best, 1 + size(a[0][2], b[0][2]) + size(a[1:], b[1:]))
        return best

    draw = random.Random(2)

    def tree(depth):
        return [(draw.choice("pqd"), 0, tree(depth - 1) if depth else []) for _ in range(draw.randrange(0, 4))]

    for _ in range(100):
        a, b = tree(2), tree(2)
        assert wrappers.match(a, b, wrappers._label, wrappers._kids)[0] == size(a, b)


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a.com/x y", big, 9), (2, "http://a.com/x y", big, 9), (9, "http://b.org/", big, 9), (4, None, None, 9), (5, "http://b.org/", "", 9), (6, "http://b.org/", "short", 9), (7, "http://b.org/", "short", 9), (None, "http://c.net/", big, 9), (9, "http://b.org/", big, 9), (8, "x\r\nWARC-Type: y", "z" * 2_000_000, 9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.capture(df).collect()), key=str)
    want = [(1, "revisit", 9, 1200), (2, "revisit", 9, 1200), (9, "response", None, 1200), (9, "response", None, 1200), (4, "response", None, 0), (5, "response", None, 0), (6, "response", None, 5), (7, "response", None, 5), (None, "revisit", 9, 1200), (8, "response", None, 2_000_000)]
    assert got == sorted(want, key=str)
    assert warc.capture(df.limit(0)).count() == 0


def test_warc_lookup_and_large_directory(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/p"), F.col("id") % 20).alias("url"), F.lit("<p>x</p>").alias("html"))
    locations = warc.write_archives(pages)
    directory = warc.build_index(locations)
    wanted = spark.createDataFrame([("http://h3.org/p3",), ("http://h0.org/p0#frag",), ("http://none/",), (None,)], "url string")
    want = sorted(r["page_id"] for r in pages.where("url in ('http://h3.org/p3', 'http://h0.org/p0')").collect())
    one = sorted(r["page_id"] for r in warc.read_records(warc.lookup(directory, wanted)).collect())
    monkeypatch.setattr(warc, "DIRECTORY_CHUNK", 4)
    many = sorted(r["page_id"] for r in warc.lookup(directory, wanted).collect())
    assert one == many == want


# --- urls ---


def test_urls(spark):
    list_ = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/25?x#y", "http://example.com/en/", "http://a.example.com/fr", "http://b.net/es/1", "http://b.net/ES/1", "http://com", "http://com/", "x://y://z/en/", "http://exämple.com/\n/en", "https://u@h.com:8080/en/?q", "http://.com/", "http://net/fr/" + "a" * 100_000]
    df = spark.createDataFrame([(u, "h") for u in list_ * 2], "url string, host string")
    by_trie = urls.filter_urls(df, list(URL_RULES)).select("url", "_judged.*").collect()
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    by_join = urls.filter_urls(df, rules, max_rules=2).select("url", "_judged.*").collect()
    assert sorted(map(str, by_trie)) == sorted(map(str, by_join))
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in by_trie}
    assert got[None] == got["nothing"] == ("", "", None, "allow")
    assert got["HTTP://WWW.Example.COM/en/25?x#y"] == ("www.example.com", "/en/25", "www.example.com/en/", "allow")
    assert got["http://example.com/en/"][2:] == ("example.com/en/", "block")
    assert got["http://b.net/es/1"][2:] == ("net/es/", "block")
    assert got["http://com"][2] is None and got["http://com/"][2] == "com/"
    assert urls.filter_urls(df.limit(0), list(URL_RULES)).count() == 0


def test_trie_takes_part_segments_and_the_longest():
    t = urls.UrlTrie([urls.Rule("block", "a.b", "/en"), urls.Rule("allow", "a.b", "/en/x"), urls.Rule("block", "b", "/")])
    assert t.find("c.a.b", "/english") == ("block", "a.b/en")
    assert t.find("a.b", "/en/xy/z") == ("allow", "a.b/en/x")
    assert t.find("b", "/q") == ("block", "b/")
    assert t.find("xb", "/q") is None


# --- mixing ---


def test_mixing(spark):
    rows = [(i, ("a", "b", None)[0 if i < 700 else 1 if i < 950 else 2], "t", 5, 6) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copy int, _source int")
    out = mixing.mix(df).collect()
    n = {s: sum(r["source"] == s for r in out) for s in ("a", "b", None)}
    assert all(abs(v - 333) < 70 for v in n.values())
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out)
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, out))
    assert mixing.mix(df.limit(0)).count() == 0
    twice = mixing.mix(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id bigint, source string"), total=300).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in twice) > 200


def test_poisson_has_its_mean_and_variance(spark):
    for rate in (0.3, 5.0, 70.0):
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
        r = mixing.with_counts(df, total=int(4000 * rate)).agg(F.avg("n_copies"), F.var_samp("n_copies")).first()
        assert abs(r[0] - rate) < 5 * math.sqrt(rate / 4000) and abs(r[1] / rate - 1) < 0.15


# --- fingerprints ---


def test_fingerprints(spark):
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        w = words(draw.randrange(20, 600))
        rows.append((2 * i, " ".join(w)))
        for _ in range(draw.randrange(0, len(w) // 8)):
            w[draw.randrange(len(w))] = "x"
        rows.append((2 * i + 1, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (505, "ü" * 70_000), (None, "a b c d e f"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, sig string").repartition(5)
    got = fingerprints.edited_neighbours(df).collect()
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    err, hashes = [], {}
    want = []
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        a, b, c = (shingle_set(x, 5) for x in (t, edited, nxt))
        hashes.setdefault((d, want[-1][2]), (len(a & b) / len(a | b) if a | b else 1.0, len(a & c) / len(a | c) if a | c else 1.0))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        j, k = hashes[r["doc_id"], r["edited_sha256"]]
        err += [abs(r["near_edited"] - j), abs(r["near_next"] - k)]
    assert max(err) < 0.25 and sum(err) / len(err) < 0.03
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[500]["fingerprint"] == by_id[502]["fingerprint"] == "" and by_id[500]["near_next"] == 1.0
    assert by_id[503]["fingerprint"] == by_id[504]["fingerprint"] and by_id[503]["near_next"] == 1.0
    assert len(by_id[0]["fingerprint"]) == 2 * fingerprints.BINS
    assert fingerprints.edited_neighbours(df.limit(0)).count() == 0
    one = fingerprints.edited_neighbours(spark.createDataFrame([(7, PROSE)], "doc_id bigint, text string")).first()
    assert one["near_next"] == 1.0


def test_buckets_change_no_neighbour(spark, monkeypatch):
    rows = [(i * i % 9973, f"text {i} " * (i % 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = lambda r: str(r)
    whole = sorted(fingerprints.edited_neighbours(df).collect(), key=key)
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 300)
    assert sorted(fingerprints.edited_neighbours(df).collect(), key=key) == whole
    monkeypatch.setattr(fingerprints, "INTERVALS", 4)
    assert sorted(fingerprints.edited_neighbours(df).collect(), key=key) == whole


def test_unpacked_fingerprint_compares_alike(spark):
    df = spark.createDataFrame([(PROSE, PROSE + " and more besides that")], "a string, b string")
    df = fingerprints.with_signature(fingerprints.with_signature(df, "a", "x"), "b", "y")
    packed = df.select(fingerprints.packed(F.col("x")).alias("p"), fingerprints.packed(F.col("y")).alias("q"), fingerprints.likeness(F.col("x"), F.col("y")).alias("want"))
    r = packed.select("want", fingerprints.likeness(fingerprints.unpack(F.col("p")), fingerprints.unpack(F.col("q"))).alias("got")).first()
    assert r["got"] == r["want"] > 0.4


# --- toxicity ---


def sample(n, seed):
    draw = random.Random(seed)
    vocab = ["".join(draw.choice(["an", "th", "er", "on", "re", "in", "ou", "st"]) for _ in range(draw.randrange(1, 5))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        w = [draw.choice(vocab) for _ in range(draw.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                w.insert(draw.randrange(len(w)), draw.choice(["wretchling", "blockhead", "numbskull"]))
        texts.append(" ".join(w))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_learns_and_tolerates_insertions(spark):
    texts, labels = sample(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "x")], "doc_id bigint, text string")
    given = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, 1), (7, None), (None, 1)], "doc_id bigint, label int")
    model = toxicity.fit(docs, given)
    test, truth = sample(300, 2)
    p = model.probability(toxicity.Scorer(model).values(test))
    assert np.mean((p >= 0.7) == np.array(truth)) > 0.97
    odd = [None, "", " \n", "such a blockxhead there", "b l o c k h e a d", "num.bskull!", "an onre " * 50_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(odd)], "doc_id bigint, text string, score string")
    got = [r["_toxicity"] for r in toxicity.score(df, model).orderBy("doc_id").collect()]
    assert [g["score"] >= 0.5 for g in got] == [False, False, False, True, True, True, False]
    assert got[4]["word"] and got[3]["sentence"]
    assert toxicity.score(df.limit(0), model).count() == 0
    empty = toxicity.fit(docs.limit(0), given)
    assert 0 <= toxicity.score(df, empty).first()["_toxicity"]["score"] <= 1


def test_kernel_equals_enumeration():
    from itertools import combinations

    def plain(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.ORDER):
            for b in combinations(range(len(t)), toxicity.ORDER):
                if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    draw = random.Random(5)
    pairs = [("".join(draw.choice("abcü") for _ in range(draw.randrange(3, 9))), "".join(draw.choice("abcü") for _ in range(draw.randrange(3, 9)))) for _ in range(60)]
    got = toxicity.kernel_pairs([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [plain(a, b) for a, b in pairs])


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark).startswith("file:")


@pytest.mark.parametrize("mark", ["sideBar", "side-bar left", "ad_slot", "ads2", "CookieConsent", "site-header", "footer-links", "newsletter", "commentList", "breadcrumbs", "promo-box"])
def test_marked_boxes_go(mark):
    page = f"<body><div class='{mark}'><p>box</p></div><div class='text'><p>story</p></div></body>"
    assert wrappers.extract_page(page) == "story"
    assert wrappers.extract_page(page.replace("<div class='text'>", "<article>").replace("</p></div></body>", f"</p><div id='{mark}'>box</div></article></body>")) == "story" or mark == "site-header"


@pytest.mark.parametrize("mark", ["article-header", "entry-content", "main-text", "addition", "navigator7x", "headline"])
def test_content_stays(mark):
    assert wrappers.extract_page(f"<body><div class='{mark}'><h1>a</h1><p>story</p></div></body>") == "a\nstory"


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y"
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(6000)) + "</article>"
    assert wrappers.extract_page(deep) == "x\ny"
    rows = [(i, "http://h/", (deep, long)[i % 2]) for i in range(6)]
    got = [r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).orderBy("page_id").collect()]
    assert got == ["x\ny", "\n".join(f"line {i}" for i in range(6000))] * 3


def test_spelled_words_take_no_time_on_hostile_texts():
    for t in ("_" * 400 + "#", "a b " + "_ " * 3000 + "#", "a_" * 3000 + "#", ("a " * 3000) + "bb", "x" * 300_000):
        toxicity.words_of(t)
    assert "idiot" in toxicity.words_of("an i d.i-o t x") or "idiotx" in toxicity.words_of("an i d.i-o t x")


def test_long_pages_keep_their_wrapper(spark):
    """Blocks beyond any fixed number: what stands behind 1,500 varying ones on each page is still found constant."""
    page = "<body><div class=a>{}</div><div class=b>All rights kept by us</div></body>"
    body = [[f"line {i} {j}" for j in range(1500)] for i in range(20)]
    rows = [(i, f"http://long/{i}", page.format("".join(f"<h4>{t}</h4><p>{t} too</p>" for t in b))) for i, b in enumerate(body)]
    out = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: "\n".join(f"{t}\n{t} too" for t in b) for i, b in enumerate(body)}


def test_what_tree_matching_pairs_has_one_path():
    """So the paths miss no text that simple tree matching would find constant."""
    draw = random.Random(6)

    def tree(depth):
        return [(draw.choice("pqd"), 0, tree(depth - 1) if depth else []) for _ in range(draw.randrange(0, 5))]

    def paths(nodes, above=""):
        return {above + n[0] for n in nodes}.union(*(paths(n[2], above + n[0]) for n in nodes))

    def paired(a, b, above=""):
        for i, j in wrappers.match(a, b, wrappers._label, wrappers._kids)[1]:
            yield above + a[i][0]
            yield from paired(a[i][2], b[j][2], above + a[i][0])

    for _ in range(50):
        a, b = tree(2), tree(2)
        assert set(paired(a, b)) <= paths(a) & paths(b)


def test_copies_neither_make_nor_break_a_wrapper(spark):
    page = "<body><div class=a><p>{}</p></div><div class=b>call us</div></body>"
    rows = [(i, "http://h/", page.format(f"story {i}")) for i in range(12)] + [(100 + i, "http://h/", page.format("again")) for i in range(60)]
    rows += [(200 + i, "http://few/", page.format(f"story {i % 5}")) for i in range(50)]
    out = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert out[3] == "story 3" and out[130] == "again"
    assert out[203] == "story 3\ncall us"


def test_depth_moves_no_end_tag():
    """Elements nested deeper than any fixed number close themselves, not their ancestors, and stay what they are."""
    for n in (10, 200, 3000):
        runs = "".join(f"<div>in {i}" for i in range(n)) + "".join(f"</div>out {i}" for i in range(n))
        page = f"<html><body><div><article>{runs}<p>after</p></article></div><p>beside</p></body></html>"
        assert wrappers.extract_page(page).split("\n") == [f"in {i}" for i in range(n)] + [f"out {i}" for i in range(n)] + ["after"]
        deep = "<div>" * n + "<nav>menu</nav><div class=ad>buy</div><footer>foot</footer><p>text</p>" + "</div>" * n
        assert wrappers.extract_page(f"<body>{deep}<p>y</p></body>") == "text\ny"
    marked = "<div class=nav>" * 5000 + "<article>x</article>"
    assert wrappers.extract_page(marked) == "x"
    assert wrappers.extract_page("<p>" + "<b>" * 100_000 + "</i>" * 100_000 + "x") == "x"


def test_chunks_of_items_change_no_leak(spark, monkeypatch):
    """Frequencies, mean length and passage width are those of all items, however they are dealt into chunks."""
    draw = random.Random(14)
    make = lambda n, v: [f"w{draw.randrange(v)}" for _ in range(n)]
    items = [(i, " ".join(make(draw.randrange(6, 40), 30 if i < 10 else 200))) for i in range(30)] + [(30, " ".join(make(150, 200))), (31, None), (32, " ")]
    texts = []
    for d in range(150):
        w = items[d % 30][1].split()
        for _ in range(len(w) // 3):
            w[draw.randrange(len(w))] = draw.choice(["new", "w1", "w150"])
        texts.append((d, " ".join(make(draw.randrange(0, 150), 200) + w)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontamination.find_leaks(docs, bench, overlap=0.2).collect())
    assert {r[:2] for r in whole} == bm25_pairs(texts, items, 0.6, 0.2)
    monkeypatch.setattr(decontamination, "CHUNK_ITEMS", 7)
    assert sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontamination.find_leaks(docs, bench, overlap=0.2).collect()) == whole
    for size, words in ((2, 500), (50, 4_000_000)):
        monkeypatch.setattr(decontamination, "CHUNK_ITEMS", size)
        monkeypatch.setattr(decontamination, "GROUP_WORDS", words)
        monkeypatch.setattr(decontamination, "RUN_PASSAGES", 3)
        assert sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontamination.find_leaks(docs, bench, overlap=0.2).collect()) == whole
    monkeypatch.setattr(decontamination, "CHUNK_CHARS", 400)
    assert sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontamination.find_leaks(docs, bench, overlap=0.2).collect()) == whole


def test_long_spellings_lie_whole_in_a_window():
    texts, labels = sample(600, 1)
    model = toxicity.fit_texts(texts, labels)
    spelled = "x".join("wretchling")
    for before in range(12):
        found = toxicity.all_windows("o" * before + spelled + "oo", model.wide)
        assert any(spelled in w for w in found)
        assert any("wretchling" in w for w in toxicity.all_windows("o" * before + "wretchling" + "oo", model.wide))
    # Wherever it starts in a long word, a typical string is judged alike.
    value = model.decide(["onre" * 5 + "thou"[:k] + "blockhead" + "thou"[k:] + "ster" * 5 for k in range(5)])
    assert (model.probability(value) >= 0.5).all()


def test_spelled_with_marks():
    for t in ("an i. d. i. o. t. here", "i- d- i- o- t", "(x) i.. d.. i.. o.. t."):
        assert "idiot" in toxicity.words_of(t)
    for t in ("a. " * 5000 + "#", "a_ " * 5000 + "#_", "a. b" + ". " * 5000):
        toxicity.words_of(t)


@pytest.mark.parametrize("kind", ["null", "hot", "clumped"])
def test_next_document_with_null_hot_and_clumped_ids(spark, monkeypatch, kind):
    """A third of the rows without an id, or with one id, or ids close together: the ring of texts is whole, no bucket is large."""
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 200)
    ids = {"null": [None] * 100 + list(range(200)), "hot": [7] * 100 + list(range(200)), "clumped": list(range(280)) + [10**15 + i for i in range(20)]}[kind]
    rows = [(d, f"text {i} " + "w " * (i % 5)) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = fingerprints.with_next(df.withColumn("_tie", F.lit(1)), "doc_id", "text", ["text", "doc_id"]).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None) == sorted(r for r in rows if r[0] is not None)
    to = {(r["doc_id"], r["text"]): (r["next_doc_id"], r["next_text"]) for r in out}
    assert len(to) == len(rows) == len(set(to.values()))
    at, seen = (rows[0][0], rows[0][1]), []
    for _ in rows:
        seen.append(at)
        at = to[at]
    assert len(set(seen)) == len(rows) and at == seen[0]
    key = [(d is not None, d or 0) for d, _ in seen]
    turn = min(range(len(key)), key=lambda i: (key[i], key[i - 1] <= key[i]))
    assert key[turn:] + key[:turn] == sorted(key)
    with pytest.raises(TypeError):
        fingerprints.with_next(df.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text", ["text"])


def test_warc_with_many_recurring_payloads_and_one_hot_url(spark, monkeypatch):
    """The joined form gives the same records as the sent one; one url's captures lie in many blocks."""
    from cellgauge.llm import common

    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "TASK_BLOCKS", 2)
    rows = [(i, "http://hot.org/x" if i % 3 else f"http://h{i}.org/", f"page {i % 7} " * (200 if i % 7 < 4 else 1), "d", i) for i in range(120)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, offset int").repartition(3)
    sent = sorted((tuple(r) for r in warc.capture(df).drop("payload").collect()), key=str)
    monkeypatch.setattr(warc, "SENT_DIGESTS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    assert sorted((tuple(r) for r in warc.capture(df).drop("payload").collect()), key=str) == sent
    assert len(sent) == 121 and sum(r[2] == "revisit" for r in sent) == sum(i % 7 < 4 for i in range(120)) - 4


def test_walk_scores_what_reaches_the_threshold_and_little_else():
    """Cursors find the items that a sum over all postings finds; a block's items that can't reach it aren't scored."""
    draw = random.Random(21)
    items = [(i, " ".join(f"w{draw.randrange(60)}" for _ in range(draw.randrange(4, 30))), "") for i in range(50)]
    ix = decontamination.ItemIndex(items, 0.5, 0.5)
    for _ in range(60):
        term = np.unique([draw.randrange(len(ix.vocabulary)) for _ in range(draw.randrange(1, 40))])
        block = np.arange(ix.blocks)
        pair, t = np.repeat(block, len(term)), np.tile(term, ix.blocks)
        got = {(int(k), int(i)): s for k, i, s in zip(*ix.walk(block, pair, t), strict=True)}
        want: dict = {}
        for x in term:
            for p in range(ix.first[x], ix.first[x + 1]):
                i = int(ix.item[p])
                want[i // decontamination.ITEM_BLOCK, i] = want.get((i // decontamination.ITEM_BLOCK, i), 0.0) + ix.impact[p]
        assert got == pytest.approx({k: s for k, s in want.items() if s >= 0.5})
    with pytest.raises(ValueError):
        decontamination.ItemIndex(items, decontamination.SLACK, 0.5)


def made_pages(seed, n, hosts):
    """Pages without telling tags or names, and the text that each should give: menus of varying links, constant blocks, varying content."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8)))
    say = lambda k: " ".join(word() for _ in range(k))
    rows, want = [], {}
    for h in range(hosts):
        before, after = [[(draw.choice(["div", "p", "h3"]), say(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 4))] for _ in range(2)]
        deep = draw.randrange(0, 3)
        for i in range(n):
            menu = "".join(f"<li><a href=/{k}>{say(2)}</a></li>" for k in range(draw.randrange(2, 6)))
            body = [(draw.choice(["p", "p", "h2"]), say(draw.randrange(3, 20))) for _ in range(draw.randrange(2, 9))]
            some = [b for b in before if draw.random() < 0.96]
            tag = lambda x: "".join(f"<{t}>{v}</{t}>" for t, v in x)
            html = f"<html><body><div><ul>{menu}</ul></div><div>{tag(some)}</div>{'<div>' * deep}<section>{tag(body)}</section>{'</div>' * deep}<div>{tag(after)}</div></body></html>"
            page = h * n + i
            rows.append((page, f"http://host{h}.org/{i}", html))
            want[page] = "\n".join(v for _, v in body)
    return rows, want


@pytest.mark.parametrize("sent", [True, False])
def test_wrappers_leave_what_varies(spark, monkeypatch, sent):
    """Of pages that mark nothing, menus and constant blocks go, whether wrappers are sent or merged; without wrappers they stay."""
    rows, want = made_pages(3, 24, 5)
    rows += [(1000 + i, "http://few.org/", rows[i][2]) for i in range(5)]
    if not sent:
        monkeypatch.setattr(wrappers, "SENT_BYTES", 0)
        monkeypatch.setattr(wrappers, "PARTS", 3)
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in wrappers.extract(df).collect()}
    assert {k: got[k] for k in want} == want
    assert all(wrappers.extract_page(rows[k][2]) != v for k, v in want.items())
    assert all(got[1000 + i].endswith(wrappers.extract_page(rows[i][2])) for i in range(5))
    found = {r["name"]: len(r["units"]) for r in wrappers.wrappers(df).collect()}
    assert sorted(found) == [f"host{h}.org" for h in range(5)] and min(found.values()) >= 2


def test_alignment_of_trees_pairs_as_simple_tree_matching_does():
    draw = random.Random(31)

    def html(depth):
        return "".join(f"<{t}>{'x' if draw.random() < 0.5 else ''}{html(depth - 1) if depth else ''}</{t}>" for t in (draw.choice(["div", "section", "ul"]) for _ in range(draw.randrange(0, 4))))

    def pairs(x, y):
        return sum(1 + pairs(x.kids[i], y.kids[j]) for i, j in wrappers.match(x.kids, y.kids, wrappers._label, wrappers._kids)[1])

    for _ in range(150):
        a, b = (wrappers.fold(wrappers.parse(html(3)))[0] for _ in range(2))
        wrappers.number(a), wrappers.number(b)
        again = wrappers.rebuilt(wrappers.skeleton(wrappers.number(b)))
        got = wrappers.align(a, again)
        assert len(got) == 1 + pairs(a, b) == 1 + wrappers.match(a.kids, b.kids, wrappers._label, wrappers._kids)[0]
        label = {x.index: x.label for x in wrappers.number(b)}
        assert all(label[got[x.index]] == x.label for x in wrappers.number(a) if x.index in got)
        order = [got[x.index] for x in wrappers.number(a) if x.index in got]
        assert order == sorted(set(order))


@pytest.mark.parametrize("n", [650, 5000])
def test_templates_of_any_size(spark, n):
    rows = [(i, f"http://long/{i}", "<body><div>" + "".join(f"<p>row {k} of ours</p>" for k in range(n)) + f"</div><section><p>story {i} begins</p></section></body>") for i in range(12)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"story {i} begins" for i in range(12)}


def test_articles_with_other_adverts_stay(spark):
    """One article taken many times, each time beside other adverts, isn't template; what stands beside many articles is."""
    page = "<body><div><p>{}</p><p>{}</p></div><section class='ad box'>{}</section><div>all rights are ours</div></body>"
    rows = [(i, "http://h.org/", page.format(f"the first story of number {i}", f"and how the story {i} ends", f"buy {i}")) for i in range(12)]
    rows += [(100 + i, "http://h.org/", page.format("the same article, taken again", "which ends like this here", f"buy now {i}")) for i in range(200)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert got[105] == "the same article, taken again\nwhich ends like this here"
    assert got[3] == "the first story of number 3\nand how the story 3 ends"


@pytest.mark.parametrize("name", ["social-history", "related-work", "legal", "share", "share-price", "header-less", "formal notice"])
def test_names_that_can_mean_content(name):
    assert wrappers.extract_page(f"<body><nav>menu</nav><div class='{name}'><p>The whole story.</p></div></body>") == "The whole story."


@pytest.mark.parametrize(
    "html,text",
    [
        ('<p title="abc>hello</p>', "hello"),
        ('<p title="abc>hello</p><p class="x">world</p>', "hello\nworld"),
        ("<p title='it's'>hello</p>", "hello"),
        ('<a href="x"title="a > b">link</a>', "link"),
        ('<p title="a > b">hello</p>', "hello"),
        ('<p "">x</p>' * 2000, "\n".join("x" * 2000)),
        ("<p '" * 3000, ""),
        ('<p a="' * 20000, ""),
    ],
)
def test_stray_quotes(html, text):
    assert wrappers.extract_page(html) == text


def test_scores_equal_a_plain_version():
    """Words, windows, likenesses, mentions, sentences and shares by their definitions, one text at a time."""
    from itertools import combinations

    texts, labels = sample(300, 4)
    texts = [t.replace(" th ", ". Th ") for t in texts]
    model = toxicity.fit_texts(texts, labels)

    def weigh(s):
        out: dict = {}
        for c in combinations(range(len(s)), toxicity.ORDER):
            u = "".join(s[i] for i in c)
            out[u] = out.get(u, 0.0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    marks = [weigh(x) for x in model.landmarks]

    def likeness(string, j):
        x = model.landmarks[j]
        lack = len(set(x) - set(string))
        if lack > (1 if len(x.removeprefix("^")) > 5 else 0):
            return 0.0
        a, b = weigh(string), marks[j]
        return sum(v * b.get(u, 0.0) for u, v in a.items()) / max(1e-6, math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))

    def mention(word):
        word = "".join(c for c in word if c.isalnum())
        if len(word) < toxicity.ORDER:
            return -1
        marked = "^" + word
        found = [max(likeness(w, j) for w in toxicity.all_windows(marked, model.wide)) for j in range(len(model.landmarks))]
        near = found[: model.positive]
        if not any(near) or sum(f * w for f, w in zip(found, model.weights, strict=True)) + model.bias <= 0:
            return -1
        plain = [j for j in range(model.positive) if model.landmarks[j] in marked]
        return max(plain, key=lambda j: near[j]) if plain else model.positive + near.index(max(near))

    def score(text):
        sentences = set(filter(None, toxicity._ENDS.split((text or "").lower())))
        held: dict = {}
        for s in sentences:
            for m in {mention(w) for w in s.split()} - {-1}:
                held[m] = held.get(m, 0) + 1
        no = 1 - model.base
        for m, n in held.items():
            n = min(n, 1 + toxicity.LONG * n // max(toxicity.LONG, len(sentences)))
            no *= 1 - model.shares[min(n, toxicity.TOP) - 1, m]
        return 1 - no

    given = [texts[k] for k in range(0, 60, 3)] + [None, "", "blockhead", "a numbskxull. blockhead!\nblockhead", "wretchling " * 3]
    got = model.probability(toxicity.Scorer(model).values(given))
    assert np.allclose(got, [score(t) for t in given])
    assert model.positive >= 3 and (got > 0.7).any() and (got < 0.3).any()


def test_one_mention_of_a_word_that_clean_texts_hold_is_little(spark):
    draw = random.Random(41)
    vocab = ["".join(draw.choice(["an", "th", "er", "on", "re", "in"]) for _ in range(draw.randrange(1, 4))) for _ in range(300)]
    say = lambda n: [draw.choice(vocab) for _ in range(n)]
    texts, labels = [], []
    for i in range(500):
        said = [say(8) for _ in range(8)]
        n = 3 if i % 6 == 0 else 1 if i % 9 == 1 else 0
        for k in draw.sample(range(8), n):
            said[k].insert(draw.randrange(8), "zubrik" + draw.choice(["an", "on", "er", "in"]))
        texts.append(". ".join(" ".join(s) for s in said))
        labels.append(int(i % 6 == 0))
    model = toxicity.fit_texts(texts[:400], labels[:400])
    p = model.probability(toxicity.Scorer(model).values(texts[400:]))
    assert ((p >= 0.7) == (np.array(labels[400:]) == 1)).mean() > 0.97


def test_fit_takes_whole_texts_up_to_its_bounds(spark):
    texts, labels = sample(120, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, label int")
    few = toxicity.fit(docs, given, max_chars=300)
    assert few.positive == 0
    assert toxicity.fit(docs, given).positive >= 3


def test_names_and_paths_of_repeated_elements_are_judged_once(monkeypatch):
    judged, hashed, name_marks, plain_hash = [], [], wrappers.name_marks, wrappers._hash
    monkeypatch.setattr(wrappers, "name_marks", lambda names: judged.append(names) or name_marks(names))
    monkeypatch.setattr(wrappers, "_hash", lambda data: hashed.append(data) or plain_hash(data))
    page = "<main>" + "".join(f'<div class="only-here footer"><a href="/{k}">{k}</a></div><section ID=once-{k % 2} data-k={k % 2}>text {k}</section>' for k in range(50)) + "</main>"
    root = wrappers.parse(page)
    assert len(judged) == 3
    divs = [k for k in root.kids[0].kids if k.tag == "div"]
    assert len(divs) == 50 and {(k.marks, k.label) for k in divs} == {(name_marks("only-here footer"), "div only-here footer")}
    assert {k.label for k in root.kids[0].kids if k.tag == "section"} == {"section once-"}
    top, _ = wrappers.fold(root)
    wrappers.number(top)
    assert len(hashed) <= 110  # a text each, and few shapes
    assert wrappers.extract_page(page).split("\n") == [f"text {k}" for k in range(50)]
