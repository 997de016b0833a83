"""Operators 2, 3, 7 and 9 against brute force, and on odd input."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import common as C
from chunkloom.llm import html_wrapper as W
from chunkloom.llm import license_scan as L
from chunkloom.llm import queries as corpus
from chunkloom.llm import url_rules as U
from chunkloom.llm import warc as A
from compare import same

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    same(corpus.QUERIES[name](spark, sf_dir), duck, corpus.ORACLES[name])


# --- 2


def stm(a, b) -> int:
    """Simple tree matching, read literally."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + stm(x, y))
    return m[-1][-1] + 1


def random_page(r: random.Random, depth: int = 0) -> str:
    if depth > 3 or r.random() < 0.3:
        return r.choice(["a", "b", "c"])
    return "".join(f"<{t}>{random_page(r, depth + 1)}</{t}>" for t in (r.choice(["div", "b", "i"]) for _ in range(r.randint(1, 3))))


def test_alignment_is_the_largest_mapping():
    r = random.Random(3)
    for _ in range(150):
        a, b = W.parse(random_page(r)), W.parse(random_page(r))
        pairs = W.align(a, b)
        assert W.score(a, b) == stm(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs)
        order = sorted((x.number, y.number) for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(order, order[1:]))


def site(n: int, host: str = "x.example", first: int = 0) -> list[tuple]:
    page = "<html><head><title>T{i}</title></head><body><nav><ul><li>Home<li>About</ul></nav><h1>Story {i}</h1><p>Body number {i}{more}.</p><footer>All rights kept</footer></body></html>"
    return [(first + i, f"http://{host}/{i}", page.format(i=i, more=" more" * (i % 3))) for i in range(n)]


PAGE = "page_id bigint, url string, html string"


@pytest.mark.parametrize("small", [W.SMALL, 0])
def test_template_goes_and_content_stays(spark, small):
    rows = site(12) + site(9, "y.example", 100) + [(200, "http://alone.example/", "<p>Only page</p>"), (201, None, "<p>No host</p>"), (202, "/x", ""), (203, "http://x.example/9", None), (None, "http://x.example/z", "<nav>Home"), (0, *site(1)[0][1:])]
    pages = spark.createDataFrame(rows, PAGE).withColumn("ref", F.lit(True)).withColumn("host", F.lit("h")).withColumn("salt", F.lit(1))
    got = W.extracted(pages, small).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x for x in got}
    for i in range(1, 12):
        assert by[i].content == f"Story {i}\nBody number {i}{' more' * (i % 3)}." and by[i].title == f"T{i}" and by[i].n_template == 3
    assert by[105].host == "y.example" and by[105].content.startswith("Story 5")
    assert by[200].content == "Only page" and by[201].content == "No host" and by[201].host is None
    assert by[202].content == by[203].content == ""
    assert W.extracted(pages.limit(0), small).count() == 0


def test_template_is_decided_by_slot_and_value_at_every_size(spark):
    """Three menus in one slot; one headline on two pages of many, as of an update, and copies of a page."""
    page = "<body><nav>{}</nav><h1>{}</h1><p>Body {}.</p></body>"
    for n in (9, 400):
        rows = [(i, f"http://x.example/{i}", page.format(f"Menu {i % 3}", f"Story {i}", i)) for i in range(n)]
        rows += [(n + k, f"http://x.example/copy{k}", page.format("Menu 0", "Copied", "of one page")) for k in range(n)]
        if n == 400:
            rows += [(2 * n + k, f"http://x.example/e{k}", page.format("Menu 1", "Update", f"late {k}")) for k in range(2)]
        got = W.extracted(spark.createDataFrame(rows, PAGE)).collect()
        assert len(got) == len(rows) and all(x.n_template == 1 and x.n_content == 2 and "Menu" not in x.content for x in got)
    copies = [(k, f"http://c.example/{k}", page.format("Menu", "One", "page")) for k in range(5)]
    assert {x.n_template for x in W.extracted(spark.createDataFrame(copies, PAGE)).collect()} == {0}


@pytest.mark.parametrize("small", [W.SMALL, 0])
def test_template_of_nodes_that_the_longest_page_lacks(spark, small):
    """The longest page has a short menu; other pages have a longer one, or another layout altogether."""
    rows = [(0, "http://x.example/0", f"<body><nav><ul><li>Home</ul></nav><p>{'long ' * 300}</p></body>")]
    rows += [(i, f"http://x.example/{i}", f"<body><nav><ul><li>Home<li>About<li>Press</ul></nav><p>Body {i}</p></body>") for i in range(1, 8)]
    rows += [(i, f"http://x.example/{i}", f"<body><table><tr><td>Menu<td>Shop</table><section><b>Item {i}</b></section><aside>Legal</aside></body>") for i in range(8, 14)]
    got = {x.page_id: x for x in W.extracted(spark.createDataFrame(rows, PAGE), small).collect()}
    assert got[0].content == ("long " * 300).strip()
    assert all((got[i].content, got[i].n_template) == (f"Body {i}", 3) for i in range(1, 8))
    assert all((got[i].content, got[i].n_template) == (f"Item {i}", 3) for i in range(8, 14))


def test_broadcast_and_shuffle_agree(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    rows = lambda *more: sorted(map(tuple, W.extracted(pages, *more).collect()))
    assert rows(W.SMALL) == rows(0) == rows(0, 5000)


def test_deep_and_wide_pages(spark):
    """5,000 levels of two kinds on two pages of a host, stray end tags, and alignments that outlive the scores."""
    deep = lambda x: "<div>" * 5000 + f"<p>{x}</p>" + "<b>" * 3000 + "</i>" * 20_000
    rows = [(1, "http://d.example/1", deep("one") + "<h1>x</h1>"), (2, "http://d.example/2", deep("two")), (3, "http://d.example/3", "<div>" * 4000 + "<i>three"), (4, "http://d.example/4", "<p>a" * 3000)]
    got = {x.page_id: x.content for x in W.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[1] == "one\nx" and got[2] == "two" and got[3] == "three" and got[4] == "\n".join("a" * 3000)
    r = random.Random(8)
    pages = [W.parse(random_page(r)) for _ in range(40)]
    before = [[(x.number, y.number) for x, y in W.align(a, b)] for a in pages for b in pages]
    W._scores.clear()
    for _ in range(500):
        W.parse(random_page(r))
    assert before == [[(x.number, y.number) for x, y in W.align(a, b)] for a in pages for b in pages]


def test_whole_query_equals_brute_force(spark, sf_dir):
    """Slots by simple tree matching as it is written, values counted page by page."""
    rows = C.table(spark, sf_dir, "pages").collect()
    host = {x.page_id: (m[1].lower() if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", x.url or "")) else None) for x in rows}

    def mapping(a, b) -> dict[int, int]:
        """Numbers of b's matched nodes -> a's, by the matrices of the plain recursion, from the end."""
        table: dict = {}

        def matrix(x, y):
            if (x.number, y.number) not in table:
                m = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
                for i, c in enumerate(x.children, 1):
                    for j, d in enumerate(y.children, 1):
                        m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + (matrix(c, d)[-1][-1] + 1 if c.label == d.label else 0))
                table[x.number, y.number] = m
            return table[x.number, y.number]

        return sum(matrix(a, b)[-1][-1:], 1)

    pages = {x.page_id: W.parse(x.html) for x in rows}
    n_words = lambda t: [(n, head, path) for n, head, path in W.texts(t)]
    got = {x.page_id: x for x in W.op2_wrapper_induction(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    checked = 0
    for h in {v for v in host.values() if v}:
        of = [x for x in rows if host[x.page_id] == h and x.html]
        if len(of) < 2:
            continue
        longest = max(of, key=lambda x: len(x.html.encode()))
        if sum(len(x.html.encode()) == len(longest.html.encode()) for x in of) > 1:
            continue  # a tie: by hash
        ref, seen, marks = pages[longest.page_id], {}, {x.page_id: tuple(n.text for n, _, _ in n_words(pages[x.page_id])) for x in of}
        slot = {}
        for x in of:
            pairs = W.align(ref, pages[x.page_id])
            assert len(pairs) == mapping(ref, pages[x.page_id])  # as large as the largest
            slot[x.page_id] = {q.number: p.number for p, q in pairs if p.label == "#text"}
            for n, head, path in n_words(pages[x.page_id]):
                if not head:
                    for s in {path, slot[x.page_id].get(n.number, path)}:
                        seen.setdefault((s, n.text), set()).add(marks[x.page_id])
        total = len(set(marks.values()))
        for x in of:
            want = [n.text for n, head, path in n_words(pages[x.page_id]) if not head and len(seen[slot[x.page_id].get(n.number, path), n.text]) < max(2, 0.01 * total)]
            assert got[x.page_id].content == "\n".join(want)
            checked += 1
    assert checked > 0.5 * len(rows)


# --- 3


def words(s: str) -> list[str]:
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", s.lower())


BODIES = [(name, list(zip(words(t), words(t)[1:]))) for name, t in L.TEMPLATES]


def brute_licences(text: str | None) -> dict[str, float]:
    best: dict[str, float] = {}
    pairs = lambda s: list(zip(words(s), words(s)[1:]))
    parts = [set(pairs(s)) for s in {*(text or "").split("\n"), *re.split(r"\n[ \t\r]*\n", text or ""), text or ""}]
    mine = pairs(text or "")
    for name, body in BODIES:
        b = set(body)
        least = L.LEAST / (2 - L.LEAST) * len(b)
        segments = list(parts)
        if len(b & set(mine)) >= least - 1e-9:
            segments += [set(mine[i : i + len(body)]) for i in range(len(mine)) if mine[i] in b]
        for a in segments:
            if a and (dice := 2 * len(a & b) / (len(a) + len(b))) >= L.LEAST:
                best[name] = max(best.get(name, 0), dice)
    return best


def test_licences_equal_brute_force():
    r = random.Random(9)
    texts = ["", None, "MIT", "x " * 200_000]
    for name, body in L.TEMPLATES:
        for drop in (0, 0.03, 0.1, 0.2, 0.3) if len(body) < 5000 else (0.1,):
            w = [x for x in body.split() if r.random() >= drop]
            lines = "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
            texts += [f"Intro text here.\n\n{lines}\n \nfoo()", " ".join(w).upper(), "# " + " ".join(w) + "\nmore text", "Our tool is small. " + " ".join(w) + " Enjoy it and " + " ".join(w[:3])]
    got: dict[int, dict[str, float]] = {}
    for row, name, dice in L.licences(pa.array(texts)):
        got.setdefault(row, {})[name] = dice
    for i, t in enumerate(texts):
        assert got.get(i, {}) == pytest.approx(brute_licences(t)), (t or "")[:200]


def test_licences_of_several_paragraphs_and_in_prose():
    mit = next(t for n, t in L.TEMPLATES if n == "MIT" and len(t) > 500)
    i, j = mit.index("The above"), mit.index("THE SOFTWARE IS")
    three = f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit[:i]}\n\n{mit[i:j]}\n\n{mit[j:]}"
    code = "\n\n".join(f"def f{k}(x):\n    return x + {k}" for k in range(400))
    full = next(t for n, t in L.TEMPLATES if n == "GPL-3.0" and len(t) > 5000)
    texts = [three + "\n\n" + code, code + "\n\n" + three, "Our tool is small. Released under the MIT License. Enjoy it.", code + full + code, code, "It is released under the terms that a later license may name."]
    got = {(row, name) for row, name, _ in L.licences(pa.array(texts))}
    assert {(0, "MIT"), (1, "MIT"), (2, "MIT"), (3, "GPL-3.0")} <= got and not {x for x, _ in got} & {4, 5}


def test_licences_on_odd_rows(spark, odd):
    assert L.licensed(odd).count() == 0 and L.licensed(odd.limit(0)).count() == 0
    docs = spark.createDataFrame([(None, L.TEMPLATES[0][1]), (1, L.TEMPLATES[0][1]), (1, L.TEMPLATES[0][1])], "doc_id bigint, text string")
    assert sorted((x.doc_id or 0, x.license, x.dice) for x in L.licensed(docs).collect()) == [(0, "MIT", 1.0), (1, "MIT", 1.0), (1, "MIT", 1.0)]


# --- 7


def test_rules_equal_brute_force(spark):
    r = random.Random(4)
    urls = [f"http://{r.choice(['a.example', 'b.example', 'ads.test'])}/{r.choice(['news', 'buy', 'free'])}/{r.randint(1, 999)}{r.choice(['', '?ref=x', '?id=1'])}" for _ in range(160)]
    urls += [None, "", "not a url", urls[0], urls[0]]
    bad = {i: int("ads.test" in (u or "") and "free" in (u or "") or r.random() < 0.08) for i, u in enumerate(urls) if i % 3}
    pages = spark.createDataFrame([(i if i != 7 else None, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, t string")
    marks = spark.createDataFrame(list(bad.items()) + [(None, 1), (8, 0)], "page_id bigint, bad int").withColumn("bad", F.col("bad") == 1)
    support, confidence = 0.03, 0.5
    rules = U.mined(pages, marks, support, confidence)
    tokens = {i: x.t for i, x in enumerate(pages.select(U.tokens(F.col("url")).alias("t")).collect())}
    known = [(tokens[i], b) for i, b in bad.items() if urls[i] is not None and i != 7]
    n, w = Counter(), Counter()
    for t, b in known:
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                n[c] += 1
                w[c] += b
    every = {c: (w[c] / n[c], w[c] / len(known)) for c in n if w[c] >= max(U.FEWEST, -(-support * len(known) // 1)) and w[c] / n[c] >= confidence}
    want = {c: v for c, v in every.items() if not any(set(d) < set(c) and every[d][0] >= v[0] for d in every)}
    got = {tuple(x["items"]): (x.confidence, x.support) for x in rules.collect()}
    assert want and set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in got)
    best = {}
    for i, t in tokens.items():
        hits = sorted((-v[0], -v[1], " & ".join(c)) for c, v in want.items() if set(c) <= set(t))
        best[i] = hits[0][2] if hits else None
    out = U.decided(pages, rules).collect()
    assert sorted((str(x.url), str(x.rule)) for x in out) == sorted((str(urls[i]), str(best[i])) for i in tokens)
    assert all(x.blocked == (x.rule is not None) for x in out)


def test_long_rules_equal_brute_force(spark):
    """Only four path segments together tell bad URLs: each three of them occur in good ones too."""
    r = random.Random(5)
    urls = [f"http://h.example/{'/'.join(s for s in 'abcd' if r.random() < 0.8)}" for _ in range(120)] + ["http://h.example/a/b/c/d/e?k=1"] * 3
    bad = [int("a/b/c/d" in u) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    marks = spark.createDataFrame(list(enumerate(bad)), "page_id bigint, bad int").withColumn("bad", F.col("bad") == 1)
    n, w = Counter(), Counter()
    for t, b in zip((x.t for x in pages.select(U.tokens(F.col("url")).alias("t")).collect()), bad):
        for c in (c for k in range(1, len(t) + 1) for c in combinations(t, k)):
            n[c] += 1
            w[c] += b
    every = {c: (w[c] / n[c], w[c] / len(urls)) for c in n if w[c] >= max(U.FEWEST, 0.02 * len(urls)) and w[c] / n[c] >= 0.5}
    want = {c: v for c, v in every.items() if not any(set(d) < set(c) and every[d][0] >= v[0] for d in every)}
    rules = U.mined(pages, marks, 0.02, 0.5).collect()
    got = {tuple(x["items"]): (x.confidence, x.support) for x in rules}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in got)
    assert ("path:a", "path:b", "path:c", "path:d") in want


def test_long_urls_do_not_make_all_token_sets(spark):
    """20 labelled URLs with 40 query keys each, on bad and good pages alike: the keys are one token to the mining."""
    import time

    r = random.Random(3)
    query = lambda: "&".join(f"k{i}={r.randint(0, 10**6)}" for i in range(40))
    urls = [f"http://{'ads' if i % 2 else 'news'}.example/{'x' if i % 5 else 'y'}?{query()}" for i in range(20)] + [f"http://news.example/{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    marks = spark.createDataFrame([(i, int(i < 20 and (i % 2 == 1) ^ (i % 7 == 0))) for i in range(40)], "page_id bigint, bad int").withColumn("bad", F.col("bad") == 1)
    began = time.time()
    got = {tuple(x["items"]): (x.confidence, x.support) for x in U.mined(pages, marks).collect()}
    assert time.time() - began < 60
    kept = [[t for t in x.t if not re.match(r"pair:|key:k[1-9]", t)] for x in pages.select(U.tokens(F.col("url")).alias("t")).collect()]
    bad = {x.page_id: x.bad for x in marks.collect()}
    n, w = Counter(), Counter()
    for i, t in enumerate(kept):
        for c in (c for k in range(1, len(t) + 1) for c in combinations(t, k)):
            n[c] += 1
            w[c] += bad[i]
    every = {c: (w[c] / n[c], w[c] / 40) for c in n if w[c] >= U.FEWEST and w[c] / n[c] >= U.CONFIDENCE}
    want = {c: v for c, v in every.items() if not any(set(d) < set(c) and every[d][0] >= v[0] for d in every)}
    plain = {c: v for c, v in got.items() if not any(re.match(r"key:k[1-9]", t) for t in c)}
    assert want and set(plain) == set(want) and all(plain[c] == pytest.approx(want[c]) for c in plain)
    with_key = [c for c in want if "key:k0" in c]
    assert with_key and len(got) == len(want) + 39 * len(with_key)


def test_rules_without_labels_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x"), (None, None)], "page_id bigint, url string")
    none = spark.createDataFrame([], "page_id bigint, bad boolean")
    good = spark.createDataFrame([(1, False)], "page_id bigint, bad boolean")
    for marks in (none, good):
        assert [x.blocked for x in U.decided(pages, U.mined(pages, marks)).collect()] == [False, False]
    assert U.decided(pages.limit(0), U.mined(pages.limit(0), good)).count() == 0


# --- 9

RECORD = "record_id string, record_type string, url string, date string, digest string, refers_to string, content_type string, http_head string, payload binary, o string, k string, part int"
JPEG = bytes(range(256)) * 40
HEAD = "HTTP/1.1 404 Not Found\r\nServer: x\r\nSet-Cookie: a=b"


def test_archives_round_trip(spark, tmp_path):
    http = "application/http; msgtype=response"
    rows = [
        ("urn:1", "response", "http://a/", "2020-01-02T00:00:00Z", "sha1:A", None, http, HEAD, "<p>ä</p>".encode()), ("urn:2", "response", "http://b/", "2020-01-01T00:00:00Z", "sha1:A", None, http, "HTTP/1.1 200 OK", "<p>ä</p>".encode()),
        ("urn:3", "revisit", "http://a/", "2020-02-01T00:00:00Z", "sha1:A", "urn:gone", http, HEAD, None), ("urn:4", "revisit", "http://q/", "2020-02-01T00:00:00Z", "sha1:none", "urn:elsewhere", None, None, None),
        ("urn:5", "response", None, None, None, None, None, None, None), ("urn:6", "response", "http://e/", "2020-01-01T00:00:00Z", None, None, http, HEAD, b""), ("urn:6", "response", "http://e/", "2020-01-01T00:00:00Z", None, None, http, HEAD, b""),
        ("urn:7", "response", "http://l/", "2020-01-01T00:00:00Z", "sha1:L", None, http, HEAD, b"x" * 3_000_000), (None, "response", "http://n/", "2020", "sha1:N", None, http, HEAD, b"lost"),
        ("urn:8", "request", "http://a/", "2020-01-02T00:00:00Z", None, "urn:1", "application/http; msgtype=request", None, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), ("urn:9", "metadata", None, "2020-01-02T00:00:00Z", "sha1:A", "urn:2", "application/warc-fields", None, b"via: x\r\n"),
        ("urn:10", "warcinfo", None, "2020-01-02T00:00:00Z", None, None, "application/warc-fields", None, b"software: y\r\n\r\nz"), ("urn:11", "response", "http://j/", "2020-01-02T00:00:00Z", "sha1:J", None, http, "HTTP/1.1 200 OK\r\nContent-Type: image/jpeg", JPEG),
        ("urn:12", "response", "http://j2/", "2020-01-03T00:00:00Z", "sha1:J", None, http, "HTTP/1.1 200 OK\r\nX: 2", JPEG),
    ]
    records = spark.createDataFrame([(*x, "o", "k", 1) for x in rows], RECORD)
    fresh, index, folder = A.write_archives(records, str(tmp_path / "w"))
    by = {x.old_id: x for x in fresh.collect()}
    said = {x[0]: x for x in rows}
    assert len(by) == fresh.count() == 12 and set(by) == set(said) - {None}
    assert {k for k, v in by.items() if v.record_type != said[k][1]} == {"urn:1", "urn:12"} and by["urn:1"].record_type == by["urn:12"].record_type == "revisit"
    assert by["urn:1"].refers_to == by["urn:3"].refers_to == by["urn:2"].record_id and by["urn:3"].refers_to_date == "2020-01-01T00:00:00Z" and by["urn:12"].refers_to_url == "http://j/"
    assert by["urn:4"].refers_to == "urn:elsewhere" and by["urn:8"].refers_to == by["urn:1"].record_id and by["urn:9"].refers_to == by["urn:2"].record_id and len({x.record_id for x in by.values()}) == 12
    names = sorted({x.file for x in index.collect()})
    back = {x.record_id: x for x in A.read_archives(spark, [f"{folder}/{f}" for f in names]).collect()}
    assert set(back) == {x.record_id for x in by.values()}
    for old, x in by.items():
        y = back[x.record_id]
        assert (y.record_type, y.url, y.date, y.digest, y.refers_to, y.refers_to_url, y.refers_to_date) == (x.record_type, x.url, x.date, x.digest, x.refers_to, x.refers_to_url, x.refers_to_date)
        assert y.http_head == said[old][7] and y.content_type == (said[old][6] or "application/octet-stream")
        assert y.payload == (None if x.record_type == "revisit" else said[old][8] or b"")
    path = folder.removeprefix("file://")
    for x in index.collect():
        import zlib

        with open(f"{path}/{x.file}", "rb") as f:
            f.seek(x.offset)
            assert A.parse_record(zlib.decompress(f.read(x.length), 31))["record_id"] == x.record_id
    assert A.write_archives(records.limit(0), str(tmp_path / "e"))[0].count() == 0
    plain = records.select("record_id", "record_type", "url", "date", "digest", F.lit("text").alias("payload"))
    assert {x.record_type for x in A.write_archives(plain, str(tmp_path / "p"))[0].collect()} == {"response", "revisit", "request", "metadata", "warcinfo"}
    (tmp_path / "cut.warc.gz").write_bytes(open(f"{path}/{names[-1]}", "rb").read()[:-9])
    with pytest.raises(Exception, match="ends within a record"):
        A.read_archives(spark, [f"file://{tmp_path}/cut.warc.gz"]).collect()


def test_captures_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (1, "http://a/", "x"), (2, None, None), (None, "u", ""), (None, None, None)], PAGE)
    fresh, index, _ = A.write_archives(A.captures(pages))
    assert fresh.count() == index.count() == 8
    assert fresh.where("record_type = 'response'").count() == 2
