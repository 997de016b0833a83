"""Operators on small inputs whose results are written out here."""

from __future__ import annotations

import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chunkloom.functions import headings as H
from chunkloom.functions import markdown as M
from chunkloom.functions import text as X
from chunkloom.functions import tokens as K
from chunkloom.operators import analyze, embed, guardrails, legacy, metadata, normalize, overlap, pack, patterns, split, stats, vector
from chunkloom.plans import pipeline
from chunkloom.plans.options import ChunkOptions
from chunkloom.sources import files
from chunkloom.streaming import files as stream

TEXT = """# Guide

First words.

## Setup

- one
- two
  - inner

```py
x = 1
```

| a | b |
|---|---|
| 1 | 2 |

> quoted *text*

### Deep

End with `code` and [a link](http://x.example).
"""


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(column(F.col("t")).alias("v"), "i").orderBy("i").collect()]


# --- parsing


def test_flatten():
    got = [(b["type"], b["text"], b["trail"]) for b in M.flatten(M.parse(TEXT))]
    assert got[:3] == [("heading", "Guide", ["Guide"]), ("paragraph", "First words.", ["Guide"]), ("heading", "Setup", ["Guide", "Setup"])]
    kinds = [g[0] for g in got]
    assert kinds.count("list-item") >= 2 and kinds.count("code") == 1 and kinds.count("table") == 1 and kinds.count("blockquote") == 1
    assert ("code", "x = 1", ["Guide", "Setup"]) in got
    assert ("table", "ab12", ["Guide", "Setup"]) in got
    assert got[-1] == ("paragraph", "End with code and a link.", ["Guide", "Setup", "Deep"])


@pytest.mark.parametrize("text", ["", "   \n\n", None, "```\nopen", "| a |", "- \n-", "> > >", "#", "[x](", "*" * 500, "[" * 300, "\\"])
def test_parse_survives(text):
    assert isinstance(M.flatten(M.parse(text)), list)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #*_`[]()>-|\n!1.\\<&~", max_size=80))
def test_parse_any(text):
    for b in M.flatten(M.parse(text)):
        assert b["type"] in {"heading", "paragraph", "code", "list-item", "table", "blockquote", "html", "thematicBreak"}
        assert len(b["trail"]) == len(b["depths"]) and b["depths"] == sorted(set(b["depths"]))


@pytest.mark.parametrize("text", [">" * 5000 + " x", "word " * 400_000, "*a " * 60_000, "a* " * 60_000, "[" * 30_000 + "]" * 30_000, "foo_ " * 60_000, "some words here\n" * 30_000, "".join("  " * i + "- a\n" for i in range(250)), "|" + " a |" * 60_000 + "\n" + "|-" * 60_000 + "|"])
def test_parse_is_linear_and_deep(text):
    import time

    began = time.time()
    blocks = M.flatten(M.parse(text))
    assert time.time() - began < 20 and "".join(b["text"] for b in blocks).strip()


def test_analyze(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in analyze.analyze(rows).collect()}
    assert (got[1].headings, got[1].h1, got[1].h2, got[1].h3, got[1].code_blocks, got[1].tables, got[1].blockquotes, got[1].links) == (3, 1, 1, 1, 1, 1, 1, 1)
    assert got[2].headings == got[3].headings == 0 and got[3].length == 0


# --- text and tokens


def test_text_functions(spark):
    assert values(spark, X.trim, "  a ﻿", "", None) == ["a", "", None]
    assert values(spark, X.length, "a\U0001f600", "", None) == [3, 0, None]
    assert values(spark, X.sentences, "One. Two!  Three?\nFour", "   ", None) == [["One.", "Two!", "Three?", "Four"], ["   "], None]
    assert values(spark, K.heuristic, "", "a", "x" * 38) == [0, 1, 10]
    assert [K.count_heuristic(s) for s in ("", "a", "x" * 38)] == [0, 1, 10]


# --- split and pack


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 900), max_size=30), st.integers(1, 80), st.integers(81, 300))
def test_pack_rule(lengths, least, most):
    """The fold that counts any tokens, against the rule read literally."""
    o = ChunkOptions(min_tokens=least, max_tokens=most, target_tokens=(least + most) // 2)
    texts = ["x" * n for n in lengths]
    at = pack.starts_with_counter(texts, o, K.count_heuristic)
    if not texts:
        assert at == []
        return
    assert at[0] == 0 and at == sorted(set(at))
    chunks = ["\n\n".join(texts[a:b]) for a, b in zip(at, [*at[1:], len(texts)])]
    assert "\n\n".join(chunks) == "\n\n".join(texts)
    for a, c in zip(at, chunks):
        assert K.count_heuristic(c) <= most or c == texts[a]


def test_pack_in_spark_equals_the_counting_fold(spark):
    import random

    r = random.Random(5)
    o = ChunkOptions(min_tokens=20, max_tokens=60, target_tokens=40)
    cases = [[r.choice([3, 30, 90, 150, 228, 300]) for _ in range(r.randint(0, 14))] for _ in range(200)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, n array<int>")
    got = {x.i: x.at for x in df.select("i", pack.starts(F.col("n"), o).alias("at")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pack.starts_with_counter(["x" * n for n in c], o, K.count_heuristic), c


def test_split_keeps_words(spark):
    texts = [" ".join(f"w{i}." if i % 7 == 0 else f"word{i}" for i in range(400)), "one\n\ntwo", "x" * 3000, "", "  "]
    for t, parts in zip(texts, values(spark, lambda c: split.split_oversized(c, 50), *texts)):
        assert "".join("".join(parts).split()) == "".join(t.split())
        assert all(K.count_heuristic(p) <= 50 or " " not in p for p in parts)


def test_split_by_any_counter_equals_the_expression(spark):
    texts = [" ".join(f"w{i}." if i % 7 == 0 else f"word{i}" for i in range(300)), "one\n\ntwo " * 60, "x" * 300 + " y\n" * 90, "", "  ", "a.  b!\n\n\n c " * 40]
    got = values(spark, lambda c: split.split_oversized(c, 20), *texts)
    assert got == [split.split_counted(t, 20, K.count_heuristic) for t in texts]


def test_overlap(spark):
    rows = spark.createDataFrame([(1, 0, "One. Two.", 2), (1, 1, "Three.", 1), (1, 2, "x" * 400, 105), (2, 0, "Alone.", 1)], "doc_id int, chunk_no int, content string, tokens int")
    o = ChunkOptions(min_tokens=1, max_tokens=106, overlap_sentences=1)
    got = {(r.doc_id, r.chunk_no): r.content for r in overlap.add_overlap(rows, o).collect()}
    assert got == {(1, 0): "One. Two.", (1, 1): "Two. Three.", (1, 2): "x" * 400, (2, 0): "Alone."}


def test_normalize(spark):
    assert values(spark, normalize.normalize, "  a   b  \n\n\n\n  c\n```\n  x   y\n```", "", None) == ["a b\n\n c\n```\n  x   y\n```".replace(" c", "c"), "", ""]


# --- metadata


def test_slugs():
    known = H.Slugs()
    assert [known.slug(*x) for x in [("A", "a"), ("A!", "a"), ("A-1", "a-1"), ("A?", "a"), ("A", "a")]] == ["a", "a-1", "a-1-1", "a-2", "a"]


def test_metadata_and_embedding(spark):
    rows = spark.createDataFrame(
        [(1, 0, "# Top\n\nWords here.", 5, ["heading", "paragraph"], ["Top"], [1], "Doc"), (1, 1, "More.", 1, ["paragraph"], ["Top", "Sub"], [1, 2], "Doc"), (2, 0, None, None, None, None, None, None)],
        "doc_id int, chunk_no int, content string, tokens int, types array<string>, trail array<string>, depths array<int>, title string",
    )
    got = {(r.doc_id, r.chunk_no): r for r in embed.add_embed_text(metadata.attach_metadata(rows), ChunkOptions(min_tokens=3)).collect()}
    a, b, c = got[1, 0], got[1, 1], got[2, 0]
    assert (a.next_id, b.prev_id, a.prev_id, b.next_id) == (b.id, a.id, None, None)
    assert (a.char_start, a.char_end, b.char_start, b.total_chars) == (0, 18, 18, 23)
    assert b.header_breadcrumb == "Top > Sub" and b.section_slug == "sub" and b.embed_text == "Doc > Top > Sub\n\nMore."
    assert a.embed_text == "# Top\n\nWords here."
    assert c.file_title == "untitled" and c.node_types == ["paragraph"] and c.tokens == 0


def test_char_offsets(spark):
    full = "a" * 50 + "b" * 150
    df = spark.createDataFrame([(full, "b" * 150), (full, "b" * 120 + "z"), (full, "q")], "f string, p string")
    s, e, c = metadata.char_offsets(F.col("f"), F.col("p"))
    assert [tuple(r) for r in df.select(s, e, c).collect()] == [(50, 200, 1.0), (50, 171, 0.8), (-1, -1, 0.0)]


# --- guardrails and statistics


def test_violations(spark):
    o = ChunkOptions(min_tokens=2, max_tokens=5)
    cases = [("", 0, "EMPTY_CONTENT"), ("ok text", 1, "TOO_SHORT"), ("long", 9, "TOO_LONG"), ("---", 3, "FORMATTING_ONLY"), ("## Head\n \n", 3, "EMPTY_HEADER"), ("```\nx\n```", 3, "ORPHANED_CODE")]
    rows = spark.createDataFrame([(1, c, t) for c, t, _ in cases], "doc_id int, original_text string, tokens int")
    found = {r.original_text: [v.code for v in r.violations] for r in guardrails.validate(rows, o).collect()}
    for text, _, code in cases:
        assert code in found[text], (text, found[text])


def test_strict_fails(spark):
    rows = spark.createDataFrame([(1, "", 0)], "doc_id int, original_text string, tokens int")
    with pytest.raises(PySparkException, match="EMPTY_CONTENT"):
        guardrails.validate(rows, ChunkOptions(strict=True)).collect()


def test_stats(spark):
    rows = spark.createDataFrame([(1, "x" * 100, 90), (1, "y" * 100, 101), (1, "z" * 50, 130)], "doc_id int, original_text string, tokens int")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    got = {r.doc_id: r for r in stats.compute_stats(rows, ChunkOptions(min_tokens=10, max_tokens=200, target_tokens=100), documents=docs).collect()}
    a = got[1]
    assert (a.total_chunks, a.total_tokens, a.min_tokens, a.max_tokens, a.avg_tokens, a.median_tokens) == (3, 321, 90, 130, 107, 101)
    assert (a.under_target, a.at_target, a.over_target, a.expected_chunks, a.efficiency_ratio, a.quality_flag) == (0, 2, 1, 1, 3.0, True)
    assert got[2].total_chunks == 0 and got[2].quality_flag is False


def test_patterns(spark):
    block = "struct<type:string,text:string,tokens:int>"
    rows = spark.createDataFrame(
        [(1, 0, "Installation setup step 1", [("list-item", "1. Run it", 3)]), (1, 1, "API reference", [("code", "f()", 1), ("paragraph", "parameters: a", 4)]), (1, 2, "", [])],
        f"doc_id int, section_no int, heading string, content array<{block}>",
    )
    got = {r.section_no: r for r in patterns.classify(rows).collect()}
    assert got[0].pattern == "organizational" and got[1].pattern == "reference" and math.isclose(got[0].score_organizational, 1.0)
    assert got[2].paragraph_tokens == 0.0


# --- older operators


def test_older_splitters(spark):
    assert values(spark, legacy.heading_parts, "a\n# b\nc\n## d") == [["a\n", "# b\nc\n", "## d"]]
    assert legacy.code_aware_sentences("One. Two. ```a. B``` End.") == ["One.", "Two.", "```a. B```", "End."]
    assert values(spark, lambda c: legacy.additive_cut(c, 3), "aaaa bbbb cccc dddd") == [["aaaa bbbb cccc", "dddd"]]
    assert legacy.ladder("aaa bbb ccc " * 50, "plain", 20)[0].startswith("aaa bbb")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.#", max_size=300))
def test_recursive_characters_without_overlap(text):
    """Without overlap and minimum the parts make up the text again."""
    parts = legacy.recursive_characters(text, 5, 0, 0)
    assert "".join("".join(parts).split()) == "".join(text.split())


# --- vectors


def test_search_many_equals_search(spark):
    import random

    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None), (62, [1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {}
    for x in [*vector.search_many(v, q, 3).collect(), *vector.search_many(v, q, 3, most=200).collect()]:
        got.setdefault(x.query_id, {})[x["rank"]] = (x.id, round(x.score, 9))

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else None

    for i, e in rows:
        if e is None or len(e) == 1 or not any(e):
            continue
        want = sorted(((round(cos(e, f), 9), j) for j, f in rows if f and len(f) == 4 and any(f)), key=lambda p: (-p[0], p[1]))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == [(j, s) for s, j in want]
    assert 60 not in got and got[62] == {1: (62, 1.0)}


# --- whole runs, sources, sinks, streams


def test_pipeline_edges(spark):
    docs = spark.createDataFrame([(1, "T", TEXT), (2, None, ""), (3, "N", None), (4, "L", "word " * 20_000), (4, "L", "word " * 20_000), (None, "x", "Text.")], "doc_id bigint, title string, text string")
    o = ChunkOptions(min_tokens=5, max_tokens=64, target_tokens=40)
    rows = pipeline.chunks(docs, o).collect()
    assert {r.doc_id for r in rows} == {1, 4, None}
    assert all(r.tokens <= 64 for r in rows)
    assert pipeline.chunks(docs.limit(0), o).count() == 0
    assert {r.doc_id for r in pipeline.full(docs, o)[1].collect()} >= {1, 2, 3, 4}
    with pytest.raises(ValueError, match="missing columns"):
        pipeline.chunks(docs.drop("text"))


def test_pipeline_with_byte_pairs(spark):
    import importlib.util

    if importlib.util.find_spec("public_tokenizers") is None:
        pytest.skip("no vocabulary")
    import public_tokenizers

    o = ChunkOptions(min_tokens=5, max_tokens=30, target_tokens=20, ranks_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = pipeline.chunks(spark.createDataFrame([(1, "T", TEXT)], "doc_id bigint, title string, text string"), o).collect()
    count = K.counter(o.ranks_file)
    assert rows and all(count(r.content) <= 30 for r in rows)


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text(TEXT)
    (src / "b.md").write_text("# B\n\nOther text.\n")
    (src / "c.txt").write_text("no")
    docs = files.text_files(spark, str(src))
    assert {r.title for r in docs.collect()} == {"a", "b"}
    assert [r.file_name for r in files.listing(spark, str(src)).collect()] == ["a.md", "b.md"]
    o = ChunkOptions(min_tokens=2, max_tokens=30, target_tokens=20)
    chunks = pipeline.chunks(docs.select("doc_id", "title", "text"), o)
    out = tmp_path / "out"
    written = files.write_chunk_files(chunks, str(out)).collect()
    assert {p.name for p in out.iterdir()} == {r.file_name for r in written}
    one = json.loads(next(out.iterdir()).read_text())
    assert "content" in one and "next_id" in one
    files.write_json(chunks.select("doc_id", "chunk_no", "content"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == len(written)
    stream.start(stream.documents(spark, str(src)), str(tmp_path / "table"), str(tmp_path / "mark"), o).awaitTermination()
    key = lambda df: sorted((r.title, r.chunk_no, r.content) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "table"))) == key(stream.packed(docs.select("doc_id", "title", "text"), o))


def test_header_hierarchy(spark):
    full = "intro\n# A\ntext a\n### B\ntext b\n## C\ntext c\n"
    df = spark.createDataFrame([(full, "text b"), (full, "text c"), (full, "intro"), (full, "### B\ntext b"), (full, "gone"), (full, None), ("x\ny", "y\n# Z")], "f string, p string")
    got = [r.h and (r.h.header_path, r.h.hierarchy) for r in df.select(metadata.header_hierarchy(F.col("f"), F.col("p")).alias("h")).collect()]
    assert got[:5] == [(["# A", "### B"], "A > B"), (["# A", "## C"], "A > C"), ([], ""), (["# A", "### B"], "A > B"), ([], "")]


def test_errors_and_stages(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id int, text string")
    out = pipeline.add_error(pipeline.add_error(df, "read", F.col("text").isNull(), F.lit("no text"), True), "read", F.col("doc_id") > 1, F.lit("late"))
    got = {r.doc_id: [(e.stage, e.message, e.recoverable) for e in r.errors] for r in out.collect()}
    assert got == {1: [], 2: [("read", "no text", True), ("read", "late", False)]}
    assert out.where(pipeline.has_errors(out)).count() == 1 and df.where(pipeline.has_errors(df)).count() == 0
    import chunkloom

    o = ChunkOptions(min_tokens=5, max_tokens=64, target_tokens=40)
    docs = spark.createDataFrame([(1, "T", TEXT)], "doc_id bigint, title string, text string")
    one = docs
    for stage in chunkloom.stages(o).values():
        one = stage(one)
    key = lambda d: sorted((r.doc_id, r.chunk_no, r.embed_text) for r in d.collect())
    assert key(one) == key(chunkloom.chunk_markdown(docs, o)[0])


def test_summary_file(spark, tmp_path):
    rows = spark.createDataFrame([("s", "# A", ["# A"], "x", None), ("s", "text", [], None, None), ("t", "b", None, None, None)], "source string, content string, header_path array<string>, prev_id string, next_id string")
    out = {r.source: (r.n_chunks, r.linked, r.with_hierarchy) for r in files.write_summary(rows, str(tmp_path / "s")).collect()}
    assert out == {"s": (2, 1, 1), "t": (1, 0, 0), None: (3, 1, 1)}
    assert spark.read.json(str(tmp_path / "s")).count() == 3


def test_parsed_with_clashing_columns(spark):
    from chunkloom.operators import parse

    df = spark.createDataFrame([(1, "# A", "x", "y")], "doc_id int, text string, _text string, text_ string")
    row = parse.parsed(df).collect()[0]
    assert (row._text, row.text_, row.blocks[0].text) == ("x", "y", "A") and analyze.analyze(df).collect()[0].h1 == 1


def test_front_matter(spark):
    t = "---\ntitle: A\ntags: x\n---\nBody"
    assert values(spark, files.front_matter, t, "none", None) == [{"title": "A", "tags": "x"}, {}, {}]
    assert values(spark, files.body, t, "none") == ["Body", "none"]
