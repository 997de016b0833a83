"""Work in proportion to the input, bounded memory, and results equal to plain brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import arrow as A
from chunkloom.functions import markdown as M
from chunkloom.functions import text as X
from chunkloom.functions import tokens as K
from chunkloom.operators import guardrails, legacy, metadata, normalize, pack, split, vector
from chunkloom.plans.options import ChunkOptions

ODD = ["", " ", "a", "  a  b ", "a b", "x" * 50, "x" * 50 + " y", "y " + "x" * 50, "é b c", "𝄞 𝄞𝄞𝄞𝄞𝄞𝄞 b", "a\n\nb. c! d?\ne", "　", "a \t\n b", "aaaa bbbb cccc dddd"]


def random_texts(n: int = 200) -> list[str]:
    r = random.Random(3)
    return ODD + ["".join(r.choice(["a", "bb", "ccc" * 5, "𝄞", " ", " ", "  ", "\n", "\n\n", ". ", "! ", " ", "\t"]) for _ in range(r.randrange(60))) for _ in range(n)]


def counted_cut(t: str, max_tokens: int) -> list[str]:
    """The greedy cut by counts of the joined words, word by word."""
    import re

    out, cur = [], ""
    for w in re.split(X.WHITE_PY + "+", t):
        test = f"{cur} {w}" if cur else w
        if K.count_heuristic(test) <= max_tokens:
            cur = test
        elif cur:
            out.append(cur)
            cur = w
        else:
            out.append(w)
    return [*out, cur] if cur else out or [t]


def column(spark, f, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", f(df.t).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("most", [0, 1, 2, 5, 20])
def test_hard_cut_equals_counting_each_join(most):
    for t in random_texts():
        assert split.cut_words(t, K.most_units(most)) == counted_cut(t, most)


@pytest.mark.parametrize("most", [1, 3, 20])
def test_ladder_equals_counting(most):
    for t in random_texts():
        assert split.cut_oversized(t, K.most_units(most)) == split.split_counted(t, most, K.count_heuristic)


def test_hard_cut_of_a_long_text_takes_little(spark):
    words = "lorem ipsum dolor sit amet " * 80_000
    column(spark, lambda c: split.hard_cut(c, 128), ["a b"])
    began = time.time()
    (parts,) = column(spark, lambda c: split.hard_cut(c, 128), [words.strip()])
    assert time.time() - began < 10  # 2 MB; by counts of each joined text it took minutes
    assert " ".join(parts) == words.strip() and max(map(len, parts)) <= K.most_units(128)


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    a = pa.array(["x" * n for n in (5, 0, 400, 3, 3, 3)] + [None])
    got = A.cuts(A.sizes(a), 100)
    assert [i for s in got for i in range(*s)] == list(range(7)) and len(got) == 2
    assert A.sizes(pa.array([["ab", None], None, [], ["c"] * 3], pa.list_(pa.string()))).tolist() == [5, 1, 1, 7]
    assert A.texts(pa.array([b"a\xff", None], pa.binary()).view(pa.string())) == ["a�", None]


# --- older operators


def test_additive_cut_of_a_long_text_takes_little(spark):
    text = ("lorem ipsum dolor sit amet " * 80_000).strip()
    column(spark, lambda c: legacy.additive_cut(c, 128), ["a b"])
    began = time.time()
    (parts,) = column(spark, lambda c: legacy.additive_cut(c, 128), [text])
    assert time.time() - began < 10  # 2 MB
    assert " ".join(parts) == text


def test_additive_cut_counts_units_and_keeps_ends():
    assert legacy.cut_additive("", 3) == [""]
    assert legacy.cut_additive(" a  b ", 1) == ["", "a", "b", ""]
    assert legacy.cut_additive("𝄞𝄞𝄞𝄞 bbb c", 2) == ["𝄞𝄞𝄞𝄞", "bbb c"]


def test_cumulative_overlap_equals_the_fold(spark):
    rows = [(0, ["A one. B two.", "C three.", "d", "E. f"]), (1, []), (2, ["a.", None, "b"]), (3, None)]
    df = spark.createDataFrame(rows, "i int, c array<string>")
    got = {r[0]: r[1] for r in df.select("i", legacy.cumulative_overlap(F.col("c"), 1)).collect()}
    assert got[0] == ["A one. B two.", "B two. C three.", "C three. d", "d E. f"]
    assert got[1] == [] and got[2] == ["a.", None, None] and got[3] is None


@pytest.mark.parametrize("o", [ChunkOptions(), ChunkOptions(min_tokens=3, max_tokens=8, target_tokens=6), ChunkOptions(min_tokens=0, max_tokens=2, target_tokens=0), ChunkOptions(min_tokens=5, max_tokens=6)])
def test_packing_sentences_equals_packing_arrays(spark, o):
    df = spark.createDataFrame(list(enumerate([*random_texts(), None])), "doc_id int, text string")
    blocks = F.filter(X.sentences(F.col("text")), lambda x: F.length(X.trim(x)) > 0)
    block = lambda x: F.struct(x.alias("text"), F.lit("paragraph").alias("type"), F.array().cast("array<string>").alias("trail"), F.array().cast("array<int>").alias("depths"))
    one = pack.pack_arrays(df.where("text is not null").select("doc_id", F.transform(blocks, block).alias("blocks")), "blocks", o)
    other = pack.pack_sentences(df, "text", o)
    assert one.columns == other.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


# --- vectors


@pytest.mark.parametrize("k", [1, 3, 40])
def test_tiles_find_the_best(k, monkeypatch):
    monkeypatch.setattr(vector, "_TILE", (4, 16))
    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (300, 3)).astype(float)  # many ties
    v = v[(v != 0).any(axis=1)]
    q, ids, v = vector._unit(v[:11]), r.permutation(len(v)), vector._unit(v)
    best = vector.Best(k, q)
    for a in range(0, len(v), 37):
        best.add(v[a : a + 37], ids[a : a + 37])
    got = {}
    for t, (row, score, found) in enumerate(best.kept):
        for x, s, i in zip(row, score, found):
            got.setdefault(int(x) + 4 * t, []).append((-s, i))
    score = np.round(q @ v.T, vector.DIGITS)
    assert got == {x: sorted(zip(-score[x], ids))[:k] for x in range(len(q))}


def test_many_queries_take_little_memory():
    import tracemalloc

    r = np.random.default_rng(1)
    q, v = vector._unit(r.normal(size=(4000, 8))), vector._unit(r.normal(size=(10_000, 8)))
    tracemalloc.start()
    best = vector.Best(5, q)
    best.add(v, np.arange(len(v)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20  # all scores at once are 320 MB
    assert sum(len(x[0]) for x in best.kept) == 5 * len(q)


# --- normalisation, guardrails


def marked_texts(n: int = 400) -> list[str]:
    r = random.Random(4)
    pieces = ["a", "bb c", "#", "##", "# T", "\n", "\n", "\n\n", " ", "  ", "\t", "`", "```", "```\n", "x = 1", ">", "> ", "- ", "* ", "|", "_", "---", " ", "\r", " ", "w" * 150, "𝄞" * 60]
    return [*ODD, "#" * 7, "# a\n \n", "# a", "#\n", "\n\n# a\n\n`b`", "```\na\n```", *("".join(r.choice(pieces) for _ in range(r.randrange(14))) for _ in range(n))]


def test_normalize_equals_its_steps(spark):
    def steps(c):
        c = normalize.collapse_blank_lines(normalize.strip_line_ends(c))
        return F.coalesce(X.trim(normalize.dedent(normalize.collapse_inner_spaces(c))), F.lit(""))

    texts = [*marked_texts(), None]
    assert column(spark, normalize.normalize, texts) == column(spark, steps, texts)


def test_faults_equal_the_patterns_of_the_jvm(spark):
    w, inner = X.WHITE, X.WHITE[1:-1]

    def orphaned(c):
        block, inline, begin = r"(?s)```.*?```", r"`[^`]+`", r"(?:(?<=[\n\r  ])|\A)"
        rest = F.regexp_replace(F.regexp_replace(c, block, ""), inline, "")
        for mark in (rf"#{{1,6}}{w}*[^\n\r  ]*", rf"[-*+]{w}+", rf">{w}+"):
            rest = F.regexp_replace(rest, rf"{begin}{w}*{mark}", "")
        return (c.rlike(block) | c.rlike(inline)) & (X.length(X.trim(rest)) < 200)

    def header(c):
        lines = F.split(c, "\n")
        first = X.trim(F.get(lines, F.lit(0)))
        blank = F.forall(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.length(X.trim(x)) == 0)
        return first.rlike(rf"\A#{{1,6}}{w}*\z") | (first.rlike(rf"\A#{{1,6}}{w}+[^\n\r  ]+") & (F.size(lines) > 1) & blank)

    def bits(c):
        marks = X.trim(c).rlike(rf"\A(?:#{{1,6}}{w}*|-{{3,}}|`{{3,}}|[*_\-{inner}]*|[|{inner}]*|[>{inner}]*)\z")
        tests = [F.length(X.trim(c)) == 0, marks, header(c), orphaned(c)]
        return sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))

    texts = marked_texts()
    got = column(spark, guardrails.faults, texts)
    assert got == column(spark, bits, texts) and len(set(got)) > 5


def test_checks_shuffle_no_text(spark):
    rows = spark.range(10).selectExpr("id", "id part", "repeat('x ', 20) original_text", "1 tokens")
    n = guardrails.validate(rows, key="part").select(F.explode("violations").alias("v")).groupBy("v.code").count()
    plan = n._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :].split("\n")
    assert "original_text" not in window[0] and "_faults" in window[1]
    assert plan.count("regexp_replace") == 0


def test_orphaned_code_with_long_white_space():
    began = time.time()
    assert guardrails.orphaned_code("`a`" + "\n" * 200_000 + "x")
    assert time.time() - began < 2  # each line began a search to the end


# --- offsets


def test_offsets_of_all_parts_equal_those_of_each(spark):
    full = "𝄞 one two. " + "x" * 150 + " three " + "x" * 149 + "y"
    parts = ["one", "", "no", "x" * 150, "x" * 149 + "y", "x" * 149 + "z", "𝄞", "two."]
    rows = [(full, parts), (None, parts), (full, []), ("", ["", "a"])]
    df = spark.createDataFrame(rows, "f string, ps array<string>")
    start, end, sure = metadata.char_offsets(F.col("f"), F.col("p"))
    one = df.select("f", F.explode("ps").alias("p")).select(start, end, sure).collect()
    many = df.select(F.explode(metadata.all_char_offsets(F.col("f"), F.col("ps"))).alias("x")).select("x.*").collect()
    assert list(map(tuple, one)) == list(map(tuple, many))


def test_offsets_carry_a_text_once(spark, sf_dir):
    from chunkloom.plans import queries

    plan = queries.char_offsets(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "instr" not in plan and plan.index("Join") < plan.index("collect_list")


# --- Markdown


def test_plain_tables_hold_no_nodes_until_asked():
    text = "# T\n\n| a | b |\n| --- | --- |\n" + "".join(f"| {i} | x |\n" for i in range(5))
    table = M.parse(text).children[1]
    assert isinstance(table, M.Table)
    assert M.structure(M.parse(text))["max_depth"] == 3 and M.structure(M.parse("| |\n|-|\n"))["max_depth"] == 2
    assert M.text_of(table) == "ab" + "".join(f"{i}x" for i in range(5)) and table._made is None
    nodes = [(n.type, n.value, n.start, n.end) for n, *_ in M.walk(M.parse(text))]
    assert nodes[2:7] == [("table", None, (3, 1), (9, 10)), ("tableRow", None, (3, 1), (3, 10)), ("tableCell", None, None, None), ("text", "a", None, None), ("tableCell", None, None, None)]
    assert sum(x[0] == "tableRow" for x in nodes) == 6 and sum(x[0] == "tableCell" for x in nodes) == 12


def test_tables_with_marks_are_read():
    root = M.parse("| a | `b` |\n|---|---|\n| c\\|d | [e](f) |\n| g |\n")
    assert M.text_of(root.children[0]) == "abc|deg" and not isinstance(root.children[0], M.Table)
    assert M.structure(root)["links"] == 1


def test_orders_are_read_fast():
    texts = [f"# Order {k}\n\nStatus `O`, priority **5-LOW**.\n\n| line | part | flag | status |\n| --- | --- | --- | --- |\n" + "".join(f"| {i} | {k + i} | N | O |\n" for i in range(4)) for k in range(3000)]
    began = time.time()
    found = [M.structure(M.parse(t)) for t in texts]
    assert time.time() - began < 0.8 and all(x["tables"] == 1 and x["max_depth"] == 3 for x in found)  # 0.3 s; 1.4 s before


def test_block_arrays_equal_rows_of_values(spark):
    import pyarrow as pa
    from chunkloom.operators import parse
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T._parse_datatype_string(f"array<{parse.BLOCK}>"))
    found = [M.flatten(M.parse(t)) for t in ("# a\n\n## b\n\n- x\n\n```py\nc\n```\n", "", "p *q*\n\n| a |\n|---|\n", "𝄞")]
    point = lambda p: {"line": p[0], "column": p[1]}
    rows = [[{**{k: x[k] for k in ("type", "text", "depth", "lang", "trail", "depths")}, "position": {"start": point(x["start"]), "end": point(x["end"])}} for x in f] for f in found]
    assert parse._block_arrays(found, kind).to_pylist() == pa.array(rows, kind).to_pylist()
    assert parse._block_arrays([], kind).type == kind
