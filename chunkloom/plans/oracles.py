"""The queries again, in the SQL of DuckDB over the same tables."""

from __future__ import annotations

from ..functions.text import WHITE_RE2 as W
from ..operators import patterns as P
from .options import DEFAULTS, ChunkOptions
from .synthesis import CONVERSATION_SQL, PLACE_SQL

SMALL = ChunkOptions(min_tokens=40, max_tokens=128, target_tokens=100, overlap_sentences=1)
NL, MARK = "chr(10)", "chr(1)"
_q = lambda s: "'" + s.replace("'", "''") + "'"


# --- expressions


def n16(c: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tok_of(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, floor(({n}) / 3.8::DOUBLE)::INT) END)"


def tok(c: str) -> str:
    return tok_of(n16(c))


def tok1(c: str) -> str:
    return f"greatest(1, floor({n16(c)} / 3.8::DOUBLE)::INT)"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '\\A{W}+|{W}+\\z', '', 'g')"


def not_blank(parts: str, v: str = "q") -> str:
    return f"list_filter({parts}, lambda {v}: length({trim(v)}) > 0)"


def sentences(c: str) -> str:
    parts = not_blank(f"string_split(regexp_replace({c}, '([.!?]){W}+', '\\1' || {MARK}, 'g'), {MARK})")
    return f"(CASE WHEN {c} IS NULL THEN NULL WHEN len({parts}) > 0 THEN {parts} ELSE [{c}] END)"


def lines(c: str) -> str:
    return not_blank(f"string_split({c}, {NL})")


def paragraphs(c: str) -> str:
    return not_blank(f"string_split({c}, {NL} || {NL})")


def rows(source: str, parts: str, number: str = "block_no", name: str = "text", more: str = "doc_id") -> str:
    return f"SELECT {more}, (generate_subscripts(p, 1) - 1)::INT AS {number}, unnest(p) AS {name} FROM (SELECT *, {parts} AS p FROM {source})"


def half_up(c: str) -> str:
    return f"floor({c} + 0.5::DOUBLE)::BIGINT"


def round2(c: str) -> str:
    return f"floor({c} * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


def joined(c: str, sep: str = "|") -> str:
    return f"array_to_string(list_transform({c}, lambda z: z::VARCHAR), {_q(sep)})"


def hard_cut(c: str, most: int) -> str:
    """Words, and the first word of each part of a greedy cut: a fold over lengths."""
    words = f"string_split(regexp_replace({c}, '{W}+', {MARK}, 'g'), {MARK})"
    size = "(CASE WHEN s['n'] = 0 THEN e['n'] ELSE s['n'] + 1 + e['n'] END)"
    fits = f"{tok_of(size)} <= {most}"
    step = f"{{'i': s['i'] + 1, 'n': CASE WHEN {fits} THEN {size} WHEN s['n'] > 0 THEN e['n'] ELSE 0 END, 'st': CASE WHEN s['n'] = 0 OR NOT {fits} THEN list_append(s['st'], s['i']) ELSE s['st'] END}}"
    zero = "{'i': 0::BIGINT, 'n': 0::BIGINT, 'st': []::BIGINT[]}"
    ns = f"list_transform({words}, lambda w: {{'i': 0::BIGINT, 'n': {n16('w')}::BIGINT, 'st': []::BIGINT[]}})"
    return f"{{'w': {words}, 'st': list_reduce({ns}, lambda s, e: {step}, {zero})['st']}}"


def cut_parts(f: str, c: str) -> str:
    return f"list_transform({f}['st'], lambda a, i: array_to_string({f}['w'][a + 1 : coalesce({f}['st'][i + 1], len({f}['w']))], ' '))"


DOCS = "(SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL)"


def ladder(source: str, most: int) -> str:
    """(doc_id, block_no, text): paragraphs, sentences, lines, words in turn, on rows that are still too large."""
    sql = f"(SELECT doc_id, []::BIGINT[] AS o, text AS t, {tok('text')} <= {most} AS whole FROM {source})"
    for rung in (paragraphs, sentences, lines):
        parts = f"(SELECT *, CASE WHEN {tok('t')} <= {most} THEN NULL ELSE {rung('t')} END AS p FROM {sql})"
        sql = (
            f"(SELECT doc_id, list_append(o, 0) AS o, t, whole FROM {parts} WHERE p IS NULL OR len(p) <= 1 "
            f"UNION ALL SELECT doc_id, list_append(o, i), {trim('x')}, whole FROM (SELECT doc_id, o, whole, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM {parts} WHERE len(p) > 1))"
        )
    cut = f"(SELECT *, CASE WHEN {tok('t')} <= {most} THEN [t] ELSE list_transform({cut_parts('f', 't')}, lambda z: {trim('z')}) END AS p FROM (SELECT *, CASE WHEN {tok('t')} > {most} THEN {hard_cut('t', most)} END AS f FROM {sql}))"
    flat = f"(SELECT doc_id, whole, list_append(o, generate_subscripts(p, 1)) AS o, unnest(p) AS text FROM {cut})"
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS block_no, text FROM {flat} WHERE whole OR length(text) > 0"


def pack(blocks: str, o: ChunkOptions, more: str = "doc_id") -> str:
    """Chunks of rows (doc_id, b), b a list of (text, type, trail, depths)."""
    size = f"(CASE WHEN s['open'] AND {tok_of("(s['len'] + 2 + e['i'])")} <= {o.max_tokens} THEN s['len'] + 2 + e['i'] ELSE e['i'] END)"
    more_ = f"(s['open'] AND {tok_of("(s['len'] + 2 + e['i'])")} <= {o.max_tokens})"
    full = f"({tok_of(size)} >= {o.max_tokens * 0.9}::DOUBLE OR ({tok_of(size)} >= {o.min_tokens} AND {tok_of(size)} >= {o.pack_target}))"
    step = f"{{'i': s['i'] + 1, 'len': {size}, 'open': NOT {full}, 'at': CASE WHEN {more_} THEN s['at'] ELSE list_append(s['at'], s['i']) END}}"
    zero = "{'i': 0::BIGINT, 'len': 0::BIGINT, 'open': false, 'at': []::BIGINT[]}"
    a = f"(SELECT *, list_transform(b, lambda x: {n16("x['text']")}::BIGINT) AS ls FROM {blocks})"
    a = f"(SELECT *, {tok_of('(list_sum(ls) + 2 * (len(ls) - 1))')} <= {o.max_tokens} AS one FROM {a} WHERE len(ls) > 0)"
    a = f"(SELECT *, CASE WHEN NOT one THEN list_reduce(list_transform(ls, lambda x: {{'i': x, 'len': x, 'open': false, 'at': []::BIGINT[]}}), lambda s, e: {step}, {zero}) END AS f FROM {a})"
    a = f"(SELECT *, CASE WHEN one THEN [0::BIGINT] ELSE f['at'] END AS st0 FROM {a})"
    a = f"(SELECT *, len(st0) AS k, list_sum(ls[st0[-2] + 1 : st0[-1]]) + 2 * (st0[-1] - st0[-2] - 1) AS bef FROM {a})"
    a = f"(SELECT *, CASE WHEN NOT one AND k > 1 AND f['open'] AND {tok_of("f['len']")} < {o.min_tokens} AND {tok_of("(bef + 2 + f['len'])")} <= {o.max_tokens} THEN st0[1 : k - 1] ELSE st0 END AS st FROM {a})"
    a = f"(SELECT *, unnest(generate_series(1, len(st))) AS c FROM {a})"
    a = f"(SELECT *, b[st[c] + 1 : coalesce(st[c + 1], len(b))] AS nodes, b[st[c] + 1 : coalesce(st0[c + 1], len(b))] AS closed FROM {a})"
    a = f"(SELECT *, array_to_string(list_transform(nodes, lambda x: x['text']), {NL} || {NL}) AS content FROM {a})"
    types = "list_transform(closed, lambda x: x['type'])"
    return (
        f"SELECT {more}, (c - 1)::INT AS chunk_no, content, {tok('content')} AS tokens, len(closed)::INT AS node_count, "
        f"list_filter({types}, lambda x, i: list_position({types}, x) = i) AS types, nodes[1]['trail'] AS trail, nodes[1]['depths'] AS depths FROM {a}"
    )


SENTENCE_BLOCKS = (
    f"(SELECT doc_id, source, list_transform(list_filter({sentences('text')}, lambda x: length({trim('x')}) > 0), "
    f"lambda x: {{'text': x, 'type': 'paragraph', 'trail': []::VARCHAR[], 'depths': []::INT[]}}) AS b FROM {DOCS})"
)


def packed(o: ChunkOptions) -> str:
    return f"({pack(SENTENCE_BLOCKS, o, 'doc_id, source')})"


def trails(blocks: str) -> str:
    """Rows with trail and depths: the headings that are open at each block."""
    h = f"(SELECT doc_id, block_no, text, depth FROM {blocks} WHERE type = 'heading')"
    ends = f"(SELECT a.doc_id, a.block_no, a.text, a.depth, min(n.block_no) AS ends FROM {h} a LEFT JOIN {h} n ON a.doc_id = n.doc_id AND n.block_no > a.block_no AND n.depth <= a.depth GROUP BY ALL)"
    open_ = f"(SELECT b.doc_id, b.block_no, list(e.text ORDER BY e.block_no) AS trail, list(e.depth ORDER BY e.block_no) AS depths FROM {blocks} b JOIN {ends} e ON b.doc_id = e.doc_id AND e.block_no <= b.block_no AND (e.ends IS NULL OR e.ends > b.block_no) GROUP BY ALL)"
    return f"SELECT b.*, coalesce(o.trail, []::VARCHAR[]) AS trail, coalesce(o.depths, []::INT[]) AS depths FROM {blocks} b LEFT JOIN {open_} o ON b.doc_id = o.doc_id AND b.block_no = o.block_no"


TALK_BLOCKS = f"({trails(f'({CONVERSATION_SQL})')})"


def block_lists(blocks: str) -> str:
    return f"(SELECT doc_id, list({{'text': text, 'type': type, 'trail': trail, 'depths': depths}} ORDER BY block_no) AS b FROM {blocks} GROUP BY doc_id)"


TALK_CHUNKS = f"({pack(block_lists(TALK_BLOCKS), SMALL)})"


def overlapped(chunks: str, o: ChunkOptions) -> str:
    lagged = f"(SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS bef FROM {chunks})"
    cut = f"(SELECT *, {sentences('bef')} AS ss FROM {lagged})"
    tail = f"(SELECT *, array_to_string(ss[-least({o.overlap_sentences}, len(ss)) :], ' ') || ' ' || content AS longer FROM {cut})"
    take = f"(SELECT *, bef IS NOT NULL AND longer <> ' ' || content AND {tok('longer')} <= {o.max_tokens} AS take FROM {tail})"
    return f"SELECT * EXCLUDE (bef, ss, longer, take, content, tokens), CASE WHEN take THEN longer ELSE content END AS content, CASE WHEN take THEN {tok('longer')} ELSE tokens END AS tokens FROM {take}"


# --- headings


def clean(c: str) -> str:
    for pattern, to in ((rf"\A#+{W}*", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"`([^`]+)`", r"\1"), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"~~([^~]+)~~", r"\1")):
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(to)}, 'g')"
    return trim(c)


def slug(c: str) -> str:
    return rf"replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\- ]', '', 'g'), ' ', '-')"


def sniffed(c: str) -> str:
    return (
        f"list_filter([CASE WHEN contains({c}, '#') THEN 'heading' END, CASE WHEN contains({c}, '```') THEN 'code' END, "
        f"CASE WHEN contains({c}, '- ') OR contains({c}, '* ') OR regexp_matches({c}, '(\\A|[\\n\\r\\x{{2028}}\\x{{2029}}])[0-9]+\\.') THEN 'list-item' END, "
        f"CASE WHEN contains({c}, '|') THEN 'table' END, CASE WHEN contains({c}, '>') THEN 'blockquote' END, 'paragraph'], lambda x: x IS NOT NULL)"
    )


PART_HEADING = (
    "CASE p_size % 6 WHEN 0 THEN '## **' || p_name || '**' WHEN 1 THEN '# [' || p_name || '](http://x.example/a)!' WHEN 2 THEN '### `' || p_name || '` (Beta)' "
    "WHEN 3 THEN '*' || p_name || '*' WHEN 4 THEN '#### ~~' || p_name || '~~ & more' ELSE ' ' || upper(p_name) || ' ' END"
)
NAME = "'Conversation ' || doc_id::VARCHAR"


def slugs(paths: str) -> str:
    """(doc_id, h, s): slug of each cleaned heading of rows (doc_id, chunk_no, header_path), numbered among equal bases."""
    each = f"(SELECT doc_id, chunk_no, generate_subscripts(header_path, 1) AS i, {clean('unnest(header_path)')} AS h FROM {paths})"
    first = f"(SELECT doc_id, h, min((chunk_no, i)) AS place FROM {each} GROUP BY ALL)"
    ranked = f"(SELECT *, {slug('h')} AS base, row_number() OVER (PARTITION BY doc_id, {slug('h')} ORDER BY place) AS r FROM {first})"
    return f"SELECT doc_id, h, CASE WHEN r = 1 THEN base ELSE base || '-' || (r - 1)::VARCHAR END AS s FROM {ranked}"


def described(chunks: str = TALK_CHUNKS, title: str = "Talk ") -> str:
    """Chunks of the conversations with all metadata."""
    before = f"coalesce(sum({n16('content')}) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"
    first = f"coalesce(list_filter(list_transform(string_split(content, {NL}), lambda x: {trim('x')}), lambda x: starts_with(x, '#'))[1], '')"
    a = f"(SELECT *, 'doc:' || doc_id::VARCHAR || '.md' AS parent_id, {before} AS char_start, sum({n16('content')}) OVER (PARTITION BY doc_id)::BIGINT AS total_chars, {first} AS own FROM {chunks})"
    a = f"(SELECT *, char_start + {n16('content')} AS char_end, parent_id || '::ch' || chunk_no::VARCHAR AS id, CASE WHEN len(trail) > 0 THEN trail WHEN own <> '' THEN [own] ELSE [] END AS header_path FROM {a})"
    a = f"(SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, CASE WHEN len(depths) > 0 THEN depths ELSE range(1, len(header_path) + 1) END AS header_depths FROM {a} WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no))"
    s = f"(SELECT doc_id AS k, list({{'h': h, 's': s}}) AS m FROM ({slugs(a)}) GROUP BY doc_id)"
    a = f"(SELECT *, list_transform(header_path, lambda p: list_filter(m, lambda e: e['h'] = {clean('p')})[1]['s']) AS header_slugs FROM {a} LEFT JOIN {s} ON doc_id = k)"
    return (
        f"(SELECT * EXCLUDE (own, m, k), CASE WHEN len(types) > 0 THEN types ELSE {sniffed('content')} END AS node_types, array_to_string(header_path, ' > ') AS header_breadcrumb, "
        f"coalesce(header_path[-1], '') AS section_title, coalesce(header_slugs[-1], '') AS section_slug, ceil({n16('content')} / 3.8::DOUBLE)::INT AS estimated_tokens, "
        f"'{title}' || doc_id::VARCHAR AS file_title, {trim('content')} AS original_text FROM {a})"
    )


def embedded(mode: str, o: ChunkOptions = SMALL, source: str | None = None) -> str:
    full = "(CASE WHEN file_title IS NOT DISTINCT FROM header_path[1] THEN header_breadcrumb WHEN header_breadcrumb <> '' THEN file_title || ' > ' || header_breadcrumb ELSE file_title END)"
    whole = f"(CASE WHEN {full} <> '' THEN {truncated(full)} || {NL} || {NL} || original_text ELSE original_text END)"
    begins = f"(section_title <> '' AND starts_with({trim('original_text')}, '#') AND starts_with(lower(regexp_replace({trim('original_text')}, '\\A#+{W}*', '')), lower(section_title)))"
    needs = f"(regexp_matches({trim('original_text')}, '\\A#+{W}') OR (len(node_types) > 0 AND len(list_filter(node_types, lambda x: x NOT IN ('code', 'table', 'list-item'))) = 0) OR tokens < {o.min_tokens})"
    title = f"(file_title IS DISTINCT FROM header_path[1] AND file_title <> '')"
    of = {
        "none": "original_text",
        "always": f"CASE WHEN {begins} THEN original_text ELSE {whole} END",
        "conditional": f"CASE WHEN {begins} THEN original_text WHEN {needs} THEN {whole} WHEN {title} THEN file_title || {NL} || {NL} || original_text ELSE original_text END",
    }
    return f"(SELECT *, {of[mode]} AS embed_text FROM {source or described()})"


def truncated(c: str, longest: int = 160) -> str:
    side = (longest - 1) // 2
    return f"(CASE WHEN length({c}) <= {longest} THEN {c} ELSE left({c}, {side}) || '…' || right({c}, {side}) END)"


# --- white space

SEEDED = f"('  ' || replace(replace(text, '. ', '. ' || chr(9) || ' '), {NL}, ' ' || chr(9) || {NL} || ' ' || {NL} || {NL} || {NL} || '   ') || ' ' || {NL})"
FENCED = f"('    ' || replace(text, {NL}, {NL} || '  ') || {NL} || '  ```py' || {NL} || '    x  =  1' || {NL} || {NL} || '      y' || {NL} || '  ```' || {NL} || '   end  of   it')"


def strip_ends(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, {NL}), lambda x: regexp_replace(x, '{W}+\\z', '')), {NL})"


def collapse_blank(c: str) -> str:
    return f"regexp_replace({c}, '\\n{W}*\\n{W}*\\n+', {NL} || {NL}, 'g')"


def line_rows(source: str, key: str, c: str) -> str:
    """(key, i, line, free) of each line; free is no fence, not in one and not blank."""
    a = f"(SELECT {key}, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT *, string_split({c}, {NL}) AS l FROM {source}))"
    a = f"(SELECT *, regexp_matches(line, '\\A{W}*```') AS fence FROM {a})"
    a = f"(SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AND NOT fence AS inside FROM {a})"
    return f"(SELECT *, NOT fence AND NOT inside AND length({trim('line')}) > 0 AS free FROM {a})"


def spaces(source: str, key: str, c: str) -> str:
    return f"(SELECT {key}, string_agg(CASE WHEN free THEN regexp_replace(line, '{W}+', ' ', 'g') ELSE line END, {NL} ORDER BY i) AS text FROM {line_rows(source, key, c)} GROUP BY ALL)"


def dedented(source: str, key: str, c: str) -> str:
    indent = f"length(regexp_extract(line, '\\A({W}*)', 1))"
    a = f"(SELECT *, coalesce(min(CASE WHEN free THEN {indent} END) OVER (PARTITION BY {key}), 0) AS least FROM {line_rows(source, key, c)})"
    return f"(SELECT {key}, string_agg(CASE WHEN free THEN substr(line, least + 1) ELSE line END, {NL} ORDER BY i) AS text FROM {a} GROUP BY ALL)"


# --- guardrails

_LITERALS = {0: f"'  ' || {NL} || ' '", 1: "'###  '", 2: "'-----'", 3: "'``````'", 4: "' ** _ - '", 5: f"'| |' || {NL} || '|'", 6: "'>  >'", 7: f"'## Title' || {NL} || ' ' || {NL}"}
_SEED = (
    f"CASE doc_id % 12 WHEN 8 THEN '# Head' || {NL} || '- item `x`' || {NL} || '> ' || text WHEN 9 THEN '```' || {NL} || 'code' || {NL} || '```' || {NL} || text "
    + " ".join(f"WHEN {k} THEN {v}" for k, v in _LITERALS.items())
    + f" ELSE '```' || {NL} || text || {NL} || '```' END"
)
GUARD = f"(SELECT doc_id, false AS seeded, text AS t, doc_id // 3 AS part FROM documents UNION ALL SELECT doc_id, true, {_SEED}, -1 - doc_id FROM documents)"


def codes(o: ChunkOptions) -> str:
    """Codes of what is wrong with a chunk: of its text c, its tokens, and whether it is single."""
    inner = W[1:-1]
    c = "c"
    begin = r"(\A|[\n\r\x{2028}\x{2029}])"
    rest = f"regexp_replace(regexp_replace({c}, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g')"
    for p in (rf"{W}*#{{1,6}}{W}*[^\n\r\x{{2028}}\x{{2029}}]*", rf"{W}*[-*+]{W}+", rf"{W}*>{W}+"):
        rest = rf"regexp_replace({rest}, '{begin}{p}', '\1', 'g')"
    marks = rf"\A(#{{1,6}}{W}*|-{{3,}}|`{{3,}}|[*_\-{inner}]*|[|{inner}]*|[>{inner}]*)\z"
    l = f"string_split({c}, {NL})"
    tests = {
        "EMPTY_CONTENT": f"length({trim(c)}) = 0",
        "TOO_SHORT": f"NOT single AND tokens < {o.min_tokens}",
        "TOO_LONG": f"tokens > {o.max_tokens}",
        "FORMATTING_ONLY": f"regexp_matches({trim(c)}, '{marks}')",
        "EMPTY_HEADER": rf"regexp_matches({trim(l + '[1]')}, '\A#{{1,6}}{W}*\z') OR (regexp_matches({trim(l + '[1]')}, '\A#{{1,6}}{W}+[^\n\r\x{{2028}}\x{{2029}}]+') AND len({l}) > 1 AND len(list_filter({l}[2:], lambda x: length({trim('x')}) > 0)) = 0)",
        "ORPHANED_CODE": f"(regexp_matches({c}, '(?s)```.*?```') OR regexp_matches({c}, '`[^`]+`')) AND {n16(trim(rest))} < 200",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + "], lambda x: x IS NOT NULL)"


def guarded(o: ChunkOptions = DEFAULTS) -> str:
    a = f"(SELECT doc_id, coalesce(t, '') AS c, coalesce({tok('t')}, 0) AS tokens, count(*) OVER (PARTITION BY part) = 1 AS single, seeded FROM {GUARD})"
    return f"(SELECT doc_id, seeded, tokens, {codes(o)} AS codes FROM {a})"


# --- statistics


def stats(chunks: str, o: ChunkOptions, documents: str | None = None, content: str = "content") -> str:
    target = o.stats_target
    tol = int(target * 0.1)
    a = (
        f"(SELECT doc_id, count(*) AS total_chunks, sum(tokens)::BIGINT AS total_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens, {half_up('avg(tokens)')} AS avg_tokens, "
        f"{half_up('median(tokens)')} AS median_tokens, sum({n16(content)})::BIGINT AS source_length, count(*) FILTER (tokens < {target - tol}) AS under_target, "
        f"count(*) FILTER (tokens BETWEEN {target - tol} AND {target + tol}) AS at_target, count(*) FILTER (tokens > {target + tol}) AS over_target FROM {chunks} GROUP BY doc_id)"
    )
    a = f"(SELECT *, ceil(ceil(source_length / 3.8::DOUBLE) / {target}::DOUBLE)::BIGINT AS expected_chunks FROM {a})"
    ratio = "CASE WHEN expected_chunks > 0 THEN total_chunks / expected_chunks::DOUBLE ELSE 0 END"
    dev = "CASE WHEN expected_chunks > 0 THEN abs(total_chunks - expected_chunks) / expected_chunks::DOUBLE ELSE 0 END"
    a = f"(SELECT *, total_chunks AS actual_chunks, {round2(ratio)} AS efficiency_ratio, {round2(dev)} AS deviation, {round2('CASE WHEN source_length > 0 THEN total_tokens / source_length::DOUBLE END')} AS compression_ratio, {dev} > 0.2 AS quality_flag FROM {a})"
    if documents is None:
        return a
    names = "total_chunks total_tokens min_tokens max_tokens avg_tokens median_tokens source_length under_target at_target over_target expected_chunks actual_chunks efficiency_ratio deviation compression_ratio".split()
    return f"(SELECT d.doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in names)}, coalesce(quality_flag, false) AS quality_flag FROM (SELECT DISTINCT doc_id FROM {documents}) d LEFT JOIN {a} s ON d.doc_id = s.doc_id)"


# --- patterns


def classified() -> str:
    phrases = ["", "1. Click it, run it and install it. ", "parameters: a. returns: b. ", "This is a thing and means it. ", "It refers to the rest. Remove and add and set. ", "output: x ", "Is it? ", "2. Start now. ", "defined as that "]
    heads = ["", " setup", " API reference", " definition", " how to guide", " class and method", " what is it?", " step 2", " part 3 install"]
    of = lambda xs: "[" + ", ".join(_q(x) for x in xs) + "][k + 1]"
    any_ = lambda c, ws: "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in ws) + ")"
    a = f"(SELECT *, (doc_id * 7 + block_no) % 9 AS k FROM ({CONVERSATION_SQL}))"
    a = f"(SELECT doc_id, block_no, CASE WHEN type = 'heading' THEN text || {of(heads)} ELSE {of(phrases)} || text END AS text, CASE WHEN type = 'heading' THEN type WHEN k IN (2, 5) THEN 'code' WHEN k IN (1, 7) THEN 'list-item' ELSE type END AS type FROM {a})"
    a = f"(SELECT *, {tok('text')} AS tokens, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY block_no)::BIGINT AS section_no FROM {a})"
    b = "type <> 'heading'"
    low, h = "lower(text)", "lower(heading)"
    defs = " + ".join(f"len(regexp_extract_all({low}, '{p}'))" for p in (rf"\bis{W}+(?:a|an|the){W}+", rf"\bmeans{W}+", rf"\brefers{W}+to{W}+", rf"\bdefined{W}+as{W}+"))
    verbs = " + ".join(rf"regexp_matches({low}, '\b{v}\b')::INT" for v in P.VERBS)
    a = (
        f"(SELECT doc_id, section_no, coalesce(max(text) FILTER (type = 'heading'), '') AS heading, count(*) FILTER ({b}) AS n, count(*) FILTER (type = 'code') AS nc, count(*) FILTER (type = 'list-item') AS nl, "
        f"coalesce(sum({defs}) FILTER ({b}), 0)::BIGINT AS definitions, coalesce(sum({verbs}) FILTER ({b}), 0)::BIGINT AS imperatives, coalesce(avg(tokens) FILTER (type = 'paragraph'), 0.0) AS paragraph_tokens, "
        f"coalesce(bool_or({any_(low, P.ACTIONS)}) FILTER ({b}), false) AS has_action, coalesce(string_agg(text, ' ' ORDER BY block_no) FILTER ({b}), '') AS body, "
        f"coalesce(bool_or(regexp_matches({trim('text')}, '\\A[0-9]+\\.')) FILTER (type = 'list-item'), false) AS has_sequence_items FROM {a} GROUP BY doc_id, section_no)"
    )
    a = (
        f"(SELECT *, {any_(h, P.ORGANIZING)} AS is_organizational, {any_(h, P.REFERENCE)} AS is_reference, {any_(h, P.PROCEDURE)} AS is_procedural, "
        f"contains({h}, '?') OR starts_with({h}, 'how ') OR starts_with({h}, 'what ') AS is_question, contains({h}, 'what is') OR ends_with({h}, 'definition') AS is_definition, "
        f"regexp_matches({h}, '\\b(step|part|phase){W}*[0-9]+') AS has_sequence, CASE WHEN n > 0 THEN nc / n::DOUBLE ELSE 0 END AS code_ratio, CASE WHEN n > 0 THEN nl / n::DOUBLE ELSE 0 END AS list_ratio, "
        f"0 AS questions, regexp_matches(lower(body), 'parameters?:|arguments?:|props?:') AS has_parameters, regexp_matches(lower(body), 'returns?:|response:|output:') AS has_returns FROM {a})"
    )
    terms = {
        "organizational": [("is_organizational", 0.4), ("has_sequence", 0.3), ("has_action", 0.2), ("list_ratio > 0.3", 0.1)],
        "reference": [("is_reference", 0.4), ("code_ratio > 0.2", 0.3), ("has_parameters", 0.2), ("has_returns", 0.1), ("paragraph_tokens < 100", 0.1)],
        "procedural": [("is_procedural", 0.4), ("imperatives > 2", 0.3), ("list_ratio > 0.4", 0.2), ("has_sequence_items", 0.1)],
        "conceptual": [("paragraph_tokens > 150", 0.3), ("imperatives = 0", 0.2), ("code_ratio < 0.1", 0.2), ("NOT has_action", 0.2), ("list_ratio < 0.2", 0.1)],
        "faq": [("is_question", 0.5), ("questions > 0", 0.3), ("definitions > 0", 0.2)],
        "glossary": [("is_definition", 0.4), ("definitions > 0", 0.4), ("paragraph_tokens < 80", 0.2)],
    }
    score = ", ".join(f"least(1.0::DOUBLE, 0.0::DOUBLE + {' + '.join(f'CASE WHEN {t} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END' for t, w in ts)}) AS score_{k}" for k, ts in terms.items())
    a = f"(SELECT *, {score} FROM {a})"
    best = f"greatest({', '.join(f'score_{k}' for k in terms)}, 0.1::DOUBLE)"
    return f"(SELECT *, CASE {' '.join(f'WHEN score_{k} = {best} THEN {_q(k)}' for k in terms)} ELSE 'mixed' END AS pattern FROM {a})"


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / {union}::DOUBLE ELSE 0.0 END)"


def _words(c: str) -> str:
    return f"list_distinct(list_filter(string_split(regexp_replace(lower({c}), '[^A-Za-z0-9_]+', {MARK}, 'g'), {MARK}), lambda w: length(w) > 3))"


def merges() -> str:
    a = f"(SELECT *, {_words("heading || ' ' || body")} AS words FROM {classified()})"
    a = f"(SELECT *, lead(pattern) OVER w AS next_pattern, lead(words) OVER w AS next_words FROM {a} WINDOW w AS (PARTITION BY doc_id ORDER BY section_no))"
    a = f"(SELECT *, {jaccard('words', 'next_words')} AS similarity FROM {a} WHERE next_pattern IS NOT NULL)"
    both = lambda p: f"pattern = '{p}' AND next_pattern = '{p}'"
    either = lambda p: f"'{p}' IN (pattern, next_pattern)"
    cases = [
        (both("organizational"), "true", "0.9", "'both organizational'"),
        (both("reference"), "similarity > 0.7", "similarity", f"'reference, similarity ' || {half_up('similarity * 100')}::VARCHAR || '%'"),
        (both("faq"), "true", "0.8", "'both faq'"),
        (both("glossary"), "true", "0.8", "'both glossary'"),
        (either("conceptual"), "false", "0.9", "'conceptual stays apart'"),
        (either("mixed"), "false", "0.5", "'unclear pattern'"),
        ("true", "false", "0.6", "'different: ' || pattern || ' and ' || next_pattern"),
    ]
    pick = lambda i, t: "CASE " + " ".join(f"WHEN {c[0]} THEN ({c[i]})::{t}" for c in cases) + " END"
    return f"SELECT doc_id, section_no, pattern, next_pattern, similarity, {pick(1, 'BOOLEAN')} AS merge, {pick(2, 'DOUBLE')} AS confidence, {pick(3, 'VARCHAR')} AS reason FROM {a}"


# --- older operators

TALK_TEXT = (
    f"(SELECT conv_id AS doc_id, 'Conversation ' || conv_id::VARCHAR AS title, '# Conversation ' || conv_id::VARCHAR || {NL} || {NL} || "
    f"string_agg('## ' || role || {NL} || {NL} || text, {NL} || {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
)


def split_at(c: str, pattern: str, flags: str = "") -> str:
    """Cut before each match."""
    return not_blank(f"string_split(regexp_replace({trim(c)}, {_q(flags + '(' + pattern + ')')}, {MARK} || '\\1', 'g'), {MARK})")


CODE = f"('x = 1' || {NL} || 'function f() {{' || {NL} || '}}' || {NL} || '  const y = ' || replace(text, {NL}, {NL} || 'let z = '))"


def additive_parts(c: str, most: int) -> str:
    """{'done': parts} of a greedy cut at words by the sum of their counts."""
    words = f"list_transform(string_split(regexp_replace({trim(c)}, '\\s+', {MARK}, 'g'), {MARK}), lambda w: {{'n': {tok1("(w || ' ')")}::BIGINT, 'cur': [w], 'parts': []::VARCHAR[]}})"
    full = f"(s['n'] + e['n'] > {most} AND len(s['cur']) > 0)"
    step = f"{{'n': CASE WHEN {full} THEN e['n'] ELSE s['n'] + e['n'] END, 'cur': CASE WHEN {full} THEN e['cur'] ELSE list_concat(s['cur'], e['cur']) END, 'parts': CASE WHEN {full} THEN list_append(s['parts'], array_to_string(s['cur'], ' ')) ELSE s['parts'] END}}"
    f = f"list_reduce({words}, lambda s, e: {step}, {{'n': 0::BIGINT, 'cur': []::VARCHAR[], 'parts': []::VARCHAR[]}})"
    return f"list_transform([{f}], lambda f: {{'done': CASE WHEN len(f['cur']) > 0 THEN list_append(f['parts'], array_to_string(f['cur'], ' ')) ELSE f['parts'] END}})[1]"


def additive(c: str, most: int) -> str:
    return f"(SELECT doc_id, {additive_parts(c, most)}['done'] AS p FROM {DOCS})"


def old_pack(most: int) -> str:
    step = f"{{'i': s['i'] + 1, 'n': CASE WHEN s['i'] = 0 OR s['n'] + e['n'] > {most} THEN e['n'] ELSE s['n'] + e['n'] END, 'at': CASE WHEN s['i'] = 0 OR s['n'] + e['n'] > {most} THEN list_append(s['at'], s['i']) ELSE s['at'] END}}"
    a = f"(SELECT doc_id, {lines('text')} AS p FROM {DOCS})"
    a = f"(SELECT *, list_reduce(list_transform(p, lambda x: {{'i': 0::BIGINT, 'n': {tok1('x')}::BIGINT, 'at': []::BIGINT[]}}), lambda s, e: {step}, {{'i': 0::BIGINT, 'n': 0::BIGINT, 'at': []::BIGINT[]}})['at'] AS st FROM {a} WHERE len(p) > 0)"
    a = f"(SELECT *, unnest(generate_series(1, len(st))) AS c FROM {a})"
    return f"SELECT doc_id, (c - 1)::INT AS chunk_no, array_to_string(p[st[c] + 1 : coalesce(st[c + 1], len(p))], {NL} || {NL}) AS content, (coalesce(st[c + 1], len(p)) - st[c])::INT AS n_pieces FROM {a}"


def old_overlap() -> str:
    last = sentences("s[-1]")
    a = f"(SELECT doc_id, list([content] ORDER BY chunk_no) AS c FROM {packed(SMALL)} GROUP BY doc_id)"
    a = f"(SELECT doc_id, list_reduce(c, lambda s, e: CASE WHEN len(s) = 0 THEN e ELSE list_append(s, {last}[-1] || ' ' || e[1]) END, []::VARCHAR[]) AS p FROM {a})"
    return f"SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS chunk_no, unnest(p) AS content FROM {a}"


def old_quality() -> str:
    t = trim("c")
    n = f"length({t})"
    marks = r"-+|#+\s*|\s*[`*_-]+\s*|```\s*"
    low = rf"({n} < 100 AND NOT regexp_matches({t}, '\A#+\s+\w')) OR regexp_matches({t}, '\A({marks})\z') OR ({n} < 200 AND regexp_matches({t}, '(?s)\A(```.*```|<script.*</script>)\z'))"
    useless = r"(?s)\A(-+|=+|#+\s*|\s*[`*_-]+\s*|```.*```|\s*\|\s*\|\s*|\s*>\s*|\s*[0-9]+\.\s*|\s*[-*+]\s*)\z"
    words = rf"list_filter(string_split(regexp_replace(regexp_replace({t}, '[#*_`>\-=|]', '', 'g'), '\s+', {MARK}, 'g'), {MARK}), lambda w: w <> '')"
    return f"SELECT doc_id, seeded, {low} AS low, {n} < 50 OR regexp_matches({t}, '{useless}') OR len({words}) < 3 AS useless, {n} <= 10 AS trivial FROM (SELECT doc_id, seeded, t AS c FROM {GUARD})"


def old_sentences(c: str) -> str:
    one = lambda x: f"regexp_replace({x}, '(\\S[.!?])\\s+([A-Z0-9\"''(])', '\\1' || {MARK} || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({one(one(c))}, {MARK}), lambda x: {trim('x')}), lambda x: x <> '')"


# --- vectors


def cosine(a: str, b: str) -> str:
    d = lambda x, y: f"list_inner_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"({d(a, b)} / nullif(sqrt({d(a, a)}) * sqrt({d(b, b)}), 0))"


# --- parsing

_ORDER_LINES = "(SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || l_partkey::VARCHAR || l_returnflag || l_linestatus, '' ORDER BY l_linenumber, concat_ws(' | ', l_partkey::VARCHAR, l_returnflag, l_linestatus)) AS cells, count(*) AS n FROM lineitem GROUP BY l_orderkey)"


def parse_blocks() -> str:
    title = "'Order ' || o_orderkey::VARCHAR"
    a = (
        f"(SELECT o_orderkey AS doc_id, unnest([{{'n': 0, 'type': 'heading', 'text': {title}}}, "
        f"{{'n': 1, 'type': 'paragraph', 'text': 'Status ' || o_orderstatus || ', priority ' || o_orderpriority || '.'}}, "
        f"{{'n': 2, 'type': 'table', 'text': 'linepartflagstatus' || coalesce(cells, '')}}]) AS x, {title} AS trail FROM orders LEFT JOIN {_ORDER_LINES} ON l_orderkey = o_orderkey)"
    )
    return f"SELECT doc_id, x['n']::INT AS block_no, x['type'] AS type, x['text'] AS text, trail, '1' AS depths, {tok("x['text']")} AS tokens FROM {a}"


def structure_counts() -> str:
    line = "concat_ws(' | ', l_linenumber::VARCHAR, l_partkey::VARCHAR, l_returnflag, l_linestatus)"
    rows_ = f"(SELECT l_orderkey, string_agg('| ' || {line} || ' |', {NL} ORDER BY l_linenumber, {line}) AS r FROM lineitem GROUP BY l_orderkey)"
    text = (
        f"'# Order ' || o_orderkey::VARCHAR || {NL} || {NL} || 'Status `' || o_orderstatus || '`, priority **' || o_orderpriority || '**.' || {NL} || {NL} || "
        f"'| line | part | flag | status |' || {NL} || '| --- | --- | --- | --- |' || {NL} || coalesce(r, '') || {NL}"
    )
    return (
        f"SELECT o_orderkey AS doc_id, {n16(text)}::INT AS length, 1 AS headings, 1 AS h1, 0 AS h2, 1 AS paragraphs, length('Status , priority .') + length(o_orderpriority) AS avg_paragraph_length, 0 AS code_blocks, 0 AS lists, 1 AS tables, "
        f"0 AS links, 0 AS images, 0 AS blockquotes, 0 AS rules, 3 AS max_depth, false AS has_front_matter, false AS has_toc, 'heading=1|paragraph=1|table=1' AS top_types FROM orders LEFT JOIN {rows_} ON l_orderkey = o_orderkey"
    )


def analyze_conversations() -> str:
    zero = ", ".join(f"0 AS {c}" for c in "h3 h4 h5 h6 code_blocks lists tables links images blockquotes rules".split())
    return (
        f"SELECT conv_id AS doc_id, any_value({n16('t.text')})::INT AS length, count(*) + 1 AS headings, 1 AS h1, count(*) AS h2, count(*) AS paragraphs, {half_up(f'avg({n16("c.text")})')} AS avg_paragraph_length, "
        f"{zero}, 1 AS max_depth, false AS has_front_matter, false AS has_toc FROM conversations c JOIN {TALK_TEXT} t ON t.doc_id = c.conv_id GROUP BY conv_id"
    )


_RICH = f"(SELECT conv_id AS doc_id, turn, role, text, turn % 4 AS k, string_split(text, {NL}) AS l FROM conversations)"


def parse_rich() -> str:
    title = "'Conversation ' || doc_id::VARCHAR"
    own = (
        f"CASE k WHEN 0 THEN list_transform(l, lambda x: {{'type': 'list-item', 'text': x, 'lang': NULL::VARCHAR}}) WHEN 1 THEN [{{'type': 'blockquote', 'text': text, 'lang': NULL::VARCHAR}}] "
        "WHEN 2 THEN [{'type': 'code', 'text': text, 'lang': 'py'}] ELSE [{'type': 'paragraph', 'text': 'Turn ' || turn::VARCHAR || ' of code and a link or .', 'lang': NULL::VARCHAR}] END"
    )
    a = f"SELECT doc_id, turn, {title} || '|' || role AS trail, list_concat([{{'type': 'heading', 'text': role, 'lang': NULL::VARCHAR}}], {own}) AS x FROM {_RICH}"
    a = f"SELECT doc_id, turn, trail, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM ({a})"
    ends = f"SELECT doc_id, -1 AS turn, {title} AS trail, 0 AS i, {{'type': 'heading', 'text': {title}, 'lang': NULL::VARCHAR}} AS x FROM (SELECT DISTINCT doc_id FROM {_RICH})"
    last = f"SELECT doc_id, max(turn) + 1, {title} || '|' || arg_max(role, turn), 0, {{'type': 'table', 'text': 'ab12', 'lang': NULL::VARCHAR}} FROM {_RICH} GROUP BY doc_id"
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY turn, i) - 1)::INT AS block_no, x['type'] AS type, x['text'] AS text, x['lang'] AS lang, trail, {tok("x['text']")} AS tokens FROM ({a} UNION ALL {ends} UNION ALL {last})"


def structure_rich() -> str:
    has = lambda *k: f"count(*) FILTER (k IN ({', '.join(map(str, k))}))"
    paragraphs = f"(coalesce(sum(len(l)) FILTER (k = 0), 0) + {has(1, 3)})"
    # a paragraph of a list item is a line, that of a quote has its lines; marked code is no text
    chars = f"(coalesce(sum(list_sum(list_transform(l, lambda x: {n16('x')}))) FILTER (k = 0), 0) + coalesce(sum({n16('text')}) FILTER (k = 1), 0) + coalesce(sum(length('Turn  of  and a link or .') + length(turn::VARCHAR)) FILTER (k = 3), 0))"
    types = f"list_filter([CASE WHEN {has(1)} > 0 THEN 'blockquote=' || {has(1)}::VARCHAR END, CASE WHEN {has(2)} > 0 THEN 'code=' || {has(2)}::VARCHAR END, 'heading=' || (count(*) + 1)::VARCHAR, CASE WHEN {has(0)} > 0 THEN 'list=' || {has(0)}::VARCHAR END, CASE WHEN {has(3)} > 0 THEN 'paragraph=' || {has(3)}::VARCHAR END, 'table=1', 'thematicBreak=1'], lambda x: x IS NOT NULL)"
    return (
        f"SELECT doc_id, count(*) + 1 AS headings, {paragraphs}::BIGINT AS paragraphs, CASE WHEN {paragraphs} > 0 THEN {half_up(f'{chars} / {paragraphs}::DOUBLE')} END AS avg_paragraph_length, {has(2)} AS code_blocks, {has(0)} AS lists, 1 AS tables, "
        f"{has(3)} AS links, {has(3)} AS images, {has(1)} AS blockquotes, 1 AS rules, 3 AS max_depth, false AS has_toc, array_to_string({types}, '|') AS top_types FROM {_RICH} GROUP BY doc_id"
    )


def old_ladder(most: int) -> str:
    """Paragraphs, then of what is too large sentences, then words."""
    big = lambda c: f"greatest(1, floor(length({c}) / 3.8::DOUBLE)::INT) > {most}"
    a = f"(SELECT doc_id, []::BIGINT[] AS o, text AS t, true AS big FROM {DOCS})"
    paras = not_blank(f"string_split(regexp_replace({trim('t')}, '\\n{{2,}}', {MARK}, 'g'), {MARK})")
    for parts in (paras, old_sentences("t")):
        p = f"(SELECT *, CASE WHEN big THEN {parts} END AS p FROM {a})"
        a = (
            f"(SELECT doc_id, list_append(o, 0) AS o, t, big AND {big('t')} AS big FROM {p} WHERE p IS NULL OR len(p) = 1 "
            f"UNION ALL SELECT doc_id, list_append(o, i), x, {big('x')} FROM (SELECT doc_id, o, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM {p} WHERE len(p) <> 1))"
        )
    words = f"(SELECT doc_id, o, CASE WHEN big THEN f['done'] ELSE [t] END AS p FROM (SELECT *, CASE WHEN big THEN {additive_parts('t', most)} END AS f FROM {a}))"
    flat = f"(SELECT doc_id, list_append(o, generate_subscripts(p, 1)) AS o, unnest(p) AS part FROM {words})"
    return f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS part_no, part FROM {flat}"


def front_matter() -> str:
    return "SELECT doc_id, 'Doc ' || doc_id::VARCHAR AS title, 'a, b' AS tags, length(text) AS body_length FROM documents"


def _boxes() -> str:
    filled = "least(40, floor(tokens * 40 / 128::DOUBLE))::INT"
    preview = f"array_to_string(list_transform(string_split(content, {NL})[1:5], lambda x: '| ' || CASE WHEN length(x) > 76 THEN left(x, 76) || '...' ELSE x END), {NL})"
    return (
        f"SELECT doc_id, chunk_no, '+ chunk ' || (chunk_no + 1)::VARCHAR || '  ' || tokens::VARCHAR || ' tokens  [' || repeat('#', {filled}) || repeat('.', 40 - {filled}) || ']' || {NL} || {preview} || {NL} || '+' || repeat('-', 79) AS report FROM {packed(SMALL)}"
    )


def _listing() -> str:
    short = lambda c, n: f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END"
    flat = lambda c: f"replace({c}, {NL}, ' ')"
    return (
        f"SELECT doc_id, chunk_no, 'chunk ' || (chunk_no + 1)::VARCHAR || ': ' || tokens::VARCHAR || ' tokens' || {NL} || '  path: ' || array_to_string(header_path, ' > ') || {NL} || '  types: ' || array_to_string(node_types, ', ') || {NL} || "
        f"'  text: ' || {short(flat('content'), 200)} || {NL} || '  embed: ' || {short(flat('embed_text'), 150)} AS report FROM {embedded('conditional')}"
    )


def talk_pipeline() -> str:
    """The whole run over the conversations: split, pack, overlap, normalise, metadata, text to embed."""
    cut = ladder(f"(SELECT doc_id * 100000 + block_no AS doc_id, text FROM {TALK_BLOCKS})", SMALL.max_tokens)
    parts = f"(SELECT b.doc_id, list({{'text': c.text, 'type': b.type, 'trail': b.trail, 'depths': b.depths}} ORDER BY b.block_no, c.block_no) AS b FROM ({cut}) c JOIN {TALK_BLOCKS} b ON c.doc_id = b.doc_id * 100000 + b.block_no GROUP BY b.doc_id)"
    longer = f"({overlapped(f'({pack(parts, SMALL)})', SMALL)})"
    plain = dedented(spaces(longer, "doc_id, chunk_no", collapse_blank(strip_ends("content"))), "doc_id, chunk_no", "text")
    chunks = f"(SELECT c.* EXCLUDE (content), coalesce({trim('x.text')}, '') AS content FROM {longer} c LEFT JOIN {plain} x ON c.doc_id = x.doc_id AND c.chunk_no = x.chunk_no)"
    return embedded("conditional", SMALL, described(chunks, "Conversation "))


_linked = lambda parent: f"(SELECT *, {parent} || '::ch' || chunk_no::VARCHAR AS id, {parent} AS parent_id, lag({parent} || '::ch' || chunk_no::VARCHAR) OVER w AS prev_id, lead({parent} || '::ch' || chunk_no::VARCHAR) OVER w AS next_id FROM {packed(SMALL)} WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no))"
_chunk = "doc_id, chunk_no, content, tokens, node_count"
_with_tokens = lambda sql: f"SELECT *, {tok('text')} AS tokens FROM ({sql})"
_part = f"SELECT p_partkey, {clean(PART_HEADING)} AS heading FROM part"
_part_blocks = "(SELECT p_partkey % 20 AS doc_id, (row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) - 1)::INT AS block_no, p_name AS text, CASE WHEN p_size % 8 < 6 THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN p_size % 8 < 6 THEN p_size % 8 + 1 END AS depth FROM part)"
_offsets = f"coalesce(sum({n16('content')}) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"
_features = "doc_id, section_no, heading, is_organizational, is_reference, is_procedural, is_question, is_definition, has_sequence, code_ratio, list_ratio, questions, definitions, imperatives, paragraph_tokens, has_action, has_parameters, has_returns, has_sequence_items"
_stats = "doc_id, total_chunks, total_tokens, min_tokens, max_tokens, avg_tokens, median_tokens, source_length, expected_chunks, actual_chunks, efficiency_ratio, deviation, compression_ratio, quality_flag"
_src = "Title: ' || source || chr(10) || 'Section: Part ' || (doc_id % 3)::VARCHAR || chr(10) || chr(10) || text"
_json = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"

SQL: dict[str, str] = {
    "source_metrics": f"SELECT doc_id, n::INT AS length, {tok_of('n')} AS tokens, CASE WHEN {tok_of('n')} <= 512 THEN 1 ELSE greatest(1, ceil({tok_of('n')} / 400.0::DOUBLE)::INT) END AS estimated_chunks FROM (SELECT doc_id, {n16("coalesce(text, '')")} AS n FROM documents)",
    "token_heuristics": f"SELECT doc_id, {tok('text')} AS floor_tokens, {tok1('text')} AS one_tokens, length(text) // 4 AS quarter_tokens, greatest(1, length(text) // 4) AS quarter_one, ceil({n16('text')} / 3.8::DOUBLE)::INT AS ceil_tokens FROM documents",
    "sentence_split": _with_tokens(rows("documents", sentences("text"))),
    "line_split": _with_tokens(rows("documents", lines("text"))),
    "paragraph_split": _with_tokens(rows("documents", paragraphs(f"replace(text, {NL}, {NL} || {NL})"))),
    "hard_cut_words": _with_tokens(rows(f"(SELECT doc_id, {trim('text')} AS t, {hard_cut(trim('text'), 128)} AS f FROM {DOCS})", cut_parts("f", "t"))),
    "split_ladder": _with_tokens(ladder(DOCS, 128)),
    "pack_chunks": f"SELECT {_chunk} FROM {packed(DEFAULTS)}",
    "pack_single": f"SELECT {_chunk} FROM {packed(ChunkOptions(max_tokens=1_000_000))}",
    "pack_tail_merge": f"SELECT {_chunk} FROM {packed(SMALL)}",
    "pack_markdown": f"SELECT {_chunk}, {joined('types')} AS types, {joined('trail')} AS trail, {joined('depths')} AS depths FROM {TALK_CHUNKS}",
    "overlap_lag": f"SELECT doc_id, chunk_no, content, tokens FROM ({overlapped(packed(SMALL), SMALL)})",
    "normalize_lines": f"SELECT doc_id, {strip_ends(SEEDED)} AS text FROM documents",
    "collapse_blank": f"SELECT doc_id, {collapse_blank(SEEDED)} AS text FROM documents",
    "normalize_text": f"SELECT doc_id, coalesce({trim('x.text')}, '') AS text FROM documents LEFT JOIN {dedented(spaces('documents', 'doc_id', collapse_blank(strip_ends(SEEDED))), 'doc_id', 'text')} x USING (doc_id)",
    "dedent_fenced": f"SELECT conv_id, turn, a.text AS inner_text, b.text AS dedented FROM {spaces('conversations', 'conv_id, turn', FENCED)} a JOIN {dedented('conversations', 'conv_id, turn', FENCED)} b USING (conv_id, turn)",
    "heading_trail": f"SELECT doc_id, block_no, text, {joined('trail', ' > ')} AS trail, {joined('depths')} AS depths FROM ({trails(_part_blocks)})",
    "place_trail": f"SELECT doc_id, block_no, type, text, {joined('trail', ' > ')} AS trail, {joined('depths')} AS depths FROM ({trails(f'({PLACE_SQL})')})",
    "chunk_ids_links": f"SELECT doc_id, chunk_no, id, parent_id, prev_id, next_id FROM {_linked("'doc:' || doc_id::VARCHAR || '.md'")}",
    "source_offsets": f"SELECT doc_id, chunk_no, {_offsets} AS char_start, {_offsets} + {n16('content')} AS char_end, sum({n16('content')}) OVER (PARTITION BY doc_id)::BIGINT AS total_chars FROM {packed(SMALL)}",
    "heading_clean": _part,
    "slug_base": f"SELECT p_partkey, {slug('heading')} AS slug FROM ({_part})",
    "slug_dedup": f"WITH p AS (SELECT p_partkey % 20 AS doc_id, p_partkey AS chunk_no, [{PART_HEADING}] AS header_path FROM part) SELECT p.doc_id, chunk_no, s AS slug FROM p JOIN ({slugs('p')}) x ON p.doc_id = x.doc_id AND x.h = {clean('header_path[1]')}",
    "node_types_sniff": f"SELECT doc_id, array_to_string({sniffed('text')}, '|') AS types FROM documents",
    "chunk_metadata": f"SELECT doc_id, chunk_no, id, parent_id, prev_id, next_id, char_start, char_end, total_chars, {', '.join(f'{joined(c)} AS {c}' for c in ('header_path', 'header_depths', 'header_slugs', 'node_types'))}, header_breadcrumb, section_title, section_slug, estimated_tokens, file_title, original_text, tokens FROM {described()}",
    **{f"embed_{m}": f"SELECT doc_id, chunk_no, embed_text FROM {embedded(m)}" for m in ("none", "always", "conditional")},
    "breadcrumb_truncate": f"SELECT doc_id, {truncated('text')} AS crumb FROM documents",
    "char_offsets": f"WITH c AS (SELECT p.doc_id, chunk_no, content, position(content IN d.text) AS e, position(left(content, 100) IN d.text) AS near FROM {packed(SMALL)} p LEFT JOIN documents d ON p.doc_id = d.doc_id), s AS (SELECT *, CASE WHEN e > 0 THEN e - 1 WHEN near > 0 THEN near - 1 ELSE -1 END AS char_start FROM c) SELECT doc_id, chunk_no, char_start, CASE WHEN char_start >= 0 THEN char_start + length(content) ELSE -1 END AS char_end, CASE WHEN e > 0 THEN 1.0::DOUBLE WHEN near > 0 THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM s",
    "content_sha": f"SELECT doc_id, sha256(text) AS sha, sha256('{_src}) AS titled_sha FROM documents",
    "guardrail_flags": f"SELECT doc_id, seeded, tokens, array_to_string(codes, '|') AS codes FROM {guarded()}",
    "guardrail_counts": f"SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM {guarded()}) GROUP BY code",
    "doc_stats": f"SELECT {_stats} FROM {stats(packed(SMALL), SMALL, 'documents')}",
    "token_distribution": f"SELECT doc_id, under_target, at_target, over_target FROM {stats(packed(SMALL), SMALL)}",
    "token_buckets": f"SELECT source, count(*) AS n_chunks, sum(tokens)::BIGINT AS total_tokens, {half_up('avg(tokens)')} AS avg_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens, count(*) FILTER (tokens < 200) AS small, count(*) FILTER (tokens >= 200 AND tokens < 400) AS medium, count(*) FILTER (tokens >= 400) AS large FROM {packed(DEFAULTS)} GROUP BY source",
    "type_histogram": f"SELECT type, count(*) AS n FROM (SELECT unnest(node_types) AS type FROM {described()}) GROUP BY type",
    "distinct_sections": f"SELECT doc_id, count(DISTINCT nullif(section_title, '')) AS n_sections FROM {described()} GROUP BY doc_id",
    "source_rollup": f"SELECT source, count(*) AS n_chunks, {half_up('avg(length(content))')} AS avg_length, min(length(content)) AS min_length, max(length(content)) AS max_length, bool_or(len(list_filter(string_split(content, {NL}), lambda x: starts_with({trim('x')}, '#'))) > 0) AS has_hierarchy, count(*) FILTER (prev_id IS NOT NULL OR next_id IS NOT NULL) AS linked FROM {_linked("'doc:' || doc_id::VARCHAR")} GROUP BY source",
    "pattern_features": f"SELECT {_features} FROM {classified()}",
    "pattern_class": f"SELECT doc_id, section_no, {', '.join(f'score_{p}' for p in P.PATTERNS[:-1])}, pattern FROM {classified()}",
    "merge_decisions": merges(),
    "topic_jaccard": f"SELECT conv_id, turn, other_turn, {jaccard('w', 'v')} AS similarity FROM (SELECT conv_id, turn, w, lead(turn) OVER p AS other_turn, lead(w) OVER p AS v FROM (SELECT conv_id, turn, {_words('text')} AS w FROM conversations) WINDOW p AS (PARTITION BY conv_id ORDER BY turn)) WHERE other_turn IS NOT NULL",
    "legacy_heading_split": rows(TALK_TEXT, split_at("text", r"^#{1,6}\s", "(?m)"), "part_no", "part"),
    "header_hierarchy": f"SELECT doc_id, chunk_no, CASE WHEN chunk_no = 0 THEN {NAME} ELSE {NAME} || ' > ' || role END AS hierarchy, CASE WHEN chunk_no = 0 THEN '# ' || {NAME} ELSE '# ' || {NAME} || '|## ' || role END AS header_path FROM (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS chunk_no, role FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, NULL FROM conversations)",
    "relationship_counts": "SELECT total, total AS linked, total AS with_hierarchy, total AS located FROM (SELECT count(*) + count(DISTINCT conv_id) AS total FROM conversations)",
    "legacy_paragraph_split": rows(TALK_TEXT, not_blank(f"string_split(regexp_replace({trim('text')}, '\\n{{2,}}', {MARK}, 'g'), {MARK})"), "part_no", "part"),
    "legacy_symbol_split": rows("documents", split_at(CODE, r"^\s*(?:def|class|function|export|const|let|var) ", "(?m)"), "part_no", "part"),
    "legacy_additive_cut": f"SELECT doc_id, (generate_subscripts(p, 1) - 1)::INT AS part_no, unnest(p) AS part FROM {additive('text', 128)}",
    "legacy_pack": old_pack(200),
    "legacy_overlap": old_overlap(),
    "legacy_quality": old_quality(),
    "legacy_sentences": rows(DOCS, old_sentences("text"), "part_no", "part"),
    "knn_cosine": f"SELECT vec_id, {cosine('embedding', 'list_transform(range(len(embedding)), lambda i: CASE WHEN i % 2 = 1 THEN 1.0 ELSE -0.5 END)')} AS score FROM embeddings ORDER BY score DESC NULLS LAST, vec_id LIMIT 5",
    "knn_many": f"SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cosine('v.embedding', 'q.embedding')}, 12) DESC, v.vec_id) AS rank FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q WHERE {cosine('v.embedding', 'q.embedding')} IS NOT NULL) WHERE rank <= 5",
    "parse_blocks": parse_blocks(),
    "parse_rich": parse_rich(),
    "structure_counts": structure_counts(),
    "structure_rich": structure_rich(),
    "analyze_conversations": analyze_conversations(),
    "legacy_ladder": old_ladder(400),
    "pipeline_chunks": f"WITH run AS (SELECT *, original_text AS c, count(*) OVER (PARTITION BY doc_id) = 1 AS single FROM {talk_pipeline()}) SELECT doc_id, chunk_no, id, prev_id, next_id, content, embed_text, tokens, header_breadcrumb, section_slug, array_to_string({codes(SMALL)}, '|') AS codes FROM run",
    "pipeline_stats": f"SELECT * FROM {stats(talk_pipeline(), SMALL, '(SELECT conv_id AS doc_id FROM conversations)', 'original_text')}",
    "report_boxes": _boxes(),
    "report_listing": _listing(),
    "chunk_json": f"SELECT doc_id, chunk_no, '{{\"id\":' || {_json('id')} || ',\"prev_id\":' || {_json('prev_id')} || ',\"next_id\":' || {_json('next_id')} || ',\"tokens\":' || tokens::VARCHAR || '}}' AS json FROM {_linked("'doc:' || doc_id::VARCHAR")}",
    "front_matter": front_matter(),
}
