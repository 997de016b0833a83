"""One query for each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import headings as H
from ..functions import text as X
from ..functions import tokens as K
from ..operators import analyze, embed, guardrails, legacy, metadata, normalize, overlap, pack, parse, patterns, report, source, split, stats, trail, vector
from ..sources import files
from . import pipeline
from . import synthesis as Y
from .options import DEFAULTS, ChunkOptions

#: Smaller bounds, under which most documents have several chunks.
SMALL = ChunkOptions(min_tokens=40, max_tokens=128, target_tokens=100, overlap_sentences=1)
Query = Callable[[SparkSession, str], DataFrame]
_no = lambda c: F.lit(None).cast(c)


def _docs(s: SparkSession, d: str) -> DataFrame:
    return Y.spread(Y.table(s, d, "documents").select("doc_id", "text", "source"), "doc_id")


def packed(s: SparkSession, d: str, o: ChunkOptions = DEFAULTS) -> DataFrame:
    return pack.pack_sentences(_docs(s, d), "text", o)


def conversation_chunks(s: SparkSession, d: str, o: ChunkOptions = SMALL) -> DataFrame:
    """Chunks of the conversations, whose blocks come from the table, not from the parser."""
    b = trail.heading_trail(Y.conversation_blocks(Y.table(s, d, "conversations")))
    rows = pack.pack_rows(b, o)
    return rows.withColumn("title", F.concat(F.lit("Talk "), F.col("doc_id").cast("string")))


def described(s: SparkSession, d: str, o: ChunkOptions = SMALL) -> DataFrame:
    return metadata.attach_metadata(conversation_chunks(s, d, o))


def _join(c: str, sep: str = "|") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)


# --- sources, tokens


def source_metrics(s, d):
    return source.source_metrics(_docs(s, d)).select("doc_id", "length", "tokens", "estimated_chunks")


def token_heuristics(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", K.heuristic(t).alias("floor_tokens"), K.at_least_one(t).alias("one_tokens"), K.quarter(t).alias("quarter_tokens"), K.quarter(t, 1).alias("quarter_one"), K.estimated(X.length(t)).alias("ceil_tokens"))


def _parts(f: Callable[[Column], Column], seed: Callable[[Column], Column] = lambda c: c) -> Query:
    def query(s, d):
        rows = _docs(s, d).select("doc_id", F.posexplode(f(seed(F.col("text")))).alias("block_no", "text"))
        return rows.withColumn("tokens", K.heuristic(F.col("text")))

    return query


def hard_cut_words(s, d):
    rows = _docs(s, d).select("doc_id", F.posexplode(split.hard_cut(X.trim(F.col("text")), SMALL.max_tokens)).alias("block_no", "text"))
    return rows.withColumn("tokens", K.heuristic(F.col("text")))


def split_ladder(s, d):
    rows = split.split_blocks(_docs(s, d), SMALL.max_tokens)
    return rows.withColumn("tokens", K.heuristic(F.col("text")))


# --- pack, overlap, normalise


def _pack(o: ChunkOptions) -> Query:
    return lambda s, d: packed(s, d, o).select("doc_id", "chunk_no", "content", "tokens", "node_count")


def pack_markdown(s, d):
    return conversation_chunks(s, d).select("doc_id", "chunk_no", "content", "tokens", "node_count", _join("types"), _join("trail"), _join("depths"))


def overlap_lag(s, d):
    return overlap.add_overlap(packed(s, d, SMALL), SMALL).select("doc_id", "chunk_no", "content", "tokens")


def seeded(c: Column) -> Column:
    """The text with tabs, trailing and repeated blanks, indents and blank lines put in."""
    return F.concat(F.lit("  "), F.replace(F.replace(c, F.lit(". "), F.lit(". \t ")), F.lit("\n"), F.lit(" \t\n \n\n\n   ")), F.lit(" \n"))


def normalize_lines(s, d):
    return _docs(s, d).select("doc_id", normalize.strip_line_ends(seeded(F.col("text"))).alias("text"))


def collapse_blank(s, d):
    return _docs(s, d).select("doc_id", normalize.collapse_blank_lines(seeded(F.col("text"))).alias("text"))


def normalize_text(s, d):
    return _docs(s, d).select("doc_id", normalize.normalize(seeded(F.col("text"))).alias("text"))


def _fenced(c: Column) -> Column:
    """Three indented lines of code, fenced, between indented copies of the text."""
    return F.concat(F.lit("    "), F.replace(c, F.lit("\n"), F.lit("\n  ")), F.lit("\n  ```py\n    x  =  1\n\n      y\n  ```\n   end  of   it"))


def dedent_fenced(s, d):
    c = Y.table(s, d, "conversations")
    inner = normalize.collapse_inner_spaces(_fenced(F.col("text")))
    return c.select("conv_id", "turn", inner.alias("inner_text"), normalize.dedent(_fenced(F.col("text"))).alias("dedented"))


# --- trails, metadata


def heading_trail(s, d):
    p = Y.table(s, d, "part")
    w = Window.partitionBy("doc_id").orderBy("p_partkey")
    b = p.select((F.col("p_partkey") % 20).alias("doc_id"), "p_partkey", F.col("p_name").alias("text"), (F.col("p_size") % 8).alias("k"))
    b = b.withColumn("block_no", F.row_number().over(w) - 1).withColumn("type", F.when(F.col("k") < 6, "heading").otherwise("paragraph")).withColumn("depth", F.when(F.col("k") < 6, F.col("k") + 1))
    return trail.heading_trail(b).select("doc_id", "block_no", "text", _join("trail", " > "), _join("depths"))


def place_trail(s, d):
    b = Y.place_blocks(Y.table(s, d, "region"), Y.table(s, d, "nation"), Y.table(s, d, "customer"))
    return trail.heading_trail(b).select("doc_id", "block_no", "type", "text", _join("trail", " > "), _join("depths"))


def chunk_ids_links(s, d):
    rows = metadata.links(packed(s, d, SMALL), F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit(".md")))
    return rows.select("doc_id", "chunk_no", "id", "parent_id", "prev_id", "next_id")


def source_offsets(s, d):
    return metadata.offsets(packed(s, d, SMALL)).select("doc_id", "chunk_no", "char_start", "char_end", "total_chars")


def _part_heading() -> Column:
    k = F.col("p_size") % 6
    name = F.col("p_name")
    marked = (
        F.when(k == 0, F.concat(F.lit("## **"), name, F.lit("**")))
        .when(k == 1, F.concat(F.lit("# ["), name, F.lit("](http://x.example/a)!")))
        .when(k == 2, F.concat(F.lit("### `"), name, F.lit("` (Beta)")))
        .when(k == 3, F.concat(F.lit("*"), name, F.lit("*")))
        .when(k == 4, F.concat(F.lit("#### ~~"), name, F.lit("~~ & more")))
        .otherwise(F.concat(F.lit(" "), F.upper(name), F.lit(" ")))
    )
    return marked


def heading_clean(s, d):
    return Y.table(s, d, "part").select("p_partkey", H.clean(_part_heading()).alias("heading"))


def slug_base(s, d):
    return Y.table(s, d, "part").select("p_partkey", H.slug_base(H.clean(_part_heading())).alias("slug"))


def slug_dedup(s, d):
    p = Y.table(s, d, "part").select((F.col("p_partkey") % 20).alias("doc_id"), F.col("p_partkey").alias("chunk_no"), F.array(_part_heading()).alias("header_path"))
    return metadata.with_slugs(p).select("doc_id", "chunk_no", F.get("header_slugs", F.lit(0)).alias("slug"))


def node_types_sniff(s, d):
    return _docs(s, d).select("doc_id", F.array_join(H.sniffed_types(F.col("text")), "|").alias("types"))


def chunk_metadata(s, d):
    return described(s, d).select(
        "doc_id", "chunk_no", "id", "parent_id", "prev_id", "next_id", "char_start", "char_end", "total_chars", _join("header_path"), _join("header_depths"), _join("header_slugs"), _join("node_types"),
        "header_breadcrumb", "section_title", "section_slug", "estimated_tokens", "file_title", "original_text", "tokens",
    )


def _embed(mode: str) -> Query:
    return lambda s, d: embed.add_embed_text(described(s, d), SMALL.with_(breadcrumb_mode=mode)).select("doc_id", "chunk_no", "embed_text")


def breadcrumb_truncate(s, d):
    return _docs(s, d).select("doc_id", embed.truncated(F.col("text")).alias("crumb"))


def char_offsets(s, d):
    chunks = packed(s, d, SMALL).groupBy("doc_id").agg(F.collect_list(F.struct("chunk_no", "content")).alias("c"))
    rows = files.with_parent(chunks, _docs(s, d))
    at = metadata.all_char_offsets(F.col("parent_text"), F.transform("c", lambda x: x["content"]))
    rows = rows.select("doc_id", F.explode(F.arrays_zip(F.transform("c", lambda x: x["chunk_no"]).alias("n"), at.alias("at"))).alias("x"))
    return rows.select("doc_id", F.col("x.n").alias("chunk_no"), "x.at.char_start", "x.at.char_end", "x.at.confidence")


def content_sha(s, d):
    t = legacy.title_prefixed(F.col("source"), F.concat(F.lit("Part "), (F.col("doc_id") % 3).cast("string")), F.col("text"))
    return _docs(s, d).select("doc_id", F.sha2(F.col("text"), 256).alias("sha"), F.sha2(t, 256).alias("titled_sha"))


# --- guardrails, statistics


def _guard_seed() -> Column:
    """A text with one fault each, by the document's number."""
    k = F.pmod("doc_id", F.lit(12))
    t = F.col("text")
    lit = {0: "  \n ", 1: "###  ", 2: "-----", 3: "``````", 4: " ** _ - ", 5: "| |\n|", 6: ">  >", 7: "## Title\n \n"}
    out = F.when(k == 8, F.concat(F.lit("# Head\n- item `x`\n> "), t)).when(k == 9, F.concat(F.lit("```\ncode\n```\n"), t))
    for i, v in lit.items():
        out = out.when(k == i, F.lit(v))
    return out.otherwise(F.concat(F.lit("```\n"), t, F.lit("\n```")))


def _with_faults(s: SparkSession, d: str) -> DataFrame:
    """Each document's whole text, and for each document a further row with a fault put in."""
    docs = _docs(s, d)
    part = F.floor(F.col("doc_id") / 3)
    seeds = docs.select("doc_id", F.lit(True).alias("seeded"), _guard_seed().alias("original_text"), (-F.col("doc_id") - 1).alias("part"))
    return docs.select("doc_id", F.lit(False).alias("seeded"), F.col("text").alias("original_text"), part.alias("part")).unionAll(seeds)


def guarded(s, d):
    rows = _with_faults(s, d).withColumn("tokens", K.heuristic(F.col("original_text")))
    return guardrails.validate(rows, DEFAULTS, key="part")


def guardrail_flags(s, d):
    return guarded(s, d).select("doc_id", "seeded", "tokens", F.array_join(F.transform("violations", lambda v: v["code"]), "|").alias("codes"))


def guardrail_counts(s, d):
    return guarded(s, d).select(F.explode("violations").alias("v")).groupBy(F.col("v.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def doc_stats(s, d):
    rows = packed(s, d, SMALL).withColumnRenamed("content", "original_text")
    return stats.compute_stats(rows, SMALL, documents=_docs(s, d)).drop("under_target", "at_target", "over_target")


def token_distribution(s, d):
    rows = packed(s, d, SMALL).withColumnRenamed("content", "original_text")
    return stats.compute_stats(rows, SMALL).select("doc_id", "under_target", "at_target", "over_target")


def token_buckets(s, d):
    return stats.token_buckets(packed(s, d, DEFAULTS), "source")


def type_histogram(s, d):
    return stats.type_histogram(described(s, d))


def distinct_sections(s, d):
    return described(s, d).groupBy("doc_id").agg(stats.distinct_sections().alias("n_sections"))


def source_rollup(s, d):
    rows = metadata.links(packed(s, d, SMALL), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return stats.source_rollup(rows.withColumn("header_path", metadata.header_path(F.col("trail"), F.col("content"))))


# --- patterns


def conversation_sections(s, d):
    """Sections of the conversations, words put in that the patterns look for."""
    b = Y.with_tokens(Y.conversation_blocks(Y.table(s, d, "conversations")))
    k = F.pmod(F.col("doc_id") * 7 + F.col("block_no"), F.lit(9))
    extra = F.element_at(F.array(*(F.lit(x) for x in _PHRASES)), (k + 1).cast("int"))
    heads = F.element_at(F.array(*(F.lit(x) for x in _HEADS)), (k + 1).cast("int"))
    b = b.withColumn("text", F.when(F.col("type") == "heading", F.concat("text", heads)).otherwise(F.concat(extra, F.col("text"))))
    b = b.withColumn("type", F.when((F.col("type") == "paragraph") & k.isin(2, 5), "code").when((F.col("type") == "paragraph") & k.isin(1, 7), "list-item").otherwise(F.col("type")))
    return patterns.sections(Y.with_tokens(b.select("doc_id", "block_no", "type", "text", "depth")))


_PHRASES = ["", "1. Click it, run it and install it. ", "parameters: a. returns: b. ", "This is a thing and means it. ", "It refers to the rest. Remove and add and set. ", "output: x ", "Is it? ", "2. Start now. ", "defined as that "]
_HEADS = ["", " setup", " API reference", " definition", " how to guide", " class and method", " what is it?", " step 2", " part 3 install"]


def classified(s, d):
    return patterns.classify(conversation_sections(s, d))


def pattern_features(s, d):
    names = [*patterns.heading_features(F.lit("")), *patterns.content_features(F.col("content")), *patterns.structure_features(F.col("content"))]
    return classified(s, d).select("doc_id", "section_no", "heading", *names)


def pattern_class(s, d):
    return classified(s, d).select("doc_id", "section_no", *(f"score_{p}" for p in patterns.PATTERNS[:-1]), "pattern")


def merge_decisions(s, d):
    return patterns.merge_decisions(classified(s, d))


def topic_jaccard(s, d):
    """Each turn of a conversation against the next."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^A-Za-z0-9_]+"), lambda x: F.length(x) > 3))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = Y.table(s, d, "conversations").select("conv_id", "turn", words.alias("w"))
    rows = rows.withColumn("other_turn", F.lead("turn").over(w)).withColumn("v", F.lead("w").over(w)).where("other_turn is not null")
    return rows.select("conv_id", "turn", "other_turn", patterns.jaccard(F.col("w"), F.col("v")).alias("similarity"))


# --- older operators


def legacy_heading_split(s, d):
    m = Y.conversation_markdown(Y.table(s, d, "conversations"))
    return m.select("doc_id", F.posexplode(legacy.heading_parts(F.col("text"))).alias("part_no", "part"))


def _located(s: SparkSession, d: str) -> DataFrame:
    """Parts of the conversations at their headings, with links, place and header hierarchy."""
    m = Y.conversation_markdown(Y.table(s, d, "conversations")).withColumnRenamed("text", "full_text")
    rows = m.select("doc_id", "full_text", F.posexplode(legacy.heading_parts(F.col("full_text"))).alias("chunk_no", "part"))
    _, _, sure = metadata.char_offsets(F.col("full_text"), X.trim(F.col("part")))
    rows = rows.select("doc_id", "chunk_no", "part", metadata.header_hierarchy(F.col("full_text"), F.col("part")).alias("h"), sure.alias("confidence"))
    return metadata.links(rows.select("doc_id", "chunk_no", "part", "h.*", "confidence"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))


def header_hierarchy(s, d):
    return _located(s, d).select("doc_id", "chunk_no", "hierarchy", _join("header_path"))


def relationship_counts(s, d):
    return stats.relationship_counts(_located(s, d))


VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def token_bpe(s, d, vocabulary: str = VOCABULARY):
    """Exact counts by a public byte-pair vocabulary, a parameter."""
    return _docs(s, d).select("doc_id", K.bpe(F.col("text"), vocabulary).alias("tokens"))


def legacy_paragraph_split(s, d):
    m = Y.conversation_markdown(Y.table(s, d, "conversations"))
    return m.select("doc_id", F.posexplode(legacy.paragraph_parts(F.col("text"))).alias("part_no", "part"))


def legacy_symbol_split(s, d):
    code = F.concat(F.lit("x = 1\nfunction f() {\n}\n  const y = "), F.replace("text", F.lit("\n"), F.lit("\nlet z = ")))
    return _docs(s, d).select("doc_id", F.posexplode(legacy.symbol_parts(code)).alias("part_no", "part"))


def legacy_additive_cut(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(legacy.additive_cut(X.trim(F.col("text")), 128)).alias("part_no", "part"))


def legacy_pack(s, d):
    p = _docs(s, d).select("doc_id", X.lines(F.col("text")).alias("pieces"))
    return legacy.pack_pieces(p, "pieces", 200)


def legacy_overlap(s, d):
    p = packed(s, d, SMALL).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "content"))), lambda x: x["content"]).alias("c"))
    return p.select("doc_id", F.posexplode(legacy.cumulative_overlap(F.col("c"), 1)).alias("chunk_no", "content"))


def legacy_quality(s, d):
    t = F.col("original_text")
    return _with_faults(s, d).select("doc_id", "seeded", legacy.low_quality(t).alias("low"), legacy.useless(t).alias("useless"), legacy.trivial(t).alias("trivial"))


def legacy_sentences(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.posexplode(legacy.sentence_parts(F.col("text"))).alias("part_no", "part"))


def legacy_ladder(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.posexplode(legacy.ladder_parts(F.col("text"), "plain", 400)).alias("part_no", "part"))


def legacy_recursive(s, d):
    return _docs(s, d).where("text is not null").select("doc_id", F.posexplode(legacy.recursive_parts(F.col("text"))).alias("part_no", "part"))


# --- vectors, parsing, whole runs


def knn_cosine(s, d):
    v = Y.table(s, d, "embeddings")
    return vector.search(v, [1.0 if i % 2 else -0.5 for i in range(_dimension(v))], 5)


def _dimension(v: DataFrame) -> int:
    first = v.select(F.size("embedding")).first()
    return first[0] if first else 0


def knn_many(s, d):
    v = Y.table(s, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))  # the stated set of queries, against all
    return vector.search_many(v, q, 5).select("query_id", "id", "rank")


def _orders(s, d):
    return Y.order_markdown(Y.table(s, d, "orders"), Y.table(s, d, "lineitem"))


def parse_blocks(s, d):
    rows = parse.block_rows(parse.parsed(_orders(s, d).select("doc_id", "text")))
    return rows.select("doc_id", "block_no", "type", "text", _join("trail"), _join("depths"), "tokens")


def _top_types() -> Column:
    return F.array_join(F.transform(F.map_entries("node_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|").alias("top_types")


def structure_counts(s, d):
    a = analyze.analyze(_orders(s, d))
    return a.select("doc_id", "length", "headings", "h1", "h2", "paragraphs", "avg_paragraph_length", "code_blocks", "lists", "tables", "links", "images", "blockquotes", "rules", "max_depth", "has_front_matter", "has_toc", _top_types())


def analyze_conversations(s, d):
    return analyze.analyze(Y.conversation_markdown(Y.table(s, d, "conversations"))).drop("node_types")


def parse_rich(s, d):
    rows = parse.block_rows(parse.parsed(Y.rich_markdown(Y.table(s, d, "conversations")).select("doc_id", "text")))
    return rows.select("doc_id", "block_no", "type", "text", "lang", _join("trail"), "tokens")


def structure_rich(s, d):
    a = analyze.analyze(Y.rich_markdown(Y.table(s, d, "conversations")))
    return a.select("doc_id", "headings", "paragraphs", "avg_paragraph_length", "code_blocks", "lists", "tables", "links", "images", "blockquotes", "rules", "max_depth", "has_toc", _top_types())


def pipeline_chunks(s, d):
    m = Y.conversation_markdown(Y.table(s, d, "conversations"))
    c = pipeline.chunks(m, SMALL)
    return c.select("doc_id", "chunk_no", "id", "prev_id", "next_id", "content", "embed_text", "tokens", "header_breadcrumb", "section_slug", F.array_join(F.transform("violations", lambda v: v["code"]), "|").alias("codes"))


def pipeline_documents(s, d):
    c = pipeline.chunks(_docs(s, d).select("doc_id", F.col("source").alias("title"), "text"), DEFAULTS)
    return c.select("doc_id", "chunk_no", "id", "content", "tokens", "embed_text")


def pipeline_stats(s, d):
    return pipeline.full(Y.conversation_markdown(Y.table(s, d, "conversations")), SMALL)[1]


def report_boxes(s, d):
    return report.boxes(packed(s, d, SMALL), SMALL.max_tokens).select("doc_id", "chunk_no", "report")


def report_listing(s, d):
    return report.listing(embed.add_embed_text(described(s, d), SMALL)).select("doc_id", "chunk_no", "report")


def chunk_json(s, d):
    rows = metadata.links(packed(s, d, SMALL), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", "chunk_no", F.to_json(F.struct("id", "prev_id", "next_id", "tokens"), {"ignoreNullFields": "false"}).alias("json"))


def front_matter(s, d):
    t = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\ntags: a, b\n---\n"), F.col("text"))
    m = files.front_matter(t)
    return _docs(s, d).select("doc_id", F.element_at(m, "title").alias("title"), F.element_at(m, "tags").alias("tags"), F.length(files.body(t)).alias("body_length"))


QUERIES: dict[str, Query] = {
    "source_metrics": source_metrics,
    "token_heuristics": token_heuristics,
    "sentence_split": _parts(X.sentences),
    "line_split": _parts(X.lines),
    "paragraph_split": _parts(X.paragraphs, lambda c: F.replace(c, F.lit("\n"), F.lit("\n\n"))),
    "hard_cut_words": hard_cut_words,
    "split_ladder": split_ladder,
    "pack_chunks": _pack(DEFAULTS),
    "pack_single": _pack(ChunkOptions(max_tokens=1_000_000)),
    "pack_tail_merge": _pack(SMALL),
    "pack_markdown": pack_markdown,
    "overlap_lag": overlap_lag,
    "normalize_lines": normalize_lines,
    "collapse_blank": collapse_blank,
    "normalize_text": normalize_text,
    "dedent_fenced": dedent_fenced,
    "heading_trail": heading_trail,
    "place_trail": place_trail,
    "chunk_ids_links": chunk_ids_links,
    "source_offsets": source_offsets,
    "heading_clean": heading_clean,
    "slug_base": slug_base,
    "slug_dedup": slug_dedup,
    "node_types_sniff": node_types_sniff,
    "chunk_metadata": chunk_metadata,
    "embed_none": _embed("none"),
    "embed_always": _embed("always"),
    "embed_conditional": _embed("conditional"),
    "breadcrumb_truncate": breadcrumb_truncate,
    "char_offsets": char_offsets,
    "content_sha": content_sha,
    "guardrail_flags": guardrail_flags,
    "guardrail_counts": guardrail_counts,
    "doc_stats": doc_stats,
    "token_distribution": token_distribution,
    "token_buckets": token_buckets,
    "type_histogram": type_histogram,
    "distinct_sections": distinct_sections,
    "source_rollup": source_rollup,
    "pattern_features": pattern_features,
    "pattern_class": pattern_class,
    "merge_decisions": merge_decisions,
    "topic_jaccard": topic_jaccard,
    "legacy_heading_split": legacy_heading_split,
    "header_hierarchy": header_hierarchy,
    "relationship_counts": relationship_counts,
    "token_bpe": token_bpe,
    "legacy_paragraph_split": legacy_paragraph_split,
    "legacy_symbol_split": legacy_symbol_split,
    "legacy_additive_cut": legacy_additive_cut,
    "legacy_pack": legacy_pack,
    "legacy_overlap": legacy_overlap,
    "legacy_quality": legacy_quality,
    "legacy_sentences": legacy_sentences,
    "legacy_ladder": legacy_ladder,
    "legacy_recursive": legacy_recursive,
    "knn_cosine": knn_cosine,
    "knn_many": knn_many,
    "parse_blocks": parse_blocks,
    "parse_rich": parse_rich,
    "structure_counts": structure_counts,
    "structure_rich": structure_rich,
    "analyze_conversations": analyze_conversations,
    "pipeline_chunks": pipeline_chunks,
    "pipeline_documents": pipeline_documents,
    "pipeline_stats": pipeline_stats,
    "report_boxes": report_boxes,
    "report_listing": report_listing,
    "chunk_json": chunk_json,
    "front_matter": front_matter,
}
