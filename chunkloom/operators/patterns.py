"""Content patterns of sections, and whether neighbouring sections should be merged.

A section row has ``heading`` and ``content``: an array of structs with type, text and tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .overlap import document

ORGANIZING = ["setup", "install", "installation", "configure", "configuration", "getting started", "prerequisites", "requirements", "dependencies", "preparation", "initialization", "deployment"]
REFERENCE = ["api", "reference", "method", "function", "class", "interface", "property", "parameter", "argument", "return", "endpoint", "schema", "specification", "documentation"]
PROCEDURE = ["how to", "tutorial", "guide", "walkthrough", "instructions", "step", "example", "usage", "demonstration", "practice"]
VERBS = ["add", "click", "configure", "create", "delete", "execute", "install", "modify", "remove", "run", "set", "start", "stop", "update"]
ACTIONS = ["begin", "click", "download", "execute", "install", "run", "start"]
DEFINITIONS = [rf"\bis{X.WHITE}+(a|an|the){X.WHITE}+", rf"\bmeans{X.WHITE}+", rf"\brefers{X.WHITE}+to{X.WHITE}+", rf"\bdefined{X.WHITE}+as{X.WHITE}+"]
PATTERNS = ["organizational", "reference", "procedural", "conceptual", "faq", "glossary", "mixed"]


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def heading_features(heading: Column) -> dict[str, Column]:
    h = F.lower(heading)
    return {
        "is_organizational": _any(h, ORGANIZING),
        "is_reference": _any(h, REFERENCE),
        "is_procedural": _any(h, PROCEDURE),
        "is_question": F.contains(h, F.lit("?")) | F.startswith(h, F.lit("how ")) | F.startswith(h, F.lit("what ")),
        "is_definition": F.contains(h, F.lit("what is")) | F.endswith(h, F.lit("definition")),
        "has_sequence": h.rlike(rf"\b(step|part|phase){X.WHITE}*[0-9]+"),
    }


def content_features(content: Column, compat: bool = True) -> dict[str, Column]:
    """``compat`` counts no question ever, as the original rule splits the marks away before looking for them."""
    n = F.size(content)
    total = lambda f: F.aggregate(F.transform(content, f), F.lit(0), lambda a, x: a + x)
    low = lambda b: F.lower(b["text"])
    share = lambda kind: F.when(n > 0, F.size(F.filter(content, lambda b: b["type"] == kind)) / n).otherwise(0.0)
    paragraphs = F.filter(content, lambda b: b["type"] == "paragraph")
    tokens = F.aggregate(F.transform(paragraphs, lambda b: b["tokens"].cast("int")), F.lit(0), lambda a, x: a + x)
    return {
        "code_ratio": share("code"),
        "list_ratio": share("list-item"),
        "questions": F.lit(0) if compat else total(lambda b: F.regexp_count(b["text"], F.lit(r"\?"))),
        "definitions": total(lambda b: reduce(lambda x, y: x + y, (F.regexp_count(low(b), F.lit(p)) for p in DEFINITIONS))),
        "imperatives": total(lambda b: reduce(lambda x, y: x + y, (low(b).rlike(rf"\b{v}\b").cast("int") for v in VERBS))),
        "paragraph_tokens": F.when(F.size(paragraphs) > 0, tokens / F.size(paragraphs)).otherwise(0.0),
        "has_action": F.exists(content, lambda b: _any(low(b), ACTIONS)),
    }


def structure_features(content: Column) -> dict[str, Column]:
    text = F.lower(F.array_join(F.transform(content, lambda b: b["text"]), " "))
    return {
        "has_parameters": text.rlike("parameters?:|arguments?:|props?:"),
        "has_returns": text.rlike("returns?:|response:|output:"),
        "has_sequence_items": F.exists(content, lambda b: (b["type"] == "list-item") & X.trim(b["text"]).rlike(r"\A[0-9]+\.")),
    }


def _sum(*terms: tuple[Column, float]) -> Column:
    """Weights of the fulfilled terms, added in order and capped at one."""
    return F.least(F.lit(1.0), reduce(lambda a, t: a + F.when(t[0], F.lit(t[1])).otherwise(F.lit(0.0)), terms, F.lit(0.0)))


def scores() -> dict[str, Column]:
    """The six scores, from the feature columns."""
    c = F.col
    return {
        "organizational": _sum((c("is_organizational"), 0.4), (c("has_sequence"), 0.3), (c("has_action"), 0.2), (c("list_ratio") > 0.3, 0.1)),
        "reference": _sum((c("is_reference"), 0.4), (c("code_ratio") > 0.2, 0.3), (c("has_parameters"), 0.2), (c("has_returns"), 0.1), (c("paragraph_tokens") < 100, 0.1)),
        "procedural": _sum((c("is_procedural"), 0.4), (c("imperatives") > 2, 0.3), (c("list_ratio") > 0.4, 0.2), (c("has_sequence_items"), 0.1)),
        "conceptual": _sum((c("paragraph_tokens") > 150, 0.3), (c("imperatives") == 0, 0.2), (c("code_ratio") < 0.1, 0.2), (~c("has_action"), 0.2), (c("list_ratio") < 0.2, 0.1)),
        "faq": _sum((c("is_question"), 0.5), (c("questions") > 0, 0.3), (c("definitions") > 0, 0.2)),
        "glossary": _sum((c("is_definition"), 0.4), (c("definitions") > 0, 0.4), (c("paragraph_tokens") < 80, 0.2)),
    }


def classify(sections: DataFrame, compat: bool = True) -> DataFrame:
    """Adds features, scores (score_*) and the pattern: the greatest score, the earlier pattern on a tie."""
    content = F.col("content")
    rows = sections.withColumns({**heading_features(F.col("heading")), **content_features(content, compat), **structure_features(content)})
    rows = rows.withColumns({f"score_{k}": v for k, v in scores().items()})
    best = F.greatest(*(F.col(f"score_{k}") for k in PATTERNS[:-1]), F.lit(0.1))
    pattern = F.coalesce(*(F.when(F.col(f"score_{k}") == best, F.lit(k)) for k in PATTERNS[:-1]), F.lit("mixed"))
    return rows.withColumn("pattern", pattern)


def words(heading: Column, content: Column) -> Column:
    """Distinct words of over three characters; only ASCII letters, digits and _ make words."""
    text = F.lower(F.concat(heading, F.lit(" "), F.array_join(F.transform(content, lambda b: b["text"]), " ")))
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def merge_decisions(classified: DataFrame, key: str = "doc_id", order: str = "section_no") -> DataFrame:
    """For each section but a document's last: whether to merge it with the next, how sure, and why."""
    w = document(key, order)
    rows = classified.withColumn("_words", words(F.col("heading"), F.col("content")))
    rows = rows.withColumn("next_pattern", F.lead("pattern").over(w)).withColumn("_next", F.lead("_words").over(w)).where("next_pattern is not null")
    a, b, s = F.col("pattern"), F.col("next_pattern"), F.col("similarity")
    both = lambda p: (a == p) & (b == p)
    either = lambda p: (a == p) | (b == p)
    row = lambda merge, sure, why: F.struct(merge.alias("merge"), sure.alias("confidence"), why.alias("reason"))
    lit = lambda m, c, r: row(F.lit(m), F.lit(c), F.lit(r))
    decision = (
        F.when(both("organizational"), lit(True, 0.9, "both organizational"))
        .when(both("reference"), row(s > 0.7, s, F.concat(F.lit("reference, similarity "), X.half_up(s * 100).cast("string"), F.lit("%"))))
        .when(both("faq"), lit(True, 0.8, "both faq"))
        .when(both("glossary"), lit(True, 0.8, "both glossary"))
        .when(either("conceptual"), lit(False, 0.9, "conceptual stays apart"))
        .when(either("mixed"), lit(False, 0.5, "unclear pattern"))
        .otherwise(row(F.lit(False), F.lit(0.6), F.concat(F.lit("different: "), a, F.lit(" and "), b)))
    )
    return rows.withColumn("similarity", jaccard(F.col("_words"), F.col("_next"))).withColumn("_d", decision).select(
        key, order, "pattern", "next_pattern", "similarity", F.col("_d.merge").alias("merge"), F.col("_d.confidence").alias("confidence"), F.col("_d.reason").alias("reason")
    )


def sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Section rows of block rows (type, text, depth, tokens): each heading and the blocks up to the next.

    Blocks before the first heading make a section with an empty heading; ``parent`` is the last
    section of a smaller depth.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumn("section_no", F.sum((F.col("type") == "heading").cast("int")).over(w))
    kind = F.struct("block_no", "type", "text", "tokens")
    head = F.when(F.col("type") == "heading", F.col("text"))
    s = rows.groupBy(key, "section_no").agg(
        F.coalesce(F.max(head), F.lit("")).alias("heading"),
        F.coalesce(F.max(F.when(F.col("type") == "heading", F.col("depth"))), F.lit(0)).alias("level"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "heading", kind))).alias("content"),
        F.sum("tokens").alias("tokens"),
    )
    return s.withColumn("is_empty", F.size("content") == 0)
