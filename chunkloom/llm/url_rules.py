"""Operator 7: association rules that filter URLs.

A URL's tokens are its scheme, host, each label of the host, the path's segments (numbers as
#) with the extension apart, query keys and pairs, and whether there is a fragment. A labelled
URL is bad when its label says so. Spark's FP-growth mines token sets that are frequent among
the labelled URLs together with the mark BAD; a set of any number of tokens becomes a rule
when it occurs with BAD in at least ``SUPPORT`` of the labelled URLs and in ``FEWEST`` of them, and at least
``CONFIDENCE`` of the labelled URLs that hold it are bad. A rule that holds a shorter rule of no
less confidence is dropped.

Three steps before the mining leave out what could only give dropped rules, so that the many tokens
of one long URL don't make 2**tokens sets: a token that only bad URLs have is a rule alone, and a token
that all labelled URLs have adds nothing to a set, so neither is mined with others; tokens that occur
in the very same labelled URLs are mined as one, and the rules found are written out for each of
them. Tokens too rare for ``SUPPORT`` are left out as well. What remains still grows with the number of
token sets that are frequent, and differ in where they occur.

Rules are matched through an inverted index: each rule is filed under the one of its tokens
that is least frequent among the labelled URLs, so a URL is compared only with rules filed
under its tokens. The index joins on the token; Spark broadcasts it where its size allows. Every URL is
decided by its best rule (confidence, then support, then the rule's text).

Defined results: very long URLs have as many tokens as they have parts; a null or empty URL has no token and is not blocked; a page without label is
not mined from but decided like any other; with no labelled page, or none that is bad, there
are no rules; repeated rows are each decided; rows with a null page_id are decided too;
labels that contradict each other on a page count as bad; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

SUPPORT, CONFIDENCE, FEWEST = 0.004, 0.5, 3
BAD = "BAD"


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, sorted."""
    part = lambda pattern, k=1: F.regexp_extract(url, pattern, k)
    scheme, host = F.lower(part(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://")), F.lower(part(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"))
    path, query = part(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"), part(r"^[^?#]*\?([^#]*)")
    tag = lambda name, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(name + ":"), x))
    segments = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"\.[a-z0-9]+$", ""), "[0-9]+", "#"))
    pairs = F.split(F.lower(query), "&")
    all_ = F.concat(
        tag("scheme", F.array(scheme)),
        tag("host", F.array(host)),
        tag("label", F.split(host, r"\.")),
        tag("path", segments),
        tag("ext", F.array(F.lower(F.regexp_extract(path, r"\.([a-zA-Z0-9]+)$", 1)))),
        tag("key", F.transform(pairs, lambda p: F.regexp_extract(p, "^([^=]*)", 1))),
        tag("pair", pairs),
        tag("mark", F.array(F.when(F.contains(url, F.lit("#")), F.lit("fragment")).otherwise(F.lit("")))),
    )
    return F.coalesce(F.array_sort(F.array_distinct(all_)), F.array().cast("array<string>"))


def mined(pages: DataFrame, bad: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, fewest: int = FEWEST) -> DataFrame:
    """(rule, items, filed, confidence, support): the rules; ``bad`` has page_id and a flag for each labelled page."""
    one = bad.where("page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    few = pages.where("url is not null and page_id is not null").select(F.col("page_id"), tokens(F.col("url")).alias("t"))
    known = C.written(few.join(one, "page_id").select("t", "bad"), "labelled-urls")
    total, n_bad = known.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    empty = known.sparkSession.createDataFrame([], "rule string, items array<string>, filed string, confidence double, support double")
    least = max(1, fewest, math.ceil(support * total - 1e-9))
    if n_bad < least:
        return empty
    # where a token occurs, as two sums over hashes of the URLs: tokens with the same sums occur in the same URLs
    each = known.select(F.monotonically_increasing_id().alias("id"), "t", "bad").select("id", "bad", F.explode("t").alias("token"))
    place = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q")]
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("w"), *place).where(F.col("w") >= least)
    classes = counted.groupBy("p", "q", "n", "w").agg(F.min("token").alias("name"), F.array_sort(F.collect_list("token")).alias("members"))
    classes = C.written(classes.select("name", "members", "n", "w"), "token-classes")
    # FP-growth over the bad URLs alone gives how often a set occurs with BAD; what it occurs
    # in all is then counted for these sets only, over all labelled URLs
    mixed = classes.where((F.col("n") > F.col("w")) & (F.col("n") < total)).select(F.col("name").alias("token"))
    rows = known.select(F.monotonically_increasing_id().alias("id"), "t", "bad").where("bad = 1").select("id", F.explode("t").alias("token")).join(mixed, "token")
    model = FPGrowth(itemsCol="t", minConfidence=1.0)
    baskets = C.written(rows.groupBy("id").agg(F.collect_list("token").alias("t")), "bad-urls")
    n_baskets = baskets.count()
    single = classes.select(F.array("name").alias("items"), F.col("w").alias("with_bad"))
    sets = single
    if n_baskets >= least:
        model.setMinSupport(max((least - 0.5) / n_baskets, 1e-12))
        found = model.fit(baskets).freqItemsets.where(F.size("items") > 1)
        sets = single.unionAll(found.select(F.array_sort("items").alias("items"), F.col("freq").alias("with_bad")).where(F.col("with_bad") >= least))
    frequency = classes.select(F.col("name").alias("token"), "n")
    kept = C.written(_filed(sets.withColumn("rule", F.array_join("items", " & ")), frequency), "sets")
    seen = _matches(known.select(F.monotonically_increasing_id().alias("id"), "t"), kept).groupBy("rule").agg(F.count("*").alias("n"))
    rules = kept.join(seen, "rule").withColumn("confidence", F.col("with_bad") / F.col("n")).where(F.col("confidence") >= confidence)
    rules = C.written(rules.select("rule", "items", "filed", "confidence", (F.col("with_bad") / F.lit(float(total))).alias("support")), "rules")
    shorter = rules.select(F.col("items").alias("i"), F.col("confidence").alias("c"), F.col("filed").alias("f"))
    longer = rules.select("rule", "items", "confidence", F.explode("items").alias("token"))
    covered = longer.join(shorter, F.col("token") == F.col("f")).where((F.size("i") < F.size("items")) & (F.size(F.array_except("i", "items")) == 0) & (F.col("c") >= F.col("confidence")))
    return _written_out(rules.join(covered.select("rule").distinct(), "rule", "left_anti"), classes)


def _written_out(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Each rule over tokens that stand for others, once for each choice of these."""
    members = rules.select("rule", F.explode("items").alias("name")).join(classes, "name").groupBy("rule").agg(F.collect_list("members").alias("m"))
    more = lambda acc, ms: F.flatten(F.transform(acc, lambda a: F.transform(ms, lambda x: F.concat(a, F.array(x)))))
    choices = F.aggregate("m", F.array(F.array().cast("array<string>")), more)
    each = rules.join(members, "rule").select(F.explode(choices).alias("items"), "filed", "confidence", "support").withColumn("items", F.array_sort("items"))
    # the token filed under may be one that stands for others: the rule is filed under its own token of that class
    own = classes.select(F.col("name").alias("filed"), F.col("members").alias("of"))
    return each.join(own, "filed").select(F.array_join("items", " & ").alias("rule"), "items", F.get(F.array_intersect("items", "of"), F.lit(0)).alias("filed"), "confidence", "support")


def _filed(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """``rules`` with the token under which each is filed, its least frequent one."""
    each = rules.select("rule", F.explode("items").alias("token")).join(frequency, "token")
    filed = each.groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("filed"))
    return rules.join(filed, "rule")


def _matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """A row of ``urls`` (with tokens t) for each rule it fulfils."""
    index = rules.select(F.col("filed").alias("token"), *(c for c in rules.columns if c != "filed"))
    each = urls.select("*", F.explode("t").alias("token"))
    return each.join(index, "token").where(F.size(F.array_except("items", "t")) == 0).drop("token")


def decided(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, blocked, rule, confidence, support): a row for each page, with its best rule."""
    urls = pages.select("page_id", "url", tokens(F.col("url")).alias("t"))
    # a URL's decision depends on nothing but the URL, so matches are brought back by URL
    hits = _matches(urls.where(F.size("t") > 0).select("url", "t").distinct(), rules.select("rule", "items", "filed", "confidence", "support"))
    best = hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "rule")).alias("b"))
    return urls.join(best, "url", "left").select(
        "page_id", "url", F.col("b").isNotNull().alias("blocked"), F.col("b.rule").alias("rule"), (-F.col("b.c")).alias("confidence"), (-F.col("b.s")).alias("support")
    )


def bad_pages(labels: DataFrame) -> DataFrame:
    """Labels of pages: bad is what is of low quality or toxic. A page's id is its document's."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return decided(pages, mined(pages, bad_pages(C.table(spark, sf_dir, "labels"))))


_TOKENS = """list_sort(list_distinct(list_concat(
  list_transform(list_filter([lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))], lambda x: x <> ''), lambda x: 'scheme:' || x),
  list_transform(list_filter([host], lambda x: x <> ''), lambda x: 'host:' || x),
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'label:' || x),
  list_transform(list_filter(list_transform(string_split(path, '/'), lambda s: regexp_replace(regexp_replace(lower(s), '\\.[a-z0-9]+$', ''), '[0-9]+', '#', 'g')), lambda x: x <> ''), lambda x: 'path:' || x),
  list_transform(list_filter([lower(regexp_extract(path, '\\.([a-zA-Z0-9]+)$', 1))], lambda x: x <> ''), lambda x: 'ext:' || x),
  list_transform(list_filter(list_transform(string_split(query, '&'), lambda p: regexp_extract(p, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'key:' || x),
  list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'pair:' || x),
  CASE WHEN contains(url, '#') THEN ['mark:fragment'] ELSE [] END)))"""
SQL = f"""
WITH RECURSIVE piece AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, lower(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) AS query FROM pages),
page AS (SELECT page_id, url, {_TOKENS} AS t FROM piece),
known AS (SELECT page.page_id, t, bad FROM page JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id) l ON l.doc_id = page_id),
size_ AS (SELECT count(*) AS total, greatest(1, {FEWEST}, ceil({SUPPORT} * count(*) - 1e-9)) AS least FROM known),
one AS (SELECT page_id, unnest(t) AS a FROM known WHERE bad = 1),
item(page_id, items, w) AS (
  SELECT * FROM (SELECT page_id, [a] AS items, count(*) OVER (PARTITION BY a) AS w FROM one) WHERE w >= (SELECT least FROM size_)
  UNION ALL
  SELECT * FROM (SELECT i.page_id, list_append(i.items, o.a) AS items, count(*) OVER (PARTITION BY i.items, o.a) AS w FROM item i JOIN one o ON i.page_id = o.page_id AND o.a > i.items[-1])
  WHERE w >= (SELECT least FROM size_)),
often AS (SELECT items, any_value(w) AS w FROM item GROUP BY items),
counted AS (SELECT f.items, f.w, count(*) AS n FROM often f JOIN known k ON list_has_all(k.t, f.items) GROUP BY f.items, f.w),
candidate AS (SELECT items, w / n::DOUBLE AS confidence, w / total::DOUBLE AS support FROM counted, size_ WHERE w / n::DOUBLE >= {CONFIDENCE}),
rule AS (SELECT array_to_string(items, ' & ') AS rule, items, confidence, support FROM candidate c WHERE NOT EXISTS (
  SELECT 1 FROM candidate d WHERE len(d.items) < len(c.items) AND list_has_all(c.items, d.items) AND d.confidence >= c.confidence)),
hit AS (SELECT page_id, url, rule, confidence, support FROM page JOIN rule ON list_has_all(t, items)),
best AS (SELECT page_id, rule, confidence, support FROM hit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, support DESC, rule) = 1)
SELECT p.page_id, p.url, b.page_id IS NOT NULL AS blocked, b.rule, b.confidence, b.support FROM pages p LEFT JOIN best b ON b.page_id = p.page_id
"""
