"""Markdown documents made of the driver's tables: H1, H2, paragraphs, list items, table rows.

The tables hold no Markdown, so structure is made here; the same blocks are made in SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as K


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where its scan has fewer tasks than these, so at most some splits for each core are moved.

    A table of more splits stays as it is scanned, without a shuffle, however few files it has. Where there is one, it
    is by the key that later windows and groups need, so they add none.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """(doc_id, block_no, type, text, depth): a conversation as H1, each turn as H2 and a paragraph."""
    k = lambda n: (F.col("turn") * 2 + n).cast("int").alias("block_no")
    row = lambda no, type_, text, depth: (no, F.lit(type_).alias("type"), text.alias("text"), F.lit(depth).cast("int").alias("depth"))
    doc = F.col("conv_id").alias("doc_id")
    title = conversations.select(doc).distinct().select("doc_id", *row(F.lit(0).alias("block_no"), "heading", F.concat(F.lit("Conversation "), F.col("doc_id").cast("string")), 1))
    heads = conversations.select(doc, *row(k(1), "heading", F.col("role"), 2))
    paragraphs = conversations.select(doc, *row(k(2), "paragraph", F.col("text"), None))
    return title.unionByName(heads).unionByName(paragraphs)


CONVERSATION_SQL = """
SELECT DISTINCT conv_id AS doc_id, 0 AS block_no, 'heading' AS type, 'Conversation ' || conv_id::VARCHAR AS text, 1 AS depth FROM conversations
UNION ALL SELECT conv_id, (turn * 2 + 1)::INT, 'heading', role, 2 FROM conversations
UNION ALL SELECT conv_id, (turn * 2 + 2)::INT, 'paragraph', text, NULL FROM conversations"""


def place_blocks(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """A region as H1, its nations as H2, their customers as list items; a document for each region."""
    r = region.select(F.col("r_regionkey").cast("bigint").alias("doc_id"), F.lit(-1).alias("n"), F.lit(-1).cast("bigint").alias("c"), F.lit("heading").alias("type"), F.col("r_name").alias("text"), F.lit(1).alias("depth"))
    n = nation.select(F.col("n_regionkey").cast("bigint"), F.col("n_nationkey"), F.lit(-1).cast("bigint"), F.lit("heading"), F.col("n_name"), F.lit(2))
    c = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("bigint"), F.col("n_nationkey"), F.col("c_custkey"), F.lit("list-item"), F.concat(F.col("c_name"), F.lit(" runs "), F.col("c_mktsegment")), F.lit(None).cast("int"))
    w = Window.partitionBy("doc_id").orderBy("n", "c")
    return r.unionAll(n).unionAll(c).withColumn("block_no", F.row_number().over(w) - 1).select("doc_id", "block_no", "type", "text", "depth")


PLACE_SQL = """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, c) - 1)::INT AS block_no, type, text, depth FROM (
  SELECT r_regionkey::BIGINT AS doc_id, -1 AS n, -1 AS c, 'heading' AS type, r_name AS text, 1 AS depth FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 'heading', n_name, 2 FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 'list-item', c_name || ' runs ' || c_mktsegment, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def conversation_markdown(conversations: DataFrame) -> DataFrame:
    """(doc_id, title, text): the same documents as Markdown text."""
    turn = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"])
    body = conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(parts.alias("parts"))
    title = F.concat(F.lit("Conversation "), F.col("doc_id").cast("string"))
    return body.select("doc_id", title.alias("title"), F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join("parts", "\n\n")).alias("text"))


def order_markdown(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(doc_id, title, text): an order as H1, a paragraph, and a table of its lines."""
    line = F.concat_ws(" | ", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    rows = lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: F.concat(F.lit("| "), x["t"], F.lit(" |"))).alias("rows"))
    body = orders.join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")  # an order without lines has a table without rows
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    text = F.concat(F.lit("# "), title, F.lit("\n\nStatus `"), F.col("o_orderstatus"), F.lit("`, priority **"), F.col("o_orderpriority"), F.lit("**.\n\n| line | part | flag | status |\n| --- | --- | --- | --- |\n"), F.coalesce(F.array_join("rows", "\n"), F.lit("")), F.lit("\n"))
    return body.select(F.col("o_orderkey").alias("doc_id"), title.alias("title"), text.alias("text"))


def rich_markdown(conversations: DataFrame) -> DataFrame:
    """(doc_id, title, text): a conversation as H1 and a rule; a turn as H2, then as a list of its lines, a quote, fenced
    code or a paragraph with marks and a link, by the turn's number; a table in the end."""
    lines = F.split("text", "\n")
    kinds = [
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), x)), "\n"),
        F.concat(F.lit("```py title\n"), F.col("text"), F.lit("\n```")),
        F.concat(F.lit("**Turn** "), F.col("turn").cast("string"), F.lit(" of `code` and [a link](http://x.example/a) or ![an image](b.png).")),
    ]
    body = F.element_at(F.array(*kinds), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), body)
    rows = conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))), lambda x: x["t"]).alias("parts"))
    title = F.concat(F.lit("Conversation "), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("# "), title, F.lit("\n\n---\n\n"), F.array_join("parts", "\n\n"), F.lit("\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n"))
    return rows.select("doc_id", title.alias("title"), text.alias("text"))


def with_tokens(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("tokens", K.heuristic(F.col("text")))
