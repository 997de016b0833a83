"""Markdown documents to tree rows and block arrays, each in one Arrow pass without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import arrow as A
from ..functions import markdown as M
from ..functions import tokens as K
from ..plans.options import DEFAULTS, ChunkOptions
from . import split as S

_POINT = "struct<line:int,column:int>"
BLOCK = f"struct<type:string,text:string,depth:int,lang:string,trail:array<string>,depths:array<int>,position:struct<start:{_POINT},end:{_POINT}>>"
AST = (
    "node_id int, parent_id int, level int, type string, value string, depth int, lang string, ordered boolean, checked boolean, "
    f"headings_before int, mainly_links boolean, text_length int, position struct<start:{_POINT},end:{_POINT}>"
)


def _place(node: M.Node) -> dict | None:
    point = lambda p: {"line": p[0], "column": p[1]}
    return {"start": point(node.start), "end": point(node.end)} if node.start else None


def ast_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each node in preorder; the parent of a document's top nodes is -1."""
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string(AST).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, 1):
            rows = []
            for k, t in zip(b.column(0).to_pylist(), A.texts(b.column(1))):
                headings = 0
                for node, i, parent, level in M.walk(M.parse(t)):
                    headings += node.type == "heading"
                    rows.append(
                        {
                            key: k, "node_id": i, "parent_id": parent, "level": level, "type": node.type, "value": node.value, "depth": node.depth, "lang": node.lang, "ordered": node.ordered,
                            "checked": node.checked, "headings_before": headings, "mainly_links": M.mainly_links(node) if node.type == "list" else None,
                            "text_length": M.text_length(node) if node.type == "paragraph" else None, "position": _place(node),
                        }
                    )
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _block_arrays(found: list[list[dict]], kind: pa.ListType) -> pa.ListArray:
    """Blocks of documents as an array of lists of structs, made field by field: a row of Python values for each block takes several times that."""
    flat = [x for blocks in found for x in blocks]
    to = {f.name: f.type for f in kind.value_type}

    def point(name: str, of: pa.StructType) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array([x[name][i] for x in flat], pa.int32()) for i in (0, 1)], fields=list(of))

    place = pa.StructArray.from_arrays([point(f.name, f.type) for f in to["position"]], fields=list(to["position"]))
    fields = [place if name == "position" else pa.array([x[name] for x in flat], t) for name, t in to.items()]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(kind.value_type))).cast(kind)


def parsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array of blocks instead of the text."""
    own = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("blocks", T._parse_datatype_string(f"array<{BLOCK}>"))])
    kind = to_arrow_schema(schema).field("blocks").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, len(own)):
            found = [M.flatten(M.parse(t)) for t in A.texts(b.column(len(own)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], _block_arrays(found, kind)], [*own, "blocks"])

    return docs.select(*own, F.col(text).cast("string")).mapInArrow(run, schema)


def split_blocks(docs: DataFrame, o: ChunkOptions = DEFAULTS, blocks: str = "blocks") -> DataFrame:
    """Oversized blocks in parts that keep type, trail and place."""
    kind, most = docs.schema[blocks].dataType, K.most_units(o.max_tokens)
    if o.ranks_file:
        cut_one = lambda t: S.split_counted(t, o.max_tokens, K.counter(o.ranks_file))
        some = F.lit(True)
    else:
        cut_one = lambda t: S.cut_oversized(t, most)
        some = F.exists(blocks, lambda b: K.heuristic(b["text"]) > o.max_tokens)
    texts = F.when(some, F.transform(blocks, lambda b: b["text"]))
    rows = docs.withColumn("_parts", A.each(texts, lambda ts: [[t] if t is None else cut_one(t) for t in ts], "array<array<string>>"))
    whole = F.flatten(F.transform(blocks, lambda b, i: F.transform(F.get("_parts", i), lambda t: b.withField("text", t))))
    return rows.withColumn(blocks, F.when(F.col("_parts").isNull(), F.col(blocks)).otherwise(whole).cast(kind)).drop("_parts")


def block_rows(docs: DataFrame, blocks: str = "blocks", key: str = "doc_id") -> DataFrame:
    b = docs.select(key, F.posexplode(blocks).alias("block_no", "b"))
    return b.select(key, "block_no", "b.*").withColumn("tokens", K.heuristic(F.col("text")))
