"""Structure of Markdown documents: one Arrow pass, a row for each document, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import arrow as A
from ..functions import markdown as M
from ..functions import text as X

STRUCTURE = (
    "length int, headings bigint, h1 bigint, h2 bigint, h3 bigint, h4 bigint, h5 bigint, h6 bigint, paragraphs bigint, avg_paragraph_length bigint, code_blocks bigint, lists bigint, tables bigint, "
    "links bigint, images bigint, blockquotes bigint, rules bigint, max_depth int, has_front_matter boolean, has_toc boolean, node_types map<string,bigint>"
)


def analyze(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, depths, histogram and flags of each document; those without a node have zeros, a null text is empty."""
    schema = T.StructType([docs.schema[key], *T._parse_datatype_string(STRUCTURE).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, 1):
            rows = []
            for t in A.texts(b.column(1)):
                found = M.structure(M.parse(t))
                found["length"] = X.units(t or "")
                found["node_types"] = list(found["node_types"].items())
                rows.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[1:])], schema=arrow)

    return docs.select(key, F.col(text).cast("string").alias("text" if key != "text" else "text_")).mapInArrow(run, schema)
