"""Text files as documents, and chunks as files."""

from __future__ import annotations

import json
import os
import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats

DOCUMENT = "doc_id bigint, title string, text string"


def from_memory(spark: SparkSession, documents: list[tuple[str, str]]) -> DataFrame:
    """(title, text) pairs as documents."""
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(documents)], DOCUMENT)


def text_files(spark: SparkSession, path: str | list[str], suffix: str = ".md") -> DataFrame:
    """A row for each file below ``path``: doc_id, title (name without suffix), source, file_name, text, read_at.

    The id is a hash of the path, so it doesn't depend on the order of files.
    """
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("doc_id"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("title"),
        F.col("_metadata.file_path").alias("source"),
        name.alias("file_name"),
        F.col("value").alias("text"),
        F.current_timestamp().alias("read_at"),
    )


def listing(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """(file_name, length) of the files of a suffix; no content is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length").orderBy("file_name")


def front_matter(c: Column) -> Column:
    """Map of the simple ``key: value`` lines between --- lines at a text's begin; empty without."""

    @F.pandas_udf("map<string,string>")
    def read(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> dict[str, str]:
            lines = (t or "").split("\n")
            if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
                return {}
            end = [x.strip() for x in lines[1:]].index("---") + 1
            pairs = (x.partition(":") for x in lines[1:end] if ":" in x and not x.startswith((" ", "\t", "#")))
            return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}

        return s.map(one)

    return read(c)


def body(c: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(c, r"(?s)\A---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\z)", "")


# --- sinks


def write_json(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines, null fields kept, a folder for each value of ``by``."""
    out = rows.write.mode(mode).option("ignoreNullFields", "false")
    (out.partitionBy(by) if by else out).json(path)


def write_parquet(rows: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    out = rows.write.mode(mode)
    (out.partitionBy(by) if by else out).parquet(path)


def chunk_file_name(kind: str, document: str, number: int) -> str:
    return f"{kind}_{document}__ch{number}.json"


def write_chunk_files(chunks: DataFrame, folder: str, document: str = "title", kind: str = "doc") -> DataFrame:
    """One pretty-printed JSON file for each chunk; gives (file_name, bytes).

    ``folder`` must be one that all executors share: a path that each mounts, or a URI. A repeated task writes the
    same files again; a file appears when it is whole.
    """
    rows = chunks.select(F.coalesce(F.col(document).cast("string"), F.lit("untitled")).alias("d"), "chunk_no", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        where.create_dir(path, recursive=True)
        for pdf in batches:
            out = []
            for d, n, j in zip(pdf["d"], pdf["chunk_no"], pdf["json"]):
                name = chunk_file_name(kind, "".join(c if c.isalnum() or c in "._-" else "-" for c in d), int(n))
                data = json.dumps(json.loads(j), indent=2, ensure_ascii=False).encode()
                part = f"{path}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write(data)
                where.move(part, f"{path}/{name}")
                out.append((name, len(data)))
            yield pd.DataFrame(out, columns=["file_name", "bytes"])

    return rows.mapInPandas(run, "file_name string, bytes bigint")


def write_summary(chunks: DataFrame, path: str, source: str = "source") -> DataFrame:
    """One JSON line for each source, with its counts, lengths and relationships, and one (source null) for all; gives the lines."""
    rows = chunks if "hierarchy" in chunks.columns else chunks.withColumn("hierarchy", F.array_join("header_path", " > "))
    rows = rows if "confidence" in rows.columns else rows.withColumn("confidence", F.lit(None).cast("double"))
    each = stats.source_rollup(rows, source).join(stats.relationship_counts(rows, source).drop("linked"), source)
    whole = stats.source_rollup(rows.withColumn("_all", F.lit(1)), "_all").join(stats.relationship_counts(rows).drop("linked"))
    out = each.unionByName(whole.withColumn("_all", F.lit(None).cast(rows.schema[source].dataType)).withColumnRenamed("_all", source))
    write_json(out, path)
    return out


def by_source(chunks: DataFrame, source: str = "source") -> DataFrame:
    """(source, json): all chunks of a source as one JSON array, in order."""
    one = F.struct("doc_id", "chunk_no", *(c for c in chunks.columns if c not in ("doc_id", "chunk_no")))
    return chunks.groupBy(source).agg(F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("json"))


def with_parent(chunks: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with the text of their document as parent_text."""
    return chunks.join(documents.select(F.col(key), F.col("text").alias("parent_text")), key, "left")
