"""Sinks: the chunk and router indexes, JSON and Markdown files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.catalog import replace_documents

CHUNK_INDEX = ("chunk_id string, doc_id string, kb_id string, fd_id string, doc_title string, embedding_text string, page_num_int array<int>, section_hint string, section_id string, section_path array<string>, original_snippet string, embedding array<float>")
ROUTER_INDEX = ("doc_id string, kb_id string, fd_id string, title string, summary string, keywords array<string>, topics array<string>, routing_text string, embedding array<float>, doc_type string, status int, create_time timestamp")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of an index, in order and type; absent ones are null."""
    fields = [f.split() for f in schema.split(", ")]
    return df.select(*[(F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def append(df: DataFrame, path: str, schema: str = CHUNK_INDEX) -> None:
    """Append-only load, partitioned by knowledge base; a document that is loaded twice stands twice."""
    conform(df, schema).write.mode("append").partitionBy("kb_id").parquet(path)


def upsert(spark: SparkSession, df: DataFrame, path: str, new_path: str, schema: str = CHUNK_INDEX) -> None:
    """A new version of an index in which the given documents have just the given rows."""
    old = spark.read.schema(schema).parquet(path)
    replace_documents(old, conform(df, schema)).write.mode("overwrite").partitionBy("kb_id").parquet(new_path)


def refresh(spark: SparkSession, path: str) -> None:
    spark.catalog.refreshByPath(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def tree_json(nodes: DataFrame, doc: str = "doc_id", keep: tuple[str, ...] = ("title", "node_id", "text", "start_index", "end_index")) -> DataFrame:
    """``doc, json``: each document's nodes as one nested tree ``{doc_name, structure}``."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, at = [], {}
        for r in pdf.sort_values("pos").to_dict("records"):
            node = {k: (None if r[k] is None or r[k] != r[k] else int(r[k]) if k.endswith("_index") else r[k]) for k in keep}
            at[r["pos"]] = node
            parent = at.get(r["parent_pos"]) if r["parent_pos"] == r["parent_pos"] and r["parent_pos"] is not None else None
            (roots if parent is None else parent.setdefault("nodes", [])).append(node)
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]], "json": [json.dumps({"doc_name": pdf["doc_name"].iloc[0], "structure": roots}, ensure_ascii=False)]})

    kind = nodes.schema[doc].dataType.simpleString()
    ready = nodes.withColumnRenamed(doc, "doc").select("doc", "doc_name", "pos", "parent_pos", *keep)
    return ready.groupBy("doc").applyInPandas(fold, f"doc {kind}, json string").withColumnRenamed("doc", doc)


def merged_markdown(chunks: DataFrame, doc: str) -> DataFrame:
    """``doc, text`` from doc, no, title, first, last, md: sections under range comments, a rule between; empty ones left out."""
    full = chunks.filter("md is not null and md <> ''")
    head = F.concat(F.lit("<!-- chunk: "), "title", F.lit(" p"), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(" -->\n"), "md")
    ordered = F.array_sort(F.collect_list(F.struct("no", head.alias("t"))))
    return full.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n---\n\n").alias("text"))
