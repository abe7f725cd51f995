"""Flat node tables: parents from levels or dotted codes, node ids, leaves, subtrees, node text, reports.

A node table has one row per node with its document, its position in preorder and its level (0 at the top).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X


def parents(nodes: DataFrame, doc: str, pos: str, level: str) -> DataFrame:
    """``doc, pos, parent``: the nearest node before with a smaller level; null at the top.

    One pass with a stack over (document, position, level), sorted within partitions; levels may be of any depth.
    """
    kind = nodes.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for pdf in batches:
            out: list[int | None] = []
            for d, p, l in zip(pdf["doc"], pdf["pos"], pdf["level"]):
                if d != at:
                    at, stack = d, []
                while stack and stack[-1][0] >= l:
                    stack.pop()
                out.append(stack[-1][1] if stack else None)
                stack.append((l, p))
            yield pd.DataFrame({"doc": pdf["doc"], "pos": pdf["pos"], "parent": pd.array(out, dtype="Int32")})

    narrow = nodes.select(F.col(doc).alias("doc"), F.col(pos).cast("int").alias("pos"), F.col(level).cast("int").alias("level")).filter("doc is not null and pos is not null and level is not null")
    laid = narrow.repartition("doc").sortWithinPartitions("doc", "pos")
    return laid.mapInPandas(run, f"doc {kind}, pos int, parent int").withColumnsRenamed({"doc": doc, "pos": pos})


def dotted_parents(toc: DataFrame, doc: str, code: str, pos: str) -> DataFrame:
    """``toc`` plus ``parent_pos``: the entry of the code without its last part; of equal codes the last before counts.

    Entries without a parent are roots, with null.
    """
    up = F.when(F.contains(F.col(code), F.lit(".")), F.regexp_replace(code, r"\.[^.]*$", ""))
    child = toc.withColumn("__up", up)
    p = toc.select(F.col(doc).alias("__d"), F.col(code).alias("__c"), F.col(pos).alias("__p"))
    hit = child.join(p, (F.col(doc) == F.col("__d")) & (F.col("__up") == F.col("__c")) & (F.col("__p") < F.col(pos)), "left")
    return hit.groupBy(*toc.columns).agg(F.max("__p").alias("parent_pos"))


def node_ids(nodes: DataFrame, doc: str, pos: str, first: int = 0) -> DataFrame:
    """``nodes`` plus ``new_id``: preorder numbers from ``first``, four digits or more."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(pos)) - 1 + first
    return nodes.withColumn("new_id", F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit("0")))


def ends(nodes: DataFrame, doc: str, pos: str, level: str) -> DataFrame:
    """``doc, pos, until``: where each subtree ends, exclusive; null for those that reach the end of the document.

    The next node that is no deeper: a self-join on the document and the range, cut to the first by a minimum.
    """
    a = nodes.select(F.col(doc), F.col(pos), F.col(level).alias("__l"))
    b = nodes.select(F.col(doc).alias("__d"), F.col(pos).alias("__p"), F.col(level).alias("__k"))
    hit = a.join(b, (F.col(doc) == F.col("__d")) & (F.col("__p") > F.col(pos)) & (F.col("__k") <= F.col("__l")), "left")
    return hit.groupBy(doc, pos).agg(F.min("__p").alias("until"))


def leaves(nodes: DataFrame, doc: str, pos: str, parent: str) -> DataFrame:
    """Nodes that are nobody's parent."""
    inner = nodes.select(F.col(doc), F.col(parent).alias(pos)).filter(F.col(pos).isNotNull()).distinct()
    return nodes.join(inner, [doc, pos], "left_anti")


def leaf_rows(nodes: DataFrame, doc: str, pos: str, parent: str, *, include_inner: bool = False) -> DataFrame:
    """Chunk rows of a tree: leaves in preorder with path, section hint, pages, embedding text and a generated id.

    ``nodes`` has title, text, path, node_id, start_index, end_index. Text of inner nodes is left out unless asked for.
    """
    rows = nodes if include_inner else leaves(nodes, doc, pos, parent)
    n = F.row_number().over(Window.partitionBy(doc).orderBy(pos))
    hint = X.section_hint(F.col("title"), F.col("text"))
    generated = F.concat(F.lit("gen_id_"), F.lpad((n - 1).cast("string"), 5, "0"))
    return rows.select(
        doc, pos, F.coalesce(F.nullif(F.col("node_id"), F.lit("")), generated).alias("section_id"), hint.alias("section_hint"),
        F.col("path").alias("section_path"), X.page_range(F.col("start_index"), F.col("end_index"), n).alias("page_num_int"),
        X.clean_text(F.coalesce(F.col("text"), F.lit(""))).alias("original_snippet"), X.embedding_text(F.col("path"), X.clean_text(F.coalesce(F.col("text"), F.lit(""))), hint).alias("embedding_text"),
    )


def subtree(nodes: DataFrame, doc: str, pos: str, level: str, value: str, how: str = "max") -> DataFrame:
    """``doc, pos, value``: ``max`` or ``sum`` of a column over each node and its descendants."""
    span = ends(nodes, doc, pos, level)
    b = nodes.select(F.col(doc).alias("__d"), F.col(pos).alias("__p"), F.col(value).alias("__v"))
    hit = span.join(b, (F.col(doc) == F.col("__d")) & (F.col("__p") >= F.col(pos)) & (F.col("until").isNull() | (F.col("__p") < F.col("until"))))
    return hit.groupBy(doc, pos).agg((F.max if how == "max" else F.sum)("__v").alias("value"))


def chapter_texts(nodes: DataFrame, doc: str, pos: str, level: str, text: str) -> DataFrame:
    """``doc, chapter, text``: the non-empty texts of each top node and all below it, in preorder."""
    top = F.last(F.when(F.col(level) == 0, F.col(pos)), ignorenulls=True).over(Window.partitionBy(doc).orderBy(pos))
    t = nodes.select(doc, pos, F.col(text).alias("t"), top.alias("chapter")).filter("t is not null and t <> '' and chapter is not null")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("t"))))
    return t.groupBy(doc, "chapter").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


def outline(nodes: DataFrame, title: str = "title", level: str = "level") -> DataFrame:
    """``nodes`` plus ``line``: the indented listing of a tree."""
    return nodes.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col(level)), F.coalesce(F.col(title), F.lit(""))))


def node_texts(nodes: DataFrame, pages: DataFrame, doc: str = "doc_id", *, own: bool = True) -> DataFrame:
    """``doc, pos, text``: pages of each node joined; an inner node has those before its first child (``own``).

    ``nodes`` has pos, parent_pos, start_index, end_index; ``pages`` has page_no, page_text.
    """
    n = nodes.select(doc, "pos", F.col("start_index").alias("a"), F.col("end_index").alias("b"))
    if own:
        first = nodes.filter("parent_pos is not null and start_index is not null").groupBy(doc, F.col("parent_pos").alias("pos")).agg(F.min_by("start_index", "pos").alias("child"))
        n = n.join(first, [doc, "pos"], "left").withColumn("b", F.when(F.col("child").isNotNull(), F.col("child") - 1).otherwise(F.col("b")))
    hit = n.join(pages, doc).filter("page_no between a and b")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    text = hit.groupBy(doc, "pos").agg(F.array_join(F.transform(ordered, lambda x: x["page_text"]), "").alias("text"))
    return n.select(doc, "pos").join(text, [doc, "pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))
