"""Layout boxes of pages: merging along lines and paragraphs, reading order, Markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "doc {kind}, page_number int, no int, x0 double, x1 double, top double, bottom double, text string, layout_type string"
COLUMNS = ["doc", "page_number", "no", "x0", "x1", "top", "bottom", "text", "layout_type"]


def _fold(boxes: DataFrame, doc: str, step: Callable[[dict, dict], bool]) -> DataFrame:
    """One pass over the boxes of each page in order; ``step(box, next)`` merges the next into the box or says no.

    Pages are sorted within partitions and streamed, so that many small pages cost no call each and a large one needs
    no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict | None = None
        for pdf in batches:
            out = []
            for r in pdf[COLUMNS].itertuples(index=False, name=None):
                box = dict(zip(COLUMNS, r))
                if open_ is not None and open_["doc"] == box["doc"] and open_["page_number"] == box["page_number"] and step(open_, box):
                    continue
                if open_ is not None:
                    out.append(open_)
                open_ = box
            yield pd.DataFrame(out, columns=COLUMNS)
        if open_ is not None:
            yield pd.DataFrame([open_], columns=COLUMNS)

    kind = boxes.schema[doc].dataType.simpleString()
    ready = boxes.withColumnRenamed(doc, "doc").select(*COLUMNS).repartition("doc", "page_number").sortWithinPartitions("doc", "page_number", "no", "top", "x0", "text")
    return ready.mapInPandas(run, SCHEMA.format(kind=kind)).withColumnRenamed("doc", doc)


def _beside(a: dict, b: dict) -> bool:
    height = (a["bottom"] - a["top"] + b["bottom"] - b["top"]) / 2
    if min(a["bottom"], b["bottom"]) < max(a["top"], b["top"]) or b["x0"] - a["x1"] > height * 0.5:
        return False
    a["x1"] = max(a["x1"], b["x1"])
    a["text"] = f"{a['text']} {b['text']}"
    return True


def _below(a: dict, b: dict) -> bool:
    height = (a["bottom"] - a["top"] + b["bottom"] - b["top"]) / 2
    shared = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
    narrow = min(a["x1"] - a["x0"], b["x1"] - b["x0"])
    if a["layout_type"] != b["layout_type"] or b["top"] - a["bottom"] > height * 2 or shared <= 0 or narrow <= 0 or shared / narrow <= 0.3:
        return False
    glue = " " if a["text"][-1:].isascii() and a["text"][-1:].isalnum() and b["text"][:1].isascii() and b["text"][:1].isalnum() else ""
    a.update(bottom=b["bottom"], x0=min(a["x0"], b["x0"]), x1=max(a["x1"], b["x1"]), text=a["text"] + glue + b["text"])
    return True


def merge_lines(boxes: DataFrame, doc: str) -> DataFrame:
    """Boxes of one line: they overlap in height and stand no further apart than half a height."""
    return _fold(boxes, doc, _beside)


def merge_paragraphs(boxes: DataFrame, doc: str) -> DataFrame:
    """Boxes of one kind: no more than two heights apart, and sharing more than 0.3 of the narrower width."""
    return _fold(boxes, doc, _below)


def reading_order(boxes: DataFrame, doc: str) -> DataFrame:
    """``boxes`` plus ``column`` and ``reading_no``: by page, column, top, left.

    The column is the first place, among the left edges in order, that is nearer than twice the average gap.
    """
    page = Window.partitionBy(doc, "page_number")
    edges = F.array_sort(F.collect_list("x0").over(page))
    gap = F.try_divide(F.element_at(edges, -1) - F.element_at(edges, 1), F.size(edges) - 1) * 2
    column = F.when(F.coalesce(gap, F.lit(0.0)) <= 0, F.lit(0)).otherwise(F.array_position(F.transform(edges, lambda e: F.abs(F.col("x0") - e) < gap), F.lit(True)) - 1)
    b = boxes.withColumn("column", column.cast("int"))
    return b.withColumn("reading_no", F.row_number().over(Window.partitionBy(doc).orderBy("page_number", "column", "top", "x0", "no")))


def markdown(boxes: DataFrame, doc: str) -> DataFrame:
    """``doc, text``: boxes in reading order; titles as headings, tables with a blank line, figures as image links."""
    kind, t = F.col("layout_type"), F.col("text")
    link = F.concat(F.lit("![figure](page_"), F.col("page_number").cast("string"), F.lit(".png)"))
    line = F.when(kind == "title", F.concat(F.lit("\n## "), t, F.lit("\n"))).when(kind == "table", F.concat(t, F.lit("\n"))).when(kind == "figure", link).otherwise(t)
    ordered = F.array_sort(F.collect_list(F.struct("reading_no", line.alias("l"))))
    return boxes.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("text"))
