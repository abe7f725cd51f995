"""Tables of contents: page offsets, chunk plans, section ends, repair windows, rules over runs of entries.

Order is always that of an explicit position column; windows are per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.functions.common import strip


def _by(doc: str, pos: str) -> Window:
    return Window.partitionBy(doc).orderBy(pos)


def page_pairs(printed: DataFrame, physical: DataFrame, doc: str, start: int = 1) -> DataFrame:
    """``doc, title, page, physical_index``: printed entries and found ones of the same title, from page ``start`` on."""
    return printed.select(doc, "title", "page").join(physical.select(doc, "title", "physical_index").filter(F.col("physical_index") >= start), [doc, "title"])


def page_offset(pairs: DataFrame, doc: str, order: str) -> DataFrame:
    """``doc, offset``: the most frequent difference of physical and printed page; of equals the one seen first."""
    d = pairs.filter("page is not null and physical_index is not null").select(doc, (F.col("physical_index") - F.col("page")).alias("offset"), order)
    c = d.groupBy(doc, "offset").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return c.groupBy(doc).agg(F.max_by("offset", F.struct("n", -F.col("first"))).alias("offset"))


def apply_offset(toc: DataFrame, offsets: DataFrame, doc: str) -> DataFrame:
    """``physical_index`` = page + offset; the page goes away."""
    return toc.join(offsets, doc).withColumn("physical_index", F.col("page") + F.col("offset")).drop("page", "offset")


def chunk_plan(toc: DataFrame, totals: DataFrame, doc: str = "doc") -> DataFrame:
    """``doc, no, title, level, first, last``: page ranges of the top entries, with a preface before the first.

    ``toc``: doc, pos, level, title, page; ``totals``: doc, total. Top entries are those of level 1, else up to 2, else
    all. A chunk ends before the next begins, the last one with the document.
    """
    least = toc.join(toc.groupBy(doc).agg(F.min("level").alias("least")), doc)
    top = least.filter((F.col("level") == 1) | (F.col("least") > 1) & (F.col("level") == 2) | (F.col("least") > 2)).join(totals, doc)
    w = _by(doc, "pos")
    end = F.coalesce(F.lead("page").over(w) - 1, F.col("total"))
    body = top.select(doc, F.row_number().over(w).alias("no"), "title", "level", F.col("page").alias("first"), F.greatest(F.col("page"), F.least(end, F.col("total"))).alias("last"))
    preface = body.filter("no = 1 and first > 1").select(doc, F.lit(0).alias("no"), F.lit("前言").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("first"), (F.col("first") - 1).alias("last"))
    return body.unionByName(preface)


def section_ends(toc: DataFrame, totals: DataFrame, doc: str = "doc") -> DataFrame:
    """``toc`` plus ``end_index``: the page before the next entry if that starts a page (appear_start yes), else its page."""
    w = _by(doc, "pos")
    nxt, start = F.lead("physical_index").over(w), F.lead("appear_start").over(w)
    end = F.when(nxt.isNull(), F.col("total")).when(start == "yes", nxt - 1).otherwise(nxt)
    return toc.join(totals, doc).withColumn("end_index", F.greatest(F.col("physical_index"), end)).drop("total")


def known_neighbours(toc: DataFrame, value: str, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """``toc`` plus ``prev_known`` (0 if there is none) and ``next_known`` (-1): the nearest entries that have a value."""
    before = _by(doc, pos).rowsBetween(Window.unboundedPreceding, -1)
    after = _by(doc, pos).rowsBetween(1, Window.unboundedFollowing)
    return toc.withColumn("prev_known", F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(0))).withColumn("next_known", F.coalesce(F.first(value, ignorenulls=True).over(after), F.lit(-1)))


def correct_neighbours(toc: DataFrame, value: str, wrong: Column, start: int, end: Column, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """``toc`` plus ``prev_correct`` and ``next_correct``: the same, over the entries that are not wrong."""
    good = toc.withColumn("__good", F.when(~wrong, F.col(value)))
    before = _by(doc, pos).rowsBetween(Window.unboundedPreceding, -1)
    after = _by(doc, pos).rowsBetween(1, Window.unboundedFollowing)
    out = good.withColumn("prev_correct", F.coalesce(F.last("__good", ignorenulls=True).over(before), F.lit(start - 1)))
    return out.withColumn("next_correct", F.coalesce(F.first("__good", ignorenulls=True).over(after), end)).drop("__good")


def with_preface(toc: DataFrame, doc: str = "doc") -> DataFrame:
    """``toc`` (doc, pos, title, physical_index) and, where the first entry is not on page 1, a preface before it."""
    first = toc.groupBy(doc).agg(F.min("pos").alias("pos"), F.min_by("physical_index", "pos").alias("first")).filter("first > 1")
    head = first.select(doc, (F.col("pos") - 1).alias("pos"), F.lit("前言").alias("title"), F.lit(1).alias("physical_index"))
    return toc.select(doc, "pos", "title", "physical_index").unionByName(head)


def deduplicated(toc: DataFrame, doc: str = "doc") -> DataFrame:
    """The first entry of each trimmed title and page."""
    w = Window.partitionBy(doc, strip("title"), "physical_index").orderBy("pos")
    return toc.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def within(toc: DataFrame, value: str, most: Column) -> DataFrame:
    """Page references beyond the document become null."""
    return toc.withColumn(value, F.when(F.col(value) <= most, F.col(value)))


def filtered(toc: DataFrame, doc: str = "doc", crowded: int = 10) -> DataFrame:
    """Entries that look like headings; on pages of more than ``crowded`` entries only numbered ones."""
    n = F.count("physical_index").over(Window.partitionBy(doc, "physical_index"))
    short = ("^[0-9.]+\\s", "^第[一二三四五六七八九十百千0-9]+", "^[（(][一二三四五六七八九十0-9]+[）)]", "^[一二三四五六七八九十]+[、.]")
    return toc.withColumn("__n", n).filter(X.is_heading(F.col("title")) & ((F.col("__n") <= crowded) | X.is_numbered(strip("title"), short))).drop("__n")


def until_appendix(chunks: DataFrame, doc: str, pos: str, title: str, stop: str = r"(?i)^(参考文献|参考资料|references|bibliography|附录|appendix)") -> DataFrame:
    """The chunks before the first whose title begins references or an appendix."""
    hit = F.max(F.coalesce(strip(title).rlike(stop), F.lit(False)).cast("int")).over(_by(doc, pos).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("__h", hit).filter("__h = 0").drop("__h")


def toc_run(pages: DataFrame, doc: str, pos: str, answer: str, within_first: int = 20) -> DataFrame:
    """Pages of the first run of contents pages: from the first ``yes`` up to the next ``no``.

    The run must begin within the first pages; other answers neither begin nor end it.
    """
    w = _by(doc, pos).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(((F.col(answer) == "yes") & (F.col(pos) < within_first)).cast("int")).over(w)
    p = pages.withColumn("__b", F.coalesce(begun, F.lit(0)))
    stopped = F.max(((F.col("__b") == 1) & (F.col(answer) == "no")).cast("int")).over(w)
    return p.withColumn("__s", F.coalesce(stopped, F.lit(0))).filter((F.col("__b") == 1) & (F.col("__s") == 0) & (F.col(answer) == "yes")).drop("__b", "__s")


def accuracy(entries: DataFrame, doc: str, correct: str) -> DataFrame:
    """``doc, accuracy``: share of entries checked ``yes``."""
    return entries.groupBy(doc).agg(F.avg((F.col(correct) == "yes").cast("double")).alias("accuracy"))


def increasing_pages(values: list[int], n: int) -> list[int]:
    """The last ``n`` values if they increase, else the longest greedy increasing run from any start, its first ``n``."""
    v = np.asarray(values, dtype=np.int64)
    if n <= len(v) and (np.diff(v[len(v) - n :]) > 0).all():
        return v[len(v) - n :].tolist()
    # a greedy run goes from each value to the next larger one: lengths come from the back, with a stack of larger values
    after, length, larger = np.full(len(v), -1), np.ones(len(v), dtype=np.int64), []
    for i in range(len(v) - 1, -1, -1):
        while larger and v[larger[-1]] <= v[i]:
            larger.pop()
        if larger:
            after[i], length[i] = larger[-1], length[larger[-1]] + 1
        larger.append(i)
    run, at = [], int(length.argmax()) if len(v) else -1
    while at >= 0 and len(run) < n:
        run.append(int(v[at]))
        at = int(after[at])
    return run


def best_sequences(df: DataFrame, doc: str, pos: str, value: str, n: str) -> DataFrame:
    """``doc, pages``: :func:`increasing_pages` of each document's values in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda x: x["v"])
    arrays = df.groupBy(doc).agg(ordered.alias("v"), F.max(n).alias("n"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(v: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([increasing_pages([int(x) for x in a if x is not None], int(m)) for a, m in zip(v, k)])

    return arrays.select(doc, pick("v", "n").alias("pages"))


def parse_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, title, page``: entries ``title ..... 12``, ``title   12``, and a title with its number on the next line."""
    lines = df.select(key, F.posexplode(X.page_lines(F.col(text))).alias("i", "line"))
    dotted, spaced = r"^(.+?)\s*(?:\.{2,}|…+|·{2,})\s*([0-9]{1,4})$", r"^(.+?)\s{3,}([0-9]{1,4})$"
    nxt = F.lead("line").over(Window.partitionBy(key).orderBy("i"))
    lines = lines.withColumn("next", nxt)
    title = F.when(F.col("line").rlike(dotted), F.regexp_extract("line", dotted, 1)).when(F.col("line").rlike(spaced), F.regexp_extract("line", spaced, 1)).when(F.col("next").rlike(r"^[0-9]{1,4}$") & ~F.col("line").rlike(r"^[0-9]+$"), F.col("line"))
    page = F.when(F.col("line").rlike(dotted), F.regexp_extract("line", dotted, 2)).when(F.col("line").rlike(spaced), F.regexp_extract("line", spaced, 2)).otherwise(F.col("next"))
    return lines.withColumn("title", strip(title)).filter("title is not null and title <> ''").select(key, (F.col("i") + 1).alias("line_no"), "title", page.cast("int").alias("page"))


def fuzzy_in_page(titles: pd.Series, pages: pd.Series) -> pd.Series:
    """``yes``, ``no`` or None: whether a title stands in a page but for one character in seven."""

    out: list[str | None] = []
    for t, p in zip(titles, pages):
        a, b = "".join((t or "").split()).lower(), "".join((p or "").split()).lower()
        if not a:
            out.append(None)
        elif a in b:
            out.append("yes")
        elif len(a) < 3:
            out.append(None)
        elif len(b) < len(a):
            out.append("no")
        else:
            x, y = (np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in (a, b))
            same = np.zeros(len(y) - len(x) + 1, dtype=np.int32)
            for i, c in enumerate(x):
                same += y[i : i + len(same)] == c
            share = same.max() / len(x)
            out.append("yes" if share >= 0.85 else "no" if share < 0.5 else None)
    return pd.Series(out, dtype=object)


def title_in_page(df: DataFrame, title: str, page: str, out: str = "answer") -> DataFrame:
    """``df`` plus the answer; titles that stand in the page as they are never leave the JVM."""
    plain = F.contains(X.squeezed(F.col(page)), X.squeezed(F.col(title))) & (X.squeezed(F.col(title)) != "")
    udf = F.pandas_udf(fuzzy_in_page, "string")
    easy = df.filter(plain).withColumn(out, F.lit("yes"))
    return easy.unionByName(df.filter(~plain | plain.isNull()).withColumn(out, udf(title, page)))


def merge_roots(roots: DataFrame, doc: str, pos: str) -> DataFrame:
    """``roots`` (doc, pos, start_index, end_index) plus ``under``: roots that begin no later than the first tree ends.

    They become children of the first root, whose end grows, until none is left; null for the first and for those apart.
    """
    schema = T.StructType([*roots.select(F.col(doc).alias("doc"), F.col(pos).cast("int").alias("pos"), F.col("start_index").cast("int"), F.col("end_index").cast("int")).schema.fields, T.StructField("under", T.IntegerType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        under: list[int | None] = [None] * len(pdf)
        if len(pdf) > 1:
            end, grown = pdf["end_index"][0], True
            while grown:
                grown = False
                for i in range(1, len(pdf)):
                    if under[i] is None and pdf["start_index"][i] <= end + 1:
                        under[i], grown = int(pdf["pos"][0]), True
                        end = max(end, pdf["end_index"][i])
        return pdf.assign(under=pd.array(under, dtype="Int32"))

    ready = roots.filter("start_index is not null and end_index is not null").select(F.col(doc).alias("doc"), F.col(pos).cast("int").alias("pos"), F.col("start_index").cast("int"), F.col("end_index").cast("int"))
    return ready.groupBy("doc").applyInPandas(fold, schema).withColumnRenamed("doc", doc)
