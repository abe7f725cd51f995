"""Chunks: sliding windows, packed paragraphs, Markdown sections, page groups, refinement of long chapters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.functions.common import strip
from docloom.functions.spans import spans


def windows(text: Column, size: int = 1500, overlap: int = 150) -> Column:
    """array<struct<i, piece>>: windows of ``size`` characters, ``size - overlap`` apart, trimmed, blank ones left out.

    The last window is the first that reaches the end of the text; null and blank texts have none.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), strip(F.substring(text, i * step + 1, F.lit(size))).alias("piece")))
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit(None)).otherwise(F.filter(cut, lambda w: w["piece"] != ""))


def window_nodes(df: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 150) -> DataFrame:
    """``key, no, title, piece``: window chunks as nodes, numbered from 1, titled by their first 30 characters."""
    w = df.select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("p", "w"))
    no = F.col("p") + 1
    head = F.replace(F.left(F.col("w.piece"), F.lit(30)), F.lit("\n"), F.lit(" "))
    return w.select(key, no.alias("no"), F.concat(F.lit("第 "), no.cast("string"), F.lit(" 段："), head, F.lit("...")).alias("title"), F.col("w.piece").alias("piece"))


def pack_paragraphs(text: Column, size: int = 500) -> Column:
    """array<string>: paragraphs (lines) packed up to ``size`` characters; a chunk begins with the last paragraph before.

    A fold in the JVM: line feeds are not counted, and a chunk that would be empty is never closed.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p)
        last = F.try_element_at(acc["open"], F.lit(-1))
        full = (acc["n"] + n > size) & (F.size(acc["open"]) > 0)
        closed = F.struct(F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n"))).alias("done"), F.array(last, p).alias("open"), (F.length(last) + n).alias("n"))
        return F.when(full, closed).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(p)).alias("open"), (acc["n"] + n).alias("n")))

    finish = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n")))).otherwise(acc["done"])
    return F.aggregate(X.page_lines(text), empty, step, finish)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, level, title, body``: Markdown headings outside code fences, each with the lines below it.

    Text before the first heading is left out. One pass per row: nothing is exploded by line.
    """
    lines = F.split(text, "\n")
    empty = F.struct(F.lit(False).alias("code"), F.array().cast("array<struct<line_no:int,level:int,title:string,body:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        line, no = x["line"], x["no"]
        bare = F.regexp_replace(line, r"[\s\p{Z}]+$", "")
        fence = strip(line).startswith("```")
        head = ~acc["code"] & bare.rlike(r"^#{1,6}\s+\S")
        new = F.struct(no.alias("line_no"), F.length(F.regexp_extract(bare, r"^(#{1,6})\s", 1)).alias("level"), strip(F.regexp_extract(bare, r"^#{1,6}\s+(.+)$", 1)).alias("title"), F.lit(None).cast("string").alias("body"))
        last = F.try_element_at(acc["out"], F.lit(-1))
        more = F.struct(last["line_no"].alias("line_no"), last["level"].alias("level"), last["title"].alias("title"), F.concat_ws("\n", last["body"], line).alias("body"))
        out = F.when(head, F.concat(acc["out"], F.array(new))).when(F.size(acc["out"]) == 0, acc["out"]).otherwise(F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(more)))
        return F.struct(F.when(fence, ~acc["code"]).otherwise(acc["code"]).alias("code"), out.alias("out"))

    numbered = F.transform(lines, lambda line, i: F.struct(line.alias("line"), (i + 1).alias("no")))
    found = F.aggregate(numbered, empty, step)["out"]
    s = df.select(key, F.explode(found).alias("s"))
    return s.select(key, F.col("s.line_no").alias("line_no"), F.col("s.level").alias("level"), F.col("s.title").alias("title"), strip(F.coalesce(F.col("s.body"), F.lit(""))).alias("body"))


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, level, title``: Markdown headings; fence lines toggle code mode, indented headings count."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("s", strip("line"))
    fences = Window.partitionBy(key).orderBy("i")
    lines = lines.withColumn("code", F.sum(F.col("s").startswith("```").cast("int")).over(fences) % 2)
    hit = lines.filter((F.col("code") == 0) & F.col("s").rlike(r"^#{1,6}\s+\S"))
    return hit.select(key, (F.col("i") + 1).alias("line_no"), F.length(F.regexp_extract("s", r"^(#{1,6})\s", 1)).alias("level"), strip(F.regexp_extract("s", r"^#{1,6}\s+(.+)$", 1)).alias("title"))


def paragraph_nodes(df: DataFrame, keys: list[str], title: str, text: str) -> DataFrame:
    """``keys, no, title, piece``: leaves of several paragraphs become one node per paragraph; others stay away."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    p = df.select(*keys, title, parts.alias("parts")).filter(F.size("parts") > 1).select(*keys, title, F.posexplode("parts").alias("i", "piece"))
    no = F.col("i") + 1
    return p.select(*keys, no.alias("no"), F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" - 段落"), no.cast("string")).alias("title"), "piece")


def concat_pages(pages: DataFrame, doc: str, no: str, text: str, form: str = "banner") -> DataFrame:
    """``doc, text``: the pages of a document as one text, in order.

    ``banner``: blank pages left out, each under ``=== 第 n 页 ===``; ``tags``: between ``<physical_index_n>`` marks;
    ``plain``: as they are.
    """
    n, t = F.col(no).cast("string"), F.coalesce(F.col(text), F.lit(""))
    if form == "banner":
        pages, one, sep = pages.filter(strip(t) != ""), F.concat(F.lit("=== 第 "), n, F.lit(" 页 ===\n"), t), "\n\n"
    elif form == "tags":
        one, sep = F.concat(F.lit("<physical_index_"), n, F.lit(">\n"), t, F.lit("\n<physical_index_"), n, F.lit(">\n\n")), ""
    else:
        one, sep = t, ""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(no).alias("n"), one.alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), sep).alias("text"))


def page_groups(pages: DataFrame, doc: str, no: str, tokens: str, most: int = 4000, overlap: int = 1) -> DataFrame:
    """``doc, group_no, first, last, pages, tokens``: pages in groups near an even share of tokens, one page repeated.

    A fold per document over (page, tokens) alone; texts are joined afterwards by range. A first page above the share
    leaves an empty first group, with ``pages`` 0.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        nos, sizes, key = pdf["no"].tolist(), pdf["tokens"].to_numpy(), pdf["doc"].iloc[0]
        total = int(sizes.sum())
        parts = math.ceil(total / most)
        share = total if total <= most else math.ceil((total / parts + most) / 2)
        rows = [(key, g, nos[a] if b > a else -1, nos[b - 1] if b > a else -1, b - a, int(sizes[a:b].sum())) for g, (a, b) in enumerate(spans(sizes, share, overlap, first_may_be_empty=True))]
        return pd.DataFrame(rows, columns=["doc", "group_no", "first", "last", "pages", "tokens"])

    kind = pages.schema[doc].dataType.simpleString()
    narrow = pages.select(F.col(doc).alias("doc"), F.col(no).cast("int").alias("no"), F.col(tokens).cast("long").alias("tokens"))
    return narrow.groupBy("doc").applyInPandas(fold, f"doc {kind}, group_no int, first int, last int, pages int, tokens long").withColumnRenamed("doc", doc)


def fixed_pages(docs: DataFrame, doc: str, total: str, per: int = 10) -> DataFrame:
    """``doc, no, title, first, last``: chunks of ``per`` pages, titled by their range; none for documents without pages."""
    c = docs.filter(F.col(total) > 0).select(doc, F.col(total).alias("t"), F.explode(F.sequence(F.lit(1), F.col(total), F.lit(per))).alias("first"))
    last = F.least(F.col("first") + per - 1, F.col("t"))
    title = F.concat(F.lit("第 "), F.col("first").cast("string"), F.lit("-"), last.cast("string"), F.lit(" 页"))
    return c.select(doc, ((F.col("first") - 1) / per + 1).cast("int").alias("no"), title.alias("title"), F.col("first").cast("int").alias("first"), last.cast("int").alias("last"))


def refine(chunks: DataFrame, toc: DataFrame, lengths: DataFrame, most: int = 20_000) -> DataFrame:
    """Chapters above ``most`` estimated tokens split by their sub-entries, else into parts of 5 to 15 pages.

    ``chunks``: doc, no, title, level, first, last; ``toc``: doc, pos, title, level, page; ``lengths``: doc, page, n
    (characters). Gives ``doc, no, part, title, level, first, last, parent``; part 0 is what stands before the first
    sub-entry or a chapter left whole.
    """
    size = chunks.join(lengths, "doc").filter("page between first and last").groupBy("doc", "no").agg(F.sum("n").alias("chars"))
    c = chunks.join(size, ["doc", "no"], "left").withColumn("chars", F.coalesce("chars", F.lit(0))).withColumn("tokens", F.floor(F.col("chars") / 1.5))
    small, big = c.filter(F.col("tokens") <= most), c.filter(F.col("tokens") > most)
    whole = lambda d: d.select("doc", "no", F.lit(0).alias("part"), "title", "level", "first", "last", F.lit("").alias("parent"))
    sub = big.alias("b").join(toc.alias("t"), "doc").filter("t.level > b.level and t.page between b.first and b.last")
    w = Window.partitionBy("doc", "no").orderBy("pos")
    sub = sub.select("doc", "no", F.col("b.title").alias("parent"), F.col("b.last").alias("end"), F.col("b.first").alias("begin"), F.col("b.level").alias("blevel"), F.col("t.title").alias("title"), F.col("t.level").alias("level"), F.col("t.page").alias("first"), F.col("t.pos").alias("pos"))
    sub = sub.withColumn("part", F.row_number().over(w)).withColumn("next", F.lead("first").over(w))
    last = F.greatest(F.col("first"), F.least(F.coalesce(F.col("next") - 1, F.col("end")), F.col("end")))
    by_entry = sub.select("doc", "no", "part", "title", "level", "first", last.alias("last"), "parent")
    lead = sub.filter("part = 1 and first > begin").select("doc", "no", F.lit(0).alias("part"), F.col("parent").alias("title"), F.col("blevel").alias("level"), F.col("begin").alias("first"), (F.col("first") - 1).alias("last"), "parent")
    bare = big.join(sub.select("doc", "no").distinct(), ["doc", "no"], "left_anti")
    pages = F.col("last") - F.col("first") + 1
    per = F.greatest(F.lit(5), F.least(F.lit(15), F.greatest(F.lit(1), F.floor(F.lit(most * 1.5) / (F.col("chars") / pages))))).cast("int")
    bare = bare.withColumn("per", per)
    parts = bare.filter(pages > F.col("per")).withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("last") - F.col("first") + 1) / F.col("per")).cast("int") - 1)))
    start = F.col("first") + F.col("k") * F.col("per")
    parts = parts.select("doc", "no", (F.col("k") + 1).alias("part"), F.concat("title", F.lit(" (第"), (F.col("k") + 1).cast("string"), F.lit("部分)")).alias("title"), "level", start.alias("first"), F.least(start + F.col("per") - 1, F.col("last")).alias("last"), F.col("title").alias("parent"))
    out = whole(small).unionByName(by_entry).unionByName(lead).unionByName(parts).unionByName(whole(bare.filter(pages <= F.col("per"))))
    return out.select("doc", "no", F.col("part").cast("int").alias("part"), "title", "level", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "parent")


def thin(nodes: DataFrame, doc: str, pos: str, level: str, text: str, tokens: int = 200) -> DataFrame:
    """``doc, pos, level, text``: from the end, a node of fewer tokens takes in its whole subtree, a blank line between.

    Token counts are of the mixed kind and taken again after each merge; a fold per document.
    """
    import re

    word, cjk = re.compile(r"\b\w+\b"), re.compile("[一-龥]")

    def count(t: str) -> int:
        return len(word.findall(t)) + len(cjk.findall(t)) + (len(t) - len(re.findall(r"\w", t))) // 2

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = [[p, lv, t or ""] for p, lv, t in zip(pdf["pos"], pdf["level"], pdf["text"])]
        alive = [True] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            kids = []
            for j in range(i + 1, len(rows)):
                if rows[j][1] <= rows[i][1]:
                    break
                if alive[j]:
                    kids.append(j)
            whole = "\n".join([rows[i][2], *[rows[j][2] for j in kids if rows[j][2]]])
            if kids and count(whole) < tokens:
                rows[i][2] = "\n\n".join(x for x in [rows[i][2], *[rows[j][2] for j in kids]] if x.strip())
                for j in kids:
                    alive[j] = False
        keep = [r for r, a in zip(rows, alive) if a]
        return pd.DataFrame([(pdf["doc"].iloc[0], *r) for r in keep], columns=["doc", "pos", "level", "text"])

    kind = nodes.schema[doc].dataType.simpleString()
    narrow = nodes.select(F.col(doc).alias("doc"), F.col(pos).cast("int").alias("pos"), F.col(level).cast("int").alias("level"), F.col(text).alias("text"))
    return narrow.groupBy("doc").applyInPandas(fold, f"doc {kind}, pos int, level int, text string").withColumnRenamed("doc", doc)
