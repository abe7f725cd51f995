"""Lines of pages: repeated lines, running heads and feet, merging of broken lines.

A page is a row with a document key, a position and a text; documents are groups of pages. Frequencies are counted
with partial aggregation; nothing gathers the pages of a document in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.common import strip

#: Lines at each end of a page, share of pages, longest head, and what of a longer third line counts.
ENDS, SHARE, LONGEST, PREFIX = 3, 0.5, 30, 13


def repeated(pages: DataFrame, doc: str, text: str, threshold: float = 0.6) -> DataFrame:
    """``doc, line, pages``: lines on at least ``threshold`` of a document's pages; none for documents of one page."""
    size = pages.groupBy(doc).agg(F.count("*").alias("total")).filter("total > 1")
    lines = pages.select(doc, F.explode(F.array_distinct(X.page_lines(F.col(text)))).alias("line"))
    count = lines.groupBy(doc, "line").agg(F.count("*").alias("pages"))
    return count.join(size, doc).filter(F.col("pages") / F.col("total") >= threshold).select(doc, "line", "pages")


def without_repeated(pages: DataFrame, doc: str, pos: str, text: str, threshold: float = 0.6) -> DataFrame:
    """``doc, pos, text``: the pages without their repeated lines, white space around lines and blank lines."""
    noise = repeated(pages, doc, text, threshold).groupBy(doc).agg(F.collect_set("line").alias("noise"))  # few: each on most pages
    out = pages.select(doc, pos, X.page_lines(F.col(text)).alias("lines")).join(noise, doc, "left")
    return out.select(doc, pos, F.array_join(F.when(F.col("noise").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("noise", x))), "\n").alias("text"))


def _head_line(line: Column, i: Column) -> Column:
    return F.when((i >= 2) & (F.length(line) > 15), F.left(line, F.lit(PREFIX))).otherwise(line)


def heads_and_feet(pages: DataFrame, doc: str, text: str, share: float = SHARE) -> DataFrame:
    """``doc, side, line, n``: candidates among the first and last three lines, seen on ``int(pages * share)`` pages."""
    size = pages.groupBy(doc).agg(F.count("*").alias("total")).filter("total >= 3")
    lines = pages.select(doc, X.page_lines(F.col(text)).alias("l"))
    top = lines.select(doc, F.lit("header").alias("side"), F.explode(F.transform(F.slice("l", 1, ENDS), _head_line)).alias("line"))
    foot = lines.select(doc, F.lit("footer").alias("side"), F.explode(F.slice("l", F.greatest(F.lit(1), F.size("l") - (ENDS - 1)), F.lit(ENDS))).alias("line"))
    count = top.unionByName(foot).groupBy(doc, "side", "line").agg(F.count("*").alias("n"))
    return count.join(size, doc).filter((F.col("n") >= F.floor(F.col("total") * share)) & (F.length("line") <= LONGEST)).select(doc, "side", "line", "n")


def strip_heads_and_feet(pages: DataFrame, doc: str, pos: str, text: str, share: float = SHARE) -> DataFrame:
    """``doc, pos, text``: the pages without the lines of :func:`heads_and_feet`; a head glued to text loses its prefix."""
    found = heads_and_feet(pages, doc, text, share)
    sets = found.groupBy(doc).agg(F.collect_set(F.when(F.col("side") == "header", F.col("line"))).alias("top"), F.collect_set(F.when(F.col("side") == "footer", F.col("line"))).alias("foot"))
    raw = F.split(text, "\n")
    lines = F.transform(raw, lambda x, i: F.struct(x.alias("raw"), strip(x).alias("s"), i.alias("i")))
    real = F.filter("__l", lambda x: x["s"] != "")
    base = pages.select(doc, pos, lines.alias("__l")).withColumn("__r", F.transform(real, lambda x: x["i"]))
    first, last = F.slice("__r", 1, ENDS), F.slice("__r", F.greatest(F.lit(1), F.size("__r") - (ENDS - 1)), F.lit(ENDS))
    base = base.withColumn("__first", first).withColumn("__last", F.when(F.size("__r") > 0, last).otherwise(F.array().cast("array<int>"))).join(sets, doc, "left")
    none = F.array().cast("array<string>")
    top, foot = F.coalesce("top", none), F.coalesce("foot", none)

    def kept(x: Column) -> Column:
        in_first, in_last = F.array_contains("__first", x["i"]), F.array_contains("__last", x["i"])
        prefix = F.left(x["s"], F.lit(PREFIX))
        glued = in_first & ~F.array_contains(top, x["s"]) & (F.length(x["s"]) > 15) & F.array_contains(top, prefix)
        gone = in_first & F.array_contains(top, x["s"]) | in_last & F.array_contains(foot, x["s"])
        return F.when(gone, F.lit(None)).when(glued, strip(F.substr(x["s"], F.lit(PREFIX + 1)))).otherwise(x["raw"])

    return base.select(doc, pos, F.array_join(F.array_compact(F.transform("__l", kept)), "\n").alias("text"))


def merge_broken(text: Column) -> Column:
    """Pairs of lines as one: the first ends in a letter, digit or CJK character, the second has text and no list mark.

    A fold over the lines that carries whether the line before took this one; a merged pair is not merged again.
    """
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), F.regexp_replace(x, r"[\s\p{Z}]+$", "").alias("r"), strip(x).alias("s")))
    ends = lambda x: x["r"].rlike(r"[\p{L}\p{N}_]$")
    starts = lambda x: (x["s"] != "") & ~x["s"].rlike(r"^[#=\-*|]")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        joined = F.concat(F.slice(acc["out"], 1, F.greatest(F.lit(0), F.size(acc["out"]) - 1)), F.array(F.concat(F.regexp_replace(last, r"[\s\p{Z}]+$", ""), x["s"])))
        take = acc["open"] & starts(x)
        return F.when(take, F.struct(joined.alias("out"), F.lit(False).alias("open"))).otherwise(F.struct(F.concat(acc["out"], F.array(x["raw"])).alias("out"), ends(x).alias("open")))

    return F.array_join(F.aggregate(lines, empty, step)["out"], "\n")
