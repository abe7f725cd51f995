"""Whole paths: files to chunk and router tables, pages to trees, Markdown to trees, chapters to chunks.

Each is one lazy plan over all documents at once; steps that ask a model take a plug-in and do without it by rules.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom import plugins
from docloom.functions import text as X
from docloom.functions.common import cut, strip
from docloom.operators import boxes, chunk, lines, summarise, toc, tree


def ingest(nodes: DataFrame, embedder: plugins.Embedder | None = None, *, include_inner: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, router rows) of documents given as nodes with doc_id, kb_id, fd_id, doc_name and the node columns.

    Repeated lines go first; chunks are the leaves; the router text is made of titles, first paragraphs, central
    sentences and frequent terms.
    """
    clean = lines.without_repeated(nodes, "doc_id", "pos", "text").withColumnRenamed("text", "clean")
    n = nodes.join(clean, ["doc_id", "pos"]).withColumn("text", F.col("clean")).drop("clean")
    rows = tree.leaf_rows(n, "doc_id", "pos", "parent_pos", include_inner=include_inner)
    owner = nodes.groupBy("doc_id").agg(F.first("kb_id").alias("kb_id"), F.first("fd_id").alias("fd_id"), F.first("doc_name").alias("title"))
    chunks = plugins.embed(rows, "embedding_text", embedder=embedder).join(owner.withColumnRenamed("title", "doc_title"), "doc_id")
    chunks = chunks.withColumn("chunk_id", F.concat_ws("#", "doc_id", "section_id"))
    titles, paragraphs = summarise.section_titles(n, "doc_id", "pos", "path"), summarise.first_paragraphs(n, "doc_id", "pos", "path", "text")
    sents = summarise.sentences(n.filter("is_leaf"), "doc_id", "pos", "text", X.chunk_weight(X.section_hint(F.col("title"), F.col("text")), F.lit(1)))
    terms = summarise.top_terms(n, "doc_id", "pos", "text")
    text = summarise.routing_text(titles, paragraphs, summarise.summaries(sents, "doc_id"), terms, "doc_id")
    router = plugins.embed(summarise.router_record(owner.join(text, "doc_id", "left")), "routing_text", embedder=embedder)
    return chunks, router


def markdown_tree(df: DataFrame, key: str, text: str, *, thin_below: int | None = None) -> DataFrame:
    """``key, pos, level, parent, node_id, title, text`` of Markdown documents: headings with the lines up to the next.

    ``thin_below`` lets nodes of fewer tokens take in their subtrees. Documents without headings give one node.
    """
    d = df.select(F.col(key).alias("doc"), F.col(text).alias("t")).filter("t is not null")
    s = chunk.sections(d, "doc", "t")
    w = Window.partitionBy("doc").orderBy("line_no")
    n = s.select("doc", (F.row_number().over(w) - 1).alias("pos"), (F.col("level") - 1).alias("level"), "title", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "title", F.lit("\n"), "body").alias("text"))
    bare = d.join(s.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit(0).alias("pos"), F.lit(0).alias("level"), F.lit("").alias("title"), strip("t").alias("text"))
    n = n.unionByName(bare)
    if thin_below is not None:
        n = chunk.thin(n, "doc", "pos", "level", "text", thin_below).join(n.select("doc", "pos", "title"), ["doc", "pos"])
    n = tree.node_ids(n, "doc", "pos").withColumnRenamed("new_id", "node_id")
    return n.join(tree.parents(n, "doc", "pos", "level"), ["doc", "pos"]).withColumnRenamed("doc", key)


def simple_text_tree(df: DataFrame, key: str, text: str, to_markdown: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Texts made into Markdown by a plug-in, then :func:`markdown_tree`."""
    md = df.withColumn("__md", F.pandas_udf(lambda s: to_markdown(s), "string")(text))
    return markdown_tree(md, key, "__md")


def checked(placed: DataFrame, seen: DataFrame, totals: DataFrame) -> DataFrame:
    """The entries of ``placed`` (doc, pos, title, level, physical_index) in documents whose contents hold, repaired.

    ``seen``: doc, pos, physical_index of the pages where titles stand; ``totals``: doc, total. An entry is right if its
    title stands on its page. Documents go on with more than 0.3 right and a last entry in their second half; a wrong
    entry goes to the first page between its right neighbours where its title stands, or stays without one.
    """
    spots = seen.select("doc", "pos", F.col("physical_index").alias("spot")).distinct()
    right = spots.select("doc", "pos", F.col("spot").alias("physical_index"), F.lit("yes").alias("correct"))
    ok = placed.join(right, ["doc", "pos", "physical_index"], "left").na.fill("no", ["correct"])
    share = toc.accuracy(ok, "doc", "correct").join(far_enough(ok, totals), "doc").filter("accuracy > 0.3").select("doc")
    near = toc.correct_neighbours(ok.join(share, "doc").join(totals, "doc"), "physical_index", F.col("correct") == "no", 1, F.col("total"))
    fits = near.filter("correct = 'no'").join(spots, ["doc", "pos"]).filter("spot between prev_correct and next_correct").groupBy("doc", "pos").agg(F.min("spot").alias("spot"))
    return near.join(fits, ["doc", "pos"], "left").select("doc", "pos", "title", "level", F.coalesce("spot", "physical_index").alias("physical_index"))


def far_enough(placed: DataFrame, totals: DataFrame) -> DataFrame:
    """``doc``: the documents whose last entry is in their second half."""
    return placed.groupBy("doc").agg(F.max_by("physical_index", "pos").alias("last")).join(totals, "doc").filter("2 * last >= total").select("doc")


def by_titles(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """``doc, pos, title, level, physical_index``: each entry on the first page from its predecessor's on where its title stands."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        at, out = 0, []
        for pos, rows in pdf.groupby("pos", sort=True):
            later = [x for x in rows["physical_index"] if x >= at]
            if later:
                at = min(later)
                out.append((pdf["doc"].iloc[0], pos, at))
        return pd.DataFrame(out, columns=["doc", "pos", "physical_index"])

    kind = seen.schema["doc"].dataType.simpleString()
    found = seen.select("doc", "pos", "physical_index").groupBy("doc").applyInPandas(fold, f"doc {kind}, pos int, physical_index int")
    return entries.select("doc", "pos", "title", "level").join(found, ["doc", "pos"])


def page_index(pages: DataFrame, *, toc_pages: int = 20, completer: Callable[[pd.Series], pd.Series] = plugins.rule_completer) -> DataFrame:
    """``doc, pos, level, title, start_index, end_index, text`` from pages (doc, page_no, text), by rules alone.

    Contents pages are found and parsed; the offset between printed and physical pages is the most frequent difference
    to where titles stand; entries are placed, checked and repaired (:func:`checked`), deduplicated, given a preface, ends
    and text. Where too few are right, entries are placed by their titles alone. Documents without usable contents give
    one node per ten pages. ``completer`` is asked whether a page is one of contents where the rules do not know: it gets
    the text of the page and answers yes or no.
    """
    p = lines.strip_heads_and_feet(pages, "doc", "page_no", "text")
    marked = plugins.ask_if_unknown(p.withColumn("answer", X.toc_page(F.col("text"))), "answer", "text", completer)
    run = toc.toc_run(marked, "doc", "page_no", "answer", toc_pages)
    parsed = toc.parse_lines(run.withColumn("k", F.concat_ws("|", "doc", F.lpad(F.col("page_no").cast("string"), 8, "0"))), "k", "text")
    entries = parsed.select(F.substring_index("k", "|", 1).alias("doc"), F.concat("k", F.lpad(F.col("line_no").cast("string"), 6, "0")).alias("order"), "title", "page")
    entries = entries.filter(X.is_heading(F.col("title"))).withColumn("level", X.title_level(F.col("title")) - 1).withColumn("pos", F.row_number().over(Window.partitionBy("doc").orderBy("order")))
    body = p.join(run.select("doc", "page_no"), ["doc", "page_no"], "left_anti")
    # titles as they stand on pages: an equi-join on the document, checked by containment
    seen = entries.join(body.select("doc", F.col("page_no").alias("physical_index"), "text"), "doc").filter(F.contains(X.squeezed(F.col("text")), X.squeezed(F.col("title"))))
    offset = toc.page_offset(seen.select("doc", "pos", "page", "physical_index"), "doc", "pos")
    totals = pages.groupBy("doc").agg(F.max("page_no").cast("int").alias("total"))
    placed = toc.apply_offset(entries, offset, "doc").join(totals, "doc").filter("physical_index between 1 and total").drop("total")
    held = cut(checked(placed.select("doc", "pos", "title", "level", "physical_index"), seen, totals))
    again = held.select("doc").distinct()
    alone = by_titles(entries.join(again, "doc", "left_anti"), seen.join(again, "doc", "left_anti"))
    kept = toc.deduplicated(held.unionByName(alone.join(far_enough(alone, totals), "doc")))
    first = toc.with_preface(kept).join(kept.select("doc", "pos", "level"), ["doc", "pos"], "left").withColumn("level", F.coalesce("level", F.lit(0))).withColumn("appear_start", F.lit("yes"))
    ended = toc.section_ends(first, totals).select("doc", "pos", "level", "title", F.col("physical_index").cast("int").alias("start_index"), F.col("end_index").cast("int").alias("end_index"))
    other = totals.join(ended.select("doc").distinct(), "doc", "left_anti")
    fixed = chunk.fixed_pages(other, "doc", "total").select("doc", F.col("no").alias("pos"), F.lit(0).alias("level"), "title", F.col("first").alias("start_index"), F.col("last").alias("end_index"))
    nodes = cut(ended.unionByName(fixed))
    nodes = nodes.join(tree.parents(nodes, "doc", "pos", "level"), ["doc", "pos"]).withColumnRenamed("parent", "parent_pos")
    text = tree.node_texts(nodes, p.select("doc", "page_no", F.col("text").alias("page_text")), "doc")
    return nodes.join(text, ["doc", "pos"])


def split_large(nodes: DataFrame, pages: DataFrame, *, most_pages: int = 10, most_tokens: int = 10_000) -> DataFrame:
    """Nodes of more pages and tokens than allowed are cut into halves of pages, until none is left.

    ``nodes``: doc, pos, title, start_index, end_index; ``pages``: doc, page_no, tokens. Gives the same with ``part``.
    """
    size = pages.select("doc", "page_no", "tokens")
    work = nodes.select("doc", "pos", "title", "start_index", "end_index").withColumn("part", F.lit(""))
    done = None
    while True:
        n = work.join(size, "doc").filter("page_no between start_index and end_index").groupBy("doc", "pos", "part").agg(F.sum("tokens").alias("n"))
        span = F.col("end_index") - F.col("start_index") + 1
        big = F.coalesce((span > max(most_pages, 1)) & (F.coalesce("n", F.lit(0)) >= most_tokens), F.lit(False))
        w = cut(work.join(n, ["doc", "pos", "part"], "left").withColumn("big", big).drop("n"))
        fine = w.filter("not big").drop("big").select("doc", "pos", "title", "start_index", "end_index", "part")
        done = fine if done is None else done.unionByName(fine)
        if w.filter("big").isEmpty():
            return done
        middle = F.floor((F.col("start_index") + F.col("end_index")) / 2).cast("int")
        halves = F.array(F.struct(F.concat("part", F.lit("1")).alias("part"), F.col("start_index").alias("a"), middle.alias("b")), F.struct(F.concat("part", F.lit("2")).alias("part"), (middle + 1).alias("a"), F.col("end_index").alias("b")))
        work = w.filter("big").select("doc", "pos", "title", F.explode(halves).alias("h")).select("doc", "pos", "title", F.col("h.a").alias("start_index"), F.col("h.b").alias("end_index"), F.col("h.part").alias("part"))


def chunked(pages: DataFrame, entries: DataFrame, *, most_tokens: int = 20_000) -> DataFrame:
    """``doc, no, part, title, level, first, last, parent, text``: the chapters of long documents.

    ``pages``: doc, page_no, text; ``entries``: doc, pos, level, title, page (bookmarks or parsed contents). Documents
    without entries are cut every ten pages; what follows references or an appendix is left out.
    """
    p = lines.strip_heads_and_feet(pages, "doc", "page_no", "text")
    totals = pages.groupBy("doc").agg(F.max("page_no").cast("int").alias("total"))
    plan = toc.chunk_plan(entries, totals)
    rest = chunk.fixed_pages(totals.join(entries.select("doc").distinct(), "doc", "left_anti"), "doc", "total")
    plan = plan.unionByName(rest.select("doc", "no", "title", F.lit(1).alias("level"), "first", "last"))
    lengths = p.select("doc", F.col("page_no").alias("page"), F.length("text").alias("n"))
    parts = chunk.refine(plan, entries, lengths, most_tokens)
    order = F.row_number().over(Window.partitionBy("doc").orderBy("no", "part"))
    kept = toc.until_appendix(parts.withColumn("pos", order), "doc", "pos", "title")
    hit = kept.join(p.select("doc", "page_no", F.col("text").alias("t")), "doc").filter("page_no between first and last and trim(t) <> ''")
    banner = F.concat(F.lit("=== 第 "), F.col("page_no").cast("string"), F.lit(" 页 ===\n"), "t")
    ordered = F.array_sort(F.collect_list(F.struct("page_no", banner.alias("b"))))
    text = hit.groupBy("doc", "no", "part").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("text"))
    return kept.drop("pos").join(text, ["doc", "no", "part"], "left")


def merged_subtrees(parts: DataFrame, subtrees: DataFrame) -> DataFrame:
    """``doc, pos, level, title``: subtrees of chapter parts put under their chapters.

    ``parts``: doc, no, part, title, parent; ``subtrees``: doc, no, part, pos, level, title. Parts of one parent stand
    under it; a subtree whose only root bears its part's title is that part.
    """
    roots = subtrees.filter("level = 0").groupBy("doc", "no", "part").agg(F.count("*").alias("roots"), F.first("title").alias("root"))
    s = parts.join(roots, ["doc", "no", "part"], "left").withColumn("same", F.coalesce((F.col("roots") == 1) & X.titles_match(F.col("title"), F.col("root")), F.lit(False)))
    under = F.when(F.col("parent") != "", 1).otherwise(0)
    chapters = s.filter("parent <> ''").groupBy("doc", "no").agg(F.first("parent").alias("title")).select("doc", "no", F.lit(-2).alias("part"), F.lit(0).alias("at"), F.lit(0).alias("level"), "title")
    own = s.select("doc", "no", "part", F.lit(-1).alias("at"), under.alias("level"), "title")
    inner = subtrees.alias("t").join(s.select("doc", "no", "part", "same", under.alias("u")), ["doc", "no", "part"]).filter("not (same and level = 0)")
    below = inner.select("doc", "no", "part", F.col("pos").alias("at"), (F.col("level") + F.col("u") + F.when(F.col("same"), 0).otherwise(1)).cast("int").alias("level"), "title")
    w = Window.partitionBy("doc").orderBy("no", "part", "at")
    return chapters.unionByName(own).unionByName(below).select("doc", (F.row_number().over(w) - 1).alias("pos"), "level", "title")


def page_boxes(parsed: DataFrame, doc: str) -> DataFrame:
    """``doc, text``: boxes merged along lines and paragraphs, in reading order, as Markdown."""
    return boxes.markdown(boxes.reading_order(boxes.merge_paragraphs(boxes.merge_lines(parsed, doc), doc), doc), doc)
