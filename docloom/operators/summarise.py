"""Extractive summaries: term counts, titles, first paragraphs, sentence ranking, diversity, routing text.

Everything is per document; only the sentence graph and the greedy choice need Python, on the sentences of one document.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as X
from docloom.functions.common import strip

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def top_terms(df: DataFrame, doc: str, pos: str, text: str, k: int = 10) -> DataFrame:
    """``doc, rank, term, n``: the most frequent runs between white space; of equals the one seen first."""
    words = df.select(doc, F.col(pos).alias("p"), F.posexplode(F.regexp_extract_all(text, F.lit(r"[^\s\p{Z}]+"), F.lit(0))).alias("i", "term"))
    count = words.groupBy(doc, "term").agg(F.count("*").alias("n"), F.min(F.struct("p", "i")).alias("first"))
    w = Window.partitionBy(doc).orderBy(F.desc("n"), "first")
    return count.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(doc, "rank", "term", "n")


def section_titles(df: DataFrame, doc: str, pos: str, path: str, k: int = 30) -> DataFrame:
    """``doc, rank, title``: distinct titles of the section paths in order of first appearance, of two characters or more."""
    t = df.select(doc, F.col(pos).alias("p"), F.posexplode(path).alias("i", "t")).withColumn("title", strip("t")).filter(F.length("title") >= 2)
    first = t.groupBy(doc, "title").agg(F.min(F.struct("p", "i")).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("first"))).filter(F.col("rank") <= k).select(doc, "rank", "title")


def first_paragraphs(df: DataFrame, doc: str, pos: str, path: str, text: str, k: int = 8, size: int = 200, longer_than: int = 30) -> DataFrame:
    """``doc, rank, paragraph``: the beginning of the first chunk of each top section, if it is long enough."""
    top = df.select(doc, F.col(pos).alias("p"), F.try_element_at(path, F.lit(1)).alias("top"), strip(F.coalesce(F.col(text), F.lit(""))).alias("t")).filter("top is not null and top <> ''")
    first = top.groupBy(doc, "top").agg(F.min_by("t", "p").alias("t"), F.min("p").alias("p")).filter(F.length("t") > longer_than)
    w = Window.partitionBy(doc).orderBy("p")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(doc, "rank", F.left("t", F.lit(size)).alias("paragraph"))


def sentences(df: DataFrame, doc: str, pos: str, text: str, weight: Column, marks: str = "。！？.!?", longer_than: int = 20) -> DataFrame:
    """``doc, no, sentence, weight``: the sentences of a document's chunks, numbered through."""
    chunks = df.select(doc, F.col(pos).alias("p"), weight.cast("double").alias("weight"), X.sentences(F.coalesce(F.col(text), F.lit("")), marks, longer_than).alias("s"))  # before the rows multiply
    s = chunks.select(doc, "p", "weight", F.posexplode("s").alias("i", "sentence"))
    return s.withColumn("no", F.row_number().over(Window.partitionBy(doc).orderBy("p", "i"))).select(doc, "no", "sentence", "weight")


def rank_sentences(texts: list[str], weights: list[float]) -> list[float]:
    """Weighted PageRank over cosines of TF-IDF vectors, self-links kept, times the weight.

    Words have two characters or more; idf is ln((1 + n) / (1 + df)) + 1; rows have length 1. Without any word the
    score is half the weight.
    """
    words = [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    n = len(texts)
    if not vocabulary:
        return [w * 0.5 for w in weights]
    rows = np.repeat(np.arange(n), [len(ws) for ws in words])
    cols = np.array([vocabulary[w] for ws in words for w in ws])
    cells, times = np.unique(rows * len(vocabulary) + cols, return_counts=True)
    rows, cols = cells // len(vocabulary), cells % len(vocabulary)
    found = np.bincount(cols, minlength=len(vocabulary))
    value = times * (np.log((1 + n) / (1 + found)) + 1)[cols]
    norm = np.sqrt(np.bincount(rows, value * value, minlength=n))
    value = value / norm[rows]
    shared = np.flatnonzero(found > 1)  # words of one sentence only count towards its length
    place = np.full(len(vocabulary), -1)
    place[shared] = np.arange(len(shared))
    keep = place[cols] >= 0
    rows, cols, value = rows[keep], place[cols[keep]], value[keep]
    # links are M M^T with ones on the diagonal for sentences with words; only M is ever held
    own = (norm > 0) - np.bincount(rows, value * value, minlength=n)

    def linked(x: np.ndarray) -> np.ndarray:
        words_of = np.bincount(cols, value * x[rows], minlength=len(shared))
        return np.bincount(rows, value * words_of[cols], minlength=n) + own * x

    out = linked(np.ones(n))
    alone = norm == 0
    out[alone] = 1
    rank = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        share = np.where(alone, 0, rank / out)
        new = DAMPING * (linked(share) + rank[alone].sum() / n) + (1 - DAMPING) / n
        done = np.abs(new - rank).sum() < n * TOLERANCE
        rank = new
        if done:
            break
    return [float(r * w) for r, w in zip(rank, weights)]


def diversify(texts: list[str], scores: list[float], k: int = 5, trade: float = 0.7) -> list[int]:
    """Greedy choice of ``k``: relevance against the largest overlap with what was chosen; of equals the earliest."""
    sets = [set(t) for t in texts]
    overlap = [0.0] * len(texts)
    left, chosen = list(range(len(texts))), []
    while left and len(chosen) < k:
        best = max(left, key=lambda i: (trade * scores[i] - (1 - trade) * overlap[i], -i))
        chosen.append(best)
        left.remove(best)
        for i in left:
            overlap[i] = max(overlap[i], len(sets[i] & sets[best]) / (len(sets[i]) + 1e-5))
    return chosen


def summaries(sents: DataFrame, doc: str, k: int = 6, trade: float = 0.7) -> DataFrame:
    """``doc, rank, no, sentence, score``: the most central and diverse sentences of each document.

    The ranking is over the whole document, in memory and time of its words.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        texts, weights = pdf["sentence"].tolist(), pdf["weight"].tolist()
        scores = rank_sentences(texts, weights)
        chosen = diversify(texts, scores, k, trade)
        nos = pdf["no"].tolist()
        return pd.DataFrame([(pdf["doc"].iloc[0], r + 1, nos[i], texts[i], scores[i]) for r, i in enumerate(chosen)], columns=["doc", "rank", "no", "sentence", "score"])

    kind = sents.schema[doc].dataType.simpleString()
    out = sents.withColumnRenamed(doc, "doc").groupBy("doc").applyInPandas(fold, f"doc {kind}, rank int, no int, sentence string, score double")
    return out.withColumnRenamed("doc", doc)


def _listed(df: DataFrame, doc: str, value: str, sep: str, out: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", value)))
    return df.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x[value]), sep).alias(out))


def routing_text(titles: DataFrame, paragraphs: DataFrame, summary: DataFrame | None, terms: DataFrame, doc: str, most: int = 6000) -> DataFrame:
    """``doc, routing_text``: titles, first paragraphs, summary and keywords, each on a line that is left out if empty."""
    parts = [
        ("目录：", _listed(titles, doc, "title", "；", "a"), "a"),
        ("各章节摘要：", _listed(paragraphs, doc, "paragraph", "。", "b"), "b"),
        ("核心内容：", _listed(summary, doc, "sentence", "。", "c") if summary is not None else None, "c"),
        ("关键词：", _listed(terms, doc, "term", ",", "d"), "d"),
    ]
    out, lines = None, []
    for label, df, name in parts:
        if df is None:
            continue
        out = df if out is None else out.join(df, doc, "full_outer")
        lines.append(F.concat(F.lit(label), F.nullif(F.col(name), F.lit(""))))
    return out.select(doc, F.left(F.concat_ws("\n", *lines), F.lit(most)).alias("routing_text"))


def router_record(df: DataFrame) -> DataFrame:
    """Router rows from doc_id, kb_id, fd_id, title, routing_text: the title is put before a text that lacks it.

    A text of fewer than ten characters is replaced by the title, or ``未知文档`` without one.
    """
    title = F.coalesce(F.nullif(strip("title"), F.lit("")), F.lit(""))
    text = F.coalesce(F.col("routing_text"), F.lit(""))
    full = F.when((title != "") & ~F.contains(text, title), F.concat(title, F.lit("\n"), text)).otherwise(text)
    safe = F.when(F.length(strip(full)) < 10, F.when(title != "", title).otherwise(F.lit("未知文档"))).otherwise(full)
    return df.select("doc_id", "kb_id", "fd_id", "title", safe.alias("routing_text"), F.lit("pdf").alias("doc_type"), F.lit(1).alias("status"))


def fallback_summary(df: DataFrame, doc: str, pos: str, text: str, k: int = 3, size: int = 200) -> DataFrame:
    """``doc, summary``: the beginnings of the first nodes with text."""
    t = df.filter(F.coalesce(strip(text), F.lit("")) != "")
    first = t.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(pos))).filter(F.col("rank") <= k)
    return _listed(first.select(doc, "rank", F.left(F.col(text), F.lit(size)).alias("head")), doc, "head", "\n", "summary")


def legacy_routing(title: Column, summary: Column, keywords: Column, topics: Column) -> Column:
    """Title, summary, keywords and topics on a line each; empty ones left out."""
    line = lambda label, v: F.concat(F.lit(label), F.nullif(v, F.lit("")))
    return F.concat_ws("\n", line("标题：", title), line("摘要：", summary), line("关键词：", F.array_join(keywords, "、")), line("主题：", F.array_join(topics, "、")))
