"""Queries of the corpus problems on texts and vectors, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.common import WHITE_SPACE, current_rows, strip, table
from docloom.llm import decontam, denoise, neighbours, pack, sentences, split


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the current nodes whose text is longer than the index takes."""
    nodes = table(spark, sf_dir, "tree_node")
    long = F.when(F.length(strip("text")) > 1500, F.col("text"))  # short texts are not shuffled
    rows = nodes.filter("doc_id is not null and pos is not null").select("doc_id", "pos", "ingested_at", "start_index", "end_index", long.alias("text"))
    return split.split_oversized(current_rows(rows, ["doc_id", "pos"], "ingested_at"), ["doc_id", "pos"], "text", ["start_index", "end_index"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that were cut: those with a second piece."""
    return p1_pieces(spark, sf_dir).filter("piece_no = 1").select("doc_id", "pos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of summaries whose embeddings have a cosine of 0.9 or more."""
    pairs = neighbours.similar_pairs(table(spark, sf_dir, "doc_summary_index"), "row_id", "embedding", 0.9)
    return pairs.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p3_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar summaries of every summary whose id is divisible by 20, among all summaries."""
    rows = table(spark, sf_dir, "doc_summary_index").select("row_id", "embedding")
    top = neighbours.nearest(rows, rows.filter("row_id % 20 = 0"), "row_id", "embedding", 10)
    return top.select(F.col("id").alias("row_id"), "neighbour", "rank", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, page numbers, divided words and misread lines in the nodes of scanned documents."""
    return denoise.noisy_lines(table(spark, sf_dir, "tree_node"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running text of the nodes of scanned documents as whole paragraphs."""
    return denoise.repaired(table(spark, sf_dir, "tree_node"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2,048 tokens that takes each document, or each part of one above 2,048 tokens."""
    return pack.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, tokens, share of unused room."""
    boxes = p6_pack(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return boxes.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.round(1 - F.sum("n") / (F.count("*") * pack.CAPACITY), 6).alias("unused"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a test item's passage, with the item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    return decontam.find_leaks(docs, "doc_id", "text", items, "item_id", "passage")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last character of each sentence of the prose documents."""
    docs = table(spark, sf_dir, "documents").filter("doc_form = 'prose'")
    return sentences.split_sentences(docs, "doc_id", "text", with_text=False).select("doc_id", "end_char")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents, whatever their form."""
    return sentences.split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_top10, p5_found, p5_paragraphs, p6_pack, p6_report, p7_found, p7_items, p8_found, p8_sentences)}

_SPACE = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
_VECTORS = """vec AS (SELECT DISTINCT row_id, embedding::DOUBLE[64] AS e FROM doc_summary_index WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
ORACLES = {
    "p3_found": f"""WITH {_VECTORS} SELECT DISTINCT a.row_id AS row_id_a, b.row_id AS row_id_b FROM vec a JOIN vec b ON a.row_id < b.row_id
WHERE array_cosine_similarity(a.e, b.e) >= 0.9""",
    "p1_found": f"""SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY ingested_at DESC) AS rn FROM tree_node)
WHERE rn = 1 AND length(trim(text, {_SPACE})) > 1500""",
}
