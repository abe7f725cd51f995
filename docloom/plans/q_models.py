"""Queries of summaries, layout boxes, plug-ins, repair, sinks and progress over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import plugins
from docloom.functions import repair
from docloom.functions import text as X
from docloom.functions.common import table
from docloom.operators import boxes, summarise
from docloom.plans.q_tables import DOCS, NODES, WS, docs, nodes
from docloom.sources import sinks
from docloom.streaming import progress

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


_TERMS = r"w AS (SELECT doc_id, pos, t, i FROM (SELECT doc_id, pos, unnest(l) AS t, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, pos, regexp_extract_all(text, '[^\s\p{Z}]+') AS l FROM n))), tc AS (SELECT doc_id, t, count(*) AS n, min((pos, i)) AS f FROM w GROUP BY doc_id, t), tt AS (SELECT doc_id, t AS term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM tc)"
_TITLES = f"tx AS (SELECT doc_id, pos, unnest(path) AS t, unnest(range(0, len(path))) AS i FROM n), tf AS (SELECT doc_id, trim(t, {WS}) AS title, min((pos, i)) AS f FROM tx WHERE length(trim(t, {WS})) >= 2 GROUP BY ALL), ti AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS rank FROM tf)"
_PARAS = f"pf AS (SELECT doc_id, path[1] AS top, arg_min(trim(coalesce(text, ''), {WS}), pos) AS t, min(pos) AS p FROM n WHERE path[1] <> '' GROUP BY ALL), pa AS (SELECT doc_id, left(t, 200) AS paragraph, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rank FROM pf WHERE length(t) > 30)"


@register(f"WITH {NODES}, {_TERMS} SELECT doc_id, rank, term, n FROM tt WHERE rank <= 10")
def ag03_top_terms(spark, sf):
    return summarise.top_terms(nodes(spark, sf), "doc_id", "pos", "text").withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {NODES}, {_TITLES} SELECT doc_id, rank, title FROM ti WHERE rank <= 30")
def ag09_section_titles(spark, sf):
    return summarise.section_titles(nodes(spark, sf), "doc_id", "pos", "path").withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {NODES}, {_PARAS} SELECT doc_id, rank, paragraph FROM pa WHERE rank <= 8")
def ag10_first_paragraphs(spark, sf):
    return summarise.first_paragraphs(nodes(spark, sf), "doc_id", "pos", "path", "text").withColumn("rank", F.col("rank").cast("long"))


def _parts(spark, sf):
    n = nodes(spark, sf)
    return summarise.section_titles(n, "doc_id", "pos", "path"), summarise.first_paragraphs(n, "doc_id", "pos", "path", "text"), summarise.top_terms(n, "doc_id", "pos", "text")


@register(f"""WITH {NODES}, {_TERMS}, {_TITLES}, {_PARAS}, a AS (SELECT doc_id, string_agg(title, '；' ORDER BY rank) AS a FROM ti WHERE rank <= 30 GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(paragraph, '。' ORDER BY rank) AS b FROM pa WHERE rank <= 8 GROUP BY doc_id), c AS (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS c FROM tt WHERE rank <= 10 GROUP BY doc_id)
SELECT doc_id, left(concat_ws(chr(10), '目录：' || nullif(a, ''), '各章节摘要：' || nullif(b, ''), '关键词：' || nullif(c, '')), 6000) AS routing_text FROM a FULL JOIN b USING (doc_id) FULL JOIN c USING (doc_id)""")
def tx03_routing_text(spark, sf):
    titles, paragraphs, terms = _parts(spark, sf)
    return summarise.routing_text(titles, paragraphs, None, terms, "doc_id")


def _sentences(spark, sf) -> DataFrame:
    n = nodes(spark, sf).filter("is_leaf")
    return summarise.sentences(n, "doc_id", "pos", "text", X.chunk_weight(X.section_hint(F.col("title"), F.col("text")), F.lit(1)))


@register()
def tx02_textrank_mmr(spark, sf):
    return summarise.summaries(_sentences(spark, sf), "doc_id").withColumn("score", F.round("score", 6))


@register()
def tx03_routing_full(spark, sf):
    titles, paragraphs, terms = _parts(spark, sf)
    return summarise.routing_text(titles, paragraphs, summarise.summaries(_sentences(spark, sf), "doc_id"), terms, "doc_id")


@register(f"""WITH {DOCS}, r AS (SELECT doc_id, kb_id, fd_id, coalesce(trim(title, {WS}), '') AS t, coalesce(source_path, '') AS x, title FROM d), u AS (SELECT *, CASE WHEN t <> '' AND NOT contains(x, t) THEN t || chr(10) || x ELSE x END AS full_text FROM r)
SELECT doc_id, kb_id, fd_id, title, CASE WHEN length(trim(full_text, {WS})) < 10 THEN CASE WHEN t <> '' THEN t ELSE '未知文档' END ELSE full_text END AS routing_text, 'pdf' AS doc_type, 1 AS status FROM u""")
def tx04_router_record(spark, sf):
    return summarise.router_record(docs(spark, sf).withColumn("routing_text", F.col("source_path")))


@register(f"WITH {NODES}, t AS (SELECT doc_id, pos, left(text, 200) AS head, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM n WHERE coalesce(trim(text, {WS}), '') <> '') SELECT doc_id, string_agg(head, chr(10) ORDER BY rank) AS summary FROM t WHERE rank <= 3 GROUP BY doc_id")
def tx05_fallback_summary(spark, sf):
    return summarise.fallback_summary(nodes(spark, sf), "doc_id", "pos", "text")


@register("SELECT row_id, concat_ws(chr(10), '标题：' || nullif(title, ''), '摘要：' || nullif(summary, ''), '关键词：' || nullif(array_to_string(keywords, '、'), ''), '主题：' || nullif(array_to_string(topics, '、'), '')) AS routing FROM doc_summary_index")
def tx06_legacy_routing(spark, sf):
    d = table(spark, sf, "doc_summary_index")
    return d.select("row_id", summarise.legacy_routing(F.col("title"), F.col("summary"), F.col("keywords"), F.col("topics")).alias("routing"))


@register(f"WITH {NODES} SELECT doc_id, pos, CASE WHEN is_leaf THEN title END AS summary, CASE WHEN NOT is_leaf THEN title END AS prefix_summary FROM n")
def tx11_summary_keys(spark, sf):
    n = nodes(spark, sf)
    return n.select("doc_id", "pos", F.when(F.col("is_leaf"), F.col("title")).alias("summary"), F.when(~F.col("is_leaf"), F.col("title")).alias("prefix_summary"))


def _boxes(spark, sf) -> DataFrame:
    """Line items as boxes of a page per order: places from their figures."""
    l = table(spark, sf, "lineitem")
    x0 = F.pmod(F.col("l_partkey"), F.lit(5)) * 100.0
    top = F.col("l_linenumber") * 12.0
    kind = F.when(F.col("l_returnflag") == "R", "title").when(F.col("l_returnflag") == "A", "table").otherwise("text")
    return l.select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("no"), x0.alias("x0"), (x0 + 80.0 + F.col("l_quantity")).alias("x1"),
        top.alias("top"), (top + 13.0).alias("bottom"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("text"), kind.alias("layout_type"),
    )


@register()
def ln16_merged_lines(spark, sf):
    return boxes.merge_lines(_boxes(spark, sf), "doc")


@register()
def ln17_merged_paragraphs(spark, sf):
    return boxes.merge_paragraphs(_boxes(spark, sf), "doc")


_BOX = "bx AS (SELECT l_orderkey AS doc, l_linenumber AS no, (l_partkey % 5) * 100.0::DOUBLE AS x0, l_linenumber * 12.0::DOUBLE AS top FROM lineitem)"


@register(f"""WITH {_BOX}, e AS (SELECT doc, list_sort(list(x0)) AS e FROM bx GROUP BY doc), c AS (SELECT bx.*, e, CASE WHEN len(e) > 1 THEN (e[-1] - e[1]) / (len(e) - 1) * 2 ELSE 0 END AS gap FROM bx JOIN e USING (doc)),
k AS (SELECT *, CASE WHEN gap <= 0 THEN 0 ELSE list_position(list_transform(e, lambda x: abs(x0 - x) < gap), true) - 1 END AS col FROM c)
SELECT doc, no, CAST(col AS INTEGER) AS "column", CAST(row_number() OVER (PARTITION BY doc ORDER BY col, top, x0, no) AS INTEGER) AS reading_no FROM k""")
def tk09_reading_order(spark, sf):
    return boxes.reading_order(_boxes(spark, sf), "doc").select("doc", "no", "column", "reading_no")


@register()
def snk08_box_markdown(spark, sf):
    return boxes.markdown(boxes.reading_order(_boxes(spark, sf), "doc"), "doc")


@register()
def sc23_json_repair(spark, sf):
    return table(spark, sf, "doc_tree").select("tree_id", "received_at", F.length(repair.repaired(F.col("payload"))).alias("n"))


@register(r"SELECT event_id, trim(CASE WHEN regexp_extract('```json' || props || '```', '```json\s*([\s\S]*)```', 1) = '' THEN props ELSE regexp_extract('```json' || props || '```', '```json\s*([\s\S]*)```', 1) END) AS body FROM events")
def sc24_fenced(spark, sf):
    return table(spark, sf, "events").select("event_id", repair.fenced(F.concat(F.lit("```json"), "props", F.lit("```"))).alias("body"))


@register()
def ud01_embedded(spark, sf):
    e = plugins.embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.round(F.try_element_at("embedding", F.lit(1)), 4).alias("first"), F.size("embedding").alias("dim"))


@register()
def ud03_reranked(spark, sf):
    d = table(spark, sf, "doc_summary_index").select("row_id", "summary").distinct()
    r = plugins.rerank(d, "summary", plugins.overlap_reranker("landing pad parser certification"))
    return r.filter(X.sigmoid(F.col("rerank")) >= 0.5).select("row_id", "rerank")


@register()
def ud09_toc_pages(spark, sf):
    n = nodes(spark, sf).select("doc_id", "pos", "text", X.toc_page(F.col("text")).alias("answer"))
    return plugins.ask_if_unknown(n, "answer", "text").select("doc_id", "pos", "answer")


@register()
def snk06_tree_json(spark, sf):
    return sinks.tree_json(nodes(spark, sf)).select("doc_id", "json")


@register(f"WITH {NODES} SELECT doc_id, string_agg('<!-- chunk: ' || title || ' p' || start_index || '-' || end_index || ' -->' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS text FROM n WHERE level = 0 AND text <> '' AND title IS NOT NULL AND start_index IS NOT NULL AND end_index IS NOT NULL GROUP BY doc_id")
def snk07_merged_markdown(spark, sf):
    n = nodes(spark, sf).filter("level = 0 and title is not null and start_index is not null and end_index is not null")
    return sinks.merged_markdown(n.select("doc_id", F.col("pos").alias("no"), "title", F.col("start_index").alias("first"), F.col("end_index").alias("last"), F.col("text").alias("md")), "doc_id")


@register(f"WITH {DOCS} SELECT doc_id, kb_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM d WHERE status = 'error') UNION ALL SELECT doc_id, 'again' FROM d WHERE status = 'error'")
def snk02_replace_documents(spark, sf):
    from docloom.operators.catalog import replace_documents

    d = docs(spark, sf).select("doc_id", "kb_id", "status")
    again = d.filter("status = 'error'").select("doc_id", F.lit("again").alias("kb_id"))
    return replace_documents(d.select("doc_id", "kb_id"), again)


@register("SELECT event_id, user_id, coalesce(round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 2), 0) AS seconds FROM events")
def pl17_message_log(spark, sf):
    return progress.message_log(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "seconds")


@register()
def pl18_progress(spark, sf):
    e = table(spark, sf, "events")
    return progress.suppress(e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.least(F.lit(100), F.floor("value")).alias("percent")))
