"""Queries of catalogue, search, lines, chunks, trees and tables of contents over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.common import WHITE_SPACE, current_rows, strip, table
from docloom.operators import catalog, chunk, lines, search, toc, tree
from docloom.plans.q_text import tokens_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
NODES = "n AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY ingested_at DESC) AS rn FROM tree_node) WHERE rn = 1)"
DOCS = "d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY update_time DESC) AS rn FROM kb_document) WHERE rn = 1)"
FOLDERS = f"""f AS (SELECT * EXCLUDE (rn) FROM (SELECT lower(trim(fd_id, {WS})) AS fd_id, name, coalesce(lower(trim(parent_id, {WS})), '') AS parent_id, kb_id, path, level,
row_number() OVER (PARTITION BY lower(trim(fd_id, {WS})) ORDER BY update_time DESC) AS rn FROM folder) WHERE rn = 1)"""
VEC = "v AS (SELECT DISTINCT row_id, doc_id, kb_id, fd_id, summary, title, routing_text, embedding::DOUBLE[64] AS e FROM doc_summary_index WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
#: The vector and the words of the sample query.
QUERY = [round(0.9 - 0.37 * (i * 7 % 11) + 0.05 * i, 3) for i in range(64)]
TERMS = ["parser", "certification", "噪", "landeplatz"]
QSQL = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[64]"


def register(sql: str | None = None) -> Callable:
    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "tree_node"), ["doc_id", "pos"], "ingested_at")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return current_rows(table(spark, sf, "kb_document"), ["doc_id"], "update_time")


def folders(spark: SparkSession, sf: str) -> DataFrame:
    low = lambda c: F.lower(strip(c))
    f = table(spark, sf, "folder").select(low("fd_id").alias("fd_id"), "name", F.coalesce(low("parent_id"), F.lit("")).alias("parent_id"), "kb_id", "path", "level", "update_time")
    return current_rows(f, ["fd_id"], "update_time").drop("update_time")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "doc_summary_index").select("row_id", "doc_id", "kb_id", "fd_id", "summary", "title", "routing_text", "embedding").filter("size(embedding) = 64")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return v.filter(fine).dropDuplicates(["row_id"])


# ---- catalogue

_PAGE = "SELECT doc_id, title, status FROM d {where} ORDER BY doc_id LIMIT 50 OFFSET {skip}"


def _page(spark, sf, skip=0, **equal):
    return catalog.page(docs(spark, sf), ["doc_id"], skip, 50, **equal).select("doc_id", "title", "status")


_KB = "(SELECT kb_id FROM d GROUP BY kb_id ORDER BY count(*) DESC, kb_id LIMIT 1)"


def _top_kb(spark, sf):
    return docs(spark, sf).groupBy("kb_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kb_id").limit(1)


@register(f"WITH {DOCS} SELECT doc_id, title, status FROM d WHERE doc_id = (SELECT min(doc_id) FROM d)")
def rel01_lookup(spark, sf):
    d = docs(spark, sf)
    return catalog.lookup(d, "doc_id", d.agg(F.min("doc_id")).scalar()).select("doc_id", "title", "status")


@register(f"WITH {DOCS} " + _PAGE.format(where=f"WHERE kb_id = {_KB}", skip=10))
def rel02_by_kb(spark, sf):
    return _page(spark, sf, 10, kb_id=_top_kb(spark, sf).select("kb_id").scalar())


@register(f"WITH {DOCS} " + _PAGE.format(where=f"WHERE fd_id = '0' AND kb_id = {_KB}", skip=0))
def rel03_by_folder(spark, sf):
    return _page(spark, sf, 0, fd_id="0", kb_id=_top_kb(spark, sf).select("kb_id").scalar())


@register(f"WITH {DOCS} " + _PAGE.format(where="WHERE status = 'ready'", skip=20))
def rel04_by_status(spark, sf):
    return _page(spark, sf, 20, status="ready")


@register(f"WITH {DOCS} " + _PAGE.format(where="", skip=5))
def rel05_all(spark, sf):
    return _page(spark, sf, 5)


@register(f"WITH {DOCS} SELECT doc_id, CASE WHEN status = 'error' THEN 'uploaded' ELSE status END AS status FROM d")
def rel06_update(spark, sf):
    return catalog.update(docs(spark, sf), F.col("status") == "error", {"status": F.lit("uploaded")}).select("doc_id", "status")


@register(f"WITH {DOCS} SELECT doc_id, status FROM d WHERE status IS NULL OR status <> 'error'")
def rel07_delete(spark, sf):
    return catalog.delete(docs(spark, sf), F.col("status") == "error").select("doc_id", "status")


@register(f"WITH {DOCS} SELECT doc_id, status FROM d UNION ALL SELECT 'new', 'uploaded'")
def rel08_insert(spark, sf):
    d = docs(spark, sf).select("doc_id", "status")
    return catalog.insert(d, spark.sql("SELECT 'new' AS doc_id, 'uploaded' AS status"))


@register(f"WITH {DOCS} SELECT created_by, source_path FROM d WHERE created_by = (SELECT min(created_by) FROM d) ORDER BY source_path, doc_id LIMIT 50")
def rel11_files_by_creator(spark, sf):
    d = docs(spark, sf)
    return catalog.page(d, ["source_path", "doc_id"], 0, 50, created_by=d.agg(F.min("created_by")).scalar()).select("created_by", "source_path")


@register(f"WITH {FOLDERS} SELECT parent_id, count(*) AS children FROM f WHERE parent_id NOT IN ('', '0') GROUP BY parent_id")
def rel12_children(spark, sf):
    return folders(spark, sf).filter(~catalog.no_parent(F.col("parent_id"))).groupBy("parent_id").agg(F.count("*").alias("children"))


@register(f"WITH {FOLDERS} SELECT kb_id, CASE WHEN parent_id IN ('', '0') THEN '0' ELSE parent_id END AS parent_id, name, count(*) AS folders FROM f GROUP BY ALL HAVING count(*) > 1")
def rel13_same_name(spark, sf):
    return catalog.siblings_with_name(folders(spark, sf))


_IDS = f"list_filter(list_transform(string_split(path, ','), lambda x: lower(trim(x, {WS}))), lambda x: x <> '')"


@register(f"WITH {FOLDERS} SELECT fd_id, count(*) AS folders FROM (SELECT unnest({_IDS}) AS fd_id FROM f) GROUP BY fd_id")
def rel15_descendant_counts(spark, sf):
    return catalog.descendant_counts(folders(spark, sf))


@register(f"WITH {FOLDERS}, pick AS (SELECT fd_id FROM f WHERE parent_id IN ('', '0') ORDER BY fd_id LIMIT 3) SELECT DISTINCT fd_id, level FROM f WHERE len(list_intersect({_IDS}, (SELECT list(fd_id) FROM pick))) > 0")
def rel16_below(spark, sf):
    f = folders(spark, sf)
    pick = f.filter(catalog.no_parent(F.col("parent_id"))).orderBy("fd_id").limit(3)
    return catalog.below(f, [r["fd_id"] for r in pick.select("fd_id").collect()]).select("fd_id", "level").distinct()


@register(f"WITH {DOCS} SELECT doc_id, file_type FROM d WHERE status IN ('ready', 'error') AND file_type = 'pdf' ORDER BY doc_id DESC LIMIT 40 OFFSET 3")
def rel18_search(spark, sf):
    return catalog.search(docs(spark, sf), ["doc_id", "file_type"], {"status": ["ready", "error"], "file_type": "pdf"}, [("doc_id", 1)], 3, 40)


@register("SELECT row_id, title FROM doc_summary_index WHERE len(list_intersect(['report', 'noise', 'survey', 'map'], regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}_]+'))) >= 1")
def rel26_match(spark, sf):
    table(spark, sf, "doc_summary_index").select("row_id", F.col("title").alias("title_tks")).createOrReplaceTempView("docloom_router")
    return catalog.run_sql(spark, "SELECT row_id,  title_tks AS title FROM docloom_router WHERE title_tks LIKE '%report noise survey map%'")


@register(f"WITH {DOCS} SELECT status, count(*) AS doc_count FROM d GROUP BY status")
def ag07_buckets(spark, sf):
    return catalog.search(docs(spark, sf), [], count_by=["status"])


@register(f"WITH {DOCS} SELECT count(*) AS total FROM d")
def ag08_total(spark, sf):
    return docs(spark, sf).agg(F.count("*").alias("total"))


@register(f"WITH {NODES} SELECT doc_id, count(*) AS chunks FROM n WHERE is_leaf GROUP BY doc_id")
def ag16_chunk_counts(spark, sf):
    return nodes(spark, sf).filter("is_leaf").groupBy("doc_id").agg(F.count("*").alias("chunks"))


@register(f"SELECT CAST(sum({tokens_sql('text')}) AS BIGINT) AS tokens FROM documents")
def ag17_tokens(spark, sf):
    return table(spark, sf, "documents").agg(F.sum(X.tokens_mixed(F.col("text"))).alias("tokens"))


@register(f"WITH {DOCS} SELECT doc_id, status, progress, progress_msg, chunk_num, process_duration FROM d WHERE chunk_num IS NOT NULL AND progress IS NOT NULL AND process_duration IS NOT NULL")
def pl22_status(spark, sf):
    return docs(spark, sf).filter("chunk_num is not null and progress is not null and process_duration is not null").select("doc_id", "status", "progress", "progress_msg", "chunk_num", "process_duration")


@register(f"WITH {DOCS} SELECT doc_id, title FROM d WHERE status = 'uploaded' ORDER BY doc_id LIMIT 100")
def pl20_uploaded(spark, sf):
    return catalog.page(docs(spark, sf), ["doc_id"], 0, 100, status="uploaded").select("doc_id", "title")


@register("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in X.PARSERS.items()) + ") AS t(extension, parser)")
def pl24_formats(spark, sf):
    return spark.createDataFrame(list(X.PARSERS.items()), "extension string, parser string")


# ---- search

_COS = f"array_cosine_similarity(e, {QSQL})"
_KNN = f"SELECT row_id, {_COS} AS score FROM v ORDER BY score DESC, row_id LIMIT 100"
_TOK = "regexp_extract_all(regexp_replace(lower(coalesce({t}, '')), '([\\x{{4e00}}-\\x{{9fff}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+')"


def bm25_sql(source: str, key: str, text: str, terms: list[str]) -> str:
    """CTEs t, s and a final select of key and score."""
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    any_ = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"SELECT {key}, {score} AS score FROM (SELECT {key}, dl, {', '.join(f'tf{i}' for i in range(len(terms)))} FROM (SELECT {key}, len(w) AS dl, {tf} FROM (SELECT {key}, {_TOK.format(t=text)} AS w FROM {source}))) t, (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM (SELECT len(w) AS dl, {tf} FROM (SELECT {_TOK.format(t=text)} AS w FROM {source}))) s WHERE {any_}"


@register(f"WITH {VEC} SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {_COS} AS score FROM v WHERE kb_id IN (SELECT kb_id FROM knowledge_base WHERE type = 'public') ORDER BY score DESC, doc_id LIMIT 5)")
def tk01_route(spark, sf):
    kb = table(spark, sf, "knowledge_base").filter("type = 'public'").select("kb_id")
    v = vectors(spark, sf).join(kb, "kb_id", "left_semi")
    return search.knn(v, "doc_id", "embedding", QUERY, 5).select("doc_id", F.round("score", 6).alias("score"))


@register(f"WITH {VEC} SELECT row_id, round(score, 6) AS score FROM ({_KNN})")
def tk02_knn(spark, sf):
    return search.knn(vectors(spark, sf), "row_id", "embedding", QUERY, 100).select("row_id", F.round("score", 6).alias("score"))


@register(f"SELECT doc_id, round(score, 6) AS score FROM ({bm25_sql('documents', 'doc_id', 'text', TERMS)}) ORDER BY score DESC, doc_id LIMIT 100")
def tk03_bm25(spark, sf):
    hits = search.bm25_scores(table(spark, sf, "documents"), "doc_id", "text", TERMS).select("doc_id", F.round("score", 6).alias("score"))
    return hits.orderBy(F.desc("score"), "doc_id").limit(100)


@register(f"""WITH {VEC}, hits AS ({bm25_sql('v', 'row_id', 'routing_text', TERMS)}), hits2 AS ({bm25_sql('v', 'row_id', 'title', TERMS)}), hits3 AS ({bm25_sql('v', 'row_id', 'summary', TERMS)})
SELECT row_id, round(sum(score), 6) AS score FROM (SELECT row_id, score * 2 AS score FROM hits UNION ALL SELECT row_id, score * 3 FROM hits2 UNION ALL SELECT row_id, score * 1.5::DOUBLE FROM hits3) GROUP BY row_id ORDER BY score DESC, row_id LIMIT 10""")
def tk04_multi_field(spark, sf):
    hits = search.multi_field(vectors(spark, sf), "row_id", {"routing_text": 2.0, "title": 3.0, "summary": 1.5}, TERMS, 1000)
    return hits.select("row_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "row_id").limit(10)


_RRF = f"""knn AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM ({_KNN})),
bm AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM (SELECT row_id, score FROM ({bm25_sql('v', 'row_id', 'summary', TERMS)}) ORDER BY score DESC, row_id LIMIT 100)),
rrf AS (SELECT row_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM knn UNION ALL SELECT * FROM bm) GROUP BY row_id)"""


def _fused(spark, sf):
    v = vectors(spark, sf)
    return search.fuse([search.knn(v, "row_id", "embedding", QUERY, 100), search.bm25(v, "row_id", "summary", TERMS, 100)], "row_id")


@register(f"WITH {VEC}, {_RRF} SELECT row_id, round(score, 6) AS score FROM rrf")
def wn02_rrf(spark, sf):
    return _fused(spark, sf).select("row_id", F.round("score", 6).alias("score"))


@register(f"WITH {VEC}, {_RRF} SELECT row_id, round(score, 6) AS score FROM rrf WHERE score >= 0.015")
def tk05_rrf_cut(spark, sf):
    return _fused(spark, sf).filter(F.col("score") >= search.RRF_CUT).select("row_id", F.round("score", 6).alias("score"))


@register(f"""WITH {VEC}, {_RRF} SELECT count(*) AS hits, count(knn.row_id) AS near, count(bm.row_id) AS worded FROM rrf LEFT JOIN knn USING (row_id) LEFT JOIN bm USING (row_id)""")
def jn02_full_outer(spark, sf):
    v = vectors(spark, sf)
    a = search.knn(v, "row_id", "embedding", QUERY, 100).select("row_id", F.lit(1).alias("a"))
    b = search.bm25(v, "row_id", "summary", TERMS, 100).select("row_id", F.lit(1).alias("b"))
    return a.join(b, "row_id", "full_outer").agg(F.count("*").alias("hits"), F.count("a").alias("near"), F.count("b").alias("worded"))


@register(f"WITH {VEC}, {NODES}, routed AS (SELECT doc_id FROM (SELECT doc_id, {_COS} AS score FROM v ORDER BY score DESC, doc_id LIMIT 200)) SELECT doc_id, pos, is_leaf FROM n WHERE doc_id IN (SELECT doc_id FROM routed)")
def jn03_routed_nodes(spark, sf):
    routed = search.knn(vectors(spark, sf), "doc_id", "embedding", QUERY, 200).select("doc_id").distinct()
    return nodes(spark, sf).join(F.broadcast(routed), "doc_id", "left_semi").select("doc_id", "pos", "is_leaf")  # at most 200 rows


_PUB = "(SELECT kb_id FROM knowledge_base WHERE type = 'public')"


@register(
    f"""WITH {VEC}, pv AS (SELECT * FROM v WHERE doc_id IN (SELECT doc_id FROM (SELECT doc_id, {_COS} AS score FROM v WHERE kb_id IN {_PUB} ORDER BY score DESC, doc_id LIMIT 200))),
knn AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM (SELECT row_id, {_COS} AS score FROM pv ORDER BY score DESC, row_id LIMIT 100)),
bm AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM (SELECT row_id, score FROM ({bm25_sql('pv', 'row_id', 'summary', TERMS)}) ORDER BY score DESC, row_id LIMIT 100)),
rrf AS (SELECT row_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM knn UNION ALL SELECT * FROM bm) GROUP BY row_id)
SELECT row_id AS chunk_id, doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, row_id) AS rank FROM (SELECT * FROM rrf WHERE score >= 0.015 ORDER BY score DESC, row_id LIMIT 10) JOIN v USING (row_id)"""
)
def pl01_rag_search(spark, sf):
    v = vectors(spark, sf)
    kb = [r["kb_id"] for r in table(spark, sf, "knowledge_base").filter("type = 'public'").select("kb_id").collect()]  # one row per knowledge base
    chunks = v.select(F.col("row_id").alias("chunk_id"), "doc_id", F.col("summary").alias("text"), "embedding")
    return search.rag_search(v, chunks, QUERY, TERMS, kb_ids=kb, route_k=200, topk=10).select("chunk_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("SELECT event_id, round(CASE WHEN hi = lo THEN 1 ELSE (value - lo) / (hi - lo) END, 6) AS normal FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type))")
def wn03_minmax(spark, sf):
    return search.normalise(table(spark, sf, "events"), "value", ["event_type"], "minmax").select("event_id", F.round("normal", 6).alias("normal"))


@register("SELECT event_id, round(CASE WHEN sd = 0 THEN 0 ELSE greatest(-1, least(1, (value - m) / sd)) END, 6) AS normal FROM (SELECT *, avg(value) OVER w AS m, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(value) OVER w END AS sd FROM events WINDOW w AS (PARTITION BY event_type))")
def wn04_zscore(spark, sf):
    return search.normalise(table(spark, sf, "events"), "value", ["event_type"], "zscore").select("event_id", F.round("normal", 6).alias("normal"))


@register("SELECT event_id, round(CASE WHEN n = 1 THEN 1 ELSE (upto - 1) / (n - 1) END, 6) AS normal FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n, count(*) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS upto FROM events)")
def wn05_percentile(spark, sf):
    return search.normalise(table(spark, sf, "events"), "value", ["event_type"], "percentile").select("event_id", F.round("normal", 6).alias("normal"))


@register("SELECT event_id, user_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS r, round(s, 6) AS score FROM (SELECT *, 1 / (1 + exp(-(value - 50) / 20)) AS s FROM events) WHERE s >= 0.5) WHERE r <= 10")
def tk06_rerank_cut(spark, sf):
    e = table(spark, sf, "events").withColumn("raw", (F.col("value") - 50) / 20)
    return search.rerank_cut(e, "raw", "event_id", ["user_id"]).select("event_id", "user_id", F.round("score", 6).alias("score"))


@register(f"WITH {NODES}, r AS (SELECT title, arg_max(pos, pos) AS score FROM n WHERE title IS NOT NULL GROUP BY title) SELECT doc_id, n.pos, CAST(coalesce(score, 0) AS DOUBLE) AS rerank FROM n LEFT JOIN r ON n.title = r.title")
def jn05_rerank_join(spark, sf):
    n = nodes(spark, sf)
    replies = n.filter("title is not null").select("title", F.col("pos").cast("double").alias("score"), F.col("pos").alias("place"))
    return search.attach_scores(n.select("doc_id", "pos", "title"), replies, "title").select("doc_id", "pos", "rerank")


@register(f"WITH {NODES} SELECT doc_id, pos, array_to_string(list_sort(list_filter(range(start_index - 1, greatest(start_index, coalesce(end_index, start_index)) + 2), lambda p: p > 0)), ',') AS pages FROM n WHERE start_index IS NOT NULL")
def jn08_neighbours(spark, sf):
    n = nodes(spark, sf).filter("start_index is not null")
    pages = F.sequence("start_index", F.greatest("start_index", F.coalesce("end_index", "start_index")))
    return n.select("doc_id", "pos", F.array_join(search.neighbour_pages(pages), ",").alias("pages"))


@register(f"""WITH {NODES}, p AS (SELECT DISTINCT doc_id, page FROM (SELECT doc_id, unnest(range(start_index - 1, start_index + 2)) AS page FROM n WHERE is_leaf AND start_index IS NOT NULL AND contains(coalesce(title, ''), 'Appendix')) WHERE page > 0)
SELECT DISTINCT n.doc_id, n.pos FROM n JOIN p ON n.doc_id = p.doc_id AND p.page BETWEEN n.start_index AND n.end_index""")
def jn09_expanded(spark, sf):
    n = nodes(spark, sf)
    hit = n.filter(F.col("is_leaf") & F.col("start_index").isNotNull() & F.coalesce(F.contains("title", F.lit("Appendix")), F.lit(False)))
    pages = hit.select("doc_id", F.explode(search.neighbour_pages(F.array("start_index"))).alias("page")).distinct()
    # an equi-join on document and page, not a range join
    own = n.filter("start_index <= end_index").select("doc_id", "pos", F.explode(F.sequence("start_index", "end_index")).alias("page"))
    return own.join(pages, ["doc_id", "page"]).select("doc_id", "pos").distinct()


@register(f"WITH {VEC}, {_RRF} SELECT doc_id, CAST(min(r) AS BIGINT) AS rank FROM (SELECT row_id, row_number() OVER (ORDER BY score DESC, row_id) AS r FROM rrf) JOIN v USING (row_id) GROUP BY doc_id")
def ag11_hit_documents(spark, sf):
    r = search.ranked(_fused(spark, sf), "row_id").join(vectors(spark, sf).select("row_id", "doc_id"), "row_id")
    return r.groupBy("doc_id").agg(F.min("rank").cast("long").alias("rank"))


# ---- lines

_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '')"
_REP = f"""size AS (SELECT doc_id, count(*) AS total FROM n GROUP BY doc_id HAVING count(*) > 1),
rep AS (SELECT l.doc_id, line, count(*) AS pages FROM (SELECT doc_id, unnest(list_distinct({_LINES})) AS line FROM n) l JOIN size USING (doc_id) GROUP BY l.doc_id, line, total HAVING count(*) / total >= 0.6)"""


@register(f"WITH {NODES}, {_REP} SELECT doc_id, line, pages FROM rep")
def ag01_repeated_lines(spark, sf):
    return lines.repeated(nodes(spark, sf), "doc_id", "text")


@register(f"""WITH {NODES}, {_REP}, noise AS (SELECT doc_id, list(line) AS l FROM rep GROUP BY doc_id)
SELECT n.doc_id, pos, CASE WHEN l IS NULL THEN array_to_string(coalesce({_LINES}, []), chr(10)) ELSE array_to_string(coalesce(list_filter({_LINES}, lambda x: NOT list_contains(l, x)), []), chr(10)) END AS text FROM n LEFT JOIN noise USING (doc_id)""")
def jn04_drop_repeated(spark, sf):
    return lines.without_repeated(nodes(spark, sf), "doc_id", "pos", "text")


_HF = f"""size AS (SELECT doc_id, count(*) AS total FROM n GROUP BY doc_id HAVING count(*) >= 3), l AS (SELECT doc_id, coalesce({_LINES}, []) AS l FROM n),
cand AS (SELECT doc_id, 'header' AS side, CASE WHEN i > 2 AND length(l[i]) > 15 THEN left(l[i], 13) ELSE l[i] END AS line FROM (SELECT doc_id, l, unnest(range(1, least(3, len(l)) + 1)) AS i FROM l)
UNION ALL SELECT doc_id, 'footer', l[i] FROM (SELECT doc_id, l, unnest(range(greatest(1, len(l) - 2), len(l) + 1)) AS i FROM l)),
hf AS (SELECT doc_id, side, line, count(*) AS n FROM cand JOIN size USING (doc_id) GROUP BY doc_id, side, line, total HAVING count(*) >= floor(total * 0.5) AND length(line) <= 30)"""


@register(f"WITH {NODES}, {_HF} SELECT doc_id, side, line, n FROM hf")
def ag02_heads_and_feet(spark, sf):
    return lines.heads_and_feet(nodes(spark, sf), "doc_id", "text")


@register()
def ln04_strip_heads_and_feet(spark, sf):
    return lines.strip_heads_and_feet(nodes(spark, sf).filter("text is not null"), "doc_id", "pos", "text")


@register()
def ln06_merge_broken(spark, sf):
    return nodes(spark, sf).filter("text is not null").select("doc_id", "pos", lines.merge_broken(F.col("text")).alias("text"))


# ---- chunks


@register(f"""SELECT doc_id, i, trim(substring(text, i * 1350 + 1, 1500), {WS}) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1500) / 1350)) AS BIGINT) + 1)) AS i FROM documents WHERE trim(text, {WS}) <> '')
WHERE trim(substring(text, i * 1350 + 1, 1500), {WS}) <> ''""")
def ck02_windows(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", F.explode(chunk.windows(F.col("text"))).alias("w"))
    return w.select("doc_id", F.col("w.i").cast("long").alias("i"), F.col("w.piece").alias("piece"))


@register(f"""WITH w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, piece FROM (SELECT doc_id, i, trim(substring(text, i * 1350 + 1, 1500), {WS}) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1500) / 1350)) AS BIGINT) + 1)) AS i FROM documents WHERE trim(text, {WS}) <> '')) WHERE piece <> '')
SELECT doc_id, no, '第 ' || no || ' 段：' || replace(left(piece, 30), chr(10), ' ') || '...' AS title, piece FROM w""")
def ck03_window_nodes(spark, sf):
    return chunk.window_nodes(table(spark, sf, "documents"), "doc_id", "text").withColumn("no", F.col("no").cast("long"))


@register()
def ck01_pack_paragraphs(spark, sf):
    p = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.posexplode(chunk.pack_paragraphs(F.col("text"))).alias("no", "piece"))
    return p.withColumn("title", F.left(F.split_part("piece", F.lit("\n"), F.lit(1)), F.lit(50)))


_MD = rf"""ml AS (SELECT doc_id, i, line, trim(line, {WS}) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_form = 'markdown' AND text IS NOT NULL)),
fl AS (SELECT *, sum(CASE WHEN starts_with(s, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) % 2 AS code FROM ml)"""


@register(f"WITH {_MD} SELECT doc_id, i + 1 AS line_no, length(regexp_extract(s, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(s, '^#{{1,6}}\\s+(.+)$', 1), {WS}) AS title FROM fl WHERE code = 0 AND regexp_matches(s, '^#{{1,6}}\\s+\\S')")
def ck05_headings(spark, sf):
    h = chunk.headings(table(spark, sf, "documents").filter("doc_form = 'markdown'"), "doc_id", "text")
    return h.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("level").cast("long").alias("level"), "title")


@register(rf"""WITH {_MD}, h AS (SELECT *, CASE WHEN code = 0 AND regexp_matches(regexp_replace(line, '[\s\p{{Z}}]+$', ''), '^#{{1,6}}\s+\S') THEN 1 ELSE 0 END AS head FROM fl),
s AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sec FROM h)
SELECT doc_id, min(i) + 1 AS line_no, trim(coalesce(string_agg(CASE WHEN head = 0 THEN line END, chr(10) ORDER BY i), ''), {WS}) AS body FROM s WHERE sec > 0 GROUP BY doc_id, sec""")
def ck04_sections(spark, sf):
    s = chunk.sections(table(spark, sf, "documents").filter("doc_form = 'markdown'"), "doc_id", "text")
    return s.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "body")


@register(f"WITH {NODES}, p AS (SELECT doc_id, pos, title, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, {WS})), lambda x: x <> '') AS parts FROM n WHERE is_leaf) SELECT doc_id, pos, no, coalesce(title, '') || ' - 段落' || no AS title, parts[no] AS piece FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS no FROM p WHERE len(parts) > 1)")
def ck13_paragraphs(spark, sf):
    p = chunk.paragraph_nodes(nodes(spark, sf).filter("is_leaf"), ["doc_id", "pos"], "title", "text")
    return p.select("doc_id", "pos", F.col("no").cast("long").alias("no"), "title", "piece")


@register(f"WITH {NODES} SELECT doc_id, string_agg('=== 第 ' || pos || ' 页 ===' || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS text FROM n WHERE trim(text, {WS}) <> '' GROUP BY doc_id")
def ck14_page_banners(spark, sf):
    return chunk.concat_pages(nodes(spark, sf), "doc_id", "pos", "text", "banner")


@register(f"WITH {NODES} SELECT doc_id, string_agg('<physical_index_' || pos || '>' || chr(10) || coalesce(text, '') || chr(10) || '<physical_index_' || pos || '>' || chr(10) || chr(10), '' ORDER BY pos) AS text FROM n GROUP BY doc_id")
def ck15_page_tags(spark, sf):
    return chunk.concat_pages(nodes(spark, sf), "doc_id", "pos", "text", "tags")


@register(f"WITH {NODES} SELECT doc_id, string_agg(coalesce(text, ''), '' ORDER BY pos) AS text FROM n GROUP BY doc_id")
def src08_whole_text(spark, sf):
    return chunk.concat_pages(nodes(spark, sf), "doc_id", "pos", "text", "plain")


@register()
def ck10_page_groups(spark, sf):
    n = nodes(spark, sf).select("doc_id", "pos", X.tokens_mixed(F.col("text")).alias("tokens"))
    return chunk.page_groups(n, "doc_id", "pos", "tokens", 4000)


@register()
def ck07_thinned(spark, sf):
    return chunk.thin(nodes(spark, sf), "doc_id", "pos", "level", "text", 400)


@register(f"WITH {NODES}, t AS (SELECT doc_id, CAST(max(end_index) AS INTEGER) AS t FROM n GROUP BY doc_id) SELECT doc_id, CAST((a - 1) // 10 + 1 AS INTEGER) AS no, '第 ' || a || '-' || least(a + 9, t) || ' 页' AS title, CAST(a AS INTEGER) AS first, CAST(least(a + 9, t) AS INTEGER) AS last FROM (SELECT *, unnest(range(1, t + 1, 10)) AS a FROM t WHERE t > 0)")
def wn18_fixed_pages(spark, sf):
    d = nodes(spark, sf).groupBy("doc_id").agg(F.max("end_index").alias("t"))
    return chunk.fixed_pages(d, "doc_id", "t")


# ---- trees

_PAR = "LEFT JOIN LATERAL (SELECT max(b.pos) AS parent FROM n b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level) p ON true"


@register(f"WITH {NODES} SELECT a.doc_id, a.pos, coalesce(p.parent, -1) AS parent FROM n a {_PAR}")
def wn13_parents(spark, sf):
    return tree.parents(nodes(spark, sf), "doc_id", "pos", "level").select("doc_id", "pos", F.coalesce("parent", F.lit(-1)).alias("parent"))


@register(f"WITH {NODES} SELECT doc_id, pos, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS VARCHAR), 4, '0') AS new_id FROM n")
def wn11_node_ids(spark, sf):
    return tree.node_ids(nodes(spark, sf), "doc_id", "pos").select("doc_id", "pos", "new_id")


@register(f"WITH {NODES} SELECT doc_id, pos, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR), 4, '0') AS new_id FROM n")
def wn12_node_ids_from_one(spark, sf):
    return tree.node_ids(nodes(spark, sf), "doc_id", "pos", 1).select("doc_id", "pos", "new_id")


_CODE = "c AS (SELECT doc_id, pos, array_to_string(list_transform(path, lambda x: CAST(length(x) AS VARCHAR)), '.') AS code FROM n)"


@register(f"WITH {NODES}, {_CODE} SELECT a.doc_id, a.pos, coalesce(max(b.pos), -1) AS parent_pos FROM c a LEFT JOIN c b ON a.doc_id = b.doc_id AND b.pos < a.pos AND contains(a.code, '.') AND b.code = regexp_replace(a.code, '\\.[^.]*$', '') GROUP BY a.doc_id, a.pos")
def jn06_dotted_parents(spark, sf):
    c = nodes(spark, sf).select("doc_id", "pos", F.array_join(F.transform("path", lambda x: F.length(x).cast("string")), ".").alias("code"))
    return tree.dotted_parents(c, "doc_id", "code", "pos").select("doc_id", "pos", F.coalesce("parent_pos", F.lit(-1)).alias("parent_pos"))


@register(f"WITH {NODES} SELECT doc_id, pos, title FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.doc_id = n.doc_id AND b.parent_pos = n.pos)")
def tr03_leaves(spark, sf):
    return tree.leaves(nodes(spark, sf), "doc_id", "pos", "parent_pos").select("doc_id", "pos", "title")


@register(f"WITH {NODES}, l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.doc_id = n.doc_id AND b.parent_pos = n.pos)) SELECT doc_id, pos, coalesce(nullif(node_id, ''), 'gen_id_' || lpad(CAST(k - 1 AS VARCHAR), 5, '0')) AS section_id, array_to_string(path, ' > ') AS section_path, trim(replace(string_split(coalesce(text, ''), '【原始数据内容】:')[-1], chr(10), ' '), {WS}) AS original_snippet FROM l")
def tr01_leaf_rows(spark, sf):
    rows = tree.leaf_rows(nodes(spark, sf), "doc_id", "pos", "parent_pos")
    return rows.select("doc_id", "pos", "section_id", F.array_join("section_path", " > ").alias("section_path"), "original_snippet")


_UNTIL = "u AS (SELECT a.doc_id, a.pos, min(b.pos) AS until FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY a.doc_id, a.pos)"


@register(f"WITH {NODES}, {_UNTIL} SELECT doc_id, pos, coalesce(until, -1) AS until FROM u")
def tr15_descendant_range(spark, sf):
    return tree.ends(nodes(spark, sf), "doc_id", "pos", "level").select("doc_id", "pos", F.coalesce("until", F.lit(-1)).alias("until"))


@register(f"WITH {NODES}, {_UNTIL} SELECT u.doc_id, u.pos, coalesce(max(b.end_index), -1) AS value FROM u JOIN n b ON u.doc_id = b.doc_id AND b.pos >= u.pos AND (until IS NULL OR b.pos < until) GROUP BY u.doc_id, u.pos")
def ag13_subtree_end(spark, sf):
    return tree.subtree(nodes(spark, sf), "doc_id", "pos", "level", "end_index").select("doc_id", "pos", F.coalesce("value", F.lit(-1)).alias("value"))


@register(f"WITH {NODES}, {_UNTIL} SELECT u.doc_id, u.pos, CAST(sum({tokens_sql('b.text')}) AS BIGINT) AS value FROM u JOIN n b ON u.doc_id = b.doc_id AND b.pos >= u.pos AND (until IS NULL OR b.pos < until) GROUP BY u.doc_id, u.pos")
def ag14_subtree_tokens(spark, sf):
    n = nodes(spark, sf).select("doc_id", "pos", "level", X.tokens_mixed(F.col("text")).alias("tokens"))
    return tree.subtree(n, "doc_id", "pos", "level", "tokens", "sum")


@register(f"WITH {NODES}, c AS (SELECT doc_id, pos, text, max(CASE WHEN level = 0 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chapter FROM n) SELECT doc_id, chapter, string_agg(text, chr(10) ORDER BY pos) AS text FROM c WHERE text <> '' AND chapter IS NOT NULL GROUP BY doc_id, chapter")
def ag15_chapter_texts(spark, sf):
    return tree.chapter_texts(nodes(spark, sf), "doc_id", "pos", "level", "text")


@register(f"WITH {NODES} SELECT doc_id, pos, repeat('  ', level) || coalesce(title, '') AS line FROM n")
def tr13_outline(spark, sf):
    return tree.outline(nodes(spark, sf)).select("doc_id", "pos", "line")


@register(f"""WITH {NODES}, ch AS (SELECT doc_id, parent_pos AS pos, arg_min(start_index, pos) AS child FROM n WHERE parent_pos IS NOT NULL AND start_index IS NOT NULL GROUP BY doc_id, parent_pos),
r AS (SELECT n.doc_id, n.pos, start_index AS a, CASE WHEN child IS NOT NULL THEN child - 1 ELSE end_index END AS b FROM n LEFT JOIN ch USING (doc_id, pos)),
pg AS (SELECT doc_id, page_no, string_agg(t, '' ORDER BY pos) AS page_text FROM (SELECT doc_id, start_index AS page_no, pos, coalesce(title, '') AS t FROM n WHERE start_index IS NOT NULL) GROUP BY doc_id, page_no)
SELECT r.doc_id, r.pos, coalesce(string_agg(page_text, '' ORDER BY page_no), '') AS text FROM r LEFT JOIN pg ON r.doc_id = pg.doc_id AND pg.page_no BETWEEN r.a AND r.b GROUP BY r.doc_id, r.pos""")
def ck17_node_text(spark, sf):
    n = nodes(spark, sf)
    t = n.filter("start_index is not null").groupBy("doc_id", F.col("start_index").alias("page_no")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("page_text"))
    return tree.node_texts(n, t)


# ---- tables of contents, from the node table: an entry per node with a page

_TOC = "toc AS (SELECT doc_id AS doc, pos, level + 1 AS level, title, start_index AS page FROM n WHERE start_index IS NOT NULL), tot AS (SELECT doc_id AS doc, max(end_index) AS total FROM n GROUP BY doc_id HAVING max(end_index) IS NOT NULL)"


def entries(spark, sf) -> DataFrame:
    return nodes(spark, sf).filter("start_index is not null").select(F.col("doc_id").alias("doc"), "pos", (F.col("level") + 1).alias("level"), "title", F.col("start_index").alias("page"))


def totals(spark, sf) -> DataFrame:
    return nodes(spark, sf).groupBy(F.col("doc_id").alias("doc")).agg(F.max("end_index").alias("total")).filter("total is not null")


_PLAN = """top AS (SELECT t.*, total FROM toc t JOIN (SELECT doc, min(level) AS least FROM toc GROUP BY doc) m USING (doc) JOIN tot USING (doc) WHERE t.level = 1 OR least > 1 AND t.level = 2 OR least > 2),
body AS (SELECT doc, row_number() OVER w AS no, title, level, page AS first, greatest(page, least(coalesce(lead(page) OVER w - 1, total), total)) AS last FROM top WINDOW w AS (PARTITION BY doc ORDER BY pos)),
plan AS (SELECT * FROM body UNION ALL SELECT doc, 0, '前言', 1, 1, first - 1 FROM body WHERE no = 1 AND first > 1)"""


@register(f"WITH {NODES}, {_TOC}, {_PLAN} SELECT doc, no, title, level, first, last FROM plan")
def wn07_chunk_plan(spark, sf):
    p = toc.chunk_plan(entries(spark, sf), totals(spark, sf))
    return p.withColumn("no", F.col("no").cast("long"))


@register(f"WITH {NODES}, {_TOC}, {_PLAN} SELECT p.doc, p.no, t.pos FROM plan p JOIN toc t ON p.doc = t.doc AND t.level > p.level AND t.page BETWEEN p.first AND p.last")
def jn07_sub_entries(spark, sf):
    p = toc.chunk_plan(entries(spark, sf), totals(spark, sf)).alias("p")
    return p.join(entries(spark, sf).alias("t"), "doc").filter("t.level > p.level and t.page between p.first and p.last").select("doc", F.col("no").cast("long").alias("no"), "pos")


@register()
def ck11_refined(spark, sf):
    plan = toc.chunk_plan(entries(spark, sf), totals(spark, sf))
    n = nodes(spark, sf).filter("start_index is not null").groupBy(F.col("doc_id").alias("doc"), F.col("start_index").alias("page")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    return chunk.refine(plan, entries(spark, sf), n, 2000)


_YES = "CASE WHEN level = 1 THEN 'yes' ELSE 'no' END"


@register(f"WITH {NODES}, {_TOC} SELECT doc, pos, greatest(page, CASE WHEN nxt IS NULL THEN total WHEN st = 'yes' THEN nxt - 1 ELSE nxt END) AS end_index FROM (SELECT *, lead(page) OVER w AS nxt, lead({_YES}) OVER w AS st FROM toc JOIN tot USING (doc) WINDOW w AS (PARTITION BY doc ORDER BY pos))")
def wn08_section_ends(spark, sf):
    e = entries(spark, sf).select("doc", "pos", F.col("page").alias("physical_index"), F.when(F.col("level") == 1, "yes").otherwise("no").alias("appear_start"))
    return toc.section_ends(e, totals(spark, sf)).select("doc", "pos", "end_index")


@register(f"WITH {NODES} SELECT doc_id AS doc, pos, coalesce(last_value(start_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_known, coalesce(first_value(start_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_known FROM n")
def wn09_known_neighbours(spark, sf):
    n = nodes(spark, sf).select(F.col("doc_id").alias("doc"), "pos", "start_index")
    return toc.known_neighbours(n, "start_index").select("doc", "pos", "prev_known", "next_known")


_WRONG = "(start_index IS NULL OR start_index > coalesce(end_index, start_index))"


@register(f"WITH {NODES}, g AS (SELECT *, CASE WHEN NOT {_WRONG} THEN start_index END AS good FROM n) SELECT doc_id AS doc, pos, coalesce(last_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_correct, coalesce(first_value(good IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 999) AS next_correct FROM g")
def wn10_correct_neighbours(spark, sf):
    n = nodes(spark, sf).select(F.col("doc_id").alias("doc"), "pos", "start_index", "end_index")
    wrong = F.col("start_index").isNull() | (F.col("start_index") > F.coalesce("end_index", "start_index"))
    return toc.correct_neighbours(n, "start_index", wrong, 1, F.lit(999)).select("doc", "pos", "prev_correct", "next_correct")


@register(f"WITH {NODES}, {_TOC} SELECT doc, pos, title, page AS physical_index FROM toc UNION ALL SELECT doc, min(pos) - 1, '前言', 1 FROM toc GROUP BY doc HAVING arg_min(page, pos) > 1")
def wn16_preface(spark, sf):
    return toc.with_preface(entries(spark, sf).withColumnRenamed("page", "physical_index"))


@register(f"WITH {NODES}, {_TOC} SELECT doc, min(pos) AS pos FROM toc GROUP BY doc, trim(title, {WS}), page")
def ag12_dedup(spark, sf):
    return toc.deduplicated(entries(spark, sf).withColumnRenamed("page", "physical_index")).select("doc", "pos")


@register(f"WITH {NODES} SELECT doc_id, start_index, count(*) AS entries FROM n WHERE start_index IS NOT NULL GROUP BY doc_id, start_index")
def ag05_entries_per_page(spark, sf):
    return nodes(spark, sf).filter("start_index is not null").groupBy("doc_id", "start_index").agg(F.count("*").alias("entries"))


_PAIRS = "pairs AS (SELECT a.doc, a.pos, a.title, a.page, b.page + 2 AS physical_index FROM toc a JOIN toc b ON a.doc = b.doc AND a.title = b.title AND b.page + 2 >= 3)"


@register(f"WITH {NODES}, {_TOC}, {_PAIRS} SELECT doc, title, page, physical_index FROM pairs")
def jn01_page_pairs(spark, sf):
    e = entries(spark, sf)
    return toc.page_pairs(e, e.select("doc", "title", (F.col("page") + 2).alias("physical_index")), "doc", 3)


@register(f"""WITH {NODES}, {_TOC}, {_PAIRS}, c AS (SELECT doc, physical_index - page AS o, count(*) AS k, min(page) AS f FROM pairs GROUP BY ALL), off AS (SELECT doc, o FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k DESC, f) AS r FROM c) WHERE r = 1)
SELECT toc.doc, pos, page + o AS physical_index FROM toc JOIN off ON toc.doc = off.doc""")
def ag04_offset_applied(spark, sf):
    e = entries(spark, sf)
    pairs = toc.page_pairs(e, e.select("doc", "title", (F.col("page") + 2).alias("physical_index")), "doc", 3)
    return toc.apply_offset(e, toc.page_offset(pairs, "doc", "page"), "doc").select("doc", "pos", "physical_index")


@register(f"WITH {NODES}, {_TOC} SELECT doc, pos, CASE WHEN page <= 9 THEN page ELSE -1 END AS page FROM toc")
def tk13_within(spark, sf):
    return toc.within(entries(spark, sf), "page", F.lit(9)).select("doc", "pos", F.coalesce("page", F.lit(-1)).alias("page"))


@register(f"WITH {NODES} SELECT doc_id, pos FROM (SELECT doc_id, pos, max(CASE WHEN coalesce(regexp_matches(trim(title, {WS}), '(?i)^(参考文献|参考资料|references|bibliography|附录|appendix)'), false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS h FROM n) WHERE h = 0")
def tk12_until_appendix(spark, sf):
    return toc.until_appendix(nodes(spark, sf), "doc_id", "pos", "title").select("doc_id", "pos")


_ANS = "CASE WHEN title IS NULL THEN NULL WHEN level > 0 THEN 'yes' ELSE 'no' END"


@register(f"WITH {NODES}, a AS (SELECT doc_id, pos, {_ANS} AS ans FROM n), b AS (SELECT *, max(CASE WHEN ans = 'yes' AND pos < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS b FROM a), s AS (SELECT *, max(CASE WHEN b = 1 AND ans = 'no' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT doc_id, pos FROM s WHERE b = 1 AND s = 0 AND ans = 'yes'")
def pl05_toc_run(spark, sf):
    n = nodes(spark, sf).withColumn("ans", F.when(F.col("title").isNull(), F.lit(None)).when(F.col("level") > 0, "yes").otherwise("no"))
    return toc.toc_run(n, "doc_id", "pos", "ans").select("doc_id", "pos")


@register(f"WITH {NODES} SELECT doc_id, round(avg(CASE WHEN contains(coalesce(text, ''), coalesce(title, '?')) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM n GROUP BY doc_id")
def ag06_accuracy(spark, sf):
    n = nodes(spark, sf).withColumn("ok", F.when(F.contains(F.coalesce("text", F.lit("")), F.coalesce("title", F.lit("?"))), "yes").otherwise("no"))
    return toc.accuracy(n, "doc_id", "ok").select("doc_id", F.round("accuracy", 6).alias("accuracy"))


@register()
def sc11_filtered(spark, sf):
    return toc.filtered(entries(spark, sf).withColumnRenamed("page", "physical_index")).select("doc", "pos", "title")


@register()
def sc14_title_in_page(spark, sf):
    return toc.title_in_page(nodes(spark, sf).select("doc_id", "pos", "title", "text"), "title", "text").select("doc_id", "pos", "answer")


@register()
def sc18_toc_lines(spark, sf):
    return toc.parse_lines(table(spark, sf, "tree_node").withColumn("key", F.concat_ws("/", "doc_id", "pos", "ingested_at")), "key", "text")


@register()
def tk08_best_sequences(spark, sf):
    e = nodes(spark, sf).filter("start_index is not null").withColumn("n", F.lit(5))
    return toc.best_sequences(e, "doc_id", "pos", "start_index", "n")


@register()
def tk11_merged_roots(spark, sf):
    return toc.merge_roots(nodes(spark, sf).filter("level = 0"), "doc_id", "pos")
