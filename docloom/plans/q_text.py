"""Queries of the scalar functions on text, each over a whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.common import WHITE_SPACE, strip, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

C = F.col
WS = " || ".join(f"chr({ord(c)})" for c in WHITE_SPACE)
DOC, NODE = ("documents", ("doc_id",)), ("tree_node", ("doc_id", "pos"))
W, CJK = r"[\p{L}\p{N}_]+", r"[\x{4e00}-\x{9fa5}]"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def count_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def tokens_sql(t: str) -> str:
    return f"CAST(coalesce({count_sql(t, W)} + {count_sql(t, CJK)} + (length({t}) - {count_sql(t, W[:-1])}) // 2, 0) AS INTEGER)"


def scalar(name: str, source: tuple[str, tuple[str, ...]], columns: Callable[[], dict[str, Column]], sql: str, where: tuple[Callable[[], Column], str] | None = None) -> None:
    """A query that computes columns for every row of a table (of the rows that ``where`` asks for).

    Columns are made when the query is, since there may be no session yet when this module is read.
    """
    tab, keys = source

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, tab)
        if where is not None:
            df = df.filter(where[0]())
        return df.select(*keys, *[c.alias(n) for n, c in columns().items()])

    query.__name__ = name
    QUERIES[name] = query
    ORACLES[name] = f"SELECT {', '.join(keys)}, {sql} FROM {tab}" + (f" WHERE {where[1]}" if where else "")


def case_has(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


scalar("sc01_tokens", DOC, lambda: {"tokens": X.tokens_mixed(C("text"))}, f"{tokens_sql('text')} AS tokens")
scalar("sc03_tokens_by_length", DOC, lambda: {"tokens": X.tokens_by_length(C("text"))}, "CAST(coalesce(floor(length(text) / 1.5), 0) AS INTEGER) AS tokens")
scalar("sc04_tokens_by_space", NODE, lambda: {"tokens": X.tokens_by_space(C("text"))}, rf"CAST(coalesce({count_sql('text', r'[^\s\p{Z}\x{85}]+')}, 0) AS INTEGER) AS tokens")
scalar("ck20_processing_mode", DOC, lambda: {"mode": X.processing_mode(C("text"))}, "CASE WHEN coalesce(floor(length(text) / 1.5), 0) <= 8000 THEN 'simple' ELSE 'chunked' END AS mode")
scalar("sc05_sigmoid", ("events", ("event_id",)), lambda: {"score": F.round(X.sigmoid(C("value") / 100), 6)}, "round(1 / (1 + exp(-value / 100)), 6) AS score")
scalar("sc06_cosine", ("embeddings", ("vec_id",)), lambda: {"cosine": F.round(X.cosine(C("embedding"), F.reverse("embedding")), 6)}, "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine")
scalar(
    "sc07_charset_overlap", NODE, lambda: {"overlap": F.round(X.charset_overlap(C("title"), C("text")), 6)},
    r"round(len(list_intersect(list_distinct(regexp_extract_all(title, '[\s\S]')), list_distinct(regexp_extract_all(text, '[\s\S]')))) / (len(list_distinct(regexp_extract_all(title, '[\s\S]'))) + 1e-5), 6) AS overlap",
    (lambda: C("title").isNotNull() & C("text").isNotNull(), "title IS NOT NULL AND text IS NOT NULL"),
)
_t, _c = "lower(coalesce(title, ''))", "lower(coalesce(text, ''))"
_hint = "CASE " + " ".join(f"WHEN {case_has(_t, w)} THEN '{h}'" for h, w in X.HINTS_BY_TITLE) + f" WHEN {case_has(_c, ('table',))} AND {case_has(_c, ('row', 'col'))} THEN '数据表格' " + " ".join(f"WHEN {case_has(_c, w)} THEN '{h}'" for h, w in X.HINTS_BY_CONTENT) + f" ELSE '{X.BODY_HINT}' END"
scalar("sc08_section_hint", NODE, lambda: {"hint": X.section_hint(C("title"), C("text"))}, f"{_hint} AS hint")
scalar(
    "sc09_weight", NODE, lambda: {"weight": F.round(X.chunk_weight(X.section_hint(C("title"), C("text")), C("level")), 6)},
    f"round(1 + CASE WHEN contains({_hint}, '引言') THEN 1.2 ELSE 0 END + CASE WHEN contains({_hint}, '正文章节') THEN 0.6 ELSE 0 END + greatest(0, 2 - level) * 0.3::DOUBLE, 6) AS weight",
)
_s = f"coalesce({sql_strip('title')}, '')"
_numbered = "(" + " OR ".join(f"regexp_matches({_s}, '{p}')" for p in X.NUMBERED) + ")"
scalar(
    "sc10_heading", NODE, lambda: {"heading": X.is_heading(C("title"))},
    f"CASE WHEN {_s} = '' OR contains({_s}, '<physical_index') OR length({_s}) > 50 OR regexp_matches({_s}, '{X.BODY_END}') OR regexp_matches({_s}, '^[0-9\\s.、，。；：]+$') THEN false "
    f"ELSE {_numbered} OR length({_s}) <= 12 OR regexp_matches({_s}, '{X.HEADING_WORDS}') END AS heading",
)
_lines = f"list_filter(list_transform(string_split({sql_strip('text')}, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> '')"
_num = f"len(list_filter({_lines}, lambda x: regexp_matches(x, '[0-9]{{1,4}}$')))"
_key = rf"regexp_matches({sql_strip('text')}, '(?im)table\s+of\s+contents|^contents$|目\s*录|目\s*次')"
_dots = f"len(regexp_extract_all({sql_strip('text')}, '\\.{{3,}}|…{{2,}}|(?:\\. ){{3,}}'))"
scalar(
    "sc12_toc_page", NODE, lambda: {"toc": X.toc_page(C("text"))},
    f"CASE WHEN coalesce({sql_strip('text')}, '') = '' THEN NULL WHEN {_key} AND ({_dots} >= 2 OR {_num} >= 3) OR {_dots} >= 5 OR len({_lines}) > 5 AND {_num} * 2 > len({_lines}) THEN 'yes' WHEN NOT {_key} AND {_dots} = 0 AND {_num} < 2 THEN 'no' END AS toc",
)
scalar(
    "sc13_toc_has_pages", NODE, lambda: {"pages": X.toc_has_pages(C("text"))},
    r"CASE WHEN len(regexp_extract_all(text, '[.…:：]{2,}\s*[0-9]+')) >= 3 OR len(regexp_extract_all(text, '(?m)\S+\s+[0-9]{1,4}\s*$')) >= 3 THEN 'yes' WHEN len(regexp_extract_all(text, '[.…:：]{2,}\s*[0-9]+')) = 0 AND len(regexp_extract_all(text, '(?m)\S+\s+[0-9]{1,4}\s*$')) <= 1 THEN 'no' END AS pages",
)
_q = lambda x: rf"regexp_replace(lower(coalesce({x}, '')), '[\s\p{{Z}}]+', '', 'g')"
scalar("sc15_titles_match", ("kb_document", ("doc_id", "create_time")), lambda: {"same": X.titles_match(C("title"), C("source_path"))}, f"{_q('title')} <> '' AND {_q('source_path')} <> '' AND (contains({_q('title')}, {_q('source_path')}) OR contains({_q('source_path')}, {_q('title')})) AS same")
scalar("sc16_titles_similar", NODE, lambda: {"same": X.titles_match(C("title"), C("doc_name"))}, f"{_q('title')} <> '' AND {_q('doc_name')} <> '' AND (contains({_q('title')}, {_q('doc_name')}) OR contains({_q('doc_name')}, {_q('title')})) AS same")
_lv = sql_strip("title")
scalar("sc17_level", NODE, lambda: {"guess": F.coalesce(X.title_level(C("title")), F.lit(0))}, f"CASE WHEN title IS NULL THEN 0 " + " ".join(f"WHEN regexp_matches({_lv}, '{p}') THEN {n}" for p, n in X.LEVELS) + " ELSE 2 END AS guess")
_tag = lambda: F.concat(F.lit("<physical_index_"), C("start_index").cast("string"), F.lit(">"))
scalar("sc20_physical_index", NODE, lambda: {"page": F.coalesce(X.physical_index(_tag()), F.lit(-1)), "plain": F.coalesce(X.physical_index(C("node_id")), F.lit(-1))}, r"coalesce(try_cast(nullif(regexp_extract('<physical_index_' || start_index || '>', '^<?physical_index_([0-9]{1,9})>?$', 1), '') AS INTEGER), -1) AS page, coalesce(try_cast(nullif(regexp_extract(node_id, '^<?physical_index_([0-9]{1,9})>?$', 1), '') AS INTEGER), -1) AS plain")
scalar("sc21_page_to_int", NODE, lambda: {"number": F.expr("coalesce(try_cast(node_id as int), -1)")}, "coalesce(try_cast(node_id AS INTEGER), -1) AS number")
_tags = lambda: F.concat_ws("", F.lit("<start_index_"), C("start_index").cast("string"), F.lit(">x<start_index_"), C("end_index").cast("string"), F.lit(">"))
_ts = "concat_ws('', '<start_index_', start_index, '>x<start_index_', end_index, '>')"
scalar("sc25_page_tags", NODE, lambda: {"first": X.page_tag(_tags()), "last": X.page_tag(_tags(), last=True)}, f"coalesce(try_cast(regexp_extract_all({_ts}, '<start_index_([0-9]+)>', 1)[1] AS INTEGER), -1) AS first, coalesce(try_cast(regexp_extract_all({_ts}, '<start_index_([0-9]+)>', 1)[-1] AS INTEGER), -1) AS last")
_trunc = "CASE WHEN length(text) <= 500 THEN text ELSE left(text, 500) || '...' END"
scalar(
    "sc26_embedding_text", NODE, lambda: {"embedding_text": X.embedding_text(C("path"), C("text"), X.section_hint(C("title"), C("text")))},
    f"chr(10) || '        标题: ' || coalesce(path[-1], '根节点') || chr(10) || '        章节: ' || array_to_string(path, ' > ') || chr(10) || '        类型: ' || {_hint} || chr(10) || '        内容: ' || {_trunc} || chr(10) || '        ' AS embedding_text",
)
scalar(
    "sc27_context_block", NODE, lambda: {"block": X.context_block(C("doc_name"), C("path"), C("text"))},
    "chr(10) || '                【文档】' || doc_name || chr(10) || '                【章节】' || array_to_string(path, ' > ') || chr(10) || '                【内容】' || text || chr(10) || '                ' AS block",
)
scalar("sc28_page_range", NODE, lambda: {"pages": F.array_join(X.page_range(C("start_index"), C("end_index"), C("pos")), ",")}, "CASE WHEN start_index IS NULL THEN CAST(pos AS VARCHAR) WHEN coalesce(end_index, start_index) >= start_index THEN array_to_string(range(start_index, coalesce(end_index, start_index) + 1), ',') ELSE '' END AS pages")
scalar("sc30_layout_type", DOC, lambda: {"layout": X.layout_type(C("doc_form"))}, "CASE WHEN lower(doc_form) IN ('title', 'text', 'table', 'header', 'footer', 'caption', 'reference', 'equation') THEN lower(doc_form) WHEN lower(doc_form) IN ('figure', 'picture', 'image') THEN 'figure' ELSE 'text' END AS layout")
scalar("sc32_sparse_vector", ("embeddings", ("vec_id",)), lambda: {"entries": F.size(X.sparse_vector(F.sequence(F.lit(0), F.size("embedding") - 1), C("embedding"))), "third": F.round(F.try_element_at(X.sparse_vector(F.sequence(F.lit(0), F.size("embedding") - 1), C("embedding")), F.lit("2")).cast("double"), 6)}, "CAST(len(embedding) AS INTEGER) AS entries, round(embedding[3]::DOUBLE, 6) AS third")

scalar("ln01_page_lines", NODE, lambda: {"lines": F.size(X.page_lines(C("text"))), "joined": F.array_join(X.page_lines(C("text")), "|")}, f"CAST(len(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> ''), [])) AS INTEGER) AS lines, array_to_string(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WS})), lambda x: x <> ''), []), '|') AS joined")
scalar("ln02_clean", NODE, lambda: {"clean": X.clean_text(C("text"))}, f"trim(replace(string_split(text, '{X.MARKER}')[-1], chr(10), ' '), {WS}) AS clean")
scalar("ln03_truncate", DOC, lambda: {"head": X.truncate(C("text"), 120)}, "CASE WHEN length(text) <= 120 THEN text ELSE left(text, 120) || '...' END AS head")
_marks = X.PUNCTUATION.replace("'", "''")
_char = r"regexp_extract_all(text, '[\s\S]')"
_median = f"list_sort({_char})[greatest(1, len({_char}) // 2 + 1)]"
_noise = (
    f"CASE WHEN coalesce({sql_strip('text')}, '') = '' THEN true WHEN regexp_matches(translate(text, '{_marks}', ''), '^[\\s\\p{{Z}}]*$') THEN true "
    f"ELSE length(text) > 10 AND (length(text) - length(replace(text, {_median}, ''))) * 2 > length(text) END"
)
scalar("ln07_noise", DOC, lambda: {"noise": X.is_noise(C("text"))}, f"{_noise} AS noise")
scalar("ln08_valid_chunk", NODE, lambda: {"valid": X.is_valid_chunk(C("text"), X.section_hint(C("title"), C("text")))}, f"length(text) >= 80 AND NOT contains({_hint}, '目录') AND NOT ({_noise}) AS valid", (lambda: C("text").isNotNull(), "text IS NOT NULL"))
scalar("ln09_dots_to_colon", DOC, lambda: {"plain": X.dots_to_colon(C("text"))}, r"regexp_replace(regexp_replace(text, '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS plain")
_sect = lambda: F.concat(F.lit("a<physical_index_1>"), C("title"), F.lit("<physical_index_2>z"))
scalar("ln10_drop_first_section", NODE, lambda: {"rest": X.drop_first_section(_sect())}, r"regexp_replace('a<physical_index_1>' || title || '<physical_index_2>z', '<physical_index_[0-9]+>[\s\S]*?<physical_index_[0-9]+>', '') AS rest")
scalar("ln11_safe_filename", ("kb_document", ("doc_id", "create_time")), lambda: {"name": X.safe_filename(C("source_path"))}, "replace(source_path, '/', '-') AS name")
scalar("src19_convertible", ("kb_document", ("doc_id", "create_time")), lambda: {"ok": X.is_convertible(C("source_path"))}, r"coalesce(lower(regexp_extract(source_path, '\.([^./]+)$', 1)) IN ('doc', 'docx', 'txt', 'json', 'ppt', 'pptx', 'xls', 'xlsx'), false) AS ok")
_map = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PARSERS.items())
scalar("src20_dispatch", ("kb_document", ("doc_id", "create_time")), lambda: {"parser": X.parser_of(C("source_path"))}, rf"CASE lower(regexp_extract(source_path, '\.([^./]+)$', 1)) {_map} END AS parser")
scalar("ck19_sentences", NODE, lambda: {"n": F.size(X.sentences(C("text"))), "first": F.try_element_at(X.sentences(C("text")), F.lit(1))}, f"CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[。！？]'), lambda x: trim(x, {WS})), lambda x: length(x) > 20)) AS INTEGER) AS n, list_filter(list_transform(regexp_split_to_array(text, '[。！？]'), lambda x: trim(x, {WS})), lambda x: length(x) > 20)[1] AS first", (lambda: C("text").isNotNull(), "text IS NOT NULL"))
_kw = ("parser", "folder tree", "Ordnerbaum")
_pat = r"(?i)\b(parser|folder tree|Ordnerbaum)\b"
scalar("ln12_highlight", DOC, lambda: {"highlight": X.highlight(C("text"), _kw)}, rf"array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[.?!;\n]'), lambda s: regexp_matches(s, '{_pat}')), lambda s: regexp_replace(s, '{_pat}', '<em>\1</em>', 'g')), '...') AS highlight", (lambda: C("text").isNotNull(), "text IS NOT NULL"))
scalar("ln13_table_row", ("supplier", ("s_suppkey",)), lambda: {"row": X.table_row([C("s_suppkey"), C("s_name"), C("s_nationkey")])}, "'| ' || s_suppkey || ' | ' || coalesce(replace(s_name, chr(10), ' '), '') || ' | ' || coalesce(CAST(s_nationkey AS VARCHAR), '') || ' |' AS row")
scalar("rel21_without_vectors", ("doc_summary_index", ("row_id", "doc_id", "kb_id", "fd_id", "title", "summary")), lambda: {"kind": C("doc_type")}, "doc_type AS kind")
scalar("rel23_reorder", ("kb_document", ("title", "doc_id", "kb_id")), lambda: {"bytes": F.coalesce("file_size", F.lit(0))}, "coalesce(file_size, 0) AS bytes")
scalar("ck08_fallback_kind", NODE, lambda: {"kind": F.when(F.coalesce(strip(C("text")), F.lit("")) == "", "empty").when(C("text").rlike(r"(?m)^#{1,6}\s+\S"), "sections").otherwise("whole")}, rf"CASE WHEN coalesce({sql_strip('text')}, '') = '' THEN 'empty' WHEN regexp_matches(text, '(?m)^#{{1,6}}\s+\S') THEN 'sections' ELSE 'whole' END AS kind")
scalar("tr06_without_pages", NODE, lambda: {"title": C("title"), "leaf": C("is_leaf")}, "title, is_leaf AS leaf")
scalar("tr08_skeleton", NODE, lambda: {"title": C("title"), "node_id": C("node_id"), "level": C("level"), "parent_pos": F.coalesce("parent_pos", F.lit(-1))}, "title, node_id, level, coalesce(parent_pos, -1) AS parent_pos")
scalar("tr09_over_limit", NODE, lambda: {"tokens": X.tokens_mixed(C("text"))}, f"{tokens_sql('text')} AS tokens", (lambda: X.tokens_mixed(C("text")) > 1000, f"{tokens_sql('text')} > 1000"))
scalar("ud07_markdown_budget", NODE, lambda: {"budget": F.greatest(F.lit(2048), F.least(F.lit(8192), 32768 - X.tokens_by_length(C("text")) - 100))}, "greatest(2048, least(8192, 32768 - CAST(coalesce(floor(length(text) / 1.5), 0) AS INTEGER) - 100)) AS budget")
scalar("tx09_summary_if_long", NODE, lambda: {"short": F.when(X.tokens_mixed(C("text")) < 200, C("text"))}, f"CASE WHEN {tokens_sql('text')} < 200 THEN text END AS short")
