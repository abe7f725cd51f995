"""Column functions on text: token estimates, predicates, rules, templates. All stay in the JVM.

Functions take columns and return columns. Where a rule has no answer it gives null ("ask a model").
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.common import strip

WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4e00}-\x{9fa5}]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


# ---- token estimates


def tokens_mixed(text: Column) -> Column:
    """Words, plus CJK characters, plus half of the characters that are neither; 0 for null."""
    letters = _count(text, r"[\p{L}\p{N}_]")
    return F.coalesce((_count(text, WORD) + _count(text, CJK) + F.floor((F.length(text) - letters) / 2)).cast("int"), F.lit(0))


def tokens_by_length(text: Column) -> Column:
    """Characters divided by 1.5, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(text) / F.lit(1.5)).cast("int"), F.lit(0))


def tokens_by_space(text: Column) -> Column:
    """Runs between white space; 0 for null."""
    return F.coalesce(_count(text, r"[^\s\p{Z}\x{85}]+"), F.lit(0))


def processing_mode(text: Column, most: int = 8000) -> Column:
    """``simple`` or ``chunked``, by estimated tokens."""
    return F.when(tokens_by_length(text) <= most, "simple").otherwise("chunked")


# ---- scores


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def charset_overlap(a: Column, b: Column) -> Column:
    """Shared distinct characters over the distinct characters of ``a`` (asymmetric)."""
    chars = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"([\s\S])"), F.lit(1)))
    return F.size(F.array_intersect(chars(a), chars(b))) / (F.size(chars(a)) + F.lit(1e-5))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one is all zero or empty."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.try_divide(dot, norm(a) * norm(b))


# ---- section hints. The classes and their words, first match counts, title before content.

HINTS_BY_TITLE = (
    ("目录列表", ("content", "目录", "index", "table of contents")),
    ("引言/概述", ("intro", "引言", "概述", "summary", "abstract")),
    ("结论", ("conclusion", "结论", "结语")),
    ("术语表/定义", ("glossary", "术语", "definition")),
    ("附录", ("appendix", "appendices", "附录")),
    ("参考文献", ("reference", "参考")),
    ("法律声明", ("disclaimer", "声明", "legal", "copyright")),
)
HINTS_BY_CONTENT = (
    ("安全警告", ("warning", "caution", "danger", "警告", "注意", "危险")),
    ("操作流程", ("step 1", "step 2", "步骤", "procedure", "流程")),
    ("技术规格", ("spec", "specification", "参数", "规格")),
)
BODY_HINT = "正文章节"


def _has(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def section_hint(title: Column, content: Column) -> Column:
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for hint, words in HINTS_BY_TITLE:
        out = out.when(_has(t, words), hint)
    out = out.when(_has(c, ["table"]) & _has(c, ["row", "col"]), "数据表格")
    for hint, words in HINTS_BY_CONTENT:
        out = out.when(_has(c, words), hint)
    return out.otherwise(BODY_HINT)


def chunk_weight(hint: Column, depth: Column) -> Column:
    """1, plus 1.2 for an introduction, 0.6 for body text and 0.3 for each level above the second."""
    weight = F.lit(1.0) + F.when(F.contains(hint, F.lit("引言")), 1.2).otherwise(0.0) + F.when(F.contains(hint, F.lit(BODY_HINT)), 0.6).otherwise(0.0)
    return weight + F.greatest(F.lit(0), 2 - depth) * F.lit(0.3)


# ---- titles and headings. The patterns.

NUMBERED = (r"^[0-9.]+\s", r"^第[一二三四五六七八九十百千0-9]+[章节部分篇]", r"^[（(][一二三四五六七八九十0-9]+[）)]", r"^[一二三四五六七八九十]+[、.]")
BODY_END = r"[，。、；：！？的了着过呢吗得]$"
HEADING_WORDS = "概述|总结|结论|引言|绪论|前言|摘要|附录|参考文献|发展|展望|分析|研究|方法|背景|目标|策略|规划|建设|驱动|价值|核心"
LEVELS = ((r"^第[一二三四五六七八九十百0-9]+[章篇部]", 1), (r"^第[一二三四五六七八九十0-9]+节", 2), (r"^[一二三四五六七八九十]+、", 3), (r"^（[一二三四五六七八九十]+）", 4), (r"^(附录|参考文献|致谢|摘\s*要|Abstract)", 1))


def is_numbered(title: Column, patterns: Sequence[str] = NUMBERED) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | title.rlike(p)
    return out


def is_heading(title: Column) -> Column:
    """Whether a title looks like one and not like a piece of running text."""
    t = strip(F.coalesce(title, F.lit("")))
    bad = (t == "") | F.contains(t, F.lit("<physical_index")) | (F.length(t) > 50) | t.rlike(BODY_END) | t.rlike(r"^[0-9\s.、，。；：]+$")
    return F.when(bad, False).otherwise(is_numbered(t) | (F.length(t) <= 12) | t.rlike(HEADING_WORDS))


def title_level(title: Column) -> Column:
    t = strip(title)
    out = F.when(t.isNull(), F.lit(None).cast("int"))
    for pattern, level in LEVELS:
        out = out.when(t.rlike(pattern), level)
    return out.otherwise(2)


def squeezed(text: Column) -> Column:
    """Lower case without white space: the form in which titles are compared."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+", "")


def titles_match(a: Column, b: Column) -> Column:
    """Equal, or one within the other, in squeezed form; never with an empty title."""
    x, y = squeezed(a), squeezed(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def toc_page(text: Column) -> Column:
    """``yes``, ``no`` or null: whether a page holds a table of contents."""
    t = strip(text)
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != "")
    n = F.size(lines)
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"[0-9]{1,4}$")))
    keyword = t.rlike(r"(?im)table\s+of\s+contents|^contents$|目\s*录|目\s*次")
    dots = _count(t, r"\.{3,}|…{2,}|(?:\. ){3,}")
    yes = keyword & ((dots >= 2) | (numbered >= 3)) | (dots >= 5) | (n > 5) & (numbered * 2 > n)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(None)).when(yes, "yes").when(~keyword & (dots == 0) & (numbered < 2), "no")


def toc_has_pages(text: Column) -> Column:
    """``yes``, ``no`` or null: whether a table of contents gives page numbers."""
    leaders = _count(text, r"[.…:：]{2,}\s*[0-9]+")
    ends = _count(text, r"(?m)\S+\s+[0-9]{1,4}\s*$")
    return F.when((leaders >= 3) | (ends >= 3), "yes").when((leaders == 0) & (ends <= 1), "no")


def physical_index(text: Column) -> Column:
    """12 for ``<physical_index_12>`` or ``physical_index_12``; null for anything else."""
    return F.nullif(F.regexp_extract(text, r"^<?physical_index_([0-9]{1,9})>?$", 1), F.lit("")).cast("int")


def page_tag(text: Column, last: bool = False) -> Column:
    """Number of the first (or last) ``<start_index_n>`` in a text, -1 if there is none."""
    all_of = F.regexp_extract_all(text, F.lit(r"<start_index_([0-9]+)>"), F.lit(1))
    return F.coalesce(F.try_element_at(all_of, F.lit(-1 if last else 1)).cast("int"), F.lit(-1))


def dots_to_colon(text: Column) -> Column:
    """Dot leaders as a colon: five dots or more, or five dots with spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def page_range(start: Column, end: Column, fallback: Column) -> Column:
    """The pages from ``start`` to ``end``; [fallback] without a start, nothing if the end lies before the start."""
    last = F.coalesce(end, start)
    return F.when(start.isNull(), F.array(fallback)).when(last >= start, F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


# ---- cleaning

MARKER = "【原始数据内容】:"
PUNCTUATION = "，。！？；：（）【】[]()\"'“”‘’"


def clean_text(text: Column) -> Column:
    """What stands after the last marker of raw content, on one line."""
    return strip(F.replace(F.element_at(F.split(text, MARKER, -1), -1), F.lit("\n"), F.lit(" ")))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("...")))


def page_lines(text: Column) -> Column:
    """The lines of a page, white space at both ends removed, blank ones left out; [] for null."""
    return F.coalesce(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.array().cast("array<string>"))


def is_noise(text: Column) -> Column:
    """Blank, only punctuation, or (beyond ten characters) more than half one and the same character."""
    chars = F.regexp_extract_all(text, F.lit(r"([\s\S])"), F.lit(1))
    # a character that fills more than half of a text is its median
    median = F.element_at(F.array_sort(chars), F.greatest(F.lit(1), F.floor(F.size(chars) / 2).cast("int") + 1))
    most = F.length(text) - F.length(F.replace(text, median, F.lit("")))
    marks = F.translate(text, PUNCTUATION, "").rlike(r"^[\s\p{Z}]*$")
    return F.when(F.coalesce(strip(text), F.lit("")) == "", True).when(marks, True).otherwise((F.length(text) > 10) & (most * 2 > F.length(text)))


def is_valid_chunk(text: Column, hint: Column, least: int = 80) -> Column:
    return (F.length(text) >= least) & ~F.contains(hint, F.lit("目录")) & ~is_noise(text)


def drop_first_section(text: Column) -> Column:
    """Without the first ``<physical_index_n> ... <physical_index_n>`` section."""
    hit = F.regexp_extract(text, r"<physical_index_[0-9]+>[\s\S]*?<physical_index_[0-9]+>", 0)
    at = F.position(hit, text)
    return F.when(F.coalesce(hit, F.lit("")) == "", text).otherwise(F.concat(F.left(text, at - 1), F.substr(text, at + F.length(hit))))


def safe_filename(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("-"))


def sentences(text: Column, marks: str = "。！？", longer_than: int = 20) -> Column:
    """Pieces between end marks, trimmed, of more than ``longer_than`` characters."""
    return F.filter(F.transform(F.split(text, f"[{marks}]"), strip), lambda s: F.length(s) > longer_than)


def highlight(text: Column, keywords: Sequence[str]) -> Column:
    """Sentences that hold a keyword at word boundaries, the keywords in <em>, joined by ``...``."""
    alternatives = "|".join(rf"\Q{k}\E" for k in keywords)
    pattern = rf"(?i)\b({alternatives})\b"
    kept = F.filter(F.split(text, r"[.?!;\n]"), lambda s: s.rlike(pattern))
    return F.array_join(F.transform(kept, lambda s: F.regexp_replace(s, pattern, "<em>$1</em>")), "...")


# ---- templates (white space is part of them)


def embedding_text(path: Column, content: Column, hint: Column) -> Column:
    pad = "\n        "
    title = F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("根节点"))
    return F.concat(F.lit(f"{pad}标题: "), title, F.lit(f"{pad}章节: "), F.array_join(path, " > "), F.lit(f"{pad}类型: "), hint, F.lit(f"{pad}内容: "), truncate(content, 500), F.lit(pad))


def context_block(doc_title: Column, path: Column, snippet: Column) -> Column:
    pad = "\n" + " " * 16
    return F.concat(F.lit(f"{pad}【文档】"), doc_title, F.lit(f"{pad}【章节】"), F.array_join(path, " > "), F.lit(f"{pad}【内容】"), snippet, F.lit(pad))


def table_row(cells: Sequence[Column]) -> Column:
    """One row of a Markdown table; null cells are empty, line feeds become spaces."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")) for c in cells]), " | "), F.lit(" |"))


# ---- formats. Extensions and layout classes.

CONVERTIBLE = ("doc", "docx", "txt", "json", "ppt", "pptx", "xls", "xlsx")
PARSERS = {"pdf": "pdf", "doc": "word", "docx": "word", "ppt": "ppt", "pptx": "ppt", "xls": "excel", "xlsx": "excel", "md": "markdown", "markdown": "markdown", "txt": "txt"}
LAYOUT = {"title": "title", "text": "text", "table": "table", "figure": "figure", "picture": "figure", "image": "figure", "header": "header", "footer": "footer", "caption": "caption", "reference": "reference", "equation": "equation"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def is_convertible(name: Column) -> Column:
    return F.coalesce(extension(name).isin(*CONVERTIBLE), F.lit(False))


def parser_of(name: Column) -> Column:
    """Which source reads a file; null if none does."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv]), extension(name))


def layout_type(region: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYOUT.items() for x in kv]), F.lower(region)), F.lit("text"))


def sparse_vector(indices: Column, values: Column) -> Column:
    """map<string, value>; null where the arrays differ in length."""
    return F.when(F.size(indices) == F.size(values), F.map_from_arrays(F.transform(indices, lambda i: i.cast("string")), values))
