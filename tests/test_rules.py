"""Text rules, chunkers, lines, contents, boxes, sentences and JSON repair on hand-made cases."""

import json
import math
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import repair
from docloom.functions import text as X
from docloom.operators import boxes, catalog, chunk, lines, search, summarise, toc, tree


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def T():
    return F.col("t")


@pytest.mark.parametrize("text, n", [("", 0), (None, 0), ("one two", 2), ("中文 ab", 4), ("a-b", 2), ("!!!!", 2)])
def test_tokens(spark, text, n):
    assert one(spark, X.tokens_mixed(T()), t=text) == n


@pytest.mark.parametrize("title, yes", [("1.1 Scope", True), ("第一章 总则", True), ("短标题", True), ("这是一个相当长的并且没有任何关键词语的标题文字", False), ("以标点结尾。", False), ("12.3", False), ("", False), (None, False), ("x" * 60, False)])
def test_heading(spark, title, yes):
    assert one(spark, X.is_heading(T()), t=title) is yes


def test_three_valued_rules(spark):
    assert one(spark, X.toc_page(T()), t="Contents\nA .... 1\nB .... 2\nC .... 3") == "yes"
    assert one(spark, X.toc_page(T()), t="plain text") == "no"
    assert one(spark, X.toc_page(T()), t="目录") is None
    assert one(spark, X.toc_page(T()), t=" ") is None
    assert one(spark, X.toc_has_pages(T()), t="a ... 1\nb ... 2\nc ... 3") == "yes"
    assert one(spark, X.is_noise(T()), t="，。！") is True
    assert one(spark, X.is_noise(T()), t="aaaaaaaaaaab") is True
    assert one(spark, X.is_noise(T()), t="ordinary words here") is False
    assert one(spark, X.drop_first_section(T()), t="a<physical_index_1>b<physical_index_2>c<physical_index_3>") == "ac<physical_index_3>"
    assert one(spark, X.highlight(T(), ["cat"]), t="A cat sat. A dog. Cats! The CAT?") == "A <em>cat</em> sat... The <em>CAT</em>"


def test_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(5000))
    got = one(spark, chunk.windows(T()), t=text)
    assert [w["i"] for w in got] == [0, 1, 2, 3]
    assert all(w["piece"] == text[w["i"] * 1350 : w["i"] * 1350 + 1500] for w in got)
    assert one(spark, chunk.windows(T()), t=" \n　") is None


def packed(text, size=500):
    done, open_ = [], []
    for p in (x.strip() for x in text.split("\n")):
        if p:
            if open_ and sum(map(len, open_)) + len(p) > size:
                done.append("\n".join(open_))
                open_ = [open_[-1]]
            open_.append(p)
    return done + (["\n".join(open_)] if open_ else [])


def test_packing(spark):
    text = "\n".join("x" * n for n in (300, 150, 100, 600, 10, 0, 499, 1))
    assert one(spark, chunk.pack_paragraphs(T()), t=text) == packed(text)


def test_merge_broken_lines(spark):
    assert one(spark, lines.merge_broken(T()), t="ab\ncd\nef\n\ngh\n- x\nend.\nnext") == "abcd\nef\n\ngh\n- xend.\nnext"


def test_heads_are_cut(spark):
    pages = [("d", i, f"HEAD\nline {i}\nmore {i}\nbody text {i}\nlast {i}\nwords {i}\nFOOT") for i in range(4)]
    got = lines.strip_heads_and_feet(spark.createDataFrame(pages, "d string, p int, t string"), "d", "p", "t").collect()
    assert {r["p"]: r["text"] for r in got}[2] == "line 2\nmore 2\nbody text 2\nlast 2\nwords 2"


def test_page_groups(spark):
    pages = spark.createDataFrame([("d", i, 1500) for i in range(6)] + [("e", 0, 10)], "d string, p int, n int")
    got = sorted(map(tuple, chunk.page_groups(pages, "d", "p", "n").collect()))
    assert got == [("d", 0, 0, 1, 2, 3000), ("d", 1, 1, 2, 2, 3000), ("d", 2, 2, 3, 2, 3000), ("d", 3, 3, 4, 2, 3000), ("d", 4, 4, 5, 2, 3000), ("e", 0, 0, 0, 1, 10)]


def test_thinning(spark):
    n = spark.createDataFrame([("d", 0, 0, "a b"), ("d", 1, 1, "c"), ("d", 2, 0, " ".join(["w"] * 300)), ("d", 3, 1, "z")], "d string, p int, l int, t string")
    got = sorted((r["pos"], r["text"][:4]) for r in chunk.thin(n, "d", "p", "l", "t", 20).collect())
    assert got == [(0, "a b\n"), (2, "w w "), (3, "z")]


def test_parents_of_any_depth(spark):
    n = spark.createDataFrame([("d", i, i) for i in range(90)] + [("d", 90, 1), ("e", 0, 3), ("e", 1, 3)], "d string, p int, l int")
    got = {(r["d"], r["p"]): r["parent"] for r in tree.parents(n, "d", "p", "l").collect()}
    assert got["d", 89] == 88 and got["d", 90] == 0 and got["e", 0] is None and got["e", 1] is None


def test_increasing_pages():
    assert toc.increasing_pages([9, 1, 2, 3], 3) == [1, 2, 3]
    assert toc.increasing_pages([1, 5, 2, 6, 7, 3], 4) == [1, 5, 6, 7]
    assert toc.increasing_pages([], 0) == []


def test_fuzzy_titles():
    got = toc.fuzzy_in_page(pd.Series(["Scope of work", "Sc0pe of work", "zzzz qqqq", "ab", "", None]), pd.Series(["x scope  of\nwork y", "x scope of work", "nothing here", "cd", "x", None]))
    assert got.tolist() == ["yes", "yes", "no", None, None, None]


def test_refined_chapters(spark):
    plan = spark.createDataFrame([("d", 1, "A", 1, 1, 20), ("d", 2, "B", 1, 21, 60), ("d", 3, "C", 1, 61, 62)], "doc string, no int, title string, level int, first int, last int")
    entries = spark.createDataFrame([("d", 1, "A", 1, 1), ("d", 2, "A1", 2, 3), ("d", 3, "A2", 2, 9), ("d", 4, "B", 1, 21), ("d", 5, "C", 1, 61)], "doc string, pos int, title string, level int, page int")
    lengths = spark.createDataFrame([("d", p, 3000) for p in range(1, 63)], "doc string, page int, n int")
    got = sorted((r["no"], r["part"], r["title"], r["first"], r["last"]) for r in chunk.refine(plan, entries, lengths).collect())
    assert got[:3] == [(1, 0, "A", 1, 2), (1, 1, "A1", 3, 8), (1, 2, "A2", 9, 20)]
    assert got[3:7] == [(2, 1, "B (第1部分)", 21, 30), (2, 2, "B (第2部分)", 31, 40), (2, 3, "B (第3部分)", 41, 50), (2, 4, "B (第4部分)", 51, 60)]
    assert got[7:] == [(3, 0, "C", 61, 62)]


def test_merged_roots(spark):
    r = spark.createDataFrame([("d", 0, 1, 3), ("d", 1, 9, 12), ("d", 2, 4, 9), ("d", 3, 20, 21)], "d string, p int, start_index int, end_index int")
    assert sorted((x["pos"], x["under"]) for x in toc.merge_roots(r, "d", "p").collect()) == [(0, None), (1, 0), (2, 0), (3, None)]


def test_boxes(spark):
    b = [("d", 1, 0, 0.0, 10.0, 0.0, 10.0, "a", "text"), ("d", 1, 1, 12.0, 20.0, 1.0, 11.0, "b", "text"), ("d", 1, 2, 0.0, 20.0, 13.0, 23.0, "c", "text"), ("d", 2, 3, 0.0, 5.0, 0.0, 10.0, "t", "title")]
    df = spark.createDataFrame(b, boxes.SCHEMA.format(kind="string"))
    merged = boxes.merge_lines(df, "doc")
    assert sorted(r["text"] for r in merged.collect()) == ["a b", "c", "t"]
    assert sorted(r["text"] for r in boxes.merge_paragraphs(merged, "doc").collect()) == ["a b c", "t"]
    text = boxes.markdown(boxes.reading_order(merged, "doc"), "doc").first()["text"]
    assert text == "a b\nc\n\n## t\n"


def test_ranking_and_diversity():
    assert summarise.rank_sentences(["a", "b"], [1.0, 2.0]) == [0.5, 1.0]
    s = summarise.rank_sentences(["red cat sat", "red cat ran", "blue dog"], [1, 1, 1])
    assert math.isclose(sum(s), 1, abs_tol=1e-4) and math.isclose(s[0], s[1], abs_tol=1e-6)
    assert summarise.diversify(["abc", "abc", "xyz"], [0.9, 0.8, 0.7], 2) == [0, 2]


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text("abc \"{}[],:", max_size=6), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=3), v, max_size=3), max_leaves=8))
def test_json_repair(v):
    text = json.dumps(v)
    assert repair.extract_json(text) == v
    assert repair.extract_json(f"answer:\n```json\n{text}\n```") == v


def test_json_repair_of_faults():
    assert repair.extract_json("x {'a': None, 'b': [True, ]} y") == {"a": None, "b": [True]}
    assert repair.extract_json('{"a": [1, 2') == {"a": [1, 2]}
    assert repair.extract_json("nothing") == {} and repair.extract_json(None) == {}


def test_catalogue(spark):
    f = spark.createDataFrame([("r", "Root", "k", "0", "r", 1), ("a", "A", "k", "r", "r,a", 2)], "fd_id string, name string, kb_id string, parent_id string, path string, level int")
    more = catalog.create_folder(f, "b", "B", "k", "a")
    assert more.filter("fd_id = 'b'").first()["path"] == "r,a,b"
    with pytest.raises(ValueError):
        catalog.create_folder(f, "x", "A", "k", "r")
    with pytest.raises(LookupError):
        catalog.rename_folder(f, "zz", "N")
    assert {r["fd_id"] for r in catalog.below(more, ["a"]).collect()} == {"a", "b"}
    assert catalog.below(more, ["a"], by_prefix=True).count() == 0 and catalog.below(more, []).count() == 0
    assert "array_intersect" in catalog.rewrite_match("select  `x` from t where y_tks like '%a b%'")


def test_rag_needs_a_knowledge_base(spark):
    with pytest.raises(ValueError):
        search.rag_search(None, None, [1.0], ["a"], kb_ids=[])


def test_long_documents_are_ranked_as_a_whole(spark):
    # the words shared with the last sentences stand more than 2,000 sentences before them
    texts = [f"zebra{i} apple{i}" for i in range(2100)]
    texts[5] = "common market signal"
    for i in range(2050, 2060):
        texts[i] = f"common market signal alone{i}"
    whole = summarise.rank_sentences(texts, [1.0] * len(texts))
    df = spark.createDataFrame([("d", i, t, 1.0) for i, t in enumerate(texts)], "doc string, no int, sentence string, weight double")
    got = {r["no"]: r["score"] for r in summarise.summaries(df, "doc", k=2100).collect()}
    assert len(got) == 2100 and all(abs(got[i] - whole[i]) < 1e-12 for i in got)
    assert got[5] > 1.01 * got[6]
