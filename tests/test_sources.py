import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.plans import pipelines
from docloom.sources import files, sinks
from docloom.streaming import progress

W = 'xmlns:w="http://w"'
A = 'xmlns:a="http://a" xmlns:p="http://p" xmlns:r="http://r"'


def packed(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_X", "."), text)
    return b.getvalue()


def docx():
    para = lambda style, text: f'<w:p>{f"<w:pPr><w:pStyle w:val={style!r}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'.replace("'", '"')
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
    body = para("", "lead") + para("H1", "One") + para("", "text") + para("H2", "Sub") + para("", "more")
    return packed(word__styles_Xxml=styles, word__document_Xxml=f"<w:document {W}><w:body>{body}</w:body></w:document>")


def xlsx():
    x = 'xmlns="http://s" xmlns:r="http://r"'
    return packed(
        xl__workbook_Xxml=f'<workbook {x}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        **{"xl___rels__workbook_Xxml_Xrels": '<Relationships xmlns="http://x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'},
        xl__sharedStrings_Xxml=f"<sst {x}><si><t>name</t></si><si><t>n</t></si></sst>",
        xl__worksheets__sheet1_Xxml=f'<worksheet {x}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>',
    )


def pptx():
    sp = lambda ph, t: f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *s: f"<p:sld {A}>{''.join(s)}</p:sld>"
    return packed(ppt__slides__slide1_Xxml=slide(sp('<p:ph type="title"/>', "Title"), sp("", "body")), ppt__slides__slide2_Xxml=slide(sp("", "only")))


def test_formats():
    assert files.parse_docx(docx(), "d") == [(0, "前言", "lead", 1, 1), (0, "One", "text", 2, 2), (1, "Sub", "more", 3, 3)]
    assert [t for _, t, *_ in files.parse_docx(docx(), "d", exact_styles=True)] == ["前言", "Sub"]
    assert files.parse_xlsx(xlsx(), "x") == [(0, "S", "name | n\n--------------------\n | 7", 1, 1)]
    assert files.parse_pptx(pptx(), "p") == [(0, "Title", "body", 1, 1), (0, "幻灯片 2", "only", 2, 2)]
    assert files.parse_md(b"x\n# A\na\n```\n# no\n```\n## B\nb", "m") == [(0, "A", "a\n```\n# no\n```", 1, 1), (1, "B", "b", 2, 2)]
    assert files.parse_md(b"plain", "m") == [(0, "m", "plain", 1, 1)]
    assert files.parse_txt("中文".encode("gbk"), "t") == [(0, "中文", "中文", 1, 1)]
    assert files.parse_txt(b"", "t") == [(0, "t", "", 1, 1)]
    assert files.sheet_text([["a"]] * 5, cap=2).endswith("... (仅显示前 2 行)")


def write(tmp_path):
    for name, data in (("a.docx", docx()), ("b.xlsx", xlsx()), ("c.md", b"# T\nalpha beta\n## U\ngamma"), ("d.txt", b"one\ntwo"), ("e.bin", b"x")):
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_files_to_chunks(spark, tmp_path):
    nodes = files.read_files(spark, write(tmp_path))
    assert {r["doc_name"]: r["n"] for r in nodes.groupBy("doc_name").agg(F.count("*").alias("n")).collect()} == {"a.docx": 3, "b.xlsx": 1, "c.md": 2, "d.txt": 1}
    n = nodes.withColumn("doc_id", F.col("doc_name")).withColumn("kb_id", F.lit("k")).withColumn("fd_id", F.lit("0"))
    chunks, router = pipelines.ingest(n)
    got = {(r["doc_id"], r["original_snippet"]) for r in chunks.collect()}
    assert got == {("a.docx", "lead"), ("a.docx", "more"), ("b.xlsx", "name | n -------------------- | 7"), ("c.md", "gamma"), ("d.txt", "one two")}
    assert router.count() == 4 and router.filter("routing_text like '%目录：%'").count() == 2  # titles of one character do not count
    path = str(tmp_path / "index")
    sinks.append(chunks, path)
    sinks.upsert(spark, chunks.filter("doc_id = 'c.md'"), path, path + "2")
    assert spark.read.parquet(path + "2").count() == 5
    tree = json.loads(sinks.tree_json(nodes.withColumn("doc_id", F.col("doc_name"))).filter("doc_id = 'c.md'").first()["json"])
    assert tree["structure"][0]["nodes"][0]["title"] == "U"


def test_broken_files(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(b"no zip")
    assert files.read_files(spark, str(tmp_path), on_error="skip").count() == 0
    with pytest.raises(Exception):
        files.read_files(spark, str(tmp_path)).count()


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src = write(tmp_path / "in")
    seen = []
    q = progress.landing(spark, src, lambda df, batch: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 7


def test_progress(spark, tmp_path):
    assert progress.steps([0, 1, 2, 3, 5, 5, 100, -1]) == ([0, 2, 4, 6, 7], 0)
    rows = [("d", i, p) for i, p in enumerate([0, 1, 2, 3, 50, 51, 100])]
    df = spark.createDataFrame(rows, "doc_id string, seq long, percent int")
    want = [0, 2, 50, 100]
    assert [r["percent"] for r in progress.suppress(df).orderBy("seq").collect()] == want
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = progress.suppress_stream(stream).writeStream.format("memory").queryName("progress_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    deadline = time.time() + 60  # a query with processing-time timeouts is never idle: wait for its rows
    while time.time() < deadline and spark.table("progress_out").count() < len(want):
        time.sleep(0.5)
    q.stop()
    assert [r["percent"] for r in spark.table("progress_out").orderBy("seq").collect()] == want


def test_page_index(spark):
    body = "第一章 总则\n" + "正文内容。" * 5
    pages = [("d", 1, "封面"), ("d", 2, "目录\n第一章 总则 ........ 1\n第二章 范围 ........ 3\n第三章 附加 ........ 4"), ("d", 3, body), ("d", 4, "续。"), ("d", 5, "第二章 范围\n内容。"), ("d", 6, "第三章 附加\n末尾。"), ("e", 1, "only"), ("e", 2, "two")]
    got = pipelines.page_index(spark.createDataFrame(pages, "doc string, page_no int, text string"))
    rows = {(r["doc"], r["title"]): (r["start_index"], r["end_index"]) for r in got.collect()}
    assert rows == {("d", "前言"): (1, 2), ("d", "第一章 总则"): (3, 4), ("d", "第二章 范围"): (5, 5), ("d", "第三章 附加"): (6, 6), ("e", "第 1-2 页"): (1, 2)}


def test_chapters_and_large_nodes(spark):
    pages = spark.createDataFrame([("d", i, f"page {i} " + "x" * 900) for i in range(1, 31)] + [("e", i, "y") for i in range(1, 13)], "doc string, page_no int, text string")
    entries = spark.createDataFrame([("d", 1, 1, "One", 2), ("d", 2, 1, "Two", 5), ("d", 3, 1, "Appendix", 29)], "doc string, pos int, level int, title string, page int")
    got = sorted((r["doc"], r["no"], r["part"], r["title"], r["first"], r["last"]) for r in pipelines.chunked(pages, entries, most_tokens=3000).collect())
    assert [g[3:] for g in got if g[0] == "e"] == [("第 1-10 页", 1, 10), ("第 11-12 页", 11, 12)]
    assert [g[3:] for g in got if g[0] == "d"] == [("前言", 1, 1), ("One", 2, 4), ("Two (第1部分)", 5, 9), ("Two (第2部分)", 10, 14), ("Two (第3部分)", 15, 19), ("Two (第4部分)", 20, 24), ("Two (第5部分)", 25, 28)]
    nodes = spark.createDataFrame([("d", 0, "big", 1, 30), ("d", 1, "small", 1, 3)], "doc string, pos int, title string, start_index int, end_index int")
    cut = pipelines.split_large(nodes, pages.withColumn("tokens", F.lit(1000)), most_pages=10, most_tokens=5000)
    assert sorted((r["pos"], r["start_index"], r["end_index"]) for r in cut.collect()) == [(0, 1, 8), (0, 9, 15), (0, 16, 23), (0, 24, 30), (1, 1, 3)]


def test_markdown_tree(spark):
    df = spark.createDataFrame([(1, "# A\na\n## B\nb\n# C\nc"), (2, "no headings"), (3, None)], "id int, body string")
    got = sorted((r["id"], r["pos"], r["level"], r["parent"], r["node_id"], r["title"]) for r in pipelines.markdown_tree(df, "id", "body").na.fill(-1, ["parent"]).collect())
    assert got == [(1, 0, 0, -1, "0000", "A"), (1, 1, 1, 0, "0001", "B"), (1, 2, 0, -1, "0002", "C"), (2, 0, 0, -1, "0000", "")]
    assert pipelines.markdown_tree(df, "id", "body", thin_below=50).filter("id = 1").count() == 2


def test_merged_subtrees(spark):
    parts = spark.createDataFrame([("d", 1, 0, "Intro", ""), ("d", 2, 1, "A1", "Alpha"), ("d", 2, 2, "A2", "Alpha")], "doc string, no int, part int, title string, parent string")
    subs = spark.createDataFrame([("d", 1, 0, 0, 0, "Intro"), ("d", 1, 0, 1, 1, "Deep"), ("d", 2, 1, 0, 0, "x"), ("d", 2, 1, 1, 0, "y")], "doc string, no int, part int, pos int, level int, title string")
    got = [(r["level"], r["title"]) for r in pipelines.merged_subtrees(parts, subs).orderBy("pos").collect()]
    assert got == [(0, "Intro"), (1, "Deep"), (0, "Alpha"), (1, "A1"), (2, "x"), (2, "y"), (1, "A2")]


def test_very_large_nodes_are_cut_until_none_is_over_the_limits(spark):
    nodes = spark.createDataFrame([("d", 1, "A", 1, 1000), ("d", 2, "B", 1001, 1004)], "doc string, pos int, title string, start_index int, end_index int")
    pages = spark.range(1, 1005).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page_no"), F.lit(1000).alias("tokens"))
    cut = pipelines.split_large(nodes, pages, most_pages=10, most_tokens=5000).collect()
    assert max(r["end_index"] - r["start_index"] + 1 for r in cut) <= 10
    assert sorted(p for r in cut for p in range(r["start_index"], r["end_index"] + 1)) == list(range(1, 1005))
    assert [(r["part"], r["start_index"], r["end_index"]) for r in cut if r["pos"] == 2] == [("", 1001, 1004)]


def test_contents_are_checked_repaired_and_placed_by_titles(spark):
    def book(doc, printed, at, total):
        names = [f"第{c}章 {t}" for c, t in zip("一二三四", ("总则", "范围", "附加", "附则"))]
        pages = [(doc, i, "续。") for i in range(3, total + 1) if i not in at]
        pages += [(doc, a, f"{n}\n内容。") for n, a in zip(names, at)]
        return [(doc, 1, "封面"), (doc, 2, "目录\n" + "\n".join(f"{n} ........ {p}" for n, p in zip(names, printed)))] + pages

    rows = book("wrong", (1, 3, 3, 7), (3, 5, 7, 9), 10) + book("none", (1, 2, 3, 4), (3, 5, 7, 9), 10)
    got = pipelines.page_index(spark.createDataFrame(rows, "doc string, page_no int, text string")).collect()
    for doc in ("wrong", "none"):
        assert sorted(r["start_index"] for r in got if r["doc"] == doc) == [1, 3, 5, 7, 9]


def test_completer_is_asked_about_contents_pages(spark):
    page = "第一章 总则 ........ 1\n第二章 范围 ........ 2"
    rows = [("d", 1, "封面"), ("d", 2, page), ("d", 3, "第一章 总则\n内容。"), ("d", 4, "第二章 范围\n内容。")]
    df = spark.createDataFrame(rows, "doc string, page_no int, text string")
    asked = pipelines.page_index(df, completer=lambda s: s.map(lambda t: "yes" if "...." in t else "no")).collect()
    assert sorted(r["start_index"] for r in asked) == [1, 3, 4]
