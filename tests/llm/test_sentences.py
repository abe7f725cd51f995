import pytest
from docloom.llm import sentences


def cut(text):
    out, at = [], 0
    for e in sentences.sentence_ends(text):
        out.append(text[at:e].strip())
        at = e
    assert not text[at:].strip()
    return out


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. A. Smith paid 5.3 million. He left.", 2),
        ("See Fig. 5 and No. 6 of the annex, i.e. the plan. Work ends at 6 p.m. Nobody came.", 3),
        ("It went to Velph Inc. On paper it did. Did Velph Inc. publish it?", 3),
        ("It waited ... and then went on. The file outline.v2.md was parsed.It ended.", 3),
        ('Mr. X asked: "Who signed minutes.txt?" Nobody did.', 2),
        ("Am 23. Mai kam z. B. Frau Dr. Mond, u. a. mit Ebenen usw. und ging. „Nicht bereit!“, schrieb er auf Seite 30. Ende.", 3),
        ("« Fermez la porte ! » écrivait l’inspecteur. Qui paiera ?", 2),
        ("«¿Falta mucho?», preguntó el Sr. Diaz. ¡Cierren!", 2),
        ("“够用吗？”澄琅翻到第42页，“不够。”系统先识别标题……最后写入。", 3),
        ("负责人表示：“先做好，再谈。”谁来承担？", 2),
        ("「気象観測所はまだ使えません。」と担当は書いた。次へ。", 2),
        ("क्या काम पूरा हुआ? कुरेन प्रा. लि. ने लिखा। \"तैयार नहीं है!\" जिमोर ने लिखा।", 3),
        ("قال د. دوريم إن الاعتماد. لماذا؟", 2),
        ("ระบบรองรับคำขอ 678 รายการต่อวัน หน่วยงานเปิดระบบใหม่", 2),
        ("No end mark\nSecond line. Third", 3),
        ("", 0),
        (" \n　", 0),
        ("...", 1),
    ],
)
def test_count(text, want):
    assert len(cut(text)) == want


def test_wrapped_lines_are_joined_and_others_are_paragraphs():
    wrapped = "The scanner of Zelmond dropped the last\nline of every page, so the router had to\nbe checked by hand. It was late and the\nwork went on until the\nmorning."
    assert len(cut(wrapped)) == 2
    assert len(cut("First paragraph without mark\nSecond one. With two.\nThird!")) == 4


def test_every_character_belongs_to_a_sentence():
    text = "a. b\n\n。。 ”x" * 50
    assert "".join(cut(text)).replace(" ", "").replace("\n", "") == "".join(text.split())


def test_very_long_text():
    assert len(sentences.sentence_ends("Nothing stops here. " * 100_000)) == 100_000
    assert sentences.sentence_ends("x" * 500_000) == [500_000]


def test_operator(spark):
    df = spark.createDataFrame([(1, "Ab. Cd.", "s"), (1, "Ab. Cd.", "s"), (2, None, "s"), (3, " ", "s"), (None, "X", "s")], "doc_id int, text string, sentence string")
    got = sorted((r["doc_id"] or 0, r["sentence_no"], r["start_char"], r["end_char"], r["sentence"]) for r in sentences.split_sentences(df, "doc_id", "text").collect())
    assert got == [(0, 0, 1, 1, "X"), (1, 0, 1, 3, "Ab."), (1, 0, 1, 3, "Ab."), (1, 1, 5, 7, "Cd."), (1, 1, 5, 7, "Cd.")]
    assert sentences.split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_a_long_line_does_not_settle_the_document():
    block = "Operators in Brikabex reported fewer faults after\nnavigation was moved to the night shift and the\nplan was filed with all of its annexes by the\nauditor of the port, who had read each of\nthem."
    long = block[:-5] + "them who had come by then.".replace(".", " and\n") + block
    joined = long.replace("\nnavigation", " navigation", 1).replace("and the\nplan", "and the plan", 1)
    assert max(map(len, joined.split("\n"))) > sentences.WIDEST
    assert len(cut(f"{block}\n\n{block}\n\n{joined}\n\n{block}")) == 4
    # a long paragraph, and lines that are paragraphs, beside a wrapped passage
    assert len(cut(f"{block}\n\n{'Nothing stops here and so on ' * 8}end.")) == 2
    lines = "\n".join(f"{'Each line is a paragraph of its own ' * 4}{i}" for i in range(6))
    assert len(cut(f"{lines}\n\n{block}")) == 7


def test_abbreviations_by_language():
    def cut(text):
        ends = sentences.sentence_ends(text)
        return [text[a:b].strip() for a, b in zip([0, *ends], ends)]

    assert cut("См. рис. 3. Затем читайте дальше.") == ["См. рис. 3.", "Затем читайте дальше."]
    assert cut("Это было в 1999 г. в Москве. Потом всё.") == ["Это было в 1999 г. в Москве.", "Потом всё."]
    assert cut("Choose Plan B. Then we go.") == ["Choose Plan B.", "Then we go."]
    assert cut("He got an A. She left.") == ["He got an A.", "She left."]
    assert cut("J. K. Meyer wrote it. He left.") == ["J. K. Meyer wrote it.", "He left."]
    assert cut("Il Sig. Rossi arriva. Poi parte.") == ["Il Sig. Rossi arriva.", "Poi parte."]
    assert cut("O Sr. Silva chegou. Depois saiu.") == ["O Sr. Silva chegou.", "Depois saiu."]
    assert cut("彼は「終わった。」と言った。次へ。") == ["彼は「終わった。」と言った。", "次へ。"]
    long = "word " * 40 + "Dr." + " " * 40 + "Meyer came. He left."
    assert len(cut(long)) == 2  # what stands before and after is not cut to a width


def test_every_decision_is_a_rule():
    for rows in sentences.RULES.values():
        assert all(isinstance(brk, bool) for brk, _, _ in rows)
    assert sentences.RULES["common"][-1] == (True, "", "") and sentences.RULES["th"][-1] == (False, "", "")
