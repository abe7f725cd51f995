from docloom.llm import decontam

P1 = "Beyond the quarry, the oldest tallyman of Halvenk weighed nineteen borrowed anchors because the bridge toll had doubled. After three failed harvests, the younger botanist of Yarbolet traded away three ivory lanterns beneath the oldest yew. On the second market day, a nervous cartographer repainted eleven sealed quinces under the tree."
P2 = "退潮之后，鲁金巴的年轻的绘图师拆开了十九个封口铁锚，免得有人来征税。采石场以外，哈文克的被逐的鞍匠修补了两件中空灯笼，放在老紫杉树下。大旱期间，乌木尔的守寡的学徒拆开了十九个蓝釉油桶，因为桥钱涨了一倍。"
S = [s + "." for s in P1.split(". ")]
OTHER = "Unrelated words stand between the parts of this text and say nothing of note. "


def test_find(spark):
    docs = [
        (1, OTHER + P1 + OTHER),
        (2, OTHER + P1.upper().replace(" ", " ") + OTHER),
        (3, OTHER + S[0] + OTHER + S[1] + OTHER + S[2]),  # other text between
        (4, OTHER + S[1] + " " + S[2] + OTHER),  # two of three sentences
        (5, OTHER + S[1] + OTHER),  # a single sentence
        (6, OTHER * 5),
        (7, P1.replace("weighed", "measured").replace("ivory", "tin").replace("nervous", "calm")),  # some words differ
        (8, "<p>" + P1.replace(" the ", " <b>the</b> ").replace(",", "") + "</p>"),
        (9, P2.replace("，", " ").replace("。", "\n").replace("之后", "以后")),
        (10, P2[:31]),
        (11, "ｘ " + P1.translate({i: i + 0xFEE0 for i in range(0x21, 0x7F)})),  # full width
        (12, S[2] + OTHER + S[1] + OTHER + S[0]),  # another order
        (13, None), (14, ""), (15, " \n"), (None, P1),
        (16, OTHER * 3000 + P1),
    ]
    items = [(100, P1), (101, P1.upper()), (102, P2), (103, None), (104, ""), (105, "too short"), (None, P1), (102, P2)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item", "1 as item_id")
    e = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "'y' as text")
    for size in (20_000, 2):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, "doc_id", "text", e, "item_id", "passage", block_items=size).collect()}
        held = {1, 2, 3, 4, 7, 8, 11, 16}
        assert got == {(i, j) for i in held for j in (100, 101)} | {(9, 102)}
    assert decontam.find_leaks(d.limit(0), "doc_id", "text", e, "item_id", "passage").count() == 0
    assert decontam.find_leaks(d, "doc_id", "text", e.limit(0), "item_id", "passage").count() == 0


def test_short_passages_and_share(spark):
    docs = [(1, "They said: 'Quartz  never sleeps' and left."), (2, "quartz sleeps never"), (3, OTHER + S[1] + OTHER)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(1, "Quartz never sleeps!"), (2, "石英"), (3, P1)], "item_id long, passage string")
    found = lambda **k: {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, "doc_id", "text", e, "item_id", "passage", **k).collect()}
    assert found() == {(1, 1)}
    assert found(cover=0.25) == {(1, 1), (3, 3)}


def test_changed_words(spark):
    """One changed word in five is found, one in four is not: the limit of the masks."""
    words = P1.split()
    for step, held in ((5, 1), (4, 0)):
        text = " ".join("x" if i % step == step - 1 else w for i, w in enumerate(words))
        index = decontam.Index(decontam.passages_of([(1, P1)]))
        assert len(list(index.find([text]))) == held
