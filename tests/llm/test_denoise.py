import random
import re
from collections import Counter

from docloom.llm import denoise

WORDS = "summary router heading extractor which begins between every minutes contract further notice keeps record section parser chunk table describe schedule".split()


def corpus(rnd):
    """Twenty scanned nodes of one document, with their true noise."""
    nodes, noise = [], set()
    for pos in range(20):
        lines = [] if pos else ["Outline of the Parser", ""]
        if pos:
            lines.append("0utline of the Parser" if pos == 7 else "Outline of the Parser")
            noise.add((pos, 1, "header"))
        for _ in range(6):
            ws = [rnd.choice(WORDS) for _ in range(7)]
            if rnd.random() < 0.3:
                k = rnd.randrange(7)
                bad = ws[k].replace("e", "c", 1)
                if bad != ws[k]:
                    ws[k] = bad
                    noise.add((pos, len(lines) + 1, "misread"))
            lines.append(" ".join(ws))
        if pos % 3 == 0:
            lines[-1] += " des-"
            noise.add((pos, len(lines), "hyphen"))
            lines.append("cribe " + " ".join(rnd.choice(WORDS) for _ in range(4)))
        if pos % 4 == 0:
            lines[-1] += " low-"
            lines.append("altitude routes.")
        lines += ["Total", "2014", f"Page l{pos}" if pos == 5 else f"Page {pos + 1}"]
        noise.add((pos, len(lines), "page_no"))
        nodes.append(("d", pos, "\n".join(lines)))
    return nodes, noise


def frame(spark, rows):
    df = spark.createDataFrame([(d, p, t, i) for i, (d, p, t) in enumerate(rows)], "doc_id string, pos int, text string, n int")
    return df.selectExpr("doc_id", "pos", "text", "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, n, 0) as ingested_at", "'x' as heads")


def test_planted_noise(spark):
    nodes, noise = corpus(random.Random(4))
    prose = [("e", i, "A plain document has long lines of words like low-altitude and describe, which no printed page would hold, so it is not scanned. " + " ".join(WORDS) * 2) for i in range(8)]
    old = [("d", 0, "An older version of this node.")]
    df = frame(spark, old + nodes + prose + [(None, 1, "x"), ("f", 0, None), ("f", 1, ""), ("g", 0, " \n ")])
    got = {(r["pos"], r["line_no"], r["noise"]) for r in denoise.noisy_lines(df).collect()}
    assert got == noise
    text = {r["pos"]: r["text"] for r in denoise.repaired(df).filter("para_no = 0").collect()}
    assert "describe" in text[3] and "low-altitude" in text[4] and "Page" not in text[3] and text[0] == "Outline of the Parser"


def test_empty(spark):
    df = frame(spark, [("d", 0, "x")]).limit(0)
    assert denoise.noisy_lines(df).count() == 0


def test_shapes():
    for line in ("Page 1 of 122", "Pagc l2", "- 7 -", "[12]", "第 9 页", "第 l2 贞", "共 36 页 第 11 页", "4/22", "Seite 3 von 9", "xii", "17"):
        assert denoise.shape(line) and not denoise.shape(line).startswith("~"), line
    for line in ("Total", "row[3] = parse(page, 4)", "seconds (cf. table 28).", "", "a | 1 | 2 | 3 | 4 | 5 | 6"):
        assert not denoise.shape(line) or denoise.shape(line).startswith("~"), line


def test_letters():
    pairs = {"的": 900, "旳": 9, "务的": 300, "务旳": 3, "的故": 300, "旳故": 3, "务": 600, "故": 600, "入": 300, "人": 300, "投入": 200, "投人": 4, "入增": 200, "人增": 4, "投": 210, "增": 210}
    m = denoise.Model({}, pairs)
    assert m.letters("服务旳故障") == [(2, "的")] and m.letters("服务的故障") == []
    assert m.letters("投人增") == [(1, "入")] and m.letters("投入增") == []


def test_running_heads_behind_wide_gaps():
    for gap in (3, 30, 90):
        line = "Outline of the Parser" + " " * gap + "12"
        assert denoise.layout(f"x\n{line}\nThe text goes on", [denoise.head_form("Outline of the Parser")], [], False) == "tht"
    assert denoise.shape("Page" + " " * 60 + "12") == "page N"


def test_context_and_two_confusions(spark):
    """A word that is right elsewhere, a word with two confusions, the second half of a divided word; repaired text."""
    rnd = random.Random(5)
    plain = []
    for i in range(300):
        ws = [rnd.choice(WORDS) for _ in range(120)]
        plain.append(("e", i, " ".join(ws) + " the modern router keeps every record. An old modem sends it. We describe the modern router. " * 2))
    nodes = []
    for pos in range(12):
        lines = ["Outline of the Parser"] + [" ".join(rnd.choice(WORDS) for _ in range(7)) for _ in range(4)]
        if pos == 3:
            lines += ["and then the modem router keeps", "what an old modem sends it every", "which schcdulc begins and we des-", "cribc what the modern router keeps"]
        lines += [" ".join(rnd.choice(WORDS) for _ in range(7)), f"Page {pos + 1}"]
        nodes.append(("d", pos, "\n".join(lines)))
    df = frame(spark, nodes + plain)
    got = {(r["line_no"], r["noise"]) for r in denoise.noisy_lines(df).filter("pos = 3").collect()}
    assert got == {(1, "header"), (6, "misread"), (8, "misread"), (8, "hyphen"), (9, "misread"), (11, "page_no")}
    text = " ".join(r["text"] for r in denoise.repaired(df).filter("pos = 3").orderBy("para_no").collect())
    assert "the modern router keeps what an old modem sends" in text
    assert "which schedule begins and we describe what the modern router" in text


def test_learned_odds_and_bit_sets(spark):
    known = spark.createDataFrame([("thc", False, 9, [("the", 5000, [0])]), ("wbo", False, 1, [("who", 4000, [9])])], "word string, joins boolean, n long, found array<struct<reading:string,n:long,used:array<int>>>")
    known = known.selectExpr("word", "joins", "n", "transform(found, f -> struct(f.n as n, f.reading as reading, f.used as used)) as found")
    assert denoise.PAIRS[0] == ("c", "e")
    odds = denoise.confusion_odds(known)
    assert odds[0] > denoise.WORD_ODDS > odds[1] > 0
    bits = denoise._bit_set(known.selectExpr("word as key"))
    assert bits.sum() == 2 and bits[denoise.bit("thc")] and bits[denoise.bit("wbo")]
    assert dict(denoise.candidates("des", 1)) and all(x.isalpha() for x, _ in denoise.candidates("c1e", 2))


def test_tally_counts_as_read_one_by_one():
    rnd = random.Random(1)
    alphabet = "ab-cé的旳航中ー\0 \n1_İΣσß-'’𝐀가ไท"
    likes = set(denoise.LIKE)
    for _ in range(300):
        texts, want = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(5))], Counter()
        for t in texts:
            words = [w for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", t.lower()) if w < "⺀"]
            plain = [x for w in words for x in w.split("-")]
            want.update(["w" + w for w in words if "-" in w] + ["w" + w for w in plain] + [f"b{a} {b}" for a, b in zip(plain, plain[1:])])
            if re.search("[぀-ヿ㐀-鿿]", t):
                flat = "".join(t.split())
                want.update([c for c in flat if c > "⹿"] + [a + b for a, b in zip(flat, flat[1:]) if a in likes or b in likes])
        got = Counter()
        for token, n in denoise.tallied(texts):
            got[token] += n
        assert got == want, texts


def test_frames_stay_below_what_arrow_takes(monkeypatch):
    monkeypatch.setattr(denoise, "FRAME_CHARS", 1000)
    texts = [" ".join(f"{'x' * 90}{chr(97 + i)}{chr(97 + j)}" for i in range(20)) for j in range(20)]
    sizes = [f["token"].str.len().sum() for f in denoise.frames(denoise.tallied(texts), ["token", "n"])]
    assert len(sizes) > 30 and max(sizes) <= 1000
    [empty] = denoise.frames([], ["token", "n"])
    assert len(empty) == 0 and list(empty.dtypes) == [object, object]


def test_counts_where_a_part_ends_without_tokens(spark):
    """A part without words, and one whose last text holds so many that they were returned before its end."""
    few = spark.createDataFrame([("the text 12",), ("34",)], "text string").repartition(5)
    assert {r["token"]: r["n"] for r in denoise.counts(few, "text").collect()} == {"wthe": 1, "wtext": 1, "bthe text": 1}
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:9]]
    many = spark.createDataFrame([(" ".join(words),)], "text string").coalesce(1)
    assert denoise.counts(many, "text").count() == 2 * len(words) - 1 > 300_000


def test_long_words(spark):
    """A word of any length may stand in any number of pairs: it is counted under a short name, and may be misread."""
    good = "extractor" * 600
    bad = good.replace("e", "c", 1)
    neighbours = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)]
    rows = [(f"{x} {good}",) for x in neighbours] + [(bad,)]
    table = denoise.counts(spark.createDataFrame(rows, "text string"), "text").cache()
    tokens = {r["token"]: r["n"] for r in table.collect()}
    assert max(map(len, tokens)) < 200
    assert tokens["w" + denoise.name(good)] == 300 and tokens[f"baax {denoise.name(good)}"] == 1
    pages = spark.createDataFrame([(f"the text\n{bad}", "tt")], "text string, kinds string")
    known = {r["word"]: r for r in denoise.readings(denoise.vocabulary(pages), table).collect()}
    [found] = known[denoise.name(bad)]["found"]
    assert (found["reading"], found["n"], denoise.PAIRS[found["used"][0]]) == (denoise.name(good), 300, ("c", "e"))
    model = denoise.Model({}, {})
    model.asked = {"r" + denoise.name(bad): (1, [(found["reading"], found["n"], tuple(found["used"]))])}
    assert model.misread(bad) == good
    assert denoise.label(f"the text\n{bad}", "tt", model)[0] == [(2, "misread")]
