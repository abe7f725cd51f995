from docloom.functions.common import WHITE_SPACE
from docloom.llm import split
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。.\n #　中 ", max_size=900), st.integers(5, 120), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    bare = text.strip(WHITE_SPACE)
    if not bare:
        assert got == []
        return
    start = text.index(bare[0]) if len(got) == 0 else got[0][0]
    assert text[got[0][0] : got[-1][1]] == bare and start == got[0][0]
    assert all(b - a <= limit for a, b in got)
    assert all(c == max(a, b - overlap) for (a, b), (c, _) in zip(got, got[1:]))
    assert (len(got) == 1) == (len(bare) <= limit)


def test_natural_ends():
    text = "\n\n".join("Sentence one is here. Sentence two is there. " * 6 for _ in range(8))
    ends = [text[:b].rstrip()[-1] for _, b in split.pieces(text, 400, 40)]
    assert set(ends) == {"."}


def test_very_long_text_without_any_separator():
    text = "x" * 2_000_000
    got = split.pieces(text)
    assert got[0] == (0, 1350) or got[0][1] <= 1500
    assert got[-1][1] == len(text) and all(b - a <= 1500 for a, b in got)


def test_operator(spark):
    rows = [("d", 1, "a" * 1501, 3, None, "k"), ("d", 1, "a" * 1501, 3, None, "k"), ("d", 2, " " * 999 + "b" * 1500 + "　" * 9, 1, 2, "k"), ("d", 3, None, 1, 2, "k"), (None, 4, "", 1, 2, "k"), (None, 5, "c d" * 1000, None, 2, "k")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, body string, start_index int, end_index int, text string")
    got = split.split_oversized(df, ["doc_id", "pos"], "body", ["start_index", "end_index"])
    assert got.columns == ["doc_id", "pos", "start_index", "end_index", "piece_no", "n_pieces", "char_start", "char_end", "piece"]
    assert sorted((r["pos"], r["piece_no"], r["n_pieces"]) for r in got.collect()) == [(1, 0, 2), (1, 0, 2), (1, 1, 2), (1, 1, 2), (5, 0, 3), (5, 1, 3), (5, 2, 3)]
    assert split.split_oversized(df.limit(0), ["doc_id", "pos"], "body").count() == 0
