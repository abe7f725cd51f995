from collections import defaultdict

from docloom.llm import pack
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 8))
def test_best_fit_of_bounded_space(sizes, slots):
    p, used, open_ = pack.Packer(50, slots), defaultdict(int), {}
    for n in sizes:
        fits = {b: f for b, f in open_.items() if f >= n}
        box, at = p.add(n)
        assert at == used[box]
        if fits:
            assert box in fits and fits[box] == min(fits.values())
        else:
            assert used[box] == 0
            if len(open_) == slots:
                least = min(open_.values())
                del open_[next(b for b, f in open_.items() if f == least and b not in p_open(p))]
        used[box] += n
        assert used[box] <= 50
        open_[box] = 50 - used[box]
        if not open_[box]:
            del open_[box]
        assert set(open_) == p_open(p)


def p_open(p):
    return {b for boxes in p.open.values() for b in boxes}


def test_operator(spark):
    texts = ["word " * n for n in (10, 3000, 500, 1, 2047, 900)] + ["", None, " ", "中文" * 3000, "word " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumnRenamed("id", "key").coalesce(1)
    got = pack.pack(df, "key", "text").collect()
    count = pack.token_counter(f"{pack.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    total, boxes = defaultdict(int), defaultdict(list)
    for r in got:
        total[r["key"]] += r["n_tokens"]
        boxes[r["container_id"]].append((r["container_start"], r["n_tokens"]))
        if r["part_no"]:
            assert count(texts[r["key"]]) > 2048
    assert total == {i: count(t) for i, t in enumerate(texts) if t}
    for parts in boxes.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 2048
    assert pack.pack(df.limit(0), "key", "text").count() == 0
