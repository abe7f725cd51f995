import numpy as np

from docloom.llm import neighbours


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row], "x") for i, row in enumerate(x)], "row_id long, embedding array<float>, id string")


def brute(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    return set(zip(i.tolist(), j.tolist()))


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    for k in range(0, n // 4):  # near copies at cosines from 0.9 on
        s = 0.9005 + 0.0995 * rng.random()
        a = x[k] / np.linalg.norm(x[k])
        z = rng.normal(size=64)
        z -= (z @ a) * a
        x[n - 1 - k] = (s * a + np.sqrt(1 - s * s) * z / np.linalg.norm(z)) * rng.uniform(0.1, 5)
    return x


def test_pairs_match_brute_force(spark):
    x = sample(1200, 1)
    got = {(r["a"], r["b"]) for r in neighbours.similar_pairs(frame(spark, x), "row_id", "embedding", 0.9).collect()}
    want = brute(x, 0.9)
    assert len(want) >= 300 and got <= want and len(want - got) <= 1


def test_hot_buckets_are_split(spark):
    rng = np.random.default_rng(2)
    x = (np.ones(64) + 0.35 * rng.normal(size=(400, 64))).astype(np.float32)  # a third and more in one bucket
    got = {(r["a"], r["b"]) for r in neighbours.similar_pairs(frame(spark, x), "row_id", "embedding", 0.9, part_rows=50).collect()}
    want = brute(x, 0.9)
    assert got <= want and len(got) >= 0.999 * len(want)


def test_unusable_repeated_and_empty(spark):
    good = [1.0] * 64
    rows = [(1, good), (1, good), (2, good), (3, None), (4, [0.0] * 64), (5, [float("nan")] + good[1:]), (6, good[:63]), (7, [None] + good[1:]), (None, good), (8, [float("inf")] + good[1:]), (9, [1e-30] * 64), (10, [-1.0] * 64)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<float>")
    got = sorted((r["a"], r["b"]) for r in neighbours.similar_pairs(df, "row_id", "embedding", 0.9).collect())
    assert got == [(1, 2), (1, 9), (2, 9)]
    assert neighbours.similar_pairs(df.limit(0), "row_id", "embedding", 0.9).count() == 0
    top = neighbours.nearest(df, df.filter("row_id = 2"), "row_id", "embedding", 2).collect()
    assert sorted((r["rank"], r["neighbour"]) for r in top)[0] == (1, 1)


def test_recall_of_the_ten_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 2000)] * 0.9 + rng.normal(size=(2000, 64))).astype(np.float32)
    df = frame(spark, x)
    got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, df.filter("row_id % 20 = 0"), "row_id", "embedding", 10).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(100), np.arange(100) * 20] = -2
    want = {(q * 20, int(b)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for b in row}
    assert len(got & want) >= 0.9 * len(want) and len(got) == 1000


def test_repeated_rows_and_copies_leave_room_for_the_others(spark):
    rng = np.random.default_rng(4)
    x = (np.ones(64) + 0.2 * rng.normal(size=(40, 64))).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = [int(i) for i in np.argsort(-(u @ u[0])) if i][:10]
    close = (rows[order[0]][1], rows[order[1]][1])
    often = rows + [(order[0], close[0])] * 60 + [(order[1], close[1])] * 60 + [rows[0]] * 60
    df = spark.createDataFrame(often, "row_id long, embedding array<float>").repartition(3)
    top = neighbours.nearest(df, df.filter("row_id = 0"), "row_id", "embedding", 10, probes=32).collect()
    assert [r["neighbour"] for r in sorted(top, key=lambda r: r["rank"])] == order
    # sixty copies under other ids, in no order: the smallest ids win
    ids = rng.permutation(np.arange(100, 160)).tolist()
    df = spark.createDataFrame([rows[0]] + [(i, close[0]) for i in ids], "row_id long, embedding array<float>")
    top = neighbours.nearest(df, df.filter("row_id = 0"), "row_id", "embedding", 10, probes=32).collect()
    assert [r["neighbour"] for r in sorted(top, key=lambda r: r["rank"])] == list(range(100, 110))


def test_comparisons_per_row_do_not_grow(spark):
    rng = np.random.default_rng(5)
    per_row = []
    for n in (20_000, 320_000):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        bits = neighbours.key_bits(n)
        keys = neighbours.Keys(64, 2, bits, max(2, bits // 6))
        stored = np.bincount(keys.of(x, 0, 1)[:, 0], minlength=1 << bits)
        per_row.append(stored[keys.of(x[:5000], 0, 2)].sum(axis=1).mean())
    assert per_row[1] < 1.5 * per_row[0]
    assert neighbours.probe_count(10**8) * neighbours.BUCKET < 0.001 * 10**8


def test_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 64)).astype(np.float32)
    x[0:60:3] = x[0]  # a third of the rows
    df = frame(spark, x)
    pairs, members = neighbours.similar_classes(df, "row_id", "embedding", 0.9)
    assert pairs.count() == 0 and sorted((r["id"], r["cls"]) for r in members.collect()) == [(i, 0) for i in range(3, 60, 3)]
    got = {(r["a"], r["b"]) for r in neighbours.similar_pairs(df, "row_id", "embedding", 0.9).collect()}
    assert got == brute(x, 0.9) and len(got) == 190
    top = neighbours.nearest(df, df, "row_id", "embedding", 3, probes=64)
    for q in (0, 3, 57):
        assert [r["neighbour"] for r in top.filter(f"id = {q}").orderBy("rank").collect()] == [i for i in (0, 3, 6, 9) if i != q][:3]
    assert top.count() == 180
