import random

from docloom.operators import hierarchy


def brute(rows):
    parent = {i: p for i, p in rows}
    out = {}
    for i in parent:
        path, at, seen = [], i, set()
        while at is not None and at in parent and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[at] if parent[at] in parent else None
        if at is not None:  # ran into a circle
            ring, x = [], at
            while x not in ring:
                ring.append(x)
                x = parent[x]
            out[i] = ("cycle", min(ring))
        else:
            out[i] = ("path", tuple(reversed(path)))
    return out


def check(spark, rows, block=hierarchy.BLOCK):
    df = spark.createDataFrame(rows, "id string, up string").repartition(3)
    tree = hierarchy.nested_sets(df, "id", "up").cache()
    want = brute(rows)
    paths = {r["id"]: tuple(r["path"]) for r in hierarchy.with_paths(tree, "id", ["id"], block=block).collect()}
    loops = {r["id"]: r["cycle_id"] for r in tree.filter("on_cycle").collect()}
    assert paths == {i: p for i, (k, p) in want.items() if k == "path"}
    assert loops == {i: p for i, (k, p) in want.items() if k == "cycle"}
    size = {r["id"]: r["last"] - r["pre"] for r in tree.filter("not on_cycle").collect()}
    for i, p in paths.items():
        assert size[i] == sum(i in q[:-1] for q in paths.values())
    return tree, paths


def test_random_forests_with_circles(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        up = rnd.choice([None, "missing", f"n{rnd.randrange(120):03d}", f"n{rnd.randrange(max(1, i)):03d}", f"n{max(0, i - 1):03d}"])
        rows.append((f"n{i:03d}", up))
    check(spark, rows, block=7)


def test_deep_chain_hot_parent_and_rings(spark):
    rows = [("r", None)] + [(f"c{i:03d}", f"c{i - 1:03d}" if i else "r") for i in range(150)] + [(f"h{i:03d}", "r") for i in range(60)]
    rows += [("s", "s"), ("a", "b"), ("b", "c"), ("c", "a"), ("t1", "a"), ("t2", "t1")]
    tree, paths = check(spark, rows, block=16)
    below = hierarchy.descendants(tree, tree.filter("id in ('r', 'c100')").select("id"), "id", block=16).collect()
    assert sum(r["ancestor"] == "r" for r in below) == 210
    assert {r["descendant"]: r["distance"] for r in below if r["ancestor"] == "c100"} == {f"c{i:03d}": i - 100 for i in range(101, 150)}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id string, up string, depth int, pre string")
    assert hierarchy.nested_sets(empty, "id", "up").count() == 0
    df = spark.createDataFrame([("a", None, 9, "x"), ("b", "a", 9, "y"), (None, "a", 1, "z")], "id string, up string, depth int, pre string")
    got = {r["id"]: (r["depth"], r["on_cycle"]) for r in hierarchy.nested_sets(df, "id", "up").collect()}
    assert got == {"a": (1, False), "b": (2, False), None: (2, False)}


def test_descendants_of_every_node(spark):
    rows = [("r", None)] + [(f"c{i:03d}", f"c{i - 1:03d}" if i else "r") for i in range(40)] + [(f"h{i}", "c010") for i in range(9)]
    rows += [("a", "b"), ("b", "a"), ("t", "a")]
    tree, paths = check(spark, rows, block=16)
    got = sorted((r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.all_descendants(tree, "id", block=16).collect())
    assert got == sorted((a, p[-1], len(p) - 1 - i) for p in paths.values() for i, a in enumerate(p[:-1]))
    assert len({a for a, _, _ in got}) == 40


def test_hot_root_is_split(spark, monkeypatch):
    """More than a third of the rows hang on one root, and a circle has many tails: parts of groups give the same trees."""
    rows = [("r", None)] + [(f"c{i}", "r") for i in range(60)] + [(f"g{i}", f"c{i % 60}") for i in range(60)]
    rows += [("x", "y"), ("y", "x")] + [(f"t{i}", "x") for i in range(40)]
    plain = hierarchy._salted_join
    monkeypatch.setattr(hierarchy, "_salted_join", lambda *a, **k: plain(*a[:5], 7, **k))
    check(spark, rows)
