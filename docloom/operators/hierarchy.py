"""Parent-child rows to nested sets, full paths, roots, descendants and cycles.

The tree is never walked level by level: pointers are doubled, so a tree of depth d takes log2(d) rounds of joins on
rows of numbers, whatever its shape. A round moves only rows that are still under way, and the nodes they point at: a node
whose way up is known, and which nobody points at any more, is set aside.

1. *Upward.* With ``anc`` the ancestor at distance 2^k and ``size`` the number of descendants nearer than 2^k,
   ``size'(v) = size(v) + sum of size(u) over anc(u) = v`` and ``anc'(v) = anc(anc(v))``. Depth and root come along.
2. *Cycles.* A round in which no row arrives ends the loop; rows under way by then hang on a circle.
3. *Downward.* Siblings get preorder offsets from prefix sums over their subtree sizes (summed in salted groups first, so
   that a parent of millions is no single task); offsets are added up along the ancestors, again by doubling.
4. Ancestors and descendants are read off the ranges ``[pre, last]``.

Joins on ``anc`` are salted: rows are counted by a bounded number of hash groups, and a group that is large (one ancestor
may have a third of all rows below it) is split in as many parts as it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.functions.common import cut, release

#: Preorder positions in one unit of work of :func:`with_paths`.
BLOCK = 4096
#: Rows that :func:`with_paths` hands on at once where a node gives several.
ROWS = 50_000
#: Hash groups that rows are counted by before a join on their ancestor, and rows in a part of a large group.
GROUPS, PART_ROWS = 1024, 500_000
#: What nested_sets adds; columns of the input with these names are replaced.
RESULT = ("nid", "root_nid", "depth", "pre", "last", "on_cycle", "cycle_id")


def nested_sets(df: DataFrame, id_col: str, parent_col: str, *, salts: int = 32) -> DataFrame:
    """Columns of ``df`` plus ``nid, root_nid, depth, pre, last, on_cycle, cycle_id``.

    ``df`` has one row per id. A row whose parent is null or names no id is a root (depth 1). ``pre`` and ``last`` are
    the preorder position of the node and of its last descendant within its tree (from 0), so ``last - pre`` is the
    number of descendants. Siblings stand in a fixed order of no meaning. For rows whose way up never ends
    ``on_cycle`` is true, ``cycle_id`` the smallest id on the circle it runs into, and the other columns are null. Rows
    with a null id are kept under their parent, and nobody's parents. Columns of ``df`` that bear a name in :data:`RESULT` are
    replaced. An empty table gives an empty table.
    """
    base = cut(df.drop(*[c for c in RESULT if c not in (id_col, parent_col)]).withColumn("nid", F.monotonically_increasing_id()))
    ids = base.select(F.col(id_col).alias("__pid"), F.col("nid").alias("par")).filter("__pid is not null")
    wanted = base.select("nid", F.col(parent_col).alias("__pid"))
    counts = _counts(wanted.filter("__pid is not null"), "__pid")
    links = _salted_join(wanted.filter("__pid is not null"), ids, "__pid", "nid", counts, PART_ROWS, how="left").select("nid", "par")
    links = links.unionByName(wanted.filter("__pid is null").select("nid", F.lit(None).cast("long").alias("par")))
    sized, lost, rounds = _upward(links)
    pre = _downward(sized, rounds, salts)
    release(sized)
    out = base.join(pre.withColumnRenamed("root", "root_nid"), "nid", "left")
    loops = _cycles(lost, base.select("nid", F.col(id_col).alias("id"))) if lost is not None else None
    if loops is None:
        return out.withColumn("on_cycle", F.lit(False)).withColumn("cycle_id", F.lit(None).cast(df.schema[id_col].dataType))
    return out.join(loops, "nid", "left").withColumn("on_cycle", F.col("root_nid").isNull())


def _group(col: str) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(GROUPS)).cast("int")


def _counts(rows: DataFrame, key: str) -> dict[int, int]:
    """Rows by hash group of the key: at most :data:`GROUPS` numbers, whatever the input."""
    return {r["g"]: r["count"] for r in rows.groupBy(_group(key).alias("g")).count().collect()}


def _salted_join(rows: DataFrame, heads: DataFrame, key: str, own: str, counts: dict[int, int], part_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``heads`` (one row per ``key``), hash groups of many rows split by a hash of ``own``."""
    parts = {g: -(-n // part_rows) for g, n in counts.items() if n > part_rows}
    if not parts:
        return rows.join(heads, key, how)
    table = F.array(*[F.lit(parts.get(g, 1)) for g in range(GROUPS)])
    n = table[_group(key)]
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(own), n).cast("int"))
    heads = heads.withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.join(heads, [key, "__part"], how).drop("__part")


def _upward(links: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame | None, list[dict[int, int]]]:
    """(``nid, par, root, depth, size, tall`` of nodes in trees; ``nid, par`` of nodes that run into circles, if any; counts).

    ``tall`` is the number of rounds in which some row points at the node; the counts are those of each round's joins.
    """
    is_root = F.col("par").isNull()
    state = cut(
        links.select(
            "nid", "par", F.col("par").alias("anc"), F.lit(1).cast("long").alias("size"),
            F.when(is_root, F.col("nid")).alias("root"), F.when(is_root, F.lit(1)).cast("long").alias("depth"), F.lit(False).alias("aside"),
        )
    )
    done: list[DataFrame] = []
    rounds: list[dict[int, int]] = []
    step, left = 1, None
    while True:
        counts = _counts(state.filter("anc is not null"), "anc")
        now = sum(counts.values())
        if now == 0 or now == left:
            break
        rounds.append(counts)
        left = now
        asked = state.filter("anc is not null").groupBy(F.col("anc").alias("nid")).agg(F.sum("size").alias("add"))
        met = state.filter("not aside").join(asked, "nid", "left").withColumn("size", F.col("size") + F.coalesce("add", F.lit(0)))
        heads = met.filter("add is not null").select(F.col("nid").alias("anc"), F.col("anc").alias("anc2"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        going = _salted_join(met.filter("anc is not null").drop("add", "aside"), heads, "anc", "nid", counts, part_rows)
        going = going.select("nid", "par", F.col("anc2").alias("anc"), "size", F.col("r2").alias("root"), (F.col("d2") + step).alias("depth"), F.lit(False).alias("aside"))
        arrived = met.filter("anc is null").select("nid", "par", "anc", "size", "root", "depth", F.col("add").isNull().alias("aside"))
        state = cut(going.unionByName(arrived))
        # rows set aside are kept in this table; the others go on
        done.append(state.filter("aside").withColumn("tall", F.lit(len(rounds) - 1)))
        state = state.filter("not aside")
        step *= 2
    done.append(state.filter("anc is null").withColumn("tall", F.lit(len(rounds))))
    all_done = done[0]
    for d in done[1:]:
        all_done = all_done.unionByName(d)
    sized = cut(all_done.select("nid", "par", "root", "depth", "size", "tall"))
    lost = cut(state.filter("anc is not null").select("nid", "par")) if left else None
    release(*done)
    return sized, lost if now else None, rounds


def _downward(sized: DataFrame, rounds: list[dict[int, int]], salts: int, part_rows: int = PART_ROWS) -> DataFrame:
    """nid, root, depth, pre, last of the nodes in trees."""
    kids = sized.withColumn("salt", F.pmod(F.xxhash64("nid"), F.lit(salts)))
    inner = Window.partitionBy("par", "salt").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("par").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    below = kids.filter("par is not null")
    groups = below.groupBy("par", "salt").agg(F.sum("size").alias("total"))
    groups = groups.withColumn("before", F.coalesce(F.sum("total").over(outer), F.lit(0))).drop("total")
    state = cut(
        below.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(groups, ["par", "salt"])
        .select("nid", F.col("par").alias("anc"), (F.col("before") + F.col("within") + 1).alias("pre"), "tall")
        .unionByName(kids.filter("par is null").select("nid", F.col("par").alias("anc"), F.lit(0).cast("long").alias("pre"), "tall"))
    )
    done: list[DataFrame] = []
    for k, counts in enumerate(rounds):
        # rows point at the same ancestors as in round k upward: what is in no later round is not asked for
        done.append(state.filter(f"anc is null and tall <= {k}").select("nid", "pre"))
        heads = state.filter(f"tall > {k}").select(F.col("nid").alias("anc"), F.col("anc").alias("anc2"), F.col("pre").alias("p2"))
        going = _salted_join(state.filter("anc is not null"), heads, "anc", "nid", counts, part_rows)
        going = going.select("nid", F.col("anc2").alias("anc"), (F.col("pre") + F.col("p2")).alias("pre"), "tall")
        state = cut(going.unionByName(state.filter(f"anc is null and tall > {k}")))
    done.append(state.select("nid", "pre"))
    pre = done[0]
    for d in done[1:]:
        pre = pre.unionByName(d)
    out = cut(sized.join(pre, "nid").select("nid", "root", "depth", "pre", (F.col("pre") + F.col("size") - 1).alias("last")))
    release(*done)
    return out


def _cycles(links: DataFrame, ids: DataFrame, part_rows: int = PART_ROWS) -> DataFrame | None:
    """nid, cycle_id of the nodes that run into a circle; None if there are none.

    f^(2^k) is followed until its image no longer shrinks (then the image is the circles) and no minimum over 2^k steps
    changes on doubling (then each is the minimum of its circle).
    """
    state = cut(links.join(ids, "nid").select("nid", F.col("par").alias("anc"), F.col("id").alias("low"), F.lit(True).alias("changed")))
    groups = lambda: state.groupBy(_group("anc").alias("g")).agg(F.count("*").alias("n"), F.count_distinct("anc").alias("image"), F.max("changed").alias("changed")).collect()
    image, now = None, groups()
    while now:
        if image == sum(r["image"] for r in now) and not any(r["changed"] for r in now):
            low = state.select(F.col("nid").alias("anc"), F.col("low").alias("cycle_id"))
            return _salted_join(state.select("nid", "anc"), low, "anc", "nid", {r["g"]: r["n"] for r in now}, part_rows).select("nid", "cycle_id")
        image = sum(r["image"] for r in now)
        up = state.select(F.col("nid").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"))
        met = _salted_join(state.drop("changed"), up, "anc", "nid", {r["g"]: r["n"] for r in now}, part_rows)
        state = cut(met.select("nid", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("changed")))
        now = groups()
    return None


def with_paths(
    tree: DataFrame,
    id_col: str,
    carry: Sequence[str] = (),
    *,
    out: T.StructType | None = None,
    make: Callable[[list[str], tuple], tuple] | None = None,
    many: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """For each node of :func:`nested_sets` in a tree: ``carry`` and its path of ids from the root.

    Nodes are laid out in preorder in blocks of ``block`` positions; a node whose range crosses into later blocks is
    repeated there as an ancestor, and one pass with a stack per block gives each path. The data moved is that of the
    nodes, not of the paths. ``make(stack of ids, carried values)`` builds the row that is returned; by default the
    carried values and ``path array<string>``. With ``many`` it builds a list of rows.
    """
    carry = list(carry)
    if out is None:
        out = T.StructType([tree.schema[c] for c in carry] + [T.StructField("path", T.ArrayType(T.StringType()))])
    make = make or (lambda stack, row: (*row, list(stack)))
    names = out.fieldNames()
    node = tree.filter("root_nid is not null").select("root_nid", "pre", "last", F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    first = F.floor(F.col("pre") / block)
    own = node.withColumn("__own", F.lit(True)).withColumn("__block", first)
    over = node.filter(F.floor(F.col("last") / block) > first).select(
        "root_nid", "pre", "last", "__id", *[F.lit(None).cast(tree.schema[c].dataType).alias(f"__c{i}") for i, c in enumerate(carry)], F.lit(False).alias("__own"),
        F.explode(F.sequence(first + 1, F.floor(F.col("last") / block))).alias("__block"),
    )
    laid = own.unionByName(over).repartition("root_nid", "__block").sortWithinPartitions("root_nid", "__block", "pre")
    width = len(carry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None
        stack: list[str] = []
        ends: list[int] = []
        for pdf in batches:
            rows = []
            carried = zip(*[pdf[f"__c{i}"].astype(object).where(pdf[f"__c{i}"].notna(), None) for i in range(width)]) if width else iter([()] * len(pdf))
            for root, block_no, pre, last, own_row, ident, extra in zip(pdf["root_nid"], pdf["__block"], pdf["pre"], pdf["last"], pdf["__own"], pdf["__id"], carried):
                if at != (root, block_no):
                    at, stack, ends = (root, block_no), [], []
                while ends and ends[-1] < pre:
                    ends.pop()
                    stack.pop()
                stack.append(ident)
                ends.append(last)
                if own_row:
                    rows += make(stack, extra) if many else [make(stack, extra)]
                    if many and len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return laid.mapInPandas(run, out)


def descendants(tree: DataFrame, of: DataFrame, id_col: str, *, block: int = BLOCK) -> DataFrame:
    """(ancestor, descendant, distance) for each id of ``of`` (one column, distinct ids) and each node below it.

    Range join on ``pre`` within the tree, as an equi-join on blocks of positions.
    """
    key = of.columns[0]
    a = tree.filter("root_nid is not null and last > pre").join(of.select(F.col(key).alias(id_col)), id_col)
    a = a.select("root_nid", F.col(id_col).alias("ancestor"), F.col("pre").alias("lo"), F.col("last").alias("hi"), F.col("depth").alias("da"))
    a = a.withColumn("__block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    d = tree.filter("root_nid is not null").select("root_nid", F.col(id_col).alias("descendant"), "pre", "depth", F.floor(F.col("pre") / block).alias("__block"))
    return a.join(d, ["root_nid", "__block"]).filter("pre > lo and pre <= hi").select("ancestor", "descendant", (F.col("depth") - F.col("da")).alias("distance"))


def all_descendants(tree: DataFrame, id_col: str, *, block: int = BLOCK) -> DataFrame:
    """(ancestor, descendant, distance) for every node of a tree and each node below it.

    Read off the stack of :func:`with_paths`, so that the work is that of the pairs there are; :func:`descendants` is
    for a few chosen ancestors. Nodes that run into a circle are in no tree and have no pairs.
    """
    kind = tree.schema[id_col].dataType
    out = T.StructType([T.StructField("ancestor", kind), T.StructField("descendant", kind), T.StructField("distance", T.LongType())])

    def pairs(stack: list[str], _: tuple) -> list[tuple]:
        return [(a, stack[-1], len(stack) - 1 - i) for i, a in enumerate(stack[:-1])]

    return with_paths(tree, id_col, out=out, make=pairs, many=True, block=block)
