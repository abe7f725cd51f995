"""Most similar vectors by cross-polytope hashing, with exact reranking.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; the signed axis nearest to the
result is one hash. A key of a table is as many such hashes, one after the other, as the number of vectors asks for: a bucket
holds about :data:`BUCKET` vectors whether there are thousands or billions (the last hash looks at fewer axes, so that the
number of buckets is any power of two). A vector is stored under its key in every table and looked up under the likeliest
few keys, best first over all hashes of the key (multiprobe).

Buckets with the same leading bits form a cell, the unit that is shuffled: a vector goes to a cell once, however many of
its keys lie there. Cells that came out large are laid out by whole keys, and a single bucket above a task's size in salted
parts; their counts come from all rows. Vectors that are equal value by value are one class, and only its first member is
hashed. Candidates of the byte vectors are then compared exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.common import cut

#: Vectors in a bucket, on average.
BUCKET = 8
#: Stored rows in a cell that are aimed at, and in one part of a bucket.
CELL_ROWS, PART_ROWS = 32_000, 20_000
#: What rounding to a byte per value may change a cosine by.
SLACK = 0.012
#: Pairs compared at once.
PAIRS = 2_000_000
#: Salts of joins on a class of equal vectors.
SALTS = 16


def usable(embedding: str, dim: int) -> Column:
    """Not null, of ``dim`` values, none of them null, NaN or infinite, not all zero."""
    e = F.col(embedding)
    s = F.sort_array(e)  # nulls first, NaN last
    least, most = s[0], s[dim - 1]
    return F.coalesce((F.size(e) == dim) & (least > -float("inf")) & (most < float("inf")) & ((least != 0) | (most != 0)), F.lit(False))


def turns(dim: int, tables: int, seed: int) -> list[np.ndarray]:
    """The pseudo-random rotations, as matrices; the dimension is padded to a power of two."""
    size = 1 << max(1, (dim - 1).bit_length())
    h = np.ones((1, 1), dtype=np.float32)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    h /= np.sqrt(size, dtype=np.float32)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        r = np.eye(dim, size, dtype=np.float32)
        for _ in range(3):
            r = (r * rng.choice(np.array([-1, 1], dtype=np.float32), size)) @ h
        out.append(r)
    return out


class Keys:
    """Keys of ``bits`` bits in each of ``tables`` tables."""

    def __init__(self, dim: int, tables: int, bits: int, probes: int, seed: int = 7):
        per = (1 << max(1, (dim - 1).bit_length())).bit_length()  # bits of one hash: signed axes
        self.tables, self.bits, self.probes = tables, max(1, bits), probes
        self.widths = [min(per, self.bits - at) for at in range(0, self.bits, per)]
        rotations = turns(dim, tables * len(self.widths), seed)
        self.rotations = [rotations[t * len(self.widths) : (t + 1) * len(self.widths)] for t in range(tables)]

    def of(self, x: np.ndarray, table: int, probes: int | None = None) -> np.ndarray:
        """The likeliest keys of each row, best first; the first is the key it is stored under."""
        most = min(probes or self.probes, 1 << self.bits)
        keys, loss = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1), dtype=np.float32)
        for r, width in zip(self.rotations[table], self.widths):
            y = (x @ r)[:, : 1 << (width - 1)]
            norm = np.linalg.norm(y, axis=1, keepdims=True)
            y = y / np.where(norm == 0, 1, norm)
            y = np.concatenate([y, -y], axis=1)
            if most == 1:
                keys = (keys << width) | np.argmax(y, axis=1)[:, None]
                continue
            axes = np.argsort(-y, axis=1, kind="stable")[:, :most]
            near = np.take_along_axis(y, axes, 1)
            lost = (near[:, :1] - near) ** 2
            # both are in order of loss, so the best ``most`` sums are among places (i, j) with i x j <= most
            i, j = np.nonzero(np.outer(np.arange(1, keys.shape[1] + 1), np.arange(1, axes.shape[1] + 1)) <= most)
            keys, loss = (keys[:, i] << width) | axes[:, j], loss[:, i] + lost[:, j]
            best = np.argsort(loss, axis=1, kind="stable")[:, :most]
            keys, loss = np.take_along_axis(keys, best, 1), np.take_along_axis(loss, best, 1)
        return keys


def key_bits(rows: int, bucket: int = BUCKET) -> int:
    """Bits of a key for so many rows."""
    return max(1, math.ceil(math.log2(max(2, rows / bucket))))


def small(df: DataFrame, key: str, embedding: str, dim: int, extra: list[str] | None = None) -> DataFrame:
    """``id, h1, h2, byte``: usable vectors with a digest of their values and the values in one byte each."""
    extra = extra or []
    good = df.filter(F.col(key).isNotNull() & usable(embedding, dim)).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("e"), *extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["e"].to_numpy()).astype(np.float64)
                data = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
                yield pdf.drop(columns="e").assign(byte=[v.tobytes() for v in data])

    digest = good.select("id", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit("second"), "e").alias("h2"), *extra, "e")
    types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in good.select(*extra).schema) if extra else ""
    return digest.mapInPandas(run, f"id long, h1 long, h2 long{types}, byte binary")


def _units(values: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(values), dtype=np.int8).reshape(len(values), dim).astype(np.float32)
    # a product of whole numbers over their length: equal vectors are equally near wherever they stand
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Cells:
    """Where keys lie: their cell, or for keys of a large cell a part of it, or the parts of a large bucket."""

    def __init__(self, bits: int, rows: int, cell_rows: int):
        wanted = max(0, math.floor(math.log2(max(1, rows / cell_rows))))
        # leading bits of a key: those of its first hash, until its cells would be of a million rows
        self.shift = bits - min(bits, wanted if wanted < 7 else max(7, math.floor(math.log2(max(1, rows / 1_000_000)))))
        self.large: dict[tuple[int, int], int] = {}
        self.hot: dict[tuple[int, int], int] = {}

    def plain(self, keys: np.ndarray) -> np.ndarray:
        return keys >> self.shift

    def slots(self, table: int, keys: np.ndarray) -> np.ndarray:
        """Table, then cell and part of a large cell, in one number; -1 for keys of a large bucket."""
        cell = keys >> self.shift
        part = np.zeros_like(keys)
        for (t, c), parts in self.large.items():
            if t == table:
                at = cell == c
                part[at] = (keys[at] * 0x9E3779B1 >> 7) % parts
        out = (np.int64(table) << 54) | (cell << 16) | part
        hot = [k for t, k in self.hot if t == table]
        if hot:
            out[np.isin(keys, hot)] = -1
        return out


def _counted(rows: DataFrame, keys: Keys, cells: Cells, dim: int, cell_rows: int, part_rows: int) -> None:
    """Fill in the large cells and buckets, from counts over all stored rows."""

    def count(of, within) -> dict[tuple[int, int], int]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c: Counter = Counter()
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _units(pdf["byte"].tolist(), dim)
                for t in range(keys.tables):
                    own = keys.of(x, t, 1)[:, 0]
                    if within is not None:
                        own = own[np.isin(cells.plain(own), [k for u, k in within if u == t])]
                    value, n = np.unique(of(own), return_counts=True)
                    c.update({(t, int(v)): int(m) for v, m in zip(value, n)})
                if len(c) > 200_000:
                    yield pd.DataFrame([(t, v, m) for (t, v), m in c.items()], columns=["t", "k", "n"])
                    c = Counter()
            yield pd.DataFrame([(t, v, m) for (t, v), m in c.items()], columns=["t", "k", "n"])

        total = rows.select("byte").mapInPandas(run, "t int, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n"))
        least = 4 * cell_rows if within is None else part_rows
        return {(r["t"], r["k"]): r["n"] for r in total.filter(F.col("n") > least).collect()}  # no more than tables x rows / least

    large = count(cells.plain, None)
    if large:
        cells.hot = {k: -(-n // part_rows) for k, n in count(lambda own: own, set(large)).items()}
        cells.large = {k: min(1 << 16, -(-n // cell_rows)) for k, n in large.items()}


def _laid_out(stored: DataFrame, asking: DataFrame | None, keys: Keys, cells: Cells, dim: int) -> DataFrame:
    """``slot, id, data`` sorted by slot within partitions. The last bit of a slot is 0 for rows that are stored there.

    ``data`` is the byte vector and, as numbers of eight bytes, the keys of the row in the cell; of a stored row the first
    is the key it is stored under. Without ``asking`` the stored rows ask too.
    """

    def rows_of(store: bool, ask: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for begin in range(0, len(pdf), 5000):
                    part = pdf.iloc[begin : begin + 5000]
                    ids, raw = part["id"].to_numpy(), part["byte"].tolist()
                    x = _units(raw, dim)
                    for t in range(keys.tables):
                        ks = keys.of(x, t, None if ask else 1)
                        at = cells.slots(t, ks)
                        if (at < 0).any():
                            yield apart(t, ks, at, ids, raw, store, ask)
                        # the keys of a row, best first, by cell
                        row, probe = np.divmod(np.arange(at.size), at.shape[1])
                        flat = at.ravel()
                        order = np.lexsort((probe, flat, row)) if at.shape[1] > 1 else np.arange(len(flat))
                        order = order[flat[order] >= 0]
                        if not len(order):
                            continue
                        row, probe, flat = row[order], probe[order], flat[order]
                        packed = ks.ravel()[order].tobytes()
                        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (flat[1:] != flat[:-1])]))
                        ends = np.append(first[1:], len(row)) * 8
                        owner = row[first]
                        asks = np.zeros(len(first), dtype=bool) if not ask else (probe[first] > 0) if store else np.ones(len(first), dtype=bool)
                        data = [raw[i] + packed[a:z] for i, a, z in zip(owner.tolist(), (first * 8).tolist(), ends.tolist())]
                        yield pd.DataFrame({"slot": flat[first] * 2 + asks, "id": ids[owner], "data": data})

        return run

    def apart(t: int, ks, at, ids, raw, store: bool, ask: bool) -> pd.DataFrame:
        """Rows for the parts of large buckets: stored in one of them, asking in all."""
        out = []
        for i, j in zip(*np.nonzero(at < 0)):
            k = int(ks[i, j])
            parts = cells.hot[t, k]
            own = int(ids[i]) % parts
            base = (1 << 61) | (t << 54) | (hash((t, k)) & 0x3FFFFFFF) << 20
            for p in range(parts) if ask else (own,):
                out.append(((base + p) * 2 + (not store or j != 0 or p != own), ids[i], raw[i] + ks[i, j : j + 1].tobytes()))
        return pd.DataFrame(out, columns=["slot", "id", "data"])

    out = stored.select("id", "byte").mapInPandas(rows_of(True, asking is None), "slot long, id long, data binary")
    if asking is not None:
        out = out.unionByName(asking.select("id", "byte").mapInPandas(rows_of(False, True), "slot long, id long, data binary"))
    return out.repartition(F.expr("slot div 2")).sortWithinPartitions("slot")


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal values begin and end."""
    edges = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return [0, *edges], [*edges, len(values)]


def _unpacked(data: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, and (row, key) of all keys."""
    n = np.array([(len(d) - dim) // 8 for d in data])
    keys = np.frombuffer(b"".join(d[dim:] for d in data), dtype=np.int64)
    return _units([d[:dim] for d in data], dim), np.repeat(np.arange(len(data)), n), keys


def _meet(batches: Iterator[pd.DataFrame], among: bool, dim: int, keep, least: float | None = None) -> Iterator[pd.DataFrame]:
    """Compare every row with the stored rows under its keys, cell by cell; ``keep(asking row, asking id, stored id, cosine)``.

    Cosines under ``least`` are left out. With ``among`` the stored rows ask too; a pair under one key comes once.
    """
    cell, ids, data, ready = None, [], [], None

    def compared(q_ids, q, rows, keys, own) -> Iterator[pd.DataFrame]:
        s_ids, s, s_keys = ready
        lo, hi = np.searchsorted(s_keys, keys), np.searchsorted(s_keys, keys, side="right")
        order = np.flatnonzero(hi > lo)
        order = order[np.argsort(keys[order], kind="stable")]
        rows, keys, lo, many = rows[order], keys[order], lo[order], (hi - lo)[order]
        ends = np.cumsum(many)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n, asking = many[at:to], q[rows[at:to]]
            sim = np.empty(int(n.sum()), dtype=np.float32)
            done = 0
            for a, b in zip(*_runs(keys[at:to])):  # one product a bucket
                i, m = int(lo[at + a]), int(n[a])
                np.dot(asking[a:b], s[i : i + m].T, out=sim[done : done + (b - a) * m].reshape(b - a, m))
                done += (b - a) * m
            left = np.repeat(rows[at:to], n)
            right = np.repeat(lo[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(sim))
            if least is not None:
                near = np.flatnonzero(sim >= least)
                left, right, sim = left[near], right[near], sim[near]
            a, b = q_ids[left], s_ids[right]
            mask = np.flatnonzero(a < b if own else a != b)
            yield keep(left[mask], a[mask], b[mask], sim[mask])
            at = to

    def close() -> Iterator[pd.DataFrame]:
        """All stored rows of the cell are there: lay them out by key, and compare them among themselves."""
        nonlocal ready
        if ready is not None or not ids:
            return
        who, values = np.concatenate(ids), [d for part in data for d in part]
        x, rows, keys = _unpacked(values, dim)
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        order = np.argsort(keys[first], kind="stable")
        ready = who[order], x[order], keys[first][order]
        if among:
            yield from compared(who, x, rows[first], keys[first], True)
            yield from compared(who, x, rows[~first], keys[~first], False)

    for pdf in batches:
        slot, all_ids, raw = pdf["slot"].to_numpy(), pdf["id"].to_numpy(), pdf["data"].tolist()
        if not len(slot):
            continue
        for a, b in zip(*_runs(slot)):
            if slot[a] >> 1 != cell:
                yield from close()
                cell, ids, data, ready = slot[a] >> 1, [], [], None
            if not slot[a] & 1:
                ids.append(all_ids[a:b])
                data.append(raw[a:b])
                continue
            yield from close()
            if ready is not None:
                for i in range(a, b, 20_000):
                    z = min(b, i + 20_000)
                    x, rows, keys = _unpacked(raw[i:z], dim)
                    yield from compared(all_ids[i:z], x, rows, keys, False)
    yield from close()


def _rescored(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of pairs and ``similarity``, the cosine of the arrays ``a`` and ``b`` in double precision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf[a].to_numpy()).astype(np.float64), np.stack(pdf[b].to_numpy()).astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # values near the ends of the range have no squares
                y /= np.abs(y).max(axis=1, keepdims=True)
                dot = lambda u, v: np.einsum("ij,ij->i", u, v)
                yield pdf[keep].assign(similarity=dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)
    return pairs.select(*keep, a, b).mapInPandas(run, f"{types}, similarity double")


def _first_of_class(rows: DataFrame) -> DataFrame:
    """One row per class of equal vectors, that of the smallest id. A class is cut to one row before the shuffle."""
    w = Window.partitionBy("h1", "h2").orderBy("id")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def _members(rows: DataFrame) -> DataFrame:
    """``id, cls``: the other members of classes of several ids, with the smallest id of the class."""
    marks = rows.select("id", "h1", "h2")
    several = marks.groupBy("h1", "h2").agg(F.min("id").alias("cls"), F.max("id").alias("most")).filter("most > cls").drop("most")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marks.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(several, ["h1", "h2", "salt"]).filter("id <> cls").select("id", "cls").distinct()


def similar_classes(df: DataFrame, key: str, embedding: str, threshold: float, *, dim: int = 64, tables: int = 8, probes: int | None = None, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(``a, b, similarity``; ``id, cls``): pairs of classes of equal vectors, and the members of classes of several keys.

    A class is named by its smallest key, and pairs are of class names, the smaller first. ``probes`` grows with the bits
    of a key where it is not given.
    """
    rows = small(df, key, embedding, dim)
    reps = cut(_first_of_class(rows).select("id", "byte"))
    n = reps.count()
    bits = key_bits(n)
    keys = Keys(dim, tables, bits, probes or max(2, bits // 6))
    cells = Cells(keys.bits, n, cell_rows)
    _counted(reps, keys, cells, dim, cell_rows, part_rows)
    least = threshold - SLACK

    def keep(_, left, right, sim):
        return pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)})

    near = _laid_out(reps, None, keys, cells, dim).mapInPandas(lambda it: _meet(it, True, dim, keep, least), "a long, b long").distinct()
    vectors = df.filter(F.col(key).isNotNull() & usable(embedding, dim)).select(F.col(key).cast("long").alias("k"), F.col(embedding).alias("e"))
    both = near.join(vectors.select(F.col("k").alias("a"), F.col("e").alias("ea")), "a").join(vectors.select(F.col("k").alias("b"), F.col("e").alias("eb")), "b")
    exact = _rescored(both, "ea", "eb", ["a", "b"]).filter(F.col("similarity") >= threshold)
    return exact.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), _members(rows)


def similar_pairs(df: DataFrame, key: str, embedding: str, threshold: float, **options) -> DataFrame:
    """``a, b, similarity``: pairs of different keys, smaller first, with a cosine of ``threshold`` or more.

    Vectors that are unusable (:func:`usable`) take no part; a key that stands in several rows is one key; pairs are
    distinct; an empty table gives an empty table. Classes of equal vectors are expanded to the pairs of their members;
    where such classes are large, take :func:`similar_classes` instead. A pair at a cosine of 0.9 is missed about once in
    some thousands of times, a closer pair less often (see the tests).
    """
    pairs, members = similar_classes(df, key, embedding, threshold, **options)
    # a class of several keys: all its pairs, of a similarity of 1
    first, second = members.select("cls", F.col("id").alias("x")), members.select("cls", F.col("id").alias("y"))
    own = members.select(F.col("cls").alias("a"), F.col("id").alias("b")).unionByName(first.join(second, "cls").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    own = own.withColumn("similarity", F.lit(1.0))
    everyone = lambda cls, name: F.col(name).alias(cls)
    left = members.select(everyone("a", "cls"), everyone("ma", "id"))
    right = members.select(everyone("b", "cls"), everyone("mb", "id"))
    also_a = pairs.join(left, "a").select(F.col("ma").alias("a"), "b", "similarity")
    also_b = pairs.unionByName(also_a).join(right, "b").select("a", F.col("mb").alias("b"), "similarity")
    wide = pairs.unionByName(also_a).unionByName(also_b).unionByName(own).filter("a <> b")
    return wide.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def probe_count(rows: int) -> int:
    """Keys that a vector is looked up under in each table: a power of the number of rows well below one."""
    return max(40, math.ceil(96 * (rows / 100_000) ** 0.35))


def nearest(df: DataFrame, queries: DataFrame, key: str, embedding: str, k: int = 10, *, dim: int = 64, tables: int = 8, probes: int | None = None, spare: int | None = None, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``id, neighbour, rank, similarity``: for each query its ``k`` most similar other keys in ``df``.

    A key that stands in several usable rows is one key, with the smallest of its vectors should they differ. Ties in
    similarity go to the smaller key. Equal vectors are one class: of the stored ones its ``k + 1`` smallest keys are
    enough for every query, and queries with equal vectors are answered once. The byte vectors choose ``k + spare`` classes
    (``spare`` is half of ``k`` where it is not given), which are compared exactly.
    """
    want = k + (-(-k // 2) if spare is None else spare)

    def single(d: DataFrame) -> DataFrame:
        good = d.filter(F.col(key).isNotNull() & usable(embedding, dim)).select(F.col(key).cast("long").alias("k"), F.col(embedding).alias("e"))
        return good.groupBy("k").agg(F.min("e").alias("e"))

    by_vector = Window.partitionBy("e").orderBy("k")
    members = single(df).withColumn("r", F.row_number().over(by_vector)).filter(F.col("r") <= k + 1)
    classes = cut(members.groupBy("e").agg(F.min("k").alias("cls"), F.sort_array(F.collect_list("k")).alias("ids")))  # k + 1 ids at most
    asked = single(queries).select("k", "e", F.xxhash64("e").alias("h1"), F.xxhash64(F.lit("second"), "e").alias("h2"))
    first = cut(asked.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("k"))).filter("r = 1").select(F.col("k").alias("q"), "e", "h1", "h2"))
    n = classes.count()
    bits = key_bits(n)
    keys = Keys(dim, tables, bits, probes or probe_count(n))
    cells = Cells(keys.bits, n, cell_rows)
    stored, asking = small(classes, "cls", "e", dim), small(first, "q", "e", dim)
    _counted(stored, keys, cells, dim, cell_rows, part_rows)

    def keep(row, left, right, sim):
        """The best of each query, and what is as near as the last of them."""
        if not len(row):
            return pd.DataFrame({"id": left, "neighbour": right, "near": sim})
        rank = (row.astype(np.int64) << 32) | (3 - sim).view(np.int32)  # by query, then by distance: a float above 2 sorts by its bits
        order = np.argsort(rank)
        rank, row = rank[order], row[order]
        begin = np.searchsorted(row, row)
        last = np.minimum(begin + want, np.searchsorted(row, row, side="right") - 1)
        top = order[rank <= rank[last]]
        return pd.DataFrame({"id": left[top], "neighbour": right[top], "near": sim[top]})

    met = _laid_out(stored, asking, keys, cells, dim).mapInPandas(lambda it: _meet(it, False, dim, keep), "id long, neighbour long, near float")
    met = met.groupBy("id", "neighbour").agg(F.max("near").alias("near"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("near"), "neighbour"))).filter(F.col("r") <= want)
    # other members of the query's own class lie at the same place as the query
    same = first.join(classes, "e").select(F.col("q").alias("id"), F.col("cls").alias("neighbour"))
    best = best.select("id", "neighbour").unionByName(same).distinct()
    exact = best.join(first.select(F.col("q").alias("id"), F.col("e").alias("eq")), "id").join(classes.select(F.col("cls").alias("neighbour"), "ids", F.col("e").alias("en")), "neighbour")
    exact = _rescored(exact, "eq", "en", ["id", "ids"]).select("id", F.explode("ids").alias("neighbour"), "similarity")
    order = lambda by: Window.partitionBy(by).orderBy(F.desc("similarity"), "neighbour")
    lists = exact.withColumn("r", F.row_number().over(order("id"))).filter(F.col("r") <= k + 1).select(F.col("id").alias("q"), "neighbour", "similarity")
    # back to all queries of a class
    sizes = asked.groupBy("h1", "h2").agg(F.min("k").alias("q"), F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    who = asked.select("k", "h1", "h2", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("salt")).join(sizes, ["h1", "h2", "salt"])
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / 10_000)).cast("int")
    who = who.select("q", F.col("k").alias("id"), F.pmod(F.xxhash64("k"), parts("n")).cast("int").alias("part"))
    spread = lists.join(sizes.filter("salt = 0").select("q", "n"), "q").withColumn("part", F.explode(F.sequence(F.lit(0), parts("n") - 1))).drop("n")
    out = who.join(spread, ["q", "part"]).filter("neighbour <> id")
    return out.withColumn("rank", F.row_number().over(order("id"))).filter(F.col("rank") <= k).select("id", "neighbour", "rank", "similarity")
