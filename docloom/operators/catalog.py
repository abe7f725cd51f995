"""Catalogue tables: lookups, paging, changes, folder trees, search by condition.

Tables are immutable: a change returns the new content, to be written as a new version. Pages are in key order, since
contents of a page are otherwise undefined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.common import strip


def lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row with this key (one of several, if it is repeated)."""
    return df.filter(F.col(key) == value).limit(1)


def page(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int = 100, **equal: Any) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in key order of those that fulfil the equalities; None asks nothing."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(*order).offset(skip).limit(limit)


def update(df: DataFrame, where: Column, changes: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in changes.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.filter(~F.coalesce(where, F.lit(False)))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows, allowMissingColumns=True)


def replace_documents(index: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """An index after documents were processed again: their old rows are gone, nothing stands twice."""
    return index.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def condition(df: DataFrame, equal: Mapping[str, Any]) -> DataFrame:
    """Conjunction of equalities; a list asks for any of its values, None for null."""
    for c, v in equal.items():
        df = df.filter(F.col(c).isNull() if v is None else F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return df


def search(df: DataFrame, fields: Sequence[str], equal: Mapping[str, Any] | None = None, order_by: Sequence[tuple[str, int]] = (), offset: int = 0, limit: int | None = None, count_by: Sequence[str] = ()) -> DataFrame:
    """The abstract search request: fields, conditions, order (0 ascending, 1 descending), page, or counts by field."""
    df = condition(df, equal or {})
    if count_by:
        return df.groupBy(*count_by).agg(F.count("*").alias("doc_count"))
    if order_by:
        df = df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order_by])
    if offset:
        df = df.offset(offset)
    return (df.limit(limit) if limit is not None else df).select(*fields)


# ---- folders: fd_id, parent_id, kb_id, name, path (comma path from the root), level


def no_parent(parent: Column) -> Column:
    return F.coalesce(strip(parent), F.lit("")).isin("", "0")


def siblings_with_name(folders: DataFrame) -> DataFrame:
    """Names that stand more than once in one parent of one knowledge base: what a duplicate check refuses."""
    parent = F.when(no_parent(F.col("parent_id")), "0").otherwise(F.col("parent_id"))
    return folders.groupBy("kb_id", parent.alias("parent_id"), "name").agg(F.count("*").alias("folders")).filter("folders > 1")


def folder_exists(folders: DataFrame, name: str, parent_id: str | None, kb_id: str, exclude: str | None = None) -> bool:
    same = (F.col("kb_id") == kb_id) & (F.col("name") == name)
    same &= no_parent(F.col("parent_id")) if parent_id in (None, "", "0") else F.col("parent_id") == parent_id
    if exclude:
        same &= F.col("fd_id") != exclude
    return not folders.filter(same).isEmpty()


def create_folder(folders: DataFrame, fd_id: str, name: str, kb_id: str, parent_id: str | None = None) -> DataFrame:
    """The table with one more folder, its path and level taken from the parent; ValueError for a sibling of that name."""
    if folder_exists(folders, name, parent_id, kb_id):
        raise ValueError(f"folder {name!r} exists")
    if parent_id in (None, "", "0"):
        row = folders.sparkSession.createDataFrame([(fd_id, name, kb_id, "0", fd_id, 1)], "fd_id string, name string, kb_id string, parent_id string, path string, level int")
    else:
        row = folders.filter(F.col("fd_id") == parent_id).limit(1).select(
            F.lit(fd_id).alias("fd_id"), F.lit(name).alias("name"), F.lit(kb_id).alias("kb_id"), F.col("fd_id").alias("parent_id"),
            F.concat_ws(",", "path", F.lit(fd_id)).alias("path"), (F.col("level") + 1).alias("level"),
        )
    return insert(folders, row)


def rename_folder(folders: DataFrame, fd_id: str, name: str) -> DataFrame:
    """LookupError for an unknown folder, ValueError for a sibling of that name."""
    old = folders.filter(F.col("fd_id") == fd_id).first()
    if old is None:
        raise LookupError(fd_id)
    if folder_exists(folders, name, old["parent_id"], old["kb_id"], fd_id):
        raise ValueError(f"folder {name!r} exists")
    return update(folders, F.col("fd_id") == fd_id, {"name": F.lit(name)})


def path_ids(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, ","), lambda x: F.lower(strip(x))), lambda x: x != "")


def below(folders: DataFrame, ids: Sequence[str], by_prefix: bool = False) -> DataFrame:
    """The folders whose stored path names one of ``ids``; nothing for no ids.

    ``by_prefix`` keeps the older behaviour, that a path must begin with the id, which only root folders do.
    """
    if not ids:
        return folders.limit(0)
    hit = F.lit(False)
    for i in ids:
        hit |= F.col("path").startswith(i) if by_prefix else F.array_contains(path_ids(F.col("path")), i)
    return folders.filter(hit)


def descendant_counts(folders: DataFrame) -> DataFrame:
    """For every folder named in a stored path: how many paths name it."""
    return folders.select(F.explode(path_ids(F.col("path"))).alias("fd_id")).groupBy("fd_id").agg(F.count("*").alias("folders"))


# ---- SQL pass-through


_LIKE = re.compile(r"(\w+_tks)\s+(?:like|=)\s+'([^']*)'", re.I)


def rewrite_match(sql: str) -> str:
    """``x_tks LIKE '%a b%'`` and ``x_tks = 'a b'`` become: at least 30 % of the words stand in the column."""

    def to(m: re.Match) -> str:
        words = [w for w in re.split(r"\W+", m[2].replace("%", "").lower()) if w]
        if not words:
            return "true"
        array = ", ".join(f"'{w}'" for w in words)
        return f"size(array_intersect(array({array}), split(lower({m[1]}), '[^\\\\p{{L}}\\\\p{{N}}_]+'))) >= {max(1, int(len(words) * 0.3))}"

    return _LIKE.sub(to, re.sub(r"[ `]+", " ", sql)).strip()


def run_sql(spark, sql: str, fetch_size: int | None = None) -> DataFrame:
    out = spark.sql(rewrite_match(sql))
    return out if fetch_size is None else out.limit(fetch_size)
