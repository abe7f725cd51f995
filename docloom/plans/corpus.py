"""Queries of the two general corpus problems: nested records (p2) and hierarchies (p4)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.common import current_rows, strip, table
from docloom.operators import hierarchy, nested

RECORD_FIELDS = ("doc_name", "total_pages", "toc_detected", "num_chunks")
NODE_FIELDS = ("node_id", "title", "text", "content", "start_index", "end_index", "start_page", "end_page", "line_num", "summary", "prefix_summary", "meta.lang")


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "doc_tree").select("tree_id", "received_at", "payload"), ["tree_id"], "received_at")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of every readable current record: the links of the pivoted node table."""
    rows = nested.pivot(nested.shred(_trees(spark, sf_dir), "tree_id", "payload", tables=["node"], paths=[nested.PARENT]), "node", [])
    return rows.select(F.col("key").alias("tree_id"), F.col("row").alias("node_pos"), F.col("parent_row").alias("parent_pos"))


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table: link to parent and record, and the fields of all three dialects in common columns."""
    rows = nested.shred(_trees(spark, sf_dir), "tree_id", "payload", tables=["node"], paths=[nested.PARENT, *NODE_FIELDS])
    flat = nested.pivot(rows, "node", NODE_FIELDS)
    page = lambda *names: F.coalesce(*[F.expr(f"try_cast({n} as int)") for n in names])
    return flat.select(
        F.col("key").alias("tree_id"), F.col("row").alias("node_pos"), F.col("parent_row").alias("parent_pos"), "node_id", "title",
        F.coalesce("text", "content").alias("text"), F.coalesce("summary", "prefix_summary").alias("summary"),
        page("start_index", "start_page", "line_num").alias("start_index"), page("end_index", "end_page").alias("end_index"), F.col("meta_lang").alias("lang"),
    )


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table: one flat row per readable current record."""
    rows = nested.shred(_trees(spark, sf_dir), "tree_id", "payload", tables=["record"], paths=[nested.PARENT, *RECORD_FIELDS])
    flat = nested.pivot(rows, "record", RECORD_FIELDS)
    whole = lambda n: F.expr(f"try_cast({n} as int)").alias(n)
    return flat.select(F.col("key").alias("tree_id"), "doc_name", whole("total_pages"), F.expr("try_cast(toc_detected as boolean)").alias("toc_detected"), whole("num_chunks"))


def p2_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that nobody declared: the boxes in the unknown field ``meta`` of nodes."""
    name = "node.meta.boxes"
    rows = nested.shred(_trees(spark, sf_dir), "tree_id", "payload", tables=[name], paths=[nested.PARENT, "x0"])
    return nested.pivot(rows, name, ["x0"]).select(F.col("key").alias("tree_id"), F.col("row").alias("box_pos"), F.col("parent_row").alias("node_pos"), F.expr("try_cast(x0 as double)").alias("x0"))


def _norm(col: str):
    return F.lower(strip(col))


def folder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of ``folder``: fd_id, parent_id (null for none), level, digest and length of the stored path."""
    ids = F.filter(F.transform(F.split("path", ","), lambda x: F.lower(strip(x))), lambda x: x != "")
    rows = table(spark, sf_dir, "folder").select(
        _norm("fd_id").alias("fd_id"),
        F.when(~_norm("parent_id").isin("", "0"), _norm("parent_id")).alias("parent_id"),
        "level",
        "update_time",
        F.sha2(F.array_join(F.coalesce(ids, F.array().cast("array<string>")), ","), 256).alias("stored"),
    )
    return current_rows(rows.filter("fd_id is not null"), ["fd_id"], "update_time")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders whose stored path or level disagrees with the links, and folders that run into a circle."""
    tree = hierarchy.nested_sets(folder_rows(spark, sf_dir), "fd_id", "parent_id")
    out = T.StructType([T.StructField("fd_id", T.StringType()), T.StructField("root_fd_id", T.StringType()), T.StructField("wrong", T.BooleanType())])

    def compare(stack: list[str], row: tuple) -> tuple:
        level, stored = row
        wrong = hashlib.sha256(",".join(stack).encode()).hexdigest() != stored or level is not None and int(level) != len(stack)
        return stack[-1], stack[0], wrong

    astray = hierarchy.with_paths(tree, "fd_id", ["level", "stored"], out=out, make=compare).filter("wrong").drop("wrong")
    return astray.unionByName(tree.filter("on_cycle").select("fd_id", F.col("cycle_id").alias("root_fd_id")))


def p4_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder with its full path, depth, root, number of descendants, or (depth 0, no path) the circle it runs into."""
    tree = hierarchy.nested_sets(folder_rows(spark, sf_dir).select("fd_id", "parent_id"), "fd_id", "parent_id")
    sized = tree.withColumn("descendants", F.col("last") - F.col("pre"))
    out = T.StructType([T.StructField("fd_id", T.StringType()), T.StructField("depth", T.LongType()), T.StructField("descendants", T.LongType()), T.StructField("root_fd_id", T.StringType()), T.StructField("path", T.StringType())])
    flat = hierarchy.with_paths(sized, "fd_id", ["depth", "descendants"], out=out, make=lambda stack, row: (stack[-1], *row, stack[0], ",".join(stack)))
    loops = tree.filter("on_cycle").select("fd_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("descendants"), F.col("cycle_id").alias("root_fd_id"), F.lit("").alias("path"), F.lit(True).alias("on_cycle"))
    return flat.withColumn("on_cycle", F.lit(False)).unionByName(loops)


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every root folder, with their distance."""
    tree = hierarchy.nested_sets(folder_rows(spark, sf_dir).select("fd_id", "parent_id"), "fd_id", "parent_id")
    return hierarchy.descendants(tree, tree.filter("depth = 1").select("fd_id"), "fd_id")


def p4_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every folder, with their distance."""
    tree = hierarchy.nested_sets(folder_rows(spark, sf_dir).select("fd_id", "parent_id"), "fd_id", "parent_id")
    return hierarchy.all_descendants(tree, "fd_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_records, p2_boxes, p4_found, p4_folders, p4_descendants, p4_all_descendants)}

_FOLDERS = r"""
WITH RECURSIVE norm AS (
  SELECT lower(trim(fd_id, e' \t\n\r')) AS fd_id, nullif(nullif(lower(trim(parent_id, e' \t\n\r')), ''), '0') AS parent_id, level, update_time,
         list_filter(list_transform(string_split(coalesce(path, ''), ','), lambda x: lower(trim(x, e' \t\n\r'))), lambda x: x <> '') AS stored
  FROM folder WHERE fd_id IS NOT NULL),
cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fd_id ORDER BY update_time DESC NULLS LAST) AS rn FROM norm) WHERE rn = 1),
link AS (SELECT c.fd_id, p.fd_id AS parent_id, c.level, c.stored FROM cur c LEFT JOIN cur p ON c.parent_id = p.fd_id),
down AS (
  SELECT fd_id, fd_id AS root_fd_id, [fd_id] AS path FROM link WHERE parent_id IS NULL
  UNION ALL SELECT l.fd_id, d.root_fd_id, list_append(d.path, l.fd_id) FROM down d JOIN link l ON l.parent_id = d.fd_id),
lost AS (SELECT fd_id, parent_id FROM link WHERE fd_id NOT IN (SELECT fd_id FROM down)),
walk AS (
  SELECT fd_id, fd_id AS spot, 0 AS steps FROM lost
  UNION ALL SELECT w.fd_id, l.parent_id, steps + 1 FROM walk w JOIN lost l ON l.fd_id = w.spot WHERE steps < 2 * (SELECT count(*) FROM lost)),
ring AS (SELECT fd_id, min(spot) AS cycle_id FROM walk WHERE steps >= (SELECT count(*) FROM lost) GROUP BY fd_id)
"""

ORACLES = {
    "p4_found": _FOLDERS + """SELECT d.fd_id, d.root_fd_id FROM down d JOIN link l USING (fd_id) WHERE l.stored <> d.path OR l.level <> len(d.path)
UNION ALL SELECT fd_id, cycle_id FROM ring""",
    "p4_folders": _FOLDERS + """, kids AS (SELECT a AS fd_id, count(*) - 1 AS n FROM (SELECT unnest(path) AS a FROM down) GROUP BY a)
SELECT d.fd_id, CAST(len(d.path) AS BIGINT) AS depth, CAST(k.n AS BIGINT) AS descendants, d.root_fd_id, array_to_string(d.path, ',') AS path, false AS on_cycle FROM down d JOIN kids k USING (fd_id)
UNION ALL SELECT fd_id, 0, 0, cycle_id, '', true FROM ring""",
    "p4_descendants": _FOLDERS + "SELECT root_fd_id AS ancestor, fd_id AS descendant, CAST(len(path) - 1 AS BIGINT) AS distance FROM down WHERE len(path) > 1",
    "p4_all_descendants": _FOLDERS + """SELECT path[i] AS ancestor, fd_id AS descendant, CAST(len(path) - i AS BIGINT) AS distance
FROM (SELECT fd_id, path, unnest(range(1, len(path))) AS i FROM down)""",
}
