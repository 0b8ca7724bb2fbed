"""Listing a tree of folders from its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import stored


def reached(edges: DataFrame, root: str) -> DataFrame:
    """(parent) of every folder that ``root`` leads to, itself included; ``edges`` has id, parent, is_folder.

    Breadth first: a step joins the last level with the edges and keeps what no level had, so that
    folders with several parents are read once and a cycle ends. Each level is stored."""
    spark = edges.sparkSession
    seen = level = stored(spark.createDataFrame([(root,)], "parent string"), "folders")
    folders = edges.filter("is_folder").select("id", "parent")
    while True:
        below = folders.join(level, "parent").select(F.col("id").alias("parent")).distinct()
        level = stored(below.join(seen, "parent", "left_anti"), "folders")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def listed(edges: DataFrame, root: str) -> DataFrame:
    """The edges of the files in the folders that ``root`` leads to: a row for each such folder."""
    return edges.filter("NOT is_folder").join(reached(edges, root), "parent", "left_semi").select(*edges.columns)


def in_locale_order(files: DataFrame, folder: str, name: str, key: str, collation: str = "UNICODE") -> DataFrame:
    """``files`` with a column place: from 1 in each folder, by name as a locale sorts it, ties by key."""
    order = Window.partitionBy(folder).orderBy(F.collate(F.col(name), collation), key)
    return files.withColumn("place", F.row_number().over(order))
