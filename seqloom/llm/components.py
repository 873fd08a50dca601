"""Consolidating pairwise matches into groups by alternating large-star and small-star rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import drop_table, materialize


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Give every name of the pairs the least name linked with it, directly or through others.

    pairs: two STRING columns; rows with a null side are left out, repeated, reversed and self pairs change
    nothing, other columns are ignored. Returns name, group_id (least by code points), one row a name; no
    rows for an empty input.

    Names become 64-bit numbers in name order once, so that the rounds move 16 bytes an edge and the least
    number is the least name. In each round, large-star links the larger neighbours of every node to
    its least neighbour and small-star does so for the smaller ones and the node itself; both are a partial aggregate and an
    equi-join whose one side has unique keys, so a hub's edges are never gathered and adaptive
    execution splits its partition. It ends when a round changes no edge: each component is then a star around
    its least node.
    """
    pairs = pairs.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    names = pairs.select(F.explode(F.array("x", "y")).alias("name")).distinct().orderBy("name")
    # numbers by (partition, row) of the sorted names: in name order, and fixed once written
    names = materialize(names.select("name", F.monotonically_increasing_id().alias("id")))
    edges = pairs.where("x <> y").join(names.toDF("x", "lo"), "x").join(names.toDF("y", "hi"), "y")
    edges = materialize(edges.select("hi", "lo"))
    while True:
        large = materialize(_large_star(edges))
        drop_table(edges)
        edges = materialize(_small_star(large))
        drop_table(large)
        if edges.where("changed").isEmpty():
            break
    roots = edges.select("hi", "lo").join(names.toDF("group_id", "lo"), "lo").select(F.col("hi").alias("id"), "group_id")
    return names.join(roots, "id", "left").select("name", F.coalesce("group_id", "name").alias("group_id"))


def _edges(rows: DataFrame, hi: Column, lo: Column, changed: Column) -> DataFrame:
    return rows.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.max(changed).alias("changed"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each edge (hi, lo) becomes (hi, least of lo and all neighbours of lo)."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("v"))))
    least = edges.select(ends.alias("e")).groupBy(F.col("e.u").alias("lo")).agg(F.min("e.v").alias("v")).select("lo", F.least("lo", "v").alias("m"))
    rows = edges.select("hi", "lo").join(least, "lo")
    return _edges(rows, F.col("hi"), F.col("m"), F.col("m") != F.col("lo"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and itself are linked to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.max("changed").alias("old"))
    rest = edges.join(least.select("hi", "m"), "hi").where("lo <> m")
    rows = rest.select(F.col("lo").alias("hi"), F.col("m").alias("lo"), F.lit(True).alias("changed"))
    rows = rows.unionByName(least.select("hi", F.col("m").alias("lo"), F.col("old").alias("changed")))
    return _edges(rows, F.col("hi"), F.col("lo"), F.col("changed"))
