"""Relational operators over a table of grouped tasks; states of a workflow are left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize


def pop(tasks: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first task of each group in the given order; only the least row of each task's partition is shuffled."""
    first = F.min_by(F.struct(*columns), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return tasks.groupBy(*by).agg(first.alias("t")).select(*by, *(F.col(f"t.{c}").alias(c) for c in columns if c not in by))


def complete_groups(tasks: DataFrame, by: list[str], size: str) -> DataFrame:
    """Groups that have as many rows as their greatest size: by, n."""
    return tasks.groupBy(*by).agg(F.count("*").alias("n"), F.max(size).alias("_size")).where("n = _size").drop("_size")


def expand(groups: DataFrame, order: list[str], size: str) -> DataFrame:
    """One row for each of the size members of a group: member from 0, and priority, rising over the groups in order.

    Prefix sums in two levels: within the ranges of the order that Spark cuts, and over the ranges' sums, one row a partition.
    """
    g = materialize(groups.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))  # the ranges must stay as they are
    sums = g.groupBy("_p").agg(F.sum(size).alias("_s"))
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0))).join(F.broadcast(sums), "_p")  # a row a partition
    g = g.where(F.col(size) > 0).withColumn("member", F.explode(F.sequence(F.lit(0), (F.col(size) - 1).cast("int"))))
    return g.withColumn("priority", F.col("_base") + F.col("_before") + F.col("member")).drop("_p", "_base", "_before")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in a random but repeatable order of their keys."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).limit(n)


def stale(tasks: DataFrame, by: list[str], modified: str, now: Column, limit: str) -> DataFrame:
    """Tasks whose last change lies more than `limit` before now: by, last_change; tasks without a time of change are left out."""
    return tasks.groupBy(*by).agg(F.max(modified).alias("last_change")).where(F.col("last_change") < now - F.expr(f"INTERVAL {limit}"))
