"""Ordered analytics over events: matching, marked windows, gaps, bursts, peaks, directions.

What goes by the order of a group's rows is built on `order`, so a group may have any number of rows. Windows that take histograms or days have few rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.order import running, running_sums, with_next, with_prior


def between_markers(df: DataFrame, by: list[str], order: list[str], is_start: Column, is_end: Column) -> DataFrame:
    """The rows of each group after the first start marker and before the first end marker that follows it; null flags are no markers. The order should be total."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    d = running(df.withColumn("_s", flag(is_start)), by, order, F.col("_s"), "_in")
    d = d.where("_in > _s")
    return running(d, by, order, flag(is_end), "_out").where("_out = 0").drop("_s", "_in", "_out")


def match_responses(queries: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Each response with the query of its key that comes directly before it: key, query_id, response_id, start, end.

    Both: the key columns, t and id; rows with a null among them take no part. A later query replaces one that waits, and a match uses it up; so a
    response matches if the event just before it, queries before responses at one time, is a query.
    """
    both = queries.select(*key, "t", "id", F.lit(0).alias("side")).unionByName(responses.select(*key, "t", "id", F.lit(1).alias("side"))).dropna()
    both = with_next(both, key, [F.col("t"), F.col("side"), F.col("id")], {"side": "_side", "t": "end", "id": "response_id"}).where("side = 0 AND _side = 1")
    return both.select(*key, F.col("id").alias("query_id"), "response_id", F.col("t").alias("start"), "end")


def gaps(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """df with gap, the time since the row before in its group; null for the first."""
    d = with_prior(df, by, [F.col(time), F.col(tie)], {time: "_prior"})
    return d.withColumn("gap", F.col(time) - F.col("_prior")).drop("_prior")


def bursts(df: DataFrame, by: list[str], time: str, tie: str, within: int) -> DataFrame:
    """Runs of events at most `within` apart: by, burst (from 0), n, start, end."""
    d = gaps(df.select(*by, time, tie), by, time, tie)
    d = running(d, by, [time, tie], F.when(F.col("gap") <= within, 0).otherwise(1), "burst").withColumn("burst", F.col("burst") - 1)
    return d.groupBy(*by, "burst").agg(F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("end"))


def direction_runs(df: DataFrame, by: list[str], order: list[str], direction: str) -> DataFrame:
    """Runs of rows of one direction: by, run (from 1), direction, n."""
    columns = list(dict.fromkeys([*by, *order, direction]))
    d = with_prior(df.select(*columns), by, [F.col(c) for c in order], {direction: "_prior"})
    d = running(d, by, order, F.when(F.col("_prior").eqNullSafe(F.col(direction)), 0).otherwise(1), "run")
    return d.groupBy(*by, "run", direction).agg(F.count("*").alias("n"))


def peaks(histogram: DataFrame, by: list[str], value: str, count: str, reach: int = 50) -> DataFrame:
    """The values whose count no other among the `reach` before and reach - 1 after exceeds; only where the whole window is there."""
    w = Window.partitionBy(*by).orderBy(value)
    near = w.rowsBetween(-reach, reach - 1)
    d = histogram.withColumn("_most", F.max(count).over(near)).withColumn("_n", F.count("*").over(near))
    return d.where((F.col("_n") == 2 * reach) & (F.col(count) >= F.col("_most"))).drop("_most", "_n")


def sampled_points(cumulative: DataFrame, by: list[str], order: str, steps: int) -> DataFrame:
    """About `steps` rows of each group at even distances, and its last row."""
    d = running_sums(cumulative.withColumn("_one", F.lit(1)), by, [order], "_one", "_i", "_n")
    return d.where(((F.col("_i") - 1) % F.greatest(F.lit(1), F.expr(f"_n div {steps - 1}")) == 0) | (F.col("_i") == F.col("_n"))).drop("_one", "_i", "_n")


def trimmed_smooth(df: DataFrame, by: list[str], order: str, value: str, n: int, drop: int = 2) -> DataFrame:
    """df with smooth, the mean of the next n values, the row's own included, without the `drop` largest; 0 if none is left."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, n - 1)
    kept = F.slice("_l", 1, F.greatest(F.size("_l") - drop, F.lit(0)))
    mean = F.coalesce(F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept)), F.lit(0.0))
    return df.withColumn("_l", F.sort_array(F.collect_list(F.col(value).cast("double")).over(w))).withColumn("smooth", mean).drop("_l")


def throttle(df: DataFrame, by: list[str], time: str, tie: str, delta: int) -> DataFrame:
    """df with sent: the earliest time, at or after its own, at least delta after the row before was sent."""
    d = running(df, by, [time, tie], F.lit(1), "_i")
    d = running(d, by, [time, tie], F.col(time) - F.col("_i") * delta, "_late", how="max")
    return d.withColumn("sent", F.col("_late") + F.col("_i") * delta).drop("_i", "_late")


def log_bucket(value: Column) -> Column:
    """The number of binary digits, 0 for 0 and less."""
    return F.when(value > 0, F.length(F.bin(value))).otherwise(0)


def root2_bucket(value: Column) -> Column:
    """The whole logarithm to base sqrt(2), 0 for 0 and less: twice the binary one, plus 1 if the square exceeds an odd power."""
    whole = F.length(F.bin(value)) - 1
    over = value.cast("double") / F.pow(F.lit(2.0), whole)
    return F.when(value > 0, 2 * whole + F.when(over * over >= 2.0, 1).otherwise(0)).otherwise(0).cast("int")
