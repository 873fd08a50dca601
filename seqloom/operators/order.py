"""Global order without a single task: numbering, zipping by position, group numbers, and look-ups of the nearest key.

All work in two levels: Spark cuts the rows into ranges, each range is scanned by itself, and what crosses their borders is carried over by
one row a range. No group, however large, has to be sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import fresh, materialize


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with the 0-based position of each row in the order; nulls come first, rows equal in the order follow one another in any way."""
    part, base, *keys = fresh(df.withColumn(name, F.lit(0)), "_part", "_base", *(f"_o{i}" for i in range(len(order))))
    d = df.select("*", *(o.alias(k) for o, k in zip(order, keys)))
    cut = materialize(d.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))  # the ranges must stay as they are
    sizes = cut.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = sizes.select(part, F.coalesce(before, F.lit(0)).alias(base))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1
    return cut.withColumn(name, local.cast("bigint")).join(F.broadcast(sizes), part).withColumn(name, F.col(base) + F.col(name)).drop(part, base, *keys)


def group_numbers(df: DataFrame, by: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """df with the 0-based position of each row within its group; null keys make a group."""
    (first,) = fresh(df.withColumn(name, F.lit(0)), "_first")
    n = materialize(numbered(df, [*map(F.col, by), *order], name))
    least = n.groupBy(*by).agg(F.min(name).alias(first)).toDF(*(f"_k{i}" for i in range(len(by))), first)
    same = [n[c].eqNullSafe(least[f"_k{i}"]) for i, c in enumerate(by)]
    return n.join(least, same).withColumn(name, F.col(name) - F.col(first)).drop(first, *(f"_k{i}" for i in range(len(by))))


def with_next(df: DataFrame, by: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """df with columns of the row that follows in its group, under new names: columns maps a column to its new name. The last row of a group gets nulls; null keys make a group."""
    return _with_neighbour(df, by, order, columns, prior=False)


def with_prior(df: DataFrame, by: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """The same with columns of the row that comes before."""
    return _with_neighbour(df, by, order, columns, prior=True)


def _with_neighbour(df: DataFrame, by: list[str], order: list[Column], columns: dict[str, str], *, prior: bool) -> DataFrame:
    part, here, over, *keys = fresh(df, "_part", "_here", "_over", *(f"_o{i}" for i in range(len(by) + len(order))))
    d = df.select("*", *(o.alias(k) for o, k in zip([*map(F.col, by), *order], keys)))
    cut = materialize(d.repartitionByRange(*keys).withColumn(part, F.spark_partition_id())).withColumn(here, F.struct(*by, *columns))
    edge, step = (F.max_by, F.lag) if prior else (F.min_by, F.lead)
    edges = cut.groupBy(part).agg(edge(here, F.struct(*keys)).alias(here))
    edges = edges.select(part, step(here).over(Window.orderBy(part)).alias(over))  # a row a range
    d = cut.withColumn("_near", step(here).over(Window.partitionBy(part).orderBy(*keys))).join(F.broadcast(edges), part)
    found = F.coalesce("_near", over)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(found[c])
    return d.select(*df.columns, *(F.when(same, found[c]).alias(n) for c, n in columns.items()))


def running_sums(df: DataFrame, by: list[str], order: list[str], value: str, upto: str = "upto", total: str = "total") -> DataFrame:
    """df with upto, the sum of value over the row and those before it in its group, and total, its group's sum; null keys make a group, null values add nothing.

    A group may be longer than a range: what it has in the ranges before is added by one row for each range that goes on with a group.
    """
    part, base, whole = fresh(df.withColumns({upto: F.lit(0), total: F.lit(0)}), "_part", "_base", "_whole")
    cut = materialize(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))  # the ranges must stay as they are
    group = Window.partitionBy(*by)
    ends = cut.groupBy(part, *by).agg(F.sum(value).alias("_s")).withColumn("_n", F.count("*").over(group)).where("_n > 1")  # at most two rows a range
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(part).alias("_p"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(base), F.sum("_s").over(group).alias(whole))
    local = Window.partitionBy(part, *by)
    d = cut.withColumn(upto, F.coalesce(F.sum(value).over(local.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))).withColumn(total, F.coalesce(F.sum(value).over(local), F.lit(0)))
    same = [d[part] == ends["_p"], *(d[c].eqNullSafe(ends[f"_k{i}"]) for i, c in enumerate(by))]
    d = d.join(F.broadcast(ends), same, "left")
    return d.select(*df.columns, (F.col(upto) + F.coalesce(base, F.lit(0))).alias(upto), F.coalesce(whole, total).alias(total))


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, *, how: str = "sum") -> DataFrame:
    """df with name, the sum or (how='max') the greatest of a value over the row and those before it in its group; null keys make a group, null values add nothing. As running_sums it works for groups longer than a range."""
    part, own, base = fresh(df.withColumn(name, F.lit(0)), "_part", "_own", "_base")
    fold = F.sum if how == "sum" else F.max
    cut = materialize(df.withColumn(own, value).repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))  # the ranges must stay as they are
    group = Window.partitionBy(*by)
    ends = cut.groupBy(part, *by).agg(fold(own).alias("_s")).withColumn("_n", F.count("*").over(group)).where("_n > 1")  # at most two rows a range
    before = fold("_s").over(group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(part).alias("_p"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), before.alias(base))
    local = fold(own).over(Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = cut.withColumn(name, local)
    d = d.join(F.broadcast(ends), [d[part] == ends["_p"], *(d[c].eqNullSafe(ends[f"_k{i}"]) for i, c in enumerate(by))], "left")
    both = F.coalesce(name, F.lit(0)) + F.coalesce(base, F.lit(0)) if how == "sum" else F.greatest(name, base)
    return d.select(*df.columns, both.alias(name))


def zip_rows(left: DataFrame, right: DataFrame, order_left: list[Column], order_right: list[Column]) -> DataFrame:
    """The rows of both tables side by side by their position; rows beyond the shorter table are left out. Column names must differ."""
    a, b = numbered(left, order_left, "_at"), numbered(right, order_right, "_at")
    return a.join(b, "_at").drop("_at")


def nearest_keys(index: DataFrame, needles: DataFrame, *, forward: bool = False) -> DataFrame:
    """For each distinct needle the value of the greatest key strictly before it, or with forward of the least key strictly after it.

    index: key (unique), value; needles: key. Returns key, value; value is null where no such key exists, null keys are left out.
    """
    both = index.where("key IS NOT NULL").select("key", F.struct("value").alias("v")).unionByName(needles.where("key IS NOT NULL").select("key").distinct().withColumn("v", F.lit(None)), allowMissingColumns=True)
    cut = materialize(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()))
    pick = F.min_by if forward else F.max_by
    edges = cut.where("v IS NOT NULL").groupBy("_part").agg(pick("v", "key").alias("edge"))
    edges = cut.select("_part").distinct().join(edges, "_part", "left")
    # the needle comes first among equal keys in the direction of the scan, so it meets none of its own key
    side = F.col("v").isNotNull()
    order = [F.desc("key"), side] if forward else [F.asc("key"), side]
    parts = Window.orderBy(F.desc("_part") if forward else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    edges = edges.select("_part", F.last("edge", ignorenulls=True).over(parts).alias("edge"))
    local = F.last("v", ignorenulls=True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("_local", local).where("v IS NULL").join(F.broadcast(edges), "_part").select("key", F.coalesce("_local", "edge")["value"].alias("value"))


def shard_intervals(index: DataFrame, needles: DataFrame) -> DataFrame:
    """For each needle the shards of a sorted index that may hold it or what begins with it: key, first_shard, last_shard.

    index: key (unique), shard BIGINT; needles: key, non-empty. The first shard is that of the greatest key strictly before the needle with its last
    character lowered by one code point, 0 if there is none; the last that of the least key strictly after the needle with it raised by one, the greatest shard if there is
    none. Any character may be the last: at U+0001 and at the surrogates the step goes to the next code point there is, U+10FFFF is raised by a longer key.

    One range partition of the index with both bounds of each needle answers both.
    """
    n = needles.where("length(key) > 0").select("key").distinct()
    head, last = F.expr("left(key, length(key) - 1)"), F.conv(F.hex(F.encode(F.expr("right(key, 1)"), "UTF-32")), 16, 10).cast("bigint")
    sign = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    lower = F.when(last == 0xE000, F.lit(0xD7FF).cast("bigint")).otherwise(last - 1)
    upper = F.when(last == 0xD7FF, F.lit(0xE000).cast("bigint")).otherwise(last + 1)
    low = F.when(last > 1, F.concat(head, sign(lower))).otherwise(head)
    high = F.when(last < 0x10FFFF, F.concat(head, sign(upper))).otherwise(F.concat("key", F.lit("\U0010ffff")))
    ends = F.explode(F.array(*(F.struct(at.alias("at"), F.lit(up).alias("up")) for at, up in ((low, False), (high, True)))))
    rows = n.select("key", ends.alias("e")).select(F.col("e.at").alias("at"), F.col("e.up").alias("up"), F.col("key").alias("needle"))
    rows = index.where("key IS NOT NULL").select(F.col("key").alias("at"), "shard").unionByName(rows, allowMissingColumns=True)
    cut = materialize(rows.repartitionByRange("at").withColumn("_part", F.spark_partition_id()))
    # the last key of the ranges before and the first one of those after, a row a range
    edges = cut.groupBy("_part").agg(F.max_by("shard", F.when(F.col("shard").isNotNull(), F.col("at"))).alias("l"), F.min_by("shard", F.when(F.col("shard").isNotNull(), F.col("at"))).alias("f"))
    over = lambda o: Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_part", F.last("l", ignorenulls=True).over(over(F.asc("_part"))).alias("before"), F.last("f", ignorenulls=True).over(over(F.desc("_part"))).alias("after"))
    # a bound comes first among equal keys in the direction of its scan, so it meets none of its own key
    scan = lambda o: F.last("shard", ignorenulls=True).over(Window.partitionBy("_part").orderBy(o, F.col("shard").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = cut.withColumn("down", scan(F.asc("at"))).withColumn("next", scan(F.desc("at"))).where("needle IS NOT NULL").join(F.broadcast(edges), "_part")
    least, most = F.lit(0).cast("bigint"), index.agg(F.max("shard").alias("most")).withColumn("one", F.lit(1))  # one row
    d = found.groupBy(F.col("needle").alias("key")).agg(F.max(F.when(~F.col("up"), F.coalesce("down", "before"))).alias("f"), F.max(F.when(F.col("up"), F.coalesce("next", "after"))).alias("l"))
    d = d.withColumn("one", F.lit(1)).join(F.broadcast(most), "one")
    return d.select("key", F.coalesce("f", least).alias("first_shard"), F.coalesce("l", "most").alias("last_shard"))


def trimmed_counts(df: DataFrame, by: list[str], value: str, *, least: int = 500, part: int = 50) -> DataFrame:
    """Counts of equal values of each group without its greatest n div part values, where it has more than `least`: by, value, n; nulls are no values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    c = running_sums(c, by, [value], "n", "_upto", "_all")
    kept = F.when(F.col("_all") > least, F.expr(f"_all - _all div {part}")).otherwise(F.col("_all"))
    return c.withColumn("n", F.least("n", kept - (F.col("_upto") - F.col("n")))).where("n > 0").select(*by, value, "n")


def largest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n first rows by the order, which should be total; each task keeps only its own n."""
    return df.orderBy(*order).limit(n)
