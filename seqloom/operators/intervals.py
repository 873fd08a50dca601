"""Continuous periods and gaps of time intervals that overlap, nest or leave pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, *, shards: int | None = None) -> DataFrame:
    """Merge the intervals [start, end] of each entity into continuous periods and list the gaps between them.

    df: start and end are BIGINT columns, keys name the entity. Intervals that overlap or touch make one
    period, also intervals of length 0. Rows with a null key, start or end, or with end < start are no
    intervals. Repeated rows change nothing; other columns are ignored, whatever they are called.
    Returns keys, kind ('period' or 'gap'), from_us, to_us; an empty input gives no rows.

    Two levels, for entities of every size: the rows are cut into ranges of (entity, start), the time shards. An interval is clipped where its shard ends; what
    hangs over is one number a shard, how far any of its intervals reaches, and a prefix maximum of these over the shards of an entity tells each shard up to where
    it is covered from before. Each shard is merged on its own. Then the pieces that touch its borders are stitched, at most two
    a shard. An entity has no more rows in one task than a range holds; only entities that cross a border, at most one for each, have anything to stitch.
    shards: the number of ranges, by default that of shuffle partitions.
    """
    k = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keys, k)), F.col(f"`{start}`").alias("a"), F.col(f"`{end}`").alias("b"))
    rows = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in k) + " AND a IS NOT NULL AND b >= a")
    # equal starts collapse before anything else moves: repeated rows and hot instants can't pile up
    rows = rows.groupBy(*k, "a").agg(F.max("b").alias("b"))
    ranged = rows.repartitionByRange(shards, *k, "a") if shards else rows.repartitionByRange(*k, "a")
    cut = materialize(ranged.withColumn("shard", F.spark_partition_id()))  # the ranges must stay as they are

    # how far the intervals of the shards before reach: entities with more than one shard, so at most two rows a shard
    entity = Window.partitionBy(*k)
    reach = cut.groupBy(*k, "shard").agg(F.max("b").alias("top")).withColumn("n", F.count("*").over(entity)).where("n > 1")
    reach = reach.select(*k, "shard", F.max("top").over(entity.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)).alias("covered"), F.lit(True).alias("crosses"))

    # level 1: merge within (entity, shard); run 0 is what goes on from the shards before
    w = Window.partitionBy(*k, "shard").orderBy("a")
    upto = F.greatest("covered", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = cut.join(F.broadcast(reach), [*k, "shard"], "left").withColumn("new", F.when(upto >= F.col("a"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    merged = runs.groupBy(*k, "shard", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("crosses").alias("crosses"))
    merged = merged.withColumn("next_a", F.lead("a").over(Window.partitionBy(*k, "shard").orderBy("run")))
    final = (F.col("run") > 0) & (F.col("crosses").isNull() | F.col("next_a").isNotNull())
    gap = F.when((F.col("run") > 0) & F.col("next_a").isNotNull(), _case("gap", F.col("b"), F.col("next_a")))
    inside = merged.select(*k, F.explode(F.array_compact(F.array(F.when(final, _case("period", F.col("a"), F.col("b"))), gap))).alias("c"))

    # level 2: of each shard the end of run 0, where its first period begins, and its last period, which later shards may go on with
    own = F.col("run") > 0
    edges = merged.where("crosses").groupBy(*k, "shard").agg(F.max(F.when(~own, F.col("b"))).alias("tail"), F.min(F.when(own, F.col("a"))).alias("first_a"), F.max(F.when(own, F.col("a"))).alias("last_a"), F.max(F.when(own, F.col("b"))).alias("last_b"))
    edges = edges.withColumn("at", F.count("first_a").over(entity.orderBy("shard")))
    before = F.struct((F.col("at") - F.col("first_a").isNotNull().cast("int")).alias("at"), F.lit(None).cast("bigint").alias("a"), F.col("tail").alias("b"), F.col("first_a").alias("then"))
    last = F.struct("at", F.col("last_a").alias("a"), F.col("last_b").alias("b"), F.lit(None).cast("bigint").alias("then"))
    open_ = edges.select(*k, F.explode(F.array(before, last)).alias("e")).select(*k, "e.*").where("at > 0")
    open_ = open_.groupBy(*k, "at").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max("then").alias("then"))
    stitched = F.array_compact(F.array(_case("period", F.col("a"), F.col("b")), F.when(F.col("then").isNotNull(), _case("gap", F.col("b"), F.col("then")))))
    out = inside.unionByName(open_.select(*k, F.explode(stitched).alias("c")))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keys, k)), "c.*")


def _case(kind: str, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), a.alias("from_us"), b.alias("to_us"))
