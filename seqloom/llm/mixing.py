"""Mixing sources to target shares of the total size, repeating small sources a capped number of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import drop_table, materialize

#: A mixture has no more sources than this; the plan, a row a source, is broadcast.
MOST_SOURCES = 100_000
#: Rows of a range, of which each source sorts one.
BUCKET_ROWS = 50_000


def allocate(sizes: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """The size that each source gives: its share of the total, capped at its size times its repeats.

    What capped sources leave goes to the others in proportion to their shares, until none is over its cap or all are.
    """
    caps = {s: sizes.get(s, 0) * max(repeats[s], 0) for s in shares}
    given, left, open_ = dict.fromkeys(shares, 0.0), float(total), {s for s in shares if shares[s] > 0 and caps[s] > 0}
    while open_:
        weight = sum(shares[s] for s in open_)
        over = {s for s in open_ if left * shares[s] / weight >= caps[s]}
        if not over:
            return given | {s: left * shares[s] / weight for s in open_}
        given |= {s: float(caps[s]) for s in over}
        left -= sum(caps[s] for s in over)
        open_ -= over
    return given


def exponential_key(item: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1] from a hash of the item: ascending keys are a weighted order without replacement."""
    u = (F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return -F.ln(u) / F.greatest(weight, F.lit(1e-3))


def mix_sources(items: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 1, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Choose copies of items so that each source comes as near to its target share as its repeats allow.

    items: id BIGINT (unique), source STRING, size BIGINT, weight DOUBLE; rows with a null id or source or size take no part, a null weight counts as 1.
    targets: source (unique), target_share, max_repeats; a small table with one row a source. total: the size wanted, by default that of all items of the
    sources in targets. Returns (chosen, report): chosen has id, source, size, n_copies of the items with a copy;
    report has, a source, target_share, max_repeats, available, chosen_size, actual_share (null if nothing is chosen).

    A source first gives as many complete epochs as its budget holds, then a fraction by weighted sampling without replacement: items in the order of
    exponential keys while the prefix sum of their sizes comes nearer to the rest. Spark cuts the items into ranges of (source, key) of about bucket_rows rows, whatever
    the weights; sizes are summed by range with partial aggregation, and only the range in which a source's budget ends is sorted. So a hot source is never one task's work.
    """
    items = items.select("id", "source", F.col("size").cast("long").alias("size"), F.coalesce("weight", F.lit(1.0)).alias("weight")).where("id IS NOT NULL AND source IS NOT NULL AND size IS NOT NULL")
    listed = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"]).limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:  # the driver allots the total to the sources
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [r.source for r in listed]
    spark = items.sparkSession
    items = items.join(F.broadcast(spark.createDataFrame([(s,) for s in names], "source string")), "source")  # a row a source
    key = exponential_key(F.col("id"), F.col("weight"), seed)
    items = materialize(items.withColumn("key", key).select("id", "source", "size", "key"))
    sums = {r.source: r for r in items.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    sizes = {s: sums[s].size for s in sums}
    budget = allocate(sizes, {r.source: r.target_share or 0.0 for r in listed}, {r.source: r.max_repeats or 0 for r in listed}, sum(sizes.values()) if total is None else total)
    plan = []
    for s in names:
        epochs = int(budget[s] // sizes[s]) if sizes.get(s) else 0
        plan.append((s, epochs, budget[s] - epochs * sizes.get(s, 0)))
    plan = F.broadcast(spark.createDataFrame(plan, "source string, epochs int, rest double"))  # a row a source

    n_ranges = max(1, -(-sum(r.n for r in sums.values()) // bucket_rows))
    ranged = materialize(items.repartitionByRange(n_ranges, "source", "key", "id").withColumn("bucket", F.spark_partition_id()))  # the ranges must stay as they are
    drop_table(items)
    placed = ranged.join(plan, "source")
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))  # rows: n / bucket_rows + one a source
    before = before.withColumn("before", F.coalesce(F.sum("in_bucket").over(w), F.lit(0)))
    placed = placed.join(before, ["source", "bucket"])
    inside = "before + in_bucket <= rest"
    ends_here = f"before < rest AND NOT ({inside})"
    w = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where(ends_here).withColumn("prior", F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("prior") + F.col("size") / 2 <= F.col("rest")).cast("int"))
    sure = placed.where(f"NOT ({ends_here})").withColumn("extra", F.expr(inside).cast("int"))
    columns = ["id", "source", "size", (F.col("epochs") + F.col("extra")).alias("n_copies")]
    chosen = materialize(edge.select(*columns).unionByName(sure.select(*columns)).where("n_copies > 0"))
    drop_table(ranged)

    got = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("chosen_size"))
    have = spark.createDataFrame([(s, sizes.get(s, 0)) for s in names], "source string, available long")
    report = targets.where("source IS NOT NULL").dropDuplicates(["source"]).select("source", "target_share", "max_repeats").join(have, "source").join(got, "source", "left").fillna(0, ["chosen_size"])
    report = report.withColumn("actual_share", F.expr("try_divide(chosen_size, sum(chosen_size) OVER ())"))
    return chosen, report.select("source", "target_share", "max_repeats", "available", "chosen_size", "actual_share")
