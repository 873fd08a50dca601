"""Statistics of classification results and of value distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.distance import QUALITIES
from seqloom.operators.order import numbered, running_sums


def options_quality(options: Column, truth: Column) -> Column:
    """0 NoResult to 6 Exact for ARRAY<STRUCT<name, count, distance_min, ...>>; null elements don't count, a null array is NoResult.

    distance_min may be text; what is no whole number is farther than any.
    """
    o = F.filter(options, lambda x: x.isNotNull())
    far = F.lit(2**62)
    least = lambda x: F.coalesce(x["distance_min"].try_cast("bigint"), far)
    votes = lambda x: F.coalesce(x["count"], F.lit(0))
    own = F.get(F.filter(o, lambda x: F.coalesce(x["name"] == truth, F.lit(False))), F.lit(0))
    rest = F.filter(o, lambda x: ~F.coalesce(x["name"] == truth, F.lit(False)))
    total = F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a + votes(x))
    return (
        F.when(F.coalesce(F.size(o), F.lit(0)) <= 0, 0)
        .when(own.isNull(), 1)
        .when(F.size(o) == 1, 6)
        .when(votes(own) * 2 > total, 5)
        .when(~F.exists(rest, lambda x: votes(x) >= votes(own)), 4)
        .when(~F.exists(rest, lambda x: (votes(x) > votes(own)) | ((votes(x) == votes(own)) & (least(x) <= least(own)))), 3)
        .otherwise(2)
    )


def quality_name(quality: Column) -> Column:
    return F.get(F.array(*map(F.lit, QUALITIES)), quality)


def quality_cube(results: DataFrame) -> DataFrame:
    """Counts at three levels: per k and true domain, per k and mapped domain, per k.

    results: k, true_domain, mapped_domain, quality, reason. Returns level, k, domain, quality, has_reason, n.
    """
    r = results.withColumn("has_reason", F.col("reason").isNotNull())
    sets = [["k", "quality", "has_reason", "true_domain"], ["k", "quality", "has_reason", "mapped_domain"], ["k", "quality", "has_reason"]]
    g = r.groupingSets([[F.col(c) for c in s] for s in sets], "k", "quality", "has_reason", "true_domain", "mapped_domain").agg(F.count("*").alias("n"), F.grouping("true_domain").alias("gt"), F.grouping("mapped_domain").alias("gm"))
    level = F.when(F.col("gt") == 0, "true").when(F.col("gm") == 0, "mapped").otherwise("all")
    return g.select(level.alias("level"), "k", F.when(F.col("gt") == 0, F.col("true_domain")).when(F.col("gm") == 0, F.col("mapped_domain")).alias("domain"), "quality", "has_reason", "n")


def quality_table(results: DataFrame) -> DataFrame:
    """One row a (k, true_domain) with a column for each quality, one more for those with a reason, and the number of reasons."""
    names = [f"{q}{w}" for q in QUALITIES for w in ("", "_w_reason")]
    r = results.withColumn("c", F.concat(quality_name(F.col("quality")), F.when(F.col("reason").isNotNull(), "_w_reason").otherwise("")))
    p = r.groupBy("k", "true_domain").pivot("c", names).count().na.fill(0, names)
    return p.withColumn("reasons", sum((F.col(n) for n in names if n.endswith("_w_reason")), F.lit(0)))


def at_least(results: DataFrame) -> DataFrame:
    """For each k and quality, how many domains have at least n results of that quality or better: k, quality, n, domains."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(len(QUALITIES) - 1)))
    per = results.where("true_domain IS NOT NULL").groupBy("k", "true_domain").agg(*(F.count_if(F.col("quality") >= q).alias(f"q{q}") for q in range(len(QUALITIES))), F.count("*").alias("most"))
    long = per.withColumn("quality", levels).select("k", "quality", F.get(F.array(*(F.col(f"q{q}") for q in range(len(QUALITIES)))), F.col("quality")).alias("n"))
    return reverse_cumulative(long.groupBy("k", "quality", "n").agg(F.count("*").alias("c")), ["k", "quality"], "n", "c").withColumnRenamed("total", "domains").drop("c")


def reverse_cumulative(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with total, the sum of value over the row and all later ones of its group. A group has one row a distinct order."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn("total", F.sum(value).over(w))


def cumulative_share(counts: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df with running, the sum up to each row, and share, its part of the group's sum; a group may have any number of rows."""
    d = running_sums(counts, by, [order], value, "running", "_total")
    return d.withColumn("share", F.round(F.col("running") / F.col("_total"), 9)).drop("_total")


def seats(counts: DataFrame, by: list[str], party: str, votes: str, n: int) -> DataFrame:
    """Seats of each party by the highest quotients votes / (2 i + 1); ties go to the lesser party name. Parties without a seat are left out."""
    q = counts.where(F.col(votes) > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("quotient", F.col(votes) / (2 * F.col("i") + 1))
    w = Window.partitionBy(*by).orderBy(F.desc("quotient"), party, "i")
    return q.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).groupBy(*by, party).agg(F.count("*").alias("seats"))


def entropy(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """The entropy in bits of the counts of each group."""
    whole = Window.partitionBy(*by)
    p = counts.withColumn("p", F.col(value) / F.sum(value).over(whole))
    return p.groupBy(*by).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, least, most, mean, population variance, sample deviation, skewness and excess kurtosis, and interpolated points at 5, 20, 50, 80 and 95 % of each group."""
    v = F.col(value)
    r = lambda c: F.round(c, 6)
    m = df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), r(F.avg(v)).alias("mean"), r(F.var_pop(v)).alias("variance"), r(F.stddev_samp(v)).alias("deviation"), r(F.skewness(v)).alias("skewness"), r(F.kurtosis(v)).alias("kurtosis"))
    p = exact_percentiles(df, by, value, {"p05": 0.05, "p20": 0.2, "median": 0.5, "p80": 0.8, "p95": 0.95}).toDF(*(f"_k{i}" for i in range(len(by))), "p05", "p20", "median", "p80", "p95")
    same = [m[c].eqNullSafe(p[f"_k{i}"]) for i, c in enumerate(by)]
    return m.join(p, same, "left").select(*m.columns, *(r(F.col(c)).alias(c) for c in ("p05", "p20", "median", "p80", "p95")))


def median_of_groups(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Over the groups within each key: their number, the median of their means, and their sample deviation."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(F.avg(value).alias("_mean"))
    m = g.groupBy(*by).agg(F.count("*").alias("groups"), F.round(F.stddev_samp("_mean"), 6).alias("deviation"))
    p = exact_percentiles(g, by, "_mean", {"median": 0.5})
    return m.join(p, by).withColumn("median", F.round("median", 6))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each (truth, predicted) and their percentage of the truth's rows."""
    c = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return c.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(truth)), 6))


def rank_points(df: DataFrame, by: list[str], value: str, percents: Sequence[int]) -> DataFrame:
    """The value at each percent of the sorted values of a group (position n * percent // 100, the last at most), from counts of equal values."""
    c = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    c = running_sums(c, by, [value], "c", "upto", "n")
    c = c.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("at", F.least(F.expr("n * percent div 100"), F.col("n") - 1))
    return c.where("at < upto AND at >= upto - c").select(*by, "percent", value)


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and one DOUBLE column for each name in shares: the value at that share of the sorted values of a group, interpolated between the two nearest; nulls are no values.

    From counts of equal values and their running sums over ranges, so no group's values are gathered in one task.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    c = running_sums(c, by, ["_v"], "_c", "_upto", "_n")
    place = lambda q: F.lit(q) * (F.col("_n") - 1)
    at = lambda p: F.max(F.when((p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_c")), F.col("_v")))
    both = [x for i, q in enumerate(shares.values()) for x in (at(F.floor(place(q))).alias(f"_a{i}"), at(F.ceil(place(q))).alias(f"_b{i}"))]
    g = c.groupBy(*by).agg(F.max("_n").alias("_n"), *both)
    between = lambda i, q: F.col(f"_a{i}") + (place(q) - F.floor(place(q))) * (F.col(f"_b{i}") - F.col(f"_a{i}"))
    return g.select(*by, *(between(i, q).alias(n) for i, (n, q) in enumerate(shares.items())))


# The readable names of qualities, and those that count as good.
READABLE = {"Exact": "Unanimous", "PluralityThenMinDist": "Pseudo-Plurality"}
GOOD_FROM = "PluralityThenMinDist"


def readable_quality(name: Column) -> Column:
    """Names as reports print them; others stay."""
    out = name
    for old, new in READABLE.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def is_good(quality: Column) -> Column:
    """Whether the right label was found."""
    return quality >= QUALITIES.index(GOOD_FROM)


def merge_counts(tables: Sequence[DataFrame], key: list[str], count: str) -> DataFrame:
    """The counts of all tables added up by key; null keys are one."""
    out = tables[0].select(*key, count)
    for t in tables[1:]:
        out = out.unionByName(t.select(*key, count))
    return out.groupBy(*key).agg(F.sum(count).alias(count))


def is_subset(part: Column, whole: Column) -> Column:
    """Whether every element of the first array is in the second; null if either is null."""
    return F.size(F.array_except(part, whole)) == 0


def indexed_labels(pairs: DataFrame, truth: str, predicted: str, *, same: dict[str, str] | None = None) -> DataFrame:
    """pairs with <truth>_no and <predicted>_no, the labels' places in the order of all labels of both columns, and the labels themselves replaced by what `same` says
    they are the same as. Null labels have none. Labels are numbered over a global order, not by one task."""
    changes = same or {}
    known = F.create_map(*(F.lit(x) for kv in changes.items() for x in kv)) if changes else None
    one = lambda c: F.coalesce(known[F.col(c)], F.col(c)) if known is not None else F.col(c)
    d = pairs.withColumns({truth: one(truth), predicted: one(predicted)})
    labels = d.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("_label")).where("_label IS NOT NULL").distinct()
    n = numbered(labels, [F.col("_label")], "_no")
    for c in (truth, predicted):
        d = d.join(n.select(F.col("_label").alias(c), F.col("_no").alias(f"{c}_no")), c, "left")
    return d.select(*pairs.columns, f"{truth}_no", f"{predicted}_no")


def corrected(features: DataFrame, offsets: dict[str, int], lengths: str | None = None, ones: int = 0) -> DataFrame:
    """features with fixed amounts taken off some columns, as what marker messages add to a capture, and an array of run lengths without its first `ones` elements equal to 1."""
    d = features.withColumns({c: F.col(c) - n for c, n in offsets.items()})
    if lengths is None:
        return d
    upto = lambda i: F.size(F.filter(F.slice(lengths, 1, i + 1), lambda x: x == 1))
    return d.withColumn(lengths, F.filter(lengths, lambda x, i: (x != 1) | (upto(i) > ones)))
