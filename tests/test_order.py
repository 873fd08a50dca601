import pytest
import random

from pyspark.sql import functions as F

from seqloom.functions import names as N
from seqloom.operators import order as O
from seqloom.operators import queue as Q
from seqloom.operators import stats as S


def test_numbered(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v int, _part int").repartition(7)
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r["_part"]: r["number"] for r in O.numbered(df, [F.col("v"), F.col("_part")]).collect()} == want
    groups: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r[2])
    got = O.group_numbers(df, ["k"], [F.col("v"), F.col("_part")])
    assert got.columns == ["k", "v", "_part", "number"]
    assert {r["_part"]: r["number"] for r in got.collect()} == {x: i for g in groups.values() for i, x in enumerate(g)}
    assert O.numbered(df.limit(0), [F.col("v")]).collect() == []


def test_with_next(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.choice(["x", "y", None])) for i in range(300)] + [("alone", 1000, "z")]
    df = spark.createDataFrame(rows, "k string, i int, _part string").repartition(6)
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    want = {(*r, *(after[1:] if after else (None, None))) for g in groups.values() for r, after in zip(g, [*g[1:], None])}
    got = O.with_next(df, ["k"], [F.col("i")], {"i": "next_i", "_part": "next_part"})
    assert got.columns == ["k", "i", "_part", "next_i", "next_part"] and {tuple(r) for r in got.collect()} == want
    assert O.with_next(df.limit(0), ["k"], [F.col("i")], {"i": "j"}).collect() == []


def test_zip(spark):
    a, b = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "x int, y string"), spark.createDataFrame([(9,), (7,)], "z int")
    assert sorted(tuple(r) for r in O.zip_rows(a, b, [F.col("x")], [F.col("z")]).collect()) == [(1, "a", 7), (2, "b", 9)]
    assert O.zip_rows(a, b.limit(0), [F.col("x")], [F.col("z")]).count() == 0


def test_nearest_keys(spark):
    rng = random.Random(6)
    keys = sorted({rng.randrange(1000) for _ in range(80)})
    index = spark.createDataFrame([(k, None if i % 9 == 4 else i) for i, k in enumerate(keys)], "key int, value long")
    needles = [rng.randrange(-5, 1010) for _ in range(200)] + [keys[0], keys[-1]]
    df = spark.createDataFrame([(n,) for n in [*needles, None, needles[0]]], "key int")
    value = {k: None if i % 9 == 4 else i for i, k in enumerate(keys)}
    for forward in (False, True):
        got = {r.key: r.value for r in O.nearest_keys(index, df, forward=forward).collect()}
        near = {n: (min((k for k in keys if k > n), default=None) if forward else max((k for k in keys if k < n), default=None)) for n in needles}
        assert got == {n: value.get(k) for n, k in near.items()}
        assert {r.value for r in O.nearest_keys(index.limit(0), df, forward=forward).collect()} == {None}


def test_shards(spark):
    index = spark.createDataFrame([("com,a", 0), ("com,c", 1), ("com,d", 2), ("com,d,x", 3), ("com,f", 4)], "key string, shard long")
    names = spark.createDataFrame([("com,d",), ("com,a",), ("com,z",), ("",), (None,)], "key string")
    # the keys com,c and com,e themselves do not count as before and after com,d
    assert {tuple(r) for r in O.shard_intervals(index, names).collect()} == {("com,d", 0, 4), ("com,a", 0, 1), ("com,z", 4, 4)}


def test_trim_and_largest(spark):
    df = spark.createDataFrame([("x", i // 2) for i in range(600)] + [("y", 1), ("y", None), (None, 4)], "k string, v int")
    got: dict = {}
    for r in O.trimmed_counts(df, ["k"], "v").collect():
        got.setdefault(r.k, {})[r.v] = r.n
    assert sum(got["x"].values()) == 588 and max(got["x"]) == 293 and got["y"] == {1: 1} and got[None] == {4: 1}
    assert [r.v for r in O.largest(df.where("k = 'x'"), [F.desc("v")], 3).collect()] == [299, 299, 298]


def test_names(spark):
    df = spark.createDataFrame([("1.5", "2019-03-04T01:02:03Z"), (" 2 ", "2019-03-04T01:02:03.5+01:00"), ("x", "no"), ("18446744073709551615", None), (None, "")], "a string, b string")
    got = df.select(N.milliseconds_to_us(F.col("a")).alias("a"), F.unix_micros(N.iso_time(F.col("b"))).alias("b")).collect()
    assert [r.a for r in got] == [1500, 2000, None, None, None] and [r.b for r in got] == [1551661323000000, 1551657723500000, None, None, None]
    d = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.uk",), ("nowhere",), (None,), ("",)], "d string")
    known = spark.createDataFrame([("uk",), ("co.uk",), ("co.uk",), (None,)], "suffix string")
    assert {tuple(r) for r in N.public_suffix(d, "d", known).collect()} == {("a.b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.uk", "uk"), ("nowhere", None), ("", None)}
    assert d.where("d = 'a.b.co.uk'").select(N.reversed_labels(F.col("d")).alias("r")).collect()[0].r == ["uk", "co", "b", "a"]


def test_counts_subsets_stale(spark):
    a, b = spark.createDataFrame([("x", 1), (None, 2)], "k string, n long"), spark.createDataFrame([("x", 4), ("y", 1), (None, 1)], "k string, n long")
    assert {tuple(r) for r in S.merge_counts([a, b], ["k"], "n").collect()} == {("x", 5), ("y", 1), (None, 3)}
    s = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["c"], ["a"]), (None, ["a"])], "p array<string>, w array<string>")
    assert [r.x for r in s.select(S.is_subset(F.col("p"), F.col("w")).alias("x")).collect()] == [True, True, False, None]
    q = s.limit(1).select(S.readable_quality(F.lit("Exact")).alias("a"), S.readable_quality(F.lit("Wrong")).alias("b"), S.is_good(F.lit(3)).alias("c"), S.is_good(F.lit(2)).alias("d")).collect()[0]
    assert tuple(q) == ("Unanimous", "Wrong", True, False)
    t = spark.createDataFrame([("a", "2020-01-01 00:00:00"), ("a", "2020-01-01 09:00:00"), ("b", "2020-01-01 07:00:00"), ("c", None)], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert [r.k for r in Q.stale(t, ["k"], "t", F.lit("2020-01-01 10:00:00").cast("timestamp"), "2 HOURS").collect()] == ["b"]


def test_group_distances(spark):
    import numpy as np

    from seqloom.functions import elements as E
    from seqloom.operators.distance import distances, group_distances

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["S01", "S02", "G03", "G09"]) for _ in range(n))
    rows = [(f"r{i}", rng.choice(["a", "b", None]), text(rng.randrange(8))) for i in range(50)] + [("long", "a", text(120)), ("only", "c", "S01"), ("null", "a", None)]
    df = spark.createDataFrame(rows, "row_id string, label string, t string").withColumn("elems", E.parse_codes(F.split("t", " ")))
    q = df.where("row_id IN ('r3', 'r4', 'only', 'null', 'long')").selectExpr("row_id AS query_id", "elems")
    code = {r: np.array([int(x[1:]) if x[0] == "S" else -int(x[1:]) - 1 for x in t.split()], int) for r, _, t in rows if t is not None}
    want = set()
    for i in ("r3", "r4", "only", "long"):
        for label in ("a", "b", "c", None):
            others = [r for r, l, t in rows if l == label and r != i and t is not None]
            if others:
                d = sorted(distances([code[i]] * len(others), [code[r] for r in others]).tolist())
                want.add((i, label, len(d), sum(d) // len(d), d[len(d) // 2]))
    assert {tuple(r) for r in group_distances(q, df, blocks=3).collect()} == want
    assert group_distances(q.limit(0), df).collect() == []


def test_group_distances_of_whole_and_split_labels(spark):
    from seqloom.functions import elements as E
    from seqloom.operators.distance import group_distances

    rng = random.Random(9)
    rows = [(f"r{i}", rng.choice(["a", "a", "a", "b", None]), " ".join(rng.choice(["S01", "S02", "G03"]) for _ in range(rng.randrange(6)))) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id string, label string, t string").withColumn("elems", E.parse_codes(F.split("t", " ")))
    q = df.where("row_id < 'r3'").selectExpr("row_id AS query_id", "elems")
    whole, some, none = (group_distances(q, df, blocks=2, most=most) for most in (1000, 30, 1))
    assert sorted(map(str, whole.collect())) == sorted(map(str, some.collect())) == sorted(map(str, none.collect()))
    # where labels lie in one block, the tasks that compare them give the results: nothing is counted or moved afterwards
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")


def test_running_and_neighbours_of_hot_groups(spark):
    """One group longer than all ranges, ties, nulls in keys and values."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), i // 3, i, rng.choice([None, rng.randrange(-5, 9)])) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, i int, v int")
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    sums, most, prior, totals = {}, {}, {}, {}
    for k, rs in by.items():
        for n, r in enumerate(rs):
            seen = [x[3] for x in rs[: n + 1] if x[3] is not None]
            sums[r[2]], most[r[2]], prior[r[2]] = sum(seen), max(seen, default=None), rs[n - 1][2] if n else None
            totals[r[2]] = sum(x[3] for x in rs if x[3] is not None)
    assert {r.i: r.s for r in O.running(df, ["k"], ["o", "i"], F.col("v"), "s").collect()} == sums
    assert {r.i: r.s for r in O.running(df, ["k"], ["o", "i"], F.col("v"), "s", how="max").collect()} == most
    assert {r.i: r.p for r in O.with_prior(df, ["k"], [F.col("o"), F.col("i")], {"i": "p"}).collect()} == prior
    assert {r.i: (r.upto, r.total) for r in O.running_sums(df, ["k"], ["o", "i"], "v").collect()} == {i: (sums[i], totals[i]) for i in sums}
    got = {r.k: (r.low, r.mid, r.high) for r in S.exact_percentiles(df, ["k"], "v", {"low": 0.0, "mid": 0.4, "high": 1.0}).collect()}
    for k, rs in by.items():
        v = sorted(r[3] for r in rs if r[3] is not None)
        at = 0.4 * (len(v) - 1)
        assert got[k] == (v[0], pytest.approx(v[int(at)] + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - v[int(at)])), v[-1])
    for f in (lambda d: O.running(d, ["k"], ["o"], F.col("v"), "s"), lambda d: O.with_prior(d, ["k"], [F.col("o")], {"i": "p"}), lambda d: S.exact_percentiles(d, ["k"], "v", {"x": 0.5})):
        assert f(df.limit(0)).collect() == []


def test_bounds_with_any_last_character(spark):
    index = spark.createDataFrame([(k, i) for i, k in enumerate(["a", "a_", "aé", "b", "z\ue000"])], "key string, shard bigint")
    needles = ["a_", "aé", "b", "a\U0001f600", "z\ue000", "z\ud7ff", "a\x01", "\U0010ffff", ""]
    got = {r.key: (r.first_shard, r.last_shard) for r in O.shard_intervals(index, spark.createDataFrame([(k,) for k in needles], "key string")).collect()}
    keys = ["a", "a_", "aé", "b", "z\ue000"]
    for n in needles[:-1]:
        c = ord(n[-1])
        low = n[:-1] + (chr(0xD7FF if c == 0xE000 else c - 1) if c > 1 else "")
        high = n[:-1] + chr(0xE000 if c == 0xD7FF else c + 1) if c < 0x10FFFF else n + "\U0010ffff"
        assert got[n] == (max([i for i, k in enumerate(keys) if k < low], default=0), min([i for i, k in enumerate(keys) if k > high], default=4)), n
    assert "" not in got
