"""Edge cases of core operators: nulls, ties, repeated rows, empty tables, other columns, and brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import elements as E
from seqloom.functions import names as N
from seqloom.operators import graph as G
from seqloom.operators import queue as Q
from seqloom.operators import stats as S
from seqloom.operators import timeline as T
from seqloom.operators.sequences import build_sequences


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_elements(spark):
    pad = lambda n: one(spark, E.block_padding(F.lit(n), 128))
    assert [pad(n) for n in (0, 1, 127, 128, 129)] == [0, 128, 128, 128, 256]
    texts = ["G1", "G13", "G12345", "G65535", "S1", "S10", "S255", "S256", "G65536", "X1", "S", "", None, " s007 "]
    df = spark.createDataFrame([(texts,), ([],), (None,)], "c array<string>").select(E.parse_codes(F.array_compact("c")).alias("e"))
    rows = df.select(E.codes(F.col("e")).alias("c"), E.length(F.col("e")).alias("n"), E.complexity(F.col("e")).alias("x"), E.message_count(F.col("e")).alias("m"), E.reason(F.col("e")).alias("r")).collect()
    assert rows[0].c == ["G01", "G13", "G12345", "G65535", "S01", "S10", "S255", "S07"] and tuple(rows[0][1:]) == (8, 273, 4, None)
    assert tuple(rows[1]) == ([], 0, 0, 0, None) and rows[2].c is None and rows[2].n is None and rows[2].m is None
    reason = lambda t: one(spark, E.reason(E.parse_codes(F.array(*map(F.lit, t.split())))))
    assert reason("S01") == "R004 Single packet of size 1." and reason("S09").endswith("unknown size.") and reason("S01 G03 S02").startswith("R102A") and reason("G01") is None


def test_build(spark):
    # gaps only beyond twice the base, ties by number, sizes of 0 and nulls left out
    rows = [("a", 0, 10, 1), ("a", 1000, 469, 2), ("a", 3001, 1, 3), ("a", 3001, 936, 4), ("a", 7002, 0, 5), ("a", None, 5, 6), (None, 1, 5, 7), ("one", 5, 5, 8)]
    df = spark.createDataFrame(rows, "k string, t bigint, s int, o int")
    got = lambda **o: {r.k: " ".join(r.c) for r in build_sequences(df, "k", "t", "s", "o", **o).select("k", E.codes(F.col("elems")).alias("c")).collect()}
    assert got() == {"a": "S01 S02 G01 S01 S02", "one": "S01"}
    assert got(mode="ident") == {"a": "S01 S02 G02 S01 S02", "one": "S01"}
    assert got(simulate="perfect_padding") == {"a": "G00 G01 G00"}
    assert got(simulate="perfect_timing") == {"a": "S01 S02 S01 S02", "one": "S01"}
    assert build_sequences(df.limit(0), "k", "t", "s", "o").collect() == []


def test_timeline(spark):
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate((0, 3, 50, 51))], "k string, t bigint, i int")
    assert [r.sent for r in T.throttle(df, ["k"], "t", "i", 10).orderBy("i").collect()] == [0, 10, 50, 60]
    marks = spark.createDataFrame([("k", i, m) for i, m in enumerate(["x", "s", "a", None, "s", "b", "e", "c", "s", "d"])], "k string, i int, m string")
    assert [r.i for r in T.between_markers(marks, ["k"], ["i"], F.col("m") == "s", F.col("m") == "e").orderBy("i").collect()] == [2, 3, 4, 5]
    q = spark.createDataFrame([("k", 1, 1), ("k", 2, 2), ("k", 9, 3), (None, 1, 4)], "k string, t bigint, id bigint")
    r = spark.createDataFrame([("k", 2, 11), ("k", 3, 12), ("z", 1, 13), ("k", None, 14)], "k string, t bigint, id bigint")
    assert [tuple(x) for x in T.match_responses(q, r, ["k"]).collect()] == [("k", 2, 11, 2, 2)]
    hist = spark.createDataFrame([("k", v, c) for v, c in enumerate([1, 2, 9, 2, 1, 1])], "k string, v int, c int")
    assert [x.v for x in T.peaks(hist, ["k"], "v", "c", 2).collect()] == [2]
    assert [one(spark, T.root2_bucket(F.lit(v).cast("bigint"))) for v in (-1, 0, 1, 2, 3, 4, 6, 8)] == [0, 0, 0, 2, 3, 4, 5, 6]


def test_stats(spark):
    c = spark.createDataFrame([("g", i, v) for i, v in enumerate([0, 1, 0] + [1] * 2)], "g string, o int, v int")
    assert [r.total for r in S.reverse_cumulative(c, ["g"], "o", "v").orderBy("o").collect()] == [3, 3, 2, 2, 1]
    v = spark.createDataFrame([("g", "a", 53), ("g", "b", 24), ("g", "c", 23), ("g", "z", 0)], "g string, p string, v int")
    assert {r.p: r.seats for r in S.seats(v, ["g"], "p", "v", 7).collect()} == {"a": 3, "b": 2, "c": 2}
    r = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("g", None)], "g string, v double")
    assert [(x.percent, x.v) for x in S.rank_points(r, ["g"], "v", [0, 50, 100]).orderBy("percent").collect()] == [(0, 0.0), (50, 5.0), (100, 9.0)]


def test_graph(spark):
    rng = random.Random(5)
    edges = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(24))}
    reach = set(edges)
    while new := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= new
    df = spark.createDataFrame([(str(a), str(b), "x") for a, b in edges] * 2 + [(None, "1", "x")], "src string, dst string, via string")
    assert {(int(r.src), int(r.dst)) for r in G.closure(df).collect()} == reach
    assert G.closure(df.limit(0)).collect() == []
    chain = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(14)], "src string, dst string")
    assert G.closure(chain).count() == G.closure(chain, most=105).count() == 14 * 15 // 2
    with pytest.raises(ValueError, match="more than 50"):
        G.closure(chain, most=50)
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert {tuple(r) for r in G.reduction(dag, G.closure(dag)).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    nodes = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "e"), ("p", "q"), ("r", "q")], "node string, domain string")
    e = spark.createDataFrame([("p", "a"), ("r", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    assert {r.node: r.merged for r in G.merge_equal(nodes, e).collect()} == {"a": "a", "b": "a", "c": "c", "p": "p", "r": "p"}


def test_queue_and_names(spark):
    g = spark.createDataFrame([(i, i % 4) for i in range(40)], "g int, size int")
    got = [tuple(r) for r in Q.expand(g, ["g"], "size").orderBy("priority").select("g", "member", "priority").collect()]
    want = [(i, m) for i in range(40) for m in range(i % 4)]
    assert got == [(*x, p) for p, x in enumerate(want)]
    surt = lambda d: one(spark, N.surt(F.lit(d)))
    assert surt("google.com") == "com,google" and surt("1.2.3.4") == "4,3,2,1"
    assert one(spark, N.suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"] and one(spark, N.tld(F.lit("x.org"))) == "org."
    assert [one(spark, N.human_time(F.lit(v).cast("bigint"))) for v in (7, 7_000, 7_000_000, 7_000_000_000, 7_200_000_000_000)] == ["7ns", "7us", "7ms", "7s", "2h"]
    assert [one(spark, N.seconds_to_us(F.lit(v))) for v in ("1.5", "-1", "x")] == [1_500_000, None, None]


def test_resolve_labels(spark):
    links = {f"c{i:02d}": f"c{i + 1:02d}" for i in range(50)} | {"x": "y", "y": "x", "s": "s", "to s": "s"}  # a chain of 50, loops
    links |= {f"t{i}": f"t{i + 1}" for i in range(12)} | {f"l{i}": f"l{(i + 1) % 7}" for i in range(7)} | {"t12": "l3", "u0": "u1", "u1": "l5"}  # tails into a loop
    links |= {f"hub{i}": "c10" for i in range(40)}
    m = spark.createDataFrame([*links.items(), (None, "x"), ("n", None)], "domain string, target string")
    names = [*links, "c50", "n", "other"]

    def follow(n):
        path = [n]
        while path[-1] in links and links[path[-1]] not in path:
            path.append(links[path[-1]])
        end = links.get(path[-1], path[-1])
        return end, path.index(end)

    df = spark.createDataFrame([(n, "clash") for n in [*names, *names[:5], None]], "name string, at string")
    got = [(r.name, (r.resolved, r.hops)) for r in G.resolve_labels(df, m).collect()]
    assert len(got) == len(names) and dict(got) == {n: follow(n) for n in names}
    assert dict(got)["c00"] == ("c50", 50) and dict(got)["t0"] == ("l3", 13) and dict(got)["l4"] == ("l4", 0)
    assert G.resolve_labels(df.limit(0), m).collect() == [] and G.resolve_labels(names=df.limit(3), mapping=m.limit(0)).count() == 3
