import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.intervals import periods_and_gaps

SCHEMA = "e string, s string, a bigint, b bigint, K0 string, shard string, run string"


def brute(rows):
    by = {}
    for e, s, a, b, *_ in rows:
        if None not in (e, s, a, b) and b >= a:
            by.setdefault((e, s), []).append((a, b))
    out = set()
    for (e, s), iv in by.items():
        merged = []
        for a, b in sorted(iv):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out |= {(e, s, "period", a, b) for a, b in merged}
        out |= {(e, s, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("shards", [1, 7, 60])
@pytest.mark.parametrize("span,longest", [(60, 4), (400, 9), (300, 200), (5000, 3)])
def test_random(spark, shards, span, longest):
    rng = random.Random(span * 31 + longest)
    rows = []
    for _ in range(300):
        e = rng.choice(["hot"] * 6 + ["x", "y", None])
        a = rng.randrange(span)
        b = rng.choice([a, a + rng.randrange(longest), a + rng.randrange(longest), a - 1, None])
        rows.append((e, rng.choice(["C", "F", None]) if e != "hot" else "C", a if rng.random() > 0.03 else None, b, "k", "s", "r"))
    rows += rows[:40]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["e", "s"], "a", "b", shards=shards).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_touching_at_edges_and_empty(spark):
    rows = [("e", "s", i, i + 1, "", "", "") for i in range(50)] + [("e", "s", i, i, "", "", "") for i in range(60, 70)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in periods_and_gaps(df, ["e", "s"], "a", "b", shards=12).collect()} == brute(rows)
    assert periods_and_gaps(df.limit(0), ["e", "s"], "a", "b").collect() == []


def test_one_entity_over_all_shards(spark):
    """Intervals longer than several shards, shards without a period of their own, and the plan that stitches at every size."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        a = rng.randrange(20_000)
        rows.append(("e", "s", a, a + rng.choice([0, 1, 5, 5, 5, 900]), "", "", ""))
    rows += [("e", "s", 3000, 9000, "", "", ""), ("e", "s", 3001, 3002, "", "", ""), ("f", "s", 1, 30_000, "", "", ""), ("f", "s", 2, 2, "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shards in (2, 40):
        out = periods_and_gaps(df, ["e", "s"], "a", "b", shards=shards)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    cut = df.where("b >= a").groupBy("e", "s", "a").count().repartitionByRange(40, "e", "s", "a").groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in cut) < 3 * len(rows) / 40
