"""Streams over several micro-batches: order, late rows, repeated rows, and state that ends."""

import random

from pyspark.sql import functions as F

from seqloom.streaming import streams as R

DAY = 86_400_000_000
END = 1000 * DAY


def stream(spark, rows, slices=4):
    """rows: k, side, t in days, id, arrival in days."""
    df = spark.createDataFrame([(k, s, None if t is None else round(t * DAY) * 1000, i, a) for k, s, t, i, a in rows], "k string, side int, t bigint, id bigint, a double")
    df = df.withColumn("at", F.timestamp_micros((F.col("a") * DAY).cast("bigint"))).drop("a")
    return R.arrivals(df, "at", {"k": F.lit("end"), "side": F.lit(2), "t": F.lit(END * 1000), "id": F.lit(-1)}, slices=slices)


def matched(spark, rows, **options):
    return {(r.k, r.query_id, r.response_id, r.took // 1000) for r in R.run_to_end(R.match_stream(stream(spark, rows), ["k"], **options)).collect()}


def test_match(spark):
    rows = [
        ("k", 0, 0.0, 1, 0.0), ("k", 1, 0.5, 2, 7.9),  # comes days behind the watermark
        ("k", 0, 1.0, 3, 1.0), ("k", 1, 9.0, 4, 9.0),  # its query isn't remembered so long
        ("k", 0, 5.0, 5, 5.5), ("k", 1, 5.1, 6, 5.2), ("k", 1, 5.1, 6, 5.6), ("k", 1, 5.2, 7, 5.3),  # before its query, and twice; the second answer has none
        ("j", 0, 8.0, 8, 8.0), ("j", 0, 8.1, 9, 8.2), ("j", 1, 8.2, 10, 8.1), (None, 0, 1.0, 11, 1.0), ("j", 0, None, 12, 2.0),
    ]
    assert matched(spark, rows, late="2 days", memory_us=3 * DAY) == {("k", 5, 6, DAY // 10), ("j", 9, 10, DAY // 10)}


def test_throttle_is_the_same_in_one_and_many_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), 0, t := rng.randrange(1000) / 100, i, t + rng.random()) for i, _ in enumerate(range(200))]
    rows += rows[:20]
    want, last = set(), {}
    for k, _, t, i, _ in sorted(set(rows), key=lambda r: (r[0], int(r[2] * DAY), r[3])):
        last[k] = max(round(t * DAY), last.get(k, -END) + DAY // 20)
        want.add((k, i, last[k]))
    for slices, late in ((1, "20 days"), (5, "4 days")):  # the files of one slice come in any order
        s = stream(spark, rows, slices).withColumn("t", F.expr("t div 1000"))
        got = [(r.k, r.id, r.sent) for r in R.run_to_end(R.throttle_stream(s, "k", DAY // 20, late=late)).where("id >= 0").collect()]
        assert len(got) == 200 and set(got) == want


def test_empty(spark):
    assert matched(spark, [("k", 0, None, 1, 0.0)]) == set()


def test_keys_share_their_state_and_batches_dont_grow_with_files(spark):
    rows = [(f"k{i}", side, 1 + i / 100 + side / 1000, 2 * i + side, 1 + i / 100 + side / 2) for i in range(900) for side in (0, 1)]
    for buckets in (1, 5):
        out = matched(spark, rows, late="1 day", memory_us=2 * DAY, buckets=buckets)
        assert {r[:3] for r in out} == {(f"k{i}", 2 * i, 2 * i + 1) for i in range(900)}
    df = spark.range(0, 400, 1, 8).withColumn("at", F.timestamp_micros(F.col("id") % 50 * DAY))
    batches = R.run_to_end(R.arrivals(df, "at", {"id": F.lit(-1)}, slices=4).withColumn("batch", F.expr("date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss.SSSSSS')")))
    assert batches.count() == 401 and batches.select("batch").distinct().count() <= 5
