import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import elements as E
from seqloom.operators import distance as D
from seqloom.operators.distance import FAR, cross_distances, distances, neighbours, quality, seq_distance, seq_distance_details, signed, trace_all, trace_costs, votes
from seqloom.plans.reports import cost_breakdown
from seqloom.plans.sequences import labelled


def s(text):
    return [int(x[1:]) if x[0] == "S" else -int(x[1:]) - 1 for x in text.split()]


@pytest.mark.parametrize("a,b,d", [
    ("S1 G2 S1 S2 S1", "S2 G2 S1 S2 S1", 6), ("S1 G2 S1 S2 S1", "S1 G3 S1 S2 S1", 3), ("S1 G2 S1 S2 S1", "S1 G2 S2 S1 S1", 3),
    ("S1 G2 S1 S2 S1", "S1 S1 S2 S1", 2), ("S1 G2 S1 S2 S1", "S1 S2 G2 S1 S2 S1", 12), ("", "", 0), ("", "S1 G5", 17), ("S1", "S1", 0),
])
def test_golden(a, b, d):
    assert distances([np.array(s(a), int)], [np.array(s(b), int)]).tolist() == [d]
    assert sum(trace_costs(s(a), s(b)).values()) == d


def test_random_batches_and_symmetry():
    rng = random.Random(1)
    one = lambda: np.array([rng.choice([1, 1, 2, 3, -1, -3, -9]) for _ in range(rng.randrange(12))], int)
    a, b = [one() for _ in range(300)], [one() for _ in range(300)]
    d = distances(a, b)
    assert d.tolist() == distances(b, a).tolist() == [sum(trace_costs(x.tolist(), y.tolist()).values()) for x, y in zip(a, b)]
    assert distances([np.ones(100, int)], [np.ones(50, int)], prefilter=True).tolist() == [FAR]


def cross(a, b, **options):
    out = np.full((len(a), len(b)), -1)
    for members, d in cross_distances(a, b, **options):
        out[members] = d
    return out.tolist()


def test_all_pairs_as_one_by_one():
    rng = random.Random(5)
    one = lambda n: np.array([rng.choice([1, 1, 1, 2, 3, 200, -1, -2, -3, -9]) for _ in range(n)], np.int64)
    some = [one(rng.choice([0, 1, 2, 5, 9, 30, 60, 61])) for _ in range(60)]
    # savings beyond 16 and 32 bits, elements that the other side hasn't, repeated sequences
    some += [np.tile(np.array(x, np.int64), n) for x, n in (([-65536, 4], 40), ([-(1 << 29), 4], 3), ([4, -65536], 41), ([4, -(1 << 29)], 3))] + some[:5] + [np.array([77, -8, 77], np.int64)]
    for prefilter in (False, True):
        assert cross(some, some, prefilter=prefilter) == [distances([x] * len(some), some, prefilter=prefilter).tolist() for x in some]
    many = [np.array([1 + i % 4, -1 - i // 4 % 7, 1 + i // 28], np.int64) for i in range(5000)]  # more than lie side by side
    assert cross(many[:3], many) == [distances([x] * len(many), many).tolist() for x in many[:3]]
    assert cross([], many) == [] and cross(many[:1], []) == [[]]


def test_all_pairs_compute_equal_beginnings_once(monkeypatch):
    lists, _ = D._distinct(likely_sequences(1500, 8))
    tree = D._Tree(lists)
    with monkeypatch.context() as m:
        m.setattr(D, "_FEW", 0)
        assert len(D._Tree(lists).place) < 0.95 * sum(map(len, lists))
    asked = sorted(lists[:12], key=lambda x: x.tolist()) + [np.array(x, np.int64) for x in ([], [7, -1, -70_000], [1, -2, 1, -3, 2, 1], [-(1 << 29), 1], [250, 250])]
    for a in asked:
        assert tree.distances(a).tolist() == distances([a] * len(lists), lists).tolist()
    # trees, and sequences side by side for those of lengths that few have; sums beyond 16 and 32 bits on both sides
    some = lists + [np.tile(np.array(x, np.int64), n) for n in (1, 60) for x in ([-65536, 4], [3, -(1 << 29)], [1, 1])]
    assert cross(some[-4:], some) == [distances([x] * len(some), some).tolist() for x in some[-4:]]


def test_all_pairs_in_several_trees(monkeypatch):
    lists = likely_sequences(900, 9)
    monkeypatch.setattr(D, "_TREE_CELLS", 3000)
    monkeypatch.setattr(D, "_FEW", 20)
    monkeypatch.setattr(D, "_KEPT_BYTES", 50_000)
    assert cross(lists[:8], lists, prefilter=True) == [distances([x] * len(lists), lists, prefilter=True).tolist() for x in lists[:8]]


def test_all_pairs_take_a_fraction_of_the_time():
    rng = random.Random(6)
    one = lambda: np.array([rng.choice([1, 1, 1, 2, 3, -1, -2, -3, -9]) for _ in range(rng.randrange(15, 30))], np.int64)
    a, b = [one() for _ in range(40)], [one() for _ in range(3000)]
    times = []
    for f in (lambda: cross(a, b), lambda: [distances([x] * len(b), b).tolist() for x in a[:4]]):
        began = time.process_time()
        f()
        times.append(time.process_time() - began)
    assert times[0] * 3 < times[1] * len(a) / 4


def test_neighbours_and_quality(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice("abc"), " ".join(rng.choice(["S01", "S02", "G03", "G09"]) for _ in range(rng.randrange(8)))) for i in range(60)]
    df = spark.createDataFrame([*rows, ("null", "a", None)], "row_id string, label string, t string").withColumn("elems", E.parse_codes(F.split("t", " ")))
    queries = df.where("try_cast(substring(row_id, 2) AS int) % 7 = 0").selectExpr("row_id AS query_id", "elems")
    got = neighbours(queries, df, 3, blocks=3)
    codes = {r: np.array(s(t), int) for r, _, t in rows}
    label = {r: l for r, l, _ in rows}
    want = {}
    for q in [r for r, *_ in rows if int(r[1:]) % 7 == 0]:
        d = {r: int(distances([codes[q]], [codes[r]])[0]) for r in codes if r != q}
        norm = lambda r: d[r] / max(len(codes[q]), len(codes[r]), 1)  # noqa: B023, E731
        for rank, r in enumerate(sorted(d, key=lambda r: (d[r], norm(r), label[r], r))[:3], 1):  # noqa: B023
            want[q, rank] = (r, d[r])
    assert {(r.query_id, r.rank): (r.row_id, r.distance) for r in got.collect()} == want
    truth = df.select(F.col("row_id").alias("query_id"), F.col("label").alias("truth")).join(queries.select("query_id"), "query_id")
    found = {(r.query_id, r.k): r.quality for r in quality(votes(got, [1, 3]), truth, [1, 3]).collect()}
    for (q, k), v in found.items():
        named = [label[want[q, i][0]] for i in range(1, k + 1)]
        own = named.count(label[q])
        assert (v == 1) == (own == 0) and (v == 6) == (own == k) and (v != 5 or own * 2 > k)
    assert neighbours(queries, df, 3, threshold=-1.0).collect() == []


def test_columns(spark):
    df = spark.createDataFrame([("S01 G02", "S01"), ("S01", None)], "a string, b string").select(*(E.parse_codes(F.split(c, " ")).alias(c) for c in "ab"))
    got = df.select(seq_distance(F.col("a"), F.col("b")).alias("d"), seq_distance_details(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.d for r in got] == [2, None] and got[0].m == {"insert_gap": 2}


def brute(a, b):
    """Cheapest alignment step by step as the reference's cost tracker goes: cost by change, and counts of gaps."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    kind, ins = lambda x: "size" if x >= 0 else "gap", lambda x: 12 if x >= 0 else -x - 1
    table = {(0, 0): (0, {})}

    def way(i, j, cost, what, gaps=None):
        before, m = table[i, j]
        m = m | ({what: m.get(what, 0) + cost} if cost else {})
        return before + cost, m | ({gaps: m.get(gaps, 0) + 1} if gaps else {})

    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and j:
                table[i, j] = way(i, j - 1, ins(b[j - 1]), f"insert_{kind(b[j - 1])}")
            elif i and not j:
                table[i, j] = way(i - 1, j, ins(a[i - 1]), f"{'delete' if b else 'insert'}_{kind(a[i - 1])}")
            elif i:
                x, y = a[i - 1], b[j - 1]
                change = 0 if x == y else 6 if x >= 0 and y >= 0 else 3 * abs(x - y) if x < 0 and y < 0 else ins(x) + ins(y)
                gaps = "gap({})_to_gap({})".format(*sorted((-x - 1, -y - 1))) if x < 0 and y < 0 and x != y else None
                ways = [way(i - 1, j - 1, change, f"substitute_{kind(x)}_{kind(y)}", gaps), way(i, j - 1, ins(y), f"delete_{kind(y)}"), way(i - 1, j, ins(x), f"insert_{kind(x)}")]
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    ways.insert(0, way(i - 2, j - 2, 0 if x == y else 3, f"swap_{kind(x)}_{kind(y)}"))
                table[i, j] = min(ways, key=lambda w: w[0])
    return table[len(a), len(b)][1]


def random_pairs(n):
    rng = random.Random(3)
    one = lambda: [rng.choice([1, 1, 2, 3, -1, -3, -4, -9]) for _ in range(rng.randrange(14))]
    return [(one(), one()) for _ in range(n)]


def test_trace_all():
    pairs = random_pairs(500)
    got = trace_all(*([np.array(x, int) for x in side] for side in zip(*pairs)))
    assert got == [brute(a, b) for a, b in pairs]
    assert {"swap_gap_size", "swap_size_gap", "swap_size_size", "gap(2)_to_gap(3)"} < set().union(*got)


def test_cost_breakdown_of_all_pairs(spark):
    where = "/root/testdata/sf0.001"
    s = labelled(spark, where).where("true_domain IS NOT NULL").select("true_domain", "seq_id", signed(F.col("elems")).alias("c")).orderBy("true_domain", "seq_id").collect()
    pairs = [(x.c, y.c) for x, y in zip(s, s[1:]) if x.true_domain == y.true_domain and x.c + y.c]
    shares = {}
    for a, b in pairs:
        for what, cost in brute(a, b).items():
            shares.setdefault(what, []).append(cost / max(len(a), len(b)))
    assert any("_to_gap" in w for w in shares)
    got = {r.change: (r.n, r.pairs, r.mean, r.most) for r in cost_breakdown(spark, where).collect()}
    assert len(pairs) > 10 and got == {w: (len(v), len(pairs), pytest.approx(sum(v) / len(pairs), abs=1e-8), pytest.approx(max(v), abs=1e-8)) for w, v in shares.items()}


def likely_sequences(n, seed=5):
    """Sequences in families of near ones, with equal ones and some of very different lengths among them."""
    rng = random.Random(seed)
    heads = [[rng.choice([1, 1, 1, 2, 3, 140, -2, -3, -4, -18, -40]) for _ in range(rng.choice([0, 1, 3, 12, 20, 33, 90]))] for _ in range(n // 12)]
    out = []
    for _ in range(n):
        x = list(rng.choice(heads))
        for _ in range(rng.randrange(4)):
            if x:
                x[rng.randrange(len(x))] = rng.choice([1, 2, 5, -2, -9])
        out.append(np.array(x, np.int64))
    return out


def test_nearest_leaves_out_by_bounds(monkeypatch):
    lists = likely_sequences(1200)
    asked, computed = lists[:60] + [np.array([7, -1, -70_000]), np.array([], np.int64)], []
    real = D._Lanes.distances
    monkeypatch.setattr(D._Lanes, "distances", lambda self, a: computed.append(self.shape[2]) or real(self, a))
    corpus = D.Corpus(lists)
    for k, threshold, fit in ((1, None, None), (7, None, None), (7, 0.5, None), (3, None, np.arange(len(corpus.sizes)) % 3 > 0)):
        for a in asked:
            want = distances([a] * len(lists), lists, prefilter=True)
            assert (corpus.bounds(a)[corpus.of] <= want).all()
            which, d, far = corpus.nearest(a, k, fit, threshold)
            rows, place = corpus.rows(which)
            got = dict(zip(rows.tolist(), d[place].tolist()))
            assert all(want[i] == x for i, x in got.items()) and set(np.flatnonzero(want == D.FAR)) == set(np.flatnonzero(far[corpus.of]))
            open_ = want < D.FAR if fit is None else (want < D.FAR) & fit[corpus.of]
            if threshold is not None:
                open_ &= want / np.maximum([len(x) for x in lists], max(1, len(a))) <= threshold
            one = {corpus.of[i]: want[i] for i in np.flatnonzero(open_)}
            most = sorted(one.values())[k - 1] if len(one) >= k else D.FAR
            assert set(np.flatnonzero(open_ & (want <= most))) <= set(got)
    assert sum(computed) < 0.4 * 4 * len(asked) * len(corpus.sizes)


def test_nearest_leaves_out_by_sizes_and_gaps_in_order(monkeypatch):
    """Rows of the same counts as the query, in another order: counts can't tell them apart, so that nearly all were compared in full before."""
    rng, head = random.Random(7), [1, 1, 2, -2, 3, 1, -4, 1, 2, 5, -3, 1, 1, 2, 3, -9, 2, 2, 7, 1]
    lists = [np.array(rng.sample(head, len(head)) + [1] * (i % 3), np.int64) for i in range(6000)]
    corpus, compared = D.Corpus(lists), []
    real = D.Corpus.distances
    monkeypatch.setattr(D.Corpus, "distances", lambda self, a, some: compared.append(len(some)) or real(self, a, some))
    for a in lists[:6]:
        want = np.array(cross([a], lists)[0])
        which, d, _ = corpus.nearest(a, 7)
        assert (want[corpus.rows(which)[0]] == d[corpus.rows(which)[1]]).all()
        assert set(np.flatnonzero(want <= np.sort(want)[6])) <= set(corpus.rows(which)[0].tolist())
    assert sum(compared) < 0.25 * 6 * len(corpus.sizes)


def test_bounds_by_sizes_and_by_gaps():
    lists = likely_sequences(900, 11) + [np.array(x, np.int64) for x in ([], [-1, -1], [-5, 1], [7] * 120, [-3] * 120, [1, -9000], [2, -400, 2])]
    corpus = D.Corpus(lists)
    distinct = [lists[i] for i in corpus.rows(np.arange(len(corpus.sizes)))[0][np.unique(corpus.rows(np.arange(len(corpus.sizes)))[1], return_index=True)[1]]]
    for a in (*lists[:25], *lists[-7:], np.array([7, -70, 9, 9, 1, -2, -3, 140], np.int64)):
        if (a >= 0).sum() <= D._PLACES:
            some = np.flatnonzero(corpus.many <= D._PLACES)
            want = distances([a[a >= 0]] * len(some), [distinct[i][distinct[i] >= 0] for i in some])
            for most in (60, 400, 1 << 40):
                near = 12 * np.abs(corpus.many[some] - (a >= 0).sum()) <= most
                if near.any():
                    got = corpus.size_distances(a, some[near], np.full(near.sum(), most))
                    assert ((got == want[near]) | (want[near] > most)).all() and (got[want[near] > most] > most).all()
        if D._costs(a).sum() <= D._Near.MOST:
            some = np.flatnonzero((corpus.many_gaps <= D._PLACES) & (corpus.costs <= D._Near.MOST))
            assert corpus.gap_distances(a, some).tolist() == distances([a[a < -1]] * len(some), [distinct[i][distinct[i] < -1] for i in some]).tolist()


def test_side_by_side_in_16_bits_as_one_by_one():
    lists = likely_sequences(500, 12) + [np.array(x, np.int64) for x in ([], [-1], [1, -2, 1, -3], [-7990, 1], [-4001, 1, 250, 2, 250], [-70_000], [-70_000, -69_990, 4])]
    corpus = D.Corpus(lists)
    every = np.arange(len(corpus.sizes))
    for a in (*lists[:12], *lists[-7:], np.array([2**31 - 1, -2, 250, 250, -4, -1, 1], np.int64)):
        assert corpus.distances(a, every)[corpus.of].tolist() == distances([a] * len(lists), lists).tolist()


def test_neighbours_are_those_of_all_pairs(spark):
    lists = likely_sequences(400, 6) + [np.array([1] * n, np.int64) for n in (300, 301, 900)]
    elems = lambda x: [(0, int(v)) if v >= 0 else (1, int(-v - 1)) for v in x]
    rows = [(f"r{i}", None if i % 11 == 0 else f"l{i % 7}", elems(x), i % 3) for i, x in enumerate(lists)]
    df = spark.createDataFrame(rows, "row_id string, label string, elems array<struct<kind:tinyint,val:int>>, fold bigint")
    some = df.where("row_id RLIKE '^r(.?1|40.)$'").withColumnRenamed("row_id", "query_id")
    for fold, threshold, k in ((True, None, 5), (False, None, 5), (False, 0.5, 5), (False, 1000.0, 402), (True, None, 402)):
        columns = ["elems", "fold"] if fold else ["elems"]
        got = D.neighbours(some.select("query_id", *columns), df.select("row_id", "label", *columns), k, threshold=threshold, blocks=2).collect()
        for i in {int(r.query_id[1:]) for r in some.collect()}:
            d = distances([lists[i]] * len(lists), lists, prefilter=True).tolist()
            want = []
            for j, x in enumerate(lists):
                norm = 0.0 if d[j] == 0 else 999.0 if d[j] == D.FAR else d[j] / max(len(x), len(lists[i]))
                if j != i and not (fold and i % 3 == j % 3) and not (threshold is not None and norm > threshold):
                    want.append((d[j], norm, rows[j][1] is None, rows[j][1] or "", f"r{j}"))
            mine = sorted((r for r in got if r.query_id == f"r{i}"), key=lambda r: r.rank)
            assert [(r.distance, r.norm, r.label is None, r.label or "", r.row_id) for r in mine] == sorted(want)[:k]


def test_codes_are_parsed_by_many_tasks(spark):
    plan = labelled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed, exchanged = (next(i for i, line in enumerate(plan) if word in line) for word in ("RLIKE", "Aggregate"))
    assert parsed <= exchanged  # in the plan's order, what is later comes first
