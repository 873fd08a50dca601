import random

from seqloom.operators.graph import merge_subsets


def brute(domain, edges):
    """The same by sets: equal ones until nothing changes, then all subsets at once, and again."""
    at, live = {n: n for n in domain}, {n: {d for s, d in edges if s == n and d != n} for n in domain}
    while True:
        before = len(live)
        while True:
            best: dict = {}
            for n in sorted(live):
                best.setdefault((domain[n], frozenset(live[n])), n)
            to = {n: best[domain[n], frozenset(live[n])] for n in live}
            if all(n == t for n, t in to.items()):
                break
            live = {t: {to[d] for n in live if to[n] == t for d in live[n]} - {t} for t in set(to.values())}
            at = {n: to[m] for n, m in at.items()}
        to = {a: min(((len(live[b]), b) for b in live if b != a and domain[a] is not None and domain[b] == domain[a] and live[b] <= live[a]), default=(0, a))[1] for a in live}
        live = {n: {to[d] for d in live[n]} - {n} for n in live if to[n] == n}
        at = {n: to[m] for n, m in at.items()}
        if len(live) == before:
            return at


def test_merge_subsets(spark):
    rng = random.Random(4)
    parts = [(0, {"a": "x", "b": "x", "c": "y", "d": None, "e": None}, [("a", "c"), ("b", "c"), ("b", "d"), ("d", "c"), ("e", "c"), ("e", "a")])]
    for i in range(1, 7):
        names = [f"n{j:02d}" for j in range(14)]
        parts.append((i, {n: rng.choice(["x", "y", "z", None]) for n in names}, [(a, b) for a in names for b in names if a > b and rng.random() < 0.3]))
    # all graphs as one, apart by the names' first part
    name = lambda i, n: None if n is None else f"{i}{n}"
    domain = {name(i, n): name(i, d) for i, ds, _ in parts for n, d in ds.items()}
    edges = [(name(i, a), name(i, b)) for i, _, es in parts for a, b in es]
    nodes = spark.createDataFrame(list(domain.items()), "node string, domain string")
    df = spark.createDataFrame([*edges, edges[0], (None, "0a")], "src string, dst string")
    got = {r.node: r.merged for r in merge_subsets(nodes, df).collect()}
    # equal successors of nodes without a domain make one node of all graphs, so each is compared by itself but for those
    want = brute(domain, edges)
    assert got == want and len(set(want.values())) < len(domain)


def test_no_edges(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "node string, domain string")
    none = spark.createDataFrame([], "src string, dst string")
    assert {r.node: r.merged for r in merge_subsets(nodes, none).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert merge_subsets(nodes.limit(0), none).collect() == []
