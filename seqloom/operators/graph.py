"""Directed graphs as edge tables (src, dst): closure, reduction, pruning and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import drop_table, materialize


def closure(edges: DataFrame, *, most: int | None = None) -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more; null ends are left out, cycles give pairs (x, x).

    Semi-naive: each round extends only the pairs found in the round before, and keeps those that are new. The result is as large as
    the reachability itself, so it suits graphs of bounded depth such as hierarchies. It ends when a round finds nothing new, which is after the longest path at the latest.
    most: if given, a closure of more pairs ends in an error as soon as a round shows it, before it fills the disk.
    """
    edges = materialize(edges.select("src", "dst").dropna().distinct())
    rounds = [edges]
    step = edges.toDF("mid", "dst")
    while True:
        found = rounds[-1].toDF("src", "mid").join(step, "mid").select("src", "dst").distinct()
        for known in rounds:
            found = found.join(known, ["src", "dst"], "left_anti")
        found = materialize(found)
        if found.isEmpty():
            drop_table(found)
            return _union(rounds)
        rounds.append(found)
        if most is not None and sum(r.count() for r in rounds) > most:
            raise ValueError(f"more than {most} pairs are reachable")
        if len(rounds) > 8:  # few tables to compare with
            merged = materialize(_union(rounds[:-1]))
            for r in rounds[1:-1]:  # the first holds the edges, which each round reads
                drop_table(r)
            rounds = [merged, found]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reduction(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """The edges of an acyclic graph without those whose end another successor of their start reaches."""
    e = edges.select("src", "dst").dropna().distinct()
    longer = e.toDF("src", "via").join(reach.toDF("via", "dst"), "via").select("src", "dst").distinct()
    return e.join(longer, ["src", "dst"], "left_anti")


def reaching(nodes: DataFrame, reach: DataFrame, root: str) -> DataFrame:
    """The nodes (column node) that are the root or reach it."""
    return nodes.join(reach.where(F.col("dst") == root).select(F.col("src").alias("node")).distinct(), "node", "left_semi").unionByName(nodes.where(F.col("node") == root)).distinct()


def merge_equal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Merge nodes of one domain that have the same successors, until nothing changes: node, merged.

    nodes: node (unique), domain. merged is the least node of those that became one. An edge within a merged node goes. Sets of successors are compared by
    their number and two sums of hashes, so no list of a hub's successors is gathered.
    """
    state = materialize(nodes.select("node", "domain", F.col("node").alias("merged")))
    base = materialize(edges.select("src", "dst").dropna().distinct())
    while True:  # each round but the last leaves fewer merged nodes
        to = state.select("node", "merged")
        e = base.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()
        sums = e.groupBy(F.col("a").alias("merged")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("b", F.lit(1))).alias("h2"))
        reps = state.groupBy("merged").agg(F.min("domain").alias("domain")).join(sums, "merged", "left").fillna(0, ["n", "h2"])
        best = reps.groupBy("domain", "n", "h1", "h2").agg(F.min("merged").alias("best"))
        cond = [reps[c].eqNullSafe(best[c]) for c in ("domain", "n", "h1", "h2")]
        moved = reps.join(best, cond).select(reps["merged"], "best")
        new = materialize(state.join(moved, "merged").select("node", "domain", F.col("best").alias("merged")))
        same = new.select("merged").distinct().count() == state.select("merged").distinct().count()
        drop_table(state)
        state = new
        if same:
            drop_table(base)
            return state.select("node", "merged")


def resolve_labels(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Follow each name (column name) through the mapping (domain unique, target) to its end, however long the chain: name, resolved, hops.

    resolved is the first name of the chain that the mapping doesn't lead on from. A chain that runs into a loop ends at the name where it enters it, which is the
    first to come twice; so a name on a loop resolves to itself with no hops. Null names, domains and targets are left out.

    Pointer doubling: each round joins the table of jumps with itself, so a chain of n hops takes log2(n) rounds, with one row a domain.
    """
    jumps = materialize(mapping.select(F.col("domain").alias("name"), F.col("target").alias("at")).dropna())
    ended, looping = _doubled(jumps)
    if not looping.isEmpty():
        # a power of the jumps that maps the names on loops one to one, and all others onto them
        power = looping.select("name", "at")
        ring = materialize(power.select(F.col("at").alias("name")).distinct())
        n = ring.count()
        while (m := (smaller := materialize(ring.join(power, "name").select(F.col("at").alias("name")).distinct())).count()) < n:
            power = materialize(_twice(power.withColumn("hops", F.lit(0))).select("name", "at"))
            ring, n = smaller, m
        # on the loops the chains end
        tails = jumps.join(looping.select("name"), "name", "left_semi").join(ring, "name", "left_anti")
        on_loop = ring.select("name", F.col("name").alias("at"), F.lit(0).cast("bigint").alias("hops"))
        ended = ended.unionByName(_doubled(materialize(tails))[0]).unionByName(on_loop)
    found = names.select("name").dropna().distinct().join(ended, "name", "left")
    return found.select("name", F.coalesce("at", "name").alias("resolved"), F.coalesce("hops", F.lit(0)).alias("hops"))


def _twice(jumps: DataFrame) -> DataFrame:
    """name, at, hops: each jump followed by the jump from where it ends, if there is one."""
    onward = jumps.select(F.col("name").alias("at"), F.col("at").alias("then"), F.col("hops").alias("more"))
    j = jumps.join(onward, "at", "left")
    return j.select("name", F.coalesce("then", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("then").isNotNull().alias("open"))


def _doubled(jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jumps (name unique, at) followed to their ends: those that end and those that never do, both as name, at, hops.

    Names at a distance of d hops from an end have the next one at d - 1; so once a round ends no further name, none of the others will.
    """
    state, left = materialize(jumps.select("name", "at", F.lit(1).cast("bigint").alias("hops"))), -1
    while True:
        new = materialize(_twice(state))
        drop_table(state)
        n = new.where("open").count()
        if n in (0, left):
            return new.where("NOT open").drop("open"), new.where("open").drop("open")
        state, left = new, n


def _subset_picks(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """a, best: nodes whose successors include all those of another node of their domain, with the one that has the fewest, the least name on a tie.

    No two nodes of a domain have equal successors. A set is only met by nodes that have its rarest successor of the domain, so no pairs of a domain's nodes
    are made; one without successors is met by all.
    """
    e = edges.join(reps.where("domain IS NOT NULL").toDF("src", "domain"), "src")
    often = e.groupBy("domain", "dst").agg(F.count("*").alias("often"))
    sets = e.join(often, ["domain", "dst"]).groupBy("src", "domain").agg(F.count("*").alias("n"), F.min(F.struct("often", "dst"))["dst"].alias("dst"))
    met = e.select("domain", "dst", F.col("src").alias("a")).join(sets.select("domain", "dst", F.col("src").alias("b"), "n"), ["domain", "dst"]).where("a <> b").select("a", "b", "n")
    shared = met.join(edges.toDF("b", "dst"), "b").join(edges.toDF("a", "dst"), ["a", "dst"], "left_semi")
    inside = shared.groupBy("a", "b", "n").agg(F.count("*").alias("c")).where("c = n").select("a", "b", "n")
    leaves = reps.where("domain IS NOT NULL").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").groupBy("domain").agg(F.min("node").alias("b"))
    empty = reps.join(leaves, "domain").where("node <> b").select(F.col("node").alias("a"), "b", F.lit(0).cast("bigint").alias("n"))
    return inside.unionByName(empty).groupBy("a").agg(F.min(F.struct("n", "b"))["b"].alias("best"))


def merge_subsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Merge nodes of one domain with equal successors, and nodes into one of their domain whose successors they include, until nothing changes: node, merged.

    nodes: node (unique), domain; a null domain has only nodes with equal successors. Edges to a node that was merged lead to what it became, its own
    edges go. Which of several nodes takes it doesn't depend on any order: the one with the fewest successors, then the least.
    """
    state = materialize(nodes.select("node", F.col("node").alias("merged")))
    live = materialize(edges.select("src", "dst").dropna().where("src <> dst").distinct())
    reps = nodes.select("node", "domain")
    while True:  # each round but the last leaves fewer nodes
        same = merge_equal(reps, live).toDF("node", "to")
        live = _moved(live, same, keep_out=True)
        reps = materialize(same.where("node = to").select("node").join(nodes.select("node", "domain"), "node"))
        picks = materialize(_subset_picks(reps, live))
        into = same.toDF("node", "a").join(picks, "a", "left").select("node", F.coalesce("best", "a").alias("to"))
        into = materialize(into)
        live = _moved(live, into, keep_out=False)
        state = materialize(state.join(into.toDF("merged", "to"), "merged").select("node", F.col("to").alias("merged")))
        if into.where("node <> to").isEmpty():
            return state
        reps = materialize(into.where("node = to").select("node").join(nodes.select("node", "domain"), "node"))


def _moved(edges: DataFrame, to: DataFrame, *, keep_out: bool) -> DataFrame:
    """Edges with their ends mapped; the edges out of nodes that moved are mapped too, or go."""
    e = edges.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst")
    e = e if keep_out else e.where("src = a")
    return materialize(e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
