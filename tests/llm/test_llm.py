import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import tokens
from seqloom.llm.components import connected_groups
from seqloom.llm.digest import certify, digest_values, merge_digests, percentiles
from seqloom.llm.mixing import allocate, exponential_key, mix_sources
from seqloom.llm.nearest import nearest_in_time
from seqloom.llm.quality import label_documents, learn_rules, not_prose, quality_statistics
from seqloom.llm.rules import induce, to_case
from seqloom.llm.runs import code_events, collapse_runs
from seqloom.llm.tokens import count_tokens, encode_corpus


def groups_of(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]  # a chain
    pairs += [("hub", f"h{i:03d}") for i in range(80)] + [("self", "self"), (None, "x"), ("x", None), ("é", "Z")]
    pairs += [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(45)]
    pairs += [(b, a) for a, b in pairs[:30]] + pairs[:20]
    df = spark.createDataFrame([(a, b, "?") for a, b in pairs], "a string, b string, name string")
    got = [tuple(r) for r in connected_groups(df, "a", "b").collect()]
    assert len(got) == len(dict(got)) and dict(got) == groups_of(pairs)
    assert connected_groups(df.limit(0), "a", "b").collect() == []


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_nearest(spark, partitions):
    rng = random.Random(partitions)
    row = lambda i: (rng.choice(["hot"] * 5 + ["a", "b", "", None]), rng.choice([rng.randrange(400), rng.randrange(400), None]), i, "x")
    left = [row(i) for i in range(150)]
    right = [row(1000 + i) for i in range(90)]
    left, right = left + left[:30], right + right[:30] + [("hot", 7, None, "x")]
    schema = "key string, t bigint, id bigint, side string"
    want = {}
    for k, t, i, _ in left:
        found = [(abs(t - u), j) for k2, u, j, _ in right if k2 == k and None not in (u, j) and abs(t - u) <= 6] if None not in (k, t) else []
        if found:
            want[i] = min(found)[::-1]
    got = nearest_in_time(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 6, partitions=partitions).collect()
    assert len(got) == len(want) and {r.left_id: (r.right_id, r.distance) for r in got} == want


def test_nearest_empty(spark):
    e = spark.createDataFrame([], "key string, t bigint, id bigint")
    one = spark.createDataFrame([("k", 1, 1)], "key string, t bigint, id bigint")
    assert nearest_in_time(e, one, 5).collect() == [] and nearest_in_time(one, e, 5).collect() == []


@pytest.mark.parametrize("partitions", [1, 4, 30])
def test_runs(spark, partitions):
    rng = random.Random(partitions)
    rows, clock = [], 0
    for i in range(400):
        clock += rng.randrange(3)
        rows.append((rng.choice(["hot"] * 8 + ["y"]), "s", rng.choice("aaaaab"), clock, i, rng.choice([10, 12, 12, 90]), clock, i))
    rows += rows[:50] + [(None, "s", "a", 1, 999, 10, 1, 1), ("hot", "s", None, 1, 998, 10, 1, 1)]
    schema = "owner string, source string, same string, o1 bigint, o2 bigint, near bigint, clock bigint, pos bigint"
    by = defaultdict(set)
    for r in rows:
        if None not in r:
            by[r[:2]].add(r)
    want = set()
    for (o, s), events in by.items():
        run = []
        for r in [*sorted(events, key=lambda r: (r[3], r[4])), None]:
            if run and r and r[2] == run[-1][2] and abs(r[5] - run[-1][5]) <= 2:
                run.append(r)
                continue
            if len(run) > 1:
                want.add((o, s, run[0][7], len(run), run[-1][6] - run[0][6]))
            run = [r]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in collapse_runs(df, 2, partitions=partitions).collect()]
    assert len(got) == len(want) and set(got) == want
    assert collapse_runs(df.limit(0), 2).collect() == []


def test_code_events(spark):
    rows = [("a", ["S01", " s1 ", "G3", None, "x", "S", "S0002", "g010", "S2"]), ("b", []), ("c", None), (None, ["S1"]), ("d", ["G1", "G2"]), ("e", ["S1"] * 3000)]
    df = spark.createDataFrame(rows, "owner string, codes array<string>")
    got = [(r.owner, r.pos, r.same, r.clock) for r in code_events(df, "owner", "codes").where("owner <> 'e'").orderBy("owner", "pos").collect()]
    assert got == [("a", 0, "1", 0), ("a", 1, "1", 0), ("a", 6, "2", 3), ("a", 8, "2", 13)]
    assert [r.n_events for r in collapse_runs(code_events(df, "owner", "codes").where("owner = 'e'")).collect()] == [3000]


def test_digest(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", i % 3, float(v)) for i, v in enumerate(rng.lognormal(3, 2, 30_000))] + [("ties", 0, 5.0)] * 500 + [("one", 1, 2.5), ("none", 1, None), ("nan", 1, float("nan")), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "g string, day int, v double").repartition(6)
    qs = [0.01, 0.25, 0.5, 0.9, 0.99]
    days = digest_values(df, ["g", "day"], "v", compression=100)
    total = merge_digests(days, ["g"], compression=100)
    assert {r.g: r.n for r in total.collect()} == {"hot": 30_000, "ties": 500, "one": 1, None: 1}
    sure = {r.g: r for r in certify(df, ["g"], "v", percentiles(total, ["g"], qs), qs).collect()}
    values = np.array([v for g, _, v in rows if g == "hot"])
    for q, x in zip(qs, sure["hot"].estimates):
        miss = max(0, (values < x).mean() - q, q - (values <= x).mean())
        assert miss <= sure["hot"].rank_error <= 0.01
    assert sure["ties"].estimates == [5.0] * 5 and sure["ties"].rank_error == 0 and sure["one"].estimates == [2.5] * 5
    assert days.groupBy("g", "day").count().where("count > 1").count() == 0
    assert max(len(r.means) for r in total.collect()) <= 102
    assert digest_values(df.limit(0), ["g"], "v").collect() == []


def test_tokens(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(2)
    signs = " '  \n\t 　'stmdrevl1½٣.,!éa日本\U0001f600​\x1c\x85"
    texts = ["", None, " ", "\n\n", "it's we'll 'sabc", "aaaa aaaaa aaaaaaa", "<|endoftext|> x", "a" * 20_000, "word " * 5000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, x, "c") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[4:6], "id long, text string, chunk string").repartition(3)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    got = encode_corpus(df, "id", "text", chunk_chars=500).collect()
    assert len(got) == len(rows) + 2 and all(list(r.ids) == want[r.id] for r in got)
    assert {r.id: r.n_tokens for r in count_tokens(df, "id", "text").collect()} == {i: len(x) for i, x in want.items()}
    assert encode_corpus(df.limit(0), "id", "text").collect() == []


def test_allocate():
    got = allocate({"a": 100, "b": 1000, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 2, "b": 2, "c": 9}, 1000)
    assert got == {"a": 200.0, "b": 800.0, "c": 0.0}


@pytest.mark.parametrize("bucket_rows", [7, 100_000])
def test_mixing(spark, bucket_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["big"] * 6 + ["small"] + ["unlisted"]), rng.randrange(1, 50), rng.choice([None, 0.2, 1.0])) for i in range(600)]
    items = spark.createDataFrame([*rows, (None, "big", 5, 1.0), (9001, None, 5, 1.0), (9002, "big", None, 1.0)], "id long, source string, size long, weight double")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mix_sources(items, targets, total=4000, bucket_rows=bucket_rows)
    got = {r.id: (r.source, r.size, r.n_copies) for r in chosen.collect()}
    size = lambda s: sum(z * c for x, z, c in got.values() if x == s)
    assert abs(size("big") - 2800) <= 50 and abs(size("small") - 1200) <= 50
    copies = {c for s, _, c in got.values() if s == "small"}
    assert max(copies) - min(copies) <= 1 and max(copies) <= 3  # whole epochs come first
    shares = {r.source: r for r in report.collect()}
    assert shares["absent"].available == 0 and abs(shares["big"].actual_share - 0.7) < 0.02 and set(shares) == {"big", "small", "absent"}


def test_mixing_is_the_same_for_any_buckets(spark):
    items = spark.range(500).selectExpr("id", "'s' AS source", "id % 17 + 1 AS size", "CAST(1 AS DOUBLE) AS weight")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = [{r.id for r in mix_sources(items, targets, total=1000, bucket_rows=b)[0].collect()} for b in (3, 1000)]
    assert got[0] == got[1] and got[0]


def test_rules():
    rng = np.random.default_rng(0)
    x = rng.random((900, 3))
    y = (x[:, 0] < 0.4) | ((x[:, 1] > 0.8) & (x[:, 2] > 0.5))
    rules = induce(x[:600], y[:600])
    case = to_case(rules, ["a", "b", "c"])
    covered = np.zeros(300, bool)
    for r in rules:
        covered |= np.logical_and.reduce([c.holds(x[600:]) for c in r])
    assert (covered == y[600:]).mean() > 0.95 and case.startswith("CASE WHEN") and case.endswith("ELSE FALSE END")
    assert induce(x, np.zeros(900, bool)) == [] and to_case([], []) == "FALSE"


PROSE = "Most of the work went into the paper mill, and the next section has more on this. Nobody wrote down when it was moved. "
CODE = "table = clean_table(rows, width=%d)\nprint(f\"{table:>8}\")\n"


def test_quality(spark):
    docs = [(1, PROSE * 4), (2, CODE * 9), (3, PROSE + CODE * 9), (4, PROSE * 9 + CODE), (5, None), (6, ""), (7, " \n\t "), (8, "| of the mill | in the log |\n" * 20), (9, "x" * 100_000), (10, "日本語の文です。次の文です。")]
    docs += [(100 + i, (PROSE if i % 2 else CODE) * 3) for i in range(60)]
    rows = [(i, t, None if t is None else [(0, "code" if i % 2 == 0 and i >= 100 else "markdown", 1, 0, len(t))], "clash") for i, t in docs]
    df = spark.createDataFrame(rows, "id long, body string, cells array<struct<cell_no int, cell_kind string, execution_count int, char_from int, char_len int>>, n_words string")
    common = ["the", "of", "and", "into", "on", "when", "it", "was", "in"]
    stats = quality_statistics(df, "id", "body", common)
    by = {r.id: r for r in stats.collect()}
    assert len(by) == len(docs) and by[5].n_words == by[6].n_words == by[7].n_words == 0 and by[5].body_share is None and by[6].symbol_ratio is None
    assert by[1].n_words == len((PROSE * 4).split()) and by[1].punct_line_share == by[1].body_share == by[1].punct_line_chars == 1 and by[9].mean_word_length == 100_000
    words = (PROSE * 4).split()
    assert by[1].common_word_share == pytest.approx(sum(w.strip(".,").lower() in common for w in words) / len(words)) and by[1].distinct_word_share == pytest.approx(len({w.lower() for w in words}) / len(words))
    assert by[1].capital_word_share == pytest.approx(8 / len(words)) and by[1].words_per_sentence == pytest.approx(len(words) / 8) and by[1].comma_rate == pytest.approx(4 / len(words))
    assert by[2].body_share == 0 and by[2].code_line_chars == 1 and by[8].side_line_chars == by[8].marked_line_chars == 1 and by[10].ideograph_share > 0.8
    case, held = learn_rules(stats, label_documents(df, "id", "body", "cells", common), "id")
    found = {r.id for r in not_prose(stats, case).collect()}
    assert {2, 3} <= found and not found & {1, 4, 5, 6, 7} and held["n"] > 10 and held["precision"] > 0.8 and held["recall"] > 0.8
    case, held = learn_rules(stats, label_documents(df.limit(0), "id", "body", "cells", common), "id")
    assert case == "FALSE" and held["n"] == 0 and held["recall"] != held["recall"] and not_prose(stats, case).collect() == []
    assert quality_statistics(df.limit(0), "id", "body", []).collect() == []


def test_quality_of_layouts(spark):
    """The same cells as plain text, as JSON objects and as comments have the same body."""
    line = "The mill was closed, and it was in the log when it opened."
    texts = [f"# Mill\n\n{line}\n{line}\n\nx = 1", '{"cell_type": "markdown", "source": ["# Mill\\n"]}\n{"cell_type": "markdown", "source": ["%s\\n", "%s\\n"]}\n{"cell_type": "code", "source": ["x = 1\\n"]}' % (line, line), f"# %% [markdown]\n# # Mill\n\n# %% [markdown]\n# {line}\n# {line}\n\n# %%\nx = 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = [(r.body_words_per_line, r.body_common_word_share, r.body_punct_line_share) for r in quality_statistics(df, "id", "body", ["the", "was"]).collect()]
    assert got[0] == got[1] == got[2] == (13.0, pytest.approx(4 / 13), 1.0)


def test_digest_tree_of_days(spark):
    """Days' digests come from many sources, so merging them is a tree of the given fan-in with the same result."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("g", d, float(v)) for d in range(40) for v in rng.normal(0, 1, 60)], "g string, day int, v double")
    days = digest_values(df, ["g", "day"], "v")
    assert days.select("src").distinct().count() == 40
    total = merge_digests(days, ["g"], fan_in=3).collect()
    assert len(total) == 1 and total[0].n == 2400
    estimate = percentiles(merge_digests(days, ["g"], fan_in=3), ["g"], [0.5])
    assert certify(df, ["g"], "v", estimate, [0.5]).first().rank_error < 0.01


def test_words_of_every_chunk_are_split(spark):
    """A word that every chunk has goes to several tasks, each with about block_chunks places of it."""
    df = spark.createDataFrame([(i, "word") for i in range(400)], "id long, text string").repartition(4)
    _, found = tokens._encode(df, "id", "text", None, False, 4, 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r.n for r in found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(F.length("places") / 4).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 400 and len(sizes) == 3 and max(sizes) < 3 * sorted(sizes)[1]
    blocks = tokens._encode(df, "id", "text", None, False, 4, 10_000)[1]
    assert blocks.count() >= 400  # one row a chunk and task
    ids = {tuple(r.ids) for r in encode_corpus(df, "id", "text", chunk_chars=4, block_chunks=10).collect()}
    assert len(ids) == 1


def test_ranges_are_even_for_uneven_weights(spark):
    """One weight in a hundred at the floor doesn't make the last ranges larger."""
    items = spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, 'a', 'b') AS source", "1 + id % 5 AS size", "IF(id % 100 = 0, 0.05, 0.9) AS weight")
    key = exponential_key(F.col("id"), F.col("weight"), 1)
    n = items.withColumn("key", key).repartitionByRange(20, "source", "key", "id").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r[1] for r in n)
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = [{(r.id, r.n_copies) for r in mix_sources(items, targets, total=30_000, bucket_rows=b)[0].collect()} for b in (1000, 1_000_000)]
    assert got[0] == got[1] and len(got[0]) > 5000
