import json
import random

from pyspark.sql import functions as F

from seqloom.operators.shred import pivot_group, read_triples, struct_triples, to_triples

TEXTS = [
    (1, '{"a": {"list": [{"n": "x", "d": 007}]}}'),  # no JSON
    (2, '{"a": {"list": [{"n": "x", "d": 7}, null, {"d": "1.5"}, 3]}, "list": [{"n": "other"}]}'),
    (3, '{"a": "{\\"list\\": [{\\"n\\": null}]}"}'),
    (4, '{"a": {"list": {"n": "alone", "d": 2.0}}}'),
    (5, ""), (6, None), (7, "[1]"), (8, '{"a": NaN}'), (None, '{"a": {"list": [{"n": "nokey"}]}}'),
    (9, '{"a": {"list": []}}'), (10, '{"a": {"list": [{"n": "é\\u00e9", "n": "last", "d": true}]}}'),
]


def test_options(spark):
    df = spark.createDataFrame([(k, t, "v") for k, t in TEXTS], "id long, body string, path string")
    t = to_triples(df, "id", "body", embedded=["a"], singles=["a.list"])
    got = {tuple(r) for r in pivot_group(t, {"a.list[]": ["pos"]}, {"n": "n", "d": "d"}).drop("ancestor").collect()}
    assert got == {
        (2, 0, "x", "text", "7", "integer"), (2, 2, None, None, "1.5", "text"), (3, 0, None, "null", None, None),
        (4, 0, "alone", "text", "2.0", "text"), (None, 0, "nokey", "text", None, None), (10, 0, "last", "text", "true", "boolean"),
    }
    roots = pivot_group(t, {"": []}, {"a": "a"})
    assert {r[0] for r in roots.collect()} == {2, 3, 4, 9, 10, None}
    assert to_triples(df.limit(0), "id", "body").collect() == []


def test_deep_and_long(spark):
    deep = "x"
    for _ in range(200):
        deep = {"c": [deep]}
    long = {"c": [{"v": i} for i in range(30_000)]}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, json.dumps(long))], "id long, body string")
    t = to_triples(df, "id", "body")
    assert t.where("size(ords) = 200").count() == 1
    assert pivot_group(t, {"c[]": ["i"]}, {"v": "v"}).where("v IS NOT NULL AND cast(v AS int) = i").count() == 30_000


def tree(node, path="", ords=()):
    """The same nodes by way of the whole tree; numbers are given as their texts."""
    kinds = {dict: "object", list: "array", type(None): "null", bool: "boolean"}
    if isinstance(node, tuple):
        return [(path, [*ords], *node)]
    if isinstance(node, (dict, list)):
        items = [(f"{path}.{k}" if path else k, ords, v) for k, v in node.items()] if isinstance(node, dict) else [(path + "[]", (*ords, i), v) for i, v in enumerate(node)]
        return [(path, [*ords], kinds[type(node)], None), *(x for p, o, v in items for x in tree(v, p, o))]
    return [(path, [*ords], kinds.get(type(node), "text"), {True: "true", False: "false"}[node] if isinstance(node, bool) else node)]


def test_reader_against_the_tree():
    rng = random.Random(8)

    def make(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind == 3:
            return "{" + rng.choice([" ", ""]) + ",".join(f'"{rng.choice("abc")}" :{make(depth - 1)}' for _ in range(rng.randrange(4))) + "\n}"
        if kind == 2:
            return "[" + " , ".join(make(depth - 1) for _ in range(rng.randrange(4))) + "]"
        return rng.choice(["1", "-0", "2.50", "1e5", "true", "null", "false", '"x\\u00e9\\n"', '""', '"{}"', "12345678901234567890"])

    for _ in range(3000):
        text = make(4)
        if rng.random() < 0.3:  # mostly broken
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", ",", "}", "x", '"', "01", "NaN", "\t"]) + text[i + rng.randrange(2) :]
        try:
            want = tree(json.loads(text, parse_float=lambda x: ("text", x), parse_int=lambda x: ("integer", x), parse_constant=lambda x: 1 / 0))
        except (ValueError, ZeroDivisionError):
            want = None
        try:
            got = [t for t in read_triples(text, frozenset(), frozenset()) if t is not None]
        except ValueError:
            got = None
        key = lambda t: (t[0], t[1], t[2], t[3] or "")
        assert (got is None) == (want is None), text
        # a key given twice keeps its first place in a dict
        assert got is None or sorted(got, key=key) == sorted(want, key=key), text


def test_typed_columns(spark):
    """Typed columns give what their JSON text gives, but for the root's nulls; also by chosen paths."""
    rows = [(1, "i", 3, {"o": [{"n": "x", "c": None}, None, {"n": None, "c": 7}], "t": [[1], None, []]}), (2, None, None, {"o": None, "t": None}), (3, "j", 1, None), (None, "k", 1, None)]
    df = spark.createDataFrame(rows, "rec_key long, id string, k int, r struct<o:array<struct<n:string,c:int>>,t:array<array<int>>>")
    text = df.select("rec_key", F.to_json(F.struct("id", "k", "r"), {"ignoreNullFields": "false"}).alias("path"))
    show = lambda d: sorted(map(repr, ((r.rec_key, r.path, r.ords, r.kind, r.value) for r in d.collect())))
    got = struct_triples(df, "rec_key", ["id", "k", "r"])
    assert show(got) == show(to_triples(text, "rec_key", "path"))
    paths = ["r.o[]", "r.o[].n", "k"]
    assert show(struct_triples(df, "rec_key", ["id", "k", "r"], paths=paths)) == show(got.where(F.col("path").isin(paths))) == show(to_triples(text, "rec_key", "path", paths=paths))
    assert struct_triples(df.limit(0), "rec_key", ["id"]).collect() == []
