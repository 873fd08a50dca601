"""Deeply nested semi-structured records as flat tables that keep their links."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TRIPLES = "path string, ords array<int>, kind string, value string"
_TRIPLE = f"struct<{_TRIPLES.replace(' ', ':').replace(',:', ',')}>"
_BLANK = re.compile(r"[ \t\n\r]*").match
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?").match
_WORDS = {"true": ("boolean", "true"), "false": ("boolean", "false"), "null": ("null", None)}


class _Open:
    """An object or array that the reader is in."""

    __slots__ = ("path", "ords", "n", "seen", "key")

    def __init__(self, path: str, ords: list[int], is_object: bool) -> None:
        self.path, self.ords, self.n, self.key = path, ords, 0, None
        self.seen: dict[str, tuple[int, int]] | None = {} if is_object else None


def read_triples(text: str, embedded: frozenset[str], singles: frozenset[str], path: str = "", ords: Sequence[int] = ()) -> list[tuple | None]:
    """Path, ordinals, kind and value of each node of one JSON text, parents first, in one pass from left to right; ValueError if it is no JSON.

    No tree is built: the reader holds the objects and arrays that are open. Of a key given twice in an object the nodes of the earlier one become None.
    """
    out: list[tuple | None] = []
    stack: list[_Open] = []
    at, end, ords = _BLANK(text, 0).end(), len(text), list(ords)
    while True:
        # a value begins at `at`; path and ords are its own
        sign = text[at : at + 1]
        if sign == '"':
            value, at = scanstring(text, at + 1, True)
            inner = None
            if path in embedded and value.lstrip(" \t\n\r")[:1] in ("{", "["):
                try:
                    inner = read_triples(value, embedded, singles, path, ords)
                except ValueError:
                    pass
            out += inner or [(path, ords, "text", value)]
        elif sign == "{" or sign == "[":
            if sign == "{" and path in singles:  # an object standing where a list of them may stand
                out.append((path, ords, "array", None))
                path, ords = path + "[]", [*ords, 0]
            out.append((path, ords, "object" if sign == "{" else "array", None))
            at = _BLANK(text, at + 1).end()
            if text[at : at + 1] == ("}" if sign == "{" else "]"):
                at += 1
            else:
                stack.append(_Open(path, ords, sign == "{"))
                at, path, ords = _enter(text, at, stack[-1], out)
                continue
        elif number := _NUMBER(text, at):
            out.append((path, ords, "text" if number[1] or number[2] else "integer", number[0]))
            at = number.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError("no JSON value")
            out.append((path, ords, *_WORDS[word]))
            at += len(word)
        # what follows a value: the next one, or the end of what is open
        while stack:
            now = stack[-1]
            if now.seen is not None:
                now.seen[now.key] = (now.seen[now.key][0], len(out))
            at = _BLANK(text, at).end()
            sign = text[at : at + 1]
            if sign == ",":
                at, path, ords = _enter(text, _BLANK(text, at + 1).end(), now, out)
                break
            if sign != ("]" if now.seen is None else "}"):
                raise ValueError("no end of what is open")
            stack.pop()
            at += 1
        else:
            if _BLANK(text, at).end() != end:
                raise ValueError("more than one value")
            return out


def _enter(text: str, at: int, now: _Open, out: list[tuple | None]) -> tuple[int, str, list[int]]:
    """Where the next value of an object or array begins, and its path and ordinals."""
    if now.seen is None:
        now.n += 1
        return at, now.path + "[]", [*now.ords, now.n - 1]
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    key, at = scanstring(text, at + 1, True)
    at = _BLANK(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no value of a key")
    if key in now.seen:
        first, last = now.seen[key]
        out[first:last] = [None] * (last - first)
    now.key, now.seen[key] = key, (len(out), len(out))
    return _BLANK(text, at + 1).end(), f"{now.path}.{key}" if now.path else key, now.ords


def to_triples(df: DataFrame, key: str, text: str, *, embedded: Sequence[str] = (), singles: Sequence[str] = (), paths: Sequence[str] | None = None) -> DataFrame:
    """Read the JSON texts of a column into one row a node: rec_key, path, ords, kind, value.

    path names the keys from the root, `[]` standing for an element of an array; ords holds the 0-based
    positions at each `[]` of the path, null elements counted. kind is object, array, null, boolean, integer
    or text (also of other numbers), and value the scalar as text. embedded: paths whose value may be a JSON text again;
    singles: paths where one object may stand in place of an array of objects; paths: if given, only nodes of these leave the task. Null, empty and invalid
    texts give no rows; of a key that is given twice in an object the last holds. Objects may nest to any depth.
    """
    deep, alone, wanted = frozenset(embedded), frozenset(singles), None if paths is None else frozenset(paths)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = read_triples(t, deep, alone) if t else []
                except ValueError:
                    continue
                for triple in found:
                    if triple is not None and (wanted is None or triple[0] in wanted):
                        keys.append(k)
                        for column, x in zip(out, triple):
                            column.append(x)
                if len(keys) > 50_000:
                    yield _batch(batch.schema.field(0).type, keys, out)
                    keys, out = [], ([], [], [], [])
            yield _batch(batch.schema.field(0).type, keys, out)

    rows = df.select(F.col(f"`{key}`").alias("rec_key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(parse, f"rec_key {rows.schema[0].dataType.simpleString()}, {_TRIPLES}")


def _batch(kind: pa.DataType, keys: list, out: tuple[list, list, list, list]) -> pa.RecordBatch:
    arrays = [pa.array(keys, kind), pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["rec_key", "path", "ords", "kind", "value"])


def struct_triples(df: DataFrame, key: str, columns: Sequence[str], *, paths: Sequence[str] | None = None) -> DataFrame:
    """The same rows of typed columns, as of an object with the columns as its keys, without a way over text: Spark walks arrays and structs by its own functions."""
    rows = df.select(F.col(f"`{key}`").alias("rec_key"), F.struct(*(F.col(f"`{c}`").alias(c) for c in columns)).alias("r"))
    found = _typed(F.col("r"), rows.schema["r"].dataType, "", F.array().cast("array<int>"), None if paths is None else frozenset(paths))
    return rows.select("rec_key", F.explode(found).alias("t")).select("rec_key", "t.*")


def _typed(c: Column, kind: T.DataType, path: str, ords: Column, paths: frozenset[str] | None) -> Column:
    """An array of the triples of a value and of all below it; those of other paths are not made."""
    node = lambda what, value=None: F.struct(F.lit(path).alias("path"), ords.alias("ords"), F.lit(what).alias("kind"), (F.lit(None) if value is None else value).cast("string").alias("value")).cast(_TRIPLE)
    below = lambda p: paths is None or any(x == p or x.startswith((f"{p}.", f"{p}[]")) for x in paths)
    own = lambda what, value=None: F.array(node(what, value)) if paths is None or path in paths else F.array().cast(f"array<{_TRIPLE}>")
    if isinstance(kind, T.StructType):
        inner = [(f.name, f"{path}.{f.name}" if path else f.name, f.dataType) for f in kind]
        found = F.concat(own("object"), *(_typed(c[n], t, p, ords, paths) for n, p, t in inner if below(p)))
    elif isinstance(kind, T.ArrayType):
        found = own("array")
        if below(f"{path}[]"):
            found = F.concat(found, F.flatten(F.transform(c, lambda x, i: _typed(x, kind.elementType, f"{path}[]", F.array_append(ords, i), paths))))
    else:
        name = "boolean" if isinstance(kind, T.BooleanType) else "integer" if isinstance(kind, T.IntegralType) else "text"
        found = own(name, c)
    return F.when(c.isNull(), own("null")).otherwise(found)


def pivot_group(triples: DataFrame, ancestors: dict[str, Sequence[str]], fields: dict[str, str]) -> DataFrame:
    """One flat table of the objects at a repeated ancestor path, which may occur in several places.

    ancestors: a path such as `results[].options[]` ('' for the root) and a column name for each `[]` of it, so that (rec_key, *names) is the
    row's key and its prefix the parent's key; names that a path doesn't have are 0. fields: path below it -> column. Each
    object there is one row, null elements and other values none. For each field there is a column with
    the value as text and one `<name>_kind` with its kind (null if the key is missing); other columns are ancestor and all names.
    """
    at = {(f"{a}." if a else "") + f: (a, c) for a in ancestors for f, c in fields.items()}
    depth = {a: a.count("[]") for a in ancestors}
    place = F.create_map(*(F.lit(x) for p, a in [*((a, a) for a in ancestors), *((p, a) for p, (a, _) in at.items())] for x in (p, a)))
    rows = triples.where(F.col("path").isin(*ancestors, *at)).withColumn("ancestor", F.element_at(place, F.col("path")))
    rows = rows.where(F.size("ords") == F.element_at(F.create_map(*(F.lit(x) for a, d in depth.items() for x in (a, d))), F.col("ancestor")))
    is_field = lambda c: F.col("path").isin(*(p for p, (_, n) in at.items() if n == c))
    aggs = [F.max(F.when((F.col("path") == F.col("ancestor")) & (F.col("kind") == "object"), 1)).alias("is_object")]
    for c in fields.values():
        aggs += [F.max(F.when(is_field(c), F.col("value"))).alias(c), F.max(F.when(is_field(c), F.col("kind"))).alias(f"{c}_kind")]
    out = rows.groupBy("rec_key", "ancestor", "ords").agg(*aggs).where("is_object = 1")
    names = list(dict.fromkeys(n for ns in ancestors.values() for n in ns))
    of = {n: [(a, list(ns).index(n)) for a, ns in ancestors.items() if n in ns] for n in names}
    ordinal = lambda n: F.coalesce(*(F.when(F.col("ancestor") == a, F.get("ords", F.lit(i))) for a, i in of[n]), F.lit(0))
    return out.select("rec_key", "ancestor", *(ordinal(n).alias(n) for n in names), *(x for c in fields.values() for x in (c, f"{c}_kind")))
