"""Column functions over size/gap sequences: ARRAY<STRUCT<kind TINYINT, val INT>>, kind 0 a size, 1 a gap.

A null sequence gives null, an empty one the value of no elements. Sizes are 0..255 and gaps 0..65535.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTS = "array<struct<kind:tinyint,val:int>>"

# Blocks of queries and responses, and the weights of the edit distance.
QUERY_BLOCK, RESPONSE_BLOCK = 128, 468
SIZE_INSERT, GAP_INSERT, SIZE_SUBSTITUTE_DIVIDER, GAP_SUBSTITUTE, SWAP = 12, 1, 4, 3, 3

# Reasons why short sequences are hard to tell apart, by the shape of the sequence.
SINGLE_SIZE_REASONS = {n: f"R004 Single packet of size {n}." for n in range(1, 7)}
SINGLE_SIZE_OTHER = "R004 A single packet of unknown size."
SHAPE_REASONS = {
    "SS": "R102 Single Domain with www redirect. A + A (for www)",
    "SGS": "R102A Single Domain with www redirect. A + A (for www). Missing gap.",
    "SSS": "R103C Three Domain requests. No gaps.",
    "SSGS": "R103A Three Domain requests. Missing first gap.",
    "SGSS": "R103B Three Domain requests. Missing second gap.",
    "SSSS": "R104A Four Domain requests. No gaps.",
    "SGSGS": "R103 Three Domain requests. Can sometimes be R102 with an erroneous `ssl.gstatic.com` or similar.",
    "SGSSS": "R104B Four Domain requests. Gap after one.",
    "SSGSS": "R104C Four Domain requests. Gap after two.",
    "SSSGS": "R104D Four Domain requests. Gap after three.",
    "SSSSS": "R105A Five Domain requests. No gaps.",
    "SGSGSS": "R104E Four Domain requests.",
    "SGSSGS": "R104F Four Domain requests.",
    "SSGSGS": "R104G Four Domain requests.",
    "SGSSSS": "R105B Five Domain requests.",
    "SSGSSS": "R105C Five Domain requests.",
    "SSSGSS": "R105D Five Domain requests.",
    "SSSSGS": "R105E Five Domain requests.",
    "SSSSSS": "R106A Five Domain requests. No gaps.",
}


def block_padding(size: Column, block: int) -> Column:
    """The size padded to whole blocks."""
    return F.ceil(size / block) * block


def size_element(size: Column, block: int = RESPONSE_BLOCK) -> Column:
    """The number of blocks, kept to 8 bits as the sequences store it."""
    return F.struct(F.lit(0).cast("tinyint").alias("kind"), F.pmod(F.ceil(size / block), F.lit(256)).cast("int").alias("val"))


def gap_value(gap: Column, base: int, mode: str = "log2") -> Column:
    """The gap's number: how often base fits before at most base is left, for log2 its whole logarithm; null if there is no gap."""
    times = F.ceil(gap / base).cast("bigint") - 1
    value = F.length(F.bin(times)) - 1 if mode == "log2" else F.pmod(times, F.lit(65536))
    return F.when(gap > base, F.nullif(value.cast("int"), F.lit(0)))


def gap_element(value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(1).cast("tinyint").alias("kind"), value.cast("int").alias("val")))


def code(element: Column) -> Column:
    """S05 or G12: at least two digits."""
    return F.format_string("%s%02d", F.when(element["kind"] == 0, "S").otherwise("G"), element["val"])


def codes(elements: Column) -> Column:
    return F.transform(elements, code)


def parse_codes(texts: Column) -> Column:
    """Elements of codes such as S05; outer blanks, letter case and padding don't matter, codes out of range or of other form are left out."""
    bare = F.transform(texts, lambda t: F.upper(F.trim(t)))
    number = lambda c: F.substring(c, 2, 20).try_cast("int")
    most = lambda c: F.when(F.substring(c, 1, 1) == "S", 255).otherwise(65535)
    good = F.filter(bare, lambda c: c.rlike("^[SG][0-9]{1,18}$") & (number(c) <= most(c)))
    return F.transform(good, lambda c: F.struct(F.when(F.substring(c, 1, 1) == "S", 0).otherwise(1).cast("tinyint").alias("kind"), number(c).alias("val")))


def complexity(elements: Column) -> Column:
    """The sum of the sizes."""
    return F.aggregate(F.filter(elements, lambda e: e["kind"] == 0), F.lit(0), lambda a, e: a + e["val"])


def message_count(elements: Column) -> Column:
    return F.when(elements.isNotNull(), F.size(F.filter(elements, lambda e: e["kind"] == 0)))


def length(elements: Column) -> Column:
    return F.when(elements.isNotNull(), F.size(elements))


def abstract(elements: Column) -> Column:
    """The same sequence with all gaps zero."""
    return F.transform(elements, lambda e: F.struct(e["kind"].alias("kind"), F.when(e["kind"] == 0, e["val"]).otherwise(0).alias("val")))


def shape(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.when(e["kind"] == 0, "S").otherwise("G")), "")


def reason(elements: Column) -> Column:
    """Why a short sequence is hard to classify, by its shape; null for all others."""
    out = F.when(shape(elements) == "S", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SINGLE_SIZE_REASONS.items() for x in kv)), F.get(elements, F.lit(0))["val"]), F.lit(SINGLE_SIZE_OTHER)))
    known = F.create_map(*(F.lit(x) for kv in SHAPE_REASONS.items() for x in kv))
    return out.otherwise(F.element_at(known, shape(elements)))


def one_hot(elements: Column) -> Column:
    """16 numbers an element: at 0 a gap's value, at s a 1 for size s; null for sizes of 16 and more."""
    row = lambda e: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(e["kind"] == 1, F.when(i == 0, e["val"]).otherwise(0)).otherwise((i == e["val"]).cast("int")))
    return F.when(~F.exists(elements, lambda e: (e["kind"] == 0) & (e["val"] >= 16)), F.transform(elements, row))


def vectors(elements: Column) -> Column:
    """Pairs (size, gap), one of them 0."""
    return F.transform(elements, lambda e: F.array(F.when(e["kind"] == 0, e["val"]).otherwise(0), F.when(e["kind"] == 1, e["val"]).otherwise(0)))


def insert_cost(e: Column) -> Column:
    """The cost of inserting or deleting an element."""
    return F.when(e["kind"] == 0, SIZE_INSERT).otherwise(e["val"] * GAP_INSERT)


def substitute_cost(a: Column, b: Column) -> Column:
    both = (SIZE_INSERT + SIZE_INSERT) // SIZE_SUBSTITUTE_DIVIDER
    return F.when(a == b, 0).when((a["kind"] == 0) & (b["kind"] == 0), both).when((a["kind"] == 1) & (b["kind"] == 1), GAP_SUBSTITUTE * F.abs(a["val"] - b["val"])).otherwise(insert_cost(a) + insert_cost(b))


def tail_distance(a: Column, b: Column) -> Column:
    """The constant-rate distance: the cost of inserting what the longer sequence has beyond the shorter one's length."""
    rest = lambda x, n: F.aggregate(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))), F.lit(0), lambda s, e: s + insert_cost(e))
    return F.when(F.size(a) >= F.size(b), rest(a, F.size(b))).otherwise(rest(b, F.size(a)))


def normalised(distance: Column, a: Column, b: Column) -> Column:
    """The distance by the longer length; 0 for 0, and 999 if both are empty."""
    return F.when(distance == 0, 0.0).otherwise(F.coalesce(F.try_divide(distance, F.greatest(F.size(a), F.size(b))), F.lit(999.0)))


def ngrams(elements: Column, n: int) -> Column:
    """All runs of n neighbouring elements."""
    return F.when(F.size(elements) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(elements) - n + 1, F.lit(1))), lambda i: F.slice(elements, i, n))).otherwise(F.array().cast(f"array<{ELEMENTS}>"))


def padded_vectors(elements: Column, length: int) -> Column:
    """vectors cut to, or filled up behind with (0, 0) to, a length."""
    rest = F.greatest(F.lit(length) - F.size(elements), F.lit(0))
    return F.concat(F.slice(vectors(elements), 1, length), F.array_repeat(F.array(F.lit(0), F.lit(0)), rest))
