"""The general numbered problems over the given tables: p2 (periods and gaps) and p3 (nested records)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.intervals import periods_and_gaps
from seqloom.operators.shred import pivot_group, struct_triples, to_triples
from seqloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous busy periods and the gaps between them, of each (trace_id, source) of matched_queries."""
    rows = table(spark, sf_dir, "matched_queries")
    rows = rows.select("trace_id", "source", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"))
    return periods_and_gaps(rows, ["trace_id", "source"], "start_us", "end_us")


_RECORD_FIELDS = {"id": "seq_path", "k": "k", "label": "label", "reason": "reason"}
_SHAPES = {"": [], "results[]": ["rec_pos"]}  # where a Misclassification may stand in a line
_AT = [f"{p}." if p else "" for p in _SHAPES]
_OPTIONS = {f"{p}class_result.options[]": [*o, "opt_pos"] for p, o in zip(_AT, _SHAPES.values())}


def _triples(spark: SparkSession, sf_dir: str, paths: list[str]) -> DataFrame:
    """Triples of both tables, those of the given paths: the typed columns by Spark's functions, the lines read as text. Repeated rows are left to the pivot."""
    rows = table(spark, sf_dir, "misclassifications").select("record_id", F.col("seq_path").alias("id"), "k", "label", "reason", "class_result")
    typed = struct_triples(rows, "record_id", ["id", "k", "label", "reason", "class_result"], paths=paths)
    lines = table(spark, sf_dir, "misclass_lines").where("raw_line IS NOT NULL")
    read = to_triples(
        lines,
        "record_id",
        "raw_line",
        embedded=[x for p in _AT for x in (f"{p}class_result", f"{p}class_result.options")] + ["results", "results[]"],
        singles=[f"{p}class_result.options" for p in _AT],
        paths=paths,
    )
    return typed.unionByName(read)


def _options(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    """The LabelOption objects of all shapes, with rec_pos and opt_pos and some of their fields."""
    triples = _triples(spark, sf_dir, [*_OPTIONS, *(f"{p}.{f}" for p in _OPTIONS for f in fields)])
    return pivot_group(triples, _OPTIONS, {f: f for f in fields})


def _digits(value: Column) -> Column:
    """A number as digits without leading zeros; '' if it is anything else."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(bare.rlike("^[0-9]+$"), F.regexp_replace(bare, "^0+(?=[0-9])", "")).otherwise("")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each LabelOption object of both tables with its place in its parents."""
    out = _options(spark, sf_dir, ["name", "distance_min"])
    name = F.coalesce("name", F.lit(""))
    return out.select(F.col("rec_key").alias("record_id"), "rec_pos", "opt_pos", name.alias("opt_name"), _digits(F.col("distance_min")).alias("distance_min")).distinct()


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents: one row a Misclassification object, (record_id, rec_pos) being its key."""
    fields = _RECORD_FIELDS | {"class_result": "class_result", "results": "results"}
    triples = _triples(spark, sf_dir, [*_SHAPES, *(f"{p}{f}" for p in _AT for f in fields)])
    # an object that only holds results is no Misclassification
    out = pivot_group(triples, _SHAPES, fields).where("seq_path IS NOT NULL AND NOT (ancestor = '' AND coalesce(results_kind, '') = 'array')")
    return out.select(F.col("rec_key").alias("record_id"), "rec_pos", "seq_path", F.expr("try_cast(trim(k) AS INT)").alias("k"), "label", "reason", (F.coalesce("class_result_kind", F.lit("null")) == "object").alias("has_result")).distinct()


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_records": p3_records}

_P3_CTE = """
WITH lines AS (
  SELECT DISTINCT record_id, CASE WHEN json_valid(raw_line) THEN raw_line::JSON END AS j FROM misclass_lines
), recs AS (
  SELECT record_id, 0 AS rec_pos, j AS r FROM lines WHERE json_type(j) = 'OBJECT'
  UNION ALL
  SELECT record_id, (i - 1)::INT, j->'results'->(i - 1)
  FROM (SELECT record_id, j, unnest(range(1, json_array_length(j->'results')::BIGINT + 1)) AS i FROM lines WHERE json_type(j->'results') = 'ARRAY')
), results AS (
  SELECT record_id, rec_pos, r, CASE WHEN json_type(r->'class_result') = 'VARCHAR' AND json_valid(r->>'class_result') THEN (r->>'class_result')::JSON ELSE r->'class_result' END AS c
  FROM recs
)
"""

ORACLES = {
    "p2_found": """
WITH rows AS (
  SELECT trace_id, source, epoch_us(start_time) AS a, max(epoch_us(end_time)) AS b FROM matched_queries
  WHERE trace_id IS NOT NULL AND source IS NOT NULL AND start_time IS NOT NULL AND end_time >= start_time GROUP BY 1, 2, 3
), marked AS (
  SELECT *, CASE WHEN max(b) OVER (PARTITION BY trace_id, source ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS fresh FROM rows
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY trace_id, source ORDER BY a) AS run FROM marked
), periods AS (
  SELECT trace_id, source, min(a) AS a, max(b) AS b FROM runs GROUP BY trace_id, source, run
)
SELECT trace_id, source, 'period' AS kind, a AS from_us, b AS to_us FROM periods
UNION ALL
SELECT trace_id, source, 'gap', b, nxt FROM (SELECT *, lead(a) OVER (PARTITION BY trace_id, source ORDER BY a) AS nxt FROM periods) WHERE nxt IS NOT NULL
""",
    "p3_found": _P3_CTE
    + r"""
, opts AS (
  SELECT record_id, rec_pos, 0 AS opt_pos, c->'options' AS o FROM results WHERE json_type(c->'options') = 'OBJECT'
  UNION ALL
  SELECT record_id, rec_pos, (i - 1)::INT, c->'options'->(i - 1)
  FROM (SELECT *, unnest(range(1, json_array_length(c->'options')::BIGINT + 1)) AS i FROM results WHERE json_type(c->'options') = 'ARRAY')
), flat AS (
  SELECT record_id, rec_pos, opt_pos, coalesce(o->>'name', '') AS opt_name, o->>'distance_min' AS d FROM opts WHERE json_type(o) = 'OBJECT'
  UNION ALL
  SELECT record_id, 0, (i - 1)::INT, coalesce(o.name, ''), o.distance_min
  FROM (SELECT record_id, i, class_result.options[i] AS o FROM (SELECT record_id, class_result, unnest(range(1, len(class_result.options) + 1)) AS i FROM misclassifications)) WHERE o IS NOT NULL
)
SELECT DISTINCT record_id, rec_pos, opt_pos, opt_name,
  CASE WHEN regexp_full_match(regexp_replace(d, '^\s+|\s+$', '', 'g'), '[0-9]+') THEN regexp_replace(regexp_replace(d, '^\s+|\s+$', '', 'g'), '^0+([0-9])', '\1') ELSE '' END AS distance_min
FROM flat
""",
    "p3_records": _P3_CTE
    + """
SELECT DISTINCT record_id, rec_pos, r->>'id' AS seq_path, try_cast(trim(r->>'k') AS INT) AS k, r->>'label' AS label, r->>'reason' AS reason, coalesce(json_type(c) = 'OBJECT', false) AS has_result
FROM results WHERE json_type(r) = 'OBJECT' AND r->>'id' IS NOT NULL
UNION
SELECT record_id, 0, seq_path, k, label, reason, class_result IS NOT NULL FROM misclassifications WHERE seq_path IS NOT NULL
""",
}
