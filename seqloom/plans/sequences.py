"""Queries that build sequences and describe them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import elements as E
from seqloom.operators.order import with_next
from seqloom.operators.sequences import build_sequences, training_rows
from seqloom.session import table

TEXT = lambda c: F.array_join(E.codes(c), " ")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forwarder's lookups of each trace, once each."""
    rows = table(spark, sf_dir, "matched_queries").where("source = 'Forwarder'")
    return rows.select("trace_id", "true_domain", "query_no", F.unix_micros("end_time").alias("t"), "response_size").dropDuplicates(["query_no"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, true_domain, mapped_domain, elems of the labelled sequences, once each; null and unreadable codes left out."""
    rows = table(spark, sf_dir, "labelled_sequences").where("seq_id IS NOT NULL AND codes IS NOT NULL")
    # the table is small, so that reading it takes few tasks: codes are parsed after the exchange, by as many as there are
    rows = rows.select("seq_id", "true_domain", "mapped_domain", "codes").dropDuplicates(["seq_id"])
    return rows.select("seq_id", "true_domain", "mapped_domain", E.parse_codes(F.array_compact("codes")).alias("elems"))


def _build(**options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build_sequences(traces(spark, sf_dir), "trace_id", "t", "response_size", "query_no", **options)
        return out.select("trace_id", TEXT(F.col("elems")).alias("sequence"))

    return query


def seq_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = labelled(spark, sf_dir)
    e = F.col("elems")
    return s.select("seq_id", TEXT(e).alias("sequence"), E.length(e).alias("n"), E.message_count(e).alias("messages"), E.complexity(e).cast("bigint").alias("complexity"), E.reason(e).alias("reason"), TEXT(E.abstract(e)).alias("abstract"))


def seq_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("elems")
    pairs = F.array_join(F.transform(E.vectors(e), lambda v: F.array_join(v.cast("array<string>"), ":")), " ")
    hot = F.array_join(F.flatten(E.one_hot(e)).cast("array<string>"), "")
    return labelled(spark, sf_dir).select("seq_id", pairs.alias("vectors"), hot.alias("one_hot"))


def seq_tail_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence against the next one of its true_domain, by the constant-rate distance and the costs of the first elements."""
    s = with_next(labelled(spark, sf_dir).where("true_domain IS NOT NULL"), ["true_domain"], [F.col("seq_id")], {"elems": "other"}).where("other IS NOT NULL")
    a, b = F.get("elems", F.lit(0)), F.get("other", F.lit(0))
    return s.select("seq_id", E.tail_distance(F.col("elems"), F.col("other")).cast("bigint").alias("tail_distance"), E.substitute_cost(a, b).cast("bigint").alias("substitute"), E.insert_cost(a).cast("bigint").alias("inserted"))


#: The length that training rows are filled up to, and the first shard for validation.
ROW_LENGTH, FIRST_VALIDATION = 24, 8


def seq_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as rows for training: padded vectors as text, the label's number, and whether they are for validation, by the last digit of their run."""
    shard = F.regexp_extract("seq_id", r"(\d)-\d+$", 1).try_cast("int")
    d = training_rows(labelled(spark, sf_dir).withColumn("shard", shard), "mapped_domain", "shard", FIRST_VALIDATION, length=ROW_LENGTH)
    return d.select("seq_id", F.array_join(F.transform("vectors", lambda v: F.array_join(v.cast("array<string>"), ":")), " ").alias("vectors"), "label_no", "is_validation")


def ngram_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each sequence the mean corpus-wide probability of its elements, pairs and triples."""
    s = labelled(spark, sf_dir)

    def named(n: int):
        return F.transform(E.ngrams(F.col("elems"), n), lambda g: F.struct(F.lit(n).alias("n"), F.array_join(E.codes(g), " ").alias("gram")))

    grams = F.explode(F.flatten(F.array(*map(named, (1, 2, 3)))))
    rows = s.select("seq_id", grams.alias("g")).groupBy("seq_id", "g.n", "g.gram").agg(F.count("*").alias("c"))
    freq = rows.groupBy("n", "gram").agg(F.sum("c").alias("f"))
    total = freq.groupBy("n").agg(F.sum("f").alias("total"))
    p = rows.join(freq, ["n", "gram"]).join(F.broadcast(total), "n")  # three rows
    mean = lambda n: F.round(F.sum(F.when(F.col("n") == n, F.col("c") * F.col("f") / F.col("total"))) / F.sum(F.when(F.col("n") == n, F.col("c"))), 9)
    return p.groupBy("seq_id").agg(*(mean(n).alias(f"p{n}") for n in (1, 2, 3)))


def pad_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overhead of padding queries to 128 and responses to 468 bytes, by source."""
    rows = table(spark, sf_dir, "matched_queries").select("query_no", "source", "query_size", "response_size").dropDuplicates(["query_no"])
    q, r = E.block_padding(F.col("query_size"), 128), E.block_padding(F.col("response_size"), 468)
    sums = [F.sum(x).cast("bigint").alias(n) for n, x in (("queries", F.col("query_size")), ("padded_queries", q), ("responses", F.col("response_size")), ("padded_responses", r))]
    return rows.groupBy("source").agg(*sums)


QUERIES = {
    "seq_build_log2": _build(), "seq_build_ident": _build(mode="ident"), "seq_perfect_padding": _build(simulate="perfect_padding"), "seq_perfect_timing": _build(simulate="perfect_timing"), "seq_build_wide_gap": _build(base_us=50_000),
    "seq_features": seq_features, "seq_vectors": seq_vectors, "seq_training_rows": seq_training_rows, "seq_tail_distance": seq_tail_distance, "ngram_probability": ngram_probability, "pad_sizes": pad_sizes,
}


def sequence_sql(events: str, key: str, base: int = 1000, mode: str = "log2", simulate: str = "none") -> str:
    """The rest of a WITH clause, behind a table of events (key, query_no, t, s), and the query for the sequences of each key."""
    value = "length(bin(n)) - 1" if mode == "log2" else "n % 65536"
    gap = "CASE WHEN gap IS NULL THEN NULL ELSE printf('G%02d', coalesce(v, 0)) END" if simulate == "perfect_padding" else "printf('G%02d', v)"
    size = "printf('S%02d', ((s + 467) // 468) % 256)"
    part = {"none": f"concat_ws(' ', CASE WHEN v IS NOT NULL THEN {gap} END, {size})", "perfect_padding": gap, "perfect_timing": size}[simulate]
    return f""", g AS (SELECT *, t - lag(t) OVER (PARTITION BY {key} ORDER BY t, query_no) AS gap FROM {events}
), n AS (SELECT *, CASE WHEN gap > {base} THEN (gap + {base - 1}) // {base} - 1 END AS n FROM g
), v AS (SELECT *, nullif({value}, 0)::INT AS v FROM n
), p AS (SELECT {key}, string_agg({part}, ' ' ORDER BY t, query_no) AS sequence FROM v GROUP BY 1)
SELECT * FROM p WHERE sequence IS NOT NULL AND sequence <> ''
"""


def _build_sql(base: int = 1000, mode: str = "log2", simulate: str = "none") -> str:
    return f"""
WITH e AS (SELECT DISTINCT trace_id, query_no, epoch_us(end_time) AS t, response_size AS s FROM matched_queries WHERE source = 'Forwarder' AND trace_id IS NOT NULL AND end_time IS NOT NULL AND response_size >= 1)
{sequence_sql("e", "trace_id", base, mode, simulate)}"""


LABELLED_SQL = r"""
raw AS (SELECT DISTINCT ON (seq_id) seq_id, true_domain, mapped_domain, list_transform(list_filter(codes, lambda c: c IS NOT NULL), lambda c: upper(trim(c))) AS c FROM labelled_sequences WHERE seq_id IS NOT NULL AND codes IS NOT NULL
), labelled AS (
  SELECT seq_id, true_domain, mapped_domain, list_transform(list_filter(c, lambda x: regexp_full_match(x, '[SG][0-9]{1,18}') AND TRY_CAST(x[2:] AS BIGINT) <= CASE WHEN x[1] = 'S' THEN 255 ELSE 65535 END), lambda x: {'k': x[1], 'v': x[2:]::INT}) AS e FROM raw
)"""
_TXT = "array_to_string(list_transform({0}, lambda x: printf('%s%02d', x.k, x.v)), ' ')"
_REASONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.SHAPE_REASONS.items())
_SINGLES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.SINGLE_SIZE_REASONS.items())
_SUM = "coalesce(list_sum(list_transform({0}, lambda x: CASE WHEN x.k = 'S' THEN 12 ELSE x.v END)), 0)::BIGINT"

ORACLES = {
    "seq_build_log2": _build_sql(), "seq_build_ident": _build_sql(mode="ident"), "seq_perfect_padding": _build_sql(simulate="perfect_padding"), "seq_perfect_timing": _build_sql(simulate="perfect_timing"), "seq_build_wide_gap": _build_sql(base=50_000),
    "seq_features": f"""
WITH {LABELLED_SQL}
SELECT seq_id, {_TXT.format("e")} AS sequence, len(e)::INT AS n, len(list_filter(e, lambda x: x.k = 'S'))::INT AS messages, coalesce(list_sum(list_transform(list_filter(e, lambda x: x.k = 'S'), lambda x: x.v)), 0)::BIGINT AS complexity,
  CASE array_to_string(list_transform(e, lambda x: x.k), '') WHEN 'S' THEN CASE e[1].v {_SINGLES} ELSE '{E.SINGLE_SIZE_OTHER}' END {_REASONS} END AS reason,
  {_TXT.format("list_transform(e, lambda y: {'k': y.k, 'v': CASE WHEN y.k = 'S' THEN y.v ELSE 0 END})")} AS abstract
FROM labelled
""",
    "seq_vectors": f"""
WITH {LABELLED_SQL}
SELECT seq_id, array_to_string(list_transform(e, lambda x: CASE WHEN x.k = 'S' THEN x.v || ':0' ELSE '0:' || x.v END), ' ') AS vectors,
  CASE WHEN len(list_filter(e, lambda x: x.k = 'S' AND x.v >= 16)) = 0 THEN array_to_string(list_transform(e, lambda x: CASE WHEN x.k = 'G' THEN x.v || repeat('0', 15) ELSE repeat('0', x.v) || '1' || repeat('0', 15 - x.v) END), '') END AS one_hot
FROM labelled
""",
    "seq_training_rows": rf"""
WITH {LABELLED_SQL}, d AS (SELECT *, try_cast(regexp_extract(seq_id, '(\d)-\d+$', 1) AS INT) AS shard FROM labelled WHERE mapped_domain IS NOT NULL
), n AS (SELECT mapped_domain, row_number() OVER (ORDER BY mapped_domain) - 1 AS label_no FROM (SELECT DISTINCT mapped_domain FROM d WHERE shard IS NOT NULL))
SELECT seq_id, array_to_string(list_transform(range(1, {ROW_LENGTH + 1}), lambda i: CASE WHEN i > len(e) THEN '0:0' WHEN e[i].k = 'S' THEN e[i].v || ':0' ELSE '0:' || e[i].v END), ' ') AS vectors, label_no, shard >= {FIRST_VALIDATION} AS is_validation FROM d JOIN n USING (mapped_domain) WHERE shard IS NOT NULL
""",
    "seq_tail_distance": f"""
WITH {LABELLED_SQL}, p AS (SELECT seq_id, e, lead(e) OVER (PARTITION BY true_domain ORDER BY seq_id) AS o FROM labelled WHERE true_domain IS NOT NULL)
SELECT seq_id, CASE WHEN len(e) >= len(o) THEN {_SUM.format("e[len(o) + 1:]")} ELSE {_SUM.format("o[len(e) + 1:]")} END AS tail_distance,
  (CASE WHEN e[1] = o[1] THEN 0 WHEN e[1].k = 'S' AND o[1].k = 'S' THEN 6 WHEN e[1].k = 'G' AND o[1].k = 'G' THEN 3 * abs(e[1].v - o[1].v)
    ELSE CASE WHEN e[1].k = 'S' THEN 12 ELSE e[1].v END + CASE WHEN o[1].k = 'S' THEN 12 ELSE o[1].v END END)::BIGINT AS substitute,
  (CASE WHEN e[1].k = 'S' THEN 12 ELSE e[1].v END)::BIGINT AS inserted
FROM p WHERE o IS NOT NULL
""",
    "ngram_probability": f"""
WITH {LABELLED_SQL}, t AS (SELECT seq_id, list_transform(e, lambda x: printf('%s%02d', x.k, x.v)) AS c FROM labelled
), g AS (SELECT seq_id, n, array_to_string(c[i:i + n - 1], ' ') AS gram FROM (SELECT seq_id, c, n, unnest(range(1, len(c) - n + 2)) AS i FROM t, (VALUES (1), (2), (3)) v(n))
), f AS (SELECT n, gram, count(*) AS f, sum(count(*)) OVER (PARTITION BY n) AS total FROM g GROUP BY n, gram)
SELECT seq_id, round(avg(f / total) FILTER (n = 1), 9) AS p1, round(avg(f / total) FILTER (n = 2), 9) AS p2, round(avg(f / total) FILTER (n = 3), 9) AS p3 FROM g JOIN f USING (n, gram) GROUP BY seq_id
""",
    "pad_sizes": """
SELECT source, sum(query_size)::BIGINT AS queries, sum((query_size + 127) // 128 * 128)::BIGINT AS padded_queries, sum(response_size)::BIGINT AS responses, sum((response_size + 467) // 468 * 468)::BIGINT AS padded_responses
FROM (SELECT DISTINCT query_no, source, query_size, response_size FROM matched_queries) GROUP BY source
""",
}
