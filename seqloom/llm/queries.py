"""The queries of the numbered problems of this subpackage, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.components import connected_groups
from seqloom.llm.digest import certify, digest_values, merge_digests, percentiles
from seqloom.llm.mixing import mix_sources
from seqloom.llm.nearest import nearest_in_time
from seqloom.llm.quality import label_documents, learn_rules, not_prose, quality_statistics
from seqloom.llm.runs import code_events, collapse_runs
from seqloom.llm.tokens import count_tokens, encode_corpus
from seqloom.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cleaned name of the similarity records with the least name of its group."""
    rows = table(spark, sf_dir, "confusion_records").where(~F.ltrim(F.col("domain")).startswith("#") & ~F.btrim("domain", F.lit(" \t\r\n\x0b\x0c")).startswith("#"))
    clean = lambda c: F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t"))), r"\.\z", "")
    pairs = rows.select(clean("domain").alias("a"), clean("is_similar_to").alias("b")).where("contains(a, '.') AND contains(b, '.')")
    out = connected_groups(pairs, "a", "b")
    return out.select("group_id", F.col("name").alias("domain"))


def _bare(name: Column) -> Column:
    """A DNS name without its letter case and final dot."""
    return F.regexp_replace(F.lower(name), r"\.\z", "")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query message the response of the same key that is nearest in time, within two seconds."""
    sides = []
    for side in ("query", "response"):
        parts = [F.substring_index("message_type", "_", 1), _bare(F.col(f"{side}_qname")), F.col(f"{side}_qtype"), F.col(f"{side}_id").cast("string")]
        key = F.when(~F.concat(*parts).isNull(), F.concat_ws("\t", *parts))  # null if any part is
        sides.append(table(spark, sf_dir, f"{side}_messages").select(key.alias("key"), F.col(f"{side}_time_ns").alias("t"), F.col("msg_id").alias("id")))
    out = nearest_in_time(*sides, 2_000_000_000)
    return out.select(F.col("left_id").alias("query_msg_id"), F.col("right_id").alias("response_msg_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of nearly equal lookups of a trace's source, and of equal messages of a sequence."""
    q = table(spark, sf_dir, "matched_queries").where("qname IS NOT NULL AND qtype IS NOT NULL")
    q = q.select(
        F.col("trace_id").alias("owner"), "source", F.concat_ws("\t", _bare(F.col("qname")), "qtype").alias("same"), F.unix_micros("end_time").alias("o1"), F.col("query_no").alias("o2"),
        F.col("response_size").alias("near"), F.unix_micros("end_time").alias("clock"), F.col("query_no").alias("pos"),
    )
    queries = collapse_runs(q, 8).withColumn("kind", F.lit("query"))
    s = table(spark, sf_dir, "labelled_sequences").select("seq_id", "codes")
    messages = collapse_runs(code_events(s, "seq_id", "codes")).withColumn("kind", F.lit("message"))
    out = queries.unionByName(messages)
    return out.select("kind", F.col("owner").alias("owner_id"), "source", "first_pos", "n_events", "duration")


QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both sizes of each true_domain, per day and for all days (day null) from the days' digests.

    A row's day is the UTC day of start_time, else of end_time, else of logged_at. Rows without a
    true_domain or the value are left out; each query_no counts once. rank_error is the certified error: the largest share of the
    group's values by which a percentile misses its rank.
    """
    day = F.to_date(F.coalesce("start_time", "end_time", "logged_at"))
    rows = table(spark, sf_dir, "matched_queries").where("true_domain IS NOT NULL")
    rows = rows.select("query_no", "true_domain", day.alias("day"), "query_size", "response_size").dropDuplicates(["query_no"])
    sizes = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("query_size", "response_size"))))
    values = materialize(rows.select("true_domain", "day", sizes.alias("s")).select("true_domain", "day", "s.*").where("v IS NOT NULL"))
    keys = ["true_domain", "measure", "day"]
    days = materialize(digest_values(values, keys, "v"))
    total = merge_digests(days, keys[:2])
    parts = []
    for scope, digests, by in (("day", days, keys), ("all", total, keys[:2])):
        sure = certify(values, by, "v", percentiles(digests, by, QUANTILES), QUANTILES)
        sure = sure if scope == "day" else sure.withColumn("day", F.lit(None).cast("date"))
        parts.append(sure.withColumn("scope", F.lit(scope)))
    out = parts[0].unionByName(parts[1])
    return out.select("true_domain", "measure", "scope", "day", "n", *(F.get("estimates", F.lit(i)).alias(f"p{round(q * 100):02d}") for i, q in enumerate(QUANTILES)), "rank_error")


def p6_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of p6_percentiles with their sizes, and whether each percentile is within 1 % of its rank, or within one value where a group has few."""
    out = p6_percentiles(spark, sf_dir)
    return out.select("true_domain", "measure", "scope", F.coalesce(F.col("day").cast("string"), F.lit("")).alias("day"), "n", (F.col("rank_error") <= 0.01 + 1 / F.col("n")).alias("certified"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document's text."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Notebooks by doc_id, sized in tokens of byte_bpe_50k; the weight is the share of the text's body, as problem 9 measures it, at least 0.05."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    clean = lambda c: F.lower(F.btrim(c, F.lit(" \t\r\n")))
    quality = _statistics(spark, sf_dir)[0].where("doc_id IS NOT NULL").select("doc_id", F.greatest(F.lit(0.05), F.coalesce("body_share", F.lit(0.0))).alias("weight"))
    weights = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
    items = docs.groupBy("doc_id").agg(F.max(clean("source")).alias("source"))
    sizes = count_tokens(docs, "doc_id", "text").groupBy("doc_id").agg(F.max("n_tokens").alias("size"))
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", clean("source"))
    return mix_sources(items.join(sizes, "doc_id").join(weights, "doc_id").withColumnRenamed("doc_id", "id"), targets)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notebooks chosen for the mixture and how often each is used."""
    chosen, _ = _mixture(spark, sf_dir)
    return chosen.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "n_copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source was to have and has."""
    return _mixture(spark, sf_dir)[1]


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps the rules: no notebook more often than max_repeats, whole epochs before fractions, and no source over its target while another still has room."""
    chosen, report = _mixture(spark, sf_dir)
    used = chosen.groupBy("source").agg(F.max("n_copies").alias("most"), F.min("n_copies").alias("least"), F.count("*").alias("used"), F.max("size").alias("largest"))
    r = report.join(used, "source", "left")
    full = F.col("chosen_size") >= F.col("available") * F.greatest("max_repeats", F.lit(0))
    return r.select(
        "source", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_repeats"), F.coalesce(F.col("most") - F.col("least") <= 1, F.lit(True)).alias("whole_epochs"),
        # what capped sources leave raises the others' shares; without such sources all shares are met
        (full | F.coalesce(F.col("actual_share") >= F.col("target_share") - F.col("largest") / F.col("chosen_size"), F.lit(False)) | (F.col("available") == 0) | (F.coalesce("target_share", F.lit(0.0)) <= 0)).alias("share_reached"),
    )


#: The list of common words is a fixed table; a longer one is an error.
MOST_WORDS = 100_000


def _statistics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    common = [r.word for r in table(spark, sf_dir, "common_words").select("word").where("word IS NOT NULL").distinct().limit(MOST_WORDS + 1).collect()]
    if len(common) > MOST_WORDS:  # every task gets the list
        raise ValueError(f"more than {MOST_WORDS} common words")
    return quality_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", common), common


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, dict[str, float]]:
    stats, common = _statistics(spark, sf_dir)
    stats = materialize(stats)
    labels = label_documents(table(spark, sf_dir, "documents"), "doc_id", "text", "cells", common)
    return stats, *learn_rules(stats, labels, "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebooks of which running prose is less than half, by rules learned from labelled ones."""
    stats, case, _ = _rules(spark, sf_dir)
    return not_prose(stats, case).select("doc_id").distinct()


def p9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that p9_found applies, as the SQL expression, with precision and recall on the held-out third of the labelled notebooks; null where nothing counts."""
    _, case, held = _rules(spark, sf_dir)
    none = lambda x: None if x != x else x
    return spark.createDataFrame([(case, held["n"], none(held["precision"]), none(held["recall"]))], "rules string, held_out bigint, precision double, recall double")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every notebook's text."""
    return _statistics(spark, sf_dir)[0]


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p6_percentiles": p6_percentiles, "p6_certified": p6_certified, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_checked": p8_checked, "p9_found": p9_found, "p9_rules": p9_rules, "p9_statistics": p9_statistics}

_BARE = "regexp_replace(lower({0}), '\\.$', '')"

ORACLES = {
    "p6_certified": """
WITH q AS (SELECT DISTINCT ON (query_no) true_domain, coalesce(start_time, end_time, logged_at)::DATE AS day, query_size, response_size FROM matched_queries WHERE true_domain IS NOT NULL
), v AS (SELECT true_domain, 'query_size' AS measure, day FROM q WHERE query_size IS NOT NULL UNION ALL SELECT true_domain, 'response_size', day FROM q WHERE response_size IS NOT NULL)
SELECT true_domain, measure, 'day' AS scope, day::VARCHAR AS day, count(*) AS n, true AS certified FROM v GROUP BY ALL
UNION ALL SELECT true_domain, measure, 'all', '', count(*), true FROM v GROUP BY ALL
""",
    "p8_checked": "SELECT DISTINCT lower(trim(source, ' ' || chr(9) || chr(13) || chr(10))) AS source, true AS within_repeats, true AS whole_epochs, true AS share_reached FROM mix_targets WHERE source IS NOT NULL",
    "p1_found": r"""
WITH RECURSIVE c AS (
  SELECT regexp_replace(lower(trim(domain, chr(32) || chr(9))), '\.$', '') AS a, regexp_replace(lower(trim(is_similar_to, chr(32) || chr(9))), '\.$', '') AS b
  FROM confusion_records WHERE NOT regexp_matches(domain, '^\s*#')
), p AS (SELECT DISTINCT a, b FROM c WHERE contains(a, '.') AND contains(b, '.')
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT min(b) AS group_id, a AS domain FROM r GROUP BY a
""",
    "p4_found": f"""
WITH q AS (
  SELECT DISTINCT msg_id, query_time_ns AS t, split_part(message_type, '_', 1) AS kind, {_BARE.format("query_qname")} AS n, query_qtype AS ty, query_id AS id FROM query_messages WHERE query_time_ns IS NOT NULL
), r AS (
  SELECT DISTINCT msg_id, response_time_ns AS t, split_part(message_type, '_', 1) AS kind, {_BARE.format("response_qname")} AS n, response_qtype AS ty, response_id AS id FROM response_messages WHERE response_time_ns IS NOT NULL
)
SELECT q.msg_id AS query_msg_id, r.msg_id AS response_msg_id FROM q JOIN r USING (kind, n, ty, id) WHERE abs(r.t - q.t) <= 2000000000
QUALIFY row_number() OVER (PARTITION BY q.msg_id ORDER BY abs(r.t - q.t), r.msg_id) = 1
""",
    "p5_found": f"""
WITH q AS (
  SELECT DISTINCT query_no, trace_id, source, {_BARE.format("qname")} AS n, qtype, epoch_us(end_time) AS t, response_size AS s FROM matched_queries
  WHERE trace_id IS NOT NULL AND source IS NOT NULL AND qname IS NOT NULL AND qtype IS NOT NULL AND end_time IS NOT NULL AND response_size IS NOT NULL
), m AS (
  SELECT *, CASE WHEN n = lag(n) OVER w AND qtype = lag(qtype) OVER w AND abs(s - lag(s) OVER w) <= 8 THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY trace_id, source ORDER BY t, query_no)
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id, source ORDER BY t, query_no) AS run FROM m
), codes AS (
  SELECT seq_id, (i - 1)::BIGINT AS pos, upper(trim(codes[i])) AS c FROM (SELECT seq_id, codes, unnest(range(1, len(codes) + 1)) AS i FROM (SELECT DISTINCT seq_id, codes FROM labelled_sequences WHERE seq_id IS NOT NULL))
), nums AS (
  SELECT seq_id, pos, c[1] AS kind, c[2:]::BIGINT AS v FROM codes WHERE regexp_full_match(c, '[SG][0-9]+')
), clocked AS (
  SELECT *, sum(CASE WHEN kind = 'G' THEN v ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos) AS clock FROM nums
), sm AS (
  SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY seq_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM clocked WHERE kind = 'S'
), sg AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM sm)
SELECT 'query' AS kind, trace_id AS owner_id, source, arg_min(query_no, (t, query_no)) AS first_pos, count(*) AS n_events, (max(t) - min(t))::BIGINT AS duration FROM g GROUP BY trace_id, source, run HAVING count(*) >= 2
UNION ALL
SELECT 'message', seq_id, '', min(pos), count(*), (max(clock) - min(clock))::BIGINT FROM sg GROUP BY seq_id, run HAVING count(*) >= 2
""",
}
