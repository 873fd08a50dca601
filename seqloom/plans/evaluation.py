"""Queries over classification results: qualities, their counts, thresholds, confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import distance as D
from seqloom.operators import stats as S
from seqloom.operators.order import with_next
from seqloom.plans.sequences import LABELLED_SQL, labelled
from seqloom.session import materialize, table

KS = (1, 3, 7)
#: The values of k that cross-validation tests.
FOLD_KS = (1, 3, 5, 7)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, k, true_domain, mapped_domain, options, reason, quality of each misclassification record, once."""
    m = table(spark, sf_dir, "misclassifications").dropDuplicates(["record_id"])
    name = F.element_at(F.split("seq_path", "/"), -1)
    trace = F.regexp_replace(name, r"(\.dnstap)?(\.json)?(\.xz)?$", "")
    return m.select("record_id", "k", "reason", F.regexp_replace(trace, r"-\d+-\d+$", "").alias("true_domain"), F.col("label").alias("mapped_domain"), F.col("class_result.options").alias("options"), S.options_quality(F.col("class_result.options"), F.col("label")).alias("quality"))


def result_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("record_id", "true_domain", "quality", S.quality_name(F.col("quality")).alias("quality_name"))


def stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_cube(results(spark, sf_dir))


def stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_table(results(spark, sf_dir))


def stats_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.at_least(results(spark, sf_dir))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an option: record_id, k, label, name, votes, d (DOUBLE), least normalised distance; what is no number is left out."""
    r = results(spark, sf_dir).select("record_id", "k", "mapped_domain", F.explode("options").alias("o")).where("o IS NOT NULL")
    return r.select("record_id", "k", "mapped_domain", F.col("o.name").alias("name"), F.col("o.count").alias("votes"), F.trim("o.distance_min_norm").try_cast("decimal(20,6)").alias("norm"))


def wrong_vote_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the number of wrong votes, their mean normalised distance in whole millionths, and the nearest and farthest wrong name."""
    v = _votes(spark, sf_dir).where("name <> mapped_domain AND norm IS NOT NULL")
    pick = F.struct("norm", "name")
    return v.groupBy("mapped_domain").agg(F.sum("votes").cast("bigint").alias("votes"), F.expr("CAST(sum(norm * 1000000) AS BIGINT) div count(*)").alias("mean_millionths"), F.min(pick)["name"].alias("nearest"), F.max(pick)["name"].alias("farthest"))


def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least normalised distance of wrong votes at every 5 % of its sorted values, for each k."""
    v = _votes(spark, sf_dir).where("name <> mapped_domain")
    return S.rank_points(v.groupBy("record_id", "k").agg(F.min("norm").cast("double").alias("norm")), ["k"], "norm", list(range(0, 101, 5)))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label against the name with the most votes, the least name on a tie."""
    v = _votes(spark, sf_dir).where("name IS NOT NULL AND mapped_domain IS NOT NULL AND votes IS NOT NULL")
    best = v.groupBy("record_id", "mapped_domain").agg(F.min(F.struct((-F.col("votes")).alias("v"), "name"))["name"].alias("predicted"))
    return S.confusion(best, "mapped_domain", "predicted")


def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sequence path the k = 1 record with the greatest record_id, and whether its reason is known."""
    m = table(spark, sf_dir, "misclassifications").where("k = 1 AND seq_path IS NOT NULL")
    return m.groupBy("seq_path").agg(F.max_by(F.struct("record_id", "label", "reason"), "record_id").alias("m")).select("seq_path", "m.record_id", "m.label", F.coalesce("m.reason", F.lit("none")).alias("reason"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason occurs for each k, with the share of good qualities."""
    r = results(spark, sf_dir).where("reason IS NOT NULL")
    return r.groupBy("k", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("quality") >= 3).alias("good"), F.round(100 * F.count_if(F.col("quality") >= 3) / F.count("*"), 6).alias("percent"))


def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results that thresholds are drawn from: of k = 1 and 7, neither right nor with a known reason, and not of the labels that most wrong votes name; by k and label, with their least distance."""
    wrong = _votes(spark, sf_dir).where("name <> mapped_domain").groupBy("name").agg(F.count("*").alias("n"))
    denied = wrong.orderBy(F.desc("n"), "name").limit(5).select(F.col("name").alias("mapped_domain"))
    r = results(spark, sf_dir).where("k IN (1, 7) AND reason IS NULL").where(~S.is_good(F.col("quality"))).join(F.broadcast(denied), "mapped_domain", "left_anti")  # five rows
    least = F.array_min(F.transform("options", lambda o: F.trim(o["distance_min_norm"]).try_cast("decimal(20,6)")))
    return r.select("k", "mapped_domain", least.alias("d")).groupBy("k", "mapped_domain").agg(F.count("*").alias("n"), F.min("d").cast("double").alias("least"))


def confusion_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion matrix by the labels' numbers; `www.` names count as the name without."""
    m = confusion_matrix(spark, sf_dir).select(F.regexp_replace("mapped_domain", r"^www\.", "").alias("truth"), F.regexp_replace("predicted", r"^www\.", "").alias("predicted"), "n")
    d = S.indexed_labels(m, "truth", "predicted")
    return d.groupBy("truth_no", "predicted_no").agg(F.sum("n").alias("n"), F.min("truth").alias("truth"))


def search_set(df: DataFrame, key: str) -> DataFrame:
    """The rows that are searched for: those whose number, from the first digits of the key's MD5, is divisible by 50."""
    return df.where(F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint") % 50 == 0)


def _found(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    s = labelled(spark, sf_dir)
    rows = s.select(F.col("seq_id").alias("row_id"), F.col("mapped_domain").alias("label"), "elems")
    q = search_set(s, "seq_id")
    found = D.neighbours(q.select(F.col("seq_id").alias("query_id"), "elems"), rows, max(KS), threshold=threshold)
    return found, q.select(F.col("seq_id").alias("query_id"), F.col("mapped_domain").alias("truth"))


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[0]


def knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = _found(spark, sf_dir)
    return D.quality(D.votes(found, KS), truth, KS)


def knn_quality_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, truth = _found(spark, sf_dir, 0.5)
    return D.quality(D.votes(found, KS), truth, KS)


def cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-fold cross-validation: the sequences searched for, each against all of the other folds; for each k how many were tested, and how many of their labels were found."""
    s = materialize(D.assign_folds(labelled(spark, sf_dir).where("mapped_domain IS NOT NULL"), "mapped_domain", "seq_id"))
    q = search_set(s, "seq_id")
    found = D.neighbours(q.select(F.col("seq_id").alias("query_id"), "elems", "fold"), s.select(F.col("seq_id").alias("row_id"), F.col("mapped_domain").alias("label"), "elems", "fold"), max(FOLD_KS))
    r = D.quality(D.votes(found, FOLD_KS), q.select(F.col("seq_id").alias("query_id"), F.col("mapped_domain").alias("truth")), FOLD_KS)
    good = F.count_if(S.is_good(F.col("quality")))
    return r.groupBy("k").agg(F.count("*").alias("tested"), good.alias("good"), F.round(100 * good / F.count("*"), 6).alias("percent"), F.count_if(F.col("quality") == 6).alias("exact"))


def consecutive_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each sequence to the next one of its true_domain, with its norm."""
    from seqloom.functions.elements import normalised

    s = with_next(labelled(spark, sf_dir).where("true_domain IS NOT NULL"), ["true_domain"], [F.col("seq_id")], {"elems": "other"}).where("other IS NOT NULL")
    s = s.withColumn("distance", D.seq_distance(F.col("elems"), F.col("other")))
    return s.select("seq_id", "true_domain", "distance", F.round(normalised(F.col("distance"), F.col("elems"), F.col("other")), 9).alias("norm"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation folds: how many sequences each label has in each."""
    s = D.assign_folds(labelled(spark, sf_dir).where("mapped_domain IS NOT NULL").drop("elems"), "mapped_domain", "seq_id")
    return s.groupBy("mapped_domain", "fold").agg(F.count("*").alias("n"), F.min("seq_id").alias("first_seq"))


QUERIES = {f.__name__: f for f in (result_quality, stats_grouping_sets, stats_table, stats_at_least, wrong_vote_distances, threshold_table, confusion_matrix, confusion_indexed, threshold_candidates, latest_result, reason_counts, knn_neighbours, knn_quality, knn_quality_threshold, cross_validated, consecutive_distances, folds)}

_Q = """
m AS (SELECT DISTINCT ON (record_id) * FROM misclassifications
), o AS (SELECT *, list_filter(class_result.options, lambda x: x IS NOT NULL) AS opts, regexp_replace(regexp_replace(split_part(seq_path, '/', -1), '(\\.dnstap)?(\\.json)?(\\.xz)?$', ''), '-\\d+-\\d+$', '') AS true_domain FROM m
), s AS (SELECT *, list_filter(opts, lambda x: coalesce(x.name = label, false))[1] AS own, list_filter(opts, lambda x: NOT coalesce(x.name = label, false)) AS rest FROM o
), t AS (SELECT *, coalesce(own.count, 0) AS c, coalesce(try_cast(own.distance_min AS BIGINT), 4611686018427387904) AS d FROM s
), q AS (
  SELECT record_id, k, reason, true_domain, label AS mapped_domain, opts,
    CASE WHEN coalesce(len(opts), 0) = 0 THEN 0 WHEN own IS NULL THEN 1 WHEN len(opts) = 1 THEN 6
      WHEN 2 * c > list_sum(list_transform(opts, lambda x: coalesce(x.count, 0))) THEN 5
      WHEN len(list_filter(rest, lambda x: coalesce(x.count, 0) >= c)) = 0 THEN 4
      WHEN len(list_filter(rest, lambda x: coalesce(x.count, 0) > c OR (coalesce(x.count, 0) = c AND coalesce(try_cast(x.distance_min AS BIGINT), 4611686018427387904) <= d))) = 0 THEN 3 ELSE 2 END AS quality
  FROM t
)""".replace("\\\\", "\\")
_NAMES = "(['" + "', '".join(D.QUALITIES) + "'])[quality + 1]"
_V = ", v AS (SELECT record_id, k, mapped_domain, o.name AS name, o.count AS votes, try_cast(trim(o.distance_min_norm) AS DECIMAL(20, 6)) AS norm FROM (SELECT record_id, k, mapped_domain, unnest(opts) AS o FROM q))"

# The distance as rows of its table: one step of the recursion fills the next row of all pairs, from the left to the right.
_INS = "CASE WHEN {0} >= 0 THEN 12 ELSE -{0} - 1 END"
_SUB = f"CASE WHEN x = b[j] THEN 0 WHEN x >= 0 AND b[j] >= 0 THEN 6 WHEN x < 0 AND b[j] < 0 THEN 3 * abs(x - b[j]) ELSE {_INS.format('x')} + cb[j] END"
DISTANCES_SQL = f"""dp AS (
  SELECT a, b, cb, 0 AS i, NULL::BIGINT[] AS older, list_reduce(list_prepend([0::BIGINT], list_transform(cb, lambda c: [c])), lambda s, c: list_append(s, s[-1] + c[1])) AS filled
  FROM (SELECT DISTINCT a, b, list_transform(b, lambda y: ({_INS.format("y")})::BIGINT) AS cb FROM pairs WHERE a <> b)
  UNION ALL
  SELECT a, b, cb, i + 1, filled, list_reduce(list_prepend([filled[1] + {_INS.format("x")}], list_transform(range(1, len(b) + 1), lambda j: [least(filled[j + 1] + {_INS.format("x")}, filled[j] + {_SUB},
    CASE WHEN i > 0 AND j > 1 AND a[i] = b[j] AND x = b[j - 1] THEN older[j - 1] + CASE WHEN x = b[j] THEN 0 ELSE 3 END END), cb[j]])), lambda s, c: list_append(s, least(c[1], s[-1] + c[2])))
  FROM (SELECT *, a[i + 1] AS x FROM dp WHERE i < len(a))
), dist AS (SELECT a, b, filled[-1] AS d FROM dp WHERE i = len(a) UNION ALL SELECT DISTINCT a, b, 0 FROM pairs WHERE a = b)"""
#: s: the sequences as signed codes c.
CODED_SQL = f"WITH RECURSIVE {LABELLED_SQL}, s AS (SELECT seq_id, true_domain, mapped_domain, list_transform(e, lambda x: CASE WHEN x.k = 'S' THEN x.v ELSE -x.v - 1 END::BIGINT) AS c FROM labelled)"
#: The shorter one of a pair p, q gives the steps.
PAIR_SQL = "CASE WHEN len({0}) <= len({1}) THEN {0} ELSE {1} END AS a, CASE WHEN len({0}) <= len({1}) THEN {1} ELSE {0} END AS b"
SEARCHED_SQL = "('0x' || md5(seq_id)[1:8])::BIGINT % 50 = 0"


def _near_sql(k: int, queries: str, rows: str, apart: str, threshold: float | None = None) -> str:
    return f"""{CODED_SQL}, folded AS (SELECT *, (row_number() OVER (PARTITION BY mapped_domain ORDER BY seq_id) - 1) % 10 AS fold FROM s
), q AS (SELECT * FROM {queries} WHERE {SEARCHED_SQL}
), met AS (SELECT q.seq_id AS query_id, r.seq_id AS row_id, r.mapped_domain AS label, greatest(len(q.c), len(r.c)) AS longest, abs(len(q.c) - len(r.c)) > greatest(40, greatest(len(q.c), len(r.c)) // 5) AS far, {PAIR_SQL.format("q.c", "r.c")} FROM q JOIN {rows} r ON q.seq_id <> r.seq_id AND {apart}
), pairs AS (SELECT a, b FROM met WHERE NOT far), {DISTANCES_SQL}
, measured AS (SELECT query_id, row_id, label, coalesce(d, 9223372036854775807) AS distance, CASE WHEN d = 0 THEN 0 WHEN far THEN 999 ELSE d / longest END::DOUBLE AS norm FROM met LEFT JOIN dist USING (a, b)
), found AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, norm, label NULLS LAST, row_id))::INT AS rank, row_id, label, distance, norm FROM measured {"" if threshold is None else f"WHERE norm <= {threshold}"} QUALIFY rank <= {k})"""


def _quality_sql(ks: tuple[int, ...]) -> str:
    return f""", ks AS (SELECT unnest({list(ks)})::INT AS k
), o AS (SELECT query_id, k, label, count(*) AS n, min(distance) AS dmin FROM found, ks WHERE rank <= k GROUP BY 1, 2, 3
), j AS (SELECT q.seq_id AS query_id, ks.k, o.n, o.dmin, coalesce(o.label = q.mapped_domain, false) AS mine FROM q CROSS JOIN ks LEFT JOIN o ON o.query_id = q.seq_id AND o.k = ks.k
), g AS (SELECT query_id, k, count(n) AS labels, coalesce(sum(n), 0) AS total, max(n) FILTER (mine) AS own, max(dmin) FILTER (mine) AS own_min, coalesce(max(n) FILTER (NOT mine), 0) AS best, max((n, -dmin)) FILTER (NOT mine AND n IS NOT NULL) AS rival FROM j GROUP BY 1, 2
), quality AS (SELECT query_id, k, CASE WHEN labels = 0 THEN 0 WHEN own IS NULL THEN 1 WHEN labels = 1 THEN 6 WHEN own * 2 > total THEN 5 WHEN own > best THEN 4 WHEN rival[1] = own AND -rival[2] > own_min THEN 3 ELSE 2 END AS quality FROM g)"""


_NAMED = f"SELECT query_id, k, quality, {_NAMES} AS quality_name FROM quality"
_NEXT = f"""n AS (SELECT *, lead(c) OVER (PARTITION BY true_domain ORDER BY seq_id) AS o FROM s WHERE true_domain IS NOT NULL
), p AS (SELECT *, {PAIR_SQL.format("c", "o")} FROM n WHERE o IS NOT NULL), pairs AS (SELECT a, b FROM p), {DISTANCES_SQL}"""

ORACLES = {
    "knn_neighbours": f"{_near_sql(max(KS), 's', 's', 'true')} SELECT * FROM found",
    "knn_quality": f"{_near_sql(max(KS), 's', 's', 'true')}{_quality_sql(KS)} {_NAMED}",
    "knn_quality_threshold": f"{_near_sql(max(KS), 's', 's', 'true', 0.5)}{_quality_sql(KS)} {_NAMED}",
    "cross_validated": f"{_near_sql(max(FOLD_KS), '(SELECT * FROM folded WHERE mapped_domain IS NOT NULL)', '(SELECT * FROM folded WHERE mapped_domain IS NOT NULL)', 'q.fold <> r.fold')}{_quality_sql(FOLD_KS)} SELECT k, count(*) AS tested, count(*) FILTER (quality >= 3) AS good, round(100 * count(*) FILTER (quality >= 3) / count(*), 6) AS percent, count(*) FILTER (quality = 6) AS exact FROM quality GROUP BY 1",
    "consecutive_distances": f"{CODED_SQL}, {_NEXT} SELECT seq_id, true_domain, d AS distance, CASE WHEN d = 0 THEN 0 ELSE round(d / len(b), 9) END::DOUBLE AS norm FROM p JOIN dist USING (a, b)",
    "result_quality": f"WITH {_Q} SELECT record_id, true_domain, quality, {_NAMES} AS quality_name FROM q",
    "stats_grouping_sets": f"""
WITH {_Q}, g AS (SELECT k, quality, reason IS NOT NULL AS has_reason, true_domain, mapped_domain, count(*) AS n, grouping(true_domain) AS gt, grouping(mapped_domain) AS gm FROM q
  GROUP BY GROUPING SETS ((k, quality, has_reason, true_domain), (k, quality, has_reason, mapped_domain), (k, quality, has_reason)))
SELECT CASE WHEN gt = 0 THEN 'true' WHEN gm = 0 THEN 'mapped' ELSE 'all' END AS level, k, CASE WHEN gt = 0 THEN true_domain WHEN gm = 0 THEN mapped_domain END AS domain, quality, has_reason, n FROM g
""",
    "stats_table": f"WITH {_Q} SELECT k, true_domain, " + ", ".join(f"count(*) FILTER (quality = {i} AND reason IS {'NOT ' if w else ''}NULL) AS \"{n}{w}\"" for i, n in enumerate(D.QUALITIES) for w in ("", "_w_reason")) + ", count(reason) AS reasons FROM q GROUP BY k, true_domain",
    "stats_at_least": f"""
WITH {_Q}, p AS (SELECT k, true_domain, t AS quality, count(*) FILTER (q.quality >= t) AS n FROM q, range(7) r(t) WHERE true_domain IS NOT NULL GROUP BY 1, 2, 3
), c AS (SELECT k, quality, n, count(*) AS c FROM p GROUP BY 1, 2, 3)
SELECT k, quality::INT AS quality, n, (sum(c) OVER (PARTITION BY k, quality ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS domains FROM c
""",
    "wrong_vote_distances": f"WITH {_Q}{_V} SELECT mapped_domain, sum(votes)::BIGINT AS votes, sum(norm * 1000000)::BIGINT // count(*) AS mean_millionths, arg_min(name, (norm, name)) AS nearest, arg_max(name, (norm, name)) AS farthest FROM v WHERE name <> mapped_domain AND norm IS NOT NULL GROUP BY 1",
    "threshold_table": f"""
WITH {_Q}{_V}, w AS (SELECT record_id, k, min(norm)::DOUBLE AS norm FROM v WHERE name <> mapped_domain GROUP BY 1, 2
), r AS (SELECT k, norm, row_number() OVER (PARTITION BY k ORDER BY norm) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM w WHERE norm IS NOT NULL)
SELECT k, p::INT AS percent, norm FROM r, range(0, 101, 5) t(p) WHERE i = least(n * p // 100, n - 1)
""",
    "confusion_matrix": f"""
WITH {_Q}{_V}, b AS (SELECT record_id, mapped_domain, arg_min(name, (-votes, name)) AS predicted FROM v WHERE name IS NOT NULL AND mapped_domain IS NOT NULL AND votes IS NOT NULL GROUP BY 1, 2
), c AS (SELECT mapped_domain, predicted, count(*) AS n FROM b GROUP BY 1, 2)
SELECT *, round(100 * n / sum(n) OVER (PARTITION BY mapped_domain), 6) AS percent FROM c
""",
    "threshold_candidates": f"""
WITH {_Q}{_V}, w AS (SELECT name FROM v WHERE name <> mapped_domain GROUP BY 1 ORDER BY count(*) DESC, name LIMIT 5
), r AS (SELECT k, mapped_domain, list_min(list_transform(opts, lambda o: try_cast(trim(o.distance_min_norm) AS DECIMAL(20, 6)))) AS d FROM q WHERE k IN (1, 7) AND reason IS NULL AND quality < 3 AND (mapped_domain IS NULL OR mapped_domain NOT IN (SELECT name FROM w)))
SELECT k, mapped_domain, count(*) AS n, min(d)::DOUBLE AS least FROM r GROUP BY 1, 2
""",
    "confusion_indexed": f"""
WITH {_Q}{_V}, b AS (SELECT record_id, mapped_domain, arg_min(name, (-votes, name)) AS predicted FROM v WHERE name IS NOT NULL AND mapped_domain IS NOT NULL AND votes IS NOT NULL GROUP BY 1, 2
), c AS (SELECT regexp_replace(mapped_domain, '^www\\.', '') AS truth, regexp_replace(predicted, '^www\\.', '') AS predicted FROM b
), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS no FROM (SELECT truth AS label FROM c UNION SELECT predicted FROM c))
SELECT a.no AS truth_no, b.no AS predicted_no, count(*) AS n, min(truth) AS truth FROM c JOIN n a ON a.label = truth JOIN n b ON b.label = c.predicted GROUP BY 1, 2
""",
    "latest_result": "SELECT seq_path, max(record_id) AS record_id, arg_max(label, record_id) AS label, coalesce(arg_max_null(reason, record_id), 'none') AS reason FROM misclassifications WHERE k = 1 AND seq_path IS NOT NULL GROUP BY seq_path",
    "reason_counts": f"WITH {_Q} SELECT k, reason, count(*) AS n, count(*) FILTER (quality >= 3) AS good, round(100 * count(*) FILTER (quality >= 3) / count(*), 6) AS percent FROM q WHERE reason IS NOT NULL GROUP BY 1, 2",
    "folds": """
WITH s AS (SELECT DISTINCT ON (seq_id) seq_id, mapped_domain FROM labelled_sequences WHERE seq_id IS NOT NULL AND codes IS NOT NULL
), f AS (SELECT *, ((row_number() OVER (PARTITION BY mapped_domain ORDER BY seq_id) - 1) % 10)::INT AS fold FROM s WHERE mapped_domain IS NOT NULL)
SELECT mapped_domain, fold, count(*) AS n, min(seq_id) AS first_seq FROM f GROUP BY 1, 2
""",
}
