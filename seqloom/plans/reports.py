"""Reports over results, sequences and graphs: suffixes, measures, runs, groups, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import elements as E
from seqloom.functions import names as N
from seqloom.operators import distance as D
from seqloom.operators import graph as G
from seqloom.operators import order as O
from seqloom.operators import stats as S
from seqloom.plans.evaluation import _Q, CODED_SQL, DISTANCES_SQL, PAIR_SQL, SEARCHED_SQL, consecutive_distances, results, search_set, stats_at_least
from seqloom.plans.evaluation import ORACLES as EVALUATION_SQL
from seqloom.plans.names import ORACLES as NAMES_SQL
from seqloom.plans.names import _lookup_graph
from seqloom.plans.sequences import LABELLED_SQL, labelled
from seqloom.plans.timeline import _L, lookups
from seqloom.session import materialize, table

#: Groups with at most so many results are left out of the report by suffix.
LEAST_RESULTS = 5


def suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities by k and public suffix of the true domain; a suffix is what lies above a trace's domain, or the last label."""
    known = lookups(spark, sf_dir).where("true_domain LIKE '%.%'").select(N.parent(F.lower("true_domain")).alias("suffix"))
    r = results(spark, sf_dir).where("true_domain IS NOT NULL").select("k", F.lower("true_domain").alias("true_domain"), "quality", "reason")
    # counts by domain first, so that the join carries one row a domain
    good = S.is_good(F.col("quality"))
    c = r.groupBy("k", "true_domain").agg(F.count_if(good).alias("good"), F.count_if(good & F.col("reason").isNotNull()).alias("good_w_reason"), F.count_if(~good).alias("bad"), F.count_if(~good & F.col("reason").isNotNull()).alias("bad_w_reason"), F.count("*").alias("total"))
    s = N.public_suffix(c, "true_domain", known)
    g = c.join(s, "true_domain").groupBy("k", "suffix").agg(*(F.sum(n).alias(n) for n in ("good", "good_w_reason", "bad", "bad_w_reason", "total")))
    return g.where(F.col("total") > LEAST_RESULTS).withColumn("sort_key", F.array_join(N.reversed_labels(F.col("suffix")), "."))


def quality_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many good and bad results there are at each value of each measure of their sequences; without a sequence a measure is 0."""
    e = F.col("elems")
    s = labelled(spark, sf_dir).select(F.col("seq_id").alias("stem"), E.length(e).alias("length"), E.message_count(e).alias("messages"), E.complexity(e).alias("complexity"))
    m = table(spark, sf_dir, "misclassifications").dropDuplicates(["record_id"]).select("record_id", N.stem(F.col("seq_path")).alias("stem"))
    d = results(spark, sf_dir).select("record_id", S.is_good(F.col("quality")).alias("good")).join(m, "record_id").join(s, "stem", "left")
    d = d.unpivot(["record_id", "good"], ["length", "messages", "complexity"], "measure", "value")
    return d.groupBy("measure", F.coalesce("value", F.lit(0)).alias("value")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def set_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each quality in the first two sets of captures: their mean, and half of what they differ by."""
    name = F.regexp_extract("seq_path", r"/(set[01])/", 1)
    m = table(spark, sf_dir, "misclassifications").dropDuplicates(["record_id"]).select("record_id", name.alias("set_name")).where("set_name <> ''")
    r = results(spark, sf_dir).where("k = 1").select("record_id", "quality").join(m, "record_id")
    c = r.groupBy("set_name", "quality").agg(F.count("*").alias("n"))
    p = c.withColumn("p", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("set_name")))
    both = [F.coalesce(F.max(F.when(F.col("set_name") == s, F.col("p"))), F.lit(0.0)) for s in ("set0", "set1")]
    g = p.groupBy("quality").agg(both[0].alias("a"), both[1].alias("b"))
    return g.select(S.readable_quality(S.quality_name(F.col("quality"))).alias("quality"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("mean"), F.round(F.abs(F.col("a") - F.col("b")) / 2, 6).alias("half_range"))


def at_least_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quality and number of results the domains that have so many, as one series over the values of k."""
    d = stats_at_least(spark, sf_dir).groupBy("quality", "n").agg(F.sort_array(F.collect_list(F.struct("k", "domains"))).alias("s"))
    return d.select("quality", "n", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["k"].cast("string"), x["domains"].cast("string"))), " ").alias("series"))


def dep_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged nodes of the lookup graph: when each was first seen, its lookups and how many nodes it was made of."""
    q = lookups(spark, sf_dir).where("qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL")
    seen = q.groupBy(F.col("qname").alias("node")).agg(F.min("s").alias("s"), F.count("*").alias("c"))
    m = G.merge_equal(*_lookup_graph(spark, sf_dir)).join(seen, "node", "left")
    return m.groupBy("merged").agg(F.min("s").alias("first_us"), F.coalesce(F.sum("c"), F.lit(0)).alias("lookups"), F.count("*").alias("nodes"))


def dep_merge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging loses no lookup: their number before and behind it, and how many nodes it leaves."""
    before = lookups(spark, sf_dir).where("qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL").agg(F.count("*").alias("lookups_before"))
    m = dep_merged_nodes(spark, sf_dir).agg(F.sum("lookups").cast("bigint").alias("lookups_after"), F.sum("nodes").cast("bigint").alias("nodes_before"), F.count("*").alias("nodes_after"))
    return before.withColumn("one", F.lit(1)).join(F.broadcast(m.withColumn("one", F.lit(1))), "one").drop("one")  # one row each


def dep_subset_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one domain that serve all sites that another of its names serves, merged into that one."""
    nodes, edges = _lookup_graph(spark, sf_dir)
    # a site is a domain of its own
    return G.merge_subsets(nodes.withColumn("domain", F.when(F.col("node").startswith("site:"), F.col("node")).otherwise(F.col("domain"))), edges)


def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's path with the sequence made of it, null if there is none."""
    a = table(spark, sf_dir, "misclassifications").where("seq_path IS NOT NULL").select("seq_path").distinct().withColumn("stem", N.stem(F.col("seq_path")))
    b = table(spark, sf_dir, "labelled_sequences").where("seq_id IS NOT NULL").select("seq_id").distinct()
    return a.join(b, a["stem"] == b["seq_id"], "left").select("seq_path", "seq_id")


def merged_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of types in queries, responses and lookups, added up."""
    sides = [table(spark, sf_dir, f"{s}_messages").dropDuplicates(["msg_id"]).groupBy(F.col(f"{s}_qtype").alias("qtype")).agg(F.count("*").alias("n")) for s in ("query", "response")]
    return S.merge_counts([*sides, lookups(spark, sf_dir).groupBy("qtype").agg(F.count("*").alias("n"))], ["qtype"], "n")


def code_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sequences of each domain hold no other codes than the one before."""
    s = labelled(spark, sf_dir).where("true_domain IS NOT NULL").select("seq_id", "true_domain", F.array_distinct(E.codes(F.col("elems"))).alias("codes"))
    s = O.with_next(s, ["true_domain"], [F.col("seq_id")], {"codes": "later"}).where("later IS NOT NULL")
    return s.groupBy("true_domain").agg(F.count_if(S.is_subset(F.col("later"), F.col("codes"))).alias("subsets"), F.count("*").alias("n"))


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distances of options read as milliseconds, and the times of loading read back from text, by label."""
    r = results(spark, sf_dir).select("mapped_domain", F.explode("options").alias("o")).where("o IS NOT NULL")
    a = r.groupBy(F.col("mapped_domain").alias("label")).agg(F.sum(N.milliseconds_to_us(F.col("o.distance_min"))).alias("us"))
    s = table(spark, sf_dir, "labelled_sequences").select("mapped_domain", F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("text"))
    b = s.groupBy(F.col("mapped_domain").alias("label")).agg(F.unix_micros(F.max(N.iso_time(F.col("text")))).alias("loaded_us"))
    return a.join(b, "label", "full")


def _run(seq_id):
    return F.regexp_extract(seq_id, r"-(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(seq_id, r"-(\d+)-(\d+)$", 2).try_cast("int")


def run_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences searched for against all of their domain: by domain and how many runs lie between them, the least, greatest, mean and median distance."""
    s = labelled(spark, sf_dir).where("true_domain IS NOT NULL").withColumn("run", _run("seq_id")[0]).where("run IS NOT NULL")
    s = materialize(s.select("seq_id", "true_domain", "run", "elems"))
    q = search_set(s, "seq_id").toDF("query_id", "true_domain", "run0", "a")
    # a domain may hold a tenth of the rows: its sequences are spread over parts, and each of those searched for goes to every part that its domain has
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    r = s.withColumn("part", F.pmod(F.xxhash64("seq_id"), F.lit(parts)))
    q = r.select("true_domain", "part").distinct().join(q, "true_domain")
    d = r.join(q, ["true_domain", "part"]).where("run > run0")
    d = materialize(d.select("true_domain", (F.col("run") - F.col("run0")).alias("step"), D.seq_distance(F.col("a"), F.col("elems")).alias("d")))
    g = d.groupBy("true_domain", "step").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"))
    g = g.join(S.exact_percentiles(d, ["true_domain", "step"], "d", {"median": 0.5}), ["true_domain", "step"])
    return g.select("true_domain", "step", "n", "least", "most", F.round("mean", 6).alias("mean"), "median")


def group_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median distance of the sequences searched for to each label."""
    s = labelled(spark, sf_dir)
    return D.group_distances(search_set(s, "seq_id").select(F.col("seq_id").alias("query_id"), "elems"), s.select(F.col("seq_id").alias("row_id"), F.col("mapped_domain").alias("label"), "elems"))


def cost_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of change costs between a sequence and the next of its domain, by the longer length: over all pairs, those without it as 0. Changes
    gap(a)_to_gap(b) have how often gap a became gap b or b became a instead of a cost."""
    s = O.with_next(labelled(spark, sf_dir).where("true_domain IS NOT NULL"), ["true_domain"], [F.col("seq_id")], {"elems": "other"}).where("other IS NOT NULL")
    # rows are few but costly: a fixed number of tasks keeps them from being put together
    s = s.where("size(elems) + size(other) > 0").repartition(96, "seq_id").select("seq_id", F.greatest(F.size("elems"), F.size("other")).alias("longest"), D.seq_distance_details(F.col("elems"), F.col("other")).alias("costs"))
    s = materialize(s)
    n = s.agg(F.count("*").alias("pairs")).withColumn("one", F.lit(1))  # one row
    c = s.select("longest", F.explode("costs").alias("change", "cost")).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.col("cost") / F.col("longest")).alias("total"), F.max(F.col("cost") / F.col("longest")).alias("most"))
    c = c.withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    return c.select("change", "n", "pairs", F.round(F.col("total") / F.col("pairs"), 9).alias("mean"), F.round("most", 9).alias("most"))


def cluster_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least and greatest normalised distance of a domain's successive sequences, and the domain's place by them."""
    g = consecutive_distances(spark, sf_dir).groupBy("true_domain").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    return O.numbered(g, [F.col("least"), F.col("most"), F.col("true_domain")], "place")


_LIST = (suffix_quality, quality_by_measure, set_means, at_least_series, dep_merged_nodes, dep_merge_totals, dep_subset_merge, paired_files, merged_type_counts, code_subsets, parsed_numbers, run_distances, group_distances, cost_breakdown, cluster_spread)
QUERIES = {f.__name__: f for f in _LIST}

# The table of costs with what led to each cell: a cell is [cost, changes ...], a change its number in CHANGES and its cost, or two gaps as 10^12 and both. Among equally
# cheap ways a swap or a substitution goes before a deletion, and that before an insertion.
_KIND, _COST = "CASE WHEN {0} >= 0 THEN 1 ELSE 0 END", "CASE WHEN {0} >= 0 THEN 12 ELSE -{0} - 1 END"
_GO = "list_concat(list_prepend({0}[1] + {1}, {0}[2:]), CASE WHEN {1} > 0 THEN [({2}) * 1000000 + {1}] ELSE [] END)"
_X, _Y, _C = _COST.format("x"), _COST.format("b[j]"), "CASE WHEN x = b[j] THEN 0 WHEN x >= 0 AND b[j] >= 0 THEN 6 WHEN x < 0 AND b[j] < 0 THEN 3 * abs(x - b[j]) ELSE " + _COST.format("x") + " + " + _COST.format("b[j]") + " END"
_KINDS = f"2 * {_KIND.format('x')} + {_KIND.format('b[j]')}"
_SUBSTITUTED = f"list_concat({_GO.format('filled[j]', f'({_C})', f'4 + {_KINDS}')}, CASE WHEN x < 0 AND b[j] < 0 AND x <> b[j] THEN [1000000000000 + (least(-x, -b[j]) - 1) * 1000000 + greatest(-x, -b[j]) - 1] ELSE [] END)"
_SWAPPED = _GO.format("older[j - 1]", "(CASE WHEN x = b[j] THEN 0 ELSE 3 END)", f"8 + {_KINDS}")
_TRACE = f"""tr AS (
  SELECT seq_id, a, b, 0 AS i, NULL::BIGINT[][] AS older, list_reduce(list_prepend([[0::BIGINT]], list_transform(b, lambda y: [[{_COST.format("y")}, {_KIND.format("y")}]])), lambda s, c: list_append(s, {_GO.format("s[-1]", "c[1][1]", "c[1][2]")})) AS filled
  FROM ends
  UNION ALL
  SELECT seq_id, a, b, i + 1, filled, list_reduce(list_prepend([{_GO.format("filled[1]", f"({_X})", f"CASE WHEN len(b) > 0 THEN 2 ELSE 0 END + {_KIND.format('x')}")}], list_transform(range(1, len(b) + 1), lambda j: [
    CASE WHEN i > 0 AND j > 1 AND a[i] = b[j] AND x = b[j - 1] AND older[j - 1][1] + CASE WHEN x = b[j] THEN 0 ELSE 3 END <= filled[j][1] + {_C} THEN {_SWAPPED} ELSE {_SUBSTITUTED} END,
    [{_Y}, 2 + {_KIND.format("b[j]")}], {_GO.format("filled[j + 1]", f"({_X})", _KIND.format("x"))}])),
    lambda s, c: list_append(s, CASE WHEN c[1][1] <= least(c[3][1], s[-1][1] + c[2][1]) THEN c[1] WHEN s[-1][1] + c[2][1] <= c[3][1] THEN {_GO.format("s[-1]", "c[2][1]", "c[2][2]")} ELSE c[3] END))
  FROM (SELECT *, a[i + 1] AS x FROM tr WHERE i < len(a))
), changes AS (SELECT seq_id, len(a) AS longest, unnest(filled[-1][2:]) AS e FROM tr WHERE i = len(a)
), named AS (SELECT seq_id, longest, CASE WHEN e >= 1000000000000 THEN 'gap(' || (e % 1000000000000 // 1000000) || ')_to_gap(' || (e % 1000000) || ')' ELSE ({D.CHANGES})[e // 1000000 + 1] END AS change, CASE WHEN e >= 1000000000000 THEN 1 ELSE e % 1000000 END AS cost FROM changes
), summed AS (SELECT seq_id, change, sum(cost) / any_value(longest) AS share FROM named GROUP BY 1, 2)"""
_READABLE = "CASE quality " + " ".join(f"WHEN {i} THEN '{S.READABLE.get(n, n)}'" for i, n in enumerate(D.QUALITIES)) + " END"

ORACLES = {
    "run_distances": rf"""
{CODED_SQL}, r AS (SELECT *, try_cast(regexp_extract(seq_id, '-(\d+)-(\d+)$', 1) AS INT) AS run FROM s WHERE true_domain IS NOT NULL
), met AS (SELECT q.true_domain, r.run - q.run AS step, {PAIR_SQL.format("q.c", "r.c")} FROM (SELECT * FROM r WHERE {SEARCHED_SQL}) q JOIN r USING (true_domain) WHERE r.run > q.run
), pairs AS (SELECT a, b FROM met), {DISTANCES_SQL}
SELECT true_domain, step, count(*) AS n, min(d) AS least, max(d) AS most, round(avg(d), 6) AS mean, quantile_cont(d, 0.5)::DOUBLE AS median FROM met JOIN dist USING (a, b) GROUP BY 1, 2
""",
    "group_distances": f"""
{CODED_SQL}, met AS (SELECT q.seq_id AS query_id, r.mapped_domain AS label, {PAIR_SQL.format("q.c", "r.c")} FROM (SELECT * FROM s WHERE {SEARCHED_SQL}) q JOIN s r ON q.seq_id <> r.seq_id
), pairs AS (SELECT a, b FROM met), {DISTANCES_SQL}
SELECT query_id, label, count(*) AS n, (sum(d) // count(*))::BIGINT AS mean, list_sort(list(d))[count(*) // 2 + 1] AS median FROM met JOIN dist USING (a, b) GROUP BY 1, 2
""",
    "cost_breakdown": f"""
{CODED_SQL}, n AS (SELECT *, lead(c) OVER (PARTITION BY true_domain ORDER BY seq_id) AS o FROM s WHERE true_domain IS NOT NULL
), ends AS (SELECT seq_id, CASE WHEN len(c) >= len(o) THEN c ELSE o END AS a, CASE WHEN len(c) >= len(o) THEN o ELSE c END AS b FROM n WHERE o IS NOT NULL AND len(c) + len(o) > 0
), {_TRACE}
SELECT change, count(*) AS n, (SELECT count(*) FROM ends) AS pairs, round(sum(share) / (SELECT count(*) FROM ends), 9) AS mean, round(max(share), 9) AS most FROM summed GROUP BY 1
""",
    "cluster_spread": f"""
WITH d AS ({EVALUATION_SQL["consecutive_distances"]}), g AS (SELECT true_domain, count(*) AS n, min(norm) AS least, max(norm) AS most FROM d GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY least, most, true_domain) - 1 AS place FROM g
""",
    "suffix_quality": rf"""
WITH {_Q}, c AS (SELECT k, lower(true_domain) AS d, quality >= 3 AS g, reason IS NOT NULL AS w FROM q WHERE true_domain IS NOT NULL
), known AS (SELECT DISTINCT regexp_replace(lower(true_domain), '^[^.]*\.', '') AS suffix FROM matched_queries WHERE true_domain LIKE '%.%'
), e AS (SELECT d, array_to_string(p[i:], '.') AS suffix FROM (SELECT DISTINCT d, string_split(d, '.') AS p, unnest(range(1, len(string_split(d, '.')) + 1)) AS i FROM c)
), found AS (SELECT d, arg_max(suffix, length(suffix)) AS suffix FROM e JOIN known USING (suffix) GROUP BY 1)
SELECT k, suffix, count(*) FILTER (g) AS good, count(*) FILTER (g AND w) AS good_w_reason, count(*) FILTER (NOT g) AS bad, count(*) FILTER (NOT g AND w) AS bad_w_reason, count(*) AS total, array_to_string(list_reverse(string_split(suffix, '.')), '.') AS sort_key
FROM c LEFT JOIN found USING (d) GROUP BY k, suffix HAVING count(*) > {LEAST_RESULTS}
""",
    "quality_by_measure": rf"""
WITH {_Q}, {LABELLED_SQL}, x AS (SELECT record_id, regexp_replace(split_part(seq_path, '/', -1), '(\.dnstap)?(\.json)?(\.xz)?$', '') AS seq_id FROM m
), f AS (SELECT q.quality >= 3 AS g, coalesce(len(e), 0) AS length, coalesce(len(list_filter(e, lambda x: x.k = 'S')), 0) AS messages, coalesce(list_sum(list_transform(list_filter(e, lambda x: x.k = 'S'), lambda x: x.v)), 0)::BIGINT AS complexity FROM q JOIN x USING (record_id) LEFT JOIN labelled USING (seq_id)
), u AS (SELECT g, 'length' AS measure, length AS value FROM f UNION ALL SELECT g, 'messages', messages FROM f UNION ALL SELECT g, 'complexity', complexity FROM f)
SELECT measure, value, count(*) FILTER (g) AS good, count(*) FILTER (NOT g) AS bad FROM u GROUP BY 1, 2
""",
    "set_means": f"""
WITH {_Q}, x AS (SELECT quality, regexp_extract(m.seq_path, '/(set[01])/', 1) AS s FROM q JOIN m USING (record_id) WHERE q.k = 1
), p AS (SELECT quality, s, 100 * count(*) / sum(count(*)) OVER (PARTITION BY s) AS p FROM x WHERE s <> '' GROUP BY 1, 2
), g AS (SELECT quality, coalesce(max(p) FILTER (s = 'set0'), 0) AS a, coalesce(max(p) FILTER (s = 'set1'), 0) AS b FROM p GROUP BY 1)
SELECT {_READABLE} AS quality, round((a + b) / 2, 6) AS mean, round(abs(a - b) / 2, 6) AS half_range FROM g
""",
    "at_least_series": f"SELECT quality, n, string_agg(k || ':' || domains, ' ' ORDER BY k) AS series FROM ({EVALUATION_SQL['stats_at_least']}) GROUP BY 1, 2",
    "dep_merged_nodes": f"""
WITH a AS ({NAMES_SQL['dep_merge']}), {_L}, s AS (SELECT qname AS node, min(s) AS s, count(*) AS c FROM l WHERE qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL GROUP BY 1)
SELECT merged, min(s) AS first_us, coalesce(sum(c), 0)::BIGINT AS lookups, count(*) AS nodes FROM a LEFT JOIN s USING (node) GROUP BY 1
""",
    "dep_merge_totals": f"""
WITH a AS ({NAMES_SQL['dep_merge']}), {_L}, q AS (SELECT count(*) AS c FROM l WHERE qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL)
SELECT c AS lookups_before, c AS lookups_after, (SELECT count(*) FROM a) AS nodes_before, (SELECT count(DISTINCT merged) FROM a) AS nodes_after FROM q
""",
    "dep_subset_merge": f"""
WITH {_L}, g AS (SELECT DISTINCT qname AS src, true_domain AS site FROM l WHERE qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL
), sets AS (SELECT src, any_value(CASE WHEN len(string_split(src, '.')) > 1 THEN array_to_string(string_split(src, '.')[-2:], '.') ELSE src END) AS domain, list(site) AS s, count(*) AS n FROM g GROUP BY 1)
SELECT a.src AS node, arg_min(b.src, (b.n, b.src)) AS merged FROM sets a JOIN sets b USING (domain) WHERE list_has_all(a.s, b.s) GROUP BY 1
UNION ALL SELECT DISTINCT 'site:' || site, 'site:' || site FROM g
""",
    "paired_files": r"""
WITH p AS (SELECT DISTINCT seq_path, regexp_replace(split_part(seq_path, '/', -1), '(\.dnstap)?(\.json)?(\.xz)?$', '') AS stem FROM misclassifications WHERE seq_path IS NOT NULL)
SELECT seq_path, seq_id FROM p LEFT JOIN (SELECT DISTINCT seq_id FROM labelled_sequences) ON stem = seq_id
""",
    "merged_type_counts": "SELECT qtype, count(*) AS n FROM (SELECT DISTINCT ON (msg_id) query_qtype AS qtype FROM query_messages UNION ALL SELECT DISTINCT ON (msg_id) response_qtype FROM response_messages UNION ALL SELECT DISTINCT ON (query_no) qtype FROM matched_queries) GROUP BY 1",
    "code_subsets": f"""
WITH {LABELLED_SQL}, c AS (SELECT seq_id, true_domain, list_distinct(list_transform(e, lambda x: x.k || x.v)) AS c FROM labelled WHERE true_domain IS NOT NULL
), p AS (SELECT *, lag(c) OVER (PARTITION BY true_domain ORDER BY seq_id) AS p FROM c)
SELECT true_domain, count(*) FILTER (list_has_all(p, c)) AS subsets, count(*) AS n FROM p WHERE p IS NOT NULL GROUP BY 1
""",
    "parsed_numbers": f"""
WITH {_Q}, u AS (SELECT mapped_domain, unnest(opts) AS o FROM q), a AS (SELECT mapped_domain AS label, sum(try_cast(round(try_cast(trim(o.distance_min) AS DOUBLE) * 1000) AS BIGINT))::BIGINT AS us FROM u WHERE o IS NOT NULL GROUP BY 1
), b AS (SELECT mapped_domain AS label, epoch_us(max(loaded_at)) AS loaded_us FROM labelled_sequences GROUP BY 1)
SELECT label, us, loaded_us FROM a FULL JOIN b USING (label)
""",
}
