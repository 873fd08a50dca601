"""Queries over names: labels, hierarchies, mappings, and sets of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import names as N
from seqloom.operators import graph as G
from seqloom.plans.evaluation import results
from seqloom.plans.timeline import lookups
from seqloom.session import table


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups(spark, sf_dir).where("qname LIKE '%.%'").select("qname").distinct()


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name looked up, and each name above one, with its parent."""
    s = _names(spark, sf_dir).select(F.explode(N.suffixes(F.col("qname"))).alias("src")).distinct()
    return s.select("src", N.parent(F.col("src")).alias("dst")).where("dst IS NOT NULL")


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("qname")
    return _names(spark, sf_dir).select("qname", N.surt(q).alias("surt"), N.tld(q).alias("tld"), N.parent(q).alias("parent"), F.size(N.suffixes(q)).alias("depth"), N.host(F.concat(F.lit("https://"), q, F.lit("/x?y=1"))).alias("host"))


def tld_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select(N.tld(F.col("qname")).alias("tld")).groupBy("tld").agg(F.count("*").alias("names"))


def host_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that equal or lie under a domain that traces were made of: one row a name and domain."""
    domains = lookups(spark, sf_dir).select(F.lower("true_domain").alias("domain")).where("domain IS NOT NULL").distinct()
    return _names(spark, sf_dir).select("qname", F.explode(N.suffixes(F.col("qname"))).alias("domain")).join(domains, "domain").select("qname", "domain")


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set, file stem, and the two numbers in it, of each sequence path."""
    m = table(spark, sf_dir, "misclassifications").select("seq_path").where("seq_path IS NOT NULL").distinct()
    part = lambda i: F.regexp_extract("seq_path", r"/(set\d+)/(.*)-(\d+)-(\d+)\.", i)
    return m.select("seq_path", part(1).alias("set_name"), N.stem(F.col("seq_path")).alias("stem"), part(3).try_cast("int").alias("run"), part(4).try_cast("int").alias("sample"), F.array_join(N.natural_key(N.stem(F.col("seq_path"))), "").alias("sort_key"))


def human_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lookups(spark, sf_dir).where("s IS NOT NULL AND t >= s")
    return q.select(N.human_time((F.col("t") - F.col("s")) * 1000).alias("took")).groupBy("took").agg(F.count("*").alias("n"))


def dep_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(_edges(spark, sf_dir))


def dep_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges to parents, from those to parents and to grandparents."""
    e = _edges(spark, sf_dir)
    two = e.unionByName(e.select("src", N.parent(F.col("dst")).alias("dst")).where("dst IS NOT NULL")).distinct()
    return G.reduction(two, G.closure(e))


def dep_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names of each depth lie under `example`."""
    e = _edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return G.reaching(nodes, G.closure(e), "example").groupBy(F.size(F.split("node", r"\.")).alias("depth")).agg(F.count("*").alias("names"))


def _lookup_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names looked up lead to the domains of their traces; a name's domain is its last two labels."""
    q = lookups(spark, sf_dir).where("qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL")
    edges = q.select(F.col("qname").alias("src"), F.concat(F.lit("site:"), "true_domain").alias("dst")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.withColumn("domain", F.substring_index("node", ".", -2)), edges


def dep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one domain that serve the same sites, as one node."""
    return G.merge_equal(*_lookup_graph(spark, sf_dir))


def dep_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains with more than one name, their number of names and of sites."""
    nodes, edges = _lookup_graph(spark, sf_dir)
    d = nodes.withColumnRenamed("node", "src").join(edges, "src")
    d = d.groupBy("domain", "src").agg(F.count("*").alias("sites"))
    return d.groupBy("domain").agg(F.count("*").alias("names"), F.sum("sites").alias("links"), F.min("src").alias("first_name")).where("names > 1")


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label mapping: comments left out, the last record of a domain holds."""
    clean = lambda c: F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t"))), r"\.\z", "")
    r = table(spark, sf_dir, "confusion_records").select(clean("domain").alias("domain"), clean("is_similar_to").alias("target"), "record_id")
    r = r.where("domain NOT LIKE '#%' AND contains(domain, '.') AND contains(target, '.')")
    return r.groupBy("domain").agg(F.max_by("target", F.struct("record_id", "target")).alias("target"))


def confusion_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping(spark, sf_dir)


def resolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label of the mapping followed to its end."""
    m = _mapping(spark, sf_dir)
    return G.resolve_labels(m.select(F.col("domain").alias("name")), m)


def mapping_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains for which the lists name more than one target."""
    clean = lambda c: F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t"))), r"\.\z", "")
    r = table(spark, sf_dir, "confusion_records").select(clean("domain").alias("domain"), clean("is_similar_to").alias("target")).where("domain NOT LIKE '#%' AND contains(domain, '.') AND contains(target, '.')").distinct()
    return r.groupBy("domain").agg(F.count("*").alias("targets"), F.min("target").alias("first_target")).where("targets > 1")


def unlabelled_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces without a labelled sequence (anti join) and sequences without a trace (difference)."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL").select(F.col("trace_id").alias("id")).distinct()
    s = table(spark, sf_dir, "labelled_sequences").where("seq_id IS NOT NULL").select(F.col("seq_id").alias("id")).distinct()
    return q.join(s, "id", "left_anti").withColumn("lacks", F.lit("sequence")).unionByName(s.subtract(q).withColumn("lacks", F.lit("trace")))


def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of sequences and results, with where they occur."""
    a = table(spark, sf_dir, "labelled_sequences").select(F.col("mapped_domain").alias("label"), F.lit(1).alias("src")).distinct()
    b = results(spark, sf_dir).select(F.col("mapped_domain").alias("label"), F.lit(2).alias("src")).distinct()
    return a.union(b).where("label IS NOT NULL").groupBy("label").agg(F.sum("src").alias("found_in"))


_LIST = (name_forms, tld_distinct, host_suffix_match, path_parts, human_times, dep_closure, dep_reduction, dep_reaching, dep_merge, dep_duplicates, confusion_mapping, resolved_labels, mapping_conflicts, unlabelled_traces, label_union)
QUERIES = {f.__name__: f for f in _LIST}

_N = r"""l AS (SELECT DISTINCT ON (query_no) query_no, trace_id, true_domain, regexp_replace(lower(qname), '\.$', '') AS qname, epoch_us(start_time) AS s, epoch_us(end_time) AS t FROM matched_queries
), n AS (SELECT DISTINCT qname FROM l WHERE qname LIKE '%.%'
), sx AS (SELECT qname, array_to_string(p[i:], '.') AS suffix FROM (SELECT qname, string_split(qname, '.') AS p, unnest(range(1, len(string_split(qname, '.')) + 1)) AS i FROM n)
), e AS (SELECT DISTINCT suffix AS src, regexp_replace(suffix, '^[^.]*\.', '') AS dst FROM sx WHERE contains(suffix, '.'))"""
_C = ", c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"
_M = r"""r AS (SELECT record_id, regexp_replace(lower(trim(domain, chr(32) || chr(9))), '\.$', '') AS domain, regexp_replace(lower(trim(is_similar_to, chr(32) || chr(9))), '\.$', '') AS target FROM confusion_records
), k AS (SELECT * FROM r WHERE domain NOT LIKE '#%' AND contains(domain, '.') AND contains(target, '.')
), m AS (SELECT domain, arg_max(target, (record_id, target)) AS target FROM k GROUP BY 1)"""

ORACLES = {
    "name_forms": f"WITH {_N} SELECT qname, array_to_string(list_reverse(string_split(qname, '.')), ',') AS surt, string_split(qname, '.')[-1] || '.' AS tld, regexp_replace(qname, '^[^.]*\\.', '') AS parent, len(string_split(qname, '.'))::INT AS depth, CASE WHEN regexp_full_match(qname, '[a-z0-9.-]+') THEN qname END AS host FROM n",
    "tld_distinct": f"WITH {_N} SELECT string_split(qname, '.')[-1] || '.' AS tld, count(*) AS names FROM n GROUP BY 1",
    "host_suffix_match": f"WITH {_N}, d AS (SELECT DISTINCT lower(true_domain) AS domain FROM l WHERE true_domain IS NOT NULL) SELECT qname, domain FROM sx JOIN d ON suffix = domain",
    "path_parts": r"""
WITH p AS (SELECT DISTINCT seq_path, regexp_replace(split_part(seq_path, '/', -1), '(\.dnstap)?(\.json)?(\.xz)?$', '') AS stem FROM misclassifications WHERE seq_path IS NOT NULL)
SELECT seq_path, regexp_extract(seq_path, '/(set\d+)/(.*)-(\d+)-(\d+)\.', 1) AS set_name, stem, try_cast(regexp_extract(seq_path, '/(set\d+)/(.*)-(\d+)-(\d+)\.', 3) AS INT) AS run, try_cast(regexp_extract(seq_path, '/(set\d+)/(.*)-(\d+)-(\d+)\.', 4) AS INT) AS sample,
  array_to_string(list_transform(regexp_extract_all(stem, '\d+|\D+'), lambda x: CASE WHEN regexp_full_match(x, '\d+') THEN lpad(x, 20, '0') ELSE x END), '') AS sort_key
FROM p
""",
    "human_times": f"WITH {_N}, d AS (SELECT (t - s) * 1000 AS ns FROM l WHERE s IS NOT NULL AND t >= s) SELECT CASE WHEN ns < 1000 THEN ns || 'ns' WHEN ns < 1000000 THEN ns // 1000 || 'us' WHEN ns < 1000000000 THEN ns // 1000000 || 'ms' WHEN ns < 3600000000000 THEN ns // 1000000000 || 's' ELSE ns // 3600000000000 || 'h' END AS took, count(*) AS n FROM d GROUP BY 1",
    "dep_closure": f"WITH RECURSIVE {_N}{_C} SELECT * FROM c",
    "dep_reduction": f"WITH {_N} SELECT * FROM e",
    "dep_reaching": f"WITH RECURSIVE {_N}{_C}, x AS (SELECT src AS node FROM c WHERE dst = 'example' UNION SELECT dst FROM e WHERE dst = 'example') SELECT len(string_split(node, '.'))::INT AS depth, count(*) AS names FROM x GROUP BY 1",
    "dep_merge": f"""
WITH {_N}, g AS (SELECT DISTINCT qname AS src, 'site:' || true_domain AS dst FROM l WHERE qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL
), nodes AS (SELECT src AS node FROM g UNION SELECT dst FROM g
), d AS (SELECT node, CASE WHEN len(string_split(node, '.')) > 1 THEN array_to_string(string_split(node, '.')[-2:], '.') ELSE node END AS domain FROM nodes
), site AS (SELECT node, min(node) OVER (PARTITION BY domain) AS merged, domain FROM d WHERE node NOT IN (SELECT src FROM g)
), sets AS (SELECT g.src AS node, d.domain, string_agg(DISTINCT site.merged, '|' ORDER BY site.merged) AS k FROM g JOIN site ON g.dst = site.node JOIN d ON d.node = g.src GROUP BY 1, 2)
SELECT node, min(node) OVER (PARTITION BY domain, k) AS merged FROM sets UNION ALL SELECT node, merged FROM site
""",
    "dep_duplicates": f"""
WITH {_N}, g AS (SELECT DISTINCT qname AS src, true_domain AS dst FROM l WHERE qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL
), d AS (SELECT CASE WHEN len(string_split(src, '.')) > 1 THEN array_to_string(string_split(src, '.')[-2:], '.') ELSE src END AS domain, src, count(*) AS sites FROM g GROUP BY 1, 2)
SELECT domain, count(*) AS names, sum(sites)::BIGINT AS links, min(src) AS first_name FROM d GROUP BY 1 HAVING count(*) > 1
""",
    "confusion_mapping": f"WITH {_M} SELECT * FROM m",
    "resolved_labels": f"""
WITH RECURSIVE {_M}, c AS (SELECT domain AS name, [domain] AS path FROM m UNION ALL SELECT c.name, list_append(c.path, m.target) FROM c JOIN m ON c.path[-1] = m.domain WHERE list_position(c.path[:-2], c.path[-1]) IS NULL
), e AS (SELECT name, arg_max(path, len(path)) AS path FROM c GROUP BY 1)
SELECT name, path[-1] AS resolved, list_position(path, path[-1])::BIGINT - 1 AS hops FROM e
""",
    "mapping_conflicts": f"WITH {_M} SELECT domain, count(DISTINCT target) AS targets, min(target) AS first_target FROM k GROUP BY 1 HAVING count(DISTINCT target) > 1",
    "unlabelled_traces": """
WITH q AS (SELECT DISTINCT trace_id AS id FROM matched_queries WHERE trace_id IS NOT NULL), s AS (SELECT DISTINCT seq_id AS id FROM labelled_sequences WHERE seq_id IS NOT NULL)
SELECT id, 'sequence' AS lacks FROM (SELECT * FROM q EXCEPT SELECT * FROM s) UNION ALL SELECT id, 'trace' FROM (SELECT * FROM s EXCEPT SELECT * FROM q)
""",
    "label_union": "SELECT label, sum(src)::BIGINT AS found_in FROM (SELECT DISTINCT mapped_domain AS label, 1 AS src FROM labelled_sequences UNION ALL SELECT DISTINCT label, 2 FROM misclassifications) WHERE label IS NOT NULL GROUP BY 1",
}
