"""Queries of ordered analytics over lookups, messages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import order as O
from seqloom.operators import stats as S
from seqloom.operators import timeline as T
from seqloom.session import materialize, table


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """matched_queries, once each, with times in microseconds."""
    q = table(spark, sf_dir, "matched_queries").dropDuplicates(["query_no"])
    return q.select("query_no", "trace_id", "true_domain", "source", F.regexp_replace(F.lower("qname"), r"\.\z", "").alias("qname"), "qtype", F.unix_micros("start_time").alias("s"), F.unix_micros("end_time").alias("t"), "query_size", "response_size")


def qr_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses matched to the latest query that waits for them, by name, type, id and port."""
    sides = []
    for side in ("query", "response"):
        m = table(spark, sf_dir, f"{side}_messages").dropDuplicates(["msg_id"])
        name = F.regexp_replace(F.lower(f"{side}_qname"), r"\.\z", "")
        sides.append(m.select(F.substring_index("message_type", "_", 1).alias("kind"), name.alias("qname"), F.col(f"{side}_qtype").alias("qtype"), F.col(f"{side}_id").alias("qid"), F.coalesce("query_port", F.lit(0)).alias("port"), F.col(f"{side}_time_ns").alias("t"), F.col("msg_id").alias("id")))
    out = T.match_responses(*sides, ["kind", "qname", "qtype", "qid", "port"])
    return out.where("kind IN ('CLIENT', 'FORWARDER')").select("kind", "query_id", "response_id", (F.col("end") - F.col("start")).alias("took_ns"))


def noise_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups without those that resolvers make for themselves, counted by type."""
    q = lookups(spark, sf_dir).where("NOT (qtype = 'NULL' AND startswith(qname, '_ta')) OR qname = ''")
    return q.groupBy("qtype").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "Forwarder").alias("forwarded"))


def marked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each trace the lookups between the first DNSKEY and the next DS lookup, counted with their span."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND t IS NOT NULL")
    d = T.between_markers(q, ["trace_id"], ["t", "query_no"], F.col("qtype") == "DNSKEY", F.col("qtype") == "DS")
    return d.groupBy("trace_id").agg(F.count("*").alias("n"), F.min("query_no").alias("first_no"), (F.max("t") - F.min("t")).alias("span"))


def gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often gaps between a trace's lookups fall into each millisecond, binary and root-two bucket."""
    g = T.gaps(lookups(spark, sf_dir).where("trace_id IS NOT NULL AND t IS NOT NULL"), ["trace_id"], "t", "query_no").where("gap IS NOT NULL")
    g = g.select(F.expr("gap div 1000 * 1000").alias("ms"), T.log_bucket(F.col("gap")).alias("log2"), T.root2_bucket(F.col("gap")).alias("root2"))
    return g.groupBy("ms", "log2", "root2").agg(F.count("*").alias("n"))


def gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type, how many lookups took 27 to 29 and 67 to 108 ms."""
    q = lookups(spark, sf_dir).where("s IS NOT NULL AND t IS NOT NULL").withColumn("took", F.col("t") - F.col("s"))
    short, long_ = F.col("took").between(27_000, 29_000), F.col("took").between(67_000, 108_000)
    return q.where(short | long_).groupBy("qtype").agg(F.count_if(short).alias("short"), F.count_if(long_).alias("long"))


def port_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a tap by direction, up for queries and down for responses, of those with a registered port, and their sizes."""
    sides = [table(spark, sf_dir, f"{s}_messages").dropDuplicates(["msg_id"]).select("tap_identity", "query_port", F.lit(d).alias("direction"), F.col(f"{s}_size").alias("size")) for s, d in (("query", "up"), ("response", "down"))]
    m = sides[0].unionByName(sides[1]).where("query_port BETWEEN 1024 AND 49151 AND size > 0")
    return m.groupBy("tap_identity", "direction").agg(F.count("*").alias("n"), F.sum("size").cast("bigint").alias("bytes"))


def gap_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the histogram of the hours between a user's events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = T.gaps(e, ["user_id"], "t", "event_id").where("gap IS NOT NULL")
    h = g.groupBy("event_type", F.expr("gap div 900000000").alias("quarter")).agg(F.count("*").alias("n"))
    return T.peaks(h, ["event_type"], "quarter", "n", 5)


def burst_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a trace's lookups at most 20 ms apart, counted by source and length."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND source IS NOT NULL AND t IS NOT NULL")
    return T.bursts(q, ["trace_id", "source"], "t", "query_no", 20_000).groupBy("source", "n").agg(F.count("*").alias("bursts"), F.max(F.col("end") - F.col("start")).alias("longest"))


def direction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each trace the bytes and runs of each direction; a lookup is a query up and a response down."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL")
    moves = F.explode(F.array(F.struct(F.lit("up").alias("dir"), F.col("s").alias("at"), F.col("query_size").alias("bytes")), F.struct(F.lit("down").alias("dir"), F.col("t").alias("at"), F.col("response_size").alias("bytes"))))
    m = q.select("trace_id", "query_no", moves.alias("m")).select("trace_id", "query_no", "m.*")
    runs = T.direction_runs(m, ["trace_id"], ["at", "query_no", "dir"], "dir").groupBy("trace_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest_run"), F.count_if((F.col("dir") == "up") & (F.col("n") == 1)).alias("single_ups"))
    sums = m.groupBy("trace_id").agg(*(F.sum(F.when(F.col("dir") == d, F.col("bytes"))).cast("bigint").alias(f"bytes_{d}") for d in ("up", "down")), F.count("*").alias("moves"))
    return sums.join(runs, "trace_id")


def size_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spread(lookups(spark, sf_dir).where("qtype IS NOT NULL"), ["qtype"], "response_size")


def domain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type the median over domains of their mean response size, and how much it varies between them."""
    return S.median_of_groups(lookups(spark, sf_dir).where("qtype IS NOT NULL"), ["qtype"], "true_domain", "response_size")


def size_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the padded response sizes of each domain."""
    c = lookups(spark, sf_dir).where("true_domain IS NOT NULL AND response_size IS NOT NULL").groupBy("true_domain", F.expr("(response_size + 467) div 468").alias("blocks")).agg(F.count("*").alias("n"))
    return S.entropy(c, ["true_domain"], "n")


def size_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the cumulative distribution of response sizes by type, about 20 each."""
    c = lookups(spark, sf_dir).where("response_size IS NOT NULL").groupBy("qtype", "response_size").agg(F.count("*").alias("n"))
    return T.sampled_points(S.cumulative_share(c, ["qtype"], "response_size", "n"), ["qtype"], "response_size", 21)


def type_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 seats for each source's lookup types by their counts."""
    c = lookups(spark, sf_dir).where("source IS NOT NULL").groupBy("source", "qtype").agg(F.count("*").alias("n"))
    return S.seats(c, ["source"], "qtype", "n", 100)


def daily_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and day number, days without any filled with zero."""
    e = table(spark, sf_dir, "events").select("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"))
    c = e.groupBy("event_type", "day").agg(F.count("*").alias("n"))
    grid = c.groupBy("event_type").agg(F.max("day").alias("last")).select("event_type", F.explode(F.sequence(F.lit(0), "last")).alias("day"))
    return grid.join(c, ["event_type", "day"], "left").fillna(0, ["n"])


def smoothed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.trimmed_smooth(daily_filled(spark, sf_dir), ["event_type"], "day", "n", 5)
    return d.select("event_type", "day", F.round("smooth", 6).alias("smooth"))


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each lookup of a trace would be answered with at least 10 ms between any two."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND t IS NOT NULL")
    return T.throttle(q, ["trace_id"], "t", "query_no", 10_000).select("query_no", (F.col("sent") - F.col("t")).alias("delay_us"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each lookup the time since its trace began, since the lookup before it ended, and its name's number by first sight."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND qname IS NOT NULL").select("query_no", "trace_id", "qname", "s", "t")
    q = materialize(O.with_prior(q, ["trace_id"], [F.col("s"), F.col("query_no")], {"t": "prior"}))
    names = q.groupBy("trace_id", "qname").agg(F.min(F.struct("s", "query_no")).alias("first"))
    names = O.group_numbers(names, ["trace_id"], [F.col("first")], "no").select("trace_id", "qname", "no")
    began = q.groupBy("trace_id").agg(F.min("s").alias("began"))
    d = q.join(names, ["trace_id", "qname"]).join(began, "trace_id")
    return d.select("query_no", (F.col("s") - F.col("began")).alias("since_start"), (F.col("s") - F.col("prior")).alias("since_prior"), (-F.col("no") - 1).cast("int").alias("name_no"))


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name looked up, how many domains and how many traces use it."""
    q = lookups(spark, sf_dir).where("qname IS NOT NULL AND true_domain IS NOT NULL AND trace_id IS NOT NULL")
    # distinct first, so that each count is a plain partial aggregate
    per = q.groupBy("qname", "true_domain", "trace_id").agg(F.count("*").alias("c")).groupBy("qname", "true_domain").agg(F.count("*").alias("traces"), F.sum("c").alias("lookups"))
    return per.groupBy("qname").agg(F.count("*").alias("domains"), F.sum("traces").alias("traces"), F.sum("lookups").alias("lookups"))


def trace_request_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each trace the sorted numbers of domains that use each of its names."""
    c = request_counts(spark, sf_dir).select("qname", "domains")
    q = lookups(spark, sf_dir).where("qname IS NOT NULL AND true_domain IS NOT NULL AND trace_id IS NOT NULL").select("trace_id", "qname").distinct()
    return q.join(c, "qname").groupBy("trace_id").agg(F.array_join(F.sort_array(F.collect_list("domains")).cast("array<string>"), " ").alias("domains"))


def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names most looked up for each domain."""
    c = lookups(spark, sf_dir).where("qname IS NOT NULL AND true_domain IS NOT NULL").groupBy("true_domain", "qname").agg(F.count("*").alias("n"))
    w = Window.partitionBy("true_domain").orderBy(F.desc("n"), "qname")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 3")


def overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups, bytes and time of each trace, and what throttling to 10 ms adds."""
    q = T.throttle(lookups(spark, sf_dir).where("trace_id IS NOT NULL AND t IS NOT NULL"), ["trace_id"], "t", "query_no", 10_000)
    d = q.groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("response_size").cast("bigint").alias("bytes"), (F.max("t") - F.min("t")).alias("time_us"), (F.max("sent") - F.min("sent")).alias("shaped_us"))
    return d.withColumn("factor", F.round(F.try_divide("shaped_us", "time_us"), 6))


def stack_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day and type the share of its events and the stack's height below it."""
    c = daily_filled(spark, sf_dir)
    w = Window.partitionBy("day")
    p = 100 * F.col("n") / F.sum("n").over(w)
    return c.withColumn("percent", p).select("day", "event_type", F.round("percent", 6).alias("percent"), F.round(F.coalesce(F.sum("percent").over(w.orderBy("event_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 6).alias("below"))


_LIST = (qr_match, noise_free, marked_windows, gap_histogram, gap_ranges, port_directions, gap_peaks, burst_lengths, direction_features, size_spread, domain_sizes, size_entropy, size_cdf, type_seats, daily_filled, smoothed_days, throttled, relative_times, request_counts, trace_request_lists, common_names, overhead, stack_heights)
QUERIES = {f.__name__: f for f in _LIST}

_L = r"""l AS (SELECT DISTINCT ON (query_no) query_no, trace_id, true_domain, source, regexp_replace(lower(qname), '\.$', '') AS qname, qtype, epoch_us(start_time) AS s, epoch_us(end_time) AS t, query_size, response_size FROM matched_queries)"""
_DAYS = """c AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, count(*) AS n FROM events GROUP BY 1, 2
), grid AS (SELECT event_type, unnest(range(0, max(day) + 1))::INT AS day FROM c GROUP BY event_type
), f AS (SELECT event_type, day, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (event_type, day))"""
_TH = ", th AS (SELECT *, max(t - i * 10000) OVER (PARTITION BY trace_id ORDER BY t, query_no ROWS UNBOUNDED PRECEDING) + i * 10000 AS sent FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY t, query_no) AS i FROM l WHERE trace_id IS NOT NULL AND t IS NOT NULL))"

ORACLES = {
    "qr_match": r"""
WITH b AS (
  SELECT DISTINCT split_part(message_type, '_', 1) AS kind, regexp_replace(lower(query_qname), '\.$', '') AS qname, query_qtype AS qtype, query_id AS qid, coalesce(query_port, 0) AS port, query_time_ns AS t, msg_id AS id, 0 AS side FROM query_messages
  UNION ALL
  SELECT DISTINCT split_part(message_type, '_', 1), regexp_replace(lower(response_qname), '\.$', ''), response_qtype, response_id, coalesce(query_port, 0), response_time_ns, msg_id, 1 FROM response_messages
), w AS (
  SELECT *, lag(side) OVER o AS ps, lag(t) OVER o AS pt, lag(id) OVER o AS pid FROM b WHERE kind IS NOT NULL AND qname IS NOT NULL AND qtype IS NOT NULL AND qid IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL
  WINDOW o AS (PARTITION BY kind, qname, qtype, qid, port ORDER BY t, side, id)
)
SELECT kind, pid AS query_id, id AS response_id, t - pt AS took_ns FROM w WHERE side = 1 AND ps = 0 AND kind IN ('CLIENT', 'FORWARDER')
""",
    "noise_free": f"WITH {_L} SELECT qtype, count(*) AS n, count(*) FILTER (source = 'Forwarder') AS forwarded FROM l WHERE NOT (qtype = 'NULL' AND starts_with(qname, '_ta')) OR qname = '' GROUP BY 1",
    "marked_windows": f"""
WITH {_L}, a AS (SELECT *, max((qtype = 'DNSKEY')::INT) OVER (PARTITION BY trace_id ORDER BY t, query_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i FROM l WHERE trace_id IS NOT NULL AND t IS NOT NULL
), b AS (SELECT *, max((qtype = 'DS')::INT) OVER (PARTITION BY trace_id ORDER BY t, query_no ROWS UNBOUNDED PRECEDING) AS o FROM a WHERE i = 1)
SELECT trace_id, count(*) AS n, min(query_no) AS first_no, max(t) - min(t) AS span FROM b WHERE o = 0 GROUP BY 1
""",
    "gap_histogram": f"""
WITH {_L}, g AS (SELECT t - lag(t) OVER (PARTITION BY trace_id ORDER BY t, query_no) AS gap FROM l WHERE trace_id IS NOT NULL AND t IS NOT NULL)
SELECT gap // 1000 * 1000 AS ms, CASE WHEN gap > 0 THEN length(bin(gap)) ELSE 0 END::INT AS log2, CASE WHEN gap > 0 THEN 2 * (length(bin(gap)) - 1) + CASE WHEN gap::HUGEINT * gap >= (1::HUGEINT << (2 * length(bin(gap)) - 1)::INT) THEN 1 ELSE 0 END ELSE 0 END::INT AS root2, count(*) AS n
FROM g WHERE gap IS NOT NULL GROUP BY 1, 2, 3
""",
    "gap_ranges": f"WITH {_L} SELECT qtype, count(*) FILTER (t - s BETWEEN 27000 AND 29000) AS short, count(*) FILTER (t - s BETWEEN 67000 AND 108000) AS long FROM l WHERE t - s BETWEEN 27000 AND 29000 OR t - s BETWEEN 67000 AND 108000 GROUP BY 1",
    "port_directions": "SELECT tap_identity, direction, count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT ON (msg_id) tap_identity, query_port, 'up' AS direction, query_size AS size FROM query_messages UNION ALL SELECT DISTINCT ON (msg_id) tap_identity, query_port, 'down', response_size FROM response_messages) WHERE query_port BETWEEN 1024 AND 49151 AND size > 0 GROUP BY 1, 2",
    "gap_peaks": """
WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events
), h AS (SELECT event_type, gap // 900000000 AS quarter, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2
), w AS (SELECT *, max(n) OVER o AS most, count(*) OVER o AS c FROM h WINDOW o AS (PARTITION BY event_type ORDER BY quarter ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))
SELECT event_type, quarter, n FROM w WHERE c = 10 AND n >= most
""",
    "burst_lengths": f"""
WITH {_L}, g AS (SELECT *, CASE WHEN t - lag(t) OVER o <= 20000 THEN 0 ELSE 1 END AS fresh FROM l WHERE trace_id IS NOT NULL AND source IS NOT NULL AND t IS NOT NULL WINDOW o AS (PARTITION BY trace_id, source ORDER BY t, query_no)
), b AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id, source ORDER BY t, query_no) AS b FROM g
), c AS (SELECT source, count(*) AS n, max(t) - min(t) AS len FROM b GROUP BY trace_id, source, b)
SELECT source, n, count(*) AS bursts, max(len) AS longest FROM c GROUP BY 1, 2
""",
    "direction_features": f"""
WITH {_L}, ok AS (SELECT * FROM l WHERE trace_id IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL
), m AS (SELECT trace_id, query_no, 'up' AS dir, s AS tm, query_size AS bytes FROM ok UNION ALL SELECT trace_id, query_no, 'down', t, response_size FROM ok
), f AS (SELECT *, CASE WHEN lag(dir) OVER o = dir THEN 0 ELSE 1 END AS fresh FROM m WINDOW o AS (PARTITION BY trace_id ORDER BY tm, query_no, dir)
), r AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY tm, query_no, dir) AS run FROM f
), c AS (SELECT trace_id, run, dir, count(*) AS n FROM r GROUP BY 1, 2, 3
), x AS (SELECT trace_id, count(*) AS runs, max(n) AS longest_run, count(*) FILTER (dir = 'up' AND n = 1) AS single_ups FROM c GROUP BY 1
), y AS (SELECT trace_id, (sum(bytes) FILTER (dir = 'up'))::BIGINT AS bytes_up, (sum(bytes) FILTER (dir = 'down'))::BIGINT AS bytes_down, count(*) AS moves FROM m GROUP BY 1)
SELECT * FROM y JOIN x USING (trace_id)
""",
    "size_spread": f"""
WITH {_L}, v AS (SELECT qtype, response_size AS v, response_size - avg(response_size) OVER (PARTITION BY qtype) AS d FROM l WHERE qtype IS NOT NULL)
SELECT qtype, count(v) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance, round(stddev_samp(v), 6) AS deviation, round(avg(d ** 3) / nullif(avg(d ** 2), 0) ** 1.5, 6) AS skewness, round(avg(d ** 4) / nullif(avg(d ** 2), 0) ** 2 - 3, 6) AS kurtosis,
  {", ".join(f"round(quantile_cont(v, {p}), 6) AS {c}" for c, p in (("p05", 0.05), ("p20", 0.2), ("median", 0.5), ("p80", 0.8), ("p95", 0.95)))} FROM v GROUP BY 1
""",
    "domain_sizes": f"WITH {_L}, g AS (SELECT qtype, true_domain, avg(response_size) AS m FROM l WHERE qtype IS NOT NULL AND true_domain IS NOT NULL AND response_size IS NOT NULL GROUP BY 1, 2) SELECT qtype, count(*) AS groups, round(stddev_samp(m), 6) AS deviation, round(quantile_cont(m, 0.5), 6) AS median FROM g GROUP BY 1",
    "size_entropy": f"""
WITH {_L}, c AS (SELECT true_domain, (response_size + 467) // 468 AS b, count(*) AS n FROM l WHERE true_domain IS NOT NULL AND response_size IS NOT NULL GROUP BY 1, 2
), p AS (SELECT true_domain, n / sum(n) OVER (PARTITION BY true_domain) AS p FROM c)
SELECT true_domain, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1
""",
    "size_cdf": f"""
WITH {_L}, c AS (SELECT qtype, response_size, count(*) AS n FROM l WHERE response_size IS NOT NULL GROUP BY 1, 2
), r AS (SELECT *, (sum(n) OVER (PARTITION BY qtype ORDER BY response_size))::BIGINT AS running, sum(n) OVER (PARTITION BY qtype) AS total, row_number() OVER (PARTITION BY qtype ORDER BY response_size) - 1 AS i, count(*) OVER (PARTITION BY qtype) AS m FROM c)
SELECT qtype, response_size, n, running, round(running / total, 9) AS share FROM r WHERE i % greatest(1, m // 20) = 0 OR i = m - 1
""",
    "type_seats": f"""
WITH {_L}, c AS (SELECT source, qtype, count(*) AS n FROM l WHERE source IS NOT NULL GROUP BY 1, 2
), q AS (SELECT source, qtype, i, n / (2 * i + 1) AS q FROM c, range(100) r(i)
), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, qtype NULLS FIRST, i) AS place FROM q)
SELECT source, qtype, count(*) AS seats FROM p WHERE place <= 100 GROUP BY 1, 2
""",
    "daily_filled": f"WITH {_DAYS} SELECT * FROM f",
    "smoothed_days": f"""
WITH {_DAYS}, w AS (SELECT event_type, day, list_sort(list(n::DOUBLE) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS v FROM f)
SELECT event_type, day, round(CASE WHEN len(v) > 2 THEN list_sum(v[1:len(v) - 2]) / (len(v) - 2) ELSE 0 END, 6) AS smooth FROM w
""",
    "throttled": f"WITH {_L}{_TH} SELECT query_no, sent - t AS delay_us FROM th",
    "relative_times": f"""
WITH {_L}, q AS (SELECT * FROM l WHERE trace_id IS NOT NULL AND s IS NOT NULL AND t IS NOT NULL AND qname IS NOT NULL
), f AS (SELECT *, min((s, query_no)) OVER (PARTITION BY trace_id, qname) AS first FROM q)
SELECT query_no, s - min(s) OVER (PARTITION BY trace_id) AS since_start, s - lag(t) OVER (PARTITION BY trace_id ORDER BY s, query_no) AS since_prior, (-dense_rank() OVER (PARTITION BY trace_id ORDER BY first))::INT AS name_no FROM f
""",
    "request_counts": f"WITH {_L} SELECT qname, count(DISTINCT true_domain) AS domains, count(DISTINCT (true_domain, trace_id)) AS traces, count(*) AS lookups FROM l WHERE qname IS NOT NULL AND true_domain IS NOT NULL AND trace_id IS NOT NULL GROUP BY 1",
    "trace_request_lists": f"""
WITH {_L}, q AS (SELECT * FROM l WHERE qname IS NOT NULL AND true_domain IS NOT NULL AND trace_id IS NOT NULL
), c AS (SELECT qname, count(DISTINCT true_domain) AS domains FROM q GROUP BY 1)
SELECT trace_id, string_agg(domains, ' ' ORDER BY domains) AS domains FROM (SELECT DISTINCT trace_id, qname FROM q) JOIN c USING (qname) GROUP BY 1
""",
    "common_names": f"WITH {_L}, c AS (SELECT true_domain, qname, count(*) AS n FROM l WHERE qname IS NOT NULL AND true_domain IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY true_domain ORDER BY n DESC, qname)::INT AS place FROM c QUALIFY place <= 3",
    "overhead": f"WITH {_L}{_TH} SELECT trace_id, count(*) AS n, sum(response_size)::BIGINT AS bytes, max(t) - min(t) AS time_us, max(sent) - min(sent) AS shaped_us, round((max(sent) - min(sent)) / nullif(max(t) - min(t), 0), 6) AS factor FROM th GROUP BY 1",
    "stack_heights": f"""
WITH {_DAYS}, p AS (SELECT day, event_type, 100 * n / sum(n) OVER (PARTITION BY day) AS percent FROM f)
SELECT day, event_type, round(percent, 6) AS percent, round(coalesce(sum(percent) OVER (PARTITION BY day ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS below FROM p
""",
}
