"""Queries over global orders, connections and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import names as N
from seqloom.operators import flows as W
from seqloom.operators import order as O
from seqloom.operators import queue as Q
from seqloom.operators import stats as S
from seqloom.plans.names import _M, _mapping
from seqloom.plans.timeline import _L, lookups
from seqloom.session import table


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted index of the traces' domains in shards of ten."""
    d = lookups(spark, sf_dir).where("true_domain IS NOT NULL").select(N.surt(F.col("true_domain")).alias("key")).distinct()
    return O.numbered(d, [F.col("key")]).select("key", F.expr("number div 10").alias("shard"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.shard_intervals(_index(spark, sf_dir), _mapping(spark, sf_dir).select(N.surt(F.col("domain")).alias("key")))


def name_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards in which each domain of the label mapping has to be searched."""
    return _intervals(spark, sf_dir)


def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shard the domains of the label mapping to be searched in it: their number, the first and the last."""
    d = _intervals(spark, sf_dir).where("first_shard <= last_shard").select("key", F.explode(F.sequence("first_shard", "last_shard")).alias("shard"))
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def next_group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each name of a domain, rising from the number of sequences that the domain has."""
    d = lookups(spark, sf_dir).where("qname IS NOT NULL AND true_domain IS NOT NULL").select("true_domain", "qname").distinct()
    base = table(spark, sf_dir, "labelled_sequences").where("seq_id IS NOT NULL").dropDuplicates(["seq_id"]).groupBy("true_domain").agg(F.count("*").alias("base"))
    n = O.group_numbers(d, ["true_domain"], [F.col("qname")]).join(base, "true_domain", "left")
    return n.select("true_domain", "qname", (F.coalesce("base", F.lit(0)) + F.col("number")).alias("group_id"))


def zipped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences and result records side by side, both in the order of their ids."""
    a = table(spark, sf_dir, "labelled_sequences").select("seq_id").where("seq_id IS NOT NULL").distinct()
    b = table(spark, sf_dir, "misclassifications").select("record_id").where("record_id IS NOT NULL").distinct()
    return O.zip_rows(a, b, [F.col("seq_id")], [F.col("record_id")])


def trimmed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response sizes of each type without the greatest 2 % of types that have more than 500."""
    return O.trimmed_counts(lookups(spark, sf_dir).where("qtype IS NOT NULL"), ["qtype"], "response_size")


def largest_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 largest responses."""
    return O.largest(lookups(spark, sf_dir).where("response_size IS NOT NULL").select("query_no", "response_size"), [F.desc("response_size"), F.asc("query_no")], 100)


def sizes_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response size at 95 % of the sorted sizes of each type."""
    return S.rank_points(lookups(spark, sf_dir).where("qtype IS NOT NULL"), ["qtype"], "response_size", [95])


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five points of the values of each type of event that is no error."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    p = S.exact_percentiles(e, ["event_type"], "value", {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0})
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in p.columns[1:]))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the messages, once each."""
    sides = []
    for side in ("query", "response"):
        m = table(spark, sf_dir, f"{side}_messages").dropDuplicates(["msg_id"])
        sides.append(m.select("msg_id", "tap_identity", "message_type", "query_address", "response_address", "query_port", F.col(f"{side}_time_ns").alias("t"), F.col(f"{side}_qtype").alias("qtype"), F.col(f"{side}_size").alias("size")))
    return sides[0].unionByName(sides[1])


def flow_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolver that each client's answers come from, the messages' kinds taken as its ports."""
    m = _messages(spark, sf_dir).where("message_type LIKE '%RESPONSE'")
    port = F.when(F.col("message_type") == "STUB_RESPONSE", 853).when(F.col("message_type") == "RESOLVER_RESPONSE", 8853).otherwise(F.col("query_port"))
    return W.server_endpoint(m.select("query_address", F.col("response_address").alias("sender"), port.alias("sender_port")).where("query_address IS NOT NULL"), ["query_address"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as records of connections of a client to a tap on a day: DNSKEY and HTTPS messages stand for the change of cipher, responses come from the server."""
    m = _messages(spark, sf_dir).where("query_address IS NOT NULL AND t IS NOT NULL AND message_type IS NOT NULL")
    kind = F.when(F.col("qtype").isin("DNSKEY", "HTTPS"), "ChangeCipherSpec").otherwise("ApplicationData")
    return m.select("query_address", F.expr("t div 86400000000000").alias("day"), "t", "msg_id", kind.alias("message_type"), F.col("size").alias("message_length"), F.col("message_type").endswith("RESPONSE").alias("srv"))


def flow_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server's answers between the markers of each connection."""
    d = W.resolver_answers(_records(spark, sf_dir), ["query_address", "day"], ["t", "msg_id"], F.col("srv"), tls13=F.col("query_address").startswith("2001:"))
    return d.select("msg_id", "query_address", "day", W.dns_payload(F.col("message_length")).alias("payload"))


def flow_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The server's answers in one connection a trace: both sides change the cipher, markers frame the trace's lookups, each lookup a client's record and the server's; sizes of the messages in them. Traces whose id has an even length are of the newer version."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND t IS NOT NULL AND response_size IS NOT NULL")
    record = lambda no, sub, kind, size, srv: F.struct(no.cast("bigint").alias("no"), F.lit(sub).alias("sub"), F.lit(kind).alias("message_type"), size.cast("int").alias("message_length"), F.lit(srv).alias("srv"))
    data, change = "ApplicationData", "ChangeCipherSpec"
    first, last = F.lit(-(1 << 62)), F.lit(1 << 62)
    frame = F.array(record(first, 0, change, F.lit(1), True), record(first, 1, change, F.lit(1), False), record(first, 2, data, F.lit(500), True), record(first, 3, data, F.lit(200), False), record(first, 4, data, F.lit(508), True), record(last, 0, data, F.lit(508), True), record(last, 1, data, F.lit(400), False), record(last, 2, data, F.lit(508), True))
    own = F.array(record(F.col("t"), 0, data, F.lit(128), False), record(F.col("t"), 1, data, F.col("response_size") + W.RECORD_OVERHEAD, True))
    marks = q.select("trace_id").distinct().select("trace_id", F.lit(-1).cast("bigint").alias("query_no"), F.explode(frame).alias("r"))
    rows = marks.unionByName(q.select("trace_id", "query_no", F.explode(own).alias("r"))).select("trace_id", "query_no", "r.*")
    d = W.resolver_answers(rows, ["trace_id"], ["no", "query_no", "sub"], F.col("srv"), tls13=F.length("trace_id") % 2 == 0)
    return d.select("trace_id", "query_no", W.dns_payload(F.col("message_length")).alias("payload"))


def tap_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each client's capture lacks, with DS and DNSKEY messages as its markers."""
    m = _messages(spark, sf_dir).where("query_address IS NOT NULL")
    return W.capture_problem(m, ["query_address"], F.col("qtype") == "DS", F.col("qtype") == "DNSKEY")


def trace_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lookups of each trace and sequence lack."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL")
    s = table(spark, sf_dir, "labelled_sequences").where("seq_id IS NOT NULL").select(F.col("seq_id").alias("trace_id"))
    return W.lookup_problem(q.select("trace_id").unionByName(s), q, ["trace_id"])


def stale_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces to which nothing was added from two hours before 2019-03-11 on."""
    q = table(spark, sf_dir, "matched_queries").where("trace_id IS NOT NULL")
    return Q.stale(q, ["trace_id"], "logged_at", F.lit("2019-03-11 00:00:00+00:00").cast("timestamp"), "2 HOURS").select("trace_id", F.unix_micros("last_change").alias("last_us"))


def first_seen_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name the lookup that showed it first."""
    q = lookups(spark, sf_dir).where("qname IS NOT NULL AND s IS NOT NULL")
    return q.groupBy("qname").agg(F.min(F.struct("s", "query_no")).alias("f")).select("qname", F.col("f.s").alias("first_us"), F.col("f.query_no").alias("query_no"))


_LIST = (name_shards, shard_names, next_group_ids, zipped_records, trimmed_sizes, largest_responses, sizes_p95, event_boxes, flow_servers, flow_answers, flow_sessions, tap_problems, trace_problems, stale_traces, first_seen_names)
QUERIES = {f.__name__: f for f in _LIST}

_I = rf"""{_M}, i0 AS (SELECT DISTINCT array_to_string(list_reverse(string_split(true_domain, '.')), ',') AS key FROM matched_queries WHERE true_domain IS NOT NULL
), i AS (SELECT key, (row_number() OVER (ORDER BY key) - 1) // 10 AS shard FROM i0
), n AS (SELECT DISTINCT array_to_string(list_reverse(string_split(domain, '.')), ',') AS key FROM m
), n2 AS (SELECT key, left(key, length(key) - 1) || chr(unicode(right(key, 1)) - 1) AS low, left(key, length(key) - 1) || chr(unicode(right(key, 1)) + 1) AS high FROM n
), v AS (SELECT n2.key, coalesce(a.shard, 0)::BIGINT AS first_shard, coalesce(b.shard, (SELECT max(shard) FROM i))::BIGINT AS last_shard FROM n2 ASOF LEFT JOIN i a ON n2.low > a.key ASOF LEFT JOIN i b ON n2.high < b.key)"""
_MSG = "msg AS (" + " UNION ALL ".join(f"SELECT DISTINCT ON (msg_id) msg_id, message_type, query_address, response_address, query_port, {s}_time_ns AS t, {s}_qtype AS qtype, {s}_size AS size FROM {s}_messages" for s in ("query", "response")) + ")"
_ONE = lambda kind, mark: f"count(*) FILTER (message_type = '{kind}' AND qtype = '{mark}')"

ORACLES = {
    "name_shards": f"WITH {_I} SELECT * FROM v",
    "shard_names": f"WITH {_I} SELECT shard, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM (SELECT key, unnest(range(first_shard, last_shard + 1)) AS shard FROM v) GROUP BY 1",
    "next_group_ids": f"""
WITH {_L}, d AS (SELECT DISTINCT true_domain, qname FROM l WHERE qname IS NOT NULL AND true_domain IS NOT NULL
), s AS (SELECT true_domain, count(*) AS base FROM (SELECT DISTINCT ON (seq_id) seq_id, true_domain FROM labelled_sequences WHERE seq_id IS NOT NULL) GROUP BY 1)
SELECT true_domain, qname, coalesce(base, 0) + row_number() OVER (PARTITION BY true_domain ORDER BY qname) - 1 AS group_id FROM d LEFT JOIN s USING (true_domain)
""",
    "zipped_records": """
WITH a AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) AS i FROM (SELECT DISTINCT seq_id FROM labelled_sequences WHERE seq_id IS NOT NULL)
), b AS (SELECT record_id, row_number() OVER (ORDER BY record_id) AS i FROM (SELECT DISTINCT record_id FROM misclassifications WHERE record_id IS NOT NULL))
SELECT seq_id, record_id FROM a JOIN b USING (i)
""",
    "trimmed_sizes": f"""
WITH {_L}, r AS (SELECT qtype, response_size, row_number() OVER (PARTITION BY qtype ORDER BY response_size) AS i, count(*) OVER (PARTITION BY qtype) AS c FROM l WHERE qtype IS NOT NULL AND response_size IS NOT NULL)
SELECT qtype, response_size, count(*) AS n FROM r WHERE c <= 500 OR i <= c - c // 50 GROUP BY 1, 2
""",
    "largest_responses": f"WITH {_L} SELECT query_no, response_size FROM l WHERE response_size IS NOT NULL ORDER BY response_size DESC, query_no LIMIT 100",
    "sizes_p95": f"""
WITH {_L}, r AS (SELECT qtype, response_size, row_number() OVER (PARTITION BY qtype ORDER BY response_size) - 1 AS i, count(*) OVER (PARTITION BY qtype) AS c FROM l WHERE qtype IS NOT NULL AND response_size IS NOT NULL)
SELECT qtype, 95 AS percent, response_size FROM r WHERE i = least(c * 95 // 100, c - 1)
""",
    "event_boxes": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {c}" for p, c in ((0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "most"))) + " FROM events WHERE event_type <> 'error' GROUP BY 1",
    "flow_servers": f"""
WITH {_MSG}, e AS (SELECT DISTINCT query_address, response_address AS s, CASE message_type WHEN 'STUB_RESPONSE' THEN 853 WHEN 'RESOLVER_RESPONSE' THEN 8853 ELSE query_port END AS p FROM msg WHERE message_type LIKE '%RESPONSE' AND query_address IS NOT NULL
), g AS (SELECT query_address, count(*) AS n, count(*) FILTER (p = 853) AS a, count(*) FILTER (p = 8853) AS b, min(s) FILTER (p = 853) AS sa, min(s) FILTER (p = 8853) AS sb FROM e WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY 1)
SELECT query_address, CASE WHEN a = 1 THEN sa WHEN a = 0 AND b = 1 THEN sb END AS server, CASE WHEN a = 1 THEN 853 WHEN a = 0 AND b = 1 THEN 8853 END AS server_port, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE n END AS candidates FROM g
""",
    "flow_answers": f"""
WITH {_MSG}, r AS (SELECT query_address AS f, t // 86400000000000 AS day, t, msg_id, qtype IN ('DNSKEY', 'HTTPS') AS chg, size, message_type LIKE '%RESPONSE' AS srv FROM msg WHERE query_address IS NOT NULL AND t IS NOT NULL AND message_type IS NOT NULL
), a AS (SELECT *, min(t) FILTER (chg AND srv) OVER o AS t1, min((t, msg_id)) FILTER (chg AND srv) OVER o AS k1, min((t, msg_id)) FILTER (chg AND NOT srv) OVER o AS k2 FROM r WINDOW o AS (PARTITION BY f, day)
), b AS (SELECT *, min((t, msg_id)) FILTER (srv AND size >= 384 AND (t, msg_id) >= greatest(k1, k2)) OVER (PARTITION BY f, day) AS k3 FROM a WHERE k1 IS NOT NULL AND k2 IS NOT NULL
), c AS (SELECT *, min((t, msg_id)) FILTER (NOT srv AND size BETWEEN 128 AND 256 AND (t, msg_id) >= k3) OVER (PARTITION BY f, day) AS k4 FROM b WHERE k3 IS NOT NULL
), d AS (SELECT *, min((t, msg_id)) FILTER (NOT srv AND size >= 384 AND (t, msg_id) >= k4) OVER (PARTITION BY f, day) AS k5 FROM c WHERE k4 IS NOT NULL
), e AS (SELECT *, row_number() OVER (PARTITION BY f, day ORDER BY t, msg_id) AS i FROM d WHERE (t, msg_id) >= k4 AND (k5 IS NULL OR (t, msg_id) < k5) AND srv AND NOT coalesce(chg, false)
), g AS (SELECT *, row_number() OVER (PARTITION BY f, day ORDER BY t DESC, msg_id DESC) AS j FROM e WHERE i > 1 AND (NOT starts_with(f, '2001:') OR size >= 128))
SELECT msg_id, f AS query_address, day, greatest(size - 40, 0) AS payload FROM g WHERE k5 IS NULL OR j > 1
""",
    "flow_sessions": f"WITH {_L} SELECT trace_id, query_no, response_size AS payload FROM l WHERE trace_id IS NOT NULL AND t IS NOT NULL AND response_size IS NOT NULL AND (length(trace_id) % 2 = 1 OR response_size + 40 >= 128)",
    "tap_problems": f"""
WITH {_MSG}, g AS (SELECT query_address, {_ONE('CLIENT_QUERY', 'DS')} AS qs, {_ONE('CLIENT_QUERY', 'DNSKEY')} AS qe, {_ONE('CLIENT_RESPONSE', 'DS')} AS rs, {_ONE('CLIENT_RESPONSE', 'DNSKEY')} AS re FROM msg WHERE query_address IS NOT NULL GROUP BY 1)
SELECT query_address, CASE WHEN qs = 0 THEN '0 start queries' WHEN qe <> 1 THEN qe || ' end queries' WHEN rs <> 1 THEN rs || ' start responses' WHEN re <> 1 THEN re || ' end responses' END AS problem FROM g
""",
    "trace_problems": f"""
WITH {_L}, t AS (SELECT trace_id FROM l WHERE trace_id IS NOT NULL UNION SELECT seq_id FROM labelled_sequences WHERE seq_id IS NOT NULL
), g AS (SELECT trace_id, count(*) FILTER (source = 'Forwarder' AND qtype = 'A') AS a FROM l GROUP BY 1)
SELECT trace_id, CASE WHEN a IS NULL THEN 'no lookup' WHEN a = 0 THEN 'no A lookup of the forwarder' END AS problem FROM t LEFT JOIN g USING (trace_id)
""",
    "stale_traces": "SELECT trace_id, epoch_us(max(logged_at)) AS last_us FROM matched_queries WHERE trace_id IS NOT NULL GROUP BY 1 HAVING max(logged_at) < TIMESTAMPTZ '2019-03-10 22:00:00+00'",
    "first_seen_names": f"WITH {_L} SELECT qname, min(s) AS first_us, arg_min(query_no, (s, query_no)) AS query_no FROM l WHERE qname IS NOT NULL AND s IS NOT NULL GROUP BY 1",
}
