"""Queries of task tables and of streams over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import queue as Q
from seqloom.plans.timeline import ORACLES as TIMELINE_SQL
from seqloom.plans.timeline import lookups
from seqloom.session import table
from seqloom.streaming import streams as R

def queue_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer by priority, then key."""
    return Q.pop(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")], ["o_orderkey", "o_orderpriority"])


def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line numbers leave none out."""
    return Q.complete_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


def queue_complete_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders that are complete, and how many they are."""
    g = Q.complete_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return table(spark, sf_dir, "lineitem").join(g, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("n").alias("lines"))


def queue_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line that an order's greatest line number calls for, with rising priorities over all orders."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("size"))
    return Q.expand(g, ["l_orderkey"], "size").select("l_orderkey", "member", "priority")


def queue_next_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the number its next order would have, 0 without orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("next_no"))
    return c.join(n, "c_custkey", "left").fillna(0, ["next_no"])


def queue_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 customers in a repeatable random order, each with its orders counted."""
    c = Q.sample(table(spark, sf_dir, "customer"), "c_custkey", 400).select("c_custkey")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("o_custkey").agg(F.count("*").alias("orders"))


#: A time after all data, for the row that ends a stream.
_END = "2100-01-01 00:00:00"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and six hours, from a stream of several micro-batches; a window is given out once the watermark has passed it."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"))
    w = R.windowed_counts(R.arrivals(e, "at", {"at": F.lit(_END)}), "at", ["event_type"], "6 hours", late="5 days")
    return R.run_to_end(w.select("event_type", F.unix_micros("window.start").alias("from_us"), "n"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events less than a day apart, from a stream of several micro-batches."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    w = R.session_counts(R.arrivals(e, "at", {"at": F.lit(_END), "user_id": F.lit(-1)}), "at", ["user_id"], "1 day", late="5 days")
    return R.run_to_end(w.select("user_id", F.unix_micros("session_window.start").alias("from_us"), "n"))


def stream_throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as throttled, from a stream in the order of logged_at; rows come up to days after their time, and more than once."""
    q = table(spark, sf_dir, "matched_queries").select("trace_id", F.unix_micros("end_time").alias("t"), F.col("query_no").alias("id"), "logged_at")
    end = {"trace_id": F.lit(""), "t": F.unix_micros(F.lit(_END).cast("timestamp")), "id": F.lit(-1)}
    out = R.run_to_end(R.throttle_stream(R.arrivals(q, "logged_at", end), "trace_id", 10_000, late="7 days"))
    t = lookups(spark, sf_dir).select(F.col("query_no").alias("id"), "t")
    return out.join(t, "id").select(F.col("id").alias("query_no"), (F.col("sent") - F.col("t")).alias("delay_us"))


def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as qr_match, from a stream of both tables' messages in the order of logged_at; they come up to days after their time, and more than once."""
    sides = []
    for i, side in enumerate(("query", "response")):
        name = F.regexp_replace(F.lower(f"{side}_qname"), r"\.\z", "")
        m = table(spark, sf_dir, f"{side}_messages")
        sides.append(m.select(F.substring_index("message_type", "_", 1).alias("kind"), name.alias("qname"), F.col(f"{side}_qtype").alias("qtype"), F.col(f"{side}_id").alias("qid"), F.coalesce("query_port", F.lit(0)).alias("port"), F.lit(i).alias("side"), F.col(f"{side}_time_ns").alias("t"), F.col("msg_id").alias("id"), "logged_at"))
    end = {"kind": F.lit(""), "qname": F.lit(""), "qtype": F.lit(""), "qid": F.lit(0), "port": F.lit(0), "side": F.lit(2), "t": F.unix_micros(F.lit(_END).cast("timestamp")) * 1000, "id": F.lit(-1)}
    both = R.arrivals(sides[0].unionByName(sides[1]), "logged_at", end)
    out = R.run_to_end(R.match_stream(both, ["kind", "qname", "qtype", "qid", "port"], late="7 days"))
    return out.where("kind IN ('CLIENT', 'FORWARDER')").select("kind", "query_id", "response_id", F.col("took").alias("took_ns"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by type, each query_no once within 31 days of arrival, from a stream of several micro-batches, and for real ones only."""
    q = table(spark, sf_dir, "matched_queries").select("query_no", "qtype", "logged_at", F.lit(False).alias("dummy"))
    s = R.arrivals(q, "logged_at", {"query_no": F.lit(-1), "qtype": F.lit(""), "logged_at": F.lit(_END), "dummy": F.lit(True)})
    return R.run_to_end(R.without_dummies(R.recent_distinct(s, "logged_at", ["query_no"], "31 days"), F.col("dummy")).select("query_no", "qtype")).groupBy("qtype").agg(F.count("*").alias("n"))


_LIST = (queue_pop, queue_complete, queue_complete_tasks, queue_members, queue_next_counters, queue_sample, stream_windows, stream_sessions, stream_throttled, stream_match, stream_distinct)
QUERIES = {f.__name__: f for f in _LIST}

ORACLES = {
    "queue_pop": "SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1",
    "queue_complete": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = max(l_linenumber)",
    "queue_complete_tasks": "SELECT l_orderkey, l_linenumber, g.n AS lines FROM lineitem JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = max(l_linenumber)) g USING (l_orderkey)",
    "queue_members": "WITH g AS (SELECT l_orderkey, max(l_linenumber) AS size FROM lineitem GROUP BY 1), s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT l_orderkey, m::INT AS member, (b + m)::BIGINT AS priority FROM (SELECT *, unnest(range(0, size)) AS m FROM s)",
    "queue_next_counters": "SELECT c_custkey, count(o_orderkey) AS next_no FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "queue_sample": "SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY md5('0:' || c_custkey) LIMIT 400) GROUP BY 1",
    "stream_windows": "SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01')) AS from_us, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events
), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s)
SELECT user_id, epoch_us(min(ts)) AS from_us, count(*) AS n FROM n GROUP BY user_id, no
""",
    "stream_distinct": "SELECT qtype, count(*) AS n FROM (SELECT DISTINCT query_no, qtype FROM matched_queries) GROUP BY 1",
    "stream_throttled": TIMELINE_SQL["throttled"],
    "stream_match": TIMELINE_SQL["qr_match"],
}
