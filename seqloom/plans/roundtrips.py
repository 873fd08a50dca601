"""Queries through the sources and sinks: the given tables are written in each format and read back, or packed into the files' contents by Spark and decoded."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import elements as E
from seqloom.functions import names as N
from seqloom.operators import order as O
from seqloom.plans.evaluation import _Q, stats_table
from seqloom.plans.evaluation import ORACLES as EVALUATION_SQL
from seqloom.operators.sequences import build_sequences
from seqloom.plans.sequences import _TXT, LABELLED_SQL, labelled, sequence_sql, traces
from seqloom.plans.sequences import ORACLES as SEQUENCES_SQL
from seqloom.plans.timeline import _L, lookups
from seqloom.plans.timeline import ORACLES as TIMELINE_SQL
from seqloom.plans.timeline import gap_histogram
from seqloom.session import scratch, table
from seqloom.sources import frames as B
from seqloom.sources import text as X
from seqloom.sources.load import load_sequences, timed_messages

#: Messages that one packed file holds.
FILE_ROWS = 1000
_SIDES = ("query", "response")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the messages, once each, as rows of the event schema with no, their place in the order of msg_id."""
    sides = []
    for side in _SIDES:
        m = table(spark, sf_dir, f"{side}_messages").dropDuplicates(["msg_id"]).where("msg_id IS NOT NULL AND message_type IS NOT NULL")
        own = {f"{side}_{c}": F.col(f"{side}_{c}") for c in ("time_ns", "qname", "qtype", "id", "size")}
        sides.append(m.select("msg_id", F.col("tap_identity").alias("identity"), F.col("tap_version").alias("version"), "message_type", "query_address", "response_address", "query_port", "query_zone", *(c.alias(n) for n, c in own.items())))
    return O.numbered(sides[0].unionByName(sides[1], allowMissingColumns=True), [F.col("msg_id")], "no")


def _packed(rows: DataFrame, pack, *columns: str) -> DataFrame:
    """path, content: files of FILE_ROWS rows each in the order of no, whose contents `pack` makes of their rows as dicts."""

    def make(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        return pa.table({"path": [f"{part:08d}"], "content": pa.array([pack(sorted(t.to_pylist(), key=lambda r: r["no"]))], pa.binary())})

    d = rows.withColumn("part", F.expr(f"no div {FILE_ROWS}")).select("part", "no", *columns)
    return d.groupBy("part").applyInArrow(make, "path string, content binary")


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as events in streams of frames, and what is read from them; place is that of a frame over all files."""
    columns = ["identity", "version", "message_type", "query_address", "response_address", "query_port", "query_zone", *(f"{s}_{c}" for s in _SIDES for c in ("time_ns", "qname", "qtype", "id", "size"))]
    files = _packed(_events(spark, sf_dir), lambda rows: B.frame_stream([B.encode_event(r) for r in rows]), *columns)
    e = B.decode_events(files)
    return e.select((F.col("path").cast("bigint") * FILE_ROWS + F.col("frame_no")).alias("place"), "identity", "version", "message_type", "query_address", "response_address", "query_port", F.lower("query_zone").alias("query_zone"), *(c for s in _SIDES for c in (f"{s}_time_ns", F.lower(f"{s}_qname").alias(f"{s}_qname"), f"{s}_qtype", f"{s}_id", f"{s}_size")))


def source_dns_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response messages with a question as DNS streams over TCP, and the messages read from them."""
    r = table(spark, sf_dir, "response_messages").dropDuplicates(["msg_id"]).where("msg_id IS NOT NULL AND response_qname IS NOT NULL AND response_qtype IS NOT NULL AND response_id IS NOT NULL")
    r = O.numbered(r.select("msg_id", "response_qname", "response_qtype", "response_id", "response_size"), [F.col("msg_id")], "no")

    def pack(rows: list[dict]) -> bytes:
        bodies = [B.dns_question(x["response_id"], x["response_qname"], x["response_qtype"], x["response_size"] or 0) for x in rows]
        return b"".join(struct.pack(">H", len(b)) + b for b in bodies)

    d = B.decode_dns_streams(_packed(r, pack, "response_qname", "response_qtype", "response_id", "response_size"))
    return d.select((F.col("path").cast("bigint") * FILE_ROWS + F.col("message_no")).alias("place"), "size", F.lower("qname").alias("qname"), "qtype", "qid")


#: Records longer than this travel in two segments, the second one first.
SEGMENT = 300


def _capture(rows: list[dict]) -> bytes:
    """A capture of one TLS record a row from a resolver to the client with the row's port."""
    out, places = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), {}
    for r in rows:
        record = bytes([23, 3, 3]) + struct.pack(">H", r["size"]) + b"x" * r["size"]
        port, at = r["port"], places.get(r["port"], 1)
        places[port] = at + len(record)
        cuts = [(0, len(record))] if r["size"] <= SEGMENT else [(SEGMENT, len(record)), (0, SEGMENT)]
        if r["size"] > SEGMENT and at == 1:  # the first packet of a direction tells where its stream begins
            cuts.reverse()
        for a, b in cuts:
            body = record[a:b]
            ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(body), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
            data = bytes(12) + struct.pack(">H", 0x0800) + ip + struct.pack(">HHIIBBHHH", 853, port, (at + a) % 2**32, 0, 0x50, 16, 0, 0, 0) + body
            out += struct.pack("<IIII", r["time_us"] // 1_000_000, r["time_us"] % 1_000_000, len(data), len(data)) + data
    return out


def source_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response messages as TLS records in packet captures, and the records read from them: place of the record over all files, its packet's number, time and length."""
    r = table(spark, sf_dir, "response_messages").dropDuplicates(["msg_id"]).where("msg_id IS NOT NULL AND response_time_ns IS NOT NULL AND response_size IS NOT NULL")
    r = r.select("msg_id", F.coalesce("query_port", F.lit(1)).alias("port"), F.expr("response_time_ns div 1000").alias("time_us"), F.col("response_size").alias("size"))
    d = B.decode_captures(_packed(O.numbered(r, [F.col("msg_id")], "no"), _capture, "port", "time_us", "size"))
    return d.select((F.col("path").cast("bigint") * FILE_ROWS + F.col("record_no")).alias("place"), "packet_no", "receiver_port", "time_us", "message_type", "message_length")


def source_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as lines of JSON and read back."""
    path = scratch(spark)
    X.write_sequences(labelled(spark, sf_dir), path)
    return X.read_sequences(spark, path).select("seq_id", F.array_join(E.codes(F.col("elems")), " ").alias("sequence"))


def source_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sequences written as lines of JSON and read back."""
    path = scratch(spark)
    X.write_labelled(labelled(spark, sf_dir), path)
    return X.read_labelled(spark, path).select("seq_id", "true_domain", "mapped_domain", F.array_join(E.codes(F.col("elems")), " ").alias("sequence"))


def source_label_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label lists as CSV files, and how often each pair is read from them."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "confusion_records").select("domain", "is_similar_to")
    rows.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return X.read_label_lists(spark, path).groupBy("domain", "target").agg(F.count("*").alias("n"))


def source_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records written as lines of JSON and read back: by path, k, label and reason the number of records, options and votes."""
    path = scratch(spark)
    m = table(spark, sf_dir, "misclassifications").dropDuplicates(["record_id"])
    X.write_results(m.select(F.col("seq_path").alias("id"), "k", "label", "reason", "class_result"), path)
    o = F.filter(F.coalesce("class_result.options", F.array().cast("array<struct<name:string,count:int,distance_min:string,distance_max:string,distance_min_norm:string,distance_max_norm:string>>")), lambda x: x.isNotNull())
    votes = F.aggregate(o, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["count"], F.lit(0)))
    return X.read_results(spark, path).select("id", "k", "label", "reason", F.size(o).alias("s"), votes.alias("v")).groupBy("id", "k", "label", "reason").agg(F.count("*").alias("n"), F.sum("s").alias("options"), F.sum("v").alias("votes"))


def source_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains by their number of lookups as a ranked list, of which the first 100 are read."""
    path = scratch(spark)
    c = lookups(spark, sf_dir).where("true_domain IS NOT NULL").groupBy(F.col("true_domain").alias("domain")).agg(F.count("*").alias("n"))
    O.numbered(c, [-F.col("n"), F.col("domain")]).select((F.col("number") + 1).alias("rank"), "domain").write.csv(path)
    return X.read_ranked(spark, path, 100)


def source_crawl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up as lines of a crawl index, packed by gzip, and how many of each top-level domain are read from it."""
    path = scratch(spark)
    q = lookups(spark, sf_dir).where("qname LIKE '%.%' AND s IS NOT NULL").groupBy("qname").agg(F.min("s").alias("s"))
    stamp = F.date_format(F.timestamp_micros("s"), "yyyyMMddHHmmss")
    fields = F.to_json(F.struct(F.concat(F.lit("https://"), F.col("qname"), F.lit("/")).alias("url"), F.lit("200").alias("status")))
    q.select(F.concat_ws(" ", F.concat(N.surt(F.col("qname")), F.lit(")/")), stamp, fields).alias("value")).write.option("compression", "gzip").text(path)
    d = X.read_crawl_index(spark, path).where("status = 200")
    return d.groupBy(F.substring_index("surt", ",", 1).alias("tld")).agg(F.count("*").alias("pages"), F.min("stamp").alias("first_stamp"), F.min("url").alias("first_url"))


def _log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, value: one browser log a trace. First come its page and two scripts; then each lookup is a request, with a referrer, by the parser, or by a script whose caller has an inline script as its parent."""
    q = lookups(spark, sf_dir).where("trace_id IS NOT NULL AND qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL")
    pages = q.groupBy("trace_id").agg(F.min(F.concat(F.lit("https://"), F.lower("true_domain"), F.lit("/"))).alias("page"))
    page, kind = F.col("page"), F.get(F.array(F.lit("other"), F.lit("parser"), F.lit("script")), (F.col("query_no") % 3).cast("int"))
    frame = lambda url, script: F.struct(url.alias("url"), F.lit(script).alias("scriptId"))
    at = lambda name: F.concat(page, F.lit(name))

    def sent(url: Column, initiator: Column, referrer: Column | None = None) -> Column:
        asked = F.struct(url.alias("url"), *([] if referrer is None else [F.struct(referrer.alias("Referer")).alias("headers")]))
        return F.to_json(F.struct(F.lit("Network.requestWillBeSent").alias("method"), F.struct(page.alias("documentURL"), asked.alias("request"), initiator.alias("initiator")).alias("params")))

    stack = F.struct(F.array(frame(at("a.js"), "1")).alias("callFrames"), F.struct(F.array(frame(F.lit(""), "7")).alias("callFrames")).alias("parent"))
    initiator = F.struct(kind.alias("type"), F.when(kind == "parser", page).alias("url"), F.when(kind == "script", stack).alias("stack"))
    got = F.when(F.col("source") == "Forwarder", F.lit(',{"method":"Network.responseReceived","params":{}},{"method":"Network.dataReceived","params":{}}')).otherwise("")
    rows = q.join(pages, "trace_id").select("trace_id", F.concat(sent(F.concat(F.lit("https://"), F.col("qname"), F.lit("/")), initiator, F.when(kind == "other", page)), got).alias("m"))
    by = lambda k, url=None: F.struct(F.lit(k).alias("type"), *([] if url is None else [url.alias("url")]))
    script = F.to_json(F.struct(F.lit("Debugger.scriptParsed").alias("method"), F.struct(F.lit("7").alias("scriptId"), F.lit("").alias("url"), F.struct(F.array(frame(at("b.js"), "2")).alias("callFrames")).alias("stackTrace")).alias("params")))
    head = pages.select("trace_id", F.array(sent(page, by("other")), sent(at("a.js"), by("parser", page)), sent(at("b.js"), by("parser", page)), script).alias("head"))
    g = rows.groupBy("trace_id").agg(F.collect_list("m").alias("l")).join(head, "trace_id")
    return g.select(F.col("trace_id").alias("file"), F.concat(F.lit("["), F.array_join(F.concat("head", "l"), ","), F.lit("]")).alias("value"))


def source_request_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the requests of such logs depend on."""
    return X.request_edges(X.browser_messages(_log_texts(spark, sf_dir)))


def source_log_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of such logs are no good."""
    return X.log_reason(X.browser_messages(_log_texts(spark, sf_dir)))


def _folders(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each domain with a packed file of timed messages for each of its traces."""
    t = traces(spark, sf_dir).where("response_size >= 1 AND t IS NOT NULL AND trace_id IS NOT NULL")
    labels = t.groupBy("trace_id").agg(F.coalesce(F.min("true_domain"), F.lit("_")).alias("label"))
    d = X.timed_texts(t, "trace_id", "t", "response_size", "query_no").join(labels, "trace_id")
    path = scratch(spark)
    B.write_files(d.select(F.concat_ws("/", "label", F.concat("trace_id", F.lit(".json.xz"))).alias("path"), F.encode("value", "UTF-8").alias("content")), path)
    return path


def source_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences built from packed files of timed messages, one a trace."""
    m = timed_messages(spark, _folders(spark, sf_dir), "json").withColumn("trace_id", F.regexp_extract("path", r"([^/]*)\.json\.xz$", 1))
    s = build_sequences(m, "trace_id", "time_us", "size", "tie")
    return s.select("trace_id", F.array_join(E.codes(F.col("elems")), " ").alias("sequence"))


def source_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of such folders by label, with their place in it."""
    d = B.labelled_files(spark, _folders(spark, sf_dir), ".json.xz")
    return d.select("label", F.regexp_extract("path", r"([^/]*)\.json\.xz$", 1).alias("trace_id"), "ordinal")


def source_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as event files, one a tap and day of arrival, and the forwarder's sequences loaded from them."""
    m = []
    for side in _SIDES:
        t = table(spark, sf_dir, f"{side}_messages").dropDuplicates(["msg_id"]).where(f"{side}_id IS NOT NULL AND {side}_qname IS NOT NULL AND {side}_qtype IS NOT NULL AND {side}_time_ns IS NOT NULL AND tap_identity IS NOT NULL AND message_type LIKE 'FORWARDER%'")
        m.append(t.select("tap_identity", F.col("logged_at").cast("date").alias("day"), "msg_id", "message_type", "query_port", *(f"{side}_{c}" for c in ("time_ns", "qname", "qtype", "id", "size"))))
    rows = m[0].unionByName(m[1], allowMissingColumns=True)

    def make(t: pa.Table) -> pa.Table:
        r = sorted(t.to_pylist(), key=lambda x: x["msg_id"])
        return pa.table({"path": [f"{r[0]['tap_identity']}/{r[0]['day']}.dnstap"], "content": pa.array([B.frame_stream([B.encode_event(x) for x in r])], pa.binary())})

    path = scratch(spark)
    B.write_files(rows.groupBy("tap_identity", "day").applyInArrow(make, "path string, content binary"), path)
    s = load_sequences(spark, path, "dnstap")
    return s.select(F.regexp_extract("seq_id", r"([^/]*/[^/]*)\.dnstap$", 1).alias("file"), F.array_join(E.codes(F.col("elems")), " ").alias("sequence"))


def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each message in the order of its response's or else its query's time."""
    e = _events(spark, sf_dir).select("msg_id", F.coalesce("response_time_ns", "query_time_ns").alias("t")).where("t IS NOT NULL")
    return O.numbered(e, [F.col("t"), F.col("msg_id")], "place").select("msg_id", "place")


def sink_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of names and sites as a GraphML document, and its nodes and edges read from the lines."""
    q = lookups(spark, sf_dir).where("qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL").select("qname", F.concat(F.lit("site:"), "true_domain").alias("site")).distinct()
    nodes = q.select(F.explode(F.array("qname", "site")).alias("node")).distinct().withColumn("kind", F.when(F.col("node").startswith("site:"), "site").otherwise("name"))
    path = scratch(spark)
    X.write_graphml(nodes, q.toDF("src", "dst"), path)
    d = spark.read.text(path)
    part = lambda pattern: F.regexp_extract("value", pattern, 1)
    d = d.select(part('^<node id="([^"]*)"').alias("node"), part('<data key="kind">([^<]*)<').alias("kind"), part('^<edge source="([^"]*)"').alias("src"), part('target="([^"]*)"').alias("dst"))
    return d.where("node <> '' OR src <> ''").select(F.when(F.col("node") != "", F.col("node")).otherwise(F.col("src")).alias("node"), F.when(F.col("node") != "", F.col("kind")).otherwise(F.col("dst")).alias("what"))


def sink_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of gaps as CSV, read back, by milliseconds."""
    path = scratch(spark)
    X.write_counters(gap_histogram(spark, sf_dir).select("ms", "n"), path)
    return X.read_counters(spark, path, "ms bigint, n bigint").groupBy("ms").agg(F.sum("n").alias("n"))


def sink_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics table of results as CSV, and from it the series of good qualities by k; of each k only labels that every k has count, as the series want equal totals."""
    path = scratch(spark)
    s = stats_table(spark, sf_dir).where("k IS NOT NULL")
    X.write_counters(s, path)
    d = X.read_counters(spark, path, ", ".join(f"`{n}` {t}" for n, t in s.dtypes))
    good = [c for c in s.columns if c not in ("k", "true_domain", "reasons")]
    return d.groupBy("k").agg(*(F.sum(c).alias(c) for c in good), F.sum("reasons").alias("reasons"))


def host_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of queries written as `address:port` and read back: how many messages each has."""
    m = table(spark, sf_dir, "query_messages").dropDuplicates(["msg_id"]).where("query_address IS NOT NULL AND query_port IS NOT NULL")
    a = F.col("query_address")
    text: Column = F.concat(F.when(F.contains(a, F.lit(":")), F.concat(F.lit("["), a, F.lit("]"))).otherwise(a), F.lit(":"), F.col("query_port").cast("string"))
    return m.select(N.host_and_port(text).alias("e")).groupBy("e.host", "e.port").agg(F.count("*").alias("n"))


def fixed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a seventh of their values to four digits behind the point, as text."""
    return table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy(N.fixed_text(F.col("value") / 7).alias("bucket")).agg(F.count("*").alias("n"))


_LIST = (source_events, source_dns_streams, source_captures, source_sequences, source_labelled, source_label_lists, source_results, source_ranked, source_crawl_index, source_request_edges, source_log_reasons, source_timed, source_folders, source_event_files, event_order, sink_graphml, sink_counters, sink_statistics, host_ports, fixed_buckets)
QUERIES = {f.__name__: f for f in _LIST}

_WIRE = "CASE WHEN {0} IS NULL THEN NULL WHEN rtrim(lower({0}), '.') = '' THEN '.' ELSE array_to_string(list_filter(string_split(lower({0}), '.'), lambda x: x <> ''), '.') || '.' END"
_LEAST = "(16 + CASE WHEN rtrim({0}, '.') = '' THEN 1 ELSE length(array_to_string(list_filter(string_split({0}, '.'), lambda x: x <> ''), '.')) + 2 END)"


def _event_sql(side: str) -> str:
    q, n, t, i, z = (f"{side}_{c}" for c in ("time_ns", "qname", "qtype", "id", "size"))
    has = f"{n} IS NOT NULL AND {t} IS NOT NULL AND {i} IS NOT NULL"
    own = f"{q} AS {side}_time_ns, CASE WHEN {has} THEN {_WIRE.format(n)} END AS {side}_qname, CASE WHEN {has} THEN {t} END AS {side}_qtype, CASE WHEN {has} THEN {i} END AS {side}_id, CASE WHEN {has} THEN greatest({_LEAST.format(n)}, coalesce({z}, 0))::INT END AS {side}_size"
    other = ", ".join(f"NULL AS {('response' if side == 'query' else 'query')}_{c}" for c in ("time_ns", "qname", "qtype", "id", "size"))
    return f"SELECT DISTINCT ON (msg_id) msg_id, nullif(tap_identity, '') AS identity, nullif(tap_version, '') AS version, message_type, query_address, response_address, query_port, {_WIRE.format('query_zone')} AS query_zone, {own}, {other} FROM {side}_messages WHERE msg_id IS NOT NULL AND message_type IS NOT NULL"


_EDGE = """q AS (SELECT trace_id AS file, query_no % 3 AS kind, source, 'https://' || qname || '/' AS src, min('https://' || lower(true_domain) || '/') OVER (PARTITION BY trace_id) AS page FROM l WHERE trace_id IS NOT NULL AND qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL)"""

ORACLES = {
    "source_events": f"SELECT row_number() OVER (ORDER BY msg_id) - 1 AS place, * EXCLUDE (msg_id) FROM ({_event_sql('query')} UNION ALL BY NAME {_event_sql('response')})",
    "source_dns_streams": f"""
SELECT row_number() OVER (ORDER BY msg_id) - 1 AS place, greatest({_LEAST.format("response_qname")}, coalesce(response_size, 0))::INT AS size, {_WIRE.format("response_qname")} AS qname, response_qtype AS qtype, response_id AS qid
FROM (SELECT DISTINCT ON (msg_id) * FROM response_messages WHERE msg_id IS NOT NULL AND response_qname IS NOT NULL AND response_qtype IS NOT NULL AND response_id IS NOT NULL)
""",
    "source_captures": f"""
WITH r AS (SELECT DISTINCT ON (msg_id) msg_id, coalesce(query_port, 1) AS port, response_time_ns // 1000 AS t, response_size AS s FROM response_messages WHERE msg_id IS NOT NULL AND response_time_ns IS NOT NULL AND response_size IS NOT NULL
), n AS (SELECT *, row_number() OVER (ORDER BY msg_id) - 1 AS place FROM r)
SELECT place, (sum(CASE WHEN s > {SEGMENT} THEN 2 ELSE 1 END) OVER (PARTITION BY place // {FILE_ROWS} ORDER BY place))::INT AS packet_no, port AS receiver_port, t AS time_us, 'ApplicationData' AS message_type, s AS message_length FROM n
""",
    "source_sequences": f"WITH {LABELLED_SQL} SELECT seq_id, {_TXT.format('e')} AS sequence FROM labelled",
    "source_labelled": f"WITH {LABELLED_SQL} SELECT seq_id, true_domain, mapped_domain, {_TXT.format('e')} AS sequence FROM labelled",
    "source_label_lists": "SELECT domain, is_similar_to AS target, count(*) AS n FROM confusion_records WHERE domain <> '' AND is_similar_to <> '' AND NOT starts_with(ltrim(domain, ' '), '#') GROUP BY 1, 2",
    "source_results": f"""
WITH {_Q} SELECT m.seq_path AS id, m.k, m.label, m.reason, count(*) AS n, sum(coalesce(len(opts), 0))::BIGINT AS options, sum(coalesce(list_sum(list_transform(opts, lambda x: coalesce(x.count, 0))), 0))::BIGINT AS votes
FROM q JOIN m USING (record_id) GROUP BY 1, 2, 3, 4
""",
    "source_ranked": f"WITH {_L}, c AS (SELECT true_domain AS domain, count(*) AS n FROM l WHERE true_domain IS NOT NULL GROUP BY 1) SELECT (row_number() OVER (ORDER BY n DESC, domain))::INT AS rank, domain FROM c QUALIFY rank <= 100",
    "source_crawl_index": f"""
WITH {_L}, q AS (SELECT qname, min(s) AS s FROM l WHERE qname LIKE '%.%' AND s IS NOT NULL GROUP BY 1)
SELECT string_split(qname, '.')[-1] AS tld, count(*) AS pages, strftime(make_timestamp(min(s)), '%Y%m%d%H%M%S') AS first_stamp, min('https://' || qname || '/') AS first_url FROM q GROUP BY 1
""",
    "source_request_edges": f"""
WITH {_L}, {_EDGE}, e AS (
  SELECT file, page AS src, 'other' AS dst FROM q UNION SELECT file, page || unnest(['a.js', 'b.js']), page FROM q UNION SELECT file, src, CASE WHEN kind = 0 AND src = page THEN 'other' ELSE page END FROM q WHERE kind < 2 UNION SELECT file, src, page || unnest(['a.js', 'b.js']) FROM q WHERE kind = 2
) SELECT DISTINCT file, src, dst FROM e WHERE src <> dst
""",
    "source_log_reasons": f"WITH {_L}, {_EDGE} SELECT file, CASE WHEN NOT coalesce(bool_or(source = 'Forwarder'), false) THEN 'R009 No network response received.' END AS reason FROM q GROUP BY 1",
    "source_timed": SEQUENCES_SQL["seq_build_log2"],
    "source_folders": """
WITH e AS (SELECT DISTINCT ON (query_no) trace_id, true_domain FROM matched_queries WHERE source = 'Forwarder' AND trace_id IS NOT NULL AND end_time IS NOT NULL AND response_size >= 1
), t AS (SELECT trace_id, coalesce(min(true_domain), '_') AS label FROM e GROUP BY 1)
SELECT label, trace_id, (row_number() OVER (PARTITION BY label ORDER BY trace_id || '.json.xz') - 1)::INT AS ordinal FROM t
""",
    "source_event_files": f"""
WITH m AS ({" UNION ALL ".join(f"SELECT DISTINCT ON (msg_id) tap_identity || '/' || logged_at::DATE AS file, msg_id AS id, {_WIRE.format(f'{s}_qname')} AS n, {s}_qtype AS ty, {s}_id AS qid, coalesce(query_port, 0) AS port, {s}_time_ns AS ns, {i} AS side, greatest({_LEAST.format(f'{s}_qname')}, coalesce({s}_size, 0)) AS s FROM {s}_messages WHERE tap_identity IS NOT NULL AND message_type LIKE 'FORWARDER%' AND {s}_id IS NOT NULL AND {s}_qname IS NOT NULL AND {s}_qtype IS NOT NULL AND {s}_time_ns IS NOT NULL AND message_type LIKE '%{s.upper()}'" for i, s in enumerate(_SIDES))}
), w AS (SELECT *, lag(side) OVER (PARTITION BY file, n, ty, qid, port ORDER BY ns, side, id) AS before FROM m
), e AS (SELECT file, ns // 1000 AS t, s, id AS query_no FROM w WHERE side = 1 AND before = 0)
{sequence_sql("e", "file")}
""",
    "event_order": "SELECT msg_id, row_number() OVER (ORDER BY t, msg_id) - 1 AS place FROM (SELECT DISTINCT ON (msg_id) msg_id, query_time_ns AS t FROM query_messages WHERE message_type IS NOT NULL UNION ALL SELECT DISTINCT ON (msg_id) msg_id, response_time_ns FROM response_messages WHERE message_type IS NOT NULL) WHERE t IS NOT NULL AND msg_id IS NOT NULL",
    "sink_graphml": f"""
WITH {_L}, q AS (SELECT DISTINCT qname, 'site:' || true_domain AS site FROM l WHERE qname IS NOT NULL AND qname <> '' AND true_domain IS NOT NULL)
SELECT DISTINCT qname AS node, 'name' AS what FROM q UNION ALL SELECT DISTINCT site, 'site' FROM q UNION ALL SELECT qname, site FROM q
""",
    "sink_counters": f"SELECT ms, sum(n)::BIGINT AS n FROM ({TIMELINE_SQL['gap_histogram']}) GROUP BY 1",
    "sink_statistics": f"SELECT k, sum(COLUMNS(* EXCLUDE (k, true_domain)))::BIGINT FROM ({EVALUATION_SQL['stats_table']}) WHERE k IS NOT NULL GROUP BY 1",
    "host_ports": "SELECT query_address AS host, query_port AS port, count(*) AS n FROM (SELECT DISTINCT ON (msg_id) query_address, query_port FROM query_messages) WHERE query_address IS NOT NULL AND query_port IS NOT NULL GROUP BY 1, 2",
    "fixed_buckets": "SELECT printf('%.4f', value / 7) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
}
