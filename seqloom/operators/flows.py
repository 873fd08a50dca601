"""Records of encrypted connections and checks of captures: flows, the resolver's end, its answers, what a capture lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ports of DNS over TLS in the order they are tried, the block queries are padded to, the least size of a large marker query, and
# what a TLS record adds to the DNS message in it.
TLS_PORTS = (853, 8853)
BLOCK, LARGE_MARKER = 128, 384
RECORD_OVERHEAD = 40


def two_way_flow(sender: Column, sender_port: Column, receiver: Column, receiver_port: Column) -> Column:
    """One text for both directions of a connection; null if an end is."""
    a, b = F.concat(sender, F.lit(":"), sender_port.cast("string")), F.concat(receiver, F.lit(":"), receiver_port.cast("string"))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.lit("-"), F.greatest(a, b)))


def dns_payload(length: Column) -> Column:
    """The size of the DNS message in a record, at least 0."""
    return F.greatest(length - RECORD_OVERHEAD, F.lit(0))


def server_endpoint(records: DataFrame, by: list[str], *, strict: bool = False) -> DataFrame:
    """Who the resolver of each capture is: by, server, server_port, candidates.

    records: by, sender, sender_port. It is the only sender on the first of TLS_PORTS that anyone sends from. Where several send from it or nobody from any of
    them, server is null and candidates tells how many there are; strict fails the query instead.
    """
    ends = records.where("sender IS NOT NULL AND sender_port IS NOT NULL").select(*by, "sender", "sender_port").distinct()
    counts = [F.count_if(F.col("sender_port") == p).alias(f"n{p}") for p in TLS_PORTS]
    first = [F.min(F.when(F.col("sender_port") == p, F.col("sender"))).alias(f"s{p}") for p in TLS_PORTS]
    g = ends.groupBy(*by).agg(F.count("*").alias("n"), *counts, *first)
    name = port = None
    number = F.col("n")
    for p in reversed(TLS_PORTS):
        one, some = F.col(f"n{p}") == 1, F.col(f"n{p}") > 0
        name = F.when(one, F.col(f"s{p}")).when(~some, name)
        port = F.when(one, F.lit(p)).when(~some, port)
        number = F.when(some, F.col(f"n{p}")).otherwise(number)
    g = g.select(*by, name.alias("server"), port.cast("int").alias("server_port"), number.alias("candidates"))
    if strict:
        g = g.withColumn("server", F.when(F.col("server").isNotNull(), F.col("server")).otherwise(F.raise_error(F.concat(F.col("candidates").cast("string"), F.lit(" candidates for the server"))).cast("string")))
    return g


def resolver_answers(records: DataFrame, flow: list[str], order: list[str], from_server: Column, *, tls13: Column | None = None) -> DataFrame:
    """The resolver's answers between the marker queries of each connection.

    records: flow, order, message_type, message_length. In the order of a flow: nothing counts until both sides have sent ChangeCipherSpec; then until the server
    sends a large record, then until the client sends one of BLOCK to 2 * BLOCK bytes, the start marker. From there on the server's
    ApplicationData records count, but for the first, up to the client's next large record, the end marker; if that was seen, the last one before it goes too. Where tls13 holds,
    records shorter than BLOCK are left out before that. Null flags are false, and a null length is none of these.
    """
    d = records.withColumn("_srv", F.coalesce(from_server, F.lit(False))).withColumn("_new", F.coalesce(tls13 if tls13 is not None else F.lit(False), F.lit(False)))
    w = Window.partitionBy(*flow).orderBy(*order)
    seen = lambda c: F.max(F.coalesce(c, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size, change = F.col("message_length"), F.col("message_type") == "ChangeCipherSpec"
    d = d.withColumn("_a", seen(change & F.col("_srv")) & seen(change & ~F.col("_srv")))
    d = d.withColumn("_b", seen(F.col("_a") & F.col("_srv") & (size >= LARGE_MARKER)))
    d = d.withColumn("_c", seen(F.col("_b") & ~F.col("_srv") & size.between(BLOCK, 2 * BLOCK)))
    d = d.withColumn("_d", seen(F.col("_c") & ~F.col("_srv") & (size >= LARGE_MARKER)))
    whole = Window.partitionBy(*flow)
    d = d.withColumn("_end", F.max("_d").over(whole)).withColumn("_new", F.max("_new").over(whole))
    d = d.where("_c AND NOT _d AND _srv AND message_type = 'ApplicationData'").withColumn("_i", F.row_number().over(w)).where("_i > 1")
    d = d.where(~F.col("_new") | (size >= BLOCK)).withColumn("_i", F.lead(F.lit(1)).over(w)).where("NOT _end OR _i IS NOT NULL")
    return d.drop("_srv", "_new", "_a", "_b", "_c", "_d", "_end", "_i")


def capture_problem(events: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """What each capture's client messages lack: by, problem, null where nothing does.

    events: by, message_type. Wanted: a query or more for the start marker, and exactly one query for the end marker, one answer for the
    start and one for the end marker, reported in this order.
    """
    of = lambda kind, mark: F.count_if((F.col("message_type") == kind) & F.coalesce(mark, F.lit(False)))
    g = events.groupBy(*by).agg(of("CLIENT_QUERY", start).alias("qs"), of("CLIENT_QUERY", end).alias("qe"), of("CLIENT_RESPONSE", start).alias("rs"), of("CLIENT_RESPONSE", end).alias("re"))
    said = lambda what, n: F.concat(n.cast("string"), F.lit(f" {what}"))
    problem = F.when(F.col("qs") == 0, said("start queries", F.col("qs"))).when(F.col("qe") != 1, said("end queries", F.col("qe"))).when(F.col("rs") != 1, said("start responses", F.col("rs"))).when(F.col("re") != 1, said("end responses", F.col("re")))
    return g.select(*by, problem.alias("problem"))


def lookup_problem(traces: DataFrame, lookups: DataFrame, by: list[str]) -> DataFrame:
    """What each trace's matched lookups lack: any at all, or an A lookup of the forwarder; problem is null where nothing is missing.

    traces: by; lookups: by, source, qtype.
    """
    a = F.coalesce((F.col("source") == "Forwarder") & (F.col("qtype") == "A"), F.lit(False))
    g = lookups.groupBy(*by).agg(F.max(a).alias("_a"))
    problem = F.when(F.col("_a").isNull(), "no lookup").when(~F.col("_a"), "no A lookup of the forwarder")
    return traces.select(*by).distinct().join(g, by, "left").select(*by, problem.alias("problem"))
