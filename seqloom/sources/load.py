"""Sequences from files of any known kind, chosen by the ending of their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.flows import dns_payload, resolver_answers, server_endpoint
from seqloom.operators.sequences import build_sequences
from seqloom.operators.timeline import match_responses
from seqloom.session import materialize
from seqloom.sources.frames import contents, read_events, read_tls_records
from seqloom.sources.text import read_sequences, timed_rows

KINDS = ("dnstap", "pcap", "json")


def kind_of(path: str) -> str:
    """dnstap, pcap or json by the path's endings, read from the last to the first; dnstap if none of them is known."""
    return next((p for p in reversed(path.lower().rsplit("/", 1)[-1].split(".")) if p in KINDS), "dnstap")


def timed_messages(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """path, time_us, size, tie: the forwarder's answers in event logs, the resolver's answers in packet captures, or what JSON of timed messages holds."""
    kind = kind or kind_of(path)
    if kind == "dnstap":
        e = materialize(read_events(spark, path, permissive=True).where("message_type LIKE 'FORWARDER%'"))  # three look-ups follow
        sides = [e.where(F.col("message_type").endswith(s.upper())).select("path", F.lower(f"{s}_qname").alias("qname"), F.col(f"{s}_qtype").alias("qtype"), F.col(f"{s}_id").alias("qid"), F.coalesce("query_port", F.lit(0)).alias("port"), F.col(f"{s}_time_ns").alias("t"), F.col("frame_no").alias("id")) for s in ("query", "response")]
        sizes = e.where("response_size IS NOT NULL").select("path", F.col("frame_no").alias("response_id"), F.col("response_size").alias("size"))
        m = match_responses(*sides, ["path", "qname", "qtype", "qid", "port"]).join(sizes, ["path", "response_id"])
        return m.select("path", F.expr("end div 1000").alias("time_us"), "size", F.col("response_id").alias("tie"))
    if kind == "pcap":
        r = read_tls_records(spark, path)
        s = server_endpoint(r, ["path"], strict=True).select("path", "server", "server_port")
        d = r.join(s, "path").withColumn("srv", (F.col("sender") == F.col("server")) & (F.col("sender_port") == F.col("server_port")))
        d = d.withColumn("flow", F.when(F.col("srv"), F.concat_ws(":", "receiver", "receiver_port")).otherwise(F.concat_ws(":", "sender", "sender_port")))
        a = resolver_answers(d, ["path", "flow"], ["record_no"], F.col("srv"), tls13=F.col("tls13"))
        return a.select("path", "time_us", dns_payload(F.col("message_length")).alias("size"), F.col("record_no").alias("tie"))
    if kind == "json":
        return timed_rows(contents(spark, path)).where("NOT is_dummy").select("path", "time_us", "size", "tie")
    raise ValueError(f"{kind} files hold no timed messages")


def load_sequences(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """seq_id, elems of the files that a path or pattern names: built by build_sequences with its options, or read as they are from JSON, which takes no options."""
    kind = kind or kind_of(path)
    if kind == "json":
        if options:
            raise ValueError("sequences in JSON are already built")
        return read_sequences(spark, path)
    return build_sequences(timed_messages(spark, path, kind), "path", "time_us", "size", "tie", **options).withColumnRenamed("path", "seq_id")


def load_groups(spark: SparkSession, patterns: list[str], **options) -> DataFrame:
    """group_no, seq_id, elems: the sequences of each pattern, numbered by its place in the list."""
    return reduce(DataFrame.unionByName, (load_sequences(spark, p, **options).select(F.lit(i).alias("group_no"), "seq_id", "elems") for i, p in enumerate(patterns)))
