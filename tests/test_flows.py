import struct

import pytest
from pyspark.sql import functions as F

from seqloom.functions.elements import codes, parse_codes
from seqloom.operators import flows as W
from seqloom.sources import text as X
from seqloom.sources.frames import dns_messages, read_dns_streams, selects_tls13
from seqloom.sources.load import kind_of, load_groups, load_sequences
from tests.test_sources import dns, field, frames, packet, varint


def test_endpoint(spark):
    rows = [("a", "s1", 853), ("a", "s2", 8853), ("a", "c", 4000), ("b", "s1", 853), ("b", "s2", 853), ("c", "s2", 8853), ("c", "s2", 8853), ("d", "x", 1), ("d", "y", 2), ("e", None, 853), ("e", "z", None)]
    df = spark.createDataFrame(rows, "f string, sender string, sender_port int")
    want = {("a", "s1", 853, 1), ("b", None, None, 2), ("c", "s2", 8853, 1), ("d", None, None, 2)}
    assert {tuple(r) for r in W.server_endpoint(df, ["f"]).collect()} == want
    assert W.server_endpoint(df.where("f = 'a'"), ["f"], strict=True).collect()[0].server == "s1"
    with pytest.raises(Exception, match="2 candidates"):
        W.server_endpoint(df, ["f"], strict=True).collect()


HEAD = [(True, "ChangeCipherSpec", 1), (False, "ApplicationData", 500), (False, "ChangeCipherSpec", 1), (False, "ApplicationData", 200), (True, "ApplicationData", 400), (True, "ApplicationData", 150), (False, "ApplicationData", 130)]
BODY = [(True, "ApplicationData", 301), (True, "ApplicationData", 302), (False, "ApplicationData", 131), (True, "Alert", 303), (True, "ApplicationData", 50), (True, "ApplicationData", 304), (True, "ApplicationData", None), (None, "ApplicationData", 305)]
END = [(True, "ApplicationData", 306), (False, "ApplicationData", 384), (True, "ApplicationData", 999)]


def test_answers(spark):
    flows = {"open": HEAD + BODY, "ended": HEAD + BODY + END, "new": HEAD + BODY + END, "no start": HEAD[:-1] + BODY[:2], "none": BODY, "at once": HEAD + END[1:]}
    rows = [(f, i, *r) for f, v in flows.items() for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "f string, i int, srv boolean, message_type string, message_length int").repartition(5)
    # a hello of the new version anywhere in the connection
    out = W.resolver_answers(df, ["f"], ["i"], F.col("srv"), tls13=(F.col("f") == "new") & (F.col("i") == 0))
    got: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r.f, r.i)):
        got.setdefault(r.f, []).append(r.message_length)
    assert got == {"open": [302, 50, 304, None], "ended": [302, 50, 304, None], "new": [302, 304]}
    assert out.columns == df.columns
    assert [r.p for r in df.where("f = 'none' AND i < 2").select(W.dns_payload(F.lit(39)).alias("p")).collect()] == [0, 0]
    d = df.limit(1).select(W.two_way_flow(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)).alias("x"), W.two_way_flow(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)).alias("y"), W.two_way_flow(F.lit("a"), F.lit(None), F.lit("b"), F.lit(1)).alias("z")).collect()[0]
    assert d.x == d.y == "a:2-b:1" and d.z is None


def test_problems(spark):
    def events(f, qs, qe, rs, re):
        return [(f, "CLIENT_QUERY", "s")] * qs + [(f, "CLIENT_QUERY", "e")] * qe + [(f, "CLIENT_RESPONSE", "s")] * rs + [(f, "CLIENT_RESPONSE", "e")] * re + [(f, None, None), (f, "STUB_QUERY", "s")]

    rows = events("ok", 3, 1, 1, 1) + events("a", 0, 1, 1, 1) + events("b", 1, 2, 1, 1) + events("c", 1, 1, 0, 1) + events("d", 1, 1, 1, 3)
    df = spark.createDataFrame(rows, "f string, message_type string, name string")
    got = {r.f: r.problem for r in W.capture_problem(df, ["f"], F.col("name") == "s", F.col("name") == "e").collect()}
    assert got == {"ok": None, "a": "0 start queries", "b": "2 end queries", "c": "0 start responses", "d": "3 end responses"}
    q = spark.createDataFrame([("x", "Forwarder", "A"), ("y", "Client", "A"), ("y", None, None)], "t string, source string, qtype string")
    t = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "t string")
    assert {tuple(r) for r in W.lookup_problem(t, q, ["t"]).collect()} == {("x", None), ("y", "no A lookup of the forwarder"), ("z", "no lookup")}


def test_dns_streams(spark, tmp_path):
    m = dns(7, "a.example", 28)
    data = b"".join(struct.pack(">H", len(x)) + x for x in (m, b"", b"xy"))
    assert list(dns_messages(data + b"\0\x09abc")) == [m, b"", b"xy"] and list(dns_messages(b"")) == []
    (tmp_path / "s.bin").write_bytes(data)
    assert [tuple(r)[1:] for r in read_dns_streams(spark, str(tmp_path)).orderBy("message_no").collect()] == [(0, len(m), "a.example.", "AAAA", 7), (1, 0, None, None, None), (2, 2, None, None, None)]


def hello(version):
    ext = struct.pack(">HH", 51, 2) + b"ab" + struct.pack(">HH", 43, 2) + version
    body = b"\x03\x03" + b"r" * 32 + b"\x04sess" + b"\x13\x01\0" + struct.pack(">H", len(ext)) + ext
    return b"\x02" + struct.pack(">I", len(body))[1:] + body


def test_version():
    assert selects_tls13(hello(b"\x03\x04")) and not selects_tls13(hello(b"\x03\x03"))
    assert not any(selects_tls13(x) for x in (b"", b"\x01abc", b"\x02abc", hello(b"\x03\x04")[:59]))


def forwarded(side, qid, name, sec, size):
    """A forwarder's query (7) or response (8)."""
    body = dns(qid, name, 1)
    body += b"\0" * (size - len(body))
    times = field(8, sec) + field(10, body) if side == "query" else field(12, sec) + field(14, body)
    m = field(1, 7 if side == "query" else 8) + field(6, 5353) + times
    return field(1, b"tap") + field(14, m) + varint(15 << 3) + varint(1)


def test_load(spark, tmp_path):
    assert [kind_of(x) for x in ("a/b.dnstap.xz", "b.pcap", "c.dnstap.json", "d.json.xz", "e", "x.pcap/e")] == ["dnstap", "pcap", "json", "json", "dnstap", "dnstap"]
    (tmp_path / "x.dnstap").write_bytes(frames(forwarded("query", 1, "A.example", 10, 40), forwarded("response", 1, "a.Example", 11, 400), forwarded("query", 2, "b.example", 11, 40), forwarded("response", 2, "b.example", 13, 500), forwarded("response", 9, "z.example", 14, 100)))
    text = lambda d: [(r.seq_id.rsplit("/", 1)[-1], " ".join(r.c)) for r in d.select("seq_id", codes(F.col("elems")).alias("c")).orderBy("seq_id").collect()]
    # two seconds are 1999 times a millisecond with at most one left
    assert text(load_sequences(spark, str(tmp_path / "x.dnstap"))) == [("x.dnstap", "S01 G10 S02")]
    a, b = ((10, 0, 0, 1), 853), ((10, 0, 0, 2), 4000)
    record = lambda kind, n: bytes([kind, 3, 3]) + struct.pack(">H", n) + b"x" * n
    cap, seq = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), {True: 1, False: 1}
    for i, (srv, n, kind) in enumerate([(True, 1, 20), (False, 1, 20), (True, 400, 23), (False, 130, 23), (True, 301, 23), (True, 500, 23), (True, 1000, 23)]):
        r = record(kind, n)
        cap += packet(*(a if srv else b), *(b if srv else a), seq[srv], r, i)
        seq[srv] += len(r)
    (tmp_path / "y.pcap").write_bytes(cap)
    assert text(load_sequences(spark, str(tmp_path / "y.pcap"))) == [("y.pcap", "S01 G09 S03")]
    df = spark.createDataFrame([("f", ["S01", "G8"])], "seq_id string, c array<string>")
    X.write_sequences(df.select("seq_id", parse_codes(F.col("c")).alias("elems")), str(tmp_path / "z.json"))
    with pytest.raises(ValueError):
        load_sequences(spark, str(tmp_path / "z.json"), mode="ident")
    got = load_groups(spark, [str(tmp_path / "z.json"), str(tmp_path / "*.dnstap")])
    assert {(r.group_no, r.seq_id.rsplit("/", 1)[-1]) for r in got.collect()} == {(0, "f"), (1, "x.dnstap")}


def test_sinks(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([("f", "a", "b", ["S01", "g8"]), ("empty", None, None, []), (None, "a", "b", ["S01"])], "seq_id string, true_domain string, mapped_domain string, c array<string>")
    X.write_labelled(df.select("seq_id", "true_domain", "mapped_domain", parse_codes(F.col("c")).alias("elems")), p("l"))
    assert {(r.seq_id, r.true_domain, r.mapped_domain, tuple(r.c)) for r in X.read_labelled(spark, p("l")).select("*", codes(F.col("elems")).alias("c")).collect()} == {("f", "a", "b", ("S01", "G08")), ("empty", None, None, ())}
    m = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "domain string, target string")
    assert {tuple(r) for r in X.unique_labels(m).collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(Exception, match="more than one target for a"):
        X.unique_labels(m.union(m.where("domain = 'a'"))).collect()
    X.write_shards(spark.createDataFrame([(1, "u"), (2, "v"), (2, None)], "s int, url string"), p("s"), "s", "url")
    assert {tuple(r) for r in spark.read.text(p("s")).select("s", "value").collect()} == {(1, "u"), (2, "v")}
