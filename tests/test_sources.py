import json
import lzma
import struct
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqloom.functions.elements import codes
from seqloom.sources import text as X
from seqloom.functions import names as N
from seqloom.operators import stats as S
from seqloom.sources.frames import DNSTAP_CONTENT_TYPE, FrameError, _name, decode_event, dns_question, encode_event, frame_stream, iter_frames, labelled_files, read_events, read_tls_records, tls_records


def frames(*bodies, content=DNSTAP_CONTENT_TYPE, stop=True):
    start = struct.pack(">II", 2, 1) + struct.pack(">I", len(content)) + content
    out = struct.pack(">II", 0, len(start)) + start + b"".join(struct.pack(">I", len(b)) + b for b in bodies)
    return out + (struct.pack(">III", 0, 4, 3) if stop else b"")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(no, value):
    if isinstance(value, bytes):
        return varint(no << 3 | 2) + varint(len(value)) + value
    return varint(no << 3) + varint(value)


def dns(qid, name, kind):
    return struct.pack(">HHHHHH", qid, 0, 1, 0, 0, 0) + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".") if x) + b"\0" + struct.pack(">HH", kind, 1)


def event(qid=7, name="a.example.", kind=28):
    m = field(1, 5) + field(4, bytes([192, 0, 2, 1])) + field(5, b"\x20\x01\x0d\xb8" + b"\0" * 11 + b"\1") + field(6, 5353) + field(8, 1_500_000_000) + varint(9 << 3 | 5) + struct.pack("<I", 42) + field(10, dns(qid, name, kind))
    return field(1, b"tap") + field(14, m) + field(15, 1)


def test_frames():
    bodies = [f"Hello, world #{i}".encode() for i in range(10)]
    assert list(iter_frames(frames(*bodies), DNSTAP_CONTENT_TYPE)) == bodies == list(iter_frames(frames(*bodies, stop=False)))
    assert list(iter_frames(b"")) == []
    for bad in (frames(content=b"other"), frames(b"x")[:-14], frames() [:-12] + frames(), struct.pack(">III", 0, 4, 9), struct.pack(">II", 0, 2)):
        with pytest.raises(FrameError):
            list(iter_frames(bad, DNSTAP_CONTENT_TYPE))


def test_events(spark, tmp_path):
    (tmp_path / "site.example").mkdir()
    (tmp_path / "site.example" / "1.dnstap").write_bytes(frames(event(), b"\xff\xff", event(8, ".", 999)))
    (tmp_path / "site.example" / "2.dnstap").write_bytes(frames(event(9), event())[:-20])
    rows = read_events(spark, str(tmp_path), permissive=True).orderBy("path", "frame_no").collect()
    assert [(r.frame_no, r.query_qname, r.query_qtype, r.query_id) for r in rows] == [(0, "a.example.", "AAAA", 7), (2, ".", "TYPE999", 8), (0, "a.example.", "AAAA", 9)]
    assert rows[0].query_time_ns == 1_500_000_000_000_000_042 and rows[0].response_address == "2001:db8::1" and rows[0].message_type == "CLIENT_QUERY" and rows[0].response_time_ns is None
    assert [(r.label, r.ordinal) for r in labelled_files(spark, str(tmp_path), ".dnstap").orderBy("path").collect()] == [("site.example", 0), ("site.example", 1)]
    assert decode_event(b"") is None and decode_event(field(14, field(1, 99))) is None


def packet(src, sport, dst, dport, seq, body, time, flags=16):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 40 + len(body), 0, 0, 64, 6, 0, bytes(src), bytes(dst))
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0, 0, 0)
    data = b"\0" * 12 + b"\x08\x00" + ip + tcp + body
    return struct.pack("<IIII", time, 5, len(data), len(data)) + data


def test_tls(spark, tmp_path):
    a, b = ((10, 0, 0, 1), 853), ((10, 0, 0, 2), 4000)
    record = lambda kind, n: bytes([kind, 3, 3]) + struct.pack(">H", n) + b"x" * n
    stream = record(22, 100) + record(23, 300)
    top = 0xFFFFFFF0  # the sequence numbers wrap
    cap = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    cap += packet(*a, *b, top - 1, b"", 1, 2) + packet(*a, *b, (top + 200) % 2**32, stream[200:], 3) + packet(*a, *b, top, stream[:200], 2) + packet(*a, *b, top, stream[:200], 4) + packet(*b, *a, 1, record(23, 9), 5)
    want = [(3, "10.0.0.1", 853, "10.0.0.2", 4000, 2_000_005, "Handshake", 100, 0, False), (3, "10.0.0.1", 853, "10.0.0.2", 4000, 2_000_005, "ApplicationData", 300, 1, False), (5, "10.0.0.2", 4000, "10.0.0.1", 853, 5_000_005, "ApplicationData", 9, 2, False)]
    assert list(tls_records(cap)) == want
    (tmp_path / "x.pcap.xz").write_bytes(lzma.compress(cap))
    assert [tuple(r)[1:] for r in read_tls_records(spark, str(tmp_path)).orderBy("record_no").collect()] == want
    cut = packet(*b, *a, 15, record(23, 9), 6)
    fragment, other = bytearray(cut), bytearray(cut)
    fragment[16 + 20], other[16 + 12 : 16 + 14] = 0x20, b"\x86\xdd"
    short = cut[:8] + struct.pack("<II", 60, 68) + cut[16 : 16 + 60]
    for bad in (b"\0\0\0", cut[:-1], bytes(fragment), bytes(other), short):
        with pytest.raises(FrameError):
            list(tls_records(cap + bad))
    (tmp_path / "x.pcap.xz").write_bytes(lzma.compress(cap + bytes(other)))
    assert read_tls_records(spark, str(tmp_path), permissive=True).count() == 3


def test_text(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([("f", ["S01", "g8", "S255", "G12345"]), ("empty", []), ("bad", ["S999"])], "seq_id string, c array<string>")
    from seqloom.functions.elements import parse_codes

    X.write_sequences(df.select("seq_id", parse_codes(F.col("c")).alias("elems")), p("seq"))
    assert {r.seq_id: r.c for r in X.read_sequences(spark, p("seq")).select("seq_id", codes(F.col("elems")).alias("c")).collect()} == {"f": ["S01", "G08", "S255", "G12345"], "empty": [], "bad": []}
    Path(p("list.csv")).write_text("# domain,x\na.example,b.example\n #c,d\ne.example\n")
    assert [tuple(r) for r in X.read_label_lists(spark, p("list.csv")).collect()] == [("a.example", "b.example")]
    Path(p("rank.csv")).write_text("2,b\n1,a\n3,c\n")
    assert [r.domain for r in X.read_ranked(spark, p("rank.csv"), 2).collect()] == ["a", "b"]
    Path(p("cdx")).write_text('com,a)/ 2018 {"url": "http://a.com/", "status": "200"}\nbroken\n')
    assert [tuple(r) for r in X.read_crawl_index(spark, p("cdx")).collect()] == [("com,a)/", "2018", "http://a.com/", 200)]
    ask = lambda url, initiator, **more: {"method": "Network.requestWillBeSent", "params": {"documentURL": "http://p/", "request": {"url": url} | more, "initiator": initiator}}
    log = [
        {"method": "Target.targetInfoChanged", "params": {"targetInfo": {"type": "page", "url": "http://t/"}}}, {"method": "Target.targetInfoChanged", "params": {"targetInfo": {"type": "worker", "url": "http://w/"}}},
        ask("http://p/", {"type": "other"}), ask("http://p/early", {"type": "parser", "url": "http://p/a.js"}), ask("http://r/", {"type": "other"}), ask("http://p/icon", {"type": "other"}, headers={"Referer": "http://x/"}),
        {"method": "Network.requestWillBeSent", "params": {"documentURL": "http://p/", "request": {"url": "http://p/a.js"}, "initiator": {"type": "parser", "url": "http://p/"}}},
        ask("http://p/c.js", {"type": "script", "url": "http://p/a.js"}), {"method": "Network.webSocketCreated", "params": {"url": "wss://s/", "initiator": {"type": "script", "stack": {"callFrames": [{"url": "http://p/a.js"}]}}}},
        {"method": "Network.webSocketCreated", "params": {"url": "wss://o/", "initiator": {"type": "other"}}},
        {"method": "Network.requestWillBeSent", "params": {"documentURL": "http://p/", "request": {"url": "http://q/b"}, "redirectResponse": {"url": "http://r/"}, "initiator": {"type": "script", "stack": {"callFrames": [{"url": "http://p/a.js"}, {"url": ""}], "parent": {"callFrames": [{"url": "http://p/c.js"}]}}}}},
        {"method": "Network.requestWillBeSent", "params": {"request": {"url": "data:x"}, "initiator": {"type": "other"}}},
    ]
    Path(p("log.json")).write_text(json.dumps(log))
    d = X.read_browser_log(spark, p("log.json"))
    want = {("http://p/a.js", "http://p/"), ("http://q/b", "http://p/a.js"), ("http://q/b", "http://p/c.js"), ("http://q/b", "http://r/"), ("http://t/", "other"), ("http://p/", "other"), ("http://p/icon", "http://p/"), ("http://p/c.js", "http://p/a.js"), ("wss://s/", "http://p/a.js")}
    assert {(r.src, r.dst) for r in X.request_edges(d).collect()} == want  # http://p/early names a URL that comes later, http://r/ has no referrer
    assert X.log_reason(d).collect()[0].reason.startswith("R009")
    nodes = spark.createDataFrame([("a&b", "x<y"), ("c", None)], "node string, domain string")
    X.write_graphml(nodes, spark.createDataFrame([("a&b", "c")], "src string, dst string"), p("g"))
    root = ET.fromstring("".join(f.read_text() for f in sorted(Path(p("g")).glob("part-*"))))
    assert len(root.findall(".//{*}node")) == 2 and root.find(".//{*}edge").get("source") == "a&b"


def test_edges_of_deep_stacks_and_inline_scripts(spark, tmp_path):
    frame = lambda url, script: {"url": url, "scriptId": script}
    stack = lambda *levels: {"callFrames": [frame(*x) for x in levels[0]]} | ({"parent": stack(*levels[1:])} if levels[1:] else {})
    parsed = lambda script, url, s, kind="scriptParsed": {"method": f"Debugger.{kind}", "params": {"scriptId": script, "url": url} | ({"stackTrace": s} if s else {})}
    request = lambda url, s: {"method": "Network.requestWillBeSent", "params": {"documentURL": "http://p/", "request": {"url": url}, "initiator": {"type": "script", "stack": s}}}
    seen = lambda *urls: [{"method": "Target.targetInfoChanged", "params": {"targetInfo": {"type": "page", "url": u}}} for u in urls]
    log = seen(*(f"http://p/{x}.js" for x in (1, 2, 3, 5, *(f"d{i}" for i in range(5))))) + [
        parsed("1", "", stack([("http://p/1.js", "9")], [], [("http://p/2.js", "8")])), parsed("2", "", stack([("", "1")], [("http://p/3.js", "7")]), "scriptFailedToParse"),
        parsed("3", "", stack([("", "2"), ("", "3")])), parsed("4", "", None), parsed("5", "extensions::x", stack([("http://p/5.js", "6")])),
        request("http://q/deep", stack(*[[(f"http://p/d{i}.js", "9")] for i in range(5)])), request("http://q/inline", stack([("", "3")])), request("http://q/none", stack([("", "4"), ("", "5"), ("", "77")])), request("http://q/late", stack([], [], [("", "1")])),
    ]
    (tmp_path / "a.json").write_text(json.dumps(log))
    # ids of scripts count within their own log
    (tmp_path / "b.json").write_text(json.dumps(seen("http://o/") + [parsed("3", "", stack([("http://o/", "1")])), request("http://q/other", stack([("", "3")]))]))
    got = {(r.src[9:], r.dst) for r in X.request_edges(X.read_browser_log(spark, str(tmp_path))).collect() if r.dst != "other"}
    want = {("deep", f"http://p/d{i}.js") for i in range(5)} | {("inline", f"http://p/{i}.js") for i in (1, 2, 3)} | {("late", "http://p/1.js"), ("late", "http://p/2.js"), ("other", "http://o/")}
    assert got == want


def test_names_with_pointers():
    data = dns_question(1, "a.example", "A") + b"\1b\xc0\x0c" + b"\xc0\x1d"
    assert _name(data, 12) == ("a.example.", 23) and _name(data, 27) == ("b.a.example.", 31)
    for bad in (b"\xc0\x00", b"\xc0\x02\xc0\x00", b"\x50abc", b"\x05ab"):
        with pytest.raises((ValueError, IndexError)):
            _name(bad)


def test_event_round_trip():
    e = {"identity": "tap", "version": None, "message_type": "FORWARDER_RESPONSE", "query_address": "2001:db8::1", "query_port": 53, "response_time_ns": 1_551_876_824_836_350_654, "response_qname": "a.example.", "response_qtype": "TYPE65000", "response_id": 9, "response_size": 99, "query_zone": "example."}
    got = decode_event(encode_event(e))
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in e.items() if v is not None}
    assert list(iter_frames(frame_stream([b"x", b"yy"]), DNSTAP_CONTENT_TYPE)) == [b"x", b"yy"]


def test_packed_lines(spark, tmp_path):
    p = tmp_path / "s.json.xz"
    p.write_bytes(lzma.compress(b'{"a": ["S01"]}\n{"b": []}\n'))
    assert {r.seq_id for r in X.read_sequences(spark, str(p)).collect()} == {"a", "b"}


def test_reports_of_other_programs(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    table = X.LOG_TABLE + "head\n----\n====\n" + "\n".join(f"{q} │ " + " │ ".join(str(i + j) for j in range(11)) for i, q in enumerate("abcd")) + "\nrest\n"
    Path(p("log")).write_text("before\n" + table + table)
    rows = X.read_log_tables(spark, p("log")).orderBy("table_no", "line_no").collect()
    assert [(r.table_no, r.line_no, r.quality, r.counts[0]) for r in rows] == [(t, i, q, 3 - i) for t in (0, 1) for i, q in enumerate("dcba")] and len(rows[0].counts) == 11
    Path(p("bad")).write_text(table.replace(" │ 10", ""))
    with pytest.raises(Exception, match="no line of 11 or 21"):
        X.read_log_tables(spark, p("bad")).collect()
    run = "runs/2019-01-01T00:00:00+00:00{'layers': 2, 'hidden_size': 3, 'epochs': 4, 'optimizer': <class 'keras.Adam'>, 'x': None}.csv"
    texts = spark.createDataFrame([(run, "val_loss,acc\n0.5,0.25\n0.25,NA\n0.75,0.5\n")], "file string, value string")
    got = {r.measure: r for r in X.training_runs(texts).collect()}
    assert got["val_loss"].best == 0.25 and got["acc"].best == 0.5 and got["acc"].stamp.startswith("2019-01-01T00") and got["acc"].settings["effort"] == "24" and got["acc"].settings["optimizer"] == "keras.Adam"
    Path(p("pkt.json")).write_text(json.dumps([{"_source": {"layers": {"frame": {"frame.number": "7"}, "dns": {"Queries": {"a: type A": {"dns.qry.name": "a"}}}}}}]))
    assert [(r.frame_no, r.qname) for r in X.read_dissections(spark, p("pkt.json")).collect()] == [(7, "a")]
    Path(p("ignore.csv")).write_text("file,reason\nx/a-1-2.dnstap.xz,r\nx/a-1-2.dnstap,r\n")
    assert [r.stem for r in X.read_ignored(spark, p("ignore.csv")).collect()] == ["a-1-2"]
    stats = spark.createDataFrame([("1", *range(1, 9)), ("1", *[0] * 8), ("3", 8, 7, 6, 5, 4, 3, 2, 1)], "k string, a int, aw int, b int, bw int, c int, cw int, d int, dw int")
    assert sorted((r.k, r.position, r.n) for r in X.quality_series(stats, stats.columns[1:]).collect()) == [("1", 0, 15), ("3", 0, 3)]
    with pytest.raises(Exception, match="not as many traces"):
        X.quality_series(stats.unionByName(stats.limit(1)), stats.columns[1:]).collect()


def test_small_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).collect()[0].v
    at = lambda t: one(N.host_and_port(F.lit(t)))
    assert tuple(at("[2001:db8::1]:53")) == ("2001:db8::1", 53) and tuple(at("a.example:853")) == ("a.example", 853) and at("2001:db8::1:53") is None and at("a:70000") is None and at("a") is None and at(None) is None
    assert one(N.fixed_text(F.lit(1.23456))) == "1.2346"
    assert one(N.scrubbed(F.lit('  "scriptId": "17", "x": 1'))) == '  "scriptId": "", "x": 1' and one(N.scrubbed(F.lit('"wallTime": 12.5,'))) == '"wallTime": 0,'
    pairs = spark.createDataFrame([("a", "b"), ("www.b", "a"), (None, "c")], "t string, p string")
    assert sorted(((r.t, r.p, r.t_no, r.p_no) for r in S.indexed_labels(pairs, "t", "p", same={"www.b": "b"}).collect()), key=str) == sorted([("a", "b", 0, 1), ("b", "a", 1, 0), (None, "c", None, 2)], key=str)
    f = spark.createDataFrame([(10, [1, 2, 1, 1, 3, 1])], "bytes int, runs array<int>")
    assert [tuple(r) for r in S.corrected(f, {"bytes": 4}, "runs", 3).collect()] == [(6, [2, 3, 1])]
