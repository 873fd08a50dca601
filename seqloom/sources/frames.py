"""Binary logs: length-prefixed frames, the DNS events in them, and TLS records of packet captures."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.order import group_numbers

# Fixed values of the frame format: a zero length announces a control frame, whose first word is its kind.
CONTROL, START, STOP, CONTENT_TYPE_FIELD = 0, 2, 3, 1
DNSTAP_CONTENT_TYPE = b"protobuf:dnstap.Dnstap"
# Message types of the event schema, and the names of DNS record types by their assigned numbers; others are TYPE and the number.
MESSAGE_TYPES = "AUTH_QUERY AUTH_RESPONSE RESOLVER_QUERY RESOLVER_RESPONSE CLIENT_QUERY CLIENT_RESPONSE FORWARDER_QUERY FORWARDER_RESPONSE STUB_QUERY STUB_RESPONSE TOOL_QUERY TOOL_RESPONSE".split()
QTYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 10: "NULL", 11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY", 28: "AAAA", 29: "LOC", 33: "SRV", 35: "NAPTR", 37: "CERT", 39: "DNAME", 41: "OPT",
    43: "DS", 44: "SSHFP", 45: "IPSECKEY", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 49: "DHCID", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY", 62: "CSYNC", 63: "ZONEMD", 64: "SVCB", 65: "HTTPS", 99: "SPF",
    249: "TKEY", 250: "TSIG", 251: "IXFR", 252: "AXFR", 255: "ANY", 256: "URI", 257: "CAA",
}
TLS_TYPES = {20: "ChangeCipherSpec", 21: "Alert", 22: "Handshake", 23: "ApplicationData"}

EVENT_SCHEMA = """path string, frame_no int, identity string, version string, message_type string, query_address string, response_address string, query_port int, response_port int,
query_time_ns bigint, response_time_ns bigint, query_qname string, query_qtype string, query_id int, query_size int, response_qname string, response_qtype string, response_id int, response_size int, query_zone string"""


class FrameError(ValueError):
    """A stream of frames that breaks the format."""


def iter_frames(data: bytes, content_type: bytes | None = None) -> Iterator[bytes]:
    """The content frames of a stream up to its stop frame or end; raises FrameError for what breaks the format."""
    at, started = 0, False

    def word() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise FrameError("the stream ends within a frame")
        at += 4
        return struct.unpack_from(">I", data, at - 4)[0]

    while at < len(data):
        size = word()
        if size != CONTROL:
            if at + size > len(data):
                raise FrameError("the stream ends within a frame")
            yield data[at : at + size]
            at += size
            continue
        size = word()
        if size < 4 or at + size > len(data):
            raise FrameError("a control frame has an invalid length")
        end, kind = at + size, word()
        if kind == STOP:
            if size != 4:
                raise FrameError("a stop frame has an invalid length")
            return
        if kind != START:
            raise FrameError(f"unknown control frame {kind}")
        if started:
            raise FrameError("a second start frame")
        started = True
        while at < end:
            if word() != CONTENT_TYPE_FIELD:
                raise FrameError("unknown field in a start frame")
            n = word()
            if content_type is not None and data[at : at + n] != content_type:
                raise FrameError(f"content type {data[at : at + n]!r}")
            at += n


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: varints and fixed numbers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, int.from_bytes(data[at : at + n], "little")
            at += n
        elif kind == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("a field is cut off")
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


def _name(data: bytes, at: int = 0) -> tuple[str, int]:
    """A name and where it ends; a label may be a pointer to an earlier place, where the name goes on."""
    labels, end, least = [], None, at
    while n := data[at]:
        if n >= 192:
            end = at + 2 if end is None else end
            at = struct.unpack_from(">H", data, at)[0] & 0x3FFF
            if at >= least:  # pointers lead back, so they end
                raise ValueError("a pointer of a name leads forward")
            least = at
            continue
        if n > 63 or at + 1 + n > len(data):
            raise ValueError("no label")
        labels.append(data[at + 1 : at + 1 + n].decode("ascii", "backslashreplace"))
        at += 1 + n
    return "".join(x + "." for x in labels) or ".", at + 1 if end is None else end


def _question(data: bytes) -> tuple[str, str, int]:
    name, at = _name(data, 12)
    kind = struct.unpack_from(">H", data, at)[0]
    return name, QTYPES.get(kind, f"TYPE{kind}"), struct.unpack_from(">H", data)[0]


def _address(data: bytes | None) -> str | None:
    import ipaddress

    return None if data is None else str(ipaddress.ip_address(data))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(no: int, value: int | bytes | None) -> bytes:
    if value is None:
        return b""
    return _varint(no << 3 | 2) + _varint(len(value)) + value if isinstance(value, bytes) else _varint(no << 3) + _varint(value)


def _wire_name(name: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".") if x) + b"\0"


def dns_question(qid: int, name: str, qtype: str, size: int = 0) -> bytes:
    """A DNS message with one question, filled up with zeros to its size."""
    number = next((n for n, t in QTYPES.items() if t == qtype), None)
    body = struct.pack(">HHHHHH", qid, 0, 1, 0, 0, 0) + _wire_name(name) + struct.pack(">HH", int(qtype[4:]) if number is None else number, 1)
    return body.ljust(size, b"\0")


def encode_event(e: dict) -> bytes:
    """The frame of an event given by the columns of EVENT_SCHEMA; a side without a name, type or id has no message."""
    import ipaddress

    address = lambda x: None if x is None else ipaddress.ip_address(x).packed
    m = _field(1, MESSAGE_TYPES.index(e["message_type"]) + 1) + _field(4, address(e.get("query_address"))) + _field(5, address(e.get("response_address"))) + _field(6, e.get("query_port")) + _field(7, e.get("response_port"))
    for side, sec, nsec, body in (("query", 8, 9, 10), ("response", 12, 13, 14)):
        t = e.get(f"{side}_time_ns")
        if t is not None:
            m += _field(sec, t // 1_000_000_000) + _varint(nsec << 3 | 5) + struct.pack("<I", t % 1_000_000_000)
        about = [e.get(f"{side}_{x}") for x in ("id", "qname", "qtype")]
        if None not in about:
            m += _field(body, dns_question(*about, e.get(f"{side}_size") or 0))
    zone = e.get("query_zone")
    return _field(1, (e.get("identity") or "").encode()) + _field(2, (e.get("version") or "").encode()) + _field(14, m + _field(11, None if zone is None else _wire_name(zone))) + _field(15, 1)


def frame_stream(frames: list[bytes], content_type: bytes = DNSTAP_CONTENT_TYPE) -> bytes:
    """Content frames between a start and a stop frame."""
    control = lambda body: struct.pack(">II", CONTROL, len(body)) + body
    start = struct.pack(">III", START, CONTENT_TYPE_FIELD, len(content_type)) + content_type
    return control(start) + b"".join(struct.pack(">I", len(f)) + f for f in frames) + control(struct.pack(">I", STOP))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files below path; those ending in .xz are unpacked. Files are read whole, one a row, so a file must fit a task."""

    def unpack(names: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([lzma.decompress(d) if n.endswith(".xz") else d for n, d in zip(names.to_pylist(), data.to_pylist())], pa.binary())

    unpack.__annotations__ = {"names": pa.Array, "data": pa.Array, "return": pa.Array}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    plain, packed = files.where("NOT endswith(path, '.xz')"), files.where("endswith(path, '.xz')")
    return plain.unionByName(packed.select("path", F.arrow_udf(unpack, "binary")("path", "content").alias("content")))


def decode_event(frame: bytes) -> dict | None:
    """One event as a row, without path and frame_no; None for a frame that isn't a valid event."""
    try:
        top = dict(_fields(frame))
        m = dict(_fields(top[14]))
        out = {"identity": top.get(1, b"").decode() or None, "version": top.get(2, b"").decode() or None, "message_type": MESSAGE_TYPES[m[1] - 1]}
        out |= {"query_address": _address(m.get(4)), "response_address": _address(m.get(5)), "query_port": m.get(6), "response_port": m.get(7)}
        for side, sec, nsec, body in (("query", 8, 9, 10), ("response", 12, 13, 14)):
            out[f"{side}_time_ns"] = m[sec] * 1_000_000_000 + m.get(nsec, 0) if sec in m else None
            q = _question(m[body]) if body in m else (None, None, None)
            out |= {f"{side}_qname": q[0], f"{side}_qtype": q[1], f"{side}_id": q[2], f"{side}_size": len(m[body]) if body in m else None}
        out["query_zone"] = _name(m[11])[0] if 11 in m else None
        return out
    except (ValueError, KeyError, IndexError, AttributeError, struct.error):
        return None


def write_files(files: DataFrame, base: str) -> int:
    """Write rows of path (relative), content BINARY as files below base, a folder that all executors share, and return how many; content for a path ending in .xz is packed.

    Each task writes its own rows; one that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base)
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                folder, _, _ = f"{root}/{name}".rpartition("/")
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(lzma.compress(data) if name.endswith(".xz") else data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    uri = base if "://" in base else f"file://{base}"
    base = uri
    return files.select("path", "content").where("path IS NOT NULL AND content IS NOT NULL").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_events(spark: SparkSession, path: str, *, permissive: bool = False) -> DataFrame:
    """DNS events of frame files below path, packed with xz or not, see decode_events."""
    return decode_events(contents(spark, path), permissive=permissive)


def decode_events(files: DataFrame, *, permissive: bool = False) -> DataFrame:
    """DNS events of frame streams given as path, content, in the order of path and frame_no.

    Frames that aren't valid events are left out. A stream whose frames break the format fails the query, or with permissive gives the frames before
    the break.
    """
    columns = [c.split()[0] for c in EVENT_SCHEMA.replace("\n", " ").split(",")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = []
                try:
                    for i, frame in enumerate(iter_frames(bytes(data), DNSTAP_CONTENT_TYPE)):
                        if (e := decode_event(frame)) is not None:
                            rows.append({"path": name, "frame_no": i} | e)
                except FrameError:
                    if not permissive:
                        raise
                yield pd.DataFrame(rows, columns=columns, dtype=object)  # as objects, so that nulls make no floats of 64-bit numbers

    return files.select("path", "content").mapInPandas(decode, EVENT_SCHEMA)


def dns_messages(data: bytes) -> Iterator[bytes]:
    """The messages of a DNS stream over TCP, each behind its length in two bytes; what is cut off at the end is left out."""
    at = 0
    while at + 2 <= len(data) and at + 2 + (n := struct.unpack_from(">H", data, at)[0]) <= len(data):
        yield data[at + 2 : at + 2 + n]
        at += 2 + n


def read_dns_streams(spark: SparkSession, path: str) -> DataFrame:
    """The messages of the DNS streams below path, packed with xz or not, see decode_dns_streams."""
    return decode_dns_streams(contents(spark, path))


def decode_dns_streams(files: DataFrame) -> DataFrame:
    """path, message_no, size, qname, qtype, qid of DNS streams given as path, content; the last three are null for what is no message with a question."""
    columns = ["path", "message_no", "size", "qname", "qtype", "qid"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = []
                for i, m in enumerate(dns_messages(bytes(data))):
                    try:
                        q = _question(m)
                    except (IndexError, ValueError, struct.error):
                        q = (None, None, None)
                    rows.append((name, i, len(m), *q))
                yield pd.DataFrame(rows, columns=columns, dtype=object)  # as objects, so that nulls make no floats of 64-bit numbers

    return files.select("path", "content").mapInPandas(decode, "path string, message_no int, size int, qname string, qtype string, qid int")


def selects_tls13(body: bytes) -> bool:
    """Whether the body of a handshake record is a server's hello that selects TLS 1.3, by its extension 43."""
    try:
        if body[0] != 2:
            return False
        at = 39 + body[38] + 3  # header, version, random and session id; then cipher and compression
        end = at + 2 + struct.unpack_from(">H", body, at)[0]
        at += 2
        while at + 4 <= end:
            kind, n = struct.unpack_from(">HH", body, at)
            if kind == 43:
                return body[at + 4 : at + 6] == b"\x03\x04"
            at += 4 + n
    except (IndexError, struct.error):
        pass
    return False


def tls_records(data: bytes) -> Iterator[tuple]:
    """TLS records of a capture: packet_no, sender, sender_port, receiver, receiver_port, time_us, message_type, message_length, record_no, tls13.

    TCP over IPv4 over Ethernet; payloads are put in order by sequence number in each direction, repeated segments dropped, and a
    record gets the time of the packet that completes it. record_no is its place among them, tls13 tells a server's hello that selects this version.
    FrameError for what is no such capture: packets cut off by the capture or by the file's end, other packets than IPv4, fragments.
    """
    order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}.get(data[:4])
    if order is None:
        raise FrameError("no packet capture")
    at, no, count = 24, 0, 0
    flows: dict[tuple, dict] = {}
    while at < len(data):
        if at + 16 > len(data):
            raise FrameError("the capture ends within a packet")
        sec, usec, size, whole = struct.unpack_from(order + "IIII", data, at)
        packet, at, no = data[at + 16 : at + 16 + size], at + 16 + size, no + 1
        if size != whole or len(packet) < size:
            raise FrameError(f"packet {no} is truncated")
        if len(packet) < 34 or packet[12:14] != b"\x08\x00":
            raise FrameError(f"packet {no} is no IPv4 packet")
        if packet[23] != 6 or len(packet) < 54:
            continue
        head = 14 + (packet[14] & 15) * 4
        total = struct.unpack_from(">H", packet, 16)[0]
        src, dst, seq = struct.unpack_from(">HHI", packet, head)
        body = packet[head + (packet[head + 12] >> 4) * 4 : 14 + total]
        key = (".".join(map(str, packet[26:30])), src, ".".join(map(str, packet[30:34])), dst)
        flow = flows.setdefault(key, {"next": None, "wait": {}, "buffer": b""})
        if packet[head + 13] & 2:  # the stream begins after this number
            flow["next"] = (seq + 1) & 0xFFFFFFFF
        if not body:
            continue
        if packet[20] & 0x20:
            raise FrameError(f"packet {no} is a fragment")
        flow["next"] = seq if flow["next"] is None else flow["next"]
        if (seq - flow["next"]) & 0xFFFFFFFF < 1 << 31:
            flow["wait"].setdefault(seq, body)
        while (part := flow["wait"].pop(flow["next"], None)) is not None:
            flow["buffer"] += part
            flow["next"] = (flow["next"] + len(part)) & 0xFFFFFFFF
        while len(flow["buffer"]) >= 5 and len(flow["buffer"]) >= 5 + (n := struct.unpack_from(">H", flow["buffer"], 3)[0]):
            kind = flow["buffer"][0]
            yield no, *key, sec * 1_000_000 + usec, TLS_TYPES.get(kind, f"Unknown({kind})"), n, count, kind == 22 and selects_tls13(flow["buffer"][5 : 5 + n])
            count += 1
            flow["buffer"] = flow["buffer"][5 + n :]


def read_tls_records(spark: SparkSession, path: str, *, permissive: bool = False) -> DataFrame:
    """TLS records of the packet captures below path, packed with xz or not, see decode_captures."""
    return decode_captures(contents(spark, path), permissive=permissive)


def decode_captures(files: DataFrame, *, permissive: bool = False) -> DataFrame:
    """TLS records of packet captures given as path, content, with the capture's path. One that breaks the format fails the query, or with permissive gives the records before the break."""
    names = ["packet_no", "sender", "sender_port", "receiver", "receiver_port", "time_us", "message_type", "message_length", "record_no", "tls13"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                rows = []
                try:
                    for r in tls_records(bytes(data)):
                        rows.append(r)
                except FrameError:
                    if not permissive:
                        raise
                d = pd.DataFrame(rows, columns=names)
                d.insert(0, "path", name)
                yield d

    return files.select("path", "content").mapInPandas(decode, "path string, packet_no int, sender string, sender_port int, receiver string, receiver_port int, time_us bigint, message_type string, message_length int, record_no int, tls13 boolean")


def labelled_files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """path, label, ordinal of the files below path with the ending: the label is the file's folder, the ordinal its position there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").load(path).select("path")
    d = files.withColumn("label", F.element_at(F.split("path", "/"), -2))
    return group_numbers(d, ["label"], [F.col("path")], "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))
