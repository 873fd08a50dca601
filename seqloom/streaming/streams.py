"""Structured Streaming counterparts: windows, dedup, matching, throttling; each works on any streaming DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.session import scratch, shared_dir


def run_to_end(stream: DataFrame) -> DataFrame:
    """Run a stream over all its input so far, in as many micro-batches as its source's limits ask for, and return what it appended; output and progress lie in the shared folder."""
    spark, base = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def arrivals(df: DataFrame, arrival: str, end: dict[str, Column], *, slices: int = 8) -> DataFrame:
    """df as a stream that comes in the order of a TIMESTAMP column, about a slice a micro-batch: written slice by slice, each slice an equal part of the time, rows of no time last.

    end: columns of one more row that comes after all others, the rest of it null. With a time far ahead it moves the watermark over all
    that waits, so that a stream over a finished table gives its last results too.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    first, last = df.agg(F.min(arrival).cast("double"), F.max(arrival).cast("double")).first()
    span = ((last or 0) - (first or 0)) / slices or 1.0
    number = F.coalesce(F.least(F.floor((F.col(arrival).cast("double") - F.lit(float(first or 0))) / span), F.lit(slices - 1)), F.lit(slices - 1))
    files, most = 0, 1
    for i in range(slices):
        df.where(number == i).write.mode("append").option("compression", "zstd").parquet(path)
        before, files = files, len(spark.read.schema(df.schema).parquet(path).inputFiles())
        most = max(most, files - before)  # of a slice; a micro-batch takes as many, so that their number doesn't grow with the table
    kinds = dict(df.dtypes)
    spark.range(1).select(*(end.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in df.columns)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", most).parquet(path)


def windowed_counts(stream: DataFrame, time: str, by: list[str], length: str, *, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per event-time window and group; rows later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length, slide or length), *by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, time: str, by: list[str], gap: str, *, late: str = "1 hour") -> DataFrame:
    """Counts per session: events of a group less than `gap` apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))


def recent_distinct(stream: DataFrame, time: str, keys: list[str], memory: str) -> DataFrame:
    """The first row of each key within the memory of the watermark."""
    return stream.withWatermark(time, memory).dropDuplicatesWithinWatermark(keys)


def without_dummies(stream: DataFrame, is_dummy: Column) -> DataFrame:
    """Only the real messages; a null flag is none."""
    return stream.where(~F.coalesce(is_dummy, F.lit(False)))


class _Held:
    """Rows of a key that wait until the watermark has passed them, as columns of 64-bit numbers; the time comes first."""

    def __init__(self, state: GroupState, width: int) -> None:
        self.columns = [np.array(x, np.int64) for x in state.get[:width]] if state.exists else [np.empty(0, np.int64)] * width

    def add(self, chunks: Iterator[pd.DataFrame], names: list[str]) -> None:
        for c in chunks:
            self.columns = [np.concatenate([have, c[n].to_numpy(np.int64)]) for have, n in zip(self.columns, names)]

    def ready(self, us: int, unit: int) -> list[np.ndarray]:
        """The rows with a time up to the watermark, in order; they are held no longer. unit: how many of the time's units a microsecond has."""
        done = self.columns[0] // unit <= us
        out, self.columns = [c[done] for c in self.columns], [c[~done] for c in self.columns]
        order = np.lexsort(out[::-1])
        return [c[order] for c in out]


def _ripe(stream: DataFrame, keys: list[str], time: str, per_us: int, columns: list[str], more: str, schema: str, process, late: str) -> DataFrame:
    """Rows of each key handed to `process` in the order of their columns, once the watermark has passed them.

    process(key, columns, state values or None) gives the rows to put out, the new state values (of the fields `more`), and until when (in microseconds) they matter, or None. A key without
    rows that wait and values that matter has no state. Rows that come later than the watermark are dropped.
    """
    fields = [f.split()[0] for f in more.split(", ")]

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _Held(state, len(columns))
        kept, until = (list(state.get[len(columns) : -1]), state.get[-1]) if state.exists else (None, None)
        if not state.hasTimedOut:
            held.add(chunks, columns)
        us = state.getCurrentWatermarkMs() * 1000
        out, kept, until = process(key, held.ready(us, per_us), kept, until)
        if until is not None and until <= us:
            kept = until = None
        if len(held.columns[0]) or until is not None:
            state.update((*(c.tolist() for c in held.columns), *(kept or [None] * len(fields)), until))
            waits = [int(held.columns[0].min()) // per_us] if len(held.columns[0]) else []
            next_us = min(waits + ([] if until is None else [until]))
            state.setTimeoutTimestamp(max(next_us // 1000 + 1, us // 1000 + 1))
        elif state.exists:
            state.remove()
        yield out

    held = ", ".join(f"h{i} array<bigint>" for i in range(len(columns)))
    at = F.timestamp_micros(F.expr(f"{time} div {per_us}"))
    rows = stream.dropna(subset=[*keys, *columns]).withColumn("_at", at).withWatermark("_at", late)
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, f"{held}, {more}, until bigint", "append", GroupStateTimeout.EventTimeTimeout)


def match_stream(stream: DataFrame, keys: list[str], *, late: str = "1 hour", memory_us: int = 31 * 86_400_000_000, buckets: int | None = None) -> DataFrame:
    """keys, query_id, response_id, took of a stream of both sides: keys, side (0 query, 1 response, others are passed over), t (nanoseconds), id BIGINT; rows with a null among them take no part.

    Rows may come in any order up to `late`: they wait until the watermark has passed them, and are taken in the order of t, side, id; later ones are dropped, and so are repeated
    deliveries of one that waits. What is kept of a key is what waits and the last query without a response, which a later query replaces, a response uses up, and
    the watermark ends memory_us behind it.

    Keys are many and have few rows each, so the state is that of a bucket of keys, a table of their rows, and all keys of a bucket are matched at once. buckets: by default four for each shuffle partition.
    """
    kinds, columns = dict(stream.dtypes), [*keys, "t", "side", "id"]
    buckets = buckets or 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pq.read_table(pa.BufferReader(state.get[0])).to_pandas()] if state.exists else []
        if not state.hasTimedOut:
            parts += [c[columns] for c in chunks]
        rows, us = pd.concat(parts, ignore_index=True), state.getCurrentWatermarkMs() * 1000
        # a query that is kept is before the watermark and goes in with the rows that have become ready
        due = rows["t"].to_numpy() // 1000 <= us
        ready, waiting = rows[due], rows[~due]
        key = ready.groupby(keys, sort=False).ngroup().to_numpy()
        t, side, id_ = (ready[c].to_numpy(np.int64) for c in ("t", "side", "id"))
        order = np.lexsort((id_, side, t, key))
        key, t, side, id_ = (x[order] for x in (key, t, side, id_))
        same = key[1:] == key[:-1]
        fresh = np.r_[True, ~same | (t[1:] != t[:-1]) | (side[1:] != side[:-1]) | (id_[1:] != id_[:-1])][: len(t)] & ((side == 0) | (side == 1))
        order, key, t, side, id_ = (x[fresh] for x in (order, key, t, side, id_))
        at = 1 + np.flatnonzero((key[1:] == key[:-1]) & (side[1:] == 1) & (side[:-1] == 0))
        out = ready.iloc[order[at]][keys].reset_index(drop=True).assign(query_id=id_[at - 1], response_id=id_[at], took=t[at] - t[at - 1])
        until = t // 1000 + memory_us
        kept = np.r_[key[1:] != key[:-1], True][: len(t)] & (side == 0) & (until > us)
        if len(waiting) or kept.any():
            # the state is written anew with each micro-batch: as Parquet, by time, it takes little disk
            held = pa.Table.from_pandas(pd.concat([ready.iloc[order[kept]], waiting], ignore_index=True).sort_values("t"), preserve_index=False)
            sink = pa.BufferOutputStream()
            pq.write_table(held, sink, compression="zstd", use_dictionary=keys, column_encoding={"t": "DELTA_BINARY_PACKED", "id": "DELTA_BINARY_PACKED"})
            state.update((sink.getvalue().to_pybytes(),))
            next_us = min([*until[kept].tolist(), *(waiting["t"].to_numpy() // 1000).tolist()])
            state.setTimeoutTimestamp(max(next_us // 1000 + 1, us // 1000 + 1))
        elif state.exists:
            state.remove()
        yield out

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", query_id bigint, response_id bigint, took bigint"
    rows = stream.dropna(subset=columns).withColumn("_at", F.timestamp_micros(F.expr("t div 1000"))).withWatermark("_at", late)
    rows = rows.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *columns, "_at")
    return rows.groupBy("_bucket").applyInPandasWithState(run, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_stream(stream: DataFrame, key: str, delta: int, *, late: str = "1 hour") -> DataFrame:
    """key, id, sent of a stream of key, t (microseconds), id: each row goes out at its time or delta after the one before, whichever is later.

    Rows may come in any order up to `late`; they wait until the watermark has passed them, and later ones are dropped, as are repeated deliveries of one that waits. The time of the last row is kept only until it can't hold back another.
    """
    kind = dict(stream.dtypes)[key]

    def send(k: tuple, rows: list[np.ndarray], kept: list | None, until: int | None):
        t, id_ = rows
        fresh = np.r_[True, (t[1:] != t[:-1]) | (id_[1:] != id_[:-1])][: len(t)]
        t, id_ = t[fresh], id_[fresh]
        i = np.arange(len(t)) * delta
        least = t if until is None or not len(t) else np.r_[max(t[0], kept[0] + delta), t[1:]]
        sent = np.maximum.accumulate(least - i) + i
        out = pd.DataFrame({key: [k[0]] * len(t), "id": id_, "sent": sent})
        last = int(sent[-1]) if len(sent) else kept[0] if until is not None else None
        return out, None if last is None else [last], None if last is None else last + delta

    return _ripe(stream, [key], "t", 1, ["t", "id"], "last bigint", f"{key} {kind}, id bigint, sent bigint", send, late)
