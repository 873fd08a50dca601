"""Collapsing runs of equal or nearly equal consecutive events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize

_TEXT, _LONG = ("owner", "source", "same"), ("o1", "o2", "near", "clock", "pos")
_SCHEMA = pa.schema(
    [("p", pa.int32()), ("ordinal", pa.int64()), ("is_edge", pa.bool_()), *((c, pa.string()) for c in _TEXT)]
    + [(c, pa.int64()) for c in ("near_first", "near_last", "clock_first", "clock_last", "pos_first", "n")]
)
_DDL = ", ".join(f"{f.name} {dict(int32='int', int64='long', bool='boolean', string='string')[str(f.type)]}" for f in _SCHEMA)


def collapse_runs(events: DataFrame, tolerance: int = 0, *, partitions: int | None = None, least: int = 2) -> DataFrame:
    """Collapse each maximal run of at least `least` consecutive events of (owner, source) into one row.

    events: owner, source, same STRING; o1, o2, near, clock, pos BIGINT. Order within (owner, source) is o1,
    o2; an event given twice (equal in all four) counts once. It continues the run of the event directly
    before it if same is equal and near differs by at most tolerance. Rows with a null in any of these
    columns take no part. Returns owner, source, first_pos (pos of the first event), n_events, duration
    (last minus first clock).

    Events are range-partitioned by (owner, source, o1, o2), so an owner may span any number of tasks. Each
    task encodes its sorted rows into runs; the first and the last run of each partition are summaries with both their ends, and
    they merge associatively over the partitions: two rows a partition are all that this last step sees.
    """
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(*(F.col(c).cast("string").alias(c) for c in _TEXT), *(F.col(c).cast("long").alias(c) for c in _LONG)).dropna()
    order = ["owner", "source", "o1", "o2"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = materialize(rows.mapInArrow(_encoder(tolerance, least), _DDL))
    w = Window.partitionBy("owner", "source").orderBy("p", "ordinal")
    edges = local.where("is_edge")
    before = F.lag(F.struct("p", "same", "near_last")).over(w)
    follows = (F.col("b.p") != F.col("p")) & (F.col("b.same") == F.col("same")) & (F.abs(F.col("near_first") - F.col("b.near_last")) <= tolerance)
    edges = edges.withColumn("b", before).withColumn("fresh", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    at = F.struct("p", "ordinal")
    whole = edges.groupBy("owner", "source", "run").agg(F.min_by("pos_first", at).alias("pos_first"), F.min_by("clock_first", at).alias("clock_first"), F.max_by("clock_last", at).alias("clock_last"), F.sum("n").alias("n"))
    columns = ["owner", "source", F.col("pos_first").alias("first_pos"), F.col("n").alias("n_events"), (F.col("clock_last") - F.col("clock_first")).alias("duration")]
    return local.where("NOT is_edge").select(*columns).unionByName(whole.where(F.col("n") >= least).select(*columns))


def _encoder(tolerance: int, least: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, ordinal, held, last = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if last is not None:
                t = pa.concat_tables([last, t])  # the row before this batch decides whether it goes on
            if not t.num_rows:
                continue
            v = {c: t[c].to_numpy().astype(np.int64) for c in _LONG}
            alike = lambda *names: np.logical_and.reduce([pc.equal(t[c].slice(1), t[c].slice(0, len(t) - 1)).to_numpy() for c in names])  # noqa: B023, E731
            owner = alike("owner", "source")
            twice = np.zeros(len(t), bool)
            twice[1:] = owner & (v["o1"][1:] == v["o1"][:-1]) & (v["o2"][1:] == v["o2"][:-1])
            if twice.any():
                keep = np.flatnonzero(~twice)
                t, v = t.take(keep), {c: x[keep] for c, x in v.items()}
                owner = alike("owner", "source")
            follows = np.zeros(len(t), bool)
            follows[1:] = owner & alike("same") & (np.abs(v["near"][1:] - v["near"][:-1]) <= tolerance)
            skip = int(last is not None)
            last = t.slice(len(t) - 1)
            starts = np.flatnonzero(~follows[skip:]) + skip
            ends = np.append(starts[1:], len(t)) - 1
            if len(t) == skip:
                continue
            if held is not None:
                stop = (starts[0] if len(starts) else len(t)) - 1  # of the run in progress
                held["n"] += int(stop - skip + 1)
                if stop >= skip:
                    held |= {"near_last": int(v["near"][stop]), "clock_last": int(v["clock"][stop])}
            if not len(starts):
                continue
            runs = {c: t[c].take(starts) for c in _TEXT} | {"near_first": v["near"][starts], "near_last": v["near"][ends], "clock_first": v["clock"][starts], "clock_last": v["clock"][ends], "pos_first": v["pos"][starts], "n": ends - starts + 1}
            table = pa.table({c: runs[c] for c in _SCHEMA.names[3:]})
            if held is not None:
                if ordinal == 0 or held["n"] >= least:
                    yield _batch(pa.Table.from_pylist([held], schema=pa.schema(list(_SCHEMA)[3:])), p, ordinal, ordinal == 0)
                ordinal += 1
            body, held = table.slice(0, len(table) - 1), table.slice(len(table) - 1).to_pylist()[0]
            if ordinal == 0 and len(body):
                yield _batch(body.slice(0, 1), p, 0, True)
                ordinal, body = 1, body.slice(1)
            body = body.filter(pc.greater_equal(body["n"], least))
            if len(body):
                yield _batch(body, p, ordinal, False)
        if held is not None:
            yield _batch(pa.Table.from_pylist([held], schema=pa.schema(list(_SCHEMA)[3:])), p, 1 << 40, True)

    return encode


def _batch(runs: pa.Table, p: int, ordinal: int, edge: bool) -> pa.RecordBatch:
    n = len(runs)
    head = [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, ordinal, np.int64)), pa.array(np.full(n, edge))]
    return pa.RecordBatch.from_arrays(head + [runs[c].combine_chunks().cast(_SCHEMA.field(c).type) for c in _SCHEMA.names[3:]], schema=_SCHEMA)


def code_events(df: DataFrame, owner: str, codes: str) -> DataFrame:
    """The S codes of size/gap sequences as events for collapse_runs.

    codes: ARRAY<STRING> such as S05 or G12; outer blanks, letter case and zero padding don't matter. An S code
    becomes an event with pos its 0-based position, same its number and clock the sum of the G numbers before
    it; null elements and anything but S or G and a number (of up to 18 digits for G) are passed over. A row with a
    null owner or null codes gives no events.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = pc.ascii_upper(pc.ascii_trim_whitespace(lists.flatten()))
            row = pc.list_parent_indices(lists).to_numpy()
            ok = pc.fill_null(pc.match_substring_regex(flat, "^[SG][0-9]+$"), False).to_numpy(zero_copy_only=False)
            if not len(row):
                continue
            first = np.searchsorted(row, row)  # position of each row's first element
            number = pc.ascii_ltrim(pc.utf8_slice_codeunits(flat, 1), "0")
            is_s = ok & pc.fill_null(pc.starts_with(flat, "S"), False).to_numpy(zero_copy_only=False)
            is_g = ok & ~is_s & (pc.fill_null(pc.utf8_length(number), 99).to_numpy() <= 18)
            gaps = np.zeros(len(row), np.int64)
            at = np.flatnonzero(is_g)
            text = pc.take(number, pa.array(at))
            gaps[at] = pc.if_else(pc.equal(text, ""), "0", text).cast(pa.int64()).to_numpy(zero_copy_only=False)
            total = np.cumsum(gaps)
            clock = total - (total - gaps)[first]
            at = np.flatnonzero(is_s)
            pos = pa.array(at - first[at])
            zero = pa.array(np.zeros(len(at), np.int64))
            arrays = [pc.take(batch.column(0), pa.array(row[at])), pa.array([""] * len(at), pa.string()), pc.take(number, pa.array(at)), pos, zero, zero, pa.array(clock[at]), pos]
            yield from pa.Table.from_arrays(arrays, names=[*_TEXT, *_LONG]).to_batches(max_chunksize=50_000)

    rows = df.select(F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{codes}`").alias("codes")).where("owner IS NOT NULL AND codes IS NOT NULL")
    return rows.mapInArrow(parse, ", ".join([f"{c} string" for c in _TEXT] + [f"{c} long" for c in _LONG]))
