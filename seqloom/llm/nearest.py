"""Pairing each left row with the right row nearest in time for the same entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize

_OUT = "p int, kind int, key string, id long, t long, pt long, pid long, nt long, nid long, open_prev boolean, open_next boolean"
_LEFT, _FIRST, _LAST = 0, 1, 2
BLOCK = 64


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int, *, partitions: int | None = None) -> DataFrame:
    """For each left row the right row of the same key with the least |time difference|, if at most tolerance.

    Both inputs have key STRING, t BIGINT, id BIGINT; rows with a null among them take no part, other columns are
    ignored. On a tie, also among right rows of one time, the smaller right id wins; a right row may serve several
    left rows, and a row given twice counts once. Returns left_id, right_id, distance; left rows without a right row in
    reach give none.

    Both sides are range-partitioned together by (key, t), so that a key may span any number of
    tasks; each task scans its sorted rows once, in batches, and keeps only left rows that still wait for a
    later right row within the tolerance. Left rows whose search ran over an end of the partition
    get the partition-edge right rows of the other partitions, by a prefix scan over two rows a partition.
    """
    cols = [F.col("key").cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.col("id").cast("long").alias("id")]
    given = "key IS NOT NULL AND t IS NOT NULL AND id IS NOT NULL"
    # one right row a (key, t): the others there can't be nearest
    r = right.select(*cols).where(given).groupBy("key", "t").agg(F.min("id").alias("id")).withColumn("side", F.lit(0))
    both = r.unionByName(left.select(*cols).where(given).withColumn("side", F.lit(1)))
    n = partitions or int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "t", "side", "id"]
    ranged = both.repartitionByRange(n, *order).sortWithinPartitions(*order)
    scanned = materialize(ranged.select(*order).mapInArrow(_scanner(tolerance), _OUT))

    carry = _carry(scanned.where(F.col("kind") != _LEFT))
    found = scanned.where(F.col("kind") == _LEFT)
    done = found.where("NOT open_prev AND NOT open_next").select("id", "t", "pt", "pid", "nt", "nid")
    # the carry has one row a partition
    waiting = found.where("open_prev OR open_next").join(F.broadcast(carry), "p", "left")
    before, after = "open_prev AND before.key = key", "open_next AND after.key = key"
    waiting = waiting.selectExpr(
        "id", "t", f"CASE WHEN {before} THEN before.t ELSE pt END AS pt", f"CASE WHEN {before} THEN before.id ELSE pid END AS pid",
        f"CASE WHEN {after} THEN after.t ELSE nt END AS nt", f"CASE WHEN {after} THEN after.id ELSE nid END AS nid",
    )
    rows = done.unionByName(waiting).selectExpr("id", "pid", "nid", "t - pt AS dp", "nt - t AS dn")
    take_next = "dn IS NOT NULL AND (dp IS NULL OR dn < dp OR (dn = dp AND nid < pid))"
    rows = rows.selectExpr("id AS left_id", f"CASE WHEN {take_next} THEN nid ELSE pid END AS right_id", f"CASE WHEN {take_next} THEN dn ELSE dp END AS distance")
    return rows.where(F.col("distance") <= tolerance)


def _carry(edges: DataFrame) -> DataFrame:
    """For each partition p the last right row before it and the first one after it, as (key, t, id).

    A prefix scan in two levels: within blocks of partitions, then over the blocks. As partitions are in
    order of (key, t), the last row before is the greatest and the first one after the least.
    """
    row = F.struct("key", "t", "id")
    e = edges.groupBy("p").agg(F.min(F.when((F.col("kind") == _FIRST) & F.col("key").isNotNull(), row)).alias("f"), F.max(F.when((F.col("kind") == _LAST) & F.col("key").isNotNull(), row)).alias("l"))
    e = e.withColumn("block", F.floor(F.col("p") / BLOCK))
    past, ahead = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    within = Window.partitionBy("block").orderBy("p")
    e = e.withColumns({"b1": F.max("l").over(within.rowsBetween(*past)), "a1": F.min("f").over(within.rowsBetween(*ahead))})
    over = Window.orderBy("block")
    blocks = e.groupBy("block").agg(F.max("l").alias("l"), F.min("f").alias("f"))
    blocks = blocks.select("block", F.max("l").over(over.rowsBetween(*past)).alias("b2"), F.min("f").over(over.rowsBetween(*ahead)).alias("a2"))
    return e.join(F.broadcast(blocks), "block").select("p", F.coalesce("b1", "b2").alias("before"), F.coalesce("a1", "a2").alias("after"))


def _scanner(tolerance: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        none = np.empty(0, np.int64)
        base, last = 0, None  # number of the key in progress; last row seen
        right: tuple[int, int] | None = None  # latest right row of that key
        first_right = last_right = None
        # left rows that wait for a later right row: id, t, latest right row's t and id, its presence, key number
        wait = [none] * 6
        key = first_key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, t, side, rid = batch.column(0), *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            fresh = np.ones(len(t), bool)
            fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last is not None and keys[0].as_py() != last[0]
            again = np.zeros(len(t), bool)
            again[1:] = ~fresh[1:] & (t[1:] == t[:-1]) & (side[1:] == side[:-1]) & (rid[1:] == rid[:-1])
            again[0] = last is not None and not fresh[0] and (t[0], side[0], rid[0]) == last[1:]
            number = base + np.cumsum(fresh)
            if last is not None and fresh[0]:
                right = None
            if last is None:
                first_key = keys[0].as_py()
            key = keys[len(keys) - 1].as_py()
            last = (key, t[-1], side[-1], rid[-1])
            is_right = side == 0
            at = np.flatnonzero(is_right)
            if len(at):
                if first_right is None:
                    first_right = (keys[int(at[0])].as_py(), int(t[at[0]]), int(rid[at[0]]))
                last_right = (keys[int(at[-1])].as_py(), int(t[at[-1]]), int(rid[at[-1]]))
            # latest right row at or before each row
            idx = np.maximum.accumulate(np.where(is_right, np.arange(len(t)), -1))
            ok = (idx >= 0) & (number[idx] == number)
            pt, pid = np.where(ok, t[idx], 0), np.where(ok, rid[idx], 0)
            if right is not None:
                carried = ~ok & (number == base)
                pt[carried], pid[carried], ok = right[0], right[1], ok | carried
            if len(at) and number[at[-1]] == number[-1]:
                right = (int(t[at[-1]]), int(rid[at[-1]]))
            elif number[-1] != base:
                right = None
            base = int(number[-1])
            # next right row after each left row, those that wait included
            lefts = np.flatnonzero(~is_right & ~again)
            rows = [np.concatenate(x) for x in zip(wait, (rid[lefts], t[lefts], pt[lefts], pid[lefts], ok[lefts].astype(np.int64), number[lefts]))]
            place = np.concatenate([np.zeros(len(wait[0]), np.int64), lefts])
            after = np.searchsorted(at, place)
            has = after < len(at)
            nxt = at[np.minimum(after, len(at) - 1)] if len(at) else np.zeros(len(place), np.int64)
            has &= number[nxt] == rows[5]
            over = has | (rows[5] < base) | (t[-1] - rows[1] > tolerance)
            yield _rows(p, [x[over] for x in rows], t[nxt][over], rid[nxt][over], has[over], first_key, None)
            wait = [x[~over] for x in rows]
        if len(wait[0]):
            yield _rows(p, wait, wait[0], wait[0], np.zeros(len(wait[0]), bool), first_key, key)
        for kind, e in ((_FIRST, first_right), (_LAST, last_right)):  # also without a right row, so that each p is there
            row = {"p": p, "kind": kind} | (dict(zip(("key", "t", "id"), e)) if e else {})
            yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    return scan


def _rows(p: int, left: list[np.ndarray], nt: np.ndarray, nid: np.ndarray, has_next: np.ndarray, first_key: str | None, open_key: str | None) -> pa.RecordBatch:
    """Left rows with what was found; open_key: the key in progress at the partition's end, where their next is open."""
    rid, t, pt, pid, has_prev, number = left
    open_prev = (has_prev == 0) & (number == 0)
    n = len(rid)
    keys = pa.array([open_key] * n if open_key is not None else [first_key if o else None for o in open_prev], pa.string())
    opt = lambda x, ok: pa.array(x, pa.int64(), mask=ok == 0)
    columns = [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, _LEFT, np.int32)), keys, pa.array(rid), pa.array(t), opt(pt, has_prev), opt(pid, has_prev), opt(nt, has_next), opt(nid, has_next)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(open_prev), pa.array(np.full(n, open_key is not None))], schema=_SCHEMA)


_SCHEMA = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("key", pa.string()), *((n, pa.int64()) for n in ("id", "t", "pt", "pid", "nt", "nid")), ("open_prev", pa.bool_()), ("open_next", pa.bool_())])
