"""Percentiles of very large numeric columns from mergeable centroid digests, with certified rank error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

COMPRESSION = 200
FAN_IN = 64
_BUFFER = 500_000


def _cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-cluster centroids of many groups at once: sorted (group, mean, weight), at most about `compression` a group.

    The clusters' limits are whole numbers of k(q) = compression * asin(2q - 1) / pi at the quantile q of a centroid's middle, so they are
    small towards both ends; equal values may share a cluster.
    """
    order = np.lexsort((mean, group))
    group, mean, weight = group[order], mean[order], weight[order]
    total = np.cumsum(weight)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    before = np.repeat(total[first] - weight[first], size)
    whole = np.repeat(total[first + size - 1], size) - before
    k = np.floor(compression / np.pi * np.arcsin(np.clip(2 * (total - before - weight / 2) / whole - 1, -1, 1)))
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
    w = np.add.reduceat(weight, start)
    return group[start], np.add.reduceat(mean * weight, start) / w, w


class _Buffer:
    """Values or centroids of many groups, re-clustered whenever the buffer is full."""

    def __init__(self, compression: int) -> None:
        self.compression, self.ids, self.parts, self.n = compression, {}, [], 0
        self.low, self.high = {}, {}

    def add(self, keys: list[tuple], group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """group: index into keys; low and high: least and greatest value behind each centroid's digest."""
        if not len(group):
            return
        ids = np.array([self.ids.setdefault(k, len(self.ids)) for k in keys])
        group = ids[group]
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        for g, a, b in zip(group[order][at].tolist(), np.minimum.reduceat(low[order], at).tolist(), np.maximum.reduceat(high[order], at).tolist()):
            self.low[g], self.high[g] = min(a, self.low.get(g, a)), max(b, self.high.get(g, b))
        self.parts.append((group, mean.astype(float), weight.astype(float)))
        self.n += len(group)
        if self.n > _BUFFER:
            self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.parts = [_cluster(*(np.concatenate(x) for x in zip(*self.parts)), self.compression)]
        self.n = len(self.parts[0][0])
        return self.parts[0]

    def digests(self, keep_last: bool = False) -> list[dict]:
        """All digests so far, the buffer emptied, but for the latest group if keep_last."""
        if not self.n:
            return []
        group, mean, weight = self.squeeze()
        keys = list(self.ids)
        cut = np.flatnonzero(np.r_[True, np.diff(group) > 0, True])
        kept = len(keys) - 1 if keep_last else -1
        out = [{"key": keys[group[a]], "means": mean[a:b], "weights": weight[a:b], "low": self.low[group[a]], "high": self.high[group[a]]} for a, b in zip(cut, cut[1:]) if group[a] != kept]
        self_low, self_high = (self.low.get(kept), self.high.get(kept))
        mask = group == kept
        self.ids, self.low, self.high, self.parts, self.n = {}, {}, {}, [], 0
        if keep_last:
            self.ids, self.low, self.high, self.n = {keys[kept]: 0}, {0: self_low}, {0: self_high}, int(mask.sum())
            self.parts = [(np.zeros(self.n, int), mean[mask], weight[mask])]
        return out


def _digest_schema(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in keys) + "src bigint, n bigint, low double, high double, means array<double>, weights array<double>"


def _to_batch(digests: list[dict], fields: list[pa.Field], src: int) -> pa.RecordBatch:
    cols = [pa.array([d["key"][i] for d in digests], f.type) for i, f in enumerate(fields)]
    cols += [pa.array([src] * len(digests), pa.int64()), pa.array([round(d["weights"].sum()) for d in digests], pa.int64())]
    cols += [pa.array([float(d[x]) for d in digests], pa.float64()) for x in ("low", "high")] + [pa.array([d[x] for d in digests], pa.list_(pa.float64())) for x in ("means", "weights")]
    return pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + ["src", "n", "low", "high", "means", "weights"])


def digest_values(df: DataFrame, keys: list[str], value: str, *, compression: int = COMPRESSION) -> DataFrame:
    """One digest a group: keys, src, n, low, high, means, weights.

    Null and NaN values are left out, and a null key is a group of its own; no rows for an empty input. Each task digests its own
    rows, so no values move; a group's partial digests merge over a tree, see merge_digests.
    """
    schema, m = _digest_schema(df, keys), len(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, fields, src = _Buffer(compression), None, TaskContext.get().partitionId()
        for b in batches:
            fields = [b.schema.field(i) for i in range(m)]
            t = pa.Table.from_batches([b])
            group, names = _codes(t, m)
            v = t.column(m).to_numpy()
            buffer.add(names, group, v, np.ones(len(v)), v, v)
            if len(buffer.ids) > 20_000:  # many groups: send what there is
                yield _to_batch(buffer.digests(), fields, src)
        if fields:
            yield _to_batch(buffer.digests(), fields, src)

    rows = df.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{value}`").cast("double").alias("_value")).where("_value IS NOT NULL AND NOT isnan(_value)")
    return merge_digests(materialize(rows.mapInArrow(partial, schema)), keys, compression=compression)


def _codes(t: pa.Table, m: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row by its first m columns, and the key of each number."""
    code = np.zeros(len(t), np.int64)
    for i in range(m):
        d = t.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    at = np.unique(code, return_index=True)[1]
    return code, list(zip(*(t.column(i).take(pa.array(at)).to_pylist() for i in range(m)))) if m else [()]


def merge_digests(digests: DataFrame, keys: list[str], *, compression: int = COMPRESSION, fan_in: int = FAN_IN) -> DataFrame:
    """Merge digests by keys, for example those of days into those of all days, by re-clustering centroids: keys, src, n, low, high, means, weights.

    src numbers the sources of a group: the task, or a hash of the keys of the digest that was merged before. While a group has more than fan_in digests, those
    whose src falls into one of so many parts merge first, about fan_in at a time; so a group with many digests, as one that every task or
    every day has, is a tree whose nodes no task gathers whole. The digests are read more than once: give a written table.
    """
    by = [F.col(f"`{k}`") for k in keys]
    most = digests.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    level = 0
    while most > fan_in:
        most, level = -(-most // fan_in), level + 1
        part = F.pmod(F.xxhash64("src", F.lit(level)), F.lit(most))
        digests = _merge_level(digests.withColumn("_part", part), [*keys, "_part"], compression).drop("src").withColumnRenamed("_part", "src")
    return _merge_level(digests, keys, compression).withColumn("src", F.xxhash64(*by) if by else F.lit(0).cast("bigint"))


def _merge_level(digests: DataFrame, keys: list[str], compression: int) -> DataFrame:
    schema, m = _digest_schema(digests, keys), len(keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, fields = _Buffer(compression), None
        for b in batches:  # groups come one after the other; the latest may go on
            fields = [b.schema.field(i) for i in range(m)]
            t = pa.Table.from_batches([b]).combine_chunks()
            if not len(t):
                continue
            group, names = _codes(t, m)
            seen = np.full(len(names), len(t), np.int64)
            np.minimum.at(seen, group, np.arange(len(t)))
            order = np.argsort(seen)
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            means, weights = (t[c].chunk(0) for c in ("means", "weights"))
            row = pc.list_parent_indices(means).to_numpy()
            buffer.add([names[i] for i in order], place[group][row], *(x.flatten().to_numpy() for x in (means, weights)), *(t[c].to_numpy()[row] for c in ("low", "high")))
            yield _to_batch(buffer.digests(keep_last=True), fields, 0)
        if fields:
            yield _to_batch(buffer.digests(), fields, 0)

    key = [F.col(f"`{k}`") for k in keys]
    rows = digests.repartition(*key).sortWithinPartitions(*key)
    return rows.select(*key, "src", "n", "low", "high", "means", "weights").mapInArrow(merge, schema)


def percentiles(digests: DataFrame, keys: list[str], quantiles: Sequence[float]) -> DataFrame:
    """keys, n and estimates, an array of DOUBLE: the value at each quantile, interpolated between the centroids' middles."""
    kinds, qs, m = dict(digests.dtypes), list(quantiles), len(keys)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for low, high, mean, weight in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("low", "high", "means", "weights"))):
                w = np.array(weight)
                middle = (np.cumsum(w) - w / 2) / w.sum()
                rows.append(np.interp(qs, np.r_[0, middle, 1], np.r_[low, mean, high]))
            arrays = [b.column(i) for i in range(m)] + [b.column(b.schema.get_field_index("n")), pa.array(rows, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(b.schema.field(i).name for i in range(m)), "n", "estimates"])

    key = [F.col(f"`{k}`") for k in keys]
    return digests.select(*key, "n", "low", "high", "means", "weights").mapInArrow(estimate, "".join(f"`{k}` {kinds[k]}, " for k in keys) + "n bigint, estimates array<double>")


def certify(values: DataFrame, keys: list[str], value: str, estimates: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Count the values below and at each estimate and add rank_error: the largest share of a group's values, over the
    quantiles, by which an estimate's rank misses its quantile. Of few values, interpolation alone may miss by up to one of them.

    values: keys and value, nulls left out. Equal values of a group are counted before they meet the estimates, and the counts are
    partial aggregates, so a hot group moves few rows.
    """
    qs = list(quantiles)
    k = [F.col(f"`{c}`") for c in keys]
    counted = values.select(*k, F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    est = estimates.select(*(x.alias(f"g{i}") for i, x in enumerate(k)), "estimates")
    on = [counted[c].eqNullSafe(est[f"g{i}"]) for i, c in enumerate(keys)]
    at = lambda i: F.get("estimates", F.lit(i))
    sums = [x for i in range(len(qs)) for x in (F.sum(F.when(F.col("v") < at(i), F.col("c")).otherwise(0)).alias(f"lt{i}"), F.sum(F.when(F.col("v") <= at(i), F.col("c")).otherwise(0)).alias(f"le{i}"))]
    ranks = counted.join(est, on).groupBy(*keys, "estimates").agg(F.sum("c").alias("n"), *sums)
    # the estimate covers all ranks from lt to le; its error is the way from them to the rank asked for
    miss = [F.greatest(F.lit(0.0), F.col(f"lt{i}") - q * F.col("n"), q * F.col("n") - F.col(f"le{i}")) / F.col("n") for i, q in enumerate(qs)]
    return ranks.select(*k, "n", "estimates", F.greatest(F.lit(0.0), *miss).alias("rank_error"))
