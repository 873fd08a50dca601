"""Building size/gap sequences from timed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.elements import gap_element, gap_value, padded_vectors, size_element
from seqloom.operators.order import numbered


def build_sequences(events: DataFrame, key: str, time_us: str, size: str, tie: str, *, base_us: int = 1000, mode: str = "log2", simulate: str = "none", block: int = 468) -> DataFrame:
    """key and elems: the messages of each key in the order of time_us and tie, each as its gap to the one before and its size in blocks.

    mode: log2 or ident. simulate: 'perfect_padding' leaves no sizes and puts a zero gap where messages have none,
    'perfect_timing' leaves no gaps. Rows with a null key, time or size and sizes below 1 are left out; keys
    without an element too.
    """
    rows = events.select(F.col(key).alias(key), F.col(time_us).alias("t"), F.col(size).alias("s"), F.col(tie).alias("o")).where(f"{key} IS NOT NULL AND t IS NOT NULL AND s >= 1")
    w = Window.partitionBy(key).orderBy("t", "o")
    prior = F.lag("t").over(w)
    value = gap_value(F.col("t") - F.col("prior"), base_us, mode)
    rows = rows.withColumn("prior", prior).withColumn("g", value)
    if simulate == "perfect_padding":
        value, parts = F.when(F.col("prior").isNotNull(), F.coalesce("g", F.lit(0))), ["gap"]
    else:
        value, parts = F.col("g"), ["size"] if simulate == "perfect_timing" else ["gap", "size"]
    made = {"gap": gap_element(value), "size": size_element(F.col("s"), block)}
    rows = rows.select(key, "t", "o", F.array_compact(F.array(*(made[p] for p in parts))).alias("e"))
    out = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", "o", "e"))).alias("l"))
    return out.select(key, F.flatten("l.e").alias("elems")).where("size(elems) > 0")


def training_rows(df: DataFrame, label: str, shard: str, first_validation: int, *, length: int) -> DataFrame:
    """df with vectors, label_no and is_validation: what a model is trained on.

    df: elems, label, shard INT. vectors has `length` pairs (size, gap), filled up with (0, 0); label_no is the label's place in the order of all labels, which are numbered
    by ranges, not by one task; rows of shards from first_validation on are for validation. Rows with a null label, shard or elems are left out.
    """
    d = df.where(F.col(label).isNotNull() & F.col(shard).isNotNull() & F.col("elems").isNotNull())
    labels = numbered(d.select(label).distinct(), [F.col(label)], "label_no")
    return d.withColumn("vectors", padded_vectors(F.col("elems"), length)).withColumn("is_validation", F.col(shard) >= first_validation).join(labels, label)
