"""Session helpers: building a local session, reading tables, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "seqloom", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with UTC time, as tests and the bench use it; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset, a temporary
    folder of this machine, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts lineage like checkpoint(), survives the loss of executors, and takes far less disk as the
    table is columnar and compressed. Spark deletes the table when its JVM ends.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; Spark deletes what lies there when its JVM ends."""
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again, to give its disk back."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/seqloom-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that clash with no column of df, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to at most `most`, one row at least."""
    start = total = 0
    for i, x in enumerate(lengths):
        if i > start and total + x > most:
            yield start, i
            start, total = i, 0
        total += x
    if len(lengths) > start:
        yield start, len(lengths)
