"""Column functions over DNS names, URLs and paths; null gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host of a URL, null if it is none."""
    return F.try_parse_url(url, F.lit("HOST"))


def surt(domain: Column) -> Column:
    """The labels in reverse order, joined by commas, as crawl indexes sort names."""
    return F.array_join(F.reverse(F.split(domain, r"\.")), ",")


def tld(domain: Column) -> Column:
    """What follows the last dot, with a dot behind it."""
    return F.concat(F.substring_index(domain, ".", -1), F.lit("."))


def parent(domain: Column) -> Column:
    """The name without its first label; null for a single label."""
    return F.when(F.contains(domain, F.lit(".")), F.regexp_replace(domain, r"^[^.]*\.", ""))


def suffixes(domain: Column) -> Column:
    """The name and all names above it."""
    labels = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def stem(path: Column) -> Column:
    """The file name without folders and without .dnstap, .json and .xz endings."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.dnstap)?(\.json)?(\.xz)?$", "")


def ignored_url(url: Column) -> Column:
    """URLs that are no network requests; the prefixes are fixed values."""
    out = F.lit(False)
    for p in ("data:", "chrome-extension:", "blob:", "about:", "extensions::"):
        out = out | F.startswith(url, F.lit(p))
    return out


def natural_key(text: Column) -> Column:
    """A sort key under which numbers in a text sort by their value."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))


def human_time(ns: Column) -> Column:
    """Nanoseconds as ns, us, ms, s or h in whole units."""
    out = None
    for limit, unit, size in ((1_000, "ns", 1), (1_000_000, "us", 1_000), (1_000_000_000, "ms", 1_000_000), (3_600_000_000_000, "s", 1_000_000_000)):
        text = F.concat(F.floor(ns / size).cast("string"), F.lit(unit))
        out = F.when(ns < limit, text) if out is None else out.when(ns < limit, text)
    return out.otherwise(F.concat(F.floor(ns / 3_600_000_000_000).cast("string"), F.lit("h")))


def seconds_to_us(value: Column) -> Column:
    """Seconds as number or text to microseconds; null for negative ones and what is no number."""
    v = value.cast("string").try_cast("decimal(30,9)")
    return F.when(v >= 0, F.floor(v * 1_000_000).cast("bigint"))


def milliseconds_to_us(value: Column) -> Column:
    """Milliseconds as text to whole microseconds, halves away from zero; null for what is no number or beyond 64 bits."""
    return F.round(F.trim(value).try_cast("double") * 1000).try_cast("bigint")


def iso_time(value: Column) -> Column:
    """An ISO 8601 time, `Z` or an offset behind it, as a timestamp; null for what is none."""
    return F.trim(value).try_cast("timestamp")


def reversed_labels(domain: Column) -> Column:
    """The labels from the last to the first: a sort key that keeps names below one domain together."""
    return F.reverse(F.split(domain, r"\."))


def public_suffix(df: DataFrame, domain: str, known: DataFrame, name: str = "suffix") -> DataFrame:
    """The distinct non-null values of a column of names, each with the longest suffix in the list (column suffix) that ends it at a dot; null if none does.

    A name that is itself in the list is its own suffix.
    """
    d = df.where(F.col(domain).isNotNull()).select(domain).distinct()
    ends = d.select(domain, F.explode(suffixes(F.col(domain))).alias("_end"))
    known = known.where("suffix IS NOT NULL").select(F.col("suffix").alias("_end")).distinct()
    hit = ends.join(known, "_end").groupBy(domain).agg(F.max_by("_end", F.length("_end")).alias(name))
    return d.join(hit, domain, "left")


def host_and_port(address: Column) -> Column:
    """STRUCT<host, port> of `host:port`, `192.0.2.1:53` or `[2001:db8::1]:53`, by the last colon; null without a port of 0 to 65535, or if colons are left in a host without brackets."""
    bare, port = F.regexp_extract(address, r"^(.*):(\d{1,5})$", 1), F.regexp_extract(address, r"^(.*):(\d{1,5})$", 2).try_cast("int")
    host = F.when(bare.rlike(r"^\[[0-9A-Fa-f:.]+\]$"), F.substr(bare, F.lit(2), F.length(bare) - 2)).when(~F.contains(bare, F.lit(":")) & (bare != ""), bare)
    return F.when(host.isNotNull() & port.between(0, 65535), F.struct(host.alias("host"), port.alias("port")))


def fixed_text(value: Column, digits: int = 4) -> Column:
    """A number as text with so many digits behind the point, as a key for values that are nearly equal."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


# Fields of browser logs that differ from run to run.
_RUN_IDS, _RUN_TIMES = "targetId|frameId|requestId|scriptId|executionContextId|loaderId", "timestamp|wallTime"


def scrubbed(line: Column) -> Column:
    """A line of a browser log with ids emptied and times set to 0, so that logs of two runs can be compared."""
    return F.regexp_replace(F.regexp_replace(line, f'"({_RUN_IDS})": "[^"]*"(,?)', '"$1": ""$2'), rf'"({_RUN_TIMES})": \d+(\.\d+)?(,?)', '"$1": 0$3')
