"""Text sources and sinks: sequences as JSON, label lists, rank lists, browser logs, result lines, graph files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.elements import codes, parse_codes
from seqloom.functions.names import ignored_url, stem
from seqloom.session import materialize
from seqloom.sources.frames import contents


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of text files, also of packed ones; Spark unpacks all kinds but xz, whose files are read whole, one a task."""
    if not path.endswith(".xz"):
        return spark.read.text(path)
    return contents(spark, path).select(F.explode(F.split(F.regexp_replace(F.col("content").cast("string"), r"\n\z", ""), r"\r?\n")).alias("value"))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, elems from lines of JSON objects {id: [code, ...]}; lines that are none are left out."""
    d = lines(spark, path).select(F.from_json("value", "map<string,array<string>>").alias("m")).where("m IS NOT NULL")
    return d.select(F.explode("m").alias("seq_id", "c")).select("seq_id", parse_codes(F.array_compact("c")).alias("elems"))


def write_sequences(df: DataFrame, path: str) -> None:
    """Lines of JSON objects {id: [code, ...]} from seq_id, elems."""
    df.where("seq_id IS NOT NULL AND elems IS NOT NULL").select(F.to_json(F.create_map("seq_id", codes(F.col("elems")))).alias("value")).write.text(path)


_TIMED = "array<struct<time:string,size:int,is_dummy_event:boolean>>"


def timed_texts(df: DataFrame, key: str, time_us: str, size: str, tie: str) -> DataFrame:
    """key, value: the JSON text `[[{time, size, is_dummy_event}, ...], id]` of each key's messages in the order of time and tie; rows with a null among them are left out."""
    at = F.date_format(F.timestamp_micros(F.col(time_us)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    d = df.dropna(subset=[key, time_us, size]).select(key, F.struct(F.col(time_us).alias("t"), F.col(tie).alias("o"), F.struct(at.alias("time"), F.col(size).cast("int").alias("size"), F.lit(False).alias("is_dummy_event")).alias("e")).alias("m"))
    g = d.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("l"))
    name = F.substr(F.to_json(F.array(key)), F.lit(2))  # a text in JSON, with the bracket behind it
    return g.select(key, F.concat(F.lit("["), F.to_json(F.col("l.e")), F.lit(","), name).alias("value"))


def timed_rows(texts: DataFrame) -> DataFrame:
    """path, seq_id, time_us, size, tie, is_dummy of such texts given as path, content; tie is a message's place in its text."""
    parts = F.from_json(F.col("content").cast("string"), "array<string>")
    d = texts.select("path", F.get(parts, F.lit(1)).alias("seq_id"), F.posexplode(F.from_json(F.get(parts, F.lit(0)), _TIMED)).alias("tie", "e"))
    return d.select("path", "seq_id", F.unix_micros(F.col("e.time").try_cast("timestamp_ntz").cast("timestamp")).alias("time_us"), F.col("e.size").alias("size"), "tie", F.coalesce("e.is_dummy_event", F.lit(False)).alias("is_dummy"))


def write_labelled(df: DataFrame, path: str) -> None:
    """Lines of JSON objects {true_domain, mapped_domain, sequences: {id: [code, ...]}}, one a sequence, from seq_id, true_domain, mapped_domain, elems."""
    d = df.where("seq_id IS NOT NULL AND elems IS NOT NULL")
    d.select("true_domain", "mapped_domain", F.create_map("seq_id", codes(F.col("elems"))).alias("sequences")).write.json(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, true_domain, mapped_domain, elems from such lines, which may hold any number of sequences; lines that are none are left out."""
    d = spark.read.option("mode", "DROPMALFORMED").schema("true_domain string, mapped_domain string, sequences map<string,array<string>>").json(path)
    return d.select("true_domain", "mapped_domain", F.explode("sequences").alias("seq_id", "c")).select("seq_id", "true_domain", "mapped_domain", parse_codes(F.array_compact("c")).alias("elems"))


def unique_labels(mapping: DataFrame) -> DataFrame:
    """domain and target of a mapping in which a domain may come only once: a second row of one fails the query. Rows with a null domain are left out."""
    g = mapping.where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    target = F.when(F.col("n") == 1, F.col("target")).otherwise(F.raise_error(F.concat(F.lit("more than one target for "), F.col("domain"))).cast("string"))
    return g.select("domain", target.alias("target"))


def write_shards(df: DataFrame, path: str, shard: str, column: str) -> None:
    """One folder of text files a shard, with the values of a column as lines; nulls are left out."""
    df.where(F.col(column).isNotNull()).select(shard, F.col(column).cast("string").alias("value")).write.partitionBy(shard).text(path)


def read_label_lists(spark: SparkSession, path: str) -> DataFrame:
    """domain, target from CSV files without a header; rows that begin with # are comments."""
    rows = spark.read.schema("domain string, target string").csv(path)
    return rows.where("domain IS NOT NULL AND target IS NOT NULL AND NOT startswith(ltrim(domain), '#')")


def read_ranked(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """rank, domain from a ranked list, the first `most` ranks if given."""
    rows = spark.read.schema("rank int, domain string").csv(path)
    return rows if most is None else rows.orderBy("rank").limit(most)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Classification results from lines of JSON; lines that aren't valid are left out."""
    option = "struct<name:string,count:int,distance_min:string,distance_max:string,distance_min_norm:string,distance_max_norm:string>"
    return spark.read.option("mode", "DROPMALFORMED").schema(f"id string, k int, label string, reason string, class_result struct<options:array<{option}>>").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Lines of JSON with the fields that read_results reads: id, k, label, reason, class_result; those and no others, null fields left out."""
    df.select("id", "k", "label", "reason", "class_result").write.json(path)


def write_counters(df: DataFrame, path: str) -> None:
    """Counters or statistics as CSV with a header, nulls as empty fields."""
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_counters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Counters or statistics from CSV with a header; the columns go by their order."""
    return spark.read.option("header", True).schema(schema).csv(path)


def quality_series(stats: DataFrame, columns: list[str]) -> DataFrame:
    """k, position, n from a statistics table as read_counters reads it: for each k the sums of its quality columns, each with its `_w_reason` column that follows, without the
    first three. columns: the quality columns in order, the second of each pair included. A k with another total than the least one fails the query."""
    sums = stats.groupBy("k").agg(*(F.sum(c).alias(c) for c in columns))
    pairs = [F.col(a) + F.col(b) for a, b in zip(columns[::2], columns[1::2])]
    least = sums.agg(F.min(sum(pairs, F.lit(0))).alias("least")).withColumn("one", F.lit(1))  # one row
    d = sums.withColumn("one", F.lit(1)).join(F.broadcast(least), "one")
    same = F.when(sum(pairs, F.lit(0)) == F.col("least"), F.array(*pairs[3:])).otherwise(F.raise_error(F.lit("not as many traces for every k")).cast("array<bigint>"))
    return d.select("k", F.posexplode(same).alias("position", "n"))


# What a log says above each table of results, which of the lines below it hold numbers, and how many a line has.
LOG_TABLE, LOG_LINES, LOG_WIDTHS = "#Domains with at least x classification results of quality or higher:\n", (3, 7), (11, 21)


def read_log_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, table_no, line_no, quality, counts of the result tables in logs: the lines from the last to the first. A line with another number of counts fails the query."""
    first, end = LOG_LINES
    tables = F.slice(F.split("value", LOG_TABLE), 2, 1_000_000)
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(tables).alias("table_no", "t"))
    d = d.select("file", "table_no", F.posexplode(F.reverse(F.slice(F.split("t", "\n"), first + 1, end - first))).alias("line_no", "line"))
    cells = F.transform(F.split("line", "│"), lambda x: F.trim(x))
    counts = F.transform(F.slice(cells, 2, 1000), lambda x: x.cast("int"))
    fits = F.when(F.size(counts).isin(*LOG_WIDTHS), counts).otherwise(F.raise_error(F.concat(F.lit("no line of 11 or 21 counts: "), F.col("line"))).cast("array<int>"))
    return d.select("file", "table_no", "line_no", F.get(cells, F.lit(0)).alias("quality"), fits.alias("counts"))


def training_runs(texts: DataFrame) -> DataFrame:
    """file, stamp, settings, measure, best of CSV files of training runs given as file, value (whole texts, as Hadoop lists no names with colons): of each measure the least value if its name has `loss` in it, else the greatest; NA is none.

    The settings are the mapping in the file's name, as a MAP of texts; `effort` among them is the product of layers, hidden_size and epochs.
    """
    rows = F.transform(F.split(F.regexp_replace("value", r"\s+\z", ""), r"\r?\n"), lambda x: F.split(x, ","))
    d = texts.select("file", rows.alias("rows")).select("file", F.get("rows", F.lit(0)).alias("names"), F.explode(F.slice("rows", 2, 1_000_000)).alias("cells"))
    d = d.select("file", "names", F.posexplode("cells").alias("i", "text"))
    value = F.nullif(F.trim("text"), F.lit("NA")).try_cast("double")
    g = d.select("file", F.get("names", F.col("i")).alias("measure"), value.alias("v")).groupBy("file", "measure").agg(F.min("v").alias("least"), F.max("v").alias("most"))
    name = F.element_at(F.split("file", "/"), -1)
    mapping = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"(\{.*\})\.csv$", 1), "<class |>", ""), "'", '"'), "None", "null")
    settings = F.from_json(mapping, "map<string,string>")
    effort = F.create_map(F.lit("effort"), F.aggregate(F.transform(F.array(*map(F.lit, ("layers", "hidden_size", "epochs"))), lambda k: settings[k].cast("bigint")), F.lit(1).cast("bigint"), lambda a, x: a * x).cast("string"))
    return g.select("file", F.regexp_extract(name, r"^([^{]*)\{", 1).alias("stamp"), F.map_concat(settings, effort).alias("settings"), "measure", F.when(F.contains("measure", F.lit("loss")), F.col("least")).otherwise(F.col("most")).alias("best"))


def read_dissections(spark: SparkSession, path: str) -> DataFrame:
    """file, frame_no, qname of packets that an analyser exported as a JSON array; a packet with another number of questions than one fails the query."""
    schema = "_source struct<layers:struct<dns:struct<Queries:map<string,struct<`dns.qry.name`:string>>>,frame:struct<`frame.number`:string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), F.col("_source.layers").alias("l"))
    q = F.map_values("l.dns.Queries")
    one = F.when(F.size(q) == 1, F.get(q, F.lit(0))["dns.qry.name"]).otherwise(F.raise_error(F.lit("not one question")).cast("string"))
    return d.select("file", F.col("l.frame")["frame.number"].cast("int").alias("frame_no"), one.alias("qname"))


def read_ignored(spark: SparkSession, path: str) -> DataFrame:
    """The distinct stems of the first column of CSV files with a header: files to be left out, for an anti join."""
    return spark.read.option("header", True).schema("file string, reason string").csv(path).where("file IS NOT NULL").select(stem(F.col("file")).alias("stem")).distinct()


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """surt, stamp, url, status from lines `surt stamp {json}`, compressed or not."""
    parts = F.split("value", " ", 3)
    d = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("surt"), F.get(parts, F.lit(1)).alias("stamp"), F.from_json(F.get(parts, F.lit(2)), "struct<url:string,status:string>").alias("j"))
    return d.select("surt", "stamp", "j.url", F.col("j.status").try_cast("int").alias("status")).where("url IS NOT NULL")


# stacks stay JSON text, as their parents nest to any depth
_LOG = """method string, params struct<requestId:string,documentURL:string,wallTime:double,scriptId:string,url:string,stackTrace:string,
request:struct<url:string,headers:struct<Referer:string>>,redirectResponse:struct<url:string>,targetInfo:struct<type:string,url:string>,
initiator:struct<type:string,url:string,stack:string>>"""


def read_browser_log(spark: SparkSession, path: str) -> DataFrame:
    """file, message_no, method, params of browser logs, each one JSON array of messages, packed with xz or not."""
    texts = contents(spark, path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("value"))
    return browser_messages(texts)


def browser_messages(texts: DataFrame) -> DataFrame:
    """The same of logs given as file, value."""
    files = texts.select("file", F.from_json("value", f"array<struct<{_inline(_LOG)}>>").alias("m"))
    return files.select("file", F.posexplode("m").alias("message_no", "m")).select("file", "message_no", "m.method", "m.params")


def _inline(ddl: str) -> str:
    head, rest = ddl.replace("\n", "").split(", ", 1)
    return f"{head.replace(' ', ':')},{rest.replace('params ', 'params:')}"


def _frames(stack: Column) -> Column:
    """url and scriptId of the frames of a stack given as JSON text and of all its parents."""

    def run(x: pa.Array) -> pa.Array:
        out = []
        for text in x.to_pylist():
            found, level = [], json.loads(text) if text else None
            while isinstance(level, dict):
                found += [{"url": f.get("url"), "scriptId": f.get("scriptId")} for f in level.get("callFrames") or []]
                level = level.get("parent")
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("url", pa.string()), ("scriptId", pa.string())])))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<url:string,scriptId:string>>")(stack)


def script_urls(log: DataFrame) -> DataFrame:
    """file, script, url: the URLs that each parsed script depends on, those of the frames of its stack; a frame without a URL stands for its own script's.

    Each round follows one more script without a URL, from the pairs that the round before found.
    """
    s = log.where("method IN ('Debugger.scriptParsed', 'Debugger.scriptFailedToParse') AND params.stackTrace IS NOT NULL").where(~F.coalesce(ignored_url(F.col("params.url")), F.lit(False)))
    s = s.select("file", F.col("params.scriptId").alias("script"), _frames(F.col("params.stackTrace")).alias("frames"))
    s = materialize(s.select("file", "script", F.explode("frames").alias("f")).select("file", "script", "f.url", F.col("f.scriptId").alias("via")).distinct())
    links = s.where("url = ''").select("file", F.col("script").alias("user"), F.col("via").alias("script"))
    known = step = materialize(s.where("url <> ''").select("file", "script", "url").distinct())
    while True:
        step = materialize(links.join(step, ["file", "script"]).select("file", F.col("user").alias("script"), "url").distinct().join(known, ["file", "script", "url"], "left_anti"))
        if step.isEmpty():
            return known
        known = materialize(known.unionByName(step))


#: The node that pages depend on.
ROOT = "other"


def request_edges(log: DataFrame) -> DataFrame:
    """file, src, dst: what the requests, web sockets and pages of browser logs depend on.

    A page target and a request for the document itself depend on ROOT; another request without an initiator on the document, if it has a referrer; one by the parser
    or a module script on the initiator's URL; one by a script on the frames of its stack and of all the stack's parents; and a redirected one on where it came from. A URL counts
    if the log named it as a node up to that message. Where a frame's URL doesn't, as that of inline scripts, the URLs that its script depends on count instead, see script_urls.
    """
    p, method = F.col("params"), F.col("method")
    request, socket = method == "Network.requestWillBeSent", method == "Network.webSocketCreated"
    page = (method == "Target.targetInfoChanged") & (p["targetInfo"]["type"] == "page")
    url = F.when(request, p["request"]["url"]).when(socket, p["url"]).when(page, p["targetInfo"]["url"])
    to = lambda u, script=None: F.struct(u.alias("url"), F.lit(script).cast("string").alias("script"))
    kind, document = p["initiator"]["type"], p["documentURL"]
    r = log.select("file", F.col("message_no").alias("no"), url.alias("url"), page.alias("page"), request.alias("request"), kind.alias("kind"), document.alias("document"), p["request"]["headers"]["Referer"].alias("referrer"), p["redirectResponse"]["url"].alias("redirect"), p["initiator"]["url"].alias("by"), p["initiator"]["stack"].alias("stack"))
    r = r.where("url IS NOT NULL").where(~ignored_url(F.col("url"))).withColumn("frames", _frames(F.when(F.col("kind") == "script", F.col("stack"))))
    alone = F.when(F.col("request") & (F.col("url") == F.col("document")), F.lit(ROOT)).when(F.col("request") & F.col("referrer").isNotNull(), F.col("document"))
    one = F.when(F.col("page"), F.lit(ROOT)).when(F.col("kind") == "other", alone).when((F.col("kind") == "parser") | F.col("stack").isNull(), F.col("by"))
    needs = F.concat(F.array(to(one), to(F.col("redirect"))), F.coalesce(F.transform("frames", lambda f: F.struct(f["url"].alias("url"), f["scriptId"].alias("script"))), F.array().cast("array<struct<url:string,script:string>>")))
    r = materialize(r.select("file", "no", "url", F.filter(needs, lambda n: n["url"].isNotNull()).alias("needs")))
    nodes = r.groupBy("file", F.col("url").alias("dst")).agg(F.min("no").alias("first"))
    nodes = nodes.unionByName(r.select("file", F.lit(ROOT).alias("dst"), F.lit(-1).alias("first")).distinct())
    d = r.select("file", "no", F.col("url").alias("src"), F.explode("needs").alias("n")).select("file", "no", "src", F.col("n.url").alias("dst"), "n.script").where(~ignored_url(F.col("dst")))
    d = d.groupBy("file", "src", "dst", "script").agg(F.max("no").alias("no")).join(nodes, ["file", "dst"], "left").withColumn("known", F.coalesce(F.col("first") <= F.col("no"), F.lit(False)))
    d = materialize(d)
    by_script = d.where("NOT known AND script IS NOT NULL").select("file", "src", "script", "no").join(script_urls(log), ["file", "script"]).select("file", "src", "no", F.col("url").alias("dst"))
    by_script = by_script.join(nodes, ["file", "dst"]).where("first <= no")
    e = d.where("known").select("file", "src", "dst").unionByName(by_script.select("file", "src", "dst"))
    return e.where("src <> dst").distinct()


def log_reason(log: DataFrame) -> DataFrame:
    """file and the reason why a log is no good; both texts are fixed values: R008 for an error page, R009 without any response, null otherwise."""
    error = F.coalesce(F.startswith("params.documentURL", F.lit("chrome-error:")), F.lit(False))
    g = log.groupBy("file").agg(F.bool_or(error).alias("e"), F.bool_or(F.col("method") == "Network.responseReceived").alias("r"), F.bool_or(F.col("method") == "Network.dataReceived").alias("d"))
    bad = F.when(F.col("e"), "R008 Domain did not load properly and Chrome performed a Google search on the error page.").when(~(F.col("r") & F.col("d")), "R009 No network response received.")
    return g.select("file", bad.alias("reason"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document in parts that follow one another by name: nodes (node and other columns as text attributes), then edges (src, dst)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark, attrs = nodes.sparkSession, [c for c in nodes.columns if c != "node"]
    keys = "".join(f'<key id="{a}" for="node" attr.name="{a}" attr.type="string"/>' for a in attrs)
    head = spark.createDataFrame([(0, "", f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "part int, o string, value string")
    data = [F.coalesce(F.concat(F.lit(f'<data key="{a}">'), esc(a), F.lit("</data>")), F.lit("")) for a in attrs]
    n = nodes.select(F.lit(1).alias("part"), F.col("node").alias("o"), F.concat(F.lit('<node id="'), esc("node"), F.lit('">'), *data, F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.col("src").alias("o"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"/>')).alias("value"))
    head.unionByName(n).unionByName(e).orderBy("part", "o").select("value").write.text(path)
