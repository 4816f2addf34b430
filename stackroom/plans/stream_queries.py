"""File sources, parsers and streams, run over data written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import generations as G
from ..operators.index import read_table
from ..session import shared_dir
from ..sources import readers as R
from ..sources.tables import documents, status_events, table
from ..streaming import dedup_ingest
from ..streaming.ingest import ingest_stream
from ..streaming.status import dedup_stream, status_stream
from . import sqlbits as S
from .dedup_queries import REPLAY, created
from .registry import query


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def partition_of(column: str):
    return F.regexp_extract("path", rf"{column}=([^/]*)/", 1)


@query("object_listing", "SELECT source, CAST(1 AS BIGINT) AS n_files, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, true AS recent FROM documents GROUP BY source")
def object_listing(spark, sf):
    """Documents written as text per source, then listed."""
    folder = scratch(spark, "objects")
    table(spark, sf, "documents").select("source", "text").repartition("source").write.partitionBy("source").text(folder)
    listing = R.object_listing(spark, folder)
    return listing.groupBy(partition_of("source").alias("source")).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), (F.min("last_modified") > F.lit("2020-01-01").cast("timestamp")).alias("recent"))


@query("read_text", "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def read_text(spark, sf):
    folder = scratch(spark, "text")
    table(spark, sf, "documents").select("source", "text").repartition("source").write.partitionBy("source").text(folder)
    return R.read_text(spark, folder).groupBy(partition_of("source").alias("source")).agg(
        F.sum(F.length("text")).alias("n_chars"))


@query("read_delimited", """SELECT o_orderpriority AS priority, count(*) AS n_rows, CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(sum(CAST('0x' || left(md5(line), 8) AS BIGINT)) AS BIGINT) AS checksum FROM (
  SELECT o_orderpriority, o_orderkey || ', ' || o_custkey || ', ' || o_orderstatus AS line FROM orders) GROUP BY 1""")
def read_delimited(spark, sf):
    """Orders written as tab-separated files; every file comes back as one text."""
    folder = scratch(spark, "tsv")
    table(spark, sf, "orders").select(
        F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("p"), F.col("o_orderkey").cast("string").alias("a"),
        F.col("o_custkey").cast("string").alias("b"), F.col("o_orderstatus").alias("c")).write.partitionBy("p").csv(folder, sep="\t")
    docs = R.read_delimited(spark, folder).withColumn("priority", F.replace(partition_of("p"), F.lit("_"), F.lit(" ")))
    lines = docs.select("priority", F.explode(F.split("text", "\n")).alias("line"))
    number = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")
    return lines.groupBy("priority").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("line")).alias("n_chars"), F.sum(number).alias("checksum"))


@query("read_json", "SELECT '{\"k\":' || CAST(props ->> 'k' AS VARCHAR) || '}' AS text, count(*) AS n FROM events GROUP BY 1")
def read_json(spark, sf):
    folder = scratch(spark, "json")
    table(spark, sf, "events").select("props").write.text(folder)
    return R.read_json(spark, folder, lines=True).groupBy("text").agg(F.count("*").alias("n"))


@query("post_processor", f"WITH {S.DOCS} SELECT doc_id, 'txt' AS doc_type, md5(lower(text)) AS text_md5 FROM docs WHERE connector_id < 'src5' UNION ALL SELECT doc_id, 'md', md5(text) FROM docs WHERE connector_id >= 'src5' UNION ALL SELECT doc_id, 'title', md5(title) FROM docs WHERE connector_id >= 'src5'")
def post_processor(spark, sf):
    """Text files are parsed to lower case; every markdown file adds its title as a further document."""
    parsers = R.Parsers()
    parsers.register("txt", lambda df: df.withColumn("text", F.lower("text")))
    parsers.add_post_processor(lambda df: df.filter(F.col("doc_type") == "md").withColumn(
        "text", F.col("title")).withColumn("doc_type", F.lit("title")))
    docs = documents(spark, sf).select(
        "doc_id", "title", "text", F.when(F.col("connector_id") < "src5", "txt").otherwise("md").alias("doc_type"))
    return parsers.parse(docs).select("doc_id", "doc_type", F.md5("text").alias("text_md5"))


def inbox(spark, df, name: str, batches: int = 3) -> tuple[str, int]:
    """A folder with the rows of a table as files that arrive in several batches, and the files of a batch. There are as many
    files as the table has splits, so a file does not grow with the table."""
    folder = scratch(spark, name)
    files = max(batches, df.rdd.getNumPartitions())
    df.repartition(files).write.parquet(folder)
    return folder, -(-files // batches)


def as_stream(spark, df, name: str):
    """The rows of a table arriving in several batches."""
    folder, files = inbox(spark, df, name)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder), folder


@query("status_stream", """WITH ev AS (SELECT event_id, user_id AS doc_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'indexed' WHEN 'error' THEN 'failed' ELSE 'deleted' END AS status, props FROM events)
  SELECT doc_id, arg_max(status, event_id) AS status, (SELECT CASE WHEN e2.status = 'failed' THEN left(e2.props, 500) END FROM ev e2 WHERE e2.doc_id = ev.doc_id AND e2.status IN ('pending', 'indexed', 'failed') ORDER BY e2.event_id DESC LIMIT 1) AS last_error, count(*) AS n_events FROM ev GROUP BY doc_id""")
def status_stream_q(spark, sf):
    """The stream over several batches ends in the same states as one pass over the table."""
    stream, folder = as_stream(spark, status_events(spark, sf).select(
        "doc_id", "event_id", "status", F.col("props").alias("error")), "events")
    out = scratch(spark, "states")
    status_stream(stream).writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "cp")).trigger(
        availableNow=True).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start().awaitTermination()
    latest = spark.read.parquet(out).groupBy("doc_id").agg(F.max_by(F.struct("status", "last_error", "n_events"), "batch").alias("s"))
    return latest.select("doc_id", "s.status", "s.last_error", "s.n_events")


@query("stream_dedup", "SELECT user_id || '|' || props || '|' || event_type AS payload FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    """Repeated payloads inside the watermark leave once."""
    source = table(spark, sf, "events").select(F.concat_ws("|", "user_id", "props", "event_type").alias("payload"),
                                               F.col("ts").cast("timestamp").alias("ts"))
    stream, folder = as_stream(spark, source, "queue")
    out = scratch(spark, "deduped")
    dedup_stream(stream, "60 days").writeStream.outputMode("append").option("checkpointLocation", scratch(spark, "cp")).trigger(
        availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema("payload string, ts timestamp").parquet(out).select("payload")


@query("stream_ingest", f"""WITH {S.chunks(200, 20)} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(total_chunks AS INTEGER) AS total_chunks, md5(text) AS text_md5 FROM chunks""")
def stream_ingest(spark, sf):
    """Documents arrive in several batches; the index table equals the one of a single batch."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("version"))
    (folder, files), path = inbox(spark, docs, "inbox"), scratch(spark, "index")
    ingest_stream(spark, folder, "doc_id bigint, text string, version int", path, scratch(spark, "cp"),
                  files_per_batch=files).awaitTermination()
    return read_table(spark, path).select("doc_id", "chunk_index", "total_chunks", F.md5("text").alias("text_md5"))


def arrived(spark, sf, parts=3):
    """The folder of an index into which the documents came in several batches, in the order of their ids."""
    docs = documents(spark, sf).join(created(spark, sf), "doc_id").select(
        "doc_id", "kb_id", F.lit("txt").alias("doc_type"), "text", F.lit(1).alias("version"),
        F.col("doc_created_at").cast("long").alias("doc_created_at"))
    folder, path, checkpoint = (scratch(spark, name) for name in ("inbox", "dedup-index", "cp"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    part = F.floor((F.col("doc_id") - low) * parts / (high - low + 1))
    for i in range(parts):
        docs.where(part == i).write.mode("append").parquet(folder)
        dedup_ingest.ingest_stream(spark, folder, path, checkpoint).awaitTermination()
    return path


@query("stream_ingest_dedup", f"{REPLAY} SELECT * FROM replayed")
def stream_ingest_dedup(spark, sf):
    """Decisions over three batches equal one replay over all documents."""
    return G.read(spark, f"{arrived(spark, sf)}/decisions").select(
        "doc_id", "candidate_id", "body_match", "title_match", "action", "replaced_by", "live")
