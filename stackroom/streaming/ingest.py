"""Continuous ingest: new files become chunks of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import fixed_chunks
from ..operators.embed import Embedder, dense_embed
from ..operators.index import replace_in_table, write_table


def index_rows(docs: DataFrame, size: int, overlap: int, fn: Embedder | None = None) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, text, vec) of a table of documents (doc_id, text)."""
    return dense_embed(fixed_chunks(docs.select("doc_id", "text"), size, overlap), fn=fn)


def ingest_batch(docs: DataFrame, path: str, size: int, overlap: int, key: str = "doc_id") -> None:
    """Chunk, embed and write one batch; a repeated batch replaces the same keys and changes nothing."""
    spark = docs.sparkSession
    latest = docs.groupBy("doc_id").agg(F.max_by("text", "version").alias("text"))
    rows = index_rows(latest, size, overlap)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        replace_in_table(spark, path, rows, latest, key)
    else:
        write_table(rows, path, key)


def ingest_stream(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str,
                  size: int = 200, overlap: int = 20, files_per_batch: int = 100) -> StreamingQuery:
    """Watch a folder of parquet documents (doc_id, text, version) and keep the index table current."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, _: ingest_batch(batch, path, size, overlap)).start()
