"""User dictionaries: expressions of any number of words that stay one token."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, ws_tokens
from .batches import pieces

#: Score of an entry that names none.
SCORE = 10.0
#: Characters of all expressions that are sent to the tasks at most.
LARGEST = 64 << 20


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(expression, tag, score) of a tab-separated dictionary; blank lines, comments and lines without a tag are passed over."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parts = lines.select(F.split("line", "\t").alias("p")).where(F.size("p") >= 2)
    return parts.select(F.col("p")[0].alias("expression"), F.col("p")[1].alias("tag"),
                        F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(SCORE)).alias("score"))


class Trie:
    """Expressions by their words. A node is a dictionary of the words that may follow; the empty word marks an end."""

    def __init__(self, expressions: list[list[str]]) -> None:
        self.root: dict = {}
        for words in expressions:
            node = self.root
            for w in words:
                node = node.setdefault(w, {})
            node[""] = True

    def tokens(self, words: list[str]) -> list[str]:
        """Words with every expression as one token: at each place the longest one that begins there, from left to right."""
        out, at, n, root = [], 0, len(words), self.root
        while at < n:
            node, end, k = root.get(words[at]), at + 1, at + 1
            while node is not None:
                if "" in node:
                    end = k
                node = node.get(words[k]) if k < n else None
                k += 1
            out.append(words[at] if end == at + 1 else " ".join(words[at:end]))
            at = end
        return out


def dictionary_tokens(docs: DataFrame, entries: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """(ids..., tokens): white-space tokens of the lower-cased text, expressions of ``entries`` (expression) kept whole.

    The dictionary goes to every task; one of more than ``LARGEST`` characters stops the job.
    """
    cut = entries.select(ws_tokens(F.col("expression")).alias("words")).where(F.size("words") > 0).distinct()
    size = cut.agg(F.sum(F.length(F.array_join("words", " "))).alias("n")).first()["n"] or 0
    if size > LARGEST:
        raise ValueError(f"the dictionary has {size} characters, more than {LARGEST}")
    sent = docs.sparkSession.sparkContext.broadcast(cut.toArrow()["words"].to_pylist())
    source = docs.select(*ids, ws_tokens(F.col(text)).alias("words"))
    schema = T.StructType([*[source.schema[c] for c in ids], T.StructField("tokens", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        for batch in (piece for whole in batches for piece in pieces(whole, "words")):
            at = batch.schema.get_field_index
            tokens = [None if w is None else trie.tokens(w) for w in batch.column(at("words")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(at(c)) for c in ids], pa.array(tokens, pa.list_(pa.string()))],
                                             names=[*ids, "tokens"])

    return source.mapInArrow(run, schema)
