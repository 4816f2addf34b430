"""Settings per knowledge base as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds of every level of a chunk size list.
LEAST_SIZE, MOST_SIZE = 64, 8192
# Fixed values: (key, type, default, minimum, maximum, allowed values, overridable).
RULES = [
    ("ingestion.max_file_size_mb", "int", "200", 1.0, 1024.0, None, True),
    ("ingestion.min_content_chars", "int", "200", 0.0, 5000.0, None, True),
    ("ingestion.html_extraction_policy", "enum", "lenient", None, None, "strict|lenient|balanced", True),
    ("ingestion.parser_plugins", "str", "", None, None, None, False),
    ("chunking.strategy", "enum", "recursive", None, None, "recursive|semantic|hierarchical", True),
    ("chunking.chunk_size", "int", "1024", 64.0, 8192.0, None, True),
    ("chunking.chunk_overlap", "int", "128", 0.0, 8191.0, None, True),
    ("chunking.semantic_threshold", "float", "0.8", 0.0, 1.0, None, True),
    ("chunking.min_chunk_chars", "int", "30", 1.0, 2000.0, None, True),
    ("chunking.code_max_chars", "int", "1500", 100.0, 20000.0, None, True),
    ("dedup.enabled", "bool", "true", None, None, None, True),
    ("dedup.simhash.ngram", "int", "3", None, None, None, False),
    ("dedup.simhash.num_bands", "int", "4", None, None, None, False),
    ("dedup.simhash.simhash_bits", "int", "64", None, None, None, False),
    ("dedup.simhash.hamming_identical_threshold", "int", "3", 0.0, 19.0, None, True),
    ("dedup.simhash.hamming_similar_threshold", "int", "10", 0.0, 19.0, None, True),
    ("dedup.minhash.jaccard_threshold", "float", "0.65", 0.0, 1.0, None, True),
    ("dedup.minhash.title_fuzzy_threshold", "float", "0.85", 0.0, 1.0, None, True),
    ("dedup.minhash.title_only_min_jaccard_floor", "float", "0.25", 0.0, 1.0, None, True),
    ("dedup.minhash.user_words_path", "str", "", None, None, None, False),
    ("dedup.chunk_compare.chunk_match_threshold", "float", "0.5", 0.0, 1.0, None, True),
    ("dedup.chunk_compare.body_identical_threshold", "float", "0.95", 0.0, 1.0, None, True),
    ("dedup.chunk_compare.body_similar_threshold", "float", "0.75", 0.0, 1.0, None, True),
    ("dedup.chunk_compare.compare_all_candidates", "bool", "false", None, None, None, True),
    ("retrieval.mode", "enum", "hybrid", None, None, "hybrid|similarity", False),
    ("retrieval.top_k", "int", "10", None, None, None, False),
    ("retrieval.hybrid.alpha", "float", "0.5", None, None, None, False),
    ("retrieval.hybrid.rrf_k", "int", "60", None, None, None, False),
    ("retrieval.similarity.min_score", "float", "0.0", None, None, None, False),
    ("retrieval.rerank.enabled", "bool", "true", None, None, None, False),
    ("retrieval.rerank.provider", "enum", "jina", None, None, "jina|internal", False),
    ("retrieval.rerank.top_n", "int", "3", None, None, None, False),
    ("retrieval.rerank.timeout_sec", "int", "5", None, None, None, False),
    ("retrieval.rerank.fallback_on_error", "bool", "true", None, None, None, False),
    ("retrieval.auto_merge.enabled", "bool", "false", None, None, None, True),
    ("retrieval.auto_merge.merge_threshold", "float", "0.5", 0.0, 1.0, None, True),
    ("retrieval.cache.enabled", "bool", "false", None, None, None, False),
    ("retrieval.cache.ttl_seconds", "int", "3600", 1.0, None, None, False),
    ("retrieval.cache.max_entries", "int", "1000", 1.0, None, None, False),
    ("retrieval.cache.match_mode", "enum", "exact", None, None, "exact|semantic", False),
    ("retrieval.cache.semantic_threshold", "float", "0.95", 0.0, 1.0, None, False),
]
SECTIONS = ("ingestion.", "chunking.", "dedup.", "retrieval.")


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES, "key string, type string, default string, low double, high double, allowed string, overridable boolean")


def resolve(kbs: DataFrame, overrides: DataFrame, rules: DataFrame) -> DataFrame:
    """(kb_id, key, value): the defaults overlaid by the rows of each knowledge base.

    The rules are a fixed short list, packed into one row and exploded per knowledge base.
    """
    packed = rules.agg(F.array_sort(F.collect_list(F.struct("key", "default"))).alias("rules"))
    base = kbs.select("kb_id").distinct().join(F.broadcast(packed)).select("kb_id", F.explode("rules").alias("r")).select(
        "kb_id", F.col("r.key").alias("key"), F.col("r.default").alias("default"))
    return base.join(overrides, ["kb_id", "key"], "left").select(
        "kb_id", "key", F.coalesce("value", "default").alias("value"), F.col("value").isNotNull().alias("overridden"))


def wide(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """One row per knowledge base with a column per key, to join to data of many bases in one job."""
    return resolved.groupBy("kb_id").agg(*[
        F.max(F.when(F.col("key") == k, F.col("value"))).alias(k.rsplit(".", 1)[-1]) for k in keys])


def violations(overrides: DataFrame, rules: DataFrame) -> DataFrame:
    """(kb_id, key, value, reason) of overrides that must not be stored."""
    section = F.lit(False)
    for s in SECTIONS:
        section = section | F.col("key").startswith(s)
    number = F.col("value").try_cast("double")
    j = overrides.join(F.broadcast(rules), "key", "left")
    typed = F.when(F.col("type") == "int", F.col("value").try_cast("bigint").isNull()).when(
        F.col("type") == "float", number.isNull()).when(
        F.col("type") == "bool", ~F.col("value").isin("true", "false")).when(
        F.col("type") == "enum", ~F.array_contains(F.split("allowed", r"\|"), F.col("value"))).otherwise(F.lit(False))
    listed = F.from_json("value", "array<int>")
    levels = (F.col("key") == "chunking.chunk_size") & F.col("value").startswith("[")
    descending = F.forall(F.sequence(F.lit(1), F.greatest(F.size(listed) - 1, F.lit(1))), lambda i: F.coalesce(
        F.get(listed, i - 1) > F.get(listed, i), F.lit(False)))
    bad_levels = ~F.coalesce((F.size(listed) >= 2) & descending & F.forall(
        listed, lambda s: s.between(LEAST_SIZE, MOST_SIZE)), F.lit(False))
    typed = F.when(levels, bad_levels).otherwise(typed)
    reason = F.when(~section, "not overridable").when(F.col("type").isNull(), "unknown key").when(
        ~F.col("overridable"), "not overridable").when(typed, "bad value").when(
        F.coalesce(number < F.col("low"), F.lit(False)) | F.coalesce(number > F.col("high"), F.lit(False)), "out of range")
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("kb_id", "key", "value", "reason")


def overlap_violations(resolved: DataFrame) -> DataFrame:
    """(kb_id, chunk_size, chunk_overlap) of knowledge bases whose effective overlap is above 15 % of their (smallest)
    chunk size. ``resolved`` comes from :func:`resolve`."""
    sizes = wide(resolved, ["chunking.chunk_size", "chunking.chunk_overlap"])
    smallest = F.coalesce(F.col("chunk_size").try_cast("int"), F.array_min(F.from_json("chunk_size", "array<int>")))
    return sizes.where(F.col("chunk_overlap").try_cast("int") > smallest * F.lit(0.15))


def put(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace all rows of the knowledge bases that send a set."""
    return current.join(fresh.select("kb_id").distinct(), "kb_id", "left_anti").unionByName(
        fresh.filter(F.col("key").isNotNull()))


def patch(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Set the given keys; a null value deletes one."""
    c = changes.select("kb_id", "key", F.col("value").alias("new"), F.lit(True).alias("named"))
    return current.join(c, ["kb_id", "key"], "full_outer").select(
        "kb_id", "key", F.when(F.col("named"), F.col("new")).otherwise(F.col("value")).alias("value")).filter(
        F.col("value").isNotNull())
