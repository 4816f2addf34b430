"""Index tables that grow: every change is a generation, added beside the ones before.

A generation holds fresh rows and the keys that it replaces; a key without fresh rows is deleted. Reading takes of each key the rows
of its last generation, so a change of ten documents writes the rows and keys of ten documents, whatever the table holds.
A generation counts once its mark stands: a file named after it that holds the number of the oldest generation still
needed. Readers look for the highest mark. A job that fails before leaves files that no mark names, and a later attempt
writes over them; a mark that a failed job left empty is passed over and its number is not used again. Of two writers
of one generation the second fails, as a mark is never overwritten.

:func:`compact` writes the current rows as a generation that needs no older one; :func:`clean` deletes what no reader
of the last mark needs. Null keys are never replaced and stay.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEN = "_gen"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _marks(spark: SparkSession, path: str) -> dict[int, int]:
    """Length of the mark of each generation."""
    fs, at = _fs(spark, f"{path}/marks")
    names = fs.listStatus(at) if fs.exists(at) else []
    return {int(s.getPath().getName().removeprefix("mark-")): s.getLen() for s in names if s.getPath().getName().startswith("mark-")}


def _name(path: str, gen: int) -> str:
    return f"{path}/marks/mark-{gen:012d}"


def current(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(last generation, oldest one needed); None for a table that was never written."""
    last = max((gen for gen, size in _marks(spark, path).items() if size), default=None)
    if last is None:
        return None
    fs, at = _fs(spark, _name(path, last))
    stream = fs.open(at)
    try:
        return last, int(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _next(spark: SparkSession, path: str) -> int:
    return max(_marks(spark, path), default=-1) + 1


def _mark(spark: SparkSession, path: str, gen: int, oldest: int) -> None:
    fs, at = _fs(spark, _name(path, gen))
    stream = fs.create(at, False)
    stream.write(bytearray(str(oldest).encode()))
    stream.close()


def _write(fresh: DataFrame, changed: DataFrame | None, path: str, key: str, gen: int, oldest: int) -> None:
    spark = fresh.sparkSession
    fresh.write.mode("overwrite").parquet(f"{path}/rows/{GEN}={gen}")
    if changed is not None:
        changed.select(key).distinct().write.mode("overwrite").parquet(f"{path}/keys/{GEN}={gen}")
    else:
        fs, stale = _fs(spark, f"{path}/keys/{GEN}={gen}")
        fs.delete(stale, True)
    _mark(spark, path, gen, oldest)


def create(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """First generation of a table; an empty one keeps its columns."""
    _write(rows, None, path, key, 0, 0)


def upsert(fresh: DataFrame, changed: DataFrame, path: str, key: str = "doc_id") -> int:
    """A new generation in which the changed keys have the fresh rows and no others. The number of the generation.

    ``fresh`` and ``changed`` may be made from the table's own rows: what is read was written before.
    """
    spark = fresh.sparkSession
    gen = _next(spark, path)
    _write(fresh, changed, path, key, gen, current(spark, path)[1])
    return gen


def read(spark: SparkSession, path: str, key: str = "doc_id", at: int | None = None) -> DataFrame:
    """The rows of the last generation, or of an earlier one that is still there."""
    last, oldest = current(spark, path)
    last = last if at is None else at
    lost = [gen for gen, size in _marks(spark, path).items() if not size]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(
        F.col(GEN).between(oldest, last) & ~F.col(GEN).isin(lost))
    try:
        keys = spark.read.option("basePath", f"{path}/keys").parquet(f"{path}/keys")
    except AnalysisException:
        return rows.drop(GEN)
    newest = keys.where((F.col(GEN) > oldest) & (F.col(GEN) <= last) & ~F.col(GEN).isin(lost)).groupBy(F.col(key).alias("_key")).agg(
        F.max(GEN).alias("_newest"))
    kept = rows.join(newest, F.col(key) == F.col("_key"), "left")
    return kept.where(F.col("_newest").isNull() | (F.col(GEN) >= F.col("_newest"))).drop("_key", "_newest", GEN)


def rollback(spark: SparkSession, path: str, to: int | None) -> None:
    """Forget the generations after ``to``; all of them for None. For a job that writes several tables and was cut short."""
    fs, _ = _fs(spark, path)
    for gen in _marks(spark, path):
        if to is None or gen > to:
            fs.delete(_fs(spark, _name(path, gen))[1], False)


def compact(spark: SparkSession, path: str, key: str = "doc_id") -> int:
    """The current rows as one generation that needs no other."""
    gen = _next(spark, path)
    read(spark, path, key).write.mode("overwrite").parquet(f"{path}/rows/{GEN}={gen}")
    _mark(spark, path, gen, gen)
    return gen


def clean(spark: SparkSession, path: str) -> None:
    """Delete generations older than the oldest one needed, and their marks. For when no reader of an older mark is left."""
    _, oldest = current(spark, path)
    for part, prefix in (("rows", f"{GEN}="), ("keys", f"{GEN}="), ("marks", "mark-")):
        fs, at = _fs(spark, f"{path}/{part}")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            name = s.getPath().getName()
            if name.startswith(prefix) and int(name.removeprefix(prefix)) < oldest:
                fs.delete(s.getPath(), True)
