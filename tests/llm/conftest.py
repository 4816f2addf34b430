from __future__ import annotations

import pytest
from fixtures import EXTRA, FOLDER, ODD, SCHEMA
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.collect()


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with columns whose names clash, in several partitions."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ODD], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
