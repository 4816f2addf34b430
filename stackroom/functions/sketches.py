"""Expressions on SimHash fingerprints and MinHash signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMHASH_BANDS, SIMHASH_BAND_BITS = 4, 16
MINHASH_SIZE, MINHASH_BANDS = 128, 16


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_band_values(simhash: Column) -> Column:
    """The 16-bit slices of a fingerprint, low bits first."""
    return F.array(*[
        F.shiftrightunsigned(simhash, i * SIMHASH_BAND_BITS).bitwiseAND(F.lit(0xFFFF)).cast("int")
        for i in range(SIMHASH_BANDS)])


def minhash_band_keys(signature: Column) -> Column:
    """One key per band of consecutive positions; equal keys mean equal positions."""
    rows = MINHASH_SIZE // MINHASH_BANDS
    return F.array(*[
        F.md5(F.array_join(F.slice(signature, i * rows + 1, rows), ",")) for i in range(MINHASH_BANDS)])


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 for an empty signature."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0),
                        lambda s, v: s + F.coalesce(v, F.lit(0)))
    return F.when(F.size(a) > 0, equal / F.size(a)).otherwise(F.lit(0.0))
