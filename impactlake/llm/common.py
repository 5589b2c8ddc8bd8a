"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, scratch  # noqa: F401

#: ASCII white space that separates words: space, tab and the four controls 0x0A-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Returns a worker's freed memory to the system; workers live on, and later stages need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library trims
        pass


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """A column name for each wish that no column of df has, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = name
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def bounded_sample(rows: DataFrame, key: Column, most: int, seed: int) -> DataFrame:
    """About `most` of the rows and never over 1.25 times as many, the same ones on each run, chosen by a hash of the key."""
    n = rows.count()
    if n <= most:
        return rows
    rank = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000))
    return rows.where(rank < F.lit(int(1_000_000 * most / n) + 1)).limit(int(1.25 * most))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(sizes: np.ndarray, most: int) -> list[slice]:
    """Consecutive slices whose sizes sum to about `most`; a larger item stands alone."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            out.append(slice(start, i))
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        out.append(slice(start, len(sizes)))
    return out


def arrow_schema(df_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
