"""Source files as rows: bytes, signatures and decoded text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import excluded, is_source, mebibytes
from ..settings import encoding

_MARK = b"\xef\xbb\xbf"
#: Files, at least, and bytes, at most, of a code base that is held at once.
IN_MEMORY_FILES, IN_MEMORY_BYTES = 1024, 128 << 20


def decode(data: bytes | None, how: str = "auto") -> tuple[str, str, bool]:
    """(text, encoding used, lossy). auto: a byte order mark or strict UTF-8, else cp932 with replacement; utf8 fails on bad bytes."""
    data, how = data or b"", encoding(how)
    if how != "cp932":
        try:
            return data.removeprefix(_MARK).decode("utf-8"), "utf8", False
        except UnicodeDecodeError:
            if how == "utf8" or data.startswith(_MARK):
                raise
    try:
        return data.decode("cp932"), "cp932", False
    except UnicodeDecodeError:
        return data.decode("cp932", "replace"), "cp932", True


def scan(spark: SparkSession, paths: str | list[str], how: str = "auto", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, text, used_encoding, lossy, size, mtime_ms of the source files under the paths, recursively."""
    return decoded(signatures(spark, paths, exclude, content=True), how).select("path", "text", "used_encoding", "lossy", "size", "mtime_ms")


def decoded(files: DataFrame, how: str = "auto") -> DataFrame:
    """The files with text, used_encoding and lossy instead of their content. Valid UTF-8 is read without leaving the JVM; other bytes are decoded in batches."""
    how = encoding(how)
    raw = F.col("content").cast("string")
    plain = F.is_valid_utf8(F.coalesce(raw, F.lit(""))) if how != "cp932" else F.lit(False)

    @F.pandas_udf("struct<text:string,used_encoding:string,lossy:boolean>")
    def other(content: pd.Series) -> pd.DataFrame:
        rows = [decode(c, how) if c is not None else ("", "", False) for c in content]
        return pd.DataFrame(rows, columns=["text", "used_encoding", "lossy"])

    text = F.coalesce(F.when(F.startswith(raw, F.lit("\ufeff")), F.substr(raw, F.lit(2))).otherwise(raw), F.lit(""))
    marked = files.withColumn("_plain", plain).withColumn("_d", other(F.when(~F.col("_plain"), F.coalesce(F.col("content"), F.unhex(F.lit(""))))))
    told = {"text": text, "used_encoding": F.lit("utf8"), "lossy": F.lit(False)}
    return marked.withColumns({c: F.when(F.col("_plain"), v).otherwise(F.col(f"_d.{c}")) for c, v in told.items()}).drop("_plain", "_d", "content")


def signatures(spark: SparkSession, paths: str | list[str], exclude: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """path, size, mtime_ms of source files; the content column is not read unless asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = found.where(is_source(F.col("path")) & ~excluded(F.col("path"), exclude))
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), *(["content"] if content else []))


def encoding_usage(files: DataFrame) -> DataFrame:
    return files.groupBy("used_encoding").agg(F.count("*").alias("files"), F.count_if("lossy").alias("lossy"), F.min(F.when(F.col("lossy"), F.col("path"))).alias("first_lossy"))


def volume(files: DataFrame, *by: str) -> DataFrame:
    """files, bytes, mib, in_memory of each group of files (size): whether they are many but small enough to be held at once. A file of unknown size is too large."""
    g = files.groupBy(*by).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"), F.count_if(F.col("size").isNull()).alias("_unknown"))
    fits = (F.col("files") >= IN_MEMORY_FILES) & (F.coalesce("bytes", F.lit(0)) <= IN_MEMORY_BYTES) & (F.col("_unknown") == 0)
    return g.withColumn("mib", mebibytes(F.col("bytes"))).withColumn("in_memory", fits).drop("_unknown")
