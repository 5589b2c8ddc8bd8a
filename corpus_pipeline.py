"""The corpus pipeline: toxicity, near-dedup, secrets, mixing and tokens, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlake.llm import minhash, mixing, secret_scan, sentencepiece_codec, toxicity
from impactlake.llm.common import cut, held_out, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay; the model learns from labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels), spans=False)
    return scored.where(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return minhash.classes(docs, one_each=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and n_chars follows."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' targets, one row for each draw, shuffled within output shards."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    out = sentencepiece_codec.encode(docs, keep=["doc_id", "source", "text"])
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit(sentencepiece_codec.SPACE), F.lit(" ")))
    return out.select("doc_id", "source", "n_tokens", "input_ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Trained models, hashes and draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
