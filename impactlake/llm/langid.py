"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed letter pairs and triples (words padded by a space).
Each language has several centroids, from spherical k-means over a bounded sample of labelled rows; the
nearest centroid by cosine gives the language. A text farther from its centroid than nearly all of the
training texts of that cluster were is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, give_back, held_out, mix64, table
from .textarrays import codes_of, lowered, parts

#: Hash buckets of n-grams.
BUCKETS = 8192
#: Labelled rows whose vectors training clusters, in equal parts for the languages (twice as many at most).
SAMPLE_ROWS = 3000
#: Texts whose bucket counts are held at once.
SLICE = 64
CLUSTERS = 4
#: Part of a cluster's training texts that its radius leaves out.
OUTSIDE = 0.005
UNKNOWN = "und"


def counts(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the n-grams of each text, and its number of letters."""
    codes, offsets = codes_of(texts)
    low = lowered(codes)
    before = np.concatenate([[0], low[:-1]])
    at = np.flatnonzero((low != 0) | (before != 0))  # a run of non-letters becomes one space
    x = np.concatenate([[0], low[at], [0]]).astype(np.uint64)
    doc = np.searchsorted(offsets, at, "right") - 1
    inner = x[1:-1]
    is_letter = inner != 0
    n = np.bincount(doc[is_letter], minlength=len(texts))
    b, a, c, doc = inner[is_letter], x[:-2][is_letter], x[2:][is_letter], doc[is_letter]
    k = np.uint64(0x9E3779B97F4A7C15)
    three = mix64((a * k + b) * k + c) & np.uint64(buckets - 1)
    two = mix64((b * k + c) * k + np.uint64(7)) & np.uint64(buckets - 1)
    place = doc.astype(np.int64) * buckets
    total = np.bincount(place + three.astype(np.int64), minlength=len(texts) * buckets) + np.bincount(place + two.astype(np.int64), minlength=len(texts) * buckets)
    return total.reshape(len(texts), buckets), n


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.log1p(tf).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sims = self.vectors(tf) @ self.centroids.T
        best = sims.argmax(axis=1)
        return best, sims[np.arange(len(best)), best]


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of spherical k-means from farthest-first seeds; empty clusters go."""
    first = (x @ x.mean(axis=0)).argmax()
    seeds, far = [first], x @ x[first]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(int(far.argmin()))
        far = np.maximum(far, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) for j in range(len(c)) if (own == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(tf: np.ndarray, langs: list[str], idf: np.ndarray | None = None, clusters: int = CLUSTERS) -> Model:
    """A model from bucket counts and their languages; idf is theirs unless it is given."""
    idf = weights((tf > 0).sum(axis=0), len(tf)) if idf is None else idf
    model = Model(idf, np.zeros((0, tf.shape[1]), np.float32), [], np.zeros(0))
    if not langs:
        return model
    v, labels = model.vectors(tf), np.array(langs, object)
    for lang in sorted(set(langs)):
        own = _kmeans(v[labels == lang], clusters)
        model.centroids = np.concatenate([model.centroids, own.astype(np.float32)])
        model.langs += [lang] * len(own)
    sims = v @ model.centroids.T
    best = sims.argmax(axis=1)
    model.radius = np.array([np.quantile(1 - sims[best == j, j], 1 - OUTSIDE) + 0.05 if (best == j).any() else 0.0 for j in range(len(model.langs))])
    return model


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies of buckets that df of n texts hold."""
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many of all texts hold each bucket, and the number of texts with a letter; a task gives its sums."""

    def run(batches):
        held, some = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, texts in parts(batch, text_col, 200_000):
                for k in range(0, len(texts), SLICE):
                    tf, n = counts([t or "" for t in texts[k : k + SLICE]])
                    held += (tf > 0).sum(axis=0)
                    some += int((n > 0).sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(held[at], some))], names=["at", "n"])
        give_back()

    got = docs.select(text_col).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row a bucket
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in got:
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from a bounded sample of the rows that have a language and a text with a letter, as many of each language; weights cover all of them.

    A language of fewer rows than its part of the sample gives all of them, so none goes unlearned.
    """
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key_col).alias("_k"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    df, n = frequencies(own, "_t")
    sizes = cut(own.groupBy("_l").agg(F.count("*").alias("_n")))
    each = max(1, rows // max(1, sizes.count()))
    rank = F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(1_000_000))
    keep = (F.col("_n") <= each) | (rank < F.ceil(F.lit(1e6 * each) / F.col("_n")))
    chosen = own.join(sizes, "_l").where(keep).select("_t", "_l").limit(2 * rows)

    def sparse(batches):
        for batch in batches:
            for part, texts in parts(batch, "_t", 200_000):
                for k in range(0, len(texts), SLICE):
                    tf, n = counts(texts[k : k + SLICE])
                    for row, lang, some in zip(tf, part.column(1).slice(k, SLICE).to_pylist(), n > 0, strict=True):
                        if some:
                            at = np.flatnonzero(row)
                            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([row[at].astype(np.int32)], pa.list_(pa.int32()))], names=["lang", "at", "n"])
        give_back()

    got = chosen.mapInArrow(sparse, "lang string, at array<int>, n array<int>").toArrow()
    tf = np.zeros((got.num_rows, BUCKETS), np.float32)
    for i, (at, n_at) in enumerate(zip(got.column(1), got.column(2), strict=True)):
        tf[i, at.values.to_numpy()] = n_at.values.to_numpy()
    langs = got.column(0).to_pylist()
    order = np.lexsort((tf @ np.arange(1, BUCKETS + 1, dtype=np.float32), np.array(langs, str))) if langs else []  # the same model whatever the order of rows
    return fit(tf[order] if langs else tf, [langs[i] for i in order], weights(df, n))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred (nearest), score (cosine, 0 to 1) and rejected (clashing names get underscores in front).

    A null text, or one without a letter, is `und` with score 0 and is rejected; so is all text when nothing was learned.
    Long texts are read whole; an empty table gives an empty one. Of equally near centroids the first wins, in the languages' order.
    """
    name = fresh(docs, "lang_pred", "score", "rejected")
    schema = T.StructType(docs.schema.fields + [T.StructField(name["lang_pred"], T.StringType()), T.StructField(name["score"], T.DoubleType()), T.StructField(name["rejected"], T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        langs = np.array(m.langs + [UNKNOWN], object)
        for batch in batches:
            for part, texts in parts(batch, text_col, 200_000):
                best, score, n = [], [], []
                for k in range(0, len(texts), SLICE):
                    tf, letters_in = counts([t or "" for t in texts[k : k + SLICE]])
                    b, s = m.nearest(tf) if m.langs else (np.full(len(tf), -1), np.zeros(len(tf)))
                    best.append(np.where(letters_in > 0, b, -1))
                    score.append(np.where(letters_in > 0, np.clip(s, 0, 1), 0).astype(float))
                best, score = np.concatenate(best), np.concatenate(score)
                radius = np.append(m.radius, -1.0)[best]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array((1 - score) > radius)], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
