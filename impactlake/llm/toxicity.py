"""Toxic spans by a linear-chain conditional random field.

Only documents carry labels, so training tokens are labelled first: a word or word stem counts as toxic
where a likelihood-ratio test over a bounded sample of labelled documents ties it to toxic ones. The
field (two states, features of the word, its stems and its neighbours, learned transitions) is fitted to
windows of those labelled tokens by the exact gradient. Forward-backward marginals of whole texts give
the offending offsets, and a logistic curve over the strongest marginal and the expected number of toxic
tokens gives the document's score.

The chain is computed in chunks: transfer matrices of all chunks advance together, are joined along each
text, and give exact marginals for texts of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, fresh, give_back, held_out, mix64, table
from .textarrays import parts

#: Labelled rows that training sees at most (1.25 times as many in the worst case).
SAMPLE_ROWS = 4000
#: Log-likelihood ratio from which a word or stem counts as tied to toxic documents, and the share of toxic ones among its documents.
EVIDENCE, PURITY = 10.0, 0.9
LEAST_DOCUMENTS = 3
#: Training rounds of the field, for any number of sequences.
ROUNDS = 150
#: Words on each side of a labelled one in a training window.
WINDOW = 8
CHUNK = 128
#: Chunks worked on at once: about 20 MB.
BLOCK_CHUNKS = 512
#: Training windows that a sampled toxic and a sampled clean document give at most, chosen by a hash of their places.
TOXIC_WINDOWS, CLEAN_WINDOWS = 4, 1
CACHE_WORDS = 150_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_COMMON_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def plain(word: str) -> str:
    w = word.strip(_COMMON_EDGES).lower()
    return w if w[:1].isalnum() and w[-1:].isalnum() else _EDGE.sub("", w)


def features(word: str) -> tuple[str, ...]:
    """The word without punctuation at its ends, after "=", and its stems of 4, 5 and 6 characters."""
    w = plain(word)
    return ("=" + w, *(w[:n] for n in (4, 5, 6) if len(w) >= n))


def _chunk_passes(odds: np.ndarray, at: np.ndarray, real: np.ndarray, opening: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """fore and back of each token inside its chunk (token, chunk, 2, 2), and the whole chunks' transfer matrices in both directions."""
    rows = len(at)
    e = np.ones((rows, CHUNK, 2))
    e[:, :, 1] = odds[at]
    e /= e.sum(axis=2, keepdims=True)
    fore = np.empty((CHUNK, rows, 2, 2))
    m = eye = np.broadcast_to(np.eye(2), (rows, 2, 2))
    for k in range(CHUNK):
        step = t[None] * e[:, k, None, :]
        if k == 0:  # the first token of a text has no transition into it
            step = np.where(opening[:, None, None], np.eye(2)[None] * e[:, 0, None, :], step)
        new = m @ step
        new /= new.sum(axis=(1, 2), keepdims=True)
        m = np.where(real[:, k, None, None], new, m)
        fore[k] = m
    back = np.empty((CHUNK, rows, 2, 2))  # what follows token k inside the chunk
    b = eye
    for k in range(CHUNK - 1, -1, -1):
        back[k] = b
        new = (t[None] * e[:, k, None, :]) @ b
        new /= new.sum(axis=(1, 2), keepdims=True)
        b = np.where(real[:, k, None, None], new, b)
    return fore, back, m, b


def marginals(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int = BLOCK_CHUNKS) -> np.ndarray:
    """P(state 1) of each token of texts of the given sizes, laid end to end; unary is the log odds of state 1.

    Chunks are worked on `block` at a time, so a text of any length needs little more than its words' numbers; beyond one block, chunks are
    walked twice: for their transfer matrices, and, once these are joined along the texts, for the marginals.
    """
    out = np.zeros(len(unary))
    if not len(unary):
        return out
    chunks = -(-sizes // CHUNK)
    rows = int(chunks.sum())
    first = np.cumsum(chunks) - chunks  # of each text
    text_of = np.repeat(np.arange(len(sizes)), chunks)
    number = np.arange(rows) - first[text_of]
    begin = (np.cumsum(sizes) - sizes)[text_of] + number * CHUNK
    length = np.minimum(CHUNK, sizes[text_of] - number * CHUNK)
    odds, t = np.exp(np.clip(unary, -30, 30)), np.exp(trans)

    def places(s: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(begin[s, None] + np.arange(CHUNK), len(unary) - 1)
        return at, np.arange(CHUNK) < length[s, None], number[s] == 0

    pieces = [slice(k, min(k + block, rows)) for k in range(0, rows, block)]
    ahead, behind = np.empty((rows, 2, 2)), np.empty((rows, 2, 2))
    for s in pieces:
        at, real, opening = places(s)
        fore, back, ahead[s], behind[s] = _chunk_passes(odds, at, real, opening, t)
    enter, leave = np.empty((rows, 2)), np.ones((rows, 2))
    vector = np.broadcast_to(np.exp(start), (len(sizes), 2)).copy()
    most = int(chunks.max(initial=0))
    for j in range(most):
        on = np.flatnonzero(chunks > j)
        r = first[on] + j
        enter[r] = vector[on]
        v = np.einsum("ri,rij->rj", vector[on], ahead[r])
        vector[on] = v / v.sum(axis=1, keepdims=True)
    after = np.ones((len(sizes), 2))
    for j in range(most - 1, -1, -1):
        on = np.flatnonzero(chunks > j)
        r = first[on] + j
        leave[r] = after[on]
        v = np.einsum("rij,rj->ri", behind[r], after[on])
        after[on] = v / v.sum(axis=1, keepdims=True)
    for s in pieces:
        if len(pieces) > 1:
            at, real, opening = places(s)
            fore, back, _, _ = _chunk_passes(odds, at, real, opening, t)
        p = np.einsum("ri,krij->krj", enter[s], fore) * np.einsum("krij,rj->kri", back, leave[s])
        p = p[:, :, 1] / p.sum(axis=2)
        out[at[real]] = p.T[real]
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    around: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    curve: tuple[float, float, float] = (-4.0, 6.0, 1.0)
    _at: dict = field(default_factory=dict)
    _own: np.ndarray | None = None
    _dicts: tuple | None = None

    def _tables(self) -> tuple[dict, dict, dict, dict]:
        """(own, near) weights by word and by stem of 4, 5 and 6 characters, so that a lookup needs no new string."""
        out: tuple[dict, dict, dict, dict] = ({}, {}, {}, {})
        for f in {**self.weights, **self.around}:
            pair = self.weights.get(f, 0.0), self.around.get(f, 0.0)
            if f[:1] == "=":
                out[0][f[1:]] = pair
            else:
                out[len(f) - 3][f] = pair
        return out

    def of_words(self, words) -> list[tuple[float, float]]:
        """Log odds that each word adds to itself and to each neighbour."""
        whole, four, five, six = self._tables() if self._dicts is None else self._dicts
        self._dicts = whole, four, five, six
        bias, none, out = self.bias, (0.0, 0.0), []
        for word in words:
            w = plain(word)
            x, y, z, v = whole.get(w, none), four.get(w[:4], none), five.get(w[:5], none), six.get(w[:6], none)
            out.append((bias + x[0] + y[0] + z[0] + v[0], x[1] + y[1] + z[1] + v[1]))
        return out

    def unary(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        at = self._at
        new = list(set(words).difference(at))
        if len(at) + len(new) > CACHE_WORDS or self._own is None:
            at.clear()
            new, self._own = list(set(words)), np.zeros((0, 2))
        if new:
            at.update(zip(new, range(len(at), len(at) + len(new))))
            self._own = np.concatenate([self._own, np.array(self.of_words(new))])
        both = self._own[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
        u, near = both[:, 0].copy(), both[:, 1]
        if len(u) > 1:
            text = np.repeat(np.arange(len(sizes)), sizes)
            same = text[1:] == text[:-1]
            u[1:] += near[:-1] * same
            u[:-1] += near[1:] * same
        return u

    def tag(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of the texts, and each text's number of words."""
        found = [_WORD.findall(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        words = [w for f in found for w in f]
        return marginals(self.unary(words, sizes), sizes, self.trans, self.start), sizes

    def summary(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each text: 1, its strongest marginal, and the logarithm of 1 + its expected toxic words."""
        out = np.zeros((len(sizes), 3))
        out[:, 0] = 1
        some = np.flatnonzero(sizes)
        if len(some):
            at = (np.cumsum(sizes) - sizes)[some]
            out[some, 1] = np.maximum.reduceat(p, at)
            out[some, 2] = np.log1p(np.add.reduceat(np.where(p > 0.5, p, 0.0), at))
        return out

    def forget(self) -> None:
        """Drops the words seen."""
        self._at, self._own, self._dicts = {}, None, None

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(p, sizes) @ np.array(self.curve), -30, 30)))


def _features_of(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text)) for f in features(w)}


def lexicon(bad: dict[str, int], fine: dict[str, int], share: float) -> set[str]:
    """Words and stems that the likelihood-ratio test ties to toxic documents, from their numbers of toxic and clean documents and the toxic share."""
    base = min(max(share, 1e-3), 1 - 1e-3)
    out = set()
    for f, k in bad.items():
        n = k + fine.get(f, 0)
        if k < LEAST_DOCUMENTS or k / n < PURITY:
            continue
        ratio = k * np.log(k / n / base) + ((n - k) * np.log((n - k) / n / (1 - base)) if k < n else 0.0)
        if ratio >= EVIDENCE:
            out.add(f)
    return out


def windows(text: str, bad: int, told: set[str]) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of a document's training windows: around marked words of a toxic one, anywhere in a clean one."""
    ws = _WORD.findall(text)
    width = 2 * WINDOW + 1
    marked = [i for i, w in enumerate(ws) if any(f in told for f in features(w))] if bad else []
    most = TOXIC_WINDOWS if marked else CLEAN_WINDOWS
    seed = np.uint64(hash_text(text))
    rank = mix64(seed + np.arange(len(marked) or len(ws), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for k in np.sort(np.argsort(rank, kind="stable")[:most]).tolist():
        c = marked[k] if marked else k
        first = min(max(0, c - WINDOW), max(0, len(ws) - width))
        part = ws[first : first + width]
        out.append((part + [""] * (width - len(part)), [int(bool(bad) and any(f in told for f in features(w))) for w in part] + [0] * (width - len(part))))
    return out


def _start(y: np.ndarray) -> Model | None:
    """A model without a field where only one label is there."""
    if len(y) and y.min() != y.max():
        return None
    model = Model()
    model.curve = (float(np.log(0.02 + 0.9 * (y.mean() if len(y) else 0.0))), 0.0, 0.0)
    return model


def _field(found: list[tuple[list[str], list[int]]]) -> Model:
    """A field fitted to windows, in an order that their words alone settle."""
    model = Model()
    found = sorted(found, key=lambda w: (hash_text(" ".join(w[0])), w))
    if found:
        _train(model, [w for w, _ in found], np.array([y for _, y in found], float))
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """The curve, by Newton steps on the documents' summaries, held near a prior."""
    prior = np.array([-3.0, 4.0, 1.0])
    w = prior.copy()
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (q - y) + 0.1 * (w - prior))
    return tuple(float(v) for v in w)


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A field and a curve from texts and their labels, all here at once; train() does the same for a table."""
    y = np.array(toxic, int)
    plain_model = _start(y)
    if plain_model:
        return plain_model
    counted: tuple[Counter, Counter] = Counter(), Counter()
    for text, bad in zip(texts, y, strict=True):
        counted[0 if bad else 1].update(_features_of(text))
    told = lexicon(*counted, float(y.mean()))
    model = _field([w for text, bad in zip(texts, y, strict=True) for w in windows(text, bad, told)])
    order = np.argsort([hash_text(t) for t in texts], kind="stable")
    x = np.concatenate([model.summary(*model.tag([texts[i] for i in order[k : k + 200]])) for k in range(0, len(texts), 200)])
    model.curve = _curve(x, y[order])
    model.forget()
    return model


def _train(model: Model, seqs: list[list[str]], y: np.ndarray, rounds: int = ROUNDS) -> None:
    """Fits weights and transitions to sequences of one length by Adagrad on the exact gradient."""
    names: dict[str, int] = {}
    n, width = y.shape
    rows, cols = [], []
    for i, seq in enumerate(seqs):
        for j, w in enumerate(seq):
            for f in features(w):
                rows.append(i * width + j)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    k = len(names)
    w, near, bias, trans = np.zeros(k), np.zeros(k), np.array([-3.0]), np.zeros((2, 2))
    sums = [np.full(k, 1e-2), np.full(k, 1e-2), np.full(1, 1e-2), np.full((2, 2), 1e-2)]
    for _ in range(rounds):
        own = np.bincount(rows, w[cols], n * width).reshape(n, width)
        side = np.bincount(rows, near[cols], n * width).reshape(n, width)
        u = own + bias[0]
        u[:, 1:] += side[:, :-1]
        u[:, :-1] += side[:, 1:]
        e = np.stack([np.ones_like(u), np.exp(np.clip(u, -30, 30))], axis=2)
        t = np.exp(trans)
        alpha, beta = np.empty((n, width, 2)), np.ones((n, width, 2))
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, width):
            a = (alpha[:, j - 1] @ t) * e[:, j]
            alpha[:, j] = a / a.sum(axis=1, keepdims=True)
        for j in range(width - 2, -1, -1):
            b = (e[:, j + 1] * beta[:, j + 1]) @ t.T
            beta[:, j] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p = p[:, :, 1] / p.sum(axis=2)
        pair = np.zeros((2, 2))
        for j in range(1, width):
            z = alpha[:, j - 1, :, None] * t[None] * (e[:, j] * beta[:, j])[:, None, :]
            z /= z.sum(axis=(1, 2), keepdims=True)
            yy = np.stack([1 - y, y], axis=2)
            pair += (z - yy[:, j - 1, :, None] * yy[:, j, None, :]).sum(axis=0)
        d = (p - y) / n
        beside = np.zeros_like(d)
        beside[:, :-1] += d[:, 1:]
        beside[:, 1:] += d[:, :-1]
        grads = [np.bincount(cols, d.ravel()[rows], k) + 1e-5 * w, np.bincount(cols, beside.ravel()[rows], k) + 1e-4 * near, np.array([d.sum()]), pair / n + 1e-3 * trans]
        for value, g, s in zip([w, near, bias, trans], grads, sums, strict=True):
            s += g * g * 1e4
            value -= 60.0 * g / np.sqrt(s) * 0.5 if value is not bias and value is not trans else 5.0 * g / np.sqrt(s)
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
    model.around = {f: float(near[i]) for f, i in names.items() if abs(near[i]) > 5e-2}
    model.bias, model.trans = float(bias[0]), trans


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from a bounded sample of labelled documents; docs need doc_id and text, labels doc_id and toxic.

    Documents are read where they are: what comes to the driver is the toxic documents' words and stems that pass the test, at most
    TOXIC_WINDOWS windows of 2 * WINDOW + 1 words a sampled document, and three numbers each.
    """
    named = bounded_sample(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic"), F.col("doc_id"), rows, 6)
    chosen = cut(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(named), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).limit(2 * rows))
    totals = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    y = np.repeat(list(totals.keys()), list(totals.values())).astype(int)
    plain_model = _start(y)
    if plain_model:
        return plain_model

    def words(batches):
        for batch in batches:
            for part, texts in parts(batch, "text"):
                for text, bad in zip(texts, part.column(1).to_pylist(), strict=True):
                    found = sorted(_features_of(text))
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), bad, np.int32))], names=["f", "toxic"])
        give_back()

    counted = chosen.mapInArrow(words, "f string, toxic int").groupBy("f").agg(F.count_if(F.col("toxic") != 0).alias("bad"), F.count_if(F.col("toxic") == 0).alias("fine"))
    likely = counted.where((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("bad") >= F.lit(PURITY) * (F.col("bad") + F.col("fine")))).collect()
    told = lexicon({r["f"]: r["bad"] for r in likely}, {r["f"]: r["fine"] for r in likely}, float((y != 0).mean()))

    def cutouts(batches):
        for batch in batches:
            for part, texts in parts(batch, "text"):
                found = [w for text, bad in zip(texts, part.column(1).to_pylist(), strict=True) for w in windows(text, bad, told)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.list_(pa.string())), pa.array([m for _, m in found], pa.list_(pa.int32()))], names=["words", "marks"])
        give_back()

    got = chosen.mapInArrow(cutouts, "words array<string>, marks array<int>").toArrow()
    model = _field(list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def numbers(batches):
        m = sent.value
        for batch in batches:
            for part, texts in parts(batch, "text"):
                x = m.summary(*m.tag(texts))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), part.column(1)], names=["most", "all", "toxic"])
        m.forget()
        give_back()

    x = np.array(sorted(tuple(r) for r in chosen.mapInArrow(numbers, "most double, all double, toxic int").collect()), float).reshape(-1, 3)
    model.curve = _curve(np.column_stack([np.ones(len(x)), x[:, :2]]), (x[:, 2] != 0).astype(float))
    return model


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """The rows with tox_score (0 to 1) and, if asked for, tox_spans (start, end in code points, p; words with p over 0.5).

    Clashing names get underscores in front. Null and empty texts have no words and get the score that no toxic word gives.
    Whole texts are read, however long; repeated rows get equal scores, and an empty table gives an empty one.
    """
    name = fresh(docs, "tox_score", "tox_spans")
    fields = docs.schema.fields + [T.StructField(name["tox_score"], T.DoubleType())]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
    if spans:
        fields.append(T.StructField(name["tox_spans"], T.ArrayType(span)))
    schema = T.StructType(fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for part, texts in parts(batch, text_col):
                whole = [t or "" for t in texts]
                p, sizes = m.tag(whole)
                columns = [*part.columns, pa.array(m.scores(p, sizes))]
                if spans:
                    ends = np.cumsum(sizes)
                    rows: list[list] = [[] for _ in whole]
                    for i in np.unique(np.searchsorted(ends, np.flatnonzero(p > 0.5), "right")).tolist():
                        own = p[ends[i] - sizes[i] : ends[i]]
                        rows[i] = [{"start": w.start(), "end": w.end(), "p": float(q)} for w, q in zip(_WORD.finditer(whole[i]), own, strict=True) if q > 0.5]
                    columns.append(pa.array(rows, kind))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        m.forget()
        give_back()

    return docs.mapInArrow(run, schema)


#: Score from which a document counts as toxic.
THRESHOLD = 0.3


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of every whole text, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    out = score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("tox_spans").alias("n_spans"))
