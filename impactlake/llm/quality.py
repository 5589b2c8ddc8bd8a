"""Quality rules as gradient-boosted trees over document statistics.

Fixed base rules reject what is too short or repeats itself; trees, boosted on a bounded sample of
labelled rows, judge the rest. Trees are flattened into numpy arrays of nodes and score all rows of a
batch level by level. On chosen statistics the score may only fall, or only rise: splits against that
direction are refused, and children keep to the middle of their parent's split.
"""

from __future__ import annotations

from collections import namedtuple
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fresh, give_back, held_out, mix64, table
from .textarrays import Words, codes_of, letters, parts

#: Labelled rows that training sees at most (1.25 times as many in the worst case).
SAMPLE_ROWS = 6000
#: Statistics, and the direction in which quality may move as each grows: -1 falls only, 1 rises only, 0 free.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "mark_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "letter_share": 0,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "words_a_line": 0,
}
MIN_WORDS, MOST_REPEATED = 50, 50
#: Score from which the trees keep a document.
KEEP = 0.5
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], np.uint32)
_MARKS = np.array([ord(c) for c in "!?=~^_/\\+@{}[]"], np.uint32)
_BLANK = " \t\n\x0b\x0c\r"

Stats = namedtuple("Stats", "n_words word_chars n_symbols n_dup_lines n_repeat_words x")


def statistics(texts: list[str]) -> Stats:
    """Counts and the matrix of FEATURES of each text."""
    codes, offsets = codes_of(texts)
    w = Words(codes, offsets)
    n = len(texts)
    sums = lambda mask: np.add.reduceat(mask, offsets[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    n_words = w.count.astype(np.int64)
    word_chars = sums(~w.space)
    n_symbols = sums(np.isin(codes, _SYMBOLS))
    _, upper, digit, letter = letters()
    small = np.minimum(codes, 65535)
    n_lines, n_dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(_BLANK)]
            n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
        else:
            n_lines[i] = 1
    three, first = w.shingles(3)
    key = mix64(three ^ mix64(w.doc[first].astype(np.uint64) + np.uint64(11)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(w.start) + 3, bool)
    for k in range(3):
        covered[first[again] + k] = True
    n_repeat = np.bincount(w.doc[covered[: len(w.start)]], minlength=n).astype(np.int64)
    chars, words, lines = np.maximum(word_chars, 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    order = np.lexsort((w.hash, w.doc))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n)
    n_upper, n_letter = sums(upper[small]), sums(letter[small])
    x = np.stack(
        [
            np.log1p(n_words),
            word_chars / words,
            n_symbols / chars,
            sums(np.isin(codes, _MARKS)) / chars,
            n_upper / np.maximum(n_letter, 1),
            sums(digit[small]) / chars,
            n_letter / chars,
            n_dup / lines,
            n_repeat / words,
            distinct / words,
            np.log1p(n_words / lines),
        ],
        axis=1,
    ) if n else np.zeros((0, len(FEATURES)))
    return Stats(n_words, word_chars, n_symbols, n_dup, n_repeat, x)


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf has feature -1. roots holds where each tree begins."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go_left = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0, directions: tuple[int, ...] = tuple(FEATURES.values())) -> Trees:
    """Boosts trees on the logistic loss over binned statistics."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else []
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, 0), int)
    p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    nodes: list[list] = []
    roots = []
    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)

        def grow(rows: np.ndarray, level: int, low: float, high: float, g=g, h=h) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, me, me, rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + least), low, high))])
            margin_of[rows] = nodes[me][4]
            if level == depth or len(rows) < 20:
                return me
            best = None
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                c = codes[rows, j]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + least), low, high), np.clip(-gr / (hr + least), low, high)
                gain = gl**2 / (hl + least) + gr**2 / (hr + least) - total_g**2 / (total_h + least)
                ok = (hl > 1e-3) & (hr > 1e-3) & (directions[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = gain[k], j, k, vl[k], vr[k]
            if best is None:
                return me
            _, j, k, vl, vr = best
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[directions[j]]
            is_left = codes[rows, j] <= k
            left = grow(rows[is_left], level + 1, *bounds[0])
            right = grow(rows[~is_left], level + 1, *bounds[1])
            nodes[me][:4] = [j, float(edges[j][k]), left, right]
            nodes[me][4] = 0.0
            return me

        margin_of = np.zeros(len(y))
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0))
        margin += margin_of
    if not nodes:
        nodes, roots = [[-1, 0.0, 0, 0, 0.0]], [0]
    cols = list(zip(*nodes, strict=True))
    return Trees(np.array(cols[0], np.int32), np.array(cols[1]), np.array(cols[2], np.int32), np.array(cols[3], np.int32), np.array(cols[4]), np.array(roots, np.int32), depth, base)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Learns from a bounded sample of labelled rows, whose statistics alone reach the driver."""
    named = bounded_sample(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality"), F.col("doc_id"), rows, 4)
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(named), "doc_id").select("text", "quality").limit(2 * rows)

    def run(batches):
        for batch in batches:
            for part, texts in parts(batch, "text"):
                x = statistics(texts).x
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column(1).cast(pa.int32())], names=["x", "y"])
        give_back()

    got = chosen.mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(got.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column(1).to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    return boost(x[order], y[order])


def judge(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows with the counts, base_failed, quality_score and kept (clashing names get underscores in front).

    A null or empty text has no words, so the base rules reject it. Whole texts count, however long; repeated rows get
    equal verdicts, and an empty table gives an empty one.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality_score", "kept"]
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    name = fresh(docs, *new)
    schema = T.StructType(docs.schema.fields + [T.StructField(name[c], k) for c, k in zip(new, kinds, strict=True)])
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = sent.value
        for batch in batches:
            for part, texts in parts(batch, text_col):
                s = statistics([t or "" for t in texts])
                failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MOST_REPEATED * s.n_words)
                score = model.score(s.x)
                arrays = [pa.array(a, pa.int64()) for a in s[:5]] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every whole text, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return judge(docs, trees).drop("text")
