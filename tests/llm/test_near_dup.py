"""Near-duplicate operators and components against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from impactlake.llm import embedding_dedup, minhash
from impactlake.llm.components import components


def groups(n, linked):
    """Smallest member of each item's component."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 560)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(600, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a: str, b: str) -> float:
    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def test_signature_estimates_weighted_jaccard(prose):
    words = prose(1, 60)
    a = " ".join(words * 3 + prose(2, 40))
    b = " ".join(words * 2 + prose(3, 60))
    doc, h, n = minhash.shingle_counts([a, b])
    assert n.max() >= 3
    sig = minhash.signatures(doc, h, n, 2, 8000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(jaccard(a, b), abs=0.03)
    assert minhash.similarity([a, b])[0] == pytest.approx(jaccard(a, b))
    assert minhash.overlaps([a, b])[0, 1] == pytest.approx(jaccard(a, b))


def near_copies(prose, seed, most=5):
    rng = random.Random(seed)
    base = prose(seed, 150)
    for _ in range(40):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = "new" + str(rng.randrange(10**6))
        yield " ".join(own)


def test_classes_equal_brute_force(spark, prose):
    texts = [t for s in (11, 12) for t in near_copies(prose, s)] + [" ".join(prose(s, 90)) for s in range(20, 50)]
    texts += [texts[0], texts[0], "", None, "  \n", "one two", "one  two", "one two three", "w " * 400, "w " * 380, "w " * 100]
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = {r["doc_id"]: r["_class_id"] for r in minhash.classes(df).collect()}
    by = dict(rows)
    filled = [i for i in sorted(by) if by[i] and by[i].split()]
    linked = [(a, b) for x, a in enumerate(filled) for b in filled[:x] if by[a] == by[b] or jaccard(by[a], by[b]) >= 0.8]
    assert got == dict(enumerate(groups(len(ids), linked)))
    one = minhash.classes(df, one_each=True)
    assert one.columns == df.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for c in got.values()})


def test_classes_of_repeated_and_null_ids(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other words")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in minhash.classes(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 2)]
    assert minhash.classes(df, one_each=True).count() == 2
    assert minhash.classes(df.limit(0)).count() == 0


def test_links_of_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((base + rng.standard_normal(24) * 0.25, g % 3))
    dense = rng.standard_normal(24)
    rows += [(dense + rng.standard_normal(24) * 0.18, 1) for _ in range(700)]
    rows += [(rows[-1][0], 1), (rows[-1][0], 1), (rows[-1][0], 2)]
    data = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [math.nan] * 24, 1), (9005, data[0][1], None), (9006, [None] + data[0][1][1:], 0), (9007, [math.inf] + data[0][1][1:], 0), (9008, data[0][1][:20], 0)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([label for _, _, label in data])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = groups(len(data), zip(*(a.tolist() for a in np.nonzero(near))))
    assert {k: got[k] for k in range(len(data))} == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(data))}
    assert all(got[k] == (0, k, True) for k, _, _ in odd)
    assert near.sum() > 5000
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def dense_label(n, cosine, pairs, seed, dims=64):
    """Vectors of one label around one direction, of which some have a copy just inside the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - cosine) * x + np.sqrt(cosine) * np.eye(dims)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.standard_normal((pairs, dims))
    aside -= (aside * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    return np.concatenate([x, 0.931 * x[:pairs] + np.sqrt(1 - 0.931**2) * aside])


def brute_force(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    return near, groups(len(x), zip(*(a.tolist() for a in np.nonzero(near))))


@pytest.mark.parametrize("numbers", [embedding_dedup.NUMBERS, 1024], ids=["one_tile", "nine_tiles"])
def test_dense_label_equals_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(embedding_dedup, "NUMBERS", numbers)
    x = dense_label(4000, 0.8, 300, 1).astype(np.float32).astype(float)
    near, want = brute_force(x)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}
    assert near.sum() >= 600


def test_links_do_not_depend_on_the_session_partitions(spark):
    x = dense_label(1500, 0.0, 1000, 3).astype(np.float32).astype(float)
    near, want = brute_force(x)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


@pytest.mark.parametrize("kind, labels", [("int", [-1, -2]), ("string", ["", "a"]), ("boolean", [True, False]), ("double", [0.5, -0.5])])
def test_labels_of_any_kind_keep_apart(spark, kind, labels):
    rng = np.random.default_rng(8)
    v = [float(x) for x in rng.standard_normal(16)]
    near = [x + 0.01 for x in v]
    rows = [(1, v, labels[0]), (2, v, labels[1]), (3, near, labels[0]), (3, near, labels[0]), (4, near, None)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


@pytest.mark.parametrize("cosine", [0.0, 0.8])
def test_sorted_passes_find_links_of_a_large_label(spark, cosine):
    x = dense_label(2500, cosine, 400, 2).astype(np.float32).astype(float)
    near, _ = brute_force(x)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())] + [(9000 + i, x[i].tolist(), 2) for i in range(5)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, window=256).collect()}
    found = sum(got[i][0] for i in range(len(x)))
    assert 0.98 * near.sum() <= found <= near.sum()
    assert all(got[i][0] <= near[i].sum() for i in range(len(x))) and all(got[9000 + i] == (0, 9000 + i) for i in range(5))


def test_crowded_labels_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PASSES", 1)
    monkeypatch.setattr(embedding_dedup, "MOST_PASSES", 1)
    x = dense_label(1500, 0.85, 300, 5).astype(np.float32).astype(float)
    near, want = brute_force(x)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, window=32).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(x))}


def test_large_open_buckets_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 2**32, 50, dtype=np.uint32) for _ in range(3)]
    rows = []
    for i in range(120):
        sig = own[i % 3].copy()
        sig[rng.integers(0, 50, 5)] = 7
        rows.append((77, bytes([i]), sig.tobytes()))
    df = spark.createDataFrame(rows, "bk long, th binary, sig binary")
    linked = {}
    for pack in (1000, 16):
        monkeypatch.setattr(minhash, "PACK", pack)
        edges = [(r["a"][0], r["b"][0]) for r in minhash.maybe_edges(df).collect()]
        linked[pack] = groups(120, edges)
    assert linked[1000] == linked[16] == [i % 3 for i in range(120)]


def test_components_with_hubs(spark):
    edges = [(0, x) for x in range(1, 200)] + [(999, x) for x in range(400, 600)] + [(x, x + 1) for x in range(700, 720)] + [(150, 450)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(1000, edges)
    assert got == {x: want[x] for e in edges for x in e}


def test_classes_of_very_long_texts(spark, prose):
    base = prose(5, 60_000)
    other = list(base)
    other[100] = "changed"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(prose(6, 60_000)))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(df).collect()} == {1: 1, 2: 1, 3: 3}
