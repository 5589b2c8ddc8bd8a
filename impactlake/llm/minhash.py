"""Near-duplicate documents by BagMinHash.

A text is the multiset of its shingles of five words. Weights are discretised to whole counts and laid
out in dyadic intervals (0,1], (1,2], (2,4], ...; each interval of each shingle has a Poisson process of
its own whose points carry a position in the interval and a slot of the signature. A slot's value is
the earliest point at a position that the weight covers, so two signatures agree in a slot with the
probability of the weighted Jaccard similarity. Processes advance together, point by point, and stop
once they pass the last slot's value.

Signatures are cut into bands. In each bucket of a band, members are paired with the bucket's least member
and, in some bands, with their neighbour in a random order; pairs that the multisets verify give
components. Buckets that still hold several components are then compared in full by signature: texts that may
be similar form families, whose members are compared exactly, tile by tile. So no link found by a band is
lost, and only spanning forests leave the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, give_back, mix64, table
from .components import components
from .textarrays import Words, codes_of, forget_powers, parts

WORDS, THRESHOLD = 5, 0.8
#: 25 bands of 5 slots miss a pair of similarity 0.8 once in 20,000.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Bands whose buckets also pair neighbours in a random order.
CHAINED = 4
#: Share of equal slots from which a pair may be similar: five standard deviations below the threshold.
MAYBE = 0.62
PACK = 1000
#: Texts of a tile of a large family.
TILE = 128


def shingle_counts(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, shingle and count of every distinct shingle; a text of fewer than n words has one of all its words, one without words none."""
    codes, offsets = codes_of(texts)
    w = Words(codes, offsets)
    h, first = w.shingles(n)
    doc = w.doc[first]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        at = np.searchsorted(w.doc, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = w.count[short] > k
            whole[has] = mix64(whole[has] * np.uint64(0xFF51AFD7ED558CCD) + w.hash[at[has] + k])
        h, doc = np.concatenate([h, mix64(whole + np.uint64(1))]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """docs x slots values; a text without shingles keeps infinity everywhere."""
    best = np.full(docs * slots, np.inf)
    top = np.floor(np.log2(np.maximum(count, 1))).astype(np.int64)
    levels = top + 1 + (count != (1 << top))  # whole intervals up to 2**top, and the next one in part
    node_doc, shingle_of = np.repeat(doc, levels), np.repeat(shingle, levels)
    level = np.arange(len(node_doc)) - np.repeat(np.cumsum(levels) - levels, levels)
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    covered = np.clip((np.repeat(count, levels) - np.where(level == 0, 0, rate)) / rate, 0, 1)
    seed = mix64(shingle_of ^ mix64(level.astype(np.uint64) + np.uint64(101)))
    time = np.zeros(len(node_doc))
    live = np.arange(len(node_doc))
    step = 0
    while len(live):
        step += 1
        bits = mix64(seed[live] + np.uint64((step * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        gap = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[live]
        time[live] += gap
        mark = mix64(bits + np.uint64(0xD6E8FEB86659FD93))
        slot = (mark % np.uint64(slots)).astype(np.int64)
        place = (mix64(mark) >> np.uint64(11)).astype(float) * 2.0**-53
        counts = place < covered[live]
        np.minimum.at(best, node_doc[live[counts]] * slots + slot[counts], time[live[counts]])
        if step <= 8 or step % 4 == 0:
            last = best.reshape(docs, slots).max(axis=1)
            live = live[time[live] < last[node_doc[live]]]
    return best.reshape(docs, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """docs x BANDS hashes of the bands' slots."""
    bits = mix64(np.ascontiguousarray(sig).view(np.uint64)).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(17), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        out = mix64(out * np.uint64(0xFF51AFD7ED558CCD) + bits[:, :, k])
    return out.view(np.int64)


def sketch(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, doc_id, bands array<long> and sig (4 bytes a slot) of each text; both are null for texts without words."""

    def run(batches):
        for batch in batches:
            for part, texts in parts(batch, text_col):
                whole = [t or "" for t in texts]
                doc, h, n = shingle_counts(whole)
                sig = signatures(doc, h, n, len(whole))
                empty = np.ones(len(whole), bool)
                empty[doc] = False
                keys = band_keys(sig)
                slots = (mix64(np.ascontiguousarray(sig).view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(sig.shape)
                bands = pa.array([None if e else k for e, k in zip(empty, keys, strict=True)], pa.list_(pa.int64()))
                raw = pa.array([None if e else s.tobytes() for e, s in zip(empty, slots, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), part.column(part.schema.get_field_index("doc_id")), bands, raw], names=[key, "doc_id", "bands", "sig"])
        forget_powers()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(key, "doc_id", text_col).mapInArrow(run, f"{key} binary, doc_id {kind}, bands array<long>, sig binary")


def similarity(texts: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of texts 0 and 1, 2 and 3, and so on."""
    doc, h, n = shingle_counts(texts)
    pair = doc // 2
    order = np.lexsort((h, pair))
    pair, h, n = pair[order], h[order], n[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    pairs = len(texts) // 2
    common = np.bincount(pair[both], np.minimum(n[both], n[both + 1]), pairs)
    total = np.bincount(pair, n, pairs)
    return common / np.maximum(total - common, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' multisets overlap enough."""

    def run(batches):
        for batch in batches:
            for part, a in parts(batch, "ta", 700_000):
                b = part.column(part.schema.get_field_index("tb")).to_pylist()
                s = similarity([t for ab in zip(a, b, strict=True) for t in ab])
                keep = pa.array(s >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])
        forget_powers()
        give_back()

    with_a = pairs.join(texts.select(F.col("th").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("th").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _forest(n: int, near) -> np.ndarray:
    """Smallest row that each of n rows reaches; near(i) gives the rows after i that are near it."""
    label = np.arange(n)
    for i in range(n):
        others = near(i)
        if len(others):
            met = np.unique(label[np.append(others, i)])
            label[np.isin(label, met[1:])] = met[0]
    return label


def maybe_edges(members: DataFrame, least: float = MAYBE) -> DataFrame:
    """Edges (a, b), a spanning forest for each bucket or two of its tiles, of texts whose signatures agree in at least that share of slots; members: bk, th, sig.

    All members of a bucket are compared, but only forests leave the tasks. Buckets of up to PACK members share tasks; larger ones are cut
    into tiles, and each two tiles meet in one group.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t["bk"].to_numpy(), kind="stable"))
        bk = t["bk"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(bk), -1)
        th, first = t["th"].to_pylist(), t["tile"].to_numpy() == t["x"][0].as_py()
        across = t["x"][0].as_py() != t["y"][0].as_py()
        border = np.flatnonzero(np.diff(bk, prepend=bk[0] + 1, append=bk[-1] + 1))
        out: set[tuple] = set()
        for a, b in zip(border, border[1:], strict=False):
            own, left = sig[a:b], first[a:b]

            def near(i: int, own=own, left=left) -> np.ndarray:
                close = (own[i + 1 :] == own[i]).mean(axis=1) >= least
                return i + 1 + np.flatnonzero(close & (left[i + 1 :] != left[i]) if across else close)

            label = _forest(b - a, near)
            out.update((th[a + label[i]], th[a + i]) for i in np.flatnonzero(label != np.arange(b - a)).tolist())
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    sizes = members.groupBy("bk").agg(F.count("*").alias("m"))
    packs = F.pmod(F.hash("bk"), F.lit(max(1, -(-members.count() // PACK)))).cast("long")
    placed = members.join(sizes, "bk").withColumn("tiles", F.ceil(F.col("m") / PACK).cast("int"))
    placed = placed.withColumn("pack", F.when(F.col("tiles") > 1, F.col("bk")).otherwise(packs)).withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.hash("th"), F.col("tiles"))).otherwise(0))
    rows = placed.select("pack", F.col("tiles").alias("alone"), "bk", "th", "sig", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("pack", "alone", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "bk", "th", "sig", "tile")
    return rows.groupBy("pack", "alone", "x", "y").applyInArrow(run, "a binary, b binary").distinct()


def overlaps(texts: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of each two of the texts."""
    doc, h, n = shingle_counts(texts)
    each = np.repeat(np.arange(len(h)), n)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    element, doc_of = mix64(h[each] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), doc[each]
    _, column, df = np.unique(element, return_inverse=True, return_counts=True)
    shared = df[column] > 1
    column = np.unique(column[shared], return_inverse=True)[1]
    row = doc_of[shared]
    common = np.zeros((len(texts), len(texts)))
    step = 8192
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (k, k + step))
        m = np.zeros((len(texts), step), np.float32)
        m[row[a:b], column[a:b] - k] = 1
        common += m @ m.T
    total = np.bincount(doc, n, len(texts))
    return common / np.maximum(total[:, None] + total[None, :] - common, 1)


def exact_edges(members: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b), a spanning forest for each two tiles, of texts of one family (fam) and different components that verify.

    Families of up to TILE texts share tasks; larger ones are cut into tiles, and each two tiles meet in one group.
    """
    sizes = members.groupBy("fam").agg(F.count("*").alias("m"))
    small = sizes.where(F.col("m") <= TILE).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("s")).first()["s"]
    placed = members.join(sizes, "fam").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")).withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.hash("th"), F.col("tiles"))).otherwise(0))
    pack = F.when(F.col("tiles") > 1, F.col("fam")).otherwise(F.unhex(F.lpad(F.hex(F.pmod(F.hash("fam"), F.lit(max(1, -(-int(small) // TILE))))), 8, "0")))
    rows = placed.select(pack.alias("pack"), "fam", "th", "comp", "text", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = rows.select("pack", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "fam", "th", "comp", "text")

    def run(t: pa.Table) -> pa.Table:
        fam, th, comp, texts = (t[c].to_pylist() for c in ("fam", "th", "comp", "text"))
        fam, comp = np.unique(np.array(fam, object), return_inverse=True)[1], np.unique(np.array(comp, object), return_inverse=True)[1]
        a, b = [], []
        for f in np.unique(fam):
            own = np.flatnonzero(fam == f)
            near = overlaps([texts[i] for i in own]) >= threshold - 1e-12
            near &= comp[own][:, None] != comp[own][None, :]
            label = _forest(len(own), lambda i, near=near: i + 1 + np.flatnonzero(near[i, i + 1 :]))
            for i in np.flatnonzero(label != np.arange(len(own))):
                a.append(th[own[label[i]]])
                b.append(th[own[i]])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("pack", "x", "y").applyInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD, one_each: bool = False) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with `class_id`, the smallest doc_id of the document's class.

    With one_each, one row of each class stays, one that has the smallest id, and the rows have no new column.

    Equal texts are one class; texts whose shingle multisets have a similarity of at least the threshold are linked, and
    classes are the components of these links. Null texts and texts without words are classes of their own. Repeated
    rows stay, each with its class. Null ids never become a class while another id is there.
    """
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    name = fresh(docs, "class_id", "_th")
    hashed = docs.withColumn(name["_th"], F.when(words, F.unhex(F.md5(F.encode("text", "UTF-8")))))
    rows = hashed.where(F.col(name["_th"]).isNotNull()).select(F.col(name["_th"]).alias("th"), "doc_id", "text")
    nodes = cut(sketch(rows, "th", "text").groupBy("th").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    buckets = nodes.select("th", F.posexplode("bands").alias("band", "bk")).withColumn("r", F.xxhash64("th", "bk"))
    crowded = buckets.groupBy("bk").agg(F.count("*").alias("m"), F.min("th").alias("c")).where("m > 1")
    buckets = cut(buckets.join(crowded, "bk"))
    star = buckets.where("c <> th").select(F.col("c").alias("a"), F.col("th").alias("b"))
    salt = F.pmod(F.hash("r"), F.ceil(F.col("m") / PACK).cast("int"))  # no window holds more than some PACK members of a bucket
    before = F.lag("th").over(Window.partitionBy("bk", salt).orderBy("r", "th"))
    chain = buckets.where(F.col("band") < CHAINED).select("th", before.alias("p")).where("p IS NOT NULL AND p <> th").select(F.least("th", "p").alias("a"), F.greatest("th", "p").alias("b"))
    pairs = star.union(chain).distinct()
    paired = buckets.select("th").distinct().join(nodes.select("th", "first_id"), "th")
    texts = cut(rows.join(paired, "th").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("th").agg(F.first("text").alias("text")))
    edges = cut(verified(pairs, texts, threshold))
    roots = cut(components(edges))
    comp = F.coalesce("root", "th")
    labelled = buckets.select("bk", "th").join(roots.withColumnRenamed("node", "th"), "th", "left").select("bk", "th", comp.alias("comp"))
    split = labelled.groupBy("bk").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bk")
    open_members = labelled.join(split, "bk").join(nodes.select("th", "sig"), "th").select("bk", "th", "sig")
    families = cut(components(maybe_edges(cut(open_members))))
    placed = families.select(F.col("node").alias("th"), F.col("root").alias("fam")).join(roots.withColumnRenamed("node", "th"), "th", "left").select("th", "fam", comp.alias("comp"))
    mixed = placed.groupBy("fam").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("fam")
    more = cut(exact_edges(placed.join(mixed, "fam").join(texts, "th"), threshold))
    if not more.isEmpty():
        roots = cut(components(edges.union(more)))
    known = nodes.select("th", "first_id").join(roots.withColumnRenamed("node", "th"), "th", "left").select("th", "first_id", comp.alias("comp"))
    if one_each:  # one text of each class, by the class's smallest id; equal rows of that text meet in the join's own partitions
        best = known.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), "first_id", "th")).alias("b")).select(F.col("b.th").alias(name["_th"]), F.col("b.first_id").alias(name["class_id"]))
        chosen = hashed.join(best, name["_th"]).where(F.col("doc_id").eqNullSafe(F.col(name["class_id"]))).dropDuplicates([name["_th"]])
        alone = hashed.where(F.col(name["_th"]).isNull())  # texts without words are classes of their own
        return chosen.select(*[F.col(f"`{c}`") for c in docs.columns]).union(alone.select(*[F.col(f"`{c}`") for c in docs.columns]))
    best = known.groupBy("comp").agg(F.min("first_id").alias("class_id"))
    of = known.join(best, "comp").select(F.col("th").alias(name["_th"]), F.col("class_id").alias(name["class_id"]))
    out = hashed.join(of, name["_th"], "left").withColumn(name["class_id"], F.coalesce(name["class_id"], "doc_id"))
    return out.drop(name["_th"])


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The class of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def oracle() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
n AS (SELECT min(doc_id) AS id, text, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
g AS (SELECT id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})] END) AS s FROM n),
c AS (SELECT id, s, count(*) AS k FROM g GROUP BY id, s), t AS (SELECT id, sum(k) AS k FROM c GROUP BY id),
o AS (SELECT x.id AS a, y.id AS b, sum(least(x.k, y.k)) AS k FROM c x JOIN c y ON x.s = y.s AND x.id <> y.id GROUP BY x.id, y.id),
l AS (SELECT a, b FROM o JOIN t p ON p.id = a JOIN t q ON q.id = b WHERE 5 * o.k >= 4 * (p.k + q.k - o.k)),
r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS class_id FROM r GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, doc_id = coalesce(class_id, doc_id) AS kept
FROM d LEFT JOIN n ON d.text = n.text LEFT JOIN m ON m.a = n.id"""
