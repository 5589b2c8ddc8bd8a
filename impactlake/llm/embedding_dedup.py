"""Near-duplicate embeddings by sorted projection passes.

In each pass every vector gets a key of concatenated random hyperplane bits, taken around its label's mean so that they cut a
crowded label too. Vectors in the order of label and key are compared with a bounded window of neighbours, and the pairs that
verify give edges (a spanning forest of each window, never all its pairs); components unite the passes. A label of up to one window
is compared whole. After each few passes, a sample of vectors is compared with all rows of their labels: labels whose links the
passes did not unite get more of them, and those that stay too crowded are compared exactly, tile by tile. Links are counted
exactly inside each component, whose vectors meet tile by tile. Equal vectors are one node with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

#: Smallest cosine of a link, in double precision.
THRESHOLD = 0.93
#: Rows of a window; each row is compared with at least half as many neighbours on both sides. Bits of a key.
WINDOW, KEY_BITS = 4096, 62
#: Passes between two probes, passes after which crowded labels are compared exactly, vectors probed, and the share of a label's probed links that may be apart.
PASSES, MOST_PASSES, PROBES, MISSED = 8, 32, 2048, 0.01
#: Rows of a tile: as many as hold NUMBERS numbers, within these bounds; and rows compared at once.
LEAST_TILE, MOST_TILE, NUMBERS, BLOCK = 512, 8192, 1 << 19, 1024


def key16(*cols: Column) -> Column:
    """A 128-bit key of the columns."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *cols)), 16, "0") for seed in (71, 72)]))


def unit(column) -> np.ndarray:
    """Rows of unit length in double precision, safe from overflow."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(values)
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) if n else x
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if n else x


def _codes(column) -> np.ndarray:
    """A number for each distinct value, by comparing the values themselves."""
    return np.unique(np.array(column.to_pylist(), object), return_inverse=True)[1]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, from those before and the pairs (a, b) that come in."""
    while True:
        u, v = root[a], root[b]
        apart = u != v
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while not ((new := root[root]) == root).all():
            root = new


def means(reps: DataFrame) -> DataFrame:
    """set, mean of the unit vectors of each set of reps (set, embedding); sums are made where the rows are."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sets, dims = _codes(batch.column(0)), batch.column(1).to_numpy()
            for s in np.unique(sets):
                own = np.flatnonzero(sets == s)
                x = unit(batch.column(2).take(pa.array(own)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(own[0], 1), pa.array([x.sum(axis=0)], pa.list_(pa.float64())), pa.array([len(x)], pa.int64())], names=["set", "total", "n"])
                assert x.shape[1] == dims[own[0]]

    parts = reps.select("set", "dim", "embedding").mapInArrow(run, "set binary, total array<double>, n long")
    each = parts.select("set", "n", F.posexplode("total").alias("i", "v")).groupBy("set", "i").agg((F.sum("v") / F.sum("n")).alias("v"))
    return each.groupBy("set").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))


def pass_edges(reps: DataFrame, centres: DataFrame, passes: range, threshold: float = THRESHOLD, seed: int = 7, window: int = WINDOW) -> DataFrame:
    """Edges (a, b) between keys of vectors that one of the passes brings together and the cosine verifies; reps: rid, set, dim, embedding.

    Only keys and ids are sorted. A row's place in the whole order, not in its partition, settles its windows, so they do not depend on the
    session's partitions.
    """
    half = window // 2

    def project(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(part.column(3)) - part.column(4).flatten().to_numpy().reshape(-1, dim)
                for p in passes:
                    planes = np.random.default_rng([seed, p, int(dim)]).standard_normal((dim, KEY_BITS))
                    key = (x @ planes > 0).astype(np.int64) @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(key), part.column(0), part.column(1), part.column(2)], names=["pass", "key", "rid", "set", "dim"])

    keyed = reps.join(centres, "set").select("rid", "set", "dim", "embedding", "mean").mapInArrow(project, "pass int, key long, rid binary, set binary, dim int")
    order = ["pass", "dim", "set", "key", "rid"]
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).drop("key", "dim"))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    before = np.concatenate([[0], np.cumsum([m for _, m in sizes])])
    starts = reps.sparkSession.createDataFrame([(p, int(m)) for (p, _), m in zip(sizes, before, strict=False)], "_p long, _before long")
    rank = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    own = placed.join(F.broadcast(starts), F.shiftright("_m", 33) == F.col("_p")).select("pass", "set", "rid", rank.alias("rank"))
    block = F.floor(F.col("rank") / half)
    both = own.select("pass", "set", "rid", "rank", F.explode(F.array(block, block - 1)).alias("window"))
    rows = both.join(reps.select("rid", "embedding"), "rid").select("window", "rank", "pass", "set", "rid", "embedding")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        first = t["rank"].to_numpy() // half == t["window"][0].as_py()  # these meet all of the window; the others' own pairs are the next one's
        group = _codes(t["set"]) * (1 + int(t["pass"].to_numpy().max())) + t["pass"].to_numpy()
        border = np.flatnonzero(np.diff(group, prepend=group[0] + 1, append=group[-1] + 1))
        root = np.arange(len(group))
        for lo, hi in zip(border, border[1:], strict=False):
            own = int(first[lo:hi].sum())
            if hi - lo < 2 or not own:
                continue
            v = unit(t["embedding"].slice(lo, hi - lo))
            for i in range(0, own, BLOCK):
                for j in range(i, hi - lo, BLOCK):
                    r, c = np.nonzero(v[i : min(i + BLOCK, own)] @ v[j : j + BLOCK].T >= threshold)
                    root = _unite(root, lo + i + r, lo + j + c)
        some = np.flatnonzero(root != np.arange(len(root)))
        rid = t["rid"].combine_chunks()
        return pa.table({"a": rid.take(pa.array(some)).cast(pa.binary()), "b": rid.take(pa.array(root[some])).cast(pa.binary())})

    return rows.groupBy("window").applyInArrow(compare, "a binary, b binary").distinct()


def crowded(reps: DataFrame, roots: DataFrame, probes: int, threshold: float = THRESHOLD) -> list[bytes]:
    """The sets of which more than MISSED of the probed links join different components: a sample of vectors against all rows of their sets."""
    placed = cut(reps.select("rid", "set", "dim", "embedding").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root"))
    asked = placed.orderBy(F.xxhash64(F.lit(3), "rid"), "rid").limit(probes).toArrow()  # a bounded number of rows
    sent = reps.sparkSession.sparkContext.broadcast({})
    by_set: dict[bytes, tuple] = {}
    if asked.num_rows:
        keys = np.array(asked["set"].to_pylist(), object)
        for s in set(keys.tolist()):
            own = asked.take(np.flatnonzero(keys == s))
            by_set[s] = unit(own["embedding"]), own["rid"].to_pylist(), np.array(own["comp"].to_pylist(), object)
        sent = reps.sparkSession.sparkContext.broadcast(by_set)

    def run(batches):
        for batch in batches:
            sets = np.array(batch.column(batch.schema.get_field_index("set")).to_pylist(), object)
            for s in {*sets.tolist()} & sent.value.keys():
                x, rid, comp = sent.value[s]
                own = batch.take(pa.array(np.flatnonzero(sets == s)))
                near = unit(own.column(own.schema.get_field_index("embedding"))) @ x.T >= threshold
                near &= np.array(own.column(own.schema.get_field_index("rid")).to_pylist(), object)[:, None] != np.array(rid, object)[None, :]
                apart = near & (np.array(own.column(own.schema.get_field_index("comp")).to_pylist(), object)[:, None] != comp[None, :])
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.binary()), pa.array([int(near.sum())]), pa.array([int(apart.sum())])], names=["set", "links", "apart"])

    told = placed.mapInArrow(run, "set binary, links long, apart long").groupBy("set").agg(F.sum("links").alias("links"), F.sum("apart").alias("apart"))
    return [bytes(r["set"]) for r in told.where(F.col("apart") > F.lit(MISSED) * F.col("links")).collect()]  # at most a row a probe


def links_within(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rid, links, root of reps (rid, set, dim, embedding, n): from each group how many vectors of other rows of its set a row links to, and a row that it reaches.

    Every pair of a set is compared: small sets share a task; a large one is cut into tiles, and each pair of tiles is one group.

    A row without links gives none, and one in several groups gives one in each: links are to be summed. root is null for the row that
    others of its group have as theirs.
    """
    most = F.greatest(F.lit(LEAST_TILE), F.least(F.lit(MOST_TILE), F.floor(F.lit(NUMBERS) / F.col("dim")))).cast("int")
    own = reps.select("set", "dim", "rid", "embedding", "n")
    sizes = cut(own.groupBy("set", "dim").agg(F.count("*").alias("m")).withColumn("tiles", F.ceil(F.col("m") / most).cast("int")))
    packs = F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("tiles") == 1, F.col("m"))) / most)).cast("int")
    packs = sizes.groupBy("dim").agg(packs.alias("packs"))
    large = sizes.where("tiles > 1").select("set", "tiles")  # at most a row for each LEAST_TILE vectors
    placed = own.join(F.broadcast(large), "set", "left").join(F.broadcast(packs), "dim").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.hash("rid"), F.col("tiles"))).otherwise(0))
    pack = F.when(F.col("tiles") > 1, F.col("set")).otherwise(F.unhex(F.lpad(F.hex(F.pmod(F.hash("set"), F.col("packs"))), 8, "0")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    rows = placed.select(pack.alias("pack"), "dim", "set", "rid", "embedding", "n", "tile", other)
    rows = rows.select("pack", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "dim", "set", "rid", "embedding", "n", "tile")

    def compare(t: pa.Table) -> pa.Table:
        v = unit(t["embedding"])
        n = t["n"].to_numpy().astype(float)
        tile = t["tile"].to_numpy()
        at = _codes(t["set"])
        order = np.argsort(at, kind="stable")
        low, high = t["x"][0].as_py(), t["y"][0].as_py()
        links, root = np.zeros(len(v)), np.arange(len(v))
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            left, right = (rows[tile[rows] == low], rows[tile[rows] == high]) if low != high else (rows, rows)
            for i in range(0, len(left), BLOCK):
                for j in range(0 if low != high else i, len(right), BLOCK):
                    a, b = left[i : i + BLOCK], right[j : j + BLOCK]
                    near = v[a] @ v[b].T >= threshold
                    same = low == high and i == j
                    if same:
                        np.fill_diagonal(near, False)
                    r, c = np.nonzero(near)
                    if not len(r):
                        continue
                    links[a] += np.bincount(r, n[b[c]], len(a))
                    if not same:
                        links[b] += np.bincount(c, n[a[r]], len(b))
                    root = _unite(root, a[r], b[c])
        some = np.flatnonzero(links)
        rid = np.array(t["rid"].to_pylist(), object)
        up = np.where(root[some] == some, None, rid[root[some]])
        return pa.table({"rid": pa.array(rid[some].tolist(), pa.binary()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(up.tolist(), pa.binary())})

    return rows.groupBy("dim", "pack", "x", "y").applyInArrow(compare, "rid binary, links long, root binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    A null, empty or zero vector, one with a null or non-finite component, and one without a label link with nothing: no
    links, and its own vec_id as component. Vectors of different lengths never link. Repeated rows are vectors of their
    own, equal to each other. Extra columns are ignored. A null vec_id is kept as it is. Labels of up to `window` vectors are compared whole;
    in larger ones at most MISSED of the links that probes find are not united.
    """
    e, window = F.col("embedding"), window or WINDOW
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    keyed = vectors.select("vec_id", F.when(valid, key16(F.col("label"), e)).alias("rid"), F.when(valid, key16(F.col("label"), F.size(e))).alias("set"), "embedding")
    reps = cut(keyed.where("rid IS NOT NULL").groupBy("rid").agg(F.first("set").alias("set"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first_id"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")))
    large = cut(reps.groupBy("set").agg(F.count("*").alias("m")).where(F.col("m") > window).select("set"))
    found = links_within(reps.join(large, "set", "left_anti"), threshold)
    edges = None
    if not large.isEmpty():
        rest = cut(reps.join(large, "set", "left_semi").select("rid", "set", "dim", "embedding", "n"))
        centres, asked, crowd = cut(means(rest)), rest, []
        for first in range(0, MOST_PASSES, PASSES):
            more = pass_edges(asked, centres, range(first, first + PASSES), threshold, window=window)
            edges = cut(more if edges is None else edges.union(more).distinct())
            roots = cut(components(edges))
            crowd = crowded(asked, roots, PROBES, threshold)
            if not crowd:
                break
            asked = rest.where(F.col("set").isin(crowd))
        members = rest.join(roots.select(F.col("node").alias("rid"), F.col("root").alias("comp")), "rid")
        if crowd:
            found = found.union(links_within(asked, threshold))
            members = members.where(~F.col("set").isin(crowd))
        found = found.union(links_within(members.select("rid", F.col("comp").alias("set"), "dim", "embedding", "n"), threshold))
    found = cut(found)
    linked = found.where("root IS NOT NULL").select(F.col("rid").alias("a"), F.col("root").alias("b"))
    roots = cut(components(linked))
    least = roots.select(F.col("node").alias("rid"), F.col("root").alias("comp")).join(reps.select("rid", "first_id"), "rid").groupBy("comp").agg(F.min("first_id").alias("least_id"))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    told = roots.select(F.col("node").alias("rid"), F.col("root").alias("comp")).join(least, "comp").join(links, "rid")
    per_rep = reps.select("rid", "first_id", "n").join(told.select("rid", "least_id", "links"), "rid", "left").select("rid", F.coalesce("least_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = keyed.select("vec_id", "rid").join(per_rep, "rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links, components and what is kept of every row of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e, label,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r"""
