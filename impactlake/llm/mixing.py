"""Mixing sources to target weights.

Targets come from the sources' weights and sizes, with a cap on repeats. Which documents a source gives
beyond its whole rounds is settled by a threshold on a hash of the document, found by a radix search
over histograms (per source and size class), so no source is ever sorted or held in one task. The
mix is then split over output shards: each source's exact number of blocks goes down a binary tree of
shards, at each node by a multivariate hypergeometric draw. A source's blocks are disjoint ranges of
permuted (hashed) draws; each shard takes its next blocks and shuffles its rows locally.

Sources may be as many as documents: all that is kept of each is a row of a table. Only totals, a threshold of the targets
and the block numbers of at most BUNDLES bundles of sources come to the driver; inside a bundle, a task of
its own goes down the same tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

#: Weights of the sources in the order of their names, repeating; null comes last.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's size against that of all sources, and how often one document may be drawn.
SHARE, MOST_REPEATS = 1.5, 2
#: Documents with one leading hash up to which the radix search stops.
LEAF_DOCS = 64
BITS, HASH_BITS = 6, 63
#: Bundles of sources whose blocks the driver splits over shards; each source stands alone while there are no more.
BUNDLES = 256
#: Words of a shard, as long as that makes no more than MOST_SHARDS; larger shards are shuffled in several parts of about PART_WORDS.
SHARD_WORDS, MOST_SHARDS, BLOCKS_A_SHARD, PART_WORDS = 200_000, 4096, 32, 2_000_000


def size_of(text: Column) -> Column:
    """Words in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def level(sizes: DataFrame, share: float = SHARE, repeats: float = MOST_REPEATS) -> float | None:
    """The words that a source gets for each unit of weight, or None where all are at their cap; sizes: source_size, weight.

    Each round takes sources above `repeats` times their size out and reshares what is left among the others, until none is above;
    only three sums leave each round.
    """
    total = None
    at = 0.0
    while True:
        capped = F.lit(repeats) * F.col("source_size") < F.lit(at) * F.col("weight")
        r = sizes.agg(
            F.sum(F.col("source_size").cast("double")).alias("all"), F.sum(F.when(capped, F.lit(float(repeats)) * F.col("source_size")).otherwise(0.0)).alias("over"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(capped).alias("n"),
        ).first()
        total = share * (r["all"] or 0.0)
        if not r["free"]:
            return None
        new = (total - r["over"]) / r["free"]
        if new <= at:
            return at
        at = new


def split(counts: np.ndarray, room: np.ndarray, seed: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, blocks) of each shard: counts[i] blocks of source i over shards with the given room, all of which is used."""
    below = np.concatenate([[0], np.cumsum(room)])
    out = []

    def divide(low: int, high: int, who: np.ndarray, have: np.ndarray) -> None:
        if not len(who):
            return
        if high - low == 1:
            out.append((low, who, have))
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([*seed, low, high])
        left = rng.multivariate_hypergeometric(have, int(below[middle] - below[low]), method="marginals")
        divide(low, middle, who[left > 0], left[left > 0])
        rest = have - left
        divide(middle, high, who[rest > 0], rest[rest > 0])

    some = np.flatnonzero(counts)
    divide(0, len(room), some, counts[some].astype(np.int64))
    return out


def rooms(blocks: int, shards: int) -> np.ndarray:
    """Blocks of each shard; they differ by one at most."""
    return np.diff(np.linspace(0, blocks, shards + 1).round().astype(np.int64))


def split_blocks(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many of each source's blocks each shard takes; columns sum to counts, rows differ by one at most."""
    out = np.zeros((shards, len(counts)), np.int64)
    for shard, who, have in split(np.asarray(counts), rooms(int(np.sum(counts)), shards), (seed,)):
        out[shard, who] = have
    return out


@dataclass
class Plan:
    """What settles every draw: groups has a row a source and size class, with all that its documents need."""

    groups: DataFrame  # source, class, source_size, target, source_taken, rounds, below, besides, blocks, shards
    shards: int
    parts: int = 1


def _keys(docs: DataFrame, text_col: str, source_col: str, key_cols: list[str], seed: int) -> dict[str, Column]:
    size = size_of(F.col(text_col))
    return {
        "source": F.col(source_col),
        "size": size,
        "class": F.when(size > 0, F.floor(F.log2(size)).cast("int")).otherwise(F.lit(-1)),
        "hash": F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols], F.col(text_col)).bitwiseAND(F.lit((1 << HASH_BITS) - 1)),
    }


def _ranked(sources: DataFrame) -> DataFrame:
    """The sources with `rank`, their number in code-point order, null last: sorted by ranges, and counted on from range to range."""
    placed = cut(sources.orderBy(F.col("source").isNull(), "source").withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(F.shiftright("_m", 33).alias("p")).agg(F.count("*").alias("n")).collect())  # a row a range
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])])
    starts = placed.sparkSession.createDataFrame([(p, int(n)) for (p, _), n in zip(sizes, before, strict=False)], "_p long, _before long")
    mask = F.lit((1 << 33) - 1)
    return placed.join(F.broadcast(starts), F.shiftright("_m", 33) == F.col("_p")).withColumn("rank", F.col("_before") + F.col("_m").bitwiseAND(mask)).drop("_m", "_p", "_before")


def _on(left: DataFrame, right: DataFrame, how: str = "inner", classes: bool = True) -> DataFrame:
    """left joined with right by source (null is a source) and class; Spark broadcasts right if its table's size allows, else both meet by key."""
    r = right.withColumnRenamed("source", "_s")
    on = left["source"].eqNullSafe(r["_s"])
    if classes:
        r = r.withColumnRenamed("class", "_c")
        on = on & (left["class"] == r["_c"])
    return left.join(r, on, how).drop("_s", "_c")


def _thresholds(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """source, class, below, besides, got for each group (source, class, quota, docs): hashes under `below` and those in `besides` are drawn, `got` words in all.

    The radix search: of each group the words of all smaller hashes, the leading bits at the border, and the documents there. Each round keeps
    only the rows at the borders, some 1 in 64.
    """
    state = cut(groups.select("source", "class", "quota", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"), "docs"))
    inside = _on(keys, state.select("source", "class")).select("source", "class", "size", "hash")
    shift = HASH_BITS
    while shift - BITS >= 0 and (state.agg(F.max("docs").alias("n")).first()["n"] or 0) > LEAF_DOCS:
        shift -= BITS
        counted = inside.groupBy("source", "class", F.shiftright("hash", shift).alias("p")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        told = _on(counted, state.select("source", "class", "quota", "before"))
        w = Window.partitionBy("source", "class").orderBy("p")  # at most 1 << BITS rows a group
        told = told.withColumn("low", F.col("before") + F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        over = F.col("low") + F.col("words") > F.col("quota")
        pick = F.coalesce(F.min(F.when(over, F.struct("p", "low", "n"))), F.max(F.struct(F.col("p"), (F.col("low")).alias("low"), F.col("n"))))
        state = cut(told.groupBy("source", "class", "quota").agg(pick.alias("x")).select("source", "class", "quota", F.col("x.low").alias("before"), F.col("x.p").alias("prefix"), F.col("x.n").alias("docs")))
        at = _on(inside, state.select("source", "class", "prefix"))
        inside = cut(at.where(F.shiftright("hash", shift) == F.col("prefix")).select("source", "class", "size", "hash"))
    leaf = inside.groupBy("source", "class", "hash").agg(F.sum("size").alias("words"))
    leaf = _on(leaf, state.select("source", "class", "quota", "before", "prefix"))
    w = Window.partitionBy("source", "class").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the documents of one border
    leaf = cut(leaf.withColumn("high", F.col("before") + F.sum("words").over(w)).withColumn("over", F.col("high") > F.col("quota")))
    end = F.shiftleft(F.col("prefix") + 1, shift) if shift < HASH_BITS else F.lit((1 << 63) - 1)
    fit = leaf.groupBy("source", "class", "quota").agg(F.coalesce(F.min(F.when(F.col("over"), F.col("hash"))), F.first(end)).alias("below"), F.coalesce(F.max(F.when(~F.col("over"), F.col("high"))), F.first("before")).alias("got"))
    fit = cut(fit)
    # What a source's classes left short is filled with the largest documents that fit: a few rows a class.
    stop = _on(leaf, fit.select("source", "class", "below")).where((F.col("hash") >= F.col("below")) & (F.col("words") > 0))
    spare = stop.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("words")).alias("minus"), "hash", "class"))).alias("spare"))
    short = fit.groupBy("source").agg((F.sum("quota") - F.sum("got")).alias("short"))
    taken = F.aggregate(
        "spare", F.struct(F.col("short").cast("double").alias("short"), F.expr("cast(array() as array<struct<class:int,hash:bigint,words:bigint>>)").alias("took")),
        lambda acc, x: F.when(-x["minus"] <= acc["short"], F.struct((acc["short"] + x["minus"]).alias("short"), F.concat(acc["took"], F.array(F.struct(x["class"].alias("class"), x["hash"].alias("hash"), (-x["minus"]).alias("words")))).alias("took"))).otherwise(acc),
    )
    filled = _on(short, spare, classes=False).select("source", F.explode(taken["took"]).alias("t"))
    extra = filled.groupBy("source", F.col("t.class").alias("class")).agg(F.sort_array(F.collect_list("t.hash")).alias("besides"), F.sum("t.words").alias("more"))
    out = _on(fit, extra, "left")
    none = F.array().cast("array<long>")
    return out.select("source", "class", "below", F.coalesce("besides", none).alias("besides"), (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"))


def _shards(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, shards: the shard of each of the source's blocks; sources: source, rank, blocks."""
    placed = sources.withColumn("bundle", (F.col("rank") % BUNDLES).cast("int"))
    per = {r["bundle"]: r["b"] for r in placed.groupBy("bundle").agg(F.sum("blocks").alias("b")).collect()}
    counts = np.array([per.get(i, 0) for i in range(BUNDLES)], np.int64)
    room = split_blocks(counts, shards, seed)  # shards x bundles

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        have, bundle = t["blocks"].to_numpy(), t["bundle"][0].as_py()
        own: list[list[np.ndarray]] = [[] for _ in range(len(have))]
        for shard, who, n in split(have, room[:, bundle], (seed, 1, bundle)):
            for i, k in zip(who.tolist(), n.tolist(), strict=True):
                own[i].append(np.full(k, shard, np.int32))
        lists = [np.concatenate(o) if o else np.zeros(1, np.int32) for o in own]
        return pa.table({"source": t["source"], "shards": pa.array(lists, pa.list_(pa.int32()))})

    kind = sources.schema["source"].dataType.simpleString()
    return placed.select("source", "rank", "blocks", "bundle").groupBy("bundle").applyInArrow(run, f"source {kind}, shards array<int>")


def make_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", key_cols: list[str] = ["doc_id"], weights=WEIGHTS, share: float = SHARE, repeats: int = MOST_REPEATS, seed: int = 5) -> Plan:
    """The plan of a mix; its tables stand in the shared folder. Any number of sources and size classes is planned alike."""
    keys = cut(docs.select(*[c.alias(n) for n, c in _keys(docs, text_col, source_col, key_cols, seed).items()]))
    totals = cut(keys.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    ranked = _ranked(totals.groupBy("source").agg(F.sum("words").alias("source_size")))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    sizes = cut(ranked.withColumn("weight", weight))
    each = level(sizes, share, repeats)
    most = F.col("source_size") * F.lit(float(repeats))
    size = F.col("source_size")
    sizes = sizes.withColumn("target", most if each is None else F.least(most, F.lit(float(each)) * F.col("weight")))
    sizes = sizes.withColumn("rounds", F.when(size > 0, F.least(F.lit(repeats), F.floor(F.col("target") / size).cast("int"))).otherwise(0))
    sizes = cut(sizes.withColumn("part", F.when((size > 0) & (F.col("rounds") < repeats), F.greatest(F.lit(0.0), F.col("target") / size - F.col("rounds"))).otherwise(0.0)))
    open_ = _on(totals, sizes.select("source", "part"), classes=False).where("part > 0 AND words > 0").select("source", "class", (F.col("part") * F.col("words")).alias("quota"), "docs")
    found = cut(_thresholds(keys, open_))
    partial = found.groupBy("source").agg(F.sum("got").alias("got"))
    taken = cut(_on(sizes, partial, "left", classes=False).withColumn("source_taken", (F.col("rounds") * size + F.coalesce("got", F.lit(0))).cast("long")).drop("got", "weight", "part"))
    words = taken.agg(F.coalesce(F.sum("source_taken"), F.lit(0)).alias("w")).first()["w"]
    shards = int(np.clip(-(-words // SHARD_WORDS), 1, MOST_SHARDS))
    blocks = F.greatest(F.round(F.col("source_taken") / F.lit(float(max(words, 1))) * (shards * BLOCKS_A_SHARD)).cast("long"), (F.col("source_taken") > 0).cast("long"))
    numbered = taken.withColumn("blocks", blocks)
    told = _on(numbered, _shards(numbered.select("source", "rank", "blocks"), shards, seed), classes=False).withColumn("blocks", F.greatest(F.col("blocks"), F.lit(1)).cast("int"))
    told = _on(totals.select("source", "class"), told, classes=False)
    groups = _on(told, found.drop("got"), "left").select(
        "source", "class", "source_size", "target", "source_taken", "rounds", F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("besides", F.array().cast("array<long>")).alias("besides"), "blocks", "shards"
    )
    return Plan(cut(groups), shards, max(1, int(-(-words // (shards * PART_WORDS)))))


def assign(docs: DataFrame, plan: Plan | None = None, text_col: str = "text", source_col: str = "source", key_cols: list[str] = ["doc_id"], seed: int = 5, **options) -> DataFrame:
    """The rows with size, source_size, target and draws array<struct<copy, block, shard, rank>> (clashing names get underscores).

    Null texts and texts without words have size 0 and are drawn like others in whole rounds only. Null sources form the last source. Rows
    with equal keys and text share a hash, so a partial round draws all of them or none. Reruns agree.
    """
    plan = plan or make_plan(docs, text_col, source_col, key_cols, seed=seed, **options)
    name = fresh(docs, "size", "source_size", "target", "draws", "_class", "_hash", "_source", "_c", "_rounds", "_below", "_besides", "_blocks", "_shards")
    col = _keys(docs, text_col, source_col, key_cols, seed)
    base = docs.withColumns({name["size"]: col["size"], name["_hash"]: col["hash"]})
    base = base.withColumn(name["_class"], F.when(F.col(name["size"]) > 0, F.floor(F.log2(name["size"])).cast("int")).otherwise(F.lit(-1)))
    own = {"source": "_source", "class": "_c", "source_size": "source_size", "target": "target", "rounds": "_rounds", "below": "_below", "besides": "_besides", "blocks": "_blocks", "shards": "_shards"}
    groups = plan.groups.select(*[F.col(c).alias(name[n]) for c, n in own.items()])
    out = base.join(groups, F.col(source_col).eqNullSafe(F.col(name["_source"])) & (F.col(name["_class"]) == F.col(name["_c"])), "left")
    h = F.col(name["_hash"])
    copies = F.coalesce(F.col(name["_rounds"]), F.lit(0)) + ((h < F.col(name["_below"])) | F.array_contains(name["_besides"], h)).cast("int")

    def draw(c: Column) -> Column:
        block = F.pmod(F.xxhash64(F.lit(seed + 1), h, c), F.col(name["_blocks"])).cast("int")
        return F.struct(c.alias("copy"), block.alias("block"), F.get(name["_shards"], block).alias("shard"), F.xxhash64(F.lit(seed + 2), h, c).alias("rank"))

    drawn = F.transform(F.sequence(F.lit(1), F.greatest(copies, F.lit(1))), draw)
    out = out.withColumn(name["draws"], F.slice(drawn, F.lit(1), copies))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name["size"], name["source_size"], name["target"], name["draws"])


def mix(docs: DataFrame, plan: Plan | None = None, **options) -> DataFrame:
    """The drawn rows, one for each draw, dealt to shards and shuffled inside each; columns as in docs.

    A large shard is dealt to several tasks by the draws' random ranks, so each part is a random sample of its shard.
    """
    plan = plan or make_plan(docs, **options)
    name = fresh(docs, "draws", "_d")
    drawn = assign(docs, plan, **{k: v for k, v in options.items() if k in ("text_col", "source_col", "key_cols", "seed")})
    rows = drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(name["draws"]).alias(name["_d"]))
    d = F.col(name["_d"])
    dealt = rows.repartition(d["shard"], F.pmod(d["rank"], F.lit(plan.parts))) if plan.parts > 1 else rows.repartition(d["shard"])
    return dealt.sortWithinPartitions(d["shard"], d["rank"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the shards they go to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = assign(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))
