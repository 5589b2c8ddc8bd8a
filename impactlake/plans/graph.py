"""Graph plans over call edges: bounded neighbourhoods and unbounded reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, scratch


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(seed, name, depth) within `depth` hops of each seed in one direction, and the traversed edges (seed, caller, callee).

    edges: caller, callee; seeds: name. A node at the limit is kept but not expanded; edges to visited nodes are
    traversed too. Each hop joins only the frontier with the edges.
    """
    a, b = ("callee", "caller") if reverse else ("caller", "callee")
    hops = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
    frontier = seeds.select(F.col("name").alias("seed"), "name").distinct()
    seen = frontier.select("seed", "name", F.lit(0).alias("depth"))
    walked = None
    for d in range(1, depth + 1):
        step = cut(frontier.join(hops, frontier["name"] == hops["_from"]).select("seed", "_from", "_to"))
        walked = step if walked is None else walked.unionByName(step)
        frontier = cut(step.select("seed", F.col("_to").alias("name")).distinct().join(seen, ["seed", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("seed", "name", F.lit(d).alias("depth")))
    if walked is None:
        walked = frontier.select("seed", F.col("name").alias("_from"), F.col("name").alias("_to")).limit(0)
    return seen, walked.select("seed", F.col("_from").alias(a), F.col("_to").alias(b)).distinct()


#: Hops that are walked one by one before chains are contracted, and how much shortcuts may add to the edges.
FEW_HOPS, MOST_SHORTCUTS = 4, 6


def _walk(delta: DataFrame, hops: DataFrame, folder: str, rounds: int | None) -> tuple[DataFrame, bool]:
    """All that delta (function_name, and what goes along) reaches through hops, semi-naive: each round joins only what the last one found and is added to the folder.

    With rounds, the walk stops after so many; the flag tells whether it came to its end.
    """
    spark, keys = delta.sparkSession, delta.columns
    n = 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{folder}/round={n}")
        return spark.read.schema(df.schema).parquet(f"{folder}/round={n}")

    front = keep(delta)
    while not front.isEmpty():
        reached = spark.read.schema(delta.schema).parquet(folder).select(*keys)
        if rounds is not None and n > rounds:
            return reached, False
        found = front.join(hops, front["function_name"] == hops["caller"]).select(F.col("callee").alias("function_name"), *[k for k in keys if k != "function_name"]).distinct()
        front = keep(found.select(*keys).join(reached, keys, "left_anti"))
    return spark.read.schema(delta.schema).parquet(folder).select(*keys), True


def _chains(hops: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, head of each function that is reached just where its only caller is, and the edges between heads.

    A function with one caller hangs on it unless it is an entry; pointers to callers are doubled until they end at heads, in as many
    rounds as the longest chain has digits. A ring that nothing outside calls has no head: it is not reached and goes.
    """
    callers = hops.where("caller <> callee").groupBy("callee").agg(F.count("*").alias("n"), F.min("caller").alias("p"))
    hanging = cut(callers.where("n = 1").select(F.col("callee").alias("name"), "p").join(entries, "name", "left_anti"))
    most, ptr = hanging.count(), hanging
    step = 1
    while step <= most:
        up = ptr.select(F.col("name").alias("_n"), F.col("p").alias("_p"))
        ptr = cut(ptr.join(up, F.col("p") == F.col("_n"), "left").select("name", F.coalesce("_p", "p").alias("p"), F.col("_p").isNotNull().alias("moved")))
        if ptr.where("moved").isEmpty():
            break
        ptr, step = ptr.drop("moved"), step * 2
    ptr = ptr.select("name", F.col("p").alias("head"))
    lost = ptr.join(hanging.select(F.col("name").alias("head")), "head", "left_semi").select("name")  # rings without a head
    ptr = cut(ptr.join(lost, "name", "left_anti"))
    rest = hops.where("caller <> callee").join(hanging.select(F.col("name").alias("callee")), "callee", "left_anti").join(lost.withColumnRenamed("name", "caller"), "caller", "left_anti")
    heads = ptr.select(F.col("name").alias("_n"), "head")
    rest = rest.join(heads, F.col("caller") == F.col("_n"), "left").select(F.coalesce("head", "caller").alias("caller"), "callee").where("caller <> callee").distinct()
    return ptr, cut(rest)


def _shortcuts(hops: DataFrame) -> DataFrame:
    """The edges with those over two, four and more of them, as long as they stay few."""
    n = hops.count()
    while True:
        ahead = hops.select(F.col("caller").alias("callee"), F.col("callee").alias("_far"))
        more = cut(hops.unionByName(hops.join(ahead, "callee").select("caller", F.col("_far").alias("callee"))).where("caller <> callee").distinct())
        m = more.count()
        if m > MOST_SHORTCUTS * n or m == hops.count():
            return hops
        hops = more


def reachability(threads: DataFrame, edges: DataFrame) -> DataFrame:
    """function_name, thread_id, is_interrupt_like: all functions each thread's entry reaches, the entry itself included.

    Shallow graphs are walked hop by hop. Where that does not end, chains of functions with one caller are contracted again and again, which takes
    a chain or a ring of any length in logarithmic rounds, the rest is walked with shortcuts, and the chains are unfolded.
    """
    spark = threads.sparkSession
    hops = cut(edges.select("caller", "callee").distinct())
    starts = cut(threads.select(F.col("entry_function").alias("function_name"), "thread_id", "is_interrupt_like").distinct())
    reached, ended = _walk(starts, hops, scratch(spark, "reach"), FEW_HOPS)
    if ended:
        return reached
    entries = starts.select(F.col("function_name").alias("name")).distinct()
    folded = []
    while True:
        chains, rest = _chains(hops, entries)
        folded.append(chains)
        small = chains.count() * 8 <= hops.count()
        hops = rest
        if small:
            break
    reached, _ = _walk(starts, _shortcuts(hops), scratch(spark, "reach"), None)
    for chains in reversed(folded):
        more = reached.join(chains, reached["function_name"] == chains["head"]).select(F.col("name").alias("function_name"), "thread_id", "is_interrupt_like")
        reached = cut(reached.unionByName(more).distinct())
    return reached
