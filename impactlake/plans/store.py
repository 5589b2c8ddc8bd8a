"""Stored indexes: what an update has to do, run records, guards and fault isolation."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import impact
from .graph import reachability
from .index import CodeIndex


T = TypeVar("T")


@dataclass(frozen=True)
class Decision:
    """reason is None where all stored facts can be used again."""

    reason: str | None
    changed: int = 0


def same_sources(a: DataFrame, b: DataFrame) -> bool:
    """Whether two lists of paths hold the same ones."""
    x, y = a.select("path").distinct(), b.select("path").distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def decide(previous: DataFrame | None, current: DataFrame, previous_dialect: str, dialect: str) -> Decision:
    """The update ladder: no index, other sources, another dialect, changed signatures, or nothing to do."""
    if previous is None:
        return Decision("previous-index-missing")
    if not same_sources(previous, current):
        return Decision("project-source-list-changed")
    if previous_dialect != dialect:
        return Decision("parser-engine-changed")
    n = impact.changed(current, previous).count()
    return Decision("native-update-rebuild", n) if n else Decision(None)


def run_record(spark: SparkSession, path: str) -> dict:
    """The last complete run: dialect, mode, reason, changed, ms and the version whose tables hold."""
    return json.loads(spark.read.text(f"{path}/run").first()["value"])


def load(spark: SparkSession, path: str) -> CodeIndex:
    return CodeIndex.load(spark, f"{path}/{run_record(spark, path)['version']}")


def update(spark: SparkSession, path: str, files: DataFrame, threads: DataFrame, macros: dict[str, str] | None = None, dialect: str = "primary", include_paths: tuple[str, ...] = (), fresh: bool = False, max_skipped: int | None = None, signatures_now: Callable[[], DataFrame] | None = None) -> tuple[CodeIndex, Decision]:
    """Brings the index under path up to date. files: path, text, size, mtime_ms.

    Unchanged sources keep all stored facts; only reachability is worked out anew, as the thread map may have changed. A rebuild
    writes a new version beside the old one, which readers may still hold, and the record that names it comes last: a build that broke
    off changes nothing; so does one that skipped more than max_skipped files, or whose sources, as signatures_now() lists them afterwards, changed
    meanwhile. With fresh, all is built anew.
    """
    started = time.time()
    current = files.select("path", "size", "mtime_ms")
    try:
        run = run_record(spark, path)
        previous = spark.read.parquet(f"{path}/{run['version']}/file_sig")
    except Exception:  # noqa: BLE001  no complete index is there
        run, previous = {"dialect": dialect, "version": None}, None
    decision = Decision("full-build") if fresh else decide(previous, current, run["dialect"], dialect)
    version = run["version"]
    if decision.reason is None:
        index = CodeIndex.load(spark, f"{path}/{version}")
        index.tables["thread"] = threads
        index.tables["thread_reach"] = reachability(threads, index.call_edge)
    else:
        version = f"v-{uuid.uuid4().hex}"
        index = CodeIndex.build(files.select("path", "text", *(["ordinal"] if "ordinal" in files.columns else [])), threads, macros, f"{path}/{version}", dialect=dialect, include_paths=include_paths)
        if max_skipped is not None:
            check_skipped(index.skipped_file, max_skipped)
        if signatures_now is not None and not unchanged(current, signatures_now()):
            raise RuntimeError("source files changed while they were read")
        current.write.parquet(f"{path}/{version}/file_sig")
    record = {"dialect": dialect, "version": version, "mode": "update" if previous is not None and not fresh else "full", "reason": decision.reason, "changed": decision.changed, "ms": int(1000 * (time.time() - started))}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run")
    return index, decision


def status(spark: SparkSession, path: str) -> DataFrame:
    """label, value rows about the stored index."""
    run, index = run_record(spark, path), load(spark, path)
    counts = {"files": spark.read.parquet(f"{path}/{run['version']}/file_sig").count(), "functions": index.function.count(), "accesses": index.access.count(), "skipped files": index.skipped_file.count()}
    rows = [(k, f"{v:,}") for k, v in counts.items()] + [("mode", run["mode"]), ("duration", f"{run['ms']}ms" if run["ms"] < 1000 else f"{run['ms'] / 1000:.1f}s")]
    return spark.createDataFrame(rows, "label string, value string")


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether no source changed while it was read: exact signatures."""
    return impact.changed(after, before, tolerance_ms=1e-9).isEmpty()


def check_skipped(skipped: DataFrame, most: int = 16) -> int:
    """Number of skipped files; more than `most` is an error."""
    n = skipped.select("path").distinct().count()
    if n > most:
        raise RuntimeError(f"{n} files were skipped; at most {most} may be")
    return n


def culprits(events: DataFrame) -> DataFrame:
    """log, file: the file that each broken run was at; events: log, n (position), phase, event, file.

    The last start without a later end, error or done of its phase and file; else the last error; else the last event.
    """
    e = events.where("event IS NOT NULL")
    closed = e.where("event IN ('end', 'error', 'done')").groupBy("log", "phase", "file").agg(F.max("n").alias("_m"))
    c = closed.select(F.col("log").alias("_l"), F.col("phase").alias("_p"), F.col("file").alias("_f"), "_m")
    starts = e.where("event = 'start'").join(c, F.col("log").eqNullSafe(F.col("_l")) & F.col("phase").eqNullSafe(F.col("_p")) & F.col("file").eqNullSafe(F.col("_f")), "left")
    open_ = starts.where("_m IS NULL OR _m < n").select("log", F.lit(2).alias("r"), "n", "file")
    ranked = open_.unionByName(e.where("event = 'error'").select("log", F.lit(1).alias("r"), "n", "file")).unionByName(e.select("log", F.lit(0).alias("r"), "n", "file"))
    return ranked.groupBy("log").agg(F.max_by("file", F.struct("r", "n")).alias("file"))


def culprit(spark: SparkSession, path: str) -> str | None:
    """The file that a broken run was at, from its JSON lines; bad lines are passed over."""
    lines = spark.read.text(path).select(F.lit(0).alias("log"), F.monotonically_increasing_id().alias("n"), F.from_json("value", "phase string, event string, file string").alias("e"))
    found = culprits(lines.select("log", "n", "e.*")).first()
    return found["file"] if found else None


def remaining(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """The files without those skipped; both have path."""
    return files.join(skipped.select("path").distinct(), "path", "left_anti")


def with_skips(run: Callable[[DataFrame], T], files: DataFrame, culprit_of: Callable[[Exception], str | None], most: int = 16) -> tuple[T, DataFrame]:
    """run(files), and the files (path, reason) left out for it: after a failure the file at fault goes, and the rest is run again, up to `most` times.

    A failure that tells no file of the rest, and one file too many, is raised.
    """
    spark = files.sparkSession
    gone: dict[str, str] = {}
    while True:
        skipped = spark.createDataFrame(list(gone.items()), "path string, reason string")
        left = remaining(files, skipped)
        try:
            return run(left), skipped
        except Exception as e:  # noqa: BLE001
            at = culprit_of(e)
            if at is None or len(gone) >= most or left.where(F.col("path") == at).isEmpty():
                raise
            gone[at] = " ".join(str(e).split())[:500]


def unresolved_by_file(unresolved: DataFrame, signatures: DataFrame) -> DataFrame:
    """file, size, mtime_ms, kinds: file-level evidence by file, with its signature or zeros where it has none."""
    rows = unresolved.where("scope = 'file'").groupBy("file").agg(F.sort_array(F.collect_list("kind")).alias("kinds"))
    sig = signatures.select(F.col("path").alias("file"), "size", "mtime_ms")
    return rows.join(sig, "file", "left").select("file", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime_ms", F.lit(0)).cast("double").alias("mtime_ms"), "kinds")
