"""Code bases to measure with, rendered as rows of files from nothing but a number of them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = """#ifndef RING_H
#define RING_H
typedef struct tagLeaf {
    int value[200];
    int count;
} LEAF;
typedef struct tagBranch {
    int total;
    LEAF *leaf;
} BRANCH;
typedef struct tagTrunk {
    BRANCH branch1;
    BRANCH branch2;
    BRANCH branch3;
    BRANCH branch4;
} TRUNK;
extern TRUNK *trunk;
extern LEAF *leaves;
#endif
"""
MEMBERS = """#define DEVICE_IN state.counter
#define DEVICE_OUT mode
typedef struct tagInner {
    int flag;
} INNER;
typedef struct tagDevice {
    int mode;
    int counter;
    INNER inner;
} DEVICE;
DEVICE state;
DEVICE devices[4];
void direct(int step)
{
    DEVICE *p = &state;
    p->counter += step;
    state.mode = p->counter;
    devices[step & 3].counter = state.mode;
}
void through_macro(DEVICE *d)
{
    d->DEVICE_OUT = DEVICE_IN;
}
void nested(int step)
{
    state.inner.flag++;
    through_macro(&state);
    unknown((DEVICE *)step);
}
"""


def _text(*lines: str | Column) -> Column:
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines], F.lit(""))


def _join(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ring(numbers: DataFrame, n: int) -> DataFrame:
    """path, text of one file a number (i, below n): its function touches members through pointers and calls the next number's, the last one the first's."""
    i, after = F.col("i"), (F.col("i") + 1) % n
    text = _text(
        '#include "ring.h"',
        _join("void ring_", after, "(int step);"),
        _join("void ring_", i, "(int step)"),
        "{",
        _join("    trunk->branch", i % 4 + 1, ".total += step;"),
        _join("    trunk->branch4.leaf->count = step;"),
        _join("    (leaves + ", i % 8, ")->count++;"),
        "    if ((step & 3) == 0) {",
        _join("        ring_", after, "(step + 1);"),
        "    }",
        "}",
    )
    spark = numbers.sparkSession
    shared = spark.createDataFrame([("src/ring.h", HEADER), ("src/ring_globals.c", '#include "ring.h"\nTRUNK *trunk;\nLEAF *leaves;\n')], "path string, text string")
    return numbers.select(_join("src/ring_", i, ".c").alias("path"), text.alias("text")).unionByName(shared)


def stress(numbers: DataFrame, n: int, lines: int = 60, probes: int = 120, nesting: int = 12, stride: int = 20) -> DataFrame:
    """path, text of one deeply nested function a number: `lines` lines of `probes` calls to what nothing defines, each stride-th line touching globals, and three calls onwards."""
    i = F.col("i")
    pad = "    " * (nesting + 1)

    def body(k: Column) -> Column:
        touch = _join(pad, "stress_", (i + k) % 280, " += stress_", (i + k + 13) % 280, " + seed;")
        calls = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(probes)), lambda p: _join("probe_", i, "_", k, "_", p, "(seed);")), " ")
        return F.when(k % stride == 0, touch).otherwise(_join(pad, "local += seed; ", calls))

    opened = [f"{'    ' * (d + 1)}if ((seed + {d}) & {d + 1}) {{" for d in range(nesting)]
    closed = ["    " * (d + 1) + "}" for d in reversed(range(nesting))]
    onwards = [_join(pad, "stress_fn_", (i + k) % n, "(seed);") for k in (1, 97, 521)]
    text = _text(_join("void stress_fn_", i, "(int seed)"), "{", "    int local = seed;", *opened, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), body), "\n"), *onwards, *closed, "}")
    spark = numbers.sparkSession
    globals_ = spark.range(280).agg(F.array_join(F.sort_array(F.collect_list(_join("int stress_", F.col("id"), ";"))), "\n").alias("text")).select(F.lit("src/stress_globals.c").alias("path"), F.concat("text", F.lit("\n")).alias("text"))
    return numbers.select(_join("src/stress_", i, ".c").alias("path"), text.alias("text")).unionByName(globals_)


def members(spark: SparkSession) -> DataFrame:
    """path, text of one file with members touched directly, in arrays, through pointers, macros and parameters."""
    return spark.createDataFrame([("src/members.c", MEMBERS)], "path string, text string")


def write(spark: SparkSession, kind: str, folder: str, n: int) -> None:
    """Writes a sample with a project file and a thread map below a folder of the driver, which must be new or empty."""
    if os.path.isdir(folder) and os.listdir(folder):
        raise FileExistsError(folder)
    numbers = spark.range(n).withColumnRenamed("id", "i")
    files = {"ring": lambda: ring(numbers, n), "stress": lambda: stress(numbers, n), "members": lambda: members(spark)}[kind]()
    entry = {"ring": "ring_0", "stress": "stress_fn_0", "members": "nested"}[kind]
    os.makedirs(os.path.join(folder, "src"))
    names = []
    for r in files.toLocalIterator():
        with open(os.path.join(folder, r["path"]), "w", encoding="utf-8") as f:
            f.write(r["text"])
        names.append(r["path"])
    with open(os.path.join(folder, f"{kind}.dsp"), "w", encoding="utf-8") as f:
        for name in sorted(names):
            f.write(f"# Begin Source File\nSOURCE=.\\{name.replace('/', chr(92))}\n# End Source File\n")
    with open(os.path.join(folder, "threads.json"), "w", encoding="utf-8") as f:
        f.write('{"threads": [{"threadId": "main", "entryFunction": "%s", "isInterruptLike": false}]}' % entry)
