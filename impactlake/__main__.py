"""Command line: scan files, build and update an index, ask it, write reports, render samples."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .settings import Settings, symbol_argument


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("impactlake").getOrCreate()


def _settings(a: argparse.Namespace) -> Settings:
    given = {}
    if a.settings:
        with open(a.settings, encoding="utf-8") as f:
            given = json.load(f)
    return Settings.of(given | {k: getattr(a, k) for k in ("project_file", "thread_map", "output_dir", "index_path", "configuration", "dialect") if getattr(a, k, None)})


def _sources(spark, root: str, s: Settings):
    from .sources import corpus, project, threadmap

    p = project.load(root, s.project_file or None, s.exclude, s.project_encoding, s.configuration, s.source_encoding)
    files = corpus.scan(spark, list(p.source_files), s.source_encoding, s.exclude)
    return p, files, threadmap.read(spark, os.path.join(root, s.thread_map) if s.thread_map else None)


def scan(spark, paths: list[str], encoding: str = "auto", define: list[str] = (), include: list[str] = (), dialect: str = "primary"):
    """An index of the files alone, without a project."""
    from .plans.index import CodeIndex
    from .sources import corpus

    macros = {n: v if eq else "1" for n, eq, v in (d.partition("=") for d in define)}
    none = spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    return CodeIndex.build(corpus.scan(spark, paths, encoding), none, macros, dialect=dialect, include_paths=tuple(include))


def update(spark, root: str, s: Settings, fresh: bool = False):
    """Builds the index of a project's folder, or brings it up to date; more skipped files than allowed is an error."""
    from .plans import store
    from .sources import corpus

    p, files, threads = _sources(spark, root, s)
    path = s.index_folder(root)
    index, decision = store.update(spark, path, files, threads, p.macro_values(), s.dialect, include_paths=p.include_paths, fresh=fresh, max_skipped=s.max_skipped_files, signatures_now=lambda: corpus.signatures(spark, list(p.source_files), s.exclude))
    return index, decision


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="impactlake")
    sub = ap.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str):
        c = sub.add_parser(name, help=text)
        for x in positional:
            c.add_argument(x)
        return c

    for name, text in (("scan-file", "facts of one source file, as JSON"), ("scan-many", "facts of the files that a JSON list names"), ("analyze-many", "the same, written as an index")):
        c = command(name, text, "path")
        c.add_argument("--encoding", default="auto")
        c.add_argument("--define", action="append", default=[])
        c.add_argument("--include", action="append", default=[])
        c.add_argument("--dialect", default="primary")
        c.add_argument("--output")
    for name, text, more in (("build", "build the index of a project's folder", ()), ("update", "bring the index up to date", ()), ("status", "what the stored index holds", ()), ("inspect", "what a change of a symbol touches", ("symbol",)), ("report", "write a symbol's report and page", ("symbol",)), ("graph", "nodes and edges of a symbol", ("symbol",))):
        c = command(name, text, "root", *more)
        c.add_argument("--settings", help="a JSON file of settings")
        for option in ("project_file", "thread_map", "output_dir", "index_path", "configuration", "dialect"):
            c.add_argument(f"--{option.replace('_', '-')}")
    c = command("sample", "render a code base to measure with", "kind", "folder")
    c.add_argument("--files", type=int, default=200)
    a = ap.parse_args(argv)
    spark = session()
    say = lambda df: [print(json.dumps(r.asDict(True), ensure_ascii=False, default=str)) for r in df.toLocalIterator()]
    if a.command in ("scan-file", "scan-many", "analyze-many"):
        paths = [a.path]
        if a.command != "scan-file":
            with open(a.path, encoding="utf-8") as f:
                paths = json.load(f)
        index = scan(spark, paths, a.encoding, a.define, a.include, a.dialect)
        if a.output:
            index.save(a.output)
        else:
            for table in ("global_var", "struct_type", "struct_member", "macro_def", "function", "access", "call_edge", "unresolved", "skipped_file"):
                say(index.tables[table].selectExpr(f"'{table}' AS table", "*"))
        return 0
    if a.command == "sample":
        from .sources import samples

        samples.write(spark, a.kind, a.folder, a.files)
        return 0
    from .plans import report, store

    s = _settings(a)
    path = s.index_folder(a.root)
    if a.command in ("build", "update"):
        _, decision = update(spark, a.root, s, fresh=a.command == "build")
        print(json.dumps({"reason": decision.reason, "changed": decision.changed}))
    if a.command in ("build", "update", "status"):
        say(store.status(spark, path))
        return 0
    i = store.load(spark, path).impact(symbol_argument(a.symbol), s.depth)
    if a.command == "inspect":
        say(report.tree(i))
    elif a.command == "graph":
        say(i.nodes())
        say(i.edges())
    else:
        print(*report.write(i, s.folder(a.root)), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
