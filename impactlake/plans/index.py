"""The code index: source files in, fact and declaration tables out.

Two distributed passes over the files. The first reads declarations; what all files declare together (names,
types, aliases, parameter templates: a dictionary of the code base, not of its lines) is gathered and broadcast. The second
walks every function with it. All that follows is DataFrame work on tables in Parquet.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import accesses, declarations, lexer, preprocess
from ..scratch import cut
from . import impact
from .graph import reachability

DECLARED = "path string, ordinal long, kind string, name string, line int, body string, skipped string"
FACT = (
    "kind string, function_name string, seq int, variable_name string, target_name string, target_kind string, access string, file string, line int, evidence string, "
    "expanded_evidence string, reasons array<string>, access_expression string, macro_names array<string>"
)
#: Bytes of declarations, and of headers' directives, up to which they are broadcast. Beyond, each file is joined with what it names.
BROADCAST_BYTES = 64 << 20
#: Bytes of text, about, of a part in which names meet declarations.
PART_BYTES = 8 << 20
#: Bytes of text, about, of a part that a scan hands to Python as one Arrow batch, whose buffers double as they grow. A code base of up to WHOLE_BYTES is scanned as it is dealt.
SCAN_BYTES = 4 << 20
WHOLE_BYTES = 64 << 20
#: The kinds of facts that tables are made of; tables of declarations are made of none.
FACTS = {"access": "access", "access_index": "access", "unresolved": "unresolved", "call_edge": "call", "thread_reach": "call"}
_NAMES = r"[A-Za-z_][A-Za-z0-9_]*"


def _base(path: str) -> str:
    return path.replace("\\", "/").split("/")[-1].lower()


def _lines(path: str, text: str, macros: dict[str, str], headers: dict[str, str], include_paths: tuple[str, ...]) -> tuple[list[str], list[str]]:
    raw = lexer.split_lines(text)

    def load(name: str, quoted: bool, where: str):
        key = next((k for k in preprocess.candidates(name, quoted, where, include_paths) if k in headers), None)
        if key is not None:
            own = headers[key].split("\n")
            return key, own, own

    return raw, preprocess.active_lines(raw, lexer.mask(raw), dict(macros), load, (preprocess.path_key(path),), path)


def _included(text) -> F.Column:
    """Base names, in lower case, of all that a text includes."""
    named = F.regexp_extract_all(text, F.lit(r"(?m)^\s*#\s*include\s*[\"<]([^\">]+)"), F.lit(1))
    return F.transform(named, lambda n: F.lower(F.trim(F.substring_index(F.replace(n, F.lit("\\"), F.lit("/")), "/", -1))))


def directives(files: DataFrame) -> DataFrame:
    """key, path, lines, names of each file that some file may include: its base name, its path, its directives (comments blank), and the base names it includes."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"]):
                raw = lexer.split_lines(text or "")
                kept = [r if "include" in m else m for r, m in zip(raw, lexer.mask(raw)) if m.lstrip().startswith("#")]
                rows.append((_base(path), preprocess.path_key(path), "\n".join(kept), [_base(n) for n, _ in preprocess.includes(kept, kept)]))
            yield pd.DataFrame(rows, columns=["key", "path", "lines", "names"])

    named = files.select(F.explode(_included("text")).alias("key")).distinct()
    base = F.lower(F.substring_index(F.replace("path", F.lit("\\"), F.lit("/")), "/", -1))
    wanted = files.select("path", "text", base.alias("key")).join(named, "key", "left_semi").select("path", "text")
    return wanted.mapInPandas(run, "key string, path string, lines string, names array<string>").dropDuplicates(["path"])


def with_headers(files: DataFrame, most: int = BROADCAST_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """The files, and the directives of all headers where they are small; else the files have what they include in a map column, headers."""
    found = cut(directives(files))
    size = found.agg(F.coalesce(F.sum(F.octet_length("lines")), F.lit(0)).alias("n")).first()["n"]
    if size <= most:
        return files, {r["path"]: r["lines"] for r in found.select("path", "lines").collect()}
    need = cut(files.select("path", F.explode(_included("text")).alias("key")).distinct().join(found.select("key").distinct(), "key", "left_semi"))
    front = need
    while not front.isEmpty():
        further = front.join(found.select("key", "names"), "key").select("path", F.explode("names").alias("key")).distinct().join(found.select("key").distinct(), "key", "left_semi")
        front = cut(further.join(need, ["path", "key"], "left_anti"))
        need = cut(need.unionByName(front))
    own = need.join(found.select("key", F.col("path").alias("header"), "lines"), "key").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("header", "lines"))).alias("headers"))
    return files.join(own, "path", "left"), {}


def _headers_of(file: dict, shared: dict[str, str]) -> dict[str, str]:
    """A file's headers: its own, where the files carry them."""
    own = file.get("headers")
    return dict(own) if own is not None else shared


#: Rows of a batch that a scan hands back.
OUT_ROWS = 8192
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def _one_by_one(batches):
    """The rows of Arrow batches as dicts; only one row at a time is turned into Python's objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _batches(rows, schema: str):
    """Arrow batches of OUT_ROWS tuples each, so that what a task holds goes with one file, not with a batch of files."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
    rows = iter(rows)
    while some := list(islice(rows, OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), fields)], schema=fields)


def dealt(files: DataFrame) -> tuple[DataFrame, int]:
    """The files, and the bytes of their texts. A large code base is dealt by path to parts of about SCAN_BYTES, so that what a task holds goes neither with the code base nor with the session's sizes of partitions."""
    length = files.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return (files.repartition(_parts(files, length, SCAN_BYTES), "path") if length > WHOLE_BYTES else files), length


def _parts(files: DataFrame, length: int, of: int) -> int:
    return max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // of)


def _carried(files: DataFrame, *columns: str) -> DataFrame:
    return files.select(*columns, *(c for c in ("headers", "context") if c in files.columns))


def declare(files: DataFrame, macros: dict[str, str], headers: dict[str, str], include_paths: tuple[str, ...] = ()) -> DataFrame:
    """Rows of DECLARED for files (path, ordinal, text); a file that fails gives one row that says why."""
    sent = files.sparkSession.sparkContext.broadcast((macros, headers))

    def rows(path, ordinal, text, own_headers):
        try:
            raw, active = _lines(path, text or "", sent.value[0], own_headers, include_paths)
            found = declarations.functions(raw, active)
            parts = [("macro", d) for d in declarations.macros(raw, active)] + [("type", d) for d in declarations.types(raw, active)]
            parts += [("global", d) for d in declarations.globals_(active, [(f.start_line, f.end_line) for f in found])]
            parts += [("function", {"name": f.name, "line": f.start_line, "end_line": f.end_line, "signature": f.signature}) for f in found]
            parts += [("template", {"name": f.name, "line": f.start_line, **t}) for f in found for t in accesses.templates(f)]
            parts += [("include", {"name": n, "line": 0, "quoted": q}) for n, q in preprocess.includes(raw, active)]
        except Exception as e:  # noqa: BLE001  one bad file is told, the others go on
            yield path, ordinal, "skipped", None, 0, None, f"{type(e).__name__}: {e}"[:500]
            return
        for kind, d in parts:
            yield path, ordinal, kind, d["name"], d["line"], json.dumps(d), None

    def run(batches):
        files = ((f["path"], f["ordinal"], f["text"], _headers_of(f, sent.value[1])) for f in _one_by_one(batches))
        yield from _batches((r for f in files for r in rows(*f)), DECLARED)

    return _carried(files, "path", "ordinal", "text").mapInArrow(run, DECLARED)


_PART = r"[A-Za-z_]\w*(?:\s*\[[^\]]+\])?"
_DOTTED = re.compile(r"[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)*")
_MEMBER = re.compile(rf"\b{_PART}(?:\s*(?:\.|->|::)\s*{_PART})+")


def alias_target(replacement: str | None, parameters: list[str], is_function_like: bool) -> str | None:
    """What a macro stands for: a dotted name that is all of an object-like one, or a function-like one's first member expression, white space and
    indexes aside, or else its first name that is no parameter."""
    text = (replacement or "").strip()
    if not is_function_like:
        return text if _DOTTED.fullmatch(text) else None
    if m := _MEMBER.search(text):
        return re.sub(r"\[[^\]]+\]", "[]", "".join(m.group().split()))
    return next((n for n in re.findall(r"\b[A-Za-z_]\w*\b", text) if n not in parameters), None)


def aliases_of(macros: list[dict], globals_: set[str]) -> dict[str, dict]:
    """The macros that lines are expanded with, in name order, the first definition of each: function-like ones must stand for a global or a member."""
    out: dict[str, dict] = {}
    for m in sorted(macros, key=lambda m: m["name"]):
        target = alias_target(m["replacement"], m["parameters"], m["is_function_like"])
        if target and m["name"] not in out and (not m["is_function_like"] or target in globals_ or any(c in target for c in (".", "->", "::"))):
            out[m["name"]] = m
    return out


def macro_aliases(macro_def: DataFrame, global_var: DataFrame, member_symbol: DataFrame) -> DataFrame:
    """Every definition of a macro that stands for something, with target_name and target_kind: a global before a member before unknown.

    Function-like macros of unknown targets are left out.
    """

    def run(batches):
        for batch in batches:
            batch["target_name"] = [alias_target(r, list(p if p is not None else []), f) for r, p, f in zip(batch["replacement"], batch["parameters"], batch["is_function_like"])]
            yield batch[batch["target_name"].notna()]

    kept = macro_def.select("name", "replacement", "parameters", "is_function_like", "file", "line", "declaration")
    schema = T.StructType([*kept.schema.fields, T.StructField("target_name", T.StringType())])
    found = kept.mapInPandas(run, schema)
    data = global_var.select("name", F.lit(0).alias("r")).union(member_symbol.select("name", F.lit(1).alias("r"))).groupBy(F.col("name").alias("target_name")).agg(F.min("r").alias("r"))
    kind = F.when(F.col("r") == 0, "global").when(F.col("r") == 1, "member").otherwise("unknown")
    told = found.join(data, "target_name", "left").withColumn("target_kind", kind).drop("r")
    return told.where(~(F.col("is_function_like") & (F.col("target_kind") == "unknown")))


def context_from(rows, dialect: str = "primary", first: dict[str, dict] | None = None) -> accesses.Context:
    """A context from declarations (kind, ordinal, path, line, rank, body); the first of a name wins, in file order, then by line and rank. first: the globals, where they are told apart already."""
    by: dict[str, list[dict]] = {"macro": [], "type": [], "global": [], "function": [], "template": []}
    for kind, *_, body in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0], r[4])):
        by[kind].append(body)
    types: dict[str, dict] = {}
    for t in by["type"]:
        for n in [t["name"], *t["aliases"]]:
            types.setdefault(n, t)
    first = dict(first or {})
    for g in by["global"]:
        first.setdefault(g["name"], g)
    simple: dict[str, list[str]] = {}
    for f in by["function"]:
        full = simple.setdefault(f["name"].split("::")[-1], [])
        full += [f["name"]] if f["name"] not in full else []
    ctx = accesses.Context(set(first), first, types, simple, {}, aliases_of(by["macro"], set(first)), dialect)
    for t in by["template"]:
        known = next((n for n in ctx.type_names if n in t["words"]), None)
        row = (t["parameter"], tuple(t["path"]), t["access"], f"{known}::{'.'.join(t['path'])}" if known else None)
        own = ctx.templates.setdefault(t["name"], [])
        own += [row] if row not in own else []
    return ctx


def _entries(declared: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """keys, refs, entry of what contexts are made of: the names it goes by, the names it may lead to, and itself as JSON, [[kind, path], ordinal, line, body].

    Of functions and globals, which are many, only the first of a name is kept, with what a walk asks for; they lead to nothing but a global's type. A walk that
    is not asked for calls needs those functions only that touch members through parameters, and one for calls alone those globals only that macros may stand for.
    """
    said = "ordinal", "path", "line", "body"
    many = declared.where(F.col("kind").isin("function", "global")).groupBy("kind", "name").agg(F.min(F.struct(*said)).alias("m")).select("kind", "name", "m.*")
    if "call" not in kinds:
        many = many.where("kind = 'global'").unionByName(many.where("kind = 'function'").join(declared.where("kind = 'template'").select("name").distinct(), "name", "left_semi"))
    elif kinds == ("call",):
        meant = declared.where("kind = 'macro'").select(F.explode(F.regexp_extract_all("body", F.lit(_NAMES), F.lit(0))).alias("name")).distinct()
        many = many.where("kind = 'function'").unionByName(many.where("kind = 'global'").join(meant, "name", "left_semi"))
    g = F.from_json("body", "name string, type_name string, is_array boolean, pointer_level int")
    known = F.when(F.col("kind") == "global", F.to_json(g, {"ignoreNullFields": "false"})).otherwise(F.to_json(F.struct("name")))
    simple = F.array_distinct(F.array(F.substring_index("name", "::", -1), F.col("name")))
    many = many.select("kind", *said[:3], known.alias("body"), simple.alias("keys"), F.when(F.col("kind") == "global", F.array_compact(F.array(g["type_name"]))).otherwise(F.array().cast("array<string>")).alias("refs"))
    inner = F.from_json("body", "aliases array<string>, members array<struct<name:string>>")
    names = F.array_distinct(F.concat(simple, *[F.coalesce(c, F.array().cast("array<string>")) for c in (inner["aliases"], inner["members"]["name"])]))
    few = declared.where(F.col("kind").isin("macro", "type", "template")).select("kind", *said, names.alias("keys"), F.array_distinct(F.regexp_extract_all("body", F.lit(_NAMES), F.lit(0))).alias("refs"))
    place = F.to_json(F.array("kind", "path"))
    entry = F.concat(F.lit("["), place, F.lit(","), F.coalesce(F.col("ordinal").cast("string"), F.lit("null")), F.lit(","), F.col("line").cast("string"), F.lit(","), "body", F.lit("]"))
    return many.unionByName(few).select("keys", "refs", entry.alias("entry"))


def with_context(files: DataFrame, declared: DataFrame, length: int, kinds: tuple[str, ...]) -> DataFrame:
    """The files with a column, context: a JSON array of the declarations that each names, and of those that these name in turn.

    No file gets more than it can use, and nothing is broadcast: joins of identifiers with declared names, dealt to parts by the length of all texts. What leads where is joined once for
    the code base; files follow it round by round until none gets a new declaration, and without a round where nothing leads on.
    """
    parts, scans = _parts(files, length, PART_BYTES), _parts(files, length, SCAN_BYTES)
    entries = cut(_entries(declared, kinds))
    own = F.xxhash64("entry").alias("id")
    keyed = entries.select(F.explode("keys").alias("key"), own)
    links = cut(entries.where(F.size("refs") > 0).select(own, F.explode("refs").alias("key")).join(keyed.withColumnRenamed("id", "to"), "key").where("id <> to").select("id", "to").distinct())
    named = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0)))).alias("key")).repartition(parts, "key")
    need = named.join(entries.select(F.explode("keys").alias("key"), "entry").repartition(parts, "key"), "key").select("path", "entry")
    if not links.isEmpty():
        need = cut(need)
        ends = links.select("id").union(links.select(F.col("to").alias("id"))).distinct()
        seen = front = cut(need.select("path", own).join(ends, "id", "left_semi").distinct())
        start = seen
        while not front.isEmpty():
            front = cut(front.join(links, "id").select("path", F.col("to").alias("id")).distinct().join(seen, ["path", "id"], "left_anti"))
            seen = cut(seen.unionByName(front))
        need = need.unionByName(seen.join(start, ["path", "id"], "left_anti").join(entries.select(own, "entry"), "id").select("path", "entry"))
    context = need.repartition(scans, "path").groupBy("path").agg(F.collect_set("entry").alias("entries")).select("path", F.concat(F.lit("["), F.array_join("entries", ","), F.lit("]")).alias("context"))
    return files.repartition(scans, "path").join(context, "path", "left")


def _carried_context(text: str | None, dialect: str) -> accesses.Context:
    """The context that a file carries."""
    globals_, rest = {}, []
    for (kind, path), ordinal, line, body in json.loads(text or "[]"):
        if kind == "global":
            globals_[body["name"]] = body
        else:
            rest.append((kind, ordinal, path, line, json.dumps(body) if kind == "template" else body["name"], body))
    return context_from(rest, dialect, globals_)


def walk(files: DataFrame, ctx: accesses.Context | None, macros: dict[str, str], headers: dict[str, str], dialect: str = "primary", include_paths: tuple[str, ...] = (), kinds: tuple[str, ...] = ("access", "unresolved", "call")) -> DataFrame:
    """Rows of FACT: accesses, calls and unresolved evidence of every function, as far as kinds ask for them, and the files that failed. Without ctx the files carry their context."""
    sent = files.sparkSession.sparkContext.broadcast((macros, headers, ctx))

    def rows(path, text, own_headers, context):
        own_macros, _, whole = sent.value
        try:
            context = whole or _carried_context(context, dialect)
            raw, active = _lines(path, text or "", own_macros, own_headers, include_paths)
            for f in declarations.functions(raw, active):
                w = accesses.Walk(f, context).run(touches=kinds != ("call",))
                for r in w.rows if "access" in kinds else ():
                    yield "access", f.name, r["seq"], r["variable_name"], r["target_name"], r["target_kind"], r["kind"], path, r["line"], r["evidence"], r["expanded_evidence"], r["reasons"], r["access_expression"], r["macro_names"]
                for i, n in enumerate(w.notes if "unresolved" in kinds else ()):
                    yield "unresolved", f.name, i, n["variable_name"], None, None, n["kind"], path, n["line"], n["evidence"], None, None, None, None
                for c in sorted(w.called) if "call" in kinds else ():
                    yield "call", f.name, None, None, c, None, None, path, None, None, None, None, None, None
        except Exception as e:  # noqa: BLE001
            yield "skipped", None, None, None, None, None, None, path, None, f"{type(e).__name__}: {e}"[:500], None, None, None, None

    def run(batches):
        files = ((f["path"], f["text"], _headers_of(f, sent.value[1]), f.get("context")) for f in _one_by_one(batches))
        yield from _batches((r for f in files for r in rows(*f)), FACT)

    return _carried(files, "path", "text").mapInArrow(run, FACT)


@dataclass
class CodeIndex:
    """The tables of an index, as lazy DataFrames, and questions to them."""

    spark: SparkSession
    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def build(cls, files: DataFrame, threads: DataFrame, macros: dict[str, str] | None = None, path: str | None = None, broadcast_bytes: int = BROADCAST_BYTES, dialect: str = "primary", include_paths: tuple[str, ...] = (), only: str | None = None) -> CodeIndex:
        """files: path, text (and ordinal, else they go by their paths); threads: thread_id, entry_function, is_interrupt_like.

        Headers that conditional compilation needs are found among the files: beside the one that includes them, then in include_paths. All declarations are broadcast
        up to broadcast_bytes; a larger code base is joined file by file with what it names. With a path, all tables are written there.
        With only, just the table of that name is to be used: what it does not need is not worked out, and its facts are not stored.
        """
        spark = files.sparkSession
        if "ordinal" not in files.columns:
            files = files.withColumn("ordinal", F.lit(0).cast("long"))
        macros = dict(macros or {})
        files, headers = with_headers(files, broadcast_bytes)
        files, length = dealt(files)
        declared = cut(declare(files, macros, headers, include_paths))
        kinds = tuple(sorted(set(FACTS.values()))) if only is None else (FACTS[only],) if only in FACTS else ()
        if only is not None and not kinds and only != "skipped_file":
            facts = spark.createDataFrame([], FACT)
        else:
            size = declared.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
            if size <= broadcast_bytes:
                rows = declared.where(F.col("kind").isin("macro", "type", "global", "function", "template")).select("kind", "ordinal", "path", "line", "body", "body").collect()
                ctx = context_from([(*r[:5], json.loads(r[5])) for r in rows], dialect)
            else:
                files, ctx = with_context(files, declared, length, kinds), None
            facts = walk(files, ctx, macros, headers, dialect, include_paths, kinds)
            facts = cut(facts) if only is None or only == "thread_reach" else facts
        body = lambda kind, schema: declared.where(F.col("kind") == kind).select("path", "ordinal", F.from_json("body", schema).alias("b"))
        members = "array<struct<name:string,member_type:string,is_array:boolean,pointer_level:int,line:int,declaration:string>>"
        types = body("type", f"name string, aliases array<string>, line int, declaration string, members {members}").select(F.col("path").alias("file"), "ordinal", "b.*")
        t: dict[str, DataFrame] = {
            "global_var": body("global", "name string, line int, declaration string, is_extern boolean, type_name string, is_array boolean, pointer_level int").select(F.col("path").alias("file"), "ordinal", "b.*"),
            "struct_type": types.drop("members"),
            "struct_member": types.select("file", F.col("name").alias("type_name"), F.posexplode("members").alias("position", "m")).select("file", "type_name", "position", "m.*"),
            "macro_def": body("macro", "name string, replacement string, parameters array<string>, is_function_like boolean, line int, declaration string").select(F.col("path").alias("file"), "ordinal", "b.*"),
            "function": body("function", "name string, line int, end_line int, signature string").select("b.name", F.col("path").alias("file"), "ordinal", F.col("b.line").alias("start_line"), "b.end_line", "b.signature"),
            "include": body("include", "name string, quoted boolean").select(F.col("path").alias("file"), "b.*"),
            "skipped_file": declared.where("kind = 'skipped'").select("path", F.lit("declare").alias("phase"), F.col("skipped").alias("reason")).unionByName(facts.where("kind = 'skipped'").select(F.col("file").alias("path"), F.lit("walk").alias("phase"), F.col("evidence").alias("reason"))),
            "call_edge": facts.where("kind = 'call'").select(F.col("function_name").alias("caller"), F.col("target_name").alias("callee")).distinct(),
            "thread": threads,
        }
        t["access"] = facts.where("kind = 'access'").select("function_name", "seq", "variable_name", "target_name", "target_kind", F.col("access").alias("kind"), "file", "line", "evidence", "expanded_evidence", "reasons", "access_expression", "macro_names")
        inside = facts.where("kind = 'unresolved'").select(F.col("access").alias("kind"), "function_name", "variable_name", "file", "line", "evidence", F.lit("function").alias("scope"))
        macro_notes = t["macro_def"].where("is_function_like").select(F.lit("macro").alias("kind"), F.lit(None).cast("string").alias("function_name"), F.lit(None).cast("string").alias("variable_name"), "file", "line", F.col("declaration").alias("evidence"), F.lit("file").alias("scope"))
        t["unresolved"] = inside.unionByName(macro_notes) if dialect == "primary" else inside
        typed = types.select(F.explode(F.array_distinct(F.concat(F.array("name"), F.col("aliases")))).alias("type_name"), "file", "ordinal", "line", "members")
        typed = impact.keep_first(typed, ["type_name"], ["ordinal", "file", "line"])
        named = typed.select("type_name", "file", F.explode("members").alias("m")).select("type_name", "file", "m.name", "m.member_type", "m.is_array", "m.pointer_level", "m.line", "m.declaration")
        owners = impact.keep_first(t["global_var"], ["name"], ["ordinal", "file", "line"]).join(typed.select("type_name"), "type_name", "left_semi")
        t["member_symbol"] = impact.member_expansion(owners.select("name", "type_name", "is_array", "pointer_level"), named)
        t["macro_alias"] = macro_aliases(t["macro_def"], t["global_var"], t["member_symbol"])
        if only in (None, "thread_reach"):
            t["thread_reach"] = reachability(threads, t["call_edge"])
        t["access_index"] = impact.inverted_index(t["access"])
        index = cls(spark, t)
        return index.save(path) if path else index

    def save(self, path: str) -> CodeIndex:
        """Writes every table; facts are sorted by their function within files, so that a symbol's functions prune row groups."""
        for name, df in self.tables.items():
            key = next((c for c in ("function_name", "symbol", "name", "caller") if c in df.columns), df.columns[0])
            df.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")
        return CodeIndex.load(self.spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeIndex:
        names = ["global_var", "struct_type", "struct_member", "macro_def", "function", "include", "skipped_file", "call_edge", "thread", "access", "unresolved", "macro_alias", "member_symbol", "thread_reach", "access_index"]
        return cls(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names})

    def hydrated(self, symbols: DataFrame) -> CodeIndex:
        """The index with the function-level tables of those functions only that the access index finds under a symbol (symbol).

        The symbols are a filter that the sorted index sees, as long as they are few; the facts are semi-joined.
        """
        few = [r["symbol"] for r in symbols.select("symbol").distinct().limit(impact.MOST_PUSHED + 1).collect()]
        found = self.access_index.where(F.col("symbol").isin(few)) if len(few) <= impact.MOST_PUSHED else self.access_index.join(symbols.select("symbol"), "symbol", "left_semi")
        names = cut(found.select("function_name").distinct())
        t = dict(self.tables)
        t["access"] = t["access"].join(names, "function_name", "left_semi").select(*t["access"].columns)
        t["function"] = t["function"].join(names.withColumnRenamed("function_name", "name"), "name", "left_semi").select(*t["function"].columns)
        own = t["unresolved"].where("scope = 'function'").join(names, "function_name", "left_semi").select(*t["unresolved"].columns)
        t["unresolved"] = own.unionByName(t["unresolved"].where("scope = 'file'"))
        return CodeIndex(self.spark, t)

    def sizes(self) -> DataFrame:
        """label, n: how many globals, functions, types, typed globals and aliases the declarations of the code base hold."""
        t = self.tables
        typed = t["global_var"].join(t["struct_type"].select(F.explode(F.array_distinct(F.concat(F.array("name"), F.col("aliases")))).alias("type_name")).distinct(), "type_name", "left_semi")
        parts = {"globals": (t["global_var"], "name"), "functions": (t["function"], "name"), "types": (t["struct_type"], "name"), "typed globals": (typed, "name"), "aliases": (t["macro_alias"], "name")}
        out = None
        for label, (df, key) in parts.items():
            one = df.agg(F.countDistinct(key).alias("n")).select(F.lit(label).alias("label"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def impact(self, symbol: str, depth: int = 4) -> Impact:
        return Impact(self, symbol, depth)


class Impact:
    """All that a change of one symbol touches; every part is a DataFrame."""

    def __init__(self, index: CodeIndex, symbol: str, depth: int = 4):
        from .graph import neighborhood

        self.index, self.symbol, self.depth = index, symbol, depth
        spark, t = index.spark, index.tables
        one = spark.createDataFrame([(symbol,)], "symbol string")
        typed, actual = impact.inferred_members(one, t["access"], t["unresolved"].where("scope = 'function'"), t["global_var"], t["member_symbol"], t["macro_alias"])
        self.lookup = cut(one.unionByName(typed.select(F.col("name").alias("symbol"))).unionByName(actual.select(F.col("name").alias("symbol"))).distinct())
        self.members = cut(t["member_symbol"].join(self.lookup.join(typed.select(F.col("name").alias("symbol")), "symbol", "left_anti").withColumnRenamed("symbol", "name"), "name", "left_semi").select("name", "file", "line", "declaration").distinct())
        known = {"global": t["global_var"], "member": self.members, "macro": t["macro_alias"], "function": t["function"]}
        own = {k: (df if k == "member" else df.where(F.col("name") == symbol)).select(F.lit(symbol).alias("name")) for k, df in known.items()}
        self.kind = impact.symbol_kind(one, own["global"], own["member"], own["macro"], own["function"]).first()["symbol_kind"]
        targets = t["macro_alias"].where(F.col("name") == (symbol if self.kind == "macro" else None)).select(F.col("target_name").alias("symbol")).distinct()
        if self.kind == "function":
            seeds = one.select(F.col("symbol").alias("name"))
            ahead, out_edges = neighborhood(t["call_edge"], seeds, depth)
            behind, in_edges = neighborhood(t["call_edge"], seeds, depth, reverse=True)
            self.names = ahead.select("name").union(behind.select("name")).distinct()
            self.edges_walked = out_edges.select("caller", "callee").union(in_edges.select("caller", "callee")).distinct()
            self.accesses = t["access"].limit(0)
        else:
            wanted = targets if self.kind == "macro" else self.lookup
            self.accesses = impact.touching(t["access"], wanted)
            if self.kind == "macro":
                by_macro = t["access"].where(F.array_contains("macro_names", symbol))
                self.accesses = self.accesses.unionByName(by_macro).dropDuplicates(["function_name", "seq", "file"])
            self.accesses = cut(self.accesses)
            self.names = self.accesses.select(F.col("function_name").alias("name")).distinct()
            self.edges_walked = t["call_edge"].limit(0)
        self.names = cut(self.names)
        self.functions = impact.keep_last(t["function"].join(self.names, "name", "left_semi"), ["name"], ["ordinal", "file", "start_line"])
        self.threads = t["thread_reach"].join(self.names.withColumnRenamed("name", "function_name"), "function_name", "left_semi")
        notes_of = t["unresolved"].where("scope = 'function'").join(self.names.withColumnRenamed("name", "function_name"), "function_name", "left_semi")
        if self.kind == "function":
            notes = impact.topology(notes_of)
        else:
            both = notes_of.unionByName(t["unresolved"].where("scope = 'file'"))
            asked = self.lookup.unionByName(targets).distinct().withColumn("symbol_kind", F.when(F.col("symbol") == symbol, F.lit(self.kind)).otherwise(F.lit("alias")))
            notes = impact.relevant_unresolved(asked, both).drop("symbol", "symbol_kind")
        self.unresolved = cut(impact.dedup_unresolved(notes, ["evidence"]))
        mark = F.lit(symbol).alias("symbol")
        rows = self.accesses.select(mark, "function_name", "kind")
        self.risks = impact.risks(spark.createDataFrame([(symbol, self.kind)], "symbol string, symbol_kind string"), rows, t["thread_reach"], self.unresolved.select(mark, "kind")).orderBy("rank")
        decl = t["global_var"].where(F.col("name") == symbol).select(F.lit("global").alias("kind"), "name", "file", "line", "declaration")
        macro = t["macro_def"].where(F.col("name") == symbol).select(F.lit("macro").alias("kind"), "name", "file", "line", "declaration")
        fn = t["function"].where(F.col("name") == symbol).select(F.lit("function").alias("kind"), "name", "file", F.col("start_line").alias("line"), F.col("signature").alias("declaration"))
        self.declarations = decl.unionByName(self.members.select(F.lit("member").alias("kind"), "name", "file", "line", "declaration")).unionByName(macro).unionByName(fn)

    def evidence(self, most: int) -> DataFrame:
        """code, rank, file, line: the first places that speak for each risk, in the order of functions."""
        mark = F.lit(self.symbol).alias("symbol")
        cited = impact.risk_evidence(self.accesses.select(mark, "function_name", "seq", "kind", "file", "line"), self.unresolved.select(mark, "kind", "function_name", "file", "line"), most)
        return cited.join(self.risks.select("code"), "code", "left_semi").drop("symbol")

    def _expansions(self) -> DataFrame:
        """What a macro stands for: name and kind."""
        own = F.col("name") == (self.symbol if self.kind == "macro" else None)
        return self.index.tables["macro_alias"].where(own).select(F.col("target_name").alias("name"), F.col("target_kind").alias("kind"))

    def nodes(self) -> DataFrame:
        """id, label, kind of the impact graph, each id once."""
        target = self.index.spark.createDataFrame([("target", self.symbol, "target")], "id string, label string, kind string")
        place = F.concat_ws(":", "kind", "name", "file", "line")
        parts = [
            self.declarations.select(place.alias("id"), F.col("declaration").alias("label"), "kind"),
            self._expansions().select(F.concat_ws(":", "kind", "name").alias("id"), F.col("name").alias("label"), "kind"),
            self.functions.select(F.concat(F.lit("function:"), "name").alias("id"), F.col("name").alias("label"), F.lit("function").alias("kind")),
            self.threads.select(F.concat(F.lit("thread:"), "thread_id").alias("id"), F.col("thread_id").alias("label"), F.lit("thread").alias("kind")),
            self.risks.select(F.concat(F.lit("risk:"), "code").alias("id"), F.col("code").alias("label"), F.lit("risk").alias("kind")),
            self.unresolved.limit(1).select(F.lit("unresolved").alias("id"), F.lit("unresolved evidence").alias("label"), F.lit("unresolved").alias("kind")),
        ]
        for p in parts:
            target = target.unionByName(p)
        return target.dropDuplicates(["id"])

    def edges(self) -> DataFrame:
        """src, dst, label; only calls are kept once."""
        fn = lambda c: F.concat(F.lit("function:"), c)
        place = F.concat_ws(":", "kind", "name", "file", "line")
        to = lambda df, src, dst, label: df.select(src.alias("src"), dst.alias("dst"), label.alias("label"))
        t, names = F.lit("target"), self.functions.select("name")
        walked = self.edges_walked.join(names.withColumnRenamed("name", "caller"), "caller", "left_semi").join(names.withColumnRenamed("name", "callee"), "callee", "left_semi")
        parts = [
            to(self._expansions(), t, F.concat_ws(":", "kind", "name"), F.lit("expands-to")),
            to(self.functions, t, fn("name"), F.lit("access" if self.kind != "function" else "related")),
            to(walked.distinct(), fn("caller"), fn("callee"), F.lit("calls")),
            to(self.accesses, fn("function_name"), t, F.col("kind")),
            to(self.threads, F.concat(F.lit("thread:"), "thread_id"), fn("function_name"), F.lit("reaches")),
            to(self.risks, t, F.concat(F.lit("risk:"), "code"), F.col("severity")),
            to(self.unresolved.limit(1), t, F.lit("unresolved"), F.lit("needs-review")),
        ]
        out = to(self.declarations, t, place, F.lit("decl"))
        for p in parts:
            out = out.unionByName(p)
        return out
