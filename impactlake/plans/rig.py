"""Queries that run the library over C text, project files and logs rendered from the tables, against SQL on the tables.

One code base, the rig, is rendered and indexed once for each session and directory. A nation is a device: a global of its region's
structure type, plain, an array or a pointer; a part is a function that touches one device in one of eight ways.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import declarations, lexer, preprocess
from ..scratch import scratch
from ..sources import corpus, project, samples, threadmap
from . import graph, impact, report, store
from .contract import query
from .index import CodeIndex

_built: dict[tuple, CodeIndex] = {}


def each(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """The rows (tuples) that fn gives for each row of df."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [t for r in batch.itertuples(index=False) for t in fn(*r)]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInPandas(run, schema)


def _s(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


#: The parts as functions (f) and nations as devices (d), on the SQL side. o is how a function names its device's members.
_RIG = """d AS (SELECT n_nationkey AS n, n_regionkey AS r, n_nationkey % 3 AS form, 'dev_' || n_nationkey AS dev,
        'dev_' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '[].' ELSE '->' END AS o FROM nation),
    f AS (SELECT p_partkey AS p, p_partkey % 8 AS k, 'pf_' || p_partkey AS fn, d.* FROM part JOIN d ON n = p_partkey % 25)"""
_ACCESS = """acc AS (SELECT fn, o || 'm0' AS variable, NULL AS target, CASE k WHEN 1 THEN 'read' WHEN 3 THEN 'unknown' ELSE 'write' END AS kind FROM f WHERE k IN (0, 1, 3, 7)
    UNION ALL SELECT fn, o || 'in.deep', NULL, 'write' FROM f WHERE k = 2
    UNION ALL SELECT fn, dev, NULL, 'unknown' FROM f WHERE k = 4 AND form = 0 UNION ALL SELECT fn, dev || '.m0', NULL, 'write' FROM f WHERE k = 4 AND form = 0
    UNION ALL SELECT fn, o || 'bits', NULL, 'read' FROM f WHERE k = 4 AND form <> 0
    UNION ALL SELECT fn, o || 'm0', NULL, 'write' FROM f WHERE k = 5 AND form <> 1
    UNION ALL SELECT fn, dev, NULL, CASE form WHEN 2 THEN 'read' ELSE 'unknown' END FROM f WHERE k = 6
    UNION ALL SELECT fn, o || m, 'KIND' || r || '::' || m, 'write' FROM f, (VALUES ('m0'), ('in.deep')) v(m) WHERE k = 6 AND form <> 1
    UNION ALL SELECT 'set_' || r_regionkey, 'KIND' || r_regionkey || '::' || m, NULL, 'write' FROM region, (VALUES ('m0'), ('in.deep')) v(m))"""
_CALLS = """calls AS (SELECT fn AS caller, 'pf_' || (p - 1) AS callee FROM f WHERE k = 1 UNION SELECT fn, 'set_' || r FROM f WHERE k = 6
    UNION SELECT 'tab_' || n, 'pf_' || (n + 25) FROM d UNION SELECT 'tab_' || n, 'pf_' || (n + 50) FROM d)"""
_REACH = """thr AS (SELECT 'th_' || n AS thread_id, 'tab_' || n AS entry, n % 10 = 0 AS irq FROM d WHERE n % 5 = 0),
    reach(fn, thread_id, irq) AS (SELECT entry, thread_id, irq FROM thr UNION SELECT callee, thread_id, irq FROM reach JOIN calls ON caller = fn)"""


def _files(t) -> DataFrame:
    r, n, p = F.col("r_regionkey"), F.col("n_nationkey"), F.col("p_partkey")
    head = '#include "types.h"\n'
    block = _s("typedef struct tagInner", r, " {\n    int deep;\n    long wide[3];\n} INNER", r, ";\ntypedef struct tagKind", r, " {\n    int m0, m1[4];\n    unsigned bits : 3;\n    struct tagKind", r, " *next;\n    INNER", r, " in;\n} KIND", r, ";")
    types = t.table("region").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", block.alias("x")))), lambda x: x["x"]), "\n").alias("text")).select(F.lit("rig/types.h").alias("path"), "text")
    form = n % 3
    first = F.when(form == 0, ".").when(form == 1, "[0].").otherwise("->")
    device = _s("KIND", F.col("n_regionkey"), F.when(form == 2, " *").otherwise(" "), "dev_", n, F.when(form == 1, "[2]").otherwise(""), ";")
    macro = F.when(form != 1, _s("#define DEV_", n, "_M dev_", n, first, "m0\n#define PUT_", n, "(v) dev_", n, first, "m1[0] = (v)\n")).otherwise(_s("#define ODD_", n, " dev_", n, "[0].m0\n"))
    nations = t.table("nation").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", c.alias("x")))), lambda x: x["x"]), end).alias(name) for name, c, end in (("d", device, "\n"), ("m", macro, ""))])
    devices = nations.select(F.lit("rig/devices.c").alias("path"), _s(head, F.col("d")).alias("text")).unionByName(nations.select(F.lit("rig/macros.h").alias("path"), F.col("m").alias("text")))
    setters = t.table("region").select(_s("rig/set", r, ".c").alias("path"), _s(head, "void set_", r, "(KIND", r, " *p)\n{\n    p->m0 = 7;\n    p->in.deep = 1;\n}\n").alias("text"))
    tables = t.table("nation").select(_s("rig/tab", n, ".c").alias("path"), _s("void tab_", n, "(void)\n{\n    void (*jobs[])(void) = { &pf_", n + 25, ", &pf_", n + 50, " };\n    jobs[1]();\n}\n").alias("text"))
    parts = t.table("part").select("p_partkey", (p % 25).alias("n_nationkey")).join(t.table("nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    o = _s("dev_", n, F.when(form == 0, ".").when(form == 1, _s("[", p % 2, "].")).otherwise("->"))
    reg = F.col("n_regionkey")
    k = p % 8
    does = (
        F.when(k == 0, _s("    ", o, "m0 += 1;"))
        .when(k == 1, _s("    local = ", o, "m0; /* ", o, "m0 = 2; */\n    pf_", p - 1, "();"))
        .when(k == 2, _s("    ", o, "in.deep++;"))
        .when(k == 3, _s("    keep(&", o, "m0);"))
        .when((k == 4) & (form == 0), _s("    KIND", reg, " *own = &dev_", n, ";\n    own->m0 = 2;"))
        .when(k == 4, _s("    local = ", o, "bits;"))
        .when((k == 5) & (form != 1), _s("    DEV_", n, "_M = 3;"))
        .when(k == 5, F.lit("    local = 1;"))
        .when(k == 6, _s("    set_", reg, "(", F.when(form == 0, _s("&dev_", n)).when(form == 1, _s("&dev_", n, "[1]")).otherwise(_s("dev_", n)), ");"))
        .otherwise(_s("#if LEVEL == 2\n    ", o, "m0 = 9;\n#else\n    ", o, "m1[1] = 8;\n#endif"))
    )
    one = _s("void pf_", p, "(void)\n{\n", does, "\n}")
    made = parts.groupBy((p % 64).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", one.alias("x")))), lambda x: x["x"]), "\n").alias("x"))
    return types.unionByName(devices).unionByName(setters).unionByName(tables).unionByName(made.select(_s("rig/f", F.col("g"), ".c").alias("path"), _s(head, '#include "macros.h"\n', F.col("x"), "\n").alias("text")))


def rig(t) -> CodeIndex:
    """The rig's index, stored in the shared folder when it is first asked for."""
    key = t.spark.sparkContext.applicationId, t.dir
    if key not in _built:
        n = F.col("n_nationkey")
        threads = t.table("nation").where(n % 5 == 0).select(_s("th_", n).alias("thread_id"), _s("tab_", n).alias("entry_function"), (n % 10 == 0).alias("is_interrupt_like"))
        _built[key] = CodeIndex.build(_files(t).repartition(16, "path"), threads, {"LEVEL": "2"}, scratch(t.spark, "rig"))
    return _built[key]


# Declarations -------------------------------------------------------------------------------------
@query("rig_types", "SELECT 'KIND' || r_regionkey AS name, 'tagKind' || r_regionkey || ',KIND' || r_regionkey AS aliases, 10 * r_regionkey + 5 AS line FROM region UNION ALL SELECT 'INNER' || r_regionkey, 'tagInner' || r_regionkey || ',INNER' || r_regionkey, 10 * r_regionkey + 1 FROM region")
def _(t):
    return rig(t).struct_type.select("name", F.array_join("aliases", ",").alias("aliases"), "line")


@query("rig_struct_members", """SELECT 'KIND' || r_regionkey AS type_name, m.* FROM region, (VALUES ('m0', 'int', false, 0), ('m1', 'int', true, 0), ('bits', NULL, false, 0)) m(name, member_type, is_array, pointer_level)
UNION ALL SELECT 'KIND' || r_regionkey, 'next', 'tagKind' || r_regionkey, false, 1 FROM region UNION ALL SELECT 'KIND' || r_regionkey, 'in', 'INNER' || r_regionkey, false, 0 FROM region
UNION ALL SELECT 'INNER' || r_regionkey, m.* FROM region, (VALUES ('deep', 'int', false, 0), ('wide', 'long', true, 0)) m(name, member_type, is_array, pointer_level)""")
def _(t):
    return rig(t).struct_member.select("type_name", "name", "member_type", "is_array", "pointer_level")


@query("rig_macros", "SELECT name, replacement, call AS is_function_like FROM (SELECT n_nationkey % 3 AS form, 'dev_' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '.' ELSE '->' END AS o, * FROM nation), LATERAL (SELECT CASE c WHEN 0 THEN 'DEV_' || n_nationkey || '_M' ELSE 'PUT_' || n_nationkey END AS name, CASE c WHEN 0 THEN o || 'm0' ELSE o || 'm1[0] = (v)' END AS replacement, c = 1 AS call FROM range(2) x(c)) WHERE form <> 1 UNION ALL SELECT 'ODD_' || n_nationkey, 'dev_' || n_nationkey || '[0].m0', false FROM nation WHERE n_nationkey % 3 = 1")
def _(t):
    return rig(t).macro_def.select("name", "replacement", "is_function_like")


@query("rig_macro_aliases", f"WITH {_RIG} SELECT 'DEV_' || n || '_M' AS name, o || 'm0' AS target_name, 'member' AS target_kind FROM d WHERE form <> 1 UNION ALL SELECT 'PUT_' || n, o || 'm1[]', 'member' FROM d WHERE form <> 1")
def _(t):
    return rig(t).macro_alias.select("name", "target_name", "target_kind")


@query("rig_globals", f"WITH {_RIG} SELECT dev AS name, 'KIND' || r AS type_name, form = 1 AS is_array, CASE form WHEN 2 THEN 1 ELSE 0 END AS pointer_level, n + 2 AS line FROM d")
def _(t):
    return rig(t).global_var.select("name", "type_name", "is_array", "pointer_level", "line")


@query("rig_member_symbols", f"""WITH {_RIG}, b AS (SELECT o AS base, dev FROM d UNION ALL SELECT dev || '[]->', dev FROM d WHERE form = 2), m AS (SELECT * FROM (VALUES ('m0', 1), ('m1[]', 1), ('bits', 1), ('next', 1), ('in', 1), ('in.deep', 2), ('in.wide[]', 2)) m(name, level))
SELECT dev AS owner, base || m.name AS name, level FROM b, m""")
def _(t):
    return rig(t).member_symbol.select("owner", "name", "level")


@query("rig_functions", f"WITH {_RIG} SELECT fn AS name, 'void ' || fn || '(void)' AS signature, (CASE WHEN k = 7 THEN 8 WHEN k = 1 OR (k = 4 AND form = 0) THEN 5 ELSE 4 END)::BIGINT AS n_lines FROM f UNION ALL SELECT 'set_' || r_regionkey, 'void set_' || r_regionkey || '(KIND' || r_regionkey || ' *p)', 5 FROM region UNION ALL SELECT 'tab_' || n, 'void tab_' || n || '(void)', 5 FROM d")
def _(t):
    return rig(t).function.select("name", "signature", (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("n_lines"))


@query("rig_context_sizes", "SELECT 'globals' AS label, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'functions', (SELECT count(*) FROM part) + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) UNION ALL SELECT 'types', (SELECT 2 * count(*) FROM region) UNION ALL SELECT 'typed globals', (SELECT count(*) FROM nation) UNION ALL SELECT 'aliases', (SELECT 2 * count(*) FROM nation WHERE n_nationkey % 3 <> 1)")
def _(t):
    return rig(t).sizes()


@query("rig_grouped_names", f"WITH {_RIG} SELECT dev AS name, 1::BIGINT AS n, 'KIND' || r || CASE form WHEN 2 THEN ' *' ELSE ' ' END || dev || CASE form WHEN 1 THEN '[2]' ELSE '' END AS declaration FROM d")
def _(t):
    g = impact.by_name_of(rig(t).global_var.select("name", "file", "line", "declaration"), ["file", "line"])
    return g.select("name", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0))["declaration"].alias("declaration"))


# What functions do ------------------------------------------------------------------------------------
@query("rig_accesses", f"WITH {_RIG}, {_ACCESS} SELECT fn AS function_name, variable AS variable_name, target AS target_name, kind FROM acc")
def _(t):
    return rig(t).access.select("function_name", "variable_name", "target_name", "kind")


@query("rig_macro_uses", f"WITH {_RIG} SELECT fn AS function_name, 'DEV_' || n || '_M' AS macros, o || 'm0 = 3;' AS expanded FROM f WHERE k = 5 AND form <> 1")
def _(t):
    return rig(t).access.where("size(macro_names) > 0").select("function_name", F.array_join("macro_names", ",").alias("macros"), F.col("expanded_evidence").alias("expanded"))


@query("rig_argument_aliases", f"WITH {_RIG} SELECT fn AS function_name, CASE form WHEN 0 THEN '&' ELSE '' END || dev AS access_expression, count(*) AS n FROM f, range(2) WHERE k = 6 AND form <> 1 GROUP BY ALL")
def _(t):
    return rig(t).access.where("array_contains(reasons, 'call-argument-alias')").groupBy("function_name", "access_expression").agg(F.count("*").alias("n"))


@query("rig_calls", f"WITH {_RIG}, {_CALLS} SELECT caller, callee FROM calls")
def _(t):
    return rig(t).call_edge


@query("rig_unresolved", f"""WITH {_RIG} SELECT 'address-taken' AS kind, fn AS function_name, o || 'm0' AS variable_name FROM f WHERE k = 3 UNION ALL SELECT 'pointer-write', fn, NULL FROM f WHERE k = 4 AND form = 0
UNION ALL SELECT 'address-taken', fn, dev FROM f WHERE (k = 4 AND form = 0) OR (k = 6 AND form <> 2) UNION ALL SELECT 'unknown-member-access', 'set_' || r_regionkey, 'KIND' || r_regionkey || '::' || m FROM region, (VALUES ('m0'), ('in.deep')) v(m)
UNION ALL SELECT 'macro', NULL, NULL FROM d WHERE form <> 1""")
def _(t):
    return rig(t).unresolved.select("kind", "function_name", "variable_name")


@query("rig_unresolved_by_file", "SELECT 'rig/macros.h' AS file, count(*) AS n, 0::BIGINT AS size, 0::DOUBLE AS mtime_ms FROM nation WHERE n_nationkey % 3 <> 1")
def _(t):
    none = t.spark.createDataFrame([("rig/else.c", 5, 1.0)], "path string, size long, mtime_ms double")
    return store.unresolved_by_file(rig(t).unresolved, none).select("file", F.size("kinds").cast("long").alias("n"), "size", "mtime_ms")


@query("rig_thread_reach", f"WITH RECURSIVE {_RIG}, {_CALLS}, {_REACH} SELECT fn AS function_name, thread_id, irq AS is_interrupt_like FROM reach")
def _(t):
    return rig(t).thread_reach


# Impacts --------------------------------------------------------------------------------------------------
_OF = f"{_RIG}, {_ACCESS}, hit AS (SELECT * FROM acc WHERE variable = 'dev_0.m0'), note AS (SELECT fn FROM f WHERE n = 0 AND k IN (3, 4, 6))"


@query("rig_hydration", f"WITH {_RIG}, {_ACCESS} SELECT DISTINCT fn AS name FROM acc WHERE variable = 'dev_0.m0' OR target = 'dev_0.m0'")
def _(t):
    return rig(t).hydrated(t.spark.createDataFrame([("dev_0.m0",)], "symbol string")).function.select("name")


@query("rig_impact_lookup", "SELECT * FROM (VALUES ('p->m0', 'member', 'KIND0::m0'), ('dev_0.m0', 'member', 'dev_0.m0'), ('DEV_0_M', 'macro', 'DEV_0_M'), ('pf_1', 'function', 'pf_1'), ('dev_3', 'global', 'dev_3'), ('q.m9', 'unknown', 'q.m9')) v(symbol, kind, holds)")
def _(t):
    rows = []
    for symbol, holds in (("p->m0", "KIND0::m0"), ("dev_0.m0", "dev_0.m0"), ("DEV_0_M", "DEV_0_M"), ("pf_1", "pf_1"), ("dev_3", "dev_3"), ("q.m9", "q.m9")):
        i = rig(t).impact(symbol, 1)
        rows += [(symbol, i.kind, r["symbol"]) for r in i.lookup.where(F.col("symbol") == holds).collect()]
    return t.spark.createDataFrame(rows, "symbol string, kind string, holds string")


@query("rig_typed_selection", f"WITH {_RIG}, {_ACCESS} SELECT DISTINCT variable AS symbol FROM acc WHERE target LIKE '%::in.deep' UNION SELECT 'p->in.deep' UNION SELECT DISTINCT 'KIND' || r || '::in.deep' FROM d")
def _(t):
    return rig(t).impact("p->in.deep").lookup


@query("rig_impact_nodes", f"""WITH RECURSIVE {_OF}, {_CALLS}, {_REACH} SELECT 'target' AS id, 'dev_0.m0' AS label, 'target' AS kind UNION SELECT 'function:' || fn, fn, 'function' FROM hit UNION SELECT 'member:dev_0.m0:rig/types.h:' || (10 * r + 5), 'int m0, m1[4]', 'member' FROM d WHERE n = 0
UNION SELECT 'thread:' || thread_id, thread_id, 'thread' FROM reach WHERE fn IN (SELECT fn FROM hit)""")
def _(t):
    return rig(t).impact("dev_0.m0").nodes().where("kind NOT IN ('risk', 'unresolved')")


@query("rig_impact_edges", f"""WITH RECURSIVE {_OF}, {_CALLS}, {_REACH}, e AS (SELECT 'target' AS src, 'function:' || fn AS dst, 'access' AS label FROM (SELECT DISTINCT fn FROM hit) UNION ALL SELECT 'function:' || fn, 'target', kind FROM hit
UNION ALL SELECT 'target', 'member:dev_0.m0:rig/types.h:' || (10 * r + 5), 'decl' FROM d WHERE n = 0 UNION ALL SELECT 'thread:' || thread_id, 'function:' || fn, 'reaches' FROM reach WHERE fn IN (SELECT fn FROM hit)) SELECT src, dst, label, count(*) AS n FROM e GROUP BY ALL""")
def _(t):
    e = rig(t).impact("dev_0.m0").edges().where("label NOT IN ('high', 'warning', 'info', 'needs-review')")
    return e.groupBy("src", "dst", "label").agg(F.count("*").alias("n"))


@query("rig_call_neighbours", f"WITH {_RIG}, {_CALLS}, e AS (SELECT * FROM calls WHERE caller = 'pf_25' OR callee = 'pf_25') SELECT 'function:' || caller AS src, 'function:' || callee AS dst FROM e")
def _(t):
    return rig(t).impact("pf_25", 1).edges().where("label = 'calls'").select("src", "dst")


@query("rig_evidence", f"""WITH {_OF}, x AS (SELECT 'UNRESOLVED_ACCESS' AS code, fn, kind <> 'unknown' AS later FROM hit WHERE kind = 'unknown' UNION SELECT 'UNRESOLVED_ACCESS', fn, true FROM note WHERE fn NOT IN (SELECT fn FROM hit WHERE kind = 'unknown') UNION SELECT 'POINTER_ALIAS', fn, false FROM note)
SELECT code, rank, fn FROM (SELECT code, fn, row_number() OVER (PARTITION BY code ORDER BY later, fn) AS rank FROM x) WHERE rank <= 12""")
def _(t):
    i = rig(t).impact("dev_0.m0")
    f = i.functions.select("name", F.col("file").alias("_f"), "start_line", "end_line")
    e = i.evidence(report.EVIDENCE).where("code IN ('UNRESOLVED_ACCESS', 'POINTER_ALIAS')")
    return e.join(f, (F.col("file") == F.col("_f")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("code", F.col("rank").cast("long").alias("rank"), F.col("name").alias("fn"))


@query("rig_report_lines", f"WITH {_OF} SELECT 'Accesses' AS title, count(*) AS n FROM hit UNION ALL SELECT 'Declarations', 1 UNION ALL SELECT 'Unresolved evidence', count(*) FROM note")
def _(t):
    lines = report.lines(rig(t).impact("dev_0.m0"))
    return lines.where("title IN ('Accesses', 'Declarations', 'Unresolved evidence')").groupBy("title").agg(F.count("*").alias("n"))


@query("rig_report_metrics", f"WITH {_OF} SELECT 'declarations' AS label, 1::BIGINT AS n UNION ALL SELECT 'accesses', count(*) FROM hit UNION ALL SELECT 'unresolved', count(*) FROM note")
def _(t):
    return report.metrics(rig(t).impact("dev_0.m0")).where("label <> 'risks'")


# The scanner's parts ---------------------------------------------------------------------------------------
@query("masked_lines", "SELECT p_partkey, (CASE p_partkey % 5 WHEN 0 THEN 'a = ' || repeat(' ', length(p_name) + 2) || '; ' || repeat(' ', 5) WHEN 1 THEN 'b ' || repeat(' ', length(p_name) + 4) || ' c' WHEN 2 THEN 'd ' || repeat(' ', length(p_name) + 2) || chr(10) || repeat(' ', 4) || ' e' WHEN 3 THEN repeat(' ', 4) || ' f ' || repeat(' ', 4) ELSE 'x = y / z;' END) AS masked FROM part")
def _(t):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    text = F.when(k == 0, _s('a = "', name, '"; // "x')).when(k == 1, _s("b /*", name, "*/ c")).when(k == 2, _s("d /*", name, "\n; */ e")).when(k == 3, F.lit("'\\'' f \"//\"")).otherwise("x = y / z;")
    return each(t.table("part").select("p_partkey", text), lambda p, x: [(p, "\n".join(lexer.mask(lexer.split_lines(x))))], "p_partkey long, masked string")


@query("active_lines", "SELECT p_partkey, CASE WHEN p_size = 10 OR p_partkey % 7 = 0 THEN 'one' WHEN p_size <> 20 AND NOT (p_size = 30 AND p_partkey % 2 = 0) THEN 'two' ELSE 'three' END || CASE WHEN p_partkey % 7 = 0 THEN ',gone' ELSE '' END AS active FROM part")
def _(t):
    p, size = F.col("p_partkey"), F.col("p_size")
    text = _s("#define SIZE ", size, "\n", F.when(p % 7 == 0, "#define BIG\n").otherwise(""), "#if SIZE == 0xA || defined(BIG)\none\n#elif (SIZE != 20) && !(SIZE == 30 && EVEN)\ntwo\n#else\nthree\n#endif\n#ifndef BIG\n#if 1\n#endif\n#else\n#undef SIZE\n#ifndef SIZE\ngone\n#endif\n#endif")

    def kept(key, even, x):
        raw = lexer.split_lines(x)
        return [(key, ",".join(y.strip() for y in preprocess.active_lines(raw, lexer.mask(raw), {"EVEN": str(even)}) if y.strip() and not y.startswith("#")))]

    return each(t.table("part").select("p_partkey", (p % 2 == 0).cast("int"), text), kept, "p_partkey long, active string")


@query("skipped_globals", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'u' || p_partkey WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'b' || p_partkey WHEN 4 THEN NULL ELSE 'q' || p_partkey END AS name FROM part")
def _(t):
    p, k = F.col("p_partkey"), F.col("p_partkey") % 6
    text = F.when(k == 0, _s("union U u", p, ";")).when(k == 1, _s("structure_t s", p, ";")).when(k == 2, _s("int f", p, "(int a);")).when(k == 3, _s("int a, b", p, "[4];")).when(k == 4, _s("static enum E e", p, ";")).otherwise(_s("static char *q", p, " = 0;"))
    return each(t.table("part").select("p_partkey", text), lambda key, x: [(key, g["name"]) for g in declarations.globals_([x], [])] or [(key, None)], "p_partkey long, name string")


@query("included_macros", "SELECT 'in_' || n_nationkey AS name FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT 'seen_' || n_nationkey FROM nation WHERE n_regionkey <> 4")
def _(t):
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    headers = t.table("region").where(r != 4).select(_s("inc/d", r, "/config.h").alias("path"), _s("#define MODE ", r, '\n#include "more.h"\n').alias("text"))
    more = t.table("region").select(_s("inc/d", r, "/more.h").alias("path"), _s("#define MORE ", r + 10, "\n").alias("text"))
    reg = F.col("n_regionkey")
    sources = t.table("nation").select(_s("inc/d", reg, "/n", n, ".c").alias("path"), _s('#include "config.h"\n#if defined MODE && MODE == ', reg, "\nint in_", n, ";\n#endif\n#if MORE == ", reg + 10, "\nint seen_", n, ";\n#endif\n").alias("text"))
    none = t.spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    return CodeIndex.build(headers.unionByName(more).unionByName(sources), none).global_var.select("name")


# Projects, thread maps, bytes, logs --------------------------------------------------------------------------
@query("project_parts", """SELECT s_suppkey, 'source' AS part, 'w/p' || s_suppkey || '/src/a' || s_suppkey || '.c' AS value FROM supplier UNION ALL SELECT s_suppkey, 'source', 'w/p' || s_suppkey || '/b c' || s_suppkey || '.CPP' FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey, 'include', 'w/inc' || (s_suppkey % 7) FROM supplier UNION ALL SELECT s_suppkey, 'include', 'w/all' FROM supplier UNION ALL SELECT s_suppkey, 'macro', 'N=' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'macro', 'REL' FROM supplier""")
def _(t):
    s = F.col("s_suppkey")
    text = _s(
        "# ADD CPP -I all /nologo\n", '!IF  "$(CFG)" == "App - Win32 Debug"\n# ADD CPP /I "dbg" /D "_DEBUG"\n!ELSEIF  "$(CFG)" == "App - Win32 Release"\n# ADD CPP /nologo /I ".\\inc', s % 7, '" /D "N=', s, '" /DREL /c\n!ENDIF\n',
        "# Begin Source File\nSOURCE=.\\src\\a", s, '.c\n# ADD CPP /I "inside"\n# End Source File\n# Begin Source File\nSOURCE=".\\b c', s, '.CPP"\n', F.when(s % 3 == 0, "# PROP Exclude_From_Build 1\n").otherwise(""), "# End Source File\n",
        "# Begin Source File\nSOURCE=.\\Debug\\c.c\n# End Source File\n# Begin Source File\nSOURCE=readme.txt\n# End Source File\n",
    )

    def parts(key, x):
        found = project.parse_lines(x.split("\n"), f"w/p{key}", "w", ["**/Debug/**"])
        return [(key, name, v) for name, values in zip(("source", "include", "macro"), found) for v in sorted(values)]

    return each(t.table("supplier").select("s_suppkey", text), parts, "s_suppkey long, part string, value string")


@query("workspace_projects", "SELECT n_nationkey, 'w/' || lower(n_name) || '/' || n_nationkey || '.dsp' AS project FROM nation UNION ALL SELECT n_nationkey, 'w/plain.DSP' FROM nation WHERE n_nationkey % 4 = 0")
def _(t):
    n = F.col("n_nationkey")
    text = _s('Microsoft Developer Studio Workspace File\nProject: "a"=".\\', F.lower("n_name"), "\\", n, '.dsp" - Package Owner=<4>\nproject: "b"=other.txt - Package Owner=<4>\n', F.when(n % 4 == 0, 'Project: "c"=plain.DSP - Package Owner=<4>\n').otherwise(""))
    return each(t.table("nation").select("n_nationkey", text), lambda key, x: [(key, p) for p in project.projects_in(x.split("\n"), "w")], "n_nationkey long, project string")


@query("picked_configurations", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'promo' WHEN p_partkey % 4 = 1 THEN 'A Promo B' WHEN p_partkey % 4 = 2 THEN 'My Release' ELSE 'First' END AS picked FROM part")
def _(t):
    p = F.col("p_partkey")
    names = F.array(F.lit("First"), F.lit("Unreleased"), F.when(p % 4 < 3, F.lit("My Release")), F.when(p % 4 < 2, F.lit("A Promo B")), F.when(p % 4 == 0, F.lit("promo")))
    return each(t.table("part").select("p_partkey", F.array_compact(names)), lambda key, x: [(key, project.pick_configuration(list(x), "PROMO"))], "p_partkey long, picked string")


@query("command_words", "SELECT s_suppkey, 'inc ' || s_suppkey || '|b|c' AS includes, 'X=' || s_suppkey || '|Y' AS defines, 9::BIGINT AS n_words FROM supplier")
def _(t):
    s = F.col("s_suppkey")
    line = _s('cl /nologo /I"inc ', s, '" -i b /Ic /D "X=', s, '" /dY')

    def told(key, x):
        ws = project.words(x)
        return [(key, "|".join(project.switches(ws, "I")), "|".join(project.switches(ws, "D")), len(ws))]

    return each(t.table("supplier").select("s_suppkey", line), told, "s_suppkey long, includes string, defines string, n_words long")


@query("thread_map_rows", "SELECT n_nationkey, 't' || n_nationkey AS thread_id, 'Entry' || n_nationkey AS entry_function, n_nationkey % 2 = 1 AS is_interrupt_like FROM nation UNION ALL SELECT n_nationkey, 'u', 'E', false FROM nation WHERE n_nationkey % 2 = 0")
def _(t):
    n = F.col("n_nationkey")
    odd = _s('{"threads": [{"threadId": "t', n, '", "entryFunction": "Entry', n, '", "isInterruptLike": true}, {"threadId": 5, "entryFunction": "x"}, {"entryFunction": "y"}]}')
    even = _s("threads:\n  - threadId: t", n, "  # one\n    entryFunction: Entry", n, "\n  - threadId: \"u\"\n    entryFunction: E\n    isInterruptLike: false\n  - threadId: v\n")
    return each(t.table("nation").select("n_nationkey", F.when(n % 2 == 1, odd).otherwise(even)), lambda key, x: [(key, r[0], r[1], r[4]) for r in threadmap.parse(x)], "n_nationkey long, thread_id string, entry_function string, is_interrupt_like boolean")


@query("encoding_usage", "SELECT CASE WHEN p_partkey % 4 < 2 THEN 'utf8' ELSE 'cp932' END AS used_encoding, count(*) AS files, count(*) FILTER (p_partkey % 4 = 3) AS lossy, min('f' || p_partkey) FILTER (p_partkey % 4 = 3) AS first_lossy FROM part GROUP BY 1")
def _(t):
    return corpus.encoding_usage(corpus.decoded(_bytes(t)))


def _bytes(t) -> DataFrame:
    """path, content: marked UTF-8, UTF-8, double-byte text, and bytes that are neither."""
    k, text = F.col("p_partkey") % 4, F.hex(F.encode("p_name", "UTF-8"))
    content = F.unhex(F.when(k == 0, F.concat(F.lit("EFBBBF"), text)).when(k == 1, F.concat(text, F.lit("C3A9"))).when(k == 2, F.concat(text, F.lit("8365"))).otherwise(F.concat(text, F.lit("8365FF83"))))
    return t.table("part").select(_s("f", F.col("p_partkey")).alias("path"), content.alias("content"))


@query("decoded_texts", "SELECT 'f' || p_partkey AS path, p_name || CASE p_partkey % 4 WHEN 1 THEN chr(233) WHEN 2 THEN chr(12486) ELSE '' END AS text FROM part WHERE p_partkey % 4 < 3")
def _(t):
    return corpus.decoded(_bytes(t)).where("NOT lossy").select("path", "text")


@query("size_rollup", "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, round(sum(n_chars) / 1048576.0, 1)::DOUBLE AS mib, count(*) >= 1024 AND sum(n_chars) <= 134217728 AND count(*) = count(n_chars) AS in_memory FROM documents GROUP BY source")
def _(t):
    return corpus.volume(t.table("documents").select("source", F.col("n_chars").cast("long").alias("size")), "source")


@query("progress_culprits", """WITH e AS (SELECT user_id AS log, event_id AS n, 'p' || (event_id % 2) AS phase, 'f' || (event_id % 5) AS file, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'end' WHEN 'error' THEN 'error' ELSE 'note' END AS event FROM events),
o AS (SELECT log, 2 AS r, n, file FROM e WHERE event = 'start' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.log = e.log AND x.phase = e.phase AND x.file = e.file AND x.n > e.n AND x.event IN ('end', 'error', 'done')) UNION ALL SELECT log, 1, n, file FROM e WHERE event = 'error' UNION ALL SELECT log, 0, n, file FROM e)
SELECT log, arg_max(file, r * 1000000000000 + n) AS file FROM o GROUP BY log""")
def _(t):
    e, n = t.table("events"), F.col("event_id")
    event = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "end").when(F.col("event_type") == "error", "error").otherwise("note")
    return store.culprits(e.select(F.col("user_id").alias("log"), n.alias("n"), _s("p", n % 2).alias("phase"), event.alias("event"), _s("f", n % 5).alias("file")))


@query("remaining_files", "SELECT DISTINCT 'f' || o_custkey AS path FROM orders WHERE o_custkey % 3 <> 0")
def _(t):
    files = t.table("orders").select(_s("f", F.col("o_custkey")).alias("path")).distinct()
    return store.remaining(files, t.table("customer").where(F.col("c_custkey") % 3 == 0).select(_s("f", F.col("c_custkey")).alias("path")))


@query("update_reasons", "SELECT * FROM (VALUES ('none', 'previous-index-missing', 0), ('sources', 'project-source-list-changed', 0), ('dialect', 'parser-engine-changed', 0), ('same', NULL, 0)) v(step, reason, changed) UNION ALL SELECT 'changed', 'native-update-rebuild', count(*) FROM supplier WHERE s_suppkey % 7 = 0")
def _(t):
    sig = t.table("supplier").select(_s("f", F.col("s_suppkey")).alias("path"), F.col("s_suppkey").cast("long").alias("size"), F.lit(1.0).alias("mtime_ms"))
    newer = sig.withColumn("mtime_ms", F.when(F.col("size") % 7 == 0, 9.0).otherwise(F.col("mtime_ms") + 1))
    steps = [("none", store.decide(None, sig, "a", "a")), ("sources", store.decide(sig, sig.where("size > 3"), "a", "a")), ("dialect", store.decide(sig, sig, "a", "b")), ("same", store.decide(sig, sig, "a", "a")), ("changed", store.decide(sig, newer, "a", "a"))]
    return t.spark.createDataFrame([(s, d.reason, d.changed) for s, d in steps], "step string, reason string, changed long")


@query("source_set_equal", "SELECT NOT EXISTS (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) AND NOT EXISTS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) AS same, true AS self")
def _(t):
    a, b = t.table("orders").select(F.col("o_custkey").alias("path")), t.table("customer").select(F.col("c_custkey").alias("path"))
    return t.spark.createDataFrame([(store.same_sources(a, b), store.same_sources(b, b.union(b)))], "same boolean, self boolean")


@query("ring_reach", "SELECT 'ring_' || c_custkey AS function_name, 'main' AS thread_id FROM customer")
def _(t):
    n = t.table("customer").count()
    files = samples.ring(t.table("customer").select(F.col("c_custkey").alias("i")), n)
    threads = t.spark.createDataFrame([("main", "ring_3", False)], "thread_id string, entry_function string, is_interrupt_like boolean")
    return CodeIndex.build(files.repartition(16, "path"), threads).thread_reach.select("function_name", "thread_id")


@query("long_chain_reach", "SELECT 'n' || o_orderkey AS function_name FROM orders WHERE o_orderkey >= 5")
def _(t):
    k = F.col("o_orderkey")
    edges = t.table("orders").select(_s("n", k).alias("caller"), _s("n", k + 1).alias("callee")).join(t.table("orders").select(_s("n", k).alias("callee")), "callee", "left_semi").select("caller", "callee")
    threads = t.spark.createDataFrame([("main", "n5", False)], "thread_id string, entry_function string, is_interrupt_like boolean")
    return graph.reachability(threads, edges).select("function_name")


@query("text_identifiers", "SELECT page_id, len(ids) AS n, list_extract(ids, 1) AS first_identifier FROM (SELECT page_id, list_distinct(ids) AS u, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids FROM (SELECT page_id, list_filter(regexp_extract_all(html, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_]')) AS ids FROM pages))")
def _(t):
    ids = fx.identifiers(F.col("html"))
    return t.table("pages").select("page_id", F.size(ids).cast("long").alias("n"), F.get(ids, F.lit(0)).alias("first_identifier"))
