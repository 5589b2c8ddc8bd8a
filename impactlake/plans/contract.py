"""The impact engine's operators as queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from . import graph, impact
from .lifts import Lift, with_ctes

QUERIES: dict = {}
ORACLE_SQL: dict = {}
DEPTH = 4


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(Lift(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# Aggregations and inverted indexes -----------------------------------------------------------------
@query("access_kind_counts", with_ctes("access", rest="SELECT variable_name, kind, count(*) AS n FROM access GROUP BY variable_name, kind"))
def _(t):
    return t.access.groupBy("variable_name", "kind").agg(F.count("*").alias("n"))


_KEYS = """keys AS (SELECT function_name, variable_name AS symbol, 'variable' AS key_kind FROM access UNION ALL SELECT function_name, target_name, 'target' FROM access
    UNION ALL SELECT function_name, regexp_replace(regexp_replace(access_expression, '\\s+', '', 'g'), '\\[[^\\]]+\\]', '[]', 'g'), 'expression' FROM access UNION ALL SELECT function_name, macro_name, 'macro' FROM access)"""


@query("access_inverted_index", with_ctes("access", _KEYS, rest="SELECT DISTINCT symbol, function_name FROM keys WHERE symbol IS NOT NULL"))
def _(t):
    return impact.inverted_index(t.access)


@query("access_key_kinds", with_ctes("access", _KEYS, rest="SELECT key_kind, count(*) AS n, count(DISTINCT symbol) AS symbols FROM keys WHERE symbol IS NOT NULL GROUP BY key_kind"))
def _(t):
    return impact.access_keys(t.access).groupBy("key_kind").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"))


@query("callers_inverted", with_ctes("call_edge", rest="SELECT callee AS function_name, string_agg(DISTINCT caller, ',' ORDER BY caller) AS callers FROM call_edge GROUP BY callee"))
def _(t):
    return impact.called_by(t.call_edge).select("function_name", F.array_join("callers", ",").alias("callers"))


@query("callees_normalised", with_ctes("call_edge", rest="SELECT caller, count(DISTINCT callee) AS n, min(callee) AS first_callee, max(callee) AS last_callee FROM call_edge GROUP BY caller"))
def _(t):
    g = impact.calls_of(t.call_edge)
    return g.select(F.col("function_name").alias("caller"), F.size("callees").cast("long").alias("n"), F.get("callees", F.lit(0)).alias("first_callee"), F.element_at("callees", -1).alias("last_callee"))


@query("functions_last_wins", "SELECT 'fn_' || o_custkey AS name, max(o_orderkey) AS ordinal, arg_max('f' || (o_orderkey % 97) || '.c', o_orderkey) AS file FROM orders GROUP BY o_custkey")
def _(t):
    f = t.table("orders").select(F.concat(F.lit("fn_"), "o_custkey").alias("name"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("f"), (F.col("o_orderkey") % 97).cast("string"), F.lit(".c")).alias("file"))
    return impact.keep_last(f, ["name"], ["ordinal"])


@query("types_first_wins", "SELECT p_brand AS alias, arg_min(p_name, p_partkey) AS type_name, min(p_partkey) AS ordinal FROM part GROUP BY p_brand")
def _(t):
    p = t.table("part")
    return impact.keep_first(p.select(F.col("p_brand").alias("alias"), F.col("p_name").alias("type_name"), F.col("p_partkey").alias("ordinal")), ["alias"], ["ordinal"])


@query("global_types_first_wins", "SELECT 'g_' || p_size AS name, arg_min(p_type, p_partkey) AS type_name FROM part GROUP BY p_size")
def _(t):
    p = t.table("part").select(F.concat(F.lit("g_"), F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("type_name"), "p_partkey")
    return impact.keep_first(p, ["name"], ["p_partkey"]).drop("p_partkey")


def _(t):
    lossy = F.col("n_chars") % 7 == 0
    return t.table("documents").groupBy(F.col("lang").alias("used_encoding")).agg(F.count("*").alias("files"), F.count_if(lossy).alias("lossy"), F.min(F.when(lossy, F.col("doc_id"))).alias("first_lossy"))


def _(t):
    g = t.table("documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    return g.select("source", "files", "bytes", fx.mebibytes(F.col("bytes")).alias("mib"), ((F.col("files") >= 1024) & (F.col("bytes") <= 134217728)).alias("in_memory"))


def _(t):
    a = t.access.agg(F.countDistinct("variable_name").alias("globals"), F.count("*").alias("accesses"))
    return a.crossJoin(t.function.agg(F.count("*").alias("functions"))).crossJoin(t.unresolved.agg(F.count("*").alias("unresolved")))


# Joins ------------------------------------------------------------------------------------------------
@query("functions_touching_symbol", with_ctes("access", "function", rest="SELECT name, file FROM function WHERE EXISTS (SELECT 1 FROM access WHERE function_name = name AND (variable_name IN ('g_1', 'g_2', 'g_3') OR target_name IN ('g_1', 'g_2', 'g_3')))"))
def _(t):
    symbols = t.spark.createDataFrame([("g_1",), ("g_2",), ("g_3",)], "symbol string")
    hits = impact.touching(t.access, symbols).select(F.col("function_name").alias("name")).distinct()
    return t.function.select("name", "file").join(hits, "name", "left_semi")


@query("functions_touching_macro", with_ctes("access", "function", rest="SELECT name FROM function WHERE EXISTS (SELECT 1 FROM access WHERE function_name = name AND (macro_name = 'M_1' OR variable_name = 'g_1' OR target_name = 's_1'))"))
def _(t):
    wanted = t.spark.createDataFrame([("macro", "M_1"), ("variable", "g_1"), ("target", "s_1")], "key_kind string, symbol string")
    hits = impact.access_keys(t.access).join(wanted, ["key_kind", "symbol"]).select(F.col("function_name").alias("name")).distinct()
    return t.function.select("name").join(hits, "name", "left_semi")


def _(t):
    f = t.function.select(F.col("name").alias("callee"), fx.simple_name(F.col("name")).alias("simple"), "file")
    e = t.call_edge.select("caller", fx.simple_name(F.col("callee")).alias("simple"))
    return e.join(f, "simple").where("caller <> callee").select("caller", "callee", "file")


def _(t):
    calls = t.table("orders").select("o_orderkey", F.concat(F.lit("fn_"), "o_orderkey").alias("caller"))
    args = t.table("lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("parameter"))
    templates = t.table("part").select("p_partkey", "p_brand")
    j = calls.join(args, calls["o_orderkey"] == args["l_orderkey"]).join(templates, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("caller", "parameter", F.concat(F.lit("g_"), F.col("l_partkey").cast("string"), F.lit("."), "p_brand").alias("target")).agg(F.count("*").alias("n"))


@query("thread_contexts", with_ctes("thread", "call_edge", "thread_reach", "function", rest="SELECT name, thread_id, is_interrupt_like FROM function JOIN thread_reach ON function_name = name"))
def _(t):
    return t.function.select("name").join(t.thread_reach.withColumnRenamed("function_name", "name"), "name")


@query("access_threads", with_ctes("access", "thread", "call_edge", "thread_reach", rest="SELECT coalesce(thread_id, '<unclassified>') AS thread_id, kind, count(*) AS n FROM access LEFT JOIN thread_reach USING (function_name) GROUP BY ALL"))
def _(t):
    return impact.with_threads(t.access, t.thread_reach).groupBy("thread_id", "kind").agg(F.count("*").alias("n"))


@query("changed_files", """WITH c AS (SELECT 'f' || o_orderkey AS path, o_custkey AS size, o_totalprice AS mtime FROM orders WHERE o_orderkey % 10 <> 0),
p AS (SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 13 = 0 THEN o_totalprice + 5 ELSE o_totalprice END AS mtime FROM orders WHERE o_orderkey % 9 <> 0)
SELECT * FROM (SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN c.size <> p.size OR abs(c.mtime - p.mtime) >= 2 THEN 'changed' END AS status FROM c FULL JOIN p ON c.path = p.path) WHERE status IS NOT NULL""")
def _(t):
    o = t.table("orders").select("o_orderkey", F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_custkey").alias("size"), F.col("o_totalprice").alias("mtime_ms"))
    k = F.col("o_orderkey")
    now = o.where(k % 10 != 0).drop("o_orderkey")
    old = o.where(k % 9 != 0).withColumn("size", F.when(k % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("mtime_ms", F.when(k % 11 == 0, F.col("mtime_ms") + 1).when(k % 13 == 0, F.col("mtime_ms") + 5).otherwise(F.col("mtime_ms"))).drop("o_orderkey")
    return impact.changed(now, old)


def _(t):
    a, b = t.table("orders").select(F.col("o_custkey").alias("k")), t.table("customer").select(F.col("c_custkey").alias("k"))
    return a.subtract(b).agg(F.count("*").alias("missing")).crossJoin(b.subtract(a).agg(F.count("*").alias("unused")))


@query("globals_outside_functions", with_ctes("function", """g AS (SELECT 'g_' || l_partkey || '_' || l_orderkey || '_' || l_linenumber AS name, 'f' || (l_suppkey % 97) || '.c' AS file, (l_partkey * 7 + l_linenumber) % 1000 AS line FROM lineitem)""", rest="SELECT name, file, line FROM g WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT file, start_line, end_line FROM function) f WHERE f.file = g.file AND line BETWEEN start_line AND end_line)"))
def _(t):
    g = t.table("lineitem").select(F.concat_ws("_", F.lit("g"), "l_partkey", "l_orderkey", "l_linenumber").alias("name"), F.concat(F.lit("f"), (F.col("l_suppkey") % 97).cast("string"), F.lit(".c")).alias("file"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 1000).alias("line"))
    return impact.outside_ranges(g, t.function.select("file", "start_line", "end_line").distinct()).select("name", "file", "line")


# Rules --------------------------------------------------------------------------------------------------
_RISK = """sym AS (SELECT DISTINCT variable_name AS symbol, 'global' AS symbol_kind FROM access UNION SELECT DISTINCT target_name, 'member' FROM access WHERE target_name IS NOT NULL),
hit AS (SELECT variable_name AS symbol, * FROM access UNION ALL SELECT target_name, * FROM access WHERE target_name IS NOT NULL),
ctx AS (SELECT h.symbol, h.kind, coalesce(thread_id, '<unclassified>') AS thread_id, coalesce(is_interrupt_like, false) AS irq FROM hit h LEFT JOIN thread_reach USING (function_name)),
thr AS (SELECT symbol, count(DISTINCT thread_id) FILTER (kind = 'write') AS w, count(DISTINCT thread_id) FILTER (kind = 'read') AS r, count(DISTINCT thread_id) FILTER (kind IN ('read', 'write')) AS e, bool_or(irq) AS irq FROM ctx GROUP BY symbol),
acc AS (SELECT symbol, count(*) AS n, count(*) FILTER (kind = 'unknown') AS u FROM hit GROUP BY symbol),
unr AS (SELECT s.symbol, u.kind FROM sym s JOIN unresolved u ON u.variable_name = s.symbol OR (symbol_kind IN ('global', 'member') AND u.variable_name IS NULL)),
un AS (SELECT symbol, count(*) AS n, count(*) FILTER (kind = 'address-taken') AS a, count(*) FILTER (kind = 'function-pointer') AS f FROM unr GROUP BY symbol),
j AS (SELECT s.symbol, s.symbol_kind, coalesce(acc.n, 0) AS n, coalesce(acc.u, 0) AS u, coalesce(w, 0) AS w, coalesce(r, 0) AS r, coalesce(e, 0) AS e, coalesce(irq, false) AS irq, coalesce(un.n, 0) AS un, coalesce(a, 0) AS a, coalesce(f, 0) AS f
      FROM sym s LEFT JOIN acc USING (symbol) LEFT JOIN thr USING (symbol) LEFT JOIN un USING (symbol)),
risk AS (SELECT symbol, 'MULTI_THREAD_WRITE' AS code, 'high' AS severity, n AS n_accesses FROM j WHERE w >= 2
  UNION ALL SELECT symbol, 'CROSS_THREAD_READ_WRITE', 'warning', n FROM j WHERE w > 0 AND r > 0 AND e >= 2 UNION ALL SELECT symbol, 'INTERRUPT_CONTEXT', 'high', n FROM j WHERE irq AND n > 0
  UNION ALL SELECT symbol, 'UNRESOLVED_ACCESS', 'warning', n FROM j WHERE u > 0 OR un > 0 UNION ALL SELECT symbol, 'POINTER_ALIAS', 'warning', n FROM j WHERE a > 0 UNION ALL SELECT symbol, 'FUNCTION_POINTER', 'info', n FROM j WHERE f > 0)"""


def _symbols(t):
    a = t.access
    s = a.select(F.col("variable_name").alias("symbol"), F.lit("global").alias("symbol_kind")).distinct()
    return s.unionByName(a.where("target_name IS NOT NULL").select(F.col("target_name").alias("symbol"), F.lit("member").alias("symbol_kind")).distinct())


def _risks(t):
    symbols = graph.cut(_symbols(t))
    hits = impact.matching(t.access, symbols)
    named = t.unresolved.where("variable_name IS NOT NULL").select(F.col("variable_name").alias("symbol"), "kind")
    # Rows that name nothing bear on every symbol: their few kinds are joined, not the rows.
    nameless = t.unresolved.where("variable_name IS NULL").select("kind").groupBy("kind").count()
    notes = named.join(symbols.select("symbol"), "symbol", "left_semi").unionByName(symbols.select("symbol").crossJoin(nameless.select("kind")))
    return impact.risks(symbols, hits, t.thread_reach, notes)


@query("risk_all", with_ctes("access", "thread", "call_edge", "thread_reach", "unresolved", _RISK, rest="SELECT symbol, code, severity, n_accesses FROM risk"))
def risk_all(t):
    return _risks(t).select("symbol", "code", "severity", "n_accesses")


def _one_rule(code: str):
    @query(f"risk_{code.lower()}", with_ctes("access", "thread", "call_edge", "thread_reach", "unresolved", _RISK, rest=f"SELECT symbol, severity, n_accesses FROM risk WHERE code = '{code}'"))
    def _(t):
        return _risks(t).where(F.col("code") == code).select("symbol", "severity", "n_accesses")


for _code, _ in impact.RULES:
    _one_rule(_code)


@query("unresolved_relevance", with_ctes("unresolved", """s AS (SELECT 'g_' || i AS symbol, 'global' AS symbol_kind, NULL AS parent FROM range(1, 6) r(i) UNION ALL SELECT 'g_' || i || '.v', 'member', 'g_' || i FROM range(1, 6) r(i) UNION ALL SELECT 'g_7', 'macro', NULL)""", rest="SELECT symbol, kind, function_name, variable_name, file, line, seq FROM s JOIN unresolved u ON u.variable_name = symbol OR (symbol_kind IN ('global', 'member') AND u.variable_name IS NOT DISTINCT FROM parent)"))
def _(t):
    rows = [(f"g_{i}", "global") for i in range(1, 6)] + [(f"g_{i}.v", "member") for i in range(1, 6)] + [("g_7", "macro")]
    s = t.spark.createDataFrame(rows, "symbol string, symbol_kind string")
    return impact.relevant_unresolved(s, t.unresolved).select("symbol", "kind", "function_name", "variable_name", "file", "line", "seq")


@query("topology_filter", with_ctes("unresolved", rest="SELECT function_name, kind, count(*) AS n FROM unresolved WHERE kind IN ('function-pointer', 'unknown-call') GROUP BY ALL"))
def _(t):
    return impact.topology(t.unresolved).groupBy("function_name", "kind").agg(F.count("*").alias("n"))


# Ordered operators --------------------------------------------------------------------------------------
@query("access_dedup_first", with_ctes("access", rest="SELECT variable_name, target_name, kind, file, macro_name, min(function_name) AS function_name, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY function_name, target_kind, coalesce(target_name, variable_name), kind, file, line, access_expression, macro_name ORDER BY seq) AS rn FROM access) WHERE rn = 1 GROUP BY ALL"))
def _(t):
    d = impact.dedup_accesses(t.access).withColumn("macro_name", F.get("macro_names", F.lit(0)))
    return d.groupBy("variable_name", "target_name", "kind", "file", "macro_name").agg(F.min("function_name").alias("function_name"), F.count("*").alias("n"))


@query("unresolved_dedup_first", with_ctes("unresolved", rest="SELECT kind, function_name, variable_name, file, line, min(seq) AS seq FROM unresolved GROUP BY ALL"))
def _(t):
    return impact.dedup_unresolved(t.unresolved, ["seq"]).select("kind", "function_name", "variable_name", "file", "line", "seq")


@query("evidence_topk", with_ctes("access", rest="SELECT variable_name, function_name, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY variable_name ORDER BY function_name, line) AS rank FROM (SELECT DISTINCT variable_name, function_name, line FROM access)) WHERE rank <= 12"))
def _(t):
    return impact.top_evidence(t.access.select("variable_name", "function_name", "line"), ["variable_name"], ["function_name", "line"], ["function_name", "line"], 12).withColumn("rank", F.col("rank").cast("long"))


def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.table("events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("current_source"))


def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return t.table("events").select("event_id", F.sum(delta).over(w).alias("depth"))


def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    g = F.coalesce(F.sum((F.col("event_type") == "error").cast("int")).over(w), F.lit(0)).cast("long")
    rows = t.table("events").withColumn("g", g).groupBy("user_id", "g").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return rows.select("user_id", "g", F.array_join(F.transform("x", lambda x: x["event_type"]), "|").alias("text"))


def _(t):
    low = F.lower("p_type")
    rank = F.when(low == "promo", 0).when(F.contains(low, F.lit("promo")), 1).when(F.col("p_type").rlike(r"\bRelease\b"), 2).otherwise(3)
    return t.table("part").groupBy("p_brand").agg(F.min_by("p_type", F.struct(rank.alias("r"), "p_partkey")).alias("picked"))


def _(t):
    e = t.table("events")
    starts = e.where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("at"))
    ends = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("done"))
    return starts.join(ends, "user_id", "left").where("done IS NULL OR at > done").groupBy("user_id").agg(F.max("at").alias("culprit"))


# Graphs ---------------------------------------------------------------------------------------------------
def _neighborhood_sql(a: str, b: str, seeds: str) -> str:
    return with_ctes("call_edge", f"""w(seed, name, depth) AS (SELECT name, name, 0 FROM ({seeds}) UNION SELECT seed, {b}, depth + 1 FROM w JOIN call_edge ON {a} = name WHERE depth < {DEPTH})""", rest="SELECT seed, name, min(depth) AS depth FROM w GROUP BY seed, name", recursive=True)


@query("neighborhood_forward_d4", _neighborhood_sql("caller", "callee", "SELECT entry_function AS name FROM (SELECT 'nation_' || n_nationkey AS entry_function FROM nation)"))
def _(t):
    seeds = t.table("nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("name"))
    return graph.neighborhood(t.call_edge, seeds, DEPTH)[0]


@query("neighborhood_backward_d4", _neighborhood_sql("callee", "caller", "SELECT 'fn_' || o_orderkey AS name FROM orders"))
def _(t):
    return graph.neighborhood(t.call_edge, t.function.select("name"), DEPTH, reverse=True)[0]


@query("neighborhood_edges_d1", with_ctes("call_edge", rest="SELECT DISTINCT caller AS seed, caller, callee FROM call_edge WHERE caller LIKE 'nation_%'"))
def _(t):
    seeds = t.table("nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("name"))
    return graph.neighborhood(t.call_edge, seeds, 1)[1]


def _neighborhood_edges_sql(a: str, b: str, seeds: str) -> str:
    walk = f"w(seed, name, depth) AS (SELECT name, name, 0 FROM ({seeds}) UNION SELECT seed, {b}, depth + 1 FROM w JOIN call_edge ON {a} = name WHERE depth < {DEPTH})"
    return with_ctes("call_edge", walk, rest=f"SELECT DISTINCT seed, {a}, {b} FROM w JOIN call_edge ON {a} = name WHERE depth < {DEPTH}", recursive=True)


@query("neighborhood_edges_forward_d4", _neighborhood_edges_sql("caller", "callee", "SELECT 'nation_' || n_nationkey AS name FROM nation"))
def _(t):
    seeds = t.table("nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("name"))
    return graph.neighborhood(t.call_edge, seeds, DEPTH)[1]


@query("neighborhood_edges_backward_d4", _neighborhood_edges_sql("callee", "caller", "SELECT 'fn_' || o_orderkey AS name FROM orders"))
def _(t):
    return graph.neighborhood(t.call_edge, t.function.select("name"), DEPTH, reverse=True)[1]


@query("thread_reach_closure", with_ctes("thread", "call_edge", "r(function_name, thread_id, is_interrupt_like) AS (SELECT entry_function, thread_id, is_interrupt_like FROM thread UNION SELECT callee, thread_id, is_interrupt_like FROM r JOIN call_edge ON caller = function_name)", rest="SELECT * FROM r", recursive=True))
def _(t):
    return t.thread_reach


@query("cyclic_reach_closure", with_ctes("event_edge", "r(function_name, thread_id) AS (SELECT event_type, event_type FROM (SELECT DISTINCT event_type FROM events) UNION SELECT callee, thread_id FROM r JOIN event_edge ON caller = function_name)", rest="SELECT * FROM r", recursive=True))
def _(t):
    starts = t.table("events").select(F.col("event_type").alias("entry_function"), F.col("event_type").alias("thread_id"), F.lit(False).alias("is_interrupt_like")).distinct()
    return graph.reachability(starts, t.event_edge).drop("is_interrupt_like")


def _(t):
    a = t.access.where("variable_name = 'g_1'")
    return _nodes(t, a)


@query("symbol_kinds", with_ctes("access", "function", "s AS (SELECT DISTINCT variable_name AS symbol FROM access UNION SELECT DISTINCT target_name FROM access WHERE target_name IS NOT NULL UNION SELECT 'M_' || s_suppkey FROM supplier UNION SELECT name FROM function UNION SELECT 'nothing')", rest="SELECT symbol, CASE WHEN symbol LIKE 'g\\_%' ESCAPE '\\' THEN 'global' WHEN symbol LIKE 's\\_%' ESCAPE '\\' THEN 'member' WHEN symbol LIKE 'M\\_%' ESCAPE '\\' THEN 'macro' WHEN symbol LIKE 'fn\\_%' ESCAPE '\\' THEN 'function' ELSE 'unknown' END AS symbol_kind FROM s"))
def _(t):
    a = t.access
    g = a.select(F.col("variable_name").alias("name"))
    m = a.where("target_name IS NOT NULL").select(F.col("target_name").alias("name"))
    k = t.table("supplier").select(F.concat(F.lit("M_"), F.col("s_suppkey").cast("string")).alias("name"))
    f = t.function.select("name")
    nothing = t.spark.createDataFrame([("nothing",)], "name string")
    symbols = g.union(m).union(k).union(f).union(nothing).withColumnRenamed("name", "symbol")
    return impact.symbol_kind(symbols, g, m, k, f)


@query("member_symbol_expansion", """WITH g AS (SELECT 'g_' || r_name AS owner, r_regionkey FROM region), n AS (SELECT n_regionkey, n_name, n_nationkey, n_nationkey % 3 = 0 AS arr, n_nationkey % 5 = 0 AS ptr FROM nation),
l1 AS (SELECT owner, owner || CASE WHEN r_regionkey % 2 = 1 THEN '->' ELSE '.' END || n_name || CASE WHEN arr THEN '[]' ELSE '' END AS name, n_name AS member_name, n_nationkey, ptr FROM g JOIN n ON n_regionkey = r_regionkey
       UNION ALL SELECT owner, owner || '[]->' || n_name || CASE WHEN arr THEN '[]' ELSE '' END, n_name, n_nationkey, ptr FROM g JOIN n ON n_regionkey = r_regionkey WHERE r_regionkey % 2 = 1)
SELECT owner, name, member_name, 1 AS level FROM l1 UNION ALL SELECT owner, name || '.' || c_name, c_name, 2 FROM l1 JOIN customer ON c_nationkey = n_nationkey WHERE NOT ptr""")
def _(t):
    key = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    g = t.table("region").select(F.concat(F.lit("g_"), "r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("type_name"), (F.col("r_regionkey") % 2).alias("pointer_level"), F.lit(False).alias("is_array"))
    n = t.table("nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("type_name"), F.col("n_name").alias("name"), key("n_nationkey").alias("member_type"), (F.col("n_nationkey") % 3 == 0).alias("is_array"), F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(0).alias("pointer_level"))
    c = t.table("customer").select(key("c_nationkey").alias("type_name"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("member_type"), F.lit(False).alias("is_array"), F.lit(0).alias("pointer_level"))
    return impact.member_expansion(g, n.unionByName(c))


_TYPED = """t AS (SELECT 'T_' || (l_suppkey % 20) || '::a.v' || l_linenumber AS typed, 'p' || l_partkey || ' [ ' || l_linenumber || ' ]->a . v' || l_linenumber AS said, 'g_' || l_suppkey || '.a.v' || l_linenumber AS actual, l_suppkey, l_linestatus FROM lineitem),
s AS (SELECT DISTINCT 'p' || p_partkey || '[]->a.v' || i AS symbol, 'a.v' || i AS path FROM part, range(1, 4) r(i) WHERE p_partkey < 60)"""


@query("typed_member_inference", f"""WITH {_TYPED}, f AS (SELECT DISTINCT symbol, typed AS name FROM s JOIN t ON split_part(typed, '::', 2) = path AND contains(regexp_replace(regexp_replace(said, '\\s+', '', 'g'), '\\[[^\\]]+\\]', '[]', 'g'), symbol) WHERE l_linestatus = 'O')
SELECT symbol, name, 'typed' AS part FROM f UNION ALL SELECT DISTINCT symbol, actual, 'actual' FROM f JOIN t ON typed = name WHERE l_linestatus <> 'O' AND l_suppkey % 2 = 0""")
def _(t):
    li, s = t.table("lineitem"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    n, own = F.col("l_linenumber"), F.col("l_suppkey")
    typed, actual = s("T_", own % 20, "::a.v", n), s("g_", own, ".a.v", n)
    open_ = F.col("l_linestatus") == "O"
    access = li.select(F.when(open_, typed).otherwise(actual).alias("variable_name"), F.when(~open_, typed).alias("target_name"), s("p", F.col("l_partkey"), " [ ", n, " ]->a . v", n).alias("access_expression"), F.lit("").alias("evidence"))
    members = li.where(own % 2 == 0).select(actual.alias("name")).distinct()
    symbols = t.table("part").where("p_partkey < 60").select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"), "p_partkey").select(s("p", F.col("p_partkey"), "[]->a.v", F.col("i")).alias("symbol"))
    none = t.spark.createDataFrame([], "name string")
    notes = t.spark.createDataFrame([], "kind string, variable_name string, evidence string")
    of_type, found = impact.inferred_members(symbols, access, notes, none, members, none)
    return of_type.withColumn("part", F.lit("typed")).unionByName(found.withColumn("part", F.lit("actual")))


# Text -----------------------------------------------------------------------------------------------------
_LINES = "l AS (SELECT doc_id, unnest(CASE WHEN t = '' THEN []::VARCHAR[] WHEN ends_with(t, chr(10)) THEN s[:len(s) - 1] ELSE s END) AS line FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS s FROM documents))"


def _doc_lines(t):
    return t.table("documents").select("doc_id", F.explode(fx.lines(F.col("text"))).alias("line"))


@query("text_lines", f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM l GROUP BY doc_id")
def _(t):
    return _doc_lines(t).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))


def _(t):
    plain = F.regexp_replace(F.regexp_replace("html", "([^A-Za-z0-9_])", " "), "[0-9][A-Za-z0-9_]*", "0")
    ids = F.array_distinct(F.regexp_extract_all(plain, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return t.table("pages").select("page_id", F.size(ids).cast("long").alias("n"), F.get(ids, F.lit(0)).alias("first_identifier"))


@query("text_brace_balance", "SELECT page_id, (length(html) - length(replace(html, '{', '')))::BIGINT - (length(html) - length(replace(html, '}', ''))) AS balance FROM pages")
def _(t):
    return t.table("pages").select("page_id", fx.brace_balance(F.col("html")).alias("balance"))


@query("text_index_normalize", with_ctes("access", rest="SELECT access_expression, regexp_replace(regexp_replace(access_expression, '\\s+', '', 'g'), '\\[[^\\]]+\\]', '[]', 'g') AS normal, count(*) AS n FROM access GROUP BY ALL"))
def _(t):
    return t.access.groupBy("access_expression", fx.normalize_index(F.col("access_expression")).alias("normal")).agg(F.count("*").alias("n"))


@query("text_member_path", """WITH x AS (SELECT p_partkey, p_type || '::' || p_brand || '.v' AS a, 'g' || p_size || '->' || p_brand || '.v[1]' AS b, 'g' || p_size AS c FROM part)
SELECT p_partkey, split_part(a, '::', 2) AS typed, regexp_extract(b, '^[^-.]*(?:->|\\.)(.*)$', 1) AS pointed, NULL::VARCHAR AS plain, split_part(b, '.', 1) AS parent, NULL::VARCHAR AS no_parent FROM x""")
def _(t):
    a, b, c = F.concat("p_type", F.lit("::"), "p_brand", F.lit(".v")), F.concat(F.lit("g"), F.col("p_size").cast("string"), F.lit("->"), "p_brand", F.lit(".v[1]")), F.concat(F.lit("g"), F.col("p_size").cast("string"))
    return t.table("part").select("p_partkey", fx.member_path(a).alias("typed"), fx.member_path(b).alias("pointed"), fx.member_path(c).alias("plain"), fx.direct_parent(b).alias("parent"), fx.direct_parent(c).alias("no_parent"))


@query("text_directives", "SELECT word, count(*) AS n FROM (SELECT regexp_extract(line, '^\\s*#\\s*([a-z]+)', 1) AS word FROM (SELECT '# ' || lower(p_type) AS line FROM part UNION ALL SELECT p_name FROM part)) WHERE word <> '' GROUP BY word")
def _(t):
    p = t.table("part")
    x = p.select(F.concat(F.lit("# "), F.lower("p_type")).alias("line")).union(p.select("p_name"))
    return x.select(fx.directive(F.col("line")).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))


@query("text_word_match", "SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS has_word FROM documents")
def _(t):
    return t.table("documents").select("doc_id", fx.contains_word(F.col("text"), "the").alias("has_word"))


@query("text_word_replace", "SELECT p_partkey, trim(replace(replace(' ' || replace(p_name, ' ', '  ') || ' ', ' part ', ' G '), '  ', ' ')) AS renamed FROM part")
def _(t):
    return t.table("part").select("p_partkey", fx.replace_word(F.col("p_name"), "part", "G").alias("renamed"))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages")
def _(t):
    return t.table("pages").select("page_id", F.md5(F.encode(fx.escape_html(F.col("html")), "UTF-8")).alias("escaped"))


@query("exclude_filter", "SELECT url FROM pages WHERE NOT contains(lower(url), 'blog') AND NOT contains(lower(url), '/fr/')".replace("'/fr/'", "'fr'"))
def _(t):
    return t.table("pages").where(~fx.excluded(F.col("url"), ["**/Blog/**", "**/fr/**"])).select("url")


@query("extension_filter", "SELECT count(*) AS n FROM (SELECT p_name || CASE p_size % 4 WHEN 0 THEN '.CPP' WHEN 1 THEN '.h' WHEN 2 THEN '.txt' ELSE '' END AS path, p_size FROM part) WHERE p_size % 4 IN (0, 1)")
def _(t):
    m = F.col("p_size") % 4
    path = F.concat("p_name", F.when(m == 0, ".CPP").when(m == 1, ".h").when(m == 2, ".txt").otherwise(""))
    return t.table("part").where(fx.is_source(path)).agg(F.count("*").alias("n"))


@query("number_formats", "SELECT o_orderkey, format('{:,}', o_orderkey) AS grouped, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.1f', ms / 1000.0) || 's' END AS duration FROM (SELECT o_orderkey, (o_orderkey % 200) * 100 + 13 AS ms FROM orders)")
def _(t):
    return t.table("orders").select("o_orderkey", fx.grouped_digits(F.col("o_orderkey")).alias("grouped"), fx.duration((F.col("o_orderkey") % 200) * 100 + 13).alias("duration"))


from . import rig, roundtrip  # noqa: E402, F401  register their queries
