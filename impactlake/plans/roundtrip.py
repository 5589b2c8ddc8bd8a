"""Round trips: C text rendered from orders and lineitem, scanned back, against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .contract import query
from .index import SCAN_BYTES, CodeIndex
from .lifts import Lift

#: Orders, and parts, of a file: 2 to this power. Larger tables render to more files, not to larger ones.
FILE_BITS = 9


def _file(folder: str, key: str) -> F.Column:
    return F.concat(F.lit(f"src/{folder}"), F.coalesce(F.shiftright(key, FILE_BITS).cast("string"), F.lit("none")), F.lit(".c")).alias("path")


def render(t: Lift) -> DataFrame:
    """path, text: one function for each order with one statement a line item, and the globals of the parts; a file holds what stands in one range of keys.

    R lines write (g += n;), A lines read (local = g;), other lines take the address. Each function calls the customer's next order.
    """
    from pyspark.sql import Window

    g = F.concat(F.lit("g_"), F.col("l_partkey").cast("string"))
    form = (
        F.when(F.col("l_returnflag") == "R", F.concat(g, F.lit(" += "), F.col("l_linenumber").cast("string"), F.lit("; /* g_0 = 1; */")))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("local = "), g, F.lit("; // "), g, F.lit("++;")))
        .otherwise(F.concat(F.lit("keep(&"), g, F.lit(");")))
    )
    body = t.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("    "), form))), "\n").alias("body"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = t.table("orders").select("o_orderkey", "o_custkey", F.lead("o_orderkey").over(w).alias("next"))
    call = F.when(F.col("next").isNotNull(), F.concat(F.lit("    fn_"), F.col("next").cast("string"), F.lit("();\n"))).otherwise(F.lit(""))
    fn = F.concat(F.lit("void fn_"), F.col("o_orderkey").cast("string"), F.lit("(void)\n{\n    int local;\n"), F.coalesce("body", F.lit("")), F.lit("\n"), call, F.lit("}\n"))
    made = orders.join(body, orders["o_orderkey"] == body["l_orderkey"], "left").select(_file("f", "o_orderkey"), "o_orderkey", fn.alias("fn"))
    files = made.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "fn"))).alias("x")).select("path", F.array_join(F.transform("x", lambda x: x["fn"]), "\n").alias("text"))
    names = t.table("part").select(_file("globals", "p_partkey"), F.concat(F.lit("int g_"), F.col("p_partkey").cast("string"), F.lit(" = 0;")).alias("d"))
    return files.unionByName(names.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("d")), "\n").alias("text")))


def _table(t: Lift, name: str) -> DataFrame:
    """One table of the index of all that is rendered."""
    none = t.spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    return CodeIndex.build(cut(render(t), group_bytes=SCAN_BYTES), none, only=name).tables[name]


_KIND = "CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read' ELSE 'unknown' END"


@query("roundtrip_globals", "SELECT 'g_' || p_partkey AS name, 'int' AS type_name, 0 AS pointer_level FROM part")
def _(t):
    return _table(t, "global_var").select("name", "type_name", "pointer_level")


@query("roundtrip_accesses", f"SELECT DISTINCT 'fn_' || l_orderkey AS function_name, 'g_' || l_partkey AS variable_name, {_KIND} AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey")
def _(t):
    return _table(t, "access").select("function_name", "variable_name", "kind").distinct()


@query("roundtrip_calls", "SELECT 'fn_' || o_orderkey AS caller, 'fn_' || nxt AS callee FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL")
def _(t):
    return _table(t, "call_edge")


@query("roundtrip_functions", "SELECT 'fn_' || o_orderkey AS name, 'void fn_' || o_orderkey || '(void)' AS signature, count(l_orderkey) + 5 + (CASE WHEN any_value(nxt) IS NULL THEN 0 ELSE 1 END) + (CASE WHEN count(l_orderkey) = 0 THEN 1 ELSE 0 END) AS n_lines FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey".replace("count(l_orderkey) + 5", "count(l_orderkey) + 4"))
def _(t):
    f = _table(t, "function")
    return f.select("name", "signature", (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("n_lines"))


@query("roundtrip_address_notes", "SELECT 'fn_' || l_orderkey AS function_name, 'g_' || l_partkey AS variable_name, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag NOT IN ('R', 'A') GROUP BY ALL")
def _(t):
    u = _table(t, "unresolved").where("kind = 'address-taken'")
    return u.groupBy("function_name", "variable_name").agg(F.count("*").alias("n"))
