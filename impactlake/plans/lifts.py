"""The driver's relational tables seen as index tables, on the Spark side (DataFrames) and the SQL side (CTEs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: DuckDB CTEs of the same lifts.
SQL = {
    "access": """access AS (SELECT 'fn_' || l_orderkey AS function_name, l_linenumber AS seq, 'g_' || l_partkey AS variable_name,
        CASE WHEN l_linenumber % 3 = 0 THEN 's_' || l_suppkey END AS target_name, 'global' AS target_kind,
        CASE l_returnflag WHEN 'R' THEN 'write' WHEN 'A' THEN 'read' ELSE 'unknown' END AS kind, 'f' || (l_orderkey % 97) || '.c' AS file, l_linenumber AS line,
        'g_' || l_partkey || '[ ' || l_linenumber || ' ] . v' AS access_expression, CASE WHEN l_linestatus = 'O' THEN 'M_' || l_suppkey END AS macro_name FROM lineitem)""",
    "function": "function AS (SELECT 'fn_' || o_orderkey AS name, 'f' || (o_orderkey % 97) || '.c' AS file, (o_orderkey % 50) * 20 AS start_line, (o_orderkey % 50) * 20 + 9 AS end_line, o_orderkey AS ordinal FROM orders)",
    "thread": "thread AS (SELECT 'th_' || n_nationkey AS thread_id, 'nation_' || n_nationkey AS entry_function, n_regionkey = 0 AS is_interrupt_like FROM nation WHERE n_regionkey <> 4)",
    "call_edge": """call_edge AS (SELECT 'nation_' || c_nationkey AS caller, 'cust_' || c_custkey AS callee FROM customer
        UNION ALL SELECT 'cust_' || o_custkey, 'fn_' || o_orderkey FROM orders)""",
    "thread_reach": """thread_reach AS (SELECT entry_function AS function_name, thread_id, is_interrupt_like FROM thread
        UNION SELECT callee, thread_id, is_interrupt_like FROM thread JOIN call_edge ON caller = entry_function
        UNION SELECT e2.callee, thread_id, is_interrupt_like FROM thread JOIN call_edge e1 ON e1.caller = entry_function JOIN call_edge e2 ON e2.caller = e1.callee)""",
    "unresolved": """unresolved AS (SELECT CASE event_type WHEN 'error' THEN 'address-taken' WHEN 'click' THEN 'function-pointer' WHEN 'view' THEN 'pointer-write' ELSE 'macro' END AS kind,
        'fn_' || user_id AS function_name, CASE WHEN event_id % 4 <> 0 THEN 'g_' || (event_id % 150 + 1) END AS variable_name,
        'f' || (user_id % 97) || '.c' AS file, event_id % 60 AS line, event_id AS seq FROM events)""",
    "event_edge": """event_edge AS (SELECT DISTINCT event_type AS caller, nxt AS callee FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL)""",
}


def with_ctes(*names: str, rest: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(SQL.get(n, n) for n in names) + " " + rest


class Lift:
    """The lifted tables of one directory; each property is a lazy DataFrame that reads only the columns it needs."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def access(self) -> DataFrame:
        key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        return self.table("lineitem").select(
            key("fn_", "l_orderkey").alias("function_name"),
            F.col("l_linenumber").alias("seq"),
            key("g_", "l_partkey").alias("variable_name"),
            F.when(F.col("l_linenumber") % 3 == 0, key("s_", "l_suppkey")).alias("target_name"),
            F.lit("global").alias("target_kind"),
            F.when(F.col("l_returnflag") == "R", "write").when(F.col("l_returnflag") == "A", "read").otherwise("unknown").alias("kind"),
            F.concat(F.lit("f"), (F.col("l_orderkey") % 97).cast("string"), F.lit(".c")).alias("file"),
            F.col("l_linenumber").alias("line"),
            F.concat(key("g_", "l_partkey"), F.lit("[ "), F.col("l_linenumber").cast("string"), F.lit(" ] . v")).alias("access_expression"),
            F.array().cast("array<string>").alias("reasons"),
            F.when(F.col("l_linestatus") == "O", F.array(key("M_", "l_suppkey"))).otherwise(F.array().cast("array<string>")).alias("macro_names"),
        )

    @property
    def function(self) -> DataFrame:
        start = (F.col("o_orderkey") % 50) * 20
        return self.table("orders").select(F.concat(F.lit("fn_"), "o_orderkey").alias("name"), F.concat(F.lit("f"), (F.col("o_orderkey") % 97).cast("string"), F.lit(".c")).alias("file"), start.alias("start_line"), (start + 9).alias("end_line"), F.col("o_orderkey").alias("ordinal"))

    @property
    def thread(self) -> DataFrame:
        n = self.table("nation").where("n_regionkey <> 4")
        return n.select(F.concat(F.lit("th_"), "n_nationkey").alias("thread_id"), F.concat(F.lit("nation_"), "n_nationkey").alias("entry_function"), (F.col("n_regionkey") == 0).alias("is_interrupt_like"))

    @property
    def call_edge(self) -> DataFrame:
        c = self.table("customer").select(F.concat(F.lit("nation_"), "c_nationkey").alias("caller"), F.concat(F.lit("cust_"), "c_custkey").alias("callee"))
        o = self.table("orders").select(F.concat(F.lit("cust_"), "o_custkey").alias("caller"), F.concat(F.lit("fn_"), "o_orderkey").alias("callee"))
        return c.unionByName(o)

    @property
    def thread_reach(self) -> DataFrame:
        from .graph import reachability

        return reachability(self.thread, self.call_edge)

    @property
    def unresolved(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "error", "address-taken").when(F.col("event_type") == "click", "function-pointer").when(F.col("event_type") == "view", "pointer-write").otherwise("macro")
        return self.table("events").select(
            kind.alias("kind"),
            F.concat(F.lit("fn_"), "user_id").alias("function_name"),
            F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("g_"), (F.col("event_id") % 150 + 1).cast("string"))).alias("variable_name"),
            F.concat(F.lit("f"), (F.col("user_id") % 97).cast("string"), F.lit(".c")).alias("file"),
            (F.col("event_id") % 60).alias("line"),
            F.col("event_id").alias("seq"),
        )

    @property
    def event_edge(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee")).where("callee IS NOT NULL").distinct()
