"""Impact questions as DataFrame plans over the index tables.

Tables: access(function_name, seq, variable_name, target_name, target_kind, kind, file, line, evidence, reasons, access_expression,
macro_names), call_edge(caller, callee), thread_reach(function_name, thread_id, is_interrupt_like), unresolved(kind, function_name,
variable_name, file, line, evidence). Every plan answers for all symbols of a table of symbols at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import direct_parent, member_path, normalize_index

UNCLASSIFIED = "<unclassified>"
#: Rule codes and severities, in order.
RULES = (
    ("MULTI_THREAD_WRITE", "high"),
    ("CROSS_THREAD_READ_WRITE", "warning"),
    ("INTERRUPT_CONTEXT", "high"),
    ("UNRESOLVED_ACCESS", "warning"),
    ("POINTER_ALIAS", "warning"),
    ("FUNCTION_POINTER", "info"),
)
TOPOLOGY = ("function-pointer", "unknown-call")


def access_keys(access: DataFrame) -> DataFrame:
    """function_name, symbol, key_kind: every symbol by which an access can be found."""
    keys = F.array(
        F.struct(F.lit("variable").alias("key_kind"), F.col("variable_name").alias("symbol")),
        F.struct(F.lit("target").alias("key_kind"), F.col("target_name").alias("symbol")),
        F.struct(F.lit("expression").alias("key_kind"), normalize_index(F.col("access_expression")).alias("symbol")),
    )
    macros = F.transform(F.coalesce("macro_names", F.array().cast("array<string>")), lambda m: F.struct(F.lit("macro").alias("key_kind"), m.alias("symbol")))
    return access.select("function_name", F.explode(F.concat(keys, macros)).alias("k")).select("function_name", "k.symbol", "k.key_kind").where("symbol IS NOT NULL AND symbol <> ''")


def inverted_index(access: DataFrame) -> DataFrame:
    return access_keys(access).select("symbol", "function_name").distinct()


def called_by(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("callee").alias("function_name")).agg(F.sort_array(F.collect_set("caller")).alias("callers"))


def calls_of(edges: DataFrame) -> DataFrame:
    """function_name, callees: each function's distinct callees in order."""
    return edges.groupBy(F.col("caller").alias("function_name")).agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def by_name_of(df: DataFrame, order: list[str]) -> DataFrame:
    """name, rows: all rows of a name in one array, in order; for reading a few, as a much-declared name makes a long array."""
    rest = [c for c in df.columns if c != "name"]
    keyed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy("name").agg(F.sort_array(F.collect_list(keyed)).alias("rows"))


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key (null keys are equal), in the given order."""
    return _ranked(df, keys, order)


def keep_last(df: DataFrame, keys: list, order: list) -> DataFrame:
    return _ranked(df, keys, [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])


def _ranked(df: DataFrame, keys: list, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dedup_accesses(access: DataFrame) -> DataFrame:
    """First of the accesses of a function that agree in target, kind, place, expression, reasons and macros."""
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ",")
    return keep_first(access, ["function_name", "target_kind", F.coalesce("target_name", "variable_name"), "kind", "file", "line", "access_expression", join(F.col("reasons")), join(F.col("macro_names"))], ["seq"])


def dedup_unresolved(unresolved: DataFrame, order: list) -> DataFrame:
    return keep_first(unresolved, ["kind", "function_name", "variable_name", "file", "line"], order)


def matching(access: DataFrame, symbols: DataFrame) -> DataFrame:
    """Accesses whose variable or target is a symbol: symbol, then the access's columns; two semi-joins' worth of equi-joins, no OR."""
    keyed = access.withColumn("symbol", F.explode(F.array_distinct(F.array("variable_name", F.coalesce("target_name", "variable_name")))))
    return keyed.join(symbols.select("symbol").distinct(), "symbol")


#: Symbols that go into a filter, which reaches the files' statistics; more are joined.
MOST_PUSHED = 500


def touching(access: DataFrame, symbols: DataFrame) -> DataFrame:
    """Accesses whose variable or target is one of the symbols, each once. Few symbols become a filter that the scan sees; many a semi-join on exploded keys."""
    few = [r["symbol"] for r in symbols.select("symbol").distinct().limit(MOST_PUSHED + 1).collect()]
    if len(few) <= MOST_PUSHED:
        return access.where(F.col("variable_name").isin(few) | F.col("target_name").isin(few))
    names = symbols.select(F.col("symbol").alias("_s")).distinct()
    by_variable = access.join(names, F.col("variable_name") == F.col("_s"), "left_semi")
    rest = access.join(names, F.col("variable_name") == F.col("_s"), "left_anti")
    return by_variable.unionByName(rest.join(names, F.col("target_name") == F.col("_s"), "left_semi"))


def topology(unresolved: DataFrame) -> DataFrame:
    """Rows that bear on calls."""
    return unresolved.where(F.col("kind").isin(*TOPOLOGY))


def inferred_members(symbols: DataFrame, access: DataFrame, unresolved: DataFrame, globals_: DataFrame, members: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, name) of the typed members that selections mean (p->x: T::x), and of the actual members that stand for these (g.x).

    A selection that is no declared data means the typed names whose member path is its own and whose text, white space and indexes aside,
    holds it; accesses and undecided member accesses both tell. A typed name means itself. The path is an equi-join; the text is looked at only there.
    """
    data = globals_.select("name").union(members.select("name")).union(aliases.select("name")).withColumnRenamed("name", "symbol")
    asked = symbols.select("symbol").distinct()
    own = asked.where(F.contains("symbol", F.lit("::"))).select("symbol", F.col("symbol").alias("name"))
    bare = asked.where(~F.contains("symbol", F.lit("::"))).join(data, "symbol", "left_anti").withColumn("needle", normalize_index(F.col("symbol")))
    bare = bare.withColumn("path", member_path(F.col("needle"))).where("path IS NOT NULL")
    typed = F.contains("variable_name", F.lit("::"))
    seen = access.where(typed).select("variable_name", F.coalesce("access_expression", "evidence").alias("said"))
    seen = seen.unionByName(unresolved.where((F.col("kind") == "unknown-member-access") & typed).select("variable_name", F.col("evidence").alias("said")))
    seen = seen.distinct().select(F.col("variable_name").alias("name"), member_path(normalize_index(F.col("variable_name"))).alias("path"), normalize_index(F.col("said")).alias("said"))
    found = bare.join(seen, "path").where(F.contains("said", F.col("needle"))).select("symbol", "name")
    of_type = own.unionByName(found).distinct()
    actual = access.where("target_name IS NOT NULL").select(F.col("target_name").alias("name"), F.col("variable_name").alias("_v")).distinct().join(of_type, "name").select("symbol", F.col("_v").alias("name")).distinct()
    return of_type, actual.join(members.select("name"), "name", "left_semi").select("symbol", "name")


def symbol_kind(symbols: DataFrame, globals_: DataFrame, members: DataFrame, macros: DataFrame, functions: DataFrame) -> DataFrame:
    """symbol, symbol_kind: global before member before macro before function, else unknown."""
    ranked = None
    for rank, (df, kind) in enumerate(((globals_, "global"), (members, "member"), (macros, "macro"), (functions, "function"))):
        part = df.select(F.col("name").alias("symbol"), F.lit(rank).alias("r"), F.lit(kind).alias("k")).distinct()
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("symbol").agg(F.min_by("k", "r").alias("symbol_kind"))
    return symbols.select("symbol").distinct().join(best, "symbol", "left").select("symbol", F.coalesce("symbol_kind", F.lit("unknown")).alias("symbol_kind"))


def with_threads(access: DataFrame, reach: DataFrame) -> DataFrame:
    """Accesses with each thread that reaches their function; a function that none reaches has one pseudo-thread."""
    joined = access.join(reach.select("function_name", "thread_id", "is_interrupt_like"), "function_name", "left")
    return joined.withColumn("thread_id", F.coalesce("thread_id", F.lit(UNCLASSIFIED))).withColumn("is_interrupt_like", F.coalesce("is_interrupt_like", F.lit(False)))


def relevant_unresolved(symbols: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Unresolved rows that bear on each symbol (symbol, symbol_kind): those that name it, and for globals and members those
    that name its parent, where a symbol without one matches rows that name nothing."""
    s = symbols.withColumn("parent", direct_parent(F.col("symbol")))
    u = unresolved.withColumn("_v", F.col("variable_name"))
    named = s.join(u, s["symbol"] == u["_v"])
    data = s.where(F.col("symbol_kind").isin("global", "member"))
    by_parent = data.join(u, data["parent"].eqNullSafe(u["_v"]) & ~F.coalesce(data["symbol"] == u["_v"], F.lit(False)))
    return named.unionByName(by_parent).drop("_v", "parent")


def risks(symbols: DataFrame, access: DataFrame, reach: DataFrame, unresolved: DataFrame) -> DataFrame:
    """symbol, code, severity, n_accesses for each rule that applies to a symbol (symbol, symbol_kind).

    unresolved: symbol and kind of the rows that bear on it. One aggregation over accesses and threads, one over unresolved
    rows; both pre-aggregate before their shuffle.
    """
    by_access = access.groupBy("symbol").agg(F.count("*").alias("n_acc"), F.count_if(F.col("kind") == "unknown").alias("n_unknown"))
    t = with_threads(access.select("symbol", "function_name", "kind").distinct(), reach).select("symbol", "kind", "thread_id", "is_interrupt_like").distinct()
    threads = t.groupBy("symbol", "thread_id").agg(F.max(F.col("kind") == "write").alias("w"), F.max(F.col("kind") == "read").alias("r"), F.max("is_interrupt_like").alias("irq"))
    by_thread = threads.groupBy("symbol").agg(
        F.count_if(F.col("w")).alias("writers"), F.count_if(F.col("r")).alias("readers"), F.count_if(F.col("w") | F.col("r")).alias("either"), F.max("irq").alias("irq")
    )
    by_note = unresolved.groupBy("symbol").agg(F.count("*").alias("n_unres"), F.count_if(F.col("kind") == "address-taken").alias("n_addr"), F.count_if(F.col("kind") == "function-pointer").alias("n_fptr"))
    all_in = symbols.select("symbol", "symbol_kind").join(by_access, "symbol", "left").join(by_thread, "symbol", "left").join(by_note, "symbol", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    data = F.col("symbol_kind").isin("global", "member", "macro")
    tests: dict[str, Column] = {
        "MULTI_THREAD_WRITE": data & (n("writers") >= 2),
        "CROSS_THREAD_READ_WRITE": data & (n("writers") > 0) & (n("readers") > 0) & (n("either") >= 2),
        "INTERRUPT_CONTEXT": F.coalesce("irq", F.lit(False)) & (n("n_acc") > 0),
        "UNRESOLVED_ACCESS": (n("n_unknown") > 0) | (n("n_unres") > 0),
        "POINTER_ALIAS": n("n_addr") > 0,
        "FUNCTION_POINTER": n("n_fptr") > 0,
    }
    rows = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(code).alias("code"), F.lit(sev).alias("severity"), tests[code].alias("on")) for i, (code, sev) in enumerate(RULES)])
    return all_in.select("symbol", n("n_acc").cast("long").alias("n_accesses"), F.explode(rows).alias("x")).where("x.on").select("symbol", "x.rank", "x.code", "x.severity", "n_accesses")


def risk_evidence(access: DataFrame, unresolved: DataFrame, most: int) -> DataFrame:
    """symbol, code, rank, file, line: up to `most` places that speak for each rule, whether it applies or not.

    access: symbol, function_name, seq, kind, file, line; unresolved: symbol, kind, function_name, file, line. Writes come before reads, accesses before
    undecided places, and then functions in the order of their names (by the collation of people, not of code points). A place counts once.
    """
    rules = {
        "MULTI_THREAD_WRITE": [(F.col("kind") == "write", 0)],
        "CROSS_THREAD_READ_WRITE": [(F.col("kind") == "write", 0), (F.col("kind") == "read", 1)],
        "INTERRUPT_CONTEXT": [(F.lit(True), 0)],
        "UNRESOLVED_ACCESS": [(F.col("kind") == "unknown", 0)],
    }
    codes = lambda tests: F.explode(F.filter(F.array(*[F.when(t, F.struct(F.lit(code).alias("code"), F.lit(part).alias("part"))) for code, ts in tests.items() for t, part in ts]), lambda x: x.isNotNull())).alias("x")
    noted = {"UNRESOLVED_ACCESS": [(F.lit(True), 1)], "POINTER_ALIAS": [(F.col("kind") == "address-taken", 0)], "FUNCTION_POINTER": [(F.col("kind") == "function-pointer", 0)]}
    a = access.select("symbol", "function_name", "seq", "file", "line", codes(rules))
    u = unresolved.select("symbol", "function_name", F.lit(0).alias("seq"), "file", "line", codes(noted))
    rows = a.unionByName(u).select("symbol", "x.code", "x.part", by_name("function_name").alias("by"), F.col("function_name").alias("fn"), "seq", "file", "line")
    return top_evidence(rows, ["symbol", "code"], ["file", "line"], ["part", "by", "fn", "seq", "file", "line"], most).select("symbol", "code", "rank", "file", "line")


def by_name(column: str) -> Column:
    """A key that sorts names as people do, by the Unicode collation."""
    return F.collate(F.col(column), "UNICODE")


def top_evidence(rows: DataFrame, keys: list, place: list, order: list, most: int) -> DataFrame:
    """The first `most` places of each key, in order, one row a place."""
    once = keep_first(rows, keys + place, order)
    w = Window.partitionBy(*keys).orderBy(*order)
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def member_expansion(globals_: DataFrame, members: DataFrame, levels: int = 3) -> DataFrame:
    """owner, name, member_name, level of every member symbol of typed globals, up to `levels` levels deep.

    globals_: name, type_name, pointer_level, is_array; members: type_name, name, member_type, is_array, pointer_level. Pointer members are listed
    but not entered; arrays get []; the first connector of a pointer global is ->.
    """
    more = [c for c in ("file", "line", "declaration") if c in members.columns]  # carried along
    g = globals_.where("type_name IS NOT NULL")
    plain = g.select(F.col("name").alias("owner"), F.concat("name", F.when(F.col("is_array"), F.lit("[]")).otherwise(F.lit(""))).alias("base"), F.when(F.col("pointer_level") > 0, F.lit("->")).otherwise(F.lit(".")).alias("con"), "type_name")
    indexed = g.where("pointer_level > 0 AND NOT is_array").select(F.col("name").alias("owner"), F.concat("name", F.lit("[]")).alias("base"), F.lit("->").alias("con"), "type_name")
    front, out = plain.unionByName(indexed), None
    m = members.select(F.col("type_name").alias("_t"), F.col("name").alias("member_name"), "member_type", F.col("is_array").alias("_a"), F.col("pointer_level").alias("_p"), *more)
    for level in range(1, levels + 1):
        here = front.join(m, front["type_name"] == m["_t"]).select("owner", F.concat("base", "con", "member_name", F.when(F.col("_a"), F.lit("[]")).otherwise(F.lit(""))).alias("name"), "member_name", "member_type", "_p", F.lit(level).alias("level"), *more)
        part = here.select("owner", "name", "member_name", "level", *more)
        out = part if out is None else out.unionByName(part)
        front = here.where("_p = 0 AND member_type IS NOT NULL").select("owner", F.col("name").alias("base"), F.lit(".").alias("con"), F.col("member_type").alias("type_name"))
    return out


def outside_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points (file, line) that no range (file, start_line, end_line) of their file covers.

    A union in line order and a running maximum of ends: no range join, so a file of many functions stays linear.
    """
    p = points.withColumn("_end", F.lit(None).cast("long")).withColumn("_point", F.lit(True)).withColumn("_line", F.col("line").cast("long"))
    r = ranges.select("file", F.col("start_line").cast("long").alias("_line"), F.col("end_line").cast("long").alias("_end"), F.lit(False).alias("_point"))
    w = Window.partitionBy("file").orderBy("_line", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = p.unionByName(r, allowMissingColumns=True).withColumn("_cover", F.max("_end").over(w))
    return marked.where("_point AND (_cover IS NULL OR _cover < _line)").drop("_end", "_point", "_line", "_cover")


def changed(current: DataFrame, previous: DataFrame, tolerance_ms: float = 2.0) -> DataFrame:
    """path, status (added, changed, removed) between two signature tables (path, size, mtime_ms)."""
    c, p = current.alias("c"), previous.alias("p")
    both = c.join(p, F.col("c.path") == F.col("p.path"), "full")
    status = F.when(F.col("p.path").isNull(), "added").when(F.col("c.path").isNull(), "removed").when((F.col("c.size") != F.col("p.size")) | (F.abs(F.col("c.mtime_ms") - F.col("p.mtime_ms")) >= tolerance_ms), "changed")
    return both.select(F.coalesce("c.path", "p.path").alias("path"), status.alias("status")).where("status IS NOT NULL")
