"""The scanner and the index on a small project of our own."""

import pytest

from impactlake.operators import accesses, declarations, lexer, preprocess
from impactlake.plans.index import CodeIndex

SHARED = """#ifndef SHARED_H
#define SHARED_H
extern volatile int ticks;
extern int level;
typedef struct tagUnit {
    int mode;
    int hits, spare;
    unsigned flags : 3;
} UNIT;
extern UNIT unit;
extern UNIT units[2];
extern UNIT *current;
#define HITS_ALIAS unit.hits
#define MODE_FIELD mode
#define TWICE(x) ((x) * 2)
#define SET_LEVEL(v) level = (v)
#endif
"""
MAIN = """#include "shared.h"
volatile int ticks = 0; /* int hidden; */
int level = 0;
UNIT unit = {0};
UNIT units[2];
UNIT *current;
#if defined(USE_EXTRA) && LIMIT == 3
int extra;
#else
int absent;
#endif

void Common(void)
{
    level = ticks;       // ticks = 9
    unit.mode = ticks;
}

void Touch(UNIT *p)
{
    p->MODE_FIELD = HITS_ALIAS;
}

void Worker(void)
{
    UNIT *own = &unit;
    ticks++;
    own->hits++;
    Touch(&unit);
    Common();
    SET_LEVEL(4);
}

void Irq(void)
{
    level = level == ticks;
    units[0].hits = 0;
    current->mode = 1;
    unit.nothing = 2;
}

void Pointer(void)
{
    int *q = &level;
    *q = 4;
    (*hook)();
}

void Table(void)
{
    void (*jobs[])(void) = { &Common, &Irq };
    jobs[1]();
}
"""


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([("p/shared.h", SHARED, 0), ("p/main.c", MAIN, 1)], "path string, text string, ordinal long")
    threads = spark.createDataFrame([("work", "Worker", False), ("irq", "Irq", True)], "thread_id string, entry_function string, is_interrupt_like boolean")
    return CodeIndex.build(files, threads, {"USE_EXTRA": "", "LIMIT": "3"})


def test_joined_contexts_equal_the_broadcast_one(spark, index):
    files = spark.createDataFrame([("p/shared.h", SHARED, 0), ("p/main.c", MAIN, 1), ("p/bad.c", None, 2)], "path string, text string, ordinal long")
    threads = spark.createDataFrame([("work", "Worker", False), ("irq", "Irq", True)], "thread_id string, entry_function string, is_interrupt_like boolean")
    other = CodeIndex.build(files, threads, {"USE_EXTRA": "", "LIMIT": "3"}, broadcast_bytes=0)
    for name in ("access", "unresolved", "call_edge", "macro_alias", "member_symbol", "global_var", "thread_reach"):
        same = index.tables[name].columns
        assert rows(other.tables[name], *same) == rows(index.tables[name], *same), name


def test_joined_contexts_follow_long_chains_of_macros(spark):
    chain = "".join(f"#define M{k:02} M{k + 1:02}\n" for k in range(1, 12)) + "#define M12 last\n"
    files = spark.createDataFrame([("p/chain.h", chain + "extern int last;\n", 0), ("p/main.c", "void Worker(void)\n{\n M01 = 1;\n}\n", 1)], "path string, text string, ordinal long")
    threads = spark.createDataFrame([("work", "Worker", False)], "thread_id string, entry_function string, is_interrupt_like boolean")
    whole, joined = (CodeIndex.build(files, threads, broadcast_bytes=b) for b in (1 << 20, 0))
    for name in ("access", "macro_alias"):
        same = whole.tables[name].columns
        assert rows(joined.tables[name], *same) == rows(whole.tables[name], *same), name
    assert rows(joined.access, "variable_name", "kind") == [("last", "write")]


def test_alternate_dialect(spark):
    text = "int g;\nint a[4];\nvoid G(void) {}\nvoid F(void)\n{\n if (g == 2) {}\n}\nvoid H(void)\n{\n a[1] = G(F(1));\n k = &g;\n}\n"
    files = spark.createDataFrame([("a.c", text)], "path string, text string")
    threads = spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    got = {d: CodeIndex.build(files, threads, dialect=d) for d in ("primary", "alternate")}
    kinds = {d: rows(i.access, "function_name", "variable_name", "kind") for d, i in got.items()}
    assert kinds["primary"] == [("F", "g", "read"), ("H", "a", "write"), ("H", "g", "unknown")]
    assert kinds["alternate"] == [("F", "g", "write"), ("H", "a", "read"), ("H", "g", "read")]
    assert rows(got["primary"].call_edge, "callee") == [("G",)] and rows(got["alternate"].call_edge, "callee") == [("F",)]
    assert got["alternate"].access.where("target_name <> variable_name OR target_name IS NULL").count() == 0


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_mask_keeps_lengths_and_carries_comments():
    lines = ['a = "x//y"; // c', "/* b", "c */ d", "'\\'' e", "/**/f"]
    masked = lexer.mask(lines)
    assert [len(x) for x in masked] == [len(x) for x in lines]
    assert [x.split() for x in masked] == [["a", "=", ";"], [], ["d"], ["e"], ["f"]]


@pytest.mark.parametrize(("line", "name", "kind"), [("g++;", "g", "write"), ("--g;", "g", "write"), ("g[i + 1] = 2;", "g", "write"), ("g <<= 2;", "g", "write"), ("if (g == 2)", "g", "read"), ("f(&g);", "g", "unknown"), ("a && g", "g", "read"), ("gg = g;", "g", "read")])
def test_classifier(line, name, kind):
    assert lexer.classify(line, name)[0] == kind


def test_members_and_calls():
    found = lexer.members("a.b[2].c = (p + 1)->x + q [ i ] -> y;")
    assert [(m.owner, m.indexed, m.path) for m in found] == [("a", False, ("b[]", "c")), ("p", True, ("x",)), ("q", True, ("y",))]
    assert lexer.calls("f(g(1), a[2, 3]); if (x) h();") == [("f", ("g(1)", "a[2, 3]")), ("h", ())]


@pytest.mark.parametrize(("text", "holds"), [("defined(A) && !defined B", True), ("A == 0x10", True), ("Z", False), ("C", True), ("(A != 16) || C", True), ("VERSION >= 5", False), ("", False)])
def test_conditions(text, holds):
    assert preprocess.evaluate(text, {"A": "16", "C": "text"}) is holds


def test_conditional_stack_and_headers():
    raw = ["#include <h.h>", "#ifdef FROM_H", "one", "#elif 1", "two", "#else", "three", "#endif", "#undef FROM_H", "#ifdef FROM_H", "four", "#endif"]
    header = ["#define FROM_H 1", '#include "h.h"']
    out = preprocess.active_lines(raw, raw, {}, lambda name, quoted, where: (name, header, header))
    assert [x.strip() for x in out if x.strip() and not x.startswith("#")] == ["one"]


def test_declarations(index):
    assert rows(index.global_var.where("NOT is_extern"), "name") == [("current",), ("extra",), ("level",), ("ticks",), ("unit",), ("units",)]
    assert rows(index.struct_member, "type_name", "name") == [("UNIT", "flags"), ("UNIT", "hits"), ("UNIT", "mode"), ("UNIT", "spare")]
    assert [r[0] for r in rows(index.function, "name")] == ["Common", "Irq", "Pointer", "Table", "Touch", "Worker"]
    assert rows(index.macro_alias, "name", "target_name", "target_kind") == [("HITS_ALIAS", "unit.hits", "member"), ("MODE_FIELD", "mode", "unknown"), ("SET_LEVEL", "level", "global")]
    assert ("units[].hits",) in rows(index.member_symbol, "name") and ("current->mode",) in rows(index.member_symbol, "name")
    assert index.skipped_file.count() == 0


def test_calls_and_reachability(index):
    assert rows(index.call_edge, "caller", "callee") == [("Table", "Common"), ("Table", "Irq"), ("Worker", "Common"), ("Worker", "Touch")]
    assert rows(index.thread_reach, "function_name", "thread_id") == [("Common", "work"), ("Irq", "irq"), ("Touch", "work"), ("Worker", "work")]


def test_accesses(index):
    got = rows(index.access, "function_name", "variable_name", "kind")
    for want in [("Common", "level", "write"), ("Common", "ticks", "read"), ("Common", "unit.mode", "write"), ("Touch", "UNIT::mode", "write"), ("Touch", "unit.hits", "read"), ("Worker", "unit.hits", "write"), ("Worker", "unit.MODE_FIELD", "write"), ("Worker", "ticks", "write"), ("Worker", "level", "write"), ("Irq", "units[].hits", "write"), ("Irq", "current->mode", "write"), ("Pointer", "level", "unknown")]:
        assert want in got, want
    notes = rows(index.unresolved, "function_name", "kind", "variable_name")
    for want in [("Irq", "unknown-member-access", "unit.nothing"), ("Pointer", "address-taken", "level"), ("Pointer", "pointer-write", None), ("Pointer", "function-pointer", None), ("Touch", "unknown-member-access", "UNIT::mode"), (None, "macro", None)]:
        assert want in notes, want


def test_impact_of_a_global(index):
    i = index.impact("level")
    assert i.kind == "global"
    assert rows(i.risks, "code") == [("FUNCTION_POINTER",), ("INTERRUPT_CONTEXT",), ("MULTI_THREAD_WRITE",), ("POINTER_ALIAS",), ("UNRESOLVED_ACCESS",)]
    assert {r[0] for r in rows(i.functions, "name")} == {"Common", "Worker", "Irq", "Pointer"}
    assert {r[0] for r in rows(i.nodes(), "kind")} == {"target", "global", "function", "thread", "risk", "unresolved"}
    assert i.edges().where("label = 'decl'").count() == 2


def test_impact_of_macro_function_and_typed_member(index):
    macro = index.impact("HITS_ALIAS")
    assert macro.kind == "macro" and {r[0] for r in rows(macro.accesses, "function_name")} >= {"Touch", "Worker"}
    fn = index.impact("Worker", 1)
    assert fn.kind == "function" and {r[0] for r in rows(fn.functions, "name")} == {"Worker", "Common", "Touch"}
    assert fn.accesses.count() == 0


def test_round_trip_through_parquet(index, tmp_path):
    again = index.save(str(tmp_path / "index"))
    assert rows(again.access, "function_name", "variable_name") == rows(index.access, "function_name", "variable_name")


def test_ambiguous_pointer():
    ctx = accesses.Context({"a", "b"}, {n: {"type_name": "T", "is_array": False, "pointer_level": 0} for n in "ab"}, {"T": {"members": [{"name": "x", "member_type": "int"}]}}, {})
    text = lexer.split_lines("void F(void)\n{\n T *p = &a;\n p->x = 1;\n p = &b;\n p->x = 2;\n}")
    w = accesses.Walk(declarations.functions(text, lexer.mask(text))[0], ctx).run()
    assert [r["variable_name"] for r in w.rows if r["target_kind"] == "member"] == ["a.x"]
    assert [n["kind"] for n in w.notes] == ["pointer-write", "address-taken", "address-taken", "ambiguous-member-alias"]


SELECTED = """typedef struct tagS {
    int x;
    int xy;
} S;
S g;
S *known;
void W1(S *p)
{
    p->x = 1;
}
void W2(S *p)
{
    p->xy = 2;
}
void T1(void)
{
    g.x = 3;
    W1(&g);
}
void T2(void)
{
    g.xy = 4;
    W1(&g);
    W2(&g);
}
"""


def test_typed_member_selection(spark):
    files = spark.createDataFrame([("s.c", SELECTED)], "path string, text string")
    threads = spark.createDataFrame([("a", "T1", False), ("b", "T2", False)], "thread_id string, entry_function string, is_interrupt_like boolean")
    index = CodeIndex.build(files, threads)
    i = index.impact("p->x")
    assert {r[0] for r in i.lookup.collect()} == {"p->x", "S::x", "g.x"}
    assert i.kind == "member" and ("MULTI_THREAD_WRITE",) in rows(i.risks, "code")
    assert {r["variable_name"] for r in i.accesses.collect()} == {"S::x", "g.x"}
    assert {r[0] for r in index.impact("g.x").lookup.collect()} == {"g.x"}
    assert {r[0] for r in index.impact("S::xy").lookup.collect()} == {"S::xy", "g.xy"}
    assert index.impact("q.unheard").kind == "unknown"


def test_evidence_of_each_risk(spark):
    text = "int g;\nvoid B(void)\n{\n g = 1;\n}\nvoid a(void)\n{\n use(g);\n}\nvoid C(void)\n{\n keep(&g);\n}\n"
    files = spark.createDataFrame([("e.c", text)], "path string, text string")
    threads = spark.createDataFrame([("t", "B", False), ("u", "a", True)], "thread_id string, entry_function string, is_interrupt_like boolean")
    i = CodeIndex.build(files, threads).impact("g")
    places = {}
    for r in i.evidence(12).orderBy("code", "rank").collect():
        places.setdefault(r["code"], []).append(r["line"])
    assert places == {"CROSS_THREAD_READ_WRITE": [4, 8], "INTERRUPT_CONTEXT": [8, 4, 12], "POINTER_ALIAS": [12], "UNRESOLVED_ACCESS": [12]}
    assert [r["line"] for r in i.evidence(1).where("code = 'INTERRUPT_CONTEXT'").collect()] == [8]


@pytest.mark.parametrize(("text", "names"), [("union U u;", ["u"]), ("structure_t s;", []), ("int a, b[2];", ["b"]), ("int c; ; int d;", ["c", "d"]), ("int x = f(1);", []), ("enum E e; returned r;", []), ("static char *p = 0;", ["p"])])
def test_globals_passed_over(text, names):
    assert [g["name"] for g in declarations.globals_([text], [])] == names


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_includes_go_by_folder_and_path(spark, broadcast_bytes):
    body = '#include "config.h"\n#if MODE == {0}\nint in_{1};\n#endif\n'
    files = [("a/config.h", "#define MODE 1\n"), ("b/config.h", "#define MODE 2\n"), ("inc/config.h", '#include "deep/more.h"\n'), ("inc/deep/more.h", "#define MODE 3\n")]
    files += [("a/x.c", body.format(1, "a")), ("b/x.c", body.format(2, "b")), ("c/x.c", body.format(3, "c")), ("d/x.c", "#include <config.h>\n#ifdef MODE\nint in_d;\n#endif\n"), ("e/x.c", '#include "nowhere.h"\n#ifndef MODE\nint in_e;\n#endif\n')]
    df = spark.createDataFrame(files, "path string, text string")
    threads = spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    index = CodeIndex.build(df, threads, broadcast_bytes=broadcast_bytes, include_paths=("inc",))
    assert rows(index.global_var, "name") == [("in_a",), ("in_b",), ("in_c",), ("in_d",), ("in_e",)]
    assert rows(CodeIndex.build(df, threads, broadcast_bytes=broadcast_bytes).global_var, "name") == [("in_a",), ("in_b",), ("in_e",)]


def reach(edges, starts):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
    out = set()
    for thread, entry in starts:
        todo = [entry]
        while todo:
            f = todo.pop()
            if (f, thread) not in out:
                out.add((f, thread))
                todo += ahead.get(f, [])
    return out


def test_reachability_of_long_graphs_equals_brute_force(spark):
    import random

    from impactlake.plans.graph import reachability

    rng = random.Random(2)
    ring = [(f"r{i}", f"r{(i + 1) % 2000}") for i in range(2000)] + [("r1999", "tail0"), ("lost0", "lost1"), ("lost1", "lost0"), ("lost1", "r7"), ("self", "self")]
    ring += [(f"tail{i}", f"tail{i + 1}") for i in range(60)] + [(f"x{rng.randrange(80)}", f"x{rng.randrange(80)}") for _ in range(110)] + [("tail60", "x1"), ("tail30", "x40")]
    starts = [("t", "r5"), ("u", "tail3"), ("v", "nowhere"), ("t", "self")]
    threads = spark.createDataFrame([(t, e, False) for t, e in starts], "thread_id string, entry_function string, is_interrupt_like boolean")
    got = {(r["function_name"], r["thread_id"]) for r in reachability(threads, spark.createDataFrame(ring, "caller string, callee string")).collect()}
    assert got == reach(ring, starts)
