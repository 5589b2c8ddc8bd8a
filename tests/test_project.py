"""Projects, thread maps, encodings, stored indexes, reports and the file stream, on files that the tests write."""

import pytest

from impactlake import settings
from impactlake.plans import report, store
from impactlake.sources import corpus, project, threadmap
from impactlake.streaming.incremental import follow

WORKSPACE = 'Project: "a"=".\\app\\a.dsp" - Package Owner=<4>\nProject: "gone"=".\\gone.dsp" - Package Owner=<4>\n'
PROJECT = """!IF  "$(CFG)" == "a - Win32 Release"
# ADD CPP /nologo /I "inc" /D "NDEBUG" /D LIMIT=3 /c
!ELSEIF  "$(CFG)" == "a - Win32 Debug"
# ADD CPP /I "dbg" /D "_DEBUG"
!ENDIF
# Begin Source File
SOURCE=.\\main.c
# ADD CPP /D "LOCAL_ONLY"
# End Source File
# Begin Source File
SOURCE=.\\skip.c
# PROP Exclude_From_Build 1
# End Source File
# Begin Source File
SOURCE="with space.c"
# End Source File
SOURCE=.\\missing.c
SOURCE=.\\readme.txt
"""


@pytest.fixture
def root(tmp_path):
    app, inc = tmp_path / "app", tmp_path / "inc"
    app.mkdir(), inc.mkdir()
    (tmp_path / "a.dsw").write_text(WORKSPACE)
    (app / "a.dsp").write_text(PROJECT)
    (app / "main.c").write_text('#include "near.h"\n#if LIMIT == 3\n#include <far.h>\n#else\n#include "never.h"\n#endif\nint g;\nvoid F(void)\n{\n    g = 1;\n}\n')
    (app / "skip.c").write_text("int s;\n")
    (app / "with space.c").write_bytes("/* 日本 */ int w;\n".encode("cp932"))
    (app / "near.h").write_text("extern int g;\n")
    (app / "never.h").write_text("int n;\n")
    (inc / "far.h").write_text('#include "deep.h"\n')
    (inc / "deep.h").write_text("int deep;\n")
    return tmp_path


def test_workspace(root):
    p = project.load(str(root))
    assert [s.removeprefix(f"{root}/") for s in p.source_files] == ["app/main.c", "app/near.h", "app/with space.c", "inc/deep.h", "inc/far.h"]
    assert p.macros == ("LIMIT=3", "NDEBUG") and p.include_paths == (f"{root}/inc",)
    assert project.load(str(root), "a.dsw", wanted="Debug").macros == ("_DEBUG",)
    assert project.load(str(root), exclude=["**/inc/**"]).source_files[-1].endswith("with space.c")
    with pytest.raises(FileNotFoundError):
        project.load(str(root), "none.dsp")
    assert project.is_enabled(str(root)) and project.is_enabled(str(root), "a.dsw") and not project.is_enabled(str(root), "../x.dsw")


def test_command_lines():
    assert project.words('a "b c" /D"X=1" d') == ["a", "b c", "/DX=1", "d"]
    assert project.switches(project.words('/I x -Iy /i "z z" /D q'), "I") == ["x", "y", "z z"]
    assert project.pick_configuration(["a Debug", "a Release"], "none") == "a Release"
    assert project.pick_configuration([], "x") is None


def test_thread_maps(spark, tmp_path):
    yaml = 'threads:\n  - threadId: "w"  # note\n    entryFunction: Run\n    isInterruptLike: TRUE\n  - threadId: lost\n'
    assert threadmap.parse(yaml) == [("w", "Run", None, None, True, None)]
    assert threadmap.parse('{"threads": [{"threadId": "a", "entryFunction": " F ", "priority": 3}, {"threadId": 1}]}') == [("a", "F", "3", None, False, None)]
    assert threadmap.read(spark, "").count() == 0
    with pytest.raises(FileNotFoundError):
        threadmap.read(spark, str(tmp_path / "none.json"))


def test_decoding():
    assert corpus.decode("é".encode()) == ("é", "utf8", False)
    assert corpus.decode(b"\xef\xbb\xbfa") == ("a", "utf8", False)
    assert corpus.decode("漢".encode("cp932")) == ("漢", "cp932", False)
    assert corpus.decode(b"a\x81")[1:] == ("cp932", True)
    assert corpus.decode(None) == ("", "utf8", False)
    with pytest.raises(UnicodeDecodeError):
        corpus.decode(b"\xff", "utf8")


def test_settings():
    assert settings.encoding("Shift_JIS") == "cp932" and settings.encoding(None) == "auto"
    assert settings.depth("99") == 20 and settings.depth("x") == 4
    assert settings.timeout_ms(None, 200) == 50_000 and settings.timeout_ms(5, 1) == 5
    assert settings.symbol_argument({"name": " g "}) == "g" and settings.symbol_argument(3) == ""
    assert settings.symbol_at("x = a.b[1]->c + 2;", 7) == "a.b[1]->c"


def test_update_ladder_and_report(spark, root, tmp_path):
    threads = spark.createDataFrame([("t", "F", True)], "thread_id string, entry_function string, is_interrupt_like boolean")
    path = str(tmp_path / "index")
    files = lambda: corpus.scan(spark, f"{root}/app", exclude=["never"])
    index, why = store.update(spark, path, files(), threads)
    assert why.reason == "previous-index-missing" and index.access.count() == 1
    assert store.update(spark, path, files(), threads)[1].reason is None
    assert store.update(spark, path, files(), threads, dialect="alternate")[1].reason == "parser-engine-changed"
    (root / "app" / "skip.c").write_text("int s;\nvoid G(void) { s++; }\n")
    index, why = store.update(spark, path, files(), threads, dialect="alternate")
    assert why == store.Decision("native-update-rebuild", 1) and index.function.count() == 2
    (root / "app" / "new.c").write_text("int k;\n")
    assert store.update(spark, path, files(), threads, dialect="alternate")[1].reason == "project-source-list-changed"
    assert dict(map(tuple, store.status(spark, path).collect()))["functions"] == "2"
    i = index.impact("g")
    text = report.markdown(i)
    assert "WRITE `g` in `F`" in text and "[high] INTERRUPT_CONTEXT" in text
    md, page = report.write(i, str(tmp_path / "reports"))
    assert "function:F" in open(page).read() and open(md).read() == text
    assert report.tree(i).where("level = 1").count() >= 3


def test_guards_and_culprit(spark, tmp_path):
    sig = spark.createDataFrame([("a", 1, 1.0)], "path string, size long, mtime_ms double")
    moved = spark.createDataFrame([("a", 1, 2.5)], "path string, size long, mtime_ms double")
    assert store.unchanged(sig, sig) and not store.unchanged(sig, moved)
    assert store.decide(sig, moved, "p", "p").reason is None  # within the tolerance
    with pytest.raises(RuntimeError):
        store.check_skipped(spark.range(20).selectExpr("string(id) AS path"), 16)
    log = tmp_path / "log.jsonl"
    log.write_text('{"event":"start","phase":"a","file":"x.c"}\n{"event":"end","phase":"a","file":"x.c"}\n{"event":"start","phase":"a","file":"y.c"}\nbroken\n')
    assert store.culprit(spark, str(log)) == "y.c"
    log.write_text('{"event":"start","phase":"a","file":"x.c"}\n{"event":"error","phase":"a","file":"x.c"}\n{"event":"note","phase":"b"}\n')
    assert store.culprit(spark, str(log)) == "x.c"


def test_stream_keeps_the_index(spark, root, tmp_path):
    threads = spark.createDataFrame([("t", "F", False)], "thread_id string, entry_function string, is_interrupt_like boolean")
    path = str(tmp_path / "streamed")
    q = follow(spark, f"{root}/app", str(tmp_path / "cp"), path, lambda: corpus.scan(spark, f"{root}/app"), threads)
    q.awaitTermination(120)
    assert store.load(spark, path).function.count() == 1


def test_all_settings():
    s = settings.Settings.of({"depth": 99, "batch_files": 0, "project_encoding": "Shift_JIS", "index_path": " x ", "exclude": ["a"], "thread_map": ""})
    assert (s.depth, s.batch_files, s.project_encoding, s.index_path, s.exclude, s.thread_map, s.configuration) == (20, 1, "cp932", "x", ("a",), "", "Release")
    assert s.index_folder("/r") == "/r/x" and settings.Settings().index_folder("/r").startswith("/r/")
    assert len(settings.Settings.__dataclass_fields__) == 14
    with pytest.raises(ValueError):
        settings.Settings.of({"colour": 1})


def test_skips_after_failures(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")

    def run(df):
        bad = sorted({r["path"] for r in df.collect()} & {"a", "c"})
        if bad:
            raise MemoryError(bad[0])
        return df.count()

    left, skipped = store.with_skips(run, files, lambda e: str(e))
    assert left == 1 and {r["path"] for r in skipped.collect()} == {"a", "c"}
    with pytest.raises(MemoryError):
        store.with_skips(run, files, lambda e: str(e), most=1)
    with pytest.raises(MemoryError):
        store.with_skips(run, files, lambda e: None)


@pytest.mark.parametrize("kind", ["ring", "stress", "members"])
def test_samples_from_the_command_line(spark, tmp_path, capsys, monkeypatch, kind):
    from impactlake import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    folder = str(tmp_path / "code")
    assert cli.main(["sample", kind, folder, "--files", "5"]) == 0
    assert cli.main(["build", folder, "--thread-map", "threads.json"]) == 0
    said = capsys.readouterr().out
    assert "full-build" in said and '"label": "functions"' in said
    symbol = {"ring": "ring_2", "stress": "stress_fn_2", "members": "state.counter"}[kind]
    assert cli.main(["report", folder, symbol]) == 0
    page = open(capsys.readouterr().out.split()[0]).read()
    assert f"# Impact of {symbol}" in page and "main" in page
    if kind == "members":
        assert cli.main(["update", folder, "--thread-map", "threads.json"]) == 0
        assert '"reason": null' in capsys.readouterr().out
        assert cli.main(["scan-file", f"{folder}/src/members.c"]) == 0
        assert "through_macro" in capsys.readouterr().out
        with pytest.raises(FileExistsError):
            cli.main(["sample", kind, folder])


def test_sources_that_change_meanwhile(spark, root, tmp_path):
    threads = spark.createDataFrame([], "thread_id string, entry_function string, is_interrupt_like boolean")
    files = corpus.scan(spark, f"{root}/app", exclude=["never"])
    moved = files.select("path", (files["size"] + 1).alias("size"), "mtime_ms")
    with pytest.raises(RuntimeError):
        store.update(spark, str(tmp_path / "i"), files, threads, signatures_now=lambda: moved)
    assert store.update(spark, str(tmp_path / "i"), files, threads, signatures_now=lambda: files.select("path", "size", "mtime_ms"))[1].reason == "previous-index-missing"
