"""Workspace and project files: which sources, include paths and macros a build has."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from ..functions.text import SOURCE_EXTENSIONS, needle
from ..operators import lexer, preprocess
from .corpus import decode

_PROJECT = re.compile(r"^\s*Project:.*?=(.*)$", re.I)
_CONDITION = re.compile(r'"?\$\(\s*CFG\s*\)"?\s*(==|!=)\s*"([^"]+)"', re.I)
_BRANCH = re.compile(r"^!(IF|ELSEIF|ELSE|ENDIF)\b\s*(.*)$", re.I)
_WORD = re.compile(r'(?:"[^"]*"|[^\s"])+')


@dataclass(frozen=True)
class Project:
    project_file: str
    workspace_root: str
    source_files: tuple[str, ...]
    include_paths: tuple[str, ...]
    macros: tuple[str, ...]

    def macro_values(self) -> dict[str, str]:
        """Macros as conditional compilation sees them: NAME=VALUE, and 1 for a bare name."""
        return {n: v if eq else "1" for n, eq, v in (m.partition("=") for m in self.macros)}


def resolve(base: str, path: str) -> str:
    return os.path.normpath(os.path.join(base, path.replace("\\", "/"))).replace("\\", "/")


def path_value(text: str, stop: str = "") -> str:
    """A quoted value, or the text up to the stop."""
    text = text.strip()
    if text.startswith('"'):
        return text[1:].partition('"')[0].strip()
    return (text.split(stop)[0] if stop else text).strip()


def words(line: str) -> list[str]:
    """Words of a command line; quotes group and vanish."""
    return [w.replace('"', "") for w in _WORD.findall(line)]


def switches(ws: list[str], letter: str) -> list[str]:
    """Values of /X v, /Xv and -X, whatever the letter's case."""
    out, flag = [], False
    for w in ws:
        if flag:
            out.append(w)
            flag = False
        elif w[:1] in ("/", "-") and w[1:2].lower() == letter.lower():
            flag = len(w) == 2
            out += [w[2:]] if len(w) > 2 else []
    return [v for v in out if v]


def configurations(lines: list[str]) -> list[str]:
    return list(dict.fromkeys(m[2] for line in lines for m in [_CONDITION.search(line)] if m))


def pick_configuration(names: list[str], wanted: str) -> str | None:
    """The wanted name, else one that holds it, else one with the word Release, else the first."""
    tests = (lambda n: n.lower() == wanted.lower(), lambda n: wanted.lower() in n.lower(), lambda n: re.search(r"\bRelease\b", n, re.I), lambda n: True)
    return next((n for test in tests for n in names if test(n)), None)


def of_configuration(lines: list[str], chosen: str | None) -> list[str]:
    """Lines of the branches that hold for the configuration; a condition that cannot be read holds."""
    if not chosen:
        return lines
    out, frames = [], []  # parent, active, taken
    for line in lines:
        m = _BRANCH.match(line.strip())
        live = all(f[1] for f in frames)
        if not m:
            out += [line] if live else []
            continue
        kind, c = m[1].upper(), _CONDITION.search(m[2])
        holds = not c or (c[2].lower() == chosen.lower()) == (c[1] == "==")
        if kind == "IF":
            frames.append([live, live and holds, live and holds])
        elif frames and kind == "ENDIF":
            frames.pop()
        elif frames:
            parent, _, taken = frames[-1]
            now = parent and not taken and (kind == "ELSE" or holds)
            frames[-1][1:] = [now, taken or now or kind == "ELSE"]
    return out


def read(path: str, how: str = "auto") -> list[str]:
    with open(path, "rb") as f:
        return re.split(r"\r?\n", decode(f.read(), how)[0])


def projects_in(lines: list[str], base: str) -> list[str]:
    """Project files that a workspace's lines name."""
    named = [path_value(m[1], " - ") for line in lines if (m := _PROJECT.match(line))]
    return list(dict.fromkeys(resolve(base, n) for n in named if n.lower().endswith(".dsp")))


def projects_of(workspace: str, how: str = "auto") -> list[str]:
    """Project files that a workspace names, or the one of its own name."""
    return projects_in(read(workspace, how), os.path.dirname(workspace)) or [os.path.splitext(workspace)[0] + ".dsp"]


def is_excluded(path: str, globs) -> bool:
    low = path.replace("\\", "/").lower()
    return any(n in low for n in map(needle, globs) if n)


def parse_lines(lines: list[str], folder: str, root: str, exclude=(), wanted: str = "Release") -> tuple[set[str], set[str], set[str]]:
    """Sources, include paths and macros that a project file's lines name. Paths of sources go from its folder, include paths from the root."""
    sources: dict[str, None] = {}
    include, macros = set(), set()
    inside, current = False, None
    for line in map(str.strip, of_configuration(lines, pick_configuration(configurations(lines), wanted))):
        if block := re.match(r"#\s*(Begin|End) Source File", line, re.I):
            inside, current = block[1].lower() == "begin", None
        elif m := re.match(r"SOURCE=(.+)$", line, re.I):
            value = path_value(m[1])
            full = resolve(folder, value) if value else ""
            if full and os.path.splitext(full)[1].lower() in SOURCE_EXTENSIONS and not is_excluded(full, exclude):
                sources[full] = None
                current = full if inside else None
        elif current and re.match(r"#\s*PROP\s+Exclude_From_Build\s+1\b", line, re.I):
            sources.pop(current, None)
        elif not current:
            ws = words(line)
            include.update(resolve(root, v) for v in switches(ws, "I"))
            macros.update(switches(ws, "D"))
    return set(sources), include, macros


def parse_project(path: str, root: str, exclude=(), how: str = "auto", wanted: str = "Release") -> tuple[set[str], set[str], set[str]]:
    """Sources that exist, include paths and macros of one project file."""
    sources, include, macros = parse_lines(read(path, how), os.path.dirname(path), root, exclude, wanted)
    return {s for s in sources if os.path.isfile(s)}, include, macros


def included(sources: set[str], include_paths: list[str], macros: dict[str, str], exclude=(), how: str = "auto") -> set[str]:
    """The sources and all files that active #include lines reach from them: breadth first, each file once."""
    seen, front = set(sources), sorted(sources)

    def find(base: str, name: str, quoted: bool) -> str | None:
        places = ([os.path.dirname(base)] if quoted else []) + list(include_paths)
        return next((p for p in (resolve(d, name) for d in places) if os.path.isfile(p)), None)

    while front:
        found = set()
        for path in front:
            raw = lexer.split_lines("\n".join(read(path, how)))
            active = preprocess.active_lines(raw, lexer.mask(raw), dict(macros))
            for name, quoted in preprocess.includes(raw, active):
                hit = find(path, name, quoted)
                if hit and os.path.splitext(hit)[1].lower() in SOURCE_EXTENSIONS and not is_excluded(hit, exclude):
                    found.add(hit)
        front = sorted(found - seen)
        seen |= found
    return seen


def load(root: str, project_file: str | None = None, exclude=(), how: str = "auto", wanted: str = "Release", source_how: str = "auto") -> Project:
    """The project that a .dsw or .dsp file describes; a workspace's missing projects are passed over, a missing project file fails."""
    root = os.path.abspath(root)
    file = resolve(root, project_file) if project_file else default_project(root)
    if file is None:
        raise FileNotFoundError(f"no .dsw or .dsp file in {root}")
    workspace = file.lower().endswith(".dsw")
    sources, include, macros = set(), set(), set()
    for p in projects_of(file, how) if workspace else [file]:
        if workspace and not os.path.isfile(p):
            continue
        s, i, m = parse_project(p, root, exclude, how, wanted)
        sources, include, macros = sources | s, include | i, macros | m
    bare = Project(file, root, (), tuple(sorted(include)), tuple(sorted(macros)))
    everything = included(sources, list(bare.include_paths), bare.macro_values(), exclude, source_how)
    return Project(file, root, tuple(sorted(everything)), bare.include_paths, bare.macros)


def default_project(root: str) -> str | None:
    """The first .dsw of a folder, else its first .dsp."""
    names = os.listdir(root)
    return next((resolve(root, n) for end in (".dsw", ".dsp") for n in names if n.lower().endswith(end)), None)


def is_enabled(root: str, setting: str = "") -> bool:
    """Whether a folder has a project: the one the setting names, inside the folder, or any."""
    if not setting.strip():
        return default_project(root) is not None
    file = resolve(root, setting.strip())
    inside = os.path.commonpath([os.path.abspath(root), os.path.abspath(file)]) == os.path.abspath(root)
    return inside and file.lower().endswith((".dsw", ".dsp")) and os.path.isfile(file)
