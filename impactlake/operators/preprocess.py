"""Conditional compilation: which lines are active under a set of macros."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

_DIRECTIVE = re.compile(r"^\s*#\s*([a-z]+)\b\s*(.*)$")
_DEFINE = re.compile(r"^\s*([A-Za-z_]\w*)(\s*\([^)]*\))?\s*(.*)$")
_INCLUDE = re.compile(r'^\s*#\s*include\s*(?:"([^"]+)"|<([^>]+)>)')
_PIECE = re.compile(r"[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+|\d+|&&|\|\||==|!=|!|\(|\)")
MOST_DEPTH = 64


def number(text: str) -> int | None:
    m = re.fullmatch(r"\s*([-+]?)\s*(0[xX][0-9A-Fa-f]+|\d+)[uUlL]*\s*", text)
    return None if not m else (-1 if m[1] == "-" else 1) * int(m[2], 16 if m[2][:2].lower() == "0x" else 10)


def evaluate(expression: str, macros: dict[str, str]) -> bool:
    """Truth of a condition. Known pieces count, all other characters are passed over; undefined names are 0, others that are no number 1."""
    pieces = _PIECE.findall(expression)
    at = 0

    def peek() -> str | None:
        return pieces[at] if at < len(pieces) else None

    def take() -> str | None:
        nonlocal at
        at += 1
        return pieces[at - 1] if at <= len(pieces) else None

    def atom() -> int:
        p = take()
        if p is None or p == ")":
            return 0
        if p == "!":
            return int(not atom())
        if p == "(":
            value = either()
            if peek() == ")":
                take()
            return value
        if p == "defined":
            bracket = peek() == "("
            if bracket:
                take()
            name = take()
            if bracket and peek() == ")":
                take()
            return int(name in macros)
        if p[0].isdigit():
            return number(p) or 0
        if p[0].isalpha() or p[0] == "_":
            value = macros.get(p)
            return 0 if value is None else (1 if (n := number(value)) is None else n)
        return 0

    def equal() -> int:
        left = atom()
        while peek() in ("==", "!="):
            same = take() == "=="
            left = int((left == atom()) == same)
        return left

    def both() -> int:
        left = equal()
        while peek() == "&&":
            take()
            right = equal()
            left = int(bool(left) and bool(right))
        return left

    def either() -> int:
        left = both()
        while peek() == "||":
            take()
            right = both()
            left = int(bool(left) or bool(right))
        return left

    return bool(either())


def active_lines(raw: list[str], masked: list[str], macros: dict[str, str], load: Callable[[str, bool, str], tuple[str, list[str], list[str]] | None] | None = None, stack: tuple[str, ...] = (), where: str = "") -> list[str]:
    """The masked lines with inactive ones blank. `macros` is changed by #define and #undef of active lines.

    load(name, quoted, where) finds what the file `where` includes as (path, raw lines, masked lines); headers only change macros. Headers in
    the stack and beyond MOST_DEPTH are passed over.
    """
    out: list[str] = []
    frames: list[list[bool]] = []  # parent active, this branch active, some branch taken
    for line, own in zip(raw, masked, strict=True):
        live = not frames or all(f[1] for f in frames)
        m = _DIRECTIVE.match(own) if "#" in own else None
        if not m:
            out.append(own if live else " " * len(own))
            continue
        word, rest = m.groups()
        if word in ("if", "ifdef", "ifndef"):
            name = rest.split()[0] if rest.split() else ""
            holds = {"if": lambda: evaluate(rest, macros), "ifdef": lambda: name in macros, "ifndef": lambda: name not in macros}[word]()
            frames.append([live, live and holds, holds])
            out.append(own if live else " " * len(own))
        elif word in ("elif", "else", "endif") and frames:
            top = frames[-1]
            out.append(own if top[0] else " " * len(own))
            if word == "endif":
                frames.pop()
            else:
                holds = word == "else" or evaluate(rest, macros)
                top[1] = top[0] and holds and not top[2]
                top[2] = top[2] or holds
        elif live:
            out.append(own)
            if word == "define" and (d := _DEFINE.match(rest)):
                macros[d[1]] = "" if d[2] else d[3].strip()
            elif word == "undef" and rest.split():
                macros.pop(rest.split()[0], None)
            elif word == "include" and load and len(stack) < MOST_DEPTH and (i := _INCLUDE.match(line)):
                found = load((i[1] or i[2]).strip(), i[1] is not None, where)
                if found and found[0].lower() not in stack:
                    active_lines(found[1], found[2], macros, load, (*stack, found[0].lower()), found[0])
        else:
            out.append(" " * len(own))
    return out


def candidates(name: str, quoted: bool, where: str, include_paths: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Keys of the files that an include may mean, in order: beside the file that includes it if quoted, then in the include paths."""
    folders = [posixpath.dirname(where.replace("\\", "/"))] if quoted else []
    return [path_key(posixpath.join(folder, name.replace("\\", "/"))) for folder in [*folders, *(p.replace("\\", "/") for p in include_paths)]]


def path_key(path: str) -> str:
    """A path as files are looked up by: with / and without steps back, in lower case."""
    return posixpath.normpath(path.replace("\\", "/")).lower()


def includes(raw: list[str], active: list[str]) -> list[tuple[str, bool]]:
    """(name, quoted) of the active #include lines."""
    found = (_INCLUDE.match(r) for r, a in zip(raw, active, strict=True) if "#" in r and a.strip())
    return [(m[1] or m[2], m[1] is not None) for m in found if m]
