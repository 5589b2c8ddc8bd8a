"""Lines, masks and tokens of C-like source text."""

from __future__ import annotations

import re
import string
from typing import NamedTuple

KEYWORDS = frozenset(
    "if else for while do switch case default break continue return goto sizeof struct class union enum typedef const volatile static extern register "
    "auto inline virtual public private protected void int char short long float double unsigned signed bool new delete this catch try throw".split()
)
CONTROL = frozenset("if for while switch catch return sizeof".split())
#: The reasons and kinds of access, as the index stores them.
WRITE, READ, UNKNOWN = "write", "read", "unknown"

_MASKED = re.compile(r"//.*|/\*.*?(?:\*/|$)|\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)")
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|->|\+\+|--|<<=|>>=|&&|\|\||::|[-+*/%&|^=!<>]=|\S")
_OPENING, _CLOSING = "([{", ")]}"
_WORD_CHARACTERS = frozenset(string.ascii_letters + string.digits + "_")


class Token(NamedTuple):
    text: str
    start: int
    end: int

    @property
    def is_name(self) -> bool:
        return self.text[0].isalpha() or self.text[0] == "_"


def split_lines(text: str) -> list[str]:
    lines = text.replace("\r\n", "\n").split("\n")
    return lines[:-1] if lines and not lines[-1] else lines


def mask(lines: list[str]) -> list[str]:
    """The lines with comments and literals as blanks of the same length; only block comments go on to the next line."""
    out, inside = [], False
    for line in lines:
        head = ""
        if inside:
            end = line.find("*/")
            if end < 0:
                out.append(" " * len(line))
                continue
            head, line, inside = " " * (end + 2), line[end + 2 :], False
        if not ("/" in line or '"' in line or "'" in line):
            out.append(head + line)
            continue

        def blank(m: re.Match) -> str:
            nonlocal inside
            if m.group().startswith("/*") and (len(m.group()) < 4 or not m.group().endswith("*/")):
                inside = True
            return " " * len(m.group())

        out.append(head + _MASKED.sub(blank, line))
    return out


def tokens(line: str) -> list[Token]:
    return [Token(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(line)]


def closing(ts: list[Token], at: int) -> int:
    """Index of the token that closes the bracket at `at`, or the number of tokens."""
    pair = ts[at].text, _CLOSING[_OPENING.index(ts[at].text)]
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i].text == pair[0]) - (ts[i].text == pair[1])
        if not depth:
            return i
    return len(ts)


def top_level(text: str, separator: str = ",") -> list[str]:
    """Parts of a text between separators that no bracket holds."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPENING:
            depth += 1
        elif c in _CLOSING:
            depth -= 1
        elif c == separator and depth <= 0:
            parts.append(text[start:i])
            start = i + 1
    parts.append(text[start:])
    return [p.strip() for p in parts if p.strip()]


def braces(line: str) -> int:
    return line.count("{") - line.count("}")


def word(name: str) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])")


def spots(line: str, name: str) -> list[tuple[int, int]]:
    """Where a name stands in a line as a whole word; as word(name) finds it, without an expression for each name."""
    out, at = [], line.find(name)
    while at >= 0:
        end = at + len(name)
        whole = not ((at and line[at - 1] in _WORD_CHARACTERS) or (end < len(line) and line[end] in _WORD_CHARACTERS))
        if whole:
            out.append((at, end))
        at = line.find(name, end if whole else at + 1)
    return out


class Member(NamedTuple):
    """A member expression: owner, whether it is indexed, connectors and path ([] marks indexed members)."""

    text: str
    owner: str
    indexed: bool
    connectors: tuple[str, ...]
    path: tuple[str, ...]
    start: int
    end: int

    def named(self, owner: str, first: str | None = None) -> str:
        cons = (first or self.connectors[0], *self.connectors[1:])
        return owner + "".join(c + p for c, p in zip(cons, self.path))


def members(line: str) -> list[Member]:
    """Member expressions from left to right; (p + i)->x counts as the indexed owner p."""
    if "." not in line and "->" not in line:
        return []
    ts, out, i = tokens(line), [], 0
    while i < len(ts):
        owner, at, indexed = None, i, False
        if ts[i].is_name and ts[i].text not in KEYWORDS:
            owner, at = ts[i].text, i + 1
        elif ts[i].text == "(":
            end = closing(ts, i)
            inner = ts[i + 1 : end]
            if end < len(ts) and len(inner) >= 3 and inner[0].is_name and inner[1].text in "+-" and not any(t.text in ("(", ",", "=") for t in inner):
                owner, at, indexed = inner[0].text, end + 1, True
        if owner is None:
            i += 1
            continue
        if at < len(ts) and ts[at].text == "[":
            indexed, at = True, closing(ts, at) + 1
        cons, path, stop = [], [], at
        while at + 1 < len(ts) and ts[at].text in ("->", ".") and ts[at + 1].is_name:
            cons.append(ts[at].text)
            name, at = ts[at + 1].text, at + 2
            if at < len(ts) and ts[at].text == "[":
                name, at = name + "[]", closing(ts, at) + 1
            path.append(name)
            stop = at
        if not path:
            i += 1
            continue
        end = ts[min(stop, len(ts)) - 1].end
        out.append(Member(line[ts[i].start : end], owner, indexed, tuple(cons), tuple(path), ts[i].start, end))
        i = stop
    return out


_ASSIGN = re.compile(r"\s*(?:<<|>>|[-+*/%&|^])?=(?!=)")
_STEP_AFTER, _STEP_BEFORE = re.compile(r"\s*(?:\+\+|--)"), re.compile(r"(?:\+\+|--)\s*$")
_ADDRESS = re.compile(r"(?<!&)&\s*$")


def classify(line: str, name: str) -> tuple[str, str]:
    """(kind, reason) of the touches of a name in a line; the strongest of its places counts."""
    places = spots(line, name)
    if ("++" in line or "--" in line) and any(_STEP_BEFORE.search(line, 0, a) or _STEP_AFTER.match(line, b) for a, b in places):
        return WRITE, "increment-decrement"
    for _, b in places if "=" in line else ():
        rest = line[b:].lstrip()
        if rest.startswith("["):
            depth = 0
            for i, c in enumerate(rest):
                depth += (c == "[") - (c == "]")
                if not depth:
                    rest = rest[i + 1 :]
                    break
        if _ASSIGN.match(rest):
            return WRITE, "assignment"
    if "&" in line and any(_ADDRESS.search(line, 0, a) for a, _ in places):
        return UNKNOWN, "address-taken"
    return READ, "read-reference"


_PLAIN_ASSIGN = re.compile(r"\s*[-+*/%&|^]?=")


def classify_alternate(line: str, name: str) -> tuple[str, str]:
    """The alternate dialect's classifier: '==' counts as an assignment, indexes are not passed over, shifts are none, and '&' is a read."""
    places = [(m.start(), m.end()) for m in re.finditer(re.escape(name), line)]
    if any(_STEP_BEFORE.search(line, 0, a) or _STEP_AFTER.match(line, b) for a, b in places):
        return WRITE, "increment-decrement"
    if any(_PLAIN_ASSIGN.match(line, b) for _, b in places):
        return WRITE, "assignment"
    if any(_ADDRESS.search(line, 0, m.start()) for m in word(name).finditer(line)):
        return READ, "address-taken"
    return READ, "read-reference"


class Call(NamedTuple):
    name: str
    arguments: tuple[str, ...]


def calls(line: str) -> list[Call]:
    """Outermost calls of a line; what stands in their arguments is not looked at."""
    ts, out, i = tokens(line), [], 0
    while i + 1 < len(ts):
        if ts[i].is_name and ts[i + 1].text == "(" and ts[i].text not in CONTROL:
            end = closing(ts, i + 1)
            inner = line[ts[i + 1].end : ts[end].start if end < len(ts) else len(line)]
            out.append(Call(ts[i].text, tuple(top_level(inner))))
            i = end
        i += 1
    return out


def calls_alternate(line: str) -> list[Call]:
    """The alternate dialect's calls: innermost ones, with arguments between commas."""
    found = re.finditer(r"(?<![A-Za-z0-9_])([A-Za-z_]\w*)\s*\(([^()]*)\)", line)
    return [Call(m[1], tuple(a.strip() for a in m[2].split(",") if a.strip())) for m in found if m[1] not in CONTROL]
