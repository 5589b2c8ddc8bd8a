"""Declarations of one source file: macros, types, functions and globals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .lexer import KEYWORDS, CONTROL, braces, top_level

_DEFINE = re.compile(r"^\s*#\s*define\s+([A-Za-z_]\w*)(\s*\(([^)]*)\))?\s*(.*)$")
_TAG = re.compile(r"\b(?:struct|class)\s+([A-Za-z_]\w*)")
_DECLARED = re.compile(r"(?:^|[*\s])([A-Za-z_]\w*)\s*(\[[^\]]*\])?\s*(?::\s*\d+)?\s*$")
_SIGNATURE = re.compile(r"([~A-Za-z_]\w*(?:::[~A-Za-z_]\w*)?)\s*\([^(){};]*\)\s*(?:const)?\s*$")
#: A statement that begins with one of these, or holds it between spaces, declares no global.
NO_GLOBAL = ("typedef", "using", "return", "goto", "break", "continue", "struct", "class", "enum", "namespace")
_TYPE_BLOCK = re.compile(r"typedef (?:struct|class)|(?:struct|class) ")
_TYPE_WORDS = frozenset("extern static const volatile register struct class unsigned signed".split())


@dataclass
class Function:
    name: str
    start_line: int
    end_line: int
    signature: str
    body: list[tuple[int, str, str]] = field(default_factory=list)  # line, raw, masked


def type_of(declarator: str) -> str | None:
    """The type name that stands before a declared name."""
    words = re.findall(r"[A-Za-z_]\w*", declarator.split("[")[0])
    before = [w for w in words[:-1] if w not in _TYPE_WORDS]
    return before[-1] if before else None


def declared(text: str) -> tuple[str, bool, int] | None:
    """(name, is_array, pointer_level) of a declarator; only a last name with one index at most counts."""
    m = _DECLARED.search(text)
    return (m[1], bool(m[2]), text.count("*")) if m and m[1] not in KEYWORDS else None


def is_no_global(statement: str) -> bool:
    """Whether a statement (white space squeezed) outside functions is passed over: with brackets, a directive, or with a word of NO_GLOBAL."""
    return statement.startswith(("#", *NO_GLOBAL)) or "(" in statement or ")" in statement or any(f" {word} " in statement for word in NO_GLOBAL)


def macros(raw: list[str], active: list[str]) -> list[dict]:
    out = []
    for i, (r, a) in enumerate(zip(raw, active, strict=True), 1):
        if "#" in a and (m := _DEFINE.match(a)):
            out.append({"name": m[1], "replacement": m[4].strip(), "parameters": [p.strip() for p in (m[3] or "").split(",") if p.strip()], "is_function_like": m[2] is not None, "line": i, "declaration": r.strip()})
    return out


def functions(raw: list[str], active: list[str]) -> list[Function]:
    """Functions with a body; text is gathered until a '{' tells whether it was a signature."""
    out: list[Function] = []
    open_one: Function | None = None
    gathered, first, depth = "", 1, 0
    for i, (r, a) in enumerate(zip(raw, active, strict=True), 1):
        if a.lstrip().startswith("#"):
            continue
        if open_one:
            open_one.body.append((i, r, a))
            depth += braces(a)
        elif a.strip():
            first = first if gathered else i
            gathered = f"{gathered} {a.strip()}".strip()
            head, brace, _ = gathered.partition("{")
            if brace:
                signature = re.sub(r"\s", " ", head).strip()
                name = _SIGNATURE.search(signature)
                if name and ";" not in signature and not signature.startswith(tuple(CONTROL)):
                    open_one, depth = Function(name[1], first, i, signature, [(i, r, a)]), braces(a)
                gathered = ""
            elif ";" in gathered:
                gathered = ""
        if open_one and depth <= 0:
            open_one.end_line = i
            out.append(open_one)
            open_one = None
    return out


def types(raw: list[str], active: list[str]) -> list[dict]:
    """Structures and classes whose '{' stands on the line of the keyword."""
    out, i = [], 0
    while i < len(active):
        if "{" not in active[i] or not re.search("struct|class", active[i]):
            i += 1
            continue
        start, depth, block = i, 0, []
        while i < len(active):
            block.append(active[i])
            depth += braces(active[i])
            i += 1
            if depth <= 0 and ";" in block[-1]:
                break
        text = "\n".join(block)
        head, _, rest = text.partition("{")
        body, close, tail = rest.rpartition("}")
        if not close or not re.search("struct|class", head):
            continue
        tag = _TAG.search(" ".join(head.split()))
        aliases = []
        if head.strip().startswith("typedef"):
            for part in top_level(tail.split(";")[0]):
                m = re.search(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?$", part.split("=")[0].strip())
                aliases += [m[1]] if m and m[1] not in KEYWORDS else []
        names = list(dict.fromkeys([*([tag[1]] if tag else []), *aliases]))
        if names:
            out.append({"name": aliases[0] if aliases else names[0], "aliases": names, "line": start + 1, "declaration": raw[start].strip(), "members": _members(body, start + 1)})
    return out


def _members(body: str, line: int) -> list[dict]:
    out = []
    for statement in body.split(";"):
        here, line = line, line + statement.count("\n")
        text = " ".join(re.sub(r"\b(?:public|private|protected)\s*:", " ", statement).split())
        if not text or re.search(r"[(){]", text):
            continue
        parts = top_level(text)
        base = type_of(re.sub(r":\s*\d+$", "", parts[0]).strip()) if parts else None
        for part in parts:
            if d := declared(part):
                out.append({"name": d[0], "member_type": base, "is_array": d[1], "pointer_level": d[2], "line": here, "declaration": text})
    return out


def globals_(active: list[str], ranges: list[tuple[int, int]]) -> list[dict]:
    """Variables outside functions and type blocks."""
    covered = set()
    for a, b in ranges:
        covered.update(range(a, b + 1))
    out, gathered, first, depth, waiting = [], "", 1, 0, False
    for i, line in enumerate(active, 1):
        text = line.strip()
        if not text or i in covered or text.startswith("#"):
            continue
        opens_type = not gathered and depth <= 0 and not waiting and _TYPE_BLOCK.match(text)
        if depth > 0 or waiting or opens_type:
            depth += braces(line)
            waiting = depth <= 0 and ";" not in text and (waiting or bool(opens_type) or depth == 0)
            if depth <= 0 and ";" in text:
                depth, waiting = 0, False
            continue
        first = first if gathered else i
        gathered = f"{gathered} {text}".strip()
        if ";" not in gathered:
            continue
        for statement in gathered.split(";"):
            if not statement:
                break
            flat = " ".join(statement.split())
            if is_no_global(flat):
                continue
            declarator = flat.split("=")[0].strip()
            if d := declared(declarator):
                out.append({"name": d[0], "line": first, "declaration": flat, "is_extern": "extern " in flat, "type_name": type_of(declarator), "is_array": d[1], "pointer_level": d[2]})
        gathered = ""
    return out
