"""Reads, writes, calls and undecidable evidence of one function.

A small machine walks a function's lines in order: it expands macro aliases, learns local types and what
pointers stand for, and emits rows. Context is what all files together declare.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .declarations import Function
from .lexer import KEYWORDS, Member, calls, calls_alternate, classify, classify_alternate, members, top_level, word

_ASM = re.compile(r"\b(?:__asm|asm)\b")
_POINTER_CALL = re.compile(r"\(\s*\*\s*[A-Za-z_]\w*\s*\)\s*\(")
_POINTER_WRITE = re.compile(r"\*\s*[A-Za-z_]\w*\s*=")
_TABLE = re.compile(r"\(\s*\*\s*([A-Za-z_]\w*)\s*\[[^\]]*\]\s*\)\s*\([^;{}]*\)\s*=")
_NAME = re.compile(r"[A-Za-z_]\w*")
_QUALIFIERS = frozenset("const volatile static register struct class".split())
ROUNDS = 3


@dataclass
class Context:
    globals: set[str] = field(default_factory=set)
    global_types: dict[str, dict] = field(default_factory=dict)  # first declaration of each global
    types: dict[str, dict] = field(default_factory=dict)  # by name and alias, the first wins
    functions: dict[str, list[str]] = field(default_factory=dict)  # simple name -> full names
    templates: dict[str, list[tuple]] = field(default_factory=dict)  # function -> (parameter, path, kind, typed name)
    aliases: dict[str, dict] = field(default_factory=dict)  # macro aliases, in name order
    dialect: str = "primary"

    def __post_init__(self):
        self.type_names = sorted(self.types, key=lambda n: (-len(n), n))
        self.member_names = {m["name"] for t in self.types.values() for m in t["members"]}
        self.known = re.compile("|".join(re.escape(a) for a in self.aliases) or r"(?!)")

    def has_path(self, type_name: str, path: tuple[str, ...]) -> bool:
        for i, step in enumerate(path):
            found = next((m for m in self.types.get(type_name, {}).get("members", ()) if m["name"] == step.removesuffix("[]")), None)
            if not found:
                return False
            type_name = found["member_type"] or ""
            if i + 1 < len(path) and type_name not in self.types:
                return False
        return True


def parameters(signature: str) -> list[str]:
    inner = signature[signature.find("(") + 1 : signature.rfind(")")] if "(" in signature else ""
    return top_level(inner)


def typed_parameters(signature: str, type_names) -> dict[str, tuple[int, str, int]]:
    """name -> (index, type, pointer level) of the parameters of known types."""
    out = {}
    for i, p in enumerate(parameters(signature)):
        names = _NAME.findall(p.split("[")[0])
        known = next((t for t in type_names if t in names[:-1]), None)
        if known:
            out[names[-1]] = (i, known, p.count("*"))
    return out


def templates(f: Function) -> list[dict]:
    """Members that the function touches through its parameters, once each: parameter, path, access and the words before the parameter's name."""
    bound = {}
    for i, p in enumerate(parameters(f.signature)):
        names = _NAME.findall(p.split("[")[0])
        if len(names) > 1 and names[-1] not in KEYWORDS:
            bound[names[-1]] = i, names[:-1]
    seen: dict[tuple, dict] = {}
    for _, _, line in f.body if bound else ():
        for m in members(line):
            if m.owner in bound:
                i, before = bound[m.owner]
                kind, _ = classify(line, m.text)
                seen.setdefault((i, m.path, kind), {"parameter": i, "path": list(m.path), "access": kind, "words": before})
    return list(seen.values())


def expand(line: str, ctx: Context) -> tuple[str, list[str]]:
    """The line after up to ROUNDS rounds of alias expansion in name order, and the macros used."""
    if not ctx.aliases:
        return line, []
    used: list[str] = []
    for _ in range(ROUNDS):
        if not ctx.known.search(line):
            break
        before = line
        for name, alias in ctx.aliases.items():
            if name not in line:
                continue
            if not alias["is_function_like"]:
                line, n = word(name).subn(lambda _, a=alias: a["replacement"], line)
                used += [name] * bool(n)
                continue
            while (m := re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}\s*\(", line)) is not None:
                depth, end = 0, len(line)
                for i in range(m.end() - 1, len(line)):
                    depth += (line[i] == "(") - (line[i] == ")")
                    if not depth:
                        end = i + 1
                        break
                body = alias["replacement"]
                for p, a in zip(alias["parameters"], top_level(line[m.end() : end - 1])):
                    body = word(p).sub(lambda _, a=a: a, body)
                if word(name).search(body):
                    break
                line = line[: m.start()] + body + line[end:]
                used.append(name)
        if line == before:
            break
    return line, sorted(set(used))


class Walk:
    """The state of one function's walk: local types, what pointers stand for, and pointers that stand for too much."""

    def __init__(self, f: Function, ctx: Context):
        self.f, self.ctx = f, ctx
        self.local = {n: (t, p) for n, (_, t, p) in typed_parameters(f.signature, ctx.type_names).items()}
        self.alias: dict[str, tuple[str, str]] = {}  # pointer -> (owner, first connector)
        self.unclear: set[str] = set()
        self.rows: list[dict] = []
        self.notes: list[dict] = []
        self.called: set[str] = set()
        self.seen: set[tuple] = set()

    # Pointers ---------------------------------------------------------------------------------
    def stands_for(self, value: str, type_name: str) -> tuple[str, str] | None:
        value = " ".join(value.split())
        if m := re.match(r"&\s*([A-Za-z_]\w*)(.*)$", value):
            g = self.ctx.global_types.get(m[1])
            if g and g["type_name"] == type_name:
                return (m[1] + "[]" if g["is_array"] or "[" in m[2] else m[1]), "."
            return None
        if not _NAME.fullmatch(value):
            return None
        if value in self.alias:
            return self.alias[value]
        g = self.ctx.global_types.get(value)
        return (value, "->") if g and g["pointer_level"] > 0 and g["type_name"] == type_name else None

    def point(self, name: str, value: str, type_name: str) -> None:
        new = self.stands_for(value, type_name)
        if self.ctx.dialect == "alternate":  # the last assignment that can be told wins
            self.alias |= {name: new} if new else {}
        elif new is None or self.alias.get(name, new) != new:
            self.alias.pop(name, None)
            self.unclear.add(name)
        elif name not in self.unclear:
            self.alias[name] = new

    def learn(self, line: str) -> None:
        for statement in line.split(";"):
            text, fresh = statement.strip(), None
            for t in self.ctx.type_names if text else ():
                m = word(t).search(text) if t in text else None
                if not m or not set(text[: m.start()].split()) <= _QUALIFIERS:
                    continue
                left, eq, right = text[m.end() :].partition("=")
                d = re.fullmatch(r"[\s*&]*([A-Za-z_]\w*)\s*(?:\[.*\])?\s*", left)
                if d and d[1] not in KEYWORDS:
                    fresh = d[1]
                    self.local[fresh] = (t, left.count("*"))
                    if left.count("*") and right.strip():
                        self.point(fresh, right, t)
                    break
            if fresh is None and self.local and "=" in text and (m := re.search(r"(?<![\w.>*])([A-Za-z_]\w*)\s*=(?!=)(.*)$", text)):
                known = self.local.get(m[1])
                if known and known[1] and known[0] not in text[: m.start()]:
                    self.point(m[1], m[2], known[0])

    # Members ------------------------------------------------------------------------------------
    def resolve(self, m: Member) -> tuple[str | None, str | None, str | None] | None:
        """(accessed name, kind of evidence, its name), or None where nothing can be said."""
        ctx, g = self.ctx, self.ctx.global_types.get(m.owner)
        owner = m.owner + "[]" if g and (g["is_array"] or m.indexed) else m.owner
        if m.connectors[0] == ".":
            if not g or g["pointer_level"] > 0 or g["type_name"] not in ctx.types:
                return None
            name = m.named(owner)
            return (name, None, None) if ctx.has_path(g["type_name"], m.path) else (None, "unknown-member-access", name)
        if m.owner in self.unclear:
            return None, "ambiguous-member-alias", m.named(m.owner)
        if m.owner in self.alias:
            return m.named(*self.alias[m.owner]), None, None
        if g and g["pointer_level"] > 0:
            return m.named(owner), None, None
        if m.owner in self.local:
            name = f"{self.local[m.owner][0]}::{'.'.join(m.path)}"
            return name, "unknown-member-access", name
        return (None, "unknown-member-access", m.named(m.owner)) if m.path[-1] in ctx.member_names else None

    def argument(self, text: str) -> tuple[str, str] | None:
        """(owner, first connector) that a call's argument hands over."""
        bare = text.strip().lstrip("& ").strip()
        taken = text.strip().startswith("&")
        if not bare:
            return None
        whole = [m for m in members(bare) if m.start == 0 and m.end == len(bare)]
        if whole:
            got = self.resolve(whole[0])
            return (got[0], ".") if got and got[0] else None
        if not _NAME.fullmatch(bare):
            return None
        if bare in self.alias:
            return self.alias[bare]
        g = self.ctx.global_types.get(bare)
        return (bare, "." if taken or not g["pointer_level"] else "->") if g else None

    # Rows -----------------------------------------------------------------------------------------
    def note(self, kind: str, variable: str | None, line: int, raw: str) -> None:
        self.notes.append({"kind": kind, "function_name": self.f.name, "variable_name": variable, "line": line, "evidence": raw.strip()})

    def touch(self, line: int, raw: str, masked: str, macros: list[str], **row) -> None:
        row = {"target_name": row["variable_name"] if self.ctx.dialect == "alternate" else None, "access_expression": None} | row
        key = (row["target_kind"], row["target_name"] or row["variable_name"], row["kind"], line, row["access_expression"], tuple(row["reasons"]), tuple(macros))
        if key not in self.seen:
            self.seen.add(key)
            expanded = masked.strip() if macros else None
            self.rows.append(row | {"function_name": self.f.name, "seq": len(self.rows), "line": line, "evidence": raw.strip(), "expanded_evidence": expanded, "macro_names": macros})

    def tables(self) -> dict[str, list[str]]:
        """Local tables of function pointers: name -> functions."""
        out: dict[str, list[str]] = {}
        name = None
        for _, _, line in self.f.body:
            rest = line
            if name is None:
                m = _TABLE.search(line)
                if not m:
                    continue
                name, rest = m[1], line[m.end() :]
                out[name] = []
            out[name] += [full for x in re.findall(r"&\s*([A-Za-z_]\w*)", rest) for full in self.ctx.functions.get(x, ())]
            if ";" in rest:
                name = None
        return {n: list(dict.fromkeys(t)) for n, t in out.items() if t}

    def touches(self, number: int, raw: str, line: str, macros: list[str]) -> None:
        """Rows and notes of a line's members and globals."""
        ctx, judge = self.ctx, classify_alternate if self.ctx.dialect == "alternate" else classify
        self.learn(line)
        found = members(line)
        for kind, sign, pattern in (("inline-asm", "asm", _ASM), ("function-pointer", "*", _POINTER_CALL), ("pointer-write", "*", _POINTER_WRITE)):
            if sign in line and pattern.search(line):
                self.note(kind, None, number, raw)
        for m in found:
            got = self.resolve(m)
            if not got:
                continue
            kind, reason = judge(line, m.text)
            if got[0]:
                self.touch(number, raw, line, macros, variable_name=got[0], target_kind="member", kind=kind, reasons=[reason], access_expression=m.text)
                if reason == "address-taken":
                    self.note(reason, got[0], number, raw)
            if got[1]:
                self.note(got[1], got[2], number, raw)
        plain = line
        for m in found:
            plain = plain[: m.start] + " " * (m.end - m.start) + plain[m.end :]
        for name in dict.fromkeys(_NAME.findall(plain)):
            if name in ctx.globals:
                kind, reason = judge(plain, name)
                self.touch(number, raw, line, macros, variable_name=name, target_kind="global", kind=kind, reasons=[reason])
                if reason == "address-taken":
                    self.note(reason, name, number, raw)

    def may_call(self, line: str) -> bool:
        """Whether a line names a function of the code base other than this one."""
        own = [self.f.name]
        return "(" in line and any(self.ctx.functions.get(name, own) != own for name in _NAME.findall(line))

    def run(self, touches: bool = True) -> Walk:
        """Walks the function; without touches only calls are told."""
        ctx, other = self.ctx, self.ctx.dialect == "alternate"
        tables = {} if other else self.tables()
        called = calls_alternate if other else calls
        for number, raw, own in self.f.body:
            line, macros = expand(own, ctx)
            if touches:
                self.touches(number, raw, line, macros)
            for call in called(line) if self.may_call(line) else ():
                for full in ctx.functions.get(call.name, ()):
                    if full == self.f.name:
                        continue
                    self.called.add(full)
                    for index, path, kind, typed in ctx.templates.get(full, ()) if touches else ():
                        owner = self.argument(call.arguments[index]) if index < len(call.arguments) else None
                        if owner:
                            self.touch(number, raw, line, macros, variable_name=owner[0] + owner[1] + ".".join(path), target_name=typed, target_kind="member", kind=kind, reasons=["call-argument-alias"], access_expression=call.arguments[index].strip())
            for name, targets in tables.items():
                if re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}\s*\[[^\]]+\]\s*\(", line):
                    self.called.update(t for t in targets if t != self.f.name)
        return self
