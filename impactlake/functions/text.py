"""Column builders for the text functions of the engine: paths, symbols, lines and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
SOURCE_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".inl")


def lines(text: Column) -> Column:
    """Lines of a text; a final line feed ends the last one."""
    whole = F.coalesce(text, F.lit(""))
    parts = F.split(whole, "\r?\n", -1)
    return F.when(F.length(whole) == 0, F.array().cast("array<string>")).when(F.endswith(whole, F.lit("\n")), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def contains_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])")


def replace_word(text: Column, word: str, new: str) -> Column:
    return F.regexp_replace(text, rf"(?<![A-Za-z0-9_])\Q{word}\E(?![A-Za-z0-9_])", new.replace("\\", "\\\\").replace("$", "\\$"))


def identifiers(text: Column) -> Column:
    """Distinct identifiers in the order of their first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_]){IDENTIFIER}"), F.lit(0)))


def normalize_index(text: Column) -> Column:
    """No white space, and any index written []."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", ""), r"\[[^\]]+\]", "[]")


def member_path(text: Column) -> Column:
    """What follows the first ::, or else the first -> or '.'; null where there is none."""
    after = F.regexp_extract(text, r"^(?:.*?::|(?:(?!::).)*?(?:->|\.)(?!.*::))(.+)$", 1)
    return F.when(F.length(after) > 0, after)


def direct_parent(text: Column) -> Column:
    """What stands before the last '.' or '->'; null where nothing does."""
    before = F.regexp_extract(text, r"^(.+)(?:->|\.)(?:(?!->|\.).)*$", 1)
    return F.when(F.length(before) > 0, before)


def count_of(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def brace_balance(text: Column) -> Column:
    return count_of(text, "{") - count_of(text, "}")


def simple_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def needle(glob: str) -> str:
    """A glob without wild cards and slashes at its ends, in lower case: exclusion looks for it anywhere in a path."""
    return glob.replace("\\", "/").replace("*", "").strip("/").lower()


def excluded(path: Column, globs) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for n in filter(None, map(needle, globs)):
        out = out | F.contains(low, F.lit(n))
    return out


def is_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0)).isin(*SOURCE_EXTENSIONS)


def directive(line: Column) -> Column:
    """The preprocessor directive of a line, or null."""
    word = F.regexp_extract(line, r"^\s*#\s*([a-z]+)", 1)
    return F.when(F.length(word) > 0, word)


def grouped_digits(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def duration(ms: Column) -> Column:
    """850ms below one second, else 19.4s."""
    return F.when(ms < 1000, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))


def mebibytes(n: Column) -> Column:
    return F.round(n / 1048576.0, 1)


def same_signature(size_a: Column, time_a: Column, size_b: Column, time_b: Column, tolerance_ms: float = 2.0) -> Column:
    return (size_a == size_b) & (F.abs(time_a - time_b) < tolerance_ms)
