"""Settings of index builds, their defaults, and normalisers of loose values."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Settings:
    """All settings of an index build. workers and batch_files bound nothing here, as Spark's partitions do; they are kept for callers that pass them."""

    project_file: str = ""
    configuration: str = "Release"
    thread_map: str = ""
    output_dir: str = ""
    exclude: tuple[str, ...] = field(default_factory=lambda: ("**/Debug/**", "**/Release/**", "**/node_modules/**", "**/.git/**"))
    depth: int = 4
    workers: int = 0
    batch_files: int = 4
    max_skipped_files: int = 16
    timeout_ms: int = -1
    dialect: str = "primary"
    index_path: str = ""
    project_encoding: str = "auto"
    source_encoding: str = "auto"

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Settings from loose values: blank ones keep their defaults, numbers are clamped, encodings and dialects normalised; unknown names fail."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        v = {k: x.strip() if isinstance(x, str) else x for k, x in values.items() if x is not None}
        out = cls(**{k: x for k, x in v.items() if x != ""})
        return replace(
            out,
            exclude=tuple(out.exclude),
            depth=clamp(out.depth, 1, 20, 4),
            workers=clamp(out.workers, 0, 64, 0),
            batch_files=clamp(out.batch_files, 1, 64, 4),
            max_skipped_files=clamp(out.max_skipped_files, 0, 1000, 16),
            dialect=dialect(out.dialect),
            project_encoding=encoding(out.project_encoding),
            source_encoding=encoding(out.source_encoding),
        )

    def folder(self, root: str) -> str:
        """Where index and reports go: output_dir, from the root, or a folder of its own there."""
        return os.path.join(root, self.output_dir or ".impactlake")

    def index_folder(self, root: str) -> str:
        return os.path.join(root, self.index_path) if self.index_path else os.path.join(self.folder(root), "index")


def encoding(value: str | None) -> str:
    """auto, utf8 or cp932; anything else is auto."""
    v = (value or "").strip().lower().replace("-", "").replace("_", "")
    return {"utf8": "utf8", "cp932": "cp932", "shiftjis": "cp932", "sjis": "cp932"}.get(v, "auto")


def dialect(value: str | None) -> str:
    return "alternate" if value == "alternate" else "primary"


def clamp(value, low: int, high: int, default: int) -> int:
    """The value as a whole number between low and high; the default where it is none."""
    try:
        return max(low, min(high, int(value)))
    except (TypeError, ValueError, OverflowError):
        return default


def depth(value) -> int:
    return clamp(value, 1, 20, 4)


def timeout_ms(value, files: int) -> int:
    """The given budget, or 250 ms a file and 30 s at least where it is missing or negative."""
    return int(value) if value is not None and value >= 0 else max(30_000, 250 * files)


def symbol_argument(value) -> str:
    """The symbol a caller means: a string, or the first of symbolName, name and label of a mapping."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("symbolName", "name", "label") if isinstance(value.get(k), str) and value[k].strip()), "")
    return value.strip() if isinstance(value, str) else ""


_SYMBOL_AT = re.compile(r"[A-Za-z_]\w*(?:\s*\[[^\]]*\])?(?:\s*(?:->|\.|::)\s*[A-Za-z_]\w*(?:\s*\[[^\]]*\])?)*")


def symbol_at(text: str, offset: int) -> str:
    """The symbol expression around a text offset, or an empty string."""
    return next((m.group() for m in _SYMBOL_AT.finditer(text) if m.start() <= offset <= m.end()), "")
