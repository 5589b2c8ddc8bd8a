"""Thread maps: JSON, or lists of keys and values in a small part of YAML."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "thread_id string, entry_function string, priority string, cycle string, is_interrupt_like boolean, notes string"
_ENTRY = re.compile(r"^(\s*-\s*|\s+)([A-Za-z0-9_]+):\s*(.*)$")


def parse(text: str) -> list[tuple]:
    """Rows of SCHEMA; entries without a textual threadId and entryFunction go."""
    if text.lstrip().startswith("{"):
        found = json.loads(text).get("threads")
    else:
        found = []
        for line in re.split(r"\r?\n", text):
            m = _ENTRY.match(re.sub(r"\s+#.*$", "", line))
            if not m:
                continue
            if "-" in m[1]:
                found.append({})
            value = re.sub(r'^"|"$', "", m[3].strip())
            if found:
                found[-1][m[2]] = value.lower() == "true" if value.lower() in ("true", "false") else value
    say = lambda v: None if v is None else str(v)
    return [
        (t["threadId"].strip(), t["entryFunction"].strip(), say(t.get("priority")), say(t.get("cycle")), bool(t.get("isInterruptLike")), say(t.get("notes")))
        for t in (found if isinstance(found, list) else [])
        if isinstance(t, dict) and isinstance(t.get("threadId"), str) and isinstance(t.get("entryFunction"), str)
    ]


def read(spark: SparkSession, path: str | None) -> DataFrame:
    """The map's rows; none for a blank setting, an error for a file that is missing."""
    rows = []
    if path and path.strip():
        with open(path, encoding="utf-8-sig") as f:
            rows = parse(f.read())
    return spark.createDataFrame(rows, SCHEMA)
