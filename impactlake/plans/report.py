"""Reports of an impact: lines of Markdown, an HTML page and rows of a tree."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html
from .impact import by_name
from .index import Impact

#: Places that a report names for a risk, and that a page does.
EVIDENCE, EVIDENCE_HTML = 12, 3


def file_name(symbol: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", symbol).strip("_") or "symbol"


def metrics(i: Impact) -> DataFrame:
    """label, n: how much an impact holds."""
    out = None
    for label in ("declarations", "accesses", "risks", "unresolved"):
        one = getattr(i, label).agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def cited(i: Impact, most: int) -> DataFrame:
    """code, places: the first places that speak for each risk, at most `most`."""
    spots = F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "file", "line").alias("spot"))))
    return i.evidence(most).groupBy("code").agg(F.array_join(F.transform(spots, lambda x: x["spot"]), ", ").alias("places"))


def lines(i: Impact) -> DataFrame:
    """section, position, text: the report as rows; sections are numbered in reading order."""
    spot = F.concat_ws(":", "file", "line")
    made = lambda df, n, title, text, order: df.select(F.lit(n).alias("section"), F.lit(title).alias("title"), text.alias("text"), F.concat_ws("\u0001", *order).alias("place"))
    threads = i.threads.groupBy("function_name").agg(F.array_join(F.sort_array(F.collect_set("thread_id")), ", ").alias("all"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("is_interrupt_like"), F.col("thread_id")))), ", ").alias("irq"))
    risks = i.risks.join(cited(i, EVIDENCE), "code", "left")
    parts = [
        made(i.declarations, 1, "Declarations", F.concat(F.col("kind"), F.lit(" `"), F.col("name"), F.lit("`: "), spot, F.lit(" `"), F.col("declaration"), F.lit("`")), ["file", F.lpad(F.col("line").cast("string"), 9, "0")]),
        made(threads, 2, "Threads", F.concat(F.lit("`"), F.col("function_name"), F.lit("`: "), F.col("all"), F.when(F.col("irq") != "", F.concat(F.lit(" (interrupt-like: "), F.col("irq"), F.lit(")"))).otherwise(F.lit(""))), ["function_name"]),
        made(i.accesses, 3, "Accesses", F.concat(F.upper("kind"), F.lit(" `"), F.col("variable_name"), F.lit("` in `"), F.col("function_name"), F.lit("` at "), spot, F.lit(": `"), F.col("evidence"), F.lit("`")), ["file", F.lpad(F.col("line").cast("string"), 9, "0"), F.lpad(F.col("seq").cast("string"), 9, "0")]),
        made(risks, 4, "Risks", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("code"), F.lit(": "), F.coalesce("places", F.lit(""))), [F.col("rank").cast("string")]),
        made(i.unresolved, 5, "Unresolved evidence", F.concat(F.col("kind"), F.lit(": "), spot, F.lit(" `"), F.coalesce("evidence", F.lit("")), F.lit("`")), ["file", F.lpad(F.col("line").cast("string"), 9, "0"), "kind"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def markdown(i: Impact) -> str:
    """The report's text. One symbol's rows come to the driver, as a person reads them."""
    rows = sorted(lines(i).collect(), key=lambda r: (r["section"], r["place"]))
    out = [f"# Impact of {i.symbol}", "", f"- kind: {i.kind}", ""]
    for n, title in enumerate(("Declarations", "Threads", "Accesses", "Risks", "Unresolved evidence"), 1):
        own = [f"- {r['text']}" for r in rows if r["section"] == n]
        out += [f"## {title}", "", *(own or ["- none found; this proves nothing"]), ""]
    return "\n".join([*out, "## Notes", "", "- Candidates from static reading; locking and timing are not judged.", ""])


def html(i: Impact) -> str:
    """A page with counts, nodes and edges."""
    nodes, edges = i.nodes().orderBy("kind", "id"), i.edges().orderBy("src", "dst", "label")
    safe = lambda df: df.select(*[escape_html(F.col(c).cast("string")).alias(c) for c in df.columns]).collect()
    counts = {r["label"]: r["n"] for r in metrics(i).collect()}
    title = i.symbol.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    cards = "".join(f'<div class="metric"><b>{v}</b> {k}</div>' for k, v in counts.items())
    table = lambda head, rows: f"<table><tr>{''.join(f'<th>{h}</th>' for h in head)}</tr>{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in r) + '</tr>' for r in rows)}</table>"
    risks = safe(i.risks.join(cited(i, EVIDENCE_HTML), "code", "left").orderBy("rank").select("severity", "code", F.coalesce("places", F.lit("")).alias("places")))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>{cards}{table(("severity", "code", "places"), risks)}{table(("id", "label", "kind"), safe(nodes))}{table(("from", "to", "label"), safe(edges))}</body></html>'


def tree(i: Impact) -> DataFrame:
    """level, label, description rows: the target, then risks, threads, accesses, functions and unresolved evidence."""
    spark = i.index.spark
    top = spark.createDataFrame([(0, i.symbol, i.kind)], "level int, label string, description string")
    row = lambda df, label, text: df.select(F.lit(1).alias("level"), label.alias("label"), text.alias("description"))
    parts = [
        row(i.risks, F.col("code"), F.col("severity")),
        row(i.threads, F.col("thread_id"), F.col("function_name")),
        row(i.accesses, F.col("variable_name"), F.concat_ws(" ", "kind", "function_name", "line")),
        row(i.functions.orderBy(by_name("name"), "name"), F.col("name"), F.concat_ws(":", "file", "start_line")),
        row(i.unresolved, F.col("kind"), F.concat_ws(":", "file", "line")),
    ]
    for p in parts:
        top = top.unionByName(p)
    return top


def write(i: Impact, folder: str) -> tuple[str, str]:
    """Writes <symbol>.md and <symbol>.html, over older ones."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for end, text in (("md", markdown(i)), ("html", html(i))):
        path = os.path.join(folder, f"{file_name(i.symbol)}.{end}")
        with open(path + ".part", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".part", path)
        out.append(path)
    return out[0], out[1]
