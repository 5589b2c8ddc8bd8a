"""Secret scans through a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression is read into a Boolean query over trigrams that every match holds. The
index maps each trigram that some query asks for to the documents that have it, in blocks of bounded
size; a rule's candidates are the intersections and unions of these postings. Candidates are then
verified with the expression itself. A rule without mandatory trigrams scans all documents. Trigrams
are those of the lower-cased text, so that one index serves rules of either case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

try:
    from re import _constants as _c
    from re import _parser
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    """`group` of each match must have `least` characters, else the match is dropped; base rules have a fixed meaning."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("gh_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("api_id", r"AIza[0-9A-Za-z_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

#: Documents in a block of the index, on average.
BLOCK_DOCS = 2048
#: Alternatives of one literal stretch beyond which it is asked for no longer.
MOST_STRINGS = 40

# Boolean queries: None asks for nothing; a string is a trigram; ("and" | "or", (query, ...)).


def _both(op: str, parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    if op == "and":
        parts = [p for p in parts if p is not None]
    elif None in parts:
        return None
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _ask(strings: set[str]) -> object:
    """The query of a stretch that is one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(seq) -> tuple[set[str] | None, object]:
    """The strings that the parsed sequence matches, if they are few, and its query."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    asked: list = []

    def flush() -> None:
        nonlocal run
        asked.append(_ask(run))
        run = {""}

    for op, arg in seq:
        few, query = None, None
        if op is _c.LITERAL:
            few = {chr(arg).lower()}
        elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            few = {chr(a).lower() for _, a in arg}
        elif op is _c.SUBPATTERN:
            few, query = _walk(arg[3])
        elif op is _c.BRANCH:
            sub = [_walk(s) for s in arg[1]]
            few = set().union(*(s for s, _ in sub)) if all(s is not None for s, _ in sub) else None
            query = _both("or", [q if s is None else _both("and", [q, _ask(s)]) for s, q in sub])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = arg
            strings, q = _walk(inner)
            if strings is not None and high != _c.MAXREPEAT and int(high) <= 4:
                few = {"".join(p) for n in range(low, int(high) + 1) for p in product(sorted(strings), repeat=n)} if len(strings) ** int(high) <= MOST_STRINGS else None
            elif strings is not None and low >= 1 and len(strings) == 1:
                query = _ask({next(iter(strings)) * low})
            query = _both("and", [query, q]) if low >= 1 else None
        elif op is _c.AT:
            few = {""}
        if few is not None and len(run) * len(few) <= MOST_STRINGS and not ("" in few and len(run) > 1):
            run = {a + b for a in run for b in few}
        else:
            flush()
            if few is None:
                asked.append(query)
            elif len(few) <= MOST_STRINGS and "" not in few:
                run = few
            exact = None
    if exact is not None:
        return run, _both("and", asked)
    flush()
    return None, _both("and", asked)


def trigram_query(pattern: str) -> object:
    """The Boolean query over lower-case trigrams that each text with a match meets; None: no trigram is mandatory."""
    strings, query = _walk(_parser.parse(pattern))
    return query if strings is None else _both("and", [query, _ask(strings)])


def trigrams(query: object) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _key(docs: DataFrame) -> Column:
    """A document's key in the index; rows that share it have the same text, so they share the verdict too."""
    return F.xxhash64(F.col("text")) if "doc_id" not in docs.columns else F.xxhash64(F.col("doc_id"), F.col("text"))


def inverted_index(docs: DataFrame, asked: list[str], blocks: int) -> DataFrame:
    """block, postings: for each block of documents a map from trigram to the keys of the documents that have it."""
    low = docs.select(_key(docs).alias("key"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = low.select("key", F.explode(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked])).alias("trigram"))
    lists = held.where(F.col("trigram").isNotNull()).groupBy(F.pmod(F.hash("key"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """key, rules (a bit for each rule): the documents whose trigrams meet the rule's query; None if no rule has one."""
    queries = {r: q for r in range(len(rules)) if (q := trigram_query(rules[r].pattern)) is not None}
    asked = sorted(set().union(*map(trigrams, queries.values())))
    if not asked:
        return None
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    index = inverted_index(docs, asked, blocks)
    def postings(q: object) -> Column:
        if isinstance(q, str):
            return F.coalesce(F.try_element_at("postings", F.lit(q)), F.array().cast("array<bigint>"))
        join = F.array_intersect if q[0] == "and" else F.array_union
        out = postings(q[1][0])
        for part in q[1][1:]:
            out = join(out, postings(part))
        return out

    def marked(r: int) -> Column:
        return F.transform(postings(queries[r]), lambda k: F.struct(k.alias("key"), F.lit(1 << r).cast("long").alias("bit")))

    hits = index.select(F.explode(F.concat(*map(marked, queries))).alias("h")).select("h.key", "h.bit")
    return hits.groupBy("key").agg(F.bit_or("bit").alias("rules"))


def let(value: Column, body) -> Column:
    """body of the value, which is evaluated once, as a lambda's variable, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so starts are running sums of their lengths;
    sums go by stretches of 128 to stay far from quadratic.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = F.transform(F.arrays_zip(between.alias("g"), found.alias("m"), judged.alias("j")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.coalesce(F.length(x["m"]), F.lit(-1)).alias("m"), F.coalesce(F.length(x["j"]), F.lit(0)).alias("j")))
    stretch = F.lit(128)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["g"] + F.greatest(x["m"], F.lit(0)))

    def starts(s: Column, before: Column) -> Column:
        at = F.transform(s, lambda x, i: F.struct((F.get(before, F.floor(i / stretch).cast("int")) + total(F.slice(s, F.floor(i / stretch).cast("int") * stretch + 1, i % stretch)) + x["g"]).alias("start"), x["m"].alias("m"), x["j"].alias("j")))
        kept = F.filter(at, lambda x: (x["m"] >= 0) & (x["j"] >= rule.least))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["m"]).alias("end")))

    def placed(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / stretch).cast("int")), lambda b: total(F.slice(s, b * stretch + 1, stretch)))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(before, lambda b: starts(s, b))

    return let(sizes, lambda s: F.when(F.size(s) <= 1, none).otherwise(placed(s)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with `spans` array<struct<start, rank, kind, end>>, by start and then the rules' order.

    A null or empty text has no spans; repeated rows get the same ones; ties in start go by the rules' order. Very long
    texts are read whole. Extra columns are carried; where one is named spans, the new column gets underscores in front.
    """
    found = candidates(docs, rules)
    name = fresh(docs, "spans", "_key", "_rules")
    base = docs.withColumn(name["_key"], _key(docs))
    if found is None:
        joined = base.withColumn(name["_rules"], F.lit(0).cast("long"))
    else:
        joined = base.join(found.select(F.col("key").alias(name["_key"]), F.col("rules").alias(name["_rules"])), name["_key"], "left")
    text = F.col("text")
    arrays = []
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    def ranked(r: int, rule: Rule) -> Column:
        return F.transform(spans_of(text, rule), lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))

    for r, rule in enumerate(rules):
        hit = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.col(name["_rules"]), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0
        if trigram_query(rule.pattern) is None and rule.least and not rule.group:
            hit = text.rlike(f"{rule.pattern.rstrip('+')}{{{rule.least}}}") if rule.pattern.endswith("]+") else hit
        arrays.append(F.when(text.isNotNull() & hit, ranked(r, rule)).otherwise(none))
    return joined.withColumn(name["spans"], F.array_sort(F.concat(*arrays))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name["spans"]))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows with each stretch of text that spans cover replaced by the mark; overlapping spans share one.

    A null text stays null and an empty one empty; a text of any length is read whole. Repeated rows are redacted alike, all columns stay, whatever their
    names, and an empty table gives an empty one.
    """
    name = fresh(docs, "spans")["spans"]
    found = scan(docs, rules)
    text = F.col("text")
    # A span is the last of its stretch if the next starts beyond all ends so far; ends only matter where spans overlap.
    merged = F.aggregate(
        F.col(name),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when((F.size(a) > 0) & (s["start"] < F.element_at(a, F.greatest(F.size(a), F.lit(1)))["end"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, F.greatest(F.size(a), F.lit(1)))["start"].alias("start"), F.greatest(F.element_at(a, F.greatest(F.size(a), F.lit(1)))["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    m = fresh(found, "_merged")["_merged"]
    at = F.col(m)
    heads = F.transform(at, lambda s, i: F.concat(F.substr(text, F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"]) + 1, s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"])), F.lit(mark)))
    tail = F.substr(text, F.element_at(at, F.greatest(F.size(at), F.lit(1)))["end"] + 1, F.length(text))
    clean = F.when(F.size(name) > 0, F.concat(F.array_join(heads, ""), tail)).otherwise(text)
    return found.withColumn(m, F.when(F.size(name) > 0, merged)).withColumn("text", clean).drop(name, m)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Spans of secrets in every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return scan(docs).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def oracle() -> str:
    ctes, unions = [], []
    for r, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        group = f"regexp_extract_all(text, '{p}', {rule.group})"
        ctes.append(
            f"r{r} AS (SELECT rid, unnest([{{'rank': {r}, 'kind': '{rule.kind}', 'start': CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS BIGINT), 'size': length(m[i]), 'ok': length(j[i]) >= {rule.least}}} FOR i IN range(1, len(m) + 1)]) AS s "
            f"FROM (SELECT rid, regexp_extract_all(text, '{p}') AS m, {group} AS j, regexp_split_to_array(text, '{p}') AS g FROM d) WHERE len(m) > 0)"
        )
        unions.append(f"SELECT rid, s FROM r{r} WHERE s.ok")
    w = "s.kind || ':' || s.start || ':' || (s.start + s.size)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), {', '.join(ctes)},
u AS ({' UNION ALL '.join(unions)}),
a AS (SELECT rid, count(*) FILTER (s.kind = 'assign') AS n_assign, count(*) FILTER (s.kind = 'access') AS n_access, count(*) FILTER (s.kind = 'hex') AS n_hex,
      string_agg({w}, ',' ORDER BY s.start, s.rank) FILTER (s.rank < {len(BASE_RULES)}) AS base, string_agg({w}, ',' ORDER BY s.start, s.rank) AS spans FROM u GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""
