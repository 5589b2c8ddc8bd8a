"""Chat formatting with DataFrame functions alone.

A declarative template names, for each role, the control strings around a turn and whether the turn's
text bears loss. A finite-state machine over the roles, folded along the turns, says whether their
order is one that the template allows. Every turn becomes three segments (opening, text, closing),
each with its loss flag. Control strings inside texts are escaped reversibly, so the formatted text
can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`turns` by role; `other` opens, parts and closes turns of any other role; `moves` has the machine's transitions."""

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked",
            ("start", "user"): "user",
            ("asked", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accept: tuple[str, ...] = ("assistant", "user")
    escape: str = "%"

    @property
    def controls(self) -> list[str]:
        """All control strings, longest first; the escape character's own code comes before them."""
        named = {s for t in self.turns.values() for s in (t.open, t.close)} | set(self.other)
        return sorted(named, key=lambda s: (-len(s), s))


def escape(text: Column, t: Template) -> Column:
    """The text with the escape character and each control string written as the escape character and two digits."""
    out = F.replace(text, F.lit(t.escape), F.lit(f"{t.escape}00"))
    for i, s in enumerate(t.controls, 1):
        out = F.replace(out, F.lit(s), F.lit(f"{t.escape}{i:02d}"))
    return out


def unescape(text: Column, t: Template) -> Column:
    """Undoes escape: every escape character there is followed by its two digits, so the order decides nothing but that 00 is last."""
    out = text
    for i, s in enumerate(t.controls, 1):
        out = F.replace(out, F.lit(f"{t.escape}{i:02d}"), F.lit(s))
    return F.replace(out, F.lit(f"{t.escape}00"), F.lit(t.escape))


def _quoted(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in s)


def format_chats(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: conv_id, formatted, segments array<struct<text, loss>>, valid, final_state.

    Rows need conv_id, turn, role and text; further columns are ignored, whatever their names. Turns go by turn,
    then role, then text, null first, so ties and repeated rows have a fixed order and all are kept. A null text is
    empty, a null role is the empty role; roles that the template lacks are written with their name and make the order
    invalid. Rows with a null conv_id form one conversation. An invalid order is told, not dropped. A conversation's turns
    are one row of the result, so the longest conversation has to fit in a task's memory.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("_t"))

    def parts(x: Column) -> Column:
        body = escape(x["text"], template)
        begin, middle, end = template.other
        opening = F.concat(F.lit(begin), escape(x["role"], template), F.lit(middle))
        closing, loss = F.lit(end), F.lit(False)
        for name, turn in template.turns.items():
            this = x["role"] == F.lit(name)
            opening = F.when(this, F.lit(turn.open)).otherwise(opening)
            closing = F.when(this, F.lit(turn.close)).otherwise(closing)
            loss = F.when(this, F.lit(turn.loss)).otherwise(loss)
        piece = lambda s, flag: F.struct(s.alias("text"), flag.alias("loss"))
        return F.array(piece(opening, F.lit(False)), piece(body, loss), piece(closing, F.lit(False)))

    def step(state: Column, x: Column) -> Column:
        out = F.lit("error")
        for (a, r), b in template.moves.items():
            out = F.when((state == F.lit(a)) & (x["role"] == F.lit(r)), F.lit(b)).otherwise(out)
        return out

    done = grouped.select(
        "conv_id",
        F.flatten(F.transform("_t", parts)).alias("segments"),
        F.aggregate("_t", F.lit("start"), step).alias("final_state"),
    )
    return done.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("final_state").isin(*template.accept).alias("valid"),
        "final_state",
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The array of turns (role, text) that a formatted text holds."""
    begin, middle, end = template.other
    opens = [t.open for t in template.turns.values()] + [begin]
    closes = [t.close for t in template.turns.values()] + [end]
    either = lambda xs: "|".join(_quoted(s) for s in sorted(xs, key=lambda s: (-len(s), s)))
    turns = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{either(opens)})(?:.*?)(?:{either(closes)})"), F.lit(0))

    def read(x: Column) -> Column:
        inner = lambda a, b: F.substr(x, F.lit(len(a) + 1), F.length(x) - F.lit(len(a) + len(b)))
        named = inner(begin, end)
        role = F.substring_index(named, middle, 1)
        text = F.substr(named, F.length(role) + F.lit(len(middle) + 1), F.length(named))
        role = unescape(role, template)
        for name, t in template.turns.items():
            this = F.startswith(x, F.lit(t.open)) & F.endswith(x, F.lit(t.close))
            role = F.when(this, F.lit(name)).otherwise(role)
            text = F.when(this, inner(t.open, t.close)).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.transform(turns, read)


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted output says when it is read back: turns, loss text and lengths."""
    turns = read_turns(F.col("formatted"), template)
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return chats.withColumn("_turns", turns).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations plus conversation -1, whose texts hold control strings."""
    probe = rows.sparkSession.range(2, numPartitions=1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """What every formatted conversation, and the probe, say when they are read back."""
    from .common import table

    return digest(format_chats(with_probe(table(spark, sf_dir, "conversations"))))


def _sql_escape(x: str, t: Template) -> str:
    out = f"replace({x}, '{t.escape}', '{t.escape}00')"
    for i, s in enumerate(t.controls, 1):
        out = f"replace({out}, '{s}', '{t.escape}{i:02d}')"
    return out


def oracle() -> str:
    t = Template()
    around = " ".join(f"WHEN role = '{r}' THEN {len(x.open) + len(x.close)}" for r, x in t.turns.items())
    other = sum(map(len, t.other))
    ok = "^(system,)?(user,assistant,)*user(,assistant)?,$"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, text) AS roles,
             sum(length({_sql_escape('text', t)}) + CASE {around} ELSE {other} + length({_sql_escape('role', t)}) END) AS chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars, regexp_matches(roles, '{ok}') AS valid FROM g"""
