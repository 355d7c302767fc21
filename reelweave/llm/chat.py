"""Chat formatting from a declarative template.

A template gives each role its opening and closing marker and whether its text
is trained on, and lists which role may follow which; that list is a finite
automaton whose state is the last role.  Markers inside texts are escaped by
a backslash after their first character (one more if there are some already),
so that the text can be read back exactly.

Conversations are built from chunks of ``CHUNK`` turns, each by its own task;
only the finished chunks of a conversation meet.  All of it is DataFrame
functions.

Defined results: rows are ordered by turn (null first), then role and text,
so ties and repeated rows have one order; a null text is empty; a null role is
the empty role; roles that the template doesn't name are written with a
marker that carries their name and are never trained on; rows without conv_id
are one conversation.  A conversation that breaks the turn order is formatted
all the same, and ``errors`` counts the turns that may not stand where they
do.  Other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)})
    other: Turn = Turn("[ROLE:", "[/ROLE]")
    #: Which role may follow which; None is the start.
    follows: tuple[tuple[str | None, str], ...] = ((None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))

    def markers(self) -> list[str]:
        return [m for t in (*self.roles.values(), self.other) for m in (t.open, t.close)]

    def control(self, slashes: str) -> str:
        """Pattern of a marker with backslashes after its first character, in three groups."""
        by: dict[str, list[str]] = {}
        for m in self.markers():
            by.setdefault(m[0], []).append(re.escape(m[1:]))
        firsts = "".join("\\" + c for c in by)
        rests = "|".join(sorted({r for rs in by.values() for r in rs}, key=len, reverse=True))
        return f"([{firsts}]){slashes}({rests})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.control(r"(\\*)"), "$1\\\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.control(r"\\(\\*)"), "$1$2$3")

    def allowed(self, state: Column, role: Column) -> Column:
        ok = F.lit(False)
        for before, after in self.follows:
            ok = ok | ((state.isNull() if before is None else state.eqNullSafe(F.lit(before))) & (role == after))
        return ok

    def segments(self, role: Column, text: Column) -> Column:
        """A turn as [opening, text, closing], each with its loss flag."""
        def three(opened: Column, turn: Turn) -> Column:
            return F.array(*[F.struct(t.alias("text"), F.lit(flag).alias("loss")) for t, flag in ((opened, False), (self.escape(text), turn.loss), (F.lit(turn.close), False))])

        out = three(F.concat(F.lit(self.other.open), F.base64(F.encode(role, "UTF-8")), F.lit("]")), self.other)
        for name, turn in self.roles.items():
            out = F.when(role == name, three(F.lit(turn.open), turn)).otherwise(out)
        return out

    def pattern(self) -> str:
        """One formatted turn."""
        known = [f"{re.escape(t.open)}.*?{re.escape(t.close)}" for t in self.roles.values()]
        return "(?s)" + "|".join([*known, rf"{re.escape(self.other.open)}[^\]]*\].*?{re.escape(self.other.close)}"])

    def read_turn(self, turn: Column) -> Column:
        """role and text of a formatted turn."""
        def inner(opened: Column, close: str) -> Column:
            return self.unescape(F.substring(turn, opened + 1, F.length(turn) - opened - len(close)))

        head = F.instr(turn, "]")
        name = F.decode(F.unbase64(F.substring(turn, F.lit(len(self.other.open) + 1), head - len(self.other.open) - 1)), "UTF-8")
        out = F.struct(name.alias("role"), inner(head, self.other.close).alias("text"))
        for role, t in self.roles.items():
            out = F.when(turn.startswith(t.open), F.struct(F.lit(role).alias("role"), inner(F.lit(len(t.open)), t.close).alias("text"))).otherwise(out)
        return out


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), errors; ``rows``: conv_id, turn, role, text."""
    t = template or Template()
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chunked = rows.groupBy("conv_id", F.expr(f"turn div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).cast("bigint").alias("errors"))

    def step(acc: Column, role: Column, inner: bool) -> Column:
        bad = ~t.allowed(acc["state"], role)
        if inner:  # the first turn of a chunk is judged once its predecessor is known
            bad = bad & acc["state"].isNotNull()
        return F.struct(role.alias("state"), (acc["errors"] + bad.cast("bigint")).alias("errors"))

    parts = chunked.select("conv_id", F.struct(
        F.col("chunk").alias("chunk"), F.size("turns").cast("bigint").alias("n"), F.col("turns")[0]["role"].alias("first"), F.col("turns")[F.size("turns") - 1]["role"].alias("last"),
        F.aggregate("turns", start, lambda acc, x: step(acc, x["role"], True))["errors"].alias("errors"),
        F.flatten(F.transform("turns", lambda x: t.segments(x["role"], x["text"]))).alias("segments")).alias("part"))
    joined = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    across = F.aggregate("parts", start, lambda acc, p: F.struct(p["last"].alias("state"), (acc["errors"] + p["errors"] + (~t.allowed(acc["state"], p["first"])).cast("bigint")).alias("errors")))
    return joined.select("conv_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"]).alias("n_turns"), F.flatten("parts.segments").alias("segments"), across["errors"].alias("errors"))


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader of the output finds: turns from the joined text, trained text from the flags."""
    t = template or Template()
    whole = formatted.withColumn("formatted", F.array_join("segments.text", ""))
    read = whole.withColumn("turns", F.transform(F.regexp_extract_all("formatted", F.lit(t.pattern()), F.lit(0)), t.read_turn))
    read = read.withColumn("loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), ""))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "errors")
