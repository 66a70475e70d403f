"""Chat formatting (DataFrame operations only).

A declarative ``ChatTemplate`` names the turn marks, the roles that carry loss and the finite-state
machine over roles. ``format_chats`` folds the machine over each conversation's roles and emits the
text segments with one loss flag each; ``read_back`` recovers turns and loss text from that output.

Escaping: every backslash is doubled, then a backslash goes after the first character of each control
string, so no control string occurs in an escaped text; dropping one backslash before any character
undoes both.

Defined cases: null text and null role count as empty; turns sort by turn (null first), role, text, so
ties and repeated rows have one order and all stay; a null conversation id is a conversation of its own;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """``open`` role ``mid`` text ``close`` for each turn; control strings hold no backslash."""

    open: str = "### @"
    mid: str = ": "
    close: str = "</turn>\n"
    #: Control strings that are escaped inside texts; ``close`` is recognised by its first one.
    controls: tuple[str, ...] = ("### ", "</turn>")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; a pair that is missing rejects the conversation at that turn.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    accepting: tuple[str, ...] = ("answered",)


def _inner(literals: tuple[str, ...]) -> str:
    """Pattern for the first character of each control string where the rest follows."""
    return "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" if len(c) > 1 else re.escape(c) for c in literals)


def escape(text: Column, literals: tuple[str, ...]) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"({_inner(literals)})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _machine(template: ChatTemplate):
    """Fold over roles; the state is (name, turns accepted)."""

    def step(state, turn):
        rule = F.lit("")
        for (at, role), to in template.moves.items():
            rule = F.when((state["at"] == at) & (turn["role"] == role), F.lit(to)).otherwise(rule)
        return F.struct(rule.alias("at"), (state["ok"] + F.when(rule != "", 1).otherwise(0)).alias("ok"))

    return step


def format_chats(turns: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: segments array<struct<text, loss>>, formatted, valid, n_valid_turns.

    The one shuffle is by conversation, which is what has to come together in one output row.
    """
    template = template or ChatTemplate()
    slim = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    chats = slim.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    end = F.aggregate("turns", F.struct(F.lit(template.start).alias("at"), F.lit(0).alias("ok")), _machine(template))

    def pieces(t):
        head = F.concat(F.lit(template.open), F.regexp_replace(escape(t["role"], template.controls), ":", "\\\\:"), F.lit(template.mid))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template.controls).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    out = chats.select("conv", end.alias("_end"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    valid = F.col("_end")["at"].isin(*template.accepting)
    return out.select(F.col("conv").alias(conv_col), "segments", formatted.alias("formatted"), valid.alias("valid"), F.col("_end")["ok"].alias("n_valid_turns"))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Add ``turns`` array<struct<role, text>> parsed from ``formatted`` and ``loss_text`` from the flagged segments."""
    template = template or ChatTemplate()
    chunks = F.filter(F.split("formatted", f"\\Q{template.close}\\E"), lambda c: c != "")
    head = f"(?s)^{re.escape(template.open)}([^:\\\\]*+(?:\\\\.[^:\\\\]*+)*+){re.escape(template.mid)}(.*)$"

    def turn(c):
        return F.struct(unescape(F.regexp_extract(c, head, 1)).alias("role"), unescape(F.regexp_extract(c, head, 2)).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("*", F.transform(chunks, turn).alias("turns"), loss.alias("loss_text"))


def chat_digest(formatted: DataFrame, template: ChatTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """Digest columns of the formatted conversations, all read back from the output."""
    back = read_back(formatted, template)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
