"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

DataFrame functions only. A template gives each role its header; every turn becomes three segments: header, escaped
text, end mark. Texts can't forge a mark: every backslash is doubled, and a backslash parts the first two characters of
a control string wherever they stand together, or stands before that character wherever it stands if both are the same. So no
control string is left in an escaped text, not even where control strings overlap, and taking out each backslash that
stands before another character gives the text back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Names of the roles in headers, roles under the loss mask, marks, and the turns that may follow each other.

    follows: state -> role -> next state; final: the states in which a conversation may end."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    loss: frozenset[str] = frozenset({"assistant"})
    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    #: Strings of two characters or more that a text can't hold unescaped; `end` and `head` must hold one each.
    controls: tuple[str, ...] = ("###", "</turn>")
    follows: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "used"},
            "used": {"assistant": "answered", "tool": "used"},
        }
    )
    final: frozenset[str] = frozenset({"answered"})

    @property
    def escapes(self) -> list[tuple[str, str]]:
        """What escape() replaces, one after the other."""
        return [("\\", "\\\\"), *dict.fromkeys((c[0], "\\" + c[0]) if c[0] == c[1] else (c[:2], c[0] + "\\" + c[1]) for c in self.controls)]


def escape(text: Column, template: Template) -> Column:
    for found, made in template.escapes:
        text = F.replace(text, F.lit(found), F.lit(made))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column, template: Template) -> Column:
    """Known roles by their names; any other after an @, escaped, its colons too, so that it can be read back."""
    other = F.concat(F.lit("@"), F.replace(escape(role, template), F.lit(":"), F.lit("\\:")))
    for name, shown in template.names.items():
        other = F.when(role == name, F.lit(shown)).otherwise(other)
    return F.concat(F.lit(template.head), other, F.lit(template.colon))


def _machine(roles: Column, template: Template) -> Column:
    """The number of the first turn that breaks the order, from 1; one past the last if it ends too early; else 0."""
    states = ["start", *dict.fromkeys(t for x in template.follows.values() for t in x.values())]

    def step(acc: Column, role: Column) -> Column:
        to = F.lit(-1)
        for state, moves in template.follows.items():
            for name, target in moves.items():
                to = F.when((acc["state"] == states.index(state)) & (role == name), F.lit(states.index(target))).otherwise(to)
        return F.when(acc["state"] < 0, acc).otherwise(F.struct(to.alias("state"), (acc["turns"] + 1).alias("turns")))

    first = F.struct(F.lit(0).alias("state"), F.lit(0).alias("turns"))
    fine = [states.index(x) for x in template.final]
    return F.aggregate(roles, first, step, lambda acc: F.when(acc["state"] < 0, acc["turns"]).when(acc["state"].isin(fine), F.lit(0)).otherwise(acc["turns"] + 1))


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conversations (conv_id, turn, role, text; a row each turn) -> conv_id, segments, formatted, error_turn, valid.

    segments: array of (text, loss) in order, the text inside marks escaped; formatted: all segments joined. Turns are
    sorted by turn (null first), ties by role and text, and repeated rows stay. A null text or role is the empty
    string; a null conv_id is a conversation of its own; an unknown role is formatted and breaks the turn order. An
    empty table gives no rows. A conversation is one row, so its turns meet in one task: its size is that of the row
    asked for. Other columns are neither read nor returned.
    """
    template = template or Template()
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = turns.select(F.col("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def parts(row: Column) -> Column:
        return F.array(
            F.struct(_header(row["role"], template).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(row["text"], template).alias("text"), row["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    made = whole.select("conv_id", F.flatten(F.transform("rows", parts)).alias("segments"), _machine(F.transform("rows", lambda x: x["role"]), template).alias("error_turn"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"), "error_turn", (F.col("error_turn") == 0).alias("valid"))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns, an array of (role, text) read from the formatted text, and loss_text, read from the segments under
    the loss mask; both unescaped. An empty text has no turns."""
    template = template or Template()
    names = list(template.names.items())

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.head) + 1))
        shown = F.regexp_extract(body, r"(?s)^((?:[^:\\]|\\.)*+)" + re.escape(template.colon), 1)
        role = unescape(F.substr(shown, F.lit(2)))
        for name, title in names:
            role = F.when(shown == title, F.lit(name)).otherwise(role)
        text = F.substr(body, F.length(shown) + len(template.colon) + 1)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    pieces = F.split("formatted", re.escape(template.end), -1)
    turns = F.transform(F.slice(F.col("pieces"), F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(0))), turn)
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: x["text"]), ""))
    return formatted.withColumn("pieces", pieces).withColumns({"turns": turns, "loss_text": loss}).drop("pieces")
