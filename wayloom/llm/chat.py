"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over the roles of a conversation validates the turn order. The template
gives the marks around a turn and whether its text is learned from; control strings inside
texts are escaped, so a mark in the output is always the template's own and the output can be
read back without loss. Segments are (text, loss) pieces whose concatenation is the output.

Defined results: a null text is empty; a null role is the role with an empty name; turns are
ordered by turn, then role, then text, null turns first; repeated rows are turns of their own;
rows with a null conv_id are one conversation; texts of any length are whole, and a conversation is
one row of the result, so it has to fit a task; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


# The template. A role that it doesn't list gets OTHER, with its name between the two parts.
TEMPLATE = {"system": Turn("<<SYS>> ", " <</SYS>>\n"), "user": Turn("[INST] ", " [/INST]\n"), "assistant": Turn("<s> ", " </s>\n", True)}
OTHER = ("<<ROLE ", ">> ", " <</ROLE>>\n")
#: Roles that may follow; "" starts a conversation, and END_STATES may end it.
ORDER = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
END_STATES = ("assistant",)
#: First character of a control string, the rest of it, and what the first character becomes.
_CONTROL = (("[", r"/?INST\]", "&lsqb;"), ("<", r"/?s>|</?SYS>>|</?ROLE", "&lt;"))


def escape(text: Column) -> Column:
    """The text without control strings; reversible."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for first, rest, code in _CONTROL:
        out = F.regexp_replace(out, f"{re.escape(first)}({rest})", f"{code}$1")
    return out


def unescape(text: Column) -> Column:
    for raw, code in (("[", "&lsqb;"), ("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _name(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def final_state(roles: Column) -> Column:
    """The last state of the machine over an array of roles; 'error' once an order is broken."""
    step = F.create_map(*[F.lit(x) for state, then in ORDER.items() for role in then for x in (f"{state}>{role}", role)])
    return F.aggregate(roles, F.lit(""), lambda s, r: F.coalesce(F.when(s != "error", F.try_element_at(step, F.concat(s, F.lit(">"), r))), F.lit("error")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, valid, formatted, segments array<struct<text, loss>>; one row for each conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(OTHER[0]), _name(t["role"]), F.lit(OTHER[1]))
        open_, close, loss = head, F.lit(OTHER[2]), F.lit(False)
        for role, turn in TEMPLATE.items():
            own = t["role"] == role
            open_, close, loss = F.when(own, F.lit(turn.open)).otherwise(open_), F.when(own, F.lit(turn.close)).otherwise(close), F.when(own, F.lit(turn.loss)).otherwise(loss)
        made = ((open_, F.lit(False)), (escape(t["text"]), loss), (close, F.lit(False)))
        return F.array(*[F.struct(x.alias("text"), y.alias("loss")) for x, y in made])

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", parts)))
    state = final_state(F.transform("turns", lambda t: t["role"]))
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*END_STATES).alias("valid"), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


_OPEN = "|".join([re.escape(t.open) for t in TEMPLATE.values()] + [f"{re.escape(OTHER[0])}[^>]*{re.escape(OTHER[1])}"])
_CLOSE = "|".join([re.escape(t.close) for t in TEMPLATE.values()] + [re.escape(OTHER[2])])


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> from the formatted string alone."""
    opens = F.regexp_extract_all(formatted, F.lit(_OPEN), F.lit(0))
    bodies = F.filter(F.split(formatted, f"{_OPEN}|{_CLOSE}", -1), lambda _, i: i % 2 == 1)

    def role(mark: Column) -> Column:
        out = unescape(F.substring(mark, F.lit(len(OTHER[0]) + 1), F.length(mark) - len(OTHER[0]) - len(OTHER[1])))
        for name, turn in TEMPLATE.items():
            out = F.when(mark == turn.open, F.lit(name)).otherwise(out)
        return out

    return F.zip_with(opens, bodies, lambda m, b: F.struct(role(m).alias("role"), unescape(b).alias("text")))
