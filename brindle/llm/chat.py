"""Chat formatting by a declarative template, with SQL functions only.

A template lists, for each role, what stands before and after a text and whether the text is under the loss, and
for the order of turns a finite-state machine as a map from (state, role) to state.  Control strings inside texts
are escaped, so the written output can be taken apart again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``other`` frames roles that ``turns`` lacks: the role's name stands between before and ``role_end``.

    Every ``before`` and ``after`` holds a control string and sets it off from the text by a blank or newline,
    which no control string contains: so none can arise where text and frame meet.
    """

    start: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>\n", "\n<</SYS>>\n"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("[OUT] ", " [/OUT]</s>", loss=True)})
    other: Turn = Turn("[TURN] ", " [/TURN]")
    role_end: str = " [ROLE] "
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[TURN]", "[/TURN]", "[ROLE]")
    escape: str = "␛"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
    )
    final: tuple[str, ...] = ("assistant",)

    def pairs(self) -> list[tuple[str, str]]:
        """What is replaced by what: the escape sign itself first, then the first sign of each control string."""
        signs = "0123456789abcdefghijklmnopqrstuvwxyz"
        return [(self.escape, self.escape + "0"), *((c, self.escape + signs[i] + c[1:]) for i, c in enumerate(self.controls, 1))]


def escaped(text: Column, template: Template) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), template.pairs(), text)


def unescaped(text: Column, template: Template) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(template.pairs()), text)


def _by_role(role: Column, template: Template, of) -> Column:
    return reduce(lambda c, t: F.when(role == t[0], of(t[1])).otherwise(c), reversed(list(template.turns.items())), of(template.other))


def format_chats(rows: DataFrame, template: Template | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: the id column, n_turns, segments (array of text and loss; joined they are the
    formatted conversation), state (where the machine ends, "error" if the order of roles isn't allowed), complete.

    Turns are put in order by turn, nulls first; ties, by role and text.  Null texts and roles count as empty,
    roles that the template lacks are framed with their name and lead to "error", and a null id is an id.  All
    conversations are formatted, valid or not.  One conversation is one value and must fit a task, as the
    formatted string must; copies and the number of conversations don't matter.
    """
    template = template or Template()
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def segments(t: Column) -> Column:
        known = t["role"].isin(*template.turns)
        name = F.when(known, F.lit("")).otherwise(F.concat(escaped(t["role"], template), F.lit(template.role_end)))
        before = F.concat(_by_role(t["role"], template, lambda x: F.lit(x.before)), name)
        no = F.lit(False)
        return F.array(
            F.struct(before.alias("text"), no.alias("loss")),
            F.struct(escaped(t["text"], template).alias("text"), _by_role(t["role"], template, lambda x: F.lit(x.loss)).alias("loss")),
            F.struct(_by_role(t["role"], template, lambda x: F.lit(x.after)).alias("text"), no.alias("loss")),
        )

    step = F.create_map(*(F.lit(x) for (state, name), to in template.transitions.items() for x in (f"{state} {name}", to)))
    start = F.array(F.struct(F.lit(template.start).alias("text"), F.lit(False).alias("loss")))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: F.coalesce(F.try_element_at(step, F.concat_ws(" ", s, t["role"])), F.lit("error")))
    out = grouped.select(conv, F.size("turns").cast("long").alias("n_turns"), F.concat(start, F.flatten(F.transform("turns", segments))).alias("segments"), state.alias("state"))
    return out.withColumn("complete", F.col("state").isin(*template.final))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss, unescaped, in order, nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template or Template())), "")


def parsed(text: Column, template: Template | None = None) -> Column:
    """A formatted conversation taken apart again: an array of role and text."""
    template = template or Template()
    frames = [*template.turns.items(), (None, template.other)]
    pattern = f"(?s)({'|'.join(re.escape(t.before) for _, t in frames)})(.*?)({'|'.join(re.escape(t.after) for _, t in frames)})"
    heads, bodies = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))

    def turn(head: Column, body: Column) -> Column:
        cut = F.instr(body, template.role_end)
        named = head == template.other.before
        role = reduce(lambda c, t: F.when(head == t[1].before, F.lit(t[0])).otherwise(c), template.turns.items(), F.substring(body, F.lit(1), cut - 1))
        rest = F.when(named, F.substring(body, cut + len(template.role_end), F.length(body))).otherwise(body)
        return F.struct(unescaped(role, template).alias("role"), unescaped(rest, template).alias("text"))

    return F.zip_with(heads, bodies, turn)
