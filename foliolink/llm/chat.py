"""Chat formatting: a finite-state machine over roles and segments with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A declarative chat template.

    ``turns`` gives each role the marks before and after its text, ``loss`` the roles whose
    text is trained on, ``moves`` the legal steps between states and ``ends`` the states a
    conversation may end in; reading a role of the table leads to the state of its name. A
    role that isn't in ``turns`` gets ``other``, whose opening mark is followed by the escaped
    role and ``role_end``. No mark may contain a backslash, and each begins with a character
    that no mark has at another place.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]"),
            "user": ("[INST]", "[/INST]"),
            "assistant": ("[ANS]", "</s>"),
        }
    )
    other: tuple[str, str] = ("[ROLE]", "[/TURN]")
    role_end: str = "[/ROLE]"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    ends: tuple[str, ...] = ("assistant",)

    def marks(self) -> list[str]:
        all_marks = {self.begin, self.role_end, *self.other, *(m for pair in self.turns.values() for m in pair)}
        return sorted(all_marks, key=lambda m: (-len(m), m))


def _java(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def escape(text: Column, template: Template) -> Column:
    """Doubles backslashes and puts one after the first character of each mark inside a text."""
    heads = sorted({m[0] for m in template.marks()})
    rest = "|".join(_java(m[1:]) for m in template.marks())
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"([{''.join(_java(h) for h in heads)}])(?={rest})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``(conv, n_turns, segments, formatted, valid, state)``.

    ``segments`` are pieces of text with a loss flag; joined they are ``formatted``. Only the
    texts of ``template.loss`` roles are under the loss, marks never are. A state machine
    reads the roles in order: ``valid`` tells whether every step was legal and the last state
    may end a conversation, ``state`` is the last state, or ``error`` from the first illegal
    step on. Illegal conversations are formatted all the same. Turns are ordered by ``turn``
    (null first), then role and text, so ties have one order; repeated rows are turns too. A
    null text is the empty text, a null role the role ``""``. Null conversation ids are one
    conversation. A conversation is one output row, so its turns meet in one task. Other
    columns aren't read; an empty table gives an empty table.
    """
    t = template or Template()
    turns = rows.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(turn: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        role, text = turn["role"], escape(turn["text"], t)
        before = F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.role_end))
        after = F.lit(t.other[1])
        for name, (opening, closing) in t.turns.items():
            before = F.when(role == name, F.lit(opening)).otherwise(before)
            after = F.when(role == name, F.lit(closing)).otherwise(after)
        return F.array(piece(before, F.lit(False)), piece(text, role.isin(*t.loss)), piece(after, F.lit(False)))

    start = F.array(F.struct(F.lit(t.begin).alias("text"), F.lit(False).alias("loss")))
    step = F.create_map(*[F.lit(x) for state, to in t.moves.items() for role in to for x in (f"{state} {role}", role)])
    state = F.aggregate(
        "turns", F.lit("start"), lambda at, turn: F.coalesce(F.element_at(step, F.concat(at, F.lit(" "), turn["role"])), F.lit("error"))
    )
    return (
        grouped.select("conv", F.size("turns").cast("long").alias("n_turns"), F.concat(start, F.flatten(F.transform("turns", pieces))).alias("segments"), state.alias("state"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select(F.col("conv").alias(conv_col), "n_turns", "segments", "formatted", F.col("state").isin(*t.ends).alias("valid"), "state")
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: array of ``(role, text)``, unescaped."""
    t = template or Template()
    openings = {opening: (name, closing) for name, (opening, closing) in t.turns.items()}
    every = [*openings, t.other[0]]
    closings = [c for _, c in openings.values()] + [t.other[1]]
    found = F.regexp_extract_all(
        F.substring(formatted, len(t.begin) + 1, 2**31 - 1),
        F.lit(f"(?s)(?:{'|'.join(map(_java, every))}).*?(?:{'|'.join(map(_java, sorted(set(closings))))})"),
        F.lit(0),
    )

    def inner(turn: Column, opening: str, closing: str) -> Column:
        return F.substring(turn, F.lit(len(opening) + 1), F.length(turn) - len(opening) - len(closing))

    def turn_of(turn: Column) -> Column:
        body = inner(turn, *t.other)
        cut = F.locate(t.role_end, body)
        role, text = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + len(t.role_end), F.length(body))
        for opening, (name, closing) in openings.items():
            mine = F.startswith(turn, F.lit(opening))
            role, text = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, inner(turn, opening, closing)).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(found, turn_of)


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped, each piece once and in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
