"""Chat formatting (operator 3), DataFrame functions only.

A declarative template gives the markers of a turn, the roles under the loss
mask and a finite-state machine over roles.  Each turn becomes three segments
(header, text, tail), each with a loss flag; only texts of loss roles have it.

Escaping is reversible: ``\\`` and the first character after ``<`` of a control
opening are prefixed by ``\\``, so no escaped text holds ``<|`` and the output
can be parsed back.  In role names, line feeds are prefixed too.

Rows of one conversation are first put together in blocks of ``block`` turns,
and blocks then in order, so a very long conversation is formatted by many
tasks; only ready-made segments meet.  The machine works the same way: a block
holds its map from every state to the state after it, and maps are composed.

Cases: null text or role counts as empty; null turns come first; rows of one
turn are ordered by role, then text; a null conv_id is one conversation of its
own; a conversation that the machine refuses is formatted, with valid = false;
repeated rows are turns of their own; texts are read whole, a conversation being
one row of the output, so at most 2 GB; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _looked_up(to: Column):
    return lambda state: F.element_at(to, state + 1)


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    role_end: str = "\n"
    end: str = "<|im_end|>"
    turn_end: str = "\n"
    control: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; what is missing leads to the refusing state.
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    initial: str = "begin"
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for marker in (self.start, self.end):
            if not marker.startswith(self.control):
                raise ValueError("markers begin with the control opening, which texts can't hold once escaped")

    @property
    def states(self) -> list[str]:
        return [*self.machine, "refused"]

    def step(self, role: Column, states: Column) -> Column:
        """The states after ``role``, given an array of state numbers."""
        names = self.states
        after = F.lit(None)
        for known in sorted({r for to in self.machine.values() for r in to}):
            to = F.array(*(F.lit(names.index(self.machine.get(s, {}).get(known, "refused"))) for s in names))
            after = F.when(role == known, F.transform(states, _looked_up(to))).otherwise(after)
        refused = F.transform(states, lambda s: F.lit(len(names) - 1))
        return F.coalesce(after, refused)

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        return F.replace(doubled, F.lit(self.control), F.lit(self.control[0] + self.escape + self.control[1:]))

    def escaped_role(self, role: Column) -> Column:
        return F.replace(self.escaped(role), F.lit(self.role_end), F.lit(self.escape + self.role_end))

    def unescaped(self, text: Column) -> Column:
        e = "\\" + self.escape
        return F.regexp_replace(text, f"(?s){e}(.)", "$1")


def format_chat(turns: DataFrame, template: Template | None = None, block: int = 64) -> DataFrame:
    """conv_id, segments (array of text, loss), valid; one row a conversation.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.
    """
    t = template or Template()
    names = t.states
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).alias("_block"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def segments(x: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(t.start), t.escaped_role(x["role"]), F.lit(t.role_end)), F.lit(False)),
            part(t.escaped(x["text"]), x["role"].isin(*t.loss_roles)),
            part(F.lit(t.end + t.turn_end), F.lit(False)),
        )

    identity = F.array(*(F.lit(i) for i in range(len(names))))
    blocks = (
        rows.groupBy("conv_id", "_block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_rows"))
        .select(
            "conv_id", "_block",
            F.flatten(F.transform("_rows", segments)).alias("segments"),
            F.aggregate("_rows", identity, lambda states, x: t.step(x["role"], states)).alias("_map"),
        )
    )
    return (
        blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_block", "segments", "_map"))).alias("_blocks"))
        .select(
            "conv_id",
            F.flatten(F.col("_blocks.segments")).alias("segments"),
            F.aggregate("_blocks", F.lit(names.index(t.initial)), lambda s, b: F.element_at(b["_map"], s + 1))
            .isin(*(names.index(s) for s in t.accepting)).alias("valid"),
        )
    )


def formatted(segments: Column) -> Column:
    """The text that the segments make up."""
    return F.concat_ws("", F.transform(segments, lambda s: s["text"]))


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or Template()
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescaped(s["text"])))


def parse(text: Column, template: Template | None = None) -> Column:
    """Reads a formatted text back: an array of (role, text)."""
    t = template or Template()
    quoted = lambda x: "\\Q" + x + "\\E"
    e, stop = "\\" + t.escape, quoted(t.role_end)
    pieces = F.split(text, quoted(t.end + t.turn_end), -1)
    head = f"(?s)^{quoted(t.start)}((?:{e}.|(?!{stop}).)*+){stop}"
    return F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(t.unescaped(F.regexp_extract(p, head, 1)).alias("role"), t.unescaped(F.regexp_replace(p, head, "")).alias("text")),
    )
