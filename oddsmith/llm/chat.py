"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: text before and after a turn of each role, and whether the loss covers
    its text; other: marks of unknown roles, whose name is written out. escape
    begins every escaped control character, so that no text can hold a mark."""

    marks: dict = field(default_factory=lambda: {"system": ("<|system|>", "<|end|>", False), "user": ("<|user|>", "<|end|>", False), "assistant": ("<|assistant|>", "<|end|>", True)})
    other: tuple = ("<|role:", "|>", "<|end|>")
    # Fixed pairs; the first is the escape character itself.
    escapes: tuple = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
    # state -> role -> state; anything else fails.
    machine: dict = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accept: tuple = ("answered",)

    def __post_init__(self):
        """Marks must begin with a character that escapes take out of texts, and turns end alike, or no text could be read back."""
        guarded = tuple(a for a, _ in self.escapes[1:])
        begins = [self.other[0], *(a for a, _, _ in self.marks.values())]
        if any(len(a) != 1 or not b.startswith(self.escapes[0][0]) for a, b in self.escapes) or len({b for _, b in self.escapes}) < len(self.escapes):
            raise ValueError("each escape stands for one character and begins with the escape character")
        if not all(m.startswith(guarded) for m in [*begins, self.other[2]]) or any(c not in guarded for c in self.other[1][:1]):
            raise ValueError("a mark must begin with an escaped character")
        if any(b != self.other[2] for _, b, _ in self.marks.values()) or any(m.startswith(k) for i, m in enumerate(begins) for j, k in enumerate(begins) if i != j):
            raise ValueError("turns must end alike, and no mark may begin another")


DEFAULT = Template()


def _swap(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: Column, t: Template = DEFAULT) -> Column:
    return _swap(text, t.escapes)


def unescaped(text: Column, t: Template = DEFAULT) -> Column:
    return _swap(text, [(b, a) for a, b in reversed(t.escapes)])


def _machine(roles: Column, t: Template) -> Column:
    edges = [(f"{s}\n{r}", to) for s, nexts in t.machine.items() for r, to in nexts.items()]
    table = F.create_map(*(F.lit(x) for e in edges for x in e))
    return F.aggregate(roles, F.lit("start"), lambda s, r: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), r)), F.lit("failed")))


def format_conversations(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """(conv_id, n_turns, valid, formatted, segments) from rows (conv_id, turn, role, text).

    segments: array of (piece, loss), whose pieces concatenate to `formatted`;
    loss marks exactly the texts of roles under the loss. Rows go by turn, then
    role and text as they are given (null turns first); null roles and texts count as empty. Rows
    with a null conv_id make one conversation. A conversation that the machine refuses is formatted
    all the same, with valid false. Repeated rows are repeated turns; other columns are ignored. The text of one
    conversation is one value, so it is built in one place, whatever its length.
    """
    raw = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), raw.alias("r")).groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    piece = lambda p, flag: F.struct(p.alias("piece"), flag.alias("loss"))

    def turn(x):
        role = x["role"]
        before = F.concat(F.lit(t.other[0]), escaped(role, t), F.lit(t.other[1]))
        loss = F.lit(False)
        for r, (a, _, flag) in t.marks.items():
            before, loss = F.when(role == r, a).otherwise(before), F.when(role == r, flag).otherwise(loss)
        return F.array(piece(before, F.lit(False)), piece(escaped(x["text"], t), loss), piece(F.lit(t.other[2]), F.lit(False)))

    rows = rows.withColumn("segments", F.flatten(F.transform("r", turn)))
    return rows.select(
        "conv_id",
        F.size("r").cast("long").alias("n_turns"),
        _machine(F.transform("r", lambda x: x["role"]), t).isin(*t.accept).alias("valid"),
        F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """array of (role, text) from a formatted text alone."""
    end = t.other[2]

    def turn(p):
        found = None
        for r, (a, _, _) in t.marks.items():
            value = F.struct(F.lit(r).alias("role"), unescaped(F.substring(p, len(a) + 1, F.length(p)), t).alias("text"))
            found = F.when(F.startswith(p, F.lit(a)), value) if found is None else found.when(F.startswith(p, F.lit(a)), value)
        close = F.instr(p, t.other[1])
        rest = F.struct(
            unescaped(F.substring(p, len(t.other[0]) + 1, close - len(t.other[0]) - 1), t).alias("role"),
            unescaped(F.substring(p, close + len(t.other[1]), F.length(p)), t).alias("text"),
        )
        return found.otherwise(rest)

    parts = F.split(formatted, "".join("\\" + c if not c.isalnum() else c for c in end), -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(segments: Column, t: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["piece"]), ""), t)
