"""Operator 9: chat formatting by a finite-state machine over roles.

A declarative template gives each role its opening and closing mark and its loss flag.
The machine walks a conversation's turns in order, checks the role order and emits text
segments, each with a loss flag. Control strings inside texts are escaped reversibly: a
backslash is doubled, and a control string gets a backslash after its first character.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import column, partitions, written

#: role: (opening mark, closing mark, loss on the text). Other roles are written as ROLE.
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
ROLE = ("[ROLE]", "[/ROLE]", "[/TURN]")
#: state: {role: next state}; a turn without an entry breaks the order and leaves the state.
MACHINE = {
    "start": {"system": "open", "user": "asked"},
    "open": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}


def controls(template=None) -> list[str]:
    marks = [m for a, b, _ in (template or TEMPLATE).values() for m in (a, b)]
    return sorted({*marks, *ROLE}, key=len, reverse=True)


def escape(text: str, marks: list[str]) -> str:
    text = text.replace("\\", "\\\\")
    for m in marks:
        if m in text:
            text = text.replace(m, m[0] + "\\" + m[1:])
    return text


UNESCAPE = re.compile(r"\\(\\?)")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text) if "\\" in text else text


def turn_segments(role: str, text: str, template, marks):
    """The segments (text, loss) of one turn; a mark is never split over segments."""
    if role in template:
        a, b, loss = template[role]
        return [(a, False), (escape(text, marks), loss), (b, False)]
    return [(ROLE[0] + escape(role, marks) + ROLE[1], False), (escape(text, marks), False), (ROLE[2], False)]


def format_chat(turns: DataFrame, template: dict | None = None) -> DataFrame:
    """conv_id, seq, segment, loss, valid: the segments of every conversation, in order of seq.

    Turns are ordered by turn, role and text (nulls first), so repeated turns stay, in a
    fixed order. Null texts and roles are empty; roles outside the template are written with
    their name; a null conv_id is a conversation of its own. valid is false from the first
    turn on that breaks the role order (such turns are formatted all the same). Rows of a
    conversation stream through one task in sorted order, one Arrow batch at a time, so a
    conversation may be larger than memory. Other columns are ignored.
    """
    template = template or TEMPLATE
    marks = controls(template)
    turns = turns.select(column(turns, "conv_id", "long"), column(turns, "turn", "long"), column(turns, "role", "string"), column(turns, "text", "string"))
    dealt = turns.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        now, seq, state, valid = ("none",), 0, "start", True
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (conv,) != now:
                    now, seq, state, valid = (conv,), 0, "start", True
                step = MACHINE[state].get(role or "")
                state, valid = step or state, valid and step is not None
                for segment, loss in turn_segments(role or "", text or "", template, marks):
                    for col, x in zip(out, (conv, seq, segment, loss, valid), strict=True):
                        col.append(x)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "seq", "segment", "loss", "valid"])

    return dealt.mapInArrow(run, "conv_id long, seq long, segment string, loss boolean, valid boolean")


def reader(template: dict | None = None):
    """A pattern for one formatted turn, and the role of each of its groups."""
    template = template or TEMPLATE
    parts = [re.escape(a) + "(.*?)" + re.escape(b) for a, b, _ in template.values()]
    parts.append(re.escape(ROLE[0]) + "(.*?)" + re.escape(ROLE[1]) + "(.*?)" + re.escape(ROLE[2]))
    return re.compile("|".join(parts), re.S), list(template)


def read_back(segments: DataFrame, template: dict | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid: parsed from formatted segments."""
    pattern, roles = reader(template)
    closing = {b for _, b, _ in (template or TEMPLATE).values()} | {ROLE[2]}
    dealt = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches):
        import hashlib

        import pyarrow as pa

        class Held:
            def __init__(self, conv):
                self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
                self.n = self.chars = self.lost = 0
                self.valid, self.open = True, ""

            def add(self, segment, loss, valid):
                self.chars += len(segment)
                self.valid &= valid
                if loss:
                    plain = unescape(segment)
                    self.lost += len(plain)
                    self.loss.update(plain.encode("utf-8", "surrogatepass"))
                self.open += segment
                if segment in closing:
                    m = pattern.fullmatch(self.open)
                    if not m:
                        raise ValueError(f"conversation {self.conv}: a turn can't be read back")
                    i = m.lastindex - 1
                    role, text = (roles[i], m[i + 1]) if i < len(roles) else (unescape(m[len(roles) + 1]), m[len(roles) + 2])
                    self.turns.update(f"{role}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                    self.n += 1
                    self.open = ""

            def row(self):
                return (self.conv, self.n, self.turns.hexdigest(), self.lost, self.loss.hexdigest(), self.chars, self.valid)

        def table(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        held = None
        for batch in batches:
            rows = []
            for conv, segment, loss, valid in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        rows.append(held.row())
                    held = Held(conv)
                held.add(segment, loss, valid)
            yield table(rows)
        if held is not None:
            yield table([held.row()])

    return dealt.select("conv_id", "seq", "segment", "loss", "valid").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def formatted_digest(turns: DataFrame, template: dict | None = None) -> DataFrame:
    """Format, write, and read back."""
    return read_back(written(format_chat(turns, template), "chat"), template)

