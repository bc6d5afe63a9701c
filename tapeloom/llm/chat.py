"""Chat formatting: a state machine over roles and a declarative template.

Turns stream through tasks in order, one conversation after the other, with only the
state of the conversation at hand in memory.  Every turn gives three text segments:
opening mark, body, closing mark; only bodies of the template's loss roles count for
the loss.  Control strings inside bodies are escaped so that they can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around each role's text, roles under the loss, and the order in which roles may follow."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    #: Marks of any other role; the name stands between the two opening marks.
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    loss: frozenset[str] = frozenset({"assistant"})
    #: Roles that may follow a state; a state is the last role, "" the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    accepts: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        controls = sorted({*self.other, *(m for pair in self.marks.values() for m in pair)}, key=lambda m: (-len(m), m))
        if any(len(m) < 2 or "\\" in m for m in controls):
            raise ValueError("marks have two characters or more and no backslash")
        object.__setattr__(self, "controls", re.compile("|".join(map(re.escape, controls))))

    def escape(self, text: str) -> str:
        """Doubles backslashes and puts one behind the first character of each control string."""
        text = text.replace("\\", "\\\\")
        # Marks can overlap, so go on until none is left.
        while (split := self.controls.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)) != text:
            text = split
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def render(self, role: str, text: str) -> tuple[str, str, str]:
        if role in self.marks:
            opening, closing = self.marks[role]
        else:
            opening, closing = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return opening, self.escape(text), closing

    def ended(self, turn: str) -> bool:
        """Whether formatted text, begun at a turn's opening mark, has come to its closing mark; bodies hold no mark."""
        if turn.startswith(self.other[0]):
            return self.other[1] in turn and turn.endswith(self.other[2])
        return any(turn.startswith(o) and len(turn) >= len(o) + len(c) and turn.endswith(c) for o, c in self.marks.values())

    def parse(self, turn: str) -> tuple[str, str]:
        """(role, text) of one formatted turn."""
        if turn.startswith(self.other[0]):
            role, _, rest = turn[len(self.other[0]) :].partition(self.other[1])
            return self.unescape(role), self.unescape(rest[: len(rest) - len(self.other[2])])
        role, (opening, closing) = next((r, m) for r, m in self.marks.items() if turn.startswith(m[0]))
        return role, self.unescape(turn[len(opening) : len(turn) - len(closing)])


def _ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def format_chat(turns: DataFrame, template: Template | None = None, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of all conversations: ``conversation``, ``seq``, ``text``, ``loss``, ``closes`` (last of its turn), ``in_order``.

    ``in_order`` is false from the first turn on that the state machine does not allow.
    Turns with equal numbers follow in order of role and text; a null turn number comes
    first, null role and text count as empty.  Turns of a null conversation are one
    conversation.  Other columns are not read.
    """
    template = template or Template()
    rows = turns.select(F.col(f"`{conversation}`").alias("c"), F.col(f"`{turn}`").alias("t"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("x"))
    kind = rows.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, good, seq = object(), "", True, 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("c", "seq", "text", "loss", "closes", "in_order")}
            for c, r, x in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if c != at:
                    at, state, good, seq = c, "", True, 0
                good = good and r in template.follows.get(state, ())
                state = r
                for i, piece in enumerate(template.render(r, x)):
                    for k, v in zip(out, (c, seq, piece, i == 1 and r in template.loss, i == 2, good), strict=True):
                        out[k].append(v)
                    seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(out["c"], batch.schema.field(0).type), pa.array(out["seq"], pa.int64()), pa.array(out["text"], pa.string()), *[pa.array(out[k], pa.bool_()) for k in ("loss", "closes", "in_order")]], names=list(out))

    return _ordered(rows, "c", "t", "r", "x").mapInArrow(run, f"c {kind}, seq bigint, text string, loss boolean, closes boolean, in_order boolean").withColumnRenamed("c", conversation)


def read_back(segments: DataFrame, template: Template | None = None, conversation: str = "conv_id") -> DataFrame:
    """One row a conversation: turns, what is under the loss, and ``valid``.

    Roles and texts of turns are parsed from the marks in the formatted text; ``loss`` tells
    what is under the loss, and ``in_order`` what the state machine allowed.  Digests run
    along with the segments; no more than a turn is held in memory.  Text behind the last
    closing mark is no turn; an empty table gives no row.
    """
    template = template or Template()
    rows = segments.select(F.col(f"`{conversation}`").alias("c"), "seq", "text", "loss", "in_order")
    kind = rows.schema["c"].dataType.simpleString()
    names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done, now = object(), [], None
        for batch in batches:
            for c, x, loss, good in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if c != at or now is None:
                    if now is not None:
                        done.append(_row(at, now, template))
                    at, now = c, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "pieces": [], "role": "", "good": True}
                now["chars"] += len(x)
                now["pieces"].append(x)
                if loss:
                    plain = template.unescape(x)
                    now["loss"].update(plain.encode())
                    now["loss_chars"] += len(plain)
                turn = "".join(now["pieces"])
                if template.ended(turn):
                    role, text = template.parse(turn)
                    now["all"].update(f"{role}\n{text}\n".encode())
                    now["turns"] += 1
                    now["pieces"], now["role"], now["good"] = [], role, good
            if len(done) >= 1000:
                yield _batch(done, batch.schema.field(0).type, names)
                done = []
        if now is not None:
            done.append(_row(at, now, template))
            yield _batch(done, batch.schema.field(0).type, names)

    schema = f"c {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    return _ordered(rows, "c", "seq").mapInArrow(run, schema).withColumnRenamed("c", conversation)


def _row(key, now: dict, template: Template) -> tuple:
    return key, now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"], now["good"] and now["role"] in template.accepts


def _batch(rows: Iterable[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
