"""Conversation structure repair: cheapest edits by Four-Russians block tables.

A conversation becomes one symbol a turn: what its role's initial is, whether its text
breaks off, or that it must go.  Before turn i, the costs of the cheapest way to the end
are a vector over what was said last (nothing, system, user, assistant).  Less its least
entry there are few such vectors, so the step over every block of four symbols from every
vector is one table lookup, made once from the rules below.  Conversations are stepped
over from the end, block by block; then each block is expanded backward from the vector
behind it, and the edits are read off forward, least initial first among equally cheap
ones, so ties are settled over the whole sequence.

Only symbols (one byte a turn), block vectors and edits of the conversation at hand are
in memory; texts are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks
from .mapping import fresh
from .storage import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
#: What was said last: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Symbols: a turn that must go, s/u/a/other, the same broken off, and what fills the last block.
GOES, WHOLE, BROKEN, PAD = 0, 1, 5, 9
SYMBOLS = 10
WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 20
#: What an inserted or reroled turn makes of each state: it says what comes next.
_NEXT = (USER, USER, ASSISTANT, USER)


def kept_state(kind: int, state: int) -> int | None:
    """The state after keeping a turn whose initial is s, u, a or another (0 to 3); none where it may not stand."""
    if kind == 0:
        return SYSTEM if state == NOTHING else None
    if kind == 1:
        return USER if state != USER else None
    return ASSISTANT if kind == 2 and state == USER else None


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of each edit of one turn, in the order of their initials."""
    out = [("D", DELETE, state)]
    if symbol != GOES:
        broken = TRUNCATED * (symbol >= BROKEN)
        to = kept_state((symbol - 1) % 4, state)
        if to is not None:
            out.append(("K", KEEP + broken, to))
        out.append(("R", REROLE + broken, _NEXT[state]))
    return out


def _with_inserts(cost: list[int]) -> list[int]:
    """Costs of the way to the end where turns may be inserted first."""
    u, a = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return [min(cost[NOTHING], INSERT + u), min(cost[SYSTEM], INSERT + u), u, a]


class Tables:
    """Normalised vectors, steps over one symbol and over blocks, and traces of blocks."""

    def __init__(self):
        end = _with_inserts([0, _FAR, _FAR, 0])
        self.vectors = [tuple(end)]
        known = {self.vectors[0]: 0}
        steps: list[list[tuple[int, int]]] = []
        while len(steps) < len(self.vectors):
            behind, row = self.vectors[len(steps)], []
            for symbol in range(SYMBOLS - 1):
                cost = _with_inserts([min(c + behind[to] for _, c, to in choices(symbol, q)) for q in range(4)])
                v = tuple(x - min(cost) for x in cost)
                if v not in known:
                    known[v] = len(self.vectors)
                    self.vectors.append(v)
                row.append((known[v], min(cost)))
            steps.append([*row, (len(steps), 0)])
        one = np.array(steps, dtype=np.int32)
        self.to, self.added = one[:, :, 0].T.copy(), one[:, :, 1].T.copy()
        # Blocks: the last symbol is stepped over first.
        to, added = self.to, self.added
        for _ in range(BLOCK - 1):
            n = to.shape[0]
            added = (added[None, :, :] + self.added[:, to]).reshape(SYMBOLS * n, -1)
            to = self.to[:, to].reshape(SYMBOLS * n, -1)
        self.block_to, self.block_added = to.astype(np.int16), added.astype(np.int16)
        self.traces: dict[tuple[int, int, int], tuple[bytes, int]] = {}

    def trace(self, block: int, behind: int, state: int) -> tuple[bytes, int]:
        """Edits of a block from a state on, and the state after it, by expanding the block backward."""
        key = (block, behind, state)
        if key not in self.traces:
            symbols = [block // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
            ways = [(behind, 0)]
            for s in reversed(symbols):
                v, base = ways[-1]
                ways.append((int(self.to[s, v]), base + int(self.added[s, v])))
            costs = [[base + x for x in self.vectors[v]] for v, base in reversed(ways)]
            said = []
            for i, s in enumerate(symbols):
                if s == PAD:
                    break
                while True:
                    left = costs[i][state]
                    if DELETE + costs[i + 1][state] == left:
                        said.append("D")
                        break
                    if INSERT + costs[i][_NEXT[state]] == left:
                        said.append("I")
                        state = _NEXT[state]
                        continue
                    edit, state = next((e, to) for e, c, to in choices(s, state)[1:] if c + costs[i + 1][to] == left)
                    said.append(edit)
                    break
            self.traces[key] = ("".join(said).encode(), state)
        return self.traces[key]

    def repair(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair; of equally cheap ones that whose edits come first in ASCII order."""
        s = np.frombuffer(symbols, dtype=np.uint8).astype(np.int32)
        s = np.concatenate([s, np.full(-len(s) % BLOCK, PAD, dtype=np.int32)]).reshape(-1, BLOCK)
        blocks = (s @ (SYMBOLS ** np.arange(BLOCK)[::-1])).tolist()
        v, cost = 0, 0
        behind = np.zeros(len(blocks), dtype=np.int16)
        for i in range(len(blocks) - 1, -1, -1):
            behind[i] = v
            cost += int(self.block_added[blocks[i], v])
            v = int(self.block_to[blocks[i], v])
        state, said = NOTHING, bytearray()
        for b, w in zip(blocks, behind.tolist(), strict=True):
            made, state = self.trace(b, w, state)
            said += made
        said += b"I" * {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
        return cost + self.vectors[v][NOTHING], said.decode()


@cache
def tables() -> Tables:
    return Tables()


def damaged(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Test damage by ``crc32(conversation:turn) % 20``: 0 takes a turn away, 1 empties it, 2 strips its ``.!?``, 3 repeats it, 4 makes it the user's.

    Nulls count as one space.  Columns: ``conv``, ``turn``, ``role``, ``text``, ``gone``
    (taken away; kept as a row, so every conversation stays known).
    """
    c, t = F.col(f"`{conversation}`"), F.col(f"`{turn}`")
    said = F.concat(F.coalesce(c.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(t.cast("string"), F.lit(" ")))
    rows = turns.select(c.alias("conv"), t.alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"), F.pmod(F.crc32(said.cast("binary")), F.lit(20)).alias("h"))
    h = F.col("h")
    return rows.select(
        "conv", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (h == 0).alias("gone"), F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _plain(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return turns.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), part(role).alias("role"), part(text).alias("text"), F.lit(False).alias("gone"))


#: Ascending, nulls first.
ORDER = ["conv", "kind", "turn", "role", "digest", "row"]


def _audits(rows: DataFrame) -> DataFrame:
    """One row a conversation from numbered rows: faults, cost and edits."""
    first = rows.where("not gone and fault = ''").groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn", "row")).alias("r")).select(F.col("r.row").alias("row"), F.lit(True).alias("first"))
    own = rows.select("conv", "turn", "role", "digest", "row", "gone", "fault", "broken").join(first, "row", "left")
    fault = F.when(F.col("fault") != "", F.col("fault")).when(F.col("first").isNull(), "d").when(F.col("broken"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(fault.isin("b", "d"), GOES).when(fault == "t", BROKEN + kind).otherwise(WHOLE + kind)
    own = own.select("conv", "turn", "role", "digest", "row", F.lit(1).alias("kind"), "gone", fault.alias("fault"), symbol.cast("int").alias("symbol"))
    conv = own.schema["conv"].dataType.simpleString()
    at = {c: i for i, c in enumerate(own.columns)}
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []
        kind = None
        for batch in batches:
            kind = batch.schema.field(at["conv"]).type
            columns = [batch.column(at[c]).to_pylist() for c in ("conv", "turn", "role", "gone", "fault", "symbol")]
            for c, t, r, gone, f, s in zip(*columns, strict=True):
                if c != now or state is None:
                    if state is not None:
                        done.append((now, *_judged(state)))
                    now, state = c, {"low": None, "last": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "role": None, "symbols": bytearray()}
                if gone:
                    continue
                if t is not None:
                    state["low"] = t if state["low"] is None else state["low"]
                    state["turns"] += t != state["last"]
                    state["last"] = t
                if f:
                    state[f] += 1
                if state["role"] is not None and state["role"] + r[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["role"] = r[:1]
                state["symbols"].append(s)
            if len(done) >= 1000:
                yield _table(done, kind, names)
                done = []
        if state is not None:
            done.append((now, *_judged(state)))
        if done:
            yield _table(done, kind, names)

    order = [ORDER[0], *ORDER[2:]]
    return own.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _judged(state: dict) -> tuple:
    cost, audit = tables().repair(state["symbols"])
    gaps = 0 if state["low"] is None else int(state["last"] - state["low"] + 1 - state["turns"])
    return gaps, state["b"], state["d"], state["t"], state["illegal"], cost, audit


def _table(rows: list[tuple], conv: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [conv, *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _repaired(turns: DataFrame) -> DataFrame:
    """Per conversation a row of its audit (``seq`` null), then its repaired turns in order; conversations stay in one partition each."""
    blank = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = written(
        turns.select("conv", "turn", "role", "text", "gone", F.unhex(F.sha2("text", 256)).alias("digest"), F.when(blank == "", "b").otherwise("").alias("fault"), (~F.right(blank, F.lit(1)).isin(".", "!", "?")).alias("broken"), F.monotonically_increasing_id().alias("row"))
    )
    audits = _audits(rows)
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    both = rows.where("not gone").select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "row", "text", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in facts])
    empty = [F.lit(None).cast(both.schema[c].dataType).alias(c) for c in ("turn", "role", "digest", "row", "text")]
    both = both.unionByName(audits.select("conv", F.lit(0).alias("kind"), *empty, *facts))
    at = {c: i for i, c in enumerate(both.columns)}
    conv = both.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, i, state, seq, now, kind = "", 0, NOTHING, 0, None, None
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            kind = batch.schema.field(at["conv"]).type
            out: list[tuple] = []
            heads = batch.column(at["kind"]).to_pylist()
            convs, roles, texts = (batch.column(at[c]) for c in ("conv", "role", "text"))
            for k, mark in enumerate(heads):
                if mark == 0:
                    for _ in edits[i:]:
                        state = _NEXT[state]
                        out.append((now, seq, ("user", "assistant")[state == ASSISTANT], "", *[None] * 7))
                        seq += 1
                    now = convs[k].as_py()
                    values = [batch.column(at[f])[k].as_py() for f in facts]
                    edits, i, state, seq = values[-1], 0, NOTHING, 0
                    out.append((now, None, None, None, *values))
                    continue
                while edits[i] == "I":
                    state = _NEXT[state]
                    out.append((now, seq, ("user", "assistant")[state == ASSISTANT], "", *[None] * 7))
                    i, seq = i + 1, seq + 1
                edit = edits[i]
                i += 1
                if edit == "D":
                    continue
                role = roles[k].as_py()
                if edit == "R":
                    state = _NEXT[state]
                    role = ("user", "assistant")[state == ASSISTANT]
                else:
                    state = kept_state("sua".find(role[:1]), state)
                out.append((now, seq, role, texts[k].as_py(), *[None] * 7))
                seq += 1
            if out:
                yield _rows(out, kind, facts)
        if len(edits) > i:
            out = []
            for _ in edits[i:]:
                state = _NEXT[state]
                out.append((now, seq, ("user", "assistant")[state == ASSISTANT], "", *[None] * 7))
                seq += 1
            yield _rows(out, kind, facts)

    return both.repartition("conv").sortWithinPartitions(*ORDER).mapInArrow(run, f"conv {conv}, seq long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _rows(rows: list[tuple], conv: pa.DataType, facts: list[str]) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "seq", "role", "text", *facts])


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """Repaired turns: ``conversation``, ``seq`` (from 0), ``role``, ``text``; with the audit in a row whose ``seq`` is null.

    Turns go by number, nulls first; turns of one number by role, then by SHA-256 of the
    text.  Null roles and texts count as one space, a null conversation is one, and a
    turn of another role or none has another initial: it can only go or be reroled.  The
    audit row has ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``
    and ``audit`` (initials of the edits in order); a conversation without turns has
    zeros.  ``damage`` applies :func:`damaged` first.  An empty table gives no row; other
    columns are not read, whatever their names.
    """
    rows = (damaged if damage else _plain)(turns, conversation, turn, role, text)
    return _repaired(rows).withColumnRenamed("conv", conversation)


def digests(repaired: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row a conversation from the rows of :func:`repair` as they come: its audit and ``repaired_sha256`` of ``role:text`` lines.

    The rows stream by without a shuffle, so this must follow ``repair`` directly.
    """
    own = fresh(repaired, "conv")
    rows = repaired.withColumnRenamed(conversation, own)
    at = {c: i for i, c in enumerate(rows.columns)}
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    conv = rows.schema[own].dataType.simpleString()
    names = [own, *facts, "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None

        def table(done: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            kind, done = batch.schema.field(at[own]).type, []
            seqs = batch.column(at["seq"]).to_pylist()
            roles, texts = batch.column(at["role"]), batch.column(at["text"])
            for k, seq in enumerate(seqs):
                if seq is None:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now = (batch.column(at[own])[k].as_py(), *[batch.column(at[f])[k].as_py() for f in facts])
                    digest = hashlib.sha256()
                    continue
                digest.update(f"{chr(10) if seq else ''}{roles[k].as_py()}:{texts[k].as_py()}".encode())
            if done:
                yield table(done)
        if now is not None:
            yield table([(*now, digest.hexdigest())])

    schema = f"`{own}` {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed(own, conversation)
