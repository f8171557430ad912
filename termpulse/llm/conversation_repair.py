"""Repair the structure of conversations: the cheapest edits after which the roles
are an optional system turn and then user and assistant in alternation.

One shuffle brings the turns of a conversation together, one secondary sort gives
them to ``mapInPandas`` twice: first without texts, last turn first, then with
texts, first turn first.

* **Backwards** the dynamic program carries, across Arrow batches, the cost of the
  best edits of all later turns for each of four states (nothing yet, after the
  system turn, after a user turn, after an assistant turn). Which edit is best in
  each state fits into one byte a turn. These backpointers wait in memory and,
  beyond ``SPILL`` bytes, in an unnamed file of the running task, as Spark's own
  sorts do; nothing but that task reads them.
* **Forwards** they are read from the end, each turn is kept, given another role,
  deleted or preceded by an empty turn, and the repaired text is hashed turn by turn.

No turn waits for its conversation: memory does not grow with its length, but for
the list of edits that is returned for it.

Turns are taken by number, those without one first; turns of the same number by
role and text. A turn's first fault counts: ``blank`` (only ASCII white space),
``duplicate`` (role and text seen earlier), ``truncated`` (the last character that
is not white space is none of ``.!?``). Keeping costs 0, another role 3, deletion 4,
an empty turn put in 3, a truncated turn that stays 3 more; blank and duplicate
turns must go. Of equally cheap edits those with the least list of initials (D, I,
K, R) count.

Defined cases: a null role or text is one space; a role that does not begin with s,
u or a (an empty one, too) can only be changed or deleted; rows whose conversation
is null form one conversation; a conversation of which no row is present has no
faults, no edits and an empty text; repeated rows are duplicates; a very long text
is held once, in its batch; an empty table gives an empty table; other columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"
#: Edits in the order of their initials; two bits each in a backpointer.
EDITS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. The state that a
#: user or assistant turn leads to, and the one that each initial leads to.
FOLLOWS = (2, 2, 3, 2)
KEEPS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
ROLES = {2: "user", 3: "assistant"}
#: Cost of the end in each state: an assistant turn, or a pair of turns, is put in.
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
SPILL = 1 << 20
LEGAL = {(0, 1), (1, 2), (2, 1)}


@lru_cache(maxsize=1 << 14)
def step(kind: int, later: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs in each state before a turn from those after it, and its backpointers."""
    initial, fault = divmod(kind, 4)
    best: list[tuple[int, int]] = []
    for state in range(4):
        options = [(DELETE_COST + later[state], DELETE)]
        if fault not in (1, 2):
            extra = TRUNCATED_COST if fault == 3 else 0
            if state in KEEPS[initial]:
                options.append((KEEP_COST + extra + later[KEEPS[initial][state]], KEEP))
            options.append((REROLE_COST + extra + later[FOLLOWS[state]], REROLE))
        best.append(min(options))
    # A turn put in leads to user or assistant; two in a row lead back there.
    for state in (2, 3, 0, 1):
        best[state] = min(best[state], (INSERT_COST + best[FOLLOWS[state]][0], INSERT))
    return tuple(cost for cost, _ in best), sum(edit << 2 * state for state, (_, edit) in enumerate(best))


class Backpointers:
    """Bytes written once and read from the last to the first."""

    def __init__(self, spill: int = SPILL):
        self.file = SpooledTemporaryFile(max_size=spill)  # noqa: SIM115  closed by its owner
        self.tail = bytearray()

    def add(self, byte: int) -> None:
        self.tail.append(byte)
        if len(self.tail) == 1 << 16:
            self.file.write(self.tail)
            self.tail = bytearray()

    def reversed(self) -> Iterator[int]:
        yield from reversed(self.tail)
        end = self.file.tell()
        while end:
            start = max(0, end - (1 << 16))
            self.file.seek(start)
            yield from reversed(self.file.read(end - start))
            end = start

    def close(self) -> None:
        self.file.close()


class Repair:
    """One conversation as it streams by."""

    def __init__(self, name: str | None, spill: int = SPILL):
        self.name = name
        self.costs, self.lowest = AT_END, 0
        self.back = Backpointers(spill)
        self.edits: Iterator[int] | None = None
        self.state, self.audit, self.digest, self.n_out = 0, bytearray(), hashlib.sha256(), 0
        self.counts = [0, 0, 0, 0]
        self.illegal, self.before = 0, None
        self.first = self.last = None
        self.n_turns = 0

    def look_back(self, kind: int) -> None:
        costs, byte = step(kind, self.costs)
        low = min(costs)
        self.lowest += low
        self.costs = tuple(c - low for c in costs)
        self.back.add(byte)

    def _put(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.digest.update(f"\n{role}:{text}".encode() if self.n_out else f"{role}:{text}".encode())
        self.n_out += 1
        return edit, role, text

    def _insert(self) -> tuple[str, str, str]:
        self.audit += b"I"
        self.state = FOLLOWS[self.state]
        return self._put("I", ROLES[self.state], "")

    def go_on(self, kind: int, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edits up to and with this turn."""
        initial, fault = divmod(kind, 4)
        self.counts[fault] += 1
        if self.before is not None and (self.before, initial) not in LEGAL:
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.last:  # turns come in order
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.n_turns += 1
        if self.edits is None:
            self.edits = self.back.reversed()
        byte = next(self.edits)
        while (edit := byte >> 2 * self.state & 3) == INSERT:
            yield self._insert()
        self.audit += EDITS[edit].encode()
        if edit == DELETE:
            yield "D", role, text
        else:
            self.state = FOLLOWS[self.state] if edit == REROLE else KEEPS[initial][self.state]
            yield self._put(EDITS[edit], ROLES[self.state] if edit == REROLE else role, text)

    def finish(self) -> Iterator[tuple[str, str, str]]:
        while self.state in (1, 2):
            yield self._insert()
        self.back.close()

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.n_turns
        cost = self.lowest + self.costs[0] if self.before is not None else 0
        return (self.name, gaps, *self.counts[1:], self.illegal, cost, self.audit.decode(), self.digest.hexdigest())


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """``conv, pass, place, kind, turn, numbered, role, text``: each turn twice, in the
    order in which the two passes want them; rows that are not present only once."""
    rows = turns.select(
        F.col(conv).cast("string").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(present, F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(present, F.coalesce(F.col(text), F.lit(" "))).alias("text"),
        present.alias("present"),
    ).repartition("conv")
    # Both windows and the last sort are of rows that are already together.
    same = Window.partitionBy("conv", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))
    in_order = Window.partitionBy("conv").orderBy("present", F.asc_nulls_first("turn"), "role", "text", "copy")
    rows = rows.withColumn("copy", F.row_number().over(same)).withColumn("at", F.row_number().over(in_order))
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(ended == "", 1).when(F.col("copy") > 1, 2).when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    )
    initial = F.lit(len(INITIALS))
    for code, letter in enumerate(INITIALS):
        initial = F.when(F.startswith(F.col("role"), F.lit(letter)), code).otherwise(initial)
    kind = F.when(F.col("present"), initial * 4 + fault).otherwise(-1).cast("int")
    rows = rows.withColumn("kind", kind)
    wide = F.struct(F.lit(1).alias("pass"), F.col("at").alias("place"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("numbered"), "role", "text")
    nothing = F.lit(None).cast("string")
    narrow = F.struct(F.lit(0).alias("pass"), (-F.col("at")).alias("place"), F.lit(0).cast("long").alias("turn"), F.lit(False).alias("numbered"), nothing.alias("role"), nothing.alias("text"))
    twice = rows.select("conv", "kind", F.explode(F.when(F.col("present"), F.array(narrow, wide)).otherwise(F.array(wide))).alias("r"))
    return twice.select("conv", "r.pass", "r.place", "kind", "r.turn", "r.numbered", "r.role", "r.text").sortWithinPartitions("conv", "pass", "place")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "place long, edit string, role string, text string"


def _streamed(rows: DataFrame, whole: bool, spill: int) -> DataFrame:
    """A summary per conversation, or (``whole``) every edit with its turn."""
    schema = f"conv string, {_TURNS if whole else _SUMMARY}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Repair | None = None
        out: list[tuple] = []
        n_edits, size = 0, 0

        def edited(edits):
            nonlocal n_edits, size
            for edit in edits:
                n_edits += 1
                if whole:
                    size += len(edit[2])
                    out.append((now.name, n_edits, *edit))

        def closed():
            edited(now.finish())
            if not whole:
                out.append(now.summary())

        for batch in batches:
            columns = (batch[c].tolist() for c in ("conv", "pass", "kind", "turn", "numbered", "role", "text"))
            for conv, second, kind, turn, numbered, role, text in zip(*columns, strict=True):
                if now is None or conv != now.name:
                    if now is not None:
                        closed()
                    now, n_edits = Repair(conv, spill), 0
                if kind < 0:
                    continue
                if second:
                    edited(now.go_on(kind, turn if numbered else None, role, text))
                else:
                    now.look_back(kind)
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if now is not None:
            closed()
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def repair(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: Column | None = None,
    whole: bool = False,
    spill: int = SPILL,
) -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``; or, with ``whole``, one row per edit: ``conv, place,
    edit, role, text``, in the order of ``place``.

    Rows where ``present`` is false only name their conversation. ``gaps`` are turn
    numbers missing between the least and the greatest, ``illegal`` are neighbours
    whose initials are not su, ua or au, ``audit`` are the initials of the edits and
    ``repaired_sha256`` is the digest of the lines ``role:text`` of what is left.
    """
    rows = _prepared(turns, conv, turn, role, text, F.lit(True) if present is None else present)
    kind = turns.schema[conv].dataType
    return _streamed(rows, whole, spill).withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: damage by the checksum of conversation and turn.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 removes ``.!?`` from
    it, 3 repeats the row and 4 makes it a user turn. A null is one space.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(F.concat_ws(":", *named)) % 20).alias("_d"))
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("_d") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    times = F.explode(F.array_repeat(F.col("_d") != 0, F.when(F.col("_d") == 3, 2).otherwise(1))).alias("present")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times)
