"""Repair of the structure of conversations by the cheapest edits, in one stream over sorted turns."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

_SPACES = " \t\n\x0b\x0c\r"

# A sound conversation: nothing, or a system turn at most and then turns of user and assistant by pairs.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_SOUND_ENDS = (_START, _ASSISTANT)
_KEPT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_DUE = {_START: "user", _SYSTEM: "user", _ASSISTANT: "user", _USER: "assistant"}
_AFTER = {g: _ASSISTANT if g == _USER else _USER for g in _DUE}
_COST = {"K": 0, "R": 2, "D": 3, "I": 2}
_TRUNCATED = 1

_EDITS = "conv string, step long, edit string, fault string, turn long, old_role string, role string, text string"
_AUDITS = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Edits:
    """The states of the search and the steps between them, found as they are met.

    A state has, for each place in the pattern that the turns so far can have led to, the least cost above the
    cheapest place and the rank of its edits in ASCII order. Edits that end at two places differ before either
    ends, since both have as many turns behind them, so ranks decide between their continuations too. A step takes a
    state and a kind of turn and has one back pointer for each place: the place before, the inserts, and the edit.
    There are few states, so few steps, and a turn costs one look into ``steps``.
    """

    def __init__(self):
        self.states: list[tuple] = [((0, 0), None, None, None)]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[tuple[int, str, str], tuple[int, int, int]] = {}
        self.backs: list[tuple] = []

    def _reach(self, state: tuple) -> Iterator[tuple]:
        """Every place reached by inserts: cost, rank, inserts, where from, where to."""
        for at, known in enumerate(state):
            if known:
                to = at
                for n in range(3):
                    yield known[0] + n * _COST["I"], known[1], "I" * n, at, to
                    to = _AFTER[to]

    def step(self, number: int, kind: tuple[str, str]) -> tuple[int, int, int]:
        """The next state, what its cheapest place costs more, and the number of the back pointers."""
        initial, fault = kind
        best: list[tuple | None] = [None] * 4
        for cost, rank, inserts, at, mid in self._reach(self.states[number]):
            ways = [("D", mid, _COST["D"])]
            if fault not in ("blank", "duplicate"):
                more = _TRUNCATED if fault == "truncated" else 0
                ways.append(("R", _AFTER[mid], _COST["R"] + more))
                if (mid, initial) in _KEPT:
                    ways.append(("K", _KEPT[mid, initial], _COST["K"] + more))
            for edit, to, price in ways:
                way = (cost + price, rank, inserts + edit, at)
                if best[to] is None or way < best[to]:
                    best[to] = way
        found = [b for b in best if b]
        least = min(b[0] for b in found)
        order = sorted(b[1:3] for b in found)
        state = tuple(b and (b[0] - least, order.index(b[1:3])) for b in best)
        to = self.numbers.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
        self.backs.append(tuple(b and (b[3], b[2]) for b in best))
        made = self.steps[number, *kind] = (to, least, len(self.backs) - 1)
        return made

    def end(self, number: int) -> tuple[int, str, int]:
        """Cost above the cheapest place, last inserts, and the place they start from."""
        cost, _, inserts, at = min(way[:4] for way in self._reach(self.states[number]) if way[4] in _SOUND_ENDS)
        return cost, inserts, at


class _Conversation:
    """The turns of one conversation in order, and their back pointers.

    They are held in blocks of bounded size. All blocks but the last lie in an unnamed file of the task, which the
    system takes away with it; a repeated task begins anew.
    """

    def __init__(self, conv: str | None, edits: _Edits, block_rows: int, block_chars: int):
        self.conv, self.edits, self.block_rows, self.block_chars = conv, edits, block_rows, block_chars
        self.state, self.cost = 0, 0
        self.turns: list[tuple] = []
        self.backs = array("I")
        self.chars = 0
        self.file, self.blocks = None, []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.initial = 0, None
        self.first, self.last, self.distinct = None, None, 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        step = self.edits.steps.get((self.state, initial, fault)) or self.edits.step(self.state, (initial, fault))
        self.state, more, back = step
        self.cost += more
        self.turns.append((turn, role, text, fault))
        self.backs.append(back)
        self.chars += len(text) + 100
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if len(self.turns) >= self.block_rows or self.chars >= self.block_chars:
            self._spill()

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        at = self.file.tell()
        self.backs.tofile(self.file)
        pickle.dump(self.turns, self.file, pickle.HIGHEST_PROTOCOL)
        self.blocks.append((at, len(self.backs)))
        self.turns, self.backs, self.chars = [], array("I"), 0

    def _read(self, at: int, n: int) -> array:
        found = array("I")
        self.file.seek(at)
        found.fromfile(self.file, n)
        return found

    def chosen(self) -> tuple[int, Iterator[tuple]]:
        """The least cost, and each edit in order: edit, new role (of a deleted turn: none), turn or none."""
        cost, last, place = self.edits.end(self.state)
        return self.cost + cost, self._applied(last, place)

    def _applied(self, last: str, place: int) -> Iterator[tuple]:
        def walk(backs: array) -> array:
            """The places before each turn of a block, from its end."""
            nonlocal place
            for i in range(len(backs) - 1, -1, -1):
                before = self.edits.backs[backs[i]][place][0]
                backs[i], place = backs[i] << 2 | place, before
            return backs

        ways = walk(self.backs)
        for at, n in reversed(self.blocks):
            walked = walk(self._read(at, n))
            self.file.seek(at)
            walked.tofile(self.file)
        now = _START

        def told(ways: array, turns: list[tuple]) -> Iterator[tuple]:
            nonlocal now
            for way, turn in zip(ways, turns):
                _, edits = self.edits.backs[way >> 2][way & 3]
                for edit in edits:
                    if edit == "D":
                        yield "D", None, turn
                    elif edit == "K":
                        now = way & 3
                        yield "K", turn[1], turn
                    else:
                        yield edit, _DUE[now], turn if edit == "R" else None
                        now = _AFTER[now]

        for at, n in self.blocks:
            walked = self._read(at, n)
            yield from told(walked, pickle.load(self.file))
        yield from told(ways, self.turns)
        for edit in last:
            yield edit, _DUE[now], None
            now = _AFTER[now]
        if self.file:
            self.file.close()


def _edit_rows(talk: _Conversation) -> Iterator[tuple]:
    _, chosen = talk.chosen()
    for step, (edit, role, turn) in enumerate(chosen):
        number, old, text, fault = turn or (None, None, "", None)
        yield talk.conv, step, edit, fault, number, old, role, text


def _audit_row(talk: _Conversation) -> Iterator[tuple]:
    cost, chosen = talk.chosen()
    audit, digest, parts = bytearray(), hashlib.sha256(), 0
    for edit, role, turn in chosen:
        audit += edit.encode()
        if role is not None:
            digest.update(f"{chr(10) * (parts > 0)}{role}:{turn[2] if turn else ''}".encode())
            parts += 1
    yield talk.conv, talk.gaps, *talk.faults.values(), talk.illegal, cost, audit.decode(), digest.hexdigest()


def _stream(
    rows: DataFrame, conv: str, turn: str, role: str, text: str, told: Callable[[_Conversation], Iterator[tuple]], schema: str,
    block_rows: int, block_chars: int,
) -> DataFrame:
    """Dealt by conversation and sorted by turn; both sorts and the stream use one shuffle."""
    named = rows.select(
        rows[conv].alias("conv"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(rows[text].cast("string"), F.lit(" ")).alias("text"))
    again = W.partitionBy("conv", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    tail = F.rtrim(F.col("text"), F.lit(_SPACES))
    sorted_ = named.repartition("conv").withColumn("copy", F.row_number().over(again) > 1).withColumn(
        "fault", F.when(tail == "", "blank").when(F.col("copy"), "duplicate").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated"),
    ).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "copy")])
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edits, talk, out, chars = _Edits(), None, [], 0

        def flushed(talk: _Conversation | None, least: int) -> Iterator[pd.DataFrame]:
            nonlocal out, chars
            for row in told(talk) if talk else ():
                out.append(row)
                chars += len(row[7]) + 100
                if chars >= 4_000_000:
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                    out, chars = [], 0
            if len(out) >= least:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out, chars = [], 0

        for batch in batches:
            for name, number, role, text, fault in zip(*(batch[c].tolist() for c in ("conv", "turn", "role", "text", "fault"))):
                if talk is None or name != talk.conv:
                    yield from flushed(talk, 10_000)
                    talk = _Conversation(name, edits, block_rows, block_chars)
                talk.add(None if number is None else int(number), role, text, fault)
        yield from flushed(talk, 1)

    # As strings, since pandas would make floats of numbers with nulls.
    sent = sorted_.select(F.col("conv").cast("string"), F.col("turn").cast("string"), "role", "text", "fault")
    kind = rows.schema[conv].dataType
    return sent.mapInPandas(run, schema).withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_rows: int = 1 << 16, block_chars: int = 1 << 24,
) -> DataFrame:
    """One row per edit: the conversation, ``step`` (from 0), ``edit``, ``fault``, ``turn``, ``old_role``, ``role``, ``text``.

    The edits are the cheapest that make the first letters of the roles one system turn at most and then pairs of
    user and assistant: K keeps a turn (0), R gives it the other role of the two (2), D deletes it (3), I inserts one
    with an empty text (2). A turn whose text is blank, or whose role and text came earlier, has to go; one whose last
    sign is none of ``.!?`` and that stays costs 1 more. Of equally cheap edits those whose letters come first in
    ASCII order are taken. ``role`` is null for a deleted turn; the repaired conversation is the other rows.

    Turns are ordered by ``turn``, nulls first, and equal ones by role and text, so that the result does not depend on the order of
    rows. Null roles and texts count as one space. A null conversation is one like others. Other columns are
    ignored. An empty table gives no rows. A task holds one block of one conversation and spills the others with their back pointers.
    """
    return _stream(rows, conv, turn, role, text, _edit_rows, _EDITS, block_rows, block_chars)


def audits(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_rows: int = 1 << 16, block_chars: int = 1 << 24,
) -> DataFrame:
    """One row per conversation that ``repair`` has edits of: missing numbers of turns (``gaps``), faults by kind, ``illegal`` neighbours,
    the ``cost``, the letters of its edits (``audit``), and the SHA-256 of ``role:text`` of the repaired turns, joined by new lines."""
    return _stream(rows, conv, turn, role, text, _audit_row, _AUDITS, block_rows, block_chars)
