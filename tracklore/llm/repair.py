"""Conversations repaired by their cheapest edits: lightest derivations, found by Knuth's agenda.

An item is (rows read, state), derived at a weight (cost, audit): the edits' cost and their
initials so far. Deductions read a row (keep, re-role, delete) or insert one, add to the cost
and append to the audit. They are superior functions: no conclusion is lighter than what it is
drawn from, as the audit before is a beginning of the audit after; and of two derivations of an
item the lighter stays lighter, as equal costs with one audit beginning the other would mean
insertions for nothing. So the lightest item on the agenda is final when it is popped, and the
first goal popped ends the search.

States are what the roles' initials so far make of ``(s?(ua)+)?``: nothing, s, ..u, ..ua.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

#: What the initials so far allow next; the goal may end in NONE or PAIRS.
NONE, SYSTEM, OPEN, PAIRS = range(4)
_NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): OPEN, (SYSTEM, "u"): OPEN, (OPEN, "a"): PAIRS, (PAIRS, "u"): OPEN}
#: The role that a state wants, and the state it leads to.
_WANTED = {NONE: ("user", OPEN), SYSTEM: ("user", OPEN), OPEN: ("assistant", PAIRS), PAIRS: ("user", OPEN)}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows whose items are on one agenda, and bytes of a conversation's turns that stay in memory.
_CHUNK, _HELD = 256, 8 << 20
_BLANK = r" \t\n\u000b\f\r"
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)

#: A row for the agenda: its role's initial and its fault.
Row = tuple[str, int]
Weight = tuple[int, str]


def deductions(state: int, row: Row) -> Iterator[tuple[int, str, int]]:
    """(cost, initial, next state) of each way to read ``row``."""
    initial, fault = row
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT_OFF else 0
    after = state if initial == "" else _NEXT.get((state, initial))
    if after is not None:
        yield more, "K", after
    yield REROLE + more, "R", _WANTED[state][1]


def agenda(starts: dict[int, Weight], rows: list[Row], last: bool) -> dict[int, Weight]:
    """The lightest weight of each state after ``rows``, from the states' weights before; with ``last`` of the goal only."""
    waiting = [(cost, audit, 0, state) for state, (cost, audit) in starts.items()]
    waiting.sort()
    done: set[tuple[int, int]] = set()
    ends: dict[int, Weight] = {}
    while waiting:
        cost, audit, at, state = heappop(waiting)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows):
            if last and state in (NONE, PAIRS):
                return {state: (cost, audit)}
            ends[state] = cost, audit
            if not last and len(ends) == 4:
                break
        else:
            for more, letter, after in deductions(state, rows[at]):
                if (at + 1, after) not in done:
                    heappush(waiting, (cost + more, audit + letter, at + 1, after))
        after = _WANTED[state][1]
        if (at, after) not in done:
            heappush(waiting, (cost + INSERT, audit + "I", at, after))
    return ends


class Repair:
    """The cheapest edits of one conversation, whose rows come in order; memory holds its audit and a chunk of rows.

    After each chunk of rows the states' lightest derivations are the axioms of the next; what
    their audits share is set aside.
    """

    def __init__(self) -> None:
        self._rows: list[Row] = []
        self._shared: list[str] = []
        self._starts: dict[int, Weight] = {NONE: (0, "")}

    def add(self, row: Row) -> None:
        if len(self._rows) == _CHUNK:
            ends = agenda(self._starts, self._rows, False)
            shared = commonprefix([audit for _, audit in ends.values()])
            self._shared.append(shared)
            self._starts = {state: (cost, audit[len(shared) :]) for state, (cost, audit) in ends.items()}
            self._rows = []
        self._rows.append(row)

    def finish(self) -> Weight:
        ((cost, audit),) = agenda(self._starts, self._rows, True).values()
        return cost, "".join(self._shared) + audit


def repaired(turns: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that ``audit`` leaves or inserts."""
    state, rest = NONE, iter(turns)
    for edit in audit:
        if edit == "I":
            role, state = _WANTED[state]
            yield edit, role, ""
            continue
        role, text = next(rest)
        if edit == "R":
            role, state = _WANTED[state]
        elif edit == "K":
            state = _NEXT.get((state, role[:1]), state)
        if edit != "D":
            yield edit, role, text


class _Turns:
    """A conversation's (role, text) in order; beyond a bound they wait in a temporary file."""

    def __init__(self) -> None:
        self._some: list[tuple[str, str]] = []
        self._bytes, self._file = 0, None

    def add(self, role: str, text: str) -> None:
        self._some.append((role, text))
        self._bytes += len(role) + len(text)
        if self._bytes > _HELD:
            self._file = self._file or tempfile.TemporaryFile()
            pickle.dump(self._some, self._file)
            self._some, self._bytes = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self._file:
            end = self._file.tell()
            self._file.seek(0)
            while self._file.tell() < end:
                yield from pickle.load(self._file)
        yield from self._some

    def close(self) -> None:
        if self._file:
            self._file.close()


class _Conversation:
    def __init__(self, key: object):
        self.key, self.turns, self.repair = key, _Turns(), Repair()
        self.counts, self.illegal, self.distinct = [0] * 4, 0, 0
        self.first = self.last = self.initial = None
        self.fresh = False

    def add(self, turn: object, role: str, text: str, fault: int) -> None:
        if fault != BLANK and not self.fresh:
            fault = DUPLICATE
        self.fresh = False
        self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        self.turns.add(role, text)
        self.repair.add((initial, fault))

    def gaps(self) -> int:
        return 0 if self.last is None else int(self.last - self.first + 1 - self.distinct)


def _fault(text: Column) -> Column:
    last = F.expr(f"right(trim(TRAILING '{_BLANK}' FROM __text), 1)")
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)


def repair(
    rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns: bool = False
) -> DataFrame:
    """One row per conversation: its faults, and its cheapest edits into ``(s?(ua)+)?`` of role initials.

    Columns: ``conv_id``, ``gaps`` (turns missing between the first and the last), ``blank``,
    ``duplicate`` (role and text seen earlier), ``truncated`` (not ended by ``.!?``), each row's
    first fault only, ``illegal`` (adjacent initials not su, ua or au), ``cost``, ``audit`` (the
    edits' initials: Keep, Rerole, Delete, Insert) and ``repaired_sha256`` of ``role:text`` lines.
    With ``turns``: ``conv_id``, ``place``, ``edit``, ``role``, ``text`` of each turn that is left.

    Which rows are first of their role and text is found by an aggregation, whose rows are sorted
    in as marks, so that no join and no table of seen texts is needed. A conversation's text is
    hashed in order, so its rows meet in one task, sorted by Spark; the task holds its audit, a
    chunk of rows and 8 MB of turns, and puts the rest aside in a temporary file.

    Defined cases: rows go by turn, null turns first; of one turn, by role and the text's MD5;
    null roles and texts are one space; null ids are one conversation; a row of role '' has no
    initial and may stay anywhere; an empty table gives an empty result; long texts count whole;
    other columns are ignored, whatever their names.
    """
    prepare(rows.sparkSession)
    named = rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("__text"),
    )
    known = named.select("conv_id", "turn", "role", F.unhex(F.md5("__text")).alias("digest"), _fault(F.col("__text")).alias("fault"), F.col("__text").alias("text"))
    when = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))
    firsts = known.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("at"))
    marks = firsts.select("conv_id", "at.turn", "role", "digest", F.lit(-1).alias("fault"), F.lit(None).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "digest", "fault"]
    both = known.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order)
    kind = both.schema["conv_id"].dataType.simpleString()
    if turns:
        schema = f"conv_id {kind}, place long, edit string, role string, text string"
    else:
        schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def ended(c: _Conversation) -> Iterator[tuple]:
        cost, audit = c.repair.finish()
        if turns:
            for place, x in enumerate(repaired(c.turns, audit)):
                yield (c.key, place, *x)
        else:
            digest = hashlib.sha256()
            for place, (_, role, text) in enumerate(repaired(c.turns, audit)):
                digest.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
            yield c.key, c.gaps(), *c.counts[1:], c.illegal, cost, audit, digest.hexdigest()
        c.turns.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size, kinds = None, [], 0, None
        names = [f.split()[0] for f in schema.split(", ")]

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kinds = [batch.column(0).type, *([pa.int64()] + [pa.string()] * 3 if turns else [pa.int64()] * 6 + [pa.string()] * 2)]
            for key, turn, role, fault, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "text")), strict=True):
                if now is None or key != now.key:
                    for row in ended(now) if now else ():
                        out.append(row)
                        size += sum(len(x) for x in row if isinstance(x, str))
                        if len(out) >= 2048 or size > 4 << 20:
                            yield ready()
                            out, size = [], 0
                    now = _Conversation(key)
                if text is None:
                    now.fresh = True
                else:
                    now.add(turn, role, text, fault)
        for row in ended(now) if now else ():
            out.append(row)
            if len(out) >= 2048:
                yield ready()
                out = []
        if out:
            yield ready()

    return both.drop("digest").mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes its role user; others stay. Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    hurt = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
