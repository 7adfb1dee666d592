"""Repair of conversations' structure by a lazily determinised weighted automaton.

A sound conversation's role initials are ``(s?(ua)+)?``. Keep, Rerole, Delete and Insert have costs, so the cheapest repair is
a shortest path through pairs of (row, state of that pattern). The costs of the four states after a row, less the smallest of them, are one state of a
deterministic automaton over nine kinds of rows; what a kind of row leads to is worked out when it is first met and kept
in a table, after which a row costs one look-up. States that can't be on a cheapest path any more are struck out of the
vectors (see ``_vector``), so there are only a few dozen. A trace back along tight arcs marks the states that lie on cheapest
repairs, and from the first row on the least letter among marked arcs is taken: that is the ASCII-least of the cheapest audits.

Rows of a conversation stream through one task in order, sorted by Spark. Of the conversation at hand a task holds four bytes
a row (state, marks, kind, letter); texts are read in a second stream, past their finished audit, and never held.

Defined results: a null conv_id is a conversation of its own. Null roles and texts are one space. Rows with one turn follow each other by
role and text, so repeated rows are neighbours. A row whose role is empty or begins with another letter than s, u, a can't be kept as it is. Empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 20
#: Pattern states: nothing yet, after s, after u, after a; what a kept initial leads to, and where u or a (one of them) may come next.
ARCS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FREE = tuple(next((n, i) for i, n in arcs.items() if i != "s") for arcs in ARCS)
FINAL = (0, 3)
#: Kinds of rows: initial (s, u, a, other), plus 4 if truncated; 8 has to go.
INITIALS = "sua"
GONE = 8
LETTERS = "DIKR"

COUNTS = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPORT = f"{COUNTS}, repaired_sha256 string"
ROWS = "conv_id bigint, place bigint, edit string, role string, text string"


class Determinised:
    """States and arcs of the deterministic automaton, as far as rows have asked for them."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}
        self.start = self._number(self._vector([0, NEVER, NEVER, NEVER])[0])

    def _number(self, vector: tuple[int, ...]) -> int:
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    @staticmethod
    def _vector(costs: list[int]) -> tuple[tuple[int, ...], int]:
        """Costs with inserts allowed, less their minimum, and the minimum.

        After an a, all is possible that is possible at the start but keeping an s, which can be deleted instead for 3; and all
        that is possible after an s. So the first two states are struck out once they cost over 3, or 0, more than it.
        """
        for _ in range(2):
            for q, (n, _i) in enumerate(FREE):
                costs[n] = min(costs[n], costs[q] + INSERT)
        if costs[0] > costs[3] + DELETE:
            costs[0] = NEVER
        if costs[1] > costs[3]:
            costs[1] = NEVER
        least = min(costs)
        return tuple(min(c - least, NEVER) if c < NEVER else NEVER for c in costs), least

    def step(self, state: int, kind: int) -> tuple[int, int]:
        """The next state, and what the row adds to the cost."""
        if (state, kind) not in self.arcs:
            costs = [NEVER] * 4
            for q, c in enumerate(self.vectors[state]):
                for _letter, n, cost in edits(q, kind):
                    costs[n] = min(costs[n], c + cost)
            vector, least = self._vector(costs)
            self.arcs[state, kind] = self._number(vector), least
        return self.arcs[state, kind]

    def ends(self, state: int) -> int:
        vector = self.vectors[state]
        return min(vector[q] for q in FINAL)

    def tight_inserts(self, state: int) -> list[tuple[int, int]]:
        v = self.vectors[state]
        return [(q, n) for q, (n, _i) in enumerate(FREE) if v[q] < NEVER and v[q] + INSERT == v[n]]

    def marked(self, state: int, marks: int) -> int:
        """Marks, and the states from which tight inserts lead to them."""
        for _ in range(2):
            for q, n in self.tight_inserts(state):
                marks |= (marks >> n & 1) << q
        return marks

    @lru_cache(maxsize=None)  # noqa: B019  one automaton a process
    def last_marks(self, state: int) -> int:
        ends = self.ends(state)
        return self.marked(state, sum(1 << q for q in FINAL if self.vectors[state][q] == ends))

    @lru_cache(maxsize=None)  # noqa: B019
    def tight(self, state: int, kind: int) -> tuple[tuple[int, str, int], ...]:
        """Tight edits of a row: (state of the pattern, letter, next state)."""
        (after, least), v = self.step(state, kind), self.vectors[state]
        return tuple((q, letter, n) for q in range(4) if v[q] < NEVER for letter, n, cost in edits(q, kind) if v[q] + cost - least == self.vectors[after][n])

    @lru_cache(maxsize=None)  # noqa: B019
    def marks_before(self, state: int, kind: int, marks: int) -> int:
        return self.marked(state, sum({1 << q for q, _letter, n in self.tight(state, kind) if marks >> n & 1}))

    @lru_cache(maxsize=None)  # noqa: B019
    def pick(self, state: int, kind: int, marks: int, q: int) -> tuple[str, int]:
        """The least letters from q through one row to a marked state, and that state."""
        here, inserts, letters = self.marks_before(state, kind, marks), dict(self.tight_inserts(state)), ""
        rows = {(p, letter): n for p, letter, n in self.tight(state, kind) if marks >> n & 1}
        while True:
            letter = next(x for x in LETTERS if (q, x) in rows or x == "I" and q in inserts and here >> inserts[q] & 1)
            letters += letter
            if letter != "I":
                return letters, rows[q, letter]
            q = inserts[q]

    @lru_cache(maxsize=None)  # noqa: B019
    def finish(self, state: int, q: int) -> str:
        v, letters, ends = self.vectors[state], "", self.ends(state)
        while not (q in FINAL and v[q] == ends):
            q, letters = FREE[q][0], letters + "I"
        return letters

    def repair(self, kinds: bytearray) -> tuple[int, str]:
        """Cost and audit of one conversation."""
        states, state, cost = array("H", [self.start]), self.start, 0
        for kind in kinds:
            state, more = self.arcs.get((state, kind)) or self.step(state, kind)
            cost += more
            states.append(state)
        marks = bytearray(len(states))
        marks[-1] = self.last_marks(state)
        for i in range(len(kinds) - 1, -1, -1):
            marks[i] = self.marks_before(states[i], kinds[i], marks[i + 1])
        q, audit = 0, []
        for i, kind in enumerate(kinds):
            letters, q = self.pick(states[i], kind, marks[i + 1], q)
            audit.append(letters)
        audit.append(self.finish(state, q))
        return cost + self.ends(state), "".join(audit)


def edits(q: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a row in a state of the pattern: (letter, next state, cost)."""
    yield "D", q, DELETE
    if kind != GONE:
        more, initial = TRUNCATED * (kind >= 4), INITIALS[kind % 4 : kind % 4 + 1]
        if initial in ARCS[q]:
            yield "K", ARCS[q][initial], more
        yield "R", FREE[q][0], REROLE + more


@lru_cache(maxsize=1)
def automaton() -> Determinised:
    return Determinised()


def prepared(rows: DataFrame, absent: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, absent, initial, fault (0 none, 1 blank, 2 truncated; duplicates later), same (identity of role and text)."""
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(False) if absent is None else absent).alias("absent"))
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(core == "", 1).when(~F.substring(core, -1, 1).isin(".", "!", "?"), 2).otherwise(0)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return d.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), same.alias("same"))


def in_order(df: DataFrame, *first: str) -> DataFrame:
    """A conversation's rows in one partition, after each other in their order."""
    return df.sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn")), "role", "same")


def pylists(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def rows_out(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
KINDS = [*[pa.int64()] * 7, pa.string()]


class Tally:
    """What is counted of one conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kinds, self.faults = conv_id, bytearray(), [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, initial: str, fault: int, repeated: bool) -> None:
        fault = 3 if repeated and fault != 1 else fault
        self.faults[fault] += 1
        at = INITIALS.find(initial) if initial else -1
        self.kinds.append(GONE if fault in (1, 3) else (at if at >= 0 else 3) + 4 * (fault == 2))
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn

    def row(self) -> tuple:
        cost, audit = automaton().repair(self.kinds)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, self.faults[1], self.faults[3], self.faults[2], self.illegal, cost, audit


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for conv_id, absent, turn, initial, fault, repeated in pylists(batch):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = Tally(conv_id)
            if not absent:
                now.add(turn, initial, fault, repeated)
            if len(done) >= 4096:
                yield rows_out(done, NAMES, KINDS)
                done = []
    yield rows_out(done + ([now.row()] if now is not None else []), NAMES, KINDS)


def audits(rows: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation of prepared rows; no text moves."""
    lean = rows.select("conv_id", "absent", "turn", "role", "initial", "fault", "same").repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "same").orderBy(F.col("turn").asc_nulls_first()))
    ordered = in_order(lean.withColumn("repeated", earlier > 1), "absent")
    return ordered.select("conv_id", "absent", "turn", "initial", "fault", "repeated").mapInArrow(count_batches, COUNTS)


class Repaired:
    """The repaired rows of one conversation, as they come out of its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.q, self.place = audit, 0, 0, 0

    def _made(self, edit: str, text: str) -> tuple[int, str, str, str]:
        self.q, initial = FREE[self.q]
        self.place += 1
        return self.place, edit, "user" if initial == "u" else "assistant", text

    def inserts(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._made("I", "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._made("R", text)
        elif edit == "K":
            self.q, self.place = ARCS[self.q][role[0]], self.place + 1
            yield self.place, "K", role, text


def follow_batches(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """whole: the repaired rows; otherwise the reports with the digest of these rows."""
    now = head = digest = None
    out: list[tuple] = []
    size = 0

    def put(made: Iterator[tuple[int, str, str, str]]) -> None:
        nonlocal size
        for place, edit, role, text in made:
            if whole:
                out.append((head[0], place, edit, role, text))
                size += len(text) + 64
            else:
                digest.update((("\n" if place > 1 else "") + f"{role}:{text}").encode())

    def close() -> None:
        if now is not None:
            put(now.inserts())
            if not whole:
                out.append((*head, digest.hexdigest()))

    names = ["conv_id", "place", "edit", "role", "text"] if whole else [*NAMES, "repaired_sha256"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3] if whole else [*KINDS, pa.string()]
    for batch in batches:
        for row in pylists(batch):
            if row[-1]:  # the audit comes first
                close()
                head, now, digest = row[:8], Repaired(row[7]), hashlib.sha256()
            else:
                put(now.row(row[8], row[9]))
            if len(out) >= 4096 or size >= 1 << 22:
                yield rows_out(out, names, kinds)
                out.clear()
                size = 0
    close()
    yield rows_out(out, names, kinds)


def followed(rows: DataFrame, whole: bool) -> DataFrame:
    told = audits(rows).select(*NAMES, F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("head"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("same"))
    there = rows.where(~F.col("absent")).select("conv_id", *(F.lit(None).cast("string" if c == "audit" else "bigint").alias(c) for c in NAMES[1:]), "role", "text", F.lit(False).alias("head"), "turn", "same")
    both = told.union(there).repartition("conv_id").withColumn("later", ~F.col("head"))
    ordered = in_order(both, "later").select(*NAMES, "role", "text", "head")
    return ordered.mapInArrow(partial(follow_batches, whole=whole), ROWS if whole else REPORT)


def report(rows: DataFrame, absent: Column | None = None) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows of every conversation in rows (conv_id, turn, role, text).

    Rows where ``absent`` holds count as not there, but their conversation is reported.
    """
    return followed(prepared(rows, absent), whole=False)


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of all repaired conversations: conv_id, place (from 1), edit (K, R or I), role, text."""
    return followed(prepared(rows), whole=True)


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with faults put in by a checksum of conv_id:turn, and which of them are to count as dropped."""
    blank = F.lit(" ")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    d = rows.select(
        "conv_id",
        "turn",
        F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (lot == 0).alias("dropped"),
        F.explode(F.when(lot == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return d, F.col("dropped")
