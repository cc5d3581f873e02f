"""Conversation repair as the cheapest path through a composition of three transducers.

A conversation's rows are an input acceptor: one symbol a row, made of the
role's initial and the row's fault. The edit transducer keeps, reroles or
deletes a row, or inserts one; the role grammar accepts the initials
``(s?(ua)+)?``. The three are composed lazily: only the states that a
conversation reaches are made, and what one symbol does to the costs of the
four grammar states is remembered for the conversations that follow.

Weights are pairs (cost, label string), compared in this order. Concatenation
keeps the order of label strings on the left only, so distances are those to
the end, found from the last row to the first in topological order. From a
state each edit leads to one place at most, as the grammar tells the role of an
insertion or a reroling; so the labels of the arcs that leave a state differ,
and the first labels settle each tie between label strings. No string is kept.

Each row is dealt out once without its text and once with it. A task reads a
conversation's symbols, finds the edits, and then hashes or emits the texts one
by one, so it holds two or three bytes for each row of a conversation and one
text, however long the conversation is. The digest of a conversation is a
sequence of all its bytes; that is why its rows pass through one task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the role grammar: nothing yet, after s, after u, after a. What follows by reading s, u or a; -1 where nothing does.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
GRAMMAR = {"s": (AFTER_S, -1, -1, -1), "u": (AFTER_U, AFTER_U, -1, AFTER_U), "a": (-1, -1, AFTER_A, -1)}
FINAL = (START, AFTER_A)
INFINITE = 1 << 60
#: A row's symbol: its initial's place here, times four, plus its fault's.
INITIALS = "sua"
FAULTS = ("", "blank", "duplicate", "truncated")
ROLE_OF = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` chooses.

    Of its remainder by 20: 0 drops the row, 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 makes its role user. A null is one space in the
    crc32, as a role and as a text. Other columns are left out.
    """
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return rows.drop("copy")


class Steps:
    """The lazily composed transducer, read from the end: distances of the grammar states, and the arcs that reach them.

    A vector of distances is kept without its least one; it is one of few, as
    no state is dearer than another by more than a few edits. ``forward[k]``
    has, for each grammar state, (labels, next state) of the k-th step: the
    insertions before a row, and the row's own edit.
    """

    def __init__(self) -> None:
        self.vectors: dict[tuple, int] = {}
        self.known: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.distances: list[tuple] = []
        self.forward: list[list[tuple[str, int] | None]] = []
        last, self.ends = self._closed([(0, "", g) if g in FINAL else (INFINITE, "", g) for g in range(4)])
        self.end_cost, self.last = self._named(last)

    def _named(self, distances: tuple) -> tuple[int, int]:
        least = min(distances)
        vector = tuple(min(INFINITE, d - least) for d in distances)
        if vector not in self.vectors:
            self.vectors[vector] = len(self.distances)
            self.distances.append(vector)
        return least, self.vectors[vector]

    def _closed(self, row: list[tuple[int, str, int]]) -> tuple[tuple, list]:
        """Best of a row's own arcs and insertions before it; two insertions in a row lead through the grammar, a third leads back."""
        best = list(row)
        for _ in range(2):
            new = list(best)
            for g in range(4):
                for role in ROLE_OF:
                    to = GRAMMAR[role][g]
                    if to >= 0:
                        new[g] = min(new[g], (min(INFINITE, best[to][0] + INSERT), "I" + best[to][1], best[to][2]), key=lambda x: x[:2])
            best = new
        return tuple(x[0] for x in best), [(labels, to) if cost < INFINITE else None for cost, labels, to in best]

    def before(self, vector: int, symbol: int) -> tuple[int, int, int]:
        """(cost taken out, vector, step) after one more row to the left."""
        key = (vector, symbol)
        if key not in self.known:
            after = self.distances[vector]
            initial, fault = INITIALS[symbol >> 2 : (symbol >> 2) + 1], FAULTS[symbol & 3]
            stays = TRUNCATED if fault == "truncated" else 0
            row = []
            for g in range(4):
                arcs = [(min(INFINITE, after[g] + DELETE), "D", g)]
                if fault not in ("blank", "duplicate"):
                    if initial and GRAMMAR[initial][g] >= 0:
                        arcs.append((min(INFINITE, after[GRAMMAR[initial][g]] + stays), "K", GRAMMAR[initial][g]))
                    for role in ROLE_OF:
                        if GRAMMAR[role][g] >= 0:
                            arcs.append((min(INFINITE, after[GRAMMAR[role][g]] + stays + REROLE), "R", GRAMMAR[role][g]))
                row.append(min(arcs, key=lambda x: x[:2]))
            distances, arcs = self._closed(row)
            self.forward.append(arcs)
            self.known[key] = (*self._named(distances), len(self.forward) - 1)
        return self.known[key]

    def edits(self, symbols: bytes | bytearray) -> tuple[int, Iterator[str]]:
        """The cost of the cheapest repair, and for each row its labels, insertions first; what is inserted at the end comes last."""
        cost, vector, steps = self.end_cost, self.last, array("i")
        for symbol in reversed(symbols):
            less, vector, step = self.before(vector, symbol)
            cost += less
            steps.append(step)

        def walk() -> Iterator[str]:
            at = START
            for step in reversed(steps):
                labels, at = self.forward[step][at]
                yield labels
            yield self.ends[at][0]

        return cost + self.distances[vector][START], walk()


_steps: list[Steps] = []


def steps_of_worker() -> Steps:
    """One transducer for each worker process; what it has composed outlives a task."""
    if not _steps:
        _steps.append(Steps())
    return _steps[0]


class Repair:
    """One conversation's repair, row by row: (edit, role, text) in order, from edits found beforehand."""

    def __init__(self, symbols: bytearray):
        self.cost, walk = steps_of_worker().edits(symbols)
        self.audit = bytearray()
        for labels in walk:
            self.audit += labels.encode()
        self.length, self.place, self.at = len(self.audit) - self.audit.count(b"D"), 0, 0

    def _next_role(self) -> str:
        return "user" if (self.place - self.length % 2) % 2 == 0 else "assistant"

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == ord("I"):
            yield "I", self._next_role(), ""
            self.place += 1
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What stands for one row: insertions before it, then the row itself."""
        yield from self._inserted()
        edit = chr(self.audit[self.at])
        self.at += 1
        yield edit, self._next_role() if edit == "R" else role, text
        self.place += edit != "D"

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


REPORT = "conv long, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, repaired_sha256 string"
EDITS = "conv long, place long, turn long, edit string, fault string, role string, text string"


class _Counts:
    """Faults, turns and adjacent roles of one conversation, from its rows without texts."""

    def __init__(self) -> None:
        self.symbols, self.faults, self.illegal, self.before = bytearray(), [0, 0, 0, 0], 0, None
        self.least = self.most = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial or " "
        place = INITIALS.find(initial) if initial else -1
        self.symbols.append(4 * (place if place >= 0 else len(INITIALS)) + fault)
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn

    @property
    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns


def _repaired(edits: bool):
    """Over rows sorted by (conv, with_text, turn, role, digest): reports, or the rows of the repaired conversations with their edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in (EDITS if edits else REPORT).split(", ")]
        types = [pa.int64() if c.endswith("long") else pa.string() for c in (EDITS if edits else REPORT).split(", ")]
        held: list[tuple] = []
        conv: object = run  # no conversation yet; null is one
        counts = repair = digest = None
        last = (None, None)
        out = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        def put(items: Iterator[tuple[str, str, str]], turn: int | None, fault: int) -> None:
            nonlocal out
            for edit, role, text in items:
                if edits:
                    inserted = edit == "I"
                    held.append((conv, out, None if inserted else turn, edit, None if inserted else FAULTS[fault] or None, role, text))
                    out += 1
                elif edit != "D":
                    if out:
                        digest.update(b"\n")
                    digest.update(role.encode() + b":")
                    digest.update(text.encode())
                    out += 1

        def end() -> None:
            put(repair.rest(), None, 0)
            if not edits:
                held.append((conv, *counts.faults[1:], counts.illegal, counts.gaps, repair.cost, repair.audit.decode(), digest.hexdigest()))

        weight = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv", "with_text", "turn", "initial", "fault", "later", "digest", "role", "text"))
            for c, with_text, turn, initial, fault, later, name, role, text in zip(*columns, strict=True):
                if c != conv:
                    if repair is not None:
                        end()
                    conv, counts, repair, digest, out, last = c, _Counts(), None, hashlib.sha256(), 0, (None, None)
                if with_text and repair is None:
                    repair, last = Repair(counts.symbols), (None, None)
                # A row without other fault is a duplicate if its like stands in an earlier turn, or just before it.
                if fault != 1 and (later or (turn, name) == last):
                    fault = 2
                last = (turn, name)
                if with_text:
                    put(repair.row(role, text), turn, fault)
                    weight += len(text) + 50
                else:
                    counts.add(turn, initial, fault)
                if len(held) >= 5000 or (edits and weight > 4 << 20):
                    yield done(held)
                    held.clear()
                    weight = 0
        if repair is not None:
            end()
        if held:
            yield done(held)

    return run


def _ordered(rows: DataFrame, conv: str) -> DataFrame:
    """Each row twice, without and with its text, where its conversation goes, in order."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    faults = F.when(stripped == "", 1).when(~F.right(stripped, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    # Role and text are told apart by one digest; the role's length keeps them from running together.
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    marked = rows.select(F.col(conv).alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text", F.left("role", F.lit(1)).alias("initial"), faults.alias("fault"), F.unhex(name).alias("digest"))
    # The first turn of each role and text, by partial aggregates; a null turn is before all others.
    first = marked.groupBy("conv", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first_turn"))).alias("first"))
    met = marked.join(first.withColumnsRenamed({"conv": "conv_", "digest": "digest_"}), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")))
    later = ~F.col("turn").eqNullSafe(F.col("first.first_turn"))
    two = F.explode(F.array(F.lit(False), F.lit(True))).alias("with_text")
    both = met.select("conv", "turn", "initial", "fault", later.alias("later"), "digest", "role", "text", two)
    lean = both.select("conv", "with_text", "turn", "initial", "fault", "later", "digest", *(F.when(F.col("with_text"), F.col(c)).otherwise("").alias(c) for c in ("role", "text")))
    # The digest is of role and text, so it orders both copies of a row alike.
    return lean.repartition("conv").sortWithinPartitions("conv", "with_text", F.col("turn").asc_nulls_first(), "digest")


def repair_reports(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``rows(conv_id, turn, role, text)``: faults, cheapest edits and digest.

    A row's first fault counts: ``blank``, ``duplicate`` (role and text in an
    earlier row) or ``truncated`` (the last character isn't one of ``.!?``).
    ``gaps`` are missing turns, ``illegal`` adjacent roles that the grammar
    hasn't, ``cost`` and ``audit`` the cheapest edits (of several, those with
    the least string), ``repaired_sha256`` that of the repaired ``role:text``
    lines. ``every(conv_id)``: conversations that are told even if they have
    no rows; then all is zero or empty.

    Null conversations are one conversation, null turns come first and make no
    gap, null roles and texts are one space. Rows of one turn stand in the
    order of a digest of role and text. A role with another initial than s, u
    or a, or none, is never kept as it is. Long texts are hashed whole;
    repeated rows are duplicates; an empty table gives no rows; other columns
    are ignored.
    """
    rows = _filled(rows)
    found = _ordered(rows, "conv_id").mapInArrow(_repaired(False), REPORT).withColumnRenamed("conv", "conv_")
    if every is None:
        return found.withColumnRenamed("conv_", "conv_id")
    all_ = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = all_.join(found, F.col("conv_id").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn, edit, fault, role, text): each conversation's rows in order with the edit K, R, D or I of each.

    Deleted rows are told too (edit D); without them the rows are the repaired
    conversation. Inserted rows have no turn and an empty text. All else as in
    ``repair_reports``.
    """
    return _ordered(_filled(rows), "conv_id").mapInArrow(_repaired(True), EDITS).withColumnRenamed("conv", "conv_id")


def _filled(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
