"""Repair of conversations whose turns are missing, doubled, empty, cut off or under a wrong role.

A sound conversation reads, by the initials of its roles, ``s?(ua)+`` or nothing. Every turn is kept (0), given the
other role of user and assistant (1) or deleted (2), and empty turns can be inserted (5); blank and duplicate turns
must go and a truncated one that stays costs 5 more. The audit is the string of edits, K R D I, of least cost; of
several it is the first in ASCII order.

The audit is found by Wagner-Fischer alignment of the turns with each feasible target: the alternating string of every
length, with or without a leading s. All targets of one kind end alike, so one table of suffix costs (turns left, target
left) serves all lengths; Ukkonen's band keeps only cells that the cost of an incumbent, a greedy repair, can still pay for.
Each length of least cost is traced back, and the audits are compared. Table rows are kept every ``CHECKPOINT`` turns and
recomputed while tracing, so a conversation of n turns and cost c takes O(n c) time and O(c) memory for a row.

Turns are ranked, judged and counted with DataFrame functions. Alignment and rendering stream over partitions sorted by
conversation and place: a task holds one letter per turn of one conversation, as the audit itself does, and never its texts.

Defined cases: turns are ordered by turn (nulls first), then role, then text; a null role or text counts as one space;
rows without conv_id are one conversation; equal rows are duplicates of the first of them; other columns are ignored,
whatever their names; a conversation without turns has the empty audit; an empty table gives an empty result. Texts are used whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kindred.llm.common import materialise

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
CHECKPOINT = 256
CACHED = 64
NEVER = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"


def _incumbent(turns: str) -> int:
    """The cost of deleting every turn that does not fit as it is, or of deleting all."""
    cost, want = 0, "u"
    for c in turns:
        if c == want:
            want = "a" if want == "u" else "u"
        else:
            cost += DELETE
    return min(cost + (INSERT if want == "a" else 0), DELETE * len(turns))


class _Table:
    """Least cost to turn the last n - i turns into the last r letters of an alternating target.

    Row i has an entry for each surplus of turns, (n - i) - r, that the incumbent can pay for.
    """

    def __init__(self, turns: str):
        self.turns, self.n = turns, len(turns)
        self.limit = _incumbent(turns)
        self.low, high = -(self.limit // INSERT), self.limit // DELETE
        self.surplus = np.arange(self.low, high + 1)
        self.slope = INSERT * np.arange(len(self.surplus))
        self.saved: dict[int, np.ndarray] = {}
        self.block: tuple[int, list[np.ndarray]] = (-1, [])

    def last(self) -> np.ndarray:
        return np.where(self.surplus <= 0, -self.surplus * INSERT, NEVER)

    def before(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        left = self.n - i - self.surplus
        c = self.turns[i]
        row = np.full(len(after), NEVER)
        row[1:] = after[:-1] + DELETE
        if c != "x":
            cost = [(0 if c.lower() == target else REROLE) + (CUT if c.isupper() else 0) for target in "ua"]
            row = np.minimum(row, after + np.where(left % 2 == 0, cost[0], cost[1]) + np.where(left > 0, 0, NEVER))
        row[left < 0] = NEVER
        return np.minimum.accumulate((row + self.slope)[::-1])[::-1] - self.slope

    def fill(self) -> Iterator[tuple[int, np.ndarray]]:
        """Rows n, n - 1, ..., 0; some are saved."""
        row = self.last()
        for i in range(self.n, -1, -1):
            if i < self.n:
                row = self.before(i, row)
            if i % CHECKPOINT == 0 or i == self.n:
                self.saved[i] = row
            yield i, row

    def row(self, i: int) -> np.ndarray:
        start = i // CHECKPOINT * CHECKPOINT
        if self.block[0] != start:
            end = min(start + CHECKPOINT, self.n)
            rows = [self.saved[end]]
            for j in range(end - 1, start - 1, -1):
                rows.append(self.before(j, rows[-1]))
            self.block = (start, rows[::-1])
        return self.block[1][i - start]

    def trace(self, i: int, left: int) -> str:
        """The first audit in ASCII order that costs what the table says; D < I < K < R."""
        out = []
        row = self.row(i)
        while i < self.n or left:
            at = self.n - i - left - self.low
            after = self.row(i + 1) if i < self.n else None
            if after is not None and at > 0 and row[at] == after[at - 1] + DELETE:
                out.append("D")
                i, row = i + 1, after
            elif left and at + 1 < len(row) and row[at] == row[at + 1] + INSERT:
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.turns[i].lower() == "au"[left % 2 == 0] else "R")
                i, row, left = i + 1, after, left - 1
        return "".join(out)


def _align(turns: str) -> tuple[int, str]:
    table = _Table(turns)
    best, ends = NEVER, []
    for i, row in table.fill():
        left = table.n - i - table.surplus
        if i == 0:
            paid, fits = 0, (left >= 0) & (left % 2 == 0)
            ways = [(paid, "", fits)]
        else:
            ways = []
        if i and turns[i - 1] in "sS" and DELETE * (i - 1) <= table.limit:
            paid = DELETE * (i - 1) + (CUT if turns[i - 1] == "S" else 0)
            ways.append((paid, "D" * (i - 1) + "K", (left > 0) & (left % 2 == 0)))
        for paid, prefix, fits in ways:
            cost = np.where(fits, row + paid, NEVER)
            least = int(cost.min())
            if least < best:
                best, ends = least, []
            if least == best:
                ends += [(i, int(left[at]), prefix) for at in np.flatnonzero(cost == best)]
    return best, min(prefix + table.trace(i, left) for i, left, prefix in sorted(ends))


_cached = lru_cache(1 << 16)(_align)


def align(turns: str) -> tuple[int, str]:
    """(cost, audit). A letter per turn: s, u, a or o for the role's initial (o: other), upper case if truncated; x: must go."""
    return _cached(turns) if len(turns) <= CACHED else _align(turns)


def targets(audit: str) -> str:
    """The initials that the audit's K, R and I give, in their order; position i of the string is for the i-th of them."""
    n = sum(map(audit.count, "KRI"))
    return "s" * (n % 2) + "ua" * (n // 2)


def judged(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), turn, role, text, fault (null: none), letter (for :func:`align`), new_turn and illegal.

    ``illegal``: the turn's initial and the one's before it are not su, ua or au.
    """
    plain = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    copies = Window.partitionBy("conv_id", "role", "text").orderBy("turn")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "_copy")
    body = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(body == "", "blank").when(F.col("_copy") > 1, "duplicate")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    pair = F.concat(F.lag(initial).over(order), initial)
    return plain.withColumn("_copy", F.row_number().over(copies)).withColumn("fault", fault).select(
        "conv_id", F.row_number().over(order).cast("bigint").alias("place"), "turn", "role", "text", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), "x")
        .when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter).alias("letter"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
    )


def counts(rows: DataFrame) -> DataFrame:
    """conv_id, gaps (turn numbers missing between the first and the last), blank, duplicate, truncated, illegal."""
    of = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).cast("bigint").alias("gaps"),
        of("blank"), of("duplicate"), of("truncated"), F.count_if("illegal").alias("illegal"),
    )


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", *columns)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, cost and audit of judged rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, letters = False, None, []

        def out(done):
            found = [align(turns) for _, turns in done]
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in done], kind), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found])],
                names=["conv_id", "cost", "audit"],
            )

        kind, done = pa.null(), []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for this, letter in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not open_ or this != conv:
                    if open_:
                        done.append((conv, "".join(letters)))
                    open_, conv, letters = True, this, []
                letters.append(letter)
            if done:
                yield out(done)
                done = []
        if open_:
            yield out([(conv, "".join(letters))])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows.select("conv_id", "place", "letter"), "letter").mapInArrow(
        run, f"conv_id {kind}, cost bigint, audit string"
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object, str | None, str | None, str | None]]:
    """("open" | "turn" | "close", conv_id, role, text, edit), turn by turn; each conversation begins with its audit."""
    audit, target, at, put, conv, open_ = "", "", 0, 0, None, False

    def inserted(upto: int):
        nonlocal at, put
        while at < upto and audit[at] == "I":
            yield "turn", conv, ROLES[target[put]], "", "I"
            at, put = at + 1, put + 1

    for batch in batches:
        for this, role, text, plan in zip(*(c.to_pylist() for c in batch.columns)):
            if plan is not None:
                if open_:
                    yield from inserted(len(audit))
                    yield "close", conv, None, None, None
                audit, target, at, put, conv, open_ = plan, targets(plan), 0, 0, this, True
                yield "open", conv, None, None, None
                continue
            yield from inserted(len(audit))
            edit = audit[at]
            if edit != "D":
                yield "turn", conv, role if edit == "K" else ROLES[target[put]], text, edit
                put += 1
            at += 1
    if open_:
        yield from inserted(len(audit))
        yield "close", conv, None, None, None


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order."""
    none = F.lit(None).cast("string")
    plans = found.select("conv_id", F.lit(0).cast("bigint").alias("place"), none.alias("role"), none.alias("text"), "audit")
    turns = rows.select("conv_id", "place", "role", "text", none.alias("audit"))
    return _in_order(plans.unionByName(turns), "role", "text", "audit")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text and edit (K, R or I) of the repaired conversations, from judged rows and their audits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches_of(_edited(typed(batches))):
            rows_ = []
            for what, conv, role, text, edit in batch:
                place = 0 if what == "open" else place + (what == "turn")
                if what == "turn":
                    rows_.append((conv, place, role, text, edit))
            if rows_:
                columns = list(zip(*rows_))
                types = [kinds[0], pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "place", "role", "text", "edit"]
                )

    kinds: list[pa.DataType] = []

    def typed(batches):
        for batch in batches:
            kinds[:] = [batch.schema.field("conv_id").type]
            yield batch

    def batches_of(steps, size=1000):
        held = []
        for step in steps:
            held.append(step)
            if len(held) == size:
                yield held
                held = []
        yield held

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _with_audits(rows, found).mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string, edit string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: of the repaired turns as ``role:text``, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, done = [], []

        def typed():
            for batch in batches:
                kinds[:] = [batch.schema.field("conv_id").type]
                yield batch

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], kinds[0]), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"]
            )

        digest, begun = hashlib.sha256(), False
        for what, conv, role, text, _ in _edited(typed()):
            if what == "open":
                digest, begun = hashlib.sha256(), False
            elif what == "turn":
                digest.update(f"{chr(10) if begun else ''}{role}:".encode())
                digest.update(text.encode())
                begun = True
            else:
                done.append((conv, digest.hexdigest()))
                if len(done) == 1000:
                    yield out()
                    done.clear()
        if done:
            yield out()

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _with_audits(rows, found).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Faults put into turns, as a test of repair; which one depends on the CRC-32 of ``conv_id:turn`` modulo 20.

    0: the row is lost; 1: its text is emptied; 2: it loses its full stops, exclamation and question marks; 3: it is
    there twice; 4: its role becomes user. Nulls count as one space.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (
        turns.withColumn("_fault", F.crc32(name.cast("binary")) % 20).filter("_fault > 0")
        .select(
            "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"),
        ).drop("_copy")
    )


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and repaired_sha256 for every conv_id of ``conversations`` from the rows ``turns``."""
    rows = materialise(judged(turns), "judged-turns")
    found = materialise(audits(rows), "audits")
    parts = [counts(rows), found, repaired_digests(rows, found)]
    out = conversations.select("conv_id").distinct()
    for part in parts:
        part = part.withColumnRenamed("conv_id", "_of")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
