"""Conversation structure repair: the cheapest edits after which roles run as one system row at most, then
user and assistant in turns.

A dynamic program over the rows in order keeps, for each of four states, the best audit (the initials of
its edits). Audits share their prefixes as linked nodes with ancestors at all powers of two and rolling
hashes, so equal costs are settled by a search for the longest common prefix."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import let

DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Column of ``damage`` for ``edits``: false for rows that only name their conversation.
THERE = "__there"
_SPACE = " \t\n\x0b\x0c\r"
#: Modulus and factor of the rolling hash (a Mersenne prime); rows after which a finished part of the edits is looked for.
MODULUS, FACTOR, PENDING = (1 << 61) - 1, 0x1F3D5B79, 512
# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)


class Node:
    """The last edit of an audit; ``up[k]`` is the node 2**k edits before."""

    __slots__ = ("depth", "edit", "hash", "up")

    def __init__(self, parent: Node | None = None, edit: str = ""):
        self.edit = edit
        self.depth = parent.depth + 1 if parent else 0
        self.hash = (parent.hash * FACTOR + ord(edit)) % MODULUS if parent else 0
        up = []
        while parent is not None:
            up.append(parent)
            k = len(up) - 1
            parent = parent.up[k] if len(parent.up) > k else None
        self.up = up

    def lifted(self, steps: int) -> Node:
        node, k = self, 0
        while steps >> k:
            if steps >> k & 1:
                node = node.up[k]
            k += 1
        return node


def shared(a: Node, b: Node) -> Node:
    """The last node that both audits go through."""
    a, b = a.lifted(max(0, a.depth - b.depth)), b.lifted(max(0, b.depth - a.depth))
    while a is not b:
        k = max((k for k in range(len(a.up)) if a.up[k] is not b.up[k]), default=0)
        a, b = a.up[k], b.up[k]
    return a


def before(x: Node, y: Node) -> bool:
    """True if the audit of ``x`` comes before that of ``y``. The longest common prefix is found by hashes and then verified."""
    a, b = x.lifted(max(0, x.depth - y.depth)), y.lifted(max(0, y.depth - x.depth))
    if a.hash != b.hash:
        for k in range(len(a.up) - 1, -1, -1):
            if k < len(a.up) and a.up[k].hash != b.up[k].hash:
                a, b = a.up[k], b.up[k]
        answer, a, b = a.edit < b.edit, a.up[0], b.up[0]
    else:
        answer = x.depth < y.depth
    while a is not b:  # equal by hash: one walk tells whether they are
        if a.edit != b.edit:
            answer = a.edit < b.edit  # a collision: the earliest difference counts
        a, b = a.up[0], b.up[0]
    return answer


class Best:
    """The better of candidates (cost, node before, edit), kept without a node until a tie needs one."""

    __slots__ = ("cost", "edit", "node", "parent")

    def __init__(self):
        self.cost, self.node, self.parent, self.edit = None, None, None, ""

    def offer(self, cost: int, parent: Node, edit: str) -> None:
        if self.cost is None or cost < self.cost:
            self.cost, self.node, self.parent, self.edit = cost, None, parent, edit
        elif cost == self.cost:
            node = Node(parent, edit) if edit else parent
            if before(node, self.made()):
                self.node = node

    def made(self) -> Node:
        if self.node is None:
            self.node = Node(self.parent, self.edit) if self.edit else self.parent
        return self.node


def _inserted(states: list) -> list:
    """States after any inserts that pay: an assistant row may follow a user row, a user row all others."""
    user = Best()
    if states[USER]:
        user.offer(*states[USER], "")
    for s in (START, SYSTEM, ASSISTANT):
        if states[s]:
            user.offer(states[s][0] + INSERT, states[s][1], "I")
    assistant = Best()
    if states[ASSISTANT]:
        assistant.offer(*states[ASSISTANT], "")
    if user.cost is not None:
        assistant.offer(user.cost + INSERT, user.made(), "I")
    return [states[START], states[SYSTEM], *[(b.cost, b.made()) if b.cost is not None else None for b in (user, assistant)]]


def _edited(states: list, initial: str, fault: int) -> list:
    """States after one row."""
    best = [Best() for _ in states]
    extra = CUT_OFF if fault == TRUNCATED else 0
    for s, known in enumerate(states):
        if not known:
            continue
        cost, node = known
        best[s].offer(cost + DELETE, node, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        to = ASSISTANT if s == USER else USER
        best[to].offer(cost + REROLE + extra, node, "R")
        if initial == ("a" if s == USER else "u"):
            best[to].offer(cost + extra, node, "K")
        elif initial == "s" and s == START:
            best[SYSTEM].offer(cost + extra, node, "K")
    known = [(b.cost, b.made()) if b.cost is not None else None for b in best]
    # Without a user row yet: whatever such a state can still lead to, an assistant row leads to as well, for one deletion (of a
    # system row) more at most. A state that costs more than that can't win, not even by a tie.
    usual = min((known[s][0] + more for s, more in ((USER, INSERT), (ASSISTANT, 0)) if known[s]), default=None)
    for s, more in ((START, DELETE), (SYSTEM, 0)):
        if usual is not None and known[s] and known[s][0] > usual + more:
            known[s] = None
    return known


class Repair:
    """The repair of one conversation, row by row. ``add`` and ``finish`` give the edits that are settled:
    what all four audits share is final, so only what they still dispute is kept."""

    def __init__(self):
        self.states: list = [(0, Node()), None, None, None]
        self.pending: deque = deque()
        self.look = PENDING
        self.state = START

    def add(self, row: tuple, initial: str, fault: int) -> Iterator[tuple]:
        self.states = _edited(_inserted(self.states), initial, fault)
        self.pending.append(row)
        if len(self.pending) >= self.look:
            yield from self._settle()
            self.look = max(PENDING, 2 * len(self.pending))

    def _settle(self) -> Iterator[tuple]:
        live = [s[1] for s in self.states if s]
        last = live[0]
        for node in live[1:]:
            last = shared(last, node)
        if not last.depth:
            return
        yield from self._applied(last)
        # The disputed rest hangs on a new root, so that the settled nodes can go.
        moved = {id(last): Node()}

        def rebased(node: Node) -> Node:
            path = []
            while id(node) not in moved:
                path.append(node)
                node = node.up[0]
            root = moved[id(node)]
            for n in reversed(path):
                root = moved[id(n)] = Node(root, n.edit)
            return root

        self.states = [s and (s[0], rebased(s[1])) for s in self.states]

    def _applied(self, node: Node) -> Iterator[tuple]:
        edits = []
        while node.up:
            edits.append(node.edit)
            node = node.up[0]
        for e in reversed(edits):
            row = None if e == "I" else self.pending.popleft()
            if e == "D":
                yield e, None, row
                continue
            role = row[1] if e == "K" else "assistant" if self.state == USER else "user"
            self.state = SYSTEM if e == "K" and role[:1] == "s" else ASSISTANT if self.state == USER else USER
            yield e, role, row

    def finish(self) -> Iterator[tuple]:
        states = _inserted(self.states)
        best = Best()
        for s in (START, ASSISTANT):
            if states[s]:
                best.offer(*states[s], "")
        yield from self._applied(best.made())


_EDITS = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("turn", pa.int64()),
                    ("was", pa.string()), ("fault", pa.int32())])
_EDITS_DDL = "conv_id long, edit string, role string, text string, turn long, was string, fault int"
#: Bytes of text of one batch of edits, about.
_BATCH = 4_000_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in _EDITS]
    held = 0

    def put(conv: int | None, edits: Iterator[tuple]) -> None:
        nonlocal held
        for e, role, row in edits:
            turn, was, text, fault = row or (None, None, "", None)
            held += len(text) + 64
            for column, value in zip(out, (conv, e, role, text, turn, was, fault), strict=True):
                column.append(value)

    def batch() -> pa.RecordBatch:
        nonlocal out, held
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _EDITS, strict=True)], schema=_EDITS)
        out, held = [[] for _ in _EDITS], 0
        return made

    conv, fold, rows = None, None, 0

    def close() -> None:
        put(conv, fold.finish())
        if not rows:
            put(conv, iter([(None, None, None)]))

    for b in batches:
        for key, turn, role, text, fault, there in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if fold is None or key != conv:
                if fold is not None:
                    close()
                conv, fold, rows = key, Repair(), 0
            if there:
                rows += 1
                put(conv, fold.add((turn, role, text, fault), role[:1], fault))
            if held > _BATCH:
                yield batch()
    if fold is not None:
        close()
    yield batch()


def fault_of(text: Column, seen: Column) -> Column:
    """Code of the first fault of a row: blank, duplicate, truncated; 0 for none."""
    return let(F.rtrim(text, F.lit(_SPACE)), lambda t: F.when(t == "", BLANK).when(seen, DUPLICATE).when(~F.right(t, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0))


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation of ``rows`` (conv_id, turn, role, text), in order within it.

    Each row is one edit: ``edit`` (K keep, R rerole, D delete, I insert), the ``role`` it leads to (null for D),
    ``text``, ``turn``, the role it ``was``, the ``fault`` of the row. A row whose column THERE is false only
    names its conversation; one without other rows yields a single row with a null edit. Rows go by turn (nulls
    first), ties by role and text. Null roles and texts count as one space, conversations with a null id are one.

    One exchange by conversation; the order is Spark's sort, which spills. A conversation streams through its
    task and only rows whose edits are still open stay in memory, so its length is not bounded by memory."""
    d = rows if THERE in rows.columns else rows.withColumn(THERE, F.lit(True))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    d = d.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), THERE)
    d = d.repartition("conv_id")
    same = W.partitionBy("conv_id", "role", "text", THERE).orderBy("turn")
    d = d.withColumn("copy", F.row_number().over(same)).withColumn("fault", fault_of(F.col("text"), F.col("copy") > 1))
    d = d.sortWithinPartitions("conv_id", "turn", "role", "text", "copy").select("conv_id", "turn", "role", "text", "fault", THERE)
    return d.mapInArrow(_fold, _EDITS_DDL)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, a row each: conv_id, role, text, in order within a conversation of a partition."""
    return edits(rows).where("edit in ('K', 'R', 'I')").select("conv_id", "role", "text")


_DIGEST = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Tally:
    def __init__(self, conv: int | None):
        self.conv, self.audit, self.sha = conv, [], hashlib.sha256()
        self.faults, self.illegal, self.cost, self.turns = [0, 0, 0, 0], 0, 0, 0
        self.least = self.last = self.was = None
        self.joint = b""

    def add(self, edit: str | None, role: str | None, text: str, turn: int | None, was: str | None, fault: int | None) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (CUT_OFF if fault == TRUNCATED and edit != "D" else 0)
        if edit != "D":
            self.sha.update(self.joint + f"{role}:{text}".encode())
            self.joint = b"\n"
        if edit == "I":
            return
        self.faults[fault] += 1
        if self.was is not None and self.was[:1] + was[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.was = was
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last
            self.last = turn

    def row(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally, done = None, []
    for b in batches:
        for conv, *rest in zip(*(b.column(i).to_pylist() for i in range(len(_EDITS))), strict=True):
            if tally is None or conv != tally.conv:
                if tally:
                    done.append(tally.row())
                tally = _Tally(conv)
            tally.add(*rest)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
            done = []
    if tally:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(tally.row(), _DIGEST, strict=True)], schema=_DIGEST)


def digest(script: DataFrame) -> DataFrame:
    """One row per conversation from its ``edits``: gaps, counts of faults, illegal neighbours, cost, audit and the
    hash of the repaired rows. It reads the edits as they stream by, without another exchange."""
    return script.mapInArrow(_digest, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _DIGEST))


def damage(rows: DataFrame) -> DataFrame:
    """Faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    stops, 3 repeats it, 4 makes it the user's. Nulls are one space. Dropped rows stay as rows whose THERE is false."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                    (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("fate"))
    new_text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"),
                    (F.col("fate") != 0).alias(THERE), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
