"""Conversations mended with the fewest edits.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``. Its rows, in
order of turn, are kept, given another role or deleted, and empty rows are inserted, at
the least cost; among equally cheap ways the one whose edits' initials read least in
ASCII is taken. Deleting is the only edit for blank and repeated rows.

The search is a Viterbi pass over four states: nothing written yet, after the system
row, after a user row, after an assistant row. Each state's survivor is a leaf of a tree
of edits with parent pointers and reference counts. Branches that no survivor descends
from are freed, and as soon as all survivors descend from one child of the root, that
child's edit is settled: it is emitted and becomes the root. So only the unsettled
edits are held, however long the conversation is. Equal costs are decided by the whole
unsettled stretch, from the survivors' common ancestor on: the letters there differ,
since a state, a row and a letter have one successor. Neither survivor's letters can
begin the other's: rows take one letter each, so the longer one would have more
inserts after the same letters, and cost more. A survivor is dropped once another can
imitate whatever it goes on with for less.

Conversations are dealt out by id and sorted by turn within a task, where they pass
through row by row: neither a conversation nor its texts are ever held together, and a
long one spills to disk in Spark's sort.

Nulls: a null id's rows are one conversation; null turns come first; a null role or text
is one space. Empty texts are blank. Ties in turn are ordered by role and text. Repeated
rows after the first are duplicates. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hirescope.llm.words import slices

RETAG, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: The state after a row that the conversation needs next, and that row's role.
_NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
_WHITE = " \t\n\x0b\x0c\r"
#: Output rows that a task hands over together.
BATCH = 2000


class Edit:
    """A node of the tree: one edit, and how many children and survivors refer to it."""

    __slots__ = ("parent", "letter", "role", "text", "depth", "refs", "children")

    def __init__(self, parent: Edit | None, letter: str, role: str = "", text: str = ""):
        self.parent, self.letter, self.role, self.text = parent, letter, role, text
        self.depth = parent.depth + 1 if parent else 0
        self.refs, self.children = 0, []
        if parent:
            parent.refs += 1
            parent.children.append(self)


def _freed(node: Edit) -> None:
    """Free a node that nothing refers to, and its ancestors that are then alike."""
    while node.refs == 0 and node.parent:
        parent = node.parent
        parent.children.remove(node)
        parent.refs -= 1
        node.parent, node = None, parent


def _reads_before(x: Edit, y: Edit) -> bool:
    """Whether the letters up to ``x`` come before those up to ``y``."""
    shorter = x.depth < y.depth
    while x.depth > y.depth:
        x = x.parent
    while y.depth > x.depth:
        y = y.parent
    if x is y:
        return shorter
    while x.parent is not y.parent:
        x, y = x.parent, y.parent
    return x.letter < y.letter


class Search:
    """Survivors of one conversation: cost and last edit by state."""

    def __init__(self) -> None:
        self.root = Edit(None, "")
        self.root.refs = 1
        self.alive: dict[int, tuple[int, Edit]] = {START: (0, self.root)}

    def _offer(self, to: dict[int, tuple[int, Edit]], state: int, cost: int, parent: Edit, letter: str,
               role: str = "", text: str = "") -> bool:
        held = to.get(state)
        if held and held[0] < cost:
            return False
        node = Edit(parent, letter, role, text)
        if held and held[0] == cost and not _reads_before(node, held[1]):
            _freed(node)
            return False
        node.refs = 1
        to[state] = cost, node
        if held:
            held[1].refs -= 1
            _freed(held[1])
        return True

    def _insert(self) -> None:
        """Survivors that insert rows at this place."""
        todo = [s for s in (START, SYSTEM, ASSISTANT, USER) if s in self.alive]
        while todo:
            cost, node = self.alive[state := todo.pop(0)]
            into, role = _NEXT[state]
            if self._offer(self.alive, into, cost + INSERT, node, "I", role) and into not in todo:
                todo.append(into)

    def push(self, role: str, text: str, kind: int) -> list[Edit]:
        """Take one row; what is settled by it."""
        self._insert()
        after: dict[int, tuple[int, Edit]] = {}
        extra = CUT_OFF if kind == TRUNCATED else 0
        for state, (cost, node) in self.alive.items():
            self._offer(after, state, cost + DELETE, node, "D")
            if kind not in (BLANK, DUPLICATE):
                into = _KEEP.get((role[:1], state))
                if into is not None:
                    self._offer(after, into, cost + extra, node, "K", role, text)
                into, other = _NEXT[state]
                self._offer(after, into, cost + RETAG + extra, node, "R", other, text)
        before, self.alive = self.alive, after
        for _, node in before.values():
            node.refs -= 1
            _freed(node)
        self._drop_hopeless()
        return self._settled()

    def _drop_hopeless(self) -> None:
        """After an assistant row everything can go on as from any other state, but for a
        system row, which can be deleted, and an assistant row, before which a user row
        can be inserted."""
        if ASSISTANT not in self.alive:
            return
        best = self.alive[ASSISTANT][0]
        for state, more in ((START, DELETE), (SYSTEM, 0), (USER, INSERT)):
            if state in self.alive and self.alive[state][0] > best + more:
                node = self.alive.pop(state)[1]
                node.refs -= 1
                _freed(node)

    def _settled(self) -> list[Edit]:
        out = []
        while self.root.refs == 1 and self.root.children:
            child = self.root.children.pop()
            child.parent, self.root = None, child
            out.append(child)
        return out

    def finish(self) -> tuple[int, list[Edit]]:
        """The least cost, and the edits not yet emitted."""
        self._insert()
        cost, best = self.alive[START] if START in self.alive else self.alive[ASSISTANT]
        if ASSISTANT in self.alive:
            other, node = self.alive[ASSISTANT]
            if other < cost or other == cost and _reads_before(node, best):
                cost, best = other, node
        out = []
        while best is not self.root:
            out.append(best)
            best = best.parent
        return cost, out[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with a fault in every fourth row or so, told by its id and turn.

    A dropped row stays, with ``there`` false, so that its conversation does.
    """
    one = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn")))
    fault = F.crc32(name) % 20
    text = F.coalesce("text", one)
    return turns.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", one)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault != 0).alias("there"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def in_order(turns: DataFrame) -> DataFrame:
    """Rows with their faults, a conversation's together and by turn; one shuffle, two sorts within it."""
    turns = turns.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    if "there" not in turns.columns:
        turns = turns.withColumn("there", F.lit(True))
    turn = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "there", "role", F.sha2("text", 256)).orderBy(turn)
    end = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))  # empty where the text is blank
    rows = turns.repartition("conv_id").withColumn("_seen", F.row_number().over(same)).withColumn("_end", end)
    kind = F.when(F.col("_end") == "", BLANK).when(F.col("_seen") > 1, DUPLICATE).when(
        ~F.col("_end").isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    return rows.withColumn("kind", kind).sortWithinPartitions("conv_id", turn, "role", "text", "_seen").select(
        "conv_id", F.col("turn").cast("long"), "role", "text", "there", "kind")


class Digest:
    """One conversation's measures, and the hash of what is written."""

    def __init__(self) -> None:
        self.counts, self.search = [0, 0, 0, 0], Search()
        self.first = self.last = self.before = None
        self.distinct = self.illegal = 0
        self.audit, self.hash, self.sep = [], hashlib.sha256(), ""

    def take(self, edits: list[Edit]) -> None:
        for e in edits:
            self.audit.append(e.letter)
            if e.letter != "D":
                self.hash.update(f"{self.sep}{e.role}:{e.text}".encode())
                self.sep = "\n"

    def push(self, turn: int | None, role: str, text: str, kind: int) -> None:
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.counts[kind] += 1
        self.take(self.search.push(role, text, kind))

    def row(self) -> tuple:
        cost, edits = self.search.finish()
        self.take(edits)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, *self.counts[1:], self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


def _conversations(turns: DataFrame, schema: T.StructType, opened: Callable, push: Callable, closed: Callable) -> DataFrame:
    """Stream each conversation's rows through a state; whatever ``push`` and ``closed`` yield are rows."""
    arrow = to_arrow_schema(schema)
    names = arrow.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        state = key = None
        for batch in slices(batches):
            for conv, *row, there, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        yield from closed(key, state)
                    key, state = conv, opened()
                if there:
                    yield from push(key, state, *row, kind)
        if state is not None:
            yield from closed(key, state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema=arrow)

    return in_order(turns).mapInArrow(run, schema)


def edits(turns: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: conv_id, step, edit, role, text (both null where deleted)."""
    schema = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("step", T.LongType()),
        *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))])

    def told(key, state, found: list[Edit]) -> Iterator[tuple]:
        for e in found:
            gone = e.letter == "D"
            yield key, state[1], e.letter, None if gone else e.role, None if gone else e.text
            state[1] += 1

    return _conversations(
        turns, schema, lambda: [Search(), 0],
        lambda key, state, turn, role, text, kind: told(key, state, state[0].push(role, text, kind)),
        lambda key, state: told(key, state, state[0].finish()[1]))


def audited(turns: DataFrame) -> DataFrame:
    """Each conversation's faults, the cost and letters of its repair, and the repaired text's hash."""
    schema = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType),
        *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        *(T.StructField(n, T.StringType()) for n in ("audit", "repaired_sha256"))])

    def push(key, state: Digest, *row) -> tuple:
        state.push(*row)
        return ()

    return _conversations(turns, schema, Digest, push, lambda key, state: [(key, *state.row())])
