r"""Conversation structure repair: the cheapest edits that give a legal sequence of roles, by survivor coalescence.

A conversation's rows follow ``turn`` (null first), then role and text. A legal sequence has role initials
``(s?(ua)+)?``. Edits of a row: Keep (cost 0), Rerole to user or assistant (3), Delete (4; required for rows that are
blank or repeat role and text of an earlier row); an Insert of an empty user or assistant row (3) may stand anywhere;
a truncated row (its last character that is no blank is none of ``.!?``) that stays costs 3 more. Among the cheapest
edits those win whose initials, in order, come first in ASCII.

Search. Four states say what a sequence so far allows: nothing yet, after the system row, after a user row, after an
assistant row. Each keeps its cheapest path (a survivor) as a node of a tree of back pointers with counts of references;
runs of one edit are one node. A survivor that another one beats whatever follows is dropped, nodes that nothing refers
to go, and once all survivors share an ancestor the edits up to it are final and leave the tree. So what is held are the
edits on which survivors still differ. Ties are decided by the survivors' complete unresolved edits: their order is kept
from row to row, so no walk is needed, however long they are (paths of equal cost to one state cannot be prefixes of
each other, since the longer would hold more inserts and cost more).

Work and data movement. Rows alike in all four columns are combined where they lie, with their number, so repeated rows
without turns are one row. Rows are then dealt by ranges of conversation, turn, role and text and sorted: a conversation
of a third of all rows spans many ranges (segments). Segments are searched on narrow rows (initial, fault, number)
without texts: conversations inside one segment at once, those at its edges from each state they may be entered in, and
a conversation's segments, a few rows, are then chained. Texts meet their edits by segment again. A digest streams each
conversation's repaired rows through one hash, in order and with flat memory, as a hash asks for.

Null role or text counts as one space; rows without conv_id are one conversation; null turns come first and make no gaps.
Rows of one turn follow role, then text. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cmp_to_key
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import saved, small_side, workspace

KEEP, REROLE, DELETE, INSERT, TRUNCATED_ROW = 0, 3, 4, 3, 3
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing so far, after a system, a user, an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row of an initial leads, by state; and where a user or assistant row of the needed kind leads.
KEPT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


class Node:
    """A run of one edit; its parent is the edit before."""

    __slots__ = ("edit", "kids", "rank", "times", "tip", "up")

    def __init__(self, up: Node | None, edit: str, times: int = 1):
        self.up, self.edit, self.times, self.kids, self.tip, self.rank = up, edit, times, set(), False, 0


def inserts_between(a: Node, b: Node) -> str | None:
    """The inserts that lead from ``a`` to ``b``; None unless nothing else does."""
    out = ""
    while b is not a and b is not None and b.edit == "I":
        out, b = out + "I" * b.times, b.up
    return out if b is a else None


def precedes(a: Node, more_a: str, b: Node, more_b: str) -> bool:
    """Whether the path to ``a`` and ``more_a`` comes before the path to ``b`` and ``more_b``; both are survivors."""
    if a is b:
        return more_a < more_b
    if (between := inserts_between(a, b)) is not None:
        return more_a < between + more_b
    if (between := inserts_between(b, a)) is not None:
        return between + more_a < more_b
    return a.rank < b.rank


class Survivors:
    """The cheapest path to each state, from ``entry``. ``final`` holds the edits that all of them share."""

    def __init__(self, entry: int | None = None):
        """From a state, or from the begin of a conversation, where rows may be inserted."""
        self.root = Node(None, "")
        self.root.tip = True
        self.tips: dict[int, tuple[int, Node]] = {EMPTY if entry is None else entry: (0, self.root)}
        self.final: list[str] = []
        if entry is None:
            self._insert()

    def step(self, initial: str, fault: int, copies: int = 1) -> None:
        """A row, and further ones alike right after it."""
        if fault in (BLANK, DUPLICATE):
            self._delete(copies)
        else:
            best: dict[int, tuple[int, Node, str]] = {}
            more = TRUNCATED_ROW if fault == TRUNCATED else 0
            for state, (cost, node) in self.tips.items():
                self._offer(best, state, cost + DELETE, node, "D")
                self._offer(best, NEXT[state], cost + REROLE + more, node, "R")
                if (to := KEPT.get(initial, {}).get(state)) is not None:
                    self._offer(best, to, cost + KEEP + more, node, "K")
            self._move(best)
            if copies > 1:
                self._delete(copies - 1)
        self._insert()
        self._settle()

    @staticmethod
    def _offer(best: dict, state: int, cost: int, node: Node, edit: str) -> None:
        held = best.get(state)
        if held is None or cost < held[0] or (cost == held[0] and precedes(node, edit, held[1], held[2])):
            best[state] = (cost, node, edit)

    def _delete(self, times: int) -> None:
        self._move({state: (cost + DELETE * times, node, "D") for state, (cost, node) in self.tips.items()}, times)

    def _move(self, best: dict[int, tuple[int, Node, str]], times: int = 1) -> None:
        """The survivors become ``best``: by state, a cost and a survivor so far with its next edit."""
        order = sorted(best.items(), key=cmp_to_key(lambda x, y: -1 if precedes(x[1][1], x[1][2], y[1][1], y[1][2]) else 1))
        used = Counter(id(parent) for _, parent, _ in best.values())
        old = [node for _, node in self.tips.values()]
        for node in old:
            node.tip = False
        self.tips = {}
        for rank, (state, (cost, parent, edit)) in enumerate(order):
            if parent.edit == edit and parent is not self.root and not parent.kids and used[id(parent)] == 1:
                node = parent
                node.times += times
            else:
                node = Node(parent, edit, times)
                parent.kids.add(node)
            node.tip, node.rank = True, rank
            self.tips[state] = (cost, node)
        for node in old:
            self._release(node)

    def _insert(self) -> None:
        """Inserted rows, as long as they lead to a state more cheaply, or as cheaply and first in order."""
        changed = True
        while changed:
            changed = False
            for state, (cost, node) in list(self.tips.items()):
                to, cost = NEXT[state], cost + INSERT
                held = self.tips.get(to)
                if self.tips[state][1] is node and (held is None or cost < held[0] or (cost == held[0] and precedes(node, "I", held[1], ""))):
                    new = Node(node, "I")
                    new.tip, new.rank = True, node.rank
                    node.kids.add(new)
                    self.tips[to] = (cost, new)
                    if held is not None:
                        held[1].tip = False
                        self._release(held[1])
                    changed = True

    def _settle(self) -> None:
        """Drop survivors that cannot win, and hand out the edits that the others share.

        After an assistant row all that the empty sequence allows is allowed too, but for a system row, which may be
        deleted; and all that a system row allows.
        """
        least = self.tips[ASSISTANT][0]
        for state, slack in ((EMPTY, DELETE), (SYSTEM, 0)):
            if state in self.tips and self.tips[state][0] > least + slack:
                node = self.tips.pop(state)[1]
                node.tip = False
                self._release(node)
        while not self.root.tip and len(self.root.kids) == 1:
            self.root = self.root.kids.pop()
            self.root.up = None
            self.final.append(self.root.edit * self.root.times)

    def _release(self, node: Node) -> None:
        while node is not self.root and not node.tip and not node.kids and node.up is not None:
            up = node.up
            up.kids.discard(node)
            node = up

    def held(self) -> int:
        """Nodes of the tree."""
        n, todo = 0, [self.root]
        while todo:
            n += 1
            todo += todo.pop().kids
        return n

    def paths(self) -> dict[int, tuple[int, str]]:
        """By state, the cost and the edits."""
        done, out = "".join(self.final), {}
        for state, (cost, node) in self.tips.items():
            open_edits = []
            while node is not self.root:
                open_edits.append(node.edit * node.times)
                node = node.up
            out[state] = (cost, done + "".join(reversed(open_edits)))
        return out


def cheapest(paths: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """Of the paths to the states in which a conversation may end."""
    return min(paths[state] for state in (EMPTY, ASSISTANT) if state in paths)


def chained(parts: list[dict[int | None, dict[int, tuple[int, str]]]]) -> list[tuple[int, int, str]]:
    """For a conversation's segments in order, each with paths by state of entry (None: from its begin), the entry, cost
    and edits of each on the cheapest way through all."""
    now: dict[int, tuple[int, str, tuple]] = {}
    for k, part in enumerate(parts):
        new: dict[int, tuple[int, str, tuple]] = {}
        if k == 0:
            begin = {state: (cost, edits, ()) for state, (cost, edits) in Survivors().paths().items()} if None not in part else {}
            for state, (cost, edits) in part.get(None, {}).items():
                new[state] = (cost, edits, (None, (EMPTY, cost, edits)))
        else:
            begin = now
        for entry, (cost, edits, way) in begin.items():
            for state, (more, its) in part.get(entry, {}).items():
                piece = (entry, more, its) if k else (EMPTY, cost + more, edits + its)  # rows inserted at the begin go with the first
                path = (cost + more, edits + its, (way or None, piece))
                if state not in new or path[:2] < new[state][:2]:
                    new[state] = path
        shared = len(commonprefix([edits for _, edits, _ in new.values()]))  # decides nothing from here on
        now = {state: (cost, edits[shared:], way) for state, (cost, edits, way) in new.items()}
    way, out = min(now[state] for state in (EMPTY, ASSISTANT) if state in now)[2], []
    while way:
        way, piece = way
        out.append(piece)
    return out[::-1]


OPTIONS = "array<struct<entry:int,state:int,cost:bigint,edits:string>>"
PARTS_DDL = f"conv_id bigint, seg bigint, open boolean, options {OPTIONS}, illegal bigint, head string, tail string"
PIECES_DDL = "conv_id bigint, seg bigint, entry int, edits string, cost bigint, illegal bigint"


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Part:
    """The rows of one conversation in one segment. The first of a segment may have begun before it."""

    def __init__(self, conv_id: int | None, seg: int, first: bool):
        self.conv_id, self.seg, self.first = conv_id, seg, first
        self.searches: dict[int | None, Survivors] = {e: Survivors(e) for e in ((EMPTY, SYSTEM, USER, ASSISTANT) if first else (None,))}
        self.illegal, self.head, self.tail = 0, None, None

    def add(self, initial: str, fault: int, copies: int) -> None:
        for s in self.searches.values():
            s.step(initial, fault, copies)
        self.illegal += copies - 1 + (self.tail is not None and not legal(self.tail, initial))
        self.head = initial if self.head is None else self.head
        self.tail = initial

    def row(self, last: bool) -> dict:
        """What ``PARTS_DDL`` names; a conversation that began and ends inside has one way left."""
        if self.first or last:
            options = [{"entry": e, "state": state, "cost": cost, "edits": edits} for e, s in self.searches.items() for state, (cost, edits) in s.paths().items()]
        else:
            cost, edits = cheapest(self.searches[None].paths())
            options = [{"entry": None, "state": ASSISTANT, "cost": cost, "edits": edits}]
        return {"conv_id": self.conv_id, "seg": self.seg, "open": self.first or last, "options": options, "illegal": self.illegal, "head": self.head, "tail": self.tail}


OPTION_TYPE = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
PARTS_TYPE = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("open", pa.bool_()), ("options", OPTION_TYPE), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])
PIECES_TYPE = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("entry", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
ROWS_AT_ONCE = 2048


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, seg, pos, initial, fault, copies) by position to their parts."""
    part, out = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "seg", "initial", "fault", "copies")]
        for conv_id, seg, initial, fault, copies in zip(*columns, strict=True):
            if part is None or part.seg != seg or part.conv_id != conv_id:
                if part is not None:
                    out.append(part.row(part.seg != seg))
                part = Part(conv_id, seg, part is None or part.seg != seg)
            part.add(initial, fault, copies)
            if len(out) >= ROWS_AT_ONCE:
                yield pa.RecordBatch.from_pylist(out, PARTS_TYPE)
                out = []
    if part is not None:
        out.append(part.row(True))
    if out:
        yield pa.RecordBatch.from_pylist(out, PARTS_TYPE)


def joined(table: pa.Table) -> pa.Table:
    """The parts of one conversation that reach the edge of a segment, chained."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    parts = []
    for r in rows:
        by_entry: dict[int | None, dict[int, tuple[int, str]]] = {}
        for o in r["options"]:
            by_entry.setdefault(o["entry"], {})[o["state"]] = (o["cost"], o["edits"])
        parts.append(by_entry)
    out = []
    for k, (r, (entry, cost, edits)) in enumerate(zip(rows, chained(parts), strict=True)):
        across = k > 0 and not legal(rows[k - 1]["tail"], r["head"])
        out.append({"conv_id": r["conv_id"], "seg": r["seg"], "entry": entry, "edits": edits, "cost": cost, "illegal": r["illegal"] + across})
    return pa.Table.from_pylist(out, PIECES_TYPE)


REPAIRED_TYPE = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("nth", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
REPAIRED_DDL = "conv_id bigint, seg bigint, nth bigint, edit string, role string, text string"


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's edits (a row with ``edits``), then its rows by position, to the rows that are left."""
    out, size = [], 0
    edits, at, state, nth, key = "", 0, EMPTY, 0, (None, -1)

    def put(edit: str, role: str, text: str) -> None:
        nonlocal nth, size
        out.append({"conv_id": key[0], "seg": key[1], "nth": nth, "edit": edit, "role": role, "text": text})
        nth, size = nth + 1, size + len(text)

    def inserts() -> None:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = NEXT[state]
            put("I", NAMES[state], "")
            at += 1

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "seg", "role", "text", "copies", "edits", "entry")]
        for conv_id, seg, role, text, copies, its, entry in zip(*columns, strict=True):
            if its is not None:
                edits, at, state, nth, key = its, 0, entry, 0, (conv_id, seg)
            else:
                for _ in range(copies):
                    inserts()
                    edit = edits[at]
                    at += 1
                    if edit == "K":
                        state = KEPT[role[:1]][state]
                        put("K", role, text)
                    elif edit == "R":
                        state = NEXT[state]
                        put("R", NAMES[state], text)
            inserts() if at < len(edits) else None
            if len(out) >= ROWS_AT_ONCE or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, REPAIRED_TYPE)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, REPAIRED_TYPE)


def faulted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies and fault of all different rows; a fault holds for the first copy, and copies of
    rows that are not blank are duplicates."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"))
    rows = saved(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), sized=False)
    hashed = rows.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    alike = hashed.groupBy("conv_id", "role", "h1", "h2").agg(F.count("*").alias("n"), F.bool_or(F.col("turn").isNull()).alias("unplaced"), F.min("turn").alias("least"))
    repeated = saved(alike.where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h1").alias("a"), F.col("h2").alias("b"), "unplaced", "least"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    later = F.coalesce(F.when(F.col("unplaced"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("least")), F.lit(False))
    solid = F.btrim("text", F.lit(BLANKS))
    fault = F.when(solid == "", BLANK).when(later, DUPLICATE).when(~F.substring(solid, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    return hashed.join(small_side(repeated), same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def arranged(conversations: DataFrame) -> DataFrame:
    """The rows of ``faulted`` with ``pos``, their place among all rows, and ``seg``, the range they lie in; saved."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    rows = faulted(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("pos", 33)), sized=False)


def edits_of(rows: DataFrame) -> DataFrame:
    """conv_id, seg, entry, edits, cost, illegal of each segment of each conversation; saved. ``rows``: of ``arranged``."""
    narrow = rows.select("conv_id", "seg", "pos", F.substring("role", 1, 1).alias("initial"), "fault", "copies")
    parts = saved(narrow.repartition("seg").sortWithinPartitions("pos").mapInArrow(searched, PARTS_DDL), sized=False)
    way = F.col("options")[0]
    whole = parts.where("not open").select("conv_id", "seg", F.lit(EMPTY).alias("entry"), way["edits"].alias("edits"), way["cost"].alias("cost"), "illegal")
    return saved(whole.unionByName(parts.where("open").groupBy("conv_id").applyInArrow(joined, PIECES_DDL)), sized=False)


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, seg, nth (order), edit (K, R or I), role and text of the repaired conversations."""
    given = rows.select("conv_id", "seg", "pos", "role", "text", "copies", F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("entry"))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    guides = edits.select("conv_id", "seg", F.lit(-1).cast("long").alias("pos"), empty("role", "string"), empty("text", "string"), empty("copies", "long"), "edits", "entry")
    return given.unionByName(guides).repartition("seg").sortWithinPartitions("seg", F.asc_nulls_first("conv_id"), "pos").mapInArrow(applied, REPAIRED_DDL)


def repair(conversations: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: conv_id, seg, nth (order by both), edit (K, R or I), role, text."""
    with workspace(conversations.sparkSession) as keep:
        rows = arranged(conversations)
        out = saved(repaired_rows(rows, edits_of(rows)), sized=False)
        keep.append(out)
    return out


def hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and hash of each conversation's lines, which come in order."""
    now, key, out = None, None, []
    for batch in batches:
        for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if now is None or conv_id != key:
                if now is not None:
                    out.append((key, now.hexdigest()))
                now, key = hashlib.sha256(line.encode()), conv_id
            else:
                now.update(b"\n" + line.encode())
        if len(out) >= ROWS_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([h for _, h in out])], ["conv_id", "sha"])
            out = []
    if now is not None:
        out.append((key, now.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([h for _, h in out])], ["conv_id", "sha"])


def repair_report(conversations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """For each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``of``: a table whose every conv_id is in the result; without it, the conversations themselves."""
    with workspace(conversations.sparkSession) as keep:
        rows = arranged(conversations)
        edits = edits_of(rows)
        lines = repaired_rows(rows, edits).select("conv_id", "seg", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
        hashes = lines.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seg", "nth").mapInArrow(hashed_lines, "conv_id bigint, sha string")
        count = lambda fault, value: F.sum(F.when(F.col("fault") == fault, value).otherwise(0))
        copies = F.when(F.col("fault").isin(NO_FAULT, TRUNCATED), F.col("copies") - 1).when(F.col("fault") == DUPLICATE, F.col("copies")).otherwise(0)
        stats = rows.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            count(BLANK, F.col("copies")).alias("blank"),
            F.sum(copies).alias("duplicate"),
            count(TRUNCATED, F.lit(1)).alias("truncated"),
        )
        pieces = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "").alias("audit"))
        every = (conversations if of is None else of).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        # One grouping brings the four together, null conv_ids included.
        all_rows = every.unionByName(stats, allowMissingColumns=True).unionByName(pieces, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
        numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        out = saved(all_rows.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256")), sized=False)
        keep.append(out)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of conversation and turn: dropped, emptied, without sentence ends,
    repeated, or given to the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def damage_report(conversations: DataFrame) -> DataFrame:
    """``repair_report`` of the damaged conversations, with every conv_id of the table."""
    return repair_report(damaged(conversations), conversations)
