"""Conversation structure repair: a Viterbi search whose survivors coalesce.

Turns of a conversation are read in order. For each state of the grammar of roles
(nothing yet, after system, after user, after assistant) one survivor is kept: the cheapest
edits that lead there. Survivors are leaves of a tree of back pointers with reference
counts. An edit that no survivor needs any more is dropped at once; as soon as all survivors share an
ancestor, the edits up to it are final and are emitted, so that memory holds the open part only.

Of equally cheap edits the least text of initials wins: two tied survivors are compared by
all their edits since their last common ancestor. That is exact: at the same turn and
cost neither text begins the other, since it would go on with inserts only, which cost more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Initial that is kept or made, states it may follow, state behind it.
MOVES = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
ROLES = {"u": "user", "a": "assistant"}
FINAL = (NOTHING, ASSISTANT)
BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Costs:
    """What edits cost; ``truncated`` is added for a truncated turn that stays. Inserts cost something."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Edit:
    """A node of the tree: an edit, with the role, text and turn that it leaves (role None: none)."""

    __slots__ = ("parent", "initial", "role", "text", "turn", "depth", "users", "children")

    def __init__(self, parent: Edit | None, initial: str, role: str | None = None, text: str = "", turn: object = None):
        self.parent, self.initial, self.role, self.text, self.turn = parent, initial, role, text, turn
        self.depth = parent.depth + 1 if parent else 0
        self.users, self.children = 0, []  # survivors that end here; nodes behind
        if parent:
            parent.children.append(self)


def _suffixes(a: Edit, b: Edit) -> tuple[str, str]:
    """Initials of two nodes since their last common ancestor."""
    x, y = [], []
    while a is not b:
        if a.depth >= b.depth:
            x.append(a.initial)
            a = a.parent
        else:
            y.append(b.initial)
            b = b.parent
    return "".join(reversed(x)), "".join(reversed(y))


class Survivors:
    """The search over one conversation. ``emit`` gets each final edit in order."""

    def __init__(self, emit: Callable[[Edit], None], costs: Costs):
        self.emit, self.costs = emit, costs
        i, d = costs.insert, costs.delete
        #: What [state][other] costs at most to go on from ``state`` as from ``other``: its inserts, or a deletion of the system's turn.
        self.switch = {
            NOTHING: {SYSTEM: 0, USER: i, ASSISTANT: 0}, SYSTEM: {NOTHING: max(d, 2 * i), USER: i, ASSISTANT: 2 * i},
            USER: {NOTHING: i + d, SYSTEM: i, ASSISTANT: i}, ASSISTANT: {NOTHING: d, SYSTEM: 0, USER: i},
        }
        self.root = Edit(None, "")
        self.best: dict[int, tuple[int, Edit]] = {}
        self._enter(self.best, NOTHING, 0, self.root)
        self._insert(self.best)

    def _enter(self, into: dict[int, tuple[int, Edit]], state: int, cost: int, node: Edit) -> None:
        """``node`` is the survivor of ``state`` if it is cheaper, or as cheap and of the lesser text."""
        node.users += 1
        if state in into:
            old_cost, old = into[state]
            if cost < old_cost or (cost == old_cost and (s := _suffixes(node, old))[0] < s[1]):
                self._leave(old)
            else:
                self._leave(node)
                return
        into[state] = cost, node

    def _leave(self, node: Edit) -> None:
        """One survivor less at ``node``; edits that none needs go."""
        node.users -= 1
        while node is not self.root and not node.users and not node.children:
            node.parent.children.remove(node)
            node = node.parent

    def _insert(self, into: dict[int, tuple[int, Edit]]) -> None:
        """Empty turns, a user's first: another user behind the assistant so made would only cost more."""
        for initial in "ua":
            after, state = MOVES[initial]
            for before in after:
                if before in into:
                    cost, node = into[before]
                    self._enter(into, state, cost + self.costs.insert, Edit(node, "I", ROLES[initial]))

    def turn(self, role: str, text: str, truncated: bool, faulty: bool, turn: object = None) -> None:
        """The next turn; a faulty one must be deleted."""
        into: dict[int, tuple[int, Edit]] = {}
        extra = self.costs.truncated if truncated else 0
        for state, (cost, node) in self.best.items():
            self._enter(into, state, cost + self.costs.delete, Edit(node, "D", turn=turn))
        for initial, (after, state) in MOVES.items():
            keeps = role[:1] == initial
            if faulty or not (keeps or initial in ROLES):
                continue
            for before in after:
                if before in self.best:
                    cost, node = self.best[before]
                    made = Edit(node, "K", role, text, turn) if keeps else Edit(node, "R", ROLES[initial], text, turn)
                    self._enter(into, state, cost + extra + (0 if keeps else self.costs.rerole), made)
        for _, node in self.best.values():
            self._leave(node)
        self.best = into
        self._insert(into)
        for state, (cost, node) in [*into.items()]:
            if any(c + self.switch[other][state] < cost for other, (c, _) in into.items() if other != state):
                del into[state]
                self._leave(node)
        self._settle()

    def _settle(self) -> None:
        """Emit the edits that all survivors share."""
        while not self.root.users and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.emit(self.root)

    def end(self) -> int:
        """The cost of the cheapest edits, all of which are emitted then."""
        last: dict[int, tuple[int, Edit]] = {}
        for state in FINAL:
            if state in self.best:
                self._enter(last, 0, *self.best[state])
        for _, node in self.best.values():
            self._leave(node)
        self.best = last
        self._settle()
        return last[0][0]


TURNS = "conv string, turn string, role string, text string, gone boolean, blank boolean, repeated boolean, truncated boolean"


def marked_turns(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, gone: Column) -> DataFrame:
    """TURNS in order, conversations whole in a partition: by turn, nulls first, then role and text.

    One shuffle by conversation; the first of equal turns is found by a window inside the same partitioning.
    A row that is ``gone`` only says that its conversation exists.
    """
    one = rows.select(conv.cast("string").alias("conv"), turn.alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), gone.alias("gone")).repartition("conv")
    ahead = Window.partitionBy("conv", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    one = one.withColumn("digest", F.sha2("text", 256)).withColumn("nth", F.row_number().over(ahead)).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "nth")
    blank = ~F.col("text").rlike(BLANK)
    return one.select("conv", F.col("turn").cast("string").alias("turn"), "role", "text", "gone", blank.alias("blank"), (F.col("nth") > 1).alias("repeated"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))


class Reading:
    """One conversation as it passes by: counts, search, and what is final so far."""

    def __init__(self, conv: str | None, costs: Costs):
        self.conv, self.ready = conv, []
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.last, self.before = 0, None, None, None, None
        self.search = Survivors(self.ready.append, costs)

    def row(self, turn: str | None, role: str, text: str, gone: bool, blank: bool, repeated: bool, truncated: bool) -> None:
        if gone:
            return
        fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
        if fault:
            self.n[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.turns, self.last, self.high = self.turns + 1, turn, int(turn)
            self.low = self.high if self.low is None else self.low
        self.search.turn(role, text, fault == "truncated", fault in ("blank", "duplicate"), turn)

    def gaps(self) -> int:
        return self.high - self.low + 1 - self.turns if self.turns else 0


def _conversations(frames: Iterator[pd.DataFrame], costs: Costs) -> Iterator[tuple[Reading, bool]]:
    """Each conversation after each of its turns, and once more when it has ended."""
    now: Reading | None = None
    for frame in frames:
        for conv, *row in zip(*[frame[c].astype(object).where(frame[c].notna(), None) for c in frame.columns], strict=True):
            if now is None or conv != now.conv:
                if now:
                    yield now, True
                now = Reading(conv, costs)
            now.row(*row)
            yield now, False
    if now:
        yield now, True


def repaired_turns(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv, place, edit, turn, role, text): every edit of ``marked_turns``, in order; deleted turns have a null role and text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, place = [], 0
        for reading, over in _conversations(frames, costs):
            if over:
                reading.search.end()
            for e in reading.ready:
                rows.append((reading.conv, place, e.initial, e.turn, e.role, e.text if e.role is not None else None))
                place += 1
            reading.ready.clear()
            place = 0 if over else place
            if len(rows) >= 1000:
                yield pd.DataFrame(rows, columns=["conv", "place", "edit", "turn", "role", "text"])
                rows = []
        yield pd.DataFrame(rows, columns=["conv", "place", "edit", "turn", "role", "text"])

    return turns.mapInPandas(run, "conv string, place long, edit string, turn string, role string, text string")


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_summary(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """SUMMARY of each conversation of ``marked_turns``: its faults, the cost and initials of the edits, and a hash of what they leave.

    Texts are hashed as they become final; a conversation's open turns and its initials are all that is held of it.
    A conversation is one row here and is read in order by one task, however long.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, audit, digest, lines = [], [], hashlib.sha256(), 0
        for reading, over in _conversations(frames, costs):
            cost = reading.search.end() if over else 0
            for e in reading.ready:
                audit.append(e.initial)
                if e.role is not None:
                    digest.update((("\n" if lines else "") + f"{e.role}:{e.text}").encode("utf-8", "surrogatepass"))
                    lines += 1
            reading.ready.clear()
            if over:
                done.append((reading.conv, reading.gaps(), *reading.n.values(), cost, "".join(audit), digest.hexdigest()))
                audit, digest, lines = [], hashlib.sha256(), 0
            if len(done) >= 1000:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in SUMMARY.split(", ")])
                done = []
        yield pd.DataFrame(done, columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return turns.mapInPandas(run, SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, gone) of ``conversations`` with faults put in by a hash of conversation and turn; a null is one blank."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return rows.select(
        F.col("conv_id").alias("conv"), "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``repair_summary`` of ``damaged`` rows, one row for each conversation that ``rows`` has.

    Nulls: a null conversation is one of its own, a null turn comes first, a null role or text is one
    blank. A role other than one that begins with s, u or a, an empty one too, cannot be kept. Equal turns go by role and
    text; repeated rows are duplicates from the second on. Other columns are not looked at; an empty table gives an empty result.
    """
    own = rows.schema["conv_id"].dataType
    d = damaged(rows)
    turns = marked_turns(d, F.col("conv"), F.col("turn"), F.col("role"), F.col("text"), F.col("gone"))
    return repair_summary(turns).withColumn("conv", F.col("conv").cast(own))
