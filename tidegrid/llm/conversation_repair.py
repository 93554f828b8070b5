"""Cheapest repairs of conversations: survivors of a Viterbi search, emitted when they coalesce.

A repaired conversation is empty, or one system turn at most and then user and assistant in turn.  Edits of a row:
Keep (nothing), Rerole to user or assistant (3), Delete (4; a must for blank and duplicate rows); between rows
Insert of an empty user or assistant turn (3).  A truncated row that stays costs 3 more.  Of equally cheap
repairs the one whose edits, written D, I, K, R in order, come first in ASCII is taken.

The search keeps one survivor per state (nothing yet, system, user, assistant last).  Survivors are leaves of a
tree of back pointers; a node counts its children, dead branches are taken away, and once all survivors
go through one node its edits are final and leave the tree.  Equally cheap ways into a state are compared over all
edits that are not final, back to where they part.  Two of them never begin with one another: each holds
one D, K or R per row, and one more I costs more.  A survivor that can't win any more against another is dropped, so
that it does not hold up the others.

Rows are sorted by conversation, turn (nulls first), role and text over all tasks, so one conversation may
lie in many tasks.  A task repairs those that lie wholly inside it at once.  Of a longer one, and of those
at its borders, it tabulates per run of ``block`` rows the cheapest way from each state to each; a second search of the
same kind goes over the runs, one after another, and never holds more than a run's table and what is not
final.  Its edits go back to the rows by a join on run and place.

Null role and text are one space; null conversations are one conversation, null turns come first.  Rows of one
turn follow role and text by their bytes; repeated rows are duplicates of the first.  Other columns are not
looked at.  Empty and very long texts are texts like any other.  An empty table gives no rows.  What one
conversation needs in one task is its own result: the string of its edits and a digest, which is read as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {"su", "ua", "au"}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_EDIT = re.compile("^I+|[DKR]I*")
#: Where an inserted or changed turn leads; each state has one.
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


@dataclass(frozen=True)
class Row:
    role: str
    text: str
    duplicate: bool

    @property
    def blank(self) -> bool:
        return not self.text.strip(WHITE)

    @property
    def must_go(self) -> bool:
        return self.blank or self.duplicate

    @property
    def truncated(self) -> bool:
        return not self.must_go and self.text.rstrip(WHITE)[-1] not in ".!?"


def _kept(state: int, initial: str) -> int | None:
    """The state after a turn that is kept as it is; none if it may not stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _table(initial: str, must_go: bool, extra: int) -> tuple:
    ways = [(s, s, DELETE, "D") for s in range(4)]
    if not must_go:
        for s in range(4):
            to = _kept(s, initial)
            if to is not None:
                ways.append((s, to, extra, "K"))
            if _TURN[s] != to:
                ways.append((s, _TURN[s], REROLE + extra, "R"))
    return tuple(ways)


_WAYS = {(i, m, t): _table(i, m, TRUNCATED * t) for i in ("s", "u", "a", "?") for m in (False, True) for t in (False, True)}


class _Node:
    __slots__ = ("up", "edits", "children", "deep")

    def __init__(self, up: _Node | None, edits: str) -> None:
        self.up, self.edits, self.children = up, edits, []
        self.deep = up.deep + 1 if up else 0


class Survivors:
    """The search.  ``final`` takes the edits of each step once they are sure, in order."""

    def __init__(self, entry: int = START, inserts: bool = True) -> None:
        self.root = _Node(None, "")
        self.final: list[str] = []
        first: list = [None] * 4
        first[entry] = (0, self.root, "")
        self.leaves: list[tuple[int, _Node] | None] = [None] * 4
        self._settle(self._inserted(first) if inserts else first, [])

    def _before(self, a: _Node, x: str, b: _Node, y: str) -> bool:
        """Whether the edits up to ``a`` and then ``x`` come before those up to ``b`` and then ``y``."""
        left, right = [x], [y]
        while a is not b:
            if a.deep >= b.deep:
                left.append(a.edits)
                a = a.up
            else:
                right.append(b.edits)
                b = b.up
        return "".join(reversed(left)) < "".join(reversed(right))

    def _better(self, new, old) -> bool:
        return old is None or new[0] < old[0] or (new[0] == old[0] and self._before(new[1], new[2], old[1], old[2]))

    def _inserted(self, found: list) -> list:
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for s in sources:
                if found[s] is not None:
                    way = (found[s][0] + INSERT, found[s][1], found[s][2] + "I")
                    if self._better(way, found[to]):
                        found[to] = way
        return found

    def _settle(self, found: list, before: list[_Node]) -> None:
        best = found[ASSISTANT]
        if best is not None:
            # Whoever has a turn of the assistant last can do what the others can, but for keeping a system turn: deleting it costs 4.
            if found[START] is not None and found[START][0] > best[0] + DELETE:
                found[START] = None
            if found[SYSTEM] is not None and found[SYSTEM][0] > best[0]:
                found[SYSTEM] = None
        for state, way in enumerate(found):
            if way is None:
                self.leaves[state] = None
            else:
                node = _Node(way[1], way[2])
                way[1].children.append(node)
                self.leaves[state] = (way[0], node)
        for node in before:  # leaves of the step before that nobody came from
            while not node.children and node is not self.root:
                node.up.children.remove(node)
                node = node.up
        while len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.up = None
            self.final.append(self.root.edits)

    def step(self, ways) -> None:
        """Takes ways as (from, to, cost, edits)."""
        found: list = [None] * 4
        leaves = self.leaves
        for source, to, cost, edits in ways:
            leaf = leaves[source]
            if leaf is not None:
                way = (leaf[0] + cost, leaf[1], edits)
                if self._better(way, found[to]):
                    found[to] = way
        self._settle(self._inserted(found), [leaf[1] for leaf in leaves if leaf is not None])

    def open_edits(self, node: _Node) -> list[str]:
        """What is not final on the way to a leaf."""
        out = []
        while node is not self.root:
            out.append(node.edits)
            node = node.up
        return out[::-1]

    def finish(self) -> int:
        """Ends in a state that may be the last; all edits are final then.  Returns the cost."""
        best = self.leaves[ASSISTANT]
        empty = self.leaves[START]
        if best is None or (empty is not None and (empty[0] < best[0] or (empty[0] == best[0] and self._before(empty[1], "", best[1], "")))):
            best = empty
        self.final += self.open_edits(best[1])
        return best[0]


def applied(edits: list[str], initials: str, state: int) -> tuple[list[str], int]:
    """Per step what it leaves: ``=`` the row, ``U`` or ``A`` the row with that role, ``u`` or ``a`` an empty turn.

    ``edits`` holds one string per row.  Returns the state after them, too.
    """
    out = []
    for edit, initial in zip(edits, initials, strict=True):
        code = ""
        for e in edit:
            if e == "K":
                state = _kept(state, initial)
                code += "="
            elif e != "D":
                state = _TURN[state]
                code += ("UA" if e == "R" else "ua")[state - USER]
        out.append(code)
    return out, state


def turns_left(code: str, row: Row | None) -> list[tuple[str, str]]:
    name = {"U": _NAME[USER], "A": _NAME[ASSISTANT], "u": _NAME[USER], "a": _NAME[ASSISTANT]}
    return [(row.role, row.text) if c == "=" else (name[c], row.text if c in "UA" else "") for c in code]


class Run:
    """Rows of one conversation that follow each other, what is wrong with them, and how they can be repaired."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low: int | None = None
        self.high: int | None = None
        self.initials = ""

    def add(self, turn: int | None, row: Row) -> None:
        initial = row.role[:1]
        if self.rows:
            self.illegal += self.rows[-1].role[:1] + initial not in _LEGAL
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.blank += row.blank
        self.duplicate += not row.blank and row.duplicate
        self.truncated += row.truncated
        self.initials += initial if initial and initial in "sua" else "?"
        self.rows.append(row)

    def ways(self) -> list[tuple]:
        return [_WAYS[i, row.must_go, row.truncated] for i, row in zip(self.initials, self.rows, strict=True)]

    def repaired(self) -> tuple[int, str, list[str]]:
        """Cost, edits, and what each step leaves; the first step comes before all rows."""
        search = Survivors()
        for ways in self.ways():
            search.step(ways)
        cost = search.finish()
        codes, _ = applied(search.final, "?" + self.initials, START)
        return cost, "".join(search.final), codes

    def tabulated(self) -> list[dict]:
        """The cheapest way from each state to each."""
        out = []
        for entry in range(4):
            search = Survivors(entry, inserts=False)
            for ways in self.ways():
                search.step(ways)
            for to, leaf in enumerate(search.leaves):
                if leaf is not None:
                    out.append({"source": entry, "to": to, "cost": leaf[0], "edits": "".join(search.final + search.open_edits(leaf[1]))})
        return out


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RUN = "n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, initials string"
_RUN_FIELDS = [x.split()[0] for x in _RUN.split(", ")]
_SCHEMA = (
    "kind int, run long, place int, gaps long, cost long, audit string, repaired_sha256 string, role string, text string, "
    + _RUN
    + ", ways array<struct<source:int,to:int,cost:long,edits:string>>"
)
_WHOLE, _PART, _ROW, _TURNS = range(4)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _table_of(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)
        rows.clear()


def _repair(schema: pa.Schema, block: int, keep_turns: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        out: list[dict] = []
        held = 0
        number = 0
        run, conv, border, before = None, None, True, None

        def part() -> None:
            """The run as a table of ways, and its rows."""
            nonlocal number
            first, last = (run.rows[0].role[:1], run.rows[-1].role[:1]) if run.rows else (None, None)
            facts = {"n": len(run.rows), "blank": run.blank, "duplicate": run.duplicate, "truncated": run.truncated, "illegal": run.illegal, "turns": run.turns}
            facts |= {"low": run.low, "high": run.high, "first": first, "last": last, "initials": run.initials}
            out.append({"kind": _PART, "conv_id": conv, "run": task + number, **facts, "ways": run.tabulated()})
            out.extend({"kind": _ROW, "conv_id": conv, "run": task + number, "place": k, "role": r.role, "text": r.text} for k, r in enumerate(run.rows))
            number += 1

        def whole() -> None:
            nonlocal number
            cost, audit, codes = run.repaired()
            digest, empty, place = hashlib.sha256(), True, 0
            for code, row in zip(codes, [None, *run.rows], strict=True):
                for role, text in turns_left(code, row):
                    digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
                    if keep_turns:
                        out.append({"kind": _TURNS, "conv_id": conv, "run": task + number, "place": place, "role": role, "text": text})
                        place += 1
            found = {"gaps": _gaps(run.low, run.high, run.turns), "blank": run.blank, "duplicate": run.duplicate, "truncated": run.truncated, "illegal": run.illegal}
            out.append({"kind": _WHOLE, "conv_id": conv, **found, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()})
            number += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "absent", "repeats")]
            for c, turn, role, text, absent, repeats in zip(*columns, strict=True):
                if run is None or c != conv:
                    if run is not None:
                        (part if border else whole)()
                        border = False
                    run, conv, before = Run(), c, None
                if absent:
                    continue
                if len(run.rows) == block:
                    part()
                    run, border = Run(), True
                run.add(turn, Row(role, text, repeats or before == (turn, role, text)))
                before = (turn, role, text)
                held += len(text)
                if held > 1 << 22 or len(out) > 4096:
                    yield from _table_of(out, schema)
                    held = 0
        if run is not None:
            part()
        yield from _table_of(out, schema)

    return of


def _combine(schema: pa.Schema):
    """From the tables of runs, in order, to one row per conversation and the codes of all their rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        conv, search = None, None
        waiting: list[tuple[int, str]] = []  # runs whose edits are not final: number, initials
        audit: list[str] = []
        state, done = START, 0
        total: dict = {}

        def emit() -> None:
            nonlocal state, done
            for edits in search.final[done:]:
                audit.append(edits)
                done += 1
                if done == 1:  # inserted before all rows
                    codes, state = applied([edits], "?", state)
                    total["lead"] = codes[0]
                    continue
                run, initials = waiting.pop(0)
                codes, state = applied(_EDIT.findall(edits), initials, state)
                if total["lead"]:
                    out.append({"kind": _TURNS, "conv_id": conv, "run": run, "place": -1, "text": total["lead"]})
                    total["lead"] = ""
                out.extend({"kind": _TURNS, "conv_id": conv, "run": run, "place": k, "text": code} for k, code in enumerate(codes))
            # The edits are in ``audit`` now; only how many there were matters to the search.
            search.final[:] = [""] * done

        def end() -> None:
            total["cost"] = search.finish()
            emit()
            lead = total.pop("lead")
            if lead:  # no run at all
                out.append({"kind": _TURNS, "conv_id": conv, "run": -1, "place": -1, "text": lead})
            found = {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}
            out.append({"kind": _WHOLE, "conv_id": conv, "gaps": _gaps(total["low"], total["high"], total["turns"]), **found, "audit": "".join(audit)})

        for batch in batches:
            for r in batch.to_pylist():
                if search is None or r["conv_id"] != conv:
                    if search is not None:
                        end()
                    conv, search, state, done = r["conv_id"], Survivors(), START, 0
                    waiting, audit = [], []
                    total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "last": None, "lead": ""}
                if r["n"]:
                    for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                        total[k] += r[k]
                    total["illegal"] += total["last"] is not None and total["last"] + r["first"] not in _LEGAL
                    total["last"] = r["last"]
                    if r["low"] is not None:
                        total["turns"] -= total["high"] == r["low"]
                        total["low"] = r["low"] if total["low"] is None else total["low"]
                        total["high"] = r["high"]
                    waiting.append((r["run"], r["initials"]))
                    search.step([(w["source"], w["to"], w["cost"], w["edits"]) for w in r["ways"]])
                    emit()
                if len(out) > 4096:
                    yield from _table_of(out, schema)
        if search is not None:
            end()
        yield from _table_of(out, schema)

    return of


def _digest(schema: pa.Schema):
    """Per conversation the digest of its turns, read as a stream."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, empty = None, None, True
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest, empty = c, hashlib.sha256(), True
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            yield from _table_of(out, schema)
        if digest is not None:
            yield from _table_of([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema)

    return of


@dataclass(frozen=True)
class Repaired:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    report: DataFrame
    #: conv_id, run, place, role, text: the turns that are left, in the order of run and place
    turns: DataFrame | None


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults that their conversation and turn decide; those that are dropped are marked ``absent``."""
    blank = F.lit(" ")
    spelt = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1]).cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", blank))
    times = F.array_repeat(F.col("fate") == 0, F.when(F.col("fate") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", "role", "text", fate.alias("fate")).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("absent"))


def repair(rows: DataFrame, absent: str | None = None, turns: bool = False, block: int = 1024) -> Repaired:
    """Repairs the conversations of ``conv_id, turn, role, text``.

    Rows of which the boolean column ``absent`` is true only say that their conversation exists.  With ``turns``
    the repaired turns are kept.  ``block``: rows of a run.
    """
    gone = F.coalesce(F.col(f"`{absent}`"), F.lit(False)) if absent else F.lit(False)
    spelt = [F.when(F.col("absent"), "").otherwise(F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", gone.alias("absent")).select("conv_id", "turn", *spelt, "absent")
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    named = rows.withColumn("same", same)
    # Only texts that stand there more than once; their first turn, one row each.
    first = named.where("not absent").groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.count("*").alias("n"), F.min(when).alias("first")).where("n > 1")
    marked = named.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")) & ~F.col("absent"), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "absent", F.coalesce(when > F.col("first"), F.lit(False)).alias("repeats"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text"]
    sorted_rows = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL(_SCHEMA).fields])
    found = cut_lineage(sorted_rows.mapInArrow(_repair(_arrow(schema), block, turns), schema))

    # Conversations that lie in several runs or at the border of a task.
    runs = found.where(F.col("kind") == _PART).select("conv_id", "run", *_RUN_FIELDS, "ways")
    runs = runs.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "run")
    joined = cut_lineage(runs.mapInArrow(_combine(_arrow(schema)), schema))
    codes = joined.where(F.col("kind") == _TURNS).select(F.col("conv_id"), F.col("run"), F.col("place"), F.col("text").alias("code"))
    held = found.where(F.col("kind") == _ROW).select("run", "place", "role", "text")
    each = codes.where("code <> ''").join(held, ["run", "place"], "left").select("conv_id", "run", "place", F.posexplode(F.split("code", "(?<=.)(?=.)")).alias("sub", "c"), "role", "text")
    role = F.when(F.col("c") == "=", F.col("role")).when(F.lower("c") == "u", _NAME[USER]).otherwise(_NAME[ASSISTANT])
    left = each.select("conv_id", "run", "place", "sub", role.alias("role"), F.when(F.col("c").isin("=", "U", "A"), F.col("text")).otherwise("").alias("text"))
    stream = left.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "run", "place", "sub")
    short = T.StructType([id_field, T.StructField("repaired_sha256", T.StringType())])
    digests = stream.mapInArrow(_digest(_arrow(short)), short).select(F.col("conv_id").alias("c"), F.col("repaired_sha256").alias("sha"))
    columns = ["conv_id", *_COUNTS, "audit"]
    late = joined.where(F.col("kind") == _WHOLE).select(*columns).join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    late = late.select(*columns, F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
    report = found.where(F.col("kind") == _WHOLE).select(*columns, "repaired_sha256").unionByName(late)
    if not turns:
        return Repaired(report, None)
    # Both keep their order within a run; places of the second kind leave room for what was inserted.
    placed = left.select("conv_id", "run", (F.col("place").cast("long") * 4 + F.col("sub")).alias("place"), "role", "text")
    own = found.where(F.col("kind") == _TURNS).select("conv_id", "run", F.col("place").cast("long").alias("place"), "role", "text")
    return Repaired(report, own.unionByName(placed))
