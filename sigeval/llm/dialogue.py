"""Repair of conversation structure by a checkpointed dynamic program.

A conversation is to have the roles of `(system?(user assistant)+)?`. Rows are kept, given another role or deleted, and
empty rows are inserted; the cheapest edits win, of equally cheap ones those whose initials (D, I, K, R) are least.
What is still to be paid from each of four states before a row (start, system, user, assistant said last) follows from
that before the next row. Walking forward, the least edit is taken that pays exactly the difference.

The vectors of costs are stored for every square root of the rows only; between such checkpoints they are computed
again while walking. A conversation of more than `SEGMENT` rows is walked in segments by several tasks: a segment is
first a table of costs from state to state, a scan over those gives the costs at its end, then the state it is left in for
each state it is entered in, and a second scan the state it is entered in. The scans see one row per segment.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigeval.operators.ordering import row_index

from .common import stage

SEGMENT = 1 << 16
FAR = 1 << 60  # no way
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # state behind an inserted row or one with a new role
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (0, 4, 2, 0)  # insertions that complete what ends in a state
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Fixed values of the contract: what counts as white space, and what may end a text.
SPACE = " \t\n\x0b\x0c\r"
CLOSING = ".!?"


# ---------------------------------------------------------------- one segment
class Segment:
    """Rows of a segment: `initials` of their roles, `faults` (b, d, t or none), and how many equal rows follow."""

    def __init__(self, initials: list[str], faults: list[str], extra: list[int]):
        self.initials, self.faults, self.extra = initials, faults, extra

    def __len__(self) -> int:
        return len(self.initials)

    def before(self, at: int, after: tuple) -> tuple:
        """Costs before row `at` from those behind it."""
        copies = DELETE * self.extra[at]
        cost = [DELETE + copies + x for x in after]
        if self.faults[at] not in ("b", "d"):
            own = copies + (TRUNCATED if self.faults[at] == "t" else 0)
            keeps = KEEPS.get(self.initials[at], {})
            for state in range(4):
                cost[state] = min(cost[state], REROLE + own + after[NEXT[state]])
                if state in keeps:
                    cost[state] = min(cost[state], own + after[keeps[state]])
        return tuple(min(cost[s], INSERT + cost[NEXT[s]], 2 * INSERT + cost[NEXT[NEXT[s]]], FAR) for s in range(4))

    def costs(self, end: tuple) -> tuple:
        """Costs before the first row, given those behind the last."""
        for at in range(len(self) - 1, -1, -1):
            end = self.before(at, end)
        return end

    def checkpoints(self, end: tuple) -> tuple[int, list[tuple]]:
        """Every how many rows costs are stored, and the costs at those places and at the end."""
        every = max(1, math.isqrt(len(self)))
        stored = [end]
        for at in range(len(self) - 1, 0, -1):
            end = self.before(at, end)
            if at % every == 0:
                stored.append(end)
        return every, stored[::-1]

    def walk(self, end: tuple, state: int) -> Iterator[tuple[int, list[int], str, int]]:
        """(row, states of the rows inserted before it, edit, state behind it) of the least edits from `state`."""
        every, stored = self.checkpoints(end)
        for block, behind in enumerate(stored):
            first, last = block * every, min((block + 1) * every, len(self))
            costs = [behind]
            for at in range(last - 1, first - 1, -1):
                costs.append(self.before(at, costs[-1]))
            costs.reverse()
            for at in range(first, last):
                now, after, added = costs[at - first], costs[at - first + 1], []
                copies = DELETE * self.extra[at]
                own = copies + (TRUNCATED if self.faults[at] == "t" else 0)
                forced = self.faults[at] in ("b", "d")
                while True:
                    kept = None if forced else KEEPS.get(self.initials[at], {}).get(state)
                    if now[state] == DELETE + copies + after[state]:
                        edit = "D"
                    elif now[state] == INSERT + now[NEXT[state]]:
                        state = NEXT[state]
                        added.append(state)
                        continue
                    elif kept is not None and now[state] == own + after[kept]:
                        edit, state = "K", kept
                    else:
                        edit, state = "R", NEXT[state]
                    break
                yield at, added, edit, state

    def table(self) -> list[int]:
        """Least costs from each state to each state, row by row."""
        ends = [self.costs(tuple(0 if s == e else FAR for s in range(4))) for e in range(4)]
        return [min(ends[e][s], FAR) for s in range(4) for e in range(4)]

    def leaves(self, end: tuple) -> list[int]:
        """The state behind the last row for each state before the first (one that cannot be left goes nowhere)."""
        out = []
        for state in range(4):
            for _, _, _, last in self.walk(end, state):
                pass
            out.append(last)
        return out


# ---------------------------------------------------------------- tasks
def _segments(batches) -> Iterator[tuple[dict, Segment, list[int]]]:
    """Rows sorted by (k, segment, pos), as segments: the first row, the segment, the positions."""
    head, rows = None, ([], [], [], [])

    for batch in batches:
        for row in batch.to_pylist():
            if head is not None and (row["k"], row["segment"]) != (head["k"], head["segment"]):
                yield head, Segment(*rows[:3]), rows[3]
                head = None
            if head is None:
                head, rows = row, ([], [], [], [])
            for column, name in zip(rows, ("initial", "fault", "extra", "pos"), strict=True):
                column.append(row[name])
    if head is not None:
        yield head, Segment(*rows[:3]), rows[3]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_TABLE = pa.schema([("k", pa.string()), ("segment", pa.int64()), ("cost", pa.list_(pa.int64()))])
_LEAVES = pa.schema([("k", pa.string()), ("segment", pa.int64()), ("leave", pa.list_(pa.int64()))])
_EDIT = pa.schema([("k", pa.string()), ("pos", pa.int64()), ("added", pa.list_(pa.string())), ("edit", pa.string()), ("new_role", pa.string())])


def _tables(batches):
    for head, segment, _ in _segments(batches):
        yield _batch([{"k": head["k"], "segment": head["segment"], "cost": segment.table()}], _TABLE)


def _leaves(batches):
    for head, segment, _ in _segments(batches):
        yield _batch([{"k": head["k"], "segment": head["segment"], "leave": segment.leaves(tuple(head["end"]))}], _LEAVES)


def _edits(batches):
    out = []
    for head, segment, positions in _segments(batches):
        state = head["enter"]
        for at, added, edit, state in segment.walk(tuple(head["end"]), state):  # noqa: B007
            out.append(
                {"k": head["k"], "pos": positions[at], "added": [ROLES[s] for s in added], "edit": edit, "new_role": ROLES[state] if edit == "R" else None}
            )
            if len(out) == 4096:
                yield _batch(out, _EDIT)
                out = []
        if positions[-1] + 1 == head["total"]:
            tail = []
            while FINAL[state]:
                state = NEXT[state]
                tail.append(ROLES[state])
            if tail:
                out.append({"k": head["k"], "pos": head["total"], "added": tail, "edit": None, "new_role": None})
    yield _batch(out, _EDIT)


def _ends(frame):
    """Costs at the end of every segment of a conversation, from the last to the first."""
    frame = frame.sort_values("segment")
    end, ends = FINAL, []
    for cost in reversed(frame["cost"].tolist()):
        ends.append(list(end))
        end = tuple(min(int(cost[4 * s + e]) + end[e] for e in range(4)) for s in range(4))
    frame["end"] = ends[::-1]
    return frame[["k", "segment", "end"]]


def _enters(frame):
    """State before the first row of every segment of a conversation."""
    frame = frame.sort_values("segment")
    state, enters = START, []
    for leave in frame["leave"].tolist():
        enters.append(state)
        state = int(leave[state])
    frame["enter"] = enters
    return frame[["k", "segment", "end", "enter"]]


# ---------------------------------------------------------------- the operator
def rows_in_order(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct rows with their place: k, conv_id, turn, role, text, initial, fault, extra, pos (from 0), total.

    Rows come by turn, NULL first, and by a hash of role and text within a turn. Equal rows of a turn are one, with
    `extra` more that follow it. NULL roles and texts are one space. The fault is b (no character but white space), d (role
    and text came before; so are all that `extra` counts), t (the last such character is not one of .!?), or empty.
    """
    k = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string"))).alias("k")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    runs = rows.select(k, F.col(key).alias("conv_id"), F.col(turn).alias("turn"), *filled)
    runs = runs.groupBy("k", "conv_id", "turn", "role", "text").agg((F.count(F.lit(1)) - 1).alias("extra"))
    order = [F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("at"), F.xxhash64("role", "text").alias("h"), F.xxhash64("text", "role").alias("g")]
    bare = F.rtrim("text", F.lit(SPACE))
    ending = F.when(bare == "", "b").when(~F.substring(bare, -1, 1).isin(*CLOSING), "t").otherwise("")
    runs = stage(runs.select("*", F.substring("role", 1, 1).alias("initial"), ending.alias("ending"), *order))
    first = runs.groupBy("k", "h", "g").agg(F.min(F.struct("has", "at")).alias("first"))
    fault = F.when((F.col("ending") != "b") & (F.col("first") < F.struct("has", "at")), "d").otherwise(F.col("ending"))
    narrow = runs.select("k", "h", "g", "has", "at", "initial", "ending", "extra").join(first, ["k", "h", "g"])
    narrow = stage(narrow.select("k", "has", "at", "h", "g", "initial", "extra", fault.alias("fault")))
    placed = row_index(narrow, ["k"], ["has", "at", "h", "g"], "pos", total="total")
    own = ["k", "has", "at", "h", "g"]
    return stage(runs.drop("initial", "ending", "extra").join(placed, own).drop("has", "at", "h", "g"))


def edits(placed: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The edits of the rows of `rows_in_order`: conv_id, pos, off, edit, role, text, times, cost.

    They come by pos and off. Edits I have the role of the new row and an empty text, R the new role, D the row
    that goes, `times` of it. `cost` counts them all, and one more for a row that stays without its end.
    """
    narrow = placed.select("k", "pos", "total", "initial", "fault", "extra", F.floor(F.col("pos") / segment).cast("long").alias("segment"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("k", "segment").sortWithinPartitions("k", "segment", "pos")

    many = narrow.where(F.col("total") > segment)
    tables = dealt(many).mapInArrow(_tables, "k string, segment long, cost array<long>")
    ends = stage(tables.groupBy("k").applyInPandas(_ends, "k string, segment long, end array<long>"))
    leaves = dealt(many.join(ends, ["k", "segment"])).mapInArrow(_leaves, "k string, segment long, leave array<long>")
    leaves = leaves.join(ends, ["k", "segment"])
    enters = stage(leaves.groupBy("k").applyInPandas(_enters, "k string, segment long, end array<long>, enter int"))

    known = narrow.join(enters, ["k", "segment"], "left")
    known = known.withColumn("end", F.coalesce("end", F.array(*[F.lit(x).cast("long") for x in FINAL]))).withColumn("enter", F.coalesce("enter", F.lit(START)))
    found = dealt(known).mapInArrow(_edits, "k string, pos long, added array<string>, edit string, new_role string")

    names = placed.select("k", "conv_id").distinct()
    rows = placed.select("k", "pos", "role", "text", "fault", "extra")
    joined = found.join(rows, ["k", "pos"], "left").join(names, "k")
    one = lambda edit, role, text, times, cost: F.struct(
        edit.alias("edit"), role.alias("role"), text.alias("text"), times.cast("long").alias("times"), cost.cast("long").alias("cost")
    )
    own = F.when(F.col("fault") == "t", TRUNCATED).otherwise(0)
    paid = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "R", REROLE + own).otherwise(own)
    parts = F.concat(
        F.transform("added", lambda r: one(F.lit("I"), r, F.lit(""), F.lit(1), F.lit(INSERT))),
        F.when(F.col("edit").isNotNull(), F.array(one(F.col("edit"), F.coalesce("new_role", "role"), F.col("text"), F.lit(1), paid))).otherwise(F.array()),
        F.when(F.col("extra") > 0, F.array(one(F.lit("D"), F.col("role"), F.col("text"), F.col("extra"), DELETE * F.col("extra")))).otherwise(F.array()),
    )
    return joined.select("k", "conv_id", "pos", F.posexplode(parts).alias("off", "e")).select("k", "conv_id", "pos", "off", "e.*")


def repaired(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, pos, off, role, text, by pos and off. An empty table gives an empty result."""
    found = edits(rows_in_order(conversations, key, turn, role, text))
    return found.where("edit <> 'D'").select("conv_id", "pos", "off", "role", "text")


def faults(placed: DataFrame) -> DataFrame:
    """One row per conversation of `rows_in_order`: k, gaps, blank, duplicate, truncated, illegal.

    Gaps are the missing turns between the least and the greatest, illegal the neighbours whose roles do not follow each other.
    """
    turns = placed.where("turn IS NOT NULL").groupBy("k", "turn").agg(F.count(F.lit(1)).alias("n"))
    turns = turns.groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    blank = F.col("fault") == "b"
    rows = placed.groupBy("k").agg(
        F.sum(F.when(blank, F.col("extra") + 1).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("extra") + F.when(F.col("fault") == "d", 1).otherwise(0))).alias("duplicate"),
        F.sum((F.col("fault") == "t").cast("long")).alias("truncated"), F.sum("extra").alias("repeats"),
    )
    ends = placed.select("k", F.explode(F.array(
        F.struct(F.col("pos").alias("p"), F.lit(None).cast("string").alias("left"), F.col("initial").alias("right")),
        F.struct((F.col("pos") + 1).alias("p"), F.col("initial").alias("left"), F.lit(None).cast("string").alias("right")),
    )).alias("x"))
    pairs = ends.groupBy("k", "x.p").agg(F.max("x.left").alias("left"), F.max("x.right").alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
    bad = pairs.groupBy("k").agg(F.sum((~F.concat("left", "right").isin("su", "ua", "au")).cast("long")).alias("bad"))
    out = rows.join(turns, "k", "left").join(bad, "k", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "k", F.coalesce("gaps", zero).cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.coalesce("bad", zero) + F.col("repeats")).alias("illegal")
    )


def _digests(batches):
    """Edits sorted by (k, pos, off) to one row per conversation. The hash takes one row at a time, so of a long
    conversation only the initials are held."""
    key, digest, audit, cost, first = None, None, [], 0, True
    schema = pa.schema([("k", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def done():
        return _batch([{"k": key, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

    for batch in batches:
        for row in batch.to_pylist():
            if digest is None or row["k"] != key:
                if digest is not None:
                    yield done()
                key, digest, audit, cost, first = row["k"], hashlib.sha256(), [], 0, True
            audit.append(row["edit"] * row["times"])
            cost += row["cost"]
            if row["edit"] != "D":
                digest.update(f"{'' if first else chr(10)}{row['role']}:{row['text']}".encode())
                first = False
    if digest is not None:
        yield done()


def digests(found: DataFrame) -> DataFrame:
    """One row per conversation of `edits`: k, cost, audit (initials of its edits), SHA-256 of its repaired rows.

    A hash is sequential, so the rows of one conversation pass through one task, as a stream.
    """
    text = F.when(F.col("edit") == "D", F.lit(None)).otherwise(F.col("text")).alias("text")
    rows = found.select("k", "pos", "off", "edit", "role", text, "times", "cost").repartition("k").sortWithinPartitions("k", "pos", "off")
    return rows.mapInArrow(_digests, "k string, cost long, audit string, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id of `conversations` (NULL is one): faults, cost, audit and digest of its `rows`.

    `rows` (default: `conversations`) are the rows to repair. A conversation without rows has zeros, no edits and the hash of an
    empty text. Other columns are not read; an empty table gives an empty result.
    """
    placed = rows_in_order(conversations if rows is None else rows)
    found = faults(placed).join(digests(stage(edits(placed, segment))), "k")
    k = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("k")
    out = conversations.select("conv_id", k).distinct().join(found, "k", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after damage by the CRC-32 of `conv_id:turn` modulo 20 (NULL is one space): 0 drops a row,
    1 empties its text, 2 takes out its .!?, 3 repeats it, 4 makes it the user's."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", CLOSING, "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_copy")).drop("_copy")
