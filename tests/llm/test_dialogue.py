"""Repair of conversations against a plain program that keeps the least (cost, edits) of each state."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigeval.llm import dialogue

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
LINES = ["Hello there.", "no end", "", " \t", None, "Why?", "Yes! ", "x.y", "Hello there."]


def conversations():
    rng, rows = random.Random(4), []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([0, 1, 2, 3, 7, 12])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(LINES)))
    rows += [(999, t, ("user", "assistant")[t % 2], f"row {t % 90}.") for t in range(400)]
    return [r for k, r in enumerate(rows) if not any(r[:2] == x[:2] for x in rows[:k])]


def plain(original):
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    groups = defaultdict(list)
    for conv, turn, role, text in original:
        groups[conv] += []
        spaced = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        groups[conv] += [row] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"": (0, "", ())}

        def put(table, state, cost, audit, said):
            if state not in table or (cost, audit) < table[state][:2]:
                table[state] = (cost, audit, said)

        def insert(table):
            for _ in range(3):
                for state, (cost, audit, said) in list(table.items()):
                    new = NEXT[state]
                    put(table, new, cost + 2, audit + "I", (*said, {"u": "user:", "a": "assistant:"}[new]))

        for (_, role, text), fault in zip(rows, faults, strict=True):
            insert(best)
            new = {}
            for state, (cost, audit, said) in best.items():
                put(new, state, cost + 3, audit + "D", said)
                if fault in ("b", "d"):
                    continue
                cost += fault == "t"
                put(new, NEXT[state], cost + 2, audit + "R", (*said, f"{ {'u': 'user', 'a': 'assistant'}[NEXT[state]]}:{text}"))
                if role[:1] in ("s", "u", "a") and (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    put(new, role[:1], cost, audit + "K", (*said, f"{role}:{text}"))
            best = new
        insert(best)
        cost, audit, said = min(best[s] for s in ("", "a") if s in best)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(x) for x in "bdt"], illegal, cost, audit, digest)
    return out


@pytest.mark.parametrize("segment", [1 << 16, 3])
def test_repair_matches_a_plain_program(spark, segment):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table = table.select("*", *[F.lit(1).alias(c) for c in ("k", "pos", "segment", "fault", "extra", "_kind", "has")])
    # several rows without a turn have no order of their own: leave one of each conversation
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.report(table, dialogue.damaged(table), segment).collect()}
    assert got == plain(rows)
    assert any(len(r[6]) > 100 for r in got.values())


def test_equal_rows_of_a_turn_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "assistant", "Yes.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = dialogue.report(table).collect()
    assert (got.blank, got.duplicate, got.truncated, got.illegal, got.cost, got.audit) == (0, 3, 0, 3, 9, "KDDKD")
    said = dialogue.repaired(table).orderBy("pos", "off").collect()
    assert [(r.role, r.text) for r in said] == [("user", "Hi."), ("assistant", "Yes.")]
    assert dialogue.report(table.limit(0)).count() == 0 and dialogue.repaired(table.limit(0)).count() == 0
    (gone,) = dialogue.report(table, table.limit(0)).collect()
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_checkpoints_give_the_same_walk_as_all_costs():
    rng = random.Random(1)
    for n in (1, 2, 5, 16, 17, 90):
        own = dialogue.Segment([rng.choice("suat") for _ in range(n)], [rng.choice(["", "", "t", "b", "d"]) for _ in range(n)], [rng.choice([0, 0, 2]) for _ in range(n)])
        whole = dialogue.Segment(own.initials, own.faults, own.extra)
        whole.checkpoints = lambda end: (n, [end])
        assert list(own.walk(dialogue.FINAL, 0)) == list(whole.walk(dialogue.FINAL, 0))
        cost = [own.table()[e] + dialogue.FINAL[e] for e in range(4)]
        assert min(cost) == own.costs(dialogue.FINAL)[0]
