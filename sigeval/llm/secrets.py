"""Secret scans with a trigram inverted index (DataFrame functions only).

From each rule's regex a Boolean query over trigrams follows: every match contains the literal runs of the regex, so a
text without their trigrams cannot match. The index lists, for each trigram that some rule asks for, the
documents that contain it in lower case. Postings are intersected by document, candidates are verified with the regex,
and a rule without mandatory trigrams reads every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, row_keys, stage

STRIDE = 256  # hits whose places are found one after another
MAX_STRINGS = 64  # literal runs with more spellings are cut into shorter runs, which only widens the candidates


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` of which group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: Fixed values of the contract, then further kinds whose token formats are public.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("repo_token", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)


# ---------------------------------------------------------------- trigram queries
def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Boolean query: every clause must hold, and a clause holds if all trigrams of one of its sets occur.

    The regex is read into literal runs with all their spellings, in lower case. Repetition, optional parts and large
    classes end a run; a clause comes from a run whose spellings all have three characters or more.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(run: set[str]) -> None:
        if run and min(map(len, run)) >= 3:
            sets = {trigrams(s) for s in run}
            clauses.append([s for s in sorted(sets, key=sorted) if not any(t < s for t in sets)])

    def spellings(nodes) -> set[str] | None:
        """All strings of a part, or None if they are unbounded or too many."""
        strings = {""}
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                own = {chr(arg).lower()}
            elif name == "IN":
                own = set()
                for kind, x in arg:
                    if str(kind) == "LITERAL":
                        own.add(chr(x).lower())
                    elif str(kind) == "RANGE" and x[1] - x[0] < MAX_STRINGS:
                        own |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                    else:
                        return None
            elif name == "SUBPATTERN":
                own = spellings(arg[3])
            elif name == "BRANCH":
                parts = [spellings(b) for b in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] <= 2:
                body = spellings(arg[2])
                own = None if body is None else {"".join(p) for n in range(arg[0], int(arg[1]) + 1) for p in product(body, repeat=n)}
            else:
                own = None
            if own is None or len(own) * len(strings) > MAX_STRINGS:
                return None
            strings = {a + b for a in strings for b in own}
        return strings

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            own = spellings([node])
            if own is not None and len(own) * len(run) <= MAX_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            close(run)
            run = own if own is not None else {""}
            if own is None:
                op, arg = node
                if str(op) == "SUBPATTERN":
                    walk(arg[3])
                elif str(op) == "MAX_REPEAT" and arg[0] >= 1:
                    walk(arg[2])
        close(run)

    walk(re._parser.parse(pattern))
    return clauses


def could_match(query: list[list[frozenset[str]]], found: Column) -> Column:
    """The query as a Boolean expression over the array of a document's trigrams."""
    every = [reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.array_contains(found, t) for t in sorted(s)]) for s in clause]) for clause in query]
    return reduce(lambda a, b: a & b, every)


# ---------------------------------------------------------------- index
def postings(docs: DataFrame, text: str, keys: list[Column], wanted: list[str]) -> DataFrame:
    """The inverted index (trigram, k1, k2) of the wanted trigrams, one row per document that contains one."""
    lower = F.lower(filled(text))
    marks = F.array(*[F.when(lower.contains(t), F.lit(t)) for t in wanted])
    return docs.select(*keys, F.explode(F.array_compact(marks)).alias("trigram"))


# ---------------------------------------------------------------- verification
def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's leftmost non-overlapping matches, in code points, end exclusive.

    The text splits into the gaps between matches, so a match starts after the gaps and matches before it.
    """
    pattern = F.lit(rule.pattern)
    lengths = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("hit"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        long = F.when(x["part"] >= rule.least, F.array(span)).otherwise(empty)
        return F.struct(F.coalesce(end, start).alias("at"), F.concat(acc["out"], long).alias("out"))

    # appending to an array copies it, so the hits of STRIDE are joined first
    hits = F.filter(lengths, lambda x: x["hit"].isNotNull())
    strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / STRIDE).cast("int")), lambda i: F.slice(hits, i * STRIDE + 1, STRIDE))

    def stride(acc, own):
        seed = F.struct(acc["at"].alias("at"), empty.alias("out"))
        return F.aggregate(own, seed, step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,end:int>>>").alias("out"))
    found = F.aggregate(strides, seed, stride, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _long_only(rule: Rule) -> Rule:
    """A rule that is one class repeated matches maximal runs, so short runs need not be listed: ask for the length."""
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """One row per input row: doc_id and `spans`, an array of (start, kind number, end) by start, then kind.

    NULL and empty texts have no spans. Rows that repeat key and text get the same spans each. An empty table gives an
    empty result. Other columns are not read.
    """
    rules = tuple(map(_long_only, rules))
    queries = [trigram_query(r.pattern) for r in rules]
    keys = row_keys(key, text)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    body = filled(text)

    def found(number: int, when: Column) -> Column:
        return F.when(when & body.rlike(rules[number].pattern), spans(body, rules[number], number)).otherwise(none)

    full = [n for n, q in enumerate(queries) if not q]
    rows = docs.select(
        F.col(key).alias("doc_id"), *keys, F.concat(none, *[found(n, F.lit(True)) for n in full]).alias("spans")
    )
    indexed = [n for n, q in enumerate(queries) if q]
    if not indexed:
        return rows.select("doc_id", F.array_sort("spans").alias("spans"))

    wanted = sorted({t for n in indexed for clause in queries[n] for s in clause for t in s})
    index = stage(postings(docs, text, keys, wanted))
    held = index.groupBy("k1", "k2").agg(F.collect_set("trigram").alias("held"))  # at most len(wanted) each
    candidates = held.select(
        "k1", "k2", F.array_compact(F.array(*[F.when(could_match(queries[n], F.col("held")), F.lit(n)) for n in indexed])).alias("rules")
    ).where(F.size("rules") > 0)
    candidates = stage(candidates)
    texts = docs.select(*keys, body.alias("body")).join(candidates, ["k1", "k2"])
    body = F.col("body")
    checked = texts.select(
        "k1", "k2", F.concat(*[found(n, F.array_contains("rules", n)) for n in indexed]).alias("more")
    ).where(F.size("more") > 0)
    checked = stage(checked).dropDuplicates(["k1", "k2"])
    out = rows.join(checked, ["k1", "k2"], "left")
    return out.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", none))).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = BASE + MORE) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.concat_ws(",", F.transform(spans, one))
