"""Counts of a growing number of keys, looked up for the occurrences in every row.

The keys with the highest counts make up most occurrences. A bounded number of them is broadcast, as sorted arrays; the others
go through a join. All keys of a count are on the same side, so a histogram of the counts finds the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 18  # keys that are broadcast at most: 4 MB
STEPS = 8  # steps of the histogram for each doubling


@dataclass
class Frequent:
    keys: np.ndarray  # sorted
    counts: np.ndarray

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, and whether it is known here."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return np.where(known, self.counts[at], 0), known


def divided(counts: DataFrame, most: int = MOST) -> tuple[Frequent, DataFrame]:
    """(key, n) as at most `most` frequent keys in memory and the table of all others."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("keys")).toPandas().sort_values("step", ascending=False)
    fits = sizes[sizes["keys"].cumsum() <= most]
    limit = int(fits["step"].min()) if len(fits) else 1 << 20
    found = counts.where(step >= limit).select("key", "n").toPandas().sort_values("key")
    own = Frequent(found["key"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64))
    return own, counts.where(step < limit).select("key", "n")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys."""
    key, count = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *counts])
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


class Tally:
    """Counts of keys over a task, in at most about twice `most` entries; `add` and `rest` yield what is to be handed on."""

    def __init__(self, most: int = 1 << 21):
        self.most, self.size, self.keys, self.counts = most, 0, [], []

    def add(self, occurrences: np.ndarray):
        key, count = np.unique(occurrences, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.size += len(key)
        if self.size > self.most:
            self.keys, self.counts = ([x] for x in merged(self.keys, self.counts))
            self.size = len(self.keys[0])
            if self.size > self.most // 2:
                yield from self.rest()

    def rest(self):
        key, count = merged(self.keys, self.counts)
        self.size, self.keys, self.counts = 0, [], []
        if len(key):
            yield key, count
