"""Gaussian mixtures over very many rows: a k-means|| start and expectation-maximisation with a stopping rule.

Rows stay in their tasks. A pass over them returns sums for each component; models, and the candidates of the start
(about 2 x components for each round and label), are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigeval.operators.probes import _log_density, _log_sum, score_windows
from sigeval.session import stage

Model = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights [k], means [k, d], variances [k, d]
TOTAL = -1  # component number of the row that carries a label's log-likelihood


@dataclass(frozen=True)
class Fit:
    """Models by label, and the mean log-likelihood of each label's rows before every step."""

    models: dict[int, Model]
    likelihood: dict[int, list[float]]


def _usable(features: str):
    return F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v) == float("inf")))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[n, k] squared distances."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0.0)


def _by_label(batches: Iterator[pd.DataFrame]):
    for pdf in batches:
        for y, part in pdf.groupby("y"):
            yield int(y), part, np.stack(part["x"].to_numpy())


def _costs(base: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    def run(batches):
        rows = [(y, float(_distances(x, centres[y]).min(axis=1).sum())) for y, _, x in _by_label(batches)]
        yield pd.DataFrame(rows, columns=["y", "cost"])

    return {r.y: r.cost for r in base.select("y", "x").mapInPandas(run, "y int, cost double").groupBy("y").agg(F.sum("cost").alias("cost")).collect()}


def _drawn(base: DataFrame, centres: dict[int, np.ndarray], rate: dict[int, float], seed: int, step: int) -> dict[int, np.ndarray]:
    """Rows drawn with a probability of rate x squared distance; draws depend on the row's stored number only."""

    def run(batches):
        for y, part, x in _by_label(batches):
            part = part[part["u"].to_numpy() < rate[y] * _distances(x, centres[y]).min(axis=1)]
            yield part[["y", "x"]]

    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(step), "row"), 11) / F.lit(float(1 << 53))
    found: dict[int, list] = {y: [] for y in centres}
    for r in base.select("y", "x", u.alias("u")).mapInPandas(run, "y int, x array<double>").distinct().collect():
        found[r.y].append(r.x)
    return {y: np.array(sorted(x), dtype=float) for y, x in found.items() if x}


def _sizes(base: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Number of rows next to each centre."""

    def run(batches):
        for y, _, x in _by_label(batches):
            at, n = np.unique(_distances(x, centres[y]).argmin(axis=1), return_counts=True)
            yield pd.DataFrame({"y": y, "at": at, "n": n})

    sizes = {y: np.zeros(len(c)) for y, c in centres.items()}
    for r in base.select("y", "x").mapInPandas(run, "y int, at int, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).collect():
        sizes[r.y][r["at"]] = r.n
    return sizes


def _reduced(points: np.ndarray, weights: np.ndarray, k: int, seed: int, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """k centres of weighted candidates (k-means++ and Lloyd steps), with the weight of each."""
    rng = np.random.default_rng(seed)
    if len(points) > k:
        chosen = [int(np.argmax(weights))]
        near = _distances(points, points[chosen])[:, 0]
        while len(chosen) < k and (weights * near).sum() > 0:
            mass = weights * near
            chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
            near = np.minimum(near, _distances(points, points[chosen[-1:]])[:, 0])
        centres = points[chosen].copy()
        for _ in range(steps):
            at = _distances(points, centres).argmin(axis=1)
            total = np.bincount(at, weights, len(centres))
            sums = np.stack([np.bincount(at, weights * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
            centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-300)[:, None], centres)
    else:
        centres = points
    return centres, np.bincount(_distances(points, centres).argmin(axis=1), weights, len(centres))


def start(base: DataFrame, k: int, seed: int = 0, rounds: int = 3) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centres and their numbers of rows per label, by k-means|| over (row, y, x)."""
    first = base.groupBy("y").agg(F.min_by("x", F.struct(F.xxhash64(F.lit(seed), "row"), "row")).alias("x")).collect()
    centres = {r.y: np.array([r.x], dtype=float) for r in first}
    for step in range(rounds):
        rate = {y: 2.0 * k / cost if cost > 0 else 0.0 for y, cost in _costs(base, centres).items()}
        for y, x in _drawn(base, centres, rate, seed, step + 1).items():
            centres[y] = np.vstack([centres[y], x])
    sizes = _sizes(base, centres)
    return {y: _reduced(c, sizes[y], k, seed) for y, c in centres.items()}


def _sums(base: DataFrame, models: dict[int, Model]) -> dict[int, tuple[np.ndarray, float]]:
    """Per label: responsibilities and the sums of values and squares under them, [k, 1 + 2 d], and the log-likelihood."""

    def run(batches):
        sums: dict = {}
        total: dict = {}
        for y, _, x in _by_label(batches):
            ll = _log_density(x, *models[y])
            whole = _log_sum(ll)
            resp = np.exp(ll - whole[:, None])
            sums[y] = sums.get(y, 0.0) + np.hstack([resp.sum(axis=0)[:, None], resp.T @ x, resp.T @ x**2])
            total[y] = total.get(y, 0.0) + float(whole.sum())
        for y, m in sums.items():
            k, j = np.indices(m.shape)
            yield pd.DataFrame({"y": y, "k": np.append(k.ravel(), TOTAL), "j": np.append(j.ravel(), 0), "v": np.append(m.ravel(), total[y])})

    t = base.select("y", "x").mapInPandas(run, "y int, k int, j int, v double").groupBy("y", "k", "j").agg(F.sum("v").alias("v"))
    out = {y: np.zeros((len(m[0]), 1 + 2 * m[1].shape[1])) for y, m in models.items()}
    ll = dict.fromkeys(models, 0.0)
    for r in t.collect():  # labels x components x (1 + 2 x dimensions) numbers
        if r.k == TOTAL:
            ll[r.y] = r.v
        else:
            out[r.y][r.k, r.j] = r.v
    return {y: (out[y], ll[y]) for y in models}


def fit(
    df: DataFrame, features: str, label: str, components: int = 256, iterations: int = 50, tolerance: float = 1e-4, seed: int = 0, floor: float = 1e-4
) -> Fit:
    """Diagonal mixtures per label. Steps end when no label's mean log-likelihood grows by more than `tolerance`.

    Values are centred before squares are summed, so that a large mean does not cancel a variance. A label with fewer
    different rows than components gets as many components as it has. Rows with a NULL label or with NULL or infinite cells are left out; no
    row at all is an error.
    """
    x = F.transform(features, lambda v: v.cast("double"))
    kept = df.where(F.col(label).isNotNull() & _usable(features))
    raw = stage(kept.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("int").alias("y"), x.alias("x")))
    cells = raw.select("y", F.posexplode("x").alias("j", "v")).groupBy("y", "j")
    moments = cells.agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("v").alias("n")).orderBy("y", "j").collect()
    if not moments:
        raise ValueError("no rows to fit mixtures to")
    width = 1 + max(r.j for r in moments)
    count = {y: next(r.n for r in moments if r.y == y) for y in sorted({r.y for r in moments})}
    centre = np.array([sum(r.m * r.n for r in moments if r.j == j) for j in range(width)]) / sum(count.values())
    # NumPy arrays go to the tasks as literals of the plan; they have one number for each dimension
    base = raw.withColumn("x", F.zip_with("x", F.array(*[F.lit(float(c)) for c in centre]), lambda v, c: v - c))

    models: dict[int, Model] = {}
    for y, (mu, n) in start(base, components, seed).items():
        spread = np.array([r.s for r in moments if r.y == y])
        models[y] = (np.maximum(n, 0.5) / np.maximum(n, 0.5).sum(), mu, np.tile(np.maximum(spread, floor), (len(mu), 1)))
    history: dict[int, list[float]] = {y: [] for y in models}
    for _ in range(iterations):
        sums = _sums(base, models)
        for y, (_, ll) in sums.items():
            history[y].append(ll / count[y])
        if all(len(h) > 1 and h[-1] - h[-2] <= tolerance for h in history.values()):
            break
        models = {y: _model(m, floor) for y, (m, _) in sums.items()}
    return Fit({y: (w, mu + centre, var) for y, (w, mu, var) in models.items()}, history)


def _model(m: np.ndarray, floor: float) -> Model:
    d = (m.shape[1] - 1) // 2
    n = np.maximum(m[:, :1], 1e-10)
    mu = m[:, 1 : 1 + d] / n
    return n[:, 0] / n.sum(), mu, np.maximum(m[:, 1 + d :] / n - mu**2, floor)


def item_ratio(df: DataFrame, keys: list[str], features: str, models: dict[int, Model], name: str = "logit") -> DataFrame:
    """Mean over an item's rows of the log-likelihood ratio of label 1 against label 0, and the number of rows.

    Rows with NULL or infinite cells do not count; an item without any other row gives none.
    """
    missing = {0, 1} - set(models)
    if missing:
        raise ValueError(f"no mixture for labels {sorted(missing)}")
    scored = score_windows(df.where(_usable(features)).select(*keys, features), features, lambda x: _ratio(x, models), "_llr")
    return scored.groupBy(*keys).agg(F.avg("_llr").alias(name), F.count(F.lit(1)).alias("n_rows"))


def _ratio(x: np.ndarray, models: dict[int, Model]) -> np.ndarray:
    """Densities of centred values, for the sake of their digits."""
    centre = models[0][1].mean(axis=0)
    one, zero = ((w, mu - centre, var) for w, mu, var in (models[1], models[0]))
    return _log_sum(_log_density(x - centre, *one)) - _log_sum(_log_density(x - centre, *zero))
