"""A task's rows read in blocks, and models and selectors from their sums of products.

The rows are held once, in the order in which they came; scaled values are made block by block, so what is needed
besides is a few numbers per row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa

from . import models as M

#: Rows whose scaled values are held at once.
BLOCK = 4096


def pieces(at: np.ndarray):
    for i in range(0, len(at), BLOCK):
        yield at[i : i + BLOCK]


def read(batches, features: list[str], numbers: list[str], other: str) -> tuple[np.ndarray, list[np.ndarray], pa.Array, dict]:
    """The features as one matrix (infinite values missing), the numbers, the other column, and the first row.

    What is kept are copies, since a column of a batch would keep the whole batch; the matrix grows where it is.
    """
    x, few, more, first = np.empty((0, len(features))), [], [], {}
    for b in batches:
        if not b.num_rows:
            continue
        first = first or {n: b.column(n)[0].as_py() for n in b.schema.names if n not in features}
        n = len(x)
        x.resize((n + b.num_rows, len(features)), refcheck=False)
        for j, f in enumerate(features):
            x[n:, j] = b.column(f).to_numpy(zero_copy_only=False)
        x[n:][~np.isfinite(x[n:])] = np.nan
        few.append([np.array(b.column(c).to_numpy(zero_copy_only=False), float) for c in numbers])
        more.append(pa.concat_arrays([b.column(other).dictionary_encode(), pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], b.column(other).type))]))
    return x, [np.concatenate(c) for c in zip(*few, strict=True)], pa.chunked_array(more).unify_dictionaries().combine_chunks() if more else None, first


@dataclass
class Scaled:
    """z-scores of the rows at of x, missing values filled; both after training rows. logged: columns taken by logarithm."""

    x: np.ndarray
    at: np.ndarray
    logged: tuple[int, ...] = ()
    floor: float = 0.0
    columns: np.ndarray | None = None
    fill: np.ndarray | None = None
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.columns is None:
            self.columns = np.arange(self.x.shape[1])

    def __len__(self) -> int:
        return len(self.at)

    def fitted(self, impute: bool = True) -> Scaled:
        """With medians, means and deviations of its own rows; without imputing, missing values become the mean."""
        fill, mean, sd = np.zeros(self.x.shape[1]), np.zeros(self.x.shape[1]), np.ones(self.x.shape[1])
        for j in range(self.x.shape[1]):
            v = self.x[self.at, j]
            if j in self.logged:
                v = np.log(np.maximum(v, self.floor))
            there = np.isfinite(v)
            fill[j] = np.median(v[there]) if there.any() else 0.0
            v = np.where(there, v, fill[j]) if impute else v[there]
            mean[j] = v.mean() if len(v) else 0.0
            sd[j] = v.std() if len(v) and v.std() > 0 else 1.0
        return replace(self, fill=fill if impute else mean, mean=mean, sd=sd)

    def like(self, train: Scaled) -> Scaled:
        return replace(self, fill=train.fill, mean=train.mean, sd=train.sd)

    def only(self, kept: np.ndarray) -> Scaled:
        return replace(self, columns=self.columns[kept])

    def block(self, at: np.ndarray) -> np.ndarray:
        """Of its own rows at these places."""
        z = self.x[self.at[at]]
        if self.logged:
            z[:, self.logged] = np.log(np.maximum(z[:, self.logged], self.floor))
        if not np.array_equal(self.columns, np.arange(z.shape[1])):
            z = z[:, self.columns]
        fill, mean, sd = (v[self.columns] for v in (self.fill, self.mean, self.sd))
        gaps = np.nonzero(~np.isfinite(z))
        z[gaps] = fill[gaps[1]]
        z -= mean
        z /= sd
        return np.nan_to_num(z, copy=False, nan=0.0, posinf=0.0, neginf=0.0)

    def column(self, j: int) -> np.ndarray:
        one = self.only(np.array([j]))
        return np.concatenate([np.zeros(0), *(one.block(at)[:, 0] for at in pieces(np.arange(len(self))))])

    def apply(self, f) -> np.ndarray:
        """f of the scaled values, row by row."""
        return np.concatenate([f(self.block(at)) for at in pieces(np.arange(len(self)))]) if len(self) else np.zeros(0)

    def products(self, y: np.ndarray, w: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """Weighted sums of products of (1, scaled values, y) over its rows, or over those at these places."""
        gram = np.zeros((len(self.columns) + 2, len(self.columns) + 2))
        for some in pieces(np.arange(len(self)) if at is None else at):
            d = np.column_stack([np.ones(len(some)), self.block(some), y[some]])
            gram += d.T @ (d if w is None else d * w[some, None])
        return gram


def fit(name: str, k: int, s: Scaled, y: np.ndarray, w: np.ndarray | None = None) -> M.PLS:
    """The architecture's model of y on the scaled values."""
    model = M.build(name, k)
    target = model.target(y)
    shift = target.mean() if len(target) else 0.0
    model.fit_gramian(s.products(target - shift, w), len(s))
    model.y_mean = model.y_mean + shift
    if isinstance(model, M.NonlinearPLS):
        model.bend(s.apply(model.scores), y)
    return model


def _scores(name: str, s: Scaled, y: np.ndarray, k: int) -> np.ndarray:
    gram, n = s.products(y - y.mean()), len(s)
    m = M.PLS(k).fit_gramian(gram, n)
    if name == "vip":
        return m.vip()
    mean = gram[0] / gram[0, 0]
    c = (gram - gram[0, 0] * np.outer(mean, mean))[1:-1, 1:-1]
    b, total = m.coef[:, 0], np.diag(c)
    size = b @ b
    if name == "sr":
        u = b / (np.sqrt(size) or 1.0)
        tt = u @ c @ u
        explained = (c @ u / (tt or 1.0)) ** 2 * tt
        return np.where(total > 0, explained / np.maximum(total - explained, 1e-12 * np.maximum(total, 1e-300)), 0.0)
    t = c @ b / (size or 1.0)
    tt = b @ t / (size or 1.0)
    rest = total - 2 * b * t + b * b * tt
    return M.significance(np.where(total > 0, b * b * tt / np.maximum(rest / max(1, n - 2), 1e-300), 0.0), n)


def select(name: str, s: Scaled, y: np.ndarray, threshold: float | None, k: int, seed: int) -> np.ndarray:
    """models.select on scaled values."""
    if name == "none":
        return np.arange(len(s.columns))
    if name == "mi":
        scores = np.array([M.numerics.mutual_information(s.column(j), y, seed=seed) for j in range(len(s.columns))])
    else:
        scores = _scores(name, s, y, k)
    return M._chosen(scores, M.THRESHOLDS[name] if threshold is None else threshold)


def temporal_select(s: Scaled, sensor: np.ndarray, time: np.ndarray, threshold: float | None) -> np.ndarray:
    own, cells = M.sensor_cells(sensor, time)
    return M._chosen(np.array([M.temporal_share(s.column(j), own, cells) for j in range(len(s.columns))]), threshold or 0.0)


def cars(s: Scaled, y: np.ndarray, k_max=5, generations=50, n_folds=5, sample_ratio=0.9, patience=10, seed=0) -> np.ndarray:
    """models.cars on scaled values, by the same draws: models without some rows come from the sums without theirs."""
    rng = np.random.default_rng(seed)
    n, p = len(s), len(s.columns)
    if p <= 2 or generations < 2:
        return np.arange(p)
    y = y - y.mean()
    rate = np.log(p / 2) / (generations - 1)
    part = int(sample_ratio * n)
    alive, best, best_error, idle = np.arange(p), np.arange(p), np.inf, 0
    whole = s.products(y)
    within = lambda kept: np.ix_(at := np.r_[0, kept + 1, p + 1], at)
    for g in range(generations):
        gram, rows = whole[within(alive)], n
        if part > 2 * k_max:
            left = np.ones(n, bool)
            left[rng.choice(n, part, replace=False)] = False
            gram, rows = gram - s.only(alive).products(y, at=np.flatnonzero(left)), part
        k = min(k_max, rows - 1, len(alive))
        try:
            weight = np.abs(M.PLS(k).fit_gramian(gram, rows).coef[:, 0]) if k >= 1 else None
        except ValueError:
            weight = None
        if weight is None:
            break
        n_keep = max(2, round(p * np.exp(-rate * g)))
        alive = alive[np.argsort(-weight, kind="stable")[:n_keep]]
        error = _cv_error(s.only(alive), y, min(k_max, len(alive)), np.array_split(rng.permutation(n), min(n_folds, n)))
        if error < best_error - 1e-9:
            best, best_error, idle = alive, error, 0
        else:
            idle += 1
        if idle >= patience or len(alive) <= 2:
            break
    return np.sort(best)


def _cv_error(s: Scaled, y: np.ndarray, k: int, folds: list[np.ndarray]) -> float:
    grams = [s.products(y, at=np.sort(f)) for f in folds]
    whole, error = sum(grams), 0.0
    for gram, f in zip(grams, folds, strict=True):
        if len(y) - len(f) < 3:
            return np.inf
        try:
            m = M.PLS(k).fit_gramian(whole - gram, len(y) - len(f))
        except ValueError:
            return np.inf
        b = m.coef[:, 0]
        v = np.r_[-(m.y_mean[0] - m.x_mean @ b), -b, 1.0]
        error += max(0.0, v @ gram @ v)
    return float(np.sqrt(error / len(y)))


def ridge_loo(s: Scaled, y: np.ndarray, alphas=M.ALPHAS) -> M.Ridge:
    """models.ridge_loo on scaled values: directions from their sums of products, leave-one-out errors block by block."""
    n, my = len(y), y.mean()
    gram = s.products(y - my)
    mx = gram[0, 1:-1] / n
    values, vectors = np.linalg.eigh(gram[1:-1, 1:-1] - n * np.outer(mx, mx))
    values = np.maximum(values, 0.0)
    bearing = vectors.T @ gram[1:-1, -1]
    coefs = [vectors @ (bearing / (values + a)) for a in alphas]
    error = np.zeros(len(alphas))
    for at in pieces(np.arange(n)):
        z = s.block(at) - mx
        along = (z @ vectors) ** 2
        for i, a in enumerate(alphas):
            leverage = along @ (1 / (values + a)) + 1 / n
            error[i] += (((y[at] - my - z @ coefs[i]) / np.maximum(1 - leverage, 1e-12)) ** 2).sum()
    best = int(np.argmin(error))
    return M.Ridge(coefs[best], float(my - mx @ coefs[best]), float(alphas[best]))


def logistic(s: Scaled, y: np.ndarray, c: float = 0.5, steps: int = 50) -> tuple[np.ndarray, float]:
    """models.logistic on scaled values; gradients and curvatures are summed block by block."""
    n, p = len(y), len(s.columns)
    w = np.where(y == 1, n / (2 * max(1, y.sum())), n / (2 * max(1, (1 - y).sum())))
    penalty, beta = np.append(np.full(p, 1 / c), 1e-8), np.zeros(p + 1)
    for _ in range(steps):
        g, h = penalty * beta, np.diag(penalty)
        for at in pieces(np.arange(n)):
            a = np.column_stack([s.block(at), np.ones(len(at))])
            q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
            g = g + a.T @ (w[at] * (q - y[at]))
            h = h + (a.T * (w[at] * q * (1 - q))) @ a
        move = np.linalg.solve(h, g)
        beta -= move
        if np.abs(move).max() < 1e-9:
            break
    return beta[:-1], float(beta[-1])
