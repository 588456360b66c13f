"""Numeric kernels for short series: numpy alone, no other library."""

from __future__ import annotations

import itertools
import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or tiny)
        c = 1 + top / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1) / a


def f_survival(f: float, df1: int, df2: int) -> float:
    """P(F > f)."""
    if f <= 0 or df2 <= 0:
        return 1.0
    return 1 - incomplete_beta(df1 / 2, df2 / 2, df1 * f / (df1 * f + df2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kendall(y: np.ndarray) -> tuple[float, float]:
    """Tau-b of y against its order, and the two-sided normal p-value with the tie correction."""
    n = len(y)
    signs = np.sign(y[None, :] - y[:, None])
    s = float(np.triu(signs, 1).sum())
    pairs = n * (n - 1) / 2
    ties = np.unique(y, return_counts=True)[1].astype(float)
    tied = float((ties * (ties - 1) / 2).sum())
    if pairs == 0 or pairs == tied:
        return float("nan"), float("nan")
    return s / math.sqrt(pairs * (pairs - tied)), normal_two_sided(s / math.sqrt(kendall_variance(n, ties)))


def kendall_variance(n: int, ties: np.ndarray) -> float:
    return (n * (n - 1) * (2 * n + 5) - float((ties * (ties - 1) * (2 * ties + 5)).sum())) / 18


def theil_sen(y: np.ndarray) -> tuple[float, float, float]:
    """Median of the pairwise slopes and its 95 % interval (Sen 1968)."""
    i, j = np.triu_indices(len(y), 1)
    slopes = np.sort((y[j] - y[i]) / (j - i))
    ties = np.unique(y, return_counts=True)[1].astype(float)
    reach = 1.959963984540054 * math.sqrt(max(0.0, kendall_variance(len(y), ties)))
    n = len(slopes)
    upper = min(n - 1, int(round((n + reach) / 2)))
    lower = max(0, int(round((n - reach) / 2)) - 1)
    return float(np.median(slopes)), float(slopes[lower]), float(slopes[upper])


def pelt_rbf(y: np.ndarray, penalty: float, jump: int = 3, min_size: int = 6) -> list[int]:
    """Change points (ends of segments but the last) of the Gaussian-kernel cost under a linear penalty."""
    n = len(y)
    if n < 2 * min_size:
        return []
    gap = (y[:, None] - y[None, :]) ** 2
    median = np.median(gap[np.triu_indices(n, 1)])
    gram = np.exp(-gap / median) if median > 0 else (gap == 0).astype(float)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = gram.cumsum(0).cumsum(1)
    cost = lambda a, b: (b - a) - (area[b, b] - area[a, b] - area[b, a] + area[a, a]) / (b - a)
    ends = [t for t in range(jump, n, jump) if t >= min_size] + [n]
    best, last = {0: -penalty}, {}
    alive = [0]
    for t in ends:
        options = [(best[s] + cost(s, t) + penalty, s) for s in alive if t - s >= min_size]
        if options:
            best[t], last[t] = min(options)
            alive = [s for s in alive if t - s < min_size or best[s] + cost(s, t) <= best[t]] + [t]
    out, t = [], n
    while t in last and last[t] > 0:
        t = last[t]
        out.append(t)
    return out[::-1]


def cusum_peaks(y: np.ndarray, margin: int = 12, depth: int = 3) -> list[int]:
    """Recursive cumulative-sum peaks: accept a peak that is ``margin`` from both ends, then search both sides."""
    found: list[int] = []
    todo = [(0, len(y), depth)]
    while todo:
        lo, hi, left = todo.pop()
        if left == 0 or hi - lo < 2 * margin:
            continue
        path = np.abs(np.cumsum(y[lo:hi] - y[lo:hi].mean()))
        at = int(path.argmax())
        if margin <= at <= hi - lo - margin:
            found.append(lo + at)
            todo += [(lo, lo + at, left - 1), (lo + at + 1, hi, left - 1)]
    return sorted(p for p in set(found) if 1 < p < len(y) - 1)


def simplex_weights(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minimises w'Gw - 2 g'w over the simplex, by active sets: weights enter by their gradient and leave at zero, until none would enter."""
    k = len(target)
    if not k:
        return np.zeros(0)
    scale = max(float(np.abs(gram).max(initial=0)), float(np.abs(target).max(initial=0)), 1e-300)
    gram, target = np.asarray(gram, float) / scale, np.asarray(target, float) / scale
    w = np.zeros(k)
    w[int((np.diag(gram) - 2 * target).argmin())] = 1
    on = w > 0
    for _ in range(50 * k):
        while True:
            s = np.flatnonzero(on)
            system = np.zeros((len(s) + 1, len(s) + 1))
            system[:-1, :-1], system[:-1, -1], system[-1, :-1] = gram[np.ix_(s, s)], 1, 1
            best = np.linalg.lstsq(system, np.append(target[s], 1.0), rcond=1e-14)[0][:-1]
            if (best > -1e-12).all():
                w[s] = np.clip(best, 0, None)
                break
            falling = best < w[s] - 1e-15
            ratio = np.where(falling & (best < 0), w[s] / np.maximum(w[s] - best, 1e-300), np.inf)
            step = min(1.0, float(ratio.min()))
            w[s] = w[s] + step * (best - w[s])
            out = s[int(ratio.argmin())]
            w[out], on[out] = 0, False
        slope = gram @ w - target
        gain = slope - slope[on].min()
        enter = int(np.where(on, np.inf, gain).argmin())
        if on.all() or gain[enter] > -1e-12:
            break
        on[enter] = True
    return w / w.sum()


def logistic_curve(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(capacity, midpoint, rate, share of the variance) of capacity / (1 + exp(-rate (t - midpoint))) nearest to y, by damped Gauss-Newton from several starts."""
    t, y = np.asarray(t, float), np.asarray(y, float)
    if len(t) < 4 or np.ptp(y) == 0:
        return (math.nan,) * 4
    span, top = max(np.ptp(t), 1e-9), float(np.abs(y).max())
    curve = lambda p: p[0] / (1 + np.exp(-np.clip(p[2] * (t - p[1]), -500, 500)))
    best, least = None, math.inf
    for share, rate in itertools.product((0.25, 0.5, 0.75, 1.0), (4 / span, 12 / span)):
        p, damping = np.array([1.05 * top, t.min() + share * span, rate]), 1e-2
        error = float(((y - curve(p)) ** 2).sum())
        for _ in range(300):
            f = curve(p)
            u = f / p[0]
            slope = np.stack([u, -f * (1 - u) * p[2], f * (1 - u) * (t - p[1])], 1)
            square = slope.T @ slope
            step = np.linalg.lstsq(square + damping * np.diag(np.diag(square) + 1e-12), slope.T @ (y - f), rcond=None)[0]
            new = float(((y - curve(p + step)) ** 2).sum()) if p[0] + step[0] > 0 else math.inf
            if new <= error:
                done = error - new <= 1e-14 * (error + 1e-30)
                p, error, damping = p + step, new, max(damping / 5, 1e-12)
                if done:
                    break
            else:
                damping *= 5
                if damping > 1e12:
                    break
        if error < least * (1 - 1e-9):
            best, least = p, error
    return float(best[0]), float(best[1]), float(best[2]), 1 - least / float(((y - y.mean()) ** 2).sum())


def granger(x: np.ndarray, y: np.ndarray, lags: int = 4) -> tuple[float, float]:
    """F statistic and p-value that lags of x help to explain y beyond y's own."""
    n = len(y)
    df2 = n - lags - 2 * lags - 1
    rows = n - lags
    if rows <= 0 or df2 <= 0:
        return 0.0, 1.0
    column = lambda v, k: v[lags - k : n - k]
    own = np.column_stack([np.ones(rows)] + [column(y, k) for k in range(1, lags + 1)])
    both = np.column_stack([own] + [column(x, k) for k in range(1, lags + 1)])
    rest = lambda m: float(((y[lags:] - m @ np.linalg.lstsq(m, y[lags:], rcond=None)[0]) ** 2).sum())
    small, large = rest(own), rest(both)
    f = ((small - large) / lags) / (large / df2) if large > 0 else 0.0
    return f, f_survival(f, lags, df2)


def upgma_cosine(vectors: np.ndarray, n_clusters: int) -> np.ndarray:
    """Average-linkage clusters by cosine distance; labels numbered by first appearance."""
    n = len(vectors)
    unit = vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    dist = 1 - unit @ unit.T
    np.fill_diagonal(dist, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(max(0, n - n_clusters)):
        i, j = np.unravel_index(int(dist.argmin()), dist.shape)
        i, j = min(i, j), max(i, j)
        row = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = row, row
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    first = {x: k for k, x in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([first[x] for x in label.tolist()])
