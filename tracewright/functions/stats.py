"""Special functions and distribution tails in numpy."""

from __future__ import annotations

import math

import numpy as np


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-squared, by series or continued fraction of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= z / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b += 2
        d = an * d + b
        c = b + an / c
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def fisher_combine(p: list[float]) -> float:
    """Fisher's method: the tail of chi-squared with 2k degrees of freedom has a closed form."""
    if not p:
        return 1.0
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    logs = [i * math.log(half) - math.lgamma(i + 1) if half > 0 else (0.0 if i == 0 else -math.inf) for i in range(len(p))]
    top = max(logs)
    return min(1.0, math.exp(-half + top + math.log(sum(math.exp(x - top) for x in logs))))


def hypergeometric_sf(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) of drawing marked ones: Fisher's exact test, one-sided."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return min(1.0, sum(math.exp(choose(marked, i) + choose(total - marked, drawn - i) - choose(total, drawn)) for i in range(max(k, drawn - (total - marked)), min(marked, drawn) + 1)))


def ols_ssr(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Residual sum of squares and rank of a least-squares fit."""
    beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ beta
    return float(r @ r), int(rank)


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) of average linkage by Lance-Williams updates; new clusters are n, n + 1, ..."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, merges = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        merges.append((ids[i], ids[j], float(d[i, j])))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        ids[i] = n + step
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, height: float | None = None, clusters: int | None = None) -> np.ndarray:
    """Labels from 0 of a linkage cut at a height, or into at most so many clusters."""
    parent = list(range(2 * n - 1))
    use = [m for m in merges if height is None or m[2] <= height]
    if clusters is not None:
        use = merges[: max(0, n - clusters)]
    for k, (a, b, _) in enumerate(merges):
        if (a, b, _) in use[k : k + 1]:
            parent[a] = parent[b] = n + k

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    roots = [root(i) for i in range(n)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; points alone in their cluster count 0."""
    out = []
    for i, own in enumerate(labels):
        mates = (labels == own) & (np.arange(len(labels)) != i)
        if not mates.any():
            out.append(0.0)
            continue
        a = distance[i, mates].mean()
        b = min((distance[i, labels == o].mean() for o in set(labels.tolist()) - {own}), default=0.0)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else 0.0


def pelt(signal: np.ndarray, penalty: float, min_size: int = 8, kernel: str = "rbf") -> list[int]:
    """Change points minimising within-segment kernel scatter plus a penalty each (pruned exact search)."""
    n = len(signal)
    if n < 2 * min_size:
        return []
    x = signal.reshape(n, -1)
    square = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    positive = square[np.triu_indices(n, 1)]
    median = np.median(positive) if len(positive) else 0.0
    gamma = 1 / median if median > 0 else 1.0
    gram = np.exp(-np.clip(gamma * square, 1e-2, 1e2)) if kernel == "rbf" else -square
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = gram.cumsum(axis=0).cumsum(axis=1)
    diagonal = np.append(0, np.cumsum(np.diag(gram)))

    def cost(starts, end):
        block = area[end, end] - area[starts, end] - area[end, starts] + area[starts, starts]
        return diagonal[end] - diagonal[starts] - block / (end - starts)

    best, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.array([0])
    best[0] = -penalty
    for end in range(min_size, n + 1):
        ok = open_[end - open_ >= min_size]
        if len(ok):
            total = best[ok] + cost(ok, end)
            k = int(np.argmin(total))
            best[end], last[end] = total[k] + penalty, ok[k]
            keep = total <= best[end]
            open_ = np.concatenate([ok[keep], open_[end - open_ < min_size]])
        open_ = np.append(open_, end) if np.isfinite(best[end]) else open_
    out, end = [], n
    while last[end] > 0:
        end = last[end]
        out.append(int(end))
    return out[::-1]


def smith_waterman(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """Best local alignment score; rows are computed with a running maximum for the gaps along the row."""
    if not a or not b:
        return 0
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    step = np.arange(1, len(y) + 1) * -gap
    row, top = np.zeros(len(y) + 1, np.int64), 0
    for c in a:
        s = np.where(y == ord(c), match, mismatch)
        free = np.maximum(0, np.maximum(row[:-1] + s, row[1:] + gap))
        row[1:] = np.maximum.accumulate(free + step) - step
        top = max(top, int(row.max()))
    return top
