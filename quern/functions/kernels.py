"""Numerical kernels in numpy for grouped-map operators; all random draws come from a generator seeded by the group's key."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


# Special functions ---------------------------------------------------------------------------------------------------


def inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - inc_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


@lru_cache(maxsize=1 << 16)
def inv_beta(a: float, b: float, p: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if inc_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def inc_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or 1e-300), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_test(r: float, n: int) -> float:
    """Two-sided p of a Pearson correlation."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return inc_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def fit_dirichlet(p: np.ndarray, steps: int = 500) -> np.ndarray:
    """Maximum-likelihood alpha of rows of probabilities, by fixed point on the mean log."""
    logs = np.log(np.maximum(p, 1e-12)).mean(axis=0)
    m, v = p.mean(axis=0), p.var(axis=0)
    alpha = np.maximum(m * max(1e-2, (m[0] * (1 - m[0]) / max(v[0], 1e-9)) - 1), 1e-3)
    for _ in range(steps):
        y = digamma(np.array([alpha.sum()]))[0] + logs
        x = np.where(y >= -2.22, np.exp(y) + 0.5, -1 / (y + 0.5772156649))
        for _ in range(6):
            h = 1e-5 * x
            x = np.maximum(x - (digamma(x) - y) / ((digamma(x + h) - digamma(x - h)) / (2 * h)), 1e-8)
        if np.abs(x - alpha).max() < 1e-9:
            break
        alpha = x
    return alpha


def dirichlet_fixed_point(counts: list[tuple[int, int, int]], lengths: list[tuple[int, int]], k: int, start: float, uniform: bool, steps: int = 100, eps: float = 1e-13) -> np.ndarray:
    """The parameters of a Dirichlet-multinomial from histograms: ``counts`` of (component, count, how often), ``lengths`` of (total,
    how often). ``uniform``: all components have one. Each step scales by ratios of digamma differences."""
    alpha = np.full(k, float(start))
    c, n, m = (np.array(v, float) for v in (zip(*counts) if counts else ((), (), ())))
    length, often = (np.array(v, float) for v in (zip(*lengths) if lengths else ((), ())))
    for _ in range(steps):
        up = np.bincount(c.astype(int), weights=m * (digamma(n + alpha[c.astype(int)]) - digamma(alpha[c.astype(int)])), minlength=k)
        total = alpha.sum()
        down = float((often * (digamma(length + total) - digamma(np.full_like(length, total)))).sum())
        if down <= 0:
            break
        new = np.maximum(np.full(k, alpha[0] * up.sum() / (k * down)) if uniform else alpha * up / down, 1e-10)
        moved = np.abs(new - alpha).max()
        alpha = new
        if moved < eps:
            break
    return alpha


def dirichlet_ll(p: np.ndarray, alpha: np.ndarray) -> float:
    return float(len(p) * (math.lgamma(alpha.sum()) - sum(map(math.lgamma, alpha))) + ((alpha - 1) * np.log(np.maximum(p, 1e-12))).sum())


def dirichlet_ratio_test(a: np.ndarray, b: np.ndarray) -> float:
    """p that both samples come from one Dirichlet distribution: likelihood ratio, chi-square with n degrees."""
    both = np.concatenate((a, b))
    stat = 2 * (dirichlet_ll(a, fit_dirichlet(a)) + dirichlet_ll(b, fit_dirichlet(b)) - dirichlet_ll(both, fit_dirichlet(both)))
    return 1 - inc_gamma(a.shape[1] / 2, max(stat, 0) / 2)


# Regression ------------------------------------------------------------------------------------------------------------


def soft(v: np.ndarray, level: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - level, 0)


def sqrt_lasso(x: np.ndarray, y: np.ndarray, level: float, eps: float = 1e-6, path: int = 5) -> np.ndarray:
    """argmin ||y - x b|| / sqrt(n) + level * |b|_1 along a path of falling levels: proximal gradient with line search."""
    n, d = x.shape
    b = np.zeros(d)
    loss = lambda b: np.linalg.norm(y - x @ b) / math.sqrt(n)
    top = np.abs(x.T @ y).max() / (math.sqrt(n) * max(np.linalg.norm(y), 1e-12))
    for lam in np.geomspace(max(top, level), level, path):
        step = 1.0
        for _ in range(2000):
            r = y - x @ b
            norm = np.linalg.norm(r)
            if norm < 1e-10:
                break
            grad = -(x.T @ r) / (norm * math.sqrt(n))
            now = loss(b)
            while True:
                new = soft(b - step * grad, step * lam)
                diff = new - b
                if loss(new) <= now + grad @ diff + diff @ diff / (2 * step) + 1e-15 or step < 1e-12:
                    break
                step /= 2
            b = new
            if np.abs(diff).max() < eps:
                break
            step *= 1.5
    return b


def approximate_inverse(cov: np.ndarray, mu: float, fixed: bool = False, resolution: float = 1.3, most: int = 32, eps: float = 1e-2, attempts: int = 9) -> np.ndarray:
    """Rows m that minimise m S m / 2 - m_i + mu |m|_1, each for the least mu that still converges within ``most`` passes.

    Coordinate descent over all rows at once. A row starts at ``mu`` and takes mu down by ``resolution`` while it converges, up
    while it doesn't; with ``fixed`` mu stays.
    """
    d = len(cov)
    diag, off = np.diag(cov).copy(), cov - np.diag(np.diag(cov))
    alone = np.abs(off).max(axis=1) / diag
    alone = alone / (1 + alone)  # from this mu on only the row's own coordinate is left

    def descend(rows: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, passes = np.zeros((len(rows), d)), np.zeros(len(rows), int)
        b[np.arange(len(rows)), rows] = (1 - alone[rows]) / diag[rows]
        at = np.flatnonzero(level < alone[rows])
        passes[at] = 1
        moved, checked, v = np.zeros((len(rows), d)), np.ones(len(rows), int), -b @ off
        while len(at):
            for j in range(d):
                new = soft(v[at, j] + (rows[at] == j), level[at]) / diag[j]
                step = new - b[at, j]
                v[at] -= step[:, None] * off[j]
                b[at, j] = new
                moved[at, j] += step
            passes[at] += 1
            due = at[passes[at] >= 2 * checked[at]]
            still = np.linalg.norm(moved[due], axis=1) < eps * np.linalg.norm(b[due], axis=1)
            moved[due], checked[due] = 0, passes[due]
            at = at[(passes[at] <= most) & ~np.isin(at, due[still])]
        return b, passes

    every = np.arange(d)
    level = np.full(d, mu)
    out, passes = descend(every, level)
    if fixed:
        return out
    rising = passes > most
    rows = every
    for _ in range(attempts - 1):
        level[rows] *= np.where(rising[rows], resolution, 1 / resolution)
        new, passes = descend(rows, level[rows])
        good = passes <= most
        # Rising rows take the first that converges; falling ones the last that did.
        out[rows[good | rising[rows]]] = new[good | rising[rows]]
        rows = rows[np.where(rising[rows], ~good, good)]
        if not len(rows):
            break
    return out


def debiased(x: np.ndarray, y: np.ndarray, fixed: bool = False, inverse: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lasso coefficients, absolute scores, p) of the de-biased square-root lasso on standardised columns.

    The noise comes from the scores' median absolute deviation: coordinates within three of it count as noise. ``inverse`` may
    give the approximate inverse of x's correlations (``approximate_inverse``), which many y share.
    """
    n, d = x.shape
    sd = x.std(axis=0)
    if (sd <= 0).any():
        raise ValueError("a column is constant")
    z, yc = (x - x.mean(axis=0)) / sd, y - y.mean()
    b = sqrt_lasso(z, yc, math.sqrt(NORMAL.inv_cdf(1 - 0.1 / d) / n))
    cov = z.T @ z / n
    m = approximate_inverse(cov, NORMAL.inv_cdf(1 - 0.1 / d**2) / math.sqrt(n), fixed) if inverse is None else inverse
    full = b + m @ z.T @ (yc - z @ b) / n
    a = np.einsum("ij,jk,ik->i", m, cov, m)
    unit = full / np.sqrt(np.maximum(a, 1e-300)) * math.sqrt(n)
    mad = 1.4826 * float(np.median(np.abs(unit - np.median(unit))))
    near = np.abs(unit) <= 3 * mad
    noise = math.sqrt(n * (full[near] @ full[near]) / a[near].sum()) if a[near].sum() else mad
    score = np.where((full != 0) & (a > 0), np.abs(full) * math.sqrt(n) / (max(noise, 1e-12) * np.sqrt(np.maximum(a, 1e-300))), 0.0)
    return b / sd, score, np.array([2 * (1 - NORMAL.cdf(v)) for v in score])


def fit_var(series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """VAR(1): (coefficients, p-values), one row per component, from T x K values."""
    x, y = series[:-1], series[1:]
    rows = [debiased(x, y[:, k]) for k in range(series.shape[1])]
    return np.array([r[0] for r in rows]), np.array([r[2] for r in rows])


def random_var(rng: np.random.Generator, k: int, density: float, radius: float) -> np.ndarray:
    a = rng.normal(size=(k, k)) * (rng.random((k, k)) < density)
    top = np.abs(np.linalg.eigvals(a)).max()
    return a * (radius / top) if top > 0 else a


def simulate_var(rng: np.random.Generator, a: np.ndarray, steps: int, noise: float) -> np.ndarray:
    out = np.zeros((steps, len(a)))
    for t in range(1, steps):
        out[t] = a @ out[t - 1] + rng.normal(scale=noise, size=len(a))
    return out


def jj_threshold(z: np.ndarray, alpha: float) -> float:
    """Least absolute score that is significant at false-discovery rate alpha."""
    z = np.sort(np.abs(z))
    d = len(z)
    if d < 2:
        return NORMAL.inv_cdf(1 - alpha / 2) if d else math.inf
    most = math.sqrt(max(0.0, 2 * math.log(d) - 2 * math.log(max(math.log(d), 1e-9))))
    for i in range(d):
        q = NORMAL.inv_cdf(1 - alpha * (d - i) / (2 * d))
        if q > most:
            break
        if q <= z[i]:
            return float(z[i])
    return 2 * math.log(d)


def granger_scores(dst: np.ndarray, src: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of the coefficients' size that lies on src, absolute scores of src, of all) for T x K series: one de-biased regression
    for each component of dst on the step before of both. Components that never differ from 0 or from their mean are left out."""
    def lively(a):
        a = a[:, np.abs(a).max(axis=0) > 1e-7]
        a = a - a.mean(axis=0)
        return a[:, np.abs(a[:-1]).max(axis=0) > 1e-7] if len(a) > 1 else a[:, :0]

    dst, src = lively(dst), lively(src)
    x = np.concatenate((dst, src), axis=1)[:-1]
    vary = x.std(axis=0) > 1e-9
    own = np.arange(x.shape[1]) < dst.shape[1]
    x, own = x[:, vary], own[vary]
    if not own.any() or own.all() or len(x) < 3:
        return 0.0, np.zeros(0), np.zeros(0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    inverse = approximate_inverse(z.T @ z / len(x), NORMAL.inv_cdf(1 - 0.1 / x.shape[1] ** 2) / math.sqrt(len(x)))
    rows = [debiased(x, dst[1:, k], inverse=inverse)[:2] for k in range(dst.shape[1])]
    size, scores = np.abs(np.array([r[0] for r in rows])), np.array([r[1] for r in rows])
    return (float(size[:, ~own].sum() / size.sum()) if size.sum() else 0.0), scores[:, ~own].ravel(), scores.ravel()


def granger(dst: np.ndarray, src: np.ndarray, alpha: float = 0.05) -> tuple[float, bool, np.ndarray]:
    """(share of the coefficients' size that lies on src, significant?, scores of src)."""
    share, own, every = granger_scores(dst, src)
    return share, bool(len(own) and (own >= jj_threshold(every, alpha)).any()), own


# Tests -----------------------------------------------------------------------------------------------------------------


def benjamini_hochberg(p: np.ndarray, alpha: float) -> list[int]:
    order = np.argsort(p, kind="stable")
    ok = np.flatnonzero(p[order] <= (np.arange(len(p)) + 1) / len(p) * alpha) if len(p) else []
    return sorted(order[: ok[-1] + 1].tolist()) if len(ok) else []


def kth_permutation(n: int, k: int) -> list[int]:
    rest, out = list(range(n)), []
    for i in range(n, 0, -1):
        at, k = divmod(k, math.factorial(i - 1))
        out.append(rest.pop(at))
    return out


def fit_beta(mean: float, var: float) -> tuple[float, float]:
    """Parameters of a Beta distribution with these moments; uniform where there is none, or no spread."""
    if not 1e-12 < var < mean * (1 - mean):
        return 1.0, 1.0
    k = mean * (1 - mean) / var - 1
    return mean * k, (1 - mean) * k


def at_distance(rng: np.random.Generator, prior: np.ndarray, center: np.ndarray, far: float, tries: int = 100) -> np.ndarray:
    """A distribution at L1 distance ``far`` from ``center``, in the direction of a Dirichlet draw. Where the simplex ends before, another
    direction is drawn; after ``tries`` of them the farthest point of the last one counts."""
    for _ in range(tries):
        step = rng.dirichlet(prior) - center
        size = np.abs(step).sum()
        if size < 1e-12:
            continue
        down = step < 0
        most = (center[down] / -step[down]).min() if down.any() else 1.0
        if far / size <= most:
            return np.maximum(center + step * far / size, 0)
    return np.maximum(center + step * most, 0)


#: Cells (sources x samples x steps x components) that are compared at once.
LAG_CELLS = 500_000


def lagged_similarity(src: np.ndarray, before: np.ndarray, after: np.ndarray, least: int = 0) -> float:
    """How well src (T x K, nan: missing) meets, a step later, the direction of the changes from ``before`` to ``after``; nan with fewer
    than ``least`` active steps."""
    t = len(src)
    ok = ~np.isnan(src[:-1, 0]) & ~np.isnan(before[:-1, 0]) & ~np.isnan(after[1:, 0])
    if ok.sum() < least:
        return math.nan
    s, p, q = src[:-1][ok], before[:-1][ok], after[1:][ok]
    up = np.maximum(q - p, 0)
    total = up.sum(axis=1)
    direction = np.where(total[:, None] > 0, up / np.maximum(total, 1e-300)[:, None], 1 / src.shape[1])
    magnitude = total / np.maximum(1 - np.minimum(p.min(axis=1), 1), 1e-300)
    x = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0)
    d = (0.5 * (x(s) + x(direction)) - x((s + direction) / 2)).sum(axis=1)
    return float((magnitude * np.maximum(math.log(2) - d, 0)).sum() / (math.log(2) * (t - 1)))


def xlogx(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0)


def lagged_similarities(src: np.ndarray, before: np.ndarray, after: np.ndarray, least: int = 0) -> np.ndarray:
    """``lagged_similarity`` of every source (E x T x K) with the changes from ``before`` (T x K) to every ``after`` (S x T x K), E x S. All of
    ``after`` miss the same steps."""
    s, t = src[:, :-1], before.shape[0]
    there = ~np.isnan(before[:-1, 0]) & ~np.isnan(after[0, 1:, 0])
    s, p, q = s[:, there], before[:-1][there], after[:, 1:][:, there]
    ok = ~np.isnan(s[:, :, 0])
    s = np.where(ok[:, :, None], s, 0)
    up = np.maximum(q - p, 0)
    total = up.sum(axis=2)
    direction = np.where(total[..., None] > 0, up / np.maximum(total, 1e-300)[..., None], 1 / src.shape[2])
    magnitude = total / np.maximum(1 - np.minimum(p.min(axis=1), 1), 1e-300) if len(p) else total
    out, xs, xd = np.empty((len(src), len(after))), xlogx(s), xlogx(direction)
    take = max(1, LAG_CELLS // max(direction.size, 1))
    for i in range(0, len(src), take):
        part = slice(i, i + take)
        d = (0.5 * (xs[part, None] + xd) - xlogx((s[part, None] + direction) / 2)).sum(axis=3)
        out[part] = (magnitude * np.maximum(math.log(2) - d, 0) * ok[part, None]).sum(axis=2) / (math.log(2) * (t - 1))
    out[ok.sum(axis=1) < least] = math.nan
    return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100, starts: int = 10) -> tuple[np.ndarray, np.ndarray, float]:
    """(cluster of each point, exemplar of each cluster: the point nearest to its centre, sum of squares): best of several starts."""
    best = None
    for _ in range(starts):
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        if best is None or d.min(axis=1).sum() < best[2]:
            best = d.argmin(axis=1), d.argmin(axis=0), float(d.min(axis=1).sum())
    return best


def monte_carlo(observed: float, draw, rng: np.random.Generator, most: int = 2000, batch: int = 100, alpha: float = 0.05, draws=None) -> tuple[float, int]:
    """(p, samples) of a sequential test: stops when the Clopper-Pearson bounds at a spent error lie on one side of alpha. ``draws`` gives
    a whole batch at once."""
    over = n = 0
    while n < most:
        over += int((draws(rng) > observed).sum()) if draws else sum(draw(rng) > observed for _ in range(batch))
        n += batch
        spent = 1e-3 * n / (n + 1000)
        low = inv_beta(over, n - over + 1, spent / 2) if over else 0.0
        high = inv_beta(over + 1, n - over, 1 - spent / 2) if over < n else 1.0
        if low > alpha or high < alpha:
            break
    return (1 + over) / (1 + n), n


def jsd(a: np.ndarray, b: np.ndarray) -> float:
    m = (a + b) / 2
    f = lambda x: float(np.sum(x[x > 0] * np.log(x[x > 0])))
    return max(0.0, 0.5 * (f(a) + f(b)) - f(m))


def permuted_scores(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """E x T x (T - 1): how well each row of each source (E x T x K) meets each change of its target."""
    up = np.maximum(t[:, 1:] - t[:, :-1], 0)
    tot = up.sum(axis=2)
    dirs = np.where(tot[..., None] > 0, up / np.maximum(tot, 1e-300)[..., None], 1 / t.shape[2])
    mag = tot / np.maximum(1 - t[:, :-1].min(axis=2), 1e-300)
    f = lambda v: xlogx(v).sum(axis=-1)
    far = np.maximum(0.5 * (f(s)[:, :, None] + f(dirs)[:, None]) - f((s[:, :, None] + dirs[:, None]) / 2), 0)
    return mag[:, None] * np.maximum(math.log(2) - far, 0)


def permutation_p(scores: np.ndarray, rng: np.random.Generator, most: int, batch: int) -> float:
    """p that a permuted source (rows of ``scores``, T x (T - 1)) meets the changes better, by ``monte_carlo`` with whole batches of draws."""
    t, at = len(scores), np.arange(len(scores) - 1)
    every = np.tile(np.arange(t), (batch, 1))
    # Sums run in one order, so that permutations of like rows stay ties.
    add = lambda rows: np.cumsum(scores[rows[:, :-1], at], axis=1)[:, -1]
    observed = add(every[:1])[0]
    return monte_carlo(observed, None, rng, most, batch, draws=lambda g: add(g.permuted(every, axis=1)))[0]


# Sets of vertices ----------------------------------------------------------------------------------------------------------


def reached(src: np.ndarray, to: list, near: list, via: np.ndarray, on: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, sum, own: whether src is one of them) of the vertices of each source: those in ``near`` and those that any of ``to`` leads
    ``on`` to. Vertices with more of them than words of bits are kept as bits: never more than 8 bytes an edge."""
    empty = np.zeros(0, np.int64)
    flat = np.concatenate([empty, *on]).astype(np.int64)
    ids = np.unique(np.concatenate([flat, *near]).astype(np.int64))
    if not len(ids):
        return tuple(np.zeros(len(src), np.int64) for _ in range(3))
    words = -(-len(ids) // 64)
    pack = lambda flags: np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)
    ends = np.cumsum([0, *map(len, on)])
    place, order = np.searchsorted(ids, flat), np.argsort(via)
    known, low = via[order], ids.min()
    heavy = np.diff(ends) > words
    row = np.cumsum(heavy) - 1
    bits = np.zeros((int(heavy.sum()), words), np.uint64)
    flags = np.zeros(words * 64, bool)
    for i in np.flatnonzero(heavy):
        flags[:] = False
        flags[place[ends[i] : ends[i + 1]]] = True
        bits[row[i]] = pack(flags)
    planes = [b for b in range(63) if (ids.max() - low) >> b]
    digits = np.zeros((len(planes), words * 64), bool)
    for k, b in enumerate(planes):
        digits[k, : len(ids)] = (ids - low) >> b & 1
    digits, weight = pack(digits), np.array([1 << b for b in planes], np.int64)
    n, total, own = (np.zeros(len(src), np.int64) for _ in range(3))
    home = np.minimum(np.searchsorted(ids, src), len(ids) - 1)
    for k, (targets, close) in enumerate(zip(to, near)):
        at = np.minimum(np.searchsorted(known, targets), max(len(known) - 1, 0))
        at = order[at[known[at] == targets]] if len(known) else np.zeros(0, int)
        big = heavy[at]
        light = [place[ends[i] : ends[i + 1]] for i in at[~big]]
        if len(close):
            light.append(np.searchsorted(ids, close))
        got = np.bitwise_or.reduce(bits[row[at[big]]], axis=0) if big.any() else np.zeros(words, np.uint64)
        if light:
            flags[:] = False
            flags[np.concatenate(light)] = True
            got = got | pack(flags)
        n[k] = np.bitwise_count(got).sum()
        total[k] = n[k] * low + np.bitwise_count(digits & got).sum(axis=1, dtype=np.int64) @ weight
        i = home[k]
        own[k] = ids[i] == src[k] and int(got[i >> 6]) >> int(i & 63) & 1
    return n, total, own


#: Pairs that are counted at once; a target is counted by a product of matrices if it has more than one in so many of a tile's pairs.
PAIR_CELLS, DENSE = 4_000_000, 256


def shared_counts(a: np.ndarray, to_a: list, b: np.ndarray, to_b: list, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source of a, source of b, number of targets that both have) of the pairs with at least ``least`` of them, a tile at a time."""
    column = np.unique(np.concatenate([np.zeros(0, np.int64), *to_b]).astype(np.int64))
    if not len(a) or not len(column):
        return

    def entries(to):
        row, t = np.repeat(np.arange(len(to)), [len(x) for x in to]), np.concatenate(to).astype(np.int64)
        at = np.minimum(np.searchsorted(column, t), len(column) - 1)
        return row[column[at] == t], at[column[at] == t]

    rb, cb = entries(to_b)
    order = np.argsort(cb, kind="stable")
    rb, cb = rb[order], cb[order]
    nb = np.bincount(cb, minlength=len(column))
    begin = np.cumsum(nb) - nb
    tile = max(1, PAIR_CELLS // len(b))
    for i in range(0, len(a), tile):
        size = min(tile, len(a) - i)
        ra, ca = entries(to_a[i : i + size])
        na = np.bincount(ca, minlength=len(column))
        dense = na * nb * DENSE > size * len(b)
        counts = np.zeros((size, len(b)), np.float32)  # exact up to 2 ** 24
        for part in np.array_split(np.flatnonzero(dense), -(-int(dense.sum()) // 512) or 1):
            if len(part):
                at = np.full(len(column), -1)
                at[part] = np.arange(len(part))
                x, y = np.zeros((size, len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
                x[ra[at[ca] >= 0], at[ca][at[ca] >= 0]] = 1
                y[rb[at[cb] >= 0], at[cb][at[cb] >= 0]] = 1
                counts += x @ y.T
        some = ~dense[ca]
        rs, cs = ra[some], ca[some]
        steps = np.cumsum(nb[cs])
        for j in range(int(steps[-1]) // PAIR_CELLS + 1 if len(steps) else 0):
            now = slice(*np.searchsorted(steps, [j * PAIR_CELLS, (j + 1) * PAIR_CELLS], side="right"))
            times = nb[cs[now]]
            if times.sum():
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cell = np.repeat(rs[now] * len(b), times) + rb[np.repeat(begin[cs[now]], times) + within]
                counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
        x, y = np.nonzero(counts >= least)
        if len(x):
            yield a[i + x], b[y], counts[x, y].astype(np.int64)


# Scaling, HMMs ------------------------------------------------------------------------------------------------------------


def mds(d: np.ndarray, dims: int = 2) -> tuple[np.ndarray, float]:
    """(coordinates, share of the eigenvalues that is not metric) of classical scaling."""
    n = len(d)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = np.argsort(-w)
    w, v = w[order], v[:, order]
    return v[:, :dims] * np.sqrt(np.maximum(w[:dims], 0)), float(np.abs(w[w < 0]).sum() / max(np.abs(w).sum(), 1e-300))


def largest_eigenvalue(a: np.ndarray, steps: int = 10_000) -> float:
    v, last = np.ones(len(a)), 0.0
    for _ in range(steps):
        w = a @ v
        top = np.linalg.norm(w)
        if top == 0 or abs(top - last) < 1e-14 * top:
            return float(top)
        v, last = w / top, top
    return float(last)


def hmm_divergence(a1: np.ndarray, b1: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> float:
    """Similarity rate of two hidden Markov models: -1/2 log2 of lambda12 / sqrt(lambda11 lambda22)."""
    def top(x, bx, y, by):
        n, m = len(x), len(y)
        emit = bx @ by.T
        return largest_eigenvalue(np.array([[x[i, k] * y[j, l] * emit[k, l] for k in range(n) for l in range(m)] for i in range(n) for j in range(m)]))

    return -0.5 * math.log2(top(a1, b1, a2, b2) / math.sqrt(top(a1, b1, a1, b1) * top(a2, b2, a2, b2)))


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Hmm:
    """Gaussian (or log-normal, on logs) hidden Markov model in log space."""

    def __init__(self, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.start, self.move, self.mean, self.var = start, move, mean, var

    def emit(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (np.log(2 * np.pi * self.var) + (x[:, None] - self.mean) ** 2 / self.var)

    def forward(self, x: np.ndarray, complete: bool) -> np.ndarray:
        e, logs = self.emit(x), np.log(np.maximum(self.move, 1e-300))
        first = np.log(np.maximum(self.start, 1e-300)) if complete else np.full(len(self.mean), -math.log(len(self.mean)))
        f = np.empty_like(e)
        f[0] = first + e[0]
        for t in range(1, len(x)):
            f[t] = lse(f[t - 1][:, None] + logs, 0) + e[t]
        return f

    def backward(self, x: np.ndarray) -> np.ndarray:
        e, logs = self.emit(x), np.log(np.maximum(self.move, 1e-300))
        b = np.zeros_like(e)
        for t in range(len(x) - 2, -1, -1):
            b[t] = lse(logs + (e[t + 1] + b[t + 1])[None, :], 1)
        return b

    def log_likelihood(self, x: np.ndarray, complete: bool = True) -> float:
        return float(lse(self.forward(x, complete)[-1], 0))

    def statistics(self, x: np.ndarray, complete: bool) -> np.ndarray:
        """One row of sufficient statistics: ll, starts, moves, weights, sums, squares; rows of sequences add up."""
        n = len(self.mean)
        f, b, e = self.forward(x, complete), self.backward(x), self.emit(x)
        ll = lse(f[-1], 0)
        g = np.exp(f + b - ll)
        logs = np.log(np.maximum(self.move, 1e-300))
        pair = np.exp(f[:-1, :, None] + logs[None] + (e[1:] + b[1:])[:, None, :] - ll).sum(axis=0) if len(x) > 1 else np.zeros((n, n))
        return np.concatenate(([ll, float(complete)], g[0] * complete, pair.ravel(), g.sum(axis=0), (g * x[:, None]).sum(axis=0), (g * x[:, None] ** 2).sum(axis=0)))

    def updated(self, s: np.ndarray) -> Hmm:
        n = len(self.mean)
        done, first, pair = s[1], s[2 : 2 + n], s[2 + n : 2 + n + n * n].reshape(n, n)
        w, m1, m2 = s[2 + n + n * n :].reshape(3, n)
        w = np.maximum(w, 1e-12)
        rows = pair.sum(axis=1, keepdims=True)
        return Hmm(first / done if done else self.start, np.where(rows > 0, pair / np.maximum(rows, 1e-300), 1 / n), m1 / w, np.maximum(m2 / w - (m1 / w) ** 2, 1e-6))


#: Cells (models x sequences x steps x states) of the arrays that are filled at once.
HMM_CELLS = 4_000_000


def hmm_statistics(models: list[Hmm], sequences: list[np.ndarray], complete: list[bool], weight: np.ndarray) -> np.ndarray:
    """Rows as of ``Hmm.statistics`` for several models of as many states: row f adds up the sequences with ``weight`` (models x sequences).

    All models and sequences go side by side, one step at a time, the longest sequences first; each step is scaled to add up to 1.
    Arrays are steps x models x states x sequences, so that every operation runs along the sequences.
    """
    n, out = len(models[0].mean), np.zeros((len(models), 2 + 4 * len(models[0].mean) + len(models[0].mean) ** 2))
    move, start, mean, var = (np.stack([getattr(m, k) for m in models]) for k in ("move", "start", "mean", "var"))
    back, mean, start = np.ascontiguousarray(move.transpose(0, 2, 1)), mean[..., None], start[..., None]
    curve, height = -0.5 / var[..., None], -0.5 * np.log(2 * np.pi * var[..., None])
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: -len(sequences[i]))
    while order:
        take = max(1, HMM_CELLS // (len(models) * len(sequences[order[0]]) * n))
        part, order = order[:take], order[take:]
        size = np.array([len(sequences[i]) for i in part])
        steps = int(size[0])
        x = np.zeros((steps, len(part)))
        for r, i in enumerate(part):
            x[: size[r], r] = sequences[i]
        width = (np.arange(steps)[:, None] < size[None, :]).sum(axis=1)
        w, done = weight[:, part], np.array([complete[i] for i in part], bool)
        e = np.empty((steps, len(models), n, len(part)))
        f, scale, tops = np.empty_like(e), np.ones((steps, len(models), len(part))), np.zeros((steps, len(models), len(part)))
        for t in range(steps):
            d = width[t]
            z = x[t, :d] - mean
            z *= z
            z *= curve
            z += height
            top = tops[t, :, :d] = z.max(axis=1)
            z -= top[:, None]
            v = np.exp(z, out=e[t, :, :, :d]) * (back @ f[t - 1, :, :, :d] if t else np.where(done, start, 1 / n))
            scale[t, :, :d] = s = np.maximum(v.sum(axis=1), 1e-300)
            np.divide(v, s[:, None], out=f[t, :, :, :d])
        b, pair, moments = np.ones(e.shape[1:]), np.zeros_like(move), np.zeros((len(models), n, 3))
        for t in range(steps - 1, -1, -1):
            d = width[t]
            g = f[t, :, :, :d] * b[:, :, :d]
            g *= w[:, None, :d]
            moments += g @ np.stack((np.ones(d), x[t, :d], x[t, :d] ** 2), axis=1)
            if t:
                y = e[t, :, :, :d] * b[:, :, :d]
                y /= scale[t, :, None, :d]
                b[:, :, :d] = move @ y
                y *= w[:, None, :d]
                pair += f[t - 1, :, :, :d] @ y.transpose(0, 2, 1)
        ll = (np.log(scale) + tops).sum(axis=0)
        out += np.concatenate(((ll * w).sum(axis=1)[:, None], (w * done).sum(axis=1)[:, None], (g * done).sum(axis=2), (move * pair).reshape(len(models), -1), *moments.transpose(2, 0, 1)), axis=1)
    return out


def start_hmm(values: np.ndarray, n: int) -> Hmm:
    """States at quantiles of the values."""
    q = np.quantile(values, (np.arange(n) + 0.5) / n)
    return Hmm(np.full(n, 1 / n), np.full((n, n), 1 / n), q + np.arange(n) * 1e-6, np.full(n, max(values.var() / n, 1e-3)))


def fit_hmm(sequences: list[tuple[np.ndarray, bool]], n: int, steps: int = 100, tol: float = 1e-6) -> tuple[Hmm, float]:
    h, last = start_hmm(np.concatenate([x for x, _ in sequences]), n), -math.inf
    for _ in range(steps):
        s = hmm_statistics([h], [x for x, _ in sequences], [c for _, c in sequences], np.ones((1, len(sequences))))[0]
        if s[0] < last or s[0] - last < tol:
            break
        h, last = h.updated(s), s[0]
    return h, last


def bursts(move: np.ndarray, mean: np.ndarray, start: np.ndarray | None = None) -> list[tuple[int, float, float]]:
    """(states, expected events, expected duration) before the chain leaves its first i + 1 states."""
    out = []
    for i in range(len(mean) - 1):
        p = np.full(i + 1, 1 / (i + 1)) if start is None or start[: i + 1].sum() == 0 else start[: i + 1] / start[: i + 1].sum()
        x = np.linalg.solve((np.eye(i + 1) - move[: i + 1, : i + 1]).T, p)
        out.append((i + 1, float(x.sum()), float(x @ mean[: i + 1])))
    return out


# Mixtures on the simplex --------------------------------------------------------------------------------------------------


def simplex_mixture(theta: np.ndarray, target: np.ndarray, ridge: float = 1e-4, steps: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the n features, free K-vector) whose mixture is nearest to the targets in Jensen-Shannon divergence.

    theta is rows x n x K, target rows x K; weights and vector are one point of the simplex: exponentiated gradient.
    """
    rows, n, k = theta.shape
    c = np.full(n + k, 1 / (n + k))
    rate = 1.0

    def loss(c):
        s = np.maximum(np.einsum("n,rnk->rk", c[:n], theta) + c[n:], 1e-300)
        f = ((math.log(2) - np.log(s + target)) * (s + target) + s * np.log(s)).sum() + ridge * np.linalg.norm(s, axis=1).sum()
        g = math.log(2) - np.log(s + target) + np.log(s) + ridge * s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-300)
        return f / rows, np.concatenate((np.einsum("rk,rnk->n", g, theta), g.sum(axis=0))) / rows

    now, grad = loss(c)
    for _ in range(steps):
        new = c * np.exp(-rate * (grad - grad.min()))
        new /= new.sum()
        got, g = loss(new)
        if got <= now:
            done = now - got < tol
            c, now, grad, rate = new, got, g, rate * 1.2
            if done:
                break
        else:
            rate /= 2
            if rate < 1e-9:
                break
    return c[:n], c[n:]
