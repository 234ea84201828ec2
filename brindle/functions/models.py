"""Numpy kernels of fitted models: HAR, DCC, logit, VECM, long memory, variance breaks, minimum variance; variances are fitted by ``family``.

They take one contiguous array or matrix and know nothing of Spark; ``brindle.operators.fitted`` deals out tickers and refits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from brindle.functions import family
from brindle.functions.family import DISTS, MODELS  # noqa: F401  part of this surface
from brindle.functions.stats import kish  # noqa: F401  part of this surface
from brindle.refuse import Refused


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, *, step: float = 0.1, tol: float = 1e-8, most: int = 2000) -> tuple[np.ndarray, float]:
    """The simplex method with the usual coefficients."""
    n = len(x0)
    simplex = np.vstack([x0, *(x0 + step * np.maximum(np.abs(x0), 0.1) * e for e in np.eye(n))])
    value = np.array([f(x) for x in simplex])
    for _ in range(most):
        order = np.argsort(value)
        simplex, value = simplex[order], value[order]
        if value[-1] - value[0] < tol * (1 + abs(value[0])) and np.abs(simplex[1:] - simplex[0]).max() < 1e-6:
            break
        centre = simplex[:-1].mean(axis=0)
        far = centre + (centre - simplex[-1])
        v = f(far)
        if v < value[0]:
            further = centre + 2 * (centre - simplex[-1])
            w = f(further)
            simplex[-1], value[-1] = (further, w) if w < v else (far, v)
        elif v < value[-2]:
            simplex[-1], value[-1] = far, v
        else:
            near = centre + 0.5 * ((far if v < value[-1] else simplex[-1]) - centre)
            w = f(near)
            if w < min(v, value[-1]):
                simplex[-1], value[-1] = near, w
            else:
                simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
                value[1:] = [f(x) for x in simplex[1:]]
    k = int(np.argmin(value))
    return simplex[k], float(value[k])


def fit_garch(y: np.ndarray, model: str = "garch", dist: str = "t", min_obs: int = 100) -> dict:
    """Maximum likelihood of a constant mean and a model of ``family``, as a dictionary; ``_fit`` is the fit itself."""
    f = family.fit(model, y, dist=dist, min_obs=min_obs)
    h, k = f.variances(y), f.count()
    out = {**f.parameters(), "loglik": f.loglik, "aic": 2 * k - 2 * f.loglik, "bic": k * math.log(f.nobs) - 2 * f.loglik, "persistence": f.persistence()}
    return {**out, "sigma": np.sqrt(h[:-1]), "next_variance": float(h[-1]), "_fit": f}


def forecast_garch(f: dict, model: str, y: np.ndarray, horizon: int, seed: int = 0) -> np.ndarray:
    """Variance 1..horizon steps ahead of the last of ``y``."""
    return f["_fit"].ahead(y, np.array([len(y)]), horizon, seed=seed)[0]


def ljung_box(x: np.ndarray, lags: int) -> float:
    d = x - x.mean()
    n = len(d)
    r = np.array([d[k:] @ d[:-k] for k in range(1, lags + 1)]) / (d @ d)
    return float(n * (n + 2) * (r**2 / (n - np.arange(1, lags + 1))).sum())


def arch_lm(z: np.ndarray, lags: int) -> float:
    """n·R² of squared residuals on their lags."""
    q = z**2
    x = np.column_stack([np.ones(len(q) - lags), *[q[lags - k : -k] for k in range(1, lags + 1)]])
    y = q[lags:]
    u = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(len(y) * (1 - u @ u / ((y - y.mean()) @ (y - y.mean()))))


def har_design(rv: np.ndarray, lags: tuple[int, ...] = (1, 5, 22)) -> np.ndarray:
    """A constant and the mean of the last 1, 5 and 22 values at each place; NaN before a full window."""
    total = np.concatenate([[0.0], np.cumsum(rv)])
    cols = [np.ones(len(rv))]
    for n in lags:
        m = np.full(len(rv), np.nan)
        m[n - 1 :] = (total[n:] - total[:-n]) / n
        cols.append(m)
    return np.column_stack(cols)


def ewma_covariance(x: np.ndarray, lam: float = 0.94, seed: int = 30) -> np.ndarray:
    s = x[:seed].T @ x[:seed] / min(seed, len(x))
    for r in x[seed:]:
        s = lam * s + (1 - lam) * np.outer(r, r)
    return s


def dcc_filter(z: np.ndarray, a: float, b: float, target: np.ndarray | None = None) -> np.ndarray:
    """Conditional correlation of each row, and of the next one."""
    target = np.corrcoef(z.T) if target is None else target
    q, out = target.copy(), []
    for r in [*z, None]:
        d = np.sqrt(np.diag(q))
        out.append(q / np.outer(d, d))
        if r is not None:
            q = (1 - a - b) * target + a * np.outer(r, r) + b * q
    return np.array(out)


def dcc_loglik(z: np.ndarray, a: float, b: float) -> float:
    r = dcc_filter(z, a, b)[:-1]
    _, logdet = np.linalg.slogdet(r)
    return float(-0.5 * (logdet + np.einsum("ti,tij,tj->t", z, np.linalg.inv(r), z) - (z * z).sum(axis=1)).sum())


def fit_dcc(z: np.ndarray) -> tuple[float, float, float]:
    """(a, b, log-likelihood) by quasi-likelihood."""

    def ab(t: np.ndarray) -> tuple[float, float]:
        total, share = 0.999 / (1 + math.exp(-min(max(t[0], -30), 30))), 1 / (1 + math.exp(-min(max(t[1], -30), 30)))
        return total * share, total * (1 - share)

    t, v = nelder_mead(lambda t: -dcc_loglik(z, *ab(t)), np.array([3.0, -3.0]), tol=1e-7, most=200)
    return (*ab(t), -v)


def fit_logit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a ridge logit (the constant, first column, isn't penalised)."""
    b = np.zeros(x.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[0] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        g = x.T @ (y - p) - penalty * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-12), g)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return b


def predict_logit(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.clip(x @ b, -35, 35))), 1e-6, 1 - 1e-6)


def vecm(x: np.ndarray, y: np.ndarray, lags: int = 20) -> tuple[np.ndarray, np.ndarray, int]:
    """Error-correction speeds, residual covariance and rows of two cointegrated log prices with vector (1, −1)."""
    d = np.column_stack([np.diff(x), np.diff(y)])
    n = len(d) - lags
    if len(x) < lags + 10:
        raise Refused("too few rows")
    z = np.column_stack([np.ones(n), (x - y)[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
    b = np.linalg.lstsq(z, d[lags:], rcond=None)[0]
    u = d[lags:] - z @ b
    return b[1], u.T @ u / (n - z.shape[1]), n


def discovery_shares(alpha: np.ndarray, omega: np.ndarray) -> dict:
    """Component share and Hasbrouck's bounds of the first venue."""
    g = np.array([alpha[1], -alpha[0]])
    g = g / g.sum()

    def share(order: list[int]) -> float:
        m = np.linalg.cholesky(omega[np.ix_(order, order)])
        part = (g[order] @ m) ** 2
        return float(part[order.index(0)] / part.sum())

    a, b = share([0, 1]), share([1, 0])
    return {"component_share": float(g[0]), "info_low": min(a, b), "info_high": max(a, b), "info_mid": (a + b) / 2}


def local_whittle(x: np.ndarray, m: int | None = None) -> float:
    """Robinson's memory parameter alone; ``series.whittle`` has its error too."""
    from brindle.functions.series import whittle

    return whittle(x, int(len(x) ** 0.65) if m is None else m)["d"]


def variance_breaks(r: np.ndarray, min_segment: int = 60, critical: float = 1.358) -> list[int]:
    """Places where the variance changes: the CUSUM of squares, scaled by its long-run variance, by binary segmentation and a pruning pass."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        q = r[lo:hi] ** 2
        n = len(q)
        d = q - q.mean()
        lag = int(4 * (n / 100) ** 0.25)
        v = d @ d / n + 2 * sum((1 - k / (lag + 1)) * (d[k:] @ d[:-k]) / n for k in range(1, lag + 1))
        c = np.abs(np.cumsum(q) - np.arange(1, n + 1) / n * q.sum()) / math.sqrt(max(v, 1e-300) * n)
        k = int(c[: n - 1].argmax())
        return float(c[k]), lo + k + 1

    found, todo = [], [(0, len(r))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 * min_segment:
            continue
        s, k = best(lo, hi)
        if s > critical and min(k - lo, hi - k) >= min_segment:
            found.append(k)
            todo += [(lo, k), (k, hi)]
    for _ in range(20):
        edges = [0, *sorted(found), len(r)]
        kept = [k for s, k in (best(a, b) for a, b in zip(edges, edges[2:])) if s > critical]
        if sorted(set(kept)) == sorted(found):
            break
        found = sorted(set(kept))
    return sorted(found)


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    """Long-only minimum variance: names with a negative weight leave, those whose marginal risk is too low come back."""
    n = len(cov)
    on = np.ones(n, bool)
    for _ in range(4 * n):
        w = np.zeros(n)
        s = np.linalg.solve(cov[np.ix_(on, on)], np.ones(on.sum()))
        w[on] = s / s.sum()
        if (w < -1e-12).any():
            on[np.argmin(w)] = False
            continue
        risk = cov @ w
        low = np.flatnonzero(~on & (risk < w @ risk - 1e-12))
        if not len(low):
            break
        on[low[np.argmin(risk[low])]] = True
    return w


def kupiec(hits: int, n: int, alpha: float) -> float:
    """Likelihood ratio of the share of violations."""
    p = hits / n
    out = -2 * ((n - hits) * math.log(1 - alpha) + hits * math.log(alpha))
    if 0 < p < 1:
        out += 2 * ((n - hits) * math.log(1 - p) + hits * math.log(p))
    return out


def christoffersen(hits: np.ndarray) -> float:
    """Likelihood ratio of independence of violations."""
    h = np.asarray(hits, int)
    n = np.zeros((2, 2))
    np.add.at(n, (h[:-1], h[1:]), 1)
    ll = lambda k, m: sum(c * math.log(c / (k + m)) for c in (k, m) if c > 0)
    return 2 * (ll(*n[0]) + ll(*n[1]) - ll(*n.sum(axis=0)))
