"""The family of variance models: fits by maximum likelihood and forecasts many steps ahead, on numpy arrays.

A model maps unbounded search coordinates to parameters, and parameters and residuals to the variance of each observation and of
the next.  Recursions that are linear in the variance are solved in blocks side by side (``scan``), so an evaluation is a
few array operations; the others are loops.  Everything is worked out on data of unit variance and scaled back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from brindle.refuse import Refused, one_of

Path = tuple[np.ndarray, dict]

BLOCK = 32
#: The decay of the exponential average; RiskMetrics 2006's horizons; the lags of fractional weights; paths of a simulation.
LAMBDA = 0.94
TAU0, TAU1, TAU_RATIO, TAUS = 1560.0, 4.0, math.sqrt(2.0), 14
FRACTIONAL_LAGS = 1000
PATHS = 1000


def scan(x: np.ndarray, b: float, start: float) -> np.ndarray:
    """start, then y[t + 1] = b y[t] + x[t]: blocks side by side, step by step, then one carry from block to block.

    A value does not depend on what follows it, to the last bit.
    """
    n = len(x)
    whole = -(-n // BLOCK)
    padded = np.zeros(whole * BLOCK)
    padded[:n] = x
    local = padded.reshape(whole, BLOCK).T.copy()  # a row per step
    for j in range(1, BLOCK):
        local[j] += b * local[j - 1]
    power = b ** np.arange(1, BLOCK + 1)
    carry, now, end = np.empty(whole), float(start), float(power[-1])
    for k, last in enumerate(local[-1].tolist()):
        carry[k] = now
        now = last + end * now
    out = np.empty(n + 1)
    out[0] = start
    out[1:] = (local + power[:, None] * carry).T.ravel()[:n]
    return out


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, most: int = 150) -> tuple[np.ndarray, float]:
    """Quasi-Newton steps with forward differences and a backtracking line search."""
    n, value = len(x), f(x)

    def slope(at: np.ndarray, v: float) -> np.ndarray:
        out = np.empty(n)
        for i in range(n):
            step = 1e-6 * max(1.0, abs(at[i]))
            moved = at.copy()
            moved[i] += step
            out[i] = (f(moved) - v) / step
        return np.clip(out, -1e8, 1e8)

    g, inverse, calm = slope(x, value), np.eye(n), 0
    for _ in range(most):
        d = -inverse @ g
        if d @ g >= 0:
            inverse, d = np.eye(n), -g
        length = min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        while length > 1e-10:
            v = f(x + length * d)
            if v <= value + 1e-4 * length * (d @ g):
                break
            length *= 0.4
        else:
            if (inverse == np.eye(n)).all():
                break
            inverse = np.eye(n)
            continue
        new = x + length * d
        gn = slope(new, v)
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            left = np.eye(n) - r * np.outer(s, y)
            inverse = left @ inverse @ left.T + r * np.outer(s, s)
        calm = calm + 1 if value - v < 1e-7 * (1 + abs(v)) else 0
        x, value, g = new, v, gn
        if calm >= 2:
            break
    return x, value


# -- distributions of unit variance: log density, draws, share of the variance below zero


def _unit(t: float) -> float:
    return 1 / (1 + math.exp(-min(max(t, -30.0), 30.0)))


def _positive(t: float) -> float:
    return math.exp(min(max(t, -30.0), 10.0))


def _log_gamma_ratio(nu: float) -> float:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))


def _skew(eta: float, lam: float) -> tuple[float, float, float]:
    c = _log_gamma_ratio(eta)
    a = 4 * lam * math.exp(c) * (eta - 2) / (eta - 1)
    return a, math.sqrt(1 + 3 * lam * lam - a * a), c


def _ged_scale(nu: float) -> float:
    return math.sqrt(2 ** (-2 / nu) * math.exp(math.lgamma(1 / nu) - math.lgamma(3 / nu)))


def log_density(dist: str, shape: tuple[float, ...], z: np.ndarray) -> np.ndarray:
    if dist == "normal":
        return -0.5 * (math.log(2 * math.pi) + z * z)
    if dist == "t":
        (nu,) = shape
        return _log_gamma_ratio(nu) - (nu + 1) / 2 * np.log1p(z * z / (nu - 2))
    if dist == "skewt":
        eta, lam = shape
        a, b, c = _skew(eta, lam)
        w = (b * z + a) / np.where(z >= -a / b, 1 + lam, 1 - lam)
        return math.log(b) + c - (eta + 1) / 2 * np.log1p(w * w / (eta - 2))
    (nu,) = shape
    scale = _ged_scale(nu)
    return math.log(nu / scale) - (1 + 1 / nu) * math.log(2) - math.lgamma(1 / nu) - 0.5 * np.abs(z / scale) ** nu


def draw(dist: str, shape: tuple[float, ...], rng: np.random.Generator, size: tuple[int, ...]) -> np.ndarray:
    if dist == "normal":
        return rng.standard_normal(size)
    if dist == "t":
        return rng.standard_t(shape[0], size) * math.sqrt((shape[0] - 2) / shape[0])
    if dist == "skewt":
        eta, lam = shape
        a, b, _ = _skew(eta, lam)
        half = np.abs(rng.standard_t(eta, size)) * math.sqrt((eta - 2) / eta)
        return (np.where(rng.random(size) < (1 + lam) / 2, (1 + lam) * half, (lam - 1) * half) - a) / b
    nu = shape[0]
    size_of = _ged_scale(nu) * (2 * rng.gamma(1 / nu, size=size)) ** (1 / nu)
    return np.where(rng.random(size) < 0.5, -size_of, size_of)


_GRID = np.linspace(-40, 0, 40_001)


def below_zero(dist: str, shape: tuple[float, ...]) -> float:
    """E[z² 1(z < 0)]: half for a symmetric distribution, by the trapezoid rule for a skewed one."""
    if dist != "skewt":
        return 0.5
    y = _GRID**2 * np.exp(log_density(dist, shape, _GRID))
    return float(((y[1:] + y[:-1]) / 2).sum() * (_GRID[1] - _GRID[0]))


SHAPES = {
    "normal": ((), (), lambda t: ()),
    "t": (("nu",), (1.8,), lambda t: (2.05 + _positive(min(t[0], 5.5)),)),
    "skewt": (("eta", "lambda"), (1.8, 0.0), lambda t: (2.05 + _positive(min(t[0], 5.5)), math.tanh(t[1]))),
    "ged": (("nu",), (0.3,), lambda t: (0.3 + _positive(min(t[0], 3.0)),)),
}
DISTS = tuple(SHAPES)


# -- the models


@dataclass(frozen=True)
class Variance:
    """names: of the variance's parameters.  path: (parameters, residuals, measure) to the variances, one more than residuals, and what a forecast needs.

    ahead: (parameters, path, places, steps, dist, shape, rng) to the mean variance 1..steps ahead of each place.
    only: the distribution that it is defined for.  own: a likelihood of its own in place of ``dist``'s, of (parameters, y, measure).
    """

    names: tuple[str, ...]
    starts: tuple[tuple[float, ...], ...]
    unpack: Callable[[np.ndarray], tuple[float, ...]]
    path: Callable[..., Path]
    ahead: Callable[..., np.ndarray]
    persistence: Callable[..., float | None]
    only: str | None = None
    own: Callable[..., float] | None = None
    mean: bool = True


def _split(total: float, *logits: float) -> list[float]:
    """Shares of ``total`` by a softmax with a last logit of 0."""
    w = np.exp(np.clip([*logits, 0.0], -30, 30))
    return (total * w / w.sum()).tolist()


def _flat(p, state, at, steps, dist, shape, rng):
    return np.repeat(state["h"][at][:, None], steps, axis=1)


def _towards(p0: float, slope: float, h: np.ndarray, steps: int) -> np.ndarray:
    """h, p0 + slope h, ...: the mean path of a variance whose next mean is linear in it."""
    out = np.empty((len(h), steps))
    for k in range(steps):
        out[:, k] = h
        h = p0 + slope * h
    return out


def _ewma(p, e, x):
    h = scan((1 - LAMBDA) * e * e, LAMBDA, 1.0)
    return h, {"h": h}


def _rm2006(p, e, x):
    tau = TAU1 * TAU_RATIO ** np.arange(TAUS)
    w = 1 - np.log(tau) / math.log(TAU0)
    h = sum(s * scan((1 - m) * e * e, float(m), 1.0) for s, m in zip(w / w.sum(), np.exp(-1 / tau)))
    return h, {"h": h}


def _garch(p, e, x):
    h = scan(p[0] + p[1] * e * e, p[2], 1.0)
    return h, {"h": h}


def _gjr(p, e, x):
    h = scan(p[0] + (p[1] + p[3] * (e < 0)) * e * e, p[2], 1.0)
    return h, {"h": h}


def _garch_sum(p, dist, shape):
    return p[1] + p[2] + (p[3] * below_zero(dist, shape) if len(p) > 3 else 0.0)


def _garch_ahead(p, state, at, steps, dist, shape, rng):
    return _towards(p[0], _garch_sum(p, dist, shape), state["h"][at], steps)


_ABS_NORMAL = math.sqrt(2 / math.pi)


def _egarch(p, e, x):
    w, a, g, b = p
    log_h = np.zeros(len(e) + 1)
    now = 0.0
    for i, u in enumerate(e.tolist()):
        z = u * math.exp(-now / 2)
        now = min(max(w + a * (abs(z) - _ABS_NORMAL) + g * z + b * now, -50.0), 50.0)
        log_h[i + 1] = now
    h = np.exp(log_h)
    return h, {"h": h}


def _egarch_ahead(p, state, at, steps, dist, shape, rng):
    if steps > 1 and dist in ("t", "skewt"):
        raise Refused(f"the variance of egarch with dist={dist!r} is infinite beyond one step")
    w, a, g, b = p
    now = np.repeat(np.log(state["h"][at])[:, None], PATHS, axis=1)
    out = np.empty((len(at), steps))
    for k in range(steps):
        out[:, k] = np.exp(now).mean(axis=1)
        if k + 1 < steps:
            z = draw(dist, shape, rng, now.shape)
            now = w + a * (np.abs(z) - _ABS_NORMAL) + g * z + b * now
    return out


def _aparch(p, e, x):
    w, a, g, b, d = p
    s = scan(w + a * (np.abs(e) - g * e) ** d, b, 1.0)
    return s ** (2 / d), {"s": s}


def _aparch_ahead(p, state, at, steps, dist, shape, rng):
    w, a, g, b, d = p
    now = np.repeat(state["s"][at][:, None], PATHS, axis=1)
    out = np.empty((len(at), steps))
    for k in range(steps):
        out[:, k] = (now ** (2 / d)).mean(axis=1)
        if k + 1 < steps:
            z = draw(dist, shape, rng, now.shape)
            now = w + (a * (np.abs(z) - g * z) ** d + b) * now
    return out


def _aparch_sum(p, dist, shape):
    z = draw(dist, shape, np.random.default_rng(0), (200_000,))
    return float(p[1] * ((np.abs(z) - p[2] * z) ** p[4]).mean() + p[3])


def fractional_weights(phi: float, d: float, beta: float, lags: int = FRACTIONAL_LAGS) -> np.ndarray:
    """Weights of past squares under fractional integration."""
    k = np.arange(2, lags + 1)
    delta = d * np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
    return scan(delta[1:] - phi * delta[:-1], beta, phi - beta + d)


def _figarch(p, e, x):
    w, phi, d, beta = p
    weight = fractional_weights(phi, d, beta)
    past = np.concatenate([np.ones(FRACTIONAL_LAGS), e * e])  # before the sample, the variance
    size = 1 << (len(past) + FRACTIONAL_LAGS - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(past, size) * np.fft.rfft(weight, size), size)
    h = w / (1 - beta) + full[FRACTIONAL_LAGS - 1 : FRACTIONAL_LAGS + len(e)]
    return h, {"past": past, "weight": weight, "base": w / (1 - beta)}


def _figarch_ahead(p, state, at, steps, dist, shape, rng):
    out = np.empty((len(at), steps))
    weight, base = state["weight"], state["base"]
    for row, i in enumerate(at):
        past = state["past"][i : i + FRACTIONAL_LAGS][::-1]  # the newest first
        for k in range(steps):
            v = base + weight @ past
            out[row, k] = v
            past = np.concatenate([[v], past[:-1]])
    return out


def _component(p, e, x):
    w, a, b, rho, phi = p
    v = e * e
    # (long run, variance) is linear in itself; its matrix has two real eigenvalues
    m = np.array([[rho, -phi], [rho - a - b, b - phi]])
    values, vectors = np.linalg.eig(m)
    back = np.linalg.inv(vectors)
    into = np.array([w * (1 - rho) + phi * v, w * (1 - rho) + (phi + a) * v])
    parts = back @ into
    start = back @ np.ones(2)
    both = vectors @ np.array([scan(parts[i], float(values[i].real), float(start[i].real)) for i in range(2)]).real
    return both[1].real, {"q": both[0].real, "h": both[1].real}


def _component_ahead(p, state, at, steps, dist, shape, rng):
    w, a, b, rho, phi = p
    q, h = state["q"][at], state["h"][at]
    out = np.empty((len(at), steps))
    for k in range(steps):
        out[:, k] = h
        after = w + rho * (q - w)
        q, h = after, after + (a + b) * (h - q)
    return out


def _beta_t(p, e, x):
    w, phi, k, lev, nu = p
    now = w / (1 - phi)
    path = np.empty(len(e) + 1)
    path[0] = now
    for i, u in enumerate(e.tolist()):
        square = u * u
        score = (nu + 1) * square / (nu * math.exp(2 * now) + square) - 1
        now = min(max(w + phi * now + k * score + (lev * (score + 1) if u < 0 else -lev * (score + 1)), -20.0), 20.0)
        path[i + 1] = now
    return np.exp(2 * path) * nu / (nu - 2), {"path": path}


def _beta_t_ahead(p, state, at, steps, dist, shape, rng):
    w, phi, k, lev, nu = p
    now = np.repeat(state["path"][at][:, None], PATHS, axis=1)
    out = np.empty((len(at), steps))
    for j in range(steps):
        out[:, j] = np.exp(2 * now).mean(axis=1) * nu / (nu - 2)
        if j + 1 < steps:
            z = rng.standard_t(nu, now.shape)
            score = (nu + 1) * z * z / (nu + z * z) - 1
            now = w + phi * now + k * score - np.sign(z) * lev * (score + 1)
    return out


def _realized(p, e, x):
    w, b, g = p[:3]
    log_h = scan(w + g * np.log(x), b, math.log(float(np.mean(e * e))))
    return np.exp(np.clip(log_h, -50, 50)), {"log_h": log_h}


def _realized_own(p, e, x):
    _, _, _, xi, phi, t1, t2, su = p
    h, state = _realized(p, e, x)
    z = e / np.sqrt(h[:-1])
    u = np.log(x) - xi - phi * state["log_h"][:-1] - t1 * z - t2 * (z * z - 1)
    return float((log_density("normal", (), z) - 0.5 * np.log(h[:-1])).sum() - 0.5 * (np.log(2 * math.pi * su * su) + u * u / (su * su)).sum())


def _realized_ahead(p, state, at, steps, dist, shape, rng):
    w, b, g, xi, phi, t1, t2, su = p
    now = np.repeat(state["log_h"][at][:, None], PATHS, axis=1)
    out = np.empty((len(at), steps))
    for k in range(steps):
        out[:, k] = np.exp(now).mean(axis=1)
        if k + 1 < steps:
            z = rng.standard_normal(now.shape)
            now = w + b * now + g * (xi + phi * now + t1 * z + t2 * (z * z - 1) + su * rng.standard_normal(now.shape))
    return out


def _range(p, y, x):
    v = scan(p[0] + p[1] * y, p[2], float(y.mean()))
    return v, {"h": v}


def forward(density: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Chance of each regime before each observation and after the last, and the log-likelihood.  density: observations by regimes.

    The chances are a product of one matrix per observation; blocks of it are multiplied out side by side, then joined.
    """
    n, k = density.shape
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    d = np.ones((blocks * size, k))
    d[:n] = density
    step = d.reshape(blocks, size, k)[:, :, :, None] * moves  # from a regime, by its density, into the next
    before = np.empty((size, blocks, k, k))
    now = np.broadcast_to(np.eye(k), (blocks, k, k))
    for i in range(size):
        before[i] = now
        now = now @ step[:, i]
        now = now / np.maximum(now.max(axis=(1, 2), keepdims=True), 1e-300)
    chance = np.empty((blocks + 1, k))
    chance[0] = start
    for j in range(blocks):
        after = chance[j] @ now[j]
        chance[j + 1] = after / max(after.sum(), 1e-300)
    every = np.einsum("jk,ijkl->jil", chance[:-1], before).reshape(-1, k)
    every = np.concatenate([every[:n], (every[n] if n < len(every) else chance[-1])[None]])
    every = every / np.maximum(every.sum(axis=1, keepdims=True), 1e-300)
    return every, float(np.log(np.maximum((every[:n] * density).sum(axis=1), 1e-300)).sum())


def _regime_parts(p) -> tuple[np.ndarray, np.ndarray, float]:
    """(omega, alpha, beta) of each regime, the moves between them, the tail."""
    own, stay = np.array(p[:6]).reshape(2, 3), np.array(p[6:8])
    moves = np.diag(stay) + np.fliplr(np.diag(1 - stay))
    return own, moves, p[8]


def _regimes(p, e, x):
    own, moves, nu = _regime_parts(p)
    v = np.column_stack([scan(w + a * e * e, b, w / max(1 - a - b, 1e-3)) for w, a, b in own.tolist()])
    density = np.exp(log_density("t", (nu,), e[:, None] / np.sqrt(v[:-1])) - 0.5 * np.log(v[:-1]))
    rest = 1 - np.diag(moves)
    chance, loglik = forward(density, moves, rest[::-1] / max(rest.sum(), 1e-12))
    return (chance * v).sum(axis=1), {"v": v, "chance": chance, "loglik": loglik}


def _regimes_ahead(p, state, at, steps, dist, shape, rng):
    own, moves, nu = _regime_parts(p)
    v = np.repeat(state["v"][at][:, None, :], PATHS, axis=1)
    regime = (rng.random((len(at), PATHS)) > state["chance"][at][:, :1]).astype(int)
    out = np.empty((len(at), steps))
    for k in range(steps):
        h = np.take_along_axis(v, regime[:, :, None], axis=2)[:, :, 0]
        out[:, k] = h.mean(axis=1) if k else (state["chance"][at] * state["v"][at]).sum(axis=1)
        if k + 1 < steps:
            e2 = h * draw("t", (nu,), rng, h.shape) ** 2
            v = own[:, 0] + own[:, 1] * e2[:, :, None] + own[:, 2] * v
            regime = np.where(rng.random(regime.shape) < moves[regime, regime], regime, 1 - regime)
    return out


def _regime_unpack(t: np.ndarray) -> tuple[float, ...]:
    calm, wild = ((_positive(t[3 * i]), *_split(_unit(t[3 * i + 1]), t[3 * i + 2])) for i in range(2))
    if calm[0] * (1 - wild[1] - wild[2]) > wild[0] * (1 - calm[1] - calm[2]):  # the second regime is the volatile one
        calm, wild = wild, calm
    return (*calm, *wild, _unit(t[6]), _unit(t[7]), 2.05 + _positive(t[8]))


def _component_unpack(t: np.ndarray) -> tuple[float, ...]:
    rho = _unit(t[3])
    return (_positive(t[0]), *_split(rho * _unit(t[1]), t[2]), rho, 0.3 * _unit(t[4]))


def _figarch_unpack(t: np.ndarray) -> tuple[float, ...]:
    d = _unit(t[2])
    phi = _unit(t[1]) * (1 - d) / 2
    return _positive(t[0]), phi, d, _unit(t[3]) * (phi + d)


def _gjr_unpack(t: np.ndarray) -> tuple[float, ...]:
    a, half, b = _split(_unit(t[1]), t[2], t[3])
    return _positive(t[0]), a, b, 2 * half


NONE = lambda p, dist, shape: None
FAMILY = {
    "ewma": Variance((), ((),), lambda t: (), _ewma, _flat, lambda p, dist, shape: 1.0),
    "rm2006": Variance((), ((),), lambda t: (), _rm2006, _flat, NONE),
    "garch": Variance(("omega", "alpha", "beta"), ((-3.0, 3.0, -2.5), (-2.0, 2.0, -1.0), (-5.0, 5.0, -3.0)), lambda t: (_positive(t[0]), *_split(_unit(t[1]), t[2])), _garch, _garch_ahead, _garch_sum),
    "gjr": Variance(("omega", "alpha", "beta", "gamma"), ((-3.0, 3.0, -3.0, -3.0), (-2.0, 2.0, -1.0, -2.0)), _gjr_unpack, _gjr, _garch_ahead, _garch_sum),
    "egarch": Variance(("omega", "alpha", "gamma", "beta"), ((0.0, 0.15, -0.02, 2.0), (0.0, 0.3, 0.0, 1.0)), lambda t: (t[0], t[1], t[2], math.tanh(t[3])), _egarch, _egarch_ahead, lambda p, dist, shape: p[3]),
    "aparch": Variance(("omega", "alpha", "gamma", "beta", "delta"), ((-3.0, 3.0, -2.5, 0.1, 0.5), (-2.0, 2.0, -1.5, 0.0, 0.0)), lambda t: (_positive(t[0]), (s := _split(_unit(t[1]), t[2]))[0], math.tanh(t[3]), s[1], 0.3 + _positive(min(t[4], 1.5))), _aparch, _aparch_ahead, _aparch_sum),
    "figarch": Variance(("omega", "phi", "d", "beta"), ((-3.0, 0.0, 0.0, 0.0), (-2.0, -1.0, -0.5, -0.5)), _figarch_unpack, _figarch, _figarch_ahead, NONE),
    "cgarch": Variance(("omega", "alpha", "beta", "rho", "phi"), ((0.0, 2.0, -2.5, 4.0, -3.0), (0.0, 1.0, -1.0, 3.0, -2.0), (0.0, 3.0, -1.5, 7.0, -4.0)), _component_unpack, _component, _component_ahead, lambda p, dist, shape: p[3], only="t"),
    "betat": Variance(("omega", "phi", "kappa", "leverage", "nu"), ((-0.01, 2.0, 0.05, 0.01, 1.8), (-0.05, 1.2, 0.1, 0.0, 1.2)), lambda t: (t[0], math.tanh(t[1]), t[2], t[3], 2.05 + _positive(min(t[4], 5.5))), _beta_t, _beta_t_ahead, lambda p, dist, shape: p[1], only="t", own=lambda p, e, x: _t_likelihood(e, _beta_t(p, e, x)[0], p[4])),
    "rgarch": Variance(("omega", "beta", "gamma", "xi", "phi", "tau1", "tau2", "sigma_u"), ((0.1, 0.5, 0.4, -0.2, 1.0, -0.05, 0.05, -1.0),), lambda t: (*t[:7], _positive(t[7])), _realized, _realized_ahead, lambda p, dist, shape: p[1] + p[4] * p[2], only="normal", own=_realized_own),
    "msgarch": Variance(("omega1", "alpha1", "beta1", "omega2", "alpha2", "beta2", "stay1", "stay2", "nu"), ((-3.0, 2.5, -2.5, -0.5, 2.0, -2.0, 3.5, 2.5, 1.8),), _regime_unpack, _regimes, _regimes_ahead, lambda p, dist, shape: p[4] + p[5], only="t", own=lambda p, e, x: _regimes(p, e, x)[1]["loglik"]),
    "carr": Variance(("omega", "alpha", "beta"), ((-2.5, 3.0, -1.5),), lambda t: (_positive(t[0]), *_split(_unit(t[1]), t[2])), _range, lambda p, state, at, steps, dist, shape, rng: _towards(p[0], p[1] + p[2], state["h"][at], steps), lambda p, dist, shape: p[1] + p[2], own=lambda p, y, x: -float((np.log(v := _range(p, y, x)[0][:-1]) + y / v).sum()), mean=False),
}
MODELS = tuple(FAMILY)
#: The mean of a driftless Brownian motion's range over its standard deviation.
RANGE_MEAN = math.sqrt(8 / math.pi)
#: Parameters that are on the scale of variances.
_OMEGAS = {"garch": ("omega",), "gjr": ("omega",), "figarch": ("omega",), "cgarch": ("omega",), "msgarch": ("omega1", "omega2")}


def _t_likelihood(e: np.ndarray, h: np.ndarray, nu: float) -> float:
    return float((log_density("t", (nu,), e / np.sqrt(h[:-1])) - 0.5 * np.log(h[:-1])).sum())


@dataclass(frozen=True)
class Fitted:
    """A fit on data of unit variance; ``scale`` leads back."""

    model: str
    dist: str
    mu: float
    p: tuple[float, ...]
    shape: tuple[float, ...]
    scale: float
    loglik: float
    nobs: int
    measure: float = 1.0  # the scale of the realized measure

    def path(self, y: np.ndarray, x: np.ndarray | None = None) -> Path:
        e = np.asarray(y, float) / self.scale - self.mu
        return FAMILY[self.model].path(self.p, e, None if x is None else np.asarray(x, float) / self.measure)

    def variances(self, y: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """The variance of each of ``y`` given those before, and of the next, in the data's units."""
        return self._back(self.path(y, x)[0])

    def ahead(self, y: np.ndarray, places: np.ndarray, steps: int, x: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """The mean variance 1..steps after each place (the number of values known there)."""
        _, state = self.path(y, x)
        return self._back(FAMILY[self.model].ahead(self.p, state, np.asarray(places), steps, self.dist, self.shape, np.random.default_rng(seed)))

    def _back(self, h: np.ndarray) -> np.ndarray:
        return (h * self.scale / RANGE_MEAN) ** 2 if self.model == "carr" else h * self.scale**2

    def parameters(self) -> dict[str, float]:
        """By name; mu and the omegas of variances in the data's units."""
        spec = FAMILY[self.model]
        out = dict(zip(spec.names, map(float, self.p))) | dict(zip(SHAPES[self.dist][0] if spec.own is None else (), self.shape))
        for k in _OMEGAS.get(self.model, ()):
            out[k] *= self.scale**2
        return ({"mu": self.mu * self.scale} if spec.mean else {}) | out

    def persistence(self) -> float | None:
        return FAMILY[self.model].persistence(self.p, self.dist, self.shape)

    def count(self) -> int:
        spec = FAMILY[self.model]
        return int(spec.mean) + len(spec.names) + (len(self.shape) if spec.own is None else 0)


def fit(model: str, y: np.ndarray, *, dist: str | None = None, x: np.ndarray | None = None, min_obs: int = 200) -> Fitted:
    """Maximum likelihood of a constant mean and a variance model.  x: the realized measure, for rgarch; ``y`` is log ranges for carr."""
    one_of("model", model, MODELS)
    spec = FAMILY[model]
    dist = dist or spec.only or "t"
    one_of("dist", dist, DISTS)
    if spec.only and dist != spec.only:
        raise Refused(f"{model} is defined for dist={spec.only!r} alone")
    y = np.asarray(y, float)
    if len(y) < max(min_obs, 3) or not np.isfinite(y).all():
        raise Refused(f"{len(y)} values, some missing or under min_obs={min_obs}")
    if (model == "carr" and (y < 0).any()) or (model == "rgarch") != (x is not None) or (x is not None and not (np.asarray(x) > 0).all()):
        raise Refused(f"{model} needs {'positive realized measures' if model == 'rgarch' else 'other values'}")
    scale = float(y.mean() if model == "carr" else y.std())
    if not scale > 0:
        raise Refused("the values don't vary")
    z = y / scale
    measure = scale**2
    m = None if x is None else np.asarray(x, float) / measure
    _, shape_start, shape_of = SHAPES[dist] if spec.own is None else SHAPES["normal"]
    first, k = int(spec.mean), len(spec.starts[0])

    def unpack(t: np.ndarray) -> tuple[float, tuple, tuple]:
        return (float(t[0]) if spec.mean else 0.0), spec.unpack(t[first : first + k]), shape_of(t[first + k :])

    def cost(t: np.ndarray) -> float:
        try:
            mu, p, shape = unpack(t)
            e = z - mu
            if spec.own is not None:
                value = -spec.own(p, e, m)
            else:
                h = spec.path(p, e, m)[0]
                if not (h > 0).all():
                    return 1e10
                root = np.sqrt(h[:-1])
                value = -float((log_density(dist, shape, e / root) - np.log(root)).sum())
        except (OverflowError, ValueError, ZeroDivisionError, np.linalg.LinAlgError):
            return 1e10
        return value if math.isfinite(value) else 1e10

    mean = [float(z.mean())] if spec.mean else []
    with np.errstate(all="ignore"):
        starts = [np.array([*mean, *s, *shape_start], float) for s in spec.starts]
        # every start where there are several valleys
        chosen = starts if model in ("aparch", "figarch", "cgarch") else [min(starts, key=cost)]
        t, best = min((minimise(cost, t) for t in chosen), key=lambda found: found[1])
    mu, p, shape = unpack(t)
    shift = 0.0 if model == "carr" else len(y) * math.log(scale)
    return Fitted(model, dist, mu, p, shape, scale, -best - shift, len(y), measure)
