import math

import numpy as np
import pytest

from brindle.functions import family
from brindle.functions import models as M
from brindle.functions import variance_models as V
from brindle.refuse import Refused


def garch(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    y, h, hs = [], 1.0, []
    for _ in range(n):
        hs.append(h)
        y.append(math.sqrt(h) * rng.standard_normal())
        h = 0.05 + 0.1 * y[-1] ** 2 + 0.85 * h
    return 0.02 * np.array(y), 0.0004 * np.array(hs)


@pytest.mark.parametrize("model", ["aparch", "cgarch", "betat", "msgarch"])
def test_the_path_follows_the_true_variance(model):
    y, h = garch()
    f = V.fit(model, y)
    assert len(f["variance"]) == len(y) + 1
    assert np.corrcoef(np.log(f["variance"][100:-1]), np.log(h[100:]))[0, 1] > 0.8
    base = M.fit_garch(y, "garch", "t")
    assert f["loglik"] > base["loglik"] - 15


def test_realized_and_range_models():
    y, h = garch(seed=1)
    rng = np.random.default_rng(2)
    x = h * np.exp(rng.normal(-0.1, 0.3, len(h)))
    f = V.fit("rgarch", y, x)
    assert f["beta"] + f["phi"] * f["gamma"] < 1.02 and np.corrcoef(np.log(f["variance"][50:-1]), np.log(h[50:]))[0, 1] > 0.8
    steps = rng.normal(size=(len(h), 200)) * np.sqrt(h / 200)[:, None]
    path = np.concatenate([np.zeros((len(h), 1)), np.cumsum(steps, axis=1)], axis=1)
    c = V.fit("carr", path.max(axis=1) - path.min(axis=1))
    assert np.median(c["variance"][100:-1] / h[100:]) == pytest.approx(1, abs=0.25)


def test_the_next_variance_uses_nothing_later():
    y, h = garch()
    x = h * np.exp(np.random.default_rng(4).normal(-0.1, 0.3, len(h)))
    for model in family.MODELS:
        own = np.abs(y) if model == "carr" else y
        m = x if model == "rgarch" else None
        f = family.fit(model, own[:600], x=None if m is None else m[:600])
        short, long = f.variances(own[:500], None if m is None else m[:500]), f.variances(own, m)
        begin = 100 if model in ("rgarch", "carr") else 0  # their start is the mean of what they are given
        assert short[begin:] == pytest.approx(long[begin:501], rel=1e-3 if begin else 1e-9)
        ahead = f.ahead(own, np.array([500, 700]), 1, m)
        assert ahead[:, 0] == pytest.approx(long[[500, 700]])


def slow(model, p, e):
    """Variances by the textbook recursions."""
    h = [1.0]
    if model == "cgarch":
        w, a, b, rho, phi = p
        q = 1.0
        for u in e:
            after = w + rho * (q - w) + phi * (u * u - h[-1])
            h.append(after + a * (u * u - q) + b * (h[-1] - q))
            q = after
    elif model == "figarch":
        w, phi, d, beta = p
        weight = family.fractional_weights(phi, d, beta).tolist()
        past = [1.0] * family.FRACTIONAL_LAGS
        h = []
        for u in [*e, None]:
            h.append(w / (1 - beta) + sum(a * b for a, b in zip(weight, reversed(past[-family.FRACTIONAL_LAGS :]))))
            if u is not None:
                past.append(u * u)
    elif model == "aparch":
        w, a, g, b, d = p
        s = 1.0
        for u in e:
            s = w + a * (abs(u) - g * u) ** d + b * s
            h.append(s ** (2 / d))
    else:
        w, a, b, g = p
        for u in e:
            h.append(w + (a + g * (u < 0)) * u * u + b * h[-1])
    return h


@pytest.mark.parametrize("model", ["cgarch", "figarch", "aparch", "gjr"])
def test_recursions_in_blocks_are_the_textbooks(model):
    e = np.random.default_rng(5).normal(size=173)
    spec = family.FAMILY[model]
    p = spec.unpack(np.array(spec.starts[0]))
    assert spec.path(p, e, None)[0] == pytest.approx(slow(model, p, e.tolist()))


def test_fractional_weights_without_integration_are_garchs():
    w = family.fractional_weights(0.3, 0.0, 0.2, 50)
    assert w == pytest.approx([0.1 * 0.2**k for k in range(50)])


def test_regimes_by_blocks_are_the_sequential_filter():
    rng = np.random.default_rng(6)
    density, moves, now = rng.random((101, 3)), rng.random((3, 3)), np.array([0.2, 0.3, 0.5])
    moves /= moves.sum(axis=1, keepdims=True)
    every, loglik = family.forward(density, moves, now)
    total = 0.0
    for t, d in enumerate(density):
        assert every[t] == pytest.approx(now)
        joint = now * d
        total += math.log(joint.sum())
        now = joint / joint.sum() @ moves
    assert every[-1] == pytest.approx(now) and loglik == pytest.approx(total)


@pytest.mark.parametrize(("dist", "shape"), [("normal", ()), ("t", (5.0,)), ("skewt", (6.0, -0.3)), ("ged", (1.3,))])
def test_distributions_have_unit_variance(dist, shape):
    z = np.linspace(-80, 80, 1_600_001)
    f = np.exp(family.log_density(dist, shape, z)) * (z[1] - z[0])
    assert (f.sum(), (z * f).sum(), (z * z * f).sum()) == pytest.approx((1, 0, 1), abs=1e-3)
    x = family.draw(dist, shape, np.random.default_rng(7), (400_000,))
    assert (x**2 * (x < 0)).mean() == pytest.approx(family.below_zero(dist, shape), abs=0.02) and x.var() == pytest.approx(1, abs=0.03)


def test_linear_forecasts_are_simulations_means():
    """Garch in closed form against a power model with exponent 2, which is simulated."""
    y, _ = garch()
    f = family.fit("garch", y, dist="normal")
    w, a, b = f.p
    power = family.Fitted("aparch", "normal", f.mu, (w, a, 0.0, b, 2.0), (), f.scale, 0.0, len(y))
    at = np.arange(600, 640)
    assert power.ahead(y, at, 10).mean(axis=0) == pytest.approx(f.ahead(y, at, 10).mean(axis=0), rel=0.02)
    with pytest.raises(Refused):
        family.fit("egarch", y).ahead(y, at, 2)
    assert family.fit("egarch", y, dist="ged").ahead(y, at, 3).shape == (40, 3)


def test_jumps_are_told_from_diffusion():
    r = np.random.default_rng(3).normal(0, 0.001, 288)
    assert V.jump_measures(r)["jump"] == 0 and V.jump_measures(r)["med_rv"] == pytest.approx(V.jump_measures(r)["rv"], rel=0.3)
    r[100] = 0.02
    assert V.jump_measures(r)["jump"] == pytest.approx(0.0004, rel=0.2)


def test_what_cannot_be_fitted_is_refused():
    for bad in (lambda: V.fit("nope", np.ones(500)), lambda: V.fit("carr", -np.ones(500)), lambda: V.fit("rgarch", np.ones(500)), lambda: V.fit("aparch", np.ones(5)), lambda: V.jump_measures(np.ones(2))):
        with pytest.raises(Refused):
            bad()
