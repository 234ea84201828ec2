"""The fitted queries read every daily return, those before 2000 too."""

import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.functions import models as M
from brindle.functions import variance_models as V
from brindle.plans.more_queries import query  # noqa: F401  the module registers its queries
from brindle.plans.queries import QUERIES

N = 325


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rng = np.random.default_rng(4)
    scale, price = 0.01, [100.0]
    for _ in range(N):
        e = scale * rng.standard_normal()
        price.append(price[-1] * np.exp(e))
        scale = np.sqrt(1e-5 + 0.1 * e * e + 0.8 * scale * scale)
    days = [datetime.date(1998, 1, 1) + datetime.timedelta(k) for k in range(N + 1)]
    out = tmp_path_factory.mktemp("history")
    n = len(days)
    pq.write_table(pa.table({"l_returnflag": ["A"] * n, "l_shipdate": days, "l_extendedprice": price, "l_quantity": [1.0] * n, "l_orderkey": pa.array(range(n), pa.int64()), "l_linenumber": pa.array([1] * n, pa.int64())}), out / "lineitem.parquet")
    return str(out), np.diff(np.log(price))


def test_walk_forward_forecasts_are_those_of_the_whole_history(spark, table):
    d, y = table
    want = []
    for refit in range(300, N + 1, 20):
        f = M.fit_garch(y[:refit], "garch", "t", 50)
        want += [M.forecast_garch(f, "garch", y[:k], 5) for k in range(refit, min(refit + 20, N + 1))]
    got = {r["h"]: r for r in QUERIES["garch_walk_forward"](spark, d).collect()}
    assert {h: r["n"] for h, r in got.items()} == {1: len(want), 5: len(want)}
    for h in (1, 5):
        assert got[h]["variance"] == pytest.approx(np.mean([v[h - 1] for v in want]), abs=2e-6)
    (held,) = QUERIES["volatility_targeted"](spark, d).collect()
    assert held["n"] > 0 and held["exposure"] == pytest.approx(np.mean([min(0.1 / np.sqrt(v[0]), 2.0) for v in want]), abs=1e-4)


def test_component_fit_reads_the_whole_history(spark, table):
    d, y = table
    (got,) = QUERIES["component_garch_fit"](spark, d).collect()
    assert got["value"] == pytest.approx(round(V.fit("cgarch", y, None, min_obs=200)["rho"], 1), abs=0.11)


def test_random_timing_draws_the_default_number(spark, table):
    assert {r["samples"] for r in QUERIES["random_timing"](spark, table[0]).collect()} == {1000}
