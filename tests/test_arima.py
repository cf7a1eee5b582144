"""ARIMA of every small order against NumPy least squares and step-by-step forecasts."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import arima
from seriesmill.operators.ordering import Sizing

ORDERS = list(itertools.product(range(3), range(3), range(3)))


def path(seed, n=240):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 2), np.zeros(n)
    for t in range(n):
        w[t] = (0.5 * w[t - 1] if t else 0) - (0.2 * w[t - 2] if t > 1 else 0) + e[t + 2] + 0.4 * e[t + 1]
    return 5.0 + np.cumsum(w) if seed % 2 else 5.0 + w


def cut(phi, clip=0.99):
    """Partial autocorrelations cut to [-clip, clip], for up to two coefficients."""
    if len(phi) < 2:
        return np.clip(phi, -clip, clip)
    r1, r2 = np.clip([phi[0] / (1 - phi[1]), phi[1]], -clip, clip)
    return np.array([r1 * (1 - r2), r2])


def reference(y, p, d, q, m=None, deep=None):
    """Both regressions by lstsq; forecasts by the recursion."""
    w = np.diff(y, d) if d else y.copy()
    m = (p + q if q else 0) if m is None else (m if q else 0)
    deep = (max(p, m + q) if q else p) if deep is None else deep
    n = len(w)
    lag = lambda k, r: w[r - k : n - k]
    one = lambda r: [np.ones(n - r)] if d == 0 else []
    a = np.zeros(0)
    if q:
        a = np.linalg.lstsq(np.stack([lag(i, m) for i in range(1, m + 1)] + one(m), 1), lag(0, m), rcond=None)[0][:m]
    u = lambda j, r: lag(j, r) - sum(a[i - 1] * lag(j + i, r) for i in range(1, m + 1))
    cols = [lag(i, deep) for i in range(1, p + 1)] + [u(j, deep) for j in range(1, q + 1)]
    design = np.stack(cols + one(deep), 1) if cols or d == 0 else np.zeros((n - deep, 0))
    x = np.linalg.lstsq(design, lag(0, deep), rcond=None)[0] if design.shape[1] else np.zeros(0)
    sigma2 = float(np.mean((lag(0, deep) - design @ x) ** 2))
    phi, theta = cut(x[:p]), x[p : p + q]
    ubar = [u(j, deep).mean() if d == 0 else 0.0 for j in range(1, q + 1)]
    c = lag(0, deep).mean() - sum(f * lag(i, deep).mean() for i, f in enumerate(phi, 1)) if d == 0 else 0.0
    at = lambda k: w[n - 1 - k]
    e = [at(k) - c - sum(f * at(k + i) for i, f in enumerate(phi, 1))
         - sum(t * (at(k + j) - sum(a[i - 1] * at(k + j + i) for i in range(1, m + 1)) - ubar[j - 1]) for j, t in enumerate(theta, 1)) for k in range(q)]
    ws, es, level, slope, out = [at(k) for k in range(max(p, 1))], e, y[-1], (y[-1] - y[-2]), []
    for _ in range(12):
        new = c + sum(f * v for f, v in zip(phi, ws)) + sum(t * v for t, v in zip(theta, es))
        ws, es = [new, *ws[:-1]], ([0.0, *es[:-1]] if q else [])
        if d == 0:
            level = new
        elif d == 1:
            level += new
        else:
            slope += new
            level += slope
        out.append(level)
    aic = (n - deep) * math.log(sigma2) + 2 * (p + q + 1 + (d == 0))
    return phi, theta, sigma2, aic, out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(s, t, float(v)) for s in (1, 2, 3) for t, v in enumerate(path(s))]
    rows += [(9, t, float(t % 3)) for t in range(12)] + [(7, t, 4.0) for t in range(40)] + [(None, t, float(v)) for t, v in enumerate(path(5, 60))]
    return spark.createDataFrame(rows, "s int, t int, y double").repartition(3)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_orders(table, d):
    for p, _, q in [o for o in ORDERS if o[1] == d]:
        got = {r.s: r for r in arima.fit(table, "y", "t", "s", (p, d, q)).collect()}
        for s in (1, 2, 3):
            phi, theta, sigma2, aic, _ = reference(path(s), p, d, q)
            assert got[s].theta == pytest.approx(list(theta), abs=1e-7) and got[s].sigma2 == pytest.approx(sigma2, rel=1e-7)
            assert got[s].aic == pytest.approx(aic, rel=1e-7) and got[s].phi == pytest.approx(list(phi), abs=1e-7)
        assert got[9].phi is None and got[9].y_last == 2.0 and got[None].phi is not None


def test_forecasts(table):
    for order in [(0, 0, 0), (0, 1, 0), (1, 1, 1), (2, 0, 2), (0, 1, 2), (1, 2, 1), (2, 2, 2), (0, 0, 1)]:
        out = arima.forecast(arima.fit(table, "y", "t", "s", order), 12, "s").collect()
        for s in (1, 2, 3):
            got = [r.y_pred for r in sorted(out, key=lambda r: r.step) if r.s == s]
            assert got == pytest.approx(reference(path(s), *order)[4], abs=1e-6)
        assert all(r.y_pred is None for r in out if r.s == 9)


def test_cut_blocks_and_one_series(table):
    one = table.filter("s = 1").drop("s")
    whole = arima.fit(one, "y", "t", None, (2, 1, 2)).first()
    cut = arima.fit(one, "y", "t", None, (2, 1, 2), sizing=Sizing(20, 5, 30)).first()
    assert cut.phi == pytest.approx(whole.phi) and cut.e == pytest.approx(whole.e)
    rows = arima.forecast_rows(arima.fit(one.filter("t < 200"), "y", "t", None, (1, 1, 0)), one.filter("t >= 200"), "t")
    got = [r.y_pred for r in rows.orderBy("t").limit(12).collect()]
    assert got == pytest.approx(reference(path(1)[:200], 1, 1, 0)[4], abs=1e-6)


def test_select_is_the_least_aic(table):
    got = {r.s: (r.p, r.d, r.q) for r in arima.select(table, "y", "t", "s", 1).collect()}
    for s in (1, 2, 3):
        want = min(((reference(path(s), p, 1, q, 4, 6)[3], p + q, p), (p, 1, q)) for p in range(3) for q in range(3))[1]
        assert got[s] == want


def test_intervals_by_simulation(table):
    fit = arima.fit(table.filter("s = 1"), "y", "t", "s", (1, 1, 1))
    r, rng = fit.first(), np.random.default_rng(0)
    out = {x.step: x.upper - x.y_pred for x in arima.forecast(fit, 6, "s", 0.8).collect()}
    w, level, e = np.zeros(200_000), np.zeros(200_000), np.zeros(200_000)
    for h in range(1, 7):
        new = rng.normal(0, math.sqrt(r.sigma2), 200_000)
        w, e = r.phi[0] * w + r.theta[0] * e + new, new
        level += w
        assert out[h] == pytest.approx(1.2815515655 * level.std(), rel=0.01)


def test_explosive_parts_are_cut_and_bad_orders_refused(spark):
    grow = spark.createDataFrame([(t, 1.2**t) for t in range(60)], "t int, y double")
    assert abs(arima.fit(grow, "y", "t", None, (1, 0, 0)).first().phi[0]) <= 0.99
    with pytest.raises(ValueError):
        arima.fit(grow, "y", "t", None, (1, -1, 0))
    assert arima.fit(grow.filter("t < 0").withColumn("s", F.lit(1)), "y", "t", "s", (1, 1, 1)).collect() == []


def test_plan_of_paths_is_short(spark):
    """Filters and joins behind a fit do not copy its columns into the plan."""
    from seriesmill.operators import forecast as X

    rows = spark.range(400).selectExpr("id", "id % 4 AS user", "sin(id) + cos(3 * id) AS value")
    fit = X.arima_fit(rows, "value", "id", "user")
    shocks = X.arima_residuals(rows, fit, "value", "id", "user")
    paths = X.bootstrap_paths(fit, shocks, "id", "user", 3, samples=5)
    assert len(fit.filter("phi IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()) < 5_000
    assert paths.count() == 4 * 5 * 3
