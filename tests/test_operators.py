import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import asof, panel, risk
from tidemark.sources import bars as sources

T0 = datetime(2024, 1, 1)


def test_as_of_equals_a_scan(spark):
    rng = np.random.default_rng(1)
    left = [(int(k), T0 + timedelta(minutes=int(m)), i) for i, (k, m) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 6000, 300), strict=True))]
    right = [(int(k), T0 + timedelta(minutes=int(m)), float(v)) for k, m, v in zip(rng.integers(0, 4, 60), rng.integers(0, 6000, 60), rng.random(60), strict=True)]
    lf = spark.createDataFrame(left, "k int, ts timestamp, i int")
    rf = spark.createDataFrame(right, "k int, ts timestamp, v double")
    want = {}
    for k, ts, i in left:
        have = [(t, v) for kk, t, v in right if kk == k and t <= ts]
        want[i] = max(have)[1] if have else None
    for bucket in (None, "day", "hour"):
        got = {r.i: r.v for r in asof.as_of(lf, rf, ["k"], ["v"], bucket=bucket).collect()}
        assert got == want
    same = {r.i: r.v for r in asof.exact(lf, rf, ["k"], ["v"]).collect()}
    assert all((same[i] is not None) == any(kk == k and t == ts for kk, t, _ in right) for k, ts, i in left)


@pytest.fixture(scope="module")
def study(spark):
    rows = [(T0.date() + timedelta(days=d), a, float((a * 7 + d * 3) % 11), 10.0 + a + d * (1 if a % 2 else -0.1)) for d in range(8) for a in range(9) if (a, d) != (3, 4)]
    return panel.dated(spark.createDataFrame(rows, "date date, asset int, factor double, price double")).cache()


def test_forward_returns_need_the_exact_date(study):
    got = {(r.asset, r.d): r.fwd_2 for r in panel.forward_returns(study, (2,)).collect()}
    price = {(r.asset, r.d): r.price for r in study.collect()}
    for (a, d), v in got.items():
        later = price.get((a, d + 2))
        assert v is None if later is None else v == pytest.approx(later / price[a, d] - 1)
    assert got[3, 3] is None  # date 5 is missing for asset 3


def test_quantiles_and_coefficients(study):
    rows = panel.with_quantiles(panel.forward_returns(study, (1,)), 3).collect()
    for d in range(1, 9):
        own = sorted((r.factor, r.quantile) for r in rows if r.d == d)
        assert [q for _, q in own] == sorted(q for _, q in own) and {q for _, q in own} == {1, 2, 3}
    ics = {r.date: r for r in panel.information_coefficients(panel.forward_returns(study, (1,)), "fwd_1").collect()}
    first = [(r.factor, r.fwd_1) for r in rows if r.d == 1]
    assert ics[T0.date()].ic == pytest.approx(np.corrcoef(*zip(*first, strict=True))[0, 1])


def test_weights_are_neutral_and_of_unit_gross(study):
    rows = panel.factor_weights(study).collect()
    for d in range(1, 9):
        w = [r.weight for r in rows if r.d == d]
        assert sum(w) == pytest.approx(0, abs=1e-12) and sum(map(abs, w)) == pytest.approx(1)


def test_neutralize_leaves_nothing_of_the_exposure(study):
    rows = panel.neutralize(study, "factor", "price", "date").filter("d = 2").collect()
    assert np.cov([r.residual for r in rows], [r.price for r in rows])[0, 1] == pytest.approx(0, abs=1e-9)


def test_risk(spark):
    r = [0.01, -0.02, 0.03, -0.01, 0.0, 0.02, -0.03, 0.015, 0.005, -0.004]
    rows = spark.createDataFrame([("x", i, v) for i, v in enumerate(r)], "s string, i int, ret double")
    got = risk.performance(rows, "s", confidence=0.8).first()
    assert got.sharpe == pytest.approx(np.mean(r) / np.std(r, ddof=1) * math.sqrt(252))
    assert got.var_historical == pytest.approx(-sorted(r)[2]) and got.cvar == pytest.approx(-np.mean(sorted(r)[:2]))
    flat = risk.performance(spark.createDataFrame([("x", 0, 0.0), ("x", 1, 0.0)], "s string, i int, ret double"), "s").first()
    assert (flat.sharpe, flat.omega) == (0.0, 0.0)
    prices = spark.createDataFrame([("x", i, p) for i, p in enumerate([1.0, 2.0, 1.0, 3.0, 2.0])], "s string, i int, p double")
    dd = risk.drawdowns(prices, "s", "i", "p").first()
    assert (dd.max_drawdown, dd.trough) == (0.5, 2)


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# version=1\ndate,Open,High,Low,Close\n2024-01-01,1,2,0.5,1.5\n2024-01-02,2,3,1.5,\n")
    got = sources.read_ohlcv_csv(spark, str(tmp_path / "a.csv"), "s").orderBy("ts").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(1.0, 1.5, 0.0), (2.0, None, 0.0)]
    (tmp_path / "b.csv").write_text("open,high,low\n1,2,3\n")
    with pytest.raises(ValueError):
        sources.read_ohlcv_csv(spark, str(tmp_path / "b.csv"), "s")


def test_repeated_bars_are_an_error(spark):
    df = spark.createDataFrame([("s", "H1", T0, 1.0), ("s", "H1", T0, 2.0)], "symbol string, timeframe string, ts timestamp, close double")
    with pytest.raises(Exception, match="repeated bar"):
        sources.check_unique(df).collect()


def test_nan_becomes_null(spark):
    assert sources.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "x double, y int")).first() == (None, 1)
