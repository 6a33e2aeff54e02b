import math

import numpy as np
import pytest

from tidemark.functions import library  # noqa: F401
from tidemark.functions.registry import REGISTRY
from tidemark.operators import kernels
from tidemark.plans.formula import DUCK, Compiler, FormulaError, Parser
from tidemark.plans.run import eval_formula


@pytest.fixture(scope="module")
def bars(spark):
    """Two series of a closed form; the second has a hole."""
    rows = []
    for i in range(50):
        base = 40000 + 50 * i + 500 * math.sin(0.3 * i)
        row = (base, base + 200 + 50 * abs(math.sin(0.7 * i)), base - 200 - 50 * abs(math.cos(0.7 * i)), base + 100 * math.sin(0.5 * i), 100000 + 50000 * abs(math.sin(0.2 * i)))
        rows.append(("a", "H1", i, *row))
        if i != 20:
            rows.append(("b", "H1", i, *(x / 2 for x in row)))
    df = spark.createDataFrame(rows, "symbol string, timeframe string, n int, open double, high double, low double, close double, volume double")
    return df.selectExpr("symbol", "timeframe", "timestamp_seconds(n * 3600) as ts", "open", "high", "low", "close", "volume").cache()


def column(bars, formula, symbol="a"):
    df = eval_formula(bars, formula).filter(f"symbol = '{symbol}'").orderBy("ts")
    return [r[-1] for r in df.collect()]


def close(bars):
    return [r.close for r in bars.filter("symbol = 'a'").orderBy("ts").collect()]


@pytest.mark.parametrize(
    "text, value",
    [("-2^2", -4), ("2^-1", 0.5), ("1+2*3", 7), ("(1+2)*3", 9), ("7 % 3", 1), ("-7 % 3", 2), ("MOD(-7, 3)", -1), ("1 > 2 OR 3 > 2", 1), ("NOT(1)", 0), ("!0", 1), ("1 = 1.00000000001", 1), ("IF(0, 1, 2)", 2), ("IF 1 > 0 THEN 5 ELSE 6", 5), ("1 XOR 0", 1)],
)
def test_operators(bars, text, value):
    assert column(bars.limit(1), f"{text} + 0 * OPEN")[0] == pytest.approx(value)


@pytest.mark.parametrize("bad", ["MA(C", "C +", "NOPE(C)", "XYZ", "MA(C)", "MA(C, 5, 6)", "'text'", "MA(C, C)", "FOR I = 1 TO 2 DO X := I;", "C $ 1", "FOR I = 1 TO 99999 DO X := I; END;"])
def test_errors(bad):
    with pytest.raises(FormulaError):
        Compiler().compile(bad)


def test_nesting_is_bounded():
    with pytest.raises(FormulaError):
        Parser("(" * 400 + "C" + ")" * 400).statements()


def test_statements_and_loops(bars):
    got = eval_formula(bars, "{comment} A := C; A += 1; B : A * 2, COLORRED; FOR I = 1 TO 3 DO A := A + I; END; D : A; // end").filter("symbol = 'a'").orderBy("ts").first()
    c = close(bars)[0]
    assert (got.b, got.d) == (pytest.approx(2 * (c + 1)), pytest.approx(c + 1 + 6))


def test_windows_share_one_shuffle(bars):
    plan = eval_formula(bars, "X := MA(MA(C, 5), 9); Y := CROSS(X, C); STD(Y, 3) + HHV(X, 4)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_warm_up_composes(bars):
    x = np.array(close(bars))
    got = column(bars, "MA(MA(C, 5), 9)")
    inner = np.convolve(x, np.ones(5) / 5, "valid")
    want = np.convolve(inner, np.ones(9) / 9, "valid")
    assert got[:12] == [None] * 12 and np.allclose(np.array(got[12:], dtype=float), want)


def test_period_beyond_the_series_is_missing(bars):
    assert column(bars, "MA(C, 51)") == [None] * 50


#: Results published for this closed-form series.
GOLDEN = {
    ("MACD(C, 12, 26, 9)", 33): 301.46662942079274217,
    ("MACD_SIGNAL(C, 12, 26, 9)", 33): 312.12259627228274894,
    ("MACD_HIST(C, 12, 26, 9)", 37): -70.97495940317031682,
}


@pytest.mark.parametrize("key", GOLDEN)
def test_golden(bars, key):
    assert column(bars, key[0])[key[1]] == pytest.approx(GOLDEN[key], abs=1e-8)


def test_kernels_against_plain_loops():
    x = np.random.default_rng(0).normal(100, 5, 80)
    e = kernels.ema(x, 10)
    y = np.mean(x[:10])
    assert np.isnan(e[:9]).all() and e[9] == pytest.approx(y)
    for i in range(10, 80):
        y = x[i] * 2 / 11 + y * 9 / 11
        assert e[i] == pytest.approx(y)
    s = kernels.sma(x, 5, 2)
    assert s[0] == x[0] and s[3] == pytest.approx((2 * x[3] + 3 * s[2]) / 5)
    r = kernels.rsi(x, 14)
    assert np.isnan(r[:14]).all() and ((0 <= r[14:]) & (r[14:] <= 100)).all()
    h, low = x + 1, x - 1
    assert kernels.atr(h, low, x, 14)[14] == pytest.approx(np.mean(kernels.true_range(h, low, x)[1:15]))


def test_recursions_nest_and_stay_apart_by_series(bars):
    a, b = column(bars, "MA(EMA(C, 5), 3)"), column(bars, "MA(EMA(C, 5), 3)", "b")
    assert a[:6] == [None] * 6 and a[6] is not None and len(b) == 49
    assert b[10] == pytest.approx(a[10] / 2)


def test_gaps_and_extremes(bars):
    c = close(bars)
    last = column(bars, "BARSLAST(C > 41000)")
    at = None
    for i, v in enumerate(c):
        at = i if v > 41000 else at
        assert last[i] == (None if at is None else i - at)
    rank = column(bars, "RANK(C, 10)")
    assert rank[20] == pytest.approx(100 * sum(v < c[20] for v in c[11:21]) / 9)
    assert column(bars, "HHVBARS(C, 10)")[30] == 9 - int(np.argmax(c[21:31]))
    assert column(bars, "WMA(C, 4)")[10] == pytest.approx(sum(k * v for k, v in zip((1, 2, 3, 4), c[7:11], strict=True)) / 10)


def test_cross_section(spark):
    df = spark.createDataFrame([(s, "H1", 0, v) for s, v in zip("abcdef", (1.0, 3.0, 2.0, 5.0, None, 9.0), strict=True)], "symbol string, timeframe string, ts int, close double")
    got = {r.symbol: r.result for r in eval_formula(df, "CS_RANK(C)").collect()}
    assert [got[s] for s in "abcdef"] == [0.0, 0.5, 0.25, 0.75, None, 1.0]


def test_every_function_is_registered_with_sense():
    assert len(REGISTRY) > 250
    for f in REGISTRY.values():
        assert f.kind in "ELWXGACR" and 0 <= f.least <= f.most


def test_sql_text_needs_no_recursion():
    c = Compiler(dialect=DUCK).compile("EMA(C, 5)")
    with pytest.raises(FormulaError):
        c.sql("SELECT 1", c.finish())


def test_candles(spark):
    plain = [("s", "H1", i, 100.0, 101.0, 99.0, 100.5) for i in range(20)]
    rows = [*plain, ("s", "H1", 20, 100.0, 101.0, 99.0, 100.0), ("s", "H1", 21, 101.0, 101.5, 99.5, 100.0), ("s", "H1", 22, 99.5, 103.0, 99.0, 102.0)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, n int, open double, high double, low double, close double").selectExpr("symbol", "timeframe", "timestamp_seconds(n * 60) as ts", "open", "high", "low", "close")
    got = eval_formula(df, "DOJI : CDLDOJI; ENGULF : CDLENGULFING;").orderBy("ts").collect()
    assert [r.doji for r in got[:10]] == [0.0] * 10 and got[20].doji == 100.0
    assert got[22].engulf == 100.0 and got[15].engulf == 0.0
