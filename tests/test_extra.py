"""Functions of ``extra`` against plain loops, and host columns."""

import math

import pytest

from tidemark.plans.run import eval_formula


@pytest.fixture(scope="module")
def series(spark):
    rows = []
    for i in range(60):
        mid = 100 + 10 * math.sin(0.4 * i) + (i * 37 % 11) / 3
        o, c = mid + (i * 13 % 7 - 3) / 2, mid + (i * 29 % 9 - 4) / 3
        rows.append((o, max(o, c) + (i * 7 % 5) / 4, min(o, c) - (i * 11 % 6) / 4, c, 1000.0 + i * 17 % 300))
    df = spark.createDataFrame([("a", "D1", i, *r) for i, r in enumerate(rows)], "symbol string, timeframe string, n int, open double, high double, low double, close double, volume double")
    return df.selectExpr("symbol", "timeframe", "timestamp_seconds(n * 86400) as ts", "open", "high", "low", "close", "volume", "close * 2 as index_close", "volume + 1 as finance_7").cache(), rows


def values(series, formula):
    return [r[-1] for r in eval_formula(series[0], formula).orderBy("ts").collect()]


def same(got, want):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want, strict=True)):
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w, rel=1e-9, abs=1e-9)), (i, g, w)


def ema(x, n):
    out, y = [], None
    seen = []
    for v in x:
        if v is None and y is None:
            out.append(None)
            continue
        if y is None:
            seen.append(v)
            y = sum(seen) / n if len(seen) == n else None
        else:
            y += 2 / (n + 1) * (v - y)
        out.append(y)
    return out


def test_bands_and_powers(series):
    o, h, low, c, v = zip(*series[1], strict=True)
    e = ema(c, 13)
    same(values(series, "ERI_BEAR(H, L, C)"), [None if y is None else x - y for x, y in zip(low, e, strict=True)])
    same(values(series, "PVO(V, 3, 8)"), [None if b is None else 100 * (a - b) / b for a, b in zip(ema(v, 3), ema(v, 8), strict=True)])
    up = [x * (1 + 4 * (x - y) / (x + y)) for x, y in zip(h, low, strict=True)]
    same(values(series, "ACCBANDS(H, L, C, 5)"), [None] * 4 + [sum(up[i - 4 : i + 1]) / 5 for i in range(4, 60)])
    mid = ema([(a + b + d) / 3 for a, b, d in zip(h, low, c, strict=True)], 6)
    tr = [None] + [max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(1, 60)]
    first, want, y = 5, [None] * 5, None  # longer average, then the range from the bars before its start
    for i in range(first, 60):
        y = sum(tr[first - 2 : first + 1]) / 3 if y is None else y + (tr[i] - y) / 3
        want.append(mid[i] - 1.5 * y)
    same(values(series, "KC_LOWER(H, L, C, 6, 3, 1.5)"), want)


def test_marks(series):
    o, h, low, c, v = zip(*series[1], strict=True)
    want = [None] * 4 + [100 if all(h[i - 1] > h[j] for j in range(i - 4, i + 1) if j != i - 1) else 0 for i in range(4, 60)]
    same(values(series, "FRACTAL(H, L, 3, 1)"), want)
    n, m, found = 6, 3, []
    for i in range(60):
        start = max(0, i + 1 - n)
        near = range(max(i - m, start), min(i + m, 59, start + n - 1) + 1)
        found.append(float(all(low[j] > low[i] for j in near if j != i)))
    same(values(series, "FINDLOW(L, 6, 3, 1)"), found)
    on = [x > 104 for x in c]
    same(values(series, "BACKSET(C > 104, 3)"), [float(any(on[i : i + 3])) for i in range(60)])
    seen, last, want = 0, None, []
    for i, x in enumerate(on):
        seen += x
        last = i if x and seen >= 4 else last
        want.append(None if last is None else i - last)
    same(values(series, "BARSSINCEN(C > 104, 4)"), want)
    last, want = None, []
    for i, x in enumerate(on):
        fires = x and (last is None or i - last >= 5)
        last = i if fires else last
        want.append(float(fires))
    same(values(series, "FILTER(C > 104, 5)"), want)
    assert values(series, "BARSTATUS")[:2] == [1, 0] and values(series, "BARSTATUS")[-1] == 2
    same(values(series, "REFDATE(C, 7)"), [c[7]] * 60)
    gaps = [o[i] / c[i - 1] - 1 for i in range(1, 60)]
    same(values(series, "GAP_SIGNAL(O, C, 0.03)"), [0] + [1 if g >= 0.03 else -1 if g <= -0.03 else 0 for g in gaps])


def test_windows(series):
    o, h, low, c, v = zip(*series[1], strict=True)
    same(values(series, "PERCENTRANK(C, 9)"), [None] * 9 + [100 * sum(x < c[i] for x in c[i - 9 : i]) / 9 for i in range(9, 60)])
    same(values(series, "SORT(C, 7, 0)"), [None] * 6 + [1 + sorted(c[i - 6 : i + 1], reverse=True).index(c[i]) for i in range(6, 60)])
    same(values(series, "PERCENTILE(C, 9, 30)"), [None] * 8 + [sorted(c[i - 8 : i + 1])[round(0.3 * 8)] for i in range(8, 60)])
    want = [None] * 9
    for i in range(9, 60):
        x, y = c[i - 9 : i + 1], o[i - 9 : i + 1]
        a, b = sum(x) / 10, sum(y) / 10
        want.append(sum((p - a) * (q - b) for p, q in zip(x, y, strict=True)) / sum((q - b) ** 2 for q in y))
    same(values(series, "BETA(C, O, 10)"), want)
    up = [0.0] + [h[i] - h[i - 1] if h[i] - h[i - 1] > max(0, low[i - 1] - low[i]) else 0.0 for i in range(1, 60)]
    same(values(series, "PLUS_DM(H, L)"), up)
    top, bottom = ([None] * 4 + [f(x[i - 4 : i + 1]) for i in range(4, 60)] for f, x in ((max, h), (min, low)))
    num = [None if a is None else p - (a + b) / 2 for p, a, b in zip(c, top, bottom, strict=True)]
    den = [None if a is None else a - b for a, b in zip(top, bottom, strict=True)]
    a, b = ema(ema(num, 7), 2), ema(ema(den, 7), 2)
    same(values(series, "SMI(H, L, C, 5, 2, 7, 3)"), [None if y is None else 100 * x / (y / 2) for x, y in zip(a, b, strict=True)])


def test_host_columns(series):
    o, h, low, c, v = zip(*series[1], strict=True)
    same(values(series, "INDEXC"), [2 * x for x in c])
    same(values(series, "FINANCE(7)"), [x + 1 for x in v])
    same(values(series, "CAPITAL"), [None] * 60)
    same(values(series, "PERIODTYPE"), [0] * 60)


def test_vwap_factor_reads_the_column(series):
    bars, rows = series
    with_vwap = bars.withColumn("vwap", bars.close * 1.5)
    same(values((with_vwap, rows), "BARVWAP / C"), [1.5] * 60)
    same(values(series, "BARVWAP / C"), [(h + low + c) / 3 / c for _, h, low, c, _ in rows])


def test_csv_columns_go_by_whole_words(spark, tmp_path):
    from tidemark.sources import bars as sources

    (tmp_path / "a.csv").write_text("contracts,open_interest,Open,High,Low,cashflow,AdjClose,Vol\n" + "\n".join(f"x,9,{i},{i + 2},{i - 1},7,{i + 1},5" for i in range(30)) + "\n")
    got = sources.read_ohlcv_csv(spark, str(tmp_path / "a.csv"), "s").orderBy("ts").collect()
    assert [(r.ts.timestamp(), r.open, r.low, r.close, r.volume) for r in got[:2]] == [(got[0].ts.timestamp(), 0, -1, 1, 5), (got[0].ts.timestamp() + 1, 1, 0, 2, 5)]
    numbered = sources.number_rows(spark.range(0, 100, numPartitions=7).toDF("x"), "n").orderBy("x").collect()
    assert [r.n for r in numbered] == list(range(100))


def test_resample_refuses_two_timeframes(series):
    from tidemark.sources import bars as sources

    bars = series[0]
    assert sources.resample(bars, "7 days", "W1").count() in (9, 10)
    with pytest.raises(Exception, match="two timeframes"):
        sources.resample(bars.unionByName(bars.selectExpr(*[f"'H1' as {c}" if c == "timeframe" else c for c in bars.columns])), "7 days", "W1").collect()
