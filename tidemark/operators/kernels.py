"""Recursive indicators as NumPy kernels, shared by batch and streaming.

``run_kernels`` runs all recursions of a planner stage in one grouped pass per (symbol, timeframe): a
recursion needs its series in order, so a series is one task; different series are independent. A
leading run of missing values is warm-up and is skipped; a missing value inside a series is carried.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAN = np.nan


def _empty(n: int) -> np.ndarray:
    return np.full(n, NAN)


def linear(x: np.ndarray, a: float, seed: float, start: int) -> np.ndarray:
    """y[start] = seed; y[i] = y[i-1] + a * (x[i] - y[i-1]); a missing x keeps y."""
    out = _empty(len(x))
    y = seed
    out[start] = y
    for i in range(start + 1, len(x)):
        v = x[i]
        if v == v:
            y += a * (v - y)
        out[i] = y
    return out


def ema(x: np.ndarray, n: float) -> np.ndarray:
    """Seeded by the mean of the first n values."""
    n = int(n)
    if len(x) < n or n < 1:
        return _empty(len(x))
    return linear(x, 2 / (n + 1), float(np.mean(x[:n])), n - 1)


def rma(x: np.ndarray, n: float) -> np.ndarray:
    n = int(n)
    if len(x) < n or n < 1:
        return _empty(len(x))
    return linear(x, 1 / n, float(np.mean(x[:n])), n - 1)


def sma(x: np.ndarray, n: float, m: float = 1) -> np.ndarray:
    """(m * x + (n - m) * previous) / n from the first value on."""
    return linear(x, m / n, float(x[0]), 0) if len(x) else _empty(0)


def dma(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    out, y = _empty(len(x)), NAN
    for i, (v, k) in enumerate(zip(x, a, strict=True)):
        if v == v and k == k:
            y = v if y != y else k * v + (1 - k) * y
        out[i] = y
    return out


def _tail(x: np.ndarray, f: Callable, *params) -> np.ndarray:
    """f over x without its leading missing values, put back in place."""
    ok = np.flatnonzero(x == x)
    out = _empty(len(x))
    if len(ok):
        out[ok[0] :] = f(x[ok[0] :], *params)
    return out


def dema(x: np.ndarray, n: float) -> np.ndarray:
    e = ema(x, n)
    return 2 * e - _tail(e, ema, n)


def tema(x: np.ndarray, n: float) -> np.ndarray:
    e = ema(x, n)
    f = _tail(e, ema, n)
    return 3 * e - 3 * f + _tail(f, ema, n)


def trix(x: np.ndarray, n: float) -> np.ndarray:
    e = _tail(_tail(ema(x, n), ema, n), ema, n)
    out = _empty(len(x))
    out[1:] = (e[1:] - e[:-1]) / e[:-1] * 100
    return out


def rsi(x: np.ndarray, n: float) -> np.ndarray:
    n = int(n)
    if len(x) <= n:
        return _empty(len(x))
    d = np.diff(x)
    gain, loss = np.where(d > 0, d, 0), np.where(d < 0, -d, 0)
    g, s = rma(gain, n), rma(loss, n)
    out = _empty(len(x))
    total = g + s
    with np.errstate(invalid="ignore", divide="ignore"):
        out[1:] = np.where(total > 1e-8, 100 * g / total, np.where(total == total, 0, NAN))
    return out


def macd(x: np.ndarray, fast: float, slow: float, signal: float) -> tuple[np.ndarray, ...]:
    """Line, signal and histogram; the fast average starts so that both begin at the slow one's first bar."""
    fast, slow, signal = int(fast), int(slow), int(signal)
    n, none = len(x), _empty(len(x))
    first = slow + signal - 2
    if n <= first or fast >= slow:
        return none, none.copy(), none.copy()
    a = np.concatenate((_empty(slow - fast), ema(x[slow - fast :], fast)))
    line = a - ema(x, slow)
    sig = np.concatenate((_empty(slow - 1), ema(line[slow - 1 :], signal)))
    line[:first] = NAN
    return line, sig, line - sig


def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = _empty(len(c))
    out[1:] = np.maximum(h[1:], c[:-1]) - np.minimum(low[1:], c[:-1])
    return out


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: float) -> np.ndarray:
    """Wilder's average of the true range from bar 1; the first value is at bar n."""
    out = _empty(len(c))
    if len(c) > n:
        out[1:] = rma(true_range(h, low, c)[1:], n)
    return out


def dmi(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: float) -> tuple[np.ndarray, ...]:
    """+DI, -DI, ADX and DX by Wilder's sums."""
    n = int(n)
    size = len(c)
    plus, minus, adx = _empty(size), _empty(size), _empty(size)
    if size <= n:
        return plus, minus, adx, _empty(size)
    up, dn = np.diff(h), -np.diff(low)
    pdm, mdm = np.where((up > dn) & (up > 0), up, 0), np.where((dn > up) & (dn > 0), dn, 0)
    tr = true_range(h, low, c)[1:]
    sums = [float(np.sum(v[: n - 1])) for v in (pdm, mdm, tr)]
    dx = _empty(size)
    for i in range(n - 1, size - 1):
        sums = [s - s / n + v[i] for s, v in zip(sums, (pdm, mdm, tr), strict=True)]
        p, m, t = sums
        plus[i + 1], minus[i + 1] = (100 * p / t, 100 * m / t) if t > 1e-8 else (0.0, 0.0)
        total = plus[i + 1] + minus[i + 1]
        dx[i + 1] = 100 * abs(plus[i + 1] - minus[i + 1]) / total if total > 1e-8 else 0.0
    if size > 2 * n - 1:
        adx[n:] = rma(dx[n:], n)
    return plus, minus, adx, dx


def quiet(on: np.ndarray, n: float) -> np.ndarray:
    """1 where ``on`` fires and did not within the n bars before it passed."""
    out, last = np.zeros(len(on)), -np.inf
    for i in np.flatnonzero(on > 0):
        if i - last >= n:
            out[i], last = 1, i
    return out


def _rolling(x: np.ndarray, n: int, f) -> np.ndarray:
    out = _empty(len(x))
    if len(x) >= n:
        out[n - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def kdj(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: float, m1: float, m2: float) -> tuple[np.ndarray, ...]:
    """K and D start from 50 before the first full window; J = 3K - 2D."""
    hi, lo = _rolling(h, int(n), np.max), _rolling(low, int(n), np.min)
    k_out, d_out = _empty(len(c)), _empty(len(c))
    k = d = 50.0
    for i in range(int(n) - 1, len(c)):
        span = hi[i] - lo[i]
        if span == span:
            raw = (c[i] - lo[i]) / span * 100 if span > 1e-8 else 50.0
            k += (raw - k) / m1
            d += (k - d) / m2
        k_out[i], d_out[i] = k, d
    return k_out, d_out, 3 * k_out - 2 * d_out


def sar(h: np.ndarray, low: np.ndarray, step: float, most: float) -> np.ndarray:
    """Parabolic stop and reverse; the first direction follows the greater directional movement."""
    n = len(h)
    out = _empty(n)
    if n < 2:
        return out
    up_move, down_move = h[1] - h[0], low[0] - low[1]
    rising = not (down_move > up_move and down_move > 0)
    stop, best = (low[0], h[1]) if rising else (h[0], low[1])
    af = step
    prev_h, prev_l = h[0], low[0]
    prev_h, prev_l = h[1], low[1]
    for i in range(1, n):
        last_h, last_l, prev_h, prev_l = prev_h, prev_l, h[i], low[i]
        if rising:
            if prev_l <= stop:
                rising = False
                stop = max(best, last_h, prev_h)
                out[i] = stop
                af, best = step, prev_l
                stop = max(stop + af * (best - stop), last_h, prev_h)
            else:
                out[i] = stop
                if prev_h > best:
                    best, af = prev_h, min(most, af + step)
                stop = min(stop + af * (best - stop), last_l, prev_l)
        elif prev_h >= stop:
            rising = True
            stop = min(best, last_l, prev_l)
            out[i] = stop
            af, best = step, prev_h
            stop = min(stop + af * (best - stop), last_l, prev_l)
        else:
            out[i] = stop
            if prev_l < best:
                best, af = prev_l, min(most, af + step)
            stop = max(stop + af * (best - stop), last_h, prev_h)
    return out


def kama(x: np.ndarray, n: float) -> np.ndarray:
    n = int(n)
    out = _empty(len(x))
    if len(x) <= n:
        return out
    fast, slow = 2 / 3, 2 / 31
    y = x[n - 1]
    for i in range(n, len(x)):
        path = float(np.sum(np.abs(np.diff(x[i - n : i + 1]))))
        er = abs(x[i] - x[i - n]) / path if path > 1e-8 else 0.0
        y += (er * (fast - slow) + slow) ** 2 * (x[i] - y)
        out[i] = y
    return out


def _volume_index(c: np.ndarray, v: np.ndarray, sign: int) -> np.ndarray:
    out = _empty(len(c))
    y = 1000.0
    for i in range(len(c)):
        if i and sign * (v[i] - v[i - 1]) > 0 and abs(c[i - 1]) > 1e-8:
            y += (c[i] - c[i - 1]) / c[i - 1] * y
        out[i] = y
    return out


def nvi(c: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _volume_index(c, v, -1)


def pvi(c: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _volume_index(c, v, 1)


def heikin(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Averaged candles: the close is the mean of the bar, the open the mean of the last averaged open and close."""
    close, opening = (o + h + low + c) / 4, _empty(len(c))
    for i in range(len(c)):
        opening[i] = (o[0] + c[0]) / 2 if i == 0 else (opening[i - 1] + close[i - 1]) / 2
    return opening, close


def supertrend(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: float, k: float) -> tuple[np.ndarray, ...]:
    """The trailing band and its direction (1 up, -1 down); bands only move towards the price while it stays inside."""
    width, mid = atr(h, low, c, n), (h + low) / 2
    line, direction = _empty(len(c)), _empty(len(c))
    up = dn = NAN
    d = 1.0
    for i in range(len(c)):
        if width[i] != width[i]:
            continue
        a, b = mid[i] + k * width[i], mid[i] - k * width[i]
        if up == up:
            a = a if a < up or c[i - 1] > up else up
            b = b if b > dn or c[i - 1] < dn else dn
            d = 1.0 if c[i] > up else -1.0 if c[i] < dn else d
        up, dn = a, b
        line[i], direction[i] = (dn if d > 0 else up), d
    return line, direction


def t3(x: np.ndarray, n: float, v: float) -> np.ndarray:
    e = [ema(x, n)]
    for _ in range(5):
        e.append(_tail(e[-1], ema, n))
    return -(v**3) * e[5] + 3 * (v**2 + v**3) * e[4] - 3 * (2 * v**2 + v + v**3) * e[3] + (1 + 3 * v + v**3 + 3 * v**2) * e[2]


def cmo(x: np.ndarray, n: float) -> np.ndarray:
    """Momentum oscillator on Wilder averages."""
    out = _empty(len(x))
    if len(x) > n:
        d = np.diff(x)
        g, s = rma(np.where(d > 0, d, 0), n), rma(np.where(d < 0, -d, 0), n)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[1:] = np.where(g + s > 1e-8, 100 * (g - s) / (g + s), np.where(g == g, 0, NAN))
    return out


def adosc(ad: np.ndarray, fast: float, slow: float) -> np.ndarray:
    """Difference of two averages of the accumulation line, both seeded by its first value; from bar slow - 1 on."""
    a, b = (linear(ad, 2 / (n + 1), float(ad[0]), 0) for n in (fast, slow))
    out = a - b
    out[: int(max(fast, slow)) - 1] = NAN
    return out


KERNELS: dict[str, Callable] = {f.__name__: f for f in (ema, rma, sma, dma, dema, tema, trix, rsi, macd, atr, dmi, kdj, sar, kama, nvi, pvi, heikin, supertrend, t3, cmo, adosc, quiet)}


def apply_kernel(kind: str, inputs: list[np.ndarray], params: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Outputs of a kernel over aligned inputs, past their common leading missing values."""
    n = len(inputs[0])
    ok = np.ones(n, dtype=bool)
    for x in inputs:
        ok &= x == x
    first = np.flatnonzero(ok)
    start = int(first[0]) if len(first) else n
    made = KERNELS[kind](*[x[start:] for x in inputs], *params) if start < n else _empty(0)
    made = made if isinstance(made, tuple) else (made,)
    return tuple(np.concatenate((_empty(start), m)) for m in made) if start < n else tuple(_empty(n) for _ in range(4))


def run_kernels(df: DataFrame, jobs: list[tuple], keys: list[str]) -> DataFrame:
    """Adds the columns of ``jobs`` (column, kernel, inputs, params, part) in one pass per series."""
    schema = T.StructType(list(df.schema))
    for job in jobs:
        schema = schema.add(job[0], "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable").reset_index(drop=True)
        done: dict[tuple, tuple] = {}
        for column, kind, inputs, params, part in jobs:
            if (kind, inputs, params) not in done:
                done[kind, inputs, params] = apply_kernel(kind, [pdf[c].to_numpy(dtype=float) for c in inputs], params)
            made = done[kind, inputs, params][part]
            pdf[column] = pd.Series(made).where(~np.isnan(made), None).astype(object)
        return pdf

    return df.groupBy(*keys).applyInPandas(run, schema)
