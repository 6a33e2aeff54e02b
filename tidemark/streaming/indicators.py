"""Indicators over live bars with Structured Streaming: keyed state, forming bars replaced, late bars dropped.

State is one small row per (symbol, timeframe): the accumulators before the current bar, and the bar.
A row with the current bar's ts replaces it (a forming bar); an older one is dropped; a newer one closes
the current bar into the accumulators. Batch and stream agree on closed bars, which the tests check.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "symbol string, timeframe string, ts timestamp, close double, ema double, rma double, macd double, rsi double, obv double, highest double"
STATE = "blob string"


class Accumulator:
    """EMA, RMA, MACD line, RSI, OBV and the running high of a series; O(1) a bar."""

    def __init__(self, ema: int = 12, rma: int = 14, fast: int = 12, slow: int = 26, rsi: int = 14, state: dict | None = None):
        self.periods = (ema, rma, fast, slow, rsi)
        self.s = state or {"n": 0, "seed": {}, "avg": {}, "close": None, "obv": 0.0, "high": None}

    def _smooth(self, s: dict, name: str, x: float, n: int, alpha: float) -> float | None:
        """A recursion seeded by the mean of its first n inputs."""
        if name in s["avg"]:
            s["avg"][name] += alpha * (x - s["avg"][name])
        else:
            count, total = s["seed"].get(name, (0, 0.0))
            s["seed"][name] = (count + 1, total + x)
            if count + 1 == n:
                s["avg"][name] = (total + x) / n
        return s["avg"].get(name)

    def peek(self, close: float, high: float, volume: float) -> tuple[dict, dict]:
        """(values with this bar, state after it); the accumulator itself is unchanged."""
        s = json.loads(json.dumps(self.s))
        ema, rma, fast, slow, rsi = self.periods
        out = {"ema": self._smooth(s, "ema", close, ema, 2 / (ema + 1)), "rma": self._smooth(s, "rma", close, rma, 1 / rma)}
        b = self._smooth(s, "slow", close, slow, 2 / (slow + 1))
        a = self._smooth(s, "fast", close, fast, 2 / (fast + 1)) if s["n"] >= slow - fast else None
        out["macd"] = a - b if a is not None and b is not None else None
        out["rsi"] = None
        if s["close"] is not None:
            d = close - s["close"]
            up, dn = self._smooth(s, "gain", max(d, 0.0), rsi, 1 / rsi), self._smooth(s, "loss", max(-d, 0.0), rsi, 1 / rsi)
            if up is not None:
                out["rsi"] = 100 * up / (up + dn) if up + dn > 1e-8 else 0.0
        s["obv"] += volume if s["close"] is None or close > s["close"] else -volume if close < s["close"] else 0.0
        s["high"] = high if s["high"] is None else max(s["high"], high)
        s["close"], s["n"] = close, s["n"] + 1
        return out | {"obv": s["obv"], "highest": s["high"]}, s


def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Bars of one key in, the values at each accepted bar out."""
    held = json.loads(state.get[0]) if state.exists else {"state": None, "bar": None}
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    out = []
    for ts, close, high, volume in zip(rows["ts"], rows["close"], rows["high"], rows["volume"], strict=True):
        at, bar = pd.Timestamp(ts).value, held["bar"]
        if bar is not None and at < bar[0]:
            continue
        if bar is not None and at > bar[0]:
            held["state"] = Accumulator(state=held["state"]).peek(*bar[1:])[1]
        held["bar"] = [at, float(close), float(high), float(volume)]
        values, _ = Accumulator(state=held["state"]).peek(*held["bar"][1:])
        out.append({"symbol": key[0], "timeframe": key[1], "ts": ts, "close": float(close)} | values)
    state.update((json.dumps(held),))
    if out:
        yield pd.DataFrame(out).astype({c: float for c in ("ema", "rma", "macd", "rsi", "obv", "highest")})


def live_indicators(bars: DataFrame) -> DataFrame:
    """A streaming frame of bars to a streaming frame of indicator values, in update mode."""
    return bars.select("symbol", "timeframe", "ts", "close", "high", "volume").groupBy("symbol", "timeframe").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def live_bars(ticks: DataFrame, symbol: str, ts: str, value: str, order: str, every: str = "1 hour", late: str = "1 hour", timeframe: str = "H1") -> DataFrame:
    """Bars of a stream of ticks by tumbling windows; ticks later than the watermark are dropped."""
    from pyspark.sql import functions as F

    at = F.struct(ts, order)
    return (
        ticks.withWatermark(ts, late)
        .groupBy(F.col(symbol).alias("symbol"), F.window(ts, every).alias("w"))
        .agg(F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
