"""Runs compiled formulas over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import candles, extra, library  # noqa: F401  fill the registry
from tidemark.operators.kernels import run_kernels
from tidemark.plans.formula import Compiler


def eval_formula(bars: DataFrame, source: str, params: dict[str, float] | None = None, digits: int | None = None, keep: tuple[str, ...] = ("symbol", "timeframe", "ts")) -> DataFrame:
    """The outputs of a formula, one row a bar.

    ``bars`` has symbol, timeframe, ts, open, high, low, close, volume; (symbol, timeframe, ts) is unique.
    Every stage is one projection on the same partitioning and order, so Spark shuffles and sorts once
    for all windows; a stage with recursions adds one grouped pass.
    """
    c = Compiler(set(bars.columns), params=params).compile(source)
    final = c.finish(keep, digits)
    df = bars
    for i, stage in enumerate(c.stages):
        if stage:
            df = df.select("*", *[F.expr(t).alias(n) for n, t in stage.items()])
        if c.kernels[i]:
            df = run_kernels(df, c.kernels[i], c.KEYS.split(", "))
    return df.selectExpr(*_split(final))


def _split(text: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
