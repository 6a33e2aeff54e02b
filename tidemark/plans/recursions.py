"""DuckDB SQL of the queries of recursive functions, written by their definitions and not by the planner.

A linear recursion y[i] = d * y[i-1] + e * x[i] from a seed at bar s is the sum d^(i-s) * seed + e * d^(i-j) * x[j]
over s < j <= i, so it is a join of a series with itself; factors that vary by bar become sums of
logarithms; state machines are recursive CTEs. ``Sheet`` collects columns by symbol and bar number i.
"""

from __future__ import annotations

from tidemark.plans.formula import rounded
from tidemark.sources.bars import EVENT_BARS_SQL

_ORDER = "(PARTITION BY symbol ORDER BY i)"


class Sheet:
    def __init__(self):
        self.ctes = [f"b AS ({EVENT_BARS_SQL})", "w0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM b)"]
        self.at = 0

    def add(self, **columns: str) -> None:
        """Columns by expressions over the ones so far."""
        self.ctes.append(f"w{self.at + 1} AS (SELECT *, {', '.join(f'{text} AS {name}' for name, text in columns.items())} FROM w{self.at})")
        self.at += 1

    def linear(self, name: str, x: str, d: float | str, e: float | str, n: int, seed: str = "avg(x)", early: int = 0) -> None:
        """The recursion over column x; the seed is over its first n values and stands at the last of them (``early`` bars before)."""
        w, k = f"w{self.at}", self.at
        self.ctes += [
            f"f{k} AS (SELECT symbol, min(i) AS f FROM {w} WHERE {x} IS NOT NULL GROUP BY symbol)",
            f"s{k} AS (SELECT symbol, f + {n - 1 - early} AS s, {seed} AS y0 FROM (SELECT symbol, f, i, {x} AS x FROM {w} JOIN f{k} USING (symbol)) WHERE i BETWEEN f AND f + {n - 1} GROUP BY symbol, f HAVING count(*) = {n})",
            f"t{k} AS (SELECT a.symbol, a.i, pow({d}, a.i - s) * any_value(y0) + coalesce(sum({e} * pow({d}, a.i - c.i) * c.{x}) FILTER (WHERE c.i > s), 0) AS y "
            f"FROM {w} a JOIN s{k} USING (symbol) JOIN {w} c ON c.symbol = a.symbol AND c.i <= a.i AND c.i >= s WHERE a.i >= s GROUP BY a.symbol, a.i, s)",
            f"w{k + 1} AS (SELECT {w}.*, y AS {name} FROM {w} LEFT JOIN t{k} ON t{k}.symbol = {w}.symbol AND t{k}.i = {w}.i)",
        ]
        self.at += 1

    def ema(self, name: str, x: str, n: int) -> None:
        self.linear(name, x, f"(1 - 2e0 / {n + 1})", f"(2e0 / {n + 1})", n)

    def rma(self, name: str, x: str, n: int) -> None:
        self.linear(name, x, f"(1 - 1e0 / {n})", f"(1e0 / {n})", n)

    def varying(self, name: str, x: str, k: str, start: int) -> None:
        """y[i] = y[i-1] + k[i] * (x[i] - y[i-1]) from y[start] = x[start]."""
        w, t = f"w{self.at}", self.at
        self.ctes += [
            f"l{t} AS (SELECT symbol, i, {x} AS x, CASE WHEN i = {start} THEN 1 ELSE {k} END AS k, sum(CASE WHEN i > {start} THEN ln(1 - {k}) ELSE 0 END) OVER {_ORDER} AS l FROM {w} WHERE i >= {start})",
            f"t{t} AS (SELECT a.symbol, a.i, sum(c.k * c.x * exp(a.l - c.l)) AS y FROM l{t} a JOIN l{t} c ON c.symbol = a.symbol AND c.i <= a.i GROUP BY a.symbol, a.i)",
            f"w{t + 1} AS (SELECT {w}.*, y AS {name} FROM {w} LEFT JOIN t{t} ON t{t}.symbol = {w}.symbol AND t{t}.i = {w}.i)",
        ]
        self.at += 1

    def states(self, first: dict[str, str], step: dict[str, str], **shown: str) -> None:
        """Columns of a state machine: ``first`` at bar 0, ``step`` from the state z and the bar r."""
        w, t = f"w{self.at}", self.at
        self.ctes += [
            f"z{t} AS (SELECT symbol, i, {', '.join(f'{v} AS {c}' for c, v in first.items())} FROM {w} WHERE i = 0 UNION ALL "
            f"SELECT r.symbol, r.i, {', '.join(f'{step[c]} AS {c}' for c in first)} FROM z{t} z JOIN {w} r ON r.symbol = z.symbol AND r.i = z.i + 1)",
            f"w{t + 1} AS (SELECT {w}.*, {', '.join(f'z{t}.{c} AS {name}' for name, c in shown.items())} FROM {w} JOIN z{t} ON z{t}.symbol = {w}.symbol AND z{t}.i = {w}.i)",
        ]
        self.at += 1

    def sql(self, digits: int = 6, **outputs: str) -> str:
        shown = ", ".join(f"{rounded(text, digits)} AS {name}" for name, text in outputs.items())
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT symbol, timeframe, ts, {shown} FROM w{self.at}"


def averages() -> str:
    s = Sheet()
    s.ema("e12", "close", 12)
    s.linear("sma", "close", "(11e0 / 12)", "(1e0 / 12)", 1)
    s.rma("rma", "close", 14)
    s.add(k="volume / 100", path=f"abs(close - lag(close) OVER {_ORDER})", far=f"abs(close - lag(close, 10) OVER {_ORDER})")
    s.varying("dma", "close", "k", 0)
    s.add(path10="sum(path) OVER (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING)")
    s.add(q="pow(CASE WHEN path10 > 1e-8 THEN far / path10 ELSE 0 END * (2e0 / 3 - 2e0 / 31) + 2e0 / 31, 2)")
    s.varying("kama", "close", "q", 9)
    for a, b, n in (("a1", "close", 10), ("a2", "a1", 10), ("a3", "a2", 10), ("t1", "close", 9), ("t2", "t1", 9), ("t3", "t2", 9)):
        s.ema(a, b, n)
    s.add(t0=f"lag(t3) OVER {_ORDER}")
    return s.sql(f_ema="e12", f_sma="sma", f_rma="rma", f_dma="dma", f_dema="2 * a1 - a2", f_tema="3 * a1 - 3 * a2 + a3", f_trix="(t3 - t0) / t0 * 100", f_kama="CASE WHEN i >= 10 THEN kama END")


def _rsi(s: Sheet, name: str, n: int) -> None:
    s.add(**{f"{name}_d": f"close - lag(close) OVER {_ORDER}"})
    s.add(**{f"{name}_u": f"greatest({name}_d, 0e0) + 0 * {name}_d", f"{name}_v": f"greatest(-{name}_d, 0e0) + 0 * {name}_d"})
    s.rma(f"{name}_g", f"{name}_u", n)
    s.rma(f"{name}_l", f"{name}_v", n)
    s.add(**{name: f"CASE WHEN {name}_g + {name}_l > 1e-8 THEN 100 * {name}_g / ({name}_g + {name}_l) WHEN {name}_g IS NOT NULL THEN 0 END"})


def _macd(s: Sheet, fast: int, slow: int, signal: int) -> None:
    """The fast average starts so late that both begin at one bar."""
    s.add(late=f"CASE WHEN i >= {slow - fast} THEN close END")
    s.ema("quick", "late", fast)
    s.ema("slow", "close", slow)
    s.add(line="quick - slow")
    s.ema("signal", "line", signal)
    s.add(shown=f"CASE WHEN i >= {slow + signal - 2} THEN line END")


def _kdj(s: Sheet, n: int, m1: int, m2: int) -> None:
    w = f"OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING)"
    s.add(hi=f"max(high) {w}", lo=f"min(low) {w}")
    s.add(raw=f"CASE WHEN i >= {n - 1} THEN CASE WHEN hi - lo > 1e-8 THEN (close - lo) / (hi - lo) * 100 ELSE 50 END END")
    s.linear("kk", "raw", f"(1 - 1e0 / {m1})", f"(1e0 / {m1})", 1, "50e0", 1)
    s.add(k=f"CASE WHEN i >= {n - 1} THEN kk END")
    s.linear("dd", "k", f"(1 - 1e0 / {m2})", f"(1e0 / {m2})", 1, "50e0", 1)
    s.add(d=f"CASE WHEN i >= {n - 1} THEN dd END")


def oscillators() -> str:
    s = Sheet()
    _rsi(s, "rsi", 14)
    _macd(s, 12, 26, 9)
    _kdj(s, 9, 3, 3)
    return s.sql(f_rsi="rsi", f_macd="shown", f_signal="signal", f_hist="shown - signal", f_k="k", f_d="d", f_j="3 * k - 2 * d")


def _dmi(s: Sheet, n: int) -> None:
    s.add(h1=f"lag(high) OVER {_ORDER}", l1=f"lag(low) OVER {_ORDER}", c1=f"lag(close) OVER {_ORDER}")
    s.add(tr="greatest(high, c1) - least(low, c1) + 0 * c1", up="high - h1", dn="l1 - low")
    s.add(pdm="CASE WHEN up > dn AND up > 0 THEN up ELSE 0 * up END", mdm="CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 * dn END")
    for x, y in (("pdm", "ps"), ("mdm", "ms"), ("tr", "ts_")):
        s.linear(y, x, f"(1 - 1e0 / {n})", "1e0", n - 1, "sum(x)")
    s.add(pdi=f"CASE WHEN i >= {n} THEN CASE WHEN ts_ > 1e-8 THEN 100 * ps / ts_ ELSE 0 END END", mdi=f"CASE WHEN i >= {n} THEN CASE WHEN ts_ > 1e-8 THEN 100 * ms / ts_ ELSE 0 END END")
    s.add(dx="CASE WHEN pdi + mdi > 1e-8 THEN 100 * abs(pdi - mdi) / (pdi + mdi) WHEN pdi IS NOT NULL THEN 0 END")
    s.rma("adx", "dx", n)


def trend() -> str:
    s = Sheet()
    _dmi(s, 14)
    s.rma("atr", "tr", 14)
    s.add(h2=f"lead(high) OVER {_ORDER}", l2=f"lead(low) OVER {_ORDER}", v1=f"lag(volume) OVER {_ORDER}")
    s.add(lh="CASE WHEN i = 1 THEN high ELSE h1 END", ll="CASE WHEN i = 1 THEN low ELSE l1 END", falls="low - l2 > h2 - high AND low - l2 > 0")
    flip = "(z.up AND r.low <= z.stop OR NOT z.up AND r.high >= z.stop)"
    turn = "CASE WHEN z.up THEN greatest(z.best, r.lh, r.high) ELSE least(z.best, r.ll, r.low) END"
    best = f"CASE WHEN {flip} THEN CASE WHEN z.up THEN r.low ELSE r.high END WHEN z.up THEN greatest(z.best, r.high) ELSE least(z.best, r.low) END"
    af = f"CASE WHEN {flip} THEN 0.02e0 WHEN z.up AND r.high > z.best OR NOT z.up AND r.low < z.best THEN least(0.2e0, z.af + 0.02e0) ELSE z.af END"
    out = f"CASE WHEN {flip} THEN {turn} ELSE z.stop END"
    moved = f"({out}) + ({af}) * (({best}) - ({out}))"
    s.states(
        {"up": "NOT falls", "stop": "CASE WHEN falls THEN high ELSE low END", "best": "CASE WHEN falls THEN l2 ELSE h2 END", "af": "0.02e0", "sar": "CAST(NULL AS double)", "nvi": "1e3", "pvi": "1e3"},
        {
            "up": f"z.up <> {flip}", "best": best, "af": af, "sar": out,
            "stop": f"CASE WHEN z.up <> {flip} THEN least({moved}, r.ll, r.low) ELSE greatest({moved}, r.lh, r.high) END",
            "nvi": "CASE WHEN r.volume < r.v1 AND abs(r.c1) > 1e-8 THEN z.nvi + (r.close - r.c1) / r.c1 * z.nvi ELSE z.nvi END",
            "pvi": "CASE WHEN r.volume > r.v1 AND abs(r.c1) > 1e-8 THEN z.pvi + (r.close - r.c1) / r.c1 * z.pvi ELSE z.pvi END",
        },
        sar="sar", nvi="nvi", pvi="pvi",
    )
    return s.sql(f_atr="atr", f_adx="adx", f_plus="pdi", f_minus="mdi", f_sar="sar", f_nvi="nvi", f_pvi="pvi")


def nested() -> str:
    s = Sheet()
    s.ema("a", "close", 12)
    s.ema("z", "close", 26)
    s.add(dif="a - z")
    s.ema("dea", "dif", 9)
    _rsi(s, "r", 6)
    s.add(dif1=f"lag(dif) OVER {_ORDER}", dea1=f"lag(dea) OVER {_ORDER}", n5="count(r) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING)", m5="avg(r) OVER (PARTITION BY symbol ORDER BY i ROWS 4 PRECEDING)")
    return s.sql(bar="2 * (dif - dea)", gold="CASE WHEN dif1 <= dea1 AND dif > dea THEN 1 ELSE 0 END", smooth="CASE WHEN n5 = 5 THEN m5 END")


def aliases() -> str:
    s = Sheet()
    _macd(s, 12, 26, 9)
    _kdj(s, 9, 3, 3)
    s.add(flow="CASE WHEN high - low > 1e-8 THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume", span="high - low")
    s.add(ad=f"sum(flow) OVER {_ORDER}")
    s.linear("ad3", "ad", "5e-1", "5e-1", 1)
    s.linear("ad10", "ad", "(9e0 / 11)", "(2e0 / 11)", 1)
    for name, x, n in (("e12", "close", 12), ("e13", "close", 13), ("e5", "close", 5), ("e10", "close", 10), ("e20", "close", 20), ("v12", "volume", 12), ("v26", "volume", 26), ("r10", "span", 10), ("m1", "span", 9), ("m2", "m1", 9)):
        s.ema(name, x, n)
    s.add(r0=f"lag(r10, 10) OVER {_ORDER}", ratio="CASE WHEN abs(m2) >= 1e-15 THEN m1 / m2 END")
    w = "OVER (PARTITION BY symbol ORDER BY i ROWS 24 PRECEDING)"
    s.add(mass=f"CASE WHEN count(ratio) {w} = 25 THEN sum(ratio) {w} END")
    align = "CASE WHEN e5 > e10 AND e10 > e20 THEN 1 WHEN e5 < e10 AND e10 < e20 THEN -1 ELSE 0 END"
    return s.sql(
        f_e1="e12", f_e2="e12", f_m1="shown", f_m2="signal", f_k="k", f_ad="CASE WHEN i >= 9 THEN ad3 - ad10 END", f_diff="e12 - slow", f_eri="high - e13", f_erib="high - e13", f_erir="low - e13",
        f_pvo="CASE WHEN v26 = 0 THEN 0 ELSE 100 * (v12 - v26) / v26 END", f_cvi="CASE WHEN r0 = 0 THEN 0 ELSE 100 * (r10 - r0) / r0 END", f_massi="mass", f_align=align, f_align2=align, f_align3=align,
    )


def movement() -> str:
    s = Sheet()
    _dmi(s, 14)
    _kdj(s, 9, 3, 3)
    w = "OVER (PARTITION BY symbol ORDER BY i ROWS 12 PRECEDING)"
    s.add(typ="(high + low + close) / 3", tr10="CASE WHEN i >= 10 THEN tr END", hc="(open + high + low + close) / 4", top=f"max(high) {w}", bottom=f"min(low) {w}", fires="CASE WHEN close > open THEN 1 ELSE 0 END")
    s.ema("mid", "typ", 20)
    s.rma("band", "tr10", 10)
    s.add(ho_=f"CASE WHEN i = 0 THEN (open + close) / 2 ELSE lag(hc) OVER {_ORDER} END", num="CASE WHEN i >= 12 THEN close - (top + bottom) / 2 END", den="CASE WHEN i >= 12 THEN top - bottom END")
    s.linear("ho", "ho_", "5e-1", "5e-1", 1)
    for a, b, n in (("n1", "num", 25), ("n2", "n1", 2), ("d1", "den", 25), ("d2", "d1", 2)):
        s.ema(a, b, n)
    s.add(smi="CASE WHEN d2 = 0 THEN 0 ELSE 100 * n2 / (d2 / 2) END")
    s.ema("smis", "smi", 9)
    free = "(r.fires = 1 AND r.i - z.last >= 5)"
    s.states({"last": "CASE WHEN fires = 1 THEN 0 ELSE -1000000 END", "hit": "fires"}, {"last": f"CASE WHEN {free} THEN r.i ELSE z.last END", "hit": f"CASE WHEN {free} THEN 1 ELSE 0 END"}, hit="hit")
    return s.sql(
        f_kc="mid + 2 * band", f_kcm="CASE WHEN i >= 19 THEN mid END", f_kcl="mid - 2 * band", f_dmi="adx", f_pdi="pdi", f_mdi="mdi", f_dx="dx", f_kd="k", f_ha="hc", f_hac="hc", f_has="hc", f_hao="ho",
        f_hah="greatest(high, ho, hc)", f_hal="least(low, ho, hc)", f_smi="smi", f_smis="smis", f_filter="hit",
    )


def oracle_sql() -> dict[str, str]:
    return {
        "fn_recursive_averages": averages(), "fn_recursive_oscillators": oscillators(), "fn_recursive_trend": trend(), "formula_recursive_nested": nested(), "fn_recursive_aliases": aliases(),
        "fn_recursive_movement": movement(),
    }
