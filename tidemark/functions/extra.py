"""More formula functions: bands, fractals, directional movement, screens, positions in windows, and host series.

The same conventions as in ``library``: NULL is the missing value, texts are read by both dialects.
Host series (index quotes, capital, order flow, fundamentals by number) are columns of the bars by the
names below; where the bars have no such column they are NULL.
"""

from __future__ import annotations

from tidemark.functions.library import _CS, _terms, true_range
from tidemark.functions.registry import function

# -- bands -------------------------------------------------------------------------------------------


def _accbands(name: str, text: str) -> None:
    @function(name, "W", (3, 4))
    def emit(c, h, low, cl, n=None):
        f = c.col(c.join(f"CASE WHEN ({h.text}) + ({low.text}) <> 0 THEN 4e0 * (({h.text}) - ({low.text})) / (({h.text}) + ({low.text})) ELSE 0e0 END", h, low))
        x = c.join(text.format(h=f"({h.text})", l=f"({low.text})", c=f"({cl.text})", f=f.text), h, low, cl, f)
        return c.call("MA", [c.col(x), n or c.number(20)])


_accbands("ACCBANDS", "{h} * (1e0 + {f})")
_accbands("ACCBANDS_MID", "{c}")
_accbands("ACCBANDS_LOWER", "{l} * (1e0 - {f})")


def _eri(name: str, high: bool, aliases: tuple[str, ...] = ()) -> None:
    @function(name, "R", (3, 4), aliases)
    def emit(c, h, low, cl, n=None):
        e, x = c.call("EMA", [cl, n or c.number(13)]), h if high else low
        return c.join(f"({x.text}) - {e.text}", x, e)


_eri("ERI", True, ("ERI_BULL",))
_eri("ERI_BEAR", False)


def _keltner(name: str, sign: int) -> None:
    """EMA of the typical price and Wilder's average range, both from the bar where the longer of them starts."""

    @function(name, "R", (3, 6))
    def emit(c, h, low, cl, n=None, m=None, k=None):
        p, q = c.int(n) if n else 20, c.int(m) if m else 10
        first = max(p - 1, q)
        at = c.col(f"row_number() OVER (PARTITION BY {c.KEYS} ORDER BY ts)")
        mid = c.call("EMA", [c.col(c.call("TYPPRICE", [h, low, cl])), c.number(p)])
        tr = true_range(c, h, low, cl, False)
        seeded = c.col(c.join(f"CASE WHEN {at.text} > {first + 1 - q} THEN {tr.text} END", at, tr))
        band = c.call("RMA", [seeded, c.number(q)])
        width = f"{sign}e0 * {k.text if k else '2e0'} * {band.text}" if sign else "0e0"
        return c.join(f"CASE WHEN {at.text} > {first} THEN {mid.text} + {width} END", at, mid, band)


_keltner("KC", 1)
_keltner("KC_MID", 0)
_keltner("KC_LOWER", -1)

# -- fractals and extremes about a bar -------------------------------------------------------------------


def _fractal(name: str, high: bool, aliases: tuple[str, ...] = ()) -> None:
    """100 where the bar ``right`` bars ago stands out strictly from ``left`` bars before and ``right`` after it."""

    @function(name, "L", (2, 4), aliases)
    def emit(c, h, low, left=None, right=None):
        a, b = c.int(left) if left else 2, c.int(right) if right else 2
        x = c.col(h if high else low)
        terms = [c.col(c.lag(x, i)) for i in range(a + b + 1)]
        pivot, rest = terms[b], [t for i, t in enumerate(terms) if i != b]
        sign = ">" if high else "<"
        test = " AND ".join(f"{pivot.text} {sign} {t.text}" for t in rest)
        return c.join(f"CASE WHEN {terms[-1].text} IS NULL THEN NULL WHEN {test} THEN 1e2 ELSE 0e0 END", *terms)


_fractal("FRACTAL", True, ("FRACTAL_HIGH",))
_fractal("FRACTAL_LOW", False)


def _find(name: str, sign: str) -> None:
    """1 where x beats its neighbours up to m bars away strictly; once n bars stand, those before it alone."""

    @function(name, "L", 4, causal=False)
    def emit(c, x, n, m, t):
        k, far = c.int(n), c.int(m)
        x = c.col(x)
        at = c.col(f"row_number() OVER (PARTITION BY {c.KEYS} ORDER BY ts)")
        near = range(1, min(far, k - 1) + 1)
        back = [c.col(c.lag(x, i)) for i in near]
        ahead = [c.col(c.lag(x, -i)) for i in near]
        tests = [f"coalesce({b.text} {sign} {x.text}, false)" for b in back]
        tests += [f"({at.text} + {i} <= {k} AND coalesce({a.text} {sign} {x.text}, false))" for i, a in zip(near, ahead, strict=True)]
        return c.join(f"CASE WHEN {x.text} IS NULL OR {' OR '.join(tests) or 'false'} THEN 0e0 ELSE 1e0 END", x, at, *back, *ahead)


_find("FINDHIGH", ">=")
_find("FINDLOW", "<=")


@function("BACKSET", "W", 2, causal=False)
def _backset(c, x, n):
    on = c.col(c.flag(f"({x.text}) > 0", x))
    return c.join(f"max({on.text}) {c.frame('CURRENT ROW', f'{max(1, c.int(n)) - 1} FOLLOWING')}", on, over=True)


@function("BARSSINCEN", "G", 2)
def _barssincen(c, x, n):
    on = c.col(c.join(f"CASE WHEN ({x.text}) IS NOT NULL AND ({x.text}) <> 0 THEN 1e0 ELSE 0e0 END", x))
    seen = c.col(c.join(f"sum({on.text}) {c.frame('UNBOUNDED PRECEDING')}", on, over=True))
    return c.call("BARSSINCE", [c.col(c.flag(f"{on.text} > 0 AND {seen.text} >= {c.int(n)}", on, seen))])


@function("BARSTATUS", "X", 0, causal=False)
def _barstatus(c):
    order = f"OVER (PARTITION BY {c.KEYS} ORDER BY ts)"
    return c.col(c.join(f"CASE WHEN lead(ts) {order} IS NULL THEN 2e0 WHEN lag(ts) {order} IS NULL THEN 1e0 ELSE 0e0 END", over=True))


@function("REFDATE", "X", 2, causal=False)
def _refdate(c, x, i):
    x = c.col(x)
    at = c.col(f"row_number() OVER (PARTITION BY {c.KEYS} ORDER BY ts)")
    own = c.col(c.join(f"CASE WHEN {at.text} = {c.int(i) + 1} THEN {x.text} END", at, x))
    return c.join(f"max({own.text}) {c.whole()}", own, over=True)


@function("PERIODTYPE", "E", 0)
def _periodtype(c):
    return c.join("CASE timeframe WHEN 'D1' THEN 0e0 WHEN 'W1' THEN 1e0 WHEN 'MN1' THEN 2e0 ELSE 3e0 END")


# -- positions in windows ---------------------------------------------------------------------------------


@function("PERCENTRANK", "A", (1, 2))
def _percentrank(c, x, n=None):
    """Share of the n bars before that lie below, in hundredths."""
    x, k = c.col(x), c.int(n) if n else 100
    before = [c.col(c.lag(x, i)) for i in range(1, k + 1)]
    less = " + ".join(f"CASE WHEN {t.text} < {x.text} THEN 1e0 ELSE 0e0 END" for t in before)
    ok = c.col(c.join(f"count({x.text}) {c.last(k + 1)}", x, over=True))
    return c.join(f"CASE WHEN {ok.text} = {k + 1} THEN 1e2 * ({less}) / {k}e0 END", x, ok, *before)


@function("SORT", "A", 3)
def _sort(c, x, n, way):
    """Place of x, from 1, among the values of its window in ascending (1) or descending order; the first of equal ones."""
    x, k, terms = _terms(c, x, n)
    sign = "<" if way.const == 1 else ">"
    ahead = " + ".join(f"CASE WHEN {t.text} {sign} {x.text} THEN 1e0 ELSE 0e0 END" for t in terms)
    ok = c.col(c.join(f"count({x.text}) {c.last(k)}", x, over=True))
    return c.join(f"CASE WHEN {ok.text} = {k} THEN 1e0 + {ahead} END", x, ok, *terms)


@function("PERCENTILE", "A", 3)
def _percentile(c, x, n, p):
    """The value at the nearest place to p hundredths of the sorted window, halves up."""
    k = c.int(n)
    at = int(p.const / 100 * (k - 1) + 0.5)
    return c.call("QUANTILE", [x, n, c.number(min(at, k - 1) / max(1, k - 1))])


@function("MINMAXINDEX", "A", 2)
def _minmaxindex(c, x, n):
    return c.call("MININDEX", [x, n])


@function("BETA", "W", 3)
def _beta(c, x, y, n):
    """Covariance with y over the variance of y, in full windows of pairs."""
    k = c.int(n)
    x, y = c.col(x), c.col(y)
    both = c.col(c.join(f"CASE WHEN {x.text} IS NOT NULL AND {y.text} IS NOT NULL THEN 1 END", x, y))
    w = c.last(k)
    return c.join(f"CASE WHEN count({both.text}) {w} = {k} AND var_pop({y.text}) {w} > 1e-12 THEN covar_pop({x.text}, {y.text}) {w} / var_pop({y.text}) {w} END", x, y, both, over=True)


# -- candles, movement, momentum ------------------------------------------------------------------------------


def _heikin(name: str, part: str, aliases: tuple[str, ...] = ()) -> None:
    @function(name, "R", 4, aliases)
    def emit(c, o, h, low, cl):
        a, b = c.call("HEIKIN_OPEN", [o, h, low, cl]), c.call("HEIKIN_CLOSE", [o, h, low, cl])
        if part in "oc":
            return a if part == "o" else b
        x, f = (h, "greatest") if part == "h" else (low, "least")
        return c.join(f"{f}({x.text}, {a.text}, {b.text})", x, a, b)


_heikin("HA", "c", ("HA_CLOSE", "HEIKIN_ASHI"))
_heikin("HA_OPEN", "o")
_heikin("HA_HIGH", "h")
_heikin("HA_LOW", "l")


def _movement(name: str, up: bool) -> None:
    """The larger of the two moves of a bar, where it is this one and positive."""

    @function(name, "L", 2)
    def emit(c, h, low):
        h, low = c.col(h), c.col(low)
        h1, l1 = c.col(c.lag(h, 1)), c.col(c.lag(low, 1))
        a, b = f"({h.text} - {h1.text})", f"({l1.text} - {low.text})"
        a, b = (a, b) if up else (b, a)
        return c.join(f"CASE WHEN {a} > 0 AND {a} > {b} THEN {a} ELSE 0e0 END", h, low, h1, l1)


_movement("PLUS_DM", True)
_movement("MINUS_DM", False)


@function("DX", "R", (3, 4))
def _dx(c, h, low, cl, n=None):
    return c.kernel("dmi", [h, low, cl], float(c.int(n) if n else 14), part=3)


def _same(name: str, other: str, kind: str, args: tuple[int, int]) -> None:
    @function(name, kind, args)
    def emit(c, *xs):
        return c.call(other, list(xs))


for _name, _other, _least, _most in (
    ("DMI", "ADX", 3, 4), ("PDI", "PLUS_DI", 3, 4), ("MDI", "MINUS_DI", 3, 4), ("KD", "KDJ", 3, 6), ("SUPERTREND_LINE", "SUPERTREND", 3, 5), ("MASSI", "MASS", 2, 4),
):
    _same(_name, _other, "R", (_least, _most))


@function("CMOU", "W", (1, 2))
def _cmou(c, x, n=None):
    return c.call("CMO", [x, n or c.number(14)])


@function("DIFF", "R", 3)
def _diff(c, x, a, b):
    p, q = c.call("EMA", [x, a]), c.call("EMA", [x, b])
    return c.join(f"{p.text} - {q.text}", p, q)


@function("PVO", "R", (1, 4))
def _pvo(c, v, a=None, b=None, kind=None):
    p, q = c.call("EMA", [v, a or c.number(12)]), c.call("EMA", [v, b or c.number(26)])
    return c.join(f"CASE WHEN {q.text} = 0 THEN 0e0 ELSE 1e2 * ({p.text} - {q.text}) / {q.text} END", p, q)


@function("CVI", "R", (2, 4))
def _cvi(c, h, low, n=None, m=None):
    e = c.call("EMA", [c.join(f"({h.text}) - ({low.text})", h, low), n or c.number(10)])
    b = c.col(c.lag(e, c.int(m) if m else 10))
    return c.join(f"CASE WHEN {b.text} = 0 THEN 0e0 ELSE 1e2 * ({e.text} - {b.text}) / {b.text} END", e, b)


def _smi(c, h, low, cl, n, a, b):
    hi, lo = c.col(c.call("HHV", [h, n or c.number(13)])), c.col(c.call("LLV", [low, n or c.number(13)]))
    parts = [c.join(f"({cl.text}) - ({hi.text} + {lo.text}) * 5e-1", cl, hi, lo), c.join(f"{hi.text} - {lo.text}", hi, lo)]
    x, y = (c.call("EMA", [c.call("EMA", [p, b or c.number(25)]), a or c.number(2)]) for p in parts)
    return c.join(f"CASE WHEN {y.text} = 0 THEN 0e0 ELSE 1e2 * {x.text} / ({y.text} * 5e-1) END", x, y)


@function("SMI", "R", (3, 7))
def _smi_line(c, h, low, cl, n=None, a=None, b=None, s=None):
    return _smi(c, h, low, cl, n, a, b)


@function("SMI_SIGNAL", "R", (3, 7))
def _smi_signal(c, h, low, cl, n=None, a=None, b=None, s=None):
    return c.call("EMA", [_smi(c, h, low, cl, n, a, b), s or c.number(9)])


# -- screens and flows ------------------------------------------------------------------------------------------


@function("MA_ALIGN", "R", 4, ("MA_ALIGNMENT", "TREND_ALIGN"))
def _ma_align(c, x, a, b, d):
    p, q, r = (c.call("EMA", [x, n]) for n in (a, b, d))
    return c.join(f"CASE WHEN {p.text} > {q.text} AND {q.text} > {r.text} THEN 1e0 WHEN {p.text} < {q.text} AND {q.text} < {r.text} THEN -1e0 ELSE 0e0 END", p, q, r)


@function("GAP_SIGNAL", "L", (2, 3), ("GAP",))
def _gap(c, o, cl, th=None):
    b, t = c.col(c.lag(c.col(cl), 1)), th.text if th else "2e-2"
    g = c.col(c.join(f"CASE WHEN abs({b.text}) > 2.220446049250313e-16 THEN ({o.text}) / {b.text} - 1e0 END", o, b))
    return c.join(f"CASE WHEN {g.text} >= {t} THEN 1e0 WHEN {g.text} <= -({t}) THEN -1e0 ELSE 0e0 END", g)


@function("TREND_BREAKOUT", "R", (8, 9), ("BREAKOUT_SCREEN", "TREND_SCREEN"))
def _trend_breakout(c, h, low, cl, v, a, b, n, m, k=None):
    p, q = c.call("EMA", [cl, a]), c.call("EMA", [cl, b])
    up, dn = c.col(c.call("BREAKOUT", [cl, h, n])), c.col(c.call("BREAKDOWN", [cl, low, n]))
    s = c.col(c.call("VOLUME_SURGE", [v, m, k or c.number(1.5)]))
    x = f"({cl.text})"
    return c.join(
        f"CASE WHEN {p.text} IS NULL OR {q.text} IS NULL OR {s.text} = 0 THEN 0e0 WHEN {up.text} > 0 AND {x} > {p.text} AND {p.text} > {q.text} THEN 1e0 "
        f"WHEN {dn.text} > 0 AND {x} < {p.text} AND {p.text} < {q.text} THEN -1e0 ELSE 0e0 END", cl, p, q, up, dn, s,
    )


@function("RS_RATIO", "L", (2, 3))
def _rs_ratio(c, x, b, n=None):
    x, b = c.col(x), c.col(b)
    k = c.int(n) if n else 20
    x0, b0 = c.col(c.lag(x, k)), c.col(c.lag(b, k))
    return c.join(f"CASE WHEN {x0.text} <> 0 AND {b0.text} <> 0 AND abs({b.text} / {b0.text}) >= 1e-8 THEN ({x.text} / {x0.text}) / ({b.text} / {b0.text}) END", x, b, x0, b0)


@function("TURNOVER", "E", 2)
def _turnover(c, v, shares):
    return c.join(f"CASE WHEN ({shares.text}) > 0 THEN ({v.text}) / ({shares.text}) END", v, shares)


@function("MONEY_FLOW", "W", (4, 5))
def _money_flow(c, h, low, cl, v, n=None):
    t = c.call("TYPPRICE", [h, low, cl])
    return c.call("SUM", [c.col(c.join(f"({t.text}) * ({v.text})", t, v)), n or c.number(14)])


@function("CS_INDNEUTRALIZE", "C", 2)
def _indneutralize(c, x, group):
    x, group = c.col(x), c.col(group)
    m = c.col(c.join(f"avg({x.text}) OVER ({_CS}, {group.text})", x, group, over=True))
    return c.join(f"({x.text} - {m.text})", x, m)


@function("FILTER", "R", 2)
def _filter(c, x, n):
    """A signal, then none for n bars."""
    on = c.col(c.flag(f"({x.text}) > 0", x))
    return c.kernel("quiet", [on], float(c.int(n)))


# -- host series ---------------------------------------------------------------------------------------------------

#: Function and the column of the bars that holds it.
HOST = {
    "INDEXO": "index_open", "INDEXH": "index_high", "INDEXL": "index_low", "INDEXC": "index_close", "INDEXV": "index_volume", "INDEXA": "index_amount",
    "CAPITAL": "capital", "BIGORDER": "bigorder", "SMALLORDER": "smallorder", "SUPERBIGORDER": "superbigorder", "MAININFLOW": "maininflow", "MAININFLOWPCT": "maininflowpct",
    "MONEYFLOW": "moneyflow", "NETINFLOW": "netinflow", "EM_ZLCCV": "em_zlccv",
}


def _host_column(c, name: str):
    return c.join(f"CAST({name} AS double)") if name in c.columns else c.join("CAST(NULL AS double)")


def _host(name: str, column: str) -> None:
    @function(name, "E", 0)
    def emit(c):
        return c.col(_host_column(c, column))


for _name, _column in HOST.items():
    _host(_name, _column)


def _numbered(name: str) -> None:
    @function(name, "E", 1)
    def emit(c, i):
        return c.col(_host_column(c, f"{name.lower()}_{c.int(i, 'a field number')}"))


for _name in ("FINANCE", "DYNAINFO", "BLOCKAVG", "BLOCKINDEX"):
    _numbered(_name)


@function("DKCOL", "E", 0)
def _dkcol(c):
    a, b = _host_column(c, "buyvol"), _host_column(c, "sellvol")
    return c.col(c.join(f"{a.text} - {b.text}", a, b))


@function("BARVWAP", "E", 0)
def _barvwap(c):
    """The volume-weighted price of each bar: the column vwap, or the typical price where the bars have none."""
    if "vwap" in c.columns:
        return c.col(_host_column(c, "vwap"))
    return c.col(c.call("TYPPRICE", [c.name("H"), c.name("L"), c.name("C")]))
