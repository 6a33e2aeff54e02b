"""Formula functions that are Catalyst expressions: elementwise, lags, windows, expanding, islands, arrays, cross-sections.

NULL is the missing value. ``full(n)`` windows give NULL until n values stand in the frame. Comparisons
with NULL are false. Divisions by less than 1e-15 give NULL.
"""

from __future__ import annotations

import math

from tidemark.functions.registry import function

# -- elementwise ------------------------------------------------------------------------------------


def _unary(name: str, text: str, aliases: tuple[str, ...] = ()) -> None:
    @function(name, "E", 1, aliases)
    def emit(c, x):
        return c.join(text.format(x=f"({x.text})"), x)


for _name, _text in (
    ("ABS", "abs({x})"), ("SIN", "sin({x})"), ("COS", "cos({x})"), ("TAN", "tan({x})"), ("ATAN", "atan({x})"), ("EXP", "exp({x})"),
    ("SINH", "((exp({x}) - exp(-{x})) / 2e0)"), ("COSH", "((exp({x}) + exp(-{x})) / 2e0)"), ("TANH", "tanh({x})"),
    ("SIGN", "CAST(sign({x}) AS double)"), ("CEIL", "CAST(ceil({x}) AS double)"), ("FLOOR", "CAST(floor({x}) AS double)"),
    ("ACOS", "CASE WHEN abs({x}) <= 1e0 THEN acos({x}) END"), ("ASIN", "CASE WHEN abs({x}) <= 1e0 THEN asin({x}) END"),
    ("SQRT", "CASE WHEN {x} >= 0 THEN sqrt({x}) END"), ("LN", "CASE WHEN {x} > 0 THEN ln({x}) END"), ("LOG", "CASE WHEN {x} > 0 THEN ln({x}) END"),
    ("LOG10", "CASE WHEN {x} > 0 THEN log10({x}) END"), ("ROUND", "(CAST(sign({x}) AS double) * floor(abs({x}) + 5e-1))"),
    ("INTPART", "CASE WHEN {x} >= 0 THEN CAST(floor({x}) AS double) ELSE CAST(ceil({x}) AS double) END"),
    ("FRACPART", "({x} - CASE WHEN {x} >= 0 THEN floor({x}) ELSE ceil({x}) END)"),
    ("NOT", "CASE WHEN {x} > 0 THEN 0e0 ELSE 1e0 END"), ("ISNA", "CASE WHEN {x} IS NULL THEN 1e0 ELSE 0e0 END"),
):
    _unary(_name, _text)


def _binary(name: str, text: str, aliases: tuple[str, ...] = ()) -> None:
    @function(name, "E", 2, aliases)
    def emit(c, a, b):
        return c.join(text.format(a=f"({a.text})", b=f"({b.text})"), a, b)


_binary("ADD", "({a} + {b})")
_binary("SUB", "({a} - {b})")
_binary("MULT", "({a} * {b})")
_binary("MAX", "CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE greatest({a}, {b}) END")
_binary("MIN", "CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE least({a}, {b}) END")
_binary("POW", "power({a}, {b})", ("CS_POWER",))
_binary("CS_SIGNED_POWER", "(sign({a}) * power(abs({a}), {b}))")
_binary("IFTHEN", "CASE WHEN {a} > 0 THEN {b} ELSE 0e0 END")


@function("DIV", "E", 2)
def _div(c, a, b):
    return c.div(a, b)


@function("MOD", "E", 2)
def _mod(c, a, b):
    q = c.col(c.div(a, b))
    return c.join(f"(({a.text}) - (CASE WHEN {q.text} >= 0 THEN floor({q.text}) ELSE ceil({q.text}) END) * ({b.text}))", a, b, q)


@function("CEILING", "E", 2)
def _ceiling(c, a, p):
    q = c.col(c.div(a, p))
    return c.join(f"(ceil({q.text}) * ({p.text}))", q, p)


@function("IF", "E", 3, ("IFF",))
def _if(c, t, a, b):
    return c.join(f"CASE WHEN ({t.text}) IS NULL OR ({t.text}) <> 0 THEN ({a.text}) ELSE ({b.text}) END", t, a, b)


@function("BETWEEN", "E", 3)
def _between(c, x, a, b):
    return c.flag(f"({x.text}) >= least(({a.text}), ({b.text})) AND ({x.text}) <= greatest(({a.text}), ({b.text}))", x, a, b)


@function("RANGE", "E", 3)
def _range(c, x, a, b):
    return c.flag(f"({x.text}) > ({a.text}) AND ({x.text}) < ({b.text})", x, a, b)


@function("AVG", "E", (1, 16), ("MATH_AVG",))
def _avg(c, *xs):
    return c.join(f"(({' + '.join(f'({x.text})' for x in xs)}) / {len(xs)}e0)", *xs)


@function("AVGPRICE", "E", 4)
def _avgprice(c, o, h, low, cl):
    return c.join(f"(({o.text} + {h.text} + {low.text} + {cl.text}) / 4e0)", o, h, low, cl)


@function("MEDPRICE", "E", 2)
def _medprice(c, h, low):
    return c.join(f"(({h.text} + {low.text}) / 2e0)", h, low)


@function("TYPPRICE", "E", 3)
def _typprice(c, h, low, cl):
    return c.join(f"(({h.text} + {low.text} + {cl.text}) / 3e0)", h, low, cl)


@function("WCLPRICE", "E", 3)
def _wclprice(c, h, low, cl):
    return c.join(f"(({h.text} + {low.text} + 2e0 * {cl.text}) / 4e0)", h, low, cl)


@function("BOP", "E", 4)
def _bop(c, o, h, low, cl):
    return c.join(f"CASE WHEN ({h.text}) - ({low.text}) <= 1e-8 THEN 0e0 ELSE (({cl.text}) - ({o.text})) / (({h.text}) - ({low.text})) END", o, h, low, cl)


@function("MARKETFI", "E", 3)
def _marketfi(c, h, low, v):
    return c.div(c.join(f"({h.text}) - ({low.text})", h, low), v)


@function("DRAWNULL", "E", 0)
def _drawnull(c):
    return c.join("CAST(NULL AS double)")


for _name, _text in (
    ("YEAR", "year(ts)"), ("MONTH", "month(ts)"), ("DAY", "day(ts)"), ("HOUR", "hour(ts)"), ("MINUTE", "minute(ts)"),
    ("DATE", "((year(ts) - 1900) * 10000 + month(ts) * 100 + day(ts))"), ("TIME", "(hour(ts) * 100 + minute(ts))"),
    ("FROMOPEN", "greatest(0, (hour(ts) - 9) * 60 + minute(ts) - 30)"),
):

    def _clock(text):
        return lambda c: c.join(f"CAST({text} AS double)")

    function(_name, "E", 0)(_clock(_text))


@function("WEEKDAY", "E", 0)
def _weekday(c):
    return c.join("CAST(dayofweek(ts) - 1 AS double)" if c.dialect == "spark" else "CAST(dayofweek(ts) AS double)")


# -- lags -------------------------------------------------------------------------------------------


@function("REF", "L", 2, ("SHIFT",))
def _ref(c, x, n):
    return c.lag(x, c.int(n))


@function("REFX", "L", 2, causal=False)
def _refx(c, x, n):
    return c.lag(x, -c.int(n))


for _name, _col in (("OPEN1", "open"), ("HIGH1", "high"), ("LOW1", "low"), ("CLOSE1", "close"), ("VOL1", "volume")):

    def _previous(column):
        return lambda c: c.lag(c.join(column), 1)

    function(_name, "L", 0)(_previous(_col))


@function("MOM", "L", 2, ("MTM", "MOMENTUM", "MINUS"))
def _mom(c, x, n):
    x = c.col(x)
    p = c.lag(x, c.int(n))
    return c.join(f"({x.text} - {p.text})", x, p)


def _change(name: str, text: str, eps: str) -> None:
    @function(name, "L", 2)
    def emit(c, x, n):
        x = c.col(x)
        p = c.col(c.lag(x, c.int(n)))
        return c.join(f"CASE WHEN abs({p.text}) > {eps} THEN {text.format(x=x.text, p=p.text)} END", x, p)


_change("ROC", "({x} - {p}) / {p} * 100e0", "1e-15")
_change("ROCP", "({x} - {p}) / {p}", "1e-15")
_change("ROCR", "{x} / {p}", "1e-15")
_change("ROCR100", "{x} / {p} * 100e0", "1e-15")


def _crossing(up: bool):
    a1, now = ("<=", ">") if up else (">=", "<")

    def emit(c, a, b):
        a, b = c.col(a), c.col(b)
        pa, pb = c.col(c.lag(a, 1)) if a.const is None else a, c.col(c.lag(b, 1)) if b.const is None else b
        return c.flag(f"{pa.text} {a1} {pb.text} AND {a.text} {now} {b.text}", a, b, pa, pb)

    return emit


function("CROSS", "L", 2, ("CROSSUP", "CROSSOVER", "GOLDEN_CROSS", "BULLISH_CROSS", "EM_CROSS"))(_crossing(True))
function("CROSSDOWN", "L", 2, ("CROSSBELOW", "DEAD_CROSS", "BEARISH_CROSS"))(_crossing(False))


@function("LONGCROSS", "L", 3)
def _longcross(c, a, b, n):
    below = c.col(c.flag(f"({a.text}) < ({b.text})", a, b))
    k = c.int(n)
    held = c.col(c.join(f"min({below.text}) {c.frame(f'{k} PRECEDING', '1 PRECEDING')}", below, over=True))
    count = c.col(c.join(f"count({below.text}) {c.frame(f'{k} PRECEDING', '1 PRECEDING')}", below, over=True))
    return c.flag(f"({a.text}) > ({b.text}) AND {held.text} > 0 AND {count.text} = {k}", a, b, held, count)


def true_range(c, h, low, cl, first: bool):
    p = c.col(c.lag(c.col(cl), 1))
    text = f"greatest(({h.text}) - ({low.text}), abs(({h.text}) - {p.text}), abs(({low.text}) - {p.text}))"
    other = f"({h.text}) - ({low.text})" if first else "NULL"
    return c.join(f"CASE WHEN {p.text} IS NULL THEN {other} ELSE {text} END", h, low, p)


@function("TR", "L", 3)
def _tr(c, h, low, cl):
    return true_range(c, h, low, cl, True)


@function("TRANGE", "L", 3)
def _trange(c, h, low, cl):
    return true_range(c, h, low, cl, False)


@function("RELATIVE_STRENGTH", "L", 3, ("RELSTRENGTH", "RS_EXCESS_RETURN"))
def _relative_strength(c, x, b, n):
    x, b = c.col(x), c.col(b)
    k = c.int(n)
    p, q = c.div(x, c.col(c.lag(x, k))), c.div(b, c.col(c.lag(b, k)))
    return c.join(f"(({p.text}) - ({q.text})) * 100e0", p, q)


@function("LIMIT_UP", "L", (1, 2))
def _limit_up(c, cl, th=None):
    p = c.col(c.lag(c.col(cl), 1))
    return c.flag(f"({cl.text}) >= {p.text} * (1e0 + {th.text if th else '1e-1'})", cl, p)


@function("LIMIT_DOWN", "L", (1, 2))
def _limit_down(c, cl, th=None):
    p = c.col(c.lag(c.col(cl), 1))
    return c.flag(f"({cl.text}) <= {p.text} * (1e0 - {th.text if th else '1e-1'})", cl, p)


# -- windows ----------------------------------------------------------------------------------------


def _window(name: str, agg: str, aliases: tuple[str, ...] = ()) -> None:
    @function(name, "W", 2, aliases)
    def emit(c, x, n):
        x = c.col(x)
        return c.full(c.int(n), agg.replace("{x}", x.text), x)


_window("MA", "avg({x}) {w}", ("AVGPRICE_N",))
_window("SUM", "sum({x}) {w}", ("TOTALVOL",))
_window("HHV", "max({x}) {w}", ("MAXPRICE", "DONCHIAN_UPPER"))
_window("LLV", "min({x}) {w}", ("MINPRICE", "MINMAX", "DONCHIAN_LOWER"))
_window("STD", "stddev_pop({x}) {w}")
_window("STDDEV_SAMPLE", "stddev_samp({x}) {w}")
_window("VAR", "var_pop({x}) {w}")
_window("ROLLING_RANGE", "(max({x}) {w} - min({x}) {w})")
_window("MIDPOINT", "((max({x}) {w} + min({x}) {w}) / 2e0)")


@function("STDDEV", "W", (2, 3))
def _stddev(c, x, n, k=None):
    s = c.call("STD", [x, n])
    return s if k is None else c.join(f"({s.text}) * ({k.text})", s, k)


@function("ZSCORE", "W", 2, ("Z_SCORE",))
def _zscore(c, x, n):
    x = c.col(x)
    m, s = c.call("MA", [x, n]), c.col(c.call("STDDEV_SAMPLE", [x, n]))
    m = c.col(m)
    return c.join(f"CASE WHEN {s.text} > 1e-15 THEN ({x.text} - {m.text}) / {s.text} ELSE CASE WHEN {s.text} IS NOT NULL THEN 0e0 END END", x, m, s)


def _count(text: str):
    def emit(c, x, n):
        k = c.int(n)
        one = c.col(c.join(text.format(x=f"({x.text})"), x))
        return one, k, c.last(k)

    return emit


@function("COUNT", "W", 2)
def _counted(c, x, n):
    one, k, w = _count("CASE WHEN {x} > 0 THEN 1e0 ELSE 0e0 END")(c, x, n)
    return c.join(f"CASE WHEN count(*) {w} = {k} THEN sum({one.text}) {w} END", one, over=True)


@function("EXIST", "W", 2)
def _exist(c, x, n):
    one, k, w = _count("CASE WHEN {x} > 0 THEN 1e0 ELSE 0e0 END")(c, x, n)
    return c.join(f"CASE WHEN count(*) {w} = {k} THEN max({one.text}) {w} END", one, over=True)


@function("EVERY", "W", 2)
def _every(c, x, n):
    one, k, w = _count("CASE WHEN {x} <= 0 THEN 0e0 ELSE 1e0 END")(c, x, n)
    return c.join(f"CASE WHEN count(*) {w} = {k} THEN min({one.text}) {w} END", one, over=True)


@function("LAST", "W", 3)
def _last(c, x, a, b):
    hi, lo = max(c.int(a), c.int(b)), min(c.int(a), c.int(b))
    ok = c.col(c.flag(f"({x.text}) > 0", x))
    w = c.frame(f"{hi} PRECEDING", f"{lo} PRECEDING" if lo else "CURRENT ROW")
    return c.join(f"CASE WHEN count(*) {w} = {hi - lo + 1} THEN min({ok.text}) {w} END", ok, over=True)


@function("APO", "W", (1, 3))
def _apo(c, x, a=None, b=None):
    p, q = c.call("MA", [x, a or c.number(12)]), c.call("MA", [x, b or c.number(26)])
    return c.join(f"(({p.text}) - ({q.text}))", p, q)


@function("PPO", "W", (1, 3))
def _ppo(c, x, a=None, b=None):
    d, q = c.call("APO", [x, a or c.number(12), b or c.number(26)]), c.col(c.call("MA", [x, b or c.number(26)]))
    return c.join(f"CASE WHEN abs({q.text}) > 1e-8 THEN ({d.text}) / {q.text} * 100e0 END", d, q)


@function("BIAS", "W", 2)
def _bias(c, x, n):
    m = c.col(c.call("MA", [x, n]))
    return c.join(f"CASE WHEN abs({m.text}) >= 1e-15 THEN (({x.text}) - {m.text}) / {m.text} * 100e0 END", x, m)


@function("PSY", "W", 2)
def _psy(c, x, n):
    x = c.col(x)
    p = c.lag(x, 1)
    p = c.col(p)
    up = c.col(c.join(f"CASE WHEN {p.text} IS NOT NULL THEN CASE WHEN {x.text} > {p.text} THEN 1e0 ELSE 0e0 END END", x, p))
    m = c.full(c.int(n), f"avg({up.text}) {{w}}", up)
    return c.join(f"({m.text}) * 100e0", m)


@function("DPO", "W", 2)
def _dpo(c, x, n):
    m = c.col(c.lag(c.col(c.call("MA", [x, n])), c.int(n) // 2 + 1))
    return c.join(f"(({x.text}) - {m.text})", x, m)


@function("CMO", "W", 2)
def _cmo(c, x, n):
    x = c.col(x)
    d = c.col(c.call("MOM", [x, c.number(1)]))
    k = c.int(n)
    w = c.last(k - 1)
    up, dn = (c.col(c.join(f"CASE WHEN count({d.text}) {w} = {k - 1} THEN sum(CASE WHEN {d.text} {o} 0 THEN abs({d.text}) ELSE 0e0 END) {w} END", d, over=True)) for o in (">", "<="))
    return c.join(f"CASE WHEN {up.text} + {dn.text} > 1e-15 THEN ({up.text} - {dn.text}) / ({up.text} + {dn.text}) * 100e0 END", up, dn)


def _moment(name: str, power: int, text: str) -> None:
    @function(name, "W", 2)
    def emit(c, x, n):
        x = c.col(x)
        k = c.int(n)
        m = c.col(c.call("MA", [x, n]))
        v = c.col(c.call("VAR", [x, n]))
        terms = [c.col(c.lag(x, i)) for i in range(k)]
        s = " + ".join(f"power({t.text} - {m.text}, {power})" for t in terms)
        return c.join(f"CASE WHEN {v.text} < 2.220446049250313e-16 THEN 0e0 ELSE {text.format(s=f'(({s}) / {k}e0)', v=v.text)} END", m, v, *terms)


_moment("SKEW", 3, "{s} / power({v}, 1.5e0)")
_moment("KURT", 4, "{s} / ({v} * {v}) - 3e0")


def _bands(part: int):
    def emit(c, x, n=None, k=None):
        n, k = n or c.number(20), k or c.number(2)
        m, s = c.call("MA", [x, n]), c.call("STD", [x, n])
        return [m, c.join(f"(({m.text}) + ({k.text}) * ({s.text}))", m, s, k), c.join(f"(({m.text}) - ({k.text}) * ({s.text}))", m, s, k)][part]

    return emit


function("BOLL", "W", (1, 3), ("BOLLMID", "BBANDS_MIDDLE"))(_bands(0))
function("BOLLUP", "W", (1, 3), ("BBANDS", "BOLLINGER"))(_bands(1))
function("BOLLDN", "W", (1, 3), ("BBANDS_LOWER",))(_bands(2))


@function("BOLLWIDTH", "W", (1, 3))
def _bollwidth(c, x, n=None, k=None):
    u, m, d = c.call("BOLLUP", [x, n or c.number(20), k or c.number(2)]), c.col(c.call("BOLL", [x, n or c.number(20)])), c.call("BOLLDN", [x, n or c.number(20), k or c.number(2)])
    return c.div(c.join(f"({u.text}) - ({d.text})", u, d), m)


@function("DONCHIAN", "W", 3, ("MIDPRICE", "DONCHIAN_MID", "DONCHIAN_MIDDLE", "TENKAN", "TENKAN_SEN", "ICHIMOKU_TENKAN", "KIJUN", "KIJUN_SEN", "ICHIMOKU_KIJUN"))
def _donchian(c, h, low, n):
    a, b = c.call("HHV", [h, n]), c.call("LLV", [low, n])
    return c.join(f"(({a.text}) + ({b.text})) / 2e0", a, b)


@function("DONCHIAN_WIDTH", "W", 3)
def _donchian_width(c, h, low, n):
    a, b = c.call("HHV", [h, n]), c.call("LLV", [low, n])
    return c.join(f"(({a.text}) - ({b.text}))", a, b)


@function("WILLR", "W", 4, ("WR",))
def _willr(c, h, low, cl, n):
    a, b = c.col(c.call("HHV", [h, n])), c.col(c.call("LLV", [low, n]))
    return c.join(f"CASE WHEN abs({a.text} - {b.text}) < 1e-8 THEN 0e0 ELSE -100e0 * ({a.text} - ({cl.text})) / ({a.text} - {b.text}) END", a, b, cl)


def _raw_k(c, h, low, cl, n):
    a, b = c.col(c.call("HHV", [h, n])), c.col(c.call("LLV", [low, n]))
    return c.col(c.join(f"CASE WHEN abs({a.text} - {b.text}) < 1e-8 THEN 0e0 ELSE 100e0 * (({cl.text}) - {b.text}) / ({a.text} - {b.text}) END", a, b, cl))


@function("STOCHF", "W", (3, 4))
def _stochf(c, h, low, cl, n=None):
    return _raw_k(c, h, low, cl, n or c.number(5))


@function("STOCH", "W", (3, 5))
def _stoch(c, h, low, cl, n=None, d=None):
    return c.call("MA", [_raw_k(c, h, low, cl, n or c.number(5)), d or c.number(3)])


@function("CCI", "W", (2, 4))
def _cci(c, *args):
    x, n = (c.col(c.call("TYPPRICE", list(args[:3]))), args[3]) if len(args) == 4 else (c.col(args[0]), args[1])
    m, d = c.col(c.call("MA", [x, n])), c.col(c.call("AVEDEV", [x, n]))
    return c.join(f"CASE WHEN {d.text} > 1e-15 THEN ({x.text} - {m.text}) / (15e-3 * {d.text}) END", x, m, d)


@function("VWMA", "W", 3)
def _vwma(c, x, v, n):
    a, b = c.call("SUM", [c.join(f"({x.text}) * ({v.text})", x, v), n]), c.col(c.call("SUM", [v, n]))
    return c.div(a, b)


@function("MFI", "W", 5)
def _mfi(c, h, low, cl, v, n):
    tp = c.col(c.call("TYPPRICE", [h, low, cl]))
    p = c.col(c.lag(tp, 1))
    flow = {o: c.col(c.join(f"CASE WHEN {p.text} IS NOT NULL THEN CASE WHEN {tp.text} {o} {p.text} THEN {tp.text} * ({v.text}) ELSE 0e0 END END", tp, p, v)) for o in "><"}
    a, b = (c.col(c.call("SUM", [flow[o], n])) for o in "><")
    return c.join(f"CASE WHEN {a.text} + {b.text} < 1e-8 THEN 0e0 ELSE 100e0 * {a.text} / ({a.text} + {b.text}) END", a, b)


def money_flow_multiplier(c, h, low, cl):
    return c.join(f"CASE WHEN ({h.text}) - ({low.text}) > 1e-8 THEN ((({cl.text}) - ({low.text})) - (({h.text}) - ({cl.text}))) / (({h.text}) - ({low.text})) ELSE 0e0 END", h, low, cl)


@function("CMF", "W", 5)
def _cmf(c, h, low, cl, v, n):
    m = money_flow_multiplier(c, h, low, cl)
    a, b = c.call("SUM", [c.join(f"({m.text}) * ({v.text})", m, v), n]), c.col(c.call("SUM", [v, n]))
    return c.join(f"CASE WHEN abs({b.text}) > 1e-8 THEN ({a.text}) / {b.text} ELSE CASE WHEN {b.text} IS NOT NULL THEN 0e0 END END", a, b)


@function("CHOP", "W", 4, ("CHOPPINESS",))
def _chop(c, h, low, cl, n):
    tr = c.col(true_range(c, h, low, cl, True))
    s, r = c.col(c.call("SUM", [tr, n])), c.col(c.call("DONCHIAN_WIDTH", [h, low, n]))
    return c.join(f"CASE WHEN {r.text} > 1e-8 AND {s.text} > 0 THEN 100e0 * log10({s.text} / {r.text}) / {math.log10(c.int(n))!r} END", s, r)


@function("ER", "W", (1, 2))
def _er(c, x, n=None):
    k = c.int(n) if n else 10
    x = c.col(x)
    path = c.col(c.call("SUM", [c.call("ABS", [c.call("MOM", [x, c.number(1)])]), c.number(k)]))
    way = c.call("MOM", [x, c.number(k)])
    return c.join(f"CASE WHEN {path.text} > 1e-8 THEN abs({way.text}) / {path.text} ELSE CASE WHEN {path.text} IS NOT NULL THEN 0e0 END END", path, way)


@function("VHF", "W", (1, 2))
def _vhf(c, x, n=None):
    n = n or c.number(28)
    x = c.col(x)
    path = c.col(c.call("SUM", [c.call("ABS", [c.call("MOM", [x, c.number(1)])]), n]))
    r = c.call("ROLLING_RANGE", [x, n])
    return c.join(f"CASE WHEN {path.text} = 0 THEN 0e0 ELSE ({r.text}) / {path.text} END", path, r)


@function("IMI", "W", 3)
def _imi(c, o, cl, n):
    up = c.col(c.call("SUM", [c.join(f"CASE WHEN ({cl.text}) > ({o.text}) THEN ({cl.text}) - ({o.text}) ELSE 0e0 END", o, cl), n]))
    dn = c.col(c.call("SUM", [c.join(f"CASE WHEN ({cl.text}) < ({o.text}) THEN ({o.text}) - ({cl.text}) ELSE 0e0 END", o, cl), n]))
    return c.join(f"CASE WHEN {up.text} + {dn.text} > 1e-8 THEN 100e0 * {up.text} / ({up.text} + {dn.text}) END", up, dn)


@function("QSTICK", "W", (2, 3))
def _qstick(c, o, cl, n=None):
    return c.call("MA", [c.join(f"({cl.text}) - ({o.text})", o, cl), n or c.number(8)])


@function("ADR", "W", (2, 3))
def _adr(c, h, low, n=None):
    return c.call("MA", [c.join(f"({h.text}) - ({low.text})", h, low), n or c.number(14)])


@function("AO", "W", (2, 4))
def _ao(c, h, low, a=None, b=None):
    mid = c.col(c.call("MEDPRICE", [h, low]))
    x, y = c.call("MA", [mid, a or c.number(5)]), c.call("MA", [mid, b or c.number(34)])
    return c.join(f"(({x.text}) - ({y.text}))", x, y)


@function("AC", "W", (2, 5))
def _ac(c, h, low, a=None, b=None, s=None):
    ao = c.col(c.call("AO", [h, low, a or c.number(5), b or c.number(34)]))
    m = c.call("MA", [ao, s or c.number(5)])
    return c.join(f"({ao.text} - ({m.text}))", ao, m)


@function("TRIMA", "W", 2)
def _trima(c, x, n):
    k = c.int(n)
    a, b = (k // 2 + 1, k // 2) if k % 2 == 0 else ((k + 1) // 2, (k + 1) // 2)
    return c.call("MA", [c.col(c.call("MA", [x, c.number(max(1, b))])), c.number(a)])


@function("ULTOSC", "W", (3, 6))
def _ultosc(c, h, low, cl, n1=None, n2=None, n3=None):
    p = c.col(c.lag(c.col(cl), 1))
    bp = c.col(c.join(f"CASE WHEN {p.text} IS NOT NULL THEN ({cl.text}) - least(({low.text}), {p.text}) END", cl, low, p))
    tr = c.col(true_range(c, h, low, cl, False))
    parts = []
    for n in (n1 or c.number(7), n2 or c.number(14), n3 or c.number(28)):
        a, b = c.col(c.call("SUM", [bp, n])), c.col(c.call("SUM", [tr, n]))
        parts.append(c.col(c.join(f"CASE WHEN {b.text} > 1e-8 THEN {a.text} / {b.text} ELSE CASE WHEN {b.text} IS NOT NULL THEN 0e0 END END", a, b)))
    x, y, z = parts
    return c.join(f"100e0 * (4e0 * {x.text} + 2e0 * {y.text} + {z.text}) / 7e0", x, y, z)


def _vortex(sign: str):
    def emit(c, h, low, cl, n=None):
        n = n or c.number(14)
        a, b = (c.col(h), c.col(c.lag(c.col(low), 1))) if sign == "+" else (c.col(low), c.col(c.lag(c.col(h), 1)))
        vm = c.call("SUM", [c.join(f"abs({a.text} - {b.text})", a, b), n])
        tr = c.col(c.call("SUM", [true_range(c, h, low, cl, False), n]))
        return c.div(vm, tr, "1e-8")

    return emit


function("VORTEX_PLUS", "W", (3, 4), ("VORTEX",))(_vortex("+"))
function("VORTEX_MINUS", "W", (3, 4))(_vortex("-"))


@function("RVOL", "W", (1, 2))
def _rvol(c, v, n=None):
    k = c.int(n) if n else 20
    v = c.col(v)
    w = c.frame(f"{k} PRECEDING", "1 PRECEDING")
    m = c.col(c.join(f"CASE WHEN count({v.text}) {w} = {k} THEN avg({v.text}) {w} END", v, over=True))
    return c.join(f"CASE WHEN {m.text} = 0 THEN 0e0 ELSE {v.text} / {m.text} END", v, m)


def _breakout(up: bool):
    agg, sign = ("max", ">") if up else ("min", "<")

    def emit(c, cl, x, n):
        k = c.int(n)
        x = c.col(x)
        w = c.frame(f"{k} PRECEDING", "1 PRECEDING")
        m = c.col(c.join(f"CASE WHEN count(*) {w} = {k} THEN {agg}({x.text}) {w} END", x, over=True))
        return c.flag(f"({cl.text}) {sign} {m.text}", cl, m)

    return emit


function("BREAKOUT", "W", 3, ("BREAKOUT_UP", "PRICE_BREAKOUT"))(_breakout(True))
function("BREAKDOWN", "W", 3, ("BREAKOUT_DOWN", "PRICE_BREAKDOWN"))(_breakout(False))


@function("VOLUME_SURGE", "W", (2, 3), ("VOLSURGE", "VOLUME_EXPANSION"))
def _volume_surge(c, v, n, k=None):
    m = c.int(n)
    v = c.col(v)
    w = c.frame(f"{m} PRECEDING", "1 PRECEDING")
    a = c.col(c.join(f"CASE WHEN count({v.text}) {w} = {m} THEN avg({v.text}) {w} END", v, over=True))
    return c.flag(f"{v.text} > {(k or c.number(2)).text} * {a.text}", v, a)


@function("HISTVOL", "W", 2)
def _histvol(c, x, n):
    x = c.col(x)
    p = c.col(c.lag(x, 1))
    r = c.col(c.join(f"CASE WHEN {p.text} IS NULL THEN CASE WHEN {x.text} IS NOT NULL THEN 0e0 END WHEN {p.text} > 0 AND {x.text} > 0 THEN ln({x.text} / {p.text}) END", x, p))
    s = c.call("STDDEV_SAMPLE", [r, n])
    return c.join(f"({s.text}) * {math.sqrt(252)!r}", s)


# -- regressions on the bar number, x = 0..n-1 --------------------------------------------------------


def _line(c, x, n):
    """(mean, slope) of a line through the last n values."""
    x = c.col(x)
    k = c.int(n)
    terms = [c.col(c.lag(x, i)) for i in range(k)]
    mid, s2 = (k - 1) / 2, k * (k * k - 1) / 12
    slope = " + ".join(f"({(k - 1 - i - mid)!r}e0 * {t.text})" for i, t in enumerate(terms)) if k > 1 else "0e0"
    m = c.col(c.call("MA", [x, n]))
    return m, c.col(c.join(f"CASE WHEN {m.text} IS NOT NULL THEN ({slope}) / {s2!r}e0 END" if k > 1 else f"CASE WHEN {m.text} IS NOT NULL THEN 0e0 END", m, *terms)), k


@function("SLOPE", "W", 2, ("LINEARREG_SLOPE",))
def _slope(c, x, n):
    return _line(c, x, n)[1]


@function("LINEARREG", "W", 2, ("FORCAST", "FORECAST", "LINEAR_REG"))
def _linearreg(c, x, n):
    m, b, k = _line(c, x, n)
    return c.join(f"({m.text} + {b.text} * {(k - 1) / 2!r}e0)", m, b)


@function("LINEARREG_INTERCEPT", "W", 2)
def _intercept(c, x, n):
    m, b, k = _line(c, x, n)
    return c.join(f"({m.text} - {b.text} * {(k - 1) / 2!r}e0)", m, b)


@function("LINEARREG_ANGLE", "W", 2)
def _angle(c, x, n):
    b = _line(c, x, n)[1]
    return c.join(f"degrees(atan({b.text}))", b)


@function("TSF", "W", 2)
def _tsf(c, x, n):
    m, b, k = _line(c, x, n)
    return c.join(f"({m.text} + {b.text} * {(k + 1) / 2!r}e0)", m, b)


@function("RESI", "W", 2)
def _resi(c, x, n):
    y = c.call("LINEARREG", [x, n])
    return c.join(f"(({x.text}) - ({y.text}))", x, y)


@function("FOSC", "W", (1, 2))
def _fosc(c, x, n=None):
    f = c.col(c.lag(c.col(c.call("TSF", [x, n or c.number(14)])), 1))
    return c.join(f"CASE WHEN abs({x.text}) > 1e-15 THEN 100e0 * (({x.text}) - {f.text}) / ({x.text}) END", x, f)


def _pair(c, x, y, n):
    x, y = c.col(x), c.col(y)
    k = c.int(n)
    xy = c.col(c.join(f"{x.text} * {y.text}", x, y))
    mx, my = c.col(c.call("MA", [x, n])), c.col(c.call("MA", [y, n]))
    tx, ty = [c.col(c.lag(x, i)) for i in range(k)], [c.col(c.lag(y, i)) for i in range(k)]
    cov = c.col(c.join("(" + " + ".join(f"({a.text} - {mx.text}) * ({b.text} - {my.text})" for a, b in zip(tx, ty, strict=True)) + f") / {k}e0", mx, my, *tx, *ty))
    return xy, cov, c.col(c.call("VAR", [x, n])), c.col(c.call("VAR", [y, n]))


@function("CORREL", "W", 3, ("CORR",))
def _correl(c, x, y, n):
    _, cov, vx, vy = _pair(c, x, y, n)
    return c.join(f"CASE WHEN {vx.text} > 1e-12 AND {vy.text} > 1e-12 THEN {cov.text} / sqrt({vx.text} * {vy.text}) WHEN {vx.text} IS NOT NULL AND {vy.text} IS NOT NULL THEN 0e0 END", cov, vx, vy)


@function("COVAR", "W", 3)
def _covar(c, x, y, n):
    return _pair(c, x, y, n)[1]


@function("RSQUARE", "W", 2)
def _rsquare(c, x, n):
    m, b, k = _line(c, x, n)
    v = c.col(c.call("VAR", [x, n]))
    return c.join(f"CASE WHEN {v.text} > 1e-15 THEN {b.text} * {b.text} * {(k * k - 1) / 12!r}e0 / {v.text} WHEN {v.text} IS NOT NULL THEN 0e0 END", b, v)


# -- arrays over a window, written out as lags ---------------------------------------------------------


def _terms(c, x, n):
    x = c.col(x)
    k = c.int(n)
    return x, k, [c.col(c.lag(x, i)) for i in range(k)]


@function("AVEDEV", "A", 2, ("AVGDEV",))
def _avedev(c, x, n):
    x, k, terms = _terms(c, x, n)
    m = c.col(c.call("MA", [x, n]))
    return c.join("(" + " + ".join(f"abs({t.text} - {m.text})" for t in terms) + f") / {k}e0", m, *terms)


@function("DEVSQ", "A", 2)
def _devsq(c, x, n):
    v = c.call("VAR", [x, n])
    return c.join(f"({v.text}) * {c.int(n)}e0", v)


@function("WMA", "A", 2)
def _wma(c, x, n):
    x, k, terms = _terms(c, x, n)
    return c.join("(" + " + ".join(f"{k - i}e0 * {t.text}" for i, t in enumerate(terms)) + f") / {k * (k + 1) // 2}e0", *terms)


@function("HMA", "A", 2)
def _hma(c, x, n):
    k = c.int(n)
    a, b = c.call("WMA", [x, c.number(max(1, k // 2))]), c.call("WMA", [x, n])
    return c.call("WMA", [c.col(c.join(f"2e0 * ({a.text}) - ({b.text})", a, b)), c.number(max(1, int(math.sqrt(k))))])


@function("ALMA", "A", (2, 4))
def _alma(c, x, n, offset=None, sigma=None):
    x, k, terms = _terms(c, x, n)
    m, s = (offset.const if offset else 0.85) * (k - 1), k / (sigma.const if sigma else 6.0)
    weights = [math.exp(-((k - 1 - i - m) ** 2) / (2 * s * s)) for i in range(k)]
    return c.join("(" + " + ".join(f"{w / sum(weights):.17e} * {t.text}" for w, t in zip(weights, terms, strict=True)) + ")", *terms)


def _place(name: str, extreme: str, whole: bool, base: int) -> None:
    @function(name, "A", 2)
    def emit(c, x, n):
        x, k, terms = _terms(c, x, n)
        m = c.col(c.call(extreme, [x, n]) if whole else c.join(f"{'max' if extreme == 'HHV' else 'min'}({x.text}) {c.last(k)}", x, over=True))
        cases = " ".join(f"WHEN {t.text} = {m.text} THEN {float(k - 1 - i if base else i)!r}e0" for i, t in reversed(list(enumerate(terms))))
        return c.join(f"CASE {cases} END", m, *terms)


_place("HHVBARS", "HHV", False, 0)
_place("LLVBARS", "LLV", False, 0)
_place("MAXINDEX", "HHV", True, 1)
_place("MININDEX", "LLV", True, 1)


def _below(name: str, text: str, strict: str = "<") -> None:
    @function(name, "A", 2)
    def emit(c, x, n):
        x, k, terms = _terms(c, x, n)
        less = " + ".join(f"CASE WHEN {t.text} {strict} {x.text} THEN 1e0 ELSE 0e0 END" for t in terms)
        same = " + ".join(f"CASE WHEN {t.text} = {x.text} THEN 1e0 ELSE 0e0 END" for t in terms)
        ok = c.join(f"count({x.text}) {c.last(k)}", x, over=True)
        ok = c.col(ok)
        return c.join(f"CASE WHEN {ok.text} = {k} THEN {text.format(less=f'({less})', same=f'({same})', k=f'{k}e0', k1=f'{max(1, k - 1)}e0')} END", x, ok, *terms)


_below("RANK", "100e0 * {less} / {k1}")
_below("PERCENT_RANK", "{less} / {k} * 100e0")
_below("RANK_PCT", "({less} + ({same} + 1e0) / 2e0) / {k}")


def _aroon(part: str):
    def emit(c, h, low=None, n=None):
        n = c.number((c.int(n) if n else 14) + 1)
        k = c.int(n) - 1
        out = []
        for x, extreme in ((h, "max"), (low, "min")):
            x = c.col(x)
            terms = [c.col(c.lag(x, i)) for i in range(k + 1)]
            m = c.col(c.full(k + 1, f"{extreme}({x.text}) {{w}}", x))
            cases = " ".join(f"WHEN {t.text} = {m.text} THEN {100 * (k - i) / k!r}e0" for i, t in enumerate(terms))
            out.append(c.col(c.join(f"CASE {cases} END", m, *terms)))
        up, dn = out
        return {"up": up, "dn": dn, "osc": c.join(f"({up.text} - {dn.text})", up, dn)}[part]

    return emit


function("AROON_UP", "A", (2, 3), ("AROON",))(_aroon("up"))
function("AROON_DN", "A", (2, 3), ("AROON_DOWN",))(_aroon("dn"))
function("AROONOSC", "A", (2, 3))(_aroon("osc"))


def _quantile(c, x, n, q: float):
    x = c.col(x)
    agg = f"percentile({x.text}, {q!r}) {{w}}" if c.dialect == "spark" else f"quantile_cont({x.text}, {q!r}) {{w}}"
    return c.full(c.int(n), agg, x)


@function("MEDIAN", "A", 2)
def _median(c, x, n):
    return _quantile(c, x, n, 0.5)


@function("QUANTILE", "A", 3)
def _quantiles(c, x, n, q):
    return _quantile(c, x, n, q.const)


# -- expanding ----------------------------------------------------------------------------------------

_SO_FAR = "UNBOUNDED PRECEDING"


@function("BARSCOUNT", "X", 1)
def _barscount(c, x):
    x = c.col(x)
    return c.join(f"CAST(count({x.text}) {c.frame(_SO_FAR)} AS double)", x, over=True)


@function("CUMSUM", "X", 1, ("CUM",))
def _cumsum(c, x):
    x = c.col(x)
    return c.join(f"sum(coalesce({x.text}, 0e0)) {c.frame(_SO_FAR)}", x, over=True)


@function("CUMMAX", "X", 1)
def _cummax(c, x):
    x = c.col(x)
    return c.join(f"max({x.text}) {c.frame(_SO_FAR)}", x, over=True)


@function("CUMMIN", "X", 1)
def _cummin(c, x):
    x = c.col(x)
    return c.join(f"min({x.text}) {c.frame(_SO_FAR)}", x, over=True)


@function("TOTALBARSCOUNT", "X", 0, causal=False)
def _total(c):
    return c.join(f"CAST(count(*) {c.whole()} AS double)", over=True)


@function("CURRBARSCOUNT", "X", 0, causal=False)
def _current(c):
    return c.join(f"CAST(count(*) {c.frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')} AS double)", over=True)


@function("ISLASTBAR", "X", 0, causal=False)
def _islast(c):
    n = c.col(c.call("CURRBARSCOUNT", []))
    return c.flag(f"{n.text} = 1", n)


@function("CONST", "X", 1, causal=False)
def _const(c, x):
    x = c.col(x)
    return c.join(f"last_value({x.text}) {c.frame('UNBOUNDED PRECEDING', 'UNBOUNDED FOLLOWING')}", x, over=True)


@function("VWAP", "X", 4)
def _vwap(c, h, low, cl, v):
    tp = c.call("TYPPRICE", [h, low, cl])
    a = c.col(c.call("CUMSUM", [c.join(f"({tp.text}) * ({v.text})", tp, v)]))
    b = c.col(c.call("CUMSUM", [v]))
    return c.div(a, b, "1e-8")


@function("OBV", "X", 2)
def _obv(c, cl, v):
    cl = c.col(cl)
    p = c.col(c.lag(cl, 1))
    return c.call("CUMSUM", [c.join(f"CASE WHEN {p.text} IS NULL THEN ({v.text}) WHEN {cl.text} > {p.text} THEN ({v.text}) WHEN {cl.text} < {p.text} THEN -({v.text}) ELSE 0e0 END", cl, p, v)])


@function("AD", "X", 4)
def _ad(c, h, low, cl, v):
    m = money_flow_multiplier(c, h, low, cl)
    return c.call("CUMSUM", [c.join(f"({m.text}) * ({v.text})", m, v)])


@function("PVT", "X", 2)
def _pvt(c, cl, v):
    cl = c.col(cl)
    p = c.col(c.lag(cl, 1))
    return c.call("CUMSUM", [c.join(f"CASE WHEN abs({p.text}) > 1e-8 THEN ({cl.text} - {p.text}) / {p.text} * ({v.text}) ELSE 0e0 END", cl, p, v)])


@function("WAD", "X", 3)
def _wad(c, h, low, cl):
    cl = c.col(cl)
    p = c.col(c.lag(cl, 1))
    step = c.join(f"CASE WHEN {cl.text} > {p.text} THEN {cl.text} - least(({low.text}), {p.text}) WHEN {cl.text} < {p.text} THEN {cl.text} - greatest(({h.text}), {p.text}) ELSE 0e0 END", cl, p, h, low)
    s = c.call("CUMSUM", [step])
    return c.join(f"CASE WHEN {p.text} IS NOT NULL THEN {s.text} END", p, s)


# -- islands ------------------------------------------------------------------------------------------


def _since(c, test: str, x):
    rn = c.col(c.join(f"row_number() OVER (PARTITION BY {c.KEYS} ORDER BY ts)", over=True))
    hit = c.col(c.join(f"CASE WHEN {test} THEN {rn.text} END", x, rn))
    at = c.col(c.join(f"max({hit.text}) {c.frame(_SO_FAR)}", hit, over=True))
    return rn, at


@function("BARSLAST", "G", 1)
def _barslast(c, x):
    rn, at = _since(c, f"({x.text}) > 0", x)
    return c.join(f"CAST({rn.text} - {at.text} AS double)", rn, at)


@function("BARSSINCE", "G", 1)
def _barssince(c, x):
    rn, at = _since(c, f"({x.text}) <> 0", x)
    return c.join(f"CAST({rn.text} - {at.text} AS double)", rn, at)


@function("BARSLASTCOUNT", "G", 1, ("CONSECUTIVE_LIMIT",))
def _barslastcount(c, x):
    x = c.col(x)
    rn, at = _since(c, f"NOT coalesce({x.text} > 0, false)", x)
    return c.join(f"CAST({rn.text} - coalesce({at.text}, 0) AS double)", rn, at)


@function("FIXNAN", "G", 1)
def _fixnan(c, x):
    x = c.col(x)
    _, at = _since(c, f"{x.text} IS NOT NULL", x)
    return c.join(f"max({x.text}) OVER (PARTITION BY {c.KEYS}, {at.text})", x, at, over=True)


@function("VALUEWHEN", "G", 2)
def _valuewhen(c, t, x):
    x = c.col(x)
    rn, at = _since(c, f"({t.text}) > 0", t)
    own = c.col(c.join(f"CASE WHEN {rn.text} = {at.text} THEN {x.text} END", rn, at, x))
    return c.join(f"max({own.text}) OVER (PARTITION BY {c.KEYS}, {at.text})", own, over=True)


# -- cross-sections: all symbols at one time of one timeframe -------------------------------------------

_CS = "PARTITION BY timeframe, ts"


@function("CS_RANK", "C", 1)
def _cs_rank(c, x):
    x = c.col(x)
    ok = f"({x.text} IS NOT NULL)"
    r = c.col(c.join(f"rank() OVER ({_CS}, {ok} ORDER BY {x.text})", x, over=True))
    same = c.col(c.join(f"count(*) OVER ({_CS}, {x.text})", x, over=True))
    n = c.col(c.join(f"count({x.text}) OVER ({_CS})", x, over=True))
    return c.join(f"CASE WHEN {x.text} IS NULL THEN NULL WHEN {n.text} = 1 THEN 0e0 ELSE ({r.text} + ({same.text} - 1) / 2e0 - 1) / ({n.text} - 1e0) END", x, r, same, n)


@function("CS_ZSCORE", "C", 1)
def _cs_zscore(c, x):
    x = c.col(x)
    m, s = c.col(c.join(f"avg({x.text}) OVER ({_CS})", x, over=True)), c.col(c.join(f"stddev_pop({x.text}) OVER ({_CS})", x, over=True))
    return c.join(f"CASE WHEN {x.text} IS NULL THEN NULL WHEN {s.text} <= 1e-12 THEN 0e0 ELSE ({x.text} - {m.text}) / {s.text} END", x, m, s)


@function("CS_SCALE", "C", (1, 2))
def _cs_scale(c, x, k=None):
    x = c.col(x)
    s = c.col(c.join(f"sum(abs({x.text})) OVER ({_CS})", x, over=True))
    return c.join(f"CASE WHEN {s.text} > 1e-15 THEN {x.text} * {k.text if k else '1e0'} / {s.text} END", x, s)


@function("CS_DEMEAN", "C", 1)
def _cs_demean(c, x):
    x = c.col(x)
    m = c.col(c.join(f"avg({x.text}) OVER ({_CS})", x, over=True))
    return c.join(f"({x.text} - {m.text})", x, m)


# -- recursive: one grouped kernel a stage ---------------------------------------------------------------


def _recursive(name: str, kernel: str, least: int, defaults: tuple[float, ...], part: int = 0, aliases: tuple[str, ...] = ()) -> None:
    @function(name, "R", (least, least + len(defaults)), aliases)
    def emit(c, *args):
        params = [a.const if a.const is not None else c.int(a) for a in args[least:]]
        return c.kernel(kernel, list(args[:least]), *params, *defaults[len(params) :], part=part)


_recursive("EMA", "ema", 1, (12,), aliases=("EXPMA", "EXPMEMA"))
_recursive("SMA", "sma", 1, (12, 1))
_recursive("RMA", "rma", 1, (14,))
_recursive("DMA", "dma", 2, ())
_recursive("RSI", "rsi", 1, (14,))
_recursive("MACD", "macd", 1, (12, 26, 9), aliases=("DIF", "MACD_DIF"))
_recursive("MACD_SIGNAL", "macd", 1, (12, 26, 9), part=1, aliases=("DEA", "MACD_DEA"))
_recursive("MACD_HIST", "macd", 1, (12, 26, 9), part=2)
_recursive("ATR", "atr", 3, (14,))
_recursive("ADX", "dmi", 3, (14,), part=2)
_recursive("PLUS_DI", "dmi", 3, (14,), part=0)
_recursive("MINUS_DI", "dmi", 3, (14,), part=1)
_recursive("KDJ", "kdj", 3, (9, 3, 3), aliases=("KDJ_K",))
_recursive("KDJ_D", "kdj", 3, (9, 3, 3), part=1)
_recursive("KDJ_J", "kdj", 3, (9, 3, 3), part=2)
_recursive("SAR", "sar", 2, (0.02, 0.2))
_recursive("DEMA", "dema", 1, (12,))
_recursive("TEMA", "tema", 1, (12,))
_recursive("TRIX", "trix", 1, (12,))
_recursive("KAMA", "kama", 1, (10,))
_recursive("NVI", "nvi", 2, ())
_recursive("PVI", "pvi", 2, ())
_recursive("HEIKIN_OPEN", "heikin", 4, ())
_recursive("HEIKIN_CLOSE", "heikin", 4, (), part=1)
_recursive("SUPERTREND", "supertrend", 3, (10, 3))
_recursive("SUPERTREND_DIR", "supertrend", 3, (10, 3), part=1)
_recursive("T3", "t3", 1, (5, 0.7))
_recursive("CMO_WILDER", "cmo", 1, (14,))
_recursive("ADOSC_OF_AD", "adosc", 1, (3, 10))


def _composed(name: str, args: tuple[int, int], aliases: tuple[str, ...] = ()):
    return function(name, "R", args, aliases)


@_composed("NATR", (3, 4))
def _natr(c, h, low, cl, n=None):
    return c.join(f"({c.div(c.call('ATR', [h, low, cl, n or c.number(14)]), c.col(cl)).text}) * 100e0", c.call("ATR", [h, low, cl, n or c.number(14)]), c.col(cl))


@_composed("ADXR", (3, 4))
def _adxr(c, h, low, cl, n=None):
    k = c.int(n) if n else 14
    a = c.call("ADX", [h, low, cl, c.number(k)])
    b = c.col(c.lag(a, k - 1))
    return c.join(f"({a.text} + {b.text}) / 2e0", a, b)


@_composed("ADOSC", (4, 6))
def _adosc(c, h, low, cl, v, a=None, b=None):
    return c.call("ADOSC_OF_AD", [c.call("AD", [h, low, cl, v]), a or c.number(3), b or c.number(10)])


@_composed("EFI", (2, 3))
def _efi(c, cl, v, n=None):
    d = c.call("MOM", [cl, c.number(1)])
    return c.call("EMA", [c.join(f"({d.text}) * ({v.text})", d, v), n or c.number(13)])


@_composed("ZLEMA", (1, 2))
def _zlema(c, x, n=None):
    n = n or c.number(12)
    p = c.col(c.lag(c.col(x), (c.int(n) - 1) // 2))
    return c.call("EMA", [c.join(f"2e0 * ({x.text}) - {p.text}", x, p), n])


@_composed("MASS", (2, 4))
def _mass(c, h, low, n=None, m=None):
    e = c.call("EMA", [c.join(f"({h.text}) - ({low.text})", h, low), n or c.number(9)])
    return c.call("SUM", [c.div(e, c.call("EMA", [e, n or c.number(9)])), m or c.number(25)])


@_composed("TSI", (1, 3))
def _tsi(c, x, slow=None, fast=None):
    d = c.col(c.call("MOM", [x, c.number(1)]))
    a, b = (c.call("EMA", [c.call("EMA", [y, slow or c.number(25)]), fast or c.number(13)]) for y in (d, c.col(c.call("ABS", [d]))))
    return c.join(f"CASE WHEN abs({b.text}) > 1e-8 THEN 100e0 * {a.text} / {b.text} END", a, b)


@_composed("STOCHRSI", (1, 3))
def _stochrsi(c, x, n=None, k=None):
    r = c.call("RSI", [x, n or c.number(14)])
    return c.call("STOCHF", [r, r, r, k or c.number(14)])


@function("COPPOCK", "A", (1, 4))
def _coppock(c, x, a=None, b=None, n=None):
    p, q = c.call("ROC", [x, a or c.number(14)]), c.call("ROC", [x, b or c.number(11)])
    return c.call("WMA", [c.join(f"({p.text}) + ({q.text})", p, q), n or c.number(10)])
