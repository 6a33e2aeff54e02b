"""Candlestick patterns as expressions over the last one to three bars and averages of earlier bars.

A candle is measured against settings: the average, over the bars before it, of a range, times a factor.
A pattern is 100, -100 or 0; bars without enough history give 0.
"""

from __future__ import annotations

from tidemark.functions.registry import function

#: What is averaged, over how many earlier bars, and the factor.
SETTINGS = {
    "body_long": ("body", 10, 1.0),
    "body_short": ("body", 10, 1.0),
    "body_doji": ("span", 10, 0.1),
    "shadow_long": ("body", 0, 1.0),
    "shadow_very_long": ("body", 0, 2.0),
    "shadow_short": ("shadows", 10, 1.0),
    "shadow_very_short": ("span", 10, 0.1),
    "near": ("span", 5, 0.2),
    "far": ("span", 5, 0.6),
    "equal": ("span", 5, 0.05),
}


class Bar:
    """Expressions of the bar ``back`` bars ago."""

    def __init__(self, c, o, h, low, cl):
        self.c = c
        self.base = {"o": c.col(o), "h": c.col(h), "l": c.col(low), "c": c.col(cl)}
        self.parts = []

    def _use(self, e):
        self.parts.append(e)
        return e.text

    def price(self, which: str, back: int = 0) -> str:
        return self._use(self.c.col(self.c.lag(self.base[which], back)))

    def measure(self, kind: str):
        b = {k: v.text for k, v in self.base.items()}
        text = {
            "body": f"abs({b['c']} - {b['o']})",
            "span": f"({b['h']} - {b['l']})",
            "shadows": f"({b['h']} - {b['l']} - abs({b['c']} - {b['o']}))",
        }[kind]
        return self.c.col(self.c.join(text, *self.base.values()))

    def limit(self, setting: str, back: int = 0) -> str:
        kind, n, factor = SETTINGS[setting]
        m = self.measure(kind)
        if not n:
            return f"({factor!r}e0 * {self._use(self.c.col(self.c.lag(m, back)))})"
        w = self.c.frame(f"{n} PRECEDING", "1 PRECEDING")
        avg = self.c.col(self.c.join(f"CASE WHEN count({m.text}) {w} = {n} THEN avg({m.text}) {w} END", m, over=True))
        scale = factor / 2 if kind == "shadows" else factor
        return f"({scale!r}e0 * {self._use(self.c.col(self.c.lag(avg, back)))})"

    def body(self, back: int = 0) -> str:
        return self._use(self.c.col(self.c.lag(self.measure("body"), back)))

    def span(self, back: int = 0) -> str:
        return self._use(self.c.col(self.c.lag(self.measure("span"), back)))

    def top(self, back: int = 0) -> str:
        return f"greatest({self.price('o', back)}, {self.price('c', back)})"

    def bottom(self, back: int = 0) -> str:
        return f"least({self.price('o', back)}, {self.price('c', back)})"

    def upper(self, back: int = 0) -> str:
        return f"({self.price('h', back)} - {self.top(back)})"

    def lower(self, back: int = 0) -> str:
        return f"({self.bottom(back)} - {self.price('l', back)})"

    def white(self, back: int = 0) -> str:
        return f"{self.price('c', back)} >= {self.price('o', back)}"

    def black(self, back: int = 0) -> str:
        return f"{self.price('c', back)} < {self.price('o', back)}"

    def gap_up(self, later: int, earlier: int) -> str:
        return f"{self.bottom(later)} > {self.top(earlier)}"

    def gap_down(self, later: int, earlier: int) -> str:
        return f"{self.top(later)} < {self.bottom(earlier)}"

    def cases(self, *cases: tuple[int | str, list[str]]):
        text = " ".join(f"WHEN {' AND '.join(tests)} THEN {value if isinstance(value, str) else f'{value}e0'}" for value, tests in cases)
        return self.c.join(f"CASE {text} ELSE 0e0 END", *self.parts)

    def colour(self, back: int = 0) -> str:
        return f"CASE WHEN {self.white(back)} THEN 100e0 ELSE -100e0 END"


def pattern(name: str):
    def add(make):
        @function(name, "W", (0, 4))
        def emit(c, *ohlc):
            ohlc = ohlc or tuple(c.name(x) for x in ("OPEN", "HIGH", "LOW", "CLOSE"))
            return make(Bar(c, *ohlc))

        return make

    return add


@pattern("CDLDOJI")
def _doji(b):
    return b.cases((100, [f"{b.body()} <= {b.limit('body_doji')}"]))


@pattern("CDLLONGLEGGEDDOJI")
def _long_legged(b):
    return b.cases((100, [f"{b.body()} <= {b.limit('body_doji')}", f"({b.upper()} > {b.limit('shadow_long')} OR {b.lower()} > {b.limit('shadow_long')})"]))


@pattern("CDLDRAGONFLYDOJI")
def _dragonfly(b):
    return b.cases((100, [f"{b.body()} <= {b.limit('body_doji')}", f"{b.upper()} < {b.limit('shadow_very_short')}", f"{b.lower()} > {b.limit('shadow_very_short')}"]))


@pattern("CDLGRAVESTONEDOJI")
def _gravestone(b):
    return b.cases((100, [f"{b.body()} <= {b.limit('body_doji')}", f"{b.lower()} < {b.limit('shadow_very_short')}", f"{b.upper()} > {b.limit('shadow_very_short')}"]))


@pattern("CDLTAKURI")
def _takuri(b):
    return b.cases((100, [f"{b.body()} <= {b.limit('body_doji')}", f"{b.upper()} < {b.limit('shadow_very_short')}", f"{b.lower()} > {b.limit('shadow_very_long')}"]))


@pattern("CDLMARUBOZU")
def _marubozu(b):
    return b.cases((b.colour(), [f"{b.body()} > {b.limit('body_long')}", f"{b.upper()} < {b.limit('shadow_very_short')}", f"{b.lower()} < {b.limit('shadow_very_short')}"]))


@pattern("CDLCLOSINGMARUBOZU")
def _closing_marubozu(b):
    near = f"(({b.white()} AND {b.upper()} < {b.limit('shadow_very_short')}) OR ({b.black()} AND {b.lower()} < {b.limit('shadow_very_short')}))"
    return b.cases((b.colour(), [f"{b.body()} > {b.limit('body_long')}", near]))


@pattern("CDLBELTHOLD")
def _belt_hold(b):
    near = f"(({b.white()} AND {b.lower()} < {b.limit('shadow_very_short')}) OR ({b.black()} AND {b.upper()} < {b.limit('shadow_very_short')}))"
    return b.cases((b.colour(), [f"{b.body()} > {b.limit('body_long')}", near]))


@pattern("CDLLONGLINE")
def _long_line(b):
    return b.cases((b.colour(), [f"{b.body()} > {b.limit('body_long')}", f"{b.upper()} < {b.limit('shadow_short')}", f"{b.lower()} < {b.limit('shadow_short')}"]))


@pattern("CDLSHORTLINE")
def _short_line(b):
    return b.cases((b.colour(), [f"{b.body()} < {b.limit('body_short')}", f"{b.upper()} < {b.limit('shadow_short')}", f"{b.lower()} < {b.limit('shadow_short')}"]))


@pattern("CDLSPINNINGTOP")
def _spinning_top(b):
    return b.cases((b.colour(), [f"{b.body()} < {b.limit('body_short')}", f"{b.upper()} > {b.body()}", f"{b.lower()} > {b.body()}"]))


@pattern("CDLHIGHWAVE")
def _high_wave(b):
    return b.cases((b.colour(), [f"{b.body()} < {b.limit('body_short')}", f"{b.upper()} > {b.limit('shadow_very_long')}", f"{b.lower()} > {b.limit('shadow_very_long')}"]))


@pattern("CDLHAMMER")
def _hammer(b):
    return b.cases((100, [f"{b.body()} < {b.limit('body_short')}", f"{b.lower()} > {b.limit('shadow_long')}", f"{b.upper()} < {b.limit('shadow_very_short')}", f"{b.bottom()} <= {b.price('l', 1)} + {b.limit('near', 1)}"]))


@pattern("CDLHANGINGMAN")
def _hanging_man(b):
    return b.cases((-100, [f"{b.body()} < {b.limit('body_short')}", f"{b.lower()} > {b.limit('shadow_long')}", f"{b.upper()} < {b.limit('shadow_very_short')}", f"{b.bottom()} >= {b.price('h', 1)} - {b.limit('near', 1)}"]))


@pattern("CDLINVERTEDHAMMER")
def _inverted_hammer(b):
    return b.cases((100, [f"{b.body()} < {b.limit('body_short')}", f"{b.upper()} > {b.limit('shadow_long')}", f"{b.lower()} < {b.limit('shadow_very_short')}", b.gap_down(0, 1)]))


@pattern("CDLSHOOTINGSTAR")
def _shooting_star(b):
    return b.cases((-100, [f"{b.body()} < {b.limit('body_short')}", f"{b.upper()} > {b.limit('shadow_long')}", f"{b.lower()} < {b.limit('shadow_very_short')}", b.gap_up(0, 1)]))


@pattern("CDLHARAMI")
def _harami(b):
    big, small = f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.body()} <= {b.limit('body_short')}"
    inside = [f"{b.top()} < {b.top(1)}", f"{b.bottom()} > {b.bottom(1)}"]
    touching = [f"{b.top()} <= {b.top(1)}", f"{b.bottom()} >= {b.bottom(1)}"]
    strong, weak = (f"CASE WHEN {b.white(1)} THEN -{v}e0 ELSE {v}e0 END" for v in (100, 80))
    return b.cases((strong, [big, small, *inside]), (weak, [big, small, *touching]))


@pattern("CDLHARAMICROSS")
def _harami_cross(b):
    big, small = f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.body()} <= {b.limit('body_doji')}"
    inside = [f"{b.top()} < {b.top(1)}", f"{b.bottom()} > {b.bottom(1)}"]
    touching = [f"{b.top()} <= {b.top(1)}", f"{b.bottom()} >= {b.bottom(1)}"]
    strong, weak = (f"CASE WHEN {b.white(1)} THEN -{v}e0 ELSE {v}e0 END" for v in (100, 80))
    return b.cases((strong, [big, small, *inside]), (weak, [big, small, *touching]))


@pattern("CDLDOJISTAR")
def _doji_star(b):
    big, small = f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.body()} <= {b.limit('body_doji')}"
    return b.cases((-100, [big, small, b.white(1), b.gap_up(0, 1)]), (100, [big, small, b.black(1), b.gap_down(0, 1)]))


@pattern("CDLPIERCING")
def _piercing(b):
    return b.cases((100, [b.black(1), f"{b.body(1)} > {b.limit('body_long', 1)}", b.white(), f"{b.body()} > {b.limit('body_long')}", f"{b.price('o')} < {b.price('l', 1)}", f"{b.price('c')} < {b.price('o', 1)}", f"{b.price('c')} > {b.price('c', 1)} + {b.body(1)} * 5e-1"]))


@pattern("CDLDARKCLOUDCOVER")
def _dark_cloud(b):
    return b.cases((-100, [b.white(1), f"{b.body(1)} > {b.limit('body_long', 1)}", b.black(), f"{b.price('o')} > {b.price('h', 1)}", f"{b.price('c')} > {b.price('o', 1)}", f"{b.price('c')} < {b.price('c', 1)} - {b.body(1)} * 5e-1"]))


@pattern("CDLHOMINGPIGEON")
def _homing_pigeon(b):
    return b.cases((100, [b.black(1), b.black(), f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.body()} <= {b.limit('body_short')}", f"{b.price('o')} < {b.price('o', 1)}", f"{b.price('c')} > {b.price('c', 1)}"]))


@pattern("CDLMATCHINGLOW")
def _matching_low(b):
    e = b.limit("equal", 1)
    return b.cases((100, [b.black(1), b.black(), f"{b.price('c')} <= {b.price('c', 1)} + {e}", f"{b.price('c')} >= {b.price('c', 1)} - {e}"]))


@pattern("CDL3INSIDE")
def _three_inside(b):
    first = [f"{b.body(2)} > {b.limit('body_long', 2)}", f"{b.body(1)} <= {b.limit('body_short', 1)}", f"{b.top(1)} < {b.top(2)}", f"{b.bottom(1)} > {b.bottom(2)}"]
    return b.cases((-100, [*first, b.white(2), b.black(), f"{b.price('c')} < {b.price('o', 2)}"]), (100, [*first, b.black(2), b.white(), f"{b.price('c')} > {b.price('o', 2)}"]))


@pattern("CDL3OUTSIDE")
def _three_outside(b):
    up = [b.white(1), b.black(2), f"{b.price('c', 1)} > {b.price('o', 2)}", f"{b.price('o', 1)} < {b.price('c', 2)}", f"{b.price('c')} > {b.price('c', 1)}"]
    down = [b.black(1), b.white(2), f"{b.price('o', 1)} > {b.price('c', 2)}", f"{b.price('c', 1)} < {b.price('o', 2)}", f"{b.price('c')} < {b.price('c', 1)}"]
    return b.cases((100, up), (-100, down))


@pattern("CDLMORNINGSTAR")
def _morning_star(b):
    return b.cases((100, [f"{b.body(2)} > {b.limit('body_long', 2)}", b.black(2), f"{b.body(1)} <= {b.limit('body_short', 1)}", b.gap_down(1, 2), f"{b.body()} > {b.limit('body_short')}", b.white(), f"{b.price('c')} > {b.price('c', 2)} + {b.body(2)} * 3e-1"]))


@pattern("CDLEVENINGSTAR")
def _evening_star(b):
    return b.cases((-100, [f"{b.body(2)} > {b.limit('body_long', 2)}", b.white(2), f"{b.body(1)} <= {b.limit('body_short', 1)}", b.gap_up(1, 2), f"{b.body()} > {b.limit('body_short')}", b.black(), f"{b.price('c')} < {b.price('c', 2)} - {b.body(2)} * 3e-1"]))


@pattern("CDLUPSIDEGAP2CROWS")
def _upside_gap_two_crows(b):
    return b.cases((-100, [b.white(2), f"{b.body(2)} > {b.limit('body_long', 2)}", b.black(1), f"{b.body(1)} <= {b.limit('body_short', 1)}", b.gap_up(1, 2), b.black(), f"{b.price('o')} > {b.price('o', 1)}", f"{b.price('c')} < {b.price('c', 1)}", f"{b.price('c')} > {b.price('c', 2)}"]))


@pattern("CDL2CROWS")
def _two_crows(b):
    return b.cases((-100, [b.white(2), f"{b.body(2)} > {b.limit('body_long', 2)}", b.black(1), b.gap_up(1, 2), b.black(), f"{b.price('o')} < {b.price('o', 1)}", f"{b.price('o')} > {b.price('c', 1)}", f"{b.price('c')} > {b.price('o', 2)}", f"{b.price('c')} < {b.price('c', 2)}"]))


@pattern("CDLTRISTAR")
def _tristar(b):
    doji = [f"{b.body(k)} <= {b.limit('body_doji', 2)}" for k in (2, 1, 0)]
    return b.cases((-100, [*doji, b.gap_up(1, 2), f"{b.top()} < {b.top(1)}"]), (100, [*doji, b.gap_down(1, 2), f"{b.bottom()} > {b.bottom(1)}"]))


@pattern("CDLENGULFING")
def _engulfing(b):
    up = [b.white(), b.black(1)]
    down = [b.black(), b.white(1)]
    wide_up = [f"{b.price('c')} >= {b.price('o', 1)}", f"{b.price('o')} <= {b.price('c', 1)}"]
    wide_down = [f"{b.price('o')} >= {b.price('c', 1)}", f"{b.price('c')} <= {b.price('o', 1)}"]
    ends_up = f"({b.price('c')} > {b.price('o', 1)} OR {b.price('o')} < {b.price('c', 1)})"
    ends_down = f"({b.price('o')} > {b.price('c', 1)} OR {b.price('c')} < {b.price('o', 1)})"
    both_up = f"CASE WHEN {b.price('o')} <> {b.price('c', 1)} AND {b.price('c')} <> {b.price('o', 1)} THEN 100e0 ELSE 80e0 END"
    both_down = f"CASE WHEN {b.price('o')} <> {b.price('c', 1)} AND {b.price('c')} <> {b.price('o', 1)} THEN -100e0 ELSE -80e0 END"
    return b.cases((both_up, [*up, *wide_up, ends_up]), (both_down, [*down, *wide_down, ends_down]))


def _about(b, x: str, y: str, setting: str, back: int) -> str:
    e = b.limit(setting, back)
    return f"{x} <= {y} + {e} AND {x} >= {y} - {e}"


@pattern("CDLRICKSHAWMAN")
def _rickshaw_man(b):
    near = b.limit("near")
    middle = f"({b.price('l')} + {b.span()} / 2e0)"
    return b.cases((100, [f"{b.body()} <= {b.limit('body_doji')}", f"{b.lower()} > {b.limit('shadow_long')}", f"{b.upper()} > {b.limit('shadow_long')}", f"{b.bottom()} <= {middle} + {near}", f"{b.top()} >= {middle} - {near}"]))


@pattern("CDL3BLACKCROWS")
def _three_black_crows(b):
    falls = [t for k in (2, 1, 0) for t in (b.black(k), f"{b.lower(k)} < {b.limit('shadow_very_short', k)}")]
    steps = [t for k in (1, 0) for t in (f"{b.price('o', k)} < {b.price('o', k + 1)}", f"{b.price('o', k)} > {b.price('c', k + 1)}", f"{b.price('c', k + 1)} > {b.price('c', k)}")]
    return b.cases((-100, [b.white(3), f"{b.price('h', 3)} > {b.price('c', 2)}", *falls, *steps]))


@pattern("CDLIDENTICAL3CROWS")
def _identical_three_crows(b):
    falls = [t for k in (2, 1, 0) for t in (b.black(k), f"{b.lower(k)} < {b.limit('shadow_very_short', k)}")]
    opens = [_about(b, b.price("o", k), b.price("c", k + 1), "equal", k + 1) for k in (1, 0)]
    return b.cases((-100, [*falls, *opens, f"{b.price('c', 2)} > {b.price('c', 1)}", f"{b.price('c', 1)} > {b.price('c')}"]))


def _rising(b) -> list[str]:
    return [b.white(2), b.white(1), b.white(), f"{b.price('c')} > {b.price('c', 1)}", f"{b.price('c', 1)} > {b.price('c', 2)}"]


@pattern("CDL3WHITESOLDIERS")
def _three_white_soldiers(b):
    short = [f"{b.upper(k)} < {b.limit('shadow_very_short', k)}" for k in (2, 1, 0)]
    opens = [t for k in (1, 0) for t in (f"{b.price('o', k)} > {b.price('o', k + 1)}", f"{b.price('o', k)} <= {b.price('c', k + 1)} + {b.limit('near', k + 1)}")]
    sizes = [f"{b.body(k)} > {b.body(k + 1)} - {b.limit('far', k + 1)}" for k in (1, 0)]
    return b.cases((100, [*_rising(b), *short, *opens, *sizes, f"{b.body()} > {b.limit('body_short')}"]))


@pattern("CDLADVANCEBLOCK")
def _advance_block(b):
    opens = [t for k in (1, 0) for t in (f"{b.price('o', k)} > {b.price('o', k + 1)}", f"{b.price('o', k)} <= {b.price('c', k + 1)} + {b.limit('near', k + 1)}")]
    first = [f"{b.body(2)} > {b.limit('body_long', 2)}", f"{b.upper(2)} < {b.limit('shadow_short', 2)}"]
    weak = [
        f"({b.body(1)} < {b.body(2)} - {b.limit('far', 2)} AND {b.body()} < {b.body(1)} + {b.limit('near', 1)})",
        f"{b.body()} < {b.body(1)} - {b.limit('far', 1)}",
        f"({b.body()} < {b.body(1)} AND {b.body(1)} < {b.body(2)} AND ({b.upper()} > {b.limit('shadow_short')} OR {b.upper(1)} > {b.limit('shadow_short', 1)}))",
        f"({b.body()} < {b.body(1)} AND {b.upper()} > {b.limit('shadow_long')})",
    ]
    return b.cases((-100, [*_rising(b), *opens, *first, f"({' OR '.join(weak)})"]))


@pattern("CDLSTALLEDPATTERN")
def _stalled(b):
    return b.cases((-100, [
        *_rising(b), f"{b.body(2)} > {b.limit('body_long', 2)}", f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.upper(1)} < {b.limit('shadow_very_short', 1)}",
        f"{b.price('o', 1)} > {b.price('o', 2)}", f"{b.price('o', 1)} <= {b.price('c', 2)} + {b.limit('near', 2)}", f"{b.body()} < {b.limit('body_short')}",
        f"{b.price('o')} >= {b.price('c', 1)} - {b.body()} - {b.limit('near', 1)}",
    ]))


@pattern("CDL3LINESTRIKE")
def _three_line_strike(b):
    def inside(k):
        e = b.limit("near", k + 1)
        return f"{b.price('o', k)} >= {b.bottom(k + 1)} - {e} AND {b.price('o', k)} <= {b.top(k + 1)} + {e}"

    up = [b.white(3), b.white(2), b.white(1), b.black(), inside(2), inside(1), f"{b.price('c', 1)} > {b.price('c', 2)}", f"{b.price('c', 2)} > {b.price('c', 3)}", f"{b.price('o')} > {b.price('c', 1)}", f"{b.price('c')} < {b.price('o', 3)}"]
    down = [b.black(3), b.black(2), b.black(1), b.white(), inside(2), inside(1), f"{b.price('c', 1)} < {b.price('c', 2)}", f"{b.price('c', 2)} < {b.price('c', 3)}", f"{b.price('o')} < {b.price('c', 1)}", f"{b.price('c')} > {b.price('o', 3)}"]
    return b.cases((100, up), (-100, down))


@pattern("CDL3STARSINSOUTH")
def _three_stars(b):
    return b.cases((100, [
        b.black(2), b.black(1), b.black(), f"{b.body(2)} > {b.limit('body_long', 2)}", f"{b.lower(2)} > {b.limit('shadow_long', 2)}", f"{b.body(1)} < {b.body(2)}",
        f"{b.price('o', 1)} > {b.price('c', 2)}", f"{b.price('o', 1)} <= {b.price('h', 2)}", f"{b.price('l', 1)} < {b.price('c', 2)}", f"{b.price('l', 1)} >= {b.price('l', 2)}",
        f"{b.lower(1)} > {b.limit('shadow_very_short', 1)}", f"{b.body()} < {b.limit('body_short')}", f"{b.lower()} < {b.limit('shadow_very_short')}", f"{b.upper()} < {b.limit('shadow_very_short')}",
        f"{b.price('l')} > {b.price('l', 1)}", f"{b.price('h')} < {b.price('h', 1)}",
    ]))


def _star(b, up: bool, star: list[str], depth: float) -> tuple:
    first, last = (b.white(2), b.black()) if up else (b.black(2), b.white())
    deep = f"{b.price('c')} < {b.price('c', 2)} - {b.body(2)} * {depth!r}e0" if up else f"{b.price('c')} > {b.price('c', 2)} + {b.body(2)} * {depth!r}e0"
    return (-100 if up else 100, [f"{b.body(2)} > {b.limit('body_long', 2)}", first, f"{b.body(1)} <= {b.limit('body_doji', 1)}", *star, f"{b.body()} > {b.limit('body_short')}", last, deep])


@pattern("CDLEVENINGDOJISTAR")
def _evening_doji_star(b):
    return b.cases(_star(b, True, [b.gap_up(1, 2)], 0.3))


@pattern("CDLMORNINGDOJISTAR")
def _morning_doji_star(b):
    return b.cases(_star(b, False, [b.gap_down(1, 2)], 0.3))


@pattern("CDLABANDONEDBABY")
def _abandoned_baby(b):
    above = [f"{b.price('l', 1)} > {b.price('h', 2)}", f"{b.price('h')} < {b.price('l', 1)}"]
    below = [f"{b.price('h', 1)} < {b.price('l', 2)}", f"{b.price('l')} > {b.price('h', 1)}"]
    return b.cases(_star(b, True, above, 0.3), _star(b, False, below, 0.3))


@pattern("CDLCOUNTERATTACK")
def _counterattack(b):
    big = [f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.body()} > {b.limit('body_long')}", _about(b, b.price("c"), b.price("c", 1), "equal", 1)]
    return b.cases((100, [b.black(1), b.white(), *big]), (-100, [b.white(1), b.black(), *big]))


@pattern("CDLSEPARATINGLINES")
def _separating_lines(b):
    same = [_about(b, b.price("o"), b.price("o", 1), "equal", 1), f"{b.body()} > {b.limit('body_long')}"]
    return b.cases((100, [b.black(1), b.white(), *same, f"{b.lower()} < {b.limit('shadow_very_short')}"]), (-100, [b.white(1), b.black(), *same, f"{b.upper()} < {b.limit('shadow_very_short')}"]))


def _neck(b, *last: str):
    return b.cases((-100, [b.black(1), f"{b.body(1)} > {b.limit('body_long', 1)}", b.white(), f"{b.price('o')} < {b.price('l', 1)}", *last]))


@pattern("CDLINNECK")
def _in_neck(b):
    return _neck(b, f"{b.price('c')} <= {b.price('c', 1)} + {b.limit('equal', 1)}", f"{b.price('c')} >= {b.price('c', 1)}")


@pattern("CDLONNECK")
def _on_neck(b):
    return _neck(b, _about(b, b.price("c"), b.price("l", 1), "equal", 1))


@pattern("CDLTHRUSTING")
def _thrusting(b):
    return _neck(b, f"{b.price('c')} > {b.price('c', 1)} + {b.limit('equal', 1)}", f"{b.price('c')} <= {b.price('c', 1)} + {b.body(1)} * 5e-1")


def _kicks(b) -> list[str]:
    bare = [f"{side(k)} < {b.limit('shadow_very_short', k)}" for k in (1, 0) for side in (b.upper, b.lower)]
    gap = f"(({b.black(1)} AND {b.white()} AND {b.price('l')} > {b.price('h', 1)}) OR ({b.white(1)} AND {b.black()} AND {b.price('h')} < {b.price('l', 1)}))"
    return [f"{b.body(1)} > {b.limit('body_long', 1)}", f"{b.body()} > {b.limit('body_long')}", *bare, gap]


@pattern("CDLKICKING")
def _kicking(b):
    return b.cases((b.colour(), _kicks(b)))


@pattern("CDLKICKINGBYLENGTH")
def _kicking_by_length(b):
    return b.cases((f"CASE WHEN {b.body()} > {b.body(1)} THEN {b.colour()} ELSE {b.colour(1)} END", _kicks(b)))


@pattern("CDLGAPSIDESIDEWHITE")
def _side_by_side_white(b):
    alike = [b.white(1), b.white(), _about(b, b.body(), b.body(1), "near", 1), _about(b, b.price("o"), b.price("o", 1), "equal", 1)]
    return b.cases((100, [b.gap_up(1, 2), b.gap_up(0, 2), *alike]), (-100, [b.gap_down(1, 2), b.gap_down(0, 2), *alike]))


@pattern("CDLTASUKIGAP")
def _tasuki_gap(b):
    e = b.limit("near", 1)
    alike = f"abs({b.body(1)} - {b.body()}) < {e}"
    up = [b.gap_up(1, 2), b.white(1), b.black(), f"{b.price('o')} < {b.price('c', 1)}", f"{b.price('o')} > {b.price('o', 1)}", f"{b.price('c')} < {b.price('o', 1)}", f"{b.price('c')} > {b.top(2)}", alike]
    down = [b.gap_down(1, 2), b.black(1), b.white(), f"{b.price('o')} < {b.price('o', 1)}", f"{b.price('o')} > {b.price('c', 1)}", f"{b.price('c')} > {b.price('o', 1)}", f"{b.price('c')} < {b.bottom(2)}", alike]
    return b.cases((100, up), (-100, down))


@pattern("CDLXSIDEGAP3METHODS")
def _gap_three_methods(b):
    within = [f"{b.price('o')} < {b.top(1)}", f"{b.price('o')} > {b.bottom(1)}", f"{b.price('c')} < {b.top(2)}", f"{b.price('c')} > {b.bottom(2)}"]
    return b.cases((100, [b.white(2), b.white(1), b.black(), *within, b.gap_up(1, 2)]), (-100, [b.black(2), b.black(1), b.white(), *within, b.gap_down(1, 2)]))


@pattern("CDLSTICKSANDWICH")
def _stick_sandwich(b):
    return b.cases((100, [b.black(2), b.white(1), b.black(), f"{b.price('l', 1)} > {b.price('c', 2)}", _about(b, b.price("c"), b.price("c", 2), "equal", 2)]))


@pattern("CDLUNIQUE3RIVER")
def _unique_three_river(b):
    return b.cases((100, [
        f"{b.body(2)} > {b.limit('body_long', 2)}", b.black(2), b.black(1), f"{b.price('c', 1)} > {b.price('c', 2)}", f"{b.price('o', 1)} <= {b.price('o', 2)}", f"{b.price('l', 1)} < {b.price('l', 2)}",
        f"{b.body()} < {b.limit('body_short')}", b.white(), f"{b.price('o')} > {b.price('l', 1)}",
    ]))


@pattern("CDLLADDERBOTTOM")
def _ladder_bottom(b):
    falls = [b.black(4), b.black(3), b.black(2), f"{b.price('o', 4)} > {b.price('o', 3)}", f"{b.price('o', 3)} > {b.price('o', 2)}", f"{b.price('c', 4)} > {b.price('c', 3)}", f"{b.price('c', 3)} > {b.price('c', 2)}"]
    return b.cases((100, [*falls, b.black(1), f"{b.upper(1)} > {b.limit('shadow_very_short', 1)}", b.white(), f"{b.price('o')} > {b.price('o', 1)}", f"{b.price('c')} > {b.price('h', 1)}"]))


@pattern("CDLCONCEALBABYSWALL")
def _concealing_baby(b):
    bare = [f"{side(k)} < {b.limit('shadow_very_short', k)}" for k in (3, 2) for side in (b.upper, b.lower)]
    return b.cases((100, [
        b.black(3), b.black(2), b.black(1), b.black(), *bare, b.gap_down(1, 2), f"{b.upper(1)} > {b.limit('shadow_very_short', 1)}", f"{b.price('h', 1)} > {b.price('c', 2)}",
        f"{b.price('h')} > {b.price('h', 1)}", f"{b.price('l')} < {b.price('l', 1)}",
    ]))


@pattern("CDLBREAKAWAY")
def _breakaway(b):
    big = f"{b.body(4)} > {b.limit('body_long', 4)}"
    down = [big, b.black(4), b.black(3), b.black(1), b.white(), b.gap_down(3, 4), f"{b.price('h', 2)} < {b.price('h', 3)}", f"{b.price('l', 2)} < {b.price('l', 3)}", f"{b.price('h', 1)} < {b.price('h', 2)}", f"{b.price('l', 1)} < {b.price('l', 2)}", f"{b.price('c')} > {b.price('o', 3)}", f"{b.price('c')} < {b.price('c', 4)}"]
    up = [big, b.white(4), b.white(3), b.white(1), b.black(), b.gap_up(3, 4), f"{b.price('h', 2)} > {b.price('h', 3)}", f"{b.price('l', 2)} > {b.price('l', 3)}", f"{b.price('h', 1)} > {b.price('h', 2)}", f"{b.price('l', 1)} > {b.price('l', 2)}", f"{b.price('c')} < {b.price('o', 3)}", f"{b.price('c')} > {b.price('c', 4)}"]
    return b.cases((100, down), (-100, up))


PATTERNS = (
    "CDLDOJI", "CDLLONGLEGGEDDOJI", "CDLDRAGONFLYDOJI", "CDLGRAVESTONEDOJI", "CDLTAKURI", "CDLMARUBOZU", "CDLCLOSINGMARUBOZU", "CDLBELTHOLD", "CDLLONGLINE", "CDLSHORTLINE",
    "CDLSPINNINGTOP", "CDLHIGHWAVE", "CDLHAMMER", "CDLHANGINGMAN", "CDLINVERTEDHAMMER", "CDLSHOOTINGSTAR", "CDLHARAMI", "CDLHARAMICROSS", "CDLDOJISTAR", "CDLPIERCING",
    "CDLDARKCLOUDCOVER", "CDLHOMINGPIGEON", "CDLMATCHINGLOW", "CDL3INSIDE", "CDL3OUTSIDE", "CDLMORNINGSTAR", "CDLEVENINGSTAR", "CDLUPSIDEGAP2CROWS", "CDL2CROWS", "CDLTRISTAR", "CDLENGULFING",
    "CDLRICKSHAWMAN", "CDL3BLACKCROWS", "CDLIDENTICAL3CROWS", "CDL3WHITESOLDIERS", "CDLADVANCEBLOCK", "CDLSTALLEDPATTERN", "CDL3LINESTRIKE", "CDL3STARSINSOUTH", "CDLEVENINGDOJISTAR", "CDLMORNINGDOJISTAR",
    "CDLABANDONEDBABY", "CDLCOUNTERATTACK", "CDLSEPARATINGLINES", "CDLINNECK", "CDLONNECK", "CDLTHRUSTING", "CDLKICKING", "CDLKICKINGBYLENGTH", "CDLGAPSIDESIDEWHITE", "CDLTASUKIGAP",
    "CDLXSIDEGAP3METHODS", "CDLSTICKSANDWICH", "CDLUNIQUE3RIVER", "CDLLADDERBOTTOM", "CDLCONCEALBABYSWALL", "CDLBREAKAWAY",
)
