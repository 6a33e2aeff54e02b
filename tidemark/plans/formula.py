"""Formula language: text to tree, and tree to staged window queries.

A formula is a list of statements ``NAME := expr;`` (local), ``NAME : expr;`` (output) and ``expr;``. The
planner gives every windowed subexpression a column in the first stage where its inputs exist, shares
equal ones, and emits one projection per stage, so a formula of any depth is a chain of window
projections over one partitioning: one shuffle by symbol and timeframe, one sort, no joins. Recursive
functions close a stage with one grouped kernel that runs all of that stage's recursions together.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from tidemark.functions.registry import REGISTRY

MAX_SOURCE, MAX_DEPTH, MAX_LOOP = 1 << 20, 256, 10_000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * MAX_DEPTH))  # a level of the formula takes some frames
MARKET = {"OPEN": "open", "O": "open", "HIGH": "high", "H": "high", "LOW": "low", "L": "low", "CLOSE": "close", "C": "close", "VOL": "volume", "V": "volume", "VOLUME": "volume", "AMOUNT": "amount"}

_TOKEN = re.compile(
    r"\s+|//[^\n]*|\{[^}]*\}|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<name>[^\W\d]\w*)|(?P<op>:=|\+=|-=|\*=|/=|>=|<=|<>|!=|==|&&|\|\||[-+*/%^<>=!(),;:\[\]&])"
)
_LEVELS = [{"OR", "||", "XOR"}, {"AND", "&&"}, {">", "<", ">=", "<=", "=", "==", "!=", "<>"}, {"+", "-"}, {"*", "/", "%", "MOD"}]
_WORDS = {"AND", "OR", "XOR", "MOD", "NOT"}


class FormulaError(ValueError):
    pass


def tokenize(source: str) -> list[tuple[str, str]]:
    if len(source) > MAX_SOURCE:
        raise FormulaError("the formula is too long")
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise FormulaError(f"unexpected {source[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            text = m.group()
            if m.lastgroup == "name" and text.upper() in _WORDS:
                out.append(("op", text.upper()))
            else:
                out.append((m.lastgroup, text))
    return out


@dataclass
class Statement:
    kind: str  # local, output, expr
    name: str
    tree: tuple


class Parser:
    """Precedence climbing; ``^`` binds tightest and does not chain, unary minus is looser than it."""

    def __init__(self, source: str):
        self.tokens = tokenize(source)
        self.at = 0
        self.depth = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if text is not None and t[1].upper() != text:
            raise FormulaError(f"expected {text}, found {t[1] or 'the end'}")
        self.at += 1
        return t

    def statements(self) -> list[Statement]:
        out = []
        while self.peek()[0] != "end":
            if self.peek() == ("op", ";"):
                self.take()
                continue
            out += self.statement()
        return out

    def statement(self) -> list[Statement]:
        kind, text = self.peek()
        if kind == "name" and text.upper() == "FOR":
            return self.loop()
        if kind == "name" and text.upper() == "PARAMS":
            raise FormulaError("PARAMS stand before the formula; pass them as params")
        if kind == "name" and self.peek(1)[0] == "op" and self.peek(1)[1] in (":=", ":", "=", "+=", "-=", "*=", "/="):
            name = self.take()[1].upper()
            op = self.take()[1]
            tree = self.expression()
            if op in ("+=", "-=", "*=", "/="):
                tree = ("bin", op[0], ("name", name), tree)
            made = [Statement("output" if op == ":" else "local", name, tree)]
        else:
            made = [Statement("expr", "", self.expression())]
        while self.peek() == ("op", ","):  # drawing attributes
            self.take()
            self.take()
        if self.peek()[0] != "end":
            self.take(";")
        return made

    def loop(self) -> list[Statement]:
        """FOR I = a TO b DO ... END with constant bounds, unrolled."""
        self.take("FOR")
        name = self.take()[1].upper()
        self.take()
        low = self.constant()
        self.take("TO")
        high = self.constant()
        self.take("DO")
        start, out = self.at, []
        if high - low + 1 > MAX_LOOP:
            raise FormulaError("too many turns of a loop")
        for i in range(low, high + 1):
            self.at = start
            out.append(Statement("local", name, ("num", float(i))))
            while self.peek()[1].upper() != "END":
                if self.peek()[0] == "end":
                    raise FormulaError("a loop has no END")
                out += self.statement()
        if high < low:
            while self.peek()[1].upper() != "END":
                self.take()
        self.take("END")
        if self.peek() == ("op", ";"):
            self.take()
        return out

    def constant(self) -> int:
        sign = 1
        if self.peek() == ("op", "-"):
            self.take()
            sign = -1
        kind, text = self.take()
        if kind != "num":
            raise FormulaError("a loop needs constant bounds")
        return sign * int(float(text))

    def expression(self, level: int = 0) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH * (len(_LEVELS) + 1):
            raise FormulaError("the formula is nested too deep")
        try:
            if level == len(_LEVELS):
                return self.unary()
            left = self.expression(level + 1)
            while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[level]:
                op = self.take()[1]
                left = ("bin", op, left, self.expression(level + 1))
            return left
        finally:
            self.depth -= 1

    def unary(self) -> tuple:
        kind, text = self.peek()
        if kind == "op" and text in ("-", "+", "NOT", "!"):
            self.take()
            inner = self.unary()
            return inner if text == "+" else ("neg", inner) if text == "-" else ("not", inner)
        left = self.postfix()
        if self.peek() == ("op", "^"):
            self.take()
            sign = self.peek() == ("op", "-")
            if sign:
                self.take()
            right = self.postfix()
            left = ("bin", "^", left, ("neg", right) if sign else right)
        return left

    def postfix(self) -> tuple:
        kind, text = self.take()
        if kind == "num":
            return ("num", float(text))
        if kind == "str":
            return ("str", text[1:-1])
        if (kind, text) == ("op", "("):
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "op" and text == "MOD" and self.peek() == ("op", "("):
            kind = "name"
        if kind == "name":
            name = text.upper()
            if name == "IF" and self.peek() != ("op", "("):
                test = self.expression()
                self.take("THEN")
                then = self.expression()
                other = ("num", 0.0)
                if self.peek()[1].upper() == "ELSE":
                    self.take()
                    other = self.expression()
                return ("call", "IF", (test, then, other))
            if self.peek() == ("op", "("):
                self.take()
                args = []
                while self.peek() != ("op", ")"):
                    args.append(self.expression())
                    if self.peek() == ("op", ","):
                        self.take()
                self.take(")")
                return ("call", name, tuple(args))
            return ("name", name)
        raise FormulaError(f"unexpected {text or 'end of the formula'}")


@dataclass(frozen=True)
class Expr:
    """SQL text that can stand in the projection of stage ``level``; ``over``: it has a window in it."""

    text: str
    level: int = 0
    over: bool = False
    const: float | None = None


SPARK, DUCK = "spark", "duck"


def rounded(text: str, digits: int) -> str:
    return f"CASE WHEN abs({text}) < 9e{18 - digits} THEN floor(({text}) * 1e{digits} + 0.3e0) / 1e{digits} ELSE {text} END"


class Compiler:
    """Turns trees into staged projections for one dialect."""

    KEYS = "symbol, timeframe"

    def __init__(self, columns: set[str] | None = None, dialect: str = SPARK, params: dict[str, float] | None = None):
        self.dialect = dialect
        self.columns = columns or set(MARKET.values())
        self.stages: list[dict[str, str]] = []
        self.kernels: list[list[tuple]] = []  # recursive functions that run after a stage: (column, kernel, inputs, params)
        self.known: dict[tuple[str, int], Expr] = {}
        self.names: dict[str, Expr] = {k: self.number(v) for k, v in (params or {}).items()}
        self.outputs: dict[str, Expr] = {}

    # -- building blocks ----------------------------------------------------------------------------

    def number(self, v: float) -> Expr:
        return Expr(f"{int(v)}e0" if float(v).is_integer() and abs(v) < 1e15 else f"{v!r}e0" if "e" not in repr(v) else repr(v), const=float(v))

    def join(self, text: str, *parts: Expr, over: bool = False) -> Expr:
        return Expr(text, max((p.level for p in parts), default=0), over or any(p.over for p in parts))

    def col(self, x: Expr | str) -> Expr:
        """``x`` as a column (a literal stays one)."""
        x = Expr(x) if isinstance(x, str) else x
        if x.const is not None or re.fullmatch(r"[a-z_]\w*", x.text):
            return x
        key = (x.text, x.level)
        if key not in self.known:
            while len(self.stages) <= x.level:
                self.stages.append({})
                self.kernels.append([])
            name = f"c{len(self.known)}"
            self.stages[x.level][name] = x.text
            self.known[key] = Expr(name, x.level + 1)
        return self.known[key]

    def kernel(self, kind: str, inputs: list[Expr], *params: float, part: int = 0) -> Expr:
        """The ``part``-th output of a recursive kernel over columns."""
        cols = [self.col(x) for x in inputs]
        level = max((c.level for c in cols), default=0)
        key = (f"{kind}({', '.join(c.text for c in cols)}; {params})#{part}", level)
        if key not in self.known:
            while len(self.stages) <= level:
                self.stages.append({})
                self.kernels.append([])
            name = f"c{len(self.known)}"
            self.kernels[level].append((name, kind, tuple(c.text for c in cols), tuple(params), part))
            self.known[key] = Expr(name, level + 2)
            while len(self.stages) <= level + 1:
                self.stages.append({})
                self.kernels.append([])
        return self.known[key]

    def frame(self, low: str, high: str = "CURRENT ROW") -> str:
        return f"OVER (PARTITION BY {self.KEYS} ORDER BY ts ROWS BETWEEN {low} AND {high})"

    def last(self, n: int) -> str:
        return self.frame(f"{n - 1} PRECEDING")

    def whole(self) -> str:
        return f"OVER (PARTITION BY {self.KEYS})"

    def full(self, n: int, agg: str, x: Expr, *others: Expr) -> Expr:
        """``agg`` (with {w} for the frame) where the last n rows of x are not NULL."""
        w = self.last(n)
        return self.join(f"CASE WHEN count({x.text}) {w} = {n} THEN {agg.format(w=w)} END", x, *others, over=True)

    def lag(self, x: Expr, n: int) -> Expr:
        x = self.col(x)
        if n == 0:
            return x
        name = "lag" if n > 0 else "lead"
        return self.join(f"{name}({x.text}, {abs(n)}) OVER (PARTITION BY {self.KEYS} ORDER BY ts)", x, over=True)

    def div(self, a: Expr, b: Expr, eps: str = "1e-15") -> Expr:
        b = self.col(b) if len(b.text) > 40 else b
        return self.join(f"CASE WHEN abs({b.text}) >= {eps} THEN ({a.text}) / ({b.text}) END", a, b)

    def flag(self, test: str, *parts: Expr) -> Expr:
        return self.join(f"CASE WHEN {test} THEN 1e0 ELSE 0e0 END", *parts)

    def int(self, x: Expr, what: str = "a period") -> int:
        if x.const is None:
            raise FormulaError(f"{what} must be a constant")
        n = int(x.const)
        if n < 0:
            raise FormulaError(f"{what} must not be negative")
        return n

    # -- trees --------------------------------------------------------------------------------------

    def compile(self, source: str) -> Compiler:
        last = None
        for s in Parser(source).statements():
            e = self.expr(s.tree)
            if s.kind == "expr":
                last = e
            else:
                e = e if e.const is not None else self.col(e)
                self.names[s.name] = e
                if s.kind == "output":
                    self.outputs[s.name] = e
                last = e
        if not self.outputs and last is not None:
            self.outputs["RESULT"] = last
        return self

    def expr(self, tree: tuple) -> Expr:
        kind = tree[0]
        if kind == "num":
            return self.number(tree[1])
        if kind == "str":
            raise FormulaError("a string is not a series")
        if kind == "name":
            return self.name(tree[1])
        if kind == "neg":
            x = self.expr(tree[1])
            return self.number(-x.const) if x.const is not None else self.join(f"(-({x.text}))", x)
        if kind == "not":
            return self.call("NOT", [self.expr(tree[1])])
        if kind == "bin":
            return self.binary(tree[1], self.expr(tree[2]), self.expr(tree[3]))
        return self.call(tree[1], [self.expr(a) for a in tree[2]])

    def name(self, name: str) -> Expr:
        if name in self.names:
            return self.names[name]
        if name in MARKET and MARKET[name] in self.columns:
            return Expr(MARKET[name])
        if name.lower() in self.columns:
            return Expr(name.lower())
        if name in REGISTRY and REGISTRY[name].least == 0:
            return self.call(name, [])
        raise FormulaError(f"unknown name {name}")

    def call(self, name: str, args: list[Expr]) -> Expr:
        f = REGISTRY.get(name)
        if f is None:
            raise FormulaError(f"unknown function {name}")
        if not f.least <= len(args) <= f.most:
            raise FormulaError(f"{name} takes {f.least} to {f.most} arguments, not {len(args)}")
        return f.emit(self, *args)

    def binary(self, op: str, a: Expr, b: Expr) -> Expr:
        if op in "+-*" and a.const is not None and b.const is not None:
            return self.number({"+": a.const + b.const, "-": a.const - b.const, "*": a.const * b.const}[op])
        x, y = f"({a.text})", f"({b.text})"
        if op in ("+", "-", "*"):
            return self.join(f"({x} {op} {y})", a, b)
        if op == "/":
            return self.div(a, b)
        if op in ("%", "MOD"):
            q = self.col(self.div(a, b))
            return self.join(f"({x} - floor({q.text}) * {y})", a, b, q)
        if op == "^":
            return self.join(f"power({x}, {y})", a, b)
        if op in (">", "<", ">=", "<="):
            return self.flag(f"{x} {op} {y}", a, b)
        if op in ("=", "=="):
            return self.flag(f"abs({x} - {y}) < 1e-10", a, b)
        if op in ("!=", "<>"):
            return self.flag(f"abs({x} - {y}) >= 1e-10", a, b)
        if op in ("AND", "&&"):
            return self.flag(f"{x} > 0 AND {y} > 0", a, b)
        if op in ("OR", "||"):
            return self.flag(f"{x} > 0 OR {y} > 0", a, b)
        if op == "XOR":
            return self.flag(f"coalesce({x} > 0, false) <> coalesce({y} > 0, false)", a, b)
        raise FormulaError(f"{op} does not work on numbers")

    # -- plans --------------------------------------------------------------------------------------

    def finish(self, keep: tuple[str, ...] = ("symbol", "timeframe", "ts"), digits: int | None = 6) -> str:
        """Materialises the outputs and returns the final projection's text.

        With ``digits``, outputs are rounded so that engines agree: up from 0.7 of the last decimal and not
        from its half, where finite decimals such as means of prices often lie. Values too large for a long
        of that many decimals stay as they are.
        """
        cols = {k: (v if v.const is not None else self.col(v)) for k, v in self.outputs.items()}
        shown = [f"{rounded(v.text, digits)} AS {k.lower()}" if digits is not None else f"{v.text} AS {k.lower()}" for k, v in cols.items()]
        return ", ".join([*keep, *shown])

    def sql(self, base: str, final: str) -> str:
        """One statement of staged CTEs over the relation ``base``; needs a formula without recursions."""
        if any(self.kernels):
            raise FormulaError("recursive functions have no SQL text")
        parts, prev = [f"s_in AS ({base})"], "s_in"
        for i, stage in enumerate(self.stages):
            if stage:
                parts.append(f"s{i} AS (SELECT *, {', '.join(f'{t} AS {n}' for n, t in stage.items())} FROM {prev})")
                prev = f"s{i}"
        return f"WITH {', '.join(parts)} SELECT {final} FROM {prev}"
