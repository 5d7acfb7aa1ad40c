"""Filter and projection expressions: parser, optimiser and compiler to Column.

The language is that of CEL with bit operators, three-valued logic and the math
catalog. NULL and NaN are both missing. Expressions compile to built-in column
expressions, so simple comparisons on bare attributes reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import math_catalog as M


class CelError(ValueError):
    """A text that isn't an expression, or an expression without a meaning."""


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Name:
    path: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Items:
    values: tuple


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


Node = Lit | Name | Param | Items | Op | Call

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<num>0[xX][0-9a-fA-F]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[uU]?)
  | (?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
  | (?P<param>[$@][A-Za-z_]\w*)
  | (?P<name>[A-Za-z_]\w*)
  | (?P<op>>>>|\|\||&&|==|!=|<=|>=|<<|>>|[-+*/%!<>=?:()\[\],.|&^~])
)""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
#: Binary operators by strength; all group to the left.
_LEVELS = [["||"], ["&&"], ["==", "!=", "<", "<=", ">", ">=", "in"], ["|"], ["^"], ["&"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]


def tokens(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise CelError(f"unexpected character at {at}: {text[at : at + 10]!r}")
        at, kind = m.end(), m.lastgroup
        raw = m[kind]
        if kind == "num":
            body = raw.rstrip("uU") if not raw.lower().startswith("0x") else raw
            out.append(("lit", int(body, 16) if body.lower().startswith("0x") else float(body) if re.search(r"[.eE]", body) else int(body)))
        elif kind == "str":
            out.append(("lit", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), raw[1:-1], flags=re.S)))
        elif kind == "name" and raw in ("true", "false", "null"):
            out.append(("lit", {"true": True, "false": False, "null": None}[raw]))
        elif kind == "name" and raw == "in":
            out.append(("op", "in"))
        else:
            out.append((kind, raw[1:] if kind == "param" else raw))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def peek(self) -> tuple[str, Any]:
        return self.toks[self.at]

    def take(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise CelError(f"expected {op!r}, found {self.peek()[1]!r}")

    def whole(self) -> Node:
        out = self.assignment()
        if self.peek()[0] != "end":
            raise CelError(f"unexpected {self.peek()[1]!r}")
        return out

    def assignment(self) -> Node:
        left = self.ternary()
        return Op("=", (left, self.assignment())) if self.take("=") else left

    def ternary(self) -> Node:
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.ternary()
        self.need(":")
        return Op("?:", (test, yes, self.ternary()))

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*_LEVELS[level]):
            left = Op(op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Node:
        if op := self.take("!", "-", "+", "~"):
            arg = self.unary()
            return arg if op == "+" else Op({"-": "neg", "!": "!", "~": "~"}[op], (arg,))
        return self.postfix()

    def arguments(self, end: str) -> tuple:
        out = []
        if self.take(end):
            return ()
        while True:
            out.append(self.ternary())
            if self.take(end):
                return tuple(out)
            self.need(",")

    def postfix(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "lit":
            out: Node = Lit(value)
        elif kind == "param":
            out = Param(value)
        elif kind == "name":
            out = Call(value, self.arguments(")")) if self.take("(") else Name(value)
        elif value == "(":
            out = self.ternary()
            self.need(")")
        elif value == "[":
            out = Items(self.arguments("]"))
        else:
            raise CelError(f"unexpected {value!r}" if kind != "end" else "unexpected end")
        while self.take("."):
            kind, value = self.peek()
            if kind != "name":
                raise CelError("expected a name after '.'")
            self.at += 1
            if self.take("("):
                out = Call(value, (out, *self.arguments(")")))
            elif isinstance(out, Name):
                out = Name(f"{out.path}.{value}")
            else:
                raise CelError(f"{value} of a value")
        return out


def parse(text: str) -> Node:
    return _Parser(text).whole()


# ------------------------------------------------------------------ optimiser

_FOLD: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def optimise(node: Node) -> Node:
    """Fold constants, drop neutral operands, decide constant conditions, and turn a
    compared square root into a comparison that the scan can use."""
    if isinstance(node, Items):
        return Items(tuple(map(optimise, node.values)))
    if isinstance(node, Call):
        return Call(node.name, tuple(map(optimise, node.args)))
    if not isinstance(node, Op):
        return node
    args = tuple(map(optimise, node.args))
    op, lits = node.name, [a.value if isinstance(a, Lit) else None for a in args]
    fixed = [isinstance(a, Lit) for a in args]
    if op in _FOLD and all(fixed) and (all(map(_number, lits)) or op in ("==", "!=", "+") and all(isinstance(x, str) for x in lits)):
        return Lit(_FOLD[op](*lits))
    if op == "neg" and fixed[0] and _number(lits[0]):
        return Lit(-lits[0])
    if op == "!" and fixed[0] and isinstance(lits[0], bool):
        return Lit(not lits[0])
    if op == "?:" and fixed[0] and isinstance(lits[0], bool):
        return args[1] if lits[0] else args[2]
    if op in ("&&", "||"):
        ends, keeps = (False, True) if op == "&&" else (True, False)
        if any(f and x is ends for f, x in zip(fixed, lits, strict=True)):
            return Lit(ends)
        for i in (0, 1):
            if fixed[i] and lits[i] is keeps and _is_test(args[1 - i]):
                return args[1 - i]
    if op in ("<", "<=") and isinstance(args[0], Call) and args[0].name == "sqrt" and fixed[1] and _number(lits[1]):
        x, c = args[0].args[0], lits[1]
        return Op("&&", (Op(">=", (x, Lit(0))), Op(op, (x, Lit(c * c))))) if c >= 0 else Op("&&", (Op(">=", (x, Lit(0))), Lit(False)))
    return Op(op, args)


def _is_test(n: Node) -> bool:
    return isinstance(n, Op) and n.name in ("==", "!=", "<", "<=", ">", ">=", "in", "!", "&&", "||")


# ------------------------------------------------------------------- compiler


@dataclass(frozen=True)
class Typed:
    """A column and what it holds: bool, int, double, string or null."""

    col: Column
    kind: str


Resolver = Callable[[str], Typed]
PREFIXES = ("src", "edge", "tgt", "node", "self")


def kind_of(simple_type: str) -> str:
    t = simple_type.lower()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if t in ("float", "double") or t.startswith("decimal"):
        return "double"
    return {"boolean": "bool", "string": "string", "timestamp": "time", "timestamp_ntz": "time", "date": "time"}.get(t, t)


def columns_of(dtypes: list[tuple[str, str]], at: Callable[[str], Column] = F.col) -> Resolver:
    """Bare and prefixed names are columns; NaN is missing, timestamps are milliseconds."""
    known = {n: kind_of(t) for n, t in dtypes}

    def of(path: str) -> Typed:
        head, _, rest = path.partition(".")
        name = rest if rest and path not in known else path
        if name not in known and head in PREFIXES:
            name = rest or "node"
        if name not in known:
            raise CelError(f"unknown attribute {path}")
        c, kind = at(name), known[name]
        if kind == "time":
            return Typed(F.unix_millis(c.cast("timestamp")), "int")
        return Typed(M.missing(c), kind) if kind == "double" else Typed(c, kind)

    return of


def _lit(v: Any) -> Typed:
    if v is None:
        return Typed(F.lit(None), "null")
    if isinstance(v, bool):
        return Typed(F.lit(v), "bool")
    if isinstance(v, int):
        return Typed(F.lit(v).cast("long") if -(1 << 63) <= v < 1 << 63 else F.lit(v).cast("decimal(20,0)"), "int")
    if isinstance(v, float):
        return Typed(F.lit(v) if v == v else F.lit(None).cast("double"), "double")
    return Typed(F.lit(str(v)), "string")


def _truth(t: Typed) -> Column:
    if t.kind == "bool":
        return t.col
    if t.kind == "null":
        return F.lit(None).cast("boolean")
    if t.kind == "string":
        return F.length(t.col) > 0
    return (M.missing(t.col) if t.kind == "double" else t.col) != 0


def _numeric(t: Typed) -> Column:
    if t.kind == "bool":
        return t.col.cast("long")
    if t.kind == "string":
        return F.lit(None).cast("double")
    return t.col if t.kind != "null" else F.lit(None).cast("long")


_DURATION = re.compile(r"(-?[\d.]+)(ms|s|m|h|d)")
_UNIT = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def duration_ms(text: str) -> int:
    if not _DURATION.fullmatch(text) and not re.fullmatch(rf"(?:{_DURATION.pattern})+", text):
        raise CelError(f"not a duration: {text!r}")
    return round(sum(float(n) * _UNIT[u] for n, u in _DURATION.findall(text)))


class Compiler:
    """Syntax tree to column, given what names stand for and the parameters' values."""

    def __init__(self, resolve: Resolver, params: Mapping[str, Any] | None = None):
        self.resolve, self.params = resolve, params or {}

    def typed(self, n: Node) -> Typed:
        if isinstance(n, Lit):
            return _lit(n.value)
        if isinstance(n, Param):
            if n.name not in self.params:
                raise CelError(f"no value for parameter {n.name}")
            return _lit(self.params[n.name])
        if isinstance(n, Name):
            return self.resolve(n.path)
        if isinstance(n, Op):
            return self.operator(n)
        if isinstance(n, Call):
            return self.call(n)
        raise CelError("a list has a meaning only after 'in'")

    def test(self, n: Node) -> Column:
        return _truth(self.typed(n))

    def operator(self, n: Op) -> Typed:
        op = n.name
        if op in ("&&", "||"):
            a, b = map(self.test, n.args)
            return Typed(a & b if op == "&&" else a | b, "bool")
        if op == "!":
            return Typed(~self.test(n.args[0]), "bool")
        if op == "?:":
            t, a, b = self.test(n.args[0]), self.typed(n.args[1]), self.typed(n.args[2])
            kind = a.kind if a.kind == b.kind or b.kind == "null" else b.kind if a.kind == "null" else "double" if {a.kind, b.kind} <= {"int", "double", "bool"} else None
            if kind is None:
                raise CelError("both sides of ?: need one type")
            cast = (lambda x: x.cast("double")) if kind == "double" else (lambda x: x)
            return Typed(F.when(t.isNull(), F.lit(None)).when(t, cast(a.col)).otherwise(cast(b.col)), kind)
        if op == "in":
            return self.member(n)
        if op == "=":
            raise CelError("assignment has a meaning only in a projection")
        if op == "neg":
            a = self.typed(n.args[0])
            return Typed(-_numeric(a), "int" if a.kind in ("int", "bool") else "double")
        if op == "~":
            return Typed(F.bitwise_not(_numeric(self.typed(n.args[0])).cast("long")), "int")
        a, b = self.typed(n.args[0]), self.typed(n.args[1])
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return Typed(self.compare(op, a, b), "bool")
        return self.arithmetic(op, a, b)

    @staticmethod
    def compare(op: str, a: Typed, b: Typed) -> Column:
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        if (a.kind == "string") != (b.kind == "string"):
            if op not in ("==", "!="):
                return F.lit(None).cast("boolean")
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "!="))
        x, y = (a.col, b.col) if a.kind == b.kind else (_numeric(a), _numeric(b))
        return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    @staticmethod
    def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        if op == "+" and "string" in (a.kind, b.kind):
            return Typed(F.concat(a.col.cast("string"), b.col.cast("string")), "string")
        x, y = _numeric(a), _numeric(b)
        if op in ("|", "&", "^", "<<", ">>", ">>>"):
            x, y = x.cast("long"), y.cast("long")
            if op == "|":
                return Typed(x.bitwiseOR(y), "int")
            if op == "&":
                return Typed(x.bitwiseAND(y), "int")
            if op == "^":
                return Typed(x.bitwiseXOR(y), "int")
            shift = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[op]
            safe = F.when(y.between(0, 63), y.cast("int")).otherwise(0)
            return Typed(F.when(y.isNull(), F.lit(None)).when(y.between(0, 63), F.call_function(shift, x, safe)).otherwise(F.lit(0).cast("long")), "int")
        whole = a.kind in ("int", "bool") and b.kind in ("int", "bool") and op != "/"
        if not whole:
            x, y = x.cast("double"), y.cast("double")
        if op in ("/", "%"):
            out = F.try_divide(x, y) if op == "/" else F.try_mod(x, y)
        else:
            out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return Typed(out if whole else M.missing(out), "int" if whole else "double")

    def member(self, n: Op) -> Typed:
        left, right = self.typed(n.args[0]), n.args[1]
        if isinstance(right, Param):
            values = [_lit(v) for v in self.params[right.name]]
        elif isinstance(right, Items):
            values = [self.typed(v) for v in right.values]
        else:
            raise CelError("'in' needs a list")
        if not values:
            return Typed(F.lit(False), "bool")
        same = [v for v in values if v.kind == "null" or (v.kind == "string") == (left.kind == "string")]
        hit = left.col.isin(*(v.col for v in same)) if same else F.lit(False)
        return Typed(F.when(left.col.isNotNull(), hit), "bool")

    def call(self, n: Call) -> Typed:
        name = re.sub(r"(?<!^)(?=[A-Z])", "_", n.name).lower()
        name = {"isnull": "is_null", "isnotnull": "is_not_null", "is_nan": "isnan", "is_inf": "isinf", "is_finite": "isfinite"}.get(name, name)
        arity = len(n.args)
        if name in ("timestamp", "duration", "now"):
            return self.time(name, n)
        args = [self.typed(a) for a in n.args]
        if name in ("is_null", "is_not_null") and arity == 1:
            gone = (M.missing(args[0].col) if args[0].kind == "double" else args[0].col).isNull()
            return Typed(gone if name == "is_null" else ~gone, "bool")
        if name in ("starts_with", "ends_with", "contains") and arity == 2:
            f = {"starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains}[name]
            return Typed(f(args[0].col.cast("string"), args[1].col.cast("string")), "bool")
        if name == "size" and arity == 1:
            return Typed(F.length(args[0].col).cast("long"), "int")
        if name in ("has_any", "has_all", "has_none", "has_lane") and arity == 2:
            mask, want = (_numeric(a).cast("long") for a in args)
            met = mask.bitwiseAND(want)
            return Typed({"has_any": met != 0, "has_all": met == want, "has_none": met == 0, "has_lane": F.call_function("shiftrightunsigned", mask, F.when(want.between(0, 63), want.cast("int")).otherwise(0)).bitwiseAND(F.lit(1).cast("long")).cast("boolean") & want.between(0, 63)}[name], "bool")
        if name in ("first_lane", "last_lane", "popcount", "clz") and arity == 1 and args[0].kind in ("int", "bool"):
            m = _numeric(args[0]).cast("long")
            width = F.when(m < 0, F.lit(64)).when(m == 0, F.lit(0)).otherwise(F.length(F.bin(m)))
            low = F.when(m == F.lit(-(1 << 63)).cast("long"), F.lit(63)).otherwise(F.bit_count(m.bitwiseAND(F.bitwise_not(F.call_function("try_subtract", m, F.lit(1).cast("long")))) - 1))
            out = {"popcount": F.bit_count(m), "clz": 64 - width, "first_lane": F.when(m == 0, F.lit(-1)).otherwise(low), "last_lane": width - 1}[name]
            return Typed(out.cast("long"), "int")
        if name in M.names():
            return Typed(M.apply(name, *map(_numeric, args)), "bool" if name in M.TESTS else "double")
        raise CelError(f"no function {n.name}")

    def time(self, name: str, n: Call) -> Typed:
        if name == "now":
            return Typed(F.unix_millis(F.current_timestamp()), "int")
        arg = n.args[0]
        value = arg.value if isinstance(arg, Lit) else self.params.get(arg.name) if isinstance(arg, Param) else None
        if name == "duration":
            if not isinstance(value, str):
                raise CelError("duration needs a constant text")
            return _lit(duration_ms(value))
        t = self.typed(arg)
        return t if t.kind == "int" else Typed(F.unix_millis(F.try_to_timestamp(t.col)), "int")


def compile_value(text: str, resolve: Resolver, params: Mapping[str, Any] | None = None) -> Typed:
    return Compiler(resolve, params).typed(optimise(parse(text)))


def compile_test(text: str, resolve: Resolver, params: Mapping[str, Any] | None = None) -> Column:
    """A truth value; rows where it is NULL are to be dropped."""
    return Compiler(resolve, params).test(optimise(parse(text)))
