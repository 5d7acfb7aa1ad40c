"""The math catalog: named functions over double columns.

Values that have no result are NULL (NaN is missing too, see cel.py), except that
log(0) is minus infinity. Everything is a built-in expression but erf, erfc and
lgamma, which Spark lacks and which run as Arrow-batched functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from meshwalk.plans.shipping import ship

ship(__name__)

INF = float("inf")


def missing(c: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _log(base: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, F.lit(-INF)).otherwise(base(x))


def _batched(f: Callable[[float], float]):
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else _safe(f, v)).astype("float64")

    return F.pandas_udf(of, DoubleType())


def _safe(f: Callable[[float], float], v: float) -> float:
    try:
        return f(v)
    except (ValueError, OverflowError):
        return INF


def _u(x: Column, width: int) -> Column:
    """The value clamped to an unsigned integer of so many bits, as a long."""
    top = 2.0**width - 1
    low = F.greatest(F.lit(0.0), F.least(x, F.lit(top)))
    if width < 64:
        return F.floor(low).cast("long")
    half = 2.0**63
    return F.when(low < half, F.floor(low).cast("long")).when(low >= 2.0**64 - 2048, F.lit(-1).cast("long")).otherwise((F.floor(low - half).cast("long")).bitwiseXOR(F.lit(-(1 << 63)).cast("long")))


def _clz(x: Column, width: int) -> Column:
    v = _u(x, width)
    bits = F.length(F.bin(v))
    return F.when(v == 0, F.lit(width)).otherwise(width - bits).cast("double")


def _ctz(x: Column, width: int) -> Column:
    v = _u(x, width)
    low = v.bitwiseAND(-v)
    return F.when(v == 0, F.lit(width)).otherwise(F.bit_count(low - 1)).cast("double") if width < 64 else F.when(v == 0, F.lit(width)).when(v == F.lit(-(1 << 63)).cast("long"), F.lit(63)).otherwise(F.bit_count(low - 1)).cast("double")


def _rot(x: Column, k: Column, width: int, left: bool) -> Column:
    v, n = _u(x, width), F.pmod(k.cast("int"), F.lit(width))
    n = n if left else F.pmod(F.lit(width) - n, F.lit(width))
    up, down = F.call_function("shiftleft", v, n), F.call_function("shiftrightunsigned", v, F.lit(width) - n)
    both = F.when(n == 0, v).otherwise(up.bitwiseOR(down))
    return (both.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else both).cast("double")


def _whole(x: Column, rounded: Column) -> Column:
    """``rounded`` goes through a long, which has no -0.0; from 2^52 on, every double is whole and stays, infinities too."""
    return F.when(F.abs(x) >= 2.0**52, x).when(rounded == 0, x * 0.0).otherwise(rounded.cast("double"))


def _round_away(x: Column) -> Column:
    """Half away from zero, kept as a double."""
    return _whole(x, F.signum(x) * F.floor(F.abs(x) + 0.5))


def rounded(x: Column, digits: int) -> Column:
    """As C and SQL engines round doubles: half away from zero after scaling, and -0.0 stays. Spark's goes through decimals."""
    y = x * 10.0**digits
    low = F.floor(F.abs(y)).cast("double")
    size = low + F.when(F.abs(y) - low >= 0.5, 1.0).otherwise(0.0)
    whole = F.when(F.abs(y) >= 2.0**52, y).when(size == 0, y * 0.0).when(y < 0, -size).otherwise(size)
    return F.when(F.abs(y) < INF, whole / 10.0**digits).otherwise(x)


def _safe_div(a: Column, b: Column, other: Column) -> Column:
    """``other`` stands in for division by zero alone: what is missing stays missing."""
    return F.when(b == 0, other).otherwise(F.try_divide(a, b))


def _tanh_gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))


UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
    "rsqrt": lambda x: F.try_divide(F.lit(1.0), F.sqrt(x)),
    "exp": F.exp,
    "exp2": lambda x: F.pow(F.lit(2.0), x),
    "exp10": lambda x: F.pow(F.lit(10.0), x),
    "expm1": F.expm1,
    "log": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "log1p": lambda x: F.when(x == -1, F.lit(-INF)).otherwise(F.log1p(x)),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinc": lambda x: F.when(F.abs(x) < 1e-15, F.lit(1.0)).otherwise(F.try_divide(F.sin(x), x)),
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "floor": lambda x: _whole(x, F.floor(x)),
    "ceil": lambda x: _whole(x, F.ceil(x)),
    "round": _round_away,
    "trunc": lambda x: _whole(x, F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "relu": lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0))),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(0.01 * x),
    "sigmoid": lambda x: F.lit(1.0) / (1 + F.exp(-x)),
    "gelu": _tanh_gelu,
    "silu": lambda x: x / (1 + F.exp(-x)),
    "softplus": lambda x: F.when(x > 20, x).otherwise(F.log1p(F.exp(x))),
    "erf": _batched(math.erf),
    "erfc": _batched(math.erfc),
    "lgamma": _batched(math.lgamma),
    "popcount": lambda x: F.bit_count(_u(x, 64)).cast("double"),
    "clz": lambda x: _clz(x, 64),
    "ctz": lambda x: _ctz(x, 64),
    "signum": F.signum,
    "neg": lambda x: -x,
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "pow": F.pow,
    "hypot": F.hypot,
    "atan2": F.atan2,
    "fmod": lambda a, b: F.try_mod(a, b),
    "copysign": lambda a, b: F.abs(a) * F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
    "rotl": lambda x, k: _rot(x, k, 64, True),
    "rotr": lambda x, k: _rot(x, k, 64, False),
    "safe_div": lambda a, b: _safe_div(a, b, F.lit(0.0)),
    "leaky_relu": lambda x, s: F.when(x > 0, x).otherwise(s * x),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
}
TERNARY: dict[str, Callable[[Column, Column, Column], Column]] = {
    "fma": lambda a, b, c: a * b + c,
    "lerp": lambda a, b, t: a + t * (b - a),
    "clamp": lambda x, lo, hi: F.when(x < lo, lo).when(x > hi, hi).otherwise(x),
    "safe_div": _safe_div,
}
#: These see NaN and infinities and answer with truth values.
TESTS: dict[str, Callable[[Column], Column]] = {
    "isnan": lambda x: F.isnan(x),
    "isinf": lambda x: F.abs(x) == INF,
    "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) != INF),
}
#: The same bit functions on 32 bits, for single-precision vectors.
BITS32: dict[str, Callable[..., Column]] = {
    "popcount": lambda x: F.bit_count(_u(x, 32)).cast("double"),
    "clz": lambda x: _clz(x, 32),
    "ctz": lambda x: _ctz(x, 32),
    "rotl": lambda x, k: _rot(x, k, 32, True),
    "rotr": lambda x, k: _rot(x, k, 32, False),
}


def names() -> set[str]:
    return {*UNARY, *BINARY, *TERNARY, *TESTS}


def apply(name: str, *args: Column, bits: int = 64) -> Column:
    """The function of this name and number of arguments; NaN results are NULL."""
    if bits == 32 and name in BITS32:
        return missing(BITS32[name](*(missing(a) for a in args)))
    if name in TESTS and len(args) == 1:
        return TESTS[name](args[0].cast("double"))
    table = {1: UNARY, 2: BINARY, 3: TERNARY}.get(len(args), {})
    if name not in table:
        raise ValueError(f"no function {name} of {len(args)} arguments")
    return missing(table[name](*(missing(a) for a in args)))
