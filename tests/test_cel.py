import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshwalk.functions import cel
from meshwalk.functions import math_catalog as M


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 2.0, "abc", None), (2, float("nan"), "", 5), (0, -1.5, None, 7)], "a long, b double, s string, n int").orderBy("a").coalesce(1)


def values(df, text, **params):
    return [r[0] for r in df.select(cel.compile_value(text, cel.columns_of(df.dtypes), params).col).collect()]


@pytest.mark.parametrize(
    "text,want",
    [  # rows in the order a = 0, 1, 2
        ("a + 1", [1, 2, 3]), ("a / 2", [0.0, 0.5, 1.0]), ("7 / a", [None, 7.0, 3.5]), ("7 % a", [None, 0, 1]), ("-a * 2", [0, -2, -4]),
        ("b > 1 && a < 5", [False, True, None]), ("b > 1 || a == 2", [False, True, True]), ("!(b > 1)", [True, False, None]),
        ("s == 1", [None, False, False]), ("s != 1", [None, True, True]), ("s < 1", [None, None, None]), ("s + 'x'", [None, "abcx", "x"]),
        ("a in [1, 2]", [False, True, True]), ("n in []", [False, False, False]), ("n in [5]", [False, None, True]), ("a << 2", [0, 4, 8]), ("1 << 70", [0, 0, 0]), ("-8 >>> 60", [15, 15, 15]),
        ("n > 5 ? 'hi' : 'lo'", ["hi", None, "lo"]), ("sqrt(b) < 2", [False, True, None]), ("s.startsWith('a')", [None, True, False]), ("is_null(b)", [False, False, True]),
        ("a | 4", [4, 5, 6]), ("a & 1", [0, 1, 0]), ("a ^ 3", [3, 2, 1]), ("~a", [-1, -2, -3]), ("popcount(7)", [3] * 3), ("first_lane(8)", [3] * 3), ("last_lane(9)", [3] * 3), ("clz(1)", [63] * 3),
        ("has_any(5, 4)", [True] * 3), ("has_all(5, 4)", [True] * 3), ("has_none(5, 2)", [True] * 3), ("has_lane(5, 2)", [True] * 3), ("1 + 2 * 3 == 7", [True] * 3), ("1 + 2 << 1", [6] * 3),
        ("true || null", [True] * 3), ("false && null", [False] * 3), ("null && true", [None] * 3), ("b && true", [True, True, None]), ("s ? 1 : 2", [None, 1, 2]), ("size(s)", [None, 3, 0]), ("clamp(a, 1, 1)", [1.0, 1.0, 1.0]),
    ],
)
def test_values(rows, text, want):
    assert values(rows, text) == want


def test_times(rows):
    assert values(rows, "timestamp('1970-01-02T00:00:00Z') - duration('1d')") == [0, 0, 0]
    assert cel.duration_ms("1h30m") == 5_400_000


def test_parameters(rows):
    assert values(rows, "a >= $low && a in @set", low=1, set=[1, 5]) == [False, True, False]
    with pytest.raises(cel.CelError):
        values(rows, "a > $nothing")


@pytest.mark.parametrize("text", ["", "1 +", "(1", "a ? b", "a b", "[1, 2", "'open", "a in 3", "f(1,", "1 = = 2", "#"])
def test_errors(rows, text):
    with pytest.raises(cel.CelError):
        values(rows, text)


def test_optimiser():
    o = lambda t: cel.optimise(cel.parse(t))
    assert o("1 + 2 < 4") == cel.Lit(True) and o("true && x > 1") == cel.parse("x > 1") and o("false && x") == cel.Lit(False) and o("true ? a : b") == cel.Name("a")
    assert o("sqrt(x) < 3") == cel.parse("x >= 0 && x < 9") and o("!true") == cel.Lit(False)


KLEENE = st.sampled_from(["true", "false", "null"])
LOGIC = st.recursive(KLEENE, lambda s: st.one_of(st.tuples(s, s).map(lambda p: f"({p[0]} && {p[1]})"), st.tuples(s, s).map(lambda p: f"({p[0]} || {p[1]})"), s.map(lambda x: f"!{x}")), max_leaves=6)


def kleene(n):
    if isinstance(n, cel.Lit):
        return n.value
    x = [kleene(a) for a in n.args]
    if n.name == "!":
        return None if x[0] is None else not x[0]
    stop = n.name == "||"
    return stop if stop in x else None if None in x else not stop


@given(st.lists(LOGIC, min_size=20, max_size=40))
@settings(max_examples=4, deadline=None)
def test_three_valued_logic(spark, texts):
    of = cel.Compiler(lambda p: None)
    one = spark.range(1).select(*(of.test(cel.parse(t)).alias(f"c{i}") for i, t in enumerate(texts))).first()
    assert list(one) == [kleene(cel.parse(t)) for t in texts]
    two = spark.range(1).select(*(of.test(cel.optimise(cel.parse(t))).alias(f"c{i}") for i, t in enumerate(texts))).first()
    assert list(two) == list(one)


def test_bits_and_special_functions(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(*(M.apply(n, *map(F.lit, a), bits=b) for n, a, b in [("clz", [1.0], 32), ("ctz", [8.0], 64), ("ctz", [0.0], 32), ("rotl", [1.0, 33], 32), ("rotr", [1.0, 1], 32), ("popcount", [255.0], 32), ("erf", [0.5], 64), ("lgamma", [5.0], 64), ("sinc", [0.0], 64), ("safe_div", [1.0, 0.0], 64), ("isinf", [float("inf")], 64), ("fmod", [-7.0, 3.0], 64), ("softplus", [30.0], 64)])).first()
    assert [round(v, 6) if isinstance(v, float) else v for v in got] == [31.0, 3.0, 32.0, 2.0, 2.0**31, 8.0, 0.5205, 3.178054, 1.0, 0.0, True, -1.0, 30.0]
