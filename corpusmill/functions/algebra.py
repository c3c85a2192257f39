r"""Equality of expressions and equations, in columns.

A text becomes an array of tokens, then postfix order by a shunting-yard pass, then
values by a stack machine; all of it in higher-order functions, so nothing leaves the JVM.

Values are taken at hashed points of a prime field, where rational expressions are the
same only if they are identical (but for one pair in about 10^9 a point), and at real
points of both signs, which decide about roots, logarithms and other functions. In the
field, functions and powers with exponents that are no integers stand for hashes of
what they are applied to.

The grammar: numbers, letters as variables, ``+ - * / ^``, round brackets and braces,
``\frac``, ``\sqrt``, ``\pi``, ``\cdot``, ``\times``, ``\left``, ``\right`` and the functions of
``FUNCTIONS``; things side by side are multiplied. What it doesn't hold, and a null, gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

PRIME = (1 << 31) - 1
#: Seeds of the points in the field, and of those among real numbers; each of the latter comes with its mirror image.
FIELD, REAL = (11, 12), (21, -21, 22, -22, 23, -23)
RELATIVE = 1e-9
#: Multiples that equations may be of each other.
LARGEST_FACTOR = 1_000_000
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "exp": F.exp, "abs": F.abs,
    "ln": lambda x: F.when(x > 0, F.ln(x)), "log": lambda x: F.when(x > 0, F.log10(x)),
}
_NAMES = "|".join(sorted(FUNCTIONS, key=len, reverse=True))
_TOKEN = rf"(\d+\.?\d*|\.\d+|{_NAMES}|pi|\^\(-?\d{{1,4}}\)|\^\d{{1,4}}(?![\d.])|[A-Za-z]|[-+*/^()])"
_COMMANDS = {r"\\(?:left|right|displaystyle|,|;|!|:|quad)": "", r"\\(?:cdot|times)": "*", r"\\div(?![a-z])": "/", r"\\(?:dfrac|tfrac)": r"\\frac"}
_SIGNS = {"**": "^", "−": "-", "–": "-", "×": "*"}
_SHORT = {r"\\frac\s*(\d)\s*(\d)": r"\\frac{$1}{$2}", r"\\frac\s*(\d)\s*\{": r"\\frac{$1}{", r"\\sqrt\s*(\d)": r"\\sqrt{$1}"}


def _replaced(x: Column, patterns: dict[str, str]) -> Column:
    """Patterns of commands are looked for only in texts with a backslash."""
    out = x
    for pattern, instead in patterns.items():
        out = F.regexp_replace(out, pattern, instead)
    return F.when(F.contains(x, F.lit("\\")), out).otherwise(x)


def _signs(x: Column) -> Column:
    for sign, instead in _SIGNS.items():
        x = F.replace(x, F.lit(sign), F.lit(instead))
    return x


def _rounded(x: Column) -> Column:
    """Braces become round brackets, innermost first, and fractions quotients."""

    def once(t: Column, _: Column) -> Column:
        t = F.regexp_replace(t, r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "(($1)/($2))")
        t = F.regexp_replace(t, r"(?<!frac|frac |\}|\} )\{([^{}]*)\}", "($1)")
        return t

    rounds = F.regexp_count(x, F.lit(r"\{"))
    return F.when(F.contains(x, F.lit("{")), F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), x, once)).otherwise(x)


def _powers(t: Column) -> Column:
    """A function's power before its argument stands behind it."""
    return F.when(F.contains(t, F.lit("^")), F.regexp_replace(t, rf"({_NAMES})\^\(?(\d+)\)?\(([^()]*)\)", "($1($3))^($2)")).otherwise(t)


#: From a text to the spelling that tokens are found in; each step needs its text more than once.
_REWRITTEN = (
    lambda t: _replaced(t, _COMMANDS), _signs, lambda t: _replaced(t, _SHORT), _rounded, lambda t: F.regexp_replace(_replaced(t, {r"\\([a-zA-Z]+)": "$1"}), r"\s+", ""), _powers,
)


def _found(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(1))


def _spelled(t: Column, found: Column) -> Column:
    """Tokens with a ``*`` between things side by side and ``~`` for a sign; null if something is left over."""
    ends = lambda a: ~a.isin("+", "-", "*", "/", "^", "(", *FUNCTIONS)
    begins = lambda a: ~(a.isin("+", "-", "*", "/", ")") | F.startswith(a, F.lit("^")))
    none = F.array().cast("array<string>")

    def spelled(a: Column, i: Column) -> Column:
        before = F.coalesce(F.get(found, i - 1), F.lit("("))
        return F.when(begins(a) & ends(before), F.array(F.lit("*"), a)).when(a.isin("+", "-") & ~ends(before), F.when(a == "-", F.array(F.lit("~"))).otherwise(none)).otherwise(F.array(a))

    whole = (F.array_join(found, "") == t) & (t != "") & ~F.rlike(t, F.lit(r"\^\(?-?\d+\)?\^"))  # towers of powers aren't held
    return F.when(whole, F.flatten(F.transform(found, spelled)))


def _strength(op: Column) -> Column:
    return F.when(op.isin("+", "-"), 1).when(op.isin("*", "/"), 2).when(op == "~", 3).when(op == "^", 4).when(op == "(", 0).otherwise(5)


_START = "named_struct('out', array_remove(array(''), ''), 'ops', array_remove(array(''), ''))"


def _postfix(ts: Column) -> Column:
    """Tokens in postfix order by a shunting-yard pass; brackets that don't match stay in it."""

    def step(acc: Column, t: Column) -> Column:
        out, ops = acc["out"], acc["ops"]
        front = lambda k: F.slice(ops, F.lit(1), F.greatest(k, F.lit(0)))
        rest = lambda k: F.slice(ops, k + 1, F.size(ops))
        state = lambda o, s: F.struct(o.alias("out"), s.alias("ops"))
        opened = F.array_position(ops, "(").cast("int")  # 0: none
        called = F.coalesce(F.get(ops, opened), F.lit("(")).isin(*FUNCTIONS).cast("int")  # a function before the bracket has its argument now
        weaker = F.transform(ops, lambda o: (_strength(o) < _strength(t)) | ((_strength(o) == _strength(t)) & (t == "^")))
        stronger = F.when(F.array_contains(weaker, True), F.array_position(weaker, True).cast("int") - 1).otherwise(F.size(ops))
        return (
            F.when(t == "(", state(out, F.array_prepend(ops, t)))
            .when(t == ")", F.when(opened > 0, state(F.concat(out, front(opened - 1), F.slice(ops, opened + 1, called)), rest(opened + called))).otherwise(state(F.array_append(out, "("), ops)))
            .when(t.isin(*FUNCTIONS, "~"), state(out, F.array_prepend(ops, t)))
            .when(t.isin("+", "-", "*", "/", "^"), state(F.concat(out, front(stronger)), F.array_prepend(rest(stronger), t)))
            .otherwise(state(F.array_append(out, t), ops))
        )

    return F.aggregate(ts, F.expr(_START), step, lambda acc: F.concat(acc["out"], acc["ops"]))


def _is_power(t: Column) -> Column:
    """Of tokens that are no operators."""
    return F.startswith(t, F.lit("^"))


def _is_number(t: Column) -> Column:
    """Of tokens that are numbers, letters or pi: digits and the point come before letters."""
    return t < F.lit("A")


def _machine(post: Column, kind: str, number: Callable, variable: Callable, unary: Callable, power: Callable, binary: Callable) -> Column:
    """Runs a postfix array on a stack whose top comes first; null if it doesn't come out even or a value is missing."""

    def step(stack: Column, t: Column) -> Column:
        a, b = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
        below = lambda k: F.slice(stack, k + 1, F.size(stack))
        two, one = t.isin("+", "-", "*", "/", "^"), t.isin(*FUNCTIONS, "~")
        put = lambda x, rest: F.array_prepend(rest, x.cast(kind))
        return F.when(two, put(binary(t, b, a), below(2))).when(one, put(unary(t, a), below(1))).when(_is_power(t), put(power(a, F.regexp_extract(t, r"(-?\d+)", 1).cast("int")), below(1))).when(_is_number(t), put(number(t), stack)).otherwise(put(variable(t), stack))

    return F.aggregate(post, F.array().cast(f"array<{kind}>"), step, lambda stack: F.when(F.size(stack) == 1, F.get(stack, F.lit(0))))


def _even(post: Column) -> Column:
    """Whether every operation finds what it needs and one value is left."""
    takes = lambda t: F.when(t.isin("+", "-", "*", "/", "^"), 2).when(t.isin(*FUNCTIONS, "~") | _is_power(t), 1).otherwise(0)
    return F.aggregate(post, F.lit(0), lambda n, t: F.when((n < takes(t)) | (n < 0), -1).otherwise(n + 1 - takes(t))) == 1


def power_mod(a: Column, n: Column) -> Column:
    """a to the n-th in the field, by squaring; as many steps as n has binary digits."""
    start = F.struct(F.lit(1).cast("long").alias("r"), a.cast("long").alias("b"))

    def power(n: Column) -> Column:
        step = lambda s, i: F.struct(F.when(F.call_function("shiftright", n, i).bitwiseAND(F.lit(1).cast("long")) == 1, s["r"] * s["b"] % PRIME).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % PRIME).alias("b"))
        return F.aggregate(F.when(n < 8, F.sequence(F.lit(0), F.lit(2))).otherwise(F.sequence(F.lit(0), F.lit(30))), start, step, lambda s: s["r"])

    return let(n.cast("long"), power)


def inverse(a: Column) -> Column:
    """1 / a in the field; null for 0. The power of PRIME - 2 by runs of ones: from 1, 2, 4, 8 and 16 of them to 29."""
    squared = lambda x, k: F.aggregate(F.sequence(F.lit(1), F.lit(k)), x, lambda r, _: r * r % PRIME)
    longer = lambda x, k, y: squared(x, k) * y % PRIME

    def power(a: Column) -> Column:
        to_29 = lambda one, four, eight: lambda sixteen: let(longer(longer(longer(sixteen, 8, eight), 4, four), 1, one), lambda x: longer(x, 2, one))
        to_16 = lambda four: let(longer(four, 4, four), lambda eight: let(longer(eight, 8, eight), to_29(a, four, eight)))
        return let(longer(a, 1, a), lambda two: let(longer(two, 2, two), to_16))

    return let(a.cast("long"), lambda a: F.when(a != 0, power(a)))


def in_field(post: Column) -> Column:
    """The values at hashed points of the field; null where it isn't defined."""
    return F.transform(F.array(*map(F.lit, FIELD)), lambda seed: _in_field(post, seed))


def _in_field(post: Column, seed: Column) -> Column:
    hashed = lambda *xs: F.pmod(F.xxhash64(seed, *xs), F.lit(PRIME - 2)) + 2

    def number(t: Column) -> Column:
        digits = F.replace(t, F.lit("."), F.lit("")).try_cast("long") % PRIME
        places = F.length(F.regexp_extract(t, r"\.(\d*)", 1))
        return F.when(F.contains(t, F.lit(".")), digits * power_mod(F.lit(pow(10, -1, PRIME)), places) % PRIME).otherwise(digits)

    def binary(t: Column, x: Column, y: Column) -> Column:
        return F.when(t == "+", (x + y) % PRIME).when(t == "-", F.pmod(x - y, F.lit(PRIME))).when(t == "*", x * y % PRIME).when(t == "/", x * inverse(y) % PRIME).otherwise(F.when(x.isNotNull() & y.isNotNull(), hashed(F.lit("^"), x, y)))

    unary = lambda t, x: F.when(t == "~", F.pmod(-x, F.lit(PRIME))).when(x.isNotNull(), hashed(t, x))
    power = lambda x, n: F.when(n >= 0, power_mod(x, n)).otherwise(power_mod(inverse(x), -n))
    return _machine(post, "bigint", number, lambda t: hashed(F.lit("v"), t), unary, power, binary)


def in_reals(post: Column) -> Column:
    """The values at hashed real points; null where it isn't defined or isn't finite."""
    got = F.transform(F.array(*map(F.lit, REAL)), lambda seed: _in_reals(post, seed))
    return F.transform(got, lambda x: F.when(~F.isnan(x) & (F.abs(x) < 1e300), x))


def _in_reals(post: Column, seed: Column) -> Column:
    """A seed below zero is the mirror image of the one above."""

    def variable(t: Column) -> Column:
        h = F.xxhash64(F.abs(seed), t)
        size = F.pmod(h, F.lit(1_000_003)) / F.lit(500_000.0) + 0.3
        return F.when(t == "pi", F.pi()).otherwise(size * F.when(F.shiftright(h, 40) % 2 == 0, F.signum(seed)).otherwise(-F.signum(seed)))

    def unary(t: Column, x: Column) -> Column:
        out = F.when(t == "~", -x)
        for name, f in FUNCTIONS.items():
            out = out.when(t == name, f(x))
        return out

    def binary(t: Column, x: Column, y: Column) -> Column:
        return F.when(t == "+", x + y).when(t == "-", x - y).when(t == "*", x * y).when(t == "/", F.try_divide(x, y)).otherwise(F.pow(x, y))

    return _machine(post, "double", lambda t: t.try_cast("double"), variable, unary, lambda x, n: F.pow(x, n.cast("double")), binary)

def _close(x: Column, y: Column) -> Column:
    return F.abs(x - y) <= RELATIVE * F.greatest(F.abs(x), F.abs(y), F.lit(1e-3))


def _rational(post: Column) -> Column:
    """Whether there are no functions, general powers or pi in it."""
    return ~F.exists(post, lambda t: t.isin(*FUNCTIONS, "^", "pi"))


def _near(y: Column) -> Callable[[Column], Column]:
    return lambda x: _close(x, y)


def _all(xs: Column, test: Callable[[Column], Column]) -> Column:
    return (F.size(xs) > 0) & F.coalesce(F.forall(xs, test), F.lit(False))


def with_postfix(df: DataFrame, texts: list[Column], name: str = "_p") -> DataFrame:
    """Adds an array of the texts in postfix order; null where the grammar doesn't hold one. Each step is a projection of its own, since the next needs it more than once."""
    steps = [
        *_REWRITTEN, lambda t: F.struct(t.alias("t"), _found(t).alias("found")), lambda s: _spelled(s["t"], s["found"]), _postfix, lambda p: F.when(~F.array_contains(p, "(") & _even(p), p),
    ]
    df = df.withColumn(name, F.array(*texts))
    for step in steps:
        df = df.withColumn(name, F.transform(name, step))
    return df


def _at(name: str, i: int) -> Column:
    return F.get(name, F.lit(i))


def _valued(df: DataFrame, pairs: list[tuple[int, int]], n: int) -> DataFrame:
    """From the postfix arrays ``_p``: values in the field (``_f``), whether these decide about a pair (``_d``: both rational, and defined), and values at the real points where they don't (``_r``)."""
    ready = df.withColumn("_f", F.transform("_p", in_field))
    ready = ready.withColumn("_sure", F.zip_with("_p", "_f", lambda p, f: F.coalesce(_rational(p) & ~F.exists(f, lambda x: x.isNull()), F.lit(False))))
    ready = ready.withColumn("_d", F.array(*[_at("_sure", i) & _at("_sure", j) for i, j in pairs]))
    open_ = [[~_at("_d", k) for k, pair in enumerate(pairs) if i in pair] for i in range(n)]
    ready = ready.withColumn("_open", F.array(*[reduce(lambda x, y: x | y, own) if own else F.lit(False) for own in open_]))
    return ready.withColumn("_r", F.zip_with("_p", "_open", lambda p, o: F.when(o & p.isNotNull(), in_reals(p))))


def _pair(i: int, j: int) -> tuple[Column, Column, Column]:
    """(whether both are held, whether the field has the same values, values at the real points where both have one)."""
    same = F.coalesce(F.forall(F.zip_with(_at("_f", i), _at("_f", j), lambda x, y: x == y), lambda x: x), F.lit(False))
    both = F.filter(F.zip_with(_at("_r", i), _at("_r", j), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return _at("_p", i).isNotNull() & _at("_p", j).isNotNull(), same, both


_OWN = ("_p", "_f", "_sure", "_d", "_open", "_r")


def _numbered(pairs: dict[str, tuple[str, str]]) -> tuple[list[str], list[tuple[int, int]]]:
    names = list(dict.fromkeys(x for pair in pairs.values() for x in pair))
    return names, [(names.index(a), names.index(b)) for a, b in pairs.values()]


def with_equal_expressions(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name whether the two text columns are the same expression; null if one isn't an expression."""
    names, at = _numbered(pairs)
    ready, found = _valued(with_postfix(df, [F.col(x) for x in names]), at, len(names)), {}
    for k, (name, (i, j)) in enumerate(zip(pairs, at, strict=True)):
        held, same, points = _pair(i, j)
        real = F.coalesce(_all(points, lambda p: _close(p["x"], p["y"])), F.lit(False))
        found[name] = F.when(held, same | (~_at("_d", k) & real))
    return ready.withColumns(found).drop(*_OWN)


def with_equal_equations(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name whether the differences of two equations' sides are integer multiples, one of the other; null if a text hasn't one equals sign or a side isn't an expression."""
    names, at = _numbered(pairs)
    sides = [F.when(F.size(F.split(x, "=")) == 2, F.get(F.split(x, "="), F.lit(i))) for x in names for i in (0, 1)]
    both = with_postfix(df, sides).withColumn("_p", F.array(*[F.concat(_at("_p", 2 * i), _at("_p", 2 * i + 1), F.array(F.lit("-"))) for i in range(len(names))]))
    ready, found = _valued(both, at, len(names)), {}
    small = lambda q: (q <= LARGEST_FACTOR) | (q >= PRIME - LARGEST_FACTOR)
    whole = lambda x: (F.abs(x) > 0.5) & (F.abs(x - F.round(x)) <= RELATIVE * F.abs(x))
    for k, (i, j) in enumerate(at):  # ratios at the real points
        points = F.filter(_pair(i, j)[2], lambda p: (F.abs(p["x"]) > 1e-9) & (F.abs(p["y"]) > 1e-9))
        ready = ready.withColumn(f"_x{k}", F.transform(points, lambda p: F.try_divide(p["x"], p["y"])))
    for k, (name, (i, j)) in enumerate(zip(pairs, at, strict=True)):
        held, equal, _ = _pair(i, j)
        first, (x, y) = _at(f"_x{k}", 0), ([F.get(_at("_f", n), F.lit(m)) for m in (0, 1)] for n in (i, j))
        either = let(inverse(x[0] * y[0] % PRIME), lambda v, x=x[0], y=y[0]: small(x * x % PRIME * v % PRIME) | small(y * y % PRIME * v % PRIME))  # the quotient one way and the other
        same = (y[1] != 0) & (x[0] * y[1] % PRIME == x[1] * y[0] % PRIME) & either
        zero = (x[0] == 0) | (y[0] == 0)
        real = _all(F.col(f"_x{k}"), _near(first)) & (whole(first) | whole(F.try_divide(F.lit(1.0), first)))
        verdict = F.when(F.coalesce(zero, F.lit(False)), equal).when(F.coalesce(same, F.lit(False)), True).otherwise(~_at("_d", k) & real)
        found[name] = F.when(held, F.coalesce(verdict, F.lit(False)))
    return ready.withColumns(found).drop(*_OWN, *[f"_x{k}" for k in range(len(at))])
