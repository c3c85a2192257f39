"""Expressions and equations in columns; no Python node may stand in the plan."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import algebra

SAME = [
    ("x^2+2x+1", "(x+1)^2"), (r"\sin(x)^2+\cos(x)^2", "1"), (r"\sin^2(x)+\cos^2(x)", "1"), ("2ab", "2ba"), (r"\frac{x}{y}", "x/y"), ("xy", "x*y"), ("a+b", "b+a"), ("2(x+3)", "2x+6"), (r"\sqrt{x^2}", r"abs(x)"), (r"\frac{x^{2}-1}{x-1}", "x+1"),
    ("-x^2", "-(x^2)"), ("x^{-2}", r"\frac{1}{x^2}"), ("0.5x", r"\frac12 x"), ("(x-y)(x+y)", "x^2-y^2"), ("--x", "x"), ("2*-3", "-6"), (r"\frac{\frac{a}{b}}{c}", "a/(b*c)"), ("exp(x+y)", "exp(x)exp(y)"), ("x/2/3", "x/6"), ("x-y-z", "x-(y+z)"),
    (r"\pi r^2", r"r^2\pi"), ("2^x*2^x", "2^(2x)"), ("1.50", "3/2"), (r"\left(x+1\right)\cdot 2", "2x+2"), ("sqrt(sqrt(x^4))", "sqrt(x^2)"), ("ln(exp(x))", "x"), ("a^10", "a^4*a^6"), (".5+.5", "1"), ("+x", "x"), ("x^3-(x-1)(x^2+x+1)", "1"),
]
OTHER = [(r"\sqrt{x^2}", "x"), ("abs(x)", "x"), ("x+1", "x+2"), ("x^2", "x^3"), ("ln(x)", "log(x)"), ("x-(y-z)", "x-y-z"), ("x", "-x"), ("x^4", "x^2"), ("1/x", "x"), ("sin(x)", "sin(-x)"), ("x", "y"), ("2^3", "9"), ("x/y", "y/x"), ("a-b", "b-a"), ("100000001", "100000000")]
NEITHER = ["", "x+", "(x", "x)", ")x(", "*x", "x$y", "x=y", None, "()", "2 3 ? 4", r"\foo{x}{y}z!", "x^2^3"]


def test_expressions(spark):
    rows = [(a, b, True) for a, b in SAME] + [(b, a, True) for a, b in SAME] + [(a, b, False) for a, b in OTHER] + [(a, "x", None) for a in NEITHER]
    df = algebra.with_equal_expressions(spark.createDataFrame(rows, "a string, b string, want boolean"), {"got": ("a", "b")})
    assert [tuple(r) for r in df.filter(~F.col("got").eqNullSafe(F.col("want"))).collect()] == []
    assert "Python" not in df._jdf.queryExecution().toString()


def test_random_polynomials(spark):
    """Products of random factors against their expanded forms, and against forms with one coefficient off."""
    rnd, rows = random.Random(7), []
    for _ in range(40):
        roots = [rnd.randint(-9, 9) for _ in range(rnd.randint(1, 5))]
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly], strict=True)]
        n = len(poly) - 1
        off = list(poly)
        off[rnd.randrange(len(off))] += rnd.choice([-1, 1])
        spell = lambda p, n=n: "+".join(f"({c})x^{n - i}" for i, c in enumerate(p)).replace("x^0", "")
        factors = "".join(f"(x-({r}))" for r in roots)
        rows += [(factors, spell(poly), True), (factors, spell(off), False)]
    df = algebra.with_equal_expressions(spark.createDataFrame(rows, "a string, b string, want boolean"), {"got": ("a", "b")})
    assert df.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_equations(spark):
    rows = [
        ("2x+2y=4", "x+y=2", True), ("x+y=2", "2x+2y=4", True), ("x+y=2", "x+y=3", False), ("3y=6x-9", "y-2x+3=0", True), ("2x+2y=4", "3x+3y=6", False), ("x^2+y^2=1", "1=x^2+y^2", True), ("y=2x+1", "2x+1=y", True), ("x^2+y^2=1", "y^2=1-x^2", True),
        ("y=x", "y=-x", False), ("x=y=z", "x=y", None), ("x", "x=1", None), ("y=sin(x)", "2y=2sin(x)", True), ("y=sqrt(x^2)", "y=x", False), ("x=x", "y=y", True), ("x=x", "y=1", False),
    ]
    df = algebra.with_equal_equations(spark.createDataFrame(rows, "a string, b string, want boolean"), {"got": ("a", "b")})
    assert [tuple(r) for r in df.filter(~F.col("got").eqNullSafe(F.col("want"))).collect()] == []


def test_postfix(spark):
    rows = [("a+b*c", "a b c * +"), ("(a+b)*c", "a b + c *"), ("-a^2", "a ^2 ~"), ("a-b-c", "a b - c -"), ("sin(a)b", "a sin b *"), ("2a^(b)", "2 a b ^ *"), ("a/b*c", "a b / c *")]
    df = algebra.with_postfix(spark.createDataFrame(rows, "t string, want string"), [F.col("t")])
    assert [" ".join(r._p[0]) for r in df.collect()] == [w for _, w in rows]


def test_inverse(spark):
    """No bits are looked at for an inverse, which every quotient of equations needs."""
    p = algebra.PRIME
    given = [0, 1, 2, p - 1, p - 2, 1 << 30, 123_456_789, None]
    df = spark.createDataFrame([(a,) for a in given], "a long").select("a", algebra.inverse(F.col("a")).alias("i"), *[algebra.power_mod(F.col("a"), F.lit(n)).alias(f"p{n}") for n in (0, 1, 7, 8, 9999)])
    assert spark.range(3).select(algebra.inverse(F.col("id")))._jdf.queryExecution().analyzed().toString().count("shiftright") == 0
    for r in df.filter("a IS NOT NULL").collect():
        assert r.i == (pow(r.a, -1, p) if r.a else None) and all(r[f"p{n}"] == pow(r.a, n, p) for n in (0, 1, 7, 8, 9999))
    assert df.filter("a IS NULL AND i IS NULL").count() == 1
