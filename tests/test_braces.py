"""Boxes and commas in columns against the scanners that read character by character."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import braces, scan


def texts():
    rnd = random.Random(11)
    bits = [r"\boxed{", r"\boxed {", r"\fbox{", r"\box{", "{", "}", "}", "a", "1 ", ", ", " and ", "; ", "x\n", r"\frac{1}{2}", "é", "$", "(", ")", "[", "]", '"', "\\,", "\\", "  ", "😀"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 30))) for _ in range(1500)]
    return [*out, "", r"\boxed{" * 60 + "x" + "}" * 55, r"a \boxed{b} c" * 300, "{" * 500, "}" * 500 + r"\boxed{1}", r"\boxed", r"\boxed{a \boxed{b}} \boxed{c}"]


def test_boxes(spark):
    given = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").repartition(4)
    out = df.select("i", braces.boxes("t").alias("boxes"), braces.last_boxes("t").alias("last"), braces.last_command("t").alias("command"), braces.last_content("t").alias("content"), braces.unbox("t").alias("unboxed"), braces.drop_last_box("t").alias("dropped"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        t = given[r.i]
        assert (r.boxes, r.last, r.command, r.content, r.unboxed, r.dropped) == (scan.boxes(t), scan.last_boxes(t), scan.last_command(t), scan.last_content(t), scan.unbox(t), scan.drop_last_box(t)), t


def test_commas(spark):
    given = [t for t in texts() if len(t) < 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").repartition(4)
    for r in df.select("i", braces.split_commas("t").alias("parts")).collect():
        assert r.parts == scan.split_commas(given[r.i]), given[r.i]
    rows = spark.createDataFrame([('(1, 2], {a, b}, "x, y", , z\\, w',)], "t string")
    forms = {"all": {}, "plain": {"quotes": False, "escapes": False}, "braces": {"brackets": "{", "quotes": False, "escapes": False}, "empty": {"keep_empty": True}}
    got = rows.select(*[F.array_join(braces.split_commas("t", **x), "|").alias(k) for k, x in forms.items()]).first()
    assert got.all == '(1, 2]|{a, b}|"x, y"|z\\, w' and got.plain == '(1, 2]|{a, b}|"x|y"|z\\|w' and got.braces == '(1|2]|{a, b}|"x|y"|z\\|w' and got.empty == '(1, 2]|{a, b}|"x, y"||z\\, w'


def test_null(spark):
    r = spark.createDataFrame([(None,)], "t string").select(braces.boxes("t").alias("b"), braces.last_command("t").alias("c"), braces.unbox("t").alias("u"), braces.drop_last_box("t").alias("d"), braces.split_commas("t").alias("s")).first()
    assert (r.b, r.c, r.u, r.d, r.s) == ([], None, "", "", [])
