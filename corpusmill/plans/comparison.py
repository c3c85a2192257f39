"""Comparison of answers in columns: expressions and equations by their values, unordered lists by matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import algebra, braces
from ..operators import matching
from ..shared import dealt


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# What both engines know of a part: numbers for its texts.
_PART = {
    "k": "p_partkey", "a": "CAST(p_size AS BIGINT)", "b": "p_partkey % 11 - 5", "s": "CAST(p_size AS BIGINT) - (p_partkey % 11 - 5) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END",
    "q": "CAST(p_size AS BIGINT) * (p_partkey % 11 - 5) + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END", "cents": "CAST(round(p_retailprice * 100) AS BIGINT)", "m": "p_partkey % 4 - 1", "e": "CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END",
}


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return dealt(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name"), "p_partkey").selectExpr(*[f"{x} AS {k}" for k, x in _PART.items()], "p_name")


_NUMBERS = f"(SELECT {', '.join(f'{x} AS {k}' for k, x in _PART.items())} FROM part)"


def equal_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Products against sums, roots against what stands under them, prices against hundredths."""
    df = _numbers(spark, d).select(
        "k", F.format_string("(x+%d)(x-(%d))", "a", "b").alias("product"), F.format_string("x^{2}+(%d)x-(%d)", "s", "q").alias("sum"), F.format_string("\\sqrt{(x-%d)^2}", "a").alias("root"),
        F.when(F.col("k") % 2 == 0, F.format_string("abs(%d-x)", "a")).otherwise(F.format_string("x-%d", "a")).alias("bare"), F.format_string("%.2fx", F.col("cents") / 100).alias("price"), F.format_string("\\frac{%d}{100}x", F.col("cents") + F.col("e")).alias("hundredths"),
        F.format_string("(x+%d", "a").alias("broken"),
    )
    pairs = {"expanded": ("product", "sum"), "rooted": ("root", "bare"), "priced": ("price", "hundredths"), "unread": ("broken", "sum")}
    return algebra.with_equal_expressions(df, pairs).select("k", "expanded", "rooted", "priced", "unread")


EQUAL_EXPRESSIONS = f"SELECT k, s = a - b AND q = a * b AS expanded, k % 2 = 0 AS rooted, e = 0 AS priced, NULL::BOOLEAN AS unread FROM {_NUMBERS}"


def equal_equations(spark: SparkSession, d: str) -> DataFrame:
    """A line against a multiple of itself, some with another constant; by sides that have changed places."""
    df = _numbers(spark, d).select(
        "k", F.format_string("%dx + (%d)y = %d", "a", F.col("b") + 6, "cents").alias("line"), F.format_string("(%d)x + (%d)y = %d", F.col("m") * F.col("a"), F.col("m") * (F.col("b") + 6), F.col("m") * F.col("cents") + F.col("e")).alias("times"),
        F.format_string("%d = %dx + (%d)y", "cents", "a", F.col("b") + 6).alias("turned"), F.format_string("y = \\sqrt{x^2}+%d", "a").alias("bent"), F.format_string("y-%d = %s", F.col("a") + F.col("e"), F.when(F.col("k") % 2 == 0, "abs(x)").otherwise("x")).alias("straight"),
    )
    return algebra.with_equal_equations(df, {"multiple": ("line", "times"), "swapped": ("line", "turned"), "branches": ("bent", "straight")}).select("k", "multiple", "swapped", "branches")


EQUAL_EQUATIONS = f"SELECT k, m <> 0 AND e = 0 AS multiple, TRUE AS swapped, k % 2 = 0 AND e = 0 AS branches FROM {_NUMBERS}"


QUERIES = {"equal_expressions": equal_expressions, "equal_equations": equal_equations}
ORACLES = {"equal_expressions": EQUAL_EXPRESSIONS, "equal_equations": EQUAL_EQUATIONS}


def unordered_lists(spark: SparkSession, d: str) -> DataFrame:
    """An order's quantities against readings of them that are up to 1.5 off, in any order, within 1."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # an order has a few lines
    items = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.row_number().over(w).cast("long").alias("i"), "l_quantity", "l_partkey")
    left = items.select("g", F.col("i").alias("l"), (F.col("l_quantity") + (F.col("l_partkey") % 7 - 3) * 0.5).alias("x"))
    right = items.select("g", (-F.col("i")).alias("r"), F.col("l_quantity").cast("double").alias("y"))
    return matching.same_numbers(left, right, 1.0).select(F.col("g").alias("l_orderkey"), F.col("n_left").alias("n_parts"), "same")


#: Of numbers and one tolerance, sorted parts can be paired if any can.
UNORDERED_LISTS = """WITH p AS (SELECT l_orderkey, l_quantity + (l_partkey % 7 - 3) * 0.5 AS x, l_quantity AS y FROM lineitem),
a AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS n FROM p), b AS (SELECT l_orderkey, y, row_number() OVER (PARTITION BY l_orderkey ORDER BY y) AS n FROM p)
SELECT l_orderkey, count(*) AS n_parts, bool_and(abs(x - y) <= 1.0) AS same FROM a JOIN b USING (l_orderkey, n) GROUP BY l_orderkey"""


def _with_boxes(df: DataFrame, text: str, n: str, k: str) -> DataFrame:
    """A text with two boxes, one with another one inside, and in every third row one that doesn't close, in every third one words behind."""
    tail = F.when(F.col(k) % 3 == 0, " or \\boxed{{open}").when(F.col(k) % 3 == 1, " end").otherwise("")
    return df.withColumn("t", F.concat(F.col(text), F.lit(" so \\boxed{"), n, F.lit("} and \\fbox{f} then \\boxed{ x_{"), k, F.lit("}^{{2}} } , \\boxed{a \\boxed{"), n, F.lit("} b}"), tail))


def boxes_of(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of documents and of conversations' turns: all, the last group, the last command, texts without boxes or without the last one."""
    docs = _with_boxes(_t(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text", F.col("n_chars").alias("n")), "text", "n", "id")
    turns = _with_boxes(_t(spark, d, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text", F.length("text").cast("long").alias("n")), "text", "n", "turn")
    return docs.unionByName(turns).select("kind", "id", "turn", F.array_join(braces.boxes("t"), "|").alias("boxes"), F.array_join(braces.last_boxes("t"), "|").alias("last_group"), braces.last_command("t").alias("last_command"), F.md5(braces.unbox("t")).alias("unboxed"), F.md5(braces.drop_last_box("t")).alias("without_last"))


_BOXES = r"""SELECT kind, id, turn, concat(n, '|x_{', k, '}^{{2}}|a \boxed{', n, '} b') AS boxes, concat('x_{', k, '}^{{2}}|a \boxed{', n, '} b') AS last_group, concat('\boxed{a \boxed{', n, '} b}') AS last_command,
  md5(concat(text, ' so ', n, ' and \fbox{f} then  x_{', k, '}^{{2}}  , a ', n, ' b', CASE k % 3 WHEN 0 THEN ' or \boxed{{open}' WHEN 1 THEN ' end' ELSE '' END)) AS unboxed,
  md5(concat(text, ' so \boxed{', n, '} and \fbox{f} then \boxed{ x_{', k, '}^{{2}} } ,', CASE k % 3 WHEN 0 THEN concat(' \boxed{a \boxed{', n, '} b} or \boxed{{open}') WHEN 1 THEN concat(' \boxed{a \boxed{', n, '} b} end') ELSE '' END)) AS without_last FROM """
BOXES_OF = f"{_BOXES} (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS turn, text, n_chars AS n, doc_id AS k FROM documents) UNION ALL {_BOXES} (SELECT 'turn' AS kind, conv_id AS id, turn, text, length(text) AS n, turn AS k FROM conversations)"


def comma_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts between commas in four ways: of an interval, a set, a quoted pair, an empty part, an escaped comma, and numbers of the table."""
    t = F.concat(F.lit("("), "c_custkey", F.lit(", "), "c_nationkey", F.lit("], {"), "c_mktsegment", F.lit(', b}, "x, y", , '), "c_name", F.lit("\\, w, f(1, {2, "), "c_nationkey", F.lit("})")).alias("t")
    df = _t(spark, d, "customer").select("c_custkey", t)
    forms = {"strict": {}, "plain": {"quotes": False, "escapes": False}, "in_braces": {"brackets": "{", "quotes": False, "escapes": False}, "with_empty": {"keep_empty": True}}
    return df.select("c_custkey", *[F.array_join(braces.split_commas("t", **x), "|").alias(k) for k, x in forms.items()])


COMMA_PARTS = r"""SELECT c_custkey, concat(a, '|', s, '|"x, y"|', c_name, '\, w|', f) AS strict, concat(a, '|', s, '|"x|y"|', c_name, '\|w|', f) AS plain,
  concat('(', c_custkey, '|', c_nationkey, ']|', s, '|"x|y"|', c_name, '\|w|f(1|{2, ', c_nationkey, '})') AS in_braces, concat(a, '|', s, '|"x, y"||', c_name, '\, w|', f) AS with_empty
FROM (SELECT *, concat('(', c_custkey, ', ', c_nationkey, ']') AS a, concat('{', c_mktsegment, ', b}') AS s, concat('f(1, {2, ', c_nationkey, '})') AS f FROM customer)"""


QUERIES |= {"unordered_lists": unordered_lists, "boxes_of": boxes_of, "comma_parts": comma_parts}
ORACLES |= {"unordered_lists": UNORDERED_LISTS, "boxes_of": BOXES_OF, "comma_parts": COMMA_PARTS}
