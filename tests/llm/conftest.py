import pytest

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a strange potion under the pale light of two moons and nobody in the village dares to ask them what it is for because the last one who asked was turned into a small green frog that still lives in the old well near the mill"
LONG = " ".join(f"w{i % 977}x{i * 7 % 1013}" for i in range(6000))

#: Null and empty texts, ties, repeated rows, copies, near copies, a very long text, odd characters.
ROWS = [
    (1, PASSAGE), (2, PASSAGE), (3, PASSAGE.replace("seven", "eight")), (4, None), (5, ""), (6, " \t\n "), (7, "one two three"), (8, "one two three"), (9, "ONE two\nthree"), (10, LONG), (11, "x" * 5000), (12, "x" * 130),
    (13, "intro line\n" + PASSAGE + "\noutro"), (14, "another intro\n" + PASSAGE + "\ndifferent end"), (15, "é中▁   \x00 end"), (16, "a b c d e f a b c d e f a b c d e f"), (17, PASSAGE), (17, PASSAGE), (None, PASSAGE), (None, None), (18, LONG[:3000]),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with further columns, of names that the operators use inside."""
    schema = "doc_id long, text string, n long, node long, `_h` string, uid long, tokens string, hi int"
    return spark.createDataFrame([(i, t, 9, 9, "h", 9, "t", 9) for i, t in ROWS], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
