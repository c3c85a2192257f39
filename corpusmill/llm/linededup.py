"""Line dedup in DataFrame operations only: a suffix array over line ids by prefix doubling.

Every line with a word gets an id, every position (document, line) a number in
the order of doc_id and line. Prefix doubling ranks the runs of 1, 2, 4, ... lines
at each position: the rank of a run of 2k lines is the place of the pair of its
halves' ranks in their sorted order, found by sorting the distinct pairs by ranges.
So ranks order positions as a suffix array does, and positions of one rank are an
interval of it whose longest common prefix is as long as the run. A position whose
run occurs nowhere else is an interval of its own and leaves the rounds.

A run counts if it has ``MIN_WORDS`` words or more. The common prefix of two
neighbours in the array has enough words if it is as long as the shortest run from
there that has; that run's interval is found by the ranks of its two (possibly
overlapping) halves, forwards from its first line and backwards from its last.
Every longer repeated run is the union of such ones, so what they cover together
are the maximal repeated runs. Of an interval all positions but the first are
copies, and are deleted; copies are judged on the input, not on what is left.
With ``min_words`` 1 every later copy of a line goes.

Lines without a word are neither compared nor deleted. A null text stays null,
an empty one empty. Rows with a null id come first in the order. Rows that are
repeated (same id, same text) are one document and all get its result; rows of
one id with different texts are different documents. Columns of the input keep
their names, whatever these are; only n_lines and n_removed are replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Words that a repeated run has at least, in one line or in several together.
MIN_WORDS = 50
_WORD = r"[^ \t\n\r\x0B\f]+"


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text hash, number among all lines (line) and among those with words (cline), words, id of each line with a word.

    uids follow the order of (doc_id, text hash, line), and are consecutive in a document.
    """
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    worded = F.filter(every, lambda s: F.length(F.btrim(s["x"], F.lit(C.SPACES))) > 0)
    rows = docs.select("doc_id", _text_hash().alias("th"), F.posexplode(worded).alias("cline", "s")).select(
        "doc_id", "th", "cline", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("h1"), F.xxhash64("s.x", F.lit(1)).alias("h2"), F.regexp_count("s.x", F.lit(_WORD)).alias("words")
    )
    rows = rows.dropDuplicates(["doc_id", "th", "cline"])
    n = C.partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th", "cline")
    return C.cut(ordered.withColumn("uid", F.monotonically_increasing_id()))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key occurs more than once, with the key's place in the order of all such keys (``rank``) and its first position (``first``).

    The ranks are checkpointed, so that they stay what they are, and both sides of the join are dealt out by it alone: Spark can then split a key with very many rows.
    """
    several = rows.groupBy(*keys).agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    ordered = several.repartitionByRange(C.partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return rows.join(C.cut(ordered.withColumn("rank", F.monotonically_increasing_id())), keys)


def _runs(live: DataFrame, min_words: int) -> DataFrame:
    """uid and m of the shortest runs with enough words that begin or end at a line, over repeated lines only."""

    def shortest(window: Window, step: int) -> Column:
        ahead = F.collect_list(F.struct("cline", "words")).over(window)
        ahead = ahead if step > 0 else F.reverse(ahead)
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
        grow = lambda a, x: F.when((a["sum"] < min_words) & (x["cline"] == F.col("cline") + step * a["n"]), F.struct((a["n"] + 1).alias("n"), (a["sum"] + x["words"]).alias("sum"))).otherwise(a)
        return F.aggregate(ahead, zero, grow, lambda a: F.when(a["sum"] >= min_words, a["n"]))

    w = Window.partitionBy("base").orderBy("cline")  # at most a document's lines
    reach = min_words - 1  # each line has a word
    both = live.select("uid", "cline", shortest(w.rowsBetween(0, reach), 1).alias("f"), shortest(w.rowsBetween(-reach, 0), -1).alias("b"))
    forward = both.filter("f is not null").select("uid", F.col("f").alias("m"))
    backward = both.filter("b is not null").select((F.col("uid") - F.col("b") + 1).alias("uid"), F.col("b").alias("m"))
    return forward.union(backward).distinct()


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """uids of the lines to delete."""
    words = F.least(F.col("words"), F.lit(min_words)).cast("int").alias("words")
    base = (F.col("uid") - F.col("cline")).alias("base")  # of the document
    ranks = C.cut(_ranked(lines.select("uid", base, "cline", words, "h1", "h2"), ["h1", "h2"]).select("uid", "base", "cline", "words", "rank", "first"))
    runs = C.cut(_runs(ranks, min_words))
    longest = runs.agg(F.max("m")).first()[0] or 0
    # intervals of runs of one line are at hand; each round doubles the length
    copies, k = [runs.filter("m = 1").join(ranks.filter("uid > first").select("uid"), "uid").select("uid", "m")], 1
    while k < longest:
        # a run of k < m <= 2k lines is two runs of k lines that may overlap; its document has both
        at = ranks.select("uid", "rank")
        head = runs.filter((F.col("m") > k) & (F.col("m") <= 2 * k)).join(at, "uid").withColumn("end", F.col("uid") + F.col("m") - k)
        pairs = C.cut(head.join(at.withColumnsRenamed({"uid": "end", "rank": "rank2"}), "end").select("uid", "m", "rank", "rank2"))
        interval = C.cut(pairs.groupBy("m", "rank", "rank2").agg(F.min("uid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
        copies.append(pairs.join(interval, ["m", "rank", "rank2"]).filter("uid > first").select("uid", "m"))
        if 2 * k >= longest:
            break
        ahead = Window.partitionBy("base").orderBy("cline").rangeBetween(k, k)
        doubled = ranks.select("uid", "base", "cline", F.col("rank").alias("rank1"), F.max("rank").over(ahead).alias("rank2")).filter("rank2 is not null")
        ranks = C.cut(_ranked(doubled, ["rank1", "rank2"]).select("uid", "base", "cline", "rank"))
        k *= 2
    hits = copies[0]
    for more in copies[1:]:
        hits = hits.union(more)
    return hits.select(F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"), "uid").select((F.col("uid") + F.col("i")).alias("uid")).distinct()


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their repeated runs deleted from ``text``, and n_lines, n_removed (lines with words)."""
    C.free_shuffles(docs.sparkSession)
    lines = _lines(docs)
    gone = repeated_lines(lines, min_words)
    removed = lines.join(gone, "uid").groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("line")).alias("gone"))
    # one byte for each line up to the last that goes: 1 where it goes
    back = F.col("gone")
    mask = F.array_join(F.transform(back, lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.when(i > 0, F.get(back, i - 1) + 1).otherwise(0)), F.lit("1"))), "")
    # the documents' own columns are numbered here, so that no name clashes
    own, out = {c: f"c{i}" for i, c in enumerate(docs.columns)}, {"n_lines", "n_removed", "text"}
    named = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], _text_hash().alias("th"))
    d = lambda c: F.col(own[c])
    removed = removed.select(F.col("doc_id").alias("id"), F.col("th").alias("h"), F.size("gone").cast("long").alias("n"), F.encode(mask, "utf-8").alias("mask"))
    both = named.join(removed, d("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h")), "left")
    every = F.split(d("text"), "\n", -1)
    kept = F.array_join(F.filter(every, lambda x, i: F.coalesce(F.substring(F.col("mask"), i + 1, F.lit(1)) != F.encode(F.lit("1"), "utf-8"), F.lit(True))), "\n")
    n_lines = F.when(d("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(every, lambda x: F.length(F.btrim(x, F.lit(C.SPACES))) > 0)))
    made = {"n_lines": n_lines.cast("long"), "n_removed": F.coalesce("n", F.lit(0)).cast("long"), "text": F.when(F.col("n").isNull(), d("text")).otherwise(kept)}
    # in two steps, as a name that a select gives could be taken for one that it uses
    both = both.select(*[d(c) for c in docs.columns if c not in out], *[x.alias(f"made_{k}") for k, x in made.items()])
    return both.select(*[d(c).alias(c) for c in docs.columns if c not in out], *[F.col(f"made_{k}").alias(k) for k in made])


def digest(deduped: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return deduped.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def oracle(min_words: int = MIN_WORDS) -> str:
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM d),
l AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^ \t\n\r\x0B\f]+')) AS w FROM e WHERE regexp_matches(x, '[^ \t\n\r\x0B\f]')),
n AS (SELECT *, row_number() OVER o AS n, sum(w) OVER o AS cum FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT a.doc_id, a.n AS s, min(b.n) AS t FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + {min_words - 1} AND b.cum - a.cum + a.w >= {min_words} GROUP BY ALL
  UNION SELECT b.doc_id, max(a.n), b.n FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + {min_words - 1} AND b.cum - a.cum + a.w >= {min_words} GROUP BY b.doc_id, b.n),
k AS (SELECT r.doc_id, s, t, string_agg(x, chr(10) ORDER BY n) AS run FROM r JOIN n ON n.doc_id = r.doc_id AND n BETWEEN s AND t GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT n.doc_id, n.i FROM f JOIN n ON n.doc_id = f.doc_id AND n.n BETWEEN s AND t WHERE nth > 1),
left_ AS (SELECT e.doc_id, string_agg(e.x, chr(10) ORDER BY e.i) AS text FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY ALL)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n_removed,
  length(coalesce(left_.text, '')) AS n_chars_left, sha256(coalesce(left_.text, '')) AS text_sha256
FROM d LEFT JOIN left_ USING (doc_id)"""
