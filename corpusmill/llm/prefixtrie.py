"""Conversation prefix trie: nodes are the distinct sequences of first turns, summed up by peeling leaves.

Every conversation's path is known by its prefixes: a prefix is the exclusive or of two 64-bit
hashes of (depth, role, text) over its turns, so prefixes are running sums, which ranges of
the sorted rows take apart; equal prefixes of equal depth are one node. A node is named by
its smallest member and its depth.

Subtree totals go up by messages. Each node holds how many of its children aren't
completed; a node with none left sends its totals to its parent and leaves, until only the
root is left. Chains of only children would cost a round for each turn; so each of
their nodes learns its chain's end beforehand by doubling pointers, the ends exchange the
messages, and the chain's other nodes take their totals from its end. There are as many
rounds as branching nodes stand on one path, and each round holds the nodes that are left.

Rows stand in the order of turn (nulls first), then digests of role and text. A null role or
text is empty; rows with a null conv_id belong to no conversation and are left out. Repeated
rows are turns of their own. Columns other than conv_id, turn, role and text aren't looked
at. An empty table has no conversation and gives an empty result, without a root. Two
sequences count as equal if their 128-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A rebuilt conversation begins with fewer turns than this of the first one of its block.
HEADS, BLOCK = 6, 100
_HASHES = ("z1", "z2")


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """Adds to the rows running sums and exclusive ors over their conversation, this row included, by ranges of the order.

    A conversation that reaches over several ranges gets from each range one row of totals.
    """
    ready = rows.withColumns(sums | xors)
    ordered = ready.repartitionByRange(C.partitions(rows.sparkSession), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    placed = C.cut(ordered.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    both = {k: F.sum for k in sums} | {k: F.bit_xor for k in xors}
    own = Window.partitionBy("conv_id", "_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("conv_id", "_range").agg(*[f(k).alias(k) for k, f in both.items()])
    before = totals.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_part"), *[F.coalesce(f(k).over(earlier), F.lit(0)).alias(f"_b_{k}") for k, f in both.items()], F.row_number().over(Window.partitionBy("conv_id").orderBy("_range")).alias("_nth")).filter("_nth > 1")
    out = placed.withColumns({k: f(k).over(own) for k, f in both.items()}).join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("_range") == F.col("_part")), "left")
    add = {k: F.col(k) + F.coalesce(f"_b_{k}", F.lit(0)) for k in sums} | {k: F.col(k).bitwiseXOR(F.coalesce(F.col(f"_b_{k}"), F.lit(0))) for k in xors}
    return out.withColumns(add).drop("_id", "_range", "_conv", "_part", "_nth", *[f"_b_{k}" for k in both])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two hashes of role and text, code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("_uid"))
    return running(rows, ["turn", "h1", "h2", "_uid"], {"pos": F.lit(1).cast("long")}, {}).drop("turn", "_uid")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, base, heads, n_own) of each conversation and its turns (conv_id, depth, h1, h2, chars) after it has been rebuilt.

    Its first ``heads`` turns are those of its block's first conversation, followed by its own after as many.
    """
    heads = (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("heads")
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("n_own")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), heads, "n_own")
    first = rows.filter((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    taken = convs.join(first, "base").filter("pos <= heads").select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "chars")
    have = convs.join(first.groupBy("base").agg(F.max("pos").alias("_n")), "base", "left").withColumn("_k", F.least("heads", F.coalesce("_n", F.lit(0)))).drop("_n")
    own = rows.join(have.select("conv_id", "heads", "_k"), "conv_id").filter("pos > heads").select("conv_id", (F.col("_k") + F.col("pos") - F.col("heads")).alias("depth"), "h1", "h2", "chars")
    lengths = have.withColumn("length", F.col("_k") + F.greatest(F.lit(0), F.col("n_own") - F.col("heads"))).select("conv_id", "length")
    return lengths, taken.unionByName(own)


def nodes_of(lengths: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (conv_id, depth, parent_conv_id, n_convs, weight, n_children) and the conversations that end in each (conv_id, depth, member)."""
    own = {f"z{i}": F.xxhash64(F.lit(i), "depth", f"h{i}") for i in (1, 2)}
    before = {f"o{i}": F.col(f"z{i}") for i in (1, 2)}
    at = C.cut(running(paths.withColumns(own).withColumns(before), ["depth"], {}, {z: F.col(z) for z in _HASHES}).select("conv_id", "depth", "chars", *_HASHES, *[F.col(f"o{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"u{i}") for i in (1, 2)]))
    found = at.groupBy("depth", *_HASHES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("u1").alias("u1"), F.min("u2").alias("u2"))
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("z1"), F.lit(0).cast("long").alias("z2"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"))
    every = C.cut(found.unionByName(top))
    children = every.groupBy((F.col("depth") - 1).alias("_d"), F.col("u1").alias("_1"), F.col("u2").alias("_2")).agg(F.count("*").alias("n_children")).filter("_d >= 0")
    parents = every.select(F.col("depth").alias("_pd"), F.col("z1").alias("_p1"), F.col("z2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = every.join(parents, (F.col("depth") - 1 == F.col("_pd")) & (F.col("u1") == F.col("_p1")) & (F.col("u2") == F.col("_p2")), "left").join(children, (F.col("depth") == F.col("_d")) & (F.col("z1") == F.col("_1")) & (F.col("z2") == F.col("_2")), "left")
    ends = at.join(lengths.select(F.col("conv_id").alias("_c"), "length"), (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("length"))).select("depth", *_HASHES, F.col("conv_id").alias("member"))
    ends = ends.join(every.select("depth", *_HASHES, "conv_id"), ["depth", *_HASHES]).select("conv_id", "depth", "member")
    turnless = lengths.filter("length = 0").select(F.col("conv_id").alias("member")).crossJoin(F.broadcast(top.select("conv_id", "depth")))  # one row
    return C.cut(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("weight"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))), ends.unionByName(turnless.select("conv_id", "depth", "member"))


def _chains(nodes: DataFrame) -> DataFrame:
    """For each only-child chain's node (one child; not the root): its chain's end (to_conv, to_depth) and the weights from it up to that end, by doubling pointers."""
    single = nodes.filter("n_children = 1 and depth > 0").select("conv_id", "depth", "weight")
    child = nodes.filter("depth > 0").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), (F.col("n_children") != 1).alias("over"))
    links, ended = C.cut(single.join(child, ["conv_id", "depth"])), []
    while True:
        ended.append(links.filter("over").drop("over"))
        open_ = links.filter("not over")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        known = reduce(DataFrame.unionByName, [links, *[x.withColumn("over", F.lit(True)) for x in ended[:-1]]])
        onward = known.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("weight").alias("_w"), F.col("to_conv").alias("_c"), F.col("to_depth").alias("_d"), F.col("over").alias("_o"))
        links = C.cut(open_.join(onward, ["to_conv", "to_depth"]).select("conv_id", "depth", (F.col("weight") + F.col("_w")).alias("weight"), F.col("_c").alias("to_conv"), F.col("_d").alias("to_depth"), F.col("_o").alias("over")))


def peel(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves and saved_tokens of each node: totals over its subtree."""
    chains = C.cut(_chains(nodes))
    ends = nodes.filter("n_children <> 1 or depth = 0")
    #: The topmost node of a chain is the child of a branching node or of the root: the chain's end answers to that one.
    branching = ends.filter("n_children > 0").select(F.col("conv_id").alias("_bc"), F.col("depth").alias("_bd"))
    tops = nodes.join(branching, (F.col("parent_conv_id") == F.col("_bc")) & (F.col("depth") - 1 == F.col("_bd"))).select("conv_id", "depth", "_bc", "_bd")
    short = chains.withColumnRenamed("weight", "extra")
    answers = tops.join(short, ["conv_id", "depth"], "left").select(F.coalesce("to_conv", "conv_id").alias("conv_id"), F.coalesce("to_depth", "depth").alias("depth"), F.col("_bc").alias("up_conv"), F.col("_bd").alias("up_depth"), F.coalesce("extra", F.lit(0)).alias("extra"))
    live = C.cut(ends.join(answers, ["conv_id", "depth"], "left").select("conv_id", "depth", "up_conv", "up_depth", "extra", F.col("n_children").alias("waits"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("weight").alias("saved_tokens")))
    completed = []
    while True:
        done = live.filter("waits = 0")
        completed.append(done.select("conv_id", "depth", "n_leaves", "saved_tokens"))
        waiting = live.filter("waits > 0")
        if waiting.isEmpty():
            break
        sent = done.filter("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_l"), F.sum(F.col("saved_tokens") + F.col("extra")).alias("_s"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        live = C.cut(waiting.join(sent, ["conv_id", "depth"], "left").select("conv_id", "depth", "up_conv", "up_depth", "extra", (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits"), plus("n_leaves", "_l"), plus("saved_tokens", "_s")))
    totals = C.cut(reduce(DataFrame.unionByName, completed))
    inner = chains.join(totals.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), "n_leaves", "saved_tokens"), ["to_conv", "to_depth"]).select("conv_id", "depth", "n_leaves", (F.col("saved_tokens") + F.col("weight")).alias("saved_tokens"))
    return totals.unionByName(inner)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's members, comma-joined, from rows sorted by node and member; holds one hash at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, hashed, out = None, None, []
    for batch in batches:
        for *at, member in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if at == node:
                hashed.update(f",{member}".encode())
                continue
            if node:
                out.append((*node, hashed.hexdigest()))
            node, hashed = at, hashlib.sha256(str(member).encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if node:
        out.append((*node, hashed.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def trie(lengths: DataFrame, paths: DataFrame) -> DataFrame:
    """The trie of any conversations.

    lengths: conv_id and length of each; paths: conv_id, depth (from 1), h1 and h2 (hashes of
    role and text) and chars of each of their turns.
    """
    nodes, ends = nodes_of(lengths, paths)
    C.bound_batches(nodes.sparkSession)
    hashes = ends.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "member").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")
    out = nodes.join(peel(nodes), ["conv_id", "depth"]).join(hashes, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as ``rebuilt`` makes them."""
    return trie(*[C.cut(x) for x in rebuilt(turns(conversations))])


def oracle() -> str:
    """DuckDB SQL: whole paths as lists, every node against the paths below it."""
    return f"""
WITH RECURSIVE named AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, s, k, x) AS (
  SELECT conv_id, s, 1, 4294967295::BIGINT FROM named
  UNION ALL SELECT conv_id, s, k + 1, {C.crc32_step()} FROM crc WHERE k <= length(s)),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(x, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = length(s) + 1),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS l FROM t GROUP BY conv_id),
paths AS (SELECT c.conv_id, list_concat(coalesce(b.l, [])[1:c.h], o.l[c.h + 1:]) AS p FROM convs c JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = c.base),
steps AS (SELECT conv_id, d, p[1:d] AS node, d = len(p) AS ends, CASE WHEN d = 0 THEN 0 ELSE length(p[d].t) END AS chars FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM steps GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
named_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node, d)),
below AS (SELECT s.node, s.d, sum((n.n_children = 0)::INT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM named_nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.d <= n.d GROUP BY s.node, s.d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM named_nodes n JOIN below b ON b.node = n.node AND b.d = n.d LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]"""
