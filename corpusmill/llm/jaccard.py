"""N-gram Jaccard join by vertical partitioning, and its connected components.

A document's set is that of its distinct word shingles; two documents link when
100 * intersection >= ``percent`` * union. Sets are cut into fragments of the
global shingle order, fragments are counted apart and the counts summed, three
times over:

1. By hash order: a linked pair shares ``LEAST`` of its shingles among the
   first of both. Fragments of these prefixes count, for each document, the
   shingles that any other document has; whoever has too few links with none.
2. By frequency among those left: fragments count each shingle's documents.
   With rare shingles first, a prefix leads to candidates (prefix, size and
   position filters).
3. Candidates are verified: each fragment's partial overlap, summed per pair.

Documents of one set are one class, compared once. Candidates are first tried
against the most central document that shares a rare shingle with them, twice,
so that a large group of near copies becomes one component by as many pairs as
it has members; only pairs of different components are compared after that. No
link between components is lost, as all their candidate pairs are verified.

Texts without words, or null ones, have the empty set and link with nothing.
Rows of one id are one node, whatever their texts; a row with a null id has no
links and a null component. Repeated rows get the same row each; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS, PERCENT = 5, 75
#: One of so many shingles must be shared among the first ones.
LEAST = 20
#: Shingles of a group or fragment that one task holds, about.
GROUP = 1_500_000
#: Bytes hashed at a time.
PIECE = 1 << 15
#: Fragments of a set in verification.
CUTS = 4
#: Rounds against central documents.
STARS = 2
#: Ids that are broadcast at most, to keep sets that are in no pair out of a join: 8 bytes each.
BROADCAST_IDS = 1_000_000
_SIGN = np.uint64(1 << 63)


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; texts are hashed together in pieces that fit a core's cache."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        ids, starts = C.word_hashes(np.frombuffer(b" ".join(group), np.uint8), lower=True)
        begins = np.cumsum([0] + [len(t) + 1 for t in group])
        edges = np.searchsorted(starts, begins).tolist()
        all_windows = C.windows(ids, n)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a >= n:
                x = np.sort(all_windows[a : b - n + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            else:
                out.append(C.windows(ids[a:b], b - a) + np.uint64(b - a) if b > a else np.empty(0, np.uint64))

    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        if held and held + len(data) > PIECE:
            flush()
            group, held = [], 0
        group.append(data)
        held += len(data)
    if group:
        flush()
    return out


def key_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers; the first is never 0."""
    h = xxhash.xxh3_128_digest(tokens.tobytes())
    hi, lo = (int.from_bytes(h[i : i + 8], "little", signed=True) for i in (0, 8))
    return hi or 1, lo


def least(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """What a set of n shingles shares with a linked one at least."""
    return -(-n * percent // 100)


def _first(tokens: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    return tokens[: min(n, n - int(least(np.int64(n), percent)) + -(-n // LEAST))]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, size of the set and its key."""

    def work():
        def each(part, texts):
            sets = shingle_sets(texts)
            keys = [key_of(s) if len(s) else (None, None) for s in sets]
            return {"doc_id": C.column(part, "doc_id"), "n": [len(s) for s in sets], "hi": [k[0] for k in keys], "lo": [k[1] for k in keys]}

        return each

    return C.map_texts(docs.select("doc_id", "text"), "doc_id long, n long, hi long, lo long", work)


def _by_fragment(tokens: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by fragment, and where each fragment begins in it."""
    at = (C.mix(tokens) % np.uint64(fragments)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(fragments + 1))


def shared_counts(docs: DataFrame, fragments: int, percent: int) -> DataFrame:
    """hi of each set, and how many of its first shingles (by hash) some other set has among its first."""

    def work():
        def each(part, texts):
            sets = {}
            for s in shingle_sets(texts):
                if len(s):
                    sets[key_of(s)[0]] = _first(s, percent)
            node = np.array(list(sets), np.int64)
            token = np.concatenate(list(sets.values())) if sets else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(node)), [len(s) for s in sets.values()]) if sets else np.empty(0, np.int64)
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
            runs = np.diff(np.append(begins, len(token)))
            # what several sets of this chunk have is counted here; one row, of no set, tells the other chunks of it
            several = np.repeat(runs > 1, runs)
            local = np.bincount(owner[several], minlength=len(node))
            sent = np.concatenate([token[~several], token[begins[runs > 1]]])
            by = np.concatenate([node[owner[~several]], np.zeros(int((runs > 1).sum()), np.int64)])
            order, start = _by_fragment(sent, fragments)
            sent, by = sent[order], by[order]
            out = {"fragment": [], "tokens": [], "nodes": [], "counts": []}
            for f in range(fragments):
                if start[f] < start[f + 1]:
                    for name, x in (("fragment", f), ("tokens", sent[start[f] : start[f + 1]].tobytes()), ("nodes", by[start[f] : start[f + 1]].tobytes()), ("counts", None)):
                        out[name].append(x)
            if local.any():
                for name, x in (("fragment", int(abs(int(node[0]))) % fragments), ("tokens", None), ("nodes", node[local > 0].tobytes()), ("counts", local[local > 0].astype(np.int64).tobytes())):
                    out[name].append(x)
            return out

        return each

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent = [r for r in rows if r["counts"] is None]
        token = np.concatenate([np.frombuffer(r["tokens"], np.uint64) for r in sent] or [np.empty(0, np.uint64)])
        node = np.concatenate([np.frombuffer(r["nodes"], np.int64) for r in sent] or [np.empty(0, np.int64)])
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new_token = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.empty(0, bool)
        new = new_token | np.concatenate([[True], node[1:] != node[:-1]]) if len(token) else new_token
        token, node, new_token = token[new], node[new], new_token[new]  # copies in other chunks count once
        runs = np.diff(np.append(np.flatnonzero(new_token), len(token)))
        lone = np.repeat(runs == 1, runs)
        found = [node[~lone & (node != 0)]]
        amount = [np.ones(len(found[0]), np.int64)]
        for r in rows:
            if r["counts"] is not None:
                found.append(np.frombuffer(r["nodes"], np.int64))
                amount.append(np.frombuffer(r["counts"], np.int64))
        uniq, at = np.unique(np.concatenate(found), return_inverse=True)
        n, of = np.bincount(at, np.concatenate(amount), len(uniq)).astype(np.int64), uniq % fragments
        order = np.argsort(of, kind="stable")
        uniq, n = uniq[order], n[order]
        start = np.searchsorted(of[order], np.arange(fragments + 1))
        full = np.flatnonzero(np.diff(start)).tolist()
        cut = lambda x: pa.array([x[start[g] : start[g + 1]].tobytes() for g in full], pa.binary())
        return pa.table({"g": pa.array(full, pa.int32()), "nodes": cut(uniq), "counts": cut(n)})

    def add_up(table: pa.Table) -> pa.Table:
        node, n = (np.concatenate([np.frombuffer(b, np.int64) for b in table.column(c).to_pylist()]) for c in ("nodes", "counts"))
        uniq, at = np.unique(node, return_inverse=True)
        return pa.table({"hi": pa.array(uniq, pa.int64()), "shared": pa.array(np.bincount(at, n, len(uniq)).astype(np.int64), pa.int64())})

    sent = C.map_texts(docs.select("text"), "fragment int, tokens binary, nodes binary, counts binary", work)
    packed = sent.groupBy("fragment").applyInArrow(count, "g int, nodes binary, counts binary")
    return packed.groupBy("g").applyInArrow(add_up, "hi long, shared long")


def _sets(docs: DataFrame, wanted: DataFrame, groups: int) -> DataFrame:
    """node, size, sorted shingles and group of the wanted sets (doc_id, hi, lo, node, n)."""
    w = wanted.select(F.col("doc_id").alias("_id"), "hi", "lo", "node")
    rows = docs.select("doc_id", "text").join(w, F.col("doc_id") == F.col("_id")).select("text", "hi", "lo", "node")

    def work():
        def each(part, texts):
            out = {"node": [], "n": [], "tokens": [], "g": []}
            his, los, nodes = (C.column(part, c).to_pylist() for c in ("hi", "lo", "node"))
            for s, hi, lo, node in zip(shingle_sets(texts), his, los, nodes, strict=True):
                if len(s) and key_of(s) == (hi, lo):  # an id can have several texts
                    for name, x in (("node", node), ("n", len(s)), ("tokens", s.tobytes()), ("g", xxhash.xxh32_intdigest(str(node)) % groups)):
                        out[name].append(x)
            return out

        return each

    return C.map_texts(rows, "node long, n long, tokens binary, g int", work).dropDuplicates(["node"])


def _prefixes(sets: DataFrame, fragments: int, percent: int) -> DataFrame:
    """token, node, n, s (shingles that others have) and pos (from 1) of the shingles of each set's prefix, rarest first."""

    def ordered(tables: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles of a group in the order of their fragments, in how many of its sets each is, and where each fragment begins."""
        token, count = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in tables]), return_counts=True)
        order, start = _by_fragment(token, fragments)
        return token[order], count[order], start

    def distinct(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        token, count, start = ordered(table.column("tokens").to_pylist())
        full = [f for f in range(fragments) if start[f] < start[f + 1]]
        # most are in one set of the group: counts go along of the others only, with their places
        some = [(at := np.flatnonzero(count[start[f] : start[f + 1]] > 1).astype(np.int32), count[start[f] + at].astype(np.int32)) for f in full]
        binary = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
        return pa.table({"fragment": pa.array(full, pa.int32()), "g": pa.array([g] * len(full), pa.int32()), "tokens": binary([token[start[f] : start[f + 1]] for f in full]), "places": binary([a for a, _ in some]), "counts": binary([n for _, n in some])})

    def frequencies(table: pa.Table) -> pa.Table:
        fragment, gs = table.column("fragment")[0].as_py(), table.column("g").to_pylist()
        tokens, places, counts = ([np.frombuffer(b, kind) for b in table.column(c).to_pylist()] for c, kind in (("tokens", np.uint64), ("places", np.int32), ("counts", np.int32)))
        n = np.ones(sum(map(len, tokens)), np.int64)
        base = np.cumsum([0, *map(len, tokens)])
        for b, at, k in zip(base, places, counts):
            n[b + at] = k
        uniq, at = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(at, n, len(uniq)).astype(np.int32)[at]
        # in the order in which the group sent them, so that the shingles needn't go back
        return pa.table({"g": pa.array(gs, pa.int32()), "fragment": pa.array([fragment] * len(gs), pa.int32()), "df": pa.array([df[a:b].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)], pa.binary())})

    def prefix(sets: pa.Table, known: pa.Table) -> pa.Table:
        out = {k: [] for k in ("token", "node", "n", "s", "pos")}
        if sets.num_rows and known.num_rows:
            token, _, _ = ordered(sets.column("tokens").to_pylist())
            df = np.concatenate([np.frombuffer(b, np.int32) for _, b in sorted(zip(known.column("fragment").to_pylist(), known.column("df").to_pylist(), strict=True))])
            token, df = token[df > 1], df[df > 1]
            order = np.argsort(token)
            token, df = token[order], df[order]
            for node, n, b in zip(*(sets.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                own = np.frombuffer(b, np.uint64)
                at = np.minimum(np.searchsorted(token, own), max(len(token) - 1, 0))
                common = token[at] == own if len(token) else np.zeros(n, bool)
                s = int(common.sum())
                reach = n - int(least(np.int64(n), percent)) + 1 - (n - s)  # shingles of the prefix after those that no other set has
                if reach <= 0:
                    continue
                own, d = own[common], df[at[common]]
                chosen = own[np.lexsort((own, d))[:reach]]
                out["token"].append(chosen)
                for name, x in (("node", node), ("n", n), ("s", s)):
                    out[name].append(np.full(len(chosen), x, np.int64))
                out["pos"].append(n - s + 1 + np.arange(len(chosen)))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({k: pa.array((join(x).view(np.int64) if k == "token" else join(x)), pa.int64()) for k, x in out.items()})

    sent = sets.select("g", "tokens").groupBy("g").applyInArrow(distinct, "fragment int, g int, tokens binary, places binary, counts binary")
    known = sent.groupBy("fragment").applyInArrow(frequencies, "g int, fragment int, df binary")
    return sets.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(prefix, "token long, node long, n long, s long, pos long")


def _possible(percent: int) -> F.Column:
    """Whether rows a and b of one token can link by their sizes, what they share with any other, and their places."""
    n = F.col("a.n") + F.col("b.n")
    need = F.ceil(percent * n / (100 + percent))
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) + 1
    return (F.least("a.s", "b.s") >= need) & (rest >= need) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))


def _in_pairs(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets whose node is among the ids, where these are few enough to be sent to every task; else all, which the join sorts out."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids), "node", "left_semi") if few else sets  # BROADCAST_IDS numbers at most


def overlaps(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b), a checkpointed table, that link: each fragment's partial overlap, summed per pair."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, CUTS, dtype=np.float64) * (2.0**64 / CUTS)).astype(np.uint64)
        for batch in batches:
            out = {"node": [], "n": [], "cut": [], "part": []}
            for node, n, b in zip(*(C.column(batch, c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                for k, part in enumerate(np.split(t := np.frombuffer(b, np.uint64), np.searchsorted(t, edges))):
                    if len(part):
                        for name, x in (("node", node), ("n", n), ("cut", k), ("part", part.tobytes())):
                            out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["cut"], pa.int32()), pa.array(out["part"], pa.binary())], names=list(out))

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")

    def parts(side: str) -> DataFrame:
        own = _in_pairs(sets.select("node", "n", "tokens"), pairs.select(F.col(side).alias("node")).distinct())
        return own.mapInArrow(split, "node long, n long, cut int, part binary")

    left = parts("a").select(F.col("node").alias("a"), F.col("n").alias("na"), "cut", F.col("part").alias("pa"))
    right = parts("b").select(F.col("node").alias("b"), F.col("n").alias("nb"), "cut", F.col("part").alias("pb"))
    both = pairs.join(left, "a").join(right, ["b", "cut"])
    total = both.select("a", "b", "na", "nb", common("pa", "pb").alias("part")).groupBy("a", "b").agg(F.sum("part").alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b", "overlap")


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it reaches) of all nodes of the edges (a, b)."""
    both = C.cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = C.cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("heard")).withColumnRenamed("a", "node")
        nearer = labels.join(heard, "node").select("node", "comp", F.least("comp", "heard").alias("next"))
        # and from there to where that label's node has got
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = C.cut(nearer.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("new")))
        labels = moved.select("node", F.col("new").alias("comp"))
        if moved.filter("new <> comp").isEmpty():
            return labels


def _candidates(rows: DataFrame, percent: int, star: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a token of their prefixes; with ``star``, of each node and the most central one at most."""
    # checkpointed, so that Spark can split a token with very many rows in the joins
    mixed = C.cut(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "n", "s", "pos", "comp"), F.struct(F.col("n") - F.col("s"), "node")).alias("p")).filter("lo <> hi"))
    if star:
        a, b = rows.alias("a"), mixed.select("token", "p.*").alias("b")
        met = a.join(b, F.col("a.token") == F.col("b.token")).filter((F.col("a.comp") != F.col("b.comp")) & _possible(percent))
        best = met.groupBy(F.col("a.node").alias("a")).agg(F.min_by("b.node", F.struct(F.col("b.n") - F.col("b.s"), "b.node")).alias("b"))
        return best.select("a", "b")
    live = rows.join(mixed.select("token"), "token")
    a, b = live.alias("a"), live.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.comp") < F.col("b.comp")) & _possible(percent))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, the smallest doc_id that it reaches."""
    spark = docs.sparkSession
    C.free_shuffles(spark)
    info = C.cut(describe(docs).withColumn("uid", F.monotonically_increasing_id()))
    known = info.filter("doc_id is not null and n > 0")
    classes = C.cut(known.groupBy("n", "hi", "lo").agg(F.min("uid").alias("node"), F.min("doc_id").alias("doc_id")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    p = C.partitions(spark)
    shared = C.cut(shared_counts(docs.filter("doc_id is not null"), max(p, -(-total // (3 * GROUP))), percent))
    # a linked set can be smaller by a quarter, and then shares as many as that one must
    need = F.ceil(F.ceil(F.col("n") * percent / 100) / LEAST)
    wanted = classes.join(shared, "hi").filter(F.col("shared") >= need)
    groups = max(p, -(-total // GROUP))
    sets = C.cut(_sets(docs, wanted, groups))
    rows = C.cut(_prefixes(sets, groups, percent))
    edges, labels = None, None
    for k in range(STARS + 1):
        now = rows.withColumn("comp", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        found = C.cut(overlaps(sets, C.cut(_candidates(now, percent, k < STARS)), percent).select("a", "b"))
        if found.isEmpty():
            if k < STARS:
                continue
            break
        edges = found if edges is None else C.cut(edges.union(found))
        labels = components(edges)
    if labels is None:
        labels = spark.createDataFrame([], "node long, comp long")
    # a class is a node, an id of several texts joins their classes
    placed = classes.join(labels, "node", "left").select("n", "hi", "lo", F.coalesce("comp", "node").alias("comp"))
    member = C.cut(info.join(placed, ["n", "hi", "lo"], "left").select("uid", "doc_id", "n", "comp"))
    twice = member.filter("comp is not null and doc_id is not null").groupBy("doc_id").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_distinct("comp").alias("k")).filter("k > 1")
    if not twice.isEmpty():
        merged = components(member.join(twice.select("doc_id", "lo"), "doc_id").filter("comp <> lo").select(F.col("comp").alias("a"), F.col("lo").alias("b")))
        member = C.cut(member.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("uid", "doc_id", "n", F.coalesce("to", "comp").alias("comp")))
    # checkpointed, so that Spark can split a component with very many documents in the join
    ids = C.cut(member.filter("comp is not null and doc_id is not null").groupBy("comp").agg(F.min("doc_id").alias("least")))
    return member.join(ids, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are the first of their component. All rows of a kept id stay, as they are one document; a row with a null id has no links and stays."""
    found = jaccard_components(docs, percent)
    later = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
