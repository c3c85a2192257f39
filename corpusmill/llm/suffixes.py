"""Suffix-array dedup of byte strings, by two-stage sorting.

Every byte that a ``LENGTH``-byte string covers which also starts earlier
(smaller doc_id, or the same document and an earlier start) is removed.

1. Anchors. Of each window of ``LENGTH`` bytes the ``GRAM``-byte string with the
   smallest hash is its anchor, so equal windows have equal anchors at equal
   places. Packed by fragments of their hashes, anchors are counted; those that
   occur once are done with.
2. Each other anchor sends the bytes of its windows to its bucket. There the
   suffixes are sorted: those smaller than their successors directly, the rest
   are induced by scanning the buckets of first bytes upwards. Adjacent common
   prefixes of ``LENGTH`` bytes make classes of equal windows; all but a class's
   first window are removed.
3. Anchors with very many places are dealt out to several buckets; each sends on
   the first window of its classes, and these meet by their digest.
4. A document's removed windows are merged.

Whole copies of an earlier text are found by their digest beforehand; they are
removed as a whole (shorter ones than ``LENGTH`` are left alone). A null text is
empty. Rows with a null id come first in the order. Rows with the same id and
text are one document and get its result each; rows of one id with different
texts are different documents, in the order of a digest. An empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 100, 24
#: Bytes of contexts in a bucket, anchors in a fragment, bytes sorted at a time, about.
BUCKET, FRAGMENT, BLOCK = 8_000_000, 1_500_000, 300_000
#: An anchor with this many places at least can be a hot one.
HOT = 2000
#: Bytes hashed at a time.
PIECE = 1 << 15
_PLACE = 15
_FIRST = -(1 << 63)
_SEED = np.uint64(0x9E3779B97F4A7C15)


# ---- anchors -------------------------------------------------------------------------------------


_OF_BYTE = C.mix(np.arange(256, dtype=np.uint64) + _SEED)


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all n-byte strings, made of those of its binary parts."""
    total = len(data) - n + 1
    part, size, out, at = _OF_BYTE[data], 1, None, 0
    while size <= n:
        if n & size:
            x = part[at : at + total]
            out = x.copy() if out is None else out * C.M1 + x
            at += size
        if size * 2 <= n:
            part = part[:-size] * C.M2 + part[size:]
            part ^= part >> np.uint64(29)
        size *= 2
    out *= C.M1
    out ^= out >> np.uint64(32)
    out *= C.M2
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, of windows whose lengths double."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The anchors of texts, the leftmost of equal hashes: owner, hash, place, first and last start of the windows it stands for.

    Texts are worked off in pieces that fit a core's cache, short ones together,
    long ones cut with an overlap.
    """
    pieces: list[tuple[np.ndarray, ...]] = []

    def work(data: np.ndarray, owner: np.ndarray, base: np.ndarray, end: np.ndarray) -> None:
        """owner, base and end of each window start."""
        h = gram_hashes(data)
        keys = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_min(keys, LENGTH - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        starts = np.arange(len(place))
        inside = np.flatnonzero(starts + LENGTH <= end[: len(place)])
        if not len(inside):
            return
        starts, place, own = starts[inside], place[inside], owner[inside]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
        last = np.append(first[1:], len(place)) - 1
        shift = base[inside[first]]
        pieces.append((own[first], h[place[first]], place[first] - shift, starts[first] - shift, starts[last] - shift))

    def flush(group: list[int]) -> None:
        size = np.array([len(texts[i]) for i in group], np.int64)
        if size.sum() >= LENGTH:
            base = np.cumsum(size) - size
            work(np.frombuffer(b"".join(texts[i] for i in group), np.uint8), np.repeat(np.array(group), size), np.repeat(base, size), np.repeat(base + size, size))

    group, held = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if held and held + len(t) > PIECE:
            flush(group)
            group, held = [], 0
        if len(t) <= PIECE:
            group.append(i)
            held += len(t)
            continue
        step = PIECE - LENGTH + 1
        for a in range(0, len(t) - LENGTH + 1, step):
            data = np.frombuffer(t, np.uint8)[a : a + PIECE]
            n = len(data)
            work(data, np.full(n, i), np.full(n, -a), np.full(n, n))
    if group:
        flush(group)
    if not pieces:
        return tuple(np.empty(0, np.uint64 if k == 1 else np.int64) for k in range(5))
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


# ---- sorting -------------------------------------------------------------------------------------


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one isn't."""
    change = np.flatnonzero(t[1:] != t[:-1])
    rises = t[change] < t[change + 1]
    at = np.searchsorted(change, np.arange(len(t)))
    return np.append(rises, False)[at]


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols: Itoh and Tanaka's two stages.

    t: uint8 symbols, 0 ends a string and stands at the end. Suffixes that are
    smaller than their successors are sorted directly. Then the buckets of first
    symbols are scanned upwards; each suffix that is reached puts its
    predecessor, if that is the larger one, at the next place of its bucket.
    """
    n = len(t)
    small = smaller_than_next(t)
    chars = t.tobytes().decode("latin-1")
    direct = np.flatnonzero(small & (t != 0))
    keys = [chars[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    by_symbol = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scanned(part: np.ndarray, symbol: int) -> np.ndarray:
        """Puts the predecessors of a part of the array into their buckets; returns those of this same bucket."""
        before = part[part > 0] - 1
        before = before[~small[before] & (t[before] >= symbol) & (t[before] != 0)]
        of = t[before]
        order = np.argsort(of, kind="stable")
        before, of = before[order], of[order]
        same = np.searchsorted(of, symbol + 1) if symbol else 0
        edges = np.flatnonzero(np.diff(of[same:])) + 1 + same
        for piece in np.split(before, np.concatenate([[same], edges]).astype(np.int64))[1:]:
            if len(piece):
                waiting[t[piece[0]]].append(piece)
        return before[:same]

    for symbol in range(256):
        part = np.flatnonzero(t == 0) if symbol == 0 else np.concatenate(waiting[symbol]) if waiting[symbol] else np.empty(0, np.int64)
        while len(part):  # larger than their successors: induced, those with a successor in this bucket in further rounds
            out.append(part)
            part = scanned(part, symbol)
        part = direct[by_symbol[symbol] : by_symbol[symbol + 1]]
        if len(part):
            out.append(part)
            scanned(part, symbol)
    sa = np.concatenate(out)
    assert len(sa) == n
    return sa


def equal_windows(parts: list[bytes], windows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows that begin at the first ``windows[i]`` places of parts[i]: class, part and place of each."""
    # 0 must be free to end strings: bytes 0 and 1 can be told apart by no one-byte symbol, so 0 becomes 0xC0, which UTF-8 never has
    t = np.frombuffer(b"\0".join(p.replace(b"\0", b"\xc0") for p in parts) + b"\0", np.uint8)
    size = np.array([len(p) + 1 for p in parts], np.int64)
    base = np.cumsum(size) - size
    part = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(t)) - base[part]
    begins = place < windows[part]
    sa = suffix_array(t, length)
    sa = sa[begins[sa]]
    view = np.lib.stride_tricks.sliding_window_view(t, length)
    new = np.ones(len(sa), bool)
    for i in range(1, len(sa), 20_000):  # adjacent common prefixes, as far as length
        j = min(i + 20_000, len(sa))
        new[i:j] = (view[sa[i:j]] != view[sa[i - 1 : j - 1]]).any(1)
    return np.cumsum(new), part[sa], place[sa]


# ---- the jobs ------------------------------------------------------------------------------------


def _document() -> dict[str, Column]:
    """The order of documents: did, then dk."""
    text = F.coalesce("text", F.lit(""))
    return {"did": F.coalesce("doc_id", F.lit(_FIRST)), "dk": F.xxhash64(F.coalesce("doc_id", F.lit(_FIRST)), text)}


def _live(docs: DataFrame, fragments: int, groups: int, hot: int) -> DataFrame:
    """dks and places (int32) of anchors whose hash occurs again, packed by groups of documents; h and n of those with ``hot`` places or more."""

    def work():
        def each(part, texts):
            owner, h, place, _, _ = _anchors_of([t.encode("utf-8", "surrogatepass") for t in texts])
            key = np.array(C.column(part, "dk").to_pylist(), np.int64)
            order = np.argsort(h, kind="stable")
            h, dk, place = h[order], key[owner[order]], place[order].astype(np.int32)
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            runs = np.diff(np.append(begins, len(h)))
            several = np.repeat(runs > 1, runs)
            # of an anchor with several places here, these are known; one row tells how many
            some = begins[runs > 1]
            sent = np.concatenate([h[~several], h[some]])
            by = np.concatenate([dk[~several], np.zeros(len(some), np.int64)])
            what = np.concatenate([place[~several], -runs[runs > 1].astype(np.int32)])
            at = (C.mix(sent) % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            sent, by, what = sent[order], by[order], what[order]
            start = np.searchsorted(at[order], np.arange(fragments + 1))
            out = {"fragment": [], "h": [], "dk": [], "place": []}
            add = lambda f, *x: [out[k].append(v) for k, v in zip(out, (f, *x), strict=True)]
            for f in np.flatnonzero(np.diff(start)):
                s = slice(start[f], start[f + 1])
                add(int(f), sent[s].tobytes(), by[s].tobytes(), what[s].tobytes())
            if several.any():
                add(int(h[0] % np.uint64(fragments)), None, dk[several].tobytes(), place[several].tobytes())
            return out

        return each

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        join = lambda k, kind, rs: np.concatenate([np.frombuffer(r[k], kind) for r in rs] or [np.empty(0, kind)])
        sent, known = [r for r in rows if r["h"] is not None], [r for r in rows if r["h"] is None]
        h, dk, place = join("h", np.uint64, sent), join("dk", np.int64, sent), join("place", np.int32, sent)
        uniq, at = np.unique(h, return_inverse=True)
        n = np.bincount(at, np.where(place < 0, -place, 1), len(uniq)).astype(np.int64)
        again = (n[at] > 1) & (place >= 0)
        dk, place = np.concatenate([dk[again], join("dk", np.int64, known)]), np.concatenate([place[again], join("place", np.int32, known)])
        of = dk % groups
        order = np.argsort(of, kind="stable")
        dk, place = dk[order], place[order]
        start = np.searchsorted(of[order], np.arange(groups + 1))
        full = [(int(g), slice(start[g], start[g + 1])) for g in np.flatnonzero(np.diff(start))]
        often = n >= hot
        nothing, m = [None] * int(often.sum()), len(full)
        return pa.table({
            "g": pa.array([g for g, _ in full] + nothing, pa.int32()), "dks": pa.array([dk[x].tobytes() for _, x in full] + nothing, pa.binary()), "places": pa.array([place[x].tobytes() for _, x in full] + nothing, pa.binary()),
            "h": pa.array([None] * m + uniq[often].view(np.int64).tolist(), pa.int64()), "n": pa.array([None] * m + n[often].tolist(), pa.int64()),
        })

    sent = C.map_texts(docs.select("text", _document()["dk"].alias("dk")), "fragment int, h binary, dk binary, place binary", work)
    return sent.groupBy("fragment").applyInArrow(count, "g int, dks binary, places binary, h long, n long")


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document of a group: dk and its places."""
    dk = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("dks").to_pylist()])
    place = np.concatenate([np.frombuffer(b, np.int32) for b in table.column("places").to_pylist()])
    order = np.argsort(dk, kind="stable")
    dk, place = dk[order], place[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(dk)) + 1, [len(dk)]])
    return pa.table({"dk": pa.array(dk[cut[:-1]], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


_CONTEXT = "bucket int, h long, did long, dk long, start int, windows int, hot boolean, bytes binary, spans binary"


def _contexts(docs: DataFrame, places: DataFrame, buckets: int, hot: dict[int, int]) -> DataFrame:
    """The bytes of the windows of each repeated anchor. A row without bytes tells of windows that are removed already."""
    rows = docs.select("text", *[x.alias(k) for k, x in _document().items()]).join(places, "dk")

    def work():
        def each(part, texts):
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            did, key, lists = (C.column(part, c).to_pylist() for c in ("did", "dk", "places"))
            owner, h, place, first, last = _anchors_of(data)
            edge = np.searchsorted(owner, np.arange(len(data) + 1))
            seen, done, out = set(), set(), {f.split()[0]: [] for f in _CONTEXT.split(", ")}
            add = lambda *x: [out[k].append(v) for k, v in zip(out, x, strict=True)]
            for i in sorted(range(len(data)), key=lambda i: (did[i], key[i])):
                if (did[i], key[i]) in done:  # a repeated row
                    continue
                done.add((did[i], key[i]))
                s = slice(edge[i], edge[i + 1])
                live = np.isin(place[s], np.frombuffer(lists[i], np.int32))
                text, gone = data[i], []
                for g, a, b in zip(h[s][live].view(np.int64).tolist(), first[s][live].tolist(), last[s][live].tolist(), strict=True):
                    context = text[a : b + LENGTH]
                    if context in seen:  # the same windows stand earlier in this chunk
                        gone.append((a, b + LENGTH))
                        continue
                    seen.add(context)
                    deal = xxhash.xxh64_intdigest(f"{g}:{xxhash.xxh32_intdigest(f'{key[i]}:{a}') % hot[g]}") if g in hot else g
                    add(deal % buckets, g, did[i], key[i], a, b - a + 1, g in hot, context, None)
                if gone:
                    add(key[i] % buckets, None, did[i], key[i], None, None, None, None, merged(np.array(gone, np.int64)).astype(np.int32).tobytes())
            return out

        return each

    return C.map_texts(rows, _CONTEXT, work)


def _spans(did: np.ndarray, dk: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, pa.Array]:
    """Merged spans of each document, packed."""
    order = np.lexsort((start, dk, did))
    did, dk, start, end = did[order], dk[order], start[order], end[order]
    out = {"did": [], "dk": [], "spans": []}
    first = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (dk[1:] != dk[:-1])])) if len(did) else np.empty(0, np.int64)
    edges = np.append(first, len(did))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out["did"].append(int(did[a]))
        out["dk"].append(int(dk[a]))
        out["spans"].append(merged(np.stack([start[a:b], end[a:b]], 1)).astype(np.int32).tobytes())
    return {"did": pa.array(out["did"], pa.int64()), "dk": pa.array(out["dk"], pa.int64()), "spans": pa.array(out["spans"], pa.binary())}


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) pairs; those that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]], 1)


_RESOLVED = "did long, dk long, spans binary, h long, sub int, firsts binary"
_FIRSTS = np.dtype([("a", "<u8"), ("b", "<u8"), ("did", "<i8"), ("dk", "<i8"), ("start", "<i4")])


def _resolve(table: pa.Table) -> pa.Table:
    """The removed windows of one bucket, and of hot anchors the first window of each class."""
    known = table.filter(pc.is_valid(table.column("spans")))
    table = table.filter(pc.is_null(table.column("spans")))
    h, did, dk, start, windows = (np.asarray(table.column(c)).astype(np.int64) for c in ("h", "did", "dk", "start", "windows"))
    hot, content = table.column("hot").to_pylist(), table.column("bytes").to_pylist()
    order = np.lexsort((start, dk, did, h))
    if len(order):  # repeated rows in different chunks send the same contexts
        order = order[np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (h, did, dk, start)], 0)])]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    order = order.tolist()
    copies: list[int] = []  # rows whose whole context stands in an earlier one of the same anchor
    gone: list[tuple[np.ndarray, ...]] = []
    firsts: dict[int, list[tuple]] = {}
    block: list[int] = []
    held = 0

    def flush() -> None:
        rows = np.array(block)
        cls, part, place = equal_windows([content[i] for i in block], windows[rows])
        own = rows[part]
        at = start[own] + place
        o = np.lexsort((at, dk[own], did[own], cls))
        later = np.concatenate([[False], cls[o][1:] == cls[o][:-1]])
        gone.append((did[own[o[later]]], dk[own[o[later]]], at[o[later]], at[o[later]] + LENGTH))
        for i in o[~later].tolist():
            if hot[r := int(own[i])]:
                w = xxhash.xxh3_128_intdigest(content[r][place[i] : place[i] + LENGTH])
                firsts.setdefault(int(h[r]), []).append((w >> 64, w & (1 << 64) - 1, int(did[r]), int(dk[r]), int(at[i])))

    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a == 1 and not hot[order[a]]:
            continue
        different: dict[bytes, int] = {}
        for r in order[a:b]:
            if different.setdefault(content[r], r) != r:
                copies.append(r)
        if len(different) > 1 or hot[order[a]]:
            block += different.values()
            held += sum(map(len, different))
        if held > BLOCK:
            flush()
            block, held = [], 0
    if block:
        flush()
    c = np.array(copies, np.int64)
    gone.append((did[c], dk[c], start[c], start[c] + windows[c] - 1 + LENGTH))
    out = _spans(*(np.concatenate(x) for x in zip(*gone, strict=True)))
    more = []
    for key, xs in firsts.items():
        x = np.array(xs, _FIRSTS)
        sub = (x["a"] % np.uint64(64)).astype(int)
        more += [(key, int(s), x[sub == s].tobytes()) for s in np.unique(sub)]
    n, none = len(out["did"]) + len(known), [None] * len(more)
    join = lambda k, kind: pa.array(out[k].to_pylist() + known.column(k).to_pylist() + none, kind)
    columns = {"did": join("did", pa.int64()), "dk": join("dk", pa.int64()), "spans": join("spans", pa.binary())}
    return pa.table(columns | {name: pa.array([None] * n + [m[k] for m in more], kind) for k, (name, kind) in enumerate((("h", pa.int64()), ("sub", pa.int32()), ("firsts", pa.binary())))})


def _meet(table: pa.Table) -> pa.Table:
    """Windows of hot anchors: all but the first of each digest."""
    x = np.concatenate([np.frombuffer(b, _FIRSTS) for b in table.column("firsts").to_pylist()])
    x = x[np.lexsort((x["start"], x["dk"], x["did"], x["b"], x["a"]))]
    later = x[1:][(x["a"][1:] == x["a"][:-1]) & (x["b"][1:] == x["b"][:-1])]
    return pa.table(_spans(later["did"], later["dk"], later["start"].astype(np.int64), later["start"].astype(np.int64) + LENGTH))


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans and kept_sha256; what is kept (binary) too if asked for."""
    spark, p = docs.sparkSession, C.partitions(docs.sparkSession)
    C.free_shuffles(spark)
    text = F.coalesce("text", F.lit(""))
    keys = [F.octet_length(text).alias("n"), F.xxhash64(text).alias("c1"), F.xxhash64(text, F.lit(1)).alias("c2")]
    info = C.cut(docs.select(*[x.alias(k) for k, x in _document().items()], *keys).filter(F.col("n") >= LENGTH))
    # checkpointed, so that Spark can split a text with very many copies in the join
    first = C.cut(info.groupBy("n", "c1", "c2").agg(F.min("did").alias("least"), F.max("did").alias("most")).filter("least < most"))
    copies = C.cut(info.join(first.drop("most"), ["n", "c1", "c2"]).filter("did > least").select("did", "dk", F.col("n").cast("int").alias("n")).distinct())
    total = info.agg(F.sum("n")).first()[0] or 0
    expected = total // 40
    found = C.cut(_live(docs, max(p, -(-expected // FRAGMENT)), p, max(HOT, expected // (4 * p))))
    # at most expected / (expected / 4 p) of them
    often = {r.h: -(-r.n // max(HOT, expected // (4 * p))) + 1 for r in found.filter("h is not null").select("h", "n").collect()}
    packed = found.filter("g is not null").select("g", "dks", "places")
    many = packed.agg(F.sum(F.length("places"))).first()[0] or 0
    places = packed.groupBy("g").applyInArrow(_gather, "dk long, places binary").join(copies.select("dk").distinct(), "dk", "left_anti")
    buckets = max(p, many // 4 * 150 // BUCKET)
    contexts = _contexts(docs, places, buckets, often)
    resolved = C.cut(contexts.groupBy("bucket").applyInArrow(_resolve, _RESOLVED))
    met = resolved.filter("firsts is not null").groupBy("h", "sub").applyInArrow(_meet, "did long, dk long, spans binary")
    whole = copies.select("did", "dk", F.lit(None).cast("binary").alias("spans"))
    spans = resolved.filter("spans is not null").select("did", "dk", "spans").union(met).union(whole)
    # a null among the spans, which collect_list leaves out, is a copy as a whole
    spans = spans.groupBy("dk").agg(F.collect_list("spans").alias("spans"), F.bool_or(F.col("spans").isNull()).alias("whole"))
    rows = docs.select("doc_id", "text", _document()["dk"].alias("dk")).join(spans, "dk", "left").select("doc_id", "text", "spans", "whole")

    def work():
        def each(part, texts):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept)}
            for t, spans, all_of_it in zip(texts, C.column(part, "spans").to_pylist(), C.column(part, "whole").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                runs = np.array([[0, len(data)]]) if all_of_it else merged(np.concatenate([np.frombuffer(b, np.int32) for b in spans]).reshape(-1, 2)) if spans else np.empty((0, 2), int)
                edges = [0, *runs.ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if len(runs) else data
                for k, v in zip(out, (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)):
                    out[k].append(v)
            return {"doc_id": C.column(part, "doc_id")} | out

        return each

    return C.map_texts(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept, work)
