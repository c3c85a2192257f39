"""Repair of the structure of conversations: the cheapest edits by which the roles read ``(s?(ua)+)?``.

Edits of a row: Keep costs 0, Rerole to user or assistant 1, Delete 2; Insert puts a row
with an empty text anywhere for 5. Blank rows and duplicates must go; a truncated row that
stays costs 5 more. Of the cheapest edits those count whose initials, in order, come first
in ASCII; this string is the audit.

The search is a dynamic programme over four states (nothing yet, after the system's row,
after a user's, after an assistant's). A macro edit is a run of inserts (two at most, more
never pay) and the edit of one row. Its initials are a word of a prefix-free code
(``CODES``, in ASCII order), so audit strings of equally many rows compare as the sequences
of their words do, and a layer needs no strings: each state holds its cost, the rank of its
audit among the layer's states, and a pointer to its parent and the word. The next layer's
ranks come from (rank of the parent, place of the word). What a layer is relative to its
cheapest state takes few values, so steps are looked up once they have been worked out.

A conversation is cut into chunks of ``CHUNK`` rows at most. For each chunk the programme runs
from each of the four states; what it costs to come from each to each, and the ranks, are
its summary. A pass over a conversation's summaries finds the states at the cuts, and
each chunk then follows its own pointers backwards. So a conversation that holds a third
of all rows is spread over many tasks; one task sees one summary for each chunk of it. Only
the digest reads a conversation in order, since SHA-256 can't be split; it streams, and holds
no conversation in memory but the audit, which is a value of the result.

Rows stand in the order of turn (nulls first), then role, text digest and the row's place in
the input. A null role or text is one space; so is a null id or turn in the key of the damage.
Rows with a null conv_id are one conversation. Repeated rows are rows of their own (and
duplicates). Columns other than conv_id, turn, role and text are not looked at. An empty
table gives an empty result. Two rows count as equal if two 64-bit hashes of role and text are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a conversation that are worked off together.
CHUNK = 1024
#: Words of the code: inserts, then the edit of a row, in ASCII order.
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_EMIT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where an inserted or reroled row leads: the user's turn but after a user.
_NEXT = (USER, USER, ASSISTANT, USER)
_ENDS = (START, ASSISTANT)
_NONE = -1

Layer = tuple[tuple[int, int], ...]  # (cost, rank) of each state; a cost of -1: out of reach
Steps = tuple[tuple[int, int], ...]  # (parent, place of the word) of each state


def _after(state: int, inserts: int) -> int:
    for _ in range(inserts):
        state = _NEXT[state]
    return state


def _ranked(best: list[tuple | None]) -> tuple[Layer, Steps]:
    """best: for each state the least (cost, rank of the parent, place of the word, parent)."""
    order = sorted((x[1:3], s) for s, x in enumerate(best) if x)
    ranks = {s: r for r, (_, s) in enumerate(order)}
    return tuple((x[0], ranks[s]) if x else (_NONE, _NONE) for s, x in enumerate(best)), tuple((x[3], x[2]) if x else (_NONE, _NONE) for x in best)


def step(layer: Layer, kind: str) -> tuple[Layer, Steps]:
    """The next layer. kind: the role's initial, then ``!`` for a row that must go, ``~`` for a truncated one, ``.`` else."""
    initial, fault = kind[:-1], kind[-1]
    best: list[tuple | None] = [None] * 4
    for state, (cost, rank) in enumerate(layer):
        if cost == _NONE:
            continue
        for place, code in enumerate(CODES):
            at, edit = _after(state, len(code) - 1), code[-1]
            if edit == "D":
                to, price = at, DELETE
            elif fault == "!":
                continue
            else:
                to, price = (_EMIT.get((at, initial)), KEEP) if edit == "K" else (_NEXT[at], REROLE)
                price += TRUNCATED * (fault == "~")
            if to is not None:
                key = (cost + INSERT * (len(code) - 1) + price, rank, place, state)
                if best[to] is None or key < best[to]:
                    best[to] = key
    return _ranked(best)


class Memo(dict):
    """Steps by (layer less its least cost, kind): the least cost that comes on top, the layer that follows less its least cost, pointers."""

    def __missing__(self, key: tuple[Layer, str]):
        layer, steps = step(*key)
        low = min(c for c, _ in layer if c != _NONE)
        self[key] = found = (low, tuple((c - low, r) if c != _NONE else (c, r) for c, r in layer), steps)
        return found


def entry_layer(state: int) -> Layer:
    return tuple((0, 0) if s == state else (_NONE, _NONE) for s in range(4))


def forward(kinds: list[str], state: int, memo: Memo) -> tuple[Layer, list[Steps]]:
    """The last layer of a chunk entered in ``state``, and all pointers."""
    layer, total, back = entry_layer(state), 0, []
    for kind in kinds:
        low, layer, steps = memo[layer, kind]
        total += low
        back.append(steps)
    return tuple((c + total, r) if c != _NONE else (c, r) for c, r in layer), back


def through(layer: Layer, costs: list[int], ranks: list[int]) -> tuple[Layer, tuple[int, ...]]:
    """The layer behind a chunk by its summary, and from which state each of its states comes."""
    best: list[tuple | None] = [None] * 4
    for state, (cost, rank) in enumerate(layer):
        for to in range(4):
            if cost != _NONE and (more := costs[4 * state + to]) != _NONE:
                key = (cost + more, rank, ranks[4 * state + to], state)
                if best[to] is None or key < best[to]:
                    best[to] = key
    layer, steps = _ranked(best)
    return layer, tuple(s for s, _ in steps)


def finish(layer: Layer) -> tuple[int, int, int]:
    """(cost, state, inserts behind the last row) of the best end."""
    ends = [(c + INSERT * k, r, k, s) for s, (c, r) in enumerate(layer) if c != _NONE for k in range(3) if _after(s, k) in _ENDS]
    cost, _, inserts, state = min(ends)
    return cost, state, inserts


def words_of(back: list[Steps], state: int) -> list[tuple[str, int]]:
    """(word, state before it) of each row, backwards from the state at the end."""
    out = []
    for steps in reversed(back):
        parent, place = steps[state]
        out.append((CODES[place], parent))
        state = parent
    return out[::-1]


def inserted(state: int, n: int) -> tuple[list[str], int]:
    """Roles of n inserted rows, and the state behind them."""
    roles = []
    for _ in range(n):
        state = _NEXT[state]
        roles.append(ROLES[state])
    return roles, state


def damaged(df: DataFrame) -> DataFrame:
    """The rows after the damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")])
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("_c")).filter("_c <> 0")
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _hashes() -> list[Column]:
    return [F.xxhash64("role", "text").alias("_h1"), F.xxhash64(F.lit(1), "role", "text").alias("_h2")]


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank, duplicate, truncated or null) and pos, numbers in the order of the rows; sorted by ranges and checkpointed."""
    at = C.cut(rows.select(F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "conv_id", "turn").select("conv_id", "turn", "role", "text", *_hashes(), F.monotonically_increasing_id().alias("_uid")))
    place = F.struct(F.col("turn").isNotNull(), "turn", "_uid")  # nulls first
    firsts = at.groupBy(F.col("conv_id").alias("_conv"), "_h1", "_h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    seen = at.alias("a").join(firsts.alias("f"), (F.col("a._h1") == F.col("f._h1")) & (F.col("a._h2") == F.col("f._h2")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    last = F.right(F.rtrim("text", F.lit(C.SPACES)), F.lit(1))
    fault = F.when(last == "", "blank").when(F.col("_first") < place, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    order = ["conv_id", "turn", "role", "_k1", "_k2", "_uid"]
    ready = seen.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.col("a._h1").alias("_k1"), F.col("a._h2").alias("_k2"), "_uid")
    ordered = ready.repartitionByRange(C.partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return C.cut(ordered.select("conv_id", "turn", "role", "text", "fault", F.monotonically_increasing_id().alias("pos")))


def _kind() -> Column:
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("?")
    return F.concat(initial, F.when(F.col("fault").isin("blank", "duplicate"), "!").when(F.col("fault") == "truncated", "~").otherwise("."))


def _chunk() -> Column:
    """A chunk's rows lie in one range, ``CHUNK`` of them at most."""
    return F.floor(F.col("pos") / CHUNK)


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict], bool]]:
    """Rows in runs of equal keys: (key, rows, whether the run ends here); a run goes on over batches, and comes in the pieces that batches hold."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            at = tuple(row[k] for k in keys)
            if key is not None and at != key:
                yield key, held, True
                held = []
            key = at
            held.append(row)
        if len(held) >= 4 * CHUNK:
            yield key, held, False
            held = []
    if key is not None:
        yield key, held, True


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk, from rows sorted by pos."""
    memo, out = Memo(), []
    for (conv, chunk), rows, _ in _groups(batches, ["conv_id", "chunk"]):
        kinds = [r["kind"] for r in rows]
        last = [forward(kinds, s, memo)[0] for s in range(4)]
        out.append({"conv_id": conv, "chunk": chunk, "costs": [c for layer in last for c, _ in layer], "ranks": [r for layer in last for _, r in layer], "roles": kinds[0][0] + kinds[-1][0], "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))})
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, _SUMMARY)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _SUMMARY)


_SUMMARY = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("roles", pa.string()), ("illegal", pa.int64())])
_STATES = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("inserts", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())])


def _states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at both ends of each chunk, from summaries sorted by conversation; of a conversation a few bytes for each chunk are held."""
    layer, back, before, illegal = entry_layer(START), [], "", 0
    for (conv,), rows, over in _groups(batches, ["conv_id"]):
        for r in rows:
            layer, parents = through(layer, r["costs"], r["ranks"])
            back.append((r["chunk"], parents))
            illegal += r["illegal"] + (before != "" and before + r["roles"][0] not in ("su", "ua", "au"))
            before = r["roles"][1]
        if over:
            cost, state, inserts = finish(layer)
            out = []
            for chunk, parents in reversed(back):
                last = not out
                out.append((conv, chunk, parents[state], state, inserts if last else 0, cost if last else None, illegal if last else None))
                state = parents[state]
            for i in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[i : i + 10_000], strict=True), _STATES, strict=True)], schema=_STATES)
            layer, back, before, illegal = entry_layer(START), [], "", 0


_EDITS = "conv_id long, pos long, turn long, role string, text string, fault string, inserted array<string>, edit string, new_role string"
_EDITED = pa.schema([(n, pa.int64()) for n in ("conv_id", "pos", "turn")] + [(n, pa.string()) for n in ("role", "text", "fault")] + [("inserted", pa.list_(pa.string())), ("edit", pa.string()), ("new_role", pa.string())])


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their edits; a chunk's states come before its rows."""
    memo, out = Memo(), []
    for (conv, _), rows, _ in _groups(batches, ["conv_id", "chunk"]):
        states, rows = rows[0], rows[1:]
        _, back = forward([r["kind"] for r in rows], states["entry"], memo)
        for r, (word, state) in zip(rows, words_of(back, states["exit"]), strict=True):
            roles, state = inserted(state, len(word) - 1)
            role = {"D": None, "K": r["role"], "R": ROLES.get(_NEXT[state])}[word[-1]]
            out.append({k: r[k] for k in ("conv_id", "pos", "turn", "role", "text", "fault")} | {"inserted": roles, "edit": word[-1], "new_role": role})
        if states["inserts"]:
            out.append({"conv_id": conv, "pos": rows[-1]["pos"], "inserted": inserted(states["exit"], states["inserts"])[0]})
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _EDITED)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _EDITED)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their edits, and the costs.

    First table: conv_id, pos (order of the rows), turn, role, text, fault, inserted (roles of
    the rows put in before), edit (K, R or D) and new_role. Rows put in behind the last row of
    a conversation come with a row of the same pos and no edit.
    Second table: conv_id, cost and illegal (neighbours in the input whose initials may not follow each other).
    """
    ready = judged(rows).select("conv_id", "pos", "turn", "role", "text", "fault", _kind().alias("kind"), _chunk().alias("chunk"))
    C.bound_batches(rows.sparkSession)
    summary = ready.select("conv_id", "chunk", "kind").mapInArrow(_summaries, "conv_id long, chunk long, costs array<long>, ranks array<long>, roles string, illegal long")
    states = C.cut(summary.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_states, "conv_id long, chunk long, entry int, exit int, inserts int, cost long, illegal long"))
    both = states.select("conv_id", "chunk", F.lit(None).cast("long").alias("pos"), "entry", "exit", "inserts").unionByName(ready, allowMissingColumns=True)
    edits = both.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(_edits, _EDITS)
    return edits, states.filter("cost is not null").select("conv_id", "cost", "illegal")


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """audit and repaired_sha256 of each conversation, from edits sorted by it."""
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    hashed, audit, first, out = hashlib.sha256(), [], True, []

    def put(role: str, text: str) -> None:
        nonlocal first
        hashed.update((("" if first else "\n") + role + ":" + text).encode())
        first = False

    for (conv,), rows, over in _groups(batches, ["conv_id"]):
        piece = []
        for r in rows:
            for role in r["inserted"]:
                put(role, "")
            piece.append("I" * len(r["inserted"]) + (r["edit"] or ""))
            if r["new_role"] is not None:
                put(r["new_role"], r["text"])
        audit.append("".join(piece))
        if over:
            out.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()})
            hashed, audit, first = hashlib.sha256(), [], True
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def structure_report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and returns what the contract asks for, a row for each original conv_id."""
    rows = damaged(conversations)
    edits, costs = repair(rows)
    digests = edits.select("conv_id", "pos", "inserted", "edit", "new_role", F.when(F.col("new_role").isNotNull(), F.col("text")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("edit").asc_nulls_last()).mapInArrow(_digests, "conv_id long, audit string, repaired_sha256 string")
    is_ = lambda name: F.count_if(F.col("fault") == name).alias(name)  # noqa: E731
    counts = edits.filter("edit is not null").groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), is_("blank"), is_("duplicate"), is_("truncated"))
    out = conversations.select("conv_id").distinct()
    for other in (counts, costs, digests):
        out = out.alias("a").join(other.withColumnRenamed("conv_id", "_conv"), F.col("a.conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)  # noqa: E731
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """DuckDB SQL: the same search over whole audit strings, in a recursion over the rows of each conversation."""
    moves, ends = [], []
    for state in range(4):
        for code in CODES:
            at, edit, price = _after(state, len(code) - 1), code[-1], INSERT * (len(code) - 1)
            if edit == "K":
                moves += [(state, code, initial, to, price + KEEP) for (s, initial), to in _EMIT.items() if s == at]
            else:
                moves.append((state, code, "*", at if edit == "D" else _NEXT[at], price + (DELETE if edit == "D" else REROLE)))
        ends += [(state, "I" * k, INSERT * k) for k in range(3) if _after(state, k) in _ENDS]
    values = lambda rows: ", ".join(str(r) for r in rows)  # noqa: E731
    key = "lpad(CAST(CAST(left({0}.key, 10) AS BIGINT) + {1} AS VARCHAR), 10, '0') || substr({0}.key, 11) || {2}"
    return rf"""
WITH RECURSIVE named AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
crc(s, k, x) AS (SELECT s, 1, 4294967295::BIGINT FROM named UNION ALL SELECT s, k + 1, {C.crc32_step()} FROM crc WHERE k <= length(s)),
codes AS (SELECT s, xor(x, 4294967295::BIGINT) % 20 AS c FROM crc WHERE k = length(s) + 1),
d AS (SELECT conv_id, turn, c, CASE WHEN c = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM conversations JOIN codes ON s = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') WHERE c <> 0),
e AS (SELECT conv_id, turn, role, text FROM (SELECT *, unnest(range(CASE WHEN c = 3 THEN 2 ELSE 1 END)) FROM d)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, right(regexp_replace(text, '[ 	-]+$', ''), 1) AS last FROM e),
o AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM n),
moves(st, word, initial, goal, price) AS (VALUES {values(moves)}), ends(st, word, price) AS (VALUES {values(ends)}),
w(conv_id, i, st, key) AS (SELECT conv_id, 0::BIGINT, 0, '0000000000' FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL SELECT w.conv_id, w.i + 1, m.goal, min({key.format("w", f"m.price + CASE WHEN o.fault = 'truncated' AND right(m.word, 1) <> 'D' THEN {TRUNCATED} ELSE 0 END", "m.word")})
  FROM w JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 JOIN moves m ON m.st = w.st AND (right(m.word, 1) = 'D' OR o.fault NOT IN ('blank', 'duplicate')) AND m.initial IN ('*', o.initial) GROUP BY w.conv_id, w.i, m.goal),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id),
best AS (SELECT w.conv_id, min({key.format("w", "ends.price", "ends.word")}) AS key FROM w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN ends ON ends.st = w.st GROUP BY w.conv_id),
edits AS (SELECT conv_id, p, substr(key, 10 + p, 1) AS edit FROM (SELECT *, unnest(range(1, length(key) - 9)) AS p FROM best)),
placed AS (SELECT *, CAST(sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS BIGINT) AS i, CAST(sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS BIGINT) AS j FROM edits),
given AS (SELECT p.conv_id, p.p, p.j, p.edit, CASE WHEN p.edit = 'K' THEN o.role END AS role, CASE WHEN p.edit = 'I' THEN '' ELSE o.text END AS text FROM placed p LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.i = p.i WHERE p.edit <> 'D'),
led AS (SELECT *, max(CASE WHEN j = 1 AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM given),
fixed AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p) AS t FROM led GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(left(b.key, 10), '0') AS BIGINT) AS cost, coalesce(substr(b.key, 11), '') AS audit, sha256(coalesce(f.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM a.conv_id"""
