"""Repair and prefix trie of conversations against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from corpusmill.llm import conversations, prefixtrie
from corpusmill.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\r\x0b\x0c"
PATTERN = re.compile(r"(s?(ua)+)?")
NULLS_FIRST = lambda turn: (turn is not None, turn or 0)


def corpus(n=60, seed=5):
    rnd, rows = random.Random(seed), []
    words = ["Yes.", "No!", "why", "Go on?", "", " \n", "fine.", "Tell me more.", "ok"]
    for c in [*range(n), 100, 101, 117, 199, 200, 305]:
        for turn in range(rnd.choice([1, 2, 3, 4, 5, 8, 12])):
            if rnd.random() < 0.1:
                continue
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ("system" if turn == 0 and rnd.random() < 0.4 else ("user", "assistant")[turn % 2])
            rows.append((c, turn, role, rnd.choice(words) if rnd.random() < 0.5 else f"text {rnd.randrange(40)}."))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (7, None, None, None), (7, None, "user", "Before all turns."), (8, 3, "user", "twice."), (8, 3, "user", "twice."), (500, 0, "", "x."), (501, 0, "user", None), (-3, 0, "user", "Below zero."), (-3, 1, "assistant", "Indeed.")]
    return rows


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(initials, found):
    """(cost, audit, role of each output row or None for inserted) by a programme over whole strings."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "")}
    for initial, fault in zip(initials, found, strict=True):
        layer = {}
        for state, (cost, audit) in best.items():
            for k in range(4):
                at, ok = state, True
                for _ in range(k):
                    at = next(t for (s, r), t in follow.items() if s == at and r in "ua")
                options = [("D", at, 2)]
                if fault not in ("blank", "duplicate"):
                    plus = 5 * (fault == "truncated")
                    if (at, initial) in follow:
                        options.append(("K", follow[at, initial], plus))
                    options += [("R", follow[at, r], 1 + plus) for r in "ua" if (at, r) in follow]
                for edit, to, price in options:
                    key = (cost + 5 * k + price, audit + "I" * k + edit)
                    if ok and (to not in layer or key < layer[to]):
                        layer[to] = key
        best = layer
    ends = []
    for state, (cost, audit) in best.items():
        for k in range(3):
            at = state
            for _ in range(k):
                at = next(t for (s, r), t in follow.items() if s == at and r in "ua")
            if at in (0, 3):
                ends.append((cost + 5 * k, audit + "I" * k))
    return min(ends)


def exhaustive(initials, found):
    """The same, by trying all edits of short conversations against the pattern itself."""
    best = None
    places = [[(k, e) for k in range(3) for e in ("D" if f in ("blank", "duplicate") else "DKR")] for f in found]
    for edits in itertools.product(*places, [(k, "") for k in range(3)]):
        cost = sum(5 * k for k, _ in edits)
        kinds = []
        for (k, e), initial, fault in zip(edits, [*initials, ""], [*found, None], strict=True):
            kinds += ["ua"] * k
            cost += {"D": 2, "K": 0, "R": 1, "": 0}[e] + (5 if fault == "truncated" and e in "KR" else 0)
            kinds += [initial] if e == "K" else ["ua"] if e == "R" else []
        if any(PATTERN.fullmatch("".join(x)) for x in itertools.product(*kinds)):
            key = (cost, "".join("I" * k + e for k, e in edits))
            best = key if best is None or key < best else best
    return best


def repaired(rows, audit):
    """Rows after the edits; what a rerole or an insert must give follows from the pattern."""
    out, state, i = [], "", 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        want = "assistant" if state == "u" else "user"
        role, text = (rows[i][2], rows[i][3]) if edit == "K" else (want, rows[i][3] if edit == "R" else "")
        i += edit != "I"
        out.append(f"{role}:{text}")
        state = role[0]
    assert PATTERN.fullmatch("".join(x[0] for x in out))
    return "\n".join(out)


def plain_report(rows):
    out, by = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}, defaultdict(list)
    for r in after_damage(rows):
        by[r[0]].append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: NULLS_FIRST(r[1]))
        found, initials = faults(own), [r[2][:1] for r in own]
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = cheapest(initials, found)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired(own, audit).encode()).hexdigest())
    return out


def test_cheapest_edits():
    """The layers against a programme over strings, and that against all edits of short conversations."""
    rnd = random.Random(1)
    for n in range(9):
        for _ in range(40 if n < 4 else 150):
            initials = [rnd.choice("suax") for _ in range(n)]
            found = [rnd.choice([None, None, "blank", "truncated"]) for _ in range(n)]
            want = cheapest(initials, found)
            if n < 4:
                assert exhaustive(initials, found) == want
            kinds = [("?" if i == "x" else i) + {None: ".", "blank": "!", "truncated": "~"}[f] for i, f in zip(initials, found, strict=True)]
            memo = conversations.Memo()
            for size in (1, 2, 3, 100):  # whatever the chunks, the audit is the same
                parts, layer, back = [kinds[i : i + size] for i in range(0, n, size)], conversations.entry_layer(0), []
                for part in parts:
                    last = [conversations.forward(part, s, memo)[0] for s in range(4)]
                    layer, parents = conversations.through(layer, [c for x in last for c, _ in x], [r for x in last for _, r in x])
                    back.append(parents)
                cost, state, k = conversations.finish(layer)
                audit = "I" * k
                for part, parents in zip(parts[::-1], back[::-1], strict=True):
                    words = conversations.words_of(conversations.forward(part, parents[state], memo)[1], state)
                    audit, state = "".join(w for w, _ in words) + audit, parents[state]
                assert (cost, audit) == want


@pytest.mark.parametrize("chunk", [2, 1024])
def test_report(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", pos long, fault string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in conversations.structure_report(df).collect()}
    want = plain_report([r for r in rows if r[0] not in (7, 8)])
    assert {k: v for k, v in got.items() if k not in (7, 8)} == want and {7, 8} < got.keys()


def test_report_sql(tmp_path):
    """The plain version and the SQL of the query say the same."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = corpus()
    pq.write_table(pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["conv_id", "turn", "role", "text"]), tmp_path / "t.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/t.parquet'")
    found = {r[0]: tuple(r[1:]) for r in con.execute(ORACLES["op12_structure_repair"]).fetchall()}
    want = plain_report(rows)
    assert {k: v for k, v in found.items() if k not in (7, 8)} == {k: v for k, v in want.items() if k not in (7, 8)} and found.keys() == want.keys()


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[(i // 3) % 2], f"t{i % 700}.") for i in range(5000)]
    got = conversations.structure_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain_report(rows)


def test_edits(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes.")], SCHEMA)
    edits, costs = conversations.repair(rows)
    got = [(r.turn, r.inserted, r.edit, r.new_role) for r in edits.orderBy("pos").collect()]
    assert got == [(0, [], "D", None), (1, [], "K", "user"), (2, [], "K", "assistant")] and costs.first().cost == 2
    alone, _ = conversations.repair(spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi.")], SCHEMA))
    assert [(r.edit, r.new_role) for r in alone.orderBy("pos").collect()] == [("R", "user"), ("R", "assistant")]


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for x in own.values():
        x.sort(key=lambda r: NULLS_FIRST(r[0]))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(c - 100 * int(c / 100)), [])
        paths[c] = tuple(x[1:] for x in base[:h] + own[c][h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def totals(node):
        below = [totals(x) for x in children[node]]
        return sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)

    return {(min(members[x]), len(x)): (min(members[x[:-1]]) if x else None, len(members[x]), len(children[x]), *totals(x), hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest()) for x in members}


def trie_rows():
    rows = corpus(95, 9)
    same = [("user", "Same start."), ("assistant", "Same answer."), ("user", "And then?")]
    for c in range(400, 460):  # copies, prefixes and branches
        rows += [(c, i, *t) for i, t in enumerate(same[: 1 + c % 3] + [("assistant", f"end {c % 4}.")] * (c % 5 > 2))]
    rows += [(900, i, "user", f"deep {i}") for i in range(40)] + [(901, i, "user", f"deep {i}") for i in range(23)] + [(902, i, "user", f"deep {min(i, 30)}") for i in range(50)]
    return [r for r in rows if r[:2] not in ((7, None), (8, 3))]


def test_trie(spark):
    rows = trie_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth long, member string").repartition(5)
    out = prefixtrie.prefix_trie(df)
    got = {(r[0], r[1]): tuple(r[2:]) for r in out.collect()}
    assert got == plain_trie(rows) and out.count() == len(got)


def test_trie_sql(spark, tmp_path):
    """The plain version and the SQL of the query say the same."""
    import duckdb

    rows = trie_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/t/*.parquet'")
    found = con.execute(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({ORACLES['op13_prefix_trie']})").fetchall()
    assert {(r[0], r[1]): tuple(r[2:]) for r in found} == plain_trie(rows)


def test_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.prefix_trie(none).count() == 0 and conversations.structure_report(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)
    assert prefixtrie.prefix_trie(nulls).count() == 0
    got = conversations.structure_report(nulls).collect()
    assert len(got) == 1 and got[0].blank in (0, 3, 6) and set(got[0].audit) <= {"D"}
    single = prefixtrie.prefix_trie(spark.createDataFrame([(3, 0, None, "x" * 100_000)], SCHEMA)).collect()
    assert {(r.conv_id, r.depth, r.n_leaves) for r in single} <= {(3, 0, 1), (3, 1, 1)} and min(r.depth for r in single) == 0


def test_repeated_turns(spark):
    """Rows of one turn: any order is that of role and text, so the result doesn't depend on the partitions."""
    rows = [(1, 0, "user", "b."), (1, 0, "user", "a."), (1, 0, "user", "b."), (1, None, None, None)] * 2
    runs = [[tuple(r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(n)).orderBy("depth").collect()] for n in (1, 3)]
    assert runs[0] == runs[1]
    runs = [conversations.structure_report(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect() for n in (1, 3)]
    assert runs[0] == runs[1]
