"""The operators that hold texts against each other, against brute force."""

import hashlib
import random
import re

import numpy as np

from corpusmill.llm import decontaminate, jaccard, linededup, suffixes

from .conftest import PASSAGE, ROWS


def shingles(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


def near_copies(n, seed=3):
    """A group whose texts are edited more and more, besides texts of their own."""
    rng, base = random.Random(seed), PASSAGE.split()
    rows = []
    for i in range(n):
        w = list(base) * 2
        for _ in range(rng.choice([0, 1, 2, 4, 7, 12])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
        rows.append((1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))))
    return rows


def test_jaccard(spark, docs, empty):
    assert jaccard.jaccard_components(empty).count() == 0
    rows = ROWS + near_copies(60)
    df = docs.select("doc_id", "text").union(spark.createDataFrame(near_copies(60), "doc_id long, text string"))
    expected = brute_components(rows)
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(expected.items())
    assert sorted((r.n_shingles for r in got)) == sorted(len(shingles(t)) for _, t in rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == set(expected.values()) | {None}


def test_jaccard_edges(spark):
    """Exactly at the limit: 3 of 4 shingles; an id with two texts joins their classes."""
    a, b = "a b c d e f g", "a b c d e f g h"  # 3 and 4 shingles, 3 in common
    rows = [(1, a), (2, b), (3, "q w e r t y"), (4, "z x c v b n"), (5, "q w e r t y"), (5, "z x c v b n")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}):
        b = t.encode()
        mark = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mark[s] += 1
                mark[s + 100] -= 1
            seen.add(b[s : s + 100])
        m = np.cumsum(mark[:-1]) > 0
        out[i, t] = (len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())
    return out


def test_suffix_dedup(docs, empty, monkeypatch):
    assert suffixes.remove_repeats(empty).count() == 0
    expected = brute_removed(ROWS)
    want = sorted((i, *expected[-(1 << 63) if i is None else i, t or ""]) for i, t in ROWS if i is not None)
    for hot in (suffixes.HOT, 3):  # with all anchors of three places dealt out, too
        monkeypatch.setattr(suffixes, "HOT", hot)
        got = suffixes.remove_repeats(docs).collect()
        assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
        assert len(got) == len(ROWS)
    kept = suffixes.remove_repeats(docs, with_kept=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_suffix_dedup_repeated_rows(spark):
    """Equal rows with a text of their own in different Arrow batches are one document."""
    own = " ".join(f"own{i * i % 97}of{i}" for i in range(80))
    df = spark.createDataFrame([(1, own), (1, own), (2, own[:300] + "x" * 40)], "doc_id long, text string")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "1")
    try:
        got = sorted((r.doc_id, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    finally:
        spark.conf.set(size, before)
    assert got == [(1, 0), (1, 0), (2, 300)]


def test_suffix_array():
    rng = np.random.default_rng(5)
    for k in range(40):
        t = rng.integers(1, 4 if k % 2 else 60, rng.integers(2, 400)).astype(np.uint8)
        t[rng.random(len(t)) < 0.05] = 0
        t[-1] = 0
        sa = suffixes.suffix_array(t)
        keys = [bytes(t[i : i + 100]).split(b"\0")[0] for i in sa]
        assert sorted(sa.tolist()) == list(range(len(t))) and keys == sorted(keys)


def brute_lines(rows, min_words=50):
    docs, seen, gone = {}, set(), set()
    for key in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        docs[key] = [(k, x) for k, x in enumerate(key[1].split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    for key, lines in docs.items():
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for _, x in lines[a : b + 1])
                if sum(len(re.findall(r"[^ \t\n\r\x0b\f]+", x)) for x in run) >= min_words:
                    if run in seen:
                        gone.update((key, k) for k, _ in lines[a : b + 1])
                    seen.add(run)
    return {key: "\n".join(x for k, x in enumerate(key[1].split("\n")) if (key, k) not in gone) for key in docs}


def test_line_dedup(spark, docs, empty):
    assert linededup.line_dedup(empty).count() == 0
    short = [f"line {i} has some seven words in it" for i in range(12)]
    rows = [(201, "\n".join(short)), (202, "\n".join(["head", *short[2:10], "", "tail"])), (203, "\n".join(short[:5])), (204, "\n".join(short[3:] + short[3:])), (205, "\n\n"), (206, "same\nsame\nsame")]
    df = docs.select("doc_id", "text", "n", "uid").union(spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, n long, uid long"))
    got = linededup.line_dedup(df)
    assert got.columns == ["doc_id", "n", "uid", "n_lines", "n_removed", "text"]
    # the null id comes first in the order, and has the passage: it is the first copy
    expected = brute_lines([(-1 if i is None else i, t) for i, t in ROWS + rows])
    for r in got.collect():
        source = [t for i, t in ROWS + rows if i == r.doc_id]
        if source == [None]:
            assert r.text is None and r.n_lines == 0
        elif r.doc_id is not None:
            assert r.text == expected[r.doc_id, source[0]], r.doc_id


def test_line_dedup_every_line(spark):
    """With one word as the least every later copy of a line goes, and clashing names of columns stay what they are."""
    rows = [(1, "a b\nc\na b\n\nd e f"), (2, "c\nx\nd e f\ny"), (2, "c\nx\nd e f\ny"), (3, "x\ny\nz"), (None, "d e f")]
    names = ["_h", "_id", "_n", "_mask", "_th", "uid", "base", "rank", "first", "d.x", "m", "h", "id", "n", "mask", "th", "n_lines"]
    df = spark.createDataFrame([(i, t, *[f"own {k}" for k in range(len(names))]) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = linededup.line_dedup(df, 1)
    assert got.columns == ["doc_id", *names[:-1], "n_lines", "n_removed", "text"]
    expected = brute_lines([(-1 if i is None else i, t) for i, t in rows], 1)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        source = next(t for i, t in rows if i == r.doc_id)
        assert r.text == expected[-1 if r.doc_id is None else r.doc_id, source]
        assert [r[n] for n in names[:-1]] == [f"own {k}" for k in range(len(names) - 1)]


def test_line_dedup_long_runs(spark):
    """Runs of many short lines, over several rounds of doubling."""
    rng = random.Random(4)
    rows = [(i, "\n".join(f"l{rng.randrange(3)}" if rng.random() < 0.9 else f"own{i}" for _ in range(rng.randrange(5, 60)))) for i in range(14)]
    for least in (3, 17, 40):
        expected = brute_lines(rows, least)
        got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
        assert {(r.doc_id, r.text) for r in got} == {(i, t) for (i, _), t in expected.items()}


def test_decontaminate(spark, docs, empty):
    items = [(1, "What is the colour of the sky at noon in summer over the hills? It is a deep and cloudless blue"), (2, "Name the river.\nAnswer: the long winding Danube of old songs"), (3, None), (4, ""), (5, PASSAGE), (5, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noise = " ".join(f"n{i}" for i in range(300))
    rows = [(50, noise + " " + items[0][1] + " " + noise), (51, noise), (52, items[0][1].replace("hills", "mountains")), (53, "What is the colour of the sky at noon in summer over the hills? " + noise), (54, None), (55, items[1][1].upper())]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    holders = {1, 2, 3, 13, 14, 17, None}
    for shard in (20_000, 2):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, shard_items=shard).collect()}
        assert got == {(50, 1), (52, 1), (55, 2)} | {(i, 5) for i in holders}
    for shard in (20_000, 2):  # a row goes by its own text, not by its id
        left = [r.doc_id for r in decontaminate.decontaminate(df, bench, shard_items=shard).collect()]
        bad = {50, 52, 55, 1, 2, 3, 13, 14, 17}
        assert sorted(map(repr, left)) == sorted(repr(i) for i, t in ROWS + rows if not (i in bad or i is None and t))
    twins = spark.createDataFrame([(7, PASSAGE, "x"), (7, "clean text", "y"), (None, "clean too", "z")], "doc_id long, text string, item_id string")
    assert sorted(r.item_id for r in decontaminate.decontaminate(twins, bench).collect()) == ["y", "z"]
    assert decontaminate.decontaminate(empty, bench).count() == 0 and decontaminate.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).count() == df.count()


def test_decontaminate_short_parts(spark):
    """Verbatim leaks of items whose question or answer has one or two words."""
    items = [(1, "What is the capital of the old kingdom beyond the western sea?\nAnswer: Paris"), (2, "Who found the lost crown under the mountain of glass? Er."), (3, "Which two colours does the banner of the northern guild bear?\nAnswer: dark blue"), (4, "Why?\nAnswer: because the tide returns to the shore twice in every day"), (5, "Define entropy.\nAnswer: the measure of disorder in a closed system at rest")]
    noise = " ".join(f"n{i}" for i in range(200))
    docs = [(10 + i, f"{noise} {t} {noise}") for i, t in items] + [(20 + i, f"{noise} {t.split('?')[0]} {noise}") for i, t in items[:3]]
    got = {(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10 + i, i, 1.0, 1.0) for i, _ in items}


def test_decontaminate_shards_alike(spark):
    """Shards give what one index gives: same scores with non-ASCII capitals, an item's own passages beside a longer one."""
    items = [(i, f"École Über x{i} Ñandú y{i}?\nAnswer: Éire z{i} Ångström v{i}") for i in range(8)] + [(8, "where does the heron nest in early spring?\nAnswer: among tall reeds"), (9, " ".join(f"long{i}" for i in range(150)))]
    noise = " ".join(f"n{i}" for i in range(100))
    rows = [(20 + i, f"{noise} {t} {noise}") for i, t in items] + [(40, f"École Über x1 Ñandú Éire z1 Ångström {noise}"), (41, f"where does the heron nest in early spring? {noise} among tall reeds")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({(r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.leaks(docs, bench, shard_items=n).collect()} for n in (20_000, 2))
    pairs = {x[:2] for x in one}
    assert one == many and (40, 1) in pairs and (41, 8) not in pairs  # a question and an answer that far apart are no leak of a short item


def plain_matches(index, text, overlap):
    """Every passage of an item's own width against every item: whole scores, then n-grams of the parts' own lengths."""
    words, found = decontaminate.words_of(text), {}
    for group in index.groups:
        for k, item in enumerate(group.ids):
            width = decontaminate.width_of(sum_words[item])
            assert width == group.width >= 2 * sum_words[item]
            for start in range(0, max(1, len(words) - width // 2), width // 2):
                passage = words[start : start + width]
                score = sum(x for w, x in group.whole[k].items() if w in set(passage))
                shares = []
                for n, wanted in group.parts[k]:
                    there = {b" ".join(passage[i : i + n]) for i in range(len(passage) - n + 1)} if n else set()
                    shares.append(len(wanted & there) / len(wanted) if wanted else 0.0)
                if score >= group.threshold - 1e-9 and wanted and min(shares) >= overlap:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, *shares))
    return found


sum_words = {}


def test_decontaminate_item_alone(spark):
    """An item's verdict doesn't change when an unrelated long one is added: question and answer 150 words apart are no leak of a short item."""
    rng = random.Random(4)
    far = "where does the old heron nest in early spring? " + " ".join(f"n{i}" for i in range(150)) + " among tall reeds by the lake"
    near = "where does the old heron nest in early spring? " + " ".join(f"n{i}" for i in range(20)) + " among tall reeds by the lake"
    item, long = (1, "where does the old heron nest in early spring?\nAnswer: among tall reeds by the lake"), (2, " ".join(f"u{rng.randrange(10**6)}" for _ in range(400)) + "?\nAnswer: nothing of it")
    docs = spark.createDataFrame([(1, far), (2, near), (3, "start " + long[1])], "doc_id long, text string")
    found = [{(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} for items in ([item], [item, long])]
    assert found == [{(2, 1)}, {(2, 1), (3, 2)}]


def test_decontaminate_brute_force():
    """All passages by all items, with questions and answers of one, two and more words, in texts of several passages."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(60)]
    some = lambda a, b: " ".join(rng.choice(vocab) for _ in range(rng.randint(a, b)))
    items = [(k, rng.choice([f"{some(1, 12)}?\nAnswer: {some(1, 3)}", f"{some(3, 14)}? {some(1, 6)}", some(4, 20), f"{some(2, 9)}. {some(1, 2)}."])) for k in range(60)]
    items += [(60 + k, f"{some(90, 130)}? {some(30, 40)}") for k in range(6)]
    sum_words.update((k, len(decontaminate.words_of(t))) for k, t in items)
    index = decontaminate.Index(items)
    texts = []
    for _ in range(80):
        held = [t if rng.random() < 0.5 else " ".join(w for w in t.split() if rng.random() < 0.8) for _, t in rng.sample(items, rng.randint(0, 3))]
        texts.append(" ".join(x for h in held for x in (some(0, 50), h)) + " " + some(0, 90))
    got = {}
    for k, item, *x in index.matches(texts):
        got.setdefault(k, {})[item] = tuple(x)
    pairs = 0
    for k, t in enumerate(texts):
        want = plain_matches(index, t, decontaminate.OVERLAP)
        assert set(got.get(k, {})) == set(want), k
        assert all(abs(a - b) < 1e-9 for i, x in want.items() for a, b in zip(x, got[k][i], strict=True))
        pairs += len(want)
    assert pairs > 40


def test_wand_finds_all():
    """Against scoring every item for every passage."""
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(80)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 25)))) for k in range(150)]
    for threshold in (0.3, 0.5, 0.8):
        [index] = decontaminate.Index(items, threshold).groups
        for _ in range(40):
            words = [rng.choice(vocab).encode() for _ in range(rng.randint(5, 60))]
            terms = {index.term[w] for w in words if w in index.term}
            there = set(words)
            want = {k for k in range(150) if sum(x for w, x in index.whole[k].items() if w in there) >= threshold}
            assert want <= set(index.search(sorted(terms)))
