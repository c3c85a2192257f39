"""The operators that judge each text by itself, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import common, pii, quality, sentencepiece, urlfilter
from corpusmill.llm import license as lic

from .conftest import ROWS

WS = " \t\n\r\x0b\x0c"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_id(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_rules(docs, empty):
    assert quality.quality_rules(empty).count() == 0
    expected = []
    for i, t in ROWS:
        w, t = words(t), t or ""
        seen = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {j for k, g in enumerate(seen) if seen.count(g) > 1 for j in range(k, k + 5)} if len(w) < 1000 else set()
        lines = [x for x in t.split("\n") if x.strip(WS)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    got = quality.quality_rules(docs)
    assert sorted(expected, key=repr) == by_id(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got.filter("base_failed and kept").count() == 0
    assert got.filter("doc_id = 1 and kept").count() == 1


def plain_shares(t):
    """What the limits on repetition measure, worked out window by window."""
    w = words(t)
    chars = max(1, sum(map(len, w)))
    top = dup = 0.0
    for n in range(2, 11):
        grams = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        counts = Counter(grams)
        if n in quality.TOP:
            most = max((c * sum(map(len, g)) for g, c in counts.items() if c > 1), default=0)
            top = max(top, most / chars / quality.TOP[n])
        if n in quality.DUPLICATED:
            seen, inside = set(), set()
            for k, g in enumerate(grams):
                if g in seen:
                    inside.update(range(k, k + n))
                seen.add(g)
            dup = max(dup, sum(len(w[j]) for j in inside) / chars / quality.DUPLICATED[n])
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if line.strip(WS):
            again += len(line) if line in seen else 0
            seen.add(line)
    return top, dup, again / max(1, len(t or ""))


def test_quality_shares(spark):
    """All measures of the method against plain ones; texts that only the method rejects, one for each limit."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("né ö abc d ef gh ij kl mn op".split()) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    own = lambda n: " ".join(f"w{i}é{i * i}" for i in range(n))
    rejected = {
        100: " ".join(f"extraordinary circumstances w{i}" for i in range(20)),  # one pair of words everywhere
        101: own(60) + " " + " ".join(f"w{i}é{i * i}" for i in range(11)),  # a run of eleven words again, 22 of 71 words in repeated windows
        102: "\n".join(["short line", *[f"l{i}" for i in range(8)]] + ["short line"] * 6),
    }
    rows = [*enumerate(texts), *rejected.items(), (103, own(80))]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        top, dup, lines = plain_shares(t)
        r = got[i]
        assert abs(r.top_share - top) < 1e-9 and abs(r.dup_share - dup) < 1e-9 and abs(r.dup_line_share - lines) < 1e-9, i
        assert r.kept == (not r.base_failed and top <= 1 and dup <= 1 and lines <= quality.DUP_LINES)
    assert not got[100].base_failed and not got[100].kept and got[103].kept
    # accented letters are one character, as plain ones are
    a, b = (quality.repetition([x], common.WordHashes()) for x in ("ééé b c ééé b d " * 3, "eee b c eee b d " * 3))
    assert a["top"] == b["top"] and a["dup"] == b["dup"]


def test_license_scan(spark, docs, empty):
    assert lic.license_scan(empty).count() == 0
    rows = [(1, "Released under the MIT License."), (2, "x SPDX-License-Identifier: (Apache-2.0 OR MIT) AND GPL-2.0-only WITH Classpath-exception-2.0\nend"), (3, None), (4, "cc-by, CC BY; mit\nlicense"), (5, "SPDX-License-Identifier: MIT OR")]
    got = {r.doc_id: r for r in lic.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (5, 1, 3, 3, "mit", "mit")
    assert got[2].base_labels == "" and got[2].labels == "apache,gpl,mit"
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0.0)
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (3, 0, 4, "cc-by,mit")
    assert got[5].labels == "mit"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert lic.license_scan(docs).count() == len(ROWS)


def test_long_expressions():
    """Every licence of a line counts, however long the line is."""
    names = [f"{a}{b}{c}-1.0" for a in "qwz" for b in "kvx" for c in "aeioujmnprst"]
    text = "SPDX-License-Identifier: (" + " AND ".join(names) + ")\nSPDX-License-Identifier: MIT"
    got = lic.scan(text, lic._automaton())
    assert set(got[5].split(",")) == {lic.label_of(n) for n in names} | {"mit"}
    assert got[7] == ["(" + " AND ".join(names) + ")", "MIT"]
    got = lic.scan("SPDX-License-Identifier: " + " OR ".join(names * 40) + " x " * 500 + "SPDX-License-Identifier: MIT", lic._automaton())
    assert "mit" in got[5].split(",") and len(got[7]) == 2


def test_expressions():
    tree, end = lic.parse("MIT or Apache-2.0 and GPL-2.0 with X")
    assert tree == ("or", "MIT", ("and", "Apache-2.0", ("with", "GPL-2.0", "X")))
    assert lic.identifiers(tree) == ["MIT", "Apache-2.0", "GPL-2.0"]
    assert lic.satisfied(tree, {"mit"}) and not lic.satisfied(tree, {"apache-2.0"})
    assert end == len("MIT or Apache-2.0 and GPL-2.0 with X")
    for bad in ("", "and MIT", "(MIT", "MIT or", "-- MIT", "(MIT -->", "MIT and )"):
        with pytest.raises(lic.BadExpression):
            lic.parse(bad)


def test_expressions_in_comments():
    """The comment styles of several languages, and prose: what stands behind a complete expression is no part of it."""
    automaton = lic._automaton()
    cases = {
        "<!-- SPDX-License-Identifier: MIT -->": ("MIT", "mit", True), "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */": ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl", False),
        "// SPDX-License-Identifier: Apache-2.0 OR MIT -- see LICENSE": ("Apache-2.0 OR MIT", "apache,mit", True), "# SPDX-License-Identifier: MIT. Do as you like": ("MIT", "mit", True), "SPDX-License-Identifier: Apache-2.0.": ("Apache-2.0", "apache", True),
        "(* SPDX-License-Identifier: (MIT AND ISC) *)": ("(MIT AND ISC)", "isc,mit", True), "{- SPDX-License-Identifier: BSD-3-Clause -}": ("BSD-3-Clause", "bsd", True), '"SPDX-License-Identifier: MIT"': ("MIT", "mit", True), "(SPDX-License-Identifier: MIT)": ("MIT", "mit", True),
        'license = "SPDX-License-Identifier: GPL-3.0-or-later"; x': ("GPL-3.0-or-later", "gpl", False), "%% SPDX-License-Identifier: MIT Apache": ("MIT", "mit", True), "--[[ SPDX-License-Identifier: MIT OR GPL-2.0 ]]": ("MIT OR GPL-2.0", "gpl,mit", True), "SPDX-License-Identifier: MIT OR": ("MIT OR", "mit", False),
    }
    for text, want in cases.items():
        got = lic.scan(text, automaton)
        assert (got[7][0], got[5], got[8]) == want, text


def plain_scan(t):
    """Words, base places and labels by looking at every place."""
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    hits = [(k, phrase) for k in range(len(w)) for phrase in [*lic.BASE, *lic.NOTICES] if w[k : k + len(phrase.split())] == phrase.split()]
    base = [(k, p) for k, p in hits if p in lic.BASE]
    labels = {lic.BASE[p] for _, p in base} | {lic.NOTICES[p][0] for _, p in hits if p in lic.NOTICES}
    return len(w), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(sorted({lic.BASE[p] for _, p in base})), ",".join(sorted(labels))


def test_license_places():
    """Against plain matching, on texts of phrases that touch, overlap and break off."""
    rng, automaton = random.Random(2), lic._automaton()
    pieces = [*lic.BASE, *lic.NOTICES, "gnu general", "apache", "CC-BY", "Mit\nLicense", "é", "public license", "cc by cc by", "x.y", "LICENSE"]
    for _ in range(400):
        t = rng.choice(" \n-,").join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))
        assert lic.scan(t, automaton)[:6] == plain_scan(t), t


def test_expressions_evaluated():
    """Random expressions against Python's own evaluation of the same logic."""
    rng, names = random.Random(6), ["MIT", "GPL-3.0-only", "Apache-2.0", "MPL-2.0", "ISC"]

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(names) + rng.choice(["", "", " WITH Some-exception"])
        return f"({make(depth - 1)} {rng.choice(['AND', 'or', 'Or'])} {make(depth - 1)})" if rng.random() < 0.5 else f"{make(depth - 1)} {rng.choice(['and', 'OR'])} {make(depth - 1)}"

    automaton, seen = lic._automaton(), set()
    for _ in range(300):
        e = make(4)
        plain = re.sub(r" WITH Some-exception", "", e)
        plain = re.sub(r"[A-Za-z0-9.+-]+", lambda m: m[0].lower() if m[0].lower() in ("and", "or") else str(lic.label_of(m[0]) in lic.PERMISSIVE), plain)
        want = eval(plain)  # of True, False, and, or and brackets only
        assert lic.satisfied(lic.parse(e)[0], lic.PERMISSIVE) is want
        assert lic.scan(f"x\nSPDX-License-Identifier: {e}\ny", automaton)[8] is want
        seen.add(want)
    assert seen == {True, False}
    assert lic.scan("no tag", automaton)[8] is None and lic.scan("SPDX-License-Identifier: MIT OR", automaton)[8] is False
    assert lic.scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0", automaton)[8] is False
    assert lic.satisfied(lic.parse(" OR ".join(["GPL-2.0"] * 5000 + ["MIT"]))[0], lic.PERMISSIVE)


def test_url_filter(spark):
    rows = [
        (1, "https://www.Example.com/en/1"), (2, "http://x.example.com/en/?a#b"), (3, "http://a.net/es/"), (4, "http://anet/es/"), (5, None), (6, "no scheme"), (7, "https://casino.example.org/x"), (8, "https://mycasino.example.org/x"), (9, "http://cheap-pills.org"),
        (10, "http://h.org?q=http://z.net/es/"), (11, "http://EXAMPLE.COM"), (11, "http://EXAMPLE.COM"), (12, "a\nb://h.net/fr/x\ny"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("x.example.com", "/en/", "example.com/en/", "block"), 3: ("a.net", "/es/", "net/es/", "block"), 4: ("anet", "/es/", None, "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("casino.example.org", "/x", None, "block"), 8: ("mycasino.example.org", "/x", None, "allow"), 9: ("cheap-pills.org", "", None, "block"), 10: ("h.org", "", None, "allow"),
        11: ("example.com", "", None, "allow"), 12: ("h.net", "/fr/x\ny", "net/fr/", "block"),
    }
    assert urlfilter.url_filter(spark.createDataFrame([], "page_id long, url string, host int")).count() == 0


def plain_spans(t):
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule, t):
            d = re.sub(r"\D", "", m[0])
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))) or (k == 2 and not (13 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((k, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+-() 1234567890_é", max_size=40))
def test_base_spans(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_pii(spark, docs, empty):
    assert pii.digest(pii.extract(empty)).count() == 0
    seeds = [(i, f"please write to user{i}@mail.example.org today or call +1 (415) 555-01{i:02d} now") for i in range(10, 40)]
    rows = [*seeds, (100, "please write to someone-99#corp today"), (101, "4111 1111 1111 1111 and 10.0.0.1 and 10.0.0.999"), (102, None), (103, "")]
    got = {r.doc_id: r for r in pii.digest(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (got[10].n_email, got[10].n_phone, got[10].n_card, got[10].n_ip) == (1, 1, 0, 0)
    assert got[100].spans == "email:16:31" and got[100].n_email == 0 and got[100].n_more == 1
    assert (got[101].n_card, got[101].n_ip) == (1, 1)
    for i, t in rows:
        base = pii.joined(plain_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert pii.digest(pii.extract(docs)).count() == len(ROWS)


def plain_graph(edges, rounds=pii.ROUNDS):
    """The scores of the pattern-instance graph by dictionaries."""
    n, seeds = Counter(), {}
    for p, i, kind, k in edges:
        n[p, i] += k
        if kind >= 0:
            seeds.setdefault(i, {})[kind] = 1.0
    total, belief, sure = Counter(), dict(seeds), {}
    for (p, _), k in n.items():
        total[p] += k
    for _ in range(rounds):
        mass, support = Counter(), Counter()
        for (p, i), k in n.items():
            for kind, b in belief.get(i, {}).items():
                mass[p, kind] += b * k
                support[p, kind] += b
        sure = {pk: x for pk in mass if support[pk] >= pii.MIN_SEEDS and (x := mass[pk] / total[pk[0]] * (1 - 1 / (1 + support[pk]))) >= pii.SURE_PATTERN}
        gained = {}
        for (p, i), _ in n.items():
            for (q, kind), x in sure.items():
                if q == p:
                    gained.setdefault(i, {}).setdefault(kind, []).append(x)
        belief = {i: {kind: 1 - math.prod(max(1 - x, 1e-9) for x in xs) for kind, xs in kinds.items()} for i, kinds in gained.items() if i not in seeds} | seeds
    return sure


def test_pii_graph(spark):
    """Spark's scores against plain ones, over chains that need several rounds."""
    rng = random.Random(3)
    edges = [(f"p{rng.randrange(12)}", f"i{rng.randrange(40)}", rng.choice([-1, -1, 0, 1, 4]), rng.randint(1, 3)) for _ in range(400)]
    edges += [("q0", f"s{k}", 2, 1) for k in range(30)] + [("q0", f"a{k}", -1, 1) for k in range(6)] + [("q1", f"a{k}", -1, 1) for k in range(6)] + [("q1", "b", -1, 1)]
    kinds = {}
    edges = [(p, i, kinds.setdefault(i, k), n) for p, i, k, n in edges]
    df = spark.createDataFrame(edges, "pattern string, instance string, kind int, n long")
    for rounds in (1, 2, 3):
        got = {(r.pattern, r.kind): r.sure for r in pii.score_graph(df, rounds).collect()}
        want = plain_graph(edges, rounds)
        assert set(got) == set(want) and all(abs(got[k] - x) < 1e-9 for k, x in want.items())
    assert ("q1", 2) not in plain_graph(edges, 1) and ("q1", 2) in plain_graph(edges, 2)


def test_pii_secrets(spark):
    """Keys of known shapes teach a context; in it unseen ones are found, elsewhere neither they nor checksums are."""
    rng = random.Random(9)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(8))
    seeds = [(i, f'{filler()} token = "{key()}"### {filler()}') for i in range(30)]
    unseen = [(100 + i, f'{filler()} token = "{x}" {filler()}') for i, x in enumerate(["hunter2-x", "Zx9_Qp77_Lm", "12345-abc"])]
    clean = [(200 + i, f"{filler()} {'checksum'[:i % 9]} {key()} {filler()}") for i in range(8)] + [(300, "room 12345b and box 99-abc"), (301, f"{filler()} 2024-01-05 {filler()}")]
    got = {r.doc_id: r.more for r in pii.extract(spark.createDataFrame(seeds + unseen + clean, "doc_id long, text string")).collect()}
    for i, t in seeds + unseen:
        assert [t[x.start : x.end] for x in got[i]] == [re.search('"(.*?)"', t)[1]] and got[i][0].kind == pii.SECRET
    assert not any(got[i] for i, _ in clean)
    assert pii.candidates('x="ab12cd"## foo\r12345ab \u00a067890 <k9k9k>', []) == [(3, 9), (17, 24), (26, 31), (33, 38)]


def test_pii_groups_and_long_tokens(spark):
    """Identifiers in groups, and tokens of any length, are found whole by a sure context."""
    token = "eyJ" + "a1B2c3" * 60
    unseen = ["415 555 0112", "(415) 555-0112", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "4111 1111 1111 1112", token]
    rows = [(i, f"please dial number {x} today") for i, x in enumerate(unseen)] + [(100 + i, f"please dial number +1 415 555 01{i:02} today") for i in range(40)]
    got = {r.doc_id: r.more for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), x in zip(rows, unseen):
        assert [t[s.start : s.end] for s in got[i]] == [x]
    text = "192.168.0.1 415 555 0112 and 12-34 (77 888 9)"
    assert [text[a:b] for a, b in pii.groups(text, pii.base_spans(text))] == ["415 555 0112", "12-34", "77 888 9"]
    for t in ("1 " * 200_000, "A1" * 200_000, "a1" * 200_000, "(1" * 200_000):
        pii.unknown(t, [])


def test_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 50_000):
        pii.base_spans(t)


def brute_force(codec, pieces, text):
    """The best score by a plain quadratic recursion."""
    score = {p.replace("▁", " "): s for p, s, t in pieces if t in (1, 4)}
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            x = score.get(text[s:e])
            if x is None and e - s == 1:
                x = codec.unknown
            if x is not None:
                best[e] = max(best[e], best[s] + x)
    return best[-1]


def test_sentencepiece(docs, empty):
    pieces = sentencepiece.log_probabilities(*sentencepiece.read_pieces())
    codec = sentencepiece.Codec(pieces)
    for t in ("the quick brown fox", "  two  spaces ", "naïve 中文 ▁ x\n\ny\t", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00"):
        whole = " " + t
        assert codec.decode(codec.encode(t).tolist()) == t
        ids, best = codec.viterbi(whole)
        assert abs(best - brute_force(codec, pieces, whole)) < 1e-6
        part_score = sum(pieces[i][1] for i in codec.encode(t).tolist() if pieces[i][2] == 1)
        assert abs(part_score - sum(pieces[i][1] for i in ids if pieces[i][2] == 1)) < 1e-6
    assert sentencepiece.round_trip(empty).count() == 0
    got = sentencepiece.round_trip(docs, with_ids=True)
    assert got.filter("not same").count() == 0 and got.count() == len(ROWS)
    back = sentencepiece.decode(sentencepiece.encode(docs))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in ROWS), key=repr)


def test_sentencepiece_like_the_library(tmp_path):
    """A unigram model of the same pieces in the library gives pieces of the same score."""
    import struct

    import sentencepiece as library

    def number(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda k, b: number(k << 3 | 2) + number(len(b)) + b
    pieces = sentencepiece.log_probabilities(*sentencepiece.read_pieces())
    model = b"".join(field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(t)) for p, s, t in pieces)
    model += field(2, number(3 << 3) + number(1) + number(35 << 3) + number(1)) + field(3, field(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(0) + number(5 << 3) + number(1))
    (tmp_path / "m.model").write_bytes(model)
    theirs, ours = library.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), sentencepiece.Codec(pieces)
    for t in ("Hello world, this is a test of the tokenizer.", "Straße naïve déjà vu 中文 end", "spam  and   eggs"):
        a, b = theirs.encode(t), ours.encode(t).tolist()
        assert abs(sum(pieces[i][1] for i in a if pieces[i][2] == 1) - sum(pieces[i][1] for i in b if pieces[i][2] == 1)) < 1e-3
        assert theirs.decode(b) == t


def test_chunks():
    import pyarrow as pa

    batch = pa.record_batch({"text": ["abc", None, "x" * 50, "", "yz"]})
    assert [t for _, ts in common.chunks(batch, limit=10) for t in ts] == ["abc", "", "x" * 50, "", "yz"]
