"""Token files: an exact round trip, the library's own ids, parts of blocks and damaged bytes."""

import random
import zlib

import numpy as np
import pytest

from corpusmill.llm import tokenfile
from corpusmill.shared import new_dir

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")


def plain(rows, path):
    """doc_id, n_tokens and crc32 by the library, in the order of doc_id."""
    tok = tokenizers.Tokenizer.from_file(path)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def texts():
    rnd = random.Random(3)
    spaces = [" ", "  ", "   ", "\n", " \n", "\n ", "\n\n  ", "\t", " ", "\x1c", " ", "\x85", "​", " \t "]
    words = ["the", "don't", "it's", "Ünder", "1234", "...", "a.b", "—", "日本語", "x" * 90, "<|endoftext|>", "é", "😀", "'s", "$", "\x00"]
    out = ["".join(rnd.choice(words) + rnd.choice(spaces) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    return out + ["", None, " ", "  ", " a", "a ", "\n a", "a\n b", "a \n b", " " * 500, "word " * 20_000, "y" * 3000]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder(path):
    tok, encode = tokenizers.Tokenizer.from_file(path), tokenfile.Encoder(path)
    given = [t or "" for t in texts()]
    for _ in range(2):  # the second time from the memo
        for text, got in zip(given, encode(given), strict=True):
            assert np.frombuffer(got, encode.kind).tolist() == tok.encode(text, add_special_tokens=False).ids + [2], repr(text[:80])


def test_small_memo(monkeypatch):
    monkeypatch.setattr(tokenfile, "MEMO", 10)
    given = [t or "" for t in texts()]
    assert tokenfile.Encoder(BYTES)(given) == [x for t in given for x in tokenfile.Encoder(BYTES)([t])]


@pytest.mark.parametrize("n, lanes, every", [(0, 1, 4), (1, 1, 1), (7, 3, 2), (5000, 16, 8), (5000, 1, 500), (4096, 64, 16), (100, 1024, 256)])
def test_frames(n, lanes, every):
    rng = np.random.default_rng(n + lanes)
    ids = np.minimum(rng.geometric(0.03, n) * rng.integers(1, 40, n), 49_999).astype(np.uint32)
    table = tokenfile.Table(tokenfile.scaled({int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True), strict=True)}))
    data = tokenfile.pack(3, 77, [5, None], [n - n // 3, n // 3], ids, table, lanes, every)
    frame = tokenfile.Frame(data)
    assert frame.ids(table).tolist() == ids.tolist() and (frame.shard, frame.first, frame.doc_ids, frame.lengths.tolist()) == (3, 77, [5, None], [n - n // 3, n // 3])
    for a, b in ((0, n), (n // 3, n // 2), (n - 1, n), (n // 2, n // 2)):
        assert frame.between(max(a, 0), b, table).tolist() == ids[max(a, 0) : b].tolist()
    for k in range(0, len(data), max(1, len(data) // 23)):
        bad = bytearray(data)
        bad[k] ^= 4
        with pytest.raises(ValueError):
            tokenfile.Frame(bytes(bad)).ids(table)
    with pytest.raises(ValueError):
        tokenfile.Frame(data[:-3])
    if n == 5000 and lanes == 16:
        _, counts = np.unique(ids, return_counts=True)
        assert len(frame.stream) * 32 < 1.03 * -(counts * np.log2(counts / n)).sum() + 32 * lanes


def test_scaled():
    assert tokenfile.scaled({}) == {}
    for counts in ({7: 1}, {0: 1, 5: 10**12}, {i: i * i + 1 for i in range(3000)}):
        got = tokenfile.scaled(counts)
        total = sum(got.values())
        assert got.keys() == counts.keys() and min(got.values()) >= 1 and total & (total - 1) == 0 and total >= 4 * len(counts)


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_files(spark, block):
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts())] + [(None, "no id"), (7, "twice"), (7, "twice"), (10**15, "x " * 3000)]
    rows = [r for r in rows if rows.count(r) > 1 or [x[0] for x in rows].count(r[0]) == 1]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, start long, ids string").repartition(4)
    path = new_dir(spark, "test")
    tokenfile.write(df, BYTES, path, block)
    got = sorted((tuple(r) for r in tokenfile.read(spark, path).collect()), key=lambda r: r[1])
    assert got == plain(rows, BYTES)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read(spark, path, with_ids=True).collect()}
    tok = tokenizers.Tokenizer.from_file(BYTES)
    assert tok.decode(back[10**15][:-1]) == "x " * 3000
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert (len(blocks) > 20) == (block == 50) and sum(b.n_docs for b in blocks) == len(rows)


def test_empty(spark):
    path = new_dir(spark, "test")
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), BYTES, path)
    assert tokenfile.read(spark, path).collect() == []
    path = new_dir(spark, "test")
    tokenfile.write(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), BYTES, path)
    assert sorted(tuple(r)[:3] for r in tokenfile.read(spark, path).collect()) == [(1, 0, 1), (2, 1, 1)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in ("10000", "1000")


def test_cuts():
    """Parts are found in all texts together, finer than at spaces, and equal ones are encoded once."""
    given = ["Foo,bar 12ab\nbaz", "", " x", "a ", "it's 　 b", "née été.", "3×é\nÉ÷1"]
    raw = [t.encode() for t in given]
    starts = tokenfile.cuts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]))
    parts = [b"".join(raw)[a:b].decode() for a, b in zip(starts, [*starts[1:], None], strict=True)]
    assert parts == ["Foo", ",", "bar", " 12", "ab", "\n", "baz", " x", "a", " ", "it", "'s", " 　", " b", "née", " été", ".", "3×é", "\n", "É÷1"]
    encode = tokenfile.Encoder(BYTES)
    encode(["word, word; word.\nword (word) " * 50])
    assert len(encode.memo) < 12


def test_words():
    """Words that go to the model alone have the ids that the whole tokenizer gives them."""
    tok, encode = tokenizers.Tokenizer.from_file(BYTES), tokenfile.Encoder(BYTES)
    rnd = random.Random(4)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
    for text in ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 20))) for _ in range(2000)]:
        for t in (text, " " + text):
            assert np.frombuffer(encode([t])[0], encode.kind).tolist() == tok.encode(t, add_special_tokens=False).ids + [2], repr(t)
