import random
import zlib

from pyspark.sql import functions as F

from corpusmill.llm import toxicity

from .conftest import ROWS


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeioubdfglmnprst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w, toxic = [rng.choice(vocab) for _ in range(rng.randint(20, 80))], int(rng.random() < 0.3)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["wretchling", "snotwaffle", "crumbhead"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    misspelt = [(9001, "some plain words and you wretchlingg there"), (9002, "some plain words and nothing else there")]
    df = spark.createDataFrame(rows + misspelt, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(i, t) for i, _, t in labels if got[i].held_out]
    assert sum(got[i].predicted == t for i, t in held) / len(held) > 0.95
    clean = sorted(got[i].score for i, _, t in labels if not t)
    assert got[9001].score > clean[int(0.99 * len(clean))] and got[9002].score < 0.5
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {r.doc_id for r in toxicity.clean(df, lab).collect()} == {i for i, r in got.items() if not r.predicted}


def test_whole_words_are_scored(spark):
    """Insults in the middle of run-together words and of text without spaces."""
    rows, labels = corpus()
    rng = random.Random(5)
    plain = sorted({w for _, t in rows for w in t.split()} - {"wretchling", "snotwaffle", "crumbhead"})
    run = lambda middle: "".join(rng.choice(plain) for _ in range(6)) + middle + "".join(rng.choice(plain) for _ in range(6))
    tags = [(9000 + i, f"some plain words #{run('snotwaffle' if i < 20 else '')} there") for i in range(40)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(rows + tags, "doc_id long, text string"), lab).collect()}
    assert sum(got[9000 + i] > got[9020 + j] for i in range(20) for j in range(20)) > 0.9 * 400
    han = [chr(0x4E00 + i) for i in range(300)]
    labels = [(i, 1, int(rng.random() < 0.3)) for i in range(700)]
    rows = [(i, "".join(rng.choice(han) for _ in range(30)) + ("\u7b28\u86cb" if t else "") + "".join(rng.choice(han) for _ in range(30))) for i, _, t in labels]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(i, t) for i, _, t in labels if got[i].held_out]
    assert sum(got[i].predicted == t for i, t in held) / len(held) > 0.95


def test_repeated_ids(spark):
    """Of several texts of one id that of the least digest is learnt, whatever the partitions."""
    rows, labels = corpus(200)
    twice = rows + [(i, t[::-1]) for i, t in rows[:100]]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    runs = [[tuple(r) for r in toxicity.toxicity(spark.createDataFrame(twice, "doc_id long, text string").repartition(n), lab).orderBy("doc_id", "score").collect()] for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_plain_scores(spark):
    """Against scores that are worked out word by word from the weights, without memo and numpy."""
    rows, labels = corpus(150)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    weights, bias = toxicity.train(df, lab).weights()
    mean = lambda xs: sum(xs) / len(xs)

    def plain(text):
        worth = [mean([float(weights[b]) for b in toxicity.features(w)]) for w in toxicity.words_of(text)]
        parts = [worth[i : i + toxicity.SEGMENT] for i in range(0, len(worth), toxicity.SEGMENT)]
        return max(map(sum, parts), default=0.0) + bias

    scores = toxicity._WordScores(weights)
    for _, t in [*rows, (0, ""), (1, "one"), (2, "one two three four"), (3, "x" * 200)]:
        assert abs(plain(t) - toxicity.log_odds(toxicity.words_of(t), scores, bias)) < 1e-4


def test_every_ngram_is_in_a_block():
    for word in (b"x" * 41, bytes(97 + i * i % 23 for i in range(300)), "\u00fcber\u00e9".encode() * 20):
        marked = b"<" + word + b">"
        blocks = [w[1:] for w in toxicity.words_of(word.decode())]
        assert max(map(len, blocks)) <= toxicity.BLOCK
        assert all(any(marked[i : i + n] in b for b in blocks) for n in toxicity.GRAMS for i in range(len(marked) - n + 1))


def test_odd_tables(spark, docs):
    rows, labels = corpus(60)
    one_class = spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], "doc_id long, quality int, toxic int")
    odd = toxicity.toxicity(docs, one_class)
    assert odd.count() == len(ROWS) and odd.filter(F.col("score") > 0).count() == 0
    assert odd.filter("doc_id is null and held_out").count() == 0
    assert toxicity.clean(docs, one_class).count() == len(ROWS)
