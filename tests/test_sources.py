import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpusmill.sources import inference, readers, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    assert rows(readers.read_jsonl(spark, str(p), "id string, n int")) == [("a", 1), ("b", 2)]
    p.write_text('{"id": "a", "n": 1}\nnoise\n{broken\n  {"id": "c", "n": 3}\n')
    assert rows(readers.read_jsonl_tolerant(spark, str(p), "id string, n int")) == [("a", 1), ("c", 3)]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(p), "id string, n int").collect()


def test_documents_and_globs(spark, tmp_path):
    for k in (10, 2):
        (tmp_path / f"checkpoint-{k}").mkdir()
        (tmp_path / f"checkpoint-{k}" / "s.json").write_text('{\n"n": %d\n}' % k)
    paths = readers.expand_inputs(spark, [f"{tmp_path}/checkpoint-*/s.json", "/nowhere/x"])
    assert len(paths) == 3 and paths[-1] == "/nowhere/x"
    df = readers.read_json_document(spark, paths[:2], "n int").select("n", readers.step_of("input_path").alias("step"))
    assert sorted(map(tuple, df.collect())) == [(2, 2), (10, 10)]
    assert readers.numbered_dirs(spark, str(tmp_path)) == [2, 10]
    with pytest.raises(Exception, match="no step"):
        spark.range(1).select(readers.step_of(F.lit("x"))).collect()


def test_optional_cached_and_counted(spark, tmp_path):
    assert readers.read_optional(lambda: spark.read.parquet(f"{tmp_path}/none"), spark, "question string, answer string, target_answer string").count() == 0
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert readers.cache_or_build(spark, f"{tmp_path}/c", build, force).count() == 3
    assert len(built) == 2
    assert readers.check_count(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        readers.check_count(spark.range(3), 4)
    assert readers.first_readable([lambda: spark.read.parquet(f"{tmp_path}/none"), lambda: spark.read.parquet(f"{tmp_path}/c")]).count() == 3
    with pytest.raises(AnalysisException):
        readers.first_readable([lambda: spark.read.parquet(f"{tmp_path}/none")])


def test_union_answers(spark):
    df = spark.createDataFrame([('["a", "b"]',), ("[0, 1]",), ("x",), (None,), ("[]",), ('["open',)], "a string")
    got = [r[0] for r in df.select(readers.string_or_list("a")).collect()]
    assert got == [["a", "b"], ["[0, 1]"], ["x"], [], [], ['["open']]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 3, None), ("s2", 4, "y"), ("s1", 5, "z")], "source string, n int, t string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert sorted(x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().split()[1:]) == ["s1,3,", "s1,5,z", "s2,4,y"]
    got = sinks.route(df, F.col("t").isNotNull(), f"{tmp_path}/ok", f"{tmp_path}/bad").first()
    assert tuple(got) == (2, 1) and spark.read.json(f"{tmp_path}/bad").count() == 1
    sinks.route(df, F.lit(True), f"{tmp_path}/dry", f"{tmp_path}/dry2", dry_run=True)
    assert not (tmp_path / "dry").exists()
    m = sinks.manifest(df, words="n").first()
    assert (m.rows, m.words, m.sources) == (3, 12, {"s1": 2, "s2": 1})
    sinks.write_indexed(df, f"{tmp_path}/ix", "n")
    assert sorted((r.n, r["index"]) for r in spark.read.json(f"{tmp_path}/ix").collect()) == [(3, 0), (4, 1), (5, 2)]
    both = sinks.concat_existing([lambda: spark.read.json(f"{tmp_path}/ok"), lambda: spark.read.json(f"{tmp_path}/none"), lambda: spark.read.json(f"{tmp_path}/bad")])
    assert both.count() == 3
    sinks.write_splits(df, f"{tmp_path}/split", "source")
    assert spark.read.parquet(f"{tmp_path}/split/source=s1").count() == 2
    for _ in range(2):
        sinks.batch_writer(f"{tmp_path}/batches")(df, 7)
    assert spark.read.parquet(f"{tmp_path}/batches").count() == 3


def test_inference(spark):
    """Calls are tried again with growing pauses; a prompt whose calls all fail has the error."""
    waits, calls = [], []

    def flaky(prompts, n):
        calls.append(len(prompts))
        if len(calls) < 4:
            raise OSError("busy")
        return [[p.upper()] * n for p in prompts]

    assert inference.call(flaky, ["a", "b"], 2, 5, waits.append) == ([["A", "A"], ["B", "B"]], None)
    assert waits == [1.0, 2.0, 4.0] and inference.backoff(9) == 30.0

    def make():
        def client(prompts, n):
            if "bad" in prompts:
                raise ValueError("no")
            return [[f"{p}{k}" for k in range(n)] for p in prompts]

        return client

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "id long, prompt string")
    got = sorted(map(tuple, inference.respond(df, "id", "prompt", make, n=2, batch=1, tries=1).collect()))
    assert got == [(1, 1, "x0", None), (1, 2, "x1", None), (2, 0, None, "ValueError: no"), (3, 1, "y0", None), (3, 2, "y1", None)]


def test_replaced_files(spark, tmp_path):
    path = f"{tmp_path}/p.json"
    assert sinks.read_bytes(spark, path) is None
    for k in (b"1", b"22"):
        sinks.write_bytes(spark, path, k)
    assert sinks.read_bytes(spark, path) == b"22"
    assert sinks.sidecar_path("a/b.jsonl") == "a/b_capability_rescues.jsonl"
    with pytest.raises(Exception):
        sinks.copy_tree(spark, f"{tmp_path}/none", f"{tmp_path}/x")


def test_progress(spark, tmp_path):
    """At every moment there is a record: also between the new one and the end of the old ones."""
    path = f"{tmp_path}/progress.json"
    assert sinks.read_progress(spark, path) is None
    for k in range(12):
        sinks.write_progress(spark, path, str(k).encode())
        assert sinks.read_progress(spark, path) == str(k).encode()
    sinks.write_bytes(spark, f"{path}.{12:012d}", b"new")  # broken off before the old one goes
    assert sinks.read_progress(spark, path) == b"new"
    sinks.write_progress(spark, path, b"next")
    assert sinks.read_progress(spark, path) == b"next" and len(list(tmp_path.glob("progress.json.*"))) == 1
