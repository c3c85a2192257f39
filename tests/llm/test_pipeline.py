"""The pipeline over small tables, stage by stage against what each must do."""

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import PASSAGE
from .test_pairs import brute_components, brute_lines
from .test_toxicity import corpus


def test_odd_tables(spark, tmp_path):
    """Each stage on an empty table, and on nulls, repeated rows and further columns whose names the operators use inside."""
    rows, labels = corpus(60)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["score", "odds", "item_id", "_h", "rank", "node", "comp", "ids", "toxic", "mask"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    odd = [(1, None), (2, ""), (3, "plain words stand here"), (3, "plain words stand here"), (None, "plain words of no document"), (4, PASSAGE), (None, PASSAGE), (5, "x" * 300_000), (6, "line one is here")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in odd], schema)
    gone = {"decontamination": {4}}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0, name
        out = stage(spark, df, str(tmp_path))
        got = out.collect()
        assert {r.doc_id for r in got} >= {1, 2, 3, 5, 6} - gone.get(name, set()) and sum(r.doc_id == 3 for r in got) == 2, name
        if name != "sentencepiece":
            assert out.columns == df.columns and all(r[n] == n for r in got for n in names), name
        if name == "decontamination":
            assert [r.text for r in got if r.doc_id is None] == ["plain words of no document"] and 4 not in {r.doc_id for r in got}


def test_pipeline(spark, tmp_path):
    rows, labels = corpus(300)
    extra = [(5000, PASSAGE), (5001, "start\n" + PASSAGE + "\nend of it all here"), (5002, PASSAGE), (5003, None), (5004, ""), (5005, rows[1][1] + " tail"), (5006, "the answer to the riddle of the seven gates is a lantern made of glass and salt"), (5007, "plain words stand here")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows + extra], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, extra[6][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out/{name}")
        out = spark.read.parquet(f"{d}/out/{name}")
        after = {r.doc_id: r for r in out.collect()}
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "line_dedup":
            expected = brute_lines(list(before.items()))
            left = {i: t for (i, _), t in expected.items() if t.strip() or not before[i].strip()}
            assert {i: r.text for i, r in after.items() if r.text is not None} == left
            assert out.filter(F.col("n_chars") != F.length("text")).count() == 0
        if name == "jaccard_join":
            assert set(after) == set(brute_components(list(before.items())).values())
        if name == "decontamination":
            assert set(before) - set(after) == {5006}
        if name == "sentencepiece":
            assert set(after) == set(before) and all(r.same for r in after.values())
        seen[name], docs = set(after), out
    toxic = {i for i, _, t in labels if t}
    assert len(seen["toxicity"] & toxic) <= 0.05 * len(toxic)
    assert 5007 in seen["sentencepiece"] and 5002 not in seen["line_dedup"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == seen["sentencepiece"]
