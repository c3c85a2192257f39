"""Queries on sources and sinks: tables go out through a sink into the shared folder and come back through a reader."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import new_dir
from ..sources import inference, readers, sinks
from .curation import docs

_META = "doc_id bigint, lang string, source string, n_chars bigint"


def _meta(spark, d):
    return docs(spark, d).select("doc_id", "lang", "source", "n_chars")


def _by_lang(df):
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def jsonl_round_trip(spark, d):
    place = new_dir(spark, "files")
    sinks.write_jsonl(_meta(spark, d), f"{place}/a")
    return _by_lang(readers.read_jsonl(spark, f"{place}/a", _META))


def appended_lines(spark, d):
    place = new_dir(spark, "files")
    for lang in ("en", "fr"):
        sinks.write_jsonl(_meta(spark, d).filter(F.col("lang") == lang), f"{place}/a", append=True)
    return _by_lang(readers.read_jsonl(spark, f"{place}/a", _META))


def tolerant_lines(spark, d):
    place, kind = new_dir(spark, "files"), F.col("doc_id") % 4
    whole = F.to_json(F.struct("doc_id", "lang", "source", "n_chars"))
    line = F.when(kind == 0, F.concat(F.lit("# "), whole)).when(kind == 1, F.concat(F.lit("  "), whole)).when(kind == 2, F.lit('{"doc_id": ')).otherwise(whole)
    docs(spark, d).select(line.alias("value")).write.text(f"{place}/a")
    return _by_lang(readers.read_jsonl_tolerant(spark, f"{place}/a", _META))


def checkpoint_documents(spark, d):
    place = new_dir(spark, "files")
    for k in (10, 2, 300):
        docs(spark, d).filter(F.col("doc_id") % k == 0).agg(F.count("*").alias("n")).coalesce(1).write.option("pretty", True).json(f"{place}/checkpoint-{k}")
    found = readers.numbered_dirs(spark, place)
    paths = readers.expand_inputs(spark, [f"{place}/checkpoint-{k}/part-*.json" for k in found])
    return readers.read_json_document(spark, paths, "n bigint").select(readers.step_of("input_path").cast("long").alias("step"), "n")


def mirrored_split(spark, d):
    place = new_dir(spark, "files")
    for split, odd in (("train", 1), ("test", 0)):
        _meta(spark, d).filter(F.col("doc_id") % 2 == odd).write.parquet(f"{place}/set/main/{split}-00000.parquet")
    return _by_lang(readers.read_mirror(spark, place, "set", "main", "test"))


def saved_splits(spark, d):
    place = new_dir(spark, "files")
    sinks.write_splits(_meta(spark, d), f"{place}/a", "lang")
    return readers.read_split_dirs(spark, f"{place}/a", "de", "lang").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def zipped_records(spark, d):
    place = new_dir(spark, "files")
    regions = [r.asDict() for r in spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").collect()]  # five rows
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        archive.writestr("data/regions.json", json.dumps(regions))
    sinks.write_bytes(spark, f"{place}/a.zip", content.getvalue())
    pinned = lambda: spark.read.parquet(f"{place}/pinned")
    return readers.first_readable([pinned, lambda: readers.read_zip_json(spark, f"{place}/a.zip", "data/regions.json", "r_regionkey bigint, r_name string")])


def csv_report(spark, d):
    place = new_dir(spark, "files")
    report = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.max(F.when(F.col("c_acctbal") > 9900, F.col("c_acctbal"))), 2).alias("best"))
    sinks.write_csv(report, f"{place}/a")
    back = spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").csv(f"{place}/a")
    return back.select("c_nationkey", "n", F.coalesce("best", F.lit("")).alias("best"))


def json_array(spark, d):
    place = new_dir(spark, "files")
    sinks.write_json_array(spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_regionkey"), f"{place}/a", "n_name")
    return readers.read_json_document(spark, f"{place}/a", "index bigint, n_name string, n_regionkey bigint").drop("input_path")


def indexed_rows(spark, d):
    place = new_dir(spark, "files")
    sinks.write_indexed(_meta(spark, d), f"{place}/a", "n_chars", "doc_id")
    return spark.read.schema("index bigint, doc_id bigint, n_chars bigint").json(f"{place}/a")


def summary_log(spark, d):
    place = new_dir(spark, "files")
    for lang in ("en", "de", "en"):
        sinks.append_log(_by_lang(_meta(spark, d).filter(F.col("lang") == lang)), f"{place}/log")
    return spark.read.schema("lang string, n bigint, chars bigint").json(f"{place}/log")


def concatenated(spark, d):
    place = new_dir(spark, "files")
    for lang in ("fr", "es"):
        sinks.write_jsonl(_meta(spark, d).filter(F.col("lang") == lang), f"{place}/{lang}")
    return _by_lang(sinks.concat_existing([lambda name=name: readers.read_jsonl(spark, f"{place}/{name}", _META) for name in ("fr", "missing", "es")]))


def routed(spark, d):
    place = new_dir(spark, "files")
    counts = sinks.route(_meta(spark, d), F.col("n_chars") > 1000, f"{place}/good", f"{place}/bad")
    sinks.route(_meta(spark, d), F.lit(True), f"{place}/dry", f"{place}/dry", dry_run=True)
    dry = readers.read_optional(lambda: spark.read.json(f"{place}/dry"), spark, _META).count()
    sizes = [readers.read_jsonl(spark, f"{place}/{p}", _META).agg(F.count("*").alias(p)) for p in ("good", "bad")]
    return counts.crossJoin(sizes[0]).crossJoin(sizes[1]).withColumn("dry", F.lit(dry).cast("long"))  # one row each


def rescue_sidecar(spark, d):
    place = new_dir(spark, "files")
    path = sinks.write_sidecar(_meta(spark, d), F.col("lang") == "es", f"{place}/x_eval_results.jsonl")
    return readers.read_jsonl(spark, path, _META).select("doc_id", "source", F.lit(path.rsplit("/", 1)[1]).alias("file"))


def error_log(spark, d):
    place = new_dir(spark, "files")
    sinks.write_error_log(spark.read.parquet(f"{d}/region.parquet").withColumn("none", F.lit(None).cast("string")), f"{place}/a", "r_regionkey", ["r_name", "none"])
    return spark.read.text(f"{place}/a").groupBy("value").agg(F.count("*").alias("n"))


def report_lines(spark, d):
    report = docs(spark, d).groupBy("lang").pivot("source", ["src1", "src2"]).count()
    return sinks.fixed_width(report, {"lang": 6, "src1": 5, "src2": 5}, right=("src1", "src2"))


def copied_folder(spark, d):
    place = new_dir(spark, "files")
    _meta(spark, d).write.parquet(f"{place}/a")
    sinks.copy_tree(spark, f"{place}/a", f"{place}/far/b")
    return _by_lang(spark.read.parquet(f"{place}/far/b"))


def cached_table(spark, d):
    place, built = new_dir(spark, "files"), []

    def build():
        built.append(1)
        return _by_lang(_meta(spark, d))

    for force in (False, False, True):
        out = readers.cache_or_build(spark, f"{place}/a", build, force)
    return readers.check_count(out, out.count()).withColumn("builds", F.lit(len(built)).cast("long"))


def progress_file(spark, d):
    """A progress record that is replaced as a whole."""
    path = f"{new_dir(spark, 'files')}/progress.json"
    before = sinks.read_progress(spark, path)
    for n in (1, 2):
        sinks.write_progress(spark, path, json.dumps({"seen": docs(spark, d).count() * n}).encode())
    seen = json.loads(sinks.read_progress(spark, path))["seen"]
    return spark.createDataFrame([(before is None, seen)], "fresh boolean, seen long")


def complete_manifest(spark, d):
    n = T.word_count("text").cast("long")
    rows = docs(spark, d).select("source", n.alias("words"), F.when(F.col("lang") == "fr", "language").when(n < 50, "too_short").alias("reason"))
    m = sinks.full_manifest(rows, "reason", "source", "words", {"main": 10}, {"seed": "7"})
    return m.select("rows", "dropped", "words", F.element_at("drops", "language").alias("language"), F.element_at("drops", "too_short").alias("too_short"), F.size("sources").cast("long").alias("n_sources"), F.element_at("sources", "src3").alias("src3"), F.col("caps")["main"].cast("long").alias("main"), F.col("parameters")["seed"].alias("seed"))


def sampled_responses(spark, d):
    """Two samples for each prompt of a client that answers with a part of the prompt."""
    asked = spark.read.parquet(f"{d}/conversations.parquet").filter("turn = 0").select("conv_id", "text")
    out = inference.respond(asked, "conv_id", "text", lambda: lambda prompts, n: [[p[: 10 * k] for k in range(1, n + 1)] for p in prompts], n=2)
    return out.select("conv_id", F.col("sample").cast("long").alias("sample"), "response")


_BY_LANG = "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE {} GROUP BY lang"
_N = r"len(regexp_extract_all(text, '\S+'))"
ORACLES = {
    "jsonl_round_trip": _BY_LANG.format("true"),
    "appended_lines": _BY_LANG.format("lang IN ('en', 'fr')"),
    "tolerant_lines": _BY_LANG.format("doc_id % 4 IN (1, 3)"),
    "checkpoint_documents": " UNION ALL ".join(f"SELECT {k}::BIGINT AS step, count(*) AS n FROM documents WHERE doc_id % {k} = 0" for k in (2, 10, 300)),
    "mirrored_split": _BY_LANG.format("doc_id % 2 = 0"),
    "saved_splits": "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'de' GROUP BY 1",
    "zipped_records": "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region",
    "csv_report": "SELECT c_nationkey::VARCHAR AS c_nationkey, count(*)::VARCHAR AS n, coalesce(round(max(c_acctbal) FILTER (c_acctbal > 9900), 2)::VARCHAR, '') AS best FROM customer GROUP BY c_nationkey",
    "json_array": "SELECT row_number() OVER (ORDER BY n_name) - 1 AS index, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation",
    "indexed_rows": "SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS index, doc_id, n_chars FROM documents",
    "summary_log": _BY_LANG.format("lang = 'de'") + " UNION ALL " + " UNION ALL ".join([_BY_LANG.format("lang = 'en'")] * 2),
    "concatenated": _BY_LANG.format("lang IN ('es', 'fr')"),
    "routed": "SELECT count(*) FILTER (n_chars > 1000) AS accepted, count(*) FILTER (n_chars <= 1000) AS rejected, count(*) FILTER (n_chars > 1000) AS good, count(*) FILTER (n_chars <= 1000) AS bad, 0::BIGINT AS dry FROM documents",
    "rescue_sidecar": "SELECT doc_id, source, 'x_eval_results_capability_rescues.jsonl' AS file FROM documents WHERE lang = 'es'",
    "error_log": "SELECT value, count(*) AS n FROM (SELECT unnest(['--- error ' || r_regionkey || ' ---', 'r_name: ' || r_name, 'none: -']) AS value FROM region) GROUP BY value",
    "report_lines": "SELECT rpad(lang, 6, ' ') || '  ' || lpad(coalesce(nullif(count(*) FILTER (source = 'src1'), 0)::VARCHAR, '-'), 5, ' ') || '  ' || lpad(coalesce(nullif(count(*) FILTER (source = 'src2'), 0)::VARCHAR, '-'), 5, ' ') AS line FROM documents GROUP BY lang",
    "copied_folder": _BY_LANG.format("true"),
    "cached_table": f"SELECT *, 2::BIGINT AS builds FROM ({_BY_LANG.format('true')})",
    "progress_file": "SELECT true AS fresh, 2 * count(*) AS seen FROM documents",
    "complete_manifest": f"SELECT count(*) FILTER (k) AS rows, count(*) FILTER (NOT k) AS dropped, CAST(sum(n) FILTER (k) AS BIGINT) AS words, count(*) FILTER (lang = 'fr') AS language, count(*) FILTER (lang <> 'fr' AND n < 50) AS too_short, count(DISTINCT source) FILTER (k) AS n_sources, count(*) FILTER (k AND source = 'src3') AS src3, 10::BIGINT AS main, '7' AS seed FROM (SELECT lang, source, {_N} AS n, lang <> 'fr' AND {_N} >= 50 AS k FROM documents)",
    "sampled_responses": "SELECT conv_id, k AS sample, left(text, (10 * k)::INT) AS response FROM conversations, range(1, 3) AS t(k) WHERE turn = 0",
}
QUERIES = {name: globals()[name] for name in ORACLES}
