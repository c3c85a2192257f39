"""Queries on curation: cleaning, rejecting, capping, mixing and auditing of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import link, records, rules, select, stats
from ..sources import readers, sinks

WORDS = r"len(regexp_extract_all(text, '\S+'))"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _words() -> Column:
    return T.word_count("text").cast("long")


def counted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with their number of words, which is worked out once."""
    return docs(spark, d).withColumn("words", _words())


def document_rules() -> list[rules.Rule]:
    """Rules on rows with ``text`` and ``words``."""
    t = F.col("text")
    return [
        rules.Rule("empty", F.coalesce(T.trim(t), F.lit("")) == ""), rules.Rule("chinese", T.has_cjk(t)), rules.Rule("contact", F.rlike(t, F.lit(r"@[a-z0-9.-]+\.[a-z]+"))), rules.Rule("license", F.contains(F.lower(t), F.lit("license"))),
        rules.Rule("symbols", F.rlike(t, F.lit(r"[#$%&]{3}"))), rules.Rule("too_short", F.col("words") < 50), rules.Rule("too_long", F.col("words") > 2000), rules.Rule("abrupt", F.rlike(t, F.lit(r"[a-z]$"))),
    ]


_TESTS = {"empty": "trim(text) = ''", "chinese": "regexp_matches(text, '[一-鿿]')", "contact": r"regexp_matches(text, '@[a-z0-9.-]+\.[a-z]+')", "license": "contains(lower(text), 'license')", "symbols": "regexp_matches(text, '[#$%&]{3}')", "too_short": f"{WORDS} < 50", "too_long": f"{WORDS} > 2000", "abrupt": "regexp_matches(text, '[a-z]$')"}
_REASON = "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for k, t in _TESTS.items()) + " END"
_MD5 = lambda seed, key="doc_id": f"md5('{seed}:' || {key})"


def word_stats_by_source(spark, d):
    return stats.index_stats(docs(spark, d).select("source", _words().alias("words")), ["source"], "words")


def interpolated_stats(spark, d):
    out = stats.interpolated(docs(spark, d).select("lang", _words().alias("words")), ["lang"], "words")
    return out.select("lang", "n", F.col("median").cast("long").alias("median"), F.round("p95", 6).alias("p95"))


def first_reason_counts(spark, d):
    return rules.histogram(rules.apply(counted(spark, d), document_rules()).withColumn("reason", F.coalesce("reason", F.lit("kept"))))


def all_reasons_audit(spark, d):
    return rules.audit(counted(spark, d), document_rules(), "doc_id")


def reason_gate(spark, d):
    return rules.gate(counted(spark, d).filter("lang = 'en'"), document_rules())


def rule_examples(spark, d):
    return rules.examples(rules.apply(counted(spark, d), document_rules()), "doc_id", 20).select("reason", "doc_id", F.col("nth").cast("long").alias("nth"))


def clean_text(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", r"(?i)\bthe answer is\b", ""), r"[#$%&]+", " ")
    rows = docs(spark, d).select("doc_id", T.trim(T.collapse_space(t)).alias("t"))  # used four times, worked out once
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"), T.preview("t", 40).alias("preview"), F.md5(T.noise_key("t")).alias("noise_key"))


def capped_reasons(spark, d):
    tagged = rules.apply(counted(spark, d), document_rules()).select("doc_id", "source", "reason")  # no text is sorted
    return rules.histogram(rules.capped(tagged, "reason", "source", "doc_id", 20, "42").withColumn("reason", F.coalesce("reason", F.lit("kept"))))


def capped_mix(spark, d):
    kept = rules.kept(rules.apply(counted(spark, d), document_rules()))
    main = select.cap_per_group(kept, ["source"], 10, "7", "doc_id").select("doc_id", "source", F.lit("main").alias("part"))
    anchors = select.sample(docs(spark, d).filter("lang <> 'en'"), 25, "anchor", "doc_id").select("doc_id", "source", F.lit("anchor").alias("part"))
    return main.unionByName(anchors)


def stage_assign_pivot(spark, d):
    n, src = _words(), F.regexp_extract("source", r"(\d+)", 1).cast("int")
    by_words = F.when(n < 150, 1).when(n < 400, 2).when(n < 800, 3).otherwise(4)
    stage = F.when(src % 5 == 0, F.when(src <= 5, 1).otherwise(4)).when(src % 5 == 1, by_words).when(src % 5 == 2, F.when(n > 1000, 4).otherwise(3)).when(src % 5 == 3, 5).otherwise(2)
    out = stats.crosstab(docs(spark, d).select("source", stage.alias("stage")), "source", "stage", [1, 2, 3, 4, 5])
    return out.select("source", *[F.col(str(k)).cast("long").alias(f"stage_{k}") for k in range(1, 6)])


def length_buckets(spark, d):
    n = _words()
    bucket = F.when(n < 50, "0-49").when(n < 200, "50-199").when(n < 1000, "200-999").otherwise("1000+")
    return docs(spark, d).groupBy(bucket.alias("bucket"), F.contains("text", F.lit("\n")).alias("several_lines")).agg(F.count("*").alias("n"), F.sum(n).alias("words"))


def bucket_crosstab(spark, d):
    topics = {"license": "license", "numbers": r"[0-9]{3}", "shout": "!!", "question": r"\?"}
    member = F.array_compact(F.array(*[F.when(F.rlike(F.lower("text"), F.lit(p)), F.lit(k)) for k, p in topics.items()]))
    return docs(spark, d).select("lang", F.explode(member).alias("topic")).groupBy("topic", "lang").agg(F.count("*").alias("n"))


def line_histogram(spark, d):
    return docs(spark, d).groupBy(F.least(F.size(F.split("text", "\n")), F.lit(7)).cast("long").alias("lines")).agg(F.count("*").alias("n"))


def dedupe_exact(spark, d):
    return link.first_by(docs(spark, d).withColumn("key", F.md5("text")), ["key"], "doc_id").select("doc_id", "key")


def dup_keys(spark, d):
    return link.duplicates(docs(spark, d).withColumn("key", F.md5("text")), ["key"])


def decontaminate_runs(spark, d):
    return link.overlap(docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def heldout_documents(spark, d):
    dirty = link.overlap(docs(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    return link.held_out(docs(spark, d), dirty, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


def source_manifest(spark, d):
    m = sinks.manifest(docs(spark, d).withColumn("words", _words()), words="words")
    return m.select("rows", "words", F.size("sources").cast("long").alias("n_sources"), F.element_at("sources", "src3").alias("src3"))


def union_answers(spark, d):
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('["a", "'), F.col("doc_id"), F.lit('"]'))).when(kind == 1, F.lit("[0, 1)")).when(kind == 2, F.col("lang"))
    parts = readers.string_or_list(raw)
    return docs(spark, d).select("doc_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts"))


def shared_sources(spark, d):
    en, de = (docs(spark, d).filter(F.col("lang") == x).select("source") for x in ("en", "de"))
    both = en.intersect(de).withColumn("op", F.lit("intersect"))
    return both.unionByName(de.distinct().exceptAll(docs(spark, d).filter("lang = 'es'").select("source").distinct()).withColumn("op", F.lit("except")))


def top_reasons(spark, d):
    return first_reason_counts(spark, d).orderBy(F.col("n").desc(), "reason").limit(3)


def source_gate(spark, d):
    rows = rules.apply(docs(spark, d), rules.source_rules("source", [f"src{i}" for i in range(15)], ["src3", "src17"]))
    return rules.histogram(rows.withColumn("reason", F.coalesce("reason", F.lit("kept"))))


def source_like(spark, d):
    return docs(spark, d).filter(rules.like_any("source", ["C1", "src7"]) | rules.like_any("lang", ["e"])).groupBy("lang", "source").agg(F.count("*").alias("n"))


def numeric_gate(spark, d):
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 7 == 0, F.concat(size, F.lit("_0"))).when(F.col("p_size") % 7 != 1, size)
    rows = rules.apply(spark.read.parquet(f"{d}/part.parquet"), rules.threshold(value, 20))
    return rules.histogram(rows.withColumn("reason", F.coalesce("reason", F.lit("kept"))))


def range_gate(spark, d):
    rows = docs(spark, d).select("source")
    gates = [rules.within(rows, low, high, F.col("source").isin(*blocked)).withColumn("gate", F.lit(name)) for name, low, high, blocked in (("ok", 1, 10**9, ["none"]), ("size", 10**8, 10**9, ["none"]), ("blocked", 1, 10**9, ["src3"]))]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


def prefix_counts(spark, d):
    return rules.prefix_count(rules.apply(counted(spark, d), document_rules()), "too_")


def token_caps(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", F.floor(T.token_proxy("text")).cast("long").alias("tokens"))
    return rules.length_cap(rows, "tokens", 1500, "doc_id", "lang")


def _pool(spark, d):
    return docs(spark, d).select(F.col("text").alias("problem"), F.col("text").alias("solution"), F.when(F.contains("text", F.lit("!!")), "").otherwise("x").alias("answer"), F.lit("unknown").alias("level"), F.regexp_replace("source", r"^src(\d)\d*$", "s$1").alias("source"))


BANDS = {"s1": (50, 400), "s2": (500, 8000)}


def dataset_audit(spark, d):
    return records.audit(_pool(spark, d), BANDS)


def pool_validity(spark, d):
    pool = _pool(spark, d)
    return pool.groupBy("source").agg(F.count("*").alias("n"), F.count_if(records.pool_is_valid(pool)).alias("valid"))


def extended_stages(spark, d):
    level = F.when(F.col("doc_id") % 3 == 0, "olympiads").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Level "), F.col("doc_id") % 6)).otherwise("x")
    kind = F.element_at(F.array(*map(F.lit, ("math", "s1k", "numina", "stratos", "openr1", "other"))), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = docs(spark, d).select(kind.alias("source"), level.alias("level"), _words().alias("words"))
    return rows.groupBy("source", records.stage("source", "level", "words").cast("long").alias("stage")).agg(F.count("*").alias("n"))


def allowed_labels(spark, d):
    """Of the union of two lists those that occur, and those that are missing."""
    allowed = spark.createDataFrame([(f"src{i}",) for i in (1, 2, 99)], "source string").union(spark.createDataFrame([("src2",), ("src5",), ("nowhere",)], "source string")).distinct()
    seen = docs(spark, d).select("source").distinct()
    return allowed.join(seen, "source", "left_semi").withColumn("state", F.lit("present")).unionByName(allowed.join(seen, "source", "left_anti").withColumn("state", F.lit("missing")))


def missing_fields(spark, d):
    rows = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"))
    return rows.groupBy(F.array_join(records.required(rows, ["doc_id", "lang", "source", "title"]), ",").alias("missing")).agg(F.count("*").alias("n"))


def flagged_first(spark, d):
    """Rows by a composite of flags, then id: the first 20."""
    both = F.contains("text", F.lit("\n")) & (F.col("lang") == "en")
    return docs(spark, d).orderBy(F.when(both, 0).when(F.col("lang") == "fr", 1).otherwise(2), "doc_id").limit(20).select("doc_id", "lang")


def next_slice(spark, d):
    return select.next_rows(docs(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"], 0.9, 7)


def quota_shortage(spark, d):
    return select.shortages(docs(spark, d), "lang", {"en": 30, "fr": 20, "xx": 5, "es": 100000})


def running_acceptance(spark, d):
    """For each source the number of accepted rows so far, at every 10th row."""
    rows = rules.apply(counted(spark, d), document_rules())
    out = select.running(rows.select("source", "doc_id", "reason"), ["source"], ["doc_id"], {"seen": F.lit(1).cast("long"), "accepted": F.col("reason").isNull().cast("long")})
    return out.filter(F.col("seen") % 10 == 0).select("source", "doc_id", "seen", "accepted")


def previous_by_source(spark, d):
    return select.with_next(docs(spark, d).select("source", "doc_id"), "source", "doc_id", "next_id", F.lit(-1)).select("doc_id", "next_id", "index")


_TOP = f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1"
_RUNS = lambda t, k: f"(SELECT {k}, array_to_string(w[i:i+7], ' ') AS run FROM (SELECT {k}, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {t}), unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8)"
_OVERLAP = f"SELECT DISTINCT doc_id, item_id FROM {_RUNS('documents', 'doc_id')} JOIN {_RUNS('benchmark', 'item_id')} USING (run)"
ORACLES = {
    "word_stats_by_source": f"SELECT source, count(*) AS n, l[1] AS min, l[len(l) // 2 + 1] AS median, l[CAST(floor((len(l) - 1) * 0.95) AS BIGINT) + 1] AS p95, l[-1] AS max FROM (SELECT source, unnest(list_value(1)) AS one, list_sort(list({WORDS})) AS l FROM documents GROUP BY source), unnest(l) GROUP BY source, l",
    "interpolated_stats": f"SELECT lang, n, CAST(floor((l[(n + 1) // 2] + l[n // 2 + 1]) / 2) AS BIGINT) AS median, round(l[CAST(floor(r) AS BIGINT)] + (l[CAST(ceil(r) AS BIGINT)] - l[CAST(floor(r) AS BIGINT)]) * (r - floor(r)), 6) AS p95 FROM (SELECT lang, count(*) AS n, list_sort(list({WORDS})) AS l, greatest(1.0, least(0.95 * (count(*) + 1), count(*)))::DOUBLE AS r FROM documents GROUP BY lang)",
    "first_reason_counts": _TOP,
    "all_reasons_audit": "SELECT rule, count(*) AS violations, array_to_string((list(doc_id ORDER BY doc_id))[1:3], ',') AS examples FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule FROM documents WHERE {t}" for k, t in _TESTS.items()) + ") GROUP BY rule",
    "reason_gate": f"SELECT count(*) AS rows, count({_REASON}) AS bad, count({_REASON}) = 0 AS passed FROM documents WHERE lang = 'en'",
    "rule_examples": f"SELECT * FROM (SELECT {_REASON} AS reason, doc_id, row_number() OVER (PARTITION BY {_REASON} ORDER BY doc_id) AS nth FROM documents) WHERE reason IS NOT NULL AND nth <= 20",
    "clean_text": r"SELECT doc_id, md5(t) AS digest, length(t) AS chars, CASE WHEN length(p) > 40 THEN left(p, 40) || '...' ELSE p END AS preview, md5(translate(lower(t), '*_', '')) AS noise_key FROM (SELECT doc_id, t, replace(t, chr(10), '\n') AS p FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe answer is\b', '', 'g'), '[#$%&]+', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents))",
    "capped_reasons": f"SELECT CASE WHEN before >= 20 THEN 'cap_reached' ELSE coalesce(reason, 'kept') END AS reason, count(*) AS n FROM (SELECT reason, coalesce(sum(CAST(reason IS NULL AS INT)) OVER (PARTITION BY source ORDER BY {_MD5('42')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, {_REASON} AS reason FROM documents)) GROUP BY 1",
    "capped_mix": f"SELECT doc_id, source, 'main' AS part FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_MD5('7')}, doc_id) AS r FROM documents WHERE {_REASON} IS NULL) WHERE r <= 10 UNION ALL SELECT * FROM (SELECT doc_id, source, 'anchor' FROM documents WHERE lang <> 'en' ORDER BY {_MD5('anchor')}, doc_id LIMIT 25)",
    "stage_assign_pivot": "SELECT source, " + ", ".join(f"count(*) FILTER (stage = {k}) AS stage_{k}" for k in range(1, 6)) + f" FROM (SELECT source, CASE s % 5 WHEN 0 THEN CASE WHEN s <= 5 THEN 1 ELSE 4 END WHEN 1 THEN CASE WHEN n < 150 THEN 1 WHEN n < 400 THEN 2 WHEN n < 800 THEN 3 ELSE 4 END WHEN 2 THEN CASE WHEN n > 1000 THEN 4 ELSE 3 END WHEN 3 THEN 5 ELSE 2 END AS stage FROM (SELECT source, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS s, {WORDS} AS n FROM documents)) GROUP BY source",
    "length_buckets": f"SELECT CASE WHEN n < 50 THEN '0-49' WHEN n < 200 THEN '50-199' WHEN n < 1000 THEN '200-999' ELSE '1000+' END AS bucket, contains(text, chr(10)) AS several_lines, count(*) AS n, CAST(sum(n) AS BIGINT) AS words FROM (SELECT text, {WORDS} AS n FROM documents) GROUP BY 1, 2",
    "bucket_crosstab": " UNION ALL ".join(f"SELECT '{k}' AS topic, lang, count(*) AS n FROM documents WHERE regexp_matches(lower(text), '{p}') GROUP BY lang" for k, p in {"license": "license", "numbers": "[0-9]{3}", "shout": "!!", "question": r"\?"}.items()),
    "line_histogram": "SELECT least(len(string_split(text, chr(10))), 7) AS lines, count(*) AS n FROM documents GROUP BY 1",
    "dedupe_exact": "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY 2",
    "dup_keys": "SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "decontaminate_runs": _OVERLAP,
    "heldout_documents": f"SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_OVERLAP})) GROUP BY lang",
    "source_manifest": f"SELECT count(*) AS rows, CAST(sum({WORDS}) AS BIGINT) AS words, count(DISTINCT source) AS n_sources, count(*) FILTER (source = 'src3') AS src3 FROM documents",
    "union_answers": "SELECT doc_id, [2, 1, 1, 0][doc_id % 4 + 1]::BIGINT AS n, CASE doc_id % 4 WHEN 0 THEN 'a|' || doc_id WHEN 1 THEN '[0, 1)' WHEN 2 THEN lang ELSE '' END AS parts FROM documents",
    "shared_sources": "(SELECT source, 'intersect' AS op FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de')) UNION ALL (SELECT source, 'except' FROM (SELECT source FROM documents WHERE lang = 'de' EXCEPT SELECT source FROM documents WHERE lang = 'es'))",
    "top_reasons": _TOP + " ORDER BY n DESC, reason LIMIT 3",
    "previous_by_source": "SELECT doc_id, coalesce(lead(doc_id) OVER w, -1) AS next_id, row_number() OVER w - 1 AS index FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
}
ORACLES["word_stats_by_source"] = f"SELECT source, len(l) AS n, l[1] AS min, l[len(l) // 2 + 1] AS median, l[CAST(floor((len(l) - 1) * 0.95) AS BIGINT) + 1] AS p95, l[-1] AS max FROM (SELECT source, list_sort(list({WORDS})) AS l FROM documents GROUP BY source)"
_KIND = "['math', 's1k', 'numina', 'stratos', 'openr1', 'other'][doc_id % 6 + 1]"
_AUDIT = "CASE source WHEN 's1' THEN n > 50 AND n < 400 WHEN 's2' THEN n > 500 AND n < 8000 ELSE n > 100 AND n < 2000 END"
_POOL = rf"(SELECT regexp_replace(source, '^src(\d)\d*$', 's\1') AS source, length(text) > 10 AS p, NOT contains(text, '!!') AS b, {WORDS} AS n FROM documents)"
ORACLES |= {
    "source_gate": "SELECT CASE WHEN source IN ('src3', 'src17') THEN 'blocked_source' WHEN source NOT IN (SELECT 'src' || i FROM range(15) AS t(i)) THEN 'disallowed_source' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "source_like": "SELECT lang, source, count(*) AS n FROM documents WHERE source LIKE '%c1%' OR source LIKE '%src7%' OR lang LIKE '%e%' GROUP BY 1, 2",
    "numeric_gate": "SELECT CASE WHEN p_size % 7 IN (0, 1) THEN 'bad_value' WHEN p_size < 20 THEN 'below_threshold' ELSE 'kept' END AS reason, count(*) AS n FROM part GROUP BY 1",
    "range_gate": "SELECT gate, n AS rows, CASE gate WHEN 'blocked' THEN b ELSE 0 END AS blocked, gate = 'ok' AS passed FROM (SELECT count(*) AS n, count(*) FILTER (source = 'src3') AS b FROM documents), (VALUES ('ok'), ('size'), ('blocked')) AS t(gate)",
    "prefix_counts": f"SELECT count(r) AS rejected, count(*) FILTER (starts_with(r, 'too_')) AS with_prefix FROM (SELECT {_REASON} AS r FROM documents)",
    "token_caps": "SELECT lang, count(*) AS n, count(*) FILTER (t <= 1500) AS kept, max(t) AS longest, round(avg(t), 4) AS mean, coalesce(array_to_string((list(doc_id ORDER BY doc_id) FILTER (t > 1500))[1:5], ','), '') AS examples FROM (SELECT doc_id, lang, CAST(floor(greatest(1, length(text) / 4)) AS BIGINT) AS t FROM documents) GROUP BY lang",
    "dataset_audit": f"SELECT source, count(*) AS n, count(*) FILTER (p) AS has_problem, count(*) FILTER (b) AS has_boxed, count(*) FILTER ({_AUDIT}) AS in_word_range, round(100 * count(*) FILTER (p) / count(*), 1) AS has_problem_percent, round(100 * count(*) FILTER (b) / count(*), 1) AS has_boxed_percent, round(100 * count(*) FILTER ({_AUDIT}) / count(*), 1) AS in_word_range_percent FROM {_POOL} GROUP BY source",
    "pool_validity": f"SELECT source, count(*) AS n, count(*) FILTER (p AND b AND n > 100 AND n < 2000) AS valid FROM {_POOL} GROUP BY source",
    "extended_stages": f"SELECT source, CASE source WHEN 'math' THEN CASE WHEN l <= 2 THEN 1 WHEN l = 3 THEN 2 WHEN l = 4 THEN 3 ELSE 4 END WHEN 's1k' THEN 4 WHEN 'numina' THEN CASE WHEN k = 0 THEN 4 WHEN n < 150 THEN 1 WHEN n < 400 THEN 2 WHEN n < 800 THEN 3 ELSE 4 END WHEN 'stratos' THEN 5 WHEN 'openr1' THEN CASE WHEN n > 1000 THEN 4 ELSE 3 END ELSE 2 END::BIGINT AS stage, count(*) AS n FROM (SELECT {_KIND} AS source, doc_id % 3 AS k, CASE WHEN doc_id % 3 = 1 THEN doc_id % 6 ELSE 0 END AS l, {WORDS} AS n FROM documents) GROUP BY 1, 2",
    "allowed_labels": "SELECT source, CASE WHEN source IN (SELECT source FROM documents) THEN 'present' ELSE 'missing' END AS state FROM (VALUES ('src1'), ('src2'), ('src99'), ('src5'), ('nowhere')) AS t(source)",
    "missing_fields": "SELECT array_to_string(list_filter([CASE WHEN doc_id % 2 = 1 THEN 'lang' END, CASE WHEN doc_id % 3 <> 0 THEN 'source' END, 'title'], lambda x: x IS NOT NULL), ',') AS missing, count(*) AS n FROM documents GROUP BY 1",
    "flagged_first": "SELECT doc_id, lang FROM documents ORDER BY CASE WHEN contains(text, chr(10)) AND lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 ELSE 2 END, doc_id LIMIT 20",
    "next_slice": "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, floor(count(*) OVER () * 0.9::DOUBLE) AS s FROM documents) WHERE r >= s AND r < s + 7",
    "quota_shortage": "SELECT lang, w AS wanted, n AS have, w - n AS short FROM (SELECT lang, w, (SELECT count(*) FROM documents WHERE documents.lang = q.lang) AS n FROM (VALUES ('en', 30::BIGINT), ('fr', 20), ('xx', 5), ('es', 100000)) AS q(lang, w)) WHERE n < w",
    "running_acceptance": f"SELECT source, doc_id, seen, accepted FROM (SELECT source, doc_id, row_number() OVER w - 1 AS seen, CAST(coalesce(sum(CAST({_REASON} IS NULL AS INT)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS accepted FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE seen % 10 = 0",
}
QUERIES = {name: globals()[name] for name in ORACLES}
