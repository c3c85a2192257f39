"""Queries on selection, joins, metrics and training data for reinforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import link, reward, select, stats
from .curation import WORDS, docs


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def graded(spark, d):
    """Labelled documents as evaluation rows: quality is the grade, a plain rule the other arm."""
    n = T.word_count("text").cast("long")
    return docs(spark, d).join(read(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("correct"), (F.col("lang") != "en").alias("is_mcq"), F.contains("text", F.lit("\n")).alias("is_multi"), n.alias("words"), (F.col("toxic") == 0).alias("format_ok"), ((n > 60) & ~F.rlike("text", F.lit("!!"))).alias("rule"))


def quality_metrics(spark, d):
    return graded(spark, d).groupBy("lang").agg(*stats.eval_metrics())


def overlapping_splits(spark, d):
    g = graded(spark, d)
    return stats.overlapping_splits(g, {"mcq": F.col("is_mcq"), "non_mcq": ~F.col("is_mcq"), "multi": F.col("is_multi"), "none": F.col("words") < 0})


def two_arm_delta(spark, d):
    return stats.two_arms(graded(spark, d), "correct", "rule", "lang")


def baseline_overlay(spark, d):
    g = graded(spark, d)
    out = link.overlay_compare(g.select("doc_id", "lang", "correct"), g.filter("is_multi").select("doc_id", "rule"), "doc_id", "rule")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("other_value").alias("other"), F.count_if(F.col("correct") & ~F.col("other_value")).alias("lost"))


def rollup_report(spark, d):
    out = stats.rolled_up(graded(spark, d), ["lang", "source"], "correct")
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "correct", "accuracy")


def heldout_anti(spark, d):
    held = read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return link.held_out(read(spark, d, "orders"), held, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def resume_split(spark, d):
    todo = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    done = read(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_orderkey").alias("key")).agg(F.count("*").alias("k"))
    have, left = link.resume(todo, done, "key")
    return have.agg(F.count("*").alias("n")).withColumn("part", F.lit("done")).unionByName(left.agg(F.count("*").alias("n")).withColumn("part", F.lit("todo")))


def overlay_latest(spark, d):
    e = read(spark, d, "events")
    part = lambda odd: e.filter(F.col("event_id") % 2 == odd).select(F.col("user_id").alias("key"), "event_id", "event_type")
    return link.overlay(part(0), part(1).filter("event_type = 'purchase'"), "key", "event_id")


def done_keys(spark, d):
    return read(spark, d, "events").select("event_id", link.done_key(F.lit("public"), F.col("user_id"), F.col("event_type")).alias("key")).groupBy("key").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).filter("n > 1")


def stratified_split(spark, d):
    counts = docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"))
    return select.largest_remainder(counts, "lang", 100)


def quota_sample(spark, d):
    return select.quotas(docs(spark, d), "lang", {"en": 30, "fr": 20, "de": 10, "xx": 5}, "11", "doc_id").select("doc_id", "lang")


def hash_sample(spark, d):
    return select.sample(docs(spark, d), 50, "3", "doc_id").select("doc_id")


def fraction_replay(spark, d):
    return select.fraction(docs(spark, d), "source", 0.1, "5", "doc_id").select("doc_id", "source")


def rank_slices(spark, d):
    return select.rank_slices(docs(spark, d).select("doc_id", "n_chars"), ["n_chars", "doc_id"], {"low": (0.0, 0.4), "middle": (0.4, 0.9)})


def cyclic_anchors(spark, d):
    return select.repeat_cyclic(read(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 60)


def curriculum_sample(spark, d):
    parts = read(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("level"))
    return select.curriculum(parts, "p_partkey", "level", 20, 8, "9").groupBy("step", "level").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def stream_mix(spark, d):
    return select.mix_streams(read(spark, d, "events").select("event_id"), "event_id", 500, 0.1, 0.5, "mix").groupBy("stream").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("stream", F.col("stream").cast("long"))


def pass_rate_bands(spark, d):
    tries = read(spark, d, "events").select("user_id", (F.col("event_type") == "purchase").alias("ok"), (F.col("event_id") % 7).alias("g"))
    return stats.pass_band(tries.withColumn("key", F.col("user_id") * 7 + F.col("g")), "key", "ok").groupBy("band").agg(F.count("*").alias("n"), F.sum("passed").alias("passed"))


def level_distribution(spark, d):
    level = stats.difficulty_level((F.col("p_size") / 5).cast("double"))
    return stats.zero_filled(read(spark, d, "part").select(level.alias("level")).filter("level is not null"), "level", 1, 6).select(F.col("level").cast("long").alias("level"), "n")


def candidates_accepted(spark, d):
    rows = select.expand(read(spark, d, "part").select("p_partkey", "p_size"), 4).filter((F.col("p_size") + F.col("candidate") * 7 + F.col("p_partkey")) % 5 == 0)
    return link.first_by(rows, ["p_partkey"], "candidate").select("p_partkey", F.col("candidate").cast("long").alias("candidate"))


def rank_checkpoints(spark, d):
    m = read(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), 2).alias("metric"), F.count("*").alias("n"))
    w = Window.orderBy(F.col("metric").desc_nulls_last(), F.col("n").desc(), "c_nationkey")
    return m.withColumn("rank", F.row_number().over(w).cast("long"))


def group_topk(spark, d):
    w = Window.partitionBy("l_returnflag").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")
    return read(spark, d, "lineitem").withColumn("nth", F.row_number().over(w)).filter("nth <= 5").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("nth").cast("long").alias("nth"))


def json_props(spark, d):
    e = read(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "k int")["k"].alias("j"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.sum("j").alias("sum_j"))


def chat_render(spark, d):
    """A conversation as one text; it must fit a row, as the text does."""
    turn = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    return rows.select("conv_id", F.size("ts").cast("long").alias("turns"), F.md5(F.array_join(F.transform("ts", lambda x: x["t"]), "")).alias("digest"))


def label_mask(spark, d):
    """Token ids by word, masked where the turn isn't the assistant's."""
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", T.word_count("text").alias("k"))
    ids = F.sequence(F.lit(1), F.greatest("k", F.lit(1)))
    masked = F.when(F.col("role") == "assistant", ids).otherwise(F.array_repeat(F.lit(-100), F.greatest("k", F.lit(1))))
    return rows.select("conv_id", "turn", F.size(masked).cast("long").alias("size"), F.aggregate(masked, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum"))


def first_messages(spark, d):
    first = lambda role: F.md5(F.coalesce(F.min_by("text", F.when(F.col("role") == role, F.col("turn"))), F.lit("")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(first("user").alias("asked"), first("assistant").alias("answered"))


def looked_up(spark, d):
    """Lookups that keep, must have and drop misses."""
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    side = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    some = side.filter("c_nationkey < 10")
    parts = {"left": link.lookup(orders, some, "c_custkey"), "all": link.lookup_all(orders, side, "c_custkey"), "inner": orders.join(some, "c_custkey")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n"), F.count("c_nationkey").alias("found")).withColumn("kind", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def zipped_rows(spark, d):
    a = read(spark, d, "nation").select("n_nationkey", "n_name")
    b = read(spark, d, "nation").select(F.col("n_name").alias("other"), (-F.col("n_nationkey")).alias("back"))
    return link.zip_by_position(a, b, "n_nationkey", "back").select("n_nationkey", "n_name", "other")


def grouped_members(spark, d):
    """Each line of an order with all line numbers of the order."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    out = link.with_group(rows, ["l_orderkey"], "l_linenumber", "numbers")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"))


def latest_parts(spark, d):
    """Final rows before partial ones; rows without a key are counted."""
    e = read(spark, d, "events").select(F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("key"), "event_type", "event_id")
    one = lambda kind: e.filter(F.col("event_type") == kind).groupBy("key").agg(F.min("event_id").alias("event_id"))
    known, counts = link.latest_counts([one("purchase"), one("click"), one("view")], "key")
    return known.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).crossJoin(counts)  # one row each


def anti_by_key(spark, d):
    done = read(spark, d, "events").filter("event_type = 'purchase'").select(link.done_key(F.lit("public"), F.col("user_id"), F.lit("view")).alias("key"))
    todo = read(spark, d, "events").filter("event_type = 'view'").withColumn("key", link.done_key(F.lit("public"), F.col("user_id"), F.col("event_type")))
    return link.held_out(todo, done, "key").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _scored(spark, d):
    mode = F.when(F.col("words") % 11 == 0, "timeout").when(F.col("words") % 13 == 0, "error:ValueError").when(F.col("rule") & ~F.col("correct"), "prose_fallback").when(F.col("correct"), "strict_correct").otherwise("unrescued")
    return graded(spark, d).withColumn("mode", mode).withColumn("ok", F.col("correct") | (F.col("mode") == "prose_fallback"))


def failure_breakdown(spark, d):
    return stats.failure_modes(_scored(spark, d), "correct", "ok", "mode")


def file_reports(spark, d):
    out = stats.file_reports(_scored(spark, d), "lang", "correct", "ok")
    return out.withColumn("lang", F.coalesce("lang", F.lit("all")))


def merged_counts(spark, d):
    per = _scored(spark, d).groupBy("source", "mode").agg(F.count("*").alias("n")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("mode", "n"))).alias("counts"))
    return stats.merge_counts(per, "counts")


def format_crosstab(spark, d):
    """Lengths by format and grade."""
    bucket = F.when(F.col("words") < 100, "short").when(F.col("words") < 400, "middle").otherwise("long")
    return graded(spark, d).groupBy(bucket.alias("bucket"), "format_ok", "correct").agg(F.count("*").alias("n"))


def option_histogram(spark, d):
    """How many rows have 0, 1, ... 6 lines or commas, 7 standing for more."""
    count = lambda mark: F.least(F.regexp_count("text", F.lit(mark)), F.lit(7)).cast("long")
    marks = docs(spark, d).select(F.explode(F.array(F.struct(F.lit("commas").alias("kind"), count(",").alias("k")), F.struct(F.lit("questions").alias("kind"), count(r"\?").alias("k")))).alias("x"))
    return marks.groupBy("x.kind", "x.k").agg(F.count("*").alias("n"))


def eval_rows(spark, d):
    """Type tags of evaluation rows, and the accuracy of each with the total."""
    rows = graded(spark, d).select("correct", F.when(F.col("is_mcq"), "mcq").when(F.col("is_multi"), "multi").otherwise("single").alias("kind"))
    return stats.rolled_up(rows, ["kind"], "correct").withColumn("kind", F.coalesce("kind", F.lit("all")))


def accepted_per_batch(spark, d):
    """The first accepted candidate of each row in each batch."""
    rows = select.expand(read(spark, d, "part").select("p_partkey", "p_size"), 6).withColumn("batch", F.floor((F.col("candidate") - 1) / 2))
    good = rows.filter((F.col("p_size") + F.col("candidate") * 5 + F.col("p_partkey")) % 3 == 0)
    return link.first_by(good, ["batch", "p_partkey"], "candidate").groupBy("batch").agg(F.count("*").alias("n"), F.sum("candidate").alias("candidates"))


def tag_rates(spark, d):
    """Shares of tags by windows of 1000 steps."""
    e = read(spark, d, "events")
    flag = lambda k, t: F.when(F.col("event_id") % k == 0, t)
    tags = F.array_compact(F.array(flag(2, "correct"), flag(3, "ideal_box"), flag(5, "clipped"), flag(7, "mcq_letter"), F.when(F.col("event_id") % 2 == 1, "wrong")))
    kind = F.when(F.col("event_type") == "view", "mcq").when(F.col("event_type") == "click", "multi").otherwise("single")
    out = reward.tag_rates(e.select("event_id", F.round("value", 2).alias("value"), tags.alias("tags"), kind.alias("kind")), "event_id", "value", "tags", "kind", 1000)
    return out.select("window", "completions", F.round("mean", 4).alias("mean"), "correct_rate", "wrong_rate", "clipped_rate", "scattered_box_rate", "mcq_count", "mcq_correct_rate", "multi_count", "multi_ideal_box_rate", "single_clipped_rate", "mcq_letter_among_mcq_rate")


def cumulative_rewards(spark, d):
    out = reward.cumulative(read(spark, d, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents")), "event_id", "cents", 200)
    return out.select("n", F.floor("mean").alias("mean"))


def cyclic_stream(spark, d):
    mixed = select.mix_streams(read(spark, d, "events").select("event_id"), "event_id", 500, 0.1, 0.5, "mix")
    return select.cyclic_items(mixed, "event_id", read(spark, d, "nation"), "n_nationkey", "13").select("event_id", "n_nationkey")


def layer_weights(spark, d):
    """Vectors as the tensors of layers and others, moved towards their doubles."""
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("model.layers."), F.col("vec_id") % 8, F.lit(".w"), F.col("vec_id"))).otherwise(F.concat(F.lit("head.w"), F.col("vec_id")))
    base = read(spark, d, "embeddings").select(name.alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("values"), "vec_id")
    tuned = base.filter("vec_id % 5 <> 0").select("name", F.transform("values", lambda x: x * 2).alias("values"))
    out = stats.interpolated_weights(base.select("name", "values"), tuned, 8, 0.2, 0.9, 0.5)
    return out.select("name", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def reward_windows(spark, d):
    e = read(spark, d, "events").select("event_id", "event_type", F.round("value", 2).alias("value"))
    out = reward.windows(e, "event_id", "value", "event_type", 1000)
    return out.withColumn("mean_reward", F.round("mean_reward", 4))


def flat_stop(spark, d):
    per = read(spark, d, "events").groupBy(F.floor(F.col("event_id") / 25).alias("step")).agg(F.round(F.avg("value"), 4).alias("mean"))
    return reward.flat(per, "step", "mean", 9, 20.0)


def stop_rules(spark, d):
    e = read(spark, d, "events").select("event_id", reward.stop_reason(F.col("event_id") % 4 == 0, F.col("value") / 5, F.col("event_id") % 9000).alias("reason"))
    return e.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


_H = lambda seed, key="doc_id": f"md5('{seed}:' || {key})"
_U = lambda x: f"(('0x' || substr(md5({x}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_G = f"(SELECT doc_id, lang, source, quality = 1 AS correct, lang <> 'en' AS is_mcq, contains(text, chr(10)) AS is_multi, {WORDS} AS words, toxic = 0 AS format_ok, {WORDS} > 60 AND NOT contains(text, '!!') AS rule FROM documents JOIN labels USING (doc_id))"
_TRIES = "SELECT user_id * 7 + event_id % 7 AS key, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1"
ORACLES = {
    "quality_metrics": f"SELECT lang, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, count(*) FILTER (correct) AS correct, round(avg(correct::INT) FILTER (is_mcq), 6) AS mcq_accuracy, count(*) FILTER (is_mcq) AS mcq_total, round(avg(correct::INT) FILTER (is_multi), 6) AS multi_accuracy, count(*) FILTER (is_multi) AS multi_total, round(avg(words), 6) AS avg_words, round(avg(format_ok::INT), 6) AS format_rate FROM {_G} GROUP BY lang",
    "overlapping_splits": " UNION ALL ".join(f"SELECT '{k}' AS split, count(*) AS n, count(*) FILTER (correct) AS correct, coalesce(round(avg(correct::INT), 6), 0.0) AS accuracy FROM {_G} WHERE {c}" for k, c in {"mcq": "is_mcq", "non_mcq": "NOT is_mcq", "multi": "is_multi", "none": "words < 0"}.items()),
    "two_arm_delta": f"SELECT lang, count(*) AS n, round(avg(correct::INT), 6) AS base, round(avg(rule::INT), 6) AS other, round(avg(rule::INT) - avg(correct::INT), 6) AS delta, count(*) FILTER (rule AND NOT correct) AS gained, count(*) FILTER (correct AND NOT rule) AS lost FROM {_G} GROUP BY lang",
    "baseline_overlay": f"SELECT lang, count(*) AS n, count(*) FILTER (is_multi AND rule) AS other, count(*) FILTER (correct AND NOT (is_multi AND rule)) AS lost FROM {_G} GROUP BY lang",
    "rollup_report": f"SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 6) AS accuracy FROM {_G} GROUP BY ROLLUP (lang, source)",
    "heldout_anti": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "resume_split": "SELECT count(*) AS n, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'done' ELSE 'todo' END AS part FROM orders GROUP BY 2",
    "overlay_latest": "SELECT key, event_id, event_type FROM (SELECT user_id AS key, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY 1 - event_id % 2, event_id) AS r FROM events WHERE event_id % 2 = 0 OR event_type = 'purchase') WHERE r = 1",
    "done_keys": "SELECT 'public:' || user_id || ':' || event_type AS key, min(event_id) AS first, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "stratified_split": "SELECT lang, n, CAST(f + CAST(row_number() OVER (ORDER BY x - f DESC, lang) <= 100 - sum(f) OVER () AS INT) AS BIGINT) AS quota FROM (SELECT lang, count(*) AS n, 100 * count(*) / sum(count(*)) OVER () AS x, floor(100 * count(*) / sum(count(*)) OVER ()) AS f FROM documents GROUP BY lang)",
    "quota_sample": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H('11')}, doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 20 WHEN 'de' THEN 10 WHEN 'xx' THEN 5 ELSE 0 END",
    "hash_sample": f"SELECT doc_id FROM documents ORDER BY {_H('3')}, doc_id LIMIT 50",
    "fraction_replay": f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H('5')}, doc_id) AS r, greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.1::DOUBLE)) AS w FROM documents) WHERE r <= w",
    "rank_slices": "SELECT doc_id, n_chars, CASE WHEN r < floor(n * 0.4::DOUBLE) THEN 'low' ELSE 'middle' END AS slice FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r < floor(n * 0.9::DOUBLE)",
    "cyclic_anchors": "SELECT n_nationkey, n_name, i AS anchor_index FROM range(60) AS t(i) JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS p, count(*) OVER () AS c FROM nation) ON i % c = p",
    "curriculum_sample": f"WITH p AS (SELECT p_partkey, p_size % 5 + 1 AS level, row_number() OVER (PARTITION BY p_size % 5 + 1 ORDER BY {_H('9', 'p_partkey')}, p_partkey) - 1 AS r, count(*) OVER (PARTITION BY p_size % 5 + 1) AS c FROM part), s AS (SELECT DISTINCT level, c FROM p), w AS (SELECT step, level, c, c * greatest((1 - t) * level + t * (6.0::DOUBLE - level), 1e-6) AS w FROM (SELECT i AS step, least(i / 19.0::DOUBLE, 1.0) AS t FROM range(20) AS q(i)), s), h AS (SELECT step, level, c, sum(w) OVER (PARTITION BY step ORDER BY level) AS hi, w, sum(w) OVER (PARTITION BY step) AS a FROM w), z AS (SELECT i // 8 AS step, {_U("'9:' || (i // 8) || ':' || (i % 8)")} AS u, {_U("'9:' || (i // 8) || ':' || (i % 8) || ':item'")} AS v FROM range(160) AS q(i)) SELECT z.step, p.level, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM z JOIN h ON z.step = h.step AND u >= (hi - w) / a AND u < hi / a JOIN p ON p.level = h.level AND p.r = CAST(floor(v * h.c) AS BIGINT) GROUP BY 1, 2",
    "stream_mix": f"SELECT CAST(CASE WHEN {_U(chr(39) + 'mix:' + chr(39) + ' || event_id')} < 0.1::DOUBLE + (0.5::DOUBLE - 0.1::DOUBLE) * least(event_id / 500.0::DOUBLE, 1.0) THEN 2 ELSE 1 END AS BIGINT) AS stream, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1",
    "pass_rate_bands": f"SELECT CASE WHEN p = 0 THEN 'too_hard' WHEN p = n THEN 'too_easy' ELSE 'kept' END AS band, count(*) AS n, CAST(sum(p) AS BIGINT) AS passed FROM ({_TRIES}) GROUP BY 1",
    "level_distribution": "SELECT i AS level, count(x) AS n FROM range(1, 7) AS t(i) LEFT JOIN (SELECT CASE WHEN s BETWEEN 9 AND 10 THEN 1 WHEN s BETWEEN 7 AND 8 THEN 2 WHEN s = 6 THEN 3 WHEN s = 5.5 THEN 4 WHEN s = 5 THEN 5 END AS x FROM (SELECT p_size / 5 AS s FROM part)) ON x = i GROUP BY i",
    "candidates_accepted": "SELECT p_partkey, min(c) AS candidate FROM part, range(1, 5) AS t(c) WHERE (p_size + c * 7 + p_partkey) % 5 = 0 GROUP BY 1",
    "rank_checkpoints": "SELECT *, row_number() OVER (ORDER BY metric DESC NULLS LAST, n DESC, c_nationkey) AS rank FROM (SELECT c_nationkey, round(avg(c_acctbal) FILTER (c_acctbal > 0), 2) AS metric, count(*) AS n FROM customer GROUP BY 1)",
    "group_topk": "SELECT l_returnflag, l_orderkey, l_linenumber, nth FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth <= 5",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS sum_k, CAST(sum(k) AS BIGINT) AS sum_j FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "chat_render": "SELECT conv_id, count(*) AS turns, md5(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "label_mask": r"SELECT conv_id, turn, greatest(k, 1) AS size, CASE WHEN role = 'assistant' THEN greatest(k, 1) * (greatest(k, 1) + 1) // 2 ELSE -100 * greatest(k, 1) END AS sum FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS k FROM conversations)",
    "first_messages": "SELECT conv_id, md5(coalesce(arg_min(text, turn) FILTER (role = 'user'), '')) AS asked, md5(coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '')) AS answered FROM conversations GROUP BY 1",
    "reward_windows": "SELECT w AS \"window\", event_type, n, round(n / sum(n) OVER (PARTITION BY w), 6) AS share, round(sum(r) OVER (PARTITION BY w) / sum(n) OVER (PARTITION BY w), 4) AS mean_reward FROM (SELECT event_id // 1000 AS w, event_type, count(*) AS n, sum(round(value, 2)) AS r FROM events GROUP BY 1, 2)",
    "flat_stop": "SELECT step, mean, count(mean) OVER w >= 9 AND max(mean) OVER w - min(mean) OVER w < 20.0 AS flat FROM (SELECT event_id // 25 AS step, round(avg(value), 4) AS mean FROM events GROUP BY 1) WINDOW w AS (ORDER BY step ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)",
    "stop_rules": "SELECT CASE WHEN event_id % 9000 > 7000 THEN 'length' WHEN value / 5 > 10 THEN 'kl' WHEN event_id % 4 = 0 THEN 'flat' ELSE 'none' END AS reason, count(*) AS n FROM events GROUP BY 1",
}
_MODES = f"(SELECT *, correct OR mode = 'prose_fallback' AS ok FROM (SELECT *, CASE WHEN words % 11 = 0 THEN 'timeout' WHEN words % 13 = 0 THEN 'error:ValueError' WHEN rule AND NOT correct THEN 'prose_fallback' WHEN correct THEN 'strict_correct' ELSE 'unrescued' END AS mode FROM {_G}))"
_REPORT = "count(*) AS n, count(*) FILTER (correct) AS strict_correct, count(*) FILTER (ok) AS capability_correct, count(*) FILTER (ok AND NOT correct) AS rescued, round(avg(correct::INT), 6) AS strict_accuracy, round(avg(ok::INT), 6) AS capability_accuracy"
_RATE = lambda c, of="true": f"round(count(*) FILTER (({c}) AND ({of})) / greatest(count(*) FILTER ({of}), 1), 6)"
ORACLES |= {
    "looked_up": "SELECT kind, CASE kind WHEN 'inner' THEN f ELSE n END AS n, CASE kind WHEN 'all' THEN n ELSE f END AS found FROM (SELECT count(*) AS n, count(*) FILTER (c_nationkey < 10) AS f FROM orders JOIN customer ON o_custkey = c_custkey), (VALUES ('left'), ('all'), ('inner')) AS t(kind)",
    "zipped_rows": "SELECT a.n_nationkey, a.n_name, b.n_name AS other FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY -n_nationkey) AS r FROM nation) b USING (r)",
    "grouped_members": "SELECT l_orderkey, l_linenumber, string_agg(l_linenumber, ',' ORDER BY l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS numbers FROM lineitem",
    "latest_parts": "WITH e AS (SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS key, event_type, event_id FROM events), p AS (SELECT key, min(event_id) AS id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS part FROM e WHERE event_type IN ('purchase', 'click', 'view') GROUP BY key, event_type) SELECT (SELECT count(DISTINCT key) FROM p) AS n, (SELECT CAST(sum(id) AS BIGINT) FROM (SELECT arg_min(id, part) AS id FROM p WHERE key IS NOT NULL GROUP BY key)) AS ids, (SELECT count(*) FROM p WHERE key IS NULL) AS bad, (SELECT count(key) - count(DISTINCT key) FROM p) AS hidden",
    "anti_by_key": "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "failure_breakdown": f"SELECT mode, count(*) AS n FROM {_MODES} WHERE (ok AND NOT correct) OR starts_with(mode, 'error:') OR mode = 'timeout' GROUP BY mode",
    "file_reports": f"SELECT lang, {_REPORT} FROM {_MODES} GROUP BY lang UNION ALL SELECT 'all', {_REPORT} FROM {_MODES}",
    "merged_counts": f"SELECT mode AS label, count(*) AS n FROM {_MODES} GROUP BY mode",
    "format_crosstab": f"SELECT CASE WHEN words < 100 THEN 'short' WHEN words < 400 THEN 'middle' ELSE 'long' END AS bucket, format_ok, correct, count(*) AS n FROM {_G} GROUP BY ALL",
    "option_histogram": "SELECT kind, k, count(*) AS n FROM (SELECT 'commas' AS kind, least(length(text) - length(replace(text, ',', '')), 7) AS k FROM documents UNION ALL SELECT 'questions', least(length(text) - length(replace(text, '?', '')), 7) FROM documents) GROUP BY kind, k",
    "eval_rows": f"SELECT coalesce(kind, 'all') AS kind, count(*) AS n, count(*) FILTER (correct) AS correct, round(avg(correct::INT), 6) AS accuracy FROM (SELECT correct, CASE WHEN is_mcq THEN 'mcq' WHEN is_multi THEN 'multi' ELSE 'single' END AS kind FROM {_G}) GROUP BY ROLLUP (kind)",
    "accepted_per_batch": "SELECT b AS batch, count(*) AS n, CAST(sum(c) AS BIGINT) AS candidates FROM (SELECT (c - 1) // 2 AS b, p_partkey, min(c) AS c FROM part, range(1, 7) AS t(c) WHERE (p_size + c * 5 + p_partkey) % 3 = 0 GROUP BY 1, 2) GROUP BY 1",
    "tag_rates": "SELECT w AS \"window\", count(*) AS completions, round(avg(value), 4) AS mean, " + ", ".join(f"{_RATE(c)} AS {k}_rate" for k, c in {"correct": "i % 2 = 0", "wrong": "i % 2 = 1", "clipped": "i % 5 = 0", "scattered_box": "false"}.items()) + f", count(*) FILTER (k = 'view') AS mcq_count, {_RATE('i % 2 = 0', 'k = ' + chr(39) + 'view' + chr(39))} AS mcq_correct_rate, count(*) FILTER (k = 'click') AS multi_count, {_RATE('i % 3 = 0', 'k = ' + chr(39) + 'click' + chr(39))} AS multi_ideal_box_rate, {_RATE('i % 5 = 0', 'k NOT IN (' + chr(39) + 'view' + chr(39) + ', ' + chr(39) + 'click' + chr(39) + ')')} AS single_clipped_rate, {_RATE('i % 7 = 0', 'k = ' + chr(39) + 'view' + chr(39))} AS mcq_letter_among_mcq_rate FROM (SELECT event_id // 1000 AS w, event_id AS i, event_type AS k, round(value, 2) AS value FROM events) GROUP BY w",
    "cumulative_rewards": "SELECT n, CAST(floor(s / n) AS BIGINT) AS mean FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, sum(round(value * 100)::BIGINT) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE n % 200 = 0",
    "cyclic_stream": f"WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events WHERE {_U(chr(39) + 'mix:' + chr(39) + ' || event_id')} < 0.1::DOUBLE + (0.5::DOUBLE - 0.1::DOUBLE) * least(event_id / 500.0::DOUBLE, 1.0)) SELECT event_id, n_nationkey FROM s JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY {_H('13', 'n_nationkey')}, n_nationkey) - 1 AS p, count(*) OVER () AS c FROM nation) ON r % c = p",
    "layer_weights": "SELECT CASE WHEN vec_id % 3 = 0 THEN 'model.layers.' || (vec_id % 8) || '.w' || vec_id ELSE 'head.w' || vec_id END AS name, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * (1 + CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 3 = 0 THEN 0.9::DOUBLE + (vec_id % 8) / 7.0::DOUBLE * (0.2::DOUBLE - 0.9::DOUBLE) ELSE 0.5::DOUBLE END))), 4) AS total FROM embeddings",
}
QUERIES = {name: globals()[name] for name in ORACLES}
