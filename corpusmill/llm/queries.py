"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shared import new_dir
from . import license as licenses
from . import conversations, decontaminate, jaccard, linededup, pii, prefixtrie, quality, sentencepiece, suffixes, tokenfile, toxicity, urlfilter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.line_dedup(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op11_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, since the rows are read from them."""
    import public_tokenizers

    path = new_dir(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return tokenfile.read(spark, path)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.structure_report(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_url_filter, op4_pii, op5_license_scan, op6_sentencepiece, op7_jaccard_join, op8_quality_rules, op9_toxicity, op10_suffix_dedup, op11_token_blocks, op12_structure_repair, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op2_line_dedup": linededup.oracle(), "op3_url_filter": urlfilter.oracle(), "op12_structure_repair": conversations.oracle(), "op13_prefix_trie": prefixtrie.oracle()}
