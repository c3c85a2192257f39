"""URL filters: a weighted vocabulary counted by an Aho-Corasick automaton, and allow/block rules.

Terms count only between boundaries, which are the ends of the url and all
characters but ASCII letters and digits. A url is rejected on one strict term
or when its distinct soft terms weigh ``soft_limit`` or more. A rule
``host/path`` fits its host and all subdomains if the path starts with the
rule's; the longest rule wins, and it overrides the vocabulary.

A null url, or one without ``://``, has an empty host and path; the vocabulary
still judges what text it has. Repeated urls are judged alike; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One of these rejects.
STRICT = ("casino", "porn", "porno", "sex", "viagra", "xxx")
#: These add up, each counted once.
SOFT = {"adult": 2, "bet": 1, "bonus": 1, "cheap": 1, "click": 1, "deal": 1, "deals": 1, "farm": 1, "free": 1, "hot": 1, "loan": 1, "loans": 1, "lottery": 2, "nude": 2, "pills": 2, "poker": 2, "promo": 1, "spam": 2, "win": 1, "winner": 1}
SOFT_LIMIT = 3
#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UP, _LOW)


def _automaton(strict: Iterable[str], soft: dict[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in strict:
        found.add_word(term, (term, -1))
    for term, weight in soft.items():
        found.add_word(term, (term, weight))
    if len(found):
        found.make_automaton()
    return found


def count_terms(url: str, terms: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Distinct strict terms, distinct soft terms and these terms' weight."""
    strict, soft, text = set(), {}, url.translate(_ASCII_LOWER)
    if not len(terms):
        return 0, 0, 0
    word = lambda c: c.isascii() and c.isalnum()
    for end, (term, weight) in terms.iter(text):
        start = end - len(term) + 1
        if (start and word(text[start - 1])) or (end + 1 < len(text) and word(text[end + 1])):
            continue
        if weight < 0:
            strict.add(term)
        else:
            soft[term] = weight
    return len(strict), len(soft), sum(soft.values())


def url_filter(pages: DataFrame, strict: Iterable[str] = STRICT, soft: dict[str, int] | None = None, soft_limit: int = SOFT_LIMIT, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """One row for each page: key, host, path, rule, verdict, n_strict, n_soft, soft_weight."""
    strict, soft = tuple(strict), dict(SOFT if soft is None else soft)

    @F.pandas_udf("n_strict long, n_soft long, soft_weight long")
    def counts(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = _automaton(strict, soft)
        for part in urls:
            yield pd.DataFrame([count_terms(u or "", terms) for u in part], columns=["n_strict", "n_soft", "soft_weight"])

    df = pages.select(F.col(key).alias(key), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    # the first :// and what follows it; DOTALL, so that line ends in an url are ordinary characters
    parse = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    df = df.withColumns({"host": F.translate(F.regexp_extract("_url", parse, 1), _UP, _LOW), "path": F.regexp_extract("_url", parse, 2)})
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    hit = F.coalesce(F.lit(None).cast("struct<verdict:string,rule:string>"), *[F.when(fits(h, p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered])
    df = df.withColumns({"_hit": hit, "_n": counts("_url")})
    own = F.when((F.col("_n.n_strict") >= 1) | (F.col("_n.soft_weight") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return df.select(key, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce(F.col("_hit.verdict"), own).alias("verdict"), "_n.n_strict", "_n.n_soft", "_n.soft_weight")


def oracle(strict: Iterable[str] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT, rules: Iterable[tuple[str, str, str]] = RULES) -> str:
    """The same in DuckDB's SQL, by a regular expression for each term."""
    edge = lambda t: rf"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    cases = lambda k: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if k else v}'" for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)))
    add = lambda xs: " + ".join(xs) or "0"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS raw, translate(coalesce(url, ''), '{_UP}', '{_LOW}') AS u FROM pages),
q AS (SELECT page_id, u,
  translate(regexp_extract(raw, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{_UP}', '{_LOW}') AS host,
  regexp_extract(raw, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path,
  {add(f"CAST({edge(t)} AS BIGINT)" for t in strict)} AS n_strict,
  {add(f"CAST({edge(t)} AS BIGINT)" for t in soft)} AS n_soft,
  {add(f"{w} * CAST({edge(t)} AS BIGINT)" for t, w in soft.items())} AS soft_weight FROM p)
SELECT page_id, host, path, CASE {cases(1)} END AS rule,
  CASE {cases(0)} WHEN n_strict >= 1 OR soft_weight >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft, CAST(soft_weight AS BIGINT) AS soft_weight FROM q"""
