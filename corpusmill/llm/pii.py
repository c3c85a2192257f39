"""PII: personal data by fixed shapes, and by contexts that are bootstrapped from them.

The base finds e-mail addresses, IPv4 addresses, card and phone numbers. These
are seeds, and so are tokens of the shape of a secret: long runs of hexadecimal
digits, the prefixes of well-known keys, signed tokens. A secret's shape alone is
no span (a checksum has it too); where its context is one of secrets, it is. The
words to the left and right of a seed are patterns; a pattern is
scored by how much of what it surrounds is known personal data of one kind, an
instance (an identifier-like token that no base span covers) by the patterns
around it; both scores are worked out in turn over the graph of patterns and
instances, which Spark holds as a table of edges and counts. Instances around
which patterns of high confidence stand become further spans.

Spans count code points, end exclusive. A null or empty text has none. Repeated
rows get the same row each (and count twice as evidence); rows with a null id
are scanned and returned too; an empty table gives an empty result; further
columns of the input are ignored. Identifiers outside the base are tokens of any
length and neighbouring groups with digits; what a longer further span covers is
no span of its own.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: The base's kinds, and the one that only the method adds.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = KINDS[:4]
#: The least length of an identifier-like token or of groups, and how far a context reaches.
SHORTEST, REACH = 5, 40
#: Kinds of what is found outside the base: evidence in the graph, or only a possible span.
UNKNOWN, AROUND = -1, -2
#: Rounds over the graph; a pattern's seeds at least; what makes a pattern and an instance sure.
ROUNDS, MIN_SEEDS, SURE_PATTERN, SURE_INSTANCE = 3, 4, 0.5, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts at the first digit of its run, as a later start fails where that does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IDENTIFYING = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+")
# what ends a token besides white space: quotes and angle brackets, which stand around identifiers and in none
_REST = re.compile(r"[^\s\"'`<>]*")
_BEFORE = re.compile(r"[\s\"'`<>]")
# Shapes of secrets.
_SECRET = re.compile(
    r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|sk-[0-9A-Za-z_-]{20,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]*"
)
_PART = "[A-Z]{0,4}[0-9][0-9A-Z]*+"
# groups with digits (an IBAN may have letters second), joined by blanks, hyphens or brackets
_CLOSED = rf"[(\[]{_PART}[)\]]"
_GROUPS = re.compile(rf"(?<![0-9A-Za-z_.@])(?:[A-Z]{{2}}[0-9]{{2}}[ -][A-Z]{{4}}|{_PART}|{_CLOSED})(?:[ -](?:{_PART}|{_CLOSED})|{_CLOSED}|(?<=[)\]]){_PART})+(?![0-9A-Za-z_@])")
_EDGE = "\"'`()[]{}<>,;:.!?#&*%$|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part is the run before it, but for what an earlier match took."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, taken := m.end()))
        at = text.find("@", max(at + 1, taken))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    out = [(EMAIL, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(IP, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((CARD, *m.span()))
    if "+" in text:
        out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an @ that no base span touches, without punctuation at their edges; white space, quotes and angle brackets end a token on both sides."""
    out, end, covered = [], 0, sorted((a, b) for _, a, b in spans)
    k = 0
    while m := _IDENTIFYING.search(text, end):
        start = at = m.start()
        while start > end and not _BEFORE.match(text, start - 1):
            start -= 1
        end = _REST.match(text, at).end()
        token = text[start:end]
        a = start + len(token) - len(token.lstrip(_EDGE))
        b = end - (len(token) - len(token.rstrip(_EDGE)))
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k < len(covered) and covered[k][0] < b:
            end = max(end, covered[k][1])
        elif SHORTEST <= b - a:
            out.append((a, b))
    return out


def groups(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Neighbouring groups with digits, as wholes, between the base spans."""
    out, start = [], 0
    for a, b in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        for m in _GROUPS.finditer(text, start, a) if start < a else ():
            if SHORTEST <= m.end() - m.start():
                out.append(m.span())
        start = max(start, b)
    return out


def unknown(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates, of which those that look like secrets are seeds, and groups; groups around a candidate aren't evidence, or it would count twice."""
    tokens = candidates(text, spans)
    out, have, k = [(SECRET if _SECRET.fullmatch(text, a, b) else UNKNOWN, a, b) for a, b in tokens], set(tokens), 0
    for a, b in groups(text, spans):
        while k < len(tokens) and tokens[k][1] <= a:
            k += 1
        if (a, b) not in have:
            out.append((AROUND if k < len(tokens) and tokens[k][0] < b else UNKNOWN, a, b))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The contexts of a span: two words to the left, one to each side, and one to the left with its punctuation."""
    left = text[max(0, start - REACH) : start]
    before = [w.lower() for w in _WORD.findall(left)][-2:]
    after = [w.lower() for w in _WORD.findall(text[end : end + REACH])[:1]]
    out = []
    if len(before) == 2:
        out.append("LL " + " ".join(before))
    if before:
        mark = re.sub(r"\s+", " ", left[left.lower().rfind(before[-1]) + len(before[-1]) :]) if before[-1] in left.lower() else ""
        out.append(f"LM {before[-1]}{mark}" if mark.strip() else f"L {before[-1]}")
    if before and after:
        out.append(f"LR {before[-1]} {after[0]}")
    return out


def shape(value: str) -> str:
    """What stands for an identifier in the graph: its digest, so that no personal data leaves its text."""
    return hashlib.blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


_FOUND = "doc_id long, spans array<struct<kind:int,start:long,end:long>>, base_sha256 string, found array<struct<kind:int,start:long,end:long,instance:string,patterns:array<string>>>"


def scan(docs: DataFrame) -> DataFrame:
    """The base spans of every text, and its seeds (kind 0 to 3), candidates (kind -1) and groups around these (kind -2) with their contexts."""

    def work():
        def each(part, texts):
            spans, digests, found = [], [], []
            for t in texts:
                s = base_spans(t)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in s])
                digests.append(hashlib.sha256(joined(s).encode()).hexdigest())
                both = s + unknown(t, s)
                found.append([{"kind": k, "start": a, "end": b, "instance": shape(t[a:b]), "patterns": patterns(t, a, b)} for k, a, b in both])
            return {"doc_id": C.column(part, "doc_id"), "spans": spans, "base_sha256": digests, "found": found}

        return each

    return C.map_texts(docs.select("doc_id", "text"), _FOUND, work)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: pattern, instance, kind (-1: not known), n. Gives (pattern, kind, sure) of patterns of high confidence.

    An instance's belief in a kind is 1 for a seed, else the noisy-or of its
    patterns' scores. A pattern's score is the belief of what it surrounds, by
    count, less what few examples are worth.
    """
    # a pattern no seed ever stood in can't gain a score in the first round, and only through shared instances later
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct()
    belief = seeds.withColumn("belief", F.lit(1.0))
    links = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n"))
    totals = links.groupBy("pattern").agg(F.sum("n").alias("total"), F.count("*").alias("instances"))
    scores = None
    for _ in range(rounds):
        scores = C.cut(
            links.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("belief") * F.col("n")).alias("mass"), F.sum("belief").alias("support"))
            .filter(F.col("support") >= MIN_SEEDS)
            .join(totals, "pattern")
            .select("pattern", "kind", (F.col("mass") / F.col("total") * (1 - 1 / (1 + F.col("support")))).alias("sure"))
            .filter(F.col("sure") >= SURE_PATTERN)
        )
        gained = links.join(scores, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))))).alias("belief"))
        belief = gained.join(seeds, ["instance"], "left_anti").unionByName(seeds.withColumn("belief", F.lit(1.0)))
    return scores


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row for each document: its base spans (``spans``), its further spans (``more``) and the digest of the base."""
    C.free_shuffles(docs.sparkSession)
    found = C.cut(scan(docs).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*").select("row", "kind", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    edges = C.cut(each.filter(F.col("kind") != AROUND).groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")))
    sure = score_graph(edges, rounds)
    # a secret's shape is evidence, but only a sure context makes it a span
    votes = each.filter((F.col("kind") < 0) | (F.col("kind") == SECRET)).select("row", "start", "end", "pattern").join(sure, "pattern")
    best = (
        votes.groupBy("row", "start", "end", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))))).alias("belief"))
        .filter(F.col("belief") >= SURE_INSTANCE)
        .groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
    )
    # a span inside a longer one goes
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("reach", F.max("end").over(before)).filter(F.col("reach").isNull() | (F.col("end") > F.col("reach")))
    more = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    empty = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    return found.select("row", "doc_id", "spans", "base_sha256").join(more, "row", "left").select("doc_id", "spans", "base_sha256", F.coalesce("more", empty).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base, its digest, and all spans as text."""
    text = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    every = F.array_join(F.transform(F.array_sort(F.concat("spans", "more")), text), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(BASE_KINDS)], "base_sha256", every.alias("spans"), F.size("more").cast("long").alias("n_more"))
