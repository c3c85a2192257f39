"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a
shunting-yard parser reads the license expression after a tag.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters; a phrase counts where its words stand one after the
other. An expression after ``SPDX-License-Identifier:`` is parsed with
``with`` above ``and`` above ``or``; its identifiers become labels, and if it
cannot be parsed, the identifiers that stand before the fault still count. Each
expression is evaluated: ``permitted`` says whether the licences of an allow list
are enough for all of a text's expressions (one that cannot be parsed isn't
permitted), and is null for a text without one.

A null or empty text has no words, labels or places and the score 0. Repeated
rows get the same row each; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from . import common as C

#: Phrase: label. These are the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases: label and what one place of it is worth.
NOTICES = {
    "licensed under the apache license": ("apache", 0.9), "released under the mit license": ("mit", 0.9), "permission is hereby granted free of charge": ("mit", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9), "mozilla public license": ("mpl", 0.8), "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9), "creative commons attribution": ("cc-by", 0.8), "creative commons zero": ("cc0", 0.8), "isc license": ("isc", 0.8),
    "eclipse public license": ("epl", 0.8), "released into the public domain": ("public-domain", 0.8), "all rights reserved": ("proprietary", 0.5), "cc by nc": ("cc-by-nc", 0.8), "cc by sa": ("cc-by-sa", 0.8),
}
#: Families of licences that ``permitted`` allows, unless others are named.
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "zlib", "0bsd"})
BASE_WORTH, TAG_WORTH = 0.7, 0.95
TAG = "spdx license identifier"
# the expression ends with the line, or where the next tag begins
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\n\r]*?)(?=[\n\r]|\Z|spdx-license-identifier:)", re.I)
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: What may stand before an expression on its line.
_OPENING = " \t\"'`"
_RANK = {"or": 1, "and": 2, "with": 3}
#: Every ASCII byte that is in no word becomes a space; A-Z are lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"


class BadExpression(ValueError):
    """An expression that the grammar doesn't hold; ``ids`` are the identifiers before the fault."""

    def __init__(self, why: str, ids: list[str]):
        super().__init__(why)
        self.ids = ids


def parse(text: str) -> tuple[tuple | str, int]:
    """The tree of the expression at the start of a line, and where it ends: an identifier, or (operator, left, right), by Dijkstra's shunting yard.

    The expression goes on as long as the grammar can: behind a complete one, a word, a mark
    (as the end of a comment), a bracket too many or a full stop ends it, and the rest of the line is no part of it. A full
    stop at an identifier's end isn't its own.
    """
    out, ops, ids, operand = [], [], [], True
    at = end = len(text) - len(text.lstrip(_OPENING))

    def reduce() -> None:
        op, right, left = ops.pop(), out.pop(), out.pop()
        out.append((op, left, right))

    while m := _TOKEN.match(text, at):
        token = m[1].rstrip(".:") or m[1]
        word, stopped = token.lower(), len(token) < len(m[1])
        if word == "(":
            if not operand:
                break
            ops.append(token)
        elif word == ")":
            if operand:
                raise BadExpression("an identifier is missing", ids)
            if "(" not in ops:
                break
            while ops[-1] != "(":
                reduce()
            ops.pop()
        elif word in _RANK:
            if operand:
                raise BadExpression("an identifier is missing", ids)
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[word]:
                reduce()
            ops.append(word)
            operand = True
        else:
            if not operand:
                break
            out.append(token)
            if not ops or ops[-1] != "with":
                ids.append(token)
            operand = False
        at, end = m.end(), m.start(1) + len(token)
        if stopped:
            break
    if operand or "(" in ops:
        raise BadExpression("the expression ends early", ids)
    while ops:
        reduce()
    return out[0], end


def identifiers(tree: tuple | str) -> list[str]:
    """The licences of a tree; what stands after ``with`` is an exception, not a licence."""
    out, waiting = [], [tree]
    while waiting:  # long expressions make deep trees
        if isinstance(top := waiting.pop(), str):
            out.append(top)
        else:
            op, left, right = top
            waiting += [left] if op == "with" else [right, left]
    return out


def satisfied(tree: tuple | str, allowed: set[str] | frozenset[str]) -> bool:
    """Whether the licences of ``allowed`` (identifiers or families, in lower case) are enough for an expression."""
    values, waiting = [], [(tree, False)]
    while waiting:  # long expressions make deep trees
        top, ready = waiting.pop()
        if isinstance(top, str):
            values.append(top.lower() in allowed or label_of(top) in allowed)
        elif top[0] == "with":  # an exception only permits more
            waiting.append((top[1], False))
        elif not ready:
            waiting += [(top, True), (top[1], False), (top[2], False)]
        else:
            a, b = values.pop(), values.pop()
            values.append(a or b if top[0] == "or" else a and b)
    return values[0]


def label_of(identifier: str) -> str:
    """The family of an identifier: ``GPL-3.0-or-later`` is gpl."""
    return re.sub(r"(-(only|or-later|clause|[0-9][0-9.]*\+?))+$|\+$", "", identifier.lower()) or identifier.lower()


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str, phrases: ahocorasick.Automaton, allowed: set[str] | frozenset[str] = PERMISSIVE) -> tuple:
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    # every byte is one character, so that offsets count bytes
    flat = f" {b' '.join(words).decode('latin-1')} "
    base, labels, places, doubt, tagged = set(), set(), [], 1.0, False
    for end, phrase in phrases.iter(flat):
        if phrase in BASE:
            base.add(BASE[phrase])
            places.append(end - len(phrase))  # of the phrase's first character in flat, counted from 1 less the space before
            doubt *= 1 - BASE_WORTH
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
            doubt *= 1 - NOTICES[phrase][1]
        tagged |= phrase == TAG
    expressions, permitted = [], None
    for m in _TAG.finditer(text) if tagged else ():
        try:
            tree, stop = parse(m[1])
            ids, good = identifiers(tree), satisfied(tree, allowed)
        except BadExpression as e:
            ids, good, stop = e.ids, False, len(m[1])
        permitted = good and permitted is not False if ids else permitted
        if ids:
            expressions.append(m[1][:stop].strip(_OPENING))
            labels.update(map(label_of, ids))
            doubt *= 1 - TAG_WORTH
    first = last = None
    if places:
        first, last = (flat.count(" ", 0, p) - 1 for p in (min(places), max(places)))
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - doubt, expressions, permitted


def license_scan(docs: DataFrame, allowed: set[str] | frozenset[str] = PERMISSIVE) -> DataFrame:
    """One row for each document: its base places and labels, all labels, how sure they are (0 to 1), its expressions and whether ``allowed`` is enough for them."""
    names = [f.split()[0] for f in SCHEMA.split(", ")][1:]

    def work():
        phrases = _automaton()

        def each(part, texts):
            return {"doc_id": C.column(part, "doc_id")} | dict(zip(names, map(list, zip(*(scan(t, phrases, allowed) for t in texts), strict=True)), strict=True))

        return each

    return C.map_texts(docs.select("doc_id", "text"), SCHEMA, work)
