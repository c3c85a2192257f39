"""Scanners that one regular expression can't express: balanced boxes and commas outside brackets.

The functions work on one Python string; the ``*_udf`` forms are Arrow-batched.
All take a null for an empty string.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

_ANY_BOX = re.compile(r"\\f?box(?:ed)?\s*\{")
_BOX, _BRACE = re.compile(r"\\boxed\s*\{"), re.compile(r"[{}]")
_OPEN, _CLOSE = "([{", ")]}"


def box_spans(text: str, command: re.Pattern = _BOX) -> list[tuple[int, int, int]]:
    """(start of the command, start of the content, end of the content) of each box whose braces close; in one pass over the braces."""
    heads = [(m.start(), m.end()) for m in command.finditer(text)]
    if not heads:
        return []
    ends, waiting = {}, []
    for m in _BRACE.finditer(text, heads[0][1] - 1):
        if m[0] == "{":
            waiting.append(m.start())
        elif waiting:
            ends[waiting.pop()] = m.start()
    out, at = [], 0
    for start, a in heads:
        if start >= at and (b := ends.get(a - 1)) is not None:
            out.append((start, a, b))
            at = b + 1
    return out


def boxes(text: str | None) -> list[str]:
    text = text or ""
    return [text[a:b].strip() for _, a, b in box_spans(text)]


def last_boxes(text: str | None) -> list[str]:
    """The last group of boxes with nothing but blanks, commas or "and" between them."""
    text = text or ""
    spans = box_spans(text)
    group: list[tuple[int, int, int]] = []
    for span in reversed(spans):
        if group and re.sub(r"[\s,;$]|and", "", text[span[2] + 1 : group[-1][0]]):
            break
        group.append(span)
    return [text[a:b].strip() for _, a, b in reversed(group)]


def last_command(text: str | None) -> str | None:
    """The last ``\\boxed`` or ``\\fbox`` with its braces, if there is one that closes."""
    text = text or ""
    spans = box_spans(text, _ANY_BOX)
    return text[spans[-1][0] : spans[-1][2] + 1] if spans else None


def last_content(text: str | None) -> str | None:
    text = text or ""
    spans = box_spans(text, _ANY_BOX)
    return text[spans[-1][1] : spans[-1][2]] if spans else None


def unbox(text: str | None) -> str:
    """Each box is replaced by its content; one that doesn't close stays."""
    text, out, at = text or "", [], 0
    for start, a, b in box_spans(text):
        out += [text[at:start], unbox(text[a:b])]
        at = b + 1
    return "".join(out) + text[at:]


def drop_last_box(text: str | None) -> str:
    """Without a box at the very end."""
    text = text or ""
    spans = box_spans(text)
    return text[: spans[-1][0]].rstrip() if spans and not text[spans[-1][2] + 1 :].strip() else text


def split_commas(text: str | None) -> list[str]:
    """Parts between commas outside of brackets and quotes, trimmed; backslashes escape, empty parts go."""
    parts, part, stack, quote, escaped = [], [], [], "", False
    for c in text or "":
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif quote:
            quote = "" if c == quote else quote
        elif c == '"':
            quote = c
        elif c in _OPEN:
            stack.append(_CLOSE[_OPEN.index(c)])
        elif stack and c in _CLOSE:
            stack.pop()  # half-open intervals close with the other bracket
        elif c == "," and not stack:
            parts.append("".join(part))
            part = []
            continue
        part.append(c)
    return [p for p in (x.strip() for x in [*parts, "".join(part)]) if p]


def _lists(fn):
    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(fn)

    return run


def _strings(fn):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(fn)

    return run


def boxes_udf():
    return _lists(boxes)


def last_boxes_udf():
    return _lists(last_boxes)


def split_commas_udf():
    return _lists(split_commas)


def unbox_udf():
    return _strings(unbox)


def drop_last_box_udf():
    return _strings(drop_last_box)
