r"""Balanced boxes, Column to Column: braces are paired by one fold over the pieces between them.

``\boxed{...}`` counts if its braces close. Of nested boxes the outer one is a box of the
text; the inner ones belong to its content. The fold keeps a stack of the braces that wait
for their end; it takes time in proportion to the braces times the depth of nesting.
A null text has no boxes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, _c, trim

BOXED, ANY_BOX = r"\\boxed\s*$", r"\\f?box(?:ed)?\s*$"
_SPAN = "struct<start:int,a:int,b:int>"
#: What may stand between boxes of one group.
BETWEEN = r"[\s,;$]|and"


def all_spans(x: ColumnLike, command: str = BOXED) -> Column:
    """array of struct(start of the command, start of the content, end of the content), from 0, of every box that closes, nested ones too, in the order of their ends."""
    t = F.coalesce(_c(x), F.lit(""))
    pieces = F.split(t, r"[{}]", -1)
    marks = F.concat(F.regexp_extract_all(t, F.lit(r"([{}])"), F.lit(1)), F.array(F.lit("")))
    start = F.expr(f"named_struct('at', 0, 'stack', CAST(array() AS ARRAY<STRUCT<start:INT,a:INT>>), 'out', CAST(array() AS ARRAY<{_SPAN}>))")

    def step(acc: Column, p: Column) -> Column:
        here = acc["at"] + F.length(p["piece"])
        stack, top = acc["stack"], F.get(acc["stack"], F.lit(0))
        head = F.length(F.regexp_extract(p["piece"], f"({command})", 1))
        opened = F.array_prepend(stack, F.struct(F.when(head > 0, here - head).otherwise(-1).alias("start"), (here + 1).alias("a")))
        closed = F.array_append(acc["out"], F.struct(top["start"].alias("start"), top["a"].alias("a"), here.alias("b")))
        box = (p["mark"] == "}") & F.coalesce(top["start"] >= 0, F.lit(False))
        return F.struct((here + 1).alias("at"), F.when(p["mark"] == "{", opened).otherwise(F.slice(stack, F.lit(2), F.size(stack))).alias("stack"), F.when(box, closed).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.zip_with(pieces, marks, lambda a, b: F.struct(a.alias("piece"), b.alias("mark"))), start, step, lambda acc: acc["out"])
    return F.when(F.rlike(t, F.lit(command.removesuffix("$") + r"\{")), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def spans(x: ColumnLike, command: str = BOXED) -> Column:
    """Those of ``all_spans`` that stand in no other one, in the order of the text."""
    every = all_spans(x, command)
    return _outer(every)


def _outer(every: Column) -> Column:
    """Boxes end in turn, so an outer box follows the ones inside it: one pass from the last end backwards keeps what begins after all that was kept."""
    start = F.expr(f"CAST(array() AS ARRAY<{_SPAN}>)")
    keep = lambda acc, s: F.when((F.size(acc) == 0) | (s["b"] < F.get(acc, F.lit(0))["start"]), F.array_prepend(acc, s)).otherwise(acc)
    return F.aggregate(F.reverse(every), start, keep)


def _inside(t: Column, s: Column) -> Column:
    return F.substring(t, s["a"] + 1, s["b"] - s["a"])


def boxes(x: ColumnLike) -> Column:
    """The boxes' contents, trimmed."""
    return F.transform(spans(x), lambda s: trim(_inside(_c(x), s)))


def last_boxes(x: ColumnLike) -> Column:
    """The last group of boxes with nothing but blanks, commas or "and" between them."""
    t = _c(x)
    start = F.expr(f"CAST(array() AS ARRAY<{_SPAN}>)")

    def grouped(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        gap = F.substring(t, last["b"] + 2, s["start"] - last["b"] - 1)
        apart = (F.size(acc) == 0) | (F.regexp_replace(gap, BETWEEN, "") != "")
        return F.when(apart, F.array(s)).otherwise(F.array_append(acc, s))

    return F.transform(F.aggregate(spans(x), start, grouped), lambda s: trim(_inside(t, s)))


def last_command(x: ColumnLike) -> Column:
    r"""The last ``\boxed``, ``\box`` or ``\fbox`` with its braces; null if none closes."""
    s = F.get(F.reverse(spans(x, ANY_BOX)), F.lit(0))
    return F.substring(_c(x), s["start"] + 1, s["b"] - s["start"] + 1)


def last_content(x: ColumnLike) -> Column:
    s = F.get(F.reverse(spans(x, ANY_BOX)), F.lit(0))
    return _inside(_c(x), s)


def unbox(x: ColumnLike) -> Column:
    """Each box, nested ones too, is replaced by its content; one that doesn't close stays. Null in, empty out."""
    t = F.coalesce(_c(x), F.lit(""))
    cuts = F.array_sort(F.flatten(F.transform(all_spans(x), lambda s: F.array(F.struct(s["start"].alias("from"), s["a"].alias("to")), F.struct(s["b"].alias("from"), (s["b"] + 1).alias("to"))))))
    start = F.expr("named_struct('out', '', 'at', 0)")
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, c["from"] - acc["at"])).alias("out"), c["to"].alias("at"))
    return F.aggregate(cuts, start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))


def drop_last_box(x: ColumnLike) -> Column:
    """Without a box at the very end. Null in, empty out."""
    t = F.coalesce(_c(x), F.lit(""))
    s = F.get(F.reverse(spans(x)), F.lit(0))
    last = (s["start"] >= 0) & (trim(F.substring(t, s["b"] + 2, F.length(t))) == "")
    return F.when(F.coalesce(last, F.lit(False)), F.regexp_replace(F.substring(t, F.lit(1), s["start"]), r"\s+$", "")).otherwise(t)


_OPEN, _CLOSE = "([{", ")]}"


def split_commas(x: ColumnLike, brackets: str = _OPEN, quotes: bool = True, escapes: bool = True, keep_empty: bool = False) -> Column:
    """Parts between commas outside of ``brackets`` (and quotes, and not behind a backslash), trimmed.

    The four ways of builds: all brackets with quotes and escapes; all brackets alone; braces alone; and with empty parts kept.
    The fold goes over the marks and the pieces between them; a bracket of any kind closes the last one that is open.
    """
    t = F.coalesce(_c(x), F.lit(""))
    closing = "".join(_CLOSE[_OPEN.index(b)] for b in brackets)
    marks = "".join(f"\\{b}" for b in brackets + closing)
    pattern = "(" + (r"\\.|" if escapes else "") + ('"|' if quotes else "") + f"[,{marks}])"
    pieces, found = F.split(t, "(?s)" + pattern, -1), F.concat(F.regexp_extract_all(t, F.lit("(?s)" + pattern), F.lit(1)), F.array(F.lit("")))
    start = F.expr("named_struct('parts', CAST(array() AS ARRAY<STRING>), 'part', '', 'depth', 0, 'quoted', false)")

    def step(acc: Column, p: Column) -> Column:
        mark, part, free = p["mark"], F.concat(acc["part"], p["piece"]), ~acc["quoted"]
        cut = (mark == ",") & free & (acc["depth"] == 0)
        depth = F.when(free & mark.isin(*brackets), acc["depth"] + 1).when(free & mark.isin(*closing), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        return F.struct(F.when(cut, F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"), F.when(cut, "").otherwise(F.concat(part, mark)).alias("part"), depth.alias("depth"), F.when(mark == '"', free).otherwise(acc["quoted"]).alias("quoted"))

    parts = F.aggregate(F.zip_with(pieces, found, lambda a, b: F.struct(a.alias("piece"), b.alias("mark"))), start, step, lambda acc: F.transform(F.array_append(acc["parts"], acc["part"]), trim))
    return parts if keep_empty else F.filter(parts, lambda p: p != "")
