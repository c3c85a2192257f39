"""Answer grading: literal and numeric comparison, lists, choices, truth values, intervals and expressions.

Expressions are parsed by a small recursive-descent parser (numbers, variables,
+ - * / ^, brackets, \\frac, \\sqrt, \\pi, common functions) and compared at fixed
sample points; nothing is ever evaluated as code. What can't be parsed is
compared as text only. All parts are always compared.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import boxes, last_boxes, split_commas

# Tolerances, words and marks that decide what counts as the same answer.
STRICT_REL = 1e-8 * 1.01
LENIENT_ABS, LENIENT_REL = 5e-3, 1e-2
SCIENTIFIC_BASE = 0.1 * 1.01
TRUE_WORDS, FALSE_WORDS = frozenset({"true", "yes", "t", "y", "correct", "right"}), frozenset({"false", "no", "f", "n", "incorrect", "wrong"})
WEEKDAYS = {"mon": "monday", "tue": "tuesday", "tues": "tuesday", "wed": "wednesday", "thu": "thursday", "thur": "thursday", "thurs": "thursday", "fri": "friday", "sat": "saturday", "sun": "sunday"}
NUMBER_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
NUMBER_WORDS |= {w: str(10 * i) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"hundred": "100", "thousand": "1000", "million": "1000000", "half": "1/2", "third": "1/3", "quarter": "1/4", "fourth": "1/4"}
UNITS = ("s", "sec", "second", "min", "minute", "hour", "hr", "day", "week", "year", "m", "cm", "mm", "km", "ft", "in", "yd", "kg", "g", "mg", "lb")
LEADING_MARKS, TRAILING_MARKS = ",.:;!?=", ",.:;!?=。，、；：！？"
SPELLINGS = {"∶": ":", "，": ",", "\\approx": "=", "\\simeq": "=", "\\sim": "=", "^{\\prime}": "'", "^\\prime": "'", "^{\\circ}": "", "^\\circ": "", "°": "", "\\%": "%", "\\infty": "inf", "∞": "inf", "−": "-", "–": "-", "×": "*", "÷": "/", "\\times": "*", "\\cdot": "*"}
TEXT_COMMANDS = ("text", "textbf", "mathrm", "mathbf", "mbox")
SPACE_COMMANDS = ("left", "right", ",", ";", "!", ":", "quad", "qquad", "displaystyle")
ROW_SECONDS = 5.0

_FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log10, "exp": math.exp, "abs": abs, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan}
_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|\\?[A-Za-z]+|\*\*|[-+*/^(){}=])")
_SAMPLES = (0.7310585, 1.3862943, 2.2360679)


class Unsupported(ValueError):
    """Text that the grammar doesn't hold."""


class OutOfTime(Exception):
    """A row took longer than it may."""


class _Clock:
    """The time at which the row that is being graded must end; a worker grades one row at a time."""

    ends = math.inf

    @classmethod
    def check(cls) -> None:
        if time.monotonic() > cls.ends:
            raise OutOfTime


class _Parser:
    """Turns an expression into a function of its variables' values."""

    def __init__(self, text: str):
        _Clock.check()
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(text)
            self.tokens.append(m[1].lstrip("\\"))
            at = m.end()
        self.at, self.names = 0, set()

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str = "") -> str:
        t = self.peek()
        if not t or expected and t != expected:
            raise Unsupported(t)
        self.at += 1
        return t

    def whole(self):
        f = self.sum()
        if self.peek():
            raise Unsupported(self.peek())
        return f

    def sum(self):
        f = self.product()
        while self.peek() in ("+", "-"):
            sign, g, h = (1 if self.take() == "+" else -1), f, self.product()
            f = lambda v, g=g, h=h, s=sign: g(v) + s * h(v)
        return f

    def product(self):
        f = self.power()
        while True:
            t = self.peek()
            if t in ("*", "cdot", "times"):
                self.take()
                g, h = f, self.power()
                f = lambda v, g=g, h=h: g(v) * h(v)
            elif t in ("/", "div"):
                self.take()
                g, h = f, self.power()
                f = lambda v, g=g, h=h: g(v) / h(v)
            elif t and (t in "({" or t[0].isalnum() or t[0] == "."):  # side by side: a product
                g, h = f, self.power()
                f = lambda v, g=g, h=h: g(v) * h(v)
            else:
                return f

    def power(self):
        if self.peek() in ("-", "+"):
            sign, g = (1 if self.take() == "+" else -1), self.power()
            return lambda v: sign * g(v)
        f = self.atom()
        if self.peek() in ("^", "**"):
            self.take()
            h = self.power()
            return lambda v, f=f, h=h: f(v) ** h(v)
        return f

    def group(self):
        close = {"(": ")", "{": "}"}[self.take()]
        f = self.sum()
        self.take(close)
        return f

    def atom(self):
        t = self.peek()
        if t in ("(", "{"):
            return self.group()
        t = self.take()
        if t[0].isdigit() or t[0] == ".":
            x = float(t)
            return lambda v: x
        if t in ("frac", "dfrac", "tfrac"):
            f, g = self.group(), self.group()
            return lambda v: f(v) / g(v)
        if t in ("left", "right"):
            return self.atom()
        if t == "pi":
            return lambda v: math.pi
        if t in _FUNCTIONS:
            fn, f = _FUNCTIONS[t], self.group() if self.peek() in ("(", "{") else self.atom()
            return lambda v: fn(f(v))
        if len(t) == 1:
            self.names.add(t)
            return lambda v: v[t]
        if t.isalpha() and t.islower() and len(t) <= 3:  # xy: a product of variables
            self.names.update(t)
            return lambda v: math.prod(v[c] for c in t)
        raise Unsupported(t)


def value(text: str) -> float | None:
    """The number that a text means, or None."""
    try:
        p = _Parser(text)
        f = p.whole()
        return None if p.names else float(f({}))
    except (Unsupported, ArithmeticError, ValueError, TypeError, RecursionError, KeyError):
        return None


def unwrapped(t: str) -> str:
    """Without brackets around the whole."""
    while len(t) > 1 and t[0] + t[-1] in ("()", "{}"):
        depth = 0
        for i, c in enumerate(t):
            depth += (c in "({") - (c in ")}")
            if not depth:
                break
        if i < len(t) - 1:
            return t
        t = t[1:-1].strip()
    return t


_TEXT_COMMAND = re.compile(r"\\(?:%s)\s*\{([^{}]*)\}" % "|".join(TEXT_COMMANDS))
_SPACE_COMMAND = re.compile(r"\\(?:%s)(?![A-Za-z])" % "|".join(map(re.escape, SPACE_COMMANDS)))
_UNIT = re.compile(r"(?<=[0-9.}])\s*(?:\\?(?:%s)(?:e?s)?|%%)$" % "|".join(sorted(UNITS, key=len, reverse=True)))
_NAME = re.compile(r"\\?(?:[a-z]|[A-Z]{2}|[a-z]+(?=\())(?:'|_\{?\w+\}?)*(?:\([^()=]*\))?")


def normalize(text: str | None, sides: bool = True) -> str:
    """One spelling of an answer; without ``sides`` equations keep theirs.

    Dollar signs, spacing and text commands, marks at the ends, thousands
    separators, units after numbers, a name and its equals sign, brackets around
    the whole and zeros that mean nothing go; short forms of fractions and roots
    are written out; weekdays and number words get one form.
    """
    t = (text or "").replace("$", "").replace("\n", " ").strip()
    for old, new in SPELLINGS.items():
        t = t.replace(old, new)
    t = _TEXT_COMMAND.sub(r" \1", t)
    t = _SPACE_COMMAND.sub("", t)
    t = re.sub(r"\\(?:dfrac|tfrac)", r"\\frac", t)
    t = re.sub(r"\\frac\s*(\d)\s*(\d)(?!\d)", r"\\frac{\1}{\2}", t)
    t = re.sub(r"\\frac\s*(\d)\s*\{", r"\\frac{\1}{", t)
    t = re.sub(r"\\sqrt\s*(\d)", r"\\sqrt{\1}", t)
    t = re.sub(r"\s+", " ", t).strip().lstrip(LEADING_MARKS + " ") if not t.lstrip().startswith(".") else re.sub(r"\s+", " ", t).strip()
    t = t.rstrip(TRAILING_MARKS + " ")
    if re.fullmatch(r"[-+]?\d{1,3}(,\d{3})+(\.\d+)?", t):
        t = t.replace(",", "")
    if re.fullmatch(r"\.\d+", t):
        t = "0" + t
    low = t.lower()
    if low in WEEKDAYS or low in NUMBER_WORDS:
        return WEEKDAYS.get(low) or NUMBER_WORDS[low]
    t = _UNIT.sub("", t).strip()
    parts = t.split("=") if sides else [t]
    if len(parts) > 2 and "," not in t:
        t = parts[-1].strip()  # of a chain the last
    elif len(parts) == 2 and (_NAME.fullmatch(parts[0].strip()) or not re.search(r"[A-Za-z]", parts[0])):
        t = parts[1].strip()
    if "," not in t:
        t = unwrapped(t)
    t = re.sub(r"(?<![\d.])0+(?=[1-9])", "", re.sub(r"(\d)\.0+(?!\d)", r"\1", t))
    return WEEKDAYS.get(t.lower()) or NUMBER_WORDS.get(t.lower()) or t


_PLUS_MINUS = re.compile(r"\s*(?:\\pm|\\mp|±)\s*")


def both_signs(t: str) -> list[str]:
    """``a \\pm b`` is a - b and a + b; anything else is one answer."""
    if len(parts := _PLUS_MINUS.split(t)) != 2:
        return [t]
    a, b = parts
    return [f"{a}-{b}", f"{a}+{b}" if a else b]


def members(t: str) -> list[str] | None:
    """The distinct elements of a set in braces, or of parts joined by "or"; null if it is neither."""
    inner = m[1] if (m := re.fullmatch(r"\\?\{(.*?)\\?\}", t)) else None
    if inner is None and not re.search(r"(?<![A-Za-z\\])or(?![A-Za-z])", t):
        return None
    parts = [p for x in split_commas(inner if inner is not None else t) for p in re.split(r"(?<![A-Za-z\\])or(?![A-Za-z])", x)]
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def same_number(a: float, b: float, rel: float = STRICT_REL, absolute: float = 0.0) -> bool:
    """Within a relative tolerance of b; of 0 absolutely."""
    return abs(a - b) <= max(absolute, rel * (abs(b) or 1.0))


def _sampled(f: Callable, g: Callable, names: list[str]) -> Iterator[tuple[float, float]]:
    """Values of both at sample points where both are real."""
    for shift in range(len(_SAMPLES)):
        v = {n: _SAMPLES[(i + shift) % len(_SAMPLES)] + 0.1 * i for i, n in enumerate(names)}
        try:
            x, y = f(v), g(v)
        except (ArithmeticError, ValueError, TypeError, KeyError):
            continue
        if not isinstance(x, complex) and not isinstance(y, complex) and math.isfinite(x) and math.isfinite(y):
            yield x, y


def _same_expression(a: str, b: str) -> bool:
    try:
        p, q = _Parser(a), _Parser(b)
        f, g = p.whole(), q.whole()
    except (Unsupported, RecursionError):
        return False
    seen = [same_number(x, y, 1e-9, 1e-12) for x, y in _sampled(f, g, sorted(p.names | q.names))]
    return bool(seen) and all(seen)


_POWER_OF_TEN = re.compile(r"([-+]?\d+\.?\d*)\s*\*\s*10\s*\^\s*\{?\s*([-+]?\d+)\s*\}?")


def _same_scientific(a: str, b: str) -> bool:
    """Of which one at least is a product with a power of ten: equal exponents, and bases that differ by a tenth at most."""
    m, n = _POWER_OF_TEN.fullmatch(a), _POWER_OF_TEN.fullmatch(b)
    if not m and not n:
        return False
    parts = []
    for t, found in ((a, m), (b, n)):
        if found:
            parts.append((float(found[1]), int(found[2])))
        elif (x := value(t)) is None or not math.isfinite(x):
            return False
        else:
            base, _, power = f"{x:.2e}".partition("e")
            parts.append((float(base), int(power)))
    return parts[0][1] == parts[1][1] and abs(parts[0][0] - parts[1][0]) <= SCIENTIFIC_BASE


def _same_equation(a: str, b: str) -> bool:
    """Equations whose sides' differences are integer multiples, one of the other."""
    try:
        (la, ra), (lb, rb) = a.split("="), b.split("=")
        p, q = _Parser(f"({la})-({ra})"), _Parser(f"({lb})-({rb})")
        f, g = p.whole(), q.whole()
    except (Unsupported, RecursionError, ValueError):
        return False
    ratios = []
    for x, y in _sampled(f, g, sorted(p.names | q.names)):
        if abs(x) < 1e-12 or abs(y) < 1e-12:
            if abs(x - y) > 1e-12:
                return False
            continue
        ratios.append(x / y)
    if not ratios or any(not same_number(r, ratios[0], 1e-9) for r in ratios):
        return False
    return any(abs(r) > 0.5 and abs(r - round(r)) < 1e-9 * abs(r) for r in (ratios[0], 1 / ratios[0]))


_INTERVAL = re.compile(r"^([\[(])(.+),(.+)([\])])$")


def _same_interval(a: str, b: str) -> bool:
    """Unions of intervals: each of the one has its like in the other; open and closed ends differ."""
    split = lambda t: [re.sub(r"\s", "", x) for x in re.split(r"\\cup|∪| U ", t)]
    xs, ys = split(a), split(b)
    if len(xs) != len(ys):
        return False
    for x in xs:
        m = _INTERVAL.match(x)
        for y in ys:
            n = _INTERVAL.match(y)
            if m and n and m[1] == n[1] and m[4] == n[4] and same(m[2], n[2]) and same(m[3], n[3]):
                ys.remove(y)
                break
        else:
            return False
    return True


def _bare(t: str) -> str:
    return re.sub(r"[{}\s]", "", t).lower()


def same_text(a: str, b: str) -> bool:
    """But for blanks, braces and case."""
    return a == b or bool(b) and _bare(a) == _bare(b)


def same_truth(a: str, b: str) -> bool:
    return any(a.lower() in words and b.lower() in words for words in (TRUE_WORDS, FALSE_WORDS))


def same_value(a: str, b: str) -> bool:
    """Numbers, the second one rounded to six places, or numbers with powers of ten."""
    x, y = value(a.rstrip("%")), value(b.rstrip("%"))
    if x is not None and y is not None and (same_number(x, y) or same_number(x, round(y, 6))):
        return True
    return _same_scientific(a, b)


def same_expression(a: str, b: str) -> bool:
    return "=" not in a + b and _same_expression(a, b)


def same_equation(a: str, b: str) -> bool:
    return a.count("=") == 1 and b.count("=") == 1 and _same_equation(a, b)


def same_interval(a: str, b: str) -> bool:
    return bool(re.match(r"[\[(]", b) and _INTERVAL.match(re.sub(r"\s", "", re.split(r"\\cup|∪", b)[0]))) and _same_interval(a, b)


def same_choice(a: str, b: str) -> bool:
    """One option letter, alone or with what it stands for after a colon."""
    return bool(re.fullmatch("[A-Z]", b)) and bool(m := re.match(r"[\[(]?([A-Za-z])[\])]?(?:\s*[:.].*)?$", a)) and m[1].upper() == b


def same_letters(a: str, b: str) -> bool:
    """Several option letters, in any order."""
    return bool(re.fullmatch("[A-Z]{2,}", b)) and sorted(re.findall("[A-Z]", a)) == sorted(b) and not re.search("[a-z0-9]", a)


def _listed(t: str) -> list[str]:
    return members(t) or split_commas(unwrapped(t))


def same_in_order(a: str, b: str) -> bool:
    p, g = _listed(a), _listed(b)
    return len(g) > 1 and same_list(p, g, ordered=True)


def same_in_any_order(a: str, b: str) -> bool:
    p, g = _listed(a), _listed(b)
    return len(g) > 1 and same_list(p, g, ordered=False)


#: How answers of each type are compared: lists unordered and ordered, intervals, truth values, expressions, equations, text, letters, a letter, numbers.
METHODS: dict[str, Callable[[str, str], bool]] = {
    "UOL": same_in_any_order, "OL": same_in_order, "INT": same_interval, "TF": same_truth, "EX": same_expression, "EQ": same_equation, "OE": same_text, "MCM": same_letters, "MCS": same_choice, "NV": same_value,
}
_LISTS = ("UOL", "OL")


def same(pred: str | None, gold: str | None, kinds: tuple[str, ...] | None = None, depth: int = 0) -> bool:
    """Whether two answers are the same by any of the ``kinds`` of comparison (all, unless named)."""
    _Clock.check()
    a, b = normalize(pred), normalize(gold)
    if not b:
        return a == b
    if depth == 0 and (kinds is None or "UOL" in kinds) and (_PLUS_MINUS.search(a) or _PLUS_MINUS.search(b)):
        return same_list([y for x in split_commas(a) for y in both_signs(x)], [y for x in split_commas(b) for y in both_signs(x)], ordered=False)
    if same_truth(a, b) and (kinds is None or "TF" in kinds):
        return True
    if b.lower() in TRUE_WORDS | FALSE_WORDS and len(b) > 1:
        return False
    cheap_first = ("OE", "NV", "MCS", "MCM", "INT", "EX", "OL", "UOL")
    if (kinds is None or "EQ" in kinds) and "=" in (pred or "") and "=" in (gold or "") and same_equation(normalize(pred, False), normalize(gold, False)):
        return True
    return any(METHODS[k](a, b) for k in cheap_first if (kinds is None or k in kinds) and not (depth and k in _LISTS))


def same_list(pred: list[str], gold: list[str], ordered: bool = True) -> bool:
    """Part by part; unordered: each part finds one of its own. A part is never a list itself."""
    if len(pred) != len(gold):
        return False
    if ordered:
        return all(same(p, g, depth=1) for p, g in zip(pred, gold, strict=True))
    rest = list(gold)
    for p in pred:
        hit = next((i for i, g in enumerate(rest) if same(p, g, depth=1)), None)
        if hit is None:
            return False
        rest.pop(hit)
    return True


def same_choices(pred: str, gold: str) -> bool:
    """One or several option letters, in any order."""
    letters = lambda t: sorted(set(re.findall(r"[A-J]", t.upper())))
    return bool(letters(gold)) and letters(pred) == letters(gold)


_SQUARE_BOX = re.compile(r"\\boxed\s*\[([^\[\]]+)\]")
_SAYS = re.compile(r"(?i)answer\s*(?:is|:)\s*(.+)", re.S)
_SAID = re.compile(r"(?is)([^,.!\n]+?)\s+is (?:the|our) ans")
_FORMULA = re.compile(r"(?s)(?:\$|\\\(|\\\[)([^$]+?)(?:\$|\\\)|\\\])")
_NUMBER = re.compile(r"-?\d*\.?\d+")


def final_section(response: str | None) -> str:
    return (response or "").split("</think>")[-1]


def extract(response: str | None, strict: bool = False) -> str:
    """The answer of a response.

    The last group of boxes counts, else what follows ``####``, else what is
    called the answer after the last "therefore"; unless ``strict``, also the last
    formula and the last number.
    """
    text = final_section(response)
    if found := [b for b in last_boxes(text) if b] or [b for b in last_boxes(response) if b]:
        return ", ".join(found)
    if "####" in text:
        return text.rsplit("####", 1)[1].strip().split("\n")[0].strip()
    text = re.split(r"[Tt]herefore", text)[-1].strip()
    if m := list(_SAID.finditer(text)):
        return m[-1][1].strip().strip("$").strip()
    if "answer" in text.lower() and (m := _SAYS.search(text[text.lower().rindex("answer") :])):
        return re.split(r"\n|\.\s|\.$", m[1].strip(), maxsplit=1)[0].strip().strip("$").strip()
    if not strict:
        if m := _FORMULA.findall(text):
            return m[-1].strip()
        if m := _NUMBER.findall(text.replace(",", "")):
            return m[-1]
    return ""


def judge(response: str | None, gold: list[str] | None, options: list[str] | None = None, kinds: list[str] | None = None) -> bool:
    """Whether a response answers the gold parts; with options its letter must be the gold's, with ``kinds`` each part is compared as its kind says."""
    gold = list(gold) if gold is not None else []
    found = extract(response)
    if not gold or not found:
        return False
    if options is not None and len(options):
        return same_choices(found, ",".join(gold))
    if kinds is not None:
        parts = split_commas(found) if len(gold) > 1 else [found]
        return len(parts) == len(gold) == len(kinds) and all(same(p, g, (k,)) for p, g, k in zip(parts, gold, kinds, strict=True))
    return same_list(split_commas(found), gold) if len(gold) > 1 else same(found, gold[0])


def strictly(response: str | None, gold: list[str] | None, options: list[str] | None = None) -> bool:
    """As ``judge``, and false where that fails."""
    try:
        return judge(response, gold, options)
    except OutOfTime:
        raise
    except Exception:
        return False


def lenient_number(pred: Column, gold: Column) -> Column:
    """Numbers within an absolute or relative tolerance, native; null where either is none."""
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    a, b = number(pred), number(gold)
    return F.abs(a - b) <= F.greatest(F.lit(LENIENT_ABS), F.lit(LENIENT_REL) * F.greatest(F.lit(1.0), F.abs(b)))


def literal_equal(pred: Column, gold: Column) -> Column:
    """Equal but for blanks and case, native."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    return bare(pred) == bare(gold)


def close(pred: str, gold: str) -> bool:
    """Numbers within the lenient tolerance."""
    x, y = value(normalize(pred)), value(normalize(gold))
    return x is not None and y is not None and math.isfinite(x) and math.isfinite(y) and abs(x - y) <= max(LENIENT_ABS, LENIENT_REL * max(1.0, abs(y)))


def close_parts(pred: str, gold: list[str]) -> bool:
    """As many parts as gold ones, each the same text or close, in order."""
    parts = split_commas(pred)
    return len(parts) == len(gold) and all(same_text(normalize(p), normalize(g)) or close(p, g) for p, g in zip(parts, gold, strict=True))


_ASSERTED = re.compile(r"(?i)\banswer\s*(?:is|:)\s*((?:[^.\n]|\.(?=\d)){1,240})")
_EQUALS = re.compile(r"=\s*([^\n=]{1,160}?)\s*(?:\.(?!\d)|\n|$)")
_CHOSEN = re.compile(r"(?i)\b(?:option|choice)\s*\(?([a-j])\b")
_CONCLUDES = re.compile(r"(?i)\b(?:therefore|thus|hence|so)\b[,:]?")
LAST_CLAUSE = 120
_WRAP = "$\\[]() \t\n"


def _tidy(t: str) -> str:
    t = re.sub(r"(?i)\s*is (?:the|our) answer\s*$", "", t.strip().rstrip(" .,:;"))
    return t.strip(_WRAP).strip(" .,:;")


def candidates(response: str | None) -> Iterator[tuple[str, str]]:
    """(mode, answer) that a response may mean, the likeliest first: boxes, else what its prose says."""
    text = _SQUARE_BOX.sub(lambda m: f"\\boxed{{{m[1].strip()}}}", response or "")
    after = final_section(text)
    found = [b for b in boxes(after) if b] or [b for b in boxes(text) if b]
    if found:
        yield "boxed_last", found[-1]
        if len(found) > 1:
            yield "multi_box_join", ", ".join(found)
            yield from (("boxed_each", b) for b in found)
        return
    said = [_tidy(m[1]) for m in _ASSERTED.finditer(after)] + [_tidy(m[1]) for m in _EQUALS.finditer(after)] + [m[1].upper() for m in _CHOSEN.finditer(after)]
    last = _CONCLUDES.split(after)[-1].strip()
    if len(last) <= LAST_CLAUSE:
        said.append(_tidy(last))
    seen = set()
    for t in said:
        if (key := _bare(t)) and key not in seen:
            seen.add(key)
            yield "prose_fallback", t


def label_of(candidate: str, options: list[str]) -> str:
    """The option that a candidate is: its letter, or the option of the same text or a close number."""
    if m := re.fullmatch(r"\(?\s*([A-J])\s*\)?", candidate.strip().upper()):
        return m[1]
    a = normalize(candidate)
    return next((chr(65 + i) for i, o in enumerate(options) if a and (same_text(a, normalize(o)) or close(candidate, o))), "")


def rescued(response: str | None, gold: list[str], options: list[str]) -> tuple[bool, str]:
    """The first candidate that is right, and how it was found."""
    rewritten = "\\boxed[" in (response or "")
    for mode, c in candidates(response):
        if options:
            if label_of(c, options) == ",".join(gold).strip().upper():
                letter = re.fullmatch(r"\(?\s*[A-J]\s*\)?", c.strip().upper())
                return True, mode if mode == "prose_fallback" else ("boxed_syntax" if rewritten else "mcq_letter_recovered") if letter else "mcq_value_match"
            continue
        judged = judge(f"\\boxed{{{c}}}", gold)
        if judged or close_parts(c, gold):
            if mode in ("multi_box_join", "prose_fallback"):
                return True, mode
            if rewritten:
                return True, "boxed_syntax"
            parts = split_commas(c)
            return True, "exact_decimal_numeric" if len(parts) == len(gold) and any(close(p, g) for p, g in zip(parts, gold, strict=True)) else "judger_lenient"
    return False, "unrescued"


def score(response: str | None, gold: list[str] | None, options: list[str] | None = None, correct: bool | None = None, seconds: float = ROW_SECONDS) -> tuple[bool, str]:
    """(correct, mode): strictly (or as ``correct`` says), else by the first candidate that rescues it.

    A row that takes more than ``seconds`` keeps its strict verdict, with the mode
    ``timeout``; so does one that fails, with the error's name.
    """
    gold, options = list(gold) if gold is not None else [], list(options) if options is not None else []
    strict = bool(correct)
    _Clock.ends = time.monotonic() + seconds
    try:
        strict = strictly(response, gold, options) if correct is None else bool(correct)
        return (True, "strict_correct") if strict else rescued(response, gold, options) if gold else (False, "unrescued")
    except OutOfTime:
        return strict, "timeout"
    except Exception as e:
        return strict, f"error:{type(e).__name__}"
    finally:
        _Clock.ends = math.inf


def _verdicts(fn: Callable[..., bool], *columns: pd.Series) -> pd.Series:
    """Verdicts on the rows of a batch; of rows that are the same one is judged."""
    rows, seen = list(zip(*columns, strict=True)), {}
    for row in rows:
        if row not in seen:
            seen[row] = fn(*row)
    return pd.Series([seen[row] for row in rows], dtype="boolean")


def _hashable(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: x if x is None else tuple(x))


@F.pandas_udf(T.BooleanType())
def same_udf(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return _verdicts(same, pred, gold)


@F.pandas_udf(T.StructType([T.StructField("correct", T.BooleanType()), T.StructField("mode", T.StringType())]))
def score_udf(response: pd.Series, gold: pd.Series, options: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([score(*x) for x in zip(response, gold, options, strict=True)], columns=["correct", "mode"])


def typed_udf():
    """Verdicts by the kinds of the parts."""

    @F.pandas_udf(T.BooleanType())
    def run(response: pd.Series, gold: pd.Series, kinds: pd.Series) -> pd.Series:
        return _verdicts(lambda r, g, k: judge(r, g, None, list(k)), response, _hashable(gold), _hashable(kinds))

    return run


def of_kind_udf(kind: str):
    """Whether two answers are the same by one kind of comparison."""

    @F.pandas_udf(T.BooleanType())
    def run(pred: pd.Series, gold: pd.Series) -> pd.Series:
        return _verdicts(lambda p, g: METHODS[kind](normalize(p, kind != "EQ"), normalize(g, kind != "EQ")), pred, gold)

    return run


def text_udf(fn: Callable[[str | None], str]):
    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(fn)

    return run
