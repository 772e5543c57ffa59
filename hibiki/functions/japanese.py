"""Japanese numbers, dates, quantities, normal forms and salient terms, as Arrow functions over columns.

Quantities are read by one cursor that walks the folded text from left to right.  At every place the grammar below is
tried from its most to its least specific form; what a form consumes, no other form sees:

    item     = fiscal | date | time | code | article | yen | days | quantity
    fiscal   = (era year | YYYY) 年度              date = era year 年 [m 月 [d 日]] | YYYY 年 [..] | R6.4.1 | Y-M-D | Y-M
    time     = [午前|午後] h 時 [m 分]              article = 第 n 条|項|...      yen = ¥ amount      days = n 営業日 | n 日 (以内|...)
    quantity = [sign] (amount | numerals) [unit]

Null in, null out; empty texts give empty results.
"""

from __future__ import annotations

import calendar
import datetime as dt
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable
from decimal import Decimal
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numerals with their worth, and the units of the decimal and of the myriad system.
DIGITS = {"〇": 0, "零": 0, "一": 1, "壱": 1, "二": 2, "弐": 2, "三": 3, "参": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
TENS = {"千": 1000, "百": 100, "十": 10}
MYRIADS = {"兆": 10**12, "億": 10**8, "万": 10**4}
TEN_OF_DEEDS = "拾"

# Eras with their letter, first and last day.
ERAS = {
    "令和": ("R", dt.date(2019, 5, 1), dt.date.max),
    "平成": ("H", dt.date(1989, 1, 8), dt.date(2019, 4, 30)),
    "昭和": ("S", dt.date(1926, 12, 25), dt.date(1989, 1, 7)),
    "大正": ("T", dt.date(1912, 7, 30), dt.date(1926, 12, 24)),
    "明治": ("M", dt.date(1868, 1, 1), dt.date(1912, 7, 29)),
}

# The words of each unit, by kind.
UNITS = {
    "percent": {"%": ("%", "パーセント")},
    "measure": {
        "g": ("グラム",),
        "kg": ("kg", "キログラム"),
        "mg": ("mg", "ミリグラム"),
        "m": ("メートル",),
        "km": ("km", "キロメートル"),
        "cm": ("cm", "センチメートル"),
        "mm": ("mm", "ミリメートル"),
        "l": ("リットル",),
        "ml": ("ml", "ミリリットル"),
        "t": ("トン",),
    },
    "duration": {
        "second": ("秒", "秒間"),
        "minute": ("分", "分間"),
        "hour": ("時間",),
        "day": ("日間",),
        "week": ("週間",),
        "month": ("か月", "ヶ月", "カ月", "ケ月", "箇月"),
        "year": ("年間",),
    },
    "money": {"JPY": ("円",)},
    "ratio": {"times": ("倍",)},
    "count": {
        "件": ("件",),
        "人": ("人",),
        "名": ("名",),
        "回": ("回",),
        "個": ("個",),
        "枚": ("枚",),
        "台": ("台",),
        "本": ("本",),
        "冊": ("冊",),
        "社": ("社",),
        "部": ("部",),
        "点": ("点",),
        "歳": ("歳", "才"),
        "箇所": ("箇所", "か所", "カ所"),
    },
}
# Words that begin with a numeral and are no number.
NOT_NUMBERS = ("十分", "一時", "一部", "一方", "一面", "一本", "一番", "一応", "一緒", "一層", "一旦")
# Parts of a law, what makes a number of days a period, what joins the ends of a range, signs.
PARTS_OF_LAW = ("条", "項", "号", "章", "節", "款", "編")
AFTER_DAYS = ("以内", "以上", "以下", "未満", "超", "前", "後", "経過", "ごと", "毎", "おき")
RANGE_MARKS = ("〜", "~", "-", "から")
MINUS = ("△", "▲", "−", "マイナス")

_FIGURES = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NUMERALS = frozenset(DIGITS) | frozenset(TENS) | frozenset(MYRIADS) | {TEN_OF_DEEDS}
_WORDS = {word: (kind, unit) for kind, units in UNITS.items() for unit, words in units.items() for word in words}
_BY_LENGTH = sorted(_WORDS, key=len, reverse=True)


def nfkc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKC", s)


# -------------------------------------------------------------------------------------------------------- numbers


def number(s: str) -> Decimal | None:
    """The value of a number in figures, numerals or both; None where units stand in no possible order."""
    s = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", nfkc(s).strip()).replace(TEN_OF_DEEDS, "十")
    return _split(s, (*MYRIADS.items(), *TENS.items())) if s and not s.startswith(",") else None


def _leaf(s: str) -> Decimal | None:
    whole, point, part = s.partition(".")
    if whole and set(whole) <= _FIGURES and (not point or (part and set(part) <= _FIGURES)):
        return Decimal(s)
    if s and set(s) <= DIGITS.keys():
        return Decimal("".join(str(DIGITS[c]) for c in s))
    return None


def _split(s: str, units: tuple[tuple[str, int], ...]) -> Decimal | None:
    """s as multiples of the units, each at most once and from the greatest down."""
    for i, (mark, size) in enumerate(units):
        head, found, tail = s.partition(mark)
        if not found:
            continue
        times = Decimal(1) if not head else _split(head, tuple(TENS.items())) if size >= 10**4 else _leaf(head)
        rest = _split(tail, units[i + 1 :]) if tail else Decimal(0)
        return None if times is None or rest is None else times * size + rest
    return _leaf(s)


def plain(value: Decimal) -> str:
    """A value in figures, without exponent or zeros that say nothing."""
    s = f"{value:f}"
    s = s.rstrip("0").rstrip(".") if "." in s else s
    return s if s.strip("-0") else "0"


def whole_number(s: str) -> int | None:
    """A year, month, day or article number; the first year of an era is written 元."""
    value = Decimal(1) if s.strip() == "元" else number(s)
    return int(value) if value is not None and value % 1 == 0 else None


# ---------------------------------------------------------------------------------------------------------- dates


def checked_date(year: int, month: int | None, day: int | None, era: str | None = None) -> tuple[str, bool, str]:
    """(text of the possibly partial date, valid, reason)."""
    text = f"{year:04d}" + (f"-{month:02d}" if month is not None else "") + (f"-{day:02d}" if day is not None else "")
    reason = ""
    if year not in range(1, 10_000):
        reason = "year_out_of_range"
    elif month not in (None, *range(1, 13)):
        reason = "month_out_of_range"
    else:
        first_month, last_month = (month, month) if month is not None else (1, 12)
        days = calendar.monthrange(year, first_month)[1]
        if day is not None and day not in range(1, days + 1):
            reason = "invalid_day"
        elif era is not None:
            spans = (dt.date(year, first_month, day or 1), dt.date(year, last_month, day or calendar.monthrange(year, last_month)[1]))
            reason = "" if spans[0] <= ERAS[era][2] and ERAS[era][1] <= spans[1] else "outside_era"
    return text, not reason, reason


# ----------------------------------------------------------------------------------------------------- quantities


class Found(NamedTuple):
    """Something countable: where it stands, what it is worth, and whether it can be."""

    kind: str
    canonical: str
    value: Decimal | None
    unit: str
    start: int
    end: int
    valid: bool = True
    note: str = ""


class Cursor:
    """Places of a text: each method says where what it looks for ends, or None where it is not."""

    def __init__(self, text: str):
        self.text = text
        self.size = len(text)

    def char(self, at: int) -> str:
        return self.text[at] if 0 <= at < self.size else ""

    def run(self, at: int, members: Iterable[str]) -> int:
        while at < self.size and self.text[at] in members:
            at += 1
        return at

    def blank(self, at: int) -> int:
        while at < self.size and self.text[at].isspace():
            at += 1
        return at

    def word(self, at: int, words: Iterable[str]) -> str | None:
        return next((w for w in words if self.text.startswith(w, at)), None)

    def figures(self, at: int, least: int, most: int) -> int | None:
        end = self.run(at, _FIGURES)
        return end if least <= end - at <= most else None

    def count(self, at: int) -> int | None:
        """One to four figures, or numerals."""
        return self.figures(at, 1, 4) or self.numerals(at)

    def numerals(self, at: int) -> int | None:
        end = self.run(at, _NUMERALS)
        return end if end > at else None

    def decimal(self, at: int) -> int | None:
        """Figures, in groups of three after commas or not, with a fraction or not."""
        end = self.run(at, _FIGURES)
        if end == at:
            return None
        if end - at <= 3:
            while self.char(end) == "," and self.run(end + 1, _FIGURES) - end - 1 >= 3:
                end += 4
                if self.char(end) in _FIGURES:
                    break
        if self.char(end) == "." and self.char(end + 1) in _FIGURES and self.char(end + 1):
            end = self.run(end + 1, _FIGURES)
        return end

    def amount(self, at: int) -> int | None:
        """A decimal with units of ten and decimals in between: 1万5千, 3.5億."""
        end = self.decimal(at)
        while end is not None and self.char(end) and (self.char(end) in TENS or self.char(end) in MYRIADS):
            end = self.decimal(end + 1) or end + 1
        return end

    def unit(self, at: int) -> str | None:
        """The longest unit here; one of letters must end there, 分 must not be a fraction."""
        for w in _BY_LENGTH:
            if self.text.startswith(w, at):
                after = self.char(at + len(w))
                if not (w[-1] in _LETTERS and after in _LETTERS and after) and not (w == "分" and after == "の"):
                    return w
        return None

    def starts_number(self, at: int) -> bool:
        return self.char(at - 1) not in _FIGURES | {",", "."} if at else True

    def counts(self, at: int) -> bool:
        """Whether numerals here are a number rather than a part of a word."""
        if self.word(at, NOT_NUMBERS):
            return False
        if at and (self.text[at - 1] == "第" or any(self.text.endswith(e, 0, at) for e in ERAS)):
            return True
        return not (at and _kind(self.text[at - 1]) == "kanji")


def _year_of(c: Cursor, at: int) -> tuple[str | None, int, int] | None:
    """(era, year of the common era, end) of the year at this place, before its 年."""
    era = c.word(at, ERAS)
    if era is None:
        end = c.figures(at, 4, 4)
        return None if end is None or c.char(at - 1) in _FIGURES and at else (None, int(c.text[at:end]), end)
    at = c.blank(at + len(era))
    end = at + 1 if c.char(at) == "元" else c.count(at)
    year = None if end is None else whole_number(c.text[at:end])
    return None if year is None or year < 1 else (era, ERAS[era][1].year + year - 1, end)


def _fiscal(c: Cursor, at: int) -> Found | None:
    year = _year_of(c, at)
    if year is None or (year[0] is None and not c.starts_number(at)):
        return None
    end = c.blank(year[2])
    return Found("fiscal_year", f"FY{year[1]}", Decimal(year[1]), "FY", at, end + 2) if c.word(end, ("年度",)) else None


def _date_found(at: int, end: int, year: int, month: int | None, day: int | None, era: str | None = None) -> Found:
    text, valid, reason = checked_date(year, month, day, era)
    return Found("date", text, None, "", at, end, valid, reason)


def _date_in_words(c: Cursor, at: int) -> Found | None:
    year = _year_of(c, at)
    if year is None or c.char(c.blank(year[2])) != "年":
        return None
    end = c.blank(year[2]) + 1
    parts: list[int | None] = []
    for mark in "月日":
        here = c.blank(end)
        stop = c.count(here)
        if stop is None or c.char(c.blank(stop)) != mark:
            break
        parts.append(whole_number(c.text[here:stop]))
        if parts[-1] is None:
            return None
        end = c.blank(stop) + 1
    month, day = (*parts, None, None)[:2]
    return _date_found(at, end, year[1], month, day, year[0])


def _date_in_figures(c: Cursor, at: int) -> Found | None:
    """R6.4.1, 2024-04-05 and 2024/4; a longer chain of figures and marks is none."""
    letter = {v[0]: k for k, v in ERAS.items()}.get(c.char(at))
    if letter:
        if c.char(at - 1) and at and c.char(at - 1) in _LETTERS | _FIGURES:
            return None
        start = c.blank(at + 1 + (c.char(at + 1) == "."))
        marks, first = "./", c.figures(start, 1, 2)
    else:
        if at and c.char(at - 1) in _FIGURES | set("./-"):
            return None
        start = at
        marks, first = "/.-", c.figures(at, 4, 4)
    if first is None:
        return None
    numbers, ends = [int(c.text[start:first])], [first]
    mark = c.char(first)
    while len(numbers) < 3 and c.char(ends[-1]) and c.char(ends[-1]) in marks and (letter or c.char(ends[-1]) == mark):
        end = c.figures(ends[-1] + 1, 1, 2)
        if end is None:
            break
        numbers.append(int(c.text[ends[-1] + 1 : end]))
        ends.append(end)
    goes_on = c.char(ends[-1]) in ("." , "/") if letter else c.char(ends[-1]) in (".", "/", "-")
    if goes_on or len(numbers) < (3 if letter else 2) or (len(numbers) == 2 and mark == "."):
        return None
    year = numbers[0] + (ERAS[letter][1].year - 1 if letter else 0)
    if letter and numbers[0] < 1:
        return None
    return _date_found(at, ends[-1], year, numbers[1], numbers[2] if len(numbers) == 3 else None, letter)


def _time(c: Cursor, at: int) -> Found | None:
    half = c.word(at, ("午前", "午後"))
    start = c.blank(at + 2) if half else at
    stop = c.figures(start, 1, 2) if half or not at or c.char(at - 1) not in _FIGURES else None
    if stop is None or c.char(c.blank(stop)) != "時" or c.char(c.blank(stop) + 1) == "間":
        return None
    hour, minute, end = int(c.text[start:stop]), 0, c.blank(stop) + 1
    more = c.figures(c.blank(end), 1, 2)
    if more is not None and c.char(c.blank(more)) == "分" and c.char(c.blank(more) + 1) != "間":
        minute, end = int(c.text[c.blank(end) : more]), c.blank(more) + 1
    last = 12 if half else 24
    if hour > last or minute > 59 or (hour == 24 and minute):
        return None
    if half:
        hour = hour % 12 + (12 if half == "午後" else 0) if hour < 12 or half == "午前" else 12
    return Found("time", f"{hour % 24:02d}:{minute:02d}", None, "", at, end)


_CODE = _LETTERS | _FIGURES | set("-_")


def _code_end(c: Cursor, at: int) -> int | None:
    """The end of a part number, telephone number or postcode that begins here."""
    figures, letters = c.run(at, _FIGURES), c.run(at, _LETTERS)
    if letters > at:
        digit = letters + (c.char(letters) in ("-", "_"))
        return c.run(digit, _CODE) if c.char(digit) and c.char(digit) in _FIGURES else None
    inner = c.run(figures, _LETTERS)
    if inner > figures and c.char(inner) and c.char(inner) in _FIGURES:
        return c.run(inner, _CODE)
    groups, end = [figures - at], figures
    while c.char(end) == "-" and c.run(end + 1, _FIGURES) > end + 1:
        stop = c.run(end + 1, _FIGURES)
        groups.append(stop - end - 1)
        end = stop
    return end if len(groups) > 2 or groups == [3, 4] else None


def _article(c: Cursor, at: int) -> Found | None:
    if c.char(at) != "第":
        return None
    start = c.blank(at + 1)
    end = c.run(start, _FIGURES) if c.char(start) in _FIGURES else c.numerals(start)
    part = None if not end or end == start else c.word(c.blank(end), PARTS_OF_LAW)
    value = number(c.text[start:end]) if part else None
    return None if value is None else Found("article", plain(value) + part, value, part, at, c.blank(end) + 1)


def _yen(c: Cursor, at: int) -> Found | None:
    start = c.blank(at + 1)
    end = c.amount(start) if c.char(at) in ("¥", "\\") else None
    value = None if end is None else number(c.text[start:end])
    return None if value is None else Found("money", f"{plain(value)}JPY", value, "JPY", at, end)


def _days(c: Cursor, at: int) -> Found | None:
    end = c.run(at, _FIGURES)
    if end == at or not c.starts_number(at):
        return None
    if c.char(end) == "." and c.run(end + 1, _FIGURES) > end + 1:
        end = c.run(end + 1, _FIGURES)
    if c.word(end, ("営業日",)):
        word, unit = "営業日", "business_day"
    elif c.char(end) == "日" and c.word(end + 1, AFTER_DAYS):
        word, unit = "日", "day"
    else:
        return None
    value = Decimal(c.text[at:end])
    return Found("duration", plain(value) + unit, value, unit, at, end + len(word))


def _quantity(c: Cursor, at: int) -> Found | None:
    sign = c.word(at, MINUS) or ("-" if c.char(at) == "-" and not (at and (c.text[at - 1].isalnum() or c.text[at - 1] in "_.")) else "")
    start = at + len(sign)
    if not c.starts_number(start):
        return None
    end = c.amount(start)
    written = end is None
    end = c.numerals(start) if written else end
    if end is None:
        return None
    word = c.unit(end)
    value = number(c.text[start:end])
    after = c.char(end)
    if value is None or (written and not (word and c.counts(start))) or (not word and after and after in _LETTERS):
        return None
    kind, unit = _WORDS[word] if word else ("number", "")
    value = -value if sign else value
    return Found(kind, plain(value) + unit, value, unit, at, end + len(word or ""))


_FORMS: tuple[Callable[[Cursor, int], Found | None], ...] = (_fiscal, _date_in_words, _date_in_figures, _time)
_LATER: tuple[Callable[[Cursor, int], Found | None], ...] = (_article, _yen, _days, _quantity)
_FIRST = _FIGURES | _LETTERS | _NUMERALS | {e[0] for e in ERAS} | set("午第¥\\-") | {m[0] for m in MINUS}


def quantities(text: str) -> list[Found]:
    """Everything countable in a text, in order; a low end of a range takes unit and myriad of the high end."""
    c = Cursor(nfkc(text))
    out: list[Found] = []
    at = 0
    while at < c.size:
        if c.text[at] not in _FIRST:
            at += 1
            continue
        found = next((f for f in (form(c, at) for form in _FORMS) if f), None)
        if found is None:
            code = _code_end(c, at) if c.text[at] in _LETTERS or c.text[at] in _FIGURES else None
            if code:
                at = code
                continue
            found = next((f for f in (form(c, at) for form in _LATER) if f), None)
        if found:
            out.append(found)
            at = found.end
        elif c.text[at] in _LETTERS:
            at = c.run(at, _LETTERS)
        elif c.text[at] in _NUMERALS and c.text[at] not in _FIGURES:
            at = c.run(at, _NUMERALS)
        else:
            at += 1
    return _ranges(c, out)


def _ranges(c: Cursor, found: list[Found]) -> list[Found]:
    out = list(found)
    for i, (low, high) in enumerate(itertools.pairwise(found)):
        low = out[i]
        if low.value is None or high.value is None or c.text[low.end : high.start] not in RANGE_MARKS:
            continue
        if high.unit and not low.unit:
            digits = c.text[high.start : high.end]
            word = c.unit(high.end - next((len(w) for w in _BY_LENGTH if digits.endswith(w)), 0))
            last = digits[: len(digits) - len(word or "")][-1:]
            size = MYRIADS.get(last, 1) if not MYRIADS.keys() & set(c.text[low.start : low.end]) else 1
            value = low.value * size
            low = low._replace(kind=high.kind, unit=high.unit, value=value, canonical=plain(value) + high.unit)
        out[i] = low._replace(note="range_low")
        out[i + 1] = high._replace(note="range_high")
    return out


def dates(text: str) -> list[Found]:
    """The dates of a text alone, whatever else it counts."""
    return [f for f in quantities(text) if f.kind == "date"]


def quantity_terms(text: str) -> list[str]:
    """q:kind:canonical of all that can be, so that equal amounts meet however they are written."""
    return [f"q:{f.kind}:{f.canonical}" for f in quantities(text) if f.valid]


# --------------------------------------------------------------------------------------------------- normal forms

# Characters that are not seen, dashes, quotation marks and wave marks with what they become.
HIDDEN = dict.fromkeys([*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
MARKS = str.maketrans("‐‑‒–—―−’‘‛“”„‟", "-------'''\"\"\"\"")
WAVES = str.maketrans("〜～", "~~")
# What NFKC would fold and a reader wants to see as it stands.
KEPT_AS_WRITTEN = (
    (0x2460, 0x2473),  # numbers in circles
    (0x3251, 0x325F),
    (0x32B1, 0x32BF),
    (0x3220, 0x3243),  # forms of companies
    (0x2160, 0x217F),  # Roman numerals
    (0x2103, 0x2103),
    (0x2109, 0x2109),
    (0x2116, 0x2116),
    (0x2121, 0x2121),
    (0x3300, 0x33FF),  # units in one square
)


def folded_but_kept(text: str) -> str:
    """NFKC piece by piece between the characters that are kept as written."""
    kept = lambda ch: any(a <= ord(ch) <= b for a, b in KEPT_AS_WRITTEN)
    return "".join("".join(piece) if as_is else nfkc("".join(piece)) for as_is, piece in itertools.groupby(text, kept))


def _seen(s: str) -> str:
    return s.replace("\r\n", "\n").replace("\r", "\n").translate(HIDDEN)


def _spaces(s: str) -> str:
    lines = [re.sub("[ \t　 ]+", " ", x).rstrip(" ") for x in s.strip().split("\n")]
    out: list[str] = []
    for line in lines:
        if line or out[-1:] != [""]:
            out.append(line)
    return "\n".join(out).strip()


def _long_vowels(s: str) -> str:
    """A hyphen between katakana is a long vowel."""
    return "".join("ー" if ch == "-" and 0 < i < len(s) - 1 and "ァ" <= s[i - 1] <= "ヴ" and "ァ" <= s[i + 1] <= "ヴ" else ch for i, ch in enumerate(s)) if "-" in s else s


def _ungrouped(s: str) -> str:
    """Numbers without their commas, where every group after the first has three figures."""

    def one(m: re.Match) -> str:
        head, *groups = m.group().split(",")
        return m.group().replace(",", "") if groups and 1 <= len(head) <= 3 and all(len(g) == 3 for g in groups) else m.group()

    return re.sub("[0-9,]*[0-9][0-9,]*", one, s)


def _in_figures(s: str) -> str:
    """Numerals that count something, in figures."""
    c = Cursor(s)
    out, at = [], 0
    while at < c.size:
        end = c.numerals(at)
        if end is None:
            out.append(s[at])
            at += 1
            continue
        asked = s[at - 1 : at] == "第" or c.unit(end) or s[end : end + 1] in ("年", "月", "日", "時")
        value = number(s[at:end]) if asked and c.counts(at) else None
        out.append(s[at:end] if value is None else plain(value))
        at = end
    return "".join(out)


def _stems(s: str) -> str:
    """Katakana words of more than three characters without the long vowel they end in."""
    return re.sub("[ァ-ヴー]{4,}", lambda m: m.group()[:-1] if m.group()[-1] == "ー" else m.group(), s)


# The rules of each profile, by name and in order.
_DISPLAY = {"strip_invisible": _seen, "spaces": _spaces}
_DENSE = {"nfkc": nfkc} | _DISPLAY
_INDEX = _DENSE | {"dash_quote": lambda s: s.translate(MARKS).translate(WAVES), "katakana_hyphen": _long_vowels, "thousands": _ungrouped, "kanji_numerals": _in_figures, "lower": str.lower}
PROFILES: dict[str, dict[str, Callable[[str], str]]] = {"display": _DISPLAY, "dense": _DENSE, "index": _INDEX, "match": _INDEX | {"katakana_final_long": _stems}}


def traced(s: str, profile: str = "index") -> tuple[str, list[str]]:
    """The text in a profile and the names of the rules that changed it."""
    changed = []
    for name, rule in PROFILES[profile].items():
        after = rule(s)
        if after != s:
            changed.append(name)
        s = after
    return s, changed


def normalized(s: str, profile: str = "index") -> str:
    return traced(s, profile)[0]


def text_form(s: str) -> str:
    """Width and compatibility forms folded, dashes and quotation marks too, white space collapsed and trimmed."""
    return " ".join(nfkc(s).translate(MARKS).split())


# -------------------------------------------------------------------------------------------------- salient terms


def _kind(ch: str) -> str:
    if ch in _LETTERS or ch in _FIGURES:
        return "latin"
    if "ァ" <= ch <= "ヴ" or ch == "ー":
        return "katakana"
    if "ぁ" <= ch <= "ん":
        return "hiragana"
    if "一" <= ch <= "龥" or ch in "々〆〤":
        return "kanji"
    return "joiner" if ch in "._:/-" else "other"


def _quoted(s: str) -> tuple[list[str], str]:
    """(what stands in quotation marks, the text with it blanked out)."""
    found, rest, at = [], [], 0
    while at < len(s):
        close = s.find({"「": "」", '"': '"', "'": "'"}[s[at]], at + 1) if s[at] in "「\"'" else -1
        if close > at + 1:
            found.append(s[at + 1 : close])
            rest.append(" " * (close + 1 - at))
            at = close + 1
        else:
            rest.append(s[at])
            at += 1
    return found, "".join(rest)


def salient_terms(text: str) -> list[str]:
    """Quoted spans, then codes and words, katakana with kanji, katakana, kanji, each where it stands for itself.

    A run counts only where its neighbours are of no other kind of letter: 設備 in 設備の点検 is part of a phrase.
    """
    terms, s = _quoted(text_form(text))
    runs: list[list] = []  # kind, start, end
    for i, ch in enumerate(s):
        kind = _kind(ch)
        if kind == "joiner" and runs and runs[-1][0] == "latin":
            kind = "latin"
        if runs and runs[-1][0] == kind:
            runs[-1][2] = i + 1
        else:
            runs.append([kind, i, i + 1])
    letters = {"latin", "katakana", "hiragana", "kanji"}
    near = lambda k: runs[k][0] if 0 <= k < len(runs) else ""
    taken: set[int] = set()

    def gather(kind: str, least: int, apart: set[str], tail: str = "") -> None:
        for k, (own, a, b) in enumerate(runs):
            last = k + 1 if tail else k
            if own != kind or k in taken or b - a < least or (tail and near(last) != tail):
                continue
            before, after = (("" if j in taken else near(j)) for j in (k - 1, last + 1))
            if before not in apart and after not in apart:
                terms.append(s[a : runs[last][2]])
                taken.update((k, last))

    gather("latin", 2, letters)
    gather("katakana", 2, {"katakana", "kanji"}, "kanji")
    gather("katakana", 2, letters - {"katakana"})
    gather("kanji", 2, letters - {"kanji"})
    clean = (text_form(t) for t in terms)
    return [t for t in dict.fromkeys(clean) if t and not (len(t) <= 3 and all(_kind(ch) == "hiragana" for ch in t))]


# -------------------------------------------------------------------------------------------------------- columns

QUANTITY = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("value", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("valid", T.BooleanType()), T.StructField("note", T.StringType())])
)


def _texts(f: Callable[[str], str | None]):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _arrays(f: Callable[[str], list[str]]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


def _number_text(s: str) -> str | None:
    value = number(s)
    return None if value is None else plain(value)


@F.pandas_udf(QUANTITY)
def quantities_of(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [f._asdict() | {"value": None if f.value is None else plain(f.value)} for f in quantities(x)], na_action="ignore")


@F.pandas_udf(QUANTITY)
def dates_of(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [f._asdict() for f in dates(x)], na_action="ignore")


number_text = _texts(_number_text)
kept_form = _texts(folded_but_kept)
salient_of = _arrays(salient_terms)
quantity_terms_of = _arrays(quantity_terms)


def normalized_as(profile: str):
    """A column function for a profile."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    return _texts(lambda x: normalized(x, profile))


def rules_of(profile: str):
    """A column function: the names of the rules of a profile that change a text."""
    return _arrays(lambda x: traced(x, profile)[1])
