"""Sentence units by cascading segmentation rules.

A text is looked at only in *candidate* places: after a run of closing marks, at a line break, at a space
in scripts written without marks, and at the joints of statements that follow each other unmarked.  A rule
is (break?, left, gap, right): regular expressions for what stands before the place, for the white space in
it, and for what follows.  The rules of a language are tried in order and the first that matches decides;
the tables of a language end in the tables common to its script.  A place inside a bracket or a quotation
of any length is never a candidate; rules about list lines and headings see the whole line.

Null, empty and blank texts have no units.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence, by language.
OPEN_ABBREVIATIONS = {
    "en": "e\\.g i\\.e approx vs no nos p pp fig figs sect sec rev ser ref maint mr mrs ms dr st vol ch eq ver cf incl max min est temp",
    "de": "z\\.\\s?B d\\.\\s?h ca bzw nr abb vgl s dr hr fr str tel max min ggf evtl inkl bspw sog u\\.\\s?a",
    "fr": "p\\.\\s?ex env fig réf p pp av art m mm mme dr n° no vol chap max min",
    "es": "pág págs fig aprox núm ref sr sra dr dra vol cap máx mín p\\.\\s?ej art",
    "ko": "no ver p fig",
    "hi": "सं डॉ श्री पृ क्र",
    "ja": "ver no p pp fig vol rev ref",
    "zh": "ver no p pp fig vol rev ref",
    "th": "มม กก ซม กม ม ก น พ ศ ค ดร เลขที่ ต อ จ no ver",
}
# Abbreviations that also close a sentence when the next word starts one.
CLOSING_ABBREVIATIONS = {
    "en": "etc a\\.m p\\.m dept inc ltd co corp jr sr",
    "de": "usw etc str",
    "fr": "etc",
    "es": "etc a\\.m p\\.m ud uds",
}
# First words of a Thai statement.
THAI_STARTS = "ตรวจสอบ ตรวจ บันทึก ปิด เปิด ห้าม หาก ถ้า เมื่อ กรุณา โปรด ควร อย่า ค่าที่ ให้ ต้อง ทำความสะอาด เปลี่ยน แจ้ง ติดต่อ รอ กด หมุน ถอด ใส่"
# Who may answer for a machine (the last word of an unmarked Japanese statement).
ROLES_JA = "安全委員 当直者 班長 設備課 品質担当 倉庫係 受付窓口 保守窓口 作業責任者 責任者 担当者 管理者 係長 課長 主任"

MARKS = ".!?。！？…।｡．॥‼⁇⁈⁉"
CLOSERS = "」』）)〕】］”\"»’›]〉》"
PAIRS = {"「": "」", "『": "』", "（": "）", "(": ")", "〔": "〕", "【": "】", "［": "］", "[": "]", "“": "”", "«": "»", "〈": "〉", "《": "》", "„": "“”"}

_LIST = r"(?:[・\-*•●◦▪‣–—*]\s|・|\d{1,2}[.)]\s|[(（]\d{1,2}[)）]\s)"
_HEAD_LATIN = r"(?:(?:Chapter|Section|Part|Appendix|Kapitel|Abschnitt|Chapitre|Capítulo|Sección)\s+\d+|(?:NOTE|WARNING|CAUTION|HINWEIS|ACHTUNG|ATTENTION|AVISO|NOTA)\s+[-–—:]|\d+(?:\.\d+)+\s)"
_HEAD_CJK = r"(?:第[\d一二三四五六七八九十百]+[章節条项節]|■|◆|●|□|【[^】]{1,20}】|\d+(?:\.\d+)+\s)"
_UP = r"(?:[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]|[a-z][A-Z]|[¿¡]|[\"“„«(](?:[A-ZÀ-ÖØ-Þ]|[a-z][A-Z]|[¿¡]|\s)|\d)"
_VERBS_JA = "清掃|点検|調整|交換|校正|記録|確認|注油|増し締め|取り外し|記入|連絡|報告|保管|廃棄|停止|使用|検査|測定|掃除|給油|設置|準備|提出"
_STATEMENT_JA = (
    rf"(?:の担当は(?:{'|'.join(ROLES_JA.split())})|以内に連絡|へ連絡|へ報告|の有無を見る|を切る|を入れる|を見る|を止める|を外す|を閉める|を開ける|再起動しない"
    rf"|[をに](?:{_VERBS_JA})する(?:こと)?|[をに](?:{_VERBS_JA})しない(?:こと)?|取り外しする(?:こと)?|と記入する|すること|しないこと)"
)
_GOES_ON_JA = r"(?!前|後(?!続)|際|時(?!間)|場合|為|度に|事|方|予定|必要|手順|人|者|日時|途中|直前|直後|間|箇所)"

Rule = tuple[bool, str, str, str]


def _abbr(words: str) -> str:
    return rf"(?i:(?<![^\W\d_])(?:{'|'.join(words.split())})\.)"


def _latin(lang: str) -> list[Rule]:
    rules: list[Rule] = [(False, _abbr(OPEN_ABBREVIATIONS[lang]), r"\s*", r"")]
    if lang == "de":
        months = "Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez"
        rules += [
            (False, r"(?<!\d)\d{1,2}\.", r"\s+", rf"(?:{months})"),
            (False, r"(?i:\b(?:am|vom|zum|den|dem|der|bis|im|ab|des)\s+\d{1,2}\.)", r"\s+", r"[A-ZÄÖÜ]"),
        ]
    if lang in CLOSING_ABBREVIATIONS:
        rules += [
            (True, _abbr(CLOSING_ABBREVIATIONS[lang]), r"\s+", r"(?!\d)" + _UP),
            (False, _abbr(CLOSING_ABBREVIATIONS[lang]), r"\s*", r""),
        ]
    return rules + [
        (False, r"(?<![^\W\d_])[A-Z]\.", r"\s?", r"[A-Z]\."),  # initials
        (True, r"[!?…]+", r"\s*", _UP + r"|[-*•]\s"),
        (True, r"[^\W\d_]{2}\.|[\d)%°\]]\.|[A-Z]\.|[.]{2,}", r"\s+", _UP + r"|[-*•]\s"),
        (True, r"(?:[a-zß-ÿ]{2}|\))\.", r"", r"(?:[A-ZÀ-Þ][a-zß-ÿ’]|[A-Z]\s|[A-Z][A-Z]+\d|[a-z][A-Z]|[¿¡])"),
        (True, r"[.!?…][\"”»)’]+", r"\s+", _UP),
    ]


def _common_lines(head: str) -> list[Rule]:
    """Line breaks of texts in Latin letters, Hangul and Devanagari."""
    return [
        (True, r"", r"\s*\n[^\S\n]*\n\s*", r""),
        (True, r"", r"\s*\n\s*", _LIST),
        (True, rf"(?:^|\n)\s*{_LIST}[^\n]*", r"\s*\n\s*", _UP + r"|[^\W\d_a-zß-ÿ]"),
        (True, rf"(?:^|\n)\s*{head}[^\n]*", r"\s*\n\s*", _UP + r"|[^\W\d_a-zß-ÿ]"),
    ]


_CJK_MARKS = r"[。｡！？!?…．‼⁇⁈⁉]"
_JA: list[Rule] = [
    (True, r"", r"\s*\n[^\S\n]*\n\s*", r""),
    (False, rf"{_CJK_MARKS}+", r"\s*", r"(?:と[^こもき]|[、，,をはがにへでのも]|って|とは|との|という|より)"),
    (False, r"…+", r"", r"と"),
    (False, _abbr(OPEN_ABBREVIATIONS["ja"]), r"\s*", r"[\dA-Za-z]"),
    (False, r"\d[.．]", r"", r"\d"),
    (False, r"[A-Za-z0-9][.]", r"", r"[A-Za-z0-9]"),
    (True, r"[。｡！？!?…‼⁇⁈⁉]+", r"\s*", r""),
    (True, r"[ぁ-んァ-ヴー一-龥々\u3099\u309a)）」』][.．]", r"\s*", r""),
    (True, r"[A-Za-z0-9][.．]", r"\s+", r"[ぁ-んァ-ヴ一-龥A-Z]"),
    (False, rf"{_CJK_MARKS}[」』）)〕】”\"]+", r"\s*", r""),
    (True, r"", r"\s*\n\s*", _LIST),
    (True, rf"(?:^|\n)\s*{_HEAD_CJK}[^\n]*", r"\s*\n\s*", r""),
    (True, rf"(?:^|\n)\s*{_HEAD_LATIN}[^\n]*", r"\s*\n\s*", r""),
    (True, rf"(?:^|\n)\s*{_LIST}[^\n]*(?:[ぅうくぐすつぬぶむるい]|こと|報告|連絡|\d[^\s\d、。ぁ-ん]{{0,3}})", r"\s*\n\s*", r""),
    (True, _STATEMENT_JA, r"\s*\n\s*", rf"{_GOES_ON_JA}[一-龥ァ-ヴーA-Z0-9ｦ-ﾟ]"),
    (True, _STATEMENT_JA, r"\s*", rf"{_GOES_ON_JA}[一-龥ァ-ヴA-Z0-9]"),
]
_ZH: list[Rule] = [
    (True, r"", r"\s*\n[^\S\n]*\n\s*", r""),
    (False, rf"{_CJK_MARKS}+", r"\s*", r"[、，,]"),
    (False, r"…+", r"", r"[^\s]"),
    (False, _abbr(OPEN_ABBREVIATIONS["zh"]), r"\s*", r"[\dA-Za-z]"),
    (False, r"\d[.．]", r"", r"\d"),
    (False, r"[A-Za-z0-9][.]", r"", r"[A-Za-z0-9]"),
    (True, r"[。｡！？!?…‼⁇⁈⁉]+", r"\s*", r""),
    (True, r"[一-龥)）”」][.．]", r"\s*", r""),
    (False, rf"{_CJK_MARKS}[”」』）)〕】\"]+", r"\s*", r""),
    (True, r"", r"\s*\n\s*", _LIST),
    (True, rf"(?:^|\n)\s*{_HEAD_CJK}[^\n]*", r"\s*\n\s*", r""),
    (True, rf"(?:^|\n)\s*{_HEAD_LATIN}[^\n]*", r"\s*\n\s*", r""),
    (True, rf"(?:^|\n)\s*{_LIST}[^\n]*", r"\s*\n\s*", r""),
]
_TH_START = "|".join(THAI_STARTS.split())
_TH: list[Rule] = [
    (True, r"", r"\s*\n[^\S\n]*\n\s*", r""),
    (False, _abbr(OPEN_ABBREVIATIONS["th"]), r"\s*", r"(?!" + _TH_START + r")"),
    (True, r"[!?…]+", r"\s*", r""),
    (True, r"", r"\s*\n\s*", _LIST),
    (True, rf"(?:^|\n)\s*(?:{_HEAD_LATIN}|{_HEAD_CJK})[^\n]*", r"\s*\n\s*", r""),
    (False, r"(?:^|\n|\s{2})\s*", r"\s*", r""),
    (False, r"(?:ซึ่ง|และ|หรือ|เพื่อ|ของ|ขณะ|จะ|ให้|ว่า|โดย|ใน|กับ|จาก)", r"\s*", r""),
    (True, r"", r"\s+", rf"(?:{_TH_START})"),
    (True, r"", r"\s+", r"เครื่อง\s?[A-Z0-9][A-Z0-9\-]*\s*(?:อยู่|ต้อง|มี|ถูก|ได้)"),
    (True, r"", r"\s+", r"(?:ฝ่าย|หัวหน้า|ผู้|ช่าง|ทีม|แผนก|พนักงาน)[ก-๛]{2,14}?(?:ต้อง|จะ|ควร|ได้)"),
    (True, r"(?:ทันที|ทุกครั้ง|ก่อนเริ่มงาน|กำลังหมุน|อยู่ในเกณฑ์|\d\s?นาที|หมายเลข\s\d+)", r"", rf"(?:{_TH_START}|เครื่อง\s|ฝ่าย|หัวหน้า)"),
    (True, r"[ก-๛]", r"\s*\n\s*", r"[A-Za-z]"),
]
_KO: list[Rule] = [
    (False, _abbr(OPEN_ABBREVIATIONS["ko"]), r"\s*", r"\d"),
    (False, r"\d[.]", r"", r"\d"),
    (False, r"[A-Za-z0-9][.]", r"", r"[A-Za-z0-9]"),
    (True, r"[가-힣)\]][.!?…]+|[.!?…]{2,}|[A-Za-z0-9%℃°][.!?]+", r"\s+", r""),
    (True, r"[가-힣)\]][.!?…]+", r"", r"[가-힣A-Z0-9\"“‘¿¡「]"),
    (True, r"[.!?…][\"”’)]+", r"\s+", r"[A-Z0-9\"“]|[가-힣]+(?:은|는|이|가|을|를|의|에서)\s"),
] + _common_lines(_HEAD_LATIN)
_HI: list[Rule] = [
    (False, _abbr(OPEN_ABBREVIATIONS["hi"]), r"\s*", r""),
    (False, r"\d[.]", r"", r"\d"),
    (True, r"[।॥!?…]+", r"\s*", r""),
    (True, r"[ऀ-ॿ]{2}[.]", r"\s+", r""),
] + _common_lines(_HEAD_LATIN)
CASCADES: dict[str, list[Rule]] = {lang: _latin(lang) + _common_lines(_HEAD_LATIN) for lang in ("en", "de", "fr", "es")} | {"ja": _JA, "zh": _ZH, "th": _TH, "ko": _KO, "hi": _HI}

_LOOK_BACK = 96  # longer than what any rule matches that does not begin at the start of its line
_WS = r"[\s\u3000]"


@lru_cache(maxsize=None)
def _compiled(lang: str) -> list[tuple[bool, re.Pattern | None, bool, re.Pattern, re.Pattern | None]]:
    """(break?, left, whether left begins at the line's start, gap, right) of each rule."""

    def part(p: str, tail: str) -> re.Pattern | None:
        return re.compile(rf"(?:{p}){tail}") if p else None

    return [(brk, part(left, r"\Z"), left.startswith(r"(?:^|\n)"), re.compile(rf"(?:{gap})\Z"), part(right, "")) for brk, left, gap, right in CASCADES[lang]]


_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_MARKED = re.compile("[\u0300-\u036f\u3099\u309a\uff9e\uff9f]")
_LIKE = dict(zip("АВЕЅКМНОРСТХУІаеорсхуіѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABESKMHOPCTXYIaeopcxyisABEZHIKMNOPTYXo", strict=True))


class _Fold(dict):
    """Each character as the rules know it, one for one: width forms, radicals and look-alike letters."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if c in _LIKE:
            v = _LIKE[c]
        elif c in "…．｡" or 0x3300 <= o < 0x3400 or 0x2460 <= o < 0x2500:
            v = "。" if c == "｡" else c
        else:
            v = unicodedata.normalize("NFKC", c)
            v = v if len(v) == 1 else c
        self[o] = v
        return v


_FOLD = _Fold()
_CANDIDATE = re.compile(rf"[{re.escape(MARKS)}]+(?:[{re.escape(CLOSERS)}]+)?{_WS}*|{_WS}*\n{_WS}*")
_CANDIDATE_TH = re.compile(rf"[!?…]+[{re.escape(CLOSERS)}]*{_WS}*|{_WS}+|(?=(?:{_TH_START}|เครื่อง|ฝ่าย|หัวหน้า|ผู้|ช่าง|ทีม|แผนก|พนักงาน))")
_JOINT_JA = re.compile(rf"(?<=[るいす者員長課当係口任絡告と])(?={_GOES_ON_JA}[ \u3000]?[一-龥ァ-ヴA-Z0-9])|(?<=[るいす者員長課当係口任絡告と])[ \u3000]+(?=[一-龥ァ-ヴA-Z0-9])")
_WORDS = {
    "de": re.compile(r"(?i)\b(?:der|die|das|ist|und|am|im|nicht|wird|bei|siehe|gehört|gehören|steht|beträgt|für|den|mit|zur|zum|ein|eine|auf)\b"),
    "fr": re.compile(r"(?i)\b(?:le|la|les|est|et|du|des|un|une|dans|pour|voir|vérifiez|en|pas|ne|sans|près|reste|jamais)\b|[ld]’"),
    "es": re.compile(r"(?i)\b(?:el|la|los|las|está|y|del|un|una|es|si|hay|no|cada|en|avise|revise|véase|se|para|con|que|toque)\b|[¿¡]"),
    "en": re.compile(r"(?i)\b(?:the|is|and|of|to|in|for|not|has|at|you|with|a|an|after|before|must|never|need|signs)\b"),
}
_SCRIPTS = {"th": re.compile(r"[ก-๛]"), "hi": re.compile(r"[ऀ-ॿ]"), "ko": re.compile(r"[가-힣ㄱ-ㆎ]"), "kana": re.compile(r"[ぁ-んァ-ヴｦ-ﾝ]"), "han": re.compile(r"[一-龥㐀-䶵々]"), "latin": re.compile(r"[A-Za-zÀ-ÿ]")}


def language(text: str) -> str:
    """The language whose rules apply, from scripts and, for Latin letters, frequent words. Of ties the earlier wins."""
    n = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    best = max(("th", "hi", "ko"), key=lambda k: n[k])
    cjk = n["kana"] + n["han"]
    if n[best] > max(cjk, 0) and n[best] * 4 > n["latin"]:
        return best
    if cjk and cjk * 4 > n["latin"]:
        return "ja" if n["kana"] * 8 >= cjk else "zh"
    hits = {k: len(p.findall(text)) for k, p in _WORDS.items()}
    if re.search(r"[äöüßÄÖÜ]", text):
        hits["de"] += 2
    if re.search(r"[èêàùçœ«»]", text):
        hits["fr"] += 2
    if re.search(r"[ñ¿¡]", text):
        hits["es"] += 3
    return max(("en", "de", "fr", "es"), key=lambda k: hits[k])


_BRACKETS = re.compile(f"[{re.escape(''.join(PAIRS))}{re.escape(''.join(PAIRS.values()))}\"]|\\n\\n")


def _inside(text: str) -> list[tuple[int, int]]:
    """Spans (open, close) of matched brackets and quotations, outermost only; none goes over a blank line.

    Every kind is matched on its own in one pass, so the work is linear and a span may be of any length.
    """
    waiting: dict[str, list[int]] = {c: [] for c in PAIRS}
    straight: int | None = None
    found: list[tuple[int, int]] = []
    for m in _BRACKETS.finditer(text):
        i, c = m.start(), m.group()
        if c == "\n\n":
            for stack in waiting.values():
                stack.clear()
            straight = None
            continue
        if c == '"':
            if straight is None:
                straight = i
            else:
                found.append((straight, i))
                straight = None
            continue
        for opening, closing in PAIRS.items():
            if c in closing:
                if waiting[opening]:
                    found.append((waiting[opening].pop(), i))
            elif c == opening:
                waiting[opening].append(i)
    spans: list[tuple[int, int]] = []
    for i, j in sorted(found):
        if not spans or i > spans[-1][1]:
            spans.append((i, j))
    return spans


def _skeleton(text: str) -> tuple[str, list[int] | None]:
    if not _INVISIBLE.search(text) and not _MARKED.search(text):
        return text.translate(_FOLD), None
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        if _INVISIBLE.match(c):
            continue
        c = {"ﾞ": "\u3099", "ﾟ": "\u309a"}.get(c, _FOLD[ord(c)])
        if out and (unicodedata.combining(c)):
            both = unicodedata.normalize("NFC", out[-1] + c)
            if len(both) == 1:
                out[-1] = both
                continue
        out.append(c)
        at.append(i)
    return "".join(out), at


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of the text, in code points; null or blank: none."""
    if not text or text.isspace():
        return []
    s, at = _skeleton(text)
    n = len(s)
    lang = language(s)
    places: dict[int, int] = {}  # start of the right side: end of the left side
    pattern = _CANDIDATE_TH if lang == "th" else _CANDIDATE
    for m in pattern.finditer(s):
        p = m.end()
        e = m.start() + len(m.group().rstrip())
        if 0 < e and p < n:
            places.setdefault(p, e)
    if lang == "ja":
        for m in _JOINT_JA.finditer(s):
            places.setdefault(m.end(), m.start())
    cuts = [0]
    if places:
        spans = _inside(s)
        rules = _compiled(lang)
        latin = _compiled("en") if lang in ("ja", "zh", "th", "ko", "hi") else None
        cjk = _compiled("ja") if lang in CASCADES and lang not in ("ja", "zh", "th") else None
        k = 0
        for p in sorted(places):
            e = places[p]
            while k < len(spans) and spans[k][1] < e - 1:
                k += 1
            if k < len(spans) and spans[k][0] < e - 1 < spans[k][1] and p <= spans[k][1]:
                continue
            for a, _ in spans[k : k + 2]:
                if a < e and s[a] == '"' and s[a - 1] in MARKS:  # a quotation that opens right after the mark
                    e = p = a
            own = rules
            if latin and not _far(s, e, p, lang):
                own = latin
            elif cjk and s[e - 1] > "\u3000" and (s[e - 1] in "。！？" or "ぁ" <= s[e - 1] <= "龥"):
                own = cjk
            left = s[max(cuts[-1], e - _LOOK_BACK) : e]
            if cuts[-1] >= e - _LOOK_BACK:
                left = "\n" + left
            line: str | None = None
            gap = s[e:p]
            for brk, lp, whole, gp, rp in own:
                if not gp.match(gap) or (rp is not None and not rp.match(s, p)):
                    continue
                if whole and line is None:
                    start = s.rfind("\n", cuts[-1], e)
                    line = "\n" + s[(start + 1 if start >= 0 else cuts[-1]) : e]
                if lp is None or lp.search(line if whole else left):
                    if brk:
                        cuts.append(p)
                    break
    cuts.append(n)
    if at is not None:
        cuts = [0] + [at[c] for c in cuts[1:-1]] + [len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        tail = len(piece.rstrip())
        if tail > lead:
            out.append((a + lead, a + tail))
    return out


def _far(s: str, e: int, p: int, lang: str) -> bool:
    """Whether the place stands among the characters of the text's own script rather than in Latin words."""
    around = s[max(0, e - 16) : e] + s[p : p + 8]
    return not re.search(r"[a-zß-ÿ]{3,}[^ぁ-龥가-힣ก-๛ऀ-ॿ]{0,6}$", s[max(0, e - 16) : e]) or bool(re.search(r"[ぁ-龥가-힣ก-๛ऀ-ॿ]", around))


def _batches(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src: list[int] = []
            start: list[int] = []
            end: list[int] = []
            no: list[int] = []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for k, (x, y) in enumerate(units(t)):
                    src.append(i)
                    no.append(k)
                    start.append(x)
                    end.append(y)
            kept = pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keys))], names=keys).take(pa.array(src, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=[*keys, "unit_no", "start_char", "end_char"])

    return run


def sentence_units(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per sentence unit of column *text*: the keys, unit_no, start_char, end_char (code points, end exclusive).

    A narrow operator: no shuffle, one Arrow pass, each text read whole.  Rows with null or blank text give no row;
    repeated rows give their units as often as they occur; columns other than the keys are not read.
    """
    from pyspark.sql import types as T

    kept = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text")).filter(F.col("__text").isNotNull())
    schema = T.StructType([*[f for f in kept.schema.fields if f.name in keys], T.StructField("unit_no", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    return kept.mapInArrow(_batches(keys), schema)
