"""Text functions as Spark expressions: normal forms, keys, tokens, masks and estimates.

All are null-safe (null in, null out) and stay in the JVM.  Patterns are written with explicit classes that mean
the same in every regular expression dialect.  NFKC comes from the ICU library that Spark ships for its collations;
Spark counts a call by name as not deterministic, so a normal form must be a column before it is joined on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\f\x{0b}\x{85}\x{2028}\x{2029}\x{3000}\x{a0}]+"
KATAKANA, KANJI, HIRAGANA = r"\x{30A1}-\x{30F4}\x{30FC}", r"\x{4E00}-\x{9FA5}\x{3005}\x{3006}\x{3024}", r"\x{3041}-\x{3093}"
QUOTED = r"[\x{300C}\x{300E}\x{201C}\x{22}]([^\x{300D}\x{300F}\x{201D}\x{22}]+)[\x{300D}\x{300F}\x{201D}\x{22}]"
CODE = r"[a-z0-9][a-z0-9._:/-]{1,}"
CODE_TAIL = r"[._:/-]+$"
COMPACT = rf"[^0-9a-z{HIRAGANA}{KATAKANA}{KANJI}]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
BAD = r"[\x{FFFD}\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}]"
LETTER = rf"[A-Za-z\x{{C0}}-\x{{24F}}{HIRAGANA}{KATAKANA}{KANJI}\x{{AC00}}-\x{{D7A3}}\x{{0E01}}-\x{{0E5B}}\x{{0900}}-\x{{097F}}]"
PUNCT = r"[\p{P}\p{S}\p{Z}\x{30FC} \t\n\r\f]"
WIDE = r"[\x{1100}-\x{11FF}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}]"


# Dashes and quotation marks, and what they become; wave marks.
DASHES_AND_QUOTES = ("‐‑‒–—―−’‘‛“”„‟", "-------" + "'" * 3 + '"' * 4)
WAVES = ("〜～", "~~")


def nfkc(c: Column) -> Column:
    """Width and compatibility forms folded, marks composed; ASCII texts are passed by."""
    called = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(True))
    return F.when(F.octet_length(c) > F.length(c), called).otherwise(c)


def text_form(c: Column) -> Column:
    """NFKC with dashes and quotation marks folded, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(nfkc(c), *DASHES_AND_QUOTES), WS, " "))


def index_form(c: Column) -> Column:
    """text_form in lower case."""
    return F.lower(text_form(c))


def match_form(c: Column) -> Column:
    """index_form with wave marks folded."""
    return F.translate(index_form(c), *WAVES)


def evidence_key(c: Column) -> Column:
    """index_form without white space."""
    return F.regexp_replace(index_form(c), WS, "")


def strong_key(c: Column) -> Column:
    """index_form without punctuation, symbols, dashes, long-vowel marks and spaces."""
    return F.regexp_replace(index_form(c), PUNCT, "")


def quoted_terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))


def code_tokens(c: Column) -> Column:
    """Codes of letters, digits and separators, at least two characters after trailing separators go, in order, distinct; with their forms without separators."""
    raw = F.transform(F.regexp_extract_all(F.lower(c), F.lit(CODE), F.lit(0)), lambda t: F.regexp_replace(t, CODE_TAIL, ""))
    kept = F.filter(raw, lambda t: F.length(t) >= 2)
    return F.array_distinct(F.flatten(F.transform(kept, lambda t: F.array(t, F.regexp_replace(t, r"[._:/-]", "")))))


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once, also where a lambda inside refers to it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def char_bigrams(c: Column) -> Column:
    """Two-character windows in order; a text of one character or none has no window.  Linear in the length."""
    pairs = let(F.split(c, ""), lambda a: F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.concat(x, y)))
    return F.when(F.length(c) >= 2, pairs).when(c.isNotNull(), F.array().cast("array<string>"))


def heuristic_tokens(c: Column) -> Column:
    """Quoted terms, codes, katakana runs, kanji runs and bigrams of the compacted text; short hiragana dropped; distinct, in order."""
    return let(index_form(c), _tokens_of)


def _content_bigrams(c: Column) -> Column:
    """char_bigrams without those of hiragana only, told by comparison: a pattern per bigram would be the greater part of the work."""
    kana = lambda x: (x >= "\u3041") & (x <= "\u3093")
    pair = lambda x, y: F.when(kana(x) & kana(y), F.lit(None)).otherwise(F.concat(x, y))
    return let(F.split(c, ""), lambda a: F.array_compact(F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), pair)))


def _tokens_of(s: Column) -> Column:
    codes = F.filter(F.transform(F.regexp_extract_all(s, F.lit(CODE), F.lit(0)), lambda t: F.regexp_replace(t, CODE_TAIL, "")), lambda t: F.length(t) >= 2)
    runs = F.concat(F.regexp_extract_all(s, F.lit(rf"[{KATAKANA}]{{2,}}"), F.lit(0)), F.regexp_extract_all(s, F.lit(rf"[{KANJI}]{{2,}}"), F.lit(0)))
    words = F.concat(F.filter(quoted_terms(s), lambda t: ~t.rlike(rf"^[{HIRAGANA}]{{1,3}}$")), codes, runs)
    return F.array_distinct(F.concat(words, _content_bigrams(F.regexp_replace(s, COMPACT, ""))))


def mask_pii(c: Column) -> Column:
    """E-mail addresses as [email], digits as #."""
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[email]"), "[0-9]", "#")


def is_garbled(c: Column) -> Column:
    """More than 2 % replacement or control characters, or fewer than 10 % letters; null for null, true for empty."""
    n = F.length(c)
    bad = n - F.length(F.regexp_replace(c, BAD, ""))
    letters = n - F.length(F.regexp_replace(c, LETTER, ""))
    return F.when(c.isNull(), None).when(n == 0, True).otherwise((bad > 0.02 * n) | (letters < 0.1 * n))


def token_estimate(c: Column) -> Column:
    """Half the wide characters plus a quarter of the others plus one, in whole numbers."""
    wide = F.length(c) - F.length(F.regexp_replace(c, WIDE, ""))
    return (F.floor(wide / 2) + F.floor((F.length(c) - wide) / 4) + 1).cast("long")


def hash_share(key: Column, seed: str, buckets: int = 10_000) -> Column:
    """A number in 0..buckets-1 from the first eight hex digits of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def fixed_windows(c: Column, size: int, overlap: int) -> Column:
    """array<struct<no, start, piece>>: windows of size characters that share overlap; an empty text has none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in 0..size-1")
    step = size - overlap
    n = F.when(F.length(c) == 0, 0).when(F.length(c) <= size, 1).otherwise(F.ceil((F.length(c) - overlap) / step)).cast("int")
    piece = lambda i: F.struct(i.alias("no"), (i * step).alias("start"), F.substring(c, i * step + 1, F.lit(size)).alias("piece"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), piece)).when(c.isNotNull(), F.array().cast("array<struct<no:int,start:int,piece:string>>"))


# Words that say nothing by themselves.
STOP_TERMS = ("です", "ます", "ください", "下さい", "何で", "何です", "原因", "概要", "説明", "ある", "いる", "する", "なる", "できる", "思う", "言う", "こと", "もの", "とき", "ため", "よう", "これ", "それ", "あれ", "どれ", "ここ", "そこ", "どこ")
CONTENT = rf"{CODE}|[{KATAKANA}]{{2,}}|[{KANJI}]{{2,}}"


def content_terms(c: Column) -> Column:
    """Codes and words, katakana and kanji runs of the index form, in order, distinct, without stop terms."""
    return F.array_distinct(F.filter(F.regexp_extract_all(index_form(c), F.lit(CONTENT), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_TERMS)))


def match_words(c: Column) -> Column:
    """The words of the index form with punctuation of any kind as white space."""
    return F.filter(F.split(F.regexp_replace(index_form(c), r"[\p{P}\p{S} \t\n\r]+", " "), " "), lambda t: t != "")


def without_endings(c: Column, endings: list[str], passes: int = 3) -> Column:
    """The text without colloquial endings (patterns), stripped up to *passes* times, trimmed; never emptied."""
    pattern = f"(?:{'|'.join(endings)})[?？。!！]*$"
    out = F.trim(c)
    for _ in range(passes):
        shorter = F.trim(F.regexp_replace(out, pattern, ""))
        out = F.when(shorter != "", shorter).otherwise(out)
    return out


def overlap_share(a: Column, b: Column) -> Column:
    """The share of the distinct characters of a that b has; null for null, 0 for an empty a."""
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    return F.when(a.isNotNull() & b.isNotNull(), F.round(F.size(F.array_intersect(chars(a), chars(b))) / F.greatest(F.size(chars(a)), F.lit(1)), 6))
