"""NFKC as SQL: the twin of text.nfkc for engines that know NFC only.

NFKC is the composition of the compatibility decompositions of all characters.  Characters whose decomposition is one
character are translated, those with several are replaced one by one, the rest is left to nfc_normalize.  The tables
come from the Unicode data that Python ships; Hangul needs no row, as it composes canonically.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Parameters: blocks whose characters of several parts are replaced (fractions, ellipses, letter-like symbols, Roman
# numerals, enclosed letters, squared units), and the range that single characters are taken from.
_SEVERAL = ((0x00A0, 0x00BF), (0x0E00, 0x0EFF), (0x2000, 0x2070), (0x2100, 0x218F), (0x2460, 0x24FF), (0x3130, 0x33FF), (0xFB00, 0xFB06))
_SINGLE = ((0x00A0, 0x02FF), (0x2000, 0x33FF), (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFFEF))


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    single, several = {}, {}
    for blocks, out, fits in ((_SINGLE, single, lambda n: n == 1), (_SEVERAL, several, lambda n: n > 1)):
        for a, b in blocks:
            for o in range(a, b + 1):
                c = chr(o)
                tag = unicodedata.decomposition(c)
                flat = unicodedata.normalize("NFKD", c) if tag.startswith("<") else unicodedata.normalize("NFKC", c)
                if flat != c and fits(len(flat)) and (tag.startswith("<") or len(flat) == 1):
                    out[c] = unicodedata.normalize("NFKC", flat) if len(unicodedata.normalize("NFKC", flat)) == len(flat) else flat
    return single, several


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def nfkc_sql(c: str) -> str:
    """An SQL expression for the NFKC of the SQL expression *c*; null for null."""
    single, several = _tables()
    chain = c
    for a, b in several.items():
        chain = f"replace({chain},{_quoted(a)},{_quoted(b)})"
    some = f"regexp_matches({c},'[{''.join(several)}]')"
    return f"nfc_normalize(translate(CASE WHEN {some} THEN {chain} ELSE {c} END,{_quoted(''.join(single))},{_quoted(''.join(single.values()))}))"
