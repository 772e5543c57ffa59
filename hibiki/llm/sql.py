"""SQL of the queries of this folder that SQL can say.

Sentences (1), pair defects (2) and abuse (9) are learned or read by rules that SQL has no words for; the token sizes of
packing (7) and mixing (8) need a tokenizer.  They are tested against brute force, goldens and held-out labels.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from ..plans.folding import nfkc_sql
from .lookalike import LOOK_ALIKES

# ------------------------------------------------------------------------------------------------ 4, leaks

_LETTERS = lambda c: f"lower(regexp_replace({nfkc_sql(c)}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_LEAKS = f"""WITH raw AS (SELECT 'semantic_challenge_v2_cases' AS item_table, case_id AS item_id, query AS x FROM semantic_challenge_v2_cases UNION ALL SELECT 'approved_qa_alias_fixture', qa_id, question FROM approved_qa_alias_fixture
UNION ALL SELECT 'approved_qa_alias_fixture', qa_id, unnest(approved_aliases) FROM approved_qa_alias_fixture), items AS (SELECT DISTINCT item_table, item_id, {_LETTERS('x')} AS s FROM raw WHERE x IS NOT NULL AND item_id IS NOT NULL),
texts AS (SELECT DISTINCT s, length(s) AS n, (7 * length(s) + 9) // 10 AS need FROM items WHERE s <> ''), cores AS (SELECT *, substr(s, n - need + 1, 2 * need - n) AS core FROM texts),
docs AS (SELECT doc_id, {_LETTERS('text')} AS d FROM documents WHERE text IS NOT NULL),
near AS (SELECT doc_id, d, s, n, need FROM docs JOIN cores ON contains(d, core)),
held AS (SELECT DISTINCT doc_id, s FROM near WHERE len(list_filter(range(1, n - need + 2), lambda i: contains(d, substr(s, i, need)))) > 0),
found AS (SELECT DISTINCT doc_id, item_table, item_id FROM held JOIN items USING (s))"""

# ------------------------------------------------------------------------------------------------ 5, look-alikes

_HIDDEN = "[\\p{Cf}\\x{034F}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{3164}\\x{FFA0}\\x{180B}-\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"


@lru_cache(maxsize=1)
def _looks() -> tuple[dict[str, str], dict[str, str]]:
    """What each character looks like, by rule: (one character for one, several for one); worked out apart from the operator."""
    like = {a: b for these, those in LOOK_ALIKES.values() for a, b in zip(these, those, strict=True)}
    one, more = {}, {}
    for o in range(0x80, 0x10000):
        c = chr(o)
        if unicodedata.category(c) in ("Cs", "Cn", "Cf", "Mn") or 0xAC00 <= o <= 0xD7A3:
            continue
        tag = unicodedata.decomposition(c).split(" ")[0]
        wide = tag in ("<wide>", "<narrow>") or 0x2E80 <= o <= 0x2FDF or 0xFF00 <= o <= 0xFFEF or o == 0x2011
        seen = " " if unicodedata.category(c) == "Zs" else "".join(like.get(x, x) for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c) if wide else c))
        seen = unicodedata.normalize("NFC", seen)
        if seen != unicodedata.normalize("NFC", c):
            (one if len(seen) == 1 else more)[c] = seen
    return one, more


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form(c: str) -> str:
    one, more = _looks()
    out = f"translate(regexp_replace({c}, '{_HIDDEN}', '', 'g'), {_q(''.join(one))}, {_q(''.join(one.values()))})"
    for a, b in more.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize({out})"


_FIELDS = (("semantic_challenge_v2_cases", "query"), ("semantic_challenge_v2_chunks", "text"), ("manufacturing_chunks", "normalized_question"))
_ALIKE = "WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' AS src_table, row_no, {c} AS v FROM {t} WHERE {c} IS NOT NULL" for t, c in _FIELDS) + f"), f AS (SELECT src_table, row_no, v, {_form('v')} AS form FROM r)"

# ------------------------------------------------------------------------------------------------ 6, format copies

_SPACES = "[\\t\\n\\x{0b}\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _same(c: str) -> str:
    """A value without white space, letter case and punctuation, marks between two digits aside."""
    runs = f"regexp_extract_all(lower(regexp_replace({c}, '{_SPACES}', '', 'g')), '\\p{{P}}+|[^\\p{{P}}]+')"
    kept = "CASE WHEN regexp_matches(t[i], '^\\p{P}') AND NOT (i > 1 AND i < len(t) AND regexp_matches(t[i - 1], '\\p{Nd}$') AND regexp_matches(t[i + 1], '^\\p{Nd}')) THEN '' ELSE t[i] END"
    return f"list_transform([{runs}], lambda t: array_to_string(list_transform(range(1, len(t) + 1), lambda i: {kept}), ''))[1]"


_PAIR = lambda c: f"coalesce('v' || {_same(c)}, 'null')"
_VALUE = "json_extract_string(payload, '$.\"' || k || '\"')"
_COPIES = f"""WITH m AS (SELECT 'manufacturing_chunks' AS src_table, row_no AS key, {_PAIR('tenant_id')} || chr(1) || {_PAIR('normalized_question')} AS g FROM manufacturing_chunks WHERE normalized_question IS NOT NULL),
a AS (SELECT 'approved_qa_alias_fixture' AS src_table, row_no AS key, {_PAIR('tenant_id')} || chr(1) || {_PAIR('question')} AS g FROM approved_qa_alias_fixture),
p AS (SELECT submission_id, payload, unnest(json_keys(payload)) AS k FROM approved_qa_submissions WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
s AS (SELECT 'approved_qa_submissions' AS src_table, submission_id AS key, string_agg(k || '=' || {_PAIR(_VALUE)}, chr(1) ORDER BY k) AS g FROM p GROUP BY submission_id),
u AS (SELECT * FROM m UNION ALL SELECT * FROM a UNION ALL SELECT * FROM s), w AS (SELECT src_table, key, min(key) OVER (PARTITION BY src_table, g) AS first FROM u)"""

SQL: dict[str, str] = {
    "p4_found": f"{_LEAKS} SELECT doc_id, item_table, item_id FROM found",
    "p4_leaked_items": f"{_LEAKS} SELECT item_table, item_id, count(*) AS n_docs FROM found GROUP BY 1, 2",
    "p5_found": f"{_ALIKE} SELECT DISTINCT a.src_table, a.row_no AS row_a, b.row_no AS row_b FROM f a JOIN f b ON a.src_table = b.src_table AND a.form = b.form AND a.v <> b.v AND a.row_no < b.row_no",
    "p5_forms": f"{_ALIKE} SELECT src_table, row_no, form FROM f",
    "p6_found": f"{_COPIES} SELECT DISTINCT src_table, first AS row_a, key AS row_b FROM w WHERE key <> first",
    "p6_records": f"{_COPIES} SELECT src_table, first AS row_no, count(DISTINCT key) AS n_copies FROM w GROUP BY 1, 2",
}
