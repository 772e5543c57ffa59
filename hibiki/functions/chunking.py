"""Shaping texts into chunks, as Arrow functions: wrapped lines, target sizes, sentence windows, questions and answers, rows of tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_END = re.compile(r"[。．.!！?？:：」』）)]$")
_ALONE = re.compile(r"^(?:[・\-*•■◆●【]|\d+[.)．、]|[(（]\d+[)）]|[QAＱＡ問答][.:：．]|第\d+)|\||\t|^[\d\s.,%]+$")
_SENTENCE = re.compile(r"[^。！？!?\n]*(?:[。！？!?]+[」』）)]*|\n+|$)")


def join_wrapped(text: str, short: int = 8) -> str:
    """Lines broken in the middle of a sentence put together again; closed, listed and short lines stay."""
    out: list[str] = []
    for block in re.split(r"\n\s*\n", text):
        lines: list[str] = []
        for line in (x.strip() for x in block.split("\n")):
            if not line:
                continue
            before = lines[-1] if lines else ""
            if before and not _END.search(before) and not _ALONE.search(before) and not _ALONE.search(line) and len(before) > short:
                if before.endswith("-") and line[:1].islower():
                    lines[-1] = before[:-1] + line
                else:
                    lines[-1] = before + (" " if before[-1].isascii() and line[0].isascii() else "") + line
            else:
                lines.append(line)
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out)


def sentences(text: str) -> list[str]:
    return [x.strip() for x in _SENTENCE.findall(text) if x.strip()]


def target_chunks(text: str, most: int = 400, overlap: int = 80, least: int = 80) -> list[str]:
    """Paragraphs gathered up to *most* characters, long ones by sentences, endless sentences by windows; a short tail joins its neighbour up to 1.25 times most."""
    pieces: list[str] = []
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if len(para) <= most:
            pieces += [para] if para else []
            continue
        for s in sentences(para):
            pieces += [s] if len(s) <= most else [s[i : i + most] for i in range(0, max(1, len(s) - overlap), most - overlap)]
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + 1 + len(p) <= most:
            out[-1] += "\n" + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < least and len(out[-2]) + 1 + len(out[-1]) <= 1.25 * most:
        out[-2:] = [out[-2] + "\n" + out[-1]]
    return out


def sentence_windows(text: str, chars: int = 200, overlap: float = 0.2) -> list[str]:
    """Windows of whole sentences of about *chars* characters; the next begins with the last sentences that fit the overlap."""
    parts, out, i = sentences(text), [], 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j]) <= chars):
            size += len(parts[j])
            j += 1
        out.append("".join(parts[i:j]))
        if j >= len(parts):
            break
        back, kept = j, 0
        while back - 1 > i and kept + len(parts[back - 1]) <= chars * overlap:
            back -= 1
            kept += len(parts[back])
        i = back
    return out


_Q, _A = re.compile(r"^\s*(?:Q|Ｑ|問|質問)\s*\d*\s*[.:：．、]\s*"), re.compile(r"^\s*(?:A|Ａ|答|回答)\s*\d*\s*[.:：．、]\s*")


def faq_pairs(text: str) -> list[tuple[str, str]]:
    """(question, answer) of marked questions and answers; wrapped lines belong to what they follow."""
    out: list[list[str]] = []
    side = None
    for line in text.split("\n"):
        if _Q.match(line):
            out.append([_Q.sub("", line).strip(), ""])
            side = 0
        elif _A.match(line) and out:
            out[-1][1] = (out[-1][1] + "\n" + _A.sub("", line).strip()).strip()
            side = 1
        elif line.strip() and out and side is not None:
            out[-1][side] = (out[-1][side] + ("\n" if side else "") + line.strip()).strip()
    return [(q, a) for q, a in out if q and a]


def table_rows(text: str, title: str = "") -> list[str]:
    """Lines with bars as rows under the first of them: title / head=value / ..."""
    rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in text.split("\n") if x.count("|") >= 1 and not re.fullmatch(r"[\s|:\-]+", x)]
    if len(rows) < 2:
        return []
    head = rows[0]
    return [" / ".join(([title] if title else []) + [f"{h}={v}" for h, v in zip(head, r, strict=False) if v]) for r in rows[1:]]


def _strings(f):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run


@F.pandas_udf(T.StringType())
def joined_of(s: pd.Series) -> pd.Series:
    return s.map(join_wrapped, na_action="ignore")


chunks_of = _strings(target_chunks)
windows_of = _strings(sentence_windows)
table_rows_of = _strings(table_rows)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())])))
def faq_of(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"question": q, "answer": a} for q, a in faq_pairs(x)], na_action="ignore")
