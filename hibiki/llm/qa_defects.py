"""Defective prompt and response pairs: empty, truncated, refusal, copies_question, other_language.

Openings of the responses (their first *width* characters, codes and numbers masked) are clustered by verified MinHash.
A cluster that recurs under unrelated prompts is a template; sound answers have templates too, so a template is named a
refusal if half its answers talk of the exchange itself in a hindering way.  Wording alone makes no refusal: an answer
whose opening does not recur is none, however it is worded.  Empty, copied, foreign and broken-off answers are told by
checks of the single pair, the last helped by the share of places at which the corpus closes a sentence after the same
clause, or the same token.

Nulls: a null answer is `empty`; a null question leaves only the checks that need no question; rows with a
null pair id are dropped.  A pair id with several versions gets the type of its worst version, in the order
empty, other_language, copies_question, refusal, truncated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, spread
from .sentences import _skeleton, language

# What stands for a missing answer.
PLACEHOLDERS = "n/a na nil none null nan tbd tba todo wip xxx ??? unknown pending placeholder undefined empty blank (blank) 未記入 未定 未入力 未回答 未設定 記入なし 回答なし 空欄 準備中 作成中 確認中 調査中 後日記入 待补充 暂无 无 待定 未填写 空 미정 없음 keine offen à compléter pendiente"
_EMPTY_WORDS = {re.sub(r"[\W_]+", "", w.lower()) for w in PLACEHOLDERS.split()} - {""}

# Wordings that decline to answer, by language; like the two lists below they only name a template.
REFUSALS = {
    "ja": [
        r"(?:お?答え|回答|お応え|お手伝い|ご?案内|提供|コメント|判断|ご?説明|返答|助言|対応)[^。「」]{0,14}(?:できません|できない(?:んです|のです|状況|です)|でき兼ね|出来ません|いたしかね|致しかね|しかね|控え|差し控え|ご遠慮|遠慮)",
        r"(?:答え|応え)(?:られません|られない(?:んです|のです|です)|かねます|ることはできません|ることができません)",
        r"(?:わかりかね|分かりかね|申し上げられ)",
        r"(?:AI|人工知能|言語モデル)(?:のため|なので|として|ですので)",
        r"回答を生成できません",
    ],
    "en": [
        r"\b(?:can(?:no|['’])t|can not|could not|couldn['’]t|unable to|not able to|won['’]t|will not|not allowed to|must decline|decline to|not comfortable|do not feel comfortable|don['’]t feel comfortable|not in a position to)\b[^.;]{0,30}\b(?:help|answer|assist|comment|provide|discuss|giv|respond|advise|share|fulfil|support|instructions|question|request)",
        r"\bno comment\b",
        r"\bas an? (?:ai|artificial|language model|large language)",
        r"\b(?:i|we) (?:have to|must|would rather|prefer to|would prefer to) (?:decline|not answer|pass)",
        r"\b(?:i am|i['’]m) (?:just |only )?an ai\b",
    ],
    "zh": [
        r"(?:无法|不能|不便|恕不|难以|不予|拒绝|没法|不可以)[^。，]{0,12}(?:回答|答复|解答|提供|协助|帮助|评论|说明|透露|讨论|给出|处理|作答|回应|判断)",
        r"(?:作为|我是)(?:一个|一名)?(?:AI|人工智能|语言模型)",
        r"无可奉告",
    ],
}
_REFUSE = re.compile("|".join(p for ps in REFUSALS.values() for p in ps), re.I)
# Talk of asking, answering, helping and of one's part in it, and hindrance.  Both are common in sound answers
# too; they count only in a cluster that recurs under unrelated prompts.
_EXCHANGE = re.compile(
    r"質問|問い?合わ?せ|回答|答え|応え|応じ|お手伝い|案内|コメント|判断|情報|返答|要望|依頼|助言|アドバイス|相談|お話し|話せ|役目|役割|立場|規約|方針|话题|问题|回答|答复|解答|信息|请求|帮助|协助|评论|建议|讨论|透露|职责|权限|规定|질문|답변|대답|도와|도움|요청|문의|조언|역할|คำถาม|ตอบ|ช่วย|คำขอ|คำแนะนำ|หน้าที่|सवाल|प्रश्न|उत्तर|जवाब|मदद|अनुरोध|सलाह|भूमिका"
    r"|(?i:\b(?:question|answer|request|help|assist|comment|inquir|enquir|discuss|guideline|polic|advise|advice|topic|subject|matter|my role|talk|frage|anfrage|antwort|beantwort|helfen|weiterhelfen|auskunft|auskünfte|thema|rat|aufgabe|richtlinie|répon|réponse|aider|demande|sujet|conseil|rôle|consigne|pregunta|respond|respuesta|contest|ayud|solicitud|tema|consej|papel|norma)\w*)"
)
_HINDER = re.compile(
    r"ません|の外|範囲外|対象外|できな|られな|しかね|かねま|控え|遠慮|申し訳|恐れ入|残念|不能|无法|不便|不予|拒|抱歉|遗憾|恕|没法|없|못|어렵|죄송|ไม่|ขออภัย|नहीं|क्षमा|माफ़"
    r"|(?i:\b(?:not|cannot|\w+n['’]t|unable|declin\w*|refus\w*|keeps?|prevents?|against|outside|beyond|sorry|unfortunately|nicht|kein\w*|leider|pas|désolée?|regrett\w*|malheureusement|no|lamentablemente|lamento|siento|sorry)\b)"
)
_CONDITION = re.compile(r"(?:場合|とき|時|際|たら|れば|なら)[はにもの、]?|(?i:\bif\b|\bwhen\b|\bwhenever\b|\bunless\b|\bin case\b|\bonce\b)|(?:如果|若|如|倘若|假如|当)")
_QUOTED = re.compile(r"「[^」]*」?|『[^』]*』?|“[^”]*”?|\"[^\"]*\"?|«[^»]*»?")
_CODE = re.compile(r"[A-Za-z0-9]*\d[A-Za-z0-9]*(?:[-.:/][A-Za-z0-9]+)*|[A-Z]{2,}(?:-[A-Z0-9]+)*|[ァ-ヴー]{4,8}(?=号機)")
_WRAP = re.compile(
    r"(?i)^\s*(?:q|question|re|質問|問|问题|问|ご質問)\s*[:：]|というご?質問(?:ですね|でしょうか|です)?|とのご?(?:質問|こと)(?:ですね|でしょうか|です)?|you are asking\s*:?|you asked\s*:?|is that your question|your question (?:is|was)\s*:?|\bright\?|您(?:的问题是|想问的是|问的是|是问)|是吗|对吗|ですね|でしょうか|ご質問"
)
_OPENS, _CLOSES = "「『（(〔【［[“«„", "」』）)〕】］]”»“"
_MARK = re.compile(r"[。.!?！？．｡…।]+[」』）)〕】］\]”»\"'’]*$")

# Endings that leave a statement open, by script.
_OPEN_JA = re.compile(r"(?:[はがをにでとへもや、，,・]|から|ので|のに|より|けど|ても|では|には|とは|ながら|つつ|ての|[^こ]との|の|て|し|き|り|か|ら|け|せ|め|え|れ|ない場合|場合|場合は|ため|際|前|後|および|または|かつ|[いっん])$")
_DONE_JA = re.compile(
    r"(?:ます|ません|です|でした|ました|ください|下さい|でしょう|こと|する|しない|した|ない|残す|ある|いる|なる|れる|せる|える|切る|見る|外す|戻す|まで|以下|以上|未満|以内|以降|のみ|だけ|可|不可|不要|必要|要|済み|受付|禁止|あり|なし|はい|いいえ|程度|前後|担当|係|課|長|者|口|員|[一-龥]{2}票|日報|記録|申請書|引継ぎ簿|[^\W\d_ぁ-んァ-ヴ一-龥%℃°]{1,4}|%|℃|°|\d+(?:個|本|台|回|日|分|時間|秒|年|か月|kg|mm|cm|m|L|V|MPa))$"
)
_OPEN_EN = re.compile(
    r"(?i)(?:[,;:(–—-]|\b(?:the|a|an|of|to|in|on|at|by|for|from|with|and|or|but|if|when|while|until|before|after|is|are|was|be|been|has|have|had|must|may|can|cannot|should|will|than|that|which|who|whose|only|as|into|see|its|their|your|these|between|unless|because|does|per|via|e\.g|i\.e|approx))\.?$"
)
_OPEN_ZH = re.compile(r"(?:[的为到和与及在请将把并以先再则从对向由被让使等于至或但而且若如因当，、；：,;:（(]|然后|应当|需要|必须|可以|不能|应|需|要|其|该|此)$")
_LIST_END = re.compile(r"(?:^|[\s；;。：:,、，])(?:\d{1,2}[.．、)）]|[①-⑳]|[-・•])\s*$")

SCHEMA = "question string, answer string, opening string, kind string, hint boolean, tail string, is_open int, final array<long>, places array<long>, closed array<long>"


def _plain(s: str) -> str:
    return re.sub(r"[\W_]+", "", s).casefold()


def _grams(s: str, n: int = 5) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)} or {s}


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _plain(_skeleton(answer)[0])
    return not bare or bare in _EMPTY_WORDS


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer gives back the question and, but for a wrapping phrase, nothing else."""
    q = _plain(question)
    a = _plain(_WRAP.sub(" ", answer))
    if not q or not a:
        return False
    if len(q) < 6:  # too short for shared windows: nothing but the question
        return a == q or a == q * 2
    gq, ga = _grams(q), _grams(a)
    if len(gq & ga) < 0.7 * len(gq):
        return False
    covered = np.zeros(len(a), bool)
    for i in range(len(a) - 4):
        if a[i : i + 5] in gq:
            covered[i : i + 5] = True
    rest = int(len(a) - covered.sum())
    return rest <= max(6, 0.2 * len(a))


_ZH_ONLY = re.compile(r"[的为这们请无须应该调检查维润滤压轮阀钟后记录询写断开关启动时间处员组门限么吗吧]")


def _tongue(s: str) -> tuple[str, float]:
    """(language, how sure) of a text without its codes, units and quoted or bracketed parts."""
    s = _QUOTED.sub(" ", s)
    s = re.sub(r"[（(〔\[][^）)〕\]]*[）)〕\]]?", " ", s)
    s = _CODE.sub(" ", s)
    hangul, kana, han = len(re.findall(r"[가-힣]", s)), len(re.findall(r"[ぁ-んァ-ヴ]", s)), len(re.findall(r"[一-龥]", s))
    words = re.findall(r"[^\W\d_ぁ-ヴ一-龥가-힣ก-๛ऀ-ॿー]{2,}", s)
    latin = sum(map(len, words))
    other = {"th": len(re.findall(r"[ก-๛]", s)), "hi": len(re.findall(r"[ऀ-ॿ]", s)), "ru": len(re.findall(r"[а-яА-Я]", s)), "ar": len(re.findall(r"[\u0600-\u06ff]", s))}
    most = max(other, key=lambda k: other[k])
    if other[most] >= 4 and other[most] > hangul + kana + han:
        return most, 1.0
    if hangul >= 3 and hangul > kana + han:
        return "ko", 1.0
    if kana + han >= 2 and (kana + han) * 3 >= latin:
        if kana >= max(2, 0.12 * (kana + han)):
            return "ja", 1.0
        zh = len(_ZH_ONLY.findall(s))
        return ("zh", 1.0) if zh >= 2 or (zh and han <= 6) else ("han", 0.3)
    if latin >= 10 and len(words) >= 3:
        return language(s), 1.0
    return "", 0.0


_FAMILY = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin"}
_LATIN_CUES = {
    "de": re.compile(r"(?i)\b(?:der|die|das|ist|und|nicht|wird|für|den|dem|mit|zuerst|bitte|sonst|bleibt|gilt|ein|eine|dann|von)\b|[äöüß]"),
    "fr": re.compile(r"(?i)\b(?:le|la|les|est|et|du|des|un|une|dans|pour|avant|puis|avec|sur|par|au)\b|[èêàçé]"),
    "es": re.compile(r"(?i)\b(?:el|la|los|las|está|y|del|un|una|es|para|con|por|antes|primero|debe)\b|[ñ¿¡áíóú]"),
    "en": re.compile(r"(?i)\b(?:the|is|and|of|to|in|for|not|has|at|with|a|an|after|before|then|no|must|when|first|be|are|it|you)\b"),
}


def is_foreign(question: str, answer: str) -> bool:
    """Whether the whole answer is in another language than the question."""
    (ql, qs), (al, sure) = _tongue(question), _tongue(answer)
    if qs < 1 or sure < 1:
        return False
    if _FAMILY.get(ql) and _FAMILY.get(al):
        hits = {k: len(p.findall(_CODE.sub(" ", answer))) for k, p in _LATIN_CUES.items()}
        best = max(hits, key=lambda k: hits[k])
        own = max(("en", "de", "fr", "es"), key=lambda k: len(_LATIN_CUES[k].findall(_CODE.sub(" ", question))))
        return best != own and hits[best] >= hits[own] + 2
    return ql != al


_ASIDE = re.compile(r"\s*[（(〔\[][^（）()〔〕\[\]]*[）)〕\]]$")
_CLOSED = re.compile(r"[。.!?！？．｡](?=\s|$|[ぁ-ヴ一-龥「」』）)A-Z])|\n")


def last_token(s: str) -> str:
    """The last word of Latin letters, else the last two characters; codes and numbers masked."""
    s = re.sub(r"[^\w§]+$", "", re.sub(r"\d+", "0", _CODE.sub("§", s[-60:])))
    m = re.search(r"[A-Za-zÀ-ÿ’']+$", s)
    return m.group().casefold() if m else s[-2:]


_TOKEN = re.compile(r"[A-Za-zÀ-ÿ’']+|\d+|\S")
_CLAUSE_END = frozenset("。.!?！？．｡;；:：,，、…।")


def places(answer: str) -> tuple[list[int], list[int], list[int]]:
    """(at the end, anywhere, before a closing mark): hashes of the masked clause so far and of the last token.

    Places at which the answer ends without a mark are only in the first list: they are what is asked about.
    """
    text = re.sub(r"[§]+", "§", _CODE.sub("§", _skeleton(answer)[0]).rstrip())
    stops = {m.start() for m in _CLOSED.finditer(text)}
    seen: set[int] = set()
    closed: set[int] = set()
    clause, before, final = 0, "", []
    for m in _TOKEN.finditer(text):
        word = m.group()
        if word in _CLAUSE_END:
            clause, before = 0, ""
            continue
        word = "0" if word.isdigit() else word.casefold()
        clause = hash_text(word, clause + 1 & 0xFFFFFFFFFFFFFFFF)
        token = hash_text(f"{before} {word}" if len(word) == 1 else word)
        before = word
        final = [clause - 2**63, token - 2**63]
        if m.end() == len(text):
            return final, sorted(seen), sorted(closed)
        seen.update(final)
        if m.end() in stops:
            closed.update(final)
        if text[m.end()] == "\n":
            clause, before = 0, ""
    return final, sorted(seen), sorted(closed)


def ending(answer: str) -> tuple[str, int]:
    """(last token, 1 open / 0 unknown / -1 closed) of how the answer ends."""
    s = _skeleton(answer)[0].rstrip()
    depth: list[str] = []
    for c in s:
        if c in _OPENS and not (c == "“" and depth and depth[-1] == "„"):
            depth.append(c)
        elif c in _CLOSES and depth:
            depth.pop()
    if s.count('"') % 2 and not re.search(r"\d\"", s):
        depth.append('"')
    tail = last_token(s)
    if not depth and _ASIDE.search(s) and len(_ASIDE.sub("", s)) > 3:
        inner = _ASIDE.sub("", s)
        return (tail, -1) if _MARK.search(inner) or _ASIDE.search(s).group().lstrip()[0] in "（〔" else ending(inner)
    if _LIST_END.search(s):
        return tail, 1
    if depth:
        return tail, 1
    if _MARK.search(s):
        return tail, 1 if re.search(r"(?i)\b(?:the|a|an|of|and|to|with|for|by)\.\.\.$|[、，,]…+$", s) else -1
    last = re.split(r"[。.!?！？．｡]\s*|\n", s)[-1].strip() or s
    lang = _tongue(s)[0] or ("ja" if re.search(r"[ぁ-ん]", last) else "")
    if lang in ("ja", "han") or (not lang and re.search(r"[ぁ-ん]", last)):
        if _DONE_JA.search(last):
            return tail, -1
        return tail, 1 if _OPEN_JA.search(last) else 0
    if lang == "zh":
        return tail, 1 if _OPEN_ZH.search(last) else 0
    if lang in _FAMILY:
        if _OPEN_EN.search(last) or re.search(r"[,;:]$", s):
            return tail, 1
    if len(re.findall(r"[^\W\d_]{2,}", last)) <= 3 and not re.search(r"[一-龥]", last):
        return tail, -1  # a short answer in words or a measure
    return tail, 0


def declines(answer: str) -> bool:
    """Whether the wording of the answer itself declines: quoted words, conditions and a way out that is offered do not."""
    s = _QUOTED.sub(" ", _skeleton(answer)[0])
    for m in _REFUSE.finditer(s):
        start = max(s.rfind(c, 0, m.start()) for c in "。.!?！？\n；;") + 1
        stop = min([i for i in (s.find(c, m.end()) for c in "。！？\n；;") if i >= 0] or [len(s)])
        before = s[start : m.end()]
        if _CONDITION.search(before) or re.match(r"[^。]{0,6}(?:場合|とき|時|際)", s[m.end() : m.end() + 10]):
            continue
        if stop >= start:
            return True
    return False


def hints(answer: str) -> bool:
    """Whether a sentence of the answer, quoted words and conditions aside, talks of the exchange in a hindering way."""
    parts = re.split(r"[。.!?！？\n；;]", _QUOTED.sub(" ", _skeleton(answer)[0]))
    return any(_EXCHANGE.search(p) and _HINDER.search(p) and not _CONDITION.search(p) for p in parts)


def opening(answer: str, width: int = 48) -> str:
    """The first *width* characters of an answer with codes and numbers masked; whole answers enter every other check."""
    s = re.sub(r"\s+", " ", _skeleton(answer)[0]).strip()
    s = _CODE.sub("N", s).casefold()
    return re.sub(r"\d+", "0", s)[:width]


def _examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for q, a in zip(pdf["question"], pdf["answer"], strict=True):
            kind, hint, head, tail, state, where = None, False, None, None, 0, ([], [], [])
            if is_empty(a):
                kind = "empty"
            else:
                head, hint = opening(a), declines(a) or hints(a)
                if q is not None and is_copy(_skeleton(q)[0], _skeleton(a)[0]):
                    kind = "copies_question"
                elif q is not None and is_foreign(_skeleton(q)[0], _skeleton(a)[0]):
                    kind = "other_language"
                tail, state = ending(a)
                if kind is None:
                    where = places(a)
            out.append((q, a, head, kind, hint, tail, state, *where))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


# --------------------------------------------------------------------------------------------- verified MinHash
HASHES, BAND = 64, 4


@lru_cache(maxsize=50_000)
def _shingles(s: str) -> np.ndarray:
    s = f" {s} "
    return np.unique(np.array([hash_text(s[i : i + 3]) for i in range(max(1, len(s) - 2))], np.uint64))


def hash_text(s: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.encode(), seed)


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(7)
    mul, add = rng.integers(1, 2**63, HASHES, np.uint64) | np.uint64(1), rng.integers(0, 2**63, HASHES, np.uint64)
    for pdf in batches:
        keys: list[str] = []
        bands: list[int] = []
        for s in pdf["opening"]:
            h = _shingles(s)
            sig = ((h[:, None] * mul + add) >> np.uint64(16)).min(0)
            for b in range(0, HASHES, BAND):
                keys.append(s)
                bands.append(hash_text(f"{b}:{sig[b : b + BAND].tobytes().hex()}") - 2**63)
        yield pd.DataFrame({"band": pd.Series(bands, dtype="int64"), "opening": pd.Series(keys, dtype="object")})


def _linked(first: list[str], second: list[str], similarity: float, width: int = 512) -> list[tuple[str, str]]:
    """Links between two lists, or within one given twice, that connect whatever their similar pairs connect."""
    texts = list(dict.fromkeys([*first, *second]))
    number = {t: i for i, t in enumerate(texts)}
    sets = [_shingles(t) for t in texts]
    size = np.array([len(x) for x in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)

    def block(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), len(grams)), np.float32)
        for k, i in enumerate(at):
            out[k, column[ends[i] - size[i] : ends[i]]] = 1
        return out

    root = np.arange(len(texts))
    links = []
    left, right = (np.array([number[t] for t in side]) for side in (first, second))
    for i in range(0, len(left), width):
        rows = left[i : i + width]
        x = block(rows)
        for j in range(0, len(right), width):
            columns = right[j : j + width]
            both = x @ block(columns).T
            for k, m in zip(*np.nonzero(both >= similarity * (size[rows][:, None] + size[columns] - both) - 1e-6), strict=True):
                u, v = rows[k], columns[m]
                while root[u] != u:
                    root[u] = u = root[root[u]]
                while root[v] != v:
                    root[v] = v = root[root[v]]
                if u != v:
                    root[max(u, v)] = min(u, v)
                    links.append((texts[rows[k]], texts[columns[m]]))
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, least) of links (u, v): every node but the least of its component, and that least.

    Alternating stars (Kiveris et al., 2014): neighbours are hooked to the least one, to the larger and to the smaller
    side in turn, until nothing changes, whatever the length of a chain; rounds grow with its logarithm.
    """

    def least(edges: DataFrame) -> DataFrame:
        return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")

    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = least(large)
        edges = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(edges, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = now


def opening_clusters(openings: DataFrame, similarity: float = 0.8, chunk: int = 1000) -> DataFrame:
    """(opening, cluster) of distinct openings: the least opening of the component of verified links.

    Two openings that share a band's bucket are linked if their shingle sets really have that Jaccard similarity.
    All pairs of a bucket are looked at, in chunks of about *chunk* openings so that no task holds a hot bucket;
    of the links found, each pair of chunks hands on only as many as keep its members connected.
    """
    bands = materialize(spread(openings).mapInPandas(_signatures, "band long, opening string"), "bands")
    sizes = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    parts = bands.join(sizes, "band").select("band", "opening", F.pmod(F.xxhash64("opening"), F.ceil(F.col("n") / chunk)).alias("part"))
    parts = parts.groupBy("band", "part").agg(F.sort_array(F.collect_list("opening")).alias("members"))
    other = parts.select("band", F.col("part").alias("part2"), F.col("members").alias("members2"))
    pairs = parts.join(other, "band").filter("part <= part2").select("members", "members2").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [link for x, y in zip(pdf["members"], pdf["members2"], strict=True) for link in _linked(list(x), list(y), similarity)]
            yield pd.DataFrame(found, columns=["u", "v"], dtype="object")

    links = materialize(pairs.mapInPandas(run, "u string, v string").distinct(), "links")
    found = components(links)
    return openings.join(found, openings["opening"] == found["node"], "left").select("opening", F.coalesce("least", "opening").alias("cluster"))


def prompt_likeness(rows: DataFrame) -> DataFrame:
    """(cluster, prompts, likeness) of distinct (cluster, question): the mean cosine of the trigram sets of two different prompts.

    Codes are left out.  The sum over all pairs follows from the sums by trigram, so the work is linear in the prompts.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace("question", _CODE.pattern, " ")), r"(?U)[\W_]+", "")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("bare") - 2)), lambda i: F.substring(F.col("bare"), i, F.lit(3))))
    rows = rows.select("cluster", bare.alias("bare")).select("cluster", grams.alias("grams"))
    n = rows.groupBy("cluster").agg(F.count("*").alias("prompts"))
    sums = rows.select("cluster", F.explode("grams").alias("gram"), (1 / F.sqrt(F.size("grams"))).alias("w")).groupBy("cluster", "gram").agg(F.sum("w").alias("s"))
    squares = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    return n.filter("prompts > 1").join(squares, "cluster").select("cluster", "prompts", ((F.col("squares") - F.col("prompts")) / (F.col("prompts") * (F.col("prompts") - 1))).alias("likeness"))


ORDER = ["empty", "other_language", "copies_question", "refusal", "truncated"]


def qa_defects(pairs: DataFrame, key: str, question: str, answer: str, similarity: float = 0.8, unrelated: float = 0.5, min_rate: float = 0.1) -> DataFrame:
    """(key, defect_type) of every defective pair, one type each.

    Distinct (question, answer) texts are examined once.  unrelated: a cluster's prompts are so if two of them have
    less than that likeness on average.  min_rate: an ending that no rule
    knows counts as broken off if at less than that share of the places with the same clause so far the answers close a
    sentence; the share at the same last token weighs as one place more.
    """
    rows = pairs.select(F.col(key).cast("string").alias("key"), F.col(question).cast("string").alias("question"), F.col(answer).cast("string").alias("answer")).filter("key is not null").distinct()
    rows = materialize(spread(rows), "pairs")
    seen = materialize(rows.select("question", "answer").distinct().mapInPandas(_examine, SCHEMA), "examined")
    heads = seen.filter("opening is not null").groupBy("opening").agg(F.count("*").alias("n"), F.sum(F.col("hint").cast("long")).alias("hints"))
    heads = materialize(heads, "openings")
    labels = materialize(opening_clusters(heads.select("opening"), similarity), "labels")
    hinting = labels.join(heads, "opening").groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("hints").alias("hints")).filter("2 * hints >= n").select("cluster")
    candidates = labels.join(hinting, "cluster")
    asked = seen.filter("question is not null").join(candidates, "opening").select("cluster", "question").distinct()
    asked = materialize(asked, "asked")  # else filters on the trigrams are pushed to all questions
    templates = prompt_likeness(asked).filter(F.col("likeness") < unrelated)
    declining = candidates.join(templates, "cluster").select("opening", F.lit(True).alias("template"))
    unsure = seen.filter("kind is null and is_open = 0 and size(final) = 2")
    wanted = materialize(unsure.select(F.explode("final").alias("place")).distinct(), "wanted")
    found = seen.select(F.explode("places").alias("place"), "closed").join(wanted, "place", "left_semi")
    found = found.groupBy("place").agg(F.count("*").alias("n"), F.sum(F.array_contains("closed", F.col("place")).cast("long")).alias("c"))
    found = materialize(found, "places")
    ends = unsure.select(F.element_at("final", 1).alias("place"), F.element_at("final", 2).alias("token")).distinct()
    ends = ends.join(found, "place", "left").join(found.select(F.col("place").alias("token"), (F.col("c") / F.col("n")).alias("by_token")), "token", "left")
    ends = ends.select("place", "token", ((F.coalesce("c", F.lit(0)) + F.coalesce("by_token", F.lit(0.0))) / (F.coalesce("n", F.lit(0)) + 1)).alias("rate"))
    told = seen.withColumns({"place": F.get("final", F.lit(0)), "token": F.get("final", F.lit(1))}).join(declining, "opening", "left").join(ends, ["place", "token"], "left")
    refusal = F.coalesce(F.col("template"), F.lit(False))
    broken = (F.col("is_open") == 1) | ((F.col("is_open") == 0) & (F.coalesce("rate", F.lit(0.0)) < min_rate))
    kind = F.when(F.col("kind").isNotNull(), F.col("kind")).when(refusal, "refusal").when(broken, "truncated")
    told = told.select("question", "answer", kind.alias("kind")).filter("kind is not null")
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("kind"))
    hit = rows.join(told, rows["question"].eqNullSafe(told["question"]) & rows["answer"].eqNullSafe(told["answer"])).select("key", "kind")
    worst = hit.groupBy("key").agg(F.min(rank).alias("r"))
    return worst.select(F.col("key").alias(key), F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.col("r").cast("int")).alias("defect_type"))
