import re
import unicodedata

import pytest

from hibiki.llm import qa_defects, sentences
from hibiki.llm.sentences import units


def cut(text):
    return [text[a:b] for a, b in units(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        (" \n　", []),
        ("測定値は０．6mmであった．次です。", ["測定値は０．6mmであった．", "次です。"]),
        ("班長は「電源を切れ。左右を確かめる。」と残しました。なぜ異音が起きたのか？！", ["班長は「電源を切れ。左右を確かめる。」と残しました。", "なぜ異音が起きたのか？！"]),
        ("異音が…と続くときは止めます。振動が続いた……次へ。", ["異音が…と続くときは止めます。", "振動が続いた……", "次へ。"]),
        ("Night work ends at 6:45 a.m. Unit A1 stands here. The shift starts at 8 a.m. and ends late.", ["Night work ends at 6:45 a.m.", "Unit A1 stands here.", "The shift starts at 8 a.m. and ends late."]),
        ("Keep fuses, belts, etc. iPanel readers need it. See Fig. 3 first.", ["Keep fuses, belts, etc.", "iPanel readers need it.", "See Fig. 3 first."]),
        ("Am 1. Mai beginnt es um 10.10 Uhr. Öl usw. gehören nicht hinein, z. B. Fett.", ["Am 1. Mai beginnt es um 10.10 Uhr.", "Öl usw. gehören nicht hinein, z. B. Fett."]),
        ("・安全カバーを点検する\n・班長へ報告。\n第3章　軸受\n次の文です。", ["・安全カバーを点検する", "・班長へ報告。", "第3章　軸受", "次の文です。"]),
        ("リミットスイッチの\n品番はA1です！", ["リミットスイッチの\n品番はA1です！"]),
        ("N号機の担当は当直者品質担当へ57分以内に連絡混練機を再起動しない", ["N号機の担当は当直者", "品質担当へ57分以内に連絡", "混練機を再起動しない"]),
        ("ปิดสวิตช์หลักแล้วรอ 68 นาที หากมีเสียงผิดปกติให้แจ้งฝ่ายคุณภาพทันที", ["ปิดสวิตช์หลักแล้วรอ 68 นาที", "หากมีเสียงผิดปกติให้แจ้งฝ่ายคุณภาพทันที"]),
        ("班长写道：“停止！不要触摸。”然后离开了。下一句。", ["班长写道：“停止！不要触摸。”然后离开了。", "下一句。"]),
        ('정비팀은 "정지! 만지지 마십시오."라고 기록했습니다. 끝났습니까?', ['정비팀은 "정지! 만지지 마십시오."라고 기록했습니다.', "끝났습니까?"]),
        ("¿Se cambió? ¡No toque! Véase la pág. 2 y la fig. 3.", ["¿Se cambió?", "¡No toque!", "Véase la pág. 2 y la fig. 3."]),
        ("फ़ॉर्म सं. 36 भरें। मशीन है।", ["फ़ॉर्म सं. 36 भरें।", "मशीन है।"]),
        ('Is it hot? "Stop it!" he said. Done.', ["Is it hot?", '"Stop it!" he said.', "Done."]),
    ],
)
def test_units(text, want):
    assert cut(text) == want


def test_units_cover_everything_but_white_space(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text").collect()
    for (text,) in rows:
        last = 0
        for a, b in units(text):
            assert a >= last and not text[last:a].strip() and text[a:b] == text[a:b].strip() and b > a
            last = b
        assert not text[last:].strip()


def test_invisible_characters_move_no_offsets():
    text = "動​きます。止ま­ります。"
    assert cut(text) == ["動​きます。", "止ま­ります。"]


def test_sentence_operator_nulls_repeats_and_long_texts(spark):
    long = "止めます。" * 20_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "甲です。乙です。", 0), (3, "甲です。乙です。", 0), (4, long, 0)], "id int, text string, unit_no int")
    got = sentences.sentence_units(df, "text", ["id"]).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {3: 4, 4: 20_000}
    assert sentences.sentence_units(df.filter("id > 9"), "text", ["id"]).count() == 0


@pytest.mark.parametrize(
    "question, answer, want",
    [
        ("軸受はいつ替えますか？", None, "empty"),
        ("軸受はいつ替えますか？", "　。", "empty"),
        ("軸受はいつ替えますか？", "（未記入）", "empty"),
        ("軸受はいつ替えますか？", "不要です", None),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "「北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？」というご質問ですね。", "copies_question"),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "AB-123456は班長の許可を得てから交換してください。", None),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "AB-123456は班長の許可を", "truncated"),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "Ask the shift lead first, then clean the filter of AB-123456.", "other_language"),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "申し訳ありませんが、そのご質問にはお答えできません。", "refusal"),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "窓口で回答できない場合は、班長が3日以内に折り返します。", None),
        ("北倉庫で動かすAB-123456の軸受は、だれの許可で交換しますか？", "音声案内が「お答えできません」と出たら、軸受を清掃します。", None),
        ("Who may open AB-123456 while the press is hot?", "I'm sorry, but I can't help with that.", "refusal"),
        ("Who may open AB-123456 while the press is hot?", "If the shift lead can't help with it, call the quality desk.", None),
        ("Who may open AB-123456 while the press is hot?", "First remove the relay, then inspect the", "truncated"),
        ("Who may open AB-123456 while the press is hot?", "The shift lead", None),
        (None, "はい。", None),
    ],
)
def test_qa_checks(question, answer, want):
    if qa_defects.is_empty(answer):
        got = "empty"
    elif question and qa_defects.is_copy(question, answer):
        got = "copies_question"
    elif question and qa_defects.is_foreign(question, answer):
        got = "other_language"
    elif qa_defects.declines(answer):
        got = "refusal"
    else:
        got = "truncated" if qa_defects.ending(answer)[1] == 1 else None
    assert got == want


def test_qa_operator(spark):
    rows = [("a", "軸受はどこですか？", "倉庫係へ確認して"), ("b", "軸受はどこですか？", None), ("b", "軸受はどこですか？", "東棟です。"), ("c", None, "はい。"), (None, "x", None), ("d", "弁はどこですか？", "回答できません。"), ("e", "弁は何ですか？", "回答できません。")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, q string, a string, kind int")
    got = {r["k"]: r["defect_type"] for r in qa_defects.qa_defects(df, "k", "q", "a").collect()}
    assert got == {"a": "truncated", "b": "empty", "d": "refusal", "e": "refusal"}
    assert qa_defects.qa_defects(df.filter("k = 'zz'"), "k", "q", "a").count() == 0


def test_minhash_clusters_are_verified_components(spark):
    base = "the request cannot be fulfilled by the assistant in this case at all"
    texts = [base, base + "!", base + "!!", "remove the relay and sign the checklist before the shift ends today", "軸受を外し、三十分待ってから清掃します。その後、点検票に記入します"]
    df = spark.createDataFrame([(t,) for t in texts], "opening string")
    got = {r["opening"]: r["cluster"] for r in qa_defects.opening_clusters(df).collect()}
    assert len(got) == 5 and len({got[t] for t in texts[:3]}) == 1 and len(set(got.values())) == 3
