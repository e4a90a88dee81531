"""Sentence units of texts with known boundaries, marked by a vertical bar."""

from __future__ import annotations

import os
import time

import pytest

from tidegrid.llm import sentences
from tidegrid.llm.sentences import sentence_spans, sentence_units

MARKED = [
    "Dr. Kavis asked.|Ms. Pell and Mr. Sab signed at 3 p.m.|J. R. Osq left.",
    "It fell by 28% (see Tab. 9, col. 3), which hurt.|(The same happened in Sept. 2001.)|“Leave it open.”|\"Is it stale?\" asked K. Roe.",
    "The note reads: \"Replay it first. Then compare.\"|We agreed in Sept..|No. 5 has no owner.",
    "It rose to 5.8... then fell.|Nobody knew...|What, again?!|The U.S. session opened.",
    "wrote part_1.json twice.|Who approved v2.1?|All is well.",
    "Die 4. Auswertung vom 6. Oktober liegt vor.|Sie fehlt, vgl. Abs. 7.|„Ist es verletzt?“, fragte die Prüferin.|Laut Frau Dr. Ost fehlt z. B. der Wert.",
    "« Est-ce périmé ? » demanda la relectrice.|Rien depuis…|Attention !|M. Pel et Mme Ilv, p. ex. pour nous.",
    "—¿Está vencido? —preguntó la revisora.|¡No repitan la carga!|La pérdida en EE. UU. fue de USD 5.|¿Por qué?",
    "А. Осин и К. Велт подписали, см. стр. 1.|В 2009 г. было 334 тыс. строк, т. е. много.|«Ждать не будем. Пересчитаем», — написал отдел.",
    "«البيانات متأخرة. لن ننتظر» كتب المكتب.|هل أعيد الإرسال؟|وقّع د. Osvith على المحضر رقم 3.|السبب غير معروف...|تم.",
    "\"डेटा देर से आया। हम नहीं रुकेंगे।\" यह टिप्पणी डेस्क ने लिखी।|रु. 59 का नुकसान।|larch-carry-07 रुका।|सब ठीक है॥",
]
GLUED = [
    "“数据迟到了。不能再等。”值班员这样写道。|真的吗？！|原因……仍不清楚。|《核对。第9版》由他起草。|x-01的限额。",
    "「データが遅れている。待てない。」と担当者は書いた。|本当ですか？！|原因は…まだ分からない。|『再計算は月曜日。』という記録。",
    "The suffix is dropped twice.|Who approved it?|\"Stop!\" he said.",
]


def marked(text: str, gap: str) -> tuple[str, list[str]]:
    return text.replace("|", gap), text.split("|")


@pytest.mark.parametrize(("text", "gap"), [*((t, g) for t in MARKED for g in (" ", "  ", "\n")), *((t, g) for t in GLUED for g in ("", " "))])
def test_marked(text, gap):
    whole, units = marked(text, gap)
    assert [whole[a:b] for a, b in sentence_spans(whole)] == units


def test_thai_gaps():
    text = "วงเงินของพอร์ต tundra-05 ยังคงเดิม  ราคาของ VIKAX หยุดเมื่อเวลา 09:03 แล้วกลับมา โปรดตรวจสอบไฟล์ a.csv ก่อนปิดตลาด"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["วงเงินของพอร์ต tundra-05 ยังคงเดิม", "ราคาของ VIKAX หยุดเมื่อเวลา 09:03 แล้วกลับมา", "โปรดตรวจสอบไฟล์ a.csv ก่อนปิดตลาด"]


def test_blocks():
    text = "Summary\r\n\r\nOne line\nwraps. Two.\n \n1. First item\nwraps on.\n2. Second. Still it\n\n- Dash\n* Star\n\n2022-06-26T07:04:13.594Z ERROR loader file=a. B\nlate=1\n\nim\n8. Quartal endet."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Summary", "One line\nwraps.", "Two.", "1. First item\nwraps on.", "2. Second. Still it", "- Dash", "* Star", "2022-06-26T07:04:13.594Z ERROR loader file=a. B\nlate=1", "im\n8. Quartal endet."]


def test_marks_of_one_list():
    text = "- The evaluation\n– of PF was kept\n- Next\n\n3. Third\n4. Fourth\n9. Quartal\n\nText\n- no item. Two."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["- The evaluation\n– of PF was kept", "- Next", "3. Third", "4. Fourth\n9. Quartal", "Text\n- no item.", "Two."]


def test_looked_through():
    text = "﻿Dr.​ Kavis ask­ed.⁠ Fin​."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Dr.​ Kavis ask­ed.", "Fin​."]


def test_nothing_and_very_long():
    assert sentence_spans(None) == sentence_spans("") == sentence_spans(" \n\t ") == []
    assert len(sentence_spans("Ab cd. " * 50_000)) == 50_000
    assert sentence_spans("." * 100_000) == [(0, 100_000)]
    assert len(sentence_spans("a" * 1_000_000)) == 1
    assert sentence_spans("(" * 2000 + "A. B") != []


def test_spans_cover_everything_but_white_space(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found: dict[int, list[tuple[int, int]]] = {}
    for r in sentence_units(docs).collect():
        found.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for d, t in texts.items():
        rest, last = t or "", 0
        for a, b in sorted(found.get(d, [])):
            assert last <= a < b and not rest[a].isspace() and not rest[b - 1].isspace() and not rest[last:a].strip("​⁠﻿­ \n\r\t 　")
            last = b
        assert not rest[last:].strip("​⁠﻿­ \n\r\t 　")


#: Texts with the units marked by hand, one per line; a unit does not know of the others' scripts.
UNITS = [
    ["数据迟到了。", "不能再等。", "他说：“明天再看。”然后离开了。"],
    ["データが遅れています。", "再送してください！", "「確認しました。」と担当者は言った。"],
    ["ข้อมูลมาช้า ", "ทีมงานตรวจสอบแล้ว"],
    ["ຂໍ້ມູນມາຊ້າແລ້ວ ", "ພວກເຮົາກວດສອບ ແລະ ແກ້ໄຂ"],
    ["ទិន្នន័យមកយឺត។ ", "យើងរង់ចាំ។"],
    ["ទិន្នន័យមកយឺត ", "ដូច្នេះយើងរង់ចាំ និង ពិនិត្យ"],
    ["အချက်အလက် နောက်ကျပါတယ် ", "ထို့ကြောင့် ပြန်ပို့ပါ"],
    ["ဒေတာ နောက်ကျသည်။ ", "ပြန်စစ်ပါ။"],
    ["ڈیٹا دیر سے آیا۔ ", "ہم انتظار کریں گے۔"],
    ["Steps:\n", "- first item\n", "- second item"],
]


@pytest.mark.parametrize("units", UNITS, ids=lambda u: u[0].strip()[:12])
def test_marked_texts(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == [u.strip() for u in units]


def test_dictionary_has_the_words_of_the_vocabulary():
    listed = sentences.dictionary()
    costs = sentences.dictionary(os.path.join(sentences.TOKENIZERS, sentences.WORDS))
    assert set(listed) < set(costs) and len(costs) > 500 and all(1 <= c <= 2 for c in costs.values())
    assert sentences.Lattice(costs).words("これ") == ("これ",) and sentences.Lattice(listed).words("これ") == ("こ", "れ")
    assert sentences.Lattice(listed).words("กำ") == ("กำ",)  # clusters are not cut


def test_time_grows_with_the_length_only():
    def seconds(n):
        texts = ["(A sentence here.) " * n, '( " ' * n + "a. B. " * n, "- x\n  y\n" * n, "“a” b. C " * n]
        start = time.perf_counter()
        for t in texts:
            sentences.sentence_spans(t)
        return time.perf_counter() - start

    seconds(200)
    assert seconds(8000) < 40 * seconds(800)


def test_punctuation_alone_is_no_unit_between_sentences():
    for text, units in (("Late again! ! Next one.", ["Late again! !", "Next one."]), ("One. Two.", ["One.", "Two."]), ("Fine. 🚨", ["Fine.", "🚨"])):
        assert [text[a:b] for a, b in sentences.sentence_spans(text)] == units
