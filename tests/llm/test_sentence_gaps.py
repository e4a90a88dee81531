"""Gaps of spaceless scripts: nodes of the lattice, classified by the words on both sides."""

from __future__ import annotations

import os
import time
import unicodedata

import pytest

from tidegrid.llm import sentences
from tidegrid.llm.sentences import Lattice, dictionary, sentence_spans

VOCABULARY = os.path.join(sentences.TOKENIZERS, sentences.WORDS)

#: Texts with the units marked by a vertical bar.
MARKED = [
    "เขาบอกว่า “ข้อมูลมาช้า เราไม่รอ” แล้วกลับ |ทีมงานตรวจสอบ",  # no gap within a quotation or a parenthesis
    "วงเงิน (ตามตาราง ฉบับใหม่) คงเดิม |ราคาหยุด",
    "ราคา ๑๐ บาทในปี ๒๕๖๗ นี้ |พบข้อความซ้ำ",  # digits are no letters
    "ชุดต่าง ๆ ที่ส่งมา |ทีมงานตรวจสอบ",  # nor is a sign of repetition
    "ข้อมูล \n|ในระบบ",  # between letters the definition outvotes the word that goes on
    "ຂໍ້ມູນ (ມາຊ້າແລ້ວ ພວກເຮົາລໍຖ້າ) ຖືກສົ່ງ",
    "အချက်အလက် နောက်ကျပါတယ်၊ ထို့ကြောင့် ပြန်ပို့ပါ",  # a comma ends nothing
    "データを確認しました |しかし再送します",
    "データを確認しました 担当者",  # white space alone is nothing in Japanese and Chinese
    "数据迟到了　|此外我们等待",
    "数据迟到了 的记录",
]


@pytest.mark.parametrize("words", [None, VOCABULARY], ids=["listed", "vocabulary"])
@pytest.mark.parametrize("text", MARKED)
def test_marked_gaps(text, words):
    whole = text.replace("|", "")
    assert [whole[a:b] for a, b in sentence_spans(whole, Lattice(dictionary(words)))] == [u.strip() for u in text.split("|")]


def test_decomposed_letters_are_the_same():
    text = unicodedata.normalize("NFD", "データは届いたばかりです しかしデータが遅れています")
    assert [text[a:b] for a, b in sentence_spans(text)] == text.split(" ")
    text = unicodedata.normalize("NFD", "「待てない。」で終わる。次へ")
    assert [text[a:b] for a, b in sentence_spans(text)] == [text[: text.index("次")], "次へ"]


def test_thai_gaps_are_classified():
    def cost(text):
        (node,) = sentences._nodes(text, Lattice())
        assert node[0] == text.index(" ")
        return node[1]

    plain = cost("ข้อมูลมาช้า นาย")
    assert cost("ตรวจสอบแล้ว ทีมงานรอ") < cost("ตรวจสอบแล้ว นาย") < plain < cost("ข้อมูลมาช้า ในระบบ") < 0


def test_runs_are_segmented_whole(monkeypatch):
    seen = []
    words = Lattice.words
    monkeypatch.setattr(Lattice, "words", lambda self, run: seen.append(run) or words(self, run))
    before, after = "ຂໍ້ມູນ" * 20 + "ແລ້ວ", "ພວກເຮົາ" + "ກວດ" * 20
    assert len(sentence_spans(f"x1 {before} {after} y")) == 2
    assert seen == [before, after]


def test_long_runs_take_linear_time():
    def seconds(n):
        lattice, text = Lattice(), "ข้อมูล" * n + " " + "ราคา " * n
        start = time.perf_counter()
        assert len(sentence_spans(text, lattice)) == n + 1
        return time.perf_counter() - start

    seconds(200)
    assert seconds(20_000) < 40 * seconds(2_000)
