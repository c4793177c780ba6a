"""Problem 1."""

from __future__ import annotations

import random
import time

import pytest

from lexspan.llm.layout import blank_tags, blocks
from lexspan.llm.sentences import STRAY_COST, WORD_COST, _automaton, lattice_words, sentence_units, unit_starts
from tests.conftest import rows


def units(text: str) -> list[str]:
    s = unit_starts(text)
    return [text[a:b].strip() for a, b in zip(s, [*s[1:], len(text)])]


@pytest.mark.parametrize(
    "text, want",
    [
        ("One here. Two there! Three? Yes", 4),
        ("We share it, e.g. with Mr. Smith of No. 5, i.e. not with Dr. Who. It ends at 9.30 a.m. Next one.", 3),
        ("Pay 1,249.50 to a.b@c.example or https://x.example/p.3 today.", 1),
        ("The old rule ... well, it ended. So... A new one came.", 3),
        ('"You may go. We will not stop you." is what they say. Good.', 2),
        ("It is run by Foo Inc. and others. It belongs to Foo Inc. You agree.", 3),
        ("Done as agreed.The next one follows. iPlume is optional. 5,374 is a number.", 4),
        ("Seit dem 28. August 2021 gilt z. B. Abs. 3 Nr. 4. Foo e. V. haftet. Ist das gut? Ja.", 4),
        ("Según el art. 31, núm. 19, vale. ¿Es justo? ¡Escríbanos! El Sr. Tal firma.", 4),
        ("« Nous écoutons. Nous agissons. » résume tout. Selon l'art. 28, al. 3, oui.", 2),
        ("Согласно ст. 42, п. 10, да. Редакция 1,2 действует. Как быть? Так.", 4),
        ("我们倾听。真的吗？是的！我们的宗旨是“我们倾听。我们行动。”这几个字。", 4),
        ("当社の方針は「聞く。動く。」という言葉です。以前の決まり……それは古い。", 2),
        ("हम सुनते हैं। ABC Pvt. Ltd. के नियम हैं। क्या यह ठीक है? हाँ।", 4),
        ('"हम सुनते हैं। हम काम करते हैं।" यही सिद्धांत है। ठीक।', 2),
        ("เราคืนเงินภายใน 13 วัน บัญชีที่ไม่ใช้งานจะถูกปิดหลังจาก 24 วัน", 2),
        ("ผู้ใช้ Morjil ต้องมีอายุอย่างน้อย 14 ปี Morjil Co. ไม่รับประกันสิ่งใด", 2),
        ("Skip to content\nHome | Blog | Press\nTerms\nWe act. You read.", 5),
        ("1. Scope\n(a) First item; with more\n- Second item. It goes on.", 4),
    ],
)
def test_counts(text, want):
    assert len(units(text)) == want, units(text)


def test_wrapped_lines_run_on():
    text = "The first sentence of this text is long enough to be wrapped at the\nseventieth column. The second one follows it and also runs over to the\nnext line.\n\nHeading\n\n- An item that is long enough to be wrapped, too, so that it has a rest\nhere."
    assert [u.split()[0] for u in units(text)] == ["The", "The", "Heading", "-"]


def test_markup_is_not_part_of_a_unit():
    text = "<p>One. Two.</p><b>Head</b><p>A <b>bold</b> word.</p>"
    assert [text[s] for s in unit_starts(text)] == ["O", "T", "H", "A"]
    assert len(blank_tags(text)) == len(text)
    assert [b for _, b in blocks("<p>a</p>\n<li>b</li>")][0].strip() == "a"


def test_lists_on_one_line():
    text = "We say this first so that the line is long enough to be one whole text on a single line. (a) The first item goes here (b) The second item goes there (c) The third item. We go on after that."
    assert len(units(text)) == 5


def test_empty_and_blank_and_long():
    assert unit_starts("") == unit_starts(" \n\t ") == unit_starts("<p></p>") == []
    long = "All is well here. " * 60_000
    began = time.time()
    assert len(unit_starts(long)) == 60_000
    assert time.time() - began < 30
    assert unit_starts("x" * 1_000_000) == [0]
    began = time.time()
    assert len(unit_starts("Col. A. B. (Etc. " * 50_000)) < 150_000 and time.time() - began < 30
    assert unit_starts('"' * 3000 + ". A") != []




def test_frames_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", 9, "x"), (1, "Ab cd. Ef gh.", 9, "x"), (2, None, 9, "x"), (3, "", 9, "x"), (None, "Z.", None, None)], "doc_id long, text string, char_start long, block string")
    assert rows(sentence_units(df)) == [(1, 0, 7), (1, 0, 7), (1, 7, 13), (1, 7, 13), (None, 0, 2)]
    assert sentence_units(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "text, units",
    [
        ("He arrived on Jan. 5 and left on Feb. 7 by train.", 1),
        ("The U.S. Senate voted today.", 1),
        ("He lives in the U.S. The weather is fine.", 2),
        ("Lt. Gov. Adams spoke.", 1),
        ("Mt. Everest is high.", 1),
        ("See fig. 5 and J. R. R. Tolkien. He wrote it.", 2),
        ("They met at 5 p.m. Then they left.", 2),
        ("Il a vu M. Dupont à 5 h. Puis il est parti.", 2),
        ("Der Vertrag endet am 5. Mai 2020. Danach gilt er nicht.", 2),
        ("วันนี้อากาศดีมาก ฉันไปตลาดกับเพื่อน พวกเขาซื้อผลไม้ แล้วกลับบ้านครับ", 3),
        ("ขอบคุณมากค่ะ ร้านเปิดทุกวัน", 2),
        ("今日は晴れです　私は学校に行きました　とても楽しかったです", 3),
        ("他走了 我们回家吧 明天见", 3),
        ("東京 大阪 京都", 1),
    ],
)
def test_lattice(text, units):
    assert len(unit_starts(text)) == units


def test_words_cover_whole_chunks():
    """The cheapest path equals that of a plain search over all cuts."""
    words = {"ที่", "บ้าน", "ครับ", "น้ำ", "ดี", "ดีมาก", "มาก", "กลับ", "กลับบ้าน"}
    rng = random.Random(4)
    for _ in range(200):
        chunk = "".join(rng.choice([*sorted(words), "ก", "ศ"]) for _ in range(rng.randint(1, 8)))
        best: list[tuple[float, tuple]] = [(0.0, ())]
        for to in range(1, len(chunk) + 1):
            options = [(best[to - 1][0] + STRAY_COST, (*best[to - 1][1], ""))]
            for w in words:
                a = to - len(w)
                if a >= 0 and chunk[a:to] == w and not (to < len(chunk) and chunk[to] in "ะาำิีึืุู่้ั") and not (a and chunk[a - 1] in "เแโใไ"):
                    options.append((best[a][0] + WORD_COST, (*best[a][1], w)))
            best.append(min(options, key=lambda x: x[0]))
        first, last = lattice_words(chunk, _automaton(sorted(words)))
        assert (first, last) == (best[-1][1][0], best[-1][1][-1])
