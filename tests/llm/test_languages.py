"""Problem 5: labels, held-out accuracy on the test tables, and edge cases."""

from __future__ import annotations

import pytest

from lexspan.llm.languages import Centroids, Judge, fit_centroids, grams, judge_languages, label_code, without_quotations
from lexspan.sources.tables import table

EN = ["The law of the land applies to every one of these terms and to all who use them.", "You may write to us at any time and ask what we know about you.", "We keep the records for as long as the contract lasts and no longer."]
DE = ["Das Recht des Landes gilt für alle diese Bedingungen und für jeden, der sie nutzt.", "Sie können uns jederzeit schreiben und fragen, was wir über Sie wissen.", "Wir bewahren die Unterlagen so lange auf, wie der Vertrag läuft, und nicht länger."]
RU = ["Право страны действует для всех этих условий и для каждого, кто их использует.", "Вы можете написать нам в любое время и спросить, что мы о вас знаем.", "Мы храним записи столько, сколько действует договор, и не дольше."]


@pytest.mark.parametrize("label, code", [("en", "en"), ("EN", "en"), (" en-US ", "en"), ("en_GB", "en"), ("eng", "en"), ("English", "en"), ("zh-Hans", "zh"), ("ger", "de"), ("deu", "de"), ("Portuguese", "pt"), ("xx", None), ("und", None), ("", None), (None, None), ("?", None), ("--", None), ("n/a", None), ("unknown", None)])
def test_labels(label, code):
    assert label_code(label) == code


def made() -> Judge:
    sample = []
    for code, texts in (("en", EN), ("de", DE), ("ru", RU)):
        for i in range(30):
            sample.append(("\n".join(texts[(i + k) % 3] for k in range(3)), code if i % 5 else ("nl" if code == "de" else None), 1.0))
    return Judge(fit_centroids(sample))


def test_wrong_labels_name_no_cluster_and_passages_are_found():
    judge = made()
    assert set(judge.centroids.codes) == {"en", "de", "ru"}
    texts = ["\n".join(EN), "\n".join(DE), "\n".join([*EN, RU[0]]), EN[0] + ' The original reads: "' + DE[0] + '" ' + EN[1] + "\n" + EN[2], "", "12345 !!", "\n".join([*DE, EN[1], EN[2]])]
    out = judge.judge(texts)
    assert [o[0] for o in out[:4]] == ["en", "de", "en", "en"] and out[6][0] == "de"
    assert [p[0] for p in out[2][2]] == ["ru"] and texts[2][out[2][2][0][1] : out[2][2][0][2]].strip() == RU[0]
    assert out[3][2] == [] and {p[0] for p in out[6][2]} == {"en"}
    assert out[4][0] is None and out[5][0] is None


def test_far_texts_are_rejected():
    lang, _, _ = made().centroids.classify(["ქართული ენა არის ქართველების ენა", "zxqj vvkw qqzz xkcd jjvq"])
    assert lang.tolist() == [-1, -1]


def test_no_labels_and_no_texts(spark):
    nothing = fit_centroids([])
    assert isinstance(nothing, Centroids) and nothing.classify(["abc"])[0].tolist() == [-1]
    assert [len(x) for x in grams([""])][:3] == [0, 0, 0]
    df = spark.createDataFrame([(1, None, "en", None), (2, " ", None, None), (3, "Hello to all of you who read this text today.", None, None), (3, "Hello to all of you who read this text today.", None, None)], "doc_id long, text string, lang string, url string")
    got = judge_languages(df).collect()
    assert [(r["doc_id"], r["kind"], r["lang"]) for r in got] == [(3, "main", None)] * 2
    assert judge_languages(df.where("false")).count() == 0


def test_quotations_are_blanked():
    text = 'He said "one two three four" here.'
    assert without_quotations(text) == text.replace("one two three four", " " * 18)
    assert without_quotations('A "b" c') == 'A "b" c'


def test_most_labels_of_the_tables_agree(spark, small):
    got = judge_languages(table(spark, small, "documents")).where("kind = 'main' AND label IS NOT NULL AND lang IS NOT NULL")
    n, same = got.count(), got.where("label = lang").count()
    assert same >= 0.85 * n
