"""Problem 8: against two public libraries, exact round trips, appends and edits."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspan.llm.encoding import PATTERN, TOKENIZER_PATH, Encoder, PrefixTable, Vocabulary, count_tokens, encode_corpus

pytestmark = pytest.mark.skipif(not Path(TOKENIZER_PATH).exists(), reason="no vocabulary")
VOCABULARY = Vocabulary.parse(Path(TOKENIZER_PATH).read_bytes()) if Path(TOKENIZER_PATH).exists() else None
ENCODER = Encoder(VOCABULARY) if VOCABULARY else None


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


HARD = ["", " ", "  ", "\n\n a  b\t\tc ", "don't I'LL they've", "<|endoftext|> as text", "2,608 days 5.3.1", "日本語のテキスト。今日は", "ข้อมูลเกี่ยวกับ", "हम सुनते हैं।", "naïve café 🍪🍪 ¿qué?", "a" * 3000, "-" * 500, " x" * 500, "  ​　 z", "é́", "\x00\x01", "   lead and trail   ", "a \n b", "word \n\n  next"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(other, text):
    assert ENCODER.encode(text).tolist() == other.encode_ordinary(text)
    assert ENCODER.count(text) == len(other.encode_ordinary(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_equals_the_library_and_comes_back(text):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
    ids = ENCODER.encode(text).tolist()
    assert ids == other.encode_ordinary(text)
    assert b"".join(VOCABULARY.tokens[i] for i in ids).decode() == text


def test_appends_and_edits_equal_starting_over():
    rng = random.Random(4)
    for _ in range(40):
        data = bytes(rng.choice(b"etaoin shrdlu,.") for _ in range(rng.randint(1, 40)))
        cut = rng.randint(0, len(data))
        table = PrefixTable(VOCABULARY, data[:cut]).append(data[cut:])
        assert table.ids() == VOCABULARY.merged(data)
        a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        assert table.replace(a, b, b"ing the").ids() == VOCABULARY.merged(data[:a] + b"ing the" + data[b:])


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hi there", 1), (2, "", 1), (3, None, 1), (None, "x", None), (1, "Hi there", 1), (4, "ok", 2)], "doc_id long, text string, ids int")
    got = {(r["doc_id"], tuple(r["ids"]) if r["ids"] is not None else None) for r in encode_corpus(df).collect()}
    assert got == {(1, tuple(ENCODER.encode("Hi there").tolist())), (2, ()), (3, None), (None, tuple(ENCODER.encode("x").tolist())), (4, tuple(ENCODER.encode("ok").tolist()))}
    assert encode_corpus(df).count() == 6 and encode_corpus(df.where("false")).count() == 0
    assert {r["doc_id"]: r["tokens"] for r in count_tokens(df, ["doc_id"]).collect()}[3] == 0
