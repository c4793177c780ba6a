"""Problem 7: furniture of a made-up site family, and edge cases."""

from __future__ import annotations

import random

from lexspan.llm.template import clean, deduce_template, entries, furniture_lines, host_of, main_text, slotted, name_pattern
from tests.conftest import rows

LEGAL = ["The supplier keeps the goods until they are paid.", "Claims must be made within thirty days.", "This contract follows the law of the seat.", "Nothing here limits the rights of consumers.", "The price is due on delivery.", "Either side may end the contract."]
HEADINGS = ["Scope", "Payment", "Liability", "Complaints"]
MENU = ["Home", "Shop", "News", "Help", "Sign in", "Jobs"]
EXTRA = ["Back to the top", "Print this page", "Join our mailing list"]


def page(rng: random.Random, i: int, site: bool) -> tuple[tuple, set[int]]:
    name = f"Corva{'abcdefghij'[i % 10]}lum"
    body = []
    for h in rng.sample(HEADINGS, 3):
        body += [h, " ".join(rng.sample(LEGAL, 3))]
    lines, marks = [(x, False) for x in body], []
    if site:
        lines = [(" | ".join([name, *rng.sample(MENU, 4)]), True)] + [(x, True) for x in rng.sample(MENU, 2)] + lines
        lines.insert(rng.choice([5, 7]), (rng.choice(EXTRA), True))
        lines += [(rng.choice(EXTRA), True), (f"© {2000 + i % 20} {name} – All rights reserved.", True)]
    marks = {k for k, (_, f) in enumerate(lines) if f}
    return (i, "\n".join(x for x, _ in lines), f"https://www.{name.lower()}.example/terms", "x"), marks


def test_deduces_the_template(spark):
    rng = random.Random(2)
    made = [page(rng, i, i % 2 == 0) for i in range(400)]
    docs = spark.createDataFrame([m[0] for m in made], "doc_id long, text string, url string, tokens string")
    want = {(m[0][0], n) for m in made for n in m[1]}
    got = set(rows(furniture_lines(docs)))
    assert len(want - got) <= 0.01 * len(want) and len(got - want) <= 0.01 * len(want)


def test_copies_on_a_host_are_one_page(spark):
    rng = random.Random(3)
    made = [page(rng, i, i % 2 == 0) for i in range(200)]
    copied = ["The rules of this house", "Each guest pays the fee of the month in advance where it is due", "Fees grow from two to three points", "All is said.", "© 2020 Solo – All rights reserved."]
    data = [m[0][:3] for m in made] + [(1000 + i, "\n".join(copied), "https://solo.example/terms") for i in range(4)]
    found = rows(furniture_lines(spark.createDataFrame(data, "doc_id long, text string, url string")).where("doc_id >= 1000"))
    assert found == [(1000 + i, 4) for i in range(4)]


def test_supports_do_not_depend_on_size(spark, monkeypatch):
    """A host's own menu entry on three pages stays furniture among very many pages."""
    monkeypatch.setattr("lexspan.llm.template.SHARE", 0.1, raising=False)  # as if there were a thousand times the pages
    rng = random.Random(5)
    made = [page(rng, i, i % 2 == 0) for i in range(200)]
    own = ["Orchard walks", "Cellar tours", "Harvest calendar", "Our donkeys", "Find the gate"]
    data = [m[0][:3] for m in made]
    for i in range(4):
        data.append((1000 + i, "\n".join([*own, "Home | Shop | News | Help | Jobs", LEGAL[i], LEGAL[i + 1], "© 2020 Solo – All rights reserved."]), "https://solo.example/terms"))
    found = {r[1] for r in rows(furniture_lines(spark.createDataFrame(data, "doc_id long, text string, url string")).where("doc_id = 1000"))}
    assert set(range(5)) <= found


def test_pages_get_the_tokens_of_the_whole_template(spark):
    """Joined tokens give the lines that the collected vocabulary gives."""
    rng = random.Random(7)
    docs = spark.createDataFrame([page(rng, i, i % 2 == 0)[0][:3] for i in range(200)], "doc_id long, text string, url string")
    whole = deduce_template(docs)
    want = sorted((r["doc_id"], n) for r in docs.collect() for n in whole.furniture(r["text"], r["url"]))
    assert rows(furniture_lines(docs)) == want


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, url string"
    df = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, " \n ", None), (None, "© 2020 Foo\nA sentence that is here.", None), (4, "Just one sentence.", ""), (4, "Just one sentence.", "")], schema)
    assert rows(furniture_lines(df)) == [(None, 0)]
    assert furniture_lines(df.where("false")).count() == 0
    long = deduce_template(df.where("false"))
    assert len(long.tokens) == len(long.headings) == 0
    assert long.furniture("word " * 400_000 + "\n© x", None) == [1]


def test_pieces():
    assert clean("<li>» Home »</li>\r") == "Home" and entries("A | B · C") == ["A", "B", "C"] and entries("one sentence") == []
    assert host_of("https://www.foo-bar.example/x") == "foo-bar" and host_of(None) == ""
    assert slotted("Foo Bar 1,5", name_pattern("foobar")) == "@ #"
    assert main_text("a\nb\nc", [1]) == "a\n\nc"


WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "zu", "te", "ar") for b in ("ra", "ni", "so", "pe", "vol") for c in ("", "x", "den", "mor", "st")]


def hosts(rng: random.Random, n: int, pages: int, start: int = 0) -> tuple[list[tuple], set[tuple[int, int]]]:
    """Pages of hosts that each have three head and three foot lines of their own around random bodies, without any copyright line or menu."""

    def line(k: int, closed: bool) -> str:
        return " ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ("." if closed else "")

    data, want = [], set()
    for h in range(n):
        head, foot = [line(2, False), line(3, False), line(6, True)], [line(3, False), line(45, True), line(5, True)]
        for _ in range(pages):
            body = [line(rng.randint(4, 12), True) if rng.random() < 0.8 else line(2, False) for _ in range(rng.randint(8, 20))]
            i = start + len(data)
            data.append((i, "\n".join([*head, *body, *foot]), f"https://{WORDS[h % 150]}{h}{start}.example/{i}"))
            want |= {(i, k) for k in (0, 1, 2)} | {(i, 3 + len(body) + k) for k in range(3)}
    return data, want


def test_own_templates_without_seeds(spark):
    """Classes of a host's own pages suffice, whatever the form and length of their lines and however many other pages there are."""
    data, want = hosts(random.Random(11), 40, 10)
    schema = "doc_id long, text string, url string"
    got = set(rows(furniture_lines(spark.createDataFrame(data, schema))))
    assert len(got & want) >= 0.95 * len(want) and got <= want
    others = [page(random.Random(i), i, i % 2 == 0)[0][:3] for i in range(100_000, 106_000)]
    more = set(rows(furniture_lines(spark.createDataFrame(data + others, schema).repartition(8)).where("doc_id < 100000")))
    assert len(more & want) >= 0.95 * len(want) and more <= want


def test_revisions_of_one_text_are_no_template(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choice(WORDS) for _ in range(8)) + "." for _ in range(30)]
    data = []
    for i in range(6):
        mine = list(base)
        mine[i] = f"Changed {i} times."
        data.append((i, "\n".join(mine), "https://same.example/terms"))
    assert rows(furniture_lines(spark.createDataFrame(data, "doc_id long, text string, url string"))) == []
