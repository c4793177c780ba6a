"""Problem 10: held-out accuracy on made-up documents, and edge cases."""

from __future__ import annotations

import random

import numpy as np

from lexspan.llm.subjects import Counts, assign_subjects, choose_terms, sentence_terms
from tests.conftest import rows

TOPICS = {"cooking": ["saucepan", "oven", "recipe", "whisk", "dough"], "sailing": ["harbour", "rudder", "anchor", "mast", "regatta"], "chess": ["bishop", "gambit", "checkmate", "pawn", "castling"]}
PLAIN = ["The contract ends after a year.", "Fees are due at once.", "The law of the seat applies here.", "Both sides may give notice.", "Nothing else has been agreed."]
FRAMES = ["Data on the {} are kept for a year.", "You may ask about the {} at any time.", "Fees for the {} are due at once.", "The rules on the {} were changed."]


def document(rng: random.Random, subjects: list[str], passing: str | None) -> str:
    out = [rng.choice(PLAIN) for _ in range(8)]
    for s in subjects:
        out += [rng.choice(FRAMES).format(rng.choice(TOPICS[s])) for _ in range(rng.randint(4, 6))]
    if passing:
        out.append(rng.choice(FRAMES).format(rng.choice(TOPICS[passing])))
    rng.shuffle(out)
    return " ".join(out)


def tables(spark, n: int = 400):
    rng, docs, labels, truth = random.Random(8), [], [], {}
    names = list(TOPICS)
    for i in range(n):
        subjects = rng.sample(names, rng.choice([0, 1, 1, 1, 2]))
        other = [x for x in names if x not in subjects]
        docs.append((i, document(rng, subjects, rng.choice(other) if other and rng.random() < 0.4 else None), "en", rng.choice(["a", "b"]), i % 60, "junk"))
        truth[i] = set(subjects)
        if i < n // 2 and subjects:
            label = rng.choice(subjects) if rng.random() < 0.95 else rng.choice(names)
            labels += [(i, rng.choice([label, label.upper(), f" {label} "]))] * rng.choice([1, 1, 2])
    schema = "doc_id long, text string, lang string, source string, service_id long, subject string"
    return spark.createDataFrame(docs, schema), spark.createDataFrame([*labels, (3, None), (None, "chess"), (5, "nonsense")], "doc_id long, subject string"), spark.createDataFrame([(k,) for k in TOPICS] + [(None,)], "subject string"), truth


def test_held_out_documents(spark):
    docs, labels, areas, truth = tables(spark)
    got: dict[int, set] = {}
    for i, s, p, n in assign_subjects(docs, labels, areas).collect():
        assert 0 < p <= 1 and n >= 2
        got.setdefault(i, set()).add(s)
    held = [i for i in truth if i >= 200]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right >= 0.95 * len(held)


def test_empty_inputs_and_nulls(spark):
    docs, labels, areas, _ = tables(spark, 60)
    assert assign_subjects(docs, labels.where("false"), areas).count() == 0
    assert assign_subjects(docs, labels, areas.where("false")).count() == 0
    bare = spark.createDataFrame([(900, None, None, None, None, None), (901, "", "en", None, 1, None)], docs.schema)
    assert rows(assign_subjects(docs.union(bare), labels, areas).where("doc_id >= 900")) == []
    assert assign_subjects(docs.where("false"), labels, areas).count() == 0


def test_terms_need_several_services_and_counts_are_per_sentence():
    sample = [("The rudder broke. The mast fell.", str(k % 2 if k < 20 else k), {"sailing": 1.0}) for k in range(10)] + [("The oven is hot.", str(k), {"cooking": 1.0}) for k in range(10)]
    terms = choose_terms(sample)
    assert "oven" in terms and "rudder" not in terms
    count = Counts({"oven": ("cooking", 1.0), "料理": ("cooking", 1.0)}, ["cooking", "sailing"])
    assert count("The oven and the oven. An ovenbird sings. 料理の本。")[0].tolist() == [2, 0]
    assert count("")[1] == 0 and Counts({}, ["cooking"])("The oven.")[0].tolist() == [0]
    assert {"料理", "の本"} <= sentence_terms("料理の本") and np.sum(count("x " * 200_000)[0]) == 0
