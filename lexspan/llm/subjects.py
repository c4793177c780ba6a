"""Problem 10: subject areas of documents, by classifier chains over term, source and structure features.

Terms that point to a subject are chosen from a bounded sample of labelled documents. Every sentence of every document
speaks for at most one subject, by the terms in it. A chain of logistic classifiers, one per subject, sees how many
sentences speak for each subject, the document's source and structure and the chain's earlier decisions; its calibrated
probabilities are decoded to the likeliest combination of subjects by beam search.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.languages import SPELLINGS, label_code
from lexspan.llm.sentences import unit_starts
from lexspan.sources.tables import table

#: Labelled documents in the sample for each language named by documents.lang (and as many without a usable label).
SAMPLE = 400
#: A term's least evidence in nats, share of its subject, documents and services.
EVIDENCE, SHARE, LEAST = 5.0, 0.5, 3
#: Combinations kept while decoding; most subjects of a document.
BEAM, MOST = 8, 8
#: Commonest sources of the sample that are features.
SOURCES = 20
#: Sentences that must speak for a subject to make it one at all.
SPOKEN = 2
SEED = 10
_LETTER = r"[^\W\d_\u0900-\u097f\u0e00-\u0e7f\u3040-\u9fff]"
_WORD = re.compile(rf"[\u0e00-\u0e7f]+|[\u3040-\u9fff]+|[\u0900-\u0963\u0970-\u097f]+|{_LETTER}+(?:[’']{_LETTER}+)?")


_LETTERS = re.compile(rf"{_LETTER}|[\u0900-\u0963\u0970-\u097f]").match


def _spaceless(c: str) -> bool:
    return "฀" <= c <= "๿" or "぀" <= c <= "鿿"


def words(sentence: str) -> list[str]:
    """Words in small letters; a run of a script without spaces is one word."""
    return _WORD.findall(sentence.lower())


def sentence_terms(sentence: str) -> set[str]:
    """Candidate terms: words, and parts of runs without spaces."""
    out, ws = set(), words(sentence)
    for w in ws:
        if _spaceless(w[0]):
            for n in (4, 6, 9, 12) if w[0] < "぀" else (2, 3, 4, 5, 6):
                for i in range(len(w) - n + 1):
                    out.add(w[i : i + n])
        elif len(w) > 2:
            out.add(w)
    return out


def _sentences(text: str) -> list[str]:
    starts = unit_starts(text)
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def choose_terms(sample: list[tuple[str, str | None, dict[str, float]]]) -> dict[str, tuple[str, float]]:
    """Term to (subject, weight); `sample` has (text, service, share of each subject in the document's labels)."""
    docs, hosts, by = Counter(), defaultdict(set), defaultdict(Counter)
    prior: Counter = Counter()
    for text, service, shares in sample:
        prior.update(shares)
        found: set[str] = set()
        for s in _sentences(text):
            found |= sentence_terms(s)
        for t in found:
            docs[t] += 1
            if len(hosts[t]) < LEAST:
                hosts[t].add(service)
            for k, v in shares.items():
                by[t][k] += v
    total = sum(prior.values()) or 1.0
    out = {}
    for t, n in docs.items():
        if n < LEAST or len(hosts[t]) < LEAST:
            continue
        k, x = by[t].most_common(1)[0]
        p, base = min(x / n, 0.999), min(0.9, max(0.02, 1.2 * prior[k] / total))
        if p <= base or (x + 0.25) / (n + 2) < SHARE:
            continue
        nats = n * (p * log(p / base) + (1 - p) * log((1 - p) / (1 - base)))
        if nats >= EVIDENCE:
            out[t] = (k, log(p / base))
    return out


class Counts:
    """Counts the sentences of a text that speak for each subject."""

    def __init__(self, terms: dict[str, tuple[str, float]], subjects: list[str]):
        self.subjects, self.automaton = subjects, ahocorasick.Automaton()
        for t, (k, w) in terms.items():
            self.automaton.add_word(t, (subjects.index(k), w, len(t), not _spaceless(t[0])))
        self.empty = not terms
        if terms:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        out, starts = np.zeros(len(self.subjects), np.int32), unit_starts(text)
        if self.empty or not starts:
            return out, len(starts)
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))
        size, scores = len(low), {}
        for end, (k, w, n, whole) in self.automaton.iter(low):
            first = end - n + 1
            # A word in a spaced script must stand by itself.
            if whole and (first and _LETTERS(low[first - 1]) or end + 1 < size and _LETTERS(low[end + 1])):
                continue
            row = scores.setdefault(bisect_right(starts, first), {})
            row[k] = row.get(k, 0.0) + w
        for row in scores.values():
            out[max(row, key=lambda k: (row[k], -k))] += 1
        return out, len(starts)


def features(counts: np.ndarray, size: int, text: str, source: str | None, sources: list[str]) -> np.ndarray:
    """Term, source and structure features of a document; the first part, per subject, is added by `Chain`."""
    structure = [1.0, log(1 + size), float("</" in text), float("\n" not in text), counts.sum() / max(1, size)]
    return np.array([*structure, *(float(source == s) for s in sources)])


def subject_features(counts: np.ndarray, k: int, size: int) -> list[float]:
    n, rest = int(counts[k]), np.delete(counts, k)
    return [*(float(n >= j) for j in (1, 2, 3, 4, 6)), min(n, 12) / 12, n / max(1, size), float(rest.max(initial=0) >= 3)]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


class Chain:
    """A chain of classifiers with calibration, decoded by beam search."""

    def __init__(self, order: list[int], weights: list[np.ndarray], scales: list[tuple[float, float]]):
        self.order, self.weights, self.scales = order, weights, scales

    @classmethod
    def fit(cls, counts: np.ndarray, sizes: np.ndarray, base: np.ndarray, labels: np.ndarray) -> Chain:
        """`labels` has 1 for a label, 0 for none. An unlabelled subject for which three or more sentences speak is unknown, not absent."""
        n, m = labels.shape
        order = [int(k) for k in np.argsort(-labels.sum(axis=0), kind="stable")]
        weights, scales, earlier = [], [], np.zeros((n, 0))
        known = (labels == 1) | (counts < 3)
        fold = np.random.default_rng(SEED).integers(0, 2, n)
        for k in order:
            own = np.array([subject_features(counts[i], k, sizes[i]) for i in range(n)])
            x = np.hstack([own, base, earlier])
            y, w = labels[:, k].astype(float), known[:, k].astype(float)
            # The halves score one another for the calibration.
            held = np.zeros(n)
            for f in (0, 1):
                held[fold == f] = x[fold == f] @ _logistic(x[fold != f], y[fold != f], w[fold != f])
            a = _logistic(np.stack([held, np.ones(n)], axis=1), y, w, ridge=0.01)
            scales.append((float(a[0]), float(a[1])))
            weights.append(_logistic(x, y, w))
            earlier = np.hstack([earlier, (labels[:, k : k + 1] == 1) | (counts[:, k : k + 1] >= 3)])
        return cls(order, weights, scales)

    def decode(self, counts: np.ndarray, size: int, base: np.ndarray) -> list[tuple[int, float]]:
        """The likeliest combination: (subject, probability) of its members. Fewer than SPOKEN sentences make no subject."""
        beam: list[tuple[float, tuple[int, ...], list[tuple[int, float]]]] = [(0.0, (), [])]
        for place, (k, b, (scale, shift)) in enumerate(zip(self.order, self.weights, self.scales)):
            if counts[k] < SPOKEN:
                continue
            own, grown = subject_features(counts, k, size), []
            m = len(own) + len(base)
            fixed = float(np.dot(b[:m], np.concatenate([own, base])))
            for score, earlier, chosen in beam:
                z = fixed + sum(b[m + j] for j in earlier)
                p = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
                p = min(max(float(p), 1e-9), 1 - 1e-9)
                grown.append((score + log(1 - p), earlier, chosen))
                if len(chosen) < MOST:
                    grown.append((score + log(p), (*earlier, place), [*chosen, (k, p)]))
            beam = sorted(grown, key=lambda x: -x[0])[:BEAM]
        return beam[0][2]


def labelled_sample(docs: DataFrame, labels: DataFrame, subjects: list[str], per_language: int = SAMPLE) -> list[tuple[str, str | None, str | None, dict[str, float]]]:
    """(text, service, source, share of each subject): about `per_language` labelled documents of each language named by documents.lang,
    at most 4 * per_language * (languages + 1) of them.

    Labels are compared without case and padding; repeated labels weigh more, contradictory ones share the document; labels that name no subject area are left out.
    """
    votes = labels.select("doc_id", F.lower(F.trim("subject")).alias("_s")).where(F.col("_s").isin(subjects)).groupBy("doc_id").agg(F.collect_list("_s").alias("_votes"))
    rows = docs.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang", "source", F.col("service_id").cast("string").alias("service")).join(votes, "doc_id")
    spellings = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SPELLINGS).collect()
    totals: Counter = Counter()
    for r in spellings:
        totals[label_code(r["lang"])] += r["n"]
    if not spellings:
        return []
    chance = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / totals[label_code(r["lang"])])) for r in spellings], "_l string, _c double")
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = rows.join(F.broadcast(chance), F.col("lang").eqNullSafe(F.col("_l"))).where(draw < F.col("_c")).limit(4 * per_language * (len(totals) + 1)).collect()
    # The draw has a quarter of the limit on average, so the limit only guards the driver; the order is made here, as rows come in any.
    some.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [(r["text"], r["service"], r["source"], {k: v / len(r["_votes"]) for k, v in Counter(r["_votes"]).items()}) for r in some]


def fit(sample: list[tuple[str, str | None, str | None, dict[str, float]]], subjects: list[str]) -> tuple[dict, list[str], Chain]:
    """Terms, sources and chain."""
    terms = choose_terms([(t, s, y) for t, s, _, y in sample])
    sources = [s for s, _ in Counter(s for _, _, s, _ in sample if s).most_common(SOURCES)]
    counter = Counts(terms, subjects)
    counted = [counter(t) for t, _, _, _ in sample]
    counts, sizes = np.array([c for c, _ in counted]).reshape(len(sample), len(subjects)), np.array([n for _, n in counted])
    base = np.array([features(c, n, t, s, sources) for (c, n), (t, _, s, _) in zip(counted, sample)]).reshape(len(sample), 5 + len(sources))
    labels = np.array([[int(y.get(k, 0) > 0) for k in subjects] for _, _, _, y in sample]).reshape(len(sample), len(subjects))
    return terms, sources, Chain.fit(counts, sizes, base, labels)


def assign_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, probability, sentences): the likeliest combination of subject areas of every document.

    `areas` is a parameter table with the subjects; without labelled documents nothing is assigned. A null, empty or blank
    text has no subject; repeated documents give repeated rows. Only the fitting looks at a sample, of about SAMPLE
    labelled documents a language; terms and weights sent to the workers are bounded by it.
    """
    spark = docs.sparkSession
    subjects = sorted({s.strip().lower() for (s,) in areas.select("subject").where("subject IS NOT NULL").distinct().collect()})
    sample = labelled_sample(docs, labels, subjects)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, subject string, probability double, sentences int"
    if not sample or not subjects:
        return spark.createDataFrame([], schema)
    terms, sources, chain = fit(sample, subjects)
    sent = spark.sparkContext.broadcast((terms, sources, chain, subjects))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, sources, chain, subjects = sent.value
        counter = Counts(terms, subjects)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cols: list[list] = [[], [], [], []]
                for i, text, source in zip(*(batch.column(k).slice(lo, 256).to_pylist() for k in range(3))):
                    if not text or text.isspace():
                        continue
                    counts, size = counter(text)
                    if counts.max(initial=0) < SPOKEN:
                        continue
                    for k, p in chain.decode(counts, size, features(counts, size, text, source, sources)):
                        for c, v in zip(cols, (i, subjects[k], round(p, 4), int(counts[k]))):
                            c.append(v)
                types = [batch.schema.field(0).type, pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "subject", "probability", "sentences"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, schema)


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every document with their probabilities and the sentences that speak for them."""
    return assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every document."""
    return p10_subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject, by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p10_found(spark, sf_dir).join(docs, "doc_id").groupBy("subject", "source").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {"p10_found": p10_found, "p10_subjects": p10_subjects, "p10_composition": p10_composition}
SQL: dict[str, str] = {}
