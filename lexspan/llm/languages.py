"""Problem 5: the language of every document and of passages in other languages, by nearest centroids.

Segments are TF-IDF vectors of hashed letter n-grams, compared by cosine with several clustered centroids per language;
a segment too far from all of them has no language. The centroids come from a bounded sample of labelled documents: the
sample's segments are clustered without their labels, and a cluster takes the label that most of the corpus' documents
in it bear, so that wrong labels, being few in every cluster, name none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.layout import blocks
from lexspan.llm.sentences import _quotations, unit_starts
from lexspan.llm.template import page_furniture, template_table, with_furniture
from lexspan.sources.tables import scratch_path, table

#: Documents in the sample for each language named by labels (and as many without a usable label), spellings of labels looked at.
SAMPLE, SPELLINGS = 150, 500
#: Segments of a sampled document, and of the whole sample, that the centroids are fitted on.
SEGMENTS, MOST = 6, 9_000
#: Hash space of the n-grams, clusters per language, rounds of clustering.
SPACE, CLUSTERS, ROUNDS = 1 << 15, 3, 8
#: A segment's least cosine to its centroid, as a share of the mean cosine of the centroid's own segments.
REJECT = 0.45
#: Share of its best cosine from which a sampled segment follows the rest of its document.
FOLLOW = 0.5
#: Least share of a cluster's segments whose documents are in its language.
PURE = 0.8
#: Lead under which a text's best language does not speak against its label.
LEAD = 0.05
#: Least mean lead of the sentences of a passage in another language.
PASSAGE_LEAD = 0.15
#: Letters of the shortest segment that is judged by itself; letters of scripts without spaces count threefold.
LEAST_LETTERS = 24
SEED = 5

# ISO 639 codes of two letters, each with its codes of three letters and its English name.
LANGUAGES = """
en eng english | de deu ger german | fr fra fre french | es spa spanish castilian | pt por portuguese | ru rus russian | zh zho chi chinese cmn mandarin |
ja jpn japanese | hi hin hindi | th tha thai | it ita italian | nl nld dut dutch flemish | af afr afrikaans | gl glg galician | mr mar marathi | bg bul bulgarian |
lo lao | uk ukr ukrainian | pl pol polish | cs ces cze czech | sk slk slo slovak | sv swe swedish | da dan danish | no nor norwegian | nb nob | nn nno | fi fin finnish |
hu hun hungarian | ro ron rum romanian | el ell gre greek | tr tur turkish | ar ara arabic | he heb hebrew | fa fas per persian farsi | ur urd urdu | bn ben bengali |
ta tam tamil | te tel telugu | ko kor korean | vi vie vietnamese | id ind indonesian | ms msa may malay | ca cat catalan | eu eus baq basque | ga gle irish |
cy cym wel welsh | is isl ice icelandic | et est estonian | lv lav latvian | lt lit lithuanian | sl slv slovenian slovene | hr hrv croatian | sr srp serbian | bs bos bosnian |
mk mkd mac macedonian | sq sqi alb albanian | be bel belarusian | kk kaz kazakh | ka kat geo georgian | hy hye arm armenian | az aze azerbaijani | ne nep nepali |
pa pan punjabi | gu guj gujarati | kn kan kannada | ml mal malayalam | si sin sinhala | km khm khmer | my mya bur burmese | mn mon mongolian | sw swa swahili |
tl tgl tagalog | fil filipino | la lat latin | eo epo esperanto | lb ltz luxembourgish | mt mlt maltese | yi yid yiddish | sa san sanskrit | bo bod tib tibetan | am amh amharic
"""
_CODES = {name: names[0] for part in LANGUAGES.split("|") if (names := part.split()) for name in names}


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, whatever its spelling; None for null, blank and placeholders."""
    if label is None:
        return None
    low = label.strip().lower()
    if low in _CODES:
        return _CODES[low]
    return _CODES.get(re.split(r"[-_\s(/;,.]", low, maxsplit=1)[0])


def _letter_table() -> np.ndarray:
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = c
    return out


_LETTERS: list[np.ndarray] = []
_ADDRESS_MARKS = ("@", "://", "www.")


def without_addresses(text: str) -> str:
    """A text whose web and mail addresses are blanked: the visible ASCII characters around `@`, `://` and `www.`."""
    spans = []
    for mark in _ADDRESS_MARKS:
        at = text.find(mark)
        while at >= 0:
            a, b = at, at + len(mark)
            while a and "!" <= text[a - 1] <= "~" and text[a - 1] not in "(<[\"'":
                a -= 1
            while b < len(text) and "!" <= text[b] <= "~":
                b += 1
            spans.append((a, b))
            at = text.find(mark, b)
    if not spans:
        return text
    out, since = [], 0
    for a, b in sorted(spans):
        if b > since:
            out.append(text[since : max(a, since)])
            since = b
    out.append(text[since:])
    return " ".join(out)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text: (text number, n-gram, count), and the letters of each text.

    Runs of three letters, of two in scripts with many characters; all else counts as one space. Everything is done on one array.
    """
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    joined = "  \n".join(texts).lower()
    if joined.count("\n") != len(texts) - 1:
        joined = "  \n".join(t.replace("\n", " ") for t in texts).lower()
    joined = without_addresses(joined)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.cumsum(raw == 10, dtype=np.int32)
    c = _LETTERS[0][np.minimum(raw, 0xFFFF)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0) | (owner[1:] != owner[:-1])
    c, owner = c[keep], owner[keep]
    wide = c >= 0x2E80
    letters = np.bincount(owner, weights=(c != 0) + 2.0 * (wide | ((c >= 0x0E00) & (c < 0x0F00))), minlength=len(texts))
    if len(c) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32), letters
    a, b, d = c[:-2].astype(np.uint64), c[1:-1].astype(np.uint64), c[2:].astype(np.uint64)
    d = np.where(wide[1:-1], np.uint64(0), d)
    h = (a * np.uint64(0x9E3779B1) ^ b * np.uint64(0x85EBCA77) ^ d * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h >> np.uint64(65 - SPACE.bit_length())).astype(np.int64)
    fine = (owner[:-2] == owner[2:]) & ((c[:-2] != 0) | (c[1:-1] != 0)) & (c[1:-1] != 0)
    key = owner[:-2][fine].astype(np.int64) * SPACE + h[fine]
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    return (key // SPACE).astype(np.int32), (key % SPACE).astype(np.int32), counts, letters


class Centroids:
    """Clustered centroids with their languages."""

    def __init__(self, weights: np.ndarray, idf: np.ndarray, langs: list[str], bars: np.ndarray):
        self.weights, self.idf, self.langs, self.bars = weights, idf, langs, bars
        self.codes = sorted(set(langs))
        self.of = np.array([self.codes.index(x) for x in langs], np.int32)

    def classify(self, texts: list[str], chunk: int = 100_000, reject: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the number of its language (-1: too far from all, or nothing to judge), a confidence from 0 to 1, and its letters.

        The confidence is the lead of the best cosine over that of the best other language, as a share of the best.
        """
        langs, sure, letters = [], [], []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) < chunk):
                size += len(texts[hi])
                hi += 1
            a, b, c = self._some(texts[lo:hi], reject)
            langs.append(a)
            sure.append(b)
            letters.append(c)
            lo = hi
        if not langs:
            return np.empty(0, np.int32), np.empty(0), np.empty(0)
        return np.concatenate(langs), np.concatenate(sure), np.concatenate(letters)

    def _some(self, texts: list[str], reject: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        row, gram, count, letters = grams(texts)
        lang, lead = np.full(n, -1, np.int32), np.zeros(n)
        if not len(row) or not len(self.langs):
            return lang, lead, letters
        w = (1 + np.log(count)) * self.idf[gram]
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rows = row[starts]
        norm = np.sqrt(np.add.reduceat(w * w, starts)) + 1e-9
        dots = np.add.reduceat(self.weights[gram] * w[:, None], starts, axis=0) / norm[:, None]
        best = np.full((len(rows), len(self.codes)), -1.0, np.float32)
        for k, c in enumerate(self.of):
            np.maximum(best[:, c], dots[:, k], out=best[:, c])
        top = dots.argmax(axis=1)
        value = dots[np.arange(len(rows)), top]
        code = self.of[top]
        best[np.arange(len(rows)), code] = 0
        second = best.max(axis=1) if len(self.codes) > 1 else np.zeros(len(rows))
        fine = value >= (self.bars[top] if reject else 1e-6)
        lang[rows[fine]] = code[fine]
        lead[rows] = np.clip((value - second) / np.maximum(value, 1e-9), 0, 1)
        return lang, lead, letters


def sample_documents(docs: DataFrame, text_column: str, lang_column: str, per_label: int = SAMPLE) -> list[tuple[str, str | None, float]]:
    """(text, label's code, documents it stands for): about `per_label` documents of each named language and of no usable label.

    Only the fitting of the centroids looks at a sample; its size is at most per_label times the languages of LANGUAGES.
    """
    labels = docs.where(F.length(F.trim(F.col(text_column))) > 40).groupBy(F.col(lang_column).alias("l")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(SPELLINGS).collect()
    totals: Counter = Counter()
    for r in labels:
        totals[label_code(r["l"])] += r["n"]
    spark = docs.sparkSession
    chance = [(r["l"], min(1.0, per_label / totals[label_code(r["l"])])) for r in labels]
    at = F.broadcast(spark.createDataFrame(chance, "_l string, _c double"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(text_column)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = docs.where(F.length(F.trim(F.col(text_column))) > 40).select(F.col(text_column).alias("t"), F.col(lang_column).alias("l"), draw.alias("_d")).join(at, F.col("l").eqNullSafe(F.col("_l"))).where("_d < _c").select("t", "l", "_c").limit(4 * per_label * (len(totals) + 1)).collect()
    # The draw has a quarter of the limit on average, so the limit only guards the driver; the order is made here, as rows come in any.
    rows.sort(key=lambda r: (r["t"], r["l"] or ""))
    return [(r["t"], label_code(r["l"]), 1 / r["_c"]) for r in rows]


def fit_centroids(sample: list[tuple[str, str | None, float]], clusters: int = CLUSTERS, rounds: int = ROUNDS, most: int = MOST) -> Centroids:
    """Cluster the sample's segments around the labels' means and name each cluster by its documents' labels."""
    rng = np.random.default_rng(SEED)
    texts, codes, stands, owners = [], [], [], []
    for number, (text, code, weight) in enumerate(sample):
        parts = [b for _, b in blocks(text) if len(b) >= 50]
        if len(parts) == 1 and len(parts[0]) > 600:
            whole = parts[0]
            parts = [whole[i : i + 300] for i in range(0, len(whole) - 100, 300)]
        for p in rng.permutation(len(parts))[:SEGMENTS]:
            texts.append(parts[p])
            codes.append(code)
            stands.append(weight)
            owners.append(number)
    if len(texts) > most:
        pick = rng.permutation(len(texts))[:most]
        texts, codes, stands, owners = ([x[i] for i in pick] for x in (texts, codes, stands, owners))
    names = sorted({c for c in codes if c})
    if not names:
        return Centroids(np.zeros((SPACE, 0), np.float32), np.zeros(SPACE, np.float32), [], np.zeros(0))
    row, gram, count, _ = grams(texts)
    n = len(texts)
    df = np.bincount(gram, minlength=SPACE)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
    w = ((1 + np.log(count)) * idf[gram]).astype(np.float32)
    norm = np.sqrt(np.bincount(row, weights=w * w, minlength=n)) + 1e-9
    w /= norm[row]
    starts = np.searchsorted(row, np.arange(n + 1))

    def mean(members: np.ndarray) -> np.ndarray:
        out = np.zeros(SPACE, np.float32)
        for i in members:
            out[gram[starts[i] : starts[i + 1]]] += w[starts[i] : starts[i + 1]]
        return out / (np.linalg.norm(out) + 1e-9)

    nonempty = np.flatnonzero(starts[1:] > starts[:-1])

    def cosines(cents: np.ndarray) -> np.ndarray:
        dots = np.zeros((n, cents.shape[1]), np.float32)
        for lo in range(0, len(nonempty), 1000):
            part = nonempty[lo : lo + 1000]
            a, b = starts[part[0]], starts[part[-1] + 1]
            dots[part] = np.add.reduceat(cents[gram[a:b]] * w[a:b, None], (starts[part] - a).astype(np.int64), axis=0)
        return dots

    def cluster(members: np.ndarray, groups: int) -> list[np.ndarray]:
        parts = np.array_split(rng.permutation(members), min(groups, max(1, len(members) // 8)))
        return [mean(p) for p in parts if len(p)]

    code_of = np.array([names.index(c) if c else -1 for c in codes])
    cents = np.array([m for k in range(len(names)) for m in cluster(np.flatnonzero(code_of == k), clusters)]).T
    place = np.zeros(n, np.int64)
    for _ in range(rounds):
        place = cosines(cents).argmax(axis=1)
        kept = [m for k in range(cents.shape[1]) if len(m := np.flatnonzero(place == k)) >= min(5, max(1, n // 50))]
        cents = np.array([mean(m) for m in kept]).T
    # Clusters are named by the votes of their documents' labels, each counting for the documents it stands for.
    weight, voted = np.array(stands), []
    for members in kept:
        votes: Counter = Counter()
        for i in members:
            if codes[i]:
                votes[codes[i]] += weight[i]
        code, won = votes.most_common(1)[0] if votes else (None, 0)
        voted.append(code if code and won >= 0.5 * sum(votes.values()) else None)
    dots = cosines(cents)
    for last in (False, True):
        found = sorted({c for c in voted if c})
        if not found:
            return Centroids(np.zeros((SPACE, 0), np.float32), idf, [], np.zeros(0))
        by = np.stack([dots[:, [k for k, c in enumerate(voted) if c == code]].max(axis=1) for code in found], axis=1)
        # A segment between two languages follows the rest of its document.
        sums = np.zeros((len(sample), len(found)), np.float32)
        np.add.at(sums, owners, by)
        own = by.argmax(axis=1)
        rest = sums.argmax(axis=1)[owners]
        own = np.where(by[np.arange(n), rest] >= FOLLOW * by[np.arange(n), own], rest, own)
        if not last:
            # A cluster of what documents of several languages have alike, such as addresses and notices, names no language.
            voted = [c if c and np.mean(rest[m] == found.index(c)) >= PURE else None for c, m in zip(voted, kept)]
    out, langs, bars = [], [], []
    for k, code in enumerate(found):
        members = np.intersect1d(np.flatnonzero(own == k), nonempty)
        if not len(members):
            continue
        inner = np.array(cluster(members, clusters)).T
        for _ in range(3):
            near = cosines(inner)[members]
            inner = np.array([mean(members[near.argmax(axis=1) == j]) if (near.argmax(axis=1) == j).any() else inner[:, j] for j in range(inner.shape[1])]).T
        near = cosines(inner)[members]
        for j in range(inner.shape[1]):
            mine = near[near.argmax(axis=1) == j, j]
            out.append(inner[:, j])
            langs.append(code)
            bars.append(REJECT * float(mine.mean()) if len(mine) else 1.0)
    return Centroids(np.ascontiguousarray(np.array(out).T, np.float32), idf, langs, np.array(bars, np.float32))


def without_quotations(text: str) -> str:
    """A text whose quoted passages of two words or more are blanked."""
    for a, b in _quotations(text):
        inner = text[a + 1 : b]
        if len(inner) >= 12:
            text = text[: a + 1] + " " * len(inner) + text[b:]
    return text


class Judge:
    """Main language, further languages and segments of texts."""

    def __init__(self, centroids: Centroids):
        self.centroids = centroids

    def segments(self, text: str) -> list[tuple[int, str]]:
        """Paragraphs; the sentence units of a text on one line."""
        parts = list(blocks(text))
        if len(parts) == 1 and len(parts[0][1]) > 150:
            starts = unit_starts(text)
            return [(a, text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)])]
        return parts

    def judge(self, texts: list[str], furniture: list[list[int] | None] | None = None) -> list[tuple[str | None, float, list[tuple[str, int, int, float]]]]:
        """Per text (main language, confidence, passages (language, start, end, confidence) in other languages); furniture has each text's furniture lines."""
        out = self.alike(texts)
        mixed = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(mixed, self.mixed([texts[i] for i in mixed], [furniture[i] if furniture else None for i in mixed])):
            out[i] = x
        return out

    def alike(self, texts: list[str]) -> list[tuple[str | None, float, list] | None]:
        """The results of texts whose segments are all in one language or have nothing to judge; None for the others."""
        c = self.centroids
        parts = [self.segments(t) for t in texts]
        # Segments too short to be judged by themselves wait for the second look at their text.
        flat = [s if len(s) >= LEAST_LETTERS or len(s) >= LEAST_LETTERS / 3 and not s.isascii() else "" for p in parts for _, s in p]
        lang, lead, letters = c.classify(flat)
        out: list = []
        at = 0
        for p in parts:
            sl = slice(at, at + len(p))
            at += len(p)
            known, size, sure = lang[sl], letters[sl], lead[sl]
            judged = (size >= LEAST_LETTERS) & (known >= 0)
            if judged.any() and (known[judged] == known[judged][0]).all():
                out.append((c.codes[known[judged][0]], float(np.average(sure[judged], weights=size[judged])), []))
            else:
                out.append(None if p else (None, 0.0, []))
        return out

    def mixed(self, texts: list[str], furniture: list[list[int] | None]) -> list[tuple[str | None, float, list[tuple[str, int, int, float]]]]:
        """Texts whose segments differ: without furniture and quotations, sentence by sentence.

        A sentence too short to be judged by itself votes as its paragraph does, if that is of one mind.
        """
        parts = [self.segments(t) for t in texts]
        out: list = [(None, 0.0, [])] * len(texts)
        c = self.centroids
        units: list[str] = []
        spans: list[list[tuple[int, int, int]]] = []
        for i in range(len(texts)):
            gone, lines, pos = set(furniture[i] or ()), [], 0
            for k, x in enumerate(texts[i].split("\n")):
                if k in gone:
                    lines.append((pos, pos + len(x)))
                pos += len(x) + 1
            mine = []
            for n, (a, s) in enumerate(parts[i]):
                if any(x <= a < y or x < a + len(s.rstrip()) <= y for x, y in lines):
                    continue
                bare = without_quotations(s)
                starts = unit_starts(s)
                for x, y in zip(starts, [*starts[1:], len(s)]):
                    mine.append((n, a + x, a + y))
                    units.append(bare[x:y])
            spans.append(mine)
        lang, lead, letters = c.classify(units)
        at = 0
        for i, mine in enumerate(spans):
            sl = slice(at, at + len(mine))
            at += len(mine)
            known, size, sure = lang[sl], letters[sl], lead[sl]
            judged = (size >= LEAST_LETTERS) & (known >= 0)
            if not judged.any():
                rest = "\n".join(texts[i][a:b] for _, a, b in mine) or texts[i]
                whole, conf, _ = c.classify([rest], reject=False)
                out[i] = (c.codes[whole[0]] if whole[0] >= 0 else None, float(conf[0]), [])
                continue
            minds: dict[int, set[int]] = {}
            for k in np.flatnonzero(judged):
                minds.setdefault(mine[k][0], set()).add(int(known[k]))
            follows = [minds[n].copy().pop() for k, (n, _, _) in enumerate(mine) if not judged[k] and size[k] > 0 and len(minds.get(n, ())) == 1]
            votes = np.bincount(np.concatenate([known[judged], np.array(follows, np.int32)]), minlength=len(c.codes))
            ties = np.flatnonzero(votes == votes.max())
            main = ties[0] if len(ties) == 1 else max(ties, key=lambda k: size[judged][known[judged] == k].sum())
            per_line = len(parts[i]) > 1 and len({n for n, _, _ in mine}) == len(mine) and len(mine) == len(unit_starts(texts[i])) and "\n" not in texts[i].strip()
            groups: dict[int, list[int]] = {}
            for k, (n, _, _) in enumerate(mine):
                groups.setdefault(n, []).append(k)
            if per_line:
                # On one line a run of sentences in one language is a paragraph.
                runs: list[list[int]] = []
                for k in range(len(mine)):
                    if runs and known[runs[-1][-1]] == known[k]:
                        runs[-1].append(k)
                    else:
                        runs.append([k])
                groups = dict(enumerate(runs))
            passages = []
            for members in groups.values():
                own = [k for k in members if judged[k]]
                if not own:
                    continue
                first = known[own[0]]
                if first == main or any(known[k] != first for k in own):
                    continue
                whole = None
                if sum(size[k] for k in own) < 0.5 * sum(max(size[k], 1) for k in members):
                    # Sentences too far from all centroids by themselves: the paragraph is judged as a whole.
                    code, conf, _ = c.classify([" ".join(units[sl.start + k] for k in members)])
                    if code[0] != first:
                        continue
                    whole = float(conf[0])
                # A quotation with a short lead-in says nothing about its paragraph.
                shown = sum(mine[k][2] - mine[k][1] for k in members)
                if sum(size[k] for k in members) < 0.3 * shown:
                    continue
                lead_in = float(np.average([sure[k] for k in own], weights=[size[k] for k in own])) if whole is None else whole
                if lead_in >= PASSAGE_LEAD:
                    passages.append((c.codes[first], mine[members[0]][1], mine[members[-1]][2], lead_in))
            mine_sure = judged & (known == main)
            out[i] = (c.codes[main], float(np.average(sure[mine_sure], weights=size[mine_sure]) * votes[main] / votes.sum()), passages)
        return out


def judge_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", url_column: str = "url") -> DataFrame:
    """(id, label, kind, lang, char_start, char_end, confidence): one row of kind `main` for every text that is not null or blank,
    and one of kind `passage` for every paragraph in another language; ends are exclusive.

    label is the code that the given label names, null if none. A text with hardly a lead of one language over another keeps
    the language of its label. lang is null where there is no letter to judge. Null, empty and blank texts have no row; repeated rows and null ids come out as they went in.

    One pass judges the texts whose segments agree; the others, which are few, go on with their text and are judged without
    their page furniture, by the template of all pages. Sizes sent to the workers are fixed: SPACE by the centroids of the languages that occur, and the map of template tokens.
    """
    spark = docs.sparkSession
    centroids = fit_centroids(sample_documents(docs, text_column, lang_column))
    sent = spark.sparkContext.broadcast((centroids.weights, centroids.idf, centroids.langs, centroids.bars))
    kind_of_id = docs.schema[id_column].dataType.simpleString()
    schema = "id {}, label string, kind string, lang string, char_start int, char_end int, confidence double".format(kind_of_id)
    names = ["id", "label", "kind", "lang", "char_start", "char_end", "confidence"]

    def table_of(rows: list[tuple], results: list, codes: list[str], kind: pa.DataType, keep: bool) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9 if keep else 7)]
        for (i, text, label, url), result in zip(rows, results):
            code = label_code(label)
            if result is None:
                rest = [(i, code, None, None, None, None, None, text, url)]
            else:
                main, sure, passages = result
                if code in codes and sure < LEAD:
                    main = code
                rest = [(i, code, k, lang, a, b, round(conf, 4), None, None) for k, lang, a, b, conf in [("main", main, 0, len(text), sure), *(("passage", *p) for p in passages)]]
            for row in rest:
                for c, v in zip(cols, row):
                    c.append(v)
        types = [kind, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*names, "text", "url"][: len(cols)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(Centroids(*sent.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = [r for r in zip(*(batch.column(k).slice(lo, 128).to_pylist() for k in range(4))) if r[1] and not r[1].isspace()]
                yield table_of(rows, judge.alike([r[1] for r in rows]), judge.centroids.codes, batch.schema.field(0).type, True)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(Centroids(*sent.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                rows = list(zip(*(batch.column(k).slice(lo, 128).to_pylist() for k in range(5))))
                yield table_of([r[:4] for r in rows], judge.mixed([r[1] for r in rows], [r[4] for r in rows]), judge.centroids.codes, batch.schema.field(0).type, False)

    path = scratch_path(spark, "languages")
    docs.select(id_column, text_column, lang_column, url_column).mapInArrow(first, schema + ", text string, url string").write.parquet(path)
    judged = spark.read.parquet(path)
    mixed = judged.where("text IS NOT NULL").select("id", "text", F.col("label").alias("lang"), "url")
    found = page_furniture(mixed, template_table(docs, text_column, url_column))
    again = with_furniture(mixed, found).select("id", "text", "lang", "url", "_lines").mapInArrow(second, schema)
    return judged.where("text IS NULL").select(*names).union(again).withColumnRenamed("id", id_column)


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and passages in other languages, with confidences."""
    return judge_languages(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and wrong labels, and further languages of whole paragraphs."""
    judged = judge_languages(table(spark, sf_dir, "documents")).where("lang IS NOT NULL")
    kind = F.when(F.col("kind") == "passage", "mixed").when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("lang"), "wrong")
    return judged.select("doc_id", kind.alias("kind"), "lang").where("kind IS NOT NULL").distinct()


QUERIES = {"p5_found": p5_found, "p5_languages": p5_languages}
SQL: dict[str, str] = {}
