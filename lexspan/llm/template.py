"""Problem 7: page furniture, by template deduction over lines and menu entries.

The tokens of a page are its lines and the entries of its menu-like lines, with slots for numbers and for the site's own
name. A token's occurrence vector says how often it is on each distinct page of its host; tokens of equal vectors make an
equivalence class. A class on most of a host's pages that is a small part of each, on a host whose pages are otherwise
unlike, is that host's template, whatever its tokens look like. As most hosts have few pages and their furniture comes from shared stock, occurrences
are added up over hosts as well: pages known to bear a template, by the structure of a few lines first and by deduced
tokens then, witness for the other tokens on them; further classes of a host nest in its pages that bear a template. Lines made up of template tokens and slots are furniture; the
rest is what the template's open slots hold.
"""

from __future__ import annotations

import marshal
import re
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.layout import MARKER, TAG
from lexspan.sources.tables import stored, table

#: Longest line that is looked at for entries, sides and names (longer ones are one token), longest heading.
LONGEST, SHORT = 200, 60
#: Least pages of a token on several hosts, of one in a valid class, whatever the number of pages.
SUPPORT, CLASS_SUPPORT = 5, 3
#: Bits of the map by which pages leave out tokens that are in no table; sent to the workers, of one size for data of any size.
MAP_BITS = 1 << 26
#: Least tokens of a valid class.
CLASS = 3
#: A host's own template: least pages of its class, least share of the host's pages, greatest share of a page's tokens, and the least
#: share of the host's other occurrences that belong to tokens of one page.
ROOT, ROOT_PAGES, ROOT_TOKENS, UNLIKE = 5, 0.5, 0.4, 0.9
#: Least share of the hosts that know a token well which must have it in their own template.
ROOT_HOSTS = 0.9
#: Parts over which hot tokens and pages are spread in joins.
SALTS = 8
#: Least share of a token's pages that bear a template, and least evidence in nats against chance: plain, closed by a terminator, with a list marker.
NESTED, EVIDENCE = 0.9, (4.0, 12.0, 25.0)

_SEPARATOR = re.compile(r"\s*[|·•»›>]\s*|\s+[-–—/]\s+|\s{2,}")
_SIDE = re.compile(r"(.{2,60}?)(?:\s*[|:：]\s*|\s+[-–—]\s+)(\S.{0,40})$")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_HOST = re.compile(r"^\s*(?:[A-Za-z]+://)?(?:www\.)?([^./:?#\s]+)")
_CLOSED = re.compile(r"[.!?;。！？।؟…][\"”»」')]*$")
_NAME = re.compile(r"(?<![A-Za-z])([A-Za-z]{4,})(?: [A-Za-z]{3,4}(?![A-Za-z]))?")
_EDGES = "[]»«›‹ \t\r​"
END_BIT, MARK_BIT, SHORT_BIT = 1, 2, 4


def host_of(url: str | None) -> str:
    """The first label of a page's host without `www`, in lower case; empty if there is none."""
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


class Name:
    """Puts a slot for a host's name in lower-case text; single spaces may stand between its letters after the third."""

    __slots__ = ("start", "rest")

    def __init__(self, host: str):
        self.start, self.rest = host[:3], host[3:]

    def __call__(self, low: str) -> str:
        at = low.find(self.start)
        if at < 0:
            return low
        out, since, size = [], 0, len(low)
        while at >= 0:
            k = at + 3
            for c in self.rest:
                if k < size and low[k] == c:
                    k += 1
                elif k + 1 < size and low[k] == " " and low[k + 1] == c:
                    k += 2
                else:
                    k = 0
                    break
            if k:
                out.append(low[since:at])
                since = k
                at = low.find(self.start, k)
            else:
                at = low.find(self.start, at + 1)
        out.append(low[since:])
        return "@".join(out)


def name_pattern(host: str) -> Name | None:
    """The slot maker of a host; hosts of one or two letters have none."""
    return Name(host) if len(host) >= 3 else None


def clean(line: str) -> str:
    """A line without tags, brackets and arrows around it."""
    return (TAG.sub("", line) if "<" in line else line).strip(_EDGES)


def slotted(line: str, name: Name | None) -> str:
    """Lower case, with slots for the site's name and for numbers."""
    low = line.lower()
    if name is not None:
        low = name(low)
    return _NUMBER.sub("#", low)


def token_id(slots: str, bits: int = 0) -> int:
    """A signed 64-bit number for a token; its last three bits are its shape."""
    n = xxhash.xxh64_intdigest(slots.encode("utf-8", "replace")) & ~7 | bits
    return n - (1 << 64) if n >> 63 else n


def shape(line: str) -> int:
    """The shape bits of a clean line."""
    closed, marked = _CLOSED.search(line) is not None, MARKER.match(line) is not None
    return closed * END_BIT | marked * MARK_BIT | (not closed and not marked and len(line) <= SHORT) * SHORT_BIT


def entries(line: str) -> list[str]:
    """The entries of a menu-like line, none for other lines."""
    parts = [p for p in _SEPARATOR.split(line) if p and not p.isspace()]
    return parts if len(parts) > 1 else []


def bears_template(line: str, parts: list[str]) -> bool:
    """Structure that marks a page as one with a template: a copyright line, or a menu of four or more short entries."""
    return line[0] == "©" or (len(parts) >= 4 and max(map(len, parts)) < 30)


class Line:
    """What a line is, whatever the host: its clean text, shape and entries, and its tokens where no host's name is in it."""

    __slots__ = ("clean", "low", "bits", "parts", "tokens")

    def __init__(self, line: str):
        self.clean = c = clean(line)
        self.parts, self.low, self.bits, self.tokens = [], "", 0, []
        if c:
            self.bits, self.low = shape(c), c.lower()
            if not self.bits & END_BIT and len(c) <= LONGEST:
                self.parts = entries(c)

    def own(self, name: Name | None) -> int:
        """The line's token on a host."""
        if name is not None and name.start in self.low:
            return token_id(_NUMBER.sub("#", name(self.low)), self.bits)
        if not self.tokens:
            self.tokens = [token_id(_NUMBER.sub("#", self.low), self.bits)]
        return self.tokens[0]

    def all(self, name: Name | None) -> list[int]:
        """The line's token and its entries' tokens on a host."""
        if not self.parts:
            return [self.own(name)]
        if name is not None and name.start in self.low:
            return [self.own(name), *(token_id(slotted(p.strip(_EDGES), name), shape(p)) for p in self.parts)]
        self.own(name)
        if len(self.tokens) == 1:
            self.tokens += [token_id(slotted(p.strip(_EDGES), None), shape(p)) for p in self.parts]
        return self.tokens


class _Lines(dict):
    """Short lines seen by this process; many of them are on many pages."""

    def __missing__(self, line: str) -> Line:
        if len(self) >= 30_000:
            self.clear()
        out = self[line] = Line(line)
        return out


_LINES = _Lines()


def line_of(line: str) -> Line:
    return _LINES[line] if len(line) <= 45 else Line(line)


def page_tokens(text: str, url: str | None) -> tuple[dict[int, int], bool]:
    """How often each token is on a page, and whether some line marks it as one with a template."""
    name, found, seed = name_pattern(host_of(url)), {}, False
    for line in text.split("\n"):
        x = line_of(line)
        if x.low:
            for t in x.all(name):
                found[t] = found.get(t, 0) + 1
            seed = seed or bears_template(x.clean, x.parts)
    return found, seed


#: Stands for an entry that is the site's own name.
_SITE = 1
#: Flags of a line: a copyright line, a menu by its structure, one that may be a short line between furniture, a menu of short entries.
COPYRIGHT, STRUCTURE, CANDIDATE, LOOSE = 1, 2, 4, 8


def sketch(text: str, url: str | None, bits: bytes | None = None) -> tuple[set[int], int, list[tuple]] | None:
    """(keys, number of lines, lines): what has to be known of a page to tell its furniture; None where nothing of it can be furniture.

    keys are those the vocabulary is asked for: a token's own number for the template of all hosts, and the number combined
    with the host's for the host's own; `bits` is a map of those that may be in it. Each line is (place among the lines that are not blank, number, keys of the
    line, flags, keys of its entries, keys of a side's heading, keys with another name in the name's slot); lines that can be nothing are left out.
    """
    host = host_of(url)
    name, mine = name_pattern(host), token_id(host)
    asked: set[int] = set()

    def keys(token: int) -> tuple[int, ...]:
        own = token ^ mine
        if bits is None:
            asked.update((token, own))
            return token, own
        k, j = token >> 3 & MAP_BITS - 1, own >> 3 & MAP_BITS - 1
        if bits[k >> 3] >> (k & 7) & 1:
            asked.add(token)
            if bits[j >> 3] >> (j & 7) & 1:
                asked.add(own)
                return token, own
            return (token,)
        if bits[j >> 3] >> (j & 7) & 1:
            asked.add(own)
            return (own,)
        return ()

    out, place, hopeful = [], -1, False
    for number, line in enumerate(text.split("\n")):
        if not line or line.isspace():
            continue
        x = line_of(line)
        c, shown = x.clean, x.bits
        if not c:
            continue
        place += 1
        own, flags, parts, side, named = keys(x.own(name)), 0, [], (), ()
        size = len(c)
        if c[0] == "©":
            flags |= COPYRIGHT
        if size <= LONGEST:
            if x.parts and not shown & MARK_BIT:
                most = max(map(len, x.parts))
                for part in x.parts:
                    slots = slotted(part.strip(_EDGES), name)
                    parts.append(_SITE if slots == "@" else keys(token_id(slots, shape(part))))
                if len(parts) >= 4 and most < 30 and size < 140:
                    flags |= STRUCTURE
                if not any(parts):
                    parts = []
                elif len(parts) >= 3 and most <= 40:
                    flags |= LOOSE
            if shown & SHORT_BIT:
                flags |= CANDIDATE
            if size <= 110 and not MARKER.match(c):
                if not shown & END_BIT and (m := _SIDE.match(c)) and len(m.group(2).split()) <= 4:
                    slots = slotted(m.group(1).strip(_EDGES), name)
                    side = _SITE if slots == "@" else keys(token_id(slots, shape(m.group(1))))
                named = tuple(k for probe in _probes(c) for k in keys(token_id(slotted(probe, name), shown)))
        hopeful = hopeful or bool(own or flags & (COPYRIGHT | STRUCTURE) or parts)
        if own or flags or parts or side or named:
            out.append((place, number, own, flags, parts, side, named))
    return (asked, place + 1, out) if hopeful else None


def _probes(line: str) -> list[str]:
    """A line with a slot in place of each of its names, if that leaves enough to tell it by."""
    out = []
    for m in _NAME.finditer(line):
        for end in {m.end(), m.end(1)}:
            probe = line[: m.start()] + "@" + line[end:]
            if len(probe) >= 8:
                out.append(probe)
    return out


def _menu(known: list[int], loose: bool) -> bool:
    """Whether a line's entries, 2 for template and 1 for heading, make it a menu."""
    missing = known.count(0)
    return 2 in known and (not missing or loose and missing <= max(1, len(known) // 3))


def decide(size: int, lines: list[tuple], tokens: set[int], headings: set[int]) -> list[int]:
    """Numbers of the furniture lines of a page, from its sketch and those of its keys that the vocabulary has."""

    def value(keys: tuple[int, ...] | int) -> int:
        if keys == _SITE or not tokens.isdisjoint(keys):
            return 2
        return int(not headings.isdisjoint(keys))

    states: list[int] = []
    for _, _, own, flags, parts, _, _ in lines:
        if flags & (COPYRIGHT | STRUCTURE) or not tokens.isdisjoint(own) or parts and _menu([value(k) for k in parts], bool(flags & LOOSE)):
            states.append(2)
        else:
            states.append(int(bool(flags & CANDIDATE) and headings.isdisjoint(own)))
    if 2 not in states:
        return []
    for i, line in enumerate(lines):
        side, named = line[5:]
        if states[i] < 2 and (side and value(side) or not tokens.isdisjoint(named)):
            states[i] = 2
    # Up to three short lines between furniture, or between it and an edge of the page, are furniture.
    i, n = 0, len(lines)
    while i < n:
        if states[i] != 1:
            i += 1
            continue
        j = i + 1
        while j < n and states[j] == 1 and lines[j][0] == lines[j - 1][0] + 1:
            j += 1
        first, final = lines[i][0], lines[j - 1][0]
        before = first == 0 or i > 0 and states[i - 1] == 2 and lines[i - 1][0] == first - 1
        after = final == size - 1 or j < n and states[j] == 2 and lines[j][0] == final + 1
        if before and after and j - i <= 3 and not (first == 0 and final == size - 1):
            states[i:j] = [2] * (j - i)
        i = j
    return [line[1] for line, state in zip(lines, states) if state == 2]


class Template:
    """A vocabulary that fits memory: template keys and headings."""

    def __init__(self, tokens: Iterable[int] = (), headings: Iterable[int] = ()):
        self.tokens, self.headings = set(tokens), set(headings)

    def furniture(self, text: str, url: str | None) -> list[int]:
        """Numbers of the lines of a page that are furniture, from 0."""
        page = sketch(text, url)
        return decide(*page[1:], self.tokens, self.headings) if page else []


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            hosts, pages, tokens, times, seeds = [], [], [], [], []
            for text, url in zip(batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512).to_pylist()):
                if not text or text.isspace():
                    continue
                t, s = page_tokens(text, url)
                hosts.append(token_id(host_of(url)))
                pages.append(token_id(text))
                tokens.append(list(t.keys()))
                times.append(list(t.values()))
                seeds.append(s)
            arrays = [pa.array(hosts, pa.int64()), pa.array(pages, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), pa.array(seeds, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "tokens", "times", "seed"])


_PAGES = "host bigint, page bigint, tokens array<bigint>, times array<int>, seed boolean"


def _evident(base: float) -> F.Column:
    """Whether a token's pages are too many to be nested by chance, given its shape."""
    nats = F.col("pages") * F.lit(log(1 / max(base, 1e-9)))
    marked, closed = F.col("token").bitwiseAND(MARK_BIT) != 0, F.col("token").bitwiseAND(END_BIT) != 0
    return nats >= F.when(marked, EVIDENCE[2]).when(closed, EVIDENCE[1]).otherwise(EVIDENCE[0])


def _first_tokens(pages: DataFrame, base: float) -> DataFrame:
    """(token): plain tokens found almost only on pages whose structure shows a template."""
    rows = pages.select("host", "seed", F.explode("tokens").alias("token"))
    grouped = rows.groupBy("token").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("seed").cast("int")).alias("nested"), F.min("host").alias("_a"), F.max("host").alias("_b"))
    rate = F.col("nested") / F.col("pages")
    sure = rate - F.sqrt(rate * (1 - rate) / F.col("pages")) >= (1 + base) / 2 - 0.02
    plain = F.col("token").bitwiseAND(MARK_BIT | END_BIT) == 0
    chosen = grouped.where((F.col("pages") >= SUPPORT) & (F.col("_a") != F.col("_b")) & sure & plain & _evident(base))
    return stored(chosen.select("token"))


def _witnessed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """`pages` with hits: how many known template tokens a page has, and one more if its structure shows a template."""
    rows = pages.select("host", "page", F.explode("tokens").alias("token")).join(known, "token", "left_semi")
    hits = stored(rows.groupBy("host", "page").agg(F.count(F.lit(1)).cast("int").alias("_h")))
    return pages.join(hits, ["host", "page"], "left").select("host", "page", "tokens", "times", (F.coalesce("_h", F.lit(0)) + F.col("seed").cast("int")).alias("hits"))


def _bearing(counted: DataFrame) -> float:
    """The share of pages that bear a template."""
    return min(0.95, max(0.02, counted.agg(F.avg((F.col("hits") > 0).cast("double")).alias("b")).first()["b"] or 0.0))


def _witnesses() -> list[F.Column]:
    """Pages with a witness, and with two: a known token's own hit is no witness for itself, which `_nested` takes off after the join."""
    return [F.sum((F.col("hits") > n).cast("int")).alias(f"_w{n + 1}") for n in range(2)]


def _nested(counts: DataFrame, known: DataFrame) -> DataFrame:
    """`counts` with nested: pages that bear a template by the witness of other tokens."""
    own = known.withColumn("_own", F.lit(True))
    return counts.join(own, "token", "left").withColumn("nested", F.when(F.col("_own"), F.col("_w2")).otherwise(F.col("_w1"))).drop("_own", "_w1", "_w2")


def _nested_tokens(counted: DataFrame, known: DataFrame) -> DataFrame:
    """(token, pages, nested, hosts): how many of a token's pages bear a template by the witness of other tokens; hosts is 1 or 2 (several)."""
    rows = counted.select("host", "hits", F.explode("tokens").alias("token"))
    grouped = rows.groupBy("token").agg(F.count(F.lit(1)).alias("pages"), *_witnesses(), F.min("host").alias("_a"), F.max("host").alias("_b"))
    return _nested(grouped, known).select("token", "pages", "nested", F.when(F.col("_a") == F.col("_b"), 1).otherwise(2).alias("hosts"))


def equivalence_classes(counted: DataFrame, first: DataFrame) -> DataFrame:
    """(host, token, pages, nested, vector): how a token occurs on the distinct pages of a host.

    The vector of a token on a host is how often it is on each of the host's pages, kept as one combined hash; tokens of equal vectors
    are one equivalence class. nested counts the pages that bear a template by the witness of other tokens. A token of `first` bears no witness for itself.
    """
    rows = counted.select("host", "page", "hits", F.explode(F.arrays_zip("tokens", "times")).alias("_x")).select("host", "page", "hits", F.col("_x.tokens").alias("token"), F.col("_x.times").alias("times"))
    grouped = rows.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), *_witnesses(), F.bit_xor(F.xxhash64("page", "times")).alias("vector"))
    return _nested(grouped, first).select("host", "token", "pages", "nested", "vector")


def valid_classes(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, vector, root): the valid classes of every host, of CLASS tokens on two pages or more.

    A root class needs no witness: it is on ROOT pages and on the share ROOT_PAGES of the host's or more, makes up a small part of
    a page, and the pages are unlike otherwise. All other valid classes nest in the pages that bear a template.
    """
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("_all"))
    spread = vectors.groupBy("host").agg(F.sum("pages").alias("_sum"), F.sum(F.when(F.col("pages") == 1, 1).otherwise(0)).alias("_single"))
    classes = vectors.where("pages >= 2").groupBy("host", "vector").agg(F.count(F.lit(1)).alias("_size"), F.max("pages").alias("pages"), F.bool_and(F.col("nested") == F.col("pages")).alias("_nests")).where(F.col("_size") >= CLASS)
    known = classes.join(sizes.hint("merge"), "host").join(spread.hint("merge"), "host")
    often = (F.col("pages") >= ROOT) & (F.col("pages") >= ROOT_PAGES * F.col("_all"))
    small = F.col("_size") * F.col("_all") <= ROOT_TOKENS * F.col("_sum")
    root = often & small & (F.col("_single") >= UNLIKE * (F.col("_sum") - F.col("_size") * F.col("pages")))
    return known.select("host", "vector", root.alias("root"), "_nests").where("root OR _nests").drop("_nests")


def template_table(docs: DataFrame, text_column: str = "text", url_column: str = "url") -> DataFrame:
    """(key, furniture): the template's keys and, with furniture false, headings of all pages of `docs`.

    A key is a token's number, or the number combined with a host's for tokens of that host's own template: those of its root
    class, unless other hosts that know them as well mostly have them outside of theirs. Hosts have few pages each and their
    templates share most tokens, so occurrences are added up over hosts too: a token belongs to the template of all if its
    pages nest in those that bear one and are too many for chance, or, with less support, if it is in a valid class as well.
    All pages are counted; counts are taken before the shuffle, so a host or line with a third of all rows costs one row a
    task. Exact copies of a text on one host are one page, as their vectors would be equal whatever their lines are. The supports do not depend
    on the number of pages, and no vocabulary is collected: its tables stay distributed. A null url gives an empty host; null, empty and blank texts are no pages.
    """
    pages = stored(docs.select(F.col(text_column).alias("text"), F.col(url_column).alias("url")).mapInArrow(_pages, _PAGES).dropDuplicates(["host", "page"]))
    shown = pages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("seed").cast("int")), F.lit(0)).alias("t")).first()
    base = min(0.95, max(0.02, shown["t"] / max(1, shown["n"])))
    first = _first_tokens(pages, base)
    counted = _witnessed(pages, first)
    base = _bearing(counted)
    wider = _nested_tokens(counted, first).where((F.col("pages") >= SUPPORT) & (F.col("hosts") > 1) & (F.col("nested") >= NESTED * F.col("pages")) & (F.col("token").bitwiseAND(MARK_BIT | END_BIT) == 0) & _evident(base))
    first = stored(first.union(wider.select("token")).distinct())
    counted = _witnessed(pages, first)
    base = _bearing(counted)
    vectors = stored(equivalence_classes(counted, first))
    valid = valid_classes(vectors, pages)
    classed = stored(vectors.where("pages >= 2").join(valid.hint("merge"), ["host", "vector"]).where("root OR nested = pages").select("host", "token", "root", (F.col("nested") == F.col("pages")).alias("inner")))
    known = vectors.groupBy("token").agg(F.sum("pages").alias("pages"), F.sum("nested").alias("nested"), F.count(F.lit(1)).alias("hosts"), F.sum((F.col("pages") >= ROOT).cast("int")).alias("_well"))
    mine = classed.groupBy("token").agg(F.bool_or("inner").alias("_v"), F.sum(F.col("root").cast("int")).alias("_roots"))
    sums = known.join(mine.hint("merge"), "token", "left").withColumn("in_class", F.coalesce("_v", F.lit(False)))
    rate = F.col("nested") / F.col("pages")
    plain = F.col("token").bitwiseAND(MARK_BIT | END_BIT) == 0
    frequent = (F.col("pages") >= SUPPORT) & (F.col("hosts") > 1)
    accepted = (rate >= NESTED) & ((frequent & _evident(base)) | ((F.col("pages") >= CLASS_SUPPORT) & F.col("in_class") & plain))
    heading = frequent & (F.col("token").bitwiseAND(SHORT_BIT) != 0) & (rate < NESTED)
    own = (F.col("_roots") > 0) & ((F.col("hosts") == 1) | (F.col("_roots") > 1) & (F.col("_roots") >= ROOT_HOSTS * F.col("_well")))
    judged = stored(sums.select("token", accepted.alias("accepted"), heading.alias("heading"), F.coalesce(own, F.lit(False)).alias("own")).where("accepted OR heading OR own"))
    roots = classed.where("root").join(judged.where("own AND NOT accepted").hint("merge"), "token", "left_semi")
    return stored(judged.where("accepted OR heading").select(F.col("token").alias("key"), F.col("accepted").alias("furniture")).union(roots.select(F.col("token").bitwiseXOR(F.col("host")), F.lit(True))).distinct())


def deduce_template(docs: DataFrame, text_column: str = "text", url_column: str = "url") -> Template:
    """`template_table`, collected; for small tables whose vocabulary fits the driver."""
    final = template_table(docs, text_column, url_column).collect()
    return Template([r["key"] for r in final if r["furniture"]], [r["key"] for r in final if not r["furniture"]])


def _token_map(keys: DataFrame) -> bytes:
    """MAP_BITS bits, set where some key has its place."""
    place = keys.select(F.shiftright("key", 3).bitwiseAND(MAP_BITS - 1).alias("k"))
    parts = place.groupBy(F.shiftright("k", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("k").bitwiseAND(32767)).alias("bits"))
    out = np.zeros((MAP_BITS >> 15, 4096), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def page_key(text_column: str, url_column: str) -> F.Column:
    """A number for a page: its text and url."""
    return F.xxhash64(text_column, url_column)


def page_furniture(docs: DataFrame, vocabulary: DataFrame, text_column: str = "text", url_column: str = "url") -> DataFrame:
    """(page, lines): the numbers of the furniture lines of every page of `docs` that has any, ascending; page is its `page_key`.

    Pages are reduced to sketches: the lines that may be furniture and the keys to ask for. The questions are joined to the
    distributed vocabulary and the answers to the sketches, so texts are neither shuffled nor read again. What is sent
    to the workers is a map of MAP_BITS bits that only spares questions. Copies of a page are one page.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_token_map(vocabulary))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                pages, sketches, keys = [], [], []
                for page, text, url in zip(*(batch.column(k).slice(lo, 512).to_pylist() for k in range(3))):
                    if text and (found := sketch(text, url, bits)):
                        pages.append(page)
                        sketches.append(marshal.dumps(found[1:]))
                        keys.append(list(found[0]))
                yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["page", "sketch", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                pages, lines = [], []
                for page, seen, tokens, headings in zip(*(batch.column(k).slice(lo, 512).to_pylist() for k in range(4))):
                    if found := decide(*marshal.loads(seen), set(tokens or ()), set(headings or ())):
                        pages.append(page)
                        lines.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(lines, pa.list_(pa.int32()))], names=["page", "lines"])

    rows = docs.select(page_key(text_column, url_column).alias("page"), F.col(text_column).alias("text"), F.col(url_column).alias("url"))
    asked = stored(rows.mapInArrow(ask, "page bigint, sketch binary, keys array<bigint>"))
    # A key on a third of all pages is asked for in several places.
    questions = asked.select("page", "keys").dropDuplicates(["page"]).select("page", F.explode("keys").alias("key"), F.pmod("page", F.lit(SALTS)).cast("int").alias("_s"))
    answers = vocabulary.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    one = lambda which: F.collect_set(F.when(which, F.col("key")))
    found = questions.join(answers.hint("merge"), ["key", "_s"]).groupBy("page").agg(one(F.col("furniture")).alias("_tokens"), one(~F.col("furniture")).alias("_headings"))
    told = asked.select("page", "sketch").dropDuplicates(["page"]).join(found.hint("merge"), "page", "left").select("page", "sketch", "_tokens", "_headings")
    return stored(told.mapInArrow(answer, "page bigint, lines array<int>"))


def with_furniture(docs: DataFrame, found: DataFrame, text_column: str = "text", url_column: str = "url") -> DataFrame:
    """`docs` with _lines: the numbers of its furniture lines from `page_furniture`, null where there are none.

    Pages with furniture are looked up in several places, so copies of one page do not meet in one task.
    """
    keyed = docs.withColumn("_page", page_key(text_column, url_column)).withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    spread = found.select(F.col("page").alias("_page"), F.col("lines").alias("_lines"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    return keyed.join(spread.hint("merge"), ["_page", "_s"], "left").drop("_page", "_s")


def furniture_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", url_column: str = "url") -> DataFrame:
    """(id, line_no) of every non-blank line that is page furniture; lines are divided at the line feed, from 0.

    Texts without any template token or structure have none. Null, empty and blank texts give no rows; repeated rows and null ids come out as
    they went in.
    """
    found = page_furniture(docs, template_table(docs, text_column, url_column), text_column, url_column)
    # Only ids and page numbers go to the join.
    keys = docs.select(F.col(id_column), page_key(text_column, url_column).alias("_page"), F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int").alias("_s"))
    spread = found.select(F.col("page").alias("_page"), F.col("lines").alias("_lines"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    return keys.join(spread.hint("merge"), ["_page", "_s"]).select(id_column, F.explode("_lines").alias("line_no"))


def main_text(text: str, furniture: list[int]) -> str:
    """A text with its furniture lines emptied, so that line numbers stay."""
    if not furniture:
        return text
    gone = set(furniture)
    return "\n".join("" if i in gone else x for i, x in enumerate(text.split("\n")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every furniture line of every document."""
    return furniture_lines(table(spark, sf_dir, "documents"))


def p7_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without its furniture lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "url")
    found = with_furniture(docs, page_furniture(docs, template_table(docs)))
    kept = F.transform(F.split("text", "\n"), lambda line, number: F.when(F.array_contains("_lines", number), "").otherwise(line))
    return found.select("doc_id", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("main_text"))


QUERIES = {"p7_found": p7_found, "p7_main": p7_main}
SQL: dict[str, str] = {}
