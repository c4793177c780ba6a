"""Lines and blocks of a text with their positions, whatever its layout: marked up, hard-wrapped, or on one line."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|a|span|small|sup|sub|font|code|q|mark)\b", re.IGNORECASE)
MARKER = re.compile(r"(?:[-*•‣▪]|\d{1,3}[.)]|\([A-Za-z0-9]{1,3}\)|[a-z]\))\s+(?=\S)")
_WORD = re.compile(r"\S+")
#: Widest line of hard-wrapped text.
WIDEST = 100
#: Characters by which later edits may have changed a wrapped line.
SLACK = 3
#: Share of lines that may be longer than the width.
LONGER = 0.05


def blank_tags(text: str) -> str:
    """Tags replaced by as many line feeds (block tags, and inline ones that stand at a block's edge) or spaces."""
    if "<" not in text:
        return text

    def fill(m: re.Match) -> str:
        tag, n = m.group(), m.end() - m.start()
        if _INLINE.match(tag):
            around = text[m.end() : m.end() + 40].lstrip(" \t") if tag[1] == "/" else text[max(0, m.start() - 40) : m.start()].rstrip(" \t")
            edge = around[:1] if tag[1] == "/" else around[-1:]
            if edge not in ("", "\n", "\r", "<", ">"):
                return " " * n
        return "\n" * n

    return TAG.sub(fill, text)


def _width(lines: list[str]) -> int:
    """The width at which the lines are wrapped, 0 if they are not.

    A line of some length that ends in a word, before one that goes on in small letters, shows the width. In scripts
    without capitals only lines of nearly the same length show one.
    """
    cased, caseless, width = [], [], 0
    for a, b in zip(lines, lines[1:]):
        if not 40 <= len(a) <= WIDEST or not b or not (a[-1].isalnum() or a[-1] in ",;-'\"" or _marks(a[-1])):
            continue
        if b[0].islower():
            cased.append(len(a))
        elif b[0].isalpha() and not b[0].isupper():
            caseless.append(len(a))
    if cased:
        width = max(cased) if len(cased) > 1 or max(cased) >= 60 else 0
    elif len(caseless) > 1 and sum(x > max(caseless) - 20 for x in caseless) >= 0.6 * len(caseless):
        width = max(caseless)
    # Wrapped text has hardly a longer line.
    return width if sum(len(x) > width + 15 for x in lines) <= LONGER * len(lines) else 0


def _marks(c: str) -> bool:
    return unicodedata.category(c)[0] == "M"


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(place, content) of each block: a line, or the lines of one wrapped paragraph or item. Blank lines are left out.

    A line of wrapped text goes on in the next one if that line's first word would not have fitted on it, unless the next
    line begins with a list marker.
    """
    flat = blank_tags(text)
    if "\n" not in flat:
        if flat.strip():
            yield 0, flat
        return
    lines = flat.split("\n")
    width = 0
    if flat is text and sum(map((WIDEST + 16).__le__, map(len, lines))) <= LONGER * len(lines):
        width = _width([x.rstrip() for x in lines])
    at, start, held = 0, 0, ""
    for line in lines:
        bare = line.rstrip()
        if not bare or bare.isspace():
            if held:
                yield start, held
                held = ""
        elif held and width and (word := _WORD.match(bare)) and width - SLACK < len(last) + 1 + len(word.group()) and len(last) <= width + 8 and not MARKER.match(bare):
            held = text[start : at + len(line)]
            last = bare
        else:
            if held:
                yield start, held
            start, held, last = at, line, bare
        at += len(line) + 1
    if held:
        yield start, held
