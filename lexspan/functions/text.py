"""Text functions as Columns. Positions count code points from 0, ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that end a sentence, and tags that are only blanked.
END_TAGS = ["</p>", "</li>"]
PLAIN_TAGS = ["<p>", "<li>", "<b>", "</b>", "<i>", "</i>", "<u>", "</u>", "<ul>", "</ul>", "<strong>", "</strong>"]
#: One sentence: text up to a run of terminators and the white space after it. Valid for Java and RE2 alike.
SENTENCE = r"[^.!?]+[.!?]*\s*|[.!?]+\s*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_tags(text: Column | str) -> Column:
    """A text with its common tags blanked; the length stays, so positions hold."""
    out = col(text)
    for tag in END_TAGS:
        out = F.replace(out, F.lit(tag), F.lit("." + " " * (len(tag) - 1)))
    for tag in PLAIN_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(" " * len(tag)))
    return out


def blank_tags_sql(text: str) -> str:
    """The same in SQL."""
    for tag in END_TAGS:
        text = f"replace({text}, '{tag}', '.{' ' * (len(tag) - 1)}')"
    for tag in PLAIN_TAGS:
        text = f"replace({text}, '{tag}', '{' ' * len(tag)}')"
    return text


def is_blank(text: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~col(text).rlike(r"\S"), F.lit(True))


def part(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Characters start..end; a null end means the end of the text, a negative start the beginning."""
    lo = F.greatest(col(start), F.lit(0))
    return F.substring(col(text), lo + 1, F.greatest(F.coalesce(col(end), F.length(col(text))) - lo, F.lit(0)))


def occurrences(text: Column | str, what: Column | str) -> Column:
    """How often `what` occurs, without overlaps; 0 for an empty `what`."""
    n = F.length(col(what))
    return F.when(n > 0, ((F.length(col(text)) - F.length(F.replace(col(text), col(what), F.lit("")))) / n).cast("int")).otherwise(0)


def sentence_list(text: Column | str) -> Column:
    """The pieces of a text that follow SENTENCE; together they are the text."""
    return F.regexp_extract_all(col(text), F.lit(SENTENCE), F.lit(0))


def word_ngrams(text: Column | str) -> Column:
    """Words of letters and digits in lower case, and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(r"[a-z0-9]+"), F.lit(0))
    # Not by index: inside a lambda the list of words would be made anew for every word.
    left, right = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words))
    pairs = F.zip_with(left, right, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)
