"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.wordlists import function_words

#: Fixed value: delimiters of glosses.
GLOSS_DELIMITERS = r"[ \t\n\r\f,.:;?!{}()\[\]']+"
#: Fixed value: ASCII punctuation.
PUNCTUATION = r"^[!-/:-@\[-`{-~]+$"
#: Penn tags of each simple class.
POS_CLASSES = {"JJ": "JJ JJR JJS", "RB": "RB RBR RBS", "NN": "NN NNS NNP NNPS", "CD": "CD", "VB": "VB VBD VBG VBN VBP VBZ"}


def gloss_tokens(text: Column) -> Column:
    """Words of a gloss in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GLOSS_DELIMITERS), lambda x: x != "")


def is_punctuation(form: Column) -> Column:
    """Whether a form is of ASCII punctuation only; false for null and empty forms."""
    return F.coalesce(form.rlike(PUNCTUATION), F.lit(False))


def is_content_word(form: Column, words: frozenset[str] | None = None) -> Column:
    """Neither punctuation nor a function word; null and empty forms are none."""
    listed = F.lower(form).isin(sorted(words or function_words()))
    return F.coalesce((form != "") & ~is_punctuation(form) & ~listed, F.lit(False))


def simple_pos(tag: Column) -> Column:
    """Penn tag to JJ, RB, NN, CD, VB or FUNCTION."""
    out = F.lit("FUNCTION")
    for name, tags in POS_CLASSES.items():
        out = F.when(tag.isin(tags.split()), name).otherwise(out)
    return out


def first_letter_pos(tag: Column) -> Column:
    """Penn tag to N, V, J, R or X by its first letter."""
    head = F.upper(F.substring(tag, 1, 1))
    return F.when(head.isin("N", "V", "J", "R"), head).otherwise("X")


def truncate_words(text: Column, n: int) -> Column:
    """The first ``n`` words of a text, parted at single spaces."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def hash28(s: Column) -> Column:
    """First 28 bits of md5 as a long; the same in any engine with md5."""
    return F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("long")
