"""Word and normalisation expressions shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: Java regular expression of the characters that separate words.
SPACE = r"[\x20\x09-\x0D]"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null or empty."""
    return F.filter(F.split(whole(text), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as long: the size of the array that ``words`` makes."""
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(whole(text), string.ascii_uppercase, string.ascii_lowercase)
