"""Column expressions for texts. White space is \\x20 and \\x09-\\x0D throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters between words.
WS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; a null or blank text has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, WS_RUN))


def n_words(text: Column) -> Column:
    """Number of words, as long."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, WS_RUN))).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How often characters of ``chars`` occur in the text, as long."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")
