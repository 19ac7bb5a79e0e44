"""Word splitting shared by the operators: runs without ASCII white space."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words as long; null gives 0."""
    return F.size(words(text)).cast("long")
