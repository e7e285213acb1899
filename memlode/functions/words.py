"""Word sets of texts.

The words of a text are its maximal runs of letters and digits (Unicode L and N) after lower-casing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(text: Column | str) -> Column:
    """All words in order; null for a null text, an empty array for a text without words."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(f"({WORD})"), F.lit(1))


def word_set(text: Column | str) -> Column:
    """The distinct words, in order of first occurrence."""
    return F.array_distinct(words(text))


def word_hashes(text: Column | str) -> Column:
    """The distinct words as 64-bit hashes."""
    return F.transform(word_set(text), lambda w: F.xxhash64(w))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection of two sets by that of their union; 1.0 for two empty sets, null if either is null."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    value = F.when(either == 0, F.lit(1.0)).otherwise(both / either)
    return F.when(a.isNotNull() & b.isNotNull(), value)
