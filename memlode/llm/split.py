"""Splitting oversized texts at natural boundaries.

Every position where a text may be cut has a strength. A sparse table over the strengths answers "the strongest
cut between these two positions, the rightmost of equals" in constant time; pieces are cut greedily with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strengths of cuts, by what they follow (fixed values).
HEADING, PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE = 6, 5, 4, 3, 2, 1

_NEWLINES = np.array([0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029], dtype="u4")
_SPACES = np.array([0x09, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], dtype="u4")
_SENTENCE = np.array([ord(c) for c in ".!?…"], dtype="u4")
_WIDE_SENTENCE = np.array([ord(c) for c in "。！？｡"], dtype="u4")
_CLAUSE = np.array([ord(c) for c in ",;:)]}"], dtype="u4")


class RangeMax:
    """Argmax over ranges of an array, the rightmost of equal maxima, from a table of powers of two."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # the position in the low bits makes the rightmost of equals the largest
        self.levels = [values.astype("i8") * (n + 1) + np.arange(n)]
        self.n = n
        width = 1
        while 2 * width <= n:
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def argmax(self, lo: int, hi: int) -> int:
        """The place of the maximum in [lo, hi)."""
        k = (hi - lo).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo], row[hi - (1 << k)]) % (self.n + 1))


def boundaries(cp: np.ndarray) -> np.ndarray:
    """The strength of a cut before each code point; 0 where there is no natural boundary."""
    n = len(cp)
    strength = np.zeros(n + 1, dtype="i1")
    if n < 2:
        return strength
    newline, space = np.isin(cp, _NEWLINES), np.isin(cp, _SPACES)
    blank = newline | space
    # for each position, the last code point before it that is not blank
    index = np.where(~blank, np.arange(n), -1)
    last = np.maximum.accumulate(index)
    lines = np.cumsum(newline & ~((cp == 0x0D) & np.append(cp[1:] == 0x0A, False)))
    before, after = cp[:-1], cp[1:]
    follows_space, follows_newline = space[:-1], newline[:-1]
    solid = last[:-1]
    ends = np.where(solid >= 0, cp[np.maximum(solid, 0)], 0)
    seen = np.where(solid >= 0, lines[np.maximum(solid, 0)], 0)
    s = strength[1:n]
    s[follows_space & ~blank[1:]] = SPACE
    s[follows_space & ~blank[1:] & np.isin(ends, _CLAUSE)] = CLAUSE
    s[(follows_space & ~blank[1:] & np.isin(ends, _SENTENCE)) | np.isin(before, _WIDE_SENTENCE)] = SENTENCE
    s[follows_newline & ~newline[1:]] = LINE
    s[follows_newline & ~newline[1:] & (lines[:-1] - seen >= 2)] = PARAGRAPH
    s[follows_newline & (after == ord("#"))] = HEADING
    s[(before == 0x0D) & (after == 0x0A)] = 0
    return strength


def split_text(text: str, max_bytes: int, overlap_bytes: int, min_fill: float = 0.5) -> list[tuple[int, int]]:
    """Byte ranges of the pieces of text.

    A piece has at most max_bytes (at least 4, the longest character). Its cut is the strongest boundary that
    fills min_fill of what it can add, else the strongest of the earlier ones, else the last whole character. The next
    piece starts at the boundary nearest to overlap_bytes before the cut, off by half an overlap and half of
    what a piece adds at most, else at a whole character there. Any overlap below max_bytes is kept; one as large
    leaves no room for anything new and is an error. Negative ones are 0.
    """
    if max_bytes <= overlap_bytes and overlap_bytes > 0:
        raise ValueError(f"an overlap of {overlap_bytes} bytes leaves no room in pieces of {max_bytes}")
    cp = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))])
    total = int(at[-1])
    limit = max(4, max_bytes)
    if total <= limit:
        return [(0, total)]
    overlap = max(0, overlap_bytes)
    slack = min(overlap // 2, (limit - overlap) // 2)
    strength = boundaries(cp)
    where = np.flatnonzero(strength)
    cuts, table = at[where], RangeMax(strength[where])
    joined = ((cp >= 0x300) & (cp <= 0x36F)) | ((cp >= 0xFE00) & (cp <= 0xFE0F)) | (cp == 0x200D) | ((cp >= 0x1F3FB) & (cp <= 0x1F3FF)) | ((cp == 0x0A) & np.append(False, cp[:-1] == 0x0D))
    joined |= np.append(False, cp[:-1] == 0x200D)
    whole = at[np.append(~joined, True)]

    def strongest(low: int, high: int) -> int | None:
        lo, hi = int(np.searchsorted(cuts, low, "left")), int(np.searchsorted(cuts, high, "right"))
        return int(cuts[table.argmax(lo, hi)]) if lo < hi else None

    def character(high: int, above: int) -> int:
        for places in (whole, at):
            k = int(np.searchsorted(places, high, "right")) - 1
            if k >= 0 and places[k] > above:
                return int(places[k])
        return int(at[np.searchsorted(at, above, "right")])

    pieces, start, done = [], 0, 0
    while total - start > limit:
        first = max(start + overlap + slack, done) + 1
        least = max(first, done + int((start + limit - done) * min_fill))
        cut = strongest(least, start + limit) or strongest(first, start + limit)
        cut = cut or character(start + limit, done)
        if cut - start > limit:  # the next character doesn't fit behind the overlap
            start = done
            continue
        pieces.append((start, cut))
        done = cut
        if overlap:
            aim = cut - overlap
            lo, hi = int(np.searchsorted(cuts, max(aim - slack, start + 1), "left")), int(np.searchsorted(cuts, min(aim + slack, cut), "right"))
            if lo < hi:
                near = lo + int(np.argmin(np.abs(cuts[lo:hi] - aim)))
                start = int(cuts[near])
            else:
                start = character(aim, start)
        else:
            start = cut
    pieces.append((start, total))
    return pieces


def split_oversized(items: DataFrame, limits: DataFrame, *, text: str = "content", kind: str = "content_type", keep: tuple[str, ...] = ("id", "label"), min_fill: float = 0.5) -> DataFrame:
    """Pieces of the items whose text has more bytes than max_bytes of their kind.

    items has the text, the kind and the columns of keep; limits has (kind, max_bytes, overlap_bytes), one row a
    kind, and is broadcast by the optimizer while it is small. Returns keep, piece_no from 1, n_pieces, start_byte,
    end_byte, piece. Items within their limit, without a limit or with a null text give no rows. Other columns of
    items are ignored, so that they may have any name; repeated items give repeated pieces. The filter by
    size runs before any text reaches Python, and pieces stay in the task of their item.
    """
    bounds = limits.select(F.col(kind).alias("_kind"), F.col("max_bytes").alias("_max"), F.coalesce("overlap_bytes", F.lit(0)).alias("_overlap"))
    rows = items.select(*keep, F.col(text).alias("_text"), F.col(kind).alias("_kind"))
    rows = rows.join(bounds, "_kind").where(F.octet_length("_text") > F.col("_max"))
    schema = rows.select(*keep).schema.add("piece_no", "integer").add("n_pieces", "integer").add("start_byte", "long").add("end_byte", "long").add("piece", "string")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *kept, value, most, overlap in batch[[*keep, "_text", "_max", "_overlap"]].itertuples(index=False, name=None):
                data = value.encode()
                pieces = split_text(value, int(most), int(overlap), min_fill)
                out += [(*kept, k, len(pieces), a, b, data[a:b].decode()) for k, (a, b) in enumerate(pieces, 1)]
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return rows.mapInPandas(cut, schema)
