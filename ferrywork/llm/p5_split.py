"""Problem 5: splitting oversized items at natural boundaries.

Every position of a text between two characters has a boundary strength (paragraph, sentence or line, clause, word,
none). A sparse table over the strengths answers range-maximum queries in constant time; each piece ends at the
strongest boundary of its permissible length window, the rightmost of equal ones, and the next piece starts the set
overlap before that end.

The kind of a text's cuts comes from the same index: it walks the ends of the natural units, from each to the strongest
end within the limit, and the weakest end it has to take tells which units fit.

Only texts above their limit reach Python; all others are whole pieces and stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of one unit of size.
UNIT = 4
#: level -> (limit, overlap) in units; None holds for every other level.
LIMITS: dict[str | None, tuple[int, int]] = {"parent": (800, 80), None: (250, 30)}

PARAGRAPH, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SENTENCE_IN_LINE = re.compile(r"(?<=[.!?])[^\S\n]+")
_LINE = re.compile(r"\n")
_CLAUSE = re.compile(r"(?<=[,;:])\s+|(?<=\s)[–—](?=\s)")
_WORD = re.compile(r"\s+")


def strengths(text: str) -> np.ndarray:
    """``s[i]``: the strength of a cut before character ``i``; a cut falls behind the white space that marks it."""
    s = np.zeros(len(text) + 1, dtype=np.int8)
    for strength, pattern in ((WORD, _WORD), (CLAUSE, _CLAUSE), (SENTENCE, _LINE), (SENTENCE, _SENTENCE), (PARAGRAPH, _PARAGRAPH)):
        ends = [m.end() for m in pattern.finditer(text)]
        s[ends] = np.maximum(s[ends], strength)
    s[0] = 0
    s[-1] = PARAGRAPH
    return s


class RangeMaximum:
    """Sparse table: the place of the greatest value of any range, the rightmost of equal ones, in O(1)."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        # the place in the low bits makes keys unique and breaks ties rightward
        self.shift = max(1, int(n).bit_length())
        row = (values.astype(np.int64) << self.shift) | np.arange(n, dtype=np.int64)
        self.rows = [row]
        width = 1
        while 2 * width <= n:
            row = np.maximum(row[: len(row) - width], row[width:])
            self.rows.append(row)
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """(place, value) of the greatest value in ``low..high``, both included."""
        k = (high - low + 1).bit_length() - 1
        key = int(max(self.rows[k][low], self.rows[k][high - (1 << k) + 1]))
        return key & ((1 << self.shift) - 1), key >> self.shift


def split_text(text: str, limit: int, overlap: int, unit: int = UNIT) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut) of each piece; sizes are ``length // unit`` and at most ``limit``.

    The window of a piece begins at half the limit; where it holds no boundary at all it is widened to the shortest
    piece that still makes headway. Consecutive pieces share exactly ``overlap * unit`` characters.
    """
    n, longest, shared = len(text), limit * unit + unit - 1, overlap * unit
    if n <= longest:
        return [(0, n, PARAGRAPH)]
    if shared >= longest:
        raise ValueError("the overlap must be smaller than the limit")
    index = RangeMaximum(strengths(text))
    pieces, start = [], 0
    while True:
        if n - start <= longest:
            pieces.append((start, n, PARAGRAPH))
            return pieces
        high = start + longest
        place, strength = index.query(start + max(longest // 2, shared + 1), high)
        if strength == 0:
            place, strength = index.query(start + shared + 1, high)
        if strength == 0:
            place = high
        pieces.append((start, place, strength))
        start = place - shared


def unit_ends(text: str) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(strength of the natural unit that ends before each character; by strength, where the unit behind begins)."""
    ends = np.zeros(len(text) + 1, dtype=np.int8)
    follows = {k: np.zeros(len(text) + 1, dtype=np.int64) for k in (SENTENCE, PARAGRAPH)}
    for strength, pattern in ((SENTENCE, _SENTENCE_IN_LINE), (SENTENCE, _LINE), (PARAGRAPH, _PARAGRAPH)):
        for m in pattern.finditer(text):
            ends[m.start()], follows[strength][m.start()] = strength, m.end()
    ends[-1] = PARAGRAPH
    return ends, follows


def cut_kind(text: str, limit: int, unit: int = UNIT) -> str:
    """Which natural units of the text all fit the limit: ``paragraph``, ``sentence`` (or line), or ``none``.

    From the beginning of a unit the index gives the strongest end within the limit, the rightmost of equal ones; the
    walk goes on behind it. Where no end of the wanted strength is in reach, a unit exceeds the limit.
    """
    longest, n = limit * unit + unit - 1, len(text)
    ends, follows = unit_ends(text)
    index = RangeMaximum(ends)
    for wanted, name in ((PARAGRAPH, "paragraph"), (SENTENCE, "sentence")):
        start = 0
        while True:
            place, strength = index.query(start, min(n, start + longest))
            if strength < wanted:
                break
            if place == n:
                return name
            start = int(follows[wanted][place])
    return "none"


def _limit(level: Column, limits: dict[str | None, tuple[int, int]], k: int) -> Column:
    out = F.lit(limits[None][k])
    for name, pair in limits.items():
        if name is not None:
            out = F.when(level == F.lit(name), F.lit(pair[k])).otherwise(out)
    return out


PIECES = "id string, section_title string, piece int, n_pieces int, start long, stop long, text string, cut_kind string"


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        # one input row at a time: a batch of very long texts never exists twice
        for row in pdf.itertuples(index=False):
            parts = split_text(row.text, row.lim, row.lap)
            kind = cut_kind(row.text, row.lim)
            yield pd.DataFrame(
                {
                    "id": row.id,
                    "section_title": row.section_title,
                    "piece": np.arange(len(parts), dtype=np.int32),
                    "n_pieces": np.int32(len(parts)),
                    "start": [p[0] for p in parts],
                    "stop": [p[1] for p in parts],
                    "text": [row.text[p[0] : p[1]] for p in parts],
                    "cut_kind": kind,
                }
            )


def split_oversized(
    df: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    title_col: str = "section_title",
    level_col: str = "level",
    limits: dict[str | None, tuple[int, int]] = LIMITS,
    keep_small: bool = True,
) -> DataFrame:
    """Pieces of every text: ``id, section_title, piece, n_pieces, start, stop, text, cut_kind``.

    A text within the limit of its level is one piece with a null ``cut_kind`` (left out if not ``keep_small``); a null
    text gives no piece, an empty one a single empty piece. A null level has the limit of key None. Repeated input rows
    give repeated pieces; further columns of the input, whatever their names, are left out.
    """
    level = F.col(level_col)
    rows = df.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(title_col).alias("section_title"),
        F.col(text_col).alias("text"),
        _limit(level, limits, 0).alias("lim"),
        _limit(level, limits, 1).alias("lap"),
    ).where(F.col("text").isNotNull())
    over = F.floor(F.char_length("text") / UNIT) > F.col("lim")
    cut = rows.where(over).mapInPandas(_cut, PIECES)
    if not keep_small:
        return cut
    whole = rows.where(~over).select(
        "id", "section_title", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start"),
        F.char_length("text").cast("long").alias("stop"), "text", F.lit(None).cast("string").alias("cut_kind"),
    )
    return cut.unionByName(whole)


def found(df: DataFrame) -> DataFrame:
    """Distinct ``chunk_id, cut_kind`` of the chunks above their limit, as the index tells them."""
    return split_oversized(df, keep_small=False).select(F.col("id").alias("chunk_id"), "cut_kind").distinct()
