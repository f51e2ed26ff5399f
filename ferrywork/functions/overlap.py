"""Overlap of an answer with its reference: keywords, n-grams, longest common subsequence."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ferrywork import schema
from ferrywork.functions.answers import blank


def all_keywords() -> list[str]:
    """The keywords of all groups in their order, each once."""
    return list(dict.fromkeys(k for group in schema.KEYWORDS.values() for k in group))


def keyword_accuracy(gold: Column, answer: Column) -> Column:
    """struct<recall, precision, matched, missed> over keywords contained in the texts; the recall is 1 if gold has none."""
    g, a = F.lower(blank(gold)), F.lower(blank(answer))
    words = F.array(*[F.lit(k) for k in all_keywords()])
    in_gold, in_answer = F.filter(words, lambda k: F.contains(g, k)), F.filter(words, lambda k: F.contains(a, k))
    both = F.array_intersect(in_gold, in_answer)
    recall = F.when(F.size(in_gold) == 0, 1.0).otherwise(F.size(both) / F.size(in_gold))
    precision = F.when(F.size(in_answer) == 0, 0.0).otherwise(F.size(both) / F.size(in_answer))
    return F.struct(recall.alias("recall"), precision.alias("precision"), F.array_sort(both).alias("matched"), F.array_sort(F.array_except(in_gold, in_answer)).alias("missed"))


def split_words(t: str | None) -> list[str]:
    return (t or "").lower().split()


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    mask = (1 << len(a)) - 1
    row = mask
    for w in b:
        m = places.get(w, 0)
        u = row & m
        row = ((row + u) | (row - u)) & mask
    return len(a) - row.bit_count()


def rouge_l(gold: list[str], answer: list[str]) -> float:
    """F-measure of the longest common subsequence of words; 0 if either is empty."""
    n = lcs_length(gold, answer)
    return 2 * n / (len(gold) + len(answer)) if n else 0.0


def _clipped(gold: list[str], answer: list[str], n: int) -> tuple[int, int]:
    """(matches of the answer's n-grams, each at most as often as gold holds it; the answer's n-grams)."""
    grams = lambda ws: Counter(zip(*(ws[i:] for i in range(n)), strict=False))
    a = grams(answer)
    return sum((a & grams(gold)).values()), sum(a.values())


def bleu(gold: list[str], answer: list[str], order: int = 4, epsilon: float = 0.1) -> float:
    """BLEU up to ``order`` with equal weights and the brevity penalty; a zero count is smoothed to ``epsilon``."""
    if not gold or not answer or not _clipped(gold, answer, 1)[0]:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        hit, total = _clipped(gold, answer, n)
        logs += math.log((hit or epsilon) / max(1, total)) / order
    return math.exp(logs + min(0.0, 1 - len(gold) / len(answer)))


def meteor_exact(gold: list[str], answer: list[str]) -> float:
    """The harmonic mean of METEOR over exact word matches only (no synonyms, stems or chunk penalty)."""
    m = _clipped(gold, answer, 1)[0] if gold and answer else 0
    if not m:
        return 0.0
    p, r = m / len(answer), m / len(gold)
    return 10 * p * r / (r + 9 * p)


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("rouge_l", "bleu1", "bleu4", "meteor")]))
def overlaps(gold: pd.Series, answer: pd.Series) -> pd.DataFrame:
    """All four figures of each pair; equal pairs of a batch are computed once."""
    memo: dict[tuple, tuple] = {}
    rows = []
    for pair in zip(gold, answer, strict=True):
        if pair not in memo:
            g, a = split_words(pair[0]), split_words(pair[1])
            memo[pair] = (rouge_l(g, a), bleu(g, a, 1), bleu(g, a, 4), meteor_exact(g, a))
        rows.append(memo[pair])
    return pd.DataFrame(rows, columns=["rouge_l", "bleu1", "bleu4", "meteor"])
