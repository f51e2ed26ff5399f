"""Problem 6: passages of held-out items inside a corpus.

Pigeonhole edit matching over words. A passage of L words with at most L // 8 edits, cut into L // 8 + 1 pieces, keeps
one piece whole; for every L >= 22 the shortest such piece has six words. Each six words in a row of an item are
therefore a seed, every document is looked up seed by seed, and around each hit the item's windows are compared with
the document by Myers' bit-parallel distance with words as its symbols.

Seeds are looked up by hashes that roll over the words of a whole batch of documents at once; the distance confirms every
hit, so a chance collision costs time and changes nothing. The item side (seeds and words) is broadcast; beyond
``max_item_words`` words or ``BROADCAST_LIMIT`` bytes the items are taken in blocks, each a pass over the corpus. A block
leaves the driver's memory for the broadcast's file as soon as it is closed, so a large test set costs time and not memory.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.runtime import BROADCAST_LIMIT

#: Fewest words of a leaked passage, and words for each permitted edit.
MIN_WORDS, WORDS_PER_EDIT = 22, 8
#: Most words of items that one pass over the corpus holds.
MAX_ITEM_WORDS = 2_000_000
#: What a word of an item takes in a block (its text, its place and its seed), in bytes besides its letters.
WORD_BYTES = 90
#: Documents whose words are looked up at once.
BATCH = 1000

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|\\[a-z]+(?=\{)")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = {c: None for c in (*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xAD, 0xFEFF, 0x34F, 0x61C, 0x180E)}
# Apostrophes inside words. Fixed values.
_APOSTROPHES = "'’ʼ"


def words(text: str) -> list[str]:
    """The words that count: markup, punctuation, case and invisible characters are gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    if "<" in text or "&" in text or "\\" in text:
        text = _MARKUP.sub(" ", text)
    for c in _APOSTROPHES:
        text = text.replace(c, "")
    return _WORD.findall(text.casefold())


def seed_length(min_words: int = MIN_WORDS, per_edit: int = WORDS_PER_EDIT) -> int:
    """The shortest of the longest whole pieces over all passages of at least ``min_words`` words."""
    return min(n // (n // per_edit + 1) for n in range(min_words, min_words + 4 * per_edit))


def myers(pattern: list, text: list) -> list[int]:
    """For each end in ``text``, the fewest edits that turn ``pattern`` into some stretch of ``text`` ending there."""
    m = len(pattern)
    peq: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & mask
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        out.append(score)
    return out


def window_lengths(min_words: int = MIN_WORDS, per_edit: int = WORDS_PER_EDIT) -> list[int]:
    """The passage lengths that need a test: the shortest, and each at which the budget grows. A passage twice as long
    as the second of them falls into parts of which one has no more than its share of the edits."""
    second = (min_words // per_edit + 1) * per_edit
    return [min_words, *range(second, 2 * second, per_edit)]


def _confirmed(doc: list[str], item: list[str], hits: list[tuple[int, int]], min_words: int, per_edit: int) -> bool:
    """Whether some window of the item that spans one of the seed hits lies in the document within its budget."""
    seed, lengths = seed_length(min_words, per_edit), window_lengths(min_words, per_edit)
    runs: dict[int, list[list[int]]] = {}
    for d, p in sorted(hits, key=lambda h: (h[0] - h[1], h[1])):
        row = runs.setdefault(d - p, [])
        if row and row[-1][1] == p - 1:
            row[-1][1] = p
        else:
            row.append([p, p])
    tried: set[tuple[int, int, int]] = set()
    reach, drift = lengths[-1], lengths[-1] // per_edit
    for diagonal, row in runs.items():
        for first, last in row:
            if last - first + seed >= min_words:
                return True
            # words of the item that the document has within the drift of the diagonal: a window passes only if it has
            # at most its budget of others
            low, high = max(0, first + seed - reach), min(len(item), last + reach)
            kept = [0]
            for q in range(low, high):
                at = q + diagonal - drift
                kept.append(kept[-1] + (item[q] in doc[max(0, at) : max(0, at + 2 * drift + 1)]))
            for n in lengths:
                budget = n // per_edit
                if n > len(item):
                    break
                for i in range(max(0, first + seed - n), min(last, len(item) - n) + 1):
                    if kept[i + n - low] - kept[i - low] < n - budget:
                        continue
                    begin = max(0, i + diagonal - budget)
                    if (i, n, begin) in tried:
                        continue
                    tried.add((i, n, begin))
                    stretch = doc[begin : i + diagonal + n + budget]
                    if len(stretch) >= n - budget and min(myers(item[i : i + n], stretch)) <= budget:
                        return True
    return False


def rolled(codes: np.ndarray, kinds: list[str], seed: int) -> np.ndarray:
    """The hash of each ``seed`` words in a row; ``codes`` number the words in ``kinds``."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in kinds], dtype=np.uint64)[codes]
    n = max(0, len(h) - seed + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(seed):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out ^ (out >> np.uint64(32))


def seeds_of(texts: list[list[str]], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes, number of the text, place of the first word) of all seeds."""
    keys, owners, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
    for k, ws in enumerate(texts):
        codes, kinds = pd.factorize(np.array(ws, dtype=object))
        h = rolled(codes, list(kinds), seed)
        keys.append(h)
        owners.append(np.full(len(h), k, dtype=np.int32))
        places.append(np.arange(len(h), dtype=np.int32))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate(owners)[order], np.concatenate(places)[order]


def _search(shared, seed: int, min_words: int, per_edit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, owners, places, items, ids = shared.value
        seen = np.zeros(1 << 20, dtype=bool)
        seen[keys >> np.uint64(44)] = True
        for pdf in frames:
            out: list[tuple] = []
            for at in range(0, len(pdf), BATCH):
                names = pdf["id"].iloc[at : at + BATCH].to_numpy()
                docs = [words(t) for t in pdf["text"].iloc[at : at + BATCH]]
                sizes = np.fromiter((len(d) for d in docs), dtype=np.int64, count=len(docs))
                codes, kinds = pd.factorize(np.array([w for d in docs for w in d], dtype=object))
                h = rolled(codes, list(kinds), seed)
                hit = np.flatnonzero(seen[h >> np.uint64(44)])
                low, high = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, dtype=np.int64)
                owner = np.searchsorted(starts, hit, side="right") - 1
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x, o, a, z in zip(hit, owner, low, high, strict=True):
                    d = int(x - starts[o])
                    if d + seed <= sizes[o]:  # not across two documents
                        for j in range(a, z):
                            hits.setdefault((int(o), int(owners[j])), []).append((d, int(places[j])))
                for (o, k), where in hits.items():
                    where = [(d, p) for d, p in where if docs[o][d : d + seed] == items[k][p : p + seed]]
                    if where and _confirmed(docs[o], items[k], where, min_words, per_edit):
                        out.append((names[o], ids[k]))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype({"doc_id": "int64", "item_id": "int64"})

    return run


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    words_per_edit: int = WORDS_PER_EDIT,
    max_item_words: int = MAX_ITEM_WORDS,
) -> DataFrame:
    """Distinct ``doc_id, item_id``: the document holds at least ``min_words`` words in a row of the item with at most
    one word in ``words_per_edit`` changed, dropped or inserted.

    Null or empty texts and null ids match nothing, nor do items shorter than ``min_words``. Repeated documents give one
    row; an item id given twice stands for both texts. Other columns are not read. The corpus is never shuffled; the
    items are read by the driver block by block, ``max_item_words`` words or ``BROADCAST_LIMIT`` bytes each (one text
    more at most).
    """
    seed = seed_length(min_words, words_per_edit)
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null")
    wanted = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    parts: list[DataFrame] = []

    def one_pass(texts: list[tuple[int, list[str]]]) -> None:
        # an id may have several texts: the search sees their numbers, the result their ids
        every = [ws for _, ws in texts]
        shared = documents.sparkSession.sparkContext.broadcast((*seeds_of(every, seed), every, [i for i, _ in texts]))
        parts.append(docs.mapInPandas(_search(shared, seed, min_words, words_per_edit), "doc_id long, item_id long"))

    block: list[tuple[int, list[str]]] = []
    held = size = 0
    for row in wanted.toLocalIterator():
        ws = words(row["text"])
        if len(ws) < min_words:
            continue
        block.append((row["id"], ws))
        held += len(ws)
        size += WORD_BYTES * len(ws) + len(row["text"])
        if held >= max_item_words or size >= BROADCAST_LIMIT:
            one_pass(block)
            block, held, size = [], 0, 0
    if block:
        one_pass(block)
    if not parts:
        return docs.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("item_id")).limit(0)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()
