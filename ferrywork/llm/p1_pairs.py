"""Problem 1: broken question and answer pairs.

An answer is cut into clauses, and a linear-chain conditional random field tags each as answer, refusal, echo, foreign or
unfinished from features of the clause and of its question: overlap with the question, language against the question's,
hashed words, and whether the text so far usually goes on. The share of the answer's words under each tag decides the
defect of the pair.

The field is trained here, on sequences made from a bounded sample of sound pairs (gold answers, cut, given back, put to
questions of other languages, replaced by refusals). How often words end a sentence, and which words stand in texts of
which language, is counted over all rows. The counts of word sequences stay in a table of the cluster, keyed by 64-bit
hashes: what an unterminated answer ends with is looked up there by a join, so nothing is folded into buckets and the
driver holds none of it. Words below a share of all are told by their letters.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywork.llm import p1_seeds as S
from ferrywork.llm import p3_residue
from ferrywork.runtime import cut

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
A, R, E, X, U = range(5)
#: Most sound pairs that the field is trained on, and most clauses of a sequence that it is trained on.
SAMPLE, TRAINING_CLAUSES = 2500, 24
#: Least share of all words (letter trigrams) of a word the language model knows itself: at most 1 / share of them.
WORD_SHARE = 5e-6
#: Share of all words that each function word counts for besides.
FUNCTION_SHARE = 2e-4
#: Size of the table of hashed words (features of the field).
HASHED = 1 << 12
#: Lengths of the word sequences whose endings are counted.
ORDERS = (1, 2, 3, 5)

_CLAUSE = re.compile(r"(?<=[.!?…;:])[\"”’)»]?\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[.!?…]|\0")
END = r"[.!?…][\"”’'»)\]*]*\s*$"
_END = re.compile(END)
_DIGIT = re.compile(r"\d+")
_BARE = re.compile(r"[\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(text) if c and _WORD.search(c)]


_LABEL = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(S.LABELS, key=len, reverse=True))) + r")\s*(?:[:=|–—-]+|$)\s*")
_APART = re.compile(r"\s*[|;\n]\s*|\s{2,}")
#: The words of labels and not-available marks: a text with any other word is not empty.
_EMPTY_WORDS = frozenset(w for x in (*S.LABELS, *S.BLANKS) for w in re.findall(r"[^\W_]+", x))
_ANY_WORD = re.compile(r"[^\W_]+")


def is_empty(text: str | None) -> bool:
    """Null, blank, nothing but punctuation, field labels or a not-available mark."""
    if text is None:
        return True
    first = _ANY_WORD.search(text)
    if not first:
        return True
    bare = text.replace("​", "").replace("﻿", "").replace("\xad", "").strip().lower()
    if any(m[0] not in _EMPTY_WORDS for m in _ANY_WORD.finditer(bare)):
        return False
    edges = lambda x: re.sub(r"^[\s\W_]+|[\s\W_]+$", "", x)
    bare = edges(_LABEL.sub("  ", bare))
    return bare in S.BLANKS or all(x == "" or x in S.BLANKS or x in S.LABELS for x in map(edges, _APART.split(bare)))


# --- counts over all rows ------------------------------------------------------------------------------------------


def _mix(h: np.ndarray, order: int) -> np.ndarray:
    """Keys of the ``order`` hashes that end at each place (places before the start count as 0)."""
    out = np.full(len(h), order, dtype=np.uint64)
    for k in range(order):
        past = h if k == 0 else np.concatenate((np.zeros(min(k, len(h)), dtype=np.uint64), h[: max(0, len(h) - k)]))
        out = (out ^ past) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_PUNCT = {".", "!", "?", "…"}


def _hash(tokens: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens], dtype=np.uint64)


def tail_keys(text: str) -> list[int]:
    """The keys of the last words of a text, one an order; 0 where the text is shorter."""
    tokens = _TOKEN.findall("\0" + text.lower())[-max(ORDERS) :]
    h = _hash(tokens)
    return [int(_mix(h, k)[-1]) if len(h) >= k else 0 for k in ORDERS]


class Counts:
    """Sums of a batch: (key, words seen, sentence ends) of every word and order, and (word, language, n)."""

    def __init__(self, votes: dict[str, np.ndarray]):
        self.votes = votes
        self.keys, self.sums = np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64)
        self.words: dict[tuple[str, int], int] = {}

    def add(self, texts: Sequence[str], endings: bool, trusted: bool) -> None:
        """Count texts; in trusted ones the end of the text is an end of a sentence, too."""
        weight_of, unique = pd.factorize(np.array(texts, dtype=object))
        many = np.bincount(weight_of, minlength=len(unique))
        tokens = _TOKEN.findall("\0" + "\0".join(t.replace("\0", " ").lower() for t in unique) + "\0")
        codes, kinds = pd.factorize(np.array(tokens, dtype=object))
        gap = np.array([k == "\0" for k in kinds])[codes]
        stop = np.array([k in _PUNCT for k in kinds])[codes]
        owner = np.minimum(np.cumsum(gap) - 1, len(unique) - 1)
        weight = many[owner]
        word = ~gap & ~stop
        # language: function words vote, clear texts count for their words
        n = len(LANGUAGES)
        vote = np.stack([self.votes.get(k, np.zeros(n)) for k in kinds])[codes]
        total = np.stack([np.bincount(owner, weights=np.where(word, vote[:, c], 0.0), minlength=len(unique)) for c in range(n)], axis=1)
        top = np.sort(total, axis=1)
        clear = (top[:, -1] >= 1.5) & (top[:, -1] >= 1.5 * top[:, -2])
        seen = word & clear[owner]
        cell, times = np.unique(codes[seen] * n + total.argmax(axis=1)[owner[seen]], return_inverse=True)
        for x, w in zip(cell, np.bincount(times, weights=weight[seen], minlength=len(cell)), strict=True):
            key = (kinds[x // n], int(x % n))
            self.words[key] = self.words.get(key, 0) + int(w)
        if not endings:
            return
        follow_stop, follow_gap = np.append(stop[1:], False), np.append(gap[1:], True)
        end = follow_stop | (follow_gap & trusted)
        keep = word & (end | ~follow_gap)
        h = _hash(list(kinds))[codes]
        keys = np.concatenate([_mix(h, k)[keep] for k in ORDERS])
        rows = np.stack((np.tile(weight[keep], len(ORDERS)), np.tile(weight[keep] * end[keep], len(ORDERS))), axis=1)
        self.keys, inverse = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        rows = np.concatenate((self.sums, rows))
        self.sums = np.stack([np.bincount(inverse, weights=rows[:, c], minlength=len(self.keys)) for c in (0, 1)], axis=1).astype(np.int64)

    def flush(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"kind": "e", "word": "", "key": self.keys, "n": self.sums[:, 0], "ended": self.sums[:, 1]})
        if self.words:
            names, langs = zip(*self.words, strict=True)
            yield pd.DataFrame({"kind": "w", "word": names, "key": np.array(langs, dtype=np.int64), "n": np.array(list(self.words.values()), dtype=np.int64), "ended": np.int64(0)})
        self.keys, self.sums, self.words = np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64), {}


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = Counts(function_votes())
    for pdf in frames:
        for column, endings, trusted in (("question", False, False), ("gold", True, True), ("answer", True, False)):
            texts = [t for t in pdf[column] if t]
            if texts:
                counts.add(texts, endings, trusted)
        if len(counts.keys) > 1_000_000 or len(counts.words) > 500_000:
            yield from counts.flush()
    yield from counts.flush()


def count_rows(rows: DataFrame) -> DataFrame:
    """``kind, word, key, n, ended`` over all rows of ``question, answer, gold``: word sequences (e, by key) and words by
    language (w, the key is the language). Written to the checkpoint folder, since three steps read it."""
    parts = rows.select("question", "answer", "gold").mapInPandas(_count, "kind string, word string, key long, n long, ended long")
    return cut(parts.groupBy("kind", "word", "key").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended")))


def ending_counts(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (with a column ``key``) and their ``n`` and ``ended``."""
    return keys.join(counts.where("kind = 'e'").select("key", "n", "ended"), "key")


def is_open(answer: Column) -> Column:
    """Whether an answer has a word and ends without the end of a sentence."""
    return F.coalesce(answer.rlike(r"[\p{L}\p{N}]") & ~answer.rlike(END), F.lit(False))


def _tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"answer": pdf["answer"], "keys": [tail_keys(t) for t in pdf["answer"]]})


def with_endings(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``ends``: of open answers, words seen and ends of each order, one behind the other; else null."""
    tails = rows.where(is_open(F.col("answer"))).select("answer").distinct().mapInPandas(_tails, "answer string, keys array<long>")
    each = tails.select("answer", F.posexplode("keys").alias("at", "key"))
    found = ending_counts(counts, each).groupBy("answer").agg(F.collect_list(F.struct("at", "n", "ended")).alias("got"))
    zero = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    one = lambda i: F.coalesce(F.get(F.transform(F.filter("got", lambda x: x["at"] == i), lambda x: F.array(x["n"], x["ended"])), F.lit(0)), zero)
    found = found.select("answer", F.flatten(F.array(*[one(i) for i in range(len(ORDERS))])).alias("ends"))
    opened = rows.where(is_open(F.col("answer"))).join(found, "answer", "left")
    return opened.select("id", "question", "answer", "ends").unionByName(rows.where(~is_open(F.col("answer"))).select("id", "question", "answer", F.lit(None).cast("array<long>").alias("ends")))


# --- language ------------------------------------------------------------------------------------------------------

LANGUAGES = tuple(S.FUNCTION_WORDS)


def _shapes(word: str) -> list[str]:
    s = f"^{word}$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


def function_votes() -> dict[str, np.ndarray]:
    """Of each function word, its share of a vote for each language."""
    votes: dict[str, np.ndarray] = {}
    for k, lang in enumerate(LANGUAGES):
        for w in S.FUNCTION_WORDS[lang].split():
            votes.setdefault(w, np.zeros(len(LANGUAGES)))[k] = 1.0
    return {w: v / v.sum() for w, v in votes.items()}


def fit_language(counts: DataFrame, share: float = WORD_SHARE) -> Language:
    """The language model of the counts of all rows. Words and trigrams below the share are left to what they consist of."""
    rows = counts.where("kind = 'w'").select("word", F.col("key").cast("int").alias("language"), "n")
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    shape = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substr(padded, i, F.lit(3))))
    tables = []
    for part in (rows, rows.select(shape.alias("word"), "language", "n").groupBy("word", "language").agg(F.sum("n").alias("n"))):
        total = part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        kept = part.groupBy("word").agg(F.sum("n").alias("m")).where(F.col("m") >= total * share)
        out: dict[str, np.ndarray] = {}
        for r in part.join(kept, "word").select("word", "language", "n").toLocalIterator():
            out.setdefault(r["word"], np.zeros(len(LANGUAGES)))[r["language"]] = r["n"]
        tables.append(out)
    return Language.fit(*tables)


class Language:
    """Log-odds of words by language: words that are frequent enough, else their letter trigrams. Ships as plain data."""

    def __init__(self, known: dict[str, np.ndarray], shapes: dict[str, np.ndarray]):
        self.known, self.shapes = known, shapes
        self.memo: dict[str, np.ndarray] = {}
        self.none = np.zeros(len(LANGUAGES), dtype=np.float32)

    @staticmethod
    def fit(word_counts: dict[str, np.ndarray], shape_counts: dict[str, np.ndarray]) -> Language:
        """From counts by language of words and of their letter trigrams.

        The function words count besides, each for a share of all words, so that every language has some. Rates within a
        language are compared with the greatest one; what is rare tells less, and its letters the rest. All smoothing is
        in shares of the whole, so that the size of the table does not matter.
        """
        n = len(LANGUAGES)
        votes = function_votes()

        def logs(counts: dict[str, np.ndarray], extra: dict[str, np.ndarray], rare: float) -> tuple[dict[str, np.ndarray], dict[str, float]]:
            total = max(1.0, float(sum(c.sum() for c in counts.values())))
            names = list(dict.fromkeys([*counts, *extra]))
            c = np.stack([counts.get(x, np.zeros(n)) + FUNCTION_SHARE * total * extra.get(x, np.zeros(n)) for x in names])
            rate = c / (c.sum(axis=0) + 0.002 * total)
            top = rate.max(axis=1, keepdims=True)
            sure = c.sum(axis=1) / (c.sum(axis=1) + rare * total)
            v = np.log((rate + 0.02 * top) / (1.02 * top)) * sure[:, None]
            return dict(zip(names, v.astype(np.float32), strict=True)), dict(zip(names, sure, strict=True))

        by_shape: dict[str, np.ndarray] = {}
        for w, v in votes.items():
            for x in _shapes(w):
                by_shape[x] = by_shape.get(x, np.zeros(n)) + 0.1 * v
        shapes, _ = logs(shape_counts, by_shape, 1e-5)
        known, sure = logs(word_counts, votes, 2e-6)
        out = Language({}, shapes)
        # the letters tell what a rare word does not
        out.known = {w: v + np.float32(1 - sure[w]) * out.word(w) for w, v in known.items()}
        return Language(out.known, shapes)

    def word(self, w: str) -> np.ndarray:
        v = self.known.get(w)
        if v is None:
            v = self.memo.get(w)
            if v is None:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                rows = [self.shapes[s] for s in _shapes(w) if s in self.shapes]
                v = (sum(rows) / 3.0).astype(np.float32) if rows and not w.isdigit() else self.none
                v = self.memo[w] = np.maximum(v - v.max(), np.float32(-3.0))
        return v

    def score(self, ws: list[str]) -> np.ndarray:
        return np.sum([self.word(w) for w in ws], axis=0) if ws else self.none


# --- features ------------------------------------------------------------------------------------------------------

N_DENSE = 64


class Features:
    """Dense features and hashed words of the clauses of pairs, a batch at a time."""

    def __init__(self, language: Language):
        self.language = language
        self.rows: dict[str, int] = {}
        self.codes = np.zeros(1 << 10, dtype=np.int64)
        self.odds = np.zeros((1 << 10, len(LANGUAGES)), dtype=np.float32)
        self.questions: dict[str, tuple] = {}

    def row(self, w: str) -> int:
        """The place of a word in the tables of hashed words and of languages."""
        i = self.rows.get(w)
        if i is None:
            i = self.rows[w] = len(self.rows)
            if i == len(self.codes):
                self.codes = np.concatenate((self.codes, np.zeros_like(self.codes)))
                self.odds = np.concatenate((self.odds, np.zeros_like(self.odds)))
            self.codes[i] = zlib.crc32(_DIGIT.sub("0", w).encode("utf-8", "surrogatepass"))
            self.odds[i] = self.language.word(w)
        return i

    def question(self, q: str) -> tuple:
        out = self.questions.get(q)
        if out is None:
            if len(self.questions) > 50_000:
                self.questions.clear()
            ws = words(q)
            odds = self.language.score(ws)
            top = np.sort(odds)
            home = int(odds.argmax()) if ws and float(top[-1] - top[-2]) > 1.0 else -1
            out = self.questions[q] = (set(ws), set(zip(ws, ws[1:], strict=False)), home)
        return out

    @staticmethod
    def ending(text: str, counts: Sequence[int] | None, own: int = 0) -> list[float]:
        """How the last words of an unterminated text usually go on, from their ``counts`` (words seen and ends of each
        order); ``own``: 1 if the text's own end was counted as an end, 2 if as a middle (taken off in training)."""
        length = 1 + len(_TOKEN.findall(text))
        f, best = [], None
        for i, k in enumerate(ORDERS):
            if length < k:
                f += [0.0, 0.0, 0.0, 0.0, 0.0]
                continue
            total, ended = (int(counts[2 * i]), int(counts[2 * i + 1])) if counts is not None else (0, 0)
            total, ended = total - (own > 0), ended - (own == 1)
            if total <= 0:
                f += [1.0, 0.0, 0.0, 0.0, 0.0]
                continue
            r = ended / total
            best = r
            f += [0.0, float(r < 0.01), float(0.01 <= r < 0.1), float(0.1 <= r < 0.5), float(r >= 0.5)]
        f += [0.0] * 4 if best is None else [float(best < 0.01), float(0.01 <= best < 0.1), float(0.1 <= best < 0.5), float(best >= 0.5)]
        return f

    def batch(self, questions: Sequence[str | None], answers: Sequence[str], counts: Sequence[Sequence[int] | None], owns: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(dense features by clause, rows of all words, words by clause, clauses by pair); ``counts`` and ``owns`` as in
        ``ending``."""
        if len(self.rows) > 500_000:
            self.rows.clear()
        flat: list[int] = []
        fresh: list[bool] = []
        sizes: list[int] = []
        spans: list[int] = []
        figures: list[tuple] = []
        open_ends: list[tuple[int, list[float]]] = []
        for k, (q, a) in enumerate(zip(questions, answers, strict=True)):
            qset, qpairs, home = self.question(q or "")
            parts = clauses(a)
            tokenised = [words(c) for c in parts]
            everything = {w for ws in tokenised for w in ws}
            in_q = len(everything & qset)
            nq = max(1, len(qset))
            recall_all, precision_all = in_q / nq, in_q / max(1, len(everything))
            last = len(parts) - 1
            for i, ws in enumerate(tokenised):
                own_set = set(ws)
                shared = len(own_set & qset)
                pairs = list(zip(ws, ws[1:], strict=False))
                chained = sum(p in qpairs for p in pairs) / max(1, len(pairs)) if shared else 0.0
                figures.append((i == 0, i == last, len(ws), shared / len(own_set), shared / nq, recall_all, precision_all, parts[i].rstrip().endswith("?"), chained, home))
                flat += [self.row(w) for w in ws]
                fresh += [w not in qset for w in ws] if shared else [True] * len(ws)
                sizes.append(len(ws))
            spans.append(len(parts))
            if parts and not _END.search(a):
                tail = a.rstrip()
                f = [1.0, float(tail[-1:] in ",;:(–—-/&"), float(tail.count("(") > tail.count(")") or tail.count("“") > tail.count("”")), float(len(parts) == 1 and len(tokenised[-1]) <= 3)]
                open_ends.append((len(sizes) - 1, f + self.ending(tail, counts[k], owns[k] if owns is not None else 0)))
        rows, n = np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)
        dense = np.zeros((len(n), N_DENSE), dtype=np.float32)
        if len(n):
            first, final, _, precision, recall, recall_all, precision_all, asks, chained, home = (np.array(x) for x in zip(*figures, strict=True))
            at = np.concatenate(([0], np.cumsum(n)))
            odds = np.zeros((len(rows) + 1, len(LANGUAGES)))
            np.cumsum(self.odds[rows] * np.array(fresh, dtype=np.float32)[:, None], axis=0, out=odds[1:])
            odds = odds[at[1:]] - odds[at[:-1]]
            margin = np.where(home >= 0, odds.max(axis=1) - np.take_along_axis(odds, np.maximum(home, 0)[:, None], axis=1)[:, 0], 0.0)
            each = margin / n
            columns = (
                np.ones(len(n)), first, final, first & final, n <= 2, n <= 5, n > 15,
                precision >= 0.5, precision >= 0.8, precision == 1.0, recall >= 0.3, recall >= 0.6, recall >= 0.85,
                recall_all >= 0.6, recall_all >= 0.85, (precision_all >= 0.7) & (recall_all >= 0.6), asks,
                (precision_all >= 0.9) & (recall_all >= 0.8), chained >= 0.5, chained >= 0.8, (chained >= 0.5) & (recall >= 0.6),
                each > 0.3, each > 1.0, margin > 4, margin > 10, (each > 0.5) & (n >= 4), (margin > 4) & (each > 0.5),
            )
            for j, column in enumerate(columns):
                dense[:, j] = column
            for i, f in open_ends:
                dense[i, len(columns) : len(columns) + len(f)] = f
        return dense, rows, n, spans

    def hashed(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashed words and word pairs, the clause each is of)."""
        owner, code = np.repeat(np.arange(len(n)), n), self.codes[rows]
        together = owner[1:] == owner[:-1]
        return np.concatenate((code % HASHED, ((code[:-1] * 31 + code[1:]) % HASHED)[together])), np.concatenate((owner, owner[1:][together]))


# --- the field -----------------------------------------------------------------------------------------------------


class Field:
    """Linear-chain conditional random field over dense and hashed features, trained by full-batch Adam."""

    def __init__(self, dense: np.ndarray, hashed: np.ndarray, move: np.ndarray, start: np.ndarray, stop: np.ndarray):
        self.dense, self.hashed, self.move, self.start, self.stop = dense, hashed, move, start, stop

    def emissions(self, dense: np.ndarray, hashed: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Scores of all clauses at once; hashed words are averaged by the square root of their number."""
        e, picked = (dense @ self.dense).astype(np.float64), self.hashed[hashed]
        scale = np.sqrt(np.maximum(np.bincount(owner, minlength=len(e)), 1))
        for c in range(e.shape[1]):
            e[:, c] += np.bincount(owner, weights=picked[:, c], minlength=len(e)) / scale
        return e

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of sequences of one length: ``e`` is sequences x clauses x tags."""
        b, length, k = e.shape
        score, back = e[:, 0] + self.start, np.zeros((b, length, k), dtype=np.int8)
        for t in range(1, length):
            options = score[:, :, None] + self.move
            back[:, t] = options.argmax(axis=1)
            score = options.max(axis=1) + e[:, t]
        tags = np.zeros((b, length), dtype=np.int8)
        tags[:, -1] = (score + self.stop).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(b), t, tags[:, t]]
        return tags

    @staticmethod
    def fit(dense: np.ndarray, ids: np.ndarray, owner: np.ndarray, gold: np.ndarray, lengths: np.ndarray, rounds: int = 100, rate: float = 0.12, l2: float = 2e-4) -> Field:
        """From dense features, hashed words with their clauses and tags of clauses, and the numbers of clauses."""
        k, total = len(TAGS), len(lengths)
        scale = (1.0 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(dense)), 1)))[owner][:, None]
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        groups = [(m, np.flatnonzero(lengths == m)) for m in sorted(set(lengths))]
        params = [np.zeros((N_DENSE, k)), np.zeros((HASHED, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            w, v, move, start, stop = params
            e = dense @ w
            picked = v[ids] * scale
            for c in range(k):
                e[:, c] += np.bincount(owner, weights=picked[:, c], minlength=len(e))
            grad_e, g_move, g_start, g_stop = np.zeros_like(e), np.zeros_like(move), np.zeros_like(start), np.zeros_like(stop)
            for m, rows in groups:
                at = begin[rows][:, None] + np.arange(m)
                x, y = e[at], gold[at]
                alpha = [x[:, 0] + start]
                for t in range(1, m):
                    alpha.append(np.logaddexp.reduce(alpha[-1][:, :, None] + move, axis=1) + x[:, t])
                z = np.logaddexp.reduce(alpha[-1] + stop, axis=1)
                beta = [np.broadcast_to(stop, x[:, 0].shape)]
                for t in range(m - 1, 0, -1):
                    beta.append(np.logaddexp.reduce(move + (x[:, t] + beta[-1])[:, None, :], axis=2))
                beta.reverse()
                one = np.eye(k)[y]
                for t in range(m):
                    p = np.exp(alpha[t] + beta[t] - z[:, None]) - one[:, t]
                    grad_e[at[:, t]] = p
                    if t == 0:
                        g_start += p.sum(axis=0)
                    if t == m - 1:
                        g_stop += p.sum(axis=0)
                    if t:
                        q = np.exp(alpha[t - 1][:, :, None] + move + (x[:, t] + beta[t])[:, None, :] - z[:, None, None])
                        g_move += q.sum(axis=0) - one[:, t - 1].T @ one[:, t]
            g_hashed = np.zeros_like(v)
            spread = grad_e[owner] * scale
            for c in range(k):
                g_hashed[:, c] = np.bincount(ids, weights=spread[:, c], minlength=HASHED)
            grads = [dense.T @ grad_e, g_hashed, g_move, g_start, g_stop]
            for i, g in enumerate(grads):
                g = g / total + l2 * params[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        return Field(*[p.astype(np.float32) for p in params])

    def state(self) -> tuple[np.ndarray, ...]:
        return self.dense, self.hashed, self.move, self.start, self.stop


def _echo(q: str, rng: random.Random) -> str:
    q = q.strip()
    x = rng.random()
    if x < 0.2:
        ws = q.split()
        if len(ws) > 4:
            ws.pop(rng.randrange(1, len(ws) - 1))
        q = " ".join(ws)
    elif x < 0.3:
        q = q.upper()
    elif x < 0.4:
        q = q.lower()
    elif x < 0.5:
        q = q.replace(" ", "  ")
    elif x < 0.65:
        q = q.rstrip("?.! ") + rng.choice(("", ".", "…?", " ?", "??"))
    return rng.choice(S.ECHOES).format(q=q)


def _phrases(text: str, function: set[str]) -> list[str]:
    """Runs of content words behind "the"."""
    ws, out = words(text), []
    for i, w in enumerate(ws):
        if w == "the":
            j = i + 1
            while j < len(ws) and j - i < 5 and (ws[j] not in function or ws[j] == "of" and j > i + 1):
                j += 1
            if j > i + 1 and ws[j - 1] != "of":
                out.append(" ".join(ws[i + 1 : j]))
    return out


def training_pairs(pairs: list[tuple[str, str]], language: Language, seed: int = 5) -> list[tuple[str, str, list[int], int]]:
    """(question, answer, tags, own) made from sound pairs; ``own`` as in ``Features.ending``."""
    rng = random.Random(seed)
    golds = [re.sub(r"^[A-Z]{4,}\s*[—–:-]\s*", "", g).strip() for _, g in pairs]
    tongue = [int(language.score(words(g)).argmax()) for g in golds]
    by_tongue: dict[int, list[int]] = {}
    for i, t in enumerate(tongue):
        by_tongue.setdefault(t, []).append(i)
    out: list[tuple[str, str, list[int], int]] = []
    function = set(" ".join(S.FUNCTION_WORDS.values()).split())
    phrases = sorted({p for q, _ in pairs for p in _phrases(q, function)})

    def add(q: str, a: str, tags: list[int], own: int = 0) -> None:
        n = len(clauses(a))
        if n and n == len(tags) and n <= TRAINING_CLAUSES:
            out.append((q, a, tags, own))

    for i, (q, _) in enumerate(pairs):
        g = golds[i]
        if not g or not words(g):
            continue
        if rng.random() < 0.4:
            more = golds[rng.choice(by_tongue[tongue[i]])]
            g = f"{g} {more}" if more else g
        # only the form counts: the answer to another question in the same tongue is sound, though it shares few words
        other = golds[rng.choice(by_tongue[tongue[i]])]
        add(q, other, [A] * len(clauses(other)))
        x = rng.random()
        if x < 0.15:
            g = rng.choice(S.LEADS) + g
        n = len(clauses(g))
        add(q, g, [A] * n)
        bare = g.rstrip(".!?… ")
        if bare != g.rstrip() and rng.random() < 0.5:
            add(q, bare, [A] * len(clauses(bare)), 1)
            if rng.random() < 0.15:  # a comma promises more
                add(q, bare + ",", [A] * (len(clauses(bare)) - 1) + [U])
        # cut inside a word or sentence
        last = max(g.rfind(". ", 0, len(g) - 1), g.rfind("; ", 0, len(g) - 1), g.rfind(": ", 0, len(g) - 1)) + 1
        if len(g) - last > 14:
            place = rng.randint(last + 5, len(g) - 4)
            cut = g[:place].rstrip()
            m = len(clauses(cut))
            if m and not _END.search(cut):
                tail = rng.random()
                cut = cut + "," if tail < 0.07 else cut + " (seen near the" if tail < 0.1 else cut
                inside = place < len(g) and g[place - 1].isalnum() and g[place].isalnum()
                add(q, cut, [A] * (m - 1) + [U], 0 if inside or tail < 0.1 else 2)
        if q.strip():
            e = _echo(q, rng)
            add(q, e, [E] * len(clauses(e)))
            # noun phrases are sound short answers, also those of the question
            if phrases and rng.random() < 0.6:
                part = rng.choice(S.SHORT).format(p=rng.choice(phrases), q=rng.choice(phrases))
                part = part[:1].upper() + part[1:]
                add(q, part, [A] * len(clauses(part)))
        if rng.random() < 0.8:
            core = rng.choice(S.REFUSALS)
            open_, close = rng.choice(S.OPENINGS), rng.choice(S.CLOSINGS)
            r = open_ + (core if open_ else core[:1].upper() + core[1:]) + close
            if rng.random() < 0.12:
                r = r.rstrip(".") + ". " + rng.choice(S.ASIDES)
            r = r.lower() if rng.random() < 0.08 else r.replace("'", "’") if rng.random() < 0.1 else r
            if rng.random() < 0.08 and len(r) > 40:
                r = r[: rng.randint(30, len(r) - 1)]
            add(q, r, [R] * len(clauses(r)))
        # an answer of another tongue
        others = [t for t in by_tongue if t != tongue[i]]
        if others and rng.random() < 0.5:
            f = golds[rng.choice(by_tongue[rng.choice(others)])]
            if int(language.score(words(f)).argmax()) == tongue[i] or len(words(f)) < 3:
                continue
            if rng.random() < 0.3:
                f += " " + f
            if rng.random() < 0.2:
                f = f[: rng.randint(len(f) // 2, len(f))]
            lead = rng.choice(S.LEADS) if rng.random() < 0.2 else ""
            m = len(clauses(lead + f))
            if m == len(clauses(f)):
                lead = ""
            add(q, lead + f, [X] * len(clauses(lead + f)))
    return out


def defect(tags: np.ndarray, sizes: list[int]) -> str | None:
    """The defect that the shares of the answer's words tell, or None."""
    if not tags.any():
        return None
    n = max(1, sum(sizes))
    share = [sum(s for t, s in zip(tags, sizes, strict=True) if t == k) / n for k in range(len(TAGS))]
    if share[R] >= 0.3:
        return "refusal"
    if share[E] >= 0.7:
        return "copies_question"
    if share[X] >= 0.5:
        return "other_language"
    if len(tags) and tags[-1] == U:
        return "truncated"
    return None


class Tagger:
    """Defects of batches of pairs."""

    def __init__(self, field: Field, features: Features):
        self.field, self.features = field, features

    def defects(self, questions: Sequence[str | None], answers: Sequence[str], counts: Sequence[Sequence[int] | None]) -> list[str | None]:
        dense, rows, n, spans = self.features.batch(questions, answers, counts)
        if not len(n):
            return [None] * len(answers)
        e = self.field.emissions(dense, *self.features.hashed(rows, n))
        tags = np.zeros(len(n), dtype=np.int8)
        begin = np.concatenate(([0], np.cumsum(spans)))
        length_of = np.array(spans)
        for length in np.unique(length_of[length_of > 0]):
            at = begin[:-1][length_of == length][:, None] + np.arange(length)
            tags[at] = self.field.viterbi(e[at])
        sizes = n.tolist()
        return [defect(tags[low:high], sizes[low:high]) if high > low else None for low, high in zip(begin, begin[1:], strict=False)]


def _flag(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, known, shapes, residue = shared.value
        scorer = p3_residue.Scorer(*residue)
        tagger = Tagger(Field(*state), Features(Language(known, shapes)))
        for pdf in frames:
            ids, kinds = [], []
            todo: dict[tuple[str, str], list[int]] = {}
            ends: dict[tuple[str, str], Sequence[int] | None] = {}
            for i, q, a, c in zip(pdf["id"], pdf["question"], pdf["answer"], pdf["ends"], strict=True):
                if is_empty(a):
                    ids.append(i)
                    kinds.append("empty")
                else:
                    todo.setdefault((q or "", a), []).append(i)
                    ends[q or "", a] = c
            pairs = list(todo)
            sound = [p for p, k in zip(pairs, scorer.kinds([a for _, a in pairs]), strict=True) if k is None]
            for at in range(0, len(sound), 2000):
                part = sound[at : at + 2000]
                for p, kind in zip(part, tagger.defects([q for q, _ in part], [a for _, a in part], [ends[p] for p in part]), strict=True):
                    if kind:
                        ids += todo[p]
                        kinds += [kind] * len(todo[p])
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "defect_type": pd.Series(kinds, dtype=object)})

    return run


def training_counts(counts: DataFrame, answers: list[str]) -> dict[str, list[int]]:
    """The counts of what each open answer of the training pairs ends with. Bounded by the number of pairs."""
    keys = {a: tail_keys(a.rstrip()) for a in answers if not _END.search(a)}
    wanted = counts.sparkSession.createDataFrame([(k,) for k in {k for ks in keys.values() for k in ks}], "key long")
    found = {r["key"]: (r["n"], r["ended"]) for r in ending_counts(counts, F.broadcast(wanted)).collect()}
    return {a: [x for k in ks for x in found.get(k, (0, 0))] for a, ks in keys.items()}


def training_set(features: Features, made: list[tuple[str, str, list[int], int]], ends: dict[str, list[int]]) -> tuple[np.ndarray, ...]:
    """What ``Field.fit`` takes, from made pairs and the counts of their endings."""
    dense, rows, n, spans = features.batch([q for q, *_ in made], [a for _, a, *_ in made], [ends.get(a) for _, a, *_ in made], [own for *_, own in made])
    return dense, *features.hashed(rows, n), np.array([t for _, _, tags, _ in made for t in tags]), np.array(spans)


def fit(df: DataFrame, counts: DataFrame, sample: int = SAMPLE) -> tuple:
    """The model as plain data: field, language. ``df``: question, answer, gold; ``counts``: those of all its rows."""
    good = df.where((F.length(F.trim("question")) > 0) & (F.length(F.trim("gold")) > 0))
    pairs = [(r[0], r[1]) for r in good.select("question", "gold").distinct().orderBy(F.xxhash64("question", "gold"), "question", "gold").limit(sample).collect()]
    language = fit_language(counts)
    features, made = Features(language), training_pairs(pairs, language)
    ends = training_counts(counts, [a for _, a, _, _ in made])
    if not made:  # no sound pair to learn from: every clause is an answer
        zero = Field(np.zeros((N_DENSE, 5), np.float32), np.zeros((HASHED, 5), np.float32), np.zeros((5, 5), np.float32), np.zeros(5, np.float32), np.zeros(5, np.float32))
        zero.dense[0, A] = 1.0
        return zero.state(), language.known, language.shapes
    return Field.fit(*training_set(features, made, ends)).state(), language.known, language.shapes


def flag_defects(
    df: DataFrame, id_col: str = "result_id", question_col: str = "question", answer_col: str = "parsed_answer", gold_col: str = "gold_answer", sample: int = SAMPLE,
    residue: tuple | None = None,
) -> DataFrame:
    """``id, defect_type`` of every defective pair: empty, truncated, refusal, copies_question or other_language.

    A null answer is empty whatever else the row holds; a null question shares no word and has no language. Answers that
    are residue (problem 3) are no pairs to judge and get no row. Repeated rows give repeated results; other columns are
    not read. ``sample``: most sound pairs (distinct question and gold answer) that the field is trained on. ``residue``:
    a model of ``p3_residue.fit``; by default one is fitted to the answers.
    """
    residue = residue or p3_residue.fit(df.select(F.col(question_col).alias("question"), F.col(gold_col).alias("gold_answer"), F.col(answer_col).alias("answer")), ("answer",))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer"), F.col(gold_col).alias("gold"))
    counts = count_rows(rows)
    shared = df.sparkSession.sparkContext.broadcast((*fit(rows, counts, sample), residue))
    return with_endings(rows, counts).mapInPandas(_flag(shared), "id long, defect_type string")


def found(df: DataFrame) -> DataFrame:
    """Distinct ``result_id, defect_type``."""
    return flag_defects(df, residue=p3_residue.fit(df)).select(F.col("id").alias("result_id"), "defect_type").distinct()
