"""Problem 2: noise in text from scanned pages.

One pass over the corpus counts words and short lines that stand alone or break a sentence, a second one the pairs of
frequent words within a few words of each other; which words are frequent is decided by their sums over all texts, so no
count depends on how the texts are partitioned. Skip-gram vectors with negative sampling are trained on the pair counts
(the objective depends on the text through them alone), with a number of draws in proportion to the vocabulary. A rare word is linked to the frequent words it turns into by plausible glyph edits; the word
whose vector fits the words around it is the correction. Lines of the page edge are told by the chunk's pages, the
document's title and the counted lines; what is left is joined over line-end hyphens and reflowed.

The driver holds words above a share of all (``MIN_SHARE``), so their number is bounded whatever the corpus. Lines of the
page edge grow with the documents: up to ``BROADCAST_LIMIT`` they are broadcast, beyond it they are joined to the chunks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.runtime import BROADCAST_LIMIT

KINDS = ("hyphenation", "misread", "running_header", "page_number")
#: Least share of all words (pairs) that the model keeps: at most 1 / MIN_SHARE of each.
MIN_SHARE = 2e-6
#: Least share of all words, and least number, of a word that has vectors: at most 1 / VECTOR_SHARE words have them.
VECTOR_SHARE, VECTOR_COUNT = 2e-5, 10
#: Width of the window, vector size, fewest training steps, draws for each word of the vocabulary, pairs a step, negatives a pair.
WINDOW, DIMENSIONS, STEPS, DRAWS, BATCH, NEGATIVES = 3, 40, 150, 1300, 8192, 5
#: A candidate for a word of at least five letters is so many times as common as the word, for a shorter one ``RATIO`` times.
WIDE_RATIO = 4
#: A correction is so many times as common as the word it replaces where its fit to the context (in standard deviations)
#: is ``FIT``; a greater ratio stands for a lesser fit and the other way round, in natural logarithms.
RATIO, FIT = 12, -1.0
#: What a line of the page edge takes in a set of them, besides its letters.
LINE_BYTES = 120

# What a glyph is misread as: printed form -> what may stand in its place. Fixed values.
GLYPHS = {
    "l": ("1", "i", "I", "t"), "i": ("l", "1", "j"), "o": ("0", "a", "c"), "s": ("5",), "e": ("c", "o"), "c": ("e", "o"), "t": ("f", "l"), "f": ("t",), "a": ("o", "e"),
    "h": ("b", "li"), "b": ("6", "h"), "g": ("q", "9"), "q": ("g", "9"), "z": ("2",), "n": ("u", "ri"), "u": ("n", "ii", "v"), "m": ("rn", "nn", "in"), "d": ("cl",),
    "w": ("vv",), "k": ("lc",), "li": ("h",), "ti": ("b",), "ri": ("n",), "fi": ("fl", "ﬁ"), "rn": ("m",), "nn": ("m", "rm"), "in": ("m",), "cl": ("d",), "vv": ("w",), "ii": ("u",),
    "ü": ("ii", "u"), "S": ("5",), "B": ("8", "6"), "O": ("0",), "I": ("l", "1"), "G": ("6", "C"), "Z": ("2",), "D": ("O", "0"), "E": ("F",), "v": ("y", "u"), "y": ("v",), "r": ("n",),
}
#: The same read backwards: what stands -> what it may have been.
_BACK: dict[str, tuple[str, ...]] = {}
for _true, _seen in GLYPHS.items():
    for _s in _seen:
        _BACK[_s] = (*_BACK.get(_s, ()), _true)
# Letters that stand for digits inside numbers. Fixed values.
DIGITS = {"l": "1", "I": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2"}
# Marks that stand at the end of a broken line. Fixed values.
HYPHENS = "-‐‑¬\xad⁃"
# Signs that stand inside a word only where its encoding is broken. Fixed values.
FOREIGN = "ÃÂÐÑ"
# Words before which a hyphen is left standing ("pre- and postoperative"). Fixed values.
SUSPENDED = frozenset("and or to und oder bis et ou y o e und/oder bzw".split())

_WORD = re.compile(r"[^\W_]+")
_TERMINAL = re.compile(r"[.!?:;][\"”’)\]»]*$")
_BULLET = re.compile(r"^\s*(?:[-–—•*▪·]|\d{1,2}[.)]|[a-z]\))\s+\S")
_NUMBERED = re.compile(r"^\s*\d+(?:\.\d+)+\.?\s+\S|^\s*\d+\.\s+\S")
_LAST_WORD = re.compile(r"([^\W\d_]+)$")
_SPACED = re.compile(r"^\W*(?:\S\s+){5,}\S\W*$")
_PAGE_WORD = r"(?:p|pp|pg|page|pag|pagina|página|seite|s|str|стр|trang)"
_PAGE_LINE = re.compile(rf"^[\s\W_]*(?P<word>{_PAGE_WORD}\b\.?)?[\s\W_]*(?P<n>[0-9IlOoSB]{{1,5}})(?P<of>\s*(?:/|of|von|de|sur|из)\s*[0-9IlOoSB]{{1,5}})?[\s\W_]*$", re.IGNORECASE)
_EDGE_NUMBER = (re.compile(r"^\W*(?:(?:p|page|seite)\b\.?\s*)?(\d{1,4})\b(?:\s*(?:/|of)\s*\d{1,4})?[\s\W]+(?=[^\W\d])", re.IGNORECASE), re.compile(r"(?<=\w)[,.]?[\s\W]+(?:(?:p|page|seite)\b\.?\s*)?(\d{1,4})(?:\s*(?:/|of)\s*\d{1,4})?\W*$", re.IGNORECASE))
_VOLUME = re.compile(r"(?:vol|no|issue|bd|band|part|series|session)\W*$", re.IGNORECASE)
_JOIN = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*\n\s*(?!(?:{'|'.join(sorted(SUSPENDED))})\b)(?=[^\W\d_])", re.IGNORECASE)
_ISSUE = re.compile(r"\bv\s?o\s?l\b[\W_]*(?:[\dlio]\s?)+")
_GLYPH_DIGITS = str.maketrans("150689", "lsobbg")
_SKELETON = str.maketrans("ljaceofhqvy", "iioooo" + "tbguu")


def skeleton(line: str) -> str:
    """What is left of a line's letters when confusable glyphs are one: equal for a line and its misread copies."""
    s = "".join(w for w in _WORD.findall(_ISSUE.sub(" ", line.lower())) if not w.isdigit()).translate(_GLYPH_DIGITS)
    for seen, true in (("rn", "m"), ("nn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("ti", "b")):
        s = s.replace(seen, true)
    s = s.translate(_SKELETON)
    return re.sub(r"\d+", "", s)


# --- lines of the page edge ----------------------------------------------------------------------------------------


def _interrupts(lines: list[str], i: int) -> bool:
    """Whether line ``i`` stands inside a sentence: what is before it is not at an end, and what follows goes on."""
    before = next((x for x in reversed(lines[:i]) if x.strip()), "")
    after = next((x for x in lines[i + 1 :] if x.strip()), "")
    before, after = before.rstrip(), after.lstrip()
    return bool(before) and bool(after) and not _TERMINAL.search(before) and (after[0].islower() or before[-1] in HYPHENS or after[0].isdigit())


def loose_lines(text: str, widest: int = 0) -> Iterator[tuple[int, str]]:
    """Lines that may belong to the page edge: short against the others (or of at most ``widest`` signs), no sentence
    end, no list item."""
    lines = text.split("\n")
    if len(lines) < 2:
        return
    widths = sorted(len(x) for x in lines if x.strip())
    if not widths:
        return
    limit = max(30, widest, 0.8 * widths[int(0.7 * (len(widths) - 1))])
    for i, line in enumerate(lines):
        s = line.strip()
        if s and (len(s) <= limit and not _TERMINAL.search(s) and (not _BULLET.match(line) or _PAGE_LINE.match(s)) or _SPACED.match(s)):
            yield i, s


class Edges:
    """Judges the lines of a chunk by its pages, its document's title and the lines counted over the corpus."""

    def __init__(self, common: set[str]):
        self.common = common

    def judge(self, text: str, title: str | None, section: str | None, first: int | None, last: int | None) -> tuple[list[str], dict[int, set[str]]]:
        lines = text.split("\n")
        out: dict[int, set[str]] = {}
        loose = dict(loose_lines(text, 100))
        if not loose:
            return lines, out
        pages = None if first is None else range(min(first, last if last is not None else first) - 1, max(first, last if last is not None else first) + 2)
        name = skeleton(title) if title else ""
        own = skeleton(section) if section else ""
        for i, s in loose.items():
            if _SPACED.match(s):
                s = re.sub(r"(?<=\S) (?=\S)", "", s)
            m = _PAGE_LINE.match(s)
            if m:
                n = int("".join(DIGITS.get(c, c) for c in m["n"])) if m["n"].translate(str.maketrans("", "", "IlOoSB0123456789")) == "" else -1
                dressed = bool(m["word"] or m["of"]) or bool(re.match(r"^[-–—·•\[(|~*]", s) and re.search(r"[-–—·•\])|~*]$", s))
                near = pages is not None and n in pages
                if near and (dressed or _interrupts(lines, i) or i in (0, len(lines) - 1) or first <= n <= (last or first)) or dressed and (pages is None or _interrupts(lines, i)):
                    out[i] = {"page_number"}
                continue
            if _NUMBERED.match(s) and not (pages is not None and (e := _EDGE_NUMBER[0].match(s)) and int(e[1]) in pages):
                continue
            numbers, rest = [], s
            for pattern in _EDGE_NUMBER:
                e = pattern.search(rest)
                if e and not _VOLUME.search(rest[: e.start(1)]):
                    if pages is not None and int(e[1]) in pages:
                        numbers.append(int(e[1]))
                        rest = rest[: e.start()] + rest[e.end() :]
            bones = skeleton(rest)
            if len(bones) < 5 or bones == own:
                continue
            shared = 0
            for a, b in zip(bones, name, strict=False):
                if a != b:
                    break
                shared += 1
            titled = len(name) > 0 and shared >= 10 and (shared >= 0.8 * len(bones) or shared >= 0.5 * len(name) and len(bones) - shared <= 14)
            if titled or bones in self.common:
                out[i] = {"running_header"} | ({"page_number"} if numbers else set())
        # a bare number beside a header of the page edge is its page number
        for i in list(out):
            for k in (i - 1, i + 1):
                if k in loose and k not in out and pages is None and re.fullmatch(r"\W*\d{1,4}\W*", loose[k]):
                    out[k] = {"page_number"}
        return lines, out


class _Asked(set):
    """Holds nothing and notes what was looked for."""

    def __init__(self):
        super().__init__()
        self.seen: set[str] = set()

    def __contains__(self, bones: object) -> bool:
        self.seen.add(bones)
        return False


# --- counting ------------------------------------------------------------------------------------------------------


def _plain(text: str) -> str:
    """Line-end hyphens joined, so that whole words are counted; not before a word that leaves the hyphen standing."""
    return _JOIN.sub("", text)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``kind, a, n``: words (w) and loose lines (l)."""
    singles: Counter = Counter()
    lines: Counter = Counter()
    for pdf in frames:
        for text in pdf["text"]:
            singles.update(_WORD.findall(_plain(text)))
            split = None
            for i, s in loose_lines(text):
                if len(s) <= 90 and sum(map(str.isalpha, s)) >= 5:
                    split = split or text.split("\n")
                    bones = skeleton(re.sub(r"(?<=\S) (?=\S)", "", s) if _SPACED.match(s) else s)
                    if len(bones) >= 5:
                        lines[bones + ("\ti" if _interrupts(split, i) else "\tn")] += 1
        if len(singles) + len(lines) > 500_000:  # emit and start anew: the counters stay small, the sums are the same
            yield from _emit(singles, lines)
            singles, lines = Counter(), Counter()
    yield from _emit(singles, lines)


def _emit(singles: Counter, lines: Counter) -> Iterator[pd.DataFrame]:
    for kind, counts in (("w", singles), ("l", lines)):
        if counts:  # an empty column would have no string type
            yield pd.DataFrame({"kind": kind, "a": list(counts), "n": list(counts.values())})


def _count_pairs(shared):
    """``a, b, n``: places of words with vectors, the second behind the first by at most ``WINDOW`` words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value
        size = np.int64(max(1, len(places)))
        tokens: list[int] = []
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def flush() -> None:
            nonlocal keys, sums
            code = np.array(tokens, dtype=np.int64)
            found = [keys]
            weights = [sums]
            for d in range(1, WINDOW + 1):
                a, b = code[:-d], code[d:]
                ok = (a >= 0) & (b >= 0)
                k, n = np.unique(a[ok] * size + b[ok], return_counts=True)
                found.append(k)
                weights.append(n)
            keys, inverse = np.unique(np.concatenate(found), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(keys)).astype(np.int64)
            tokens.clear()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"a": (keys // size).astype(np.int32), "b": (keys % size).astype(np.int32), "n": sums})

        for pdf in frames:
            for text in pdf["text"]:
                tokens += [places.get(w, -1) for w in _WORD.findall(_plain(text))]
                tokens += [-1] * WINDOW  # no pair across two texts
                if len(tokens) > 600_000:
                    flush()
            if len(keys) > 2_000_000:
                yield out()
                keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        flush()
        yield out()

    return run


def train_vectors(words: list[str], counts: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram with negative sampling on pair counts: word vectors and context vectors."""
    rng = np.random.default_rng(seed)
    size = len(words)
    v = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    u = np.zeros((size, DIMENSIONS), dtype=np.float32)
    if not len(n):
        return v, u
    total_v, total_u = np.full((size, 1), 1e-3, np.float32), np.full((size, 1), 1e-3, np.float32)
    a, b = np.concatenate((left, right)), np.concatenate((right, left))
    # frequent words are thinned as usual for skip-grams, by weight and not by chance
    keep = np.minimum(1.0, np.sqrt(1e-3 / np.maximum(counts / counts.sum(), 1e-12)))
    weight = np.concatenate((n, n)) * keep[a] * keep[b]
    cumulated = np.cumsum(weight / weight.sum())
    noise = np.cumsum(counts**0.75 / (counts**0.75).sum())
    for _ in range(max(STEPS, -(-DRAWS * size // BATCH))):
        pick = np.minimum(np.searchsorted(cumulated, rng.random(BATCH)), len(a) - 1)
        w = np.repeat(a[pick], 1 + NEGATIVES)
        c = np.minimum(np.searchsorted(noise, rng.random(BATCH * (1 + NEGATIVES))), size - 1)
        c[:: 1 + NEGATIVES] = b[pick]
        label = np.zeros(len(c), dtype=np.float32)
        label[:: 1 + NEGATIVES] = 1.0
        vw, uc = v[w], u[c]
        g = (label - 1 / (1 + np.exp(-np.clip((vw * uc).sum(axis=1), -15, 15))))[:, None]
        for target, total, index, grad in ((v, total_v, w, g * uc), (u, total_u, c, g * vw)):
            order = np.argsort(index, kind="stable")
            at, start = np.unique(index[order], return_index=True)
            step = np.add.reduceat(grad[order], start, axis=0)
            total[at] += (step * step).mean(axis=1, keepdims=True)
            target[at] += 0.3 * step / np.sqrt(total[at])
    return v, u


# --- correction ----------------------------------------------------------------------------------------------------


def originals(word: str, most: int = 2) -> set[str]:
    """Words that ``word`` may be a misreading of, by at most ``most`` glyph edits (the second from five letters on)."""
    level, out = {word}, set()
    for _ in range(most if len(word) >= 5 else 1):
        following = set()
        for w in level:
            for i in range(len(w)):
                for width in (1, 2):
                    options = _BACK.get(w[i : i + width])
                    if options:
                        left, right = w[:i], w[i + width :]
                        for true in options:
                            following.add(left + true + right)
        following -= {word}
        out |= following
        level = following
    return out


class Corrector:
    """Corrections of rare words in their context; one per task."""

    def __init__(self, counts: dict[str, int], cut: float, places: dict[str, int], v: np.ndarray, u: np.ndarray):
        self.counts, self.cut, self.places, self.v, self.u = counts, cut, places, v, u
        self.folded: dict[str, int] = {}
        for w, n in counts.items():
            f = w.lower()
            self.folded[f] = self.folded.get(f, 0) + n
        self.memo: dict[str, tuple[str, ...]] = {}
        self.fine: set[str] = set()
        #: A word above this count can only be a misreading of one that makes up a tenth of all words.
        self.common = max(3.0, 0.1 / RATIO * sum(counts.values()))
        self.spread = float(np.std(v @ u[: min(len(u), 200)].T)) if len(v) else 1.0

    def candidates(self, word: str) -> tuple[str, ...]:
        out = self.memo.get(word)
        if out is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            out = self.memo[word] = self._candidates(word)
        return out

    def _candidates(self, word: str) -> tuple[str, ...]:
        if len(word) < 3 or word.isdigit() or word.isupper() and len(word) > 3 or any(c in FOREIGN for c in word[1:]):
            return ()
        lower = word.lower()
        mine = max(self.folded.get(lower, 0), self.counts.get(word, 0))
        if mine > self.common:
            return ()
        need = max((WIDE_RATIO if len(word) >= 5 else RATIO) * mine, 3 * self.cut if not mine else 0, 5)
        seen = {w.lower(): self.folded.get(w.lower(), 0) for w in originals(word) | originals(lower)}
        need = max(need, 0.02 * max(seen.values(), default=0))
        shape = lambda w: w if w in self.counts else w[:1].upper() + w[1:]
        return tuple(shape(w) for w in sorted((w for w, n in seen.items() if n >= need and w != lower), key=lambda w: (-seen[w], w)))

    def suspects(self, words: list[str]) -> set[str]:
        """The words that have a correction in some context; the others are remembered as fine."""
        out = set()
        for w in set(words) - self.fine:
            if self.number(w) or self.candidates(w):
                out.add(w)
            else:
                if len(self.fine) > 500_000:
                    self.fine.clear()
                self.fine.add(w)
        return out

    def fit(self, word: str, around: list[str]) -> float:
        """How well the word's vector fits the words around it, in spreads; 0 if nothing is known."""
        i = self.places.get(word, self.places.get(word.lower()))
        rows = [self.places[w] for w in around if w in self.places]
        if i is None or not rows:
            return 0.0
        return float((self.v[i] @ self.u[rows].T).mean() / (self.spread or 1.0))

    def correct(self, word: str, around: list[str]) -> str | None:
        options = self.candidates(word)
        if not options:
            return None
        # a word below the cut may have any count up to it
        mine = max(self.folded.get(word.lower(), 0), self.counts.get(word, 0), self.cut / 4, 0.4)
        # short words have many neighbours: their ratio never outweighs the context
        most = RATIO if len(word) < 5 else math.inf
        evidence, best = max((math.log(min(self.folded[w.lower()] / mine, most)) + self.fit(w, around), w) for w in options)
        if evidence < math.log(RATIO) + FIT:
            return None
        return best[:1].upper() + best[1:] if word[:1].isupper() else best

    def number(self, word: str) -> str | None:
        """A number with letters in place of digits."""
        if len(word) < 2 or word.isdigit() or word in self.counts and self.counts[word] > max(3, 3 * self.cut) or not any(c.isdigit() for c in word) or not all(c.isdigit() or c in DIGITS for c in word):
            return None
        plain = "".join(DIGITS.get(c, c) for c in word)
        return plain if plain != word and word[0].isdigit() and not plain.startswith("0") else None


def repair(text: str, title: str | None, section: str | None, first: int | None, last: int | None, edges: Edges, corrector: Corrector) -> tuple[list[str], str]:
    """(kinds of noise in the order of ``KINDS``, the text as continuous paragraphs)."""
    lines, out = edges.judge(text, title, section, first, last)
    kinds = {k for v in out.values() for k in v}
    # paragraphs: blank lines part them, but not where a removed line stood inside a sentence
    paragraphs: list[list[str]] = [[]]
    blank = False
    for i, line in enumerate(lines):
        if i in out:
            continue
        if not line.strip():
            blank = True
            continue
        current = paragraphs[-1]
        if current and blank:
            before = current[-1].rstrip()[-8:]
            edge = any(k in out for k in range(max(0, i - 4), i))
            if not (edge and not _TERMINAL.search(before) and (line.lstrip()[:1].islower() or before[-1:] in HYPHENS)):
                paragraphs.append([])
                current = paragraphs[-1]
        blank = False
        current.append(line)
    done: list[str] = []
    for paragraph in paragraphs:
        pieces: list[str] = []
        for line in paragraph:
            fresh = not pieces or _BULLET.match(line) or _NUMBERED.match(line)
            if fresh:
                pieces.append(line.strip())
                continue
            before = pieces[-1]
            # only the end is looked at: a search through the growing paragraph would be quadratic
            tail = before.rstrip(" \t")
            m = w = None
            if tail[-1:] in HYPHENS and tail[-2:-1].isalpha():
                head = tail[-81:-1]
                m = _LAST_WORD.search(head)
                w = _WORD.match(line.lstrip())
            if m and w and not w[0].isdigit():
                joined, compound = m[1] + w[0], f"{m[1]}-{w[0]}"
                known = corrector.folded.get(joined.lower(), 0)
                if w[0].lower() in SUSPENDED and not known > 2:
                    pieces[-1] = before + " " + line.strip()
                    continue
                kinds.add("hyphenation")
                stem = tail[: len(tail) - 1 - len(m[1])]
                parts = min(corrector.folded.get(m[1].lower(), 0), corrector.folded.get(w[0].lower(), 0))
                whole = joined if tail[-1] == "\xad" or known or corrector.candidates(joined) or parts <= RATIO * max(1, known) and parts < 50 else compound
                pieces[-1] = stem + whole + line.lstrip()[w.end() :]
            elif len(before) < 40 and not _TERMINAL.search(before[-8:]) and (line.lstrip()[:1].isupper() or line.lstrip()[:1] in "“¿¡") and len(pieces) == 1 and pieces[0] == paragraph[0].strip():
                pieces.append(line.strip())  # a heading line
            else:
                pieces[-1] = before.rstrip() + " " + line.strip()
        done += ["\n".join(pieces)]
    result = "\n\n".join(p for p in done if p)
    suspects = corrector.suspects(_WORD.findall(result))
    fixed: list[tuple[int, int, str]] = []
    if suspects:
        matches = list(_WORD.finditer(result))
        for k, m in enumerate(matches):
            w = m[0]
            # a short word at the edge of the text may be the rest of a word that the chunk's border cuts
            if w not in suspects or len(w) <= 4 and (k == 0 and w.islower() or k == len(matches) - 1):
                continue
            new = corrector.number(w)
            if new is None:
                near = [x[0] for x in matches[max(0, k - WINDOW) : k + WINDOW + 1] if x is not m]
                new = corrector.correct(w, near)
            if new and new != w:
                fixed.append((m.start(), m.end(), new))
    if fixed:
        kinds.add("misread")
        parts, at = [], 0
        for s, e, new in fixed:
            parts += [result[at:s], new]
            at = e
        result = "".join(parts) + result[at:]
    return [k for k in KINDS if k in kinds], result


def fit(texts: DataFrame, min_share: float = MIN_SHARE) -> tuple:
    """The model: word counts, cut, vector places, vectors as plain data, and the lines of the page edge as a table
    ``bones``. ``texts``: one column, text."""
    texts = texts.where(F.length("text") > 0)
    sums = texts.mapInPandas(_count, "kind string, a string, n long").groupBy("kind", "a").agg(F.sum("n").alias("n"))
    from ferrywork.runtime import cut as checkpoint

    sums = checkpoint(sums)
    total = sums.where("kind = 'w'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = total * min_share
    words = sums.where((F.col("kind") == "w") & (F.col("n") >= cut)).select("a", "n").toPandas()
    counts = dict(zip(words["a"], words["n"].astype(int), strict=True))
    frequent = words[words["n"] >= max(VECTOR_COUNT, total * VECTOR_SHARE)].sort_values(["n", "a"], ascending=[False, True])
    places = {w: i for i, w in enumerate(frequent["a"])}
    shared = texts.sparkSession.sparkContext.broadcast(places)
    pairs = texts.mapInPandas(_count_pairs(shared), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # pairs below a share of all words tell the vectors nothing: at most WINDOW / min_share pairs reach the driver
    pairs = pairs.where(F.col("n") >= max(3, cut)).toPandas().sort_values(["a", "b"])
    v, u = train_vectors(list(places), frequent["n"].to_numpy(dtype=float), pairs["a"].to_numpy(dtype=np.int64), pairs["b"].to_numpy(dtype=np.int64), pairs["n"].to_numpy(dtype=float))
    return counts, float(cut), places, v, u, edge_lines(sums.where("kind = 'l'"))


def edge_lines(lines: DataFrame) -> DataFrame:
    """``bones`` of the counted lines (``a``: skeleton, tab, i inside a sentence or n elsewhere; ``n``) that stand inside
    a sentence twice at least and in 15 % of all cases. No share of the corpus decides: a header's count is that of its
    document, however many others there are."""
    inside, n = F.sum(F.when(F.col("a").endswith("\ti"), F.col("n")).otherwise(0)), F.sum("n")
    per_line = lines.groupBy(F.substring_index("a", "\t", 1).alias("bones")).agg(inside.alias("inside"), n.alias("n"))
    return per_line.where("inside >= 2 and inside >= 0.15D * n").select("bones")


def _pages(first: object, last: object) -> tuple[int | None, int | None]:
    return None if pd.isna(first) else int(first), None if pd.isna(last) else int(last)


def _ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for key, text, title, section, first, last in zip(pdf["key"], pdf["text"], pdf["title"], pdf["section"], pdf["first"], pdf["last"], strict=True):
            asked = _Asked()
            Edges(asked).judge(text, title, section, *_pages(first, last))
            rows += [(key, x) for x in asked.seen]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "bones"])


def with_known(rows: DataFrame, passing: DataFrame) -> DataFrame:
    """``rows`` with the column ``known``: which of their lines are among the ``passing`` ones."""
    keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct(*rows.columns)), 256))
    asked = keyed.mapInPandas(_ask, "key string, bones string").distinct()
    known = asked.join(passing, "bones").groupBy("key").agg(F.collect_set("bones").alias("known"))
    return keyed.join(known, "key", "left").drop("key")


def _repair(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, cut, places, v, u, common = shared.value
        edges, corrector = Edges(common), Corrector(counts, cut, places, v, u)
        for pdf in frames:
            rows = []
            known = pdf["known"] if "known" in pdf else [None] * len(pdf)
            for i, text, title, section, first, last, own in zip(pdf["id"], pdf["text"], pdf["title"], pdf["section"], pdf["first"], pdf["last"], known, strict=True):
                kinds, new = repair(text, title, section, *_pages(first, last), edges if own is None else Edges(set(own)), corrector)
                if kinds:
                    rows.append((i, kinds, new))
            yield pd.DataFrame(rows, columns=["id", "kinds", "repaired"])

    return run


def repair_scans(
    df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", title_col: str = "doc_title", section_col: str = "section_title", first_col: str = "page_start", last_col: str = "page_end",
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``id, kinds, repaired`` of every disturbed text: its kinds of noise and its text as continuous paragraphs.

    Null and empty texts are not disturbed. Null titles, sections and pages are unknown; pages in the wrong order are
    taken as a range either way. Repeated rows give repeated results; other columns are not read.
    """
    rows = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(title_col).alias("title"), F.col(section_col).alias("section"),
        F.col(first_col).cast("double").alias("first"), F.col(last_col).cast("double").alias("last"),
    ).where(F.length("text") > 0)
    *model, passing = fit(rows.select("text"))
    held = passing.agg(F.coalesce(F.sum(F.length("bones") + LINE_BYTES), F.lit(0))).first()[0]
    common: set[str] = set()
    if held <= broadcast_limit:
        common = {r["bones"] for r in passing.collect()}
    else:
        rows = with_known(rows, passing)
    shared = df.sparkSession.sparkContext.broadcast((*model, common))
    return rows.mapInPandas(_repair(shared), "id string, kinds array<string>, repaired string")


def found(df: DataFrame) -> DataFrame:
    """Distinct ``chunk_id, noise_kind``."""
    return repair_scans(df).select(F.col("id").alias("chunk_id"), F.explode("kinds").alias("noise_kind")).distinct()
