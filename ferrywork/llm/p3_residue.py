"""Problem 3: template remains, filler, error messages and script notices in place of content.

Character 4-gram models (Witten-Bell interpolation over a small alphabet) of each kind of residue, fitted to generated
material, and of natural prose, fitted to counts over the whole table, give each character a log-likelihood ratio.
Windows of several widths localise residue; a field is excluded by the share of it that such windows cover.

All texts of a batch are scored at once by table look-up and running sums.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.llm import p3_seeds

#: Signs with a symbol of their own besides letters, digits and space.
SIGNS = ".,'\"?:-([]{}<>/|_$%#="
SAME = {"!": "?", ";": ":", "–": "-", "—": "-", "‐": "-", "’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"', ")": "(", "…": ".", "`": "'", "\\": "/"}
BOUNDARY, SPACE, DIGIT, OTHER, LETTER = 0, 1, 2, 3, 4
SIZE = LETTER + 26 + len(SIGNS)
KINDS = ("template", "filler", "notice")
WIDTHS = (12, 24, 48)
#: Least window sums (nats) of residue, and those of the first model, which only decides what the prose model counts.
FLOORS, FIRST_FLOORS = (7.0, 10.0, 14.0), (6.5, 9.0, 13.0)
#: Prose of any kind, seen or not, is taken to be at least this likely (nats a character; the second for signs of markup,
#: which prose has seldom): a text that no model knows is no residue.
BACKGROUND, MARKUP_BACKGROUND, MARKUP = -2.0, -7.0, "[]{}<>/|_$%#="
#: Ratios are kept in steps of so many nats, one byte each.
STEP = 0.125
#: Characters that are scored at once.
GROUP = 400_000
#: A text of at most so many characters is residue as a whole from a lower sum on, which grows with the characters beyond
#: the first number by the last one.
BRIEF, LONGEST_BRIEF, BRIEF_FLOOR, BRIEF_SLOPE = 20, 40, 4.5, 0.225
#: Generated texts a residue model is fitted to.
SEED_TEXTS = 6000
#: Share of the natural texts that stay below a threshold, and its distance (nats) from what they reach.
NATURAL, DISTANCE = 0.999, 1.0
#: A field with at least this share of residue is excluded; template delimiters count from one whole slot on.
COVERAGE = 0.15
#: Delimiters that other writing uses as well: brackets of an editor, markup.
SHARED_DELIMITERS = ("[", "<")


def _slots(delimiters: list[tuple[str, str]]) -> re.Pattern:
    """Whole slots: a name or an instruction between delimiters, on one line and without quotation marks."""
    forms = []
    for left, right in sorted({(a.strip(), b.strip()) for a, b in delimiters}, key=lambda x: (-len(x[0]), x)):
        if left == right:  # without blanks: a pair of per cent signs is no slot
            # each form begins with a fixed sign, so that the search skips to such signs
            forms.append(rf"{re.escape(left[0])}(?<!\w{re.escape(left[0])}){re.escape(left[1:])}[^\W_](?:[\w.|-]{{0,58}}[^\W_])?{re.escape(right)}(?!\w)")
        else:
            signs = re.escape("".join(sorted(set(left + right) - {"s"})))
            first = r"[^\W\d_]" if left in SHARED_DELIMITERS else r"\w"  # [1] is a reference
            forms.append(rf"{re.escape(left)}[ \t]?{first}[^\n\",{signs}]{{0,59}}{re.escape(right)}")
    return re.compile("|".join(forms))


SLOT = _slots(list(p3_seeds.DELIMITERS))
#: Slots in delimiters of template languages alone.
PLAIN_SLOT = _slots([d for d in p3_seeds.DELIMITERS if d[0] not in SHARED_DELIMITERS])
#: Such delimiters are a sign themselves: the least sum of a slot between them (of others ``BRIEF_FLOOR``).
PLAIN_SLOT_FLOOR = 0.0
#: What a slot is scored behind.
SLOT_CONTEXT = "to "
#: A text without any of these holds no slot.
SLOT_SIGNS = ("{", "[", "<", "%", "__", "@@")


def _alphabet() -> np.ndarray:
    table = np.full(65537, OTHER, dtype=np.uint8)
    for cp in range(1, 65536):
        c = SAME.get(chr(cp), chr(cp))
        base = unicodedata.normalize("NFD", c)[0].lower() if cp > 127 else c.lower()
        if "a" <= base <= "z":
            table[cp] = LETTER + ord(base) - 97
        elif base in "đıøłæœß":
            table[cp] = LETTER + ord(dict(zip("đıøłæœß", "diolaos", strict=True))[base]) - 97
        elif c.isspace() or c in "\xad​":
            table[cp] = SPACE
        elif base.isdigit():
            table[cp] = DIGIT
        elif c in SIGNS:
            table[cp] = LETTER + 26 + SIGNS.index(c)
    table[0] = BOUNDARY
    return table


def symbols(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each with three boundaries before and one behind it, and the place of each text."""
    joined = "\0\0\0" + "\0\0\0".join(t.replace("\0", " ") for t in texts) + "\0"
    cps = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 65536)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = 3 + np.concatenate(([0], np.cumsum(lengths[:-1] + 3)))
    return alphabet[cps], starts


def grams(s: np.ndarray) -> np.ndarray:
    """The number of the 4-gram that ends at each place from the fourth on."""
    s = s.astype(np.int32)
    return ((s[:-3] * SIZE + s[1:-2]) * SIZE + s[2:-1]) * SIZE + s[3:]


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before) from 4-gram counts."""
    c4 = counts.reshape(SIZE, SIZE, SIZE, SIZE)
    p = np.full(SIZE, 1.0 / SIZE, dtype=np.float32)
    for axes in ((0, 1, 2), (0, 1), (0,), ()):
        c = c4.sum(axis=axes, dtype=np.float32) if axes else c4.astype(np.float32)
        n, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True).astype(np.float32)
        kinds = np.maximum(kinds, 1)
        p = (c + kinds * p) / (n + kinds)
    return np.log(p, out=p).ravel()


def count_texts(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    s, _ = symbols(texts, alphabet)
    g = grams(s)
    return np.bincount(g[s[3:] + s[2:-1] > 0], minlength=SIZE**4)


class Scorer:
    """Residue of texts by the ratio tables; ``thresholds``: of each kind, for each window width."""

    def __init__(self, tables: dict[str, np.ndarray], thresholds: dict[str, list[float]]):
        self.tables, self.thresholds, self.alphabet = tables, thresholds, _alphabet()

    def windows(self, texts: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, width, window sum at each place, starts, lengths)."""
        s, starts = symbols(texts, self.alphabet)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        g = grams(s)
        # the two padding boundaries of a text tell nothing; the one behind its end does
        mute = np.zeros(len(s), dtype=bool)
        mute[1:] = (s[1:] == BOUNDARY) & (s[:-1] == BOUNDARY)
        mute[:3] = True
        at = np.arange(len(s), dtype=np.int32)
        first = np.zeros(len(s), dtype=np.int32)
        first[starts] = starts
        np.maximum.accumulate(first, out=first)
        lows = [np.maximum(at - (width - 1), first) for width in WIDTHS]
        total = np.zeros(len(s) + 1, dtype=np.float32 if len(s) < 50_000 else np.float64)
        for kind in KINDS:
            ratio = np.zeros(len(s), dtype=np.float32)
            ratio[3:] = self.tables[kind][g]
            ratio *= STEP
            ratio[mute] = 0.0
            np.cumsum(ratio, out=total[1:])
            for width, low in zip(WIDTHS, lows, strict=True):
                yield kind, width, total[1:] - total[low], starts, lengths

    def best(self, texts: list[str]) -> dict[tuple[str, int], np.ndarray]:
        """The greatest window sum of each text (the boundary behind it included)."""
        return {(kind, width): np.maximum.reduceat(w, starts) for kind, width, w, starts, _ in self.windows(texts)}

    def slotted(self, texts: list[str], slot: re.Pattern) -> np.ndarray:
        """The numbers of the texts that hold a whole slot. The slot is its own window, scored apart from the text around
        it: what stands there must not hide it."""
        found = [(j, m[0]) for j, t in enumerate(texts) if any(d in t for d in SLOT_SIGNS) for m in slot.finditer(t)]
        if not found:
            return np.zeros(0, dtype=np.int64)
        owner, slots = zip(*found, strict=True)
        s, starts = symbols([SLOT_CONTEXT + x for x in slots], self.alphabet)
        total = np.concatenate((np.zeros(4), np.cumsum(self.tables["template"][grams(s)] * STEP)))
        starts = starts + len(SLOT_CONTEXT)
        ends = starts + np.fromiter((len(x) for x in slots), dtype=np.int64, count=len(slots))
        floors = np.array([PLAIN_SLOT_FLOOR if PLAIN_SLOT.fullmatch(x) else BRIEF_FLOOR for x in slots])
        return np.unique(np.array(owner)[total[ends] - total[starts] >= floors])

    def coverage(self, texts: list[str], slot: re.Pattern = SLOT) -> dict[str, np.ndarray]:
        """The share of each text's characters that residue windows of each kind cover; for template it is ``COVERAGE``
        at least where the text holds a whole ``slot``, however long it is."""
        out: dict[str, np.ndarray] = {}
        if not texts:
            return {k: np.zeros(0) for k in KINDS}
        marks: np.ndarray | None = None
        for kind, width, w, starts, lengths in self.windows(texts):
            if width == WIDTHS[0]:
                marks = np.zeros(len(w) + 1, dtype=np.int32)
            hit = np.flatnonzero(w >= self.thresholds[kind][WIDTHS.index(width)])
            if len(hit):
                owner = np.searchsorted(starts, hit, side="right") - 1
                np.add.at(marks, np.maximum(hit - width + 1, starts[owner]), 1)
                np.add.at(marks, hit + 1, -1)
            if width == WIDTHS[1]:
                brief = (lengths <= LONGEST_BRIEF) & (np.maximum.reduceat(w, starts) >= BRIEF_FLOOR + BRIEF_SLOPE * np.maximum(lengths - BRIEF, 0))
            if width == WIDTHS[-1]:
                covered = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:-1] > 0)))
                end = np.minimum(starts + lengths, len(covered) - 1)
                out[kind] = (covered[end] - covered[np.minimum(starts, len(covered) - 1)]) / np.maximum(lengths, 1)
                out[kind][brief] = 1.0
                if kind == "template":
                    j = self.slotted(texts, slot)
                    out[kind][j] = np.maximum(out[kind][j], COVERAGE)
        return out

    def kinds(self, texts: list[str | None], slot: re.Pattern = SLOT) -> list[str | None]:
        """The kind of residue for which each text is to be excluded, or None."""
        unique = list({t for t in texts if t and not t.isspace()})
        found: dict[str, str] = {}
        # long texts go one by one, short ones together: memory follows the longest text, not the batch
        group: list[str] = []
        held = 0
        for t in [*unique, None]:
            if group and (t is None or held + len(t) > GROUP):
                cover = self.coverage(group, slot)
                shares = np.stack([cover[k] for k in KINDS])
                top, share = shares.argmax(axis=0), shares.max(axis=0)
                for j in np.flatnonzero(share >= COVERAGE):
                    found[group[j]] = KINDS[top[j]]
                group, held = [], 0
            if t is not None:
                group.append(t)
                held += len(t)
        return [found.get(t) if t else None for t in texts]


def _ratios(prose: np.ndarray, alphabet: np.ndarray) -> dict[str, np.ndarray]:
    background = np.full(SIZE, BACKGROUND, dtype=np.float32)
    background[[LETTER + 26 + SIGNS.index(c) for c in MARKUP]] = MARKUP_BACKGROUND
    natural = np.maximum(log_model(prose).reshape(-1, SIZE), background).ravel()
    return {k: np.clip(np.rint((log_model(count_texts(p3_seeds.residue(k, SEED_TEXTS), alphabet)) - natural) / STEP), -127, 127).astype(np.int8) for k in KINDS}


def _summed(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of all parts and how often they came; the parts are merged one by one."""
    keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for part in parts:
        k, n = np.unique(part, return_counts=True)
        keys, inverse = np.unique(np.concatenate((keys, k)), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate((sums, n)), minlength=len(keys)).astype(np.int64)
    return keys, sums


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """The texts in groups of about ``GROUP`` characters; a longer one is a group of its own."""
    group: list[str] = []
    held = 0
    for t in texts:
        if group and held + len(t) > GROUP:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def _grams_of(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    s, _ = symbols(texts, alphabet)
    return grams(s)[s[3:] + s[2:-1] > 0]


def _count_natural(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``gram, n`` of natural texts, plain and dressed."""
    alphabet = _alphabet()
    keys, n = _summed(_grams_of([*part, *p3_seeds.dressed(part)], alphabet) for pdf in frames for part in _pieces(list(pdf["text"])))
    yield pd.DataFrame({"gram": keys, "n": n})


def _count_prose(shared):
    """``gram, n`` of all texts in which the model finds no residue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)

        def parts() -> Iterator[np.ndarray]:
            for pdf in frames:
                texts = list(pdf["text"])
                natural = [t for t, k in zip(texts, scorer.kinds(texts, PLAIN_SLOT), strict=True) if k is None]
                for part in _pieces(natural):
                    yield _grams_of(part, scorer.alphabet)

        keys, n = _summed(parts())
        yield pd.DataFrame({"gram": keys, "n": n})

    return run


def _reached(shared):
    """``place, at, n``: how many dressed natural texts have their greatest window sum of a kind and width (numbered by
    ``place``) at so many steps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value, {k: [0.0] * len(WIDTHS) for k in KINDS})

        def parts() -> Iterator[np.ndarray]:
            for pdf in frames:
                for part in _pieces(list(pdf["text"])):
                    for (kind, width), top in scorer.best(p3_seeds.dressed(part, seed=17)).items():
                        place = KINDS.index(kind) * len(WIDTHS) + WIDTHS.index(width)
                        yield place * (1 << 32) + (1 << 31) + np.rint(top / STEP).astype(np.int64)

        keys, n = _summed(parts())
        yield pd.DataFrame({"place": (keys >> 32).astype(np.int32), "at": (keys & 0xFFFFFFFF) - (1 << 31), "n": n})

    return run


def _thresholds(counts: pd.DataFrame) -> dict[str, list[float]]:
    """For each kind and width, above what the share ``NATURAL`` of natural texts reach, and never below ``FLOORS``."""
    out = {}
    for i, kind in enumerate(KINDS):
        out[kind] = list(FLOORS)
        for j in range(len(WIDTHS)):
            rows = counts[counts["place"] == i * len(WIDTHS) + j].sort_values("at")
            if len(rows):
                within = rows["n"].cumsum().to_numpy() >= NATURAL * rows["n"].sum()
                out[kind][j] = max(FLOORS[j], DISTANCE + STEP * float(rows["at"].to_numpy()[within.argmax()]))
    return out


def fit(
    df: DataFrame, fields: tuple[str, ...] = ("parsed_answer", "raw_judge_response"), prose_fields: tuple[str, ...] = ("question", "gold_answer")
) -> tuple[dict[str, np.ndarray], dict[str, list[float]]]:
    """Ratio tables and thresholds, each from all rows.

    A first prose model is counted over the distinct natural texts (``prose_fields``), plain and in the forms that machine
    replies take. It keeps residue out of the second, which is counted over the distinct texts of all rows and all fields (a
    message that comes a thousand times is no more natural than one that comes once). The thresholds come
    from what the natural texts reach under the second model. The driver receives one number per distinct 4-gram,
    ``SIZE ** 4`` at most, and a histogram of window sums.
    """
    spark, alphabet = df.sparkSession, _alphabet()

    def distinct_texts(columns: list[str]) -> DataFrame:
        return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("text")).where(F.length(F.trim("text")) > 0).distinct()

    natural = distinct_texts(list(prose_fields))

    def counted(counts: DataFrame) -> np.ndarray:
        pdf, out = counts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas(), np.zeros(SIZE**4, dtype=np.int64)
        out[pdf["gram"].to_numpy(dtype=np.int64)] = pdf["n"].to_numpy(dtype=np.int64)
        return out

    prose = counted(natural.mapInPandas(_count_natural, "gram int, n long"))
    first = spark.sparkContext.broadcast((_ratios(prose, alphabet), {k: list(FIRST_FLOORS) for k in KINDS}))
    prose += counted(distinct_texts(list(dict.fromkeys([*prose_fields, *fields]))).mapInPandas(_count_prose(first), "gram int, n long"))
    tables = _ratios(prose, alphabet)
    reached = natural.mapInPandas(_reached(spark.sparkContext.broadcast(tables)), "place int, at long, n long")
    return tables, _thresholds(reached.groupBy("place", "at").agg(F.sum("n").alias("n")).toPandas())


def broadcast_model(spark: SparkSession, model: tuple[dict[str, np.ndarray], dict[str, list[float]]]):
    """The model as a broadcast variable; its size is fixed by the alphabet."""
    return spark.sparkContext.broadcast(model)


def _find(shared, fields: tuple[str, ...]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for pdf in frames:
            parts = []
            for f in fields:
                kinds = pd.Series(scorer.kinds(list(pdf[f])), dtype=object)
                hit = kinds.notna().to_numpy()
                parts.append(pd.DataFrame({"id": pdf["_id"].to_numpy()[hit], "field_name": f, "residue": kinds.to_numpy()[hit]}))
            yield pd.concat(parts)

    return run


def find_residue(df: DataFrame, id_col: str = "result_id", fields: tuple[str, ...] = ("parsed_answer", "raw_judge_response"), prose_fields: tuple[str, ...] = ("question", "gold_answer")) -> DataFrame:
    """``id, field_name, residue`` of every field to be excluded; ``residue`` is template, filler or notice.

    Null, empty and blank fields hold no residue. Repeated rows give repeated results. Other columns are not read.
    """
    shared = broadcast_model(df.sparkSession, fit(df, fields, prose_fields))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), *[F.col(f) for f in fields])
    return rows.mapInPandas(_find(shared, fields), "id long, field_name string, residue string")


def exclude_residue(df: DataFrame, found: DataFrame, id_col: str = "result_id", fields: tuple[str, ...] = ("parsed_answer", "raw_judge_response")) -> DataFrame:
    """``df`` with the found fields set to null: the residue stays out of what follows."""
    marks = found.groupBy("id").agg(F.collect_set("field_name").alias("_residue")).withColumnRenamed("id", "_residue_id")
    joined = df.join(marks, df[id_col].cast("long") == F.col("_residue_id"), "left")
    clean = {f: F.when(F.array_contains("_residue", f), F.lit(None)).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(clean).drop("_residue", "_residue_id")


def found(df: DataFrame) -> DataFrame:
    """Distinct ``result_id, field_name``."""
    return find_residue(df).select(F.col("id").alias("result_id"), "field_name").distinct()
