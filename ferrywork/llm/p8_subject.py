"""Problem 8: the subject areas of each document.

One-versus-rest logistic classifiers over hashed words and word pairs judge sentences. They are trained from document
labels only: documents first, then their sentences, each given in turns to that label of its document which the last
classifiers find likeliest, or to none. A document has the subjects whose share of its sentences passes thresholds, one
to three of them. The thresholds are calibrated on labelled documents that the classifiers have not seen: the executors
judge all of them and the driver receives counts by share.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that the classifiers are trained on, and one labelled document in how many is kept from them.
LABELLED, HELD = 8000, 4
HASHED = 1 << 16
MOST = 3
#: Least probabilities of a sentence that are tried, bins of a share, and what holds without calibration.
LEAST, BINS, DEFAULT = (0.3, 0.4, 0.5, 0.6), 100, (0.3, 0.2)

_SENTENCE = re.compile(r"(?<=[.!?…])[\"”»)]*\s+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.strip()) if s]


class Hasher:
    """Hashed words and word pairs of sentences; remembers words."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}

    def __call__(self, sentence: str) -> list[int]:
        out = []
        for w in _WORD.findall(sentence.lower()):
            i = self.ids.get(w)
            if i is None:
                if len(self.ids) > 500_000:
                    self.ids.clear()
                i = self.ids[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out.append(i)
        return list({i % HASHED for i in out} | {(a * 1_000_003 + b) % HASHED for a, b in zip(out, out[1:], strict=False)})


class Sparse:
    """Rows of hashed features, each scaled to unit length."""

    def __init__(self, rows: list[list[int]]):
        n = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
        self.n = n
        self.ids = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(n.sum()))
        self.owner = np.repeat(np.arange(len(rows)), n)
        self.scale = (1.0 / np.sqrt(np.maximum(n, 1)))[self.owner].astype(np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        picked = w[self.ids] * self.scale[:, None]
        out = np.empty((len(self.n), w.shape[1]), dtype=np.float64)
        for c in range(w.shape[1]):
            out[:, c] = np.bincount(self.owner, weights=picked[:, c], minlength=len(self.n))
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.empty((HASHED, g.shape[1]))
        for c in range(g.shape[1]):
            out[:, c] = np.bincount(self.ids, weights=g[self.owner, c] * self.scale, minlength=HASHED)
        return out


def train(x: Sparse, y: np.ndarray, weight: np.ndarray, rounds: int = 40, rate: float = 0.3, l2: float = 1e-5, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of one-versus-rest logistic regressions with targets ``y`` in 0..1, by full-batch Adam."""
    k = y.shape[1]
    w, b = start or (np.zeros((HASHED, k), dtype=np.float32), np.full(k, -2.0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
    total = weight.sum() or 1.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
        g = (p - y) * weight[:, None] / total
        gw, gb = (x.back(g) + l2 * w).astype(np.float32), g.sum(axis=0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w = w - (rate * (m / a) / (np.sqrt(v / c) + 1e-7)).astype(np.float32)
        b = b - rate * (mb / a) / (np.sqrt(vb / c) + 1e-7)
    return w, b


def shares(best: np.ndarray, sure: np.ndarray, owner: np.ndarray, docs: int, k: int) -> np.ndarray:
    """The share of each document's sentences that are about each subject."""
    out = np.zeros((docs, k))
    np.add.at(out, (owner[sure], best[sure]), 1.0)
    return out / np.maximum(np.bincount(owner, minlength=docs), 1)[:, None]


def ranked(share: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The rank of each subject in its document, from 0: by share, then by mean probability."""
    return np.argsort(np.argsort(-(share + 1e-3 * mean), axis=1, kind="stable"), axis=1, kind="stable")


def binned(share: np.ndarray) -> np.ndarray:
    return np.floor(share * BINS + 1e-9).astype(np.int64)


def decide(share: np.ndarray, mean: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """One to three subjects of each document: the strongest, and those at or above their thresholds (in bins)."""
    rank = ranked(share, mean)
    return (rank == 0) | ((binned(share) >= threshold) & (rank < MOST))


def fit(docs: list[tuple[str, list[int]]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, biases) from texts with subject numbers."""
    hasher = Hasher()
    texts = [sentences(t) for t, _ in docs]
    flat = [s for ss in texts for s in ss]
    owner = np.repeat(np.arange(len(docs)), [len(ss) for ss in texts])
    if not flat:
        return np.zeros((HASHED, k), dtype=np.float32), np.zeros(k)
    kinds: dict[str, int] = {}
    kind_of = np.array([kinds.setdefault(s, len(kinds)) for s in flat])
    hashed = [hasher(s) for s in kinds]
    allowed = np.zeros((len(docs), k), dtype=bool)
    for i, (_, y) in enumerate(docs):
        allowed[i, y] = True
    # documents first
    w, b = train(Sparse([list({i for s in ss for i in hashed[kinds[s]]}) for ss in texts]), allowed.astype(float), np.ones(len(docs)), rounds=30)
    x = Sparse(hashed)
    n = np.bincount(kind_of, minlength=len(kinds)).astype(float)
    for step in range(3):
        score = (x.dot(w) + (b if step else 0))[kind_of]
        best = np.where(allowed[owner], score, -np.inf).argmax(axis=1)
        own = np.take_along_axis(score, best[:, None], axis=1)[:, 0]
        given = own > (-1.0 if step else score.mean(axis=1))
        target = np.zeros((len(kinds), k))
        np.add.at(target, (kind_of[given], best[given]), 1.0)
        w, b = train(x, target / n[:, None], np.sqrt(n), rounds=25)
    return w.astype(np.float32), b


def sentence_scores(texts: list[str], w: np.ndarray, b: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities by sentence and subject, the number of the text each sentence is of)."""
    parts = [sentences(t) for t in texts]
    kinds: dict[str, int] = {}
    kind_of = np.array([kinds.setdefault(s, len(kinds)) for ss in parts for s in ss], dtype=np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(ss) for ss in parts])
    if not len(kind_of):
        return np.zeros((0, w.shape[1])), owner
    return (1 / (1 + np.exp(-np.clip(Sparse([hasher(s) for s in kinds]).dot(w) + b, -30, 30))))[kind_of], owner


def document_means(p: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    sums = np.stack([np.bincount(owner, weights=p[:, c], minlength=docs) for c in range(p.shape[1])], axis=1)
    return sums / np.maximum(np.bincount(owner, minlength=docs), 1)[:, None]


def _count_shares(shared, k: int):
    """For each least probability, subject, place (strongest or not) and bin of the share: documents, and right ones.

    Cells below 0 count the documents that have a subject."""
    shape = (len(LEAST), k, 2, BINS + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = shared.value
        hasher, got, hit, truth = Hasher(), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for pdf in frames:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                p, owner = sentence_scores(list(part["text"]), w, b, hasher)
                if not len(p):
                    continue
                real = np.zeros((len(part), k), dtype=bool)
                for i, y in enumerate(part["subjects"]):
                    real[i, list(y)] = True
                truth += real.sum(axis=0)
                mean = document_means(p, owner, len(part))
                for j, least in enumerate(LEAST):
                    share = shares(p.argmax(axis=1), p.max(axis=1) >= least, owner, len(part), k)
                    rank = ranked(share, mean)
                    doc, c = np.nonzero(rank < MOST)
                    cell = (j, c, np.minimum(rank[doc, c], 1), binned(share[doc, c]))
                    np.add.at(got, cell, 1)
                    np.add.at(hit, cell, real[doc, c].astype(np.int64))
        at = np.flatnonzero(got)
        yield pd.DataFrame({"cell": np.concatenate((at, -1 - np.arange(k))), "got": np.concatenate((got.ravel()[at], truth)), "hit": np.concatenate((hit.ravel()[at], truth))})

    return run


def thresholds(counts: pd.DataFrame, k: int) -> tuple[float, np.ndarray]:
    """(least sentence probability, share threshold of each subject in bins) of the best F1 over the counted documents."""
    shape = (len(LEAST), k, 2, BINS + 1)
    none = (DEFAULT[0], np.full(k, round(DEFAULT[1] * BINS)))
    cell = counts["cell"].to_numpy(dtype=np.int64)
    truth = np.zeros(k)
    truth[-1 - cell[cell < 0]] = counts["got"].to_numpy()[cell < 0]
    if not truth.sum():
        return none
    tables = []
    for name in ("got", "hit"):
        flat = np.zeros(int(np.prod(shape)))
        flat[cell[cell >= 0]] = counts[name].to_numpy()[cell >= 0]
        x = flat.reshape(shape)
        # by threshold: all strongest subjects, and the others from the threshold's bin on
        tables.append(x[:, :, 0].sum(axis=-1)[..., None] + np.cumsum(x[:, :, 1, ::-1], axis=-1)[..., ::-1])
    got, hit = tables
    common = range(round(0.12 * BINS), round(0.32 * BINS))
    f1 = lambda h, g, n: 2 * h / max(1.0, g + n)
    _, j, t = max((round(f1(hit[j, :, t].sum(), got[j, :, t].sum(), truth.sum()), 4), -j, t) for j in range(len(LEAST)) for t in common)
    j = -j
    # each subject's own threshold, drawn to the common one where it has few labels
    near = range(t - round(0.06 * BINS), t + round(0.06 * BINS) + 1)
    own = [max((f1(hit[j, c, o], got[j, c, o], truth[c]) - 0.2 * abs(o - t) / BINS, o) for o in near)[1] for c in range(k)]
    return LEAST[j], np.array(own)


def _judge(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subjects, w, b, least, threshold = shared.value
        hasher, names = Hasher(), np.array(subjects, dtype=object)
        for pdf in frames:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                p, owner = sentence_scores(list(part["text"]), w, b, hasher)
                if not len(p):
                    continue
                share = shares(p.argmax(axis=1), p.max(axis=1) >= least, owner, len(part), len(names))
                got = decide(share, document_means(p, owner, len(part)), threshold)
                got[np.bincount(owner, minlength=len(part)) == 0] = False
                doc, subject = np.nonzero(got)
                yield pd.DataFrame({"doc_id": part["id"].to_numpy()[doc], "subject": names[subject], "share": share[doc, subject]})

    return run


def assign_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, doc_id: str = "doc_id", text_col: str = "text", subject_col: str = "subject", labelled: int = LABELLED
) -> DataFrame:
    """``doc_id, subject, share``: one to three rows for each document with a word in it.

    Null and blank texts get no row. ``labels`` holds ``doc_id, subject``; labels of unknown documents or subjects and
    null labels are left out, and a document labelled twice has both labels. Without any label, every document gets the
    alphabetically first subject with share 0. One labelled document in ``HELD``, by its hashed id, is kept from the
    classifiers; of the others at most ``labelled``, by the order of their hashed ids, train them. All labelled documents
    that do not train calibrate the thresholds, all documents are judged. The list of subjects is read whole.
    """
    spark = documents.sparkSession
    names = sorted({r[0] for r in subjects.select(subject_col).distinct().collect() if r[0]})
    number = {s: i for i, s in enumerate(names)}
    k = max(1, len(names))
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length(F.trim("text")) > 0)
    marks = labels.select(F.col(doc_id).cast("long").alias("label_id"), F.col(subject_col).alias("subject")).where(F.col("subject").isin(names))
    coded = F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("subject")) if number else F.lit(0)
    marks = marks.groupBy("label_id").agg(F.array_sort(F.collect_set(coded)).alias("subjects"))
    marked = docs.join(marks, docs["id"] == marks["label_id"]).select("id", "text", "subjects", F.xxhash64("id").alias("h"))
    held = F.pmod("h", F.lit(HELD)) == 0
    known = marked.where(~held).orderBy("h", "id", "text").limit(labelled).select("text", "subjects", "h").collect()
    classifiers = fit([(r["text"], r["subjects"]) for r in known], k)
    beyond = F.col("h") > known[-1]["h"] if len(known) == labelled and known else F.lit(False)
    counts = marked.where(held | beyond).select("text", "subjects").mapInPandas(_count_shares(spark.sparkContext.broadcast(classifiers), k), "cell long, got long, hit long")
    least, threshold = thresholds(counts.groupBy("cell").agg(F.sum("got").alias("got"), F.sum("hit").alias("hit")).toPandas(), k)
    shared = spark.sparkContext.broadcast((names or [""], *classifiers, least, threshold))
    return docs.mapInPandas(_judge(shared), "doc_id long, subject string, share double")


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct ``doc_id, subject``."""
    return assign_subjects(documents, labels, subjects).select("doc_id", "subject").distinct()
