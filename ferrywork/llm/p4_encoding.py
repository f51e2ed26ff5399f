"""Problem 4: text garbled by a wrong decoding.

Records whose two fields agree are mostly clean. Their words that hold other than ASCII signs are counted over the whole
table; a word that some chain turns into a far commoner one is dropped (both fields can be damaged alike), and the rest
train a smoothed character trigram model (Witten-Bell interpolation). Every
unknown word of any field is put through every chain of encode and decode steps; the chain with the greatest gain in
log-likelihood over the field's words is accepted where the gain exceeds a margin validated on held-out clean words.

What no chain can bring back is lossy: a replacement character, a question mark where orthography has none, or a word
with question marks in place of the signs of a far commoner word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte code pages that texts are wrongly decoded with. Fixed values.
CODE_PAGES = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r")
#: A word counts for the model if it makes up at least this share of the clean words; at most 1 / share words pass.
MIN_SHARE = 5e-6
#: The margin is at least this (nats), whatever the held-out words say.
MIN_MARGIN = 4.0
LOST = "�"

#: Written-out numbers of single bytes, as some tools leave them.
_ESCAPE = re.compile(r"&#(?:x([0-9A-Fa-f]{2})|(\d{3}));|=([89A-F][0-9A-F])|%([89A-Fa-f][0-9A-Fa-f])|\\x([89a-f][0-9a-f])")
_TOKEN = re.compile("[^ \t\n\r]*(?:[^\x00-\x7f]|&#x?[0-9A-Fa-f]+;|=[89A-F][0-9A-F]|%[89A-Fa-f][0-9A-Fa-f]|\\\\x[89a-f])[^ \t\n\r]*")
_MARKED = re.compile(r"[^ \t\n\r]*\?[^ \t\n\r]*")
_ODD = "[^\\x00-\\x7F]|[?=%]|&#|\\\\x"
#: A word is a damaged form of another if that one is so many times as common in the clean records; the second number
#: holds for a page read as another page, where any sign gives some other.
DOMINANCE, PAGE_DOMINANCE = 3, 30


def _decode_table(page: str) -> list[str]:
    """The sign of each byte; a byte the page leaves undefined keeps its number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


_DECODE = {p: _decode_table(p) for p in CODE_PAGES}
_ENCODE = {p: {c: b for b, c in reversed(list(enumerate(t)))} for p, t in _DECODE.items()}


def _encode(text: str, page: str) -> bytes | None:
    table = _ENCODE[page]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _utf8(raw: bytes | None) -> str | None:
    try:
        return raw.decode("utf-8") if raw is not None else None
    except UnicodeDecodeError:
        return None


def _unescape(token: str) -> str | None:
    if not _ESCAPE.search(token):
        return None
    return _ESCAPE.sub(lambda m: chr(int(m[2])) if m[2] else chr(int(m[1] or m[3] or m[4] or m[5], 16)), token)


def chains(token: str) -> Iterator[tuple[str, str]]:
    """(chain, result) of every chain that can be applied to the token and changes it.

    A chain undoes, last step first: a page read as another page, UTF-8 read as a page, that twice, or any of these
    with the bytes written out as numbers.
    """
    plain = _unescape(token)
    if plain is not None:
        yield "escape", plain
        for chain, result in chains(plain):
            yield f"escape>{chain}", result
        return
    for page in CODE_PAGES:
        raw = _encode(token, page)
        if raw is None:
            continue
        once = _utf8(raw)
        if once is not None and once != token:
            yield f"{page}>utf-8", once
            if not once.isascii():
                for second in CODE_PAGES:
                    twice = _utf8(_encode(once, second))
                    if twice is not None and twice != once:
                        yield f"{page}>utf-8>{second}>utf-8", twice
            continue  # a sequence that is sound UTF-8 is no chance product of two pages
        for other in CODE_PAGES:
            if other != page:
                table = _DECODE[other]
                text = "".join([table[b] for b in raw])
                if text != token:
                    yield f"{page}>{other}", text


class CharModel:
    """Character trigrams with Witten-Bell interpolation down to a uniform floor; plain dictionaries, so it ships."""

    FLOOR = 1 / 20_000

    def __init__(self, counts: dict[str, int]):
        self.follow: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for token, n in counts.items():
            s = "^^" + token + "$"
            for i in range(2, len(s)):
                c = s[i]
                self.follow[s[i - 2 : i]][c] += n
                self.follow[s[i - 1]][c] += n
                self.follow[""][c] += n
        self.total = {h: sum(f.values()) for h, f in self.follow.items()}

    def prob(self, c: str, history: str) -> float:
        p = self.FLOOR
        for h in ("", history[1:], history):
            f = self.follow.get(h)
            if f:
                n, kinds = self.total[h], len(f)
                p = (f.get(c, 0) + kinds * p) / (n + kinds)
        return p

    def score(self, token: str) -> float:
        s = "^^" + token + "$"
        return sum(math.log(self.prob(s[i], s[i - 2 : i])) for i in range(2, len(s)))


def _best(model: CharModel, token: str) -> list[tuple[str, float, str]]:
    """(chain, gain, result) of the chains that make the token likelier."""
    base, out = model.score(token), []
    for chain, result in chains(token):
        if any(0x7F <= ord(c) < 0xA0 or c == LOST for c in result):
            continue
        gain = model.score(result) - base
        if gain > 0:
            out.append((chain, gain, result))
    return out


def family(chain: str) -> str:
    """``bytes`` for chains that pass through UTF-8 or written-out bytes, ``pages`` for a page read as another page."""
    return "bytes" if "utf-8" in chain or "escape" in chain else "pages"


def fit(tokens: dict[str, int]) -> tuple[dict[str, int], dict[str, float]]:
    """The clean words with their counts, and the validated margin of each family of chains.

    Words that a chain turns into a far commoner one are dropped first, then those that a chain of bytes turns into a
    word of far commoner signs. Each half of the rest is then scored by a model of the other half: a margin exceeds
    99.9 % of the gains that its family finds there.
    """
    ratio = {"bytes": DOMINANCE, "pages": PAGE_DOMINANCE}
    kept = {t: n for t, n in tokens.items() if LOST not in t and all(tokens.get(y, 0) < ratio[family(c)] * n for c, y in chains(t))}
    signs: Counter = Counter()
    for t, n in kept.items():
        for c in set(t):
            if not c.isascii():
                signs[c] += n
    rarest = lambda t: min((signs[c] for c in t if not c.isascii()), default=0)
    kept = {t: n for t, n in kept.items() if all(family(c) == "pages" or y.isascii() or rarest(y) <= DOMINANCE * rarest(t) for c, y in chains(t))}
    halves = [{t: n for t, n in kept.items() if sum(map(ord, t)) % 2 == k} for k in (0, 1)]
    gains: dict[str, list[tuple[float, int]]] = {"bytes": [], "pages": []}
    for mine, other in (halves, halves[::-1]):
        m = CharModel(other)
        for t, n in mine.items():
            best = {"bytes": 0.0, "pages": 0.0}
            for c, g, _ in _best(m, t):
                best[family(c)] = max(best[family(c)], g)
            for f, g in best.items():
                gains[f].append((g, n))
    margins = {}
    for f, found in gains.items():
        seen, bound = 0, 0.001 * sum(n for _, n in found)
        margins[f] = MIN_MARGIN
        for g, n in sorted(found, reverse=True):
            seen += n
            if seen > bound:
                margins[f] = max(MIN_MARGIN, g)
                break
    return kept, margins


def _class(c: str) -> str:
    if c == "":
        return "e"
    if c in " \t\r\n\xa0 ":
        return "s"
    return "d" if c.isdigit() else "l" if c.isalpha() else "q" if c == "?" else "p"


def mark_contexts(text: str) -> Iterator[tuple[str, int]]:
    """(context, place) of each question mark: the classes before and behind it, and what follows the white space."""
    i = text.find("?")
    while i >= 0:
        before, after = _class(text[i - 1 : i] if i else ""), _class(text[i + 1 : i + 2])
        beyond = ""
        if after == "s":
            rest = text[i + 1 :].lstrip()[:1]
            beyond = "e" if not rest else "n" if "\n" in text[i + 1 : i + 3] else "a" if rest.islower() else "A" if rest.isupper() else _class(rest)
        yield before + after + beyond, i
        i = text.find("?", i + 1)


#: Contexts in which orthography has a question mark. Fixed values.
_USUAL = frozenset("lsA lse lsn lsp lsd lsl le lp pe psA pse psn pp dsA dse dsn de dp ssA sse ssn se".split())


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for pdf in frames:
        for t in pdf["text"]:
            total.update(_TOKEN.findall(t))
            if "?" in t:
                total.update("? " + w for w in _MARKED.findall(t))
        if len(total) > 200_000:  # emit and start anew: the counter stays small, the sum is the same
            yield pd.DataFrame({"token": list(total), "n": list(total.values())})
            total = Counter()
    yield pd.DataFrame({"token": list(total), "n": list(total.values())}, columns=["token", "n"]).astype({"token": object, "n": "int64"})


def clean_counts(df: DataFrame, text_col: str, context_col: str) -> DataFrame:
    """``token, n`` over all records whose fields agree."""
    rows = df.select(F.col(text_col).alias("text"), F.col(context_col).alias("ctx"))
    rows = rows.where(F.col("text").rlike(_ODD) & F.expr("endswith(ctx, text)") & (F.char_length("text") > 0))
    return rows.select("text").mapInPandas(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Mender:
    """Judges fields against the clean words; one per task."""

    def __init__(self, known: dict[str, int], marked: dict[str, int], margin: dict[str, float]):
        self.known, self.margin, self.model, self.marked = known, margin, CharModel(known), marked
        self.memo: dict[str, list[tuple[str, float, str]]] = {}
        self.shapes: dict[str, int] = defaultdict(int)
        for t, n in known.items():
            self.shapes["".join(c if c.isascii() else "?" for c in t)] += n

    def options(self, token: str) -> list[tuple[str, float, str]]:
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[token] = _best(self.model, token)
        return found

    def lost(self, text: str) -> bool:
        """Whether a sign of the text was replaced by one that does not tell which it was."""
        if LOST in text:
            return True
        if "?" not in text:
            return False
        if any(c not in _USUAL for c, _ in mark_contexts(text)):
            return True
        return any(w != "?" and self.shapes.get(w, 0) > DOMINANCE * self.marked.get(w, 0) for w in _MARKED.findall(text))

    def mend(self, text: str) -> tuple[str | None, str]:
        """(damage or None, the text with all chains undone)."""
        lossy = self.lost(text)
        fixes: dict[str, str] = {}
        unknown = Counter(t for t in _TOKEN.findall(text) if t not in self.known)
        while unknown:
            gain: dict[str, float] = defaultdict(float)
            for t, n in unknown.items():
                for chain, g, _ in self.options(t):
                    gain[chain] += g * n
            if not gain:
                break
            gain = {c: g for c, g in gain.items() if g > self.margin[family(c)]}
            if not gain:
                break
            chain = max(gain, key=lambda c: (gain[c], -len(c), c))
            for t in list(unknown):
                for c, _, result in self.options(t):
                    if c == chain:
                        fixes[t] = result
                        del unknown[t]
                        break
        if fixes:
            text = _TOKEN.sub(lambda m: fixes.get(m.group(), m.group()), text)
        return ("lossy" if lossy else "restorable" if fixes else None), text


def _judge(known: dict[str, int], marked: dict[str, int], margin: dict[str, float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mender = Mender(known, marked, margin)
        for pdf in frames:
            out = []
            for i, text, ctx in zip(pdf["id"], pdf["text"], pdf["ctx"], strict=True):
                damage, mended = mender.mend(text) if text else (None, text)
                if damage:
                    out.append((i, "text", damage, mended))
                if ctx:
                    if text and ctx.endswith(text):
                        head, new = mender.mend(ctx[: len(ctx) - len(text)])
                        new += mended
                        damage = "lossy" if "lossy" in (head, damage) else head or damage
                    else:
                        damage, new = mender.mend(ctx)
                    if damage:
                        out.append((i, "contextualized_text", damage, new))
            yield pd.DataFrame(out, columns=["id", "field_name", "damage", "restored"], dtype=object)

    return run


def restore_encoding(
    df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", context_col: str = "contextualized_text", min_share: float = MIN_SHARE
) -> DataFrame:
    """``id, field_name, damage, restored`` of every damaged field; field names are ``text`` and ``contextualized_text``.

    ``damage`` is ``lossy`` or ``restorable``; ``restored`` has every undone chain either way. Null and empty fields are
    sound, as are all fields of a table without clean records that hold non-ASCII signs. Repeated rows give repeated
    results; other columns are not read. The model holds at most ``1 / min_share`` words, whatever the table's size.
    """
    counts = clean_counts(df, text_col, context_col)
    # one pass: what is seldom is cut against the total, so the driver holds at most 1 / min_share words
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * min_share).select("token", "n").collect()
    marked = {r["token"][2:]: r["n"] for r in rows if r["token"].startswith("? ")}
    known, margin = fit({r["token"]: r["n"] for r in rows if not r["token"].startswith("? ")})
    fields = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(context_col).alias("ctx"))
    fields = fields.where(F.col("text").rlike(_ODD) | F.col("ctx").rlike(_ODD))
    return fields.mapInPandas(_judge(known, marked, margin), "id string, field_name string, damage string, restored string")


def found(df: DataFrame) -> DataFrame:
    """Distinct ``chunk_id, field_name, damage``."""
    return restore_encoding(df).select(F.col("id").alias("chunk_id"), "field_name", "damage").distinct()
