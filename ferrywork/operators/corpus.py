"""From pages to linked chunks: sections, filtering, packing, deduplication, links, summaries, validation."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.functions import tags, text
from ferrywork.functions.answers import blank, strip
from ferrywork.runtime import cut


def pack(items: Column, most: int, overlap: int) -> Column:
    """Greedy packing of sentences (array<string>) into texts of at most ``most`` tokens, as array<array<string>>.

    On overflow the pack is closed and its last sentences of together at most ``overlap`` tokens are carried over, unless
    the carry and the next sentence would overflow again. A sentence over the limit is a pack of its own.
    """
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + text.token_count(x))
    empty = F.array().cast("array<string>")
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"), F.lit(0).alias("n"))

    def carry(xs: Column) -> Column:
        if overlap < 1:  # no sentence has fewer than one token
            return empty
        zero = F.struct(empty.alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        back = F.aggregate(
            F.reverse(xs),
            zero,
            lambda a, x: F.when(a["full"] | (a["n"] + text.token_count(x) > overlap), F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
                F.struct(F.concat(F.array(x), a["kept"]).alias("kept"), (a["n"] + text.token_count(x)).alias("n"), F.lit(False).alias("full"))
            ),
        )
        return back["kept"]

    def step(a: Column, x: Column) -> Column:
        mine = text.token_count(x)
        over = (F.size(a["open"]) > 0) & (a["n"] + mine > most)
        fits = lambda kept: F.when(size(kept) + mine > most, empty).otherwise(kept)
        closed = lambda kept: F.struct(F.array_append(a["done"], a["open"]).alias("done"), F.array_append(kept, x).alias("open"), (size(kept) + mine).alias("n"))
        after = text.let(text.let(carry(a["open"]), fits), closed)
        return F.when(over, after).otherwise(F.struct(a["done"].alias("done"), F.array_append(a["open"], x).alias("open"), (a["n"] + mine).alias("n")))

    return text.let(F.aggregate(items, zero, step), lambda out: F.when(F.size(out["open"]) > 0, F.array_append(out["done"], out["open"])).otherwise(out["done"]))


def split_overlong(items: Column, most: int) -> Column:
    """Sentences over the limit cut into runs of words that fit; the others as they are."""
    one = lambda s: F.transform(pack(F.split(s, r"\s+"), most, 0), lambda ws: F.array_join(ws, " "))
    return F.flatten(F.transform(items, lambda s: F.when(text.token_count(s) > most, one(s)).otherwise(F.array(s))))


#: Documents of more pages are cut into blocks at clean headings, about one in so many pages; each block is walked alone.
BLOCK_PAGES, BLOCK_RATE = 2000, 256
#: Signs of kept sections beyond which bibliographies and lists of contributors end a page.
SETTLED = 1200
_HEADING, _ENTRY, _END, _NUMBERED, _TOC, _BODY = (1 << i for i in range(6))


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_num, tie, lines, codes, front, contents``: the cleaned lines of each page and what each line is.

    Every predicate is computed once a line, in the JVM. ``tie`` orders pages of one number. The result is written to the
    checkpoint folder: several steps read it, and a filter pushed down through the steps of cleaning would repeat them.
    """
    rows = text.clean(pages.select("doc_id", F.coalesce("page_num", F.lit(0)).cast("int").alias("page_num"), "text"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("lines", F.filter(F.split("cleaned", "\n"), lambda x: strip(x) != ""))
    kinds = {"_h": text.heading_form, "_r": text.reference_line, "_e": text.endmatter_line, "_t": text.toc_line, "_i": text.imprint_line, "_w": text.wordy_line}
    rows = rows.withColumns({name: F.transform("lines", test) for name, test in kinds.items()})
    bit = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    flag = lambda name, i: F.get(F.col(name), i)

    def code(x: Column, i: Column) -> Column:
        other = flag("_r", i) | flag("_t", i)
        return (
            bit(flag("_h", i) & ~other, _HEADING) + bit(flag("_r", i), _ENTRY) + bit(flag("_e", i), _END) + bit(strip(x).rlike(r"^\d{1,3}\.\s+"), _NUMBERED) + bit(flag("_t", i), _TOC)
            + bit(flag("_w", i) & ~other & ~flag("_i", i), _BODY)
        )

    toc = F.size(F.filter(F.slice("_t", 1, 20), lambda f: f))
    tails = F.size(F.filter(F.slice("lines", 1, 20), lambda x: strip(x).rlike(r"\s\d{1,3}$")))
    contents = (F.size("lines") >= 6) & ((toc >= 5) | ((toc >= 3) & (tails >= 8)))
    return cut(rows.select("doc_id", "page_num", "tie", "lines", F.transform("lines", code).alias("codes"), text.front_matter_page(F.col("cleaned")).alias("front"), contents.alias("contents")))


def _blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with ``block``: documents of many pages fall into blocks that begin with a heading.

    A page may be cut at its first heading behind another line, if it holds no bibliography, contributors or contents: at
    such a line the walk has just closed a section, so its state is the heading alone. Which of these pages are cut is
    decided by their hash, so no page has to know the others; a document's cuts are one small array.
    """
    bare = lambda x: x.bitwiseAND(F.lit(_ENTRY | _END)) == 0
    is_heading = lambda x: x.bitwiseAND(F.lit(_HEADING)) > 0
    at = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size("codes") - 1, F.lit(1))), lambda i: F.coalesce(is_heading(F.get(F.col("codes"), i)) & ~is_heading(F.get(F.col("codes"), i - 1)), F.lit(False))), F.lit(0))
    clean = F.forall("codes", bare) & ~F.col("contents") & ~F.col("front")
    many = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_PAGES).select("doc_id")
    chosen = lines.where(clean & at.isNotNull() & (F.pmod(F.xxhash64("tie", "page_num"), F.lit(BLOCK_RATE)) == 0)).join(many, "doc_id")
    cuts = chosen.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("page_num", "tie"))).alias("cuts"))
    me = F.struct("page_num", "tie")
    rows = lines.join(cuts, "doc_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<page_num:int,tie:bigint>>")))
    block = F.size(F.filter("cuts", lambda c: c <= me))
    part = lambda low, n, b: F.struct(F.slice("lines", low, n).alias("lines"), F.slice("codes", low, n).alias("codes"), b.alias("block"))
    whole = F.array(part(F.lit(1), F.size("lines"), block))
    halves = F.array(part(F.lit(1), at, block - 1), part(at + 1, F.size("lines") - at, block))
    rows = rows.withColumn("p", F.explode(F.when(F.array_contains("cuts", me), halves).otherwise(whole)))
    return rows.select("doc_id", "page_num", "tie", "front", "contents", F.size("cuts").alias("n_cuts"), "p.lines", "p.codes", "p.block")


def _heavy(codes: Sequence[int]) -> bool:
    """Whether bibliography fills the first sixteen of at least six lines (by their codes)."""
    sample = codes[:16]
    if len(sample) < 6:
        return False
    hits, numbered = sum(c & _ENTRY > 0 for c in sample), sum(c & _NUMBERED > 0 for c in sample)
    return hits >= 6 or numbered >= 8 and hits >= max(5, numbered - 2)


_STARTS = tuple(re.compile(p) for p in text.INLINE_STARTS)
_DROPPED = tuple(re.compile(p) for p in text.DROP_HEADINGS)
_PREAMBLE, _LEAST = text.PREAMBLE_WORDS, schema.MIN_SECTION_CHARS


def _without_preamble(lines: list[str], codes: list[int]) -> tuple[str, list[int]]:
    """The body of a section behind its preamble, and the codes of the lines left (as ``text.trim_preamble``)."""
    body = "\n".join(lines).strip()
    low = body[:2000].lower()
    if sum(low.count(w) for w in _PREAMBLE) < 2:
        return body, codes
    found = [m.start() for m in (p.search(body[:4000]) for p in _STARTS) if m and m.start() > 40]
    if found:
        rest = body[min(found) :].lstrip()
        kept = codes[len(codes) - rest.count("\n") - 1 :]
        kept = [0, *kept[1:]]  # the first line is cut: it begins with a label
    else:
        first = next((i for i, c in enumerate(codes[:80]) if c & _BODY and not c & _TOC), None)
        if sum(c & _TOC > 0 for c in codes[:60]) < 5 or first is None:
            return body, codes
        rest, kept = "\n".join(lines[first:]).strip(), codes[first:]
    return (rest, kept) if len(rest) >= _LEAST else (body, codes)


def _title(line: str) -> str:
    """A heading without letter spacing, outer signs and what exceeds 160 signs."""
    t = line.strip()
    if re.fullmatch(r"(?:[A-Z]\s+){4,}[A-Z]", t):
        joined = t.replace(" ", "")
        return "ABSTRACT" if joined.upper() == "ABSTRACT" else joined.title()
    return re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r"\s{2,}", " ", t))[:160].strip()


class Walk:
    """The state of one walk through the lines of a document (or of a block of it that begins with a heading)."""

    def __init__(self, opening: bool):
        self.out: list[tuple[str, str, int, int]] = []
        self.title, self.lines, self.codes, self.held = "Introduction", [], [], 0
        self.first = self.last = None
        self.content, self.run, self.fresh = (0, 0, True) if opening else (SETTLED + 1, 0, False)
        self.expects_heading = not opening

    def close(self) -> None:
        if self.lines:
            body, codes = _without_preamble(self.lines, self.codes)
            title = _title(self.title)
            if not title or any(p.match(title) for p in _DROPPED):
                title = "Section" if len(body) >= 240 else ""
            heavy = len(codes) >= 5 and sum(c & _ENTRY > 0 for c in codes[:12]) >= 4
            if title and len(body) > _LEAST and not heavy:
                self.content += len(body)
                self.fresh = False
                self.out.append((title, body, self.first, self.last))
        self.lines, self.codes, self.held = [], [], 0

    def settled(self) -> bool:
        return self.content + self.held > SETTLED

    def page(self, number: int, lines: Sequence[str], codes: Sequence[int], front: bool, contents: bool) -> None:
        if self.expects_heading and lines:
            self.expects_heading, self.title, self.first, self.last = False, lines[0].strip(), number, number
            lines, codes = lines[1:], codes[1:]
        if not len(lines) or contents or front and self.fresh and not self.lines:
            return
        if self.settled() and _heavy(codes):
            self.close()
            self.run = 0
            return
        for i, (line, c) in enumerate(zip(lines, codes, strict=True)):
            self.run = self.run + 1 if c & _ENTRY else 0
            bibliography = self.settled() and (self.run >= 3 or _heavy(codes[i : i + 12]))
            if bibliography or c & _END and self.content > SETTLED:
                self.close()
                self.run = 0 if bibliography else self.run
                return
            if c & _HEADING and self.lines:
                self.close()
                self.title, self.first, self.last = line.strip(), number, number
            else:
                self.lines.append(line)
                self.codes.append(c)
                self.held += len(line)
                self.first = number if self.first is None else self.first
                self.last = number


def sections(pages: DataFrame) -> DataFrame:
    """``doc_id, section_id, title, heading_path, text, page_start, page_end``; ``pages``: ``doc_id, page_num, text``.

    Pages are cleaned and their lines classed in the JVM; the lines then pass one state machine in order. Title and
    imprint pages before any text and pages of contents are passed over; a heading opens a section where the open one has
    lines; behind 1,200 signs a bibliography ends its page, as does a list of contributors. Sections of at most 80 signs
    (240 without a usable title) and bibliographies are left out, and a document without any section is one. One group is
    one document, or one block of a document of more than ``BLOCK_PAGES`` pages. A null page number is 0; null and blank
    pages hold nothing.
    """
    cols = ["doc_id", "block", "seq", "title", "text", "page_start", "page_end"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_num", "tie"])
        doc, block = pdf["doc_id"].iloc[0], int(pdf["block"].iloc[0])
        w = Walk(block == 0)
        for number, lines, codes, front, contents in zip(pdf["page_num"], pdf["lines"], pdf["codes"], pdf["front"], pdf["contents"], strict=True):
            w.page(int(number), list(lines), [int(c) for c in codes], bool(front), bool(contents))
        w.close()
        if not w.out and not pdf["n_cuts"].iloc[0]:
            lines, codes = [x for xs in pdf["lines"] for x in xs], [int(c) for cs in pdf["codes"] for c in cs]
            body, codes = _without_preamble(lines, codes)
            if body and not (len(codes) >= 5 and sum(c & _ENTRY > 0 for c in codes[:12]) >= 4):
                w.out.append(("Full Document", body, int(pdf["page_num"].iloc[0]), int(pdf["page_num"].iloc[-1])))
        first = int(pdf["page_num"].iloc[0])
        return pd.DataFrame([(doc, block, i, t, b, first if a is None else a, first if z is None else z) for i, (t, b, a, z) in enumerate(w.out)], columns=cols)

    types = dict(pages.dtypes)
    found = _blocks(page_lines(pages)).groupBy("doc_id", "block").applyInPandas(walk, f"doc_id {types['doc_id']}, block int, seq int, title string, text string, page_start int, page_end int")
    return numbered_sections(cut(found), ["block", "seq"]).select("doc_id", "section_id", "title", F.col("title").alias("heading_path"), "text", "page_start", "page_end")


def numbered_sections(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``section_id`` SEC_001, SEC_002, ... by document. Only the keys pass the window, not the texts."""
    keys = rows.select("doc_id", *order).withColumn("section_id", F.format_string("SEC_%03d", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))))
    return rows.drop("section_id").join(keys.withColumnsRenamed({c: f"_{c}" for c in order}), (rows["doc_id"] == keys["doc_id"]) & functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in order])).drop(keys["doc_id"]).drop(*[f"_{c}" for c in order])


def keep_section(title: Column, body: Column, hints: Column, family: Column, source_type: Column | None = None) -> Column:
    """Whether a section is worth keeping.

    Long enough, no dropped title, no short text of low value, no table without a signal of the document's hints (two for
    one in the title, one for one in the text), no study table. Then by the kind of document: dataset papers, human
    factors, guidelines and reviews keep sections by title, by words or by signal; other documents keep all.
    """
    title, body, source = blank(title), blank(body), blank(source_type if source_type is not None else F.lit(""))
    low = F.lower(body)
    signal = F.aggregate(F.coalesce(hints, F.array().cast("array<string>")), F.lit(0), lambda a, h: a + F.when(F.contains(F.lower(title), F.lower(h)), 2).when(F.contains(low, F.lower(h)), 1).otherwise(0))
    long = F.length(strip(body)) >= schema.MIN_SECTION_CHARS
    bad = title.rlike(text.DROP_TITLES) | (body.rlike(text.LOW_VALUE) & (F.length(strip(body)) < 400)) | (text.table_block(body) & (signal < 3)) | text.study_table(body)
    dataset = ~text.author_block(body) & (title.rlike(text.KEEP_DATASET) | F.contains(low, F.lit("critical view of safety")) | F.contains(low, F.lit("annotation")) | ((signal >= 2) & (F.length(strip(body)) >= 220)))
    factors = title.rlike(r"(?i)\b(?:introduction|methods?|results?|discussion|conclusions?|summary)\b") | body.rlike(r"(?i)\b(?:illusion|misidentification|misperception|human factors?|error|prevention|rule)\b") | (signal >= 2)
    guideline = title.rlike(r"(?i)\b(?:recommendation|summary of evidence|background|question|step|conclusion)\b") | body.rlike(r"(?i)\b(?:recommend|we suggest|we recommend|safe steps?|bailout|critical view of safety)\b") | (signal >= 2)
    review = title.rlike(r"(?i)\b(?:introduction|discussion|conclusion|results|methods?|case presentation)\b") | (signal >= 1)
    by_kind = F.when(family == "dataset_paper", dataset).when(family == "human_factors", factors).when(source.isin("guideline", "complication_guideline"), guideline).when(source.isin("anatomy_review", "clinical_review", "bailout_review"), review).otherwise(True)
    return long & ~bad & F.coalesce(by_kind, F.lit(True))


def filter_sections(secs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sections of documents of the manifest with sanitised texts and inferred titles, those worth keeping, numbered anew.

    A missing title, "Section", and an "Introduction" whose text does not begin like one are inferred from the text.
    """
    meta = manifest.select("doc_id", F.col("doc_family").alias("_family"), F.col("source_type").alias("_source"), F.col("tags_hint").alias("_hints"))
    rows = text.sanitized(secs.join(meta, "doc_id"), "text", "_t")
    rows = rows.withColumn("text", F.when(F.col("_family") == "dataset_paper", text.trim_dataset_front(F.col("_t"))).otherwise(F.col("_t"))).withColumn("_title", text.canonical_heading(F.col("title"))).withColumn("_s", text.title_source(F.col("text")))
    vague = (F.col("_title") == "") | (F.col("_title") == "Section") | ((F.col("_title") == "Introduction") & ~F.col("text").rlike(r"(?i)^(?:Introduction|Background|Abstract)\b"))
    named = F.when(vague, text.title_of(F.col("_s"), F.when(F.col("_title") == "", "Section").otherwise(F.col("_title")))).otherwise(F.col("_title"))
    path = text.canonical_heading(F.col("heading_path"))
    rows = rows.withColumn("title", F.when(named == "", "Section").otherwise(named)).withColumn("heading_path", F.when(path == "", F.col("title")).otherwise(path)).withColumnRenamed("section_id", "_old")
    # a filter pushed down would repeat all steps above for each of its uses of the text
    rows = cut(rows.select("doc_id", "_old", "title", "heading_path", "text", "page_start", "page_end", "_hints", "_family", "_source"))
    kept = rows.where(keep_section(F.col("title"), F.col("text"), F.col("_hints"), F.col("_family"), F.col("_source")))
    return numbered_sections(kept, ["_old"]).select("doc_id", "section_id", "title", "heading_path", "text", "page_start", "page_end")


#: How each chunk strategy of a manifest packs. Fixed values; any other name packs by section.
STRATEGIES = {"paragraph": "paragraph", "landmark_review": "paragraph", "lexicon": "lexicon"}
CHUNKS = "array<struct<level:string,idx:int,text:string,parent:int>>"


def _packed(sents: Column, most: int, overlap: int) -> Column:
    """The packs of sentences as texts."""
    return F.transform(pack(split_overlong(sents, most), most, overlap), lambda p: F.array_join(p, " "))


def _long_enough(packs: Column) -> Column:
    """array<struct<idx, text>> of the packs of at least ``MIN_TOKENS`` tokens, with their places."""
    return F.filter(F.transform(packs, lambda t, i: F.struct(i.cast("int").alias("idx"), t.alias("text"))), lambda x: text.token_count(x["text"]) >= schema.MIN_TOKENS)


def _piece(level: str, idx: Column, body: Column, parent: Column | None = None) -> Column:
    return F.struct(F.lit(level).alias("level"), idx.cast("int").alias("idx"), body.alias("text"), (parent if parent is not None else F.lit(None)).cast("int").alias("parent"))


def _by_section(parents: Column, children: Column) -> Column:
    """The chunks of a section from its packs: parents, then children with the parent that shares most sentences.

    Without a long enough parent the longest child pack is one; a child that shares no sentence with any parent is given
    one of its own text, which later children may share. A fold over the few packs of one section.
    """
    longest = F.array_max(F.transform(children, lambda t, i: F.struct(text.token_count(t).alias("n"), (-i).alias("i"), t.alias("t"))))["t"]
    kept = text.let(_long_enough(parents), lambda k: F.when((F.size(k) == 0) & (F.size(children) > 0), F.array(F.struct(F.lit(0).alias("idx"), longest.alias("text")))).otherwise(k))
    known = F.transform(kept, lambda p: F.struct(p["idx"].cast("int").alias("idx"), p["text"].alias("text"), text.sentences(p["text"]).alias("s")))
    zero = F.struct(known.alias("parents"), F.array().cast("array<struct<idx:int,text:string,parent:int>>").alias("children"))

    def step(a: Column, c: Column) -> Column:
        def placed(mine: Column) -> Column:
            best = F.array_max(F.transform(a["parents"], lambda p, i: F.struct(F.size(F.array_intersect(mine, p["s"])).alias("n"), (-i).alias("i"), p["idx"].alias("idx"))))
            own = F.coalesce(F.array_max(F.transform(a["parents"], lambda p: p["idx"])), F.lit(-1)) + 1
            child = lambda idx: F.array_append(a["children"], F.struct(c["idx"].alias("idx"), c["text"].alias("text"), idx.alias("parent")))
            alone = lambda o: F.struct(F.array_append(a["parents"], F.struct(o.alias("idx"), c["text"].alias("text"), mine.alias("s"))).alias("parents"), child(o).alias("children"))
            shared = lambda b: F.coalesce(b["n"], F.lit(0)) > 0
            return text.let(best, lambda b: F.when(shared(b), F.struct(a["parents"].alias("parents"), child(b["idx"]).alias("children"))).otherwise(text.let(own, alone)))

        return text.let(text.sentences(c["text"]), placed)

    done = F.aggregate(_long_enough(children), zero, step)
    return text.let(done, lambda d: F.concat(F.transform(d["parents"], lambda p: _piece("parent", p["idx"], p["text"])), F.transform(d["children"], lambda c: _piece("child", c["idx"], c["text"], c["parent"]))))


def chunks_of_sections(sections_df: DataFrame, strategy: Column | None = None) -> DataFrame:
    """``doc_id, section_id, seq, level, idx, text, parent, token_count`` of each section; ``seq`` is the order.

    By section: parents of 800 tokens (80 carried over) and children of 250 (30), each with its parent's ``idx``. By
    paragraph: the same within each paragraph of at least 30 tokens, unlinked. ``lexicon`` packs lines into children of
    400 tokens and makes no parents. Chunks below 30 tokens are left out. All work stays within the row of a section.
    """
    kind = strategy if strategy is not None else F.lit("section_aware")
    none = F.lit(None).cast(CHUNKS)

    def paragraph(p: Column) -> Column:
        def both(inner: Column) -> Column:
            parents, children = _packed(inner, schema.PARENT_TOKENS, schema.PARENT_OVERLAP), _packed(inner, schema.CHILD_TOKENS, schema.CHILD_OVERLAP)
            return F.concat(F.transform(_long_enough(parents), lambda x: _piece("parent", x["idx"], x["text"])), F.transform(_long_enough(children), lambda x: _piece("child", x["idx"], x["text"])))

        return text.let(text.sentences(p), both)

    paragraphs = F.filter(F.transform(F.split(blank(F.col("text")), r"\n\s*\n"), strip), lambda p: text.token_count(p) >= schema.MIN_TOKENS)
    lines = F.transform(pack(text.lines_of(F.col("text")), schema.LEXICON_TOKENS, 0), lambda p: F.array_join(p, "\n"))
    rows = sections_df.withColumn("_kind", kind).withColumn("_sent", text.sentences(F.col("text")))
    rows = rows.withColumns({"_parents": _packed(F.col("_sent"), schema.PARENT_TOKENS, schema.PARENT_OVERLAP), "_children": _packed(F.col("_sent"), schema.CHILD_TOKENS, schema.CHILD_OVERLAP)})
    rows = rows.withColumn(
        "_chunks",
        F.coalesce(
            F.when(F.col("_kind") == "lexicon", F.transform(_long_enough(lines), lambda x: _piece("child", x["idx"], x["text"]))).otherwise(none),
            F.when(F.col("_kind") == "paragraph", F.flatten(F.transform(paragraphs, paragraph))).otherwise(none),
            _by_section(F.col("_parents"), F.col("_children")),
        ),
    )
    # the outer form: filters that Catalyst infers for the other one would work out all chunks again
    out = rows.select("doc_id", "section_id", F.posexplode_outer("_chunks").alias("seq", "c")).where("seq is not null").select("doc_id", "section_id", "seq", "c.level", "c.idx", "c.text", "c.parent")
    return out.withColumn("token_count", text.token_count(F.col("text")))


def normal_text(c: Column) -> Column:
    """What texts are compared by: lower case, white space runs as one blank."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def keep_first(df: DataFrame, keys: list[str], text_col: str, order: list[str]) -> DataFrame:
    """The first of the rows with equal keys and equal text (case and white space aside), in the given order.

    An aggregate with partial results, so that copies of one text do not meet in one task; texts are told apart by 256
    bits of hash. Of rows equal in the order, too, any one is kept.
    """
    groups = df.groupBy(*keys, F.sha2(normal_text(F.col(text_col)), 256).alias("_norm"))
    return groups.agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*order)).alias("_row")).select("_row.*")


def best_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``child_idx, parent_idx, shared`` within each section: the parent that shares most sentences, the first of equals.

    Both sides: ``doc_id, section_id, idx, text``. Children without a shared sentence have no row.
    """
    c = children.select("doc_id", "section_id", F.col("idx").alias("child_idx"), F.explode(F.array_distinct(text.sentences(F.col("text")))).alias("s"))
    p = parents.select("doc_id", "section_id", F.col("idx").alias("parent_idx"), F.explode(F.array_distinct(text.sentences(F.col("text")))).alias("s"))
    shared = c.join(p, ["doc_id", "section_id", "s"]).groupBy("doc_id", "section_id", "child_idx", "parent_idx").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("doc_id", "section_id", "child_idx").orderBy(F.col("shared").desc(), "parent_idx")
    return shared.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def link(chunks: DataFrame) -> DataFrame:
    """``chunk_id, parent_id, child_ids, sibling_ids`` from ``chunk_id, parent_id``: sorted arrays, one row a chunk."""
    family = chunks.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    down = family.select(F.col("parent_id").alias("chunk_id"), F.col("ids").alias("child_ids"))
    out = chunks.select("chunk_id", "parent_id").distinct().join(family, "parent_id", "left")
    siblings = F.array_except(F.coalesce("ids", F.array().cast("array<string>")), F.array("chunk_id"))
    return out.select("chunk_id", "parent_id", siblings.alias("sibling_ids")).join(down, "chunk_id", "left").select("chunk_id", "parent_id", F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"), "sibling_ids")


def _shorten(words: Column, most: int = schema.PARENT_TOKENS) -> Column:
    """The words without as many tens from the end as it takes to fit ``most`` tokens."""

    def fit(ws: Column) -> Column:
        n = F.size(ws)
        head = lambda k: F.array_join(F.slice(ws, F.lit(1), F.greatest(n - 10 * k, F.lit(0))), " ")
        steps = F.get(F.filter(F.sequence(F.lit(0), F.ceil(n / 10).cast("int")), lambda k: text.token_count(head(k)) <= most), F.lit(0))
        return head(F.coalesce(steps, F.lit(0)))

    return text.let(words, fit)


def section_summary(body: Column) -> Column:
    """The first two, the middle and the last sentence (all of at most four); below 60 tokens further sentences follow in
    order, as long as the whole stays within 800 tokens. The sentences and the choice are bound: the fold would work them
    out again for each sentence."""

    def choice(s: Column) -> Column:
        n = F.size(s)
        return F.when(n <= 4, s).otherwise(F.array(F.get(s, F.lit(0)), F.get(s, F.lit(1)), F.get(s, F.floor(n / 2).cast("int")), F.get(s, n - 1)))

    def grown(s: Column, chosen: Column) -> Column:
        zero = F.struct(F.array_join(chosen, " ").alias("t"), F.lit(False).alias("over"))

        def add(a: Column, x: Column) -> Column:
            longer = F.trim(F.concat(a["t"], F.lit(" "), x))
            stop = a["over"] | (text.token_count(a["t"]) >= 60) | F.array_contains(chosen, x)
            full = text.token_count(longer) > schema.PARENT_TOKENS
            return F.when(stop, a).when(full, F.struct(a["t"].alias("t"), F.lit(True).alias("over"))).otherwise(F.struct(longer.alias("t"), F.lit(False).alias("over")))

        return F.aggregate(s, zero, add)["t"]

    out = text.let(text.sentences(body), lambda s: text.let(choice(s), lambda chosen: grown(s, chosen)))
    return text.let(out, lambda t: F.when(text.token_count(t) > schema.PARENT_TOKENS, _shorten(F.split(t, r"\s+"))).otherwise(t))


def tagged(chunks: DataFrame) -> DataFrame:
    """``chunks`` with the five tag families and the chunk type computed from text and document kind."""
    families = {f: tags.tag_family(F.col("text"), f) for f in schema.TAGS}
    return chunks.withColumns({**families, "phase_scope": tags.phases(F.col("text")), "chunk_type": tags.chunk_type(F.col("text"), F.col("source_type"), F.col("doc_family"))})


def validation(chunks: DataFrame) -> DataFrame:
    """One row of checks: chunks, children with a parent, damaged texts, tag false positives, empty texts, page order."""
    child = F.col("level") == "child"
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(child).alias("n_children"), F.count_if(child & F.col("parent_id").isNotNull()).alias("n_linked"), F.count_if(text.mojibake_score(F.col("text")) > 0).alias("n_mojibake"),
        F.count_if(F.array_contains("instrument_tags", "port") | F.array_contains("action_tags", "wash")).alias("n_false_tags"), F.count_if(strip(F.col("text")) == "").alias("n_empty"), F.count_if(F.col("page_end") < F.col("page_start")).alias("n_page_order"),
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``collection, chunk_type, level, n, avg_tokens`` (integer division; null counts as 0)."""
    total = F.sum(F.coalesce("token_count", F.lit(0)))
    return chunks.groupBy("collection", "chunk_type", "level").agg(F.count(F.lit(1)).alias("n"), F.floor(total / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("long").alias("avg_tokens"))


def fallback_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``chunk_id, parent_id`` of children without a parent: within the section the parent that shares most sentences,
    else the one that holds the greatest share of the child's words, else the only one. The first of equals by ``pos``.

    Both sides: ``doc_id, section_id, chunk_id, text, pos``. Only children that lost their parent come here.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    c = children.select("doc_id", "section_id", "chunk_id", F.array_distinct(text.sentences(F.col("text"))).alias("_s"), words(F.col("text")).alias("_w"))
    p = parents.select("doc_id", "section_id", F.col("chunk_id").alias("parent_id"), F.col("pos").alias("_pos"), F.array_distinct(text.sentences(F.col("text"))).alias("_ps"), words(F.col("text")).alias("_pw"))
    pairs = c.join(p, ["doc_id", "section_id"]).select("chunk_id", "parent_id", "_pos", F.size(F.array_intersect("_s", "_ps")).alias("_shared"), (F.size(F.array_intersect("_w", "_pw")) / F.greatest(F.size("_w"), F.lit(1))).alias("_ratio"))
    best = pairs.groupBy("chunk_id").agg(F.max_by(F.struct("parent_id", "_shared", "_ratio"), F.struct("_shared", "_ratio", -F.col("_pos"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.where((F.col("b._shared") > 0) | (F.col("b._ratio") > 0) | (F.col("n") == 1)).select("chunk_id", F.col("b.parent_id").alias("parent_id"))


def build(pages: DataFrame, manifest: DataFrame, least_chars: int = 100) -> DataFrame:
    """The corpus: pages and manifest to tagged, linked chunks and summaries with ids and context headers.

    Documents of fewer than ``least_chars`` signs are left out. Texts equal to an earlier one of their document are dropped
    (parents before children before summaries), but ids keep the places before that, so they have gaps. The manifest is
    joined by what Catalyst chooses for its size.
    """
    enough = pages.groupBy("doc_id").agg(F.sum(F.length(blank(F.col("text")))).alias("_n")).where(F.col("_n") >= least_chars).select("doc_id")
    secs = filter_sections(sections(pages.join(enough, "doc_id", "left_semi")), manifest)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in STRATEGIES.items() for x in kv]), F.col("chunk_strategy"))
    secs = cut(secs)
    raw = chunks_of_sections(secs.join(manifest.select("doc_id", "chunk_strategy"), "doc_id"), F.coalesce(named, F.lit("section_aware"))).withColumn("kind", F.lit(0))
    brief = secs.select("doc_id", "section_id", F.lit(0).alias("seq"), F.lit("section_summary").alias("level"), F.lit(0).alias("idx"), section_summary(F.col("text")).alias("text"), F.lit(None).cast("int").alias("parent"), F.lit(1).alias("kind"))
    whole = document_summaries(secs).select("doc_id", "section_id", F.lit(0).alias("seq"), "level", F.lit(0).alias("idx"), "text", F.lit(None).cast("int").alias("parent"), F.lit(2).alias("kind"))
    rows = cut(raw.unionByName(brief.withColumn("token_count", text.token_count(F.col("text")))).unionByName(whole.withColumn("token_count", text.token_count(F.col("text")))))
    place = ["doc_id", "kind", "section_id", "seq"]
    keys = rows.select(*place).withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "section_id", "seq")) - 1)  # keys alone pass the window
    numbered = rows.join(keys, place).withColumn("chunk_id", F.format_string("%s_%s_%04d", "doc_id", F.upper(F.left("level", F.lit(3))), "pos"))
    unique = cut(keep_first(numbered, ["doc_id"], "text", ["pos"]))
    parents, children = unique.where("level = 'parent'"), unique.where("level = 'child'")
    given = children.join(parents.select("doc_id", "section_id", F.col("idx").alias("parent"), F.col("chunk_id").alias("parent_id")), ["doc_id", "section_id", "parent"]).groupBy("chunk_id").agg(F.min("parent_id").alias("parent_id"))
    linked = given.unionByName(fallback_parents(children.join(given, "chunk_id", "left_anti"), parents))
    full = unique.drop("parent", "seq", "kind", "idx").join(linked, "chunk_id", "left")
    about = secs.select("doc_id", "section_id", F.col("title").alias("section_title"), "heading_path", "page_start", "page_end").unionByName(
        secs.groupBy("doc_id").agg(F.lit("DOC_SUMMARY").alias("section_id"), F.lit("Document Summary").alias("section_title"), F.lit("Document Summary").alias("heading_path"), F.min_by("page_start", "section_id").alias("page_start"), F.max_by("page_end", "section_id").alias("page_end"))
    )
    full = full.join(about, ["doc_id", "section_id"])
    full = tagged(full.join(manifest.drop("filename"), "doc_id"))
    full = full.withColumn("section_title", F.when((F.col("chunk_strategy") == "lexicon") & (F.col("level") == "child"), "Ontology Entry").otherwise(F.col("section_title")))
    header = tags.context_header(*[F.col(c) for c in ("doc_title", "source_type", "trust_tier", "heading_path", "chunk_type")], {k: F.col(k) for k in ("anatomy_tags", "risk_tags", "phase_scope")}, F.col("tags_hint"), F.col("page_start"), F.col("page_end"))
    return full.withColumn("contextualized_text", F.concat(header, F.lit("\n"), F.col("text"))).drop("pos", "tags_hint", "chunk_strategy")


def document_summaries(sections_df: DataFrame) -> DataFrame:
    """``doc_id, section_id, section_title, text, level``: title and first sentence of each document's first ten sections.

    Sections beyond the tenth are cut before the text is gathered, so a document's row stays small.
    """
    w = Window.partitionBy("doc_id").orderBy("section_id")
    sentence = F.get(text.sentences(F.col("text")), F.lit(0))
    # a sentence that repeats the title before a colon loses it
    label = F.concat(F.col("title"), F.lit(":"))
    bare = F.when(F.lower(F.left(F.ltrim(sentence), F.length(label))) == F.lower(label), F.ltrim(F.substr(F.ltrim(sentence), F.length(label) + 1))).otherwise(sentence)
    rows = sections_df.withColumn("_n", F.row_number().over(w)).where("_n <= 10").withColumn("_s", bare).where(F.col("_s").isNotNull())
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.col("title"), F.lit(": "), F.col("_s")).alias("t")))).alias("parts"))
    words = F.split(F.array_join(F.transform("parts", lambda p: p["t"]), " "), r"\s+")
    return parts.select("doc_id", F.lit("DOC_SUMMARY").alias("section_id"), F.lit("Document Summary").alias("section_title"), _shorten(words).alias("text"), F.lit("document_summary").alias("level"))
