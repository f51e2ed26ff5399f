from pyspark.sql import functions as F

from ferrywork.functions import tags, text
from ferrywork.operators import corpus


BODY = " ".join(["A sentence that is long enough to count as body text."] * 8)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column(F.col("t")).alias("x")).first().x


def test_line_predicates(spark):
    assert one(spark, text.heading, "ABSTRACT") and one(spark, text.heading, "1. Introduction") and one(spark, text.heading, "Step 2")
    assert not one(spark, text.heading, "John Doe, MD, PhD, University of X")
    assert one(spark, text.reference_line, "12. Smith J, Doe A. Title. J Surg 2010;12:3.")
    assert not one(spark, text.reference_line, "1. Introduction")
    assert one(spark, text.toc_line, "Section II. Ten objectives 14")
    assert not one(spark, text.heading, None) and not one(spark, text.reference_line, None)


def test_cleaning(spark):
    assert one(spark, text.normalize_artifacts, "ﬁne /C12 text Page 3 of 9") == "fine text "
    assert one(spark, text.mojibake_score, "â€™ and Ã©") == 2
    assert one(spark, text.normalize_mojibake, "cafÃ© â€“ ok") == "café – ok"
    assert one(spark, text.normalize_mojibake, "déjà vu") == "déjà vu"
    df = text.clean(spark.createDataFrame([(1, "Page 3\nBody text here.\nhttps://x.y/z\n12"), (2, None)], "i int, text string"), "text")
    got = {r.i: r.cleaned for r in df.collect()}
    assert "Body text here." in got[1] and "https" not in got[1] and got[2] == ""


def test_sentences_and_tokens(spark):
    assert one(spark, text.sentences, "See Fig. 2 now. Next one! Last") == ["See Fig. 2 now.", "Next one!", "Last"]
    assert one(spark, text.sentences, None) == []
    assert one(spark, text.token_count, "") == 1 and one(spark, text.token_count, "x" * 41) == 10


def test_packing_keeps_everything(spark):
    sents = [f"{'w' * 19} {i:03d}." for i in range(40)]  # 24 signs, 6 tokens each
    got = spark.createDataFrame([(sents,)], "s array<string>").select(corpus.pack(F.col("s"), 20, 6).alias("p")).first().p
    assert [s for p in got for s in p if s] and set(s for p in got for s in p) == set(sents)
    assert all(sum(len(s) // 4 for s in p) <= 20 for p in got)
    assert all(a[-1] == b[0] for a, b in zip(got, got[1:], strict=False))
    long = spark.createDataFrame([(["x" * 400, "short one."],)], "s array<string>").select(corpus.pack(F.col("s"), 20, 6).alias("p")).first().p
    assert [len(p) for p in long] == [1, 1]


def test_tags(spark):
    assert one(spark, lambda c: tags.tag_family(c, "anatomy_tags"), "The CVS and Calot's triangle near the cystic duct") == ["critical view of safety", "cystic duct", "hepatocystic triangle"]
    assert one(spark, lambda c: tags.tag_family(c, "instrument_tags"), "transport and clipboard") == []
    assert one(spark, tags.phases, "trocar then specimen bag") == ["setup", "extraction"]
    assert one(spark, tags.phases, None) == []


def test_keep_first_links_and_sections(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, None), (4, "")], "doc_id int, text string")
    assert {r.doc_id for r in corpus.keep_first(df, [], "text", ["doc_id"]).collect()} == {1, 3}
    c = spark.createDataFrame([("p", None), ("a", "p"), ("b", "p"), ("x", None)], "chunk_id string, parent_id string")
    got = {r.chunk_id: r for r in corpus.link(c).collect()}
    assert got["p"].child_ids == ["a", "b"] and got["a"].sibling_ids == ["b"] and got["x"].child_ids == []
    # a heading opens a section where the open one has lines: the first one is text of the introduction
    body = BODY
    pages = spark.createDataFrame([("d", 1, f"INTRODUCTION\n{body}\nMETHODS\n{body}"), ("d", 2, f"{body}\nRESULTS\n{body}"), ("e", 1, None)], "doc_id string, page_num int, text string")
    got = sorted(corpus.sections(pages).collect(), key=lambda r: r.section_id)
    assert [(r.title, r.page_start, r.page_end) for r in got] == [("Introduction", 1, 1), ("METHODS", 1, 1), ("RESULTS", 2, 2)]  # a page begins at its first content word
    assert got[0].text.startswith("INTRODUCTION\n") and [r.section_id for r in got] == ["SEC_001", "SEC_002", "SEC_003"]


def test_best_parents_breaks_ties_by_order(spark):
    p = spark.createDataFrame([("d", "s", 0, "One. Two."), ("d", "s", 1, "One. Two. Three.")], "doc_id string, section_id string, idx int, text string")
    c = spark.createDataFrame([("d", "s", 0, "One."), ("d", "s", 1, "Three."), ("d", "s", 2, "Nine.")], "doc_id string, section_id string, idx int, text string")
    got = {r.child_idx: r.parent_idx for r in corpus.best_parents(c, p).collect()}
    assert got == {0: 0, 1: 1}


def test_build_end_to_end(spark):
    body = "The cystic duct and the cystic artery are exposed before any clip is placed. " * 30
    pages = spark.createDataFrame([("d", 1, f"INTRODUCTION\n{body}\nMETHODS\n{body}")], "doc_id string, page_num int, text string")
    m = spark.createDataFrame([("f.pdf", "d", "Title", "review", "guideline", "A", "c", 1, "section_aware", ["cystic"])], "filename string, doc_id string, doc_title string, source_type string, doc_family string, trust_tier string, collection string, priority int, chunk_strategy string, tags_hint array<string>")
    got = corpus.build(pages, m).collect()
    assert got and len({r.chunk_id for r in got}) == len(got)
    assert all(r.contextualized_text.startswith("[Source: Title | Type: review | Trust: Tier A]") for r in got)
    assert any(r.parent_id for r in got if r.level == "child")


def test_front_matter_and_titles(spark):
    body = "This is a line of the body that has more than eight words in it."
    page = f"Authors: A B\na@b.org\nDepartment of Surgery\n{body}\nmore"
    assert one(spark, text.trim_front_matter, page) == f"{body}\nmore"
    assert one(spark, text.trim_front_matter, body) == body and one(spark, text.trim_front_matter, None) == ""
    assert one(spark, text.body_line, body) and not one(spark, text.body_line, "a@b.org")
    assert one(spark, text.front_matter_page, "Published by X\nISBN 1\nTitle") and not one(spark, text.front_matter_page, (body + "\n") * 5)
    assert one(spark, text.trim_preamble, "Authors at the University and the Hospital of somewhere Abstract: " + "x" * 90).startswith("Abstract:")
    assert one(spark, text.sanitize_section, "Open Access Some text.\nReferences\n1. x") == "Some text."
    assert one(spark, text.trim_dataset_front, "y" * 200 + " Abstract " + "x" * 300).startswith("Abstract")
    title = lambda c: text.infer_title(c, F.lit("F"))
    assert [one(spark, title, t) for t in ("2. Study Design\nx", "Conclusion: x", "", "A first line longer than twenty signs.\nz", "one two")] == ["Study Design", "Conclusions", "F", "A first line longer than twenty signs", "F"]
    secs = spark.createDataFrame([("d", f"SEC_{i:03d}", f"T{i}", "First one. Second.") for i in range(12)], "doc_id string, section_id string, title string, text string")
    got = corpus.document_summaries(secs).collect()
    assert len(got) == 1 and got[0].text.startswith("T0: First one. T1:") and "T9" in got[0].text and "T10" not in got[0].text


def test_reference_entries_and_headings(spark):
    entry = lambda t: one(spark, text.reference_line, t)
    assert not entry("1. Support the gallbladder") and one(spark, text.heading, "1. Support the gallbladder")
    assert not entry("1. Volume of bile") and not entry("3. Key Question on safety, duct, artery")
    assert entry("3. Study design") and not one(spark, text.heading, "3. Study design")
    assert entry("4. Smith AB. On the ligation of ducts in pigs. Surgery") and entry("5. Anything 2011") and not entry("A line, with two, commas")
    assert one(spark, text.endmatter_line, "Contributors to this guideline") and not one(spark, text.endmatter_line, "A contributor")
    assert not one(spark, text.heading, "RESULTS OF THE UNIVERSITY") and not one(spark, text.heading, "2. The duct was seen")
    refs = "\n".join(f"{i}. Author A, Author B. Title 20{i:02d}." for i in range(1, 9))
    assert one(spark, text.reference_heavy, refs) and one(spark, lambda c: text.reference_heavy_lines(text.lines_of(c)), refs)
    assert one(spark, text.truncate_at_references, "x" * 900 + "\n" + refs) == "x" * 900 and one(spark, text.truncate_at_references, "x" * 100 + "\n" + refs).endswith("2008.")
    assert one(spark, text.truncate_at_references, "y" * 600 + "\nReferences\nz").rstrip() == "y" * 600


def test_the_walk_leaves_contents_and_bibliographies_out(spark):
    toc = "\n".join(f"Section {n}. Something about checks {i}" for i, n in enumerate(("I", "II", "III", "IV", "V", "VI"), 3))
    refs = "\n".join(f"{i}. Author A, Author B. Title 20{i:02d}." for i in range(1, 9))
    rows = [("d", 1, "A Title"), ("d", 2, toc), ("d", 3, f"{BODY}\n{BODY}\n{BODY}\nOPERATIVE DETAILS\n{BODY}"), ("d", 4, f"{BODY}\n{refs}\nLATER FINDINGS\n{BODY}"), ("d", 5, f"{BODY}\nCLOSING WORDS\n{BODY}"), ("s", 1, "Too short."), ("n", None, BODY)]
    got = sorted((r.doc_id, r.section_id, r.title, r.page_start, r.page_end) for r in corpus.sections(spark.createDataFrame(rows, "doc_id string, page_num int, text string")).collect())
    assert got == [
        ("d", "SEC_001", "Introduction", 3, 3), ("d", "SEC_002", "OPERATIVE DETAILS", 3, 5), ("d", "SEC_003", "CLOSING WORDS", 5, 5),
        ("n", "SEC_001", "Full Document", 0, 0), ("s", "SEC_001", "Full Document", 1, 1),
    ]


def test_bibliographies_end_their_page():
    entry, heading, end = corpus._ENTRY | corpus._NUMBERED, corpus._HEADING, corpus._END
    w = corpus.Walk(True)
    w.page(1, ["x" * 700, "y" * 700], [0, 0], False, False)
    w.page(2, ["1. ref"] * 8, [entry] * 8, False, False)  # a page of entries behind 1,200 signs
    w.page(3, ["NEW PART", "z" * 90, "1. a", "2. b", "3. c", "w" * 90], [heading, 0, entry, entry, entry, 0], False, False)  # three in a row end the page
    w.page(4, ["u" * 90, "Contributors to it", "v" * 90], [0, end, 0], False, False)
    w.close()
    assert [(t, b[0], len(b), a, z) for t, b, a, z in w.out] == [("Introduction", "x", 1401, 1, 1), ("Introduction", "N", 109, 1, 3), ("Introduction", "u", 90, 1, 4)]
    short = corpus.Walk(True)
    short.page(1, ["x" * 100, *["1. ref"] * 3], [0, *[entry] * 3], False, False)
    short.close()
    assert short.out[0][1].count("ref") == 3  # not settled: entries are kept


def test_blocks_of_a_long_document_give_the_same_sections(spark, monkeypatch):
    rows = [("d", i, f"{BODY}\nPART NUMBER {chr(65 + i % 26)}{chr(65 + i // 26)}\n{BODY}\n{BODY}") for i in range(60)]
    pages = spark.createDataFrame(rows, "doc_id string, page_num int, text string")
    plain = lambda: sorted((r.section_id, r.title, r.text, r.page_start, r.page_end) for r in corpus.sections(pages).collect())
    whole = plain()
    monkeypatch.setattr(corpus, "BLOCK_PAGES", 20)
    monkeypatch.setattr(corpus, "BLOCK_RATE", 6)
    assert len(whole) == 61 and plain() == whole
    assert corpus._blocks(corpus.page_lines(pages)).select("block").distinct().count() > 3


def test_strategies_and_fallback_parents(spark):
    long = " ".join(f"Sentence number {i} says something about the duct." for i in range(60))
    secs = spark.createDataFrame([("d", "s1", long, "section_aware"), ("d", "s2", "Short one. " * 3, "section_aware"), ("d", "s3", f"{long}\n\nTiny.", "paragraph"), ("d", "s4", "\n".join(["a line of an ontology entry with words"] * 60), "lexicon")], "doc_id string, section_id string, text string, k string")
    got = {}
    for r in corpus.chunks_of_sections(secs, F.col("k")).collect():
        got.setdefault((r.section_id, r.level), []).append(r)
    assert all(r.token_count <= 250 and r.parent == 0 for r in got["s1", "child"]) and len(got["s1", "parent"]) == 1 and len(got["s1", "child"]) > 1
    assert [r.text for r in got["s2", "parent"]] == ["Short one. Short one. Short one."] and ("s2", "child") not in got  # below 30 tokens: a fallback parent alone
    assert ("s3", "parent") in got and all(r.parent is None for r in got["s3", "child"]) and ("s4", "parent") not in got and all(r.token_count <= 440 for r in got["s4", "child"])  # line ends come on top
    c = spark.createDataFrame([("d", "s", "c1", "One. Two.", 1), ("d", "s", "c2", "alpha beta gamma", 2), ("d", "t", "c3", "nothing here", 3)], "doc_id string, section_id string, chunk_id string, text string, pos int")
    p = spark.createDataFrame([("d", "s", "p1", "alpha beta", 1), ("d", "s", "p2", "Two. Three.", 2), ("d", "t", "p3", "else", 3)], "doc_id string, section_id string, chunk_id string, text string, pos int")
    assert {r.chunk_id: r.parent_id for r in corpus.fallback_parents(c, p).collect()} == {"c1": "p2", "c2": "p1", "c3": "p3"}


def test_sections_are_filtered_by_kind(spark):
    keep = lambda title, body, hints, family, source: spark.createDataFrame([(title, body, hints, family, source)], "t string, b string, h array<string>, f string, s string").select(corpus.keep_section(*[F.col(c) for c in "tbhfs"]).alias("x")).first().x
    assert keep("Findings", BODY, [], "other", None) and not keep("Acknowledgements", BODY, [], "other", None) and not keep("Findings", "short", [], "other", None) and not keep(None, None, None, None, None)
    assert not keep("Findings", BODY, [], "dataset_paper", None) and keep("Findings", BODY + " annotation", [], "dataset_paper", None) and keep("Dataset", BODY, [], "dataset_paper", None)
    assert not keep("Findings", BODY, [], "x", "guideline") and keep("Findings", BODY, ["body text", "sentence"], "x", "guideline") and keep("Discussion", BODY, [], "x", "clinical_review")


def test_summaries(spark):
    assert one(spark, corpus.section_summary, "A one. B two. C three. D four. E five. F six.") == "A one. B two. D four. F six. C three. E five."
    assert one(spark, corpus.section_summary, None) == "" and len(one(spark, corpus.section_summary, "word " * 2000)) // 4 <= 800


def test_a_summary_splits_its_text_once(spark):
    df = spark.createDataFrame([("A one. B two. " * 300,)], "t string").select(corpus.section_summary(F.col("t")).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?<=[.!?])") == 1
    assert len(df.first().s) >= 20


def test_packing_repeats_no_step(spark):
    df = corpus.chunks_of_sections(spark.createDataFrame([("d", "s", "One sentence of some words. " * 30)], "doc_id string, section_id string, text string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?<=[.!?])") <= 8
    assert {r.level for r in df.collect()} == {"parent", "child"}
