"""Registered queries of the core and the SQL they are held against.

Every query reads whole tables. ``hybrid_hits``, ``mock_results`` and ``retrieval_recall`` ask all questions; the other searches
take as queries the rows whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.functions import answers, overlap, prompts, tags, text
from ferrywork.operators import corpus, frames, lexical, metrics, observability, ranking
from ferrywork.plans import oracles
from ferrywork.runtime import table
from ferrywork.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "heldout_items").where("item_id % 20 = 0")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions_v3").where("cast(regexp_extract(qid, '([0-9]+)$', 1) as bigint) % 20 = 0")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks as first delivered: later copies of a chunk are the same row again."""
    return table(s, d, "chunks_v3").dropDuplicates(["chunk_id"])


def _results(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "spike_results_v3").dropDuplicates(["result_id"])


# --- retrieval -----------------------------------------------------------------------------------------------------


@query
def bm25_topk(s, d):
    """The five best documents of each held-out item by single-field BM25."""
    found = lexical.search(table(s, d, "documents"), _items(s, d), 5, {"text": 1.0}, "doc_id", "item_id", "text")
    return found.select("qid", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query
def bm25_fields_topk(s, d):
    """The five best child chunks of each held-out item by nine weighted fields."""
    chunks = _chunks(s, d).where("level = 'child'")
    scores = lexical.bm25(chunks, _items(s, d), "chunk_id", "item_id", "text", schema.FIELD_WEIGHTS)
    return lexical.top_per_query(scores, 5).select("qid", F.col("id").alias("chunk_id"), "score", F.col("rank").cast("long").alias("rank"))


def _bundles(s: SparkSession, d: str) -> DataFrame:
    return lexical.query_bundle(_questions(s, d))


@query
def bm25_questions_topk(s, d):
    """The five best child chunks of each question by nine weighted fields."""
    found = lexical.search(_chunks(s, d).where("level = 'child'"), _bundles(s, d), 5, schema.FIELD_WEIGHTS)
    return found.select("qid", F.col("id").alias("chunk_id"), "score", F.col("rank").cast("long").alias("rank"))


def _all_bundles(s: SparkSession, d: str) -> DataFrame:
    return lexical.query_bundle(table(s, d, "questions_v3"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "position", "chunk_id", "evidence_chunk_id", F.round("retrieval_score", 6).alias("score"), F.col("evidence_card.chunk_type").alias("chunk_type"))


@query
def retrieve_hits(s, d):
    """Expanded queries, weighted fields, bonuses, priors, diverse selection and packaged evidence, without vectors."""
    return _shown(ranking.retrieve(_chunks(s, d), _bundles(s, d)))


@query
def hybrid_hits(s, d):
    """The same with BM25 and dense lists fused; the vectors are those of the hashed encoder."""
    return _shown(ranking.retrieve(_chunks(s, d), _all_bundles(s, d), ranking.HashedEncoder()))


@query
def retrieval_recall(s, d):
    """How many questions find their needle among five hybrid hits."""
    questions = table(s, d, "questions_v3")
    hits = ranking.retrieve(_chunks(s, d), lexical.query_bundle(questions), ranking.HashedEncoder())
    return ranking.recall_at_k(hits, ranking.needles(prompts.retrieval_evaluation(questions)))


@query
def build_prompts(s, d):
    """Prompts of the packaged evidence with the hint of the question type."""
    bundles = _bundles(s, d)
    return prompts.prompts(bundles, ranking.retrieve(_chunks(s, d), bundles)).select("qid", "prompt", F.col("evidence_count").cast("long").alias("evidence_count"))


@query
def mock_results(s, d):
    """Result rows of all questions with the mock answer and the arrays of what was retrieved."""
    bundles = _all_bundles(s, d)
    hits = ranking.retrieve(_chunks(s, d), bundles)
    rows = prompts.answer_all(bundles, hits, prompts.mock).join(ranking.retrieved_arrays(hits), "qid", "left")
    return rows.select("qid", "is_defer", "parsed_answer", "prompt_variant", F.array_join("retrieved_chunks", ";").alias("chunks"), F.array_join("parse_flags", ";").alias("flags"))


def _dense(s, d, k: int, cosine: bool) -> DataFrame:
    e = table(s, d, "embeddings")
    return ranking.dense_topk(e, e.where("vec_id % 20 = 0"), k, cosine=cosine)


@query
def dense_topk_ip(s, d):
    return _dense(s, d, 10, False).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query
def rrf_fusion(s, d):
    """Reciprocal-rank fusion of the inner-product and the cosine list."""
    return ranking.rrf(_dense(s, d, 20, False), _dense(s, d, 20, True))


@query
def alpha_mix(s, d):
    a, b = _dense(s, d, 40, False), _dense(s, d, 20, True)
    return ranking.alpha_mix(ranking.rrf(a, b), a, b)


@query
def query_expansion(s, d):
    """Terms of all questions: expansions, hints of the type, detected classes."""
    b = lexical.query_bundle(table(s, d, "questions_v3"))
    return b.select("qid", F.size("terms").cast("long").alias("n_terms"), "sparse_query", F.array_join("preferred_collections", ";").alias("collections"))


@query
def parent_child_join(s, d):
    """Children with the page range and length of their parent, the child's own where there is none."""
    c = _chunks(s, d)
    p = c.select(F.col("chunk_id").alias("pid"), F.char_length("text").alias("plen"), F.col("page_start").alias("pstart"))
    rows = c.where("level = 'child'").join(p, c["parent_id"] == p["pid"], "left")
    return rows.select("chunk_id", F.coalesce("pid", "chunk_id").alias("evidence_id"), F.coalesce("plen", F.char_length("text")).cast("long").alias("evidence_length"), F.coalesce("pstart", "page_start").cast("long").alias("page"))


# --- corpus --------------------------------------------------------------------------------------------------------


@query
def keep_first_dedup(s, d):
    """Documents whose text (case and white space aside) no document of a smaller id holds."""
    return corpus.keep_first(table(s, d, "documents"), [], "text", ["doc_id"]).select("doc_id", "n_chars")


@query
def corpus_stats(s, d):
    return corpus.corpus_stats(_chunks(s, d))


@query
def corpus_validation(s, d):
    return corpus.validation(_chunks(s, d))


@query
def tag_dictionary(s, d):
    c = _chunks(s, d)
    return c.select("chunk_id", *[F.array_join(tags.tag_family(F.col("text"), f), ";").alias(f) for f in schema.TAGS], F.array_join(tags.phases(F.col("text")), ";").alias("phases"))


@query
def chunk_types(s, d):
    return _chunks(s, d).select("chunk_id", tags.chunk_type(F.col("text"), F.col("source_type"), F.col("doc_family")).alias("kind"))


@query
def sentence_split(s, d):
    x = text.sentences(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(x).cast("long").alias("n_sentences"), F.array_max(F.transform(x, F.char_length)).cast("long").alias("longest"))


@query
def mojibake_marks(s, d):
    return _chunks(s, d).select("chunk_id", text.mojibake_score(F.col("text")).cast("long").alias("marks")).where("marks > 0")


@query
def clean_text(s, d):
    return text.clean(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "cleaned")


@query
def heading_lines(s, d):
    """Heading, reference and contents lines of each chunk."""
    c = _chunks(s, d)
    lines = text.lines_of(F.col("text"))
    n = lambda test: F.size(F.filter(lines, test)).cast("long")
    return c.select("chunk_id", n(text.heading).alias("headings"), n(text.reference_line).alias("references"), n(text.toc_line).alias("contents"))


@query
def pack_sections(s, d):
    """Chunks of the documents' texts as sections: parents and children by token budget."""
    docs = table(s, d, "documents").where("text is not null")
    secs = docs.select("doc_id", F.lit("SEC_001").alias("section_id"), "text")
    return corpus.chunks_of_sections(secs).select("doc_id", "level", F.col("idx").cast("long").alias("idx"), F.col("token_count").cast("long").alias("token_count"))


def _pages(s, d) -> DataFrame:
    return _chunks(s, d).where("level = 'parent' and text is not null").select("doc_id", F.coalesce("page_start", F.lit(0)).alias("page_num"), "text")


@query
def built_corpus(s, d):
    """The corpus built from the parents as pages: chunks by document and level."""
    out = corpus.build(_pages(s, d), table(s, d, "manifest_v3"))
    return out.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.count("parent_id").alias("linked"))


@query
def document_sections(s, d):
    """Sections of each document of the corpus, from its parents as pages."""
    return corpus.sections(_pages(s, d)).select("doc_id", "section_id", "title", "page_start", F.char_length("text").cast("long").alias("n_chars"))


@query
def argmax_overlap_join(s, d):
    """The parent chunk that shares most sentences with each child of its section."""
    c = _chunks(s, d).where("text is not null").select("doc_id", "section_id", F.col("chunk_id").alias("idx"), "text", "level")
    return corpus.best_parents(c.where("level = 'child'"), c.where("level = 'parent'")).select("child_idx", "parent_idx", "shared")


@query
def link_family(s, d):
    out = corpus.link(_chunks(s, d))
    return out.select("chunk_id", F.array_join("child_ids", ";").alias("children"), F.array_join(F.array_sort("sibling_ids"), ";").alias("siblings"))


@query
def context_headers(s, d):
    c = _chunks(s, d).join(table(s, d, "manifest_v3").select("doc_id", "tags_hint"), "doc_id")
    h = tags.context_header(*[F.col(x) for x in ("doc_title", "source_type", "trust_tier", "heading_path", "chunk_type")], {k: F.col(k) for k in ("anatomy_tags", "risk_tags", "phase_scope")}, F.col("tags_hint"), F.col("page_start"), F.col("page_end"))
    return c.select("chunk_id", h.alias("header"))


@query
def section_summaries(s, d):
    return _chunks(s, d).where("level = 'parent'").select("chunk_id", corpus.section_summary(F.col("text")).alias("summary"))


# --- evaluation ----------------------------------------------------------------------------------------------------


@query
def parse_responses(s, d):
    rows = answers.parse_responses(_results(s, d).select("result_id", "raw_response"))
    return rows.select("result_id", "parsed.is_defer", "parsed.confidence", "parsed.parsed_answer", F.array_join("parsed.parse_flags", ";").alias("flags"))


@query
def parse_judgements(s, d):
    rows = answers.parse_judgements(_results(s, d).select("result_id", "raw_judge_response"))
    return rows.select("result_id", "judged.judge_verdict", "judged.judge_reason", *[F.col(f"judged.{x}").cast("long").alias(x) for x in schema.SCORES], "judged.judge_parse_error")


@query
def confusion_matrix(s, d):
    return metrics.confusion(_results(s, d), "should_defer", "is_defer")


@query
def confusion_by_type(s, d):
    return metrics.confusion(_results(s, d), "should_defer", "is_defer", "question_type")


@query
def tier1_summary(s, d):
    return metrics.tier1(_results(s, d))


@query
def by_question_type(s, d):
    return metrics.by_group(_results(s, d), "question_type")


@query
def by_difficulty(s, d):
    return metrics.by_group(_results(s, d), "difficulty")


@query
def grouped_sets(s, d):
    return metrics.grouped_sets(_results(s, d))


@query
def flag_histogram(s, d):
    return metrics.flag_histogram(_results(s, d))


@query
def confidence_histogram(s, d):
    return metrics.confidence_histogram(_results(s, d))


@query
def per_question(s, d):
    return metrics.per_question(_results(s, d))


@query
def keyword_recall(s, d):
    k = overlap.keyword_accuracy(F.col("gold_answer"), F.col("parsed_answer"))
    return _results(s, d).select("result_id", k["recall"].alias("recall"), k["precision"].alias("precision"), F.array_join(k["missed"], ";").alias("missed"))


@query
def overlap_metrics(s, d):
    """BLEU, ROUGE-L and exact-match METEOR of all answered rows."""
    return metrics.tier2_rows(_results(s, d)).select("result_id", *[F.round(c, 6).alias(c) for c in ("rouge_l", "bleu1", "bleu4", "meteor")])


@query
def tier2_summary(s, d):
    return metrics.tier2(_results(s, d))


@query
def tier3_summary(s, d):
    return metrics.tier3(_results(s, d))


@query
def judge_by_type(s, d):
    return metrics.judge_by_group(_results(s, d), "question_type")


@query
def defer_alignment(s, d):
    return metrics.defer_alignment(_results(s, d))


@query
def outcome_counts(s, d):
    return metrics.outcome_counts(_results(s, d))


@query
def tier3_by_type(s, d):
    return metrics.tier3(_results(s, d), "question_type")


@query
def judge_cache_keys(s, d):
    r = _results(s, d)
    key = answers.cache_key(F.col("question"), F.col("gold_answer"), F.col("parsed_answer"))
    return r.select("result_id", key.alias("cache_key"))


@query
def left_anti_resume(s, d):
    """Questions that no result answers yet."""
    return metrics.resume(table(s, d, "spike_results_v3"), table(s, d, "questions_v3"), ["qid"]).select("qid", "question_type")


@query
def results_with_questions(s, d):
    """Results with the frame of their question, by a left join."""
    q = table(s, d, "questions_v3").select("qid", F.col("frame_index").cast("long").alias("frame_index"), "video_id")
    return _results(s, d).select("result_id", "qid").join(q, "qid", "left")


# --- frames and observability --------------------------------------------------------------------------------------


@query
def class_frequency(s, d):
    q = table(s, d, "questions_v3").select(F.explode("classes_detected").alias("class", "share"))
    return q.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean_share"))


@query
def class_features(s, d):
    c = frames.class_features(F.coalesce("classes_detected", F.create_map().cast("map<string,double>")))
    return table(s, d, "questions_v3").select("qid", *[F.round(c[k], 6).alias(k) for k in ("anatomy_area", "tool_area", "risk_area")], c["n_classes"].cast("long").alias("n_classes"), c["has_blood"].alias("has_blood"))


@query
def bucket_target_fill(s, d):
    """Questions of each bucket against its target."""
    goal = s.createDataFrame([(x, y, n) for (x, y), n in schema.BUCKETS.items()], "difficulty string, question_type string, target long")
    have = table(s, d, "questions_v3").groupBy("difficulty", "question_type").agg(F.count(F.lit(1)).alias("n"))
    return goal.join(F.broadcast(have), ["difficulty", "question_type"], "left").select("difficulty", "question_type", "target", F.coalesce("n", F.lit(0)).alias("n"))


@query
def trim_to_targets(s, d):
    """The first questions of each bucket up to its target, by id."""
    goal = s.createDataFrame([(x, y, n) for (x, y), n in schema.BUCKETS.items()], "difficulty string, question_type string, target long")
    w = Window.partitionBy("difficulty", "question_type").orderBy("qid")
    rows = table(s, d, "questions_v3").join(F.broadcast(goal), ["difficulty", "question_type"]).withColumn("rn", F.row_number().over(w))
    return rows.where("rn <= target").select("qid", "difficulty", "question_type")


@query
def trim_by_area(s, d):
    """The questions of each bucket up to its target by the anatomy in view, then by risk and tools."""
    goal = s.createDataFrame([(x, y, n) for (x, y), n in schema.BUCKETS.items()], "difficulty string, question_type string, target long")
    c = frames.class_features(F.coalesce("classes_detected", F.create_map().cast("map<string,double>")))
    rows = table(s, d, "questions_v3").select("qid", "difficulty", "question_type", c["anatomy_area"].alias("score"), c["risk_area"].alias("defer_score"), c["tool_area"].alias("quality_score"))
    return frames.trim_to_targets(rows, goal, "qid").select("qid", "difficulty", "question_type", "score")


@query
def hamming_pairs(s, d):
    """Pairs of vectors whose 64 sign bits differ in fewer than eighteen places."""
    return frames.near_duplicates(_sign_hashes(s, d), "vec_id", "h", 18).select("a", "b", F.col("distance").cast("long").alias("distance"))


def _sign_hashes(s, d) -> DataFrame:
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return table(s, d, "embeddings").select("vec_id", F.array(F.conv(bits, 2, -10).cast("long")).alias("h"))


@query
def hamming_self_join(s, d):
    """Pairs of vectors whose 64 sign bits differ in fewer than eight places."""
    return frames.near_duplicates(_sign_hashes(s, d), "vec_id", "h").select("a", "b", F.col("distance").cast("long").alias("distance"))


@query
def robust_z(s, d):
    z = observability.robust_z(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return z.select("o_orderkey", F.round("z_o_totalprice", 9).alias("z"))


@query
def tertile_strata(s, d):
    return observability.tertiles(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "stratum").select("o_orderkey", "stratum")


@query
def crosstab_pivot(s, d):
    return observability.crosstab(table(s, d, "questions_v3"), "question_type", "difficulty", list(schema.DIFFICULTIES))


@query
def stratified_sample_counts(s, d):
    q = table(s, d, "questions_v3")
    goal = s.createDataFrame([(x, 20) for x in schema.DIFFICULTIES], "difficulty string, target int")
    return observability.stratified_sample(q, ["difficulty"], goal, "qid").groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_sample_rows(s, d):
    """Which twenty questions of each difficulty a seeded sample takes."""
    goal = s.createDataFrame([(x, 20) for x in schema.DIFFICULTIES], "difficulty string, target int")
    return observability.stratified_sample(table(s, d, "questions_v3"), ["difficulty"], goal, "qid").select("difficulty", "qid")


@query
def pilot_rows(s, d):
    """A pilot sample of questions: types as strata, difficulties as states."""
    q = table(s, d, "questions_v3").select("qid", "question_type", "difficulty")
    out = observability.pilot_sample(q, "qid", "question_type", "difficulty", 40, {"easy": 10, "medium": 15, "hard": 10})
    return out.select("qid", F.col("pilot_row_index").cast("long").alias("pilot_row_index"))


@query
def bootstrap_rates(s, d):
    """The rate of deferred answers by question type with its bootstrap interval."""
    r = _results(s, d).withColumn("v", F.col("is_defer").cast("double"))
    out = observability.bootstrap_interval(r, ["question_type"], "v")
    return out.select("question_type", F.col("mean"), "n", (F.col("ci_low") <= F.col("mean")).alias("low_ok"), (F.col("ci_high") >= F.col("mean")).alias("high_ok"))


@query
def retrieval_evaluation(s, d):
    """Keywords and needle of each question."""
    r = prompts.retrieval_evaluation(table(s, d, "questions_v3"))
    return r.select("qid", F.array_join("relevant_keywords", ";").alias("keywords"), F.col("min_acceptable_chunk_contains").alias("needle"))


@query
def question_drafts(s, d):
    """Draft questions and gold stubs by type and frame."""
    q = table(s, d, "questions_v3")
    draft = prompts.draft_question(F.col("question_type"), F.col("frame_index"), F.col("difficulty"), F.col("classes_detected"), F.col("should_defer"))
    return q.select("qid", draft.alias("draft"), prompts.gold_stub(F.col("classes_detected"), F.col("should_defer")).alias("gold_stub"))


@query
def section_titles(s, d):
    """Titles inferred from the text of each document."""
    return table(s, d, "documents").select("doc_id", text.infer_title(F.col("text"), F.lit("Untitled")).alias("title"))


# --- relational forms and extensions -------------------------------------------------------------------------------


@query
def pricing_summary(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count(F.lit(1)).alias("n"))


@query
def revenue_by_nation(s, d):
    t = lambda n: table(s, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def set_operations(s, d):
    """Customers with orders in common, without, and in either table, as counts."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"))
    one = lambda df, name: df.agg(F.lit(name).alias("operation"), F.count(F.lit(1)).alias("n"))
    return one(c.intersect(o), "intersect").unionByName(one(c.subtract(o), "except")).unionByName(one(c.union(o).distinct(), "union"))


@query
def event_windows(s, d):
    """Extension: hourly counts of events."""
    return incremental.windowed_counts(table(s, d, "events")).select("window_start", "event_type", "n", F.round("total", 2).alias("total"))


@query
def event_sessions(s, d):
    """Extension: sessions of each user, ended by half an hour without events."""
    return incremental.sessions(table(s, d, "events"))


ORACLES: dict[str, str] = oracles.build()
