import random

from pyspark.sql import functions as F

from ferrywork.operators import lexical, ranking


def test_bm25_empty_null_and_ties(spark):
    docs = spark.createDataFrame([(1, "cystic duct"), (2, "cystic duct"), (3, None), (4, "")], "id int, t string")
    q = spark.createDataFrame([(9, "duct duct"), (8, None)], "qid int, t string")
    got = lexical.top_per_query(lexical.bm25(docs, q, "id", "qid", "t", {"t": 1.0}), 5).collect()
    assert [(r.qid, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(9, 1, 1), (9, 2, 2)]
    assert lexical.bm25(docs.limit(0), q, "id", "qid", "t", {"t": 1.0}).count() == 0


def test_unique_terms_and_bundle(spark):
    got = spark.createDataFrame([([" A", "a", "", "b"],)], "x array<string>").select(lexical.unique_terms(F.col("x")).alias("u")).first().u
    assert got == ["A", "b"]
    q = spark.createDataFrame([("q1", "Is the CVS seen?", "recognition", {"gallbladder": 0.5, "grasper": 0.01})], "qid string, question string, question_type string, classes_detected map<string,double>")
    b = lexical.query_bundle(q).first()
    assert b.terms[0] == "Is the CVS seen?" and "critical view of safety" in b.terms and "infundibulum" in b.terms and "retraction" not in b.terms
    assert b.preferred_collections[0] == "visual_ontology"


def plain_select(items, k):
    chosen, families, places = [], set(), set()
    items = sorted(items, key=lambda x: (-x[1], x[0]))
    top = items[0][1] or 1.0
    for i, s, fam, doc, sec in items:
        if len(chosen) >= k:
            break
        if len(chosen) >= max(2, min(3, k)) and (s / top < 0.52 or (chosen[-1][1] and s / chosen[-1][1] < 0.62 and s / top < 0.82)):
            break
        family = fam or sec or str(i)
        if family in families or ((doc, sec) in places and len(chosen) >= max(1, k // 2)):
            continue
        chosen.append((i, s))
        families.add(family)
        places.add((doc, sec))
    if len(chosen) < min(k, 2):
        chosen += [(i, s) for i, s, *_ in items if i not in {c for c, _ in chosen}][: k - len(chosen)]
    return [i for i, _ in chosen]


def test_adaptive_select_against_plain_version(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for q in range(30):
        items = [(i, round(rng.random(), 3), rng.choice([None, "p1", "p2", "p3", "p4"]), rng.choice("xy"), f"s{rng.randint(1, 3)}") for i in range(rng.randint(1, 15))]
        rows += [(q, *x) for x in items]
        want[q] = plain_select(items, 5)
    df = spark.createDataFrame(rows, "qid int, id int, score double, parent_id string, doc_id string, section_id string")
    got = {}
    for r in sorted(ranking.adaptive_select(df).collect(), key=lambda r: r.position):
        got.setdefault(r.qid, []).append(r.id)
    assert got == want


def test_rrf_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "qid int, id int, rank int")
    f = lambda *x: {(r.qid, r.id, r.score) for r in ranking.rrf(*x).collect()}
    assert f(a, b) == f(b, a) and {i for _, i, _ in f(a, b)} == {10, 11}


def test_dense_topk_against_brute_force(spark):
    rng = random.Random(4)
    vs = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>").repartition(5)
    exact = {r.vec_id: list(r.embedding) for r in df.where("embedding is not null").collect()}
    got = ranking.dense_topk(df, df.where("vec_id < 3"), 4).collect()
    for q in range(3):
        best = sorted(((round(sum(a * b for a, b in zip(exact[q], v, strict=True)), 6), i) for i, v in exact.items()), key=lambda x: (-x[0], x[1]))[:4]
        assert [(r.score, r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == best
    assert ranking.dense_topk(df, df.limit(0), 4).count() == 0


def test_rerank_and_recall(spark):
    class Longest:
        def score(self, queries, texts):
            return [len(t) for t in texts]

    hits = spark.createDataFrame([(1, "a", 1, "short"), (1, "b", 2, "much longer duct")], "qid int, chunk_id string, position int, evidence_text string")
    q = spark.createDataFrame([(1, "?"), (2, "?")], "qid int, question string")
    assert [r.chunk_id for r in sorted(ranking.rerank(hits, q, Longest()).collect(), key=lambda r: r.position)] == ["b", "a"]
    n = spark.createDataFrame([(1, ["Duct"]), (2, ["x"])], "qid int, needles array<string>")
    assert tuple(ranking.recall_at_k(hits, n).first()) == (2, 1, 0.5)


def test_registered_searches_ask_the_questions_with_their_classes(spark, tmp_path):
    from ferrywork.plans.queries import QUERIES

    names = "doc_title string, source_type string, doc_family string, trust_tier string, collection string, section_title string, section_id string, heading_path string, chunk_type string, contextualized_text string, parent_id string"
    tags = "anatomy_tags array<string>, instrument_tags array<string>, action_tags array<string>, risk_tags array<string>, phase_scope array<string>"
    filler = [(f"c{i}", "d1", "child", f"unrelated words {i}", 1, 1) for i in range(8)]
    rows = [("c9", "d1", "child", "the infundibulum lies here", 2, 2), *filler]
    schema = f"chunk_id string, doc_id string, level string, text string, page_start int, page_end int, {names}, {tags}"
    spark.createDataFrame([(*r, *[None] * 9, r[3], *[None] * 6) for r in rows], schema).write.parquet(f"{tmp_path}/chunks_v3.parquet")
    asked = [(q, "Where?", None, {"gallbladder": 0.5}) for q in ("Q00000020", "Q00000021", "Q00000040", "Q00000100")]
    spark.createDataFrame(asked, "qid string, question string, question_type string, classes_detected map<string,double>").write.parquet(f"{tmp_path}/questions_v3.parquet")
    for name in ("bm25_questions_topk", "retrieve_hits"):
        best = {(r.qid, r.chunk_id) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert {("Q00000020", "c9"), ("Q00000040", "c9"), ("Q00000100", "c9")} <= best and not any(q == "Q00000021" for q, _ in best), name
    prompts = {r.qid: r.prompt for r in QUERIES["build_prompts"](spark, str(tmp_path)).collect()}
    assert set(prompts) == {"Q00000020", "Q00000040", "Q00000100"} and all("infundibulum" in p for p in prompts.values())


def test_search_against_all_scored_pairs(spark, monkeypatch):
    import random

    from ferrywork import schema
    from ferrywork.operators import lexical, ranking

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(f"c{i:03d}", pick(rng.randint(0, 30)) if i % 17 else None, rng.choice(["safe_chole_guideline", "other", None]), rng.choice(["cvs_criteria", "general"]), [rng.choice(words)] if i % 3 else None, [], None) for i in range(150)]
    df = spark.createDataFrame(chunks, "chunk_id string, contextualized_text string, collection string, chunk_type string, anatomy_tags array<string>, risk_tags array<string>, phase_scope array<string>").selectExpr("*", "'x' as id", "1 as score")
    asked = [(f"q{i}", pick(rng.randint(1, 6)), ["safe_chole_guideline"], ["cvs_criteria"], words[:3]) for i in range(7)] + [("none", "", [], [], [])]
    q = spark.createDataFrame(asked, "qid string, sparse_query string, preferred_collections array<string>, preferred_chunk_types array<string>, terms array<string>")
    weights = {"contextualized_text": 1.0, "anatomy_tags": 0.8, "chunk_type": 0.75}
    plain = {(r.qid, r.id): r.score for r in lexical.bm25(df, q, "chunk_id", "qid", "sparse_query", weights).collect()}
    bonus = lambda c, a: schema.BONUS["collection"] * (c[2] in a[2]) + schema.BONUS["chunk_type"] * (c[3] in a[3]) + schema.BONUS["anatomy_tags"] * bool(set(c[4] or ()) & set(a[4]))
    for with_bonus in (False, True):
        want = set()
        for a in asked[:-1]:
            scored = [(round(plain.get((a[0], c[0]), 0.0) + (bonus(c, a) if with_bonus else 0.0), 6), c[0]) for c in chunks]
            want |= {(a[0], i, s) for s, i in sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], x[1]))[:12]}
        for limit in (1 << 25, 1):
            monkeypatch.setattr(lexical, "BROADCAST_LIMIT", limit)
            got = {(r.qid, r.id, round(r.score, 6)) for r in lexical.search(df, q, 12, weights, bonus=with_bonus).collect()}
            assert {x[:2] for x in got} == {x[:2] for x in want} and all(abs(s - dict(((x[0], x[1]), x[2]) for x in want)[a, b]) < 2e-6 for a, b, s in got)
    assert lexical.search(df.limit(0), q, 3, weights).count() == 0 and lexical.search(df, q.limit(0), 3, weights).count() == 0


def test_hybrid_retrieval_end_to_end(spark):
    from ferrywork import schema
    from ferrywork.operators import lexical, ranking

    texts = ["The cystic duct and the critical view of safety", "Bleeding from the liver bed", "Trocar placement and insufflation", "A grasper holds the fundus"]
    rows = [(f"c{i}", f"p{i % 2}", "child", t, t, "d", "Title", "safe_chole_guideline", "A", "Sec", f"SEC_00{i}", "general", [], [], [], [], [], 1, 2) for i, t in enumerate(texts)]
    rows += [(f"p{i}", None, "parent", f"Parent {i}", f"[x] Parent {i}", "d", "Title", "safe_chole_guideline", "A", "Sec", "SEC_009", "general", [], [], [], [], [], 1, 3) for i in range(2)]
    chunks = spark.createDataFrame(rows, "chunk_id string, parent_id string, level string, text string, contextualized_text string, doc_id string, doc_title string, collection string, trust_tier string, section_title string, section_id string, chunk_type string, anatomy_tags array<string>, instrument_tags array<string>, action_tags array<string>, risk_tags array<string>, phase_scope array<string>, page_start int, page_end int")
    q = spark.createDataFrame([("q1", "What must be seen before the cystic duct is cut?", "safety_verification", None), ("q2", "Where does bleeding come from?", "risk_pitfall", {"grasper": 0.4})], "qid string, question string, question_type string, classes_detected map<string,double>")
    bundles = lexical.query_bundle(q)
    hits = ranking.retrieve(chunks, bundles, ranking.HashedEncoder())
    first = {r.qid: r for r in hits.where("position = 1").collect()}
    assert first["q1"].chunk_id == "c0" and first["q1"].evidence_chunk_id == "p0" and first["q1"].evidence_text == "[x] Parent 0" and first["q1"].evidence_raw_text == "Parent 0" and first["q2"].chunk_id == "c1"
    arrays = {r.qid: r for r in ranking.retrieved_arrays(hits).collect()}
    assert arrays["q1"].retrieved_chunks[0] == "c0" and len(arrays["q1"].retrieved_scores) == len(arrays["q1"].retrieved_evidence_cards)
    needles = ranking.needles(spark.createDataFrame([("q1", " PARENT 0 ", None), ("q2", "x", ["zzz"])], "qid string, min_acceptable_chunk_contains string, acceptable_needles array<string>"))
    assert ranking.recall_at_k(hits, needles).first().recall == 0.5

    class Backwards:
        def score(self, queries, texts):
            return [-len(t) if "1" in t else len(t) for t in texts]

    assert ranking.retrieve(chunks, bundles, None, reranker=Backwards()).where("position = 1 and evidence_chunk_id = 'p0'").count() >= 1
    assert ranking.retrieve(chunks.where("level = 'parent'"), bundles).count() > 0


def test_hashed_encoder_is_deterministic_and_near_for_like_texts():
    import numpy as np

    from ferrywork.operators.ranking import HashedEncoder

    a, b, c, d = HashedEncoder().encode(["the cystic duct", "cystic ducts", "trocar placement", ""])
    assert a @ b > a @ c and not d.any() and np.allclose(a, HashedEncoder().encode(["the cystic duct"])[0]) and abs(np.linalg.norm(a) - 1) < 1e-4


def test_a_search_of_many_queries_is_one_pass(spark):
    docs = spark.createDataFrame([("a", "duct"), ("b", "duct artery"), ("c", "liver")], "chunk_id string, text string")
    q = spark.range(2500).selectExpr("id as qid", "if(id % 2 = 0, 'duct', 'artery') as sparse_query")
    found = lexical.search(docs, q, 1, {"text": 1.0})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r.qid % 2, r.id): r.n for r in found.selectExpr("qid", "id").groupBy("qid", "id").count().selectExpr("qid % 2 as qid", "id").groupBy("qid", "id").count().selectExpr("qid", "id", "count as n").collect()} == {(0, "a"): 1250, (1, "b"): 1250}


def test_a_dense_search_of_many_queries_is_one_pass(spark):
    e = spark.range(2500).selectExpr("id as vec_id", "if(id % 2 = 0, array(1.0f, 0.0f), array(0.0f, 1.0f)) as embedding")
    found = ranking.dense_topk(e.where("vec_id < 4"), e, 1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {tuple(r) for r in found.selectExpr("qid % 2", "id").distinct().collect()} == {(0, 0), (1, 1)} and found.count() == 2500
