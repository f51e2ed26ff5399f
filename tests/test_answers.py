from pyspark.sql import functions as F

from ferrywork.functions import answers, overlap


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_parse_response_cases(spark):
    raw = [None, "", "[your concise answer]", "0, 0, 0, 0, 0, 0,", "DEFER: too dark", "ANSWER: DEFER", "ANSWER: the duct | CONFIDENCE: [High]", "ANSWER: | CONFIDENCE: low", "the duct", "assistant: ANSWER: x"]
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(raw)], "i int, raw_response string, parsed_answer string")
    got = {r["i"]: r["parsed"] for r in rows(answers.parse_responses(df))}
    assert got[0]["parse_flags"] == got[1]["parse_flags"] == ["empty_raw"] and got[0]["is_defer"]
    assert got[2]["parse_flags"] == ["template_leak", "noncanonical_prefix"] and got[2]["parsed_answer"] == answers.LEAK_TEXT
    assert "garbage_output" in got[3]["parse_flags"] and got[3]["parsed_answer"] == answers.GARBAGE_TEXT
    assert got[4]["is_defer"] and got[4]["parsed_answer"] == "too dark"
    assert got[5]["is_defer"]
    assert (got[6]["parsed_answer"], got[6]["confidence"], got[6]["is_defer"]) == ("the duct", "high", False)
    assert got[7]["parse_flags"] == ["blank_answer_after_parse"]
    assert got[8]["parse_flags"] == ["noncanonical_prefix"] and got[8]["confidence"] == "unknown"
    assert got[9]["parsed_answer"] == "x"


def test_parse_judgement_cases(spark):
    raw = [
        'so {"verdict": "Unsafe", "reason": "a {b} \\"c\\"", "correctness_score": 9, "safety_score": 2.5} end', "The answer is incorrect.", "nothing here", None, '{"verdict": "correct"', '{"verdict": "maybe"}',
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, raw_judge_response string")
    got = {r["i"]: r["judged"] for r in rows(answers.parse_judgements(df))}
    assert got[0]["judge_verdict"] == "unsafe" and got[0]["correctness_score"] == 5 and got[0]["safety_score"] == 2 and got[0]["grounding_score"] == 1
    assert got[0]["judge_reason"] == 'a {b} "c"'
    assert got[1]["judge_verdict"] == "correct" and got[1]["correctness_score"] == 3 and not got[1]["judge_parse_error"]
    assert got[2]["judge_parse_error"] and got[2]["safety_score"] == 0
    assert got[3]["judge_parse_error"]
    assert got[4]["judge_verdict"] == "correct" and not got[4]["judge_parse_error"]
    assert got[5]["judge_verdict"] == ""


def test_small_column_functions(spark):
    df = spark.createDataFrame([("  a  b ", "YES", "```json\n{\"answer\": \"No\"}\n```"), (None, None, "I am uncertain, yes"), ("x" * 30, "maybe", None)], "t string, a string, p string")
    got = df.select(
        answers.collapse(F.col("t")).alias("c"), answers.truncate(F.col("t"), 10).alias("u"), answers.answer_to_binary(F.col("a")).alias("b"), answers.pilot_answer(F.col("p")).alias("p"), answers.cache_key(F.col("t"), F.col("a")).alias("k")
    ).collect()
    assert [r.c for r in got] == ["a b", "", "x" * 30]
    assert got[2].u == "x" * 7 + "..."
    assert [r.b for r in got] == [1.0, None, None]
    assert [r.p for r in got] == ["no", "uncertain", "unknown"]
    assert all(len(r.k) == 16 for r in got)


def test_overlap_against_plain_versions():
    import random

    rng = random.Random(1)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert overlap.lcs_length(a, b) == lcs(a, b)
    assert overlap.bleu(list("abcd"), list("abcd")) == 1.0
    assert overlap.bleu([], ["a"]) == overlap.rouge_l([], []) == overlap.meteor_exact(["a"], ["b"]) == 0.0
    assert 0 < overlap.bleu(list("abcdef"), list("abc")) < 1


def test_keyword_accuracy(spark):
    df = spark.createDataFrame([("the liver and the hook", "a Liver"), (None, "liver"), ("plain", None)], "g string, a string")
    got = [r.k for r in df.select(overlap.keyword_accuracy(F.col("g"), F.col("a")).alias("k")).collect()]
    assert got[0].recall == 0.5 and got[0].precision == 1.0 and got[0].missed == ["hook"]
    assert got[1].recall == 1.0 and got[1].precision == 0.0
    assert got[2].recall == 1.0


def test_escaped_quotes_in_judgements(spark):
    raw = 'Sure: {"verdict":"unsafe","reason":"a 5\\" port } was used","correctness_score":2,"safety_score":1,"grounding_score":2.5,"defer_score":"x"} end'
    r = answers.parse_judgements(spark.createDataFrame([(raw,), ("it is incorrect",), ('{"verdict":"correct"',), (None,)], "raw_judge_response string")).select("judged.*").collect()
    assert (r[0].judge_verdict, r[0].correctness_score, r[0].safety_score, r[0].grounding_score, r[0].defer_score, r[0].judge_reason) == ("unsafe", 2, 1, 2, 1, 'a 5" port } was used')
    assert r[1].judge_verdict == "correct" and r[2].judge_verdict == "correct" and r[2].correctness_score == 3 and r[3].judge_parse_error


def test_answering_and_judging(spark):
    from ferrywork.functions import prompts

    q = spark.createDataFrame([("q1", "What is this?", "recognition"), ("q2", "Which phase?", "workflow_phase"), ("q3", "Boom?", "risk_pitfall"), ("q4", None, None)], "qid string, question string, question_type string")
    hits = spark.createDataFrame([("q1", 1, "e1", "text one"), ("q1", 2, "e1", "text one"), ("q1", 3, "e2", "text two"), ("q2", 1, "e1", "text one")], "qid string, position int, evidence_chunk_id string, evidence_text string")

    def model(prompt, question):
        if question and question.startswith("Boom"):
            raise ValueError("no")
        if question and question.startswith("Which"):
            return "[your concise answer]" if "Evidence" in prompt and len(prompt) > 0 and not getattr(model, "x", False) else "DEFER: x"
        return "ANSWER: a duct | CONFIDENCE: high"

    got = {r.qid: r for r in prompts.answer_all(q, hits, model).collect()}
    assert got["q1"].parsed_answer == "a duct" and got["q1"].confidence == "high" and got["q1"].prompt_evidence_count == 2 and got["q1"].prompt_variant == "full"
    assert got["q2"].is_defer and "template_leak" in got["q2"].parse_flags and got["q3"].error == "ValueError: no" and got["q3"].parse_flags == ["generation_error"] and got["q4"].prompt_evidence_count == 0
    rows = spark.createDataFrame([("q1", "Q?", "recognition", "easy", False, False, "high", ["x"], ["some  text"], "ANSWER: a", "a", "b")] * 2 + [("q2", None, None, None, None, None, None, None, None, None, None, None)], "qid string, question string, question_type string, difficulty string, should_defer boolean, is_defer boolean, confidence string, format_flags array<string>, retrieved_previews array<string>, raw_response string, parsed_answer string, gold_answer string")
    done, fresh = prompts.judge_all(rows, None, lambda p: '{"verdict": "correct", "reason": "%s", "correctness_score": 5}' % ("some text" in p), "Judge this.")
    assert fresh.count() == 2 and {(r.qid, r.judge_verdict, r.judge_reason) for r in done.collect()} == {("q1", "correct", "True"), ("q2", "correct", "False")} and done.count() == 3
    again, none = prompts.judge_all(rows, fresh, lambda p: 1 / 0, "Judge this.")
    assert none.count() == 0 and again.where("judge_verdict = 'correct'").count() == 3
    failed, _ = prompts.judge_all(rows, None, lambda p: 1 / 0, "Judge this.")
    assert all(r.judge_reason.startswith("Judge call error: ZeroDivisionError") for r in failed.collect())
