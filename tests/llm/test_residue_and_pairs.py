import random

import pytest

from ferrywork.llm import p1_pairs, p1_seeds, p3_residue, p3_seeds

PARTS = ["cystic duct", "cystic artery", "liver bed", "porta hepatis", "gallbladder neck", "omental adhesion", "hepatic flexure", "falciform ligament"]
TOOLS = ["grasper", "hook cautery", "clip applier", "blunt probe", "scissors"]
ENGLISH = ["It is the {a}, held by the {t} and drawn medially.", "The {a} lies behind the {b}, so the {t} should be moved before any division.", "Not yet, because the {a} is covered by fat and only one structure enters the {b}.", "The main concern is a leak, since the {a} could be taken for the {b}.", "DEFER — The view is limited by smoke, so the {a} cannot be confirmed."]
FRENCH = ["Le danger principal est de confondre la voie biliaire avec le lit hépatique.", "La pince tire probablement sur la vésicule dans cette image.", "Il n’est pas possible de distinguer le canal cystique dans cette vue."]
QUESTIONS = ["Which border of the {a} can be traced here?", "What lies directly behind the {t}?", "Is the {a} or the {b} closer to the {t}?"]


def sentence(rng, forms):
    a, b = rng.sample(PARTS, 2)
    return rng.choice(forms).format(a=a, b=b, t=rng.choice(TOOLS))


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        foreign = i % 12 == 0
        q = "Quelle structure se trouve derrière la vésicule dans cette image ?" if foreign else sentence(rng, QUESTIONS)
        g = rng.choice(FRENCH) if foreign else sentence(rng, ENGLISH)
        a = rng.choice(FRENCH) if foreign else sentence(rng, ENGLISH[:4])
        rows.append((i, q, a, g, f'{{"verdict": "correct", "reason": "It names the {rng.choice(PARTS)}.", "correctness_score": 4}}'))
    q = "Which border of the liver bed can be traced here?"
    bad = [
        (1000, q, None, None, None), (1001, q, "  \t", None, None), (1002, q, "N/A", None, None), (1003, q, "ANSWER:", None, None), (1004, q, "…", None, None),
        (1010, q, "It is the cystic duct, held by the", None, None), (1011, q, "The cystic artery lies behind the porta hepatis, so the gras", None, None),
        (1020, q, "I'm sorry, but I can't help with that. Is there anything else I can do for you?", None, None), (1021, q, "As an AI assistant, I am not able to interpret medical images.", None, None),
        (1030, q, q, None, None), (1031, q, "You asked: Which border of the liver bed can be traced here", None, None), (1032, q, q.upper(), None, None),
        (1040, q, FRENCH[0], None, None), (1041, q, FRENCH[1] + " " + FRENCH[2], None, None),
        (1050, q, "It is the cystic duct, held by the grasper and drawn medially", None, None), (1051, None, "It is the cystic duct, held by the grasper and drawn medially.", None, None), (1052, q, "The liver bed", None, None),
        (1060, q, "{{short_answer}}", None, None), (1061, q, "Lorem ipsum dolor sit amet consectetur elit magna vitae", None, None), (1062, q, "Please enable JavaScript to continue.", None, "500 Internal Server Error"),
        (1063, q, "The liver bed is next to {{ structure_name }} and the grasper is in use.", None, '{"verdict": "[verdict]", "reason": "[short reason]"}'), (1064, q, "The [grasper] near the liver bed", None, "Verdict: correct. It names the liver bed."),
        (1010, q, "It is the cystic duct, held by the", None, None), (1070, q, " ".join(ENGLISH[0].format(a="liver bed", t="grasper") for _ in range(400)), None, None),
    ]
    return spark.createDataFrame([*rows, *bad], "result_id long, question string, parsed_answer string, gold_answer string, raw_judge_response string").cache()


def test_residue(results):
    got = {tuple(r) for r in p3_residue.found(results).collect()}
    assert {(1060, "parsed_answer"), (1061, "parsed_answer"), (1062, "parsed_answer"), (1062, "raw_judge_response"), (1063, "parsed_answer"), (1063, "raw_judge_response")} <= got
    assert len(got) <= 8 and (1064, "parsed_answer") not in got
    found = p3_residue.find_residue(results)
    clean = p3_residue.exclude_residue(results, found)
    assert clean.columns == results.columns and clean.where("result_id = 1060").first().parsed_answer is None and clean.count() == results.count()


def test_generated_residue_is_told_from_prose_held_out(results):
    scorer = p3_residue.Scorer(*p3_residue.fit(results))
    for kind in p3_residue.KINDS:
        texts = p3_seeds.residue(kind, 400, seed=99)
        assert sum(k is not None for k in scorer.kinds(texts)) >= 0.85 * len(texts)
    rng = random.Random(77)
    assert sum(k is not None for k in scorer.kinds([sentence(rng, ENGLISH) for _ in range(300)])) <= 3


def test_one_slot_in_a_long_field(results):
    scorer, rng = p3_residue.Scorer(*p3_residue.fit(results)), random.Random(5)
    for size in (200, 800, 2000):
        for left, right in p3_seeds.DELIMITERS:
            for name in ("value", "short_answer", "reason"):
                words = " ".join(sentence(rng, ENGLISH) for _ in range(size // 60)).split(" ")
                assert scorer.kinds([" ".join(words)]) == [None]
                words.insert(rng.randrange(len(words)), left + name + right)
                assert scorer.kinds([" ".join(words)]) == ["template"], words
    sound = " ".join(sentence(rng, ENGLISH) for _ in range(8))
    for x in ("[grasper]", "the [liver bed]", "[1]", "[sic]", "between 5 % and 20 %", "(value)", '{"verdict": "correct"}'):
        assert scorer.kinds([f"{sound} {x} {sound}"]) == [None], x


def test_defects(results):
    got = {r.result_id: r.defect_type for r in p1_pairs.found(results).collect()}
    want = {**dict.fromkeys(range(1000, 1005), "empty"), 1010: "truncated", 1011: "truncated", 1020: "refusal", 1021: "refusal", 1030: "copies_question", 1031: "copies_question", 1032: "copies_question", 1040: "other_language", 1041: "other_language"}
    assert {k: got.get(k) for k in want} == want
    assert not {1050, 1051, 1060, 1061, 1062, 1070} & set(got)
    assert sum(k < 1000 for k in got) <= 5


def test_held_out_sequences_are_tagged(results):
    pairs = [(r.question, r.gold_answer) for r in results.where("gold_answer is not null").select("question", "gold_answer").distinct().orderBy("question", "gold_answer").collect()]
    counts = p1_pairs.count_rows(results.selectExpr("question", "gold_answer as gold", "parsed_answer as answer"))
    language = p1_pairs.fit_language(counts)
    features = p1_pairs.Features(language)

    def make(ps, seed):
        made = p1_pairs.training_pairs(ps, language, seed)
        return p1_pairs.training_set(features, made, p1_pairs.training_counts(counts, [a for _, a, _, _ in made]))

    field = p1_pairs.Field.fit(*make(pairs[::2], 5))
    dense, ids, owner, gold, lengths = make(pairs[1::2], 6)
    e, right, at = field.emissions(dense, ids, owner), 0, 0
    for n in lengths:
        right += int((field.viterbi(e[None, at : at + n])[0] == gold[at : at + n]).sum())
        at += n
    assert right >= 0.93 * len(gold)


def test_empty_tables_and_marks(results):
    none = results.limit(0)
    assert p3_residue.found(none).count() == 0 and p1_pairs.found(none).count() == 0
    assert all(p1_pairs.is_empty(x) for x in (None, "", "​", "- -", "null", "| CONFIDENCE:", "Answer: n/a")) and not any(p1_pairs.is_empty(x) for x in ("Yes", "No.", "a duct", "none of these ducts"))
    assert set(p1_seeds.FUNCTION_WORDS) == set(p1_pairs.LANGUAGES)
