import random

import pytest

from ferrywork.llm import p2_scans as P

FORMS = ["The {a} should be free of adhesions before the {t} is advanced beyond the {b}.", "Most reports of bleeding describe a friable {a} that had been taken for the {b}.", "During washout the {a} is pulled medially so that the {b} comes into line with the {t}.", "A second look at the {a} took less time and changed the plan for the {b} in older patients."]
PARTS = ["gallbladder fundus", "cystic artery", "hepatic flexure", "peritoneal fold", "common bile duct", "umbilical fissure"]
TOOLS = ["suction irrigator", "second grasper", "hook cautery"]


def prose(rng, n):
    out = []
    for _ in range(n):
        a, b = rng.sample(PARTS, 2)
        out.append(rng.choice(FORMS).format(a=a, b=b, t=rng.choice(TOOLS)))
    return " ".join(out)


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(9)
    rows = [(f"c{i}", prose(rng, 6), "Atlas of Safe Exposure", "Methods", 10, 11) for i in range(300)]
    body = "The gallbladder fundus should be free of adhesions before the\nsuction irrigator is advanced beyond the cystic artery. During washout the"
    tail = "hepatic flexure is pulled medially so that the cystic artery\ncomes into line with the hook cautery."
    rows += [
        ("hyphen", body.replace("adhesions before the\n", "adhe-\nsions before the\n") + "\n" + tail, "Atlas of Safe Exposure", "Methods", 30, 31),
        ("soft", body.replace("irrigator is", "irri­\ngator is") + "\n" + tail, None, None, None, None),
        ("misread", body.replace("gallbladder", "ga1lbladder").replace("cystic artery", "cystic arfery") + "\n" + tail, "Atlas of Safe Exposure", "Methods", 30, 31),
        ("number", body + "\n30\n" + tail, "Atlas of Safe Exposure", "Methods", 30, 30),
        ("dressed", body + "\n- 31 -\n" + tail, "Atlas of Safe Exposure", "Methods", 30, 31),
        ("header", body + "\nATLAS OF SAFE EXPOSURE    31\n" + tail, "Atlas of Safe Exposure", "Methods", 31, 30),
        ("sound", body + "\n" + tail + "\n\n- one item here\n- another item\n\nPre- and postoperative findings agreed.", "Atlas of Safe Exposure", "Methods", 30, 31),
        ("table", "Frames per case\n2152\n" + body + "\n" + tail, "Atlas of Safe Exposure", "Methods", 30, 31),
        ("null", None, None, None, None, None), ("empty", "", None, None, None, None), ("long", (body + "\n" + tail + "\n") * 300, None, None, None, None),
        ("number", body + "\n30\n" + tail, "Atlas of Safe Exposure", "Methods", 30, 30),
    ]
    return spark.createDataFrame(rows, "chunk_id string, text string, doc_title string, section_title string, page_start int, page_end int").selectExpr("*", "'x' as id", "'y' as kinds", "1 as first").cache()


def test_kinds_and_repair(chunks):
    got = {r.id: r for r in P.repair_scans(chunks).collect()}
    assert {k: list(r.kinds) for k, r in got.items()} == {
        "hyphen": ["hyphenation"], "soft": ["hyphenation"], "misread": ["misread"], "number": ["page_number"], "dressed": ["page_number"], "header": ["running_header", "page_number"],
    }
    want = "The gallbladder fundus should be free of adhesions before the suction irrigator is advanced beyond the cystic artery. During washout the hepatic flexure is pulled medially so that the cystic artery comes into line with the hook cautery."
    assert {r.repaired for r in got.values()} == {want}


def test_found_is_distinct_and_empty_table(chunks):
    assert P.found(chunks).count() == 7 and P.found(chunks.limit(0)).count() == 0


def test_a_header_of_one_document_is_found_in_a_large_corpus(spark, chunks):
    # 3 lines of one document among 4,000,000 others: a share of 2e-6 would ask for 8
    lines = [("otherline\tn", 4_000_000), ("ownheader\ti", 3), ("mixedline\ti", 2), ("mixedline\tn", 12), ("rareline\ti", 1), ("edgeline\ti", 3), ("edgeline\tn", 17)]
    assert {r.bones for r in P.edge_lines(spark.createDataFrame(lines, "a string, n long")).collect()} == {"ownheader", "edgeline"}


def test_lines_too_many_to_broadcast_are_joined(spark, chunks):
    page = "The gallbladder fundus should be free of adhesions before the\nsuction irrigator is advanced beyond the cystic artery. During washout the\nVale Institute Quarterly\nhepatic flexure is pulled medially so that the cystic artery\ncomes into line with the hook cautery."
    rows = [(f"v{i}", page, None, "Methods", 30, 31) for i in (0, 1, 1)]
    more = chunks.select("chunk_id", "text", "doc_title", "section_title", "page_start", "page_end").unionByName(spark.createDataFrame(rows, "chunk_id string, text string, doc_title string, section_title string, page_start int, page_end int"))
    got = lambda limit: sorted((r.id, *r.kinds, r.repaired) for r in P.repair_scans(more, broadcast_limit=limit).collect())
    joined = got(0)
    assert [r[:-1] for r in joined if r[0].startswith("v")] == [("v0", "running_header"), ("v1", "running_header"), ("v1", "running_header")]
    assert joined == got(P.BROADCAST_LIMIT)


def test_skeletons_and_edits():
    assert P.skeleton("Vale Institute Reports 2015") == P.skeleton("VaIe lnstitiite Reporfs") == P.skeleton("vale institute reports")
    assert "gallbladder" in P.originals("ga1lbladder") and "common" in P.originals("cornmon") and "said" not in P.originals("cat")


def test_vectors_bring_like_words_together():
    import numpy as np

    words = ["a", "b", "x", "y", "c1", "c2"]
    left, right, n = [], [], []
    for w, c in ((0, 4), (1, 4), (2, 5), (3, 5)):
        left.append(w), right.append(c), n.append(200.0)
    v, _ = P.train_vectors(words, np.array([100.0] * 6), np.array(left), np.array(right), np.array(n))
    cos = lambda i, j: float(v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j])))
    assert cos(0, 1) > cos(0, 2) and cos(2, 3) > cos(1, 3)


def test_context_decides_between_candidates():
    import numpy as np

    counts = {"lined": 900, "fined": 900, "wall": 900, "court": 900, "the": 90_000}
    places = {w: i for i, w in enumerate(counts)}
    v, u = np.zeros((5, 2), np.float32), np.zeros((5, 2), np.float32)
    v[places["lined"]] = u[places["wall"]] = (3, 0)
    v[places["fined"]] = u[places["court"]] = (0, 3)
    corrector = P.Corrector(counts, 0.0, places, v, u)
    assert set(corrector.candidates("tlned")) == {"lined", "fined"}
    assert corrector.correct("tlned", ["the", "wall"]) == "lined" and corrector.correct("tlned", ["the", "court"]) == "fined"


def test_counts_do_not_depend_on_partitions(chunks):
    models = [P.fit(chunks.select("text").repartition(n)) for n in (1, 7)]
    assert models[0][0] == models[1][0] and models[0][2] == models[1][2] and (models[0][3] == models[1][3]).all()
