import random

from ferrywork.llm import p6_leak as P


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_myers_against_table():
    rng = random.Random(2)
    for _ in range(200):
        p = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        t = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        want = [min(edits(p, t[s : e + 1]) for s in range(e + 2)) for e in range(len(t))]
        assert P.myers(p, t) == want


def test_seed_length_holds_by_pigeonhole():
    assert P.seed_length() == 6 and P.window_lengths() == [22, 24, 32, 40]


def brute(doc, item):
    for n in range(22, len(item) + 1):
        for i in range(len(item) - n + 1):
            if min(P.myers(item[i : i + n], doc), default=99) <= n // 8:
                return True
    return False


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(24, 70))] for _ in range(6)]
    docs = []
    for k in range(90):
        item = rng.choice(items)
        n = rng.randint(14, 40)
        s = rng.randint(0, max(0, len(item) - n))
        part = item[s : s + n]
        for _ in range(rng.randint(0, max(1, n // 5))):
            i = rng.randrange(len(part))
            part = part[:i] + rng.choice(([], ["x"], [part[i], "y"])) + part[i + 1 :]
        around = [rng.choice(vocabulary) for _ in range(30)]
        docs.append((k, " ".join([*around[:15], *part, *around[15:]])))
    d = spark.createDataFrame([*docs, (500, None), (501, ""), (0, docs[0][1])], "doc_id long, text string")
    i = spark.createDataFrame([*[(j, " ".join(w)) for j, w in enumerate(items)], (9, None), (10, "too short")], "item_id long, text string")
    got = {tuple(r) for r in P.find_leaks(d, i).collect()}
    want = {(k, j) for k, t in docs for j, w in enumerate(items) if brute(P.words(t), w)}
    assert got == want and len(want) > 10
    assert {tuple(r) for r in P.find_leaks(d, i, max_item_words=60).collect()} == want


def test_disguises_and_empty_tables(spark):
    item = "The fibrotic hepatic flexure meets the liver bed five millimetres from the clip applier inferiorly which of the mobile gallbladder body may be traced next"
    dressed = "<p>THE fibrotic​ hepatic&nbsp;flexure — meets the <b>liver</b>\n bed, five millimetres from the cl­ip applier; inferiorly (which) of the “mobile” gallbladder body may be traced next</p>"
    d = spark.createDataFrame([(1, dressed, "extra")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in P.find_leaks(d, i).collect()] == [(1, 7)]
    assert P.find_leaks(d.limit(0), i).count() == 0 and P.find_leaks(d, i.limit(0)).count() == 0
