import random
from fractions import Fraction

import pytest

from ferrywork.llm import p7_mix, p8_subject

TOPICS = {"law": ["court", "negligence", "consent", "tribunal"], "sport": ["training", "athlete", "league", "goal"], "food": ["fasting", "fibre", "protein", "meal"]}


def test_pfair_lag_stays_below_one_block():
    rng = random.Random(1)
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, 100), 4))
        shares = [b - a for a, b in zip([0, *cuts], [*cuts, 100], strict=True)]
        w = {f"s{i}": Fraction(x, 100) for i, x in enumerate(shares)}
        got, used = p7_mix.pfair(w, 300), dict.fromkeys(w, 0)
        for t, s in enumerate(got, 1):
            used[s] += 1
            assert all(abs(used[k] - w[k] * t) < 1 for k in w)


def test_mix_report(spark):
    rng = random.Random(2)
    sizes = [(i, "a", rng.randint(1, 9)) for i in range(3000)] + [(10_000 + i, "b", 5) for i in range(100)] + [(20_000, "c", 50), (20_001, None, 7), (20_002, "a", 0)]
    sized = spark.createDataFrame(sizes, "id long, source string, size long")
    targets = spark.createDataFrame([("A ", 0.5, 1), ("b", 0.3, 4), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    uses, report = p7_mix.mix(sized, targets, slots=200, groups=8)
    got = {r.source: r for r in report.collect()}
    total = sum(r.size_used for r in got.values())
    assert abs(got["b"].actual_share - 0.375) < 0.01 and got["none"].actual_share == 0 and got["c"].uses == 0 and got[None].target_share == 0
    assert got["b"].repeats_used == 4 and got["b"].size_used <= 2000 and got["a"].repeats_used == 1 and total > 5000
    per = {r.id: r.n for r in uses.groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert max(per.values()) <= 4
    slots = {}
    for r in uses.collect():
        slots.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in slots.values())
    assert p7_mix.mix(sized.limit(0), targets)[1].where("uses > 0").count() == 0


def scheduled_mix(spark):
    """Sized documents, one source due for less than a slot, and their targets."""
    rng = random.Random(4)
    sizes = [(i, "a", rng.randint(1, 9)) for i in range(2000)] + [(10_000 + i, "b", rng.randint(1, 9)) for i in range(1200)] + [(20_000 + i, "c", 3) for i in range(40)]
    targets = [("a", 0.601, 1), ("b", 0.397, 2), ("c", 0.002, 1)]
    return spark.createDataFrame(sizes, "id long, source string, size long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_report_is_of_the_scheduled_mixture(spark):
    uses, report = p7_mix.mix(*scheduled_mix(spark), slots=200, groups=4)
    got, mixture = {r.source: r for r in report.collect()}, sorted(uses.collect(), key=lambda r: r.slot)
    weights, total = {"a": 0.601, "b": 0.397, "c": 0.002}, sum(r.size_used for r in got.values())
    slots, sums, reached, furthest = {}, dict.fromkeys(weights, 0), 0, dict.fromkeys(weights, 0.0)
    for r in mixture:
        assert slots.setdefault(r.slot, [r.source, 0])[0] == r.source
        slots[r.slot][1] += r.size
    for _, (source, size) in sorted(slots.items()):
        sums[source], reached = sums[source] + size, reached + size
        furthest = {s: max(furthest[s], abs(sums[s] - w * reached)) for s, w in weights.items()}
    block = -(-total // 200)
    assert len(slots) <= 203 and max(size for _, size in slots.values()) <= block + 8
    for s, w in weights.items():
        assert got[s].size_used == sums[s] > 0 and abs(sums[s] - w * total) <= 9
        assert abs(got[s].max_lag - furthest[s]) < 1e-6 and furthest[s] < block + 27


def test_the_schedule_decides_the_report(spark, monkeypatch):
    documents, targets = scheduled_mix(spark)
    told = lambda: {r.source: r for r in p7_mix.mix(documents, targets, slots=200, groups=4)[1].collect()}
    fair, pfair = told(), p7_mix.pfair
    monkeypatch.setattr(p7_mix, "pfair", lambda *a: sorted(pfair(*a)))
    in_turn = told()
    assert in_turn["a"].size_used == fair["a"].size_used and in_turn["a"].max_lag > 20 * fair["a"].max_lag
    monkeypatch.setattr(p7_mix, "pfair", lambda *a: ["" if s == "b" else s for s in pfair(*a)])
    without = told()
    assert without["b"].uses == without["b"].size_used == 0 and without["a"].actual_share > 0.99 and without["b"].max_lag > 1000


def test_pfair_with_blocks():
    w = {"a": Fraction(1, 2), "b": Fraction(999, 2000), "c": Fraction(1, 2000)}
    got = p7_mix.pfair(w, 10, {"a": 5, "b": 5, "c": 1})
    assert sorted(got) == ["a"] * 5 + ["b"] * 5 + ["c"] and "c" not in p7_mix.pfair(w, 10) and p7_mix.pfair(w, 10, {}) == []


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", " A"), (2, None, None), (3, "", "a"), (4, "word " * 20000, "a")], "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as id")
    got = {r.id: (r.source, r.size) for r in p7_mix.token_sizes(df).collect()}
    assert got[1] == ("a", 2) and got[2] == (None, 0) and got[3] == ("a", 0) and got[4][1] > 15000


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    forms = ["What matters here is {}.", "Several departments have written about {}.", "The last paragraph returns to {}."]
    none = ["This note was revised in May.", "Details follow in the next section."]
    docs, labels, truth = [], [], {}
    for i in range(500):
        topics = rng.sample(list(TOPICS), rng.choice((1, 1, 2)))
        sents = [rng.choice(forms).format(rng.choice(TOPICS[t])) for t in topics for _ in range(4)] + [rng.choice(none)]
        rng.shuffle(sents)
        docs.append((i, " ".join(sents)))
        truth[i] = set(topics)
        if i % 3 == 0:
            labels += [(i, t) for t in topics]
    docs += [(900, None), (901, " "), (902, "Nothing known at all"), (0, docs[0][1]), (903, "What matters here is court. " * 3000)]
    labels += [(1, "food"), (2, None), (77777, "law"), (3, "unknown")]
    areas = [(t, "") for t in TOPICS]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' as subject", "0 as id"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame(areas, "subject string, description string"), truth


def test_subjects(corpus):
    docs, labels, areas, truth = corpus
    got = {}
    for r in p8_subject.found(docs, labels, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 3]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    assert 900 not in got and 901 not in got and len(got[902]) == 1 and got[903] == {"law"} and all(1 <= len(v) <= 3 for v in got.values())


def test_subjects_without_labels_or_documents(corpus):
    docs, labels, areas, _ = corpus
    assert p8_subject.found(docs.limit(0), labels, areas).count() == 0
    assert {r.subject for r in p8_subject.found(docs, labels.limit(0), areas).collect()} == {"food"}
