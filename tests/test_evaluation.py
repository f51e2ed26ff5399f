import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.operators import frames, metrics, observability


def test_confusion_without_rows_and_with_nulls(spark):
    df = spark.createDataFrame([(True, True), (True, None), (None, True), (False, False)], "r boolean, p boolean")
    got = metrics.confusion(df, "r", "p").first()
    assert (got.tp, got.fp, got.fn, got.tn, got.precision, got.recall) == (1, 1, 1, 1, 0.5, 0.5)
    empty = metrics.confusion(df.limit(0), "r", "p").first()
    assert (empty.tp, empty.f1, empty.accuracy) == (0, 0.0, 0.0)


def test_robust_z_cases(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, float("nan"), 5.0), (4, 4.0, 5.0), (5, None, 5.0)], "i int, x double, c double")
    got = {r.i: r for r in observability.robust_z(df, ["x", "c"]).collect()}
    x = np.array([1.0, 2.0, 4.0])
    iqr = np.percentile(x, 75) - np.percentile(x, 25)
    assert abs(got[1].z_x - (1 - 2) / iqr) < 1e-12 and got[3].z_x is None and got[5].z_x is None and got[1].z_c == 0.0


def test_tertiles_match_pandas(spark):
    for n in (1, 2, 9, 10, 11, 12, 50):
        s = pd.Series([random.Random(n).choice([0.1, 0.2, 0.3, 0.4]) for _ in range(n)])
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(s)], "i int, s double")
        got = {r.i: r.t for r in observability.tertiles(df, "s", "i", "t").collect()}
        if n >= 3:
            want = pd.qcut(s.rank(method="first"), 3, labels=["low", "mid", "high"])
            assert [got[i] for i in range(n)] == list(want)


def test_sample_bootstrap_and_verdict(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "id int, g string")
    t = spark.createDataFrame([("a", 5), ("b", 100)], "g string, target int")
    counts = {r.g: r["count"] for r in observability.stratified_sample(df, ["g"], t, "id").groupBy("g").count().collect()}
    assert counts == {"a": 5, "b": 25}
    v = spark.createDataFrame([("a", 1.0)] * 30 + [("a", 0.0)] * 70 + [("b", None)], "g string, v double")
    got = observability.bootstrap_interval(v, ["g"], "v").collect()
    assert len(got) == 1 and got[0].n == 100 and 0.2 < got[0].ci_low < 0.3 < got[0].ci_high < 0.4
    s = spark.createDataFrame([("m", "low", 0.5), ("m", "mid", 0.6), ("m", "high", 0.7), ("n", "low", 0.5)], "model_id string, stratum string, accuracy double")
    assert {r.model_id: r.verdict for r in observability.verdict(s).collect()} == {"m": "PASS", "n": "INCOMPLETE"}


def test_score_predictions(spark):
    p = spark.createDataFrame([(0, "c1", "Yes"), (0, "c2", "uncertain"), (7, "c1", "no")], "pilot_row_index int, criterion string, parsed_answer string")
    m = spark.createDataFrame([(0, "r0", 1, 0, 0)], "pilot_row_index int, record_id string, c1 int, c2 int, c3 int")
    got = {(r.pilot_row_index, r.criterion): r for r in observability.score_predictions(p, m).collect()}
    assert got[0, "c1"].strict_correct == 1.0 and got[0, "c2"].answered_correct is None and got[0, "c2"].strict_correct == 0.0 and got[7, "c1"].gt is None


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [[rng.getrandbits(63) - 2**62 for _ in range(4)] for _ in range(12)]
    rows = [(i, list(w)) for i, w in enumerate(words)]
    for k in range(20):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 10)):
            w[rng.randrange(4)] ^= 1 << rng.randrange(62)
        rows.append((100 + k, w))
    rows += [(200, list(words[0])), (201, list(words[0])), (300, None)]
    df = spark.createDataFrame(rows, "id long, h array<long>")
    got = {(r.a, r.b): r.distance for r in frames.near_duplicates(df, "id", "h").collect()}
    kept = {}
    for i, w in rows:
        if w is not None:
            kept.setdefault(tuple(w), []).append(i)
    dist = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    heads = {w: min(ids) for w, ids in kept.items()}
    want = {(min(a, b), max(a, b)): dist(x, y) for x, a in heads.items() for y, b in heads.items() if a < b and dist(x, y) < 8}
    want |= {(heads[w], i): 0 for w, ids in kept.items() for i in ids if i != heads[w]}
    assert got == want


def test_candidates_and_selection(spark):
    rng = random.Random(6)
    stats = "brightness contrast sharpness saturation bright_fraction dark_fraction specular_fraction quality_score".split()
    rows = []
    for i in range(400):
        classes = {c: rng.random() * 0.3 for c in rng.sample(schema.FRAME_CLASSES, rng.randint(1, 9))}
        rows.append((f"f{i}", f"v{i % 30}", i * 7, classes, *[rng.random() * (200 if s in ("brightness", "sharpness") else 30 if s in ("contrast", "quality_score") else 0.4) for s in stats]))
    df = spark.createDataFrame(rows, "source string, video_id string, frame_index int, classes_detected map<string,double>, " + ", ".join(f"{s} double" for s in stats))
    got = frames.candidates(df).collect()
    assert {r.difficulty for r in got} <= {"easy", "medium", "hard"} and all(0 <= r.defer_score <= 1 and len(r.question_type_ranking) == 5 for r in got)
    picks = frames.select_frames([{**r.asDict(recursive=True), "scores": {k: r[f"score_{k}"] for k in schema.QUESTION_TYPES}} for r in got])
    per = pd.Series([p["video_id"] for p in picks]).value_counts()
    assert per.max() <= schema.PER_VIDEO and len({p["source"] for p in picks}) == len(picks) <= 100
    issues = {r.issue: r.n for r in frames.validate_selection(spark.createDataFrame([(p["video_id"], p["assigned_difficulty"], p["assigned_question_type"], p["defer_score"]) for p in picks], "video_id string, assigned_difficulty string, assigned_question_type string, defer_score double")).collect()}
    assert issues["video_over_limit"] == 0


def test_cache_and_resume(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    cache = spark.createDataFrame([("a", "correct"), ("a", "correct")], "cache_key string, judge_verdict string")
    hit, miss = metrics.with_cache(rows, cache)
    assert [r.cache_key for r in hit.collect()] == ["a"] and [r.cache_key for r in miss.collect()] == ["b"]
    assert metrics.resume(cache, rows, ["cache_key"]).count() == 1
    assert metrics.flag_histogram(spark.createDataFrame([], "raw_response string, parsed_answer string, is_defer boolean, confidence string")).agg(F.sum("n")).first()[0] == 0


def test_frame_paths(spark):
    df = spark.createDataFrame([("/a/video07/clip/f_12_endo.png",), ("/a/b/x.png",)], "p string")
    assert [tuple(r) for r in df.select(frames.video_id(F.col("p")), frames.frame_index(F.col("p"))).collect()] == [("video07", 12), ("b", -1)]


def test_summaries_of_scored_predictions(spark):
    from ferrywork.operators import observability as O

    manifest = spark.createDataFrame([(i, f"r{i}", 1, 0, i % 2, ["low", "mid", "high"][i % 3], ["high", "mid", "low"][i % 3]) for i in range(30)], "pilot_row_index int, record_id string, c1 int, c2 int, c3 int, obs_visual_stratum string, obs_construct_stratum string")
    preds = [("m", i, c, "yes" if i % 3 else "uncertain", f"f{i}") for i in range(30) for c in ("c1", "c2", "c3")]
    scored = O.score_predictions(spark.createDataFrame(preds, "model_id string, pilot_row_index int, criterion string, parsed_answer string, frame_path string").withColumn("record_id", F.concat(F.lit("r"), F.col("pilot_row_index").cast("string"))), manifest)
    got = {r.stratum: r for r in O.summarize(scored).collect()}
    assert got["low"].strict_accuracy == 0.0 and got["low"].answered_accuracy is None and got["low"].uncertain_rate == 1.0 and got["mid"].yes_rate == 1.0 and got["mid"].n_frames == 10 and got["mid"].n_predictions == 30
    assert got["mid"].strict_ci_low <= got["mid"].strict_accuracy <= got["mid"].strict_ci_high and abs(got["mid"].strict_accuracy - 0.5) < 1e-9
    assert O.summarize_all(scored).count() == 6 and {r.n for r in O.summarize_by_criterion(scored).collect()} == {10}
    assert O.error_examples(scored, 4).groupBy("model_id", "example").count().where("count > 4").count() == 0
    v = O.verdict(O.summarize(scored).select("model_id", "stratum", F.col("strict_accuracy").alias("accuracy"))).first()
    assert v.verdict == "PASS"


def test_bootstrap_interval_against_resampling(spark):
    import numpy as np

    from ferrywork.operators import observability as O

    ones, n = 37, 120
    df = spark.createDataFrame([("g", float(i < ones)) for i in range(n)] + [("g", None)], "k string, v double")
    r = O.bootstrap_interval(df, ["k"], "v").first()
    rng, values = np.random.default_rng(7), np.array([float(i < ones) for i in range(n)])
    means = [rng.choice(values, n).mean() for _ in range(4000)]
    assert r.n == n and abs(r.ci_low - np.percentile(means, 2.5)) < 0.02 and abs(r.ci_high - np.percentile(means, 97.5)) < 0.02


def test_pilot_sample_and_joins(spark):
    import pytest

    from ferrywork.operators import metrics
    from ferrywork.operators import observability as O

    rows = [(f"r{i}", ["low", "mid", None][i % 3], ["no", "partial", "achieved"][i % 7 % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "record_id string, obs_visual_stratum string, cvs_state string")
    got = O.pilot_sample(df, per_stratum=40, targets={"no": 10, "partial": 10, "achieved": 10})
    counts = {(r.obs_visual_stratum, r.cvs_state): r["count"] for r in got.groupBy("obs_visual_stratum", "cvs_state").count().collect()}
    assert got.count() == 80 and all(n >= 10 for n in counts.values()) and sorted(r.pilot_row_index for r in got.collect()) == list(range(80))
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, b string")
    assert [tuple(r) for r in metrics.assert_one_to_one(a, b, "k").collect()] == [(1, "x", "y")]
    with pytest.raises(Exception, match="not exactly one row"):
        metrics.assert_one_to_one(b, a, "k").collect()
    cache = spark.createDataFrame([("k1", 1, "old"), ("k1", 2, "new")], "cache_key string, at int, v string")
    hit, miss = metrics.with_cache(spark.createDataFrame([("k1",), ("k2",)], "cache_key string"), cache, newest="at")
    assert [r.v for r in hit.collect()] == ["new"] and [r.cache_key for r in miss.collect()] == ["k2"]


def test_selection_keeps_its_limits(spark):
    import random

    from ferrywork import schema
    from ferrywork.operators import frames

    rng = random.Random(4)
    rows = []
    for i in range(1500):
        scores = {t: round(rng.uniform(0.2, 0.9), 4) for t in schema.QUESTION_TYPES}
        rows.append({"source": f"s{i}", "video_id": f"v{i % 40}", "frame_index": (i // 40) * 30, "difficulty": rng.choice(schema.DIFFICULTIES), "question_type_ranking": sorted(scores, key=scores.get, reverse=True), "scores": scores, "defer_score": rng.uniform(0, 0.7), "quality_score": rng.uniform(5, 25), "phash": [rng.getrandbits(63) for _ in range(4)]})
    got = frames.select_frames(rows)
    per, buckets = {}, {}
    for o in got:
        per.setdefault(o["video_id"], []).append(o["frame_index"])
        b = (o["assigned_difficulty"], o["assigned_question_type"])
        buckets[b] = buckets.get(b, 0) + 1
    assert len(got) == 100 and all(buckets.get(b, 0) == n for b, n in schema.BUCKETS.items()) and max(map(len, per.values())) <= schema.PER_VIDEO
    assert all(b - a >= schema.RELAXED_GAP for v in per.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))
    assert sum(o["defer_score"] >= 0.5 for o in got) >= schema.DEFERRED and len({o["source"] for o in got}) == 100 and frames.select_frames(rows) == got and frames.select_frames([]) == []
    few = frames.select_frames(rows[:60])
    assert len(few) <= 60 and len({o["source"] for o in few}) == len(few)
    cols = "source string, video_id string, frame_index int, assigned_difficulty string, assigned_question_type string, question_type_ranking array<string>, scores map<string,double>, defer_score double, classes_detected map<string,double>, phash array<bigint>, has_mask boolean"
    df = spark.createDataFrame([(o["source"], o["video_id"], o["frame_index"], o["assigned_difficulty"], o["assigned_question_type"], o["question_type_ranking"], o["scores"], o["defer_score"], {"liver": 0.2}, o["phash"], True) for o in got], cols)
    saved = frames.save_order(df)
    assert [r.qid for r in saved.orderBy("position").limit(2).collect()] == ["Q001", "Q002"] and saved.first().notes.startswith("Auto-selected for ") and frames.blueprint(saved).count() == 100
    assert {r.issue: r.n for r in frames.validate_selection(df).collect()} == {"no_mask": 0, "near_duplicates": 0, "video_over_limit": 0, "few_videos": 0, "bucket_off_target": 0, "deferrable_short": 0}


def test_class_features_follow_their_thresholds(spark):
    from ferrywork.operators import frames

    df = spark.createDataFrame([({"gallbladder": 0.0051, "liver": 0.0051, "cystic_duct": 0.0021, "grasper": 0.0011, "black_background": 0.5, "fat": 0.0029},), ({},)], "c map<string,double>")
    a, b = df.select(*[v.alias(k) for k, v in frames.class_features(F.col("c")).items()]).collect()
    assert a.cvs_relevant and a.n_tools == 1 and a.n_classes == 2 and a.n_anatomy == 2 and a.bg_area == 0.5 and not b.cvs_relevant and b.anatomy_area == 0.0
