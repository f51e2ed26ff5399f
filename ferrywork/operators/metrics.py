"""Aggregates over result rows: confusion matrices, the three tiers, histograms, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.functions import answers, overlap


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def median_or_zero(c: Column) -> Column:
    return F.coalesce(F.median(c), F.lit(0.0))


def confusion(df: DataFrame, reference: str | Column, predicted: str | Column, *keys: str) -> DataFrame:
    """``tp, fp, fn, tn, precision, recall, f1, accuracy`` of two flags (null is false), by ``keys``; one pass."""
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    r, p = col(reference), col(predicted)
    counts = df.groupBy(*keys).agg(F.count_if(r & p).alias("tp"), F.count_if(~r & p).alias("fp"), F.count_if(r & ~p).alias("fn"), F.count_if(~r & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    return counts.select(*keys, tp, fp, fn, tn, prec.alias("precision"), rec.alias("recall"), safe_div(2 * prec * rec, prec + rec).alias("f1"), safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def tier1(results: DataFrame) -> DataFrame:
    """One row of totals, latency and retrieval figures. Latencies that are null or 0 are left out."""
    lat = F.when(F.col("latency_s") != 0, F.col("latency_s"))
    top = F.get("retrieved_scores", F.lit(0))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~flag("is_defer")).alias("answered"), F.count_if(flag("is_defer")).alias("deferred"), F.count_if(flag("should_defer")).alias("should_defer_gt"),
        mean_or_zero(lat).alias("latency_mean"), median_or_zero(lat).alias("latency_median"), F.coalesce(F.min(lat), F.lit(0.0)).alias("latency_min"), F.coalesce(F.max(lat), F.lit(0.0)).alias("latency_max"),
        mean_or_zero(F.coalesce(F.size("retrieved_chunks"), F.lit(0))).alias("avg_chunks"), mean_or_zero(top).alias("avg_top_score"),
    )


def by_group(results: DataFrame, key: str) -> DataFrame:
    """``key, count, answered, deferred, should_defer_gt, avg_latency_s``; a null key is ``unknown``, a null latency 0."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return results.groupBy(F.coalesce(key, F.lit("unknown")).alias(key)).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(~flag("is_defer")).alias("answered"), F.count_if(flag("is_defer")).alias("deferred"), F.count_if(flag("should_defer")).alias("should_defer_gt"),
        F.avg(F.coalesce("latency_s", F.lit(0.0))).alias("avg_latency_s"),
    )


def grouped_sets(results: DataFrame) -> DataFrame:
    """Counts by type, by difficulty and in all, in one aggregation over grouping sets."""
    rows = results.select(F.coalesce("question_type", F.lit("unknown")).alias("question_type"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("is_defer", F.lit(False)).alias("d"))
    sets = rows.groupingSets([["question_type"], ["difficulty"], []], "question_type", "difficulty")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("d").alias("deferred"))


def flag_histogram(results: DataFrame) -> DataFrame:
    """``flag, n`` of the format checks; all flags are listed."""
    flags = answers.format_flags(*[F.col(c) for c in ("raw_response", "parsed_answer", "is_defer", "confidence")])
    found = results.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    every = results.sparkSession.createDataFrame([(f,) for f in schema.FORMAT_FLAGS], "flag string")
    return every.join(F.broadcast(found), "flag", "left").select("flag", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confidence_histogram(results: DataFrame) -> DataFrame:
    """``confidence, n``; all four levels are listed."""
    found = results.groupBy(answers.normal_confidence(F.col("confidence")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    every = results.sparkSession.createDataFrame([(c,) for c in schema.CONFIDENCES], "confidence string")
    return every.join(F.broadcast(found), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tier2_rows(results: DataFrame) -> DataFrame:
    """Overlap figures of answered rows with a gold answer."""
    rows = results.where(~F.coalesce("is_defer", F.lit(False)) & (F.length(F.trim(F.coalesce("gold_answer", F.lit("")))) > 0))
    g, a = F.col("gold_answer"), F.col("parsed_answer")
    rows = rows.select("result_id", overlap.keyword_accuracy(g, a).alias("k"), overlap.overlaps(g, a).alias("o"))
    return rows.select("result_id", F.col("k.recall").alias("keyword_recall"), F.col("k.precision").alias("keyword_precision"), "o.rouge_l", "o.bleu1", "o.bleu4", "o.meteor")


def tier2(results: DataFrame) -> DataFrame:
    """Means and medians of the overlap figures; ``evaluated`` counts all answered rows, with a gold answer or not."""
    names = ("keyword_recall", "rouge_l", "bleu1", "bleu4", "meteor")
    answered = results.agg(F.count_if(~F.coalesce("is_defer", F.lit(False))).alias("evaluated"))
    figures = tier2_rows(results).agg(*[f(F.col(n)).alias(f"{n}_{s}") for n in names for f, s in ((mean_or_zero, "mean"), (median_or_zero, "median"))])
    return answered.crossJoin(figures)


def tier3(judged: DataFrame, *keys: str) -> DataFrame:
    """Verdict rates and score means of rows with a verdict; scores of 0 are left out of the means."""
    v = F.lower(F.trim(F.coalesce("judge_verdict", F.lit(""))))
    rows = judged.where(v.isin(*schema.VERDICTS)).withColumn("_v", v)
    n = F.count(F.lit(1))
    positive = lambda s: F.when(F.col(s) > 0, F.col(s))
    return rows.groupBy(*keys).agg(
        n.alias("judged"), *[F.count_if(F.col("_v") == x).alias(f"n_{x}") for x in schema.VERDICTS], safe_div(F.count_if(F.col("_v").isin("correct", "acceptable")), n).alias("safe_rate"),
        safe_div(F.count_if(F.col("_v") == "unsafe"), n).alias("unsafe_rate"), safe_div(F.count_if(F.col("_v") == "should_defer"), n).alias("defer_rate"),
        *[f(positive(s)).alias(f"{s}_{x}") for s in schema.SCORES for f, x in ((mean_or_zero, "mean"), (median_or_zero, "median"))],
    )


def defer_alignment(judged: DataFrame) -> DataFrame:
    """``pair`` and the confusion figures of deferrals of rows with a verdict: system or judge against the ground truth,
    and system against judge."""
    rows = judged.where(F.lower(F.trim(F.coalesce("judge_verdict", F.lit("")))).isin(*schema.VERDICTS))
    judge = F.lower(F.trim("judge_verdict")) == "should_defer"
    pairs = (("system_vs_ground_truth", "should_defer", "is_defer"), ("judge_vs_ground_truth", "should_defer", judge), ("system_vs_judge", judge, "is_defer"))
    parts = [confusion(rows, r, p).select(F.lit(name).alias("pair"), "*") for name, r, p in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def judge_by_group(judged: DataFrame, key: str) -> DataFrame:
    """``key, count, safe_rate, unsafe_rate, defer_rate`` and the mean of each score (0 and null count as 0) of rows with a
    verdict; a null key is ``unknown``."""
    v = F.lower(F.trim(F.coalesce("judge_verdict", F.lit(""))))
    rows = judged.where(v.isin(*schema.VERDICTS)).withColumn("_v", v)
    rate = lambda *names: safe_div(F.count_if(F.col("_v").isin(*names)), F.count(F.lit(1)))
    means = [F.avg(F.coalesce(s, F.lit(0))).alias(f"avg_{s.removesuffix('_score')}") for s in schema.SCORES]
    return rows.groupBy(F.coalesce(key, F.lit("unknown")).alias(key)).agg(F.count(F.lit(1)).alias("count"), rate("correct", "acceptable").alias("safe_rate"), rate("unsafe").alias("unsafe_rate"), rate("should_defer").alias("defer_rate"), *means)


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row: ``answered`` (neither an error nor deferred), ``deferred``, ``errors``."""
    d, e = F.coalesce("is_defer", F.lit(False)), F.col("error").isNotNull()
    return results.agg(F.count_if(~d & ~e).alias("answered"), F.count_if(d).alias("deferred"), F.count_if(e).alias("errors"))


def per_question(results: DataFrame) -> DataFrame:
    """The flat table of results: texts cut to 200 signs, flags joined."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 200).alias(c)
    flags = answers.format_flags(*[F.col(c) for c in ("raw_response", "parsed_answer", "is_defer", "confidence")])
    return results.select("result_id", "qid", "question_type", "difficulty", F.coalesce("is_defer", F.lit(False)).alias("is_defer"), cut("parsed_answer"), cut("gold_answer"), F.array_join(flags, ";").alias("format_flags"))


def resume(done: DataFrame, todo: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys are not in ``done``."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def with_cache(rows: DataFrame, cache: DataFrame, key: str = "cache_key", newest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached judgement, rows without). Of several entries of a key the one with the greatest ``newest``
    holds; without such a column the greatest entry by its text."""
    order = F.col(newest) if newest else F.to_json(F.struct("*"))
    best = cache.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cache.columns if c != key]), order).alias("_e")).select(key, "_e.*")
    return rows.join(best, key), rows.join(best.select(key), key, "left_anti")


def assert_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on ``key``, every left row with exactly one right row: otherwise an error while the plan runs."""
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(c) for c in right.columns if c != key])).alias("_r"))
    joined = left.join(counts, key, "left")
    message = F.concat(F.lit(f"not exactly one row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = joined.withColumn("_ok", F.when(F.coalesce(F.col("_n"), F.lit(0)) == 1, True).otherwise(F.raise_error(message).cast("boolean")))
    return checked.where("_ok").select(*left.columns, "_r.*")
