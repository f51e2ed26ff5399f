"""Robust z-scores, weighted index, tertiles, stratified sampling, scoring and bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.functions.answers import answer_to_binary


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


def robust_z(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """``df`` with (x - median) / IQR of each column; an IQR below 1e-8 gives way to the population standard deviation,
    and that to 0. NaN counts as missing and stays null. All columns share one aggregation, broadcast as one row."""
    quarters = [F.percentile(_number(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q{i}") for i, c in enumerate(columns)]
    stats = df.agg(*quarters, *[F.stddev_pop(_number(c)).alias(f"_s{i}") for i, c in enumerate(columns)])
    out = df.crossJoin(F.broadcast(stats))
    made = {}
    for i, c in enumerate(columns):
        q = F.col(f"_q{i}")
        iqr = q[2] - q[0]
        spread = F.when(iqr >= 1e-8, iqr).otherwise(F.col(f"_s{i}"))
        made[prefix + c] = F.when(spread >= 1e-8, (_number(c) - q[1]) / spread).otherwise(F.when(_number(c).isNotNull() | (F.coalesce(spread, F.lit(0.0)) < 1e-8), F.lit(0.0)))
    drop = [f"_{x}{i}" for i in range(len(columns)) for x in "qs"]
    return out.withColumns(made).drop(*drop)


def observability(df: DataFrame) -> DataFrame:
    """Derived features, their z-scores, the visual and construct scores."""
    labels = F.coalesce(F.size("spatial_labels"), F.lit(0))
    out = df.withColumns(
        {
            "sharpness_log": F.log1p("sharpness_lap_var"),
            "brightness_good": 1.0 - F.least(F.abs(F.col("brightness_mean") - 128.0) / 128.0, F.lit(1.0)),
            "contrast_good": F.least(F.col("contrast_std") / 64.0, F.lit(1.0)),
            "exposure_bad": F.coalesce("underexposed_frac", F.lit(0.0)) + F.coalesce("overexposed_frac", F.lit(0.0)),
            "spatial_signal": 0.50 * F.col("insseg_available").cast("double") + 0.35 * F.col("semseg_available").cast("double") + 0.15 * F.least(labels / 6.0, F.lit(1.0)),
        }
    )
    out = robust_z(out, [*schema.OBSERVABILITY, "disagreement_count", "disagreement_score"])
    score = sum((w * F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c, w in schema.OBSERVABILITY.items()), F.lit(0.0))
    out = out.withColumn("obs_visual_score", score)
    return out.withColumn("obs_construct_score", F.col("obs_visual_score") - schema.DISAGREEMENT_ALPHA * F.coalesce("z_disagreement_count", F.lit(0.0)))


def tertiles(df: DataFrame, score: str, order: str, out: str) -> DataFrame:
    """``df`` with low, mid or high by the rank of ``score`` (ties by ``order``): of n rows the first (n + 1) // 3 are
    low and those up to 2 n // 3 mid. Nulls have no stratum.

    The rank comes from two-phase counting over range partitions, not from one global window.
    """
    good = df.where(F.col(score).isNotNull())
    ranked = global_row_number(good, [score, order], "_rn")
    n = good.agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.crossJoin(F.broadcast(n))
    label = F.when(F.col("_rn") <= F.floor((F.col("_n") + 1) / 3), "low").when(F.col("_rn") <= F.floor(2 * F.col("_n") / 3), "mid").otherwise("high")
    missing = df.where(F.col(score).isNull()).withColumn(out, F.lit(None).cast("string"))
    return ranked.withColumn(out, label).drop("_rn", "_n").unionByName(missing)


def global_row_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Row numbers from 1 in the order of the columns, without gathering all rows in one task."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    parts = parts.withColumn("_part", F.shiftright("_mid", 33))
    from ferrywork.runtime import cut

    parts = cut(parts)  # the partition numbers must be the same for both uses
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))  # one row a partition
    return parts.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_mid", "_part", "_before")


def cvs_state(c: Column) -> Column:
    return F.when(c <= 0, "no").when(c >= 3, "achieved").when(c.isNotNull(), "partial")


def seeded(c: Column, seed: int) -> Column:
    """A hash of an id by which rows fall into a seeded order, the same in every engine (MD5 of id, colon and seed)."""
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, strata: list[str], targets: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """At most ``target`` rows of each stratum (``targets``: the strata and ``target``), in the order of a seeded hash."""
    w = Window.partitionBy(*strata).orderBy(seeded(F.col(id_col), seed), F.col(id_col))
    rows = df.join(F.broadcast(targets), strata)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("target")).drop("_rank", "target")


# Rows of each state that a stratum of a pilot sample aims at. Fixed values.
STATE_TARGETS = {"no": 33, "partial": 34, "achieved": 33}


def pilot_sample(df: DataFrame, id_col: str = "record_id", stratum: str = "obs_visual_stratum", state: str = "cvs_state", per_stratum: int = 100, targets: dict[str, int] | None = STATE_TARGETS, seed: int = 42) -> DataFrame:
    """``per_stratum`` rows of each stratum: first up to ``targets`` of each state, then others of the stratum, in an order
    by a seeded hash; with ``pilot_row_index``, the place in a seeded shuffle (from 0). Without targets only the strata are
    balanced.

    The rank within a cell decides by itself whether a row is one of its state's, so one window over (stratum, state) and
    one over the stratum suffice; both keep few rows for each partition (a rank limit).
    """
    hashed = lambda k: seeded(F.col(id_col), seed + k)
    goal = F.lit(0)
    for name, n in (targets or {}).items():
        goal = F.when(F.col(state) == name, n).otherwise(goal)
    cell = Window.partitionBy(stratum, state).orderBy(hashed(0), id_col)
    rows = df.where(F.col(stratum).isNotNull()).withColumn("_cell", F.row_number().over(cell)).where(F.col("_cell") <= per_stratum + max([0, *(targets or {}).values()]))
    within = Window.partitionBy(stratum).orderBy(F.when(F.col("_cell") <= goal, 0).otherwise(1), hashed(1), id_col)
    rows = rows.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= per_stratum)
    # a pilot has a few hundred rows: one window numbers them
    return rows.withColumn("pilot_row_index", F.row_number().over(Window.orderBy(hashed(2), id_col)) - 1).drop("_cell", "_n")


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    return df.groupBy(a).pivot(b, values).count().na.fill(0)


def score_predictions(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions with the ground truth of their criterion, strict and answered correctness."""
    truth = manifest.select("pilot_row_index", F.col("record_id"), *[c for c in manifest.columns if c.startswith("obs_")], F.expr("stack(3, 'c1', c1, 'c2', c2, 'c3', c3) as (criterion, gt)")).withColumnRenamed("record_id", "record_id_manifest")
    rows = predictions.join(truth, ["pilot_row_index", "criterion"], "left").withColumn("pred_bin", answer_to_binary(F.col("parsed_answer")))
    right = F.col("pred_bin") == F.col("gt")
    return rows.withColumns(
        {"answered": F.col("pred_bin").isNotNull(), "strict_correct": F.coalesce(right, F.lit(False)).cast("double"), "answered_correct": F.when(F.col("pred_bin").isNotNull(), right.cast("double")), "uncertain_or_error": F.col("pred_bin").isNull()}
    )


def bootstrap_interval(df: DataFrame, keys: list[str], value: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """``keys, mean, ci_low, ci_high, n``: the percentile interval of the mean of a 0/1 value.

    A resample of n values with h ones draws a binomial count of ones, so only (n, h) of each group reach Python and a
    group of any size costs the same. Nulls are left out; an empty group has no row.
    """
    groups = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("h"))

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(n: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(n, h, strict=True):
            draws = np.random.default_rng(seed).binomial(int(a), min(1.0, b / a), resamples) / a
            rows.append(np.percentile(draws, [2.5, 97.5]))
        return pd.DataFrame(rows, columns=["low", "high"])

    return groups.withColumn("_ci", interval("n", "h")).select(*keys, (F.col("h") / F.col("n")).alias("mean"), F.col("_ci.low").alias("ci_low"), F.col("_ci.high").alias("ci_high"), "n")


def summarize(scored: DataFrame, stratum: str = "obs_visual_stratum", score_type: str = "visual", resamples: int = 2000) -> DataFrame:
    """Accuracy by model and stratum with bootstrap intervals, strict and of answered rows, and the rates of answers.

    ``scored`` is the result of ``score_predictions``; rows without a stratum are left out. One aggregation counts
    everything; the intervals are drawn from the counts.
    """
    keys = ["model_id", "stratum"]
    rows = scored.where(F.col(stratum).isNotNull()).withColumn("stratum", F.col(stratum))
    share = lambda name: F.coalesce(F.avg((F.col("parsed_answer") == name).cast("double")), F.lit(0.0)).alias(f"{name}_rate")
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_predictions"), F.count_distinct("record_id").alias("n_frames"), F.avg(F.col("uncertain_or_error").cast("double")).alias("uncertain_rate"), share("yes"), share("no"))
    for name, column in (("strict", "strict_correct"), ("answered", "answered_correct")):
        ci = bootstrap_interval(rows, keys, column, resamples)
        base = base.join(ci.select(*keys, F.col("mean").alias(f"{name}_accuracy"), F.col("ci_low").alias(f"{name}_ci_low"), F.col("ci_high").alias(f"{name}_ci_high")), keys, "left")
    names = [f"{a}_{b}" for a in ("strict", "answered") for b in ("accuracy", "ci_low", "ci_high")]
    return base.select("model_id", F.lit(score_type).alias("score_type"), "stratum", "n_predictions", "n_frames", *names, "uncertain_rate", "yes_rate", "no_rate")


def summarize_all(scored: DataFrame) -> DataFrame:
    """The summaries by the visual and the construct stratum, one below the other."""
    return summarize(scored).unionByName(summarize(scored, "obs_construct_stratum", "construct"))


def summarize_by_criterion(scored: DataFrame, resamples: int = 2000) -> DataFrame:
    """``model_id, criterion, obs_visual_stratum, n``, strict accuracy with its interval, and the uncertain rate."""
    keys = ["model_id", "criterion", "obs_visual_stratum"]
    rows = scored.where(F.col("obs_visual_stratum").isNotNull())
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("uncertain_or_error").cast("double")).alias("uncertain_rate"))
    ci = bootstrap_interval(rows, keys, "strict_correct", resamples).select(*keys, F.col("mean").alias("strict_accuracy"), F.col("ci_low").alias("strict_ci_low"), F.col("ci_high").alias("strict_ci_high"))
    return base.join(ci, keys, "left").select(*keys, "n", "strict_accuracy", "strict_ci_low", "strict_ci_high", "uncertain_rate")


def error_examples(scored: DataFrame, most: int = 10) -> DataFrame:
    """``model_id, example, path``: at most ``most`` distinct frames of right and wrong answers at low and high strata."""
    kind = F.concat(F.col("obs_visual_stratum"), F.lit("_obs_"), F.when(F.col("strict_correct") == 1, "correct").otherwise("wrong"))
    rows = scored.where(F.col("obs_visual_stratum").isin("low", "high")).select("model_id", kind.alias("example"), F.col("frame_path").alias("path")).distinct()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("model_id", "example").orderBy("path"))).where(F.col("_n") <= most).drop("_n")


def verdict(summary: DataFrame) -> DataFrame:
    """PASS, MARGINAL, FAIL or INCOMPLETE of each model from its accuracy by stratum (``model_id, stratum, accuracy``)."""
    p = summary.groupBy("model_id").pivot("stratum", ["low", "mid", "high"]).agg(F.first("accuracy"))
    gap, monotonic = F.col("high") - F.col("low"), (F.col("high") >= F.col("mid")) & (F.col("mid") >= F.col("low"))
    missing = F.col("low").isNull() | F.col("mid").isNull() | F.col("high").isNull()
    return p.withColumn("verdict", F.when(missing, "INCOMPLETE").when(monotonic & (gap >= 0.15), "PASS").when(gap >= 0.10, "MARGINAL").otherwise("FAIL"))
