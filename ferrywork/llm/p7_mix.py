"""Problem 7: mixing sources to target weights.

Each source's share of the total is cut into blocks of equal size. Pfair scheduling gives block i of a source of weight
w the release floor((i - 1) / w) and the deadline ceil(i / w); earliest deadline first (ties as in PD2: successor bit,
then group deadline) then places one block a slot, so that at any slot no source is a whole block away from its share.
Only what has a slot is in the mixture, and the report is taken from the mixture in the order of its slots.

The number of slots is a parameter (a last block that is not full takes one besides, so there is at most one more for
each source), so the schedule is small whatever the corpus. Documents reach their slots by
running sums of their sizes within a source: first over hashed groups of documents (one row a group), then within each
group, so no source is ever gathered in one task. The driver receives one total per listed source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the tokenizer file lies (a parameter of every operator here; it is read by the driver and sent along).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Slots of the schedule; fewest groups a source falls into, and about how many documents a group holds at most.
SLOTS, GROUPS, GROUP_SIZE = 2000, 64, 1_000_000


def _sizes(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.encode_special_tokens = True
        for pdf in frames:
            out = []
            for at in range(0, len(pdf), 256):
                part = list(pdf["text"].iloc[at : at + 256])
                out += [len(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "size": pd.Series(out, dtype="int64")})

    return run


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, source, size``: the number of tokens of each document; the source without case and outer blanks.

    Null texts count as empty (size 0). The file is a tokenizer of the library ``tokenizers``.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), F.lower(F.trim(source_col)).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(_sizes(shared), "id long, source string, size long")


def pfair(weights: dict[str, Fraction], slots: int, blocks: dict[str, int] | None = None) -> list[str]:
    """The source of each slot; weights sum to at most 1, ties fall to the alphabetically first name.

    With ``blocks`` each source gets just so many slots, and the schedule ends with the last block, not after ``slots``.

    >>> pfair({"a": Fraction(1, 2), "b": Fraction(1, 2)}, 4)
    ['a', 'b', 'a', 'b']
    """
    ceil = lambda x: -((-x.numerator) // x.denominator)
    waiting: list[tuple[int, str, int]] = [(0, s, 1) for s, w in weights.items() if w > 0 and (blocks is None or blocks.get(s, 0) > 0)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, str, int]] = []
    out: list[str] = []
    while len(out) < slots if blocks is None else waiting or ready:
        t = len(out)
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            w = weights[s]
            deadline = ceil(Fraction(i) / w)
            overlaps = int(deadline != Fraction(i) / w)  # the window of the next block begins before this one's ends
            group = deadline
            if w >= Fraction(1, 2) and w < 1:  # only heavy sources have chains of windows of two slots
                group = ceil(ceil(Fraction(deadline) * (1 - w)) / (1 - w))
            heapq.heappush(ready, (deadline, 1 - overlaps, -group, s, i))
        if not ready:
            out.append("")
            continue
        _, _, _, s, i = heapq.heappop(ready)
        out.append(s)
        if blocks is None or i < blocks[s]:
            heapq.heappush(waiting, (max(t + 1, int(Fraction(i) / weights[s])), s, i + 1))
    return out


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], slots: int = SLOTS) -> tuple[dict[str, Fraction], int]:
    """(weight of each source that can supply, total size): the greatest total that keeps all weights and caps.

    A source without documents, or with a target or cap of 0, supplies nothing; the others keep their proportions.
    """
    able = {s: Fraction(share).limit_denominator(10**6) for s, (share, cap) in targets.items() if share > 0 and cap > 0 and sizes.get(s, 0) > 0}
    whole = sum(able.values())
    weights = {s: w / whole for s, w in able.items()}
    total = min((int(Fraction(sizes[s] * targets[s][1]) / w) for s, w in weights.items()), default=0)
    return weights, total


def mix(sized: DataFrame, targets: DataFrame, slots: int = SLOTS, groups: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, report).

    ``uses``: ``id, source, repeat, slot, size``, one row per use of a document; ordered by slot it is the mixture.
    ``report``: one row per source of either table: ``source, target_share, actual_share, documents, documents_used,
    uses, repeats_used, max_repeats, size, size_used, max_lag``. It counts what has a slot; ``max_lag`` is the furthest
    that the source is, before or after any slot, from its part of the mixture so far (in the unit of ``size``; its part
    as the sources that can supply share the whole).

    ``sized`` is the result of ``token_sizes``; ``targets`` holds ``source, target_share, max_repeats`` (names are taken
    without case and outer blanks; of two rows for a source the one with the greater share holds). Documents of unlisted
    or null sources are not used and reported with target 0. A document id given twice is two documents. Documents of
    size 0 take no room and are used once with the first block. ``groups``: by default one for each ``GROUP_SIZE``
    documents of the whole, so that no group grows with the corpus.
    """
    spark = sized.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).collect():
        if r["source"] is not None and (r["source"] not in wanted or (r["share"] or 0) > wanted[r["source"]][0]):
            wanted[r["source"]] = (r["share"] or 0.0, r["cap"] or 0)
    groups = groups or max(GROUPS, -(-sized.count() // GROUP_SIZE))
    # the salted group of a document: a hot source falls into as many groups as any other
    rows = sized.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    grouped = rows.groupBy("source", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    listed = grouped.where(F.col("source").isin(list(wanted)))
    sizes: dict[str, int] = {r["source"]: r["size"] for r in listed.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    weights, total = plan(sizes, wanted, slots)
    block = max(1, -(-total // slots))
    quotas = {s: int(w * total) for s, w in weights.items()}
    places: dict[str, list[int]] = {s: [] for s in weights}
    for t, s in enumerate(pfair(weights, slots, {s: -(-q // block) for s, q in quotas.items()})):
        if s:
            places[s].append(t)
    quota = [(s, sizes[s], q, wanted[s][1], places[s]) for s, q in quotas.items()]
    # where each group begins within its source: a window over one row a group
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = listed.select("source", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    quota_df = spark.createDataFrame(quota, "source string, all_size long, quota long, cap int, places array<int>")
    running = Window.partitionBy("source", "part").orderBy(F.xxhash64("id", F.lit(1)), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["source", "part"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("size").over(running), F.lit(0)))
    uses = (
        placed.join(F.broadcast(quota_df), "source")
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("cap"))))
        .withColumn("from", F.col("begin") + (F.col("repeat") - 1) * F.col("all_size"))
        .where((F.col("from") < F.col("quota")) & ((F.col("size") > 0) | (F.col("repeat") == 1)))
        .withColumn("slot", F.get("places", F.floor(F.col("from") / F.lit(block)).cast("int")))
        .where(F.col("slot").isNotNull())
        .select("id", "source", "repeat", "slot", "size")
    )
    aims = spark.createDataFrame([(s, share, cap, float(weights.get(s, 0))) for s, (share, cap) in wanted.items()], "aim string, target_share double, max_repeats int, weight double")
    # the mixture in the order of its slots, one row a slot: how far each source is from its part after and before its slots
    filled = uses.groupBy("source", "slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("uses"), F.sum(F.when(F.col("repeat") == 1, 1).otherwise(0)).alias("documents_used"), F.max("repeat").alias("repeats_used"))
    so_far, own_so_far = Window.orderBy("slot"), Window.partitionBy("source").orderBy("slot")
    lags = filled.withColumn("reached", F.sum("size").over(so_far)).withColumn("own", F.sum("size").over(own_so_far)).join(F.broadcast(aims.select(F.col("aim").alias("source"), "weight")), "source")
    after = F.col("own") - F.col("weight") * F.col("reached")
    lag = F.greatest(F.abs(after), F.abs(after - F.col("size") * (1 - F.col("weight"))))
    used = lags.groupBy("source").agg(F.sum("size").alias("size_used"), F.sum("uses").alias("uses"), F.sum("documents_used").alias("documents_used"), F.max("repeats_used").alias("repeats_used"), F.max(lag).alias("lag"))
    have = grouped.groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("documents"))
    report = have.join(aims, have["source"].eqNullSafe(aims["aim"]), "full").select(F.coalesce("source", "aim").alias("source"), "target_share", "max_repeats", "weight", "documents", "size")
    report = report.join(used.withColumnRenamed("source", "used_source"), F.col("source") == F.col("used_source"), "left")
    overall = used.agg(F.sum("size_used").alias("overall"))
    at_end = F.abs(F.coalesce("size_used", F.lit(0)) - F.coalesce("weight", F.lit(0.0)) * F.coalesce("overall", F.lit(0)))
    report = report.crossJoin(F.broadcast(overall)).select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("size_used") / F.col("overall"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("documents_used", F.lit(0)).cast("long").alias("documents_used"), F.coalesce("uses", F.lit(0)).cast("long").alias("uses"),
        F.coalesce("repeats_used", F.lit(0)).cast("int").alias("repeats_used"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats"), F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("size_used", F.lit(0)).cast("long").alias("size_used"),
        F.greatest("lag", at_end).alias("max_lag"),
    )
    return uses, report


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The report of the scheduled mixture of ``documents`` by ``targets``. Sizes are counted once and kept in the checkpoint folder."""
    from ferrywork.runtime import cut

    return mix(cut(token_sizes(documents, tokenizer=tokenizer)), targets)[1]
