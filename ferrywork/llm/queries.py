"""The pN_ queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrywork.llm import p1_pairs, p2_scans, p3_residue, p4_encoding, p5_split, p6_leak, p7_mix, p8_subject
from ferrywork.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs.found(table(spark, d, "spike_results_v3"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_scans.found(table(spark, d, "chunks_v3"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_residue.found(table(spark, d, "spike_results_v3"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_encoding.found(table(spark, d, "chunks_v3"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_split.found(table(spark, d, "chunks_v3"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces per chunk above the limit, with the size of the longest and the sum of all."""
    pieces = p5_split.split_oversized(table(spark, d, "chunks_v3"), keep_small=False).dropDuplicates(["id", "piece"])
    longest = F.max(F.floor(F.char_length("text") / p5_split.UNIT)).cast("long")
    return pieces.groupBy(F.col("id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_pieces"), longest.alias("longest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leak.find_leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return p7_mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_subject.found(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p5_pieces, p6_found, p7_shares, p8_found)}

ORACLES: dict[str, str] = {
    "p5_found": r"""
        WITH c AS (
            SELECT DISTINCT chunk_id, text, CASE WHEN level = 'parent' THEN 800 ELSE 250 END AS lim FROM chunks_v3 WHERE text IS NOT NULL
        ), o AS (SELECT * FROM c WHERE length(text) // 4 > lim),
        p AS (
            SELECT chunk_id,
                bool_and(length(par) // 4 <= lim) AS by_paragraph
            FROM (SELECT chunk_id, lim, unnest(string_split_regex(text, '\n[^\S\n]*(?:\n[^\S\n]*)+')) AS par FROM o) GROUP BY chunk_id
        ), s AS (
            SELECT chunk_id, bool_and(length(sen) // 4 <= lim) AS by_sentence
            FROM (SELECT chunk_id, lim, unnest(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[\n' || chr(1) || ']')) AS sen FROM o) GROUP BY chunk_id
        )
        SELECT chunk_id, CASE WHEN by_paragraph THEN 'paragraph' WHEN by_sentence THEN 'sentence' ELSE 'none' END AS cut_kind
        FROM p JOIN s USING (chunk_id)
    """,
    # boundaries from the runs of white space of each text, then one walk a text from cut to cut
    "p5_pieces": r"""
        WITH RECURSIVE c AS (
            SELECT chunk_id, text, CASE WHEN level = 'parent' THEN 800 ELSE 250 END AS lim, CASE WHEN level = 'parent' THEN 80 ELSE 30 END AS lap
            FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks_v3) WHERE text IS NOT NULL
        ), o AS (SELECT *, length(text) AS n, lim * 4 + 3 AS longest, lap * 4 AS shared FROM c WHERE length(text) // 4 > lim),
        g AS (SELECT chunk_id, n, regexp_extract_all(text, '[^\s]*\s+') AS parts FROM o),
        u AS (SELECT chunk_id, n, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, unnest(list_transform(range(0, len(parts)), lambda k: coalesce(list_sum(list_transform(parts[1:k], lambda x: length(x))), 0)::BIGINT)) AS off FROM g),
        r AS (SELECT *, regexp_extract(part, '^([^\s]*)', 1) AS word, regexp_extract(part, '(\s+)$', 1) AS gap FROM u),
        b AS (
            SELECT chunk_id, off + length(part) AS pos, CASE WHEN length(gap) - length(replace(gap, chr(10), '')) >= 2 THEN 4 WHEN regexp_matches(word, '[.!?]$') OR gap[-1] = chr(10) THEN 3 WHEN regexp_matches(word, '[,;:]$') THEN 2 ELSE 1 END AS strength FROM r
            UNION ALL SELECT chunk_id, off + length(word) + k, 3 FROM (SELECT *, unnest(list_filter(range(1, length(gap) + 1), lambda j: gap[j] = chr(10))) AS k FROM r)
            UNION ALL SELECT chunk_id, off + 1, 2 FROM r WHERE word IN ('–', '—') AND off > 0
        ), s AS (SELECT chunk_id, pos, max(strength) AS strength FROM b GROUP BY ALL),
        k AS (SELECT chunk_id, list({'p': pos, 's': strength} ORDER BY strength DESC, pos DESC) AS cuts FROM s WHERE pos > 0 GROUP BY chunk_id),
        w AS (
            SELECT o.chunk_id, n, longest, shared, cuts, 0::BIGINT AS start, CASE WHEN n <= longest THEN n ELSE NULL END AS stop, 0 AS piece FROM o LEFT JOIN k USING (chunk_id)
            UNION ALL
            SELECT chunk_id, n, longest, shared, cuts, CASE WHEN stop IS NULL THEN start ELSE stop - shared END, CASE WHEN stop IS NOT NULL THEN CASE WHEN n - (stop - shared) <= longest THEN n END
                ELSE coalesce(list_filter(cuts, lambda x: x.p >= start + greatest(longest // 2, shared + 1) AND x.p <= start + longest)[1].p, list_filter(cuts, lambda x: x.p >= start + shared + 1 AND x.p <= start + longest)[1].p, start + longest) END,
                CASE WHEN stop IS NULL THEN piece ELSE piece + 1 END
            FROM w WHERE stop IS NULL OR stop < n
        )
        SELECT chunk_id, count(*) AS n_pieces, max((stop - start) // 4)::BIGINT AS longest FROM w WHERE stop IS NOT NULL GROUP BY chunk_id
    """,
}
