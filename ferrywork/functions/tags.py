"""Dictionary tags, chunk types and context headers as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrywork import schema
from ferrywork.functions.answers import blank


def mentions(text: Column, word: str) -> Column:
    """Whether the word or phrase stands in the text between word boundaries, without regard to case."""
    return blank(text).rlike(rf"(?i)\b{re.escape(word)}\b")


def tag_family(text: Column, family: str) -> Column:
    """The sorted distinct keywords of a family that the text mentions, aliases as their keyword."""
    words, aliases = schema.TAGS[family]
    by_tag: dict[str, list[str]] = {w: [w] for w in words}
    for alias, tag in aliases.items():
        by_tag.setdefault(tag, []).append(alias)
    found = []
    for tag in sorted(by_tag):
        one = "|".join(re.escape(x) for x in dict.fromkeys(by_tag[tag]))
        found.append(F.when(blank(text).rlike(rf"(?i)\b(?:{one})\b"), tag))
    return F.array_compact(F.array(*found))


def phases(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(blank(text).rlike(r"(?i)\b(?:" + "|".join(map(re.escape, w)) + r")\b"), p) for p, w in schema.PHASES.items()]))


def chunk_type(text: Column, source_type: Column, doc_family: Column) -> Column:
    """The first rule that holds, in order of the document's kind and then of the text's words."""
    low = F.lower(blank(text))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    dataset = F.when(has("critical view of safety", "cvs prediction", "cvs criteria"), "cvs_criteria").when(has("annotation", "bounding box", "segmentation mask", "dataset", "benchmark"), "instrument_lexicon").otherwise("general")
    human = F.when(has("optical illusion", "visual perceptual illusion", "misidentification", "misperception"), "risk_pitfall").otherwise("complication_management")
    return (
        F.when(source_type == "ontology", "instrument_lexicon")
        .when(doc_family == "dataset_paper", dataset)
        .when(doc_family == "human_factors", human)
        .when(has("critical view of safety") | low.rlike(r"\bcvs\b"), "cvs_criteria")
        .when(has("subtotal cholecystectomy", "conversion to open", "bail out", "bailout", "fundus-first", "fundus first", "dome-down"), "bailout_strategy")
        .when(has("bile duct injury", "bile duct injuries", "repair", "reconstruction", "strasberg", "injury classification"), "complication_management")
        .when((source_type == "anatomy_review") & ~has("variant", "anomaly", "aberrant") | has("rouviere", "hepatocystic triangle") & ~has("variant", "anomaly", "aberrant"), "anatomy_landmark")
        .when(has("variant", "anomaly", "aberrant"), "anatomy_variant")
        .when(has("technique", "procedure step", "port placement", "trocar placement"), "technique_step")
        .when(has("checklist", "time out", "sign in", "sign out", "safety check"), "safety_check")
        .otherwise("general")
    )


def context_header(title: Column, source_type: Column, trust: Column, path: Column, kind: Column, tags: dict[str, Column], hints: Column, first: Column, last: Column) -> Column:
    """The bracketed lines before a chunk's text: source, section, topic, tags, focus, pages; empty parts left out."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    label = {"anatomy_tags": "Anatomy", "risk_tags": "Risk", "phase_scope": "Phase"}
    listed = F.concat_ws(" | ", *[F.when(F.size(tags[k]) > 0, F.concat(F.lit(f"{v}: "), F.array_join(F.slice(tags[k], 1, 5), ", "))) for k, v in label.items()])
    pages = F.when(first == last, F.concat(F.lit("Page "), first.cast("string"))).otherwise(F.concat(F.lit("Pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    bracket = lambda cond, c: F.when(cond, F.concat(F.lit("["), c, F.lit("]")))
    return F.concat_ws(
        " ",
        F.concat(F.lit("[Source: "), title, F.lit(" | Type: "), F.coalesce(source_type, F.lit("unknown")), F.lit(" | Trust: Tier "), F.coalesce(trust, F.lit("B")), F.lit("]")),
        bracket(some(path), F.concat(F.lit("Section: "), path)),
        bracket(some(kind) & (kind != "general"), F.concat(F.lit("Topic: "), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))),
        bracket(listed != "", listed),
        bracket(F.size(hints) > 0, F.concat(F.lit("Focus: "), F.array_join(F.slice(hints, 1, 4), ", "))),
        bracket((first > 0) & (last > 0), pages),
    )
