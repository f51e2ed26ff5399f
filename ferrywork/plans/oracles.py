"""The SQL of the core's queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from ferrywork import schema
from ferrywork.functions import answers, text

CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM chunks_v3)"
RESULTS = "(SELECT DISTINCT ON (result_id) * FROM spike_results_v3)"
ITEMS = "(SELECT * FROM heldout_items WHERE item_id % 20 = 0)"
TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+(?:[''-][a-z0-9]+)?')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _bm25(docs: str, id_col: str, fields: dict[str, float], text_of) -> str:  # noqa: ANN001
    posts = " UNION ALL ".join(f"SELECT {q(f)} AS field, {w} AS w, {id_col} AS id, {TOKENS.format(text_of(f))} AS words FROM {docs}" for f, w in fields.items())
    return f"""
        WITH raw AS ({posts}), p0 AS (SELECT field, w, id, len(words) AS dl, unnest(words) AS term FROM raw),
        p AS (SELECT field, w, id, term, count(*) AS tf, first(dl) AS dl FROM p0 GROUP BY ALL),
        n AS (SELECT count(*) AS n FROM {docs}),
        l AS (SELECT field, sum(dl)::DOUBLE / (SELECT n FROM n) AS avgdl FROM (SELECT DISTINCT field, id, dl FROM p) GROUP BY field),
        d0 AS (SELECT field, term, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p GROUP BY field, term),
        m AS (SELECT field, avg(raw) AS mean FROM d0 GROUP BY field),
        d AS (SELECT field, term, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM d0 JOIN m USING (field)),
        t AS (SELECT item_id AS qid, unnest({TOKENS.format("text")}) AS term FROM {ITEMS}), u AS (SELECT qid, term, count(*) AS qf FROM t GROUP BY ALL),
        s AS (
            SELECT qid, id, round(sum(qf * w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM u JOIN p USING (term) JOIN d USING (field, term) JOIN l USING (field) GROUP BY qid, id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
        SELECT qid, id AS {id_col}, score, rank FROM r WHERE rank <= 5
    """


def _dense(k: int, cosine: bool) -> str:
    dot = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    if cosine:
        norm = lambda x: f"greatest(sqrt(list_inner_product({x}.embedding::DOUBLE[], {x}.embedding::DOUBLE[])), 1e-12)"
        dot = f"({dot} / {norm('a')} / {norm('b')})"
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        SELECT a.vec_id AS qid, b.vec_id AS id, round({dot}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= {k})"""


def _norm(c: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


def _strip(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"


def _tags() -> str:
    import re

    out = []
    for family, (words, aliases) in schema.TAGS.items():
        by: dict[str, list[str]] = {w: [w] for w in words}
        for a, t in aliases.items():
            by.setdefault(t, []).append(a)
        cases = ", ".join(f"CASE WHEN regexp_matches(text, {q(r'(?i)\b(?:' + '|'.join(re.escape(x) for x in dict.fromkeys(by[t])) + r')\b')}) THEN {q(t)} END" for t in sorted(by))
        out.append(f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ';') AS {family}")
    cases = ", ".join(f"CASE WHEN regexp_matches(text, {q(r'(?i)\b(?:' + '|'.join(map(re.escape, w)) + r')\b')}) THEN {q(p)} END" for p, w in schema.PHASES.items())
    out.append(f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ';') AS phases")
    return f"SELECT chunk_id, {', '.join(out)} FROM {CHUNKS}"


def _kinds() -> str:
    has = lambda *ws: "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in ws) + ")"
    variant = has("variant", "anomaly", "aberrant")
    return f"""SELECT chunk_id, CASE
        WHEN source_type = 'ontology' THEN 'instrument_lexicon'
        WHEN doc_family = 'dataset_paper' THEN CASE WHEN {has('critical view of safety', 'cvs prediction', 'cvs criteria')} THEN 'cvs_criteria'
            WHEN {has('annotation', 'bounding box', 'segmentation mask', 'dataset', 'benchmark')} THEN 'instrument_lexicon' ELSE 'general' END
        WHEN doc_family = 'human_factors' THEN CASE WHEN {has('optical illusion', 'visual perceptual illusion', 'misidentification', 'misperception')} THEN 'risk_pitfall' ELSE 'complication_management' END
        WHEN {has('critical view of safety')} OR regexp_matches(lower(text), '\\bcvs\\b') THEN 'cvs_criteria'
        WHEN {has('subtotal cholecystectomy', 'conversion to open', 'bail out', 'bailout', 'fundus-first', 'fundus first', 'dome-down')} THEN 'bailout_strategy'
        WHEN {has('bile duct injury', 'bile duct injuries', 'repair', 'reconstruction', 'strasberg', 'injury classification')} THEN 'complication_management'
        WHEN (source_type = 'anatomy_review' OR {has('rouviere', 'hepatocystic triangle')}) AND NOT {variant} THEN 'anatomy_landmark'
        WHEN {variant} THEN 'anatomy_variant'
        WHEN {has('technique', 'procedure step', 'port placement', 'trocar placement')} THEN 'technique_step'
        WHEN {has('checklist', 'time out', 'sign in', 'sign out', 'safety check')} THEN 'safety_check' ELSE 'general' END AS kind FROM {CHUNKS}"""


def _sentences() -> str:
    t = "coalesce(text, '')"
    for a in text.ABBREVIATIONS:
        t = f"replace({t}, {q(a)}, {q(a.replace('.', '§'))})"
    return rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({t}, '\n\s*\n', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS x FROM documents)
        SELECT doc_id, len(x)::BIGINT AS n_sentences, list_max(list_transform(x, lambda y: length(y)))::BIGINT AS longest FROM s"""


FLAG = {
    "raw_empty": "r = ''", "invalid_prefix": "r <> '' AND NOT (starts_with(upper(r), 'ANSWER:') OR starts_with(upper(r), 'DEFER:'))", "mixed_answer_and_defer": "contains(lower(r), 'answer:') AND contains(lower(r), 'defer:')",
    "template_leak": "contains(lower(r), '[your concise answer]') OR contains(lower(r), '[brief reason')", "mentions_defer_but_not_parsed": "contains(lower(r), 'defer') AND NOT d", "parsed_blank": "p = ''",
    "missing_confidence": "NOT d AND c NOT IN ('high', 'medium', 'low')",
}
FLAGGED = f"(SELECT *, {_strip('raw_response')} AS r, {_strip('parsed_answer')} AS p, coalesce(is_defer, false) AS d, lower({_strip('confidence')}) AS c FROM {RESULTS})"
COUNTS = "count(*) FILTER (WHERE r AND p) AS tp, count(*) FILTER (WHERE NOT r AND p) AS fp, count(*) FILTER (WHERE r AND NOT p) AS fn, count(*) FILTER (WHERE NOT r AND NOT p) AS tn"
RATES = """coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
    coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0)::DOUBLE AS f1,
    coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)::DOUBLE AS accuracy"""


def _confusion(*keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    return f"WITH x AS (SELECT {k}{COUNTS} FROM (SELECT *, coalesce(should_defer, false) AS r, coalesce(is_defer, false) AS p FROM {RESULTS}){by}) SELECT {k}tp, fp, fn, tn, {RATES} FROM x"


def _by(key: str) -> str:
    d = "coalesce(is_defer, false)"
    return f"""SELECT coalesce({key}, 'unknown') AS {key}, count(*) AS count, count(*) FILTER (WHERE NOT {d}) AS answered, count(*) FILTER (WHERE {d}) AS deferred,
        count(*) FILTER (WHERE coalesce(should_defer, false)) AS should_defer_gt, avg(coalesce(latency_s, 0.0)) AS avg_latency_s FROM {RESULTS} GROUP BY 1"""


def _tier3(*keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    by = f" GROUP BY {', '.join(keys)}" if keys else ""
    scores = ", ".join(f"coalesce(avg(nullif(greatest({s}, 0), 0)), 0)::DOUBLE AS {s}_mean, coalesce(median(nullif(greatest({s}, 0), 0)), 0)::DOUBLE AS {s}_median" for s in schema.SCORES)
    rate = lambda c: f"coalesce(count(*) FILTER (WHERE {c}) / nullif(count(*), 0), 0)::DOUBLE"
    return f"""SELECT {k}count(*) AS judged, {', '.join(f"count(*) FILTER (WHERE v = '{x}') AS n_{x}" for x in schema.VERDICTS)}, {rate("v IN ('correct', 'acceptable')")} AS safe_rate, {rate("v = 'unsafe'")} AS unsafe_rate,
        {rate("v = 'should_defer'")} AS defer_rate, {scores} FROM (SELECT *, lower(trim(coalesce(judge_verdict, ''))) AS v FROM {RESULTS}) WHERE v IN ({', '.join(map(q, schema.VERDICTS))}){by}"""


def _parse() -> str:
    low = "lower(t)"
    cues = " OR ".join(f"contains({low}, {q(c)})" for c in answers.DEFER_CUES)
    leak = " OR ".join(f"contains({low}, {q(c)})" for c in answers.LEAKS)
    tail = r"regexp_replace({}, '\|\s*confidence\s*[:=\-]?\s*\[?\s*(?:high|medium|low)\s*\]?\s*$', '', 'i')"
    col = lambda c: rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return rf"""
        WITH a AS (SELECT result_id, {_strip('raw_response')} AS t FROM {RESULTS}),
        b AS (SELECT *, t = '' AS e, {leak} AS leak, (regexp_full_match(t, '(?:\[?0(?:\.0)?\]?[,\s.]*){{6,}}') OR (NOT regexp_matches(t, '[A-Za-z]') AND length(t) > 12)) AS g,
            regexp_matches(t, '^\s*defer\b\s*:?', 'i') OR regexp_matches(t, '\banswer\s*:\s*\[?\s*defer\b', 'i') OR {cues} AS f,
            starts_with(upper(t), 'ANSWER:') OR starts_with(upper(t), 'DEFER:') AS ok FROM a),
        c AS (SELECT *, regexp_replace(regexp_extract(t, '\bdefer\b\s*:?\s*(.*)$', 1, 'is'), '^\s+|\s+$', '', 'g') AS rest,
            CASE WHEN regexp_matches(t, '\banswer\s*:\s*', 'i') THEN regexp_extract(t, '\banswer\s*:\s*(.*)$', 1, 'is') ELSE t END AS ans,
            regexp_extract(t, 'confidence\s*[:=\-]?\s*\[?\s*(high|medium|low)\s*\]?', 1, 'i') AS conf FROM b),
        d AS (SELECT *, regexp_replace({tail.format('ans')}, '^\s+|\s+$', '', 'g') AS ans2, {tail.format("CASE WHEN rest <> '' THEN rest ELSE t END")} AS rest2 FROM c)
        SELECT result_id, (e OR leak OR g OR f OR ans2 = '') AS is_defer, CASE WHEN e OR leak OR g OR f OR ans2 = '' OR conf = '' THEN 'unknown' ELSE lower(conf) END AS confidence,
            CASE WHEN e THEN {q(answers.EMPTY_TEXT)} WHEN leak THEN {q(answers.LEAK_TEXT)} WHEN g THEN {q(answers.GARBAGE_TEXT)} WHEN f THEN {col('rest2')} WHEN ans2 = '' THEN {q(answers.BLANK_TEXT)} ELSE {col('ans2')} END AS parsed_answer,
            CASE WHEN e THEN 'empty_raw' ELSE array_to_string(list_filter([CASE WHEN leak THEN 'template_leak' END, CASE WHEN g THEN 'garbage_output' END, CASE WHEN NOT ok THEN 'noncanonical_prefix' END,
                CASE WHEN NOT leak AND NOT g AND NOT f AND ans2 = '' THEN 'blank_answer_after_parse' END], lambda x: x IS NOT NULL), ';') END AS flags FROM d
    """


def _keywords() -> str:
    from ferrywork.functions.overlap import all_keywords

    words = "[" + ", ".join(map(q, all_keywords())) + "]"
    return f"""WITH a AS (SELECT result_id, lower(coalesce(gold_answer, '')) AS g, lower(coalesce(parsed_answer, '')) AS p FROM {RESULTS}),
        b AS (SELECT result_id, list_filter({words}, lambda k: contains(g, k)) AS kg, list_filter({words}, lambda k: contains(p, k)) AS kp FROM a)
        SELECT result_id, CASE WHEN len(kg) = 0 THEN 1.0 ELSE len(list_filter(kg, lambda k: list_contains(kp, k))) / len(kg) END::DOUBLE AS recall,
        CASE WHEN len(kp) = 0 THEN 0.0 ELSE len(list_filter(kg, lambda k: list_contains(kp, k))) / len(kp) END::DOUBLE AS precision,
        array_to_string(list_sort(list_filter(kg, lambda k: NOT list_contains(kp, k))), ';') AS missed FROM b"""


def _features() -> str:
    m = "coalesce(classes_detected, MAP {})"
    area = lambda names: f"round(list_sum(list_transform(map_entries({m}), lambda e: CASE WHEN e.key IN ({', '.join(map(q, names))}) THEN coalesce(e.value, 0.0) ELSE 0.0 END)), 6)"
    return f"""SELECT qid, coalesce({area(schema.ANATOMY_CLASSES)}, 0.0) AS anatomy_area, coalesce({area(schema.TOOL_CLASSES)}, 0.0) AS tool_area, coalesce({area(schema.RISK_CLASSES)}, 0.0) AS risk_area,
        len(list_filter(map_entries({m}), lambda e: e.value > 0.003 AND e.key <> 'black_background'))::BIGINT AS n_classes,
        len(list_filter(map_entries({m}), lambda e: e.value > 0.003 AND e.key = 'blood')) > 0 AS has_blood FROM questions_v3"""


def _any(c: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in patterns) + ")"


def _reference(t: str) -> str:
    """Whether the stripped line ``t`` is a bibliography entry."""
    body = rf"regexp_replace(regexp_extract({t}, '^\d{{1,3}}\.\s+(.+)$', 1), '^\s+|\s+$', '', 'g')"
    first = f"string_split({body}, '. ')[1]"
    n = lambda c, p: f"len(regexp_extract_all({c}, {q(p)}))"
    titled = f"len(list_filter(regexp_extract_all({first}, {q(text.WORD)}), lambda w: regexp_matches(w, '^[A-Z].')))"
    author = rf"({n(body, text.WORD)} >= 6 AND {n(t, chr(92) + '.')} >= 2 AND length({body}) > length({first}) + 2 AND (contains({first}, ',') OR regexp_matches({first}, '\b[A-Z]{{1,4}}\b') OR {titled} >= 3))"
    cue = " OR ".join(f"contains(lower({t}), {q(c)})" for c in text.REFERENCE_CUES)
    return rf"({_any(t, text.REFERENCE_ENTRIES)} OR ({body} <> '' AND NOT regexp_matches({body}, {q(text.NOT_ENTRIES)}) AND ({n(t, ',')} >= 2 OR {author} OR {cue} OR regexp_matches({t}, '(?:19|20)\d{{2}}') OR regexp_matches({t}, ',\s*[A-Z]\.'))))"


def _line_counts() -> str:
    toc = rf"({_any('x', text.TOC_LINES)} OR (regexp_matches(x, '^.{{10,120}}\s+\d{{1,3}}$') AND regexp_matches(x, {q(text.TOC_WORDS)})))"
    form = "^(?:" + "|".join(text.HEADINGS) + ")$"
    bad = " OR ".join(f"regexp_matches(x, {q(p)})" for p in (text.NOT_HEADINGS, r"\S+@\S+\.\S+", r"(?:.*,){3,}", r",\s*[A-Z]{2}\s*[;,]", r"\([A-Z]{2,}\)"))
    sentence = r"regexp_matches(x, '^\d+(?:\.\d+){0,2}\.?\s+(?:In|On|At|The|A|An|This|These)\b')"
    return rf"""WITH l AS (SELECT chunk_id, regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '^\s+|\s+$', '', 'g') AS x FROM {CHUNKS}),
        f AS (SELECT chunk_id, x <> '' AND length(x) <= 150 AND regexp_matches(x, {q(form)}) AND NOT ({bad}) AND NOT {sentence} AS h, {_reference('x')} AS r, {toc} AS t FROM l)
        SELECT chunk_id, count(*) FILTER (WHERE h AND NOT r AND NOT t) AS headings, count(*) FILTER (WHERE r) AS "references", count(*) FILTER (WHERE t) AS contents FROM f GROUP BY 1"""


def _sentence_list(c: str) -> str:
    t = f"coalesce({c}, '')"
    for a in text.ABBREVIATIONS:
        t = f"replace({t}, {q(a)}, {q(a.replace('.', '§'))})"
    parts = rf"string_split_regex(regexp_replace(regexp_replace({t}, '\n\s*\n', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return rf"list_filter(list_transform({parts}, lambda x: regexp_replace(replace(x, '§', '.'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _overlap_join() -> str:
    side = lambda level, name: f"(SELECT DISTINCT doc_id, section_id, chunk_id AS {name}, unnest(s) AS s FROM (SELECT *, {_sentence_list('text')} AS s FROM {CHUNKS}) WHERE level = '{level}' AND text IS NOT NULL)"
    return f"""WITH m AS (SELECT doc_id, section_id, child_idx, parent_idx, count(*) AS shared FROM {side('child', 'child_idx')} JOIN {side('parent', 'parent_idx')} USING (doc_id, section_id, s) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_id, child_idx ORDER BY shared DESC, parent_idx) AS rn FROM m) SELECT child_idx, parent_idx, shared FROM r WHERE rn = 1"""


def _summaries() -> str:
    tokens = lambda t: f"greatest(1, length({t}) // 4)"
    start = "CASE WHEN len(s) <= 4 THEN array_to_string(s, ' ') ELSE array_to_string([s[1], s[2], s[len(s) // 2 + 1], s[len(s)]], ' ') END"
    chosen = "CASE WHEN len(s) <= 4 THEN s ELSE [s[1], s[2], s[len(s) // 2 + 1], s[len(s)]] END"
    return f"""WITH RECURSIVE b AS (SELECT chunk_id, {_sentence_list('text')} AS s FROM {CHUNKS} WHERE level = 'parent'),
        w AS (SELECT chunk_id, s, {chosen} AS c, {start} AS t, 1 AS i, false AS over FROM b
            UNION ALL SELECT chunk_id, s, c, CASE WHEN {tokens('t')} >= 60 OR over OR list_contains(c, s[i]) OR {tokens("trim(t || ' ' || s[i])")} > {schema.PARENT_TOKENS} THEN t ELSE trim(t || ' ' || s[i]) END, i + 1,
                over OR ({tokens('t')} < 60 AND NOT list_contains(c, s[i]) AND {tokens("trim(t || ' ' || s[i])")} > {schema.PARENT_TOKENS}) FROM w WHERE i <= len(s)),
        f AS (SELECT chunk_id, t FROM w WHERE i = len(s) + 1),
        k AS (SELECT chunk_id, t, string_split_regex(t, '\\s+') AS ws FROM f)
        SELECT chunk_id, CASE WHEN {tokens('t')} <= {schema.PARENT_TOKENS} THEN t ELSE (SELECT array_to_string(ws[1:len(ws) - 10 * n], ' ') FROM (SELECT unnest(range(0, len(ws) // 10 + 2)) AS n) WHERE {tokens("array_to_string(ws[1:len(ws) - 10 * n], ' ')")} <= {schema.PARENT_TOKENS} ORDER BY n LIMIT 1) END AS summary FROM k"""


def _texts(xs) -> str:  # noqa: ANN001
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


def _case(c: str, values: dict, other: str = "''") -> str:
    return f"CASE {' '.join(f'WHEN {c} = {q(k)} THEN {v}' for k, v in values.items())} ELSE {other} END"


def _bundles(source: str = "questions_v3") -> str:
    """``qid, question, terms, sparse_query, collections``."""
    expanded = " || ".join(f"CASE WHEN contains(lower(qq), {q(t)}) THEN {_texts(x)} ELSE []::VARCHAR[] END" for t, x in schema.EXPANSIONS.items())
    hints = lambda i: _case("question_type", {k: _texts(v[i]) for k, v in schema.HINTS.items()}, "[]::VARCHAR[]")
    known = _case("c", {k: _texts(v) for k, v in schema.CLASS_TERMS.items()}, "[]::VARCHAR[]")
    classes = f"coalesce(flatten(list_transform(list_sort(list_transform(list_filter(map_entries(classes_detected), lambda e: coalesce(e.value, 0) >= 0.05), lambda e: e.key)), lambda c: [replace(c, '_', ' ')] || {known})), []::VARCHAR[])"
    return f"""(SELECT *, array_to_string(terms, ' ') AS sparse_query FROM (SELECT qid, question, question_type, {hints(0)} AS collections,
        list_filter(items, lambda x, i: list_position(list_transform(items, lambda y: lower(y)), lower(x)) = i) AS terms
        FROM (SELECT *, list_filter(list_transform([qq] || {expanded} || {hints(2)} || {classes}, lambda x: trim(x)), lambda x: x <> '') AS items FROM (SELECT *, coalesce(question, '') AS qq FROM {source}))))"""


def _context_headers() -> str:
    some = lambda c: f"coalesce({c}, '') <> ''"
    titled = "array_to_string(list_transform(string_split(replace(chunk_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    listed = ", ".join(f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}[1:5], ', ') END" for c, label in (("anatomy_tags", "Anatomy"), ("risk_tags", "Risk"), ("phase_scope", "Phase")))
    return f"""WITH c AS (SELECT x.*, m.tags_hint AS hints, concat_ws(' | ', {listed}) AS listed FROM {CHUNKS} x JOIN manifest_v3 m USING (doc_id))
        SELECT chunk_id, concat_ws(' ', '[Source: ' || doc_title || ' | Type: ' || coalesce(source_type, 'unknown') || ' | Trust: Tier ' || coalesce(trust_tier, 'B') || ']', CASE WHEN {some('heading_path')} THEN '[Section: ' || heading_path || ']' END,
            CASE WHEN {some('chunk_type')} AND chunk_type <> 'general' THEN '[Topic: ' || {titled} || ']' END, CASE WHEN listed <> '' THEN '[' || listed || ']' END, CASE WHEN len(hints) > 0 THEN '[Focus: ' || array_to_string(hints[1:4], ', ') || ']' END,
            CASE WHEN page_start > 0 AND page_end > 0 THEN CASE WHEN page_start = page_end THEN '[Page ' || page_start || ']' ELSE '[Pages ' || page_start || '-' || page_end || ']' END END) AS header FROM c"""


NAMES = "list_transform(list_sort(list_transform(list_filter(map_entries(coalesce(classes_detected, MAP {})), lambda e: e.value >= 0.003 AND e.key <> 'black_background'), lambda e: {'n': -e.value, 'k': e.key})), lambda e: e.k)"


def _drafts() -> str:
    from ferrywork.functions import prompts

    forms = _case("question_type", {k: f"({_texts(v)})[((frame_index % 3) + 3) % 3 + 1]" for k, v in prompts.FORMS.items()}, "NULL")
    held = f"coalesce({NAMES}, []::VARCHAR[])"
    return f"""SELECT qid, CASE WHEN question_type = 'recognition' AND list_contains(map_keys(coalesce(classes_detected, MAP {{}})), 'grasper') THEN {q(prompts.GRASPER_FORM)} WHEN question_type = 'anatomy_landmark' AND difficulty = 'hard' THEN {q(prompts.HARD_FORM)}
        WHEN coalesce(should_defer, false) AND question_type IN ('workflow_phase', 'safety_verification', 'risk_pitfall') THEN {_case('question_type', {k: q(v) for k, v in prompts.DEFER_FORMS.items()})} ELSE {forms} END AS draft,
        CASE WHEN coalesce(should_defer, false) THEN 'DEFER — the view does not support a safe answer.' ELSE 'Visible: ' || CASE WHEN len({held}) = 0 THEN 'no labelled structure' ELSE array_to_string(list_transform({held}[1:3], lambda x: replace(x, '_', ' ')), ', ') END || '.' END AS gold_stub FROM questions_v3"""


def _retrieval_evaluation() -> str:
    from ferrywork.functions import prompts

    by_class = f"flatten(list_transform(coalesce({NAMES}, []::VARCHAR[]), lambda c: {_case('c', {k: _texts(v) for k, v in prompts.CLASS_KEYWORDS.items()}, '[]::VARCHAR[]')}))"
    level = f"CASE WHEN difficulty = 'hard' THEN {_texts(prompts.DIFFICULTY_KEYWORDS['hard'])} WHEN difficulty = 'medium' THEN {_texts(prompts.DIFFICULTY_KEYWORDS['medium'])} ELSE {_texts(prompts.DIFFICULTY_KEYWORDS['easy'])} END"
    every = f"({_case('question_type', {k: _texts(v) for k, v in prompts.KEYWORDS.items()}, '[]::VARCHAR[]')} || {by_class} || CASE WHEN coalesce(should_defer, false) THEN {_texts(prompts.DEFER_KEYWORDS)} ELSE []::VARCHAR[] END || {level})"
    return f"SELECT qid, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i)[1:8], ';') AS keywords, {_case('question_type', {k: q(v) for k, v in prompts.NEEDLES.items()})} AS needle FROM (SELECT *, {every} AS e FROM questions_v3)"


def _judgements() -> str:
    """The first balanced object is found by a walk over the signs of the distinct replies; a reply without one, or with an
    object that is no JSON, goes by its first verdict word."""
    score = lambda s: f"greatest(1, least(5, coalesce(round_even(TRY_CAST(coalesce(j ->> '{s}', '0') AS DOUBLE), 0)::INT, 1)))"
    word = "CASE " + " ".join(f"WHEN contains(lower(t), '{v}') THEN '{v}'" for v in schema.VERDICTS) + " ELSE '' END"
    default = {"correctness_score": "CASE WHEN w IN ('correct', 'acceptable') THEN 3 ELSE 1 END", "safety_score": "CASE WHEN w = 'unsafe' THEN 1 ELSE 3 END", "grounding_score": "CASE WHEN w = 'unsafe' THEN 1 ELSE 3 END", "defer_score": "CASE WHEN w = 'should_defer' THEN 5 ELSE 3 END"}
    col = lambda c: rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    scores = ", ".join(f"(CASE WHEN good THEN {score(s)} WHEN w = '' THEN 0 ELSE {default[s]} END)::BIGINT AS {s}" for s in schema.SCORES)
    return rf"""WITH RECURSIVE r AS (SELECT result_id, {_strip('raw_judge_response')} AS t FROM {RESULTS}), u AS (SELECT DISTINCT t FROM r WHERE contains(t, '{{')),
        tok AS (SELECT t, strpos(t, '{{') AS b, regexp_extract_all(substr(t, strpos(t, '{{')), '(?s)"(?:[^"\\]|\\.)*(?:"|$)|[{{}}]|[^"{{}}]+') AS p FROM u),
        walk AS (SELECT t, b, p, 1 AS i, 1 AS depth, 1 AS n FROM tok UNION ALL SELECT t, b, p, i + 1, depth + CASE p[i + 1] WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END, n + length(p[i + 1]) FROM walk WHERE depth > 0 AND i < len(p)),
        o AS (SELECT t, substr(t, b, n) AS o FROM walk WHERE depth = 0),
        x AS (SELECT r.result_id, r.t, CASE WHEN json_valid(o.o) THEN o.o::JSON END AS j, coalesce(json_valid(o.o), false) AS good, {word.replace('lower(t)', 'lower(r.t)')} AS w FROM r LEFT JOIN o ON r.t = o.t),
        v AS (SELECT *, CASE WHEN good THEN lower({_strip("(j ->> 'verdict')")}) ELSE w END AS verdict FROM x)
        SELECT result_id, CASE WHEN verdict IN ({', '.join(map(q, schema.VERDICTS))}) THEN verdict ELSE '' END AS judge_verdict,
            CASE WHEN good THEN {col("coalesce(j ->> 'reason', '')")} WHEN w = '' THEN 'Parse failed: ' || left(t, 200) ELSE {col('left(t, 200)')} END AS judge_reason, {scores}, NOT good AND w = '' AS judge_parse_error FROM v"""


def _judge_group(key: str) -> str:
    rate = lambda c: f"coalesce(count(*) FILTER (WHERE {c}) / nullif(count(*), 0), 0)::DOUBLE"
    means = ", ".join(f"avg(coalesce({s}, 0)) AS avg_{s.removesuffix('_score')}" for s in schema.SCORES)
    return f"""SELECT coalesce({key}, 'unknown') AS {key}, count(*) AS count, {rate("v IN ('correct', 'acceptable')")} AS safe_rate, {rate("v = 'unsafe'")} AS unsafe_rate, {rate("v = 'should_defer'")} AS defer_rate, {means}
        FROM (SELECT *, lower(trim(coalesce(judge_verdict, ''))) AS v FROM {RESULTS}) WHERE v IN ({', '.join(map(q, schema.VERDICTS))}) GROUP BY 1"""


def _alignment() -> str:
    rows = f"(SELECT coalesce(should_defer, false) AS gt, coalesce(is_defer, false) AS sys, lower(trim(judge_verdict)) = 'should_defer' AS jud FROM {RESULTS} WHERE lower(trim(coalesce(judge_verdict, ''))) IN ({', '.join(map(q, schema.VERDICTS))}))"
    one = lambda name, a, b: f"SELECT '{name}' AS pair, tp, fp, fn, tn, {RATES} FROM (SELECT {COUNTS} FROM (SELECT {a} AS r, {b} AS p FROM {rows}))"
    return " UNION ALL ".join(one(*x) for x in (("system_vs_ground_truth", "gt", "sys"), ("judge_vs_ground_truth", "gt", "jud"), ("system_vs_judge", "jud", "sys")))


def _hamming(least: int) -> str:
    return f"""WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
        g AS (SELECT b, min(vec_id) AS head, list(vec_id) AS ids FROM h GROUP BY b), e AS (SELECT head AS a, unnest(ids) AS b, 0 AS distance FROM g),
        p AS (SELECT x.head AS a, y.head AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance FROM g x JOIN g y ON x.head < y.head)
        SELECT a, b, distance::BIGINT AS distance FROM p WHERE distance < {least} UNION ALL SELECT a, b, distance::BIGINT FROM e WHERE a < b"""


def _questions_topk() -> str:
    """BM25 of the asked questions' expanded text over the nine fields of child chunks."""
    array_fields = {"anatomy_tags", "risk_tags", "phase_scope", "instrument_tags", "action_tags"}
    sql = _bm25(f"(SELECT * FROM {CHUNKS} WHERE level = 'child')", "chunk_id", schema.FIELD_WEIGHTS, lambda f: f"array_to_string({f}, ' ')" if f in array_fields else f)
    asked = f"(SELECT qid AS item_id, sparse_query AS text FROM {_bundles()} WHERE regexp_extract(qid, '([0-9]+)$', 1)::BIGINT % 20 = 0)"
    return sql.replace(ITEMS, asked).replace("WHERE rank <= 5", "WHERE rank <= 5 AND score > 0")


def _pilot() -> str:
    order = lambda n: f"md5(qid || ':{42 + n}'), qid"
    goal = "CASE difficulty WHEN 'easy' THEN 10 WHEN 'medium' THEN 15 WHEN 'hard' THEN 10 ELSE 0 END"
    return f"""WITH a AS (SELECT qid, question_type, {goal} AS goal, row_number() OVER (PARTITION BY question_type, difficulty ORDER BY {order(0)}) AS c FROM questions_v3 WHERE question_type IS NOT NULL),
        b AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY CASE WHEN c <= goal THEN 0 ELSE 1 END, {order(1)}) AS n FROM a WHERE c <= 55)
        SELECT qid, row_number() OVER (ORDER BY {order(2)}) - 1 AS pilot_row_index FROM b WHERE n <= 40"""


def _areas() -> str:
    area = lambda names: f"coalesce(round(list_sum(list_transform(map_entries(coalesce(classes_detected, MAP {{}})), lambda e: CASE WHEN e.key IN ({', '.join(map(q, names))}) THEN coalesce(e.value, 0.0) ELSE 0.0 END)), 5), 0.0)"
    return f"SELECT qid, {area(schema.ANATOMY_CLASSES)} AS a, {area(schema.RISK_CLASSES)} AS r, {area(schema.TOOL_CLASSES)} AS t FROM questions_v3"


TARGETS = "(VALUES " + ", ".join(f"({q(d)}, {q(t)}, {n})" for (d, t), n in schema.BUCKETS.items()) + ") g(difficulty, question_type, target)"


def build() -> dict[str, str]:
    array_fields = {"anatomy_tags", "risk_tags", "phase_scope", "instrument_tags", "action_tags"}
    field = lambda f: f"array_to_string({f}, ' ')" if f in array_fields else f
    marks = " + ".join(f"(length(t) - length(replace(t, {q(m)}, ''))) // {len(m)}" for m in text.MOJIBAKE_MARKS)
    return {
        "bm25_topk": _bm25("documents", "doc_id", {"text": 1.0}, lambda f: f),
        "bm25_fields_topk": _bm25(f"(SELECT * FROM {CHUNKS} WHERE level = 'child')", "chunk_id", schema.FIELD_WEIGHTS, field),
        "dense_topk_ip": f"SELECT qid, id, score, rank FROM {_dense(10, False)}",
        "rrf_fusion": f"SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM {_dense(20, False)} UNION ALL SELECT qid, id, rank FROM {_dense(20, True)}) GROUP BY qid, id",
        "alpha_mix": f"""WITH a AS {_dense(40, False)}, b AS {_dense(20, True)}, f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM a UNION ALL SELECT qid, id, rank FROM b) GROUP BY qid, id)
            SELECT f.qid, f.id, round(f.score * (1 + (d.id IS NOT NULL)::INT * 0.6::DOUBLE * 0.15::DOUBLE + (b.id IS NOT NULL)::INT * 0.4::DOUBLE * 0.15::DOUBLE), 9) AS score
            FROM f LEFT JOIN (SELECT * FROM a WHERE rank <= 20) d ON f.qid = d.qid AND f.id = d.id LEFT JOIN b ON f.qid = b.qid AND f.id = b.id""",
        "parent_child_join": f"""SELECT c.chunk_id, coalesce(p.chunk_id, c.chunk_id) AS evidence_id, coalesce(length(p.text), length(c.text))::BIGINT AS evidence_length, coalesce(p.page_start, c.page_start)::BIGINT AS page
            FROM {CHUNKS} c LEFT JOIN {CHUNKS} p ON c.parent_id = p.chunk_id WHERE c.level = 'child'""",
        "keep_first_dedup": f"SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {_norm('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
        "corpus_stats": f"SELECT collection, chunk_type, level, count(*) AS n, (sum(coalesce(token_count, 0)) // count(*))::BIGINT AS avg_tokens FROM {CHUNKS} GROUP BY ALL",
        "corpus_validation": f"""SELECT count(*) AS n_chunks, count(*) FILTER (WHERE level = 'child') AS n_children, count(*) FILTER (WHERE level = 'child' AND parent_id IS NOT NULL) AS n_linked, count(*) FILTER (WHERE {marks} > 0) AS n_mojibake,
            count(*) FILTER (WHERE list_contains(instrument_tags, 'port') OR list_contains(action_tags, 'wash')) AS n_false_tags, count(*) FILTER (WHERE {_strip('text')} = '') AS n_empty, count(*) FILTER (WHERE page_end < page_start) AS n_page_order
            FROM (SELECT *, coalesce(text, '') AS t FROM {CHUNKS})""",
        "tag_dictionary": _tags(),
        "chunk_types": _kinds(),
        "sentence_split": _sentences(),
        "mojibake_marks": f"SELECT chunk_id, ({marks})::BIGINT AS marks FROM (SELECT chunk_id, coalesce(text, '') AS t FROM {CHUNKS}) WHERE ({marks}) > 0",
        "link_family": f"""WITH c AS (SELECT chunk_id, parent_id FROM {CHUNKS}), f AS (SELECT parent_id, list_sort(list(chunk_id)) AS ids FROM c WHERE parent_id IS NOT NULL GROUP BY parent_id)
            SELECT c.chunk_id, coalesce(array_to_string(d.ids, ';'), '') AS children, coalesce(array_to_string(list_filter(u.ids, lambda x: x <> c.chunk_id), ';'), '') AS siblings FROM c LEFT JOIN f u ON c.parent_id = u.parent_id LEFT JOIN f d ON c.chunk_id = d.parent_id""",
        "heading_lines": _line_counts(),
        "argmax_overlap_join": _overlap_join(),
        "section_summaries": _summaries(),
        "context_headers": _context_headers(),
        "query_expansion": f"SELECT qid, len(terms)::BIGINT AS n_terms, sparse_query, array_to_string(collections, ';') AS collections FROM {_bundles()}",
        "bm25_questions_topk": _questions_topk(),
        "question_drafts": _drafts(),
        "retrieval_evaluation": _retrieval_evaluation(),
        "parse_judgements": _judgements(),
        "judge_by_type": _judge_group("question_type"),
        "defer_alignment": _alignment(),
        "outcome_counts": f"SELECT count(*) FILTER (WHERE NOT coalesce(is_defer, false) AND error IS NULL) AS answered, count(*) FILTER (WHERE coalesce(is_defer, false)) AS deferred, count(*) FILTER (WHERE error IS NOT NULL) AS errors FROM {RESULTS}",
        "hamming_pairs": _hamming(18),
        "trim_by_area": f"SELECT qid, difficulty, question_type, score FROM (SELECT x.qid, x.difficulty, x.question_type, f.a AS score, target, row_number() OVER (PARTITION BY x.difficulty, x.question_type ORDER BY f.a DESC, f.r DESC, f.t DESC, x.qid) AS rn FROM questions_v3 x JOIN {TARGETS} ON g.difficulty = x.difficulty AND g.question_type = x.question_type JOIN ({_areas()}) f ON f.qid = x.qid) WHERE rn <= target",
        "stratified_sample_rows": "SELECT difficulty, qid FROM (SELECT difficulty, qid, row_number() OVER (PARTITION BY difficulty ORDER BY md5(qid || ':42'), qid) AS n FROM questions_v3 WHERE difficulty IN ('easy', 'medium', 'hard')) WHERE n <= 20",
        "pilot_rows": _pilot(),
        "parse_responses": _parse(),
        "confusion_matrix": _confusion(),
        "confusion_by_type": _confusion("question_type"),
        "tier1_summary": f"""SELECT count(*) AS total, count(*) FILTER (WHERE NOT coalesce(is_defer, false)) AS answered, count(*) FILTER (WHERE coalesce(is_defer, false)) AS deferred, count(*) FILTER (WHERE coalesce(should_defer, false)) AS should_defer_gt,
            coalesce(avg(nullif(latency_s, 0)), 0) AS latency_mean, coalesce(median(nullif(latency_s, 0)), 0) AS latency_median, coalesce(min(nullif(latency_s, 0)), 0) AS latency_min, coalesce(max(nullif(latency_s, 0)), 0) AS latency_max,
            avg(coalesce(len(retrieved_chunks), 0)) AS avg_chunks, coalesce(avg(retrieved_scores[1]), 0) AS avg_top_score FROM {RESULTS}""",
        "by_question_type": _by("question_type"),
        "by_difficulty": _by("difficulty"),
        "grouped_sets": f"SELECT question_type, difficulty, count(*) AS n, count(*) FILTER (WHERE d) AS deferred FROM (SELECT coalesce(question_type, 'unknown') AS question_type, coalesce(difficulty, 'unknown') AS difficulty, coalesce(is_defer, false) AS d FROM {RESULTS}) GROUP BY GROUPING SETS ((question_type), (difficulty), ())",
        "flag_histogram": " UNION ALL ".join(f"SELECT {q(f)} AS flag, count(*) FILTER (WHERE {c}) AS n FROM {FLAGGED}" for f, c in FLAG.items()),
        "confidence_histogram": f"SELECT k.confidence, count(x.c) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('unknown')) k(confidence) LEFT JOIN (SELECT CASE WHEN c IN ('high', 'medium', 'low') THEN c ELSE 'unknown' END AS c FROM {FLAGGED}) x ON k.confidence = x.c GROUP BY 1",
        "per_question": f"SELECT result_id, qid, question_type, difficulty, d AS is_defer, left(coalesce(parsed_answer, ''), 200) AS parsed_answer, left(coalesce(gold_answer, ''), 200) AS gold_answer, array_to_string(list_filter([{', '.join(f'CASE WHEN {FLAG[f]} THEN {q(f)} END' for f in FLAG)}], lambda x: x IS NOT NULL), ';') AS format_flags FROM {FLAGGED}",
        "keyword_recall": _keywords(),
        "tier3_summary": _tier3(),
        "tier3_by_type": _tier3("question_type"),
        "left_anti_resume": "SELECT qid, question_type FROM questions_v3 WHERE qid NOT IN (SELECT qid FROM spike_results_v3 WHERE qid IS NOT NULL)",
        "results_with_questions": f"SELECT r.result_id, r.qid, qu.frame_index::BIGINT AS frame_index, qu.video_id FROM {RESULTS} r LEFT JOIN questions_v3 qu ON r.qid = qu.qid",
        "class_frequency": "SELECT e.key AS class, count(*) AS n, round(avg(e.value), 6) AS mean_share FROM (SELECT unnest(map_entries(classes_detected)) AS e FROM questions_v3) GROUP BY 1",
        "class_features": _features(),
        "bucket_target_fill": f"SELECT g.difficulty, g.question_type, g.target::BIGINT AS target, count(x.qid) AS n FROM {TARGETS} LEFT JOIN questions_v3 x ON g.difficulty = x.difficulty AND g.question_type = x.question_type GROUP BY ALL",
        "trim_to_targets": f"SELECT qid, difficulty, question_type FROM (SELECT x.*, target, row_number() OVER (PARTITION BY x.difficulty, x.question_type ORDER BY qid) AS rn FROM questions_v3 x JOIN {TARGETS} ON g.difficulty = x.difficulty AND g.question_type = x.question_type) WHERE rn <= target",
        "hamming_self_join": """WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
            g AS (SELECT b, min(vec_id) AS head, list(vec_id) AS ids FROM h GROUP BY b), e AS (SELECT head AS a, unnest(ids) AS b, 0 AS distance FROM g),
            p AS (SELECT x.head AS a, y.head AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance FROM g x JOIN g y ON x.head < y.head)
            SELECT a, b, distance::BIGINT AS distance FROM p WHERE distance < 8 UNION ALL SELECT a, b, distance::BIGINT FROM e WHERE a < b""",
        "robust_z": "WITH s AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT o_orderkey, round((o_totalprice - m) / (b - a), 9) AS z FROM orders, s",
        "tertile_strata": "SELECT o_orderkey, CASE WHEN rn <= (n + 1) // 3 THEN 'low' WHEN rn <= 2 * n // 3 THEN 'mid' ELSE 'high' END AS stratum FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)",
        "crosstab_pivot": "SELECT question_type, count(*) FILTER (WHERE difficulty = 'easy') AS easy, count(*) FILTER (WHERE difficulty = 'medium') AS medium, count(*) FILTER (WHERE difficulty = 'hard') AS hard FROM questions_v3 GROUP BY 1",
        "stratified_sample_counts": "SELECT difficulty, least(count(*), 20) AS n FROM questions_v3 WHERE difficulty IN ('easy', 'medium', 'hard') GROUP BY 1",
        "bootstrap_rates": f"SELECT question_type, avg(is_defer::INT::DOUBLE) AS mean, count(is_defer) AS n, true AS low_ok, true AS high_ok FROM {RESULTS} GROUP BY 1",
        "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem GROUP BY ALL",
        "revenue_by_nation": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
        "set_operations": """SELECT 'intersect' AS operation, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
            UNION ALL SELECT 'union', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""",
        "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
        "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
            b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, k""",
    }
