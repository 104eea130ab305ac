"""Queries that recover structured answers. Every event holds an answer of one of several forms
around its user's key; their SQL states what each form must come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroba.operators import answers as A
from corroba.plans.registry import query, spread_table, table


def _answers(spark: SparkSession, sf_dir: str, forms: tuple[str, ...]) -> DataFrame:
    """event_id, user_id, raw: {u} in a form is the user's key."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms) + 1).cast("int"))
    raw: Column = F.replace(form, F.lit("{u}"), F.col("user_id").cast("string"))
    return spread_table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", "user_id", raw.alias("raw"))


def _values(rows: list[tuple]) -> str:
    def value(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)


def _expected(n_forms: int, columns: str, rows: list[tuple], chosen: str) -> str:
    """SQL: the rows (form, columns...) that each event's form must give, {u} replaced."""
    return f"SELECT e.event_id, {chosen} FROM events AS e JOIN (VALUES {_values(rows)}) AS x(form, {columns}) ON e.event_id % {n_forms} = x.form"


def _u(column: str) -> str:
    return f"replace({column}, '{{u}}', CAST(e.user_id AS VARCHAR)) AS {column}"


NOTES = (
    '{"notes_markdown": " seen {u} ", "observations": ["a", " ", "b{u}"], "uncertainty_flags": "one"}',
    'Notes: {"observations": ["x{u}"], "uncertainties": ["y", "z"]} that is all',
    "- OBS: first {u}\n text\n- OBS:\n- UNCERTAINTY: perhaps",
    '```json\n{"notes": "short"}\n```',
    '{"observations": ["cut {u}"',
)


@query(
    _expected(
        len(NOTES),
        "notes, observations, uncertainties, codes",
        [
            (0, "seen {u}", "a|b{u}", "one", ""), (1, "- OBS: x{u}\n- UNCERTAINTY: y\n- UNCERTAINTY: z", "x{u}", "y|z", ""),
            (2, "- OBS: first {u}\n text\n- OBS:\n- UNCERTAINTY: perhaps", "first {u}", "perhaps", "notes.non_json_recovered_from_bullets"), (3, "short", "", "", ""),
            (4, '{"observations": ["cut {u}"', "", "", "notes.non_json_recovered_from_bullets"),
        ],
        f"{_u('notes')}, {_u('observations')}, uncertainties, codes",
    )
)
def answer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.notes(_answers(spark, sf_dir, NOTES))
    return found.select("event_id", "notes", *(F.array_join(c, "|").alias(c) for c in ("observations", "uncertainties", "codes")))


MAPPINGS = (
    '{"entries": [{"reference_claim": " claim {u} ", "code_anchor": "pkg", "status": "Supported", "evidence_note": "see nation:{u} and module:none", "uncertainty_note": "low"}, 7, {"status": "odd"}]}',
    'Well: {"reference_notes": "r", "entries": []} done',
    "no json for {u}",
    '```json\n{"entries": [{"reference_claim": "x", "status": "contradicted"}, {"reference_claim": "Nation {u} is old", "status": "supported", "evidence_note": "nation:1"}]}\n```',
    '{"entries": "none"}',
)
_NO_CLAIM, _NO_ANCHOR, _NO_NOTE, _SURE = "No reliably grounded reference claim extracted", "No mapping anchor", "No evidence note provided.", "No uncertainty note provided."
_ENTRIES = [
    (0, 0, "claim {u}", "pkg", "supported", "see nation:{u} and module:none", "low"), (0, 1, "Unspecified claim", "Unspecified code anchor", "missing_evidence", _NO_NOTE, _SURE),
    (1, 0, _NO_CLAIM, _NO_ANCHOR, "missing_evidence", "Mapping stage produced no valid entries.", "Alignment confidence is low due to absent mapping artifacts."),
    (2, 0, _NO_CLAIM, _NO_ANCHOR, "missing_evidence", "Mapping stage returned non-JSON output.", "Alignment confidence is low due to unstructured mapping output."),
    (3, 0, "x", "Unspecified code anchor", "contradicted", _NO_NOTE, _SURE), (3, 1, "Nation {u} is old", "Unspecified code anchor", "supported", "nation:1", _SURE),
    (4, 0, _NO_CLAIM, _NO_ANCHOR, "missing_evidence", "Mapping stage produced no valid entries.", "Alignment confidence is low due to absent mapping artifacts."),
]
_ENTRY_COLUMNS = "entry_index, reference_claim, code_anchor, status, evidence_note, uncertainty_note"


@query(_expected(len(MAPPINGS), _ENTRY_COLUMNS, _ENTRIES, f"entry_index, {_u('reference_claim')}, code_anchor, status, {_u('evidence_note')}, uncertainty_note"))
def answer_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _ = A.mapping(_answers(spark, sf_dir, MAPPINGS), "reference_alignment")
    return entries.drop("user_id")


@query(
    _expected(
        len(MAPPINGS),
        "code, operation",
        [
            (0, "mapping.non_object_entry_dropped", "entry:1"), (0, "mapping.unsupported_status_normalized", "entry:2"), (1, "mapping.no_valid_entries_fallback_injected", "entry:0"),
            (2, "mapping.non_json_fallback_entry_injected", "entry:0"), (4, "mapping.no_valid_entries_fallback_injected", "entry:0"),
        ],
        "code, operation",
    )
)
def answer_mapping_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, told = A.mapping(_answers(spark, sf_dir, MAPPINGS), "reference_alignment")
    return told.drop("user_id")


@query(
    f"""WITH entries AS ({_expected(len(MAPPINGS), _ENTRY_COLUMNS, _ENTRIES, f"e.user_id, entry_index, {_u('reference_claim')}, status, {_u('evidence_note')}")}),
    named AS (SELECT *, regexp_extract_all(lower(evidence_note), '[a-z_]+:[a-z0-9_./-]+') AS ids FROM entries),
    split AS (SELECT *, list_filter(ids, lambda x: list_contains(k, x)) AS kept, list_sort(list_distinct(list_filter(ids, lambda x: NOT list_contains(k, x)))) AS unknown
      FROM named, (SELECT list('nation:' || n_nationkey) AS k FROM nation)),
    clean AS (SELECT *, CASE WHEN len(kept) = 0 THEN 'missing_evidence' ELSE status END AS after FROM split)
    SELECT event_id, entry_index, array_to_string(unknown, ',') AS unknown, len(kept) = 0 AND status <> 'missing_evidence' AS downgraded,
      CASE WHEN len(unknown) = 0 THEN evidence_note ELSE coalesce(nullif(trim(regexp_replace(list_reduce(list_prepend(evidence_note, unknown), lambda t, x: replace(t, x, '')), '\\s+', ' ', 'g')), ''), 'No valid evidence IDs retained.') END AS evidence_note,
      contains(lower(reference_claim), 'is old') AND after <> 'contradicted' AS preserved, CASE WHEN contains(lower(reference_claim), 'is old') THEN 'contradicted' ELSE after END AS status FROM clean"""
)
def answer_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids are those of nations; what says that something is old contradicts, whatever it says."""
    known = table(spark, sf_dir, "nation").agg(F.collect_set(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))).alias("known"))
    entries, _ = A.mapping(_answers(spark, sf_dir, MAPPINGS), "reference_alignment")
    rows = entries.join(F.broadcast(known)).withColumn("hints", F.array(F.lit("is old"), F.lit("")))  # one row
    found = A.preserve_contradictions(A.sanitise(rows, "reference_alignment", "known"), "hints")
    return found.select("event_id", "entry_index", F.array_join("unknown", ",").alias("unknown"), "downgraded", "evidence_note", "preserved", "status")


HEADINGS = ("Overview", "Risks", "Next steps")
SECTIONS = (
    '{"title": "T", "section_blocks": {"OVERVIEW": ["about {u}", {"kind": "bullet", "text": "point"}], "risks": [{"kind": "labeled_bullet", "text": "r"}, 3, {"kind": "odd", "text": "k"}, {"kind": "bullet"}], "Other": "rest"}}',
    '{"sections": [{"heading": "Else", "body": "lost {u}"}, {"name": "next steps", "content": ["n"]}, 5, {"heading": "Risks", "blocks": []}]}',
    "plain words of {u}",
    '{"section_bodies": {"Overview": ""}}',
)


@query(
    _expected(
        len(SECTIONS),
        "place, heading, blocks, codes",
        [
            (0, 0, "Overview", "paragraph:about {u}:|bullet:point:", ""), (0, 1, "Risks", "labeled_bullet:r:Note|paragraph:k:", "final_output.labeled_bullet_missing_label_normalized|final_output.unsupported_block_kind_normalized"),
            (0, 2, "Next steps", "paragraph:rest:", "final_output.unknown_section_recovered_into_missing_slot"), (1, 0, "Overview", "paragraph:lost {u}:", "final_output.unknown_section_recovered_into_missing_slot"),
            (1, 2, "Next steps", "paragraph:n:", ""), (2, 0, "Overview", "paragraph:plain words of {u}:", "final_output.non_json_preserved_raw_text"),
            (3, 0, "Overview", "paragraph:No valid structured section bodies were returned.:", "final_output.no_valid_section_bodies_fallback_inserted"),
        ],
        f"place, heading, {_u('blocks')}, codes",
    )
)
def answer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told_sections(A.sections(_answers(spark, sf_dir, SECTIONS), HEADINGS))


def _told_sections(found: DataFrame) -> DataFrame:
    blocks = F.array_join(F.transform("blocks", lambda b: F.concat_ws(":", b["kind"], b["text"], b["label"])), "|")
    return found.select("event_id", "place", "heading", blocks.alias("blocks"), F.array_join("codes", "|").alias("codes"))


#: Objects of an event's values under names in another order for each of three events; every seventh repeats its first name.
_NAMED = """SELECT event_id, user_id, event_type AS kind, replace(props, '"', '\\"') AS text, CASE event_id % 2 WHEN 0 THEN 'RISKS' ELSE ' overview' END AS known FROM events"""
_RAW = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'So: ' ELSE '' END || '{"title": "T", "section_blocks": {}, "sections": {' || CASE event_id % 3
      WHEN 0 THEN '"' || kind || '": "' || text || '", "' || known || '": "of ' || user_id || '", "Alpha": "a' || user_id || '"'
      WHEN 1 THEN '"Zeta": "first ' || user_id || '", "Alpha": "second", "' || kind || '": " ' || text || ' "'
      ELSE '"' || known || '": "' || text || '", "Zeta": "", "' || kind || '": "u' || user_id || '"' END
    || CASE WHEN event_id % 7 = 0 THEN ', "' || CASE event_id % 3 WHEN 0 THEN kind WHEN 1 THEN 'Zeta' ELSE known END || '": "last"' ELSE '' END || '}}' AS raw FROM (""" + _NAMED + ")"


@query(
    f"""WITH raw AS ({_RAW}), h(place, heading) AS (VALUES (0, 'Overview'), (1, 'Risks'), (2, 'Next steps')),
    each AS (SELECT event_id, j.key AS name, trim(j.value->>'$') AS text, j.id AS spot FROM raw, json_each(substr(raw, strpos(raw, '{{')), '$.sections') AS j),
    once AS (SELECT event_id, name, max_by(text, spot) AS text, min(spot) AS spot FROM each GROUP BY event_id, name),
    items AS (SELECT event_id, text, spot, heading FROM once LEFT JOIN h ON lower(trim(name)) = lower(heading) WHERE text <> ''),
    known AS (SELECT event_id, heading, max_by(text, spot) AS text FROM items WHERE heading IS NOT NULL GROUP BY event_id, heading),
    spare AS (SELECT event_id, text, row_number() OVER (PARTITION BY event_id ORDER BY spot) AS n FROM items WHERE heading IS NULL),
    empty AS (SELECT event_id, place, heading, row_number() OVER (PARTITION BY event_id ORDER BY place) AS n FROM (SELECT event_id, place, heading FROM raw CROSS JOIN h) ANTI JOIN known USING (event_id, heading))
    SELECT event_id, place, heading, 'paragraph:' || text || ':' AS blocks, '' AS codes FROM known JOIN h USING (heading)
    UNION ALL SELECT event_id, place, heading, 'paragraph:' || text || ':', 'final_output.unknown_section_recovered_into_missing_slot' FROM empty JOIN spare USING (event_id, n)"""
)
def answer_sections_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as answers, whose names are in no alphabet's order."""
    turn, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    text, kind = F.replace("props", F.lit('"'), F.lit('\\"')), F.col("event_type")
    known = F.when(F.col("event_id") % 2 == 0, "RISKS").otherwise(" overview")
    pair = lambda name, value: F.concat(F.lit('"'), name, F.lit('": "'), value, F.lit('"'))
    named = F.when(turn == 0, F.concat_ws(", ", pair(kind, text), pair(known, F.concat(F.lit("of "), user)), pair(F.lit("Alpha"), F.concat(F.lit("a"), user))))
    named = named.when(turn == 1, F.concat_ws(", ", pair(F.lit("Zeta"), F.concat(F.lit("first "), user)), pair(F.lit("Alpha"), F.lit("second")), pair(kind, F.concat(F.lit(" "), text, F.lit(" ")))))
    named = named.otherwise(F.concat_ws(", ", pair(known, text), pair(F.lit("Zeta"), F.lit("")), pair(kind, F.concat(F.lit("u"), user))))
    again = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(", "), pair(F.when(turn == 0, kind).when(turn == 1, "Zeta").otherwise(known), F.lit("last")))).otherwise("")
    raw = F.concat(F.when(turn == 0, "So: ").otherwise(""), F.lit('{"title": "T", "section_blocks": {}, "sections": {'), named, again, F.lit("}}"))
    answers = spread_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props").select("event_id", raw.alias("raw"))
    return _told_sections(A.sections(answers, HEADINGS))


@query(
    """WITH claims AS (SELECT o_orderkey AS id, o_orderstatus AS route, o_orderpriority AS claim, CASE o_orderstatus WHEN 'F' THEN 'supported' ELSE 'contradicted' END AS verdict, 'customer:' || o_custkey AS evidence FROM orders),
    ids AS (SELECT route, '[' || string_agg(DISTINCT '"' || evidence || '"', ',' ORDER BY '"' || evidence || '"') || ']' AS ids FROM claims GROUP BY route),
    first AS (SELECT route, '[' || string_agg('{"claim_id":' || id || ',"claim_text":"' || claim || '","status":"' || verdict || '"}', ',' ORDER BY id) || ']' AS rows FROM (
      SELECT *, row_number() OVER (PARTITION BY route ORDER BY id) AS r FROM claims) WHERE r <= 12 GROUP BY route)
    SELECT route, '{"route":"' || route || '","allowed_evidence_ids":' || ids || ',"claims":' || rows || '}' AS pack FROM ids JOIN first USING (route)"""
)
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))
    verdict = F.when(F.col("o_orderstatus") == "F", "supported").otherwise("contradicted")
    claims = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("route"), F.col("o_orderpriority").alias("claim"), verdict.alias("verdict"), ids.alias("ids")
    )
    return A.pack(claims, "route", "claim_id")
