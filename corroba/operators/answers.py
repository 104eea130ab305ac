"""Structured answers of a model: notes, mappings and sections, recovered from what was written.

An answer is JSON, JSON inside prose or a fence, or no JSON at all. Values are read as VARIANT, in
expressions; what was repaired on the way is told by diagnostic codes.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroba.functions.text import bound, strip
from corroba.operators.recovery import json_object, json_text

# Which statuses a section's mapping may have, and the order of preference of a fallback.
_ANY = ("supported", "contradicted", "partially_supported", "unclear", "missing_evidence")
STATUSES: dict[str, tuple[str, ...]] = {
    "theory_alignment": _ANY,
    "reference_alignment": ("supported", "partially_supported", "missing_evidence", "contradicted"),
    "agent_instruction_alignment": ("supported", "partially_supported", "not_evidenced", "contradicted", "out_of_scope_or_non_verifiable"),
    "readme_claim_alignment": ("supported", "partially_supported", "not_evidenced", "contradicted", "not_statically_verifiable"),
}
FALLBACKS = ("missing_evidence", "not_evidenced", "unclear", "partially_supported")
# What stands where an answer says nothing.
NO_CLAIM, NO_ANCHOR = "No reliably grounded reference claim extracted", "No mapping anchor"
NO_ENTRIES = ("Mapping stage produced no valid entries.", "Alignment confidence is low due to absent mapping artifacts.")
NO_JSON = ("Mapping stage returned non-JSON output.", "Alignment confidence is low due to unstructured mapping output.")
UNSAID = {
    "reference_claim": "Unspecified claim",
    "code_anchor": "Unspecified code anchor",
    "evidence_note": "No evidence note provided.",
    "uncertainty_note": "No uncertainty note provided.",
}
NO_IDS = "No valid evidence IDs retained."
NO_CONTENT, NO_BODIES = "No structured section content was returned by the model.", "No valid structured section bodies were returned."
# Kinds of blocks.
BLOCKS = ("paragraph", "bullet", "labeled_bullet", "numbered_item")
ID = r"[a-z_]+:[a-z0-9_./-]+"


def statuses(section: str) -> tuple[str, ...]:
    return STATUSES.get(section, _ANY)


def fallback_status(section: str) -> str:
    return next(s for s in FALLBACKS if s in statuses(section))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text_at(v: Column, *paths: str) -> Column:
    """The first of the values at the paths that is not empty, as stripped text; else empty."""
    return F.coalesce(*(F.nullif(strip(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths), F.lit(""))


def _object(v: Column) -> Column:
    """The values of a VARIANT object by name; null if it is none. What it has not is then told by a look,
    whereas a path that leads nowhere is dear: Spark leaves the search by an exception."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text_in(m: Column, *names: str) -> Column:
    """text_at() of an _object()."""
    texts = (bound(strip(F.try_variant_get(m[n], "$", "string")), lambda t: F.nullif(t, F.lit(""))) for n in names)
    return F.coalesce(*texts, F.lit(""))


def list_at(v: Column, *paths: str) -> Column:
    """The first value that is there, as a list of non-empty texts; a text is a list of one."""
    out = F.array().cast("array<string>")
    for p in reversed(paths):
        many = F.filter(F.transform(F.try_variant_get(v, p, "array<string>"), strip), lambda x: x != "")
        one = F.nullif(strip(F.try_variant_get(v, p, "string")), F.lit(""))
        out = F.when(F.size(F.coalesce(many, F.array())) > 0, many).when(many.isNull() & one.isNotNull(), F.array(one)).otherwise(out)
    return out


def marked(raw: Column, mark: str) -> Column:
    """What follows the mark on the lines that begin with it."""
    lines = F.filter(F.transform(F.split(raw, "\r\n|\r|\n"), strip), lambda x: x.startswith(mark))
    return F.filter(F.transform(lines, lambda x: strip(F.substr(x, F.lit(len(mark) + 1)))), lambda x: x != "")


def notes(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """All columns of answers with notes, observations, uncertainties and codes."""
    rows = answers.withColumn("v", json_object(F.col(raw)))
    v, none = F.col("v"), F.col("v").isNull()
    observed = F.when(none, marked(F.col(raw), "- OBS:")).otherwise(list_at(v, "$.observations"))
    unsure = F.when(none, marked(F.col(raw), "- UNCERTAINTY:")).otherwise(list_at(v, "$.uncertainty_flags", "$.uncertainties"))
    told = rows.withColumn("observations", observed).withColumn("uncertainties", unsure)
    composed = F.array_join(
        F.concat(F.transform("observations", lambda x: F.concat(F.lit("- OBS: "), x)), F.transform("uncertainties", lambda x: F.concat(F.lit("- UNCERTAINTY: "), x))), "\n"
    )
    written = F.when(none, strip(F.col(raw))).otherwise(F.coalesce(F.nullif(text_at(v, "$.notes_markdown", "$.notes"), F.lit("")), composed))
    codes = F.when(none, F.array(F.lit("notes.non_json_recovered_from_bullets"))).otherwise(F.array().cast("array<string>"))
    return told.withColumn("notes", written).withColumn("codes", codes).drop("v")


def mapping(answers: DataFrame, section: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(entries, diagnostics) of answers. Entries: the answers' other columns with entry_index,
    reference_claim, code_anchor, status, evidence_note, uncertainty_note; at least one an
    answer. Diagnostics: the other columns with code and operation."""
    keys = [c for c in answers.columns if c != raw]
    fallback, allowed = fallback_status(section), statuses(section)

    def entry(claim: str, anchor: str, note: str, unsure: str) -> Column:
        values = (("reference_claim", claim), ("code_anchor", anchor), ("status", fallback), ("evidence_note", note), ("uncertainty_note", unsure))
        return F.struct(*(F.lit(x).alias(n) for n, x in values))

    def read(x: Column) -> Column:
        def value(name: str) -> Column:
            return F.coalesce(F.nullif(text_at(x, f"$.{name}"), F.lit("")), F.lit(UNSAID[name])).alias(name)

        status = F.coalesce(F.nullif(F.lower(text_at(x, "$.status")), F.lit("")), F.lit(fallback))
        return F.struct(
            value("reference_claim"), value("code_anchor"), F.when(status.isin(*allowed), status).otherwise(fallback).alias("status"), value("evidence_note"), value("uncertainty_note")
        )

    rows = answers.withColumn("v", json_object(F.col(raw)))
    given = F.coalesce(F.try_variant_get("v", "$.entries", "array<variant>"), F.array().cast("array<variant>"))
    rows = rows.withColumn("given", F.when(F.startswith(_kind(F.variant_get("v", "$.entries", "variant")), F.lit("ARRAY<")), given).otherwise(F.array().cast("array<variant>")))
    is_object = lambda x: F.coalesce(F.startswith(_kind(x), F.lit("OBJECT<")), F.lit(False))
    good = F.transform(F.filter("given", is_object), read)
    nothing, no_json = (entry(NO_CLAIM, NO_ANCHOR, *why) for why in (NO_ENTRIES, NO_JSON))
    rows = rows.withColumn("entries", bound(good, lambda q: F.when(F.col("v").isNull(), F.array(no_json)).when(F.size(q) > 0, q).otherwise(F.array(nothing))))

    def note(code: str, place: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.concat(F.lit("entry:"), place.cast("string")).alias("operation"))

    def problem(x: Column, i: Column) -> Column:
        status = F.coalesce(F.nullif(F.lower(text_at(x, "$.status")), F.lit("")), F.lit(fallback))
        return F.when(~is_object(x), note("mapping.non_object_entry_dropped", i)).when(~status.isin(*allowed), note("mapping.unsupported_status_normalized", i))

    whole = F.when(F.col("v").isNull(), F.array(note("mapping.non_json_fallback_entry_injected", F.lit(0))))
    whole = whole.when(~F.exists("given", is_object), F.array(note("mapping.no_valid_entries_fallback_injected", F.lit(0)))).otherwise(F.array().cast("array<struct<code:string,operation:string>>"))
    told = F.concat(F.array_compact(F.transform("given", problem)), whole)
    entries = rows.select(*keys, F.posexplode_outer("entries").alias("entry_index", "e")).select(*keys, "entry_index", "e.*")
    return entries, rows.select(*keys, F.inline(told))


def sanitise(entries: DataFrame, section: str, allowed: str) -> DataFrame:
    """entries with the evidence ids that `allowed` (an array column) doesn't have taken out of
    their notes. An entry without any valid id gets the fallback status, a contradicted one too.
    Adds unknown (sorted) and downgraded."""
    named = F.array_distinct(F.regexp_extract_all(F.lower("evidence_note"), F.lit(ID), F.lit(0)))
    rows = entries.withColumn("unknown", F.array_sort(F.array_except(named, F.col(allowed)))).withColumn("kept", F.array_intersect(named, F.col(allowed)))
    cut = F.aggregate("unknown", F.col("evidence_note"), lambda text, x: F.replace(text, x, F.lit("")))
    clean = F.coalesce(F.nullif(F.btrim(F.regexp_replace(cut, r"[ \t\r\n\x0b\x0c]+", " ")), F.lit("")), F.lit(NO_IDS))
    fallback = F.lit(fallback_status(section))
    lost = (F.size("kept") == 0) & (F.col("status") != fallback)
    rows = rows.withColumn("downgraded", lost).withColumn("evidence_note", F.when(F.size("unknown") > 0, clean).otherwise(F.col("evidence_note")))
    return rows.withColumn("status", F.when(F.size("kept") == 0, fallback).otherwise(F.col("status"))).drop("kept")


def preserve_contradictions(entries: DataFrame, hints: str) -> DataFrame:
    """entries whose claim holds one of the hints (an array column of lower-case texts) are
    contradicted, whatever they say. Adds preserved. Comes after sanitise."""
    held = F.exists(hints, lambda h: (h != "") & F.contains(F.lower("reference_claim"), h))
    changed = F.coalesce(held, F.lit(False)) & (F.col("status") != "contradicted")
    return entries.withColumn("preserved", changed).withColumn("status", F.when(changed, "contradicted").otherwise(F.col("status")))


def allowed_ids(packs: DataFrame, key: str, marker: str = "deterministic_alignment_pack") -> DataFrame:
    """key, ids (sorted): the evidence ids of packs (key, source_path, excerpt); other rows and
    those that are no JSON object count for nothing."""
    v = F.try_parse_json("excerpt")
    ids = F.transform(F.try_variant_get(v, "$.allowed_evidence_ids", "array<string>"), lambda x: F.lower(strip(x)))
    named = packs.filter(F.col("source_path") == marker).select(key, F.explode(ids).alias("id")).filter("id <> ''")
    return named.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def pack(claims: DataFrame, route: str, order: str, most: int = 12) -> DataFrame:
    """route, pack: JSON of a route's name, the ids of all its claims (column ids) and its first `most`
    claims (claim_id, claim, verdict) in order."""
    row = F.struct(F.col(order).alias("o"), "claim_id", "claim", "verdict")
    found = claims.select(route, F.explode("ids").alias("id")).groupBy(route).agg(F.array_sort(F.collect_set("id")).alias("allowed_evidence_ids"))
    place = F.row_number().over(Window.partitionBy(route).orderBy(order))
    first = claims.withColumn("r", place).filter(F.col("r") <= most).groupBy(route).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["claim_id"], x["claim"], x["verdict"])).alias("claims"))
    joined = first.join(found, route, "left").withColumn("allowed_evidence_ids", F.coalesce("allowed_evidence_ids", F.array().cast("array<string>")))
    return joined.select(route, F.to_json(F.struct(F.col(route).alias("route"), F.col("allowed_evidence_ids"), F.transform("claims", lambda c: F.struct(c["claim_id"].alias("claim_id"), c["claim"].alias("claim_text"), c["verdict"].alias("status"))).alias("claims"))).alias("pack"))


_BLOCK = "struct<kind:string,text:string,label:string>"


def blocks_of(value: Column) -> Column:
    """A section's blocks: a text is a paragraph; of a list, texts are paragraphs, objects are
    blocks if they have text, and the rest is dropped. Unknown kinds are paragraphs; a labelled
    bullet without a label is a Note. Each block carries the codes of what was mended."""
    none = F.array().cast("array<struct<kind:string,text:string,label:string,codes:array<string>>>")

    def block(kind: Column, text: Column, label: Column, codes: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), label.alias("label"), codes.alias("codes"))

    def plain(x: Column) -> Column:
        text = strip(F.try_variant_get(x, "$", "string"))
        return F.when(_kind(x) == "STRING", bound(text, lambda t: F.when(t != "", block(F.lit("paragraph"), t, F.lit(""), F.array().cast("array<string>")))))

    def mended(p: Column) -> Column:
        known = p["kind"].isin(*BLOCKS)
        unnamed = (p["kind"] == "labeled_bullet") & (p["label"] == "")
        codes = F.array_compact(F.array(F.when(~known, "final_output.unsupported_block_kind_normalized"), F.when(unnamed, "final_output.labeled_bullet_missing_label_normalized")))
        return F.when(p["text"] != "", block(F.when(known, p["kind"]).otherwise("paragraph"), p["text"], F.when(unnamed, "Note").otherwise(p["label"]), codes))

    def said(m: Column) -> Column:
        return F.struct(F.lower(_text_in(m, "kind")).alias("kind"), _text_in(m, "text", "body", "content").alias("text"), _text_in(m, "label").alias("label"))

    def read(x: Column) -> Column:
        return bound(_object(x), lambda m: F.when(m.isNotNull(), bound(said(m), mended)).otherwise(plain(x)))

    # in a lambda nothing is computed once by itself: what is used twice is bound
    return bound(value, lambda v: F.coalesce(F.array_compact(F.transform(_list(v), read)), F.array_compact(F.array(plain(v))), none))


def _is(field: str, value: str):
    return lambda x: x[field] == value


@contextlib.contextmanager
def repeated_names(spark: SparkSession) -> Iterator[None]:
    """What is built inside parses objects that repeat a name; else they would be no JSON."""
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sections(answers: DataFrame, headings: tuple[str, ...], raw: str = "raw") -> DataFrame:
    """The answers' other columns with place, heading, blocks, recovered and codes, for each required
    heading that got content. Headings are found in any case; content under unknown names fills
    missing headings in order. An answer without JSON is kept as a paragraph under the first
    heading, and one without content gets a notice there. Names of an object go in the order in which
    the answer has them; of a name that it repeats the last value holds, at the first's place."""
    keys = [c for c in answers.columns if c != raw]
    with repeated_names(answers.sparkSession):
        rows = answers.withColumn("json", json_text(F.col(raw))).withColumn("v", F.try_parse_json("json"))
    canonical = F.create_map(*(F.lit(x) for h in headings for x in (h.lower(), h)))
    held_in = ("section_blocks", "section_bodies", "sections")
    rows = rows.withColumn("top", _object(F.col("v")))
    says = lambda n: ~F.coalesce(F.to_json(F.col("top")[n]), F.lit("null")).isin("{}", "[]", '""', "null", "false", "0")
    rows = rows.withColumn("held_in", F.coalesce(*(F.when(says(n), F.lit(n)) for n in held_in)))
    rows = rows.withColumn("body", F.col("top")[F.col("held_in")]).withColumn("of_name", _object(F.col("body")))
    body_text = F.coalesce(*(F.when(F.col("held_in") == n, F.get_json_object("json", f"$.{n}")) for n in held_in))
    names = F.array_distinct(F.json_object_keys(body_text))
    by_name = F.transform(names, lambda k: F.struct(strip(k).alias("name"), blocks_of(F.col("of_name")[k]).alias("blocks")))

    def row(m: Column) -> Column:
        held = F.coalesce(*(m[n] for n in ("blocks", "section_blocks", "body", "content")))
        return F.when(m.isNotNull(), F.struct(_text_in(m, "heading", "name").alias("name"), blocks_of(held).alias("blocks")))

    in_rows = F.array_compact(F.transform(_list(F.col("body")), lambda x: bound(_object(x), row)))
    items = F.when(F.col("of_name").isNotNull(), by_name).otherwise(F.coalesce(in_rows, F.array().cast("array<struct<name:string,blocks:array<struct<kind:string,text:string,label:string,codes:array<string>>>>>")))
    rows = rows.withColumn("items", F.filter(items, lambda x: F.size(x["blocks"]) > 0))
    rows = rows.withColumn("items", F.transform("items", lambda x: F.struct(canonical[F.lower(x["name"])].alias("heading"), x["blocks"].alias("blocks"))))
    known = [F.try_element_at(F.filter("items", _is("heading", h)), F.lit(-1))["blocks"] for h in headings]
    rows = rows.withColumn("known", F.array(*known)).withColumn("unknown", F.transform(F.filter("items", lambda x: x["heading"].isNull()), lambda x: x["blocks"]))

    def notice(text: Column | str) -> Column:
        text = F.lit(text) if isinstance(text, str) else text
        return F.array(F.struct(F.lit("paragraph").alias("kind"), text.alias("text"), F.lit("").alias("label"), F.array().cast("array<string>").alias("codes")))

    out = None
    empty = F.array().cast("array<string>")
    for place, heading in enumerate(headings):
        own = F.col("known")[place]
        before = F.size(F.filter(F.slice("known", 1, place), lambda x: x.isNull())) if place else F.lit(0)
        taken = F.when(own.isNull(), F.try_element_at("unknown", before + 1))
        none = F.col("v").isNull()
        lost = ~none & (F.size(F.col("items")) == 0)
        if place == 0:
            blocks = F.when(none, notice(F.coalesce(F.nullif(strip(F.col(raw)), F.lit("")), F.lit(NO_CONTENT)))).when(
                lost, notice(NO_BODIES)
            ).otherwise(F.coalesce(own, taken))
            codes = F.when(none, F.array(F.lit("final_output.non_json_preserved_raw_text"))).when(lost, F.array(F.lit("final_output.no_valid_section_bodies_fallback_inserted")))
            codes = codes.when(taken.isNotNull(), F.array(F.lit("final_output.unknown_section_recovered_into_missing_slot"))).otherwise(empty)
        else:
            blocks = F.when(~none, F.coalesce(own, taken))
            codes = F.when(taken.isNotNull(), F.array(F.lit("final_output.unknown_section_recovered_into_missing_slot"))).otherwise(empty)
        part = F.struct(F.lit(place).alias("place"), F.lit(heading).alias("heading"), blocks.alias("blocks"), codes.alias("codes"))
        out = [part] if out is None else [*out, part]
    told = rows.select(*keys, F.inline_outer(F.array(*out))).filter("blocks IS NOT NULL")
    return told.withColumn("codes", F.concat("codes", F.flatten(F.transform("blocks", lambda b: b["codes"]))))
