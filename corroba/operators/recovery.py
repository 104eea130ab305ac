"""Recovering structured values from loosely written answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(raw: Column) -> Column:
    """The first text of a JSON object among: the whole text, fenced blocks, and what lies from the
    first opening to the last closing brace. Null if none parses; each is only tried if those before fail."""

    def parsing(c: Column) -> Column:  # what begins with a brace is an object, if it parses
        return F.when(F.btrim(c).startswith("{"), F.when(F.try_parse_json(c).isNotNull(), c))

    fenced = F.regexp_extract_all(raw, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    in_fence = F.when(F.contains(raw, F.lit("```")), F.try_element_at(F.filter(F.transform(fenced, parsing), lambda x: x.isNotNull()), F.lit(1)))
    in_braces = F.when(F.contains(raw, F.lit("{")), parsing(F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))))
    return F.coalesce(parsing(raw), in_fence, in_braces)


def json_object(raw: Column) -> Column:
    """The object of json_text() as VARIANT."""
    return F.try_parse_json(json_text(raw))


def split_ids(note: Column, known: Column) -> tuple[Column, Column]:
    """Evidence ids named in a note: those known, those not; sorted."""
    named = F.array_distinct(F.regexp_extract_all(F.lower(note), F.lit(r"[a-z_]+:[a-z0-9_./-]+"), F.lit(0)))
    return F.array_sort(F.array_intersect(named, known)), F.array_sort(F.array_except(named, known))


def string_list(value: Column) -> Column:
    """A VARIANT as a list of clean strings: null is empty, a scalar is a list of one."""
    many = F.try_variant_get(value, "$", "array<string>")
    one = F.try_variant_get(value, "$", "string")
    return F.filter(F.transform(F.coalesce(many, F.array_compact(F.array(one))), lambda x: F.btrim(x)), lambda x: x != "")


def bullets(raw: Column) -> Column:
    """Lines that begin with a list mark, without it."""
    marked = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.btrim(x)), lambda x: x.rlike(r"^[-*]\s+"))
    return F.transform(marked, lambda x: F.btrim(F.regexp_replace(x, r"^[-*]\s+", "")))
