"""Small expressions: settings' values, labels, paths, notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroba.functions.text import strip

# What counts as true, how long an answer is at least, marks of pages that may be overwritten.
TRUE = ("1", "true", "yes", "on")
USABLE = 24
MANAGED = ("managed page", "placeholder page")
JSON_PHRASES = ("return json", "return only one valid json object", "json output discipline", "json schema]")


def as_bool(value: Column, default: bool = False) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(strip(value)).isin(*TRUE))


def as_number(value: Column, default: float) -> Column:
    return F.coalesce(F.try_to_number(strip(value), F.lit("S999999999999D999999")).cast("double"), value.try_cast("double"), F.lit(default))


def as_text(values: Column, unset: str = "(unset)") -> Column:
    """A list of values for display: joined by commas, the mark if there is none."""
    return F.when(values.isNull() | (F.size(values) == 0), F.lit(unset)).otherwise(F.array_join(values, ", "))


def split_many(value: Column, separator: str = ":") -> Column:
    """Values between separators or commas, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.replace(value, F.lit(separator), F.lit(",")), ","), strip), lambda x: x != "")


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def usable(text: Column) -> Column:
    """Whether an answer is long enough to be one."""
    return F.coalesce(F.length(strip(text)) >= USABLE, F.lit(False))


def managed(page: Column, marks: tuple[str, ...] = MANAGED) -> Column:
    """Whether a page may be overwritten: it is empty or has a mark."""
    out = page.isNull() | (strip(page) == "")
    for m in marks:
        out = out | F.contains(page, F.lit(m))
    return out


def json_stage(label: Column, prompt: Column, suffixes: tuple[str, ...], phrases: tuple[str, ...] = JSON_PHRASES) -> Column:
    """Whether a stage's answer must be JSON, by the end of its label or a phrase in its prompt."""
    out = F.lit(False)
    for s in suffixes:
        out = out | label.endswith(s)
    for p in phrases:
        out = out | F.contains(F.lower(prompt), F.lit(p))
    return out


def web_url(url: Column) -> Column:
    """Whether a URL is absolute, by http or https, with a host."""
    return F.coalesce(url.rlike("^[hH][tT][tT][pP][sS]?://[^/?#]+"), F.lit(False))


def privacy_mode(use_model: Column, model: Column, url: Column) -> Column:
    """Nothing leaves; or it may, to a valid endpoint; or the configuration is incomplete."""
    whole = (F.coalesce(model, F.lit("")) != "") & web_url(url)
    return F.when(~use_model, "local-only").when(whole, "llm-endpoint-enabled").otherwise("llm-config-invalid")


def label(language: Column, key: Column, known: dict[str, dict[str, str]], english: Column) -> Column:
    """A text's form in a language, the English one where there is none."""
    out = english
    for name, texts in known.items():
        found = F.create_map(*(F.lit(x) for pair in texts.items() for x in pair))[key]
        out = F.when((language == name) & found.isNotNull(), found).otherwise(out)
    return out


def looked_up(key: Column, known: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[key], F.lit(default))


def title_of_path(path: Column) -> Column:
    """The file's stem in words; a README has its directory's name."""
    name, above = F.substring_index(path, "/", -1), F.regexp_extract(path, "([^/]+)/[^/]*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    chosen = F.when((F.lower(name) == "readme.md") & (above != ""), above).otherwise(stem)
    words = F.initcap(F.lower(F.translate(chosen, "_-", "  ")))
    return F.when(F.trim(words) == "", "Documentation").otherwise(words)


def rationale(logic: Column, atoms: Column, scope: Column) -> Column:
    """Why a claim was taken up."""
    more = F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit("; instruction_scope="), scope)).otherwise("")
    return F.concat(F.lit("logic="), logic, F.lit("; atoms="), atoms.cast("string"), more)


def evidence_note(entities: Column, supporting: Column, contradicting: Column, trace: Column, uncertainty: Column) -> Column:
    """What a verdict rests on, in one line."""

    def listed(ids: Column) -> Column:
        return F.coalesce(F.nullif(F.array_join(ids, ","), F.lit("")), F.lit("none"))

    parts = (F.concat(F.lit("entities="), listed(entities)), F.concat(F.lit("evidence_ids="), listed(supporting)), F.concat(F.lit("contradictions="), listed(contradicting)), F.concat(F.lit("match_trace="), trace))
    return F.concat_ws("; ", *parts, F.when(F.coalesce(uncertainty, F.lit("")) != "", F.concat(F.lit("uncertainty="), uncertainty)))


def prompt_digest(prompt: Column) -> Column:
    return F.left(F.sha1(prompt.cast("binary")), F.lit(12))


def preview(text: Column, chars: int) -> Column:
    """The text's beginning in one line."""
    return F.replace(F.left(text, F.lit(chars)), F.lit("\n"), F.lit(" "))
