"""Text expressions shared by the operators. All are built from Catalyst functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\r\n\x0b\x0c"

# The tokens and words that decide polarity and modality.
NEGATIONS = ("not", "no", "does not", "do not", "without", "never", "cannot")
MODALITIES = (
    ("must", ("must", "required", "shall")),
    ("should", ("should", "recommended")),
    ("forbidden", ("forbidden", "must not", "do not")),
)


# Characters whose case folding has letters of a-z.
FOLDED = (
    ("ß", "ss"), ("ẞ", "ss"), ("ſ", "s"), ("\u212a", "k"), ("İ", "i "), ("ŉ", " n"), ("ǰ", "j "),
    ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
)
_OTHERS = "".join(c for c in map(chr, range(1, 128)) if not re.match("[-a-z0-9_./: ]", c))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column | str) -> Column:
    return F.btrim(c, F.lit(SPACES))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def lines(c: Column | str) -> Column:
    """The text's lines, cut at line feeds."""
    return F.split(c, "\n")


def parts(c: Column | str, separator: str) -> Column:
    """Stripped, non-empty pieces between separators (a regular expression)."""
    return F.filter(F.transform(F.split(c, separator), strip), lambda x: x != "")


def clean(c: Column | str) -> Column:
    """Without pairs of backticks, white space as one space, without dashes, colons and semicolons around."""
    plain = F.regexp_replace(F.regexp_replace(c, "`([^`]+)`", "$1"), r"[ \t\r\n\x0b\x0c]+", " ")
    return F.btrim(plain, F.lit(" -:;"))


def norm(c: Column | str) -> Column:
    """Case folded; other characters than a-z, 0-9, _ - . / : and white space become spaces."""
    c = F.col(c) if isinstance(c, str) else c
    folded = c
    for character, letters in FOLDED:
        folded = F.replace(folded, F.lit(character), F.lit(letters))
    folded = F.when(c.rlike("[" + "".join(x for x, _ in FOLDED) + "]"), folded).otherwise(c)
    # beside those folded, only A-Z have letters of a-z in lower case; one pass for the other ASCII characters,
    # one for all beyond, which is much faster than one class of what stays
    plain = F.regexp_replace(F.translate(F.lower(folded), _OTHERS, " " * len(_OTHERS)), r"[^\x01-\x7F]", " ")
    return F.btrim(F.regexp_replace(plain, " +", " "))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def polarity(normal: Column) -> Column:
    """negative if a negation stands as a word (or words) of its own."""
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    return F.when(contains_any(padded, tuple(f" {w} " for w in NEGATIONS)), "negative").otherwise("positive")


def modality(normal: Column) -> Column:
    """The first kind one of whose words occurs; so `must not` is a must."""
    out = F.lit("descriptive")
    for name, words in reversed(MODALITIES):
        out = F.when(contains_any(normal, words), name).otherwise(out)
    return out


def split_claim(c: Column) -> Column:
    """Clauses of a claim: cut at but, then at and, then at commas; trimmed, empty ones dropped;
    the claim itself if nothing is left. The cuts follow each other, so that a comma before
    `and` leaves no `and` behind."""
    clauses = F.array(c)
    for separator in (r"\s+but\s+", r"\s+and\s+", ","):
        clauses = F.flatten(F.transform(clauses, _cut_at(separator)))
    return bound(clauses, lambda q: F.when(F.size(q) > 0, q).otherwise(F.array(c)))


def _cut_at(separator: str):
    return lambda p: F.filter(F.transform(F.split(p, separator), lambda x: F.btrim(x, F.lit(" .;"))), lambda x: x != "")


def claim_logic(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit(" or ")), "or").when(contains_any(low, (" and ", " but ", ",")), "and").otherwise("single")
