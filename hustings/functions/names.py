"""Normalisers of names, constituencies and parties (pure column functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hustings.functions.base import col, squeeze

#: Long party names and their short codes (fixed values).
PARTY_SHORT = {
    "Telugu Desam": "TDP",
    "Yuvajana Sramika Rythu Congress Party": "YSRCP",
    "Janasena Party": "Janasena Party",
    "Bharatiya Janata Party": "BJP",
    "Indian National Congress": "INC",
    "Bahujan Samaj Party": "BSP",
    "Communist Party of India": "CPI",
    "Communist Party of India  (Marxist)": "CPI(M)",
    "Independent": "IND",
}
#: What a party is called in running text (fixed values).
PARTY_ALIASES = {
    "TDP": ["tdp", "telugu desam"],
    "YSRCP": ["ysrcp", "ysr congress", "ysr cong"],
    "JSP": ["jsp", "jana sena", "janasena"],
    "Janasena Party": ["jsp", "jana sena", "janasena"],
    "BJP": ["bjp", "bharatiya janata"],
    "INC": ["inc", " congress"],
}
#: Words in front of a name (fixed values).
HONORIFICS = "Dr|Sri|Smt|Shri|Mr|Mrs|Ms|Adv|Hon|Late"
#: One list in two parts: word sets of names leave out the first part only.
TITLES = "sri|smt|dr|mr|mrs|shri|kumari|alias|advocate|er|engr"
DEGREES = "m.a|b.a|b.ed|p.hd|notary|adv"


def normalize_name(c) -> Column:
    """No parenthesised part, no @-alias, no honorifics, dots as blanks, lower case."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s*\([^)]*\)\s*", " ")
    c = F.regexp_replace(c, r"\s*@\s*.*$", "")
    c = F.regexp_replace(c, rf"(?i)\b(?:{HONORIFICS})\.?\s+", "")
    return F.lower(squeeze(F.replace(c, F.lit("."), F.lit(" "))))


def normalize_constituency(c) -> Column:
    """All parenthesised parts out, upper case."""
    return F.upper(squeeze(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s*\([^)]*\)\s*", " ")))


def stem(c) -> Column:
    """Upper case, one parenthesised suffix dropped."""
    return F.trim(F.regexp_replace(squeeze(F.upper(col(c))), r"\s*\([^)]*\)\s*$", ""))


def alnum_key(c) -> Column:
    """Only A-Z and digits of the upper-cased text."""
    return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]+", "")


def safe_name(c) -> Column:
    """Each character that is no letter or digit becomes an underscore; lower case."""
    return F.lower(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "_"))


def clean_key(c) -> Column:
    """ASCII key with inner underscores only."""
    return F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "_"), F.lit("_"))


def clean_person_name(c) -> Column:
    """Parenthesised parts, titles and degrees dropped, letters only, lower case."""
    c = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\(.*?\)", "")
    c = F.regexp_replace(c, rf"(?i)\b(?:{TITLES}|{DEGREES})\b", "")
    return squeeze(F.lower(F.regexp_replace(c, r"[^a-zA-Z\s]", "")))


def name_tokens(c) -> Column:
    """The set of words of a name, without titles, as a sorted array."""
    c = F.lower(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\(.*?\)", ""))
    c = F.regexp_replace(F.regexp_replace(c, rf"\b(?:{TITLES})\b", ""), r"[^a-zA-Z0-9\s]", " ")
    return F.array_sort(F.array_distinct(F.array_remove(F.split(squeeze(c), " "), "")))


def clean_search_name(c) -> Column:
    """Parentage, alias and parenthesised parts dropped.

    The class before "/O" also holds a bar: names written so are cut as well.
    """
    c = F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?i)\s+[S|D|W]/O\s+.*$", "")
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", ""), "@.*$", ""))


def title_case(c) -> Column:
    """All-capital words in title case; mixed case and short dotted initials stay."""

    def word(w: Column) -> Column:
        plain = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        return F.when(w.rlike(r"\p{Ll}"), w).when(F.contains(w, F.lit(".")) & (F.length(w) <= 4), F.upper(w)).otherwise(plain)

    # Words and the white space between them alternate.
    parts = F.split(F.trim(col(c)), r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")
    return F.array_join(F.transform(parts, word), "")


def _lookup(c: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def party_short(c) -> Column:
    """The short code of a party; unknown names stay."""
    return F.coalesce(_lookup(col(c), PARTY_SHORT), col(c))


def party_aliases(c) -> Column:
    """What a party may be called in lower-case text; empty for others."""
    table = F.create_map(*(x for k, v in PARTY_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, col(c)), F.array().cast("array<string>"))


def search_terms(name, constituency, template: str = '"{constituency}" Andhra') -> Column:
    """Distinct search terms of a candidate, in order, as an array."""
    clean = clean_search_name(name)
    words = F.split(clean, " ")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    long_name = F.size(words) >= 3
    seat = F.trim(F.coalesce(col(constituency), F.lit("")))
    head, _, tail = template.partition("{constituency}")
    terms = F.array(
        F.when(F.trim(F.coalesce(col(name), F.lit(""))) != "", quoted(clean)),
        F.when(long_name, quoted(F.array_join(F.slice(words, -2, 2), " "))),
        F.when(long_name, quoted(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "))),
        F.when((seat != "") & F.lit(bool(template)), F.concat(F.lit(head), seat, F.lit(tail)) if "{constituency}" in template else F.lit(template)),
    )
    return F.array_distinct(F.array_compact(terms))
