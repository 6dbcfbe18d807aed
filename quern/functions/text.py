"""Text functions, Column to Column, all built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import fixed_values as V


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and their bases."""
    source, target = [], []
    for code in range(0xC0, 0x3000):
        full = unicodedata.normalize("NFD", chr(code))
        base = [c for c in full if unicodedata.category(c) != "Mn"]
        if len(full) > 1 and len(base) == 1:
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


def strip_accents(text: Column, map_d: bool = True) -> Column:
    """Base letters only; ``map_d`` also turns the barred d, which has no decomposition, into d."""
    source, target = _accents()
    if map_d:
        source, target = source + "đĐ", target + "dD"
    # Plain ASCII, most of many corpora, has nothing to strip; the map is slow.
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", "")).otherwise(text)


def match_form(text: Column, map_d: bool = False) -> Column:
    return F.lower(strip_accents(text, map_d))


def newlines(text: Column) -> Column:
    """CRLF, CR and the rarer line ends as LF."""
    rare = "[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
    return F.when(text.rlike(rare), F.regexp_replace(text, "\r\n|" + rare, "\n")).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S++"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def index_tokens(text: Column, deaccent: bool = True, stopwords: bool = True) -> Column:
    """Tokens of the lexical index: ASCII words of at most 40 characters."""
    text = F.lower(strip_accents(text) if deaccent else text)
    found = F.regexp_extract_all(text, F.lit("[0-9a-zA-Z_]+"), F.lit(0))
    keep = lambda t: F.length(t) <= 40
    if stopwords:
        keep = lambda t: (F.length(t) <= 40) & ~t.isin(V.INDEX_STOPWORDS)
    return F.filter(found, keep)


def evidence_tokens(text: Column) -> Column:
    """Unicode words of two characters or more, without stop words."""
    found = F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(V.EVIDENCE_STOPWORDS))


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(match_form(text), F.lit("[a-z0-9_]+"), F.lit(0))


def word_tokens(text: Column, deaccent: bool = True) -> Column:
    low = F.lower(strip_accents(text) if deaccent else text)
    return F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))


def heading_of(text: Column) -> Column:
    return F.when(F.instr(text, "\n") > 0, F.trim(F.substring_index(text, "\n", 1))).otherwise(F.lit(""))


def body_of(text: Column) -> Column:
    at = F.instr(text, "\n")
    return F.when(at > 0, F.btrim(F.substring(text, at + 1, F.length(text)), F.lit(" \n\t"))).otherwise(text)


def name_from_link(link: Column) -> Column:
    """Last path segment, decoded, without .asp or .aspx; a plus stays a plus."""
    decoded = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)
    last = F.element_at(F.split(F.regexp_replace(decoded, "/+$", ""), "/"), -1)
    return F.coalesce(F.trim(F.regexp_replace(last, r"(?i)\.aspx?$", "")), F.lit(""))


def name_from_passage(passage: Column) -> Column:
    """First line of 12 to 220 characters that is more than digits and signs."""
    lines = F.transform(F.split(newlines(passage), "\n"), squeeze)
    fit = F.filter(lines, lambda x: F.length(x).between(12, 220) & ~x.rlike(r"(?U)^[\W\d_]+$"))
    return F.coalesce(F.get(fit, 0), F.lit(""))


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def weight_name(weight: float) -> str:
    """0.65 as 0p65, 1.00 as 1."""
    return f"{weight:.2f}".rstrip("0").rstrip(".").replace(".", "p")


def sha1(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def numeric_first(ident: str) -> list[Column]:
    """Sort keys: ids of digits by value, before all others by text."""
    col = F.col(ident).cast("string")
    digits = col.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1).asc(), F.when(digits, F.expr(f"try_cast({ident} as decimal(38,0))")).asc(), col.asc()]
