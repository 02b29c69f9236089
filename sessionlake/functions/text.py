"""String expressions: search terms, excerpts, URL components, timestamps."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"([\p{L}\p{N}]+)"


@cache
def _latin_marks() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0].lower()) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def fold(text: Column) -> Column:
    """Small letters, Latin ones without diacritics."""
    return F.translate(F.lower(text), *_latin_marks())


def fold_text(text: str) -> str:
    """``fold`` of a Python string."""
    return text.lower().translate(str.maketrans(*_latin_marks()))


def terms(text: Column) -> Column:
    """The search terms of a text, in order, with repeats."""
    return F.regexp_extract_all(fold(text), F.lit(TERM), F.lit(1))


def query_terms(text: str) -> list[str]:
    """The terms of a query: each run of letters and digits, folded."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", fold_text(text))


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that ends between code points."""

    @F.pandas_udf("string")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else t.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore"))

    return F.when(F.octet_length(text) <= most, text).otherwise(cut(F.when(F.octet_length(text) > most, text)))


def compact(text: Column) -> Column:
    """Control characters as spaces, runs of white space as one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), r"\s+", " "))


def encode_uri_component(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def parsed_timestamp(text: Column) -> Column:
    """An ISO-8601 text as a timestamp; null for null, empty and unreadable ones."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?\s*$"), text))


def snippet(text: Column, term: str, before: int = 40, after: int = 80) -> Column:
    """The text around the first place of ``term``, with ellipses where it was cut; the beginning where the term is absent."""
    at = F.instr(fold(text), F.lit(fold_text(term)).cast("string"))
    start = F.greatest(at - F.lit(before), F.lit(1))
    stop = F.least(at + F.lit(len(term) + after), F.length(text) + 1)
    middle = F.substring(text, start, stop - start)
    found = F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), middle, F.when(stop <= F.length(text), F.lit("…")).otherwise(F.lit("")))
    head = F.when(F.length(text) > before + after, F.concat(F.substring(text, 1, before + after), F.lit("…"))).otherwise(text)
    return F.when(at > 0, found).otherwise(head)


def highlight_ranges(text: Column, query: str) -> Column:
    """``array<struct<start,end>>``: the places of a query's terms in code points, overlapping ones merged."""
    wanted = sorted({t for t in query_terms(query)}, key=len, reverse=True)
    pattern = re.compile("|".join(map(re.escape, wanted))) if wanted else None

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ranges(values: pd.Series) -> pd.Series:
        def one(t: str | None):
            out: list[dict] = []
            for m in pattern.finditer(fold_text(t)) if t and pattern else ():
                if out and m.start() <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], m.end())
                else:
                    out.append({"start": m.start(), "end": m.end()})
            return out

        return values.map(one)

    return ranges(text)


def parse_search(raw: str) -> dict[str, object]:
    """A search line with ``project: provider: role: @project #role`` scopes and free terms."""
    scopes: dict[str, object] = {}
    rest: list[str] = []
    for word in raw.split():
        key, colon, value = word.partition(":")
        if colon and key in ("project", "provider", "role") and value:
            scopes[key] = value
        elif word[0] in "@#" and len(word) > 1:
            scopes["project" if word[0] == "@" else "role"] = word[1:]
        else:
            rest.append(word)
    return {**scopes, "text": " ".join(rest)}
