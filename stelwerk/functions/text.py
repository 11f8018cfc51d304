"""Text and value functions on columns."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters a snippet shows on each side of a match.
SNIPPET = 40


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (trim takes plain spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The stripped text, null if nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[filled(c) for c in cs])


def first_truthy(*cs: Column) -> Column:
    """The first value that is neither null nor the empty string, as it is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def strip_html(c: Column) -> Column:
    """Tags become a space, runs of white space one space; the text of scripts and entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def snippet(text: Column, start: Column, end: Column, window: int = SNIPPET) -> Column:
    """The text around the half-open span of 0-based offsets, stripped."""
    lo = F.greatest(start - window, F.lit(0))
    return strip(F.substring(text, lo + 1, F.least(F.length(text), end + window) - lo))


def celex(letter: Column | str, year: Column, number: Column) -> Column:
    """``3{year}{letter}{number}``, the number at least four digits wide; a number that is none counts as 0."""
    at = F.lit(letter) if isinstance(letter, str) else letter
    return F.format_string("3%s%s%04d", year, at, F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint")))


def leading_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)", 1), F.lit("")).try_cast("bigint")


def iso_utc(c: Column) -> Column:
    """A timestamp (session zone UTC) as ISO 8601 with Z and whole seconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def since_text(c: Column) -> Column:
    return F.coalesce(iso_utc(c), F.lit("full history"))


def date_or_min(c: Column) -> Column:
    """An ISO date, 0001-01-01 for anything else."""
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date")), F.lit("0001-01-01").cast("date"))


def as_int(c: Column) -> Column:
    """An integer of a text, truncated toward zero; null if it is none."""
    return filled(c).try_cast("double").cast("bigint")


def keywords(words: Iterable[str | None]) -> list[str]:
    """Lower-case, stripped, without blanks."""
    return [w.strip().lower() for w in words if w and w.strip()]


def has_keyword(c: Column, words: Iterable[str | None]) -> Column:
    """Whether the text holds any of the words, whatever the case; false for null. One pass of substring tests in the JVM,
    no join: the words are a profile's handful."""
    words = keywords(words)
    if not words:
        return F.lit(False)

    def any_in(lower: Column) -> Column:
        hit = F.contains(lower, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(lower, F.lit(w))
        return hit

    return F.coalesce(F.exists(F.array(F.lower(c)), any_in), F.lit(False))  # lower-case is made once


def has_prefix(c: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(c, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def in_list(c: Column, values: Iterable[str], separator: str = ",") -> Column:
    """Whether any entry of a comma-separated text equals any of the values, case and blanks aside."""
    own = F.transform(F.split(c, separator), lambda x: F.lower(F.trim(x)))
    want = F.array(*[F.lit(v.strip().lower()) for v in values]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(own, want), F.lit(False))


def _collect(text: str) -> str | None:
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return None
    found = []
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            if v.strip():
                found.append(v.strip())
        elif isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))
    return "\n".join(found) or None


@F.pandas_udf(T.StringType())
def _json_strings(texts: pd.Series) -> pd.Series:
    return texts.map(_collect, na_action="ignore")


def json_strings(c: Column) -> Column:
    """All strings in a JSON text, in document order, stripped, joined by line feeds; null for null, malformed or none. The
    depth is unknown, so this runs in Python, by Arrow batches."""
    return _json_strings(c)


def display_name(kind: Column, props: dict[str, Column]) -> Column:
    """The name to show for a node of each type, from the props there are (missing ones count as null)."""
    get = lambda *names: first_filled(*[props[n] for n in names if n in props], F.lit(None).cast("string"))
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" ("), b, F.lit(")")))
    labelled = lambda word, x: F.concat(F.lit(word), x)
    title = get("title", "official_title")
    ecli, number = get("ecli"), get("zaaknummer", "case_number")
    by_type = {
        "instrument": F.coalesce(both(title, get("bwb_id", "celex")), title, labelled("BWB ", get("bwb_id")), labelled("EU ", get("celex")), F.lit("Instrument")),
        "article": F.coalesce(labelled("Art. ", get("article_number")), F.lit("Artikel")),
        "judgment": F.coalesce(both(get("title", "case_title", "zaaknaam"), ecli), ecli, labelled("Uitspraak ", number), F.lit("Uitspraak")),
        "publication": F.coalesce(both(get("title"), get("kamerstuknummer", "document_number")), get("title"), F.lit("Publicatie")),
        "procedure": F.coalesce(get("title"), labelled("Procedure ", get("procedure_id", "external_id")), F.lit("Procedure")),
        "topic": F.coalesce(get("label", "name"), get("slug"), get("code"), F.lit("Topic")),
    }
    name = F.coalesce(get("name", "label", "title"), F.initcap(kind))
    for t, c in by_type.items():
        name = F.when(kind == t, c).otherwise(name)
    return name
