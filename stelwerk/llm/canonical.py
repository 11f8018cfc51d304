"""One form for text that looks the same.

Normalisation is done by segments. A table of character properties, made once a process from ``unicodedata``, says which
characters are unstable: those whose quick check for composed form isn't *yes*, combining marks, invisible ones, spaces
other than the plain one, and those with an entry in the look-alike fold. A segment is a run of unstable characters with
the stable character before it, its boundary context: nothing outside can combine with what is inside. Only segments are
normalised, each different one once a process, and spliced into the otherwise unchanged text. ASCII text is never sent
to Python at all.

Rows that look alike but are spelled differently come out as classes (a representative and its members) or as pairs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stelwerk.session import written

# Letters and signs drawn alike, other script or sign to Latin or ASCII.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian, Latin extensions
    "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ɡ": "g", "ı": "i", "ɑ": "a",
    # Cherokee, Lisu, Coptic, Latin small capitals
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "Ⲥ": "C", "ⲥ": "c", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲏ": "H", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ᴜ": "u",
    # signs
    "∶": ":", "꞉": ":", "ː": ":", "׃": ":", "։": ":", "․": ".", "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "⁄": "/", "∕": "/", "ʼ": "’", "ʹ": "′", "‚": ",", "٫": ",", ";": ";",
}

#: Compatibility forms that differ in width, spacing or joining only. Superscripts, circled and styled letters show.
_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
#: Compatibility forms that do look different from what they decompose to.
_SHOWN = "ſϐϑϒϕϖϰϱϵ"


def _fold(ch: str) -> str | None:
    """What the character becomes before composition, or None if it stays."""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" or "︀" <= ch <= "️":
        return ""
    if kind == "Zs":
        return " " if ch != " " else None
    if ch == "\r" or ch in "  \x85":
        return "\n"
    if ch == "\t":
        return " "
    form = unicodedata.decomposition(ch)
    if form.startswith(_KINDS) and ch not in _SHOWN:
        to = "".join(chr(int(x, 16)) for x in form.split()[1:])
        if to[0] != " ":  # a spacing accent is a sign of its own
            return "".join(_fold(c) or c for c in to) if to != ch else None
    return None


def _alone(s: str) -> str:
    s = unicodedata.normalize("NFD", s)
    return unicodedata.normalize("NFC", "".join(c if (to := _fold(c)) is None else to for c in s))


_segment = lru_cache(maxsize=1 << 16)(_alone)


@lru_cache(maxsize=1)
def _unstable() -> re.Pattern:
    """A pattern for runs of unstable characters."""
    seconds = set()  # characters that may combine with one before them: quick check *maybe*
    # Unified ideographs, Hangul syllables and private use are stable throughout.
    chars = [chr(c) for a, b in ((0x9, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x17000), (0x1AFF0, 0x20000), (0x2F800, 0x2FA20)) for c in range(a, b)]
    for ch in chars:
        form = unicodedata.decomposition(ch)
        if form and form[0] != "<" and " " in form:
            seconds.add(chr(int(form.split()[1], 16)))
    seconds.update(chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])
    codes = [ord(ch) for ch in chars if ch in seconds or unicodedata.combining(ch) or _alone(ch) != ch]
    codes += range(0xE0000, 0xE1000)
    spans: list[list[int]] = []
    for c in codes:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]+")


def canonical_text(text: str) -> str:
    """The text in its one form: composed, without invisible characters, plain spaces, look-alikes folded, trimmed."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    parts, done = [], 0
    for m in _unstable().finditer(text):
        start = max(done, m.start() - 1)  # the stable character before is the boundary context
        parts += (text[done:start], _segment(text[start : m.end()]))
        done = m.end()
    return ("".join(parts) + text[done:] if parts else text).strip(" ")


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def canonical(c: Column) -> Column:
    """The canonical form of a string column; null stays null, empty stays empty. Only values with characters other than
    printable ASCII and line feeds go to Python; the others are trimmed in place."""
    plain = ~c.rlike(r"[^\n -~]")
    return F.when(plain, F.trim(c)).otherwise(_canonical(F.when(~plain, c)))


def with_canonical(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with a canonical column for each (new name: expression). An existing column of that name is replaced."""
    return df.withColumns({name: canonical(F.expr(e)) for name, e in columns.items()})


def digests(df: DataFrame, rec: str, fields: dict[str, tuple[list[str], list[str], str]]) -> DataFrame:
    """``field, id, look, spelling``: for each field (name to group, shown and exact expressions) a digest of the row's group
    and of the canonical forms of what is shown, and one of the exact characters. Rows with a null in any of them have none
    for that field. One pass over ``df``; what several fields show is made canonical once."""
    shown = {e: f"_shown_{i}" for i, e in enumerate(dict.fromkeys(e for _, own, _ in fields.values() for e in own))}
    rows = df.withColumns({"_row_id": F.expr(rec)} | {n: canonical(F.expr(e)) for e, n in shown.items()})
    forms = []
    for name, (group, own, exact) in fields.items():
        parts = [*[F.expr(g).cast("string") for g in group], *[F.col(shown[e]) for e in own]]
        there = F.expr(exact).isNotNull()
        for p in parts:
            there = there & p.isNotNull()
        look = F.unhex(F.md5(F.to_json(F.array(*parts))))
        forms.append(F.when(there, F.struct(F.lit(name).alias("field"), look.alias("look"), F.unhex(F.md5(F.expr(exact))).alias("spelling"))))
    made = rows.select(F.col("_row_id").alias("id"), F.explode(F.array_compact(F.array(*forms))).alias("f"))
    return made.select("f.field", "id", "f.look", "f.spelling").where("id is not null")


def look_alikes(keyed: DataFrame) -> DataFrame:
    """The rows of digests whose look has two spellings or more. The digests are written once; the looks are found by partial
    aggregation over them, so that a frequent value with one spelling costs nothing."""
    keyed = written(keyed, "looks")
    many = keyed.groupBy("field", "look").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("field", "look")
    return keyed.join(many, ["field", "look"], "left_semi")


def look_alike_classes(alike: DataFrame) -> DataFrame:
    """``field, id, class_id, spelling_id``: rows that look the same form a class, named by its least id; rows of it with the
    same characters share a ``spelling_id``, the least id among them. One row per row of look_alikes, however large a class:
    two rows look alike but differ if they have one ``class_id`` and two ``spelling_id``."""
    spelled = alike.groupBy("field", "look", "spelling").agg(F.min("id").alias("spelling_id"))
    classed = alike.groupBy("field", "look").agg(F.min("id").alias("class_id"))
    rows = alike.join(spelled, ["field", "look", "spelling"]).join(classed, ["field", "look"])
    return rows.select("field", "id", "class_id", "spelling_id")


def look_alike_pairs(alike: DataFrame) -> DataFrame:
    """``field, id_a, id_b`` with ``id_a < id_b``: the pairs of rows of one class with different spellings. As many rows as
    there are pairs; use the classes where those will do."""
    a, b = alike.alias("a"), alike.alias("b")
    met = a.join(b, (F.col("a.field") == F.col("b.field")) & (F.col("a.look") == F.col("b.look")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.spelling") != F.col("b.spelling")))
    return met.select("a.field", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
