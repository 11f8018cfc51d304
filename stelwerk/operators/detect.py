"""Citation detectors: rules compiled to columns.

A rule is a pattern and what its groups mean. All rules of a detector run over a text in one projection; their matches
are exploded once. The first match of each target wins by (rule, position), which partial aggregation decides map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelwerk.functions import text as X
from stelwerk.operators.scan import find_all, pattern

#: Numbers of a range that are spelled out in one array; longer ranges are cut into such stretches first.
STRETCH = 10_000


@dataclass(frozen=True)
class Rule:
    """``regex`` without flags. Group numbers: of the article, of a code to look up, of a law's id, of a CELEX id, of year and
    number of an EU act (with ``letter``). ``law`` and ``act``: fixed targets."""

    regex: str
    kind: str
    confidence: float
    article: int = 0
    code: int = 0
    law_id: int = 0
    celex_id: int = 0
    year: int = 0
    number: int = 0
    letter: str = ""
    law: str = ""
    act: str = ""


# Forms of citations, their confidences, in the order in which they are looked for.
_NO = r"(\d+[a-z]?)"
_EU = r"\s+(\d{4})/(\d+)(?:/EU|/EG)?\b"
_CELEX = r"\bCELEX:([0-9A-Z()\\/.\-]+)\b"
CODES = {"judgment": ("Sr", "Sv", "WVW"), "eu": ("Sr", "Sv", "BW"), "parliament": ("Sr", "Sv", "BW", "EVRM"), "parliament_short": ("Sr", "Sv", "BW")}


def _codes(names: Sequence[str]) -> str:
    return "(" + "|".join(names) + ")"


def eu_rules(codes: Sequence[str] = CODES["eu"]) -> list[Rule]:
    return [
        Rule(rf"\bartikel\s+{_NO}\s+van\s+Richtlijn{_EU}", "article", 0.85, article=1, year=2, number=3, letter="L"),
        Rule(rf"\bartikel\s+{_NO}\s+van\s+Verordening{_EU}", "article", 0.85, article=1, year=2, number=3, letter="R"),
        Rule(_CELEX, "instrument", 0.9, celex_id=1),
        Rule(rf"\bRichtlijn{_EU}", "instrument", 0.7, year=1, number=2, letter="L"),
        Rule(rf"\bVerordening{_EU}", "instrument", 0.7, year=1, number=2, letter="R"),
        Rule(rf"\bartikel\s+{_NO}\s*{_codes(codes)}\b", "article", 0.95, article=1, code=2),
        Rule(r"\b(BWBR0\d{6})\b", "instrument", 0.7, law_id=1),
    ]


def parliament_rules(acts: Mapping[str, tuple[str | None, str | None]], codes: Sequence[str] = CODES["parliament"], short_codes: Sequence[str] = CODES["parliament_short"]) -> list[Rule]:
    """``acts``: name to (law id, CELEX id)."""
    named = [Rule(rf"(?<![\p{{L}}\p{{N}}_])\Q{name}\E(?![\p{{L}}\p{{N}}_])", "instrument", 0.6, law=law or "", act=act or "") for name, (law, act) in acts.items() if law or act]
    return [
        *named,
        Rule(r"\b(BWBR0\d{6})\b", "instrument", 0.75, law_id=1),
        Rule(rf"\bartikel\s+{_NO}\s*{_codes(codes)}\b", "article", 0.95, article=1, code=2),
        Rule(rf"\bart\.\s*{_NO}\s*{_codes(short_codes)}\b", "article", 0.95, article=1, code=2),
        Rule(_CELEX, "instrument", 0.9, celex_id=1),
        Rule(rf"\bRichtlijn{_EU}", "instrument", 0.65, year=1, number=2, letter="L"),
        Rule(rf"\bVerordening{_EU}", "instrument", 0.65, year=1, number=2, letter="R"),
    ]


def judgment_rules(codes: Sequence[str] = CODES["judgment"]) -> list[Rule]:
    return [
        Rule(rf"\bart\.\s*{_NO}\s*{_codes(codes)}\b", "article", 0.95, article=1, code=2),
        Rule(rf"\bartikel\s+{_NO}\s*{_codes(codes)}\b", "article", 0.95, article=1, code=2),
    ]


#: Articles named without a law, for judgments: kept only outside the spans of the rules above.
BARE_RULES = [Rule(rf"\bartikel\s+{_NO}\b", "article", 0.35, article=1), Rule(rf"\bart\.\s*{_NO}\b", "article", 0.35, article=1)]

# How a law's text names its own articles, and the confidences.
LAW_BLOCK = r"\b(?:de\s+)?(?:artikel(?:en)?|art(?:ikel)?\.?)\s+(\d+[a-zA-Z]{0,4}(?:\s*(?:tot\s+en\s+met|tot|en|,|&|-)\s*\d+[a-zA-Z]{0,4})*)"
LAW_NUMBER = r"\d+[a-zA-Z]{0,4}"
NUMBER_CONFIDENCE, RANGE_CONFIDENCE = 0.95, 0.8


def confidence_of(section: Mapping[str, object], name: str, default: float) -> float:
    """A confidence from a profile's section, the default where it is missing or no number."""
    try:
        return float(section[name])  # type: ignore[arg-type]
    except (KeyError, TypeError, ValueError):
        return default


def code_map(aliases: Mapping[str, str]) -> dict[str, str]:
    """Aliases and ids stripped, aliases upper-case, blanks left out."""
    return {str(k).strip().upper(): str(v).strip() for k, v in aliases.items() if k and v and str(k).strip() and str(v).strip()}


def _lookup(c: Column, values: Mapping[str, str]) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.upper(c)]


def _numbered(found: Column, seq: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(seq).alias("seq"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("raw_match")))


def matches(df: DataFrame, doc: str, text: str, rules: Sequence[Rule], base: int = 0) -> DataFrame:
    """``doc, txt, seq, start, end, raw_match``: every match of every rule; ``seq`` is the rule's number from ``base``."""
    arrays = [_numbered(find_all(F.col("txt"), pattern(r.regex)), base + i) for i, r in enumerate(rules)]
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("txt")).where("txt is not null")
    return rows.select("doc", "txt", F.inline(F.concat(*arrays)))


def targets(found: DataFrame, rules: Sequence[Rule], codes: Mapping[str, str], base: int = 0) -> DataFrame:
    """Adds ``kind, celex, bwb_id, article_number, confidence`` as the rules say; hits with an unknown code go."""
    null = F.lit(None).cast("string")
    cols = {"kind": null, "celex": null, "bwb_id": null, "article_number": null, "confidence": F.lit(None).cast("double")}
    known = F.lit(True)
    for i, r in enumerate(rules):
        here = F.col("seq") == base + i
        group = lambda g, r=r: F.regexp_extract("raw_match", pattern(r.regex), g)
        law = _lookup(group(r.code), codes) if r.code else F.upper(group(r.law_id)) if r.law_id else F.lit(r.law) if r.law else null
        act = F.upper(group(r.celex_id)) if r.celex_id else X.celex(r.letter, group(r.year), group(r.number)) if r.year else F.lit(r.act) if r.act else null
        own = {"kind": F.lit(r.kind), "celex": act, "bwb_id": law, "article_number": group(r.article) if r.article else null, "confidence": F.lit(r.confidence)}
        cols = {n: F.when(here, own[n]).otherwise(c) for n, c in cols.items()}
        if r.code:
            known = known & (~here | law.isNotNull())
    return found.where(known).withColumns(cols)


def first_per_target(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first hit (by rule, then position) of each document and target. Null keys are equal to one another."""
    rest = [c for c in hits.columns if c not in ("doc", *keys)]
    order = ["seq", "start"] + [c for c in rest if c not in ("seq", "start")]
    best = hits.groupBy("doc", *keys).agg(F.min(F.struct(*order)).alias("b"))
    return best.select("doc", *keys, *[F.col(f"b.{c}") for c in order])


def detect(df: DataFrame, doc: str, text: str, rules: Sequence[Rule], codes: Mapping[str, str]) -> DataFrame:
    """``doc, kind, celex, bwb_id, article_number, seq, start, end, raw_match, confidence, snippet``: the hits of a text.
    Null and empty texts have none; repeated documents give each hit once; ``doc`` should be unique."""
    found = matches(df, doc, text, rules)
    shown = found.withColumn("snippet", X.snippet(F.col("txt"), F.col("start"), F.col("end"))).drop("txt")
    return first_per_target(targets(shown, rules, code_map(codes)), ["kind", "celex", "bwb_id", "article_number"])


def detect_judgment(df: DataFrame, doc: str, text: str, codes: Mapping[str, str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """As detect, with bare article numbers outside the accepted citations (no target, confidence 0.35)."""
    rules = list(rules or judgment_rules())
    known = _lookup_known(rules, code_map(codes))
    base = len(rules)
    with_code = F.concat(*[F.filter(find_all(F.col("txt"), pattern(r.regex)), known(r)) for r in rules])
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("txt")).where("txt is not null").withColumn("spans", with_code)
    free = lambda m: ~F.exists("spans", lambda s: (m["end"] > s["start"]) & (m["start"] < s["end"]))
    bare = F.concat(*[_numbered(F.filter(find_all(F.col("txt"), pattern(r.regex)), free), base + i) for i, r in enumerate(BARE_RULES)])
    extra = targets(rows.select("doc", "txt", F.inline(bare)), BARE_RULES, {}, base)
    extra = extra.withColumn("snippet", X.snippet(F.col("txt"), F.col("start"), F.col("end"))).drop("txt")
    first = first_per_target(extra, ["kind", "celex", "bwb_id", "article_number"])
    return detect(df, doc, text, rules, codes).unionByName(first)


def _lookup_known(rules: Sequence[Rule], codes: Mapping[str, str]):
    def known(r: Rule):
        return lambda m: _lookup(F.regexp_extract(m["text"], pattern(r.regex), r.code), codes).isNotNull()

    return known


def detect_law(df: DataFrame, doc: str, text: str, law: str, number_confidence: float = NUMBER_CONFIDENCE, range_confidence: float = RANGE_CONFIDENCE) -> DataFrame:
    """``doc, start, end, text, bwb_id, article_number, confidence``: articles of its own law that a law's text names.

    Each number of a block (``artikelen 1, 2 en 5``) is a hit; numbers joined by ``tot`` also stand for the whole numbers
    between them, with the block's span. Offsets are those of the stripped text. Rows without text or law have none; the
    first of equal (start, end, number) wins; a range is spelled out however wide it is, by stretches."""
    rows = df.select(F.col(doc).alias("doc"), X.filled(F.col(text)).alias("txt"), F.nullif(F.col(law), F.lit("")).alias("bwb_id")).dropna()
    blocks = rows.select("doc", "bwb_id", F.inline(find_all(F.col("txt"), pattern(LAW_BLOCK))))
    numbers = F.regexp_extract("text", pattern(LAW_BLOCK), 1)
    blocks = blocks.select("doc", "bwb_id", F.col("end"), numbers.alias("block")).withColumn("at", F.col("end") - F.length("block"))
    parts = blocks.withColumn("n", find_all(F.col("block"), pattern(LAW_NUMBER)))

    single = parts.select("doc", "bwb_id", "at", F.inline("n")).select("doc", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "text", "bwb_id", F.col("text").alias("article_number"), F.lit(number_confidence).alias("confidence"))

    pairs = parts.select("doc", "bwb_id", "at", "end", "block", F.inline(F.arrays_zip(F.slice("n", 1, F.greatest(F.size("n") - 1, F.lit(0))).alias("a"), F.slice("n", 2, F.size("n")).alias("b"))))
    between = F.substring(F.col("block"), F.col("a.end") + 1, F.col("b.start") - F.col("a.end"))
    ends = pairs.where(F.contains(F.lower(between), F.lit("tot"))).select("*", X.leading_int(F.col("a.text")).alias("x"), X.leading_int(F.col("b.text")).alias("y"))
    wide = ends.select("*", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).where("hi - lo > 1")
    begins = F.sequence(F.col("lo") + 1, F.col("hi") - 1, F.lit(STRETCH).cast("bigint"))
    wide = wide.select("*", F.explode(begins).alias("from")).withColumn("until", F.least(F.col("from") + STRETCH - 1, F.col("hi") - 1))
    ranged = wide.select("doc", F.col("at").alias("start"), "end", F.col("block").alias("text"), "bwb_id", F.explode(F.transform(F.sequence("from", "until"), lambda n: n.cast("string"))).alias("article_number"), F.lit(range_confidence).alias("confidence"))

    hits = single.unionByName(ranged).withColumn("lower", F.lower("article_number"))
    best = hits.groupBy("doc", "start", "end", "lower").agg(F.max(F.struct("confidence", "article_number", "text", "bwb_id")).alias("b"))
    return best.select("doc", "start", "end", "b.text", "b.bwb_id", "b.article_number", "b.confidence")
