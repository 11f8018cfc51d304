"""Citations in texts to edges: text, detect, resolve, last hit of an edge wins."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelwerk.functions import text as X
from stelwerk.operators import detect as D
from stelwerk.operators import graph
from stelwerk.operators.scan import find_all, pattern
from stelwerk.sources.profiles import act_aliases, section


def joined_text(fragments: list[Column], max_chars: int | None = None) -> Column:
    """The filled fragments, one a line, null if there are none. ``max_chars`` cuts the result; the default reads all."""
    text = F.nullif(F.concat_ws("\n", *[X.filled(f) for f in fragments]), F.lit(""))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def capped_text(fragments: list[Column], more: Column, max_chars: int) -> Column:
    """As joined_text, with the lines of ``more`` after the fragments as long as fewer than ``max_chars`` characters came
    before; no line is cut."""
    size = F.lit(0)
    for f in fragments:
        size = size + F.coalesce(F.length(X.filled(f)), F.lit(0))
    start = F.struct(size.cast("int").alias("n"), F.lit(0).alias("lines"))
    lines = F.split(more, "\n")
    fits = F.aggregate(lines, start, lambda a, x: F.struct(F.when(a["n"] < max_chars, a["n"] + F.length(x)).otherwise(a["n"]).cast("int").alias("n"), (a["lines"] + (a["n"] < max_chars).cast("int")).alias("lines")))
    return joined_text([*fragments, F.concat_ws("\n", F.slice(lines, F.lit(1), fits["lines"]))])


def prop(df: DataFrame, name: str) -> Column:
    """A field of ``props``, null where the table has none of that name."""
    return F.col(f"props.{name}") if name in df.schema["props"].dataType.fieldNames() else F.lit(None).cast("string")


def _since(docs: DataFrame, since, column: str = "ingested_at") -> DataFrame:
    return docs if since is None else docs.where(F.col(column) >= F.lit(str(since)).cast(docs.schema[column].dataType))


def codes_of(profile: Mapping[str, Any], own: tuple[str, ...], strict: bool = False) -> list[str]:
    """The codes a detector looks for: its own and the profile's; ``strict``: its own only."""
    return list(dict.fromkeys([*own, *([] if strict else _profile_codes(profile))]))


def _profile_codes(profile: Mapping[str, Any]) -> list[str]:
    return [str(k).strip() for k in section(profile, "code_aliases") if str(k).strip()]


def link_laws(articles: DataFrame, nodes: DataFrame, laws: list[str] | None = None, profile: Mapping[str, Any] | None = None) -> DataFrame:
    """Edges between articles of one law that name each other. ``laws``: only these; self-references stay. A profile's
    section ``bwb`` may set ``confidence_default`` and ``confidence_range``."""
    docs = articles.where("props.text is not null")
    if laws is not None:
        docs = docs.where(F.col("props.bwb_id").isin(laws))
    hits = D.detect_law(docs.select(F.col("_id"), F.col("props.text").alias("t"), F.col("props.bwb_id").alias("law")), "_id", "t", "law", *_confidences(profile))
    hits = hits.withColumns({"seq": F.lit(0), "celex": F.lit(None).cast("string"), "raw_match": F.col("text"), "snippet": F.lit(None).cast("string")})
    return graph.semantic_edges(graph.resolve(hits, nodes), graph.REFERS_TO_ARTICLE, "bwb-article-linker", ("start", "article_number"))


def _confidences(profile: Mapping[str, Any] | None) -> tuple[float, float]:
    own = section(profile or {}, "bwb")
    return D.confidence_of(own, "confidence_default", D.NUMBER_CONFIDENCE), D.confidence_of(own, "confidence_range", D.RANGE_CONFIDENCE)


def with_citations(articles: DataFrame) -> DataFrame:
    """Node rows of the articles whose props are their citations, to be merged into the stored ones."""
    return stored_citations(articles).select(F.regexp_replace("_id", "^[^/]*/", "").alias("_key"), "_id", F.struct("citations").alias("props"))


def stored_citations(articles: DataFrame) -> DataFrame:
    """``_id, citations``: an article's own citations in order, an empty list where there are none."""
    docs = articles.select("_id", F.col("props.text").alias("t"), F.col("props.bwb_id").alias("law"))
    hits = D.detect_law(docs, "_id", "t", "law")
    entry = F.struct("start", "end", "text", F.col("bwb_id").alias("target_bwb_id"), F.col("article_number").alias("target_article_number"), "confidence")
    got = hits.groupBy(F.col("doc").alias("_id")).agg(F.array_sort(F.collect_list(entry)).alias("citations"))
    empty = F.array().cast("array<struct<start:int,end:int,text:string,target_bwb_id:string,target_article_number:string,confidence:double>>")
    return docs.select("_id").join(got, "_id", "left").select("_id", F.coalesce("citations", empty).alias("citations"))


def link_eu(instruments: DataFrame, nodes: DataFrame, profile: Mapping[str, Any], since=None, max_chars: int | None = None, strict: bool = False) -> DataFrame:
    docs = _since(instruments.where(F.array_contains("labels", "EU")), since)
    text = joined_text([prop(docs, "title"), prop(docs, "official_title"), prop(docs, "display_name"), X.strip_html(prop(docs, "raw_html"))], max_chars)
    hits = D.detect(docs.select("_id", text.alias("t")), "_id", "t", D.eu_rules(codes_of(profile, D.CODES["eu"], strict)), section(profile, "code_aliases"))
    return graph.semantic_edges(graph.resolve(hits, nodes), graph.MENTIONS_ARTICLE, "eu-article-linker")


def recent_eclis(raw: DataFrame, since) -> DataFrame:
    """``ecli``: of the judgments whose contents were fetched at ``since`` or later, distinct."""
    rows = _since(raw.where((F.col("source") == "rechtspraak") & (F.col("kind") == "rs-content")), since, "fetched_at")
    return rows.select(F.col("meta")["ecli"].alias("ecli")).where("ecli is not null").distinct()


def judgment_text(docs: DataFrame) -> Column:
    """The document as it is, tags included, if it isn't blank; else the text."""
    own, other = prop(docs, "raw_xml"), prop(docs, "text")
    return F.when(X.filled(own).isNotNull(), own).when(X.filled(other).isNotNull(), other)


def link_judgments(judgments: DataFrame, nodes: DataFrame, profile: Mapping[str, Any], eclis: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``eclis``: only judgments with these (``ecli``); an empty frame means none."""
    docs = judgments if eclis is None else judgments.join(eclis.select(F.col("ecli").alias("_e")).distinct(), F.col("props.ecli") == F.col("_e"), "left_semi")
    codes = section(profile, "code_aliases")
    hits = D.detect_judgment(docs.select("_id", judgment_text(docs).alias("t")), "_id", "t", codes, D.judgment_rules(codes_of(profile, D.CODES["judgment"], strict))).where(F.col("bwb_id").isNotNull())
    return graph.semantic_edges(graph.resolve(hits, nodes), graph.MENTIONS_ARTICLE, "rechtspraak-article-linker")


def link_parliament(documents: DataFrame, nodes: DataFrame, profile: Mapping[str, Any], since=None, strict: bool = False, max_chars: int | None = None) -> DataFrame:
    """``max_chars``: no more strings of the raw record are added once the text has that many characters."""
    docs = _since(documents.where(F.array_contains("labels", "TK")), since)
    own, more = [prop(docs, n) for n in ("title", "summary", "body", "text")], X.json_strings(prop(docs, "raw"))
    text = joined_text([*own, more]) if max_chars is None else capped_text(own, more, max_chars)
    rules = D.parliament_rules(act_aliases(profile), codes_of(profile, D.CODES["parliament"], strict), codes_of(profile, D.CODES["parliament_short"], strict))
    hits = D.detect(docs.select("_id", text.alias("t")), "_id", "t", rules, section(profile, "code_aliases"))
    return graph.semantic_edges(graph.resolve(hits, nodes), graph.MENTIONS_ARTICLE, "tk-article-linker")


_CITED = r"\bart(?:ikel|icle|\.)\s+(\d+(?::\d+)*[a-z]?)\b(?:\s*,\s*lid\s+\d+)?"
_LEAD = r"^\s+(?:(?:van|of|de|der)\s+)?(?:(?:de|het|the)\s+)?"
#: Characters behind a citation that are looked at first; where the words asked for go beyond them, the whole text is.
REACH = 256
_STOP = r"[.!?:]\s|[;\n]"
_GAPS = r"[^\p{L}\p{N}]+"


def name_form(c: Column) -> Column:
    """The words of a name in lower case with single blanks, whatever signs stand between them."""
    return F.trim(F.regexp_replace(F.lower(c), _GAPS, " "))


def act_names(instruments: DataFrame) -> DataFrame:
    """``name, bwb_id, n_words``: titles and short titles (name_form) that mean one law only."""
    each = F.explode(F.array("props.title", "props.short_title"))
    rows = instruments.where("props.bwb_id is not null").select(F.col("props.bwb_id").alias("bwb_id"), each.alias("n"))
    named = rows.select(name_form(F.col("n")).alias("name"), "bwb_id").where("name <> ''")
    one = named.groupBy("name").agg(F.min("bwb_id").alias("bwb_id"), F.max("bwb_id").alias("other")).where("bwb_id = other")
    return one.select("name", "bwb_id", F.size(F.split("name", " ")).alias("n_words"))


def link_by_names(docs: DataFrame, text: str, names: DataFrame, nodes: DataFrame, source: str = "name-linker") -> DataFrame:
    """Edges for articles cited with an act's name or short title, where the names are a table of any size: the words after
    the article are joined to it, and the longest name that is there counts. ``docs``: ``_id`` and the text column.

    As many words are looked at as the longest name has (a small job asks the names for it), and names are told apart by
    their words, not by the signs between them; no name goes on behind the end of a sentence. Names meet the texts by their
    first word first, so only words that begin a name go on; what moves of a text are the words after its citations."""
    rx = pattern(_CITED)
    longest = names.agg(F.max("n_words")).first()[0] or 0

    def behind(m: Column) -> Column:
        """What follows a match: REACH characters, or all there is where those don't hold enough words."""
        near, more = F.substring(F.col(text), m["end"] + 1, F.lit(REACH)), F.substring(F.col(text), m["end"] + 1, F.length(F.col(text)))
        enough = F.regexp_count(near, F.lit(r"[\p{L}\p{N}]+")) > longest + 4
        return F.struct(m["start"].alias("start"), m["text"].alias("text"), F.when(enough | (F.length(near) < REACH), near).otherwise(more).alias("after"))

    found = docs.select(F.col("_id").alias("doc"), F.inline(F.transform(find_all(F.col(text), rx), behind)))
    lead = F.length(F.regexp_extract("after", pattern(_LEAD), 0))
    name = F.split(F.substring(F.col("after"), lead + 1, F.length("after")), _STOP)[0]
    found = found.where(lead > 0).select("doc", "start", "text", F.regexp_extract("text", rx, 1).alias("article_number"), F.slice(F.split(name_form(name), " "), 1, max(1, longest)).alias("w"))
    first = names.select(F.split("name", " ")[0].alias("first")).distinct()
    found = found.withColumn("first", F.col("w")[0]).join(first, "first", "left_semi")
    tries = found.select("doc", "start", "text", "article_number", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.concat_ws(" ", F.slice("w", F.lit(1), n)))).alias("n", "name"))
    best = tries.join(names, "name").groupBy("doc", "start", "text", "article_number").agg(F.max_by("bwb_id", "n").alias("bwb_id"))
    hits = best.select("doc", "start", "article_number", "bwb_id", F.col("text").alias("raw_match"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("celex"), F.lit(None).cast("string").alias("snippet"), F.lit(0.95).alias("confidence"))
    return graph.semantic_edges(graph.resolve(hits, nodes), graph.MENTIONS_ARTICLE, source, ("start", "raw_match"))
