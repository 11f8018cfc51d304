"""Raw records to nodes and edges, one plan per source. Every function returns lazy frames; writing is the caller's."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelwerk.functions import keys as K
from stelwerk.functions import text as X
from stelwerk.operators import graph
from stelwerk.operators.merge import last_per_key
from stelwerk.operators.nested import local_name
from stelwerk.sources import raw as R
from stelwerk.sources.profiles import section

ARTICLE_SCHEMA = "bwb_id string, seq int, article_number string, text string"


class _Parts:
    """A document's elements as tables by name: rows in document order, each with the number of its parent and of its last
    descendant. What stands inside an element are rows of a table between two numbers."""

    def __init__(self, xml: str):
        top = ElementTree.fromstring(xml)
        self.elements: list[ElementTree.Element] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.tables: dict[str, list[int]] = defaultdict(list)
        todo = [(top, -1)]
        while todo:
            e, up = todo.pop()
            if up == -2:  # everything inside has been numbered
                self.last[e] = len(self.elements) - 1
                continue
            at = len(self.elements)
            self.elements.append(e)
            self.parent.append(up)
            self.last.append(at)
            self.tables[local_name(e.tag)].append(at)
            todo.append((at, -2))
            todo += [(c, at) for c in reversed(e) if isinstance(c.tag, str)]

    def inside(self, at: int, name: str, itself: bool = False) -> list[int]:
        rows = self.tables.get(name, [])
        return rows[bisect_right(rows, at - itself) : bisect_right(rows, self.last[at])]

    def first(self, at: int, *names: str) -> int | None:
        """The first element of the first name inside, then of the next name inside that."""
        for name in names:
            rows = self.inside(at, name)
            if not rows:
                return None
            at = rows[0]
        return at

    def text(self, at: int | None) -> str:
        return "" if at is None else "".join(self.elements[at].itertext()).strip()


_LABEL = re.compile(r"\s*artikel[:.\s]*(.*?)\s*$", re.I | re.S)


def article_rows(xml: str | None) -> Iterator[tuple[int, str, str]]:
    """(position, number, text) of every article of a law's XML that has both, nested ones too; none if malformed.

    An article is an element of that name or with a label that begins with it. Its number stands in its heading, else in
    the label. Its text is its paragraphs, each with its number before it; without paragraphs, all its lines."""
    try:
        doc = _Parts(xml or "")
    except (ElementTree.ParseError, ValueError, RecursionError):
        return
    labels = {at: m[1] for at, e in enumerate(doc.elements) if (m := _LABEL.match(e.get("label") or ""))}
    lines: dict[int, list[str]] = defaultdict(list)  # by paragraph, the lines directly in it
    for at in doc.tables.get("al", []):
        if words := doc.text(at):
            lines[doc.parent[at]].append(words)
    for n, at in enumerate(sorted({*doc.tables.get("artikel", []), *labels})):
        number = doc.text(doc.first(at, "kop", "nr")) or labels.get(at, "")
        paragraphs = [f"{no}. {own}" if (no := doc.text(doc.first(p, "lidnr"))) else own for p in doc.inside(at, "lid", itself=True) if (own := " ".join(lines.get(p, [])))]
        text = "\n".join(paragraphs or filter(None, map(doc.text, doc.inside(at, "al", itself=True))))
        if number and text:
            yield n, number, text


def law_articles(laws: DataFrame) -> DataFrame:
    """ARTICLE_SCHEMA from ``bwb_id, xml``. Each document is parsed in its task, by Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(law, *a) for law, xml in zip(b["bwb_id"].to_pylist(), b["xml"].to_pylist()) for a in article_rows(xml)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["bwb_id", "seq", "article_number", "text"])

    return laws.select("bwb_id", "xml").mapInArrow(run, ARTICLE_SCHEMA)


def _node(df: DataFrame, collection: str, kind: str, key: Column, labels: Column, props: Mapping[str, Column]) -> DataFrame:
    named = dict(props) | {"display_name": X.display_name(F.lit(kind), dict(props))}
    return df.select(key.alias("_key"), K.node_id(collection, key).alias("_id"), F.lit(kind).alias("type"), labels.alias("labels"), F.struct(*[c.alias(n) for n, c in named.items()]).alias("props"), "fetched_at", F.col("raw_key"))


def _last(nodes: DataFrame) -> DataFrame:
    """The node of the last fetched record of each key."""
    return last_per_key(nodes, ["_key"], ["fetched_at", "raw_key"]).select("_key", "_id", "type", "labels", "props")


def _labels(first: str, extra: Column, name: str) -> Column:
    return F.when(extra, F.array(F.lit(first), F.lit(name))).otherwise(F.array(F.lit(first)))


def laws(raw: DataFrame, since=None) -> dict[str, DataFrame]:
    """Instruments, articles and their edges from law documents. A law whose XML is malformed still is an instrument."""
    rows = R.scan(raw, "bwb", ["bwb-toestand-xml"], since)
    law = F.coalesce(F.nullif(F.col("meta")["bwb_id"], F.lit("")), F.nullif("external_id", F.lit("")))
    rows = rows.select(law.alias("bwb_id"), F.col("payload_text").alias("xml"), "fetched_at", F.col("_key").alias("raw_key")).where("bwb_id is not null and coalesce(xml, '') <> ''")
    last = last_per_key(rows, ["bwb_id"], ["fetched_at", "raw_key"])
    instruments = _node(last, "instruments", "instrument", K.node_key(F.col("bwb_id")), F.array(F.lit("BWB")), {"bwb_id": F.col("bwb_id"), "title": F.concat(F.lit("BWB-regeling "), F.col("bwb_id"))})
    found = law_articles(last)
    one = last_per_key(found.withColumn("_key", K.node_key(F.col("bwb_id"), F.col("article_number"))), ["_key"], ["seq"])
    articles = _node(one.withColumns({"fetched_at": F.lit(None), "raw_key": F.lit(None)}), "instrument_articles", "article", F.col("_key"), F.array(F.lit("BWB"), F.lit("Article")), {"bwb_id": F.col("bwb_id"), "article_number": F.col("article_number"), "text": F.col("text")})
    articles = articles.select("_key", "_id", "type", "labels", "props")
    part = graph.edges(articles, F.col("_id"), K.node_id("instruments", K.node_key(F.col("props.bwb_id"))), graph.PART_OF_INSTRUMENT, True, "bwb-normalize")
    return {"instruments": _last(instruments), "instrument_articles": articles, "edges_strict": part}


def eu_acts(raw: DataFrame, profile: Mapping[str, Any], since=None, topics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Instruments from EU pages; acts of the profile's domain bear its label and an edge to its topic."""
    rows = R.scan(raw, "eurlex", ["eu-celex-html"], since).withColumnRenamed("_key", "raw_key")
    rows = rows.withColumn("celex", F.nullif(F.coalesce(F.col("meta")["celex"], F.col("external_id")), F.lit(""))).where("celex is not null")
    wanted = [str(i.get("celex")) for i in section(profile, "eu_instruments") or [] if i.get("celex")] + [str(x) for x in section(profile, "filters", "eurlex", "celex_ids") or []]
    own = F.coalesce(F.col("celex").isin(wanted), F.lit(False)) | X.has_keyword(F.col("payload_text"), section(profile, "filters", "eurlex", "subject_keywords") or [])
    slug = str(section(profile, "topic", "slug") or "")
    nodes = _node(rows, "instruments", "instrument", K.node_key(F.col("celex")), _labels("EU", own, slug.capitalize()), {"celex": F.col("celex"), "raw_html": F.col("payload_text"), "lang": F.col("meta")["lang"]})
    last = _last(nodes)
    return {"instruments": last, "edges_semantic": topic_edges(last, profile, "eurlex-normalize", topics)}


def judgments(raw: DataFrame, profile: Mapping[str, Any], since=None, topics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Judgments from content records that name their ECLI."""
    rows = R.scan(raw, "rechtspraak", ["rs-content"], since).withColumnRenamed("_key", "raw_key")
    rows = rows.withColumn("ecli", F.nullif(F.coalesce(F.col("meta")["ecli"], F.col("external_id")), F.lit(""))).where("ecli is not null")
    rules = section(profile, "filters", "rechtspraak")
    seeds = [str(x) for x in section(profile, "seed_examples", "rechtspraak_eclis") or []]
    own = F.coalesce(F.col("ecli").isin(seeds), F.lit(False)) | X.has_prefix(F.col("ecli"), rules.get("ecli_prefixes", [])) | X.has_keyword(F.col("payload_text"), rules.get("search_terms", [])) | X.in_list(F.col("meta")["rechtsgebied"], rules.get("rechtsgebieden", []))
    slug = str(section(profile, "topic", "slug") or "")
    nodes = _node(rows, "judgments", "judgment", K.node_key(F.col("ecli")), _labels("Rechtspraak", own, slug.capitalize()), {"ecli": F.col("ecli"), "raw_xml": F.col("payload_text"), "source_kind": F.col("kind")})
    last = _last(nodes)
    return {"judgments": last, "edges_semantic": topic_edges(last, profile, "rechtspraak-normalize", topics)}


def parliament(raw: DataFrame, profile: Mapping[str, Any], since=None, topics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Procedures and publications from parliament's cases and document versions, with the edges between them."""
    both = R.scan(raw, "tk", ["tk-zaak", "tk-documentversie"], since).withColumnRenamed("_key", "raw_key").where("payload_json is not null")
    rules = section(profile, "filters", "tk")
    own = F.lit(False)
    for f in ("Titel", "ZaakTitel", "Omschrijving", "TitelMetBijlagen"):
        own = own | X.has_keyword(R.field(f), rules.get("title_contains", []))
    own = own | X.has_keyword(F.col("payload_json"), rules.get("dossier_keywords", []))
    slug = str(section(profile, "topic", "slug") or "")
    frames = R.by_kind(both, ["tk-zaak", "tk-documentversie"])
    labels = _labels("TK", own, slug.capitalize())
    case_id = X.first_filled(R.field("Id"), R.field("ZaakId"), R.field("ZaakNummer"))
    cases = frames["tk-zaak"].withColumn("external_id", case_id).where("external_id is not null")
    procedures = _last(_node(cases, "procedures", "procedure", K.node_key(F.col("external_id")), labels, {"external_id": F.col("external_id"), "title": X.first_truthy(R.field("Titel"), R.field("ZaakTitel"), R.field("Omschrijving")), "raw": F.col("payload_json")}))
    version_id = X.first_filled(R.field("Id"), R.field("DocumentVersieId"))
    versions = frames["tk-documentversie"].withColumn("external_id", version_id).where("external_id is not null")
    publications = _last(_node(versions, "publications", "publication", K.node_key(F.col("external_id")), labels, {"external_id": F.col("external_id"), "procedure_external_id": X.first_filled(R.field("ZaakId"), R.field("ZaakNummer")), "title": X.first_truthy(R.field("Titel"), R.field("TitelMetBijlagen")), "raw": F.col("payload_json")}))
    known = procedures.select(F.col("props.external_id").alias("ref"), F.col("_id").alias("procedure_id"))
    met = publications.select("_id", F.col("props.procedure_external_id").alias("ref")).join(known, "ref")
    part = graph.edges(met, F.col("_id"), F.col("procedure_id"), graph.PART_OF_PROCEDURE, True, "tk-normalize")
    topics = topic_edges(procedures, profile, "tk-normalize", topics).unionByName(topic_edges(publications, profile, "tk-normalize", topics))
    return {"procedures": procedures, "publications": publications, "edges_strict": part, "edges_semantic": topics}


def topic_key(profile: Mapping[str, Any]) -> Column:
    return K.node_key(F.lit(str(section(profile, "topic", "slug") or section(profile, "topic", "id") or "")), fold=False)


def topic_edges(nodes: DataFrame, profile: Mapping[str, Any], source: str, topics: DataFrame | None = None) -> DataFrame:
    """Edges to the profile's topic from the nodes that bear its label; none without a topic. ``topics``: the stored ones; of
    those with the profile's id or slug the one with the least key is meant, else a key is made of the slug."""
    slug = str(section(profile, "topic", "slug") or "")
    chosen = nodes.where(F.array_contains("labels", slug.capitalize()) & F.lit(bool(slug)))
    target = K.node_id("topics", topic_key(profile))
    if topics is not None:
        target = F.coalesce(graph.find_topic(topics, section(profile, "topic", "id") or None, slug or None).select("_id").scalar(), target)
    return graph.edges(chosen, F.col("_id"), target, graph.RELATED_TOPIC, False, source)
