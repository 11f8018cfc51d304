"""Queries for scans, functions, detectors, merges, graph questions and pipelines, over whole driver tables."""

from __future__ import annotations

import re
import unicodedata
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelwerk.functions import keys as K
from stelwerk.functions import text as X
from stelwerk.operators import detect as D
from stelwerk.operators import graph, merge
from stelwerk.operators.scan import find_all
from stelwerk.plans import engine, linkers, normalize, serve
from stelwerk.queries.problems import NODE_TABLES, table
from stelwerk.session import shared_dir
from stelwerk.sources import raw as R
from stelwerk.sources import versions
from stelwerk.sources.profiles import act_aliases
from stelwerk.streaming import ingest

#: A profile with the names the driver tables use.
PROFILE = {
    "topic": {"id": "topic:handhavingsrecht", "slug": "handhavingsrecht"},
    "nl_instruments": [{"id": "voorbeeld:a", "bwb_id": "BWBR0990001", "title": "Visserijwet binnenwater"}, {"id": "voorbeeld:b", "title": "Zonder nummer"}],
    "eu_instruments": [{"id": "voorbeeld:c", "celex": "39990R0001"}],
    "code_aliases": {"RsiIV": "BWBR0206810", "WheIV": "BWBR0207092", "VvrIV": "BWBR0207389", "RegIV": "BWBR0206396", "VsiIV": "BWBR0205511", "VhaII": "BWBR0202263", "Bac": "BWBR0201993", "WhrIV": "BWBR0201178"},
    "instrument_aliases": {"Regeling wapenwijze 2003": "BWBR0201173", "Wet onherroepelijke rioolcommissie": "BWBR0200057", "Besluit tijdelijke afvalmelding 1990": "BWBR0204202", "Wet vervoersfonds 1983": "BWBR0200256", "Wet brugvordering 2010": "BWBR0207411"},
    "filters": {"tk": {"title_contains": ["handhaving"], "dossier_keywords": ["straf"]}, "rechtspraak": {"search_terms": ["handhaving"], "ecli_prefixes": ["ECLI:NL:XQD"]}, "eurlex": {"subject_keywords": ["handhaving"]}},
}
KEYWORDS = ["subsidie", "visserij", "tariff", "pensioen"]
CITED = r"(?i)art(?:ikel|icle|[.]) +[0-9]+[a-z]?"
CITED_IN_ACT = r"(?i)art(?:ikel|icle|[.]) +[0-9]+[a-z]? +(?:van|of|de) +[a-z]+"
SINCE = "2032-01-01 00:00:00"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_view({t: table(spark, d, t) for t in NODE_TABLES})


def raw_scan_kind_since(spark, d):
    got = R.scan(table(spark, d, "raw_sources"), "tk", ["tk-zaak", "tk-documentversie"], SINCE)
    return got.select("_key", "kind", "external_id")


def raw_count_by_kind(spark, d):
    return table(spark, d, "raw_sources").groupBy("source", "kind").agg(F.count("*").alias("n"), F.count("payload_json").alias("n_json"), F.count("payload_text").alias("n_text"))


def raw_split_by_kind(spark, d):
    parts = R.by_kind(table(spark, d, "raw_sources"), ["rs-index", "rs-content"])
    rows = [df.select(F.lit(k).alias("kind"), "_key") for k, df in parts.items()]
    return rows[0].unionByName(rows[1])


def raw_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def raw_latest_per_key(spark, d):
    rows = table(spark, d, "raw_sources").where("external_id is not null").select("external_id", "fetched_at", F.col("_key").alias("raw_key"))
    return merge.last_per_key(rows, ["external_id"], ["fetched_at", "raw_key"]).select("external_id", "raw_key")


def raw_first_per_key(spark, d):
    rows = table(spark, d, "raw_sources").where("external_id is not null").select("external_id", "fetched_at", F.col("_key").alias("raw_key"))
    return merge.first_per_key(rows, ["external_id"], ["fetched_at", "raw_key"]).select("external_id", "raw_key")


def sources_in_order(spark, d):
    return merge.ordered_distinct(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("source", F.col("doc_id").alias("first_doc_id"))


def node_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", K.node_key(F.col("p_brand"), F.lit(" "), F.col("p_name"), fold=False).alias("node_key"), K.node_id("instruments", K.node_key(F.col("p_type"), fold=False)).alias("node_id"))


def article_keys(spark, d):
    """Keys of numbers and ids as stored, accents and full-width forms folded to ASCII."""
    return table(spark, d, "instrument_articles").select("rec_id", K.node_key(F.col("props.bwb_id"), F.col("props.article_number")).alias("node_key"))


def id_parts(spark, d):
    return table(spark, d, "edges_semantic").where("_to is not null").select("rec_id", K.id_collection(F.col("_to")).alias("collection"), K.id_key(F.col("_to")).alias("target_key"))


def display_names(spark, d):
    def named(t, kind, *props):
        return table(spark, d, t).select(F.lit(t).alias("node_table"), "rec_id", X.display_name(F.lit(kind), {p: F.col(f"props.{p}") for p in props}).alias("shown"))

    parts = [named("instruments", "instrument", "title", "bwb_id", "celex"), named("instrument_articles", "article", "article_number"), named("procedures", "procedure", "title", "external_id"), named("publications", "publication", "title"), named("topics", "topic", "name", "slug")]
    for p in parts[1:]:
        parts[0] = parts[0].unionByName(p)
    return parts[0]


def strip_html(spark, d):
    text = X.strip_html(F.col("props.raw_html"))
    return table(spark, d, "instruments").where("props.raw_html is not null").select("rec_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def joined_text(spark, d):
    text = linkers.joined_text([F.col("props.title"), F.col("props.raw")])
    return table(spark, d, "publications").select("rec_id", F.md5(text).alias("text_md5"))


def keyword_classifier(spark, d):
    return table(spark, d, "documents").select("doc_id", X.has_keyword(F.col("text"), KEYWORDS).alias("is_hit"))


def multi_rule_classifier(spark, d):
    rule = F.coalesce(F.col("doc_id").isin([1, 2, 3]), F.lit(False)) | X.has_prefix(F.col("source"), ["bron-q"]) | X.has_keyword(F.col("text"), ["onverminderd"]) | X.in_list(F.concat_ws(",", "source", "doc_kind"), ["TK", "Commentaar"])
    return table(spark, d, "documents").select("doc_id", rule.alias("is_hit"))


def _cited(spark, d, regex=CITED):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "bwb_id", "text", F.inline(find_all(F.col("text"), regex)).alias("at", "until", "raw_match"))


def citation_scan(spark, d):
    return _cited(spark, d).select("doc_id", F.col("at").alias("start_pos"), F.col("until").alias("end_pos"), "raw_match")


def citation_snippets(spark, d):
    return _cited(spark, d).select("doc_id", F.col("at").alias("start_pos"), X.snippet(F.col("text"), F.col("at"), F.col("until")).alias("snippet"))


def citation_first_per_number(spark, d):
    rows = _cited(spark, d).select("doc_id", F.lower(F.regexp_extract("raw_match", "[0-9]+[A-Za-z]?$", 0)).alias("number"), "at", "raw_match")
    return merge.first_per_key(rows, ["doc_id", "number"], ["at"]).select("doc_id", "number", F.col("at").alias("start_pos"), "raw_match")


def citation_edge_lastwins(spark, d):
    rows = _cited(spark, d).where("bwb_id is not null").select(K.edge_key(F.col("bwb_id"), F.regexp_extract("raw_match", "[0-9]+[A-Za-z]?$", 0), graph.REFERS_TO_ARTICLE).alias("edge_key"), "doc_id", "at", "raw_match")
    return merge.last_per_key(rows, ["edge_key"], ["doc_id", "at"]).select("edge_key", "doc_id", F.col("at").alias("start_pos"), "raw_match")


def overlap_antijoin(spark, d):
    taken = find_all(F.col("text"), CITED_IN_ACT)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", find_all(F.col("text"), CITED).alias("all"), taken.alias("taken"))
    free = F.filter("all", lambda m: ~F.exists("taken", lambda s: (m["end"] > s["start"]) & (m["start"] < s["end"])))
    return rows.select("doc_id", F.inline(free).alias("start_pos", "end_pos", "raw_match"))


def citation_ranges(spark, d):
    """The whole numbers strictly between two, spelled out and counted per order."""
    lo, hi = F.least("l_linenumber", F.col("l_quantity").cast("int")), F.greatest("l_linenumber", F.col("l_quantity").cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", lo.alias("lo"), hi.alias("hi")).where("hi - lo > 1")
    each = rows.select("l_orderkey", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("number"))
    return each.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("number").cast("bigint").alias("total"))


def celex_format(spark, d):
    letter = F.when(F.col("o_orderstatus") == "F", "L").otherwise("R")
    return table(spark, d, "orders").select("o_orderkey", X.celex(letter, F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey").cast("string")).alias("celex"))


def resolve_targets(spark, d):
    """Articles of its own law that a document names, where they are nodes."""
    hits = _cited(spark, d).where("bwb_id is not null").select(F.col("doc_id").alias("doc"), "bwb_id", F.regexp_extract("raw_match", "[0-9]+[A-Za-z]?$", 0).alias("article_number"), F.lit(None).cast("string").alias("celex")).distinct()
    return graph.resolve(hits, table(spark, d, "instrument_articles").select("_id")).select(F.col("doc").alias("doc_id"), "target_id").distinct()


def edge_build_strict(spark, d):
    articles = graph.current(table(spark, d, "instrument_articles"), "props.bwb_id as bwb_id")
    laws = graph.current(table(spark, d, "instruments"), "props.bwb_id as law_id").where("law_id is not null").select(F.col("_id").alias("instrument_id"), "law_id")
    met = articles.join(laws, F.col("bwb_id") == F.col("law_id"))
    return graph.edges(met, F.col("_id"), F.col("instrument_id"), graph.PART_OF_INSTRUMENT, True).select("_key", "_from", "_to", "relation", "strict")


def edge_build_publications(spark, d):
    pubs = graph.current(table(spark, d, "publications"), "props.procedure_external_id as ref")
    procs = graph.current(table(spark, d, "procedures"), "props.external_id as ref").select("ref", F.col("_id").alias("procedure_id"))
    return graph.edges(pubs.join(procs, "ref"), F.col("_id"), F.col("procedure_id"), graph.PART_OF_PROCEDURE, True).select("_key", "_from", "_to", "relation", "strict")


def edge_insert_if_absent(spark, d):
    cols = ["_from", "_to", "relation"]
    return merge.new_rows(table(spark, d, "edges_semantic").select(*cols).dropna(), table(spark, d, "edges_strict").select(*cols), cols)


def upsert_merge_nodes(spark, d):
    cols = ["_key", "type", F.struct("props.external_id", "props.title", "props.display_name").alias("props")]
    rows = table(spark, d, "procedures")
    old = merge.last_per_key(rows.where(F.col("ingested_at") < F.lit(SINCE).cast("timestamp_ntz")).select(*cols, "ingested_at", "rec_id"), ["_key"], ["ingested_at", "rec_id"]).drop("ingested_at", "rec_id")
    new = rows.where(F.col("ingested_at") >= F.lit(SINCE).cast("timestamp_ntz")).select(*cols, "ingested_at", "rec_id")
    done = merge.upsert(old, new, "_key", ["ingested_at", "rec_id"])
    return done.select("_key", F.col("props.external_id").alias("external_id"), F.col("props.title").alias("title"), F.col("props.display_name").alias("display_name"), "created")


def seed_summary(spark, d):
    rows = table(spark, d, "procedures").select("_key", "ingested_at", "rec_id")
    at = F.lit(SINCE).cast("timestamp_ntz")
    done = rows.groupBy("_key").agg(F.min("ingested_at").alias("first"), F.max("ingested_at").alias("last"))
    return done.agg(F.count_if(F.col("first") >= at).alias("n_created"), F.count_if((F.col("first") < at) & (F.col("last") >= at)).alias("n_updated"))


def topic_or_lookup(spark, d):
    return graph.find_topic(table(spark, d, "topics"), "topic:grondrecht", "grondrecht").select("_key", "_id")


def edge_upsert(spark, d):
    """Edges stored again later, with another confidence or source: the later row counts."""
    cols = ["_key", "_from", "_to", "relation", "confidence", "source", "created_at", "rec_id"]
    rows = table(spark, d, "edges_semantic").select(*cols).where("_key is not null")
    at = F.lit(SINCE).cast("timestamp_ntz")
    old = merge.last_per_key(rows.where(F.col("created_at") < at), ["_key"], ["created_at", "rec_id"])
    done = merge.upsert(old, rows.where(F.col("created_at") >= at), "_key", ["created_at", "rec_id"])
    return done.select("_key", "_from", "_to", "relation", "confidence", "source", "created")


def node_update(spark, d):
    """Publications stored again later change the ones there were; new ones don't come in."""
    rows = table(spark, d, "publications").select("_key", F.struct("props.title", "props.procedure_external_id").alias("props"), "ingested_at", "rec_id")
    at = F.lit(SINCE).cast("timestamp_ntz")
    old = merge.last_per_key(rows.where(F.col("ingested_at") < at), ["_key"], ["ingested_at", "rec_id"])
    done = merge.update(old, rows.where(F.col("ingested_at") >= at), "_key", ["ingested_at", "rec_id"])
    return done.select("_key", F.col("props.title").alias("title"), F.col("props.procedure_external_id").alias("procedure_external_id"), "updated")


def labels_contains(spark, d):
    return table(spark, d, "instruments").where(F.array_contains("labels", "EU")).select("rec_id", "_key")


def instrument_topics(spark, d):
    acts = graph.current(table(spark, d, "instruments"), "props.celex as celex").where("celex is not null")
    to_topic = table(spark, d, "edges_semantic").where(F.col("relation") == graph.RELATED_TOPIC).select(F.col("_from").alias("_id"), F.col("_to").alias("topic_id")).distinct()
    return acts.join(to_topic, "_id").select("_id", "celex", "topic_id")


def mentions_of_article(spark, d):
    return graph.mentions(table(spark, d, "edges_semantic")).select(F.col("_id").alias("article_id"), "source_id")


def confident_edges(spark, d):
    return table(spark, d, "edges_semantic").where("confidence >= 0.8").select("rec_id", "_from", "_to", "confidence")


def article_detail(spark, d):
    articles = graph.current(table(spark, d, "instrument_articles"), "props.display_name as display_name")
    return graph.article_detail(articles, table(spark, d, "edges_strict"), table(spark, d, "edges_semantic"), nodes(spark, d)).withColumnRenamed("_id", "article_id")


def _articles(spark, d):
    return graph.current(table(spark, d, "instrument_articles"), "struct(props.bwb_id, props.text) as props")


def article_citations(spark, d):
    """What each article refers to, by its edges and by the citations found in its own text."""
    got = graph.article_citations(linkers.stored_citations(_articles(spark, d)), table(spark, d, "edges_semantic"), nodes(spark, d))
    return got.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def judgment_detail(spark, d):
    """Every judgment of the raw records by its ECLI: the articles it mentions, with their instruments."""
    found = normalize.judgments(_raw(spark, d), PROFILE)["judgments"]
    asked = found.select("props.ecli")
    return graph.judgment_detail(asked, found, table(spark, d, "edges_strict"), table(spark, d, "edges_semantic"), nodes(spark, d))


def document_articles(spark, d):
    docs = graph.current(table(spark, d, "publications"))
    return graph.document_articles(docs, table(spark, d, "edges_strict"), table(spark, d, "edges_semantic"), nodes(spark, d)).withColumnRenamed("_id", "document_id")


def node_neighbors(spark, d):
    cols = ["_from", "_to", "relation", "confidence", "strict"]
    both = table(spark, d, "edges_strict").select(*cols).unionByName(table(spark, d, "edges_semantic").select(*cols))
    return graph.neighbours(both, nodes(spark, d)).withColumnRenamed("_id", "node_id")


def semi_recent(spark, d):
    recent = R.scan(table(spark, d, "raw_sources"), "bwb", ["bwb-toestand-xml"], SINCE).select("external_id").distinct()
    return table(spark, d, "instruments").select("rec_id", F.col("props.bwb_id").alias("external_id")).join(recent, "external_id", "left_semi")


def citations_union(spark, d):
    cols = [F.col("_from").alias("source_id"), F.col("_to").alias("target_id"), F.col("meta.start_pos").alias("start"), F.col("meta.end_pos").alias("end"), F.col("meta.text").alias("text"), "confidence"]
    rows = table(spark, d, "edges_semantic").where("_to is not null")
    of = lambda rel: rows.where(F.col("relation") == rel).select(*cols)
    got = graph.merged_citations(of(graph.REFERS_TO_ARTICLE), of(graph.MENTIONS_ARTICLE))
    return got.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def law_versions_latest(spark, d):
    rows = table(spark, d, "toestanden").where("bwb_id is not null and locatie_toestand is not null")
    return versions.latest(rows, "rec_id").select("bwb_id", "rec_id")


def stream_counts(spark, d):
    """Records per day of fetching, counted by a stream over the landing files until it has read all of them."""
    schema = table(spark, d, "raw_sources").schema
    rows = ingest.landing(spark, f"{d}/raw_sources.parquet*", schema).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    at = f"{shared_dir(spark)}/stelwerk/counts_{uuid.uuid4().hex}"
    ingest.into_table(ingest.counts(rows), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{at}/table")
    return got.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source", "kind", "n")


def json_text_collect(spark, d):
    return table(spark, d, "procedures").select("rec_id", X.json_strings(F.col("props.raw")).alias("text"))


def _raw(spark, d):
    return table(spark, d, "raw_sources")


def normalize_laws(spark, d):
    return normalize.laws(_raw(spark, d))["instrument_articles"].select("_key", "props.bwb_id", "props.article_number", "props.text")


def normalize_law_edges(spark, d):
    return normalize.laws(_raw(spark, d))["edges_strict"].select("_key", "_from", "_to", "relation")


def normalize_judgments(spark, d):
    return normalize.judgments(_raw(spark, d), PROFILE)["judgments"].select("_key", F.concat_ws(",", "labels").alias("labels"), "props.ecli", "props.display_name")


def normalize_eu_acts(spark, d):
    return normalize.eu_acts(_raw(spark, d), PROFILE)["instruments"].select("_key", F.concat_ws(",", "labels").alias("labels"), "props.celex", "props.display_name")


def normalize_procedures(spark, d):
    return normalize.parliament(_raw(spark, d), PROFILE)["procedures"].select("_key", F.concat_ws(",", "labels").alias("labels"), "props.external_id", "props.display_name")


def normalize_publications(spark, d):
    return normalize.parliament(_raw(spark, d), PROFILE)["publications"].select("_key", F.concat_ws(",", "labels").alias("labels"), "props.external_id", "props.procedure_external_id", "props.display_name")


def topic_edges(spark, d):
    got = normalize.parliament(_raw(spark, d), PROFILE)["edges_semantic"].unionByName(normalize.judgments(_raw(spark, d), PROFILE)["edges_semantic"])
    return got.select("_key", "_from", "_to", "relation", "source")


def detect_law(spark, d):
    """Articles of its own law that each stored article names."""
    docs = table(spark, d, "instrument_articles").select("rec_id", F.col("props.text").alias("t"), F.col("props.bwb_id").alias("law"))
    got = D.detect_law(docs, "rec_id", "t", "law")
    return got.select(F.col("doc").alias("rec_id"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.lower("article_number").alias("article_number"), "confidence", "bwb_id")


def _detected(got):
    cols = [F.col("doc").alias("doc_id"), "kind", "celex", "bwb_id", "article_number", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "raw_match", "confidence"]
    return got.select(*cols)


def detect_eu(spark, d):
    rules = D.eu_rules(linkers.codes_of(PROFILE, D.CODES["eu"]))
    docs = table(spark, d, "edges_semantic").select("rec_id", F.concat_ws("; ", "meta.raw_match", "meta.snippet").alias("t"))
    return _detected(D.detect(docs, "rec_id", "t", rules, PROFILE["code_aliases"]))


def detect_judgment(spark, d):
    rules = D.judgment_rules(linkers.codes_of(PROFILE, D.CODES["judgment"]))
    return _detected(D.detect_judgment(table(spark, d, "documents"), "doc_id", "text", PROFILE["code_aliases"], rules))


def detect_parliament(spark, d):
    rules = D.parliament_rules(act_aliases(PROFILE), *(linkers.codes_of(PROFILE, D.CODES[c]) for c in ("parliament", "parliament_short")))
    return _detected(D.detect(table(spark, d, "documents"), "doc_id", "text", rules, PROFILE["code_aliases"]))


_EDGE = ("_key", "_from", "_to", "relation", "confidence", "source", "raw_match")


def link_laws(spark, d):
    return linkers.link_laws(_articles(spark, d), table(spark, d, "instrument_articles").select("_id")).select(*_EDGE)


def stored_citations(spark, d):
    return linkers.stored_citations(_articles(spark, d)).select(F.col("_id").alias("article_id"), F.size("citations").alias("n_citations"), F.to_json("citations").alias("citations"))


def link_eu(spark, d):
    acts = graph.current(table(spark, d, "instruments"), "labels", "struct(props.title, props.display_name, props.raw_html) as props")
    return linkers.link_eu(acts, nodes(spark, d), PROFILE).select(*_EDGE)


def link_judgments(spark, d):
    return linkers.link_judgments(normalize.judgments(_raw(spark, d), PROFILE)["judgments"], nodes(spark, d), PROFILE).select(*_EDGE)


def link_parliament(spark, d):
    docs = [graph.current(table(spark, d, t), "labels", "struct(props.title, props.raw) as props") for t in ("publications", "procedures")]
    return linkers.link_parliament(docs[0].unionByName(docs[1]), nodes(spark, d), PROFILE).select(*_EDGE)


def link_by_names(spark, d):
    """Publications, articles, EU pages and judgments to the articles they cite by an act's title or short title."""
    docs = [
        graph.current(table(spark, d, "publications"), "concat_ws(' ', props.title, get_json_object(props.raw, '$.Tekst')) as text"),
        graph.current(table(spark, d, "instrument_articles"), "props.text as text"),
        graph.current(table(spark, d, "instruments").where(F.array_contains("labels", "EU")), "props.raw_html as text").select("_id", X.strip_html(F.col("text")).alias("text")),
        normalize.judgments(_raw(spark, d), PROFILE)["judgments"].select("_id", X.strip_html(F.col("props.raw_xml")).alias("text")),
    ]
    for x in docs[1:]:
        docs[0] = docs[0].unionByName(x)
    names = linkers.act_names(table(spark, d, "instruments"))
    return linkers.link_by_names(docs[0], "text", names, table(spark, d, "instrument_articles").select("_id")).select(*_EDGE)


def node_payloads(spark, d):
    """Current instruments as served, without their pages."""
    acts = graph.current(table(spark, d, "instruments"), "type", "labels", "props")
    return serve.node_payload(acts, drop=("raw_html",)).withColumnRenamed("_id", "node_id")


def article_summaries(spark, d):
    return serve.summaries(graph.current(table(spark, d, "instrument_articles"), "props"), "instrument_articles")


def article_relations(spark, d):
    """Every current article with the summary of its instrument."""
    articles, acts = (graph.current(table(spark, d, t), "props") for t in ("instrument_articles", "instruments"))
    got = serve.article_relations(articles, table(spark, d, "edges_strict"), acts)
    return got.select("id", "key", "display_name", "bwb_id", "article_number", F.col("instrument.id").alias("instrument_id"), F.col("instrument.display_name").alias("instrument_name"))


def recent_eclis(spark, d):
    return linkers.recent_eclis(_raw(spark, d), SINCE)


def seed_nodes(spark, d):
    """Topic and instruments of the queries' profile, as the seed makes them."""
    made = engine.seed_rows(spark, PROFILE)
    cols = ["_id", "type", F.concat_ws(",", "labels").alias("labels"), F.col("props.display_name").alias("display_name")]
    return made["topics"].select(*cols).unionByName(made["instruments"].select(*cols))


def edge_confidences(spark, d):
    edges = table(spark, d, "edges_semantic")
    return edges.select("rec_id", serve.edge_confidence(edges).alias("confidence"))


_LIST = """raw_scan_kind_since raw_count_by_kind raw_split_by_kind raw_json_field raw_latest_per_key raw_first_per_key sources_in_order node_keys article_keys id_parts display_names
strip_html joined_text keyword_classifier multi_rule_classifier citation_scan citation_snippets citation_first_per_number citation_edge_lastwins overlap_antijoin citation_ranges celex_format
resolve_targets edge_build_strict edge_build_publications edge_insert_if_absent edge_upsert node_update upsert_merge_nodes seed_summary topic_or_lookup labels_contains instrument_topics mentions_of_article confident_edges
article_detail article_citations judgment_detail document_articles node_neighbors semi_recent citations_union law_versions_latest stream_counts json_text_collect normalize_laws normalize_law_edges normalize_judgments normalize_eu_acts
normalize_procedures normalize_publications topic_edges detect_law detect_eu detect_judgment detect_parliament link_laws stored_citations link_eu link_judgments link_parliament link_by_names node_payloads article_summaries article_relations recent_eclis seed_nodes edge_confidences"""
QUERIES = {name: globals()[name] for name in _LIST.split()}

_FILLED = "nullif(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"
_KEY = "coalesce(nullif(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_]+', '_', 'g'), '_{{2,}}', '_', 'g'), '_'), ''), 'node')"


def _current(table_: str, cols: str) -> str:
    return f"(SELECT * FROM (SELECT _id, deleted_at, {cols}, row_number() OVER (PARTITION BY _id ORDER BY ingested_at DESC, rec_id DESC) AS rn FROM {table_}) WHERE rn = 1 AND deleted_at IS NULL)"


_SHOWN = {"topics": "coalesce(props.name, props.slug, '')"}
_NODES = " UNION ALL ".join(f"SELECT _id, display_name FROM {_current(t, _SHOWN.get(t, 'coalesce(props.display_name, %s)' % (chr(39) * 2)) + ' AS display_name')}" for t in NODE_TABLES)


def _scan_sql(regex: str, where: str = "text IS NOT NULL", extra: str = "") -> str:
    return f"""
      parts AS (SELECT doc_id, {extra} text, regexp_split_to_array(regexp_replace(translate(text, chr(1) || chr(2), '  '), '{regex}', chr(1) || '\\0' || chr(2), 'g'), chr(1) || '|' || chr(2)) AS p FROM documents WHERE {where}),
      hits AS (SELECT * EXCLUDE (p, i), cast(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS INT) AS pos, p[i] AS raw_match
        FROM (SELECT *, unnest(generate_series(2, len(p) - 1, 2)) AS i FROM parts WHERE len(p) > 1))"""


_NUMBER = "lower(regexp_extract(raw_match, '[0-9]+[A-Za-z]?$'))"
_PART_OF = """
  part AS (SELECT _id, min(instrument_id) AS instrument_id FROM (
    SELECT _from AS _id, _to AS instrument_id FROM edges_strict WHERE relation = 'PART_OF_INSTRUMENT' AND starts_with(_from, 'instrument_articles/')
    UNION ALL SELECT _to, _from FROM edges_strict WHERE relation = 'PART_OF_INSTRUMENT' AND starts_with(_to, 'instrument_articles/')) GROUP BY _id)"""


def _name(kind: str, value: str) -> str:
    return f"SELECT '{kind}' AS node_table, rec_id, {value} AS shown FROM {kind}"


_T, _B, _C = (_FILLED.format(f"props.{c}") for c in ("title", "bwb_id", "celex"))

_WHITE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _re2(regex: str) -> str:
    """A detector's pattern for DuckDB: a word boundary at the start or end takes the character outside with it (the first and
    the last group)."""
    lead = regex.startswith(r"\b") or regex.startswith("(?<!")
    rest = regex.removeprefix(r"\b").removeprefix(r"(?<![\p{L}\p{N}_])").replace(r"(?![\p{L}\p{N}_])", r"\b")
    tail = rest.endswith(r"\b")
    rest = rest.removesuffix(r"\b") if tail else rest
    rest = rest.replace(r"\s", _WHITE).replace(r"\d", r"\p{Nd}").replace("'", "''")
    return f"(?i){'(^|[^\\pL\\pN_]|\\b)' if lead else '()'}({rest}){'($|[^\\pL\\pN_])' if tail else '()'}"


def _found(name: str, regex: str, source: str, key: str, text: str, keep: str = "") -> str:
    """CTEs ``name``: every match of a pattern with its position, over ``source`` (a table with key and text)."""
    return f"""
      {name}_p AS (SELECT {key}, {keep} {text} AS _t, regexp_split_to_array(regexp_replace(translate({text}, chr(1) || chr(2), '  '), '{_re2(regex)}', '\\1' || chr(1) || '\\2' || chr(2) || '\\{re.compile(regex.replace(chr(92) + "p", "x")).groups + 3}', 'g'), chr(1) || '|' || chr(2)) AS p FROM {source} WHERE {text} IS NOT NULL),
      {name} AS (SELECT * EXCLUDE (p, i), cast(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS INT) AS pos, p[i] AS raw_match FROM (SELECT *, unnest(generate_series(2, len(p) - 1, 2)) AS i FROM {name}_p WHERE len(p) > 1))"""


def _group(regex: str, n: int) -> str:
    return f"regexp_extract(raw_match, '{_re2(regex)}', {n + 2})"


_BARE = D.LAW_BLOCK[D.LAW_BLOCK.index(r"(\d+") :]
_OWN = f"""
  texts AS (SELECT rec_id, regexp_replace(props.text, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS t, props.bwb_id AS law FROM {{source}} WHERE props.bwb_id <> ''),
  {_found('block', D.LAW_BLOCK, 'texts', 'rec_id, law', 't')},
  blocks AS (SELECT rec_id, law, block, pos + length(raw_match) - length(block) AS base, cast(pos + length(raw_match) AS INT) AS until FROM (SELECT *, {_group(D.LAW_BLOCK, 1)} AS block FROM block)),
  {_found('number', '(' + D.LAW_NUMBER + ')', 'blocks', 'rec_id, law, base, until, block', 'block')},
  numbered AS (SELECT *, lead(raw_match) OVER w AS nxt, substr(block, pos + length(raw_match) + 1, lead(pos) OVER w - pos - length(raw_match)) AS between_ FROM number WINDOW w AS (PARTITION BY rec_id, law, base, until ORDER BY pos)),
  hits AS (
    SELECT rec_id, law, cast(base + pos AS INT) AS s, cast(base + pos + length(raw_match) AS INT) AS e, raw_match AS no, raw_match AS text, {D.NUMBER_CONFIDENCE}::DOUBLE AS c FROM numbered
    UNION ALL
    SELECT rec_id, law, cast(base AS INT), until, cast(unnest(generate_series(least(x, y) + 1, greatest(x, y) - 1)) AS VARCHAR), block, {D.RANGE_CONFIDENCE}::DOUBLE
    FROM (SELECT *, try_cast(regexp_extract(raw_match, '^[0-9]+') AS BIGINT) AS x, try_cast(regexp_extract(nxt, '^[0-9]+') AS BIGINT) AS y FROM numbered WHERE contains(lower(between_), 'tot')) WHERE abs(x - y) > 1),
  own AS (SELECT rec_id, s, e, lower(no) AS number, max(struct_pack(c := c, no := no, text := text, law := law)) AS b FROM hits GROUP BY rec_id, s, e, lower(no))"""


def _detected_sql(rules: list, codes: dict, bare: bool = False, source: str = "documents") -> str:
    """The hits of a detector's rules over all documents; of several of one target the first by rule, then position."""
    null = "cast(NULL AS VARCHAR)"
    look = "CASE upper({}) " + " ".join(f"WHEN '{k.strip().upper()}' THEN '{v}'" for k, v in codes.items()) + " END"
    ctes, parts, spans = [], [], []
    for i, r in enumerate(rules):
        ctes.append(_found(f"r{i}", r.regex, source, "doc_id", "text"))
        law = look.format(_group(r.regex, r.code)) if r.code else f"upper({_group(r.regex, r.law_id)})" if r.law_id else f"'{r.law}'" if r.law else null
        year, number = (_group(r.regex, g) for g in (r.year, r.number))
        act = f"upper({_group(r.regex, r.celex_id)})" if r.celex_id else f"printf('3%s{r.letter}%04d', {year}, coalesce(try_cast({number} AS BIGINT), 0))" if r.year else f"'{r.act}'" if r.act else null
        rows = f"SELECT doc_id, {i} AS seq, pos, raw_match, '{r.kind}' AS kind, {act} AS celex, {law} AS bwb_id, {_group(r.regex, r.article) if r.article else null} AS article_number, {r.confidence}::DOUBLE AS confidence FROM r{i}"
        parts.append(f"SELECT * FROM ({rows}) WHERE bwb_id IS NOT NULL" if r.code else rows)
    named = " UNION ALL ".join(parts)
    ctes.append(f"named AS ({named})")
    everything = "SELECT * FROM named"
    if bare:
        for i, r in enumerate(D.BARE_RULES):
            ctes.append(_found(f"b{i}", r.regex, source, "doc_id", "text"))
            everything += f" UNION ALL SELECT doc_id, {len(rules) + i}, pos, raw_match, '{r.kind}', NULL, NULL, {_group(r.regex, r.article)}, {r.confidence}::DOUBLE FROM b{i} b WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.doc_id = b.doc_id AND n.pos + length(n.raw_match) > b.pos AND n.pos < b.pos + length(b.raw_match))"
    return "WITH " + ", ".join(ctes) + f""", everything AS ({everything})
      SELECT doc_id, kind, celex, bwb_id, article_number, pos AS start_pos, cast(pos + length(raw_match) AS INT) AS end_pos, raw_match, confidence FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, kind, celex, bwb_id, article_number{', bwb_id IS NULL' if bare else ''} ORDER BY seq, pos) AS rn FROM everything) WHERE rn = 1"""


def _linked_sql(rules: list, texts: str, source: str) -> str:
    """The edges of a linker: hits in ``texts`` (a query of doc_id and text) whose target is a node, the last of each edge."""
    hits = _detected_sql(rules, PROFILE["code_aliases"], source=f"({texts})")
    at = hits.rindex("SELECT doc_id, kind,")
    key = lambda x: _KEY.format(x)
    return hits[:at].rstrip() + f""", nodes AS MATERIALIZED ({_NODES}),
      one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, celex, bwb_id, article_number ORDER BY seq, pos) AS rn FROM everything),
      met AS (SELECT doc_id, seq, pos, raw_match, confidence, CASE WHEN bwb_id <> '' AND article_number IS NOT NULL THEN 'instrument_articles/' || {key("bwb_id || '_' || translate(article_number, '０１２３４５６７８９', '0123456789')")}
        WHEN celex IS NOT NULL THEN 'instruments/' || {key('celex')} WHEN bwb_id <> '' THEN 'instruments/' || {key('bwb_id')} END AS t FROM one WHERE rn = 1),
      last AS (SELECT doc_id AS f, t, arg_max(struct_pack(c := confidence, m := raw_match), (seq, pos)) AS v FROM met SEMI JOIN nodes n ON n._id = met.t GROUP BY doc_id, t)
      SELECT {key("substr(f, strpos(f, '/') + 1)")} || '__' || {key("substr(t, strpos(t, '/') + 1)")} || '__MENTIONS_ARTICLE' AS _key, f AS _from, t AS _to, 'MENTIONS_ARTICLE' AS relation, v.c AS confidence, '{source}' AS source, v.m AS raw_match FROM last"""


def _codes_for(*names: str) -> list[list[str]]:
    return [linkers.codes_of(PROFILE, D.CODES[n]) for n in names]


SQL = {
    "raw_scan_kind_since": f"SELECT _key, kind, external_id FROM raw_sources WHERE source = 'tk' AND kind IN ('tk-zaak', 'tk-documentversie') AND fetched_at >= TIMESTAMP '{SINCE}'",
    "raw_count_by_kind": "SELECT source, kind, count(*) AS n, count(payload_json) AS n_json, count(payload_text) AS n_text FROM raw_sources GROUP BY source, kind",
    "raw_split_by_kind": "SELECT kind, _key FROM raw_sources WHERE kind IN ('rs-index', 'rs-content')",
    "raw_json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "raw_latest_per_key": "SELECT external_id, arg_max(_key, (fetched_at, _key)) AS raw_key FROM raw_sources WHERE external_id IS NOT NULL GROUP BY external_id",
    "raw_first_per_key": "SELECT external_id, arg_min(_key, (fetched_at, _key)) AS raw_key FROM raw_sources WHERE external_id IS NOT NULL GROUP BY external_id",
    "sources_in_order": "SELECT source, min(doc_id) AS first_doc_id FROM documents GROUP BY source",
    "node_keys": f"SELECT p_partkey, {_KEY.format(chr(39).join(['p_brand || ', '_', ' || p_name']))} AS node_key, 'instruments/' || {_KEY.format('p_type')} AS node_id FROM part",
    "id_parts": "SELECT rec_id, split_part(_to, '/', 1) AS collection, CASE WHEN contains(_to, '/') THEN substr(_to, strpos(_to, '/') + 1) END AS target_key FROM edges_semantic WHERE _to IS NOT NULL",
    "display_names": " UNION ALL ".join([
        _name("instruments", f"CASE WHEN {_T} IS NOT NULL AND coalesce({_B}, {_C}) IS NOT NULL THEN {_T} || ' (' || coalesce({_B}, {_C}) || ')' WHEN {_T} IS NOT NULL THEN {_T} WHEN {_B} IS NOT NULL THEN 'BWB ' || {_B} WHEN {_C} IS NOT NULL THEN 'EU ' || {_C} ELSE 'Instrument' END"),
        _name("instrument_articles", f"coalesce('Art. ' || {_FILLED.format('props.article_number')}, 'Artikel')"),
        _name("procedures", f"coalesce({_T}, 'Procedure ' || {_FILLED.format('props.external_id')}, 'Procedure')"),
        _name("publications", f"coalesce({_T}, 'Publicatie')"),
        _name("topics", f"coalesce({_FILLED.format('props.name')}, {_FILLED.format('props.slug')}, 'Topic')"),
    ]),
    "strip_html": "SELECT rec_id, cast(length(t) AS INT) AS n_chars, md5(t) AS text_md5 FROM (SELECT rec_id, trim(regexp_replace(regexp_replace(props.raw_html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM instruments WHERE props.raw_html IS NOT NULL)",
    "joined_text": f"SELECT rec_id, md5(nullif(concat_ws(chr(10), {_T}, {_FILLED.format('props.raw')}), '')) AS text_md5 FROM publications",
    "keyword_classifier": "SELECT doc_id, coalesce(" + " OR ".join(f"contains(lower(text), '{w}')" for w in KEYWORDS) + ", false) AS is_hit FROM documents",
    "multi_rule_classifier": "SELECT doc_id, doc_id IN (1, 2, 3) OR coalesce(starts_with(source, 'bron-q'), false) OR coalesce(contains(lower(text), 'onverminderd'), false) OR coalesce(lower(source) IN ('tk', 'commentaar'), false) OR coalesce(lower(doc_kind) IN ('tk', 'commentaar'), false) AS is_hit FROM documents",
    "citation_scan": f"WITH {_scan_sql(CITED)} SELECT doc_id, pos AS start_pos, cast(pos + length(raw_match) AS INT) AS end_pos, raw_match FROM hits",
    "citation_first_per_number": f"WITH {_scan_sql(CITED)} SELECT doc_id, {_NUMBER} AS number, min(pos) AS start_pos, arg_min(raw_match, pos) AS raw_match FROM hits GROUP BY doc_id, {_NUMBER}",
    "citation_edge_lastwins": f"WITH {_scan_sql(CITED, 'text IS NOT NULL AND bwb_id IS NOT NULL', 'bwb_id,')}, keyed AS (SELECT *, {_KEY.format('bwb_id')} || '__' || {_NUMBER} || '__REFERS_TO_ARTICLE' AS edge_key FROM hits) SELECT edge_key, arg_max(doc_id, (doc_id, pos)) AS doc_id, arg_max(pos, (doc_id, pos)) AS start_pos, arg_max(raw_match, (doc_id, pos)) AS raw_match FROM keyed GROUP BY edge_key",
    "overlap_antijoin": f"WITH {_scan_sql(CITED)}, {_scan_sql(CITED_IN_ACT).replace('parts', 'parts2').replace('hits', 'taken')} SELECT h.doc_id, h.pos AS start_pos, cast(h.pos + length(h.raw_match) AS INT) AS end_pos, h.raw_match FROM hits h WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = h.doc_id AND h.pos + length(h.raw_match) > t.pos AND h.pos < t.pos + length(t.raw_match))",
    "citation_ranges": "SELECT l_orderkey, count(*) AS n, cast(sum(number) AS BIGINT) AS total FROM (SELECT l_orderkey, unnest(generate_series(lo + 1, hi - 1)) AS number FROM (SELECT l_orderkey, least(l_linenumber, cast(l_quantity AS INT)) AS lo, greatest(l_linenumber, cast(l_quantity AS INT)) AS hi FROM lineitem) WHERE hi - lo > 1) GROUP BY l_orderkey",
    "celex_format": "SELECT o_orderkey, printf('3%s%s%04d', strftime(o_orderdate, '%Y'), CASE WHEN o_orderstatus = 'F' THEN 'L' ELSE 'R' END, o_orderkey) AS celex FROM orders",
    "resolve_targets": f"WITH {_scan_sql(CITED, 'text IS NOT NULL AND bwb_id IS NOT NULL', 'bwb_id,')}, keyed AS (SELECT DISTINCT doc_id, 'instrument_articles/' || {_KEY.format(chr(39).join(['bwb_id || ', '_', ' || ']) + _NUMBER)} AS target_id FROM hits) SELECT * FROM keyed WHERE target_id IN (SELECT _id FROM instrument_articles)",
    "edge_build_strict": f"SELECT substr(a._id, 21) || '__' || substr(i._id, 13) || '__PART_OF_INSTRUMENT' AS _key, a._id AS _from, i._id AS _to, 'PART_OF_INSTRUMENT' AS relation, true AS strict FROM {_current('instrument_articles', 'props.bwb_id AS bwb_id')} a JOIN {_current('instruments', 'props.bwb_id AS bwb_id')} i ON a.bwb_id = i.bwb_id",
    "edge_build_publications": f"SELECT substr(p._id, 14) || '__' || substr(q._id, 12) || '__PART_OF_PROCEDURE' AS _key, p._id AS _from, q._id AS _to, 'PART_OF_PROCEDURE' AS relation, true AS strict FROM {_current('publications', 'props.procedure_external_id AS ref')} p JOIN {_current('procedures', 'props.external_id AS ref')} q ON p.ref = q.ref",
    "edge_insert_if_absent": "SELECT DISTINCT _from, _to, relation FROM edges_semantic s WHERE _from IS NOT NULL AND _to IS NOT NULL AND relation IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges_strict t WHERE t._from = s._from AND t._to = s._to AND t.relation = s.relation)",
    "upsert_merge_nodes": f"""
      WITH o AS (SELECT _key, arg_max(props, (ingested_at, rec_id)) AS p FROM procedures WHERE ingested_at < TIMESTAMP '{SINCE}' GROUP BY _key),
      n AS (SELECT _key, arg_max(props, (ingested_at, rec_id)) AS p FROM procedures WHERE ingested_at >= TIMESTAMP '{SINCE}' GROUP BY _key)
      SELECT coalesce(n._key, o._key) AS _key, coalesce(n.p.external_id, o.p.external_id) AS external_id, coalesce(n.p.title, o.p.title) AS title, coalesce(n.p.display_name, o.p.display_name) AS display_name, n._key IS NOT NULL AND o._key IS NULL AS created
      FROM o FULL OUTER JOIN n ON o._key = n._key""",
    "seed_summary": f"SELECT count(*) FILTER (f >= TIMESTAMP '{SINCE}') AS n_created, count(*) FILTER (f < TIMESTAMP '{SINCE}' AND l >= TIMESTAMP '{SINCE}') AS n_updated FROM (SELECT min(ingested_at) AS f, max(ingested_at) AS l FROM procedures GROUP BY _key)",
    "topic_or_lookup": "SELECT _key, _id FROM topics WHERE props.id = 'topic:grondrecht' OR props.slug = 'grondrecht' ORDER BY _key LIMIT 1",
    "labels_contains": "SELECT rec_id, _key FROM instruments WHERE list_contains(labels, 'EU')",
    "instrument_topics": f"SELECT DISTINCT i._id, i.celex, e._to AS topic_id FROM {_current('instruments', 'props.celex AS celex')} i JOIN edges_semantic e ON e._from = i._id WHERE e.relation = 'RELATED_TOPIC' AND i.celex IS NOT NULL",
    "mentions_of_article": "SELECT DISTINCT _to AS article_id, _from AS source_id FROM edges_semantic WHERE relation = 'MENTIONS_ARTICLE' AND _to IS NOT NULL",
    "edge_confidences": "SELECT rec_id, confidence FROM edges_semantic",
    "confident_edges": "SELECT rec_id, _from, _to, confidence FROM edges_semantic WHERE confidence >= 0.8",
    "article_detail": f"""
      WITH nodes AS MATERIALIZED ({_NODES}), {_PART_OF},
      said AS (SELECT _id, count(*) AS n, count(*) FILTER (starts_with(s, 'judgments/')) AS j FROM (SELECT DISTINCT _to AS _id, _from AS s FROM edges_semantic WHERE relation = 'MENTIONS_ARTICLE' AND _to IS NOT NULL) GROUP BY _id),
      cited AS (SELECT _id, count(*) AS n FROM (SELECT DISTINCT e._from AS _id, e._to FROM edges_semantic e SEMI JOIN nodes n ON n._id = e._to WHERE e.relation = 'REFERS_TO_ARTICLE') GROUP BY _id)
      SELECT a._id AS article_id, a.display_name, p.instrument_id, n.display_name AS instrument_name, coalesce(s.n, 0) AS n_mentions, coalesce(s.j, 0) AS n_judgments, coalesce(c.n, 0) AS n_citations
      FROM {_current('instrument_articles', 'props.display_name AS display_name')} a LEFT JOIN part p ON a._id = p._id LEFT JOIN nodes n ON n._id = p.instrument_id LEFT JOIN said s ON s._id = a._id LEFT JOIN cited c ON c._id = a._id""",
    "document_articles": f"""
      WITH nodes AS ({_NODES}), {_PART_OF},
      met AS (SELECT DISTINCT e._from, e._to, n.display_name FROM edges_semantic e JOIN nodes n ON n._id = e._to WHERE e.relation = 'MENTIONS_ARTICLE' AND e._from IN (SELECT _id FROM {_current('publications', 'rec_id')}))
      SELECT m._from AS document_id, m._to AS article_id, m.display_name AS article_name, p.instrument_id, count(*) OVER (PARTITION BY m._from) AS article_count FROM met m LEFT JOIN part p ON p._id = m._to""",
    "node_neighbors": f"""
      WITH nodes AS ({_NODES}), e AS (SELECT _from, _to, relation, confidence, strict FROM edges_strict UNION ALL SELECT _from, _to, relation, confidence, strict FROM edges_semantic),
      w AS (SELECT _from AS node_id, _to AS neighbour_id, 'outbound' AS direction, relation, strict, confidence FROM e UNION ALL SELECT _to, _from, 'inbound', relation, strict, confidence FROM e)
      SELECT w.node_id, w.neighbour_id, n.display_name AS neighbour_name, w.relation, w.direction, w.strict, w.confidence FROM w JOIN nodes n ON n._id = w.neighbour_id WHERE w.node_id IS NOT NULL""",
    "semi_recent": f"SELECT rec_id, props.bwb_id AS external_id FROM instruments WHERE props.bwb_id IN (SELECT external_id FROM raw_sources WHERE source = 'bwb' AND kind = 'bwb-toestand-xml' AND fetched_at >= TIMESTAMP '{SINCE}')",
    "citations_union": """
      SELECT source_id, target_id, start_pos, end_pos, text, confidence FROM (
        SELECT _from AS source_id, _to AS target_id, meta.start_pos AS start_pos, meta.end_pos AS end_pos, meta.text AS text, confidence,
          row_number() OVER (PARTITION BY _from, _to, meta.start_pos, meta.end_pos, meta.text ORDER BY CASE relation WHEN 'REFERS_TO_ARTICLE' THEN 0 ELSE 1 END, coalesce(confidence, -1) DESC) AS rn
        FROM edges_semantic WHERE _to IS NOT NULL AND relation IN ('REFERS_TO_ARTICLE', 'MENTIONS_ARTICLE')) WHERE rn = 1""",
    "law_versions_latest": """
      SELECT bwb_id, rec_id FROM (SELECT bwb_id, rec_id, row_number() OVER (PARTITION BY bwb_id ORDER BY o DESC, CASE WHEN NOT o THEN coalesce(e, DATE '0001-01-01') END DESC, CASE WHEN NOT o THEN coalesce(s, DATE '0001-01-01') END DESC, rec_id) AS rn
        FROM (SELECT *, coalesce(geldigheidsperiode_einddatum = '9999-12-31', false) AS o,
          CASE WHEN regexp_full_match(geldigheidsperiode_einddatum, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(geldigheidsperiode_einddatum AS DATE) END AS e,
          CASE WHEN regexp_full_match(geldigheidsperiode_startdatum, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(geldigheidsperiode_startdatum AS DATE) END AS s
        FROM toestanden WHERE bwb_id IS NOT NULL AND locatie_toestand IS NOT NULL)) WHERE rn = 1""",
    "stream_counts": "SELECT strftime(fetched_at, '%Y-%m-%d') AS day, source, kind, count(*) AS n FROM raw_sources WHERE fetched_at IS NOT NULL GROUP BY ALL",
}
SQL["detect_law"] = f"WITH {_OWN.replace('{source}', 'instrument_articles')} SELECT rec_id, s AS start_pos, e AS end_pos, number AS article_number, b.c AS confidence, b.law AS bwb_id FROM own"
SQL["detect_eu"] = _detected_sql(D.eu_rules(*_codes_for("eu")), PROFILE["code_aliases"], source="(SELECT rec_id AS doc_id, concat_ws('; ', meta.raw_match, meta.snippet) AS text FROM edges_semantic)")
SQL["detect_judgment"] = _detected_sql(D.judgment_rules(*_codes_for("judgment")), PROFILE["code_aliases"], bare=True)
SQL["detect_parliament"] = _detected_sql([replace(r, regex=r.regex.replace(r"\Q", "").replace(r"\E", "")) for r in D.parliament_rules(act_aliases(PROFILE), *_codes_for("parliament", "parliament_short"))], PROFILE["code_aliases"])
_CURRENT_TEXTS = _current("instrument_articles", "props, rec_id AS r").replace("SELECT _id, deleted_at", "SELECT _id, rec_id, deleted_at")
_TARGET = "'instrument_articles/' || " + _KEY.format("b.law || '_' || translate(b.no, '０１２３４５６７８９', '0123456789')")
SQL["article_citations"] = f"""WITH {_OWN.replace('{source}', _CURRENT_TEXTS)}, ids AS (SELECT rec_id, _id FROM {_CURRENT_TEXTS}),
  nodes AS MATERIALIZED ({_NODES}),
  both_ AS (
    SELECT _from AS source_id, _to AS target_id, meta.start_pos AS start_pos, meta.end_pos AS end_pos, {_FILLED.format('meta.text')} AS text, confidence, 0 AS rank FROM edges_semantic WHERE relation = 'REFERS_TO_ARTICLE' AND _from IN (SELECT _id FROM ids)
    UNION ALL SELECT i._id, {_TARGET}, o.s, o.e, {_FILLED.format('b.text')}, b.c, 1 FROM own o JOIN ids i USING (rec_id)),
  one AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, start_pos, end_pos, text ORDER BY rank, coalesce(confidence, -1) DESC) AS rn FROM both_)
  SELECT o.source_id, o.target_id, n.display_name AS target_name, o.start_pos, o.end_pos, o.text, o.confidence FROM one o JOIN nodes n ON n._id = o.target_id WHERE rn = 1"""
SQL["link_laws"] = f"""WITH {_OWN.replace('{source}', _CURRENT_TEXTS)}, ids AS (SELECT rec_id, _id FROM {_CURRENT_TEXTS}),
  met AS (SELECT i._id AS f, {_TARGET} AS t, o.s, b.no AS no, b.c AS c, b.text AS m FROM own o JOIN ids i USING (rec_id) WHERE {_TARGET} IN (SELECT _id FROM instrument_articles)),
  last AS (SELECT f, t, arg_max(struct_pack(c := c, m := m), (s, no)) AS v FROM met GROUP BY f, t)
  SELECT substr(f, 21) || '__' || substr(t, 21) || '__REFERS_TO_ARTICLE' AS _key, f AS _from, t AS _to, 'REFERS_TO_ARTICLE' AS relation, v.c AS confidence, 'bwb-article-linker' AS source, v.m AS raw_match FROM last"""
_ENTRY = "struct_pack(start := o.s, \"end\" := o.e, text := b.text, target_bwb_id := b.law, target_article_number := b.no, confidence := b.c)"
SQL["stored_citations"] = f"""WITH {_OWN.replace('{source}', _CURRENT_TEXTS)},
  listed AS (SELECT rec_id, count(*) AS n, cast(to_json(list({_ENTRY} ORDER BY o.s, o.e, b.text, b.law, b.no)) AS VARCHAR) AS j FROM own o GROUP BY rec_id)
  SELECT i._id AS article_id, cast(coalesce(l.n, 0) AS INT) AS n_citations, coalesce(l.j, '[]') AS citations FROM {_CURRENT_TEXTS} i LEFT JOIN listed l USING (rec_id)"""
SQL["json_text_collect"] = f"""
  WITH atoms AS (SELECT p.rec_id, t.id, {_FILLED.format("t.atom ->> '$'").replace(chr(92) + 's', _WHITE)} AS v FROM procedures p, json_tree(CASE WHEN json_valid(p.props.raw) THEN p.props.raw END) t WHERE t.type = 'VARCHAR')
  SELECT p.rec_id, a.text FROM procedures p LEFT JOIN (SELECT rec_id, string_agg(v, chr(10) ORDER BY id) AS text FROM atoms WHERE v IS NOT NULL GROUP BY rec_id) a USING (rec_id)"""
_JUDGED = f"""judged AS (SELECT 'judgments/' || {_KEY.format('ecli')} AS _id, {_KEY.format('ecli')} AS _key, arg_max(ecli, (fetched_at, raw_key)) AS ecli, arg_max(hit, (fetched_at, raw_key)) AS hit FROM (
    SELECT nullif(coalesce(meta['ecli'], external_id), '') AS ecli, fetched_at, _key AS raw_key, coalesce({' OR '.join(f"starts_with(coalesce(meta['ecli'], external_id), '{p}')" for p in PROFILE['filters']['rechtspraak']['ecli_prefixes'])}, false)
      OR coalesce({' OR '.join(f"contains(lower(payload_text), '{w}')" for w in PROFILE['filters']['rechtspraak']['search_terms'])}, false) AS hit FROM raw_sources WHERE source = 'rechtspraak' AND kind = 'rs-content') WHERE ecli IS NOT NULL GROUP BY {_KEY.format('ecli')})"""
SQL["judgment_detail"] = f"""
  WITH {_JUDGED}, nodes AS MATERIALIZED ({_NODES}), {_PART_OF},
  met AS (SELECT DISTINCT e._from, e._to, n.display_name FROM edges_semantic e JOIN nodes n ON n._id = e._to WHERE e.relation = 'MENTIONS_ARTICLE' AND e._from IN (SELECT _id FROM judged))
  SELECT j.ecli, j._id AS judgment_id, m._to AS article_id, m.display_name AS article_name, p.instrument_id, count(m._to) OVER (PARTITION BY j.ecli) AS article_count FROM judged j LEFT JOIN met m ON m._from = j._id LEFT JOIN part p ON p._id = m._to"""
_LABEL = PROFILE["topic"]["slug"].capitalize()
SQL["normalize_judgments"] = f"WITH {_JUDGED} SELECT _key, CASE WHEN hit THEN 'Rechtspraak,{_LABEL}' ELSE 'Rechtspraak' END AS labels, ecli, ecli AS display_name FROM judged"
_PAGES = f"""pages AS (SELECT {_KEY.format('celex')} AS _key, arg_max(celex, (fetched_at, raw_key)) AS celex, arg_max(hit, (fetched_at, raw_key)) AS hit FROM (
  SELECT nullif(coalesce(meta['celex'], external_id), '') AS celex, fetched_at, _key AS raw_key, coalesce({' OR '.join(f"contains(lower(payload_text), '{w}')" for w in PROFILE['filters']['eurlex']['subject_keywords'])}, false) AS hit
  FROM raw_sources WHERE source = 'eurlex' AND kind = 'eu-celex-html') WHERE celex IS NOT NULL GROUP BY {_KEY.format('celex')})"""
SQL["normalize_eu_acts"] = f"WITH {_PAGES} SELECT _key, CASE WHEN hit THEN 'EU,{_LABEL}' ELSE 'EU' END AS labels, celex, 'EU ' || celex AS display_name FROM pages"


def _tk_sql(kind: str, ids: str, titles: str, more: str = "") -> str:
    """CTE ``tk_{kind}``: the last fetched record of each node of parliament, with its id, title and label."""
    text = lambda f: f"CASE WHEN json_valid(payload_json) THEN json_extract_string(payload_json, '$.{f}') END"
    filled = lambda names: "coalesce(" + ", ".join(_FILLED.format(text(f)) for f in names.split()) + ")"
    shown = "coalesce(" + ", ".join(f"nullif({text(f)}, '')" for f in titles.split()) + ")"
    rules = PROFILE["filters"]["tk"]
    hit = " OR ".join([f"coalesce(contains(lower({text(f)}), '{w}'), false)" for f in ("Titel", "ZaakTitel", "Omschrijving", "TitelMetBijlagen") for w in rules["title_contains"]] + [f"coalesce(contains(lower(payload_json), '{w}'), false)" for w in rules["dossier_keywords"]])
    ref = f", {filled(more)} AS ref" if more else ", cast(NULL AS VARCHAR) AS ref"
    own = f"SELECT {filled(ids)} AS external_id, {shown} AS title, {hit} AS hit{ref}, fetched_at, _key AS raw_key FROM raw_sources WHERE source = 'tk' AND kind = '{kind}' AND payload_json IS NOT NULL"
    keyed = f"SELECT {_KEY.format('external_id')} AS _key, * FROM ({own}) WHERE external_id IS NOT NULL"
    return f"tk_{kind[3:]} AS (SELECT _key, max_by(struct_pack(external_id := external_id, title := title, hit := hit, ref := ref), (fetched_at, raw_key)) AS v FROM ({keyed}) GROUP BY _key)"


_CASES, _VERSIONS = _tk_sql("tk-zaak", "Id ZaakId ZaakNummer", "Titel ZaakTitel Omschrijving"), _tk_sql("tk-documentversie", "Id DocumentVersieId", "Titel TitelMetBijlagen", "ZaakId ZaakNummer")
_TK = f"CASE WHEN v.hit THEN 'TK,{_LABEL}' ELSE 'TK' END AS labels, v.external_id AS external_id"
SQL["normalize_procedures"] = f"WITH {_CASES} SELECT _key, {_TK}, coalesce({_FILLED.format('v.title')}, 'Procedure ' || v.external_id) AS display_name FROM tk_zaak"
SQL["normalize_publications"] = f"WITH {_VERSIONS} SELECT _key, {_TK}, v.ref AS procedure_external_id, coalesce({_FILLED.format('v.title')}, 'Publicatie') AS display_name FROM tk_documentversie"
_TO_TOPIC = "SELECT _key || '__{topic}__RELATED_TOPIC' AS _key, '{c}/' || _key AS _from, 'topics/{topic}' AS _to, 'RELATED_TOPIC' AS relation, '{source}' AS source FROM {t} WHERE {hit}"
SQL["topic_edges"] = f"WITH {_CASES}, {_VERSIONS}, {_JUDGED} " + " UNION ALL ".join(
    _TO_TOPIC.format(topic=PROFILE["topic"]["slug"], c=c, t=t, source=src, hit=hit) for c, t, src, hit in (("procedures", "tk_zaak", "tk-normalize", "v.hit"), ("publications", "tk_documentversie", "tk-normalize", "v.hit"), ("judgments", "judged", "rechtspraak-normalize", "hit"))
)
_STRIPPED = lambda c: _FILLED.format(c).replace(chr(92) + "s", _WHITE)
_PAGE = "trim(regexp_replace(regexp_replace(props.raw_html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
SQL["link_eu"] = _linked_sql(D.eu_rules(*_codes_for("eu")), f"SELECT _id AS doc_id, nullif(concat_ws(chr(10), {_STRIPPED('props.title')}, {_STRIPPED('props.display_name')}, {_STRIPPED(_PAGE)}), '') AS text FROM {_current('instruments', 'labels, props')} WHERE list_contains(labels, 'EU')", "eu-article-linker")
_LAST_CONTENT = f"SELECT 'judgments/' || {_KEY.format('ecli')} AS doc_id, arg_max(struct_pack(t := payload_text), (fetched_at, raw_key)).t AS text FROM (SELECT nullif(coalesce(meta['ecli'], external_id), '') AS ecli, payload_text, fetched_at, _key AS raw_key FROM raw_sources WHERE source = 'rechtspraak' AND kind = 'rs-content') WHERE ecli IS NOT NULL GROUP BY {_KEY.format('ecli')}"
SQL["link_judgments"] = _linked_sql(D.judgment_rules(*_codes_for("judgment")), _LAST_CONTENT, "rechtspraak-article-linker")
_PAPERS = " UNION ALL ".join(f"SELECT _id, labels, props.title AS title, props.raw AS raw FROM {_current(t, 'labels, props')}" for t in ("publications", "procedures"))
_STRINGS = f"SELECT d._id, string_agg(v, chr(10) ORDER BY id) AS more FROM (SELECT d._id, t.id, {_STRIPPED("t.atom ->> '$'")} AS v FROM ({_PAPERS}) d, json_tree(CASE WHEN json_valid(d.raw) THEN d.raw END) t WHERE t.type = 'VARCHAR') d WHERE v IS NOT NULL GROUP BY d._id"
SQL["link_parliament"] = _linked_sql(
    [replace(r, regex=r.regex.replace(r"\Q", "").replace(r"\E", "")) for r in D.parliament_rules(act_aliases(PROFILE), *_codes_for("parliament", "parliament_short"))],
    f"SELECT d._id AS doc_id, nullif(concat_ws(chr(10), {_STRIPPED('d.title')}, m.more), '') AS text FROM ({_PAPERS}) d LEFT JOIN ({_STRINGS}) m ON m._id = d._id WHERE list_contains(d.labels, 'TK')", "tk-article-linker",
)


def _folded(c: str) -> str:
    """A text without anything that isn't ASCII after compatibility decomposition: single letters by one table made from the
    Unicode data, joined ones one by one, the rest dropped."""
    forms = {chr(x): unicodedata.normalize("NFKD", chr(x)).encode("ascii", "ignore").decode() for x in (*range(0x80, 0x2100), *range(0x2160, 0x2180), *range(0x3000, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))}
    one = {a: b for a, b in forms.items() if len(b) == 1}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    done = f"translate({c}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for a, b in forms.items():
        if len(b) > 1 and a in "ĲĳǱǲǳ½¼¾ﬀﬁﬂﬃﬄⅡⅢⅣⅥⅦⅧⅨⅪⅫⅱⅲⅳⅵⅶⅷⅸⅺⅻ…":
            done = f"replace({done}, {quoted(a)}, {quoted(b)})"
    return f"regexp_replace({done}, '[^\\x00-\\x7F]', '', 'g')"


_KEPT = lambda c: f"CASE WHEN regexp_matches({c}, '[^' || substr('{_WHITE}', 2)) THEN {c} END"
SQL["article_keys"] = f"SELECT rec_id, {_KEY.format(_folded('v'))} AS node_key FROM (SELECT rec_id, concat_ws('_', {_KEPT('props.bwb_id')}, {_KEPT('props.article_number')}) AS v FROM instrument_articles)"


def _object(fields: dict[str, str]) -> str:
    """A JSON object of the fields that aren't null, in their order."""
    parts = ", ".join(f"'\"{n}\":' || to_json({v})::VARCHAR" for n, v in fields.items())
    return "'{' || array_to_string(list_filter([" + parts + "], lambda x: x IS NOT NULL), ',') || '}'"


_ACT_PROPS = _object({n: f"CASE WHEN props.{n} IS NOT NULL THEN props.{n} END" for n in ("bwb_id", "celex", "title", "short_title", "jurisdiction", "lang", "display_name")})
SQL["node_payloads"] = "SELECT _id AS node_id, " + _object({"id": "_id", "key": "substr(_id, strpos(_id, '/') + 1)", "collection": "split_part(_id, '/', 1)", "type": "coalesce(type, '')", "display_name": "props.display_name", "labels": "labels", "props": f"nullif({_ACT_PROPS}, '{{}}')"}) + f" AS payload FROM {_current('instruments', 'type, labels, props')}"

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_PLAIN = "t"
for _a, _b in _ENTITIES.items():
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
#: A law's XML as a table of its tags and texts, and from that the table of its elements: level, first and last place.
_LAW_XML = rf"""
  laws AS (SELECT law, arg_max(xml, (fetched_at, k)) AS xml FROM (SELECT coalesce(nullif(meta['bwb_id'], ''), nullif(external_id, '')) AS law, payload_text AS xml, fetched_at, _key AS k FROM raw_sources WHERE source = 'bwb' AND kind = 'bwb-toestand-xml')
    WHERE law IS NOT NULL AND xml <> '' GROUP BY law),
  cut AS (SELECT law, regexp_extract_all(xml, '<[^>]*>|[^<]+') AS parts FROM laws),
  places AS (SELECT law, unnest(parts) AS t, unnest(generate_series(1, len(parts))) AS i FROM cut),
  tags AS (SELECT *, CASE WHEN t LIKE '</%' THEN -1 WHEN t LIKE '<?%' OR t LIKE '<!%' OR t NOT LIKE '<%' THEN 0 WHEN t LIKE '%/>' THEN 2 ELSE 1 END AS kind, regexp_extract(t, '^</?(?:[^\s:>/]+:)?([^\s>/]+)', 1) AS name FROM places),
  deep AS (SELECT *, sum(CASE WHEN kind IN (1, -1) THEN kind ELSE 0 END) OVER (PARTITION BY law ORDER BY i) AS depth FROM tags),
  ends AS (SELECT *, CASE kind WHEN 1 THEN depth ELSE depth + 1 END AS lvl FROM deep WHERE kind <> 0),
  closed AS (SELECT *, lead(i) OVER w AS til, lead(kind) OVER w AS nxt, lead(name) OVER w AS other FROM ends WHERE kind IN (1, -1) WINDOW w AS (PARTITION BY law, lvl ORDER BY i)),
  broken AS (SELECT law FROM deep GROUP BY law HAVING min(depth) < 0 OR arg_max(depth, i) <> 0 OR max(depth) = 0 UNION SELECT law FROM closed WHERE kind = 1 AND (nxt IS DISTINCT FROM -1 OR other <> name)
    UNION SELECT law FROM laws WHERE len(regexp_extract_all(xml, '&')) <> len(regexp_extract_all(xml, '&(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);'))),
  el AS MATERIALIZED (SELECT law, i, til, lvl, name, {_STRIPPED(r"regexp_extract(t, '\slabel\s*=\s*[" + '"' + "'']([^" + '"' + "'']*)', 1)")} AS label FROM closed WHERE kind = 1 UNION ALL SELECT law, i, i, lvl, name, NULL FROM ends WHERE kind = 2),
  told AS (SELECT e.law, e.i, {_STRIPPED("string_agg(" + _PLAIN + ", '' ORDER BY d.i)")} AS words FROM el e JOIN deep d ON d.law = e.law AND d.i > e.i AND d.i < e.til AND d.kind = 0 AND d.t NOT LIKE '<%' WHERE e.name IN ('al', 'nr', 'lidnr') GROUP BY e.law, e.i),
  art AS (SELECT * FROM el WHERE (name = 'artikel' OR lower(label) LIKE 'artikel%') AND law NOT IN (SELECT law FROM broken)),
  inner_ AS (SELECT a.law, a.i AS a, e.i, e.til, e.lvl, e.name, o.words FROM art a JOIN el e ON e.law = a.law AND e.i >= a.i AND e.i <= a.til LEFT JOIN told o ON o.law = e.law AND o.i = e.i),
  kop AS (SELECT law, a, min(i) AS i FROM inner_ WHERE name = 'kop' AND i > a GROUP BY law, a),
  nr AS (SELECT k.law, k.a, arg_min(x.words, x.i) AS no FROM kop k JOIN el e ON e.law = k.law AND e.i = k.i JOIN (SELECT l.law, l.i, o.words FROM el l LEFT JOIN told o ON o.law = l.law AND o.i = l.i WHERE l.name = 'nr') x ON x.law = e.law AND x.i > e.i AND x.i < e.til GROUP BY k.law, k.a),
  lid AS (SELECT p.law, p.a, p.i, string_agg(q.words, ' ' ORDER BY q.i) AS own FROM inner_ p JOIN inner_ q ON q.law = p.law AND q.a = p.a AND q.name = 'al' AND q.lvl = p.lvl + 1 AND q.i > p.i AND q.i < p.til WHERE p.name = 'lid' AND q.words IS NOT NULL GROUP BY p.law, p.a, p.i),
  no AS (SELECT p.law, p.a, p.i, arg_min(struct_pack(w := q.words), q.i).w AS no FROM inner_ p JOIN inner_ q ON q.law = p.law AND q.a = p.a AND q.name = 'lidnr' AND q.i > p.i AND q.i < p.til WHERE p.name = 'lid' GROUP BY p.law, p.a, p.i),
  bylid AS (SELECT l.law, l.a, string_agg(coalesce(n.no || '. ', '') || l.own, chr(10) ORDER BY l.i) AS text FROM lid l LEFT JOIN no n ON n.law = l.law AND n.a = l.a AND n.i = l.i GROUP BY l.law, l.a),
  byal AS (SELECT law, a, string_agg(words, chr(10) ORDER BY i) AS text FROM inner_ WHERE name = 'al' AND words IS NOT NULL GROUP BY law, a),
  found AS (SELECT a.law, a.i, coalesce(n.no, nullif(regexp_replace(CASE WHEN lower(a.label) LIKE 'artikel%' THEN a.label END, '(?i)^artikel[:.\s]*', ''), '')) AS number, coalesce(l.text, b.text) AS text
    FROM art a LEFT JOIN nr n ON n.law = a.law AND n.a = a.i LEFT JOIN bylid l ON l.law = a.law AND l.a = a.i LEFT JOIN byal b ON b.law = a.law AND b.a = a.i),
  articles AS (SELECT {_KEY.format(_folded("law || '_' || number"))} AS _key, arg_max(struct_pack(law := law, number := number, text := text), i) AS v FROM found WHERE number IS NOT NULL AND text IS NOT NULL GROUP BY 1)"""
SQL["normalize_laws"] = f"WITH {_LAW_XML} SELECT _key, v.law AS bwb_id, v.number AS article_number, v.text AS text FROM articles"
SQL["normalize_law_edges"] = f"WITH {_LAW_XML}, parts AS (SELECT _key, {_KEY.format(_folded('v.law'))} AS law FROM articles) SELECT _key || '__' || law || '__PART_OF_INSTRUMENT' AS _key, 'instrument_articles/' || _key AS _from, 'instruments/' || law AS _to, 'PART_OF_INSTRUMENT' AS relation FROM parts"
SQL["article_summaries"] = f"SELECT _id AS id, substr(_id, 21) AS key, props.display_name AS display_name, props.bwb_id AS bwb_id, props.article_number AS article_number, props.text AS text FROM {_current('instrument_articles', 'props')}"
SQL["article_relations"] = f"""
  WITH {_PART_OF}, acts AS (SELECT _id, props.display_name AS n FROM {_current('instruments', 'props')})
  SELECT a._id AS id, substr(a._id, 21) AS key, a.props.display_name AS display_name, a.props.bwb_id AS bwb_id, a.props.article_number AS article_number, i._id AS instrument_id, i.n AS instrument_name
  FROM {_current('instrument_articles', 'props')} a LEFT JOIN part p ON p._id = a._id LEFT JOIN acts i ON i._id = p.instrument_id"""
SQL["recent_eclis"] = f"SELECT DISTINCT meta['ecli'] AS ecli FROM raw_sources WHERE source = 'rechtspraak' AND kind = 'rs-content' AND fetched_at >= TIMESTAMP '{SINCE}' AND meta['ecli'] IS NOT NULL"
SQL["seed_nodes"] = """SELECT * FROM (VALUES
  ('topics/handhavingsrecht', 'topic', 'Domain', 'handhavingsrecht'), ('instruments/bwbr0990001', 'instrument', 'Handhavingsrecht', 'Visserijwet binnenwater (BWBR0990001)'),
  ('instruments/voorbeeld_b', 'instrument', 'Handhavingsrecht', 'Zonder nummer'), ('instruments/39990r0001', 'instrument', 'Handhavingsrecht', 'EU 39990R0001')) AS t(_id, type, labels, display_name)"""
SQL["edge_upsert"] = f"""
  WITH o AS (SELECT _key, arg_max(struct_pack(f := _from, t := _to, r := relation, c := confidence, s := source), (created_at, rec_id)) AS v FROM edges_semantic WHERE created_at < TIMESTAMP '{SINCE}' AND _key IS NOT NULL GROUP BY _key),
  n AS (SELECT _key, arg_max(struct_pack(f := _from, t := _to, r := relation, c := confidence, s := source), (created_at, rec_id)) AS v FROM edges_semantic WHERE created_at >= TIMESTAMP '{SINCE}' AND _key IS NOT NULL GROUP BY _key),
  b AS (SELECT coalesce(n._key, o._key) AS _key, CASE WHEN n._key IS NULL THEN o.v ELSE n.v END AS v, o._key IS NULL AS created FROM o FULL OUTER JOIN n ON o._key = n._key)
  SELECT _key, v.f AS _from, v.t AS _to, v.r AS relation, v.c AS confidence, v.s AS source, created FROM b"""
SQL["node_update"] = f"""
  WITH o AS (SELECT _key, arg_max(props, (ingested_at, rec_id)) AS p FROM publications WHERE ingested_at < TIMESTAMP '{SINCE}' GROUP BY _key),
  n AS (SELECT _key, arg_max(props, (ingested_at, rec_id)) AS p FROM publications WHERE ingested_at >= TIMESTAMP '{SINCE}' GROUP BY _key)
  SELECT o._key, coalesce(n.p.title, o.p.title) AS title, coalesce(n.p.procedure_external_id, o.p.procedure_external_id) AS procedure_external_id, n._key IS NOT NULL AS updated FROM o LEFT JOIN n ON o._key = n._key"""
SQL["citation_snippets"] = f"WITH {_scan_sql(CITED)} SELECT doc_id, pos AS start_pos, regexp_replace(substr(text, greatest(pos - 40, 0) + 1, least(length(text), pos + length(raw_match) + 40) - greatest(pos - 40, 0)), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS snippet FROM hits"


def _words(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^\\pL\\pN]+', ' ', 'g'))"


_NO_TAGS = lambda c: f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_CITED_RE = linkers._CITED
_NAMED_DOCS = f"""
  docs AS (
    SELECT _id AS doc_id, concat_ws(' ', props.title, CASE WHEN json_valid(props.raw) THEN json_extract_string(props.raw, '$.Tekst') END) AS text FROM {_current('publications', 'props')}
    UNION ALL SELECT _id, props.text FROM {_current('instrument_articles', 'props')}
    UNION ALL SELECT _id, {_NO_TAGS('props.raw_html')} FROM {_current('instruments', 'labels, props')} WHERE list_contains(labels, 'EU')
    UNION ALL SELECT doc_id, {_NO_TAGS('text')} FROM ({_LAST_CONTENT}))"""
SQL["link_by_names"] = f"""
  WITH {_NAMED_DOCS}, {_found('hit', _CITED_RE, 'docs', 'doc_id', 'text')},
  named AS (SELECT name, min(bwb_id) AS bwb_id FROM (SELECT props.bwb_id AS bwb_id, {_words('unnest([props.title, props.short_title])')} AS name FROM instruments WHERE props.bwb_id IS NOT NULL) WHERE name <> '' GROUP BY name HAVING min(bwb_id) = max(bwb_id)),
  behind AS (SELECT doc_id, pos, raw_match, {_group(_CITED_RE, 1)} AS no, substr(_t, pos + length(raw_match) + 1) AS after FROM hit),
  led AS (SELECT *, regexp_extract(after, '(?i)^{_WHITE}+(?:(?:van|of|de|der){_WHITE}+)?(?:(?:de|het|the){_WHITE}+)?') AS lead FROM behind),
  told AS (SELECT doc_id, pos, raw_match, no, string_split({_words(f"regexp_split_to_array(substr(after, length(lead) + 1), '[.!?:]{_WHITE}|[;' || chr(10) || ']')[1]")}, ' ') AS w FROM led WHERE lead <> ''),
  tries AS (SELECT doc_id, pos, raw_match, no, w, unnest(generate_series(1, least(len(w), (SELECT max(len(string_split(name, ' '))) FROM named)))) AS n FROM told),
  best AS (SELECT doc_id, pos, raw_match, no, arg_max(m.bwb_id, n) AS bwb_id FROM tries t JOIN named m ON m.name = array_to_string(w[1:n], ' ') GROUP BY ALL),
  met AS (SELECT doc_id AS f, 'instrument_articles/' || {_KEY.format("bwb_id || '_' || translate(no, '０１２３４５６７８９', '0123456789')")} AS t, pos, raw_match FROM best),
  last AS (SELECT f, t, arg_max(raw_match, (pos, raw_match)) AS m FROM met WHERE t IN (SELECT _id FROM instrument_articles) GROUP BY f, t)
  SELECT {_KEY.format("substr(f, strpos(f, '/') + 1)")} || '__' || {_KEY.format("substr(t, strpos(t, '/') + 1)")} || '__MENTIONS_ARTICLE' AS _key, f AS _from, t AS _to, 'MENTIONS_ARTICLE' AS relation, 0.95::DOUBLE AS confidence, 'name-linker' AS source, m AS raw_match FROM last"""
