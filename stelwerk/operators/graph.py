"""Nodes, edges and the one-hop questions asked of them, for many keys at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelwerk.functions import keys as K
from stelwerk.functions import text as X
from stelwerk.operators.merge import first_per_key, last_per_key

COLLECTIONS = ("instruments", "instrument_articles", "procedures", "publications", "judgments", "topics")
PART_OF_INSTRUMENT, PART_OF_PROCEDURE, RELATED_TOPIC = "PART_OF_INSTRUMENT", "PART_OF_PROCEDURE", "RELATED_TOPIC"
MENTIONS_ARTICLE, REFERS_TO_ARTICLE = "MENTIONS_ARTICLE", "REFERS_TO_ARTICLE"


def checked_collection(name: str) -> str:
    if name not in COLLECTIONS:
        raise ValueError(f"unsupported collection {name!r}")
    return name


def current(nodes: DataFrame, *columns: str) -> DataFrame:
    """The stored-last version of each ``_id`` that isn't deleted, with the given columns (expressions)."""
    rows = nodes.select("_id", "ingested_at", "rec_id", "deleted_at", *[F.expr(c) for c in columns])
    return last_per_key(rows, ["_id"], ["ingested_at", "rec_id"]).where("deleted_at is null").drop("ingested_at", "rec_id", "deleted_at")


def node_view(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``_id, collection, type, display_name`` of the current nodes of all tables. Only these columns are read;
    a table without display names shows its names or slugs."""
    def shown(df: DataFrame) -> str:
        have = df.schema["props"].dataType.fieldNames()
        return "coalesce(" + ", ".join(f"props.{c}" for c in ("display_name", "name", "slug") if c in have) + ", '') as display_name"

    views = [current(df, "type", shown(df)).select("_id", F.lit(name).alias("collection"), F.coalesce("type", F.lit("")).alias("type"), "display_name") for name, df in tables.items()]
    for v in views[1:]:
        views[0] = views[0].unionByName(v)
    return views[0]


def edges(pairs: DataFrame, from_: Column, to: Column, relation: str, strict: bool, source: str | None = None, confidence: Column | None = None) -> DataFrame:
    """Edge rows with deterministic keys from rows that hold both ends; rows without an end go."""
    rows = pairs.select(from_.alias("_from"), to.alias("_to"), (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"))
    rows = rows.where("_from is not null and _to is not null")
    key = K.edge_key(K.id_key(F.col("_from")), K.id_key(F.col("_to")), relation)
    return rows.select(key.alias("_key"), "_from", "_to", F.lit(relation).alias("relation"), "confidence", F.lit(source).cast("string").alias("source"), F.lit(strict).alias("strict"))


def neighbours(edges_: DataFrame, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``_id, neighbour_id, neighbour_name, relation, direction, strict, confidence`` over the edges at a node, both ways.
    ``of``: the nodes asked for (``_id``), else every end of an edge. The other end must be a node. An edge to itself shows in both ways."""
    cols = ["relation", "strict", "confidence"]
    both = edges_.select(F.col("_from").alias("_id"), F.col("_to").alias("other"), F.lit("outbound").alias("direction"), *cols).unionByName(edges_.select(F.col("_to").alias("_id"), F.col("_from").alias("other"), F.lit("inbound").alias("direction"), *cols)).where("_id is not null and other is not null")
    if of is not None:
        both = both.join(of.select("_id").distinct(), "_id", "left_semi")
    named = nodes.select(F.col("_id").alias("other"), F.col("display_name").alias("neighbour_name"))
    return both.join(named, "other").select("_id", F.col("other").alias("neighbour_id"), "neighbour_name", "relation", "direction", "strict", "confidence")


def part_of(strict: DataFrame) -> DataFrame:
    """``_id, instrument_id``: the instrument of each article that is part of one, whichever way the edge runs; the least id
    of several."""
    part = strict.where(F.col("relation") == PART_OF_INSTRUMENT)
    ends = F.array(F.struct(F.col("_from").alias("_id"), F.col("_to").alias("instrument_id")), F.struct(F.col("_to").alias("_id"), F.col("_from").alias("instrument_id")))
    ways = part.select(F.inline(F.filter(ends, lambda w: F.startswith(w["_id"], F.lit("instrument_articles/")))))
    return ways.groupBy("_id").agg(F.min("instrument_id").alias("instrument_id"))


def instrument_of(articles: DataFrame, strict: DataFrame) -> DataFrame:
    """``_id, instrument_id``: the instrument an article is part of (part_of), null if there is none."""
    return articles.select("_id").join(part_of(strict), "_id", "left")


def find_topic(topics: DataFrame, id_: str | None, slug: str | None) -> DataFrame:
    """The topic with this id or this slug; of several the one with the least key."""
    return topics.where((F.col("props.id") == id_) | (F.col("props.slug") == slug)).orderBy("_key").limit(1)


def find_instrument(instruments: DataFrame, config_id: str) -> DataFrame:
    """The instrument of a profile's entry; of several the one with the least key."""
    return instruments.where(F.col("props.config_id") == config_id).orderBy("_key").limit(1)


def find_judgments(judgments: DataFrame, asked: DataFrame) -> DataFrame:
    """``ecli, _id``: for each ECLI asked for the judgment with its key, else the one with that ECLI (the least id)."""
    want = asked.select("ecli").where("ecli is not null").distinct().withColumn("_k", K.node_key(F.col("ecli")))
    by_key = want.join(judgments.select(F.col("_key").alias("_k"), F.col("_id").alias("by_key")).distinct(), "_k", "left")
    by_ecli = judgments.where("props.ecli is not null").groupBy(F.col("props.ecli").alias("ecli")).agg(F.min("_id").alias("by_ecli"))
    return by_key.join(by_ecli, "ecli", "left").select("ecli", F.coalesce("by_key", "by_ecli").alias("_id")).where("_id is not null")


def with_key(nodes: DataFrame, collection: str, key: Column) -> DataFrame:
    """The nodes under another key; rows whose key is null or empty go."""
    named = nodes.withColumns({"_key": F.nullif(key, F.lit("")), "_id": K.node_id(collection, F.nullif(key, F.lit("")))})
    return named.where("_key is not null")


def edge_citations(semantic: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source_id, target_id, start, end, text, confidence`` of the edges by which articles refer to others. The target must
    be a node; the span is the edge's own, its text stripped."""
    meta = semantic.schema["meta"].dataType.fieldNames() if "meta" in semantic.columns else []
    span = lambda *names: F.coalesce(*[F.col(f"meta.{n}").try_cast("bigint") for n in names if n in meta], F.lit(None).cast("bigint"))
    text = X.filled(F.col("meta.text")) if "text" in meta else F.lit(None).cast("string")
    rows = semantic.where((F.col("relation") == REFERS_TO_ARTICLE) & F.col("_from").isNotNull())
    rows = rows.select(F.col("_from").alias("source_id"), F.col("_to").alias("target_id"), span("start_pos", "start").alias("start"), span("end_pos", "end").alias("end"), text.alias("text"), F.col("confidence").try_cast("double").alias("confidence"))
    return rows.join(nodes.select(F.col("_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id", "start", "end", "text", "confidence")


def embedded_citations(articles: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same of the citations that articles hold themselves (``_id, citations``). An entry needs a law and a number, and
    the article these make must be a node."""
    rows = articles.select(F.col("_id").alias("source_id"), F.explode("citations").alias("c"))
    rows = rows.where((X.filled(F.col("c.target_bwb_id")).isNotNull()) & (X.filled(F.col("c.target_article_number")).isNotNull()))
    target = K.node_id("instrument_articles", K.node_key(F.col("c.target_bwb_id"), F.col("c.target_article_number")))
    rows = rows.select("source_id", target.alias("target_id"), F.col("c.start").cast("bigint").alias("start"), F.col("c.end").cast("bigint").alias("end"), X.filled(F.col("c.text")).alias("text"), F.col("c.confidence").cast("double").alias("confidence"))
    return rows.join(nodes.select(F.col("_id").alias("target_id")).distinct(), "target_id", "left_semi").select("source_id", "target_id", "start", "end", "text", "confidence")


def article_citations(articles: DataFrame, semantic: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source_id, target_id, target_name, start, end, text, confidence``: what each article (``_id, citations``) refers to,
    by its edges and by its own citations, each span once (merged_citations)."""
    own = edge_citations(semantic, nodes).join(articles.select(F.col("_id").alias("source_id")), "source_id", "left_semi")
    both = merged_citations(own, embedded_citations(articles, nodes))
    return both.join(nodes.select(F.col("_id").alias("target_id"), F.col("display_name").alias("target_name")), "target_id").select("source_id", "target_id", "target_name", "start", "end", "text", "confidence")


def judgment_detail(asked: DataFrame, judgments: DataFrame, strict: DataFrame, semantic: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ecli, judgment_id, article_id, article_name, instrument_id, article_count``: the articles each judgment asked for
    mentions, with their instruments. A judgment without any has one row with a count of 0; one there is not has none."""
    found = find_judgments(judgments, asked)
    met = document_articles(found.select("_id").distinct(), strict, semantic, nodes)
    rows = found.join(met, "_id", "left")
    return rows.select("ecli", F.col("_id").alias("judgment_id"), "article_id", "article_name", "instrument_id", F.coalesce("article_count", F.lit(0)).cast("bigint").alias("article_count"))


def mentions(semantic: DataFrame, relation: str = MENTIONS_ARTICLE) -> DataFrame:
    """``_id, source_id``: who mentions a node, distinct."""
    return semantic.where((F.col("relation") == relation) & F.col("_to").isNotNull()).select(F.col("_to").alias("_id"), F.col("_from").alias("source_id")).distinct()


def article_detail(articles: DataFrame, strict: DataFrame, semantic: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per article (``_id, display_name``): its instrument with name, documents that mention it, articles it refers to."""
    by = mentions(semantic).groupBy("_id").agg(F.count("*").alias("n_mentions"), F.count_if(F.startswith("source_id", F.lit("judgments/"))).alias("n_judgments"))
    refers = semantic.where(F.col("relation") == REFERS_TO_ARTICLE).select(F.col("_from").alias("_id"), "_to").join(nodes.select(F.col("_id").alias("_to")), "_to", "left_semi").distinct()
    cited = refers.groupBy("_id").agg(F.count("*").alias("n_citations"))
    acts = nodes.where("collection = 'instruments'") if "collection" in nodes.columns else nodes  # the other tables aren't read for names
    names = acts.select(F.col("_id").alias("instrument_id"), F.col("display_name").alias("instrument_name"))
    rows = articles.join(part_of(strict), "_id", "left").join(names, "instrument_id", "left").join(by, "_id", "left").join(cited, "_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("_id", "display_name", "instrument_id", "instrument_name", zero("n_mentions"), zero("n_judgments"), zero("n_citations"))


def document_articles(documents: DataFrame, strict: DataFrame, semantic: DataFrame, nodes: DataFrame, relation: str = MENTIONS_ARTICLE) -> DataFrame:
    """Per document (``_id``) and article it mentions: the article's name and instrument; the document's article count."""
    said = semantic.where(F.col("relation") == relation).select("_from", "_to").distinct().withColumnRenamed("_from", "_id").join(documents.select("_id"), "_id", "left_semi")
    met = said.join(nodes.select(F.col("_id").alias("_to"), F.col("display_name").alias("article_name")), "_to")
    home = part_of(strict).withColumnRenamed("_id", "_to")
    counts = met.groupBy("_id").agg(F.count("*").alias("article_count"))
    return met.join(home, "_to", "left").join(counts, "_id").select("_id", F.col("_to").alias("article_id"), "article_name", "instrument_id", "article_count")


def merged_citations(from_edges: DataFrame, embedded: DataFrame) -> DataFrame:
    """Union of citations from edges and from the article itself (both ``source_id, target_id, start, end, text, confidence``):
    of those equal in all but the confidence the edge's counts, then the greater confidence."""
    both = from_edges.withColumn("_rank", F.lit(0)).unionByName(embedded.withColumn("_rank", F.lit(1)))
    both = both.withColumn("_less", -F.coalesce("confidence", F.lit(-1.0)))
    return first_per_key(both, ["source_id", "target_id", "start", "end", "text"], ["_rank", "_less"]).drop("_rank", "_less")


def resolve(hits: DataFrame, nodes: DataFrame, articles_by_celex: bool = False) -> DataFrame:
    """Adds ``target_id`` to hits (kind, celex, bwb_id, article_number): an article if law and number are known, else the
    instrument by CELEX id, else by law id. Hits whose target is no node go. One join, on the derived id."""
    article = F.col("bwb_id").isNotNull() & (F.col("bwb_id") != "") & F.col("article_number").isNotNull()
    known = F.when(article, K.node_id("instrument_articles", K.node_key(F.col("bwb_id"), F.col("article_number"))))
    known = known.when(F.col("celex").isNotNull(), K.node_id("instruments", K.node_key(F.col("celex"))))
    known = known.when(F.col("bwb_id") != "", K.node_id("instruments", K.node_key(F.col("bwb_id"))))
    return hits.withColumn("target_id", known).where("target_id is not null").join(nodes.select(F.col("_id").alias("target_id")).distinct(), "target_id", "left_semi")


def semantic_edges(hits: DataFrame, relation: str, source: str, order: Sequence[str] = ("seq", "start")) -> DataFrame:
    """Edges of resolved hits (``doc`` is the source's id): the last hit in the order of the rules wins for each edge."""
    key = K.edge_key(K.id_key(F.col("doc")), K.id_key(F.col("target_id")), relation)
    rows = hits.select(key.alias("_key"), F.col("doc").alias("_from"), F.col("target_id").alias("_to"), *[c for c in hits.columns if c not in ("doc", "target_id")])
    last = last_per_key(rows, ["_key", "_from", "_to"], list(order))
    return last.select("_key", "_from", "_to", F.lit(relation).alias("relation"), "confidence", F.lit(source).alias("source"), F.lit(False).alias("strict"), "raw_match", "snippet")
