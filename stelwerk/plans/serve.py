"""Answers as JSON documents, one per key asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stelwerk.functions import keys as K
from stelwerk.functions import text as X
from stelwerk.operators import graph


def node_payload(nodes: DataFrame, drop: tuple[str, ...] = ("raw_xml",)) -> DataFrame:
    """``_id, payload``: id, key, collection, type, display name, labels and props (null if they are empty) as JSON, without
    the props in ``drop``; an unknown type is empty."""
    have = nodes.schema["props"].dataType.fieldNames()
    kept = [F.col(f"props.{c}").alias(c) for c in have if c not in drop]
    shown = F.col("props.display_name") if "display_name" in have else F.lit(None).cast("string")
    props = F.nullif(F.to_json(F.struct(*kept)), F.lit("{}")) if kept else F.lit(None).cast("string")
    fields = F.struct(F.col("_id").alias("id"), K.id_key(F.col("_id")).alias("key"), K.id_collection(F.col("_id")).alias("collection"), F.coalesce("type", F.lit("")).alias("type"), shown.alias("display_name"), F.col("labels").alias("labels"), props.alias("props"))
    return nodes.select("_id", F.to_json(fields).alias("payload"))


#: The props a summary of each collection shows, besides id, key and display name.
SUMMARIES = {"instruments": (), "instrument_articles": ("bwb_id", "article_number", "text"), "judgments": ("ecli",)}


def summaries(nodes: DataFrame, collection: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``id, key, display_name`` and the collection's SUMMARIES, null where a node has no such prop; without those in ``drop``
    (a citation's target is an article without its text)."""
    have = nodes.schema["props"].dataType.fieldNames()
    get = lambda n: (F.col(f"props.{n}") if n in have else F.lit(None).cast("string")).alias(n)
    return nodes.select(F.col("_id").alias("id"), K.id_key(F.col("_id")).alias("key"), get("display_name"), *[get(n) for n in SUMMARIES[collection] if n not in drop])


def article_relations(articles: DataFrame, strict: DataFrame, instruments: DataFrame) -> DataFrame:
    """Summaries of articles without their text, each with ``instrument``: the summary of the one it is part of, or null."""
    own = summaries(articles, "instrument_articles", drop=("text",))
    acts = summaries(instruments, "instruments").select(F.col("id").alias("instrument_id"), F.struct("id", "key", "display_name").alias("instrument"))
    home = graph.part_of(strict).withColumnRenamed("_id", "id").join(acts, "instrument_id").select("id", "instrument")
    return own.join(home, "id", "left")


def judgment_summary(nodes: DataFrame) -> DataFrame:
    """``_id, ecli, summary``: the summary, else the profile a judgment was taken up for."""
    have = nodes.schema["props"].dataType.fieldNames()
    get = lambda n: F.col(f"props.{n}") if n in have else F.lit(None).cast("string")
    return nodes.select("_id", get("ecli").alias("ecli"), X.first_truthy(get("summary"), get("strafrecht_profile")).alias("summary"))


def edge_confidence(edges: DataFrame) -> Column:
    """The confidence of an edge, else the one in its meta."""
    meta = edges.schema["meta"].dataType.fieldNames() if "meta" in edges.columns else []
    return F.coalesce(F.col("confidence").try_cast("double"), F.col("meta.confidence").try_cast("double") if "confidence" in meta else F.lit(None).cast("double"))


def neighbourhood(nodes: DataFrame, strict: DataFrame, semantic: DataFrame, view: DataFrame) -> DataFrame:
    """``_id, n_strict, n_semantic, neighbours``: the neighbours of the nodes asked for, as a JSON list in a fixed order.
    A node's list is one value, so ask for nodes by name, not for all of a graph with very frequent ones."""
    cols = ["_from", "_to", "relation", "strict", "confidence"]
    both = strict.select(*cols).unionByName(semantic.select(*cols))
    near = graph.neighbours(both, view, nodes)
    entry = F.struct("direction", "relation", "neighbour_id", "neighbour_name", "strict", "confidence")
    got = near.groupBy("_id").agg(F.count_if("strict").alias("n_strict"), F.count_if(~F.col("strict")).alias("n_semantic"), F.to_json(F.array_sort(F.collect_list(entry))).alias("neighbours"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("_id").join(got, "_id", "left").select("_id", zero("n_strict"), zero("n_semantic"), F.coalesce("neighbours", F.lit("[]")).alias("neighbours"))


def article_document(asked: DataFrame, articles: DataFrame, strict: DataFrame, semantic: DataFrame, nodes: DataFrame, citations: DataFrame) -> DataFrame:
    """``_id, payload``: for each article asked for (``_id``) one JSON document with its name and instrument, the documents that
    mention it, its citations in order, and their counts. Articles there are not have none. An article's lists are one
    value, so ask for articles by name. ``citations``: graph.article_citations."""
    own = articles.join(asked.select("_id").distinct(), "_id", "left_semi")
    names = nodes.select(F.col("_id").alias("source_id"), F.col("display_name").alias("name"))
    listed = lambda df, key, name, *cols: df.groupBy(F.col(key).alias("_id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    said = graph.mentions(semantic).join(own.select("_id"), "_id", "left_semi").join(names, "source_id")
    said = listed(said, "_id", "mentioned_by", F.col("source_id").alias("id"), "name")
    cited = listed(citations.join(own.select(F.col("_id").alias("source_id")), "source_id", "left_semi"), "source_id", "citations", "start", "end", F.col("target_id").alias("target"), "target_name", "text", "confidence")
    home = graph.instrument_of(own, strict).join(nodes.select(F.col("_id").alias("instrument_id"), F.col("display_name").alias("instrument_name")), "instrument_id", "left")
    rows = own.select("_id", "display_name").join(home, "_id", "left").join(said, "_id", "left").join(cited, "_id", "left")
    judged = F.coalesce(F.size(F.filter("mentioned_by", lambda x: F.startswith(x["id"], F.lit("judgments/")))), F.lit(0))
    sized = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    fields = F.struct(F.col("_id").alias("id"), "display_name", "instrument_id", "instrument_name", "mentioned_by", "citations", sized("mentioned_by").alias("mention_count"), judged.alias("judgment_count"), sized("citations").alias("citation_count"))
    return rows.select("_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload"))


def descriptor() -> dict[str, object]:
    """What this engine serves, for callers that ask it."""
    from stelwerk.plans.engine import STAGES

    return {"name": "stelwerk", "collections": list(graph.COLLECTIONS), "stages": list(STAGES), "answers": ["article_document", "judgment_detail", "neighbourhood", "node_payload"]}


def schemas(tables: dict[str, DataFrame]) -> dict[str, str]:
    """The schema of each table as JSON."""
    return {name: df.schema.json() for name, df in tables.items()}
