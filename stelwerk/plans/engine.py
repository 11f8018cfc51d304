"""The run over a store: retrieve, seed, normalize, link. Nodes and edges are upserted: running a stage again adds nothing
that is there, and changes what has changed."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stelwerk.operators import graph
from stelwerk.operators.merge import Store
from stelwerk.plans import linkers, normalize
from stelwerk.sources.profiles import resolve, section

log = logging.getLogger(__name__)
STAGES = ("seed", "parliament", "judgments", "eu_acts", "laws", "link_laws", "store_citations", "link_eu", "link_judgments", "link_parliament")
#: Left out unless asked for.
OPTIONAL = ("store_citations",)
_PROPS = "struct<config_id:string,jurisdiction:string,kind:string,title:string,short_title:string,notes:string,bwb_id:string,celex:string,display_name:string>"


def seed(spark: SparkSession, profile: Mapping[str, Any], store: Store) -> dict[str, DataFrame]:
    """seed_rows with the keys of nodes that are stored already: an instrument with the same ``config_id`` and a topic with
    the same id or slug keep the least of their keys, whatever they are called in the profile now."""
    made = seed_rows(spark, profile)
    topics = store.read("topics") if store.exists("topics") else None
    if topics is not None:
        same = graph.find_topic(topics, *(str(section(profile, "topic", x)) for x in ("id", "slug"))).select("_key").scalar()
        made["topics"] = _renamed(made["topics"].withColumn("_old", same), "topics")
    if store.exists("instruments") and "config_id" in store.read("instruments").schema["props"].dataType.fieldNames():
        have = store.read("instruments").where("props.config_id is not null").groupBy(F.col("props.config_id").alias("_c")).agg(F.min("_key").alias("_old"))
        made["instruments"] = _renamed(made["instruments"].join(have, F.col("props.config_id") == F.col("_c"), "left").drop("_c"), "instruments")
    made["edges_semantic"] = normalize.topic_edges(made["instruments"], profile, "seed", topics)
    return made


def _renamed(df: DataFrame, table: str) -> DataFrame:
    key = F.coalesce("_old", "_key")
    return df.withColumns({"_id": F.concat(F.lit(f"{table}/"), key), "_key": key}).drop("_old")


def seed_rows(spark: SparkSession, profile: Mapping[str, Any]) -> dict[str, DataFrame]:
    """Topic and instruments of a profile with their edges. A topic needs id and slug, an instrument an id."""
    topic = section(profile, "topic")
    if not topic.get("id") or not topic.get("slug"):
        raise ValueError("a profile's topic needs an id and a slug")
    entries = [*(section(profile, "nl_instruments") or []), *(section(profile, "eu_instruments") or [])]
    if any(not e.get("id") for e in entries):
        raise ValueError("a profile's instrument needs an id")
    labels = list(dict.fromkeys([*topic.get("labels", []), "Domain"]))
    t = spark.createDataFrame([(topic["id"], topic["slug"], topic.get("name"), topic.get("description"), list(topic.get("tags", [])))], "id string, slug string, name string, description string, tags array<string>")
    key = normalize.topic_key(profile)
    label = F.array(*[F.lit(x) for x in labels])
    topics = t.select(key.alias("_key"), F.concat(F.lit("topics/"), key).alias("_id"), F.lit("topic").alias("type"), label.alias("labels"), F.struct("id", "slug", "name", "description", "tags", F.coalesce("name", "slug").alias("display_name")).alias("props"))
    rows = [(str(e["id"]), *[e.get(k) for k in ("jurisdiction", "kind", "title", "short_title", "notes", "bwb_id", "celex")]) for e in entries]
    e = spark.createDataFrame(rows, "config_id string, jurisdiction string, kind string, title string, short_title string, notes string, bwb_id string, celex string")
    from stelwerk.functions import keys as K
    from stelwerk.functions import text as X

    own = K.node_key(F.coalesce("bwb_id", "celex", "config_id"))
    props = {c: F.col(c) for c in e.columns}
    slug = str(topic["slug"]).capitalize()
    nodes = e.select(own.alias("_key"), F.concat(F.lit("instruments/"), own).alias("_id"), F.lit("instrument").alias("type"), F.array(F.lit(slug)).alias("labels"), F.struct(*props.values(), X.display_name(F.lit("instrument"), props).alias("display_name")).cast(_PROPS).alias("props"))
    return {"topics": topics, "instruments": nodes, "edges_semantic": normalize.topic_edges(nodes, profile, "seed")}


def _write(store: Store, frames: Mapping[str, DataFrame]) -> dict[str, int]:
    return {t: store.upsert(t, df) for t, df in frames.items()}


def run(spark: SparkSession, raw: DataFrame, root: str, profile: str | Mapping[str, Any] | None, stages: Iterable[str] | None = None, skip: Iterable[str] = (), since=None) -> dict[str, dict[str, int]]:
    """Runs the stages in order and returns new rows per stage and table. Without ``stages``, all but OPTIONAL ones. A stage
    in ``skip`` is left out; unknown names are an error. With ``since``, only records fetched then or later are normalized,
    and only judgments among them and documents stored since then are linked."""
    chosen, skipped = [s for s in STAGES if s not in OPTIONAL] if stages is None else list(stages), set(skip)
    if unknown := [s for s in (*chosen, *skipped) if s not in STAGES]:
        raise ValueError(f"no such stage: {unknown}")
    profile, store, made = resolve(profile), Store(spark, root), {}
    for stage in chosen:
        if stage in skipped:
            continue
        if stage == "seed":
            frames = seed(spark, profile, store) if section(profile, "topic") else {}
        elif stage == "laws":
            frames = normalize.laws(raw, since)
        elif stage in ("parliament", "judgments", "eu_acts"):
            frames = getattr(normalize, stage)(raw, profile, since, store.read("topics") if store.exists("topics") else None)
        else:
            frames = _links(store, stage, profile, raw, since)
        made[stage] = _write(store, frames)
        log.info("%s: %s", stage, made[stage])
    for table in {t for frames in made.values() for t in frames}:
        store.compact(table)
    return made


def _links(store: Store, stage: str, profile: Mapping[str, Any], raw: DataFrame, since=None) -> dict[str, DataFrame]:
    ids = [store.read(t).select("_id") for t in graph.COLLECTIONS if store.exists(t)]
    if not ids:
        return {}
    nodes = ids[0]
    for x in ids[1:]:
        nodes = nodes.unionByName(x)
    if stage == "link_laws" and store.exists("instrument_articles"):
        return {"edges_semantic": linkers.link_laws(store.read("instrument_articles"), nodes, section(profile, "bwb", "ids") or None, profile)}
    if stage == "store_citations" and store.exists("instrument_articles"):
        return {"instrument_articles": linkers.with_citations(store.read("instrument_articles"))}
    if stage == "link_eu" and store.exists("instruments"):
        return {"edges_semantic": linkers.link_eu(store.read("instruments"), nodes, profile)}
    if stage == "link_judgments" and store.exists("judgments"):
        return {"edges_semantic": linkers.link_judgments(store.read("judgments"), nodes, profile, None if since is None else linkers.recent_eclis(raw, since))}
    if stage == "link_parliament":
        names = ("title", "summary", "body", "text", "raw")
        tables = [store.read(t) for t in ("publications", "procedures") if store.exists(t)]
        docs = [t.select("_id", "labels", F.struct(*[linkers.prop(t, n).alias(n) for n in names]).alias("props")) for t in tables]
        if docs:
            both = docs[0] if len(docs) == 1 else docs[0].unionByName(docs[1])
            return {"edges_semantic": linkers.link_parliament(both, nodes, profile)}
    return {}
