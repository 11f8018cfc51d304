"""From the public services to rows of the landing table.

Every function returns rows of the landing table with one more column, ``error``: a document that could not be fetched is a
row without payload that says why. A walk over pages can't end half-way: one that fails is tried again by Spark and in the
end fails the job. land stores what was fetched, and what was not beside it.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Iterable, Mapping
from typing import Any
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stelwerk.functions import text as X
from stelwerk.session import written
from stelwerk.sources import http, raw, versions
from stelwerk.sources.profiles import env_list, section, unique

log = logging.getLogger(__name__)
SOURCES = ("parliament", "judgments", "eu_acts", "laws")
#: Length of the stretches of time a scan of changes is cut into, one task each.
WINDOW = dt.timedelta(days=1)


def _url(base: str, request: tuple[str, Mapping[str, str]]) -> str:
    path, params = request
    return base + path + ("?" + urlencode(params) if params else "")


def _read(spark: SparkSession, kind: type, urls: list[str]) -> DataFrame:
    """``url, payload, error`` of the urls, one task each."""
    spark.dataSource.register(kind)
    if not urls:
        return spark.createDataFrame([], "url string, payload string, error string")
    return spark.read.format(kind.name()).option("urls", json.dumps(urls)).load()


def _rows(got: DataFrame, source: str, kind: str, external_id: Column | None = None, meta: Column | None = None, as_json: bool = False) -> DataFrame:
    own = {"payload_json" if as_json else "payload_text": F.col("payload")}
    return raw.raw_rows(got, source, kind, external_id, meta=meta, **own, error=F.col("error"))


def parliament_filter(rules: Mapping[str, Any], payload: str = "payload") -> Column:
    """Whether a record's titles or case number hold a title keyword, or the record as a whole a dossier keyword."""
    hit = X.has_keyword(F.col(payload), rules.get("dossier_keywords", []))
    for name in ("Titel", "ZaakTitel", "Omschrijving", "TitelMetBijlagen", "ZaakNummer"):
        hit = hit | X.has_keyword(F.get_json_object(payload, f"$.{name}"), rules.get("title_contains", []))
    return hit


def time_windows(since: dt.datetime, until: dt.datetime, step: dt.timedelta = WINDOW) -> list[tuple[dt.datetime, dt.datetime | None]]:
    """Stretches of ``step`` from ``since`` on that cover all time: the last has no end."""
    cuts = [since]
    while cuts[-1] + step < until:
        cuts.append(cuts[-1] + step)
    return list(zip(cuts, [*cuts[1:], None]))


def parliament(spark: SparkSession, since: dt.datetime, top: int = 100, cases: Column | None = None, documents: Column | None = None, base: str | None = None, step: dt.timedelta = WINDOW, until: dt.datetime | None = None) -> DataFrame:
    """Cases and document versions changed since a time, one task per stretch of time and entity. ``cases`` and
    ``documents``: conditions on ``payload``."""
    base, made = base or http.service("TK_API_BASE"), []
    windows = time_windows(since, until or dt.datetime.now(since.tzinfo), step)
    for entity, kind, keep in (("Zaak", "tk-zaak", cases), ("DocumentVersie", "tk-documentversie", documents)):
        got = _read(spark, http.PagedJson, [_url(base, http.modified_since(entity, a, top, b)) for a, b in windows])
        got = got if keep is None else got.where(keep)
        made.append(_rows(got, "tk", kind, F.get_json_object("payload", "$.Id"), as_json=True))
    return made[0].unionByName(made[1])


def _named(got: DataFrame, by_url: Mapping[str, str], name: str) -> DataFrame:
    """The documents with the name each url was made for. The names are those of the request."""
    names = got.sparkSession.createDataFrame(list(by_url.items()) or [], f"url string, {name} string")
    return got.join(names, "url")


def judgments(spark: SparkSession, eclis: Iterable[str], index_since: dt.datetime | None = None, extra: Mapping[str, str] | None = None, base: str | None = None) -> DataFrame:
    """Contents of the judgments asked for, and the index if a time is given."""
    base = base or http.service("RECHTSPRAAK_BASE")
    by_url = {_url(base, http.ecli_content(e)): e for e in dict.fromkeys(eclis)}
    got = _named(_read(spark, http.HttpText, list(by_url)), by_url, "ecli")
    rows = _rows(got, "rechtspraak", "rs-content", F.col("ecli"), F.create_map(F.lit("ecli"), "ecli"))
    if index_since is not None:
        rows = rows.unionByName(_rows(_read(spark, http.HttpText, [_url(base, http.ecli_index(index_since, extra))]), "rechtspraak", "rs-index"))
    return rows


def acts(spark: SparkSession, celexes: Iterable[str], lang: str = "NL", base: str | None = None) -> DataFrame:
    """EU acts as HTML by CELEX id."""
    base = base or http.service("EURLEX_BASE")
    by_url = {_url(base, http.celex_html(c, lang)): c for c in dict.fromkeys(celexes)}
    got = _named(_read(spark, http.HttpText, list(by_url)), by_url, "celex")
    return _rows(got, "eurlex", "eu-celex-html", F.col("celex"), F.create_map(F.lit("celex"), "celex", F.lit("lang"), F.lit(lang)))


def laws(spark: SparkSession, bwb_ids: Iterable[str], search: str | None = None) -> DataFrame:
    """The version of each law that holds now: the listing is searched, one version picked, its document fetched. Listings
    that fail, and laws without a version, have a row with an error. The urls of the documents are read from the chosen
    versions, which are written once and fetched where they are: no address passes through the driver."""
    search = (search or http.service("BWB_SRU_ENDPOINT")).rstrip("/")
    by_url = {_url(search, http.law_versions(i)): i for i in dict.fromkeys(bwb_ids)}
    listings = written(_named(_read(spark, http.HttpText, list(by_url)), by_url, "asked"), "listings")
    chosen = versions.latest(versions.parse(listings.where("error is null")))
    got = http.fetched(chosen.withColumnRenamed("locatie_toestand", "url"), "url")
    meta = F.map_filter(F.create_map(F.lit("bwb_id"), "bwb_id", F.lit("toestand_url"), "url", F.lit("start_date"), "geldigheidsperiode_startdatum", F.lit("end_date"), "geldigheidsperiode_einddatum"), lambda _, v: v.isNotNull())
    rows = written(_rows(got, "bwb", "bwb-toestand-xml", F.col("bwb_id"), meta), "laws")
    missing = listings.select("asked", F.col("error"), F.lit(None).cast("string").alias("payload"))
    missing = missing.join(rows.select(F.col("external_id").alias("asked")), "asked", "left_anti").withColumn("error", F.coalesce("error", F.lit("no version")))
    return rows.unionByName(_rows(missing, "bwb", "bwb-toestand-xml", F.col("asked")))


def land(rows: DataFrame, path: str) -> dict[str, int]:
    """Appends what was fetched to the landing table at ``path`` and what was not to ``path``_failed; returns how many rows of
    both. Everything is fetched before anything is stored: a fetch that fails as a whole stores nothing."""
    done = written(rows, "fetched")
    good, bad = done.where("error is null").drop("error"), done.where("error is not null")
    counts = {"stored": good.count(), "failed": bad.count()}
    if counts["stored"]:
        raw.append(good, path)
    if counts["failed"]:
        bad.write.mode("append").parquet(path.rstrip("/") + "_failed")
        log.warning("%s not fetched", counts["failed"])
    return counts


def fetch(spark: SparkSession, source: str, profile: Mapping[str, Any], since: dt.datetime, top: int = 50, ids: Iterable[str] = (), lang: str = "NL", bases: Mapping[str, str] | None = None) -> DataFrame | None:
    """The rows of one of SOURCES as a profile asks for them. ``ids``: ECLIs, CELEX or law ids in place of the profile's; None
    if a source needs ids and there are none."""
    bases, ids = bases or {}, list(ids)
    if source == "parliament":
        rules = section(profile, "filters", "tk")
        keep = parliament_filter(rules) if rules else None
        return parliament(spark, since, top, keep, keep, bases.get(source))
    if source == "judgments":
        rules = section(profile, "filters", "rechtspraak")
        extra = http.search_parameters(list(rules.get("rechtsgebieden") or []), list(rules.get("search_terms") or []))
        return judgments(spark, ids or unique(section(profile, "seed_examples", "rechtspraak_eclis")), since, extra, bases.get(source))
    if source == "eu_acts":
        own = unique(section(profile, "filters", "eurlex", "celex_ids"), [i.get("celex") for i in section(profile, "eu_instruments") or []])
        wanted = ids or own
        return acts(spark, wanted, lang, bases.get(source)) if wanted else None
    if source == "laws":
        wanted = ids or unique(section(profile, "bwb", "ids")) or env_list("BWB_IDS")
        return laws(spark, wanted, bases.get(source)) if wanted else None
    raise ValueError(f"no such source: {source}")


def run(spark: SparkSession, path: str, profile: Mapping[str, Any], sources: Iterable[str] = SOURCES, skip: Iterable[str] = (), since: dt.datetime | None = None, **options: Any) -> dict[str, dict[str, int]]:
    """Fetches the sources in order into the landing table; rows stored and failed per source. A source in ``skip``, or
    without ids to ask for, is left out; the first that fails as a whole ends the run. ``since``: one day back by default."""
    since = since or dt.datetime.now(dt.timezone.utc).replace(microsecond=0) - dt.timedelta(days=1)
    made = {}
    for source in sources:
        if source in set(skip):
            continue
        rows = fetch(spark, source, profile, since, **options)
        if rows is None:
            log.warning("%s: no ids to ask for", source)
            continue
        made[source] = land(rows, path)
        log.info("%s: %s", source, made[source])
    return made
