"""Listings of law versions: records of a search answer, and the version to take."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stelwerk.functions.text import date_or_min
from stelwerk.operators.merge import last_per_key
from stelwerk.operators.nested import local_name

FIELDS = ("bwb_id", "locatie_toestand", "locatie_wti", "locatie_manifest", "geldigheidsperiode_startdatum", "geldigheidsperiode_einddatum")


def records(xml: str) -> Iterator[tuple]:
    """(position, *FIELDS) of each record of an answer that names a law and a document; none of a malformed answer."""
    try:
        top = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError):
        return
    n = 0
    for record in top.iter():
        if not isinstance(record.tag, str) or local_name(record.tag) != "record":
            continue
        got: dict[str, str] = {}
        spare = None
        for e in record.iter():
            text = (e.text or "").strip()
            if not text or not isinstance(e.tag, str):
                continue
            name = local_name(e.tag)
            if name == "bwb-id":
                got["bwb_id"] = text
            elif name == "identifier" and "bwb_id" not in got:
                got["bwb_id"] = spare = text
            elif name in FIELDS[1:]:
                got[name] = text
        if got.get("bwb_id") and got.get("locatie_toestand"):
            yield (n, *[got.get(f) for f in FIELDS])
            n += 1


def parse(df: DataFrame, xml: str = "payload") -> DataFrame:
    """``seq`` and FIELDS: a row per record of each answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for x in b.column(0).to_pylist() if x for r in records(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.string()] * len(FIELDS))], names=["seq", *FIELDS])

    return df.select(xml).mapInArrow(run, "seq int, " + ", ".join(f"{f} string" for f in FIELDS))


def latest(versions: DataFrame, position: str = "seq") -> DataFrame:
    """One version per law: the first open-ended one, else that with the latest end, then start; then the first."""
    end, start = F.col("geldigheidsperiode_einddatum"), F.col("geldigheidsperiode_startdatum")
    is_open = F.coalesce(end == "9999-12-31", F.lit(False))
    ranked = versions.withColumns({"_open": is_open, "_end": F.when(~is_open, date_or_min(end)), "_start": F.when(~is_open, date_or_min(start)), "_first": -F.col(position)})
    return last_per_key(ranked, ["bwb_id"], ["_open", "_end", "_start", "_first"]).drop("_open", "_end", "_start", "_first")
