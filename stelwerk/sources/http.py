"""Paged and single HTTP scans as a Spark data source, and the requests of the four public services.

``spark.dataSource.register(PagedJson)``, then ``spark.read.format("paged_json").option("url", ...)``. Each url is read
by one task; pages follow their next links there. A paged url that fails fails its task, which Spark tries again: half a walk
must not look like a whole one. A single url that fails is a row with ``error``; it doesn't end the job.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import urlencode, urljoin
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

TIMEOUT = 30
# The public services and the environment variables that replace them.
SERVICES = {
    "TK_API_BASE": "https://gegevensmagazijn.tweedekamer.nl/OData/v4/2.0/",
    "RECHTSPRAAK_BASE": "https://data.rechtspraak.nl/",
    "EURLEX_BASE": "https://eur-lex.europa.eu/",
    "BWB_BASE": "https://wetten.overheid.nl/",
    "BWB_SRU_ENDPOINT": "https://zoekservice.overheid.nl/sru/Search",
}
NEXT_LINK = "@odata.nextLink"


def base_url(url: str) -> str:
    """Exactly one slash at the end."""
    return url.rstrip("/") + "/"


def service(name: str) -> str:
    """The base of a service: its environment variable, else where it is public."""
    return base_url(os.environ.get(name) or SERVICES[name])


def odata_time(value: dt.datetime) -> str:
    """A time for a filter: zone-aware ones in UTC, others as they are, whole seconds, Z."""
    if value.tzinfo:
        value = value.astimezone(dt.timezone.utc)
    return value.replace(microsecond=0, tzinfo=None).isoformat() + "Z"


def modified_since(entity: str, since: dt.datetime, top: int = 100, before: dt.datetime | None = None) -> tuple[str, dict[str, str]]:
    """Path and parameters of an OData entity changed since a time and before another. ``top`` is the page size, not a limit."""
    end = f" and ApiGewijzigdOp lt {odata_time(before)}" if before else ""
    return entity, {"$filter": f"ApiGewijzigdOp ge {odata_time(since)}{end}", "$top": str(top)}


def ecli_index(modified: dt.datetime | None = None, extra: Mapping[str, str] | None = None) -> tuple[str, dict[str, str]]:
    return "uitspraken/zoeken", ({"modifiedsince": modified.replace(microsecond=0).isoformat()} if modified else {}) | dict(extra or {})


def ecli_content(ecli: str) -> tuple[str, dict[str, str]]:
    return "uitspraken/content", {"id": ecli}


def celex_html(celex: str, lang: str = "NL") -> tuple[str, dict[str, str]]:
    return f"legal-content/{lang}/TXT/", {"uri": f"CELEX:{celex}"}


def law_versions(bwb_id: str) -> tuple[str, dict[str, str]]:
    return "", {"operation": "searchRetrieve", "version": "1.2", "x-connection": "BWB", "query": f"dcterms.identifier=={bwb_id}"}


def search_parameters(areas: list[str], terms: list[str]) -> dict[str, str]:
    """Areas of law joined by commas, search terms joined by blanks under both names the service knows."""
    areas, terms = [a.strip() for a in areas if a and a.strip()], [t.strip() for t in terms if t and t.strip()]
    made = {"rechtsgebieden": ",".join(areas)} if areas else {}
    return made | ({"zoekterm": " ".join(terms), "searchterm": " ".join(terms)} if terms else {})


def fetch(url: str, timeout: int = TIMEOUT) -> str:
    with urlopen(Request(url, headers={"Accept": "*/*"}), timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def entries(page, result_key: str = "value") -> list[dict]:
    """The objects of a page: of the list under the key; else of every list in the page; else of a top-level list."""
    if isinstance(page, list):
        lists = [page]
    elif isinstance(page, dict):
        own = page.get(result_key)
        lists = [own] if isinstance(own, list) else [v for v in page.values() if isinstance(v, list)]
    else:
        lists = []
    return [x for one in lists for x in one if isinstance(x, dict)]


def pages(url: str, get: Callable[[str], str] = fetch, result_key: str = "value", next_link: str = NEXT_LINK) -> Iterator[dict]:
    """The objects of all pages from the url on. A next link seen before ends the walk."""
    seen: set[str] = set()
    while url and url not in seen:
        seen.add(url)
        page = json.loads(get(url))
        yield from entries(page, result_key)
        link = page.get(next_link) if isinstance(page, dict) else None
        url = urljoin(url, link.strip()) if isinstance(link, str) and link.strip() else ""


class _Url(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], paged: bool):
        self.urls = json.loads(options["urls"]) if "urls" in options else [base_url(options["url"]) + options.get("path", "") + ("?" + urlencode(json.loads(options["params"])) if "params" in options else "")]
        self.key, self.link, self.paged = options.get("resultKey", "value"), options.get("nextLink", NEXT_LINK), paged
        self.timeout = int(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[_Url]:
        return [_Url(u) for u in self.urls]

    def read(self, partition: _Url) -> Iterator[tuple]:
        if self.paged:
            get = lambda u: fetch(u, self.timeout)
            for x in pages(partition.url, get, self.key, self.link):
                yield partition.url, json.dumps(x, ensure_ascii=False), None
        else:
            yield (partition.url, *attempt(partition.url, self.timeout))


def attempt(url: str, timeout: int = TIMEOUT) -> tuple[str | None, str | None]:
    """(body, None), or (None, what went wrong)."""
    try:
        return fetch(url, timeout), None
    except (OSError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"


def fetched(df: DataFrame, url: str, timeout: int = TIMEOUT) -> DataFrame:
    """The rows with ``payload`` and ``error`` of the document at their url, fetched in their tasks; each row once, so make
    urls distinct. Null urls have an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [attempt(u, timeout) if u else (None, "no url") for u in b[url].to_pylist()]
            yield b.append_column("payload", pa.array([g[0] for g in got], pa.string())).append_column("error", pa.array([g[1] for g in got], pa.string()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("payload", StringType()), StructField("error", StringType())]))


class PagedJson(DataSource):
    """Rows ``url, payload, error``: one per object of the paged results. Options: url, path, params (JSON) or urls (a JSON
    list); resultKey, nextLink, timeout."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, payload string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


class HttpText(PagedJson):
    """Rows ``url, payload, error``: the body of each url as text."""

    @classmethod
    def name(cls) -> str:
        return "http_text"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)
