"""python -m stelwerk retrieve --raw PATH [--source S]... [--skip S]... [--profile NAME] [--since-days 1] [--limit 50] [--id ID]... [--lang NL]
python -m stelwerk run --raw PATH --store PATH [--profile NAME] [--stage S]... [--skip S]... [--since-days 0] [--store-citations]
python -m stelwerk all: retrieve, then run

Sources and stages can also be left out by STELWERK_SKIP_<NAME>=1.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import logging
import os

from stelwerk.plans import retrieve
from stelwerk.plans.engine import OPTIONAL, STAGES, run
from stelwerk.session import session, ship
from stelwerk.sources.profiles import resolve


def skipped_by_environment(names: tuple[str, ...] = STAGES) -> set[str]:
    return {s for s in names if os.environ.get(f"STELWERK_SKIP_{s.upper()}", "").strip().lower() in ("1", "true")}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="stelwerk")
    made.add_argument("command", choices=["retrieve", "run", "all"])
    made.add_argument("--raw", required=True, help="folder of the landing table")
    made.add_argument("--store", help="folder of the node and edge tables")
    made.add_argument("--profile")
    made.add_argument("--source", action="append", choices=retrieve.SOURCES)
    made.add_argument("--stage", action="append", choices=STAGES)
    made.add_argument("--skip", action="append", choices=[*retrieve.SOURCES, *STAGES], default=[])
    made.add_argument("--since-days", type=int, help="retrieve: 1 by default; run: 0 by default, the full history")
    made.add_argument("--limit", type=int, default=50, help="page size")
    made.add_argument("--id", action="append", default=[], help="ECLI, CELEX or law id of the one source given")
    made.add_argument("--lang", default="NL")
    made.add_argument("--store-citations", action="store_true")
    return made


def main(args: list[str] | None = None) -> dict:
    got = parser().parse_args(args)
    if got.id and len(got.source or ()) != 1:
        raise SystemExit("--id needs one --source")
    if got.command != "retrieve" and not got.store:
        raise SystemExit("--store is missing")
    logging.basicConfig(level=os.environ.get("STELWERK_LOG_LEVEL", "INFO"))
    spark = session()
    ship(spark)
    profile, made = resolve(got.profile), {}
    now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
    if got.command in ("retrieve", "all"):
        since = now - dt.timedelta(days=1 if got.since_days is None else got.since_days)
        skip = {*got.skip, *skipped_by_environment(retrieve.SOURCES)}
        made |= retrieve.run(spark, got.raw, profile, got.source or retrieve.SOURCES, skip, since, top=got.limit, ids=got.id, lang=got.lang)
    if got.command in ("run", "all"):
        since = now.replace(tzinfo=None) - dt.timedelta(days=got.since_days) if got.since_days else None
        stages = got.stage or [s for s in STAGES if s not in OPTIONAL or got.store_citations]
        made |= run(spark, spark.read.parquet(got.raw), got.store, profile, stages, {s for s in (*got.skip, *skipped_by_environment()) if s in STAGES}, since)
    print(json.dumps(made))
    return made


if __name__ == "__main__":
    main()
