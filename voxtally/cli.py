"""Command line: run the pipeline, load Gold, show run summaries."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from voxtally.functions.scalars import video_id
from voxtally.sources import manifests

MOST = 100


def bounded(name: str) -> Callable[[str], int]:
    def parse(text: str) -> int:
        try:
            value = int(text)
        except ValueError:
            value = 0
        if not 1 <= value <= MOST:
            raise argparse.ArgumentTypeError(f"{name} must be an integer from 1 to {MOST}")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxtally", description=__doc__)
    top.add_argument("--base", default="data", help="folder of raw, silver, gold and run files")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="fetch and process the comments of one video")
    run.add_argument("video", help="video id or URL")
    run.add_argument("--max-pages", type=bounded("max pages"), default=2)
    run.add_argument("--page-size", type=bounded("page size"), default=10)
    run.add_argument("--entities", required=True, help="entity dictionary (JSON)")
    run.add_argument("--topics", required=True, help="topic dictionary (JSON)")
    load = commands.add_parser("load", help="publish the newest successful run's Gold tables")
    load.add_argument("video", help="video id or URL")
    load.add_argument("--schema", default="gold", help="schema of the Spark warehouse")
    load.add_argument("--duckdb", metavar="FILE", help="load into this DuckDB file instead")
    show = commands.add_parser("summary", help="show the newest run, the newest successful one, or several")
    show.add_argument("video", help="video id or URL")
    which = show.add_mutually_exclusive_group()
    which.add_argument("--latest-successful", action="store_true")
    which.add_argument("--history", type=bounded("history limit"), metavar="N")
    return top


def load_newest(spark, own: str, base: str, schema: str = "gold", warehouse=None) -> dict:  # noqa: ANN001
    """Publish the newest successful run of a video, in the Spark warehouse if no other is given."""
    from voxtally.warehouse.store import SparkWarehouse

    manifest = manifests.latest(own, f"{base}/runs", succeeded=True)
    if manifest is None:
        raise ValueError(f"No successful run for {own}")
    rows = (warehouse or SparkWarehouse(spark, schema)).load_snapshots(manifests.snapshot_loads(manifest))
    return {"run_id": manifest["run_id"], "video_id": own, "loaded_rows": rows}


def summaries(own: str, base: str, succeeded: bool = False, last: int | None = None) -> dict | list | None:
    if last is not None:
        return [manifests.summary(m) for m in manifests.history(own, last, f"{base}/runs")]
    manifest = manifests.latest(own, f"{base}/runs", succeeded)
    return None if manifest is None else manifests.summary(manifest)


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    top = parser()
    args = top.parse_args(argv)
    try:
        own = video_id(args.video)
    except ValueError as e:
        top.error(str(e))
    if args.command == "summary":
        found = summaries(own, args.base, args.latest_successful, args.history)
        print(json.dumps(found, ensure_ascii=False, indent=2))
        return 0 if found else 1
    if args.command == "load" and args.duckdb:
        from voxtally.warehouse.duckdb_store import DuckDbWarehouse

        print(json.dumps(load_newest(None, own, args.base, warehouse=DuckDbWarehouse(args.duckdb)), indent=2))
        return 0
    from voxtally.session import get_session

    spark = get_session()
    if args.command == "load":
        print(json.dumps(load_newest(spark, own, args.base, args.schema), indent=2))
        return 0
    from voxtally.plans.pipeline import Settings, run
    from voxtally.sources.dictionaries import load_entities, load_topics
    from voxtally.sources.rest import Client

    client = Client(os.environ.get("YOUTUBE_API_KEY"))
    print(run(spark, client, Settings(own, args.max_pages, args.page_size, args.base), load_entities(args.entities), load_topics(args.topics)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
