"""Commands for spark-submit: python -m evidentia.cli COMMAND ..."""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import functions as F

from evidentia.functions.text import snippet
from evidentia.operators import embedding, ranking
from evidentia.plans import pipeline
from evidentia.session import Settings, session
from evidentia.sources import files
from evidentia.sources.store import Store


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be at least 1")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="evidentia")
    out.add_argument("--base", help="folder of the store")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    p = commands.add_parser("crawl-archive")
    p.add_argument("--html", required=True)
    p.add_argument("--since", type=datetime.date.fromisoformat)
    p.add_argument("--include-future", action="store_true")
    p.add_argument("--limit", type=positive, default=50)
    p = commands.add_parser("crawl-supporting")
    p.add_argument("--pages", required=True, help="Parquet of hearing_id, source_url, html")
    p.add_argument("--limit", type=positive, default=50)
    p.add_argument("--hearing-id")
    for name in ("download-pdfs", "parse-pdfs"):
        p = commands.add_parser(name)
        p.add_argument("--contents", required=True)
        p.add_argument("--limit", type=positive)
        p.add_argument("--force", action="store_true")
        p.add_argument("--document-id")
    p = commands.add_parser("parse-agendas")
    p.add_argument("--limit", type=positive)
    p.add_argument("--hearing-id")
    p.add_argument("--document-id")
    p.add_argument("--no-links", action="store_true")
    p = commands.add_parser("chunk")
    p.add_argument("--limit", type=positive)
    p.add_argument("--document-id")
    p = commands.add_parser("embed")
    p.add_argument("--limit", type=positive)
    p.add_argument("--force", action="store_true")
    p.add_argument("--batch-size", type=positive, default=32)
    p = commands.add_parser("index")
    p.add_argument("--in-block", type=positive, default=256)
    p = commands.add_parser("search")
    p.add_argument("query")
    p.add_argument("--limit", type=positive, default=10)
    p.add_argument("--date-start", type=datetime.date.fromisoformat)
    p.add_argument("--date-end", type=datetime.date.fromisoformat)
    p.add_argument("--types", help="comma-separated")
    p.add_argument("--lexical-only", action="store_true")
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    settings = Settings.from_environment()
    spark = session()
    store, now = Store(spark, a.base or settings.base), datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    store.create()
    if a.command == "crawl-archive":
        pipeline.crawl_archive(store, files.html_files(spark, a.html), now.date(), now, a.since, a.include_future, a.limit)
    elif a.command == "crawl-supporting":
        pipeline.crawl_supporting(store, spark.read.parquet(a.pages), a.limit, a.hearing_id)
    elif a.command == "download-pdfs":
        counts, failures = pipeline.download_pdfs(store, a.contents, now, a.limit, a.force, a.document_id)
        print(counts)
        failures.show(truncate=False)
    elif a.command == "parse-pdfs":
        pipeline.parse_downloaded(store, a.contents, None, a.limit, a.document_id).show(truncate=False)
    elif a.command == "parse-agendas":
        pipeline.parse_agendas(store, a.hearing_id, a.document_id, a.limit, not a.no_links)
    elif a.command == "chunk":
        pipeline.chunk_documents(store, settings, a.limit, a.document_id)
    elif a.command == "embed":
        print(pipeline.embed_chunks(store, now, settings, a.limit, a.force, a.batch_size))
    elif a.command == "index":
        pipeline.build_index(store, a.in_block)
    elif a.command == "search":
        provider = None if a.lexical_only else embedding.provider_for(settings.provider, settings.model, settings.dimensions)
        types = [t.strip() for t in (a.types or "").split(",") if t.strip()] or None
        how = (store.read("chunks"), store.read("source_documents"), store.read("hearings"), a.query, store.read("chunk_embeddings"), provider, a.limit, a.date_start, a.date_end, types)
        index = pipeline.search_index(store)
        found = index.search(*how).rows if index.exists() else ranking.search(*how)
        found.select("score", "citation_label", "url", snippet(F.col("text")).alias("text")).show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
