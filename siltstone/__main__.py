"""python -m siltstone ingest | query | chat | inspect"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .config import load_config
from .models.http import HttpClient
from .operators.store import Table
from .plans.ingest import run_ingest
from .plans.retrieval import chat_with_context, query_repo
from .session import ChatSession


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("--config")
    p.add_argument("--offline", action="store_true", help="hash embeddings instead of the model server")
    sub = p.add_subparsers(dest="command", required=True)
    ingest = sub.add_parser("ingest")
    ingest.add_argument("--root")
    ingest.add_argument("--changed-only", action="store_true")
    ingest.add_argument("--force", action="store_true")
    ingest.add_argument("--no-index", action="store_true")
    ingest.add_argument("--vacuum", action="store_true")
    query = sub.add_parser("query")
    query.add_argument("question")
    query.add_argument("--top-k", type=int)
    query.add_argument("--answer", action="store_true")
    sub.add_parser("chat")
    sub.add_parser("inspect")
    args = p.parse_args(argv)
    cfg, _ = load_config(args.config)
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    host = cfg["ollama"]["host"]
    client = None if args.offline else HttpClient(host)
    if args.command == "ingest":
        print(run_ingest(spark, args.root, config_path=args.config, force_reembed=args.force, changed_only=args.changed_only, create_vec_index=not args.no_index, vacuum_after=args.vacuum, make_embedder=None if args.offline else lambda: HttpClient(host, backoff=0.2)))
    elif args.command == "query":
        hits = query_repo(spark, args.question, config_path=args.config, top_k=args.top_k, embedder=client)
        for h in hits.collect():  # top_k rows
            print(f"{h['_distance']:.4f} {h['relpath']}:{h['chunk_idx']}\n{h['content'][:300]}{'...' if len(h['content']) > 300 else ''}\n")
        if args.answer and client:
            print(chat_with_context(args.question, hits, client, args.config))
    elif args.command == "chat":
        session = ChatSession(spark, client, client, args.config)
        while (question := input("> ").strip()) not in ("", "exit", "quit"):
            session.ask(question, on_chunk=lambda s: print(s, end="", flush=True))
            print()
    else:
        table = Table(spark, cfg["db_dir"], cfg["table"])
        print(table.counts())
        table.read().printSchema()
        table.read().drop("vector").show(5)


if __name__ == "__main__":
    main()
