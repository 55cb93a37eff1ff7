"""Commands: index, stats, search, threads, export, merge, attachments."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from .archive import MailArchive, merge_mailboxes
from .config import load_config
from .operators import export
from .operators.threads import thread_order
from .schema import MailError
from .ship import to_workers
from .sources.index import index_path, index_size


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lettermill", description="Queries over mail archives on Spark.")
    p.add_argument("--config", help="settings file (TOML)")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        if name != "merge":
            c.add_argument("mailbox")
            c.add_argument("-f", "--force", action="store_true", help="build the index anew")
        return c

    command("index", "build the index")
    command("stats", "statistics").add_argument("--json", action="store_true")
    c = command("search", "messages that match")
    c.add_argument("query")
    c.add_argument("--json", action="store_true")
    c.add_argument("--limit", type=int, default=100, help="rows shown in the table")
    command("threads", "conversation threads").add_argument("--limit", type=int, default=50)
    c = command("export", "write the messages that match")
    c.add_argument("-F", "--format", default="eml", help="eml, csv, txt, html or mbox")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-q", "--query", default="")
    c.add_argument("--quoted-printable", action="store_true", help="re-encode 8-bit text in eml files")
    c = command("merge", "merge mailboxes")
    c.add_argument("inputs", nargs="+")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--dedup", action="store_true", help="the first message of each id only")
    c.add_argument("--source-header", action="store_true", help="name each message's mailbox in a header")
    c = command("attachments", "write attachments, a folder for each message")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-q", "--query", default="")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    to_workers(spark)
    if args.command == "merge":
        print(json.dumps(merge_mailboxes(spark, args.inputs, args.output, args.dedup, args.source_header)))
        return
    began = time.time()
    archive = MailArchive(spark, args.mailbox, force=args.force, config=load_config(args.config))
    match args.command:
        case "index":
            n, where = archive.messages.count(), index_path(args.mailbox)
            print(json.dumps({"messages": n, "index": where, "index_size": index_size(where), "seconds": round(time.time() - began, 3)}))
        case "stats":
            doc = json.loads(archive.stats_json())
            if args.json:
                print(json.dumps(doc, ensure_ascii=False))
            else:
                n, with_ = doc["message_count"], doc["with_attachments"]
                print(f"{n} messages, {with_} with attachments ({100 * with_ / n if n else 0:.1f} %), {doc['duplicates']} duplicates, {doc['unique_ids']} unique ids")
                for s in doc["top_senders"]:
                    print(f"{s['count']:>8}  {s['sender']}")
        case "search":
            found = archive.search(args.query)
            if args.json:
                print(export.search_json(found).first()[0])
            else:
                export.search_table(found.orderBy("sequence").limit(args.limit)).orderBy("sequence").show(args.limit, truncate=False)
        case "threads":
            thread_order(archive.thread_nodes()).join(archive.messages.select("sequence", "subject"), "sequence").select("thread_key", "depth", "date", "subject").show(args.limit, truncate=60)
        case "export":
            print(archive.export(args.format, args.output, args.query, args.quoted_printable), "written to", os.path.abspath(args.output))
        case "attachments":
            print(archive.export_attachments(args.output, args.query), "written to", os.path.abspath(args.output))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lettermill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args)
    except MailError as e:
        print(f"lettermill: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
