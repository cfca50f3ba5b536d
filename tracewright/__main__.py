"""Command line: ``python -m tracewright <command>``."""

from __future__ import annotations

import argparse
import sys

from .session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewright")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="run techniques over a folder of logs")
    analyze.add_argument("path", nargs="*")
    analyze.add_argument("--output", required=True)
    analyze.add_argument("--techniques", default="")
    analyze.add_argument("--essential", action="store_true")
    analyze.add_argument("--split", action="store_true")
    listing = commands.add_parser("list-techniques")
    listing.add_argument("--essential", action="store_true")
    parse = commands.add_parser("parse", help="print one file's sessions")
    parse.add_argument("path")
    parse.add_argument("--format", choices=("json", "json-pretty"), default="json")
    freeze = commands.add_parser("freeze", help="write a table of files and digests")
    freeze.add_argument("path")
    freeze.add_argument("--output", required=True)
    export = commands.add_parser("export", help="write the latest run's manifest as a notebook")
    export.add_argument("folder")
    export.add_argument("--output", required=True)
    store = commands.add_parser("archive", help="copy logs into a content-addressed archive")
    store.add_argument("roots", nargs="*")
    store.add_argument("--target", required=True)
    store.add_argument("--dry-run", action="store_true")
    store.add_argument("--yes", action="store_true")
    args = parser.parse_args(argv)

    from .registry import REGISTRY

    if args.command == "list-techniques":
        for t in REGISTRY.values():
            if t.essential or not args.essential:
                print(f"{t.name:28} {'essential' if t.essential else '':10} {t.description}")
        return 0
    spark = build_session()
    from .sinks import archive as archives
    from .sinks import render, storage
    from .sources import discover, read_logs
    from .sources.logs import parse_dump

    if args.command == "parse":
        print(parse_dump(spark, args.path, args.format == "json-pretty"))
    elif args.command == "freeze":
        storage.freeze(spark, args.path).write.mode("overwrite").parquet(args.output)
    elif args.command == "archive":
        archives.archive(spark, args.roots or discover(), args.target, args.dry_run, args.yes, bool(args.roots)).show(truncate=False)
    elif args.command == "export":
        found = storage.latest_run(spark, args.folder)
        if found is None:
            print("no run to export", file=sys.stderr)
            return 1
        from .result import TechniqueResult

        run, manifest = found
        results = [TechniqueResult(t["technique"], {x["name"]: spark.read.parquet(x["path"]) for x in t["tables"]}, spark.read.parquet(f"{run}/{storage.slug(t['technique'])}/findings.parquet")) for t in manifest.techniques]
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(render.notebook(results, run))
    else:
        read = read_logs(spark, args.path or discover())
        manifest, failed = storage.analyze(read.frames, args.output, [x for x in args.techniques.split(",") if x], args.essential, args.split)
        for name, why in failed.items():
            print(f"warning: {name}: {why}", file=sys.stderr)
        print(manifest.run_id)
    return 0


if __name__ == "__main__":
    sys.exit(main())
