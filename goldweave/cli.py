"""``python -m goldweave {parse,validate,explain,run,test} document ...``"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from goldweave.plans.model import DocumentError, load


def describe(doc) -> str:
    """The stages of a document's plan, by target and mapping."""
    out = []
    for t in doc.targets.values():
        out.append(f"target {t.name}: identity {' or '.join('(' + ', '.join(g) + ')' for g in t.identity) or 'none'}")
        out += [f"  {f.name}: {f.strategy}" + (f" of group {f.group}" if f.group else "") + (f" -> {f.references}" if f.references else "") for f in t.fields.values()]
        for m in doc.into(t.name):
            shape = f"elements of {'.'.join(m.array)} in {m.parent}" if m.array else f"part of {m.parent}" if m.parent else f"rows of {m.source}"
            out.append(f"  <- {m.name}: {shape}; {len(m.fields)} fields" + ("; filtered" if m.filter is not None else ""))
    return "\n".join(out)


def dot(doc) -> str:
    """The document's graph of sources, mappings and targets in DOT."""
    lines = [f'  "s:{s}" [label="{s}", shape=box];' for s in doc.sources] + [f'  "t:{t}" [label="{t}", shape=ellipse];' for t in doc.targets]
    for m in doc.mappings.values():
        lines.append(f'  "m:{m.name}" [label="{m.name}", shape=plain];')
        lines.append(f'  "{"m:" + m.parent if m.parent else "s:" + m.source}" -> "m:{m.name}";')
        lines.append(f'  "m:{m.name}" -> "t:{m.target}";')
        lines += [f'  "m:{m.name}" -> "{"m:" if f.references in doc.mappings else "t:"}{f.references}" [style=dashed];' for f in m.fields if f.references]
    return "digraph mapping {\n" + "\n".join(lines) + "\n}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="goldweave", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("parse", "validate", "explain", "dot", "run", "test"):
        p = sub.add_parser(name)
        p.add_argument("document")
        if name == "run":
            p.add_argument("--source", action="append", default=[], metavar="NAME=PATH")
            p.add_argument("--format", default="parquet")
            p.add_argument("--strict", action="store_true", help="refuse texts that aren't arrays where arrays belong, and several identity groups")
            p.add_argument("--out", required=True, help="folder for one Parquet table per mapping and kind")
    args = parser.parse_args(argv)
    try:
        doc = load(args.document)
    except DocumentError as e:
        for path, message in e.errors:
            print(f"{path or '/'}: {message}", file=sys.stderr)
        return 1
    if args.command == "validate":
        print("valid")
    elif args.command == "parse":
        print(json.dumps(asdict(doc), indent=2, default=str))
    elif args.command == "explain":
        print(describe(doc))
    elif args.command == "dot":
        print(dot(doc))
    else:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.command == "test":
            from goldweave.plans.golden import run_test

            bad = 0
            for t in doc.tests:
                found = run_test(spark, doc, t)
                bad += bool(found)
                print(("FAIL " if found else "ok   ") + str(t.get("description", "")).strip())
                for f in found:
                    print("     " + f)
            return int(bad > 0)
        from goldweave.plans.pipeline import Pipeline
        from goldweave.sources.registry import read

        Pipeline(doc, read(spark, doc, dict(s.split("=", 1) for s in args.source), args.format), strict=args.strict).write(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
