"""python -m condensa COMMAND: compress, analyse, compare, patterns, add, stats, health, optimise, benchmark, learn.

Texts come from an argument, a file or standard input; results go to standard
output as JSON lines, or to a file. ``benchmark`` and ``learn`` read a Parquet
file or folder with doc_id and text.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .config import EngineConfig
from .operators import engines, mining, rules
from .service import Service
from .sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="condensa", description=__doc__.splitlines()[0])
    p.add_argument("--config", help="JSON file with settings")
    p.add_argument("--rules", help="Parquet rule table (default: the starter rules)")
    p.add_argument("--output", help="file for the result")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: bool = True):
        c = sub.add_parser(name)
        if text:
            c.add_argument("text", nargs="?")
            c.add_argument("--input", help="file with the text")
        return c

    for name in ("compress", "compare"):
        command(name).add_argument("--level", choices=["none", "light", "balanced", "aggressive"])
    sub.choices["compress"].add_argument("--domain")
    command("analyse")
    c = command("optimise")
    c.add_argument("--model", default="large")
    c.add_argument("--max-tokens", type=int)
    c = command("patterns", text=False)
    c.add_argument("--domain")
    c.add_argument("--search")
    c.add_argument("--limit", type=int, default=10)
    c = command("add", text=False)
    c.add_argument("original")
    c.add_argument("compressed")
    c.add_argument("--domain")
    for name in ("stats", "health"):
        command(name, text=False)
    command("benchmark", text=False).add_argument("documents")
    c = command("learn", text=False)
    c.add_argument("documents")
    c.add_argument("--least", type=int, help="occurrences that a phrase needs")
    return p


def run(args: argparse.Namespace, spark: SparkSession, stdin=sys.stdin) -> list[dict]:
    config = EngineConfig.load(spark, args.config)
    table = io.read_rules(spark, args.rules) if args.rules else rules.starter_rules(spark)
    if args.command in ("benchmark", "learn"):
        docs = spark.read.parquet(args.documents).select("doc_id", "text")
        if args.command == "benchmark":
            return [r.asDict() for r in engines.benchmark(engines.compare_engines(docs, table, config)).orderBy("engine").collect()]
        return [r.asDict() for r in mining.learn_rules(docs, args.least or config.min_frequency).orderBy("chars_saved", ascending=False).limit(config.max_results).collect()]
    service = Service(spark, table, config)
    if args.command in ("patterns", "add"):
        if args.command == "add":
            out = service.call("patterns", action="add", original=args.original, compressed=args.compressed, domain=args.domain)
            if out.get("added") and args.rules:
                io.overwrite_rules(service.rules, args.rules)
            return [out]
        return [service.call("patterns", action="search" if args.search else "list", search=args.search, domain=args.domain, limit=args.limit)]
    if args.command in ("stats", "health"):
        return [service.call(args.command)]
    text = args.text
    if text is None:
        if args.input:
            with open(args.input, encoding="utf-8") as f:
                text = f.read()
        else:
            text = stdin.read()
    more = {k: getattr(args, k) for k in ("level", "domain", "model", "max_tokens") if getattr(args, k, None) is not None}
    return [service.call(args.command, text=text, **more)]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("condensa").getOrCreate()
    out = run(args, spark)
    lines = "".join(json.dumps(x, default=str, ensure_ascii=False) + "\n" for x in out)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(lines)
    else:
        sys.stdout.write(lines)
    return 0 if all(x.get("success", True) for x in out) else 1


if __name__ == "__main__":
    sys.exit(main())
