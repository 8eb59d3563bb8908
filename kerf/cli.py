"""spark-submit kerf/cli.py chunk|eval|stats|serve ...; exit code 2 for a missing path, 1 for errors."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("kerf").getOrCreate()


def _chunks(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from kerf.operators.chunking import chunk
    from kerf.sources import files

    options = {"max_chunk_size": a.max_size, "min_chunk_size": a.min_size, "size_unit": a.size_unit, "overlap": a.overlap}
    if os.path.isfile(a.path):
        with open(a.path, "rb") as f:
            return chunk(spark.createDataFrame([(0, a.path, f.read())], "doc_id bigint, path string, content binary"), **options)
    return files.chunk_directory(spark, a.path, glob=a.glob, exclude=tuple(a.exclude), include_hidden=a.include_hidden, encoding=a.encoding, **options)


def _overlap(text: str) -> float | int:
    value = float(text)
    if value < 0:
        raise argparse.ArgumentTypeError("an overlap isn't negative")
    return value if value < 1 else int(value)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kerf")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("chunk", "stats"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--output")
        c.add_argument("--format", choices=("jsonl", "csv"), default="jsonl")
        for flag, size in (("--min-size", 50), ("--max-size", 1500)):
            c.add_argument(flag, type=int, default=size)
        c.add_argument("--size-unit", choices=("tokens", "chars", "nws"), default="tokens")
        c.add_argument("--overlap", type=_overlap, default=0)
        c.add_argument("--include-hidden", default=False, action="store_true")
        for flag, value in (("--encoding", "utf-8"), ("--glob", "**/*")):
            c.add_argument(flag, default=value)
        c.add_argument("--exclude", default=[], action="append")
    e = sub.add_parser("eval")
    e.add_argument("path")
    e.add_argument("--source")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8765)
    return p


def main(argv: list[str] | None = None) -> int:
    from kerf.operators import analytics, export

    a = parser().parse_args(argv)
    if a.command == "serve":
        from kerf import rpc

        rpc.serve(_session(), a.host, a.port)
        return 0
    if not os.path.exists(a.path):
        print(f"no such path: {a.path}", file=sys.stderr)
        return 2
    spark = _session()
    try:
        if a.command == "eval":
            chunks = export.with_stable_id(export.read_jsonl(spark, a.path)).where("error is null")
            sources = None
            if a.source:
                with open(a.source, encoding="utf-8") as f:
                    sources = chunks.select("doc_id").distinct().withColumn("content", F.lit(f.read()))
            print(json.dumps(analytics.evaluation_report(analytics.evaluate(chunks, sources)).first().asDict(), sort_keys=True))
            return 0
        chunks = _chunks(spark, a)
        failed = chunks.where("error is not null").count()
        good = chunks.where("error is null")
        if a.command == "stats":
            figures = analytics.chunk_stats(good, size="token_count").first().asDict()
            mean = analytics.quality_scores(good, a.min_size, a.max_size, "token_count").agg(F.round(F.avg("overall"), 4)).first()[0]
            types = {r.type: r.n for r in analytics.entity_distribution(good).orderBy("type").collect()}
            print(json.dumps(figures | {"mean_quality": mean, "entity_distribution": types, "failed_files": failed}, sort_keys=True))
        elif a.output:
            (export.write_csv if a.format == "csv" else export.write_jsonl)(good, a.output)
        else:
            for row in good.toLocalIterator():
                print(json.dumps(row.asDict(recursive=True), sort_keys=True, ensure_ascii=False))
        return 1 if failed else 0
    except (OSError, ValueError) as error:
        print(str(error), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
