"""Command line: ``python -m spanloom.cli`` (or spark-submit): describe, classify, export, eval, dry-run, query."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom import constants as C


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    sub = p.add_subparsers(dest="do", required=True)
    for name, text in (("describe", "fixed values, queries, formats"), ("classify", "transcripts to spans by a keyword rule"), ("dry-run", "chunks, tokens and cost"), ("export", "spans to text formats"), ("query", "run a registered query")):
        s = sub.add_parser(name, help=text)
        if name in ("classify", "dry-run", "export"):
            s.add_argument("--input", required=True, help="transcript JSON or caption files (a glob)")
            s.add_argument("--max-tokens", type=int, default=6000)
            s.add_argument("--words", default="sponsor,promo code,brought to you", help="cues of the keyword rule")
        if name in ("classify", "export"):
            s.add_argument("--output", required=True)
            s.add_argument("--force", action="store_true")
        if name == "export":
            s.add_argument("--formats", default="edl,srt,vtt")
        if name == "query":
            s.add_argument("name")
            s.add_argument("data")
    return p


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    from spanloom.plans import registry
    from spanloom.sinks.exporters import RENDER, WITH_TRANSCRIPT, export_all, write_exports
    from spanloom.sources import readers

    if a.do == "describe":
        print({"thresholds": (C.AD_THRESHOLD, C.UNCERTAIN), "kinds": C.KINDS, "formats": [*RENDER, *WITH_TRANSCRIPT], "queries": sorted(registry.QUERIES), "exit_codes": C.EXIT_CODES})
        return C.EXIT_CODES["ok"]
    spark = SparkSession.builder.appName("spanloom").getOrCreate()
    if a.do == "query":
        registry.QUERIES[a.name](spark, a.data).show(50, False)
        return C.EXIT_CODES["ok"]
    from spanloom.operators.propose import RuleProposer
    from spanloom.plans.classify import classify, dry_run
    from spanloom.sinks.records import record_spans, write_new

    words = F.array().cast("array<struct<w:string,s:bigint,e:bigint>>")
    try:
        segments = readers.read_transcripts(spark, a.input) if a.input.endswith(".json") else readers.read_captions(spark, a.input).withColumn("words", words)
        if segments.isEmpty():
            return C.EXIT_CODES["unreadable"]
    except Exception as e:  # noqa: BLE001
        print(str(e)[:400], file=sys.stderr)
        return C.EXIT_CODES["unreadable"]
    if a.do == "dry-run":
        dry_run(segments, a.max_tokens).show(50, False)
        return C.EXIT_CODES["ok"]
    cue = F.lit(False)
    for w in a.words.split(","):
        cue = cue | F.lower(F.coalesce("text", F.lit(""))).contains(w.strip().lower())
    result = classify(segments, RuleProposer(cue), a.max_tokens)
    spans = record_spans(result.spans.withColumn("advertiser", F.lit(None).cast("string")))
    if a.do == "classify":
        try:
            write_new(result.episodes, f"{a.output}/episodes", a.force)
            write_new(spans, f"{a.output}/spans", a.force)
        except Exception as e:  # noqa: BLE001
            print(str(e)[:400], file=sys.stderr)
            return C.EXIT_CODES["exists"]
        return C.EXIT_CODES["ok"]
    media = result.episodes.select("episode", "duration_ms", F.lit("").alias("sha256"), F.col("episode").cast("string").alias("path"), "status")
    write_exports(export_all(media, spans, segments, a.formats.split(",")), a.output)
    return C.EXIT_CODES["ok"]


if __name__ == "__main__":
    sys.exit(main())
