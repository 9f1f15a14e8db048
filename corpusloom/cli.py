"""Command line: duplicate files, code spans or the full report of directories."""

from __future__ import annotations

import argparse
import math
import os
import sys

from .options import IGNORED_DIRS, InvalidOption, ScanOptions

LARGEST = 2**53 - 1


def whole(least: int = 0, most: int = LARGEST):
    def parse(s: str) -> int:
        if not (s.isascii() and s.isdigit()) or not least <= int(s) <= most:
            raise argparse.ArgumentTypeError(f"needs a whole number from {least} to {most}: {s}")
        return int(s)

    return parse


def share(s: str) -> float:
    try:
        value = float(s)
    except ValueError:
        value = math.nan
    if not math.isfinite(value) or not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"needs a number from 0 to 1: {s}")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Find duplicate files and similar code in directories.", allow_abbrev=False)
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--report", action="store_true", help="run all detectors")
    mode.add_argument("--code-spans", action="store_true", help="find repeated code spans")
    p.add_argument("--json", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--strict", action="store_true", help="fail if something was left out that matters")
    p.add_argument("--cross-repo-only", action="store_true", help="only groups of two roots or more")
    p.add_argument("--gitignore", dest="gitignore", action="store_true", default=True)
    p.add_argument("--no-gitignore", dest="gitignore", action="store_false")
    p.add_argument("--follow-symlinks", action="store_true")
    for name in ("max-files", "max-total-bytes", "max-normalized-chars", "max-tokens", "max-file-size"):
        p.add_argument(f"--{name}", type=whole())
    p.add_argument("--min-match-len", type=whole(1, 2**32 - 1), default=50)
    p.add_argument("--min-token-len", type=whole(1, 2**32 - 1), default=50)
    p.add_argument("--similarity-threshold", type=share, default=0.85)
    p.add_argument("--simhash-max-distance", type=whole(0, 64), default=3)
    p.add_argument("--max-report-items", type=whole(0, 2**32 - 1), default=200)
    p.add_argument("--ignore-dir", action="append", default=[])
    p.add_argument("--localization", choices=["en", "zh"], default="en")
    p.add_argument("-V", "--version", action="version", version="corpusloom 0.1.0")
    p.add_argument("roots", nargs="*")
    return p


def options_of(args: argparse.Namespace) -> ScanOptions:
    size = ScanOptions().max_file_size if args.max_file_size is None else args.max_file_size
    return ScanOptions(
        ignore_dirs=(*IGNORED_DIRS, *args.ignore_dir),
        max_file_size=size,
        max_files=args.max_files,
        max_total_bytes=args.max_total_bytes,
        max_normalized_chars=args.max_normalized_chars,
        max_tokens=args.max_tokens,
        min_match_len=args.min_match_len,
        min_token_len=args.min_token_len,
        similarity_threshold=args.similarity_threshold,
        simhash_max_distance=args.simhash_max_distance,
        max_report_items=args.max_report_items,
        respect_gitignore=args.gitignore,
        cross_repo_only=args.cross_repo_only,
        follow_symlinks=args.follow_symlinks,
    )


def run(argv: list[str], spark=None) -> int:
    """Exit code 0, 1 (failed, or strict with something left out) or 2 (usage)."""
    p = parser()
    args = p.parse_args(argv)
    roots = args.roots or [os.getcwd()]
    if args.cross_repo_only and len(roots) < 2:
        p.error("--cross-repo-only needs at least two roots")
    options = options_of(args)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import files, prepare, spans
    from .plans import report, sinks
    from .sources import tree

    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    try:
        options = options.for_report() if args.report else options.for_spans() if args.code_spans else options
        corpus, listing = tree.corpus(spark, roots, options)
        if args.report:
            found = report.generate(corpus, options)
            stats, kind = found.stats, "report"
            result = {sinks.camel(s): sinks.rows_of(found.sections[s], s) for s in report.SECTIONS}
            shown = sinks.text_report(result, args.localization)
        else:
            kept, stats = report.scanned(corpus, options)
            kind = "groups"
            if args.code_spans:
                docs = prepare.numbered(kept)
                symbols = prepare.char_symbols(docs)
                params = spans.SpanParams.exact(options.min_match_len, cross_repo_only=options.cross_repo_only, max_bucket=options.max_bucket)
                groups = spans.span_groups(docs, symbols, params)
                letters = F.transform(F.sequence(F.lit(0), F.least(F.col("normalized_len"), F.lit(80)).cast("int") - 1), lambda i: F.decode(F.substring(F.col("sample"), i * 4 + 1, F.lit(1)), "utf-8"))
                groups = groups.withColumn("preview", F.array_join(letters, "")).orderBy("hash", "normalized_len", "n_members")
                result = sinks.rows_of(groups, "spans")
                shown = sinks.text_spans(result, args.localization)
            else:
                result = sinks.rows_of(files.nested(kept, options.cross_repo_only).orderBy("hash", "normalized_len", F.size("files")), "file_duplicates")
                shown = sinks.text_files(result, args.localization)
        counts = sinks.stats_of(stats)
        for name, n in listing.items():
            counts[sinks.camel(name)] = n if name == "candidate_files" else counts[sinks.camel(name)] + n
    except (InvalidOption, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.json:
        print(sinks.as_json(result, kind, counts if args.stats else None))
    else:
        print(shown, end="")
        if args.stats:
            print(sinks.text_stats(counts), file=sys.stderr)
    lost = [c for c in report.FATAL if counts[sinks.camel(c)]]
    if lost:
        print("warning: the scan is not complete: " + ", ".join(f"{c}={counts[sinks.camel(c)]}" for c in lost), file=sys.stderr)
    return int(args.strict and bool(lost))


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
