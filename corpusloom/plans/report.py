"""The full report: eight lazy sections over one prepared corpus, and scan counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..operators import blocks, budgets, files, prepare, spans
from ..options import ScanOptions
from ..sources.shared import Stage

COUNTERS = (
    "candidate_files scanned_files scanned_bytes git_fast_path_fallbacks skipped_not_found skipped_permission_denied skipped_too_large skipped_binary "
    "skipped_outside_root skipped_relativize_failed skipped_walk_errors skipped_budget_max_files skipped_budget_max_total_bytes "
    "skipped_budget_max_normalized_chars skipped_budget_max_tokens skipped_bucket_truncated"
).split()
FATAL = [c for c in COUNTERS if c.startswith("skipped_") and c not in ("skipped_not_found", "skipped_too_large", "skipped_binary")]
SECTIONS = (
    "file_duplicates code_span_duplicates line_span_duplicates token_span_duplicates block_duplicates ast_subtree_duplicates similar_blocks_minhash similar_blocks_simhash"
).split()


_PLACE = "struct<repo_id:int,repo_label:string,path:string,start_line:int,end_line:int>"
_GROUP = f"hash string, normalized_len long, n_members long, n_repos long, occurrences array<{_PLACE}>, preview string"
_PAIR = f"a {_PLACE}, b {_PLACE}, score double, distance int"
SCHEMAS = dict(
    zip(SECTIONS, ["hash string, normalized_len long, files array<struct<repo_id:int,repo_label:string,path:string>>, n_members int", *[_GROUP] * 5, _PAIR, _PAIR], strict=True)
)


def _has_nul() -> F.Column:
    return F.contains(F.col("content"), F.lit(bytearray(b"\x00")))


def scanned(corpus: DataFrame, options: ScanOptions, report: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files that detectors read, counters).  A scan goes by (repo_id, path) and
    stops for good behind the file that is the last of max_files, or at the text file
    that takes characters or tokens over their budget; a file too large for what is
    left of the bytes is only skipped.  Files behind the stop aren't even candidates.
    Names and sizes are written once; budgets are worked out on them."""
    here, size = F.struct(*budgets.ORDER), F.octet_length("content").cast("long")
    limit = F.lit(True) if options.max_file_size is None else F.col("size") <= options.max_file_size
    columns = {"size": size, "binary": _has_nul()}
    if options.max_normalized_chars is not None:
        columns["n_chars"] = F.length(text.code_chars(prepare.lossy(F.col("content")))).cast("long")
    meta = corpus.select("repo_id", "path", *[c.alias(n) for n, c in columns.items()])
    if report and options.max_tokens is not None:
        meta = meta.join(prepare.token_numbers(corpus), ["repo_id", "path"])
    meta = Stage(corpus.sparkSession, "scan").write(meta, "files")

    allowed = limit
    if options.max_total_bytes is not None:
        allowed = limit & budgets.greedy_condition(meta.where(limit), "size", options.max_total_bytes)
    readable = allowed & ~F.col("binary")
    # the places where a scan can stop; of one file, the first in this order counts
    stops = []
    if options.max_normalized_chars is not None:
        counted = readable if report else readable & (F.col("n_chars") >= options.min_match_len)
        stops.append((budgets.first_over(meta.where(counted), "n_chars", options.max_normalized_chars), "skipped_budget_max_normalized_chars"))
    if report and options.max_tokens is not None:
        before = readable & (here < budgets.place(stops[0][0])) if stops and stops[0][0] else readable
        stops.append((budgets.first_over(meta.where(before), "n_tokens", options.max_tokens), "skipped_budget_max_tokens"))
    if options.max_files:
        found = budgets.first_files(meta.where(allowed), options.max_files).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*budgets.ORDER)).alias("o")).first()
        stops.append((found.o if found.n == options.max_files else None, "skipped_budget_max_files"))
    stop, why = min(((o, w) for o, w in stops if o is not None), key=lambda x: (x[0].repo_id, x[0].path.encode()), default=(None, None))
    seen, read = F.lit(True), readable
    if options.max_files == 0:
        seen, read, why = F.lit(False), F.lit(False), "skipped_budget_max_files"
    elif stop is not None:
        seen = here <= budgets.place(stop)
        read = readable & (seen if why == "skipped_budget_max_files" else here < budgets.place(stop))
    stats = meta.where(seen).agg(
        F.count(F.lit(1)).alias("candidate_files"),
        F.count_if(allowed).alias("scanned_files"),
        F.coalesce(F.sum(F.when(allowed, F.col("size"))), F.lit(0)).cast("long").alias("scanned_bytes"),
        F.count_if(~limit).alias("skipped_too_large"),
        F.count_if(allowed & F.col("binary")).alias("skipped_binary"),
        F.count_if(limit & ~allowed).alias("skipped_budget_max_total_bytes"),
    )
    for c in COUNTERS:
        if c not in stats.columns:
            stats = stats.withColumn(c, F.lit(int(c == why)).cast("long"))
    kept = corpus.withColumns({"size": size, "binary": _has_nul()}).where(read)
    return kept.drop("size", "binary"), stats.select(*COUNTERS)


def scan_stats(corpus: DataFrame, options: ScanOptions) -> DataFrame:
    return scanned(corpus, options)[1]


def fatal(stats: DataFrame) -> bool:
    """Whether a scan left out something that a strict run must not."""
    row = stats.first()
    return any(row[c] for c in FATAL)


def top(groups: DataFrame, most: int) -> DataFrame:
    return groups.orderBy(F.desc("n_members"), F.desc("normalized_len"), "hash", F.to_json("occurrences")).limit(most)


def with_previews(groups: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds the lines of the first occurrence; for the few groups of a section."""
    first = F.element_at("occurrences", 1)
    heads = groups.withColumns({"__r": first["repo_id"], "__p": first["path"], "__a": first["start_line"], "__b": first["end_line"]})
    own = corpus.select(F.col("repo_id").alias("__r"), F.col("path").alias("__p"), prepare.lossy(F.col("content")).alias("__t"))
    return heads.join(own, ["__r", "__p"]).withColumn("preview", text.preview("__t", "__a", "__b")).drop("__r", "__p", "__a", "__b", "__t")


def _letters() -> F.Column:
    """The first 80 characters of a sample; every fourth byte is one."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.col("normalized_len"), F.lit(80)).cast("int") - 1), lambda i: F.decode(F.substring(F.col("sample"), i * 4 + 1, F.lit(1)), "utf-8")), "")


def top_spans(docs: DataFrame, options: ScanOptions) -> DataFrame:
    """The first code span groups with their previews of 80 characters."""
    params = spans.SpanParams.exact(options.min_match_len, cross_repo_only=options.cross_repo_only, max_bucket=options.max_bucket)
    groups = spans.span_counts(docs, "char", params).orderBy(F.desc("n_members"), F.desc("normalized_len"), "hash", "first").limit(options.max_report_items)
    found = spans.with_samples(groups, docs, "char", params)
    return found.select("hash", "normalized_len", "n_members", "n_repos", _letters().alias("preview"))


@dataclass
class Report:
    """Eight sections, none computed before it is asked for, and the scan's counters."""

    sections: dict[str, DataFrame]
    stats: DataFrame

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["sections"][name]
        except KeyError:
            raise AttributeError(name) from None


def generate(corpus: DataFrame, options: ScanOptions) -> Report:
    """All sections.  With max_report_items 0 nothing is scanned."""
    options = options.for_report()
    if not options.max_report_items:
        spark = corpus.sparkSession
        zero = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in COUNTERS])
        return Report({s: spark.createDataFrame([], SCHEMAS[s]) for s in SECTIONS}, zero)
    kept, stats = scanned(corpus, options, report=True)
    docs = prepare.numbered(kept)
    cross, most, cap = options.cross_repo_only, options.max_report_items, options.max_bucket
    tokens = prepare.token_symbols(docs)
    by_kind = {
        "code": ("char", spans.SpanParams.exact(options.min_match_len, cross_repo_only=cross, max_bucket=cap)),
        "line": ("line", spans.SpanParams(2, 2, 8, cross, cap, options.min_match_len)),
        "token": ("token", spans.SpanParams.exact(options.min_token_len, cross_repo_only=cross, max_bucket=cap)),
    }
    shown = lambda g: with_previews(top(g, most), kept)
    sections = {"file_duplicates": files.nested(kept, cross).withColumn("n_members", F.size("files")).orderBy(F.desc("n_members"), F.desc("normalized_len"), "hash").limit(most)}
    for kind, (symbols, params) in by_kind.items():
        found = spans.span_groups(docs, symbols, params, most)
        sections[f"{kind}_span_duplicates"] = top(found, most).withColumn("preview", _letters()) if kind == "code" else shown(found)
    sections["block_duplicates"] = shown(blocks.duplicate_blocks(tokens, docs, options.min_token_len, cross))
    sections["ast_subtree_duplicates"] = shown(blocks.duplicate_subtrees(tokens, docs, options.min_token_len, cross))
    signed = blocks.staged(blocks.signed_blocks(docs, options.min_token_len))
    names = docs.select("file_id", "repo_id", "repo_label", "path")

    def pairs(found: DataFrame) -> DataFrame:
        for side in "ab":
            own = names.select(*[F.col(c).alias(f"__{c}") for c in names.columns])
            place = F.struct(F.col("__repo_id").alias("repo_id"), F.col("__repo_label").alias("repo_label"), F.col("__path").alias("path"), F.col(f"start_line_{side}").alias("start_line"), F.col(f"end_line_{side}").alias("end_line"))
            found = found.join(own, found[f"file_id_{side}"] == F.col("__file_id")).withColumn(side, place).drop(*own.columns)
        # the smaller place first, whatever the numbers of the files
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "distance")
        return found.orderBy(F.desc("score"), "a", "b").limit(most)

    sections["similar_blocks_minhash"] = pairs(blocks.minhash_pairs(signed, options.similarity_threshold, cross))
    sections["similar_blocks_simhash"] = pairs(blocks.simhash_pairs(signed, options.simhash_max_distance, cross))
    if cap is not None:
        cut = [spans.truncated(spans.fingerprints(docs, s, p), cap).agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("n")) for s, p in by_kind.values()]
        total = cut[0].unionByName(cut[1]).unionByName(cut[2]).agg(F.sum("n").cast("long").alias("__cut"))
        stats = stats.crossJoin(F.broadcast(total)).withColumn("skipped_bucket_truncated", F.col("__cut")).drop("__cut")  # one row by one row
    return Report({s: sections[s].select(*StructType.fromDDL(SCHEMAS[s]).names) for s in SECTIONS}, stats)
