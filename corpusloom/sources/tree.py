"""Corpora from directory trees.

Listing is work of the driver: it yields paths and sizes, never contents.  Contents
are read by Spark's binaryFile source, with the size limit pushed into it.
"""

from __future__ import annotations

import fnmatch
import os
import re
import stat as stats
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import InvalidOption, ScanOptions


def check_roots(roots: list[str]) -> list[str]:
    """Real paths of roots; each must be a directory."""
    for r in roots:
        if not os.path.isdir(r):
            raise InvalidOption(f"not a directory: {r}")
    return [os.path.realpath(r) for r in roots]


def label(root: str, number: int) -> str:
    return os.path.basename(root.rstrip("/")) or f"repo{number}"


def is_safe(path: str) -> bool:
    """Relative, and nothing but plain names between the slashes."""
    parts = path.split("/")
    return bool(path) and not path.startswith("/") and parts[0] != "." and ".." not in parts


def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern on a relative path, negated, directories only) of an ignore line."""
    line = line.rstrip("\n\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    line = line[1:] if line.startswith("\\") and line[1:2] in ("#", "!") else line
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + fnmatch.translate(line[i : end + 1]).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z"), end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folder


@dataclass
class Listing:
    """Files of one root and what was left out, by counter."""

    files: list[tuple[str, str, int]] = field(default_factory=list)  # path, real path, size
    counters: dict[str, int] = field(default_factory=dict)

    def count(self, name: str) -> None:
        self.counters[name] = self.counters.get(name, 0) + 1


def _git_paths(root: str) -> list[str] | None:
    """What git lists under a root: tracked, and neither tracked nor ignored."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True, timeout=600)
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted({os.fsdecode(p) for p in done.stdout.split(b"\0") if p})


def _walked(root: str, options: ScanOptions, out: Listing) -> Iterator[str]:
    """Relative paths below a root, by its own ignore files, hidden files included."""
    stack: list[tuple[str, list[tuple[str, list]], frozenset[str]]] = [("", [], frozenset([os.path.realpath(root)]))]
    while stack:
        folder, rules, above = stack.pop()
        here = os.path.join(root, folder)
        if options.respect_gitignore and os.path.isfile(os.path.join(here, ".gitignore")):
            lines = Path(here, ".gitignore").read_text(errors="replace").split("\n")
            rules = [*rules, (folder, [r for r in map(_rule, lines) if r])]
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except PermissionError:
            out.count("skipped_permission_denied")
            continue
        except OSError:
            out.count("skipped_walk_errors")
            continue
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            linked = e.is_symlink()
            if linked and not options.follow_symlinks:
                continue
            is_dir = e.is_dir()
            ignored = False
            for base, patterns in rules:
                inner = path[len(base) + 1 :] if base else path
                for pattern, negated, folders in patterns:
                    if (is_dir or not folders) and pattern.match(inner):
                        ignored = not negated
            if ignored:
                continue
            if not is_dir:
                yield path
            elif e.name not in options.ignore_dirs:
                real = os.path.realpath(e.path)
                if linked and os.path.commonpath([real, os.path.realpath(root)]) != os.path.realpath(root):
                    out.count("skipped_outside_root")
                elif real not in above:  # a link to a folder above it would never end
                    stack.append((path, rules, above | {real}))


def listed(root: str, options: ScanOptions) -> Listing:
    """Regular files of a root.  Git lists them if it can and may; else the tree is
    walked, and what was listed before is not listed again."""
    out, real_root, paths = Listing(), os.path.realpath(root), None
    if options.respect_gitignore and not options.follow_symlinks and os.path.exists(os.path.join(root, ".git")):
        paths = _git_paths(root)
        if paths is None:
            out.count("git_fast_path_fallbacks")
    for path in paths if paths is not None else _walked(root, options, out):
        if not is_safe(path):
            out.count("skipped_outside_root")
            continue
        if any(d in options.ignore_dirs for d in path.split("/")[:-1]):
            continue
        whole = os.path.join(root, path)
        try:
            info = os.lstat(whole)
            if stats.S_ISLNK(info.st_mode):
                if not options.follow_symlinks:
                    continue
                real = os.path.realpath(whole)
                if os.path.commonpath([real, real_root]) != real_root:
                    out.count("skipped_outside_root")
                    continue
                info = os.stat(real)
                whole = real
            if not stats.S_ISREG(info.st_mode):
                continue
            out.count("candidate_files")
            if not os.access(whole, os.R_OK):
                out.count("skipped_permission_denied")
                continue
        except FileNotFoundError:
            out.count("skipped_not_found")
            continue
        except OSError:
            out.count("skipped_walk_errors")
            continue
        out.files.append((path, whole, info.st_size))
    out.files.sort()
    return out


def corpus(spark: SparkSession, roots: list[str], options: ScanOptions | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(corpus, counters of the listing) of some directories."""
    options = options or ScanOptions()
    rows, counters = [], {}
    for number, root in enumerate(check_roots(roots)):
        found = listed(root, options)
        rows += [(number, label(root, number), path, real, size) for path, real, size in found.files]
        for name, n in found.counters.items():
            counters[name] = counters.get(name, 0) + n
    listing = spark.createDataFrame(rows, "repo_id int, repo_label string, path string, real string, size long")
    small = [r for r in rows if options.max_file_size is None or r[4] <= options.max_file_size]
    large = listing.where(F.col("size") > options.max_file_size) if options.max_file_size is not None else listing.limit(0)
    counters["skipped_too_large"] = len(rows) - len(small)
    if not small:
        return listing.select("repo_id", "repo_label", "path", F.lit(b"").alias("content")).limit(0), counters
    del large
    # a glob character in a name must not be taken for a pattern
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r[3]) for r in dict.fromkeys(small)]
    read = spark.read.format("binaryFile").load(sorted(set(literal)))
    read = read.select(F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))).alias("real"), "content")
    return listing.join(read, "real").select("repo_id", "repo_label", "path", "content"), counters
