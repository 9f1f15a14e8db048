"""Scan and detection options with their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

# Directories that a scan leaves out by default.
IGNORED_DIRS = (".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "out", ".next", ".turbo", ".cache")
REPORT_BYTES = 256 * 1024 * 1024


class InvalidOption(ValueError):
    """An option outside its range."""


@dataclass(frozen=True)
class ScanOptions:
    ignore_dirs: tuple[str, ...] = IGNORED_DIRS
    max_file_size: int | None = 10 * 1024 * 1024
    max_files: int | None = None
    max_total_bytes: int | None = None
    max_normalized_chars: int | None = None
    max_tokens: int | None = None
    min_match_len: int = 50
    min_token_len: int = 50
    similarity_threshold: float = 0.85
    simhash_max_distance: int = 3
    max_report_items: int = 200
    respect_gitignore: bool = True
    cross_repo_only: bool = False
    follow_symlinks: bool = False
    max_bucket: int | None = 512  # occurrences of one fingerprint; None: all

    def for_spans(self) -> ScanOptions:
        if self.min_match_len < 1:
            raise InvalidOption("min_match_len must be at least 1")
        return self

    def for_report(self) -> ScanOptions:
        """Checked, with the budgets that a report has by default."""
        self.for_spans()
        if self.min_token_len < 1:
            raise InvalidOption("min_token_len must be at least 1")
        if not math.isfinite(self.similarity_threshold) or not 0 <= self.similarity_threshold <= 1:
            raise InvalidOption("similarity_threshold must be a number from 0 to 1")
        if not 0 <= self.simhash_max_distance <= 64:
            raise InvalidOption("simhash_max_distance must be from 0 to 64")
        total = REPORT_BYTES if self.max_total_bytes is None else self.max_total_bytes
        chars = total if self.max_normalized_chars is None else self.max_normalized_chars
        return replace(self, max_total_bytes=total, max_normalized_chars=chars, max_tokens=total // 4 if self.max_tokens is None else self.max_tokens)
