"""Results as JSON and as text.  Sections are short by their options' limits."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, Row

from .report import COUNTERS, SECTIONS

WORDS = {
    "en": {"groups": "duplicate groups", "spans": "duplicate code span groups", "pairs": "similar pairs"},
    "zh": {"groups": "重复文件组", "spans": "疑似重复代码片段组", "pairs": "相似对"},
}


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(r.capitalize() for r in rest)


def plain(value: Any) -> Any:
    """Rows as dictionaries with camel-case names."""
    if isinstance(value, Row):
        return {camel(k): plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows_of(section: DataFrame, name: str) -> list[dict]:
    """A section's rows in the shape of the JSON output."""
    if not section.columns:
        return []
    want = ["hash", "normalized_len", "files"] if name == "file_duplicates" else ["a", "b", "score", "distance"] if name.startswith("similar") else ["hash", "normalized_len", "preview", "occurrences"]
    return [plain(r) for r in section.select(*[c for c in want if c in section.columns]).collect()]


def stats_of(stats: DataFrame) -> dict[str, int]:
    row = stats.first()
    return {camel(c): row[c] for c in COUNTERS}


def as_json(result: Any, kind: str, stats: dict | None = None) -> str:
    if stats is not None:
        result = {kind: result, "scanStats": stats}
    return json.dumps(result, indent=2, ensure_ascii=False)


def _place(o: dict) -> str:
    return f"[{o['repoLabel']}] {o['path']}:{o['startLine']}-{o['endLine']}"


def text_files(groups: list[dict], language: str = "en") -> str:
    out = [f"{WORDS[language]['groups']}: {len(groups)}"]
    for g in groups:
        out += ["", f"hash={g['hash']} normalized_len={g['normalizedLen']} files={len(g['files'])}"]
        out += [f"- [{f['repoLabel']}] {f['path']}" for f in g["files"]]
    return "\n".join([*out, "", ""])


def text_spans(groups: list[dict], language: str = "en") -> str:
    out = [f"{WORDS[language]['spans']}: {len(groups)}"]
    for g in groups:
        out += ["", f"hash={g['hash']} normalized_len={g['normalizedLen']} occurrences={len(g['occurrences'])}", f"preview={g['preview']}"]
        out += [f"- {_place(o)}" for o in g["occurrences"]]
    return "\n".join([*out, "", ""])


def text_pairs(pairs: list[dict], language: str = "en") -> str:
    out = [f"{WORDS[language]['pairs']}: {len(pairs)}"]
    for p in pairs:
        far = "" if p["distance"] is None else f" distance={p['distance']}"
        out += [f"score={p['score']:g}{far}", f"- A {_place(p['a'])}", f"- B {_place(p['b'])}"]
    return "\n".join([*out, "", ""])


def text_report(report: dict[str, list[dict]], language: str = "en") -> str:
    out = []
    for name in SECTIONS:
        rows = report[camel(name)]
        body = text_files(rows, language) if name == "file_duplicates" else text_pairs(rows, language) if name.startswith("similar") else text_spans(rows, language)
        out.append(f"== {name} ==\n{body}")
    return "\n".join(out)


def text_stats(stats: dict[str, int]) -> str:
    return "\n".join(["scan stats:", *[f"  {k}: {v}" for k, v in stats.items()], ""])
