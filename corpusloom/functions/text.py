"""Column functions: normalisation, hashes as hex strings, previews."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import kernels

BLANK = r"[ \t\n\f\r]"
NOT_CODE = "[^A-Za-z0-9_]"


def without_blanks(text: Column) -> Column:
    """ASCII white space off; a vertical tab is none."""
    return F.regexp_replace(text, BLANK, "")


def code_chars(text: Column) -> Column:
    return F.regexp_replace(text, NOT_CODE, "")


def code_lines(text: Column) -> Column:
    """For each kept character the number of its line, from 1 on."""
    counts = F.transform(F.split(text, "\n"), lambda line: F.length(code_chars(line)))
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i + 1, n)))


def safe_path(path: Column) -> Column:
    """Relative, not empty, and nothing but names between its slashes."""
    parts = F.split(path, "/")
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.exists(parts, lambda p: p.isin("..", ".")) & (F.element_at(parts, 1) != "")


def in_ignored_dir(path: Column, names: tuple[str, ...]) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(folders, lambda d: d.isin(*names)) if names else F.lit(False)


def hex64(value: int) -> str:
    return f"{int(value) & (1 << 64) - 1:016x}"


def _hashing(width: int, decode):
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            out = pd.Series([None] * len(batch), dtype=object)
            out[known.to_numpy()] = [hex64(h) for h in kernels.fnv_many([decode(x) for x in batch[known]], width)]
            yield out

    return run


fnv_text = _hashing(1, lambda x: np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8))
fnv_chars = _hashing(4, lambda x: np.frombuffer(x.encode("utf-8", "surrogatepass"), np.uint8))
fnv_symbols = _hashing(4, lambda x: np.frombuffer(x, "<u4"))


def cut_bytes(text: str, most: int) -> str:
    """The longest start of a text that has at most so many UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def line_preview(text: str, first: int, last: int, most: int = 120) -> str:
    """Lines first..last joined by line ends, which are only put after something."""
    out = ""
    for line in text.split("\n")[first - 1 : last]:
        line = line.removesuffix("\r")
        out = f"{out}\n{line}" if out else line
        if len(out.encode("utf-8", "surrogatepass")) >= most:
            break
    return cut_bytes(out, most)


@F.pandas_udf(StringType())
def preview(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([line_preview(t, a, b) for t, a, b in zip(text, first, last, strict=True)], dtype=object)
