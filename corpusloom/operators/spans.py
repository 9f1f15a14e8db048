"""Maximal repeated spans of symbols: one engine for characters, lines and tokens.

Fingerprints are winnowed in each file.  Buckets of equal ones are dealt by hash; in
a bucket, two fingerprints are a seed of the diagonal (file a, file b, distance).
Seeds that follow each other on a diagonal are known from the bucket alone, since
each fingerprint carries a hash of the symbols up to its neighbours: only the first
and the last seed of a run are events, and each also tells, from the symbols around
it, how far the run goes beyond it.  A run of one seed ends where it starts, and
needs no shuffle; events of longer ones meet by file pair.  Places of runs, each
once, go back to their files, which give them a digest and lines; places of one
digest are a group.  Texts are shuffled once to get fingerprints' surroundings and
once for digests, and to a pair of files only for runs whose ends aren't in sight;
of lines, symbols are shuffled in place of texts.

Without a cap (`max_bucket=None`) no pairs are made.  A bucket's places are told apart
symbol by symbol, as in a trie of what follows them; where a branch of it parts, counts
of what lies before the places tell which of them end a common stretch there.  See
`maximal`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import Stage, release
from . import prepare


@dataclass(frozen=True)
class SpanParams:
    min_len: int
    k: int
    w: int
    cross_repo_only: bool = False
    max_bucket: int | None = 512  # occurrences of one fingerprint; None: all of them, by `exactly`
    min_chars: int = 0  # of the sizes of a span's symbols

    @classmethod
    def exact(cls, min_len: int, **more) -> SpanParams:
        """k and w with k + w - 1 = min_len, so every match has a fingerprint."""
        k = max(1, min(25, min_len // 2 if min_len > 1 else 1))
        return cls(min_len, k, min_len - k + 1, **more)


LINES = SpanParams(2, 2, 8)
FAR = 64  # symbols between neighbours that are hashed as a link
AHEAD = 64  # symbols carried from a fingerprint on where no bucket is cut; more only for those that agree so far
WIDE = 128  # symbols carried around a fingerprint beside which others were cut
PACKED = {"char": 1 << 20, "line": 1 << 17, "token": 1 << 20}  # bytes of packed bodies that are read at once
# Bytes of a symbol; tokens are numbered anew to fit into two.
CODES = {"char": np.dtype("u1"), "line": np.dtype("<u4"), "token": np.dtype("<u2")}


def coded(kind: str, values: np.ndarray) -> np.ndarray:
    if kind == "token":
        return np.where(values >= kernels.PUNCT, values - kernels.PUNCT + 1000, values).astype("<u2")
    return values.astype(CODES[kind])


def _bodies(files: DataFrame, *more: str) -> DataFrame:
    return files.select("file_id", "repo_id", *more, prepare.lossy(F.col("content")).alias("body"))


def _packed(files: DataFrame, kind: str, *more: str) -> DataFrame:
    """Bodies compressed, for a shuffle: `size` is the length of a body.  Of lines only
    symbols, numbers and sizes are needed, far fewer bytes than their text."""
    rows = _bodies(files, *more)
    kept = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in prepare.slabs(whole, "body", 1 << 20):
                texts = prepare.bytes_of(batch.column("body"))
                if kind == "line":
                    texts = [_line_bytes(s) for s in prepare.read_lines(texts)]
                packed = [pa.array([len(t) for t in texts], pa.int32()), pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *packed], [*kept, "size", "body"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "body"]
    return rows.mapInArrow(run, ", ".join([*fields, "size int", "body binary"]))


def _line_bytes(symbols: prepare.Symbols) -> bytes:
    numbers = np.diff(symbols.lines(np.arange(len(symbols.values))), prepend=0)
    return np.concatenate([symbols.values, numbers, symbols.sizes]).astype("<u4").tobytes()


def _line_symbols(packed: bytes) -> prepare.Symbols:
    values, numbers, sizes = np.frombuffer(packed, "<u4").reshape(3, -1)
    return prepare.Symbols(values, np.cumsum(numbers, dtype=np.int64).__getitem__, sizes.astype(np.int64))


def _unpacked(kind: str, sizes: pa.Array, bodies: pa.Array) -> list[prepare.Symbols]:
    raw = [pa.decompress(b, n, "zstd", asbytes=True) for b, n in zip(bodies.to_pylist(), sizes.to_pylist(), strict=True)]
    return [_line_symbols(r) for r in raw] if kind == "line" else prepare.READERS[kind](raw)


def fingerprints(files: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """(hash, repo_id, file_id, pos) with the hash's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in prepare.slabs(whole, "body", 1 << 20):
                found = [kernels.winnowed(s.values, params.k, params.w) for s in prepare.READERS[kind](prepare.bytes_of(batch.column("body")))]
                size = np.array([len(at) for at, _ in found])
                if size.sum():
                    own = [pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("repo_id", "file_id")]
                    at, h = (np.concatenate([f[i] for f in found]) for i in range(2))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *own, pa.array(at.astype(np.int32))], ["hash", "repo_id", "file_id", "pos"])

    # a text too short for a match has no fingerprint: drop it before Python starts
    rows = _bodies(files)
    least = 2 * params.min_len - 1 if kind == "line" else 1 if kind == "token" else params.min_len
    return rows.where(F.octet_length("body") >= least).mapInArrow(run, "hash long, repo_id int, file_id long, pos int")


def _turns(of: np.ndarray, repo: np.ndarray) -> np.ndarray:
    """For rows in the order of bucket and root, each row's number in its root."""
    first = np.concatenate([[True], (of[1:] != of[:-1]) | (repo[1:] != repo[:-1])])
    heads = np.flatnonzero(first)
    return np.arange(len(of)) - np.repeat(heads, np.diff(np.append(heads, len(of))))


def buckets(prints: DataFrame, max_bucket: int | None) -> DataFrame:
    """(file_id, repo_id, pos, cut) of fingerprints whose hash occurs more than once.
    Of a hash with more than `max_bucket` occurrences, roots give one in turn, in the
    order of file and position; `cut` marks what is left of such.  A bucket streams
    through: of one still growing only the first `max_bucket` of each root are held."""
    cap = max_bucket

    def ordered(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in ("pos", "file_id", "repo_id", "hash")])))

    def thin(table: pa.Table) -> pa.Table:
        if cap is None or table.num_rows <= cap:
            return table
        table = ordered(table)
        # one more than can be kept, so that a cut bucket stays above the cap
        return table.filter(pa.array(_turns(np.zeros(table.num_rows), table.column("repo_id").to_numpy()) <= cap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in prepare.whole_groups(batches, ["hash"], thin=thin):
            of = prepare.group_numbers(table, ["hash"])
            n = np.bincount(of)[of]
            columns = ["file_id", "repo_id", "pos"]
            large = n > cap if cap is not None else np.zeros(len(n), dtype=bool)
            small = table.select(columns).filter(pa.array((n > 1) & ~large))
            yield from small.append_column("cut", pa.array(np.zeros(small.num_rows, dtype=bool))).combine_chunks().to_batches()
            if large.any():
                part = ordered(table.filter(pa.array(large)))
                of, repo = prepare.group_numbers(part, ["hash"]), part.column("repo_id").to_numpy()
                order = np.lexsort((repo, _turns(of, repo), of))
                place = np.empty(len(of), dtype=np.int64)
                place[order] = _turns(of[order], np.zeros(len(of)))
                part = part.select(columns).filter(pa.array(place < cap))
                yield from part.append_column("cut", pa.array(np.ones(part.num_rows, dtype=bool))).combine_chunks().to_batches()

    return prepare.dealt(prints, ["hash"]).mapInArrow(run, "file_id long, repo_id int, pos int, cut boolean")


def truncated(prints: DataFrame, max_bucket: int) -> DataFrame:
    """(hash, n, dropped) of the buckets that the cap cuts."""
    return prints.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket).withColumn("dropped", F.col("n") - max_bucket)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        h = kernels.splitmix(h ^ p.astype(np.uint64))
    return h


def _links(values: np.ndarray, at: np.ndarray, h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For neighbours at[i] and at[i + 1] a hash of the symbols from the first through
    the second's k-gram; of neighbours far apart, a number that no other row has."""
    gap = np.diff(at)
    near = np.flatnonzero(gap <= FAR)
    out = _mixed(own[:-1], at[:-1], np.full(len(gap), 7))
    total, left, start, size = np.zeros(len(near), dtype=np.uint64), np.arange(len(near)), at[:-1][near], gap[near]
    with np.errstate(over="ignore"):
        for j in range(int(size.max()) if len(size) else 0):
            left = left[size[left] > j]
            total[left] = total[left] * kernels.POLY + values[start[left] + j].astype(np.uint64) + np.uint64(1)
    out[near] = _mixed(total, size, h[1:][near])
    return out


def surroundings(files: DataFrame, kept: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """What a bucket needs of each kept fingerprint: links to its neighbours in the
    file, the symbols before it (the nearest first) and behind it, and whether those
    reach the file's start and end."""
    schema = "hash long, file_id long, repo_id int, pos int, before long, behind long, left_ binary, right_ binary, edges int"
    k, w, width = params.k, params.w, CODES[kind].itemsize
    places = kept.groupBy("file_id").agg(F.collect_list(F.struct("pos", "cut")).alias("places"))
    rows = _packed(files, kind).join(places, "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for whole in batches:
            for batch in prepare.slabs(whole, "body", PACKED[kind]):
                read = _unpacked(kind, batch.column("size"), batch.column("body"))
                out: list[list] = [[] for _ in names]
                for file, repo, where, symbols in zip(batch.column("file_id").to_pylist(), batch.column("repo_id").to_pylist(), batch.column("places"), read, strict=True):
                    at = where.values.field("pos").to_numpy().astype(np.int64)
                    order = np.argsort(at)
                    at, cut = at[order], where.values.field("cut").to_numpy(zero_copy_only=False)[order]
                    values, n = symbols.values, len(symbols.values)
                    h = kernels.poly_hashes(values, k)[at]
                    own = np.full(len(at), file, dtype=np.int64)
                    link = _links(values, at, h, own)
                    alone = _mixed(own[:1], own[:1], np.array([3])), _mixed(own[:1], own[:1], np.array([5]))
                    gap = np.diff(at, prepend=-1, append=n + 1)
                    odd = cut | (gap[:-1] > w)
                    odd[1:] |= cut[:-1]
                    odd_ = cut | (gap[1:] > w)
                    odd_[:-1] |= cut[1:]
                    a = np.minimum(at, np.where(odd, WIDE, w))
                    b = np.minimum(n - at - k, np.where(odd_, WIDE, w))
                    forth = coded(kind, values).tobytes()
                    back = coded(kind, values[::-1]).tobytes()
                    columns = [
                        h.view(np.int64), own, np.full(len(at), repo, dtype=np.int32), at.astype(np.int32),
                        np.concatenate([alone[0], link]).view(np.int64), np.concatenate([link, alone[1]]).view(np.int64),
                        [back[(n - p) * width : (n - p + m) * width] for p, m in zip(at.tolist(), a.tolist(), strict=True)],
                        [forth[(p + k) * width : (p + k + m) * width] for p, m in zip(at.tolist(), b.tolist(), strict=True)],
                        ((a == at) + 2 * (b == n - at - k)).astype(np.int32),
                    ]
                    for held, column in zip(out, columns, strict=True):
                        held.append(column)
                if out[0]:
                    arrays = [pa.array([x for part in c for x in part], pa.binary()) if isinstance(c[0], list) else pa.array(np.concatenate(c)) for c in out]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, schema)


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """([row, word], lengths in bytes) of a binary column, filled up with zeros."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    size = np.diff(offsets)
    most = max(8, -(-int(size.max(initial=0)) // 8) * 8)
    matrix = np.zeros((len(size), most), dtype=np.uint8)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    matrix[np.arange(most) < size[:, None]] = data[offsets[0] : offsets[-1]]
    return matrix.view("<u8"), size


def _common(words: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that rows i and j have in common from their start."""
    out, live = np.minimum(size[i], size[j]), np.arange(len(i))
    for t in range(words.shape[1]):
        differs = words[i[live], t] ^ words[j[live], t]
        ends = differs != 0
        with np.errstate(over="ignore"):
            low = np.bitwise_count((differs[ends] & (~differs[ends] + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        out[live[ends]] = np.minimum(out[live[ends]], 8 * t + low)
        live = live[~ends]
        live = live[out[live] > 8 * (t + 1)]
        if not len(live):
            break
    return out


# Events of a run: what is known at its first seed and at its last.
START, END = 0, 1
EVENT = "fa long, fb long, distance int, pos int, what int, beyond int, sure boolean"
PLACE = "file_id long, start int, len int"


def _batch(schema: str, columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(max(0, len(order) - 1), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    keep = np.concatenate([[True], new]) if len(order) else np.zeros(0, dtype=bool)
    return [c[keep] for c in columns]


def seeds(rows: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """EVENT's columns, of runs of several seeds and of those whose ends aren't in
    sight; and PLACE's columns (as fa, pos, beyond; `what` is null), of spans known
    at once.  A bucket's pairs are looked at but for the few that begin or end a run."""
    width, k = CODES[kind].itemsize, params.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in prepare.whole_groups(batches, ["hash"], 20_000):
            of = prepare.group_numbers(table, ["hash"])
            file, repo, pos, before, behind, edges = (table.column(c).to_numpy() for c in ("file_id", "repo_id", "pos", "before", "behind", "edges"))
            left, right = _words(table.column("left_")), _words(table.column("right_"))
            live, found, held = np.arange(len(of)), [], 0
            for d in range(1, len(of)):
                live = live[live + d < len(of)]
                live = live[of[live] == of[live + d]]
                if not len(live):
                    break
                new = (before[live] != before[live + d]) | (behind[live] != behind[live + d])
                if params.cross_repo_only:
                    new &= repo[live] != repo[live + d]
                found.append(np.stack([live[new], live[new] + d]))
                held += int(new.sum())
                if held >= 1 << 18:
                    yield from events(np.concatenate(found, axis=1), file, pos, before, behind, edges, left, right)
                    found, held = [], 0
            if held:
                yield from events(np.concatenate(found, axis=1), file, pos, before, behind, edges, left, right)

    def events(pairs, file, pos, before, behind, edges, left, right) -> Iterator[pa.RecordBatch]:
        i, j = pairs
        turned = (file[i] > file[j]) | ((file[i] == file[j]) & (pos[i] > pos[j]))
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        starts, ends = before[i] != before[j], behind[i] != behind[j]
        a, b = (_common(*side, i, j) // width for side in (left, right))
        # the symbols in sight end in a difference, or with one of the files
        sure = [(n * width < np.minimum(size[i], size[j])) | ((size[i] == n * width) & (edges[i] & bit > 0)) | ((size[j] == n * width) & (edges[j] & bit > 0)) for n, size, bit in ((a, left[1], 1), (b, right[1], 2))]
        done = starts & ends & sure[0] & sure[1]
        length = a + k + b
        good = done & (length >= params.min_len) & ((file[i] != file[j]) | (pos[j] - pos[i] >= length))
        x = _distinct(np.concatenate([file[i[good]], file[j[good]]]), np.concatenate([(pos[i] - a)[good], (pos[j] - a)[good]]), np.concatenate([length[good]] * 2))
        if len(x[0]):
            none = pa.nulls(len(x[0]), pa.int32())
            yield _batch(EVENT, [x[0], pa.nulls(len(x[0]), pa.int64()), none, x[1], none, x[2], pa.nulls(len(x[0]), pa.bool_())])
        for what, some, beyond, known in ((START, starts & ~done, a, sure[0]), (END, ends & ~done, b, sure[1])):
            if some.any():
                order = np.lexsort((file[j[some]], file[i[some]]))  # neighbours in a shuffle file pack well
                p, q = i[some][order], j[some][order]
                yield _batch(EVENT, [file[p], file[q], pos[q] - pos[p], pos[p], np.full(len(p), what), beyond[some][order], known[some][order]])

    return prepare.dealt(rows, ["hash"]).mapInArrow(run, EVENT)


def joined(events: DataFrame, params: SpanParams) -> DataFrame:
    """Runs from their events: PLACE's columns (as fa, pos, beyond), both places of a
    run; or, where the ends of a run weren't in sight, (fa, fb, distance, pos): a seed."""
    schema = "fa long, fb long, distance int, pos int, beyond int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in prepare.whole_groups(batches, ["fa"]):
            table = table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in ("what", "pos", "distance", "fb", "fa")])))
            of = prepare.group_numbers(table, ["fa", "fb", "distance"])
            fa, fb, distance, pos, what, beyond, sure = (table.column(c.split()[0]).to_numpy() for c in EVENT.split(", "))
            first = np.flatnonzero(what == START)
            last = first + 1  # rows are in the order of place, a start before an end
            start, end = pos[first] - beyond[first], pos[last] + params.k + beyond[last]
            group, sure_a, sure_b = of[first], sure[first], sure[last]
            # runs that touch are parts of one
            order = np.lexsort((start, group))
            first, start, end, group, sure_a, sure_b = (x[order] for x in (first, start, end, group, sure_a, sure_b))
            far = np.int64(1) << 32
            reach = np.maximum.accumulate(end + group * far)
            new = np.concatenate([[True], start[1:] + group[1:] * far > reach[:-1]])
            heads = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            lo, hi = np.minimum.reduceat(start, heads), np.maximum.reduceat(end, heads)
            known = [np.zeros(len(heads), dtype=bool), np.zeros(len(heads), dtype=bool)]
            np.logical_or.at(known[0], run_of, sure_a & (start == lo[run_of]))
            np.logical_or.at(known[1], run_of, sure_b & (end == hi[run_of]))
            at = first[heads]
            a, b, d, n = fa[at], fb[at], distance[at], hi - lo
            whole = known[0] & known[1]
            good = whole & (n >= params.min_len) & ((a != b) | (d >= n))
            x = _distinct(np.concatenate([a[good], b[good]]), np.concatenate([lo[good], (lo + d)[good]]), np.concatenate([n[good]] * 2))
            none = pa.nulls(len(x[0]), pa.int64())
            yield _batch(schema, [x[0], none, none.cast(pa.int32()), x[1], x[2]])
            if not whole.all():
                open_ = ~whole
                yield _batch(schema, [a[open_], b[open_], d[open_], pos[at][open_], pa.nulls(int(open_.sum()), pa.int32())])

    return prepare.dealt(events, ["fa"]).mapInArrow(run, schema)


def runs(a: np.ndarray, b: np.ndarray, starts: list[tuple[int, int]], min_len: int, same: bool) -> list[tuple[int, int, int]]:
    """(start a, start b, length) of the maximal equal runs through the seeds, given
    as (distance, place in a)."""
    out, of = [], {}
    for d, p in starts:
        of.setdefault(d, []).append(p)
    for d, ps in of.items():
        first = max(0, -d)
        n = min(len(a) - first, len(b) - first - d)
        differs = np.flatnonzero(a[first : first + n] != b[first + d : first + d + n])
        at = np.array(ps) - first
        i = np.searchsorted(differs, at)
        begin = np.where(i > 0, differs[np.maximum(i - 1, 0)] + 1 if len(differs) else 0, 0)
        end = np.where(i < len(differs), differs[np.minimum(i, len(differs) - 1)] if len(differs) else n, n)
        hit = end > at  # the seed itself is equal: a hash alone is no proof
        for s, e in set(zip(begin[hit].tolist(), end[hit].tolist(), strict=True)):
            if e - s >= min_len and not (same and d < e - s):
                out.append((first + s, first + s + d, e - s))
    return out


def extended(files: DataFrame, open_: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """PLACE's columns of runs whose ends weren't in sight, from the texts of both
    files.  They lie among more than WIDE symbols of cut fingerprints, so are few."""
    starts = open_.groupBy("fa", "fb").agg(F.collect_set(F.struct("distance", "pos")).alias("starts"))
    packed = _packed(files, kind)  # once: both sides read one shuffle
    side = lambda s: packed.select(F.col("file_id").alias(f"f{s}"), F.col("size").alias(f"size_{s}"), F.col("body").alias(f"body_{s}"))
    rows = starts.join(side("a"), "fa").join(side("b"), "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in prepare.slabs(whole, "body_a", PACKED[kind]):
                for batch in prepare.slabs(half, "body_b", PACKED[kind]):
                    out = set()
                    read = [_unpacked(kind, batch.column(f"size_{s}"), batch.column(f"body_{s}")) for s in "ab"]
                    for fa, fb, seeds_, a, b in zip(*(batch.column(n).to_pylist() for n in ("fa", "fb", "starts")), *read, strict=True):
                        for p, q, n in runs(a.values, b.values, [(s["distance"], s["pos"]) for s in seeds_], params.min_len, fa == fb):
                            out |= {(fa, p, n), (fb, q, n)}
                    yield _batch(PLACE, list(zip(*sorted(out), strict=True)) if out else [[], [], []])

    return rows.select("fa", "fb", "starts", "size_a", "body_a", "size_b", "body_b").mapInArrow(run, PLACE)


def repeated(prints: DataFrame) -> DataFrame:
    """(file_id, pos) of fingerprints whose hash occurs more than once; a bucket of any
    size streams through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, False  # the last row, and whether its hash was seen before
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held else [batch]).combine_chunks()
            h = table.column("hash").to_numpy()
            same = np.concatenate([[known], h[1:] == h[:-1]])
            keep = same[:-1] | same[1:]
            yield from table.select(["file_id", "pos"]).slice(0, len(keep)).filter(pa.array(keep)).combine_chunks().to_batches()
            held, known = table.slice(len(keep)).to_batches()[0], bool(same[-1])
        if known:
            yield held.select(["file_id", "pos"])

    return prepare.dealt(prints, ["hash"]).mapInArrow(run, "file_id long, pos int")


AROUND = "hash long, more long, file_id long, repo_id int, places array<int>, first int, body binary"


def around(packed: DataFrame, kept: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """AROUND's columns: of each place w symbols before it and AHEAD from it on, where
    `first` is the place of the first symbol.  Where kept places have keys (hash, more),
    all of them that share a file and a key share its symbols up to its end."""
    far = "more" in kept.columns
    own = ["hash", "more", "pos"] if far else ["pos"]
    rows = packed.join(kept.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(*own))).alias("places")), "file_id")
    width, names = CODES[kind].itemsize, [x.split()[0] for x in AROUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in prepare.slabs(whole, "body", PACKED[kind]):
                read = _unpacked(kind, batch.column("size"), batch.column("body"))
                for file, repo, where, symbols in zip(batch.column("file_id").to_pylist(), batch.column("repo_id").to_pylist(), batch.column("places"), read, strict=True):
                    n = len(symbols.values)
                    code = coded(kind, symbols.values).tobytes()
                    at = where.values.field("pos").to_numpy().astype(np.int64)
                    if far:
                        keys = [where.values.field(c).to_numpy() for c in ("hash", "more")]
                        heads = np.flatnonzero(np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])]))
                        ends = np.full(len(heads), n)
                    else:
                        keys = [kernels.poly_hashes(symbols.values, params.k)[at].view(np.int64), np.zeros(len(at), dtype=np.int64)]
                        heads, ends = np.arange(len(at)), np.minimum(at + AHEAD, n)
                    first = np.maximum(at[heads] - params.w, 0)
                    most = np.append(np.flatnonzero(np.diff(np.cumsum((ends - first) * width) >> 22)) + 1, len(heads))  # of many places or classes, some MB at once
                    for a, b in zip([0, *most[:-1]], most, strict=True):
                        bounds = np.append(heads[a:b], heads[b] if b < len(heads) else len(at))
                        places = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(at[bounds[0] : bounds[-1]], pa.int32()))
                        bodies = [code[p * width : q * width] for p, q in zip(first[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                        few = [pa.array(k[heads[a:b]]) for k in keys] + [pa.array(np.full(b - a, file)), pa.array(np.full(b - a, repo), pa.int32())]
                        yield pa.RecordBatch.from_arrays([*few, places, pa.array(first[a:b], pa.int32()), pa.array(bodies, pa.binary())], names)

    return rows.select("file_id", "repo_id", "size", "body", "places").mapInArrow(run, AROUND)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """For each row a number of its combination of values."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _partner(group: np.ndarray, x: np.ndarray, y: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each row the row of least rank in its group that differs from it in x and in
    y, or -1.  Five rows of a group answer that for all others: the first; the first
    that differs from it in x, and of such the first that differs from that in y; and
    so with x and y exchanged."""
    order = np.lexsort((rank, group))
    g, x, y = (c[order] for c in (group, x, y))
    g = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]]))

    def first(rows: np.ndarray) -> np.ndarray:
        found = np.full(g[-1] + 1, -1)
        at = np.flatnonzero(rows)[::-1]
        found[g[at]] = at
        return found[g]

    head = first(np.ones(len(g), dtype=bool))
    candidates = [head]
    for u, v in ((x, y), (y, x)):
        second = first(u != u[head])
        third = first((u != u[head]) & (v != v[second]) & (second >= 0))
        candidates += [second, third]
    best = np.full(len(g), len(g))
    for c in candidates:
        best = np.where((c >= 0) & (x[c] != x) & (y[c] != y), np.minimum(best, c), best)
    out = np.empty(len(g), dtype=np.int64)
    out[order] = np.where(best < len(g), order[np.minimum(best, len(g) - 1)], -1)
    return out


def maximal(of, symbols, at, begin, end, file, repo, pos, base: int, ahead: int, params: SpanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places in buckets `of`: (row, symbols before it, length) of all maximal common
    stretches with another place of the bucket; and the rows that may have more of them
    beyond `ahead` symbols.  A row's place is symbols[at]; what is there of its file lies
    from `begin` to `end`.  Fewer than w symbols before it or `ahead` from it on end with
    the file.  Places of a bucket have their first `base` symbols in common.

    Of two places, w or more symbols in common before them hold a common fingerprint
    too, whose bucket finds the stretch: so only pairs that part within w are asked for.
    Rows are divided by one symbol behind the place at a time.  Those of one class that
    part there, and have a symbols before them in common but not a + 1, are the pairs of
    a stretch.  For a row it is enough to know the first and the last of its partners,
    by root, file and place: they tell whether one lies elsewhere or far enough."""
    n, w = len(of), params.w
    own = np.arange(n) + (np.int64(1) << 40)  # an end of a file is like nothing else
    classes = [np.asarray(of, dtype=np.int64)]
    for a in range(w):
        there = at - 1 - a
        classes.append(_numbered(np.where(there >= begin, symbols[np.maximum(there, 0)].astype(np.int64), own), classes[-1]))
    lead = classes[w]
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((pos, file, repo))] = np.arange(n)
    found: list[np.ndarray] = []

    def living(rows: np.ndarray, cls: np.ndarray, b: int) -> np.ndarray:
        """Which of `rows`, in the order of cls, are in a class that may have pairs."""
        if not len(rows):
            return np.zeros(0, dtype=bool)
        heads = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        low, high = (lambda v: np.minimum.reduceat(v[rows], heads)), (lambda v: np.maximum.reduceat(v[rows], heads))
        good = (low(lead) != high(lead)) & ((low(file) != high(file)) | (high(pos) - low(pos) >= b))
        return np.repeat(good, np.diff(np.append(heads, len(rows))))

    def part(rows: np.ndarray, cls: np.ndarray, y: np.ndarray, b: int) -> None:
        for a in range(w):
            group = _numbered(classes[a][rows], cls)
            many = np.bincount(group)[group] > 1
            rows, cls, y, group = rows[many], cls[many], y[many], group[many]
            if not len(rows):
                break
            if a + b < params.min_len:
                continue
            first, last = (_partner(group, classes[a + 1][rows], y, r[rows]) for r in (rank, -rank))
            hit = first >= 0
            i, p, q = rows[hit], rows[first[hit]], rows[last[hit]]
            if params.cross_repo_only:
                valid = (repo[p] != repo[q]) | (repo[i] != repo[p])
            else:
                valid = (file[p] != file[q]) | (file[i] != file[p]) | (np.maximum(pos[i] - pos[p], pos[q] - pos[i]) >= a + b)
            found.append(np.stack([i[valid], np.full(int(valid.sum()), a), np.full(int(valid.sum()), a + b)]))

    live = np.argsort(classes[0], kind="stable")
    cls = classes[0][live]
    good = living(live, cls, base)
    live, cls = live[good], cls[good]
    for b in range(base, ahead):
        if not len(live):
            break
        there = at[live] + b
        symbol = np.where(there < end[live], symbols[np.minimum(there, len(symbols) - 1)].astype(np.int64), own[live])
        heads = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        size = np.diff(np.append(heads, len(cls)))
        middle = heads + size // 2  # mostly one of the many, if there are many alike
        leaves = symbol != np.repeat(symbol[middle], size)
        if not leaves.any():
            continue
        parted = np.repeat(np.logical_or.reduceat(leaves, heads), size)
        # Those who stay, and have before them what most have, have partners only among
        # the leaving who haven't.
        common = lead[live] == np.repeat(lead[live[middle]], size)
        needed = parted & (leaves | ~common | np.repeat(np.logical_or.reduceat(leaves & ~common, heads), size))
        y = np.zeros(len(live), dtype=np.int64)
        y[leaves] = 1 + _numbered(symbol[leaves], cls[leaves])
        if b >= params.k:
            part(live[needed], cls[needed], y[needed], b)
        order = np.flatnonzero(leaves)[np.argsort(y[leaves], kind="stable")]
        rows, new = live[order], y[order] + int(cls.max())
        live, cls = np.concatenate([live[~leaves], rows]), np.concatenate([cls[~leaves], new])
        good = living(live, cls, b + 1)
        live, cls = live[good], cls[good]
    row, a, length = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
    return row, a, length, live


def _found(batches: Iterator[pa.RecordBatch], kind: str, params: SpanParams, far: bool, schema: str) -> Iterator[pa.RecordBatch]:
    for table in prepare.whole_groups(batches, ["hash", "more"], 2_000 if far else 20_000):
        places, body = (table.column(c).combine_chunks() for c in ("places", "body"))
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64) // CODES[kind].itemsize
        symbols = np.frombuffer(body.buffers()[2], CODES[kind])
        line = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
        of = prepare.group_numbers(table, ["hash", "more"])[line]
        file, repo, first = (table.column(c).to_numpy().astype(np.int64)[line] for c in ("file_id", "repo_id", "first"))
        pos = places.flatten().to_numpy().astype(np.int64)
        begin, end = offsets[:-1][line], offsets[1:][line]
        at = begin + pos - first
        ahead = int((end - at).max()) + 1 if far else AHEAD
        row, a, length, rest = maximal(of, symbols, at, begin, end, file, repo, pos, AHEAD if far else 0, ahead, params)
        places = _distinct(file[row], pos[row] - a, length)
        none = pa.nulls(len(places[0]), pa.int64())
        yield _batch(schema, [*places, none, none])
        if len(rest):
            heads = [hashlib.blake2b(symbols[x : x + AHEAD].tobytes(), digest_size=16).digest() for x in at[rest].tolist()]
            keys = np.frombuffer(b"".join(heads), "<i8").reshape(-1, 2)
            yield _batch(schema, [file[rest], pos[rest], pa.nulls(len(rest), pa.int32()), keys[:, 0], keys[:, 1]])


def exactly(files: DataFrame, kind: str, params: SpanParams, stage: Stage) -> DataFrame:
    """PLACE's columns: the places of repeated spans, from all places of a fingerprint.
    Those that agree with others in AHEAD symbols, but not in what lies before them,
    meet a second time by what these symbols are, with the rest of their files."""
    packed = _packed(files, kind)
    if kind == "line":
        packed = stage.write(packed, "packed")
    schema = f"{PLACE}, hash long, more long"
    kept, steps = stage.write(repeated(fingerprints(files, kind, params)), "kept"), []
    for far in (False, True):
        rows = prepare.dealt(around(packed, kept, kind, params), ["hash", "more"])
        steps.append(stage.write(rows.mapInArrow(lambda batches, far=far: _found(batches, kind, params, far, schema), schema), f"found-{far}"))
        kept = steps[-1].where("len IS NULL").select("file_id", F.col("start").alias("pos"), "hash", "more")
        if kept.isEmpty():
            break
    release(files.sparkSession)
    return reduce(DataFrame.unionByName, steps).where("len IS NOT NULL").select("file_id", "start", "len")


def occurrences(files: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """PLACE's columns: the places of repeated spans, some more than once."""
    stage = Stage(files.sparkSession, f"spans-{kind}", tidy=True)
    if params.max_bucket is None:
        return exactly(files, kind, params, stage)
    kept = stage.write(buckets(fingerprints(files, kind, params), params.max_bucket), "kept")
    found = stage.write(seeds(surroundings(files, kept, kind, params), kind, params), "seeds")
    stage.drop("kept")
    met = stage.write(joined(found.where("what IS NOT NULL"), params), "runs")
    at_once = found.where("what IS NULL").select(F.col("fa").alias("file_id"), F.col("pos").alias("start"), F.col("beyond").alias("len"))
    places = at_once.unionByName(met.where("fb IS NULL").select(F.col("fa").alias("file_id"), F.col("pos").alias("start"), F.col("beyond").alias("len")))
    open_ = met.where("fb IS NOT NULL")
    if not open_.isEmpty():
        places = places.unionByName(extended(files, open_, kind, params))
    release(files.sparkSession)
    return places


FOUND = "key binary, hash long, len int, repo_id int, path string, file_id long, start int, start_line int, end_line int"


def digested(files: DataFrame, places: DataFrame, kind: str, params: SpanParams, sample: bool = False) -> DataFrame:
    """Places with a digest of their symbols, FNV hash and lines; with `sample` also
    the symbols, four bytes each.  A file's places are read from it at once, each of
    them once."""
    schema = FOUND + ", sample binary" * sample
    own = places.groupBy("file_id").agg(F.collect_set(F.struct("start", "len")).alias("places"))
    rows = _packed(files, kind, "path").join(own, "file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in prepare.slabs(whole, "body", PACKED[kind]):
                read = _unpacked(kind, batch.column("size"), batch.column("body"))
                hashed: dict[bytes, int] = {}
                todo, out = [], []
                for file, repo, path, where, s in zip(*(batch.column(c).to_pylist() for c in ("file_id", "repo_id", "path")), batch.column("places"), read, strict=True):
                    start, size = (where.values.field(c).to_numpy().astype(np.int64) for c in ("start", "len"))
                    a, b = s.lines(start), s.lines(start + size - 1)
                    code = coded(kind, s.values)
                    width, data = code.itemsize, code.tobytes()
                    total = np.concatenate([[0], np.cumsum(s.sizes)]) if s.sizes is not None else None
                    for p, n, x, y in zip(start.tolist(), size.tolist(), a.tolist(), b.tolist(), strict=True):
                        if params.min_chars and total is not None and total[p + n] - total[p] < params.min_chars:
                            continue
                        key = hashlib.blake2b(data[p * width : (p + n) * width], digest_size=16).digest()
                        if key not in hashed:
                            hashed[key] = len(todo)
                            todo.append(s.values[p : p + n])
                        out.append((key, n, repo, path, file, p, x, y))
                if out:
                    h = kernels.fnv_many(todo, 4).view(np.int64)
                    key, *others = zip(*out, strict=True)
                    which = np.array([hashed[k] for k in key])
                    columns = [key, h[which], *others]
                    if sample:
                        columns.append([todo[i].astype("<u4").tobytes() for i in which.tolist()])
                    types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _grouped(members: DataFrame, params: SpanParams) -> DataFrame:
    groups = members.groupBy("key", "hash", "len").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.size(F.collect_set("repo_id")).cast("long").alias("n_repos"),
        F.min(F.struct("repo_id", "path", "start_line", "end_line", "file_id", "start")).alias("first"),
    ).where("n_members > 1")
    groups = groups.where("n_repos > 1") if params.cross_repo_only else groups
    return groups.select(F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash"), F.col("len").cast("long").alias("normalized_len"), "n_members", "n_repos", "first", "key")


def span_counts(files: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """(hash, normalized_len, n_members, n_repos, first, key) of each repeated span;
    `first` is its first place by root, path and lines."""
    return _grouped(digested(files, occurrences(files, kind, params), kind, params), params)


def with_places(groups: DataFrame, places: DataFrame, files: DataFrame) -> DataFrame:
    """`groups` with their occurrences, sorted by root, path and lines.  For the
    groups that are shown: a list is one row, however long."""
    labels = files.select("file_id", "repo_label")
    own = places.join(labels, "file_id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("repo_id", "repo_label", "path", "start_line", "end_line"))).alias("occurrences"))
    return groups.join(own, "key")


def with_samples(groups: DataFrame, files: DataFrame, kind: str, params: SpanParams) -> DataFrame:
    """`groups` with the symbols of their first place, four bytes each."""
    heads = groups.select(F.col("first.file_id").alias("file_id"), F.col("first.start").alias("start"), F.col("normalized_len").cast("int").alias("len"))
    return groups.join(digested(files, heads, kind, params, sample=True).select("key", "sample").dropDuplicates(["key"]), "key")


def span_groups(files: DataFrame, kind: str, params: SpanParams, most: int | None = None) -> DataFrame:
    """(hash, normalized_len, n_members, n_repos, first, key, sample, occurrences) of
    each repeated span, or of the `most` with the most places and symbols."""
    stage = Stage(files.sparkSession, f"groups-{kind}", tidy=True)
    places = stage.write(digested(files, occurrences(files, kind, params), kind, params), "places")
    groups = _grouped(places, params)
    if most is not None:
        groups = groups.orderBy(F.desc("n_members"), F.desc("normalized_len"), "hash", "first").limit(most)
    groups = stage.write(groups, "groups")
    keys = F.broadcast(groups.select("key")) if most is not None else groups.select("key")
    return with_places(with_samples(groups, files, kind, params), places.join(keys, "key", "left_semi"), files)
