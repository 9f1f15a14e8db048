"""WARC files, written and read back with boundary-chain verification.

Writing is done by Spark's own text writer: a record is one string, and the writer
ends each with the CRLF pairs that end a WARC record, so a lost task leaves no
half-written archive.  Records with equal payloads of at least `revisit_bytes` are
written once; the others revisit it.

Reading splits archives at the bytes of the version line, wherever they stand, in
payloads too.  Each task gives its pieces' lengths and, for each piece that begins
like a record, the distance to the record's successor.  Sums over pieces make file
offsets.  Then, file by file, pointers jump from offset 0 along the successors;
only what the chain reaches is a record, so a version line inside a payload is
rejected.  A record whose payload was split at such a line is read again and put
together; all others are digested where they were read.

Defined cases.  Null html: empty payload.  Null url: no target URI.  Control
characters and blanks of a url are percent-encoded in the header.  Null page_id:
a response, never a revisit and never referred to.  Repeated page_ids: the rows of
the largest id are all responses; rows of one id with other contents are told apart
by digest, in writing and in reading.  Empty tables give no archive, and no rows.
Offsets are 64 bits; what one group holds is a number or two for each piece of one
archive file, whose size the writer's partitions bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BROADCAST_ROWS = 500_000
FIELDS = "file string, start long, idx long, head long, size long, kind string, page string, digest string, refers string, whole boolean, payload_bytes long, found string"


def header_url(url: Column) -> Column:
    """A url as a header value: nothing in it can end the line."""
    out = url
    for c, code in (("%", None), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20"), ("\x00", "%00"), ("\x0b", "%0B"), ("\x0c", "%0C")):
        out = out if code is None else F.replace(out, F.lit(c), F.lit(code))
    return out


def records(pages: DataFrame, revisit_bytes: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, record): each page's record without its final CRLF pairs."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    large = rows.where((F.octet_length("html") >= revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    first = large.groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # only pages that revisit another: a small part of most crawls, so the pages themselves need not move
    again = large.join(first.select("sha1", "kept"), "sha1").where("page_id < kept").select("page_id", "sha1", "kept").distinct()
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, ["page_id", "sha1"], "left")  # by content too: one page_id can have several
    revisit = F.col("kept").isNotNull()
    body = F.when(revisit, F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), header_url(F.col("url")), F.lit("\r\n")), F.lit(""))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), named(F.col("kept")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise("")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Record-ID: "),
        named(F.col("page_id")),
        F.lit("\r\n"),
        uri,
        refers,
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
    )
    return rows.select("page_id", record.alias("record"))


def write(pages: DataFrame, path: str, **options) -> None:
    """Archives under `path`, one for each partition, uncompressed."""
    records(pages, **options).select("record").write.mode("overwrite").option("lineSep", END).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Archive bytes split at every version line, with the place of each split."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _payload(body: bytes) -> bytes:
    """What follows the HTTP header."""
    _, found, rest = body.partition(b"\r\n\r\n")
    return rest if found else b""


def candidates(rows: DataFrame) -> DataFrame:
    """FIELDS of each piece: its place in its split, its length, and what it would
    be as a record: `head` bytes of header, `size` bytes of block (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idx = None, 0
        for batch in batches:
            out = []
            for file, start, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                idx = idx + 1 if (file, start) == place else 0
                place = (file, start)
                cut = piece.find(b"\r\n\r\n")
                fields = _fields(piece[:cut]) if cut >= 0 else {}
                size = fields.get("content-length", "")
                row = [file, start, idx, len(piece), None, None, None, None, None, None, None, None]
                if size.isascii() and size.isdigit() and len(size) < 18 and "warc-type" in fields:
                    block = piece[cut + 4 : cut + 4 + int(size)]
                    whole = len(block) == int(size)
                    payload = _payload(block) if whole else b""
                    row[4:] = [cut + 4 + int(size), fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-payload-digest"), fields.get("warc-refers-to"), whole, len(payload), hashlib.sha1(payload).hexdigest() if whole else None]
                out.append(row)
            yield pa.RecordBatch.from_pylist([], schema=schema) if not out else pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    text, long, flag = pa.string(), pa.int64(), pa.bool_()
    schema = pa.schema([("file", text), ("start", long), ("idx", long), ("head", long), ("size", long), ("kind", text), ("page", text), ("digest", text), ("refers", text), ("whole", flag), ("payload_bytes", long), ("found", text)])
    return rows.mapInArrow(run, FIELDS)


def reachable(succ: np.ndarray, first: int) -> np.ndarray:
    """Which nodes a chain from `first` visits; succ[i] is i's successor, or i
    itself at the end.  The set doubles with every jump."""
    seen = np.zeros(len(succ), dtype=bool)
    if len(succ):
        seen[first] = True
        jump = succ.copy()
        for _ in range(max(1, int(len(succ)).bit_length())):
            seen[jump[seen]] = True
            jump = jump[jump]
    return seen


def chained(found: DataFrame) -> DataFrame:
    """Places of true records: (file, start, idx, offset, last_start, last_idx, end)
    where the record's bytes run up to piece (last_start, last_idx)."""
    schema = "file string, start long, idx long, offset long, record long, whole boolean"

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["start", "idx"], kind="stable").reset_index(drop=True)
        # a split begins with a piece that another's version line ended, but for the file's first
        length = part["head"].to_numpy() + len(MAGIC)
        offset = np.cumsum(length) - length - len(MAGIC)  # of the version line before each piece
        size = part["size"].to_numpy(dtype=float)
        ok = ~np.isnan(size)
        after = np.where(ok, offset + len(MAGIC) + np.nan_to_num(size) + len(END), -1).astype(np.int64)
        at = np.searchsorted(offset, after)
        hit = ok & (at < len(offset)) & (offset[np.minimum(at, len(offset) - 1)] == after)
        succ = np.where(hit, at, np.arange(len(offset)))
        begins = np.flatnonzero(offset == 0)
        seen = reachable(succ, int(begins[0])) if len(begins) else np.zeros(len(offset), dtype=bool)
        seen &= ok
        record = np.where(seen, np.arange(len(offset)), -1)
        record = np.maximum.accumulate(record) if len(record) else record
        # pieces of a record that goes on past its first piece
        inside = (record >= 0) & (offset < after[np.maximum(record, 0)] - len(END))
        keep = seen | (inside & ~part["whole"].astype("boolean").fillna(False).to_numpy()[np.maximum(record, 0)])
        out = part.loc[keep, ["file", "start", "idx"]].assign(offset=offset[keep], record=offset[record[keep]], whole=part["whole"].astype("boolean").fillna(False).to_numpy()[record[keep]])
        return out

    return found.select("file", "start", "idx", "head", "size", "whole").groupBy("file").applyInPandas(run, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, record_type, payload_bytes, payload_digest, refers_to,
    intact) of every record that the chains reach.  A revisit's payload is that of
    the record it refers to, of the one with its digest if several have that id;
    `intact` compares digests in headers with payloads."""
    stage = Stage(spark, "warc-read")
    found = stage.write(candidates(pieces(spark, path)), "candidates")
    chain = stage.write(chained(found), "chain")
    at = ["file", "start", "idx"]
    heads = chain.where("offset = record").select(*at, "offset")
    rows = found.drop("whole").join(heads, at)
    split = chain.where("NOT whole").select(*at, "record", "offset")
    if split.limit(1).count():  # records whose payload holds a version line: read those pieces again

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, idx = None, 0
            for batch in batches:
                out = []
                for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    idx = idx + 1 if (file, start) == place else 0
                    place = (file, start)
                    out.append(idx)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["file", "start", "piece", "idx"])

        again = pieces(spark, path).mapInArrow(numbered, "file string, start long, piece binary, idx long").join(split, at)
        again = again.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, digests = [], []
                for parts in batch.column(2).to_pylist():
                    data = MAGIC.encode().join(p["piece"] for p in parts)
                    cut = data.find(b"\r\n\r\n")
                    payload = _payload(data[cut + 4 : cut + 4 + int(_fields(data[:cut])["content-length"])])
                    sizes.append(len(payload))
                    digests.append(hashlib.sha1(payload).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests)], ["file", "offset", "n", "sha1"])

        whole = again.mapInArrow(joined, "file string, offset long, n long, sha1 string")
        rows = rows.join(whole, ["file", "offset"], "left").withColumns({"payload_bytes": F.coalesce("n", "payload_bytes"), "found": F.coalesce("sha1", "found")})
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    rows = rows.select("file", "offset", number(F.col("page")).alias("page_id"), F.col("kind").alias("record_type"), "payload_bytes", F.col("found").alias("made"), F.regexp_replace("digest", "^sha1:", "").alias("said"), number(F.col("refers")).alias("refers_to"))
    rows = stage.write(rows, "rows")
    held = rows.where("record_type = 'response'").select(F.col("page_id").alias("to"), "payload_bytes", "made", "said")
    first = held.groupBy("to").agg(F.max(F.struct("payload_bytes", "made")).alias("o"))
    # by the digest that a response has or claims; a revisit whose digest none of them has gets the largest payload, and isn't intact
    same = held.withColumn("digest", F.explode(F.array_distinct(F.array("made", "said"))))
    same = same.groupBy("to", "digest").agg(F.max(F.struct((F.col("made") == F.col("digest")).alias("has"), "payload_bytes", "made")).alias("s"))
    again = rows.where("record_type = 'revisit'").join(same.withColumnRenamed("to", "same_to"), (F.col("refers_to") == F.col("same_to")) & (F.col("said") == F.col("digest")), "left")
    again = again.join(first, F.col("refers_to") == F.col("to"), "left")
    again = again.withColumns({"payload_bytes": F.coalesce("s.payload_bytes", "o.payload_bytes"), "made": F.coalesce("s.made", "o.made")}).drop("to", "o", "same_to", "digest", "s")
    both = rows.where("record_type = 'response'").unionByName(again)
    return both.select("file", "offset", "page_id", "record_type", "payload_bytes", F.col("made").alias("payload_digest"), "refers_to", F.coalesce(F.col("made") == F.col("said"), F.lit(False)).alias("intact"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stage(spark, "warc").path("archives")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


# The same rows by SQL alone: what the archives must give back.
SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to, true AS intact
FROM p LEFT JOIN m USING (payload_digest)
"""
