"""WARC archives with a two-level capture index.

Writing: each task appends its pages to an archive of its own, one gzip member
a record, and returns the capture lines ``(urlkey, page_id, archive, offset,
length, ...)``; only archives named by successful tasks count, so a lost
executor leaves a stray file and nothing else.  Equal payloads of at least
``revisit_bytes`` are stored once (for the largest page_id); the others become
revisit records that refer to it.

Index: capture lines sorted by reversed-host URL key are dealt by range and
packed into compressed blocks (level one); the sparse directory holds the
first and last key of each block (level two).  A look-up binary-searches the
directory, inflates the blocks that may hold a key, and reads byte ranges of
the archives.  The directory is dealt by key ranges, whose bounds are a sample
of its keys, and the wanted keys with it, so that each task searches its own
part of it only.  :func:`round_trip` reads all pages back that way.

Archives lie in the folder that the cluster shares (any scheme that pyarrow's
file systems know, or a plain path).

Defined cases: null html is an empty payload; null url has the key ``)/``;
repeated rows give a record each (the greatest page_id, then one of its rows,
is the response; further rows with that page_id and payload are responses
too); null page_id loses against any other; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm._work import join_skewed, release, stored, work_dir

_CAPTURE = "urlkey string, page_id long, url string, archive string, offset long, length long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: Column) -> Column:
    """``https://blog.site.org:8080/a?b`` as ``org,site,blog:8080)/a?b``; case-folded."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    authority = F.regexp_extract(bare, r"^[^/?]*", 0)
    host, port = F.regexp_replace(authority, r"^[^@]*@|:\d*$", ""), F.regexp_extract(authority, r":\d+$", 0)
    path = F.substring(bare, F.length(authority) + 1, 1 << 30)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def _fs(path: str):
    import pyarrow.fs as pf

    return pf.FileSystem.from_uri(path) if "://" in path else (pf.LocalFileSystem(), path)


#: Signs that a URI may hold as they are; all others are written as %XX.
_URI = "%:/?#[]@!$&'()*+,;=-._~"


def _header(record: dict, digest: str) -> bytes:
    page, refers, url = record["page_id"], record["refers_to"], record["url"]
    uri = quote(url or "", safe=_URI)
    head = [
        "WARC/1.1",
        f"WARC-Type: {record['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if page is None else page}",
        f"X-Payload-Length: {record['payload_bytes']}",
    ]
    if uri != (url or ""):
        head.append(f"X-Target-As-Given: {json.dumps(url)}")
    if record["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>", f"X-Refers-To-Page: {refers}"]
    return "\r\n".join(head).encode()


def _writer(folder: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        out, name, at = None, "", 0
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                payload = (r["html"] or "").encode()
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if r["record_type"] == "response" else b"")
                head = _header(r | {"payload_bytes": len(payload)}, hashlib.sha1(payload).hexdigest())
                member = gzip.compress(head + b"\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                lines.append((r["urlkey"], r["page_id"], r["url"], f"{folder}/{name}", at, len(member)))
                at += len(member)
            cols = list(zip(*lines, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in _CAPTURE.split(", ")])
        if out is not None:
            out.close()

    return scan


def write_archives(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Writes ``pages (page_id, url, html)``; returns the stored capture lines."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n_bytes"))
    shared = rows.where(F.col("n_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    # a payload that a third of all pages share is joined apart
    typed = join_skewed(rows, stored(shared, "shared"), ["digest"], "left", size="n", by=["page_id"])
    again = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    typed = typed.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original")).alias("refers_to"), url_key(F.col("url")).alias("urlkey"))
    return stored(typed.mapInArrow(_writer(f"{work_dir(pages.sparkSession)}/archive"), _CAPTURE), "captures")


_BLOCK = "block string, first_key string, last_key string, n int, lines binary"


def build_index(captures: DataFrame, lines_per_block: int = 3000) -> DataFrame:
    """Level one: compressed blocks of sorted capture lines, a row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table) -> pa.RecordBatch:
            keys = table.column("urlkey")
            lines = "\n".join(json.dumps(list(r.values())) for r in table.to_pylist())
            return pa.record_batch([[uuid.uuid4().hex], [keys[0].as_py()], [keys[-1].as_py()], pa.array([table.num_rows], pa.int32()), pa.array([zlib.compress(lines.encode())], pa.binary())], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while table.num_rows >= lines_per_block:
                yield block(table.slice(0, lines_per_block))
                table = table.slice(lines_per_block)
            held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    # url then place: a host or URL with a third of all captures spans many ranges
    ranged = captures.repartitionByRange("urlkey", "archive", "offset").sortWithinPartitions("urlkey", "archive", "offset")
    return stored(ranged.mapInArrow(pack, _BLOCK), "blocks")


def _lines_of(raw: bytes) -> list[list]:
    """The capture lines of one compressed block."""
    return [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")]


def read_lines(blocks: DataFrame) -> DataFrame:
    """The capture lines of the given blocks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("lines"):
                rows = _lines_of(raw.as_py())
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in _CAPTURE.split(", ")])

    return blocks.select("lines").mapInArrow(unpack, _CAPTURE)


def parse_record(member: bytes) -> dict:
    """One gzip member as page_id, url, digest, type, reference and payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    page, kind = fields["X-Page-Id"], fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record of page {page} does not match its digest")
    # a response is measured; a revisit has no payload of its own
    size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
    if size != int(fields["X-Payload-Length"]):
        raise ValueError(f"record of page {page} does not have its length")
    refers, given = fields.get("X-Refers-To-Page"), fields.get("X-Target-As-Given")
    return {"page_id": int(page) if page else None, "url": json.loads(given) if given else fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None, "payload": payload if kind == "response" else None}


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-reads the records of the given capture lines and checks digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for batch in batches:
            place = batch.to_pandas().sort_values(["archive", "offset"])[["archive", "offset", "length"]]
            for archive, part in place.groupby("archive", sort=False):
                if archive not in files:
                    if len(files) >= 32:
                        files.pop(next(iter(files))).close()
                    fs, path = _fs(archive)
                    files[archive] = fs.open_input_file(path)
                for lo in range(0, len(part), 256):
                    rows = []
                    for offset, length in part[["offset", "length"]].iloc[lo : lo + 256].itertuples(index=False):
                        files[archive].seek(offset)
                        r = parse_record(files[archive].read(length))
                        rows.append(r if payloads else r | {"payload": None})
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        for f in files.values():
            f.close()

    return captures.mapInArrow(read, _RECORD)


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def directory(blocks: DataFrame) -> DataFrame:
    """Level two: (first_key, last_key, block), in key order."""
    return blocks.select("first_key", "last_key", "block").repartitionByRange("first_key", "last_key", "block").sortWithinPartitions("first_key", "last_key", "block")


def look_up(blocks: DataFrame, urls: DataFrame, entries_per_part: int = 500) -> DataFrame:
    """Capture lines of ``urls (url)``.

    The directory is dealt in parts of about ``entries_per_part`` blocks.  Only
    the parts' bounds reach the driver: one key of so many blocks, that is of
    ``entries_per_part`` x ``lines_per_block`` captures.
    """
    wanted = urls.select(url_key(F.col("url")).alias("wanted")).distinct()
    cut = stored(directory(blocks), "directory")
    bounds = [r[0] for r in cut.where(F.pmod(F.xxhash64("block"), F.lit(entries_per_part)) == 0).select("first_key").distinct().orderBy("first_key").collect()]

    def dealt(low: str, high: str):
        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            edge = np.array(bounds, object)
            for pdf in frames:
                a = np.searchsorted(edge, pdf[low].to_numpy(object), "left")
                n = np.searchsorted(edge, pdf[high].to_numpy(object), "right") - a + 1
                out = pdf.loc[pdf.index.repeat(n)]
                yield out.assign(part=np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n))

        return scan

    def search(keys: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        """(wanted, block): binary search of the keys in this part of the directory."""
        entries = entries.sort_values(["first_key", "last_key"], kind="stable")
        first, last, names = (entries[c].to_numpy(object) for c in ("first_key", "last_key", "block"))
        w = keys["wanted"].to_numpy(object)
        lo, hi = np.searchsorted(last, w, "left"), np.searchsorted(first, w, "right")
        n = np.maximum(hi - lo, 0)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return pd.DataFrame({"wanted": np.repeat(w, n), "block": names[place]}, columns=["wanted", "block"])

    # a key or block that spans bounds goes to each part that it touches
    asked = wanted.mapInPandas(dealt("wanted", "wanted"), "wanted string, part long")
    entries = cut.mapInPandas(dealt("first_key", "last_key"), "first_key string, last_key string, block string, part long")
    hits = stored(asked.groupBy("part").cogroup(entries.groupBy("part")).applyInPandas(search, "wanted string, block string").distinct(), "hits")

    def inflate(keys: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        there = set(keys["wanted"])
        rows = [x for raw in (block["lines"] if there else ()) for x in _lines_of(raw) if x[0] in there]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _CAPTURE.split(", ")]).astype({"page_id": "Int64"})

    return hits.groupBy("block").cogroup(blocks.select("block", "lines").groupBy("block")).applyInPandas(inflate, _CAPTURE)


def round_trip(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Writes all pages, builds the index and reads every record through it.

    All urls of the pages are looked up; the lines found are sorted by archive
    and offset, so that a task reads its ranges of an archive in order.
    """
    captures = write_archives(pages, revisit_bytes)
    blocks = build_index(captures)
    release(captures)
    lines = look_up(blocks, pages.select("url")).repartitionByRange("archive", "offset")
    return read_records(lines, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
