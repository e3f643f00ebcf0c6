"""Deterministic sharded WARC writer and reader.

``write_archives`` cuts the pages into ranges of page_id, sorts each range,
writes one gzip member per record and starts a new file when the compressed
size passes ``ROLL_BYTES``.  Every header (ids, digests, lengths) is made
anew from the record.  A file is written under a temporary name and moved
when complete; names and contents follow from the input alone, so a repeated
task writes the same file again.  The manifest, one row per file, goes
through Spark's own commit protocol, and only files it names are read.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the largest
page_id is the response and the others are revisits of it.  The digests are
grouped without the html; the decisions then travel to the writer as extra
small rows of the same range partition, so the html is shuffled once.

Defined results: null html is the empty payload; null page_ids come first,
and records whose group has no page_id at all are all responses; of repeated
rows of the response's own page_id the first is the response, the others
revisit it; control characters in a url are percent-encoded in the header;
an empty table gives no file; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmeter.llm.common import LOWEST, FileOutput, kept, range_parts, read_file
from inkmeter.session import scratch_path

MIN_REVISIT = 1000
ROLL_BYTES = 64 << 20
#: Payload bytes of a range, which compress to about one file; and what the reader hands to the decompressor at a time.
RANGE_BYTES, SLICE = 4 * ROLL_BYTES, 1 << 14
#: Fixed values of the WARC/1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest}')}>"


def _member(headers: list, block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def response_or_revisit(page_id, url, payload: bytes, digest: str, keeper, level: int = 6) -> bytes:
    """One gzip member; ``keeper`` is the page whose response this record repeats, or None."""
    b32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if keeper is not None else http + payload
    headers = [("WARC-Type", "response" if keeper is None else "revisit"),
               ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url)))
    headers += [("WARC-Payload-Digest", b32), ("WARC-Block-Digest", _base32(block)),
                ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", page_id))
    if keeper is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(keeper, digest)),
                    ("X-Refers-To-Page", keeper)]
    return _member(headers, block, level)


def members(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an archive; what is behind a record is copied a slice at most."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            parts.append(z.decompress(view[at:at + SLICE]))
            at = min(at + SLICE, len(view))
        at -= len(z.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        if len(rest) != n + 4:
            raise ValueError("a record has another length than its header says")
        yield headers, rest[:n]


MANIFEST = "part int, seq int, file string, records long, bytes long, sha256 string"


def write_archives(pages: DataFrame, folder: str, level: int = 4, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the manifest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.coalesce("page_id", F.lit(LOWEST)))
    small = kept(rows.select("page_id", "key", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")),
                 "page-digests")
    groups = (small.where(F.col("n") >= MIN_REVISIT).groupBy("digest", "n")
              .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
              .where((F.col("copies") > 1) & F.col("keeper").isNotNull()).select("digest", "n", "keeper"))
    decisions = small.join(groups, ["digest", "n"]).select("key", "digest", "keeper").distinct()

    # ranges are sized by bytes: a file each, or as many as the session has partitions if the pages are few
    payload = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-payload // RANGE_BYTES))
    _, edges = range_parts(small, "key", "digest", tasks, exact=True)

    def placed(df: DataFrame) -> DataFrame:
        return range_parts(df, "key", "digest", tasks, edges)[0]

    nothing = F.lit(None).cast("string")
    wide = placed(rows.withColumn("digest", F.sha1("html"))).select(
        "part", "key", F.lit(1).alias("kind"), "digest", F.col("page_id").cast("string").alias("id"), "url", "html")
    extra = placed(decisions).select(
        "part", "key", F.lit(0).alias("kind"), "digest", F.col("keeper").cast("string").alias("id"),
        nothing.alias("url"), nothing.alias("html"))
    ordered = (wide.unionByName(extra).repartitionById(tasks, F.col("part"))
               .sortWithinPartitions("part", "key", "kind", "digest", "url"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        out, records, done, part, seq = None, 0, [], None, 0
        key, keepers, last = None, {}, None

        def close() -> None:
            nonlocal out, records
            if out is not None:
                out.commit()
                done.append((part, seq, out.name, records, out.size, out.digest.hexdigest()))
                out, records = None, 0

        for pdf in batches:
            for p, k, kind, digest, i, url, html in zip(*(pdf[c] for c in
                                                         ("part", "key", "kind", "digest", "id", "url", "html"))):
                if (p, k) != key:
                    key, keepers, last = (p, k), {}, None
                if kind == 0:
                    keepers[digest] = i
                    continue
                if p != part:
                    close()
                    part, seq = p, 0
                elif out is not None and out.size >= roll_bytes:
                    close()
                    seq += 1
                if out is None:
                    name = f"part-{part:07d}-{seq:05d}.warc.gz"
                    out = FileOutput(folder, name)
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "")),
                                       ("WARC-Date", DATE), ("WARC-Filename", name),
                                       ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                payload = html.encode("utf-8", "surrogatepass")
                keeper = keepers.get(digest)
                if keeper is not None and keeper == i and last != digest:
                    keeper, last = None, digest
                out.write(response_or_revisit(i, url, payload, digest, keeper, level))
                records += 1
            if done:
                yield pd.DataFrame(done, columns=columns)
                done = []
        close()
        yield pd.DataFrame(done, columns=columns)

    return kept(ordered.mapInPandas(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per page record of the files in the manifest; every digest and length is checked."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, sha in zip(pdf["file"], pdf["sha256"]):
                data = read_file(folder, file)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{file} is not the file of the manifest")
                out = []
                for headers, block in members(data):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    if _base32(block) != headers["WARC-Block-Digest"]:
                        raise ValueError("a block and its digest disagree")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(http.rsplit(b"Content-Length: ", 1)[1])
                    if headers["WARC-Type"] == "response" and (
                            len(payload) != n or _base32(payload) != headers["WARC-Payload-Digest"]):
                        raise ValueError("a payload and its digest disagree")
                    digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                    ids = [headers.get(h) for h in ("X-Page-Id", "X-Refers-To-Page")]
                    out.append((*(None if x is None else int(x) for x in ids), n, digest, headers["WARC-Type"], file))
                got = pd.DataFrame(out, columns=["page_id", "refers_to", "payload_bytes", "payload_digest",
                                                 "record_type", "file"])
                for c in ("page_id", "refers_to"):
                    got[c] = pd.array([r[c == "refers_to"] for r in out], dtype="Int64")
                yield got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]]

    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "file string")
    # a number of its own: sized by bytes, the few small rows of the manifest would all go to one task
    tasks = min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism) or 1
    return manifest.select("file", "sha256").repartition(tasks, "file").mapInPandas(read, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
