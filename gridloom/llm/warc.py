"""WARC archives, written and read index first.

Writing: each task writes one archive of gzip members, a record each, to the shared folder, under a name of its own; the
rows that it returns are the archive's index: file, offset, length, URL and digest of every record. Only the index of
tasks that succeeded is kept, so a lost or repeated task leaves an archive that nothing refers to. Of records with equal
payloads the first is a response, the others are revisits that name it and carry its headers alone.

Reading: the index is filtered first; then the byte ranges of the records wanted are sorted by file and offset, and ranges
that (nearly) adjoin are read at once. Archives are opened through pyarrow's file systems, so any store that it knows works.

Defined results: every row is one record, whatever its id; a null payload is empty; rows of one payload whose id is the least
are all responses (also where it comes twice, or all ids are null), the others, null ids among them, revisit it; null urls are
written as `urn:none` and read back as null, and urls that no header line can hold (line breaks, blanks, none but `urn:none`)
are quoted there and kept whole in a header of their own; payloads of any length are one record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.components import join_unskewed
from gridloom.llm.files import file_system
from gridloom.session import partitions, shared_path, ship, stored

#: Ranges whose gap is at most so many bytes are read at once, up to so many bytes.
GAP, RUN = 64 << 10, 8 << 20
INDEX = "file string, offset long, length long, url string, digest string, record_id string, record_type string, refers_to string, payload_bytes long"
FIELDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64())])
NO_URL = "urn:none"
#: A header of ours: the URL as it was, in base 64, where a header line cannot hold it.
EXACT_URL = "X-Exact-Target-URI"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(record_id: str | None) -> str:
    return f"<urn:record:{record_id or ''}>"


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record; a revisit has the response's headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    plain = url is not None and url != NO_URL and re.fullmatch(r"[!-~]+", url)
    target = NO_URL if url is None else url if plain else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(record_id)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None and not plain:
        head.append(f"{EXACT_URL}: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """One record's headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    got = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(got["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    name = lambda k: got[k][len("<urn:record:") : -1] or None if k in got else None
    if got["WARC-Type"] == "response" and digest_of(payload) != got["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {got['WARC-Record-ID']} does not have its digest")
    url = base64.b64decode(got[EXACT_URL]).decode("utf-8", "surrogatepass") if EXACT_URL in got else None if got["WARC-Target-URI"] == NO_URL else got["WARC-Target-URI"]
    return {"record_id": name("WARC-Record-ID"), "url": url, "digest": got["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": got["WARC-Type"], "refers_to": name("WARC-Refers-To"), "payload_bytes": size, "payload": payload if got["WARC-Type"] == "response" else None}


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def duplicates(rows: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, h (the payload's SHA-256), refers_to of the ids that are not the least of their payload's."""
    some = stored(rows.where(F.length("payload") >= least_bytes).select("page_id", "h"), "digests")
    least = some.groupBy("h").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 and refers_to is not null")
    pairs = join_unskewed(some, stored(least, "repeated"), "h", "rows").distinct()
    return pairs.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "h", "refers_to")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives below path; the index (also written, to path/index) of all records."""
    spark = ship(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload")).withColumn("h", F.sha2("payload", 256))
    seen = stored(duplicates(rows, least_bytes), "duplicates").select(F.col("page_id").alias("same_id"), F.col("h").alias("same_h"), "refers_to")
    rows = rows.join(seen, F.col("page_id").eqNullSafe(F.col("same_id")) & (F.col("h") == F.col("same_h")), "left").select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))

    def write(batches):
        fs, base = file_system(path)
        name, offset, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for b in batches:
                index = []
                for rid, url, payload, refers in zip(*(b.column(i).to_pylist() for i in range(4))):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(name, compression=None)
                    digest = digest_of(payload)
                    member = gzip_member(record(rid, url, payload, digest, refers))
                    out.write(member)
                    index.append((name, offset, len(member), url, digest, rid, "response" if refers is None else "revisit", refers, len(payload)))
                    offset += len(member)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index), FIELDS)], schema=FIELDS)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP, most: int = RUN) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) as (start, end, how many of them) of reads."""
    out: list[list[int]] = []
    for o, n in ranges:
        if out and o - out[-1][1] <= gap and o + n - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], o + n)
            out[-1][2] += 1
        else:
            out.append([o, o + n, 1])
    return [tuple(x) for x in out]


RECORD = "record_id string, url string, digest string, record_type string, refers_to string, payload_bytes long, payload binary"


def read_warc(index: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, parsed from the archives."""
    spark = ship(index.sparkSession)
    part = F.floor(F.col("offset") / F.lit(16 * RUN))
    dealt = index.select("file", "offset", "length", part.alias("part")).repartition(partitions(spark), "file", "part").sortWithinPartitions("file", "offset")

    def read(batches):
        fs, _ = file_system(path)
        name, source = None, None
        for b in batches:
            files, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name, source = files[i], fs.open_input_file(files[i])
                at = i
                for start, end, n in coalesce(list(zip(offsets[i:j], lengths[i:j]))):
                    data = source.read_at(end - start, start)
                    got = [parse(zlib.decompress(data[o - start : o - start + m], 31)) for o, m in zip(offsets[at : at + n], lengths[at : at + n])]
                    at += n
                    if not with_payload:
                        got = [g | {"payload": None} for g in got]
                    yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("record_id", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))
                i = j
        if source is not None:
            source.close()

    return dealt.mapInArrow(read, RECORD)


def fresh_archive(pages: DataFrame) -> str:
    return shared_path(pages.sparkSession, "warc")
