"""WARC archives as seekable Zstandard bundles.

A bundle is one ``.warc.zst`` file: WARC records are grouped into frames that
decompress independently, and a skippable frame at the end holds the seek
table (the public seekable format: one pair of compressed and decompressed
size per frame, then a nine-byte footer).  The index maps every record to
(bundle, frame, offset inside the decompressed frame, length), so that one
record is read with one ranged read and one frame's decompression.

Records with equal payloads of at least ``min_payload`` bytes are stored once:
the one with the smallest id is a ``response``, the others are ``revisit``
records that refer to it.

Defined results for odd input:

* null payload: an empty payload; null URI: no ``WARC-Target-URI`` header;
* null id: the record is written with the id ``null``; it never becomes the
  response of a group that also holds ids, and a group with null ids only
  keeps all its records as responses;
* repeated rows (same id, same payload): all copies of the smallest id are
  responses;
* empty input: an empty index, no bundle;
* extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm.common import cut, filesystem, shared_folder, small_batches

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-record:"

INDEX_SCHEMA = "record_id string, bundle string, frame int, frame_offset long, offset long, length long"
RECORD_SCHEMA = ("record_id string, record_type string, uri string, payload_digest string, "
                 "payload_bytes long, refers_to string, payload binary")


# --- one record -----------------------------------------------------------------------------

def _one_line(s: str) -> str:
    """A header value must stay on its line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)


def format_record(record_id: str, uri: str | None, digest: str, size: int, refers_to: str | None,
                  payload: bytes, date: str) -> bytes:
    """The bytes of one WARC record; ``refers_to`` makes it a revisit without payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{ID_PREFIX}{_one_line(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_one_line(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{_one_line(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the offset after it; the payload's digest is verified."""
    end = data.index(b"\r\n\r\n", at)
    head = {}
    for line in data[at:end].decode().split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        head[k] = v
    start, size = end + 4, int(head["Content-Length"])
    block = data[start:start + size]
    http_end = block.index(b"\r\n\r\n") + 4
    length = next(int(x.split(b":")[1]) for x in block[:http_end].split(b"\r\n") if x.startswith(b"Content-Length:"))
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[http_end:] if kind == "response" else None
    if payload is not None and (len(payload) != length
                                or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    strip = lambda x: None if x is None else x[1 + len(ID_PREFIX):-1]
    return {"record_id": strip(head["WARC-Record-ID"]), "record_type": kind, "uri": head.get("WARC-Target-URI"),
            "payload_digest": digest, "payload_bytes": length, "refers_to": strip(head.get("WARC-Refers-To")),
            "payload": payload}, start + size + 4


# --- one bundle -----------------------------------------------------------------------------

def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that closes a bundle, for (compressed, decompressed) sizes of its frames."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int]]:
    """(file offset, compressed size) of every frame, from the end of an open bundle of ``size`` bytes."""
    f.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if descriptor & 0x80 else 8
    f.seek(size - 9 - n * width)
    raw, at, out = f.read(n * width), 0, []
    for k in range(n):
        c, _ = struct.unpack_from("<II", raw, k * width)
        out.append((at, c))
        at += c
    return out


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int, date: str):
    def write(batches) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        ctx = TaskContext.get()
        # A retried or speculative attempt writes files of its own; only those of the attempt whose
        # index rows are committed are ever read.
        stem = f"{folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        fs, _ = filesystem(folder)
        packer = zstandard.ZstdCompressor(level=level)
        cols: dict[str, list] = {c.split()[0]: [] for c in INDEX_SCHEMA.split(", ")}
        state = {"out": None, "name": None, "n": 0, "at": 0, "sizes": [], "frame": bytearray()}

        def flush_frame():
            if state["frame"]:
                if state["out"] is None:
                    state["name"] = f"{stem}-{state['n']:05d}.warc.zst"
                    state["out"] = fs.open_output_stream(filesystem(state["name"])[1], compression=None)
                raw = bytes(state["frame"])
                packed = packer.compress(raw)
                state["out"].write(packed)
                state["sizes"].append((len(packed), len(raw)))
                state["at"] += len(packed)
                state["frame"] = bytearray()

        def flush_bundle():
            flush_frame()
            if state["out"] is not None:
                state["out"].write(seek_table(state["sizes"]))
                state["out"].close()
                state.update(out=None, name=None, n=state["n"] + 1, at=0, sizes=[])

        for batch in batches:
            for rid, uri, payload, hexdigest, refers in zip(*(batch.column(k).to_pylist() for k in range(5))):
                rid = "null" if rid is None else rid
                digest = base64.b32encode(bytes.fromhex(hexdigest)).decode()
                rec = format_record(rid, uri, digest, len(payload), refers, payload, date)
                if state["frame"] and len(state["frame"]) + len(rec) > frame_bytes:
                    flush_frame()
                    if state["at"] >= bundle_bytes:
                        flush_bundle()
                name = state["name"] or f"{stem}-{state['n']:05d}.warc.zst"
                for c, v in zip(cols, (rid, name, len(state["sizes"]), state["at"], len(state["frame"]), len(rec))):
                    cols[c].append(v)
                state["frame"] += rec
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["record_id"], pa.string()), pa.array(cols["bundle"], pa.string()),
                 pa.array(cols["frame"], pa.int32())] + [pa.array(cols[c], pa.int64()) for c in list(cols)[3:]],
                names=list(cols))
            for v in cols.values():
                v.clear()
        flush_bundle()
    return write


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url",
                   payload_col: str = "html", min_payload: int = 0, frame_bytes: int = 1 << 18,
                   bundle_bytes: int = 1 << 25, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into bundles under ``folder`` (a shared folder); returns the index.

    A first, narrow pass finds the smallest id of every digest held more than
    once.  That table is joined back to the rows: the planner broadcasts it if
    it is small, else both sides shuffle plainly, so that AQE can split the
    partition of a digest that many rows share.  Each task then streams its
    rows into frames; memory is one frame and the current batch.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(uri_col).cast("string").alias("_uri"),
                        payload.alias("_payload"), F.sha1(payload).alias("_digest"))
    firsts = cut(rows.filter(F.length("_payload") >= min_payload).groupBy("_digest")
                 .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                 .filter("_n > 1 AND _first IS NOT NULL").select("_digest", "_first"))
    refers = F.when((F.length("_payload") >= min_payload) & ~F.col("_id").eqNullSafe(F.col("_first")),
                    F.col("_first").cast("string"))
    marked = (rows.join(firsts, "_digest", "left")
              .select(F.col("_id").cast("string").alias("_id"), "_uri", "_payload", "_digest",
                      F.when(F.col("_first").isNotNull(), refers).alias("_refers")))
    index = marked.transform(small_batches).mapInArrow(_writer(folder, frame_bytes, bundle_bytes, level, date), INDEX_SCHEMA)
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _reader(batches) -> Iterator:
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = filesystem(uri)
            with fs.open_input_file(path) as f:
                for at, size in read_seek_table(f, f.size()):
                    f.seek(at)
                    data, pos, out = unpack.decompress(f.read(size)), 0, []
                    while pos < len(data):
                        rec, pos = parse_record(data, pos)
                        out.append(rec)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=names)


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles named in ``index``, frame by frame (``RECORD_SCHEMA``)."""
    bundles = index.select("bundle").distinct()
    # One bundle is one unit of work.  An explicit count keeps AQE from gathering these few bytes of
    # paths, which stand for whole files, into one task.
    n = max(1, bundles.count())
    return bundles.repartition(n).transform(small_batches).mapInArrow(_reader, RECORD_SCHEMA)


def read_record(bundle: str, frame_offset: int, frame: int, offset: int) -> dict:
    """Random access: the one record that an index row points to."""
    import zstandard
    fs, path = filesystem(bundle)
    with fs.open_input_file(path) as f:
        at, size = read_seek_table(f, f.size())[frame]
        assert at == frame_offset
        f.seek(at)
        return parse_record(zstandard.ZstdDecompressor().decompress(f.read(size)), offset)[0]


def roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Digest rows of every record after writing the archives and reading them back."""
    r = read_archives(write_archives(pages))
    num = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return r.select(num("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    num("refers_to").alias("refers_to"))


#: DuckDB form of ``roundtrip`` over ``pages``: base32 of a SHA-1 goes by eight groups of 20 bits.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
e AS (SELECT page_id, payload_bytes, h, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS g FROM d),
f AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g[k // 4 + 1] >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM e),
m AS (SELECT h, min(page_id) AS first FROM f GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f JOIN m USING (h)
"""
