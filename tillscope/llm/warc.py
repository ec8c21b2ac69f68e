"""WARC archives: segmented writing, and reassembly of segments with chunked transfer framing.

A record's block is an HTTP response whose body is chunked. A block over SEGMENT_BYTES is cut: the first segment is the response record, the
others are continuation records with the origin's id, their segment number, and on the last one the total length. Every record is a
gzip member of its own; a task starts a new archive after FILE_BYTES, so segments of a record may lie in different archives. Reading does
not rely on their order: continuation records are grouped by the origin's id, sorted by number, and checked for gaps, the total length and
the payload's digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import join_small, open_store
from tillscope.session import settle

SEGMENT_BYTES = 4096
CHUNK_BYTES = 1500
FILE_BYTES = 64 << 20
MIN_REVISIT_BYTES = 100
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PAGE = re.compile(r"<urn:page:(-?\d+|none)")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it should")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, with chunked framing taken off."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(headers: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, segmented where the block is long."""
    name = "none" if page is None else page
    origin = f"<urn:page:{name}:{uuid.uuid4().hex}>"
    uri = re.sub(r"[\r\n]+", " ", url) if url else None
    shared = {"WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        yield _record({"WARC-Type": "revisit", "WARC-Record-ID": origin, "WARC-Refers-To": f"<urn:page:{refers_to}>", **shared}, b"")
        return
    block = HTTP_HEAD + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for number, part in enumerate(parts, 1):
        long = len(parts) > 1
        yield _record(
            {
                "WARC-Type": "response" if number == 1 else "continuation",
                "WARC-Record-ID": origin if number == 1 else f"<urn:uuid:{uuid.uuid4()}>",
                "WARC-Segment-Number": number if long else None,
                "WARC-Segment-Origin-ID": origin if number > 1 else None,
                "WARC-Segment-Total-Length": len(block) if long and number == len(parts) else None,
                **shared,
            },
            part,
        )


def parsed(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower case) and block of each record of a gzipped archive; one record in memory at a time."""
    unpacker, held = zlib.decompressobj(31), []
    while chunk := source.read(1 << 20):
        while chunk:
            held.append(unpacker.decompress(chunk))
            chunk = unpacker.unused_data if unpacker.eof else b""
            if unpacker.eof:
                head, _, rest = b"".join(held).partition(b"\r\n\r\n")
                fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                fields = {k.lower(): v for k, v in fields.items()}
                yield fields, rest[: int(fields["content-length"])]
                unpacker, held = zlib.decompressobj(31), []


def decided(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: of equal payloads of at least 100 bytes all but the least id revisit it.

    A null payload is empty. Rows that repeat the least id are responses too; a row without an id revisits the least id there is.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    long = F.octet_length("payload") >= MIN_REVISIT_BYTES
    firsts = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = join_small(rows, settle(firsts.select("digest", "first")), ["digest"], limit=100_000)  # spread over salts beyond that
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``decided`` pages; the manifest of archives (``file, n_records``), settled.

    Archives get new names, so one that a lost task left behind is in no manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base)
        sink, name, n, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                for raw in records(*(c[k].as_py() for c in columns), segment=segment):
                    if sink is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        sink, n, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                    sink.write(raw)
                    n, size = n + 1, size + len(raw)
                    if size >= file_bytes:
                        sink.close()
                        done.append((name, n))
                        sink = None
        if sink is not None:
            sink.close()
            done.append((name, n))
        if done:
            yield pa.RecordBatch.from_pydict({"file": [d[0] for d in done], "n_records": [d[1] for d in done]})

    return settle(pages.mapInArrow(write, "file string, n_records long"))


RECORD = "origin string, number int, total long, type string, page_id long, refers_to long, digest string, block binary"


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives; ``origin`` is the id of the first segment."""
    schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])

    def page_in(text: str | None) -> int | None:
        found = _PAGE.match(text or "")
        return int(found[1]) if found and found[1] != "none" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{file}", compression=None) as source:
                    for h, block in parsed(source):
                        origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                        rows.append({
                            "origin": origin, "number": int(h.get("warc-segment-number", 0)) or None,
                            "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                            "type": h["warc-type"], "page_id": page_in(origin), "refers_to": page_in(h.get("warc-refers-to")),
                            "digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "block": block,
                        })
                        held += len(block) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, RECORD)


def reassembled(found: DataFrame) -> DataFrame:
    """``page_id, digest, payload`` of every response; payload is null where segments are missing, too long or damaged.

    Continuation records are grouped by their origin: a group is the segments of one payload.
    """
    responses = found.where("type <> 'revisit'")
    whole = responses.where("number is null").select("page_id", "digest", F.array("block").alias("blocks"), F.lit(True).alias("ok"))
    cut = (
        responses.where("number is not null")
        .groupBy("origin")
        .agg(
            F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
            F.min("page_id").alias("page_id"), F.min("digest").alias("digest"),
        )
        .select(
            "page_id", "digest", F.col("parts.block").alias("blocks"),
            (
                F.col("parts.number").eqNullSafe(F.sequence(F.lit(1), F.size("parts")))
                & F.col("total").eqNullSafe(F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p["block"])))
            ).alias("ok"),
        )
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for digest, blocks, ok in zip(*(batch.column(c) for c in ("digest", "blocks", "ok"))):
                try:
                    payload = payload_of(b"".join(blocks.as_py())) if ok.as_py() else None
                except ValueError:
                    payload = None
                intact = payload is not None and hashlib.sha256(payload).hexdigest() == digest.as_py()
                payloads.append(payload if intact else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("digest"), pa.array(payloads, pa.binary())], ["page_id", "digest", "payload"]
            )

    return whole.unionByName(cut).mapInArrow(decode, "page_id long, digest string, payload binary")


def pages_read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per page ``page_id, payload_bytes, payload_digest, record_type, refers_to``, read from the archives.

    A revisit has the figures of the response it refers to; figures are null where that, or the payload itself, is not intact. The
    archives are read twice, once for payloads and once for revisits, rather than copied.
    """
    bodies = reassembled(read_records(manifest, folder)).select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    bodies = settle(bodies)
    targets = bodies.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(
        F.max("payload_bytes").alias("payload_bytes")
    )
    revisits = read_records(manifest, folder).where("type = 'revisit'").select("page_id", "refers_to", "digest").join(targets, ["refers_to", "digest"], "left")
    figures = F.when(F.col("payload_bytes").isNotNull(), F.col("digest")).alias("payload_digest")
    again = revisits.select("page_id", "payload_bytes", figures, F.lit("revisit").alias("record_type"), "refers_to")
    own = bodies.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return own.unionByName(again)
