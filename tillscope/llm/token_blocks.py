"""Token ids in binary files of patched frame-of-reference blocks.

File, all little-endian: magic "PFOR0001"; blocks of 1024 ids; a footer of block starts (u64), document starts in ids (u64),
and document ids (i64, with a byte each that is 1 for null); the tail (u64 ids, u64 documents, u64 blocks, u64 footer start,
magic). A block: u32 minimum, u8 width, u8 spare, u16 number of exceptions; the low ``width`` bits of id - minimum, packed in 32
lanes (value j * 32 + lane is row j of its lane); exception positions (u16) and their high bits (u32). The width is the
bit length that at least PERCENT % of the block's values need. The last block is filled up with its first id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.llm.common import open_store, release
from tillscope.llm.tokens import encoder
from tillscope.session import fresh_path, settle

MAGIC = b"PFOR0001"
BLOCK, LANES = 1024, 32
PERCENT = 90
CHUNK = 256  # blocks coded at a time
HEAD, TAIL = struct.Struct("<IBBH"), struct.Struct("<QQQQ8s")


def _lanes(rows: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values below 2 ** width as (blocks, width, 32) words."""
    rows = rows.reshape(-1, LANES, LANES)
    out = np.zeros((len(rows), width, LANES), "<u4")
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 32)
        out[:, word] |= rows[:, j] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= rows[:, j] >> np.uint32(32 - shift)
    return out


def _unlanes(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), LANES, LANES), "<u4")
    mask = np.uint32((1 << width) - 1)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 32)
        value = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | (words[:, word + 1] << np.uint32(32 - shift))
        out[:, j] = value & mask
    return out.reshape(-1, BLOCK)


def _widths(spread: np.ndarray, percent: int) -> np.ndarray:
    """Per block the bit length that ``percent`` of the values need at most."""
    at = -(-BLOCK * percent // 100) - 1
    ranked = np.partition(spread, at, axis=1)[:, at]
    return np.frexp(ranked.astype(np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray, percent: int = PERCENT) -> list[bytes]:
    """Blocks of a multiple of 1024 unsigned 32-bit ids."""
    rows = ids.astype("<u4", copy=False).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    spread = rows - least[:, None]
    widths = _widths(spread, percent)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        of = np.nonzero(widths == width)[0]
        high = spread[of] >> np.uint32(width) if width < 32 else np.zeros((len(of), BLOCK), "<u4")
        packed = _lanes(spread[of] & np.uint32((1 << width) - 1), width)
        for k, block in enumerate(of.tolist()):
            where = np.nonzero(high[k])[0]
            head = HEAD.pack(int(least[block]), width, 0, len(where))
            out[block] = b"".join((head, packed[k].tobytes(), where.astype("<u2").tobytes(), high[k][where].astype("<u4").tobytes()))
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``raw``."""
    out = np.empty((len(starts), BLOCK), "<u4")
    heads = [HEAD.unpack_from(raw, s) for s in starts.tolist()]
    widths = np.array([h[1] for h in heads], np.uint8)
    for width in np.unique(widths).tolist():
        of = np.nonzero(widths == width)[0]
        size = width * LANES * 4
        words = np.stack([np.frombuffer(raw, "<u4", width * LANES, starts[k] + HEAD.size).reshape(width, LANES) for k in of])
        out[of] = _unlanes(words, width)
        for k in of.tolist():
            least, _, _, n = heads[k]
            at = int(starts[k]) + HEAD.size + size
            where = np.frombuffer(raw, "<u2", n, at)
            out[k, where] |= np.frombuffer(raw, "<u4", n, at + 2 * n) << np.uint32(width) if width < 32 else 0
            out[k] += np.uint32(least)
    return out.reshape(-1)


class Writer:
    """Appends documents to one file; holds at most CHUNK blocks of ids and the index."""

    def __init__(self, sink, percent: int = PERCENT):
        self.sink, self.percent = sink, percent
        self.starts, self.docs, self.nulls, self.blocks = [], [], bytearray(), []
        self.parts, self.held, self.ids, self.at = [], 0, 0, len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.starts.append(self.ids)
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.ids += len(ids) // 4
        if self.held >= CHUNK * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.parts), "<u4")
        if last and len(values) % BLOCK:
            values = np.concatenate([values, np.full(-len(values) % BLOCK, values[len(values) // BLOCK * BLOCK], "<u4")])
        full = len(values) // BLOCK * BLOCK
        for first in range(0, full, CHUNK * BLOCK):
            for block in encode_blocks(values[first : min(full, first + CHUNK * BLOCK)], self.percent):
                self.blocks.append(self.at)
                self.sink.write(block)
                self.at += len(block)
        self.parts, self.held = [values[full:].tobytes()], len(values) - full

    def close(self) -> None:
        self._flush(True)
        for part in (np.array(self.blocks, "<u8"), np.array(self.starts, "<u8"), np.array(self.docs, "<i8"), bytes(self.nulls)):
            self.sink.write(part if isinstance(part, bytes) else part.tobytes())
        self.sink.write(TAIL.pack(self.ids, len(self.docs), len(self.blocks), self.at, MAGIC))
        self.sink.close()


class Reader:
    """Documents of one file in order, or ids by position through the block index."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - TAIL.size)
        self.ids, self.n_docs, n_blocks, foot, magic = TAIL.unpack(source.read(TAIL.size))
        source.seek(0)
        if magic != MAGIC or source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token block file")
        source.seek(foot)
        read = lambda kind, n: np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
        self.blocks = np.append(read("<u8", n_blocks), foot).astype(np.int64)
        self.starts = np.append(read("<u8", self.n_docs), self.ids).astype(np.int64)
        self.docs, self.nulls = read("<i8", self.n_docs), read("u1", self.n_docs)

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; only the blocks that hold them are read."""
        first, last = start // BLOCK, -(-stop // BLOCK)
        if first >= last:
            return np.empty(0, "<u4")
        self.source.seek(int(self.blocks[first]))
        raw = self.source.read(int(self.blocks[last] - self.blocks[first]))
        ids = decode_blocks(raw, self.blocks[first:last] - self.blocks[first])
        return ids[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Reads CHUNK blocks at a time, or one document where it is longer."""
        k = 0
        while k < self.n_docs:
            upto = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + CHUNK * BLOCK, "right")) - 1)
            base = int(self.starts[k])
            ids = self.span(base, int(self.starts[upto]))
            for j in range(k, upto):
                doc = None if self.nulls[j] else int(self.docs[j])
                yield doc, ids[self.starts[j] - base : self.starts[j + 1] - base]
            k = upto


MANIFEST = "file_no long, file string, n_docs long, n_ids long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_blocks(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    files: int | None = None,
) -> DataFrame:
    """Encode every text (null: empty), end each document with ``end_id``, and write files in ascending id order.

    Documents are range-partitioned by id (nulls first, ties by text); one task writes one file of one range under a new name, so a
    task that runs again leaves only a file that the manifest does not list. The manifest, with the first id position ``start`` of
    each file, is returned settled; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64("_text")
    narrow = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    ordered = narrow.repartitionByRange(n, "_id", key).sortWithinPartitions("_id", key)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, store, name = encoder(tokenizer_path, ids=True), None, None, ""
        end = struct.pack("<I", end_id)
        for batch in batches:
            ids, texts, numbers = batch.column("_id").to_pylist(), batch.column("_text"), batch.column("_no")
            if writer is None and len(ids):
                store, base = open_store(folder)
                store.create_dir(base)
                number, name = numbers[0].as_py(), f"{numbers[0].as_py():06d}-{uuid.uuid4().hex}.pfor"
                writer = Writer(store.open_output_stream(f"{base}/{name}"))
            for doc, found in zip(ids, coder.of(t.as_py() or "" for t in texts)):
                writer.add(doc, found + end)
        release()
        if writer is not None:
            writer.close()
            row = {"file_no": [number], "file": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.ids]}
            yield pa.RecordBatch.from_pydict(row)

    numbered = ordered.withColumn("_no", F.spark_partition_id().cast("bigint"))
    listed = settle(numbered.mapInArrow(write, MANIFEST))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_blocks(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; one task reads one file at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as source:
                    found, at = [], row["start"]
                    for doc, ids in Reader(source).documents():
                        found.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(found) == 10_000:
                            yield _table(found)
                            found = []
                    if found:
                        yield _table(found)

    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(read, READ_BACK)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def written_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs`` to a new folder under the shared one and read the files back."""
    folder = fresh_path(docs.sparkSession, "token_blocks")
    return read_blocks(write_blocks(docs, folder, tokenizer_path, **options), folder)
