"""Token-ID output: fixed-width bit packing in self-describing blocks with document offsets.

A block holds whole documents in ascending ``doc_id`` order. Its bytes are a header, the document ids, the
documents' first positions and the ids at the vocabulary's minimum width, so a reader unpacks any span with a
few numpy operations and without touching the rest. Blocks are stored as rows of a Parquet table (the binary
column is the block file itself), because Spark's commit protocol then holds on any store and lost executors
cost only their own tasks.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` sorts first and stays null; rows with
one ``doc_id`` each count as a document, in the order of their texts' hashes; an empty table gives no block; other columns
of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced
from .encoding import CALL_BYTES, CALL_ROWS, END_ID, encoder

MAGIC, HEAD = b"CSB1", struct.Struct("<4sBxxxqq")
#: Ids after which a block is closed; a longer document is a block by itself.
BLOCK_IDS = 1 << 17
BLOCKS = "shard int, block int, first long, n_tokens long, payload binary"
DOCS = "shard int, local long, doc_id long, n_tokens long, ids_crc32 long"


def width(vocab_size: int) -> int:
    """The fewest bits that hold every id below ``vocab_size``."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{bits // 8}").tobytes()
    out = []
    for a in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        rows = (ids[a : a + (1 << 16)].astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(rows.astype(np.uint8).reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of what :func:`pack` made, reading only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-(start + n) * bits // 8)
    raw = np.frombuffer(bytes(data[low:high]) + b"\0" * 8, np.uint8)
    at = (start + np.arange(n, dtype=np.int64)) * bits - low * 8
    words = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        words |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_block(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The bytes of a block: header, null flags, document ids, first positions (and the end), packed ids."""
    n = len(doc_ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    own = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    return HEAD.pack(MAGIC, bits, n, len(ids)) + known.tobytes() + own.tobytes() + offsets.astype("<i8").tobytes() + pack(ids, bits)


class Block:
    """Random access to the documents of a block's bytes."""

    def __init__(self, data: bytes):
        magic, self.bits, n, self.n_tokens = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size
        known = np.frombuffer(data, np.uint8, n, at)
        own = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(own, known)]
        self.offsets = np.frombuffer(data, "<i8", n + 1, at + 9 * n)
        self.ids = memoryview(data)[at + 9 * n + 8 * (n + 1) :]

    def span(self, start: int, n: int) -> np.ndarray:
        return unpack(self.ids, self.bits, start, n)

    def doc(self, k: int) -> np.ndarray:
        return self.span(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k]))


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write all texts as blocks in ascending ``doc_id`` order; returns the written table.

    One range shuffle by id moves the texts; everything after it is local to a shard. Columns: ``shard`` (in order
    of ids), ``block``, ``first`` (ids of the shard before it), ``n_tokens``, ``payload``.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        bits = width(max(enc.vocab_size, end_id + 1))
        block, first, held, parts, sizes = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal block, first, held, parts, sizes
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data = write_block(held, offsets, np.concatenate(parts), bits)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([int(offsets[-1])]), pa.array([data], pa.binary())], ["shard", "block", "first", "n_tokens", "payload"])
            block, first, held, parts, sizes = block + 1, first + int(offsets[-1]), [], [], []
            return out

        for batch in sliced(batches, CALL_ROWS, CALL_BYTES):
            ids, at = enc.encode(batch.column(1), end_id)
            doc_ids, a = batch.column(0).to_pylist(), 0
            total = sum(sizes)
            for k in range(len(doc_ids)):
                total += int(at[k + 1] - at[k])
                if total >= block_ids or k == len(doc_ids) - 1:
                    held += doc_ids[a : k + 1]
                    parts.append(ids[at[a] : at[k + 1]])
                    sizes += np.diff(at[a : k + 2]).tolist()
                    a = k + 1
                if total >= block_ids:
                    yield close()
                    total = 0
        if held:
            yield close()

    # The range is over a hash of the text, as a sample of the keys goes to the driver.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h")
    ordered = keyed.sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    return saved(ordered.mapInArrow(blocks, BLOCKS), "tokens", "zstd")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """``shard, base``: the ids of all shards before each. Shards are no more than the tasks that wrote them."""
    base, rows = 0, []
    for r in sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()):
        rows.append((r.shard, base))
        base += r.n
    return blocks.sparkSession.createDataFrame(rows, "shard int, base long")


def read_index(blocks: DataFrame) -> DataFrame:
    """A row per document from the written blocks: ``doc_id, start, n_tokens, ids_crc32``."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                b = Block(data)
                ids, at = b.span(0, b.n_tokens), b.offsets
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * int(x) : 4 * int(y)]) for x, y in zip(at, at[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array(at[:-1] + first), pa.array(b.doc_ids, pa.int64()), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["shard", "local", "doc_id", "n_tokens", "ids_crc32"])

    index = blocks.select("shard", "first", "payload").mapInArrow(docs, DOCS)
    return index.join(F.broadcast(shard_starts(blocks)), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
