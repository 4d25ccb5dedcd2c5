"""Packing: bounded-space online best-fit of token pieces into fixed-length sequences.

Each partition keeps a fixed number of open windows. A document's ids are cut at the sequence length; what is
left goes into the fullest window that still holds it. Where none does and no window is free, the fullest one is
emitted: topped up from the piece when its gap is worth a cut, as it is otherwise. At the end of its rows
a partition pours its open windows together, so that one is left over; leftovers of many partitions are then poured
together in groups, round by round, until one group is left. No row is shuffled but those leftovers.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` stays null; repeated rows are packed each;
an empty table gives no sequence; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced
from .encoding import CALL_BYTES, CALL_ROWS, END_ID, encoder, vocab_size
from .token_output import pack, unpack, width

LENGTH, WINDOWS, MIN_GAP = 4096, 64, 48
#: Leftovers (one a partition at most) that one task pours together.
MERGE = 256
PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
SEQUENCES = "part long, sequence_id long, full boolean, n_tokens int, payload binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = ["part", "sequence_id", "full", "n_tokens", "payload", "pieces"]


@dataclass
class Window:
    used: int = 0
    pieces: list = field(default_factory=list)  # (doc_id, start, ids, doc_tokens)

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self.pieces.append((doc_id, start, ids, doc_tokens))
        self.used += len(ids)


class Packer:
    """The open windows of one partition; :meth:`add` and :meth:`pour` return the windows that are done."""

    def __init__(self, length: int = LENGTH, windows: int = WINDOWS, min_gap: int = MIN_GAP):
        self.length, self.min_gap = length, min_gap
        self.open: list[Window] = []
        self.room = np.zeros(windows, np.int64)  # of the open windows; 0 where none is

    def add(self, doc_id, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> list[Window]:
        doc_tokens, done = len(ids) if doc_tokens is None else doc_tokens, []
        while len(ids) >= self.length:
            done.append(Window())
            done[-1].add(doc_id, start, ids[: self.length], doc_tokens)
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return done
        ids = ids.copy()  # an open window does not hold its batch
        n = len(self.open)
        fits = np.flatnonzero(self.room[:n] >= len(ids))
        if len(fits):
            at = int(fits[self.room[fits].argmin()])
        elif n < len(self.room):
            at = n
            self.open.append(Window())
            self.room[at] = self.length
        else:
            at = int(self.room.argmin())
            gap = int(self.room[at])
            if gap >= self.min_gap:
                self.open[at].add(doc_id, start, ids[:gap], doc_tokens)
                start, ids = start + gap, ids[gap:]
            done.append(self.open[at])
            self.open[at] = Window()
            self.room[at] = self.length
        self.open[at].add(doc_id, start, ids, doc_tokens)
        self.room[at] -= len(ids)
        if not self.room[at]:
            done.append(self.open.pop(at))
            self.room[at:-1] = self.room[at + 1 :].copy()
            self.room[-1] = 0
        return done

    def pour(self) -> tuple[list[Window], Window | None]:
        """Close all: the fullest windows stay whole, the others' pieces fill them; at most one is not full."""
        rest = sorted(self.open, key=lambda w: -w.used)
        self.open, self.room[:] = [], 0
        done = [w for w in rest if self.length - w.used < self.min_gap]
        rest = rest[len(done) :]
        now = None
        for w in rest:
            if now is None:
                now = w
                continue
            for doc_id, start, ids, doc_tokens in w.pieces:
                while len(ids):
                    gap = self.length - now.used
                    now.add(doc_id, start, ids[:gap], doc_tokens)
                    start, ids = start + min(gap, len(ids)), ids[gap:]
                    if now.used == self.length:
                        done.append(now)
                        now = Window()
        if now is not None and self.length - now.used < self.min_gap:
            done, now = [*done, now], None
        return done, now if now is not None and now.used else None


class Writer:
    """Numbers windows and turns them into Arrow batches. ``level``: 0 for the first pass, then the merge rounds."""

    def __init__(self, level: int, part: int, bits: int):
        self.part, self.bits, self.next = part, bits, level << 56 | part << 28

    def rows(self, windows: list[Window], full: bool = True) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], [], []]
        for w in windows:
            at, pieces = 0, []
            for doc_id, start, ids, doc_tokens in w.pieces:
                pieces.append({"doc_id": doc_id, "start": start, "length": len(ids), "doc_tokens": doc_tokens, "offset": at})
                at += len(ids)
            data = pack(np.concatenate([p[2] for p in w.pieces]), self.bits)
            for c, x in zip(cols, (self.part, self.next, full, w.used, data, pieces)):
                c.append(x)
            self.next += 1
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.list_(PIECE)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], COLUMNS)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = END_ID, length: int = LENGTH, windows: int = WINDOWS) -> DataFrame:
    """Sequences of all texts, written to the shared folder: ``sequence_id, n_tokens, payload`` (packed ids) and
    ``pieces`` (which ids of which document, and where)."""
    bits = width(max(vocab_size(vocabulary), end_id + 1))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, out = encoder(vocabulary), Packer(length, windows), Writer(0, TaskContext.get().partitionId(), bits)
        done: list[Window] = []
        for batch in sliced(batches, CALL_ROWS, CALL_BYTES):
            ids, at = enc.encode(batch.column(1), end_id)
            ids = ids.view(np.uint32)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                done += packer.add(doc_id, ids[at[k] : at[k + 1]])
                if len(done) >= 64:
                    yield out.rows(done)
                    done = []
        more, left = packer.pour()
        yield out.rows(done + more)
        if left:
            yield out.rows([left], False)

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, packer, out = None, None, None

            def close() -> Iterator[pa.RecordBatch]:
                done, left = packer.pour()
                yield out.rows(done)
                if left:
                    yield out.rows([left], False)

            for batch in sliced(batches, 64):
                for row in batch.to_pylist():
                    if row["part"] // MERGE != group:
                        if group is not None:
                            yield from close()
                        group = row["part"] // MERGE
                        packer, out = Packer(length, MERGE), Writer(level, group, bits)
                    w = Window()
                    ids = unpack(row["payload"], bits, 0, row["n_tokens"])
                    for p in row["pieces"]:
                        w.add(p["doc_id"], p["start"], ids[p["offset"] : p["offset"] + p["length"]], p["doc_tokens"])
                    packer.open.append(w)
            if group is not None:
                yield from close()

        return run

    now = saved(docs.select("doc_id", "text").mapInArrow(first, SEQUENCES), "packed", "zstd")
    out, level = now.filter("full"), 1
    left = now.filter(~F.col("full"))
    parts = now.agg(F.max("part")).first()[0] or 0
    while True:
        grouped = left.withColumn("g", F.expr(f"part div {MERGE}")).repartition("g").sortWithinPartitions("g", "part").select(*COLUMNS)
        now = saved(grouped.mapInArrow(merge(level), SEQUENCES), "packed", "zstd")
        if parts < MERGE:
            return out.unionByName(now)
        out, left = out.unionByName(now.filter("full")), now.filter(~F.col("full"))
        level, parts = level + 1, parts // MERGE


def read_pieces(sequences: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """A row per piece, its checksum taken from the stored ids."""
    bits = width(max(vocab_size(vocabulary), end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p = batch.column("pieces")
            n = pa.compute.list_value_length(p).to_numpy(zero_copy_only=False)
            flat = p.flatten()
            own = {k: flat.field(k) for k in ("doc_id", "start", "length", "doc_tokens", "offset")}
            crc, at = np.empty(len(flat), np.int64), 0
            off, size = own["offset"].to_numpy(), own["length"].to_numpy()
            for k, (data, total) in enumerate(zip(batch.column("payload").to_pylist(), batch.column("n_tokens").to_pylist())):
                raw = memoryview(unpack(data, bits, 0, total).astype("<u4").tobytes())
                for _ in range(int(n[k])):
                    crc[at] = zlib.crc32(raw[4 * int(off[at]) : 4 * int(off[at] + size[at])])
                    at += 1
            ids = pa.array(np.repeat(batch.column("sequence_id").to_numpy(), n))
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["start"], own["length"], pa.array(crc), own["doc_tokens"], ids, own["offset"]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.select("sequence_id", "n_tokens", "payload", "pieces").mapInArrow(run, PIECES)
