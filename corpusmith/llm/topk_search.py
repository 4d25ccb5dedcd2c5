"""Exact top-k search: BM25 over sharded inverted indexes, with block-max dynamic pruning.

Every task builds shards of a bounded number of words: sorted term hashes (64 bits of the lower-cased word), posting
lists, document lengths. Document frequencies, the number of documents and their mean length are counted over all shards, so
scores are global and the shards' results merge exactly.

A shard's documents are ordered by kind (k-means on frequent words, which tells languages apart) and length and cut into
segments. In a segment, terms that many of its documents have are columns of a matrix; other postings stay in lists. A batch of
queries of one kind is answered by block-max WAND on blocks of ``BLOCK`` documents, which all terms share: a cursor is moved by
blocks, and the pivot test is made for a block. Lists are read in full, in parts that stay in a core's cache, and give exact
partial scores; the maxima of the columns in a block, with its best partial score, bound what a document of it can
reach. A query reads a block's columns only if the bound reaches its threshold: the k-th best score so far, in this shard or (as the
floor that is carried on) in the shards before. Blocks come in rounds, those with the highest bounds first, and thresholds rise
between rounds and segments; where most of a segment is read, one matrix product does it. What reaches the k-th best is a
candidate, and the k best of these are scored in full, in double precision. Bounds are compared with a slack far above rounding, so
nothing is lost. The classic order of single postings reads fewer of them (a test counts both: for whole texts 0.39 of all
postings next to 0.92), but one after the other in interpreted code, where a matrix product takes a block's at once.

Shards belong to one of ``groups`` groups (of ``GROUP_SHARDS`` at most), and queries to chunks of about ``MAX_TERMS`` terms, as many as there are. A
task has one chunk and the shards of one group, which pass by one at a time; it carries the floors along and
emits a query's k best once, so hits are queries x groups x k. Queries and shards reach it by the shuffle, nothing by the driver.
Every chunk shuffles the whole index once more, so chunks are as large as a worker's memory bears.

Edge cases: a document without words, or with a null text, is never found, and as a query finds nothing; rows with
a null id are neither queries nor found; equal scores are ordered by id; repeated rows are found each; documents that share
no word with a query are not results, so a query may have fewer than k; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sliced

K1, B, K = 1.2, 0.75, 10
#: Words and documents after which a shard is closed, documents of a block, terms of a chunk of queries.
SHARD_WORDS, SHARD_DOCS, BLOCK, MAX_TERMS = 3_000_000, 60_000, 128, 7_000_000
#: Queries of a chunk whose terms are looked up at once.
PART = 2048
#: Groups of shards at least, and shards of a group at most, which bound a task.
GROUPS, GROUP_SHARDS = 8, 64
#: Rounds in which a segment's blocks are read: the share that each adds.
ROUNDS = (0.1, 0.3, 1.0)
#: Queries of a batch at most, and scores that it holds; relative slack of bounds (sums are in single precision); decimals of a score.
BATCH, CELLS, SLACK, DIGITS = 256, 2_000_000, 5e-4, 6
#: Kinds of documents that order a shard, the terms that tell them apart, documents of a segment.
KINDS, SIGNS, SEGMENT = 6, 256, 4096
#: A term is a column of a segment if this share of its documents, and so many of them, have it; cells of all columns
#: together; queries from which on one product for a whole segment is worth more than one for each block.
OFTEN, FEW, DENSE, MANY = 0.03, 8, 8_000_000, 16
#: Postings of lists that are read at once: what is made of them stays in a core's cache.
READ = 32_768
#: Documents, terms, postings and bytes of a shard, which follow compressed.
HEAD, CODEC = struct.Struct("<qqqq"), pa.Codec("zstd", compression_level=1)


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of all texts; which of them stands where, for all texts in a row, and in which text."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    index, docs = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), np.diff(at))
    if b"" in words:
        full = index != words.index(b"")
        index, docs = index[full], docs[full]
    return own, index, docs


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row as hashes, and the document of each."""
    own, index, docs = coded_words(texts)
    return own[index], docs


def build(ids: np.ndarray, hashes: np.ndarray, docs: np.ndarray, index: np.ndarray | None = None) -> bytes:
    """A shard's bytes from its documents' ids and its words (or, with ``index``, the place in ``hashes`` of each).
    Documents' numbers in it take 16 bits."""
    if len(ids) > 1 << 16:
        raise ValueError("too many documents for a shard")
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    terms, code = np.unique(hashes, return_inverse=True)
    code = code.reshape(-1).astype(np.int64) << 16
    key = (code if index is None else code[index]) | rank[docs]
    key.sort()
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    tf, key = np.diff(begin, append=len(key)), key[begin]
    used, doc = np.bincount(key >> 16, minlength=len(terms)), key & 0xFFFF
    terms, ptr = terms[used > 0], np.concatenate([[0], np.cumsum(used[used > 0])])
    length = np.bincount(rank[docs], minlength=len(ids))
    # Steps from one document of a list to the next compress well, in particular with their bytes apart.
    step = np.diff(doc, prepend=0)
    step[ptr[:-1]] = doc[ptr[:-1]]
    parts = ids[order].astype("<i8"), length.astype("<i4"), terms.astype("<u8"), ptr.astype("<i4"), (step & 255).astype("u1"), (step >> 8).astype("u1"), tf.astype("<u4")
    raw = b"".join(p.tobytes() for p in parts)
    return HEAD.pack(len(ids), len(terms), len(key), len(raw)) + CODEC.compress(raw, asbytes=True)


def unpack(data: bytes | pa.Buffer) -> Iterator[np.ndarray]:
    """A shard's arrays, in the order of :func:`build`: ids, lengths, terms, ends of lists, steps (low, high), counts."""
    n, t, p, size = HEAD.unpack_from(data)
    data, at = CODEC.decompress(memoryview(data)[HEAD.size :], size), 0
    for kind, count in (("<i8", n), ("<i4", n), ("<u8", t), ("<i4", t + 1), ("u1", p), ("u1", p), ("<u4", p)):
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        yield out


def lists(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """A shard's terms, and how many documents have each."""
    _, _, terms, ptr, *_ = unpack(data)
    return terms, np.diff(ptr)


class Shard:
    """A shard ready to be searched with global statistics; of its terms, those in ``among`` (sorted) if that is given."""

    def __init__(self, data: bytes | pa.Buffer, mean_length: float, among: np.ndarray | None = None):
        self.ids, self.length, self.terms, ptr, low, high, tf = unpack(data)
        n, size = len(self.ids), np.diff(ptr).astype(np.int64)
        total = np.cumsum(high.astype(np.int32) << 8 | low, dtype=np.int64)
        docs = (total - np.repeat(np.concatenate([[0], total])[ptr[:-1]], size)).astype(np.uint16)
        if among is not None:
            place = np.searchsorted(among, self.terms)
            place[place == len(among)] = 0
            here = among[place] == self.terms if len(among) else np.zeros(len(self.terms), bool)
            kept = np.repeat(here, size)
            self.terms, self.place, size, docs, tf = self.terms[here], place[here], size[here], docs[kept], tf[kept]
        t, self.size, self.docs = len(size), size, docs
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * self.length / mean_length))[docs])
        term = np.repeat(np.arange(t, dtype=np.int32), size)
        # The documents' own terms, for candidates.
        by_doc = np.argsort(docs, kind="stable")
        self.own_term, self.own_impact = term[by_doc], self.impact[by_doc]
        self.own_ptr = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])
        self.weight = np.zeros(t)
        self.counted: list[int] | None = None  # postings of the queries' terms here, and those that were read
        self._segments(term)

    def _segments(self, term: np.ndarray) -> None:
        """Documents by kind, the longest of a kind first, in segments of whole blocks; each has a place in this order."""
        n, t = len(self.ids), len(self.size)
        kind = self._kinds(n)
        order = np.lexsort((-self.length, kind))
        cuts = [c for part in np.split(np.arange(n), np.searchsorted(kind[order], np.arange(1, KINDS))) for c in np.split(part, range(SEGMENT, len(part), SEGMENT)) if len(c)]
        starts = np.concatenate([[0], np.cumsum([-(-len(c) // BLOCK) for c in cuts])]).astype(np.int64)
        self.blocks = int(starts[-1])
        self.at_place = np.full(self.blocks * BLOCK, -1)
        place, part = np.empty(n, np.int32), np.empty(n, np.uint8 if len(cuts) < 256 else np.uint16)
        for i, c in enumerate(cuts):
            spots = starts[i] * BLOCK + np.arange(len(c))
            self.at_place[spots], place[order[c]], part[order[c]] = order[c], spots, i
        part = part[self.docs]
        by_part, first = np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(cuts)))])
        self.segments, budget = [], max(1, DENSE // max(1, self.blocks * BLOCK))
        for i, (c, a, z) in enumerate(zip(cuts, starts[:-1].tolist(), starts[1:].tolist())):
            own = by_part[first[i] : first[i + 1]]
            code, spot, impact = term[own], place[self.docs[own]] - np.int32(a * BLOCK), self.impact[own].astype(np.float32)
            count = np.bincount(code, minlength=t)
            # Its frequent terms are columns, with their maxima in every block; the other postings stay in lists.
            often = np.flatnonzero(count >= max(FEW, len(c) * OFTEN))
            often = np.sort(often[np.argsort(-count[often], kind="stable")[:budget]])
            column = np.full(t, -1, np.int32)
            column[often] = np.arange(len(often), dtype=np.int32)
            to = column[code]
            dense = np.zeros((len(often), (z - a) * BLOCK), np.float32)
            dense[to[to >= 0], spot[to >= 0]] = impact[to >= 0]
            # In the table of columns, lists go below -1. A posting is its document and its impact in eight bytes.
            held = to < 0
            begin = np.flatnonzero(np.diff(code[held], prepend=-1))
            column[code[held][begin]] = -2 - np.arange(len(begin), dtype=np.int32)
            packed = np.empty((int(held.sum()), 2), np.int32)
            packed[:, 0], packed[:, 1] = spot[held], impact[held].view(np.int32)
            block_max = dense.reshape(len(often), z - a, BLOCK).max(2)
            self.segments.append((a, z, column, dense, block_max, np.append(begin, len(packed)), packed.view(np.int64).reshape(-1)))

    def _kinds(self, n: int) -> np.ndarray:
        """A number for every document, alike for those that share frequent words (say, a language): a few rounds of
        k-means on the most frequent terms. It only orders documents; no result depends on it."""
        self.signs = np.argsort(-self.size, kind="stable")[:SIGNS]
        rows = np.zeros((n, len(self.signs)), np.float32)
        for j, t in enumerate(self.signs):
            rows[self.docs[self.ptr[t] : self.ptr[t + 1]], j] = 1
        many = rows.sum(1)
        rows /= np.maximum(1, np.sqrt(many))[:, None]
        # Each start is the document, of those with many such terms, that is least like those before it.
        start, like = [], np.where(many >= np.median(many) if n else many > 0, 0, 2).astype(np.float32)
        for _ in range(min(KINDS, n)):
            start.append(int(np.argmin(like)))
            like = np.maximum(like, rows @ rows[start[-1]])
        self.means = rows[start]
        for _ in range(4 if n else 0):
            near = (rows @ self.means.T).argmax(1)
            self.means = np.stack([rows[near == j].sum(0) for j in range(len(start))])
            self.means /= np.maximum(1e-9, np.linalg.norm(self.means, axis=1, keepdims=True))
        return (rows @ self.means.T).argmax(1) if n else np.zeros(0, np.int64)

    def kinds_of(self, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The kind of each query, so that like ones can be asked together."""
        sign = np.full(len(self.size), -1, np.int32)
        sign[self.signs] = np.arange(len(self.signs))
        sign, query = sign[term], np.repeat(np.arange(len(at) - 1), np.diff(at))
        like = [np.bincount(query[sign >= 0], m[sign[sign >= 0]], len(at) - 1) for m in self.means]
        return np.argmax(like, 0) if like else np.zeros(len(at) - 1, np.int64)

    def count(self) -> None:
        """From now on, keep count of postings (for tests)."""
        self.counted = [0, 0]

    def search(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For queries (the terms from ``at[q]`` to ``at[q + 1]``, by ordinal, with their weights): number of the
        query, documents and scores of its top k among those that reach its floor. Queries without any are left out."""
        step = max(4, min(BATCH, CELLS // max(1, self.blocks * BLOCK)))
        for a in range(0, len(at) - 1, step):
            ends = at[a : a + step + 1]
            yield from self._some(a, ends - ends[0], term[ends[0] : ends[-1]], weight[ends[0] : ends[-1]], k, floors[a : a + step])

    def _some(self, first: int, at: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, floors: np.ndarray):
        g = len(at) - 1
        if not len(term) or not self.blocks:
            return
        query, single = np.repeat(np.arange(g), np.diff(at)), weight.astype(np.float32)
        if self.counted is not None:
            self.counted[0] += int(self.size[term].sum())
        peaks, least, scored = np.zeros((g, self.blocks), np.float32), floors, []
        columns = [s[2][term] for s in self.segments]
        # The segments that have most of the terms come first, so that thresholds rise early.
        for i in np.argsort([-np.count_nonzero(c + 1) for c in columns], kind="stable").tolist():
            scored.append((self.segments[i][0], self._score(i, query, columns[i], single, least, peaks, k)))
            least = np.maximum(least, _kth(peaks, k))
        if self.blocks < k:
            least = np.maximum(least, _kth(np.concatenate([tiles.reshape(g, -1) for _, tiles in scored], 1), k))
        least, found = least - SLACK * np.maximum(1, least), []
        for a, tiles in scored:
            tops = peaks[:, a : a + tiles.shape[1]]
            row, block = np.nonzero((tops > 0) & (tops >= least[:, None]))
            near = tiles[row, block]
            which, inside = np.nonzero((near > 0) & (near >= least[row, None]))
            found.append((row[which], self.at_place[(a + block[which]) * BLOCK + inside], near[which, inside]))
        owner, docs, rough = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-rough, owner))
        owner, docs, rough = owner[order], docs[order], rough[order]
        # No more than the k best of them, and what rounding does not tell from the last of these.
        ends = np.searchsorted(owner, np.arange(g + 1))
        last = np.append(rough, 0)[np.where(np.diff(ends) < k, -1, ends[:-1] + k - 1)]
        near = rough >= (last - SLACK * np.maximum(1, last))[owner]
        owner, docs = owner[near], docs[near]
        ends = np.searchsorted(owner, np.arange(g + 1)).tolist()
        for q in np.unique(owner).tolist():
            cand, a, z = docs[ends[q] : ends[q + 1]], at[q], at[q + 1]
            # Scored in full, each document by its own terms in one fixed order.
            self.weight[term[a:z]] = weight[a:z]
            spans = [slice(*x) for x in zip(self.own_ptr[cand].tolist(), self.own_ptr[cand + 1].tolist())]
            own, impact = np.concatenate([self.own_term[x] for x in spans]), np.concatenate([self.own_impact[x] for x in spans])
            starts = np.cumsum([0, *(x.stop - x.start for x in spans[:-1])])
            scores = np.round(np.add.reduceat(self.weight[own] * impact, starts), DIGITS)
            self.weight[term[a:z]] = 0
            top = np.lexsort((self.ids[cand], -scores))[:k]
            yield first + q, cand[top], scores[top]

    def _score(self, i: int, query: np.ndarray, spot: np.ndarray, weight: np.ndarray, least: np.ndarray, peaks: np.ndarray, k: int) -> np.ndarray:
        """The queries' scores in a segment by blocks; what cannot reach ``least`` may stay below its score. ``spot`` are
        the terms' columns, ``peaks`` the best of every block so far, which this adds to."""
        a, z, _, dense, block_max, ptr, packed = self.segments[i]
        g, span = len(least), (z - a) * BLOCK
        # What stays in lists is read in full.
        use = np.flatnonzero(spot < -1)
        begin = ptr[-2 - spot[use]]
        size = ptr[-1 - spot[use]] - begin
        total, sums = np.concatenate([[0], np.cumsum(size)]), np.zeros(g * span, np.float32)
        owner = np.empty((len(use), 2), np.int32)
        owner[:, 0], owner[:, 1] = query[use] * np.int32(span), weight[use].view(np.int32)
        owner, begin = owner.view(np.int64).reshape(-1), begin - total[:-1]
        cuts = [*np.searchsorted(total, np.arange(0, total[-1], READ)).tolist(), len(use)]
        for x, y in zip(cuts, cuts[1:]):
            flat = np.arange(total[x], total[y])
            flat += np.repeat(begin[x:y], size[x:y])
            own, post = np.repeat(owner[x:y], size[x:y]).view(np.int32).reshape(-1, 2), packed[flat].view(np.int32).reshape(-1, 2)
            np.add.at(sums, np.add(own[:, 0], post[:, 0], dtype=np.int64), own[:, 1].view(np.float32) * post[:, 1].view(np.float32))
        tiles = sums.reshape(g, z - a, BLOCK)
        peaks[:, a:z] = tiles.max(2)
        # Of the columns, only blocks whose maxima can reach the threshold.
        use = np.flatnonzero(spot >= 0)
        w = np.zeros((g, len(dense)), np.float32)
        w[query[use], spot[use]] = weight[use]
        best = w @ block_max + peaks[:, a:z]
        if self.counted is not None:
            filled = (dense > 0).reshape(len(dense), z - a, BLOCK).sum(2)
            self.counted[1] += int(total[-1])
        order = np.argsort(-(best - least[:, None]).max(0), kind="stable")
        done = 0
        for share in ROUNDS:
            least = np.maximum(least, _kth(peaks, k))
            live = best >= (least - SLACK * np.maximum(1, least))[:, None]
            if not done and g >= MANY and live.mean() > 0.25 and self.counted is None:
                tiles += (w @ dense).reshape(tiles.shape)
                peaks[:, a:z] = tiles.max(2)
                return tiles
            stop = min(z - a, done + max(1, round(share * (z - a))))
            for b in order[done:stop].tolist():
                q = np.flatnonzero(live[:, b])
                if len(q):
                    tile = tiles[q, b] + w[q] @ dense[:, b * BLOCK : (b + 1) * BLOCK]
                    tiles[q, b], peaks[q, a + b] = tile, tile.max(1)
                    if self.counted is not None:
                        self.counted[1] += int(((w[q] > 0) @ filled[:, b]).sum())
            done = stop
        return tiles


def _kth(peaks: np.ndarray, k: int) -> np.ndarray:
    """A bound that k documents of each query reach: the k-th best of its blocks' best ones, if there are so many."""
    return np.partition(peaks, peaks.shape[1] - k, 1)[:, -k] if peaks.shape[1] >= k else np.zeros(len(peaks), np.float32)


def index(docs: DataFrame) -> DataFrame:
    """The shards of all documents as a written table: ``slot`` (to deal them out by), ``n, words, payload``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, index, owner, n, known, words, shard = [], [], [], [], 0, 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            nonlocal ids, hashes, index, owner, n, known, words, shard
            docs = np.concatenate(owner)
            data, found = build(np.concatenate(ids), np.concatenate(hashes), docs, np.concatenate(index)), np.count_nonzero(np.bincount(docs))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([found], pa.int64()), pa.array([words], pa.int64()), pa.array([data], pa.binary())], ["slot", "n", "words", "payload"])
            ids, hashes, index, owner, n, known, words, shard = [], [], [], [], 0, 0, 0, shard + 1
            return out

        for batch in sliced(batches):
            h, i, d = coded_words(batch.column(1))
            ids.append(batch.column(0).to_numpy())
            hashes.append(h)
            index.append((i + known).astype(np.int32))
            owner.append((d + n).astype(np.int32))
            n, known, words = n + batch.num_rows, known + len(h), words + len(d)
            if words >= SHARD_WORDS or n >= SHARD_DOCS:
                yield close()
        if n:
            yield close()

    known = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    return saved(known.mapInArrow(run, "slot int, n long, words long, payload binary"), "index", "none")


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, h, tf``: the distinct words of each query; a query's rows with one id count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            h, d = term_hashes(batch.column(1))
            ids = batch.column(0).to_numpy()[d] if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(h.view(np.int64))], ["qid", "h"])

    known = queries.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    return known.mapInArrow(run, "qid long, h long").groupBy("qid", "h").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, queries: DataFrame, k: int = K, groups: int = GROUPS) -> DataFrame:
    """``doc_id, rank, match_id, score``: the k best documents of ``docs`` for every text of ``queries``."""
    shards = index(docs)
    n, words, count = shards.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    groups = max(groups, -(-count // GROUP_SHARDS))
    mean = words / n if n else 1.0

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [lists(x.as_buffer()) for x in batch.column(0)]
            if own:
                terms, at = np.unique(np.concatenate([t for t, _ in own]), return_inverse=True)
                sums = np.bincount(at.reshape(-1), np.concatenate([c for _, c in own]), len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(sums)], ["h", "n"])

    terms = saved(query_terms(queries), "terms")
    counts = shards.select("payload").mapInArrow(frequencies, "h long, n long")
    df = counts.join(terms.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("df"))
    weight = F.col("tf") * F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "h").select("qid", "h", weight.alias("w"))
    weighted = saved(weighted.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("h", "w"))).alias("t")).select("qid", "t.h", "t.w"), "queries")
    total = weighted.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // MAX_TERMS))
    # Queries go to every group, shards to every chunk; a task gets its queries first.
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = weighted.select(F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("chunk"), every(groups).alias("g"), F.lit(0).alias("kind"), "qid", "h", "w", F.lit(None).cast("binary").alias("payload"))
    held = shards.select(every(chunks).alias("chunk"), (F.col("slot") % groups).alias("g"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("qid"), F.lit(None).cast("array<bigint>").alias("h"), F.lit(None).cast("array<double>").alias("w"), "payload")
    both = asked.unionByName(held).withColumn("key", F.col("chunk") * groups + F.col("g")).drop("chunk", "g")
    dealt = both.repartitionById(chunks * groups, F.col("key")).sortWithinPartitions("key", "kind", "qid")
    found = saved(dealt.mapInArrow(_answer(mean, k), "qid long, match_id long, score double"), "hits")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "match_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("doc_id"), "rank", "match_id", "score")


class Chunk:
    """A chunk of queries, with the best that each has found so far. Its terms are numbered once, for all shards."""

    def __init__(self, parts: list[pa.RecordBatch], k: int):
        self.qids = np.concatenate([p.column("qid").to_numpy() for p in parts])
        self.at = np.concatenate([[0], np.cumsum(np.concatenate([pc.list_value_length(p.column("h")).to_numpy() for p in parts]))])
        self.w = np.concatenate([p.column("w").flatten().to_numpy() for p in parts])
        self.terms = np.zeros(0, np.uint64)
        for p in parts:
            self.terms = np.union1d(self.terms, p.column("h").flatten().to_numpy().view(np.uint64))
        self.term = np.concatenate([np.searchsorted(self.terms, p.column("h").flatten().to_numpy().view(np.uint64)).astype(np.int32) for p in parts])
        self.k, self.floors, self.order = k, np.zeros(len(self.qids)), None
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _asked(self, queries: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of some queries as a shard numbers them, without those that it does not have."""
        size = self.at[queries + 1] - self.at[queries]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.at[queries] - total[:-1], size) + np.arange(total[-1])
        term = number[self.term[flat]]
        here = term >= 0
        return np.concatenate([[0], np.cumsum(here)])[total], term[here], self.w[flat[here]]

    def see(self, shard: Shard) -> None:
        if not len(shard.terms):
            return
        number = np.full(len(self.terms), -1, np.int32)
        number[shard.place] = np.arange(len(shard.place), dtype=np.int32)
        parts = range(0, len(self.qids), PART)
        if self.order is None:  # like queries are asked together
            kinds = [shard.kinds_of(*self._asked(np.arange(a, min(a + PART, len(self.qids))), number)[:2]) for a in parts]
            self.order = np.argsort(np.concatenate(kinds), kind="stable")
        for a in parts:
            queries = self.order[a : a + PART]
            for i, docs, scores in shard.search(*self._asked(queries, number), self.k, self.floors[queries]):
                q, ids = int(queries[i]), shard.ids[docs]
                if q in self.best:
                    ids, scores = np.concatenate([self.best[q][0], ids]), np.concatenate([self.best[q][1], scores])
                    top = np.lexsort((ids, -scores))[: self.k]
                    ids, scores = ids[top], scores[top]
                self.best[q] = ids, scores
                if len(ids) == self.k:
                    self.floors[q] = scores[-1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.best:
            own = np.repeat(self.qids[list(self.best)], [len(i) for i, _ in self.best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(np.concatenate(c)) for c in zip(*self.best.values()))], ["qid", "match_id", "score"])


def _answer(mean: float, k: int):
    """What a task does: for each key, gather its queries, let its shards pass, emit the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, chunk = None, [], None
        for batch in batches:
            keys, kinds = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(keys)] if len(keys) else []
            for a, z in zip(cuts, cuts[1:]):
                if keys[a] != key:
                    if chunk:
                        yield from chunk.rows()
                    key, parts, chunk = keys[a], [], None
                if kinds[a] == 0:
                    parts.append(batch.slice(a, z - a))
                elif parts or chunk:
                    chunk, parts = chunk or Chunk(parts, k), []
                    for i in range(a, z):
                        chunk.see(Shard(batch.column("payload")[i].as_buffer(), mean, chunk.terms))
        if chunk:
            yield from chunk.rows()

    return run


def oracle(every: int = 50, k: int = K) -> str:
    """DuckDB SQL for :func:`search` on ``documents``, queries being the rows whose id is divisible by ``every``."""
    return f"""
WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS t FROM documents WHERE doc_id IS NOT NULL),
tf AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY doc_id, t),
len AS (SELECT doc_id, sum(n) AS l FROM tf GROUP BY doc_id),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(l) / CAST(count(*) AS DOUBLE) AS mean FROM len),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT tf.doc_id AS qid, t, tf.n * ln(1 + (st.n - df + 0.5) / (df + 0.5)) AS w FROM tf JOIN df USING (t), st WHERE tf.doc_id % {every} = 0),
s AS (SELECT qid, tf.doc_id AS match_id, round(sum(w * tf.n * {K1 + 1} / (tf.n + {K1} * (1 - {B} + CAST({B} AS DOUBLE) * l / st.mean))), {DIGITS}) AS score FROM q JOIN tf USING (t) JOIN len ON len.doc_id = tf.doc_id, st GROUP BY qid, tf.doc_id)
SELECT qid AS doc_id, rank, match_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, match_id) AS rank FROM s) WHERE rank <= {k}"""
