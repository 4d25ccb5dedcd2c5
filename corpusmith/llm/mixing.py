"""Mixing sources to target weights, in fixed-length blocks of words.

A source's documents in ``doc_id`` order form one stream of words, cut into blocks. Every output shard draws how
many of its slots each source fills: a multinomial over what the sources still owe, so their totals are exact. A
source's slots run through pseudorandom permutations of its block numbers, one permutation for each pass, and
each slot is joined to its block by (source, block). The last block of a source's last pass is cut to the target.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last;
a null ``doc_id`` comes first in its source; repeated rows are separate documents; an empty table gives no row;
other columns of the input are ignored. The driver holds the distinct sources with their sizes and at most ``DRAWN``
numbers of draws, whatever the number of documents; tasks part each draw into shards of ``SHARD`` slots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved, sliced

BLOCK, SHARE, WEIGHTS, CAP = 256, 1.5, (5.0, 2.0, 1.0), 2.0
#: Slots of an output shard; groups of shards that the driver draws, and numbers (groups x sources) that it draws at most.
SHARD, GROUPS, DRAWN = 4096, 4096, 4_000_000
#: Sources up to which their table is broadcast (some 100 bytes each).
FEW_SOURCES = 50_000
KEYED = "key long, part int, source string, doc_id long, h long, size long, local long"


def words(text: str) -> object:
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Each source's words: ``share`` of all by repeating weights, at most ``cap`` times its size, the excess
    reshared by weight until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while free:
        unit = left / sum(w[i] for i in free)
        over = [i for i in free if unit * w[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


class Permutation:
    """A pseudorandom permutation of range(n): a Feistel network over the next power of four, walked until it falls
    into the range."""

    def __init__(self, n: int, key):
        self.n, self.half = n, max(1, (int(n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def _f(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        f = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        f ^= f >> np.uint64(29)
        f *= np.uint64(0xBF58476D1CE4E5B9)
        return (f >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            left, right = (right ^ self._f(left, k), left) if back else (right, left ^ self._f(right, k))
        return left << np.uint64(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x).astype(np.uint64), back)
            while len(far := np.flatnonzero(out >= np.uint64(self.n))):
                out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def at(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def place(self, value: int) -> int:
        """The index at which ``value`` stands."""
        return int(self._walk(np.array([value]), True)[0])


def parted(owed: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Deals ``owed`` slots of each source into parts of ``size`` slots: multinomials over what is still owed."""
    owed = owed.copy()
    total = int(owed.sum())
    while total > 0:
        room, drawn = min(size, total), np.zeros(len(owed), np.int64)
        while room:
            left = owed - drawn
            more = np.minimum(rng.multinomial(room, left / left.sum()), left)
            drawn += more
            room -= int(more.sum())
        owed -= drawn
        total -= int(drawn.sum())
        yield drawn


@dataclass
class Plan:
    """Of each source: its name, words, target, blocks, slots, and the words that its last slot takes."""

    names: list
    sizes: list[int]
    targets: list[float]
    block: int
    seed: int

    def __post_init__(self):
        b = self.block
        self.blocks, self.slots, self.last = [], [], []
        for s, (size, target) in enumerate(zip(self.sizes, self.targets)):
            n, want = -(-size // b), min(round(target), int(CAP * size)) if size else 0
            passes, rest = divmod(want, size) if size else (0, 0)
            k, took = 0, b
            if rest:
                # Slots until the words are reached; the last block, wherever its slot is, may be shorter than the others.
                p, short = Permutation(n, self.key(s, passes)).place(n - 1), size - (n - 1) * b
                if rest <= p * b:
                    k = -(-rest // b)
                    took = rest - (k - 1) * b
                elif rest <= p * b + short:
                    k, took = p + 1, rest - p * b
                else:
                    more = rest - p * b - short
                    k = p + 1 - (-more // b)
                    took = more - (k - p - 2) * b
            self.blocks.append(n)
            self.slots.append(passes * n + k)
            self.last.append(took)

    def key(self, source: int, turn: int) -> list[int]:
        return [self.seed, source, turn]

    def groups(self) -> list[tuple[int, int, list[int], list[int]]]:
        """Groups of output shards: number, first shard, how many slots each source fills, and from which of its slots on."""
        owed = np.array(self.slots, np.int64)
        most = max(1, min(GROUPS, DRAWN // max(1, len(owed))))
        shards = -(-int(owed.sum()) // (most * SHARD)) if len(owed) else 0
        first, out = np.zeros(len(owed), np.int64), []
        for drawn in parted(owed, max(1, shards) * SHARD, np.random.default_rng(self.seed)):
            out.append((len(out), len(out) * shards, drawn.tolist(), first.tolist()))
            first = first + drawn
        return out


def number(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, share: float = SHARE, seed: int = 42) -> tuple[DataFrame, DataFrame, Plan]:
    """The documents with their place in their source's stream, the sources' plan as a table and as an object.

    Running sums are taken in two levels over range partitions, so a hot source is no single task's.
    """
    spark = docs.sparkSession
    narrow = saved(docs.select(F.col("source").cast("string"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), words("text").alias("size")), "sizes")
    rows = narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    names = [r.source for r in rows]
    plan = Plan(names, [r.n for r in rows], targets([r.n for r in rows], weights, share), block, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, carried = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            n, size = batch.num_rows, batch.column("size").to_numpy()
            if not n:
                continue
            # Rows come sorted, so a source's are a run.
            coded = batch.column("source").dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
            total = np.cumsum(size)
            base = np.where(begins > 0, total[begins - 1], 0)
            if at and coded.dictionary[int(code[0])].as_py() == last:
                base[0] -= carried
            local = total - size - np.repeat(base, np.diff([*begins, n]))
            last, carried = coded.dictionary[int(code[-1])].as_py(), int(local[-1] + size[-1])
            keys = (part << 36) + at + np.arange(n)
            at += n
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([part] * n, pa.int32()), batch.column("source"), batch.column("doc_id"), batch.column("h"), batch.column("size"), pa.array(local)], ["key", "part", "source", "doc_id", "h", "size", "local"])

    order = ["source", "doc_id", "h", "size"]
    keyed = saved(narrow.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, KEYED), "keyed")
    base, done, sid = [], [0] * len(names), {name: i for i, name in enumerate(names)}
    sums = keyed.groupBy("part", "source").agg(F.sum("size").alias("n")).collect()  # partitions and sources at most
    for part, s, n in sorted((r.part, sid[r.source], r.n) for r in sums):
        base.append((part, s, names[s], done[s]))
        done[s] += n
    few = F.broadcast if len(base) <= FEW_SOURCES else (lambda df: df)
    before = few(spark.createDataFrame(base, "p int, sid int, s string, base long"))
    placed = keyed.join(before, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("start", F.col("base") + F.col("local"))
    about = spark.createDataFrame([(i, n, z, float(t)) for i, (n, z, t) in enumerate(zip(names, plan.sizes, plan.targets))], "sid int, source string, source_size long, target double")
    about = F.broadcast(about) if len(names) <= FEW_SOURCES else about
    return placed.select("key", "sid", "doc_id", "h", "size", "start"), about, plan


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, share: float = SHARE, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix: a row per slot of each output shard and document in its block (``shard, slot, turn, key, doc_id``
    and the words ``low`` to ``high`` of the document); then what :func:`number` returns."""
    placed, about, plan = number(docs, block, weights, share, seed)
    spark = docs.sparkSession
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    spans = placed.filter("size > 0").select("sid", "key", "doc_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, shard, counts, firsts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                first = np.array(firsts, np.int64)
                for drawn in parted(np.array(counts, np.int64), SHARD, np.random.default_rng([plan.seed, group])):
                    sid = np.repeat(np.arange(len(drawn)), drawn)
                    block_no, turn, took = (np.empty(len(sid), np.int64) for _ in range(3))
                    ends = np.cumsum(drawn)
                    for s in np.flatnonzero(drawn):
                        here, n = slice(ends[s] - drawn[s], ends[s]), plan.blocks[s]
                        j = first[s] + np.arange(drawn[s])
                        turn[here] = j // n
                        block_no[here] = np.concatenate([Permutation(n, plan.key(int(s), int(t))).at(j[j // n == t] % n) for t in np.unique(j // n)])
                        took[here] = np.where(j == plan.slots[s] - 1, plan.last[s], plan.block)
                    slot = np.random.default_rng([plan.seed, 1, shard]).permutation(len(sid))
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sid), pa.int64()), pa.array(slot, pa.int64()), pa.array(sid, pa.int32()), pa.array(block_no), pa.array(turn), pa.array(took)], ["shard", "slot", "sid", "block", "turn", "took"])
                    first, shard = first + drawn, shard + 1

    drawn = spark.createDataFrame(plan.groups(), "g long, shard long, counts array<long>, firsts array<long>").repartition(spark.sparkContext.defaultParallelism)
    filled = drawn.mapInArrow(slots, "shard long, slot long, sid int, block long, turn long, took long")
    at = F.col("block") * block
    low = F.greatest(F.col("start"), at)
    high = F.least(F.col("start") + F.col("size"), at + F.col("took"))
    # Slots come from a few rows, which the planner would take for few: they are not broadcast.
    mixed = filled.join(spans.hint("merge"), ["sid", "block"]).filter(low < high)
    return mixed.select("shard", "slot", "turn", "sid", "key", "doc_id", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high")), placed, about


def taken(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document."""
    mixed, placed, about = mix(docs, **how)
    sums = mixed.groupBy("key").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    return placed.join(sums, "key", "left").join(about, "sid").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: for each document and pass a row whose text is what the pass takes of it.

    A document that a pass takes whole keeps its text as it is; otherwise the taken spans are joined by line
    ends. Returns ``doc_id, text, lang, source, n_chars``.
    """
    mixed, placed, about = mix(docs, **how)
    spans = mixed.groupBy("key", "turn").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    chosen = placed.select("key", "sid", "doc_id", "h", "size").join(spans, "key")
    # Rows with one id and text count as one text, with their least lang.
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("g"), F.struct("lang", "text").alias("t")).groupBy("d", "g").agg(F.min("t").alias("t")).select("d", "g", "t.text", "t.lang")
    both = chosen.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    named = both.join(about.select("sid", "source"), "sid").select("doc_id", "text", "lang", "source", "size", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, sizes, spans = (batch.column(k).to_pylist() for k in ("text", "size", "spans"))
            out = [text if sum(s["high"] - s["low"] for s in own) == size else slices(text, own) for text, size, own in zip(texts, sizes, spans)]
            n = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("lang"), batch.column("source"), n], ["doc_id", "text", "lang", "source", "n_chars"])

    return named.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long")


def slices(text: str, spans: list[dict]) -> str:
    """The words ``low`` to ``high`` of each span with the white space between them; touching spans run on."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    joined: list[list[int]] = []
    for s in spans:
        if joined and joined[-1][1] == s["low"]:
            joined[-1][1] = s["high"]
        else:
            joined.append([s["low"], s["high"]])
    return "\n".join(raw[begin[a] : end[z - 1]].decode() for a, z in joined)
