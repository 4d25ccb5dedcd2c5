"""MinHash near-duplicates: chosen-path set similarity join, exact confirmation, components.

A document's set is its distinct word shingles, hashed to 64 bits. Equal sets are one class at once, by a partial
aggregation; everything after works on one representative (least ``doc_id``) of each class.

1. *Chosen paths.* Each of ``TREES`` independent trees branches a document at every node by a few positions of its
   minwise signature (1 / threshold of them on average, chosen by the node), so that a pair at the threshold keeps
   one common child on average. Nodes of up to ``LEAF`` documents are compared exhaustively on signatures, with a
   margin of four standard deviations; larger nodes are branched further. What is still together at the last depth is
   dense, and every member hangs on the least one. All three only *propose*, and never more edges than members.
2. *Confirmation.* Proposed edges are joined to clusters, whose members are compared on full sets: a document against
   all others at once, until every document outside the cluster's largest confirmed component has been compared with
   all. Every link between two components has such an end, so no link inside a cluster is lost, and none is made
   without a full comparison. Clusters beyond ``BLOCK`` documents or ``BLOCK_SHINGLES`` are dealt out in chunks.
3. *Components* of confirmed links.

Recall is that of step 1, by calculation, not measurement: a pair exactly at the threshold falls below the signature margin
with a probability of about 3e-5, in all trees alike, as they share one signature; 16 trees, taken as independent, all
part it with about 1e-9 in nodes that are not branched further and 3e-6 in those that are. More similar pairs are safer.

Edge cases: a null text or one without words has an empty set and is linked with nothing; fewer words than a shingle
make one shingle; a null ``doc_id`` is never a representative: such a row belongs to the component of its text, if any
row with an id has the same set, and else has no ``component_id`` and is kept; rows that share an id belong to one
component; repeated rows get equal results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, saved, sliced
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
POSITIONS, TREES, LEAF = 96, 16, 64
DEPTHS = (2, 5)
#: Documents and shingles of a cluster that one task confirms; larger clusters are dealt out.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Members of a large cluster that are compared with all others first, and those that pass by a chunk in one task later.
FIRST_LEADERS, LEADERS = 64, 65_536
#: Nodes with more than ``LEAF`` documents, or large clusters, whose list (24 bytes each) is broadcast, so that no task gets
#: the rows of one.
HOT_NODES = 200_000
SPACE = r"[\x20\x09-\x0D]+"
SETS = "doc_id long, h long, n_shingles long, digest string, sig binary, nodes array<long>"

GOLD, A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * A
        x = (x ^ (x >> np.uint64(27))) * B
        return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SPACE)
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    index = coded.indices.to_numpy(zero_copy_only=False)
    full = np.fromiter((w != "" for w in words), bool, len(words))[index] if len(words) else np.zeros(0, bool)
    h = own[index] if len(words) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for a, z in zip(at, at[1:]):
            x = h[a:z][full[a:z]]
            n = min(k, len(x))
            s = np.zeros(len(x) - n + 1 if n else 0, np.uint64)
            for i in range(n):
                s = mixed(s * GOLD + x[i : len(x) - n + 1 + i])
            out.append(np.unique(s))
    return out


def coefficients(seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minwise signature of each set: documents x POSITIONS of 32 bits; zeros for an empty set."""
    a, b = coefficients()
    out = np.zeros((len(sets), POSITIONS), np.uint32)
    with np.errstate(over="ignore"):
        for row, s in zip(out, sets):
            if len(s):
                low = np.full(POSITIONS, 0xFFFFFFFF, np.uint64)
                for i in range(0, len(s), 2048):
                    low = np.minimum(low, ((a[:, None] * s[None, i : i + 2048] + b[:, None]) >> np.uint64(32)).min(1))
                row[:] = low
    return out


def branch(sig: np.ndarray, row: np.ndarray, node: np.ndarray, levels: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """``levels`` more steps down the chosen paths: (row, node) pairs for signatures ``sig`` at their nodes."""
    whole, part = int(1 / threshold), 1 / threshold % 1
    with np.errstate(over="ignore"):
        for _ in range(levels):
            rows, nodes = [], []
            for j in range(whole + 1):
                pick = mixed(node * GOLD + np.uint64(j + 1))
                if j == whole:  # one more at a share of the nodes
                    some = (mixed(pick ^ C) >> np.uint64(40)).astype(float) / 2**24 < part
                    row_j, node_j, pick = row[some], node[some], pick[some]
                else:
                    row_j, node_j = row, node
                pos = (pick % np.uint64(POSITIONS)).astype(np.int64)
                value = sig[row_j, pos].astype(np.uint64)
                rows.append(row_j)
                nodes.append(mixed(mixed(node_j ^ (pick * C)) + value * GOLD))
            row, node = np.concatenate(rows), np.concatenate(nodes)
    return row, node


def roots(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.arange(n), TREES), np.repeat(mixed(np.arange(1, TREES + 1, dtype=np.uint64) * GOLD), n)


class Union:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Sets:
    """Many sets, and how much of one of them each has: an inverted index from shingles to sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.known, self.begins = flat[begins], np.append(begins, len(flat))

    def shared(self, one: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with a sorted distinct set."""
        if not len(self.known):
            return np.zeros(len(self.sizes), np.int64)
        at = np.searchsorted(self.known, one)
        at[at == len(self.known)] = 0
        at = at[self.known[at] == one]
        begin, size = self.begins[at], self.begins[at + 1] - self.begins[at]
        total = np.cumsum(size)
        flat = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        return np.bincount(self.owner[flat], minlength=len(self.sizes))


def linked(shared: np.ndarray, sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    return (100 * shared >= percent * (sizes + size - shared)) & (sizes > 0) & (size > 0)


def confirmed(sets: list[np.ndarray], percent: int) -> Union:
    """The exact components of a cluster."""
    n, joined, all_sets = len(sets), Union(len(sets)), Sets(sets)
    todo = np.ones(n, bool)
    while True:
        root = np.array([joined.root(i) for i in range(n)])
        largest = np.bincount(root, minlength=n).argmax()
        left = np.flatnonzero(todo & (root != largest)) if not todo.all() else np.arange(n)
        if not len(left) or n < 2:
            return joined
        # A few at a time, as the largest component grows with them.
        for i in left[: 4 if todo.all() else max(16, len(left) // 4)]:
            for j in np.flatnonzero(linked(all_sets.shared(sets[i]), all_sets.sizes, len(sets[i]), percent)):
                joined.join(int(i), int(j))
            todo[i] = False


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: a document links with those that share at least
    ``threshold`` of the union of their shingles; components have their smallest ``doc_id``, whose row is kept."""
    return _judged(docs, shingle, threshold).drop("h")


def _judged(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """:func:`near_duplicates` with ``h``, the hash of a row's text."""
    percent = round(100 * threshold)
    margin = threshold - 4 * (threshold * (1 - threshold) / POSITIONS) ** 0.5

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in sliced(batches):
            sets = shingles(batch.column(1), shingle)
            sig = signatures(sets)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            row, node = branch(sig[full], *roots(len(full)), DEPTHS[0], threshold)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(full) + 1))
            sizes = np.zeros(len(sets), np.int64)
            sizes[full] = np.diff(ends)
            nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(node[order].view(np.int64)))
            digests = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()), pa.array([s.tobytes() for s in sig], pa.binary()), nodes], ["doc_id", "h", "n_shingles", "digest", "sig", "nodes"])

    sets = saved(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(sketch, SETS), "sketches")
    # Signature and nodes depend on the set alone, so any row's will do.
    classes = sets.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("nodes").alias("nodes"))
    classes = saved(classes.filter("rep is not null"), "classes")
    proposed = saved(_propose(classes, threshold, margin).distinct(), "proposed")
    clusters = saved(components(proposed).withColumnRenamed("node", "rep"), "clusters")
    labels = _confirm(docs, clusters, classes, shingle, percent)
    named = classes.select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("label", "rep").alias("found"))
    out = sets.select("doc_id", "h", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "h", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.when(F.col("doc_id").isNull(), F.col("component_id").isNull()).otherwise(F.col("doc_id") == F.col("component_id")))


def _propose(classes: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Edges ``a, b`` between representatives that may be similar: a spanning forest of every node's similar pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(batches, "node"):
            reps = table.column("rep").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(reps), -1)
            first, joined = np.triu_indices(len(reps), 1), Union(len(reps))
            near = (sig[first[0]] == sig[first[1]]).mean(1) >= margin
            edges = [(i, j) for i, j in zip(first[0][near].tolist(), first[1][near].tolist()) if joined.join(i, j)]
            if edges:
                e = reps[np.array(edges)]
                yield pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], ["a", "b"])

    def deeper(levels: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2000):
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                node = batch.column("node").to_numpy().view(np.uint64)
                row, node = branch(sig, np.arange(len(node)), node, levels, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("rep").take(pa.array(row))], ["node", "rep"])

        return run

    signed = classes.select("rep", "sig")
    rows, found = classes.select(F.explode("nodes").alias("node"), "rep"), []
    for k, depth in enumerate(DEPTHS):
        shared = saved(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1"), f"nodes{k}")
        hot = shared.filter(F.col("n") > LEAF).select("node", "least")
        n_hot = hot.count()
        # The rows of a hot node stay where they are; what is shuffled by node has LEAF rows of each at most.
        few = n_hot <= HOT_NODES
        cold = rows.join(F.broadcast(hot.select("node")), "node", "left_anti") if n_hot and few else rows
        small = cold.join(shared.filter(F.col("n") <= LEAF).select("node"), "node").join(signed, "rep").select("node", "rep", "sig")
        found.append(small.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(compare, "a long, b long"))
        if not n_hot:
            break
        large = rows.join(F.broadcast(hot) if few else hot, "node")
        if depth == DEPTHS[-1]:
            found.append(large.filter("least <> rep").select(F.col("least").alias("a"), F.col("rep").alias("b")))
        else:
            large = large.select("node", "rep").join(signed, "rep").select("node", "rep", "sig")
            rows = saved(large.mapInArrow(deeper(DEPTHS[k + 1] - depth), "node long, rep long"), "deeper")
    return functools.reduce(DataFrame.unionByName, found)


def _confirm(docs: DataFrame, clusters: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``rep, label`` of every representative in a cluster; the label is the least of its confirmed component."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in by_key(batches, "comp"):
            reps = table.column("rep").to_numpy()
            joined = confirmed(shingles(table.column("text").combine_chunks(), shingle), percent)
            root = np.array([joined.root(i) for i in range(len(reps))])
            least = np.full(len(reps), np.iinfo(np.int64).max)
            np.minimum.at(least, root, reps)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(least[root])], ["rep", "label"])

    weight = clusters.join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("w")), "rep")
    about = saved(weight.groupBy("comp").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "about")
    fits = (F.col("n") <= BLOCK) & (F.col("w") <= BLOCK_SHINGLES)
    n_large = about.filter(~fits).count()
    listed = F.broadcast if n_large <= HOT_NODES else (lambda df: df)
    # What is shuffled by cluster has the rows of small ones only, where the large ones can be listed.
    rest = clusters.join(listed(about.filter(~fits).select("comp")), "comp", "left_anti") if n_large else clusters
    ids = rest.join(about.filter(fits), "comp")
    ids = ids.unionByName(clusters.join(listed(about.filter(~fits)), "comp")) if n_large else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").filter("rep is not null")
    members = saved(texts.join(ids, "rep"), "members")
    small = members.filter(fits).select("comp", "rep", "text").repartition("comp").sortWithinPartitions("comp", "rep")
    labels = small.mapInArrow(exact, "rep long, label long").groupBy("rep").agg(F.min("label").alias("label"))
    if not n_large:
        return labels
    large = members.filter(~fits).withColumn("chunks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int"))
    large = saved(large.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int")).select("comp", "rep", "text", "chunks", "chunk"), "large")
    from pyspark.sql import Window

    order = Window.partitionBy("comp").orderBy(F.xxhash64("rep"), "rep")
    leaders = large.select("comp", "rep").withColumn("i", F.row_number().over(order)).filter(F.col("i") <= FIRST_LEADERS)
    edges = saved(_against(large, leaders.select("comp", "rep", F.lit(0).alias("turn")), shingle, percent), "links")
    found = components(edges)
    placed = large.select("comp", "rep").distinct().join(found.select(F.col("node").alias("rep"), F.col("comp").alias("sub")), "rep", "left").withColumn("sub", F.coalesce("sub", "rep"))
    sizes = placed.groupBy("comp", "sub").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("comp").agg(F.max(F.struct("m", "sub")).alias("top")).select("comp", F.col("top.sub").alias("top"))
    outside = placed.join(listed(largest), "comp").filter("sub <> top").select("comp", "rep")
    turns = outside.withColumn("turn", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)))
    per = outside.groupBy("comp").agg(F.ceil(F.count("*") / LEADERS).alias("t"))
    turns = turns.join(listed(per), "comp").select("comp", "rep", F.expr("cast(turn % t as int)").alias("turn"))
    more = saved(_against(large, turns, shingle, percent), "links")
    whole = components(edges.unionByName(more))
    ends = large.select("rep").distinct().join(whole.select(F.col("node").alias("rep"), F.col("comp").alias("label")), "rep", "left")
    return labels.unionByName(ends.select("rep", F.coalesce("label", "rep").alias("label")))


def _against(large: DataFrame, leaders: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links ``a, b`` of leaders (``comp, rep, turn``) with all members of their clusters: a task holds a chunk
    of the members, and the leaders of a turn pass by. A member's text is sent once a turn, of ``LEADERS`` leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, index = None, [], [], None
        for batch in sliced(batches):
            keys, lead = batch.column("key").to_pylist(), batch.column("lead").to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or lead[i] != lead[i - 1]], len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                sets, reps = shingles(batch.column("text").slice(a, z - a), shingle), batch.column("rep").slice(a, z - a).to_numpy()
                if keys[a] != key:
                    key, held, ids, index = keys[a], [], [], None
                if not lead[a]:
                    held += sets
                    ids.append(reps)
                    continue
                if index is None:
                    index, every, held = Sets(held), np.concatenate(ids) if ids else np.zeros(0, np.int64), []
                for rep, own in zip(reps, sets):
                    to = every[linked(index.shared(own), index.sizes, len(own), percent)]
                    to = to[to != rep]
                    if len(to):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(to, rep)), pa.array(np.maximum(to, rep))], ["a", "b"])

    leaders = saved(leaders, "leaders")
    turns = leaders.select("comp", "turn").distinct()
    turns = F.broadcast(turns) if turns.count() <= HOT_NODES else turns
    members = large.join(turns, "comp").select("comp", "turn", "chunk", "rep", "text", F.lit(False).alias("lead"))
    heads = large.join(leaders, ["comp", "rep"]).select("comp", "turn", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "rep", "text", F.lit(True).alias("lead"))
    key = F.concat_ws(":", "comp", "turn", "chunk")
    both = members.unionByName(heads).select(key.alias("key"), "rep", "text", "lead")
    return both.repartition("key").sortWithinPartitions("key", "lead").mapInArrow(run, "a long, b long").distinct()


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which one of each component stays; columns as they come.

    Of rows that share a kept id, the one with the least hash over all columns stays, and so one of equal rows. A row
    without an id stays if no row with an id has its set of shingles.
    """
    row, text = "_corpusmith_row", "_corpusmith_text"
    judged = saved(_judged(docs, shingle, threshold).filter("kept").select("doc_id", "h").distinct(), "kept")
    hashed = docs.withColumns({row: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), text: F.xxhash64("text")})
    ids = judged.filter("doc_id is not null").select("doc_id").distinct()
    least = hashed.select("doc_id", row).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias(row))
    own = hashed.join(least, ["doc_id", row], "left_semi").dropDuplicates(["doc_id"])
    without = judged.filter("doc_id is null").select(F.col("h").alias(text)).distinct()
    return own.unionByName(hashed.filter("doc_id is null").join(without, text, "left_semi").select(own.columns)).select(docs.columns)
