"""Recall of near-duplicate links by similarity, against all links of sf0.1 and of a planted family whose nodes are branched."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from corpusmith.llm import near_dedup

BANDS = ((0.85, 0.87), (0.87, 0.9), (0.9, 1.0))


def recall(texts, component, shingle, percent):
    """Of all pairs of different sets that are similar enough, by band: how many, and the share whose ends have one component."""
    sets = near_dedup.shingles(pa.array(texts, pa.string()), shingle)
    index, found = near_dedup.Sets(sets), {b: [0, 0] for b in BANDS}
    for i, own in enumerate(sets):
        shared = index.shared(own)
        ok = near_dedup.linked(shared, index.sizes, len(own), percent)
        for j in np.flatnonzero(ok[:i]):
            similarity = shared[j] / (len(own) + index.sizes[j] - shared[j])
            for low, high in BANDS:
                if low <= similarity < high:
                    found[low, high][0] += 1
                    found[low, high][1] += component[i] == component[j]
    return {b: (n, hit / n if n else None) for b, (n, hit) in found.items()}


def test_recall_by_band(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 0.85).collect()}
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    ids, texts = table.column(0).to_pylist(), table.column(1).to_pylist()
    found = recall(texts, [got[i] for i in ids], 3, 85)
    print("sf0.1:", found)
    assert all(n and share == 1.0 for n, share in found.values())


def test_recall_in_branched_nodes(spark):
    rng, base = np.random.default_rng(12), [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(1200):
        w = list(base)
        for at in rng.integers(0, 300, rng.integers(0, 9)):
            w[at] = f"x{rng.integers(0, 10_000)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 0.85).collect()}
    found = recall(texts, [got[i] for i in range(len(texts))], 3, 85)
    print("planted:", found)
    assert all(share is None or share >= 0.999 for _, share in found.values()) and found[0.9, 1.0][0] > 1000
