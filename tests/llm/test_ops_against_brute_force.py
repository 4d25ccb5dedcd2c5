"""Each operator's query on the smallest tables against a plain computation of the same contract."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import same
from llm.plain import WORD, exact_components

from corpusmith.llm import queries as Q
from corpusmith.llm.encoding import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def ids_of(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_output(spark, docs):
    rows = sorted(Q.op1_token_output(spark, SF).collect(), key=lambda r: r.doc_id)
    order, at = sorted(docs), 0
    assert [r.doc_id for r in rows] == order
    for r, ids in zip(rows, ids_of([docs[i].text for i in order], "byte_bpe_50k.json")):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids)), r.doc_id
        at += len(ids)


def test_mixing(spark, docs):
    rows = Q.op2_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = {i: len(WORD.findall(d.text or "")) for i, d in docs.items()}
    per = Counter()
    for i, d in docs.items():
        per[d.source] += sizes[i]
    names = sorted(per)
    w = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, free, left = {}, set(names), 1.5 * sum(per.values())
    while free:
        unit = left / sum(w[n] for n in free)
        over = [n for n in free if unit * w[n] > 2 * per[n]]
        if not over:
            want |= {n: unit * w[n] for n in free}
            break
        for n in over:
            want[n] = 2.0 * per[n]
            left -= want[n]
            free.discard(n)
    took = Counter()
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == sizes[r.doc_id] and r.source_size == per[s] and math.isclose(r.target, want[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        took[s] += r.taken
    for n in names:
        assert abs(took[n] - want[n]) <= 1
    again = Q.op2_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing(spark, docs):
    rows = Q.op3_packing(spark, SF).collect()
    ids = dict(zip(docs, ids_of([d.text for d in docs.values()], "word_bpe_49k.json")))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length > 0 and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(by_seq) * 4096 <= 1.03 * total + 4096


def accuracy(spark, rows, truth):
    found = {r.doc_id: r for r in rows}
    held = [i for i in truth if found[i].held_out]
    return np.mean([found[i].predicted == truth[i] for i in held]), found


def folds(found, n, k):
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % n == k) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    acc, found = accuracy(spark, Q.op4_toxicity(spark, sf).collect(), truth)
    folds(found, 3, 1)
    assert len(found) == 1000 and acc >= 0.95


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    acc, found = accuracy(spark, Q.op5_quality(spark, sf).collect(), truth)
    folds(found, 4, 2)
    assert len(found) == 1000 and acc >= 0.95


def test_language_id(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op6_language_id(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.97


def test_url_filters_equal_their_sql(spark):
    same(Q.op7_url_filters(spark, SF), Q.oracle_sql()["op7_url_filters"], SF)


def test_near_dedup(spark, docs):
    want, sizes = exact_components({i: d.text for i, d in docs.items()}, 3, 85)
    for r in Q.op8_minhash_near_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_media(spark, docs):
    rows = Q.op9_media_columns(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        pad = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))


def test_search_equals_its_sql(spark):
    same(Q.op10_topk_search(spark, SF), Q.oracle_sql()["op10_topk_search"], SF)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P
    from corpusmith.llm.common import DOC_COLS, saved

    now = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:3]:
        out = saved(stage(spark, now, SF), name)
        assert out.columns == DOC_COLS
        before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in out.collect()}
        assert all(before[i] == r for i, r in after.items())
        if name == "near_dedup":
            want, _ = exact_components({i: r.text for i, r in before.items()}, 5, 80)
            assert set(after) == {i for i in before if want[i] == i}
        now = out
    mixed = saved(P.mixing_stage(spark, now, SF), "mixing")
    assert mixed.columns == DOC_COLS
    rows, source = mixed.collect(), {r.doc_id: r for r in now.collect()}
    took = Counter()
    for r in rows:
        own = WORD.findall(source[r.doc_id].text)
        cut = WORD.findall(r.text)
        assert r.n_chars == len(r.text) and len(cut) <= len(own) and Counter(cut) <= Counter(own)
        took[r.doc_id] += len(cut)
    from corpusmith.llm.mixing import taken

    assert {r.doc_id: r.taken for r in taken(now).collect() if r.taken} == dict(took)
    pieces = P.packing_stage(spark, mixed, SF).collect()
    per_seq = Counter()
    for r in pieces:
        per_seq[r.sequence_id] += r.length
    assert max(per_seq.values()) <= 4096
    assert sum(per_seq.values()) == sum(map(len, ids_of([r.text for r in rows], "word_bpe_49k.json")))
