"""Nulls in any column, empty and very long texts, repeated rows, empty tables, extra columns with clashing names."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusmith.llm import language_id, mixing, near_dedup, packing, quality, tiff, token_output, topk_search, toxicity, url_filter
from corpusmith.llm.encoding import Encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rep long, node string, w array<int>, key int, part int"
BYTE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text else None, 1, 2, "x", [3], 4, 5)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [row(1, None), row(2, ""), row(3, " \t\n"), row(4, "one two"), row(4, "one two"), row(5, "one two"), row(None, "one two"), row(None, None, None, None), row(6, long, None, None), row(7, long + " more"), row(8, "x" * 100_000), row(9, "Ünïcode <|endoftext|>  two  spaces\n\n\tend", "de", None), row(10, "12 34 !!", "fr")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def test_token_output(odd, none):
    rows = token_output.read_index(token_output.write_tokens(odd, BYTE)).collect()
    assert len(rows) == 13
    assert sum(r.doc_id is None for r in rows) == 2
    for r in rows:
        if r.doc_id in (1, 2):
            assert (r.n_tokens, r.ids_crc32) == (1, zlib.crc32(np.array([2], "<u4").tobytes()))
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert token_output.read_index(token_output.write_tokens(none, BYTE)).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_equals_the_library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["", "a", " a", "a ", "Hello, world! it's 12,5% off... (see x_y) <b>", "tabs\tand\r\nlines", "é ñ ß 漢字  nbsp", "a b", "don't, DON'T. we'll!", "x\x01y", "<|endoftext|> in <|startoftext|> text", "end.\nNext line, then;more", "1,2.3:4 a.b,c", "word.) (word", "é,è. 😀! ok", "\x85next\x1cfile"]
    ids, at = Encoder(path).encode(pa.array(texts), 2)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], repr(text)


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_encoder_equals_the_library_on_any_text(path):
    """All texts of sf0.1, and random Unicode, with a memo that starts anew several times."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(11)
    kinds = [(32, 127), (160, 1400), (0x2000, 0x2100), (0x3040, 0x3100), (0x4E00, 0x4F00), (0x1F600, 0x1F640), (9, 14), (32, 33)]
    wild = ["".join(chr(rng.integers(*kinds[k])) for k in rng.choice(8, rng.integers(0, 60), p=[0.5, 0.1, 0.03, 0.03, 0.03, 0.03, 0.03, 0.25])) for _ in range(3000)]
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist() + wild
    enc = Encoder(path, memo_bytes=1 << 20)
    for i in range(0, len(texts), 1500):
        part = texts[i : i + 1500]
        ids, at = enc.encode(pa.array(part, pa.string()).slice(1), 2)
        want = [[*e.ids, 2] for e in t.encode_batch([x or "" for x in part[1:]], add_special_tokens=False)]
        assert np.diff(at).tolist() == list(map(len, want))
        assert ids.tolist() == [x for w in want for x in w]
        assert enc.words.nbytes < 8 << 20


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001)
    data = token_output.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) or bits in (8, 16, 32)
    for a, n in ((0, 70_001), (3, 5), (65_530, 20), (70_000, 1), (9, 0)):
        assert token_output.unpack(data, bits, a, n).tolist() == ids[a : a + n].tolist()


def test_mixing(odd, none):
    rows = mixing.taken(odd).collect()
    assert len(rows) == 13
    assert all(r.taken == 0 for r in rows if r.size == 0) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.taken(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in rows)


def test_targets_stop_at_twice_a_source():
    assert mixing.targets([10, 1000, 0]) == pytest.approx([20.0, 1495.0, 0.0])
    assert mixing.targets([]) == []


def test_permutation():
    for n in (1, 2, 3, 100, 4097):
        assert sorted(mixing.Permutation(n, 5).at(np.arange(n)).tolist()) == list(range(n))


def test_permutation_is_inverted():
    for n in (1, 2, 3, 100, 4097):
        p = mixing.Permutation(n, 5)
        assert [p.place(v) for v in p.at(np.arange(n))[:50]] == list(range(min(n, 50)))
    big = mixing.Permutation((1 << 23) + 5, [42, 0, 1])
    assert big.at(np.array([big.place((1 << 23) + 4)])).tolist() == [(1 << 23) + 4]


@pytest.mark.parametrize("size, target", [(10, 3.0), (10, 17.0), (11, 11.0), (97, 150.0), (1000, 1999.0), (4 * (1 << 22) + 3, 1.5 * 4 * (1 << 22)), (4 * (1 << 23) + 1, 9.0)])
def test_the_last_slot_makes_the_target_exact(size, target):
    """At every number of blocks, also where there was a switch once."""
    plan = mixing.Plan(["a"], [size], [target], 4, 42)
    n, slots = plan.blocks[0], plan.slots[0]
    took = 0
    for turn in range(-(-slots // n)):
        at = mixing.Permutation(n, plan.key(0, turn)).at(np.arange(min(n, slots - turn * n)))
        words = np.where(at == n - 1, size - (n - 1) * 4, 4)
        if (turn + 1) * n >= slots:
            words[-1] = min(words[-1], plan.last[0])
        took += int(words.sum())
    assert took == min(round(target), 2 * size)


def test_mixing_of_many_sources_and_shards(spark, monkeypatch):
    rows = [row(i, "word " * (i % 40), source=f"s{i % 300}" if i % 7 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = sorted((r.doc_id, r.taken) for r in mixing.taken(docs).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 10)
    monkeypatch.setattr(mixing, "SHARD", 16)
    monkeypatch.setattr(mixing, "DRAWN", 1500)
    found = mixing.taken(docs).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == want  # what is taken does not depend on shards or joins
    per, target = {}, {}
    for r in found:
        per[r.source] = per.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert len(per) == 301 and all(abs(per[s] - t) <= 1 for s, t in target.items())
    shards = mixing.mix(docs)[0].groupBy("shard").count().count()
    assert shards > 20


def test_packing(odd, none):
    rows = packing.read_pieces(packing.pack_documents(odd, WORDS), WORDS).collect()
    assert sum(r.length for r in rows if r.doc_id == 6) == next(r.doc_tokens for r in rows if r.doc_id == 6)
    assert sum(r.doc_id is None for r in rows) >= 2
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and sum(u < 4096 - packing.MIN_GAP for u in used.values()) <= 1
    assert packing.read_pieces(packing.pack_documents(none, WORDS), WORDS).count() == 0


def test_classifiers_without_labels(spark, odd, none):
    for kind, empty in ((toxicity, 0.0), (quality, 0.5)):
        model = kind.fit(odd, labels(spark))
        rows = kind.score(odd, model).collect()
        assert len(rows) == 13 and {r.score for r in rows} == {empty}
        assert not any(r.held_out for r in rows if r.doc_id is None)
        assert kind.score(none, model).count() == 0
        one = kind.fit(odd, labels(spark, [(4, 1, 1, "t"), (6, 1, 1, "t"), (None, 1, 1, None), (7, None, None, None)]))
        assert kind.score(odd, one).count() == 13


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idio": 4.0}, {"scum": 4.0})
    score = lambda t: sum(c[2] for c in g.clauses(t))
    assert score("a fine day") == 0 and score("") == 0
    assert score("you are an idiot") > score("the idiot") > score("not an idiot") > 0
    assert score("he said that the scum left") < score("that the scum left now")
    assert score("i will kill you") > 0 and score("i will kill time. you know") == 0
    assert len(g.clauses("idiots here. nothing. scum there")) == 2
    assert score("preidiot") == 0


def plain_factors(classes, reach=toxicity.REACH, lone=toxicity.LONE):
    """The grammar's factor of every word, from the rules as they are stated."""
    out, seen = [], 0
    for i, c in enumerate(classes):
        near = lambda kind, stop=None: any(classes[j] == kind and stop not in classes[j:i] for j in range(max(0, i - reach), i))  # noqa: B023, E731
        f = 0.0
        if c == toxicity.INSULT:
            f = lone if not seen else 1.0
            f *= 1.25 / lone if near(toxicity.TARGET, toxicity.REPORT) else 1.0
            f *= 0.6 if near(toxicity.NEGATION) else 1.0
            f *= 0.75 if toxicity.REPORT in classes[:i] else 1.0
            seen += 1
        elif c == toxicity.TARGET:
            f = float(near(toxicity.THREAT))
        out.append(f)
    return out


def test_composed_machine_equals_the_rules():
    rng, machine = np.random.default_rng(5), toxicity.grammar()
    for _ in range(2000):
        classes = rng.choice(6, rng.integers(0, 14), p=[0.3, 0.2, 0.1, 0.2, 0.1, 0.1]).tolist()
        assert machine.run(classes) == pytest.approx(plain_factors(classes)), classes


def test_a_lone_insult_is_the_weakest_clause():
    g = toxicity.Grammar({"idio": 4.0}, {})
    score = lambda t: sum(c[2] for c in g.clauses(t))
    assert score("the word idiot") < score("he was killing her") and score("the word idiot") < score("you idiot") and score("the word idiot") * 2 < score("idiot idiots")
    assert score("she stabbed him") == score("they will murder you") > 0 == score("a killing floor") == score("time kills")


def test_grammar_and_words_alone_on_held_out_rows(spark):
    """The grammar costs no accuracy where labels know only words, and tells apart what words cannot."""
    from corpusmith.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    docs, labels_ = Q._documents(spark, sf), Q._labels(spark, sf)
    truth = {r.doc_id: r.toxic for r in labels_.collect()}
    accuracy, models = [], []
    for machine in (None, toxicity.words_alone()):
        models.append(toxicity.fit(docs, labels_, machine=machine))
        rows = [r for r in toxicity.score(docs, models[-1]).collect() if r.held_out and r.doc_id in truth]
        accuracy.append(np.mean([r.predicted == truth[r.doc_id] for r in rows]))
    assert accuracy[0] >= accuracy[1] - 0.01
    word = max(models[0].lexicon.stems, key=models[0].lexicon.stems.get)
    texts = [f"you are {word}", f"the word {word}", f"he said it was not {word}"]
    with_grammar, without = ([m.score(t) for t in texts] for m in models)
    assert with_grammar[0] > with_grammar[1] > with_grammar[2]
    assert max(without) - min(without) < 0.05


def plain_minimum(rows, y, scale, c, steps=60_000):
    """The least of the hinge-loss objective, by projected gradient ascent on the dual."""
    x = np.zeros((len(rows), len(scale) + 1))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, -1] = 1
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, rate = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(steps):
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, c)
    w = x.T @ (alpha * y)
    return w @ w / 2 + c * np.maximum(0, 1 - y * (x @ w)).sum(), x


def test_dual_coordinate_descent_finds_the_minimum():
    rng = np.random.default_rng(9)
    rows = [np.sort(rng.choice(30, rng.integers(1, 8), replace=False)) for _ in range(40)]
    y, scale = rng.choice([-1.0, 1.0], 40), rng.normal(0, 1, 30)
    best, x = plain_minimum(rows, y, scale, 0.3)
    w = quality.descend(rows, y, scale, 0.3, 400)
    assert w @ w / 2 + 0.3 * np.maximum(0, 1 - y * (x @ w)).sum() == pytest.approx(best, rel=1e-3)


def test_quality_indicators_tell_words_and_shapes():
    a, b, c = (set(quality.indicators(pa.array([t]))[0].tolist()) for t in ("the cat sat", "the dog sat", "The cat, sat"))
    words = lambda s: {i for i in s if i >= quality.BUCKETS * len(quality.SHARES)}
    assert len(words(a)) == 5 and words(a) == words(c) and words(a) != words(b) and a - words(a) == b - words(b) != c - words(c)
    ids, at = quality.indicators(pa.array(["x y", None, "", "the cat sat"]).slice(1))
    assert at.tolist()[:3] == [0, 0, 0] and set(ids.tolist()) == a


def plain_labels(net, text):
    """The network's mean probabilities over a text's bytes, one step after the other in double precision."""
    h, states = net.h, {}
    sig = lambda v: 1 / (1 + np.exp(-v))
    for d, data in (("f", text), ("b", text[::-1])):
        s, own = np.zeros(h), []
        E, U, b = net.p["E" + d], net.p["U" + d], net.p["b" + d]
        for byte in data:
            e, r = E[byte], s @ U + b
            z, q = sig(e[:h] + r[:h]), sig(e[h : 2 * h] + r[h : 2 * h])
            s = z * s + (1 - z) * np.tanh(e[2 * h :] + q * r[2 * h :])
            own.append(s)
        states[d] = own
    p = []
    for f, b in zip(states["f"], states["b"][::-1]):
        o = np.exp(np.concatenate([f, b]) @ net.p["V"] + net.p["c"])
        p.append(o / o.sum())
    return np.mean(p, 0)


def test_reading_in_step_equals_reading_byte_by_byte(monkeypatch):
    net = language_id.Network(["a", "b", "c"], hidden=5, seed=3)
    texts = ["The CAT, and the dog!", "x", "", None, "ñandú 12 über", "a" * 447, "wörter " * 60, "12 !", "\u0301\u0302"]
    found = language_id.Reader(net).probabilities(pa.array(["skipped", *texts]).slice(1))
    clean = [" ".join("".join(ch if ch.isalpha() else " " for ch in t.lower()).split()).encode() if t else b"" for t in texts[:-1]] + [b""]
    for t, p in zip(clean, found):
        assert p == pytest.approx(plain_labels(net, t), abs=1e-4) if t else not p.any()
    # Longer texts are read in windows: each position knows CONTEXT bytes beyond its window's core.
    long = "wörter über alles " * 100
    monkeypatch.setattr(language_id, "STEP", 3)
    p = language_id.Reader(net).probabilities(pa.array([long, "x"]))
    assert p[0] == pytest.approx(plain_labels(net, long.strip().encode()), abs=5e-3)
    assert p[0] == pytest.approx(language_id.Reader(net).probabilities(pa.array([long]))[0], abs=1e-6)


def test_language_edges(spark, odd, none):
    docs = spark.createDataFrame([row(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)], SCHEMA)
    net = language_id.fit(docs, steps=60)
    found = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, net).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (10, "und")} <= found
    marks = spark.createDataFrame([row(1, "\u0301 \u0302")], SCHEMA)  # marks alone are no letters
    assert [(r.lang_pred, r.score) for r in language_id.predict(marks, net).collect()] == [("und", 0.0)]
    many = spark.createDataFrame([row(i, f"{chr(97 + i % 20) * 4} text {i}", f"l{i % 230:03}") for i in range(460)], SCHEMA)
    assert len(language_id.fit(many, folds=None, steps=2).languages) == 230  # no language is left out
    assert language_id.predict(none, net).count() == 0
    assert language_id.fit(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.in_known_language(odd).columns == odd.columns


def test_backpropagation_is_the_gradient():
    net = language_id.Network(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 105, (4, 5)), np.array([0, 1, 2, 1])
    _, grad = net.gradients(x, y)
    for k, a in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in a.shape) if not k.startswith("E") else (int(x[0, 0]), int(rng.integers(0, a.shape[1])))
            keep, e = a[at], 1e-6
            a[at] = keep + e
            up = net.gradients(x, y)[0]
            a[at] = keep - e
            down = net.gradients(x, y)[0]
            a[at] = keep
            assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-6, k


def test_near_dedup(odd, none):
    rows = near_dedup.near_duplicates(odd, 3, 0.85).collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all((r.n_shingles, r.component_id, r.kept) == (0, i, True) for i in (1, 2, 3) for r in by[i])
    assert {(r.component_id, r.kept) for r in by[4]} == {(4, True)} and by[5][0].component_id == 4 and not by[5][0].kept
    assert by[6][0].component_id == by[7][0].component_id == 6
    assert {(r.n_shingles, r.component_id, r.kept) for r in by[None]} == {(1, 4, False), (0, None, True)}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.deduplicated(odd)
    # Of the rows without an id, the one whose set a row with an id has goes, as near_duplicates says.
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9, 10]


def test_one_row_of_an_id_survives_whatever_the_partitions(spark):
    rows = [row(1, "alpha beta gamma delta"), row(1, "quite another text here"), row(1, "alpha beta gamma delta", "de"), row(2, "third text of all")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [sorted(map(tuple, near_dedup.deduplicated(docs.repartition(n)).collect())) for n in (1, 3, 5)]
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 2]


def test_clusters_beyond_one_task(spark, monkeypatch):
    """A family of near copies confirmed in chunks gives the components that one task gives."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 5)):
            w[at] = f"x{rng.integers(0, 50)}"
        rows.append(row(i, " ".join(w)))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 0.85).collect()}
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "FIRST_LEADERS", 2)
    monkeypatch.setattr(near_dedup, "LEADERS", 7)
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 0.85).collect()}
    monkeypatch.setattr(near_dedup, "HOT_NODES", 0)  # nothing is listed by broadcast
    unlisted = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 3, 0.85).collect()}
    from llm.plain import exact_components

    exact, _ = exact_components({r[0]: r[1] for r in rows}, 3, 85)
    assert got == want == unlisted == exact


def test_components(spark):
    from corpusmith.llm.components import components

    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (4, 1), (1, 2), *[(i, i + 1) for i in range(100, 160)]]
    found = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, **{i: 100 for i in range(100, 161)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiff(odd, none):
    rows = tiff.media_features(tiff.store_texts(odd)).collect()
    assert len(rows) == 13 and {r.payload_bytes % 64 for r in rows} == {0}
    assert len({r.media_sha256 for r in rows if r.n_bytes == 0}) == 1
    assert tiff.media_features(tiff.store_texts(none)).count() == 0


@pytest.mark.parametrize("kind", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(kind, tile, predictor):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 4, (37, 50)).astype(np.uint8), rng.integers(0, 65536, (20, 33, 3)).astype(np.uint16), np.repeat(rng.integers(0, 255, (300, 1)), 90, 1).astype(np.uint8)]
    data = tiff.write_tiff(pages, kind, predictor, tile)
    back = tiff.read_pages(data)
    assert len(back) == 3
    for a, b in zip(pages, back):
        assert (a.reshape(b.pixels.shape) == b.pixels).all() and b.tiled == bool(tile)


def test_tiff_damage(spark):
    good = tiff.write_tiff([np.zeros((8, 8), np.uint8)])
    cyclic = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    n = int.from_bytes(good[at : at + 2], "little")
    cyclic[at + 2 + 12 * n : at + 6 + 12 * n] = good[4:8]
    rows = [(1, good), (2, b"nonsense"), (3, good[:40]), (4, None), (5, bytes(cyclic)), (6, b"")]
    found = {r.doc_id: r.error for r in tiff.decode_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert set(found) == {1, 2, 3, 5, 6} and found[1] is None and all(found[k] for k in (2, 3, 5, 6))


def test_url_filters(spark):
    rows = [
        (1, "http://a.example.com/en/1?x=1#f", None),
        (2, "HTTPS://EXAMPLE.COM/en/7/x", ""),
        (3, None, "<html>"),
        (4, "no scheme", "x"),
        (5, "http://other.io/p", '<link rel="canonical" href="http://shop.com/en/2">'),
        (6, "http://six.io/?url=http%3A%2F%2Fsite.net%2Fde%2F1", ""),
        (7, "http://seven.io", '<link href="/page" rel=canonical><meta http-equiv="refresh" content="0;url=http://shop.com/en/2">'),
        (8, "http://example.net/de/88", None),
        (None, "http://x.org/es/", None),
        (9, "http://notcom/en/", None),
        (10, "http://seven.io/page", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert found[1] == ("a.example.com", "/en/1", "com/en/", "block")
    assert found[2] == ("example.com", "/en/7/x", "example.com/en/7", "allow")
    assert found[3] == found[4] == ("", "", None, "allow")
    assert found[5][2:] == (None, "block") and found[6][2:] == (None, "allow")
    assert found[7][3] == "block" and found[10][3] == "block"
    assert found[8][2:] == ("example.net/de/8", "block") and found[None][2:] == ("org/es/", "block") and found[9][2:] == (None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0
    many = tuple(url_filter.Rule("block", f"h{i}.com", "/x") for i in range(100)) + url_filter.RULES
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, many).collect()} == found


def test_search(spark, odd, none):
    rows = topk_search.search(odd, odd, k=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.rank, r.match_id))
    assert None not in by and 1 not in by and not any(r.match_id is None for r in rows)
    assert sorted(by[5]) == [(1, 4), (2, 4), (3, 5)]
    assert [m for _, m in sorted(by[7])] == [7, 6]
    assert topk_search.search(none, none).count() == 0 and topk_search.search(odd, none.limit(0)).count() == 0


def test_search_in_many_groups_and_chunks(spark, monkeypatch):
    """Shards, groups and chunks do not change a result; hits are bounded by queries x groups x k."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(9)
    queries = docs.filter("doc_id % 10 = 0")
    want = sorted(map(tuple, topk_search.search(docs, queries, 5).collect()))
    for name, value in (("MAX_TERMS", 300), ("GROUPS", 2), ("GROUP_SHARDS", 3)):
        monkeypatch.setattr(topk_search, name, value)
    seen = []
    keep = topk_search.saved
    monkeypatch.setattr(topk_search, "saved", lambda df, name, *a: seen.append((name, keep(df, name, *a))) or seen[-1][1])
    assert sorted(map(tuple, topk_search.search(docs, queries, 5, 2).collect())) == want
    tables = dict(seen)
    shards = tables["index"].count()
    assert shards == 9 and tables["hits"].count() <= queries.count() * -(-shards // 3) * 5


def classic(lists, weight, k):
    """Block-max WAND in the classic order of single postings: scores of the k best, and how many postings were read."""
    import heapq

    size = 32
    maxima = {t: {b: max(x for d, x in p if d // size == b) for b in {d // size for d, _ in p}} for t, p in lists.items()}
    at, best, read, top = dict.fromkeys(lists, 0), [], 0, {t: max(x for _, x in p) for t, p in lists.items()}
    while True:
        live = sorted((lists[t][i][0], t) for t, i in at.items() if i < len(lists[t]))
        least, total, pivot = best[0] if len(best) == k else 0.0, 0.0, None
        for d, t in live:
            total += weight[t] * top[t]
            if total > least:
                pivot = d
                break
        if pivot is None:
            return sorted(best, reverse=True), read
        here = [t for d, t in live if d <= pivot]
        if sum(weight[t] * maxima[t].get(pivot // size, 0.0) for t in here) <= least:
            for t in here:  # no document of the block up to the next list can be better
                stop = min([pivot // size * size + size, *(d for d, t2 in live if d > pivot)])
                while at[t] < len(lists[t]) and lists[t][at[t]][0] < max(stop, pivot + 1):
                    at[t] += 1
            continue
        score = 0.0
        for t in here:
            while at[t] < len(lists[t]) and lists[t][at[t]][0] < pivot:
                at[t] += 1
            if at[t] < len(lists[t]) and lists[t][at[t]][0] == pivot:
                score += weight[t] * lists[t][at[t]][1]
                at[t] += 1
                read += 1
        heapq.heappush(best, score)
        if len(best) > k:
            heapq.heappop(best)


def test_pruning_next_to_the_classic_order():
    """Both orders find the same; the shares of postings that each reads are printed (README has them)."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 3000)
    h, d = topk_search.term_hashes(table.column(1).combine_chunks())
    lengths = np.bincount(d, minlength=3000)
    s = topk_search.Shard(topk_search.build(np.arange(3000), h, d), lengths.mean())
    s.count()
    df = np.diff(s.ptr)
    idf = np.log(1 + (3000 - df + 0.5) / (df + 0.5))
    often, rare = np.argsort(-df)[:30], np.flatnonzero((df > 20) & (df < 60))
    share = {}
    for kind in ("short", "long"):
        mine = other = held = 0
        for q in range(6):
            terms = np.sort(np.array([rare[q * 7], *often[[q, 29 - q]]])) if kind == "short" else np.sort(s.own_term[s.own_ptr[q * 40 + 6] : s.own_ptr[q * 40 + 7]])
            floor = np.zeros(1)
            s.counted = [0, 0]
            for _ in range(2):  # the second time with the floor that a task carries on
                s.counted = [0, 0]
                found = list(s.search(np.array([0, len(terms)]), terms, idf[terms], 10, floor))
                floor = np.array([found[0][2][-1]])
            lists = {t: list(zip(s.docs[s.ptr[t] : s.ptr[t + 1]].tolist(), s.impact[s.ptr[t] : s.ptr[t + 1]].tolist())) for t in terms.tolist()}
            best, read = classic(lists, dict(zip(terms.tolist(), idf[terms].tolist())), 10)
            assert found[0][2] == pytest.approx(best, abs=2e-6)
            mine, other, held = mine + s.counted[1], other + read, held + s.counted[0]
        share[kind] = mine / held, other / held
    print("read by blocks, by single postings:", share)
    assert all(0 < x < 1 for pair in share.values() for x in pair) and share["short"][0] < 0.6


def test_pruned_search_is_exact():
    rng = np.random.default_rng(4)
    n, terms = 700, np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    words = [rng.choice(300, rng.integers(1, 60), p=(p := 1 / np.arange(1, 301)) / p.sum()) for _ in range(n)]
    ids = rng.permutation(10_000)[:n].astype(np.int64)
    data = topk_search.build(ids, terms[np.concatenate(words)], np.repeat(np.arange(n), [len(w) for w in words]))
    mean = np.mean([len(w) for w in words])
    s = topk_search.Shard(data, mean)
    for _ in range(60):
        q = rng.choice(300, rng.integers(1, 40), replace=False)
        weight = rng.random(len(q)) * 5
        want = []
        for i, w in zip(ids, words):
            score = 0.0
            for t, x in zip(q, weight):
                if tf := int((w == t).sum()):
                    score += x * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score > 0:
                want.append((-round(score, 6), i))
        at = np.searchsorted(s.terms, terms[q])
        here = (at < len(s.terms)) & (s.terms[np.minimum(at, len(s.terms) - 1)] == terms[q])
        got = [(-b, a) for _, docs, scores in s.search(np.array([0, here.sum()]), at[here], weight[here], 10, np.zeros(1)) for a, b in zip(s.ids[docs], scores)]
        assert got == [(x, i) for x, i in sorted(want)[:10]]


def mixed_shard(n=1600, kinds=3):
    """Documents of some kinds, each with words of its own, and their plain scores against whole texts of every fifth."""
    rng = np.random.default_rng(8)
    terms = np.unique(rng.integers(0, 2**63, 400 * kinds).astype(np.uint64))
    p = (p := 1 / np.arange(1, 401)) / p.sum()
    words = [400 * (i % kinds) + rng.choice(400, rng.integers(1, 120), p=p) for i in range(n)]
    words[1::7] = words[:1] * len(words[1::7])  # equal scores
    counts = np.zeros((n, len(terms)))
    np.add.at(counts, (np.repeat(np.arange(n), list(map(len, words))), np.concatenate(words)), 1)
    length = counts.sum(1)
    impact = counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * length / length.mean())[:, None])
    ids, weight = rng.permutation(10_000)[:n].astype(np.int64), counts[::5] * rng.random(len(terms)) * 5
    data = topk_search.build(ids, terms[np.concatenate(words)], np.repeat(np.arange(n), list(map(len, words))))
    query, term = np.nonzero(weight)
    return topk_search.Shard(data, length.mean()), ids, np.searchsorted(query, np.arange(len(weight) + 1)), term, weight[query, term], weight @ impact.T, terms


@pytest.mark.parametrize("n, sizes", [(1600, {}), (1600, {"BATCH": 20, "SEGMENT": 256, "READ": 64, "KINDS": 3}), (1600, {"DENSE": 10_000, "MANY": 999}), (500, {})])
def test_batches_of_queries_are_answered_exactly(monkeypatch, n, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk_search, name, value)
    s, ids, at, term, weight, scores, terms = mixed_shard(n)
    term = np.searchsorted(s.terms, terms)[term]
    floors = np.zeros(len(scores))
    for again in range(2):  # the second time with the floors that a task carries on
        got = {q: list(zip((-x).tolist(), s.ids[docs].tolist())) for q, docs, x in s.search(at, term, weight, 10, floors)}
        for q, row in enumerate(scores):
            best = sorted((-round(x, 6), i) for x, i in zip(row.tolist(), ids.tolist()) if x > 0)[:10]
            assert [i for _, i in got[q]] == [i for _, i in best] and [x for x, _ in got[q]] == pytest.approx([x for x, _ in best], abs=2e-6)
            floors[q] = -best[-1][0] if len(best) == 10 else 0


def test_few_documents_are_scored_in_full():
    """Of the candidates, only those that can be among the k best (equal ones besides)."""

    class Asked(np.ndarray):
        def __getitem__(self, i):
            seen.append(i)
            return np.asarray(self)[i]

    s, ids, at, term, weight, scores, terms = mixed_shard()
    s.own_ptr, seen = s.own_ptr.view(Asked), []
    list(s.search(at, np.searchsorted(s.terms, terms)[term], weight, 10, np.zeros(len(scores))))
    tenth = np.sort(scores, 1)[:, -10, None]
    assert sum(map(len, seen)) / 2 <= 1.2 * (scores >= np.maximum(tenth * (1 - 1e-3), 1e-9)).sum()


def test_split_words_and_hashes_agree():
    """A shard is the same from every word's hash and from distinct hashes with places, empty words left out."""
    texts = pa.array(["B a\x0b\x0cb", "", None, " \t a  É\r\n", "x\x1cy"])
    own, index, docs = topk_search.coded_words(texts)
    h, d = topk_search.term_hashes(texts)
    assert docs.tolist() == d.tolist() == [0, 0, 0, 3, 3, 4] and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    ids = np.arange(5)[::-1].copy()
    assert topk_search.build(ids, h, d) == topk_search.build(ids, own, docs, index)
