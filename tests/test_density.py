"""Two-phase density clustering against a plain reading of its definition, and its edge cases."""

import numpy as np
import pytest

from corpusmith.operators import density

VECTORS = "idx long, vector array<double>"


def parts(d, members, level):
    """Connected parts of ``members`` by distances of at most ``level``."""
    left, out = set(members), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            x = todo.pop()
            more = {y for y in left if d[x, y] <= level}
            left -= more
            part |= more
            todo += more
        out.append(frozenset(part))
    return out


def plain_labels(m, least, epsilon):
    """By thresholds: at every distance below which a part falls apart, look at what is left of it."""
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.maximum(np.round(1 - unit @ unit.T, 6), 0)
    levels = sorted({float(x) for x in d[np.triu_indices(len(m), 1)]}, reverse=True)

    def grow(members, birth, at):
        now, mass = members, 0.0
        for i in range(at, len(levels)):
            below = levels[i + 1] if i + 1 < len(levels) else -1.0
            large = [p for p in parts(d, now, below) if len(p) >= least]
            lam = 1 / max(levels[i], 1e-9)
            if len(large) == 1:
                mass += (len(now) - len(large[0])) * (lam - birth)
                now = large[0]
            else:
                mass += len(now) * (lam - birth)
                return {"rows": members, "birth": birth, "mass": mass, "kids": [grow(p, lam, i + 1) for p in large]}
        raise AssertionError("rows never part")

    def best(node, root=False):
        found = [best(k) for k in node["kids"]]
        total = sum(x for x, _ in found)
        if root or total > node["mass"]:
            return total, [c for _, cs in found for c in cs]
        return node["mass"], [node]

    tree = grow(frozenset(range(len(m))), 0.0, 0)
    path = {}

    def walk(node, above):
        path[node["rows"]] = [*above, node]
        for k in node["kids"]:
            walk(k, path[node["rows"]])

    walk(tree, [])
    out = np.full(len(m), -1)
    for node in best(tree, True)[1]:
        up = path[node["rows"]]
        while up[-1]["birth"] * epsilon >= 1 and len(up) > 2:
            up = up[:-1]
        for x in up[-1]["rows"]:
            out[x] = min(up[-1]["rows"])
    return out


def same_parts(a, b):
    return all((a[i] == -1) == (b[i] == -1) for i in range(len(a))) and all((a[i] == a[j]) == (b[i] == b[j]) for i in range(len(a)) for j in range(i))


def blobs(rng, k, each, noise=0, spread=0.03, dims=24):
    """``k`` groups around axes, and rows that are farther from all of them than these from each other."""
    m = np.eye(dims)[np.repeat(np.arange(k), each)] + rng.normal(0, spread, (k * each, dims))
    far = 2 * np.eye(dims)[8 : 8 + noise] - 0.5 * np.eye(dims)[:k].sum(0)
    return np.concatenate([m, far]), np.repeat(np.arange(k), each)


@pytest.mark.parametrize("seed", range(12))
def test_equal_to_the_definition(seed):
    rng = np.random.default_rng(seed)
    m = np.concatenate([rng.normal(0, 1, (1, 5)) + rng.normal(0, s, (9, 5)) for s in (0.1, 0.3, 0.5)] + [rng.normal(0, 1, (8, 5))])
    for least, epsilon in ((2, 0.0), (3, 0.0), (4, 0.0), (3, 0.02), (3, 0.3)):
        assert same_parts(density.density_labels(m, least, 1, epsilon), plain_labels(m, least, epsilon)), (least, epsilon)


def test_clusters_and_noise():
    m, own = blobs(np.random.default_rng(1), 4, 40, noise=12)
    found = density.density_labels(m, 15, 5)
    assert [set(found[:160][own == k]) - {-1} for k in range(4)] == [{0}, {1}, {2}, {3}]
    assert (found[:160] == -1).mean() < 0.2 and (found[160:] == -1).all()


def test_epsilon_keeps_near_parts_together():
    rng = np.random.default_rng(2)
    m, _ = blobs(rng, 2, 60, spread=0.01)
    m[30:60, 2] += 0.15  # the first cluster falls into two near ones
    apart, joined = density.density_labels(m, 10, 3), density.density_labels(m, 10, 3, 0.05)
    assert len(set(apart) - {-1}) == 3 and len(set(joined) - {-1}) == 2


def test_equal_zero_and_few_rows():
    same = np.concatenate([np.tile([1.0, 0.0], (6, 1)), np.tile([0.0, 1.0], (6, 1))])
    assert density.density_labels(same, 3, 2).tolist() == [0] * 6 + [1] * 6
    assert density.density_labels(np.zeros((12, 2)), 3, 2).tolist() == [-1] * 12
    assert density.density_labels(np.ones((3, 2)), 2, 2).tolist() == [-1] * 3
    assert density.density_labels(np.empty((0, 0)), 2, 2).tolist() == []
    with pytest.raises(ValueError, match="at least two"):
        density.density_labels(same, 1, 2)


def test_blocks_are_merged(spark):
    m, own = blobs(np.random.default_rng(3), 3, 80, spread=0.02)
    order = np.random.default_rng(4).permutation(len(m))
    rows = [(int(i), m[k].tolist()) for i, k in enumerate(order)] + [(1000, None), (None, m[0].tolist())]
    v = spark.createDataFrame(rows, VECTORS)
    first = density.density_clusters(v, 120, 12, 4, 0.05).collect()
    assert len(first) == 240 and {r.cluster // 10 for r in first if r.cluster >= 0} == {0, 1}
    found = {r.idx: r.cluster for r in density.two_phase(v, 120, 12, 4, 0.05).collect()}
    assert len(found) == 240 and len(set(found.values()) - {-1}) == 3
    for k in range(3):
        assert len({found[i] for i in range(240) if own[order[i]] == k} - {-1}) == 1
    assert sum(x == -1 for x in found.values()) < 24


def test_no_vectors(spark):
    assert density.two_phase(spark.createDataFrame([], VECTORS)).collect() == []
    assert density.two_phase(spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)).collect() == [(1, -1)]
