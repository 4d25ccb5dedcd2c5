"""Plain computations that operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_components(texts, k, percent):
    def shingles(t):
        w = [x for x in WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))]
        return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(i for i in sets if sets[i])
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}
