"""Language ID: a bidirectional gated recurrent network over bytes.

The text is lower-cased and every run of other characters than letters and marks becomes one space. One recurrent unit
reads its bytes forward and one backward, across words, and a softmax on both labels every byte position; a document's
probabilities are the mean over all its positions. Texts of any length are read in windows of ``CORE`` labelled
positions, on each side of which the units also read ``CONTEXT`` bytes more, so that no state starts at a
labelled position but at the ends of a text. Windows of many documents run in step, as rows of a matrix.

The network is trained in numpy by backpropagation through time with Adam, on the driver, from a bounded sample outside
the held-out fold: of each language ``PER_LANGUAGE`` documents by a hash of the id (``LEAST`` at least, where there are
many languages), and ``PIECES`` pieces of ``TRAINED`` characters from hashed places of each. Prediction reads whole texts.

Edge cases: a text that is null or has no letter gets ``und`` and score 0, and so does every text if nothing could be
learned; documents with a null ``lang`` or ``doc_id`` teach nothing, and a null id is never held out; a single language is
predicted for all texts with letters; repeated rows are predicted each; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, sliced

PER_LANGUAGE, MAX_DOCS, LEAST, PIECES, TRAINED = 750, 12_000, 20, 4, 48
HIDDEN, STEPS, BATCH, RATE = 12, 300, 160, 0.02
#: Lengths of training pieces; short ones prepare for short texts.
LENGTHS = (3, 6, 12, 24, 48)
#: Positions that a window labels, bytes read before and after them, and windows that run in step.
CORE, CONTEXT, STEP = 448, 32, 1024
FOLDS, FOLD = 5, 0
UNKNOWN = "und"
NOT_LETTERS, LETTER = r"[^\pL\pM]+", r"\pL"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(o: np.ndarray) -> np.ndarray:
    o = np.exp(o - o.max(-1, keepdims=True))
    return o / o.sum(-1, keepdims=True)


class Network:
    """Weights: for each direction an input table by byte (256 x 3h), a recurrent matrix (h x 3h) and its bias (the gates
    are update, reset, candidate); the output matrix (2h x languages) and its bias."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 6):
        rng = np.random.default_rng(seed)
        h, n = hidden, len(languages)
        self.languages, self.h = languages, h
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("E", rng.normal(0, 0.3, (256, 3 * h))), ("U", rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))), ("b", np.zeros(3 * h)))}
        self.p |= {"V": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, n)), "c": np.zeros(n)}

    def _over(self, d: str, x: np.ndarray, keep: bool):
        """States of one direction for runs of equal length (runs x steps), and what going back needs."""
        E, U, b, h = self.p["E" + d], self.p["U" + d], self.p["b" + d], self.h
        s, states, trail = np.zeros((len(x), h), E.dtype), [], []
        for t in range(x.shape[1]):
            e, r = E[x[:, t]], s @ U + b
            zr = _sigmoid(e[:, : 2 * h] + r[:, : 2 * h])
            z, q = zr[:, :h], zr[:, h:]
            c = np.tanh(e[:, 2 * h :] + q * r[:, 2 * h :])
            new = z * s + (1 - z) * c
            if keep:
                trail.append((s, z, q, c, r[:, 2 * h :]))
            s = new
            states.append(s)
        return np.stack(states, 1), trail

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every position: runs x steps x languages."""
        f, b = self._over("f", x, False)[0], self._over("b", x[:, ::-1], False)[0][:, ::-1]
        return _softmax(np.concatenate([f, b], 2) @ self.p["V"] + self.p["c"])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient by backpropagation through time."""
        h, grad = self.h, {}
        f, ft = self._over("f", x, True)
        b, bt = self._over("b", x[:, ::-1], True)
        s = np.concatenate([f, b[:, ::-1]], 2)
        p = _softmax(s @ self.p["V"] + self.p["c"])
        n = x.size
        loss = -float(np.log(p[np.arange(len(x)), :, y] + 1e-12).sum()) / n
        p[np.arange(len(x)), :, y] -= 1
        p /= n
        grad["V"], grad["c"] = np.tensordot(s, p, ((0, 1), (0, 1))), p.sum((0, 1))
        ds = p @ self.p["V"].T
        for d, trail, dd, xx in (("f", ft, ds[:, :, :h], x), ("b", bt, ds[:, ::-1, h:], x[:, ::-1])):
            U = self.p["U" + d]
            gE, gU, gb = np.zeros_like(self.p["E" + d]), np.zeros_like(U), np.zeros(3 * h)
            back = np.zeros((len(x), h))
            for t in range(x.shape[1] - 1, -1, -1):
                s0, z, q, c, rc = trail[t]
                g = dd[:, t] + back
                dc = g * (1 - z) * (1 - c * c)
                dz = g * (s0 - c) * z * (1 - z)
                dq = dc * rc * q * (1 - q)
                de = np.concatenate([dz, dq, dc], 1)
                dr = np.concatenate([dz, dq, dc * q], 1)
                gE += np.bincount((xx[:, t, None] * (3 * h) + np.arange(3 * h)).ravel(), de.ravel(), gE.size).reshape(gE.shape)
                gU += s0.T @ dr
                gb += dr.sum(0)
                back = g * z + dr @ U.T
            grad |= {"E" + d: gE, "U" + d: gU, "b" + d: gb}
        return loss, grad

    def train(self, pieces: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> list[float]:
        """Adam on batches of pieces of one length at random places, languages in equal shares; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        longest = max(LENGTHS)
        size = np.array([min(len(w), longest) for w in pieces])
        raw = np.zeros((len(pieces), longest), np.int64)
        for row, w in zip(raw, pieces):
            row[: min(len(w), longest)] = np.frombuffer(w[:longest], np.uint8)
        least = [n for n in LENGTHS if (size >= n).any()] or [int(size.max())]
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            n = int(rng.choice(least))
            fit = np.flatnonzero(size >= n)
            weight = 1 / np.bincount(y[fit], minlength=len(self.languages)).clip(1)[y[fit]]
            pick = fit[rng.choice(len(fit), batch, p=weight / weight.sum())]
            begin = (rng.random(batch) * (size[pick] - n + 1)).astype(np.int64)
            loss, grad = self.gradients(raw[pick[:, None], begin[:, None] + np.arange(n)], y[pick])
            losses.append(loss)
            now = rate * min(1, t / 20) * (0.1 + 0.9 * (1 - t / steps))
            for k, a in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return losses


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many bytes in a row: each window's text, and where it and its labelled core begin and end."""
    count = -(-sizes // CORE)
    text = np.repeat(np.arange(len(sizes)), count)
    begin = (np.cumsum(sizes) - sizes)[text]
    core = begin + CORE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    stop = begin + sizes[text]
    core_end = np.minimum(core + CORE, stop)
    return text, np.maximum(core - CONTEXT, begin), core, core_end, np.minimum(core_end + CONTEXT, stop)


class Reader:
    """A trained network, laid out for reading many windows in step in single precision."""

    def __init__(self, network: Network):
        h, p, single = network.h, network.p, np.float32
        self.h, self.V, self.c = h, p["V"].astype(single), p["c"].astype(single)
        self.units = {}
        for d in "fb":
            E, U, b = p["E" + d], p["U" + d], p["b" + d]
            # A sigmoid is half a hyperbolic tangent of half its argument, so gates are halved here.
            own = [0.5 * (E[:, :h] + b[:h]), 0.5 * (E[:, h : 2 * h] + b[h : 2 * h]), E[:, 2 * h :], 0.5 * U[:, :h], 0.5 * U[:, h : 2 * h], 0.5 * U[:, 2 * h :], 0.5 * b[2 * h :]]
            self.units[d] = [np.ascontiguousarray(a, single) for a in own]

    def logits(self, d: str, x: np.ndarray) -> np.ndarray:
        """What one direction adds to the logits (steps x languages x windows) for bytes ``x`` (steps x windows)."""
        Ez, Eq, Ec, Uz, Uq, Uc, bc = self.units[d]
        V = np.ascontiguousarray((self.V[: self.h] if d == "f" else self.V[self.h :]).T)
        out = np.empty((x.shape[0], len(self.c), x.shape[1]), np.float32)
        s = np.zeros((x.shape[1], self.h), np.float32)
        z, q, c, m = (np.empty_like(s) for _ in range(4))
        for xt, o in zip(x, out):
            Ez.take(xt, 0, z, "clip")
            z += np.matmul(s, Uz, m)
            np.tanh(z, z)
            Eq.take(xt, 0, q, "clip")
            q += np.matmul(s, Uq, m)
            np.tanh(q, q)
            np.matmul(s, Uc, m)
            m += bc
            q += 1
            q *= m
            Ec.take(xt, 0, c, "clip")
            c += q
            np.tanh(c, c)
            # The new state is c + z (s - c), z being half of one more than its tangent.
            s -= c
            z += 1
            z *= 0.5
            s *= z
            s += c
            np.matmul(V, s.T, o)
        return out

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """Documents x languages; a row of zeros where a text has no letter."""
        texts = pc.fill_null(texts, "")
        clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), NOT_LETTERS, " "), " ")
        clean = pc.if_else(pc.match_substring_regex(texts, LETTER), clean, "")
        sizes = pc.binary_length(clean).to_numpy().astype(np.int64)
        out, n = np.zeros((len(texts), len(self.c))), int(sizes.sum())
        if not n:
            return out
        offsets, raw = np.frombuffer(clean.buffers()[1], np.int32), np.frombuffer(clean.buffers()[2], np.uint8)
        data = raw[offsets[clean.offset] : offsets[clean.offset] + n]
        text, low, core, core_end, high = windows(sizes)
        length = high - low
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), STEP):
            w = order[i : i + STEP]
            size = length[w]
            steps = np.arange(size.max())[:, None]
            o = self.logits("f", data[np.minimum(low[w] + steps, n - 1)].astype(np.intp))
            back = self.logits("b", data[np.maximum(high[w] - 1 - steps, 0)].astype(np.intp))
            # The backward unit's state for a position is counted from the window's end.
            o += back[::-1] if size.min() == size.max() else np.take_along_axis(back, np.maximum(size - 1 - steps, 0)[:, None], 0)
            o += self.c[:, None]
            o -= o.max(1, keepdims=True)
            np.exp(o, o)
            own = (steps >= (core - low)[w]) & (steps < (core_end - low)[w])
            o *= (own / o.sum(1))[:, None]
            np.add.at(out, text[w], o.sum(0, dtype=np.float64).T)
        return out / np.maximum(1, sizes)[:, None]


def fit(docs: DataFrame, folds: int | None = FOLDS, fold: int = FOLD, per_language: int = PER_LANGUAGE, pieces: int = PIECES, steps: int = STEPS) -> Network | None:
    """The network trained on a bounded sample; None if there is nothing to learn from."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "lang", "text")
    if folds:
        known = known.filter(~held_out("doc_id", folds, fold))
    clean = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " "))
    # Ids first, on narrow rows (so many languages, so few documents of each); their texts after that.
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    if not languages:
        return None
    each = max(LEAST, min(per_language, MAX_DOCS // len(languages)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    chosen = known.select("lang", "doc_id", F.xxhash64("text").alias("h"), rank.alias("r")).filter(F.col("r") <= each).select("lang", "doc_id", "h").distinct()
    size = F.length("c")
    begins = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(size - TRAINED, F.lit(1))).cast("int") + 1 for i in range(pieces)]
    rows = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "doc_id", "h"]).select("doc_id", "h", "lang", clean.alias("c")).filter("c <> ''")
    found = rows.select("doc_id", "h", "lang", F.array(*[F.col("c").substr(b, F.lit(TRAINED)) for b in begins]).alias("w")).distinct().collect()
    pairs = [(w.encode(), r.lang) for r in sorted(found) for w in dict.fromkeys(r.w)]
    if not pairs:
        return None
    languages = sorted({x for _, x in pairs})
    network = Network(languages)
    network.train([w for w, _ in pairs], np.searchsorted(np.array(languages), np.array([x for _, x in pairs])), steps)
    return network


def labelled(network: Network | None, texts: pa.Array, reader: Reader | None) -> tuple[list[str], np.ndarray]:
    """The language and its probability of each text."""
    if network is None or reader is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = reader.probabilities(texts)
    best = p.argmax(1)
    top = np.minimum(p[np.arange(len(p)), best].round(6), 1.0)
    return [network.languages[k] if x > 0 else UNKNOWN for k, x in zip(best, p.max(1))], top


def predict(docs: DataFrame, network: Network | None, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network) if network else None
        for batch in sliced(batches, 2000, 4 << 20):
            names, scores = labelled(network, batch.column(1), reader)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out("doc_id", folds, fold).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a probability of at least ``least``, columns as they come; texts
    without letters go. Nothing is shuffled."""
    network = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(network) if network else None
        for batch in sliced(batches, 2000, 4 << 20):
            names, scores = labelled(network, batch.column("text"), reader)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
