"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause as a string of word classes: insult, threat, target, negation, reported speech.
Each passes its input on with a factor, and :func:`compose` makes one deterministic machine of them whose factor is the
product. The patterns: an insult near a target, and a chain of insults, count in full; an insult that stands alone is the
weakest pattern, at ``LONE`` of that; negated or reported ones count less (who reports is no target); a threat counts only where a target follows.
A clause scores the lexicon weights of its matches times the machine's factors, and a document is scored by what its
matched clauses add up to.

The insult lexicon is learned: words and stems (prefixes) whose presence in labelled training rows speaks for
the label beyond chance, weighted by their log-odds. It is compiled into one automaton, and only documents that it
touches are parsed. Threats are known by their stems and inflections. Counting runs in Spark over at most
``max_labelled`` training documents (chosen by a hash of the id; of rows that share an id, the one with the least hash of
its text; near copies of one text count once); the driver holds only the lexicon, which that sample bounds too.

Edge cases: a null or empty text has no clause and gets the score of an untouched document; a null ``doc_id`` is never
held out; repeated rows are scored each; no labels, or only one class, give every document score 0; labels with null
fields are left out; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved, sliced

MAX_LABELLED, STEMS = 20_000, (4, 5, 6, 7, 8)
FOLDS, FOLD, LIMIT = 3, 1, 0.7

# Closed word classes of the grammar (English, German, French, Spanish).
TARGETS = "you your yours he she they them him her u du dich dir ihr euch sie er tu te toi vous il elle ils elles usted tú ti él ella ellos".split()
NEGATIONS = "not no never isn aren wasn don doesn didn without nicht kein keine nie ohne ne pas jamais sans nunca jamás sin".split()
REPORTS = "said says say called calls wrote writes quoted claimed reported sagte sagt nannte schrieb disait dit appelé écrit dijo dice llamó escribió".split()
# Stems of threats, the endings that they take (after a doubled last letter too), and forms that no stem covers.
THREATS = "kill murder hurt beat stab shoot strangl burn töt umbring schlag frapp étrangl golpe dispar apuñal".split()
ENDINGS = "e s ed es er ers ing en et t te ten est end ez é ée és er ent ant ons a o as an ar aré ará ado ando ear eo eas eado eando".split()
SHORT_THREATS = "tuer tue tuerai tuera tué tuez matar mato mata maté mataré matando shot getötet bringe schlägt schlug".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = 6
#: Words over which a target or a negation reaches; what an insult counts that stands alone.
REACH, LONE = 4, 0.5
WORD, CLAUSE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n|]+")


class Machine:
    """A deterministic weighted transducer on word classes: next state and factor by state and class."""

    def __init__(self, step: np.ndarray, factor: np.ndarray):
        self.step, self.factor = step, factor

    def run(self, classes: list[int]) -> list[float]:
        state, out = 0, []
        for c in classes:
            out.append(float(self.factor[state, c]))
            state = int(self.step[state, c])
        return out


def _reaching(trigger: int, on: int, near: float, far: float = 1.0, ends: int | None = None) -> Machine:
    """State k > 0: ``trigger`` was read REACH - k words before the last; an ``on`` then has factor ``near``. The class
    ``ends`` cuts the reach off."""
    step, factor = np.zeros((REACH + 1, CLASSES), int), np.ones((REACH + 1, CLASSES))
    for s in range(REACH + 1):
        step[s] = max(0, s - 1)
        step[s, trigger] = REACH
        if ends is not None:
            step[s, ends] = 0
        factor[s, on] = near if s else far
    return Machine(step, factor)


def _from_then_on(trigger: int, on: int, after: float) -> Machine:
    step = np.zeros((2, CLASSES), int)
    step[1] = 1
    step[0, trigger] = 1
    factor = np.ones((2, CLASSES))
    factor[1, on] = after
    return Machine(step, factor)


def insult_machine() -> Machine:
    """Insults count, other classes do not: the first in a clause as one that stands alone, later ones as a chain."""
    step, factor = np.zeros((2, CLASSES), int), np.zeros((2, CLASSES))
    step[1] = 1
    step[:, INSULT] = 1
    factor[:, INSULT] = (LONE, 1.0)
    factor[:, TARGET] = 1.0  # left to the threat machine, which asks for a threat
    return Machine(step, factor)


def threat_machine() -> Machine:
    """A target within REACH words of a threat is a match; no other target is."""
    return _reaching(THREAT, TARGET, 1.0, 0.0)


def words_alone() -> Machine:
    """No grammar: every insult counts alike. Only for comparison."""
    factor = np.zeros((1, CLASSES))
    factor[0, INSULT] = 1.0
    return Machine(np.zeros((1, CLASSES), int), factor)


def threatens(word: str) -> bool:
    """Whether a word is a form of a threat."""
    if word in SHORT_THREATS:
        return True
    for n in range(min(8, len(word)), 2, -1):
        if word[:n] in THREATS:
            rest = word[n:]
            return not rest or rest in ENDINGS or (rest[0] == word[n - 1] and rest[1:] in ENDINGS)
    return False


def compose(a: Machine, b: Machine) -> Machine:
    """Both in step: states are pairs, factors are multiplied."""
    n, m = len(a.step), len(b.step)
    step = (a.step[:, None, :] * m + b.step[None, :, :]).reshape(n * m, CLASSES)
    return Machine(step, (a.factor[:, None, :] * b.factor[None, :, :]).reshape(n * m, CLASSES))


def grammar() -> Machine:
    out = insult_machine()
    for m in (threat_machine(), _reaching(TARGET, INSULT, 1.25 / LONE, ends=REPORT), _reaching(NEGATION, INSULT, 0.6), _from_then_on(REPORT, INSULT, 0.75)):
        out = compose(out, m)
    return out


class Grammar:
    """The composed machine with a lexicon: ``stems`` (prefixes) and ``words`` with weights."""

    def __init__(self, stems: dict[str, float], words: dict[str, float], machine: Machine | None = None):
        self.stems, self.words, self.machine = stems, words, machine or grammar()
        self.closed = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.longest = max(map(len, stems), default=0)
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}  # each worker compiles its own

    def _compiled(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for w in {*self.stems, *self.words, *THREATS, *SHORT_THREATS}:
                self.automaton.add_word(w, len(w))
            self.automaton.make_automaton()
        return self.automaton

    def weight(self, word: str) -> float:
        """Of a whole word: its own, else its longest stem's."""
        if word in self.words:
            return self.words[word]
        for n in range(min(self.longest, len(word)), 0, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """Matched clauses of a lower-cased text: begin, end and score."""
        if not (self.stems or self.words):
            return []
        hits = sorted({e + 1 - n for e, n in self._compiled().iter(text) if e + 1 == n or not text[e - n].isalpha()})
        if not hits:
            return []
        cuts = [0, *[m.end() for m in CLAUSE.finditer(text)], len(text) + 1]
        out, last = [], -1
        for h in hits:
            k = bisect.bisect_right(cuts, h) - 1
            if k != last:
                last = k
                score = self._clause(WORD.findall(text[cuts[k] : cuts[k + 1]]))
                if score > 0:
                    out.append((cuts[k], cuts[k + 1], score))
        return out

    def _clause(self, words: list[str]) -> float:
        weights = [self.weight(w) for w in words]
        classes = [INSULT if x > 0 else self.closed[w] if w in self.closed else THREAT if threatens(w) else OTHER for w, x in zip(words, weights)]
        strong = self.threat_weight()
        return sum(f * (x if c == INSULT else strong) for f, c, x in zip(self.machine.run(classes), classes, weights) if f > 0 and c in (INSULT, TARGET))

    def threat_weight(self) -> float:
        return max([*self.stems.values(), *self.words.values()], default=0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Whether there is a matched clause, the log of their sum, and their sum by length of text."""
        total = sum(c[2] for c in self.clauses(text.lower())) if text else 0.0
        return float(total > 0), math.log1p(total), total / math.log2(4 + len(text) / 6) if text else 0.0


def learn_lexicon(training: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and words that tell toxic from other rows of ``text, toxic``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    rows = training.filter("text is not null and toxic is not null").select(F.col("toxic").cast("int").alias("y"), words.alias("w"))
    # Near copies mostly share the least hash of their word pairs: of those with one such hash, one is counted.
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    keyed = rows.filter(F.size("w") > 0).withColumn("k", F.array_min(pairs))
    once = keyed.groupBy("k", "y").agg(F.min("w").alias("w")).select("y", F.explode("w").alias("w"))
    counts = once.groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    units = F.array_distinct(F.array(F.concat(F.lit("="), F.col("w")), *[F.substring("w", 1, n) for n in STEMS]))
    long = counts.filter(F.length("w") >= 3).select(F.explode(F.when(F.length("w") < STEMS[0], F.array(F.concat(F.lit("="), F.col("w")))).otherwise(units)).alias("u"), "pos", "neg")
    sums = long.groupBy("u").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0)), F.count("*")).first()
    if not total[0] or not total[1]:
        return {}, {}
    base = total[0] / (total[0] + total[1])
    # The log-likelihood ratio against the base rate must stand out among all units tried.
    need = 2 * math.log(max(10, total[2])) + 8
    n, p = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    ratio = 2 * (F.col("pos") * F.ln(p / base) + F.when(F.col("neg") > 0, F.col("neg") * F.ln((1 - p) / (1 - base))).otherwise(0.0))
    chosen = sums.filter((F.col("pos") > 0) & (p > 0.5)).withColumn("g", ratio).filter(F.col("g") >= need).collect()
    weight = {r.u: math.log((r.pos + 0.5) / (total[0] + 1)) - math.log((r.neg + 0.5) / (total[1] + 1)) for r in chosen}
    stems: dict[str, float] = {}
    for u in sorted((u for u in weight if u[0] != "="), key=lambda u: (len(u), u)):
        if not any(u[:k] in stems for k in range(1, len(u))):  # the shortest stem that is pure enough stands for longer ones
            stems[u] = weight[u]
    words_ = {u[1:]: x for u, x in weight.items() if u[0] == "=" and not any(u[1 : 1 + k] in stems for k in range(1, len(u)))}
    return stems, words_


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Weights (the last for the constant) of a ridge-penalised logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        d = np.linalg.solve(h, x.T @ (p - y) / len(y) + ridge * w)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


SCORES = "doc_id long, held_out boolean, score double"


class Toxicity:
    """A fitted grammar with its calibration."""

    def __init__(self, lexicon: Grammar, weights: np.ndarray | None):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = float(np.dot(self.lexicon.features(text), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, folds: int | None = FOLDS, fold: int = FOLD, max_labelled: int = MAX_LABELLED, machine: Machine | None = None) -> Toxicity:
    """Learn from labelled documents outside the held-out fold (``folds`` None: from all labelled ones).
    ``machine`` stands in for the grammar."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if folds:
        known = known.filter(~held_out("doc_id", folds, fold))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    training = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("t")).join(F.broadcast(known), "doc_id")
    training = training.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("t").alias("t")).select("t.text", "toxic")
    training = saved(training, "toxicity")
    lexicon = Grammar(*learn_lexicon(training), machine)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            f = np.array([lexicon.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 3).round(6)
            yield pa.RecordBatch.from_arrays([*map(pa.array, f.T), batch.column(1)], ["a", "b", "c", "y"])

    rows = sorted(training.mapInArrow(measure, "a double, b double, c double, y int").groupBy("a", "b", "c", "y").agg(F.count("*").alias("n")).collect())
    y = np.repeat([r.y for r in rows], [r.n for r in rows]).astype(float)
    if not lexicon.threat_weight() or len(set(y)) < 2:
        return Toxicity(lexicon, None)
    x = np.repeat([[r.a, r.b, r.c] for r in rows], [r.n for r in rows], axis=0)
    return Toxicity(lexicon, logistic(x, y))


def score(docs: DataFrame, model: Toxicity, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out("doc_id", folds, fold).alias("held_out"))
    return rows.mapInArrow(run, SCORES).withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def non_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the limit, columns as they come. The text alone decides, so the filter is a narrow
    transformation that moves nothing."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [model.score(t) < LIMIT for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
