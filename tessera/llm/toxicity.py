"""Toxicity by a support vector machine with a subsequence string kernel, on Nyström features.

The kernel of two strings is the sum over the character subsequences of length 4 that both hold, each weighted by
DECAY to the power of the stretches it spans, normalised by the strings' own kernels. Inserted characters and gaps only
stretch a subsequence, so "id-iot" stays close to "idiot". A sentence is its units: words without outer punctuation, also
with none inside, and runs of single characters joined.

Training: a sentence of a labelled document carries the document's label; a sentence that clean documents hold too is
clean. Every unit is a training row, as often as it stands in toxic sentences with label 1 and as often as it stands in
clean ones with label -1, and a linear SVM on Nyström features decides. Where most of a kernel's values are near zero
nothing can be learnt, so the machine looks only near some gates, units that are many times more frequent in toxic
sentences: a unit further than NEAR from all gates is no evidence. Landmarks are the units inside that cover the toxic and
the clean rows best; their features are whitened by the landmarks' own kernel.

A text is scored by how many of its units reach each of a few margins, in a logistic fit to the labelled documents.

There are as many gates as it takes to cover all units that are LEAST_RATIO times as frequent in toxic sentences, and that by
more than chance explains among so many units: by a likelihood ratio above the units' number over BY_CHANCE. Rarer
insults are found by their nearness to others alone. What is bounded: SAMPLE documents of each class, and the LANDMARKS, the
rank of the approximation. A word of one or two characters is near to itself alone; an insult of two words is not a unit."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, kept, staged, strings

LENGTH, DECAY = 4, 0.6
#: Stands before each word, so that subsequences from a word's beginning count on their own, and behind words that are shorter than a subsequence.
EDGE = "\x02"
#: Longer words are scored by overlapping windows of this many characters, so that no insult falls between two.
WINDOW = 24
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»…"
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Words whose margins a worker keeps; all are dropped beyond it.
MOST_WORDS = 300_000


def units_of(text: str) -> set[str]:
    """The distinct units of a text."""
    low = text.lower()
    words = {w.strip(MARKS) for w in set(low.split())}
    for run in SPELLED.findall(low):
        words.add("".join(run.split()).strip(MARKS))
    for w in [w for w in words if not w.isalnum()]:
        words.add("".join(filter(str.isalnum, w)))
    words.discard("")
    return words


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def codes(words: list[str], alphabet: np.ndarray | None = None) -> np.ndarray:
    """(words, longest) character numbers; 0 is the end, and characters outside the alphabet (ascending code points)."""
    words = [EDGE + w + EDGE * (LENGTH - 1 - len(w)) for w in words]
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if alphabet is not None:
        at = np.minimum(np.searchsorted(alphabet, flat), len(alphabet) - 1)
        flat = np.where(alphabet[at] == flat, at + 1, 0)
    sizes = np.array([len(w) for w in words])
    out = np.zeros((len(words), sizes.max()), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def own_kernel(words: list[str]) -> np.ndarray:
    s = codes(words)
    n, size = s.shape
    layers, total = [np.zeros((size + 1, n)) for _ in range(LENGTH - 1)], np.zeros(n)
    for i in range(size):
        eq = DECAY**2 * ((s[:, i : i + 1] == s) & (s[:, i : i + 1] > 0)).T
        total += (eq * layers[-1][:-1]).sum(axis=0)
        below = [eq, *(eq * x[:-1] for x in layers[:-1])]
        for x, add in zip(layers, below):
            x *= DECAY
            step = np.zeros(n)
            for j in range(size):
                step = DECAY * step + add[j]
                x[j + 1] += step
    return total


class Kernel:
    """Normalised kernel values of words to fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.alphabet = np.unique(codes(landmarks)[codes(landmarks) > 0])
        marks = codes(landmarks, self.alphabet)
        self.m, self.size = marks.shape
        # By place in the landmark, character and landmark: whether they match, and what the character adds to subsequences of length 1.
        self.eq = np.zeros((self.size, len(self.alphabet) + 1, self.m), dtype=np.float32)
        for k in range(1, len(self.alphabet) + 1):
            self.eq[:, k] = DECAY**2 * (marks == k).T
        self.first = np.zeros_like(self.eq)
        for j in range(1, self.size):
            self.first[j] = DECAY * self.first[j - 1] + self.eq[j - 1]
        self.own = np.sqrt(own_kernel(landmarks))
        self.at_once = max(16, min(256, 8192 // max(1, self.m)))

    def batch(self, words: list[str]) -> np.ndarray:
        s, n = codes(words, self.alphabet), len(words)
        layers = [np.zeros((self.size, n, self.m), np.float32) for _ in range(LENGTH - 1)]
        total, step = np.zeros((n, self.m), np.float32), np.empty((n, self.m), np.float32)
        add = np.empty_like(layers[0])
        for c in s.T:
            eq = np.take(self.eq, c, axis=1)
            total += np.einsum("jnm,jnm->nm", eq, layers[-1])
            for k in range(LENGTH - 2, 0, -1):
                np.multiply(eq, layers[k - 1], out=add)
                layers[k] *= DECAY
                step[:] = 0
                for j in range(1, self.size):
                    step *= DECAY
                    step += add[j - 1]
                    layers[k][j] += step
            layers[0] *= DECAY
            layers[0] += np.take(self.first, c, axis=1)
        own = np.sqrt(own_kernel(words))
        return total / np.maximum(own[:, None] * self.own[None, :], 1e-12)

    def __call__(self, words: list[str]) -> np.ndarray:
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = np.zeros((len(words), self.m))
        for at in range(0, len(order), self.at_once):
            part = order[at : at + self.at_once]
            out[part] = self.batch([words[i] for i in part])
        return out


#: A text's evidence: by step, the logarithm of one more than the number of its units whose margin is at least that.
STEPS = (-0.4, 0.0, 0.3, 0.6, 0.9)
#: Kernel value to a gate from which on a unit is looked at.
NEAR = 0.3


@dataclass
class Model:
    gates: list[str]
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    evidence: tuple[float, ...]
    offset: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.gates = Kernel(model.gates) if model.gates else None
        self.kernel = Kernel(model.landmarks) if model.landmarks else None
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        """The margin of each word: of its windows near a gate the largest, below all steps without such a window."""
        self.known.update(dict.fromkeys(words, -np.inf))
        parts = [(w, p) for w in words for p in windows(w)]
        if not parts:
            return
        parts = [parts[i] for i in np.flatnonzero(self.gates([p for _, p in parts]).max(axis=1) >= NEAR)]
        if parts:
            margins = self.kernel([p for _, p in parts]) @ self.model.weights + self.model.bias
            for (w, _), m in zip(parts, margins.tolist()):
                self.known[w] = max(m, self.known[w])

    def evidence(self, texts: list[str]) -> np.ndarray:
        """(texts, steps): see STEPS."""
        out = np.zeros((len(texts), len(STEPS)))
        if not self.kernel:
            return out
        for at in range(0, len(texts), 64):
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            sets = [units_of(t) for t in texts[at : at + 64]]
            self.learn(list(set().union(*sets) - self.known.keys()))
            for i, s in enumerate(sets, at):
                high = [m for m in map(self.known.__getitem__, s) if m >= STEPS[0]]
                if high:
                    out[i] = [sum(m >= step for m in high) for step in STEPS]
        return np.log1p(out)


def svm(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights w that make |w|^2 / 2 + the sum of toxic * max(0, 1 - xw)^2 + clean * max(0, 1 + xw)^2 least, by Newton
    steps with halving; the last column of x is the bias, which is hardly held back."""
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3

    def cost(w: np.ndarray) -> float:
        f = x @ w
        return w @ keep @ w / 2 + toxic @ np.maximum(0, 1 - f) ** 2 + clean @ np.maximum(0, 1 + f) ** 2

    w = np.zeros(x.shape[1])
    now = cost(w)
    for _ in range(rounds):
        f = x @ w
        above, below = np.where(f < 1, toxic, 0.0), np.where(f > -1, clean, 0.0)
        slope = keep @ w + 2 * x.T @ (below * (1 + f) - above * (1 - f))
        step = np.linalg.solve(keep + 2 * (x * (above + below)[:, None]).T @ x, slope)
        size, then = 1.0, cost(w - step)
        while then > now and size > 1e-6:
            size /= 2
            then = cost(w - size * step)
        if then >= now - 1e-12 * max(1.0, now):
            break
        w, now = w - size * step, then
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, none negative, and offset by penalised Newton steps; both classes weigh the same, whatever their shares among the
    labelled documents, and targets are softened as Platt proposes."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    heavy = np.where(y == 1, neg / max(pos, 1), 1.0)
    full = np.hstack([x, np.ones((len(x), 1))])
    use = np.ones(full.shape[1], dtype=bool)
    while True:
        v, part = np.zeros(use.sum()), full[:, use]
        v[-1] = np.log((pos + 1) / (neg + 1))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ v, -30, 30)))
            h = part.T @ (part * (heavy * np.maximum(p * (1 - p), 1e-6))[:, None]) + 1e-2 * np.eye(len(v))
            d = np.linalg.solve(h, part.T @ (heavy * (p - t)) + 1e-2 * v)
            v -= d * min(1.0, 5 / max(np.abs(d).max(), 1e-9))
            if np.abs(d).max() < 1e-8:
                break
        out = np.zeros(full.shape[1])
        out[use] = v
        if (out[:-1] >= 0).all():
            return out[:-1], float(out[-1])
        use[:-1] &= out[:-1] > 0


#: Labelled documents of each class that training reads at most, and the rank of the features: landmarks that cover the toxic and the clean rows.
SAMPLE, LANDMARKS = 2000, (80, 160)
#: How much more frequent a gate must be in toxic sentences than in clean ones, and how many gates chance may open: all that a
#: needless gate does is that more units are looked at.
LEAST_RATIO, BY_CHANCE = 12, 20
#: Cost of all toxic rows together, and how much more all clean ones cost.
COST, CLEAN_COST = 5000.0, 8.0


def cover(words: list[str], weight: np.ndarray, most: float, enough: float = 1.0) -> list[str]:
    """The heaviest word, then always the one with the most weight that those before leave uncovered; without those covered enough."""
    out, near = [], np.zeros(len(words))
    while len(out) < most:
        left = np.where(near < enough, weight * (1 - near), 0.0)
        if not len(left) or left.max() <= 1e-9:
            break
        out.append(words[int(left.argmax())])
        near = np.maximum(near, Kernel(out[-1:])(words)[:, 0])
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most SAMPLE labelled documents of each class, taken by a hash of their id. Null labels and texts are
    left out; of several texts of one id that with the smallest hash is read. Without both classes, or without units that open a gate, every text gets the toxic share (0.5 without labels)."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    picked = own.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).unionByName(own.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    shares = dict(own.groupBy("y").count().collect())
    base = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    flat = Model([], [], np.zeros(0), 0.0, (0.0,) * len(STEPS), float(np.log(base / (1 - base))))

    @F.pandas_udf("array<string>")
    def sentence_units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sorted({p for u in units_of(t) for p in windows(u)}) for t in strings(batch)])

    read = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null")
    sample = staged(read.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")), "toxicity-sample")
    parts = sample.select("y", F.explode(F.split("t", SENTENCE.pattern)).alias("s")).groupBy("s").agg(F.min("y").alias("y"))
    held = staged(parts.select("y", sentence_units("s").alias("units")), "toxicity-units")
    totals = dict(held.groupBy("y").count().collect())
    if not totals.get(0) or not totals.get(1):
        return flat
    by_unit = staged(held.select("y", F.explode("units").alias("unit")).groupBy("unit").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")), "toxicity-counts")
    ratio = F.col("toxic") / totals[1] / ((F.col("clean") + 0.5) / totals[0])
    n, share = F.col("toxic") + F.col("clean"), totals[1] / (totals[0] + totals[1])
    log = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.ln(F.col(k) / (n * q))).otherwise(0.0)
    surprise = log("toxic", share) + log("clean", 1 - share)
    marks = by_unit.where((ratio >= LEAST_RATIO) & (surprise >= float(np.log(1 + by_unit.count() / BY_CHANCE)))).select("unit", "toxic").orderBy("unit").toPandas()
    gates = cover(marks["unit"].to_list(), marks["toxic"].to_numpy(dtype=float), np.inf, NEAR)  # what is near a gate is looked at without a gate of its own
    if not gates:
        return flat

    @F.pandas_udf("boolean")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kernel = Kernel(gates)
        for batch in batches:
            yield pd.Series(kernel(batch.to_list()).max(axis=1) >= NEAR)

    rows = by_unit.where(near("unit")).orderBy("unit").toPandas()
    return train(gates, rows["unit"].to_list(), rows["toxic"].to_numpy(dtype=float), rows["clean"].to_numpy(dtype=float), totals, sample, flat)


def train(gates: list[str], units: list[str], toxic: np.ndarray, clean: np.ndarray, totals: dict[int, int], sample: DataFrame, flat: Model) -> Model:
    """The machine on the units near a gate, and the logistic fit of the sample's labels to what it finds in the texts."""
    leaning = toxic / totals[1] > clean / totals[0]
    landmarks = sorted({*cover(units, np.sqrt(np.where(leaning, toxic, 0.0)), LANDMARKS[0]), *cover(units, np.sqrt(np.where(leaning, 0.0, clean)), LANDMARKS[1])})
    whole = Kernel(landmarks)
    value, vector = np.linalg.eigh(whole(landmarks))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    x = np.hstack([whole(units) @ whiten, np.ones((len(units), 1))])
    w = svm(x, COST * toxic / totals[1], COST * CLEAN_COST * clean / totals[0])
    model = Model(gates, landmarks, whiten @ w[:-1], float(w[-1]), flat.evidence, 0.0)
    seen = sample.select("y", evidence_column(F.col("t"), model).alias("e")).toPandas()
    evidence, offset = logistic(np.array([*seen["e"]]), seen["y"].to_numpy())
    return Model(gates, landmarks, model.weights, model.bias, tuple(evidence), offset) if evidence.any() else flat


def evidence_column(text: Column, model: Model) -> Column:
    name = repr((model.gates, model.landmarks, model.weights.tolist(), model.bias)).encode()

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept(("toxicity", name), lambda: Scorer(model))
        for batch in batches:
            yield pd.Series([*scorer.evidence(strings(batch))], dtype=object)

    return evidence(text)


def with_toxicity(df: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold) of each whole text, under the names in out.

    Null and empty texts get the score of a text without any unit; very long texts and words are scored whole. Equal texts
    get equal scores, own columns of these two names give way, and an empty table gives no rows."""
    hold = "_" + uuid.uuid4().hex
    rows = df.withColumn(hold, evidence_column(F.col(text), model))
    z = sum((F.col(hold)[k] * float(w) for k, w in enumerate(model.evidence)), F.lit(float(model.offset)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    scored = appended(rows, F.struct(score.alias(out[0])), [out[0]]).drop(hold)
    return appended(scored, F.struct((F.col(out[0]) >= threshold).cast("int").alias(out[1])), [out[1]])
