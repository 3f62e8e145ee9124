"""Secret scans: rules find the plain forms, and a character convolutional network reads every other candidate in its context.

The rules' findings are the labelled positives, all other candidates the negatives. The network, in numpy, sees characters
around and inside a candidate: two convolutions, the highest response of each filter inside and around the candidate, and
one weight each. A third of the windows that it doesn't learn from gives the calibration and the threshold: the one with the
highest precision among those that keep the recall asked for. Half of the positives are shown again in other candidates'
surroundings, so that the network can't go by the keyword alone.

All different windows of all texts take part. Those to learn from are dealt to parts; in each round every part goes on from the
common weights over all of its windows, and the parts' weights, by their windows, have their mean as the next common ones. The
windows held back are scored where they are and leave as counts by logit, which give calibration and threshold."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, discard, staged, strings

#: The rules and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: Candidates: runs of such characters, without stops and dashes at their ends. The shortest rule on runs needs more.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SHORTEST = 16
FOUND = "net"
#: Characters before, inside (longer candidates are several windows) and after.
BEFORE, INSIDE, AFTER = 20, 36, 8
WIDTH = BEFORE + INSIDE + AFTER
#: One window of so many is held back to calibrate.
HELD = 3
#: Windows of the larger class in a part, and those that the rarer class has in each at least, if need be by joining several parts.
PART, LEAST_PART = 16_384, 2_000
#: Logits are counted to this fraction of one.
FINE = 1000
EMBEDDED, FILTERS, ROUNDS, EPOCHS, AT_ONCE, RATE = 12, 24, 3, 2, 128, 0.003
FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, str]


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The rules' spans, by start and kind, and the places of the secret values themselves."""
    spans, values = [], set()
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                spans.append((m.start(), m.end(), "assign"))
                values.add(m.span(2))
    for run in RUN.finditer(text):  # a long enough run of either kind lies within one
        for kind, rule in (("access", ACCESS), ("hex", HEX)):
            if kind == "hex" or "AKIA" in run[0]:
                for m in rule.finditer(text, *run.span()):
                    if m.end() - m.start() >= LEAST[kind]:
                        spans.append((*m.span(), kind))
                        values.add(m.span())
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans, sorted(values)


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that no rule touches. taken: spans in order of their starts, which may overlap."""
    out, k, reach = [], 0, 0
    for run in RUN.finditer(text):
        value = run[0].strip(".-")
        start = run.start() + run[0].find(value)
        end = start + len(value)
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if len(value) >= SHORTEST and reach <= start:
            out.append((start, end))
    return out


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The characters around and inside a candidate, a byte each: 0 for none, 1 for others than ASCII, 128 more inside."""
    out = []
    for at in range(start, end, INSIDE):
        stop = min(end, at + INSIDE)
        code = lambda s, more=0: bytes(ord(c) + more if 1 < ord(c) < 128 else 1 + more for c in s)
        before, after = code(text[max(0, at - BEFORE) : at]), code(text[stop : stop + AFTER])
        out.append(before.rjust(BEFORE, b"\0") + (code(text[at:stop], 128) + after).ljust(INSIDE + AFTER, b"\0"))
    return out


class Net:
    """Weights by name; forward() keeps what backward() needs."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int) -> Net:
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
        return cls({"chars": (r.standard_normal((256, EMBEDDED)) * 0.3).astype(np.float32), "first": make(5 * EMBEDDED, FILTERS), "first0": np.zeros(FILTERS, np.float32), "second": make(3 * FILTERS, FILTERS), "second0": np.zeros(FILTERS, np.float32), "last": make(2 * FILTERS, 1), "last0": np.zeros(1, np.float32)})

    @staticmethod
    def spread(x: np.ndarray, width: int) -> np.ndarray:
        """Each place with its neighbours, side by side."""
        n, length, k = x.shape
        padded = np.zeros((n, length + width - 1, k), np.float32)
        padded[:, width // 2 : width // 2 + length] = x
        return np.concatenate([padded[:, i : i + length] for i in range(width)], axis=2)

    @staticmethod
    def gathered(g: np.ndarray, width: int) -> np.ndarray:
        """The other way round: what each place gets back from its neighbours."""
        n, length, k = g.shape[0], g.shape[1], g.shape[2] // width
        padded = np.zeros((n, length + width - 1, k), np.float32)
        for i in range(width):
            padded[:, i : i + length] += g[:, :, i * k : (i + 1) * k]
        return padded[:, width // 2 : width // 2 + length]

    def forward(self, codes: np.ndarray) -> np.ndarray:
        w = self.w
        self.codes, inside = codes, (codes >= 128)[:, :, None]
        self.x1 = self.spread(w["chars"][codes], 5)
        self.h1 = np.maximum(self.x1 @ w["first"] + w["first0"], 0)
        self.x2 = self.spread(self.h1, 3)
        h2 = np.maximum(self.x2 @ w["second"] + w["second0"], 0)
        self.h2 = h2
        parts = [np.where(inside == side, h2, -1.0) for side in (True, False)]
        self.best = [p.argmax(axis=1) for p in parts]
        self.pooled = np.concatenate([np.maximum(p.max(axis=1), 0) for p in parts], axis=1).astype(np.float32)
        return (self.pooled @ w["last"] + w["last0"])[:, 0]

    def backward(self, g: np.ndarray) -> dict[str, np.ndarray]:
        w, out = self.w, {}
        g = g.astype(np.float32)[:, None]
        out["last"], out["last0"] = self.pooled.T @ g, g.sum(axis=0)
        back = (g @ w["last"].T) * (self.pooled > 0)
        gh = np.zeros_like(self.h2)
        rows, columns = np.arange(len(g))[:, None], np.arange(FILTERS)[None]
        for side, best in enumerate(self.best):
            np.add.at(gh, (rows, best, columns), back[:, side * FILTERS : (side + 1) * FILTERS])
        gh *= self.h2 > 0
        out["second"], out["second0"] = np.tensordot(self.x2, gh, ((0, 1), (0, 1))), gh.sum(axis=(0, 1))
        g1 = self.gathered(gh @ w["second"].T, 3) * (self.h1 > 0)
        out["first"], out["first0"] = np.tensordot(self.x1, g1, ((0, 1), (0, 1))), g1.sum(axis=(0, 1))
        out["chars"] = np.zeros_like(w["chars"])
        np.add.at(out["chars"], self.codes, self.gathered(g1 @ w["first"].T, 5))
        return out

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 512]) for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def trained(net: Net, codes: np.ndarray, labels: np.ndarray, seed: Sequence[int]) -> Net:
    """The net, further by Adam on the logistic loss over all windows, both classes weighing the same."""
    r = np.random.default_rng(seed)
    share = max(labels.mean(), 1e-9)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-9))
    m, v, t = {k: np.zeros_like(x) for k, x in net.w.items()}, {k: np.zeros_like(x) for k, x in net.w.items()}, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(codes))
        for i in range(0, len(order), AT_ONCE):
            own = order[i : i + AT_ONCE]
            g = (sigmoid(net.forward(codes[own])) - labels[own]) * weight[own] / len(own)
            t += 1
            for k, d in net.backward(g).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                net.w[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def calibrated(x: np.ndarray, labels: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from logits, each seen n times, to probabilities, by Newton steps with slightly softened labels."""
    n1, n0 = (n * labels).sum(), (n * (1 - labels)).sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w, z = np.array([1.0, 0.0]), np.stack([x, np.ones(len(x))])
    for _ in range(50):
        p = sigmoid(w @ z)
        step = np.linalg.solve((z * n * (p * (1 - p) + 1e-9)) @ z.T + 1e-6 * np.eye(2), z @ (n * (p - goal)) + 1e-6 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def threshold(p: np.ndarray, labels: np.ndarray, recall: float, n: np.ndarray | int = 1) -> float:
    """n: how often each score was seen. Of the thresholds that keep this recall, the one with the highest precision; the highest one among equals, halfway to the next lower score."""
    order = np.argsort(-p, kind="stable")
    n = np.broadcast_to(n, p.shape)
    found, seen = np.cumsum((labels * n)[order]), np.cumsum(n[order])
    last = np.append(np.diff(p[order]) != 0, True)  # equal scores go together
    good = last & (found >= recall * (labels * n).sum())
    best = int(np.flatnonzero(good)[np.argmax((found / seen)[good])])
    here = p[order][best]
    lower = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((here + lower) / 2)


def in_other_places(codes: np.ndarray, others: np.ndarray, seed: int | Sequence[int]) -> np.ndarray:
    """The insides of windows in the surroundings of others."""
    around = others[np.random.default_rng(seed).integers(len(others), size=len(codes))]
    return np.where(codes >= 128, codes, np.where(around < 128, around, 32)).astype(np.uint8)


def labelled(docs: DataFrame, text: str) -> DataFrame:
    """(positive, h, window): all windows of both classes, h a hash of them from 0; equal ones of a batch once."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept: set[tuple[bool, bytes]] = set()
            for t in strings(batch["t"]):
                spans, values = base_spans(t)
                for positive, places in ((True, values), (False, candidates(t, spans))):
                    for place in places:
                        kept.update((positive, w) for w in windows(t, *place))
            yield pd.DataFrame([(positive, xxhash.xxh64_intdigest(w, 5) >> 1, w) for positive, w in kept], columns=["positive", "h", "window"]).astype({"positive": bool, "h": "int64"})

    return docs.select(F.col(f"`{text}`").alias("t")).mapInPandas(pick, "positive boolean, h long, window binary")


def as_set(rows: pd.DataFrame, seed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """A part's windows and labels, in the order of their hashes; half of the positives again in other surroundings."""
    rows = rows.sort_values(["positive", "h"], ascending=[False, True])
    codes = np.frombuffer(b"".join(map(bytes, rows["window"])), np.uint8).reshape(-1, WIDTH)
    positive = rows["positive"].to_numpy()
    yes, no = codes[positive], codes[~positive]
    if len(yes) and len(no):
        yes = np.concatenate([yes, in_other_places(yes[::2], no, seed)])
    return np.concatenate([yes, no]), np.concatenate([np.ones(len(yes)), np.zeros(len(no))])


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def learned(rows: DataFrame, counts: dict[bool, int], seed: int = 7) -> Net:
    """A net that has learned from all rows (positive, h, window), of which counts tells how many of each class there are.

    Each row is in one part, one of a class with too few for the parts in several, at most in all."""
    parts = math.ceil(max(counts.values()) / PART)
    times = {c: min(parts, math.ceil(LEAST_PART * parts / n)) for c, n in counts.items()}
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("positive"), times[True]).otherwise(times[False]) - 1))
    dealt = rows.withColumn("again", again).withColumn("part", F.pmod(F.pmod(F.xxhash64("h"), F.lit(parts)) + F.col("again"), F.lit(parts)).cast("int")).drop("again").repartition(parts, "part")
    net = Net.fresh(seed)

    def step(k: int, common: dict[str, np.ndarray]):
        def further(key, part):
            codes, labels = as_set(part, [seed, 0, int(key[0])])
            own = flat(trained(Net({c: w.copy() for c, w in common.items()}), codes, labels, [seed, k, int(key[0])]).w).astype(float)
            return pd.DataFrame({"place": np.arange(len(own)), "w": own * len(codes), "n": float(len(codes))})

        return further

    for k in range(ROUNDS):
        mean = dealt.groupBy("part").applyInPandas(step(k, net.w), "place int, w double, n double").groupBy("place").agg((F.sum("w") / F.sum("n")).alias("w"))
        net = Net(unflat(np.array([r["w"] for r in sorted(mean.collect(), key=lambda r: r["place"])]), net.w))
    return net


def seen(rows: DataFrame, net: Net, count: int, seed: int = 7) -> pd.DataFrame:
    """(logit, positive, n): how often rows of a class have a logit, to 1 / FINE and within 40 of 0: a table of bounded size."""
    weights = net.w

    def scored(key, part):
        codes, labels = as_set(part, [seed, 1, int(key[0])])
        at = np.rint(np.clip(Net(weights).logits(codes), -40, 40) * FINE).astype(int)
        return pd.DataFrame({"at": at, "positive": labels == 1}).groupby(["at", "positive"]).size().reset_index(name="n")

    parts = math.ceil(count / PART)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int")).repartition(parts, "part")
    found = dealt.groupBy("part").applyInPandas(scored, "at int, positive boolean, n long").groupBy("at", "positive").agg(F.sum("n").alias("n")).orderBy("at", "positive")
    return found.select((F.col("at") / FINE).alias("logit"), "positive", "n").toPandas()


def fit(docs: DataFrame, text: str = "text", recall: float = 0.95) -> dict | None:
    """The network, its calibration and threshold, from all different windows of the texts; None where a class has too few."""
    every = staged(labelled(docs, text).dropDuplicates(["positive", "h"]).withColumn("held", F.col("h") % HELD == 0), "secret-windows")
    counts = {(r["held"], r["positive"]): r["count"] for r in every.groupBy("held", "positive").count().collect()}
    if len(counts) < 4 or min(counts[True, c] + counts[False, c] for c in (True, False)) < 4 * HELD:
        discard(every)
        return None
    net = learned(every.where("NOT held"), {c: counts[False, c] for c in (True, False)})
    scores = seen(every.where("held"), net, counts[True, True] + counts[True, False])
    discard(every)
    logits, labels, n = scores["logit"].to_numpy(float), scores["positive"].to_numpy(float), scores["n"].to_numpy(float)
    a, b = calibrated(logits, labels, n)
    return {"weights": net.w, "slope": a, "shift": b, "threshold": threshold(sigmoid(a * logits + b), labels, recall, n)}


def probabilities(model: dict, texts: list[str], found: list[list[tuple[int, int]]]) -> list[list[float]]:
    """Of each candidate of each text; one of several windows has the mean of their logits."""
    net, out = Net(model["weights"]), []
    held: list[bytes] = []
    sizes: list[int] = []
    logits: list[np.ndarray] = []

    def flush() -> None:
        if held:
            logits.append(net.logits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, WIDTH)))
            held.clear()

    for t, spans in zip(texts, found):
        for span in spans:
            own = windows(t, *span)
            sizes.append(len(own))
            held.extend(own)
            if len(held) >= 8192:
                flush()
    flush()
    every = np.concatenate(logits) if logits else np.zeros(0)
    starts = np.cumsum(sizes, dtype=np.int64) - sizes if sizes else np.zeros(0, np.int64)
    means = np.add.reduceat(every, starts) / sizes if sizes else every
    p, k = sigmoid(model["slope"] * means + model["shift"]).tolist(), 0
    for spans in found:
        out.append(p[k : k + len(spans)])
        k += len(spans)
    return out


def findings(texts: list[str], model: dict | None) -> list[list[Span]]:
    """All spans of each text, by start and kind; the network's have the kind FOUND."""
    base = [base_spans(t)[0] for t in texts]
    if model is None:
        return base
    others = [candidates(t, b) for t, b in zip(texts, base)]
    return [sorted([*b, *((s, e, FOUND) for (s, e), p in zip(o, ps) if p >= model["threshold"])], key=lambda s: (s[0], (*KINDS, FOUND).index(s[2]))) for b, o, ps in zip(base, others, probabilities(model, texts, others))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(model: dict | None) -> Column:
    @F.pandas_udf(FIELDS)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for spans in findings(strings(batch), model):
                base = [s for s in spans if s[2] != FOUND]
                rows.append((*[sum(s[2] == k for s in base) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return apply


def with_findings(df: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """df with the counts of the rules' spans, their digest, and all spans as kind:start:end in code points.

    A null text is empty and has none; a text of any length is read whole, and a long candidate is scored on all of its
    windows. Repeated rows are scored each, alike; own columns named like the new ones give way; an empty table gives no rows."""
    return appended(df, scan(model)(F.col(f"`{text}`")), [f.split()[0] for f in FIELDS.split(", ")])
