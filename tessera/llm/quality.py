"""Quality by co-training of two views: the content of a text, and the metadata of its page.

The text view holds shares of character classes, repetition and lengths, and the text's words by hash bucket; the page view
holds a bucket of each metadata column. Each view has a logistic classifier. In every round each classifier names the
unlabelled documents of the whole corpus that it is surest of, and these become training rows, with its labels, of the
other. In the end both are calibrated on the labelled sample, out of fold, and a logistic combination of the calibrated
logits scores all documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import appended, staged, strings
from tessera.llm.toxicity import logistic

#: Labelled documents that training reads at most; rounds, pseudo-labels of each class and view a round, and how sure they must be.
SAMPLE, ROUNDS, EACH, SURE = 4000, 6, 40, 0.95
#: Hash buckets of a text's words, and of each metadata column.
WORD_BUCKETS, BUCKETS = 128, 64
_CLASS = np.zeros((256, 6))
_CLASS[65:91, 0] = _CLASS[48:58, 1] = 1
_CLASS[[33, 63], 2] = _CLASS[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126], 3] = _CLASS[[44, 46, 58, 59], 4] = _CLASS[10, 5] = 1


def text_view(text: str) -> list[float]:
    """Shares of character classes, of repeated words and lines, lengths, and the square roots of the words' shares by hash bucket; bounded for the empty and for very long texts."""
    raw = text.encode()
    n = max(1, len(raw))
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / n
    words = text.split()
    k = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    ends = sum(not w[-1].isalnum() for w in words)
    held = [0] * WORD_BUCKETS
    for w, n in counts.items():
        held[zlib.crc32(w.encode()) % WORD_BUCKETS] += n
    content = np.sqrt(np.array(held) / k)
    return [*shares, np.log1p(len(words)), len(raw) / k / 10, len(counts) / k, len(counts) / k**0.7, top / k, repeated, pairs / k, ends / k, np.log1p(k / max(1, len(lines))), sum(map(str.isupper, words)) / k, *content]


def page_view(values: tuple, n_columns: int) -> list[int]:
    """A bucket for each metadata column, by a hash of its place and value; null is a value."""
    return [zlib.crc32(f"{i}:{v}".encode()) % BUCKETS + BUCKETS * i for i, v in enumerate(values[:n_columns])]


def page_values(df: DataFrame, columns: list[str]) -> list[Column]:
    """The metadata columns as strings; numbers by half powers of two, so that neighbouring ones share a value."""
    number = {c for c, d in df.dtypes if d in ("tinyint", "smallint", "int", "bigint", "float", "double") or d.startswith("decimal")}
    return [(F.floor(2 * F.log2(1 + F.abs(F.col(f"`{c}`").cast("double")))) if c in number else F.col(f"`{c}`")).cast("string") for c in columns]


@dataclass
class Model:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    page: np.ndarray
    steps: list[tuple[float, float]]
    mix: tuple[float, float]
    offset: float

    def logits(self, x: np.ndarray, pages: np.ndarray) -> np.ndarray:
        """The calibrated logits of both views."""
        z = z_scores(x, (self.mean, self.scale)) @ self.text[:-1] + self.text[-1]
        m = self.page[pages].sum(axis=1) + self.page[-1]
        return np.stack([a * v + b for v, (a, b) in zip((z, m), self.steps)], axis=1)

    def score(self, x: np.ndarray, pages: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x, pages) @ np.array(self.mix) + self.offset, -30, 30)))


def ridge_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    full = np.hstack([x, np.ones((len(x), 1))])
    keep = penalty * np.eye(full.shape[1])
    keep[-1, -1] = 1e-6
    v = np.zeros(full.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -30, 30)))
        h = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + keep
        d = np.linalg.solve(h, full.T @ (weight * (p - y)) + keep @ v)
        v -= d * min(1.0, 4 / max(np.abs(d).max(), 1e-9))
        if np.abs(d).max() < 1e-7:
            break
    return v


class Learner:
    """Co-training of one set of labelled rows: x and hot are their views, y their labels."""

    def __init__(self, x: np.ndarray, hot: np.ndarray, y: np.ndarray):
        self.views = [x, hot]
        self.rows = [[(x, hot, y.astype(float), np.ones(len(y)))] for _ in (0, 1)]
        self.taken: list[set[int]] = [set(), set()]
        self.fit()

    def fit(self) -> None:
        """The classifiers of both views, of their labelled and pseudo-labelled rows; the latter weigh less."""
        self.weights = []
        for view, penalty in ((0, 1.0), (1, 4.0)):
            parts = self.rows[view]
            self.weights.append(ridge_logistic(np.vstack([p[view] for p in parts]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]), penalty))

    def teach(self, view: int, label: float, rows: list[int], x: np.ndarray, hot: np.ndarray) -> None:
        """Rows that the other view's classifier is sure of."""
        self.taken[view].update(rows)
        if rows:
            self.rows[view].append((x, hot, np.full(len(rows), label), np.full(len(rows), 0.3)))


def chance(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v @ weights[:-1] + weights[-1], -30, 30)))


def views(df: DataFrame, columns: list[str], text: str) -> Column:
    """A struct of the text view x and the page view m."""

    @F.pandas_udf("x array<float>, m array<int>")
    def look(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *meta in batches:
            x = [np.array(text_view(t), dtype=np.float32) for t in strings(texts)]
            m = [page_view(v, len(columns)) for v in zip(*meta)] if meta else [[]] * len(texts)
            yield pd.DataFrame({"x": pd.Series(x, dtype=object), "m": pd.Series(m, dtype=object)})

    return look(F.col(text), *page_values(df, columns))


def one_hot(pages: np.ndarray, width: int) -> np.ndarray:
    hot = np.zeros((len(pages), width))
    for column in pages.T:
        hot[np.arange(len(pages)), column] = 1
    return hot


def surest(pool: DataFrame, learners: list[Learner], scale: tuple[np.ndarray, np.ndarray], width: int) -> dict[tuple[int, int, int], list]:
    """By learner, teaching view and label: the EACH rows (row, x, m) that the view's classifier is surest of, among all rows that
    the other view hasn't learnt from. Each partition hands on no more than as many."""
    weights, taken = [one.weights for one in learners], [one.taken for one in learners]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], pd.DataFrame] = {}
        for batch in batches:
            if not len(batch):
                continue
            both = [z_scores(np.stack(batch["x"].to_list()), scale), one_hot(np.array([*batch["m"]], dtype=int).reshape(len(batch), -1), width)]
            for k, ws in enumerate(weights):
                for view in (0, 1):
                    p = chance(both[view], ws[view])
                    free = ~batch["row"].isin(taken[k][1 - view]).to_numpy()
                    for label, sure in ((1, p), (0, 1 - p)):
                        chosen = np.flatnonzero(free & (sure >= SURE))
                        chosen = chosen[np.lexsort((batch["row"].to_numpy()[chosen], -sure[chosen]))[:EACH]]
                        part = batch.iloc[chosen].assign(learner=k, view=view, label=label, sure=sure[chosen])
                        old = held.get((k, view, label))
                        part = part if old is None else pd.concat([old, part])
                        held[k, view, label] = part.sort_values(["sure", "row"], ascending=[False, True]).head(EACH)
        for part in held.values():
            yield part[["learner", "view", "label", "sure", "row", "x", "m"]]

    found = pool.mapInPandas(best, "learner int, view int, label int, sure double, row long, x array<float>, m array<int>")
    place = F.row_number().over(Window.partitionBy("learner", "view", "label").orderBy(F.desc("sure"), "row"))
    out: dict[tuple[int, int, int], list] = {}
    for r in found.withColumn("place", place).where(F.col("place") <= EACH).orderBy("learner", "view", "label", "place").collect():
        out.setdefault((r["learner"], r["view"], r["label"]), []).append((r["row"], r["x"], r["m"]))
    return out


def z_scores(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((x.astype(np.float64) - scale[0]) / scale[1], -6, 6)


def fit(docs: DataFrame, labels: DataFrame, columns: list[str], doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model from at most SAMPLE labelled documents, taken by a hash of their id, and all unlabelled ones; None without both
    classes. Of rows with one labelled id the first is read. Null texts count as empty, null metadata as a value."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    picked = own.orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE)
    seen = docs.select(F.col(doc_id).alias("id"), views(docs, columns, text).alias("v")).select("id", "v.*")
    seen = seen.join(labels.select(F.col(doc_id).alias("id")).where("id is not null").distinct().withColumn("labelled", F.lit(True)), "id", "left")
    every = staged(seen.withColumn("row", F.monotonically_increasing_id()), "quality-views")
    first = every.where("labelled").join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by(F.struct("x", "m"), "row").alias("v"))
    rows = first.select("id", "y", "v.*").orderBy("id", "y").toPandas()
    y = rows["y"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return None
    x = np.array([*rows["x"]], dtype=np.float64)
    width = BUCKETS * len(columns)
    hot = one_hot(np.array([*rows["m"]], dtype=int).reshape(len(rows), -1), width)
    scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = z_scores(x, scale)
    fold = np.array([zlib.crc32(str(i).encode()) % 2 for i in rows["id"]])
    parts = [fold != f if len(set(y[fold != f])) == 2 else np.ones(len(y), dtype=bool) for f in (0, 1)] + [np.ones(len(y), dtype=bool)]
    learners = [Learner(z[p], hot[p], y[p]) for p in parts]
    pool = every.where("labelled is null").select("row", "x", "m")
    for _ in range(ROUNDS):
        for (k, view, said), chosen in surest(pool, learners, scale, width).items():
            more = z_scores(np.array([c[1] for c in chosen], dtype=np.float64), scale)
            learners[k].teach(1 - view, float(said), [c[0] for c in chosen], more, one_hot(np.array([c[2] for c in chosen], dtype=int).reshape(len(chosen), -1), width))
        for one in learners:
            one.fit()
    out = np.zeros((len(rows), 2))
    for f in (0, 1):
        a, b = learners[f].weights
        out[fold == f] = np.stack([z[fold == f] @ a[:-1] + a[-1], hot[fold == f] @ b[:-1] + b[-1]], axis=1)
    steps = [(float(a[0]), b) for a, b in (logistic(out[:, [v]], y) for v in (0, 1))]
    calibrated = np.stack([a * out[:, v] + b for v, (a, b) in enumerate(steps)], axis=1)
    mix, offset = logistic(calibrated, y)
    return Model(columns, *scale, *learners[2].weights, steps, tuple(float(m) for m in mix), offset)


def with_quality(df: DataFrame, model: Model | None, threshold: float = 0.5, text: str = "text", out: tuple[str, str] = ("quality_score", "quality_kept")) -> DataFrame:
    """df with quality_score (0 to 1) and quality_kept (score >= threshold) of each row, under the names in out.

    Null texts count as empty, null metadata as a value; very long texts are read whole. Rows with equal text and metadata get
    equal scores, own columns of these two names give way, an empty table gives no rows, and without a model all rows get
    0.5 and are kept."""
    if model is None:
        scored = appended(df, F.struct(F.lit(0.5).alias(out[0])), [out[0]])
    else:

        @F.pandas_udf("quality_score double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for texts, *meta in batches:
                x = np.array([text_view(t) for t in strings(texts)]).reshape(len(texts), -1)
                pages = np.array([page_view(v, len(model.columns)) for v in zip(*meta)], dtype=int).reshape(len(texts), -1)
                yield pd.DataFrame({"quality_score": model.score(x, pages) if len(texts) else []})

        scored = appended(df, score(F.col(text), *page_values(df, model.columns)).cast(f"struct<`{out[0]}`:double>"), [out[0]])
    return appended(scored, F.struct((F.col(out[0]) >= threshold).alias(out[1])), [out[1]])
