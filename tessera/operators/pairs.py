"""Statistics of pairs, of columns or of units, against shuffled rows, by products of matrices.

Rows are dealt to random blocks of bounded size by a hash of their key. A round shuffles rows inside each block, with a
generator seeded by round and block, so every round is a product of two matrices where the rows already are, and no round
moves a row. Shuffles inside random blocks form a group, which is all that a permutation test needs to be exact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.semantics import ratio
from tessera.operators.regional import bh
from tessera.operators.statistics import clean, partial

#: Rows of a block, on average.
ROWS = 2048
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def blocks(df: DataFrame, key: str, rows: int = ROWS, seed: int = 42) -> Column:
    """The block of each row: as many blocks as keep them at `rows` on average."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(max(1, round(df.count() / rows)))).cast("long")


def draw(round_no: int, block: int, n: int, seed: int = 42) -> np.ndarray:
    """The order of a block's rows in a round; round 0 is the one that they have."""
    return np.random.default_rng([seed, round_no, block]).permutation(n) if round_no else np.arange(n)


def whole_runs(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """The sorted rows again, one frame for each value."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if len(batch):
            last = batch[by].iloc[-1]
            done = batch[by] != last
            for _, part in batch[done].groupby(by, sort=False):
                yield part
            rest = batch[~done]
    if rest is not None and len(rest):
        yield rest


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(6, columns of x, columns of y): the sums of the pairs' complete rows."""
    kx, ky = (~np.isnan(a) for a in (x, y))
    x0, y0, kx, ky = np.where(kx, x, 0.0), np.where(ky, y, 0.0), kx.astype(float), ky.astype(float)
    return np.stack([kx.T @ ky, x0.T @ ky, kx.T @ y0, (x0 * x0).T @ ky, kx.T @ (y0 * y0), x0.T @ y0])


def r_of() -> Column:
    """Pearson's r from the sums; null at zero variance, told from rounding by the size of the squares."""
    c = F.col
    less = lambda a, x, y: c(a) - ratio(c(x) * c(y), "n")
    vx, vy = less("sxx", "sx", "sx"), less("syy", "sy", "sy")
    safe = (vx > 1e-12 * c("sxx")) & (vy > 1e-12 * c("syy"))
    return F.when(safe, ratio(less("sxy", "sx", "sy"), F.sqrt(vx * vy)))


def sweep_sums(df: DataFrame, key: str, xs: Sequence[str], ys: Sequence[str], rounds: int, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """(round, i, j, n, sx, sy, sxx, syy, sxy) of all pairs, round 0 as the rows are; all pairs and rounds leave a task as sums."""
    nx, ny = len(xs), len(ys)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rounds + 1, 6, nx, ny))
        for part in whole_runs(batches, "_block"):
            part = part.sort_values(["_h", "_k"], kind="stable")
            x, y, block = (part[[f"x{i}" for i in range(nx)]].to_numpy(float), part[[f"y{j}" for j in range(ny)]].to_numpy(float), int(part["_block"].iloc[0]))
            for k in range(rounds + 1):
                total[k] += products(x, y[draw(k, block, len(y), seed)])
        k, i, j = np.meshgrid(np.arange(rounds + 1), np.arange(nx), np.arange(ny), indexing="ij")
        yield pd.DataFrame({"round": k.ravel(), "i": i.ravel(), "j": j.ravel(), **{s: total[:, place].ravel() for place, s in enumerate(SUMS)}})

    given = df.select(F.xxhash64(key, F.lit(seed + 1)).alias("_h"), F.col(key).cast("string").alias("_k"), blocks(df, key, rows, seed).alias("_block"), *[clean(c).alias(f"x{i}") for i, c in enumerate(xs)], *[clean(c).alias(f"y{j}") for j, c in enumerate(ys)])
    sums = given.repartition("_block").sortWithinPartitions("_block").mapInPandas(task, "round int, i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return sums.groupBy("round", "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def named(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> list[Column]:
    return [F.array(*map(F.lit, xs))[F.col("i")].alias("x"), F.array(*map(F.lit, ys))[F.col("j")].alias("y")]


def adjusted(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Benjamini and Hochberg over all rows that have a p, of which there are as many as tests: a small table."""
    return bh(df.where(F.col(p).isNotNull()), p, out).unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def pair_sweep(df: DataFrame, key: str, xs: Sequence[str], ys: Sequence[str], control: str | None = None) -> DataFrame:
    """(x, y, n, r, partial_r): every x against every y on the rows complete for both; partial given the control, over the pairs' own
    correlations with it."""
    cx, cy = [*xs, *([control] if control else [])], [*ys, *([control] if control else [])]
    found = sweep_sums(df, key, cx, cy, 0).withColumn("r", r_of())
    own = found.where((F.col("i") < len(xs)) & (F.col("j") < len(ys))).select("i", "j", F.col("n").cast("long").alias("n"), "r")
    if control:
        xz = found.where((F.col("j") == len(ys)) & (F.col("i") < len(xs))).select("i", F.col("r").alias("xz"))
        yz = found.where((F.col("i") == len(xs)) & (F.col("j") < len(ys))).select("j", F.col("r").alias("yz"))
        own = own.join(xz, "i").join(yz, "j").withColumn("partial_r", partial("r", "xz", "yz"))
    return own.select(*named(own, xs, ys), "n", "r", *(["partial_r"] if control else []))


def pair_tests(df: DataFrame, key: str, xs: Sequence[str], ys: Sequence[str], rounds: int = 499, seed: int = 42, rows: int = ROWS) -> DataFrame:
    """(x, y, n, r, p, q): p two-sided, (rounds with as large an r or larger + 1) / (rounds + 1); q over all pairs at once.

    A round shuffles the rows of all ys together, so where values are missing a round's complete rows are its own."""
    r = sweep_sums(df, key, xs, ys, rounds, seed, rows).withColumn("r", r_of())
    seen = r.where("round = 0").select("i", "j", F.col("n").cast("long").alias("n"), F.col("r").alias("seen"))
    both = r.where("round > 0").select("i", "j", "r").join(seen, ["i", "j"])
    p = both.groupBy("i", "j", "n", F.col("seen").alias("r")).agg(((F.count_if(F.abs("r") >= F.abs("seen") - 1e-12) + 1) / (rounds + 1)).alias("p"))
    tests = p.withColumn("p", F.when(F.col("r").isNotNull(), F.col("p")))
    return adjusted(tests.select(*named(tests, xs, ys), "n", "r", "p"), "p")


def top_of_each(tests: DataFrame, by: str = "y", most: int = 3) -> DataFrame:
    """The strongest relations of each y, with their place."""
    from pyspark.sql import Window

    order = Window.partitionBy(by).orderBy(F.desc_nulls_last(F.round(F.abs("r"), 9)), "x")
    return tests.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def unit(a: np.ndarray) -> np.ndarray:
    """The rows by their lengths; zeros stay."""
    size = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(size > 0, size, 1)


def distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "cosine":
        return 1 - unit(a) @ unit(b).T
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def turned(x: np.ndarray, y: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rounds,): the sums of x and y's products, y's rows and columns in each round's orders, one of a round in each row."""
    return np.array([(x * y[np.ix_(p, q)]).sum() for p, q in zip(*orders)])


def turned_cosines(u1: np.ndarray, u2: np.ndarray, y: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The same for the cosine distances of u1 and u2, whose rows have length 1 or 0. These are 1 less products of few columns, so
    rather than y those columns are turned, all rounds side by side, and one product of matrices holds all rounds."""
    rounds, d = len(orders[0]), u1.shape[1]
    a1, a2 = (np.ascontiguousarray(u[np.argsort(p, axis=1)].transpose(1, 0, 2)).reshape(len(u), -1) for u, p in zip((u1, u2), orders))
    return y.sum() - (a1 * (y @ a2)).sum(axis=0).reshape(rounds, d).sum(axis=1)


def mantel(df: DataFrame, key: str, a: str, b: str, kinds: tuple[str, str] = ("cosine", "euclidean"), rounds: int = 199, seed: int = 42, rows: int = 512, together: int = 16) -> DataFrame:
    """(n_units, n_pairs, r, p): the correlation of two distances over all pairs of units, against units whose second vector is dealt
    anew; p is one-sided, for distances that rise together. a and b: columns of arrays. For tables of units.

    Blocks of units meet in cells of `together` blocks a side, each in one task, which goes through the pairs of blocks; a round
    applies its order of a block to whichever end of a pair the block is. Both distances' own sums are the same in every round,
    only the sum of products is new: for cosines by one product of matrices for all rounds. All pairs are compared, so the
    work grows with the square of the units; a task holds two sides of bounded size, and a unit goes to as many cells as there
    are sides. A unit with a null in either vector is left out."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    count = max(1, round(known.count() / rows))
    sides = -(-count // together)
    block = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(count)).cast("long")
    side = F.floor(F.col("_block") / together).cast("long")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(sides - 1)).cast("array<long>"), lambda o: F.struct(F.least(o, side).alias("low"), F.greatest(o, side).alias("high"))))
    units = known.select(F.col(key).cast("string").alias("_k"), F.xxhash64(key, F.lit(seed + 1)).alias("_h"), block.alias("_block"), F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))

    def cell(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        low, high = map(int, key)
        held = {}
        for k, own in part.sort_values(["_h", "_k"], kind="stable").groupby("_block"):
            vectors = [np.array(own[c].tolist(), float).reshape(len(own), -1) for c in ("a", "b")]
            held[int(k)] = (*vectors, np.stack([draw(i, int(k), len(own), seed) for i in range(rounds + 1)]))
        out = np.zeros((rounds + 1, len(SUMS)))
        for k1, (a1, b1, p1) in held.items():
            for k2, (a2, b2, p2) in held.items():
                if k1 // together != low or k2 // together != high or k1 > k2:
                    continue
                x, y = distances(a1, a2, kinds[0]), distances(b1, b2, kinds[1])
                if k1 == k2:  # each pair is there twice, and a unit with itself
                    np.fill_diagonal(x, 0.0)
                    np.fill_diagonal(y, 0.0)
                share = 0.5 if k1 == k2 else 1.0
                out[0, :5] += share * np.array([x.size - (len(x) if k1 == k2 else 0), x.sum(), y.sum(), (x * x).sum(), (y * y).sum()])
                if kinds[0] == "cosine":
                    out[:, 5] += share * turned_cosines(unit(a1), unit(a2), y, (p1, p2))
                else:
                    out[:, 5] += share * turned(x, y, (p1, p2))
        return pd.DataFrame(out, columns=list(SUMS)).assign(round=np.arange(rounds + 1))[["round", *SUMS]]

    schema = "round int, " + ", ".join(f"{s} double" for s in SUMS)
    dealt = units.withColumn("cell", cells).select("cell.low", "cell.high", "_k", "_h", "_block", "a", "b").repartition(min(2048, sides * (sides + 1) // 2), "low", "high")
    found = dealt.groupBy("low", "high").applyInPandas(cell, schema).groupBy("round").agg(*[F.sum(s).alias(s) for s in SUMS])
    seen = found.where("round = 0").select("n", "sx", "sy", "sxx", "syy", F.col("sxy").alias("seen"))
    both = found.select("round", "sxy").crossJoin(F.broadcast(seen))
    c = F.col
    tests = both.groupBy("n", "sx", "sy", "sxx", "syy", "seen").agg(((F.count_if((c("round") > 0) & (c("sxy") >= c("seen") - 1e-9 * F.abs("seen"))) + 1) / (rounds + 1)).alias("p")).withColumn("sxy", c("seen"))
    return tests.select(F.round((1 + F.sqrt(1 + 8 * c("n"))) / 2).cast("long").alias("n_units"), c("n").cast("long").alias("n_pairs"), r_of().alias("r"), "p")


def silhouettes(df: DataFrame, vector: str, labels: dict[int | str, str]) -> DataFrame:
    """(labelling, k, n, silhouette): the mean silhouette by squared Euclidean distance of several labellings of the same points.

    The mean squared distance from a point to a cluster is its own square, plus the cluster's mean square, less twice its
    product with the cluster's mean: so sums by cluster say it all, and all labellings share one pass over the points and one
    over the points with the few clusters' sums. A point alone in its cluster has 0; a labelling of one cluster is null. Rows
    without vector, and without a label in a labelling, are left out of it."""
    pairs = F.array(*[F.struct(F.lit(str(name)).alias("labelling"), F.col(c).cast("string").alias("label")) for name, c in labels.items()])
    points = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.explode(pairs).alias("l")).select("v", "l.labelling", "l.label").where("label IS NOT NULL")

    def part_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for own, rows in batch.groupby(["labelling", "label"], sort=False):
                m = np.array(rows["v"].tolist(), float).reshape(len(rows), -1)
                s = held.setdefault(own, [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + len(m), s[1] + (m * m).sum(), s[2] + m.sum(axis=0)
        yield pd.DataFrame([(*k, d, float(x), n, sq) for k, (n, sq, s) in held.items() for d, x in enumerate(s)], columns=["labelling", "label", "d", "s", "n", "sq"])

    sums = points.mapInPandas(part_sums, "labelling string, label string, d int, s double, n long, sq double").groupBy("labelling", "label", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("sq").alias("sq"))
    known: dict[str, dict[str, list]] = {}
    for r in sums.collect():  # clusters times dimensions
        c = known.setdefault(r["labelling"], {}).setdefault(r["label"], [0, 0.0, {}])
        c[0], c[1], c[2][r["d"]] = r["n"], r["sq"], r["s"]
    tables = {name: (list(cs), np.array([c[0] for c in cs.values()], float), np.array([c[1] for c in cs.values()]), np.array([[c[2][d] for d in sorted(c[2])] for c in cs.values()])) for name, cs in known.items()}

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, rows in batch.groupby("labelling", sort=False):
                names, n, sq, s = tables[name]
                m = np.array(rows["v"].tolist(), float).reshape(len(rows), -1)
                own = rows["label"].map({x: i for i, x in enumerate(names)}).to_numpy()
                total = (m * m).sum(1)[:, None] * n + sq - 2 * m @ s.T
                here = np.arange(len(m))
                a = total[here, own] / np.maximum(n[own] - 1, 1)
                mean = total / n
                mean[here, own] = np.inf
                b = mean.min(axis=1)
                top = np.maximum(a, b)
                score = np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0) if len(n) > 1 else np.full(len(m), np.nan)
                h = held.setdefault(name, [0, 0.0])
                h[0], h[1] = h[0] + len(m), h[1] + score.sum()
        yield pd.DataFrame([(k, n, s) for k, (n, s) in held.items()], columns=["labelling", "n", "s"])

    sizes = F.create_map(*[F.lit(x) for name, (names, *_) in tables.items() for x in (name, len(names))]) if tables else F.create_map().cast("map<string,int>")
    done = points.mapInPandas(scored, "labelling string, n long, s double").groupBy("labelling").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return done.select("labelling", sizes[F.col("labelling")].cast("long").alias("k"), "n", F.when(~F.isnan("s"), F.col("s") / F.col("n")).alias("silhouette"))
