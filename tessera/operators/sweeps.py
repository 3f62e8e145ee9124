"""Scores of many targets, blocks, samples and group effects, each sweep from the sums of one scan.

Targets are null in different rows. The scan keeps its sums of products by fold and by pattern: which targets a row has. A
target's complete rows are then a sum of patterns, so any number of targets shares the scan. A null feature is 0 in the sums
with a mark of its absence beside it: filled with a median it is the column plus median times mark, again weights over the
summed columns. So every fold fills with the median of its own training rows, and still no model needs another scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import quantiles
from tessera.operators.products import Cells, Weights, cross_products
from tessera.operators.scoring import chosen, r2_of, ridge
from tessera.operators.statistics import clean, uniform

FOLD, PATTERN = "_fold", "_pattern"


@dataclass(frozen=True)
class Panel:
    """Sums by (fold, pattern, ...) over the columns, the marks of those that have nulls, and the targets."""

    sums: Cells
    columns: dict[str, str]
    marks: dict[str, str]
    targets: dict[str, str]
    fills: dict[tuple, float]

    def cells(self, target: str, wanted: Callable[[tuple], bool] = lambda k: True) -> Cells:
        """By fold: the rows that have the target."""
        place, out = list(self.targets).index(target), {}
        for k, m in self.sums.sums.items():
            if k[1][place] == "1" and wanted(k):
                out[k[:1]] = out.get(k[:1], 0.0) + m
        return Cells(self.sums.columns, out)

    def design(self, target: str, fold, columns: Sequence[str], marked: bool = True) -> np.ndarray:
        """Weights of the columns as a model sees them that is tested on a fold: nulls filled, with their marks where wanted."""
        rows, marks = [], []
        for c in columns:
            w = self.sums.unit(self.columns[c])
            if c in self.marks:
                mark = self.sums.unit(self.marks[c])
                w = w + self.fills.get((c, target, fold), 0.0) * mark
                marks.append(mark)
            rows.append(w)
        return np.array([*rows, *(marks if marked else [])]).reshape(-1, len(self.sums.columns) + 1)


def panel(df: DataFrame, columns: Sequence[str], targets: Sequence[str], fold: str, extra: Sequence[str] = ()) -> Panel:
    """Rows without a fold are left out. The columns with nulls are found and their medians taken in two more scans, none if there are no nulls."""
    columns, targets = list(dict.fromkeys(columns)), list(targets)
    x, y, marks = ({c: f"_{kind}{i}" for i, c in enumerate(names)} for kind, names in (("x", columns), ("y", targets), ("m", columns)))
    pattern = F.concat(*[F.when(clean(t).isNull(), "0").otherwise("1") for t in targets])
    given = df.where(F.col(fold).isNotNull()).select(F.col(fold).alias(FOLD), pattern.alias(PATTERN), *extra, *[clean(c).alias(x[c]) for c in columns], *[clean(t).alias(y[t]) for t in targets])
    gaps = given.agg(*[F.count_if(F.col(v).isNull()).alias(v) for v in x.values()]).first()
    holes = [c for c in columns if gaps[x[c]]]
    marks = {c: marks[c] for c in holes}
    whole = given.withColumns({marks[c]: F.col(x[c]).isNull().cast("double") for c in holes}).na.fill(0.0, [*x.values(), *y.values()])
    sums = cross_products(whole, [*x.values(), *marks.values(), *y.values()], [FOLD, PATTERN, *extra])
    return Panel(sums, x, marks, y, medians(given, {c: x[c] for c in holes}, targets) if holes else {})


def medians(given: DataFrame, columns: dict[str, str], targets: Sequence[str]) -> dict[tuple, float]:
    """By (column, target, fold): the median over the rows of the other folds that have the target. Values are counted once and then stand in every distribution that they belong to."""
    folds = [r[0] for r in given.select(FOLD).distinct().collect()]
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(v).alias("v")) for c, v in columns.items()])
    counts = given.select(FOLD, PATTERN, F.explode(pairs).alias("p")).select(FOLD, PATTERN, "p.c", "p.v").where("v IS NOT NULL").groupBy(FOLD, PATTERN, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    places = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(targets) - 1)), lambda i: F.substring(F.col(PATTERN), i + 1, F.lit(1)) == "1"))
    others = F.explode(F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col(FOLD)))
    every = counts.withColumn("target", places).withColumn("without", others).groupBy("c", "target", "without", "v").agg(F.sum("n").alias("n"))
    found = quantiles(every, "v", [0.5], ["c", "target", "without"], "n")
    return {(r["c"], targets[r["target"]], r["without"]): r["q"][0] for r in found.collect()}


def fitted(p: Panel, target: str, cells: Cells, columns: Sequence[str], alphas: Sequence[float], base: dict[tuple, Weights] | None = None, marked: bool = True) -> dict[tuple, Weights]:
    """Out-of-fold weights of one model, on the target or on what a base model leaves of it."""
    out = {}
    for key in cells.sums:
        inside = lambda k, f=key[0]: k[0] != f
        x, goal = p.design(target, key[0], columns, marked), cells.unit(p.targets[target])
        left = goal - base[key] if base else goal
        w = ridge(cells.total(inside), x, left, chosen(cells, inside, x, left, alphas))
        out[key] = base[key] + w if base else w
    return out


def scope_sweep(df: DataFrame, baseline: Sequence[str], scopes: dict[str, Sequence[str]], targets: Sequence[str], fold: str, alphas: Sequence[float] = (0.0,), marked: bool = True) -> DataFrame:
    """(target, scope, n, r2_baseline, r2_full, lift): what each block adds to one unpenalised baseline, which all blocks of a target
    share. Each target is scored on the rows that have it; nulls in columns are filled inside the folds."""
    p = panel(df, [*baseline, *(c for cs in scopes.values() for c in cs)], targets, fold)
    rows = []
    for t in targets:
        cells, y = p.cells(t), p.targets[t]
        base = fitted(p, t, cells, baseline, (0.0,), marked=marked)
        n, low = r2_of(cells, y, base)
        for name, block in scopes.items():
            full = r2_of(cells, y, fitted(p, t, cells, block, alphas, base, marked))[1]
            rows.append((t, name, n, low, full, full - low if full is not None and low is not None else None))
    return df.sparkSession.createDataFrame(rows, "target string, scope string, n long, r2_baseline double, r2_full double, lift double")


@dataclass(frozen=True)
class Model:
    """A list of columns, and the model whose R2 less its own is what it lacks."""

    name: str
    columns: tuple[str, ...]
    reference: str | None = None
    family: str = "plain"
    withheld: str = ""


def drop_one_models(size: Sequence[str], blocks: dict[str, Sequence[str]], places: Sequence[str] = (), pairs: Sequence[tuple[str, ...]] = (), proxies: dict[str, tuple[str, Sequence[str]]] | None = None) -> list[Model]:
    """The intercept alone, size, blocks, both; both without each block, each of some sets of blocks, and without proxies:
    name -> (block, columns elsewhere that restate it). With places each drop-one model has a twin that knows them, compared with the full model that does."""
    every = tuple(c for b in blocks.values() for c in b)
    size, places = tuple(size), tuple(places)
    without = lambda cs, gone: tuple(c for c in cs if c not in set(gone))
    out = [Model("mean", ()), Model("size", size), Model("blocks", every), Model("full", size + every)]
    out += [Model(f"full_drop_{k}", size + without(every, b), "full", withheld=k) for k, b in blocks.items()]
    out += [Model(f"full_drop_{'_'.join(ks)}", size + without(every, [c for k in ks for c in blocks[k]]), "full", withheld=";".join(ks)) for ks in pairs]
    for name, (k, columns) in (proxies or {}).items():
        rest = without(every, columns)
        out += [Model(f"full_no_{name}", size + rest, "full"), Model(f"full_drop_{k}_no_{name}", size + without(rest, blocks[k]), f"full_no_{name}", withheld=k)]
    if places:
        out += [Model("size_places", size + places, family="places"), Model("full_places", size + places + every, family="places")]
        out += [Model(f"full_places_drop_{k}", size + places + without(every, b), "full_places", "places", k) for k, b in blocks.items()]
    return out


def drop_one(df: DataFrame, models: Sequence[Model], targets: Sequence[str], fold: str, alphas: Sequence[float] = (0.0,), restated: dict[str, Sequence[str]] | None = None, size: str = "size") -> DataFrame:
    """(target, model, family, withheld, n, n_predictors, r2, r2_ablated, lift_over_size, contribution, contribution_ablated) of every model.

    Ablated scores leave out the columns that restate a target (restated). A contribution is the reference's R2 less the
    model's own: what the withheld block was worth."""
    p = panel(df, [c for m in models for c in m.columns], targets, fold)
    rows = []
    for t in targets:
        cells, y, gone = p.cells(t), p.targets[t], set((restated or {}).get(t, ()))
        score = lambda columns: r2_of(cells, y, fitted(p, t, cells, columns, alphas))  # noqa: B023, E731
        plain = {m.name: score(m.columns) for m in models}
        less = {m.name: score([c for c in m.columns if c not in gone]) if gone & {*m.columns} else plain[m.name] for m in models}
        minus = lambda a, b: None if a is None or b is None else a - b
        for m in models:
            n, r2 = plain[m.name]
            ref = m.reference
            rows.append((t, m.name, m.family, m.withheld, n, len(m.columns), r2, less[m.name][1], minus(r2, plain[size][1]), minus(plain[ref][1], r2) if ref else None, minus(less[ref][1], less[m.name][1]) if ref else None))
    return df.sparkSession.createDataFrame(rows, "target string, model string, family string, withheld string, n long, n_predictors long, r2 double, r2_ablated double, lift_over_size double, contribution double, contribution_ablated double")


def twins(scores: DataFrame) -> DataFrame:
    """(withheld, n_targets, plain, places, share_left): each block's mean ablated contribution without and with the places known."""
    named = scores.where("withheld <> '' AND contribution_ablated IS NOT NULL")
    both = named.groupBy("withheld").agg(F.count_distinct("target").alias("n_targets"), *[F.avg(F.when(F.col("family") == f, F.col("contribution_ablated"))).alias(f) for f in ("plain", "places")])
    return both.where("places IS NOT NULL").withColumn("share_left", F.try_divide("places", "plain"))


def group_effects(df: DataFrame, models: dict[str, Sequence[str]], y: str, fold: str, group: str, alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """(model, n, n_groups, r2): out-of-fold R2 of models that also have an effect for each group, without a column for any.

    The effects are absorbed: in a fold's training rows the sums of products less each group's share, sum times sum by rows,
    are the products around the groups' means. The slopes follow from these, the effects from the slopes, and the error on the
    fold's rows from its own sums by group. The penalty is on the slopes alone, the columns standardised over all training
    rows; a group that a fold didn't train on has the mean effect. The driver holds one vector of sums a fold and group."""
    columns = list(dict.fromkeys(c for xs in models.values() for c in xs))
    names = {c: f"_x{i}" for i, c in enumerate(columns)} | {y: "_y"}
    rows = df.select(F.col(fold).alias(FOLD), F.col(group).alias("_g"), *[clean(c).alias(n) for c, n in names.items()]).na.drop()
    cells = cross_products(rows, list(names.values()), [FOLD])
    by_group: dict[tuple, np.ndarray] = {}
    for r in rows.groupBy(FOLD, "_g").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(n).alias(n) for n in names.values()]).collect():
        by_group[r[FOLD], r["_g"]] = np.array([r["n"], *[r[n] for n in names.values()]])
    groups = {g for _, g in by_group}
    out = []
    for name, xs in models.items():
        fits = {}
        for key in cells.sums:
            f = key[0]
            ix = [cells.at[names[c]] for c in xs]
            fits[f] = absorbed(cells, f, ix, cells.at["_y"], alphas, by_group)
        m = cells.total(lambda k: True)
        at = cells.at["_y"]
        spread = m[at, at] - m[0, at] ** 2 / m[0, 0]
        out.append((name, int(m[0, 0]), len(groups), float(1 - sum(fits.values()) / spread) if spread > 0 else None))
    return df.sparkSession.createDataFrame(out, "model string, n long, n_groups long, r2 double")


def totals(by_group: dict[tuple, np.ndarray], without: Sequence) -> dict:
    """Each group's sums over the other folds."""
    out: dict = {}
    for (f, g), s in by_group.items():
        if f not in without:
            out[g] = out.get(g, 0.0) + s
    return out


def absorbed(cells: Cells, fold, ix: list[int], iy: int, alphas: Sequence[float], by_group: dict[tuple, np.ndarray]) -> float:
    """The squared error on a fold's rows of slopes and group effects from the other folds'."""

    def slopes(without: Sequence, alpha: float) -> tuple[np.ndarray, dict, float]:
        m, sums = cells.total(lambda k: k[0] not in without), totals(by_group, without)
        s = np.array(list(sums.values()))
        within = m - (s / s[:, :1]).T @ s
        n, w = m[0, 0], np.zeros(len(m))
        sd = np.sqrt(np.maximum(np.diag(m)[ix] / n - (m[0, ix] / n) ** 2, 0))
        use = (sd > 1e-9 * np.maximum(1, np.abs(m[0, ix] / n))) & (np.diag(within)[ix] > 1e-12 * np.maximum(np.diag(m)[ix], 1e-300))
        if use.any():
            j = np.array(ix)[use]
            z = within[np.ix_(j, j)] / np.outer(sd[use], sd[use]) + alpha * np.eye(use.sum())
            w[j] = np.linalg.lstsq(z, within[j, iy] / sd[use], rcond=None)[0] / sd[use]
        left = -w
        left[iy] += 1
        effects = {g: float(v @ left) / v[0] for g, v in sums.items()}
        return left, effects, sum(effects[g] * v[0] for g, v in sums.items()) / n

    def loss(f, left: np.ndarray, effects: dict, mean: float) -> float:
        total = float(left @ cells.total(lambda k: k[0] == f) @ left)
        for (k, g), v in by_group.items():
            if k == f:
                a = effects.get(g, mean)
                total += a * a * v[0] - 2 * a * float(v @ left)
        return total

    best = alphas[0]
    if len(alphas) > 1:
        rest = [f for f in cells.folds if f != fold]

        def inner(alpha: float) -> float:
            return sum(loss(f, *slopes((fold, f), alpha)) for f in rest if len(rest) > 1)

        best = min(alphas, key=inner)
    return loss(fold, *slopes((fold,), best))


def sampled(df: DataFrame, key: str, shares: Sequence[float], rounds: int, seed: int = 42) -> DataFrame:
    """df once a round, with _round and _step: the place, from 0, of the smallest share whose sample has the row. A round's samples
    are nested, by a hash of key and round; a row is in none of them if even the largest leaves it out."""
    u = uniform(F.col(key), F.col("_round"), F.lit(seed))
    shares = sorted(shares)
    many = df.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return many.withColumn("_step", sum(((u >= float(s)).cast("int") for s in shares), F.lit(0))).where(F.col("_step") < len(shares))


def size_rounds(df: DataFrame, key: str, baseline: Sequence[str], full: Sequence[str], targets: Sequence[str], fold: str, shares: Sequence[float], rounds: int, alphas: Sequence[float] = (0.0,), seed: int = 42) -> DataFrame:
    """(target, share, round, n, r2_baseline, r2_full, lift): the models of samples of several sizes, drawn several times, all from one scan.

    A row is sent on once a round but moves nowhere: what is summed are the cells of round and step, and a sample is the sum
    of the steps up to its own. Nulls in columns are filled with the medians of each fold's training rows over the whole table."""
    names = [*baseline, *full]
    p = panel(sampled(df, key, shares, rounds, seed), names, targets, fold, ["_round", "_step"])
    rows = []
    for t in targets:
        for r in range(1, rounds + 1):
            for step, share in enumerate(sorted(shares)):
                cells, y = p.cells(t, lambda k: k[2] == r and k[3] <= step), p.targets[t]  # noqa: B023
                if len(cells.sums) < 2:
                    continue
                n, low = r2_of(cells, y, fitted(p, t, cells, baseline, (0.0,)))
                high = r2_of(cells, y, fitted(p, t, cells, full, alphas))[1]
                rows.append((t, float(share), r, n, low, high, high - low if high is not None and low is not None else None))
    return df.sparkSession.createDataFrame(rows, "target string, share double, round int, n long, r2_baseline double, r2_full double, lift double")


def grain_arms(fine: DataFrame, coarse: DataFrame, key: str, baseline: Sequence[str], full: Sequence[str], targets: Sequence[str], fold: str, rounds: int = 20, alphas: Sequence[float] = (0.0,), seed: int = 42) -> DataFrame:
    """(target, arm, n, lift, sd): the lift on all fine units, on the coarse ones, and on samples of as many fine units as there are
    coarse ones (their mean and deviation), so that what aggregation does is told from what fewer rows do."""
    n_fine, n_coarse = fine.count(), coarse.count()
    share = min(1.0, n_coarse / max(n_fine, 1))
    arms = [(name, scope_lifts(df, baseline, full, targets, fold, alphas)) for name, df in (("fine", fine), ("coarse", coarse))]
    rounds_df = size_rounds(fine, key, baseline, full, targets, fold, [share], rounds, alphas, seed)
    out = None
    for name, df in arms:
        df = df.select("target", F.lit(name).alias("arm"), F.col("n").cast("double").alias("n"), "lift", F.lit(0.0).alias("sd"))
        out = df if out is None else out.unionByName(df)
    means = rounds_df.groupBy("target").agg(F.lit("fine_sample").alias("arm"), F.avg("n").alias("n"), F.avg("lift").alias("lift"), F.coalesce(F.stddev_samp("lift"), F.lit(0.0)).alias("sd"))
    return out.unionByName(means.select("target", "arm", "n", "lift", "sd"))


def scope_lifts(df: DataFrame, baseline: Sequence[str], full: Sequence[str], targets: Sequence[str], fold: str, alphas: Sequence[float]) -> DataFrame:
    """(target, n, lift) of one joint model on all columns over the baseline."""
    p, rows = panel(df, [*baseline, *full], targets, fold), []
    for t in targets:
        cells, y = p.cells(t), p.targets[t]
        n, low = r2_of(cells, y, fitted(p, t, cells, baseline, (0.0,)))
        high = r2_of(cells, y, fitted(p, t, cells, full, alphas))[1]
        rows.append((t, n, high - low if high is not None and low is not None else None))
    return df.sparkSession.createDataFrame(rows, "target string, n long, lift double")


def arm_report(df: DataFrame, targets: Sequence[str], arms: dict[str, Sequence[str]], baselines: dict[str, Sequence[str]], folds: dict[str, str], tier: str | None = None, alphas: Sequence[float] = (0.0,), recovered: str | None = None) -> DataFrame:
    """(folds, target, baseline, arm, tier, n, r2_baseline, r2_full, lift) of every arm on every baseline, for each way to deal folds, over
    all rows (tier null) and scored inside each tier; one scan for each way.

    Arms are blocks of columns, such as a block, its parts and its tiers' own copies; baselines such as size, size with its curve,
    size with places. Random folds beside folds of whole groups show what transfers to groups that were never seen. With
    `recovered`, rows of that target without a baseline ('') say how well each arm tells it by itself, as size can be
    recovered from a block that should be free of it."""
    goals = [*targets, *([recovered] if recovered and recovered not in targets else [])]
    columns = [c for block in [*arms.values(), *baselines.values()] for c in block]
    rows: list[tuple] = []

    def score(p: Panel, how: str, t: str, baseline: str, arm: str, cells: Cells, by_tier: dict, base: dict | None, fits: dict[tuple, Weights]) -> None:
        y = p.targets[t]
        for level, own in [(None, cells), *sorted(by_tier.items(), key=lambda x: str(x[0]))]:
            n, full = r2_of(own, y, fits)
            low = r2_of(own, y, base)[1] if base else 0.0
            rows.append((how, t, baseline, arm, None if level is None else str(level), n, low, full, full - low if full is not None and low is not None else None))

    for how, fold in folds.items():
        p = panel(df.where(F.col(tier).isNotNull()) if tier else df, columns, goals, fold, [tier] if tier else [])
        levels = sorted({k[2] for k in p.sums.sums}) if tier else []
        for t in goals:
            cells = p.cells(t)
            by_tier = {level: p.cells(t, lambda k, level=level: k[2] == level) for level in levels}
            if t == recovered:
                for arm, block in arms.items():
                    score(p, how, t, "", arm, cells, by_tier, None, fitted(p, t, cells, block, alphas))
            if t in targets:
                for baseline, controls in baselines.items():
                    base = fitted(p, t, cells, controls, (0.0,))
                    for arm, block in arms.items():
                        score(p, how, t, baseline, arm, cells, by_tier, base, fitted(p, t, cells, block, alphas, base))
    return df.sparkSession.createDataFrame(rows, "folds string, target string, baseline string, arm string, tier string, n long, r2_baseline double, r2_full double, lift double")


def leave_one_out(df: DataFrame, blocks: dict[str, Sequence[str]], controls: Sequence[str], targets: dict[str, Sequence[str]], fold: str, alphas: Sequence[float] = (0.0,)) -> DataFrame:
    """(block, target, n, r2_baseline, r2_full, lift): each block's own columns as targets, told by all other blocks on top of the controls.

    targets: by block the columns of it that are predicted; the block they belong to is left out of the design, so what is
    scored is the signal that the others carry about it. All targets share one scan."""
    goals = [c for cs in targets.values() for c in cs]
    p = panel(df, [*controls, *(c for cs in blocks.values() for c in cs)], goals, fold)
    rows = []
    for name, own in targets.items():
        others = [c for block, cs in blocks.items() if block != name for c in cs]
        for t in own:
            cells, y = p.cells(t), p.targets[t]
            base = fitted(p, t, cells, controls, (0.0,))
            n, low = r2_of(cells, y, base)
            full = r2_of(cells, y, fitted(p, t, cells, others, alphas, base))[1]
            rows.append((name, t, n, low, full, full - low if full is not None and low is not None else None))
    return df.sparkSession.createDataFrame(rows, "block string, target string, n long, r2_baseline double, r2_full double, lift double")
