"""Quarantine and cascading release: turns arrive, faulty ones fail until they are repaired, and each waits for its parent.

The time at which a turn is delivered is a piecewise function of the time at which its parent is. Conversations are cut into
blocks of consecutive turns; within a block the forest of parents is decomposed into heavy paths with a segment tree of
composed functions each, light edges are followed top-down, and a sweep down the trees gives every prefix of every path. A
parent is at most REACH turns back, so all that a later block needs of an earlier one is the delivery of its last turns, as
functions of the deliveries before it: these summaries compose, and a scan over them, in groups of FAN, starts every block."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, staged

#: Seconds between arrivals, waits before attempts 2 to 4 counted from the first, and how far back a parent may be.
GAP, WAITS, REACH = 7, (0, 20, 60, 140), 6
#: Turns in a block, and blocks (or buckets of rows) that one step of a scan takes together.
BLOCK, FAN = 256, 64
#: The delivery of what is never delivered.
DEAD = 1 << 60
#: (starts, slopes, values): from each start on, slope * time + value, or DEAD.
Pieces = tuple[list[int], list[int], list[int]]
ROW = "conv long, block long, p long, turn long, crc long, copies long, back int, wait int, good int"


def at(f: Pieces, t: int) -> int:
    if t >= DEAD:
        return DEAD
    i = bisect_right(f[0], t) - 1
    return f[1][i] * t + f[2][i]


def delivery(arrival: int, wait: int, good: int) -> Pieces:
    """The delivery of a turn by its parent's. wait: seconds until its repair, below 0 if it is not faulty; good: bit a is set if attempt a (from 0) may deliver."""
    if wait < 0:
        return [0, arrival], [0, 1], [arrival, 0]
    steps = [(arrival + wait - WAITS[a], WAITS[a]) for a in (3, 2, 1, 0) if good >> a & 1]
    own = next((w for s, w in reversed(steps) if s <= arrival), None)
    later = [(s, w) for s, w in steps if s > arrival]
    first = [(arrival, own)] if own is not None else []
    starts = [0, *[s for s, _ in first + later]]
    return starts, [0] + [1] * (len(starts) - 1), [DEAD if own is None else arrival + own, *[w for _, w in first + later]]


def then(f: Pieces, g: Pieces) -> Pieces:
    """g after f."""
    starts, slopes, values = [], [], []

    def add(start: int, slope: int, value: int) -> None:
        if not starts or (slopes[-1], values[-1]) != (slope, value):
            starts.append(start)
            slopes.append(slope)
            values.append(value)

    for i, (start, slope, value) in enumerate(zip(*f)):
        if not slope:
            add(start, 0, at(g, value))
            continue
        end = f[0][i + 1] if i + 1 < len(f[0]) else DEAD
        j = bisect_right(g[0], start + value) - 1
        while j < len(g[0]) and (begin := max(start, g[0][j] - value)) < end:
            add(begin, g[1][j], g[2][j] + value if g[1][j] else g[2][j])
            j += 1
    return starts, slopes, values


class Path:
    """A segment tree of composed functions over the turns of a heavy path."""

    def __init__(self, functions: list[Pieces]):
        self.levels = [functions]
        while len(below := self.levels[-1]) > 1:
            self.levels.append([then(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])

    def inputs(self, t: int) -> list[int]:
        """What each turn of the path waits for, if the first waits for t: a sweep from the root of the tree to its leaves."""
        now = [t]
        for level in reversed(self.levels[:-1]):
            now = [at(level[i - 1], now[i >> 1]) if i & 1 else now[i >> 1] for i in range(len(level))]
        return now

    def prefix(self, n: int) -> Pieces:
        """The first n turns as one function."""
        out, start = None, 0
        for k in range(len(self.levels) - 1, -1, -1):
            if n - start >= 1 << k and start >> k < len(self.levels[k]):
                f = self.levels[k][start >> k]
                out, start = f if out is None else then(out, f), start + (1 << k)
        return out


class Forest:
    """The turns of one block, in order; parents before the block are entries, numbered by how far back of it they are."""

    def __init__(self, positions: list[int], backs: list[int], waits: list[int], goods: list[int]):
        first, n = positions[0], len(positions)
        self.parent = [p - b - first if b and b <= p else None for p, b in zip(positions, backs)]
        functions = [delivery(GAP * p, w, g) for p, w, g in zip(positions, waits, goods)]
        size, heavy = [1] * n, [-1] * n
        for i in range(n - 1, -1, -1):
            if (up := self.parent[i]) is not None and up >= 0:
                size[up] += size[i]
        for i in range(n):
            if (up := self.parent[i]) is not None and up >= 0 and (heavy[up] < 0 or size[i] > size[heavy[up]]):
                heavy[up] = i
        self.path_of, self.paths = [(0, 0)] * n, []
        for i in range(n):
            up = self.parent[i]
            if up is None or up < 0 or heavy[up] != i:
                members = [i]
                while heavy[members[-1]] >= 0:
                    members.append(heavy[members[-1]])
                for k, j in enumerate(members):
                    self.path_of[j] = len(self.paths), k
                self.paths.append((members, Path([functions[j] for j in members])))

    def waits_for(self, before: list[int]) -> list[int]:
        """The delivery of each turn's parent, 0 where it has none; before: the deliveries of the turns before the block, the nearest first. A path's head comes after its parent, so paths in order of their heads go top-down."""
        n = len(self.parent)
        waits, done = [0] * n, [0] * n
        for members, path in self.paths:
            up = self.parent[members[0]]
            t = 0 if up is None else done[up] if up >= 0 else before[-up - 1]
            for j, x, f in zip(members, path.inputs(t), path.levels[0]):
                waits[j], done[j] = x, at(f, x)
        return waits

    def exits(self) -> list[list[int]]:
        """For each of the last turns, the nearest to the end first: its entry (-1: none) and the pieces of its delivery as a function of that entry's."""
        out = []
        for i in range(len(self.parent) - 1, max(-1, len(self.parent) - 1 - REACH), -1):
            f, entry = None, i
            while entry is not None and entry >= 0:
                k, at_k = self.path_of[entry]
                members, path = self.paths[k]
                own = path.prefix(at_k + 1)
                f, entry = own if f is None else then(own, f), self.parent[members[0]]
            out.append(packed(-1 if entry is None else -entry - 1, f))
        return out


def packed(entry: int, f: Pieces) -> list[int]:
    if entry < 0:
        f = [0], [0], [at(f, 0)]
    return [entry, *(x for piece in zip(*f) for x in piece)]


def unpacked(x: list[int]) -> tuple[int, Pieces]:
    return x[0], (list(x[1::3]), list(x[2::3]), list(x[3::3]))


def joined(first: list[list[int]], second: list[list[int]]) -> list[list[int]]:
    """The summary of two neighbouring runs of turns, the second of at least REACH turns."""
    out = []
    for entry, f in map(unpacked, second):
        if entry >= 0:
            entry, before = unpacked(first[entry])
            f = then(before, f)
        out.append(packed(entry, f))
    return out


def moved(before: list[int], summary: list[list[int]]) -> list[int]:
    """The deliveries of a run's last turns, given those before it."""
    return [at(f, 0 if entry < 0 else before[entry]) for entry, f in map(unpacked, summary)]


def whole_blocks(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The sorted rows again, cut so that no run of equal keys is torn; runs are of BLOCK rows at most."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if now.num_rows:
            last = [now[k][-1].as_py() for k in keys]
            cut = now.num_rows
            while cut and [now[k][cut - 1].as_py() for k in keys] == last:
                cut -= 1
            if cut:
                yield now.slice(0, cut)
            rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def runs(columns: list[list]) -> Iterator[tuple[int, int]]:
    start, n = 0, len(columns[0])
    for i in range(1, n + 1):
        if i == n or any(c[i] != c[start] for c in columns):
            yield start, i
            start = i


def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_blocks(batches, ["conv", "block"]):
        c = t.to_pydict()
        rows = [(c["conv"][a], c["block"][a], Forest(*(c[k][a:b] for k in ("p", "back", "wait", "good"))).exits()) for a, b in runs([c["conv"], c["block"]]) if b - a == BLOCK]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int64())))], ["conv", "block", "exits"])


def outcomes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_blocks(batches, ["conv", "block"]):
        c = t.to_pydict()
        status, attempts, first_at, last_at = [], [], [], []
        for a, b in runs([c["conv"], c["block"]]):
            forest = Forest(*(c[k][a:b] for k in ("p", "back", "wait", "good")))
            for p, wait, good, t0 in zip(c["p"][a:b], c["wait"][a:b], c["good"][a:b], forest.waits_for(c["before"][a] or [])):
                if t0 >= DEAD:
                    status.append("blocked")
                    attempts.append(0)
                    first_at.append(None)
                    last_at.append(None)
                    continue
                x, n = max(GAP * p, t0), 0
                if wait >= 0:
                    n = next((k for k in range(4) if good >> k & 1 and x + WAITS[k] >= GAP * p + wait), 4)
                status.append("dead" if n == 4 else "delivered")
                attempts.append(min(n, 3) + 1)
                first_at.append(x)
                last_at.append(x + WAITS[min(n, 3)])
        arrays = [t["conv"].combine_chunks(), t["turn"].combine_chunks(), t["crc"].combine_chunks(), t["copies"].combine_chunks(), pa.array(status, pa.string()), pa.array(attempts, pa.int32()), pa.array(first_at, pa.int64()), pa.array(last_at, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "turn", "crc", "copies", "status", "attempts", "first_at", "last_at"])


def up_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The summaries of a group of blocks as one."""
    rows, out = rows.sort_values("block"), None
    for exits in rows["exits"]:
        exits = [list(x) for x in exits]
        out = exits if out is None else joined(out, exits)
    return pd.DataFrame({"conv": [key[0]], "block": [key[1]], "exits": [out]})


def down_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What lies before each block of a group, and before the one after it, given what lies before the group."""
    rows = rows.sort_values("block")
    now, starts, ends = rows["before"].iloc[0], [], 0
    now = None if now is None else list(now)
    for block, exits in zip(rows["block"], rows["exits"]):
        starts.append(now if now is not None else [0] * REACH)
        now, ends = moved(now or [0] * REACH, [list(x) for x in exits]), int(block) + 1
    blocks = [*map(int, rows["block"]), ends]  # the block after the last full one has no summary of its own
    return pd.DataFrame({"conv": [key[0]] * len(blocks), "block": blocks, "before": [*starts, now]})


def block_starts(blocks: DataFrame, most: int) -> DataFrame:
    """(conv, block, before): the deliveries before each block but a conversation's first. most: the highest position of all."""
    level = blocks.where(F.col("full")).drop("full").repartition("conv", "block").sortWithinPartitions("conv", "block", "p").mapInArrow(summarise, "conv long, block long, exits array<array<long>>")
    levels, high = [level], most // BLOCK
    while high >= FAN:
        level = level.groupBy("conv", F.expr(f"block div {FAN}").alias("up")).applyInPandas(up_one, "conv long, block long, exits array<array<long>>")
        levels.append(level)
        high //= FAN
    before = None
    for level in reversed(levels):
        level = level.withColumn("up", F.expr(f"block div {FAN}"))
        level = level.withColumn("before", F.lit(None).cast("array<long>")) if before is None else level.join(before.withColumnRenamed("block", "up"), ["conv", "up"], "left")
        before = level.groupBy("conv", "up").applyInPandas(down_one, "conv long, block long, before array<long>").dropDuplicates(["conv", "block"])
    return before


def bases(buckets: DataFrame, low: int, high: int) -> DataFrame:
    """(conv, bucket, n0, s0, w0): what lies before each bucket of a group, for buckets (conv, bucket, n, s, w) numbered within
    low..high. n: rows; s: their sum of values; w: their sum of value by place in the bucket. Buckets go up in groups of FAN, so
    no task holds all of a large group's."""
    up = Window.partitionBy("conv", "up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(up), F.lit(0)).cast("decimal(38,0)")
    top = high - low < FAN
    named = buckets.withColumn("up", F.lit(0).cast("long") if top else F.floor(F.col("bucket") / FAN))
    known = named.withColumns({"n0": so_far("n"), "s0": so_far("s")}).withColumn("w1", (F.col("w") + F.col("n0") * F.col("s")).cast("decimal(38,0)")).withColumn("w0", so_far("w1"))
    if top:
        return known.select("conv", "bucket", "n0", "s0", "w0")
    total = known.groupBy("conv", F.col("up").alias("bucket")).agg(F.sum("n").cast("decimal(38,0)").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("w1").cast("decimal(38,0)").alias("w"))
    above = bases(total, low // FAN, high // FAN).toDF("conv", "up", "n2", "s2", "w2")
    both = known.join(above, ["conv", "up"])
    return both.select("conv", "bucket", (F.col("n0") + F.col("n2")).cast("decimal(38,0)").alias("n0"), (F.col("s0") + F.col("s2")).cast("decimal(38,0)").alias("s0"), (F.col("w2") + F.col("w0") + F.col("n2") * F.col("s0")).cast("decimal(38,0)").alias("w0"))


def draw(k: int) -> Column:
    return F.crc32(F.concat(F.lit(f"{k}:"), F.col("conv").cast("string"), F.lit(":"), F.col("turn").cast("string")))


def replay(turns: DataFrame, group: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, turn, status, attempts, first_at, last_at, release_no, state): the replay of each turn, one row for each row of turns.

    Rows of the same group and order are one turn, whose text is that of the smallest crc32; each gets the turn's result. A
    row without group or order is in no conversation: its other columns are null. A null text is empty; long texts are read
    whole, by crc32. state is kept modulo 2^64. Other columns of turns don't matter, whatever their names; an empty table
    gives no rows."""
    rows = turns.select(F.col(f"`{group}`").cast("long").alias("conv"), F.col(f"`{order}`").cast("long").alias("turn"), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("crc"))
    known = rows.where("conv IS NOT NULL AND turn IS NOT NULL").groupBy("conv", "turn").agg(F.min("crc").alias("crc"), F.count(F.lit(1)).alias("copies"))
    known = staged(known, "turns")
    low, high = known.agg(F.coalesce(F.min("turn"), F.lit(0)), F.coalesce(F.max("turn"), F.lit(0))).first()
    bucket = F.floor(F.col("turn") / BLOCK)
    own = known.withColumn("bucket", bucket)
    zero = F.lit(0).cast("decimal(38,0)")
    before = bases(own.groupBy("conv", "bucket").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n")).withColumns({"s": zero, "w": zero}), low // BLOCK, high // BLOCK)
    place = F.row_number().over(Window.partitionBy("conv", "bucket").orderBy("turn")) - 1
    placed = own.withColumn("place", place).join(before, ["conv", "bucket"]).withColumn("p", (F.col("n0") + F.col("place")).cast("long"))

    faulty = draw(1) % 101 < 20
    good = sum((F.when(draw(a + 3) % 3 != 0, 1 << a).otherwise(0) for a in range(1, 4)), F.when(draw(3) % 3 != 0, 1).otherwise(0))
    turns_at = placed.select("conv", F.expr(f"p div {BLOCK}").alias("block"), "p", "turn", "crc", "copies", (draw(0) % (REACH + 1)).cast("int").alias("back"), F.when(faulty, draw(2) % 101).otherwise(-1).cast("int").alias("wait"), good.cast("int").alias("good"))
    turns_at = staged(turns_at, "placed")
    most = turns_at.agg(F.coalesce(F.max("p"), F.lit(0))).first()[0]
    if most >= BLOCK:
        size = F.count(F.lit(1)).over(Window.partitionBy("conv", "block"))
        starts = block_starts(turns_at.withColumn("full", size == BLOCK), most)
        ready = turns_at.join(starts, ["conv", "block"], "left")
    else:
        ready = turns_at.withColumn("before", F.lit(None).cast("array<long>"))
    ready = ready.repartition("conv", "block").sortWithinPartitions("conv", "block", "p")
    done = staged(ready.mapInArrow(outcomes, "conv long, turn long, crc long, copies long, status string, attempts int, first_at long, last_at long"), "outcomes")
    discard(known, turns_at)

    released = done.where("status = 'delivered'").withColumn("bucket", F.floor(F.col("last_at") / (BLOCK * GAP)))
    inside = Window.partitionBy("conv", "bucket").orderBy("last_at", "turn")
    values = released.withColumn("i", F.row_number().over(inside)).withColumn("crc", F.col("crc").cast("decimal(38,0)"))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumns({"s": F.sum("crc").over(running).cast("decimal(38,0)"), "w": F.sum((F.col("crc") * F.col("i")).cast("decimal(38,0)")).over(running).cast("decimal(38,0)")})
    totals = values.groupBy("conv", "bucket").agg(F.max("i").cast("decimal(38,0)").alias("n"), F.max("s").alias("s"), F.max("w").alias("w"))
    last = done.agg(F.coalesce(F.max("last_at"), F.lit(0))).first()[0] // (BLOCK * GAP)
    numbered = values.join(bases(totals, 0, last), ["conv", "bucket"])
    state = (F.col("w0") + F.col("n0") * F.col("s") + F.col("w")).cast("decimal(38,0)")
    half, full = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    wrapped = (((state + half).cast("decimal(38,0)") % full) - half).cast("long")
    numbered = numbered.select("conv", "turn", "status", "attempts", "first_at", "last_at", "copies", (F.col("n0") + F.col("i")).cast("long").alias("release_no"), wrapped.alias("state"))
    others = done.where("status <> 'delivered'").select("conv", "turn", "status", "attempts", "first_at", "last_at", "copies", F.lit(None).cast("long").alias("release_no"), F.lit(None).cast("long").alias("state"))
    names = ["conv", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    some = 1 << 16
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {some}")), lambda k: F.least(F.lit(some).cast("long"), F.col("copies") - k * some))
    everyone = numbered.unionByName(others).withColumn("part", F.explode(parts)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part")))).select(*names)
    lost = rows.where("conv IS NULL OR turn IS NULL").select("conv", "turn", *[F.lit(None).cast(kind).alias(n) for n, kind in zip(names[2:], ("string", "int", "long", "long", "long", "long"))])
    return everyone.unionByName(lost).toDF("conv_id", "turn", *names[2:])
