"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign, that
it comes closest to. A table's bucket is made of HASHES such hashes. Each vector is listed under its own bucket and, by
multiprobe, under those where one of its hashes gives way to the runner-up. Vectors that share a bucket are candidates,
and their cosine is verified in double precision. Equal vectors are one row from the start."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.groups import cells, components, united

#: Tables, hashes that make a bucket, and rows of a bucket that are compared in one task.
TABLES, HASHES, LIMIT = 6, 2, 1024
SEED = 20_240_501


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, by butterflies; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x


def signs(d: int, seed: int) -> np.ndarray:
    return np.where(np.random.default_rng(seed).integers(0, 2, (TABLES, HASHES, 3, d)) == 1, 1.0, -1.0)


def buckets(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(rows, TABLES, 1 + HASHES) bucket numbers: the own one, then those with one hash replaced by its runner-up."""
    n, width = x.shape
    d = 1 << max(0, width - 1).bit_length()
    full = np.zeros((n, d))
    full[:, :width] = x
    flips = signs(d, seed)
    out = np.empty((n, TABLES, 1 + HASHES), dtype=np.int64)
    row = np.arange(n)
    for t in range(TABLES):
        first, second = [], []
        for h in range(HASHES):
            y = full
            for r in range(3):
                y = hadamard(y * flips[t, h, r])
            size = np.abs(y)
            a = size.argmax(axis=1)
            first.append(2 * a + (y[row, a] < 0))
            size[row, a] = -1
            b = size.argmax(axis=1)
            second.append(2 * b + (y[row, b] < 0))
        for k in range(1 + HASHES):
            code = np.zeros(n, dtype=np.int64)
            for h in range(HASHES):
                code = code * (2 * d) + (second[h] if k == h + 1 else first[h])
            out[:, t, k] = code
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


#: Linked pairs of a cell whose codes are compared at once.
SLICE = 1 << 15


def first_met(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether each pair is counted here: in the first table where the two share a bucket, and there in the smallest bucket they share."""
    out = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), SLICE):
        a, b = codes[i[at : at + SLICE]], codes[j[at : at + SLICE]]
        met = a[:, :, :, None] == b[:, :, None, :]
        tables = met.any(axis=(2, 3))
        shared = np.where(met[:, table].any(axis=2), a[:, table], np.iinfo(a.dtype).max).min(axis=1)
        out[at : at + SLICE] = (tables.argmax(axis=1) == table) & (shared == bucket)
    return out


def verify(table: int, bucket: int, ids: np.ndarray, sizes: np.ndarray, vecs: np.ndarray, codes: np.ndarray, part: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(id, vectors that it is linked with by pairs first met here, smallest id of its group by those pairs) for the rows of
    a cell: the groups' (id, smallest) rows are a spanning forest of the cell's links."""
    same = len(np.unique(part)) == 1
    order = np.lexsort((ids, part))
    ids, sizes, vecs, codes, part = ids[order], sizes[order], vecs[order], codes[order], part[order]
    cut = 0 if same else int(np.searchsorted(part, part[-1]))
    i, j = np.nonzero((vecs @ vecs.T if same else vecs[:cut] @ vecs[cut:].T) >= least - 1e-9)
    j = j + cut
    if same:
        i, j = i[i < j], j[i < j]
    sure = np.concatenate([np.einsum("ij,ij->i", vecs[i[at : at + SLICE]], vecs[j[at : at + SLICE]]) >= least for at in range(0, len(i), SLICE)]) if len(i) else np.zeros(0, dtype=bool)
    i, j = i[sure], j[sure]
    mine = first_met(codes, i, j, table, bucket)
    i, j = i[mine], j[mine]
    n, low = np.zeros(len(ids), dtype=np.int64), united(ids, i, j)
    np.add.at(n, i, sizes[j])
    np.add.at(n, j, sizes[i])
    return [(int(ids[k]), int(n[k]), int(low[k])) for k in np.flatnonzero(n)]


def packed(codes: np.ndarray) -> list[bytes]:
    """Each row's bucket numbers, in four bytes each if they all fit."""
    codes = codes.reshape(len(codes), -1)
    return [c.tobytes() for c in codes.astype("<i4" if codes.size and codes.max() < 1 << 31 else "<i8")]


def unpacked(codes: list[bytes]) -> np.ndarray:
    n = TABLES * (1 + HASHES)
    return np.stack([np.frombuffer(c, "<i4" if len(c) == 4 * n else "<i8").astype(np.int64) for c in codes]).reshape(len(codes), TABLES, 1 + HASHES)


def near_duplicates(df: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", limit: int = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Only rows with equal labels are compared. Rows whose label is null and vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of different lengths neither. Equal vectors with one label are one
    node with a number of its own and link with each other, so rows with a repeated vec_id keep their own links and
    components; rows whose vec_id is null link with nothing. An empty table gives no rows."""
    wide = "double" if df.schema[vector].dataType.simpleString() != "array<float>" else "float"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast(f"array<{wide}>").alias("v"))
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(~bad & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    copies = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = staged(copies.withColumn("id", F.monotonically_increasing_id()), "vector-classes")

    @F.pandas_udf("numbers array<long>, codes binary")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, codes = np.empty(len(batch), dtype=object), np.empty(len(batch), dtype=object)
            lengths = batch.map(len).to_numpy()
            for d in np.unique(lengths):
                where = np.flatnonzero(lengths == d)
                found = buckets(unit(np.stack(batch.iloc[where].to_list()).astype(np.float64))).reshape(len(where), -1)
                for at, row, short in zip(where, found, packed(found)):
                    numbers[at], codes[at] = row, short
            yield pd.DataFrame({"numbers": numbers, "codes": codes})

    coded = classes.withColumn("h", hashed("v")).select("id", "copies", "v", "label", "h.*")
    entries = F.transform(F.sequence(F.lit(0), F.lit(TABLES * (1 + HASHES) - 1)), lambda k: F.struct(F.floor(k / (1 + HASHES)).cast("int").alias("table"), F.get("numbers", k).alias("bucket")))
    listed = coded.select("id", "copies", "v", "codes", F.xxhash64("label", F.size("v")).alias("of"), F.explode(F.array_distinct(entries)).alias("e"))
    listed = listed.select("id", "copies", "v", "codes", "of", "e.table", "e.bucket").withColumn("key", F.xxhash64("of", "table", "bucket"))
    met = cells(listed, "key", "id", limit).groupBy("key", "of", "table", "bucket", "cell_a", "cell_b").agg(F.collect_list(F.struct("id", "copies", "v", "codes", "part")).alias("rows"))
    full = met.where(F.size("rows") > 1).select("table", "bucket", (F.col("cell_a") != F.col("cell_b")).alias("across"), *[F.col(f"rows.{c}").alias(c) for c in ("id", "copies", "v", "codes", "part")])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for b in batch.itertuples(index=False):
                part = np.asarray(b.part)
                if not b.across or len(np.unique(part)) > 1:
                    vecs = unit(np.stack(list(b.v)).astype(np.float64))
                    out += verify(b.table, b.bucket, np.asarray(b.id), np.asarray(b.copies), vecs, unpacked(list(b.codes)), part, least)
            yield pd.DataFrame(out, columns=["id", "n", "low"], dtype="int64")

    found = staged(full.mapInPandas(compare, "id long, n long, low long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = classes.join(counts, "id", "left").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    named = staged(named.select("label", "v", "root", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-roots")
    least_ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = rows.where("ok").join(named.drop("least_id").join(least_ids, "root"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
