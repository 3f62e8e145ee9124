"""SimHash near-duplicates: fingerprints of word shingles, linked where few bits differ.

Candidates come from an inverted index on the byte positions of the 64-bit fingerprints. With at most 4 differing bits at
least 4 of 8 bytes agree, so a pair shares the guaranteed minimum of 4 positional bytes. Posting lists of single bytes
would be a constant share of all rows; the index therefore lists triples of positions, 20 of them, chosen so that any 4
positions contain one. Within a list the shared positional bytes of each pair are tallied, pairs that reach the minimum are
retained, and those are verified by their differing bits. Equal fingerprints are one row from the start."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, strings
from tessera.llm.groups import cells, components, united

SEED = 42
#: Rows of one posting list that are compared in one task.
LIMIT = 2048


def triples() -> list[tuple[int, int, int]]:
    """Positions in three classes taken cyclically: all of one class, or two of one and one of the next. Any 4 of the 8 contain one."""
    kind = [0, 0, 0, 1, 1, 1, 2, 2]
    out = []
    for a in range(8):
        for b in range(a + 1, 8):
            for c in range(b + 1, 8):
                k = sorted((kind[a], kind[b], kind[c]))
                if k in ([0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 2], [0, 2, 2]):
                    out.append((a, b, c))
    return out


# By byte value: its bits as eight counters of one byte each, the highest bit first in memory.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]


def fingerprint(text: str, words_in_shingle: int = 4) -> int:
    """The signed 64-bit fingerprint of a whole text; A-Z are lower-cased, words are cut at ASCII white space, repeats count."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    k = min(words_in_shingle, n)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])], dtype=">u8")
    each = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, len(each), 255):
        counts += SPREAD[each[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(8, 8)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprint_column(text: Column, words_in_shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, words_in_shingle) for t in strings(batch)], dtype="int64")

    return of(text)


def meet(fps: np.ndarray, ids: np.ndarray, part: np.ndarray, bits: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a cell: (id, smallest id of its group here). Rows of one part meet only in the part's own cell."""
    same = len(np.unique(part)) == 1
    order = np.lexsort((ids, part))
    fps, ids, part = fps[order], ids[order], part[order]
    cut = len(ids) if same else int(np.searchsorted(part, part[-1]))
    a, b = (slice(0, len(ids)), slice(0, len(ids))) if same else (slice(0, cut), slice(cut, len(ids)))
    left, right = fps[a].view(np.uint8).reshape(-1, 8), fps[b].view(np.uint8).reshape(-1, 8)
    tally = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(8):
        tally += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(tally >= least)
    ok = np.bitwise_count(fps[a][i] ^ fps[b][j]) <= bits
    i, j = i[ok] + a.start, j[ok] + b.start
    if same:
        i, j = i[i < j], j[i < j]
    return [(int(x), int(low)) for x, low in zip(ids, united(ids, i, j)) if x != low]


def link(nodes: DataFrame, bits: int = 4, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between nodes (id, fp) with distinct fingerprints: they connect exactly what pairs with at most bits differing bits connect."""
    if not 0 <= bits <= 4:
        raise ValueError("the chosen triples find all pairs with at most 4 differing bits")
    least = 8 - bits
    keys = []
    for t, where in enumerate(triples()):
        byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
        keys.append(F.lit(t << 24) + byte(where[0]) * 65536 + byte(where[1]) * 256 + byte(where[2]))
    posted = nodes.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    lists = cells(posted, "key", "id", limit).groupBy("key", "cell_a", "cell_b").agg(F.collect_list(F.struct("fp", "id", "part")).alias("rows"))
    full = lists.where(F.size("rows") > 1).select(F.col("rows.fp").alias("fp"), F.col("rows.id").alias("id"), F.col("rows.part").alias("part"), (F.col("cell_a") != F.col("cell_b")).alias("across"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fp, ident, part, across in batch.itertuples(index=False):
                part = np.asarray(part)
                if not across or len(np.unique(part)) > 1:
                    out += meet(np.asarray(fp).astype(np.int64).view(np.uint64), np.asarray(ident).astype(np.int64), part, bits, least)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return full.mapInPandas(compare, "a long, b long")


def rooted(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """nodes (fp, ...) with distinct fingerprints, each with the smallest fingerprint that links reach as root. A fingerprint
    is a node of its own, whatever the ids of its rows: repeated and missing ids neither join nor part any."""
    roots = components(link(nodes.select(F.col("fp").alias("id"), "fp"), bits))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(df: DataFrame, bits: int = 4, words_in_shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row: the component is the smallest doc_id that links reach.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any other. Rows with a repeated
    doc_id keep their own fingerprints and components. Rows whose doc_id is null are linked but never name a component.
    Columns other than the two named aren't read, whatever their names. A very long text is hashed whole, in memory that grows
    with its length. An empty table gives no rows."""
    prints = staged(df.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint_column(F.col(text), words_in_shingle).alias("fp")), "fingerprints")
    named = staged(rooted(staged(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes"), bits), "roots")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, bits: int = 4, words_in_shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies one row of df: that with the smallest doc_id, a null one last; of those with one id the
    first by a hash of the text. The row is found again by a number of its own, so repeated and null ids do no harm."""
    hold = "_" + uuid.uuid4().hex[:8]
    rows = staged(df.withColumns({f"{hold}fp": fingerprint_column(F.col(text), words_in_shingle), f"{hold}row": F.monotonically_increasing_id()}), "numbered")
    first = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text), F.col(f"{hold}row").alias("row"))
    nodes = staged(rows.groupBy(F.col(f"{hold}fp").alias("fp")).agg(F.min(first).alias("best")), "nodes")
    kept = rooted(nodes, bits).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(f"{hold}row"))
    return rows.join(kept, f"{hold}row", "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
