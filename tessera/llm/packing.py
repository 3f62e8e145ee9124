"""Packing of documents into token sequences, in order, with cuts at document or sentence ends.

Windows are chosen by dynamic programming over the places where the stream of a partition's documents may be cut.
best(j) = penalty of cutting at j + WINDOW + the least of best(i) + padding of the window from i to j. Padding is the
capacity less the window's length, or nothing if that length is a power of two. For the first kind the least
best(i) + place(i) among the places within one capacity of j comes from a monotone queue; for the second the few places a
power of two before j are looked up. All documents of a stream are placed; one that is longer than a window spans several."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import strings
from tessera.llm.unit_tokens import CACHE_UNITS, units

#: Costs of a cut, in tokens of padding: at a document's end, at a sentence's end, elsewhere.
DOCUMENT_CUT, SENTENCE_CUT, OTHER_CUT = 0, 2, 24
#: Cost of each window, so that a full one is better than several of the lengths that need no padding.
WINDOW = 16
#: Inside sentences a cut is possible at every so many tokens.
STEP = 128
#: Ids that are packed at a time, so that a partition of any size needs bounded memory; a longer document is packed at once. A cut is
#: forced there, at a document's end: cutting the one window of the best cutting that spans it costs one more window's padding and
#: cost at most, fewer than 2,100 of 4 million.
STREAM_IDS = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_places(sizes: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places and penalties: document ends, sentence ends, and steps where these are far apart."""
    ends = np.cumsum(sizes)
    natural = np.unique(np.concatenate(([0], ends, sentence_ends)))
    gaps = np.diff(natural)
    more = (gaps - 1) // STEP
    far = np.flatnonzero(more)
    steps = np.repeat(natural[far], more[far]) + STEP * (np.arange(more[far].sum()) - np.repeat(np.cumsum(more[far]) - more[far], more[far]) + 1)
    places = np.unique(np.concatenate((natural, steps)))
    cost = np.full(len(places), OTHER_CUT, dtype=np.int64)
    cost[np.searchsorted(places, sentence_ends)] = SENTENCE_CUT
    cost[np.searchsorted(places, ends)] = DOCUMENT_CUT
    cost[0] = DOCUMENT_CUT
    return places, cost


def power_pairs(places: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """All pairs of places a power of two apart, up to the capacity, as two lists of their numbers in the order of the later
    one; a last entry of no place ends the first list."""
    number = np.full(int(places[-1]) + 1, -1, dtype=np.int32)
    number[places] = np.arange(len(places), dtype=np.int32)
    later, earlier = [], []
    for k in range(capacity.bit_length()):
        first = int(np.searchsorted(places, 1 << k))
        found = number[places[first:] - (1 << k)]
        met = np.flatnonzero(found >= 0)
        later.append(met + first)
        earlier.append(found[met])
    whole = np.concatenate(later)
    order = np.argsort(whole, kind="stable")
    return [*whole[order].tolist(), -1], np.concatenate(earlier)[order].tolist()


def windows(places: np.ndarray, cost: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The (begin, end) of each window of the cheapest cutting. Neighbouring places lie at most capacity apart."""
    at, penalty = places.tolist(), cost.tolist()
    n = len(at)
    best, back = [0] * n, [0] * n
    later, earlier = power_pairs(places, capacity)
    pair = 0
    queue: deque[int] = deque([0])
    key = [0] * n
    for j in range(1, n):
        p = at[j]
        least = p - capacity
        while at[queue[0]] < least:
            queue.popleft()
        source = queue[0]
        low = key[source] - least
        while later[pair] == j:
            i = earlier[pair]
            pair += 1
            if best[i] < low:
                low, source = best[i], i
        low += penalty[j] + WINDOW
        best[j], back[j] = low, source
        key[j] = k = low + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append((at[back[j]], at[j]))
        j = back[j]
    return out[::-1]


def sentence_ids(t) -> np.ndarray:
    """By id of a tokenizer: whether a token ends a sentence."""
    n = t.get_vocab_size()
    ends = np.zeros(n, dtype=bool)
    for i in range(n):
        said = t.decode([i], skip_special_tokens=False)
        ends[i] = said.rstrip("\"')]").endswith((".", "!", "?", "\n", "。"))
    return ends


_ENDS: dict[str, np.ndarray] = {}


def pack(df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", cached: int = CACHE_UNITS) -> DataFrame:
    """The pieces of all documents: which part of which document lies where in which sequence.

    Null texts count as empty and are the end id alone. Documents keep the order of their partition, so the table's own
    partitions are packed apart and no row moves; cached is how many units of text a worker keeps the ids of; sequence ids are the partition's number in the upper bits and a count
    from zero in the lower 40, the same however the result's partitions are merged later. Repeated rows are packed each; an empty table gives no pieces."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = units(tokenizer_path, cached)
        encode = own.encode
        if tokenizer_path not in _ENDS:
            _ENDS[tokenizer_path] = sentence_ids(own.tokenizer)
        is_end, end = _ENDS[tokenizer_path], np.array([end_id], "<u4").tobytes()
        sequence: int | None = None
        docs: list = []
        ids: list[bytes] = []
        held = 0

        def packed() -> pd.DataFrame:
            nonlocal sequence
            data = b"".join(ids)
            sizes = np.array([len(x) // 4 for x in ids])
            ends = np.cumsum(sizes)
            flags = is_end[np.frombuffer(data, "<u4")]
            places, cost = cut_places(sizes, np.flatnonzero(flags) + 1)
            cuts = np.array([b for _, b in windows(places, cost, capacity)])
            stops = np.union1d(cuts, ends)
            begins = np.concatenate(([0], stops[:-1]))
            of_doc, of_seq = np.searchsorted(ends, begins, side="right"), np.searchsorted(cuts, begins, side="right")
            first = np.concatenate(([0], cuts[:-1]))
            out = pd.DataFrame({
                "doc_id": pd.array([docs[i] for i in of_doc], dtype="Int64"), "start": begins - (ends - sizes)[of_doc], "length": stops - begins,
                "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist())],
                "doc_tokens": sizes[of_doc], "sequence_id": sequence + of_seq, "offset": begins - first[of_seq],
            })
            sequence += len(cuts)
            docs.clear()
            ids.clear()
            return out

        for batch in batches:
            if sequence is None and len(batch):
                sequence = int(batch["p"].iloc[0]) << 40
            for key, found in zip(batch["d"], encode(strings(batch["t"]))):
                docs.append(pd.NA if pd.isna(key) else int(key))
                ids.append(found + end)
                held += len(found) // 4 + 1
                if held >= STREAM_IDS:
                    held = 0
                    yield packed()
        if docs:
            yield packed()

    return df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.spark_partition_id().alias("p")).mapInPandas(pieces, PIECES)
