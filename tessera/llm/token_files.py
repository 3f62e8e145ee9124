"""Token files: blocks of ids in byte-aligned variable-length coding, in ascending document order.

A block holds the ids of some neighbouring documents. Its ids are replaced by their frequency rank in the block (the
most frequent is 0; ties by id), so that most take one byte. Control bytes, two bits an id, stand apart from the data
bytes and give each id's length of 1 to 4 bytes. Decoding reads four lengths from each control byte by table and gathers
the data with numpy. Blocks are rows of a Parquet table, so Spark's committer makes writing safe against lost tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged, strings
from tessera.llm.unit_tokens import units

#: Ids after which a block is closed; a document is never split between blocks.
BLOCK_IDS = 1 << 18
#: Lengths of the four ids that each control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BLOCKS = "file_no int, first_id long, n_null int, doc_ids binary, doc_tokens binary, n_ids long, ranked binary, control binary, data binary"


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The ids by frequency rank, the control bytes and the data bytes."""
    ids = np.asarray(ids, dtype=np.uint32)
    if not len(ids):
        return b"", b"", b""
    if int(ids.max()) < 1 << 20:
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        ranked = distinct[np.lexsort((distinct, -counts[distinct]))].astype("<u4")
        place = np.empty(len(counts), dtype=np.uint32)
        place[ranked] = np.arange(len(ranked), dtype=np.uint32)
        codes = place[ids]
    else:
        distinct, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, -counts))
        ranked = distinct[order].astype("<u4")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        codes = place[where]
    steps = [np.flatnonzero(codes > limit) for limit in (0xFF, 0xFFFF, 0xFFFFFF) if len(ranked) > limit + 1]
    extra = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    for longer in steps:
        extra[longer] += 1
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    lengths = extra[: len(codes)] + np.uint8(1)
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    data = np.empty(int(ends[-1]), dtype=np.uint8)
    data[starts] = codes.astype(np.uint8)
    for k, longer in enumerate(steps, 1):
        data[starts[longer] + k] = (codes[longer] >> np.uint32(8 * k)).astype(np.uint8)
    return ranked.tobytes(), control.tobytes(), data.tobytes()


def unpack(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The n ids that pack() stored."""
    if not n:
        return np.empty(0, dtype="<u4")
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    codes = raw[starts].astype(np.uint32)
    for k in range(1, int(lengths.max())):
        longer = np.flatnonzero(lengths > k)
        codes[longer] |= raw[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[codes]


def write(df: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", path: str | None = None, ranges: int | None = None) -> DataFrame:
    """The blocks of all documents, written to path and read back as a table; files follow one another by file_no, ids inside by
    first_id. Without a path they lie in the shared folder until the driver ends.

    Null texts count as empty; each document ends with end_id. Rows are dealt by ranges of doc_id (repeated ids stay
    together in one file, null ids come first) and sorted inside. A very long text is a block of its own length. Columns other
    than the two named aren't read. An empty table gives no blocks. ranges: how many files, by default one for each partition
    of the input, so that a file has about what a task reads."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, file_no, first = units(tokenizer_path).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        ids: list[bytes] = []
        docs: list[int | None] = []
        sizes: list[int] = []

        def block() -> pd.DataFrame:
            nonlocal first
            joined = np.frombuffer(b"".join(ids), "<u4")
            known = [d for d in docs if d is not None]  # null ids lead
            row = (file_no, first, len(docs) - len(known), np.array(known, "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), len(joined), *pack(joined))
            first += len(joined)
            for x in (ids, docs, sizes):
                x.clear()
            return pd.DataFrame([row], columns=[f.split()[0] for f in BLOCKS.split(", ")])

        held = 0
        for batch in batches:
            for key, found in zip(batch["d"], encode(strings(batch["t"]))):
                ids.append(found + end)
                docs.append(None if pd.isna(key) else int(key))
                sizes.append(len(found) // 4 + 1)
                held += sizes[-1]
                if held >= BLOCK_IDS:
                    held = 0
                    yield block()
        if docs:
            yield block()

    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    ranges = ranges or max(1, rows.rdd.getNumPartitions())
    found = rows.repartitionByRange(ranges, "d").sortWithinPartitions(F.col("d").asc_nulls_first()).mapInPandas(blocks, BLOCKS)
    if path is None:
        return staged(found, "token-files")
    found.write.parquet(path)
    return df.sparkSession.read.schema(found.schema).parquet(path)


def read(files: DataFrame, fields: str, of) -> DataFrame:
    """of(doc_id, ids) for each document of the files, with doc_id, start (ids of all documents before it) and n_tokens.

    A file's place follows from the sizes of the files before it: one row a file is summed and broadcast, never one a document."""
    from pyspark.sql import Window

    sizes = files.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    base = sizes.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("base"))
    names = [x.split()[0] for x in fields.split(",")]

    def docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = unpack(b.n_ids, b.ranked, b.control, b.data)
                keys, n = [*[None] * b.n_null, *np.frombuffer(b.doc_ids, "<i8").tolist()], np.frombuffer(b.doc_tokens, "<i8")
                ends = np.cumsum(n)
                out = pd.DataFrame({"doc_id": pd.array(keys, dtype="Int64"), "start": b.base + b.first_id + ends - n, "n_tokens": n})
                found = [of(k, ids[e - c : e]) for k, e, c in zip(keys, ends, n)]
                for i, name in enumerate(names):
                    out[name] = [x[i] for x in found]
                yield out

    placed = files.join(F.broadcast(base), "file_no")
    schema = f"doc_id long, start long, n_tokens long, {fields}"
    return placed.mapInPandas(docs, schema)


def checksums(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids, as read back from the files."""
    return read(files, "ids_crc32 long", lambda _, ids: (zlib.crc32(ids.astype("<u4").tobytes()),))
