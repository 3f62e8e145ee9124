"""Alignment of the tokens of two tokenizers by their bytes, and how often two ids lie on the same bytes corpus-wide.

Both tokenizations cut the same bytes, so the places where either ends a token cut a text into stretches, each within one
token of either side: a stretch is a link. Documents are aligned in batches with numpy. A batch's postings, (B id, A id,
document, how often), are dealt by B id to SIDES sides and by batch to parts, so that a frequent id's are spread over many
groups of bounded size. Counts come first, summed in each task before they are shuffled; then each part of a side is
cogrouped with that side's counts, in streams that Spark sorts and spills, adds up its documents' contributions, and these
are summed by document."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept, staged, strings
from tessera.llm.unit_tokens import Rows, Units

SPACE = "▁"
SIDES = 16
#: Characters of a batch of documents (a longer one is a batch alone), and batches in a part of a side.
AT_ONCE, PART = 1_500_000, 64
#: Bits of an id and of a document's place in its batch in the keys that are sorted.
ID, PLACE = 20, 19
#: Words that a worker keeps the ids of, on either side; longer ones are encoded anew each time.
CACHE_WORDS = 400_000
LONGEST_CACHED = 64
BATCHES = "batch long, side int, docs binary, codes binary, runs binary, places binary, times binary"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links"]


class Bytes:
    """The bytes of each id of a vocabulary."""

    def __init__(self, found: list[bytes]):
        self.rows = Rows()
        self.rows.flat = np.empty(1 << 16, np.uint8)
        self.rows.append(np.frombuffer(b"".join(found), np.uint8), np.array([len(x) for x in found]))

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.rows.joined(ids)[0]

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.rows.size[ids]


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces:
    """Ids of a sentencepiece BPE model for whole texts, through a cache of the ids of words.

    No piece holds a space behind another character, so no merge crosses the place before a single space: the words that
    begin there can be encoded apart. Texts with spaces side by side or at an end go to the library whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(n)]
        self.apart = not any(SPACE in p.lstrip(SPACE) for p, s in zip(pieces, special) if not s)
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if s else p.replace(SPACE, " ").encode() for i, (p, s) in enumerate(zip(pieces, special))])
        self.forget()

    def forget(self) -> None:
        self.number, self.ids = {}, Rows()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.apart and "  " not in t and SPACE not in t and not t.startswith(" ") and not t.endswith(" ") and t != "" for t in texts]
        out = [None if p else np.asarray(self.model.encode(t), "<u4") for t, p in zip(texts, plain)]
        if any(plain):
            if self.ids.count > CACHE_WORDS:
                self.forget()
            lists = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            words, kept = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.ids.count
            missing = sorted((w for w in words if w not in self.number), key=len)
            found = self.model.encode(missing, num_threads=1)
            self.number.update(zip(missing, range(kept, kept + len(missing))))
            self.ids.append(np.fromiter((i for x in found for i in x), "<u4"), np.fromiter(map(len, found), np.int32, len(found)))
            numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
            ids, ends = self.ids.joined(numbers)
            edges = ends[lists.offsets.to_numpy()[1:] - 1].tolist()
            own = iter([ids[a:b] for a, b in zip([0, *edges], edges)])
            out = [next(own) if x is None else x for x in out]
            long = [w for w in missing if len(w) > LONGEST_CACHED]  # the longest come last
            for w in long:
                del self.number[w]
            self.ids.cut(kept + len(missing) - len(long))
        return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Units(a_path, special=False, most=CACHE_WORDS), Pieces(b_path)
        table, t = byte_level(), self.a.tokenizer
        self.bytes = Bytes([bytes(table[c] for c in t.id_to_token(i) or "" if c in table) for i in range(t.get_vocab_size())])

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A and B ids of all texts, and where each text's end in them and in the bytes; texts that either side doesn't give back have none."""
        full = [" " + t if t else "" for t in texts]
        a = [np.frombuffer(x, "<u4") for x in self.a.encode(full)]
        b = [x if t else x[:0] for x, t in zip(self.b.encode(texts), texts)]
        data = [t.encode() for t in full]
        joined = np.frombuffer(b"".join(data), np.uint8)
        if not all(np.array_equal(own.of(np.concatenate(ids)), joined) for own, ids in ((self.bytes, a), (self.b.bytes, b))):
            for i, d in enumerate(data):
                raw = np.frombuffer(d, np.uint8)
                if not (np.array_equal(self.bytes.of(a[i]), raw) and np.array_equal(self.b.bytes.of(b[i]), raw)):
                    a[i], b[i], data[i] = a[i][:0], b[i][:0], b""
        ends = [np.cumsum([len(x) for x in xs], dtype=np.int64) for xs in (a, b, data)]
        return np.concatenate(a), np.concatenate(b), *ends

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray]:
        """Counts by text, the groups of each as text, and the sorted keys of all links: side, B id, A id, text's place."""
        a, b, a_ends, b_ends, byte_ends = self.tokens(texts)
        at = np.zeros(int(byte_ends[-1]) + 1, np.uint8)
        at[np.cumsum(self.bytes.sizes(a), dtype=np.int64)] = 1
        at[np.cumsum(self.b.bytes.sizes(b), dtype=np.int64)] |= 2
        places = np.flatnonzero(at)
        flags = at[places]
        ends_a, ends_b, both = flags & 1 != 0, flags & 2 != 0, flags == 3
        link_ends = np.searchsorted(places, byte_ends, side="right")
        groups = np.cumsum(both, dtype=np.int64)
        group_ends = np.concatenate(([0], groups))[link_ends]
        counts = {"n_a": np.diff(a_ends, prepend=0), "n_b": np.diff(b_ends, prepend=0), "n_groups": np.diff(group_ends, prepend=0), "n_links": np.diff(link_ends, prepend=0)}
        said = rendered(a, b, (groups - both)[ends_a], (groups - both)[ends_b], both[ends_a], both[ends_b], a_ends + b_ends)
        own_a, own_b = a[np.cumsum(ends_a, dtype=np.int64) - ends_a].astype(np.int64), b[np.cumsum(ends_b, dtype=np.int64) - ends_b].astype(np.int64)
        text = np.repeat(np.arange(len(texts)), counts["n_links"])
        keys = (((own_b % SIDES << ID | own_b) << ID | own_a) << PLACE) | text
        keys.sort()
        return counts, said, keys


def rendered(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, ends: np.ndarray) -> list[str]:
    """The groups of each text, `a1,a2|b1;a3|b2,b3`; ends: of the texts, in tokens of both sides."""
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    before_a = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=n))))
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=n))))
    ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    place = np.arange(len(a)) + before_b[group_a]
    ids[place], marks[place] = a, np.where(last_a, ord("|"), ord(","))
    place = np.arange(len(b)) + before_a[group_b + 1]
    ids[place], marks[place] = b, np.where(last_b, ord(";"), ord(","))
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
    stops = np.cumsum(digits + 1)
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    out[stops - 1] = marks
    rest, where = ids, stops - 2
    while len(rest):
        out[where] = 48 + rest % 10
        more = np.flatnonzero(rest >= 10)
        rest, where = rest[more] // 10, where[more] - 1
    data, edges = out.tobytes().decode("ascii"), np.concatenate(([0], stops))[np.concatenate(([0], ends))].tolist()
    return [data[x : y - 1] if y > x else "" for x, y in zip(edges, edges[1:])]


def aligner(a_path: str, b_path: str) -> Aligner:
    return kept(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def by_size(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > AT_ONCE or i - start >= 1 << PLACE):
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def postings(keys: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """By side: the different pairs (B id, A id), how many documents hold each, these documents' places and how often they hold it."""
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    times, keys = np.diff(first, append=len(keys)), keys[first]
    sides = keys >> (2 * ID + PLACE)
    edges = np.searchsorted(sides, np.arange(SIDES + 1))
    for side in range(SIDES):
        x, y = edges[side], edges[side + 1]
        if y > x:
            codes = keys[x:y] >> PLACE & (1 << 2 * ID) - 1
            new = np.flatnonzero(np.diff(codes, prepend=-1))
            yield side, codes[new].astype("<i8").tobytes(), np.diff(new, append=y - x).astype("<i4").tobytes(), (keys[x:y] & (1 << PLACE) - 1).astype("<i4").tobytes(), times[x:y].astype("<i4").tobytes()


def arrays(row, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(getattr(row, n), "<i8" if n == "codes" else "<i4") for n in names]


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return found, total


def batch_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(code, n) of a task's postings, added up as long as few enough are held."""
    codes, counts, held = [], [], 0
    for batch in batches:
        for row in batch.itertuples(index=False):
            code, runs, times = arrays(row, "codes", "runs", "times")
            if len(code):
                codes.append(code)
                counts.append(np.add.reduceat(times.astype(np.int64), np.cumsum(runs) - runs))
                held += len(code)
            if held > 2_000_000:
                code, count = summed(codes, counts)
                codes, counts, held = [code], [count], len(code)
                if held > 1_000_000:
                    yield pd.DataFrame({"code": code, "n": count})
                    codes, counts, held = [], [], 0
    if codes:
        code, count = summed(codes, counts)
        yield pd.DataFrame({"code": code, "n": count})


def contributions(key, posts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """By batch: what its documents get from this side, as arrays by place."""
    counts = counts.sort_values("code")
    known, n, best = counts["code"].to_numpy(), counts["n"].to_numpy(), counts["best"].to_numpy()
    rows = []
    for row in posts.itertuples(index=False):
        codes, runs, places, times = arrays(row, "codes", "runs", "places", "times")
        own = np.searchsorted(known, codes)
        size = int(places.max()) + 1
        n_best, count_sum = np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(n_best, places, np.repeat(best[own], runs) * times)
        np.add.at(count_sum, places, np.repeat(n[own], runs) * times)
        rows.append((row.batch, n_best.tobytes(), count_sum.tobytes()))
    return pd.DataFrame(rows, columns=["batch", "n_best", "count_sum"])


def documents(key, docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    out = pa.ipc.open_stream(docs["docs"].iloc[0]).read_pandas()
    for name in ("n_best", "count_sum"):
        total = np.zeros(len(out), np.int64)
        for x in sums[name]:
            part = np.frombuffer(x, np.int64)
            total[: len(part)] += part
        out[name] = total
    return out


def stored(docs: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(docs, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def align(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, with groups also their text) and pairs (a, b, n, best).

    A encodes a space and the text, B the text, to which it adds the space. Null and empty texts, and those that a tokenizer
    doesn't give back byte by byte, have zeros and ''. Each row counts, repeated rows and ids too; a pair that shares its B
    id's highest count is best, ties included. A very long text is a batch of its own and takes memory by its length, some
    hundred bytes a character. An empty table gives none; other columns don't matter, whatever their names."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for frame in frames:
            texts, ids = strings(frame["t"]), pd.array([None if pd.isna(x) else int(x) for x in frame["d"]], dtype="Int64")
            for start, end in by_size(texts):
                counts, said, keys = own.align(texts[start:end])
                docs = pd.DataFrame({"doc_id": ids[start:end], **{c: counts[c] for c in COLUMNS}, "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]})
                if groups:
                    docs["groups"] = said
                rows = [(number, -1, stored(docs), b"", b"", b"", b""), *[(number, side, b"", *found) for side, *found in postings(keys)]]
                number += 1
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BATCHES.split(", ")])

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    table = staged(rows.mapInPandas(batches, BATCHES), "aligned")
    posts = table.where("side >= 0")
    parts = math.ceil(table.where("side < 0").count() / PART) or 1
    total = posts.select("codes", "runs", "times").mapInPandas(batch_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    total = staged(total.withColumn("b", F.shiftright("code", ID)), "pair-counts")
    pairs = total.join(total.groupBy("b").agg(F.max("n").alias("most")), "b").select("code", F.expr(f"code & {(1 << ID) - 1}").alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))
    of_part = F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int")
    ranked = pairs.select((F.col("b") % SIDES).cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "code", "n", "best")
    sides = posts.select("batch", "side", of_part.alias("part"), "codes", "runs", "places", "times")
    sums = sides.groupBy("side", "part").cogroup(ranked.groupBy("side", "part")).applyInPandas(contributions, "batch long, n_best binary, count_sum binary")
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COLUMNS], "groups_sha256 string", *["groups string"] * groups, "n_best long", "count_sum long"])
    found = table.where("side < 0").select("batch", "docs").groupBy("batch").cogroup(sums.groupBy("batch")).applyInPandas(documents, schema)
    names = ["doc_id", *COLUMNS, "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    return found.select(*names), pairs.select("a", "b", "n", "best")
