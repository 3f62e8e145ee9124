"""Ids of the tokenizers library for whole texts, through a cache of the ids of short units.

The byte-level pre-tokenizer always begins a new word at a single space or line feed between other characters, and at a
comma or full stop between a letter and white space. In texts where no such character has a neighbour that could change
this, the parts cut there can be encoded apart. Parts repeat: the library encodes each once while it stays in the cache.
All other texts go to the library whole."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space side by side; other white space than these two, among which may be what Python and the library class differently or what marks cuts here.
PAIRS = ("  ", "\n ", " \n", "\n\n")
OTHER = re.compile(r"[^\S \n]")
HARD = re.compile(r"\s\s|[\x1c-\x1f]")
#: Commas and stops beside other marks, which one word of the pre-tokenizer may hold together.
MARKS = re.compile(r"[,.](?<=[\W_][,.])|[,.](?=[^\w\s]|_)")
#: Cached units in a worker, about 200 bytes each; all are dropped beyond it.
CACHE_UNITS = 800_000
LONGEST_CACHED = 64
#: Characters of text that are cut into units at a time.
AT_ONCE = 2_000_000
#: Units joined by line feeds in one call of the library; units with white space inside or at their end are left out.
JOINED = 200
PLAIN = re.compile(r" ?\S+")
CUT = "\x1f"


class Rows:
    """Arrays of different lengths, one after another in a single one, by number."""

    def __init__(self):
        self.flat, self.begin, self.size = np.empty(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.count = self.used = 0

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, need in (("flat", self.used + len(flat)), ("begin", self.count + len(sizes)), ("size", self.count + len(sizes))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate((old, np.empty(max(need - len(old), len(old)), old.dtype))))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.count : self.count + len(sizes)] = sizes
        self.begin[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(flat), self.count + len(sizes)

    def cut(self, count: int) -> None:
        """Forget all arrays from this number on."""
        if count < self.count:
            self.used, self.count = int(self.begin[count]), count

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers joined, and the end of each."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        shift = np.repeat(self.begin[numbers] - (ends - sizes), sizes)
        shift += np.arange(len(shift))
        return self.flat[shift], ends


class Units:
    def __init__(self, path: str, special: bool = True, most: int = CACHE_UNITS):
        """special: the strings of special tokens inside texts are those tokens, as is the library's default. most: cached units."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = not special
        self.most = most
        [self.line_feed] = self.whole("\n")
        self.forget()

    def forget(self) -> None:
        self.number, self.ids = {"": 0}, Rows()
        self.ids.append(np.empty(0, "<u4"), np.array([0]))

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, missing: list[str]) -> None:
        plain = [u for u in missing if PLAIN.fullmatch(u)]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        known = set()
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(found.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.line_feed)
            if len(cuts) == len(group) - 1:
                self.number.update(zip(group, range(self.ids.count, self.ids.count + len(group))))
                self.ids.append(np.delete(ids, cuts), np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
                known.update(group)
        for u in missing:
            if u not in known:
                self.number[u] = self.ids.count
                ids = self.whole(u)
                self.ids.append(ids, np.array([len(ids)]))

    def numbers(self, units: pa.Array) -> np.ndarray:
        """The number of each unit in the cache; its library is asked for those that aren't there yet."""
        coded = units.dictionary_encode()
        texts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [u for u in texts if u not in self.number]
        self.learn([u for u in missing if len(u) <= LONGEST_CACHED])
        self.learn([u for u in missing if len(u) > LONGEST_CACHED])
        return np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))[coded.indices.to_numpy()]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            marked = [marked_units(t) for t in texts[start:end]]
            known = iter(self.cut_texts([m for m in marked if m is not None]))
            for text, m in zip(texts[start:end], marked):
                yield (self.whole(text) if m is None else next(known)).tobytes()
            start = end

    def cut_texts(self, marked: list[str]) -> Iterator[np.ndarray]:
        if not marked:
            return
        if self.ids.count > self.most:
            self.forget()
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), CUT)
        short = self.ids.count
        numbers = self.numbers(lists.flatten())
        ids, ends = self.ids.joined(numbers)
        edges = ends[lists.offsets.to_numpy()[1:] - 1].tolist()
        self.drop_long(short)
        yield from (ids[a:b] for a, b in zip([0, *edges], edges))

    def drop_long(self, since: int) -> None:
        """Forget the long units, which the last batch appended behind its short ones."""
        late = [(u, k) for u, k in itertools.islice(reversed(self.number.items()), self.ids.count - since)]
        long = [(u, k) for u, k in late if len(u) > LONGEST_CACHED]
        for u, _ in long:
            del self.number[u]
        if long:
            self.ids.cut(min(k for _, k in long))


def marked_units(text: str) -> str | None:
    """The text with marks where units that can be encoded apart meet, or None if it must be encoded whole."""
    if any(p in text for p in PAIRS) or OTHER.search(text) and HARD.search(text):
        return None
    marked = text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f")
    return marked if MARKS.search(text) else marked.replace(",", "\x1f,").replace(".", "\x1f.")


def units(path: str, most: int = CACHE_UNITS) -> Units:
    return kept(("units", path, most), lambda: Units(path, most=most))
