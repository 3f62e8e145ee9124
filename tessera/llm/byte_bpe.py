"""Byte-level BPE over a local rank file: encoding of whole texts and decoding to raw bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, per_text

#: Texts longer than this are encoded in pieces of about this many characters.
PIECE_CHARS = 32_768
#: A match of the split pattern always begins here: a space between two characters that aren't white space, or a letter followed by a digit.
SAFE = regex.compile(r"(?<=[^\s])(?= [^\s])|(?<=\p{L})(?=\p{N})")


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """text cut at safe boundaries, each piece the first of at least limit characters that can be cut; joined they are the text."""
    out, at = [], 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def encode(text: str, enc: tiktoken.Encoding, limit: int = PIECE_CHARS) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, limit) for i in enc.encode_ordinary(p)]


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    """The raw bytes of the ids, whether or not they are valid UTF-8."""
    return enc.decode_bytes(ids)


def with_token_ids(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with an array of token ids. Null and empty texts give an empty array; long texts are encoded whole, piece by piece."""

    def make():
        enc = encoder(ranks_path, pattern)
        return lambda t: (encode(t, enc),)

    return appended(df, per_text(make, f"{out} array<int>", [out])(F.col(text)), [out])


def with_text_bytes(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", out: str = "text_bytes") -> DataFrame:
    """df with the bytes that an array of ids stands for; null ids give empty bytes."""

    @F.pandas_udf("binary")
    def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(ranks_path, pattern)
        for b in batches:
            yield b.map(lambda x: enc.decode_bytes([int(i) for i in x]) if x is not None else b"")

    return df.withColumn(out, unpack(F.col(ids)))


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of each row's whole text, by encode() and decode().

    Null and empty texts have no ids, and the digests of nothing. Very long texts are encoded in parts that meet where a match
    of the pattern must begin, and decoded whole. Repeated rows are encoded each, alike; own columns of these three names give
    way, others stay; an empty table gives no rows."""

    def make():
        enc = encoder(ranks_path, pattern)
        word = [str(i) for i in range(enc.max_token_value + 1)]

        def one(t: str) -> tuple:
            ids = encode(t, enc)
            said = " ".join(map(word.__getitem__, ids)).encode()
            return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(decode(ids, enc)).hexdigest()

        return one

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return appended(df, per_text(make, "n_tokens long, ids_sha256 string, decoded_sha256 string", names)(F.col(text)), names)
