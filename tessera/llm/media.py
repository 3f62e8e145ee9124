"""Media columns: telephony audio in WAV containers.

mu-law and A-law samples are expanded by lookup tables that are computed from the companding rules. IMA ADPCM is decoded
with numpy across blocks: every block of a batch advances by one sample at a time. Decoded audio can be stored as
resampled 16-bit PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import appended, strings

#: Format numbers of the container.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
RATE = 8000
#: Bytes of an ADPCM block here: a header of 4 bytes and two samples a byte.
BLOCK = 576


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (low + 256) << np.maximum(exponent - 1, 0), low)
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM, about a tenth apart, up to 32767."""
    # Fixed values of the IMA ADPCM format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], dtype=np.int32)


MU, A, STEPS = mu_law_table(), a_law_table(), ima_steps()
# By step index * 16 + nibble: the change of the predicted sample, and the next step index * 16.
_N = np.arange(16)
DELTA = ((STEPS[:, None] >> 3) + np.where(_N & 4, STEPS[:, None], 0) + np.where(_N & 2, STEPS[:, None] >> 1, 0) + np.where(_N & 1, STEPS[:, None] >> 2, 0)) * np.where(_N & 8, -1, 1)
DELTA = DELTA.astype(np.int32).reshape(-1)
ONWARD = (np.clip(np.arange(89)[:, None] + np.where(_N & 4, 2 * (_N & 3) + 2, -1), 0, 88) * 16).astype(np.int32).reshape(-1)


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, (blocks, bytes) in and (blocks, samples) out. Step indices beyond 88 count as 88."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = sample
    for k in range(width - 4):
        for half, nibble in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = index + nibble
            sample += DELTA[at]
            np.clip(sample, -32768, 32767, out=sample)
            index = ONWARD[at]
            out[1 + 2 * k + half] = sample
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between samples, in whole numbers; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.repeat(pcm, 2)
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) // 2
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    whole, part = at // to, at % to
    wide = np.append(pcm, pcm[-1:]).astype(np.int64)
    return ((wide[whole] * (to - part) + wide[whole + 1] * part) // to).astype(np.int16)


def wav(data: bytes, kind: int, rate: int = RATE) -> bytes:
    bits, block = {PCM: (16, 2), A_LAW: (8, 1), MU_LAW: (8, 1), IMA_ADPCM: (4, BLOCK)}[kind]
    per_second = rate * bits // 8 if kind != IMA_ADPCM else rate * BLOCK // (2 * (BLOCK - 4) + 1)
    head = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, bits) + (b"" if kind == PCM else struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if kind == IMA_ADPCM else b"\0\0")
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[int, int, int, memoryview]:
    """Kind, rate, block size and stored bytes of a container; ValueError if it is none."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE container")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
        elif name == b"data" and form:
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the container")


def pcm_of(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a container with mono audio of any of the four kinds."""
    kind, rate, block, data = parse(media)
    raw = np.frombuffer(data, np.uint8)
    if kind == MU_LAW:
        return MU[raw], rate
    if kind == A_LAW:
        return A[raw], rate
    if kind == IMA_ADPCM:
        return adpcm(raw[: len(raw) // block * block].reshape(-1, block)).reshape(-1), rate
    if kind == PCM:
        return np.frombuffer(data, "<i2"), rate
    raise ValueError(f"format {kind} isn't handled")


def pcm_column(df: DataFrame, media: str = "media", out: str = "pcm", rate: int = 16_000) -> DataFrame:
    """df with a column of 16-bit PCM containers at the given rate, decoded from any of the kinds. Null and unreadable media give null."""

    @F.pandas_udf("binary")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            got = []
            for m in batch:
                try:
                    pcm, own = pcm_of(m)
                    got.append(wav(resample(pcm, own, rate).astype("<i2").tobytes(), PCM, rate))
                except (TypeError, ValueError, struct.error):
                    got.append(None)
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, convert(F.col(media)))


def padded(text: str, unit: int = BLOCK) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with n_bytes and a mu-law container whose samples are the text's UTF-8 bytes, padded by 255 to a positive multiple of 576.

    Null and empty texts are one padded stretch. A very long text is one container of its length. Repeated rows are stored
    each, alike; own columns of the two new names give way; an empty table gives no rows."""

    @F.pandas_udf("n_bytes long, media binary")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [padded(t) for t in strings(batch)]
            yield pd.DataFrame({"n_bytes": [n for n, _ in both], "media": [wav(p, MU_LAW) for _, p in both]})

    names = ["n_bytes", out]
    return appended(df, build(F.col(text)).cast(f"struct<n_bytes:bigint,{out}:binary>"), names)


#: ADPCM blocks that are decoded together.
LANES = 4096


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the digests of what its containers hold, read back from the stored bytes, and a feature string.

    The stored samples are expanded as mu-law and as A-law (sum of squares and sign changes), decoded as ADPCM blocks
    (checksum) and resampled to 16 kHz PCM (checksum and length). All are whole numbers, so equal media give equal values.
    A null or unreadable container gives nulls, one without samples zeros; one of any length is read whole. Repeated rows are
    read each, own columns of these names give way, and an empty table gives no rows."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def readable(m: bytes | None) -> tuple | None:
        try:
            return None if m is None else parse(m)
        except (ValueError, struct.error):
            return None

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media, at, rows = list(batch), 0, []
            while at < len(media):
                end, held = at, 0
                while end < len(media) and (end == at or held < LANES * BLOCK):
                    held += len(media[end] or b"")
                    end += 1
                parsed = [readable(m) for m in media[at:end]]
                raws = [np.frombuffer(p[3], np.uint8) if p else np.zeros(0, np.uint8) for p in parsed]
                blocks = [r[: len(r) // BLOCK * BLOCK].reshape(-1, BLOCK) for r in raws]
                ends = np.cumsum([len(b) for b in blocks])
                spoken = adpcm(np.concatenate(blocks))
                for m, p, raw, b, e in zip(media[at:end], parsed, raws, blocks, ends):
                    if p is None:
                        rows.append((None,) * len(names))
                        continue
                    _, rate, _, data = p
                    mu, a = MU[raw], A[raw]
                    wide = resample(mu, rate, 2 * rate)
                    voice = np.ascontiguousarray(spoken[e - len(b) : e])
                    power = [int(np.dot(x.astype(np.float64), x)) for x in (mu, a)]
                    turns = [int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) for x in (mu, a)]
                    feature = f"mu:{power[0]}/{turns[0]} a:{power[1]}/{turns[1]} adpcm:{voice.size}/{zlib.crc32(voice):08x} pcm16k:{wide.size}/{zlib.crc32(wide):08x}"
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                at = end
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return appended(df, describe(F.col(media)), names)
