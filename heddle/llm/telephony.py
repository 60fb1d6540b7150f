"""Telephony audio columns: mu-law and A-law by lookup tables, IMA ADPCM across blocks, resampled PCM.

``store`` keeps a text's bytes as samples of a mu-law (G.711) WAVE file (format 7, 8 kHz mono) in a binary column.
``read_back`` parses such files and appends their samples, features and the resampled PCM as a WAVE file of 16 kHz.
ADPCM blocks (IMA, mono, fixed size) start with their own predictor and step index, so all blocks of a batch are
encoded, or decoded, together, one sample of all blocks at a time. Resampling doubles the rate by a symmetric
half-band filter in integers.

Null texts count as empty; an empty payload is 64 zero bytes. Equal texts give equal values, so repeated rows do. A
null or damaged file has no samples and null in all that follows from them. Empty tables give empty results; input
columns named like a new one are replaced, all others stay.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import append, pieces

UNIT = 64
RATE = 8000
MU_LAW, A_LAW = 7, 6


def _mu_law() -> np.ndarray:
    """16-bit PCM of each mu-law byte (G.711): inverted sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    b = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return np.where(b & 0x80, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    """16-bit PCM of each A-law byte (G.711): even bits inverted, 3-bit exponent, 4-bit mantissa."""
    b = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = b >> 4 & 7, (b & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """The 89 IMA step sizes: from 7, each about a tenth more than the one before, to 32767."""
    # fixed values of the IMA ADPCM format
    return np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


MU, A, STEP = _mu_law(), _a_law(), _steps()
#: Change of the step index by a code's low three bits: fixed values of the IMA ADPCM format.
MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each step index and code the change of the predictor, and the next step index."""
    step, code = STEP[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    change = np.where(code & 8, -size, size).astype(np.int32)
    after = np.clip(np.arange(len(STEP))[:, None] + MOVE[code & 7], 0, len(STEP) - 1).astype(np.int32)
    return change.ravel(), (after * 16).ravel().astype(np.int32)


CHANGE, AFTER = _code_tables()


def expand(samples: bytes, law: int) -> np.ndarray:
    return (MU if law == MU_LAW else A)[np.frombuffer(samples, np.uint8)]


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows of bytes: predictor as little-endian int16, step index, 0, then codes)."""
    n, size = blocks.shape
    low = np.ascontiguousarray(blocks.T)
    value = (low[0].astype(np.int32) | low[1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    state = np.minimum(low[2], len(STEP) - 1).astype(np.int32) * 16
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    at = 1
    for byte in low[4:]:
        for code in (byte & 15, byte >> 4):
            k = state + code
            value += CHANGE[k]
            np.clip(value, -32768, 32767, out=value)
            state = AFTER[k]
            out[at] = value
            at += 1
    return out.T


def to_adpcm(pcm: np.ndarray, size: int = UNIT) -> np.ndarray:
    """IMA ADPCM blocks of PCM samples, 1 + 2 * (size - 4) a block; the last one is filled up with the last sample.

    A block's first step is the one next to its mean difference, so it needs nothing of the block before it.
    """
    per = 1 + 2 * (size - 4)
    n = -(-len(pcm) // per)
    x = np.pad(pcm.astype(np.int32), (0, n * per - len(pcm)), mode="edge").reshape(n, per).T if n else np.zeros((per, 0), np.int32)
    return _adpcm_blocks(np.ascontiguousarray(x), size)


def _adpcm_blocks(x: np.ndarray, size: int) -> np.ndarray:
    """Blocks of samples, a block a column."""
    out = np.zeros((size, x.shape[1]), np.uint8)
    value = x[0].copy()
    index = np.minimum(np.searchsorted(STEP, np.abs(np.diff(x, axis=0)).mean(axis=0)), len(STEP) - 1).astype(np.int32)
    out[0], out[1], out[2] = value & 255, value >> 8 & 255, index
    state = index * 16
    for at in range(1, len(x)):
        left = x[at] - value
        code = np.where(left < 0, 8, 0)
        left, step = np.abs(left), STEP[state >> 4]
        for bit in (4, 2, 1):
            hit = left >= step
            code += bit * hit
            left -= step * hit
            step = step >> 1
        k = state + code
        value = np.clip(value + CHANGE[k], -32768, 32767)
        state = AFTER[k]
        out[4 + (at - 1 >> 1)] |= (code << (4 * (at - 1 & 1))).astype(np.uint8)
    return np.ascontiguousarray(out.T)


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and between two of them (9 (b + c) - (a + d)) / 16."""
    x = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def wave(samples: bytes, law: int = MU_LAW, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono WAVE file of samples in the given format (1 for PCM)."""
    unit = bits // 8
    form = struct.pack("<HHIIHHH", law, 1, rate, rate * unit, unit, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(samples) // unit)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) & 1)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def unwave(data: bytes | None) -> tuple[int, int, bytes] | None:
    """Format, rate and samples of a WAVE file, its chunks in any order; None where a chunk is missing or cut short."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, found = 12, {}
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > len(data):
            return None
        found.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    if len(found.get(b"fmt ", b"")) < 16 or b"data" not in found:
        return None
    law, _, rate = struct.unpack_from("<HHI", found[b"fmt "])
    return law, rate, found[b"data"]


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def features(stored: list[bytes]) -> list[tuple[str, np.ndarray]]:
    """What is computed from each item's mu-law samples, and their resampled PCM.

    Levels of the mu-law, the A-law and the ADPCM reading, zero crossings, and sums of the decoded ADPCM and of the
    resampled PCM. The ADPCM blocks of all items are encoded and decoded in one pass.
    """
    level = lambda x: int(np.abs(x, dtype=np.int32).sum(dtype=np.int64)) // max(1, x.size)
    sound, per = [expand(x, MU_LAW) for x in stored], 1 + 2 * (UNIT - 4)
    ends = np.cumsum([0, *(-(-len(x) // per) for x in sound)])
    filled = [np.pad(x, (0, -len(x) % per), mode="edge") if len(x) else x for x in sound]
    coded = to_adpcm(np.concatenate([np.empty(0, np.int16), *filled]))
    decoded_, out = adpcm(coded), []
    for raw, mu, a, b in zip(stored, sound, ends, ends[1:]):
        back = np.ascontiguousarray(decoded_[a:b]).ravel()[: len(mu)]
        pcm = resampled(mu)
        crosses = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
        out.append((f"mu:{level(mu)};a:{level(expand(raw, A_LAW))};adpcm:{level(back)}:{zlib.crc32(coded[a:b]):08x}:{zlib.crc32(back):08x};zero:{crosses};pcm16k:{level(pcm)}:{zlib.crc32(pcm):08x}", pcm))
    return out


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Appends ``n_bytes`` of the text as UTF-8 and ``media``, its payload as a mu-law WAVE file."""

    def make():
        return lambda texts: [[len((t or "").encode()) for t in texts], [wave(payload(t)) for t in texts]]

    return append(df, text, [T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())], make, rows=256)


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """Appends ``payload`` (the samples of a stored mu-law file), ``feature`` and ``pcm_16k``, a WAVE file of 16-bit PCM."""
    new = [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("pcm_16k", T.BinaryType())]
    keep = [c for c in df.columns if c not in {f.name for f in new}]
    schema = T.StructType([df.schema[c] for c in keep] + new)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 256, media):
                found = [unwave(x) for x in part.column(media).to_pylist()]
                samples = [x[2] if x and x[0] == MU_LAW else None for x in found]
                made = iter(features([x for x in samples if x is not None]))
                made = [(None, None) if x is None else next(made) for x in samples]
                sound = [None if p is None else wave(p.tobytes(), 1, 2 * RATE, 16) for _, p in made]
                cols = [pa.array(samples, pa.binary()), pa.array([f for f, _ in made], pa.string()), pa.array(sound, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], names=[*keep, *(f.name for f in new)])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, media: str = "media") -> DataFrame:
    """Appends sizes and hashes of the columns that ``store`` and ``read_back`` made, and takes the binary columns away."""
    out = df.withColumns({
        "payload_bytes": F.length("payload").cast("long"),
        "payload_sha256": F.sha2("payload", 256),
        "tail_crc32": F.crc32(F.expr(f"substring(payload, greatest(length(payload) - {UNIT - 1}, 1), {UNIT})")),
        "media_bytes": F.length(media).cast("long"),
        "media_sha256": F.sha2(media, 256),
        "pcm_bytes": F.length("pcm_16k").cast("long"),
        "pcm_sha256": F.sha2("pcm_16k", 256),
    })
    return out.drop(media, "payload", "pcm_16k")


def decoded(df: DataFrame, audio: str, codec: str, block: int = 256) -> DataFrame:
    """Appends ``pcm``, little-endian 16-bit PCM of a binary column of raw ``mu``, ``a`` or ``adpcm`` data.

    ADPCM data of a batch are decoded in one pass over all their blocks; bytes after the last whole block
    are ignored. Null stays null.
    """
    keep = [c for c in df.columns if c != "pcm"]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("pcm", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for b in pieces(batch, 512, audio):
                data = b.column(audio).to_pylist()
                if codec == "adpcm":
                    whole = [x[: len(x) // block * block] if x else b"" for x in data]
                    pcm = adpcm(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, block))
                    ends = np.cumsum([0, *(len(x) // block for x in whole)])
                    got = [None if x is None else pcm[s:e].tobytes() for x, s, e in zip(data, ends, ends[1:], strict=False)]
                else:
                    got = [None if x is None else expand(x, MU_LAW if codec == "mu" else A_LAW).tobytes() for x in data]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.binary())], names=[*keep, "pcm"])

    return df.mapInArrow(run, schema)
