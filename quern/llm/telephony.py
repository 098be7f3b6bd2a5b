"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers, decoded with numpy.

mu-law and A-law codes expand through 256-entry tables. ADPCM is decoded one
sample position at a time for all blocks of a batch at once. Decoded sound is
resampled to another rate by linear interpolation in integers and kept as
16-bit PCM. All arithmetic is in integers, so results are the same everywhere.

Media form of the payload: a WAV file whose samples are the payload's bytes as
mu-law codes, 8 kHz mono; reading it back gives the bytes again.

Defined results: a null text is an empty one; the payload of an empty text is
576 padding bytes; equal texts give equal rows; repeated rows are rows of their
own; null doc_ids pass through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, UNIT, RATE = 255, 576, 8000
#: WAV format tags (fixed values).
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: IMA ADPCM index steps (fixed values).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
#: IMA ADPCM step sizes (fixed values).
STEP = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
        5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
        27086, 29794, 32767,
    ],
    dtype=np.int32,
)


@lru_cache(maxsize=2)
def expansion(law: str) -> np.ndarray:
    """int16[256]: the linear sample of every mu-law or A-law code (G.711)."""
    code = np.arange(256)
    if law == "mulaw":
        code = ~code & 255
        size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
        return np.where(code & 128, -size, size).astype(np.int16)
    code = code ^ 85
    part, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


@lru_cache(maxsize=2)
def compression(law: str) -> np.ndarray:
    """uint8[65536]: the code whose sample is nearest to each int16 (as uint16), by its expansion."""
    samples = expansion(law).astype(np.int32)
    order = np.argsort(samples, kind="stable")
    middle = (samples[order][1:] + samples[order][:-1]) / 2.0
    return order[np.searchsorted(middle, np.arange(65536, dtype=np.uint16).view(np.int16))].astype(np.uint8)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """int16[n, 2 * (size - 4) + 1] from uint8[n, size] mono IMA blocks (4-byte header, low nibble first)."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(body) + 1, len(blocks)), dtype=np.int16)
    out[0] = value = head
    for at in range(2 * len(body)):
        code = (body[at >> 1] >> (4 * (at & 1)) & 15).astype(np.int32)
        step = STEP[index]
        size = code & 7
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[size], 0, 88)
        out[at + 1] = value
    return out.T


def encode_ima(samples: np.ndarray, block: int = 256) -> np.ndarray:
    """uint8[n, block] mono IMA blocks of int16 ``samples``, the last one filled with its last sample."""
    per = 2 * (block - 4) + 1
    count = max(1, -(-len(samples) // per))
    rows = np.zeros(count * per, dtype=np.int32)
    rows[: len(samples)] = samples
    rows[len(samples) :] = samples[-1] if len(samples) else 0
    rows = rows.reshape(count, per)
    out = np.zeros((count, block), dtype=np.uint8)
    out[:, :2] = rows[:, 0].astype("<i2").view(np.uint8).reshape(count, 2)
    value, index = rows[:, 0].copy(), np.zeros(count, dtype=np.int32)
    for at in range(per - 1):
        step = STEP[index]
        gap = rows[:, at + 1] - value
        size = np.minimum(np.abs(gap) * 4 // step, 7)
        change = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(gap < 0, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEP[size], 0, 88)
        out[:, 4 + (at >> 1)] |= ((size | np.where(gap < 0, 8, 0)) << (4 * (at & 1))).astype(np.uint8)
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """int16 ``samples`` at another rate, by linear interpolation rounded down."""
    return np.concatenate([np.zeros(0, dtype=np.int16), *resampled(lambda lo, hi: samples[lo:hi], len(samples), rate, to)])


def resampled(read, n: int, rate: int, to: int, step: int = 1 << 18):
    """The same in slices of ``step`` samples; ``read(lo, hi)`` gives samples of the ``n`` there are."""
    total = n * to // rate
    for lo in range(0, total, step):
        at = np.arange(lo, min(lo + step, total), dtype=np.int64) * rate
        left, part = at // to, at % to
        start = int(left[0])
        x = read(start, min(int(left[-1]) + 2, n)).astype(np.int64)
        left -= start
        right = np.minimum(left + 1, len(x) - 1)
        yield ((x[left] * (to - part) + x[right] * part) // to).astype(np.int16)


def write_wav(data: bytes, tag: int, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono WAV file; ``align`` is the block size in bytes."""
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    speed = rate * align // (2 * (align - 4) + 1) if tag == IMA else rate * align
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, 4 if tag == IMA else bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """``(tag, rate, align, data)``; raises ValueError on anything else."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = tag, rate, align
        elif name == b"data" and form:
            return *form, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a WAV file without samples")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """``(rate, int16 samples)`` of a WAV file in any of the four forms."""
    tag, rate, align, data = read_wav(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if tag in (MULAW, ALAW):
        return rate, expansion("mulaw" if tag == MULAW else "alaw")[raw]
    if tag == IMA:
        return rate, decode_ima(raw[: len(raw) // align * align].reshape(-1, align)).ravel()
    if tag == PCM:
        return rate, raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"WAV format {tag} isn't supported")


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes before padding, and the padded payload."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes([PAD]) * (-len(raw) % UNIT or (0 if raw else UNIT))


class _Stats:
    """Samples, peak, mean square and sign changes of a sound that comes in slices."""

    def __init__(self):
        self.n, self.peak, self.power, self.turns, self.below = 0, 0, 0, 0, None

    def add(self, samples: np.ndarray) -> None:
        x = samples.astype(np.int32)
        if not len(x):
            return
        below = x < 0
        self.turns += int(np.count_nonzero(below[1:] != below[:-1])) + (self.below is not None and self.below != bool(below[0]))
        self.n, self.below = self.n + len(x), bool(below[-1])
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.power += int((x.astype(np.int64) ** 2).sum())

    def __str__(self):
        return f"{self.n},{self.peak},{self.power // max(1, self.n)},{self.turns}"


def features(datas: list[bytes], to: int = 16000, step: int = 1024 * UNIT, also: tuple[int, ...] = ()) -> list[tuple]:
    """For each payload: its feature string, its sound as 16-bit PCM resampled to ``to`` Hz, and to each rate of ``also``.

    mu=, a= and ima= give samples, peak, mean square and sign changes under that reading; pcm= is a
    CRC of the resampled mu-law sound, ``to``'s the last. ADPCM blocks of all payloads are decoded together, and payloads above
    ``step`` bytes in slices, so besides the payload and its PCM only a slice is held.
    """
    small = [d for d in datas if len(d) <= step]
    decoded, at = decode_ima(np.frombuffer(b"".join(small), dtype=np.uint8).reshape(-1, UNIT)) if small else None, 0
    out = []
    for data in datas:
        raw, law = np.frombuffer(data, dtype=np.uint8), expansion("mulaw")
        mu, a, ima = _Stats(), _Stats(), _Stats()
        for lo in range(0, len(raw), step):
            part = raw[lo : lo + step]
            mu.add(law[part])
            a.add(expansion("alaw")[part])
            if len(raw) > step:
                ima.add(decode_ima(part.reshape(-1, UNIT)).ravel())
            else:
                ima.add(decoded[at : at + len(raw) // UNIT].ravel())
                at += len(raw) // UNIT
        sounds = {}
        for rate in (*also, to):
            sounds[rate] = b"".join(x.astype("<i2").tobytes() for x in resampled(lambda lo, hi: law[raw[lo:hi]], len(raw), RATE, rate))  # noqa: B023
        crcs = "".join(f";pcm{rate}={zlib.crc32(pcm):08x}" for rate, pcm in sounds.items())
        out.append((f"mu={mu};a={a};ima={ima}{crcs}", sounds[to], *(sounds[rate] for rate in also)))
    return out


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string"
)


def store_texts(docs: DataFrame, keep_media: bool = False, budget: int = 4 << 20, to: int = 16000, also: tuple[int, ...] = ()) -> DataFrame:
    """A row of digests, features and ``pcm``, the sound resampled to ``to`` Hz, for each row of ``docs(doc_id, text)``.

    Each rate of ``also`` (others than ``to``) adds a column ``pcm<rate>``. ``keep_media`` adds ``media`` (the WAV file). ``budget`` is the payload held at once, in bytes (a longer text is held alone).
    """
    schema = SCHEMA + ", pcm binary" + "".join(f", pcm{rate} binary" for rate in also) + (", media binary" if keep_media else "")

    def rows(ids, files):
        read = [read_wav(media)[3] for _, media in files]
        for doc, (n, media), data, (feature, *sounds) in zip(ids, files, read, features(read, to, also=also)):
            row = (
                doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), feature, *sounds,
            )
            yield (*row, media) if keep_media else row

    def run(batches):
        names = [c.strip().split(" ")[0] for c in schema.split(",")]

        def frame(ids, files):
            out = pd.DataFrame(list(rows(ids, files)), columns=names)
            return out.astype({"doc_id": "Int64"})

        for batch in batches:
            ids, files, held = [], [], 0
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                n, data = payload(text)
                if held and held + len(data) > budget:
                    yield frame(ids, files)
                    ids, files, held = [], [], 0
                ids.append(doc)
                files.append((n, write_wav(data, MULAW)))
                held += len(data)
            if ids:
                yield frame(ids, files)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, schema)


def op1_telephony(spark, sf_dir):
    """Twice the telephone rate with every sample interpolated (``pcm16000``), and half of it (``pcm``: every other sample, a byte of sound for a byte of text)."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), to=RATE // 2, also=(2 * RATE,))
