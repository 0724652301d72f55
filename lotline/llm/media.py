"""Media columns: telephony audio.

Mu-law and A-law bytes expand to 16-bit samples by lookup; IMA ADPCM blocks are decoded
with numpy across blocks (one step of every block at a time); decoded audio is resampled
(by linear interpolation in integers when the rate rises, by a polyphase low-pass filter when
it falls) and stored as PCM. Files are RIFF/WAVE.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: WAVE format codes.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
RATE = 8000

# Fixed values of the public IMA ADPCM definition.
STEP_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
STEPS = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte (ITU-T G.711)."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = (a >> 4) & 7, ((a & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(0, exponent - 1), size)
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def compress(samples: np.ndarray, code: int) -> bytes:
    """The byte of the nearest value in the code's table for each 16-bit sample."""
    table = TABLES[code].astype(np.int32)
    order = np.argsort(table, kind="stable")
    values = table[order]
    edges = (values[1:] + values[:-1]) / 2
    return order[np.searchsorted(edges, samples.astype(np.int32))].astype(np.uint8).tobytes()


def adpcm_decode(data: bytes, block_bytes: int) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, all blocks stepped together; a short last block is padded with zeros."""
    n = -(-len(data) // block_bytes)
    raw = np.zeros(n * block_bytes, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw = raw.reshape(n, block_bytes)
    out = np.empty((n, 1 + 2 * (block_bytes - 4)), np.int16)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    steps, moves = np.array(STEPS, np.int32), np.array(STEP_INDEX, np.int32)
    for k in range(2 * (block_bytes - 4)):
        nibble = (raw[:, 4 + k // 2] >> (4 * (k % 2))) & 15
        step = steps[index]
        size = nibble & 7
        delta = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + moves[size], 0, 88)
        out[:, k + 1] = value
    return out.ravel()


def adpcm_encode(samples: np.ndarray, block_bytes: int) -> bytes:
    """Mono IMA ADPCM blocks of the samples, the last one padded with zeros."""
    per = 1 + 2 * (block_bytes - 4)
    n = -(-len(samples) // per)
    x = np.zeros(n * per, np.int32)
    x[: len(samples)] = samples
    x = x.reshape(n, per)
    raw = np.zeros((n, block_bytes), np.uint8)
    raw[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    steps, moves = np.array(STEPS, np.int32), np.array(STEP_INDEX, np.int32)
    # a block starts with the step that its first change asks for
    value, index = x[:, 0].copy(), np.minimum(np.searchsorted(steps, np.abs(x[:, 1] - x[:, 0])), 88).astype(np.int32)
    raw[:, 2] = index
    for k in range(per - 1):
        step, gap = steps[index], x[:, k + 1] - value
        size, rest, delta = np.zeros(n, np.int32), np.abs(gap), step >> 3
        for bit in (2, 1, 0):
            part = step >> (2 - bit)
            take = rest >= part
            size |= take << bit
            rest -= np.where(take, part, 0)
            delta = delta + np.where(take, part, 0)
        value = np.clip(np.where(gap < 0, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + moves[size], 0, 88)
        raw[:, 4 + k // 2] |= ((size | np.where(gap < 0, 8, 0)) << (4 * (k % 2))).astype(np.uint8)
    return raw.tobytes()


def wav(code: int, data: bytes, rate: int = RATE, block_bytes: int = 1) -> bytes:
    """A mono WAVE file of these stored bytes."""
    bits = {PCM: 16, ALAW: 8, MULAW: 8, IMA_ADPCM: 4}[code]
    align = {PCM: 2, IMA_ADPCM: block_bytes}.get(code, 1)
    per = 1 + 2 * (block_bytes - 4)
    extra = struct.pack("<HH", 2, per) if code == IMA_ADPCM else b"" if code == PCM else struct.pack("<H", 0)
    second = rate * align // (per if code == IMA_ADPCM else 1)
    fmt = struct.pack("<HHIIHH", code, 1, rate, second, align, bits) + extra
    samples = len(data) // align * (per if code == IMA_ADPCM else 1)
    fact = b"" if code == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format code, rate, block bytes, stored bytes) of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, head, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and head:
            return head[0], head[2], head[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no format or no data")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a WAVE file."""
    code, rate, block, data = parse_wav(media)
    if code in TABLES:
        return TABLES[code][np.frombuffer(data, np.uint8)], rate
    if code == IMA_ADPCM:
        return adpcm_decode(bytes(data), block), rate
    if code == PCM:
        return np.frombuffer(data, "<i2"), rate
    raise ValueError(f"format {code}")


def resample(samples: np.ndarray, up: int = 2, down: int = 1) -> np.ndarray:
    """Linear-phase resampling by up/down in integer arithmetic: output k lies at input position k * down / up."""
    n = len(samples) * up // down
    if not len(samples):
        return np.zeros(0, np.int16)
    at = np.arange(n, dtype=np.int64) * down
    left, part = at // up, (at % up).astype(np.int32)
    x = samples.astype(np.int32)
    right = np.minimum(left + 1, len(x) - 1)
    return ((x[left] * (up - part) + x[right] * part) // up).astype(np.int16)


def double_rate(samples: np.ndarray) -> np.ndarray:
    """resample(samples, 2, 1), without index arrays."""
    x = samples.astype(np.int32)
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    out[1:-1:2] = (x[:-1] + x[1:]) // 2
    out[-1:] = x[-1:]
    return out


def low_pass(up: int, down: int, zeros: int = 8) -> np.ndarray:
    """Taps of a windowed sinc that cuts at the lower of both rates, in units of 1 / 2**15, for a signal filled up with zeros."""
    wide = max(up, down)
    t = np.arange(-zeros * wide, zeros * wide + 1)
    taps = np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1]
    return np.round(taps / taps.sum() * up * (1 << 15)).astype(np.int64)


def decimate(samples: np.ndarray, up: int, down: int) -> np.ndarray:
    """Resampling by up/down through low_pass, phase by phase in whole numbers; what lies above the new rate's half is damped.

    No samples give none; a constant stays what it is but for the ends, where silence comes in.
    """
    taps, x = low_pass(up, down), samples.astype(np.int64)
    half, n = len(taps) // 2, len(x) * up // down
    if not n:
        return np.zeros(0, np.int16)
    out, place = np.empty(n, np.int64), np.arange(n, dtype=np.int64) * down + half  # in the filled-up signal, past the first taps
    padded = np.concatenate((np.zeros(len(taps), np.int64), x, np.zeros(len(taps), np.int64)))
    for phase in range(up):
        at = np.flatnonzero(place % up == phase)
        own = taps[phase::up]
        first = place[at] // up + len(taps)
        out[at] = sum(int(h) * padded[first - k] for k, h in enumerate(own)) >> 15
    return np.clip(out, -32768, 32767).astype(np.int16)


def feature_text(samples: np.ndarray) -> str:
    """n, peak, mean square, zero crossings and the CRC-32 of 16 kHz PCM, all integers."""
    x = samples.astype(np.int64)
    peak = int(np.abs(x).max()) if len(x) else 0
    square = int((x * x).sum()) // max(1, len(x))
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"n={len(x)};peak={peak};ms={square};zc={crossings};pcm={zlib.crc32(samples.astype('<i2').tobytes()):08x}"


def store_payload(payload: bytes, code: int = MULAW) -> bytes:
    """The payload as 8-bit samples of a WAVE file, without loss: each byte is one code word."""
    if code not in TABLES:
        raise ValueError("only 8-bit codes keep any byte as it is")
    return wav(code, payload)


def audio_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", code: int = MULAW, unit: int = 64) -> DataFrame:
    """A row for each text: its UTF-8 padded with zeros to a positive multiple of `unit`, stored as audio, read back.

    Null texts count as empty (one unit of zeros); equal texts give equal values; repeated rows stay.
    Columns other than the two named are neither read nor kept.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        out: list[list] = [[] for _ in range(8)]
        for i in range(texts.n):
            raw = bytes(texts.bytes_of(i))
            payload = raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))
            media = store_payload(payload, code)
            back = parse_wav(media)[3]
            samples, _ = decode(media)
            for column, x in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(double_rate(samples)), None), strict=True):
                column.append(x)
        return rows.column(0), *out[:7]

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", 1 << 20)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", code: int = MULAW, unit: int = 64) -> DataFrame:
    """(id, media, pcm): the stored file and its 16 kHz PCM as WAVE, for each row.

    Null and empty texts are one unit of zeros; equal texts give equal files, repeated rows stay, an empty table gives
    no rows; a file is as long as its text, so a very long text is one large file. Other columns go, whatever their names.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(rows, texts):
        media, pcm = [], []
        for i in range(texts.n):
            raw = bytes(texts.bytes_of(i))
            media.append(store_payload(raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), code))
            samples, rate = decode(media[-1])
            pcm.append(wav(PCM, double_rate(samples).astype("<i2").tobytes(), 2 * rate))
        return rows.column(0), media, pcm

    return map_texts(df, [id_col], text_col, run, f"`{id_col}` {id_type}, media binary, pcm binary", 1 << 20)
