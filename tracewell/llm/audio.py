"""Telephony audio in media columns.

A text's bytes, padded to whole blocks, are stored as a mu-law WAV file of 8-bit samples, and beside
it the 16-bit PCM that it gives: expanded by the mu-law table and resampled from 8 to 16 kHz by a
windowed-sinc half-band filter in whole numbers. Both columns are read back for the features. The
payload is also expanded by the A-law table and decoded as IMA ADPCM blocks of 64 bytes, step by step
in numpy across all blocks of a batch, and resampled in the same way.

PCM is stored as plain samples, four bytes for each of the text, which compressed take over three times the
input. So op7 goes through all documents in SLICES parts, by a hash of the row: a part's media and PCM are written,
read back and deleted before the next part's are written, and only the rows of the result stay.
pack_pcm() is a lossless compact form for callers who keep PCM.

Defined cases: null text is empty and gives one block of zeros; repeated rows get equal results; a
very long text is worked on in parts of PART_BYTES with the filter's surroundings, so parts do not
show in the result; an empty table gives an empty result; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import buffers, row_chunks, scratch, written

RATE = 8000
BLOCK = 64
PART_BYTES = 1 << 19
#: Parts of the documents, one after the other, so that a part's PCM is about half the input on disk.
SLICES = 6
_MULAW_TAG = 7

# Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    return np.where(u & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    low, segment = (a & 0x0F) << 4, (a & 0x70) >> 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
#: By step index and 4-bit code: the signed difference.
_CODES = np.arange(16)
_SIZES = (STEPS[:, None] >> 3) + sum(np.where(_CODES & bit, STEPS[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2)))
DIFFERENCES = np.where(_CODES & 8, -_SIZES, _SIZES).astype(np.int32)
NEXT_INDEX = np.clip(np.arange(89)[:, None] + INDEX_CHANGES[_CODES & 7], 0, 88).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 64) bytes to (blocks, 121) samples: a first sample, a step index, and 120 codes, low half first."""
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK - 4):
        for half, code in enumerate((codes[k] & 15, codes[k] >> 4)):
            at = index * 16 + code
            value = np.clip(value + DIFFERENCES.ravel()[at], -32768, 32767)
            index = NEXT_INDEX.ravel()[at]
            out[1 + 2 * k + half] = value
    return np.ascontiguousarray(out.T)


#: Samples on either side of a new one.
TAPS = 8
_UNIT = 15


def filter_table() -> np.ndarray:
    """Half of the symmetric half-band filter: a sinc at distances 1/2, 3/2, ... under a Kaiser window, in units of 2**-15."""
    t = np.arange(TAPS) + 0.5
    h = np.sinc(t) * np.i0(6 * np.sqrt(1 - (t / TAPS) ** 2)) / np.i0(6.0)
    h = np.rint(h / (2 * h.sum()) * (1 << _UNIT)).astype(np.int32)
    h[0] += (1 << _UNIT - 1) - h.sum()
    return h


FILTER = filter_table()


def between(samples: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sample half a step after each, within rows that end at ends; a row's edges are continued."""
    if not len(samples):
        return np.zeros(0, "<i2")
    sizes = np.diff(np.concatenate(([0], ends)))
    at = np.arange(len(samples)) + TAPS * (2 * np.repeat(np.arange(len(ends)), sizes) + 1)
    wide = np.empty(len(samples) + 2 * TAPS * len(ends), np.int32)
    wide[at] = samples
    first = ends - sizes + TAPS * (2 * np.arange(len(ends)) + 1)
    for k in range(TAPS):
        wide[first - 1 - k] = wide[first]
        wide[first + sizes + k] = wide[first + sizes - 1]
    n = len(wide) - 2 * TAPS + 1
    # Loud samples in the filter's signs add up to more than 31 bits.
    total = np.full(n, 1 << _UNIT - 1, np.int64)
    for k, h in enumerate(FILTER.astype(np.int64)):
        total += h * (wide[TAPS - 1 - k :][:n] + wide[TAPS + k :][:n])
    return np.clip(total >> _UNIT, -32768, 32767).astype("<i2")[at - (TAPS - 1)]


def resample(samples: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample and the one between it and the next."""
    out = np.empty((len(samples), 2), "<i2")
    out[:, 0] = samples
    out[:, 1] = between(samples, ends)
    return out.ravel()


_PCM_BLOCK = 4096
_CODE_OF = np.full(1 << 16, -1, np.int16)
_CODE_OF[MULAW.view(np.uint16)] = np.arange(256)


def pack_pcm(pcm: np.ndarray) -> bytes:
    """Lossless form of any 16-bit samples at 16 kHz: count, a flag for codes, every second sample, block bits, differing blocks."""
    even, odd = pcm[0::2], pcm[1::2]
    codes = _CODE_OF[np.ascontiguousarray(even).view(np.uint16)]
    coded = bool((codes >= 0).all())
    guess = between(even.astype(np.int32), np.array([len(even)]))[: len(odd)]
    rest = np.pad(odd - guess, (0, -len(odd) % _PCM_BLOCK)).reshape(-1, _PCM_BLOCK)
    differs = rest.any(axis=1)
    return b"".join((struct.pack("<Q?", len(pcm), coded), codes.astype(np.uint8).tobytes() if coded else even.astype("<i2").tobytes(), np.packbits(differs).tobytes(), rest[differs].astype("<i2").tobytes()))


def unpack_pcm(raw: bytes) -> np.ndarray:
    n, coded = struct.unpack_from("<Q?", raw)
    evens, odds = (n + 1) // 2, n // 2
    blocks, at = -(-odds // _PCM_BLOCK), 9
    even = MULAW[np.frombuffer(raw, np.uint8, evens, at)] if coded else np.frombuffer(raw, "<i2", evens, at)
    at += evens * (1 if coded else 2)
    differs = np.unpackbits(np.frombuffer(raw, np.uint8, -(-blocks // 8), at), count=blocks).astype(bool)
    rest = np.zeros((blocks, _PCM_BLOCK), np.int16)
    rest[differs] = np.frombuffer(raw, "<i2", offset=at + -(-blocks // 8)).reshape(-1, _PCM_BLOCK)
    out = np.empty(n, "<i2")
    out[0::2] = even
    out[1::2] = between(even.astype(np.int32), np.array([evens]))[:odds] + rest.ravel()[:odds]
    return out


def wav_file(payload: bytes) -> bytes:
    """A mono mu-law file: header of 58 bytes, then the payload as it is."""
    form = struct.pack("<HHIIHHH", _MULAW_TAG, 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_payload(raw: bytes) -> bytes:
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", raw, at + 8)[0]
        if name == b"data":
            if tag != _MULAW_TAG or at + 8 + size > len(raw):
                raise ValueError("not a whole mu-law file")
            return raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


DECODERS = ("mulaw", "alaw", "adpcm")


def decoded(payloads: list[bytes], decoders: tuple[str, ...] = DECODERS) -> Iterator[tuple[int, str, np.ndarray]]:
    """(number of the payload, decoder, resampled PCM of its next part), parts in order."""
    parts = [(k, a, min(a + PART_BYTES, len(p))) for k, p in enumerate(payloads) for a in range(0, len(p), PART_BYTES)]
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + parts[end][2] - parts[end][1] <= PART_BYTES):
            held += parts[end][2] - parts[end][1]
            end += 1
        # Parts with a block on either side, which is more than the filter's reach.
        own = [(k, a, b, max(a - BLOCK, 0), min(b + BLOCK, len(payloads[k]))) for k, a, b in parts[at:end]]
        data = np.frombuffer(b"".join([payloads[k][low:high] for k, _, _, low, high in own]), np.uint8)
        ends = np.cumsum([high - low for *_, low, high in own])
        for name in decoders:
            if name == "adpcm":
                samples, each = decode_adpcm(data.reshape(-1, BLOCK)).ravel(), 1 + 2 * (BLOCK - 4)
            else:
                samples, each = (MULAW if name == "mulaw" else ALAW)[data], BLOCK
            upto = ends // BLOCK * each
            pcm = resample(samples.astype(np.int32), upto)
            for (k, a, b, low, _), first in zip(own, np.concatenate(([0], upto[:-1]))):
                start = first + (a - low) // BLOCK * each
                yield k, name, pcm[2 * start : 2 * (start + (b - a) // BLOCK * each)]
        at = end


def pcm_of(payloads: list[bytes], decoder: str = "mulaw") -> list[np.ndarray]:
    """Resampled PCM of each payload."""
    held: list[list[np.ndarray]] = [[] for _ in payloads]
    for k, _, pcm in decoded(payloads, (decoder,)):
        held[k].append(pcm)
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in held]


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def store(docs: DataFrame, decoder: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes, media (each text as a WAV file) and pcm (what it decodes to: 16-bit little-endian samples at twice the rate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for low, high in row_chunks(offsets, PART_BYTES):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[low:high], offsets[low + 1 : high + 1])]
                payloads = [padded(t) for t in texts]
                pcm = [p.astype("<i2").tobytes() for p in pcm_of(payloads, decoder)]
                columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([wav_file(p) for p in payloads], pa.binary()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], *columns], ["doc_id", "n_bytes", "media", "pcm"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_bytes long, media binary, pcm binary")


def features(payloads: list[bytes], stored: list[np.ndarray]) -> list[str]:
    """For each decoder: samples, mean size and CRC-32 of the resampled PCM; mu-law's from what was stored."""
    state = {(k, d): [0, 0, 0] for k in range(len(payloads)) for d in DECODERS}
    read = ((k, "mulaw", pcm) for k, pcm in enumerate(stored))
    for k, name, pcm in itertools.chain(read, decoded(payloads, DECODERS[1:])):
        s = state[k, name]
        s[0] += len(pcm)
        s[1] += int(np.abs(pcm.astype(np.int32)).sum(dtype=np.int64))
        s[2] = zlib.crc32(pcm, s[2])
    return [";".join(f"{d}={n},{size // max(n, 1)},{crc:08x}" for d in DECODERS for n, size, crc in [state[k, d]]) for k in range(len(payloads))]


def digests(media: DataFrame) -> DataFrame:
    """What is read back from stored media: the payload's digests and its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("media")
            _, offsets = buffers(column)
            for low, high in row_chunks(offsets, PART_BYTES):
                files = [column[k].as_py() for k in range(low, high)]
                payloads = [wav_payload(f) for f in files]
                stored = [np.frombuffer(batch.column("pcm")[k].as_buffer(), "<i2") for k in range(low, high)]
                rows = {
                    "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                    "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    "media_bytes": pa.array([len(f) for f in files], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    "feature": pa.array(features(payloads, stored)),
                }
                first = [batch.column(c)[low:high] for c in ("doc_id", "n_bytes")]
                yield pa.RecordBatch.from_arrays([*first, *rows.values()], ["doc_id", "n_bytes", *rows])

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, kinds)


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slice_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))
    found = []
    for n in range(SLICES):
        with scratch(spark):
            found.append(written(digests(written(store(docs.where(slice_of == n)), "media")), "features", lasting=True))
    return functools.reduce(DataFrame.union, found)
