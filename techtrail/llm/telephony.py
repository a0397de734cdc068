"""Telephony audio in binary columns.

``store_mulaw`` keeps a payload of 8-bit samples as a mu-law WAV file;
``read_telephony`` parses such files, expands the codes and measures them.
G.711 codes are expanded by tables of 256 entries, IMA ADPCM blocks are decoded
by numpy across all blocks of a batch at once, and the expanded audio is stored
as resampled 16-bit PCM.

Defined results: a null payload is an empty one; a WAV file that can't be
parsed gives nulls. Equal payloads give equal files and features. Rows
are independent, so repeated rows, ties and other columns don't matter. Long payloads are stored and measured whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from techtrail.llm.common import small_batches, text_or_empty

RATE = 8000
BLOCK = 576

# Format tags of WAV files.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17

# The step sizes and index changes of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
]
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """Linear value of each mu-law code (G.711, bias 132)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law code (G.711, even bits inverted)."""
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the predictor, and next index, for each (index, nibble)."""
    step = np.array(STEPS)[:, None]
    nibble = np.arange(16)[None, :]
    size = (step >> 3) + (nibble >> 2 & 1) * step + (nibble >> 1 & 1) * (step >> 1) + (nibble & 1) * (step >> 2)
    change = np.where(nibble & 8, -size, size)
    after = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGE)[nibble & 7], 0, len(STEPS) - 1)
    return change.ravel().astype(np.int32), after.ravel().astype(np.int32)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()
ADPCM_CHANGE, ADPCM_AFTER = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decode mono IMA ADPCM blocks, one a row: (blocks, bytes) uint8 to (blocks, samples) int16.

    A block is a 16-bit first sample, a step index (over 88: 88), a byte
    without meaning, then nibbles, low one first. One step decodes the
    same nibble of every block.
    """
    count, size = blocks.shape
    samples = np.empty((2 * (size - 4) + 1, count), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    samples[0] = value
    for i in range(samples.shape[0] - 1):
        codes = data[i >> 1]
        key = index * 16 + (codes >> 4 if i & 1 else codes & 15)
        value = np.clip(value + ADPCM_CHANGE[key], -32768, 32767)
        index = ADPCM_AFTER[key]
        samples[i + 1] = value
    return samples.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by a half-band filter (-1, 9, 9, -1)/16; samples beyond the ends repeat the ends."""
    if not len(pcm):
        return pcm.astype("<i2")
    wide = np.concatenate((pcm[:1], pcm, pcm[-1:], pcm[-1:])).astype(np.int32)
    out = np.empty(2 * len(pcm), "<i2")
    out[::2] = pcm
    out[1::2] = np.clip((9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4, -32768, 32767)
    return out


def write_wav(tag: int, rate: int, bits: int, align: int, data: bytes) -> bytes:
    """A mono WAV file; data of odd length gets the pad byte of RIFF."""
    body = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
    chunks = b"WAVEfmt " + struct.pack("<I", len(body)) + body + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(chunks) + len(data) % 2) + chunks + b"\0" * (len(data) % 2)


def read_wav(file: bytes) -> tuple[int, int, int, bytes] | None:
    """(format tag, rate, block align, data) of a WAV file; None if it is none."""
    if len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if kind == b"fmt " and size >= 16:
            tag, _, rate, _, align, _ = struct.unpack_from("<HHIIHH", file, at + 8)
            found = tag, rate, align
        elif kind == b"data" and found:
            return *found, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def measure(pcm: np.ndarray) -> str:
    """Mean absolute value, peak and sign changes, in whole numbers."""
    if not len(pcm):
        return "0/0/0"
    size = np.abs(pcm.astype(np.int32))
    return f"{int(size.sum()) // len(pcm)}/{int(size.max())}/{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "payload"):
        keep, payload = batch.select([x for x in batch.schema.names if x != "payload"]), batch.column("payload")
        media = pa.array([write_wav(MULAW, RATE, 8, 1, x or b"") for x in payload.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*keep.columns, media], names=[*keep.schema.names, "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "media"):
        files = [read_wav(x or b"") for x in batch.column("media").to_pylist()]
        whole = [len(x[3]) // BLOCK if x else 0 for x in files]
        joined = b"".join(x[3][: n * BLOCK] for x, n in zip(files, whole, strict=True) if n)
        adpcm = decode_adpcm(np.frombuffer(joined, np.uint8).reshape(-1, BLOCK)) if joined else None
        payloads, features, audio, at = [], [], [], 0
        for x, n in zip(files, whole, strict=True):
            if x is None:
                payloads.append(None), features.append(None), audio.append(None)
                continue
            tag, rate, _, data = x
            codes = np.frombuffer(data, np.uint8)
            linear = (ALAW_PCM if tag == ALAW else MULAW_PCM)[codes]
            other = (MULAW_PCM if tag == ALAW else ALAW_PCM)[codes]
            views = ("alaw", "mulaw") if tag == ALAW else ("mulaw", "alaw")
            blocks = adpcm[at : at + n].ravel() if n else np.empty(0, np.int16)
            at += n
            features.append(f"{views[0]}:{measure(linear)} {views[1]}:{measure(other)} adpcm:{measure(blocks)}")
            payloads.append(data)
            audio.append(write_wav(PCM, 2 * rate, 16, 2, resample_double(linear).tobytes()))
        made = [pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(audio, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "payload", "feature", "pcm"])


def _fields(df: DataFrame, **kinds) -> StructType:
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in kinds.items())])


def store_mulaw(df: DataFrame) -> DataFrame:
    """Replace the binary column payload by media: a WAV file of mu-law codes at 8 kHz."""
    return df.mapInArrow(_store, _fields(df.drop("payload"), media=BinaryType()))


def read_telephony(df: DataFrame) -> DataFrame:
    """Read the WAV files in media: adds payload, feature and pcm.

    payload is the stored codes; feature measures them as mu-law, A-law and
    ADPCM blocks of 576 bytes; pcm is a WAV file of the expanded codes as
    16-bit PCM at twice the rate.
    """
    return df.mapInArrow(_read, _fields(df, payload=BinaryType(), feature=StringType(), pcm=BinaryType()))


def store_and_read(df: DataFrame) -> DataFrame:
    """read_telephony(store_mulaw(df)) in one pass of the Python workers."""
    return df.mapInArrow(lambda batches: _read(_store(batches)), _fields(df.drop("payload"), media=BinaryType(), payload=BinaryType(), feature=StringType(), pcm=BinaryType()))


def text_payload(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload: UTF-8 text (null: empty) and bytes 255 up to a positive multiple of 576."""
    data = F.encode(text_or_empty(), "UTF-8")
    size = F.octet_length(text_or_empty())
    pad = F.when(size == 0, BLOCK).otherwise((BLOCK - size % BLOCK) % BLOCK)
    return documents.select("doc_id", size.cast("long").alias("n_bytes"), F.concat(data, F.unhex(F.repeat(F.lit("FF"), pad))).alias("payload"))


def op1_telephony_media(spark, sf_dir):
    """Texts of documents as mu-law audio: digests of what is stored and read back."""
    payloads = text_payload(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return store_and_read(payloads).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
